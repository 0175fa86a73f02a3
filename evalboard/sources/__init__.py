"""Readers and writers: result tables, submissions, document sets."""
