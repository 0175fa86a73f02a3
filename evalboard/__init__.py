"""Evaluation leaderboards on Spark."""
