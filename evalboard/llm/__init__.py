"""Training-data operators: deduplication, packing, sharding, mixing, token files, language, media, licences, quality.

Nothing outside this subpackage imports it.
"""
