"""Operators for training-data pipelines: search, language, duplicates, transcripts, quality, secrets, tokens, packing."""
