"""Operators for text corpora: near copies, secrets, quality, language models, lines, pieces, shards, leaks, languages, personal data."""
