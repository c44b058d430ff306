"""Operators for building training corpora: scans, dedup, language models, mixing, packing, token files."""
