"""Operators for preparing training text: deduplication, quality, language-model scores, mixing, chat and tokens."""
