"""Corpus preparation for language models: ten operators and their queries."""
