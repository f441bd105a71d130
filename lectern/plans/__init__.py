"""Compositions: indexing a snapshot, hybrid search, chat prompts."""
