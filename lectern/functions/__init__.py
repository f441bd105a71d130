"""Column functions: text (tokens, hashes, citations, ...) and scope predicates."""
