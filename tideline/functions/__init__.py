"""Column expressions: texts, tokens, distributions."""
