"""Operators on message, score and cohort tables."""
