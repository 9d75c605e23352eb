"""The same scores and metrics over streams."""
