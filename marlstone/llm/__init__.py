"""Operators for preparing training data: ten components, their queries and their SQL."""
