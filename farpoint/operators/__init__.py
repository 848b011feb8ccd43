"""Relational operators of the scoring pipeline."""
