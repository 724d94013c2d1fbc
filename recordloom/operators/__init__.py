"""Operators over track frames: grouping, fuzzy matching and statistics."""
