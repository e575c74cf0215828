"""Operators on text and on numbers about text; nothing outside this package imports it."""
