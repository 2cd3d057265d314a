"""Operators that prepare training text.  Nothing outside this folder imports it."""
