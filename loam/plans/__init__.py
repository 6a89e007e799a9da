"""Helpers that shape physical plans."""
