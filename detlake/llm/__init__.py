"""Operators for preparing training text, written for corpora of any size."""
