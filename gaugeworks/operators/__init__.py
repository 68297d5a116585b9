"""Operators over corpora."""
