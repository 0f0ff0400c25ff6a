"""Operators over record sets and corpora."""
