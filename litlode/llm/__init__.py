"""Operators for preparing training data for language models.

Nothing outside this subpackage imports it: the folder can be removed and the
rest of the library still works.
"""
