"""Operators for preparing language-model training text.

Nothing outside this subpackage imports it; remove the folder and the rest
of the library still works.
"""
