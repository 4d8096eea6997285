"""Operators over training text. Nothing outside this subpackage imports it."""
