"""Operators over ordered, optionally keyed series."""
