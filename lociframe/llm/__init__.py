"""Operators for text and sequence corpora; nothing outside this subpackage imports it."""
