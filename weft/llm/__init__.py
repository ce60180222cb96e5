"""Operators for text corpora and duplicate records. Nothing outside this subpackage imports it."""
