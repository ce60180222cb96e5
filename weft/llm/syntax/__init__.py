"""Syntax checks by generalised LL parsing."""
