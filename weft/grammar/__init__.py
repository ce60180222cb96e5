"""Grammars and the recogniser that runs them."""
