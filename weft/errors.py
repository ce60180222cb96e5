"""Errors that a caller can act on."""

from __future__ import annotations


class WeftError(Exception):
    """The base of all of them."""


class ConfigError(WeftError, ValueError):
    """A configuration file cannot be read or does not fit."""


class GraphNotFound(WeftError, FileNotFoundError):
    """There is no stored graph."""


class StoreError(WeftError, ValueError):
    """A stored graph cannot be read."""


class NodeNotFound(WeftError, LookupError):
    """No node is meant; ``suggestions`` are nodes that look alike, as dicts of id, name, type and file_path."""

    def __init__(self, query: str, suggestions: list[dict]):
        super().__init__(f"No node matches {query!r}.")
        self.query, self.suggestions = query, suggestions


class AmbiguousNode(WeftError, LookupError):
    """Several nodes are meant at the same stage; ``candidates`` are all of them, as dicts of id, name, type and file_path."""

    def __init__(self, query: str, candidates: list[dict]):
        super().__init__(f"Ambiguous node {query!r}.")
        self.query, self.candidates = query, candidates
