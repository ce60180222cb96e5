"""Tables that SQL text reads and writes, found by scanning tokens; nothing is executed.

Only text that the grammar of one dialect accepts as a whole gives facts; statements without a place in the grammar, such
as those that set options, are passed over.
The scanner knows where table names stand (after FROM, JOIN, INTO, UPDATE, USING, TABLE and commas of a FROM list), keeps
brackets apart as scopes, and leaves out names of common table expressions, functions and the written table.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

from weft.grammar import sql as grammar

_TOKEN = re.compile(
    r"(?P<skip>\s+|--[^\n]*|/\*[\s\S]*?\*/)|(?P<string>'(?:[^'\\]|''|\\[\s\S])*')|(?P<quoted>\"(?:[^\"]|\"\")+\"|`[^`]+`|\[[A-Za-z_][^\]\n]*\])"
    r"|(?P<number>\d[\w.]*|\.\d+)|(?P<word>[^\W\d][\w$]*)|(?P<op>::|<=>|<>|!=|<=|>=|\|\||->>?|[-+*/%^&|~<>=!.,;:()?@#$\[\]{}])"
)
#: First words of statements that are understood, and of those that are passed over; fixed values.
_READS = frozenset((
    "select", "with", "values", "table", "from",
))
_WRITES = frozenset((
    "insert", "update", "delete", "merge", "create", "replace", "upsert",
))
_OTHER = frozenset((
    "set", "use", "drop", "alter", "truncate", "grant", "revoke", "begin", "commit", "rollback", "explain", "describe", "show", "analyze", "start",
))
#: Words that end the list of tables of a FROM clause, or cannot be an alias.
_CLAUSE = frozenset((
    "where", "group", "order", "having", "limit", "union", "intersect", "except", "minus", "window", "qualify", "on", "using", "set", "values",
    "select", "when", "then", "returning", "offset", "fetch", "for", "join", "inner", "left", "right", "full", "cross", "natural", "lateral", "outer",
    "anti", "semi", "pivot", "unpivot", "tablesample", "into", "from", "as", "partition", "cluster", "distribute", "sort", "with", "and", "or", "not",
    "is", "in",
))
_NOT_FROM = frozenset(("extract", "substring", "trim", "position", "overlay"))


class SqlError(ValueError):
    """The text is no SQL that can be read."""


@dataclass(frozen=True)
class SqlFact:
    """The tables a statement reads, in order, and the one it writes."""

    sources: tuple[str, ...]
    target: str | None


def normal_name(parts: list[str]) -> str | None:
    """Dotted parts in lower case without quotes and brackets."""
    out = [p for p in (re.sub(r"^[\s`'\"\[\]]+|[\s`'\"\[\]]+$", "", part).lower() for part in parts) if p]
    return ".".join(out) or None


def _tokens(sql: str) -> list[tuple[str, str]]:
    out, at = [], 0
    for m in _TOKEN.finditer(sql):
        if m.start() != at:
            raise SqlError(f"unexpected text at offset {at}")
        at = m.end()
        if m.lastgroup != "skip":
            out.append((m.lastgroup, m.group()))
    if at != len(sql):
        raise SqlError(f"unexpected text at offset {at}")
    return out


def _statements(tokens: list[tuple[str, str]]) -> list[list[tuple[str, str]]]:
    out, depth = [[]], 0
    for kind, text in tokens:
        if text == "(" and kind == "op":
            depth += 1
        elif text == ")" and kind == "op":
            depth -= 1
            if depth < 0:
                raise SqlError("a closing bracket without an opening one")
        if text == ";" and kind == "op" and not depth:
            out.append([])
        else:
            out[-1].append((kind, text))
    if depth:
        raise SqlError("an opening bracket without a closing one")
    return [s for s in out if s]


class _Reader:
    def __init__(self, tokens: list[tuple[str, str]]):
        self.tokens = tokens
        self.found: list[str] = []
        self.ctes: set[str] = set()
        self.target: str | None = None

    def word(self, at: int) -> str:
        return self.tokens[at][1].lower() if 0 <= at < len(self.tokens) and self.tokens[at][0] == "word" else ""

    def op(self, at: int) -> str:
        return self.tokens[at][1] if 0 <= at < len(self.tokens) and self.tokens[at][0] == "op" else ""

    def name(self, at: int) -> tuple[list[str], int]:
        """A dotted name from ``at`` and the place after it; no parts if there is none."""
        parts: list[str] = []
        while at < len(self.tokens) and self.tokens[at][0] in ("word", "quoted"):
            if not parts and self.tokens[at][0] == "word" and self.word(at) in _CLAUSE:
                break
            parts.append(self.tokens[at][1])
            at += 1
            if self.op(at) != ".":
                break
            at += 1
        return parts, at

    def table(self, at: int) -> int:
        """Reads a table, subquery or function where a table must stand; returns the place after it and its alias."""
        while self.word(at) in ("lateral", "only", "table"):
            at += 1
        if self.op(at) == "(":
            return at + 1  # its content is scanned like the rest
        parts, after = self.name(at)
        if not parts:
            raise SqlError("a table name is missing after " + " ".join(t for _, t in self.tokens[max(0, at - 2) : at]))
        if self.op(after) != "(" and (name := normal_name(parts)):
            self.found.append(name)
        return after

    def read(self) -> SqlFact:
        tokens, at = self.tokens, 0
        stack: list[dict] = [{"from": False, "call": ""}]
        first = self.word(0)
        while self.op(at) == "(":
            stack.append({"from": False, "call": ""})
            at += 1
            first = self.word(at)
        if first not in _READS | _WRITES | _OTHER:
            raise SqlError(f"no statement begins with {tokens[at][1] if at < len(tokens) else 'nothing'}")
        if first in _OTHER:
            return SqlFact((), None)
        expects_target = first in _WRITES
        while at < len(tokens):
            word, op, scope = self.word(at), self.op(at), stack[-1]
            if op == "(":
                stack.append({"from": False, "call": self.word(at - 1)})
            elif op == ")":
                stack.pop()
                if not stack:
                    raise SqlError("a closing bracket without an opening one")
            elif op == "," and scope["from"]:
                at = self.table(at + 1)
                if self.op(at - 1) == "(":
                    stack.append({"from": False, "call": ""})
                continue
            elif word == "with" and self.word(at + 1) not in ("time", "ties", "no", "data") and self.op(at + 1) != "(" and at + 1 < len(tokens):
                self.note_ctes(at)
            elif word == "as" and self.op(at + 1) == "(" and self.word(at + 2) in ("select", "with", "insert", "update", "delete", "values"):
                pass
            elif expects_target and word in ("into", "update", "table", "view", "from", "overwrite") and self.takes_target(first, word, at):
                after = at + 1
                while self.word(after) in ("table", "if", "not", "exists", "only", "into"):
                    after += 1
                parts, end = self.name(after)
                if parts:
                    self.target, expects_target, at = normal_name(parts), False, end
                    scope["from"] = first == "update"  # further tables may follow after commas
                    continue
            elif word == "from" and scope["call"] not in _NOT_FROM and self.word(at - 1) != "distinct":
                scope["from"] = True
                at = self.table(at + 1)
                if self.op(at - 1) == "(":
                    stack.append({"from": False, "call": ""})
                continue
            elif word == "join" or (word == "apply" and self.word(at - 1) in ("cross", "outer")) or (word == "using" and first in ("merge", "delete") and len(stack) == 1):
                at = self.table(at + 1)
                scope["from"] = True
                if self.op(at - 1) == "(":
                    stack.append({"from": False, "call": ""})
                continue
            elif word in ("where", "group", "order", "having", "limit", "union", "intersect", "except", "select", "on", "set", "when", "window", "qualify"):
                scope["from"] = scope["from"] and word == "on"
            at += 1
        sources: list[str] = []
        for name in self.found:
            if name not in self.ctes and name != self.target and name not in sources:
                sources.append(name)
        last = tokens[-1]
        if last[0] == "op" and last[1] in (",", ".", "=", "<", ">", "+", "-", "/", "<=", ">=", "<>", "!=", "||") or last[0] == "word" and last[1].lower() in (
            "from", "join", "where", "by", "on", "and", "or", "select", "into", "set", "union", "having", "between", "like", "then", "when", "else", "case"
        ):
            raise SqlError(f"the statement ends with {last[1]}")
        return SqlFact(tuple(sources), self.target)

    def takes_target(self, first: str, word: str, at: int) -> bool:
        return {"insert": word in ("into", "overwrite", "table"), "replace": word == "into", "upsert": word == "into", "merge": word == "into", "update": word == "update" and at < 2 or word == "update",
                "delete": word == "from", "create": word in ("table", "view")}[first]

    def note_ctes(self, at: int) -> None:
        at += 2 if self.word(at + 1) == "recursive" else 1
        while True:
            parts, at = self.name(at)
            if len(parts) != 1:
                return
            if self.op(at) == "(":
                at = self.close(at)
            if self.word(at) != "as":
                return
            at += 1
            while self.word(at) in ("not", "materialized"):
                at += 1
            if self.op(at) != "(":
                return
            self.ctes.add(normal_name(parts) or "")
            at = self.close(at)
            if self.op(at) != ",":
                return
            at += 1

    def close(self, at: int) -> int:
        depth = 0
        while at < len(self.tokens):
            depth += {"(": 1, ")": -1}.get(self.op(at), 0)
            at += 1
            if not depth:
                return at
        return at


def _accepted(text: str) -> bool:
    """Whether one dialect accepts all statements that the grammar knows."""
    for kinds in grammar.readings(text):
        known = [s for s in grammar.statements(kinds) if next((k for k in s if k != "("), "").lower() in _READS | _WRITES]
        if grammar.grammar().accepts_all(known):
            return True
    return False


@lru_cache(maxsize=512)
def sql_facts(sql: str) -> tuple[tuple[SqlFact, ...], str | None]:
    """The facts of all statements, and an error if the text cannot be read; then there are no facts."""
    try:
        facts = tuple(_Reader(s).read() for s in _statements(_tokens(sql)))
        if not _accepted(sql):
            raise SqlError("no dialect accepts it")
        return facts, None
    except SqlError as e:
        return (), str(e)


def looks_like_sql(text: str) -> bool:
    m = re.match(r"[\s(]*([^\s(;]+)", text)
    return bool(m) and m.group(1).lower() in {"select", "insert", "update", "delete", "create", "merge", "with", "replace", "upsert", "truncate"}
