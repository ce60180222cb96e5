"""Generalised LL recognition with graph-structured stacks, for several dialects of a grammar at once.

A grammar is a text of rules ``name: body ;`` whose bodies are regular expressions over quoted terminals, upper-case
token classes and lower-case rule names, with ``|``, ``[...]``, ``*``, ``+`` and parentheses. Rules whose name starts
with ``_`` are put in place where they are used. ``{a,b}`` before a symbol restricts it to these dialects.

Every rule becomes a deterministic automaton. A descriptor is a state, a node of the graph-structured stack, a position
and the set of dialects that are still possible; a stack node stands for one rule begun at one position and is shared by
all callers and dialects. One token of lookahead prunes alternatives, so that unambiguous stretches run without creating
descriptors. The result is the set of dialects that accept the whole input.

Where a language is a sequence of statements, its inputs are given statement by statement, and the verdict on a sequence
of token kinds is remembered by its digest: many statements differ in names and values only.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from hashlib import blake2b

_LEX = re.compile(r"\s+|#[^\n]*|'[^']+'|\{[\w,]+\}|\w+|[:;|\[\]()*+]")
EOF = "EOF"
#: Verdicts that a grammar remembers, about 200 bytes each; beyond, it forgets all and begins again.
MEMORY = 100_000


class _Node:
    __slots__ = ("edges", "popped")

    def __init__(self) -> None:
        self.edges: list[tuple] = []
        self.popped: list[tuple[int, int]] = []


class Grammar:
    """A compiled grammar. ``kinds`` maps every token kind that a lexer emits to the terminals it can stand for."""

    def __init__(self, text: str, start: str, kinds: dict[str, Iterable[str]], dialects: Iterable[str] = ("all",)):
        self.bits = {d: 1 << i for i, d in enumerate(dialects)}
        self.full = (1 << len(self.bits)) - 1
        self.rules = self._read(text)
        self.kind_ids = {k: i for i, k in enumerate([*kinds, EOF])}
        self.memory: dict[bytes, int] = {}
        self.terminals = [frozenset(kinds[k]) if k != EOF else frozenset([EOF]) for k in self.kind_ids]
        self._compile(start)

    # reading: bodies become nested tuples
    def _read(self, text: str) -> dict[str, tuple]:
        tokens = [t for t in _LEX.findall(text) if t.strip() and not t.startswith("#")]
        at, rules = 0, {}

        def alternatives() -> tuple:
            nonlocal at
            options = [sequence()]
            while tokens[at] == "|":
                at += 1
                options.append(sequence())
            return options[0] if len(options) == 1 else ("or", options)

        def sequence() -> tuple:
            nonlocal at
            items, mask = [], self.full
            while tokens[at] not in ("|", ")", "]", ";"):
                t = tokens[at]
                at += 1
                if t[0] == "{":
                    mask = sum(self.bits[d] for d in t[1:-1].split(","))
                    continue
                if t in "([":
                    inner = alternatives()
                    at += 1
                    item = inner if t == "(" else ("opt", inner)
                elif t[0] == "'":
                    item = ("sym", t[1:-1], True, mask)
                else:
                    item = ("sym", t, t.upper() == t and t[0] != "_", mask)
                mask = self.full
                while tokens[at] in ("*", "+"):
                    item = ("star", item) if tokens[at] == "*" else ("seq", [item, ("star", item)])
                    at += 1
                items.append(item)
            return ("seq", items)

        while at < len(tokens):
            name = tokens[at]
            at += 2
            rules[name] = alternatives()
            at += 1
        return rules

    def _automaton(self, name: str) -> tuple[list[dict], set[int]]:
        """States as dicts from (symbol, is terminal, mask) to state, and the accepting ones; state 0 begins."""
        moves: list[list[tuple]] = []

        def new() -> int:
            moves.append([])
            return len(moves) - 1

        def build(tree: tuple, a: int, b: int) -> None:
            if tree[0] == "sym":
                if tree[1][0] == "_" and not tree[2]:
                    build(self.rules[tree[1]], a, b)
                else:
                    moves[a].append((tree[1:], b))
            elif tree[0] == "seq":
                for item in tree[1][:-1]:
                    c = new()
                    build(item, a, c)
                    a = c
                build(tree[1][-1], a, b) if tree[1] else moves[a].append((None, b))
            elif tree[0] == "or":
                for option in tree[1]:
                    c = new()
                    moves[a].append((None, c))
                    build(option, c, b)
            elif tree[0] == "opt":
                moves[a].append((None, b))
                c = new()
                moves[a].append((None, c))
                build(tree[1], c, b)
            else:
                c = new()
                moves[a].append((None, c))
                moves[c].append((None, b))
                d = new()
                build(tree[1], c, d)
                moves[d].append((None, c))

        first, last = new(), new()
        build(self.rules[name], first, last)

        def closure(states: Iterable[int]) -> frozenset[int]:
            seen, todo = set(states), list(states)
            while todo:
                for label, b in moves[todo.pop()]:
                    if label is None and b not in seen:
                        seen.add(b)
                        todo.append(b)
            return frozenset(seen)

        begin = closure([first])
        number, order, out = {begin: 0}, [begin], []
        for own in order:
            targets: dict[tuple, set[int]] = {}
            for s in own:
                for label, b in moves[s]:
                    if label is not None:
                        targets.setdefault(label, set()).add(b)
            step = {}
            for label, to in targets.items():
                to = closure(to)
                if to not in number:
                    number[to] = len(order)
                    order.append(to)
                step[label] = number[to]
            out.append(step)
        return out, {i for i, own in enumerate(order) if last in own}

    def _compile(self, start: str) -> None:
        names = [n for n in self.rules if n[0] != "_"]
        auto = {n: self._automaton(n) for n in names}
        base, total = {}, 0
        for n in names:
            base[n] = total
            total += len(auto[n][0])
        steps: list[dict] = [{}] * total
        accepting, owner = [False] * total, [""] * total
        for n in names:
            for i, step in enumerate(auto[n][0]):
                steps[base[n] + i] = {label: base[n] + to for label, to in step.items()}
                accepting[base[n] + i] = i in auto[n][1]
                owner[base[n] + i] = n
        if any(accepting[base[n]] for n in names if n != start):
            raise ValueError("only the start rule may match nothing: " + ", ".join(n for n in names if accepting[base[n]]))
        first: dict[str, set[str]] = {n: set() for n in names}
        changed = True
        while changed:
            changed = False
            for n in names:
                for symbol, terminal, _ in steps[base[n]]:
                    more = {symbol} if terminal else first[symbol]
                    if not more <= first[n]:
                        first[n] |= more
                        changed = True
        begins = [set().union(*({s} if t else first[s] for s, t, _ in step)) for step in steps]
        follow: dict[str, set[str]] = {n: set() for n in names}
        changed = True
        while changed:
            changed = False
            for s, step in enumerate(steps):
                for (symbol, terminal, _), to in step.items():
                    if not terminal:
                        more = begins[to] | (follow[owner[s]] if accepting[to] else set())
                        if not more <= follow[symbol]:
                            follow[symbol] |= more
                            changed = True
        self.begin, self.accepting, self.start = base, accepting, start
        self.actions: list[list[tuple]] = []
        for s in range(total):
            row = []
            for terminals in self.terminals:
                acts = []
                for (symbol, terminal, mask), to in steps[s].items():
                    if terminal and symbol in terminals:
                        acts.append((0, to, mask, 0))
                    elif not terminal and first[symbol] & terminals:
                        acts.append((1, to, mask, base[symbol]))
                if accepting[s] and owner[s] != start and follow[owner[s]] & terminals:
                    acts.append((2, 0, 0, 0))
                row.append(tuple(acts))
            self.actions.append(row)

    def accepts_all(self, statements: Iterable[list[str]]) -> int:
        """The dialects, as bits, that accept every one of the inputs; all of them for no input."""
        accepted = self.full
        for kinds in statements:
            key = blake2b("\0".join(kinds).encode(), digest_size=16).digest()
            known = self.memory.get(key)
            if known is None:
                if len(self.memory) >= MEMORY:
                    self.memory.clear()
                known = self.memory[key] = self.accepts(kinds)
            accepted &= known
            if not accepted:
                break
        return accepted

    def accepts(self, tokens: list[str]) -> int:
        """The dialects, as bits, that accept the token kinds; an unknown kind is accepted by none."""
        ids = self.kind_ids
        try:
            kinds = [ids[t] for t in tokens]
        except KeyError:
            return 0
        kinds.append(ids[EOF])
        actions, full, end = self.actions, self.full, len(kinds)
        root = _Node()
        nodes: dict[tuple[int, int], _Node] = {}
        seen: set[tuple] = set()
        todo: list[tuple] = [(self.begin[self.start], root, 0, full, None)]
        accepted = 0
        while todo:
            state, node, pos, mask, act = todo.pop()
            while True:
                if act is None:
                    if pos == end:
                        if node is root and self.accepting[state]:
                            accepted |= mask
                            if accepted == full:
                                return full
                        break
                    acts = actions[state][kinds[pos]]
                    if not acts:
                        break
                    act = acts[0]
                    for other in acts[1:]:
                        todo.append((state, node, pos, mask, other))
                code, to, allowed, callee = act
                act = None
                if code == 0:
                    mask &= allowed
                    if not mask:
                        break
                    state = to
                    pos += 1
                elif code == 1:
                    mask &= allowed
                    if not mask:
                        break
                    key = (callee, pos)
                    below = nodes.get(key)
                    if below is None:
                        below = nodes[key] = _Node()
                        below.edges.append((to, node, mask))
                        state, node, mask = callee, below, full
                    else:
                        edge = (to, node, mask)
                        if edge not in below.edges:
                            below.edges.append(edge)
                            for at, got in below.popped:
                                if got & mask:
                                    item = (to, id(node), at, got & mask)
                                    if item not in seen:
                                        seen.add(item)
                                        todo.append((to, node, at, got & mask, None))
                        break
                else:
                    result = (pos, mask)
                    if result in node.popped:
                        break
                    node.popped.append(result)
                    following = None
                    for to, parent, called in node.edges:
                        both = called & mask
                        if both:
                            item = (to, id(parent), pos, both)
                            if item not in seen:
                                seen.add(item)
                                if following is None:
                                    following = (to, parent, both)
                                else:
                                    todo.append((to, parent, pos, both, None))
                    if following is None:
                        break
                    state, node, mask = following
        return accepted
