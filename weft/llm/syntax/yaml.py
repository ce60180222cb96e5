"""YAML streams: a scanner that turns layout into tokens, and the grammar over them."""

from __future__ import annotations

import re
from functools import lru_cache

from weft.grammar.gll import Grammar

GRAMMAR = """
stream: DOC_END* [ node ] ( document | DOC_END )* EOF ;
document: DIRECTIVE* DOC_START [ node ] ;
node: ALIAS | _properties [ _content ] | _content ;
_properties: ANCHOR [ TAG ] | TAG [ ANCHOR ] ;
_content: SCALAR | flow_seq | flow_map | block_seq | block_map ;
block_seq: SEQ ( ENTRY [ node ] )* END ;
block_map: MAP ( KEY [ value ] [ VALUE [ value ] ] | VALUE [ value ] )* END ;
value: node | [ _properties ] flat_seq ;
flat_seq: ( ENTRY [ node ] )+ ;
flow_seq: '[' [ _flow_entry ( ',' _flow_entry )* [ ',' ] ] ']' ;
flow_map: '{' [ _flow_entry ( ',' _flow_entry )* [ ',' ] ] '}' ;
_flow_entry: flow | KEY [ flow ] [ VALUE [ flow ] ] | VALUE [ flow ] ;
flow: ALIAS | _properties [ _flow_content ] | _flow_content ;
_flow_content: SCALAR | flow_seq | flow_map ;
"""
_KINDS = ("DOC_START", "DOC_END", "DIRECTIVE", "SEQ", "MAP", "END", "ENTRY", "KEY", "VALUE", "[", "]", "{", "}", ",", "ALIAS", "ANCHOR", "TAG", "SCALAR")

_BLANK, _BREAK = " \t", "\n"
_SPACE = " \t\n"
_UNPRINTABLE = re.compile("[^\t\n\r\x20-\x7e\x85\xa0-\ud7ff\ue000-\ufffd\U00010000-\U0010ffff]")
_ESCAPE = re.compile(r"\\(?:[0abt\tnvfre \"/\\N_LP\n]|x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8})")
_NAME_END = re.compile(r"[\s,\[\]{}]|\Z")
#: A key that is not marked by ``?`` must stay on one line within this many characters.
KEY_CHARS = 1024


class _Bad(Exception):
    """The text is no YAML here."""


class _Scanner:
    def __init__(self, text: str):
        self.text, self.out = text, []
        self.at = self.line_start = self.line = 0
        self.indents: list[int] = []
        self.flow: list[str] = []
        self.key_allowed = True
        #: By flow level, where a key could have begun: place in ``out``, must it be one, line, offset and column.
        self.keys: dict[int, tuple[int, bool, int, int, int]] = {}

    @property
    def column(self) -> int:
        return self.at - self.line_start

    @property
    def indent(self) -> int:
        return self.indents[-1] if self.indents else -1

    def peek(self, ahead: int = 0) -> str:
        return self.text[self.at + ahead : self.at + ahead + 1]

    def newline(self) -> None:
        self.at += 1
        self.line += 1
        self.line_start = self.at

    def blank_after(self, ahead: int = 1) -> bool:
        return self.peek(ahead) == "" or self.peek(ahead) in _SPACE

    def unwind(self, column: int) -> None:
        if not self.flow:
            while self.indent > column:
                self.indents.pop()
                self.out.append("END")

    def nest(self, column: int, kind: str, place: int | None = None) -> None:
        if self.indent < column:
            self.indents.append(column)
            self.out.insert(len(self.out) if place is None else place, kind)

    def drop_key(self) -> None:
        key = self.keys.pop(len(self.flow), None)
        if key and key[1]:
            raise _Bad

    def note_key(self) -> None:
        if self.key_allowed:
            self.drop_key()
            self.keys[len(self.flow)] = (len(self.out), not self.flow and self.indent == self.column, self.line, self.at, self.column)

    def expire_keys(self) -> None:
        for level, key in list(self.keys.items()):
            if key[2] != self.line or self.at - key[3] > KEY_CHARS:
                if key[1]:
                    raise _Bad
                del self.keys[level]

    def skip(self) -> None:
        while True:
            while self.peek() and (self.peek() == " " or (self.peek() == "\t" and (self.flow or not self.key_allowed))):
                self.at += 1
            if self.peek() == "\t":  # a tab is white space only before a comment or the end of the line
                end = self.at
                while self.text[end : end + 1] and self.text[end] in _BLANK:
                    end += 1
                if self.text[end : end + 1] not in ("", "\n", "#"):
                    raise _Bad
                self.at = end
            if self.peek() == "#" and (self.column == 0 or self.text[self.at - 1] in _SPACE or self.at == 0):
                while self.peek() and self.peek() != "\n":
                    self.at += 1
            if self.peek() != "\n":
                return
            self.newline()
            if not self.flow:
                self.key_allowed = True

    def marker(self) -> str:
        """A document marker at the start of this line."""
        if self.column == 0 and self.text[self.at : self.at + 3] in ("---", "...") and self.blank_after(3):
            return self.text[self.at : self.at + 3]
        return ""

    def scan(self) -> list[str]:
        while True:
            self.skip()
            self.expire_keys()
            self.unwind(self.column)
            c = self.peek()
            if not c:
                break
            self.token(c)
        self.unwind(-1)
        for key in self.keys.values():
            if key[1]:
                raise _Bad
        if self.flow:
            raise _Bad
        return self.out

    def token(self, c: str) -> None:
        if self.column == 0 and (marker := self.marker()):
            self.unwind(-1)
            self.drop_key()
            self.key_allowed = False
            if self.flow:
                raise _Bad
            self.at += 3
            self.out.append("DOC_START" if marker == "---" else "DOC_END")
        elif c == "%" and self.column == 0:
            self.unwind(-1)
            self.drop_key()
            self.key_allowed = False
            end = self.text.find("\n", self.at)
            line = self.text[self.at : end if end >= 0 else len(self.text)]
            if not re.match(r"%YAML[ ]+\d+\.\d+\s*(#.*)?$|%TAG[ ]+!\w*!?[ ]+\S+\s*$|%(?!YAML|TAG)\w+.*$", line):
                raise _Bad
            self.at += len(line)
            self.out.append("DIRECTIVE")
        elif c in "[{":
            self.note_key()
            self.flow.append(c)
            self.key_allowed = True
            self.out.append(c)
            self.at += 1
        elif c in "]}":
            self.drop_key()
            if not self.flow:
                raise _Bad
            self.flow.pop()
            self.key_allowed = False
            self.out.append(c)
            self.at += 1
        elif c == "," and self.flow:
            self.drop_key()
            self.key_allowed = True
            self.out.append(",")
            self.at += 1
        elif c == "-" and self.blank_after():
            if self.flow:
                raise _Bad
            if not self.key_allowed:
                raise _Bad
            self.nest(self.column, "SEQ")
            self.drop_key()
            self.key_allowed = True
            self.out.append("ENTRY")
            self.at += 1
        elif c == "?" and (self.blank_after() if not self.flow else self.blank_after() or self.peek(1) in ",[]{}"):
            if not self.flow:
                if not self.key_allowed:
                    raise _Bad
                self.nest(self.column, "MAP")
            self.drop_key()
            self.key_allowed = not self.flow
            self.out.append("KEY")
            self.at += 1
        elif c == ":" and (self.blank_after() or (self.flow and (self.peek(1) in ",[]{}" or self.after_json_key()))):
            self.value()
        elif c in "*&":
            self.note_key()
            self.key_allowed = False
            self.at += 1
            start = self.at
            self.at = _NAME_END.search(self.text, self.at).start()
            if self.at == start:
                raise _Bad
            self.out.append("ALIAS" if c == "*" else "ANCHOR")
        elif c == "!":
            self.note_key()
            self.key_allowed = False
            m = re.compile(r"!<[^<>\s]+>|![^\s,\[\]{}]*").match(self.text, self.at)
            self.at = m.end()
            if not self.blank_after(0) and self.peek() not in ",]}":
                raise _Bad
            self.out.append("TAG")
        elif c in "|>" and not self.flow:
            self.drop_key()
            self.key_allowed = True
            self.block_scalar()
        elif c in "'\"":
            self.note_key()
            self.key_allowed = False
            self.quoted(c)
        elif c in "%@`|>" or (c in "#,[]{}&*!"):
            raise _Bad
        else:
            self.note_key()
            self.key_allowed = False
            self.plain()

    def after_json_key(self) -> bool:
        """A quoted or bracketed key ended just here, so that its colon needs no space."""
        return bool(self.out) and self.text[self.at - 1] in "\"']}" and self.keys.get(len(self.flow)) is not None

    def value(self) -> None:
        key = self.keys.pop(len(self.flow), None)
        if key:
            self.out.insert(key[0], "KEY")
            if not self.flow:
                self.nest(key[4], "MAP", key[0])
            self.key_allowed = False
        else:
            if not self.flow:
                if not self.key_allowed:
                    raise _Bad
                self.nest(self.column, "MAP")
            self.drop_key()
            self.key_allowed = not self.flow
        self.out.append("VALUE")
        self.at += 1

    def block_scalar(self) -> None:
        m = re.compile(r"[|>](?:[+-][1-9]?|[1-9][+-]?)?[ \t]*(?:(?<=[ \t])#[^\n]*)?(?=\n|\Z)").match(self.text, self.at)
        if not m:
            raise _Bad
        digit = re.search(r"[1-9]", m.group().split("#")[0])
        self.at = m.end()
        least = max(1, self.indent + 1)
        want = max(self.indent, 0) + int(digit.group()) if digit else None
        while self.peek() == "\n":
            self.newline()
            start = self.at
            while self.peek() == " " and (want is None or self.column < want):
                self.at += 1
            if self.peek() == "\n" or not self.peek():
                continue
            if want is None:
                want = max(least, self.column)
                if self.peek() == "\t" and self.column < least:
                    raise _Bad
            if self.column < want or (self.column == 0 and self.marker()):
                self.at = start
                break
            end = self.text.find("\n", self.at)
            self.at = end if end >= 0 else len(self.text)
        self.out.append("SCALAR")

    def quoted(self, quote: str) -> None:
        self.at += 1
        while True:
            c = self.peek()
            if not c:
                raise _Bad
            if c == "\n":
                self.newline()
                if self.marker():
                    raise _Bad
            elif c == quote:
                if quote == "'" and self.peek(1) == "'":
                    self.at += 2
                    continue
                self.at += 1
                break
            elif c == "\\" and quote == '"':
                m = _ESCAPE.match(self.text, self.at)
                if not m:
                    raise _Bad
                if m.group() == "\\\n":
                    self.at += 1
                else:
                    self.at = m.end()
            else:
                self.at += 1
        self.out.append("SCALAR")

    def plain(self) -> None:
        text, stop = self.text, ",[]{}" if self.flow else ""
        least = self.indent + 1
        while True:
            if self.peek() == "#":
                break
            start = self.at
            while (c := self.peek()) and c not in _SPACE and c not in stop:
                if c == ":" and (self.blank_after() or (stop and self.peek(1) in stop)):
                    break
                self.at += 1
            if self.at == start:
                break
            self.key_allowed = False
            end, line, line_start, broke = self.at, self.line, self.line_start, False
            while self.peek() and self.peek() in _BLANK:
                self.at += 1
            while self.peek() == "\n":
                broke = True
                self.newline()
                if self.marker():
                    break
                while self.peek() and (self.peek() == " " or (self.peek() == "\t" and (self.flow or self.column >= least))):
                    self.at += 1
            if broke and not self.flow:
                self.key_allowed = True
            more = self.peek() and self.peek() != "#" and not (broke and self.column == 0 and self.marker())
            if not more or (not self.flow and broke and self.column < least):
                if not broke:
                    break
                self.at, self.line, self.line_start = end, line, line_start
                break
        self.out.append("SCALAR")


def tokens(text: str) -> list[str] | None:
    """Tokens of the stream; None where the layout or a scalar is broken."""
    text = re.sub("\r\n?|\x85|\u2028|\u2029", "\n", text.removeprefix("\ufeff"))
    if _UNPRINTABLE.search(text):
        return None
    try:
        return _Scanner(text).scan()
    except _Bad:
        return None


@lru_cache(maxsize=1)
def grammar() -> Grammar:
    return Grammar(GRAMMAR, "stream", {k: {k} for k in _KINDS})


def accepts(text: str) -> bool:
    """Whether the text is a YAML stream; an empty one is."""
    kinds = tokens(text)
    return kinds is not None and bool(grammar().accepts_all([kinds]))
