"""Python 3.13: token kinds with indentation, and the grammar."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

from weft.grammar.gll import Grammar

KEYWORDS = (
    "False", "None", "True", "and", "as", "assert", "async", "await", "break", "class", "continue", "def", "del", "elif", "else", "except", "finally",
    "for", "from", "global", "if", "import", "in", "is", "lambda", "nonlocal", "not", "or", "pass", "raise", "return", "try", "while", "with", "yield",
)
SOFT_KEYWORDS = ("match", "case", "type", "_")
_OPERATORS = ("**=", "//=", ">>=", "<<=", "...", "!=", "->", ":=", "+=", "-=", "*=", "/=", "%=", "&=", "|=", "^=", "@=", "**", "//", ">>", "<<", "<=", ">=", "==",
              "+", "-", "*", "/", "%", "&", "|", "^", "~", "@", "<", ">", "(", ")", "[", "]", "{", "}", ",", ":", ".", ";", "=", "!")


def _parameters(name: str, default: str, only: str) -> str:
    """Parameter lists: without defaults before with defaults, one ``/``, then ``*`` and ``**``."""
    star = f"( '*' {only} ( ',' ( {name} | {default} ) )* [ ',' '**' {name} ] | '*' ( ',' ( {name} | {default} ) )+ [ ',' '**' {name} ] | '**' {name} )"
    n, d = f"{name} ( ',' {name} )*", f"{default} ( ',' {default} )*"
    tail = f"[ ',' {star} ] [ ',' ]"
    return (
        f"{n} ',' '/' ( ',' {name} )* ( ',' {default} )* {tail} | ( {name} ',' )* {d} ',' '/' ( ',' {default} )* {tail}"
        f" | {n} ( ',' {default} )* {tail} | {d} {tail} | {star} [ ',' ]"
    )


GRAMMAR = f"""
file: ( NEWLINE | statement )* EOF ;
statement: _simple ( ';' _simple )* [ ';' ] NEWLINE | compound ;
block: NEWLINE INDENT statement+ DEDENT | _simple ( ';' _simple )* [ ';' ] NEWLINE ;
_simple: assign | star_exprs | yield | 'return' [ star_exprs ] | 'pass' | 'break' | 'continue' | 'raise' [ expr [ 'from' expr ] ] | 'global' _names | 'nonlocal' _names
  | 'del' del_target ( ',' del_target )* [ ',' ] | 'assert' expr [ ',' expr ] | 'import' _module [ 'as' NAME ] ( ',' _module [ 'as' NAME ] )* | 'type' NAME [ type_params ] '=' expr
  | 'from' ( ( '.' | '...' )* _module | ( '.' | '...' )+ ) 'import' ( '*' | '(' _imported ( ',' _imported )* [ ',' ] ')' | _imported ( ',' _imported )* ) ;
_names: NAME ( ',' NAME )* ;
_module: NAME ( '.' NAME )* ;
_imported: NAME [ 'as' NAME ] ;
assign: ( targets '=' )+ ( star_exprs | yield ) | single ( _augmented ( star_exprs | yield ) | ':' expr [ '=' ( star_exprs | yield ) ] ) ;
_augmented: '+=' | '-=' | '*=' | '/=' | '//=' | '%=' | '@=' | '&=' | '|=' | '^=' | '>>=' | '<<=' | '**=' ;
single: NAME ( call* part )* | place ( call* part )+ | '(' single ')' ;
targets: star_target ( ',' star_target )* [ ',' ] ;
star_target: [ '*' ] target ;
target: NAME ( call* part )* | place ( call* part )+ | '(' [ targets ] ')' | '[' [ targets ] ']' ;
del_target: NAME ( call* part )* | place ( call* part )+ | '(' [ del_target ( ',' del_target )* [ ',' ] ] ')' | '[' [ del_target ( ',' del_target )* [ ',' ] ] ']' ;
part: '.' NAME | '[' slices ']' ;
call: '(' [ arguments ] ')' ;
place: 'True' | 'False' | 'None' | NUMBER | strings | '...' | group | list | braces ;
star_exprs: _star ( ',' _star )* [ ',' ] ;
_star: '*' arith | expr ;
yield: 'yield' [ star_exprs | 'from' expr ] ;
expr: _or [ 'if' disjunction 'else' expr ] | 'lambda' [ lambda_params ] ':' expr ;
disjunction: _or ;
_or: _inversion ( ( 'or' | 'and' ) _inversion )* ;
_inversion: 'not'* _arith ( ( '==' | '!=' | '<' | '>' | '<=' | '>=' | 'in' | 'not' 'in' | 'is' | 'is' 'not' ) _arith )* ;
arith: _arith ;
_arith: _operand ( ( '+' | '-' | '*' | '/' | '//' | '%' | '@' | '**' | '&' | '|' | '^' | '<<' | '>>' ) _operand )* ;
_operand: ( '+' | '-' | '~' )* [ 'await' ] ( NAME | place ) ( part | call )* ;
strings: ( STRING | FSTART field* FEND )+ | BYTES+ ;
field: FOPEN ( star_exprs | yield ) [ '=' ] [ '!' NAME ] [ ':' FSPEC field* ] FCLOSE ;
_named: NAME ':=' expr | expr ;
_starred: '*' arith | _named ;
group: '(' [ yield | _named [ comp+ ] | _starred ',' [ _starred ( ',' _starred )* [ ',' ] ] ] ')' ;
list: '[' [ _named comp+ | _starred ( ',' _starred )* [ ',' ] ] ']' ;
braces: '{{' [ expr ':' expr comp+ | _pair ( ',' _pair )* [ ',' ] | _named comp+ | _starred ( ',' _starred )* [ ',' ] ] '}}' ;
_pair: expr ':' expr | '**' arith ;
comp: [ 'async' ] 'for' targets 'in' disjunction ( 'if' disjunction )* ;
arguments: _named comp+ | ( _positional ( ',' _positional )* ( ',' _keyword )* ( ',' _double )* | _keyword ( ',' _keyword )* ( ',' _double )* | _double ( ',' _double )* ) [ ',' ] ;
_positional: '*' expr | _named ;
_keyword: NAME '=' expr | '*' expr ;
_double: NAME '=' expr | '**' expr ;
slices: slice ( ',' slice )* [ ',' ] ;
slice: [ expr ] ':' [ expr ] [ ':' [ expr ] ] | _named | '*' arith ;
lambda_params: {_parameters("NAME", "NAME '=' expr", "NAME")} ;
params: {_parameters("_param", "_param '=' expr", "NAME [ ':' ( expr | '*' arith ) ]")} ;
_param: NAME [ ':' expr ] ;
type_params: '[' type_param ( ',' type_param )* [ ',' ] ']' ;
type_param: NAME [ ':' expr ] [ '=' expr ] | '*' NAME [ '=' ( expr | '*' arith ) ] | '**' NAME [ '=' expr ] ;
compound: ( '@' _named NEWLINE )* ( [ 'async' ] 'def' NAME [ type_params ] '(' [ params ] ')' [ '->' expr ] ':' block | 'class' NAME [ type_params ] [ '(' [ arguments ] ')' ] ':' block )
  | 'if' _named ':' block ( 'elif' _named ':' block )* [ _else ] | 'while' _named ':' block [ _else ] | [ 'async' ] 'for' targets 'in' star_exprs ':' block [ _else ]
  | 'try' ':' block ( ( 'except' [ expr [ 'as' NAME ] ] ':' block )+ [ _else ] [ 'finally' ':' block ] | ( 'except' '*' expr [ 'as' NAME ] ':' block )+ [ _else ] [ 'finally' ':' block ] | 'finally' ':' block )
  | [ 'async' ] 'with' ( '(' item ( ',' item )* [ ',' ] ')' | item ( ',' item )* ) ':' block
  | 'match' ( _named | _starred ',' [ _starred ( ',' _starred )* [ ',' ] ] ) ':' NEWLINE INDENT case+ DEDENT ;
_else: 'else' ':' block ;
item: expr [ 'as' target ] ;
case: 'case' ( as_pattern | _star_pattern ',' [ _star_pattern ( ',' _star_pattern )* [ ',' ] ] ) [ 'if' _named ] ':' block ;
_star_pattern: '*' NAME | as_pattern ;
as_pattern: closed ( '|' closed )* [ 'as' NAME ] ;
closed: 'None' | 'True' | 'False' | strings | number | NAME ( '.' NAME )* [ '(' [ _pattern_argument ( ',' _pattern_argument )* [ ',' ] ] ')' ] | '(' [ as_pattern | _star_pattern ',' [ _star_pattern ( ',' _star_pattern )* [ ',' ] ] ] ')'
  | '[' [ _star_pattern ( ',' _star_pattern )* [ ',' ] ] ']' | '{{' [ _entry ( ',' _entry )* [ ',' ] ] '}}' ;
_pattern_argument: as_pattern | NAME '=' as_pattern ;
_entry: ( 'None' | 'True' | 'False' | strings | number | NAME ( '.' NAME )+ ) ':' as_pattern | '**' NAME ;
number: [ '-' ] NUMBER [ ( '+' | '-' ) NUMBER ] ;
"""

_NAME = re.compile(r"[^\W\d]\w*")
_NUMBER = re.compile(
    r"0[xX](?:_?[0-9a-fA-F])+|0[bB](?:_?[01])+|0[oO](?:_?[0-7])+|(?:\d(?:_?\d)*\.(?:\d(?:_?\d)*)?|\.\d(?:_?\d)*)(?:[eE][+-]?\d(?:_?\d)*)?[jJ]?"
    r"|\d(?:_?\d)*[eE][+-]?\d(?:_?\d)*[jJ]?|\d(?:_?\d)*[jJ]|(?:0(?:_?0)*|[1-9](?:_?\d)*)"
)
_AFTER_NUMBER = re.compile(r"(?:and|else|for|if|in|is|not|or)\b")
_PREFIX = re.compile(r"(?i:(?:[rb]?|u|rb|br|f|rf|fr)(?='|\"))")
_OPERATOR = re.compile("|".join(map(re.escape, _OPERATORS)))
_BODY = {q: re.compile(rf"(?:[^\\{q[0]}{'' if len(q) == 3 else chr(10)}]|\\[\s\S]{'|' + q[0] + '(?!' + q[0] * 2 + ')' if len(q) == 3 else ''})*{q}") for q in ("'", '"', "'''", '"""')}
_BAD_ESCAPE = re.compile(r"(?<!\\)(?:\\\\)*\\(?:x(?![0-9a-fA-F]{2})|u(?![0-9a-fA-F]{4})|U(?!00(?:0[0-9a-fA-F]|10)[0-9a-fA-F]{4})|N(?!\{[^{}]+\}))")
_NAMED = re.compile(r"(?<!\\)(?:\\\\)*\\N\{([^{}]+)\}")
_CLOSING = {")": "(", "]": "[", "}": "{"}
#: The next name or operator of a line, where it is no string prefix, number or comment.
_NEXT = re.compile(rf"[ \t\f]*+(?:([^\W\d]\w*+)(?!['\"])|(?!\.\d)({'|'.join(map(re.escape, _OPERATORS))}))")
_CONTINUES = frozenset(["elif", "else", "except", "finally", "INDENT", "DEDENT", "NEWLINE"])


#: Lines whose token kinds are remembered, of at most so many characters each; beyond, all are forgotten.
LINES, LINE_LENGTH = 50_000, 200
_LINES: dict[str, tuple[str, ...]] = {}


class _Bad(Exception):
    """No token begins here."""


class _Lexer:
    def __init__(self, text: str):
        self.text, self.out, self.stack = text, [], []

    def file(self) -> list[str]:
        text, out = self.text, self.out
        if "\0" in text:
            raise _Bad
        indents, at, begin = [(0, 0)], 1 if text.startswith("﻿") else 0, True
        line, end, mark = "", -1, 0  # a logical line, where its first physical line ends, and its first token
        while at < len(text):
            if begin:
                column = other = 0
                while at < len(text) and text[at] in " \t\f":
                    if text[at] == " ":
                        column, other = column + 1, other + 1
                    elif text[at] == "\t":
                        column, other = (column // 8 + 1) * 8, other + 1
                    else:
                        column = other = 0
                    at += 1
                if at == len(text):
                    break
                if text[at] == "#":
                    while at < len(text) and text[at] != "\n":
                        at += 1
                    at += 1
                    continue
                if text[at] == "\n":
                    at += 1
                    continue
                if not (text[at] == "\\" and text[at + 1 : at + 2] == "\n"):
                    if column == indents[-1][0]:
                        if other != indents[-1][1]:
                            raise _Bad
                    elif column > indents[-1][0]:
                        if other <= indents[-1][1]:
                            raise _Bad
                        indents.append((column, other))
                        out.append("INDENT")
                    else:
                        while column < indents[-1][0]:
                            indents.pop()
                            out.append("DEDENT")
                        if (column, other) != indents[-1]:
                            raise _Bad
                begin = False
                end = text.find("\n", at)
                line, mark = text[at : end if end >= 0 else len(text)], len(out)
                known = _LINES.get(line) if end >= 0 else None
                if known is not None:
                    out += known
                    at = end
            m = _NEXT.match(text, at)
            if m is not None:
                word, op = m.groups()
                if op is None and (word.isascii() or word.isidentifier()):
                    out.append(word if word in _WORDS else "NAME")
                elif op is None:
                    raise _Bad
                else:
                    self.operator(op)
                at = m.end()
                continue
            if text[at] == "\n":
                if not self.stack:
                    if at == end and len(line) <= LINE_LENGTH and line not in _LINES:
                        if len(_LINES) >= LINES:
                            _LINES.clear()
                        _LINES[line] = tuple(out[mark:])
                    out.append("NEWLINE")
                    begin = True
                at += 1
                continue
            at = self.token(at)
        if self.stack:
            raise _Bad
        if out and out[-1] != "NEWLINE" and not begin:
            out.append("NEWLINE")
        out += ["DEDENT"] * (len(indents) - 1)
        return out

    def token(self, at: int) -> int:
        """Appends the token at ``at``, if there is one before the line ends; returns where to go on."""
        text, c = self.text, self.text[at]
        if c in " \t\f":
            return at + 1
        if c == "#":
            end = text.find("\n", at)
            return len(text) if end < 0 else end
        if c == "\\":
            if text[at + 1 : at + 2] != "\n" or at + 2 == len(text):
                raise _Bad
            return at + 2
        if c in "'\"" or (c in "rRbBuUfF" and (m := _PREFIX.match(text, at))):
            prefix = "" if c in "'\"" else m.group().lower()
            return self.string(at + len(prefix), prefix)
        if m := _NAME.match(text, at):
            word = m.group()
            if not word.isascii() and not word.isidentifier():
                raise _Bad
            self.out.append(word if word in _WORDS else "NAME")
            return m.end()
        if c.isdigit() or (c == "." and text[at + 1 : at + 2].isdigit()):
            m = _NUMBER.match(text, at)
            if not m or (text[m.end() : m.end() + 1].isidentifier() and not _AFTER_NUMBER.match(text, m.end())) or text[m.end() : m.end() + 1].isdigit():
                raise _Bad
            self.out.append("NUMBER")
            return m.end()
        m = _OPERATOR.match(text, at)
        if not m:
            raise _Bad
        self.operator(m.group())
        return m.end()

    def operator(self, op: str) -> None:
        if op in "([{":
            self.stack.append(op)
        elif op in _CLOSING:
            if not self.stack or self.stack.pop() != _CLOSING[op]:
                raise _Bad
        self.out.append(op)

    def string(self, at: int, prefix: str) -> int:
        quote = self.text[at] * 3 if self.text.startswith(self.text[at] * 3, at) else self.text[at]
        if "f" in prefix:
            return self.fstring(at + len(quote), quote, "r" in prefix)
        m = _BODY[quote].match(self.text, at + len(quote))
        if not m:
            raise _Bad
        body = m.group()[: -len(quote)]
        if "b" in prefix and not body.isascii():
            raise _Bad
        if "r" not in prefix and "\\" in body and _BAD_ESCAPE.search(re.sub(r"\\[uUN]", "", body) if "b" in prefix else body):
            raise _Bad
        if not prefix and "\\N{" in body:
            for name in _NAMED.findall(body):
                try:
                    unicodedata.lookup(name)
                except KeyError:
                    raise _Bad from None
        self.out.append("BYTES" if "b" in prefix else "STRING")
        return m.end()

    def fstring(self, at: int, quote: str, raw: bool) -> int:
        self.out.append("FSTART")
        end = self.literal(at, quote, raw, False)
        self.out.append("FEND")
        return end + len(quote)

    def literal(self, at: int, quote: str, raw: bool, spec: bool) -> int:
        """Runs over text and fields up to the closing quote, or of a format up to its closing brace."""
        text = self.text
        while True:
            if at >= len(text) or (text[at] == "\n" and len(quote) == 1):
                raise _Bad
            c = text[at]
            if text.startswith(quote, at):
                if spec:
                    raise _Bad
                return at
            if c == "\\" and not raw:
                if text.startswith("\\N{", at):
                    at = text.find("}", at) + 1 or len(text)
                else:
                    at += 1 if text[at + 1 : at + 2] in "{}" else 2
            elif c == "\\":
                at += 1 if text[at + 1 : at + 2] in "{}" else 2
            elif c == "{":
                if not spec and text[at + 1 : at + 2] == "{":
                    at += 2
                else:
                    at = self.field(at + 1, quote, raw)
            elif c == "}":
                if spec:
                    return at
                if text[at + 1 : at + 2] != "}":
                    raise _Bad
                at += 2
            else:
                at += 1

    def field(self, at: int, quote: str, raw: bool) -> int:
        text, depth = self.text, len(self.stack)
        self.out.append("FOPEN")
        while True:
            if at >= len(text):
                raise _Bad
            c = text[at]
            if c == "\n":
                at += 1
            elif len(self.stack) == depth and c == "}":
                self.out.append("FCLOSE")
                return at + 1
            elif len(self.stack) == depth and c == "!" and text[at + 1 : at + 2] != "=":
                self.out.append("!")
                at += 1
            elif len(self.stack) == depth and c == ":":
                self.out += [":", "FSPEC"]
                at = self.literal(at + 1, quote, raw, True)
            else:
                at = self.token(at)


_WORDS = frozenset([*KEYWORDS, *SOFT_KEYWORDS])


def tokens(text: str) -> list[str] | None:
    """Token kinds with NEWLINE, INDENT and DEDENT; None where something is no token."""
    lexer = _Lexer(text.replace("\r\n", "\n").replace("\r", "\n"))
    try:
        return lexer.file()
    except _Bad:
        return None


@lru_cache(maxsize=1)
def grammar() -> Grammar:
    kinds = {w: {w} for w in KEYWORDS} | {w: {w, "NAME"} for w in SOFT_KEYWORDS} | {o: {o} for o in _OPERATORS}
    kinds |= {k: {k} for k in ("NAME", "NUMBER", "STRING", "BYTES", "FSTART", "FEND", "FOPEN", "FCLOSE", "FSPEC", "NEWLINE", "INDENT", "DEDENT")}
    return Grammar(GRAMMAR, "file", kinds)


def statements(kinds: list[str]) -> list[list[str]]:
    """The token kinds cut where a line begins a new statement without indentation.

    Such a line continues a statement only if it begins with elif, else, except or finally, or follows a decorator.
    """
    out: list[list[str]] = []
    depth, begins, decorated = 0, True, False
    for kind in kinds:
        if kind == "INDENT":
            depth += 1
        elif begins and depth == 0 and kind not in _CONTINUES:
            if not decorated:
                out.append([])
            decorated = kind == "@"
        elif kind == "DEDENT":
            depth -= 1
        if not out:
            out.append([])
        out[-1].append(kind)
        begins = kind in ("NEWLINE", "DEDENT")
    return out


def accepts(text: str) -> bool:
    """Whether the text is a Python 3.13 file; an empty one is."""
    kinds = tokens(text)
    return kinds is not None and bool(grammar().accepts_all(statements(kinds)))
