"""Common SQL in several dialects; a Jinja expression stands for a table name."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

from weft.grammar.gll import Grammar

DIALECTS = ("ansi", "postgres", "mysql", "tsql", "spark")

#: Words that no dialect takes as a name without quotes.
RESERVED = frozenset((
    "ALL", "AND", "AS", "BETWEEN", "BY", "CASE", "CREATE", "CROSS", "DELETE", "DISTINCT", "DROP", "ELSE", "END", "EXCEPT", "EXISTS", "FALSE", "FROM",
    "FULL", "GROUP", "HAVING", "IN", "INNER", "INSERT", "INTERSECT", "INTO", "IS", "JOIN", "LEFT", "LIKE", "LIMIT", "NATURAL", "NOT", "NULL", "ON",
    "OR", "ORDER", "OUTER", "RIGHT", "SELECT", "SET", "TABLE", "THEN", "TRUE", "UNION", "UPDATE", "USING", "VALUES", "WHEN", "WHERE", "WITH", "ALTER",
    "CAST",
))
#: Words with a place in the grammar that are names elsewhere.
SOFT = frozenset((
    "ACTION", "ADD", "ALWAYS", "ANALYZE", "ANY", "APPLY", "ARRAY", "ASC", "AT", "AUTO_INCREMENT", "BEGIN", "CACHE", "CASCADE", "CHECK", "CLUSTER",
    "COLLATE", "COLUMN", "COMMENT", "COMMIT", "CONCURRENTLY", "CONFLICT", "CONSTRAINT", "CONVERT", "COPY", "CURRENT", "DATA", "DATABASE", "DATE",
    "DEFAULT", "DEFERRABLE", "DESC", "DESCRIBE", "DISTRIBUTE", "DIV", "DO", "DUPLICATE", "ENGINE", "ESCAPE", "EXPLAIN", "EXTERNAL", "EXTRACT",
    "FETCH", "FILTER", "FIRST", "FOLLOWING", "FOR", "FOREIGN", "FUNCTION", "GENERATED", "GLOBAL", "GRANT", "GROUPING", "GROUPS", "IDENTITY", "IF",
    "IGNORE", "ILIKE", "INDEX", "INTERVAL", "ISNULL", "KEY", "LAST", "LATERAL", "LOCAL", "LOCATION", "MATCHED", "MATERIALIZED", "MERGE", "MINUS",
    "MOD", "NEXT", "NO", "NOTHING", "NOTNULL", "NULLS", "OFFSET", "ONLY", "OPTIONS", "OUTPUT", "OVER", "OVERWRITE", "PARTITION", "PARTITIONED",
    "PERCENT", "PIVOT", "POSITION", "PRECEDING", "PRIMARY", "PRIVILEGES", "QUALIFY", "RANGE", "RECURSIVE", "REFERENCES", "REGEXP", "RENAME",
    "REPLACE", "RESPECT", "RESTRICT", "RETURNING", "REVOKE", "RLIKE", "ROLLBACK", "ROLLUP", "CUBE", "ROW", "ROWS", "SAFE_CAST", "SCHEMA", "SEPARATOR",
    "SETS", "SIMILAR", "SOME", "SORT", "SOURCE", "START", "STORED", "SUBSTRING", "SYMMETRIC", "TABLESAMPLE", "TBLPROPERTIES", "TEMP", "TEMPORARY",
    "TIES", "TIME", "TIMESTAMP", "TO", "TOP", "TRANSACTION", "TRIM", "TRUNCATE", "TRY_CAST", "UNBOUNDED", "UNIQUE", "UNKNOWN", "UNLOGGED", "UNPIVOT",
    "USE", "VIEW", "WINDOW", "WITHIN", "WORK", "XOR", "ZONE", "TARGET",
))
_OPERATORS = ("<=>", "->>", "#>>", "<>", "!=", "<=", ">=", "||", "::", "->", "=>", ":=", "#>", "@>", "<@", "<<", ">>", "==", "=", "<", ">", "+", "-", "*", "/", "%", "^", "&", "|", "~", "(", ")", ",", ".", ";", "[", "]", ":")

GRAMMAR = """
script: ';'* [ statement ( ';'+ statement )* ';'* ] EOF ;
statement: query | insert | update | delete | merge | create | drop | alter | {mysql,postgres,spark,ansi,tsql} 'TRUNCATE' [ 'TABLE' ] table_name ( ',' table_name )* [ 'CASCADE' | 'RESTRICT' ]
  | 'EXPLAIN' [ 'ANALYZE' ] statement | 'BEGIN' [ 'TRANSACTION' | 'WORK' ] | 'START' 'TRANSACTION' | 'COMMIT' [ 'WORK' | 'TRANSACTION' ] | 'ROLLBACK' [ 'WORK' | 'TRANSACTION' ]
  | 'USE' [ 'SCHEMA' | 'DATABASE' ] path | 'SET' name ( '.' name )* ( '=' | 'TO' ) setting ( ',' setting )* | 'GRANT' privileges 'ON' [ 'TABLE' | 'SCHEMA' ] path 'TO' path
  | 'REVOKE' privileges 'ON' [ 'TABLE' | 'SCHEMA' ] path 'FROM' path | ( 'DESCRIBE' | 'ANALYZE' ) [ 'TABLE' ] table_name
  | 'COMMENT' 'ON' ( 'TABLE' | 'COLUMN' | 'VIEW' ) path 'IS' ( STRING | 'NULL' ) | {mysql} 'REPLACE' 'INTO' table_name [ columns ] ( query_body | with query_body ) ;
privileges: ( 'ALL' [ 'PRIVILEGES' ] | 'SELECT' | 'INSERT' | 'UPDATE' | 'DELETE' ) ( ',' ( 'SELECT' | 'INSERT' | 'UPDATE' | 'DELETE' ) )* ;
setting: expr | 'ON' | 'DEFAULT' ;
name: IDENT | {tsql} '[' ( IDENT | NUMBER | 'ORDER' | 'GROUP' | 'USER' | '-' )+ ']' ;
path: name ( '.' name )* ;
table_name: ( name | JINJA ) ( '.' ( name | JINJA ) )* ;
columns: '(' name ( ',' name )* ')' ;
query: [ with ] query_body ;
with: 'WITH' [ 'RECURSIVE' ] cte ( ',' cte )* ;
cte: name [ columns ] 'AS' [ [ 'NOT' ] 'MATERIALIZED' ] '(' ( query | insert | update | delete ) ')' ;
query_body: term ( ( 'UNION' | 'INTERSECT' | 'EXCEPT' | 'MINUS' ) [ 'ALL' | 'DISTINCT' ] term )* [ order ] [ {spark} 'DISTRIBUTE' 'BY' exprs ] [ {spark} 'CLUSTER' 'BY' exprs ] [ {spark} 'SORT' 'BY' sort ( ',' sort )* ] _limit* ;
_limit: 'LIMIT' ( expr | 'ALL' ) [ {mysql,spark} ',' expr ] | 'OFFSET' expr [ 'ROW' | 'ROWS' ] | 'FETCH' ( 'FIRST' | 'NEXT' ) [ NUMBER ] ( 'ROW' | 'ROWS' ) ( 'ONLY' | 'WITH' 'TIES' ) | 'FOR' ( 'UPDATE' | IDENT ) ;
order: 'ORDER' 'BY' sort ( ',' sort )* ;
sort: expr [ 'ASC' | 'DESC' ] [ 'NULLS' ( 'FIRST' | 'LAST' ) ] ;
term: select | 'VALUES' row ( ',' row )* | '(' query ')' | {postgres,ansi,spark} 'TABLE' table_name ;
row: '(' value ( ',' value )* ')' | {spark,mysql} expr | {mysql} 'ROW' '(' exprs ')' ;
value: expr | 'DEFAULT' ;
select: 'SELECT' [ 'ALL' | 'DISTINCT' [ {postgres} 'ON' '(' exprs ')' ] ] [ {tsql} 'TOP' ( NUMBER | '(' expr ')' ) [ 'PERCENT' ] ] item ( ',' item )* [ {tsql,postgres} 'INTO' table_name ]
  [ 'FROM' table_ref ( ',' table_ref )* ] lateral_view* [ 'WHERE' expr ] [ 'GROUP' 'BY' group ( ',' group )* ] [ 'HAVING' expr ] [ 'WINDOW' name 'AS' window ( ',' name 'AS' window )* ] [ {spark,ansi} 'QUALIFY' expr ] ;
lateral_view: {spark} 'LATERAL' 'VIEW' [ 'OUTER' ] path '(' [ arguments ] ')' [ name ] [ 'AS' name ( ',' name )* ] ;
group: expr | 'ALL' | ( 'ROLLUP' | 'CUBE' ) '(' exprs ')' | 'GROUPING' 'SETS' '(' grouping_set ( ',' grouping_set )* ')' ;
grouping_set: '(' [ exprs ] ')' | expr ;
item: _star | path '.' _star | expr [ [ 'AS' ] alias ] | {tsql} name '=' expr ;
_star: '*' [ ( 'EXCEPT' | 'REPLACE' ) '(' expr [ 'AS' name ] ( ',' expr [ 'AS' name ] )* ')' ] ;
alias: name | STRING ;
table_ref: table_primary join* ;
join: [ 'INNER' | ( 'LEFT' | 'RIGHT' | 'FULL' ) [ 'OUTER' ] | {spark} 'LEFT' ( 'SEMI' | 'ANTI' ) ] 'JOIN' table_primary ( 'ON' expr | 'USING' columns )
  | ( 'CROSS' | 'NATURAL' [ 'INNER' | ( 'LEFT' | 'RIGHT' | 'FULL' ) [ 'OUTER' ] ] ) 'JOIN' table_primary | {tsql} ( 'CROSS' | 'OUTER' ) 'APPLY' table_primary ;
table_primary: ( table_name | [ 'LATERAL' ] path '(' [ arguments ] ')' [ {postgres} 'WITH' IDENT ] | [ 'LATERAL' ] '(' query ')' | '(' table_ref ')' ) [ 'TABLESAMPLE' [ IDENT ] '(' expr [ 'PERCENT' | 'ROWS' ] ')' ] [ [ 'AS' ] name [ columns ] ] [ {tsql} 'WITH' '(' IDENT ')' ] [ pivot ] ;
pivot: {spark,tsql} 'PIVOT' '(' item ( ',' item )* 'FOR' path 'IN' '(' item ( ',' item )* ')' ')' [ [ 'AS' ] name ] ;
exprs: expr ( ',' expr )* ;
expr: _not ( ( 'AND' | 'OR' | {mysql} 'XOR' ) _not )* ;
_not: 'NOT'* operand _test* ;
_test: _compare ( operand | ( 'ANY' | 'SOME' | 'ALL' ) '(' ( query | expr ) ')' ) | 'IS' [ 'NOT' ] ( 'NULL' | 'TRUE' | 'FALSE' | 'UNKNOWN' | 'DISTINCT' 'FROM' operand )
  | [ 'NOT' ] ( 'IN' '(' ( exprs | query ) ')' | 'BETWEEN' [ 'SYMMETRIC' ] operand 'AND' operand | ( 'LIKE' | 'ILIKE' | 'RLIKE' | 'REGEXP' | 'SIMILAR' 'TO' ) [ 'ANY' | 'ALL' ] operand [ 'ESCAPE' operand ] ) | 'ISNULL' | 'NOTNULL' ;
_compare: '=' | '<>' | '!=' | '<' | '>' | '<=' | '>=' | {spark,mysql} '<=>' | {spark} '==' | {postgres} '~' | {postgres} '@>' | {postgres} '<@' ;
operand: _unary ( ( '+' | '-' | '*' | '/' | '%' | '^' | '&' | '|' | '||' | '->' | '->>' | '#>' | '#>>' | '<<' | '>>' | {mysql,spark} 'DIV' | {mysql} 'MOD' ) _unary )* ;
_unary: ( '+' | '-' | '~' )* primary ( '::' type | '[' expr [ ':' expr ] ']' | '.' name | 'COLLATE' path | 'AT' 'TIME' 'ZONE' primary )* ;
primary: NUMBER | STRING+ | PARAM | 'NULL' | 'TRUE' | 'FALSE' | '(' exprs ')' | '(' query ')' | [ 'NOT' ] 'EXISTS' '(' query ')' | case | path | call
  | ( 'CAST' | 'TRY_CAST' | 'SAFE_CAST' ) '(' expr 'AS' type ')' | {mysql,tsql} 'CONVERT' '(' ( expr ',' type | type ',' expr [ ',' expr ] | expr 'USING' name ) ')' | 'INTERVAL' ( STRING | [ '-' ] NUMBER | '(' expr ')' ) [ IDENT [ 'TO' IDENT ] ]
  | ( 'DATE' | 'TIMESTAMP' | 'TIME' ) STRING | 'ARRAY' '[' [ exprs ] ']' | '[' [ exprs ] ']' | 'EXTRACT' '(' IDENT 'FROM' expr ')' | 'SUBSTRING' '(' expr 'FROM' expr [ 'FOR' expr ] ')'
  | 'POSITION' '(' operand 'IN' expr ')' | 'TRIM' '(' [ IDENT ] [ expr ] 'FROM' expr ')' ;
call: ( path | 'LEFT' | 'RIGHT' | 'VALUES' ) '(' [ arguments ] ')' [ 'WITHIN' 'GROUP' '(' order ')' ] [ 'FILTER' '(' 'WHERE' expr ')' ] [ ( 'IGNORE' | 'RESPECT' ) 'NULLS' ] [ 'OVER' ( name | window ) ] ;
arguments: '*' | [ 'ALL' | 'DISTINCT' ] argument ( ',' argument )* [ order ] [ {mysql} 'SEPARATOR' STRING ] [ ( 'IGNORE' | 'RESPECT' ) 'NULLS' ] | query ;
argument: expr | name ( '=>' | ':=' ) expr | path '.' '*' ;
window: '(' [ name ] [ 'PARTITION' 'BY' exprs ] [ order ] [ ( 'ROWS' | 'RANGE' | 'GROUPS' ) ( bound | 'BETWEEN' bound 'AND' bound ) ] ')' ;
bound: 'UNBOUNDED' ( 'PRECEDING' | 'FOLLOWING' ) | 'CURRENT' 'ROW' | operand ( 'PRECEDING' | 'FOLLOWING' ) ;
case: 'CASE' [ expr ] ( 'WHEN' expr 'THEN' expr )+ [ 'ELSE' expr ] 'END' ;
type: ( IDENT+ | {spark} IDENT '<' type_field ( ',' type_field )* '>' ) [ '(' ( NUMBER | IDENT ) ( ',' NUMBER )* ')' ] [ 'WITH' 'TIME' 'ZONE' | IDENT 'TIME' 'ZONE' ] ( '[' [ NUMBER ] ']' )* ;
type_field: [ name ':' ] type ;
insert: 'INSERT' ( 'INTO' | {spark} 'OVERWRITE' | {mysql} 'IGNORE' 'INTO' | {spark} 'OVERWRITE' 'INTO' ) [ {spark} 'TABLE' ] table_name [ {postgres} 'AS' name ] [ {spark} 'PARTITION' '(' item ( ',' item )* ')' ] [ columns ] ( query | 'DEFAULT' 'VALUES' )
  [ {postgres} 'ON' 'CONFLICT' [ columns ] 'DO' ( 'NOTHING' | 'UPDATE' 'SET' assignment ( ',' assignment )* [ 'WHERE' expr ] ) ] [ {mysql} 'ON' 'DUPLICATE' 'KEY' 'UPDATE' assignment ( ',' assignment )* ] [ returning ] ;
returning: {postgres} 'RETURNING' item ( ',' item )* ;
assignment: path '=' value | columns '=' ( row | '(' query ')' ) ;
update: [ with ] 'UPDATE' table_ref ( {mysql} ',' table_ref )* 'SET' assignment ( ',' assignment )* [ {postgres,tsql} 'FROM' table_ref ( ',' table_ref )* ] [ 'WHERE' expr ] [ {mysql} order ] [ {mysql} 'LIMIT' expr ] [ returning ] ;
delete: [ with ] 'DELETE' 'FROM' table_name [ [ 'AS' ] name ] [ {postgres} 'USING' table_ref ( ',' table_ref )* ] [ 'WHERE' expr ] [ {mysql} order ] [ {mysql} 'LIMIT' expr ] [ returning ] ;
merge: [ with ] 'MERGE' 'INTO' table_name [ [ 'AS' ] name ] 'USING' table_primary 'ON' expr merge_when+ ;
merge_when: 'WHEN' [ 'NOT' ] 'MATCHED' [ 'BY' ( 'SOURCE' | 'TARGET' ) ] [ 'AND' expr ] 'THEN' ( 'UPDATE' 'SET' ( '*' | assignment ( ',' assignment )* ) | 'DELETE' | 'INSERT' ( '*' | [ columns ] 'VALUES' row ) | 'DO' 'NOTHING' ) ;
_exists: 'IF' 'EXISTS' ;
_absent: 'IF' 'NOT' 'EXISTS' ;
create: 'CREATE' [ 'OR' 'REPLACE' ] [ 'GLOBAL' | 'LOCAL' ] [ 'TEMP' | 'TEMPORARY' | 'UNLOGGED' | 'EXTERNAL' ] 'TABLE' [ _absent ] table_name ( '(' element ( ',' element )* ')' table_option* [ 'AS' query ] | table_option* 'AS' ( query | '(' query ')' [ 'WITH' [ 'NO' ] 'DATA' ] ) | 'LIKE' table_name )
  | 'CREATE' [ 'OR' 'REPLACE' ] [ 'GLOBAL' ] [ 'TEMP' | 'TEMPORARY' | 'MATERIALIZED' ] 'VIEW' [ _absent ] table_name [ columns ] 'AS' query [ 'WITH' [ 'NO' ] ( 'DATA' | 'CHECK' ) [ IDENT ] ]
  | 'CREATE' [ 'UNIQUE' ] 'INDEX' [ 'CONCURRENTLY' ] [ _absent ] [ name ] 'ON' table_name [ 'USING' IDENT ] '(' sort ( ',' sort )* ')' [ 'WHERE' expr ]
  | 'CREATE' ( 'SCHEMA' | 'DATABASE' ) [ _absent ] path ;
element: name type constraint* | [ 'CONSTRAINT' name ] ( 'PRIMARY' 'KEY' columns | 'UNIQUE' columns | 'CHECK' '(' expr ')' | 'FOREIGN' 'KEY' columns 'REFERENCES' table_name [ columns ] action* ) | {mysql} ( 'KEY' | 'INDEX' ) [ name ] columns ;
constraint: [ 'CONSTRAINT' name ] ( [ 'NOT' ] 'NULL' | 'PRIMARY' 'KEY' | 'UNIQUE' | 'DEFAULT' primary | 'CHECK' '(' expr ')' | 'REFERENCES' table_name [ columns ] action* | 'COLLATE' path | {mysql} 'AUTO_INCREMENT' | 'COMMENT' STRING
  | 'GENERATED' ( 'ALWAYS' | 'BY' 'DEFAULT' ) 'AS' ( 'IDENTITY' | '(' expr ')' IDENT* ) | {tsql} 'IDENTITY' [ '(' NUMBER ',' NUMBER ')' ] ) ;
action: 'ON' ( 'DELETE' | 'UPDATE' ) ( 'CASCADE' | 'RESTRICT' | 'SET' ( 'NULL' | 'DEFAULT' ) | 'NO' 'ACTION' ) ;
table_option: {spark} 'USING' IDENT | {spark} ( 'PARTITIONED' | 'CLUSTER' ) 'BY' '(' expr [ type ] ( ',' expr [ type ] )* ')' | {spark} 'LOCATION' STRING | 'COMMENT' [ '=' ] STRING | {spark} ( 'TBLPROPERTIES' | 'OPTIONS' ) '(' STRING '=' STRING ( ',' STRING '=' STRING )* ')'
  | {spark} 'STORED' 'AS' IDENT | {mysql} 'ENGINE' '=' IDENT | {mysql} 'DEFAULT' IDENT '=' IDENT | {postgres,tsql} 'WITH' '(' IDENT '=' expr ( ',' IDENT '=' expr )* ')' | {postgres} 'PARTITION' 'BY' IDENT columns ;
drop: 'DROP' ( 'TABLE' | [ 'MATERIALIZED' ] 'VIEW' | 'INDEX' | 'SCHEMA' | 'DATABASE' | 'FUNCTION' ) [ _exists ] table_name ( ',' table_name )* [ 'CASCADE' | 'RESTRICT' ] ;
alter: 'ALTER' ( 'TABLE' | 'VIEW' ) [ _exists ] table_name alteration ( ',' alteration )* ;
alteration: 'ADD' [ 'COLUMN' ] [ _absent ] element | {spark} 'ADD' ( 'COLUMNS' ) '(' element ( ',' element )* ')' | 'DROP' [ 'COLUMN' | 'CONSTRAINT' ] [ _exists ] name [ 'CASCADE' ] | 'RENAME' [ 'COLUMN' ] name 'TO' name | 'RENAME' 'TO' path
  | 'ALTER' [ 'COLUMN' ] name ( [ 'SET' 'DATA' ] IDENT type | 'SET' 'DEFAULT' expr | 'DROP' 'DEFAULT' | ( 'SET' | 'DROP' ) 'NOT' 'NULL' ) ;
"""

_WORD = r"[^\W\d][\w$]*"
_STANDARD = r"'(?:[^']|'')*'"
_BACKSLASH = r"'(?:[^'\\]|''|\\.)*'"


def _lexer(string: str) -> re.Pattern:
    jinja = r"\{\{[-+]?(?!\s*[-+]?\}\})(?:'[^']*'|\"[^\"]*\"|[^{}'\"])*\}\}"
    parts = [
        ("skip", r"[\s﻿]+|--[^\n]*|/\*(?:(?!/\*)[\s\S])*?\*/|/\*[\s\S]*?\*/"), ("JINJA", jinja), ("STRING", rf"(?:\b[NnEeXxBb](?='))?{string}|\$\$[\s\S]*?\$\$"), ("quoted", r'"(?:[^"]|"")+"'),
        ("IDENT", r"`[^`]+`"), ("NUMBER", r"(?:0[xX][0-9a-fA-F]+|\d+(?:\.\d*)?(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?)(?![^\W])"),
        ("PARAM", r"\?|\$\d+|%s|:[A-Za-z_]\w*(?<!::)|@@?\w+"), ("word", rf"[#]{{0,2}}{_WORD}"), ("op", "|".join(map(re.escape, _OPERATORS))),
    ]
    return re.compile("|".join(f"(?P<{n}>{p})" for n, p in parts))


_LEXERS = (_lexer(_STANDARD), _lexer(_BACKSLASH))


def tokens(text: str, lexer: re.Pattern) -> list[str] | None:
    """Token kinds, None where something is no token."""
    out, at = [], 0
    for m in lexer.finditer(text):
        if m.start() != at:
            return None
        at, kind = m.end(), m.lastgroup
        if kind == "skip":
            continue
        if kind == "word":
            word = m.group().upper()
            kind = word if word in RESERVED or word in SOFT else "IDENT"
        elif kind == "op":
            kind = m.group()
        elif kind == "PARAM" and m.group()[0] == ":" and out and text[m.start() - 1] == ":":
            return None
        elif kind == "JINJA" and (m.group().count("(") != m.group().count(")") or m.group().count("[") != m.group().count("]")):
            return None
        out.append(kind)
    return out if at == len(text) else None


@lru_cache(maxsize=1)
def grammar() -> Grammar:
    kinds = {w: {w} for w in RESERVED} | {w: {w, "IDENT"} for w in SOFT} | {o: {o} for o in _OPERATORS}
    kinds |= {"IDENT": {"IDENT"}, "quoted": {"IDENT", "STRING"}, "STRING": {"STRING"}, "NUMBER": {"NUMBER"}, "PARAM": {"PARAM"}, "JINJA": {"JINJA"}}
    return Grammar(GRAMMAR, "script", kinds, DIALECTS)


def statements(kinds: list[str]) -> list[list[str]]:
    """The token kinds between semicolons, which stand nowhere within a statement; empty ones are left out."""
    out: list[list[str]] = [[]]
    for kind in kinds:
        if kind == ";":
            out.append([])
        else:
            out[-1].append(kind)
    return [s for s in out if s]


def readings(text: str) -> Iterator[list[str]]:
    """The token kinds of a text: with doubled quotes in strings, and where there are any also with escaped ones."""
    for lexer in _LEXERS if "\\'" in text else _LEXERS[:1]:
        kinds = tokens(text, lexer)
        if kinds is not None:
            yield kinds


def dialects(text: str) -> int:
    """The dialects, as bits, that accept the whole text; an empty text is accepted by all."""
    return next((bits for kinds in readings(text) if (bits := grammar().accepts_all(statements(kinds)))), 0)
