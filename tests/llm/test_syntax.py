import ast
import random
import warnings
from pathlib import Path

import pytest

from weft.grammar import sql
from weft.llm.syntax import python, yaml
from weft.llm.syntax.files import check_files, rates
from weft.grammar.gll import Grammar

VALID_SQL = [
    "", "  -- nothing\n", "SELECT 1", "select a, b.c x from s.t b where a between 1 and 2 and b.c is not null;", "SELECT x.id FROM {{ ref('stg') }} x LEFT JOIN (SELECT id FROM raw.t GROUP BY id) y ON x.id = y.id",
    "WITH a AS (SELECT 1 AS n) SELECT * FROM a UNION ALL SELECT 2 ORDER BY 1 LIMIT 3", "INSERT INTO t (a, b) VALUES (1, 'it''s'), (2, NULL)", "CREATE TABLE x AS SELECT * FROM y; DELETE FROM x WHERE id IN (1, 2)",
    "UPDATE t SET a = a + 1, b = CASE WHEN c >= 2 THEN 'x' ELSE 'y' END WHERE NOT d", "CREATE TABLE t (id bigint PRIMARY KEY, n varchar(20) NOT NULL DEFAULT 'x', FOREIGN KEY (id) REFERENCES u (id))",
    "MERGE INTO t USING s ON t.id = s.id WHEN MATCHED THEN UPDATE SET a = s.a WHEN NOT MATCHED THEN INSERT (a) VALUES (s.a)", "SELECT TOP 5 [name] FROM [dbo].[t] WITH (NOLOCK)", "SELECT a::int, d->>'x' FROM t WHERE a ~ 'x'",
    "SELECT sum(a) OVER (PARTITION BY b ORDER BY c ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) FROM t", "select * from {{- source('raw', 'visits') -}} where kind in ('x', '(z')", "SELECT date, count(*) FILTER (WHERE x) FROM t GROUP BY date HAVING count(*) > 1",
    "DROP TABLE IF EXISTS a.b", "ALTER TABLE t ADD COLUMN c int", "TRUNCATE TABLE t", "/* a ; ( */ SELECT extract(year FROM d) FROM t", "INSERT INTO t SELECT * FROM u ON CONFLICT (id) DO NOTHING",
]
INVALID_SQL = [
    "SELCT a FROM t", "SELECT a FORM t.u WHERE x", "SELECT a,, b FROM t", "SELECT (a FROM t", "SELECT a FROM t WHERE", "SELECT 'open FROM t", "SELECT a FROM t GROUP BY", "<<<<<<< HEAD\nSELECT 1", "import os\n",
    "SELECT a FROM {{ ref('x') } y", "SELECT count( FROM t", "INSERT INTO", "SELECT a FROM t JOIN", "UPDATE t a = 1", "SELECT a b c FROM t", "/* open", "SELECT a FROM t ORDER id", "CREATE TABLE t (", "DELETE t WHERE", "SELECT a FROM t x LEFT JOIN u y",
]


@pytest.mark.parametrize("text", VALID_SQL)
def test_valid_sql(text):
    assert sql.dialects(text)


@pytest.mark.parametrize("text", INVALID_SQL)
def test_invalid_sql(text):
    assert not sql.dialects(text)


def test_dialects_run_together_but_do_not_mix():
    names = lambda text: [d for i, d in enumerate(sql.DIALECTS) if sql.dialects(text) >> i & 1]
    assert names("SELECT TOP 5 a FROM t") == ["tsql"]
    assert names("REPLACE INTO t VALUES (1)") == ["mysql"]
    assert names("SELECT a FROM t") == list(sql.DIALECTS)
    assert names("SELECT TOP 5 a FROM t; REPLACE INTO t VALUES (1)") == []


def test_ambiguous_and_left_recursive_grammars():
    g = Grammar("s: e EOF ; e: e '+' e | e 'x' | 'a' ;", "s", {k: {k} for k in "a+x"})
    assert g.accepts(list("a+a+axx+a")) and not g.accepts(list("a+")) and not g.accepts([]) and not g.accepts(["?"])
    h = Grammar("s: ( t | u )* EOF ; t: 'a' ; u: 'a' ;", "s", {"a": {"a"}})
    assert h.accepts(["a"] * 300)


def exact(text):
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            ast.parse(text)
        return True
    except (SyntaxError, ValueError):
        return False


SNIPPETS = [
    "", "x", "x = 1\n", "def f(a, /, b=1, *c, d, **e): return a\n", "def f(a=1, b): pass\n", "f(a=1, b)", "f(**k, *a)", "f(x for x in y)", "f(1, x for x in y)", "print 'a'", "exec 'a'", "a = *b, c", "(*a)", "[*a, b]", "x + 1 = 2",
    "f() = 1", "a.b[c], (d, *e) = f", "a: int = 3", "(a) += 1", "a, b += 1", "lambda x, *, y=1: x", "not a == not b", "a == not b", "if a:\n  b\nelse:\n  c\n", "if a:\nb\n", "try:\n  a\nexcept A, B:\n  c\n", "try:\n  a\nexcept* A as b:\n  c\n",
    "match x:\n  case {'a': int(n), **r} if n > 0: pass\n  case [1, *_] | None: pass\n", "match = 1\nmatch(x)\ntype = 3\ntype X[T] = list[T]\n", "async def f():\n  async with a as b, c: await d\n  return [x async for x in y]\n", "f'{a!r:>{w}} {{}} {b=}'",
    "f'{a'", "f'{}'", "f'{a:{b:{c}}}'", "b'a' b'c'", "b'a' 'c'", "'\\x1'", "r'\\x1'", "'\\N{DASH}'", "0777", "0o17", "1_000", "1__0", "5abc", "1if x else 2", "0x", "1e5j", "'open", "'''open\n", "(1,\n 2)", "(1]", "x = [\n", "@a.b\nclass C(D, metaclass=E): x: int\n",
    "global a, b\nnonlocal c\n", "del a[0], (b, c)\n", "del f()\n", "from . import (a, b,)\n", "from a import *\n", "import a.b as c, d\n", "from a import b,\n", "with (a as b, c): pass\n", "with (a, b) as c: pass\n", "raise A from b\n", "x = yield\n", "a if b", "a[1:2, ::3, *d]",
    "\tif x:\n        y\n", "if x:\n\ty\n        z\n", "if x:\n    y\n  z\n", "x = 1 \\\n  + 2\n", "x \\ \n", "while 1: a; b;\n", "def f[T: int = str](x: T) -> T: ...\n", "class A: pass;\n", "{**a, 'b': 1}", "{a: 1, b}", "{*a, b}", "x := 1", "(x := 1)", "a = b = c", "assert a, b",
    "for x in *a, b: pass\nelse: pass\n", "for f() in x: pass\n", "“a”", "é = 1\n", "$", "a?b", "<<<<<<< HEAD\n", "True = 1", "None.a = 1", "x\f\n", "if 1:\n    pass\n    # c\n# d\nx\n",
]


@pytest.mark.parametrize("text", SNIPPETS)
def test_python_snippets_as_the_interpreter_has_it(text):
    assert python.accepts(text) == exact(text)


def test_a_byte_order_mark_belongs_to_a_file():
    assert python.accepts("\ufeffx = 1\n") and not python.accepts("x = 1\n\ufeff")


def test_python_library_and_mutants_as_the_interpreter_has_it():
    rnd, wrong, seen = random.Random(3), [], 0
    for file in sorted(Path(ast.__file__).parent.glob("*.py"))[::6]:
        text = file.read_text(encoding="utf-8", errors="replace")
        if len(text) > 20_000:
            continue
        lines = text.split("\n")
        for _ in range(6):
            own = list(lines)
            for _ in range(rnd.randrange(3)):
                i = rnd.randrange(len(own))
                at = rnd.randrange(len(own[i]) + 1)
                own[i] = rnd.choice([own[i][:at] + rnd.choice("()[]{}:,=.'\"+ \t@#\\ax1") + own[i][at:], own[i][:at], own[i][:at] + own[i][at + 1 :], "  " + own[i], own[i].lstrip()])
            mutant = "\n".join(own)
            seen += 1
            if python.accepts(mutant) != exact(mutant):
                wrong.append((file.name, python.accepts(mutant)))
    assert seen > 60 and len(wrong) <= seen // 50, wrong


VALID_YAML = ["", "# c\n", "a: 1\nb:\n- c\n- d: e\n  f: [1, {g: h}]\n", "--- \na\n...\n---\n- b\n", "a: |\n  x: y: z\n  [\nb: >-\n  t\n", "? a\n: b\n", "a: 'it''s'\nb: \"c\\n\"\n", "&x a: *x\n", "a: !t {b: c}\n", "a:\r\n  b: 1\r\n", "{a: 1,\n b: 2}\n", "a: b\n  c\n", "- - a\n  - b\n-\n  c: d\n"]
INVALID_YAML = ["a: b: c\n", "a: [1, 2\n", "a: {b: [1}\n", "a:\n\tb: 1\n", "@a\n", "a: 'open\n", "a: 1\n- b\n", "a: 1\n  b: 2\n", "<<<<<<< HEAD\na: 1\n", "a: \"\\q\"\n", "a\nb: 1\n", "[a]]\n", "a: `b`\n", "- a\nb: 1\n"]


@pytest.mark.parametrize(("text", "want"), [(t, True) for t in VALID_YAML] + [(t, False) for t in INVALID_YAML])
def test_yaml(text, want):
    assert yaml.accepts(text) is want
    library = pytest.importorskip("yaml")
    try:
        list(library.parse(text))
        assert want
    except library.YAMLError:
        assert not want


def test_files_and_rates(spark):
    rows = [
        (1, "r", "a/B.PY", "x = (\n"), (2, "r", "a.py", ""), (3, "r", "b.Sql", None), (4, "s", "c.yml", "a: b: c"), (5, "s", "d.txt", "("), (6, None, None, "("), (7, "s", "e.yaml", "a: 1"),
        (8, "r", "x.py", "y = [\n" + "1,\n" * 20_000 + "]\n"), (9, "r", "deep.py", "(" * 60 + ")" * 60), (1, "r", "a/B.PY", "x = (\n"),
    ]
    df = spark.createDataFrame(rows, "file_id long, repo string, file_path string, content string").selectExpr("*", "'x' as language", "true as invalid")
    got = sorted((r["file_id"], r["language"], r["invalid"]) for r in check_files(df).collect())
    assert got == [(1, "python", True)] * 2 + [(2, "python", False), (3, "sql", False), (4, "yaml", True), (7, "yaml", False), (8, "python", False), (9, "python", False)]
    assert {(r["repo"], r["language"]): (r["files"], r["invalid"], r["rate"]) for r in rates(check_files(df)).collect()} == {
        ("r", "python"): (5, 2, 0.4), ("r", "sql"): (1, 0, 0.0), ("s", "yaml"): (2, 1, 0.5),
    }
    assert check_files(df.limit(0)).collect() == []
