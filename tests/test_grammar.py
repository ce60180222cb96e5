import pytest

from weft.grammar import gll, sql
from weft.plans import extraction_queries
from weft.sources.sqltext import sql_facts


@pytest.mark.parametrize("text", ["CREATE TABLE x AS SELEC * FROM y", "SELECT 1 +* 2 FROM z", "select * from a group order b", "SELECT a b c d FROM t x y z", "SELECT TOP 5 a FROM t; REPLACE INTO t VALUES (1)"])
def test_text_that_no_dialect_accepts_gives_no_facts(text):
    assert sql_facts(text) == ((), "no dialect accepts it")


def test_statements_without_a_place_in_the_grammar_are_passed_over():
    facts, error = sql_facts("SET x = 1; ANALYZE t COMPUTE STATISTICS; SELECT * FROM u")
    assert error is None and [f.sources for f in facts] == [(), (), ("u",)]


def test_all_tables_of_an_update_are_read():
    assert [(f.sources, f.target) for f in sql_facts("UPDATE a, b SET a.x = b.y")[0]] == [(("b",), "a")]


def test_verdicts_are_remembered_by_kinds_and_forgotten_beyond_a_bound(monkeypatch):
    monkeypatch.setattr(gll, "MEMORY", 2)
    g = gll.Grammar("s: ( 'a' | 'b' )+ EOF ;", "s", {k: {k} for k in "abc"})
    assert [g.accepts_all([[k] * n]) for n in (1, 2, 3) for k in "abc"] == [1, 1, 0] * 3 and len(g.memory) <= 2
    assert g.accepts_all([]) == 1 and g.accepts_all([["a"], ["c"]]) == 0


def test_dialects_of_a_script_are_those_of_all_its_statements():
    one = {t: sql.dialects(t) for t in ("SELECT TOP 5 a FROM t", "SELECT a FROM t", "SELECT a::int FROM t")}
    for a in one:
        for b in one:
            assert sql.dialects(f"{a};;{b};") == one[a] & one[b] and sql.grammar().accepts(sql.tokens(f"{a};;{b};", sql._LEXERS[0])) == one[a] & one[b]


def test_every_fixture_has_expected_rows():
    assert set(extraction_queries.EXPECTED) == set(extraction_queries.FIXTURES) and set(extraction_queries.QUERIES) == set(extraction_queries.ORACLE)
