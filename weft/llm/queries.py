"""Queries p3, p4, p6, p7 and p8, and the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm import leaks, mixing, reading, representative
from weft.llm.syntax.files import check_files, rates
from weft.session import table


def _tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    return representative.tally(representative.unpivot_facts(table(spark, sf_dir, "node_facts"), table(spark, sf_dir, "parser_trust")))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fact that supplies each field of every node with several facts."""
    won = representative.winners(_tally(spark, sf_dir))
    return won.filter("members >= 2 and fact_id is not null").select("group_id", "field", "fact_id")


def p3_golden(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record per node, each field from its best fact."""
    return representative.golden_records(representative.winners(_tally(spark, sf_dir)))


def p3_voted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record per node, each field the value with the most votes of trust times recency decay."""
    return representative.golden_records(representative.winners(_tally(spark, sf_dir), by="votes"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files that every dialect of their language rejects."""
    return check_files(table(spark, sf_dir, "source_files")).filter("invalid").select("file_id")


def p4_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A flag for every file, with the number of dialects that accept it."""
    checked = check_files(table(spark, sf_dir, "source_files"))
    return checked.select("file_id", "repo", "language", F.size("dialects").alias("dialects"), "invalid")


def p4_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates of files that do not parse per repository and language."""
    return rates(check_files(table(spark, sf_dir, "source_files")))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that share 12 consecutive words with a test item."""
    found = leaks.leaked_windows(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"), cells="cells")
    return found.select("doc_id", "item_id").distinct()


def p6_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the spans that leaked."""
    return leaks.remove_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"), cells="cells")


def _mixture(spark: SparkSession, sf_dir: str) -> mixing.Mixture:
    return mixing.Mixture(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sources that cannot reach their share."""
    return _mixture(spark, sf_dir).report().filter("short").select("source")


def p7_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and actual shares of the mixed corpus."""
    return _mixture(spark, sf_dir).report()


def p7_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixed corpus in its global order, a row with the whole document for each copy."""
    return _mixture(spark, sf_dir).corpus()


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The demanding documents."""
    documents = table(spark, sf_dir, "documents")
    return reading.demanding(reading.prose_features(documents), reading.fit(documents))


def p8_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reading level of every document."""
    documents = table(spark, sf_dir, "documents")
    return reading.reading_levels(reading.prose_features(documents), reading.fit(documents))


QUERIES = {f.__name__: f for f in (p3_found, p3_golden, p3_voted, p4_found, p4_files, p4_rates, p6_found, p6_cleaned, p7_found, p7_report, p7_corpus, p8_found, p8_levels)}

_FACTS = r"""
parts AS (
  SELECT *, list_transform(string_split(regexp_replace(id, '^\s+|\s+$', '', 'g'), ':'), lambda p: regexp_replace(p, '^\s+|\s+$', '', 'g')) AS ps
  FROM node_facts WHERE id IS NOT NULL),
keyed AS (
  SELECT *, ps[1] AS kind, array_to_string(ps[2:], ':') AS rest, array_to_string(ps[3:], ':') AS path FROM parts),
canon AS (
  SELECT *, kind || ':' || CASE kind
    WHEN 'sql_table' THEN array_to_string(list_transform(string_split(rest, '.'), lambda p: lower(regexp_replace(p, '^[\s`''"\[\]]+|[\s`''"\[\]]+$', '', 'g'))), '.')
    WHEN 'api_route' THEN upper(ps[2]) || ':' || CASE WHEN starts_with(path, '/') THEN path ELSE '/' || path END
    WHEN 'external_system' THEN regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(rest), '^[a-z][a-z0-9+.-]*:\s*//', ''), '[/?#].*$', ''), '^.*@', ''), ':.*$', '')
    ELSE rest END AS node FROM keyed),
facts AS (
  SELECT c.*, coalesce(t.trust, 0) AS tr, min(fact_id) OVER (PARTITION BY repo, node) AS group_id, count(*) OVER (PARTITION BY repo, node) AS members,
    regexp_replace(file_path, '^\s+|\s+$', '', 'g') AS path_value,
    to_json(list_sort(list_transform(map_entries(metadata), lambda e: {'key': e.key, 'value': coalesce(e.value, 'null')})))::VARCHAR AS meta_value,
    coalesce(len(list_filter(map_values(metadata), lambda v: v IS NOT NULL AND regexp_matches(v, '\S'))), 0) AS filled
  FROM canon c LEFT JOIN parser_trust t USING (parser)),
long AS (
  SELECT repo, node, group_id, members, 'file_path' AS field, path_value AS value, 0 AS filled, tr, emitted_at, fact_id FROM facts WHERE regexp_matches(lower(path_value), '\.(py|sql|yml|yaml)$')
  UNION ALL SELECT repo, node, group_id, members, 'line_number', line_number::VARCHAR, 0, tr, emitted_at, fact_id FROM facts WHERE line_number > 0
  UNION ALL SELECT repo, node, group_id, members, 'metadata', meta_value, filled, tr, emitted_at, fact_id FROM facts WHERE filled > 0),
won AS (
  SELECT *, row_number() OVER (PARTITION BY repo, node, field ORDER BY filled DESC, tr DESC, emitted_at DESC NULLS LAST, fact_id) AS place FROM long)
"""

_PROSE = r"""
shown AS (SELECT doc_id, unnest(list_filter(cells, lambda c: c.kind = 'text' AND c.len > 0)) AS c, text FROM documents),
lines AS (SELECT doc_id, unnest(string_split(replace(replace(substring(text, c.pos + 1, c.len), E'\r\n', E'\n'), E'\r', E'\n'), E'\n')) AS line FROM shown),
counted AS (
  SELECT doc_id, sum(len(regexp_extract_all(line, '\p{L}+'))) AS words, sum(length(regexp_replace(line, '\P{L}', '', 'g'))) AS letters,
    sum(len(list_filter(regexp_split_to_array(line || ' ', '[.!?][\s\p{Z}\x0B\x{85}]'), lambda s: regexp_matches(s, '\p{L}')))) AS sentences
  FROM lines WHERE regexp_matches(line, '^\p{L}') GROUP BY doc_id)
"""

_LEAKS = r"""
limits AS (SELECT doc_id, text, list_sort(list_distinct(list_concat([0::BIGINT], flatten(list_transform(cells, lambda c: [c.pos, c.pos + c.len]))))) AS cuts FROM documents),
pieces AS (SELECT doc_id, unnest(list_transform(range(1, len(cuts) + 1), lambda i: substring(text, cuts[i] + 1, coalesce(cuts[i + 1], 2000000000) - cuts[i]))) AS piece, unnest(range(1, len(cuts) + 1)) AS k FROM limits),
doc_words AS (SELECT doc_id, flatten(list(regexp_extract_all(lower(piece), '[\p{L}\p{N}]+') ORDER BY k)) AS w FROM pieces GROUP BY doc_id),
doc_grams AS (SELECT doc_id, unnest(list_transform(range(1, len(w) - 10), lambda i: array_to_string(w[i:i + 11], ' '))) AS gram FROM doc_words WHERE len(w) >= 12),
item_words AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM eval_items),
item_grams AS (SELECT item_id, unnest(list_transform(range(1, len(w) - 10), lambda i: array_to_string(w[i:i + 11], ' '))) AS gram FROM item_words WHERE len(w) >= 12)
"""

_NAME = r"lower(regexp_replace(source, '^\s+|\s+$', '', 'g'))"

_PIVOT = ", ".join(f"max(value) FILTER (field = '{f}') AS {f}" for f in ("file_path", "line_number", "metadata"))

_VOTES = """
newest AS (SELECT max(epoch_us(emitted_at)) AS t FROM facts),
tally AS (
  SELECT repo, node, field, value, sum(coalesce(round((tr + 1) * pow(2.0, -((SELECT t FROM newest) - epoch_us(emitted_at)) / 86400000000.0 / 90.0) * 1000000)::BIGINT, 0)) AS votes FROM long GROUP BY ALL),
won_votes AS (SELECT *, row_number() OVER (PARTITION BY repo, node, field ORDER BY votes DESC, value) AS place FROM tally)
"""


def _golden_sql(ctes: str, winners: str) -> str:
    return (
        f"WITH {_FACTS}{ctes}, nodes AS (SELECT DISTINCT repo, node, group_id, members FROM facts), p AS (SELECT repo, node, {_PIVOT} FROM {winners} WHERE place = 1 GROUP BY repo, node) "
        "SELECT n.*, file_path, line_number, metadata FROM nodes n LEFT JOIN p ON n.repo IS NOT DISTINCT FROM p.repo AND n.node = p.node"
    )


ORACLE = {
    "p3_golden": _golden_sql("", "won"),
    "p3_voted": _golden_sql("," + _VOTES, "won_votes"),
    "p3_found": f"WITH {_FACTS} SELECT group_id, field, fact_id FROM won WHERE place = 1 AND members >= 2",
    "p6_found": f"WITH {_LEAKS} SELECT DISTINCT doc_id, item_id FROM doc_grams JOIN item_grams USING (gram)",
    # sizes in characters: the margins of the shortfalls are wide enough for any measure of size
    "p7_found": f"WITH own AS (SELECT {_NAME} AS source, sum(length(text)) AS n FROM documents GROUP BY 1) "
    f"SELECT {_NAME} AS source FROM mix_targets t LEFT JOIN own ON own.source = {_NAME.replace('source', 't.source')} "
    "WHERE target_share * (SELECT sum(length(text)) FROM documents) > max_repeats * coalesce(n, 0)".replace(f"SELECT {_NAME} AS source FROM mix", f"SELECT {_NAME.replace('source', 't.source')} AS source FROM mix"),
    "p8_found": f"WITH {_PROSE} SELECT doc_id FROM counted WHERE words >= 20 * sentences AND 10 * letters >= 51 * words AND words > 0",
}
