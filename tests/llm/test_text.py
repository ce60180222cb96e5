import math
import random
import re
from collections import Counter
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from weft.llm import leaks, mixing, reading, representative

CELL = "array<struct<kind:string,exec_count:int,pos:long,len:long>>"


# leaks

ITEM = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"


def found(spark, docs, items, **options):
    d = spark.createDataFrame(docs, f"doc_id long, text string, cells {CELL}, item_id string")
    i = spark.createDataFrame(items, "item_id long, text string, doc_id string")
    out = leaks.leaked_windows(d, i, cells="cells", **options)
    return {(r["doc_id"], r["item_id"]): [tuple(s) for s in r["spans"]] for r in out.collect()}


def test_words_are_runs_of_letters_and_digits():
    assert leaks.words("Añ_o 3x-İB é²") == ["añ", "o", "3x", "i̇b", "é²"]
    assert leaks.words(None) == leaks.words("") == []


def test_partial_retypeset_and_near_misses(spark):
    docs = [
        (1, f"x {ITEM.upper()} y", None, ""), (2, ITEM.replace(" ", " **\n> "), [], ""), (3, " ".join(ITEM.split()[:12]), None, ""), (4, " ".join(ITEM.split()[:11]) + " zzz twelve thirteen", None, ""),
        (5, None, None, ""), (6, "", None, ""), (7, ("filler " * 40_000) + ITEM, None, ""), (8, ITEM.replace("seven", "sev") , None, ""), (8, ITEM, None, ""),
        (9, ITEM.replace("six seven", "sixseven"), [("text", None, 0, ITEM.index("seven") - 1), ("text", None, ITEM.index("seven") - 1, 500)], ""), (None, "a", None, ""),
    ]
    got = found(spark, docs, [(10, ITEM, ""), (11, " ".join(ITEM.split()[1:]), ""), (12, "too short", ""), (13, None, ""), (None, ITEM, "")])
    assert got[1, 10] == [(1, 15)] and got[2, 10] == [(0, 14)] and got[3, 10] == [(0, 12)] and (3, 11) not in got
    assert got[7, 10] == [(40_000, 40_014)] and (8, 10) in got and got[9, 10] == [(0, 14)]
    assert {d for d, _ in got} == {1, 2, 3, 7, 8, 9}


def test_windows_against_brute_force(spark):
    rnd = random.Random(1)
    vocabulary = [f"w{i}" for i in range(6)]
    text = lambda n: " ".join(rnd.choice(vocabulary + ["zz"]) for _ in range(n))
    docs = [(i, text(60), None, "") for i in range(40)]
    items = [(i, text(12), "") for i in range(30)]
    want = set()
    for d, body, _, _ in docs:
        grams = {tuple(body.split()[k : k + 4]) for k in range(57)}
        want |= {(d, i) for i, t, _ in items if any(tuple(t.split()[k : k + 4]) in grams for k in range(9))}
    assert set(found(spark, docs, items, n=4)) == want
    assert set(found(spark, docs, items, n=4, most=30)) == want  # several passes, each with a bounded broadcast


@pytest.mark.parametrize("most", [leaks.BROADCAST_WORDS, 20])  # one set, and one set an item
def test_removal_leaves_the_rest(spark, most):
    other = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu"
    split = ITEM.replace("six seven", "sixseven")
    half = split.index("seven")
    docs = [
        (1, f"a b {ITEM}! c", None), (2, "clean", [("text", 0, 0, 2)]), (3, None, None), (None, f"x {ITEM} y {other} z", None), (5, split + " end", [("text", 0, 0, half), ("code", 1, half, 10_000)]),
        (6, "", []), (7, f"{ITEM} {' '.join(other.split()[:6])} {ITEM} {' '.join(other.split()[6:])}", None), (1, "twice", None),
    ]
    rows = spark.createDataFrame(docs, f"doc_id long, text string, cells {CELL}")
    items = spark.createDataFrame([(7, ITEM), (8, other), (9, ITEM)], "item_id long, text string")
    got = [tuple(r) for r in leaks.remove_leaks(rows, items, cells="cells", most=most).collect()]
    want = [
        (1, "a b ! c", 14), (2, "clean", 0), (3, None, 0), (None, "x  y  z", 27), (5, " end", 14), (6, "", 0),
        (7, f" {' '.join(other.split()[:6])}  {' '.join(other.split()[6:])}", 28), (1, "twice", 0),
    ]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_no_items_or_documents(spark):
    assert found(spark, [(1, ITEM, None, "")], []) == {} and found(spark, [], [(1, ITEM, "")]) == {}


# mixing

def test_capped_poisson_has_the_wanted_mean():
    for rate, cap in ((0.3, 1), (0.5, 2), (1.9, 2), (4.2, 6), (0.0, 3)):
        mean = mixing.poisson_mean(rate, cap)
        below = mixing.steps(mean, cap)
        assert mixing.capped_mean(mean, cap) == pytest.approx(rate, abs=1e-6)
        assert sum(1 - b for b in below) == pytest.approx(rate, abs=1e-6)
    mean = mixing.poisson_mean(900.0, 10_000)
    assert mean == pytest.approx(900, rel=1e-6) and sum(1 - b for b in mixing.steps(mean, 10_000)) == pytest.approx(900, rel=1e-6)
    assert mixing.poisson_mean(2.0, 2) == math.inf and mixing.steps(math.inf, 2) == [0.0, 0.0] and mixing.steps(1.0, 0) == []


def mixture(spark, docs, targets, **options):
    d = spark.createDataFrame(docs, "doc_id long, source string, text string, tokens string, copies int")
    return mixing.Mixture(d, spark.createDataFrame(targets, "source string, target_share double, max_repeats int"), **options)


def test_shares_caps_and_shortfalls(spark):
    docs = [(i, " Web\t" if i % 2 else "WEB", "alpha beta gamma delta " * (1 + i % 3), "", 0) for i in range(3000)]
    docs += [(10_000 + i, "books", "one two three " * 4, "", 0) for i in range(600)] + [(20_000 + i, "tiny", "a b", "", 0) for i in range(5)] + [(30_000, None, "left over", "", 0), (30_001, "other", None, "", 0), (30_002, "web", "", "", 0)]
    m = mixture(spark, docs, [("web", 0.5, 3), ("Books ", 0.3, 4), ("tiny", 0.1, 2), ("absent", 0.1, 3), (None, 0.5, 1)])
    plan = {r["source"]: r for r in m.report().collect()}
    assert set(plan) == {"web", "books", "tiny", "absent"} and {s for s, r in plan.items() if r["short"]} == {"tiny", "absent"}
    for s in ("web", "books"):
        assert abs(plan[s]["mixed_tokens"] / plan[s]["wanted"] - 1) < 0.1
    assert plan["tiny"]["taken"] == 10 and plan["absent"]["taken"] == plan["absent"]["mixed_tokens"] == 0
    assert sum(r["actual_share"] for r in plan.values()) == pytest.approx(1)
    rows = m.corpus().collect()
    times = Counter(r["doc_id"] for r in rows)
    cap = {"web": 3, "books": 4, "tiny": 2}
    source = {r["doc_id"]: r["source"] for r in rows}
    assert all(n <= cap[source[d]] for d, n in times.items()) and all(sorted(r["copy"] for r in rows if r["doc_id"] == d) == list(range(1, times[d] + 1)) for d in list(times)[:20])
    assert [r["place"] for r in rows] == sorted(r["place"] for r in rows) and rows == m.corpus().collect()
    assert Counter(r["source"] for r in rows)["web"] == plan["web"]["taken"]


def test_the_corpus_holds_whole_documents(spark):
    docs = [(i, " Web\t", f"text {i}", f"own {i}", i) for i in range(300)] + [(7, "web", "same key", "", 0), (None, "web", "no key", "", 0), (400, "web", None, None, None), (401, "other", "x", "", 0)]
    m = mixture(spark, docs, [("web", 2.0, 4)])
    rows = m.corpus().collect()
    got = Counter((r["doc_id"], r["document_source"], r["text"], r["document_tokens"], r["copies"]) for r in rows)
    times = {(r["doc_id"]): r["copies"] for r in m.counts(m.plan()).collect()}
    assert got == Counter({d: times[d[0]] for d in docs if times.get(d[0])}) and len(rows) > 400
    encoding = mixing._encoding(mixing.TOKENIZER_DIR, mixing.TOKENIZER_FILE)
    assert all(r["tokens"] == len(encoding.encode_ordinary(r["text"] or "")) and r["source"] == "web" for r in rows)
    assert [r["place"] for r in rows] == sorted(r["place"] for r in rows)


def test_short_is_read_off_the_mixture(spark):
    docs = [(i, s, "one two three four", "", 0) for i, s in enumerate(["a"] * 10 + ["b"] * 10 + ["c"] * 80)]
    report = {r["source"]: r for r in mixture(spark, docs, [("a", 0.2, 2), ("b", 0.21, 2), ("c", 0.0, 0), ("d", 0.0, 5)]).report().collect()}
    assert {s for s, r in report.items() if r["short"]} == {"b"}  # a is spent and just reaches its share
    assert report["a"]["taken"] == report["b"]["taken"] == 20 and report["c"]["taken"] == 0


def test_empty_mixtures_and_double_targets(spark):
    assert [tuple(r)[:3] for r in mixture(spark, [], [("a", 1.0, 2)]).report().collect()] == [("a", 1.0, 0.0)]
    assert mixture(spark, [], [("a", 1.0, 2)]).corpus().collect() == []
    assert mixture(spark, [(1, "a", "x", "", 0)], []).report().collect() == []
    with pytest.raises(ValueError):
        mixture(spark, [(1, "a", "x", "", 0)], [("a", 0.5, 2), ("A ", 0.5, 2)]).report()


def test_token_sizes_are_those_of_the_whole_text(spark):
    texts = ["", None, "Hello world", "x" * 50_000, "naïve 💡 " * 1000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    encoding = mixing._encoding(mixing.TOKENIZER_DIR, mixing.TOKENIZER_FILE)
    got = {r["doc_id"]: r["tokens"] for r in mixing.token_sizes(df, ["doc_id"]).collect()}
    assert got == {i: len(encoding.encode_ordinary(t)) if t else 0 for i, t in enumerate(texts)}
    assert encoding.decode(encoding.encode_ordinary(texts[4])) == texts[4]


# reading

def measures(text, cells):
    words = letters = sentences = 0
    for kind, _, pos, size in cells or []:
        if kind != "text":
            continue
        for line in re.split("\r\n|\r|\n", text[pos : pos + size]):
            if not line[:1].isalpha():
                continue
            for sentence in re.split(r"[.!?](?=\s|$)", line):
                own = re.findall(r"[^\W\d_]+", sentence)
                words, letters, sentences = words + len(own), letters + sum(map(len, own)), sentences + bool(own)
    return words, letters, sentences


def documents(spark, rows):
    return spark.createDataFrame(rows, f"doc_id long, text string, cells {CELL}, words string, score string")


def test_prose_is_counted_as_stated(spark):
    parts = ["Hello there, e.g. this... is 3.5 long! Really?", "- no prose here", "Ünïcode wörds 12 end", "x\r\nY z.\rW", "... !!! ???", "One\u00a0two.\u00a0Three four!\u2009Five", "End.\n\n  indented line\nA.b c? d"]
    text = "\n".join(parts)
    at, cells = 0, []
    for i, p in enumerate(parts):
        cells.append(("code" if i == 3 else "text", i, at, len(p)))
        at += len(p) + 1
    rows = [(1, text, cells, "", ""), (2, None, cells, "", ""), (3, text, None, "", ""), (4, "", [], "", ""), (5, text, [("text", 0, None, 5), (None, 0, 0, 5), ("text", 0, 0, 10_000), ("text", 0, 3, -1)], "", ""), (6, "Word " * 30_000, [("text", 0, 0, 150_000)], "", "")]
    got = {r["doc_id"]: (r["words"], r["letters"], r["sentences"]) for r in reading.prose_features(documents(spark, rows)).collect()}
    assert got == {1: measures(text, cells), 2: (0, 0, 0), 3: (0, 0, 0), 4: (0, 0, 0), 5: measures(text, [("text", 0, 0, 10_000)]), 6: (30_000, 120_000, 1)}


def corpus(n=400):
    rnd, rows = random.Random(5), []
    for i in range(n):
        hard = i / n
        body = ""
        for _ in range(6):
            body += " ".join("a" * max(1, int(rnd.gauss(2 + 6 * hard, 1))) for _ in range(max(2, int(rnd.gauss(4 + 40 * hard, 3))))).capitalize() + ". "
        rows.append((i, body, [("text", None, 0, len(body))], "", ""))
    return rows


def test_levels_follow_difficulty_on_held_out_documents(spark):
    rows = corpus()
    model = reading.fit(documents(spark, rows[::2]))
    got = {r["doc_id"]: r for r in reading.reading_levels(reading.prose_features(documents(spark, rows[1::2])), model).collect()}
    ids = sorted(got)
    right = [got[a]["score"] < got[b]["score"] for a, b in zip(ids, ids[20:])]
    assert np.mean(right) > 0.95 and {r["level"] for r in got.values()} == {1, 2, 3, 4, 5}
    assert model.held_out > 0.95 and min(model.weights) >= 0
    grades = [got[i]["grade"] for i in sorted(ids, key=lambda i: got[i]["score"])]
    assert grades == sorted(grades)


def test_demanding_documents_are_exact(spark):
    rows = corpus() + [(900, "", [], "", ""), (901, None, None, "", "")]
    df = documents(spark, rows)
    want = {d for d, t, c, _, _ in rows for w, n, s in [measures(t or "", c)] if w and w >= 20 * s and n >= 5.1 * w}
    got = [r["doc_id"] for r in reading.demanding(reading.prose_features(df), reading.fit(df)).collect()]
    assert sorted(got) == sorted(want) and want
    features = reading.prose_features(df)
    assert len(want) <= reading.candidates(features, reading.fit(df)).count() < features.count()
    empty = df.limit(0)
    assert reading.demanding(reading.prose_features(empty), reading.fit(empty)).collect() == []
    assert reading.reading_levels(reading.prose_features(df.filter("doc_id >= 900")), reading.fit(empty)).select("level").distinct().collect() == [(0,)]


def test_any_model_keeps_all_demanding_documents(spark):
    rnd, rows = random.Random(8), []
    for i in range(300):  # around the limits, with very uneven sentences and words
        body = " ".join(" ".join("b" * rnd.choice((1, 2, 5, 6, 12, 30)) for _ in range(rnd.choice((1, 2, 25, 70)))) + "." for _ in range(rnd.randint(1, 6)))
        rows.append((i, body, [("text", None, 0, len(body))], "", ""))
    df = documents(spark, rows)
    want = {d for d, t, c, _, _ in rows for w, n, s in [measures(t, c)] if w and w >= 20 * s and 10 * n >= 51 * w}
    for _ in range(3):
        model = reading.ReadingModel([rnd.random() * 10 for _ in reading.FEATURES], [0.0], [0.0])
        assert want and {r["doc_id"] for r in reading.demanding(reading.prose_features(df), model).collect()} == want


def test_own_grades_and_cells_far_into_a_text(spark):
    body = "x" * 70_000 + "\nAbc def. Ghi\n" + "y" * 70_000 + "\nLast words here."
    at = body.index("Last")
    df = documents(spark, [(1, body, [("text", 0, 70_001, 12), ("text", 1, at, 999), ("text", 2, 65_530, 4_480), ("text", 3, 10**6, 5)], "3", "")])
    got = reading.prose_features(df).first()
    assert (got["words"], got["letters"], got["sentences"]) == measures(body, [("text", 0, 70_001, 12), ("text", 1, at, 999), ("text", 2, 65_530, 4_480)])
    graded = reading.fit(documents(spark, [(i, t, c, str(-i), "") for i, t, c, _, _ in corpus(60)]), grade="words")
    assert graded.weights == [0.0] * len(reading.FEATURES) or graded.held_out is not None


def test_isotonic_is_the_monotone_fit():
    lows, means = reading.isotonic(np.array([1.0, 2, 3, 4, 4]), np.array([1.0, 3, 2, 5, 7]))
    assert lows == [1, 2, 4] and means == [1, 2.5, 6]


# representatives

FACTS = "fact_id long, repo string, parser string, id string, name string, type string, file_path string, line_number int, metadata map<string,string>, emitted_at timestamp, trust string, node string"


def at(day):
    return datetime(2024, 1, day) if day else None


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("  python_function: a.B ", "python_function:a.B"), ("sql_table: \"Gold\" . [My T] ", "sql_table:gold.my t"), ("api_route: post : x/y", "api_route:POST:/x/y"), ("api_route:get:/a:b", "api_route:GET:/a:b"),
        ("external_system: HTTPS://u:p@Host.Example:443/a/b:c", "external_system:host.example"), ("external_system:HOST", "external_system:host"), ("external_system:http://[::1]:80/", "external_system:::1"), ("llm: a : B ", "llm:a:B"), ("bare", "bare"), (None, None),
    ],
)
def test_canonical_ids(spark, raw, want):
    df = spark.createDataFrame([(raw,)], "id string")
    assert df.select(representative.canonical_id(F.col("id"))).first()[0] == want


def winners(spark, rows, by="preference"):
    return representative.winners(representative.tally(unpivoted(spark, rows)), by)


def unpivoted(spark, rows):
    facts = spark.createDataFrame([(*r, "clash", "clash") for r in rows], FACTS)
    trust = spark.createDataFrame([("p", 5), ("q", 9), (None, 99)], "parser string, trust int")
    return representative.unpivot_facts(facts, trust)


def test_preference_field_by_field(spark):
    rows = [
        (3, "r", "p", "sql_table:A.b", "n", "t", " x.PY ", 0, {"k": " "}, at(5)), (4, "r", "q", "sql_table:a.B", "n", "t", "x.txt", 7, {"k": "v"}, at(1)), (5, "r", "p", "sql_table:a.b", "n", "t", "y.sql", 8, {"k": "v", "l": "w"}, None),
        (6, "r", None, " sql_table:a.b", "n", "t", None, None, None, at(9)), (7, "r", "p", "sql_table:a.b", None, None, "z.yml", -1, {}, at(5)), (8, "s", "p", "sql_table:a.b", "n", "t", "x.py", 1, None, None), (9, None, "p", "x", "n", "t", "a.py", 1, None, None),
        (10, None, "p", "x", "n", "t", "b.py", 1, None, None), (11, "r", "p", None, "n", "t", "a.py", 1, None, None), (12, "u", "x", "y", "n", "t", None, None, {"k": None}, at(1)), (13, "u", "x", "y", "n", "t", "", 0, None, at(1)),
    ]
    won = winners(spark, rows).filter("members >= 2 and fact_id is not null").collect()
    assert {(r["group_id"], r["field"], r["fact_id"]) for r in won} == {(3, "file_path", 3), (3, "line_number", 4), (3, "metadata", 5), (9, "file_path", 9), (9, "line_number", 9)}
    golden = {r["group_id"]: r for r in representative.golden_records(winners(spark, rows)).collect()}
    assert (golden[3]["file_path"], golden[3]["line_number"], golden[3]["members"]) == ("x.PY", "7", 5) and golden[12]["metadata"] is None


def test_votes_sum_per_value(spark):
    rows = [(i, "r", p, "x", "n", "t", path, 1, None, at(d)) for i, (p, path, d) in enumerate([("q", "a.py", 1), ("p", "b.py", 1), ("p", " b.py", 1), ("p", "c.py", None), ("q", "d.txt", 1)])]
    won = {r["field"]: r for r in winners(spark, rows, "votes").collect()}
    assert (won["file_path"]["value"], won["file_path"]["members"], won["metadata"]["value"]) == ("b.py", 5, None)


def test_votes_are_summed_once(spark):
    # sums that differ between two evaluations, as floating-point sums in another order do, must not lose the winner
    rows = [(i, repo, "p", "x", "n", "t", f"{i % 3}.py", 1, None, at(1)) for repo in ("r", None) for i in range(9)]
    shaken = F.udf(lambda i: random.random(), "double")("fact_id")
    won = representative.winners(representative.tally(unpivoted(spark, rows).withColumn("trust", shaken)), "votes").collect()
    assert all((r["value"] is not None and r["fact_id"] is not None) == (r["field"] != "metadata") for r in won)
    assert sorted((r["repo"] or "", r["field"], r["members"]) for r in won) == [(r, f, 9) for r in ("", "r") for f in ("file_path", "line_number", "metadata")]


def test_no_facts(spark):
    assert winners(spark, []).collect() == [] and winners(spark, [], "votes").collect() == []


def test_votes_and_order_may_disagree(spark):
    rows = [(i, "r", p, "x", "n", "t", path, 1, None, at(1)) for i, (p, path) in enumerate([("q", "a.py"), ("p", "b.py"), ("p", "b.py")])]
    tallied = representative.tally(unpivoted(spark, rows))
    assert {tuple(r) for r in representative.disagreements(tallied).collect()} == {("file_path", 1, 1), ("line_number", 1, 0)}
    by = {m: {r["field"]: r for r in winners(spark, rows, m).collect()}["file_path"] for m in ("preference", "votes")}
    assert (by["preference"]["value"], by["preference"]["fact_id"], by["votes"]["value"], by["votes"]["fact_id"]) == ("a.py", 0, "b.py", 1)
