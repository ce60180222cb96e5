"""The reading level of each document's prose.

Syntax and vocabulary features of the prose are scored by a linear ranker, learned from graded pairs of documents: of
a pair the one with the higher grade should score higher. Grades are the caller's, or else school years by the public
Automated Readability Index; its two averages are not among the features. Isotonic regression calibrates scores into
grades, and grades are cut into levels. Everything per document runs in the JVM; the model is fitted on a bounded
sample on the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Documents that the ranker and the calibration are fitted on at most; the ones with the smallest hashes.
SAMPLE_DOCUMENTS = 2000
#: Graded pairs that are drawn from the sample.
SAMPLE_PAIRS = 20_000
#: Of the sample, every so many documents are kept out of the fit, to measure how well their pairs are ranked.
HELD_OUT_EVERY = 5
#: Pairs whose grades differ less are not compared.
PAIR_MARGIN = 0.5
#: School years at which levels 2 to 5 begin.
LEVEL_GRADES = (6.0, 9.0, 12.0, 15.0)
LEVELS = len(LEVEL_GRADES) + 1
#: Demanding prose has at least so many words a sentence, and letters a word as a fraction.
DEMANDING_WORDS, DEMANDING_LETTERS = 20, (51, 10)
#: Words of a sentence after so many are deep in it; letters of a word likewise.
DEEP_WORDS, DEEP_LETTERS = 10, 4
#: Texts are cut into blocks of so many characters before cells are taken out of them.
BLOCK = 1 << 16

FEATURES = ("deep_words", "deep_letters", "long_words", "rare_words", "marks")


def prose(text: Column, cells: Column) -> Column:
    """The lines of text cells whose first character is a letter, joined by line feeds; empty if there are none.

    Cells are taken from blocks of the text, so that a cell far into a long text does not pass over all before it.
    """
    shown = F.filter(cells, lambda c: (c["kind"] == "text") & (c["pos"] >= 0) & (c["len"] > 0))
    number = lambda x: F.floor(x / BLOCK).cast("int")
    size = F.length(text).cast("long")
    blocks = F.transform(F.sequence(F.lit(0), number(size)), lambda i: F.substring(text, i * BLOCK + 1, F.lit(BLOCK)))

    def body(c: Column, blocks: Column) -> Column:
        first, last = number(c["pos"]), number(F.least(c["pos"] + c["len"], size))
        own = F.array_join(F.slice(blocks, first + 1, F.greatest(last - first + 1, F.lit(0))), "")
        return F.substring(own, (c["pos"] - first.cast("long") * BLOCK + 1).cast("int"), F.least(c["len"], size).cast("int"))

    short = F.transform(shown, lambda c: F.substring(text, (c["pos"] + 1).cast("int"), F.least(c["len"], size).cast("int")))
    # one array of blocks is bound to a name, so that it is made once and not for each cell
    long = F.flatten(F.transform(F.array(blocks), lambda b: F.transform(shown, lambda c: body(c, b))))
    bodies = F.when(size < BLOCK, short).otherwise(long)
    lines = F.split(F.array_join(bodies, "\n"), "\r\n|\r|\n", -1)
    return F.coalesce(F.array_join(F.filter(lines, lambda x: x.rlike(r"^\p{L}")), "\n"), F.lit(""))


def prose_features(documents: DataFrame, *, doc_id: str = "doc_id", extra: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, words, letters, sentences, ``FEATURES`` and the ``extra`` columns), one row a document.

    Null texts and cells, and documents without prose, have 0 words and null features. All features lie in [0, 1].
    A sentence ends at ``.``, ``!`` or ``?`` before white space of any kind, and at the line's end.
    """
    shown = documents.select(F.col(doc_id).alias("doc_id"), *extra, prose(F.col("text"), F.col("cells")).alias("prose"))
    lengths = F.filter(F.transform(F.split("prose", r"(?U)[.!?](?=\s)|\n", -1), lambda s: F.regexp_count(s, F.lit(r"\p{L}+"))), lambda n: n > 0)
    counts = {
        "lengths": lengths,
        "letters": F.length(F.regexp_replace("prose", r"\P{L}+", "")).cast("long"),
        "tails": F.length(F.regexp_replace("prose", rf"\p{{L}}{{1,{DEEP_LETTERS}}}(\p{{L}}*)|\P{{L}}+", "$1")),
        "long": F.regexp_count("prose", F.lit(r"\p{L}{7,}")),
        "rare": F.regexp_count("prose", F.lit(r"\p{L}{11,}")),
        "points": F.regexp_count("prose", F.lit(r"[,;:]")),
    }
    # a generator keeps later filters from being pushed below the counts and evaluating them again
    counted = shown.select("doc_id", *extra, F.inline(F.array(F.struct(*(c.alias(n) for n, c in counts.items())))))
    total = lambda f: F.aggregate("lengths", F.lit(0).cast("long"), lambda a, n: a + f(n))
    counted = counted.select(
        "*", total(lambda n: n).alias("words"), F.size("lengths").cast("long").alias("sentences"),
        total(lambda n: F.greatest(n - DEEP_WORDS, F.lit(0))).alias("deep"),
    )
    per_word = lambda c: F.least(F.try_divide(F.col(c), F.col("words")), F.lit(1.0))
    return counted.select(
        "doc_id", *extra, "words", "letters", "sentences", per_word("deep").alias("deep_words"), F.try_divide("tails", "letters").alias("deep_letters"),
        per_word("long").alias("long_words"), per_word("rare").alias("rare_words"), per_word("points").alias("marks"),
    )


def school_years() -> Column:
    """The Automated Readability Index of counted prose: a school year from letters a word and words a sentence."""
    # the index's constants; fixed values
    return 4.71 * F.try_divide("letters", "words") + 0.5 * F.try_divide("words", "sentences") - 21.43


def isotonic(scores: np.ndarray, grades: np.ndarray) -> tuple[list[float], list[float]]:
    """Lowest score and mean grade of the blocks that pooling adjacent violators leaves."""
    order = np.argsort(scores, kind="stable")
    blocks: list[list[float]] = []  # lowest score, sum, count
    for s, g in zip(scores[order], grades[order]):
        if blocks and blocks[-1][0] == s:
            blocks[-1][1] += g
            blocks[-1][2] += 1
        else:
            blocks.append([float(s), float(g), 1])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            _, total, n = blocks.pop()
            blocks[-1][1] += total
            blocks[-1][2] += n
    return [b[0] for b in blocks], [b[1] / b[2] for b in blocks]


@dataclass
class ReadingModel:
    """Weights of the features, none below 0, the calibration as rising steps, and the share of held-out pairs ranked right."""

    weights: list[float]
    lows: list[float]
    grades: list[float]
    held_out: float | None = None

    def score(self) -> Column:
        total = F.lit(0.0)
        for w, f in zip(self.weights, FEATURES):
            total = total + F.lit(float(w)) * F.col(f)
        return total

    def grade(self, score: Column) -> Column:
        """The calibrated grade; a score below all seen ones has the lowest grade."""
        lows, grades = F.lit(self.lows), F.lit(self.grades)
        return F.element_at(grades, F.greatest(F.lit(1), F.size(F.filter(lows, lambda x: x <= score))))

    def least_score(self, held: dict[str, float]) -> float:
        """No document whose features in ``held`` are at least as given scores less: features and weights are not below 0."""
        return sum(w * held.get(f, 0.0) for w, f in zip(self.weights, FEATURES))


def sample_documents(documents: DataFrame, sample: int, seed: int) -> DataFrame:
    """About three times ``sample`` documents, chosen by hash, so that each task passes on its share only."""
    total = documents.count()
    share = min(1.0, 3.0 * sample / max(1, total))
    place = F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id")), F.lit(1 << 40))
    return documents.filter(place < int(share * (1 << 40)) + 1)


def _pairs(rng: np.random.Generator, x: np.ndarray, graded: np.ndarray, pairs: int) -> np.ndarray:
    """Feature differences, harder minus easier, of random pairs whose grades differ enough."""
    if len(x) < 2:
        return np.zeros((0, x.shape[1]))
    a, b = rng.integers(0, len(x), pairs), rng.integers(0, len(x), pairs)
    apart = np.abs(graded[a] - graded[b]) >= PAIR_MARGIN
    sign = np.where(graded[a] > graded[b], 1.0, -1.0)[:, None]
    return (sign * (x[a] - x[b]))[apart]


def fit(documents: DataFrame, *, sample: int = SAMPLE_DOCUMENTS, pairs: int = SAMPLE_PAIRS, seed: int = 11, doc_id: str = "doc_id", grade: str | None = None) -> ReadingModel:
    """A model fitted on at most ``sample`` documents with prose; without two of them, all weights and grades are 0.

    ``grade`` names a column with grades of the documents, null where there is none; by default they are school years.
    """
    own = documents.select(F.col(doc_id).alias("doc_id"), "text", "cells", (F.col(grade).cast("double") if grade else F.lit(None).cast("double")).alias("_grade"))
    chosen = prose_features(sample_documents(own, sample, seed), extra=("_grade",)).filter("words > 0")
    graded = chosen if grade else chosen.withColumn("_grade", school_years())
    graded = graded.filter("_grade is not null")
    rows = graded.orderBy(F.xxhash64(F.lit(seed), F.col("doc_id")), "doc_id").limit(sample).select("_grade", *FEATURES).collect()
    if len(rows) < 2:
        return ReadingModel([0.0] * len(FEATURES), [0.0], [0.0])
    raw = np.array([tuple(r) for r in rows], dtype=float)
    y, x = raw[:, 0], raw[:, 1:]
    rng, kept = np.random.default_rng(seed), np.arange(len(x)) % HELD_OUT_EVERY != HELD_OUT_EVERY - 1
    diff = _pairs(rng, x[kept], y[kept], pairs)
    scale = np.maximum(x[kept].std(axis=0), 1e-9)
    w = np.zeros(x.shape[1])
    for _ in range(400):  # logistic loss on scaled pair differences with a small ridge; weights stay at 0 or above
        p = 1.0 / (1.0 + np.exp(np.clip(diff / scale @ w, -30, 30))) if len(diff) else np.zeros(0)
        w = np.maximum(0.0, w + 1.0 * ((diff / scale).T @ p / max(1, len(diff)) - 1e-3 * w))
    w = np.where(x[kept].std(axis=0) > 1e-9, w / scale, 0.0)
    unseen = _pairs(rng, x[~kept], y[~kept], pairs // HELD_OUT_EVERY)
    lows, grades = isotonic(x[kept] @ w, y[kept])
    return ReadingModel([float(v) for v in w], lows, grades, float((unseen @ w > 0).mean()) if len(unseen) else None)


def reading_levels(features: DataFrame, model: ReadingModel) -> DataFrame:
    """(doc_id, level, grade, score, words, sentences, letters): level 1 to ``LEVELS``, 0 for documents without prose."""
    scored = features.withColumn("score", model.score())
    scored = scored.withColumn("grade", F.when(F.col("words") > 0, model.grade(F.col("score"))))
    level = F.lit(1)
    for begin in LEVEL_GRADES:
        level = level + (F.col("grade") >= begin).cast("int")
    return scored.select("doc_id", F.coalesce(level, F.lit(0)).alias("level"), "grade", "score", "words", "sentences", "letters")


def candidates(features: DataFrame, model: ReadingModel) -> DataFrame:
    """The documents that the model ranks high enough to be demanding, with their score.

    Of at least 20 words a sentence at least half stand after the tenth of their sentence, as no sentence has more than
    ten others; of at least 5.1 letters a word likewise 1 - 4 / 5.1. As no weight or feature is below 0, no demanding
    document scores less than the weights of these two give, so the cut loses none, whatever the model.
    """
    letters, per = DEMANDING_LETTERS
    held = {"deep_words": 1 - DEEP_WORDS / DEMANDING_WORDS, "deep_letters": 1 - DEEP_LETTERS * per / letters}
    return features.withColumn("score", model.score()).filter((F.col("words") > 0) & (F.col("score") >= model.least_score(held) - 1e-9))


def demanding(features: DataFrame, model: ReadingModel) -> DataFrame:
    """(doc_id): demanding documents, chosen by the ranker (see ``candidates``) and then verified in whole numbers."""
    letters, per = DEMANDING_LETTERS
    exact = (F.col("words") >= DEMANDING_WORDS * F.col("sentences")) & (F.col("letters") * per >= F.col("words") * letters)
    return candidates(features, model).filter(exact).select("doc_id")
