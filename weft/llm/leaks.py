"""Evaluation texts that leak into training text.

The normalised n-grams of all test items form a hash set that is built once on the driver and broadcast, in parts of
bounded size. Executors scan the token windows of every training text; a window that hits is verified word by word
against the item, so a hash collision reports nothing. Words no test item has cannot be part of a hit, so windows are
only hashed within runs of at least n words of the items' vocabulary; this skips nothing that could match.
"""

from __future__ import annotations

import re
from array import array
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.session import cut

#: Consecutive words that make a leak.
GRAM_WORDS = 12
#: Most words of test items in one broadcast set (about 120 bytes each in a worker); more are scanned in several passes.
BROADCAST_WORDS = 500_000

_WORD = re.compile(r"[^\W_]+")
_SPANS = pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32())]))


def words(text: str | None) -> list[str]:
    """Runs of letters and digits, lower-cased; everything else only separates them."""
    if not text:
        return []
    low = text.lower()
    return _WORD.findall(low) if len(low) == len(text) else [w.lower() for w in _WORD.findall(text)]


def cell_limits(cells: Column) -> Column:
    """The sorted places in a text where a cell begins or ends; null for null cells."""
    ends = F.flatten(F.transform(cells, lambda c: F.array(c["pos"], c["pos"] + c["len"])))
    return F.array_sort(F.array_distinct(F.filter(ends, lambda x: x > 0)))


def pieces(text: str, limits: list[int] | None) -> Iterator[tuple[int, str]]:
    """(start, piece) of a text cut at ``limits``, in one pass; limits outside the text are left out."""
    start = 0
    for limit in limits or ():
        if start < limit < len(text):
            yield start, text[start:limit]
            start = limit
    yield start, text[start:]


class GramSet:
    """The n-grams of test items: by the hash of a window of word numbers, the places in all items' words that have it."""

    def __init__(self, items: list[tuple[int, str | None]], n: int = GRAM_WORDS):
        self.n, self.numbers, self.items, self.starts = n, {}, [], []
        self.flat, self.places = array("q"), {}
        for item, text in items:
            ids = [self.numbers.setdefault(w, len(self.numbers)) for w in words(text)]
            start = len(self.flat)
            self.items.append(item)
            self.starts.append(start)
            self.flat.extend(ids)
            for at in range(len(ids) - n + 1):
                key, place = hash(tuple(ids[at : at + n])), start + at
                known = self.places.setdefault(key, place)
                if isinstance(known, list):
                    known.append(place)
                elif known != place:
                    self.places[key] = [known, place]
            self.flat.append(-1)  # no window runs from one item into the next

    def hits(self, text: str | None, limits: list[int] | None = None) -> Iterator[tuple[int, int, int]]:
        """(item, first word, last word + 1) of each window of ``text`` that an item has; no word runs across a limit."""
        n, numbers = self.n, self.numbers
        if not text or not numbers:
            return
        ids = list(map(numbers.get, words("\n".join(p for _, p in pieces(text, limits)) if limits else text)))
        at = n - 1
        while at < len(ids):  # a window needs n known words: look at every n-th word and its run only
            if ids[at] is None:
                at += n
                continue
            low = at
            while low and ids[low - 1] is not None:
                low -= 1
            high = at + 1
            while high < len(ids) and ids[high] is not None:
                high += 1
            for start in range(low, high - n + 1):
                window = ids[start : start + n]
                places = self.places.get(hash(tuple(window)), ())
                seen = set()
                for place in (places,) if isinstance(places, int) else places:
                    item = self.items[bisect_right(self.starts, place) - 1]
                    if item not in seen and self.flat[place : place + n].tolist() == window:
                        seen.add(item)
                        yield item, start, start + n
            at = high + n

    def spans(self, text: str | None, limits: list[int] | None = None) -> dict[int, list[list[int]]]:
        """By item, the merged spans [first word, last word + 1) of ``text`` that it has."""
        found: dict[int, list[list[int]]] = {}
        for item, start, end in self.hits(text, limits):
            own = found.setdefault(item, [])
            if own and start <= own[-1][1]:
                own[-1][1] = max(end, own[-1][1])
            else:
                own.append([start, end])
        return found


def _parts(items: DataFrame, item_id: str, text: str, most: int) -> Iterator[list[tuple[int, str | None]]]:
    """The test items in lists of at most ``most`` words each; every list holds at least one item."""
    part, size = [], 0
    for row in items.select(item_id, text).filter(F.col(text).isNotNull() & F.col(item_id).isNotNull()).toLocalIterator():
        n = len(words(row[1]))
        if part and size + n > most:
            yield part
            part, size = [], 0
        part.append((row[0], row[1]))
        size += n
    yield part


def _sets(items: DataFrame, item_id: str, text: str, n: int, most: int) -> Iterator[tuple[Broadcast, bool]]:
    """Broadcast sets and whether more follow; one at a time is in memory, as each but the last is destroyed after use."""
    parts = _parts(items, item_id, text, most)
    part = next(parts)
    while part is not None:
        following = next(parts, None)
        shared = items.sparkSession.sparkContext.broadcast(GramSet(part, n))
        yield shared, following is not None
        if following is not None:
            shared.destroy()
        part = following


def _corpus(documents: DataFrame, doc_id: str, text: str, cells: str | None) -> DataFrame:
    limits = cell_limits(F.col(cells)) if cells else F.lit(None).cast("array<bigint>")
    return documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), limits.alias("limits"))


def leaked_windows(
    documents: DataFrame, items: DataFrame, *, doc_id: str = "doc_id", text: str = "text", cells: str | None = None, item_id: str = "item_id",
    item_text: str = "text", n: int = GRAM_WORDS, most: int = BROADCAST_WORDS,
) -> DataFrame:
    """(doc_id, item_id, spans): per document and item the merged word spans [first, end) that the item also has.

    ``cells`` names the column of cells whose limits separate words, if there is one. Null and empty texts share nothing;
    a repeated item counts once under its id; items shorter than n words cannot leak. Evaluation sets of more than
    ``most`` words are scanned in several passes over the corpus, whose hits are written before the next set is sent.
    No items or documents give an empty result.
    """
    corpus, found = _corpus(documents, doc_id, text, cells), None
    for shared, more in _sets(items, item_id, item_text, n, most):

        def scan(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            grams = shared.value
            for batch in batches:
                docs, ids, spans = [], [], []
                for doc, body, limits in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                    for item, own in grams.spans(body.as_py(), limits.as_py()).items():
                        docs.append(doc)
                        ids.append(item)
                        spans.append([{"first": a, "end": b} for a, b in own])
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(ids, pa.int64()), pa.array(spans, _SPANS)], names=["doc_id", "item_id", "spans"])

        hits = corpus.mapInArrow(scan, "doc_id long, item_id long, spans array<struct<first:int,end:int>>")
        hits = cut(hits) if more else hits
        found = hits if found is None else found.unionByName(hits)
    return found


def without_spans(text: str, limits: list[int] | None, spans: list[tuple[int, int]]) -> tuple[str, int]:
    """``text`` without the words in the spans [first, end), nor what stands between the words of a span, and how many
    words are gone. ``limits`` only separate words: the rest of the text stays as it is."""
    places = [(start + m.start(), start + m.end()) for start, piece in pieces(text, limits) for m in _WORD.finditer(piece)]
    out, at, done, removed = [], 0, 0, 0
    for first, end in sorted(spans):
        start, stop = places[first][0], places[end - 1][1]
        removed += max(0, end - max(first, done))
        done = max(done, end)
        if stop > at:
            out.append(text[at : max(at, start)])
            at = stop
    return "".join([*out, text[at:]]), removed


def remove_leaks(
    documents: DataFrame, items: DataFrame, *, doc_id: str = "doc_id", text: str = "text", cells: str | None = None, item_id: str = "item_id",
    item_text: str = "text", n: int = GRAM_WORDS, most: int = BROADCAST_WORDS,
) -> DataFrame:
    """(doc_id, text, removed_words): every document, without the spans that leaked; see ``leaked_windows``.

    Spans are found and cut out in one pass over the corpus. Documents without a leak stay as they are, also null ones;
    rows are cleaned one by one, whatever their ``doc_id``. Where the items need several sets, spans are carried from
    pass to pass and the texts are cut after the last, so that a cut joins no words into a window.
    """
    carried = "array<struct<first:int,end:int>>"
    state = _corpus(documents, doc_id, text, cells).withColumn("spans", F.lit(None).cast(carried))
    for shared, more in _sets(items, item_id, item_text, n, most):

        def scan(batches: Iterator[pa.RecordBatch], shared=shared, more=more) -> Iterator[pa.RecordBatch]:
            grams = shared.value
            for batch in batches:
                docs, bodies, limits, known = (batch.column(i) for i in range(4))
                found, texts, removed = [], [], []
                for body, limit, own in zip(bodies, limits, known.to_pylist()):
                    body, limit = body.as_py(), limit.as_py()
                    spans = {(s["first"], s["end"]) for s in own or ()} | {tuple(s) for v in grams.spans(body, limit).values() for s in v}
                    if more:
                        found.append([{"first": a, "end": b} for a, b in sorted(spans)])
                    else:
                        cleaned, gone = without_spans(body, limit, list(spans)) if spans else (body, 0)
                        texts.append(cleaned)
                        removed.append(gone)
                if more:
                    yield pa.RecordBatch.from_arrays([docs, bodies, limits, pa.array(found, _SPANS)], names=["doc_id", "text", "limits", "spans"])
                else:
                    yield pa.RecordBatch.from_arrays([docs, pa.array(texts, pa.string()), pa.array(removed, pa.int64())], names=["doc_id", "text", "removed_words"])

        state = state.mapInArrow(scan, f"doc_id long, text string, limits array<bigint>, spans {carried}" if more else "doc_id long, text string, removed_words long")
        state = cut(state) if more else state
    return state
