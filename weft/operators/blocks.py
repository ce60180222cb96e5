"""Graphs as blocks of numbers, for layers, components and places of graphs with many links.

A node is numbered by the 64-bit hash of its id: hash modulo the number of blocks is its block, its place in the order of
the block's hashes the rest. Links are pairs of such numbers in arrays. A step sends arrays to the block they are about,
where they meet the block's own arrays (``kind`` orders them), so a shuffle moves some bytes a link and no rows. Tasks hold
the arrays of one block, which has at most about ``BLOCK`` nodes, and of its links only the distinct ones that end there
while repeats are dropped. Results of steps are Parquet files in the checkpoint folder.

Hashes of nodes are checked to differ; other salts are tried where they don't. An end of a link that is no node is taken
for one only where 64 bits agree by chance.
"""

from __future__ import annotations

import gc
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.functions.ids import LAYERS, layer_of
from weft.session import checkpoint_dir

ROWS = "block int, kind int, data binary"
#: Nodes a block, links that a task gathers before it sends them, rows up to which places are found in one task.
BLOCK, GATHER, ONE_SORT = 1 << 17, 1 << 21, 1 << 18
#: Links from which the files of shuffles are given back after every step; layers up to which links lie in a folder each.
LARGE, FOLDERS = 5_000_000, 64
I4, I8, F8 = np.dtype("i4"), np.dtype("i8"), np.dtype("f8")
_SHAPE = pa.schema([("block", pa.int32()), ("kind", pa.int32()), ("data", pa.binary())])


def _pack(*columns: np.ndarray) -> bytes:
    return b"".join(c.tobytes() for c in columns)


def _unpack(data, *types: np.dtype) -> list[np.ndarray]:
    n, at, out = len(data) // sum(t.itemsize for t in types), 0, []
    for t in types:
        out.append(np.frombuffer(data, t, n, at))
        at += n * t.itemsize
    return out


def _rows(batches) -> Iterator[tuple[int, int, memoryview]]:
    for batch in batches:
        blocks, kinds, data = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)
        for i, (block, kind) in enumerate(zip(blocks, kinds)):
            yield block, kind, memoryview(data[i].as_buffer())


def _batch(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_SHAPE)], schema=_SHAPE)


def _by_block(batches) -> Iterator[tuple[int, Iterator[tuple[int, memoryview]]]]:
    """Each block with its (kind, data) in turn; rows lie together by block."""
    rows = _rows(batches)
    head = next(rows, None)
    while head is not None:
        block = head[0]

        def own():
            nonlocal head
            while head is not None and head[0] == block:
                now = head
                head = next(rows, None)
                yield now[1], now[2]

        mine = own()
        yield block, mine
        for _ in mine:
            pass


class _Sender:
    """Gathers columns and gives one row for each destination (block, kind) when there are enough."""

    def __init__(self):
        self.parts, self.size = [], 0

    def add(self, block: np.ndarray, kind: np.ndarray | int, *columns: np.ndarray) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(block), GATHER):
            cut = slice(i, i + GATHER)
            self.parts.append((block[cut].astype(I4), np.broadcast_to(np.asarray(kind, I4), block.shape)[cut], *(c[cut] for c in columns)))
            self.size += len(self.parts[-1][0])
            if self.size >= GATHER:
                yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.size:
            return
        block, kind, *columns = (np.concatenate(c) for c in zip(*self.parts))
        self.parts, self.size = [], 0
        order = np.argsort(block.astype(np.uint16) if block.max() < 1 << 16 else block, kind="stable")
        if kind.min() != kind.max():
            order = order[np.argsort(kind[order], kind="stable")]
        block, kind, columns = block[order], kind[order], [c[order] for c in columns]
        starts = np.flatnonzero(np.r_[True, (block[1:] != block[:-1]) | (kind[1:] != kind[:-1])])
        ends = np.r_[starts[1:], len(block)]
        for i in range(0, len(starts), 256):
            yield _batch([(int(block[s]), int(kind[s]), _pack(*(c[s:e] for c in columns))) for s, e in zip(starts[i : i + 256], ends[i : i + 256])])


class Blocks:
    """``ids`` (id) and the distinct links between them of ``edges`` (source, target), in blocks."""

    def __init__(self, ids: DataFrame, edges: DataFrame):
        self.spark: SparkSession = ids.sparkSession
        self.large = True
        named = F.lower("id").rlike("|".join(LAYERS))  # few ids are, and only they are taken apart
        tie = F.coalesce(F.when(named, F.array_position(F.array(*(F.lit(x) for x in LAYERS)), layer_of(F.col("id")))), F.lit(len(LAYERS) + 1))
        names = ids.select("id").filter("id is not null").distinct().select("id", tie.alias("tie"))
        #: (id, r): r numbers the nodes in the order of ties, which goes by bronze, silver, gold and the rest, then by id.
        self.names, total = self.numbered(names, "r", "tie", "id")
        self.names = self.names.select("id", "r")
        self.count = total
        partitions = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        self.blocks = max(1, -(-total // BLOCK), min(partitions, total // 2000))
        for salt in range(8):
            self.salt = salt
            self.units = self.stored(self._meet(self.names.select(self._hash("id").alias("h"), "r").mapInArrow(self._split_hashes((I8, I4)), ROWS), _units))
            if not self.units.filter("kind > 0").limit(1).count():
                break
        else:
            raise ValueError("hashes of ids agree under every salt")
        self.units = self.units.select("block", F.lit(0).alias("kind"), "data")
        self._link(edges)

    def _hash(self, column: str):
        return F.xxhash64(column) if not self.salt else F.xxhash64(F.lit(self.salt), F.col(column))

    def numbered(self, df: DataFrame, name: str, *order: str) -> tuple[DataFrame, int]:
        """``df`` with a running number ``name`` in ``order``, and the number of its rows."""
        part, k = F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("k")
        ranged, shift, total = self.stored(df.sort(*order).select("*", part, k)), [], 0
        for at, first, n in sorted(map(tuple, ranged.groupBy("part").agg(F.min("k"), F.count(F.lit(1))).collect())):
            shift.append((at, total - first))
            total += n
        if total >= 1 << 31:
            raise ValueError("more rows than 32 bits can number")
        offsets = self.spark.createDataFrame(shift, "part int, shift long")
        return ranged.join(F.broadcast(offsets), "part").select(*df.columns, (F.col("k") + F.col("shift")).cast("int").alias(name)), total

    def stored(self, df: DataFrame, folders: bool = False) -> DataFrame:
        """``df`` written to the checkpoint folder and read back."""
        path = f"{checkpoint_dir(self.spark)}/blocks-{uuid.uuid4().hex}"
        writer = df.write.option("compression", "zstd")
        (writer.partitionBy("kind") if folders else writer).parquet(path)
        kept = self.spark.read.schema(df.schema).parquet(path)
        kept.stored_at = path
        if self.large:  # files of shuffles go when the driver collects its garbage
            del df, writer
            gc.collect()
            self.spark.sparkContext._jvm.System.gc()
        return kept

    def drop(self, df: DataFrame) -> None:
        """Removes the files of ``stored``."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(df.stored_at)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def _meet(self, rows: DataFrame, step, blocks: int | None = None) -> DataFrame:
        """``step`` over the rows of each block, in the order of kinds."""
        return rows.repartitionById(blocks or self.blocks, F.col("block")).sortWithinPartitions("block", "kind").mapInArrow(step, ROWS)

    def _split_hashes(self, types):
        blocks = self.blocks

        def split(batches):
            sender = _Sender()
            for batch in batches:
                columns = [c.to_numpy(zero_copy_only=False).astype(t, copy=False) for c, t in zip(batch.columns, types)]
                yield from sender.add(columns[0] % blocks, 1, *columns)
            yield from sender.flush()

        return split

    def _link(self, edges: DataFrame) -> None:
        blocks = self.blocks
        ends = edges.filter("source is not null and target is not null").select(self._hash("source").alias("a"), self._hash("target").alias("b"))

        def first(batches):
            sender = _Sender()
            for block, rows in _by_block(batches):
                own = np.zeros(0, I8)
                for kind, data in rows:
                    if kind == 0 or not len(own):
                        own = _unpack(data, I8, I4)[0] if kind == 0 else own
                        continue
                    a, b = _unpack(data, I8, I8)
                    at = np.minimum(np.searchsorted(own, a), len(own) - 1)
                    good = own[at] == a
                    yield from sender.add(b[good] % blocks, 1, b[good], (at[good] * blocks + block).astype(I4))
            yield from sender.flush()

        def second(batches):
            for block, rows in _by_block(batches):
                own, pairs = np.zeros(0, I8), []
                for kind, data in rows:
                    if kind == 0 or not len(own):
                        own = _unpack(data, I8, I4)[0] if kind == 0 else own
                        continue
                    b, a = _unpack(data, I8, I4)
                    at = np.minimum(np.searchsorted(own, b), len(own) - 1)
                    good = own[at] == b
                    pairs.append(at[good].astype(I8) << 32 | a[good])
                if not pairs:
                    continue
                pairs = np.sort(np.concatenate(pairs))
                pairs = np.r_[pairs[:1], pairs[1:][pairs[1:] != pairs[:-1]]]
                for i in range(0, len(pairs), GATHER):
                    b, a = (pairs[i : i + GATHER] >> 32).astype(I4), (pairs[i : i + GATHER] & 0xFFFFFFFF).astype(I4)
                    loops = int(np.count_nonzero(a == b * blocks + block))
                    yield _batch([(block, loops, _pack(b, a))])

        def turn(batches):
            sender = _Sender()
            for block, _, data in _rows(batches):
                b, a = _unpack(data, I4, I4)
                yield from sender.add(a % blocks, 2, a // blocks, b * blocks + block)
            yield from sender.flush()

        if not self.count:
            ends = ends.limit(0)
        sent = ends.mapInArrow(self._split_hashes((I8, I8)), ROWS)
        known = self._meet(self.units.unionByName(sent), first)
        into = self.stored(self._meet(self.units.unionByName(known), second))
        self.loops, self.links = into.agg(F.coalesce(F.sum("kind"), F.lit(0)), F.coalesce(F.sum(F.octet_length("data")), F.lit(0))).first()
        self.links //= 8
        self.large = self.links >= LARGE
        #: By the block of their second end, and of their first: place in the block, number of the other end.
        self.into = into.select("block", F.lit(2).alias("kind"), "data")
        self.out = self.stored(into.mapInArrow(turn, ROWS))

    def layers(self) -> DataFrame | None:
        """Rows with the longest distance of each node from a root; None where there are cycles of several nodes."""
        blocks = self.blocks

        def begin(batches):
            for block, rows in _by_block(batches):
                waiting = np.zeros(0, I4)
                for kind, data in rows:
                    if kind == 0:
                        waiting = np.zeros(len(data) // 12, I4)
                        continue
                    b, a = _unpack(data, I4, I4)
                    waiting += np.bincount(b[a != b * blocks + block], minlength=len(waiting)).astype(I4)
                yield _batch([(block, int(np.count_nonzero(waiting == 0)), _pack(np.where(waiting == 0, 0, -1).astype(I4), waiting))])

        def push(depth):
            def step(batches):
                sender = _Sender()
                for block, rows in _by_block(batches):
                    for kind, data in rows:
                        if kind == 0:
                            new = _unpack(data, I4, I4)[0] == depth
                        elif new.any():
                            a, b = _unpack(data, I4, I4)
                            b = b[new[a] & (b != a * blocks + block)]
                            yield from sender.add(b % blocks, 1, b // blocks)
                yield from sender.flush()

            return step

        def take(depth):
            def step(batches):
                for block, rows in _by_block(batches):
                    for kind, data in rows:
                        if kind == 0:
                            layer, waiting = (x.copy() for x in _unpack(data, I4, I4))
                            continue
                        waiting -= np.bincount(_unpack(data, I4)[0], minlength=len(waiting)).astype(I4)
                    new = (layer < 0) & (waiting == 0)
                    layer[new] = depth + 1
                    yield _batch([(block, int(np.count_nonzero(new)), _pack(layer, waiting))])

            return step

        state, depth, done = self.stored(self._meet(self.units.unionByName(self.into), begin)), 0, 0
        while True:
            ready = state.agg(F.coalesce(F.sum("kind"), F.lit(0))).first()[0]
            done += ready
            if not ready or done == self.count:
                return state.select("block", F.lit(0).alias("kind"), "data").mapInArrow(_first_of_two, ROWS) if done == self.count else None
            own, before = state.select("block", F.lit(0).alias("kind"), "data"), state
            sent = self._meet(own.unionByName(self.out), push(depth))
            state = self.stored(self._meet(own.unionByName(sent), take(depth)))
            self.drop(before)
            depth += 1

    def components(self, small, rounds: int = 24) -> DataFrame | None:
        """Rows with the number of one node of the weakly connected component of each node.

        What the node with most links reaches in either direction is taken from it, each link being followed once from
        both ends; ``small`` (nodes (id), links (source, target)), which is ``traverse.components``, gets the rest. None
        where that walk is not over after ``rounds``, as on long chains.
        """
        blocks = self.blocks

        def degrees(batches):
            for block, rows in _by_block(batches):
                for kind, data in rows:
                    if kind == 0:
                        degree = np.zeros(len(data) // 12, I8)
                        continue
                    degree += np.bincount(_unpack(data, I4, I4)[0], minlength=len(degree))
                yield _batch([(block, int(degree.argmax()), _pack(np.array([degree.max()], I8)))])

        def begin(hub):
            def step(batches):
                for block, _, data in _rows(batches):
                    seen = np.full(len(data) // 12, -1, I4)
                    if block == hub[0]:
                        seen[hub[1]] = 0
                    yield _batch([(block, int(block == hub[0]), _pack(seen))])

            return step

        def push(depth):
            def step(batches):
                sender = _Sender()
                for _, rows in _by_block(batches):
                    for kind, data in rows:
                        if kind == 0:
                            new = np.frombuffer(data, I4) == depth
                        elif new.any():
                            x, other = _unpack(data, I4, I4)
                            other = other[new[x]]
                            yield from sender.add(other % blocks, 1, other // blocks)
                yield from sender.flush()

            return step

        def take(depth):
            def step(batches):
                for block, rows in _by_block(batches):
                    for kind, data in rows:
                        if kind == 0:
                            seen = np.frombuffer(data, I4).copy()
                            hit = np.zeros(len(seen), bool)
                            continue
                        hit[np.frombuffer(data, I4)] = True
                    new = hit & (seen < 0)
                    seen[new] = depth + 1
                    yield _batch([(block, int(np.count_nonzero(new)), _pack(seen))])

            return step

        def rest(batches):
            for block, rows in _by_block(batches):
                for kind, data in rows:
                    if kind == 0:
                        left = np.frombuffer(data, I4) < 0
                    elif left.any():
                        b, a = _unpack(data, I4, I4)
                        some = left[b] & (a != b * blocks + block)
                        yield pa.RecordBatch.from_arrays([pa.array(a[some]), pa.array(b[some] * blocks + block)], ["source", "target"])

        def label(number):
            def step(batches):
                for block, rows in _by_block(batches):
                    for kind, data in rows:
                        if kind == 0:
                            seen = np.frombuffer(data, I4)
                            code = np.where(seen < 0, np.arange(len(seen)) * blocks + block, number).astype(I4)
                            continue
                        g, c = _unpack(data, I4, I4)
                        code[g // blocks] = c
                    yield _batch([(block, 0, _pack(code))])

            return step

        links = self.into.unionByName(self.out)
        most = self._meet(self.units.unionByName(links), degrees).collect()
        if not most:
            return self.units
        hub = max((int(np.frombuffer(r["data"], I8)[0]), -r["block"], r["kind"]) for r in most)
        hub = (-hub[1], hub[2])
        state, depth = self.stored(self.units.mapInArrow(begin(hub), ROWS)), 0
        while state.agg(F.sum("kind")).first()[0]:
            if depth == rounds:
                return None
            own, before = state.select("block", F.lit(0).alias("kind"), "data"), state
            sent = self._meet(own.unionByName(links), push(depth))
            state = self.stored(self._meet(own.unionByName(sent), take(depth)))
            self.drop(before)
            depth += 1
        own = state.select("block", F.lit(0).alias("kind"), "data")
        left = own.unionByName(self.into).repartitionById(self.blocks, F.col("block")).sortWithinPartitions("block", "kind")
        left = self.stored(left.mapInArrow(rest, "source int, target int"))
        rows = own
        if left.limit(1).count():
            ends = left.select(F.explode(F.array("source", "target")).alias("id")).distinct()
            found = small(ends, left).select("id", "component")
            rows = rows.unionByName(found.mapInArrow(self._split_hashes((I4, I4)), ROWS))
        return self.stored(self._meet(rows, label(hub[1] * blocks + hub[0])))

    def labelled(self, placed: DataFrame) -> DataFrame:
        """Rows with the component (a number), as kind 0, and layer, as kind 1, of each node of ``placed`` (id, code, layer)."""

        def fill(batches):
            for block, rows in _by_block(batches):
                for kind, data in rows:
                    if kind == 0:
                        own = _unpack(data, I8, I4)[0]
                        code, layer = np.zeros(len(own), I4), np.zeros(len(own), I4)
                        continue
                    h, c, x = _unpack(data, I8, I4, I4)
                    at = np.searchsorted(own, h)
                    code[at], layer[at] = c, x
                yield _batch([(block, 0, _pack(code)), (block, 1, _pack(layer))])

        sent = placed.select(self._hash("id").alias("h"), F.col("code").cast("int"), F.col("layer").cast("int")).mapInArrow(self._split_hashes((I8, I4, I4)), ROWS)
        return self._meet(self.units.unionByName(sent), fill)

    def order(self, codes: DataFrame | None, layers: DataFrame, sweeps: int, strict: bool = False) -> DataFrame:
        """(r, code, layer, position) after barycentre sweeps, see ``traverse.column_order``.

        ``codes``, ``layers``: rows with a number a node; without ``codes`` there is one component, 0. ``strict``: every
        link but those of a node to itself leads to a higher layer. Then a layer whose nodes all have links, and on one
        side only, is not placed again straight after it has been: its neighbours have not moved.
        """
        blocks = self.blocks

        def facts(batches):
            for block, rows in _by_block(batches):
                code = None
                for kind, data in rows:
                    if kind == 0:
                        r = _unpack(data, I8, I4)[1]
                    elif kind == 1:
                        layer = np.frombuffer(data, I4)
                    else:
                        code = np.frombuffer(data, I4)
                yield _batch([(block, int(layer.max(initial=0)), _pack(r, np.zeros(len(r), I4) if code is None else code, layer))])

        parts = self.units.unionByName(layers.select("block", F.lit(1).alias("kind"), "data"))
        if codes is not None:
            parts = parts.unionByName(codes.select("block", F.lit(2).alias("kind"), "data"))
        made = self.stored(self._meet(parts, facts))
        last = made.agg(F.coalesce(F.max("kind"), F.lit(0))).first()[0]
        own = made.select("block", F.lit(0).alias("kind"), "data")

        def feed(batches):  # links to the block of the end that gives its place, by the layer of the end that takes it
            sender = _Sender()
            for block, rows in _by_block(batches):
                for kind, data in rows:
                    if kind == 0:
                        layer = _unpack(data, I4, I4, I4)[2]
                        linked = np.zeros(len(layer), bool)
                        continue
                    x, other = _unpack(data, I4, I4)
                    linked[x] = True
                    yield from sender.add(other % blocks, layer[x], other // blocks, x * blocks + block)
                yield _batch([(int(v), -1, _pack(np.array([t, k], I8))) for v, t, k in _shares(layer, linked)])
            yield from sender.flush()

        folders = last < FOLDERS
        feeds = [self.stored(self._meet(own.unionByName(side), feed), folders) for side in (self.into, self.out)]
        total, linked = {}, ({}, {})
        for side, rows in enumerate(feeds):
            for layer, data in rows.filter("kind = -1").select("block", "data").collect():
                t, k = np.frombuffer(data, I8)
                linked[side][layer] = linked[side].get(layer, 0) + int(k)
                if not side:
                    total[layer] = total.get(layer, 0) + int(t)
        strict = strict and not self.loops

        def chosen(layer):
            def step(batches):
                for block, rows in _by_block(batches):
                    sums = {}
                    for kind, data in rows:
                        if kind == 0:
                            r, code, at = _unpack(data, I4, I4, I4)
                        elif kind == 1:
                            position = np.frombuffer(data, I4)
                        else:
                            x, p = _unpack(data, I4, I4)
                            s = sums.setdefault(kind, [np.zeros(len(r)), np.zeros(len(r))])
                            s[0] += np.bincount(x, p, len(r))
                            s[1] += np.bincount(x, minlength=len(r))
                    take = np.flatnonzero(at == layer) if layer is not None else np.arange(len(r))
                    weight = np.zeros(len(r)) if layer is None else position.astype(F8)
                    for kind in sorted(sums, reverse=True):  # the side that counts comes last
                        some = sums[kind][1] > 0
                        weight[some] = sums[kind][0][some] / sums[kind][1][some]
                    group = code[take].astype(I8) * (last + 1) + at[take]
                    yield from _pieces(block, group, weight[take], r[take], (take * blocks + block).astype(I4))

            return step

        def push(layer):
            def step(batches):
                sender = _Sender()
                for _, rows in _by_block(batches):
                    for kind, data in rows:
                        if kind == 1:
                            position = np.frombuffer(data, I4)
                            continue
                        x, other = _unpack(data, I4, I4)
                        yield from sender.add(other % blocks, kind, other // blocks, position[x])
                yield from sender.flush()

            return step

        place, before = self._placed(self._meet(own, chosen(None)), self.count, own, None), None
        for sweep in range(sweeps if self.count else 0):
            forward = sweep % 2 == 0
            for layer in range(last + 1) if forward else range(last, -1, -1):
                n, ends = total.get(layer, 0), [linked[side].get(layer, 0) for side in (0, 1)]
                same = strict and before == layer and sorted(ends) == [0, n]
                before = layer
                if not n or same:
                    continue
                near = 0 if forward else 1
                sides = [(k, s) for k, s in ((2, near), (3, 1 - near)) if ends[s] and (k == 2 or ends[near] < n)]
                rows = own.unionByName(place.select("block", F.lit(1).alias("kind"), "data"))
                for kind, side in sides:
                    fed = feeds[side].filter(F.col("kind") == layer).select("block", F.lit(kind).alias("kind"), "data")
                    rows = rows.unionByName(self._meet(place.select("block", F.lit(1).alias("kind"), "data").unionByName(fed), push(layer)))
                old, place = place, self._placed(self._meet(rows, chosen(layer)), n, own, place)
                self.drop(old)
        for rows in feeds:
            self.drop(rows)

        def shown(batches):
            for _, rows in _by_block(batches):
                for kind, data in rows:
                    if kind == 0:
                        r, code, layer = _unpack(data, I4, I4, I4)
                    else:
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (r, code, layer, np.frombuffer(data, I4))], ["r", "code", "layer", "position"])

        both = own.unionByName(place.select("block", F.lit(1).alias("kind"), "data"))
        return both.repartitionById(self.blocks, F.col("block")).sortWithinPartitions("block", "kind").mapInArrow(shown, "r int, code int, layer int, position int")

    def _placed(self, weighed: DataFrame, rows: int, own: DataFrame, place: DataFrame | None) -> DataFrame:
        """Rows with the position of each node: ``weighed`` are numbered by weight and rank within their groups, the others
        keep their place. Many are sorted by ranges, between bounds from samples of every block."""
        blocks, many = self.blocks, rows > ONE_SORT
        types = (I8, F8, I4, I4)
        bounds, carry = None, {}
        if many:
            weighed = kept = self.stored(weighed)
            ranges = min(max(self.blocks, 2), -(-rows // (ONE_SORT // 2)))
            sample = np.sort(np.concatenate([_keys(*_unpack(d, I8, F8, I4)) for (d,) in kept.filter("kind = 1").select("data").toLocalIterator()]))
            bounds = sample[np.arange(1, ranges) * len(sample) // ranges]
        weighed = weighed.filter("kind = 0")

        def spread(batches):
            sender = _Sender()
            for _, _, data in _rows(batches):
                columns = _unpack(data, *types)
                to = np.searchsorted(bounds, _keys(*columns[:3]), "right") if bounds is not None else np.zeros(len(columns[0]), I4)
                yield from sender.add(to, 0, *columns)
            yield from sender.flush()

        def ranked(batches):
            for block, pieces in _by_block(batches):
                parts = [_unpack(d, *types) for _, d in pieces]
                group, weight, r, g = (np.concatenate(c) for c in zip(*parts))
                order = np.lexsort((r, weight, group)) if group.min() != group.max() else np.lexsort((r, weight))
                group, g = group[order], g[order]
                starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
                at = np.arange(len(group)) - np.repeat(starts, np.diff(np.r_[starts, len(group)]))
                if bounds is None:
                    yield from _parted(g, at, blocks)
                    continue
                firsts = int(starts[1]) if len(starts) > 1 else len(group)
                yield _batch([(block, 1, _pack(np.array([group[0], group[-1], firsts, at[-1] + 1, len(starts)], I8))), (block, 0, _pack(g, at.astype(I4)))])

        def carried(batches):
            for block, _, data in _rows(batches):
                g, at = _unpack(data, I4, I4)
                firsts, shift = carry[block]
                at = at.copy()
                at[:firsts] += shift
                yield from _parted(g, at, blocks)

        def settle(batches):
            for block, parts in _by_block(batches):
                for kind, data in parts:
                    if kind == 0:
                        position = np.zeros(len(data) // 12, I4)
                    elif kind == 1:
                        position = np.frombuffer(data, I4).copy()
                    else:
                        x, p = _unpack(data, I4, I4)
                        position[x] = p
                yield _batch([(block, 0, _pack(position))])

        sent = weighed.mapInArrow(spread, ROWS)
        if many:
            sorts = self.stored(self._meet(sent, ranked, len(bounds) + 1))
            self.drop(kept)
            group, so_far = None, 0
            for block, data in sorted(map(tuple, sorts.filter("kind = 1").select("block", "data").collect())):
                first, end, firsts, tail, groups = (int(x) for x in np.frombuffer(data, I8))
                shift = so_far if first == group else 0
                carry[block] = (firsts, shift)
                group, so_far = end, tail + (shift if groups == 1 else 0)
            found = sorts.filter("kind = 0").mapInArrow(carried, ROWS)
        else:
            found = self._meet(sent, ranked, 1)
        rows = own.unionByName(found)
        if place is not None:
            rows = rows.unionByName(place.select("block", F.lit(1).alias("kind"), "data"))
        done = self.stored(self._meet(rows, settle))
        if many:
            self.drop(sorts)
        return done


def _units(batches):
    """Hashes in order and ranks of each block; ``kind`` counts hashes that agree."""
    for block, rows in _by_block(batches):
        h, r = (np.concatenate(c) for c in zip(*(_unpack(d, I8, I4) for _, d in rows)))
        order = np.argsort(h)
        h, r = h[order], r[order]
        yield _batch([(block, int(np.count_nonzero(h[1:] == h[:-1])), _pack(h, r))])


def _first_of_two(batches):
    for block, kind, data in _rows(batches):
        yield _batch([(block, kind, _pack(_unpack(data, I4, I4)[0]))])


def _shares(layer: np.ndarray, linked: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """Each layer with its nodes and those that have links."""
    values, at = np.unique(layer, return_inverse=True)
    return zip(values, np.bincount(at, minlength=len(values)), np.bincount(at, linked, len(values)).astype(I8))


def _keys(group: np.ndarray, weight: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Bytes that sort as (group, weight, r), none of which is negative."""
    out = np.empty(len(group), np.dtype([("g", ">i8"), ("w", ">i8"), ("r", ">i4")]))
    out["g"], out["w"], out["r"] = group, np.asarray(weight, F8).view(I8), r
    return out.view("S20")


def _pieces(block: int, group: np.ndarray, weight: np.ndarray, r: np.ndarray, g: np.ndarray):
    """The rows to sort and, as kind 1, a sample of them."""
    if len(group):
        some = slice(None, None, 64)
        yield _batch([(block, 0, _pack(group, weight, r, g)), (block, 1, _pack(group[some], weight[some], r[some]))])


def _parted(g: np.ndarray, at: np.ndarray, blocks: int):
    sender = _Sender()
    yield from sender.add(g % blocks, 2, g // blocks, at.astype(I4))
    yield from sender.flush()
