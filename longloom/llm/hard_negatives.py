"""Hard negatives by an inverted multi-index over embeddings.

Vectors are scaled and floored to integers, so every score is an exact integer inner product.  For an
anchor, rows are ordered by score, highest first, ties by smaller id (a null id is the largest).  Its
positives are its first rows of the same label; a positive's negatives are the first rows of another
label whose score lies in the window ``low`` to ``high`` percent of the positive's score.

**Index.**  The dimensions are cut into two halves and each half space gets its own codebook (k-means
on at most ``CODEBOOK_ROWS`` rows: it decides speed, never results).  A row's two codewords name its
cell.  Rows are range-partitioned by cell and row hash, so a cell or a vector that holds a third of
all rows is spread over many shards, and packed into shards of at most ``SHARD_BYTES``.

**Search.**  Anchors are a stated query set, taken in blocks of about ``ANCHOR_BLOCK``; a block (a few
MB) travels to the shards, each shard answers with its own few best rows, and a ranked merge by anchor
keeps the first.  Inside a shard a codeword bounds the half score of its members by ``q.c + |q| r``,
with ``r`` the radius of its members there.  A multi-sequence heap visits cells by the sum of the two
half bounds, highest first.  It stops when the windows are certified: no unvisited cell can hold a row
that belongs to any of the lists that are being filled (ties included).  Lists are carried from shard
to shard of a task, so later shards stop earlier.  Positives come first, since their scores are the
windows of the second search.

Edge cases.  Rows with a null label, a null vector, or any null or non-finite component take no part,
nor do empty vectors, vectors of another length than most (the smaller length on a tie), and vectors
with a component too large for a 64-bit inner product.  A row with a null id is no anchor.  Repeated
rows are rows of their own: the twin of an anchor is another row, and a repeated anchor is mined twice.
Fewer positives or negatives than asked: all there are.  Extra columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut_lineage, scratch_path

CODEWORDS = 32
CODEBOOK_ROWS = 20_000
SHARD_BYTES = 8 << 20
ANCHOR_BLOCK = 2_048
FIRST_VISIT = 256               # rows gathered before the first scoring, doubled every time

_NO_ID = np.iinfo(np.int64).max

SHARD = "n int, row long, ids binary, no_id binary, labels binary, anchor binary, cells binary, vecs binary"
HIT = "a int, p int, score long, id long, row long"
RESULT = ("anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long, "
          "label long")


def prepared(vectors: DataFrame, vec_id: str, label: str, vector: str, anchor: Column, scale: int) -> DataFrame:
    """Rows that take part: ``id, label, anchor, v`` with integer vectors of one length."""
    t = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(label).cast("long").alias("label"),
                       F.coalesce(anchor, F.lit(False)).alias("anchor"),
                       F.col(vector).cast("array<double>").alias("x"))
    t = t.filter(F.col("label").isNotNull() & F.col("x").isNotNull() & (F.size("x") > 0))
    t = t.filter(F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(math.inf))))
    sizes = t.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    d = sizes[0].d if sizes else 1
    limit = float(min(2 ** 31 - 1, math.isqrt(2 ** 62 // d)))       # d products stay below 2 ** 62
    t = t.filter(F.size("x") == d).withColumn("v", F.transform("x", lambda c: F.floor(c * F.lit(float(scale))).cast("double")))
    t = t.filter(F.forall("v", lambda c: F.abs(c) <= F.lit(limit)))
    return t.select("id", "label", "anchor", F.col("v").cast("array<int>").alias("v"))


def _matrix(col, d: int) -> np.ndarray:
    return np.asarray(col.flatten(), dtype=np.int32).reshape(-1, d)


def _assign(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    return np.argmin((book * book).sum(1) - 2.0 * (x @ book.T), axis=1)


def codebook(x: np.ndarray, codewords: int, rounds: int = 12) -> np.ndarray:
    """Lloyd's k-means of one half space; starts at rows spread over the sample."""
    book = np.unique(x, axis=0)
    book = book[np.linspace(0, len(book) - 1, min(codewords, len(book))).astype(int)] if len(book) else np.zeros((1, x.shape[1]))
    for _ in range(rounds):
        own = _assign(x, book)
        n = np.bincount(own, minlength=len(book))
        total = np.zeros_like(book)
        np.add.at(total, own, x)
        book = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], book)
    return book


def fit(rows: DataFrame, codewords: int = CODEWORDS):
    """The two half-space codebooks, from at most ``CODEBOOK_ROWS`` rows spread over the table by hash."""
    n = rows.count()
    if n == 0:
        return None
    part = rows if n <= CODEBOOK_ROWS else rows.filter(
        F.pmod(F.xxhash64("v"), F.lit(1 << 20)) < F.lit(int((1 << 20) * CODEBOOK_ROWS / n) + 1))
    x = np.array([r.v for r in part.select("v").limit(CODEBOOK_ROWS).collect()], np.float64)
    if not len(x):                                          # every hash was above the cut
        x = np.array([r.v for r in rows.select("v").limit(CODEBOOK_ROWS).collect()], np.float64)
    h = x.shape[1] // 2
    return codebook(x[:, :h], codewords), codebook(x[:, h:], codewords)


def _cells(books):
    d = books[0].shape[1] + books[1].shape[1]
    h = books[0].shape[1]

    def run(batches):
        import pyarrow as pa
        for rb in batches:
            x = _matrix(rb.column(3), d).astype(np.float64)
            cell = _assign(x[:, :h], books[0]) * len(books[1]) + _assign(x[:, h:], books[1])
            yield pa.RecordBatch.from_arrays([*rb.columns, pa.array(cell.astype(np.int32))],
                                             names=["id", "label", "anchor", "v", "cell"])
    return run


def _pack(d: int):
    size = max(1, SHARD_BYTES // (4 * d))

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext
        at, held = TaskContext.get().partitionId() << 40, []

        def shard(parts):
            n = sum(len(p[0]) for p in parts)
            ids, none, labels, anchor, cells, vecs = (np.concatenate([p[i] for p in parts]) for i in range(6))
            cols = [ids.astype("<i8"), none, labels.astype("<i8"), anchor, cells.astype("<i4"), vecs.astype("<i4")]
            return pa.RecordBatch.from_arrays(
                [pa.array([n], pa.int32()), pa.array([at], pa.int64()), *(pa.array([c.tobytes()], pa.binary()) for c in cols)],
                names=["n", "row", "ids", "no_id", "labels", "anchor", "cells", "vecs"])

        for rb in batches:
            none = np.asarray(rb.column(0).is_null()).astype(np.uint8)
            part = (np.asarray(rb.column(0).fill_null(_NO_ID)), none, np.asarray(rb.column(1)),
                    np.asarray(rb.column(2)).astype(np.uint8), np.asarray(rb.column(4)), _matrix(rb.column(3), d))
            lo = 0
            while lo < rb.num_rows:
                hi = min(rb.num_rows, lo + size - sum(len(p[0]) for p in held))
                held.append(tuple(c[lo:hi] for c in part))
                if sum(len(p[0]) for p in held) == size:
                    yield shard(held)
                    at, held = at + size, []
                lo = hi
        if held:
            yield shard(held)
    return run


def build(rows: DataFrame, books) -> DataFrame:
    """The index: shards of rows in cell order, written to the shared folder."""
    t = rows.mapInArrow(_cells(books), "id long, label long, anchor boolean, v array<int>, cell int")
    t = t.repartitionByRange("cell", F.xxhash64("id", "label", "v")).sortWithinPartitions("cell")
    return cut_lineage(t.mapInArrow(_pack(books[0].shape[1] + books[1].shape[1]), SHARD), "hn-index")


def _shards(batches, d):
    for rb in batches:
        for r in range(rb.num_rows):
            ids, none, labels, anchor, cells, vecs = (np.frombuffer(rb.column(i)[r].as_buffer(), t) for i, t in
                                                      ((2, "<i8"), (3, np.uint8), (4, "<i8"), (5, np.uint8), (6, "<i4"), (7, "<i4")))
            yield rb.column(1)[r].as_py(), ids, none, labels, anchor, cells, vecs.reshape(-1, d)


def _anchors(d):
    def run(batches):
        import pyarrow as pa
        for row, ids, _, labels, anchor, _, vecs in _shards(batches, d):
            k = np.flatnonzero(anchor)
            if len(k):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row + k), pa.array(ids[k]), pa.array(labels[k]), pa.array(vecs[k].tolist(), pa.list_(pa.int32()))],
                    names=["row", "id", "label", "v"])
    return run


class _Shard:
    """One shard with its cells, radii and exact scores."""

    def __init__(self, books, row, ids, none, labels, cells, vecs):
        self.ids, self.none, self.labels, self.rows = ids, none, labels, row + np.arange(len(ids))
        h, k2 = books[0].shape[1], len(books[1])
        self.halves, self.of = [], []
        for side, x, code in ((0, vecs[:, :h], cells // k2), (1, vecs[:, h:], cells % k2)):
            used, local = np.unique(code, return_inverse=True)
            away = np.sqrt(((x - books[side][code]) ** 2).sum(1))
            radius = np.zeros(len(used))
            np.maximum.at(radius, local, away)
            self.halves.append((books[side][used], radius))
            self.of.append(local)
        # rows are in cell order: each cell is one range
        grid = (len(self.halves[0][0]), len(self.halves[1][0]))
        self.start, self.end = np.zeros(grid, np.int64), np.zeros(grid, np.int64)
        cut = np.flatnonzero(np.diff(cells, prepend=-1))
        i, j = self.of[0][cut], self.of[1][cut]
        self.start[i, j], self.end[i, j] = cut, np.append(cut[1:], len(cells))
        top = int(np.abs(vecs).max(initial=0))
        self.small = top
        self.vecs, self.as_float = vecs, None

    def bounds(self, q: np.ndarray):
        """Upper bounds of the half scores of all queries, by codeword, and a slack for rounding."""
        h = self.halves[0][0].shape[1]
        out, slack = [], 0.0
        for part, (book, radius) in zip((q[:, :h], q[:, h:]), self.halves):
            norm = np.sqrt((part * part).sum(1))[:, None]
            out.append(part @ book.T + norm * radius)
            slack = slack + norm[:, 0] * (np.sqrt((book * book).sum(1)) + radius).max(initial=0.0)
        return out[0], out[1], slack * 1e-9 + 1e-6

    def scores(self, k: np.ndarray, q: np.ndarray) -> np.ndarray:
        if self.small * int(np.abs(q).max(initial=0)) * len(q) < 1 << 53:      # exact in doubles
            if self.as_float is None:
                self.as_float = self.vecs.astype(np.float64)
            return (self.as_float[k] @ q.astype(np.float64)).astype(np.int64)
        return self.vecs[k].astype(np.int64) @ q.astype(np.int64)

    def visit(self, u: np.ndarray, v: np.ndarray, needed, found):
        """Multi-sequence search: cells by the sum of their half bounds while a bound reaches ``needed()``;
        ``found(rows)`` is called with growing groups of rows."""
        iu, iv = np.argsort(-u, kind="stable").tolist(), np.argsort(-v, kind="stable").tolist()
        su, sv = u[iu].tolist(), v[iv].tolist()
        heap, group, held, size = [(-(su[0] + sv[0]), 0, 0)], [], 0, FIRST_VISIT
        start, end = self.start, self.end
        while heap:
            bound, a, b = heap[0]
            if -bound < needed():
                break
            heapq.heappop(heap)
            if b + 1 < len(sv):
                heapq.heappush(heap, (-(su[a] + sv[b + 1]), a, b + 1))
            if b == 0 and a + 1 < len(su):
                heapq.heappush(heap, (-(su[a + 1] + sv[0]), a + 1, 0))
            lo, hi = start[iu[a], iv[b]], end[iu[a], iv[b]]
            if hi > lo:
                group.append(np.arange(lo, hi))
                held += hi - lo
                if held >= size:
                    found(np.concatenate(group))
                    group, held, size = [], 0, 2 * size
        if group:
            found(np.concatenate(group))


def _first(best, s, ids, rows, none, k):
    """The first ``k`` of a list and new rows: highest score, then smallest id, then row."""
    s, ids, rows, none = (np.concatenate([a, b]) for a, b in zip(best, (s, ids, rows, none)))
    order = np.lexsort((rows, ids, none, -s))[:k]
    return s[order], ids[order], rows[order], none[order]


def _empty():
    return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint8)


def _hits(lists):
    import pyarrow as pa
    keys = [k for k, b in lists.items() if len(b[0])]
    if keys:
        n = [len(lists[k][0]) for k in keys]
        s, ids, rows, none = (np.concatenate([lists[k][i] for k in keys]) for i in range(4))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat([k[0] for k in keys], n), pa.int32()), pa.array(np.repeat([k[1] for k in keys], n), pa.int32()),
             pa.array(s), pa.array(ids, mask=none.astype(bool)), pa.array(rows)], names=["a", "p", "score", "id", "row"])


def _positives(books, q, labels, own, k):
    """First ``k`` other rows of the anchor's label, of the rows of a task."""
    d = q.shape[1]

    def run(batches):
        lists = {(a, 0): _empty() for a in range(len(q))}
        for row, ids, none, lab, _, cells, vecs in _shards(batches, d):
            sh = _Shard(books, row, ids, none, lab, cells, vecs)
            u, v, slack = sh.bounds(q.astype(np.float64))
            for a in range(len(q)):
                key = (a, 0)

                def found(i, a=a, key=key):
                    i = i[(lab[i] == labels[a]) & (sh.rows[i] != own[a])]
                    s = sh.scores(i, q[a])
                    best = lists[key]
                    if len(best[0]) == k:
                        near = s >= best[0][-1]
                        i, s = i[near], s[near]
                    if len(i):
                        lists[key] = _first(best, s, ids[i], sh.rows[i], none[i], k)

                def needed(a=a, key=key):
                    best = lists[key][0]
                    return float(best[-1]) - slack[a] if len(best) == k else -math.inf
                sh.visit(u[a], v[a], needed, found)
        yield from _hits(lists)
    return run


def _negatives(books, q, labels, windows, k):
    """First ``k`` rows of other labels inside each window ``(p, lowest, highest)`` of an anchor."""
    d = q.shape[1]

    def run(batches):
        lists = {(a, p): _empty() for a, w in enumerate(windows) for p, _, _ in w}
        for row, ids, none, lab, _, cells, vecs in _shards(batches, d):
            sh = _Shard(books, row, ids, none, lab, cells, vecs)
            u, v, slack = sh.bounds(q.astype(np.float64))
            for a, wins in enumerate(windows):
                if not wins:
                    continue

                def reach(a=a, wins=wins):
                    out = []
                    for p, lo, _ in wins:
                        best = lists[(a, p)][0]
                        out.append(int(best[-1]) if len(best) == k else lo)
                    return min(out)

                def found(i, a=a, wins=wins):
                    i = i[lab[i] != labels[a]]
                    s = sh.scores(i, q[a])
                    near = (s >= reach()) & (s <= max(hi for _, _, hi in wins))
                    i, s = i[near], s[near]
                    for p, lo, hi in wins:
                        m = (s >= lo) & (s <= hi)
                        if m.any():
                            j = i[m]
                            lists[(a, p)] = _first(lists[(a, p)], s[m], ids[j], sh.rows[j], none[j], k)
                sh.visit(u[a], v[a], lambda a=a: float(reach()) - slack[a], found)
        yield from _hits(lists)
    return run


def _merged(hits: DataFrame, k: int):
    order = Window.partitionBy("a", "p").orderBy(F.desc("score"), F.asc_nulls_last("id"), "row")
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def mine(vectors: DataFrame, anchor: Column, vec_id: str = "vec_id", label: str = "label", vector: str = "embedding",
         positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, scale: int = 256,
         codewords: int = CODEWORDS) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score, label``: for each anchor
    row (where ``anchor`` holds) and each of its positives the hardest negatives of the score window."""
    spark = vectors.sparkSession
    rows = cut_lineage(prepared(vectors, vec_id, label, vector, anchor, scale), "hn-rows")
    books = fit(rows, codewords)
    if books is None:
        return spark.createDataFrame([], RESULT)
    index = build(rows, books)
    d = books[0].shape[1] + books[1].shape[1]
    asked = cut_lineage(index.mapInArrow(_anchors(d), "row long, id long, label long, v array<int>"), "hn-anchors")
    blocks = max(1, math.ceil(asked.count() / ANCHOR_BLOCK))
    path = scratch_path(spark, "hn-result")
    for b in range(blocks):
        part = asked if blocks == 1 else asked.filter(F.pmod(F.xxhash64("row"), F.lit(blocks)) == b)
        block = part.orderBy("row").collect()               # about ANCHOR_BLOCK rows
        q = np.array([r.v for r in block], np.int64).reshape(len(block), d)
        labels, own = [r.label for r in block], [r.row for r in block]
        near = _merged(index.mapInArrow(_positives(books, q, labels, own, positives), HIT), positives).collect()
        windows = [[] for _ in block]
        pos = []
        for r in near:                                      # at most `positives` of each anchor of the block
            lo, hi = -(-low * r.score // 100), high * r.score // 100
            pos.append((r.a, r.rank, r.id, r.score, block[r.a].id, block[r.a].label))
            if lo <= hi:
                windows[r.a].append((r.rank, lo, hi))
        hits = _merged(index.mapInArrow(_negatives(books, q, labels, windows, negatives), HIT), negatives)
        named = spark.createDataFrame(pos, "a int, p int, positive_id long, positive_score long, anchor_id long, label long")
        hits.join(F.broadcast(named), ["a", "p"]).select(
            "anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score",
            F.col("score").alias("negative_score"), "label").write.parquet(f"{path}/block={b}")
    return spark.read.schema(RESULT).parquet(*[f"{path}/block={b}" for b in range(blocks)])
