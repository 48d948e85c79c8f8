"""Exact removal of repeated byte strings with a logarithmic family of sparse suffix arrays.

A byte goes when a ``length``-byte string covering it also starts earlier (smaller doc_id, or the
same document and an earlier start); strings are judged on the input.

**Sparse suffix array.**  Indexing every byte would need eight bytes of index for each byte of text.
Suffixes are therefore sampled by content: within every ``length``-byte string the position whose
``gram``-byte prefix has the smallest hash is an anchor.  Equal strings choose the same anchor, so
no repeat is missed, and about 2 / (length - gram + 2) of the positions are anchors.  Consecutive
strings with one anchor form a stretch ``[a, b + length)``.  A *class* is the pair (hash of the
suffix's first ``gram`` bytes, hash of the whole stretch), 96 bits.  The array of a batch is its
anchors sorted by (class, doc_id, start): equal suffix prefixes are neighbours and the first of a
run is the earliest occurrence.  (The order is that of the fingerprints, not of the letters: finding
equal prefixes only needs them to be adjacent.)

**Logarithmic family.**  Documents arrive in ``batches`` of ascending doc_id.  A batch is sorted
into its array, heads of runs are matched against all existing levels by one equi-join on the class
(hash or sort-merge, as Spark plans it; the levels are sets without an order of their own), heads that
no level holds become a new level, and the two newest levels are put together while their sizes (in
batches) are equal, so there are logarithmically many.  Partial matches between long strings are
found by one sort over all batches at the end.  The array is a global sort (range partitions
of the full key), so a class with a third of all rows spreads over many tasks; only the first row of
a partition is compared with the last row of the one before, on the driver (one row per partition).

**Edges of matches.**  Two stretches around one suffix prefix may agree only in part.  The classes
whose prefix also heads another class send their bytes to that prefix, where their single
``length``-byte strings are compared.  A prefix with more than ``HOT`` classes is not gathered: its
strings go through the global sort instead.

Texts travel between tasks compressed, and tables of finished steps are deleted.

Edge cases.  Null texts are empty.  Texts shorter than ``length`` stay whole.  Repeated rows (same
doc_id, same text) get the same result and do not remove each other.  When a doc_id is null or
stands for several texts, the order is (doc_id, md5 of the text), nulls first.  Cut bytes may split a
multi-byte character, so the kept text is binary.  Extra columns are ignored, an empty table gives
an empty result.  A text above the block size is scanned in pieces: memory stays bounded.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textblocks as tb
from .common import cut_lineage, doc_texts, drop_table, release

LENGTH, GRAM, BATCHES = 100, 24, 4
HOT = 50_000
BLOCK = 1 << 19
_POS_BITS = np.uint64(24)

ANCHOR = "key int, content long, ord long, pn long"
RUN = ANCHOR + ", head boolean, shared boolean, edge boolean, tail boolean, part int"


def anchors(data: np.ndarray, off: np.ndarray, length: int, gram: int):
    """Stretches of a block: ``(document, start, strings, key, content)`` arrays."""
    n = len(data)
    if n < length:
        z = np.zeros(0, np.int64)
        return z, z, z, z.astype(np.uint64), z.astype(np.uint64)
    q = tb.prefix_hash(data, tb.byte_codes(23))
    at = np.arange(n - gram + 1)
    grams = tb.span_hash(q, at, at + gram)
    m = ((grams >> _POS_BITS) << _POS_BITS) | at.astype(np.uint64)
    w, size = length - gram + 1, 1
    while size * 2 <= w:
        m = np.minimum(m[:-size], m[size:])
        size *= 2
    if w > size:
        m = np.minimum(m[: len(m) - (w - size)], m[w - size:])
    where = (m & np.uint64((1 << 24) - 1)).astype(np.int64)        # anchor of the string starting here
    doc_len = np.diff(off)
    valid = np.zeros(n + 1, np.int8)
    long_docs = doc_len >= length
    np.add.at(valid, off[:-1][long_docs], 1)
    np.add.at(valid, off[1:][long_docs] - length + 1, -1)
    s = np.flatnonzero(np.cumsum(valid[: len(where)]))
    if not len(s):
        return anchors(data[:0], off[:1], length, gram)
    new = np.ones(len(s), bool)
    new[1:] = (where[s[1:]] != where[s[:-1]]) | (np.diff(s) != 1)
    first = np.flatnonzero(new)
    a = s[first]
    b = s[np.append(first[1:], len(s)) - 1]
    doc = np.searchsorted(off, a, side="right") - 1
    return doc, a - off[doc], b - a + 1, grams[where[a]], tb.span_hash(q, a, b + length)


def _pieces(data, off, length):
    """Blocks of whole documents; a document above the block size in overlapping pieces."""
    for i, j, d, o in tb.blocks(data, off, BLOCK):
        if len(d) <= 2 * BLOCK:
            yield i, 0, d, o
        else:
            for x in range(0, len(d) - length + 1, BLOCK):
                p = d[x: x + BLOCK + length - 1]
                yield i, x, p, np.array([0, len(p)])


def _anchor_rows(length, gram):
    def run(batches):
        import pyarrow as pa
        for rb in batches:
            ids = np.asarray(rb.column(0))
            data, off = tb.text_bytes(rb.column(1))
            for i, shift, d, o in _pieces(data, off, length):
                doc, a, k, key, content = anchors(d, o, length, gram)
                yield pa.RecordBatch.from_arrays(
                    [pa.array((key >> np.uint64(32)).astype(np.uint32).view(np.int32)),
                     pa.array(content.view(np.int64)), pa.array(ids[i + doc]),
                     pa.array((a + shift) * 128 + k)], names=["key", "content", "ord", "pn"])
    return run


def _stretch_rows(length):
    """Listed stretches of compressed texts with their bytes."""
    def run(batches):
        import pyarrow as pa
        for rb in batches:
            ids, texts = np.asarray(rb.column(0)), rb.column(1)
            pn, po = _flat(rb.column(2), "pn")
            key, _ = _flat(rb.column(2), "key")
            unpack = tb.unpacker()
            for i in range(rb.num_rows):
                text, p = unpack(texts[i]), pn[po[i]: po[i + 1]]
                parts = [text[a: a + k + length - 1] for a, k in zip((p // 128).tolist(), (p % 128).tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key[po[i]: po[i + 1]].astype(np.int32)), pa.array(np.full(len(p), ids[i])), pa.array(p),
                     pa.array(parts, pa.binary())], names=["key", "ord", "pn", "bytes"])
    return run


def _hashes(data, off, length):
    """Start, row and two hashes of every string of the rows of a flat byte column."""
    k = np.maximum(np.diff(off) - length + 1, 0)
    ends = np.cumsum(k)
    row = np.repeat(np.arange(len(k)), k)
    rel = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - k, k)
    s = rel + off[row]
    h = [tb.span_hash(tb.prefix_hash(data, tb.byte_codes(seed)), s, s + length) for seed in (41, 43)]
    return rel, row, h


def _compare_strings(length):
    """Rows sorted by (key, ord, pn): the strings that an earlier row of the key holds, as spans."""
    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        def spans(cols):
            ord_, pn = np.asarray(cols.column("ord")), np.asarray(cols.column("pn"))
            data, off = tb.text_bytes(cols.column("bytes"))
            rel, row, h = _hashes(data, off, length)
            o = np.lexsort((np.arange(len(rel)), h[1], h[0]))
            again = np.zeros(len(rel), bool)
            again[o[1:]] = (h[0][o[1:]] == h[0][o[:-1]]) & (h[1][o[1:]] == h[1][o[:-1]])
            # consecutive strings of a row become one span
            at = np.flatnonzero(again)
            new = np.ones(len(at), bool)
            new[1:] = (np.diff(at) != 1) | (row[at[1:]] != row[at[:-1]])
            first = np.flatnonzero(new)
            size = np.diff(np.append(first, len(at)))
            r = row[at[first]]
            return pa.RecordBatch.from_arrays(
                [pa.array(ord_[r]), pa.array((pn[r] // 128 + rel[at[first]]) * 128 + size)], names=["ord", "pn"])
        def parts(t):
            """Whole keys of about 1 MB of bytes."""
            key, size = np.asarray(t.column("key")), np.cumsum(np.asarray(pc.binary_length(t.column("bytes"))))
            i = 0
            while i < len(key):
                j = max(i, int(np.searchsorted(size, (size[i - 1] if i else 0) + (1 << 20))) - 1)
                j = int(np.searchsorted(key, key[j], side="right"))
                yield t.slice(i, j - i)
                i = j

        held = None
        for rb in batches:
            t = pa.Table.from_batches([rb])
            t = t if held is None else pa.concat_tables([held, t])
            key = np.asarray(t.column("key"))
            cut = int(np.searchsorted(key, key[-1])) if len(key) else 0      # the last key may go on
            if cut and t.nbytes > (1 << 20):
                yield from map(spans, parts(t.slice(0, cut)))
                t = t.slice(cut)
            held = t
        if held is not None and held.num_rows:
            yield from map(spans, parts(held))
    return run


def _string_rows(length):
    """Every string of the rows, for prefixes too frequent to be gathered."""
    def run(batches):
        import pyarrow as pa
        for rb in batches:
            ord_, pn = np.asarray(rb.column(1)), np.asarray(rb.column(2))
            data, off = tb.text_bytes(rb.column(3))
            rel, row, h = _hashes(data, off, length)
            yield pa.RecordBatch.from_arrays(
                [pa.array((h[0] >> np.uint64(32)).astype(np.uint32).view(np.int32)), pa.array(h[1].view(np.int64)),
                 pa.array(ord_[row]), pa.array((pn[row] // 128 + rel) * 128 + 1)],
                names=["key", "content", "ord", "pn"])
    return run


def _flat(col, field=None):
    """A list column (null: empty list) as flat values (of a struct field) and offsets."""
    import pyarrow.compute as pc
    if not len(col):
        return np.zeros(0, np.int64), np.zeros(1, np.int64)
    ln = np.asarray(pc.fill_null(pc.list_value_length(col), 0)).astype(np.int64)
    off = np.zeros(len(ln) + 1, np.int64)
    np.cumsum(ln, out=off[1:])
    flat = pc.list_flatten(col)
    return np.asarray(flat if field is None else pc.struct_field(flat, field)).astype(np.int64), off


def _mark(keep):
    """Flag the rows of a sorted partition: ``head`` starts a run of one class, ``shared`` has a
    neighbour of the same key and another class, ``edge``/``tail`` are the partition's ends.  Only
    the rows that ``keep`` names and the ends are returned; one row is held back until its successor
    is known."""
    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        prev = held = None        # the row before the held one; the held row (key, content, ord, pn)

        def out(rows, prev_row, next_row):
            key, content = rows[0], rows[1]
            pk = np.concatenate([[prev_row[0] if prev_row is not None else 0], key[:-1]])
            pc = np.concatenate([[prev_row[1] if prev_row is not None else 0], content[:-1]])
            nk = np.concatenate([key[1:], [next_row[0] if next_row is not None else 0]])
            nc = np.concatenate([content[1:], [next_row[1] if next_row is not None else 0]])
            has_p = np.ones(len(key), bool)
            has_n = np.ones(len(key), bool)
            has_p[0] = prev_row is not None
            has_n[-1] = next_row is not None
            same_p, same_n = has_p & (pk == key), has_n & (nk == key)
            head = ~(same_p & (pc == content))
            shared = (same_p & (pc != content)) | (same_n & (nc != content))
            edge, tail = ~has_p, ~has_n
            use = {"all": np.ones(len(key), bool), "repeated": ~head, "shared": shared}[keep] | edge | tail
            return pa.RecordBatch.from_arrays(
                [pa.array(x[use]) for x in (*rows, head, shared, edge, tail, np.full(len(key), part, np.int32))],
                names=["key", "content", "ord", "pn", "head", "shared", "edge", "tail", "part"])

        for rb in batches:
            if not rb.num_rows:
                continue
            rows = [np.asarray(rb.column(i)) for i in range(4)]
            if held is not None:
                rows = [np.concatenate([[held[i]], rows[i]]) for i in range(4)]
            body = [x[:-1] for x in rows]
            held_new = [x[-1] for x in rows]
            if len(body[0]):
                yield out(body, prev, held_new)
                prev = [x[-1] for x in body]
            held = held_new
        if held is not None:
            yield out([np.array([x]) for x in held], prev, None)
    return run


def sorted_run(rows: DataFrame, name: str, keep: str = "all"):
    """Sort anchors globally, flag them and write the array; returns it with the flags that depend
    on the neighbouring partitions corrected."""
    full = ["key", "content", "ord", "pn"]
    # partitions follow the session's setting, adaptive execution may merge neighbours
    run = rows.repartitionByRange(*full).sortWithinPartitions(*full).mapInArrow(_mark(keep), RUN)
    run = cut_lineage(run, name)
    # ends of partitions: two rows each, bounded by the number of partitions
    ends = run.filter("edge or tail").select("part", "key", "content", "edge", "tail").collect()
    first = {r.part: r for r in ends if r.edge}
    last = {r.part: r for r in ends if r.tail}
    no_head, share = [], []
    for p, q in zip(sorted(first), sorted(first)[1:]):
        if last[p].key == first[q].key:
            if last[p].content == first[q].content:
                no_head.append(q)
            else:
                share += [(p, "tail"), (q, "edge")]
    head = F.col("head") & ~(F.col("edge") & F.col("part").isin(no_head)) if no_head else F.col("head")
    # a key shared across a partition end concerns whole runs; marking the key is enough
    keys = {last[p].key for p, e in share if e == "tail"}
    shared = F.col("shared") | F.col("key").isin(list(keys)) if keys else F.col("shared")
    return run.withColumn("head", head).withColumn("shared", shared).drop("edge", "tail", "part")


def _ordered(docs: DataFrame):
    """``doc_id, ord, text`` where ``ord`` is a long that sorts like (doc_id, text): all rows, and
    each ``ord`` once."""
    t = doc_texts(docs)
    ids = t.groupBy("doc_id").count()
    odd = ids.agg(F.max("count"), F.count(F.when(F.col("doc_id").isNull(), 1))).first()
    if (odd[0] or 0) <= 1 and not odd[1]:
        t = t.withColumn("ord", F.col("doc_id"))
        return t, t
    t = t.withColumn("_m", F.md5(F.coalesce("text", F.lit(""))))
    ranks = t.select("doc_id", "_m").distinct()
    ranks = ranks.repartitionByRange("doc_id", "_m").sortWithinPartitions("doc_id", "_m").withColumn(
        "ord", F.monotonically_increasing_id())
    ranks = cut_lineage(ranks, "sx-order").withColumnRenamed("doc_id", "_d").withColumnRenamed("_m", "_r")
    t = t.join(ranks, t["doc_id"].eqNullSafe(F.col("_d")) & (F.col("_m") == F.col("_r"))).select(
        "doc_id", "ord", "text")
    return t, t.dropDuplicates(["ord"])


class Family:
    """Levels of the index: ``(size in batches, classes)``, newest last."""

    def __init__(self):
        self.levels = []

    def union(self):
        out = None
        for _, t in self.levels:
            out = t if out is None else out.unionByName(t)
        return out

    def scan(self, heads: DataFrame):
        """Merge-scan the heads of a batch against all levels: adds ``known``."""
        old = self.union()
        if old is None:
            return heads.withColumn("known", F.lit(False))
        old = old.select("key", "content", F.lit(True).alias("known"))
        return heads.join(old, ["key", "content"], "left").withColumn("known", F.coalesce("known", F.lit(False)))

    def insert(self, classes: DataFrame):
        self.levels.append((1, classes))
        while len(self.levels) > 1 and self.levels[-1][0] == self.levels[-2][0]:
            (n, new), (_, old) = self.levels.pop(), self.levels.pop()
            both = cut_lineage(old.unionByName(new), "sx-level")
            drop_table(old)
            drop_table(new)
            self.levels.append((2 * n, both))


def _cutter(length):
    def run(batches):
        import pyarrow as pa
        for rb in batches:
            unpack = tb.unpacker()
            texts = [unpack(t) for t in rb.column(1)]
            data, off = tb.text_bytes(pa.array(texts, pa.large_binary()))
            pn, po = _flat(rb.column(2))
            for i, j, d, o in tb.blocks(data, off, BLOCK):
                p, ln = pn[po[i]: po[j]], np.diff(po[i: j + 1])
                a = p // 128 + np.repeat(o[:-1], ln)
                e = a + p % 128 + length - 1
                d_off = np.bincount(a, minlength=len(d) + 1) - np.bincount(e, minlength=len(d) + 1)
                gone = np.cumsum(d_off[: len(d)]) > 0
                cut = np.zeros(len(d) + 1, bool)
                cut[o[:-1]] = True
                starts = gone.copy()
                starts[1:] &= ~gone[:-1] | cut[1:-1]
                cg = np.concatenate([[0], np.cumsum(gone)])
                cs = np.concatenate([[0], np.cumsum(starts)])
                removed = cg[o[1:]] - cg[o[:-1]]
                spans = cs[o[1:]] - cs[o[:-1]]
                kept = d[~gone]
                ko = (o - cg[o]).astype(np.int64)
                text = pa.LargeBinaryArray.from_buffers(pa.large_binary(), j - i, [None, pa.py_buffer(ko), pa.py_buffer(kept)])
                yield pa.RecordBatch.from_arrays(
                    [rb.column(0).slice(i, j - i), pa.array(np.diff(o)), pa.array(removed), pa.array(spans),
                     text.cast(pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_text"])
    return run


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, batches: int = BATCHES) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_text`` (binary) for every row of ``docs``."""
    spark = docs.sparkSession
    texts, once = _ordered(docs)
    bounds = once.agg(F.percentile_approx("ord", [i / batches for i in range(1, batches)], 10000)).first()[0] \
        if batches > 1 else []
    bounds = sorted(set(bounds or []))
    family, gone = Family(), []
    lows, highs = [None, *bounds], [*bounds, None]
    for lo, hi in zip(lows, highs):
        part = once
        if lo is not None:
            part = part.filter(F.col("ord") > lo)
        if hi is not None:
            part = part.filter(F.col("ord") <= hi)
        rows = part.select("ord", "text").mapInArrow(_anchor_rows(length, gram), ANCHOR)
        run = sorted_run(rows, "sx-run")
        gone.append(cut_lineage(run.filter("not head").select("ord", "pn"), "sx-gone"))
        scanned = family.scan(run.filter("head").select("key", "content", "ord", "pn"))
        if family.levels:
            scanned = cut_lineage(scanned, "sx-scan")
            gone.append(scanned.filter("known").select("ord", "pn"))
            gone[-1] = cut_lineage(gone[-1], "sx-gone")
            family.insert(cut_lineage(scanned.filter("not known").drop("known"), "sx-level"))
            drop_table(scanned)
        else:
            family.insert(cut_lineage(scanned.drop("known"), "sx-level"))
        drop_table(run)
        release(spark)
    # classes that share their suffix prefix with another class: compare their single strings
    merged = sorted_run(family.union(), "sx-merged", "shared").filter("shared").select("key", "ord", "pn")
    for _, level in family.levels:
        drop_table(level)
    release(spark)
    listed = merged.groupBy("ord").agg(F.collect_list(F.struct("key", "pn")).alias("pns"))
    packed = once.select("ord", "text").mapInArrow(tb.pack_texts, "ord long, packed binary")
    parts = packed.join(listed, "ord").mapInArrow(_stretch_rows(length), "key int, ord long, pn long, bytes binary")
    parts = cut_lineage(parts, "sx-stretches")
    release(spark)
    hot = cut_lineage(parts.groupBy("key").count().filter(F.col("count") > HOT).select("key"), "sx-hot")
    cold = parts.join(hot, "key", "left_anti").repartition("key").sortWithinPartitions("key", "ord", "pn")
    gone.append(cut_lineage(cold.mapInArrow(_compare_strings(length), "ord long, pn long"), "sx-gone"))
    if not hot.isEmpty():
        many = parts.join(hot, "key", "left_semi").mapInArrow(_string_rows(length), ANCHOR)
        gone.append(sorted_run(many, "sx-strings", "repeated").filter("not head").select("ord", "pn"))
    drop_table(parts)
    release(spark)
    spans = gone[0]
    for g in gone[1:]:
        spans = spans.unionByName(g)
    spans = spans.groupBy("ord").agg(F.collect_list("pn").alias("pns"))
    packed = texts.select("doc_id", "ord", "text").mapInArrow(tb.pack_texts, "doc_id long, ord long, packed binary")
    out = packed.join(spans, "ord", "left").select("doc_id", "packed", "pns")
    return out.mapInArrow(_cutter(length),
                          "doc_id long, n_bytes long, n_removed long, n_spans long, kept_text binary")
