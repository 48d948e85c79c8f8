"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard verification.

**Signature.**  A shingle's 64-bit hash is sent by a first permutation ``sigma`` to a point of
``[0, 2**32)``.  The second permutation ``pi`` of that range is used ``K`` times, each time shifted
circularly by one more place: coordinate ``k`` is ``min over shingles of pi((sigma(x) - k) mod
2**32)``.  Two permutations therefore generate every coordinate.  ``pi`` is a bijective integer
finaliser, so a coordinate costs a subtraction and a few multiply/shift passes over a flat array.

**Banding.**  ``bands`` bands of ``rows`` coordinates.  With the defaults (42 x 5) a pair of
Jaccard similarity 0.8 shares no band with probability (1 - 0.8**5)**42 = 6e-8.

**Verification.**  Candidates are confirmed on the full shingle sets: they are linked when
``100 * |A & B| >= threshold * |A | B|``.

**Whole results without all pairs.**  Documents with equal shingle sets form one class and only
classes are compared.  Classes that share a band are gathered in candidate clusters (connected
components over the buckets), and every class ships its full set once to its cluster's *unit*.
A unit counts the intersections of all its sets with numpy and returns a spanning forest of the
confirmed links, so no pair is ever a row.  A cluster above ``UNIT`` is cut into blocks by set size
(sets whose sizes differ by more than the similarity allows are never linked, so a block meets only
its own and the neighbouring size class) and each pair of blocks is a unit of bounded size: a group
with a third of all rows is spread over many tasks and loses no link.  The work in such a cluster grows
with the square of its different sets (equal sets are one class).  Bucket minima are map-side
combined aggregates; joins back to a hot bucket are shuffled joins that adaptive execution splits.

Edge cases.  Null or blank texts have an empty set and stay alone.  A text with fewer words than a
shingle has one shingle, the whole word sequence.  Repeated rows and equal texts share a class.
A null ``doc_id`` is an ordinary row; a class of only null ids has a null representative and such
rows get a null component.  Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textblocks as tb
from .common import cut_lineage, doc_texts, free_name, row_key
from .components import star_forest

BANDS, ROWS = 42, 5
UNIT = 400_000        # weight of a unit: shingles, every set counting for at least SET_WEIGHT
SET_WEIGHT = 200

SKETCH = "doc_id long, row string, n long, h1 long, h2 long, bands array<long>"
SETS = "doc_id long, h1 long, h2 long, shingles array<long>"


def shingle_sets(data: np.ndarray, off: np.ndarray, k: int):
    """Distinct shingle hashes of a block's documents, flat, with the count of each document."""
    low = tb.lower_ascii(data)
    start, end, first = tb.words(low, off, tb.SPACE)
    nw = np.diff(first)
    h = tb.span_hash(tb.prefix_hash(low, tb.byte_codes(11)), start, end)
    n_sh = np.where(nw >= k, nw - k + 1, (nw > 0).astype(np.int64))
    doc = np.repeat(np.arange(len(nw)), n_sh)
    first_sh = np.concatenate([[0], np.cumsum(n_sh)])
    pos = np.arange(first_sh[-1]) - first_sh[doc] + first[doc]       # first word of each shingle
    ln = np.minimum(nw, k)[doc]
    x = np.zeros(len(pos), np.uint64)
    for j in range(k):
        use = j < ln
        nxt = h[np.minimum(pos + j, max(len(h) - 1, 0))] if len(h) else x
        x = np.where(use, tb.mix64(x * np.uint64(0x9E3779B97F4A7C15) + nxt), x)
    order = np.lexsort((x, doc))
    x, doc = x[order], doc[order]
    keep = np.ones(len(x), bool)
    keep[1:] = (x[1:] != x[:-1]) | (doc[1:] != doc[:-1])
    x, doc = x[keep], doc[keep]
    return x, np.bincount(doc, minlength=len(nw))


def _pi(y: np.ndarray) -> np.ndarray:
    """The second permutation: a bijection of 32-bit integers, in place."""
    t = y >> np.uint32(16)
    y ^= t
    y *= np.uint32(0x7FEB352D)
    np.right_shift(y, np.uint32(15), out=t)
    y ^= t
    y *= np.uint32(0x846CA68B)
    np.right_shift(y, np.uint32(16), out=t)
    y ^= t
    return y


def band_hashes(x: np.ndarray, counts: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """``(documents with shingles, bands)`` band hashes of flat shingle sets."""
    full = np.flatnonzero(counts)
    starts = (np.cumsum(counts) - counts)[full]
    out = np.zeros((len(full), bands), np.uint64)
    if not len(full):
        return out
    sigma = (tb.mix64(x) >> np.uint64(32)).astype(np.uint32)
    # pieces of bounded size keep the passes in cache; a document never spans two pieces
    cuts = [0]
    while cuts[-1] < len(full):
        nxt = int(np.searchsorted(starts, starts[cuts[-1]] + 65536, side="right"))
        cuts.append(max(cuts[-1] + 1, min(nxt, len(full))))
    ends = np.append(starts[1:], len(x))
    for i, j in zip(cuts, cuts[1:]):
        s = sigma[starts[i]: ends[j - 1]]
        at = starts[i:j] - starts[i]
        for b in range(bands):
            acc = np.full(j - i, b + 1, np.uint64)
            for r in range(rows):
                m = np.minimum.reduceat(_pi(s - np.uint32(b * rows + r)), at)
                acc = tb.mix64(acc * np.uint64(0x9E3779B97F4A7C15) + m.astype(np.uint64))
            out[i:j, b] = acc
    return out


def _set_hash(x: np.ndarray, counts: np.ndarray):
    """Order-free 128-bit fingerprint of every set."""
    res = []
    ends = np.cumsum(counts)
    for seed in (0xA5A5A5A5A5A5A5A5, 0x0123456789ABCDEF):
        c = np.zeros(len(x) + 1, np.uint64)
        np.cumsum(tb.mix64(x ^ np.uint64(seed)), out=c[1:])
        res.append(tb.mix64(c[ends] - c[ends - counts] + counts.astype(np.uint64)).view(np.int64))
    return res


def _lists(values: np.ndarray, counts: np.ndarray):
    import pyarrow as pa
    off = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(off), pa.array(values.view(np.int64)))


def _sketcher(k: int, bands: int, rows: int):
    def run(batches):
        import pyarrow as pa
        for rb in batches:
            ids = rb.column(0)
            data, off = tb.text_bytes(rb.column(1))
            for i, j, d, o in tb.blocks(data, off):
                x, n = shingle_sets(d, o, k)
                h1, h2 = _set_hash(x, n)
                bh = band_hashes(x, n, bands, rows)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(i, j - i), rb.column(2).slice(i, j - i), pa.array(n.astype(np.int64)), pa.array(h1),
                     pa.array(h2), _lists(bh.ravel(), np.where(n > 0, bands, 0))],
                    names=["doc_id", "row", "n", "h1", "h2", "bands"])
    return run


def _set_maker(k: int):
    def run(batches):
        import pyarrow as pa
        unpack = tb.unpacker()
        for rb in batches:
            ids = rb.column(0)
            data, off = tb.text_bytes(pa.array([unpack(t) for t in rb.column(1)], pa.large_binary()))
            for i, j, d, o in tb.blocks(data, off):
                x, n = shingle_sets(d, o, k)
                h1, h2 = _set_hash(x, n)
                yield pa.RecordBatch.from_arrays([ids.slice(i, j - i), pa.array(h1), pa.array(h2), _lists(x, n)],
                                                 names=["doc_id", "h1", "h2", "shingles"])
    return run


def linked(x: np.ndarray, counts: np.ndarray, threshold: int):
    """Smallest member (by position) of the link component of each of a unit's sets."""
    m = len(counts)
    doc = np.repeat(np.arange(m), counts)
    order = np.argsort(x, kind="stable")
    x, doc = x[order], doc[order]
    new = np.ones(len(x), bool)
    new[1:] = x[1:] != x[:-1]
    col = np.cumsum(new) - 1
    freq = np.bincount(col)
    common = np.zeros((m, m), np.float32)
    heavy = np.flatnonzero(freq >= 16)
    number = np.full(len(freq), -1)
    number[heavy] = np.arange(len(heavy))
    num = number[col]
    for lo in range(0, len(heavy), 2048):
        use = (num >= lo) & (num < lo + 2048)
        has = np.zeros((m, min(2048, len(heavy) - lo)), np.float32)
        has[doc[use], num[use] - lo] = 1
        common += has @ has.T
    light = (num < 0) & (freq[col] > 1)
    c, d = col[light], doc[light]                    # documents ascend within a shingle
    for k in range(1, 15):
        same = np.flatnonzero(c[k:] == c[:-k])
        if not len(same):
            break
        np.add.at(common, (d[same], d[same + k]), 1)
    # integers: the float counts are exact below 2 ** 24, their products with 100 are not
    common = np.maximum(common, common.T).astype(np.int64)
    n = counts.astype(np.int64)
    link = 100 * common >= threshold * (n[:, None] + n[None, :] - common)
    label = np.arange(m)
    while True:
        low = np.where(link, label[None, :], m).min(axis=1)
        low = np.minimum(label, low)
        low = low[low]
        if (low == label).all():
            return label
        label = low


def _unit_links(threshold: int):
    """Sorted rows ``(unit, id, shingles)`` to the spanning links of every unit."""
    def run(batches):
        import pyarrow as pa

        def links(ids, sets):
            counts = np.array([len(s) for s in sets])
            label = linked(np.concatenate(sets), counts, threshold)
            ids = np.array(ids, np.int64)
            k = np.flatnonzero(label != np.arange(len(ids)))
            return pa.RecordBatch.from_arrays([pa.array(ids[k]), pa.array(ids[label[k]])], names=["u", "v"])
        unit, ids, sets = None, [], []
        for rb in batches:
            units, own = rb.column(0).to_pylist(), rb.column(1).to_pylist()
            flat, off = rb.column(2).flatten(), np.asarray(rb.column(2).offsets)
            flat, off = np.asarray(flat), off - off[0]
            for i, u in enumerate(units):
                if u != unit:
                    if len(ids) > 1:
                        yield links(ids, sets)
                    unit, ids, sets = u, [], []
                ids.append(own[i])
                sets.append(flat[off[i]: off[i + 1]].copy())
        if len(ids) > 1:
            yield links(ids, sets)
    return run


def _units(members: DataFrame, threshold: int) -> DataFrame:
    """``id, unit`` for ``id, n, cluster``: one row per unit a member belongs to."""
    weight = F.sum(F.greatest("n", F.lit(SET_WEIGHT)))
    total = members.groupBy("cluster").agg(weight.alias("w"))
    m = members.join(total, "cluster")
    small = m.filter(F.col("w") <= UNIT).select("id", F.col("cluster").cast("string").alias("unit"))
    size = F.floor(F.log("n") / math.log(100 / threshold) + 1e-9).cast("int")
    large = m.filter(F.col("w") > UNIT).select("id", "n", "cluster", size.alias("s"))
    blocks = large.groupBy("cluster", "s").agg(F.ceil(weight / (UNIT / 2)).cast("int").alias("k"))
    near = [blocks.select("cluster", (F.col("s") + d).alias("s"), F.col("k").alias(name))
            for d, name in ((0, "k"), (1, "below"), (-1, "above"))]
    for t in near:
        large = large.join(t, ["cluster", "s"], "left")
    own = F.pmod(F.xxhash64("id"), F.col("k")).cast("int")

    def key(s1, h1, s2, h2) -> Column:
        return F.concat_ws(":", "cluster", s1, h1, s2, h2)

    def each(k) -> Column:
        return F.when(F.coalesce(k, F.lit(0)) > 0, F.sequence(F.lit(0), k - 1)).otherwise(F.array().cast("array<int>"))
    s = F.col("s")
    keys = F.concat(
        F.transform(each(F.col("k")), lambda h: key(s, F.least(h, F.col("own")), s, F.greatest(h, F.col("own")))),
        F.transform(each(F.col("above")), lambda h: key(s, F.col("own"), s + 1, h)),
        F.transform(each(F.col("below")), lambda h: key(s - 1, h, s, F.col("own"))))
    large = large.withColumn("own", own).select("id", F.explode(keys).alias("unit"))
    return small.unionByName(large)


def near_duplicates(docs: DataFrame, shingle: int = 5, threshold: int = 80, bands: int = BANDS,
                    rows: int = ROWS) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row of ``docs``.

    ``shingle`` words make a shingle, ``threshold`` is the Jaccard similarity in percent,
    ``component_id`` the smallest doc_id reachable over links (itself included).
    """
    out = _components(docs, F.lit(None).cast("string"), shingle, threshold, bands, rows)
    return out.select("doc_id", F.col("n").alias("n_shingles"),
                      F.when(F.col("n") > 0, F.col("best.doc_id")).otherwise(F.col("doc_id")).alias("component_id"))


def _components(docs: DataFrame, key: Column, shingle: int = 5, threshold: int = 80, bands: int = BANDS,
                rows: int = ROWS) -> DataFrame:
    """``doc_id, row (the key), n, best`` for every row; ``best(no_id, doc_id, row)`` is the first row of
    its component: the smallest doc_id, null after all others, then the smallest key.  Null without shingles."""
    texts = doc_texts(docs)
    rows_t = cut_lineage(texts.withColumn("row", key).mapInArrow(_sketcher(shingle, bands, rows), SKETCH), "mh-sketch")
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")
    classes = rows_t.filter("n > 0").groupBy("h1", "h2").agg(
        F.min(order).alias("best"), F.max("n").alias("n"), F.first("bands").alias("bands"))
    classes = classes.withColumn("rep", F.col("best.doc_id"))
    classes = cut_lineage(classes.withColumn("id", F.monotonically_increasing_id()), "mh-classes")

    # classes that share a bucket, gathered in clusters
    cells = classes.select("id", F.explode("bands").alias("b"))
    shared = cells.groupBy("b").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).filter("lo != hi")
    near = cells.join(shared.select("b", "lo"), "b").filter("id != lo").select(F.col("id").alias("u"),
                                                                              F.col("lo").alias("v"))
    clusters = star_forest(near)
    members = clusters.select(F.col("u").alias("id"), F.col("v").alias("cluster")).unionByName(
        clusters.select(F.col("v").alias("id"), F.col("v").alias("cluster")).distinct())
    members = cut_lineage(members.join(classes.drop("bands", "best"), "id"), "mh-members")

    # full sets of the representatives, sent to their units
    # the wanted ids grow with the corpus: always joined by shuffle, with compressed texts
    wanted = members.select(F.col("rep").alias("_rep")).distinct().hint("merge")
    packed = texts.mapInArrow(tb.pack_texts, "doc_id long, packed binary")
    named = packed.join(wanted, packed["doc_id"].eqNullSafe(F.col("_rep")), "left_semi")
    sets = named.mapInArrow(_set_maker(shingle), SETS).join(
        members.select("id", "h1", "h2"), ["h1", "h2"]).select("id", "shingles").dropDuplicates(["id"])
    units = _units(members.select("id", "n", "cluster"), threshold)
    rows = sets.join(units, "id").select("unit", "id", "shingles").repartition("unit").sortWithinPartitions("unit")
    forest = star_forest(rows.mapInArrow(_unit_links(threshold), "u long, v long"))

    # component of every class, then of every row
    root = forest.select(F.col("u").alias("id"), F.col("v").alias("root"))
    comp = classes.select("id", "h1", "h2", "best").join(root, "id", "left").withColumn("root", F.coalesce("root", "id"))
    first = comp.groupBy("root").agg(F.min("best").alias("best"))
    comp = comp.drop("best").join(first, "root").select("h1", "h2", "best")
    return rows_t.select("doc_id", "row", "n", "h1", "h2").join(comp, ["h1", "h2"], "left").select(
        "doc_id", "row", "n", F.when(F.col("n") > 0, F.col("best")).alias("best"))


def keep_one(docs: DataFrame, **params) -> DataFrame:
    """Rows of ``docs`` (all columns) without near duplicates: of each component one row stays, that of
    the smallest doc_id (null after all others), of several texts of this doc_id the one with the smallest
    fingerprint.  Repeated rows of one doc_id and text count as copies, also those without shingles."""
    comp = cut_lineage(_components(docs, row_key(), **params).select("row", F.col("best.row").alias("first")),
                       "mh-components")
    key = free_name(docs, "_row")
    drop = cut_lineage(comp.filter(F.col("row") != F.col("first")).select(F.col("row").alias(key)).distinct(), "mh-drop")
    kept = docs.join(drop, row_key() == F.col(key), "left_anti")
    twice = cut_lineage(comp.groupBy(F.col("row").alias(key)).agg(F.count(F.lit(1)).alias(f"{key}n")).filter(
        F.col(f"{key}n") > 1).select(key), "mh-twice")
    if twice.isEmpty():
        return kept
    same = row_key() == F.col(key)
    again = kept.join(twice, same, "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.join(twice, same, "left_anti").unionByName(again)
