"""Benchmark decontamination with a distributed positional inverted index.

Words are lower-cased (A-Z only) runs of digits, ASCII letters and all characters above 0x7F.  A
window is ``window`` consecutive words of a benchmark item; a shorter item is one window.

1. *Document frequencies.*  Occurrences of the test vocabulary are counted over all documents
   (counted per batch inside the tasks, then a partial aggregate).
2. *Postings.*  For every distinct window the two rarest terms are chosen; windows with a term that
   never occurs are out.  The postings ``(term, document, position, context)`` of the chosen terms
   are stored sorted by term; the context holds the word hashes within one window of the position.
3. *Intersection.*  Postings become window starts by subtracting the term's offset in the window;
   the lists of the rarest and the second rarest term are intersected on (document, window, start).
   With ``slop`` the starts may differ by that many words: proximity matches.
4. *Exact phrase.*  A surviving start is confirmed on all words of the window in the stored context.

The item side is a stated query set: its distinct windows are processed in blocks of about
``WINDOW_BLOCK``, so what the driver holds and tasks receive (vocabulary and windows of one block) is
bounded by that parameter, however long an item is and however often it is repeated.
The join keys after step 2 are (document, window, start), which no single document, item or frequent
term can make hot.

Edge cases.  Null or word-less texts have no words and match nothing; items without words have no
window.  A row is known by its doc_id and a 128-bit fingerprint of its text, so null doc_ids and different
texts of one doc_id are judged apart and repeated rows alike.  Several items may share windows or ids: an id counts once.
A null item_id is named by the empty string.  Extra columns are ignored; empty tables give empty or
clean results.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textblocks as tb
from .common import cut_lineage, doc_texts, free_name, row_key

WINDOW = 10
WINDOW_BLOCK = 50_000
BLOCK = 1 << 20


def _hashed_words(d, o):
    low = tb.lower_ascii(d)
    start, end, first = tb.words(low, o, tb.NON_ALNUM)
    return tb.span_hash(tb.prefix_hash(low, tb.byte_codes(31)), start, end).view(np.int64), first


def _member(h: np.ndarray, sorted_set: np.ndarray) -> np.ndarray:
    if not len(sorted_set):
        return np.zeros(len(h), bool)
    at = np.minimum(np.searchsorted(sorted_set, h), len(sorted_set) - 1)
    return sorted_set[at] == h


def _item_words(batches):
    import pyarrow as pa
    for rb in batches:
        data, off = tb.text_bytes(rb.column(1))
        h, first = _hashed_words(data, off)
        yield pa.RecordBatch.from_arrays(
            [rb.column(0), pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(h))],
            names=["item_id", "terms"])


def _count_terms(vocabulary):
    vocab = np.sort(np.array(vocabulary, np.int64))

    def run(batches):
        import pyarrow as pa
        total = np.zeros(len(vocab), np.int64)
        for rb in batches:
            data, off = tb.text_bytes(rb.column(0))
            for _, _, d, o in tb.blocks(data, off, BLOCK):
                h, _ = _hashed_words(d, o)
                h = h[_member(h, vocab)]
                total += np.bincount(np.searchsorted(vocab, h), minlength=len(vocab))
        k = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(vocab[k]), pa.array(total[k])], names=["term", "n"])
    return run


def _post(chosen, window):
    """Per document: its word count and the postings of the chosen terms with their context."""
    terms = np.sort(np.array(chosen, np.int64))
    width = 2 * window - 1

    def run(batches):
        import pyarrow as pa
        for rb in batches:
            data, off = tb.text_bytes(rb.column(1))
            for i, j, d, o in tb.blocks(data, off, BLOCK):
                h, first = _hashed_words(d, o)
                at = np.flatnonzero(_member(h, terms))
                doc = np.searchsorted(first, at, side="right") - 1
                cell = at[:, None] + np.arange(-(window - 1), window)
                inside = (cell >= first[doc][:, None]) & (cell < first[doc + 1][:, None])
                ctx = np.where(inside, h[np.clip(cell, 0, max(len(h) - 1, 0))] if len(h) else 0, 0)
                n = np.bincount(doc, minlength=j - i)
                ends = np.zeros(j - i + 1, np.int32)
                np.cumsum(n, out=ends[1:])
                post = pa.StructArray.from_arrays(
                    [pa.array(h[at]), pa.array(at - first[doc]),
                     pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * width),
                                              pa.array(ctx.astype(np.int64).ravel()))], names=["term", "pos", "ctx"])
                yield pa.RecordBatch.from_arrays(
                    [rb.column(0).slice(i, j - i), rb.column(2).slice(i, j - i), pa.array(np.diff(first).astype(np.int64)),
                     pa.ListArray.from_arrays(pa.array(ends), post)], names=["doc_id", "row", "n_words", "postings"])
    return run


def _match_block(docs: DataFrame, wins: list, owners: DataFrame, window: int, slop: int | None):
    """Hits of a block of distinct windows, and the items that own them."""
    spark = docs.sparkSession
    vocab = sorted({t for w in wins for t in w})
    counts = docs.select("text").mapInArrow(_count_terms(vocab), "term long, n long").groupBy("term").agg(
        F.sum("n").alias("n"))
    df = {r.term: r.n for r in counts.collect()}          # at most the block's vocabulary
    plan, chosen = [], set()
    for w, terms in enumerate(sorted(wins)):
        if any(t not in df for t in terms):
            continue
        rare = sorted(range(len(terms)), key=lambda i: (df[terms[i]], terms[i], i))
        second = next((i for i in rare if terms[i] != terms[rare[0]]), rare[0])
        plan.append((w, list(terms), terms[rare[0]], rare[0], terms[second], second))
        chosen |= {terms[rare[0]], terms[second]}
    rows = docs.withColumn("row", row_key()).mapInArrow(
        _post(sorted(chosen), window),
        "doc_id long, row string, n_words long, postings array<struct<term:long,pos:long,ctx:array<long>>>")
    forward = cut_lineage(rows.select("row", "doc_id", "n_words", "postings"), "dc-rows")
    # repeated rows share their key: one of them is indexed
    again = forward.groupBy("row").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("row")
    again = cut_lineage(again, "dc-again")
    once = forward.select("row", "postings").join(again, "row", "left_anti")
    once = once.unionByName(forward.select("row", "postings").join(again, "row", "left_semi").dropDuplicates(["row"]))
    index = once.select("row", F.explode("postings").alias("p")).select("p.term", "row", "p.pos", "p.ctx")
    index = cut_lineage(index.repartitionByRange("term", "row").sortWithinPartitions("term", "row"), "dc-index")
    table = spark.createDataFrame(plan, "win long, terms array<long>, t1 long, o1 int, t2 long, o2 int")
    owner = owners.join(F.broadcast(table.select("win", "terms")), "terms").select("win", "item_id")
    # offset-adjusted lists; the window table is bounded by the block of items
    first = index.join(F.broadcast(table), index["term"] == F.col("t1")).select(
        "row", "win", "terms", "o1", (F.col("pos") - F.col("o1")).alias("start"), "ctx").filter("start >= 0")
    second = index.select("term", "row", "pos").join(
        F.broadcast(table.select(F.col("win").alias("win2"), "t2", "o2")), F.col("term") == F.col("t2")).select(
        F.col("row").alias("row2"), "win2", (F.col("pos") - F.col("o2")).alias("start2"))
    same = (F.col("row") == F.col("row2")) & (F.col("win") == F.col("win2"))
    phrase = F.slice("ctx", window - F.col("o1"), F.size("terms"))
    hit = first.join(second, same & (F.col("start") == F.col("start2"))).withColumn("exact", phrase == F.col("terms"))
    exact = hit.filter("exact").select("row", "win", "start", F.size("terms").alias("length"), F.lit(0).alias("off"))
    if slop:
        # starts that differ by at most `slop` lie in the same or in neighbouring cells
        cell = F.floor(F.col("start") / (slop + 1))
        near = first.withColumn("cell", F.explode(F.array(cell - 1, cell, cell + 1)))
        other = second.withColumn("cell2", F.floor(F.col("start2") / (slop + 1)))
        near = near.join(other, same & (F.col("cell") == F.col("cell2"))
                         & (F.abs(F.col("start") - F.col("start2")) <= slop))
        near = near.filter(~((F.col("start") == F.col("start2")) & (phrase == F.col("terms")))).select(
            "row", "win", "start", F.size("terms").alias("length"), F.abs(F.col("start") - F.col("start2")).alias("off"))
        exact = exact.withColumn("kind", F.lit("phrase")).unionByName(near.withColumn("kind", F.lit("near")))
    else:
        exact = exact.withColumn("kind", F.lit("phrase"))
    return forward.select("row", "doc_id", "n_words"), exact, owner


def _blocks_of(items: DataFrame, window: int):
    """The distinct windows of all items, in blocks of about ``WINDOW_BLOCK``, with their owners."""
    words = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"),
                         F.col("text").cast("string").alias("text")).mapInArrow(_item_words, "item_id string, terms array<long>")
    starts = F.sequence(F.lit(1), F.greatest(F.size("terms") - window + 1, F.lit(1)))
    wins = words.filter(F.size("terms") > 0).select("item_id", F.explode(
        F.transform(starts, lambda i: F.slice("terms", i, window))).alias("terms"))
    owners = cut_lineage(wins.distinct(), "dc-windows")
    distinct = owners.select("terms").distinct()
    blocks = max(1, -(-distinct.count() // WINDOW_BLOCK))
    for b in range(blocks):
        part = distinct if blocks == 1 else distinct.filter(F.pmod(F.xxhash64("terms"), F.lit(blocks)) == b)
        yield [tuple(r.terms) for r in part.collect()], owners


def matches(docs: DataFrame, items: DataFrame, window: int = WINDOW, slop: int | None = 5) -> DataFrame:
    """``doc_id, item_id, start, length, off, kind``: every occurrence of an item's window.  ``kind``
    is ``phrase`` (all words in order) or ``near`` (the two rarest terms within ``slop`` words of
    their places, ``off`` says by how many)."""
    texts, out = doc_texts(docs), None
    for block, owners in _blocks_of(items, window):
        rows, hits, owner = _match_block(texts, block, owners, window, slop)
        m = hits.join(owner, "win").join(rows, "row").select(
            "doc_id", "item_id", "start", "length", "off", "kind").distinct()
        out = m if out is None else out.unionByName(m)
    return out


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items (array of ids), contaminated`` for every row."""
    return _judged(docs, items, window).drop("row")


def _judged(docs: DataFrame, items: DataFrame, window: int) -> DataFrame:
    """:func:`contamination` with the key ``row`` of every row."""
    texts, rows, spots, found = doc_texts(docs), None, None, None
    for block, owners in _blocks_of(items, window):
        base, hits, owner = _match_block(texts, block, owners, window, None)
        hits = cut_lineage(hits.select("row", "win", "start", "length").distinct(), "dc-hits")
        s = hits.select("row", F.explode(F.sequence("start", F.col("start") + F.col("length") - 1)).alias("spot"))
        f = hits.select("row", "win").distinct().join(owner, "win").select("row", "item_id")
        rows = base if rows is None else rows
        spots = s if spots is None else spots.unionByName(s)
        found = f if found is None else found.unionByName(f)
    n_hit = spots.distinct().groupBy("row").agg(F.count("*").alias("n_hit"))
    names = found.groupBy("row").agg(F.array_sort(F.collect_set("item_id")).alias("items"))   # bounded by the items
    none = F.array().cast("array<string>")
    return rows.join(n_hit, "row", "left").join(names, "row", "left").select(
        "row", "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"),
        F.size(F.coalesce("items", none)).cast("long").alias("n_items"), F.coalesce("items", none).alias("items"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"))


def drop_contaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """Rows of ``docs`` (all columns) without any benchmark window in their own text."""
    key = free_name(docs, "_bad")
    bad = cut_lineage(_judged(docs, items, window).filter("contaminated").select(F.col("row").alias(key)).distinct(), "dc-bad")
    return docs.join(bad, row_key() == F.col(key), "left_anti")
