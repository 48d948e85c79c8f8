"""Ranked lexical search over tries of frequency-ordered term vectors.

Terms are runs of digits, ASCII letters and all characters above 0x7F, with A-Z lower-cased.  A term's
weight, a document's length factor ``m`` and the score are those of the contract of
``op13_lexical_search``: integers, so engines agree.

1. *Restricted vectors.*  One pass over the texts keeps, for every document, its number of terms and the
   counts of the query vocabulary (numpy on byte blocks); the vectors are written once.
2. *Statistics.*  Documents, terms and document frequencies are aggregates over that table; the terms of a
   block of items are ordered by document frequency, the most frequent first.
3. *Tries.*  Every task puts the vectors of up to ``MATRIX_BYTES`` into a trie: vectors in frequency order
   share their prefix as one path, and paths without a branch are one node.  Every node keeps the largest
   count of each term and the smallest ``m`` of its subtree, which bound the score of all documents below it.
4. *Branch and bound.*  For every item the trie is searched depth first, the child with the best bound
   first; a subtree is left out when its bound is below the k-th best score so far, or equals it and its
   smallest doc_id is not smaller.  The best of one trie are the threshold for the task's next.
5. *Merge.*  Each task answers with at most k rows an item; a ranked merge in two levels keeps the first k.

Documents are never grouped by a key, so no term, source or group of copies is hot; copies are leaves of
one node.  The items are a stated query set, taken in blocks of about ``BLOCK_TERMS`` terms (an item is
never cut); a block's vocabulary and weights are what travels to the tasks.

Edge cases.  Null or term-less texts have no terms, count for nothing and are never found; items without
terms get no rows.  Every row is a document or an item of its own, so repeated rows are all ranked and
repeated items all answered.  A null doc_id comes last among equal scores.  Extra columns are ignored; empty
tables give an empty result.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textblocks as tb
from .common import cut_lineage, doc_texts

TOP = 10
BLOCK_TERMS = 1 << 14
MATRIX_BYTES = 96 << 20
TEXT_BLOCK = 1 << 20
SMALL = 64                      # a subtree of so few documents is one node
PARTS = 64

_NO_ID = np.iinfo(np.int64).max


def _hashed_terms(data, off):
    low = tb.lower_ascii(data)
    start, end, first = tb.words(low, off, tb.NON_ALNUM)
    return tb.span_hash(tb.prefix_hash(low, tb.byte_codes(57)), start, end).view(np.int64), first


def _item_terms(batches):
    import pyarrow as pa
    from pyspark import TaskContext
    at = TaskContext.get().partitionId() << 40
    for rb in batches:
        data, off = tb.text_bytes(rb.column(1))
        h, first = _hashed_terms(data, off)
        terms = [np.unique(h[a:b]).tolist() for a, b in zip(first.tolist(), first[1:].tolist())]
        yield pa.RecordBatch.from_arrays(
            [pa.array(at + np.arange(rb.num_rows)), rb.column(0), pa.array(terms, pa.list_(pa.int64()))],
            names=["item", "item_id", "terms"])
        at += rb.num_rows


def _vectors(vocabulary):
    """Per document with terms: their number, and the vocabulary's terms (by index) with their counts."""
    vocab = np.sort(np.array(vocabulary, np.int64))

    def run(batches):
        import pyarrow as pa
        for rb in batches:
            data, off = tb.text_bytes(rb.column(1))
            for i, j, d, o in tb.blocks(data, off, TEXT_BLOCK):
                h, first = _hashed_terms(d, o)
                at = np.minimum(np.searchsorted(vocab, h), max(len(vocab) - 1, 0))
                hit = np.flatnonzero(vocab[at] == h) if len(vocab) else at[:0]
                doc = np.searchsorted(first, hit, side="right") - 1
                key, tf = np.unique(doc * len(vocab) + at[hit], return_counts=True)
                n = np.diff(first).astype(np.int64)
                keep = np.flatnonzero(n > 0)
                ends = np.searchsorted(key, np.append(keep, j - i) * len(vocab)).astype(np.int32)
                ends[-1] = len(key)
                yield pa.RecordBatch.from_arrays(
                    [rb.column(0).slice(i, j - i).take(pa.array(keep)), pa.array(n[keep]),
                     pa.ListArray.from_arrays(pa.array(ends), pa.array((key % max(len(vocab), 1)).astype(np.int32))),
                     pa.ListArray.from_arrays(pa.array(ends), pa.array(tf.astype(np.int32)))],
                    names=["doc_id", "n", "terms", "tfs"])
    return run


class Trie:
    """Vectors in frequency order as a trie with bounds.

    Node ``i < docs`` is the leaf of document ``i`` in lexicographic order; inner nodes follow.  ``top``
    holds the largest count of each term, ``low`` the smallest ``m`` and ``least`` the smallest id of a
    node's subtree (for a leaf its own)."""

    def __init__(self, ids, m, ends, ranks, tfs, width):
        n = len(ids)
        order_type = ">u2" if width <= 1 << 16 else ">u4"
        step = np.dtype(order_type).itemsize
        raw, cut = ranks.astype(order_type).tobytes(), (ends * step).tolist()
        keys = [raw[a:b] for a, b in zip(cut, cut[1:])]
        self.order = np.array(sorted(range(n), key=keys.__getitem__), np.int64)
        size = np.diff(ends)[self.order]
        start = ends[:-1][self.order]
        shared = np.zeros(n, np.int64)                       # common prefix with the document before
        live = np.arange(1, n)
        while len(live):
            t = shared[live]
            live = live[(t < size[live]) & (t < size[live - 1])]
            t = shared[live]
            live = live[ranks[start[live] + t] == ranks[start[live - 1] + t]]
            shared[live] += 1
        kind = np.uint16 if tfs.max(initial=0) < 1 << 16 else np.int32
        self.top = np.zeros((2 * n, width), kind)
        row = np.empty(n, np.int64)
        row[self.order] = np.arange(n)
        self.top[np.repeat(row, np.diff(ends)), ranks] = tfs
        self.low, self.least = np.full(2 * n, _NO_ID), np.full(2 * n, _NO_ID)
        self.low[:n], self.least[:n] = m[self.order], ids[self.order]
        self.docs, self.inner, self.children = n, n, []
        self.root = self._grow(shared.tolist())

    def _node(self, children):
        c, node = np.array(children), self.inner
        self.top[node] = self.top[c].max(axis=0)
        self.low[node], self.least[node] = self.low[c].min(), self.least[c].min()
        self.children.append(c)
        self.inner += 1
        return node

    def _close(self, children):
        """A finished subtree: a list of leaves while it is small, else a node."""
        if all(isinstance(c, list) for c in children) and sum(map(len, children)) <= SMALL:
            return [leaf for c in children for leaf in c]
        return self._node([(self._node(c) if len(c) > 1 else c[0]) if isinstance(c, list) else c for c in children])

    def _grow(self, shared):
        open_nodes = [(0, [])]                               # depth and children of the path to the last leaf
        for leaf in range(self.docs):
            depth = shared[leaf + 1] if leaf + 1 < self.docs else -1
            child = [leaf]
            while open_nodes and open_nodes[-1][0] > depth:
                _, children = open_nodes.pop()
                children.append(child)
                child = self._close(children) if len(children) > 1 else children[0]
            if not open_nodes:
                return self._node(child) if isinstance(child, list) else child
            if open_nodes[-1][0] == depth:
                open_nodes[-1][1].append(child)
            else:
                open_nodes.append((depth, [child]))
        return None

    def bound(self, nodes, terms, weights):
        """Score bounds of nodes; for a leaf this is the score."""
        tf = self.top[nodes[:, None], terms].astype(np.int64)
        r, c = np.nonzero(tf)
        tf = tf[r, c]
        part = weights[c] * ((1_000_000_000 * tf) // (1000 * tf + 8 * self.low[nodes[r]]))
        out = np.zeros(len(nodes), np.int64)
        np.add.at(out, r, part)
        return out

    def search(self, terms, weights, best, k):
        """Improve ``best``, a list of ``(-score, id)`` in order with at most ``k`` entries."""
        if self.root is None:
            return best
        stack = [(_NO_ID, -1, np.array([self.root]))]
        while stack:
            bound, least, nodes = stack.pop()
            if len(best) == k and (-bound, least) >= best[-1]:
                continue
            score = self.bound(nodes, terms, weights)
            alive = score > 0
            if len(best) == k:
                worst, last = -best[-1][0], best[-1][1]
                alive &= (score > worst) | ((score == worst) & (self.least[nodes] < last))
            nodes, score = nodes[alive], score[alive]
            leaf = nodes < self.docs
            if leaf.any():
                own, s = self.least[nodes[leaf]], score[leaf]
                first = np.lexsort((own, -s))[:k]
                best = sorted([*best, *zip((-s[first]).tolist(), own[first].tolist())])[:k]
            inner, s = nodes[~leaf], score[~leaf]
            for i in np.argsort(s, kind="stable").tolist():   # the best bound is taken first
                stack.append((int(s[i]), int(self.least[inner[i]]), self.children[inner[i] - self.docs]))
        return best


def _search(rank, weights, items, docs, terms_total, k):
    """Top ``k`` of every item over the documents of a task."""
    width = len(weights)
    size = max(64, MATRIX_BYTES // (4 * max(width, 1)))

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext
        best = {i: [] for i, _ in items}

        def use(held):
            ids, m = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
            lens = np.concatenate([h[2] for h in held])
            ranks, tfs = np.concatenate([h[3] for h in held]), np.concatenate([h[4] for h in held])
            doc = np.repeat(np.arange(len(ids)), lens)
            order = np.lexsort((ranks, doc))
            trie = Trie(ids, m, np.concatenate([[0], np.cumsum(lens)]), ranks[order], tfs[order], width)
            for i, terms in items:
                best[i] = trie.search(terms, weights[terms], best[i], k)

        held, n = [], 0
        for rb in batches:
            # documents without a query term cannot be found
            lens = np.asarray(rb.column(2).value_lengths().fill_null(0))
            rb = rb.take(pa.array(np.flatnonzero(lens)))
            lo = 0
            while lo < rb.num_rows:
                hi = min(rb.num_rows, lo + size - n)
                part = rb.slice(lo, hi - lo)
                words = [int(x) for x in np.asarray(part.column(1))]
                held.append((np.asarray(part.column(0).fill_null(_NO_ID)),
                             np.array([10 + (90 * w * docs) // terms_total for w in words], np.int64),
                             np.asarray(part.column(2).value_lengths()), rank[np.asarray(part.column(2).flatten())],
                             np.asarray(part.column(3).flatten())))
                n += hi - lo
                if n == size:
                    use(held)
                    held, n = [], 0
                lo = hi
        if held:
            use(held)
        rows = [(i, -s, d) for i, b in best.items() for s, d in b]
        if rows:
            ids = np.array([r[2] for r in rows], np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()),
                 pa.array(ids, mask=ids == _NO_ID), pa.array([TaskContext.get().partitionId() % PARTS] * len(rows), pa.int32())],
                names=["item", "score", "doc_id", "part"])
    return run


def _weight(docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * docs + 2) / (2 * df + 1)))


def _search_block(texts: DataFrame, block, k: int):
    """``item, score, doc_id`` candidates of a block of items: at most ``k`` of each task and item."""
    vocab = sorted({t for r in block for t in r.terms})
    vectors = cut_lineage(texts.mapInArrow(_vectors(vocab), "doc_id long, n long, terms array<int>, tfs array<int>"), "ls-vectors")
    total = vectors.agg(F.count("*").alias("docs"), F.sum("n").alias("terms")).first()
    found = vectors.select(F.explode("terms").alias("t")).groupBy("t").count().collect()      # at most the vocabulary
    df = {r.t: r["count"] for r in found}
    rank = np.zeros(len(vocab), np.int64)
    by_frequency = np.array(sorted(df, key=lambda t: (-df[t], t)), np.int64)
    rank[by_frequency] = np.arange(len(by_frequency))
    weights = np.array([_weight(total.docs, df[t]) for t in by_frequency.tolist()], np.int64)
    at = {h: i for i, h in enumerate(vocab)}
    items = [(r.item, np.sort(rank[[at[h] for h in r.terms if at[h] in df]])) for r in block]
    items = [(i, t) for i, t in items if len(t)]
    return vectors.mapInArrow(_search(rank, weights, items, total.docs, total.terms or 1, k),
                              "item long, score long, doc_id long, part int")


def search(docs: DataFrame, items: DataFrame, k: int = TOP) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` best documents of every item with a score above 0."""
    kind = items.schema["item_id"].dataType.simpleString()
    asked = cut_lineage(items.select("item_id", F.col("text").cast("string").alias("text")).mapInArrow(
        _item_terms, f"item long, item_id {kind}, terms array<long>"), "ls-items").filter(F.size("terms") > 0)
    terms = asked.agg(F.sum(F.size("terms"))).first()[0] or 0
    blocks = max(1, -(-terms // BLOCK_TERMS))
    texts, hits = doc_texts(docs), None
    for b in range(blocks):
        part = asked if blocks == 1 else asked.filter(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b)
        h = _search_block(texts, part.select("item", "terms").collect(), k)
        hits = h if hits is None else hits.unionByName(h)
    best = (F.desc("score"), F.asc_nulls_last("doc_id"))
    for keys in (("item", "part"), ("item",)):
        hits = hits.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*best))).filter(F.col("rank") <= k)
    return hits.join(asked.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")
