"""Token ids as Simple-8b coded shards.

**Tokenizing.**  A tokenizer file of the public set, loaded once per Python worker.  A byte-level
BPE never merges across a pre-token border, and a space that does not follow white space always
starts a pre-token, and so does a single line end; texts are therefore cut before these and every
distinct piece is encoded once per worker (a bounded cache).  Where white space surrounds a cut, the
border could lie elsewhere: such texts are encoded whole, and so are texts that hold the string of an
added token (``<|endoftext|>``), which is one id.  The ids are those of encoding each text at once.

**Coding.**  A 64-bit word holds a 4-bit selector and as many ids as fit its 60 bits at one width
(60 x 1 bit ... 1 x 60 bits).  Selector 15 is the escape: its payload indexes the row's list of ids
above 60 bits.  Ids are packed in blocks of 128; the word count of every block is stored, so blocks
are found by a running sum and all blocks of a row are packed and unpacked together with numpy.

**Shards.**  Documents are range-partitioned and sorted by doc_id, so files and the rows in them are
in ascending doc_id order.  A row ``(shard, seq, doc_ids, n_tokens, n_ids, words, block_words,
escaped)`` holds whole documents of up to ``ROW_IDS`` ids, or one longer document.

Edge cases.  A null text is empty and holds only the end id.  Rows with a null doc_id come first.
Rows of one doc_id, null too, are spread over the
partitions by a hash of their text and ordered by it, then by text; repeated rows follow each other.  Extra columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import itertools
import os
import re
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.worker import worker_state
from . import textblocks as tb
from .common import doc_texts, scratch_path

TOKENIZER = "byte_bpe_50k.json"
END_ID = 2
BLOCK_IDS = 128
ROW_IDS = 1 << 18
CACHE_PIECES = 600_000
JOINED = 64                 # new pieces encoded as one string

# ids per word and bits per id, by selector (fixed values of the coding)
COUNTS = np.array([60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1, 0, 1])
WIDTHS = np.array([1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60, 0, 0])
ESCAPE = 15

SHARD = ("shard int, seq long, doc_ids array<long>, n_tokens array<long>, n_ids long, words binary, "
         "block_words binary, escaped array<long>")


def _bit_length(x: np.ndarray) -> np.ndarray:
    """Bit length by 16-bit digits."""
    table = worker_state().get("bit-length")
    if table is None:
        table = worker_state()["bit-length"] = np.frexp(np.arange(1 << 16, dtype=np.float64))[1].astype(np.uint8)
    bits = table[x & np.uint64(0xFFFF)]
    for shift in (16, 32, 48):
        if x.size and int(x.max()) >> shift:
            digit = (x >> np.uint64(shift)) & np.uint64(0xFFFF)
            bits = np.where(digit > 0, table[digit] + np.uint8(shift), bits)
    return bits


def pack(ids: np.ndarray):
    """Simple-8b words, the word count of each block of 128 ids, and the escaped ids."""
    n = len(ids)
    blocks = -(-n // BLOCK_IDS)
    pad = int(COUNTS.max())
    grid = np.zeros((blocks, BLOCK_IDS + pad), np.uint64)
    flat = np.zeros(blocks * BLOCK_IDS, np.uint64)
    flat[:n] = ids
    grid[:, :BLOCK_IDS] = flat.reshape(blocks, BLOCK_IDS)
    size = np.full(blocks, BLOCK_IDS)
    if blocks:
        size[-1] = n - (blocks - 1) * BLOCK_IDS
    bits = _bit_length(grid)
    best = np.full((blocks, BLOCK_IDS), ESCAPE, np.uint8)
    reach = {1: bits}                                   # widest id of the next 1, 2, 4 ... ids
    p = 1
    while p * 2 <= pad:
        a = reach[p].copy()
        a[:, :-p] = np.maximum(a[:, :-p], reach[p][:, p:])
        reach[2 * p] = a
        p *= 2
    for sel in range(13, -1, -1):                       # the most ids win
        c, w = int(COUNTS[sel]), int(WIDTHS[sel])
        p = 1 << (c.bit_length() - 1)
        top = np.maximum(reach[p][:, :BLOCK_IDS], reach[p][:, c - p: c - p + BLOCK_IDS])
        best[top <= w] = sel
    pos = np.zeros(blocks, np.int64)
    act = np.arange(blocks)
    at_block, at_pos, at_sel = [], [], []
    while len(act):
        sel = best[act, pos[act]]
        at_block.append(act)
        at_pos.append(pos[act])
        at_sel.append(sel)
        pos[act] += COUNTS[sel]
        act = act[pos[act] < size[act]]
    if not at_block:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint16), np.zeros(0, np.uint64)
    blk, at, sel = np.concatenate(at_block), np.concatenate(at_pos), np.concatenate(at_sel)
    order = np.argsort(blk, kind="stable")
    blk, at, sel = blk[order], at[order], sel[order]
    words = sel.astype(np.uint64) << np.uint64(60)
    for s in range(14):
        k = np.flatnonzero(sel == s)
        for j in range(int(COUNTS[s])):
            words[k] |= grid[blk[k], at[k] + j] << np.uint64(j * int(WIDTHS[s]))
    esc = np.flatnonzero(sel == ESCAPE)
    words[esc] |= np.arange(len(esc), dtype=np.uint64)
    return words, np.bincount(blk, minlength=blocks).astype(np.uint16), grid[blk[esc], at[esc]]


def unpack(words: np.ndarray, block_words: np.ndarray, n: int, escaped: np.ndarray) -> np.ndarray:
    """The ids of a row; every selector is unpacked for all blocks at once."""
    blocks = len(block_words)
    out = np.zeros(blocks * BLOCK_IDS + int(COUNTS.max()), np.uint64)
    if not len(words):
        return out[:0]
    sel = (words >> np.uint64(60)).astype(np.int64)
    cnt = COUNTS[sel]
    first_word = np.cumsum(block_words.astype(np.int64)) - block_words
    before = np.cumsum(cnt) - cnt
    blk = np.repeat(np.arange(blocks), block_words)
    at = before - before[first_word][blk] + blk * BLOCK_IDS
    limit = np.minimum((blk + 1) * BLOCK_IDS, n)
    for s in range(14):
        k = np.flatnonzero(sel == s)
        if not len(k):
            continue
        w, mask = int(WIDTHS[s]), np.uint64((1 << int(WIDTHS[s])) - 1)
        for j in range(int(COUNTS[s])):
            use = k[at[k] + j < limit[k]]
            out[at[use] + j] = (words[use] >> np.uint64(j * w)) & mask
    k = np.flatnonzero(sel == ESCAPE)
    if len(k):
        out[at[k]] = escaped[(words[k] & np.uint64((1 << 60) - 1)).astype(np.int64)]
    return out[:n]


class _Codes(dict):
    """Codes of pieces; an unknown one takes the next code and is noted in ``new``."""

    def __init__(self, known=()):
        super().__init__(known)
        self.base, self.new = 0, []

    def __missing__(self, piece: str) -> int:
        code = self[piece] = self.base + len(self.new)
        self.new.append(piece)
        return code


class PieceEncoder:
    """Encodes texts piece by piece with a bounded cache of the ids of distinct pieces.

    Missing pieces of a call are encoded in one batch.  A full cache keeps the half of its pieces that was
    used most."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(path)
        # an added token is found before the text is cut into pre-tokens, also across white space
        added = [t.content for t in self.tok.get_added_tokens_decoder().values() if t.content]
        self.added = re.compile("|".join(map(re.escape, added)), re.IGNORECASE) if added else None
        # bytes of every id (a byte-level vocabulary writes a byte as one character): they part the ids of joined pieces
        size = {i: len(w) for w, i in self.tok.get_vocab(with_added_tokens=True).items()}
        self.size_of = np.zeros(max(size, default=0) + 1, np.int64)
        self.size_of[list(size)] = list(size.values())
        self.joins = not any(re.search(r"\s", a) for a in added)
        # sentence marks that are one id after a letter
        after = {m: self.tok.encode("a" + m, add_special_tokens=False).ids for m in ".,;:!?"}
        self.marks = {m: x[1] for m, x in after.items() if len(x) == 2}
        # piece at the start of a text / after a space -> its code
        self.first, self.rest = {}, _Codes()
        self.n = self.used = 0
        self.starts = np.zeros(1024, np.int32)
        self.lens = np.zeros(1024, np.int32)
        self.hits = np.zeros(1024, np.int32)
        self.flags = np.zeros(1024, np.uint8)            # 1: starts with white space after the cut, 2: ends with it
        self.ids = np.zeros(4096, np.uint32)

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, np.uint32)

    def _gather(self, codes: np.ndarray):
        ln = self.lens[codes].astype(np.int64)
        total = np.cumsum(ln)
        n = int(total[-1]) if len(total) else 0
        return self.ids[np.arange(n) + np.repeat(self.starts[codes] - (total - ln), ln)], ln

    def _store(self, codes, ids, ln):
        while int(codes.max()) >= len(self.starts):
            self.starts, self.lens, self.flags, self.hits = (
                np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.lens, self.flags, self.hits))
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.lens[codes] = ln
        self.starts[codes] = self.used + np.cumsum(ln) - ln
        self.ids[self.used: self.used + len(ids)] = ids
        self.used += len(ids)

    def _encode_each(self, texts: list[str]):
        """Flat ids of texts and the number of ids of each."""
        x = [e.ids for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]
        ln = np.fromiter(map(len, x), np.int64, len(x))
        return np.fromiter(itertools.chain.from_iterable(x), np.uint32, int(ln.sum())), ln

    def _encode_joined(self, texts: list[str]):
        """:meth:`_encode_each` for texts that start with a pre-token border and end without white space: many
        are encoded in one string, and the bytes of the ids tell where each ends."""
        if not self.joins:
            return self._encode_each(texts)
        ids, _ = self._encode_each(["".join(texts[i: i + JOINED]) for i in range(0, len(texts), JOINED)])
        upto = np.cumsum(self.size_of[ids])
        ends = np.cumsum(np.fromiter((len(t) if t.isascii() else len(t.encode()) for t in texts), np.int64, len(texts)))
        last = np.searchsorted(upto, ends)
        if len(upto) != last[-1] + 1 or (upto[last] != ends).any():        # not a byte-level vocabulary
            return self._encode_each(texts)
        return ids, np.diff(last, prepend=-1)

    def _add(self, new, heads):
        """Encode the pieces ``new`` as codes from ``n`` on; a space was cut before all but those with codes in ``heads``.

        A sentence mark after an ASCII letter is a pre-token of its own, so a word that carries one takes
        the ids of the bare word; other pieces without white space of their own are encoded joined."""
        marked, bare, mark_ids = [], [], []
        alone, alone_code = [], []
        plain, plain_code = [], []
        flagged, flags = [], []
        rest, code = self.rest, self.n - 1
        for w in new:                                 # grows by the bare words that are not known yet
            code += 1
            cut = code not in heads
            if cut and w.isalpha():
                plain.append(" " + w)
                plain_code.append(code)
                continue
            line = w[:1] == "\n"
            parts = (w[1:] if line else w).split() if cut else ()
            if len(parts) != 1 or len(parts[0]) != len(w) - line:
                flagged.append(code)
                flags.append((cut and (not w or w[0].isspace())) + 2 * ((cut and not w) or (w != "" and w[-1].isspace())))
                alone.append(" " + w if cut and not line else w)
                alone_code.append(code)
                continue
            if line:
                flagged.append(code)
                flags.append(1)
            elif w[-1] in self.marks and len(w) > 1 and w[-2].isascii() and w[-2].isalpha():
                k = rest.get(w[:-1])
                if k is None:
                    k = rest[w[:-1]] = self.n + len(new)
                    new.append(w[:-1])
                marked.append(code)
                bare.append(k)
                mark_ids.append(self.marks[w[-1]])
                continue
            plain.append(w if line else " " + w)
            plain_code.append(code)
        base, self.n = self.n, self.n + len(new)
        if alone:
            self._store(np.array(alone_code), *self._encode_each(alone))
        if plain:
            self._store(np.array(plain_code), *self._encode_joined(plain))
        if marked:
            ids, ln = self._gather(np.array(bare))
            self._store(np.array(marked), np.insert(ids, np.cumsum(ln), np.array(mark_ids, np.uint32)), ln + 1)
        self.hits[base: self.n] = 0
        self.flags[base: self.n] = 0
        if flagged:
            self.flags[np.array(flagged)] = flags

    def _shrink(self):
        keep = np.sort(np.argpartition(-self.hits[: self.n], self.n // 2)[: self.n // 2])
        ids, ln = self._gather(keep)
        code = np.full(self.n, -1)
        code[keep] = np.arange(len(keep))
        code = code.tolist()
        self.first = {p: code[c] for p, c in self.first.items() if code[c] >= 0}
        self.rest = _Codes({p: code[c] for p, c in self.rest.items() if code[c] >= 0})
        self.n, self.used = len(keep), len(ids)
        self.flags[: self.n] = self.flags[keep]
        self.lens[: self.n] = ln
        self.starts[: self.n] = np.cumsum(ln) - ln
        self.hits[: self.n] = 0
        self.ids[: self.used] = ids

    def encode(self, texts: list[str]):
        """Flat ids of all texts and the number of ids of each."""
        if not texts:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        if self.n > CACHE_PIECES:
            self._shrink()
        first, rest = self.first, self.rest
        rest.base, rest.new = self.n, []
        new, code_of = rest.new, rest.__getitem__
        heads, codes, counts = set(), [], []
        special = []                                      # texts with an added token have no pieces
        for i, t in enumerate(texts):
            if self.added is not None and self.added.search(t):
                special.append(i)
                t = ""
            p = t.replace("\n", " \n").split(" ")
            head = first.get(p[0])
            if head is None:
                head = first[p[0]] = self.n + len(new)
                heads.add(head)
                new.append(p[0])
            c = np.empty(len(p), np.int32)
            c[0] = head
            c[1:] = np.fromiter(map(code_of, p[1:]), np.int32, len(p) - 1)
            codes.append(c)
            counts.append(len(p))
        if new:
            self._add(new, heads)
        code = np.concatenate(codes)
        self.hits[code] += 1                              # texts of one call count once
        count = np.array(counts, np.int64)
        ends = np.cumsum(count)
        flag = self.flags[code]
        # white space on both sides of a cut: the border may lie elsewhere
        bad = np.flatnonzero((flag[:-1] & 2 > 0) & (flag[1:] & 1 > 0)) + 1
        whole = np.union1d(np.searchsorted(ends, bad, side="right"), np.array(special, np.int64))
        ids, ln = self._gather(code)
        per = np.add.reduceat(ln, ends - count)
        if len(whole):
            cut = np.split(ids, np.cumsum(per)[:-1])
            for i in whole:
                cut[i] = self._whole(texts[i])
            per = np.array([len(x) for x in cut], np.int64)
            ids = np.concatenate(cut)
        return ids, per


def _tokenizer_path(name: str) -> str:
    if os.path.isabs(name):
        return name
    import public_tokenizers
    return public_tokenizers.path(name)


def worker_encoder(name: str) -> PieceEncoder:
    """The encoder of this Python worker (loaded once, kept across tasks)."""
    held = worker_state().setdefault("piece-encoders", {})
    if name not in held:
        held[name] = PieceEncoder(_tokenizer_path(name))
    return held[name]


def _with_end(ids: np.ndarray, per: np.ndarray, end_id: int) -> np.ndarray:
    out = np.full(len(ids) + len(per), end_id, np.uint32)
    at = np.arange(len(ids)) + np.repeat(np.arange(len(per)), per)
    out[at] = ids
    return out


def _shard_rows(tokenizer: str, end_id: int):
    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext
        enc = worker_encoder(tokenizer)
        part, seq = TaskContext.get().partitionId(), 0
        for rb in batches:
            col = rb.column(1)
            _, off = tb.text_bytes(col)
            lo = 0
            while lo < rb.num_rows:
                # about as many bytes as a row holds ids: never fewer than one document
                hi = max(lo + 1, int(np.searchsorted(off, off[lo] + ROW_IDS, side="right")) - 1)
                texts = [t or "" for t in col.slice(lo, hi - lo).to_pylist()]
                ids, per = enc.encode(texts)
                ids = _with_end(ids, per, end_id)
                words, bw, esc = pack(ids)
                yield pa.RecordBatch.from_arrays([
                    pa.array([part], pa.int32()), pa.array([seq], pa.int64()),
                    pa.array([rb.column(0).slice(lo, hi - lo).to_pylist()], pa.list_(pa.int64())),
                    pa.array([(per + 1).tolist()], pa.list_(pa.int64())), pa.array([len(ids)], pa.int64()),
                    pa.array([words.astype("<u8").tobytes()], pa.binary()),
                    pa.array([bw.astype("<u2").tobytes()], pa.binary()),
                    pa.array([esc.view(np.int64).tolist()], pa.list_(pa.int64()))],
                    names=["shard", "seq", "doc_ids", "n_tokens", "n_ids", "words", "block_words", "escaped"])
                lo, seq = hi, seq + 1
    return run


def write_shards(docs: DataFrame, path: str, tokenizer: str = TOKENIZER, end_id: int = END_ID) -> None:
    """Tokenize ``docs`` and write the shards under ``path`` in ascending doc_id order."""
    t = doc_texts(docs)
    spread = F.xxhash64("text")
    t = t.repartitionByRange("doc_id", spread).sortWithinPartitions("doc_id", spread, "text")
    # fixed slots leave zero bits, which a light compression of the file takes out
    t.mapInArrow(_shard_rows(tokenizer, end_id), SHARD).write.mode("overwrite").option("compression", "zstd").parquet(path)


def _doc_rows(batches):
    import pyarrow as pa
    for rb in batches:
        for r in range(rb.num_rows):
            shard, seq, doc_ids, n_tok, n_ids, words, bw, esc = (rb.column(i)[r] for i in range(8))
            ids = unpack(np.frombuffer(words.as_buffer(), "<u8"), np.frombuffer(bw.as_buffer(), "<u2"), n_ids.as_py(),
                         np.array(esc.as_py(), np.int64).view(np.uint64)).astype("<u4")
            per = np.asarray(n_tok.values, dtype=np.int64)
            ends = np.cumsum(per)
            raw = memoryview(ids.tobytes())
            crc = [zlib.crc32(raw[4 * (e - k): 4 * e]) for e, k in zip(ends.tolist(), per.tolist())]
            k = len(per)
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(k, shard.as_py(), np.int32)), pa.array(np.full(k, seq.as_py(), np.int64)),
                doc_ids.values.cast(pa.int64()), pa.array(ends - per), pa.array(per), pa.array(crc, pa.int64())],
                names=["shard", "seq", "doc_id", "local", "n_tokens", "ids_crc32"])


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, from the written shards alone.

    ``start`` is a two-level running sum: rows inside a shard, then the totals of the shards (one
    row per shard)."""
    rows = spark.read.parquet(path)
    docs = rows.select("shard", "seq", "doc_ids", "n_tokens", "n_ids", "words", "block_words", "escaped").mapInArrow(
        _doc_rows, "shard int, seq long, doc_id long, local long, n_tokens long, ids_crc32 long")
    back = (Window.unboundedPreceding, -1)
    inside = Window.partitionBy("shard").orderBy("seq").rowsBetween(*back)
    at = rows.select("shard", "seq", "n_ids").withColumn("in_shard", F.coalesce(F.sum("n_ids").over(inside), F.lit(0)))
    shards = rows.groupBy("shard").agg(F.sum("n_ids").alias("total"))
    shards = shards.withColumn("base", F.coalesce(F.sum("total").over(Window.orderBy("shard").rowsBetween(*back)),
                                                  F.lit(0)))
    at = at.join(shards.drop("total"), "shard").select("shard", "seq", (F.col("base") + F.col("in_shard")).alias("row_start"))
    return docs.join(at, ["shard", "seq"]).select("doc_id", (F.col("row_start") + F.col("local")).alias("start"),
                                                  "n_tokens", "ids_crc32")


def token_table(docs: DataFrame, tokenizer: str = TOKENIZER, end_id: int = END_ID, path: str | None = None) -> DataFrame:
    """Write the shards (under ``path`` or the shared scratch folder) and read them back."""
    spark = docs.sparkSession
    path = path or scratch_path(spark, "token-shards")
    write_shards(docs, path, tokenizer, end_id)
    return read_documents(spark, path)
