"""BPE encoding and decoding with content-defined chunk reuse.

**Chunks.**  A rolling hash of the last 16 bytes cuts every text where its top bits are zero (on average
every ``2 ** CUT_BITS`` bytes, never inside a character, never below ``MIN_CHUNK`` or above ``MAX_CHUNK``
bytes), so equal passages fall into equal chunks wherever they stand.  A chunk is known by a 128-bit
fingerprint.

**Encoded once.**  Chunks go to a cell by fingerprint; the cell encodes each distinct chunk of the whole
table once and answers every block of documents that asked for it.  A task sends the text of a chunk only
the first time it meets it, and a block asks once for a chunk however often it holds it: a chunk that all
documents share costs one text a task and one fingerprint a block.

**Joins.**  The ids at the two ends of a chunk may differ from those inside the whole text.  White space
after an ASCII character that is none is a border that a tokenizer of this kind always cuts at.  From the
last but one border of the left chunk to the second of the right one the text is encoded again; when the
new ids agree with both chunks between their outer and inner borders, they replace what lies between the
inner ones.  Otherwise the window is widened (the next chunk is taken in where one has no borders, then
the number of borders doubles) until both sides agree or the whole text has been encoded.

**Decoding.**  Ids become bytes by the table of the vocabulary, invalid UTF-8 becomes U+FFFD.

Texts (block sorting) and ids travel compressed.  Blocks hold about ``BLOCK_BYTES`` of text or one longer document, cells a
bounded share of the table (one for each shuffle partition), so tasks work in bounded memory.
Documents are never grouped by a key of theirs, so no source or group of copies is hot.

Edge cases.  A null or empty text has no ids and decodes to the empty text.  A text that holds the string
of an added token is one chunk.  Rows with null or repeated doc_ids and repeated rows stay as they are.
Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import bz2
import hashlib
import json

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.worker import worker_state
from . import textblocks as tb
from .common import doc_texts
from .token_binary import TOKENIZER, _tokenizer_path, worker_encoder

CUT_BITS = 9
MIN_CHUNK = 128
MAX_CHUNK = 8_192
BLOCK_BYTES = 8 << 20
CELLS_PER_PARTITION = 1         # of a shuffle
MARK = 12                       # bytes of a fingerprint
SENT = 200_000                  # fingerprints a task remembers as sent
ENCODE_BYTES = 1 << 20
LEVEL = 6

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_SOLID = np.zeros(256, bool)
_SOLID[0x21:0x7F] = True

ROWS = "cell long, kind int, block long, a binary, b binary, c binary"
TEXTS, ASKED, RECIPE = 0, 1, 2


def _codes() -> np.ndarray:
    return (tb.byte_codes(83) >> np.uint64(32)).astype(np.uint32)


def rolling(data: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Hash of the 16 bytes up to each position (a byte's code shifted by its distance), by doubling."""
    h = codes[data]
    for step in (1, 2, 4, 8):
        longer = h.copy()
        longer[step:] += h[:-step] << np.uint32(step)
        h = longer
    return h


def cut_points(data: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Positions where a chunk may start: after a byte with the right hash, at the start of a character."""
    out, n, step = [], len(data), 1 << 20
    for lo in range(0, n, step):
        lead = max(0, lo - 15)
        part = data[lead: lo + step]
        k = np.flatnonzero(rolling(part, codes) >> np.uint32(32 - CUT_BITS) == 0) + lead + 1
        out.append(k[(k > lo) & (k < n)])
    k = np.concatenate(out) if out else np.zeros(0, np.int64)
    return k[(data[k] & 0xC0) != 0x80]


def chunks_of(start: int, end: int, points, data) -> list[int]:
    """Ends of the chunks of ``data[start:end]``, given the possible cuts inside it in order."""
    out, at = [], start
    for p in [*points, end]:
        while p - at > MAX_CHUNK:
            cut = at + MAX_CHUNK
            while (data[cut] & 0xC0) == 0x80:
                cut -= 1
            out.append(cut)
            at = cut
        if p == end or p - at >= MIN_CHUNK:
            out.append(p)
            at = p
    return out


def _row(cell, kind, block, a, b, c):
    import pyarrow as pa
    return pa.RecordBatch.from_arrays(
        [pa.array([cell], pa.int64()), pa.array([kind], pa.int32()), pa.array([block], pa.int64()),
         pa.array([a], pa.binary()), pa.array([b], pa.binary()), pa.array([c], pa.binary())],
        names=["cell", "kind", "block", "a", "b", "c"])


def _cut(tokenizer: str, cells: int):
    def run(batches):
        import zstandard
        from pyspark import TaskContext
        added, codes = worker_encoder(tokenizer).added, _codes()
        z = zstandard.ZstdCompressor(level=LEVEL)
        block, sent = TaskContext.get().partitionId() << 32, set()
        ids, counts, own, index, texts, held = [], [], [], {}, {}, 0

        def flush():
            order = sorted(index, key=lambda f: int.from_bytes(f[:8], "little") % cells)
            at, groups = 0, []
            keys = [int.from_bytes(f[:8], "little") % cells for f in order]
            for i in range(1, len(order) + 1):
                if i == len(order) or keys[i] != keys[at]:
                    groups.append((keys[at], order[at:i]))
                    at = i
            for cell, fps in groups:
                new = [f for f in fps if f in texts]
                if new:
                    yield _row(cell, TEXTS, block, b"", np.array([len(texts[f]) for f in new], "<i4").tobytes(),
                               bz2.compress(b"".join(texts[f] for f in new)))
                yield _row(cell, ASKED, block, b"".join(fps), np.array([index[f] for f in fps], "<i4").tobytes(), None)
            doc_ids = np.array([0 if i is None else i for i in ids], "<i8")
            none = np.array([i is None for i in ids], np.uint8)
            yield _row(block % cells, RECIPE, block, doc_ids.tobytes() + none.tobytes(), np.array(counts, "<i4").tobytes(),
                       z.compress(np.array(own, "<i4").tobytes()))

        for rb in batches:
            data, off = tb.text_bytes(rb.column(1))
            doc_id = rb.column(0).to_pylist()
            for i, j, d, o in tb.blocks(data, off):
                points = cut_points(d, codes)
                split = np.searchsorted(points, o).tolist()
                points, o, raw = points.tolist(), o.tolist(), d.tobytes()
                for r in range(j - i):
                    lo, hi = o[r], o[r + 1]
                    # points are inside the text, apart from one at its very start
                    inner = [p for p in points[split[r]: split[r + 1]] if p > lo]
                    if hi > lo and added is not None and added.search(raw[lo:hi].decode("utf-8", "replace")):
                        ends = [hi]
                    else:
                        ends = chunks_of(lo, hi, inner, d) if hi > lo else []
                    at = lo
                    for e in ends:
                        piece = raw[at:e]
                        f = hashlib.blake2b(piece, digest_size=MARK).digest()
                        k = index.get(f)
                        if k is None:
                            k = index[f] = len(index)
                            if f not in sent:
                                if len(sent) >= SENT:
                                    sent.clear()
                                sent.add(f)
                                texts[f] = piece
                        own.append(k)
                        at = e
                    ids.append(doc_id[i + r])
                    counts.append(len(ends))
                    held += hi - lo
                    if held >= BLOCK_BYTES:
                        yield from flush()
                        block += 1
                        ids, counts, own, index, texts, held = [], [], [], {}, {}, 0
        if ids:
            yield from flush()
    return run


def _cells(batches):
    """``(kind, block, a, b, c)`` of every row."""
    for rb in batches:
        cols = [rb.column(i) for i in range(6)]
        for r in range(rb.num_rows):
            cell, kind, block = cols[0][r].as_py(), cols[1][r].as_py(), cols[2][r].as_py()
            a, b, c = (memoryview(col[r].as_buffer()) if col[r].is_valid else b"" for col in cols[3:])
            yield cell, kind, block, a, b, c


def _encode(tokenizer: str):
    def run(batches):
        import zstandard
        enc = worker_encoder(tokenizer)
        z = zstandard.ZstdCompressor(level=LEVEL)
        at_cell, known, waiting, size = None, {}, [], 0
        flat, per = [], []

        def encode():
            nonlocal waiting, size
            if waiting:
                x, n = enc.encode(waiting)
                flat.append(x)
                per.append(n)
            waiting, size = [], 0

        for cell, kind, block, a, b, c in _cells(batches):
            if cell != at_cell:
                at_cell, known, waiting, size, flat, per, start = cell, {}, [], 0, [], [], None
            if kind == TEXTS:
                raw, lo = bz2.decompress(c), 0
                for n in np.frombuffer(b, "<i4").tolist():
                    piece = raw[lo: lo + n]
                    lo += n
                    f = hashlib.blake2b(piece, digest_size=MARK).digest()
                    if f not in known:                     # the first text of a chunk is the one encoded
                        known[f] = len(known)
                        waiting.append(piece.decode("utf-8"))
                        size += n
                        if size >= ENCODE_BYTES:
                            encode()
                continue
            if kind == ASKED:
                if start is None:
                    encode()
                    ids, ln = np.concatenate(flat), np.concatenate(per)
                    start = np.cumsum(ln) - ln
                fps = bytes(a)
                k = np.array([known[fps[i: i + MARK]] for i in range(0, len(fps), MARK)])
                n = ln[k]
                total = np.cumsum(n)
                out = ids[np.arange(int(total[-1])) + np.repeat(start[k] - (total - n), n)]
                kind_of = "<u2" if out.max(initial=0) < 1 << 16 else "<u4"
                yield _row(block, ASKED, block, bytes(b) + n.astype("<i4").tobytes(), kind_of.encode(),
                           z.compress(out.astype(kind_of).tobytes()))
            else:
                yield _row(block, RECIPE, block, bytes(a), bytes(b), bytes(c))
    return run


class Vocabulary:
    """Bytes of every id, flat and with their first and last byte."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        tokens = {i: t for t, i in spec["model"]["vocab"].items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
        # the printable stand-ins of byte-level vocabularies: printable Latin-1 stands for itself,
        # the other bytes for the code points from 256 on, in order
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        rest = [b for b in range(256) if b not in set(plain)]
        of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}
        self.bytes = []
        for i in range(max(tokens) + 1):
            t = tokens.get(i, "")
            try:
                self.bytes.append(bytes(map(of.__getitem__, t)))
            except KeyError:                               # no byte-level token: stands for its own text
                self.bytes.append(t.encode())
        self.length = np.array([len(b) for b in self.bytes], np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.flat = np.frombuffer(b"".join(self.bytes), np.uint8)
        self.opens = np.array([bool(b) and bool(_SPACE[b[0]]) for b in self.bytes])
        self.closes = np.array([bool(b) and bool(_SOLID[b[-1]]) for b in self.bytes])

    def decode(self, ids: np.ndarray) -> np.ndarray:
        n = self.length[ids]
        total = np.cumsum(n)
        return self.flat[np.arange(int(total[-1]) if len(n) else 0) + np.repeat(self.start[ids] - (total - n), n)]

    def borders(self, ids: np.ndarray) -> np.ndarray:
        """Token indices at which white space follows an ASCII character that is none."""
        return np.flatnonzero(self.opens[ids[1:]] & self.closes[ids[:-1]]) + 1


def worker_vocabulary(name: str) -> Vocabulary:
    held = worker_state().setdefault("vocabularies", {})
    if name not in held:
        held[name] = Vocabulary(_tokenizer_path(name))
    return held[name]


def stitch(parts: list[np.ndarray], vocab: Vocabulary, encode) -> np.ndarray:
    """Ids of a text from the ids of its chunks; each join is encoded again until both sides agree."""
    done, tail, i = [], parts[0], 1
    while i < len(parts):
        right, skip, i = parts[i], 0, i + 1
        reach = 2
        while True:
            cut = vocab.borders(right[skip:]) + skip
            while len(cut) < reach and i < len(parts):      # take the next chunk in
                skip = len(right)
                right, i = np.concatenate([right, parts[i]]), i + 1
                cut = vocab.borders(right[skip:]) + skip
            left = vocab.borders(tail)
            while len(left) < reach and done:
                tail = np.concatenate([done.pop(), tail])
                left = vocab.borders(tail)
            lo, lo2 = (left[-reach], left[1 - reach]) if len(left) >= reach else (0, 0)
            hi, hi1 = (cut[reach - 1], cut[reach - 2]) if len(cut) >= reach else (len(right), len(right))
            text = vocab.decode(np.concatenate([tail[lo:], right[:hi]])).tobytes().decode("utf-8")
            new = encode(text)
            keep_l, keep_r = lo2 - lo, hi - hi1
            if len(new) >= keep_l + keep_r and np.array_equal(new[:keep_l], tail[lo:lo2]) and np.array_equal(
                    new[len(new) - keep_r:], right[hi1:hi]):
                done += [tail[:lo], new]
                tail = right[hi:]
                break
            reach *= 2
    return np.concatenate([*done, tail])


def assemble(flat: np.ndarray, chunk_at: np.ndarray, own: np.ndarray, counts: np.ndarray, vocab: Vocabulary, encoder):
    """Flat ids of all documents of a block and the number of ids of each.

    ``flat`` holds the ids of the block's distinct chunks, chunk ``c`` at ``chunk_at[c]:chunk_at[c + 1]``; ``own``
    the chunks of the documents in order, ``counts`` how many each has."""
    ends = np.cumsum(counts)
    document = np.repeat(np.arange(len(counts)), counts)
    border = vocab.borders(flat)
    border = border[~np.isin(border, chunk_at)]
    b_lo, b_hi = np.searchsorted(border, chunk_at[:-1]), np.searchsorted(border, chunk_at[1:])
    many = b_hi - b_lo >= 2
    lo, hi = chunk_at[own], chunk_at[own + 1]
    # joins: position k joins chunk k and k + 1 of the same document
    k = np.flatnonzero(document[1:] == document[:-1])
    good = many[own[k]] & many[own[k + 1]]
    slow = np.unique(document[k[~good]])
    k = k[~np.isin(document[k], slow)]
    pair, back = np.unique(own[k] * len(chunk_at) + own[k + 1], return_inverse=True)
    left, right = pair // len(chunk_at), pair % len(chunk_at)
    if len(pair):
        s, s2, e1, e2 = border[b_hi[left] - 2], border[b_hi[left] - 1], border[b_lo[right]], border[b_lo[right] + 1]
        n_l, n_r = chunk_at[left + 1] - s, e2 - chunk_at[right]
        size = np.stack([n_l, n_r], 1).ravel()
        begin = np.stack([s, chunk_at[right]], 1).ravel()
        total = np.cumsum(size)
        tokens = flat[np.arange(total[-1]) + np.repeat(begin - (total - size), size)]
        raw = vocab.decode(tokens).tobytes()
        cut = np.append(0, np.cumsum(np.add.reduceat(vocab.length[tokens], total[1::2] - n_l - n_r))).tolist()
        new, per = encoder.encode([raw[a:b].decode("utf-8") for a, b in zip(cut, cut[1:])])
        end = np.cumsum(per)
        start = end - per
        keep_l, keep_r = s2 - s, e2 - e1
        agree = per >= keep_l + keep_r

        def same(at, source, n):
            """Whether ``n`` ids of ``new`` from ``at`` equal those of ``flat`` from ``source``, by join."""
            n = np.where(agree, n, 0)
            t = np.cumsum(n)
            step = np.arange(t[-1]) - np.repeat(t - n, n)
            bad = new[np.repeat(at, n) + step] != flat[np.repeat(source, n) + step]
            return np.bincount(np.repeat(np.arange(len(n)), n)[bad], minlength=len(n)) == 0
        agree = agree & same(start, s, keep_l) & same(end - keep_r, e1, keep_r)
        fail = ~agree[back]
        if fail.any():
            slow = np.union1d(slow, np.unique(document[k[fail]]))
            back, k = back[~np.isin(document[k], slow)], k[~np.isin(document[k], slow)]
        hi[k], lo[k + 1] = s2[back], e1[back]
    else:
        new, start, end, keep_l, keep_r = flat[:0], *(np.zeros(0, np.int64),) * 4
    # segments: chunk, join, chunk, join ...; a chunk without a join after it has an empty one
    seg_at, seg_n = np.zeros((len(own), 2), np.int64), np.zeros((len(own), 2), np.int64)
    seg_at[:, 0], seg_n[:, 0] = lo, hi - lo
    if len(k):
        seg_at[k, 1] = len(flat) + start[back] + keep_l[back]
        seg_n[k, 1] = (end - start - keep_l - keep_r)[back]
    per_doc = np.bincount(document, weights=seg_n.sum(1), minlength=len(counts)).astype(np.int64) if len(own) else np.zeros(len(counts), np.int64)
    n, at = seg_n.ravel(), seg_at.ravel()
    total = np.cumsum(n)
    source = np.concatenate([flat, new])
    out = source[np.arange(int(total[-1]) if len(n) else 0) + np.repeat(at - (total - n), n)]
    if len(slow):
        docs = np.split(out, np.cumsum(per_doc)[:-1])
        one = lambda text: encoder.encode([text])[0]                                  # noqa: E731
        for d in slow.tolist():
            docs[d] = stitch([flat[chunk_at[c]: chunk_at[c + 1]] for c in own[ends[d] - counts[d]: ends[d]]], vocab, one)
        per_doc = np.array([len(x) for x in docs], np.int64)
        out = np.concatenate(docs)
    return out, per_doc


def _documents(tokenizer: str):
    def run(batches):
        import pyarrow as pa
        import zstandard
        enc, vocab, unz = worker_encoder(tokenizer), worker_vocabulary(tokenizer), zstandard.ZstdDecompressor()
        where, lens, ids = [], [], []
        for _, kind, _, a, b, c in _cells(batches):
            if kind == ASKED:
                both = np.frombuffer(a, "<i4")
                where.append(both[: len(both) // 2])
                lens.append(both[len(both) // 2:])
                ids.append(np.frombuffer(unz.decompress(c), bytes(b).decode()).astype(np.uint32))
                continue
            counts = np.frombuffer(b, "<i4").astype(np.int64)
            n = len(counts)
            doc_id, none = np.frombuffer(a[: 8 * n], "<i8"), np.frombuffer(a[8 * n:], np.uint8).astype(bool)
            own = np.frombuffer(unz.decompress(c), "<i4").astype(np.int64)
            if where:
                order = np.argsort(np.concatenate(where))       # the chunks of the block, by their number
                ln, got = np.concatenate(lens).astype(np.int64), np.concatenate(ids)
                begin = (np.cumsum(ln) - ln)[order]
                ln = ln[order]
                total = np.cumsum(ln)
                flat = got[np.arange(total[-1]) + np.repeat(begin - (total - ln), ln)]
                chunk_at = np.append(0, total)
            else:
                flat, chunk_at = np.zeros(0, np.uint32), np.zeros(1, np.int64)
            where, lens, ids = [], [], []
            out, per = assemble(flat, chunk_at, own, counts, vocab, enc)
            ends = np.cumsum(per)
            lo = 0
            while lo < n:
                first = int(ends[lo] - per[lo])
                hi = max(lo + 1, int(np.searchsorted(ends, first + ENCODE_BYTES // 4, side="right")))
                part, cut = out[first: ends[hi - 1]], np.append(0, ends[lo:hi] - first)
                raw = vocab.decode(part)
                at = np.append(0, np.cumsum(vocab.length[part]))[cut]
                whole = raw.tobytes()
                texts = [whole[x:y].decode("utf-8", "replace") for x, y in zip(at.tolist(), at[1:].tolist())]
                raw_ids = part.astype("<u4").tobytes()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc_id[lo:hi], mask=none[lo:hi]), pa.array(per[lo:hi]),
                     pa.array([raw_ids[4 * x: 4 * y] for x, y in zip(cut.tolist(), cut[1:].tolist())], pa.binary()),
                     pa.array(texts, pa.string())], names=["doc_id", "n_tokens", "ids", "text"])
                lo = hi
    return run


def encode_decode(docs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """``doc_id, n_tokens, ids (little-endian unsigned 32-bit), text (decoded from the ids)`` of every row."""
    texts = doc_texts(docs)
    cells = CELLS_PER_PARTITION * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = texts.mapInArrow(_cut(tokenizer, cells), ROWS)
    by_cell = cut.repartition("cell").sortWithinPartitions("cell", "kind", "block")
    encoded = by_cell.mapInArrow(_encode(tokenizer), ROWS)
    by_block = encoded.repartition("block").sortWithinPartitions("block", "kind")
    return by_block.mapInArrow(_documents(tokenizer), "doc_id long, n_tokens long, ids binary, text string")
