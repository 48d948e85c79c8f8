"""Chunk reuse against an untouched tokenizer: small chunks, joins, odd texts, repeated rows."""

import collections
import hashlib
import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from longloom.llm import catalog, chunk_bpe
from longloom.llm.common import read
from longloom.llm.token_binary import TOKENIZER, _tokenizer_path, worker_encoder

NAME = "op12_chunk_bpe"
ALPHABET = ["a", "bc", "d ", " ", "  ", "\n", "\n\n", " \n", ".", ",", "!", "'s", "'", "é", "ü.", " ", "　", "漢字", "1", "2.5", "\t",
            "\r\n", "don't", "x.", "...", "?!", "A", "\x1c", "\x85", "🙂", "word ", " longer words here", "<|endoftext", "|>"]


def _tok():
    return Tokenizer.from_file(_tokenizer_path(TOKENIZER))


def _want(tok, doc_id, text):
    ids = tok.encode(text or "", add_special_tokens=False).ids
    back = tok.decode(ids, skip_special_tokens=False)
    return (doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest())


@pytest.mark.parametrize("table", ["odd", "repeated", "/root/testdata/sf0.001"])
def test_against_the_tokenizer(spark, odd_dir, repeated_dir, table):
    folder, tok = {"odd": odd_dir, "repeated": repeated_dir}.get(table, table), _tok()
    docs = read(spark, folder, "documents").select("doc_id", "text").collect()
    got = collections.Counter(tuple(r) for r in catalog.QUERIES[NAME](spark, folder).collect())
    assert got == collections.Counter(_want(tok, r.doc_id, r.text) for r in docs)


def _texts(seed):
    rng = random.Random(seed)
    shared = ["".join(rng.choice(ALPHABET) for _ in range(120)) for _ in range(4)]
    out = ["".join(rng.choice(ALPHABET) for _ in range(rng.randrange(0, 90))) for _ in range(200)]
    out += [a + rng.choice(shared) + b + rng.choice(shared) for a, b in zip(out[::2], out[1::2])]
    return [*out, "x" * 900, " " * 300, "漢" * 200, "ab " * 300, "", *shared, "x" * 200 + " y z " * 60 + "x" * 500, "<|endoftext|>" * 3, "a<|endoftext|>b " * 9]


@pytest.mark.parametrize("bits,low,high", [(2, 1, 16), (3, 8, 40), (5, 16, 200)])
def test_small_chunks(spark, monkeypatch, bits, low, high):
    monkeypatch.setattr(chunk_bpe, "CUT_BITS", bits)
    monkeypatch.setattr(chunk_bpe, "MIN_CHUNK", low)
    monkeypatch.setattr(chunk_bpe, "MAX_CHUNK", high)
    tok, vocab, enc, codes = _tok(), chunk_bpe.Vocabulary(_tokenizer_path(TOKENIZER)), worker_encoder(TOKENIZER), chunk_bpe._codes()
    texts = [t for t in _texts(bits) if not enc.added.search(t)]
    index, own, counts = {}, [], []
    for t in texts:
        raw = np.frombuffer(t.encode(), np.uint8)
        ends = chunk_bpe.chunks_of(0, len(raw), chunk_bpe.cut_points(raw, codes).tolist(), raw) if len(raw) else []
        pieces = [raw[a:b].tobytes().decode() for a, b in zip([0, *ends], ends)]      # never inside a character
        assert "".join(pieces) == t and all(len(p.encode()) <= high for p in pieces)
        own += [index.setdefault(p, len(index)) for p in pieces]
        counts.append(len(pieces))
    assert len(index) < len(own) and max(counts) > 8
    ids, per = enc.encode(list(index))
    out, n = chunk_bpe.assemble(ids, np.append(0, np.cumsum(per)), np.array(own), np.array(counts), vocab, enc)
    want = [tok.encode(t, add_special_tokens=False).ids for t in texts]
    assert n.tolist() == [len(w) for w in want] and out.tolist() == [i for w in want for i in w]
    assert vocab.decode(out).tobytes().decode() == "".join(texts)


def test_cuts_follow_the_content():
    """A shared passage falls into the same chunks behind different starts."""
    rng, codes = random.Random(2), chunk_bpe._codes()
    passage = " ".join(f"w{rng.randrange(10 ** 6)}" for _ in range(3000))

    def pieces(t):
        raw = np.frombuffer(t.encode(), np.uint8)
        ends = chunk_bpe.chunks_of(0, len(raw), chunk_bpe.cut_points(raw, codes).tolist(), raw)
        return {raw[a:b].tobytes() for a, b in zip([0, *ends], ends)}
    a, b = pieces("one start " + passage), pieces("quite another beginning, longer than the first " * 5 + passage)
    assert len(a & b) >= len(a) - 3 and len(a) > 20
    assert max(map(len, a)) <= chunk_bpe.MAX_CHUNK


def test_slices_of_the_rolling_hash_agree():
    raw = np.frombuffer(random.Random(1).randbytes((1 << 20) + 5000), np.uint8)
    codes = chunk_bpe._codes()
    whole = np.flatnonzero(chunk_bpe.rolling(raw, codes) >> np.uint32(32 - chunk_bpe.CUT_BITS) == 0) + 1
    assert [p for p in whole.tolist() if p < len(raw) and (raw[p] & 0xC0) != 0x80] == chunk_bpe.cut_points(raw, codes).tolist()


def test_each_chunk_is_encoded_once(spark, monkeypatch):
    """A shared chunk is sent once by a task, asked for once by a block and encoded once by its cell."""
    import pyarrow as pa
    from pyspark import TaskContext
    monkeypatch.setattr(TaskContext, "get", classmethod(lambda cls: type("T", (), {"partitionId": lambda self: 0})()))
    monkeypatch.setattr(chunk_bpe, "BLOCK_BYTES", 30_000)
    rng = random.Random(4)
    shared = " ".join(f"s{rng.randrange(9999)}" for _ in range(1500))
    texts = [f"doc {i} " + " ".join(f"d{rng.randrange(9999)}" for _ in range(300)) + " " + shared for i in range(12)]
    rb = pa.RecordBatch.from_arrays([pa.array(range(12)), pa.array(texts)], names=["doc_id", "text"])
    rows = pa.Table.from_batches(list(chunk_bpe._cut(TOKENIZER, 3)(iter([rb])))).sort_by([("cell", "ascending"), ("kind", "ascending")])
    calls, enc = [], worker_encoder(TOKENIZER)
    plain = type(enc).encode
    monkeypatch.setattr(type(enc), "encode", lambda self, t: calls.extend(t) or plain(self, t))
    back = list(chunk_bpe._encode(TOKENIZER)(iter(rows.to_batches(max_chunksize=3))))
    assert len(calls) == len(set(calls)) and sum(map(len, calls)) < 0.6 * sum(map(len, texts))
    table = pa.Table.from_batches(back).sort_by([("block", "ascending"), ("kind", "ascending")])
    got = pa.Table.from_batches(list(chunk_bpe._documents(TOKENIZER)(iter(table.to_batches())))).to_pylist()
    assert [r["text"] for r in got] == texts
    tok = _tok()
    assert all(np.frombuffer(r["ids"], "<u4").tolist() == tok.encode(t, add_special_tokens=False).ids for r, t in zip(got, texts))
