"""The numpy and byte-level parts against plain definitions."""

import gzip
import random
import zlib

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from longloom.llm import arc_convert, chat_format, minhash_dedup, suffix_dedup, textblocks, token_binary


@given(st.lists(st.one_of(st.integers(0, 70_000), st.integers(0, 2**64 - 1), st.just(0)), max_size=700))
@settings(max_examples=60, deadline=None)
def test_simple8b_round_trip(ids):
    x = np.array(ids, np.uint64)
    words, block_words, escaped = token_binary.pack(x)
    assert (token_binary.unpack(words, block_words, len(x), escaped) == x).all()
    assert block_words.sum() == len(words)


@given(st.lists(st.lists(st.sampled_from(list("ab  é\n\t '.5\x0b\xa0€") + ["<|endoftext|>"]), max_size=30).map("".join), max_size=8))
@settings(max_examples=150, deadline=None)
def test_pieces_equal_whole_texts(texts):
    enc = token_binary.worker_encoder(token_binary.TOKENIZER)
    ids, per = enc.encode(texts)
    whole = [enc.tok.encode(t, add_special_tokens=False).ids for t in texts]
    assert per.tolist() == [len(w) for w in whole] and ids.tolist() == [i for w in whole for i in w]


def test_piece_cache_shrinks(monkeypatch):
    monkeypatch.setattr(token_binary, "CACHE_PIECES", 40)
    enc = token_binary.PieceEncoder(token_binary._tokenizer_path(token_binary.TOKENIZER))
    rng = random.Random(1)
    for _ in range(20):
        texts = [" ".join(rng.choice(["the", "and", f"w{rng.randrange(500)},"]) for _ in range(30)) for _ in range(3)]
        ids, per = enc.encode(texts)
        assert ids.tolist() == [i for t in texts for i in enc.tok.encode(t, add_special_tokens=False).ids]


@given(st.lists(st.one_of(st.sampled_from(chat_format.CONTROL + ["\\", "<", "[", "<\\s>", "\n", "é"]), st.text(max_size=4)), max_size=12))
@settings(max_examples=150, deadline=None)
def test_escape_is_reversible(parts):
    text = "".join(parts)
    escaped = chat_format.escape_column(pa.array([text]))[0].as_py()
    assert chat_format.unescape(escaped) == text
    assert not any(c in escaped for c in chat_format.CONTROL)


def test_words_and_shingles():
    texts = ["A b\x0bc", "", "one", "É é é É", " a  a a a "]
    data, off = textblocks.text_bytes(pa.array(texts))
    for k in (1, 2, 5):
        _, counts = minhash_dedup.shingle_sets(data, off, k)
        want = []
        for t in texts:
            w = bytes(t.encode()).lower().split()
            want.append(len({tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))}) if w else 0)
        assert counts.tolist() == want


def test_linked_equals_all_pairs():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 50))).astype(np.int64) for _ in range(60)]
    sets += [np.unique(np.append(s[:-2], rng.integers(0, 60, 2))).astype(np.int64) for s in sets[:30] if len(s) > 3]
    counts = np.array([len(s) for s in sets])
    label = minhash_dedup.linked(np.concatenate(sets), counts, 60)
    want = list(range(len(sets)))
    for i, a in enumerate(sets):
        for j in range(i):
            n = len(np.intersect1d(a, sets[j]))
            if 100 * n >= 60 * (len(a) + len(sets[j]) - n) and want[i] != want[j]:
                lo, hi = sorted((want[i], want[j]))
                want = [lo if x == hi else x for x in want]
    assert label.tolist() == want


def test_signature_agreement_follows_similarity():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 2**63, 500).astype(np.uint64)
    other = base.copy()
    other[:56] = rng.integers(0, 2**63, 56).astype(np.uint64)          # similarity 0.8
    x = np.concatenate([base, other])
    b = minhash_dedup.band_hashes(x, np.array([500, 500]), 600, 1)
    assert abs((b[0] == b[1]).mean() - 444 / 556) < 0.06


@given(st.text(alphabet="abc", max_size=400), st.integers(0, 5))
@settings(max_examples=40, deadline=None)
def test_every_string_has_one_stretch(text, shift):
    data, off = textblocks.text_bytes(pa.array(["q" * shift, text, text + "b"]))
    doc, a, k, _, _ = suffix_dedup.anchors(data, off, 20, 6)
    for d in range(3):
        starts = sorted(s for i, j, n in zip(doc, a, k) if i == d for s in range(j, j + n))
        assert starts == list(range(max(0, off[d + 1] - off[d] - 19)))


def test_long_text_in_pieces(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BLOCK", 500)
    rng = np.random.default_rng(2)
    data = rng.integers(97, 100, 5000).astype(np.uint8)
    seen = []
    for _, shift, d, o in suffix_dedup._pieces(data, np.array([0, 5000]), 100):
        _, a, k, _, _ = suffix_dedup.anchors(d, o, 100, 24)
        seen += [s + shift for i, n in zip(a, k) for s in range(i, i + n)]
    assert sorted(seen) == list(range(4901))


def _arc(version, records, cut=0):
    fields = arc_convert.ARC_FIELDS[version]
    body = f"{version} 0 org\n{fields}\n".encode()
    mid = b"" if version == 1 else b"200 - - 0 f.arc "
    out = [b"filedesc://f.arc 0.0.0.0 20010101000000 text/plain " + mid + b"%d\n" % len(body) + body + b"\n"]
    for url, block in records:
        out.append(url + b" 1.2.3.4 20020304050607 text/html " + mid + b"%d\n" % len(block) + block + b"\n")
    out[-1] = out[-1][: len(out[-1]) - cut]
    return out


def test_arc_versions_and_compression():
    records = [(b"http://a b.com/ x", b"HTTP/1.1 200 OK\r\nX: 1\r\n\r\nhttp://fake 1.1.1.1 20000101000000 t 5\n\n\n"),
               (b"http://b.com/", b""), (b"dns:c.com", b"plain\r\n\r\nblock")]
    for version in (1, 2):
        parts = _arc(version, records)
        forms = [b"".join(parts), gzip.compress(b"".join(parts)), b"".join(map(gzip.compress, parts))]
        for form in forms:
            got = list(arc_convert.arc_records(form))
            assert [(u.encode(), b) for u, _, _, _, b in got] == records
            assert got[0][1:4] == ("1.2.3.4", "20020304050607", "text/html")
    truncated = b"".join(_arc(1, records, cut=8))
    assert len(list(arc_convert.arc_records(truncated))) == 2


def test_warc_record_reads_back():
    block = b"HTTP/1.1 200 OK\r\n\r\na\r\n\r\nWARC/1.0\r\n"
    data = arc_convert.warc_record([("WARC-Type", "response"), ("X", None)], block) + b"\r\n\r\n"
    (head, got), = arc_convert.warc_records(zlib.compress(data, wbits=31))
    assert got == block and head["warc-type"] == "response" and "x" not in head
