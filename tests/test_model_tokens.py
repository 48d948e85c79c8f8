"""A model's own tokens against the tokenizer: offsets, cuts, decoding, needle contexts."""

import hashlib

import pytest
from pyspark.sql import functions as F

from longloom import constants as K
from longloom.functions import model_tokens as M
from longloom.operators import haystack as H
from longloom.plans import model

TOK = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def tok():
    import public_tokenizers
    return TOK.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


ODD = ["", "a", "漢字かな交じり文", "é" * 5, "🙂🙃 x", "a<|endoftext|>b", " \n\n ", "The cat. Sat. " * 9, None]


def _rows(spark, docs_small):
    odd = spark.createDataFrame([(10 ** 6 + i, t) for i, t in enumerate(ODD)], "doc_id long, text string")
    return docs_small.select("doc_id", "text").unionByName(odd)


def test_cuts_equal_the_decoded_ids(spark, docs_small, tok):
    d = _rows(spark, docs_small).withColumn("t", model.tokenizer().tokens("text"))
    m = [0, 1, 2, 3, 7, 101]
    r = d.select("doc_id", "text", "t", *[M.head("text", F.col("t"), k).alias(f"h{k}") for k in m],
                 *[M.tail("text", F.col("t"), k).alias(f"t{k}") for k in m],
                 *[M.truncate_middle_text("text", F.col("t"), k).alias(f"a{k}") for k in m],
                 *[M.truncate_middle_text("text", F.col("t"), k, exact=True).alias(f"e{k}") for k in m]).collect()
    assert len(r) == 209
    back = lambda ids: tok.decode(ids, skip_special_tokens=False)
    for x in r:
        if x.text is None:
            assert x.t is None and x.h3 is None
            continue
        e = tok.encode(x.text, add_special_tokens=False)
        assert x.t.ids == e.ids
        # the tokenizer's offsets count characters; ours are the bytes before them at character borders
        for (_, end), ours in zip(e.offsets, x.t.ends):
            assert len(x.text[:end].encode()) >= ours > len(x.text[:max(end - 1, 0)].encode()) - 1
        for k in m:
            n = len(e.ids)
            assert x[f"h{k}"] == back(e.ids[:k]) and x[f"t{k}"] == back(e.ids[max(n - k, 0):] if k else [])
            half = k // 2
            assert x[f"a{k}"] == (x.text if n <= k else back(e.ids[:k]) if k < 2 else back(e.ids[:half]) + back(e.ids[n - half:]))
            assert x[f"e{k}"] == (x.text if n <= k else back(e.ids[:half]) + back(e.ids[n - (k - half):]))


def test_decode_and_sizes(spark, docs_small):
    own = model.tokenizer()
    d = _rows(spark, docs_small).withColumn("t", own.tokens("text"))
    r = d.select("text", own.text("t.ids").alias("back"), M.sized_tokens(F.col("t")).alias("s"), "t").collect()
    for x in r:
        assert x.back == x.text
        if x.text is not None:
            assert [p.id for p in x.s] == x.t.ids and sum(p.n for p in x.s) == len(x.text.encode())


def test_needle_contexts(spark, docs_small, tok):
    own, max_len, buffer = model.tokenizer(), 3000, K.FINAL_CONTEXT_LENGTH_BUFFER
    lengths, depths = [300, 900, 3000], [0, 11, 56, 100]
    needle, period = K.DEFAULT_NEEDLE, tok.encode(".", add_special_tokens=False).ids
    got = model.model_cases(docs_small.select("lang", "doc_id", "text", "n_chars"), own, needle, F.array(*map(F.lit, lengths)),
                            F.array(*map(F.lit, depths)), max_len).collect()
    encode = lambda t: tok.encode(t, add_special_tokens=False).ids
    texts = {}
    for r in docs_small.orderBy("doc_id").collect():
        texts.setdefault(r.lang, []).append(encode(r.text))
    own_ids = encode(needle)
    assert len(got) == len(texts) * 12
    for r in got:
        hay = [i for ids in texts[r.lang] * 40 for i in ids][:max_len]
        ctx = hay[:r.context_length]
        room = r.context_length - buffer - len(own_ids)
        ctx = ctx if len(ctx) <= room else ctx[:max(room, 0)]
        at = len(ctx) if r.depth_percent == 100 else int(len(ctx) * (r.depth_percent / 100))
        while r.depth_percent != 100 and at and ctx[at - 1] not in period:
            at -= 1
        assert r.insert_at == at and r.total_tokens == len(ctx) + len(own_ids)
        assert r.context == tok.decode(ctx[:at] + own_ids + ctx[at:], skip_special_tokens=False)


def test_lossy_tokenizers_are_refused(spark):
    lossy = M.ModelTokenizer("lossy", lambda: (lambda texts: [[0] for _ in texts], [b"x"]))
    with pytest.raises(Exception, match="not lossless"):
        spark.createDataFrame([("abc",)], "t string").select(lossy.tokens("t")).collect()


def test_query_digests(spark, tok):
    from conftest import SF001
    r = {x.doc_id: x for x in model.q_model_truncate(spark, SF001).collect()}
    from longloom.sources.tables import read_table
    for d in read_table(spark, SF001, "documents").collect():
        ids = tok.encode(d.text, add_special_tokens=False).ids
        cut = d.text if len(ids) <= 101 else tok.decode(ids[:50]) + tok.decode(ids[-50:])
        assert r[d.doc_id].n_tokens == len(ids) and r[d.doc_id].cut_md5 == hashlib.md5(cut.encode()).hexdigest()


def test_batches_are_encoded_in_bounded_parts(spark):
    most = 4 << 20

    def load():
        def encode(texts):
            if sum(map(len, texts)) > most:
                raise ValueError("too many texts at once")
            return [list(t.encode()) for t in texts]
        return encode, [bytes([i]) for i in range(256)]
    own = M.ModelTokenizer("bounded-parts", load)
    d = spark.range(6000).select("id", F.when(F.col("id") % 5 > 0, F.repeat(F.col("id").cast("string"), 400)).alias("text")).coalesce(1)
    t = d.select("id", "text", own.tokens("text").alias("t"))
    r = t.select("id", F.size("t.ids").alias("n"), F.element_at("t.ends", -1).alias("end"), own.text("t.ids").eqNullSafe(F.col("text")).alias("same")).collect()
    assert [x.id for x in r] == list(range(6000)) and all(x.same for x in r)
    assert all((x.n, x.end) == ((400 * len(str(x.id)),) * 2 if x.id % 5 else (None, None)) for x in r)
