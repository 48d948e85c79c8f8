import pytest
from models import cut_spans, pack_model, token_id, tokens
from pyspark.sql import functions as F

from longloom.operators import packing
from longloom.operators.sampling import order_key


def _docs(spark, texts, sources=None):
    rows = [(i, (sources or ["s"] * len(texts))[i], t) for i, t in enumerate(texts)]
    d = spark.createDataFrame(rows, "doc_id long, source string, text string")
    return packing.with_token_ids(d.withColumn("k", order_key(F.col("doc_id"))).drop("doc_id"))


def _model(texts, sources, C):
    import hashlib
    order = sorted(range(len(texts)), key=lambda i: hashlib.md5(f"42:{i}".encode()).hexdigest())
    toks = [[token_id(t) for t in tokens(texts[i])] for i in order]
    srcs = [sources[i] for i in order]
    keep = [(t, s) for t, s in zip(toks, srcs) if t]
    return pack_model([t for t, _ in keep], [s for _, s in keep], C)


def _collect(df):
    out = []
    for r in df.orderBy("chunk_id").collect():
        out.append((list(r.input_ids), r.labels, [(x.source, x.start, x.end) for x in r.source]))
    return out


def test_docstring_example():
    spans = [("arxiv", 0, 50), ("cc", 50, 80), ("c4", 80, 100)]
    assert cut_spans(spans, 60) == ([("arxiv", 0, 50), ("cc", 50, 60)], [("cc", 0, 20), ("c4", 20, 40)])


@pytest.mark.parametrize("size", [60, 50, 80, 100, 200])
def test_split_spans_column(spark, size):
    spans = [("arxiv", 0, 50), ("cc", 50, 80), ("c4", 80, 100)]
    df = spark.createDataFrame([(spans,)], "sp array<struct<source:string,start:int,end:int>>")
    kept, carried = packing.split_spans(F.col("sp"), size)
    r = df.select(kept.alias("k"), carried.alias("c")).first()
    want_k, want_c = cut_spans(spans, size)
    assert [tuple(x) for x in r.k] == want_k
    assert [tuple(x) for x in r.c] == want_c


@pytest.mark.parametrize("C", [7, 16, 64, 512])
def test_pack_matches_loop(spark, docs_small, C):
    rows = docs_small.select("doc_id", "source", "text").orderBy("doc_id").collect()
    texts = [r.text for r in rows][:60]
    sources = [r.source for r in rows][:60]
    got = _collect(packing.pack_chunks(_docs(spark, texts, sources), C))
    want = _model(texts, sources, C)
    assert len(got) == len(want)
    assert got == [(list(a), b, list(c)) for a, b, c in want]


def test_pack_properties(spark, docs_small):
    C = 128
    d = packing.with_token_ids(docs_small.select("source", "text", order_key(F.col("doc_id")).alias("k")))
    n = d.select(F.sum(F.size("input_ids"))).first()[0]
    ch = packing.pack_chunks(d, C).cache()
    assert ch.count() == (n - 1) // C
    assert ch.filter(F.size("input_ids") != C).count() == 0
    # spans of a chunk tile [0, C)
    bad = ch.select(F.aggregate("source", F.lit(0), lambda acc, z: F.when(z["start"] == acc, z["end"]).otherwise(-10 ** 6))
                    .alias("end")).filter(F.col("end") != C)
    assert bad.count() == 0


@pytest.mark.parametrize("n_extra", [0, 1, 2])
def test_exact_boundaries(spark, n_extra):
    C = 4
    # one document of exactly C + n_extra - 1 ... tokens: words separated by single spaces
    words = ["w%d" % i for i in range(3)]
    text = " ".join(words)  # 5 tokens
    assert len(tokens(text)) == 5
    text = text + " x" * 0
    texts = [text[: len(text)] for _ in range(1)]
    got = _collect(packing.pack_chunks(_docs(spark, texts), C + n_extra))
    want = _model(texts, ["s"], C + n_extra)
    assert [(list(a), b, list(c)) for a, b, c in want] == got


def test_segment_lengths_and_unpack(spark, docs_small):
    d = packing.with_token_ids(docs_small.select("source", "text", order_key(F.col("doc_id")).alias("k")))
    ch = packing.pack_chunks(d, 256)
    seg = packing.segment_lengths(ch)
    assert seg.agg(F.sum("length")).first()[0] == ch.count() * 256
    u = packing.unpack(ch)
    assert u.filter(F.size("input_ids") != F.col("end") - F.col("start")).count() == 0


def test_pack_spans_narrow(spark, docs_small):
    d = docs_small.select("source", order_key(F.col("doc_id")).alias("k"),
                          F.size(F.regexp_extract_all("text", F.lit(r"[^ \t\n\r.]+|[.]|[ \t\n\r]+"), F.lit(0))).cast("long").alias("n"))
    spans = packing.pack_spans(d, 256)
    full = packing.pack_chunks(packing.with_token_ids(
        docs_small.select("source", "text", order_key(F.col("doc_id")).alias("k"))), 256)
    a = sorted(tuple(r) for r in spans.collect())
    b = sorted((r.chunk_id, r.source, r.start, r.end) for r in packing.unpack(full).collect())
    assert a == b


def test_packed_name():
    assert packing.packed_name(131072, "5b", "none", 0.2) == "packed_131072_5b"
    assert packing.packed_name(131072, "5b", "per_source", 0.1) == "packed_131072_5b_per_source_down_sample_0.1"


def test_pluggable_tokenizer(spark, docs_small):
    from longloom.functions.tokens import ArrowTokenizer

    def word_encoder():
        # a stand-in model tokenizer: one id per whitespace-separated word
        import zlib
        return lambda s: [zlib.crc32(w.encode()) & 0x7FFFFFFF for w in s.split()]

    tok = ArrowTokenizer("words", word_encoder)
    d = packing.with_token_ids(docs_small.select("source", "text", order_key(F.col("doc_id")).alias("k")), tokenizer=tok)
    rows = docs_small.select("text").collect()
    n = sum(len(r.text.split()) for r in rows)
    assert d.select(F.sum("n")).first()[0] == n
    ch = packing.pack_chunks(d, 64)
    assert ch.count() == (n - 1) // 64


def test_tokenizer_is_loaded_once_per_worker(spark, docs_small, tmp_path):
    from longloom.functions.tokens import ArrowTokenizer
    log = str(tmp_path / "loads")

    def factory():
        import os
        with open(log, "a") as f:
            f.write(f"{os.getpid()}\n")
        return lambda texts: [[len(w) for w in t.split()] for t in texts]

    d = docs_small.repartition(32).select(ArrowTokenizer("lengths", factory, batched=True).ids("text").alias("ids"))
    assert d.selectExpr("sum(size(ids))").first()[0] == sum(len(r.text.split()) for r in docs_small.collect())
    loads = open(log).read().split()
    assert len(loads) == len(set(loads)) <= 8


def test_the_pattern_tokenizer_has_the_ids_of_the_default(spark, docs_small):
    """Also for texts of no token, null, other spaces, characters beyond 16 bits and bytes that are no UTF-8."""
    import random

    from longloom.functions import tokens
    rnd = random.Random(3)
    odd = ["a", "b", "é", "漢", "😀", " ", "\t", "\n", "\r", ".", "\x0b", "\x00", "\u2003", "\xa0"]
    raw = [65, 32, 46, 0x80, 0xC3, 0xE6, 0xBC, 0xA2, 0xF0, 0x9F, 0x98, 0xED, 0xA0, 0xFF, 0xC0]
    texts = ["".join(rnd.choices(odd, k=rnd.randrange(40))).encode() for _ in range(500)] + [None, b"", b".." * 9, b" "]
    texts += [bytes(rnd.choices(raw, k=rnd.randrange(30))) for _ in range(500)]
    rows = spark.createDataFrame([(t,) for t in texts], "raw binary").select(F.expr("cast(raw as string)").alias("text"))
    d = docs_small.select("text").unionByName(rows)
    ids = d.select(tokens.token_ids(tokens.tokenize("text")).alias("a"), tokens.PatternTokenizer().ids("text").alias("b"))
    assert ids.count() == docs_small.count() + len(texts)
    assert ids.filter("not (a <=> b)").count() == 0 and ids.filter("a is null").count() == 1
