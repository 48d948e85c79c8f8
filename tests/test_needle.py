import numpy as np
from models import needle_at_token, tokens
from pyspark.sql import functions as F

from longloom import constants as K
from longloom.operators import haystack as H


def test_grid_values(spark):
    g = H.default_grid(spark).toPandas()
    lengths = sorted(set(g.context_length))
    assert lengths == [int(x) for x in np.round(np.linspace(1000, 128000, 40)).astype(int)]
    assert sorted(set(g.depth_percent)) == [0, 11, 22, 33, 44, 56, 67, 78, 89, 100]
    assert len(g) == 400
    s = sorted(set(H.default_grid(spark, sigmoid=True).toPandas().depth_percent))
    assert s[0] == 0 and s[-1] == 100 and len(s) == 10


def _hay_model(texts, max_len):
    toks = [tokens(t) for t in texts if tokens(t)]
    total = sum(len(t) for t in toks)
    out = []
    while len(out) < max_len:
        for t in toks:
            out.extend(t)
    return out[:max_len], total


def test_haystack_and_cells_match_model(spark, docs_small):
    max_len = 20000
    h = H.haystacks(docs_small.select("lang", "doc_id", "text"), max_len)
    rows = {r.lang: r for r in h.collect()}
    pdf = docs_small.select("lang", "doc_id", "text").toPandas().sort_values("doc_id")
    needle = tokens(K.DEFAULT_NEEDLE)
    lengths = [300, 600, 900, 5000, 20000]
    depths = [0, 11, 44, 56, 100]
    cells = H.needle_cells(h, F.array(*map(F.lit, lengths)), F.array(*map(F.lit, depths)), len(needle)).collect()
    got = {(c.lang, c.context_length, int(c.depth_percent)): (c.insert_at, c.ctx_tokens) for c in cells}
    for lang, grp in pdf.groupby("lang"):
        hay, total = _hay_model(list(grp.text), max_len)
        assert list(rows[lang].tokens) == hay and rows[lang].passes == -(-max_len // total)
        for L in lengths:
            for d in depths:
                at, ctx = needle_at_token(hay, needle, L, d)
                assert got[(lang, L, d)][0] == at


def test_materialize_contains_needle_once(spark, docs_small):
    h = H.haystacks(docs_small.select("lang", "doc_id", "text"), 5000)
    needle = tokens(K.DEFAULT_NEEDLE)
    c = H.needle_cells(h, F.array(F.lit(3000)), F.array(F.lit(0), F.lit(50), F.lit(100)), len(needle))
    m = H.materialize(c, h, K.DEFAULT_NEEDLE).collect()
    for r in m:
        assert r.context.count(K.DEFAULT_NEEDLE) == 1
        assert len(tokens(r.context)) <= r.total_tokens + 2


def test_cell_name(spark):
    df = spark.createDataFrame([("org/model-1.5", 4256, 0.11)], "m string, l int, d double")
    assert df.select(H.cell_name(F.col("m"), F.col("l"), F.col("d"))).first()[0] == "model-1_5_len_4256_depth_11"


def test_text_dir_haystack(spark, tmp_path):
    from longloom.sources import io as IO
    texts = {"b.txt": "Second file. More", "a.txt": "First file.", "c.md": "ignored"}
    for name, t in texts.items():
        (tmp_path / name).write_text(t)
    df = IO.read_text_dir(spark, str(tmp_path))
    rows = sorted((r.file_name, r.text) for r in df.collect())
    assert rows == [("a.txt", "First file."), ("b.txt", "Second file. More")]
    d = df.withColumn("g", F.lit("essays"))
    # haystack order is the file name (a numeric rank of it; the window is over a handful of files)
    from pyspark.sql import Window
    d = d.withColumn("o", F.row_number().over(Window.orderBy("file_name")))
    h = H.haystacks(d, 20, group="g", order="o").first()
    want, _ = _hay_model(["First file.", "Second file. More"], 20)
    assert list(h.tokens) == want


def test_results_dir(spark, tmp_path):
    import json
    from longloom.sources import io as IO
    for i, (L, d) in enumerate([(1000, 0.0), (2000, 50.0)]):
        doc = {"model": "m", "context_length": L, "depth_percent": d, "version": 1, "needle": "x",
               "model_response": "x", "score": 10.0, "test_duration_seconds": 1.0,
               "test_timestamp_utc": "2024-01-01 00:00:00+0000"}
        (tmp_path / f"r{i}_results.json").write_text(json.dumps(doc, indent=2))
    r = IO.read_results_dir(spark, str(tmp_path)).collect()
    assert sorted((x.context_length, x.depth_percent) for x in r) == [(1000, 0.0), (2000, 50.0)]


def test_haystack_tokenizes_only_a_prefix(spark, docs_mid):
    # a small guess forces widening; a large corpus group reaches max_len without counting every range
    a = H.haystacks(docs_mid.select("lang", "doc_id", "text"), 3000, chars_per_token_guess=1).collect()
    b = H.haystacks(docs_mid.select("lang", "doc_id", "text"), 3000, chars_per_token_guess=1000).collect()
    key = lambda rows: sorted((r.lang, r.passes, tuple(r.tokens)) for r in rows)
    assert key(a) == key(b)
    assert all(len(r.tokens) == 3000 for r in a)


def test_length_range_of_the_grid(spark):
    from longloom.operators import haystack as H
    lengths, depths = H.default_axes()
    every = H.grid(spark, lengths, depths).select("context_length").distinct()
    some = H.grid(spark, lengths, depths, min_len=20_000, max_len=40_000).select("context_length").distinct()
    want = sorted(r[0] for r in every.collect() if 20_000 <= r[0] <= 40_000)
    assert want and sorted(r[0] for r in some.collect()) == want


def test_haystacks_of_sparse_clustered_and_null_groups(spark):
    """Ids in two far clusters, a null group, another tokenizer: the first tokens of each group in order."""
    from pyspark.sql import functions as F
    from longloom.operators import haystack as H
    rows = [(i if i % 2 else 10**12 + i, None if i % 5 == 0 else f"g{i % 2}", f"w{i} x. ") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    split = lambda c: F.filter(F.split(c, " "), lambda w: w != "")
    got = {r.lang: r.tokens for r in H.haystacks(df, 90, tokenizer=split).collect()}
    for g in (None, "g0", "g1"):
        text = "".join(t for _, lang, t in sorted(rows) if lang == g)
        assert got[g] == (text * 90).split()[:90]


def test_more_groups_than_literal_bounds(spark, monkeypatch):
    rows = [(i, f"g{i % 30}" if i % 30 else None, f"w{i} x. ") for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    key = lambda h: sorted((r.lang or "", r.passes, r.tokens) for r in h.collect())
    want = key(H.haystacks(df, 40))
    monkeypatch.setattr(H, "LITERAL_GROUPS", 7)
    assert key(H.haystacks(df, 40)) == want and len(want) == 30


def test_every_turn_is_scored(spark):
    from conftest import SF01
    from longloom.plans import fixtures as FX
    from longloom.plans import needle
    r = needle.results(spark, SF01)
    turns = FX.assistant_turns(spark, SF01)
    text = {t.text for t in turns.collect()}
    rows = r.select("model_response", "score").collect()
    doubled = sum(x.model_response == " ".join(needle.NEEDLE_WORDS[:8]) for x in rows)
    assert len(rows) == turns.count() + doubled and all(x.model_response is not None and x.score is not None for x in rows)
    assert all(any(x.model_response.endswith(t) for t in text) for x in rows if x.model_response != " ".join(needle.NEEDLE_WORDS[:8]))


def test_stemmed_needle_score(spark):
    from longloom.functions import scoring as S
    df = spark.createDataFrame([("walks dogs", "walk dog")], "p string, t string")
    stem = lambda t: F.transform(t, lambda w: F.rtrim(w, F.lit("s")))
    r = df.select(S.needle_score("p", "t").alias("a"), S.needle_score("p", "t", stem).alias("b")).first()
    assert r.a == 0 and r.b == 10


def test_folder_files_follow_the_data(spark, monkeypatch):
    """The files of a folder are as many as the partitions of the session, not a fixed four."""
    from longloom.plans import needle
    from longloom.sources import io
    seen, read = [], io.read_text_lines
    monkeypatch.setattr(needle.IO, "read_text_lines", lambda s, path: seen.append(path) or read(s, path))
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "12")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        needle.q_haystack_files(spark, "/root/testdata/sf0.001")
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    files = spark.read.text(seen[0]).select(F.regexp_extract("_metadata.file_name", "part-[0-9]+", 0).alias("f")).distinct().count()
    assert files > 4
