"""Filter stages judge every row by its own text: rows of one doc_id and rows without one."""

import random

from llm_helpers import prose, words

from longloom.llm import decontam, minhash_dedup, quality_rules

COLUMNS = "doc_id long, text string"


def _kept(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=repr)


def test_rules_reject_rows_not_ids(spark):
    rng = random.Random(3)
    good = [prose(rng, 200) for _ in range(3)]
    rows = [(None, good[0]), (None, "too short"), (None, None), (7, good[1]), (7, "x"), (8, good[2]), (8, good[2])]
    docs = spark.createDataFrame(rows, COLUMNS)
    want = [(r.doc_id, r.n_words) for r in quality_rules.judge(docs).filter("kept").collect()]
    got = _kept(quality_rules.keep_good(docs))
    assert got == sorted([(None, good[0]), (7, good[1]), (8, good[2]), (8, good[2])], key=repr)
    assert sorted(((d, len(t.split())) for d, t in got), key=repr) == sorted(want, key=repr)


def test_decontamination_drops_rows_not_ids(spark):
    rng = random.Random(4)
    leak = " ".join(words(random.Random(77), 30))
    clean = [prose(rng, 60) for _ in range(3)]
    rows = [(None, clean[0]), (None, clean[1] + " " + leak), (None, None), (5, clean[1]), (5, leak), (5, leak), (6, clean[2])]
    items = spark.createDataFrame([(1, leak)], "item_id long, text string")
    got = _kept(decontam.drop_contaminated(spark.createDataFrame(rows, COLUMNS), items))
    assert got == sorted([(None, clean[0]), (None, None), (5, clean[1]), (6, clean[2])], key=repr)


def test_near_copies_drop_rows_not_ids(spark):
    rng = random.Random(5)
    texts = [prose(rng, 300) for _ in range(6)]

    def near(t):
        w = t.split(" ")
        w[150] = "changed"
        return " ".join(w)
    rows = [(1, texts[0]), (2, near(texts[0])), (2, texts[1]),          # only the copy of 2 goes
            (None, near(texts[2])), (3, texts[2]),                      # null is after every doc_id
            (None, texts[3]), (None, near(texts[3])),                   # one of a group without ids stays
            (4, texts[4]), (4, texts[4].upper()), (4, texts[5]),        # one row of a group with one id stays
            (None, None), (None, None), (None, "")]
    got = _kept(minhash_dedup.keep_one(spark.createDataFrame(rows, COLUMNS)))
    for fixed in [(1, texts[0]), (2, texts[1]), (3, texts[2]), (4, texts[5]), (None, None), (None, "")]:
        assert got.count(fixed) == 1
        got.remove(fixed)
    assert len(got) == 2
    assert got[0] in rows[7:9] and got[1] in rows[5:7] or got[1] in rows[7:9] and got[0] in rows[5:7]


CLASH = ["_bad", "_drop", "_row", "_rown", "_twice", "_s", "_block", "_copies", "_k", "_upto", "_epoch", "r", "ROW", "n", "count"]


def test_stages_with_clashing_columns(spark):
    import corpus_pipeline
    from pyspark.sql import functions as F

    from longloom.llm import mixing
    from longloom.llm.common import read
    sf = "/root/testdata/sf0.001"
    docs = read(spark, sf, "documents")
    odd = docs.select("*", *[F.concat(F.lit(c), F.col("doc_id")).alias(c) for c in CLASH])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got, want = stage(spark, odd, sf), stage(spark, docs, sf)
        assert got.columns == odd.columns, name
        assert sorted(map(tuple, got.select(*docs.columns).collect())) == sorted(map(tuple, want.collect())), name
        assert got.filter(" or ".join(f"`{c}` <> concat('{c}', doc_id)" for c in CLASH)).count() == 0, name
    own = mixing.mix(odd)
    assert own.columns == odd.columns + ["__epoch", "__block", "_n_tokens", "_weight", "_exponent"]


def test_many_equal_rows_and_items(spark):
    """A third of the table is one row with a benchmark passage, every item is there twice."""
    from longloom.llm import decontam as D
    leak = " ".join(words(random.Random(77), 10))
    rows = [(None, leak)] * 10_000 + [(i, f"clean text number {i}") for i in range(100)]
    items = spark.createDataFrame([(1, leak), (1, leak), (2, leak), (3, "clean text")], "item_id long, text string")
    got = D.contamination(spark.createDataFrame(rows, COLUMNS), items).groupBy("doc_id", "n_hit", "n_items", "items").count().collect()
    null = [r for r in got if r.doc_id is None]
    assert len(null) == 1 and null[0]["count"] == 10_000 and (null[0].n_hit, null[0].n_items, null[0].items) == (10, 2, ["1", "2"])
    assert all((r.n_hit, r.n_items) == (2, 1) for r in got if r.doc_id is not None) and len(got) == 101


def test_line_ends_in_roles_come_back(spark):
    from longloom.llm import chat_format as C
    turns = [("a\nb", "t"), ("a", "b\nt"), ("\\n", "\\"), ("\\", "n"), ("x\\\n", "<s>\n"), ("[INST]\n", "")]
    df = spark.createDataFrame([(1, i, r, t, ) for i, (r, t) in enumerate(turns)], "conv_id long, turn long, role string, text string")
    back = [x for r in C.format_conversations(df).orderBy("part").collect() for x in C.parse_turns(r.formatted)]
    assert back == turns


def test_odd_archive_headers():
    from longloom.llm import arc_convert as A
    assert [A.number(x) for x in (b"12", " 7 ", "x", b"", None, "1e3", "9" * 40, b"\xff")] == [12, 7, None, None, None, None, None, None]
    odd = b"WARC/1.0\r\nContent-Length: many\r\n\r\nWARC/1.0\r\nWARC-Type: response\r\nContent-Length: 2\r\n\r\nok\r\n\r\n"
    assert [bytes(b) for _, b in A.warc_records(memoryview(odd))] == [b"ok"]
    assert A.payload_digest({"warc-payload-digest": "sha1:!!"}) is None and A.payload_digest({}) is None


def test_a_long_conversation_is_formatted_by_many_tasks(spark):
    from pyspark.sql import functions as F

    from longloom.llm import chat_format as C
    rows = [(7, i, "assistant" if i % 2 else "user", f"turn {i}") for i in range(3000)] + [(i, 0, "user", "x") for i in range(100, 400)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        parts = C.format_conversations(df).withColumn("task", F.shiftright("part", 32)).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    own = sorted((p for p in parts if p.conv_id == 7), key=lambda p: p.part)
    assert len({p.task for p in own}) >= 3
    assert [x for p in own for x in C.parse_turns(p.formatted)] == [(r, t) for c, _, r, t in rows if c == 7]
    assert sum(p.n_turns for p in parts) == len(rows)
