"""Registered tokenizing and packing queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as K
from ..functions import tokens as TK
from ..operators import packing, profile, sampling
from ..operators.prefix import running_sum
from ..sources import io as IO
from . import fixtures as FX
from .corpus import _profile_sql, _profile_view, docs, mix, sampling_ctes
from .registry import register, sql_str

C = FX.CHUNK
PAT = sql_str(TK.TOKEN_PATTERN)
TOK_SQL = f"regexp_extract_all(text, {PAT})"
IDS_SQL = f"list_transform({TOK_SQL}, lambda x: ('0x' || substr(md5(x), 1, 7))::INTEGER)"


def _ids_md5(col):
    return F.md5(F.array_join(F.col(col).cast("array<string>"), ","))


# ---------------------------------------------------------------- tokens

@register("tokenize", f"""SELECT doc_id, CAST(len({TOK_SQL}) AS INTEGER) AS n_tokens,
md5(array_to_string({TOK_SQL}, '|')) AS tokens_md5, md5(array_to_string({IDS_SQL}, ',')) AS ids_md5 FROM documents""")
def q_tokenize(spark, sf_dir):
    d = docs(spark, sf_dir).select("doc_id", TK.tokenize("text").alias("t"))
    return d.select("doc_id", F.size("t").alias("n_tokens"), F.md5(F.array_join("t", "|")).alias("tokens_md5"),
                    F.md5(F.array_join(TK.token_ids("t").cast("array<string>"), ",")).alias("ids_md5"))


@register("detokenize", f"""SELECT doc_id, array_to_string({TOK_SQL}, '') = text AS lossless,
md5(array_to_string(({TOK_SQL})[1:100], '')) AS head_md5 FROM documents""")
def q_detokenize(spark, sf_dir):
    d = docs(spark, sf_dir).select("doc_id", "text", TK.tokenize("text").alias("t"))
    return d.select("doc_id", (TK.detokenize("t") == F.col("text")).alias("lossless"),
                    F.md5(TK.detokenize("t", 100)).alias("head_md5"))


@register("token_count", f"""SELECT source, CAST(sum(len({TOK_SQL})) AS BIGINT) AS n_tokens,
CAST(sum(n_chars) AS BIGINT) AS n_chars FROM documents GROUP BY source""")
def q_token_count(spark, sf_dir):
    d = docs(spark, sf_dir)
    return d.groupBy("source").agg(F.sum(TK.token_count(TK.tokenize("text"))).cast("long").alias("n_tokens"),
                                   F.sum("n_chars").cast("long").alias("n_chars"))


@register("trim_tokens", f"""SELECT doc_id, CAST(least(len({TOK_SQL}), 1000) AS INTEGER) AS n_kept,
md5(array_to_string(({TOK_SQL})[1:1000], '')) AS kept_md5 FROM documents""")
def q_trim_tokens(spark, sf_dir):
    d = docs(spark, sf_dir).select("doc_id", TK.trim_tokens(TK.tokenize("text"), 1000).alias("t"))
    return d.select("doc_id", F.size("t").alias("n_kept"), F.md5(F.array_join("t", "")).alias("kept_md5"))


@register("trim_chars", f"""SELECT doc_id, CAST(length(substr(text, 1, {int(FX.TRIM_CHARS_LENGTH * K.HAYSTACK_CHARS_PER_TOKEN)})) AS INTEGER) AS n_kept,
md5(substr(text, 1, {int(FX.TRIM_CHARS_LENGTH * K.HAYSTACK_CHARS_PER_TOKEN)})) AS kept_md5 FROM documents""")
def q_trim_chars(spark, sf_dir):
    d = docs(spark, sf_dir).select("doc_id", TK.trim_chars("text", FX.TRIM_CHARS_LENGTH).alias("t"))
    return d.select("doc_id", F.length("t").alias("n_kept"), F.md5("t").alias("kept_md5"))


@register("right_aligned_windows", f"""WITH t AS (SELECT doc_id, len({TOK_SQL}) AS n FROM documents),
b AS (SELECT doc_id, n, unnest(generate_series(n - 1, 1, -{FX.WINDOW_STEP})) AS hi FROM t WHERE n - 1 > 0),
w AS (SELECT doc_id, hi, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY hi), 0) AS lo FROM b)
SELECT doc_id, CAST(lo AS INTEGER) AS lo, CAST(hi AS INTEGER) AS hi FROM w""")
def q_right_aligned_windows(spark, sf_dir):
    d = docs(spark, sf_dir).select("doc_id", TK.token_count(TK.tokenize("text")).alias("n"))
    return d.select("doc_id", F.explode(TK.right_aligned_windows("n", FX.WINDOW_STEP)).alias("w")).select(
        "doc_id", "w.lo", "w.hi")


# ---------------------------------------------------------------- packing

def tokenized_sample(spark, sf_dir, spec=FX.SPEC_PER_SOURCE_LARGE, m=FX.MIX_TEST):
    d = docs(spark, sf_dir)
    r = sampling.sample(d, spec, mix(spark, m))
    t = packing.attach_text(r.admitted.select("doc_id", "source", "n_chars", "k"), d, candidates=r.candidates)
    return packing.persist_tokens(packing.with_token_ids(t))


def counted_sample(spark, sf_dir, spec=FX.SPEC_PER_SOURCE_LARGE, m=FX.MIX_TEST):
    """``source, k, n`` (token count) of the admitted documents, written once: both offset passes read it."""
    d = docs(spark, sf_dir)
    r = sampling.sample(d, spec, mix(spark, m))
    t = packing.attach_text(r.admitted.select("doc_id", "source", "n_chars", "k"), d, candidates=r.candidates)
    return packing.persist_tokens(t.select("source", "k", TK.token_count(TK.tokenize("text")).cast("long").alias("n")))


def packed(spark, sf_dir, spec=FX.SPEC_PER_SOURCE_LARGE, m=FX.MIX_TEST, chunk=C):
    return packing.pack_chunks(tokenized_sample(spark, sf_dir, spec, m), chunk)


_PACK_BASE = f"""WITH {sampling_ctes(FX.SPEC_PER_SOURCE_LARGE, FX.MIX_TEST)},
t AS (SELECT adm.doc_id, adm.source, adm.k, {IDS_SQL} AS ids FROM adm JOIN documents ON adm.doc_id = documents.doc_id),
t2 AS (SELECT *, len(ids) AS n FROM t WHERE len(ids) > 0),
o AS (SELECT *, CAST(sum(n) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS e FROM t2),
o2 AS (SELECT *, e - n AS s FROM o),
pc AS (SELECT o2.*, unnest(generate_series(s // {C}, (e - 1) // {C})) AS cid FROM o2),
pieces AS (SELECT cid, source, greatest(s, cid * {C}) AS a, least(e, (cid + 1) * {C}) AS b, s, ids FROM pc),
pieces2 AS (SELECT cid, source, a, b, ids[a - s + 1 : b - s] AS piece,
                   CASE WHEN a = cid * {C} AND cid >= 1 THEN ids[a - s + 1] END AS lab FROM pieces),
lab AS (SELECT cid - 1 AS chunk_id, lab AS labels FROM pieces2 WHERE lab IS NOT NULL),
ch AS (SELECT cid AS chunk_id, CAST(sum(b - a) AS INTEGER) AS n_tokens, CAST(count(*) AS INTEGER) AS n_spans,
              md5(string_agg(array_to_string(piece, ','), ',' ORDER BY a)) AS ids_md5,
              string_agg(source || ':' || CAST(a - cid * {C} AS VARCHAR) || '-' || CAST(b - cid * {C} AS VARCHAR), ';' ORDER BY a) AS spans
       FROM pieces2 GROUP BY cid),
chunks AS (SELECT ch.*, lab.labels FROM ch JOIN lab ON ch.chunk_id = lab.chunk_id),
segs AS (SELECT p.cid AS chunk_id, p.source, p.a - p.cid * {C} AS start, p.b - p.cid * {C} AS "end",
                p.piece, row_number() OVER (PARTITION BY p.cid ORDER BY p.a) - 1 AS span_idx
         FROM pieces2 p JOIN lab ON p.cid = lab.chunk_id)"""


def _spans_str(col="source"):
    return F.array_join(F.transform(col, lambda z: F.concat(z["source"], F.lit(":"), z["start"].cast("string"),
                                                            F.lit("-"), z["end"].cast("string"))), ";")


@register("pack_chunks", _PACK_BASE + "\nSELECT chunk_id, n_tokens, labels, ids_md5, spans FROM chunks")
def q_pack_chunks(spark, sf_dir):
    ch = packed(spark, sf_dir)
    return ch.select("chunk_id", F.size("input_ids").alias("n_tokens"), "labels", _ids_md5("input_ids").alias("ids_md5"),
                     _spans_str().alias("spans"))


@register("pack_spans", _PACK_BASE + """
SELECT chunk_id, source, CAST(start AS INTEGER) AS start, CAST("end" AS INTEGER) AS "end" FROM segs""")
def q_pack_spans(spark, sf_dir):
    return packing.pack_spans(counted_sample(spark, sf_dir), C)


@register("chunk_unpack", _PACK_BASE + """
SELECT chunk_id, CAST(span_idx AS INTEGER) AS span_idx, source, CAST(start AS INTEGER) AS start,
       CAST("end" AS INTEGER) AS "end", md5(array_to_string(piece, ',')) AS piece_md5 FROM segs""")
def q_chunk_unpack(spark, sf_dir):
    u = packing.unpack(packed(spark, sf_dir))
    return u.select("chunk_id", "span_idx", "source", "start", "end", _ids_md5("input_ids").alias("piece_md5"))


@register("segment_length_profile", _PACK_BASE + ",\nseg_len AS (SELECT source, \"end\" - start AS length FROM segs)\n"
          + _profile_sql("SELECT source, length FROM seg_len", "length", int_total=True).replace("WITH x AS", ", x AS", 1))
def q_segment_length_profile(spark, sf_dir):
    # spans need token counts only: no ids travel and no chunk is collected
    spans = packing.pack_spans(counted_sample(spark, sf_dir), C)
    seg = spans.select("source", (F.col("end") - F.col("start")).cast("long").alias("length"))
    return _profile_view(profile.length_profile(seg, "length"))


@register("segment_length_sink", _PACK_BASE + ",\nseg_len AS (SELECT source, \"end\" - start AS length FROM segs)\n"
          + _profile_sql("SELECT source, length FROM seg_len", "length", int_total=True).replace("WITH x AS", ", x AS", 1))
def q_segment_length_sink(spark, sf_dir):
    """Segment lengths written in long form (source, length) and profiled from the written table."""
    seg = packing.segment_lengths(packed(spark, sf_dir)).select("source", F.col("length").cast("long"))
    from ..session import scratch_path
    path = scratch_path(spark, "segment_lengths")
    seg.write.mode("overwrite").partitionBy("source").parquet(path)
    back = spark.read.parquet(path)
    return _profile_view(profile.length_profile(back, "length"))


@register("split_spans", """WITH t AS (SELECT conv_id, turn, role, length(text) AS n FROM conversations),
s AS (SELECT conv_id, turn, role, CAST(sum(n) OVER (PARTITION BY conv_id ORDER BY turn
             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS e, n FROM t),
s2 AS (SELECT conv_id, turn, role, e - n AS start, e AS "end",
              CAST(sum(n) OVER (PARTITION BY conv_id) // 2 AS BIGINT) AS size FROM s)
SELECT conv_id, turn, role, size,
       CAST(coalesce(CASE WHEN "end" <= size OR start < size THEN start END, -1) AS BIGINT) AS kept_start,
       CAST(coalesce(CASE WHEN "end" <= size OR start < size THEN least("end", size) END, -1) AS BIGINT) AS kept_end,
       CAST(coalesce(CASE WHEN "end" > size THEN greatest(start - size, 0) END, -1) AS BIGINT) AS carried_start,
       CAST(coalesce(CASE WHEN "end" > size THEN "end" - size END, -1) AS BIGINT) AS carried_end
FROM s2""")
def q_split_spans(spark, sf_dir):
    """Turns of a conversation form one buffer (spans = running character offsets), split at half
    its length.  Row-wise: no conversation is gathered into one task or one array."""
    from ..operators.prefix import range_bucket
    from ..sources.tables import read_table
    c = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role",
                                                           F.length("text").cast("long").alias("n"))
    c = running_sum(c, "n", ["turn"], range_bucket(c, "turn", 64), by=["conv_id"], out="e")
    size = c.groupBy(F.col("conv_id").alias("_conv")).agg(F.floor(F.sum("n") / 2).cast("long").alias("size"))
    c = c.join(size, F.col("conv_id").eqNullSafe(F.col("_conv")))
    ks, ke, cs, ce = packing.split_span_columns(F.col("e") - F.col("n"), F.col("e"), F.col("size"))
    # an absent part is marked -1
    parts = [F.coalesce(x, F.lit(-1)).cast("long").alias(a) for x, a in
             zip((ks, ke, cs, ce), ("kept_start", "kept_end", "carried_start", "carried_end"))]
    return c.select("conv_id", "turn", "role", "size", *parts)


@register("read_first", """WITH n AS (SELECT conv_id, turn, row_number() OVER (ORDER BY conv_id, turn) AS i FROM conversations)
SELECT conv_id, turn FROM n WHERE i <= 50""")
def q_read_first(spark, sf_dir):
    """The first fifty rows of the first shard of the conversations, in file order (the row cap is the feature)."""
    from ..sources.tables import CONVERSATIONS, read_table
    c = read_table(spark, sf_dir, "conversations")
    folder = IO.write_sharded(c.repartitionByRange(2, "conv_id", "turn").sortWithinPartitions("conv_id", "turn"),
                              spark, "conversations_first", 2, None)
    return IO.read_first(spark, f"{folder}/data_0-2.jsonl", CONVERSATIONS, 50).select("conv_id", "turn")


@register("pack_write", _PACK_BASE + "\nSELECT chunk_id, n_tokens, labels, n_spans FROM chunks")
def q_pack_write(spark, sf_dir):
    ch = packed(spark, sf_dir)
    name = packing.packed_name(C, f"{FX.BUDGET_LARGE // 1000}k", FX.SPEC_PER_SOURCE_LARGE.mode, FX.RATIO)
    path = IO.write_jsonl(ch, spark, name)
    back = IO.read_packed(spark, path)
    return back.select("chunk_id", F.size("input_ids").alias("n_tokens"), "labels", F.size("source").alias("n_spans"))
