"""Registered corpus queries: scan, estimates, profiles, sampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as K
from ..operators import length_sketch, profile, sampling, stream_order
from ..operators.sampling import SampleSpec
from ..sources.tables import corpus_scan, read_table
from ..session import table_path
from . import fixtures as FX
from .registry import register, sql_double, sql_str


def docs(spark, sf_dir):
    return read_table(spark, sf_dir, "documents")


def mix(spark, m):
    return sampling.mix_frame(spark, m)


# ---------------------------------------------------------------- SQL pieces

def _mix_values(m) -> str:
    return ", ".join(f"({sql_str(s)}, {sql_double(w)})" for s, w in m)


def _pass_sql(spec: SampleSpec) -> str:
    if spec.mode == "none":
        return "true"
    return (f"(n_chars >= {spec.threshold_chars} OR "
            f"('0x' || substr(md5('{spec.coin_seed}:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT <= {spec.coin_cut})")


def _keyed_sql(spec: SampleSpec) -> str:
    return (f"SELECT doc_id, source, n_chars, md5('{spec.order_seed}:' || coalesce(doc_id::VARCHAR, '')) AS k, "
            f"{_pass_sql(spec)} AS pass FROM documents")


def bud_ctes(spec: SampleSpec, m) -> str:
    """CTEs ``mix`` (literal) and ``bud`` (per-source budgets)."""
    tot = sql_double(float(spec.total_tokens))
    r = sql_double(K.CHARS_PER_TOKEN)
    return f"""mix(source, weight) AS (VALUES {_mix_values(m)}),
bud AS (SELECT source, weight, {tot} * weight AS budget_tokens,
               CAST(floor({tot} * weight * {r}) AS BIGINT) AS bf,
               CAST(ceil({tot} * weight * {r}) AS BIGINT) AS bc FROM mix)"""


def sampling_ctes(spec: SampleSpec, m=None) -> str:
    """CTEs ``d`` (keyed docs), ``w2`` (charged rows), ``stop`` (one row), ``adm`` (admitted)."""
    tot = sql_double(float(spec.total_tokens))
    r = sql_double(K.CHARS_PER_TOKEN)
    if spec.per_source:
        return f"""
{bud_ctes(spec, m)},
d AS ({_keyed_sql(spec)}),
w AS (SELECT d.*, bud.bf, bud.bc, CASE WHEN pass THEN n_chars ELSE 0 END AS v,
             CAST(sum(CASE WHEN pass THEN n_chars ELSE 0 END) OVER (PARTITION BY d.source ORDER BY k, n_chars
                 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS incl
      FROM d JOIN bud ON d.source = bud.source),
w2 AS (SELECT *, incl - v AS prior, (pass AND incl - v <= bf) AS admit,
              ((NOT pass) AND incl - v <= bf) AS filtered FROM w),
fin AS (SELECT source, min(k) AS kf FROM w2 WHERE admit AND incl >= bc GROUP BY source),
stop AS (SELECT CASE WHEN count(*) = {len(m)} THEN max(kf) END AS stop FROM fin),
adm AS (SELECT w2.* FROM w2, stop WHERE admit AND (stop.stop IS NULL OR k <= stop.stop))"""
    x = float(spec.total_tokens) * K.CHARS_PER_TOKEN
    import math
    return f"""
d AS ({_keyed_sql(spec)}),
w AS (SELECT d.*, CAST({math.floor(x)} AS BIGINT) AS bf, CASE WHEN pass THEN n_chars ELSE 0 END AS v,
             CAST(sum(CASE WHEN pass THEN n_chars ELSE 0 END) OVER (ORDER BY k, source, n_chars
                 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS incl
      FROM d),
w2 AS (SELECT *, incl - v AS prior, (pass AND incl - v <= bf) AS admit,
              ((NOT pass) AND incl - v <= bf) AS filtered FROM w),
stop AS (SELECT min(k) AS stop FROM w2 WHERE admit AND incl > bf),
adm AS (SELECT w2.* FROM w2, stop WHERE admit AND (stop.stop IS NULL OR k <= stop.stop))"""


def _admitted_sql(spec, m=None) -> str:
    return f"WITH {sampling_ctes(spec, m)}\nSELECT doc_id, source, n_chars, k, prior AS \"offset\" FROM adm"


def _run_sample(spark, sf_dir, spec, m=None):
    mx = mix(spark, m) if m is not None else None
    return sampling.sample(docs(spark, sf_dir), spec, mx)


# ---------------------------------------------------------------- queries

@register("corpus_scan", "SELECT doc_id, source, n_chars FROM documents")
def q_corpus_scan(spark, sf_dir):
    return corpus_scan(spark, table_path(sf_dir, "documents"))


@register("est_tokens", f"""SELECT doc_id, source, n_chars, n_chars / {sql_double(K.CHARS_PER_TOKEN)} AS est_tokens,
n_chars >= {FX.SPEC_PER_SOURCE.threshold_chars} AS is_long FROM documents""")
def q_est_tokens(spark, sf_dir):
    d = docs(spark, sf_dir)
    return d.select("doc_id", "source", "n_chars", (F.col("n_chars") / F.lit(K.CHARS_PER_TOKEN)).alias("est_tokens"),
                    (F.col("n_chars") >= F.lit(FX.SPEC_PER_SOURCE.threshold_chars)).alias("is_long"))


def _profile_sql(inner: str, value: str, int_total: bool = False) -> str:
    ps = K.PROFILE_PERCENTILES
    qs = ", ".join(f"{p / 100.0}" for p in ps)
    cols = ", ".join(f"CAST(floor(round(q[{i + 1}], 6)) AS BIGINT) AS p{p}" for i, p in enumerate(ps))
    return f"""WITH x AS ({inner}),
g AS (SELECT source, count(*) AS n, {f"CAST(sum({value}) AS BIGINT)" if int_total else f"sum({value})"} AS total, quantile_cont({value}, [{qs}]) AS q FROM x GROUP BY source)
SELECT source, n, {"total" if int_total else "round(total, 3)"} AS total, round(total / sum(total) OVER (), 6) AS portion, {cols} FROM g"""


def _profile_view(df):
    ps = K.PROFILE_PERCENTILES
    # a sum of doubles depends on the summation order: report it rounded (integer sums stay exact)
    total = F.col("total") if dict(df.dtypes)["total"] in ("bigint", "int") else F.round("total", 3)
    cols = [F.col("source"), F.col("n"), total.alias("total"), F.round("portion", 6).alias("portion")]
    cols += [F.floor(F.round(F.col(f"p{p}"), 6)).cast("long").alias(f"p{p}") for p in ps]
    return df.select(*cols)


@register("length_profile", _profile_sql(f"SELECT source, n_chars / {sql_double(K.CHARS_PER_TOKEN)} AS est FROM documents", "est"))
def q_length_profile(spark, sf_dir):
    d = docs(spark, sf_dir).select("source", (F.col("n_chars") / F.lit(K.CHARS_PER_TOKEN)).alias("est"))
    return _profile_view(profile.length_profile(d, "est"))


def _sketch_sql() -> str:
    b, ps = length_sketch.BITS, K.PROFILE_PERCENTILES
    cols = ", ".join(f"CAST(arg_min(m, low) FILTER (WHERE upto * 100 >= every * {p}) AS BIGINT) AS p{p}" for p in ps)
    return f"""WITH v AS (SELECT source, n_chars AS v, CAST(greatest(length(bin(n_chars)) - {1 + b}, 0) AS BIGINT) AS s FROM documents),
bk AS (SELECT source, (v >> s) << s AS low, CAST(1 AS BIGINT) << s AS width, count(*) AS n, sum(v) AS total, min(v) AS vmin, max(v) AS vmax
       FROM v GROUP BY ALL),
c AS (SELECT *, sum(n) OVER (PARTITION BY source ORDER BY low ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto,
             sum(n) OVER (PARTITION BY source) AS every,
             (greatest(low, vmin) + least(low + width - 1, vmax)) // 2 AS m FROM bk),
g AS (SELECT source, CAST(sum(n) AS BIGINT) AS n, CAST(sum(total) AS BIGINT) AS total, {cols} FROM c GROUP BY source)
SELECT source, n, total, round(total / sum(total) OVER (), 6) AS portion, {", ".join(f"p{p}" for p in ps)} FROM g"""


@register("length_sketch", _sketch_sql())
def q_length_sketch(spark, sf_dir):
    """Length profile from stored sketches of three runs, merged without reading the documents again."""
    from ..session import scratch_path
    path, d = scratch_path(spark, "length_sketch"), docs(spark, sf_dir)
    for run in range(3):
        part = d.filter(F.pmod(F.xxhash64("doc_id"), F.lit(3)) == run)
        length_sketch.store(length_sketch.sketch(part, "n_chars"), path, str(run))
    q = length_sketch.quantiles(length_sketch.load(spark, path))
    return q.withColumn("portion", F.round("portion", 6))


@register("downsample_short", f"WITH d AS ({_keyed_sql(FX.SPEC_PER_SOURCE)}) SELECT doc_id, source, n_chars, k FROM d WHERE pass")
def q_downsample_short(spark, sf_dir):
    return sampling.downsample_short(docs(spark, sf_dir), FX.SPEC_PER_SOURCE)


@register("mix_join", f"""WITH {bud_ctes(FX.SPEC_PER_SOURCE, FX.MIX_TEST)}
SELECT documents.doc_id, documents.source, bud.weight, bud.bf, bud.bc FROM documents JOIN bud ON documents.source = bud.source""")
def q_mix_join(spark, sf_dir):
    b = sampling.budgets(mix(spark, FX.MIX_TEST), FX.SPEC_PER_SOURCE)
    return docs(spark, sf_dir).select("doc_id", "source").join(F.broadcast(b), "source").select(
        "doc_id", "source", "weight", "bf", "bc")


@register("sample_per_source", _admitted_sql(FX.SPEC_PER_SOURCE, FX.MIX_TEST))
def q_sample_per_source(spark, sf_dir):
    return _run_sample(spark, sf_dir, FX.SPEC_PER_SOURCE, FX.MIX_TEST).admitted


@register("sample_per_source_long", _admitted_sql(FX.SPEC_LONG_THRESHOLD, FX.MIX_TEST))
def q_sample_per_source_long(spark, sf_dir):
    return _run_sample(spark, sf_dir, FX.SPEC_LONG_THRESHOLD, FX.MIX_TEST).admitted


@register("sample_upsample_mix", _admitted_sql(FX.SPEC_UPSAMPLE, FX.MIX_TEST_UPSAMPLED))
def q_sample_upsample(spark, sf_dir):
    return _run_sample(spark, sf_dir, FX.SPEC_UPSAMPLE, FX.MIX_TEST_UPSAMPLED).admitted


@register("sample_starved", _admitted_sql(FX.SPEC_STARVED, FX.MIX_STARVED))
def q_sample_starved(spark, sf_dir):
    return _run_sample(spark, sf_dir, FX.SPEC_STARVED, FX.MIX_STARVED).admitted


@register("sample_global", _admitted_sql(FX.SPEC_GLOBAL))
def q_sample_global(spark, sf_dir):
    return _run_sample(spark, sf_dir, FX.SPEC_GLOBAL).admitted


@register("sample_none", _admitted_sql(FX.SPEC_NONE))
def q_sample_none(spark, sf_dir):
    return _run_sample(spark, sf_dir, FX.SPEC_NONE).admitted


@register("scan_prefix", f"""WITH {sampling_ctes(FX.SPEC_PER_SOURCE, FX.MIX_TEST)}
SELECT d.source, count(*) AS scanned FROM d, stop WHERE stop.stop IS NULL OR d.k <= stop.stop GROUP BY d.source""")
def q_scan_prefix(spark, sf_dir):
    r = _run_sample(spark, sf_dir, FX.SPEC_PER_SOURCE, FX.MIX_TEST)
    return r.scanned().groupBy("source").agg(F.count(F.lit(1)).alias("scanned"))


@register("sampling_report", f"""WITH {sampling_ctes(FX.SPEC_PER_SOURCE_LARGE, FX.MIX_TEST)},
sc AS (SELECT d.source, count(*) AS scanned FROM d, stop WHERE stop.stop IS NULL OR d.k <= stop.stop GROUP BY d.source),
ch AS (SELECT w2.source, CAST(sum(CASE WHEN admit THEN n_chars ELSE 0 END) AS BIGINT) AS used_chars,
              count(*) FILTER (WHERE admit) AS passed, count(*) FILTER (WHERE filtered) AS filtered
       FROM w2, stop WHERE w2.prior <= w2.bf AND (stop.stop IS NULL OR w2.k <= stop.stop) GROUP BY w2.source)
SELECT sc.source, sc.scanned, coalesce(ch.used_chars, 0) AS used_chars, coalesce(ch.passed, 0) AS passed,
       coalesce(ch.filtered, 0) AS filtered FROM sc LEFT JOIN ch ON sc.source = ch.source""")
def q_sampling_report(spark, sf_dir):
    r = _run_sample(spark, sf_dir, FX.SPEC_PER_SOURCE_LARGE, FX.MIX_TEST)
    return r.report().select("source", "scanned", "used_chars", "passed", "filtered")


@register("sampling_plan", f"""WITH {sampling_ctes(FX.SPEC_PER_SOURCE_LARGE, FX.MIX_TEST)},
ch AS (SELECT w2.source, CAST(sum(CASE WHEN admit THEN n_chars ELSE 0 END) AS BIGINT) AS used_chars
       FROM w2, stop WHERE w2.prior <= w2.bf AND (stop.stop IS NULL OR w2.k <= stop.stop) GROUP BY w2.source)
SELECT ch.source, used_chars, round(used_chars / {sql_double(K.CHARS_PER_TOKEN)} / budget_tokens, 6) AS fill,
       CAST({FX.BUDGET_LARGE} // {FX.CHUNK} AS BIGINT) AS planned_chunks FROM ch JOIN bud ON bud.source = ch.source""")
def q_sampling_plan(spark, sf_dir):
    """How full every budget is, and the chunks that the run plans for."""
    r = _run_sample(spark, sf_dir, FX.SPEC_PER_SOURCE_LARGE, FX.MIX_TEST).report(chunk_size=FX.CHUNK)
    return r.select("source", "used_chars", F.round("fill", 6).alias("fill"), "planned_chunks")


@register("budget_prefix", f"""WITH {bud_ctes(FX.SPEC_PER_SOURCE, FX.MIX_TEST)},
d AS ({_keyed_sql(FX.SPEC_PER_SOURCE)}),
p AS (SELECT d.doc_id, d.source, d.n_chars, d.k,
             CAST(sum(n_chars) OVER (PARTITION BY d.source ORDER BY k, n_chars ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS incl
      FROM d JOIN bud ON d.source = bud.source WHERE pass)
SELECT doc_id, source, n_chars, k, incl, incl - n_chars AS prior FROM p""")
def q_budget_prefix(spark, sf_dir):
    return sampling.budget_prefix(docs(spark, sf_dir), FX.SPEC_PER_SOURCE, mix(spark, FX.MIX_TEST))


@register("unknown_sources", f"""WITH mix(source, weight) AS (VALUES {_mix_values(FX.MIX_MISSING)})
SELECT source, count(*) AS n_docs FROM documents WHERE source NOT IN (SELECT source FROM mix) GROUP BY source""")
def q_unknown_sources(spark, sf_dir):
    return sampling.unknown_sources(docs(spark, sf_dir), mix(spark, FX.MIX_MISSING))


@register("shuffle_order", f"""SELECT doc_id, md5('{K.ORDER_SEED}:' || coalesce(doc_id::VARCHAR, '')) AS k,
row_number() OVER (ORDER BY md5('{K.ORDER_SEED}:' || coalesce(doc_id::VARCHAR, ''))) - 1 AS pos FROM documents""")
def q_shuffle_order(spark, sf_dir):
    return sampling.stream_position(docs(spark, sf_dir), FX.SPEC_PER_SOURCE)


@register("stream_rewrite", f"""SELECT doc_id, md5('{K.ORDER_SEED}:' || coalesce(doc_id::VARCHAR, '')) AS k,
row_number() OVER (ORDER BY md5('{K.ORDER_SEED}:' || coalesce(doc_id::VARCHAR, ''))) - 1 AS pos FROM documents""")
def q_stream_rewrite(spark, sf_dir):
    """The whole corpus written in stream order; positions come from the manifest and the files."""
    return stream_order.write_stream_order(docs(spark, sf_dir), n_parts=FX.STREAM_PARTS).positions(spark)


@register("sample_early_stop", _admitted_sql(FX.SPEC_PER_SOURCE, FX.MIX_TEST))
def q_sample_early_stop(spark, sf_dir):
    """Per-source admission over the corpus in stream order, read only until every source is full."""
    table = stream_order.write_stream_order(docs(spark, sf_dir).select("doc_id", "source", "n_chars"), n_parts=FX.STREAM_PARTS)
    return stream_order.sample_until_full(spark, table, FX.SPEC_PER_SOURCE, mix(spark, FX.MIX_TEST)).result.admitted


@register("scan_prefix_early_stop", f"""WITH {sampling_ctes(FX.SPEC_GLOBAL)}
SELECT d.source, count(*) AS scanned FROM d, stop WHERE stop.stop IS NULL OR d.k <= stop.stop GROUP BY d.source""")
def q_scan_prefix_early_stop(spark, sf_dir):
    table = stream_order.write_stream_order(docs(spark, sf_dir).select("doc_id", "source", "n_chars"), n_parts=FX.STREAM_PARTS)
    r = stream_order.sample_until_full(spark, table, FX.SPEC_GLOBAL).result
    return r.scanned().groupBy("source").agg(F.count(F.lit(1)).alias("scanned"))


# documents with null and repeated ids: every third id is that of its neighbours, every seventh is null
_ODD_IDS = "(SELECT CASE WHEN doc_id % 7 = 0 THEN NULL ELSE doc_id - doc_id % 3 END AS doc_id, source, n_chars FROM documents)"


def odd_ids(spark, sf_dir):
    d = docs(spark, sf_dir).select("doc_id", "source", "n_chars")
    return d.withColumn("doc_id", F.when(F.col("doc_id") % 7 == 0, None).otherwise(F.col("doc_id") - F.col("doc_id") % 3))


@register("sample_odd_ids", _admitted_sql(FX.SPEC_PER_SOURCE_LARGE, FX.MIX_TEST).replace("FROM documents", f"FROM {_ODD_IDS}")
          .replace("SELECT doc_id, source, n_chars, k, prior", "SELECT coalesce(doc_id, -1) AS doc_id, source, n_chars, k, prior"))
def q_sample_odd_ids(spark, sf_dir):
    a = sampling.sample(odd_ids(spark, sf_dir), FX.SPEC_PER_SOURCE_LARGE, mix(spark, FX.MIX_TEST)).admitted
    return a.withColumn("doc_id", F.coalesce("doc_id", F.lit(-1)))


@register("shuffle_order_odd_ids", f"""SELECT coalesce(doc_id, -1) AS doc_id, md5('{K.ORDER_SEED}:' || coalesce(doc_id::VARCHAR, '')) AS k,
row_number() OVER (ORDER BY md5('{K.ORDER_SEED}:' || coalesce(doc_id::VARCHAR, ''))) - 1 AS pos FROM {_ODD_IDS}""")
def q_shuffle_order_odd_ids(spark, sf_dir):
    p = sampling.stream_position(odd_ids(spark, sf_dir), FX.SPEC_PER_SOURCE)
    return p.withColumn("doc_id", F.coalesce("doc_id", F.lit(-1)))


@register("corpus_scan_json", """WITH c AS (SELECT source, text, n_chars, md5(coalesce(source, '') || chr(31) || coalesce(text, '')) AS c FROM documents),
n AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY n_chars) AS nth FROM c)
SELECT CAST('0x' || substr(md5(c || ':' || nth), 1, 15) AS BIGINT) AS doc_id, source, n_chars, md5(text) AS text_md5 FROM n""")
def q_corpus_scan_json(spark, sf_dir):
    """Raw corpus rows (text + nested source name) as JSON lines, scanned back with the fixed schema."""
    from ..sources import io as IO
    raw = docs(spark, sf_dir).select("text", F.struct(F.col("source").alias("redpajama_set_name")).alias("meta"))
    path = IO.write_jsonl(raw, spark, "raw_corpus")
    c = corpus_scan(spark, path, fmt="json", with_text=True)
    return c.select("doc_id", "source", "n_chars", F.md5("text").alias("text_md5"))
