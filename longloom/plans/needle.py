"""Registered needle-in-a-haystack queries.

Haystacks are the documents of each language, in ``doc_id`` order.  Model results are made from the
conversations (no model is run): every assistant turn is the result of one cell, its response the
first ``j`` words of the needle and the turn's text, ``j`` from the turn's hash.  ``j = 3`` has no
version (counts as 1), ``j = 5`` only has a version-2 result (still to run for version 1), and
``j = 4`` has a second, duplicate result with the first eight words (cell means average both).  Whole
cells are unfinished, so that the resume query has work to find: no turn is assigned to every
eleventh cell.
"""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from .. import constants as K
from ..functions import scoring as S
from ..functions import tokens as TK
from ..operators import haystack as H
from ..operators import report as R
from ..session import scratch_path
from ..sources import io as IO
from ..sources import results as RS
from . import fixtures as FX
from .corpus import docs
from .packing import TOK_SQL
from .qa import words_sql
from .registry import register, sql_str

NEEDLE = K.DEFAULT_NEEDLE
NEEDLE_TOKENS = len(re.findall(TK.TOKEN_PATTERN, NEEDLE))
NEEDLE_WORDS = NEEDLE.split()
MAX_LEN = K.CONTEXT_LENGTHS_MAX
BUF = K.FINAL_CONTEXT_LENGTH_BUFFER
MODEL_PREFIX = "lab/needle-1.0-"
RESULT_TS = "2024-01-01 00:00:00"
LANGS = ["de", "en", "es", "fr"]
N_CELLS = len(LANGS) * K.CONTEXT_LENGTHS_INTERVALS * K.DEPTH_PERCENT_INTERVALS
UNFINISHED = 11                 # every so manieth cell gets no result

# grid values for the oracle, in closed form in SQL: i-th of n evenly spaced values, half to even
_STEP_LEN = f"{K.CONTEXT_LENGTHS_MIN} + i * ({K.CONTEXT_LENGTHS_MAX} - {K.CONTEXT_LENGTHS_MIN}) / CAST({K.CONTEXT_LENGTHS_INTERVALS - 1} AS DOUBLE)"
_STEP_DEPTH = f"{K.DEPTH_PERCENT_MIN} + i * ({K.DEPTH_PERCENT_MAX} - {K.DEPTH_PERCENT_MIN}) / CAST({K.DEPTH_PERCENT_INTERVALS - 1} AS DOUBLE)"
LENGTHS_SQL = (f"SELECT CAST(round_even({_STEP_LEN}, 0) AS INTEGER) AS context_length "
               f"FROM range({K.CONTEXT_LENGTHS_INTERVALS}) t(i)")
DEPTHS_SQL = (f"SELECT CAST(round_even({_STEP_DEPTH}, 0) AS DOUBLE) AS depth_percent "
              f"FROM range({K.DEPTH_PERCENT_INTERVALS}) t(i)")
# column names of the pivot
LENGTHS = [round(K.CONTEXT_LENGTHS_MIN + i * (K.CONTEXT_LENGTHS_MAX - K.CONTEXT_LENGTHS_MIN) / (K.CONTEXT_LENGTHS_INTERVALS - 1))
           for i in range(K.CONTEXT_LENGTHS_INTERVALS)]
# the ends of the logistic scale are exact
SIGMOID_SQL = (f"SELECT CASE i WHEN 0 THEN CAST(0 AS DOUBLE) WHEN {K.DEPTH_PERCENT_INTERVALS - 1} THEN CAST(100 AS DOUBLE) "
               f"ELSE round_even({K.LOGISTIC_L} / (1 + exp({K.LOGISTIC_K} * ({K.LOGISTIC_X0} - ({_STEP_DEPTH})))), 3) END "
               f"AS depth_percent FROM range({K.DEPTH_PERCENT_INTERVALS}) t(i)")


# ---------------------------------------------------------------- Spark side

def hay(spark, sf_dir):
    d = docs(spark, sf_dir).select("lang", "doc_id", "text", "n_chars")
    return H.haystacks(d, MAX_LEN, group="lang", order="doc_id", chars="n_chars")


def cells(spark, sf_dir, sigmoid=False, h=None):
    h = h if h is not None else hay(spark, sf_dir)
    lengths, depths = H.default_axes(sigmoid)
    return H.needle_cells(h, lengths, depths, NEEDLE_TOKENS, group="lang")


def results(spark, sf_dir):
    """One result for every assistant turn, assigned to a (language, length, depth) cell by its hash.

    The response is the first ``j`` words of the needle followed by the turn's own text (null for a
    null text)."""
    lengths, depths = H.default_axes()
    c = FX.assistant_turns(spark, sf_dir)
    h = F.conv(F.substring(F.md5(F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string"))), 1, 8),
               16, 10).cast("long")
    n_len, n_lang = K.CONTEXT_LENGTHS_INTERVALS, len(LANGS)
    words = F.array(*[F.lit(w) for w in NEEDLE_WORDS])
    c = c.withColumn("h", h).withColumn("cell", F.col("h") % N_CELLS)
    c = c.withColumn("cell", F.col("cell") + (F.col("cell") % UNFINISHED == 0).cast("int"))
    r = c.select(
        F.concat(F.lit(MODEL_PREFIX), F.element_at(F.array(*[F.lit(x) for x in LANGS]), (F.col("cell") % n_lang + 1).cast("int"))).alias("model"),
        F.element_at(lengths, (F.floor(F.col("cell") / n_lang) % n_len + 1).cast("int")).cast("int").alias("context_length"),
        F.element_at(depths, (F.floor(F.col("cell") / (n_lang * n_len)) + 1).cast("int")).cast("double").alias("depth_percent"),
        (F.col("h") % (len(NEEDLE_WORDS) + 1)).cast("int").alias("j"), "text")
    resp = F.when(F.col("j") == 0, F.col("text")).otherwise(
        F.concat(F.array_join(F.slice(words, 1, F.col("j")), " "), F.lit(" "), F.col("text")))
    version = F.when(F.col("j") == 3, F.lit(None).cast("int")).when(F.col("j") == 5, F.lit(2)).otherwise(F.lit(1))
    r = r.select("model", "context_length", "depth_percent", version.alias("version"),
                 F.lit(NEEDLE).alias("needle"), resp.alias("model_response"), "j")
    dup = r.filter(F.col("j") == 4).withColumn("model_response", F.array_join(F.slice(words, 1, 8), " "))
    r = r.unionByName(dup).drop("j")
    r = r.withColumn("test_duration_seconds", F.length(F.coalesce("model_response", F.lit(""))) * 0.5)
    # the zone is part of the text, whatever the session's zone
    r = r.withColumn("test_timestamp_utc", F.concat(F.date_format(F.to_timestamp_ntz(F.lit(RESULT_TS)), "yyyy-MM-dd HH:mm:ss"),
                                                    F.lit("+0000")))
    r = r.withColumn("score", S.needle_score(F.coalesce(F.col("model_response"), F.lit("")), F.col("needle")))
    return r.withColumn("file_name", H.cell_name(F.col("model"), F.col("context_length"), F.col("depth_percent")))


# ---------------------------------------------------------------- SQL side

def _list(xs) -> str:
    return "[" + ", ".join(repr(x) for x in xs) + "]"


HAY_SQL = f"""t AS (SELECT lang AS g, doc_id AS o, {TOK_SQL} AS toks FROM documents),
t2 AS (SELECT *, len(toks) AS n FROM t WHERE len(toks) > 0),
tot AS (SELECT g, CAST(sum(n) AS BIGINT) AS total, CAST(ceil({MAX_LEN} / sum(n)) AS BIGINT) AS passes FROM t2 GROUP BY g),
rep AS (SELECT t2.*, tot.total, tot.passes, unnest(generate_series(0, tot.passes - 1)) AS pass FROM t2 JOIN tot ON t2.g = tot.g),
hw AS (SELECT *, CAST(sum(n) OVER (PARTITION BY g ORDER BY pass, o ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) - n AS prior FROM rep),
hp AS (SELECT g, total, passes, pass, o, prior, toks[1:least(n, {MAX_LEN} - prior)] AS piece FROM hw WHERE prior < {MAX_LEN}),
hay AS (SELECT g AS lang, max(total) AS n_tokens, max(passes) AS passes, flatten(list(piece ORDER BY prior)) AS tokens FROM hp GROUP BY g),
hay2 AS (SELECT lang, tokens, CAST(len(tokens) AS INTEGER) AS h_len FROM hay),
pos AS (SELECT lang, generate_subscripts(tokens, 1) - 1 AS pos, unnest(tokens) AS tok FROM hay),
lp AS (SELECT lang, pos, coalesce(max(CASE WHEN tok = '.' THEN pos END) OVER (PARTITION BY lang ORDER BY pos
        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), -1) AS last_period FROM pos)"""


def _cells_sql(depths) -> str:
    return f"""{HAY_SQL},
gl AS ({LENGTHS_SQL}),
gd AS ({depths}),
c AS (SELECT h.lang, h.h_len, CAST(gl.context_length AS INTEGER) AS context_length, gd.depth_percent,
        CAST(CASE WHEN least(gl.context_length, h.h_len) + {NEEDLE_TOKENS} > gl.context_length - {BUF}
             THEN greatest(gl.context_length - {BUF} - {NEEDLE_TOKENS}, 0) ELSE least(gl.context_length, h.h_len) END AS INTEGER) AS ctx_tokens
      FROM hay2 h, gl, gd),
c2 AS (SELECT *, CAST(trunc(ctx_tokens * (depth_percent / CAST(100 AS DOUBLE))) AS INTEGER) AS ip FROM c),
c3 AS (SELECT c2.*, lp.last_period FROM c2 LEFT JOIN lp ON lp.lang = c2.lang AND lp.pos = c2.ip - 1),
cells AS (SELECT lang, h_len, context_length, depth_percent, ctx_tokens,
        CAST(CASE WHEN depth_percent = 100 THEN ctx_tokens WHEN ip <= 0 THEN 0 ELSE coalesce(last_period, -1) + 1 END AS INTEGER) AS insert_at,
        ctx_tokens + {NEEDLE_TOKENS} AS total_tokens FROM c3)"""


CELLS_SQL = _cells_sql(DEPTHS_SQL)
ROUGE_TOK = "list_filter(string_split(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g'), ' '), lambda w_: w_ <> '')"


def _f1(p, g):
    ov = (f"CAST(coalesce(list_sum(list_transform(list_distinct({p}), lambda u_: least(len(list_filter({p}, lambda x_: x_ = u_)), "
          f"len(list_filter({g}, lambda y_: y_ = u_))))), 0) AS BIGINT)")
    pr, rc = f"({ov} / len({p}))", f"({ov} / len({g}))"
    return f"CASE WHEN {ov} = 0 THEN 0.0 ELSE 2 * {pr} * {rc} / ({pr} + {rc}) END"


_N = (len(LANGS), K.CONTEXT_LENGTHS_INTERVALS, K.DEPTH_PERCENT_INTERVALS)
RESULTS_SQL = f"""gl AS ({LENGTHS_SQL}),
gd AS ({DEPTHS_SQL}),
axes AS (SELECT (SELECT list(context_length ORDER BY context_length) FROM gl) AS ls, (SELECT list(depth_percent ORDER BY depth_percent) FROM gd) AS ds),
rj AS (SELECT text, CAST('0x' || substr(md5(concat_ws(':', conv_id, turn)), 1, 8) AS BIGINT) AS h FROM conversations WHERE role = 'assistant'),
rk AS (SELECT *, h % {len(NEEDLE_WORDS) + 1} AS j, h % {N_CELLS} + CAST(h % {N_CELLS} % {UNFINISHED} = 0 AS BIGINT) AS cell FROM rj),
res1 AS (SELECT {sql_str(MODEL_PREFIX)} || ({_list(LANGS)})[cell % {_N[0]} + 1] AS model, ls[(cell // {_N[0]}) % {_N[1]} + 1] AS context_length,
        ds[cell // {_N[0] * _N[1]} + 1] AS depth_percent,
        CASE WHEN j = 3 THEN NULL WHEN j = 5 THEN 2 ELSE 1 END AS version, {sql_str(NEEDLE)} AS needle,
        CASE WHEN j = 0 THEN text ELSE array_to_string(({_list(NEEDLE_WORDS)})[1:j], ' ') || ' ' || text END AS model_response, j
        FROM rk, axes),
res0 AS (SELECT * FROM res1 UNION ALL
         SELECT model, context_length, depth_percent, version, needle,
                array_to_string(({_list(NEEDLE_WORDS)})[1:8], ' ') AS model_response, j FROM res1 WHERE j = 4),
res AS (SELECT *, 10 * ({_f1(ROUGE_TOK.format(x="coalesce(model_response, '')"), ROUGE_TOK.format(x="needle"))}) AS score,
        CASE WHEN model_response IS NULL THEN 0.0 ELSE len(list_intersect({words_sql('lower(model_response)')}, {_list(K.EXPECTED_ANSWER.lower().split())}))
             / {float(len(K.EXPECTED_ANSWER.split()))} END AS recall FROM res0)"""


# ---------------------------------------------------------------- queries

@register("needle_grid", f"""WITH {HAY_SQL},
gl AS ({LENGTHS_SQL}),
gd AS ({DEPTHS_SQL})
SELECT h.lang, CAST(gl.context_length AS INTEGER) AS context_length, gd.depth_percent,
       CAST(least(gl.context_length, h.h_len) AS INTEGER) AS h_tokens FROM hay2 h, gl, gd""")
def q_needle_grid(spark, sf_dir):
    h = hay(spark, sf_dir).select("lang", F.size("tokens").alias("h_len"))
    g = H.with_grid(h, *H.default_axes())
    return g.select("lang", "context_length", "depth_percent",
                    F.least("context_length", "h_len").cast("int").alias("h_tokens"))


@register("needle_grid_range", f"""WITH gl AS ({LENGTHS_SQL}),
gd AS ({DEPTHS_SQL}),
l AS (SELECT DISTINCT lang FROM documents)
SELECT l.lang, CAST(gl.context_length AS INTEGER) AS context_length, gd.depth_percent FROM l, gl, gd
WHERE gl.context_length >= 20000 AND gl.context_length <= 40000""")
def q_needle_grid_range(spark, sf_dir):
    """The grid of every language within a range of context lengths."""
    langs = docs(spark, sf_dir).select("lang").distinct()
    return H.with_grid(langs, *H.default_axes(), min_len=20_000, max_len=40_000).select("lang", "context_length", "depth_percent")


@register("haystack_build", f"""WITH {HAY_SQL}
SELECT lang, passes, CAST(len(tokens) AS INTEGER) AS hay_len, md5(array_to_string(tokens, '')) AS hay_md5 FROM hay""")
def q_haystack_build(spark, sf_dir):
    h = hay(spark, sf_dir)
    return h.select("lang", "passes", F.size("tokens").alias("hay_len"),
                    F.md5(F.array_join("tokens", "")).alias("hay_md5"))


# the lines of a folder's files are the documents of its haystack
_FILES_HAY_SQL = HAY_SQL.replace(
    f"t AS (SELECT lang AS g, doc_id AS o, {TOK_SQL} AS toks FROM documents)",
    f"""fl AS (SELECT lang, doc_id, string_split(text, chr(10)) AS ls FROM documents),
fl2 AS (SELECT lang, doc_id, generate_subscripts(ls, 1) AS i, unnest(ls) || chr(10) AS text FROM fl),
t AS (SELECT lang AS g, doc_id * 1000000 + i AS o, {TOK_SQL} AS toks FROM fl2)""")


@register("haystack_files", f"""WITH {_FILES_HAY_SQL}
SELECT lang, passes, CAST(len(tokens) AS INTEGER) AS hay_len, md5(array_to_string(tokens, '')) AS hay_md5 FROM hay""")
def q_haystack_files(spark, sf_dir):
    """Haystacks of folders of text files (one folder a language), read in splits and ordered by file name."""
    path = scratch_path(spark, "essays")
    d = docs(spark, sf_dir).select("lang", "doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("lang", "doc_id")
    d.select("lang", "text").write.partitionBy("lang").text(path)
    lines = IO.read_text_lines(spark, path)
    h = H.haystacks(lines, MAX_LEN, group="lang", order="pos", chars="n_bytes")
    return h.select("lang", "passes", F.size("tokens").alias("hay_len"), F.md5(F.array_join("tokens", "")).alias("hay_md5"))


@register("insert_needle_tokens", f"""WITH {CELLS_SQL}
SELECT lang, context_length, depth_percent, ctx_tokens, insert_at, total_tokens FROM cells""")
def q_insert_needle_tokens(spark, sf_dir):
    return cells(spark, sf_dir).select("lang", "context_length", "depth_percent", "ctx_tokens", "insert_at",
                                       "total_tokens")


@register("sigmoid_depths", f"""WITH {_cells_sql(SIGMOID_SQL)}
SELECT lang, context_length, depth_percent, ctx_tokens, insert_at FROM cells""")
def q_sigmoid_depths(spark, sf_dir):
    return cells(spark, sf_dir, sigmoid=True).select("lang", "context_length", "depth_percent", "ctx_tokens",
                                                     "insert_at")


@register("needle_cases", f"""WITH {CELLS_SQL}
SELECT c.lang, c.context_length, c.depth_percent, c.insert_at, c.total_tokens,
       md5(array_to_string(h.tokens[1:c.insert_at], '') || {sql_str(NEEDLE)} ||
           array_to_string(h.tokens[c.insert_at + 1:c.ctx_tokens], '')) AS context_md5
FROM cells c JOIN hay h ON c.lang = h.lang""")
def q_needle_cases(spark, sf_dir):
    h = hay(spark, sf_dir)
    m = H.materialize(cells(spark, sf_dir, h=h), h, NEEDLE)
    return m.select("lang", "context_length", "depth_percent", "insert_at", "total_tokens",
                    F.md5("context").alias("context_md5"))


@register("insert_needle_sentence", f"""WITH d AS (SELECT doc_id, text, string_split(text, '.') AS parts FROM documents),
x AS (SELECT doc_id, parts, CAST(unnest({_list(FX.SENTENCE_DEPTHS)}) AS DOUBLE) AS depth FROM d),
y AS (SELECT doc_id, depth, parts, CAST(trunc(depth * len(parts)) AS INTEGER) AS place FROM x),
z AS (SELECT doc_id, depth, array_to_string(parts[1:place], '.') || '.' || {sql_str(NEEDLE)} || array_to_string(parts[place + 1:len(parts)], '.') AS out FROM y)
SELECT doc_id, depth, md5(out) AS out_md5, CAST(length(out) AS INTEGER) AS out_len FROM z""")
def q_insert_needle_sentence(spark, sf_dir):
    d = docs(spark, sf_dir).select("doc_id", "text")
    d = d.withColumn("depth", F.explode(F.array(*[F.lit(float(x)) for x in FX.SENTENCE_DEPTHS])))
    out = H.insert_needle_sentence(F.col("text"), F.lit(NEEDLE), F.col("depth"))
    return d.select("doc_id", "depth", F.md5(out).alias("out_md5"), F.length(out).alias("out_len"))


@register("rouge1", f"""WITH {RESULTS_SQL}
SELECT model, context_length, depth_percent, score FROM res""")
def q_rouge1(spark, sf_dir):
    return results(spark, sf_dir).select("model", "context_length", "depth_percent", "score")


@register("needle_recall", f"""WITH {RESULTS_SQL}
SELECT model, context_length, depth_percent, recall FROM res""")
def q_needle_recall(spark, sf_dir):
    r = R.with_recall(results(spark, sf_dir))
    return r.select("model", "context_length", "depth_percent", "recall")


@register("needle_summary", f"""WITH {RESULTS_SQL},
cs AS (SELECT model, depth_percent, context_length, avg(recall) AS cell_score FROM res GROUP BY ALL),
ov AS (SELECT model, avg(recall) AS overall_score FROM res GROUP BY model)
SELECT cs.model, depth_percent, context_length, round(cell_score, 6) AS cell_score, round(overall_score, 6) AS overall_score
FROM cs JOIN ov ON cs.model = ov.model""")
def q_needle_summary(spark, sf_dir):
    s = R.summary(R.with_recall(results(spark, sf_dir)))
    return s.select("model", "depth_percent", "context_length", F.round("cell_score", 6).alias("cell_score"),
                    F.round("overall_score", 6).alias("overall_score"))


_PIVOT_COLS = ", ".join(f'round(avg(CASE WHEN context_length = {L} THEN recall END), 6) AS "{L}"' for L in LENGTHS)


@register("needle_heatmap", f"""WITH {RESULTS_SQL}
SELECT model, depth_percent, {_PIVOT_COLS} FROM res GROUP BY model, depth_percent""")
def q_needle_heatmap(spark, sf_dir):
    p = R.heatmap(R.with_recall(results(spark, sf_dir)), LENGTHS)
    return p.select("model", "depth_percent", *[F.round(F.col(str(L)), 6).alias(str(L)) for L in LENGTHS])


@register("beyond_train_len", f"""WITH {RESULTS_SQL},
d AS (SELECT DISTINCT model, context_length FROM res),
i AS (SELECT model, context_length, row_number() OVER (PARTITION BY model ORDER BY context_length) - 1 AS idx FROM d)
SELECT model, count(*) AS n_lengths,
       CAST(coalesce(min(CASE WHEN context_length > {K.PRETRAINED_LEN} THEN idx END), max(idx)) AS INTEGER) AS pretrained_idx
FROM i GROUP BY model""")
def q_beyond_train_len(spark, sf_dir):
    return R.beyond_train_len(results(spark, sf_dir))


@register("needle_resume", f"""WITH {RESULTS_SQL},
m AS (SELECT DISTINCT model FROM res),
todo AS (SELECT m.model, CAST(gl.context_length AS INTEGER) AS context_length, gd.depth_percent FROM m, gl, gd)
SELECT t.model, t.context_length, t.depth_percent FROM todo t
WHERE NOT EXISTS (SELECT 1 FROM res r WHERE r.model = t.model AND r.context_length = t.context_length
                  AND r.depth_percent = t.depth_percent AND coalesce(r.version, 1) = 1)""")
def q_needle_resume(spark, sf_dir):
    res = results(spark, sf_dir)
    models = res.select("model").distinct()
    todo = H.with_grid(models, *H.default_axes())
    return R.resume(todo, res).select("model", "context_length", "depth_percent")


@register("needle_upsert", f"""WITH {RESULTS_SQL}
SELECT model, context_length, depth_percent, coalesce(version, 1) AS version, score FROM res""")
def q_needle_upsert(spark, sf_dir):
    """Results written by two runs; the second also replays cells of the first, which replaces them."""
    r = results(spark, sf_dir)
    path = scratch_path(spark, "needle_cells")
    RS.upsert_cells(r.filter(F.col("context_length") <= LENGTHS[20]), path)
    RS.upsert_cells(r.filter(F.col("context_length") > LENGTHS[10]), path)
    return RS.read_cells(spark, path).select("model", "context_length", "depth_percent",
                                             F.coalesce("version", F.lit(1)).alias("version"), "score")


@register("needle_resume_written", f"""WITH {RESULTS_SQL},
m AS (SELECT DISTINCT model FROM res WHERE context_length <= {LENGTHS[20]}),
todo AS (SELECT m.model, CAST(gl.context_length AS INTEGER) AS context_length, gd.depth_percent FROM m, gl, gd)
SELECT t.model, t.context_length, t.depth_percent FROM todo t
WHERE NOT EXISTS (SELECT 1 FROM res r WHERE r.model = t.model AND r.context_length = t.context_length AND r.context_length <= {LENGTHS[20]}
                  AND r.depth_percent = t.depth_percent AND coalesce(r.version, 1) = 1)""")
def q_needle_resume_written(spark, sf_dir):
    """Cells still to run after a run that wrote the shorter contexts: the folder says what is done."""
    path = scratch_path(spark, "needle_cells")
    RS.upsert_cells(results(spark, sf_dir).filter(F.col("context_length") <= LENGTHS[20]), path)
    done = RS.read_cells(spark, path)
    todo = H.with_grid(done.select("model").distinct(), *H.default_axes())
    return R.resume(todo, done).select("model", "context_length", "depth_percent")


@register("results_scan", f"""WITH {RESULTS_SQL}
SELECT model, depth_percent, CAST(1 AS BIGINT) AS n_unreadable, {_PIVOT_COLS} FROM res GROUP BY model, depth_percent""")
def q_results_scan(spark, sf_dir):
    """The heat map of a results folder that grew between two scans and holds one unreadable line."""
    r = results(spark, sf_dir)
    folder, ledger = scratch_path(spark, "results_folder"), scratch_path(spark, "results_ledger")
    IO.write_jsonl(r.filter(F.col("depth_percent") <= 50), spark, "", path=f"{folder}/a")
    RS.scan_results(spark, folder, ledger, whole_files=False)
    IO.write_jsonl(r.filter(F.col("depth_percent") > 50), spark, "", path=f"{folder}/b")
    r.limit(1).select(F.lit('{"model": "broken').alias("value")).write.text(f"{folder}/c")
    RS.scan_results(spark, folder, ledger, whole_files=False)
    p = R.heatmap(R.with_recall(RS.current_results(spark, ledger)), LENGTHS)
    bad = RS.quarantine(spark, ledger).count()
    return p.select("model", "depth_percent", F.lit(bad).cast("long").alias("n_unreadable"),
                    *[F.round(F.col(str(L)), 6).alias(str(L)) for L in LENGTHS])


@register("cell_name", f"""WITH {RESULTS_SQL}
SELECT model, context_length, depth_percent,
       printf('%s_len_%d_depth_%d', replace(split_part(model, '/', -1), '.', '_'), context_length,
              CAST(trunc(depth_percent * 100) AS BIGINT)) AS file_name FROM res""")
def q_cell_name(spark, sf_dir):
    return results(spark, sf_dir).select("model", "context_length", "depth_percent", "file_name")


_FILE_NAME_SQL = ("printf('%s_len_%d_depth_%d', replace(split_part(model, '/', -1), '.', '_'), context_length, "
                  "CAST(trunc(depth_percent * 100) AS BIGINT))")


@register("needle_write", f"""WITH {RESULTS_SQL}
SELECT context_length, depth_percent, score, {_FILE_NAME_SQL} AS file_name, '{RESULT_TS}+0000' AS test_timestamp_utc FROM res""")
def q_needle_write(spark, sf_dir):
    r = results(spark, sf_dir)
    path = IO.write_jsonl(r, spark, "needle_results", partition_by=["model"])
    back = IO.read_jsonl(spark, path, IO.NEEDLE_RESULT)
    return back.select("context_length", "depth_percent", "score", "file_name", "test_timestamp_utc")


@register("contexts_write", f"""WITH {CELLS_SQL},
m AS (SELECT {sql_str(MODEL_PREFIX)} || c.lang AS model, c.context_length, c.depth_percent,
             array_to_string(h.tokens[1:c.insert_at], '') || {sql_str(NEEDLE)} ||
             array_to_string(h.tokens[c.insert_at + 1:c.ctx_tokens], '') AS context
      FROM cells c JOIN hay h ON c.lang = h.lang)
SELECT model, context_length, depth_percent, {_FILE_NAME_SQL} AS file_name,
       CAST(length({sql_str(K.NEEDLE_PROMPT_PREFIX)} || context || {sql_str(K.NEEDLE_PROMPT_MIDDLE)} ||
            {sql_str(K.DEFAULT_RETRIEVAL_QUESTION)} || {sql_str(K.NEEDLE_PROMPT_SUFFIX)}) AS INTEGER) AS prompt_len,
       md5({sql_str(K.NEEDLE_PROMPT_PREFIX)} || context || {sql_str(K.NEEDLE_PROMPT_MIDDLE)} ||
            {sql_str(K.DEFAULT_RETRIEVAL_QUESTION)} || {sql_str(K.NEEDLE_PROMPT_SUFFIX)}) AS prompt_md5 FROM m""")
def q_contexts_write(spark, sf_dir):
    """Contexts with the needle, wrapped as prompts, written partitioned by model and context length."""
    from ..functions.prompts import needle_prompt
    h = hay(spark, sf_dir)
    m = H.materialize(cells(spark, sf_dir, h=h), h, NEEDLE)
    m = m.select(F.concat(F.lit(MODEL_PREFIX), F.col("lang")).alias("model"), "context_length", "depth_percent",
                 H.cell_name(F.concat(F.lit(MODEL_PREFIX), F.col("lang")), F.col("context_length"),
                             F.col("depth_percent")).alias("file_name"),
                 needle_prompt(F.col("context")).alias("prompt"))
    path = scratch_path(spark, "contexts")
    m.write.mode("overwrite").partitionBy("model", "context_length").parquet(path)
    back = spark.read.parquet(path)
    return back.select("model", "context_length", "depth_percent", "file_name", F.length("prompt").alias("prompt_len"),
                       F.md5("prompt").alias("prompt_md5"))
