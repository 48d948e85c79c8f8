"""Registered QA queries: normalisation, scoring, truncation, prompts, task files.

Fixture data derived from the driver tables:

* scoring pairs: every assistant turn is a prediction; the user turn right
  before it is the first reference answer, the turn two before (if any) the
  second;
* QA examples: ``id = item_id div 4``; the four benchmark texts of a group are
  the options; the answer is option ``id % 4``; the context is the document
  with ``doc_id = id``; the question is the first eight words of the answer.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import prompts as PR
from ..functions import scoring as S
from ..functions import tokens as TK
from ..operators.prefix import range_bucket, running_sum
from ..sources import io as IO
from ..sources.tables import read_table
from . import fixtures as FX
from .corpus import docs
from .packing import TOK_SQL
from .registry import register, sql_str

# ---------------------------------------------------------------- fixtures (Spark)


def pairs(spark, sf_dir) -> DataFrame:
    c = read_table(spark, sf_dir, "conversations")
    a = c.filter(F.col("role") == "assistant").select("conv_id", "turn", F.col("text").alias("prediction"))
    u = c.filter(F.col("role") == "user").select("conv_id", (F.col("turn") + 1).alias("turn"),
                                                 F.col("text").alias("answer"))
    v = c.select("conv_id", (F.col("turn") + 2).alias("turn"), F.col("text").alias("answer2"))
    p = a.join(u, ["conv_id", "turn"]).join(v, ["conv_id", "turn"], "left")
    return p.withColumn("answers", F.when(F.col("answer2").isNull(), F.array("answer"))
                        .otherwise(F.array("answer", "answer2")))


def option_groups(spark, sf_dir) -> DataFrame:
    """Four options per group (``g, n_groups, options``): items ``4 g .. 4 g + 3``, the last group is
    filled up from the first items, so every item is an option."""
    b = read_table(spark, sf_dir, "benchmark")
    n = b.count()
    groups = -(-n // 4)
    i = F.col("item_id")
    fill = 4 * groups - n
    places = F.array(F.struct(F.floor(i / 4).cast("long").alias("g"), (i % 4).alias("k")))
    again = F.when(i < fill, F.array(F.struct(F.lit(groups - 1).cast("long").alias("g"), (i + 4 - fill).alias("k")))
                   ).otherwise(F.array().cast("array<struct<g:bigint,k:bigint>>"))
    b = b.select("text", F.explode(F.concat(places, again)).alias("p")).select("text", "p.g", "p.k")
    b = b.groupBy("g").agg(F.array_sort(F.collect_list(F.struct("k", "text"))).alias("o"))
    return b.select("g", F.lit(max(groups, 1)).alias("n_groups"), F.transform("o", lambda z: z["text"]).alias("options"))


def _with_options(rows: DataFrame, groups: DataFrame, number) -> DataFrame:
    """Each row with the options of its group; every number falls into one, a null number has none."""
    n = groups.select("n_groups").first()
    return rows.withColumn("g", F.pmod(number, F.lit(n[0] if n else 1))).join(groups.drop("n_groups"), "g", "left").drop("g")


def examples(spark, sf_dir) -> DataFrame:
    """Every document is the context of one example; its options rotate over the item groups."""
    d = docs(spark, sf_dir).select(F.col("doc_id").alias("id"), F.col("text").alias("context"), "n_chars")
    e = _with_options(d, option_groups(spark, sf_dir), F.floor(F.col("id") / len(PR.TASKS)).cast("long"))
    e = e.withColumn("answer", F.array(F.element_at("options", (F.col("id") % 4 + 1).cast("int"))))
    return e.withColumn("input", F.array_join(F.slice(F.split(F.col("answer")[0], " "), 1, 8), " "))


def task_examples(spark, sf_dir) -> DataFrame:
    """Tasks rotate over the examples; code and math inputs carry a call / a target phrase."""
    e = examples(spark, sf_dir)
    e = e.withColumn("task", F.element_at(F.array(*[F.lit(t) for t in PR.TASKS]), (F.col("id") % len(PR.TASKS) + 1).cast("int")))
    inp = (F.when(F.col("task") == "code_run",
                  F.format_string("What is the value of func_%d(%d)?", F.col("id"), F.col("n_chars") % 7 - 3))
            .when(F.col("task") == "math_find",
                  F.format_string("The %s of the list is what?", F.lower(F.split(F.col("input"), " ")[0])))
            .otherwise(F.col("input")))
    return e.withColumn("input", inp)


# ---------------------------------------------------------------- SQL helpers

_WCH = r"[^\p{L}\p{Nd}\p{M}_]"
_ART = sql_str(f"(^|{_WCH})(" + "|".join(K.ARTICLES) + f")({_WCH}|$)")


def norm_en_sql(x: str) -> str:
    t = f"translate(lower({x}), {sql_str(K.ASCII_PUNCTUATION)}, '')"
    a1 = f"regexp_replace({t}, {_ART}, '\\1 \\3', 'g')"
    a2 = f"regexp_replace({a1}, {_ART}, '\\1 \\3', 'g')"
    return f"trim(regexp_replace({a2}, '\\s+', ' ', 'g'))"


def norm_zh_sql(x: str) -> str:
    t = f"translate(lower({x}), {sql_str(K.ASCII_PUNCTUATION + K.CJK_PUNCTUATION)}, '')"
    return f"regexp_replace({t}, '\\s+', '', 'g')"


def words_sql(x: str) -> str:
    return f"list_filter(string_split_regex({x}, '\\s+'), lambda w_: w_ <> '')"


def chars_sql(x: str) -> str:
    return f"list_filter(string_split({x}, ''), lambda w_: w_ <> '')"


def overlap_sql(p: str, g: str) -> str:
    return (f"CAST(coalesce(list_sum(list_transform(list_distinct({p}), lambda u_: least("
            f"len(list_filter({p}, lambda x_: x_ = u_)), len(list_filter({g}, lambda y_: y_ = u_))))), 0) AS BIGINT)")


def f1_sql(c: str, p: str, g: str) -> str:
    pr, rc = f"({c} / len({p}))", f"({c} / len({g}))"
    return f"CASE WHEN {c} = 0 THEN 0.0 ELSE 2 * {pr} * {rc} / ({pr} + {rc}) END"


PAIRS_SQL = """pairs AS (
  SELECT a.conv_id, a.turn, a.text AS prediction, u.text AS answer, v.text AS answer2
  FROM conversations a
  JOIN conversations u ON u.conv_id = a.conv_id AND u.turn = a.turn - 1 AND u.role = 'user'
  LEFT JOIN conversations v ON v.conv_id = a.conv_id AND v.turn = a.turn - 2
  WHERE a.role = 'assistant')"""

GROUPS_SQL = """nb AS (SELECT count(*) AS n, greatest(CAST(ceil(count(*) / 4) AS BIGINT), 1) AS ng FROM benchmark),
grp AS (SELECT g, list(b.text ORDER BY k) AS options FROM (SELECT g, k, (4 * g + k) % n AS item FROM nb,
        (SELECT unnest(range(ng)) AS g FROM nb), range(4) r(k)) x JOIN benchmark b ON b.item_id = x.item GROUP BY g)"""

EXAMPLES_SQL = f"""{GROUPS_SQL},
ex AS (SELECT d.doc_id AS id, options, [options[(d.doc_id % 4) + 1]] AS answer, d.text AS context, d.n_chars,
              array_to_string((string_split(options[(d.doc_id % 4) + 1], ' '))[1:8], ' ') AS input
       FROM documents d, nb JOIN grp ON grp.g = (d.doc_id // {len(PR.TASKS)}) % nb.ng)"""


# ---------------------------------------------------------------- normalising / matching

@register("normalize_en", f"SELECT conv_id, turn, {norm_en_sql('text')} AS norm FROM conversations")
def q_normalize_en(spark, sf_dir):
    c = read_table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", S.normalize_answer("text").alias("norm"))


@register("normalize_zh", f"SELECT conv_id, turn, {norm_zh_sql('text')} AS norm FROM conversations")
def q_normalize_zh(spark, sf_dir):
    c = read_table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", S.normalize_zh_answer("text").alias("norm"))


@register("first_int_match", f"""WITH {PAIRS_SQL}
SELECT conv_id, turn, CAST(coalesce(regexp_extract(prediction, '[0-9]+', 0), '') = coalesce(regexp_extract(answer, '[0-9]+', 0), '') AS INTEGER) AS score FROM pairs""")
def q_first_int_match(spark, sf_dir):
    p = pairs(spark, sf_dir)
    return p.select("conv_id", "turn", S.first_int_match("prediction", F.regexp_extract("answer", "[0-9]+", 0)).alias("score"))


@register("in_match", f"""WITH {PAIRS_SQL}
SELECT conv_id, turn, CAST(contains(prediction, answer) AS INTEGER) AS score,
  CAST(contains(lower(prediction), lower(({words_sql('answer')})[-1])) AS INTEGER) AS last_word FROM pairs""")
def q_in_match(spark, sf_dir):
    p = pairs(spark, sf_dir)
    last = F.try_element_at(S.words("answer"), F.lit(-1))
    return p.select("conv_id", "turn", S.in_match("prediction", "answer").alias("score"),
                    S.in_match(F.lower("prediction"), F.lower(last)).alias("last_word"))


@register("token_f1", f"""WITH {PAIRS_SQL},
t AS (SELECT conv_id, turn, {words_sql('prediction')} AS p, {words_sql('answer')} AS g FROM pairs),
c AS (SELECT *, {overlap_sql('p', 'g')} AS c FROM t)
SELECT conv_id, turn, c AS common, {f1_sql('c', 'p', 'g')} AS f1 FROM c""")
def q_token_f1(spark, sf_dir):
    p = pairs(spark, sf_dir).select("conv_id", "turn", S.words("prediction").alias("p"), S.words("answer").alias("g"))
    return p.select("conv_id", "turn", S.multiset_overlap(F.col("p"), F.col("g")).cast("long").alias("common"),
                    S.f1_tokens(F.col("p"), F.col("g")).alias("f1"))


@register("qa_f1", f"""WITH {PAIRS_SQL},
a AS (SELECT conv_id, turn, prediction, answer AS ans FROM pairs
      UNION ALL SELECT conv_id, turn, prediction, answer2 FROM pairs WHERE answer2 IS NOT NULL),
t AS (SELECT conv_id, turn, {words_sql(norm_en_sql('prediction'))} AS p, {words_sql(norm_en_sql('ans'))} AS g FROM a),
c AS (SELECT *, {overlap_sql('p', 'g')} AS c FROM t)
SELECT conv_id, turn, greatest(max({f1_sql('c', 'p', 'g')}), 0.0) AS score FROM c GROUP BY conv_id, turn""")
def q_qa_f1(spark, sf_dir):
    p = pairs(spark, sf_dir)
    return p.select("conv_id", "turn", S.qa_f1("prediction", "answers").alias("score"))


@register("qa_f1_zh", f"""WITH {PAIRS_SQL},
t AS (SELECT conv_id, turn, {chars_sql(norm_zh_sql('prediction'))} AS p, {chars_sql(norm_zh_sql('answer'))} AS g FROM pairs),
c AS (SELECT *, {overlap_sql('p', 'g')} AS c FROM t)
SELECT conv_id, turn, {f1_sql('c', 'p', 'g')} AS score FROM c""")
def q_qa_f1_zh(spark, sf_dir):
    p = pairs(spark, sf_dir)
    return p.select("conv_id", "turn", S.qa_f1_zh("prediction", "answer").alias("score"))


def _rouge_l_sql(tok) -> str:
    """ROUGE-L F of every pair by a recursive LCS table (one row of the table per prediction token)."""
    return f"""WITH RECURSIVE {PAIRS_SQL},
pr AS (SELECT conv_id, turn, conv_id * 100 + turn AS id, {tok('prediction')} AS p, {tok('answer')} AS g FROM pairs),
dp(id, i, r) AS (
  SELECT id, 0, list_transform(range(len(g) + 1), lambda x_: 0) FROM pr
  UNION ALL
  SELECT dp.id, dp.i + 1,
         list_reduce(range(1, len(pr.g) + 1),
                     lambda acc, j: list_append(acc, CASE WHEN pr.g[j] = pr.p[dp.i + 1] THEN dp.r[j] + 1
                                                      ELSE greatest(acc[j], dp.r[j + 1]) END), [0])
  FROM dp JOIN pr ON dp.id = pr.id WHERE dp.i < len(pr.p)),
l AS (SELECT dp.id, dp.r[-1] AS lcs FROM dp JOIN pr ON dp.id = pr.id WHERE dp.i = len(pr.p))
SELECT pr.conv_id, pr.turn, CASE WHEN l.lcs = 0 THEN 0.0
       ELSE 2 * (l.lcs / len(pr.p)) * (l.lcs / len(pr.g)) / ((l.lcs / len(pr.p)) + (l.lcs / len(pr.g))) END AS score
FROM pr JOIN l ON pr.id = l.id"""


@register("rouge_l", _rouge_l_sql(lambda x: words_sql(f"lower({x})")))
def q_rouge_l(spark, sf_dir):
    p = pairs(spark, sf_dir)
    return p.select("conv_id", "turn", S.rouge_l("prediction", "answer").alias("score"))


# the character-level table one row at a time: v[i][j] is the best of v[i-1][j] and, over the matches k <= j,
# v[i-1][k-1] + 1, a running maximum; only the last row of each pair is kept
_ROUGE_L_ZH_SQL = f"""WITH RECURSIVE {PAIRS_SQL},
pr AS MATERIALIZED (SELECT conv_id * 100 + turn AS id, conv_id, turn, {chars_sql('prediction')} AS p, {chars_sql('answer')} AS g FROM pairs),
g AS MATERIALIZED (SELECT id, unnest(g) AS c, unnest(range(1, len(g) + 1)) AS j FROM pr),
p AS MATERIALIZED (SELECT id, unnest(p) AS c, unnest(range(1, len(p) + 1)) AS i FROM pr),
dp(id, j, c, i, v) USING KEY (id, j) AS (
  SELECT id, j, c, 0::BIGINT, 0::BIGINT FROM g
  UNION
  SELECT id, j, c, i, greatest(v, coalesce(max(CASE WHEN hit THEN before + 1 END)
      OVER (PARTITION BY id ORDER BY j ROWS UNBOUNDED PRECEDING), 0)) FROM (
    SELECT dp.id, dp.j, dp.c, dp.i + 1 AS i, dp.v, dp.c = p.c AS hit,
      coalesce(lag(dp.v) OVER (PARTITION BY dp.id ORDER BY dp.j), 0) AS before
    FROM dp JOIN p ON p.id = dp.id AND p.i = dp.i + 1)),
l AS (SELECT id, max(v) AS lcs FROM dp GROUP BY id),
x AS (SELECT conv_id, turn, coalesce(lcs, 0) AS c, len(p) AS np, len(g) AS ng FROM pr LEFT JOIN l ON l.id = pr.id)
SELECT conv_id, turn, CASE WHEN c = 0 THEN 0.0 ELSE 2 * (c / np) * (c / ng) / ((c / np) + (c / ng)) END AS score FROM x"""


@register("rouge_l_zh", _ROUGE_L_ZH_SQL)
def q_rouge_l_zh(spark, sf_dir):
    p = pairs(spark, sf_dir)
    return p.select("conv_id", "turn", S.rouge_l_zh("prediction", "answer").alias("score"))


@register("rouge_l_native", _rouge_l_sql(lambda x: words_sql(f"lower({x})")))
def q_rouge_l_native(spark, sf_dir):
    """ROUGE-L of the same pairs without a Python worker."""
    p = pairs(spark, sf_dir)
    return p.select("conv_id", "turn", S.rouge_l_native("prediction", "answer").alias("score"))


@register("word_recall", f"""WITH {PAIRS_SQL},
t AS (SELECT conv_id, turn, list_distinct({words_sql('lower(answer)')}) AS g, {words_sql('lower(prediction)')} AS p FROM pairs)
SELECT conv_id, turn, CASE WHEN len(g) = 0 THEN NULL ELSE len(list_intersect(g, p)) / len(g) END AS recall FROM t""")
def q_word_recall(spark, sf_dir):
    p = pairs(spark, sf_dir)
    return p.select("conv_id", "turn", S.word_recall("prediction", "answer").alias("recall"))


@register("running_recall", f"""WITH {PAIRS_SQL},
t AS (SELECT conv_id, turn, list_distinct({words_sql('lower(answer)')}) AS g, {words_sql('lower(prediction)')} AS p FROM pairs),
r AS (SELECT conv_id, turn, CASE WHEN len(g) = 0 THEN 0.0 ELSE len(list_intersect(g, p)) / len(g) END AS recall FROM t)
SELECT conv_id, turn, round(avg(recall) OVER (ORDER BY conv_id, turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS recall_so_far FROM r""")
def q_running_recall(spark, sf_dir):
    p = pairs(spark, sf_dir)
    r = p.select("conv_id", "turn", F.coalesce(S.word_recall("prediction", "answer"), F.lit(0.0)).alias("recall"),
                 F.lit(1).cast("long").alias("one"))
    # scored pairs written once (narrow): the bucket range and both running sums read the table
    from ..session import cut_lineage
    r = cut_lineage(r, "recall")
    # running mean = running sum / running count: what lies before a conversation (one row each, ranges of
    # conv_id), then inside it by ranges of its turns, so that a very long conversation is spread as well
    per = r.groupBy("conv_id").agg(F.sum("recall").alias("c_recall"), F.sum("one").alias("c_one"))
    conv = range_bucket(r, "conv_id", FX.RECALL_BUCKETS)
    for c in ("recall", "one"):
        per = running_sum(per, f"c_{c}", ["conv_id"], conv, out=f"upto_{c}")
    per = per.select(F.col("conv_id").alias("_conv"), *[(F.col(f"upto_{c}") - F.col(f"c_{c}")).alias(f"before_{c}") for c in ("recall", "one")])
    turns = range_bucket(r, "turn", 64)
    for c in ("recall", "one"):
        r = running_sum(r, c, ["turn"], turns, by=["conv_id"], out=f"in_{c}")
    r = r.join(per, F.col("conv_id").eqNullSafe(F.col("_conv")))
    mean = (F.col("before_recall") + F.col("in_recall")) / (F.col("before_one") + F.col("in_one"))
    return r.select("conv_id", "turn", F.round(mean, 6).alias("recall_so_far"))


@register("expand_choice", f"""WITH {GROUPS_SQL},
p AS (SELECT c.conv_id, c.turn, lower(c.text) AS pred, options FROM conversations c, nb LEFT JOIN grp ON grp.g = ((c.conv_id % nb.ng) + nb.ng) % nb.ng
      WHERE c.role = 'assistant'),
q AS (SELECT *, trim(lower(substr(pred, 1, 1))) AS f FROM p)
SELECT conv_id, turn, CASE
  WHEN length(pred) = 0 THEN pred
  WHEN f = 'a' AND NOT contains(pred, options[1]) THEN pred || ' ' || lower(options[1])
  WHEN f = 'b' AND NOT contains(pred, options[2]) THEN pred || ' ' || lower(options[2])
  WHEN f = 'c' AND NOT contains(pred, options[3]) THEN pred || ' ' || lower(options[3])
  WHEN f = 'd' AND NOT contains(pred, options[4]) THEN pred || ' ' || lower(options[4])
  ELSE pred END AS prediction FROM q""")
def q_expand_choice(spark, sf_dir):
    c = read_table(spark, sf_dir, "conversations").filter(F.col("role") == "assistant")
    j = _with_options(c, option_groups(spark, sf_dir), F.col("conv_id"))
    return j.select("conv_id", "turn", S.expand_choice(F.lower("text"), "options").alias("prediction"))


@register("answer_letters", f"""WITH {EXAMPLES_SQL}
SELECT id, answer[1] AS answer_text, substr('ABCD', CAST(list_position(options, answer[1]) AS INTEGER), 1) AS letter FROM ex""")
def q_answer_letters(spark, sf_dir):
    e = examples(spark, sf_dir)
    a = S.answer_letters("answer", "options")
    return e.select("id", a[0].alias("answer_text"), a[1].alias("letter"))


# ---------------------------------------------------------------- truncation

def _trunc_sql(m: int, exact: bool) -> str:
    left = m // 2
    right = (m - left) if exact else m // 2
    return f"""WITH t AS (SELECT doc_id, {TOK_SQL} AS t FROM documents),
u AS (SELECT doc_id, CASE WHEN len(t) <= {m} THEN t ELSE list_concat(t[1:{left}], t[len(t) - {right} + 1:len(t)]) END AS u FROM t)
SELECT doc_id, CAST(len(u) AS INTEGER) AS n_kept, md5(array_to_string(u, '')) AS kept_md5 FROM u"""


@register("truncate_middle", _trunc_sql(FX.TRUNCATE_M, exact=False))
def q_truncate_middle(spark, sf_dir):
    t = docs(spark, sf_dir).select("doc_id", TK.truncate_middle(TK.tokenize("text"), FX.TRUNCATE_M).alias("u"))
    return t.select("doc_id", F.size("u").alias("n_kept"), F.md5(F.array_join("u", "")).alias("kept_md5"))


@register("truncate_middle_exact", _trunc_sql(FX.TRUNCATE_M, exact=True))
def q_truncate_middle_exact(spark, sf_dir):
    t = docs(spark, sf_dir).select("doc_id", TK.truncate_middle_exact(TK.tokenize("text"), FX.TRUNCATE_M).alias("u"))
    return t.select("doc_id", F.size("u").alias("n_kept"), F.md5(F.array_join("u", "")).alias("kept_md5"))


@register("truncate_text", _trunc_sql(FX.TRUNCATE_TEXT_TOKENS, exact=False).replace(
    "SELECT doc_id, CAST(len(u) AS INTEGER) AS n_kept, md5(array_to_string(u, '')) AS kept_md5 FROM u",
    "SELECT doc_id, CAST(length(array_to_string(u, '')) AS INTEGER) AS n_chars_kept, md5(array_to_string(u, '')) AS text_md5 FROM u"))
def q_truncate_text(spark, sf_dir):
    t = docs(spark, sf_dir).select("doc_id", TK.truncate_text("text", FX.TRUNCATE_TEXT_TOKENS).alias("x"))
    return t.select("doc_id", F.length("x").alias("n_chars_kept"), F.md5("x").alias("text_md5"))


# ---------------------------------------------------------------- tasks, prompts, files

@register("task_slice", f"""WITH {EXAMPLES_SQL}
SELECT id, input FROM ex WHERE id >= {FX.SLICE_START} AND id < {FX.SLICE_STOP}""")
def q_task_slice(spark, sf_dir):
    e = examples(spark, sf_dir)
    return e.filter((F.col("id") >= FX.SLICE_START) & (F.col("id") < FX.SLICE_STOP)).select("id", "input")


def _task_inputs_sql() -> str:
    tasks = ", ".join(sql_str(t) for t in PR.TASKS)
    return f"""tex0 AS (SELECT ex.*, ([{tasks}])[id % {len(PR.TASKS)} + 1] AS task FROM ex),
tex AS (SELECT tex0.*,
  CASE WHEN task = 'code_run' THEN printf('What is the value of func_%d(%d)?', id, n_chars % 7 - 3)
       WHEN task = 'math_find' THEN printf('The %s of the list is what?', lower((string_split(input, ' '))[1]))
       ELSE input END AS tinput
  FROM tex0)"""


@register("task_load", f"""WITH {EXAMPLES_SQL}, {_task_inputs_sql()}
SELECT task, id, tinput AS input, answer[1] AS answer_text, CAST(len(options) AS INTEGER) AS n_options FROM tex""")
def q_task_load(spark, sf_dir):
    """All task files written flat, with answers as lists or plain strings, and read back by task name."""
    e = task_examples(spark, sf_dir).select("id", "task", "context", "input", "answer", "options")
    folder = IO.write_task_files(e, spark, "tasks", plain_answers=["passkey", "math_find"])
    back = None
    for t in PR.TASKS:
        one = IO.load_task(spark, folder, t).withColumn("task", F.lit(t))
        back = one if back is None else back.unionByName(one)
    return back.select("task", "id", "input", F.col("answer")[0].alias("answer_text"), F.size("options").alias("n_options"))


@register("jsonl_roundtrip", f"""WITH {PAIRS_SQL}
SELECT conv_id * 100 + turn AS id, md5(prediction) AS prediction_md5,
       CAST(CASE WHEN answer2 IS NULL THEN 1 ELSE 2 END AS INTEGER) AS n_truths FROM pairs""")
def q_jsonl_roundtrip(spark, sf_dir):
    p = pairs(spark, sf_dir).select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), "prediction",
                                    F.col("answers").alias("ground_truth"))
    path = IO.write_jsonl(p, spark, "preds_longbook_qa_eng")
    back = IO.read_jsonl(spark, path, IO.PREDICTION)
    return back.select("id", F.md5("prediction").alias("prediction_md5"), F.size("ground_truth").alias("n_truths"))


@register("sharded_load", "SELECT doc_id, source, n_chars FROM documents")
def q_sharded_load(spark, sf_dir):
    d = docs(spark, sf_dir).select("doc_id", "source", "n_chars")
    path = IO.write_sharded(d, spark, "docs_sharded", FX.N_SHARDS, "doc_id")
    back = IO.read_sharded(spark, path, d.schema)
    return back.select("doc_id", "source", "n_chars")


@register("json_doc_roundtrip", f"""WITH {PAIRS_SQL}
SELECT conv_id, turn, CAST(CASE WHEN answer2 IS NULL THEN 1 ELSE 2 END AS INTEGER) AS n_answers,
       md5(answer || CASE WHEN answer2 IS NULL THEN '' ELSE '|' || answer2 END) AS answers_md5 FROM pairs""")
def q_json_doc_roundtrip(spark, sf_dir):
    p = pairs(spark, sf_dir).select("conv_id", "turn", "answers")
    path = IO.write_text(IO.to_pretty_json(p), spark, "pretty")
    back = IO.read_pretty(spark, path, "conv_id long, turn long, answers array<string>")
    return back.select("conv_id", "turn", F.size("answers").alias("n_answers"),
                       F.md5(F.array_join("answers", "|")).alias("answers_md5"))


def _templates_sql() -> str:
    vals = ", ".join(f"({sql_str(m)}, {sql_str(t)}, {sql_str(x)})" for m, t, x in PR.template_rows())
    return f"tpl(model, task, template) AS (VALUES {vals})"


def _render_sql() -> str:
    opt = {f"OPTION_{L}": f"tex.options[{i + 1}]" for i, L in enumerate("ABCD")}
    call = "nullif(regexp_extract(tinput, 'func_[0-9]+\\(-?[0-9]+\\)', 0), '')"
    tgt = "nullif(regexp_extract(tinput, 'The .+ of', 0), '')"
    f = {"context": "tex.context", "question": "tinput", "input": "tinput",
         "prefix": f"'What is ' || substr(lower({tgt}), 1, length({tgt}) - 3) || ' in the following list?'",
         "func": f"split_part({call}, '(', 1)", "func_call": call, **opt}
    cases = []
    for t in list(PR.TASK_FIELDS) + ["__default__"]:
        names = PR.TASK_FIELDS.get(t, PR.DEFAULT_FIELDS)
        r = "template"
        for n in [n for n in names if n != "context"] + (["context"] if "context" in names else []):
            r = f"replace({r}, '{{{n}}}', {f[n]})"
        cases.append(("ELSE " if t == "__default__" else f"WHEN tex.task = '{t}' THEN ") + r)
    body = "CASE " + " ".join(cases) + " END"
    return f"""{EXAMPLES_SQL}, {_task_inputs_sql()}, {_templates_sql()},
r AS (SELECT tpl.model, tex.task, tex.id,
        CASE WHEN tpl.model = 'gpt4' AND tex.task = 'math_calc' THEN tex.context ELSE {body} END AS prompt
      FROM tex JOIN tpl ON tex.task = tpl.task)"""


@register("render_prompts", f"""WITH {_render_sql()}
SELECT model, task, id, coalesce(md5(prompt), '') AS prompt_md5, CAST(coalesce(length(prompt), -1) AS INTEGER) AS prompt_len,
  CASE WHEN prompt IS NULL THEN 'no value for prefix' ELSE '' END AS problem FROM r""")
def q_render_prompts(spark, sf_dir):
    """A prompt for every example and model; inputs without a target phrase are kept with the reason."""
    r = PR.render(task_examples(spark, sf_dir), PR.templates_frame(spark))
    return r.select("model", "task", "id", F.coalesce(F.md5("prompt"), F.lit("")).alias("prompt_md5"),
                    F.coalesce(F.length("prompt"), F.lit(-1)).alias("prompt_len"),
                    F.coalesce("problem", F.lit("")).alias("problem"))


@register("chat_messages", f"""WITH {_render_sql()},
m AS (SELECT task, id, CASE WHEN task = 'math_calc' THEN ['system:' || {sql_str(K.CALC_SYSTEM_MESSAGE)}, 'user:' || {sql_str(K.CALC_EXAMPLE_QUESTION)},
         'system:' || {sql_str(K.CALC_EXAMPLE_ANSWER)}, 'user:' || prompt]
       ELSE ['system:' || {sql_str(K.CHAT_SYSTEM_MESSAGE)}, 'user:' || prompt] END AS m FROM r WHERE model = 'gpt4')
SELECT task, id, CAST(len(m) AS INTEGER) AS n_messages, md5(array_to_string(m, chr(10))) AS messages_md5 FROM m""")
def q_chat_messages(spark, sf_dir):
    r = PR.render(task_examples(spark, sf_dir), PR.templates_frame(spark)).filter(F.col("model") == "gpt4")
    m = r.select("task", "id", PR.chat_messages(F.col("prompt"), F.col("task")).alias("m"))
    return m.select("task", "id", F.size("m").alias("n_messages"), F.md5(F.array_join(
        F.transform("m", lambda x: F.concat(x["role"], F.lit(":"), x["content"])), "\n")).alias("messages_md5"))


@register("extract_call", f"""WITH {EXAMPLES_SQL}, {_task_inputs_sql()}
SELECT id, nullif(regexp_extract(tinput, 'func_[0-9]+\\(-?[0-9]+\\)', 0), '') AS func_call,
       split_part(nullif(regexp_extract(tinput, 'func_[0-9]+\\(-?[0-9]+\\)', 0), ''), '(', 1) AS func
FROM tex""")
def q_extract_call(spark, sf_dir):
    e = task_examples(spark, sf_dir)
    call = PR.extract_call(F.col("input"))
    return e.select("id", call.alias("func_call"), PR.call_name(call).alias("func"))


@register("extract_target", f"""WITH {EXAMPLES_SQL}, {_task_inputs_sql()}
SELECT id, substr(lower(nullif(regexp_extract(tinput, 'The .+ of', 0), '')), 1,
                  length(nullif(regexp_extract(tinput, 'The .+ of', 0), '')) - 3) AS target FROM tex""")
def q_extract_target(spark, sf_dir):
    e = task_examples(spark, sf_dir)
    return e.select("id", PR.find_target(F.col("input")).alias("target"))
