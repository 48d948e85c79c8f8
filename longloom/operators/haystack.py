"""Needle-in-a-haystack test sets.

* grid: context lengths x depth percents (linear or logistic spacing);
* haystack: the documents of a group concatenated in order and repeated until
  the longest context is covered, built once (the original re-reads and
  re-encodes it for every cell);
* cells: for every (haystack, length, depth) only the insertion point is
  computed, by joining the cell to the haystack's running "last period"
  index - the context itself is materialised last, when it is written.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import constants as K
from ..functions.model_tokens import valid_text
from ..functions.tokens import PERIOD_TOKENS, tokenize
from ..session import cut_lineage


# ------------------------------------------------------------------ grid

def linear_values(lo: float, hi: float, n: int) -> Column:
    """array<int>: ``round(linspace(lo, hi, n))`` with half-to-even rounding."""
    if n == 1:
        return F.array(F.lit(int(round(lo))))
    step = (hi - lo) / (n - 1)
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)),
                       lambda i: F.when(i == n - 1, F.lit(float(hi))).otherwise(i * F.lit(step) + F.lit(float(lo))))


def rounded_int(values: Column) -> Column:
    return F.transform(values, lambda x: F.bround(x, 0).cast("int"))


def logistic_values(lo: float, hi: float, n: int) -> Column:
    """array<double>: logistic spacing of ``linspace(lo, hi, n)``; 0 and 100 stay exact."""
    xs = linear_values(lo, hi, n)
    L, x0, k = K.LOGISTIC_L, K.LOGISTIC_X0, K.LOGISTIC_K
    return F.transform(xs, lambda x: F.when(x == 0, F.lit(0.0)).when(x == 100, F.lit(100.0)).otherwise(
        F.bround(F.lit(float(L)) / (F.lit(1.0) + F.exp(F.lit(-k) * (x - F.lit(float(x0))))), 3)))


def with_grid(df: DataFrame, lengths: Column, depths: Column, min_len: int | None = None,
              max_len: int | None = None) -> DataFrame:
    """Every row of ``df`` once per (context_length, depth_percent) of the grid.

    The grid is two parameter arrays exploded in place (no join); the length
    range filter of the original runner is applied to the lengths.
    """
    g = df.withColumn("context_length", F.explode(lengths)).withColumn("context_length", F.col("context_length").cast("int"))
    if min_len is not None:
        g = g.filter(F.col("context_length") >= min_len)
    if max_len is not None:
        g = g.filter(F.col("context_length") <= max_len)
    g = g.withColumn("depth_percent", F.explode(depths))
    return g.withColumn("depth_percent", F.col("depth_percent").cast("double"))


def grid(spark: SparkSession, lengths: Column, depths: Column, min_len: int | None = None,
         max_len: int | None = None) -> DataFrame:
    """One row per (context_length, depth_percent)."""
    return with_grid(spark.range(1).drop("id"), lengths, depths, min_len, max_len)


def default_axes(sigmoid: bool = False) -> tuple[Column, Column]:
    lengths = rounded_int(linear_values(K.CONTEXT_LENGTHS_MIN, K.CONTEXT_LENGTHS_MAX, K.CONTEXT_LENGTHS_INTERVALS))
    if sigmoid:
        depths = logistic_values(K.DEPTH_PERCENT_MIN, K.DEPTH_PERCENT_MAX, K.DEPTH_PERCENT_INTERVALS)
    else:
        depths = rounded_int(linear_values(K.DEPTH_PERCENT_MIN, K.DEPTH_PERCENT_MAX, K.DEPTH_PERCENT_INTERVALS))
    return lengths, depths


def default_grid(spark: SparkSession, sigmoid: bool = False) -> DataFrame:
    return grid(spark, *default_axes(sigmoid))


# ------------------------------------------------------------------ haystack

LITERAL_GROUPS = 1000


def _reach(t: DataFrame, ranges: DataFrame, lo: int, width: int) -> DataFrame:
    """Rows of ``t`` up to the last wanted range of their group.

    For up to ``LITERAL_GROUPS`` groups these are literal bounds on the order column (one per group), so
    that the scan skips the row groups beyond them; more groups are joined, behind the greatest bound."""
    reach = ranges.groupBy(F.col("g").alias("_g")).agg((F.lit(lo) + (F.max("bk") + 1) * width).alias("_end"))
    last = reach.limit(LITERAL_GROUPS + 1).collect()
    if len(last) > LITERAL_GROUPS:
        top = reach.agg(F.max("_end")).first()[0]
        return t.filter(F.col("o") < F.lit(top)).join(
            reach, F.col("g").eqNullSafe(F.col("_g")) & (F.col("o") < F.col("_end")), "left_semi")
    keep = F.lit(False)
    for r in last:
        keep = keep | (F.col("g").eqNullSafe(F.lit(r["_g"])) & (F.col("o") < F.lit(r["_end"])))
    return t.filter(F.col("o") < F.lit(max((r["_end"] for r in last), default=lo))).filter(keep)


def haystacks(docs: DataFrame, max_len: int, group: str = "lang", order: str = "doc_id", text: str = "text",
              chars: str | None = None, n_buckets: int = 1024, materialize: bool = True,
              chars_per_token_guess: int = 8, tokenizer=None) -> DataFrame:
    """``group, passes, tokens array<string>`` (at most ``max_len`` tokens).

    Documents of a group are concatenated in ``order`` and the whole sequence is
    repeated until it reaches ``max_len`` tokens (``passes`` repetitions); only
    the first ``max_len`` tokens are kept (every context is a prefix of at most
    that length).

    Only the documents that can reach into the first ``max_len`` tokens are read and
    tokenized: the order is cut into ``n_buckets`` ranges, characters per range are
    summed (from the column ``chars`` when there is one, so that no text is read), and a
    prefix of ranges holding fewer than ``max_len * chars_per_token_guess`` characters is
    tokenized first; the guess widens (x4) until every group either reaches ``max_len``
    tokens or has all of its ranges counted (then its exact total fixes the number of
    passes).  Both times the wanted ranges become literal bounds on ``order`` in the scan.
    Offsets are two-level: per (group, pass, range) totals, then a window inside
    the ranges that reach into the first ``max_len`` tokens.  The result
    (groups x ``max_len`` tokens) is reused by every cell, so it is written once
    to the shared checkpoint folder unless ``materialize=False``.  A null group is a group.
    ``tokenizer`` maps a text column to an array of token strings.
    """
    split = tokenizer or tokenize
    size = F.col(chars) if chars else F.length(F.col(text))
    t = docs.select(F.col(group).alias("g"), F.col(order).alias("o"), F.col(text).alias("text"))
    c = docs.select(F.col(group).alias("g"), F.col(order).alias("o"), size.alias("c"))
    lo, hi = c.agg(F.min("o"), F.max("o")).first()
    if lo is None:
        return t.sparkSession.createDataFrame([], f"{group} string, passes long, tokens array<string>")
    width = max(1, math.ceil((hi - lo + 1) / n_buckets))
    bucket = F.floor((F.col("o") - F.lit(lo)) / width).cast("long")

    def same(a, b, *more):
        """Null-safe equality of the group and plain equality of the other columns."""
        on = a["g"].eqNullSafe(b["_g"])
        for x in more:
            on = on & (a[x] == b[f"_{x}"])
        return on

    def named(df, *cols):
        return df.select(*[F.col(x).alias(f"_{x}") if x in ("g", "bk") else F.col(x) for x in df.columns if x in cols or not cols])
    wb = Window.partitionBy("g").orderBy("bk").rowsBetween(Window.unboundedPreceding, -1)
    # characters per (group, range): groups x n_buckets rows
    ct = c.groupBy("g", bucket.alias("bk")).agg(F.sum("c").alias("bc"))
    ct = cut_lineage(ct.select("g", "bk", F.coalesce(F.sum("bc").over(wb), F.lit(0)).alias("chars_before")),
                     "haystack_chars")
    n_all = ct.groupBy(F.col("g").alias("_g")).agg(F.count(F.lit(1)).alias("n_all"))
    guess = max_len * chars_per_token_guess
    while True:
        cand = ct.filter(F.col("chars_before") < guess).select("g", "bk")
        bt = _reach(t, cand, lo, width).groupBy("g", bucket.alias("bk")).agg(
            F.sum(F.size(split(F.col("text")))).cast("long").alias("bn"))
        bt = cut_lineage(bt, "haystack_tokens")
        st = bt.groupBy("g").agg(F.sum("bn").alias("tok"), F.count(F.lit(1)).alias("n_cand"))
        st = st.join(n_all, same(st, n_all)).withColumn("covered", F.col("n_cand") == F.col("n_all"))
        pending = st.filter((F.coalesce("tok", F.lit(0)) < max_len) & ~F.col("covered")).count()
        if pending == 0:
            break
        guess *= 4
    # per group: exact total when all ranges were counted, else at least max_len (one pass)
    tot = named(st.filter(F.col("tok") > 0).select("g", "tok", "covered"))
    bt = bt.join(tot, same(bt, tot))
    bt = bt.select("g", "bk", "bn", F.coalesce(F.sum("bn").over(wb), F.lit(0)).alias("within"),
                   F.col("tok").alias("total"),
                   F.when(F.col("covered"), F.ceil(F.lit(max_len) / F.col("tok"))).otherwise(F.lit(1))
                   .cast("long").alias("passes"))
    # (group, pass, range) rows whose start lies inside the first max_len tokens: bounded by groups x (max_len + buckets)
    bp = bt.select("g", "bk", "within", "total", "passes",
                   F.explode(F.sequence(F.lit(0).cast("long"), F.col("passes") - 1)).alias("pass"))
    bp = bp.withColumn("off", F.col("pass") * F.col("total") + F.col("within")).filter(F.col("off") < max_len)
    bp = cut_lineage(bp, "haystack_ranges")
    # select the needed documents first, tokenize only those
    d = _reach(t, bp, lo, width).withColumn("bk", bucket)
    want = named(bp.select("g", "bk", "pass", "off", "passes"))
    j = d.join(want, same(d, want, "bk")).drop("_g", "_bk")
    j = j.withColumn("toks", split(F.col("text"))).withColumn("n", F.size("toks").cast("long")).drop("text")
    w = Window.partitionBy("g", "pass", "bk").orderBy("o").rowsBetween(Window.unboundedPreceding, 0)
    j = j.withColumn("prior", F.col("off") + F.sum("n").over(w) - F.col("n")).filter(F.col("prior") < max_len)
    j = j.withColumn("piece", F.slice("toks", 1, F.greatest(F.least(F.col("n"), F.lit(max_len) - F.col("prior")),
                                                            F.lit(0)).cast("int")))
    h = j.groupBy("g").agg(F.array_sort(F.collect_list(F.struct("prior", "piece"))).alias("parts"),
                           F.first("passes").alias("passes"))
    h = h.select(F.col("g").alias(group), "passes", F.flatten(F.transform("parts", lambda z: z["piece"])).alias("tokens"))
    return cut_lineage(h, "haystacks") if materialize else h


def _sized(hay: DataFrame) -> bool:
    """Whether the tokens are ids with byte lengths (see ``ModelTokenizer.sized``)."""
    return isinstance(hay.schema["tokens"].dataType.elementType, T.StructType)


def period_index(hay: DataFrame, group: str = "lang", period_tokens=None) -> DataFrame:
    """Per haystack position: the last position at or before it holding a period token
    (-1 if none) and ``char_end``, the number of characters up to and including it.

    One window per haystack; a haystack holds at most ``max_len`` tokens.  Tokens are strings, or
    ``struct<id, n>`` with ``period_tokens`` as ids and ``char_end`` in bytes.
    """
    pt = period_tokens or PERIOD_TOKENS
    p = hay.select(group, F.posexplode("tokens").alias("pos", "tok"))
    if _sized(hay):
        w = Window.partitionBy(group).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
        return p.select(group, "pos", F.coalesce(F.max(F.when(F.col("tok.id").isin(*pt), F.col("pos"))).over(w), F.lit(-1)).alias("last_period"),
                        F.sum("tok.n").over(w).alias("char_end"))
    w = Window.partitionBy(group).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return p.select(group, "pos",
                    F.coalesce(F.max(F.when(F.col("tok").isin(*pt), F.col("pos"))).over(w), F.lit(-1)).alias("last_period"),
                    F.sum(F.length("tok")).over(w).alias("char_end"))


def position_arrays(hay: DataFrame, group: str = "lang", period_tokens=None) -> DataFrame:
    """Per haystack: ``lp`` (last period position at or before each position) and ``ce``
    (characters up to and including each position) as arrays (at most ``max_len`` long)."""
    idx = period_index(hay, group, period_tokens)
    a = idx.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("pos", "last_period", "char_end"))).alias("a"))
    return a.select(group, F.transform("a", lambda z: z["last_period"]).alias("lp"),
                    F.transform("a", lambda z: z["char_end"]).alias("ce"))


def _let(value: Column, body) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def needle_cells(hay: DataFrame, lengths: Column, depths: Column, needle_tokens: int, group: str = "lang",
                 buffer: int = K.FINAL_CONTEXT_LENGTH_BUFFER, period_tokens=None) -> DataFrame:
    """Insertion point of the needle for every (haystack, length, depth).

    The context is the first ``L`` haystack tokens, cut further to
    ``L - buffer - needle`` when context plus needle would not fit in
    ``L - buffer``; depth 100 appends, any other depth starts at
    ``int(len * depth / 100)`` and moves left to just after a period.
    Each haystack row carries its position arrays once; every cell is computed
    by array lookups inside ``transform`` over the grid axes and only then
    exploded, so no cell scans its context and cells never join or shuffle.
    ``ins_chars`` / ``ctx_chars`` are the character offsets used to cut the text.
    """
    nt = F.lit(needle_tokens)
    at = position_arrays(hay, group, period_tokens).withColumnRenamed(group, "_g")
    h = hay.select(group, F.size("tokens").alias("h_len"))
    h = h.join(at, h[group].eqNullSafe(at["_g"])).drop("_g")
    h_len, lp, ce = F.col("h_len"), F.col("lp"), F.col("ce")

    def cell(L, d):
        ctx0 = F.least(L, h_len)
        budget = L - F.lit(buffer)
        ctx_e = F.when(ctx0 + nt > budget, F.greatest(budget - nt, F.lit(0))).otherwise(ctx0).cast("int")
        return _let(ctx_e, lambda ctx: _let((ctx * (d / 100.0)).cast("int"), lambda ip: _let(
            F.when(d == 100, ctx).when(ip <= 0, F.lit(0)).otherwise(F.element_at(lp, ip) + 1).cast("int"),
            lambda ins: F.struct(
                L.cast("int").alias("context_length"), d.cast("double").alias("depth_percent"),
                ctx.alias("ctx_tokens"), ins.alias("insert_at"),
                F.when(ins > 0, F.element_at(ce, ins)).otherwise(F.lit(0)).cast("int").alias("ins_chars"),
                F.when(ctx > 0, F.element_at(ce, ctx)).otherwise(F.lit(0)).cast("int").alias("ctx_chars")))))

    cells = F.flatten(F.transform(lengths, lambda L: F.transform(depths, lambda d: cell(L, d))))
    c = h.select(group, "h_len", F.explode(cells).alias("c")).select(group, "h_len", "c.*")
    return c.select(group, "context_length", "depth_percent", "h_len", "ctx_tokens", "insert_at",
                    (F.col("ctx_tokens") + nt).alias("total_tokens"), "ins_chars", "ctx_chars")


def materialize(cells: DataFrame, hay: DataFrame, needle: str, group: str = "lang", decode=None) -> DataFrame:
    """Add ``context`` (text with the needle inserted) to needle cells.  ``decode`` maps an array of ids
    to bytes, for haystacks of model tokens.

    Cells are spread over all cores by (haystack, length, depth) and meet the haystack texts (groups x
    ``max_len`` tokens; Spark broadcasts them where they are few); each context is two substrings around the needle (the
    tokenizer is lossless, so character offsets of token boundaries cut the text exactly).
    """
    text = decode(F.col("tokens.id")) if _sized(hay) else F.array_join("tokens", "")
    text = hay.select(F.col(group).alias("_g"), text.alias("_text"))
    tasks = hay.sparkSession.sparkContext.defaultParallelism
    spread = cells.repartition(tasks, group, "context_length", "depth_percent")
    j = spread.join(text, spread[group].eqNullSafe(F.col("_g")))
    left = F.substring(F.col("_text"), F.lit(1), F.col("ins_chars"))
    right = F.substring(F.col("_text"), F.col("ins_chars") + 1, F.col("ctx_chars") - F.col("ins_chars"))
    context = (valid_text(F.concat(left, F.lit(needle).cast("binary"), right)) if _sized(hay)
               else F.concat(left, F.lit(needle), right))
    return j.withColumn("context", context).drop("_text", "_g")


def insert_needle_sentence(text: Column, needle: Column, depth: Column) -> Column:
    """Split on periods, insert at ``int(depth * parts)``: left + '.' + needle + right."""
    parts = F.split(text, "[.]", -1)
    n = F.size(parts)
    place = (depth * n).cast("int")
    left = F.array_join(F.slice(parts, 1, place), ".")
    right = F.array_join(F.slice(parts, place + 1, F.greatest(n - place, F.lit(0))), ".")
    return F.concat(left, F.lit("."), needle, right)


def cell_name(model: Column, length: Column, depth: Column, suffix: str | None = None) -> Column:
    """File-safe cell name: ``<model version>_len_<L>_depth_<int(depth*100)>`` (dots to underscores)."""
    version = F.element_at(F.split(model, "/"), -1)
    if suffix:
        version = F.concat(version, F.lit("_" + suffix))
    return F.format_string("%s_len_%d_depth_%d", F.regexp_replace(version, "[.]", "_"), length.cast("int"),
                           (depth * 100).cast("long"))
