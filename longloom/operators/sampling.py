"""Length sampling of a document stream under token budgets.

The original job walks a shuffled stream once, dropping short documents by a
coin flip and charging admitted documents against per-source budgets until
every source is full.  The coin does not depend on the budget state, so the
loop equals a relational plan:

    coin filter  ->  running sum of admitted lengths per source (in stream order)
                 ->  admit while the running sum *before* the row is within budget
                 ->  stop key = the point where the last source became full

Stream order is a total order on ``md5('<seed>:<doc_id>')``.  Only lengths
(``doc_id, source, n_chars``) are read here; text is attached later for the
admitted rows only.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..session import cut_lineage
from .prefix import hex_bucket, running_sum

# rows of one doc_id share a stream key; rows that agree in all three are interchangeable
TIES = ["k", "source", "n_chars"]
MODES = ("none", "global", "per_source", "upsample_code_arxiv_book")


@dataclass(frozen=True)
class SampleSpec:
    total_tokens: int
    mode: str = "per_source"
    ratio: float = K.DEFAULT_RATIO
    threshold_tokens: float = K.DEFAULT_THRESHOLD_TOKENS
    order_seed: int = K.ORDER_SEED
    coin_seed: int = K.COIN_SEED
    bucket_digits: int = 3
    strict_sources: bool = True

    def __post_init__(self):
        if self.mode not in MODES:
            raise ValueError(f"unknown mode {self.mode!r}")

    @property
    def threshold_chars(self) -> int:
        """Smallest integer length whose estimated tokens reach the threshold."""
        n = math.ceil(self.threshold_tokens * K.CHARS_PER_TOKEN)
        while n > 0 and (n - 1) / K.CHARS_PER_TOKEN >= self.threshold_tokens:
            n -= 1
        while n / K.CHARS_PER_TOKEN < self.threshold_tokens:
            n += 1
        return n

    @property
    def coin_cut(self) -> int:
        """A 32-bit coin ``c`` keeps a short document when ``c <= coin_cut``."""
        return math.floor(self.ratio * 2 ** 32)

    @property
    def per_source(self) -> bool:
        return self.mode in ("per_source", "upsample_code_arxiv_book")


def parse_dataset_size(text: str) -> int:
    """``test`` -> 2,000,000; ``<number>[kmb]`` in any case -> tokens."""
    t = text.strip().lower()
    if t == "test":
        return K.TEST_DATASET_TOKENS
    scale = {"k": 10 ** 3, "m": 10 ** 6, "b": 10 ** 9}
    if t and t[-1] in scale:
        try:
            return int(round(float(t[:-1]) * scale[t[-1]]))
        except ValueError:
            pass
    raise ValueError(f"dataset size {text} not supported")


def planned_chunks(total_tokens: int, chunk_size: int) -> int:
    """Number of chunks a run plans for: whole chunks in the token target."""
    return total_tokens // chunk_size


def normalize_mix(mix: list[tuple[str, float]]) -> list[tuple[str, float]]:
    total = sum(w for _, w in mix)
    return [(s, w / total) for s, w in mix]


def mix_frame(spark, mix: list[tuple[str, float]]) -> DataFrame:
    return spark.createDataFrame(mix, "source string, weight double")


def order_key(doc_id: Column, seed: int = K.ORDER_SEED) -> Column:
    """Stream position: md5 of '<seed>:<doc_id>' (hex, uniform, unique per id; a null id is empty)."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))))


def coin(doc_id: Column, seed: int = K.COIN_SEED) -> Column:
    """Uniform 32-bit integer per document id."""
    return F.conv(F.substring(order_key(doc_id, seed), 1, 8), 16, 10).cast("long")


def with_stream_keys(docs: DataFrame, spec: SampleSpec, keep=()) -> DataFrame:
    """doc_id, source, n_chars (+ ``keep`` columns) + k (order), pass (down-sample coin or long)."""
    d = docs.select("doc_id", "source", F.col("n_chars").cast("long").alias("n_chars"), *keep)
    d = d.withColumn("k", order_key(F.col("doc_id"), spec.order_seed))
    if spec.mode == "none":
        return d.withColumn("pass", F.lit(True))
    keep = (F.coalesce("n_chars", F.lit(0)) >= F.lit(spec.threshold_chars)) | (coin(F.col("doc_id"), spec.coin_seed) <= F.lit(spec.coin_cut))
    return d.withColumn("pass", keep)


def downsample_short(docs: DataFrame, spec: SampleSpec) -> DataFrame:
    """Documents that survive the short-document coin (long ones always do)."""
    return with_stream_keys(docs, spec).filter("pass").drop("pass")


def budgets(mix: DataFrame, spec: SampleSpec) -> DataFrame:
    """Per source: budget in estimated tokens and the two integer char bounds.

    ``bf``: admit while chars already used <= bf  (used/3.68 <= budget)
    ``bc``: a source is full once chars used >= bc (used/3.68 >= budget)
    """
    x = F.lit(float(spec.total_tokens)) * F.col("weight") * F.lit(K.CHARS_PER_TOKEN)
    return mix.select("source", "weight",
                      (F.lit(float(spec.total_tokens)) * F.col("weight")).alias("budget_tokens"),
                      F.floor(x).cast("long").alias("bf"), F.ceil(x).cast("long").alias("bc"))


def attach_budgets(d: DataFrame, mix: DataFrame, spec: SampleSpec) -> DataFrame:
    """Join each document to its source budget (the mix is a literal table: broadcast)."""
    b = F.broadcast(budgets(mix, spec))
    if spec.strict_sources:
        j = d.join(b, "source", "left")
        msg = F.concat(F.lit("source not in mix: "), F.coalesce(F.col("source"), F.lit("null")))
        return j.filter(F.when(F.col("bf").isNull(), F.raise_error(msg).cast("boolean")).otherwise(F.lit(True)))
    return d.join(b, "source", "inner")


@dataclass
class SampleResult:
    windowed: DataFrame      # rows that could be charged: prior <= bf
    stop_key: str | None     # last stream key the scan looked at (None: scanned to the end)
    spec: SampleSpec
    keyed: DataFrame         # all documents with k / pass (for scan statistics)
    budget_table: DataFrame | None = None   # per-source budgets (per-source modes)

    @property
    def admitted(self) -> DataFrame:
        w = self.windowed.filter("admit")
        if self.stop_key is not None:
            w = w.filter(F.col("k") <= F.lit(self.stop_key))
        return w.select("doc_id", "source", "n_chars", "k", F.col("prior").alias("offset"))

    def candidates(self, documents: DataFrame) -> DataFrame:
        """Corpus rows that can be admitted, found without a shuffle: coin passed, before the
        stop key, and in a (source, stream-key bucket) that holds admitted rows.  The bucket
        table has at most sources x 16^digits rows.  Returns ``doc_id, source, n_chars, text``."""
        digits = self.spec.bucket_digits
        buckets = self.admitted.select(F.col("source").alias("_src"), hex_bucket("k", digits).alias("_bkey")).distinct()
        d = with_stream_keys(documents, self.spec, keep=["text"]).filter("pass")
        if self.stop_key is not None:
            d = d.filter(F.col("k") <= F.lit(self.stop_key))
        near = F.col("source").eqNullSafe(F.col("_src")) & (hex_bucket("k", digits) == F.col("_bkey"))
        return d.join(buckets, near, "left_semi").select("doc_id", "source", "n_chars", "text")

    def scanned(self) -> DataFrame:
        k = self.keyed
        if self.stop_key is not None:
            k = k.filter(F.col("k") <= F.lit(self.stop_key))
        return k

    def report(self, chunk_size: int | None = None) -> DataFrame:
        """Per source: budget, used, passed, filtered, scanned rows, fill ratio; with ``chunk_size`` also
        the number of chunks that the run plans for."""
        w = self.windowed
        if self.stop_key is not None:
            w = w.filter(F.col("k") <= F.lit(self.stop_key))
        charged = w.groupBy("source").agg(
            F.sum(F.when(F.col("admit"), F.col("n_chars")).otherwise(F.lit(0))).cast("long").alias("used_chars"),
            F.count_if(F.col("admit")).alias("passed"),
            F.count_if(F.col("filtered")).alias("filtered"))
        scanned = self.scanned().groupBy("source").agg(F.count(F.lit(1)).alias("scanned"))
        charged = charged.withColumnRenamed("source", "_src")
        r = scanned.join(charged, F.col("source").eqNullSafe(F.col("_src")), "left").drop("_src").fillna(
            0, ["used_chars", "passed", "filtered"])
        if self.budget_table is not None:
            # one row per source of the mix: broadcast
            b = F.broadcast(self.budget_table.select("source", "budget_tokens"))
            r = r.join(b, "source", "left").withColumn(
                "fill", F.try_divide(F.col("used_chars") / F.lit(K.CHARS_PER_TOKEN), F.col("budget_tokens")))
        if chunk_size is not None:
            r = r.withColumn("planned_chunks", F.lit(planned_chunks(self.spec.total_tokens, chunk_size)).cast("long"))
        return r


def sample(docs: DataFrame, spec: SampleSpec, mix: DataFrame | None = None, checkpoint: bool = True) -> SampleResult:
    """Run the sampling plan.  ``mix`` (source, weight) is required for per-source modes."""
    keyed = with_stream_keys(docs, spec)
    if spec.per_source:
        if mix is None:
            raise ValueError("per-source sampling needs a mix")
        d = attach_budgets(keyed, mix, spec)
        by = ["source"]
    else:
        x = float(spec.total_tokens) * K.CHARS_PER_TOKEN
        d = keyed.withColumn("bf", F.lit(math.floor(x))).withColumn("bc", F.lit(math.ceil(x)))
        by = []
    d = d.withColumn("v", F.when(F.col("pass"), F.coalesce("n_chars", F.lit(0))).otherwise(F.lit(0)).cast("long"))
    w = running_sum(d, "v", TIES, hex_bucket("k", spec.bucket_digits), by=by, out="incl",
                    bucket_offset_max=F.col("bf"))
    w = (w.withColumn("prior", F.col("incl") - F.col("v"))
          .withColumn("admit", F.col("pass") & (F.col("prior") <= F.col("bf")))
          .withColumn("filtered", ~F.col("pass") & (F.col("prior") <= F.col("bf")))
          .filter(F.col("prior") <= F.col("bf"))
          .select("doc_id", "source", "n_chars", "k", "pass", "v",
                  "incl", "prior", "bf", "bc", "admit", "filtered"))
    if checkpoint:
        w = cut_lineage(w, "sample")
    stop = _stop_key(w, spec, mix)
    return SampleResult(windowed=w, stop_key=stop, spec=spec, keyed=keyed,
                        budget_table=budgets(mix, spec) if spec.per_source else None)


def _stop_key(w: DataFrame, spec: SampleSpec, mix: DataFrame | None) -> str | None:
    """One scalar: the stream key after which the original loop breaks."""
    if spec.per_source:
        n_sources = mix.select("source").distinct().count()
        fin = (w.filter(F.col("admit") & (F.col("incl") >= F.col("bc")))
                .groupBy("source").agg(F.min("k").alias("k_full")))
        row = fin.agg(F.count(F.lit(1)).alias("n"), F.max("k_full").alias("stop")).first()
        return row["stop"] if row["n"] == n_sources else None
    row = w.filter(F.col("admit") & (F.col("incl") > F.col("bf"))).agg(F.min("k").alias("stop")).first()
    return row["stop"]


def unknown_sources(docs: DataFrame, mix: DataFrame) -> DataFrame:
    """Sources present in the corpus but absent from the mix, with document counts."""
    return (docs.select("source").join(F.broadcast(mix.select("source")), "source", "left_anti")
                .groupBy("source").agg(F.count(F.lit(1)).alias("n_docs")))


def budget_prefix(docs: DataFrame, spec: SampleSpec, mix: DataFrame) -> DataFrame:
    """Running admitted length per source for every coin-passing document (no cut)."""
    d = attach_budgets(with_stream_keys(docs, spec), mix, spec).filter("pass")
    w = running_sum(d, "n_chars", TIES, hex_bucket("k", spec.bucket_digits), by=["source"], out="incl")
    return w.select("doc_id", "source", "n_chars", "k", "incl", (F.col("incl") - F.col("n_chars")).alias("prior"))


def stream_position(docs: DataFrame, spec: SampleSpec) -> DataFrame:
    """0-based position of every document in the shuffled stream (two-level count)."""
    d = docs.select("doc_id").withColumn("k", order_key(F.col("doc_id"), spec.order_seed)).withColumn("one", F.lit(1))
    w = running_sum(d, "one", ["k"], hex_bucket("k", spec.bucket_digits), out="pos1")
    return w.select("doc_id", "k", (F.col("pos1") - 1).alias("pos"))
