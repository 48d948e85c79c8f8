"""Secret scanning with a random forest that removes false positives (DataFrame and ML functions).

**Candidates**, each with its neighbouring words, are

* in any word: runs of at least ``MIN_LENGTH`` characters of ``[A-Za-z0-9_+/=-]``;
* of any length and alphabet: what follows ``=`` or ``:`` inside a word (after a name of three letters
  or more), the word after one that ends so, and a word after a naming word such as ``token`` (also
  with ``is`` or an assignment sign between), without the quotes and marks around it.

**Features** (all from built-in functions): length; transitions between character classes and between
vowels and other letters, share of the letter pairs that the corpus' frequent words know, digit,
upper-case and hex shares, share of distinct characters; dictionary coverage (share of the characters
that frequent words of the corpus explain, counted over all documents); path signs (slashes, dots, an
address in the word); neighbours (quotes, lengths, whether the words around are frequent ones).

**Training.**  Labelled findings come as a table or from ``label_rules``: an assignment to a naming
word marks a secret; outside both, words of letters only, numbers and dates, addresses and paths, and
what is named an id, a hash or a version are false positives; the rest is unlabelled.  Assignment and
naming are no features, so the forest has to tell by the candidate and its surroundings.  It is fitted
on at most ``TRAIN_ROWS`` labelled findings, chosen by the smallest hash of their text, and then scores
every candidate of every document.

Edge cases.  Null or blank texts have no candidates.  Repeated rows give repeated findings; null
doc_ids pass through.  Without both kinds of labelled findings nothing can be learned: every labelled
secret then scores 1, anything else 0.  Extra columns are ignored; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, doc_texts, let, ws_words

MIN_LENGTH = 16
DICTIONARY = 500              # frequent words used for the coverage
TRAIN_ROWS = 8_000
TREES, DEPTH = 30, 6
CANDIDATE = "[A-Za-z0-9_+/=-]{%d,}"
# words that name a secret (fixed values)
NAMING = "token|secret|passw|passwd|apikey|api_key|auth|credential|private_key|access_key"

# words after which a long string is an identifier (fixed values)
HARMLESS = "id|ids|uuid|commit|revision|version|sha1|sha256|md5|hash|checksum|digest|number|date|page|isbn|issn"

FEATURES = ["f_length", "f_runs", "f_vowel_runs", "f_pairs", "f_digits", "f_upper", "f_hex", "f_distinct", "f_dictionary",
            "f_slashes", "f_dots", "f_address", "f_quoted", "f_prev_length", "f_next_length", "f_prev_known", "f_next_known"]
_NAMED = f"(?i)({NAMING})"
_SET = "[=:]$"                                       # a word that assigns the next one
_INNER = "[A-Za-z_]{3,}[\"'`]?[=:]+[\"'`]?([^=:].*)$"  # name=value inside a word
_AROUND = "^[\"'`(<\\[{]+|[\"'`)>\\]},;.]+$"


def candidates(docs: DataFrame, min_length: int = MIN_LENGTH) -> DataFrame:
    """``doc_id, pos, candidate, word, prev, prev2, next`` for every candidate of every text."""
    rx = CANDIDATE % min_length
    t = doc_texts(docs).filter(F.col("text").rlike(f"{rx}|[=:]|{_NAMED}"))

    def hits(w):
        # only words that can hold a candidate leave the text
        def may(i):
            word, before = F.get(w, i), F.coalesce(F.get(w, i - 1), F.lit(""))
            return ((F.length(word) >= min_length) & word.rlike(rx)) | word.rlike(_INNER) | before.rlike(_SET) | (
                F.concat_ws(" ", F.coalesce(F.get(w, i - 2), F.lit("")), before).rlike(f"{_NAMED}[^ ]*( is| was|)$"))
        at = F.filter(F.sequence(F.lit(0), F.size(w) - 1), may)
        return F.transform(at, lambda i: F.struct(
            i.alias("pos"), F.get(w, i).alias("word"), F.coalesce(F.get(w, i - 1), F.lit("")).alias("prev"),
            F.coalesce(F.get(w, i - 2), F.lit("")).alias("prev2"), F.coalesce(F.get(w, i + 1), F.lit("")).alias("next")))
    t = t.select("doc_id", F.explode(let(ws_words(F.col("text")), hits)).alias("h")).select("doc_id", "h.*")
    value = F.regexp_extract("word", _INNER, 1)
    after = F.col("prev").rlike(_SET) | F.concat_ws(" ", "prev2", "prev").rlike(f"{_NAMED}[^ ]*( is| was|)$")
    whole = F.when(value != "", value).when(after & ~F.col("word").rlike(_SET), F.col("word")).otherwise(F.lit(""))
    whole = F.regexp_replace(whole, _AROUND, "")
    runs = F.regexp_extract_all("word", F.lit(rx), F.lit(0))
    # a run inside an assigned value is that value
    runs = F.filter(runs, lambda r: ~F.contains(whole, r) | (whole == r))
    found = F.filter(F.array_distinct(F.concat(F.array(whole), runs)), lambda c: c != "")
    return t.withColumn("candidate", F.explode(found))


def frequent_words(docs: DataFrame, size: int = DICTIONARY) -> list[str]:
    """The ``size`` most frequent words of 3 to 12 lower-case letters, over all documents."""
    w = doc_texts(docs).select(F.explode(ws_words(F.col("text"))).alias("w")).filter(
        F.col("w").rlike("^[a-z]{3,12}$")).groupBy("w").count()
    return [r.w for r in w.orderBy(F.desc("count"), "w").limit(size).collect()]      # a bounded top-k


def label_rules(found: DataFrame) -> DataFrame:
    """Adds ``label``: 1 secret, 0 false positive, null unknown."""
    c = F.col("candidate")
    plain = c.rlike("^[A-Za-z]+$") | c.rlike("^[0-9.,:/+-]+$") | F.col("word").rlike("(?i)://|^www\\.|^/|\\.(com|net|org|html?)")
    harmless = F.concat_ws(" ", "prev2", "prev", "word").rlike(f"(?i)(^|[^A-Za-z])({HARMLESS})[^A-Za-z]")
    return found.withColumn("label", F.when(_assigned() & _named(), 1.0).when(~_named() & (harmless | (plain & ~_assigned())), 0.0))


def _assigned() -> Column:
    return F.col("prev").rlike(_SET) | F.col("word").rlike(_INNER)


def _named() -> Column:
    return F.concat_ws(" ", "prev2", "prev", "word").rlike(_NAMED)


def _share(c: Column, keep: str) -> Column:
    return F.length(F.regexp_replace(c, f"[^{keep}]", "")) / F.length(c)


def _runs(c: Column, rx: str) -> Column:
    return F.size(F.regexp_extract_all(c, F.lit(rx), F.lit(0))) / F.length(c)


def with_features(found: DataFrame, dictionary: list[str]) -> DataFrame:
    c = F.col("candidate")

    def yes(x: Column) -> Column:
        return F.when(x, 1.0).otherwise(0.0)
    # longest words first, so that a long word is taken whole
    known = "|".join(sorted(dictionary, key=lambda w: (-len(w), w)))
    pairs = sorted({w[i:i + 2] for w in dictionary for i in range(len(w) - 1)})      # at most 26 * 26
    low = F.regexp_replace(F.lower(c), "[^a-z]", "")
    own = F.when(F.length(low) > 1, F.transform(F.sequence(F.lit(1), F.length(low) - 1), lambda i: F.substr(low, i, F.lit(2))))
    usual = F.coalesce(F.size(F.filter(own, lambda p: p.isin(*pairs))) / F.size(own), F.lit(0.0)) if pairs else F.lit(0.0)

    def frequent(w: str) -> Column:
        return yes(F.regexp_replace(F.lower(w), "[^a-z]", "").isin(*dictionary)) if dictionary else F.lit(0.0)
    covered = 1 - F.length(F.regexp_replace(F.lower(c), known, "")) / F.length(c) if dictionary else F.lit(0.0)

    cols = {
        "f_length": F.length(c), "f_runs": _runs(c, "[a-z]+|[A-Z]+|[0-9]+|[^A-Za-z0-9]+"),
        "f_vowel_runs": _runs(c, "[aeiouAEIOU]+|[^aeiouAEIOU]+"), "f_pairs": usual, "f_digits": _share(c, "0-9"),
        "f_upper": _share(c, "A-Z"), "f_hex": _share(c, "0-9a-f"),
        "f_distinct": F.size(F.array_distinct(F.split(c, ""))) / F.length(c), "f_dictionary": covered,
        "f_slashes": F.size(F.split("word", "/")) - 1, "f_dots": F.size(F.split("word", r"\.")) - 1,
        "f_address": yes(F.col("word").rlike(r"(?i)://|^www\.|@|\.(com|net|org|html?)")),
        "f_quoted": yes(F.col("word").rlike("[\"'`]")), "f_prev_length": F.length("prev"), "f_next_length": F.length("next"),
        "f_prev_known": frequent("prev"), "f_next_known": frequent("next")}
    return found.withColumns({k: v.cast("double") for k, v in cols.items()})


def train(labelled: DataFrame, rows: int = TRAIN_ROWS, trees: int = TREES, depth: int = DEPTH, seed: int = 7):
    """A forest on a bounded sample of labelled findings, or None when only one kind of label is there."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    kinds = labelled.filter("label is not null").groupBy("label").count().collect()     # two rows
    if len(kinds) < 2:
        return None
    sample = None
    for k in sorted(kinds):                              # as many of either kind as the bound allows
        part = labelled.filter(F.col("label") == k["label"]).select("label", *FEATURES, F.md5(
            F.concat_ws(" ", "candidate", "prev", "next")).alias("_o")).dropDuplicates(["_o"]).orderBy("_o").limit(rows // 2)
        sample = part if sample is None else sample.unionByName(part)
    # written in one order, so that a repeated fit sees the same rows
    sample = cut_lineage(sample.coalesce(1).sortWithinPartitions("_o"), "secret-sample")
    forest = RandomForestClassifier(featuresCol="features", labelCol="label", numTrees=trees, maxDepth=depth, seed=seed)
    return forest.fit(VectorAssembler(inputCols=FEATURES, outputCol="features").transform(sample))


def score(found: DataFrame, model) -> DataFrame:
    """Adds ``p_secret`` to findings with features."""
    if model is None:
        return found.withColumn("p_secret", F.when(F.col("label") == 1, 1.0).otherwise(0.0))
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array
    v = VectorAssembler(inputCols=FEATURES, outputCol="_features").transform(found)
    model = model.copy().setFeaturesCol("_features").setProbabilityCol("_p").setRawPredictionCol("").setPredictionCol("")
    return model.transform(v).withColumn("p_secret", vector_to_array("_p")[1]).drop("_features", "_p")


def scan(docs: DataFrame, labelled: DataFrame | None = None, min_length: int = MIN_LENGTH, at: float = 0.5) -> DataFrame:
    """``doc_id, pos, candidate, label, p_secret, is_secret`` for every candidate of every document.

    ``labelled`` may hold findings of :func:`candidates` with a ``label``; otherwise the labels come
    from :func:`label_rules`."""
    words = frequent_words(docs)
    found = cut_lineage(with_features(label_rules(candidates(docs, min_length)), words), "secret-findings")
    given = found if labelled is None else with_features(labelled, words)
    out = score(found, train(given))
    return out.select("doc_id", F.col("pos").cast("long").alias("pos"), "candidate", "label", "p_secret",
                      (F.col("p_secret") >= at).alias("is_secret"))
