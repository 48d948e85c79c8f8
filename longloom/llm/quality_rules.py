"""Document quality by weak supervision (DataFrame functions only).

**Rules** look at counts of a text and vote good (+1), bad (-1) or abstain (0).  Rules for a defect
abstain when they see none: its absence says little about the rest of the text.

**Label model.**  No labels are used.  How often each rule votes bad, abstains or votes good on good and
on bad documents is unknown; expectation-maximisation over the vote patterns estimates these
accuracies and the class prior, starting from rules that are mostly right and from mostly good
documents, and holding each rule to the right side: a bad vote stays rarer than ``TURN`` on good
documents and commoner on bad ones, and every estimate is the mean of the observed share and the starting belief,
so that one frequent kind of bad documents does not turn the rules for the others.  The patterns of J three-valued rules are at most 3**J, whatever
the corpus: documents are counted per pattern (map-side combined), the estimation runs inside one
row of that bounded table, and a document takes the posterior of its pattern by a join.

**Base.**  Texts with fewer than ``MIN_WORDS`` words, or more than half of whose words lie in repeated
3-word windows, fail in any case.  Other documents are kept when their posterior quality is at least
``keep_at``.

All counts come from one pass over the texts; they are written once, so texts are read once.

Edge cases.  A null or blank text has no words and fails the base.  Rows are judged one by one, so
repeated rows, null doc_ids and ties are ordinary.  Extra columns are ignored; an empty table gives
an empty result.  Long texts cost n log n in their words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, doc_texts, free_name, let, row_key, ws_words

MIN_WORDS = 50
KEEP_AT = 0.5
ROUNDS = 40

# rule: (name, good when, bad when) as integer comparisons of the counts below; otherwise it abstains
RULES = [
    ("symbols", "FALSE", "10 * n_symbols > n_words"),
    ("tables", "FALSE", "10 * n_bars > n_words"),
    ("capitals", "FALSE", "10 * n_upper > 3 * word_chars"),
    ("endings", "50 * n_odd_ends <= n_words", "10 * n_odd_ends > n_words"),
    ("shouting", "FALSE", "10 * n_exclaim > n_words"),
    ("dup_lines", "FALSE", "3 * n_dup_lines > n_lines"),
    ("repeats", "FALSE", "100 * n_repeat_words > 30 * n_words"),
    ("vocabulary", "10 * n_distinct >= 3 * n_words", "10 * n_distinct < n_words"),
    ("word_length", "word_chars >= 3 * n_words AND word_chars <= 10 * n_words",
     "word_chars < 2 * n_words OR word_chars > 14 * n_words"),
    ("sentences", "100 * n_stops >= 2 * n_words AND 100 * n_stops <= 40 * n_words", "200 * n_stops < n_words"),
]
# starting point (share of bad votes, abstentions, good votes) and limits (fixed values)
PRIOR, GOOD_START, BAD_START = 0.8, (0.002, 0.5, 0.498), (0.3, 0.4, 0.3)
LOW, HIGH, TURN, DIGITS = 0.0005, 0.9995, 0.02, 9


# a word that ends in two or more characters that are no letters or digits
ODD_END = r"[^ \t\n\x0B\f\r\p{L}\p{N}]{2,}([ \t\n\x0B\f\r]|$)"


def _count_chars(text: Column, pattern: str) -> Column:
    return (F.length(text) - F.length(F.regexp_replace(text, pattern, ""))).cast("long")


def repeat_words(words: Column) -> Column:
    """Words in 3-word windows found twice or more in the array, each word counted once."""
    def covered(h):
        # windows with an equal one: sort (hash, position), look at the neighbours
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def spots(s):
            k = F.sequence(F.lit(0), F.size(s) - 1)
            twice = F.filter(k, lambda j: F.coalesce(F.get(s, j)["h"] == F.get(s, j - 1)["h"], F.lit(False))
                             | F.coalesce(F.get(s, j)["h"] == F.get(s, j + 1)["h"], F.lit(False)))
            return F.sort_array(F.transform(twice, lambda j: F.get(s, j)["i"]))
        start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))
        return F.aggregate(
            let(pairs, spots), start,
            lambda acc, p: F.struct((acc["n"] + 3 - F.greatest(acc["end"] - p, F.lit(0))).alias("n"), (p + 3).alias("end")),
            lambda acc: acc["n"])

    def windows(w):
        h = F.transform(F.sequence(F.lit(0), F.size(w) - 3),
                        lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
        return let(h, lambda x: F.when(F.size(F.array_distinct(x)) < F.size(x), covered(x)).otherwise(F.lit(0).cast("long")))
    return F.when(F.size(words) >= 4, let(words, windows)).otherwise(F.lit(0).cast("long"))


def counts(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``row`` (its key) and the counts the rules look at."""
    t = doc_texts(docs).withColumn("row", row_key()).withColumn("text", F.coalesce("text", F.lit("")))
    w = t.withColumn("w", ws_words(F.col("text")))
    line = let(F.filter(F.split("text", "\n", -1), lambda x: x.rlike(r"[^ \t\n\x0B\f\r]")),
               lambda x: F.struct(F.size(x).alias("n"), F.size(F.array_distinct(x)).alias("d")))
    w = w.withColumn("lines", line)
    return w.select(
        "doc_id", "row", F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        _count_chars(F.col("text"), r"[#*$%&|<>]+").alias("n_symbols"),
        (F.col("lines.n") - F.col("lines.d")).cast("long").alias("n_dup_lines"),
        repeat_words(F.col("w")).alias("n_repeat_words"),
        F.col("lines.n").cast("long").alias("n_lines"),
        F.size(F.array_distinct("w")).cast("long").alias("n_distinct"),
        _count_chars(F.col("text"), r"\p{Lu}+").alias("n_upper"),
        _count_chars(F.col("text"), r"!+").alias("n_exclaim"),
        (F.length("text") - F.length(F.replace(F.col("text"), F.lit("|")))).cast("long").alias("n_bars"),
        F.regexp_count("text", F.lit(ODD_END)).cast("long").alias("n_odd_ends"),
        _count_chars(F.col("text"), r"[.!?]+").alias("n_stops"))


def with_votes(stats: DataFrame, rules=RULES) -> DataFrame:
    votes = [F.when(F.expr(bad), -1).when(F.expr(good), 1).otherwise(0) for _, good, bad in rules]
    return stats.withColumn("votes", F.array(*votes))


def _log_odds(votes: Column, state: Column) -> Column:
    """Log odds of good against bad for a vote pattern under ``state``."""
    def term(v, i):
        return F.log(F.get(F.get(state["good"], i), v + 1)) - F.log(F.get(F.get(state["bad"], i), v + 1))
    return F.aggregate(F.transform(votes, term), F.log(state["prior"]) - F.log(1 - state["prior"]), lambda a, x: a + x)


def _posterior(votes: Column, state: Column) -> Column:
    return 1 / (1 + F.exp(-_log_odds(votes, state)))


def fit(patterns: DataFrame, n_rules: int, rounds: int = ROUNDS) -> DataFrame:
    """One row ``ps, state(prior, good, bad)`` from ``votes, c`` (at most 3**rules rows); ``good`` and
    ``bad`` hold the shares of bad votes, abstentions and good votes of every rule."""
    def total(ps, value):
        return F.aggregate(ps, F.lit(0.0), lambda a, p: a + value(p))

    def clamp(x, low=LOW, high=HIGH):
        return F.round(F.least(F.greatest(x, F.lit(low)), F.lit(high)), DIGITS)

    def step(ps, state):
        def update(q):
            all_good = total(q, lambda p: p["c"] * p["q"])
            all_ = total(q, lambda p: p["c"])

            def share(j, v, good):
                n = total(q, lambda p: F.when(F.get(p["votes"], j) == v,
                                              p["c"] * (p["q"] if good else 1 - p["q"])).otherwise(0.0))
                size = all_good if good else all_ - all_good
                return (n / (size + 0.001) + (GOOD_START if good else BAD_START)[v + 1]) / 2

            def rule(j, good):
                bad_vote = clamp(share(j, -1, good), *((LOW, TURN) if good else (TURN, HIGH)))
                return F.array(bad_vote, clamp(share(j, 0, good)), clamp(share(j, 1, good)))
            js = F.sequence(F.lit(0), F.lit(n_rules - 1))
            return F.struct(clamp(all_good / all_).alias("prior"),
                            F.transform(js, lambda j: rule(j, True)).alias("good"),
                            F.transform(js, lambda j: rule(j, False)).alias("bad"))
        q = F.transform(ps, lambda p: F.struct(p["votes"].alias("votes"), p["c"].alias("c"),
                                               _posterior(p["votes"], state).alias("q")))
        return let(q, update)

    def shares(start):
        return F.array(*[F.array(*map(F.lit, start))] * n_rules)
    start = F.struct(F.lit(PRIOR).alias("prior"), shares(GOOD_START).alias("good"), shares(BAD_START).alias("bad"))
    one = patterns.agg(F.sort_array(F.collect_list(F.struct("votes", F.col("c").cast("double").alias("c")))).alias("ps"))
    return one.select("ps", F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start,
                                        lambda s, _: step(F.col("ps"), s)).alias("state"))


def judge(docs: DataFrame, rules=RULES, keep_at: float = KEEP_AT, min_words: int = MIN_WORDS) -> DataFrame:
    """``doc_id``, ``row``, the counts, ``base_failed``, ``votes``, ``p_quality`` and ``kept`` of every row."""
    failed = (F.col("n_words") < min_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    stats = cut_lineage(with_votes(counts(docs), rules).withColumn("base_failed", failed), "qr-counts")
    # the label model is fitted on all documents, whether they pass the base or not
    patterns = stats.groupBy("votes").agg(F.count("*").alias("c"))
    model = fit(patterns, len(rules))
    table = model.select(F.explode("ps").alias("p"), "state").select(
        F.col("p.votes").alias("votes"), _posterior(F.col("p.votes"), F.col("state")).alias("p_quality"))
    table = cut_lineage(table, "qr-posteriors")                # at most 3**rules rows
    out = stats.join(F.broadcast(table), "votes", "left")
    return out.withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("p_quality") >= keep_at, F.lit(False)))


def keep_good(docs: DataFrame, **params) -> DataFrame:
    """Rows of ``docs`` (all columns) that the rules keep.  Every row is judged by its own text, also
    rows of one doc_id and rows with a null doc_id."""
    key = free_name(docs, "_bad")
    bad = cut_lineage(judge(docs, **params).filter("not kept").select(F.col("row").alias(key)).distinct(), "qr-bad")
    return docs.join(bad, row_key() == F.col(key), "left_anti")
