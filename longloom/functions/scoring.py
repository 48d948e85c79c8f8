"""Answer normalisation and scoring as column functions (``Column x Column -> Column``).

All of these stay inside Catalyst (higher-order array functions), except the
longest-common-subsequence used by ROUGE-L, which runs as an Arrow batched
``arrow_udf`` over token arrays that were split on the JVM side.
"""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import constants as K


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


ARTICLE_RE = r"(?U)\b(" + "|".join(K.ARTICLES) + r")\b"


def normalize_answer(s: Column | str) -> Column:
    """lower -> drop ASCII punctuation -> articles to spaces -> collapse whitespace."""
    x = F.lower(_c(s))
    x = F.translate(x, K.ASCII_PUNCTUATION, "")
    x = F.regexp_replace(x, ARTICLE_RE, " ")
    return F.trim(F.regexp_replace(x, r"(?U)\s+", " "))


def normalize_zh_answer(s: Column | str) -> Column:
    """lower -> drop ASCII and CJK punctuation -> drop all whitespace."""
    x = F.lower(_c(s))
    x = F.translate(x, K.ASCII_PUNCTUATION + K.CJK_PUNCTUATION, "")
    return F.regexp_replace(x, r"(?U)\s+", "")


def words(s: Column | str) -> Column:
    """Whitespace split without empty strings (Python's ``str.split()``)."""
    return F.filter(F.split(_c(s), r"(?U)\s+"), lambda w: w != "")


def chars(s: Column | str) -> Column:
    """One token per character (default segmenter for Chinese text)."""
    return F.filter(F.split(_c(s), ""), lambda w: w != "")


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once per row and pass it to ``body`` (Catalyst does not
    share sub-expressions inside lambda functions, so expensive inputs of
    higher-order functions are bound this way)."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _overlap(p: Column, g: Column) -> Column:
    """Merge of the sorted tokens of both sides: ``open`` counts the unmatched tokens of the left side
    with the current word, every token of the right side takes one."""
    both = F.sort_array(F.concat(F.transform(p, lambda w: F.struct(w.alias("w"), F.lit(0).alias("side"))),
                                 F.transform(g, lambda w: F.struct(w.alias("w"), F.lit(1).alias("side")))))
    start = F.struct(F.lit("").alias("w"), F.lit(0).alias("open"), F.lit(0).alias("n"))

    def step(acc, t):
        left = F.when(acc["w"] == t["w"], acc["open"]).otherwise(0)
        hit = (t["side"] == 1) & (left > 0)
        return F.struct(t["w"].alias("w"),
                        F.when(t["side"] == 0, left + 1).when(hit, left - 1).otherwise(left).alias("open"),
                        (acc["n"] + hit.cast("int")).alias("n"))
    return F.aggregate(both, start, step, lambda acc: acc["n"])


def multiset_overlap(p: Column, g: Column) -> Column:
    """Size of the multiset intersection of two token arrays (``Counter & Counter``)."""
    return let(p, lambda pp: let(g, lambda gg: _overlap(pp, gg)))


def _f1(pp: Column, gg: Column) -> Column:
    return let(_overlap(pp, gg), lambda c: F.when(c == 0, F.lit(0.0)).otherwise(
        2 * (c / F.size(pp)) * (c / F.size(gg)) / ((c / F.size(pp)) + (c / F.size(gg)))))


def f1_tokens(p: Column, g: Column) -> Column:
    """Token F1 of two arrays; 0 when nothing is shared."""
    return let(p, lambda pp: let(g, lambda gg: _f1(pp, gg)))


def qa_f1(pred: Column | str, answers: Column | str) -> Column:
    """Max over reference answers of the token F1 of normalised texts (0 for no answers)."""
    best = let(words(normalize_answer(pred)), lambda pt: F.array_max(
        F.transform(_c(answers), lambda a: let(words(normalize_answer(a)), lambda gt: _f1(pt, gt)))))
    return F.coalesce(F.greatest(best, F.lit(0.0)), F.lit(0.0))


def qa_f1_zh(pred: Column | str, answer: Column | str, segmenter=None) -> Column:
    """Token F1 of segmented, normalised Chinese text (per-character segmentation by default)."""
    seg = segmenter or (lambda s: chars(normalize_zh_answer(s)))
    return f1_tokens(seg(_c(pred)), seg(_c(answer)))


def first_int_match(pred: Column | str, answer: Column | str) -> Column:
    """1 when the first run of digits of the prediction equals the answer as text."""
    return (F.regexp_extract(_c(pred), "[0-9]+", 0) == _c(answer)).cast("int")


def in_match(pred: Column | str, answer: Column | str) -> Column:
    """1 when the answer occurs in the prediction (an empty answer always does)."""
    return F.contains(_c(pred), _c(answer)).cast("int")


def rouge_tokens(s: Column | str, stemmer=None) -> Column:
    """ROUGE tokens: lower case, runs of ASCII letters and digits; ``stemmer`` maps the array of tokens."""
    t = F.filter(F.split(F.regexp_replace(F.lower(_c(s)), "[^a-z0-9]+", " "), " "), lambda w: w != "")
    return stemmer(t) if stemmer else t


def rouge1_f(pred: Column | str, target: Column | str, stemmer=None) -> Column:
    """ROUGE-1 F-measure of a prediction against a target (no stemming by default)."""
    return f1_tokens(rouge_tokens(pred, stemmer), rouge_tokens(target, stemmer))


def needle_score(response: Column | str, needle: Column | str, stemmer=None) -> Column:
    """Score stored with each needle result: ROUGE-1 F times 10 (``stemmer`` maps the array of tokens)."""
    return rouge1_f(response, needle, stemmer) * 10


def needle_recall(response: Column | str, expected: str = K.EXPECTED_ANSWER, dedup: bool = False) -> Column:
    """Share of expected words present in the response (set overlap).

    The divisor is the expected *list* (repeated words count twice), as in the
    original heatmap, unless ``dedup``.  A null response scores 0.
    """
    exp_words = expected.lower().split()
    exp = F.array(*[F.lit(w) for w in exp_words])
    denom = len(set(exp_words)) if dedup else len(exp_words)
    hit = F.size(F.array_intersect(words(F.lower(_c(response))), exp))
    return F.when(_c(response).isNull(), F.lit(0.0)).otherwise(hit / F.lit(float(denom)))


def word_recall(pred: Column | str, answer: Column | str) -> Column:
    """|set(answer words) & set(pred words)| / |set(answer words)| on lower-cased text."""
    g = F.array_distinct(words(F.lower(_c(answer))))
    p = words(F.lower(_c(pred)))
    return F.when(F.size(g) == 0, F.lit(None).cast("double")).otherwise(
        F.size(F.array_intersect(g, p)) / F.size(g))


def expand_choice(pred: Column | str, options: Column | str) -> Column:
    """If the prediction starts with a/b/c/d and lacks that option's text, append the option lower-cased."""
    p, o = _c(pred), _c(options)
    first = F.trim(F.lower(F.substring(p, 1, 1)))
    out = p
    for i, letter in reversed(list(enumerate("abcd"))):
        opt = F.try_element_at(o, F.lit(i + 1))
        out = F.when((first == letter) & ~F.contains(p, opt), F.concat(p, F.lit(" "), F.lower(opt))).otherwise(out)
    return F.when(p.isNull() | (F.length(p) == 0), p).otherwise(out)


def answer_letters(answer: Column | str, options: Column | str) -> Column:
    """Choice answers as ``[text, letter]``; an answer missing from the options raises."""
    a, o = _c(answer), _c(options)
    first = F.try_element_at(a, F.lit(1))
    pos = F.array_position(o, first)
    letter = F.substring(F.lit(K.OPTION_LETTERS), pos.cast("int"), 1)
    bad = F.raise_error(F.lit("answer is not one of the options")).cast("array<string>")
    second = F.try_element_at(a, F.lit(2))
    return (F.when((F.size(a) == 1) & (pos > 0), F.array(first, letter))
             .when((F.size(a) == 2) & second.isin(*list(K.OPTION_LETTERS)), a)
             .otherwise(bad))


# ------------------------------------------------------------------ ROUGE-L

def lcs_length(a: list, b: list) -> int:
    """Longest common subsequence length, bit-parallel over ``b`` (Python big ints)."""
    if not a or not b:
        return 0
    masks: dict = {}
    for i, y in enumerate(b):
        masks[y] = masks.get(y, 0) | (1 << i)
    full = (1 << len(b)) - 1
    v = full
    for x in a:
        m = masks.get(x, 0)
        u = v & m
        v = ((v + u) | (v - u)) & full
    return len(b) - bin(v).count("1")


ROUGE_ROWS = 64


@F.arrow_udf(T.DoubleType())
def _rouge_l_udf(p: pa.Array, g: pa.Array) -> pa.Array:
    """F of every pair; few rows at a time leave Arrow, their tokens as numbers."""
    out = []
    for lo in range(0, len(p), ROUGE_ROWS):
        pair = [x.slice(lo, ROUGE_ROWS) for x in (p, g)]
        codes = pc.dictionary_encode(pa.concat_arrays([x.flatten() for x in pair]), null_encoding="encode").indices.to_pylist()
        sizes = [pc.fill_null(pc.list_value_length(x), 0).to_pylist() for x in pair]
        valid = pc.and_(*[x.is_valid() for x in pair]).to_pylist()
        i, j = 0, sum(sizes[0])
        for m, n, ok in zip(*sizes, valid):
            lcs = lcs_length(codes[i: i + m], codes[j: j + n]) if ok else 0
            out.append(2 * (lcs / m) * (lcs / n) / (lcs / m + lcs / n) if lcs else 0.0 if ok else None)
            i, j = i + m, j + n
    return pa.array(out, pa.float64())


def rouge_l(pred: Column | str, target: Column | str, tokenizer=None) -> Column:
    """ROUGE-L F (LCS based, F = 2PR/(P+R)) of two texts."""
    tok = tokenizer or (lambda s: words(F.lower(s)))
    return _rouge_l_udf(tok(_c(pred)), tok(_c(target)))


def rouge_l_zh(pred: Column | str, target: Column | str, segmenter=None) -> Column:
    """ROUGE-L over segments (single characters by default; ``segmenter`` maps a text to an array)."""
    return rouge_l(pred, target, tokenizer=segmenter or chars)


def lcs_native(a: Column, b: Column) -> Column:
    """Longest common subsequence length of two token arrays, in built-in functions.

    The matches of the first array's tokens, each token's places in the second one from last to first,
    are a sequence whose longest strictly increasing part is the subsequence (Hunt and Szymanski).  The
    fold keeps, for every length, the smallest place such a part can end at.  Work and memory follow the
    number of matches (at most the product of both lengths, few for prose); :func:`rouge_l` is the form
    for long texts of few distinct tokens.
    """
    def matches(aa, bb):
        place = F.sequence(F.lit(0), F.size(bb) - 1)
        # places of every distinct token of the second array, found once
        table = F.map_from_entries(F.transform(F.array_distinct(bb), lambda w: F.struct(
            w.alias("w"), F.reverse(F.filter(place, lambda i: F.get(bb, i) == w)).alias("at"))))
        return let(table, lambda t: F.flatten(F.transform(F.filter(aa, lambda w: F.map_contains_key(t, w)), lambda w: F.element_at(t, w))))

    def longest(found):
        def step(ends, j):
            return let(F.size(F.filter(ends, lambda x: x < j)), lambda k: F.concat(
                F.slice(ends, F.lit(1), k), F.array(j), F.slice(ends, k + 2, F.greatest(F.size(ends) - k - 1, F.lit(0)))))
        return F.size(F.aggregate(found, F.array().cast("array<int>"), step))
    both = let(a, lambda aa: let(b, lambda bb: longest(matches(aa, bb))))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), both).otherwise(F.lit(0))


def rouge_l_native(pred: Column | str, target: Column | str, tokenizer=None) -> Column:
    """:func:`rouge_l` without a Python worker (see :func:`lcs_native`)."""
    tok = tokenizer or (lambda s: words(F.lower(s)))

    def f(p, g):
        return let(lcs_native(p, g), lambda c: F.when(c == 0, F.lit(0.0)).otherwise(
            2 * (c / F.size(p)) * (c / F.size(g)) / ((c / F.size(p)) + (c / F.size(g)))))
    p, g = tok(_c(pred)), tok(_c(target))
    score = let(p, lambda pp: let(g, lambda gg: f(pp, gg)))
    return F.when(_c(pred).isNotNull() & _c(target).isNotNull(), score)
