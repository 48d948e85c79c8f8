"""Query of the quality rules and its oracle."""

from __future__ import annotations

from . import quality_rules as qr
from .common import read
from .registry import register

_W = r"regexp_extract_all(text, '[^\x20\x09-\x0D]+')"
_J = len(qr.RULES)
_VOTES = ", ".join(f"CASE WHEN {bad} THEN -1 WHEN {good} THEN 1 ELSE 0 END AS v{j}"
                   for j, (_, good, bad) in enumerate(qr.RULES))
_V = ", ".join(f"v{j}" for j in range(_J))


def _clamp(x: str, low=qr.LOW, high=qr.HIGH) -> str:
    return f"round(least(greatest({x}, {low}), {high}), {qr.DIGITS})"


def _posterior(t: str) -> str:
    odds = " + ".join(f"CASE v{j} WHEN -1 THEN ln(g{j}_0) - ln(b{j}_0) WHEN 0 THEN ln(g{j}_1) - ln(b{j}_1) "
                      f"ELSE ln(g{j}_2) - ln(b{j}_2) END" for j in range(_J))
    return f"SELECT pat.*, 1 / (1 + exp(-(ln(prior) - ln(1 - prior) + {odds}))) AS q FROM pat, {t}"


def _round(i: int) -> str:
    def share(j, v, good):
        w = "q" if good else "(1 - q)"
        start = (qr.GOOD_START if good else qr.BAD_START)[v + 1]
        size = "sum(c * q)" if good else "(sum(c) - sum(c * q))"
        x = f"(coalesce(sum(c * {w}) FILTER (v{j} = {v}), 0) / ({size} + 0.001) + {start}) / 2"
        low, high = ((qr.LOW, qr.TURN) if good else (qr.TURN, qr.HIGH)) if v == -1 else (qr.LOW, qr.HIGH)
        return f"{_clamp(x, low, high)} AS {'g' if good else 'b'}{j}_{v + 1}"
    shares = ", ".join(share(j, v, good) for j in range(_J) for v in (-1, 0, 1) for good in (True, False))
    return (f"m{i + 1} AS MATERIALIZED (SELECT {_clamp('sum(c * q) / sum(c)')} AS prior, {shares} "
            f"FROM ({_posterior(f'm{i}')}))")


_START = f"SELECT CAST({qr.PRIOR} AS DOUBLE) AS prior, " + ", ".join(
    f"CAST({qr.GOOD_START[v]} AS DOUBLE) AS g{j}_{v}, CAST({qr.BAD_START[v]} AS DOUBLE) AS b{j}_{v}"
    for j in range(_J) for v in range(3))

OP1_SQL = f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
s AS (SELECT doc_id, text, {_W} AS w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^ \\t\\n\\x0B\\f\\r]')) AS l FROM t),
win AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS k FROM (
  SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM s WHERE len(w) >= 3)),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS c FROM win) WHERE c > 1) GROUP BY doc_id),
f AS (SELECT s.doc_id, len(w) AS n_words, len(array_to_string(w, '')) AS word_chars,
  len(text) - len(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines,
  coalesce(rep.n, 0) AS n_repeat_words, len(l) AS n_lines, len(list_distinct(w)) AS n_distinct,
  len(text) - len(regexp_replace(text, '\\p{{Lu}}', '', 'g')) AS n_upper, len(text) - len(replace(text, '!', '')) AS n_exclaim,
  len(text) - len(replace(text, '|', '')) AS n_bars, len(regexp_extract_all(text, '{qr.ODD_END}')) AS n_odd_ends,
  len(text) - len(regexp_replace(text, '[.!?]', '', 'g')) AS n_stops FROM s LEFT JOIN rep ON rep.doc_id = s.doc_id),
v AS MATERIALIZED (SELECT *, n_words < {qr.MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed, {_VOTES} FROM f),
pat AS MATERIALIZED (SELECT {_V}, CAST(count(*) AS DOUBLE) AS c FROM v GROUP BY {_V}),
m0 AS MATERIALIZED ({_START}),
{", ".join(_round(i) for i in range(qr.ROUNDS))},
post AS MATERIALIZED ({_posterior(f'm{qr.ROUNDS}')})
SELECT v.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND coalesce(q >= {qr.KEEP_AT}, false) AS kept
FROM v LEFT JOIN post USING ({_V})
"""


@register("op1_quality_rules", OP1_SQL)
def op1_quality_rules(spark, sf_dir):
    """Counts, base and label-model verdict of all documents."""
    return qr.judge(read(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
