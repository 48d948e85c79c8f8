"""Query of the URL filter and its oracle."""

from __future__ import annotations

from . import url_filter
from .common import read
from .registry import register

# the rules of the query (verdict, host, path)
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
         ("block", "net", "/es/"), ("block", "net", "/fr/")]

_RULE_SQL = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)


def _parts(url: str, keep: str) -> str:
    rest = f"CASE WHEN strpos({url}, '://') > 0 THEN substr({url}, strpos({url}, '://') + 3) END"
    return f"""{keep}, {rest} AS rest,
    coalesce(translate(regexp_extract({rest}, '^[^/?#]*'), '{url_filter.UPPER}', '{url_filter.LOWER}'), '') AS host,
    coalesce(regexp_extract({rest}, '^[^/?#]*([^?#]*)', 1), '') AS path,
    coalesce(regexp_extract({rest}, '^[^?#]*\\?([^#]*)', 1), '') AS query"""


_NODE = "CASE WHEN host <> '' THEN host || path || CASE WHEN query <> '' THEN '?' || query ELSE '' END END"
_Q = "[\"'']?"


def _link(tag: str, has: str, at: str) -> str:
    return (f"regexp_extract(list_filter(regexp_extract_all(html, '(?i)<{tag}\\b[^>]*>'), "
            f"lambda t: regexp_matches(t, '(?i)\\b{has}\\b'))[1], '(?i)\\b{at}\\s*=\\s*{_Q}([^\"''\\s>]+)', 1)")


OP5_SQL = f"""
WITH RECURSIVE rules AS (SELECT * FROM (VALUES {_RULE_SQL}) AS t(verdict, host, path)),
p AS (SELECT {_parts('url', 'page_id, url, html')} FROM pages),
t AS (SELECT {_NODE} AS node, url, host AS h0, path AS p0, unnest([
  replace({_link('link', f'rel\\s*=\\s*{_Q}canonical', 'href')}, '&amp;', '&'),
  replace({_link('meta', f'http-equiv\\s*=\\s*{_Q}refresh', 'url')}, '&amp;', '&')]) AS t FROM p),
target AS (SELECT node, CASE WHEN t = '' THEN NULL WHEN strpos(t, '://') > 0 THEN t
  WHEN starts_with(t, '//') THEN split_part(url, '://', 1) || ':' || t
  WHEN starts_with(t, '/') THEN split_part(url, '://', 1) || '://' || h0 || t
  ELSE split_part(url, '://', 1) || '://' || h0 || regexp_replace(p0, '[^/]*$', '') || t END AS t FROM t),
found AS (SELECT node, {_NODE} AS alias FROM (SELECT {_parts('t', 'node')} FROM target)),
form AS (SELECT {_NODE} AS node, host AS h0, regexp_replace(host, ':(80|443)$', '') AS host,
  regexp_replace(path, '/(index\\.html?)?$', '') AS path,
  array_to_string(list_filter(string_split(query, '&'), lambda q: NOT regexp_matches(q, '{url_filter.TRACKING}')), '&') AS query FROM p),
edges AS (SELECT DISTINCT node, alias FROM (SELECT node, alias FROM found UNION ALL
  SELECT node, {_NODE} FROM form) WHERE node <> alias),
both_ways AS (SELECT node AS a, alias AS b FROM edges UNION SELECT alias, node FROM edges),
reach AS (SELECT a AS node, a AS other FROM both_ways UNION SELECT r.node, e.b FROM reach r JOIN both_ways e ON e.a = r.other),
urls AS (SELECT DISTINCT host, path FROM (SELECT host, path FROM p UNION ALL
  SELECT host, path FROM (SELECT {_parts("('x://' || other)", 'other')} FROM (SELECT DISTINCT other FROM reach)))),
ruled AS (SELECT u.host, u.path, r.host || r.path AS rule, r.verdict FROM urls u JOIN rules r
  ON (u.host = r.host OR ends_with(u.host, '.' || r.host)) AND starts_with(u.path, r.path)
  QUALIFY row_number() OVER (PARTITION BY u.host, u.path ORDER BY len(r.host || r.path) DESC, r.host DESC) = 1),
inherited AS (SELECT node, CASE WHEN bool_or(verdict = 'allow') THEN 'allow' ELSE 'block' END AS v
  FROM (SELECT {_parts("('x://' || other)", 'node')} FROM reach) JOIN ruled USING (host, path) GROUP BY node)
SELECT page_id, p.host, p.path, rule, coalesce(ruled.verdict, v, 'allow') AS verdict
FROM p LEFT JOIN ruled ON ruled.host = p.host AND ruled.path = p.path
LEFT JOIN inherited ON inherited.node = (CASE WHEN p.host <> '' THEN p.host || p.path || CASE WHEN query <> '' THEN '?' || query ELSE '' END END)
"""


@register("op5_url_filter", OP5_SQL)
def op5_url_filter(spark, sf_dir):
    """Verdicts for all page urls under the fixed rules, blocks spread over aliases."""
    rules = spark.createDataFrame(RULES, "verdict string, host string, path string")
    return url_filter.filter_urls(read(spark, sf_dir, "pages"), rules)
