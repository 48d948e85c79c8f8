"""URL rules with redirect equivalence (DataFrame functions only).

**Rules.**  A rule ``(verdict, host, path)`` fits its host and all subdomains when the url's path
starts with the rule's; the longest rule ``host + path`` wins (ties: the greater host).  Hosts are
matched by equi-join on the suffixes of a host's labels, so the rule table may be of any size; Spark
broadcasts it only when its size allows.

**Redirect equivalence.**  Urls are nodes (host, path and query; no scheme, no fragment).  Edges are
canonical links and meta refreshes found in the html, rows of an optional redirect table, and the
step from a url to its canonical form (no default port, no trailing slash or index page, no tracking
parameters).  Distributed connected components join all aliases; a url that no rule fits takes the
decision of its component: allow when any alias is explicitly allowed, else block when any alias is
blocked, else allow.  A url's own rule always precedes what it would inherit.

Edge cases.  A null url, or one without ``://``, has empty host and path, fits no rule, is no node and
is allowed.  Null html has no links.  Repeated rows and urls share their node and get one row each.
Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage
from .components import star_forest

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LINK = r"(?i)<link\b[^>]*>"
META = r"(?i)<meta\b[^>]*>"
IS_CANONICAL = r"(?i)\brel\s*=\s*[\"']?canonical\b"
IS_REFRESH = r"(?i)\bhttp-equiv\s*=\s*[\"']?refresh\b"
HREF = r"(?i)\bhref\s*=\s*[\"']?([^\"'\s>]+)"
REFRESH_URL = r"(?i)\burl\s*=\s*[\"']?([^\"'\s>]+)"
TRACKING = r"^(utm_[a-z]+|ref|fbclid|gclid|sessionid)="


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def host_of(url: Column) -> Column:
    """A-Z lower-cased text after the first ``://`` up to ``/ ? #``; empty without a scheme."""
    return F.translate(F.coalesce(F.regexp_extract(_after_scheme(url), r"^[^/?#]*", 0), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def query_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_after_scheme(url), r"^[^?#]*\?([^#]*)", 1), F.lit(""))


def _node(host: Column, path: Column, query: Column) -> Column:
    return F.when(host != "", F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise("")))


def node_of(url: Column) -> Column:
    """The url without scheme and fragment, null when it has no host."""
    return _node(host_of(url), path_of(url), query_of(url))


def canonical_of(url: Column) -> Column:
    kept = F.array_join(F.filter(F.split(query_of(url), "&"), lambda q: ~q.rlike(TRACKING)), "&")
    return _node(F.regexp_replace(host_of(url), r":(80|443)$", ""),
                 F.regexp_replace(path_of(url), r"/(index\.html?)?$", ""), kept)


def _first_tag(html: Column, tag: str, has: str) -> Column:
    return F.get(F.filter(F.regexp_extract_all(html, F.lit(tag), F.lit(0)), lambda t: t.rlike(has)), F.lit(0))


def _resolved(target: Column, url: Column) -> Column:
    """An absolute url for a link found on the page ``url``."""
    scheme = F.substring_index(url, "://", 1)
    site = F.concat(scheme, F.lit("://"), host_of(url))
    t = F.regexp_replace(target, "&amp;", "&")
    return F.when(t == "", None).when(F.instr(t, "://") > 0, t).when(
        t.startswith("//"), F.concat(scheme, F.lit(":"), t)).when(
        t.startswith("/"), F.concat(site, t)).otherwise(
        F.concat(site, F.regexp_replace(path_of(url), r"[^/]*$", ""), t))


def judge(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """The longest fitting rule of distinct ``(host, path)``: ``host, path, rule, rule_verdict``."""
    r = rules.select(F.col("host").alias("_h"), F.col("path").alias("_p"), F.col("verdict").alias("_v"))
    keys = urls.select("host", "path").filter("host != ''").distinct()
    labels = F.split("host", r"\.")
    suffix = F.transform(F.sequence(F.lit(1), F.size(labels)),
                         lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    fits = keys.withColumn("_s", F.explode(suffix)).join(r, F.col("_s") == F.col("_h")).filter(
        F.col("path").startswith(F.col("_p")))
    rule = F.concat("_h", "_p")
    best = fits.groupBy("host", "path").agg(F.max(F.struct(
        F.length(rule).alias("len"), F.col("_h"), rule.alias("rule"), F.col("_v").alias("verdict"))).alias("b"))
    return best.select("host", "path", "b.rule", F.col("b.verdict").alias("rule_verdict"))


def filter_urls(pages: DataFrame, rules: DataFrame, redirects: DataFrame | None = None) -> DataFrame:
    """``page_id, host, path, rule, verdict`` for every row of ``pages`` (``page_id, url, html``).

    ``rules`` has ``verdict, host, path``; ``redirects`` optional ``from_url, to_url``."""
    url = F.col("url")
    p = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    canonical = F.regexp_extract(_first_tag(F.col("html"), LINK, IS_CANONICAL), HREF, 1)
    refresh = F.regexp_extract(_first_tag(F.col("html"), META, IS_REFRESH), REFRESH_URL, 1)
    p = p.select("page_id", "url", host_of(url).alias("host"), path_of(url).alias("path"),
                 _resolved(canonical, url).alias("t1"), _resolved(refresh, url).alias("t2"))
    parsed = cut_lineage(p.select(
        "page_id", "host", "path", node_of(url).alias("node"),
        F.array_compact(F.array(node_of(F.col("t1")), node_of(F.col("t2")), canonical_of(url))).alias("aliases")),
        "url-parsed")
    edges = parsed.select("node", F.explode("aliases").alias("alias"))
    if redirects is not None:
        edges = edges.unionByName(redirects.select(node_of(F.col("from_url")).alias("node"),
                                                   node_of(F.col("to_url")).alias("alias")))
    edges = edges.filter("node is not null and alias is not null and node != alias").distinct()
    # nodes of the graph get dense numbers once, written so that they stay the same
    names = edges.select("node").unionByName(edges.select(F.col("alias").alias("node"))).distinct()
    names = cut_lineage(names.withColumn("id", F.monotonically_increasing_id()), "url-nodes")
    links = edges.join(names.withColumnRenamed("id", "u"), "node").join(
        names.select(F.col("node").alias("alias"), F.col("id").alias("v")), "alias").select("u", "v")
    forest = star_forest(links)
    as_url = F.concat(F.lit("x://"), F.col("node"))
    member = names.join(forest.select(F.col("u").alias("id"), F.col("v").alias("root")), "id", "left").select(
        "node", F.coalesce("root", "id").alias("root"), host_of(as_url).alias("host"), path_of(as_url).alias("path"))
    ruled = judge(member.select("host", "path"), rules)
    decision = member.join(ruled, ["host", "path"]).groupBy("root").agg(
        F.max(F.when(F.col("rule_verdict") == "allow", 2).otherwise(1)).alias("d"))
    inherited = member.join(decision, "root").select(
        "node", F.when(F.col("d") == 2, "allow").otherwise("block").alias("inherited"))
    out = parsed.select("page_id", "host", "path", "node").join(judge(parsed, rules), ["host", "path"], "left")
    out = out.join(inherited, "node", "left")
    return out.select("page_id", "host", "path", "rule",
                      F.coalesce("rule_verdict", "inherited", F.lit("allow")).alias("verdict"))
