"""URL block decisions that follow redirects.

Rules (host, path prefix, verdict) fit a host and its subdomains; of the rules that fit a URL the
longest wins (host and path together; a block wins a tie).  URLs that redirect to one another, or
name one another as canonical, are aliases: connected components over those edges.  A component in
which some URL is blocked by a rule blocks its members, crawled or not, except those that a rule
allows: an explicit allow takes precedence for the page that it names, and for no other.

Links are read from canonical ``link`` and refresh ``meta`` tags of any length, and resolved against
the page's URL or its first ``base`` tag (RFC 3986: scheme-relative, absolute and relative paths, dot
segments, query only).  Links in comments don't count, signs in quoted values are no ends of tags, and a URL without a
path is its host's root.

DataFrame operations only.  Rules are joined by host suffix and by path prefix, so neither a plan nor a
row grows with the list.  A null URL, or one without ``://``, has an empty host
and path, fits no rule and has no aliases.  Rows are judged each, also if ids or URLs repeat; null
html has no links.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Work, components


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    def __post_init__(self) -> None:
        if self.verdict not in ("allow", "block"):
            raise ValueError(f"a verdict is allow or block, not {self.verdict!r}")


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A to Z in lower case."""
    rest = F.when(url.contains("://"), F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.coalesce(F.translate(F.regexp_extract(rest, r"(?s)\A([^/?#]*)", 1), upper, lower), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    rest = F.when(url.contains("://"), F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    return F.coalesce(F.regexp_extract(rest, r"(?s)\A[^/?#]*([^?#]*)", 1), F.lit(""))


def url_key(url: Column) -> Column:
    """What makes two URLs the same node: host and path with the query; scheme and fragment don't count."""
    rest = F.when(url.contains("://"), F.regexp_extract(F.substring(url, F.instr(url, "://") + 3, F.length(url)), r"(?s)\A[^/?#]*([^#]*)", 1))
    rest = F.when(rest.rlike(r"\A(\?|\z)"), F.concat(F.lit("/"), rest)).otherwise(rest)  # no path is the root
    return F.when(host_of(url) != "", F.concat(host_of(url), rest))


def _after(text: Column, pattern: str) -> Column:
    return F.regexp_extract(text, pattern, 1)


def without_dots(path: Column) -> Column:
    """A path that starts with a slash, with ``.`` and ``..`` segments resolved."""
    parts = F.slice(F.split(path, "/"), 2, 1 << 30)
    up = lambda done: F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))
    done = F.aggregate(parts, F.array().cast("array<string>"), lambda done, x: F.when(x == ".", done).when(x == "..", up(done)).otherwise(F.concat(done, F.array(x))))
    done = F.when(F.element_at(parts, -1).isin(".", ".."), F.concat(done, F.array(F.lit("")))).otherwise(done)
    return F.when(path.contains("/."), F.concat(F.lit("/"), F.array_join(done, "/"))).otherwise(path)


def resolved(target: Column, base: Column) -> Column:
    """The absolute URL of ``target`` on a page at ``base``; null if it names no page (fragment only, other kinds of URL)."""
    scheme, server = _after(base, r"(?s)\A([^:/?#]*):"), _after(base, r"(?s)\A[^:/?#]*://([^/?#]*)")
    origin = F.concat(scheme, F.lit("://"), server)
    path, rest = _after(target, r"(?s)\A([^?#]*)"), _after(target, r"(?s)\A[^?#]*(.*)")
    folder = _after(path_of(base), r"(?s)\A(.*/)")
    folder = F.when(folder == "", F.lit("/")).otherwise(folder)
    return (
        F.when(target.rlike(r"(?s)\A[A-Za-z][A-Za-z0-9+.-]*://"), target)
        .when(target.rlike(r"(?s)\A(#|\z|[A-Za-z][A-Za-z0-9+.-]*:)"), F.lit(None).cast("string"))
        .when(target.startswith("//"), F.concat(scheme, F.lit(":"), target))
        .when(target.startswith("/"), F.concat(origin, without_dots(path), rest))
        .when(target.startswith("?"), F.concat(origin, path_of(base), target))
        .otherwise(F.concat(origin, without_dots(F.concat(folder, path)), rest))
    )


def _attribute(tag: Column, name: str) -> Column:
    quoted = [_after(tag, rf"(?is)(?<![\w-]){name}\s*=\s*{q}([^{q}]*){q}") for q in ('"', "'")]
    bare = _after(tag, rf"(?is)(?<![\w-]){name}\s*=\s*([^\s\"'>]+)")
    value = F.when(quoted[0] != "", quoted[0]).when(quoted[1] != "", quoted[1]).otherwise(bare)
    return F.trim(F.replace(value, F.lit("&amp;"), F.lit("&")))


#: A tag; signs within quotes don't end it.
TAG = r"""(?is)<(?:link|meta|base)\b[^<>"']*+(?:(?:"[^"]*+"|'[^']*+')[^<>"']*+)*+>"""


def link_edges(pages: DataFrame) -> DataFrame:
    """(``a``, ``b``): keys of a page's URL and of the target of each of its canonical links and refresh redirects."""
    html, url = F.col("html").cast("string"), F.col("url").cast("string")
    shown = F.when(html.contains("<!--"), F.regexp_replace(html, r"(?s)<!--.*?(?:-->|\z)", "")).otherwise(html)
    tags = F.regexp_extract_all(shown, F.lit(TAG), F.lit(0))
    found = pages.where(html.rlike(r"(?i)canonical|http-equiv") & url.contains("://")).select(url.alias("u"), tags.alias("tags"))
    base = F.get(F.filter("tags", lambda t: t.rlike(r"(?i)\A<base\b")), F.lit(0))
    found = found.select("u", "tags", F.coalesce(resolved(_attribute(base, "href"), F.col("u")), F.col("u")).alias("base"))
    canonical = lambda t: t.rlike(r"(?i)\A<link\b") & t.rlike(r"(?i)(?<![\w-])rel\s*=\s*[\"']?[^\"'>]*\bcanonical\b")
    refresh = lambda t: t.rlike(r"(?i)\A<meta\b") & t.rlike(r"(?i)http-equiv\s*=\s*[\"']?\s*refresh\b")
    target = lambda t: F.when(canonical(t), _attribute(t, "href")).otherwise(_after(_attribute(t, "content"), r"(?is)\burl\s*=\s*[\"']?\s*([^\"'\s]+)"))
    found = found.select("u", "base", F.explode(F.filter("tags", lambda t: canonical(t) | refresh(t))).alias("t"))
    found = found.select("u", "base", target(F.col("t")).alias("to"))
    return found.select(url_key(F.col("u")).alias("a"), url_key(resolved(F.col("to"), F.col("base"))).alias("b")).where("a is not null and b is not null and a <> b")


def rule_table(like: DataFrame, rules: list[Rule]) -> DataFrame:
    """(h, p, rule, verdict) of a list of rules."""
    rows = [F.struct(F.lit(r.host).alias("h"), F.lit(r.path).alias("p"), F.lit(r.host + r.path).alias("rule"), F.lit(r.verdict).alias("verdict")) for r in rules]
    return like.sparkSession.range(1).select(F.inline(F.array(*rows))) if rows else like.sparkSession.range(0).select(*[F.lit("").alias(c) for c in ("h", "p", "rule", "verdict")])


def with_rules(work: Work, rows: DataFrame, rules: DataFrame) -> DataFrame:
    """``rows`` (host, path) and ``best``: struct of rule and verdict of the longest rule that fits, else null.

    A place (host and path) looks up the prefixes of its path that have the lengths of its hosts' rules; no row holds a host's rules.
    """
    parts = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "."))
    lengths = rules.select("h", F.length("p").alias("n")).distinct()
    places = rows.where("host <> ''").select("host", "path").distinct().select("host", "path", F.explode(suffixes).alias("h"))
    prefixes = places.join(lengths, "h").where(F.col("n") <= F.length("path")).select("host", "path", "h", F.expr("substring(path, 1, n)").alias("p"))
    order = F.struct(F.length("rule").alias("n"), (F.col("verdict") == "block").alias("b"), "p", "rule", "verdict")
    fits = prefixes.join(rules, ["h", "p"]).groupBy("host", "path").agg(F.max(order).alias("best"))
    # written, so that Spark can split the join at a place with many pages
    fits = work.write(fits.select("host", "path", F.struct("best.rule", "best.verdict").alias("best")), "rules")
    return rows.join(fits, ["host", "path"], "left")


def judge(work: Work, pages: DataFrame, rules: list[Rule] | DataFrame, redirects: DataFrame | None = None) -> DataFrame:
    """Rows (page_id, host, path, rule, verdict) for all rows of ``pages`` (page_id, url, html).

    ``rules``: a list, or a table (host, path, verdict).  ``redirects`` (from_url, to_url) adds edges
    of a crawl log.  Ends of edges that aren't pages are judged too, so a page is blocked if it
    redirects to a blocked URL that wasn't crawled.
    """
    table = rule_table(pages, rules) if isinstance(rules, list) else rules.select(F.col("host").alias("h"), F.col("path").alias("p"), F.concat("host", "path").alias("rule"), "verdict")
    own = pages.select("page_id", F.col("url").cast("string").alias("u")).select("page_id", host_of(F.col("u")).alias("host"), path_of(F.col("u")).alias("path"), url_key(F.col("u")).alias("key"))
    own = with_rules(work, own, table)
    edges = link_edges(pages)
    if redirects is not None:
        edges = edges.unionByName(redirects.select(url_key(F.col("from_url")).alias("a"), url_key(F.col("to_url")).alias("b")).where("a is not null and b is not null and a <> b"))
    edges = work.write(edges.distinct(), "links")
    if edges.isEmpty():
        return _rows(own.withColumn("spread", F.lit(False)))
    nodes = edges.select(F.explode(F.array("a", "b")).alias("key")).distinct().withColumn("node", F.monotonically_increasing_id())
    nodes = work.write(nodes, "nodes")
    ids = edges.join(nodes.toDF("a", "u"), "a").join(nodes.toDF("b", "v"), "b").select("u", "v")
    member = components(work, ids)
    nodes = nodes.join(member, "node", "left").select("key", F.coalesce("component", "node").alias("component"))
    as_url = F.concat(F.lit("x://"), F.col("key"))
    judged = with_rules(work, nodes.select("key", "component", host_of(as_url).alias("host"), path_of(as_url).alias("path")), table)
    judged = work.write(judged.select("key", "component", F.col("best.verdict").alias("v")), "judged")
    said = work.write(judged.where("v = 'block'").select("component").distinct(), "blocked")
    blocked = work.write(judged.join(said, "component", "left_semi").select("key", F.lit(True).alias("spread")), "spread")
    work.drop(edges, judged, said)
    return _rows(own.join(blocked, "key", "left"))


def _rows(df: DataFrame) -> DataFrame:
    spread = F.when(F.coalesce("spread", F.lit(False)), F.lit("block")).otherwise(F.lit("allow"))
    return df.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", spread).alias("verdict"))


#: For pages without canonical or refresh links, as the method then blocks nothing more.
ORACLE_SQL = r"""
WITH u AS (
  SELECT page_id,
         CASE WHEN contains(url, '://') THEN translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
         CASE WHEN contains(url, '://') THEN regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) ELSE '' END AS path FROM pages),
r(verdict, h, p) AS (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
m AS (SELECT page_id, h || p AS rule, verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(h || p) DESC, verdict DESC) AS nth
      FROM u JOIN r ON (host = h OR host LIKE '%.' || h) AND starts_with(path, p))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM u LEFT JOIN (SELECT * FROM m WHERE nth = 1) USING (page_id)
"""
