"""URL filters: rules on host and path, and redirect equivalence for what no rule decides; DataFrame functions only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.words import table
from lodestone.operators.components import connected_components
from lodestone.operators.keyed import attach
from lodestone.session import cut


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (Rule("block", "net", "/"), Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _after_scheme(url: Column) -> Column:
    at = F.instr(F.coalesce(url, F.lit("")), "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(_after_scheme(url), "^[^/?#]*", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(_after_scheme(url), "^[^/?#]*([^?#]*)", 1)


def fitting(host: Column, path: Column, rules: tuple[Rule, ...]) -> Column:
    """Name of the longest rule (host and path together) that fits, else null; of equally long ones an allowing one."""
    chosen = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.name), r.verdict == "allow", r.name)):
        chosen = F.when(((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path), F.lit(r.name)).otherwise(chosen)
    return chosen


def _attribute(tag: Column, name: str) -> Column:
    """Value of an attribute, with double, single or no quotes; empty if it is not there."""
    return F.regexp_replace(F.regexp_extract(tag, rf"(?is)\s{name}\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", 1), "^[\"']|[\"']$", "")


#: What a browser does not read as tags, and a target of another kind than a page, like mailto:.
UNREAD = r"(?is)<!--.*?(?:-->|$)|<(script|style|template|noscript)\b[^>]*>.*?(?:</\1\s*>|$)"
OTHER_SCHEME = r"^[A-Za-z][A-Za-z0-9+.\-]*:"


def folded(path: Column) -> Column:
    """``path`` without its ``.`` and ``..`` segments."""
    last = F.element_at(F.split(path, "/"), -1)
    closed = F.when(last.isin(".", ".."), F.concat(path, F.lit("/"))).otherwise(path)

    def step(done: Column, x: Column) -> Column:
        up = F.when(F.size(done) > 1, F.slice(done, F.lit(1), F.size(done) - 1)).otherwise(done)
        return F.when(x == "..", up).when(x == ".", done).otherwise(F.array_append(done, x))

    return F.when(path.rlike(r"(^|/)\.\.?(/|$)"), F.array_join(F.aggregate(F.split(closed, "/"), F.array().cast("array<string>"), step), "/")).otherwise(path)


def resolved(target: Column, url: Column) -> Column:
    """The url that ``target`` names on the page ``url``; null where it names no page.

    Targets without a scheme are taken against the page: ``//host/x``, ``/x`` from the host, ``x`` and ``../x`` from the
    folder of the page's path, ``?q`` and ``#f`` the page itself. Queries and fragments do not matter to a place and are cut there.
    """
    bare = F.regexp_extract(target, "^[^?#]*", 0)
    here = F.concat(F.lit("http://"), host_of(url))
    folder = F.regexp_replace(F.when(path_of(url) == "", F.lit("/")).otherwise(path_of(url)), "[^/]*$", "")
    return (
        F.when(target.contains("://") & target.rlike(OTHER_SCHEME), target)
        .when(target.rlike(OTHER_SCHEME), F.lit(None))
        .when(target.startswith("//"), F.concat(F.lit("http:"), target))
        .when(bare == "", url)
        .when(bare.startswith("/"), F.concat(here, folded(bare)))
        .otherwise(F.concat(here, folded(F.concat(folder, bare))))
    )


def links(pages: DataFrame) -> DataFrame:
    """(src, dst): the page's own place and the place its canonical link or its meta refresh names, as host and path.

    Tags within comments, scripts, styles, templates and noscript do not count. See resolved() for targets.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    # a cheap substring test keeps the patterns off pages without such a tag
    hinted = pages.filter(F.lower(html).contains("canonical") | F.lower(html).contains("refresh"))
    tags = hinted.select("url", F.explode(F.regexp_extract_all(F.regexp_replace(html, UNREAD, " "), F.lit(r"(?is)<(?:link|meta)\b[^>]*>"), F.lit(0))).alias("tag"))
    canonical = F.when(F.lower(_attribute(F.col("tag"), "rel")).rlike(r"(^|\s)canonical(\s|$)"), _attribute(F.col("tag"), "href"))
    refresh = F.when(F.lower(_attribute(F.col("tag"), "http-equiv")) == "refresh", F.regexp_extract(_attribute(F.col("tag"), "content"), r"(?is)url\s*=\s*['\"]?([^'\"\s]+)", 1))
    to = tags.select("url", F.trim(F.coalesce(canonical, refresh)).alias("to")).filter("to <> ''")
    return to.select(place(F.col("url")).alias("src"), place(resolved(F.col("to"), F.col("url"))).alias("dst")).filter("src <> '' AND dst <> ''")


def place(url: Column) -> Column:
    """Host and path as one string: what rules can see of a url, and the node that pages of equal place share."""
    return F.concat(host_of(url), path_of(url))


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, redirects: DataFrame | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict, alias_of): the rule's verdict where one fits; else block for aliases of a blocked place, else allow.

    ``redirects`` (from_url, to_url) adds edges to those that pages name themselves. Places connected by redirects and
    canonical links are one; if a rule blocks any place of them, those without a rule of their own are blocked. A place
    with an allowing rule stays allowed, and a place that is itself only an alias passes nothing on. ``alias_of``
    is the least place of the connected ones, null for places without edges. Null urls have empty host and path.
    """
    edges = links(pages)
    if redirects is not None:
        edges = edges.union(redirects.select(place(F.col("from_url")), place(F.col("to_url"))).toDF("src", "dst").filter("src <> '' AND dst <> ''"))
    components = cut(connected_components(edges))
    host, path = F.regexp_extract("node", "^[^/]*", 0), F.regexp_extract("node", "^[^/]*(.*)$", 1)
    blocking = F.lit(False)
    for r in rules:
        if r.verdict == "block":
            blocking = blocking | (F.col("__r") == r.name)
    blocked = components.withColumn("__r", fitting(host, path, rules)).groupBy("component").agg(F.coalesce(F.bool_or(blocking), F.lit(False)).alias("blocked")).filter("blocked")
    sized = cut(components.groupBy("component").agg(F.count("*").alias("__n")).join(blocked, "component"))
    aliases = attach(components, sized, "component", "__n", components.count(), how="left")
    aliases = aliases.select(F.col("node").alias("__place"), F.col("component").alias("alias_of"), F.coalesce("blocked", F.lit(False)).alias("__blocked"))
    slim = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    slim = slim.withColumns({"rule": fitting(F.col("host"), F.col("path"), rules), "__p": F.concat("host", "path")})
    own = F.lit(None).cast("string")
    for r in rules:
        own = F.when(F.col("rule") == r.name, F.lit(r.verdict)).otherwise(own)
    crawled = slim.groupBy(F.col("__p").alias("__place")).agg(F.count("*").alias("__n"))  # one place may be crawled any number of times
    joined = attach(slim, cut(aliases.join(crawled, "__place")), "__p", "__n", pages.count(), "__place", how="left")
    return joined.select("page_id", "host", "path", "rule", F.coalesce(own, F.when(F.col("__blocked"), F.lit("block")), F.lit("allow")).alias("verdict"), "alias_of")


def op10_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    """Every page's verdict; null urls have empty host and path and are allowed, repeated rows are judged alike."""
    return judge(table(spark, folder, "pages").select("page_id", "url", "html"))


OP10_SQL = r"""
WITH RECURSIVE p AS (
  SELECT page_id, html, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS u FROM pages
), q AS (
  SELECT page_id, html, regexp_extract(u, '^[^/?#]*([^?#]*)', 1) AS path,
    translate(regexp_extract(u, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host
  FROM p
), rules(name, host, path, verdict) AS (
  VALUES ('net/', 'net', '/', 'block'), ('example.net/en/', 'example.net', '/en/', 'allow'), ('example.com/de/', 'example.com', '/de/', 'block'), ('org/fr/', 'org', '/fr/', 'allow')
), tags AS (
  SELECT host, path, unnest(regexp_extract_all(regexp_replace(regexp_replace(html, '(?is)<!--.*?(-->|$)', ' ', 'g'), '(?is)<script\b[^>]*>.*?(</script\s*>|$)|<style\b[^>]*>.*?(</style\s*>|$)|<template\b[^>]*>.*?(</template\s*>|$)|<noscript\b[^>]*>.*?(</noscript\s*>|$)', ' ', 'g'), '(?is)<(?:link|meta)\b[^>]*>')) AS tag FROM q WHERE lower(html) LIKE '%canonical%' OR lower(html) LIKE '%refresh%'
), named AS (
  SELECT host, path, CASE
    WHEN regexp_matches(tag, '(?is)\srel\s*=\s*["'']?[^"''>]*\bcanonical\b') THEN trim(regexp_extract(tag, '(?is)\shref\s*=\s*("[^"]*"|''[^'']*''|[^\s"''>]+)', 1), '"''')
    WHEN regexp_matches(tag, '(?is)\shttp-equiv\s*=\s*["'']?refresh') THEN regexp_extract(tag, '(?is)url\s*=\s*[''"]?([^''"\s>]+)', 1) END AS target
  FROM tags
), named_page AS (
  SELECT host, path, trim(target) AS target, regexp_replace(trim(target), '[?#].*$', '', 's') AS bare FROM named WHERE trim(target) <> ''
), rooted AS (
  SELECT host, path, target, bare, CASE WHEN starts_with(bare, '/') THEN bare ELSE regexp_replace(CASE WHEN path = '' THEN '/' ELSE path END, '[^/]*$', '') || bare END AS whole FROM named_page
), full_urls AS (
  SELECT host || path AS src, CASE
    WHEN regexp_matches(target, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN CASE WHEN contains(target, '://') THEN target END
    WHEN starts_with(target, '//') THEN 'http:' || target
    WHEN bare = '' THEN 'http://' || host || path
    ELSE 'http://' || host || array_to_string(list_reduce(list_transform(string_split(CASE WHEN regexp_matches(whole, '(^|/)[.][.]?$') THEN whole || '/' ELSE whole END, '/'), lambda x: [x]),
      lambda done, x: CASE WHEN x[1] = '.' THEN done WHEN x[1] = '..' THEN CASE WHEN len(done) > 1 THEN done[1:len(done) - 1] ELSE done END ELSE done || x END), '/') END AS target
  FROM rooted
), after AS (
  SELECT src, substr(target, strpos(target, '://') + 3) AS u FROM full_urls WHERE target IS NOT NULL
), edges AS (
  SELECT src, translate(regexp_extract(u, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') || regexp_extract(u, '^[^/?#]*([^?#]*)', 1) AS dst FROM after
), both_ways AS (
  SELECT src, dst FROM edges WHERE src <> '' AND dst <> '' UNION SELECT dst, src FROM edges WHERE src <> '' AND dst <> ''
), reach(node, other) AS (
  SELECT src, src FROM both_ways UNION SELECT r.node, b.dst FROM reach r JOIN both_ways b ON r.other = b.src
), places AS (
  SELECT host, path, host || path AS place FROM q UNION SELECT regexp_extract(other, '^[^/]*'), regexp_extract(other, '^[^/]*(.*)$', 1), other FROM reach
), fit AS (
  SELECT place, max_by(r.name, length(r.name)) AS rule, max_by(r.verdict, length(r.name)) AS verdict
  FROM places p JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path) GROUP BY place
), alias AS (
  SELECT node, min(other) AS alias_of, bool_or(coalesce(f.verdict = 'block', false)) AS blocked FROM reach LEFT JOIN fit f ON f.place = other GROUP BY node
)
SELECT q.page_id, q.host, q.path, f.rule, coalesce(f.verdict, CASE WHEN a.blocked THEN 'block' END, 'allow') AS verdict, a.alias_of
FROM q LEFT JOIN fit f ON f.place = q.host || q.path LEFT JOIN alias a ON a.node = q.host || q.path
"""
