"""URL filters with redirect equivalence.

Rules (host, path prefix) decide the urls that they fit. Urls that redirects or canonical links join are aliases of
one page: distributed connected components over those edges carry block decisions to the aliases that no rule
decides. An explicit allow always stands for the url that it fits, whatever its aliases are.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, bind
from .components import connected_components

#: The rules of the registered query, host and path in one string.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))

ATTRIBUTE = r"""\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""


def host_of(url: Column) -> Column:
    """After the first '://' up to '/', '?', '#' or the end, A-Z lower-cased; empty without '://' or for null."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to '?', '#' or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def identity(url: Column) -> Column:
    """The page that a url names: host, path and query. The scheme is dropped (sites redirect http to https) and so is the fragment (never sent). Null without '://'."""
    query = F.regexp_extract(url, r"(?s)^.*?://[^?#]*(\?[^#]*)?", 1)
    return F.when(F.instr(url, F.lit("://")) > 0, F.concat(host_of(url), F.coalesce(F.nullif(path_of(url), F.lit("")), F.lit("/")), F.coalesce(query, F.lit(""))))


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> Column:
    """(rule, verdict) of the longest rule that fits, as a struct; null if none does. The rules are a short, fixed list."""
    longest = sorted(rules, key=lambda r: (-len(r[1]), r[1]))
    listed = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(v).alias("verdict"), F.lit(r.partition("/")[0]).alias("host"), F.lit(f"/{r.partition('/')[2]}").alias("path")) for v, r in longest])
    fits = lambda u, r: ((u["host"] == r["host"]) | F.endswith(u["host"], F.concat(F.lit("."), r["host"]))) & F.startswith(u["path"], r["path"])
    first = lambda u: F.try_element_at(F.filter(listed, lambda r: fits(u, r)), F.lit(1))
    return bind(bind(F.struct(host.alias("host"), path.alias("path")), first), lambda r: F.when(r.isNotNull(), F.struct(r["rule"].alias("rule"), r["verdict"].alias("verdict"))))


def _value(attribute: str, tag: Column) -> Column:
    pattern = rf"(?is)\s{attribute}{ATTRIBUTE}"
    value = F.concat(*[F.coalesce(F.regexp_extract(tag, pattern, i), F.lit("")) for i in (1, 2, 3)])
    return F.replace(value, F.lit("&amp;"), F.lit("&"))


def _absolute(base: Column, link: Column) -> Column:
    """A link as an absolute url: with its scheme, or relative to the page's scheme, host or folder. Null for null."""
    origin = F.regexp_extract(base, r"(?s)^(.*?://[^/?#]*)", 1)
    folder = F.regexp_extract(base, r"(?s)^.*?://[^/?#]*([^?#]*/)", 1)

    def resolved(x: Column) -> Column:
        return (
            F.when(F.rlike(x, F.lit(r"^[A-Za-z][A-Za-z0-9+.-]*://")), x)
            .when(F.startswith(x, F.lit("//")), F.concat(F.lit("http:"), x))
            .when(F.startswith(x, F.lit("/")), F.concat(origin, x))
            .when(F.startswith(x, F.lit("?")), F.concat(origin, path_of(base), x))
            .otherwise(F.concat(origin, F.coalesce(F.nullif(folder, F.lit("")), F.lit("/")), x))
        )

    return bind(F.trim(link), resolved)


def link_edges(pages: DataFrame) -> DataFrame:
    """pages (url, html) -> (source, target): urls that a page declares equivalent by a canonical link or a meta refresh. Tags are read case-insensitively, with attributes in any order; a page may declare several."""
    tags = F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(r"(?is)(<(?:link|meta)\s[^>]*>)"), 1)
    tagged = pages.filter(F.col("html").isNotNull()).select("url", F.explode(F.filter(tags, lambda t: F.rlike(t, F.lit(r"(?is)\srel\s*=\s*[\"']?[^\"'>]*canonical|http-equiv\s*=\s*[\"']?refresh")))).alias("tag"))
    refresh = F.regexp_extract(_value("content", F.col("tag")), r"(?is);\s*url\s*=\s*['\"]?([^'\"]*)", 1)
    link = F.when(F.rlike("tag", F.lit("(?is)^<link")), _value("href", F.col("tag"))).otherwise(refresh)
    return tagged.select(F.col("url").alias("source"), _absolute(F.col("url"), F.nullif(link, F.lit(""))).alias("target")).filter(F.col("target").isNotNull())


def judge_urls(pages: DataFrame, redirects: DataFrame | None = None, rules: tuple[tuple[str, str], ...] = RULES) -> DataFrame:
    """One row per row of ``pages``: page_id, url, host, path, rule, verdict, by ('rule', 'alias' or 'default'), component.

    redirects: (source, target) urls from a crawl's log; edges out of the pages' html are added. The verdict is the
    rule's; without one it is block if any url of the same component, be it a page or only a link's target, is
    blocked by a rule, else allow. Null urls and urls without '://' have empty host and path, no aliases, and are
    allowed. Null html has no links, very long html is searched whole; repeated rows are judged alike. Of rules that fit
    the longest wins, of equally long ones the first in name order. Columns other than page_id, url and html are not
    read, whatever they are called; an empty table gives an empty one.
    """
    edges = link_edges(pages)
    if redirects is not None:
        edges = edges.unionByName(redirects.select("source", "target"))
    named = edges.select(identity(F.col("source")).alias("a"), identity(F.col("target")).alias("b")).filter("a is not null and b is not null and a != b")
    linked = connected_components(named)
    # An identity decides like any url: its host and path are what the url's were.
    by_rule = rule_of(host_of(F.concat(F.lit("x://"), F.col("node"))), path_of(F.concat(F.lit("x://"), F.col("node"))), rules)["verdict"]
    blocked = linked.withColumn("v", by_rule).groupBy("root").agg(F.max(F.coalesce(F.col("v") == "block", F.lit(False))).alias("blocked"))
    decided = linked.join(blocked, "root").select(F.col("node").alias("__node"), F.col("root").alias("component"), "blocked")
    own = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), identity(F.col("url")).alias("__node"))
    own = own.withColumn("__rule", rule_of(F.col("host"), F.col("path"), rules))
    verdict = F.coalesce(F.col("__rule.verdict"), F.when(F.col("blocked"), "block"), F.lit("allow"))
    by = F.when(F.col("__rule").isNotNull(), "rule").when(F.col("blocked"), "alias").otherwise("default")
    return own.join(decided, "__node", "left").select("page_id", "url", "host", "path", F.col("__rule.rule").alias("rule"), verdict.alias("verdict"), by.alias("by"), "component")


def rules_sql(rules: tuple[tuple[str, str], ...] = RULES) -> str:
    """DuckDB SQL for judge_urls over pages without redirects or canonical links among their urls: host, path, rule, verdict."""
    listed = ", ".join(f"('{v}', '{r}', '{re.split('/', r)[0]}', '/{r.partition('/')[2]}')" for v, r in rules)
    return rf"""
WITH p AS (SELECT page_id, lower(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1)) AS host, regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
r(verdict, rule, h, pre) AS (VALUES {listed}),
m AS (SELECT p.*, (SELECT arg_max(rule, length(rule)) FROM r WHERE (p.host = h OR ends_with(p.host, '.' || h)) AND starts_with(p.path, pre)) AS rule FROM p)
SELECT page_id, host, path, m.rule, coalesce(r.verdict, 'allow') AS verdict FROM m LEFT JOIN r ON r.rule = m.rule"""
