"""URL filters: host and path rules, carried to aliases over redirect and canonical links.

Two urls are equivalent when a page at one redirects to the other or names it as its
canonical address. Equivalence is the connected components of these links, found in
Spark. A url's own rule decides first. Without one, an explicit allow of any alias beats
a block of any alias; with neither, the default holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, keep, table
from .components import connected_components

#: verdict, host, start of the path
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
LINK_TAG = r"(?i)<link\b[^>]*>"
META_TAG = r"(?i)<meta\b[^>]*>"


def url_host(url: Column) -> Column:
    """What stands after the first :// up to a slash, question mark, hash or the end, A-Z lower-cased."""
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def url_path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def matching_rule(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...]) -> Column:
    """The longest rule that fits, as struct(verdict, rule); of equally long ones an allow."""
    order = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[0] != "allow", r[1] + r[2]))
    found = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, name, start in reversed(order):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        found = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(name + start).alias("rule"))).otherwise(found)
    return found


def page_address(url: Column) -> Column:
    """A url as a node: the fragment, which names a place within the page, is cut off."""
    return F.regexp_replace(url, r"(?s)#.*$", "")


def absolute(link: Column, url: Column) -> Column:
    """A link as written on the page at url, as an absolute address without fragment."""
    link = F.trim(F.regexp_replace(link, "&amp;", "&"))
    scheme = F.regexp_extract(url, r"^([^:/?#]+:)", 1)
    site = F.regexp_extract(url, r"^([^:/?#]+://[^/?#]*)", 1)
    folder = F.regexp_extract(url, r"^([^:/?#]+://[^/?#]*(?:[^?#]*/)?)", 1)
    folder = F.when(folder.endswith("/") & (F.length(folder) > F.length(site)), folder).otherwise(F.concat(site, F.lit("/")))
    full = (
        F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), link)
        .when(link.startswith("//"), F.concat(scheme, link))
        .when(link.startswith("/"), F.concat(site, link))
        .otherwise(F.concat(folder, link))
    )
    return page_address(full)


def alias_links(pages: DataFrame) -> DataFrame:
    """(a, b): page address and the address that its canonical link or refresh redirect names.

    Pages without url, links without target and links to the page itself give no row.
    """
    html = F.coalesce("html", F.lit(""))
    links = F.filter(F.regexp_extract_all(html, F.lit(LINK_TAG), F.lit(0)), lambda t: t.rlike(r"""(?i)\brel\s*=\s*["']?[^"'>]*\bcanonical\b"""))
    hrefs = F.transform(links, lambda t: F.regexp_extract(t, r"""(?i)\bhref\s*=\s*["']?([^"'\s>]+)""", 1))
    metas = F.filter(F.regexp_extract_all(html, F.lit(META_TAG), F.lit(0)), lambda t: t.rlike(r"""(?i)\bhttp-equiv\s*=\s*["']?refresh\b"""))
    moves = F.transform(metas, lambda t: F.regexp_extract(t, r"""(?i)\burl\s*=\s*["']?([^"'\s>;]+)""", 1))
    tagged = pages.where(F.col("url").isNotNull() & html.rlike(r"(?i)canonical|http-equiv"))
    found = tagged.select("url", F.explode(F.concat(hrefs, moves)).alias("link")).where("link <> ''")
    return found.select(page_address(F.col("url")).alias("a"), absolute(F.col("link"), F.col("url")).alias("b")).where("a <> b")


def judge_urls(
    pages: DataFrame,
    rules: tuple[tuple[str, str, str], ...] = RULES,
    redirects: DataFrame | None = None,
    default: str = "allow",
) -> DataFrame:
    """pages (page_id, url, html, ...) plus host, path, rule, verdict.

    redirects: further edges (a, b) of addresses, for instance from a crawl log. Null urls
    and urls without :// have an empty host and path, fit no rule and have no aliases.
    Repeated rows are judged alike; columns of these four names are replaced.
    """
    pages = pages.drop("host", "path", "rule", "verdict")
    judged = pages.withColumns({"host": url_host(F.col("url")), "path": url_path(F.col("url"))})
    own = matching_rule(F.col("host"), F.col("path"), rules)
    judged = judged.withColumn("_own", own)
    links = alias_links(pages)
    if redirects is not None:
        links = links.unionByName(redirects.select(page_address(F.col("a")).alias("a"), page_address(F.col("b")).alias("b")))
    roots = connected_components(links)
    # A member's verdict comes from the rules too, whether or not its page was crawled.
    members = roots.withColumn("_rule", matching_rule(url_host(F.col("node")), url_path(F.col("node")), rules)["verdict"])
    spread = members.groupBy("root").agg(
        F.max((F.col("_rule") == "allow").cast("int")).alias("_allow"), F.max((F.col("_rule") == "block").cast("int")).alias("_block")
    )
    decided = F.when(F.col("_allow") == 1, "allow").when(F.col("_block") == 1, "block")
    aliases = keep(roots.join(spread, "root").select(F.col("node").alias("_node"), decided.alias("_alias")).where("_alias is not null"))
    judged = judged.withColumn("_node", page_address(F.col("url"))).join(aliases, "_node", "left")
    verdict = F.coalesce(F.col("_own")["verdict"], F.col("_alias"), F.lit(default))
    return judged.withColumns({"rule": F.col("_own")["rule"], "verdict": verdict}).drop("_own", "_node", "_alias")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return judge_urls(pages).select("page_id", "host", "path", "rule", "verdict")


_RULES_SQL = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)

ORACLE_SQL = rf"""
WITH RECURSIVE rules(verdict, host, start) AS (VALUES {_RULES_SQL}),
tags AS (
    SELECT url, unnest(regexp_extract_all(html, '(?i)<link\b[^>]*>') || regexp_extract_all(html, '(?i)<meta\b[^>]*>')) AS tag FROM pages
), targets AS (
    SELECT url, CASE WHEN regexp_matches(tag, '(?i)^<link') THEN regexp_extract(tag, '(?i)\bhref\s*=\s*["'']?([^"''\s>]+)', 1)
                     ELSE regexp_extract(tag, '(?i)\burl\s*=\s*["'']?([^"''\s>;]+)', 1) END AS link
    FROM tags WHERE regexp_matches(tag, '(?i)^<link\b[^>]*\brel\s*=\s*["'']?[^"''>]*\bcanonical\b')
                 OR regexp_matches(tag, '(?i)^<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?refresh\b')
), links AS (
    SELECT regexp_replace(url, '#.*$', '', 's') AS a,
           regexp_replace(CASE WHEN regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN link
                               WHEN starts_with(link, '//') THEN regexp_extract(url, '^([^:/?#]+:)', 1) || link
                               WHEN starts_with(link, '/') THEN regexp_extract(url, '^([^:/?#]+://[^/?#]*)', 1) || link
                               ELSE regexp_extract(url, '^([^:/?#]+://[^/?#]*(?:[^?#]*/)?)', 1) || link END, '#.*$', '', 's') AS b
    FROM targets WHERE link <> ''
), two_way AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(a, b) AS (SELECT a, b FROM two_way UNION SELECT r.a, l.b FROM reach r JOIN two_way l ON r.b = l.a),
addresses AS (
    SELECT DISTINCT url AS address, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1),
                     'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
           regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
    FROM (SELECT url FROM pages UNION SELECT b FROM reach)
), ruled AS (
    SELECT a.address, a.host, a.path, max_by(r.host || r.start, length(r.host || r.start)) AS rule,
           max_by(r.verdict, length(r.host || r.start)) AS verdict
    FROM addresses a LEFT JOIN rules r ON (a.host = r.host OR ends_with(a.host, '.' || r.host)) AND starts_with(a.path, r.start)
    GROUP BY 1, 2, 3
), spread AS (
    SELECT r.a, CASE WHEN bool_or(x.verdict = 'allow') THEN 'allow' WHEN bool_or(x.verdict = 'block') THEN 'block' END AS verdict
    FROM reach r JOIN ruled x ON x.address = r.b GROUP BY r.a
)
SELECT p.page_id, x.host, x.path, x.rule, coalesce(x.verdict, s.verdict, 'allow') AS verdict
FROM pages p JOIN ruled x ON x.address IS NOT DISTINCT FROM p.url
LEFT JOIN spread s ON s.a = regexp_replace(p.url, '#.*$', '', 's')
"""
