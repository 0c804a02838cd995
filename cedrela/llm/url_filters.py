"""URL filters with redirect equivalence."""

from __future__ import annotations

import html
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .common import components, pick, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Fixed rules of the query: host and path in one string, verdict.
RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]

COMMENT = r"(?s)<!--.*?(?:-->|\z)"
LINK, META, BASE = (rf"(?is)<{tag}\b[^>]*>" for tag in ("link", "meta", "base"))
TARGET = r"""(?is)\burl\s*=\s*["']?\s*([^"'\s>]+)"""


def attribute(tag: Column, name: str) -> Column:
    """The value of a tag's attribute as it is written, without what quotes it; empty if it isn't there."""
    found = lambda value: F.regexp_extract(tag, rf"""(?is)[\s"'/]{name}\s*=\s*{value}""", 1)
    one, two, bare = found('"([^"]*)"'), found("'([^']*)'"), found(r"""([^"'\s>]+)""")
    return F.trim(F.when(one != "", one).when(two != "", two).otherwise(bare))


@F.pandas_udf(StringType())
def unescaped(values: pd.Series) -> pd.Series:
    """Character references decoded, as in attributes of HTML."""
    return values.map(html.unescape, na_action="ignore")


def host_of(url: Column) -> Column:
    """What stands after the first `://` up to `/`, `?`, `#` or the end, A-Z in lower case; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to `?`, `#` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The longest rule (text, verdict) that fits, as a struct, or null. The rules are an argument, so a short list."""
    fits = []
    for text, verdict in sorted(rules, key=lambda r: -len(r[0])):
        at, _, rest = text.partition("/")
        here = ((host == at) | host.endswith(f".{at}")) & path.startswith(f"/{rest}")
        fits.append(F.when(here, F.struct(F.lit(text).alias("rule"), F.lit(verdict).alias("verdict"))))
    return F.coalesce(*fits) if fits else F.lit(None).cast("struct<rule:string,verdict:string>")


def key_of(url: Column) -> Column:
    """A url as a node: without its fragment."""
    return F.regexp_replace(url, r"(?s)#.*$", "")


def node_of(url: Column) -> Column:
    """What makes urls the same page: scheme and host in any case, no default port, no fragment, an empty path like `/`."""
    site = F.translate(F.regexp_extract(url, r"(?s)^(.*?://[^/?#]*)", 1), UPPER, LOWER)
    site = F.regexp_replace(site, r"^(?:(http://.*):80|(https://.*):443)$", "$1$2")
    rest = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^#]*)", 1)
    return F.when(url.contains("://"), F.concat(site, F.when(rest.startswith("/"), rest).otherwise(F.concat(F.lit("/"), rest)))).otherwise(key_of(url))


def without_dots(path: Column) -> Column:
    """A path that begins with `/`, its segments `.` and `..` worked off."""
    parts = F.split(path, "/")
    dots = lambda x: x.isin(".", "..")
    step = lambda held, x: F.when(x == ".", held).when(x == "..", F.slice(held, F.lit(1), F.greatest(F.size(held) - 1, F.lit(0)))).otherwise(F.concat(held, F.array(x)))
    kept = F.aggregate(F.slice(parts, F.lit(2), F.size(parts)), F.array().cast("array<string>"), step)
    end = F.when(dots(F.element_at(parts, -1)), F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
    return F.concat(F.lit("/"), F.array_join(F.concat(kept, end), "/"))


def resolved(base: Column, target: Column) -> Column:
    """The url that `target` is on a page with the url `base`; null for what has another form (`mailto:`) or is empty."""
    scheme = F.regexp_extract(base, r"(?s)^(.*?)://", 1)
    site = F.regexp_extract(base, r"(?s)^(.*?://[^/?#]*)", 1)
    own, rest = F.regexp_extract(target, r"(?s)^([^?#]*)", 1), F.regexp_extract(target, r"(?s)^[^?#]*(.*)$", 1)
    folder = F.concat(F.lit("/"), F.regexp_extract(path_of(base), r"(?s)^/(.*/)", 1))
    return (
        F.when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), target)
        .when(target.rlike(r"^(?:[A-Za-z][A-Za-z0-9+.-]*:|#|$)"), F.lit(None))
        .when(target.startswith("//"), F.concat(scheme, F.lit(":"), target))
        .when(target.startswith("?"), F.concat(site, path_of(base), target))
        .when(target.startswith("/"), F.concat(site, without_dots(own), rest))
        .otherwise(F.concat(site, without_dots(F.concat(folder, own)), rest))
    )


def page_links(pages: DataFrame) -> DataFrame:
    """Edges a, b from each page's canonical links and refresh redirects, resolved against its url or its first `<base>`.

    Comments aren't read. A link is canonical if that is one of its `rel` words, in any case; character references in
    attributes are decoded; every link and redirect of a page counts.
    """
    at = pick(pages, "url", "html").where("url LIKE '%://%' AND html IS NOT NULL AND (html ILIKE '%canonical%' OR html ILIKE '%refresh%')")
    at = at.withColumn("html", F.regexp_replace("html", COMMENT, ""))
    tags = lambda tag: F.regexp_extract_all("html", F.lit(tag), F.lit(0))
    links = F.filter(tags(LINK), lambda x: F.array_contains(F.split(F.lower(attribute(x, "rel")), r"\s+"), "canonical"))
    turns = F.filter(tags(META), lambda x: F.lower(attribute(x, "http-equiv")) == "refresh")
    targets = F.concat(F.transform(links, lambda x: attribute(x, "href")), F.transform(turns, lambda x: F.regexp_extract(x, TARGET, 1)))
    to = at.select("url", attribute(F.coalesce(F.try_element_at(tags(BASE), F.lit(1)), F.lit("")), "href").alias("base"), F.explode(targets).alias("target"))
    to = to.withColumns({"base": unescaped("base"), "target": unescaped("target")})
    base = F.coalesce(resolved(F.col("url"), F.col("base")), F.col("url"))
    return to.select(key_of(F.col("url")).alias("a"), key_of(resolved(base, F.col("target"))).alias("b")).where("b IS NOT NULL")


def filter_urls(pages: DataFrame, links: DataFrame, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """page_id, host, path, rule, verdict of every page.

    links (a, b: urls): redirect and canonical edges. Distributed connected components over them give the aliases of a url,
    urls being the same page as node_of() says. A page with a rule of its own has that rule's verdict. Another page is allowed if an alias has an
    explicit allow, else blocked if an alias has a block, else allowed. Aliases count whether or not they are pages.

    Cases: a null url, or one without `://`, has empty host and path, no rule and no alias, and is allowed. Repeated rows
    are all returned. Other columns of the input are ignored. An empty table gives an empty result. The pages are never
    shuffled when there are no links; else they join the decided aliases by url, which Spark splits when it is skewed.
    """
    own = pick(pages, "page_id", "url").withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    own = own.withColumn("own", rule_of(F.col("host"), F.col("path"), rules))
    found = components(links.select(node_of(F.col("a")).alias("a"), node_of(F.col("b")).alias("b")))
    judged = found.withColumn("own", rule_of(host_of(F.col("node")), path_of(F.col("node")), rules))
    decided = (
        judged.groupBy("component")
        .agg(F.max(F.col("own.verdict") == "allow").alias("allowed"), F.max(F.col("own.verdict") == "block").alias("blocked"))
        .where("blocked AND NOT coalesce(allowed, false)")
    )
    blocked = found.join(decided, "component").select(F.col("node").alias("key"), F.lit(True).alias("alias_blocked"))
    spread = F.concat(F.lit("#"), F.coalesce(F.col("page_id").cast("string"), F.lit("")))  # no node has a `#`: urls without a key meet nowhere
    out = own.withColumn("key", F.coalesce(node_of(F.col("url")), spread)).join(blocked, "key", "left")
    verdict = F.coalesce(F.col("own.verdict"), F.when(F.col("alias_blocked"), "block"), F.lit("allow"))
    return out.select("page_id", "host", "path", F.col("own.rule").alias("rule"), verdict.alias("verdict"))


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return filter_urls(pages, page_links(pages), RULES)


#: Of targets that aren't absolute, only those from the host's root and without dots; of references, the five named ones.
OP9_SQL = r"""
WITH RECURSIVE own AS (
  SELECT page_id, url, regexp_replace(html, '(?s)<!--.*?(?:-->|\z)', '', 'g') AS html,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
), tag AS (
  SELECT url, 'rel' AS kind, unnest(regexp_extract_all(html, '(?is)<link\b[^>]*>')) AS tag FROM own WHERE url LIKE '%://%'
  UNION ALL SELECT url, 'http-equiv', unnest(regexp_extract_all(html, '(?is)<meta\b[^>]*>')) FROM own WHERE url LIKE '%://%'
), said AS (
  SELECT url, tag, kind, lower(trim(CASE kind
    WHEN 'rel' THEN regexp_extract(tag, '(?is)[\s"''/]rel\s*=\s*("[^"]*"|''[^'']*''|[^"''\s>]+)', 1)
    ELSE regexp_extract(tag, '(?is)[\s"''/]http-equiv\s*=\s*("[^"]*"|''[^'']*''|[^"''\s>]+)', 1) END, '"'' ')) AS value FROM tag
), target AS (
  SELECT url, replace(replace(replace(replace(replace(CASE kind
      WHEN 'rel' THEN trim(regexp_extract(tag, '(?is)[\s"''/]href\s*=\s*("[^"]*"|''[^'']*''|[^"''\s>]+)', 1), '"'' ')
      ELSE regexp_extract(tag, '(?is)\burl\s*=\s*["'']?\s*([^"''\s>]+)', 1) END,
    '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&apos;', ''''), '&amp;', '&') AS b
  FROM said WHERE kind = 'rel' AND list_contains(regexp_split_to_array(value, '\s+'), 'canonical') OR kind = 'http-equiv' AND value = 'refresh'
), end_of AS (
  SELECT url AS a, CASE WHEN b LIKE '%://%' THEN b WHEN b LIKE '//%' THEN regexp_extract(url, '(?s)^(.*?:)//', 1) || b
    WHEN b LIKE '/%' THEN regexp_extract(url, '(?s)^(.*?://[^/?#]*)', 1) || b END AS b FROM target
), spelled AS (
  SELECT url, regexp_replace(translate(regexp_extract(url, '(?s)^(.*?://[^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '^(?:(http://.*):80|(https://.*):443)$', '\1\2') AS site,
    regexp_extract(url, '(?s)^.*?://[^/?#]*([^#]*)', 1) AS rest
  FROM (SELECT a AS url FROM end_of UNION SELECT b FROM end_of UNION SELECT url FROM own) WHERE url LIKE '%://%'
), same AS (SELECT url, site || CASE WHEN rest LIKE '/%' THEN rest ELSE '/' || rest END AS node FROM spelled
), link AS (SELECT x.node AS a, y.node AS b FROM end_of e JOIN same x ON x.url = e.a JOIN same y ON y.url = e.b
), edge AS (SELECT a, b FROM link UNION SELECT b, a FROM link
), reach AS (SELECT a AS node, b AS other FROM edge UNION SELECT r.node, e.b FROM reach r JOIN edge e ON r.other = e.a
), url_of AS (SELECT DISTINCT other AS url FROM reach
), node AS (
  SELECT url, translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM url_of
), rule(rule, rhost, rpath, rverdict) AS (VALUES
  ('net/', 'net', '/', 'block'), ('example.net/en/', 'example.net', '/en/', 'allow'),
  ('example.com/de/', 'example.com', '/de/', 'block'), ('org/fr/', 'org', '/fr/', 'allow')
), judged AS (
  SELECT n.url, (SELECT arg_max(r.rverdict, length(r.rule)) FROM rule r
    WHERE (n.host = r.rhost OR ends_with(n.host, '.' || r.rhost)) AND starts_with(n.path, r.rpath)) AS verdict FROM node n
), alias AS (
  SELECT r.node, bool_or(coalesce(j.verdict = 'allow', false)) AS allowed, bool_or(coalesce(j.verdict = 'block', false)) AS blocked
  FROM reach r JOIN judged j ON j.url = r.other GROUP BY r.node
), ruled AS (
  SELECT o.*, (SELECT arg_max(r.rule, length(r.rule)) FROM rule r
    WHERE (o.host = r.rhost OR ends_with(o.host, '.' || r.rhost)) AND starts_with(o.path, r.rpath)) AS rule FROM own o
)
SELECT d.page_id, d.host, d.path, d.rule,
  CASE WHEN r.rverdict IS NOT NULL THEN r.rverdict WHEN a.blocked AND NOT a.allowed THEN 'block' ELSE 'allow' END AS verdict
FROM ruled d LEFT JOIN rule r ON r.rule = d.rule LEFT JOIN same ON same.url = d.url LEFT JOIN alias a ON a.node = same.node
"""
