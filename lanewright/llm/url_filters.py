"""URL filters with redirect equivalence, in DataFrame functions only.

Rules (host, path prefix, verdict) decide the urls they fit.  Urls are aliases of each other if
they have one canonical form (scheme, fragment, tracking parameters, a last slash and the
letter case of the host do not matter) or are joined by canonical links or meta-refresh
redirects of the pages, transitively.  A url that no rule fits is allowed if a rule allows one of
its aliases (explicit allow precedence), else blocked if a rule blocks one, else allowed.

Cases: a null url or one without ``://`` has empty host and path, no rule and no alias, and is
allowed; null html has no links; relative targets are resolved against the host if they begin
with a slash and ignored otherwise; repeated pages get equal rows; no pages give no rows;
extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, require_columns
from .components import connected_components

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TRACKING = r"(utm_[^=&]*|ref|fbclid|gclid)(=[^&]*)?(&|$)"
LINK = r"(?i)<link\s[^>]*\brel\s*=\s*[\x22\x27]?canonical\b[^>]*>"
REFRESH = r"(?i)<meta\s[^>]*http-equiv\s*=\s*[\x22\x27]?refresh\b[^>]*>"
HREF = r"(?i)\shref\s*=\s*[\x22\x27]?([^\x22\x27\s>]+)"
TARGET = r"(?i)url\s*=\s*[\x22\x27]?([^\x22\x27\s>]+)"
#: The rules of the registered query: fixed values.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))


def _rest(url: Column) -> Column:
    return F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(_rest(url), F.lit("")), r"^([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(_rest(url), F.lit("")), r"^[^/?#]*([^?#]*)", 1)


def canonical_form(url: Column) -> Column:
    """Null for what is not a url."""
    query = F.regexp_extract(_rest(url), r"^[^?#]*\?([^#]*)", 1)
    query = F.regexp_replace(F.regexp_replace(query, r"(?<![^&])" + TRACKING, ""), r"&$", "")
    key = F.concat(host_of(url), F.regexp_replace(path_of(url), r"/+$", ""), F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    return F.when(F.instr(url, "://") > 0, key)


def matching_rule(host: Column, path: Column, rules: tuple[tuple[str, str], ...]) -> Column:
    """struct(verdict, rule) of the longest rule that fits, else null; of equally long ones the first."""
    out = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, rule in sorted(reversed(rules), key=lambda r: len(r[1])):
        h, p = rule.split("/", 1)
        fits = ((host == h) | host.endswith("." + h)) & path.startswith("/" + p)
        out = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))).otherwise(out)
    return out


def alias_targets(url: Column, html: Column) -> Column:
    """Canonical forms of the targets of a page's canonical links and refreshes."""
    raw = F.concat(
        F.transform(F.regexp_extract_all(html, F.lit(LINK), F.lit(0)), lambda x: F.regexp_extract(x, HREF, 1)),
        F.transform(F.regexp_extract_all(html, F.lit(REFRESH), F.lit(0)), lambda x: F.regexp_extract(x, TARGET, 1)),
    )
    full = lambda x: F.when(F.instr(x, "://") > 0, x).when(x.startswith("//"), F.concat(F.lit("http:"), x)).when(x.startswith("/"), F.concat(F.lit("http://"), host_of(url), x))
    return F.when(html.rlike(r"(?i)<(link|meta)\s[^>]*(canonical|refresh)"), F.array_distinct(F.filter(F.transform(raw, lambda x: canonical_form(full(x))), lambda x: x.isNotNull())))


def judge_urls(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES) -> DataFrame:
    """pages -> page_id, host, path, rule, verdict."""
    require_columns(pages, ["page_id", "url", "html"])
    url = F.col("url")
    seen = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"), canonical_form(url).alias("key"), alias_targets(url, F.col("html")).alias("targets"))
    seen = seen.withColumn("r", matching_rule(F.col("host"), F.col("path"), rules))
    seen = materialize(seen.select("page_id", "host", "path", "key", "targets", F.col("r.rule").alias("rule"), F.col("r.verdict").alias("own")), "urls")
    links = seen.where("key IS NOT NULL AND size(targets) > 0").select(F.col("key").alias("a"), F.explode("targets").alias("b"))
    groups = connected_components(links).withColumnRenamed("node", "key")
    named = seen.drop("targets").join(groups, "key", "left").withColumn("alias", F.coalesce("component", "key"))
    decided = named.where("own IS NOT NULL").groupBy("alias").agg(F.bool_or(F.col("own") == "allow").alias("allowed"), F.bool_or(F.col("own") == "block").alias("blocked"))
    by_alias = F.when(~F.coalesce("allowed", F.lit(False)) & F.coalesce("blocked", F.lit(False)), "block").otherwise("allow")
    out = named.where("own IS NULL").join(decided, "alias", "left").select("page_id", "host", "path", "rule", by_alias.alias("verdict"))
    return out.unionByName(named.where("own IS NOT NULL").select("page_id", "host", "path", "rule", F.col("own").alias("verdict")))


def oracle_sql(rules: tuple[tuple[str, str], ...] = RULES) -> str:
    """The same in SQL; aliases by a recursive table over the pages' links."""
    rest = lambda u: f"CASE WHEN position('://' IN {u}) > 0 THEN substr({u}, position('://' IN {u}) + 3) ELSE '' END"
    host = lambda u: f"translate(regexp_extract(coalesce({rest(u)}, ''), '^([^/?#]*)', 1), '{UPPER}', '{LOWER}')"
    path = lambda u: f"regexp_extract(coalesce({rest(u)}, ''), '^[^/?#]*([^?#]*)', 1)"
    query = lambda u: f"array_to_string(list_filter(string_split(regexp_extract({rest(u)}, '^[^?#]*\\?([^#]*)', 1), '&'), lambda q: NOT regexp_full_match(q, '(utm_[^=&]*|ref|fbclid|gclid)(=[^&]*)?')), '&')"
    key = lambda u: f"CASE WHEN position('://' IN {u}) > 0 THEN {host(u)} || regexp_replace({path(u)}, '/+$', '') || CASE WHEN {query(u)} <> '' THEN '?' || {query(u)} ELSE '' END END"
    fit = "".join(f" WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '/{p}') THEN '{v} {h}/{p}'" for v, (h, p) in sorted(((v, r.split("/", 1)) for v, r in rules), key=lambda x: -len("/".join(x[1]))))
    full = "CASE WHEN position('://' IN t) > 0 THEN t WHEN starts_with(t, '//') THEN 'http:' || t WHEN starts_with(t, '/') THEN 'http://' || host || t END"
    return f"""
WITH RECURSIVE s AS (SELECT page_id, {host('url')} AS host, {path('url')} AS path, {key('url')} AS key, html FROM pages),
r AS (SELECT *, CASE{fit} END AS hit FROM s),
raw AS (SELECT host, key, regexp_extract(unnest(regexp_extract_all(html, '{LINK}')), '{HREF}', 1) AS t FROM r WHERE key IS NOT NULL
  UNION ALL SELECT host, key, regexp_extract(unnest(regexp_extract_all(html, '{REFRESH}')), '{TARGET}', 1) AS t FROM r WHERE key IS NOT NULL),
link AS (SELECT key AS a, {key('u')} AS b FROM (SELECT key, {full} AS u FROM raw)),
both_ways AS (SELECT DISTINCT a, b FROM (SELECT a, b FROM link UNION ALL SELECT b, a FROM link) WHERE a <> b),
reach AS (SELECT DISTINCT a AS node, a AS other FROM both_ways UNION SELECT r.node, e.b FROM reach r JOIN both_ways e ON r.other = e.a),
root AS (SELECT node, min(other) AS component FROM reach GROUP BY node),
n AS (SELECT r.*, coalesce(component, key) AS alias FROM r LEFT JOIN root ON node = key),
d AS (SELECT alias, bool_or(hit LIKE 'allow %') AS allowed, bool_or(hit LIKE 'block %') AS blocked FROM n WHERE hit IS NOT NULL GROUP BY alias)
SELECT page_id, host, path, substr(hit, 7) AS rule,
  CASE WHEN hit IS NOT NULL THEN hit[:5] WHEN NOT coalesce(allowed, false) AND coalesce(blocked, false) THEN 'block' ELSE 'allow' END AS verdict
FROM n LEFT JOIN d USING (alias)
"""
