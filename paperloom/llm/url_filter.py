"""URL filters: block and allow rules, spread over redirect and canonical-link equivalences."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, connected_components

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str


#: Fixed values of the contract.
RULES = (
    Rule("block", "com", "/en/"),
    Rule("allow", "example.com", "/en/7"),
    Rule("allow", "net", "/de/"),
    Rule("block", "example.net", "/de/8"),
    Rule("block", "org", "/es/"),
)


def host_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(url, instr(url, '://') + 3)"))
    return F.translate(F.coalesce(F.regexp_extract(rest, r"^([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(url, instr(url, '://') + 3)"))
    return F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _fits(rule: Rule) -> Column:
    host = F.col("host")
    return ((host == rule.host) | host.endswith(f".{rule.host}")) & F.col("path").startswith(rule.path)


def rule_columns(rules) -> tuple[Column, Column]:
    """(name, verdict) of the longest rule that fits columns host and path; null where none does. The rule list is a short parameter; equal lengths go by its order."""
    ordered = sorted(rules, key=lambda r: -len(r.host + r.path))
    name = F.coalesce(*[F.when(_fits(r), F.lit(r.host + r.path)) for r in ordered], F.lit(None).cast("string"))
    verdict = F.coalesce(*[F.when(_fits(r), F.lit(r.verdict)) for r in ordered], F.lit(None).cast("string"))
    return name, verdict


def _segments(path: Column) -> Column:
    """A path, which begins with a slash, without its segments ``.`` and ``..``; the latter takes the one before it along."""
    parts = F.split(path, "/", -1)

    def step(kept: Column, part: Column) -> Column:
        return F.when(part == ".", kept).when(part == "..", F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0)))).otherwise(F.concat(kept, F.array(part)))

    kept = F.aggregate(F.slice(parts, 2, F.size(parts)), F.array().cast("array<string>"), step)
    tail = F.when(F.element_at(parts, -1).isin(".", ".."), F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
    return F.when(path.contains("/."), F.concat(F.lit("/"), F.array_join(F.concat(kept, tail), "/"))).otherwise(path)


def address(url: Column) -> Column:
    """The url with its scheme and host in lower case, without fragment and dot segments, an empty path being a slash; null where it has no host. Two addresses are one only if they are equal."""
    at = F.instr(url, "://")
    rest = F.regexp_extract(F.expr("substring(url, instr(url, '://') + 3)"), r"^[^/?#]*([^#]*)", 1)
    path, query = F.regexp_extract(rest, r"^([^?]*)", 1), F.regexp_extract(rest, r"^[^?]*(.*)", 1)
    scheme = F.translate(F.substring(url, F.lit(1), at + 2), UPPER, LOWER)
    return F.when(F.coalesce(host_of(url), F.lit("")) != "", F.concat(scheme, host_of(url), F.when(path == "", "/").otherwise(_segments(path)), query))


#: How an attribute may write characters; the ampersand comes last.
ENTITIES = (("&quot;", '"'), ("&#34;", '"'), ("&apos;", "'"), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&#38;", "&"), ("&#x26;", "&"), ("&amp;", "&"))


def _decoded(value: Column) -> Column:
    for written, meant in ENTITIES:
        value = F.replace(value, F.lit(written), F.lit(meant))
    return value


def _resolved(target: Column, url: Column) -> Column:
    """A target as an absolute url, seen from ``url``."""
    site = F.regexp_extract(url, r"^([^/?#]*?://[^/?#]*)", 1)
    base = F.regexp_extract(url, r"^([^?#]*)", 1)
    folder = F.when(base == site, F.concat(site, F.lit("/"))).otherwise(F.regexp_extract(base, r"^(.*/)", 1))
    return (
        F.when(target.contains("://"), target)
        .when(target.startswith("//"), F.concat(F.regexp_extract(url, r"^([^/?#]*?:)//", 1), target))
        .when(target.startswith("/"), F.concat(site, target))
        .when(target.startswith("?"), F.concat(base, target))
        .when(target.startswith("#"), url)
        .otherwise(F.concat(folder, target))
    )


def _tag_target(html: Column, tag: str, attribute: str, word: str, target: str) -> Column:
    """The target in the first such tag of the page; null where there is none."""
    found = F.regexp_extract(html, rf"(?i)<{tag}\b[^>]*\b{attribute}\s*=\s*[\"']?{word}[\"']?[^>]*>", 0)
    return F.nullif(F.regexp_extract(found, target, 1), F.lit(""))


def page_links(pages: DataFrame) -> DataFrame:
    """(url, target) of each page's canonical link and of its immediate redirect, entities decoded, targets made absolute by the page's base or its url."""
    # The tags that matter, by one scan; of most pages nothing is left, and only what is gets looked at closely.
    tags = F.array_join(F.regexp_extract_all("html", F.lit(r"<(?i:link|meta|base)\b[^>]*>"), 0), "")
    pages = checkpoint(pages.where("instr(url, '://') > 0").select("url", tags.alias("html")).where(F.col("html").rlike(r"(?i)canonical|refresh")))
    html = F.col("html")
    href = r"(?i)\bhref\s*=\s*[\"']?([^\"'\s>]+)"
    canonical = F.when(html.rlike("(?i)canonical"), _tag_target(html, "link", "rel", "canonical", href))
    refresh = F.when(html.rlike(r"(?i)http-equiv\s*=\s*[\"']?refresh"), _tag_target(html, "meta", "http-equiv", "refresh", r"(?i)\burl\s*=\s*[\"']?([^\"'\s>]+)"))
    base = F.when(html.rlike(r"(?i)<base\b"), F.nullif(F.regexp_extract(F.regexp_extract(html, r"(?i)<base\b[^>]*>", 0), href, 1), F.lit("")))
    links = pages.select("url", F.explode(F.array(canonical, refresh)).alias("target"), base.alias("base")).where("target is not null")
    seen = links.select("url", F.trim(_decoded(F.col("target"))).alias("target"), F.coalesce(_resolved(F.trim(_decoded(F.col("base"))), F.col("url")), F.col("url")).alias("base"))
    return seen.select("url", _resolved(F.col("target"), F.col("base")).alias("target"))


def judge_urls(pages: DataFrame, rules=RULES, redirects: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str | None = "html") -> DataFrame:
    """Judge every url by the longest fitting rule, else by what is known of the addresses that it is equivalent to.

    Vertices are addresses: whole urls without their fragment and dot segments. Edges are canonical links and immediate redirects found in the pages and, if
    given, ``redirects(source, target)``; they alone make addresses equivalent. In each component, an allow rule on any member (by its address) wins over block
    rules on others: a member without a rule is allowed if any member is explicitly allowed, else blocked
    if any is blocked, else allowed. A member's own rule always stands. A target that is no page itself is a member like any other.

    Only addresses that have a link enter the component rounds; all others are components of
    their own, and their own rule decides. Decisions are partially aggregated by root, and AQE may split a hot root or url where they are joined back.

    Null urls and urls without ``://`` have an empty host and path, match no rule and are allowed. Repeated rows are
    judged each; null pages have no links; an empty table gives an empty result; other columns are ignored.
    """
    own = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), (F.col(html_col) if html_col else F.lit(None).cast("string")).alias("html"))
    name, verdict = rule_columns(rules)
    url = F.col("url")

    links = page_links(own)
    if redirects is not None:
        links = links.unionByName(redirects.select(F.col("source").alias("url"), "target"))
    ends = links.select(address(url).alias("u"), F.col("target").alias("url")).select("u", address(url).alias("v"))
    roots = connected_components(ends)

    members = roots.select("root", F.col("node").alias("key"), F.col("node").alias("url"))
    members = members.withColumns({"host": host_of(url), "path": path_of(url)}).select("root", "key", verdict.alias("by_rule"))
    known = members.groupBy("root").agg(F.max(F.col("by_rule") == "allow").alias("allowed"), F.max(F.col("by_rule") == "block").alias("blocked"))
    spread = F.when(F.col("allowed"), "allow").when(F.col("blocked"), "block").otherwise("allow")
    known = members.join(known, "root").select("key", "root", spread.alias("spread"))

    judged = own.withColumns({"host": host_of(url), "path": path_of(url), "key": address(url)}).select("page_id", "host", "path", "key", name.alias("rule"), verdict.alias("by_rule"))
    judged = judged.join(known, "key", "left")
    return judged.select("page_id", "host", "path", "rule", F.coalesce("by_rule", "spread", F.lit("allow")).alias("verdict"), F.coalesce("root", "key").alias("component"))


_RULES = ", ".join(f"('{r.verdict}', '{r.host}', '{r.path}', {len(r.host + r.path)})" for r in RULES)

_ENTITIES = "{}"
for _written, _meant in ENTITIES:
    _ENTITIES = f"replace({_ENTITIES}, '{_written}', '{_meant.replace(chr(39), chr(39) * 2)}')"
_HREF = r"""'(?i)\bhref\s*=\s*["'']?([^"''\s>]+)'"""


def _absolute(target: str, url: str) -> str:
    site, base = f"regexp_extract({url}, '^([^/?#]*?://[^/?#]*)', 1)", f"regexp_extract({url}, '^([^?#]*)', 1)"
    return f"""case when strpos({target}, '://') > 0 then {target} when starts_with({target}, '//') then regexp_extract({url}, '^([^/?#]*?:)//', 1) || {target}
      when starts_with({target}, '/') then {site} || {target} when starts_with({target}, '?') then {base} || {target} when starts_with({target}, '#') then {url}
      when {target} is null then null else case when {base} = {site} then {site} || '/' else regexp_extract({base}, '^(.*/)', 1) end || {target} end"""


#: DuckDB. Links of pages are followed to their closure; the least member names the component. Targets that are no pages are judged by their own host and path.
ORACLE_SQL = rf"""
with recursive tags as (
  select url, html, regexp_extract(regexp_extract(html, '(?i)<link\b[^>]*\brel\s*=\s*["'']?canonical["'']?[^>]*>', 0), {_HREF}, 1) as target from pages
  union all
  select url, html, regexp_extract(regexp_extract(html, '(?i)<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?refresh["'']?[^>]*>', 0), '(?i)\burl\s*=\s*["'']?([^"''\s>]+)', 1) from pages),
decoded as (
  select url, trim({_ENTITIES.format("target")}) as target, trim({_ENTITIES.format(f"nullif(regexp_extract(regexp_extract(html, '(?i)<base{chr(92)}b[^>]*>', 0), {_HREF}, 1), '')")}) as base
  from tags where target <> '' and strpos(url, '://') > 0),
based as (select url, target, coalesce({_absolute("base", "url")}, url) as base from decoded),
links as (select url, {_absolute("target", "base")} as target from based),
urls as (select url from pages union select url from links union select target from links),
parts as (
  select url, case when strpos(url, '://') > 0 then substring(url, strpos(url, '://') + 3) else '' end as rest, substring(url, 1, strpos(url, '://') + 2) as scheme from urls where url is not null),
split as (
  select url, translate(scheme, '{UPPER}', '{LOWER}') as scheme, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') as host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path, regexp_extract(rest, '^[^/?#]*[^?#]*([^#]*)', 1) as query from parts),
walked as (
  select *, string_split(path, '/') as segments, list_reduce(list_prepend([]::varchar[], list_transform(string_split(path, '/')[2:], lambda s: [s])),
    lambda kept, s: case when s[1] = '.' then kept when s[1] = '..' then kept[1:greatest(len(kept) - 1, 0)] else kept || s end) as kept from split),
tidied as (
  select url, scheme, host, path, query, case when path = '' then '/' when not contains(path, '/.') then path
    else '/' || array_to_string(kept || case when segments[-1] in ('.', '..') then [''] else []::varchar[] end, '/') end as bare from walked),
rules(verdict, rhost, rpath, size) as (values {_RULES}),
judged as (
  select url, case when host <> '' then scheme || host || bare || query end as key, host, path, bare, arg_max(rhost || rpath, size) as rule, arg_max(verdict, size) as by_rule
  from tidied left join rules on (host = rhost or ends_with(host, '.' || rhost)) and starts_with(path, rpath) group by all),
edges as (select u.key as u, v.key as v from links join judged u on u.url = links.url join judged v on v.url = links.target where u.key <> v.key),
both_ways as (select u, v from edges union select v, u from edges),
reach(a, b) as (select u, u from both_ways union select r.a, e.v from reach r join both_ways e on r.b = e.u),
roots as (select a as key, min(b) as root from reach group by a),
nodes as (select key, arg_max(verdict, size) as by_rule from (select distinct key, host, bare from judged) left join rules on (host = rhost or ends_with(host, '.' || rhost)) and starts_with(bare, rpath) group by key),
known as (select root, bool_or(by_rule = 'allow') as allowed, bool_or(by_rule = 'block') as blocked from roots join nodes using (key) group by root)
select p.page_id, coalesce(j.host, '') as host, coalesce(j.path, '') as path, j.rule,
       coalesce(j.by_rule, case when allowed then 'allow' when blocked then 'block' else 'allow' end) as verdict, coalesce(r.root, j.key) as component
from pages p left join judged j on j.url = p.url left join roots r on r.key = j.key left join known on known.root = r.root
"""
