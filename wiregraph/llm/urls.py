"""URL filters with redirect equivalence, in DataFrame operations only.

A page's own rule decides first. Pages without a rule take over a block from any url that redirects or canonical
links make equivalent to them (connected components); an explicit allow always holds for the urls it fits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, durable, once
from .components import components

#: (verdict, host, path): a rule fits its host and all subdomains where the path starts with the rule's.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))


def _rest(url: Column) -> Column:
    """What follows the first ://; empty where there is none."""
    return F.coalesce(F.when(F.contains(url, F.lit("://")), F.expr("substring(_u, instr(_u, '://') + 3)")), F.lit(""))


def with_parts(df: DataFrame, url_col: str, host: str = "host", path: str = "path") -> DataFrame:
    """Adds host and path; both are empty where the url is null or has no ://."""
    x = df.withColumn("_u", F.col(url_col)).withColumn("_r", _rest(F.col("_u")))
    x = x.withColumn("_h", F.regexp_extract("_r", r"^[^/?#]*", 0))
    x = x.withColumn(path, F.regexp_extract(F.expr("substring(_r, char_length(_h) + 1)"), r"^[^?#]*", 0))
    return x.withColumn(host, ascii_lower(F.col("_h"))).drop("_u", "_r", "_h")


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls; of equally long ones a block."""
    known = sorted(rules, key=lambda r: (len(r[1] + r[2]), r[0] == "block"))
    given = F.array(*[F.struct(F.lit(v).alias("v"), F.lit(h).alias("h"), F.lit(p).alias("p")) for v, h, p in known])
    last = F.element_at(F.concat(F.array(F.lit(None)), F.filter(given, lambda r: ((host == r["h"]) | host.endswith(F.concat(F.lit("."), r["h"]))) & path.startswith(r["p"]))), -1)
    return F.concat(last["h"], last["p"]), last["v"]


#: Character references that urls are written with, each with what it stands for, the ampersand last.
REFERENCES = ((r"(?i)&(?:quot;?|#0*34;|#x0*22;)", '"'), (r"(?i)&(?:apos;|#0*39;|#x0*27;)", "'"), (r"(?i)&(?:lt;?|#0*60;|#x0*3c;)", "<"), (r"(?i)&(?:gt;?|#0*62;|#x0*3e;)", ">"), (r"(?i)&(?:sol;|#0*47;|#x0*2f;)", "/"), (r"(?i)&(?:colon;|#0*58;|#x0*3a;)", ":"), (r"(?i)&(?:amp;?|#0*38;|#x0*26;)", "&"))
ATTRIBUTE = r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>][^\s>]*)))?"""
TAG = r"""(?is)<(?:link|meta)(?=[\s/])(?:[^>"']++|"[^"]*+"|'[^']*+')*+>"""


def _attribute(name: str) -> Column:
    """The value of the first attribute of that name in the attributes `a` (name, value), as written."""
    return F.coalesce(F.try_element_at(F.filter("a", lambda x: x["n"] == name), F.lit(1))["v"], F.lit(""))


def _node(df: DataFrame, url_col: str, name: str) -> DataFrame:
    """Adds the url as a node: null without scheme and ://, else without fragment, scheme and host in lower case, without
    the scheme's own port, dot segments resolved, and / for an empty path (RFC 3986, 5.2.4 and 6.2)."""
    x = once(df, "_head", F.regexp_extract(url_col, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*", 0))
    x = once(x, "_tail", F.regexp_extract(F.expr(f"substring({url_col}, char_length(_head) + 1)"), r"^[^#]*", 0))
    x = once(x, "_path", F.regexp_extract("_tail", r"^[^?]*", 0))
    x = once(x, "_parts", F.split("_path", "/", -1))
    empty = F.array().cast("array<string>")
    kept = F.aggregate("_parts", empty, lambda done, p: F.when(p == ".", done).when(p == "..", F.when(F.size(done) > 1, F.slice(done, 1, F.size(done) - 1)).otherwise(done)).otherwise(F.concat(done, F.array(p))))
    # a last . or .. stands for the folder itself
    x = once(x, "_kept", F.concat(kept, F.when(F.element_at("_parts", -1).isin(".", ".."), F.array(F.lit(""))).otherwise(empty)))
    clean = F.when(F.col("_path").rlike(r"(^|/)\.\.?(/|$)"), F.array_join("_kept", "/")).otherwise(F.col("_path"))
    x = once(x, "_clean", F.when(F.col("_path") == "", F.lit("/")).otherwise(clean))
    head = F.regexp_replace(F.regexp_replace(F.regexp_replace(ascii_lower(F.col("_head")), r"^(http://.*):80$", "$1"), r"^(https://.*):443$", "$1"), ":$", "")
    full = F.concat(head, "_clean", F.expr("substring(_tail, char_length(_path) + 1)"))
    return x.withColumn(name, F.when(F.col("_head") != "", full)).drop("_head", "_tail", "_path", "_parts", "_kept", "_clean")


def link_targets(pages: DataFrame) -> DataFrame:
    """(url, to): the targets of the canonical links and refresh redirects of pages (url, html), as references still to be resolved.

    Comments, scripts and styles hold no tags. Attributes are read by name, the first of a name counts; character
    references are replaced before a refresh is cut into its time and target, which ends at the end or its closing quote.
    """
    seen = F.regexp_replace("html", r"(?is)<!--.*?(?:-->|\z)|<(script|style)\b.*?(?:</\1\s*>|\z)", " ")
    x = once(pages.where("url is not null and html is not null").select("url", "html"), "seen", seen).drop("html")
    x = x.select("url", F.explode(F.regexp_extract_all("seen", F.lit(TAG), F.lit(0))).alias("tag"))
    x = once(x, "body", F.regexp_replace("tag", r"(?i)^<(?:link|meta)|>$", " "))
    groups = F.arrays_zip(*[F.regexp_extract_all("body", F.lit(ATTRIBUTE), F.lit(i)).alias(k) for i, k in ((1, "n"), (2, "d"), (3, "s"), (4, "u"))])
    x = once(x, "a", F.transform(groups, lambda g: F.struct(ascii_lower(g["n"]).alias("n"), F.concat(g["d"], g["s"], g["u"]).alias("v"))))
    canonical = F.col("tag").rlike("(?i)^<link") & F.array_contains(F.split(F.lower(F.trim(_attribute("rel"))), r"\s+"), "canonical")
    refresh = F.col("tag").rlike("(?i)^<meta") & (F.lower(F.trim(_attribute("http-equiv"))) == "refresh")
    x = once(x, "raw", F.when(canonical, _attribute("href")).when(refresh, F.when(_attribute("content").rlike(r"(?i)url|[;,]\s*\S"), _attribute("content")).otherwise(F.concat(F.lit("0;url="), _attribute("url")))))
    for pattern, stands_for in REFERENCES:
        x = x.withColumn("raw", F.regexp_replace("raw", pattern, stands_for))
    x = once(x.where("raw is not null").select("url", "raw", F.col("tag").rlike("(?i)^<meta").alias("meta")), "value", F.col("raw"))
    cut = r"(?is)^\s*(?:[\d.]+\s*(?:[;,]|\s)\s*|(?=url\s*=))(?:url\s*=\s*)?([\"']?)(.*)$"
    x = once(x, "quote", F.regexp_extract("value", cut, 1))
    x = once(x, "rest", F.regexp_extract("value", cut, 2))
    target = F.when(~F.col("meta"), F.col("value")).when(F.col("quote") == "", F.col("rest")).otherwise(F.regexp_extract("rest", "^[^\"']*", 0))
    return once(x, "to", F.regexp_replace(F.trim(F.regexp_replace(target, r"[\t\r\n]", "")), r"^\s+|\s+$", "")).select("url", "to").where("to != ''")


def links(pages: DataFrame) -> DataFrame:
    """(u, v): edges from a page's url to the targets of its canonical links and refresh redirects.

    Targets are resolved against the page's url (RFC 3986, 5.2): with a scheme at the start they are absolute, else they
    start with //, / or ?, or are relative to the page's folder. Those without a host, and pages without a url, have none.
    """
    # each value once a row: nested expressions would be copied into code too long to compile
    x = once(link_targets(pages), "site", F.regexp_extract("url", r"^[^/?#]*://[^/?#]*", 0))
    x = once(x, "page", F.regexp_extract("url", r"^[^/?#]*://[^/?#]*[^?#]*", 0))
    folder = F.when(F.col("page") == F.col("site"), F.concat("site", F.lit("/"))).otherwise(F.regexp_extract("page", r"^.*/", 0))
    full = F.when(F.col("to").rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), F.col("to")).when(F.col("to").startswith("//"), F.concat(F.regexp_extract("site", r"^[^/]*", 0), "to")).when(F.col("to").startswith("/"), F.concat("site", "to")).when(F.col("to").startswith("?"), F.concat("page", "to")).when(F.col("to").startswith("#"), F.lit(None)).otherwise(F.concat(folder, "to"))
    x = once(x.where("site != ''"), "full", full).select("url", "full")
    return _node(_node(x, "url", "u"), "full", "v").select("u", "v").where("u is not null and v is not null and u != v").distinct()


def blocked_nodes(edges: DataFrame, rules=RULES) -> DataFrame:
    """Nodes whose component holds a url that a rule blocks."""
    member = components(edges)
    judged = durable(with_parts(member, "node"))
    bad = judged.where(rule_of(F.col("host"), F.col("path"), rules)[1] == "block").select("component").distinct()
    return member.join(bad, "component", "left_semi").select(F.col("node").alias("bad_node"))


def judge_pages(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule and verdict of every row of pages (page_id, url, html).

    Repeated rows give repeated results; a null url has empty parts, fits no rule and is allowed. Without a rule or a
    blocked equivalent a page is allowed. Null and empty html has no links; very long pages are read whole; an empty table
    gives no rows; other columns are not read. `<base>` is not read either, so a page's own url is what links start from.
    """
    x = with_parts(pages.select("page_id", "url"), "url")
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    x = _node(x.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("own"), "url"), "url", "node")
    bad = blocked_nodes(links(pages), rules)
    x = x.join(bad, x["node"] == bad["bad_node"], "left")
    return x.select("page_id", "host", "path", "rule", F.coalesce("own", F.when(F.col("bad_node").isNotNull(), "block").otherwise("allow")).alias("verdict"))


#: DuckDB: rules written out; blocks walk over both directions of the edges. Of links it knows plain ones only (absolute or rooted,
#: in double quotes, without dot segments): the tables hold none, and the tests hold `links` against the standard library's parsers.
ORACLE = r"""
with recursive rules(v, h, p) as (values ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
tags as (select url, unnest(regexp_extract_all(html, '(?is)<(?:link|meta)\b[^>]*>')) tag from pages where url is not null and html is not null),
targets as (select url, replace(case when regexp_matches(tag, '(?i)^<link') then regexp_extract(tag, '(?is)\bhref\s*=\s*["'']?\s*([^"''\s>]+)', 1) else regexp_extract(tag, '(?is)\burl\s*=\s*["'']?\s*([^"''\s>;]+)', 1) end, '&amp;', '&') t, regexp_extract(url, '^[^/?#]*://[^/?#]*') site
  from tags where regexp_matches(tag, '(?i)\brel\s*=\s*["'']?\s*canonical\b|http-equiv\s*=\s*["'']?\s*refresh\b')),
pairs as (select url a, case when instr(t, '://') > 0 then t when starts_with(t, '//') then regexp_extract(site, '^[^/]*') || t when starts_with(t, '/') then site || t else regexp_extract(url, '^[^/?#]*://[^/?#]*(?:/[^?#]*/|/)?') || t end b from targets where t != ''),
urls as (select a url from pairs union select b from pairs union select url from pages where url is not null),
heads as (select url, regexp_extract(url, '^[^/?#]*://[^/?#]*') head from urls),
nodes as (select url, translate(head, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') || regexp_extract(substr(url, length(head) + 1), '^[^#]*') node from heads where head != ''),
edges as (select distinct x.node u, y.node v from pairs join nodes x on x.url = a join nodes y on y.url = b where x.node != y.node),
both_ways as (select u, v from edges union select v, u from edges),
parts as (select url, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end r from (select url from urls union select node from nodes)),
hosts as (select url, regexp_extract(r, '^[^/?#]*') h0, r from parts),
judged as (select url, translate(h0, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') host, regexp_extract(substr(r, length(h0) + 1), '^[^?#]*') path from hosts),
own as (select url, arg_max(h || p, length(h || p)) as rule, arg_max(v, length(h || p)) as v from judged join rules on (host = h or ends_with(host, '.' || h)) and starts_with(path, p) group by url),
reached(node) as (select u from both_ways join own on own.url = u and own.v = 'block' union select b.v from reached join both_ways b on b.u = node)
select pages.page_id, coalesce(j.host, '') host, coalesce(j.path, '') path, own.rule, coalesce(own.v, case when nodes.node in (select node from reached) then 'block' else 'allow' end) verdict
from pages left join judged j using (url) left join own using (url) left join nodes using (url)
"""
