"""URL filter with redirect equivalence.

Rules of host and path give explicit verdicts, the longest rule that fits wins.
Redirects, canonical links and spellings of one address make pages aliases;
the connected components of these edges share a block: a page without a rule is
blocked if an alias has an explicit block, a page with a rule keeps its own
verdict, so an explicit allow goes before an inherited block.

A few rules are part of the plan. Many are joined to the distinct hosts, by the
ends of a host that a rule may name, and the rules of a host come back to its
pages, so a page meets only the rules of its own host.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, hot_join
from .components import components

#: Rules that are part of the plan; more are joined by host.
INLINE_RULES = 64

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def rule(text: str, verdict: str) -> Rule:
    """``example.com/en/`` is host ``example.com`` and path ``/en/``."""
    host, slash, path = text.partition("/")
    if verdict not in ("allow", "block") or not host:
        raise ValueError(f"not a rule: {verdict} {text}")
    return Rule(verdict, host.lower(), slash + path)


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def key_of(url: Column) -> Column:
    """One spelling for addresses that differ in scheme, default port, last slashes or fragment; null without a host."""
    host = F.regexp_replace(host_of(url), ":(80|443)$", "")
    query = F.coalesce(F.regexp_extract(url, r"://[^?#]*(\?[^#]*)", 1), F.lit(""))
    return F.when(host != "", F.concat(host, F.regexp_replace(path_of(url), "/+$", ""), query))


_MATCH = "struct<rule:string,verdict:string>"


def _ordered(rules: list[Rule]) -> list[Rule]:
    """The longest first, allow before block for one text."""
    return sorted(rules, key=lambda r: (-len(r.text), r.text, r.verdict))


def _first_fit(fits: Column) -> Column:
    return F.get(F.transform(fits, lambda r: F.struct(r["rule"].alias("rule"), r["verdict"].alias("verdict"))), F.lit(0))


def matching(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The longest rule that fits as ``struct<rule, verdict>``, allow before block for one text; else null. All rules are in the expression."""
    if not rules:
        return F.lit(None).cast(_MATCH)
    table = F.array(*[F.struct(F.lit(r.host).alias("host"), F.lit("." + r.host).alias("under"), F.lit(r.path).alias("path"), F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict")) for r in _ordered(rules)])
    return _first_fit(F.filter(table, lambda r: ((host == r["host"]) | F.endswith(host, r["under"])) & F.startswith(path, r["path"])))


def matched(urls: DataFrame, rules: list[Rule], scratch: Scratch) -> DataFrame:
    """``urls (host, path, ...)`` with ``match``, as :func:`matching` has it."""
    if len(rules) <= INLINE_RULES:
        return urls.withColumn("match", matching(F.col("host"), F.col("path"), rules))
    urls = scratch.written(urls, "urls")
    table = urls.sparkSession.createDataFrame([(k, r.host, r.path, r.text, r.verdict) for k, r in enumerate(_ordered(rules))], "place int, at string, path string, rule string, verdict string")
    hosts = urls.where("host <> ''").groupBy("host").agg(F.count("*").alias("n"))
    names = F.split("host", "[.]", -1)
    ends = F.transform(F.sequence(F.lit(1), F.size(names)), lambda i: F.array_join(F.slice(names, i, F.size(names)), "."))
    fitting = hosts.select("host", "n", F.explode(ends).alias("at")).join(table, "at").groupBy("host", "n").agg(F.array_sort(F.collect_list(F.struct("place", "path", "rule", "verdict"))).alias("rules"))
    found = hot_join(urls, scratch.written(fitting, "rules"), "host", how="left")
    return found.withColumn("match", _first_fit(F.filter("rules", lambda r: F.startswith(F.col("path"), r["path"])))).drop("rules")


def _plain_path(path: Column) -> Column:
    """The path without ``.`` and ``..`` segments."""
    names = F.split(path, "/")
    fold = lambda kept, x: F.when(x == "..", F.slice(kept, 1, F.greatest(F.lit(1), F.size(kept) - 1))).when(x == ".", kept).otherwise(F.concat(kept, F.array(x)))
    kept = F.aggregate(names, F.array().cast("array<string>"), fold)
    end = F.when(F.element_at(names, -1).isin(".", ".."), "/").otherwise("")
    return F.when(path.rlike(r"/\.\.?(/|$)"), F.concat(F.array_join(kept, "/"), end)).otherwise(path)


def _absolute(target: Column, url: Column) -> Column:
    """The target of a link as an absolute URL, resolved against the page's ``url``; null if it is empty, a fragment, or of a scheme without a host."""
    t = F.trim(F.replace(target, F.lit("&amp;"), F.lit("&")))
    scheme, site = F.regexp_extract(url, r"^([^:/?#]*)://", 1), F.regexp_extract(url, r"^([^:/?#]*://[^/?#]*)", 1)
    folder = F.regexp_extract(path_of(url), "^(.*/)", 1)
    full = (
        F.when(t.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), t)
        .when((t == "") | F.startswith(t, F.lit("#")) | t.rlike("^[A-Za-z][A-Za-z0-9+.-]*:") | (site == ""), None)
        .when(F.startswith(t, F.lit("//")), F.concat(scheme, F.lit(":"), t))
        .when(F.startswith(t, F.lit("/")), F.concat(site, t))
        .when(F.startswith(t, F.lit("?")), F.concat(site, path_of(url), t))
        .otherwise(F.concat(site, F.when(folder == "", "/").otherwise(folder), t))
    )
    return F.concat(F.regexp_extract(full, r"^([^:/?#]*://[^/?#]*)", 1), _plain_path(path_of(full)), F.regexp_extract(full, r"^[^?#]*(.*)$", 1))


#: Tags and attributes of links; a rel attribute has any number of tokens in any order.
_COMMENT = r"(?s)<!--.*?(?:-->|\z)"
_LINK, _BASE = r"(?i)<link\b[^>]*>", r"(?i)<base\b[^>]*\bhref\s*=\s*[\"']?([^\"'\s>]+)"
_CANONICAL = r"(?i)[\s\"'/]rel\s*=\s*(?:\"(?:[^\"]*\s)?canonical(?:\s[^\"]*)?\"|'(?:[^']*\s)?canonical(?:\s[^']*)?'|canonical[\s/>])"
_REFRESH = r"(?i)<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>"


def link_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``source, target`` URLs of all canonical links and refresh redirects in the pages.

    Targets are resolved against the page's ``<base href>``, itself resolved
    against the page's url; comments, also one that does not end, have no links.
    """
    page = F.col(html_col)
    html = F.when(F.instr(page, "<!--") > 0, F.regexp_replace(page, _COMMENT, "")).otherwise(page)
    tags = lambda pattern: F.coalesce(F.regexp_extract_all("html", F.lit(pattern), F.lit(0)), F.array().cast("array<string>"))
    links = F.transform(F.filter(tags(_LINK), lambda x: x.rlike(_CANONICAL)), lambda x: F.regexp_extract(x, r"(?i)\bhref\s*=\s*[\"']?([^\"'\s>]+)", 1))
    metas = F.transform(tags(_REFRESH), lambda x: F.regexp_extract(x, r"(?i)\burl\s*=\s*[\"']?([^\"'\s>]+)", 1))
    rows = pages.select(F.col(url_col).alias("source"), html.alias("html")).where("source is not null and html is not null")
    found = rows.select("source", F.regexp_extract("html", _BASE, 1).alias("base"), F.filter(F.concat(links, metas), lambda t: t != "").alias("t")).where("size(t) > 0")
    found = found.select("source", F.coalesce(_absolute(F.col("base"), F.col("source")), "source").alias("base"), F.explode("t").alias("t"))
    return found.select("source", _absolute(F.col("t"), F.col("base")).alias("target")).where("target is not null")


def judge(pages: DataFrame, rules: list[Rule], default: str = "allow", id_col: str = "page_id", url_col: str = "url", html_col: str | None = "html", redirects: DataFrame | None = None) -> DataFrame:
    """``id_col, host, path, rule, verdict, inherited`` for each row.

    ``redirects (source, target)`` adds known redirects to the links found in
    ``html_col``. Targets that are no page themselves still pass on the verdict
    of their rule. ``inherited``: blocked as an alias. A null url has empty host
    and path, no alias and the ``default`` verdict; a null html has no links;
    urls and pages of any length are read whole; repeated rows keep their number;
    an empty table stays empty. Other columns are not read.
    """
    scratch = Scratch(pages.sparkSession)
    named = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"))
    parts = lambda url: (host_of(url).alias("host"), path_of(url).alias("path"), key_of(url).alias("key"))
    own = matched(named.select("id", *parts(F.col("url"))), rules, scratch)
    edges = None
    if html_col is not None:
        edges = link_edges(pages.select(url_col, html_col), url_col, html_col)
    if redirects is not None:
        known = redirects.select(F.col("source").cast("string"), F.col("target").cast("string"))
        edges = known if edges is None else edges.union(known)
    block = lambda df: df.where("match.verdict = 'block' and key is not null").select("key").distinct()
    blocked = block(own)
    if edges is not None:
        edges = scratch.written(edges.select(key_of(F.col("source")).alias("u"), *parts(F.col("target"))), "links")
        linked = scratch.written(components(edges.select("u", F.col("key").alias("v")).where("u <> v"), scratch=scratch), "aliases")
        blocked = scratch.written(blocked.union(block(matched(edges.select("host", "path", "key"), rules, scratch))).distinct(), "blocked")
        groups = blocked.join(linked, F.col("key") == F.col("node")).select("component").distinct()
        groups = groups.join(linked.groupBy("component").agg(F.count("*").alias("n")), "component")
        blocked = blocked.union(hot_join(linked, groups, "component").select(F.col("node").alias("key"))).distinct()
    # Only pages without a rule inherit; of each blocked key how many pages have it.
    open_ = own.where("match is null and key is not null").groupBy("key").agg(F.count("*").alias("n"))
    heirs = scratch.written(blocked.join(open_, "key").withColumn("blocked", F.lit(True)), "heirs")
    out = hot_join(own, heirs, "key", how="left")
    inherited = F.col("match").isNull() & F.coalesce("blocked", F.lit(False))
    judged = out.select(F.col("id").alias(id_col), "host", "path", F.col("match.rule").alias("rule"), F.coalesce("match.verdict", F.when(inherited, "block"), F.lit(default)).alias("verdict"), inherited.alias("inherited"))
    return scratch.result(judged, "judged")
