"""Operator 1, URL filters: block decisions spread over redirect-equivalent URLs.

Edges join a URL with where it leads: its normal form (the redirects that servers make: http to https, www. and m.
to the bare host, no fragment, default port, tracking parameters, index page or .html ending), the
target of its page's canonical link or refresh (not in comments, scripts and styles), and logged redirects. URLs of one connected
component are aliases. A rule names a host (with all below it) or a host and leading path segments. If
an alias matches an allow rule, all aliases are allowed; else, if one matches a block rule, all are blocked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import _shared

#: Hosts to block, and the domains below which they are met; www., m., blog. and all else below such a host counts too.
BLOCKED_HOSTS = ["casino-win", "free-bets", "ads-track", "spam-farm", "cheap-pills", "adult-x"]
PARENTS = ["example.com", "example.net", "example.org"]
#: The query's rules: (host or host/path, "block" or "allow"). The German pages of cheap-pills stay.
RULES = [
    *((f"{host}.{parent}", "block") for host in BLOCKED_HOSTS for parent in PARENTS),
    *((f"cheap-pills.{parent}/de", "allow") for parent in PARENTS),
]

# These expressions are also in the DuckDB query, so both engines' dialects must read them alike.
_SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*://"
_TRACKING = r"(^|&)(utm_[a-z]+|ref|fbclid|gclid)=[^&]*"
_HIDDEN = r"(?is)<!--.*?(?:-->|\z)|<script\b.*?(?:</script\s*>|\z)|<style\b.*?(?:</style\s*>|\z)"
_CANONICAL_TAG = r"""(?is)(<link\s[^>]*rel\s*=\s*["']?canonical[^>]*>)"""
_HREF = r"""(?is)\shref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^"'\s>]+))"""
_REFRESH_TAG = r"""(?is)(<meta\s[^>]*http-equiv\s*=\s*["']?refresh[^>]*>)"""
_REFRESH = r"""(?is)\scontent\s*=\s*["']?[^"'>]*?url\s*=\s*["']?([^"'\s>]+)"""
#: Character references that URLs hold, the ampersand's last.
_ENTITIES = [("&(lt|#60|#x3c);", "<"), ("&(gt|#62|#x3e);", ">"), ("&(quot|#34|#x22);", '"'), ("&(apos|#39|#x27);", "'"), ("&(amp|#38|#x26);", "&")]


def _host(url: Column) -> Column:
    raw = F.lower(F.regexp_extract(url, _SCHEME + "([^/?#]*)", 1))
    return F.regexp_replace(F.regexp_replace(raw, "^[^@]*@", ""), ":(80|443)$", "")


def _path(url: Column) -> Column:
    return F.regexp_extract(F.regexp_replace(url, _SCHEME + "[^/?#]*", ""), "(?s)^([^?#]*)", 1)


def with_normal_form(urls: DataFrame, url: str, name: str) -> DataFrame:
    """urls with a column for the URL that the usual redirects lead to; what has no scheme and host stays as it is."""
    u, host, path, query = F.col(url), F.col("_host"), F.col("_path"), F.col("_query")
    parts = urls.withColumns({"_host": _host(u), "_path": _path(u), "_query": F.regexp_extract(u, r"(?s)^[^?#]*[?]([^#]*)", 1)})
    short = parts.withColumns({"_path": F.regexp_replace(F.regexp_replace(path, "(/index)?[.]html?$", ""), "/+$", ""), "_query": F.regexp_replace(F.regexp_replace(query, _TRACKING, ""), "^&", "")})
    whole = F.concat(F.lit("https://"), F.regexp_replace(host, "^(www|m)[.]", ""), path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    return short.withColumn(name, F.when(host == "", u).otherwise(whole)).drop("_host", "_path", "_query")


def _decoded(text: Column) -> Column:
    for pattern, sign in _ENTITIES:
        text = F.regexp_replace(text, "(?i)" + pattern, sign)
    return F.trim(text)


def _without_dots(path: Column) -> Column:
    """A path without its . and .. segments; .. at the root is dropped."""
    parts = F.slice(F.split(path, "/"), F.lit(2), F.size(F.split(path, "/")))  # the path begins with a slash
    up = lambda s: F.slice(s, F.lit(1), F.greatest(F.size(s) - 1, F.lit(0)))
    kept = F.aggregate(parts, F.array().cast("array<string>"), lambda s, x: F.when(x == "..", up(s)).when(x == ".", s).otherwise(F.concat(s, F.array(x))))
    folder = F.element_at(parts, -1).isin(".", "..")  # these name a folder, so the slash stays
    return F.concat(F.lit("/"), F.array_join(kept, "/"), F.when(folder & (F.size(kept) > 0), "/").otherwise(""))


def resolved(target: Column, base: Column) -> Column:
    """target as an absolute URL, seen from base; null if empty, of another scheme than with //, or a mere fragment."""
    rest = F.regexp_extract(target, r"(?s)([?#].*)$", 1)
    own = F.regexp_replace(target, r"(?s)[?#].*$", "")
    folder = F.regexp_replace(_path(base), "[^/]*$", "")
    path = F.when(own.startswith("/"), own).otherwise(F.concat(F.when(folder == "", "/").otherwise(folder), own))
    return (
        F.when((target == "") | target.startswith("#"), None)
        .when(target.rlike(_SCHEME + "."), target)
        .when(target.startswith("//"), F.concat(F.lit("https:"), target))
        .when(target.rlike("^[A-Za-z][A-Za-z0-9+.-]*:") | (_host(base) == ""), None)
        .when(target.startswith("?"), F.concat(F.lit("https://"), _host(base), _path(base), target))
        .otherwise(F.concat(F.lit("https://"), _host(base), _without_dots(path), rest))
    )


def page_edges(pages: DataFrame) -> DataFrame:
    """(a, b): each page's URL and where it leads."""
    url, html, shown = F.col("url"), F.coalesce(F.col("html"), F.lit("")), F.col("_shown")
    # what a browser doesn't read as tags is left out; most pages have neither tag and aren't gone through again
    visible = F.when(html.rlike("(?i)canonical|refresh"), F.regexp_replace(html, _HIDDEN, "")).otherwise("")
    tagged = pages.where("url is not null").select("url", visible.alias("_shown"))
    tagged = tagged.select("url", F.regexp_extract(shown, _CANONICAL_TAG, 1).alias("_link"), F.regexp_extract(shown, _REFRESH_TAG, 1).alias("_meta"))
    canonical = F.concat(*[F.regexp_extract("_link", _HREF, k) for k in (1, 2, 3)])
    led = tagged.select("url", _decoded(canonical).alias("canonical"), _decoded(F.regexp_extract("_meta", _REFRESH, 1)).alias("refresh"))
    plain = with_normal_form(led.select("url"), "url", "b").select(url.alias("a"), "b")
    # few pages have a target, so only these take the work of resolving it
    linked = led.where("canonical <> '' or refresh <> ''").select(url.alias("a"), F.explode(F.array(resolved(F.col("canonical"), url), resolved(F.col("refresh"), url))).alias("b"))
    return plain.union(linked).where("b is not null")


def rule_keys(nodes: DataFrame, labels_most: int, parts_most: int) -> DataFrame:
    """(component, key): what rules can match each node: its host, the hosts above, and the host with leading path segments.

    No longer than rules are: hosts of at most labels_most labels and the node's own, paths of at most parts_most segments.
    """
    host, labels, parts = F.col("host"), F.col("labels"), F.col("parts")
    cut = nodes.select("component", _host(F.col("node")).alias("host"), F.filter(F.split(_path(F.col("node")), "/"), lambda x: x != "").alias("parts")).where("host <> ''")
    cut = cut.withColumn("labels", F.split("host", "[.]")).withColumn("parts", F.slice(parts, 1, max(parts_most, 1)))
    first = F.greatest(F.size(labels) - max(labels_most, 1) + 1, F.lit(1))
    hosts = F.transform(F.sequence(first, F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    paths = F.when((F.size(parts) > 0) & F.lit(parts_most > 0), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.concat(host, F.lit("/"), F.array_join(F.slice(parts, F.lit(1), k), "/")))).otherwise(F.array().cast("array<string>"))
    return cut.select("component", F.explode(F.concat(hosts, paths)).alias("key"))


def decide(pages: DataFrame, rules: DataFrame | None = None, redirects: DataFrame | None = None) -> DataFrame:
    """(page_id, url, component, decision, blocked), one row for each row of pages.

    rules: (rule, action); None: RULES. redirects: further edges (src, dst). component is the least URL
    of the aliases; decision is allow, block or none. Rows without a URL have component null and
    decision none; null rules, redirects and html are passed over; repeated rows get equal rows, URLs
    and pages may be of any length, other columns aren't looked at. Relative targets are resolved against the
    page's URL (a <base> isn't looked at), character references in them decoded. No pages, no rows.
    """
    spark = pages.sparkSession
    if rules is None:
        rules = spark.createDataFrame(RULES, "rule string, action string")
    pages = pages.select("page_id", "url", "html")
    edges = page_edges(pages)
    if redirects is not None:
        more = redirects.select(F.col("src").alias("a"), F.col("dst").alias("b")).where("a is not null and b is not null")
        # a logged URL reaches the aliases of its normal form too
        edges = edges.union(more).union(with_normal_form(more.select("a"), "a", "b"))
    targets = _shared.materialize(edges.distinct(), "url-targets")
    edges = _shared.materialize(targets.union(with_normal_form(targets.select(F.col("b").alias("a")), "a", "b")).distinct(), "url-edges")
    _shared.release(targets)
    linked = _shared.connected_components(edges)
    nodes = edges.select("a").union(edges.select(F.col("b").alias("a"))).distinct().join(linked, F.col("a") == F.col("node"), "left")
    nodes = _shared.materialize(nodes.select(F.col("a").alias("node"), F.coalesce("component", "a").alias("component")), "url-nodes")
    rules = _shared.small(rules.select(F.col("rule").alias("key"), "action").where("key is not null and action in ('allow', 'block')").distinct())
    size = rules.agg(F.max(F.size(F.split(F.substring_index("key", "/", 1), "[.]"))), F.max(F.size(F.split("key", "/")) - 1)).first()
    hits = rule_keys(nodes, size[0] or 1, size[1] or 0).join(rules, "key")
    by = hits.groupBy("component").agg(F.when(F.max(F.col("action") == "allow"), "allow").otherwise("block").alias("decision"))
    named = nodes.join(by, "component", "left").select(F.col("node").alias("url"), "component", F.coalesce("decision", F.lit("none")).alias("decision"))
    out = pages.select("page_id", "url").join(named, "url", "left")
    return out.select("page_id", "url", "component", F.coalesce("decision", F.lit("none")).alias("decision"), (F.coalesce("decision", F.lit("none")) == "block").alias("blocked"))
