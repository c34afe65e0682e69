"""The ten operators as queries over the shared tables, with DuckDB's SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import _shared, language_id, mixing, packing, quality, simhash_fingerprints, simhash_neardup, topk_search, toxicity, url_filters, warc_zstd


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.decide(_table(spark, sf_dir, "pages"))


def op2_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.search(_table(spark, sf_dir, "embeddings"))


def op2_topk_search_every_50th(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.search(_table(spark, sf_dir, "embeddings"), every=50)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return language_id.identify(docs, language_id.fit(docs))


def op4_warc_zstd(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _shared.new_path(spark, "warc")
    warc_zstd.write(_table(spark, sf_dir, "pages"), path)
    return warc_zstd.pages_of(warc_zstd.read(spark, path))


def op5_simhash_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_fingerprints.search(_table(spark, sf_dir, "documents"), simhash_fingerprints.COPY_RADIUS)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity.grades(docs, toxicity.fit(docs, _table(spark, sf_dir, "labels")))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op8_simhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_neardup.near_duplicates(_table(spark, sf_dir, "documents"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.ranked(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.sample(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_url_filters, op2_topk_search, op2_topk_search_every_50th, op3_language_id, op4_warc_zstd, op5_simhash_fingerprints, op6_toxicity, op7_best_fit_packing, op8_simhash_neardup, op9_quality_classifier, op10_mixing_sources)
}


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _sql_host(u: str) -> str:
    raw = f"lower(regexp_extract({u}, {_quoted(url_filters._SCHEME + '([^/?#]*)')}, 1))"
    return f"regexp_replace(regexp_replace({raw}, '^[^@]*@', ''), ':(80|443)$', '')"


def _sql_path(u: str) -> str:
    return f"regexp_extract(regexp_replace({u}, {_quoted(url_filters._SCHEME + '[^/?#]*')}, ''), '(?s)^([^?#]*)', 1)"


def _sql_normal(u: str) -> str:
    query = f"regexp_replace(regexp_replace(regexp_extract({u}, '(?s)^[^?#]*[?]([^#]*)', 1), {_quoted(url_filters._TRACKING)}, '', 'g'), '^&', '')"
    path = f"regexp_replace(regexp_replace({_sql_path(u)}, '(/index)?[.]html?$', ''), '/+$', '')"
    return f"CASE WHEN {_sql_host(u)} = '' THEN {u} ELSE 'https://' || regexp_replace({_sql_host(u)}, '^(www|m)[.]', '') || {path} || CASE WHEN {query} <> '' THEN '?' || {query} ELSE '' END END"


def _sql_decoded(t: str) -> str:
    for pattern, sign in url_filters._ENTITIES:
        t = f"regexp_replace({t}, '(?i){pattern}', {_quoted(sign)}, 'g')"
    return f"trim({t})"


def _sql_without_dots(path: str) -> str:
    """Segments as lists of one, folded into one list."""
    parts = f"string_split({path}, '/')[2:]"
    kept = f"list_reduce(list_prepend(CAST([] AS VARCHAR[]), list_transform({parts}, lambda x: [x])), lambda s, x: CASE x[1] WHEN '..' THEN s[:greatest(len(s) - 1, 0)] WHEN '.' THEN s ELSE list_concat(s, x) END)"
    return f"'/' || array_to_string({kept}, '/') || CASE WHEN {parts}[-1] IN ('.', '..') AND len({kept}) > 0 THEN '/' ELSE '' END"


def _sql_resolved(t: str) -> str:
    host, folder = _sql_host("url"), f"regexp_replace({_sql_path('url')}, '[^/]*$', '')"
    own, rest = f"regexp_replace({t}, '(?s)[?#].*$', '')", f"regexp_extract({t}, '(?s)([?#].*)$', 1)"
    path = f"CASE WHEN starts_with({own}, '/') THEN {own} ELSE (CASE WHEN {folder} = '' THEN '/' ELSE {folder} END) || {own} END"
    return (
        f"CASE WHEN {t} = '' OR starts_with({t}, '#') THEN NULL WHEN regexp_matches({t}, {_quoted(url_filters._SCHEME + '.')}) THEN {t} WHEN starts_with({t}, '//') THEN 'https:' || {t} "
        f"WHEN regexp_matches({t}, '^[A-Za-z][A-Za-z0-9+.-]*:') OR {host} = '' THEN NULL WHEN starts_with({t}, '?') THEN 'https://' || {host} || {_sql_path('url')} || {t} "
        f"ELSE 'https://' || {host} || {_sql_without_dots(path)} || {rest} END"
    )


_OP1 = f"""
WITH RECURSIVE p AS (SELECT url, regexp_replace(coalesce(html, ''), {_quoted(url_filters._HIDDEN)}, '', 'g') AS html FROM pages WHERE url IS NOT NULL),
tags AS (SELECT url, regexp_extract(html, {_quoted(url_filters._CANONICAL_TAG)}, 1) AS link, regexp_extract(html, {_quoted(url_filters._REFRESH_TAG)}, 1) AS meta FROM p),
t AS (SELECT url, {_sql_decoded(" || ".join(f"regexp_extract(link, {_quoted(url_filters._HREF)}, {k})" for k in (1, 2, 3)))} AS canonical, {_sql_decoded(f"regexp_extract(meta, {_quoted(url_filters._REFRESH)}, 1)")} AS refresh FROM tags),
e1 AS (SELECT url AS a, {_sql_normal("url")} AS b FROM t UNION SELECT url, {_sql_resolved("canonical")} FROM t UNION SELECT url, {_sql_resolved("refresh")} FROM t),
e AS (SELECT a, b FROM e1 WHERE b IS NOT NULL UNION SELECT b, {_sql_normal("b")} FROM e1 WHERE b IS NOT NULL),
both_ways AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach(node, other) AS (SELECT a, a FROM both_ways UNION SELECT r.node, w.b FROM reach r JOIN both_ways w ON w.a = r.other),
component AS (SELECT node, min(other) AS component FROM reach GROUP BY node),
parts AS (SELECT component, {_sql_host("node")} AS host, list_filter(string_split({_sql_path("node")}, '/'), lambda x: x <> '') AS steps, string_split({_sql_host("node")}, '.') AS labels FROM component WHERE {_sql_host("node")} <> ''),
keys AS (SELECT component, unnest(list_concat(list_transform(range(1, len(labels) + 1), lambda k: array_to_string(labels[k:], '.')), list_transform(range(1, len(steps) + 1), lambda k: host || '/' || array_to_string(steps[:k], '/')))) AS key FROM parts),
rules(key, action) AS (VALUES {", ".join(f"({_quoted(k)}, {_quoted(a)})" for k, a in url_filters.RULES)}),
decided AS (SELECT component, CASE WHEN bool_or(action = 'allow') THEN 'allow' ELSE 'block' END AS decision FROM keys JOIN rules USING (key) GROUP BY component)
SELECT page_id, pages.url, component, coalesce(decision, 'none') AS decision, coalesce(decision, 'none') = 'block' AS blocked
FROM pages LEFT JOIN component ON pages.url = node LEFT JOIN decided USING (component)"""

_OP2 = f"""
SELECT vec_id, rank, neighbor_id, score FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, neighbor_id) AS INTEGER) AS rank FROM (
    SELECT a.vec_id, b.vec_id AS neighbor_id, round(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda x: CAST(x[1] AS DOUBLE) * CAST(x[2] AS DOUBLE))), {topk_search.DECIMALS}) AS score
    FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id))
WHERE rank <= {topk_search.K}"""

_OP2_EVERY_50TH = f"""
SELECT vec_id, rank, neighbor_id, score FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, neighbor_id) AS INTEGER) AS rank FROM (
    SELECT a.vec_id, b.vec_id AS neighbor_id, round(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda x: CAST(x[1] AS DOUBLE) * CAST(x[2] AS DOUBLE))), {topk_search.DECIMALS}) AS score
    FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0))
WHERE rank <= {topk_search.K}"""

#: The documents (rows of `docs`) with the copies that mixing gives them; the pipeline's SQL could use it too.
_OP10 = f"""
WITH d AS (SELECT doc_id, coalesce(source, '{mixing.NULL_SOURCE}') AS src, length(bin(CAST(coalesce(length(text), 0) AS BIGINT))) AS size,
  (CAST('0x' || substr(md5('{mixing.SEED}:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 12) AS BIGINT) + 0.5::DOUBLE) / {float(1 << 48)}::DOUBLE AS u FROM documents),
s AS (SELECT src, count(*) AS n, CAST(sum(size) AS BIGINT) AS x FROM d GROUP BY src),
w AS (SELECT *, round(CAST(sum(n) OVER () AS DOUBLE) * 1.0::DOUBLE / count(*) OVER (), 9) AS exact, CAST(sum(n) OVER () AS BIGINT) AS total FROM s),
f AS (SELECT *, CAST(floor(exact) AS BIGINT) AS base, exact - floor(exact) AS rest FROM w),
q AS (SELECT src, x, base + CASE WHEN row_number() OVER (ORDER BY rest DESC, src) <= total - sum(base) OVER () THEN 1 ELSE 0 END AS quota FROM f),
due AS (SELECT doc_id, d.src, size, u, CAST(quota * size AS DOUBLE) / CAST(x AS DOUBLE) AS due, quota FROM d JOIN q ON d.src = q.src),
c AS (SELECT *, CAST(floor(due) AS BIGINT) AS whole, due - floor(due) AS chance FROM due),
o AS (SELECT *, CASE WHEN chance > 0 THEN (u / (1 - u)) / (chance / (1 - chance)) END AS rank_value, quota - sum(whole) OVER (PARTITION BY src) AS need FROM c),
r AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY rank_value NULLS LAST, doc_id NULLS FIRST, size) AS r FROM o)
SELECT doc_id, CASE WHEN src <> '{mixing.NULL_SOURCE}' THEN src END AS source, CAST(whole + CASE WHEN rank_value IS NOT NULL AND r <= need THEN 1 ELSE 0 END AS INTEGER) AS copies FROM r"""

ORACLES: dict[str, str] = {
    "op1_url_filters": _OP1,
    "op2_topk_search": _OP2,
    "op2_topk_search_every_50th": _OP2_EVERY_50TH,
    "op4_warc_zstd": "SELECT page_id, url, html FROM pages",
    "op10_mixing_sources": _OP10,
}
