"""Top-k search (2), URL filters (1), WARC (4)."""

import io
import re
import struct

import duckdb
import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from tessera.llm import queries, topk_search, url_filters, warc_zstd

VECTORS = "vec_id bigint, embedding array<float>, score int, b int"


def _brute(rows, k):
    out = {}
    for i, v in rows.items():
        best = sorted(((-round(float(np.dot(np.float64(v), np.float64(w))), 9), j) for j, w in rows.items() if j != i))[:k]
        out |= {(i, r + 1): (j, -s) for r, (s, j) in enumerate(best)}
    return out


@pytest.mark.parametrize("block", [4096, 7])
def test_topk_is_exact(spark, block):
    rng = np.random.default_rng(block)
    rows = {i: np.float32(v).tolist() for i, v in enumerate(rng.integers(-2, 3, (90, 5)))}  # small integers: many ties
    got = topk_search.search(spark.createDataFrame([(i, v, 1, 2) for i, v in rows.items()], VECTORS), k=6, block=block)
    assert {(r.vec_id, r.rank): (r.neighbor_id, r.score) for r in got.collect()} == _brute(rows, 6)


@pytest.mark.parametrize("scale", [1.0, 1e3, 1e5, 1e7])
def test_topk_of_long_vectors_is_exact(scale):
    rng = np.random.default_rng(3)
    near = rng.normal(size=16) * scale
    x = near + rng.normal(size=(600, 16)) * scale * 1e-9  # products that differ in their last digits only
    ids = rng.permutation(600)
    got, scores = topk_search.best(x[:200], ids[:200], x, ids, 10)
    for i in range(200):
        exact = topk_search._exact(np.repeat(x[i : i + 1], 600, 0), x)
        want = sorted((-s, j) for s, j in zip(exact, ids, strict=True) if j != ids[i])[:10]
        assert got[i].tolist() == [j for _, j in want] and scores[i].tolist() == [-s for s, _ in want]


@pytest.mark.parametrize("lengths", ["equal", "one very long", "zeros", "tiny", "ties"])
def test_topk_over_many_shards_is_exact(lengths):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(1500, 12)).astype(np.float32)
    if lengths == "one very long":
        x[::150] *= 1e6  # single precision tells nothing beside it
    elif lengths == "zeros":
        x[::3] = 0
    elif lengths == "tiny":
        x *= 1e-30
    elif lengths == "ties":
        x = rng.integers(-1, 2, x.shape).astype(np.float32)
    ids = rng.permutation(1500)
    found = topk_search.Best(x[:300], ids[:300], 10)
    for i in range(0, 1500, 250):
        found.add(x[i : i + 250], ids[i : i + 250])
    for i in range(300):
        exact = topk_search._exact(np.repeat(np.float64(x[i : i + 1]), 1500, 0), np.float64(x))
        want = sorted((-s, j) for s, j in zip(exact, ids, strict=True) if j != ids[i])[:10]
        assert found.ids[i].tolist() == [j for _, j in want] and found.scores[i].tolist() == [-s for s, _ in want]


def test_topk_computes_few_pairs_exactly(monkeypatch):
    pairs, exact = [], topk_search._exact
    monkeypatch.setattr(topk_search, "_exact", lambda a, b: pairs.append(len(a)) or exact(a, b))
    x = np.random.default_rng(6).normal(size=(20_000, 16))
    found = topk_search.Best(x[:500], np.arange(500), 10)
    for i in range(0, 20_000, 1000):
        found.add(x[i : i + 1000], np.arange(i, i + 1000))
    assert sum(pairs) < 70 * 500  # each shard by itself: 20 times 10 at least


@pytest.mark.parametrize("block", [4096, 40])
def test_topk_of_every_50th_and_its_sql(spark, tmp_path, block):
    rng = np.random.default_rng(7)
    rows = [(int(i), np.float32(v).tolist()) for i, v in zip(rng.permutation(900) - 150, rng.integers(-3, 4, (900, 6)), strict=True)]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = topk_search.search(spark.read.parquet(f"{tmp_path}/embeddings.parquet"), block=block, every=50).collect()
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    assert sorted(map(tuple, got)) == sorted(con.sql(queries.ORACLES["op2_topk_search_every_50th"]).fetchall())
    assert sorted(map(tuple, queries.op2_topk_search_every_50th(spark, str(tmp_path)).collect())) == sorted(map(tuple, got))
    assert {r.vec_id for r in got} == set(range(-150, 750, 50))
    assert topk_search.search(spark.createDataFrame([(1, [1.0]), (2, [2.0])], "vec_id bigint, embedding array<float>"), every=50).count() == 0


def test_topk_awkward(spark):
    rows = [(1, [1.0, 0.0], 0, 0), (1, [1.0, 0.0], 0, 0), (2, [0.0, 1.0], 0, 0), (3, None, 0, 0), (None, [1.0, 1.0], 0, 0), (4, [], 0, 0), (5, [1.0], 0, 0), (6, [float("nan"), 1.0], 0, 0), (7, [float("inf"), 1.0], 0, 0), (8, [None, 1.0], 0, 0)]
    got = topk_search.search(spark.createDataFrame(rows, VECTORS)).collect()
    assert sorted((r.vec_id, r.neighbor_id) for r in got) == [(1, 2), (2, 1)]
    assert topk_search.search(spark.createDataFrame([], VECTORS)).count() == 0
    assert topk_search.search(spark.createDataFrame(rows[:1], VECTORS)).count() == 0


PAGES = "page_id bigint, url string, html string, component string, decision int, a string"
RULES = [("bad.org", "block"), ("bad.org/ok", "allow"), ("evil.com/x", "block"), (None, "block")]


def _rules(spark):
    return spark.createDataFrame(RULES, "rule string, action string")


def test_normal_form(spark):
    urls = {
        "http://www.Example.com:80/a/index.html?utm_source=x&p=1&ref=y#f": "https://example.com/a?p=1",
        "https://m.example.com/": "https://example.com",
        "https://example.com/a.html": "https://example.com/a",
        "https://user@example.com/a/?ref=q": "https://example.com/a",
        "not a url": "not a url",
        "": "",
    }
    got = url_filters.with_normal_form(spark.createDataFrame([(u,) for u in urls], "u string"), "u", "n")
    assert {r.u: r.n for r in got.collect()} == urls


def test_decisions_spread_and_allow_wins(spark):
    link = '<html><LINK href="https://bad.org/page" rel="canonical"></html>'
    rows = [
        (1, "https://bad.org/page", None), (2, "http://mirror.net/page", link), (3, "https://www.mirror.net/page.html?ref=1", ""),
        (4, "https://sub.bad.org/", ""), (5, "https://bad.org/ok/1", ""), (6, "https://alias.net/1", '<link rel=canonical href="//bad.org/ok/1">'),
        (7, "https://evil.com/x/y", ""), (8, "https://evil.com/xyz", ""), (9, "https://r.com/a", '<meta http-equiv="refresh" content="0; url=/b">'), (10, "https://r.com/b", ""),
        (11, None, "x"), (12, "", ""), (2, "http://mirror.net/page", link), (13, "https://far.net/z", ""), (14, "https://notbad.org/", ""),
    ]
    pages = spark.createDataFrame([(*r, "c", 1, "a") for r in rows], PAGES)
    log = spark.createDataFrame([("https://far.net/z", "https://hop.net/"), ("http://hop.net", "https://evil.com/x"), (None, "https://bad.org")], "src string, dst string")
    got = url_filters.decide(pages, _rules(spark), log).collect()
    assert len(got) == len(rows)
    by = {r.page_id: r for r in got}
    assert [by[i].decision for i in range(1, 15)] == ["block", "block", "block", "block", "allow", "allow", "block", "none", "none", "none", "none", "none", "block", "none"]
    assert all(r.blocked == (r.decision == "block") for r in got)
    assert by[1].component == by[2].component == by[3].component and by[9].component == by[10].component and by[11].component is None
    assert url_filters.decide(pages.limit(0), _rules(spark)).count() == 0
    assert {r.decision for r in url_filters.decide(pages, _rules(spark).limit(0)).collect()} == {"none"}


@pytest.mark.parametrize(
    "base,target,want",
    [
        ("https://a.com/x/y.html?q=1", "page.html", "https://a.com/x/page.html"),
        ("https://a.com/x/y/z", "../up", "https://a.com/x/up"),
        ("https://a.com", "../../top", "https://a.com/top"),
        ("https://a.com/x/y", "?p=1", "https://a.com/x/y?p=1"),
        ("https://a.com/x/y", "./a/./b/../c?d=../e", "https://a.com/x/a/c?d=../e"),
        ("https://a.com/x/y", "..", "https://a.com/"),
        ("https://a.com/x/y/", ".", "https://a.com/x/y/"),
        ("https://a.com/x", "//b.com/z", "https://b.com/z"),
        ("https://a.com/x", "/r/../s", "https://a.com/s"),
        ("https://a.com/x", "ftp://c.com/z", "ftp://c.com/z"),
        ("https://a.com/x", "mailto:a@b", None),
        ("https://a.com/x", "#part", None),
        ("https://a.com/x", "", None),
        ("no url", "page.html", None),
    ],
)
def test_relative_targets(spark, base, target, want):
    got = spark.createDataFrame([(base, target)], "base string, target string").select(url_filters.resolved(F.col("target"), F.col("base")).alias("r"))
    assert got.first().r == want


LINKS = [
    '<link href="{0}" rel="canonical">', "<LINK data-href='x' REL=canonical HREF='{0}'/>", "<link rel=canonical href={0}>", '<meta http-equiv="refresh" content="0; url={0}">',
    "<meta content=\"1;URL='{0}'\" http-equiv=Refresh>", '<!-- <link rel="canonical" href="https://bad.org/z"> --><link rel="canonical" href="{0}">',
]
HIDDEN = ['<!-- <link rel="canonical" href="{0}"> -->', "<script>x = '<link rel=canonical href={0}>'</script>", "<style><link rel=canonical href={0}></style>", '<!-- never closed <link rel="canonical" href="{0}">', '<link rel="stylesheet" href="{0}">']


def test_links_in_every_form_and_their_sql(spark, tmp_path):
    targets = {"https://www.spam-farm.example.org/a": True, "../x?a=1&amp;b=2": None, "b.html": None, "//casino-win.example.net/": True, "mailto:x@y": None, "&#x2F;": None}
    rows, blocked = [], {}
    for k, (form, target) in enumerate((f, t) for f in LINKS + HIDDEN for t in targets):
        rows.append((k, f"https://site{k}.org/p/q?n={k}", f"<html>{form.format(target)}</html>"))
        blocked[k] = bool(targets[target]) and form in LINKS
    rows += [(1000, "https://site1.org/p/b", ""), (1001, None, LINKS[0]), (1002, "https://site1.org/x?b=2&a=1", None)]
    spark.createDataFrame(rows, "page_id bigint, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = queries.op1_url_filters(spark, str(tmp_path)).toPandas()
    assert {r.page_id: r.blocked for r in got.itertuples() if r.page_id < 1000} == blocked
    con = duckdb.connect()
    con.sql(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    want = con.sql(queries.ORACLES["op1_url_filters"]).df()[list(got.columns)]
    key = lambda df: sorted(map(repr, df.astype(object).where(df.notna(), None).values.tolist()))
    assert key(got) == key(want)


def test_long_urls(spark):
    path = "/".join(f"s{k}" for k in range(50_000))
    rows = [(1, "https://deep.bad.org/ok/" + path), (2, "https://x.bad.org/" + path), (3, "https://" + ".".join("h" * 5000) + ".bad.org/"), (4, "https://evil.com/x/" + path)]
    pages = spark.createDataFrame([(i, u, "") for i, u in rows], "page_id bigint, url string, html string")
    got = {r.page_id: r.decision for r in url_filters.decide(pages, _rules(spark)).collect()}
    assert got == {1: "block", 2: "block", 3: "block", 4: "block"}


@pytest.mark.parametrize("size", ["sf0.001", "sf0.1"])
def test_the_querys_rules_reach_every_blocked_host(spark, size):
    got = queries.op1_url_filters(spark, f"/root/testdata/{size}").collect()
    bad = re.compile(r"https?://([^/]*[.])?(casino-win|free-bets|ads-track|spam-farm|cheap-pills|adult-x)[.]")
    seen = [(r.decision, "allow" if re.search(r"cheap-pills[.][^/]*/de/", r.url) else "block") for r in got if bad.match(r.url or "")]
    assert seen and all(a == b for a, b in seen)
    assert all(r.decision == "none" for r in got if not bad.match(r.url or ""))


def test_warc_round_trip(spark, sf, tmp_path):
    odd = [(1, None, None), (None, "http://a/b c%20d\r\nX: y", "x"), (2, "", ""), (3, "http://é.fr/?q=ü#z", "é\r\n\r\nWARC/1.1\r\n"), (4, " lead", "y" * 3_000_000), (4, " lead", "twice"), (4, " lead", "twice")]
    pages = spark.createDataFrame(odd, "page_id bigint, url string, html string").union(spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", "html"))
    path = f"file://{tmp_path}/warc"
    assert warc_zstd.write(pages, path) >= 1
    found = warc_zstd.read(spark, path).cache()
    assert found.where("error is not null").count() == 0
    key = lambda df: sorted(map(repr, df.collect()))
    assert key(warc_zstd.pages_of(found)) == key(pages)
    assert key(warc_zstd.pages_of(warc_zstd.read(spark, path))) == key(pages)
    assert warc_zstd.write(pages.limit(0), f"file://{tmp_path}/none") >= 0
    assert warc_zstd.read(spark, f"file://{tmp_path}/none").count() == 0


def _archive(records, dictionary=None, packed=False):
    data = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    out = b""
    if dictionary:
        body = zstandard.ZstdCompressor().compress(dictionary) if packed else dictionary
        out = struct.pack("<II", warc_zstd.DICTIONARY_MAGIC, len(body)) + body
    return out + b"".join(zstandard.ZstdCompressor(dict_data=data, write_checksum=True).compress(r) for r in records)


def _read(raw):
    return [(h and h["warc-type"], block, error) for _, h, block, error in warc_zstd.records(io.BytesIO(raw))]


@pytest.mark.parametrize("dictionary,packed", [(None, False), (b"WARC/1.1 abc " * 50, False), (b"WARC/1.1 abc " * 50, True)])
def test_warc_reads_each_kind_of_archive(dictionary, packed):
    rng = np.random.default_rng(0)
    records = [warc_zstd.record(i, f"http://x/{i}", h) for i, h in enumerate(["a", "", rng.bytes(400_000).hex(), "z" * 500_000])]
    got = _read(_archive(records, dictionary, packed))
    assert [len(b) for _, b, _ in got] == [1, 0, 800_000, 500_000] and all(t == "resource" and e is None for t, _, e in got)


def test_warc_tells_what_is_broken():
    good = warc_zstd.record(1, "http://x/", "hello")
    bad = [good.replace(b"WARC/1.1", b"HTTP/1.1"), good.replace(b"Content-Length: 5", b"Content-Length: 6"), good.replace(b"Content-Length: 5", b"Content-Length: x"), good.replace(b"WARC-Date", b"WARC-Data"), good[:-2], good + good, good.replace(b"WARC-Type:", b"WARC-Type"), b""]
    got = _read(_archive([x for b in bad for x in (b, good)]))
    assert [e is None for _, _, e in got] == [False, True] * len(bad)
    raw = _archive([good, good])
    assert [e for _, _, e in _read(raw[:-3])] == [None, "truncated frame"]
    assert [e for _, _, e in _read(raw + b"junk")] == [None, None, "not a frame"]
    assert _read(b"") == [] and _read(struct.pack("<II", 0x184D2A51, 2) + b"ab" + raw)[0][2] is None
    flipped = bytearray(_archive([good]))
    flipped[-1] ^= 1
    assert _read(bytes(flipped))[0][2] is not None
    folded = good.replace(b"Content-Type: text/html", b"Content-Type: text/html;\r\n charset=x")
    headers, block = warc_zstd.parse_record(folded)
    assert headers["content-type"] == "text/html; charset=x" and block == b"hello"
    twice = good.replace(b"Content-Type: text/html", b"WARC-Concurrent-To: <urn:a>\r\nContent-Type: text/html\r\nWARC-Concurrent-To: <urn:b>\r\n folded")
    headers, block = warc_zstd.parse_record(twice)
    assert headers["warc-concurrent-to"] == "<urn:a>\n<urn:b> folded" and headers["content-type"] == "text/html" and block == b"hello"
    with pytest.raises(warc_zstd.Corrupt, match="twice"):
        warc_zstd.parse_record(good.replace(b"Content-Length: 5", b"Content-Length: 5\r\nContent-Length: 5"))
