"""Fingerprints (5) and near duplicates (8)."""

import random

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import _shared, _text, queries, simhash_fingerprints, simhash_neardup
from tests.llm.conftest import words


def _prints(texts, bits):
    data, offsets, _ = _text.column_buffers(pa.array(texts))
    return _text.simhash(data, offsets, bits)


def _hamming(a, b):
    return int(np.bitwise_count(a ^ b).sum())


def _distances(fp):
    x = fp.view(np.uint64)
    return np.bitwise_count(x[:, None, :] ^ x[None, :, :]).sum(2)


def test_simhash_matches_a_slow_one():
    texts = ["The cat sat on the mat. The CAT sat!", "solo", "...", "", None, "é É Ü ü x", "a " * 5000]
    fp, has = _prints(texts, 64)
    assert has.tolist() == [True, True, True, False, False, True, True]
    for k, t in enumerate(texts):
        if not t:
            continue
        data, offsets, _ = _text.column_buffers(pa.array([t]))
        doc, h, count = _text.unique_counts(*_text.Words(data, offsets).pairs())
        votes = np.zeros(64)
        for hash_, n in zip(h, count, strict=True):
            bits = np.unpackbits(_text.mix(np.array([hash_]) * np.uint64(8) + np.uint64(1)).view(np.uint8))
            votes += np.rint(16 * (1 + np.log(n))) * (bits * 2.0 - 1)
        assert (np.unpackbits(fp[k]) == (votes > 0)).all()


def test_words_are_cut_at_documents_and_case_is_ignored():
    data, offsets, _ = _text.column_buffers(pa.array(["ab", "cd AB", None, "Ünder ünder"]))
    w = _text.Words(data, offsets)
    assert w.count.tolist() == [1, 2, 0, 2] and w.hash[0] == w.hash[2] and w.hash[3] == w.hash[4]
    # long texts are hashed whole, however they are grouped
    rng = random.Random(0)
    long = words(rng, 300_000, 100_000)
    assert (_prints([long], 64)[0] == _prints(["a b", long, "c d"], 64)[0][1]).all()
    assert _hamming(_prints([long], 256)[0], _prints([long + " another end"], 256)[0]) < 8


@pytest.mark.parametrize("agree", [None, 1, 3])
@pytest.mark.parametrize("radius", [1, 3, 6])
def test_near_pairs_are_all_found(spark, radius, agree):
    rng = np.random.default_rng(radius)
    base = rng.integers(0, 1 << 63, 60)
    some = {int(x) for x in base}
    for x in base.tolist():
        for _ in range(4):
            y = x
            for b in rng.choice(64, rng.integers(1, radius + 3), replace=False).tolist():
                y ^= 1 << b
            some.add(y - (1 << 64) if y >> 63 else y)
    values = sorted(some)
    got = [(r.a, r.b, r.distance) for r in simhash_fingerprints.near_pairs(spark.createDataFrame([(v,) for v in values], "fingerprint bigint"), radius, agree).collect()]
    want = [(a, b, d) for i, a in enumerate(values) for b in values[i + 1 :] if (d := ((a ^ b) & (1 << 64) - 1).bit_count()) <= radius]
    assert sorted(got) == want


@pytest.mark.parametrize("radius", [1, 3, 8, 30])
def test_planned_keys_grow_with_the_corpus(radius):
    before = 0
    for n in (1, 10**3, 10**6, 10**9, 10**11):
        agree = simhash_fingerprints.planned(n, radius)
        assert agree >= max(before, 1)
        before = agree


def _rows(df):
    return sorted((r.doc_id, r.other_id if r.other_id is not None else -1, r.distance) for r in df.collect())


def test_search_lists(spark, awkward, no_docs, documents):
    for radius in (3, simhash_fingerprints.COPY_RADIUS):
        got = simhash_fingerprints.search(documents, radius)
        prints = {r.doc_id: r.fingerprint for r in simhash_fingerprints.fingerprints(documents).collect()}
        least = {}
        for d, f in sorted(prints.items()):
            least.setdefault(f, d)
        want = [(d, least[f], 0) for d, f in prints.items() if least[f] != d]
        for f, d in least.items():
            near = [(d, o, n) for g, o in least.items() if g != f and (n := ((f ^ g) & (1 << 64) - 1).bit_count()) <= radius]
            want += near or [(d, -1, None)]
        assert _rows(got) == sorted(want)
        assert all(prints[r.doc_id] == r.fingerprint for r in got.collect())
    rows = _rows(simhash_fingerprints.search(awkward))
    assert [r for r in rows if r[0] in (20, 21, 22, 23, 30)] == [(20, -1, None), *[(d, 20, 0) for d in (21, 22, 23, 30)]]
    assert not any(r[0] in (1, 2, 3) for r in rows)
    assert simhash_fingerprints.search(no_docs).count() == 0
    with pytest.raises(ValueError):
        simhash_fingerprints.near_pairs(no_docs, 0)


def _edited(rng, text, share):
    return " ".join(f"e{rng.randrange(10**6)}" if rng.random() < share else w for w in text.split())


def test_the_query_lists_edited_copies(spark, tmp_path):
    rng = random.Random(8)
    texts = [words(rng, rng.randrange(60, 400)) for _ in range(200)]
    texts += [_edited(rng, t, 0.02) for t in texts] + [words(rng, 150) for _ in range(300)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.doc_id, r.other_id) for r in queries.op5_simhash_fingerprints(spark, str(tmp_path)).collect() if r.other_id is not None}
    assert np.mean([(i, i + 200) in got or (i + 200, i) in got for i in range(200)]) >= 0.9
    assert all(abs(a - b) == 200 for a, b in got)  # no unrelated text


def test_copies_of_unspaced_text_are_listed(spark):
    rng = random.Random(9)
    han = [chr(c) for c in range(0x4E00, 0x5A00)]
    texts = ["".join(rng.choices(han, k=300)) for _ in range(40)]
    texts += [t[:100] + rng.choice(han) + t[101:] for t in texts]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {(r.doc_id, r.other_id) for r in simhash_fingerprints.search(docs, simhash_fingerprints.COPY_RADIUS).collect() if r.other_id is not None}
    assert sum((i, i + 40) in got or (i + 40, i) in got for i in range(40)) >= 36 and all(abs(a - b) == 40 for a, b in got)
    groups = {r.doc_id: r.group_id for r in simhash_neardup.near_duplicates(docs).collect()}
    assert all(groups[i + 40] == i for i in range(40)) and len(set(groups.values())) == 40


def test_windows_change_nothing(monkeypatch):
    texts = ["The cat, sat. " * 40 + "É" * 90, "", "x" * 300, "漢字テスト" * 30, " \n ", "a"]
    whole = _prints(texts, 256)
    monkeypatch.setattr(_text, "WINDOW", 61)
    monkeypatch.setattr(_text, "_powers", [])
    assert all((a == b).all() for a, b in zip(whole, _prints(texts, 256), strict=True))


def test_recall_against_brute_force(spark):
    rng = random.Random(4)
    texts = []
    for _ in range(150):
        t = words(rng, rng.randrange(60, 400))
        texts += [t, _edited(rng, t, 0.02), _edited(rng, t, 0.05)]
    texts += [words(rng, 120) for _ in range(1500)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    fp, _ = _prints(texts, 256)
    near = np.argwhere(np.triu(_distances(fp) <= simhash_neardup.RADIUS, 1))
    got = {r.doc_id: r.group_id for r in simhash_neardup.near_duplicates(docs, bucket=16).collect()}
    assert len(near) > 300 and np.mean([got[a] == got[b] for a, b in near.tolist()]) >= 0.9
    label = simhash_neardup.forest(fp.view(np.uint64), simhash_neardup.RADIUS)
    assert all(label[d] == label[g] for d, g in got.items())  # nothing is joined that brute force keeps apart


def test_capped_buckets_lose_nothing_when_dense(spark):
    rng = random.Random(5)
    base = words(rng, 300)
    texts = [_edited(rng, base, 0.01) for _ in range(300)] + [words(rng, 100) for _ in range(200)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r for r in simhash_neardup.near_duplicates(docs, cap=20).collect()}
    assert len({got[i].group_id for i in range(300)}) == 1 and sum(r.keep for r in got.values()) == 201


def test_forest_is_the_components():
    rng = np.random.default_rng(6)
    fp = rng.integers(0, 1 << 63, (5, 4)).astype(np.uint64).repeat(40, 0)
    fp[:, 0] ^= (np.uint64(1) << rng.integers(0, 64, 200).astype(np.uint64))
    far = _distances(fp.view(np.uint8).reshape(200, 32))
    label = np.arange(200)
    for _ in range(200):
        label = np.array([label[far[i] <= 2].min() for i in range(200)])
    assert (simhash_neardup.forest(fp, 2) == label).all()


def test_planned_tables_keep_the_recall():
    for n in (10, 1000, 10**6, 10**10):
        bits, tables = simhash_neardup.planned(n)
        p = (1 - simhash_neardup.DESIGN_DISTANCE / simhash_neardup.BITS) ** bits
        assert 1 - (1 - p) ** tables >= simhash_neardup.RECALL - 1e-9 and n / 2**bits <= max(simhash_neardup.BUCKET, n / 2)


@pytest.mark.parametrize("n", [10**4, 10**5, 10**6, 10**7])
def test_planned_tables_find_pairs_at_the_radius(n):
    bits, tables = simhash_neardup.planned(n)
    p = 1.0  # bits are sampled without replacement
    for k in range(bits):
        p *= (simhash_neardup.BITS - simhash_neardup.RADIUS - k) / (simhash_neardup.BITS - k)
    assert 1 - (1 - p) ** tables >= 0.95 - 1e-9


def test_awkward_rows(spark, awkward, awkward_rows, no_docs):
    got = {r.doc_id: r for r in simhash_neardup.near_duplicates(awkward).collect()}
    assert sorted(got) == sorted({r[0] for r in awkward_rows if r[0] is not None})
    assert all(got[d].group_id == 20 and got[d].keep == (d == 20) for d in (20, 21, 22, 23, 30))
    assert all(got[d].keep for d in (1, 2, 3, 4, 5, 6, 7, 9, 10))
    kept = simhash_neardup.deduplicate(awkward)
    assert kept.schema == awkward.schema
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([1, 2, 3, 4, 5, 6, 7, 9, 10, 20, None, None], key=str)
    assert simhash_neardup.near_duplicates(no_docs).count() == 0 and simhash_neardup.deduplicate(no_docs).count() == 0
    repeated = spark.createDataFrame([(1, "same words here and there")] * 5, "doc_id bigint, text string")
    assert simhash_neardup.deduplicate(repeated).count() == 1


@pytest.mark.parametrize("kind", ["random", "chain", "long", "star", "none"])
def test_connected_components(spark, kind):
    rng = random.Random(7)
    edges = {"long": [(i * 7919 % 1009, (i + 1) * 7919 % 1009) for i in range(1000)], "random": [(rng.randrange(80), rng.randrange(80)) for _ in range(45)], "chain": [(i, i + 1) for i in range(60)], "star": [(50, i) for i in range(60)], "none": []}[kind]
    df = spark.createDataFrame([*edges, *edges, (3, 3), (None, 4)], "a bigint, b bigint")
    got = {r.node: r.component for r in _shared.connected_components(df).collect()}
    label = {x: x for e in edges for x in e if e[0] != e[1]}
    before = None
    while before != label:
        before = dict(label)
        for a, b in [*edges, *edges[::-1]]:
            if a != b:
                label[a] = label[b] = min(label[a], label[b])
    assert got == label


def test_broadcasts_are_bounded_by_rows_and_bytes(spark, monkeypatch):
    hinted = lambda df, *rows: "ResolvedHint" in (plan := _shared.small(df, *rows)._jdf.queryExecution().analyzed().toString()) or "broadcast" in plan
    ids, long = spark.range(50), spark.range(10).selectExpr("repeat('x', 1000) as name")
    assert hinted(ids) and hinted(ids, 50) and hinted(long)
    monkeypatch.setattr(_shared, "BROADCAST_ROWS", 49)
    assert not hinted(ids) and not hinted(ids, 50)
    monkeypatch.setattr(_shared, "BROADCAST_BYTES", 9000)
    assert not hinted(long) and hinted(ids.limit(5)) and hinted(spark.range(0).selectExpr("'' as name"))
