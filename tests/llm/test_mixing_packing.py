"""Mixing (10), packing (7) and the pipeline."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from tessera.llm import mixing, packing
from tests.llm.conftest import words


def _slow(rows, weights, total):
    """Copies by (doc_id, text, source), as a plain loop over each source."""
    key = lambda s: mixing.NULL_SOURCE if s is None else s
    by = {}
    for r in rows:
        by.setdefault(key(r[2]), []).append(r)
    weights = {s: 1.0 for s in by} if weights is None else {key(k): v for k, v in weights.items()}
    whole = sum(v for s, v in weights.items() if s in by)
    exact = {s: round(total * weights.get(s, 0) / whole, 9) for s in by}
    quota = {s: int(x) for s, x in exact.items()}
    for s in sorted(by, key=lambda s: (-(exact[s] - quota[s]), s))[: total - sum(quota.values())]:
        quota[s] += 1
    out = Counter()
    for s, own in by.items():
        size = lambda r: len(bin(len(r[1] or ""))) - 2
        x, ranked, got = sum(map(size, own)), [], 0
        for r in own:
            due = quota[s] * size(r) / x
            out[r] += int(due)
            got += int(due)
            if p := due - int(due):
                u = (int(hashlib.md5(f"{mixing.SEED}:{'null' if r[0] is None else r[0]}".encode()).hexdigest()[:12], 16) + 0.5) / 2**48
                ranked.append(((u / (1 - u)) / (p / (1 - p)), -1 if r[0] is None else r[0], size(r), r))
        for *_, r in sorted(ranked, key=lambda t: t[:3])[: quota[s] - got]:
            out[r] += 1
        assert sum(out[r] for r in set(own)) == quota[s]
    return out


@pytest.mark.parametrize("weights,total", [(None, None), ({"a": 5, "b": 1, "zz": 0}, 700), ({"a": 0.2, None: 0.8}, 333), (None, 3)])
def test_mixing_matches_a_slow_one(spark, weights, total):
    rng = random.Random(1)
    rows = [(i, words(rng, rng.randrange(1, 60)), rng.choice(["a", "a", "a", "b", "c", None])) for i in range(300)]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id bigint, text string, source string, src string, copies int")
    want = _slow(rows, weights, total or 300)
    got = {r.doc_id: r.copies for r in mixing.sample(docs, weights, total).collect()}
    assert got == {r[0]: want[r] for r in rows}
    mixed = mixing.mix(docs, weights, total)
    assert mixed.schema == docs.schema and Counter(r.doc_id for r in mixed.collect()) == Counter({d: n for d, n in got.items() if n})


def test_inclusion_follows_size(spark):
    # over many seeds the share of draws approaches the chance; here: long documents are due more copies than short ones
    rng = random.Random(2)
    rows = [(i, "x" * (3 if i % 2 else 3000), "a") for i in range(4000)]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = mixing.sample(docs, total=1000).toPandas()
    assert got["copies"].sum() == 1000 and abs(got[got.doc_id % 2 == 0]["copies"].sum() / 1000 - 12 / 14) < 0.04


def test_mixing_awkward(spark, awkward, awkward_rows, no_docs):
    got = mixing.sample(awkward).collect()
    assert len(got) == len(awkward_rows) and sum(r.copies for r in got) == len(awkward_rows)
    assert {r.source for r in got} == {"a", "b", "c", None}
    assert mixing.sample(no_docs).count() == 0 and mixing.mix(no_docs).count() == 0
    same = spark.createDataFrame([(1, "tie", "a")] * 10 + [(2, "b", "b")] * 2, "doc_id bigint, text string, source string")
    for total in (5, 7, 12, 30):
        assert sum(r.copies for r in mixing.sample(same, total=total).collect()) == total
        assert mixing.mix(same, total=total).count() == total
    assert sum(r.copies for r in mixing.sample(same, {"a": 0.0}).collect()) == 0


def _check(rows, words_of, capacity):
    """Bins within capacity; every copy of a row covered once, in order."""
    fill = Counter()
    for r in rows:
        assert (r.bin_id is None) == (r.length == 0)
        if r.bin_id:
            fill[r.bin_id] += r.length
    assert max(fill.values(), default=0) <= capacity
    total = Counter()
    for r in rows:
        total[r.doc_id] += r.length
    assert total == words_of
    return fill


def test_packing_is_valid_and_tight(spark):
    rng = random.Random(3)
    rows = [(i, words(rng, rng.choice([rng.randrange(1, 120), rng.randrange(1, 40), 450]))) for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = packing.pack(docs, capacity=200, shard_items=300, tokenizer=None)
    again = packing.pack(docs.repartition(3), capacity=200, shard_items=300, tokenizer=None)
    found = got.collect()
    assert sorted(map(repr, found)) == sorted(map(repr, again.collect()))
    count = {i: len(t.split()) for i, t in rows}
    fill = _check(found, Counter(count), 200)
    for i in range(900):
        mine = sorted((r.start, r.length) for r in found if r.doc_id == i)
        assert [s for s, _ in mine] == [200 * k for k in range(len(mine))]
    assert len(fill) <= -(-sum(count.values()) // 200) + 6


def test_token_counts_are_the_tokenizers(spark, awkward, awkward_rows):
    import base64

    import tiktoken

    with open(packing.TOKENIZER, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    encoding = tiktoken.Encoding("t", pat_str=packing.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = Counter()
    for d, t, *_ in awkward_rows:
        tokens = encoding.encode_ordinary(t or "")
        assert encoding.decode(tokens) == (t or "")
        want[d] += len(tokens)
    _check(packing.pack(awkward, capacity=500).collect(), want, 500)


def test_long_white_space_is_counted_as_the_tokenizer_would(spark, monkeypatch):
    import base64
    import re

    import tiktoken

    with open(packing.TOKENIZER, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    encoding = tiktoken.Encoding("t", pat_str=packing.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = [(1, " " * 5_000_000), (2, "\n" * 5_000_000), (3, "a" + " " * 3_000_000 + "b c"), (4, "x" * 1_000_000), (5, "a  b")]
    got = {r.doc_id: r.tokens for r in packing.token_counts(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    one = len(encoding._encode_single_piece(" " * 2_999_999))
    assert got[1] == len(encoding._encode_single_piece(" " * 5_000_000)) and got[3] == 1 + one + 2 and got[5] == len(encoding.encode_ordinary("a  b"))
    assert got[2] == len(encoding._encode_single_piece("\n" * 5_000_000))
    # with a short limit the same cuts can be held against the tokenizer itself
    monkeypatch.setattr(packing, "_BLANKS", re.compile(packing._BLANKS.pattern.replace(str(packing.LONG_BLANK), "2")))
    rng = random.Random(6)
    for _ in range(3000):
        text = "".join(rng.choices([" ", " ", "\n", "\t", "\u3000", "\xa0", "\x85", "\x1c", "a", "1", "!", "'s", "é", "漢"], k=rng.randrange(1, 14)))
        assert packing.count_tokens(encoding, text) == len(encoding.encode_ordinary(text))


def test_the_search_betters_best_fit_decreasing(spark):
    """Lengths that best fit decreasing packs badly: islands must find fuller bins, and validly."""
    rng = random.Random(7)
    # triples of exactly 100 words, in random order
    sizes = [x for a, b in ((rng.randrange(26, 45), rng.randrange(26, 30)) for _ in range(60)) for x in (a, b, 100 - a - b)]
    docs = spark.createDataFrame([(i, words(rng, n)) for i, n in enumerate(sizes)], "doc_id bigint, text string")
    got = packing.pack(docs, capacity=100, shard_items=1000, tokenizer=None).collect()
    fill = _check(got, Counter(dict(enumerate(sizes))), 100)
    lengths = np.sort(np.array(sizes))[::-1].astype(np.int64)
    start = np.zeros(len(lengths), np.int64)
    packing.best_fit({}, np.arange(len(lengths)), lengths, start, 100)
    found = np.mean([(x / 100) ** 2 for x in fill.values()])
    assert found > packing.fitness(start, lengths, 100) and len(fill) <= len(np.unique(start))
    assert not packing.done(start, lengths, 100) and packing.done(np.repeat(np.arange(60), 3), np.array(sizes), 100)


def test_crossover_keeps_every_item_once():
    rng = np.random.default_rng(4)
    lengths = np.sort(rng.integers(1, 60, 200))[::-1].astype(np.int64)
    people = packing.found(lengths, 100, 6, rng)
    people = people if len(people) > 1 else [people[0], packing.mutate(people[0], lengths, 100, rng)]
    for _ in range(30):
        child = packing.mutate(packing.crossover(people[0], people[-1], lengths, 100, rng), lengths, 100, rng)
        assert len(child) == 200 and np.bincount(child, weights=lengths).max() <= 100 and child.min() >= 0
    # sizes that best fit decreasing packs badly: the search must improve on it
    hard = np.sort(np.concatenate([np.full(6, x) for x in (51, 27, 26, 23, 24, 49)]))[::-1].astype(np.int64)
    start = packing.found(hard, 100, 6, rng)
    end = packing.evolve(list(start), hard, 100, 400, rng)
    assert packing.fitness(end[0], hard, 100) > max(packing.fitness(p, hard, 100) for p in start)
    assert len(np.unique(end[0])) <= 13  # 12 fit; best fit decreasing takes 13 with less filled ones


def test_packing_awkward(spark, awkward, awkward_rows, no_docs):
    got = packing.pack(awkward, capacity=100, tokenizer=None).collect()
    count = Counter()
    for d, t, *_ in awkward_rows:
        count[d] += len((t or "").split())
    _check(got, count, 100)
    assert {r.doc_id for r in got} == {r[0] for r in awkward_rows}
    assert sorted({r.copy for r in got if r.doc_id == 30}) == [1, 2, 3]
    assert packing.pack(no_docs).count() == 0
    ties = spark.createDataFrame([(i, "a b c d e") for i in range(100)], "doc_id bigint, text string")
    assert len({r.bin_id for r in packing.pack(ties, capacity=10, tokenizer=None).collect()}) == 50


def test_pipeline_stages(spark, sf, documents, labels):
    """Each stage against a plain statement of what it keeps."""
    from tessera.llm import language_id, quality, simhash_neardup

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "language", "near_duplicates", "mixture", "packing"] and corpus_pipeline.ORACLE_SQL is None
    docs, seen = documents, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == documents.columns
        path = f"{spark.conf.get('spark.checkpoint.dir')}/test-{name}"
        out.write.mode("overwrite").parquet(path)
        seen[name] = (docs, spark.read.parquet(path))
        docs = seen[name][1]
    before, after = seen["quality"]
    keep = {r.doc_id for r in quality.score(before, quality.fit(before, labels)).collect() if r.keep}
    assert {r.doc_id for r in after.collect()} == keep and 0 < len(keep) < before.count()
    before, after = seen["language"]
    keep = {r.doc_id for r in language_id.identify(before, language_id.fit(before)).collect() if r.keep}
    assert {r.doc_id for r in after.collect()} == keep
    before, after = seen["near_duplicates"]
    prints = sorted((r.doc_id, bytes(r.fp)) for r in simhash_neardup.fingerprints(before).collect())
    fp = np.frombuffer(b"".join(f for _, f in prints), np.uint64).reshape(-1, 4)
    label = simhash_neardup.forest(fp, simhash_neardup.RADIUS)
    assert sorted(r.doc_id for r in after.collect()) == [prints[k][0] for k in np.unique(label)]
    before, after = seen["mixture"]
    rows = [(r.doc_id, r.text, r.source) for r in before.collect()]
    want = _slow(rows, None, len(rows))
    assert Counter(r.doc_id for r in after.collect()) == Counter({r[0]: n for r, n in want.items() if n})
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    count = Counter()
    for r in packing.token_counts(docs).collect():
        count[r.doc_id] += r.tokens
    _check(packed, count, packing.CAPACITY)
    assert sorted(map(repr, corpus_pipeline.run(spark, sf).collect())) == sorted(map(repr, packed))


def test_pipeline_awkward(spark, awkward, no_docs, sf):
    for docs in (awkward, no_docs):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, sf)
            assert out.columns == docs.columns
            out.count()
        corpus_pipeline.STAGES[-1][1](spark, docs, sf).count()
