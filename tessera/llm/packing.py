"""Operator 7, best-fit packing: a grouping genetic algorithm on islands.

Documents are packed into training sequences of `capacity` tokens. A document above that gives full
sequences of its own and a rest. Items are spread over shards of about SHARD_ITEMS by hash; each shard
is a packing problem that several islands (one task each) work at. An individual assigns items to
bins; its fitness is the mean squared filling. Crossover injects whole well-filled bins of one parent
into the other, removes the bins that now repeat an item, and puts the displaced items where they fit
best. After each epoch an island's elite goes to the next island of its shard. An island stops early only
where its best individual can't be improved: all bins full but at most one.
"""

from __future__ import annotations

import base64
import re
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm import _shared, _text

CAPACITY, SHARD_ITEMS = 4096, 2000
#: A byte-pair vocabulary (base64 token, rank) that every executor can read at this path, and how it cuts texts first.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: White space in a row beyond this is counted apart: the pattern's look-ahead would go back over it character by character.
LONG_BLANK = 4096
_BLANKS = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{%d,}" % LONG_BLANK)
ISLANDS, POPULATION, OFFSPRING, EPOCHS = 4, 6, 40, 3
#: Islands that a task works at on average, where there are many.
ISLANDS_PER_TASK = 64


def count_tokens(encoding, text: str) -> int:
    """len(encoding.encode_ordinary(text)), also with white space of any length.

    The pattern makes one piece of a run of white space, without its last character where other text
    follows; so a long run is cut out and its piece encoded as it is.
    """
    n, at = 0, 0
    for m in _BLANKS.finditer(text):
        end = m.end() - (m.end() < len(text))
        n += len(encoding.encode_ordinary(text[at : m.start()])) + len(encoding._encode_single_piece(text[m.start() : end]))
        at = end
    return n + len(encoding.encode_ordinary(text[at:] if at else text))


def token_counts(docs: DataFrame, tokenizer: str | None = TOKENIZER) -> DataFrame:
    """(doc_id, tokens) for each row; without a tokenizer, tokens are runs of non-blank characters. Null texts have none."""
    if tokenizer is None:
        return docs.select("doc_id", F.coalesce(F.regexp_count("text", F.lit(r"\S+")), F.lit(0)).alias("tokens"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        with open(tokenizer, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        encoding = tiktoken.Encoding("pack", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        for b in _text.parts(batches):
            n = [count_tokens(encoding, t.decode("utf-8", "replace")) if t else 0 for t in b.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int32())], ["doc_id", "tokens"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, tokens int")


def best_fit(free: dict[int, int], order: np.ndarray, lengths: np.ndarray, assign: np.ndarray, capacity: int) -> None:
    """Puts the items of `order` one by one into the fullest bin that has room, or a new one. free: room by bin; both are changed."""
    room = sorted((f, b) for b, f in free.items() if f > 0)
    new = max(free, default=-1) + 1
    for k in order.tolist():
        size = int(lengths[k])
        at = bisect_left(room, (size, -1))
        if at < len(room):
            left, b = room.pop(at)
        else:
            left, b, new = capacity, new, new + 1
        assign[k] = b
        free[b] = left - size
        if left > size:
            insort(room, (left - size, b))


def fitness(assign: np.ndarray, lengths: np.ndarray, capacity: int) -> float:
    """The mean of (filling)^2 over the bins used."""
    fill = np.bincount(assign, weights=lengths)
    fill = fill[fill > 0] / capacity
    return float((fill * fill).mean()) if len(fill) else 1.0


def crossover(a: np.ndarray, b: np.ndarray, lengths: np.ndarray, capacity: int, rng: np.random.Generator) -> np.ndarray:
    """A child of a with some well-filled bins of b. lengths descend, so displaced items are placed longest first."""
    fill = np.bincount(b, weights=lengths)
    bins = np.flatnonzero(fill)
    good = bins[fill[bins] >= np.median(fill[bins])]
    chosen = np.zeros(len(fill), bool)
    chosen[rng.choice(good, max(1, int(len(good) * rng.uniform(0.1, 0.5))), replace=False)] = True
    into = chosen[b]
    hit = np.zeros(int(a.max()) + 1, bool)
    hit[a[into]] = True
    loose = hit[a] & ~into
    child = np.where(into, b + len(hit), a)
    stays = ~loose
    fill = np.bincount(child[stays], weights=lengths[stays]).astype(int)
    used = np.unique(child[stays])
    best_fit({int(k): capacity - int(fill[k]) for k in used}, np.flatnonzero(loose), lengths, child, capacity)
    return np.unique(child, return_inverse=True)[1]


def mutate(a: np.ndarray, lengths: np.ndarray, capacity: int, rng: np.random.Generator) -> np.ndarray:
    """Dissolves the emptiest bin and some others, by their free room, and places their items again, about longest first or in random order."""
    fill = np.bincount(a, weights=lengths).astype(int)
    used = np.flatnonzero(fill)
    room = capacity - fill[used] + 1.0
    out = np.zeros(len(fill), bool)
    out[rng.choice(used, min(len(used), max(2, len(used) // 40)), replace=False, p=room / room.sum())] = True
    out[used[np.argmin(fill[used])]] = True
    loose, child = np.flatnonzero(out[a]), a.copy()
    order = loose[np.argsort(-lengths[loose] * rng.uniform(0.8, 1.2, len(loose)))] if rng.random() < 0.5 else rng.permutation(loose)
    best_fit({int(k): capacity - int(fill[k]) for k in used[~out[used]]}, order, lengths, child, capacity)
    return np.unique(child, return_inverse=True)[1]


def found(lengths: np.ndarray, capacity: int, size: int, rng: np.random.Generator) -> list[np.ndarray]:
    """A population: best-fit decreasing, and best fit in disturbed orders."""
    people = []
    for k in range(size):
        noise = 1 if not k else rng.uniform(0.7, 1.3, len(lengths))
        assign = np.zeros(len(lengths), np.int64)
        best_fit({}, np.argsort(-lengths * noise, kind="stable"), lengths, assign, capacity)
        people.append(assign)
        if not k and done(assign, lengths, capacity):
            break
    return people


def done(assign: np.ndarray, lengths: np.ndarray, capacity: int) -> bool:
    """Whether no assignment is fitter: full bins and one for the rest."""
    full, rest = divmod(int(lengths.sum()), capacity)
    best = (full + (rest / capacity) ** 2) / (full + (rest > 0)) if full + rest else 1.0
    return fitness(assign, lengths, capacity) >= best - 1e-12


def evolve(people: list[np.ndarray], lengths: np.ndarray, capacity: int, offspring: int, rng: np.random.Generator) -> list[np.ndarray]:
    """The population after so many children, best first; each replaces the worst individual if it is fitter."""
    people = sorted(people, key=lambda a: -fitness(a, lengths, capacity))
    fits = [fitness(a, lengths, capacity) for a in people]
    for _ in range(offspring):
        if done(people[0], lengths, capacity):
            break
        if len(people) > 1:
            i, j = sorted(rng.choice(len(people), 2, replace=False))
            child = crossover(people[i], people[j], lengths, capacity, rng)
        else:
            child = people[0]
        if rng.random() < 0.5:
            child = mutate(child, lengths, capacity, rng)
        fit = fitness(child, lengths, capacity)
        if fit > fits[-1] and fit not in fits:  # equals would crowd out variety
            people[-1], fits[-1] = child, fit
            order = sorted(range(len(people)), key=lambda k: -fits[k])
            people, fits = [people[k] for k in order], [fits[k] for k in order]
    return people


_STATE = "shard int, island int, lengths binary, people binary, fitness double"
_FIELDS = ["shard", "island", "lengths", "people", "fitness"]


def _row(shard: list, island: list, lengths: list, people: list, fit: list) -> pa.Table:
    return pa.table([pa.array(shard, pa.int32()), pa.array(island, pa.int32()), pa.array(lengths, pa.binary()), pa.array(people, pa.binary()), pa.array(fit, pa.float64())], _FIELDS)


def pack(docs: DataFrame, capacity: int = CAPACITY, shard_items: int = SHARD_ITEMS, islands: int = ISLANDS, population: int = POPULATION, offspring: int = OFFSPRING, epochs: int = EPOCHS, tokenizer: str | None = TOKENIZER) -> DataFrame:
    """(doc_id, copy, part, start, length, bin_id): which tokens of which document fill which sequence.

    A row of docs gives one or more parts that follow each other without gap or overlap; no bin holds
    more than `capacity` tokens. Tokens are those of the whole text. Rows that repeat doc_id and length are
    told apart by copy (1, 2, ...). Texts without tokens, as null and empty ones, take no room: one part
    of length 0 with bin_id null. Null ids are packed like others. An empty table gives an empty
    result; other columns aren't looked at. Runs with the same rows give the same bins.
    """
    spark = docs.sparkSession
    counted = _shared.materialize(token_counts(docs, tokenizer).groupBy("doc_id", "tokens").agg(F.count("*").alias("n")), "sized")
    total = counted.agg(F.sum(F.when(F.col("tokens") % capacity > 0, F.col("n")))).first()[0] or 0
    shards = max(1, -(-total // shard_items))
    each = counted.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n").cast("int")))).drop("n")
    full = (F.col("tokens") / capacity).cast("int")
    whole = each.where(F.col("tokens") >= capacity).withColumn("part", F.explode(F.sequence(F.lit(0), full - 1))).select("doc_id", "copy", "part", (F.col("part") * capacity).alias("start"), F.lit(capacity).alias("length"), F.concat_ws("-", F.lit("own"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "tokens", "copy", "part").alias("bin_id"))
    none = each.where("tokens = 0").select("doc_id", "copy", F.lit(0).alias("part"), F.lit(0).alias("start"), F.lit(0).alias("length"), F.lit(None).cast("string").alias("bin_id"))
    rest = each.where(F.col("tokens") % capacity > 0).select("doc_id", "copy", full.alias("part"), (full * capacity).alias("start"), (F.col("tokens") % capacity).alias("length"))
    rest = rest.withColumn("shard", F.pmod(F.xxhash64("doc_id", "copy", "start", "length"), F.lit(shards)).cast("int"))
    rest = _shared.materialize(rest.withColumn("item", F.row_number().over(Window.partitionBy("shard").orderBy(F.desc("length"), "doc_id", "copy", "part")) - 1), "items")

    def start(items: pa.Table) -> pa.Table:
        shard = items.column("shard")[0].as_py()
        lengths = np.sort(items.column("length").to_numpy())[::-1].astype(np.int64)
        n = np.ascontiguousarray(lengths).tobytes()
        return _row([shard] * islands, list(range(islands)), [n] * islands, [b""] * islands, [0.0] * islands)

    def epoch(turn: int):
        def run(state: pa.Table) -> pa.Table:
            shard, island = state.column("shard")[0].as_py(), state.column("island")[0].as_py()
            lengths = np.frombuffer(state.column("lengths")[0].as_py(), np.int64)
            rng = np.random.default_rng([shard, island, turn])
            people = [p for x in sorted(state.column("people").to_pylist(), key=len)[::-1] for p in np.frombuffer(x, np.int32).reshape(-1, len(lengths)).astype(np.int64)]
            people = evolve(people or found(lengths, capacity, population, rng), lengths, capacity, offspring, rng)[:population]
            best, fit = people[0], fitness(people[0], lengths, capacity)
            n, ending = lengths.tobytes(), turn == epochs - 1 or done(best, lengths, capacity)
            if ending:  # only the elite counts from here on
                return _row([shard], [island], [n], [best.astype(np.int32).tobytes()], [fit])
            out = np.stack(people).astype(np.int32).tobytes()
            return _row([shard, shard], [island, (island + 1) % islands], [n, n], [out, best.astype(np.int32).tobytes()], [fit, fit])

        return run

    state, before = rest.select("shard", "length").groupBy("shard").applyInArrow(start, _STATE), []
    # rows are small and their work is long, so tasks are set by the number of islands, not by bytes
    tasks = min(shards * islands, max(spark.sparkContext.defaultParallelism * 4, shards * islands // ISLANDS_PER_TASK))
    for turn in range(epochs):
        state = _shared.materialize(state.repartition(tasks, "shard", "island").groupBy("shard", "island").applyInArrow(epoch(turn), _STATE), "epoch")
        _shared.release(*before)
        before = [state]

    def unfold(best: pa.Table) -> pa.Table:
        fit, people = best.column("fitness").to_numpy(), best.column("people").to_pylist()
        island = best.column("island").to_numpy()
        assign = np.frombuffer(people[min(range(len(fit)), key=lambda k: (-fit[k], island[k], people[k]))], np.int32)
        return pa.table({"shard": pa.array(np.full(len(assign), best.column("shard")[0].as_py(), np.int32)), "item": pa.array(np.arange(len(assign), dtype=np.int32)), "bin": pa.array(assign)})

    bins = state.groupBy("shard").applyInArrow(unfold, "shard int, item int, bin int")
    placed = rest.join(bins, ["shard", "item"]).select("doc_id", "copy", "part", "start", "length", F.concat_ws("-", "shard", "bin").alias("bin_id"))
    return placed.unionByName(whole).unionByName(none)
