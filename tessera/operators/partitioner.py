"""Balanced graph partitioning and label matching, on the driver: graphs of centroids have at most some 10,000 nodes."""

from __future__ import annotations

import heapq

import numpy as np

IMBALANCE = 0.03


def _neighbours(n: int, src: np.ndarray, dst: np.ndarray, weight: np.ndarray) -> list[dict[int, float]]:
    out: list[dict[int, float]] = [{} for _ in range(n)]
    for a, b, w in zip(src.tolist(), dst.tolist(), weight.tolist(), strict=True):
        if a != b:
            out[a][b] = out[a].get(b, 0.0) + w
            out[b][a] = out[b].get(a, 0.0) + w
    return out


def partition(n: int, src: np.ndarray, dst: np.ndarray, blocks: int, seed: int = 0, weight: np.ndarray | None = None, node_weight: np.ndarray | None = None, imbalance: float = IMBALANCE, passes: int = 8) -> np.ndarray:
    """A block for each node: at most ceil((1 + imbalance) total / blocks) of weight in each where nodes fit, few edges cut.

    Blocks grow one by one along their strongest links, then boundary nodes move while that cuts less.
    """
    weight = np.ones(len(src)) if weight is None else weight
    load = np.ones(n) if node_weight is None else np.maximum(node_weight.astype(float), 0)
    links, rng = _neighbours(n, src, dst, weight), np.random.default_rng(seed)
    most = max(np.ceil((1 + imbalance) * load.sum() / blocks), load.max(initial=0))
    block, size = np.full(n, -1), np.zeros(blocks)
    order = rng.permutation(n)
    at = 0
    for b in range(blocks):
        goal = load[block < 0].sum() / (blocks - b)
        heap: list[tuple[float, int]] = []
        gain: dict[int, float] = {}
        while size[b] < goal and (block < 0).any():
            k = -1
            while heap:
                g, x = heapq.heappop(heap)
                if block[x] < 0 and -g == gain[x]:
                    k = x
                    break
            if k < 0:
                while at < n and block[order[at]] >= 0:
                    at += 1
                if at == n:
                    break
                k = int(order[at])
            if size[b] + load[k] > most and size[b] > 0:
                break
            block[k] = b
            size[b] += load[k]
            for x, w in links[k].items():
                if block[x] < 0:
                    gain[x] = gain.get(x, 0.0) + w
                    heapq.heappush(heap, (-gain[x], x))
    for k in sorted(np.flatnonzero(block < 0).tolist(), key=lambda k: -load[k]):
        block[k] = int(np.argmin(size))
        size[block[k]] += load[k]
    for _ in range(passes):
        moved = 0
        for k in rng.permutation(n).tolist():
            own = block[k]
            pull: dict[int, float] = {}
            for x, w in links[k].items():
                pull[block[x]] = pull.get(block[x], 0.0) + w
            best, to = 0.0, own
            for b, w in pull.items():
                more = w - pull.get(own, 0.0)
                if b != own and size[b] + load[k] <= most and (more > best or more == best and more == 0 and size[b] + load[k] < size[own]):
                    best, to = more, b
            if to != own:
                block[k] = to
                size[own] -= load[k]
                size[to] += load[k]
                moved += best > 0
        if not moved:
            break
    # last, weight that is still too much moves to the lightest block
    for b in range(blocks):
        for k in sorted(np.flatnonzero(block == b).tolist(), key=lambda k: load[k]):
            to = int(np.argmin(size))
            if size[b] <= most or size[to] + load[k] > most:
                break
            block[k] = to
            size[b] -= load[k]
            size[to] += load[k]
    return block


def match(score: np.ndarray) -> np.ndarray:
    """For each row the column of a maximum-weight perfect matching of a square matrix (shortest augmenting paths)."""
    n = len(score)
    cost = score.max(initial=0) - score.astype(float)
    u, v, row_of = np.zeros(n + 1), np.zeros(n + 1), np.full(n + 1, n)
    for i in range(n):
        row_of[n] = i
        j, least, came, used = n, np.full(n, np.inf), np.full(n, n), np.zeros(n + 1, bool)
        while row_of[j] != n or j == n:
            used[j] = True
            i0 = row_of[j]
            free = ~used[:n]
            reduced = cost[i0] - u[i0] - v[:n]
            better = free & (reduced < least)
            least[better], came[better] = reduced[better], j
            to = int(np.where(free, least, np.inf).argmin())
            delta = least[to]
            u[row_of[used]] += delta
            v[used] -= delta
            least[free] -= delta
            j = to
        while j != n:
            row_of[j] = row_of[came[j]]
            j = came[j]
    out = np.zeros(n, int)
    out[row_of[:n]] = np.arange(n)
    return out


def relabel(new: np.ndarray, old: np.ndarray, blocks: int) -> tuple[np.ndarray, int]:
    """(new with the labels that agree most with old, how many nodes still differ)."""
    shared = np.zeros((blocks, blocks))
    np.add.at(shared, (new, old), 1)
    named = match(shared)[new]
    return named, int((named != old).sum())


def drift(new: np.ndarray, old: np.ndarray, blocks: int) -> float:
    """The share of nodes that move under the best relabelling."""
    return relabel(new, old, blocks)[1] / max(len(new), 1)
