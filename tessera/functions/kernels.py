"""Array kernels that run on Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Distances, or elements of vectors, worked on at a time; rows of a batch at a time.
_CELLS, ROWS = 1 << 20, 4096


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of the batches, ROWS at most at a time: what is computed from them is as large whatever the batches' size."""
    for b in batches:
        for i in range(0, b.num_rows, ROWS):
            yield b.slice(i, ROWS)


def usable(column: pa.Array | pa.ChunkedArray, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(matrix of doubles, rows): the vectors that can be worked with, and in which rows of the column they are.

    Left out are null vectors, those of another dimension and those with an element that is null, NaN or infinite.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        column = column if isinstance(column, pa.Array) else (column.chunk(0) if column.num_chunks else pa.array([], column.type))
    n = len(column)
    offsets = column.offsets.to_numpy()
    # what a null row spans isn't looked at; null elements become NaN; of a slice's values only its own are converted
    values = column.values.slice(offsets[0], offsets[-1] - offsets[0]).to_numpy(zero_copy_only=False)
    offsets = offsets - offsets[0]
    fits = np.diff(offsets) == dim
    if column.null_count:
        fits &= ~np.asarray(column.is_null())
    if fits.all():
        x, rows = values[offsets[0] : offsets[-1]].reshape(-1, dim), np.arange(n)
    else:
        rows = np.flatnonzero(fits)
        x = values[offsets[rows][:, None] + np.arange(dim)].reshape(-1, dim)
    x = np.ascontiguousarray(x, np.float64)
    finite = np.isfinite(x).all(1)
    return (x, rows) if finite.all() else (x[finite], rows[finite])


def exact_l2(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances row by row, added in the order of the dimensions (the same bits as the expression gives)."""
    out = np.zeros(len(a))
    for i in range(a.shape[1]):
        x = a[:, i] - b[:, i]
        out += x * x
    return out


def _exact(q: np.ndarray, r: np.ndarray, x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """exact_l2 of the rows r of q and c of x, some at a time: where many are equally near, candidates are as many as the pairs."""
    out, step = np.empty(len(r)), max(1, _CELLS // q.shape[1])
    for i in range(0, len(r), step):
        out[i : i + step] = exact_l2(q[r[i : i + step]], x[c[i : i + step]])
    return out


def nearest(q: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of q, row of x, squared distance) of each query's k nearest, by distance, then id; not those with the id in own.

    A matrix product selects candidates within its rounding error; their distances are then exact.
    """
    rows, cols, dist = [], [], []
    if not len(x) or not len(q):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    xx = (x * x).sum(1)
    step = max(1, _CELLS // len(x))
    for i in range(0, len(q), step):
        part = q[i : i + step]
        qq = (part * part).sum(1)
        far = qq[:, None] + xx[None, :] - 2 * (part @ x.T)
        if own is not None:
            far[own[i : i + step, None] == ids[None, :]] = np.inf
        limit = np.partition(far, k - 1, axis=1)[:, k - 1] if far.shape[1] > k else np.full(len(part), np.inf)
        slack = 1e-12 * (qq + xx.max()) * x.shape[1]
        r, c = np.nonzero((far <= (limit + slack)[:, None]) & (far < np.inf))
        d = _exact(part, r, x, c)
        order = np.lexsort((ids[c], d, r))
        r, c, d = r[order], c[order], d[order]
        some = np.arange(len(r)) - np.searchsorted(r, r) < k
        rows.append(r[some] + i)
        cols.append(c[some])
        dist.append(d[some])
    return np.concatenate(rows), np.concatenate(cols), np.concatenate(dist)


class Best:
    """The k nearest of each query so far, over batches of vectors; an id counts once, with its least distance; ties go to the lesser id."""

    NONE = np.iinfo(np.int64).max

    def __init__(self, queries: np.ndarray, own: np.ndarray | None, k: int):
        self.q, self.own, self.k = queries, own, k
        self.ids, self.d = np.full((len(queries), k), self.NONE), np.full((len(queries), k), np.inf)

    def add(self, x: np.ndarray, ids: np.ndarray) -> None:
        if len(np.unique(ids)) < len(ids):  # else copies of one id could push out others
            self.add_grouped(x, ids, ids)
        else:
            r, c, d = nearest(self.q, x, ids, self.k, self.own)
            self._merge(r, ids[c], d)

    def add_grouped(self, x: np.ndarray, ids: np.ndarray, group: np.ndarray) -> None:
        """The same for groups of vectors, each as near as its nearest one."""
        if not len(x):
            return
        order = np.argsort(group, kind="stable")
        x, ids, group = x[order], ids[order], group[order]
        starts = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
        xx = (x * x).sum(1)
        step = max(1, _CELLS // len(x))
        for i in range(0, len(self.q), step):
            part = self.q[i : i + step]
            qq = (part * part).sum(1)
            far = qq[:, None] + xx[None, :] - 2 * (part @ x.T)
            if self.own is not None:
                far[self.own[i : i + step, None] == ids[None, :]] = np.inf
            least = np.minimum.reduceat(far, starts, axis=1)
            limit = np.partition(least, self.k - 1, axis=1)[:, self.k - 1] if least.shape[1] > self.k else np.full(len(part), np.inf)
            r, c = np.nonzero((far <= (limit + 1e-12 * (qq + xx.max()) * x.shape[1])[:, None]) & (far < np.inf))
            d = _exact(part, r, x, c)
            order = np.lexsort((d, group[c], r))
            r, g, d = r[order], group[c[order]], d[order]
            first = np.concatenate(([True], (r[1:] != r[:-1]) | (g[1:] != g[:-1]))) if len(r) else np.zeros(0, bool)
            r, g, d = r[first], g[first], d[first]
            order = np.lexsort((g, d, r))
            r, g, d = r[order], g[order], d[order]
            some = np.arange(len(r)) - np.searchsorted(r, r) < self.k
            self._merge(r[some] + i, g[some], d[some])

    def _merge(self, r: np.ndarray, ids: np.ndarray, d: np.ndarray) -> None:
        """Takes in at most k of each row, by row."""
        better = d <= self.d[r, -1]
        r, ids, d = r[better], ids[better], d[better]
        if not len(r):
            return
        touched, row = np.unique(r, return_inverse=True)
        place = np.arange(len(r)) - np.searchsorted(r, r)
        both_ids, both = np.full((len(touched), 2 * self.k), self.NONE), np.full((len(touched), 2 * self.k), np.inf)
        both_ids[:, : self.k], both[:, : self.k] = self.ids[touched], self.d[touched]
        both_ids[row, self.k + place], both[row, self.k + place] = ids, d
        order = np.lexsort((both, both_ids), axis=1)
        both_ids, both = np.take_along_axis(both_ids, order, 1), np.take_along_axis(both, order, 1)
        again = both_ids[:, 1:] == both_ids[:, :-1]
        both[:, 1:][again] = np.inf
        order = np.lexsort((both_ids, both), axis=1)[:, : self.k]
        both = np.take_along_axis(both, order, 1)
        self.ids[touched], self.d[touched] = np.where(both < np.inf, np.take_along_axis(both_ids, order, 1), self.NONE), both

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row of the query, id, squared distance)."""
        r, c = np.nonzero(self.d < np.inf)
        return r, self.ids[r, c], self.d[r, c]


def within(q: np.ndarray, x: np.ndarray, most: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of q, row of x, squared distance) of all pairs within the squared distance."""
    rows, cols, dist = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
    if len(q) and len(x):
        xx = (x * x).sum(1)
        step = max(1, _CELLS // len(x))
        for i in range(0, len(q), step):
            part = q[i : i + step]
            qq = (part * part).sum(1)
            slack = 1e-12 * (qq + xx.max()) * x.shape[1]
            r, c = np.nonzero(qq[:, None] + xx[None, :] - 2 * (part @ x.T) <= (most + slack)[:, None])
            d = _exact(part, r, x, c)
            some = d <= most
            rows.append(r[some] + i)
            cols.append(c[some])
            dist.append(d[some])
    return np.concatenate(rows), np.concatenate(cols), np.concatenate(dist)
