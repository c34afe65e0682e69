"""Text features over whole Arrow batches: words, n-grams and fingerprints by array operations on UTF-8 bytes.

A word is a run of ASCII letters, digits and bytes of non-ASCII characters. Hashes see lower case
(ASCII and Latin-1 letters). Texts are cut into groups of whole documents of about CHUNK bytes, and a
long one is gone through in windows, so memory stays small; a document is never cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK, CHUNK_DOCS = 1 << 18, 4096
#: Bytes that are worked at at once, also of a longer text.
WINDOW = 1 << 20
#: A word with so many characters of three or more bytes is a run of text without spaces.
UNSPACED = 6
#: Rows of an Arrow batch that are worked at and given back at a time.
PART_ROWS = 1024
_MUL, _INV = np.uint64(0x9E3779B97F4A7C15), np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))

_b = np.arange(256)
_UPPER = (_b >= 65) & (_b <= 90)
_WORD = _UPPER | ((_b >= 97) & (_b <= 122)) | ((_b >= 48) & (_b <= 57)) | (_b >= 128)
_LOWER = (_b + 32 * _UPPER).astype(np.uint8)


def column_buffers(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, offsets, is null) of a string column; offsets has one entry more than there are rows."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
        if isinstance(col, pa.ChunkedArray):
            col = col.chunk(0) if col.num_chunks else pa.array([], col.type)
    n = len(col)
    null = np.zeros(n, bool) if not col.null_count else np.asarray(col.is_null())
    _, offs, data = col.buffers() if n else (None, None, None)
    if not n or offs is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64), null
    kind = np.int64 if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type) else np.int32
    offsets = np.frombuffer(offs, kind)[col.offset : col.offset + n + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets, null


def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in slices of PART_ROWS rows."""
    for b in batches:
        for i in range(0, b.num_rows, PART_ROWS):
            yield b.slice(i, PART_ROWS)


def groups(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about CHUNK bytes and at most CHUNK_DOCS rows."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + CHUNK, "right")) - 1
        j = min(max(j, i + 1), i + CHUNK_DOCS, n)
        yield i, j
        i = j


def mix(h: np.ndarray) -> np.ndarray:
    """splitmix64's finalizer."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_powers: list[np.ndarray] = []


def _power(n: int) -> list[np.ndarray]:
    """Powers of the multiplier and of its inverse, modulo 2^64."""
    if not _powers or len(_powers[0]) < n:
        _powers[:] = [np.multiply.accumulate(np.concatenate(([np.uint64(1)], np.full(max(n, WINDOW + 1) - 1, x, np.uint64)))) for x in (_MUL, _INV)]
    return _powers


def windows(n: int) -> Iterator[tuple[int, int]]:
    """Ranges of at most WINDOW bytes that cover n bytes."""
    for a in range(0, n, WINDOW):
        yield a, min(a + WINDOW, n)


def lowered(raw: np.ndarray, a: int = 0, b: int | None = None) -> np.ndarray:
    """Bytes a to b in lower case (ASCII, and Latin-1 letters in UTF-8)."""
    part = raw[a:b]
    low = _LOWER[part]
    lead = part[:-1] == 0xC3
    after = np.flatnonzero(lead) + 1
    if a and len(part) and raw[a - 1] == 0xC3:
        after = np.concatenate(([0], after))
    after = after[(part[after] >= 0x80) & (part[after] <= 0x9E) & (part[after] != 0x97)]
    low[after] += 32
    return low


class Words:
    """The words of some documents: doc (0-based), start and length in bytes, hash; raw: the bytes of all.

    Texts are gone through in windows, so besides the words themselves memory doesn't grow with a long text.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.n, self.offsets = len(offsets) - 1, offsets - offsets[0]
        self.raw = raw = data[offsets[0] : offsets[-1]]
        starts, ends, hashes = [], [], []
        # of a word that began in an earlier window: where, the running sum there and the inverse power there
        open_at, open_sum, open_inv = -1, np.uint64(0), np.uint64(0)
        before, total, scale, scale_inv = False, np.uint64(0), 1, 1
        at_docs = np.zeros((2, self.n + 1), np.uint64)  # running sum and inverse power at each document's start
        for a, b in windows(len(raw)):
            p, inv = _power(b - a + 1)
            sums = np.zeros(b - a + 1, np.uint64)
            np.cumsum((lowered(raw, a, b).astype(np.uint64) + np.uint64(1)) * p[: b - a], out=sums[1:])
            sums = total + sums * np.uint64(scale)
            word = _WORD[raw[a:b]]
            i, j = np.searchsorted(self.offsets, (a, b))
            cut = self.offsets[i:j] - a
            first, last = word.copy(), np.zeros(b - a + 1, bool)  # last: a word ends before this byte
            first[1:] &= ~word[:-1]
            first[0] &= not before
            last[1:-1] = word[:-1] & ~word[1:]
            last[0] = before and not word[0]
            first[cut] = word[cut]
            last[cut] = np.concatenate(([before], word[:-1]))[cut]
            last[-1] = word[-1] and b == len(raw)
            s, e = np.flatnonzero(first), np.flatnonzero(last)
            ss, si = sums[s], inv[s] * np.uint64(scale_inv)
            if open_at >= 0:
                s, ss, si = np.concatenate(([open_at - a], s)), np.concatenate(([open_sum], ss)), np.concatenate(([open_inv], si))
            k = len(e)
            hashes.append(mix((sums[e] - ss[:k]) * si[:k] + (e - s[:k]).astype(np.uint64)))
            starts.append(s[:k] + a)
            ends.append(e + a)
            open_at, open_sum, open_inv = (s[k] + a, ss[k], si[k]) if len(s) > k else (-1, np.uint64(0), np.uint64(0))
            at_docs[:, i:j] = sums[cut], inv[cut] * np.uint64(scale_inv)
            before, total = bool(word[-1]), sums[-1]
            scale, scale_inv = scale * int(p[b - a]) % (1 << 64), scale_inv * int(inv[b - a]) % (1 << 64)
        at_docs[:, np.searchsorted(self.offsets, len(raw)) :] = [[total], [np.uint64(scale_inv)]]
        self._at_docs = at_docs
        self.start = np.concatenate(starts) if starts else np.zeros(0, np.int64)
        self.length = (np.concatenate(ends) if ends else self.start) - self.start
        self.hash = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        self.doc = np.searchsorted(self.offsets, self.start, "right") - 1
        self.count = np.bincount(self.doc, minlength=self.n)

    def whole(self) -> np.ndarray:
        """A hash of each document's text in lower case."""
        sums, inv = self._at_docs
        return mix((sums[1:] - sums[:-1]) * inv[:-1] + np.diff(self.offsets).astype(np.uint64))

    def _unspaced(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(which words are runs of at least UNSPACED characters of three or more bytes, doc and hash of the runs of three characters in these).

        Chinese, Japanese, Thai and others write sentences without spaces; a whole run is no term.
        """
        none = np.zeros(len(self.start), bool), np.zeros(0, np.int64), np.zeros(0, np.uint64)
        if not len(self.raw) or not (long := np.flatnonzero(self.length >= 3 * UNSPACED)).size or self.raw.max() < 0xE0:
            return none
        some, docs, hashes = none[0], [], []
        for k in long.tolist():
            part = self.raw[self.start[k] : self.start[k] + self.length[k]]
            if np.count_nonzero(part >= 0xE0) < UNSPACED:
                continue
            some[k] = True
            for a in range(0, len(part), WINDOW):
                # windows overlap by three characters; each gram is counted where its first byte lies
                piece = part[a : a + WINDOW + 12]
                at = np.flatnonzero((piece & 0xC0) != 0x80)
                wide = np.concatenate((piece, np.zeros(4, np.uint8))).astype(np.uint64)
                size = np.diff(np.append(at, len(piece)))
                code = np.zeros(len(at), np.uint64)
                for i in range(4):
                    code = code * np.uint64(256) + np.where(size > i, wide[at + i], np.uint64(0))
                own = at[:-2] < WINDOW
                hashes.append(mix((code[:-2] * np.uint64(0xD6E8FEB86659FD93) + code[1:-1]) * np.uint64(0xD6E8FEB86659FD93) + code[2:])[own])
                docs.append(np.full(len(hashes[-1]), self.doc[k]))
        return (some, np.concatenate(docs), np.concatenate(hashes)) if docs else none

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """(doc, hash) of the terms: pairs of neighbouring words; a lone word; without words, the text itself; in unspaced runs, three characters."""
        run, doc3, hash3 = self._unspaced()
        same = (self.doc[:-1] == self.doc[1:]) & ~run[:-1] & ~run[1:]
        two = mix(self.hash[:-1] * np.uint64(0xD6E8FEB86659FD93) + self.hash[1:])[same]
        lone = (self.count[self.doc] == 1) & ~run
        bare = self._bare()
        return np.concatenate((self.doc[:-1][same], self.doc[lone], bare, doc3)), np.concatenate((two, self.hash[lone], self.whole()[bare], hash3))

    def singles(self) -> tuple[np.ndarray, np.ndarray]:
        """(doc, hash) of the terms: the words; without words, the text itself; in unspaced runs, three characters."""
        run, doc3, hash3 = self._unspaced()
        bare = self._bare()
        return np.concatenate((self.doc[~run], bare, doc3)), np.concatenate((self.hash[~run], self.whole()[bare], hash3))

    def _bare(self) -> np.ndarray:
        """The documents that have a text without words that isn't blank."""
        return np.flatnonzero((self.count == 0) & ~self.blank())

    def blank(self) -> np.ndarray:
        """Which documents hold nothing but white space."""
        out = self.count == 0
        for k in np.flatnonzero(out).tolist():
            out[k] = not (self.raw[self.offsets[k] : self.offsets[k + 1]] > 32).any()
        return out


def unique_counts(doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc, 48-bit hash, count) of each document's distinct hashes; at most CHUNK_DOCS documents."""
    key = np.sort((doc.astype(np.uint64) << np.uint64(48)) | (h >> np.uint64(16)))
    new = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    count = np.diff(np.append(new, len(key)))
    key = key[new]
    return (key >> np.uint64(48)).astype(np.int64), key & np.uint64((1 << 48) - 1), count


_SIGNS = (np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.float64) * 2 - 1)


def simhash(data: np.ndarray, offsets: np.ndarray, bits: int, singles: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """SimHash fingerprints (rows of bits/8 bytes) of all documents, and which have one.

    Terms are pairs of neighbouring words (singles: the words), weighted round(16 (1 + ln count)); each term's hash
    votes its weight for or against each bit, and a bit is set if its votes are above 0. Blank texts have none.
    """
    n, size = len(offsets) - 1, bits // 8
    out, has = np.zeros((n, size), np.uint8), np.zeros(n, bool)
    for i, j in groups(offsets):
        if offsets[j] == offsets[i]:
            continue
        words = Words(data, offsets[i : j + 1])
        doc, h, count = unique_counts(*(words.singles() if singles else words.pairs()))
        weight = np.rint(16 * (1 + np.log(count)))
        at = doc * 256
        for k in range(0, size, 8):
            some = mix(h * np.uint64(8) + np.uint64(k // 8 + 1)).view(np.uint8).reshape(-1, 8)
            for b in range(8):
                votes = np.bincount(at + some[:, b], weights=weight, minlength=(j - i) * 256).reshape(-1, 256) @ _SIGNS
                out[i:j, k + b] = np.packbits(votes > 0, axis=1)[:, 0]
        has[i:j] = np.bincount(doc, minlength=j - i) > 0
    return out, has


def binary_rows(rows: np.ndarray) -> pa.Array:
    """A binary column from rows of bytes."""
    n, w = rows.shape
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((np.arange(n + 1) * w).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(rows))])


def rows_of_binary(col: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    data, offsets, _ = column_buffers(col)
    return data[offsets[0] : offsets[-1]].reshape(-1, width)
