"""Numpy helpers that work on many texts at once: bytes, words, hashes and windows.

Texts are taken from Arrow columns as one UTF-8 buffer with offsets, in blocks of bounded
bytes (a single longer text is a block of its own), so memory does not follow the batch.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 19
_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_P_INVERSE = np.uint64(pow(int(_P), -1, 1 << 64))
_Q = np.uint64(0xD6E8FEB86659FD93)
_powers: dict[str, np.ndarray] = {"p": np.ones(1, np.uint64), "i": np.ones(1, np.uint64)}

#: A-Z to a-z, all else unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def word_bytes(*ranges: tuple[int, int]) -> np.ndarray:
    """Which bytes belong to words; every byte of a character beyond ASCII does."""
    found = np.zeros(256, bool)
    found[128:] = True
    for a, b in ranges:
        found[a : b + 1] = True
    return found


#: Digits, letters, and all beyond ASCII.
ALNUM = word_bytes((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A))
#: All but a space and the five controls from tab to carriage return.
NONSPACE = word_bytes((0x00, 0x7F))
NONSPACE[0x20] = NONSPACE[0x09:0x0E] = False


def _power(kind: str, base: np.uint64, n: int) -> np.ndarray:
    """The first n powers of a number; kept for texts up to a block, made anew for longer ones."""
    made = _powers[kind]
    if len(made) < n:
        steps = np.full(max(n, BLOCK_BYTES + 2), base, np.uint64)
        steps[0] = 1
        made = np.cumprod(steps, dtype=np.uint64)
        if n <= BLOCK_BYTES + 2:
            _powers[kind] = made
    return made[:n]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """n powers of the base of rolling hashes, and n + 1 of its inverse."""
    return _power("p", _P, n), _power("i", _P_INVERSE, n + 1)


def tidied(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """A task's function that gives freed memory back to the system when the task ends, so a worker that waits for its next one is small."""

    def whole(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):  # only where the C library has it
            return

    return whole


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the splitmix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def blocks(column: pa.Array | pa.ChunkedArray, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of blocks of texts; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    _, at, raw = column.buffers()
    offsets = np.frombuffer(at, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


class Words:
    """The words of a block: where they start and end, whose they are, and a hash of each."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, kind: np.ndarray, lower: bool = True):
        data = LOWER[data] if lower else data
        n = len(data)
        inside = kind[data]
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        edges = offsets[(offsets > 0) & (offsets < n)]
        first[edges] = inside[edges]
        last[edges - 1] = inside[edges - 1]
        self.data = data
        self.starts = np.flatnonzero(first)
        self.ends = np.flatnonzero(last) + 1
        #: Of each document: its first word, and the word after its last.
        self.offsets = np.searchsorted(self.starts, offsets)
        self.counts = np.diff(self.offsets)
        self.owner = np.repeat(np.arange(len(offsets) - 1), self.counts)
        sums = np.zeros(n + 1, np.uint64)
        up, down = powers(n)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up, out=sums[1:])
        raw = (sums[self.ends] - sums[self.starts]) * down[self.starts]
        self.hashes = mix(raw ^ ((self.ends - self.starts).astype(np.uint64) << np.uint64(40)))

    def text(self, i: int, k: int = 1) -> bytes:
        """The words from i on, with a space between them."""
        return b" ".join(self.data[a:b].tobytes() for a, b in zip(self.starts[i : i + k], self.ends[i : i + k]))

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(first words, hashes) of all windows of k words that lie in one document."""
        n = len(self.hashes) - k + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        total = np.zeros(n, np.uint64)
        for t in range(k):
            total = total * _Q + self.hashes[t : t + n]
        at = np.flatnonzero(self.owner[:n] == self.owner[k - 1 :])
        return at, mix(total[at] + np.uint64(k))

    def whole(self, below: int) -> tuple[np.ndarray, np.ndarray]:
        """(first words, hashes) of documents of fewer than ``below`` words, but not none, each as one window."""
        at, found = [], []
        for k in range(1, below):
            docs = np.flatnonzero(self.counts == k)
            if len(docs):
                first = self.offsets[docs]
                total = np.zeros(len(docs), np.uint64)
                for t in range(k):
                    total = total * _Q + self.hashes[first + t]
                at.append(first)
                found.append(mix(total + np.uint64(k)))
        return (np.concatenate(at), np.concatenate(found)) if at else (np.zeros(0, np.int64), np.zeros(0, np.uint64))


def map_texts(df, columns: list[str], schema: str, body: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]):
    """mapInArrow over some columns of a table; ``body`` turns a batch into batches."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield from body(batch)

    return df.select(*columns).mapInArrow(tidied(run), schema)


def lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column from flat values and the length of each list."""
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))


def with_columns(docs, text_col: str, keep: list[str], added: str, body: Callable[[np.ndarray, np.ndarray], list]):
    """The ``keep`` columns of a table and more, worked out from blocks of its texts.

    ``body`` takes a block's bytes and offsets and gives one array for each added column. Each
    text goes to Python once, and comes back only if it is kept. Columns are renamed meanwhile,
    so their names may be any.
    """
    from pyspark.sql import functions as F

    inner = {c: f"__kw_c{i}" for i, c in enumerate(keep)}
    text = [F.col(f"`{text_col}`").alias("__kw_text")] * (text_col not in inner)
    rows = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in inner.items()], *text)
    place = rows.columns.index(inner.get(text_col, "__kw_text"))
    schema = rows.select(*inner.values()).schema
    fresh = type(schema).fromDDL(added)
    names = [f"__kw_a{i}" for i in range(len(fresh))]
    for f, n in zip(fresh, names):
        schema = schema.add(n, f.dataType)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            for lo, hi, data, offsets in blocks(batch.column(place)):
                kept = [batch.column(i).slice(lo, hi - lo) for i in range(len(inner))]
                made = [x if isinstance(x, (pa.Array, pa.ChunkedArray)) else pa.array(x) for x in body(data, offsets)]
                yield pa.RecordBatch.from_arrays(kept + made, [*inner.values(), *names])

    out = rows.mapInArrow(tidied(run), schema)
    return out.select(*[F.col(n).alias(c) for c, n in inner.items()], *[F.col(n).alias(f.name) for n, f in zip(names, fresh)])


def sums_by(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of runs of ``values`` (along axis 0) from each offset to the next; empty runs give 0."""
    total = np.concatenate([np.zeros((1, *values.shape[1:])), np.cumsum(values, axis=0, dtype=np.float64)])
    return total[offsets[1:]] - total[offsets[:-1]]
