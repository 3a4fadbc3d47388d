"""Operator 10: benchmark decontamination with a broadcast hash set of test n-grams.

The benchmark's windows of 13 normalised words are hashed into a sorted set. While that set has
at most ``most_bytes`` (its bound for broadcasting) it is broadcast whole; beyond it, the set is
dealt into blocks of that size and the documents are scanned once for each block, adding to what
the earlier blocks found, so nothing is lost. Every window of a document whose
hash is in the set is then compared word by word with the benchmark's words.

Defined cases: a null or wordless document has no words and is clean; an item of 1 to 12 words
is one window, an item without words none; an item without an id goes by the empty text; items that share a window all count; repeated items
count once by id; repeated documents are judged alike, each on its own row; an empty benchmark
leaves all documents clean. Other columns are carried along whatever their names.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle
from .textkit import ALNUM, Words, blocks, tidied

WINDOW = 13
REPORT = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
_BITS = 22
#: Of the windows that are broadcast at once, with their words and items.
MOST_BYTES = 64 << 20


def item_windows(benchmark: DataFrame, item_col: str, text_col: str, k: int = WINDOW) -> DataFrame:
    """One row per item and window: hash, words, length in words, item id as text."""

    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for lo, _, data, offsets in blocks(batch.column(1)):
                words = Words(data, offsets, ALNUM)
                at, hashes = words.windows(k)
                short, more = words.whole(k)
                lengths = [k] * len(at) + words.counts[words.owner[short]].tolist() if len(short) else [k] * len(at)
                at = np.concatenate([at, short])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate([hashes, more]).view(np.int64)),
                        pa.array([words.text(int(i), n) for i, n in zip(at, lengths)], pa.binary()),
                        pa.array(lengths, pa.int32()),
                        pa.array([ids[lo + d] for d in words.owner[at]], pa.string()),
                    ],
                    ["hash", "words", "length", "item"],
                )

    picked = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("i"), F.col(text_col).alias("t"))
    return picked.mapInArrow(tidied(run), "hash long, words binary, length int, item string").distinct()


def _flat(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a column of texts."""
    chunks = column.cast(pa.large_binary()).chunks
    column = pa.concat_arrays(chunks) if chunks else pa.array([], pa.large_binary())
    _, at, raw = column.buffers()
    offsets = np.frombuffer(at, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
    return data.copy(), offsets - offsets[0]


class WindowSet:
    """A block of benchmark windows in flat arrays, sorted by hash: at most about MOST_BYTES. Made on the driver, sent to tasks."""

    def __init__(self, table: pa.Table):
        hashes = table.column("hash").to_numpy()
        order = np.argsort(hashes, kind="stable")
        self.hashes = hashes[order]
        self.words, self.words_at = _flat(table.column("words").take(pa.array(order)))
        self.items, self.items_at = _flat(table.column("item").take(pa.array(order)))
        self.lengths = np.unique(table.column("length").to_numpy()).tolist()
        self.near = np.zeros(1 << _BITS, bool)
        self.near[self.hashes.view(np.uint64) & np.uint64((1 << _BITS) - 1)] = True

    def hits(self, words: Words, k: int) -> Iterator[tuple[int, int, list[str]]]:
        """(first word, words in the window, items) of each verified occurrence."""
        for n in self.lengths:
            at, hashes = words.windows(n)
            maybe = np.flatnonzero(self.near[hashes & np.uint64((1 << _BITS) - 1)])
            found = hashes[maybe].view(np.int64)
            if not len(found):
                continue
            lo, hi = np.searchsorted(self.hashes, found, "left"), np.searchsorted(self.hashes, found, "right")
            for j in np.flatnonzero(hi > lo).tolist():
                first = int(at[maybe[j]])
                text = words.text(first, n)
                same = [i for i in range(lo[j], hi[j]) if self.words[self.words_at[i] : self.words_at[i + 1]].tobytes() == text]
                if same:
                    yield first, n, sorted({self.items[self.items_at[i] : self.items_at[i + 1]].tobytes().decode() for i in same})


def window_blocks(windows: DataFrame, most_bytes: int) -> Iterator[tuple[WindowSet, bool, bool]]:
    """(a block of windows, whether it is the first, whether it is the last): as many as it takes to keep each within ``most_bytes``."""
    size = F.octet_length("words") + F.octet_length("item") + 24
    total = windows.agg(F.sum(size)).collect()[0][0] or 0
    n = max(1, -(-total // most_bytes))
    for b in range(n):
        block = windows if n == 1 else windows.where(F.pmod(F.xxhash64("hash"), F.lit(n)) == b)
        yield WindowSet(block.toArrow()), b == 0, b == n - 1


def _scan(docs: DataFrame, text_col: str, known: WindowSet, k: int, last: bool, again: bool) -> DataFrame:
    """Add (or extend) the hit words and items of each row; at the last block, the report instead."""
    sent = docs.sparkSession.sparkContext.broadcast(known)
    state = {"__kw_hit": "array<int>", "__kw_items": "array<string>"}
    rows = [c for c in docs.columns if c not in state and not (last and c == "__kw_text")]
    added = REPORT if last else ", ".join(f"{c} {t}" for c, t in state.items())
    schema = docs.select(*[F.col(f"`{c}`") for c in rows]).schema
    for f in docs.select().schema.fromDDL(added).fields:
        schema = schema.add(f)

    def run(batches):
        known = sent.value
        for batch in batches:
            if not batch.num_rows:
                continue
            text = batch.column(batch.schema.get_field_index(text_col))
            before = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in state] if again else None
            out: list[list] = [[] for _ in range(5 if last else 2)]
            for lo, hi, data, offsets in blocks(text):
                words = Words(data, offsets, ALNUM)
                hit = np.zeros(len(words.hashes) + 1, np.int32)
                items: dict[int, set[str]] = defaultdict(set)
                for at, n, found in known.hits(words, k):
                    hit[at] += 1
                    hit[at + n] -= 1
                    items[int(words.owner[at])].update(found)
                hit = np.cumsum(hit[:-1]) > 0
                if before:
                    for d in range(hi - lo):
                        hit[words.offsets[d] + np.array(before[0][lo + d], np.int64)] = True
                        items[d].update(before[1][lo + d])
                sums = np.concatenate([[0], np.cumsum(hit)])
                n_hit = sums[words.offsets[1:]] - sums[words.offsets[:-1]]
                for d in range(hi - lo):
                    names = sorted(items[d]) if d in items else []
                    if last:
                        n, h = int(words.counts[d]), int(n_hit[d])
                        digest = hashlib.sha256(",".join(names).encode()).hexdigest()
                        for o, v in zip(out, (n, h, len(names), digest, h > 0 and 20 * h >= n)):
                            o.append(v)
                    else:
                        out[0].append(np.flatnonzero(hit[words.offsets[d] : words.offsets[d + 1]]).tolist())
                        out[1].append(names)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_()] if last else [pa.list_(pa.int32()), pa.list_(pa.string())]
            kept = [batch.column(batch.schema.get_field_index(c)) for c in rows]
            names = rows + [f.split()[0] for f in added.split(", ")]
            yield pa.RecordBatch.from_arrays(kept + [pa.array(v, t) for v, t in zip(out, kinds)], names)

    return docs.mapInArrow(tidied(run), schema)


def contamination(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
    k: int = WINDOW, most_bytes: int = MOST_BYTES, keep: list[str] | None = None,
) -> DataFrame:
    """Each document's ``keep`` columns (default doc_id) with REPORT's columns."""
    windows = settle(item_windows(benchmark, item_col, item_text, k), "windows")
    names = {c: f"__kw_c{i}" for i, c in enumerate(keep or ["doc_id"])}
    rows = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()], *[F.col(text_col).alias("__kw_text")] * (text_col not in names))
    text = names.get(text_col, "__kw_text")  # each text is sent to Python once
    for known, first, last in window_blocks(windows, most_bytes):
        rows = _scan(rows, text, known, k, last, not first)
        if not last:
            rows = settle(rows, "hits")
    return rows.select(*[F.col(n).alias(c) for c, n in names.items()], *[F.col(c.split()[0]) for c in REPORT.split(", ")])


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **how) -> DataFrame:
    """The documents that are not contaminated, with all their columns; no shuffle."""
    clash = {f.split()[0]: f"__kw_own{i}" for i, f in enumerate(REPORT.split(", ")) if f.split()[0] in docs.columns}
    own = docs.withColumnsRenamed(clash)
    judged = contamination(own, benchmark, text_col, keep=own.columns, **how)
    stay = judged.where(~F.col("contaminated")).select(*own.columns)
    return stay.withColumnsRenamed({b: a for a, b in clash.items()})


def remove_spans(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", k: int = WINDOW, most_bytes: int = MOST_BYTES) -> DataFrame:
    """The documents with every occurrence of a benchmark window cut out of the text; only ids of items may be null."""
    windows = settle(item_windows(benchmark, item_col, item_text, k), "windows")
    place = docs.columns.index(text_col)
    for known, _, last in window_blocks(windows, most_bytes):
        sent = docs.sparkSession.sparkContext.broadcast(known)

        def run(batches, sent=sent):
            for batch in batches:
                texts: list[str | None] = []
                for lo, hi, data, offsets in blocks(batch.column(place)):
                    words = Words(data, offsets, ALNUM)
                    cut = np.zeros(len(data) + 1, np.int32)
                    for at, n, _ in sent.value.hits(words, k):
                        cut[words.starts[at]] += 1
                        cut[words.ends[at + n - 1]] -= 1
                    stay = np.cumsum(cut[:-1]) == 0
                    texts += [data[a:b][stay[a:b]].tobytes().decode() for a, b in zip(offsets[:-1], offsets[1:])]
                old = batch.column(place).is_null().to_pylist()
                fresh = pa.array([None if o else t for o, t in zip(old, texts)], batch.schema.field(place).type)
                yield batch.set_column(place, batch.schema.field(place), fresh)

        docs = docs.mapInArrow(tidied(run), docs.schema)
        docs = docs if last else settle(docs, "spans")
    return docs
