"""Operator 4: n-gram Jaccard self-join by parity sketches.

A document is the set of its distinct shingles. Hashing every shingle to one of many bits and
flipping that bit gives a parity sketch: each shingle that only one of two sets has flips at
most one bit, so the Hamming distance of two sketches is a lower bound of the symmetric
difference of the sets.

Sets that reach similarity t differ in at most d = (1 - t) / (1 + t) * (|A| + |B|) shingles.
For each size band (by the smaller set, 1 / t wide; a set takes part in its own band and in the
one below) the sketch is cut into m > d blocks, and by the pigeonhole principle two similar
sets agree in at least m - d whole blocks. A block's key is the XOR of a mixed hash of its
flipped bits, a linear fingerprint of the block. Sets are joined on block keys:

* In one order for all sets, rarest first and blocks without shingles last, a set needs only its
  first d + 1 keys (a prefix filter on blocks). Empty blocks and blocks filled by a common
  passage are left out without losing a pair. A set with fewer than d + 1 filled blocks adds
  keys of empty ones.
* A band that would need more than MOST_BLOCKS blocks uses that many of its d + 1, the same ones
  for all sets, and may leave out SPARE keys. Two sets exactly at the threshold agree in each
  block with probability 0.35 at least, so they miss each other with a probability of about 6e-8 (an estimate),
  and more similar ones more rarely still: the order of a collision of hashes.

Candidates are made without pairing whole groups. In a group of copies of copies the sets near
the middle have the keys that most others have, so in each of ROUNDS rounds every set is compared
only with the most central set it shares keys with, and sets found alike are merged to
components; a later round leaves out what is already in a key's largest component. Only pairs
across components that still share a key are then tried, within the bounds of size and of the
Hamming distance of two short sketches, which drop nearly all that aren't alike. Exact sets
decide in the end.

Defined cases: a text without words (or null) has no shingles and links with nothing; fewer
words than k make one shingle of all; equal sets are linked and compared once; repeated rows
stay; a row without an id links only with equal sets, and its component is the smallest id
there (null if it has none); ids that aren't whole numbers are taken as texts, the smallest by
its bytes; a text may have any length; other columns are carried along.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import bitset
from .common import ident, settle
from .components import components
from .textkit import NONSPACE, Words, blocks, lists, mix, tidied

K, PERCENT = 5, 75
MOST_BLOCKS, SPARE = 64, 4
SKETCH_WORDS = 16
ROUNDS = 2


def _sets(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, shingle hash), distinct and sorted by document."""
    at, hashes = words.windows(k)
    short, more = words.whole(k)
    owner = words.owner[np.concatenate([at, short])]
    hashes = np.concatenate([hashes, more])
    order = np.lexsort((hashes, owner))
    owner, hashes = owner[order], hashes[order]
    fresh = np.ones(len(owner), bool)
    fresh[1:] = (owner[1:] != owner[:-1]) | (hashes[1:] != hashes[:-1])
    return owner[fresh], hashes[fresh]


def most_apart(a: int, b: int, percent: int) -> int:
    """The largest symmetric difference of similar sets of a and b shingles."""
    return (a + b) * (100 - percent) // (100 + percent)


def band_of(n: int, percent: int) -> int:
    return int(math.log(max(n, 1)) / math.log(100 / percent) + 1e-9)


def band_plan(band: int, percent: int = PERCENT) -> tuple[int, int, int]:
    """(largest size of a smaller set, m blocks, blocks used) of a band."""
    most = int((100 / percent) ** (band + 1) + 1e-9)
    d = most_apart(most, most * 100 // percent, percent)
    m = d + 1 + max(SPARE, d // 3)
    return (most, m, m) if m <= MOST_BLOCKS else (most, d + 1, MOST_BLOCKS)


_taken: dict[tuple[int, int], np.ndarray] = {}


def _used(band: int, m: int, used: int) -> np.ndarray:
    """Which of a band's blocks are used."""
    if (band, m) not in _taken:
        rank = np.argsort(np.argsort(mix(np.arange(m, dtype=np.uint64) + np.uint64(band * 7919))))
        _taken[band, m] = rank < used
    return _taken[band, m]


def _block_keys(hashes: np.ndarray, band: int, percent: int) -> tuple[np.ndarray, int]:
    """The keys of a set's filled blocks in a band, and how many of the most frequent it may leave out."""
    n = len(hashes)
    most, m, used = band_plan(band, percent)
    spread = mix(hashes ^ np.uint64(0x1000003 * (band + 1)))
    block = (spread >> np.uint64(32)) * np.uint64(m) >> np.uint64(32)
    bit = mix((spread & np.uint64(0xFFFFFF)) + (block << np.uint64(24)) + np.uint64(band << 50))
    taken = _used(band, m, used)
    if used < m:
        inside = taken[block.astype(np.int64)]
        block, bit = block[inside], bit[inside]
    order = np.argsort(block, kind="stable")
    block, bit = block[order], bit[order]
    first = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]])) if len(block) else np.zeros(0, np.int64)
    parity = np.bitwise_xor.reduceat(bit, first) if len(block) else bit
    full = parity != 0
    block, parity = block[first][full], parity[full]
    salt = np.uint64(band * 2 + 1)
    if used == m:
        larger = most if n > most else n * 100 // percent
        need = most_apart(n, larger, percent) + 1
        drop = len(block) - need
        if drop < 0:
            empty = np.setdiff1d(np.arange(m, dtype=np.uint64), block)[:-drop]
            block, parity, drop = np.concatenate([block, empty]), np.concatenate([parity, empty * np.uint64(0)]), 0
    else:
        drop = min(SPARE, max(0, len(block) - 1))
    return mix(mix(parity + salt) ^ (block << np.uint64(20))), drop


def _sketch(hashes: np.ndarray) -> np.ndarray:
    """1,024 parity bits."""
    flips = np.bincount((hashes >> np.uint64(7) & np.uint64(64 * SKETCH_WORDS - 1)).astype(np.int64), minlength=64 * SKETCH_WORDS) & 1
    return np.packbits(flips.astype(np.uint8), bitorder="little").view(np.int64)


def _id(own: np.ndarray) -> int:
    """A 64-bit id of a set."""
    both = np.bitwise_xor.reduce(mix(own)) ^ mix(np.array([np.add.reduce(own) + np.uint64(len(own))]))
    return int(mix(both).view(np.int64)[0])


def signatures(docs: DataFrame, id_col: str, text_col: str, k: int = K, percent: int = PERCENT) -> DataFrame:
    """One row per document: doc_id, n (shingles), fp (id of its set; null if empty), sketch; for
    each key its band, and how many keys the set may leave out in that band."""

    def run(batches):
        for batch in batches:
            for lo, hi, data, offsets in blocks(batch.column(1)):
                owner, hashes = _sets(Words(data, offsets, NONSPACE), k)
                ends = np.searchsorted(owner, np.arange(hi - lo + 1))
                fps, sketches, keys, bands, drops, per = [], [], [], [], [], []
                for d in range(hi - lo):
                    own = hashes[ends[d] : ends[d + 1]]
                    per.append(0)
                    fps.append(_id(own) if len(own) else None)
                    sketches.append(_sketch(own))
                    for band in range(band_of(-(-len(own) * percent // 100), percent), band_of(len(own), percent) + 1) if len(own) else ():
                        made, drop = _block_keys(own, band, percent)
                        per[-1] += len(made)
                        keys.append(made)
                        bands.append(np.full(len(made), band, np.int16))
                        drops.append(np.full(len(made), drop, np.int16))
                flat = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (keys, bands, drops)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(lo, hi - lo),
                        pa.array(np.diff(ends), pa.int64()),
                        pa.array(fps, pa.int64()),
                        lists(np.concatenate(sketches), np.full(hi - lo, SKETCH_WORDS), pa.int64()),
                        lists(flat[0].view(np.int64), np.array(per), pa.int64()),
                        lists(flat[1].astype(np.int16), np.array(per), pa.int16()),
                        lists(flat[2].astype(np.int16), np.array(per), pa.int16()),
                    ],
                    ["doc_id", "n", "fp", "sketch", "keys", "bands", "drops"],
                )

    rows = docs.select(ident(docs, id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(tidied(run), f"doc_id {kind}, n long, fp long, sketch array<long>, keys array<long>, bands array<short>, drops array<short>")


def shingle_sets(docs: DataFrame, text_col: str, k: int = K) -> DataFrame:
    """The id and the hashes of each row's set of shingles."""

    def run(batches):
        for batch in batches:
            for lo, hi, data, offsets in blocks(batch.column(0)):
                owner, hashes = _sets(Words(data, offsets, NONSPACE), k)
                ends = np.searchsorted(owner, np.arange(hi - lo + 1))
                fps = [_id(hashes[a:b]) if b > a else None for a, b in zip(ends[:-1], ends[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(fps, pa.int64()), lists(hashes.view(np.int64), np.diff(ends), pa.int64())], ["fp", "hashes"])

    return docs.select(text_col).mapInArrow(tidied(run), "fp long, hashes array<long>")


def may_be_alike(percent: int) -> Column:
    """Whether sizes na, nb and sketches sa, sb allow the threshold.

    With i shared of u shingles, i >= t u and |A xor B| = u - i, so
    |A xor B| (1 + t) <= (|A| + |B|) (1 - t); sketches are apart by |A xor B| at most.
    """
    apart = reduce(lambda x, y: x + y, [F.bit_count(F.col("sa")[i].bitwiseXOR(F.col("sb")[i])) for i in range(SKETCH_WORDS)])
    sizes = F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent
    return sizes & (apart * (100 + percent) <= (F.col("na") + F.col("nb")) * (100 - percent))


class _Verifier:
    """Decides candidate pairs of sets; sets are read from the texts of those that occur."""

    def __init__(self, docs: DataFrame, signed: DataFrame, id_col: str, text_col: str, k: int, percent: int):
        self.docs, self.id_col, self.text_col, self.k, self.percent = docs, id_col, text_col, k, percent
        known = signed.where("fp is not null").groupBy("fp").agg(F.min("doc_id").alias("doc"), F.min(F.struct("n", "sketch")).alias("s"))
        # written, so that a set in many pairs can be split in the joins
        self.known = settle(known.select("fp", "doc", "s.n", "s.sketch"), "known")

    def links(self, pairs: DataFrame) -> DataFrame:
        """Those of the pairs (a, b) that reach the threshold."""
        p = self.percent
        part = self.known.select("fp", "n", "sketch")
        near = pairs.join(part.toDF("a", "na", "sa"), "a").join(part.toDF("b", "nb", "sb"), "b")
        near = settle(near.where(may_be_alike(p)).select("a", "b"), "candidates")
        nodes = near.select(F.explode(F.array("a", "b")).alias("fp")).distinct()
        nodes = settle(nodes.join(self.known.select("fp", "doc"), "fp"), "nodes")
        _, some = bitset.split(self.docs, F.xxhash64(ident(self.docs, self.id_col)), nodes, F.xxhash64("doc"), nodes.count())
        sets = shingle_sets(some, self.text_col, self.k).join(nodes.select("fp"), "fp").groupBy("fp").agg(F.first("hashes").alias("hashes"))
        sets = settle(sets, "sets")
        both = near.join(sets.toDF("a", "ha"), "a").join(sets.toDF("b", "hb"), "b")
        shared = F.size(F.array_intersect("ha", "hb"))
        linked = shared * 100 >= (F.size("ha") + F.size("hb") - shared) * p
        return settle(both.where(linked).select("a", "b"), "linked")


def _keyed(signed: DataFrame) -> DataFrame:
    """(key, fp, band, drop), one row for each block key of each row's set."""
    each = signed.where("fp is not null").select("fp", F.explode(F.arrays_zip("keys", "bands", "drops")).alias("x"))
    return each.select(F.col("x.keys").alias("key"), "fp", F.col("x.bands").alias("band"), F.col("x.drops").alias("drop"))


def _shared_keys(signed: DataFrame) -> DataFrame:
    """(key, fp, uses): the keys that different sets share, without those that a set may leave out."""
    keyed = _keyed(signed)
    stats = keyed.groupBy("key").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi"), F.count(F.lit(1)).alias("uses"))
    stats = settle(stats.where("lo <> hi").select("key", "uses"), "keys")
    _, some = bitset.split(keyed, F.col("key"), stats, F.col("key"), stats.count())
    met = settle(some.distinct(), "met").join(stats, "key")
    order = W.partitionBy("fp", "band").orderBy(F.desc("uses"), "key")  # at most MOST_BLOCKS rows each
    return met.withColumn("place", F.row_number().over(order)).where("place > drop").select("key", "fp", "uses")


def _placed(rows: DataFrame, links: DataFrame | None) -> DataFrame:
    """Rows of (key, fp, central) with the root of each set's component so far."""
    if links is None:
        return rows.withColumn("root", F.col("fp"))
    roots = components(links).withColumnRenamed("node", "fp")
    return settle(rows.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")), "placed")


def _middles(rows: DataFrame) -> DataFrame:
    """For each key that meets in several components: its most central set, and that one's root."""
    tops = rows.groupBy("key").agg(F.max(F.struct("central", "fp", "root")).alias("top"), F.min("root").alias("r0"), F.max("root").alias("r1"))
    return settle(tops.where("r0 <> r1").select("key", F.col("top.fp").alias("lead"), F.col("top.root").alias("lead_root")), "middles")


def _links(signed: DataFrame, check: _Verifier, percent: int) -> DataFrame:
    """Links (a, b) between sets, enough to connect all that are connected."""
    shared = settle(_shared_keys(signed), "shared")
    central = shared.groupBy("fp").agg(F.sum("uses").alias("central"))
    rows = settle(shared.join(central, "fp").select("key", "fp", "central"), "central")
    links, tried = None, None
    for k in range(ROUNDS):
        some = placed = _placed(rows, links)
        if k:
            some = settle(placed.join(_middles(placed), "key").where("root <> lead_root").select("key", "fp", "central", "root"), "open")
        pairs = some.join(_middles(some), "key").where("root <> lead_root").groupBy("fp", "lead").count()
        best = pairs.groupBy("fp").agg(F.max(F.struct("count", "lead")).alias("top"))
        fresh = settle(best.select(F.least("fp", "top.lead").alias("a"), F.greatest("fp", "top.lead").alias("b")).distinct(), "pairs")
        found = check.links(fresh if tried is None else fresh.join(tried, ["a", "b"], "left_anti"))
        tried = fresh if tried is None else tried.unionByName(fresh)
        links = found if links is None else links.unionByName(found)
    placed = _placed(rows, links)
    middles = _middles(placed)
    known = check.known.select("fp", "n", "sketch")
    mixed = settle(placed.join(middles, "key").join(known, "fp"), "mixed")
    x = mixed.where("root <> lead_root").select("key", F.col("fp").alias("x"), F.col("root").alias("rx"), F.col("n").alias("na"), F.col("sketch").alias("sa"))
    y = mixed.select("key", F.col("fp").alias("y"), F.col("root").alias("ry"), F.col("n").alias("nb"), F.col("sketch").alias("sb"))
    more = x.join(y, (x["key"] == y["key"]) & (F.col("rx") != F.col("ry")) & may_be_alike(percent))
    more = settle(more.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "pairs")
    return links.unionByName(check.links(more.join(tried, ["a", "b"], "left_anti")))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, percent: int = PERCENT) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (its smallest doc_id)."""
    signed = settle(signatures(docs, id_col, text_col, k, percent), "signatures")
    check = _Verifier(docs, signed, id_col, text_col, k, percent)
    links = _links(signed, check, percent)
    # components of documents, a set standing as the smallest that has it: their roots are the answer, and nothing is joined on one
    ids = check.known.select("fp", "doc").where("doc is not null")
    near = links.join(ids.toDF("a", "da"), "a").join(ids.toDF("b", "db"), "b").select(F.least("da", "db").alias("a"), F.greatest("da", "db").alias("b"))
    roots = components(near).withColumnRenamed("node", "doc")
    named = settle(check.known.select("fp", "doc").join(roots, "doc", "left").select("fp", F.coalesce("root", "doc").alias("component_id")), "named")
    return signed.select("doc_id", "n", "fp").join(named, "fp", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id")
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """Of each component the document with the smallest id, with all columns; the rest of the texts isn't shuffled."""
    found = jaccard_components(docs, id_col, text_col, **how)
    drop = settle(found.where("doc_id <> component_id").select(F.col("doc_id").alias("__kw_drop")).distinct(), "drop")
    sure, maybe = bitset.split(docs, F.xxhash64(ident(docs, id_col)), drop, F.xxhash64("__kw_drop"), drop.count())
    return sure.unionByName(maybe.join(drop, ident(maybe, id_col) == F.col("__kw_drop"), "left_anti"))
