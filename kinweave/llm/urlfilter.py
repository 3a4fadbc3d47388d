"""Operator 13: exact URL lists by a cascade of Bloom filters.

A rule is a host, the beginning of a path, and a verdict. It fits its host and all subdomains where the URL's
path begins with its own; of the rules that fit the longest wins (in characters of host and path), and of two
verdicts on one rule "block". A URL that no rule fits isn't listed: it is allowed.

The keys a URL can be listed under are its host's suffixes (whole labels) joined with its path's prefixes, of the
lengths that rules have. The keys of all URLs of the corpus are the universe. The first level of a cascade holds
the listed keys; the second the keys of the universe that the first takes for listed; the third the listed keys
that the second takes for those; and so on until a level mistakes no key. The first level that doesn't hold a key
then tells for certain whether it is listed, without a join. There is a cascade for each verdict. One pass over
the corpus builds the first level's mistakes; each later level works on what the one before mistook, about half.

Levels come to the driver and go to the tasks as bit arrays: some 2.5 bytes a listed key at a universe of a
thousand times as many keys, and never more than ``most_bytes`` (64 MB) a verdict, else an error says so before
anything is built. Keys are told apart by 128 bits of hash; should two keys share them all, building fails rather
than guesses.

Defined cases: a null URL or one without "://" has empty host and path and fits no rule; an empty host neither; a
rule whose path isn't empty and doesn't begin with "/" fits nothing; no rules allow everything; repeated rows are
judged each for itself; an empty table gives an empty result; columns that are not read don't matter.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import settle
from .textkit import mix

RULES = "host string, path string, verdict string"
MOST_BYTES = 64 << 20
MOST_LEVELS = 200
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host with A-Z lowered, path) of a URL; both empty if there is no "://"."""
    u = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(u, "://([^/?#]*)", 1), _UPPER, _LOWER), F.regexp_extract(u, "://[^/?#]*([^?#]*)", 1)


def candidates(host: Column, path: Column, host_lengths: list[int], path_lengths: list[int]) -> Column:
    """The keys a URL can be listed under, the longest first."""
    long = lambda xs: F.array(*[F.lit(x) for x in xs]).cast("array<int>")
    whole = lambda n: (n == F.length(host)) | (F.substring(host, F.length(host) - n, F.lit(1)) == ".")
    fitting = F.filter(long(host_lengths), lambda n: (n <= F.length(host)) & (n > 0) & whole(n))
    ends = F.transform(fitting, lambda n: F.substring(host, F.length(host) - n + 1, n))
    starts = F.transform(F.filter(long(path_lengths), lambda n: n <= F.length(path)), lambda n: F.substring(path, F.lit(1), n))
    keys = F.flatten(F.transform(ends, lambda e: F.transform(starts, lambda s: F.concat(e, s))))
    return F.transform(F.sort_array(F.transform(keys, lambda k: F.struct(F.length(k).alias("n"), k.alias("k"))), asc=False), lambda x: x["k"])


def hashes(key: Column) -> tuple[Column, Column]:
    """Two 64-bit numbers that stand for a key."""
    return F.xxhash64(key), F.xxhash64(F.lit(13), key)


def hashed(keys: str) -> tuple[Column, Column]:
    """The same of each of an array of keys."""
    return F.transform(keys, lambda k: hashes(k)[0]), F.transform(keys, lambda k: hashes(k)[1])


@dataclass
class Level:
    """A Bloom filter of ``keys`` keys that mistakes about ``rate`` of the others."""

    number: int
    keys: int
    rate: float
    bits: int = 0
    probes: int = 0
    words: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))

    def __post_init__(self):
        self.probes = max(1, round(-math.log2(self.rate)))
        self.bits = 64 * max(1, math.ceil(self.keys * -math.log2(self.rate) / math.log(2) / 64))

    def places(self, h: np.ndarray, g: np.ndarray) -> list[np.ndarray]:
        """Where the bits of keys are; each level deals them anew."""
        salt = np.uint64(self.number)
        a = mix(h.view(np.uint64) ^ mix(g.view(np.uint64) + salt * np.uint64(0x9E3779B97F4A7C15)))
        b = mix(g.view(np.uint64) ^ mix(h.view(np.uint64) + salt * np.uint64(0xD6E8FEB86659FD93))) | np.uint64(1)
        return [(a + np.uint64(i) * b) % np.uint64(self.bits) for i in range(self.probes)]

    def holds(self, h: np.ndarray, g: np.ndarray) -> np.ndarray:
        found = np.ones(len(h), bool)
        for at in self.places(h, g):
            found &= (self.words[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1
        return found

    def fill(self, keys: DataFrame) -> None:
        """Set the bits of all keys (h, g): words are put together by Spark, only they come to the driver."""
        places = self.places

        def run(batches):
            for b in batches:
                at = np.unique(np.concatenate(places(b.column(0).to_numpy(), b.column(1).to_numpy())))
                yield pa.RecordBatch.from_arrays([pa.array((at >> np.uint64(6)).astype(np.int64)), pa.array((at & np.uint64(63)).astype(np.int32))], ["word", "bit"])

        marked = keys.select("h", "g").mapInArrow(run, "word long, bit int")
        made = marked.groupBy("word").agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit"))).alias("v")).toArrow()
        self.words = np.zeros(self.bits >> 6, np.uint64)
        self.words[made["word"].to_numpy()] = made["v"].to_numpy().view(np.uint64)


@dataclass
class Cascade:
    """Levels in turn; those with odd numbers hold listed keys, the others keys of the universe that aren't."""

    levels: list[Level] = field(default_factory=list)

    def member(self, h: np.ndarray, g: np.ndarray) -> np.ndarray:
        listed, open_ = np.zeros(len(h), bool), np.arange(len(h))
        for level in self.levels:
            held = level.holds(h[open_], g[open_])
            listed[open_[~held]] = level.number % 2 == 0
            open_ = open_[held]
        listed[open_] = len(self.levels) % 2 == 1
        return listed

    @property
    def bytes(self) -> int:
        return sum(level.bits // 8 for level in self.levels)


def flags(spark: SparkSession, test) -> callable:
    """A column function: for arrays of hashes, an array of what ``test`` (a level or a cascade) says."""
    shared = spark.sparkContext.broadcast(test)

    @F.arrow_udf("array<boolean>")
    def run(h: pa.Array, g: pa.Array) -> pa.Array:
        said = shared.value
        ask = said.member if isinstance(said, Cascade) else said.holds
        values = ask(h.flatten().to_numpy(zero_copy_only=False), g.flatten().to_numpy(zero_copy_only=False))
        return pa.ListArray.from_arrays(_from_zero(h.offsets), pa.array(values))

    return run


def _from_zero(offsets: pa.Array) -> pa.Array:
    """Offsets of a part of a list column, from 0 on."""
    at = offsets.to_numpy()
    return pa.array(at - at[0], pa.int32())


def build(listed: DataFrame, corpus: DataFrame, universe: int, most_bytes: int = MOST_BYTES) -> Cascade:
    """The cascade of the keys ``listed`` (key) over the keys of ``corpus`` (keys array<string>), of which there are about ``universe``."""
    spark = corpus.sparkSession
    h, g = hashes(F.col("key"))
    held = settle(listed.select(h.alias("h"), g.alias("g")).distinct(), "listed")
    n = held.count()
    cascade = Cascade()
    if not n:
        return cascade
    level = Level(1, n, min(0.5, math.sqrt(0.5) * n / max(universe, 1)))
    # the levels after the first add about as much as half of two bits a key of the first
    if (level.bits + 5 * n) // 8 > most_bytes:
        raise ValueError(f"a filter of {n} keys takes more than {most_bytes} bytes; judge by parts of the list")
    level.fill(held)
    cascade.levels.append(level)
    # the one pass over the universe: which of its keys does the first level mistake?
    hs, gs = hashed("keys")
    asked = corpus.select("keys", hs.alias("hs"), gs.alias("gs")).withColumn("hit", flags(spark, level)("hs", "gs"))
    asked = asked.select(F.explode(F.filter(F.arrays_zip("hs", "gs", "hit"), lambda x: x["hit"])).alias("x"))
    wrong = asked.select(F.col("x.hs").alias("h"), F.col("x.gs").alias("g")).distinct().join(held, ["h", "g"], "left_anti")
    inside, outside = held, settle(wrong, "mistaken")
    n = outside.count()
    while n:
        if level.number == MOST_LEVELS:
            raise ValueError("a listed key and another have the same hashes")
        level = Level(level.number + 1, n, 0.5)
        level.fill(outside)
        cascade.levels.append(level)
        hit = F.element_at(flags(spark, level)(F.array("h"), F.array("g")), 1)
        inside, outside = outside, settle(inside.where(hit), "mistaken")
        n = outside.count()
    return cascade


def judge(pages: DataFrame, rules: DataFrame, url: str = "url", most_bytes: int = MOST_BYTES) -> DataFrame:
    """The rows of ``pages`` with host, path, rule (null if none fits) and verdict, by rules(host, path, verdict).

    These four replace columns of the same names.
    """
    spark = pages.sparkSession
    r = rules.select(F.translate("host", _UPPER, _LOWER).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict")
    r = settle(r.where((F.length("host") > 0) & ((F.col("path") == "") | F.startswith("path", F.lit("/")))), "rules")
    shape = r.agg(*[F.sort_array(F.collect_set(F.length(c))).alias(c) for c in ("host", "path")]).collect()[0]  # lengths, no more than the longest rule has characters
    host, path = url_parts(F.col(url))
    rows = pages.withColumns({"host": host, "path": path})
    keys = candidates(F.col("host"), F.col("path"), shape.host, shape.path)
    corpus = pages.select(*[c.alias(n) for c, n in zip(url_parts(F.col(url)), ("host", "path"))]).select(keys.alias("keys"))
    universe = corpus.agg(F.sum(F.size("keys"))).collect()[0][0] or 0
    hs, gs = hashed("__kw_keys")
    rows = rows.withColumn("__kw_keys", keys).withColumns({"__kw_h": hs, "__kw_g": gs})
    listed = r.select(F.concat("host", "path").alias("key"), "verdict")
    for verdict in ("block", "allow"):
        cascade = build(listed.where(F.col("verdict") == verdict), corpus, universe, most_bytes)
        found = F.array_position(flags(spark, cascade)("__kw_h", "__kw_g"), F.lit(True)) if cascade.levels else F.lit(0).cast("long")
        rows = rows.withColumn(f"__kw_{verdict}", found)
    block, allow = (F.when(F.col(f"__kw_{v}") > 0, F.col(f"__kw_{v}")) for v in ("block", "allow"))
    first = F.least(block, allow)  # of the place of the longest key in each list, the smaller; nulls don't count
    rows = rows.withColumns({"rule": F.get("__kw_keys", (first - 1).cast("int")), "verdict": F.when(block == first, "block").otherwise("allow")})
    return rows.drop("__kw_keys", "__kw_h", "__kw_g", "__kw_block", "__kw_allow")


#: The list that the query judges by.
LISTED = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def url_report(pages: DataFrame, listed: list[tuple[str, str, str]] = LISTED) -> DataFrame:
    """page_id, host, path, rule, verdict of every row."""
    rules = pages.sparkSession.createDataFrame(listed, RULES)
    return judge(pages.select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict")
