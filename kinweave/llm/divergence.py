"""Operator 12: how far the sources of each language diverge, by integer-dictionary encoding.

Tasks count the terms of whole documents a (language, source) at a time; Spark adds the counts up by (language,
source, term) and deals the result by ranges of (language, term). In each range the terms that enough documents of
the language have are kept as sorted arrays, a chunk at a time; a term's id is its place in its chunk (by
``searchsorted``), a source's counts are a ``bincount`` of ids. Ids follow the terms' UTF-8 order, so taking the
highest values of a chunk in the order of ids breaks ties as asked. A chunk is stored as one row of arrays with all
its sources; read again with the sizes of all groups, it becomes a dense table of sources by terms, and every pair
of sources is compared by whole vectors. A chunk has 2^18 cells at most (one term at least), however long the
language's list of terms is; a source with a third of all documents has no longer a vector than any other.

Arithmetic is exact: 64-bit integers, long division in base 1,000 for the scaled shares. It holds for counts up to
10^15 and up to 10^9 kept terms a language.

Defined cases: null text, lang and source are empty strings; a document without terms makes its group occur; a
group without kept terms has the share of a count of 0 everywhere; a language without kept terms has pairs of value
0 and no terms; a source alone in its language has no pairs; each repeated row is a document; very long texts are
split as bytes; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import settle
from .textkit import tidied

LEAST_DOCUMENTS, TERMS_SHOWN = 3, 200
SCALE_STEPS = 3  # shares are scaled by 1000 ** 3
CELLS = 1 << 18
#: Distinct terms a task holds before it passes its counts on.
HELD = 200_000
COUNTS = "lang string, source string, term string, n long, documents long"
CHUNKS = "lang string, terms array<string>, sources array<string>, sums array<long>, source_ids array<int>, term_ids array<int>, counts array<long>"
FOUND = "lang string, source string, part string, item string, value long"
#: A-Z to a-z; a-z and the bytes of characters beyond ASCII stay; all else parts terms.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def _arrow(schema: str) -> pa.Schema:
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32()}
    each = (f.split(" ") for f in schema.split(", "))
    return pa.schema([(n, pa.list_(kinds[k[6:-1]]) if k.startswith("array") else kinds[k]) for n, k in each])


def term_counts(documents: DataFrame) -> DataFrame:
    """(lang, source, term, n, documents): how often each term occurs in a group, and in how many of its documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def out():
            for (lang, source), (n, d) in held.items():
                terms = pa.array(list(n), pa.binary()).cast(pa.string())
                values = [pa.array([lang] * len(n), pa.string()), pa.array([source] * len(n), pa.string()), terms, pa.array(list(n.values()), pa.int64()), pa.array([d[t] for t in n], pa.int64())]
                yield pa.RecordBatch.from_arrays(values, schema=_arrow(COUNTS))
            held.clear()

        for batch in batches:
            langs, sources, texts = (batch.column(i) for i in range(3))
            for i in range(batch.num_rows):
                terms = texts[i].as_py().encode().translate(_TABLE).split()
                if terms:
                    n, d = held.setdefault((langs[i].as_py(), sources[i].as_py()), (Counter(), Counter()))
                    n.update(terms)
                    d.update(set(terms))
            if sum(len(n) for n, _ in held.values()) >= HELD:
                yield from out()
        yield from out()

    blank = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    each = documents.select(blank("lang"), blank("source"), blank("text")).mapInArrow(tidied(run), COUNTS)
    return each.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("documents").alias("documents"))


def _starts(*columns: pa.ChunkedArray) -> np.ndarray:
    """Where a sorted table's values differ from the row before; the first row counts."""
    found = np.ones(len(columns[0]), bool)
    found[1:] = False
    for c in columns:
        found[1:] |= pc.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False) if len(c) > 1 else False
    return found


def chunks(batches: Iterator[pa.RecordBatch], terms: int) -> Iterator[pa.Table]:
    """Rows in the order of (lang, term), cut where a language ends and after each so many terms of it."""
    rest = None
    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        t = pa.concat_tables([rest, t]).combine_chunks() if rest is not None else t
        lang = _starts(t["lang"])
        first = np.flatnonzero(_starts(t["lang"], t["term"]))
        language = np.cumsum(lang)[first]
        place = np.arange(len(first)) - np.searchsorted(language, language)
        cuts = first[place % terms == 0]
        for a, b in zip(cuts, cuts[1:]):
            yield t.slice(a, b - a)
        rest = t.slice(cuts[-1])
    if rest is not None:
        yield rest


def encode(counts: DataFrame, terms: int, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """CHUNKS: the kept terms in sorted arrays, and of each source the ids and counts of those it has."""
    kind = _arrow(CHUNKS)

    def run(batches):
        for t in chunks(batches, terms):
            first = np.flatnonzero(_starts(t["term"]))
            kept = first[np.add.reduceat(t["documents"].to_numpy(), first) >= least]
            if not len(kept):
                continue
            words = t["term"].take(pa.array(kept)).cast(pa.binary()).to_numpy(zero_copy_only=False)
            each = t["term"].cast(pa.binary()).to_numpy(zero_copy_only=False)
            ids = np.minimum(np.searchsorted(words, each), len(words) - 1)
            mine = words[ids] == each
            ids, n = ids[mine], t["n"].to_numpy()[mine]
            sources = t["source"].to_numpy(zero_copy_only=False)[mine].astype(object)
            names = np.array(sorted(set(sources)), object)
            of = np.searchsorted(names, sources)
            sums = np.zeros(len(names), np.int64)
            np.add.at(sums, of, n)
            row = {
                "lang": [t["lang"][0].as_py()], "terms": [[w.decode() for w in words]], "sources": [list(names)], "sums": [sums],
                "source_ids": [of.astype(np.int32)], "term_ids": [ids.astype(np.int32)], "counts": [n],
            }
            yield pa.RecordBatch.from_arrays([pa.array(row[f.name], f.type) for f in kind], schema=kind)

    dealt = counts.repartitionByRange("lang", "term").sortWithinPartitions("lang", "term")
    return dealt.mapInArrow(tidied(run), CHUNKS)


def scaled(count: np.ndarray, total) -> np.ndarray:
    """floor(10^9 * count / total), exactly; counts up to 10^15."""
    whole, left = np.divmod(count, total)
    for _ in range(SCALE_STEPS):
        digits, left = np.divmod(left * 1000, total)
        whole = whole * 1000 + digits
    return whole


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def compare(encoded: DataFrame, languages: DataFrame, shown: int) -> DataFrame:
    """FOUND: a chunk's part of the value of every pair of sources, and its highest terms of every source."""

    def rows(lang, source, part, items, values):
        n = len(items)
        return pa.RecordBatch.from_arrays([pa.array([lang] * n, pa.string()), pa.array([source] * n, pa.string()), pa.array([part] * n, pa.string()), pa.array(items, pa.string()), pa.array(values, pa.int64())], schema=_arrow(FOUND))

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                lang, words, names = r["lang"], np.array(r["terms"], object), [m["source"] for m in r["members"]]
                sizes = np.array([m["n"] for m in r["members"]], np.int64)
                place = np.searchsorted(np.array(names, object), np.array(r["sources"], object))
                counts = np.zeros((len(names), len(words)), np.int64)
                # each (source, term) occurs once, so a bincount of cells is exact below 2^53
                cells = place[np.array(r["source_ids"])] * len(words) + np.array(r["term_ids"])
                counts[:] = np.bincount(cells, np.array(r["counts"], np.float64), counts.size).reshape(counts.shape)
                p = 1 + scaled(counts + 1, sizes[:, None] + r["v"])
                q = 1 + scaled(counts.sum(0) + 1, np.int64(sizes.sum() + r["v"]))
                for a, name in enumerate(names):
                    with_others = divergence(p[a], p).sum(1)
                    yield rows(lang, name, "pair", names[:a] + names[a + 1 :], np.delete(with_others, a))
                    more = np.flatnonzero((counts[a] > 0) & (p[a] > q))
                    value = divergence(p[a][more], q[more])
                    best = np.argsort(-value, kind="stable")[:shown]  # ids are in UTF-8 order, and so are ties
                    yield rows(lang, name, "term", words[more[best]], value[best])

    return encoded.join(languages, "lang").mapInArrow(tidied(run), FOUND)


def audit(documents: DataFrame, least: int = LEAST_DOCUMENTS, shown: int = TERMS_SHOWN) -> DataFrame:
    """(lang, source, part, item, value, rank) of every (lang, source) group: all other sources of the language, and its ``shown`` most telling terms."""
    blank = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    groups = settle(documents.select(blank("lang"), blank("source")).distinct(), "groups")
    most = groups.groupBy("lang").count().agg(F.max("count")).collect()[0][0] or 1
    counts = settle(term_counts(documents), "term-counts")
    encoded = settle(encode(counts, max(1, CELLS // most), least), "chunks")
    sums = encoded.select("lang", F.explode(F.arrays_zip("sources", "sums")).alias("x")).groupBy("lang", F.col("x.sources").alias("source")).agg(F.sum("x.sums").alias("n"))
    terms = encoded.groupBy("lang").agg(F.sum(F.size("terms")).cast("long").alias("v"))
    members = groups.join(sums, ["lang", "source"], "left").select("lang", "source", F.coalesce("n", F.lit(0)).alias("n"))
    languages = members.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("source", "n"))).alias("members")).join(terms, "lang", "left")
    languages = settle(languages, "languages")
    found = settle(compare(encoded, languages, shown), "divergence")
    # pairs of languages without kept terms are in no chunk: every pair begins with 0
    one = languages.select("lang", F.explode("members.source").alias("source"), "members")
    none = one.select("lang", "source", F.explode("members.source").alias("item"), F.lit(0).cast("long").alias("value")).where("source <> item")
    pairs = found.where("part = 'pair'").select("lang", "source", "item", "value").unionByName(none).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    telling = found.where("part = 'term'").select("lang", "source", "item", "value")
    shape = lambda rows, part: _ranked(rows).select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
    return shape(pairs, "pair").unionByName(shape(telling, "term").where(F.col("rank") <= shown))


def _ranked(rows: DataFrame) -> DataFrame:
    w = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    rank: Column = F.row_number().over(w)
    return rows.withColumn("rank", rank)
