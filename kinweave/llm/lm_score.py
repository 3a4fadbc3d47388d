"""Operator 9: stupid-backoff scores computed relationally.

Words (runs of letters and digits, lower-cased) and bigrams are counted over all documents, each
by a 63-bit hash: one table of counts, partitioned by hash. Every document becomes its distinct
bigrams with what it has of them itself; those are joined to the counts, and the parts summed per
document. The document's own counts are taken off before it is scored, else no bigram would ever
back off.

score(w2 | w1) = f(w1 w2) / f(w1), or ALPHA * f(w2) / N where the bigram is found in no other
document; the first word has f(w) / N; a word found in no other document counts as half an
occurrence. No word or bigram is left out or pooled with others.

Three tables of bounded size save most of the join and change no result: the counts of the most
frequent bigrams (``hot`` at most) and words (``head`` at most) are looked up where the documents
are, and a bit filter of repeated n-grams tells there which of the others surely occur nowhere
else. The filter has MOST_BITS at most; a corpus with more n-grams than it is good for does
without it, and joins them all. What is left to join is rarer than the frequent ones, so no key
is hot.

Defined cases: null, empty or wordless texts have n_tokens 0 and log_score 0 (mean null);
repeated rows are documents of their own, also those that repeat an id; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import settle
from .textkit import ALNUM, Words, blocks, mix, tidied

ALPHA = 0.4
#: Counts sent to every task: 16 bytes each.
HEAD, HOT = 1 << 18, 1 << 19
#: Bits of the filter, at least and at most (32 MB); below PER_KEY bits a key it isn't worth its while.
LEAST_BITS, MOST_BITS, PER_KEY = 1 << 18, 1 << 28, 3
_PAGE = 1 << 15  # bits that both places of a key lie within
#: n-grams that a task counts together before it passes them on.
TOGETHER = 1 << 21
_WORD = np.uint64(1 << 63)


def _ids(words: Words) -> np.ndarray:
    """Words' hashes, with the highest bit set: negative as signed numbers."""
    return words.hashes | _WORD


def _bigrams(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(places of the first words, hashes) of all bigrams; their highest bit isn't set."""
    at = np.flatnonzero(words.owner[:-1] == words.owner[1:])
    h = _ids(words)
    return at, mix(h[at] * np.uint64(3) + h[at + 1]) >> np.uint64(1)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def ngram_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(code, n): how often each word (a negative code) and each bigram occurs in all documents."""

    def counted(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        codes, n = np.unique(np.concatenate(held), return_counts=True)
        held.clear()
        for lo in range(0, len(codes), 1 << 16):
            yield pa.RecordBatch.from_arrays([_signed(codes[lo : lo + (1 << 16)]), pa.array(n[lo : lo + (1 << 16)], pa.int64())], ["code", "n"])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for _, _, data, offsets in blocks(batch.column(0)):
                words = Words(data, offsets, ALNUM)
                held += [_ids(words), _bigrams(words)[1]]
                size += 2 * len(words.hashes)
                if size > TOGETHER:
                    yield from counted(held)
                    size = 0
        if held:
            yield from counted(held)

    return docs.select(text_col).mapInArrow(tidied(run), "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


def _least(sizes: list, most: int) -> int:
    """From which count on at most ``most`` n-grams are that frequent, by (n, how many) with n descending."""
    so_far, least = 0, 1 << 62
    for r in sizes:
        so_far += r["many"]
        if so_far > most:
            break
        least = r["n"]
    return least


def _places(codes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The two places of a hash in a filter, both in one page."""
    spread = mix(codes)
    page = (spread & np.uint64(bits // _PAGE - 1)) * np.uint64(_PAGE)
    return tuple((page + (spread >> np.uint64(by) & np.uint64(_PAGE - 1))).astype(np.int64) for by in (33, 48))


def _filter(keys: DataFrame, bits: int) -> np.ndarray:
    """A bit filter of the codes of a table: pages are made apart, and come to the driver once (bits / 8 bytes)."""

    def run(batches):
        found = np.zeros(bits // 8, np.uint8)  # memory is taken only for pages that are touched
        touched = np.zeros(bits // _PAGE, bool)
        for batch in batches:
            for at in _places(batch.column(0).to_numpy().view(np.uint64), bits):
                np.bitwise_or.at(found, at >> 3, np.uint8(1) << (at & 7).astype(np.uint8))
                touched[at // _PAGE] = True
        pages = np.flatnonzero(touched)
        for lo in range(0, len(pages), 256):
            some = pages[lo : lo + 256]
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array([found[p * _PAGE // 8 : (p + 1) * _PAGE // 8].tobytes() for p in some])], ["page", "bitmap"])

    def paged(batches):
        for batch in batches:
            codes = batch.column(0)
            spread = mix(codes.to_numpy().view(np.uint64)) & np.uint64(bits // _PAGE - 1)
            yield pa.RecordBatch.from_arrays([codes, pa.array(spread.astype(np.int64))], ["code", "page"])

    each = keys.select("code").mapInArrow(tidied(paged), "code long, page long").repartition("page").mapInArrow(tidied(run), "page long, bitmap binary")
    table = each.toArrow()
    out = np.zeros((bits // _PAGE, _PAGE // 8), np.uint8)
    for page, bitmap in zip(table.column("page").to_numpy(), table.column("bitmap")):
        out[page] = np.frombuffer(bitmap.as_buffer(), np.uint8)
    return out.ravel()


@dataclass
class Known:
    """What every task knows: sorted codes and counts of frequent words and bigrams, and the filter of other repeated bigrams."""

    words: np.ndarray
    word_n: np.ndarray
    pairs: np.ndarray
    pair_n: np.ndarray
    bits: np.ndarray | None

    @staticmethod
    def _look(table: np.ndarray, values: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Counts of sorted codes; -1 where they aren't known."""
        if not len(table):
            return np.full(len(codes), -1)
        at = np.minimum(np.searchsorted(table, codes), len(table) - 1)
        return np.where(table[at] == codes, values[at], -1)

    def of_words(self, codes: np.ndarray) -> np.ndarray:
        return self._look(self.words, self.word_n, codes)

    def of_pairs(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(counts, whether a bigram whose count isn't known may be repeated)."""
        n = self._look(self.pairs, self.pair_n, codes)
        maybe = n < 0
        if self.bits is not None:
            for at in _places(codes, len(self.bits) * 8):
                maybe &= (self.bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
        return n, maybe


#: Rows of one table, told apart by what is null. A document: code (only to spread it), g1 tokens, g2 backoffs so far,
#: s its score so far, id. A bigram still to be joined: code, times, g1 and g2 the counts elsewhere of its words;
#: where a word's count isn't known, w1 or w2 is its code and g1 or g2 its count here. A word still to be joined:
#: code, times, g1 its count here, g2 1 if its bigram was found.
_ROWS = "row long, code long, times int, g1 long, g2 long, w1 long, w2 long, s double"


def _unique(owner: np.ndarray, inner: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first places, inverse, counts) of distinct pairs of an owner and a number below ``width``."""
    _, first, back, n = np.unique(owner * width + inner, return_index=True, return_inverse=True, return_counts=True)
    return first, back, n


def _look_up(known: Known, words: Words) -> tuple[list[np.ndarray], list[np.ndarray], list[np.ndarray]]:
    """A block's documents (tokens, backoffs, score), bigrams and words that are still to be joined, as columns."""
    docs, of, ids = len(words.counts), words.owner, _ids(words)
    codes, local = np.unique(ids, return_inverse=True)
    f = known.of_words(codes)
    first, back, n = _unique(of, local, len(codes))
    own = n[back]
    s, b = np.zeros(docs), np.zeros(docs, np.int64)

    def word_part(doc, word, here, times, found) -> list[np.ndarray]:
        """Sum what is known of words; the rest is still to be joined."""
        seen = f[word] >= 0
        value = f[word] - here
        part = np.where(found, -np.log(np.maximum(value, 1)), np.log(np.maximum(value, 0.5))) * times
        s[:] += np.bincount(doc[seen], part[seen], docs)
        left = np.flatnonzero(~seen)
        doc, word, here, times, found = (x[left] for x in (doc, word, here, times, found))
        one, where, _ = _unique(doc * 2 + found, word, len(codes))
        return [doc[one], codes[word[one]], np.bincount(where, times, len(one)).astype(np.int64), here[one], found[one].astype(np.int64)]

    full = np.flatnonzero(words.counts)
    at = words.offsets[:-1][full]
    yes = lambda like, value: np.full(len(like), value)
    rare = [word_part(full, local[at], own[at], np.ones(len(full), np.int64), yes(full, False))]
    at, pair = _bigrams(words)
    pairs, where = np.unique(pair, return_inverse=True)
    first, _, times = _unique(of[at], where, max(len(pairs), 1))
    at, where = at[first], where[first]
    n, maybe = known.of_pairs(pairs)
    n, maybe = n[where], maybe[where]
    doc, w1, w2 = of[at], local[at], local[at + 1]
    hit = n > times
    s += np.bincount(doc[hit], np.log((n - times)[hit]) * times[hit], docs)
    rare.append(word_part(doc[hit], w1[hit], own[at[hit]], times[hit], yes(w1[hit], True)))
    miss = ~hit & ~maybe
    b += np.bincount(doc[miss], times[miss], docs).astype(np.int64)
    rare.append(word_part(doc[miss], w2[miss], own[at[miss] + 1], times[miss], yes(w2[miss], False)))
    far = np.flatnonzero(maybe & ~hit)
    columns = [doc[far], pairs[where[far]], times[far]]
    for w, here in ((w1[far], own[at[far]]), (w2[far], own[at[far] + 1])):
        seen = f[w] >= 0
        columns += [np.where(seen, f[w] - here, here), seen, codes[w]]
    return [words.counts, b, s], columns, [np.concatenate(c) for c in zip(*rare)]


def _rows(docs: DataFrame, known: Known, id_col: str, text_col: str) -> DataFrame:
    """The documents and all that is still to be joined, as _ROWS and id."""
    sent = docs.sparkSession.sparkContext.broadcast(known)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    names = [c.split(" ")[0] for c in _ROWS.split(", ")]
    schema = type(rows.schema).fromDDL(_ROWS).add(rows.schema["id"])
    kinds = [pa.int64(), pa.int64(), pa.int32(), *[pa.int64()] * 4, pa.float64()]

    def batch_of(kind: pa.DataType, ids: pa.Array | None, **columns) -> pa.RecordBatch:
        n = len(columns["row"])
        made = [pa.nulls(n, t) if columns.get(c) is None else pa.array(columns[c], t) if isinstance(columns[c], np.ndarray) else columns[c] for c, t in zip(names, kinds)]
        return pa.RecordBatch.from_arrays([*made, pa.nulls(n, kind) if ids is None else ids], [*names, "id"])

    def run(batches):
        next_row = TaskContext.get().partitionId() << 33
        for batch in batches:
            kind = batch.column(0).type
            for lo, hi, data, offsets in blocks(batch.column(1)):
                base, next_row = next_row, next_row + hi - lo
                (tokens, b, s), (doc, code, times, g1, seen1, w1, g2, seen2, w2), (of, word, n, here, found) = _look_up(sent.value, Words(data, offsets, ALNUM))
                row = np.arange(base, next_row)
                yield batch_of(kind, batch.column(0).slice(lo, hi - lo), row=row, code=(mix(row.view(np.uint64)) >> np.uint64(1)).view(np.int64), g1=tokens, g2=b, s=s)
                unless = lambda w, seen: pa.array(w.view(np.int64), pa.int64(), mask=seen)
                yield batch_of(kind, None, row=base + doc, code=code.view(np.int64), times=times, g1=g1, g2=g2, w1=unless(w1, seen1), w2=unless(w2, seen2))
                yield batch_of(kind, None, row=base + of, code=word.view(np.int64), times=n, g1=here, g2=found)

    return rows.mapInArrow(tidied(run), schema)


def _word_part(found: Column, n: Column, less: Column) -> Column:
    """What a word's count gives to a score. A word without a count occurs once, so here alone."""
    rest = F.coalesce(n - less, F.lit(0))
    return F.when(found, -F.log(F.greatest(rest, F.lit(1)).cast("double"))).otherwise(F.log(F.greatest(rest.cast("double"), F.lit(0.5))))


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT, head: int = HEAD) -> DataFrame:
    """One row per document: doc_id, n_tokens, n_backoff, log_score, mean_log_score."""
    counts = settle(ngram_counts(docs, text_col).where("n > 1"), "counts")  # what occurs once needs no count
    word = F.col("code") < 0
    sizes = counts.groupBy(word.alias("word"), "n").agg(F.count(F.lit(1)).alias("many")).orderBy(F.desc("n")).limit(200_000).collect()
    least_word, least_pair = (_least([r for r in sizes if r.word == kind], most) for kind, most in ((True, head), (False, hot)))
    frequent = F.col("n") >= F.when(word, least_word).otherwise(least_pair)
    top = counts.where(frequent).toArrow()  # hot + head rows at most
    codes, n = top.column("code").to_numpy().view(np.uint64), top.column("n").to_numpy()
    order = np.argsort(codes)
    codes, n = codes[order], n[order]
    cut = int(np.searchsorted(codes, _WORD))  # as unsigned numbers words come last
    rest = counts.where(~frequent)
    keys = rest.where(~word).count()
    bits = LEAST_BITS
    while bits < MOST_BITS and bits < 12 * keys:
        bits *= 2
    known = Known(codes[cut:], n[cut:], codes[:cut], n[:cut], _filter(rest.where(~word), bits) if keys * PER_KEY <= bits else None)
    rows = _rows(docs, known, id_col, text_col).join(rest, "code", "left")
    document, single = F.col("times").isNull(), F.col("code") < 0
    found = F.when(single, F.col("g2") == 1).otherwise(F.coalesce(F.col("n") > F.col("times"), F.lit(False)))
    w = F.when(document | single, F.lit(None)).when(found, F.col("w1")).otherwise(F.col("w2"))
    g = F.when(found, F.col("g1")).otherwise(F.col("g2"))  # of a bigram: the count elsewhere of the word it needs
    pair = F.when(found, F.log((F.col("n") - F.col("times")).cast("double"))).otherwise(0.0)
    pair = pair + F.when(w.isNotNull(), 0.0).otherwise(_word_part(found, g, F.lit(0)))
    s = F.when(document, F.col("s")).otherwise(F.col("times") * F.when(single, _word_part(found, F.col("n"), F.col("g1"))).otherwise(pair))
    b = F.when(document, F.col("g2")).when(single | found, 0).otherwise(F.col("times"))
    rows = rows.select(
        "row", "id", F.when(document, F.col("g1")).alias("tokens"), s.alias("s"), b.cast("long").alias("b"),
        w.alias("w"), F.when(w.isNotNull(), found).alias("found"), F.when(w.isNotNull(), g).alias("less"), F.when(w.isNotNull(), F.col("times")).alias("times"),
    )
    sums = [F.max("id").alias("id"), F.max("tokens").alias("tokens"), F.sum("s").alias("s"), F.sum("b").alias("b")]
    # one row a document, and one for each rare word of a joined bigram, whose count is still to come
    parts = settle(rows.groupBy("row", "w", "found").agg(*sums, F.max("less").alias("less"), F.sum("times").alias("times")), "parts")
    words = parts.where("w is not null").join(rest.select(F.col("code").alias("w"), "n"), "w", "left")
    words = words.select("row", (_word_part(F.col("found"), F.col("n"), F.col("less")) * F.col("times")).alias("s"), F.lit(0).cast("long").alias("b"))
    none = [F.lit(None).cast(parts.schema[c].dataType).alias(c) for c in ("id", "tokens")]
    each = parts.select("row", "id", "tokens", "s", "b").unionByName(words.select("row", *none, "s", "b"))
    done = settle(each.groupBy("row").agg(*sums), "scores")
    total = done.agg(F.sum("tokens")).collect()[0][0] or 0
    others = F.log(F.greatest(F.lit(total) - F.col("tokens"), F.lit(1)).cast("double"))
    score = F.col("s") + F.col("b") * math.log(ALPHA) - (F.col("b") + F.when(F.col("tokens") > 0, 1).otherwise(0)) * others
    return done.select(
        F.col("id").alias("doc_id"), F.col("tokens").alias("n_tokens"), F.col("b").alias("n_backoff"), score.alias("log_score"),
        F.when(F.col("tokens") > 0, score / F.col("tokens")).alias("mean_log_score"),
    )
