"""Operator 6: toxicity by class-conditional Kneser-Ney models.

Two bigram models, of toxic and of ordinary documents, discount their counts and back off to
their class's words, and from there to shared continuation counts (how many different words a
word follows in either class). Each level may add to the weight of the shared order below it, by
an amount chosen on documents that the counts leave out, so that a rare word says little. A
document's
numbers are differences of the two log-likelihoods over their number of words: of the whole
text, of its most toxic stretches of 5 and of 25 words, and of its 2nd and 4th most toxic word
(an insult in a long text is lost in a mean). A logistic curve, fitted on the same left-out
documents, turns them into a probability.

All labelled rows that aren't held out are counted, by Spark: three quarters of them word by word and
pair by pair, exactly; the others fit the curve, by Newton's steps whose sums Spark adds up. What comes
to the driver and goes to the tasks is bounded by its form, not by leaving rows out: each word has one of
``WORDS`` slots and each pair one of ``PAIRS``, by a hash (48 MB in all). Words or pairs of one slot share their
counts; the mass that chance puts into a slot of pairs (their median) is taken off, and a pair counts at
most as often as its two words. Words are runs of letters and digits, lower-cased.

Defined cases: a null text is scored as an empty one, an empty one from the share of toxic
labels and its length of 0; a label without a document and a null label teach nothing; of
several labels of a document the largest counts; without labels of both kinds every score is
the base rate; repeated rows are scored alike; an empty table gives an empty result; other
columns are carried along.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, SparkContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out, settle, within
from .quality import labelled_rows, training_rows
from .textkit import ALNUM, Words, blocks, lists, mix, tidied, with_columns

LIMIT = 0.5
WORDS = 1 << 20
PAIRS = 1 << 21
#: Places of a block that is sent as one row, blocks that come to the driver at a time (8 MB), and words or pairs that a task adds up at a time.
BLOCK, BLOCKS, AT_ONCE = 1 << 12, 128, 1 << 20
#: Where each table begins in the one row of places that Spark adds up. A word has (count of each class, words before it, 0), a head
#: (counts, kinds of words after it, of each class; one more slot is a document's start), a pair its discounted counts.
_HEADS, _PAIRS = WORDS, 2 * WORDS + BLOCK
DISCOUNT = 0.75
#: What each level adds to the weight of the order below: for words in sizes of the class, for
#: pairs in occurrences. The best on the fitting documents is taken.
PULLS = [(one, two) for one in (0.1, 0.5, 2.0, 8.0) for two in (30.0, 1000.0, 30_000.0)]
#: Words in the stretches whose most toxic one counts, beside the whole text.
STRETCHES = (5, 25)
INPUTS = 2 * (1 + len(STRETCHES) + 2) + 2


def _codes(words: Words) -> np.ndarray:
    """Of each word: the slot of the one before it (``WORDS`` at a document's start) and its own, as one number."""
    w = (words.hashes % np.uint64(WORDS)).astype(np.int64)
    h = np.concatenate([np.zeros(1, np.int64), w[:-1]])[: len(w)]
    h[words.offsets[:-1][words.counts > 0]] = WORDS
    return h * WORDS + w


def _moved(w: np.ndarray) -> np.ndarray:
    return (mix(w.astype(np.uint64)) % np.uint64(PAIRS)).astype(np.int64)


def _pair(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    """A pair's slot; with the second word it tells the first (see ``_head``)."""
    return (h + _moved(w)) % PAIRS


def _head(pair: np.ndarray, w: np.ndarray) -> np.ndarray:
    return (pair - _moved(w)) % PAIRS


@dataclass
class KneserNey:
    """Both classes' counts by slot; index 1 is toxic. ``pull`` is what each level adds to the
    weight of the order below (0 is plain Kneser-Ney)."""

    word_n: np.ndarray  # of each class, less the discount
    shared: np.ndarray  # continuation probability
    size: np.ndarray  # tokens of each class
    back: np.ndarray  # discounted mass of each class's words
    head_n: np.ndarray
    head_back: np.ndarray
    pair_n: np.ndarray  # less the discount, and less what chance puts there
    pull: tuple[float, float]
    curve: np.ndarray
    tables: tuple[SparkContext, Broadcast] | None = None

    def differences(self, words: Words, pulls: list[tuple[float, float]]) -> list[np.ndarray]:
        """For each pull, of each word: log-probability as toxic less as ordinary."""
        codes, back = np.unique(_codes(words), return_inverse=True)
        h, w = codes // WORDS, codes % WORDS
        shared, word_n, head_n, head_back = self.shared[w], self.word_n[:, w], self.head_n[:, h], self.head_back[:, h]
        pair_n = np.minimum(self.pair_n[:, _pair(h, w)], np.minimum(word_n, np.maximum(head_n - DISCOUNT, 0)))
        found = []
        for one, two in pulls:
            logs = []
            for c in (1, 0):
                low = (word_n[c] + (one * self.size[c] + self.back[c]) * shared) / ((one + 1) * self.size[c])
                logs.append(np.log((pair_n[c] + (two + head_back[c]) * low) / (two + head_n[c])))
            found.append((logs[0] - logs[1])[back])
        return found

    def inputs(self, words: Words, pulls: list[tuple[float, float]]) -> np.ndarray:
        """For each pull, of each document, the inputs of the curve: length-normalised
        differences of the whole text, of its most toxic stretches, and its length."""
        docs, n = len(words.counts), words.counts
        long = np.log1p(n) / 5
        found = []
        for x in self.differences(words, pulls):
            sums = np.concatenate([[0], np.cumsum(x)])
            total = sums[words.offsets[1:]] - sums[words.offsets[:-1]]
            columns = [total / np.maximum(n, 1)]
            for k in STRETCHES:
                best = np.where(n > 0, total / k, 0)
                at = np.flatnonzero(words.owner[: max(0, len(x) - k + 1)] == words.owner[k - 1 :]) if len(x) >= k else np.zeros(0, int)
                best[words.owner[at]] = -np.inf
                np.maximum.at(best, words.owner[at], (sums[at + k] - sums[at]) / k)
                columns.append(best)
            order = np.lexsort((-x, words.owner))
            for k in (2, 4):  # the k-th most toxic word
                column = np.zeros(docs)
                some = np.flatnonzero(n >= k)
                column[some] = x[order[words.offsets[some] + k - 1]]
                columns.append(column)
            found.append(np.column_stack([*columns, *[c * long for c in columns], long, np.ones(docs)]))
        return np.array(found)

    def sent(self, spark: SparkSession) -> Broadcast:
        """These tables at the executors. They are sent once: a model with another pull or curve uses the same (see ``with_curve``)."""
        if self.tables is None or self.tables[0] is not spark.sparkContext:
            self.tables = spark.sparkContext, spark.sparkContext.broadcast(self)
        return self.tables[1]

    def with_curve(self, pull: tuple[float, float], curve: np.ndarray) -> KneserNey:
        return replace(self, pull=pull, curve=curve)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"tables": None}

    def score(self, words: Words) -> np.ndarray:
        if not self.size.min():
            return np.full(len(words.counts), 1 / (1 + np.exp(-self.curve[-1])))
        return _curve(self.inputs(words, [self.pull])[0], self.curve)


def _curve(x: np.ndarray, b: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))


def _added(rows: DataFrame, curves: np.ndarray, weights: tuple[float, float]) -> np.ndarray:
    """For each pull: the logistic loss's gradient, its second derivatives and the loss itself, over all rows."""
    k, m = curves.shape

    def run(batches):
        total = np.zeros((k, m + m * m + 1))
        for batch in batches:
            y = batch.column(0).to_numpy(zero_copy_only=False).astype(float)
            x = batch.column(1).flatten().to_numpy().astype(float).reshape(len(y), k, m)
            weight = np.where(y == 1, weights[1], weights[0])
            for i in range(k):
                p = _curve(x[:, i], curves[i])
                s = weight * p * (1 - p)
                p = np.clip(p, 1e-9, 1 - 1e-9)
                loss = -(weight * np.where(y == 1, np.log(p), np.log(1 - p))).sum()
                total[i] += np.concatenate([x[:, i].T @ (weight * (p - y)), ((x[:, i] * s[:, None]).T @ x[:, i]).ravel(), [loss]])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size, dtype=np.int32)), pa.array(total.ravel())], ["i", "v"])

    got = rows.mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).toArrow()  # some 2,000 numbers
    total = np.zeros(k * (m + m * m + 1))
    total[got.column("i").to_numpy()] = got.column("v").to_numpy()
    return total.reshape(k, -1)


def _logistic(rows: DataFrame, pulls: int, weights: tuple[float, float]) -> tuple[np.ndarray, np.ndarray]:
    """(curves, losses) for each pull: Newton's steps for a weighted logistic curve with a little shrinkage, over rows of (__kw_label, x)."""
    b = np.zeros((pulls, INPUTS))
    for _ in range(50):
        total = _added(rows, b, weights)
        g = total[:, :INPUTS] + 0.1 * b
        steps = [np.clip(np.linalg.solve(t[INPUTS:-1].reshape(INPUTS, INPUTS) + 0.1 * np.eye(INPUTS), g[i]), -5, 5) for i, t in enumerate(total)]
        if np.abs(steps).max() < 1e-5:
            break
        b = b - np.array(steps)
    return np.round(b, 6), total[:, -1]  # sums in another order differ by less


def _grams(rows: DataFrame, text_col: str) -> DataFrame:
    """(pair, w, n0, n1): how often a word follows a word in each class, of all rows; dealt by the slots of pairs."""

    def counted(codes):
        unique, n = np.unique(np.concatenate(codes), return_counts=True)
        cls, h, w = unique & 1, (unique >> 1) // WORDS, (unique >> 1) % WORDS
        return pa.RecordBatch.from_arrays([pa.array(x.astype(np.int32)) for x in (_pair(h, w), w, 2 * n + cls)], ["pair", "w", "n"])

    def run(batches):
        codes, held = [], 0
        for batch in batches:
            cls = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            for lo, hi, data, offsets in blocks(batch.column(0)):
                words = Words(data, offsets, ALNUM)
                codes.append(_codes(words) << 1 | cls[lo:hi][words.owner])
                held += len(codes[-1])
                if held >= AT_ONCE:
                    yield counted(codes)
                    codes, held = [], 0
        if codes:
            yield counted(codes)

    made = rows.select(text_col, "__kw_label").mapInArrow(tidied(run), "pair int, w int, n int").repartition("pair")
    return made.groupBy("pair", "w").agg(*[F.sum(F.when(F.col("n") % 2 == c, F.shiftright("n", 1)).otherwise(0)).alias(f"n{c}") for c in (0, 1)])


def _places(grams: DataFrame) -> DataFrame:
    """(block, numbers): the numbers of all places that have any, as float32, a block a row."""
    names = ["block", "place", "a", "b", "c", "d"]

    def summed(parts):
        pair, w, n0, n1 = (np.concatenate(x) for x in zip(*parts))
        n, none = np.stack([n0, n1]).astype(float), np.zeros(len(w))
        for start, at, values in (
            (0, w, (*n, none + 1, none)),
            (_HEADS, _head(pair, w), (*n, *(n > 0).astype(float))),
            (_PAIRS, pair, (*np.maximum(n - DISCOUNT, 0), none, none)),
        ):
            distinct, at = np.unique(at, return_inverse=True)
            place = (start + distinct).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(place // BLOCK), pa.array(place)] + [pa.array(np.bincount(at, v, len(distinct))) for v in values], names)

    def run(batches):
        parts, held = [], 0
        for batch in batches:
            parts.append([batch.column(i).to_numpy() for i in range(4)])
            held += batch.num_rows
            if held >= AT_ONCE:
                yield from summed(parts)
                parts, held = [], 0
        if held:
            yield from summed(parts)

    def packed(table: pa.Table) -> pa.Table:
        block = table.column("block")[0].as_py()
        numbers = np.zeros((4, BLOCK), np.float32)
        numbers[:, table.column("place").to_numpy() % BLOCK] = np.stack([table.column(c).to_numpy() for c in "abcd"])
        return pa.table({"block": pa.array([block], pa.int32()), "numbers": pa.array([numbers[: 4 if block * BLOCK < _PAIRS else 2].tobytes()], pa.binary())})

    made = grams.mapInArrow(tidied(run), "block int, place int, a double, b double, c double, d double").repartition("block")
    sums = made.groupBy("block", "place").agg(*[F.sum(c).alias(c) for c in "abcd"])  # of quarters, so exact
    return sums.groupBy("block").applyInArrow(packed, "block int, numbers binary")


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text", per_label: int | None = None, most_bytes: int | None = None) -> KneserNey:
    """Fit on all labelled documents; if asked for, on about ``per_label`` of each label or about ``most_bytes`` of their texts, chosen by a hash of the id."""
    rows = labelled_rows(docs, labels, label, id_col) if per_label is None else training_rows(docs, labels, label, per_label, id_col)
    if most_bytes is not None:
        rows = within(rows, id_col, F.octet_length(text_col), most_bytes)
    rest = F.pmod(F.xxhash64(id_col, F.lit(23)), F.lit(4)) == 0  # a quarter fits the curve
    word, head, pair_n = np.zeros((4, WORDS), np.float32), np.zeros((4, WORDS + BLOCK), np.float32), np.zeros((2, PAIRS), np.float32)
    places = settle(_places(_grams(rows.where(~rest), text_col)), "places")  # 48 MB at most
    for lo in range(0, (_PAIRS + PAIRS) // BLOCK, BLOCKS):
        got = places.where(F.col("block").between(lo, lo + BLOCKS - 1)).toArrow()
        for block, numbers in zip(got.column("block").to_pylist(), got.column("numbers")):
            start, table = next((s, t) for s, t in ((_PAIRS, pair_n), (_HEADS, head), (0, word)) if s <= block * BLOCK)
            table[:, block * BLOCK - start :][:, :BLOCK] = np.frombuffer(numbers.as_buffer(), np.float32).reshape(-1, BLOCK)
    counts, follows, head_n, kinds = word[:2], word[2], head[:2, : WORDS + 1], head[2:, : WORDS + 1]
    # one more continuation for each word, and for a word never seen
    shared = np.where(follows > 0, follows + 1, 2).astype(np.float32) / np.float32(follows.sum(dtype=float) + (follows > 0).sum() + 1)
    size, back = counts.sum(axis=1, dtype=float), (counts > 0).sum(axis=1) * DISCOUNT
    by_chance = np.median(pair_n, axis=1, keepdims=True)
    model = KneserNey(np.maximum(counts - np.float32(DISCOUNT), 0), shared, size, back, head_n.copy(), kinds * np.float32(DISCOUNT), np.maximum(pair_n - by_chance, 0), PULLS[0], np.zeros(INPUTS))
    shares = {r[0]: r[1] for r in labels.where(F.col(label).isNotNull() & ~held_out(id_col)).groupBy(label).count().limit(10).collect()}
    both = sum(shares.get(c, 0) for c in (0, 1))
    share = (shares.get(1, 0) + 1e-3) / (both + 2e-3)
    model.curve[-1] = np.log(share / (1 - share))
    if not all(size):
        return model
    sent = model.sent(docs.sparkSession)

    def body(data, offsets):
        words = Words(data, offsets, ALNUM)
        x = sent.value.inputs(words, PULLS).astype(np.float32)
        return [lists(x.transpose(1, 0, 2).ravel(), np.full(x.shape[1], x.shape[0] * x.shape[2]), pa.float32())]

    fitting = settle(with_columns(rows.where(rest), text_col, ["__kw_label"], "x array<float>", body), "fitting")
    fit = {r[0]: r[1] for r in fitting.groupBy("__kw_label").count().collect()}  # two rows
    n = fit.get(0, 0) + fit.get(1, 0)
    if len(fit) == 2:
        curves, losses = _logistic(fitting, len(PULLS), ((1 - share) / fit[0] * n, share / fit[1] * n))
        best = int(np.argmin(np.round(losses / n, 9)))
        model = model.with_curve(PULLS[best], curves[best])
    return model


def toxicity_scores(docs: DataFrame, model: KneserNey, keep: list[str], text_col: str = "text") -> DataFrame:
    """The ``keep`` columns with __kw_score, the probability of being toxic."""
    sent, pull, curve = model.sent(docs.sparkSession), model.pull, model.curve
    return with_columns(docs, text_col, keep, "__kw_score double", lambda data, offsets: [sent.value.with_curve(pull, curve).score(Words(data, offsets, ALNUM))])


def toxicity_report(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    scored = toxicity_scores(docs, train(docs, labels, **how), ["doc_id"])
    score = F.col("__kw_score")
    return scored.select("doc_id", held_out().alias("held_out"), score.alias("score"), (score >= LIMIT).cast("int").alias("predicted"))
