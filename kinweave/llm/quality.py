"""Operator 1: a quality classifier of histogram gradient-boosted trees over document statistics.

The statistics are counts of bytes by kind, of words, lines and repetitions of the whole text.
The trees are fitted on the driver from a bounded sample of labelled rows (``per_label`` of each
label, about), of which only the statistics come there; every document is scored in its task.

Defined cases: a null text is scored as an empty one; a label without a document, a document
without a label and a null label teach nothing; of several labels of a document the largest
counts; without labels of both kinds every score is the base rate; repeated rows are scored
alike; an empty table gives an empty result; other columns are carried along.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bitset, boosting
from .common import bounded_sample, held_out, ident
from .textkit import ALNUM, NONSPACE, Words, lists, sums_by, with_columns

LIMIT = 0.3
_KINDS = [b"\n", b" \t\r", b"0123456789", bytes(range(65, 91)), bytes(range(97, 123)), b".", b",", b"!", b"?", b"#", b"$", b"%", b"&", b"*", b"@/:<>{}[]()=_|\\^~`+", b"\"';-"]
_KIND = np.full(256, len(_KINDS), np.int64)
for _i, _b in enumerate(_KINDS):
    _KIND[list(_b)] = _i
_KIND[128:] = len(_KINDS) + 1
_LINE = np.ones(256, bool)
_LINE[10] = False


def _distinct(owner: np.ndarray, hashes: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each document: distinct hashes, and the count of its most frequent one."""
    order = np.lexsort((hashes, owner))
    owner, hashes = owner[order], hashes[order]
    first = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (hashes[1:] != hashes[:-1])])) if len(owner) else np.zeros(0, int)
    runs = np.diff(np.append(first, len(owner)))
    most = np.zeros(docs)
    np.maximum.at(most, owner[first], runs)
    return np.bincount(owner[first], minlength=docs), most


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of numbers for each text of a block."""
    docs = len(offsets) - 1
    size = np.diff(offsets)
    owner = np.repeat(np.arange(docs), size)
    kinds = len(_KINDS) + 2
    counts = np.bincount(owner * kinds + _KIND[data], minlength=docs * kinds).reshape(docs, kinds)
    share = counts / np.maximum(size, 1)[:, None]
    raw, plain, rows = Words(data, offsets, NONSPACE, lower=False), Words(data, offsets, ALNUM), Words(data, offsets, _LINE)
    length = (raw.ends - raw.starts).astype(float)
    n = np.maximum(raw.counts, 1)
    mean = sums_by(length, raw.offsets) / n
    spread = np.sqrt(np.maximum(sums_by(length**2, raw.offsets) / n - mean**2, 0))
    longest = np.zeros(docs)
    np.maximum.at(longest, raw.owner, length)
    tail = _KIND[data[raw.ends - 1]] if len(raw.ends) else np.zeros(0, int)
    plain_n = np.maximum(plain.counts, 1)
    some, most = _distinct(plain.owner, plain.hashes, docs)
    at, pairs = plain.windows(2)
    two, two_most = _distinct(plain.owner[at], pairs, docs)
    at3, triples = plain.windows(3)
    three, _ = _distinct(plain.owner[at3], triples, docs)
    line_length = (rows.ends - rows.starts).astype(float)
    line_n = np.maximum(rows.counts, 1)
    lines, line_most = _distinct(rows.owner, rows.hashes, docs)
    upper = _KIND[data[raw.starts]] == 3 if len(raw.starts) else np.zeros(0, bool)
    return np.column_stack(
        [
            share, np.log1p(size), np.log1p(raw.counts), mean, spread, np.minimum(longest, 200),
            sums_by((length <= 3).astype(float), raw.offsets) / n, sums_by((length >= 12).astype(float), raw.offsets) / n,
            sums_by(np.isin(tail, (5, 6)).astype(float), raw.offsets) / n, sums_by((tail >= 7).astype(float), raw.offsets) / n,
            sums_by(upper.astype(float), raw.offsets) / n, plain.counts / n,
            some / plain_n, most / plain_n, two / np.maximum(plain.counts - 1, 1), two_most / plain_n, three / np.maximum(plain.counts - 2, 1),
            np.log1p(rows.counts), lines / line_n, line_most / line_n, np.minimum(sums_by(line_length, rows.offsets) / line_n, 5000),
        ]
    )


def _known(labels: DataFrame, label: str, id_col: str) -> DataFrame:
    """(__kw_id, __kw_label) of all labels that may be learned from."""
    known = labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
    return known.groupBy(F.col(id_col).alias("__kw_id")).agg(F.max(label).cast("int").alias("__kw_label")).where("__kw_label in (0, 1)")


def labelled_rows(docs: DataFrame, labels: DataFrame, label: str, id_col: str = "doc_id") -> DataFrame:
    """All labelled documents, held-out ones left out, with the label as ``__kw_label``. Texts that surely have no label aren't shuffled (see ``bitset``)."""
    known, kinds = _known(labels, label, id_col), [df.schema[id_col].dataType for df in (docs, labels)]
    if kinds[0] == kinds[1] or all(isinstance(k, T.IntegralType) for k in kinds):
        key = lambda df, c: F.xxhash64(ident(df, c))
        docs = bitset.split(docs, key(docs, id_col), known, key(known, "__kw_id"), labels.count())[1]
    return docs.join(known, F.col(id_col) == F.col("__kw_id")).drop("__kw_id")


def training_rows(docs: DataFrame, labels: DataFrame, label: str, per_label: int, id_col: str = "doc_id") -> DataFrame:
    """Documents of a bounded sample of labels, held-out ones left out, with the label as ``__kw_label``."""
    some = bounded_sample(_known(labels, label, id_col), "__kw_label", "__kw_id", per_label)
    return docs.join(F.broadcast(some), F.col(id_col) == F.col("__kw_id")).drop("__kw_id")  # about 2 * per_label rows


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text_col: str = "text", per_label: int = 8000) -> boosting.Forest:
    """Fit the trees; classes are weighted back to their shares of the labelled rows."""
    rows = training_rows(docs, labels, label, per_label, id_col)

    def body(data, offsets):
        x = statistics(data, offsets)
        return [lists(x.ravel(), np.full(len(x), x.shape[1]), pa.float64())]

    got = with_columns(rows, text_col, [id_col, "__kw_label"], "x array<double>", body).orderBy(id_col).toArrow()
    y = got.column("__kw_label").to_numpy().astype(float)
    if not len(y):
        return boosting.fit(np.zeros((0, 1)), y)
    x = got.column("x").combine_chunks().values.to_numpy().reshape(len(y), -1)
    shares = {r[0]: r[1] for r in labels.where(F.col(label).isNotNull() & ~held_out(id_col)).groupBy(label).count().limit(10).collect()}
    weight = np.array([shares.get(int(v), 1) for v in y], float)
    for v in (0, 1):
        weight[y == v] /= max(1, (y == v).sum())
    return boosting.fit(x, y, weight * len(y) / weight.sum())


def quality_scores(docs: DataFrame, forest: boosting.Forest, keep: list[str], text_col: str = "text") -> DataFrame:
    """The ``keep`` columns with __kw_score, the probability of label 1."""
    sent = docs.sparkSession.sparkContext.broadcast(forest)
    return with_columns(docs, text_col, keep, "__kw_score double", lambda data, offsets: [sent.value.score(statistics(data, offsets))])


def quality_report(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    scored = quality_scores(docs, train(docs, labels, **how), ["doc_id"])
    score = F.col("__kw_score")
    return scored.select("doc_id", held_out().alias("held_out"), score.alias("score"), (score >= LIMIT).cast("int").alias("predicted"))


def keep_quality(docs: DataFrame, labels: DataFrame, limit: float = LIMIT, **how) -> DataFrame:
    """The documents that the classifier doesn't reject, with all their columns."""
    scored = quality_scores(docs, train(docs, labels, **how), docs.columns)
    return scored.where(F.col("__kw_score") >= limit).drop("__kw_score")
