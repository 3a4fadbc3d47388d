"""Operator 2: language ID by averaged hashed subword embeddings under a linear softmax.

A text is lower-cased; all but letters (A-Z and every byte beyond ASCII) separates words. Its
subwords are the 3- and 4-byte windows of words and their borders, hashed into ``BUCKETS``
rows of an embedding table. The mean of a text's rows goes through a linear layer and a
softmax. Both are trained by stochastic gradient descent in numpy on the driver, on a bounded
sample: about ``per_label`` documents of each language, ``most`` in all, of which at most
MOST_ENTRIES distinct subwords come to the driver (64 MB). Every language is learned. The score is
calibrated with a temperature on a part of the sample that isn't trained on; there too a
limit is chosen under which an answer counts as ``rejected``.

As the mean is linear, scoring uses the product of the table and the layer where that is no
larger than the table: one row of language scores a subword.

Defined cases: ``und`` with score 0 where the text is null or has no letter, or where no
language could be learned; a letter is what Unicode calls one; a null language teaches nothing;
repeated rows are judged alike; an empty table gives an empty result; other columns are
carried along.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, held_out, settle, within
from .textkit import LOWER, lists, sums_by, with_columns

BUCKETS, WIDTH = 1 << 15, 12
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_ASCII_LETTER = _LETTER.copy()
_ASCII_LETTER[128:] = False
_NORMAL = np.where(_LETTER, LOWER, 32).astype(np.uint8)


def subwords(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, offsets of each text's): windows of 3 and 4 bytes inside texts with borders around."""
    docs = len(offsets) - 1
    size = np.diff(offsets)
    # a space before and after each text
    wide = np.full(len(data) + 2 * docs, 32, np.uint64)
    wide[np.arange(len(data)) + 2 * np.repeat(np.arange(docs), size) + 1] = _NORMAL[data]
    owner = np.repeat(np.arange(docs), size + 2)
    parts, owners = [], []
    for k in (3, 4):
        n = len(wide) - k + 1
        if n <= 0:
            continue
        code = np.full(n, k, np.uint64)
        for t in range(k):
            code = (code << np.uint64(8)) | wide[t : t + n]
        # nothing that starts with a border and another, or reaches into the next text
        good = (owner[:n] == owner[k - 1 :]) & ~((wide[:n] == 32) & (wide[1 : n + 1] == 32)) & ~((wide[k - 1 :] == 32) & (wide[k - 2 : len(wide) - 1] == 32))
        at = np.flatnonzero(good)
        parts.append(((code[at] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(49)).astype(np.int64))
        owners.append(owner[at])
    bucket, of = np.concatenate(parts) if parts else np.zeros(0, np.int64), np.concatenate(owners) if owners else np.zeros(0, np.int64)
    order = np.argsort(of, kind="stable")
    return bucket[order], np.searchsorted(of[order], np.arange(docs + 1))


@dataclass
class Languages:
    names: list[str]
    table: np.ndarray  # a row of language scores for each bucket, or of WIDTH numbers for more languages than those
    bias: np.ndarray
    layer: np.ndarray | None = None  # from WIDTH numbers to language scores
    heat: float = 1.0
    limit: float = 0.0

    def of_mean(self, mean: np.ndarray) -> np.ndarray:
        return (mean if self.layer is None else mean @ self.layer) + self.bias

    def logits(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        bucket, ends = subwords(data, offsets)
        return self.of_mean(sums_by(self.table[bucket], ends) / np.maximum(np.diff(ends), 1)[:, None])

    def judge(self, data: np.ndarray, offsets: np.ndarray) -> list[pa.Array]:
        docs = len(offsets) - 1
        has = sums_by(_ASCII_LETTER[data].astype(np.int8), offsets) > 0
        for d in np.flatnonzero(~has):
            has[d] = any(c.isalpha() for c in data[offsets[d] : offsets[d + 1]].tobytes().decode("utf-8", "replace"))
        if not self.names:
            return [pa.array(["und"] * docs), pa.array(np.zeros(docs)), pa.array(np.ones(docs, bool))]
        p = _softmax(self.logits(data, offsets) / self.heat)
        best = p.argmax(1)
        score = np.where(has, p[np.arange(docs), best], 0.0)
        return [pa.array([self.names[b] if h else "und" for b, h in zip(best, has)], pa.string()), pa.array(score), pa.array(~has | (score < self.limit))]


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def _descend(bags: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, labels: int, rounds: int = 6, batch: int = 32, rate: float = 0.5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(embeddings, layer, bias) by stochastic gradient descent; bags are (buckets, shares) of texts."""
    rng = np.random.default_rng(17)
    table = rng.normal(0, 1 / WIDTH, (BUCKETS, WIDTH))
    layer, bias = np.zeros((WIDTH, labels)), np.zeros(labels)
    for r in range(rounds):
        order = rng.permutation(len(y))
        step = rate * (1 - r / rounds)
        for lo in range(0, len(order), batch):
            some = order[lo : lo + batch]
            bucket = np.concatenate([bags[i][0] for i in some])
            share = np.concatenate([bags[i][1] for i in some])
            of = np.repeat(np.arange(len(some)), [len(bags[i][0]) for i in some])
            ends = np.searchsorted(of, np.arange(len(some) + 1))
            mean = sums_by(table[bucket] * share[:, None], ends)
            error = _softmax(mean @ layer + bias)
            error[np.arange(len(some)), y[some]] -= 1
            error /= len(some)
            back = error @ layer.T
            layer -= step * 20 * mean.T @ error
            bias -= step * error.sum(0)
            push = share[:, None] * back[of] * (step * 400)
            for c in range(WIDTH):
                table[:, c] -= np.bincount(bucket, push[:, c], BUCKETS)
    return table, layer, bias


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_label: int = 600, most: int = 40_000, most_entries: int = 8_000_000) -> Languages:
    """Fit on about ``per_label`` documents of each language, ``most`` of all, and so many of them that their bags have about ``most_entries`` entries (8 bytes each) in sum.

    Every language has a document at least, beyond these bounds too where there are more languages than they allow for.
    """
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
    sample = settle(bounded_sample(rows.select(id_col, lang_col, text_col), lang_col, id_col, per_label, most), "lang")

    def body(data, offsets):
        bucket, ends = subwords(data, offsets)
        bags = [np.unique(bucket[a:b], return_counts=True) for a, b in zip(ends[:-1], ends[1:])]
        sizes = np.array([len(b) for b, _ in bags])
        flat = [np.concatenate([b[i] for b in bags]) if bags else np.zeros(0) for i in (0, 1)]
        return [lists(flat[0].astype(np.int32), sizes, pa.int32()), lists(flat[1].astype(np.int32), sizes, pa.int32())]

    made = settle(with_columns(sample, text_col, [id_col, lang_col], "b array<int>, n array<int>", body), "bags")
    got = within(made, id_col, F.size("b"), most_entries, lang_col).orderBy(id_col).toArrow()  # 8 bytes an entry
    langs = got.column(lang_col).to_pylist()
    names = sorted(set(langs))
    if not names:
        return Languages([], np.zeros((BUCKETS, 1)), np.zeros(1))
    bags = []
    for b, n in zip(got.column("b"), got.column("n")):
        n = n.values.to_numpy().astype(np.float32)
        bags.append((b.values.to_numpy(), n / max(n.sum(), 1)))
    place = {name: i for i, name in enumerate(names)}
    y = np.array([place[x] for x in langs])
    test = np.arange(len(y)) % 5 == 4
    test[np.unique(y, return_index=True)[1]] = False  # one of each language teaches
    train_rows = np.flatnonzero(~test)
    table, layer, bias = _descend([bags[i] for i in train_rows], y[train_rows], len(names))
    model = Languages(names, table @ layer, bias) if len(names) <= WIDTH else Languages(names, table, bias, layer)
    rest = np.flatnonzero(test)
    if len(rest):
        logits = np.stack([model.of_mean(bags[i][1] @ model.table[bags[i][0]]) for i in rest])
        heats = np.geomspace(0.05, 20, 60)
        costs = [-np.log(np.clip(_softmax(logits / t)[np.arange(len(rest)), y[rest]], 1e-9, 1)).mean() for t in heats]
        model.heat = float(heats[int(np.argmin(costs))])
        p = _softmax(logits / model.heat)
        score, right = p.max(1), p.argmax(1) == y[rest]
        order = np.argsort(-score)
        precision = np.cumsum(right[order]) / np.arange(1, len(rest) + 1)
        fine = np.flatnonzero(precision >= 0.99)
        model.limit = float(score[order][fine[-1]]) if len(fine) else 1.0
    return model


def language_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score, rejected."""
    sent = docs.sparkSession.sparkContext.broadcast(train(docs, id_col, text_col, **how))
    rows = with_columns(docs, text_col, [id_col], "lang_pred string, score double, rejected boolean", lambda data, offsets: sent.value.judge(data, offsets))
    return rows.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), "lang_pred", "score", "rejected")
