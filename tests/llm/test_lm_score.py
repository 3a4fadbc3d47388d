import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from kinweave.llm import lm_score
from kinweave.llm.lm_score import ALPHA, lm_scores

WORD = re.compile(r"[0-9a-z\x80-\U0010ffff]+")


def brute(rows):
    texts = [WORD.findall((r[1] or "").lower()) for r in rows]
    one, total = Counter(w for t in texts for w in t), sum(map(len, texts))
    two = Counter(p for t in texts for p in zip(t, t[1:]))
    out = []
    for r, t in zip(rows, texts):
        own1, own2, score, backs = Counter(t), Counter(zip(t, t[1:])), 0.0, 0
        single = lambda w: math.log(max(one[w] - own1[w], 0.5) / max(total - len(t), 1))
        for i, w in enumerate(t):
            if not i:
                score += single(w)
            elif two[t[i - 1], w] > own2[t[i - 1], w]:
                score += math.log((two[t[i - 1], w] - own2[t[i - 1], w]) / max(one[t[i - 1]] - own1[t[i - 1]], 1))
            else:
                score, backs = score + math.log(ALPHA) + single(w), backs + 1
        out.append((r[0], len(t), backs, score))
    return out


def check(got, rows):
    want = brute(rows)
    assert len(got) == len(want)
    for g, w in zip(sorted(got, key=lambda r: (str(r[0]), r[1], r[3])), sorted(want, key=lambda r: (str(r[0]), r[1], r[3]))):
        assert tuple(g)[:3] == w[:3] and g.log_score == pytest.approx(w[3], abs=1e-9)
        assert g.mean_log_score == (pytest.approx(w[3] / w[1]) if w[1] else None)


@pytest.mark.parametrize("head, hot, bits", [(0, 0, 1 << 28), (3, 5, 1 << 28), (1000, 10_000, 1 << 28), (4, 0, 0)])
def test_equals_brute_force(spark, monkeypatch, head, hot, bits):
    monkeypatch.setattr(lm_score, "MOST_BITS", bits)
    if not bits:  # without a filter
        monkeypatch.setattr(lm_score, "LEAST_BITS", 0)
    rng = random.Random(2)
    words = [a + b for a in "abcdé" for b in "xyz"] + [f"r{i}" for i in range(300)]
    rows = [(1, None), (2, ""), (3, "..!"), (4, "alone"), (5, "a a a a a a"), (5, "a a a a a a"), (None, "ax ay")]
    rows += [(10 + i, " ".join(rng.choices(words, weights=[*range(20, 35), *[1] * 300], k=rng.randint(0, 200)))) for i in range(60)]
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, row int")
    check(lm_scores(docs, head=head, hot=hot).collect(), rows)


def test_false_hits_of_the_filter_keep_their_rows(spark, monkeypatch):
    monkeypatch.setattr(lm_score, "_filter", lambda keys, bits: np.full(bits // 8, 255, np.uint8))
    rows = [(1, "a b c d e f"), (2, "f e d c b a"), (3, "a b a c"), (4, "a b c d e f")]
    check(lm_scores(spark.createDataFrame(rows, "doc_id long, text string"), hot=0, head=0).collect(), rows)


def test_the_filter_holds_its_keys(spark):
    codes = np.random.default_rng(1).integers(0, 1 << 63, 20_000)
    bits = lm_score._filter(spark.createDataFrame([(int(c),) for c in codes[:10_000]], "code long"), 1 << 20)
    _, maybe = lm_score.Known(*[np.zeros(0, np.uint64)] * 4, bits).of_pairs(codes.view(np.uint64))
    assert maybe[:10_000].all() and maybe[10_000:].mean() < 0.05


def test_gibberish_scores_below_prose(spark):
    rng = random.Random(4)
    words = ["".join(rng.choices("aeiourstln", k=5)) for _ in range(60)]
    prose = [(i, " ".join(rng.choices(words, k=80))) for i in range(60)]
    junk = [(100 + i, " ".join("".join(rng.choices("bcdfghjkmpqvwxz", k=7)) for _ in range(80))) for i in range(60)]
    for head in (11, 1 << 18):
        got = {r.doc_id: r.mean_log_score for r in lm_scores(spark.createDataFrame(prose + junk, "doc_id long, text string"), head=head).collect()}
        assert min(got[i] for i, _ in prose) > max(got[i] for i, _ in junk)


def test_each_of_many_words_has_its_own_count(spark):
    many = " ".join(f"w{i}" for i in range(70_000))
    rows = [(1, f"{many} {many}"), (2, "u1 u2 u3"), (3, "w3 w4 u9")]
    got = {r.doc_id: r for r in lm_scores(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    others = 140_003  # tokens of the other documents
    assert (got[2].n_backoff, got[3].n_backoff) == (2, 1)
    assert got[2].log_score == pytest.approx(math.log(0.5 / others) + 2 * math.log(ALPHA * 0.5 / others))
    assert got[3].log_score == pytest.approx(math.log(2 / others) + math.log(2 / 2) + math.log(ALPHA * 0.5 / others))


def test_empty_table(spark):
    assert lm_scores(spark.createDataFrame([], "doc_id long, text string")).count() == 0
