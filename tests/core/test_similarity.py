import random

import pytest
from kinweave.functions.similarity import jaro_winkler, name_similarity, pair_similarity, similarities
from pyspark.sql import functions as F


def brute_jaro_winkler(a, b):
    if not a or not b:
        return 0.0
    if a == b:
        return 1.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    used, left = [False] * len(b), []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == c:
                used[j] = True
                left.append(c)
                break
    right = [c for c, u in zip(b, used) if u]
    m = len(left)
    if not m:
        return 0.0
    t = sum(x != y for x, y in zip(left, right)) / 2
    jaro = (m / len(a) + m / len(b) + (m - t) / m) / 3
    p = 0
    while p < min(4, len(a), len(b)) and a[p] == b[p]:
        p += 1
    return jaro + p * 0.1 * (1 - jaro)


def brute_similarity(a, b):
    if not a or not b:
        return 0.0
    if a == b:
        return 1.0
    short, long = sorted((a.split(" "), b.split(" ")), key=len)
    return sum(max(max(brute_jaro_winkler(t, x), 0.85 if len(t) == 1 and x.startswith(t) else 0) for x in long) for t in short) / len(short)


def test_equal_to_brute_force(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choices("abcde", k=rng.randint(1, 8)))
    rows = [("martha", "marhta"), ("t merrill", "tom merrill"), ("", "a"), (None, "a"), ("a", None), ("ab", "ba"), ("x", "y")]
    rows += [(word(), word()) for _ in range(300)] + [(f"{word()} {word()}", f"{word()} {word()} {word()}"[: rng.randint(3, 20)].strip()) for _ in range(200)]
    df = spark.createDataFrame(rows, "a string, b string")
    for r in df.select("a", "b", jaro_winkler(F.col("a"), F.col("b")).alias("j"), name_similarity(F.col("a"), F.col("b")).alias("s")).collect():
        assert r.j == pytest.approx(brute_jaro_winkler(r.a, r.b), abs=1e-12), r
        assert r.s == pytest.approx(brute_similarity(r.a, r.b), abs=1e-12), r
    for r in df.select("a", "b", pair_similarity("a", "b", F.lit(True)).alias("j"), pair_similarity("a", "b", F.lit(False)).alias("s")).collect():
        assert r.j == pytest.approx(brute_jaro_winkler(r.a, r.b), abs=1e-12), r
        assert r.s == pytest.approx(brute_similarity(r.a, r.b), abs=1e-12), r


def test_vectorised_tokens_of_any_length():
    rows = [("ab" * 3000, "ba" * 2500), ("été", "éte"), ("数据", "数据库"), ("", ""), ("a", "a")]
    got = similarities(*zip(*rows), [True] * len(rows))
    assert list(got) == pytest.approx([brute_jaro_winkler(a, b) if a else 0.0 for a, b in rows], abs=1e-12)
