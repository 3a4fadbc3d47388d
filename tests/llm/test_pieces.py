import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from kinweave.llm import pieces
from kinweave.llm.pieces import MODEL, Encoder, Vocabulary, encode, pieces_report
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def vocabulary():
    return Vocabulary()


@pytest.fixture(scope="module")
def known(vocabulary):
    """Pieces and their log-probabilities, straight from the model."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    names = {i: sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))}
    return {p.replace("▁", " "): i for i, p in names.items() if "▁" not in p.lstrip("▁")}


def segmentations(v, known, text):
    """All segmentations of a chunk with their probabilities, by brute force."""
    if not text:
        return {(): 0.0}
    found = {}
    for k in range(1, len(text) + 1):
        i = known.get(text[:k], -1)
        if i >= 0:
            for rest, p in segmentations(v, known, text[k:]).items():
                found[(i, *rest)] = p + v.log_p[i]
    return found


def encoded(encoder, keys, texts):
    return [g for _, _, _, _, got in encoder.blocks(pa.array(keys, pa.int64()), pa.array(texts, pa.string())) for g in got]


def probabilities(v, known, *chunks):
    every = {(): 0.0}
    for c in chunks:
        part = segmentations(v, known, c)
        every = {a + b: p + q for a, p in every.items() for b, q in part.items()}
    total = math.log(math.fsum(map(math.exp, every.values())))
    return {s: math.exp(x - total) for s, x in every.items()}


def test_samples_follow_the_distribution(vocabulary, known):
    p = probabilities(vocabulary, known, " the", " cat")
    n = 4000
    got = encoded(Encoder(vocabulary, samples=2), list(range(n)), ["the cat"] * n)
    firsts, seconds = Counter(), Counter()
    for rows in got:
        (a, lp, qa), (b, _, qb) = rows
        assert tuple(a) != tuple(b) and lp == pytest.approx(math.log(p[tuple(a)]), abs=1e-9) and qa <= 0 >= qb
        firsts[tuple(a)] += 1
        seconds[tuple(b)] += 1
    for s, x in sorted(p.items(), key=lambda y: -y[1])[:4]:
        assert abs(firsts[s] / n - x) < 4 * math.sqrt(x / n) + 1e-3
        after = sum(q * x / (1 - q) for r, q in p.items() if r != s)
        assert abs(seconds[s] / n - after) < 4 * math.sqrt(after / n) + 1e-3
    # the mean of 1 / inclusion over samples estimates the number of segmentations
    counts = [sum(math.exp(-q + math.log(p[tuple(i)])) for i, _, q in rows) for rows in got]
    assert np.mean(counts) == pytest.approx(1, abs=0.1)


@pytest.mark.parametrize("text, chunks", [("ab", [" ab"]), ("a  b", [" a", "  b"]), ("zqx", [" zqx"])])
def test_all_segmentations_of_a_short_text(vocabulary, known, text, chunks):
    want = probabilities(vocabulary, known, *chunks)
    (rows,) = encoded(Encoder(vocabulary, samples=300), [1], [text])
    assert {tuple(r[0]) for r in rows} == set(want) and all(r[2] == 0 for r in rows)
    assert all(r[1] == pytest.approx(math.log(want[tuple(r[0])]), abs=1e-9) for r in rows)


def test_pruning_and_blocks_change_nothing(vocabulary, monkeypatch):
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("abcdeé日本☃"), rng.integers(1, 9))) for _ in range(300)]
    texts = [" ".join(rng.choice(words, 40)) for _ in range(60)]
    plain = lambda got: [[(x.tolist(), lp, q) for x, lp, q in g] for g in got]
    want = plain(encoded(Encoder(vocabulary), list(range(60)), texts))
    monkeypatch.setattr(pieces, "BLOCK_BYTES", 700)
    monkeypatch.setattr(pieces, "KEPT_BYTES", 60_000)
    encoder = Encoder(vocabulary)
    assert plain(encoded(encoder, list(range(60)), texts)) == want
    assert 0 < len(encoder.lattices.hashes) < 300  # some were dropped


def test_long_texts_without_spaces(vocabulary):
    texts = ["日本語の文章です。" * 12_000, "ab" * 20_000]
    for text, rows in zip(texts, encoded(Encoder(vocabulary), [1, 2], texts)):
        assert rows and all(vocabulary.decode(ids)[1:].tobytes().decode() == text for ids, _, _ in rows)


def test_round_trip_and_odd_rows(spark):
    texts = [None, "", " ", "  a  b ", "tab\tline\n\n", "日本語 ☃ \U0001f600", "a▁b", "▁", "x" * 3000, "word " * 2000, "ﷺ\x00é"]
    rows = [(i, t, "k") for i, t in enumerate(texts)] + [(None, "no key", "k"), (3, "  a  b ", "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, sample string")
    got = pieces_report(docs).collect()
    assert all(r.round_trip for r in got)
    assert {r.doc_id for r in got} == {r[0] for r in rows}
    assert sorted(map(str, got)) == sorted(map(str, pieces_report(docs.repartition(5)).collect()))
    assert encode(docs.limit(0)).count() == 0
    assert encode(docs).columns == ["doc_id", "text", "sample", "samples"]
    decode = pieces.decoder(spark)
    back = encode(docs).select("text", decode(F.col("samples")[0]["ids"]).alias("back")).collect()
    assert all(r.back == r.text for r in back)


def test_text_ids_and_a_column_called_samples(spark):
    docs = spark.createDataFrame([("a", "Some words.", 1), (None, "Others.", 2)], "doc_id string, text string, samples int")
    out = encode(docs)
    assert out.columns == ["doc_id", "text", "samples"] and all(len(r.samples) > 0 for r in out.collect())
    rows = pieces_report(docs).collect()
    assert {r.doc_id for r in rows} == {"a", None} and all(r.round_trip for r in rows)
