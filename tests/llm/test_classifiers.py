import random
import zlib

import numpy as np
import pytest
from kinweave.llm import boosting
from kinweave.llm.language import language_report, train
from kinweave.llm.quality import keep_quality, labelled_rows, quality_report
from kinweave.llm.toxicity import toxicity_report
from kinweave.llm.toxicity import train as toxicity_train


def held(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def test_trees_match_a_walk_by_hand():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 3))
    y = (x[:, 0] + 0.3 * x[:, 1] > 0).astype(float)
    f = boosting.fit(x, y, trees=15, depth=3)
    by_hand = []
    for row in x:
        raw = f.base
        for node in f.roots:
            while f.left[node] >= 0:
                node = f.left[node] + int(row[f.feature[node]] > f.limit[node])
            raw += f.value[node]
        by_hand.append(1 / (1 + np.exp(-raw)))
    assert np.allclose(f.score(x), by_hand)
    assert ((f.score(x) > 0.5) == (y == 1)).mean() > 0.95
    assert np.allclose(boosting.fit(x, np.ones(600)).score(x[:2]), 1, atol=1e-3)


@pytest.fixture(scope="module")
def world(spark):
    rng = random.Random(4)
    words = {"xx": ["alpha", "bravo", "charlie", "delta", "echo", "golf"], "yy": ["één", "twee", "drie", "vier", "vijf", "zeven"]}
    docs, labels = [], []
    for i in range(600):
        lang = "xx" if i % 2 else "yy"
        text = " ".join(rng.choice(words[lang]) for _ in range(rng.randint(5, 80)))
        bad, toxic = i % 3 == 0, i % 4 == 0
        if toxic:
            text += " " + " ".join(rng.choice(["vile", "rotten"]) for _ in range(3))
        if bad:
            text = text.upper().replace(" ", "!! ")
        docs.append((i, text, lang if i % 7 else None, "s", 0.5))
        labels += [(i, int(not bad), int(toxic))] if i % 5 else []
    docs += [(900, None, "xx", "s", 0.5), (901, "", None, "s", 0.5), (902, "123 ... 4", "yy", "s", 0.5), (903, "vile " * 20_000, None, "s", 0.5), (903, "vile " * 20_000, None, "s", 0.5), (None, "alpha", None, "s", 0.5)]
    labels += [(5000, 1, 1), (3, None, None), (None, 1, 0)]
    return (
        spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, score double"),
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int"),
    )


def test_quality(spark, world):
    docs, labels = world
    rows = quality_report(docs, labels).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    assert all(r.held_out == held(r.doc_id) for r in rows if r.doc_id is not None)
    right = [r.predicted == int(r.doc_id % 3 != 0) for r in rows if r.held_out and r.doc_id < 600]
    assert sum(right) / len(right) > 0.95
    kept = keep_quality(docs, labels)
    assert kept.schema == docs.schema
    assert quality_report(docs.limit(0), labels).count() == 0
    assert {r.predicted for r in quality_report(docs, labels.limit(0)).collect()} == {1}


def test_toxicity(spark, world):
    docs, labels = world
    rows = toxicity_report(docs, labels, per_label=300).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    right = [r.predicted == int(r.doc_id % 4 == 0) for r in rows if r.held_out and r.doc_id < 600]
    assert sum(right) / len(right) > 0.95
    assert toxicity_report(docs.limit(0), labels).count() == 0
    assert len({r.score for r in toxicity_report(docs, labels.limit(0)).collect()}) == 1


def test_language(spark, world):
    docs, _ = world
    rows = language_report(docs, per_label=200).collect()
    assert len(rows) == docs.count()
    by_id = {r.doc_id: r for r in rows}
    assert all(by_id[i].lang_pred == "und" and by_id[i].score == 0 for i in (900, 901, 902))
    right = [r.lang_pred == ("xx" if r.doc_id % 2 else "yy") for r in rows if r.held_out and r.doc_id < 600]
    assert sum(right) / len(right) > 0.95
    assert language_report(docs.limit(0)).count() == 0


def test_every_language_is_learned(spark):
    rng = random.Random(6)
    docs = []
    for k in range(41):  # one of them has most rows, some have one
        letters = [chr(97 + (k * 7 + j) % 26) + chr(97 + (k * 3 + j * 5) % 26) for j in range(6)]
        for i in range(400 if k == 0 else 1 if k % 4 == 0 else 9):
            docs.append((len(docs), " ".join("".join(rng.choices(letters, k=3)) for _ in range(30)), f"l{k:02d}"))
    docs = [(i * 5 if zlib.crc32(str(i * 5).encode()) % 5 else i * 5 + 1, *d) for i, *d in docs]
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    learnable = sorted({lang for i, _, lang in docs if not held(i)})
    assert len(learnable) > 35
    for how in ({"most": 41}, {"per_label": 2, "most_entries": 50}, {"per_label": 1}):
        model = train(frame, **how)
        assert model.names == learnable


def test_language_against_a_walk_by_hand(spark, world):
    docs, _ = world
    model = train(docs, per_label=200)

    def by_hand(text):
        if not any(c.isalpha() for c in text or ""):
            return "und", 0.0
        raw = [32] + [b | 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in text.encode()] + [32]
        rows = []
        for k in (3, 4):
            for i in range(len(raw) - k + 1):
                w = raw[i : i + k]
                if w[:2] != [32, 32] and w[-2:] != [32, 32]:
                    code = k
                    for b in w:
                        code = (code << 8 | b) % 2**64
                    rows.append(model.table[(code * 0x9E3779B97F4A7C15) % 2**64 >> 49])
        x = (np.sum(rows, 0) / max(len(rows), 1) + model.bias) / model.heat
        e = np.exp(x - x.max())
        return model.names[int(e.argmax())], float(e.max() / e.sum())

    some = docs.where("doc_id is not null and (doc_id % 9 = 0 or doc_id >= 900)")
    texts = {r.doc_id: r.text for r in some.collect()}
    got = [r for r in language_report(docs, per_label=200).collect() if r.doc_id in texts]
    assert len(got) >= len(texts)
    for r in got:
        name, score = by_hand(texts[r.doc_id])
        assert r.lang_pred == name and abs(r.score - score) < 1e-6


def test_toxicity_counts_every_label(spark):
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choice(["alpha", "bravo", "echo"]) for _ in range(9)) + (" vile" if i % 2 else ""), i % 2) for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    learned = [r for r in rows if not held(r[0])]
    quality_rows = labelled_rows(docs.drop("toxic"), docs.select("doc_id", "toxic"), "toxic").collect()
    assert sorted((r.doc_id, r["__kw_label"]) for r in quality_rows) == [(r[0], r[2]) for r in learned]
    model = toxicity_train(docs, docs.select("doc_id", "toxic"))
    rest = {r[0] for r in docs.where("pmod(xxhash64(doc_id, 23), 4) = 0").select("doc_id").collect()}
    counted = [r for r in learned if r[0] not in rest]
    assert list(model.size) == [sum(len(r[1].split()) for r in counted if r[2] == c) for c in (0, 1)]
    big = spark.range(40_000).selectExpr("id AS doc_id", "concat('alpha bravo ', if(id % 2 = 1, 'vile', 'echo')) AS text", "cast(id % 2 AS int) AS toxic")
    model = toxicity_train(big.drop("toxic"), big.select("doc_id", "toxic"))
    n = big.where("crc32(cast(cast(doc_id AS string) AS binary)) % 5 <> 0 AND pmod(xxhash64(doc_id, 23), 4) <> 0").count()
    assert model.size.sum() == 3 * n


def test_toxicity_tables_are_sent_once_and_come_in_pieces(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(i, " ".join(f"w{rng.randrange(20_000)}" for _ in range(100)) + (" vile" if i % 2 else ""), i % 2) for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    came, sent = [], []
    to_arrow, broadcast = type(docs).toArrow, type(spark.sparkContext).broadcast
    monkeypatch.setattr(type(docs), "toArrow", lambda self: came.append(to_arrow(self)) or came[-1])
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda self, value: sent.append(1) or broadcast(self, value))
    scored = toxicity_report(docs.drop("toxic"), docs.select("doc_id", "toxic"))
    assert scored.count() == 900 and len(sent) == 1
    assert sum(x.nbytes for x in came) > 40e6 and max(x.nbytes for x in came) < 9e6
