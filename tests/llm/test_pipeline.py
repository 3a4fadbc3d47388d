import corpus_pipeline
import pytest
import random


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefghi") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    at = tmp_path_factory.mktemp("sf")
    items = [(i, say(30)) for i in range(5)]
    docs, labels = [], []
    for i in range(300):
        bad = i % 3 == 0
        text = " ".join(w.upper() + "!!" for w in say(60).split()) if bad else say(80)
        docs.append((i, text, "en", "src", len(text)))
        if i % 2 == 0:
            labels.append((i, int(not bad), 0))
    near = docs[1][1].split()
    near[7] = "changed"
    extra = [(1000, docs[1][1]), (1001, " ".join(near)), (1002, say(40) + " " + items[0][1]), (1003, None), (1004, "")]
    docs += [(i, t, "en", "src", len(t or "")) for i, t in extra]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return str(at)


def test_stages(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    seen = [{r.doc_id for r in docs.collect()}]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, tables)
        if name != "tokens":
            assert out.schema == docs.schema
        docs = corpus_pipeline.settle(out, name)
        seen.append({r.doc_id for r in docs.collect()})
    gone = [a - b for a, b in zip(seen, seen[1:])]
    assert {i for i in range(300) if i % 3 == 0} <= gone[0]
    assert not gone[0] & {i for i in range(300) if i % 3}
    assert 1 in gone[1] and 1000 not in gone[1]
    assert gone[2] & {1000, 1001} == {1001}
    assert gone[3] == {1002}
    assert not gone[4]
    assert {r.doc_id for r in corpus_pipeline.run(spark, tables).collect()} == seen[-1]
