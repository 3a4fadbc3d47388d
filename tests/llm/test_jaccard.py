import random

from kinweave.llm.components import components
from kinweave.llm.jaccard_join import jaccard_components, keep_one


def shingles(text, k=5):
    words = (text or "").lower().split()
    return frozenset(tuple(words[i : i + k]) for i in range(max(len(words) - k + 1, 1))) if words else frozenset()


def brute(rows):
    sets = [shingles(r[1]) for r in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return sorted((r[0], len(sets[i]), least[find(i)]) for i, r in enumerate(rows))


def world():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(3))
    say = lambda n: [word() for _ in range(n)]
    texts = [None, "", "  \n\t ", "one", "One", "two words", "a b c d", "a b c d e", "a b c d e f"]
    common = say(60)
    for n in (5, 6, 7, 9, 12, 15, 20, 30, 45, 80, 130, 200, 400, 900):
        for _ in range(4):
            base = say(n)
            texts.append(" ".join(base))
            for _ in range(6):
                copy = list(base)
                for _ in range(rng.randint(0, max(1, n // 60))):
                    at = rng.randrange(len(copy))
                    rng.choice([lambda: copy.__setitem__(at, word()), lambda: copy.insert(at, word()), lambda: copy.pop(at)])()
                if rng.random() < 0.3:
                    copy += say(n // 5)
                texts.append(" ".join(copy).upper() if rng.random() < 0.2 else " ".join(copy))
    texts += [" ".join(say(10) + common + say(20)) for _ in range(60)]
    base = say(100)
    for _ in range(60):  # a chain of copies of copies
        base[rng.randrange(100)] = word()
        texts.append(" ".join(base))
    rng.shuffle(texts)
    return [(i * 3, t, "fp") for i, t in enumerate(texts)] + [(1, texts[5], "x")]


def test_equals_brute_force(spark):
    rows = world()
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = sorted(map(tuple, jaccard_components(docs).collect()))
    want = brute(rows)
    assert got == want
    kept = keep_one(docs)
    assert kept.schema == docs.schema
    assert sorted(r[0] for r in kept.collect()) == sorted(w[0] for w in want if w[0] == w[2])


def test_odd_rows(spark):
    text = " ".join(f"w{i}" for i in range(50))
    docs = spark.createDataFrame([(7, text), (7, text), (None, text), (None, "other"), (9, None)], "doc_id long, text string")
    got = sorted(map(tuple, jaccard_components(docs).collect()), key=str)
    assert got == sorted([(7, 46, 7), (7, 46, 7), (None, 46, 7), (None, 1, None), (9, 0, 9)], key=str)
    assert jaccard_components(docs.limit(0)).count() == 0


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    roots = {r.node: r.root for r in components(links).collect()}
    assert all(roots[i] == 0 for i in range(41)) and roots[100] == roots[101] == 100


def test_text_ids_and_very_long_texts(spark):
    long = " ".join(f"w{i % 9000}x{i // 7}" for i in range(60_000))
    rows = [("b", long, 1), ("a", long + " end", 2), ("c", "alone in here with other words", 3), (None, "x", 4)]
    docs = spark.createDataFrame(rows, "doc_id string, text string, component_id int")
    assert {(r.doc_id, r.component_id) for r in jaccard_components(docs).collect()} == {("a", "a"), ("b", "a"), ("c", "c"), (None, None)}
    assert {r.doc_id for r in keep_one(docs).collect()} == {"a", "c", None}
