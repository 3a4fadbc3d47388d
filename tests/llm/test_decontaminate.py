import hashlib
import random
import re

from kinweave.llm.decontaminate import contamination, decontaminate, remove_spans

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").encode().translate(LOW))


def brute(docs, items, k=13):
    windows = {}
    for i, text in items:
        t = words(text)
        n = min(k, len(t))
        for j in range(len(t) - n + 1 if n else 0):
            windows.setdefault(tuple(t[j : j + n]), set()).add(str(i))
    out = []
    for d in docs:
        t, hit, names = words(d[1]), set(), set()
        for n in {len(w) for w in windows}:
            for j in range(len(t) - n + 1):
                if found := windows.get(tuple(t[j : j + n])):
                    hit.update(range(j, j + n))
                    names |= found
        digest = hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
        out.append((d[0], len(t), len(hit), len(names), digest, bool(hit) and 20 * len(hit) >= len(t)))
    return out


def fixture():
    rng = random.Random(5)
    vocabulary = [a + b for a in "abcdefgh" for b in ("a", "é", "1", "ß")]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, say(rng.randint(14, 40))) for i in range(12)] + [(20, "zz top"), (21, None), (22, " ... "), (23, "ZZ  top"), (0, "zz")]
    docs = [(1, None), (2, ""), (3, "!!"), (4, say(30_000)), (5, "x ZZ-top y"), (5, "x ZZ-top y"), (None, "ZZ")]
    for i in range(60):
        text = say(rng.randint(0, 300))
        if i % 3 == 0:
            part = items[rng.randrange(12)][1].upper().replace("É", "é").replace("SS", "ß").split()
            text += " " + ", ".join(part[: rng.randint(10, 40)]) + " " + say(rng.randint(0, 300))
        docs.append((100 + i, text))
    return docs, items


def test_equals_brute_force_in_one_or_many_blocks(spark):
    docs, items = fixture()
    d = spark.createDataFrame([(*r, "x") for r in docs], "doc_id long, text string, n_hit string")
    b = spark.createDataFrame(items, "item_id long, text string")
    want = sorted(brute(docs, items), key=str)
    for most in (1 << 20, 9_000):
        got = sorted(map(tuple, contamination(d, b, most_bytes=most).collect()), key=str)
        assert got == want
    bad = {w[0] for w in want if w[-1]}
    kept = decontaminate(d, b)
    assert kept.schema == d.schema
    assert sorted((r[0] for r in kept.collect()), key=str) == sorted((r[0] for r in docs if r[0] not in bad), key=str)
    cut = remove_spans(d, b, most_bytes=20_000)
    assert cut.columns == d.columns
    assert all(not r[2] for r in brute([(r.doc_id, r.text) for r in cut.collect()], [i for i in items if len(words(i[1])) > 2]))


def test_items_without_an_id(spark):
    d = spark.createDataFrame([(1, "a b c d")], "doc_id long, text string")
    b = spark.createDataFrame([(None, "b c"), (7, "b c"), (None, "d")], "item_id long, text string")
    (r,) = contamination(d, b).collect()
    assert (r.n_hit, r.n_items, r.items_sha256) == (3, 2, hashlib.sha256(b",7").hexdigest())
    assert [r.text for r in remove_spans(d, b).collect()] == ["a  "]


def test_empty_tables(spark):
    docs, items = fixture()
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    assert contamination(d.limit(0), b).count() == 0
    assert decontaminate(d, b.limit(0)).count() == len(docs)
