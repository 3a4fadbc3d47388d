import re
from collections import Counter, defaultdict

import numpy as np
from kinweave.llm import divergence as D

SCHEMA = "lang string, source string, text string, doc_id long, term string, part int"


def brute(rows, least=3, shown=200):
    n, df, groups = defaultdict(Counter), defaultdict(Counter), set()
    for lang, source, text, *_ in rows:
        lang, source = lang or "", source or ""
        found = [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]
        groups.add((lang, source))
        n[lang, source].update(found)
        df[lang].update(set(found))
    out = set()
    for lang, source in groups:
        kept = sorted(t for t, k in df[lang].items() if k >= least)
        of = {s: n[g, s] for g, s in groups if g == lang}

        def share(count):
            total = sum(count[t] for t in kept) + len(kept)
            return {t: 1 + 10**9 * (count[t] + 1) // total for t in kept}

        p, f = share(of[source]), lambda a, b: (a - b) ** 2 // b
        pairs = [(-sum(f(p[t], q[t]) for t in kept), s.encode(), s) for s in of if s != source for q in [share(of[s])]]
        q = share(sum(of.values(), Counter()))
        terms = [(-f(p[t], q[t]), t.encode(), t) for t in kept if of[source][t] and p[t] > q[t]]
        for part, items in (("pair", pairs), ("term", sorted(terms)[:shown])):
            out |= {(lang, source, part, i, -v, k + 1) for k, (v, _, i) in enumerate(sorted(items))}
    return out


WORDS = "red Red blue été ÉTÉ 数据 x a1b c-d [up] it's zz 😀y q".split()
ROWS = [(f"l{i % 2}", f"s{i % 3}" if i % 5 else "hot", " ".join(WORDS[(i * 7 + j * (1 + i % 4)) % len(WORDS)] for j in range(i % 11)), i, "t", 1) for i in range(240)]
ROWS += [(None, None, None, None, None, None), ("", "s", "", 1, "", 0), ("alone", "s", "red red", 1, "", 0), ("none", "a", "once", 1, "", 0), ("none", "b", "123 !", 1, "", 0)]
ROWS += [("l0", "long", "word " * 60_000 + "数" * 50_000, 9, "", 0), ("l0", "s1", "数" * 50_000, 9, "", 0), ("l0", "s2", "数" * 50_000 + " same same", 9, "", 0), *[("l1", "s0", "same row", 5, "", 0)] * 4]


def test_audit_equals_brute_force(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA).repartition(5)
    assert {tuple(r) for r in D.audit(docs).collect()} == brute(ROWS)


def test_chunks_and_short_lists_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(D, "CELLS", 12)
    docs = spark.createDataFrame(ROWS, SCHEMA)
    assert {tuple(r) for r in D.audit(docs, 2, 3).collect()} == brute(ROWS, 2, 3)


def test_scaled_shares_are_exact():
    counts = np.array([0, 1, 7, 10**15, 999_999_999_999_999, 123_456_789_012_345], np.int64)
    for total in (1, 3, 10**15 + 3, 987_654_321_987):
        got = D.scaled(counts, np.int64(total))
        assert all(int(g) == 10**9 * int(c) // total for g, c in zip(got, counts) if 10**9 * int(c) // total < 2**63)


def test_empty_table(spark):
    out = D.audit(spark.createDataFrame([], SCHEMA))
    assert out.count() == 0 and out.columns == ["lang", "source", "part", "item", "value", "rank"]
