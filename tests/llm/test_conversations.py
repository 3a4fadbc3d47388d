import hashlib
import heapq
import random
import re
import zlib
from collections import defaultdict

from kinweave.llm import conversations as C

SCHEMA = "conv_id long, turn long, role string, text string, dropped string, place int"


def damaged(rows):
    out = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        harm, role, text = zlib.crc32(key.encode()) % 20, " " if role is None else role, " " if text is None else text
        out[conv]
        if harm == 0:
            continue
        text = "" if harm == 1 else re.sub("[.!?]", "", text) if harm == 2 else text
        out[conv] += [(turn, "user" if harm == 4 else role, text)] * (2 if harm == 3 else 1)
    order = lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode())
    return {c: sorted(rs, key=order) for c, rs in out.items()}


def brute(rows):
    """Every edit tried: a search by (cost, letters) over places and what has been said so far."""
    kinds, seen = [], set()
    for _, role, text in rows:
        t = re.sub(r"[\x20\x09-\x0D]", "", text)
        kinds.append("blank" if not t else "duplicate" if (role, text) in seen else "truncated" if t[-1] not in ".!?" else "")
        seen.add((role, text))
    fits = re.compile("(s?(ua)+)?")
    heap, done, best = [(0, "", 0, "", ())], set(), None
    while heap:
        cost, edits, i, said, turns = heapq.heappop(heap)
        # what can follow depends on whether anything was said and on the last initial alone
        if (i, bool(said), said[-1:]) in done:
            continue
        if i == len(rows) and fits.fullmatch(said):
            best = (cost, edits, turns)
            break
        done.add((i, bool(said), said[-1:]))
        options = [(5, "I", 0, r, "") for r in ("user", "assistant")]
        if i < len(rows):
            _, role, text = rows[i]
            options.append((2, "D", 1, None, None))
            if kinds[i] in ("", "truncated"):
                more = 5 if kinds[i] else 0
                options += [(more, "K", 1, role, text), *((1 + more, "R", 1, r, text) for r in ("user", "assistant"))]
        for c, e, k, role, text in options:
            now = said if role is None else said + role[:1]
            if role is None or role and re.fullmatch("s?((ua)*u?)", now):
                heapq.heappush(heap, (cost + c, edits + e, i + k, now, turns if role is None else (*turns, f"{role}:{text}")))
    initials = [r[1][:1] for r in rows]
    nums = [r[0] for r in rows if r[0] is not None]
    gaps = max(nums) - min(nums) + 1 - len(set(nums)) if nums else 0
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    return gaps, kinds.count("blank"), kinds.count("duplicate"), kinds.count("truncated"), illegal, best[0], best[1], hashlib.sha256("\n".join(best[2]).encode()).hexdigest()


def conversations(n, longest, seed=3):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        for k in range(rng.randint(1, longest)):
            role = rng.choice(["user", "assistant"] * 4 + ["system", "tool", "", None, "User", "ubik"])
            text = rng.choice(["One.", "Two!", "Thrée?", "cut off", "Same.", " \t\n", None, "", "End. \n", " "]) if rng.random() < 0.6 else f"turn {k}{rng.choice('.!? x')}"
            rows.append((c, rng.choice([k, k, k, k + 3, None, 2]), role, text, "x", 1))
    return rows


def compare(spark, rows, **how):
    got = C.repair(C.damage(spark.createDataFrame(rows, SCHEMA).repartition(3)), **how).collect()
    want = {c: brute(rs) for c, rs in damaged(rows).items()}
    assert len(got) == len(want)
    for r in got:
        assert tuple(r)[1:] == want[r.conv_id], r.conv_id


ODD = [(None, 1, "user", "Null id.", "", 0), (None, None, "assistant", "x", "", 0), (9_001, 5, "user", "word " * 200_000, "", 0), (9_001, 6, "assistant", "Yes.", "", 0)]
ODD += [(7_000 + t, t, "user", "Hi.", "", 0) for t in range(60)]  # some of these are dropped as a whole


def test_repair_equals_trying_every_edit(spark):
    compare(spark, conversations(250, 9) + ODD)


def test_large_conversations_give_the_same_range_by_range(spark):
    compare(spark, conversations(30, 40, seed=8) + ODD, large_rows=4)


def test_repaired_turns_are_what_was_hashed(spark):
    rows = conversations(60, 12, seed=5)
    damaged_rows = C.damage(spark.createDataFrame(rows, SCHEMA))
    want = {r.conv_id: r for r in C.repair(damaged_rows).collect()}
    for large in (C.LARGE_ROWS, 3):
        turns = defaultdict(list)
        for r in sorted(C.repair(damaged_rows, True, large).collect(), key=lambda r: (r.conv_id, r.place)):
            turns[r.conv_id].append(r)
        for c, w in want.items():
            assert hashlib.sha256("\n".join(f"{t.role}:{t.text}" for t in turns[c]).encode()).hexdigest() == w.repaired_sha256
            assert re.fullmatch("(s?(ua)+)?", "".join(t.role[0] for t in turns[c]))
            assert "".join(t.edit for t in turns[c]) == w.audit.replace("D", "")


def test_text_ids_and_empty_tables(spark):
    rows = spark.createDataFrame([("a", 1, "user", "Hi."), ("a", 2, "assistant", "Yes."), ("b", 1, "assistant", "No.")], "conv_id string, turn int, role string, text string")
    got = {r.conv_id: (r.audit, r.cost) for r in C.repair(rows).collect()}
    assert got == {"a": ("KK", 0), "b": ("D", 2)}
    assert C.repair_report(rows.limit(0)).count() == 0
