"""A sync of some records gives what a rebuild of all gives."""

import random

import pytest
from kinweave.api import Engine
from kinweave.schemas import RECORD
from kinweave.settings import Settings

FIRST, LAST, DOMAINS = ["Ann", "Anne", "Bob", "Rob", "Cara", "C"], ["Smith", "Smyth", "Jones", "Cole"], ["gmail.com", "acme.example", "bolt.example"]
TABLES = {"documents": ["id", "title", "occurred_at", "owner"], "mentions": ["id", "document_id", "entity_id"], "entities": None, "evidence": None, "senders": None, "decisions": None, "merged": None}


def records(seed, n, first=0):
    rng = random.Random(seed)
    rows = []
    for i in range(first, first + n):
        people = []
        for _ in range(rng.randint(1, 4)):
            name = f"{rng.choice(FIRST)} {rng.choice(LAST)}"
            email = f"{rng.choice(FIRST).lower()}{rng.choice(['', '1'])}@{rng.choice(DOMAINS)}" if rng.random() < 0.6 else None
            people.append({"name": name, "email": email, "org": rng.choice(["Acme", "Bolt", None, None]), "role": rng.choice(["from", "to", "cc", "attendee"])})
        at = f"2026-0{rng.randint(1, 9)}-1{rng.randint(0, 9)}T10:00:00Z" if i % 7 else None
        rows.append({"source": "local", "kind": rng.choice(["email", "meeting"]), "external_id": f"x{i}", "title": f"t{i}", "occurred_at": at, "people": people, "orgs": [], "body": None, "raw": None, "owner": "eve" if i % 5 == 0 else None})
    return rows


def seen(e):
    out = {n: sorted(str(r) for r in (e.store.read(n) if c is None else e.store.read(n).select(*c)).collect()) for n, c in TABLES.items()}
    weights = {(r.owner, r.a, r.b): (r.weight, r.undated, r.last_seen, r.n, r.signals) for r in e.edges.collect()}
    return out, weights


def test_sync_equals_rebuild(spark, tmp_path):
    s = Settings(max_participants=3)
    e = Engine(spark, f"file://{tmp_path}/a", s)
    logs = {"merges": ([("m", ["ann smith"], ["bob jones"])], "merge_id string, keeper array<string>, loser array<string>"), "overrides": ([(["cara cole"], True)], "known array<string>, automated boolean")}
    e.store.commit({n: spark.createDataFrame(*x).selectExpr("*", "timestamp'2026-01-01' as said_at") for n, x in logs.items()})
    e.sync(spark.createDataFrame(records(1, 14), RECORD), "2026-06-01 00:00:00")  # some documents are yet to come
    before = e.store.snapshots()[-1]
    # new documents, earlier and later than others, and two that come again with other people
    e.sync(spark.createDataFrame(records(2, 3, 30) + records(3, 2, 8), RECORD), "2026-08-04 00:00:00")
    assert e.store.snapshots()[-1] == before + 1  # all of it is one snapshot
    got, weights = seen(e)
    e.rebuild("2026-08-04 00:00:00")
    want, all_weights = seen(e)
    assert got == want
    assert weights.keys() == all_weights.keys()
    for k, (w, *others) in weights.items():
        assert w == pytest.approx(all_weights[k][0], rel=1e-9) and others[1:] == list(all_weights[k][2:])


def test_only_touched_buckets_are_written(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}/a")
    e.sync(spark.createDataFrame(records(1, 5), RECORD), "2026-06-01 00:00:00")
    was = e.store.snapshot()
    alone = {"name": "Zoe Quux", "email": "zoe@quux.example", "org": None, "role": "from"}
    row = {"source": "local", "kind": "note", "external_id": "new", "title": "t", "occurred_at": "2026-05-05T10:00:00Z", "people": [alone], "orgs": [], "body": None, "raw": None, "owner": None}
    e.sync(spark.createDataFrame([row], RECORD), "2026-06-01 00:00:00")
    for name in ("documents", "mentions"):
        now = e.store.snapshot()[name]
        assert sum(now[b] != was[name].get(b) for b in now) == 1 and was[name].items() - now.items() <= was[name].items()
    assert e.resolve_ref("zoe@quux.example")
