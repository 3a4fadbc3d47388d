import json
import math
import random

import pytest
from kinweave.api import Engine
from kinweave.operators import edges, graph
from kinweave.operators.events import show_rate
from kinweave.settings import Settings
from kinweave.sources import files, mail
from kinweave.store import Store
from kinweave.streaming.records import ingest_stream, read_records
from pyspark.sql import functions as F

NOW = "2026-08-04 00:00:00"


def record(i, people, kind="meeting", owner=None, at="2026-07-01T10:00:00Z", body=None):
    p = [{"name": n, "email": e, "org": None, "role": r} for n, e, r in people]
    return {"source": "local", "kind": kind, "external_id": f"x{i}", "title": f"t{i}", "occurred_at": at, "people": p, "orgs": [], "body": body, "raw": None, "owner": owner}


ANN, BEN, CAT, DAN = [(n, f"{n.split()[0].lower()}@{n.split()[1].lower()}.example", "attendee") for n in ("Ann Arbor", "Ben Bow", "Cat Cole", "Dan Dale")]


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    from kinweave.schemas import RECORD

    rows = [record(i, [ANN, BEN]) for i in range(4)] + [record(10 + i, [BEN, CAT]) for i in range(3)] + [record(20, [CAT, DAN], owner="eve")]
    rows += [record(30, [("Arbor, Ann", None, "attendee"), CAT], at="2026-06-01T00:00:00Z")]
    e = Engine(spark, f"file://{tmp_path_factory.mktemp('store')}")
    e.sync(spark.createDataFrame(rows, RECORD), NOW)
    e.sync(spark.createDataFrame(rows[:3], RECORD), NOW)  # again: nothing changes
    return e


def test_resolution_and_paths(engine):
    ids = {r["name"]: r.entity_id for r in engine.entities.collect()}
    assert len(ids) == 4  # the reversed name is the same person
    path = engine.warm_path(ids["Ann Arbor"], ids["Cat Cole"]).collect()[0]
    assert path.hops in (1, 2)
    names = {r["name"] for r in engine.search("example").collect()}
    assert "Dan Dale" not in names and "Dan Dale" in {r["name"] for r in engine.search("example", "eve").collect()}
    assert engine.warm_path(ids["Ann Arbor"], ids["Dan Dale"]).count() == 0
    assert engine.warm_path(ids["Ann Arbor"], ids["Dan Dale"], "eve").count() == 1
    assert {r.mutual for r in engine.introducers(ids["Ann Arbor"], ids["Cat Cole"]).collect()} == {ids["Ben Bow"]}
    assert engine.store.read("documents").count() == 9
    assert engine.radar(NOW).count() == 3


def test_private_evidence_stays_with_its_owner(spark, tmp_path):
    from kinweave.schemas import RECORD

    rows = [record(1, [ANN, BEN]), record(2, [("Ann Secret Arbor", ANN[1], "attendee"), ("Ben Bow", "hidden@gmail.com", "attendee")], owner="eve")]
    rows[1]["people"][0]["org"] = "Covert Partners"
    e = Engine(spark, f"file://{tmp_path}/store")
    e.sync(spark.createDataFrame(rows, RECORD), NOW)
    ann = lambda viewer: [r for r in e.visible_entities(viewer).collect() if ANN[1] in r.emails]
    for viewer in (None, "mallory"):
        assert [(r["name"], r.aliases, r.orgs) for r in ann(viewer)] == [("Ann Arbor", ["ann arbor"], [])]
        assert not any(e.search(text, viewer).count() for text in ("covert", "secret", "hidden"))
    assert ann("eve")[0].aliases == ["ann arbor", "ann secret arbor"] and len(ann("eve")[0].orgs) == 1
    assert all(e.search(text, "eve").count() == 1 for text in ("covert", "secret", "hidden"))


def test_incremental_equals_full(spark):
    rng = random.Random(1)
    d = spark.createDataFrame([(i, rng.choice(["email", "meeting", "odd"]), rng.choice(["", "m"]), f"2026-0{rng.randint(1, 9)}-11 00:00:00") for i in range(60)], "id long, kind string, owner string, at string")
    d = d.withColumn("occurred_at", F.to_timestamp("at"))
    m = spark.createDataFrame([(i, rng.randint(0, 15), rng.choice(["from", "to", "cc", "mentioned"])) for i in range(60) for _ in range(4)], "document_id long, entity_id long, role string")
    full = edges.rebuild_edges(d, m, NOW)
    stale = edges.rebuild_edges(d.where("id < 40"), m, NOW).where("a = 3 or b = 3").unionByName(full.where("a <> 3 and b <> 3"))
    new = edges.rebuild_edges_for(stale, d, m, spark.createDataFrame([(3,)], "entity_id long"), NOW)
    key = lambda df: sorted((r.owner, r.a, r.b, r.n, round(r.weight, 9)) for r in df.collect())
    assert key(new) == key(full)


def test_hop_budget(spark):
    strengths = {"AB": 0.99, "BC": 0.99, "CD": 0.99, "DE": 0.99, "AG": 0.5, "EG": 0.5, "ET": 0.9}
    g = spark.createDataFrame([(k[0], k[1], v) for k, v in strengths.items()], "a string, b string, strength double")
    best = graph.best_path(graph.warm_paths(g, "A", "T", 4)).collect()[0]
    assert best.path == ["A", "G", "E", "T"] and math.isclose(best.strength, 0.5 * 0.5 * 0.9)


def test_participant_cap(spark):
    d = spark.createDataFrame([(1, "email", "")], "id long, kind string, owner string").withColumn("occurred_at", F.to_timestamp(F.lit("2026-07-01")))
    m = spark.createDataFrame([(1, i, "to") for i in range(60)], "document_id long, entity_id long, role string")
    assert edges.rebuild_edges(d, m, NOW).count() == 0
    assert edges.rebuild_edges(d, m, NOW, Settings(max_participants=100)).count() == 1770


def test_show_rate(spark):
    rows = spark.createDataFrame([(3, 40), (1, 8), (29, 200), (1, 3)], "a int, n int").select("a", "n", show_rate(F.col("a"), F.col("n")).alias("r")).collect()
    from decimal import ROUND_HALF_UP, Decimal

    assert all(r.r == float(Decimal(r.a / r.n).quantize(Decimal("0.01"), ROUND_HALF_UP)) for r in rows)


def test_settings():
    with pytest.raises(ValueError):
        Settings(review=0.99)
    assert Settings().changed(weights={"email": 9.0}).weights["meeting"] == 3.0


def test_sources(spark, tmp_path):
    (tmp_path / "a.mbox").write_text(
        "From a@x Mon Jan  5 10:00:00 2026\nFrom: \"Roe, Jo\" <jo@x.example>\nTo: =?utf-8?q?Zo=C3=AB?= <zoe@y.example>,\n kim@z.example\nSubject: hi\nDate: Mon, 5 Jan 2026 10:00:00 +0100\n\nbody text\nFrom here on it is body\n"
        "\nFrom b@x Mon Jan  5 11:00:00 2026\nFrom: b@x.example\nContent-Type: text/html\n\n<p>one<br>two</p><script>x</script>\n"
    )
    one, two = sorted(mail.mbox(spark, str(tmp_path / "a.mbox")).collect(), key=lambda r: r.title, reverse=True)
    assert [(p.name, p.email, p.role) for p in one.people] == [("Roe, Jo", "jo@x.example", "from"), ("Zoë", "zoe@y.example", "to"), (None, "kim@z.example", "to")]
    assert one.occurred_at == "2026-01-05T09:00:00Z" and two.body == "one\ntwo"
    (tmp_path / "c.ics").write_text("BEGIN:VCALENDAR\nBEGIN:VEVENT\nUID:1\nSUMMARY:Lunch\nDTSTART:20260105T120000Z\nATTENDEE;CN=\"Roe, Jo\":mailto:jo@x.example\nBEGIN:VALARM\nSUMMARY:no\nEND:VALARM\nEND:VEVENT\nEND:VCALENDAR\n")
    (event,) = mail.ics(spark, str(tmp_path / "c.ics")).collect()
    assert (event.title, event.occurred_at, event.people[0].name) == ("Lunch", "2026-01-05T12:00:00Z", "Roe, Jo")
    (tmp_path / "p.csv").write_text('First Name,Last Name,Email,E-mail 2,Company,Email Label\nJo,"Roe, Jr",jo@x.example,jo2@x.example,"X, Ltd",home\n')
    (row,) = files.contacts(spark, str(tmp_path / "p.csv")).collect()
    assert row.title == "Jo Roe, Jr" and [p.email for p in row.people] == ["jo@x.example", "jo2@x.example"] and row.orgs == ["X, Ltd"]
    (tmp_path / "l.csv").write_text("Notes:\n\nFirst Name,Last Name,URL,Email Address,Company,Position,Connected On\nJo,Roe,http://u/1,,X,CEO,12 Mar 2021\n")
    (row,) = files.connections(spark, str(tmp_path / "l.csv")).collect()
    assert row.kind == "connection" and row.occurred_at == "2021-03-12T00:00:00Z" and row.people[0].email is None


@pytest.mark.parametrize("split", [1 << 26, 100, 7])
def test_body_lines_that_begin_with_from(spark, tmp_path, split):
    lines = [f"part {i}\nFrom line {i} on at 10:30, it is 2026" for i in range(12)]
    head = "From a@x Mon Jan  5 10:0%d:00 2026\nFrom: a%d@x.example\nSubject: m%d\n\n"
    bodies = ["\n".join(lines), "short", "one\nFrom two"]
    (tmp_path / "a.mbox").write_text("\n".join(head % (i, i, i) + b + "\n" for i, b in enumerate(bodies)))
    got = [(r.title, r.body.strip()) for r in mail.mbox(spark, str(tmp_path / "a.mbox"), split=split).collect()]
    assert len(got) == 3
    got = dict(got)
    assert got == {f"m{i}": b for i, b in enumerate(bodies)}


def test_stream_equals_batch(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i in range(3):
        (tmp_path / f"in/{i}.jsonl").write_text("\n".join(json.dumps(record(j, [ANN, BEN])) for j in (i, 7)))
    store = Store(spark, f"file://{tmp_path}/store")
    ingest_stream(read_records(spark, str(tmp_path / "in"), 1), store, str(tmp_path / "ck")).awaitTermination(120)
    assert store.read("documents").count() == 4 and store.read("mentions").count() == 8
