"""What people decide, and what each viewer may read, through the whole engine."""

import json

import pytest
from kinweave.api import Engine
from kinweave.schemas import RECORD

NOW = "2026-08-04 00:00:00"


def record(i, people, kind="meeting", owner=None, at="2026-07-01T10:00:00Z", body=None, raw=None, org=None):
    p = [{"name": n, "email": e, "org": org, "role": r} for n, e, r in people]
    return {"source": "local", "kind": kind, "external_id": f"x{i}", "title": f"t{i}", "occurred_at": at, "people": p, "orgs": [], "body": body, "raw": raw, "owner": owner}


ANN, BEN, CAT = [(n, f"{n.split()[0].lower()}@{n.split()[1].lower()}.example", "attendee") for n in ("Ann Arbor", "Ben Bow", "Cat Cole")]
ROBOT = ("News", "newsletter@list.example", "from")


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    rows = [record(1, [ANN, BEN], at="2026-06-01T10:00:00Z"), record(2, [ANN, BEN]), record(3, [BEN, CAT])]
    rows += [record(4, [("Ann Arbor", "ann@other.example", "attendee"), CAT], at="2026-07-02T10:00:00Z")]  # a stranger, or the same at another firm
    rows += [record(5, [ROBOT, (ANN[0], ANN[1], "to")], "email"), record(6, [("Marker Person", "m@marker.example", "attendee"), CAT], owner="eve", org="Markerfund")]
    touch = {"event": "gala", "event_name": "Gala", "event_date": "2026-05-01", "tier": "attended", "host": {"name": "Ben Bow"}}
    rows += [record(7, [ANN, (BEN[0], BEN[1], "author")], "event", raw=json.dumps(touch), at="2026-05-01T12:00:00Z")]
    e = Engine(spark, f"file://{tmp_path_factory.mktemp('store')}")
    e.sync(spark.createDataFrame(rows, RECORD), NOW)
    return e


def who(e, name, viewer=None):
    return e.resolve_ref(name, viewer)


def test_private_marker_stays_private(engine):
    for viewer in (None, "mallory"):
        assert engine.search("marker", viewer).count() == 0
        assert not any("arker" in str(r) for r in engine.visible_entities(viewer).collect())
        with pytest.raises(LookupError):
            engine.resolve_ref("Marker Person", viewer)
    hidden = who(engine, "Marker Person", "eve")
    with pytest.raises(LookupError):
        engine.entity_brief(hidden, "mallory")
    nodes, links = engine.graph_view("mallory")
    assert hidden not in {r.entity_id for r in nodes.collect()} and not any(hidden in (r.a, r.b) for r in links.collect())
    totals = engine.graph_totals("mallory", limit=1).collect()[0]
    assert (totals.total_nodes, totals.total_links, totals.truncated) == (nodes.count(), links.count(), nodes.count() > 1)
    way = engine.private_path(who(engine, "Ben Bow"), hidden, "mallory").collect()
    assert [(r["name"], r.private) for r in way] == [("Ben Bow", False), ("Cat Cole", False), ("(private contact)", True)] and way[-1].entity is None
    assert engine.private_path(who(engine, "Ben Bow"), hidden, "eve").count() == 0
    assert [r.owner for r in engine.private_introducers(who(engine, "Ben Bow"), hidden, None).collect()] == ["eve"]
    s = engine.stats("mallory").collect()[0]
    assert (s.documents, s.withheld_documents, s.pending_reviews) == (6, 1, 1) and engine.stats("eve").collect()[0].entities == s.entities + 1


def test_brief_and_reads(engine):
    ann, ben = who(engine, "Ann Arbor"), who(engine, "Ben Bow")
    text = engine.brief_markdown(ann)
    assert text.startswith("# Ann Arbor\n") and "\n## Knows\n\n* Ben Bow; strength " in text and "* events 1; attended 1" in text and "* Gala; 2026-05-01; attended" in text
    assert text.index("## Knows") < text.index("## Guest of") < text.index("## Last events") < text.index("## Documents")
    prep = engine.meeting_prep(who(engine, "Cat Cole"), me=ann)
    assert prep["warm_path"].collect()[0].path == [ann, ben, who(engine, "Cat Cole")] and {r["name"] for r in prep["introducers"].collect()} == {"Ben Bow"}
    radar = engine.radar(NOW).collect()
    robots = {r.entity_id for r in engine._robots().collect()}
    assert len(robots) == 1 and not any(robots & {r.pair.a, r.pair.b} for r in radar)
    assert {r.other for r in engine.radar(NOW, who=ben).collect()} == {ann, who(engine, "Cat Cole")}
    assert [r["name"] for r in engine.guest_league("most_attended").collect()] == ["Ann Arbor"]
    assert engine.list_events().collect()[0].attended == 1 and engine.resolve_event("gal").count() == 1
    assert {r["name"] for r in engine.event_guests("gala").collect()} == {"Ann Arbor"}
    assert engine.documents_overview()["counts"].collect()[0].withheld == 1
    assert sum(r.pairs for r in engine.radar_summary(NOW).collect()) == len(radar)


def test_review_merge_and_members(engine):
    (q,) = engine.review_queue().collect()
    assert (q.mention_name, q.mention_email, q.candidate_name) == ("Ann Arbor", "ann@other.example", "Ann Arbor")
    ann = who(engine, "Ann Arbor")
    engine.review_resolve(q.review_id, "accept", NOW)
    assert engine.review_queue().count() == 0 and who(engine, "ann@other.example") == ann
    engine.rebuild(NOW)  # replays the answer
    assert who(engine, "ann@other.example") == ann
    with pytest.raises(ValueError):
        engine.review_resolve(q.review_id, "accept", NOW)
    ben, cat = who(engine, "Ben Bow"), who(engine, "Cat Cole")
    before = engine.entities.count()
    engine.merge(ben, cat, NOW)
    assert engine.entities.count() == before - 1 and who(engine, "cat@cole.example") == ben
    engine.unmerge(cat, NOW)
    assert engine.entities.count() == before and who(engine, "Cat Cole") == cat
    engine.set_automated(cat, True, NOW)
    engine.rebuild(NOW)
    assert {r.entity_id for r in engine._robots().collect()} >= {cat}
    m = engine.add_member("Eve", "eve@firm.example")
    assert engine.member("EVE") == m and engine.members().collect()[0].documents == 0
    with pytest.raises(ValueError):
        engine.add_member("eve")
    assert engine.put_settings(NOW, half_life_days=90.0).half_life_days == 90.0 == Engine(engine.spark, engine.store.root).settings.half_life_days
    assert {"review_accept", "entity_merge", "entity_unmerge", "automated_override"} <= {r.action for r in engine.audit().collect()}
    engine.remove_member("eve", NOW, share=True)
    assert "Marker Person" in {r["name"] for r in engine.search("marker").collect()}


def test_extraction(engine):
    def generate(text):
        return [{"kind": "person", "name": "Zed Quill", "confidence": 0.9}, {"kind": "deal", "name": "Bolt Labs", "confidence": 0.9, "status": "passed"}]

    engine.sync(engine.spark.createDataFrame([record(50, [ANN], "note", body="Zed Quill told Ann that Bolt Labs is raising a round now.")], RECORD), NOW)
    assert engine.extract(generate, NOW, "model", stop=lambda: True)["waiting"] > 0 and engine.table("extractions").count() == 0
    ran = engine.extract(generate, NOW, "model")
    assert ran["extracted"] > 0 and (ran["failed"], ran["waiting"], ran["stopped_after"]) == (0, 0, None)
    zed = who(engine, "Zed Quill")
    assert zed and engine.company_memory("Bolt Labs")["deals"].collect()[0].status == "passed"
    engine.extract(generate, NOW, "model")  # nothing waits any more
    assert who(engine, "Zed Quill") == zed and engine.table("extractions").count() == 1
