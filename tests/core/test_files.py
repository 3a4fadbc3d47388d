import json

import pytest
from kinweave.operators import ingest as I
from kinweave.settings import next_due
from kinweave.sources import files, mail
from kinweave.store import KEPT, Store
from kinweave.streaming import records as C
from pyspark.sql import functions as F


def doc(i, title, body=None, at="2026-01-01T00:00:00Z"):
    return {"source": "local", "kind": "note", "external_id": f"x{i}", "title": title, "occurred_at": at, "people": [{"name": "Ann Lee", "email": None, "org": None, "role": None}], "orgs": ["Acme Ltd"], "body": body}


def test_the_last_line_wins_and_an_earlier_body_stays(spark, tmp_path):
    long = "a body that is long enough to be worth keeping here"
    (tmp_path / "a.jsonl").write_text("\n".join(map(json.dumps, [doc(1, "first", long), doc(1, "zz"), doc(2, "only"), doc(1, "last")])) + "\n\n")
    for n in ("100", "128m"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", n)
        try:
            d, m = I.normalise(files.jsonl(spark, str(tmp_path / "a.jsonl")))
            rows = {r.external_id: (r.title, r.body) for r in d.collect()}
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", "128m")
        assert rows == {"x1": ("last", long), "x2": ("only", None)}
    assert {(r.kind, r.norm_name) for r in m.collect()} == {("person", "ann lee"), ("org", "acme")}
    d2, m2 = I.ingest(d, m, files.jsonl(spark, str(tmp_path / "a.jsonl")), bodies=False)
    assert {r.body for r in d2.collect()} == {None} and m2.count() == m.count()


def test_a_bad_line_is_named(spark, tmp_path):
    (tmp_path / "b.jsonl").write_text(json.dumps(doc(1, "a")) + "\n\n{oops\n" + json.dumps(doc(2, "b")) + "\n")
    assert files.bad_line(spark, str(tmp_path / "b.jsonl")).endswith("b.jsonl:3: {oops")
    (tmp_path / "c.jsonl").write_text(json.dumps(doc(1, "a")))
    assert files.bad_line(spark, str(tmp_path / "c.jsonl")) is None
    with pytest.raises(Exception, match="(?i)malformed|bad record"):
        files.jsonl(spark, str(tmp_path / "b.jsonl")).collect()


def test_connections_with_quoted_fields(spark, tmp_path):
    (tmp_path / "l.csv").write_text('Notes:\n"some, text"\n\nFirst Name,Last Name,URL,Email Address,Company,Position,Connected On\nJo,"Roe, Jr",http://u/1,jo@x.example,"X,\nLtd",CEO,12 Mar 2021\nAl,Poe,,,,,bad\n')
    (row,) = files.connections(spark, str(tmp_path / "l.csv")).collect()
    assert (row.title, row.people[0].org, row.occurred_at, row.people[0].email) == ("Jo Roe, Jr", "X,\nLtd", "2021-03-12T00:00:00Z", "jo@x.example")


def test_calendars(spark, tmp_path):
    (tmp_path / "a.ics").write_bytes(b"BEGIN:VEVENT\r\nUID:7\r\nSUMMARY:Long \r\n title\r\nDTSTART;VALUE=DATE:20260105\r\nORGANIZER;CN=Org:mailto:o@x.example\r\nATTENDEE;ROLE=X;CN=\"Roe: Jo\":no address\r\nDESCRIPTION:a\\, b\\; c\\nd\r\nEND:VEVENT\r\n")
    (e,) = mail.ics(spark, str(tmp_path / "a.ics")).collect()
    assert (e.title, e.occurred_at, e.body, e.external_id) == ("Long title", "2026-01-05T00:00:00Z", "a, b; c\nd", "7")
    assert [(p.name, p.email) for p in e.people] == [("Org", "o@x.example"), ("Roe: Jo", None)]


def test_snapshots(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/store")
    t = lambda n: spark.createDataFrame([(n,)], "n int")
    with pytest.raises(ValueError):
        s.read("t")
    for n in range(6):
        s.commit({"t": t(n), "u": t(-n)} if n % 2 == 0 else {"t": t(n)})
    assert s.read("t").collect()[0].n == 5 and s.read("u").collect()[0].n == -4 and len(s.snapshots()) == KEPT
    assert len([p for p in (tmp_path / "store/t").iterdir()]) == KEPT


def test_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text("\n".join(json.dumps({"external_id": k, "pair": "p", "at": f"2026-01-01T0{h}:00:00Z"}) for k, h in (("a", 1), ("a", 2), ("b", 3))))
    stream = spark.readStream.schema("external_id string, pair string, at timestamp").json(str(tmp_path / "in"))
    for name, df, mode in (("once", C.once(stream), "append"), ("bursts", C.bursts(stream), "complete"), ("windows", C.contact_counts(stream, panes=False), "complete")):
        df.writeStream.format("memory").queryName(f"kw_{name}").outputMode(mode).trigger(availableNow=True).start().awaitTermination(120)
    assert {r.external_id for r in spark.table("kw_once").collect()} == {"a", "b"} and spark.table("kw_once").count() == 2
    assert [r.contacts for r in spark.table("kw_bursts").collect()] == [3]
    assert spark.table("kw_windows").agg(F.sum("contacts")).collect()[0][0] == 3 * 90


def test_windows_of_days_that_are_over(spark, tmp_path):
    (tmp_path / "in").mkdir()
    times = [["2026-01-01T01:00:00Z", "2026-01-01T02:00:00Z", "2026-01-03T00:00:00Z"], ["2027-01-01T00:00:00Z"], ["2027-01-02T00:00:00Z"]]
    for i, some in enumerate(times):
        (tmp_path / f"in/{i}.json").write_text("\n".join(json.dumps({"pair": "p", "at": t}) for t in some))
    schema = "pair string, at timestamp"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    C.contact_counts(stream).writeStream.format("memory").queryName("kw_days").outputMode("append").trigger(availableNow=True).start().awaitTermination(120)
    whole = C.contact_counts(spark.read.schema(schema).json(str(tmp_path / "in/0.json")))
    got, want = ({(r.window.start, r.pair, r.contacts) for r in df.collect()} for df in (spark.table("kw_days"), whole))
    assert got == want and len(got) == 92


def test_next_due():
    assert [next_due(100, 10, k) for k in (0, 1, 4, 9)] == [110, 120, 260, 260] and next_due(0, 50_000, 3) == 86_400 and next_due(0, 100_000, 2) == 100_000


def test_loading_names_a_bad_line(spark, tmp_path):
    from kinweave.api import Engine

    engine = Engine(spark, str(tmp_path / "graph"))
    (tmp_path / "b.jsonl").write_text('{"source": "local"}\n\n{oops\n')
    with pytest.raises(ValueError, match=r"b\.jsonl:3: \{oops"):
        engine.load(str(tmp_path / "b.jsonl"))
    (tmp_path / "c.jsonl").write_text('{"source": "local", "external_id": "1"}\n')
    assert engine.load(str(tmp_path / "c.jsonl")).count() == 1
