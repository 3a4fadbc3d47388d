import json

from kinweave.sources import crm


def read(spark, tmp_path, name, rows, schema):
    (tmp_path / name).write_text("\n".join(map(json.dumps, rows)))
    return spark.read.schema(schema).json(str(tmp_path / name))


def who(r):
    return [(p["name"], p.email, p.org, p.role) for p in r.people]


def test_attio(spark, tmp_path):
    c = [{"id": {"record_id": "c1"}, "created_at": "2026-01-02T03:04:05Z", "values": {"name": [{"value": "Moss Media"}]}}, {"id": {"record_id": "c2"}, "values": {"name": []}}]
    p = [
        {"id": {"record_id": "p1"}, "values": {"name": [{"first_name": "Ida", "last_name": "Moss"}], "email_addresses": [{"email_address": "ida@m.example"}, {"value": "i2@m.example"}, {"value": "no"}], "company": [{"target_record_id": "c2"}, {"target_record_id": "c1"}]}},
        {"id": {"record_id": "p2"}, "values": {"name": [{"full_name": "Lou"}]}}, {"id": {"record_id": "p3"}, "values": {"email_addresses": []}},
    ]
    companies = crm.attio_companies(read(spark, tmp_path, "c", c, crm.COMPANIES))
    people = crm.attio_people(read(spark, tmp_path, "p", p, crm.PERSONS), companies)
    docs = {r.external_id: r for r in crm.attio_records(companies, people).collect()}
    assert set(docs) == {"attio-company-c1", "attio-person-p1", "attio-person-p2"}
    assert who(docs["attio-person-p1"]) == [("Ida Moss", "ida@m.example", "Moss Media", "mentioned"), ("Ida Moss", "i2@m.example", "Moss Media", "mentioned")] and docs["attio-person-p1"].orgs == ["Moss Media"]
    assert who(docs["attio-person-p2"]) == [("Lou", None, None, "mentioned")] and docs["attio-company-c1"].occurred_at == "2026-01-02T03:04:05.000Z"
    notes = [{"id": {"note_id": "n1"}, "parent_record_id": "p1", "title": "", "created_at": "2026-02-02T00:00:00Z", "content": "secret"}, {"id": {"note_id": "n2"}, "parent_record_id": "zz"}]
    (n,) = crm.attio_notes(read(spark, tmp_path, "n", notes, crm.NOTES), people).collect()
    assert (n.title, n.external_id, who(n)) == ("(untitled note)", "attio-note-n1", [("Ida Moss", "ida@m.example", None, "mentioned")]) and n.body is None


def test_affinity(spark, tmp_path):
    o = read(spark, tmp_path, "o", [{"id": 1, "name": "Peak", "domain": "peak.example"}, {"id": 2, "name": None}], crm.AFFINITY["organizations"])
    p = read(spark, tmp_path, "p", [{"id": 7, "first_name": "Raj", "last_name": "P", "primary_email": "r@p.example", "emails": ["r@p.example", "x@p.example"], "organization_ids": [2, 1]}, {"id": 8, "emails": []}], crm.AFFINITY["persons"])
    n = read(spark, tmp_path, "n", [{"id": 5, "person_ids": [8, 7], "created_at": "2026-01-01T00:00:00Z"}, {"id": 6, "person_ids": [8]}], crm.AFFINITY["notes"])
    docs = {r.external_id: r for r in crm.affinity(p, o, n).collect()}
    assert set(docs) == {"affinity-org-1", "affinity-person-7", "affinity-note-5"} and json.loads(docs["affinity-org-1"].raw) == {"domain": "peak.example"}
    assert [x[1] for x in who(docs["affinity-person-7"])] == ["r@p.example", "x@p.example"] and docs["affinity-person-7"].orgs == ["Peak"]
    assert who(docs["affinity-note-5"]) == [("Raj P", "r@p.example", None, "mentioned")]


def test_granola(spark, tmp_path):
    docs = {"a": {"id": "a", "title": "Sync", "created_at": "2026-01-01T00:00:00Z", "people": {"creator": {"name": "Ann", "email": "a@x.example"}, "attendees": [{"email": "A@x.example"}, {"name": " "}, {"displayName": "Bo"}]}}, "b": {"id": "b", "people": []}}
    for i, text in enumerate([json.dumps({"cache": json.dumps({"state": {"documents": docs}})}), json.dumps({"state": {"documents": list(docs.values())}})]):
        (tmp_path / f"{i}.json").write_text(text)
        (r,) = crm.granola(spark, str(tmp_path / f"{i}.json")).collect()
        assert (r.external_id, r.title, r.kind, who(r)) == ("a", "Sync", "meeting", [("Ann", "a@x.example", None, "attendee"), ("Bo", None, None, "attendee")])


def test_mail_calendar_drive(spark, tmp_path):
    h = lambda **k: {"headers": [{"name": n.replace("_", "-"), "value": v} for n, v in k.items()]}
    rows = [{"id": "1", "payload": h(From='"Roe, Jo" <jo@x.example>', To="=?utf-8?q?Zo=C3=AB?= <z@y.example>, k@z.example", Date="Mon, 5 Jan 2026 10:00:00 +0100", Message_ID="<m1>")}, {"id": "2", "payload": h(Subject="none")}]
    (r,) = crm.gmail(read(spark, tmp_path, "g", rows, crm.MESSAGES)).collect()
    assert (r.external_id, r.title, r.occurred_at) == ("m1", "(no subject)", "2026-01-05T09:00:00Z")
    assert [x[:2] + x[3:] for x in who(r)] == [("Roe, Jo", "jo@x.example", "from"), ("Zoë", "z@y.example", "to"), (None, "k@z.example", "to")]
    e = [{"id": "e", "start": {"date": "2026-01-05"}, "attendees": [{"email": "a@x.example"}, {"displayName": "no"}], "organizer": {"displayName": "Org", "email": "o@x.example"}}, {"id": "f"}]
    (r,) = crm.calendar(read(spark, tmp_path, "e", e, crm.CALENDAR)).collect()
    assert (r.occurred_at, r.title, [x[1] for x in who(r)]) == ("2026-01-05T00:00:00Z", "(untitled event)", ["a@x.example", "o@x.example"])
    f = [{"id": "f", "name": "Deck", "modifiedTime": "2026-01-01T00:00:00Z", "owners": [{"displayName": "O"}], "lastModifyingUser": {"emailAddress": "l@x.example"}, "permissions": [{"emailAddress": "p@x.example"}, {"displayName": "any"}]}, {"id": "g"}]
    (r,) = crm.drive(read(spark, tmp_path, "f", f, crm.DRIVE)).collect()
    assert [(x[0], x[1], x[3]) for x in who(r)] == [("O", None, "author"), (None, "l@x.example", "author"), (None, "p@x.example", "mentioned")]
