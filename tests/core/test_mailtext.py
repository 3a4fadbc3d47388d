import base64
import io
import quopri

from hypothesis import given, settings
from hypothesis import strategies as st
from kinweave.functions import mailtext as M
from kinweave.sources import mail
from pyspark.sql import functions as F


def column(spark, values, *use):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [tuple(r)[1:] for r in rows.select("i", *[u(F.col("t")).alias(f"c{j}") for j, u in enumerate(use)]).orderBy("i").collect()]


def test_address_lists(spark):
    texts = [
        "a@x.example", "Team: a@x.example, B <b@x.example>;", "a@x.example (Ann)", '"Q \\"x\\", y" <q@x.example>', "", None, "no address", " , ,",
        '"Roe, Jo" <jo@x.example>,kim@z.example', '=?utf-8?q?Zo=C3=AB_R?= <z@y.example>', '"a <b" <c@d.example>', '"open <o@x.example>', "<only@x.example>",
    ]
    got = [[(p.name, p.email) for p in r] for (r,) in column(spark, texts, lambda t: M.address_list(t, "to"))]
    assert got == [
        [(None, "a@x.example")], [(None, "a@x.example"), ("B", "b@x.example")], [("Ann", "a@x.example")], [('Q "x", y', "q@x.example")], [], [], [], [],
        [("Roe, Jo", "jo@x.example"), (None, "kim@z.example")], [("Zoë R", "z@y.example")], [("a <b", "c@d.example")], [('"open', "o@x.example")], [(None, "only@x.example")],
    ]
    many = ", ".join(f'"Person {i}, x" <p{i}@x.example>' for i in range(20_000))
    ((people,),) = column(spark, [many], M.address_list)
    assert len(people) == 20_000 and people[-1].name == "Person 19999, x"


def test_encoded_words(spark):
    texts = ["plain = text?", None, "", "=?utf-8?B?Wm/Dqw==?= =?iso-8859-1?q?_=EB=21?= x", "a =?UTF-8?Q?1+1=3D2_100%?= b", "=?utf-8?b?Wm/Dq?= =?utf-8?x?no?=", "=?utf-8?q?=FF?="]
    assert [r for (r,) in column(spark, texts, M.decode_words)] == ["plain = text?", None, "", "Zoë ë! x", "a 1+1=2 100% b", "Zo� =?utf-8?x?no?=", "�"]


def test_dates(spark):
    texts = [
        "Mon, 5 Jan 2026 10:00:00 +0100", "5 Jan 26 10:00 -0530", "Thu, 31 Dec 2026 23:59:59 EST", "Mon, 5 Jan 2026 10:00:00 GMT (x)", "Mon, 5 Jan 2026 10:00:00", "5 Jan 99 1:02:03 Z",
        "2026-01-05T10:00:00+02:00", "2026-01-05T10:00:00.5Z", "31 Feb 2026 10:00:00 Z", "5 Jan 2026 25:00:00 Z", "", None, "soon",
    ]
    want = [
        "2026-01-05T09:00:00Z", "2026-01-05T15:30:00Z", "2027-01-01T04:59:59Z", "2026-01-05T10:00:00Z", "2026-01-05T10:00:00Z", "1999-01-05T01:02:03Z",
        "2026-01-05T08:00:00Z", "2026-01-05T10:00:00Z", None, None, None, None, None,
    ]
    for zone in ("UTC", "America/New_York"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        try:
            assert [r for (r,) in column(spark, texts, M.mail_date)] == want
        finally:
            spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_transfer_encodings_round_trip(spark):
    texts = ["", "Zoë is = here + 100 %\nand\tthere", "x" * 5_000, "été " * 400, "日本語 🙂", "a=41 =\nb"]
    latin = [t for t in texts if all(ord(c) < 256 for c in t)]
    for some, code, utf8 in ((texts, "utf-8", True), (latin, "iso-8859-1", False)):
        qp = [quopri.encodestring(t.encode(code)).decode() for t in some]
        b64 = [base64.encodebytes(t.encode(code)).decode() for t in some]
        assert [r for (r,) in column(spark, qp, lambda t: M.from_quoted(t, F.lit(utf8)))] == some
        assert [r for (r,) in column(spark, b64, lambda t: M.from_base64(t, F.lit(utf8)))] == some
    odd = column(spark, ["Wm_Dqw", "W", "", None, "!!", "Wm9l\nW"], lambda t: M.from_base64(t, F.lit(True)))
    assert [r for (r,) in odd] == ["Zoë", "", "", None, "", "Zoe"]


def nested(kind, *parts):
    return f"Content-Type: multipart/{kind}; boundary=b{kind}\n\npreamble\n" + "".join(f"--b{kind}\n{p}\n" for p in parts) + f"--b{kind}--\nepilogue"


def test_bodies(spark, tmp_path):
    html, plain, none = "Content-Type: text/html\n\n<p>some<br>page</p>", "Content-Type: text/plain\n\nyes", "Content-Type: image/png\nContent-Transfer-Encoding: base64\n\nAAAA"
    bodies = {
        "Content-Type: text/plain; charset=utf-8\nContent-Transfer-Encoding: base64\n\nWm/Dqw==\n": "Zoë",
        "Content-Type: text/plain; charset=iso-8859-1\nContent-Transfer-Encoding: quoted-printable\n\nZo=EB is=\n here\n": "Zoë is here",
        nested("alternative", html, plain): "yes",
        nested("mixed", none, html, nested("alternative", html, plain)): "yes",
        nested("mixed", none, html, none): "some\npage",
        nested("mixed", "\nno head"): "no head",
        nested("a", nested("b", nested("c", plain))): "yes",
        nested("a", nested("b", nested("c", nested("d", plain)))): None,
        nested("mixed", none): None,
        'Content-Type: multipart/mixed; boundary="a (b) c"\n\n--a (b) c\nContent-Type: TEXT/PLAIN;\n charset=latin1\nContent-Transfer-Encoding: Quoted-Printable\n\n=E9t=E9\n--a (b) c--': "été",
        "Content-Type: multipart/mixed\n\nno boundary": None,
        "Subject: =?utf-8?B?Wm/Dqw==?=\n\n  \n": None,
        "X: y\n\nbare text\nFrom here on": "bare text\nFrom here on",
    }
    text = "".join(f"From x@y Mon Jan  5 10:00:00 2026\nFrom: a@x.example\nMessage-ID: <{i}>\n{b}\n\n" for i, b in enumerate(bodies))
    (tmp_path / "box").mkdir()
    (tmp_path / "box/a.mbox").write_text(text)
    (tmp_path / "box/b.mbox").write_bytes(text.replace("\n", "\r\n").encode())
    (tmp_path / "box/_SUCCESS").write_text("From x@y Mon Jan  5 10:00:00 2026\nFrom: a@x.example\n\nno")
    (tmp_path / "box/empty.mbox").write_text("")
    want = {str(i): b for i, b in enumerate(bodies.values())}
    for split in (50, 1 << 26):
        got = [(r.external_id, r.body and r.body.strip()) for r in mail.mbox(spark, str(tmp_path / "box"), split=split).collect()]
        assert len(got) == 2 * len(want) and dict(got) == want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["From a@x Mon Jan  5 10:00:00 2026\n", "From here\n", "\n", "To: b@x.example\n", "text\n", "text", "é\r\n"]), max_size=25), st.integers(1, 80))
def test_ranges_give_each_message_once(lines, split):
    data = "".join(lines).encode()
    whole = list(mail.messages(mail._Lines(io.BytesIO(data)), 0, len(data), 1 << 20))
    parts = [m for at in range(0, len(data), split) for m in mail.messages(mail._Lines(io.BytesIO(data), 5), at, min(at + split, len(data)), 1 << 20)]
    assert parts == whole
    marks = sum(1 for line in data.split(b"\n") if mail.POSTMARK.match(line))
    assert len(whole) == marks


def test_long_messages_are_cut_while_they_are_read():
    data = b"From a@x Mon Jan  5 10:00:00 2026\nFrom: a@x.example\n\n" + b"0123456789\n" * 100_000 + b"From a@x Mon Jan  5 10:00:01 2026\nSubject: two\n\nend\n"
    one, two = mail.messages(mail._Lines(io.BytesIO(data)), 0, len(data), 1_000)
    assert 1_000 <= len(one[2]) < 1_020 and (two[1], two[2]) == ("Subject: two", "end")
