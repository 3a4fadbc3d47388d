import hashlib

from kinweave.llm.common import new_path
from kinweave.llm.warc import capture_histories, loser_tree, warc_report

SAME = "<p>" + "é" * 60 + "</p>"
PAGES = [
    (1, "http://www.b.example.com:80/x?y=1#z", SAME),
    (2, "https://b.example.com/x?y=1", SAME),
    (3, None, None),
    (4, "http://a.example.org", ""),
    (5, "http://a.example.org", "short"),
    (6, "http://a.example.org", "short"),
    (7, "http://a.example.org/", "WARC/1.1\r\n\r\nContent-Length: 5\r\n\r\n" * 9),
    (8, "http://z.example/\r\n", "x" * 300_000),
    (8, "http://z.example/\r\n", "x" * 300_000),
    *[(100 + i, "http://hot.example/", "h" * 200) for i in range(40)],
]


def test_loser_tree():
    runs = [[1, 4, 4, 9], [], [2, 4], [0], [3, 3, 3]]
    for n in range(len(runs) + 1):
        assert list(loser_tree([iter(r) for r in runs[:n]], lambda x: x)) == sorted(x for r in runs[:n] for x in r)


def test_round_trip(spark):
    pages = spark.createDataFrame([(*p, 7) for p in PAGES], "page_id long, url string, html string, size int").repartition(3)
    want = []
    for p, _, html in PAGES:
        raw = (html or "").encode()
        first = min(q for q, _, h in PAGES if (h or "") == (html or ""))
        again = len(raw) >= 100 and first != p
        want.append((p, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", first if again else None))
    rows = warc_report(pages).collect()
    assert sorted((tuple(r)[:5] for r in rows), key=str) == sorted(want, key=str)
    assert {r.url_key for r in rows if r.page_id <= 2} == {"com,example,b)/x?y=1"}
    path = new_path(spark, "test")
    merged = capture_histories(pages, path).collect()
    assert [(r.url_key, r.captured, r.page_id) for r in merged] == sorted((r.url_key, r.captured, r.page_id) for r in merged)


def test_empty_table(spark):
    assert warc_report(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
