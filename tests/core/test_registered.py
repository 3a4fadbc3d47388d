"""The registered functions, against the column expressions of the same name."""

import pytest
from pyspark.sql import functions as F

from kinweave.functions import registered
from kinweave.functions import text as T
from kinweave.functions.similarity import name_similarity
from kinweave.operators.extract import chunks

NAMES = [None, "", "  ", "Dr. Ann O'Neil-Smith", "MR", 'Zoë "Z" Bell', "a", "Acme Capital Partners, LLC", "The Fund", "x.y z", "Acme\tDigest", "it’s \\ me", "ann lee", "Lee Ann 3"]
EMAILS = [None, "", "x", " Ann+News@Acme.Example ", "no-reply@acme.example", "Team@acme.example", "a@mail.acme.example", "a@b@c", "@", "ann@gmail.com", "list-bounces@x.example", "it's@x.example"]
PAGES = [None, "", "<p>a</p>b<br/>c", "<script>x\n</script>t<STYLE>y</style>", "1 &lt; 2 &amp;&amp; &quot;it&#39;s&quot;&nbsp;\\n", "<div>a</div>\n\n\n\n<li>b", "<b>  \t </b>"]


@pytest.fixture(scope="module")
def sql(spark):
    registered.register(spark)
    return spark.sql


def test_text_functions(spark, sql):
    spark.createDataFrame([(n, e, k) for n in NAMES for e in EMAILS for k in ("person", "org")], "name string, email string, kind string").createOrReplaceTempView("who")
    got = sql("SELECT norm_email(email) AS a, norm_person(name) AS b, norm_org(name) AS c, block_keys(name, email, kind) AS d, classify_address(email, name) AS e FROM who")
    n, e = F.col("name"), F.col("email")
    expected = spark.table("who").select(
        T.norm_email(e).alias("a"), T.norm_person(n).alias("b"), T.norm_org(n).alias("c"), T.block_keys(n, e, F.col("kind")).alias("d"), T.classify_address(e, n).alias("e"),
    )
    assert got.collect() == expected.collect()
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString()
    assert [r[0] for r in sql("SELECT is_freemail(e) FROM VALUES ('a@gmail.com'), ('a@acme.example'), ('a'), (NULL) AS t(e)").collect()] == [True, False, None, None]
    spark.createDataFrame([(p,) for p in PAGES], "html string").createOrReplaceTempView("pages_of")
    assert [r[0] for r in sql("SELECT strip_html(html) FROM pages_of").collect()] == [r[0] for r in spark.table("pages_of").select(T.strip_html(F.col("html"))).collect()]


def test_similarity(spark, sql):
    some = [None, "", "ann lee", "a lee", "lee ann", "anne leigh", "bob"]
    spark.createDataFrame([(a, b) for a in some for b in some], "a string, b string").createOrReplaceTempView("two")
    got = [r[0] for r in sql("SELECT name_similarity(a, b) FROM two").collect()]
    assert got == pytest.approx([r[0] for r in spark.table("two").select(name_similarity(F.col("a"), F.col("b"))).collect()])


def test_chunks(spark, sql):
    texts = [None, "", "short", "x" * 20_000, "x" * 20_001, ("line\n" * 9_000), "a" * 15_000 + "\n" + "b" * 30_000, "é" * 130_000, "x" * 20_000 + "\n" + "y" * 50]
    spark.createDataFrame(list(enumerate(texts)), "id int, body string").createOrReplaceTempView("bodies")
    got = sql("SELECT id, chunk, text, at, substring(body, at + 1, length(text)) = text AS placed FROM bodies, LATERAL text_chunks(body) ORDER BY id, chunk").collect()
    expected = spark.table("bodies").select("id", F.posexplode(chunks(F.col("body"))).alias("chunk", "text")).orderBy("id", "chunk").collect()
    assert [(r.id, r.chunk, r.text) for r in got] == [(r.id, r.chunk, r.text) for r in expected] and all(r.placed for r in got)
    assert [(r.chunk, r.at, r.text) for r in sql("SELECT * FROM text_chunks('abcdefghij', 9, 4, 1)").collect()] == [(0, 0, "abcd"), (1, 3, "defg"), (2, 6, "ghi")]
