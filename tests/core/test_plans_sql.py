"""Queries against their SQL twins on tables made for what could tell them apart."""

import duckdb
from kinweave.plans import ORACLE_SQL, QUERIES


def both(spark, folder, query, **tables):
    """What a query and its SQL give, as sorted rows."""
    con = duckdb.connect()
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet/*.parquet')")
    rows = sorted((tuple(r) for r in QUERIES[query](spark, str(folder)).collect()), key=str)
    return rows, sorted(con.execute(ORACLE_SQL[query]).fetchall(), key=str)


def texts(*each):
    return [(i, t) for i, t in enumerate(each)], "doc_id long, text string"


def test_addresses_as_wholes(spark, tmp_path):
    documents = texts(
        "to a@b.co.", "a@b.co", "A@B.co, twice a@b.co", "a@b.co_x", "a@b.co%", "a@b.co+1 and a@b.co", "q@a@b.co", "x@y.co@a@b.co z", "İa@b.co", "\u212aa@b.co", "ka@b.co ia@b.co", "éa@b.coé", "x_a@b.co", None, "",
        "mar\u212a@b.co", "mark@b.co", "a@", "@b.co", "a@b.co\na@b.co",
    )
    got, want = both(spark, tmp_path, "email_ground", documents=documents)
    assert got == want and len(got) > 10


def test_phrases_and_places(spark, tmp_path):
    documents = texts(
        "of the", "man.of.the@hill.co", "x of the@x.co", "of a@b the", "İİ of the THE", "İİ OF--THE", "\U0001d4b3 of the", "ΑΣ of the", "softhe of thé", "of     the", "of the9", None, "", "\u212a of\n\nthe", "a@of the.co",
    )
    got, want = both(spark, tmp_path, "phrase_ground", documents=documents)
    assert got == want and len(got) > 7
