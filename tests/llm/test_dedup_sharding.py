import hashlib
import zlib
from collections import defaultdict

from kinweave.llm.exact_dedup import exact_dedup, exact_dedup_report
from kinweave.llm.sharding import jump_hash, shard_rows
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, bucket string, keep_id long, slot int"
ROWS = [
    (1, "a b c", "x", 9, 0),
    (2, "a b c", "y", 9, 0),
    (3, "A b c", None, None, None),
    (4, None, "x", 9, 0),
    (5, "", "x", 9, 0),
    (6, "long " * 50_000, "x", 9, 0),
    (7, "long " * 50_000, "x", 9, 0),
    (8, "twice", "x", 9, 0),
    (8, "twice", "x", 9, 0),
    (None, "no id", "x", 9, 0),
    (None, "a b c", "x", 9, 0),
    *[(100 + i, "hot copy", "h", i, i) for i in range(200)],
    *[(1000 + i, f"alone {i}", "s", i, i) for i in range(300)],
]


def test_report_equals_brute_force(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    groups = defaultdict(list)
    for r in ROWS:
        groups[r[1] or ""].append(r[0])
    want = []
    for r in ROWS:
        ids = groups[r[1] or ""]
        keep = max((i for i in ids if i is not None), default=None)
        want.append((r[0], keep, len(ids), r[0] == keep, hashlib.sha256((r[1] or "").encode()).hexdigest()))
    got = [tuple(r) for r in exact_dedup_report(docs).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_kept_rows_carry_all_columns(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    kept = exact_dedup(docs)
    assert kept.schema == docs.schema
    rows = [tuple(r) for r in kept.collect()]
    best = {}
    for r in ROWS:
        key = r[1] or ""
        if key not in best or (r[0] is not None and (best[key][0] is None or r[0] > best[key][0])):
            best[key] = r
    assert sorted(rows, key=str) == sorted(best.values(), key=str)


def test_empty_tables(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert exact_dedup_report(docs).count() == 0
    assert exact_dedup(docs).count() == 0
    assert shard_rows(docs).count() == 0


def jump(key, shards):
    b, j, key = -1, 0, key & (2**64 - 1)
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) & (2**64 - 1)
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_jump_hash_is_the_published_one(spark):
    keys = [*range(500), -1, -5, 2**63 - 1, -(2**63), 123456789012345]
    rows = spark.createDataFrame([(k,) for k in keys], "k long").withColumnRenamed("k", "__kw_key")
    got = rows.select("__kw_key", jump_hash(F.col("__kw_key"), 16).alias("s")).collect()
    for r in got:
        assert (r.s.shard, r.s.grown) == (jump(r[0], 16), jump(r[0], 17))


def test_shards_slots_and_growth(spark):
    rows = shard_rows(spark.createDataFrame(ROWS, SCHEMA)).collect()
    assert len(rows) == len(ROWS)
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
        assert r.grown_shard in (r.shard, 16) and r.law == "key"
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    texts = {r[0]: r[1] or "" for r in ROWS if r[0] is not None}
    for r in rows:
        if r.doc_id is not None:
            raw = texts[r.doc_id].encode()
            assert (r.size, r.text_crc32) == (len(raw) + 1, zlib.crc32(raw))
