"""Operator 5: WARC archives, and capture histories by an external index merge.

Pages become WARC/1.1 records, written by Spark's text writer (its line separator is the two
line ends that close a record), one file a task; equal payloads of at least 100 bytes are
stored once and revisited. Reading takes each file whole, cuts it into records by their
Content-Length and checks every stored payload against its digest.

Each archive's index lines form a locally sorted run. The runs are dealt by ranges of (URL key,
timestamp, page), each range's part of a run staying sorted, and in each range a loser tree
merges them, so the histories are in order over all ranges. A range has some 20,000 lines; its size doesn't depend on how often one URL was captured, as the
timestamp is part of the range.

Defined cases: a null html is an empty payload; a null url has an empty key; payloads under 100
bytes are always responses; of equal payloads the smallest page_id is the response (repeats of
that id too); an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bitset
from .common import new_path, settle
from .textkit import tidied

LEAST_SHARED = 100
END = "\r\n\r\n"
#: Captures are a second apart from here on, for so many seconds; pages have no time of their own.
FIRST_CAPTURE, SECONDS = 1_704_067_200, 1_000_000_000
#: About how large a file may get, by the mean size of a payload.
FILE_BYTES = 64 << 20
INDEX = "page_id long, url_key string, captured string, record_type string, payload_bytes long, payload_digest string, refers_to long, archive string, position long"


def url_key(url: Column) -> Column:
    """A URL's sort key: host labels reversed and comma-joined, then path and query, without scheme, www, user, port or fragment."""
    u = F.lower(F.coalesce(url, F.lit("")))
    u = F.regexp_replace(F.regexp_replace(u, "#.*$", ""), "^[a-z][a-z0-9+.-]*://", "")
    host = F.regexp_replace(F.regexp_replace(F.regexp_extract(u, "^([^/?]*)", 1), "^.*@", ""), r"(^www[0-9]*\.)|(:[0-9]+$)", "")
    rest = F.regexp_extract(u, "^[^/?]*(.*)$", 1)
    return F.when(host == "", rest).otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), F.when(rest == "", "/").otherwise(rest)))


def _plan(pages: DataFrame) -> DataFrame:
    """Pages with payload, digest and refers_to (null for a response). Only possible revisits are shuffled."""
    payload = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("size", F.octet_length("payload").cast("long")).withColumn("digest", F.sha2(F.col("payload").cast("binary"), 256))
    digests = settle(rows.where(F.col("size") >= LEAST_SHARED).select("page_id", "digest"), "digests")
    shared = digests.groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = settle(shared.select("digest", "first"), "shared")
    again = digests.join(shared, "digest").where("page_id <> first").select(F.col("page_id").alias("p"), F.col("digest").alias("g"), "first").distinct()
    again = settle(again, "again")
    alone, maybe = bitset.split(rows, F.xxhash64("page_id", "digest"), again, F.xxhash64("p", "g"), again.count())
    maybe = maybe.join(again, (F.col("page_id") == F.col("p")) & (F.col("digest") == F.col("g")), "left")
    return alone.withColumn("refers_to", F.lit(None).cast("long")).unionByName(maybe.withColumnRenamed("first", "refers_to").drop("p", "g"))


def write_archives(pages: DataFrame, path: str) -> None:
    """Write a WARC record for each row of pages(page_id, url, html); files are runs sorted by URL key and time."""
    rows = _plan(pages).withColumn("key", url_key(F.col("url")))
    rows = rows.withColumn("second", F.lit(FIRST_CAPTURE) + F.pmod(F.coalesce("page_id", F.lit(0)), F.lit(SECONDS)))
    stamp = F.date_format(F.timestamp_seconds("second"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    revisit = F.col("refers_to").isNotNull()
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size").cast("string"), F.lit(END))
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("payload")))
    record_id = lambda c: F.concat(F.lit("<urn:kinweave:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: "), record_id(F.col("page_id"))),
        F.concat(F.lit("WARC-Date: "), stamp),
        F.concat(F.lit("WARC-Target-URI: "), F.regexp_replace(F.coalesce("url", F.lit("")), r"[\r\n]", "")),
        F.concat(F.lit("WARC-URL-Key: "), F.regexp_replace("key", r"[\r\n]", "")),
        F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.col("digest")),
        F.when(revisit, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), record_id(F.col("refers_to")))),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")),
    ]
    record = F.concat(F.concat_ws("\r\n", *lines), F.lit(END), block)
    sorted_runs = rows.sortWithinPartitions("key", "second", "page_id").select(record.alias("value"))
    mean = pages.agg(F.avg(F.octet_length("html"))).collect()[0][0] or 0
    sorted_runs.write.option("lineSep", END).option("maxRecordsPerFile", max(1, int(FILE_BYTES / (mean + 1_000)))).text(path)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The index of archives: a row for each record, in the order of each file."""

    def records(raw: memoryview) -> Iterator[tuple[dict[str, str], int, memoryview]]:
        data, at = bytes(raw), 0
        while at < len(data):
            end = data.index(b"\r\n\r\n", at)
            head = dict(x.split(": ", 1) for x in data[at:end].decode().split("\r\n")[1:])
            size = int(head["Content-Length"])
            yield head, at, raw[end + 4 : end + 4 + size]
            at = end + 8 + size

    def number(x: str | None) -> int | None:
        return int(x) if x and (x := x.removesuffix(">").rpartition(":")[2]) else None

    def run(batches):
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                out: list[list] = [[] for _ in range(9)]
                for head, at, block in records(memoryview(content.as_buffer())):
                    http, _, body = bytes(block).partition(b"\r\n\r\n")
                    size = int(http.rpartition(b"Content-Length: ")[2])
                    digest = head["WARC-Payload-Digest"].removeprefix("sha256:")
                    kind = head["WARC-Type"]
                    if kind == "response" and (len(body) != size or hashlib.sha256(body).hexdigest() != digest):
                        raise ValueError(f"{name}: the payload at {at} differs from its digest")
                    page, first = number(head["WARC-Record-ID"]), number(head.get("WARC-Refers-To"))
                    for o, v in zip(out, (page, head["WARC-URL-Key"], head["WARC-Date"], kind, size, digest, first, name, at)):
                        o.append(v)
                kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, kinds)], [f.split()[0] for f in INDEX.split(", ")])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    return files.mapInArrow(tidied(run), INDEX)


def loser_tree(runs: list[Iterator], key: Callable) -> Iterator:
    """Merge sorted runs. Each inner node holds the loser of its match; a step replays one path."""
    heads = [next(r, None) for r in runs]
    n = len(runs)

    def before(a: int, b: int) -> bool:
        if heads[a] is None or heads[b] is None:
            return heads[b] is None and (heads[a] is not None or a < b)
        ka, kb = key(heads[a]), key(heads[b])
        return ka < kb or ka == kb and a < b

    if not n:
        return
    losers = [-1] * n
    winners = [-1] * n + list(range(n))
    for node in range(n - 1, 0, -1):
        a, b = winners[2 * node], winners[2 * node + 1]
        winners[node], losers[node] = (a, b) if before(a, b) else (b, a)
    champion = winners[1] if n > 1 else 0
    while heads[champion] is not None:
        yield heads[champion]
        heads[champion] = next(runs[champion], None)
        node = (champion + n) // 2
        while node:
            if before(losers[node], champion):
                losers[node], champion = champion, losers[node]
            node //= 2


def merge_index(index: DataFrame, ranges: int) -> DataFrame:
    """All captures ordered by URL key, time and page over the partitions, with their place in their URL's history of this range."""

    def run(batches):
        kept = [b for b in batches if b.num_rows]
        if not kept:
            return
        table = pa.Table.from_batches(kept)
        archive, *keys = (table.column(c).to_pylist() for c in ("archive", "url_key", "captured", "page_id"))
        cuts = [0, *(i for i in range(1, len(archive)) if archive[i] != archive[i - 1]), len(archive)]
        # each run is in order; the tree holds one line of each
        place = lambda i: (keys[0][i], keys[1][i], keys[2][i] is not None, keys[2][i] or 0)
        order = list(loser_tree([iter(range(a, b)) for a, b in zip(cuts, cuts[1:])], place))
        yield from table.take(pa.array(order, pa.int64())).combine_chunks().to_batches()

    ranged = index.repartitionByRange(ranges, "url_key", "captured", "page_id")
    # the shuffle mixes the pieces of runs: Spark's external sort puts those of a range together again, each in order
    return ranged.sortWithinPartitions("archive", "url_key", "captured", "page_id").mapInArrow(tidied(run), INDEX)


def capture_histories(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Write the pages as archives, read them back, and merge their indexes."""
    spark = pages.sparkSession
    path = path or new_path(spark, "warc")
    write_archives(pages, path)
    index = settle(read_archives(spark, path), "index")
    return merge_index(index, max(2, -(-index.count() // 20_000)))


def warc_report(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, payload_bytes, payload_digest, record_type, refers_to, url_key, captured."""
    return capture_histories(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "captured")
