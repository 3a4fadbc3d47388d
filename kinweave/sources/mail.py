"""Mailboxes, read by a data source that cuts files at postmarks without a shuffle, and calendars. What they hold is read by column expressions."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from kinweave.functions import mailtext as M
from kinweave.schemas import RECORD

POSTMARK = re.compile(rb"From \S+ +(?:\w{3} )?\w{3} [ \d]\d [\d:]{5,8}(?: [+-]\d{4})? \d{4}")
#: Characters of a body that are gathered before it is decoded, and that are kept of its text: what the format's readers agree on.
MOST_RAW, MOST_BODY = 131_072, 65_536
#: Bytes of a file that one task reads at most, and where there are more tasks than that makes at least; and of messages that it hands on at a time.
SPLIT, LEAST, BATCH = 64 << 20, 1 << 20, 4 << 20
_LINE = 1 << 20


def _files(path: str) -> Iterator[tuple[str, int]]:
    """Files under a path and their sizes; names that begin with a dot or an underscore are left out."""
    system, root = _system(path)
    info = system.get_file_info(root)
    if info.type == arrow_fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.type == arrow_fs.FileType.File else system.get_file_info(arrow_fs.FileSelector(root, recursive=True))
    for f in sorted(found, key=lambda f: f.path):
        hidden = any(part[:1] in "._" for part in f.path[len(root) :].split("/") if part)
        if f.type == arrow_fs.FileType.File and not hidden:
            yield f.path, f.size


def _system(path: str) -> tuple[arrow_fs.FileSystem, str]:
    """The file system of a path as Arrow knows it: local folders that all executors see, hdfs, s3, gs, abfs."""
    path = re.sub("^s3[an]://", "s3://", path)
    if not re.match("[a-z0-9]+:/", path):
        return arrow_fs.LocalFileSystem(), os.path.abspath(path)
    return (arrow_fs.LocalFileSystem(), re.sub("^file:/+", "/", path)) if path.startswith("file:") else arrow_fs.FileSystem.from_uri(path)


@dataclass
class Range(InputPartition):
    """The messages of a file whose postmarks begin in ``start <= byte < end``."""

    path: str
    start: int
    end: int


def messages(lines, start: int, end: int, most: int) -> Iterator[tuple[int, str, str]]:
    """(place, head, body) of the messages that begin in a range of an open file. One message is held at a time, and of its body no more than ``most`` characters and a line."""
    lines.seek(max(0, start - 1))
    at = max(0, start - 1)
    if start:
        fresh = lines.read(1) == b"\n"  # does the range begin with a line?
        at += 1
    else:
        fresh = True
    place, head, body, in_head, size = None, [], [], False, 0

    def text(parts: list[bytes]) -> str:
        return b"".join(parts).decode("utf-8", "replace").replace("\r\n", "\n").removesuffix("\n")

    while line := lines.readline(_LINE):
        mark = fresh and line.startswith(b"From ") and POSTMARK.match(line)
        if (mark or place is None) and at >= end:
            break
        if mark:
            if place is not None:
                yield place, text(head), text(body)
            place, head, body, in_head, size = at, [], [], True, 0
        elif place is None:
            pass
        elif in_head and fresh and line in (b"\n", b"\r\n"):
            in_head = False
        elif in_head:
            head.append(line)
        elif size < most:
            body.append(line)
            size += len(line.decode("utf-8", "ignore"))
        at += len(line)
        fresh = line.endswith(b"\n")
    if place is not None:
        yield place, text(head), text(body)


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.path, self.split, self.most = options["path"], int(options.get("split", SPLIT)), int(options.get("most", MOST_RAW))
        self.tasks = int(options.get("tasks", 1))

    def partitions(self) -> list[Range]:
        """Ranges by size alone; nothing of the files is read here."""
        files = list(_files(self.path))
        step = min(self.split, max(LEAST, sum(size for _, size in files) // self.tasks))
        found = [Range(f, at, min(at + step, size)) for f, size in files for at in range(0, size, step)]
        return found or [Range("", 0, 0)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        if part.start >= part.end:
            return
        rows, size = [], 0
        pack = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.string(), pa.string()))], ["path", "place", "head", "body"])
        with _system(self.path)[0].open_input_file(part.path) as raw:
            for place, head, body in messages(_Lines(raw), part.start, part.end, self.most):
                rows.append((part.path, place, head, body))
                size += len(head) + len(body)
                if size >= BATCH:
                    yield pack()
                    rows, size = [], 0
        if rows:
            yield pack()


class _Lines:
    """Lines of an Arrow file, a block at a time."""

    def __init__(self, raw, block: int = 1 << 20):
        self.raw, self.block, self.held, self.at = raw, block, b"", 0

    def seek(self, to: int) -> None:
        self.raw.seek(to)
        self.held, self.at = b"", 0

    def read(self, n: int) -> bytes:
        if len(self.held) - self.at < n:
            self.held, self.at = self.held[self.at :] + self.raw.read(max(self.block, n)), 0
        out = self.held[self.at : self.at + n]
        self.at += len(out)
        return out

    def readline(self, most: int) -> bytes:
        end = self.held.find(b"\n", self.at, self.at + most)
        while end < 0 and len(self.held) - self.at < most and (more := self.raw.read(self.block)):
            self.held, self.at = self.held[self.at :] + more, 0
            end = self.held.find(b"\n", 0, most)
        return self.read(min(most, (end + 1 if end >= 0 else len(self.held)) - self.at))


class Mailbox(DataSource):
    """``spark.read.format("kinweave_mbox").load(path)``: (path, place, head, body) of each message; options ``split`` (bytes a task), ``tasks`` (to share small files among) and ``most`` (characters of a body)."""

    @classmethod
    def name(cls) -> str:
        return "kinweave_mbox"

    def schema(self) -> str:
        return "path string, place bigint, head string, body string"

    def reader(self, schema) -> _Reader:
        return _Reader(self.options)


#: Header fields that are read.
FIELDS = ("From", "To", "Cc", "Subject", "Date", "Message-ID", "Content-Type", "Content-Transfer-Encoding")


def mbox(spark: SparkSession, path: str, split: int = SPLIT, most_raw: int = MOST_RAW, most_body: int = MOST_BODY) -> DataFrame:
    """Messages of a mailbox or a folder of them, those aside that name no one; who is in From, To and Cc has that role. A body line that begins with "From " but is no postmark stays in its body."""
    spark.dataSource.register(Mailbox)
    raw = spark.read.format("kinweave_mbox").option("split", split).option("tasks", spark.sparkContext.defaultParallelism).option("most", most_raw).load(path)
    raw = raw.select("body", *[M.header(F.col("head"), n).alias(n) for n in FIELDS])
    body = M.text_body(F.col("`Content-Type`"), F.col("`Content-Transfer-Encoding`"), F.col("body"))
    record = dict(
        source=F.lit("mbox"), kind=F.lit("email"), external_id=F.regexp_replace("`Message-ID`", "[<>]", ""), title=M.decode_words(F.coalesce("Subject", F.lit("(no subject)"))),
        occurred_at=M.mail_date(F.col("Date")), people=F.concat(*[M.address_list(F.col(n), n.lower()) for n in FIELDS[:3]]), body=F.left(body, F.lit(most_body)),
    )
    # a filter of its own would be pushed below and read the addresses a second time
    named = F.filter(F.array(F.struct(*_columns(record))), lambda r: F.size(r.people) > 0)
    return raw.select(F.inline(named))


def _columns(record: dict[str, Column]) -> list[Column]:
    return [record.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in RECORD.fields]


_OPTIONS = r'(?:;[^:\n"]*+(?:"[^"\n]*+"[^:\n"]*+)*+)?'


def ics(spark: SparkSession, path: str) -> DataFrame:
    """Events of calendars; alarms inside them are left aside, local times are read as UTC. Large files are read in parts."""
    text = F.regexp_replace(F.regexp_replace("value", "\r\n", "\n"), "\n[ \t]", "")
    event = F.regexp_replace(F.substring_index(text, "BEGIN:VEVENT", -1), "(?s)BEGIN:VALARM.*?END:VALARM", "")
    rows = spark.read.option("lineSep", "END:VEVENT").text(path).where(F.contains("value", F.lit("BEGIN:VEVENT"))).select(event.alias("event"))

    def field(name: str) -> Column:
        first = F.get(F.regexp_extract_all("event", F.lit(rf"(?mid)^{name}{_OPTIONS}:([^\n]*+)"), F.lit(1)), F.lit(0))
        return F.regexp_replace(F.replace(F.trim(first), F.lit("\\n"), F.lit("\n")), r"\\([,;])", "$1")

    def person(line: Column) -> Column:
        value = F.regexp_replace(F.trim(F.regexp_extract(line, rf"(?id)^[a-z]+{_OPTIONS}:([^\n]*+)", 1)), "(?i)^mailto:", "")
        options = F.regexp_extract(line, rf"(?id)^[a-z]+({_OPTIONS}):", 1)
        name = F.coalesce(*[F.nullif(F.regexp_extract(options, rf"(?i);CN={v}", 1), F.lit("")) for v in ('"([^"]*+)"', '([^;:"]++)')])
        return F.struct(name.alias("name"), F.when(F.contains(value, F.lit("@")), value).alias("email"), F.lit(None).cast("string").alias("org"), F.lit("attendee").alias("role"))

    lines = F.regexp_extract_all("event", F.lit(rf"(?mid)^(?:ATTENDEE|ORGANIZER){_OPTIONS}:[^\n]*+"), F.lit(0))
    start = F.col("start")
    at = F.concat(F.regexp_replace(F.substring(start, 1, 8), r"^(\d{4})(\d\d)(\d\d)$", "$1-$2-$3"), F.lit("T"), F.when(start.rlike(r"^\d{8}T\d{6}"), F.regexp_replace(F.substring(start, 10, 6), "^(..)(..)(..)$", "$1:$2:$3")).otherwise("00:00:00"), F.lit("Z"))
    record = dict(
        source=F.lit("ics"), kind=F.lit("meeting"), external_id=field("UID"), title=field("SUMMARY"),
        occurred_at=F.when(start.rlike(r"^\d{8}"), at), people=F.transform(lines, person), body=field("DESCRIPTION"),
    )
    return rows.withColumn("start", field("DTSTART")).select(*_columns(record))
