"""Operator 11: conversations whose turns are in order again, at the least cost.

A row of a conversation may be blank, a duplicate of an earlier one, or truncated. A repair keeps, reroles or
deletes rows and inserts empty ones, so that the roles' initials read (s?(ua)+)?. The costs to go from each place
and state of that grammar (nothing yet, after s, after u, after a) are found backwards; then a walk forwards takes,
of the edits that lose nothing against them, the one whose letter (D, I, K, R) is least in ASCII.

A conversation of up to ``large_rows`` rows and ``large_bytes`` of text is repaired by the task that its rows are
shuffled to, one conversation after the other. A larger one may be of any size, so its rows are dealt over tasks by
ranges of turns; each range gives the 4 by 4 matrix of what it costs to come from one state to another through it.
Matrices multiply by (min, +); from the end backwards they tell the costs to go at each range's end, a few numbers a
range. With those the walk needs one range at a time, so the task that puts the conversation together (its hash
needs all turns in order) holds no more than a range. Whether a turn of a large conversation was seen before is
found by a join on its digest.

Defined cases: a null id is a conversation of its own; a null role or text is one space; turns that are null come
first; rows with the same turn are taken in the order of role and text; a role is what its first letter says, and
one whose letter doesn't fit is reroled or deleted; a conversation all of whose rows are dropped gives zeros, no
edits and the hash of nothing; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import settle
from .textkit import tidied

#: The costs of edits.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
LARGE_ROWS, LARGE_BYTES = 20_000, 8 << 20
NEVER = 1 << 50
SPACE = " \t\n\v\f\r"
#: The states of the grammar: nothing yet, after s, after u, after a; where each initial leads, and what would lead on.
NEXT = [{"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2}]
ON = ["u", "u", "a", "u"]
ROLES = {"u": "user", "a": "assistant"}
LEGAL = {"su", "ua", "au"}
SUMMED = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def damage(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, dropped): rows harmed by the crc32 of ``conv_id:turn`` modulo 20.

    0 drops a row, 1 empties its text, 2 removes the text's . ! and ?, 3 repeats the row, 4 gives it the role user."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    harm = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn")).cast("binary")) % 20
    text = F.when(harm == 1, "").when(harm == 2, F.translate(said("text"), ".!?", "")).otherwise(said("text"))
    role = F.when(harm == 4, "user").otherwise(said("role"))
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), (harm == 0).alias("dropped"), F.when(harm == 3, 2).otherwise(1).alias("__kw_times"))
    return rows.withColumn("__kw_times", F.explode(F.array_repeat(F.lit(0), F.col("__kw_times")))).drop("__kw_times")


def relax(c: list[int]) -> list[int]:
    """Costs to go with insertions here."""
    start, s, u, a = c
    u, a = min(u, INSERT + a), min(a, INSERT + u)
    return [min(start, INSERT + u), min(s, INSERT + u), u, a]


END = relax([0, NEVER, NEVER, 0])


def step(after: list[int], initial: str, must: bool, cut: bool) -> list[int]:
    """Costs to go before a row, from those after it."""
    c = [DELETE + x for x in after]
    if not must:
        more = TRUNCATED if cut else 0
        for st in range(4):
            to = NEXT[st].get(initial)
            if to is not None:
                c[st] = min(c[st], more + after[to])
            c[st] = min(c[st], REROLE + more + after[NEXT[st][ON[st]]])
    return relax(c)


def faults(text: str, seen: bool) -> tuple[bool, bool, bool]:
    """(blank, duplicate, truncated): the first that holds."""
    t = text.strip(SPACE)
    return not t, bool(t) and seen, bool(t) and not seen and t[-1] not in ".!?"


class Walk:
    """A conversation's repair, fed with its rows range by range."""

    def __init__(self):
        self.state, self.cost, self.edits, self.hash = 0, 0, [], hashlib.sha256()
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.least = self.last_turn = self.last_role = None
        self.known: set[bytes] = set()
        self.none_yet = True

    def _put(self, edit: str, role: str, text: str, out: list | None) -> None:
        self.hash.update(("" if self.none_yet else "\n").encode() + f"{role}:{text}".encode())
        self.none_yet = False
        self.state = NEXT[self.state][role[0]]
        if out is not None:
            out.append((edit, role, text))

    def _insert(self, out: list | None) -> None:
        self.edits.append("I")
        self.cost += INSERT
        self._put("I", ROLES[ON[self.state]], "", out)

    def feed(self, rows: list[tuple], after: list[int], out: list | None = None) -> None:
        """Rows (turn, role, text, seen) in order; ``after`` has the costs to go behind them. ``out`` gets the repaired turns."""
        facts = []
        for turn, role, text, seen in rows:
            if seen is None:
                digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()
                seen = digest in self.known
                self.known.add(digest)
            blank, twice, cut = faults(text, seen)
            self.blank, self.duplicate, self.truncated = self.blank + blank, self.duplicate + twice, self.truncated + cut
            if self.last_role is not None and self.last_role + role[:1] not in LEGAL:
                self.illegal += 1
            self.last_role = role[:1]
            if turn is not None and turn != self.last_turn:
                self.least, self.last_turn, self.turns = turn if self.least is None else self.least, turn, self.turns + 1
            facts.append((role[:1], blank or twice, cut))
        togo = [after]
        for fact in reversed(facts):
            togo.append(step(togo[-1], *fact))
        togo.reverse()
        i = 0
        while i < len(rows):
            (_, role, text, _), (initial, must, cut) = rows[i], facts[i]
            here, there, st = togo[i], togo[i + 1], self.state
            more = TRUNCATED if cut else 0
            on = NEXT[st][ON[st]]
            if DELETE + there[st] == here[st]:
                self.edits.append("D")
                self.cost += DELETE
            elif INSERT + here[on] == here[st]:
                self._insert(out)
                continue
            elif not must and initial in NEXT[st] and more + there[NEXT[st][initial]] == here[st]:
                self.edits.append("K")
                self.cost += more
                self._put("K", role, text, out)
            else:
                self.edits.append("R")
                self.cost += REROLE + more
                self._put("R", ROLES[ON[st]], text, out)
            i += 1

    def close(self, out: list | None = None) -> None:
        while self.state in (1, 2):
            self._insert(out)

    def summary(self) -> tuple:
        gaps = self.last_turn - self.least + 1 - self.turns if self.turns else 0
        return gaps, self.blank, self.duplicate, self.truncated, self.illegal, self.cost, "".join(self.edits)


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[tuple], list[int] | None]]:
    """(conversation and range, its rows, costs to go behind them) of sorted rows."""
    at, rows, after = None, [], None
    for b in batches:
        c = {n: b.column(n).to_pylist() for n in ("conv_id", "__kw_block", "turn", "role", "text", "dropped", "__kw_seen", "__kw_after")}
        for i in range(b.num_rows):
            key = (c["conv_id"][i], c["__kw_block"][i])
            if key != at:
                if at is not None:
                    yield at, rows, after
                at, rows, after = key, [], c["__kw_after"][i]
            if not c["dropped"][i]:
                rows.append((c["turn"][i], c["role"][i], c["text"][i], c["__kw_seen"][i]))
    if at is not None:
        yield at, rows, after


def _repair(rows: DataFrame, turns: bool) -> DataFrame:
    """Walk through sorted rows (conv_id, __kw_block, turn, role, text, dropped, __kw_seen, __kw_after)."""
    head = T.StructType([rows.schema["conv_id"]])
    more = "place long, edit string, role string, text string" if turns else f"{SUMMED}, repaired_sha256 string"
    schema = T.StructType([*head.fields, *T._parse_datatype_string(more).fields])
    from pyspark.sql.pandas.types import to_arrow_schema

    kind = to_arrow_schema(schema)

    def run(batches):
        walk, now, place, held = None, None, 0, []

        def emit(values):
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*values), kind)], schema=kind)

        def done():
            nonlocal place
            out = [] if turns else None
            walk.close(out)
            if turns:
                held.extend((now[0], place + k, *x) for k, x in enumerate(out))
            else:
                held.append((now[0], *walk.summary(), walk.hash.hexdigest()))

        for key, found, after in _ranges(batches):
            if now is not None and key[0] != now[0]:
                done()
            if now is None or key[0] != now[0]:
                walk, place = Walk(), 0
            now = key
            out = [] if turns else None
            walk.feed(found, after or END, out)
            if turns:
                held.extend((key[0], place + k, *x) for k, x in enumerate(out))
                place += len(out)
            if len(held) >= 1_000:
                yield emit(held)
                held.clear()
        if now is not None:
            done()
        if held:
            yield emit(held)

    return rows.mapInArrow(tidied(run), schema)


def _same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def _marked(rows: DataFrame, large_rows: int, large_bytes: int) -> tuple[DataFrame, DataFrame | None]:
    """Rows of small conversations, and of large ones with their ranges, whether they were seen before, and the costs to go behind their range."""
    size = rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("b"))
    large = settle(size.where((F.col("n") > large_rows) | (F.col("b") > large_bytes)).withColumnRenamed("conv_id", "__kw_conv"), "large")
    total = large.agg(F.sum("n").alias("n"), F.sum("b").alias("b")).collect()[0]
    small = rows if not total.n else rows.join(large, _same("conv_id", "__kw_conv"), "left_anti")
    small = small.withColumns({"__kw_block": F.lit(0), "__kw_seen": F.lit(None).cast("boolean"), "__kw_after": F.lit(None).cast("array<long>")})
    small = small.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    if not total.n:
        return small, None
    parts = -(-total.n // large_rows) + total.b // large_bytes + 1
    conv = rows.schema["conv_id"]
    those = rows.join(large, _same("conv_id", "__kw_conv"), "left_semi").where("not dropped")
    those = those.withColumn("digest", F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256))
    first = those.groupBy(F.col("conv_id").alias("c"), F.col("digest").alias("d")).agg(F.min(F.struct(F.col("turn").isNotNull().alias("dated"), "turn")).alias("first"))
    those = those.join(first, _same("conv_id", "c") & (F.col("digest") == F.col("d"))).select("conv_id", "turn", "role", "text", "digest", (~F.col("first.turn").eqNullSafe(F.col("turn"))).alias("later"))
    ranged = those.repartitionByRange(int(parts), "conv_id", "turn", "role", "text").sortWithinPartitions("conv_id", "turn", "role", "text")
    schema = T.StructType([conv, *T._parse_datatype_string("__kw_block int, turn long, role string, text string, __kw_seen boolean, __kw_matrix array<long>").fields])
    from pyspark.sql.pandas.types import to_arrow_schema

    kind = to_arrow_schema(schema)

    def run(batches):
        block, now, last, matrix, any_ = TaskContext.get().partitionId(), None, None, None, False

        def whole():  # a range's matrix goes out as a row without role
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((now, block, None, None, None, None, [x for r in matrix for x in r]), kind)], schema=kind)

        for b in batches:
            conv_ids, turns, roles, texts, digests, later = (b.column(n).to_pylist() for n in ("conv_id", "turn", "role", "text", "digest", "later"))
            seen = []
            for i, key in enumerate(conv_ids):
                if any_ and key != now:
                    yield whole()
                if not any_ or key != now:
                    now, last, matrix, any_ = key, None, [[0 if i == j else NEVER for j in range(4)] for i in range(4)], True
                seen.append(later[i] or last == (turns[i], digests[i]))
                last = (turns[i], digests[i])
                blank, twice, cut = faults(texts[i], seen[-1])
                # what a row costs from each state to each, put behind what came before
                each = [step([0 if k == j else NEVER for k in range(4)], roles[i][:1], blank or twice, cut) for j in range(4)]
                matrix = [[min(NEVER, *(r[k] + each[j][k] for k in range(4))) for j in range(4)] for r in matrix]
            n = b.num_rows
            values = [b.column("conv_id"), pa.array([block] * n), b.column("turn"), b.column("role"), b.column("text"), pa.array(seen, pa.bool_()), pa.nulls(n, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([v.cast(f.type) for v, f in zip(values, kind)], schema=kind)
        if any_:
            yield whole()

    dealt = settle(ranged.mapInArrow(tidied(run), schema), "ranges")
    after = T.StructType([conv, *T._parse_datatype_string("__kw_block int, __kw_after array<long>").fields])

    def behind(t: pa.Table) -> pa.Table:
        """The costs to go behind each range of a conversation: a few numbers a range."""
        found, c = [], END
        for block, m in sorted(zip(t["__kw_block"].to_pylist(), t["__kw_matrix"].to_pylist()), reverse=True):
            found.append((block, c))
            c = [min(m[4 * i + j] + c[j] for j in range(4)) for i in range(4)]
        return pa.table([t["conv_id"].slice(0, 1).take(pa.array([0] * len(found))), pa.array([b for b, _ in found], pa.int32()), pa.array([c for _, c in found], pa.list_(pa.int64()))], schema=to_arrow_schema(after))

    ends = dealt.where("__kw_matrix is not null").select("conv_id", "__kw_block", "__kw_matrix").groupBy("conv_id").applyInArrow(behind, after)
    ends = settle(ends, "ends").toDF("c", "b", "__kw_after")
    big = dealt.where("__kw_matrix is null").join(ends, _same("conv_id", "c") & (F.col("__kw_block") == F.col("b")))
    # a conversation all of whose rows are dropped still has one row
    gone = rows.join(large, _same("conv_id", "__kw_conv"), "left_semi").groupBy("conv_id").agg(F.min("dropped").alias("dropped")).where("dropped")
    big = big.withColumn("dropped", F.lit(False)).select(*small.columns).unionByName(gone.select("conv_id", "dropped"), allowMissingColumns=True)
    return small, big.repartition("conv_id").sortWithinPartitions("conv_id", "__kw_block", "turn", "role", "text")


def repair(turns: DataFrame, rows_out: bool = False, large_rows: int = LARGE_ROWS, large_bytes: int = LARGE_BYTES) -> DataFrame:
    """One row a conversation of turns(conv_id, turn, role, text[, dropped]): its faults, the cost and edits of its repair and the repaired turns' hash.

    With ``rows_out`` the repaired turns themselves: (conv_id, place, edit, role, text). ``dropped`` rows only say that there is such a conversation.
    """
    blank = lambda c: F.coalesce(F.col(c), F.lit(" ")).alias(c)
    dropped = F.coalesce(F.col("dropped"), F.lit(False)) if "dropped" in turns.columns else F.lit(False)
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), blank("role"), blank("text"), dropped.alias("dropped"))
    small, big = _marked(rows, large_rows, large_bytes)
    done = _repair(small, rows_out)
    return done if big is None else done.unionByName(_repair(big, rows_out))


def repair_report(conversations: DataFrame) -> DataFrame:
    """The damaged rows' repair: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256."""
    return repair(damage(conversations))
