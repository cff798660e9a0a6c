"""Structure repair of conversations: damaged turns are edited back to ``(system? (user assistant)+)?``.

The turns are range-partitioned and sorted by conversation and turn, so a conversation is a run of rows
of one task, or of neighbouring tasks. A task repairs each conversation that lies inside its partition
and is not long, by :mod:`groundwork.llm.alignment`. The first and the last conversation of a partition,
which may go on in the next one, and long ones stay open: a conversation that holds a third of all rows
is open in every task it spans. Open conversations are aligned in blocks of bounded size, each solved for
every state it may begin and end in, and the solved blocks are joined per partition and then per
conversation: numbers and one letter a turn, no texts. Their digests are taken from a sorted stream, since
a digest of one whole conversation is one pass over it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from groundwork.llm.alignment import DONE, START, Follower, Part, joined, whole
from groundwork.llm.registry import query, table
from groundwork.llm.storage import stored

BLANKS = " \t\n\x0b\f\r"
LEGAL = ("su", "ua", "au")
#: Turns and characters of a conversation that one task repairs by itself, and turns of one block of a longer one.
MOST_TURNS, MOST_CHARS, BLOCK = 512, 8_000_000, 512

COUNTS = ["blank", "duplicate", "truncated", "illegal", "cost"]
REPORT = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"
OPEN = "part int, pos bigint, turn bigint, role string, text string"
SOLVED = (
    "part int, block bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, first string, last string, "
    "solved array<struct<before:int,after:int,cost:bigint,audit:string>>"
)


def is_blank(text: str) -> bool:
    return not text.strip(BLANKS)


def is_cut(text: str) -> bool:
    return text.rstrip(BLANKS)[-1:] not in (".", "!", "?")


def illegal_pairs(initials: list[str]) -> int:
    return sum(a + b not in LEGAL for a, b in zip(initials, initials[1:], strict=False))


def repair(turns: list[tuple[int | None, str, str]]) -> dict:
    """The report of one conversation: its (turn, role, text) rows in order."""
    seen, blank, again, cut = set(), [], [], []
    for _, role, text in turns:
        empty = is_blank(text)
        twin = not empty and (role, text) in seen
        seen.add((role, text))
        blank.append(empty)
        again.append(twin)
        cut.append(not empty and not twin and is_cut(text))
    initials = [role[:1] for _, role, _ in turns]
    must_go = [a or b for a, b in zip(blank, again, strict=True)]
    cost, audit = whole(Part([*initials], must_go, cut).solve((START,), (START, DONE)))
    known = [turn for turn, _, _ in turns if turn is not None]
    digest = Digest()
    for line in lines(audit, [(role, text) for _, role, text in turns]):
        digest.add(line)
    return {
        "gaps": max(known) - min(known) + 1 - len(set(known)) if known else 0,
        "blank": sum(blank),
        "duplicate": sum(again),
        "truncated": sum(cut),
        "illegal": illegal_pairs(initials),
        "cost": cost,
        "audit": audit,
        "repaired_sha256": digest.value(),
    }


def lines(audit: str, turns) -> Iterator[str]:
    """``role:text`` of the repaired turns."""
    left, follower = iter(turns), Follower()
    for edit in audit:
        role, text = ("", "") if edit == "I" else next(left)
        new = follower.role(edit, role)
        if new is not None:
            yield f"{new}:{text}"


class Digest:
    """SHA-256 of lines joined by newlines."""

    def __init__(self):
        self.hash, self.begun = hashlib.sha256(), False

    def add(self, line: str) -> None:
        self.hash.update(("\n" * self.begun + line).encode())
        self.begun = True

    def value(self) -> str:
        return self.hash.hexdigest()


def _plain(turns: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    return turns.select(
        F.col(conv).alias("conv_id"),
        F.col(turn).cast("bigint").alias("turn"),
        *(F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(new) for c, new in ((role, "role"), (text, "text"))),
    )


def _in_order(turns: DataFrame) -> DataFrame:
    """Sorted runs: by conversation, turn (nulls first), and, within one turn, role and a hash of the text.

    The row number makes rows that are equal otherwise fall into different ranges where they are many.
    """
    numbered = turns.withColumn("tie", F.xxhash64("text")).withColumn("row", F.monotonically_increasing_id())
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "tie", "row"]
    return numbered.repartitionByRange(*order).sortWithinPartitions(*order)


def _report_type(turns: DataFrame, *more: str) -> T.StructType:
    return T.StructType([turns.schema["conv_id"], *T.StructType.fromDDL(", ".join(more)).fields])


def repair_conversations(
    turns: DataFrame,
    conv: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    most_turns: int = MOST_TURNS,
    most_chars: int = MOST_CHARS,
    block: int = BLOCK,
) -> DataFrame:
    """One row per conversation of ``turns``: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    Rows follow each other by turn, nulls first; of one turn by role and then by a hash of the text. Null roles and
    texts are one space, a null conversation is one of its own. A row's first fault counts: blank (no word
    character), duplicate (role and text seen earlier in the conversation), truncated (its last word character
    is not one of ``.!?``). ``illegal`` counts neighbours whose role initials are not su, ua or au; ``gaps`` is the
    number of whole turns missing between the smallest and largest. ``audit`` holds the cheapest edits (K, R, D,
    I) that leave ``(s?(ua)+)?``, the ASCII-least of them. An empty table gives no rows; other columns are not
    looked at. ``most_turns``, ``most_chars`` and ``block`` only decide which way a conversation takes.
    """
    plain = _plain(turns, conv, turn, role, text)
    schema = _report_type(plain, OPEN, REPORT)
    out = to_arrow_schema(schema)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, pos, current, first = TaskContext.get().partitionId(), 0, None, True
        held, chars, spilled, begun = [], 0, False, False
        rows = {name: [] for name in schema.names}

        def emit(**values) -> None:
            for name, column in rows.items():
                column.append(values.get(name))

        def opened() -> None:
            for at, turn, role, text in held:
                emit(conv_id=current, part=part, pos=at, turn=turn, role=role, text=text)

        def take() -> Iterator[pa.RecordBatch]:
            if rows["conv_id"]:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows.values(), out.types, strict=True)], schema=out)
                for column in rows.values():
                    column.clear()

        for batch in batches:
            columns = (batch.column(name).to_pylist() for name in ("conv_id", "turn", "role", "text"))
            for name, turn, role, text in zip(*columns, strict=True):
                if not begun or name != current:
                    if begun and not first and not spilled:
                        emit(conv_id=current, **repair([row[1:] for row in held]))
                    elif begun:
                        opened()
                        first = False
                    current, held, chars, spilled, begun = name, [], 0, False, True
                held.append((pos, turn, role, text))
                pos, chars = pos + 1, chars + len(text)
                if len(held) > most_turns or chars > most_chars:
                    opened()
                    held, chars, spilled = [], 0, True
                    yield from take()
            yield from take()
        opened()
        yield from take()

    found = stored(_in_order(plain).select("conv_id", "turn", "role", "text").mapInArrow(work, schema), "repairs")
    closed = found.where("part IS NULL").select("conv_id", *_names(REPORT))
    return closed.unionByName(_open_reports(found.where("part IS NOT NULL").select("conv_id", *_names(OPEN)), block))


def _names(ddl: str) -> list[str]:
    return T.StructType.fromDDL(ddl).names


def _open_reports(rows: DataFrame, block: int) -> DataFrame:
    blank = F.btrim("text", F.lit(BLANKS)) == ""
    known = F.when(F.col("conv_id").isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), F.col("conv_id").cast("string")))
    print_ = F.sha2(F.concat_ws(":", F.length(known), known, F.length("role"), "role", "text").cast("binary"), 256)
    facts = rows.select(
        "conv_id",
        "part",
        "pos",
        F.substring("role", 1, 1).alias("initial"),
        blank.alias("blank"),
        (~F.btrim("text", F.lit(BLANKS)).rlike(r"[.!?]\z")).alias("cut"),
        print_.alias("print"),
    )
    place = F.struct("part", "pos")
    # Only what stands twice or more, combined in each task first; written, so that a hot key can be split below.
    first = stored(facts.where("NOT blank").groupBy("print").agg(F.min(place).alias("first"), F.count("*").alias("times")).where("times > 1"), "twins")
    again = F.col("first").isNotNull() & (F.col("first") != place)
    marked = facts.join(first.select("print", "first"), "print", "left").select(
        "conv_id", "part", F.floor(F.col("pos") / block).alias("block"), "pos", "initial", "blank", (again & ~F.col("blank")).alias("again"), "cut"
    )
    schema = _report_type(rows, SOLVED)
    out = to_arrow_schema(schema)

    def solve(group: pa.Table) -> pa.Table:
        group = group.sort_by("pos")
        blank, again, cut = (group.column(c).to_pylist() for c in ("blank", "again", "cut"))
        must_go = [a or b for a, b in zip(blank, again, strict=True)]
        cut = [c and not g for c, g in zip(cut, must_go, strict=True)]
        initials = group.column("initial").to_pylist()
        values = {"blank": sum(blank), "duplicate": sum(again), "truncated": sum(cut), "illegal": illegal_pairs(initials)}
        values |= {"first": initials[0], "last": initials[-1], "solved": _as_rows(Part([*initials], must_go, cut).solve())}
        return _one(values | {c: group.column(c)[0].as_py() for c in ("conv_id", "part", "block")}, out)

    def join(group: pa.Table) -> pa.Table:
        parts = group.sort_by([("part", "ascending"), ("block", "ascending")]).to_pylist()
        values = {c: sum(p[c] for p in parts) for c in ("blank", "duplicate", "truncated", "illegal")}
        values["illegal"] += sum(illegal_pairs([a["last"], b["first"]]) for a, b in zip(parts, parts[1:], strict=False))
        solved = joined([{(s["before"], s["after"]): (s["cost"], s["audit"]) for s in p["solved"]} for p in parts])
        values |= {"first": parts[0]["first"], "last": parts[-1]["last"], "solved": _as_rows(solved)}
        return _one(values | {c: parts[0][c] for c in ("conv_id", "part", "block")}, out)

    solved = marked.groupBy("conv_id", "part", "block").applyInArrow(solve, schema)
    solved = solved.groupBy("conv_id", "part").applyInArrow(join, schema).groupBy("conv_id").applyInArrow(join, schema)
    ends = F.filter("solved", lambda s: (s.before == START) & s.after.isin(START, DONE))
    best = F.array_min(F.transform(ends, lambda s: F.struct(s.cost.alias("cost"), s.audit.alias("audit"))))
    aligned = stored(solved.withColumn("best", best).select("conv_id", *COUNTS[:4], "best.cost", "best.audit"), "aligned")
    gaps = rows.groupBy("conv_id").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("bigint").alias("gaps")
    )
    digests = _followed(rows, aligned, "repaired_sha256 string", _digests)
    every = aligned.unionByName(gaps, allowMissingColumns=True).unionByName(digests, allowMissingColumns=True)
    names = _names(REPORT)
    return every.groupBy("conv_id").agg(*(F.max(c).alias(c) for c in names)).select("conv_id", *names)


def _as_rows(solved) -> list[dict]:
    return [{"before": a, "after": b, "cost": cost, "audit": audit} for (a, b), (cost, audit) in solved.items()]


def _one(values: dict, out: pa.Schema) -> pa.Table:
    return pa.Table.from_arrays([pa.array([values[name]], kind) for name, kind in zip(out.names, out.types, strict=True)], schema=out)


def _followed(rows: DataFrame, audits: DataFrame, ddl: str, work) -> DataFrame:
    """Run ``work`` over streams in which each conversation's audit comes before its rows in order."""
    head = audits.select("conv_id", F.lit(-1).alias("part"), F.lit(-1).cast("bigint").alias("pos"), F.lit(None).cast("string").alias("role"), F.col("audit").alias("text"))
    stream = head.unionByName(rows.select("conv_id", "part", "pos", "role", "text"))
    schema = _report_type(rows, ddl)
    return stream.repartition("conv_id").sortWithinPartitions("conv_id", "part", "pos").mapInArrow(work(to_arrow_schema(schema)), schema)


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, str, Iterator[tuple[str, str]]]]:
    """(conversation, audit, its (role, text) rows as they come)."""

    def rows():
        for batch in batches:
            yield from zip(*(batch.column(c).to_pylist() for c in ("conv_id", "pos", "role", "text")), strict=True)

    stream = rows()
    ahead = next(stream, None)
    while ahead is not None:
        name, _, _, audit = ahead
        ahead = next(stream, None)

        def turns():
            nonlocal ahead
            while ahead is not None and ahead[1] >= 0:
                _, _, role, text = ahead
                ahead = next(stream, None)
                yield role, text

        mine = turns()
        yield name, audit, mine
        for _ in mine:  # what was not asked for
            pass


def _digests(out: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, audit, turns in _conversations(batches):
            digest = Digest()
            for line in lines(audit, turns):
                digest.add(line)
            yield pa.RecordBatch.from_arrays([pa.array([name], out.types[0]), pa.array([digest.value()])], schema=out)

    return run


def repaired_turns(
    turns: DataFrame, report: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """The repaired conversations of a report: conv_id, place (from 0), edit (K, R or I), role, text.

    ``report`` is :func:`repair_conversations` of the same ``turns``; rows come in a stream per conversation.
    """
    ordered = _in_order(_plain(turns, conv, turn, role, text))
    rows = ordered.select("conv_id", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("pos"), "role", "text")

    def work(out: pa.Schema):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for name, audit, left in _conversations(batches):
                follower, place, held = Follower(), 0, []
                for edit in audit:
                    old, words = ("", "") if edit == "I" else next(left)
                    new = follower.role(edit, old)
                    if new is not None:
                        held.append((name, place, edit, new, words))
                        place += 1
                    if len(held) >= 1000:
                        yield _table(held, out)
                        held = []
                if held:
                    yield _table(held, out)

        return run

    return _followed(rows, report, "place bigint, edit string, role string, text string", work)


def _table(rows: list[tuple], out: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), out.types, strict=True)], schema=out)


def damaged(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``turns`` as conv_id, turn, role, text and ``times`` (0, 1 or 2 rows of it are left), broken by rule.

    crc32 of "conv_id:turn" modulo 20 decides: 0 drops the row, 1 empties its text, 2 takes ``.!?`` out, 3
    repeats it, 4 makes its role user. Nulls are one space there and in role and text.
    """

    def known(name: str):
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat(known(conv), F.lit(":"), known(turn)).cast("binary")) % 20
    return turns.select(
        F.col(conv).alias("conv_id"),
        F.col(turn).cast("bigint").alias("turn"),
        F.when(kind == 4, F.lit("user")).otherwise(known(role)).alias("role"),
        F.when(kind == 1, F.lit("")).when(kind == 2, F.regexp_replace(known(text), "[.!?]", "")).otherwise(known(text)).alias("text"),
        F.when(kind == 0, F.lit(0)).when(kind == 3, F.lit(2)).otherwise(F.lit(1)).alias("times"),
    )


@query("op11_conversation_repair")
def op11(spark: SparkSession, directory: str) -> DataFrame:
    broken = damaged(table(spark, directory, "conversations"))
    left = broken.where("times > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times"))))
    report = repair_conversations(left)
    # Conversations of which nothing is left.
    gone = broken.groupBy("conv_id").agg(F.max("times").alias("most")).where("most = 0")
    empty = [F.lit(0).cast("bigint").alias(c) for c in ("gaps", *COUNTS)]
    none = gone.select("conv_id", *empty, F.lit("").alias("audit"), F.lit(Digest().value()).alias("repaired_sha256"))
    return report.unionByName(none)
