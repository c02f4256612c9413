"""Repair of conversation structure by iterative-deepening A*.

The rows of a conversation, by turn, are edited so that the initials of their roles read ``(s?(ua)+)?``:
K keeps a row, R gives it the role that fits (user or assistant, 3), D deletes it (4; blank rows and
repeats must go) and I inserts an empty turn (3); a truncated row that stays costs 3 more. The search goes
depth first through the edits in ASCII order, under a bound on cost plus what the rows ahead cost at least;
the bound rises to the least value that exceeded it. A table holds, for each state (row, place in the
pattern), the cost that was proved too small there, across all bounds: failed states are not searched again.
The first path that is accepted is the cheapest, and the least in ASCII among those.

A conversation may hold any share of all rows. Rows are dealt by ranges of (conversation, turn), so a long one
lies in several tasks, and cut into blocks of ``block`` rows. For a block the search finds the best edits from
each state to each other one, without inserts at its end; as such edits are never prefixes of one another, the best
whole is the chain of blocks of least cost, each the least in ASCII. A task keeps one byte a row for a
conversation (its edits, which are part of the result), never its texts: a second pass in turn order applies them.

Cases: null turns come first; null roles, texts and ids of damaged rows count as one space (a null conversation id stays
null and is one conversation); rows of one turn go by role and then by a digest of the text, so equal rows stand
together; turns that are no numbers count as null; a role is known by its first character, a role with another one is
given a role or deleted; conversations without rows have noughts, no edits and the digest of the empty text; a conversation
of one row and one of many are treated alike; no rows give no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import bounded_batches

#: Places in the pattern: nothing yet, after a system turn, after a user turn, after an assistant turn.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {NOTHING: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
NAMES = {USER: "user", ASSISTANT: "assistant"}
KEEP = {("s", NOTHING): SYSTEM, ("u", NOTHING): USER, ("u", SYSTEM): USER, ("u", ASSISTANT): USER, ("a", USER): ASSISTANT}
DELETE, CHANGE, CUT = 4, 3, 3
#: Closing inserts that lead from a place to the end of the pattern.
CLOSING = {NOTHING: 0, SYSTEM: 2, USER: 1, ASSISTANT: 0}
NEVER = 1 << 60

#: A row as two characters: the initial (``?`` if it is none of s, u, a) and the fault (b, d, t or a dot).
Rows = str


def _least(initial: str, fault: str) -> int:
    if fault in "bd":
        return DELETE
    return min(DELETE, (initial == "?") * CHANGE + (fault == "t") * CUT)


def _deleting(rows: Rows, entry: int, goal: int) -> tuple[int, str] | None:
    """The best edits to a place that only deletions keep: all rows go, or all but one system turn."""
    n = len(rows) // 2
    if entry == goal:
        return DELETE * n, "D" * n
    kept = [(CUT * (rows[2 * i + 1] == "t"), -i) for i in range(n) if rows[2 * i] == "s" and rows[2 * i + 1] in ".t"]
    if goal != SYSTEM or entry != NOTHING or not kept:
        return None
    more, at = min(kept)  # the last of the cheapest: D is less than K
    return DELETE * (n - 1) + more, "D" * -at + "K" + "D" * (n - 1 + at)


@lru_cache(maxsize=50_000)
def search(rows: Rows, entry: int = NOTHING, goal: int | None = None) -> tuple[int, str] | None:
    """Cost and edits of the first accepted path of least cost; None where there is none.

    Without ``goal`` the path must complete the pattern and may insert after the last row; with it, the path must
    end in that place right after the last row.
    """
    n = len(rows) // 2
    ahead = [0] * (n + 1)
    for i in range(n - 1, -1, -1):
        ahead[i] = ahead[i + 1] + _least(rows[2 * i], rows[2 * i + 1])
    if goal in (NOTHING, SYSTEM) or n == 0 and goal is not None:
        return _deleting(rows, entry, goal)
    proved: dict[tuple[int, int], int] = {}

    def moves(i: int, place: int) -> Iterator[tuple[str, int, int, int]]:
        if i < n:
            initial, fault = rows[2 * i], rows[2 * i + 1]
            yield "D", DELETE, i + 1, place
        if i < n or goal is None:
            yield "I", CHANGE, i, NEXT[place]
        if i < n and fault not in "bd":
            more = CUT if fault == "t" else 0
            if (initial, place) in KEEP:
                yield "K", more, i + 1, KEEP[initial, place]
            yield "R", CHANGE + more, i + 1, NEXT[place]

    def descend(i: int, place: int, budget: int) -> str | None:
        if i == n and (place in (NOTHING, ASSISTANT) if goal is None else place == goal):
            return ""
        if proved.get((i, place), ahead[i]) > budget:
            return None
        least = NEVER
        for edit, cost, to, then in moves(i, place):
            if cost <= budget and (rest := descend(to, then, budget - cost)) is not None:
                return edit + rest
            least = min(least, cost + proved.get((to, then), ahead[to]))
        proved[i, place] = max(least, proved.get((i, place), 0))
        return None

    bound = ahead[0]
    while (path := descend(0, entry, bound)) is None:
        bound = proved[0, entry]
    return bound, path


def block_table(rows: Rows) -> list:
    """[entry, exit, cost, edits] of the best edits of a block between all places."""
    return [[a, b, *best] for a in range(4) for b in range(4) if (best := search(rows, a, b)) is not None]


def chain(tables: list[list]) -> tuple[int, str]:
    """Least cost and edits of consecutive blocks, with the inserts that close the pattern."""
    costs = [{p: CHANGE * k for p, k in CLOSING.items()}]
    for block in reversed(tables):
        onward: dict[int, int] = {}
        for a, b, cost, _ in block:
            if b in costs[-1]:
                onward[a] = min(onward.get(a, NEVER), cost + costs[-1][b])
        costs.append(onward)
    costs.reverse()
    place, edits = NOTHING, []
    for block, here, there in zip(tables, costs, costs[1:], strict=False):
        edit, place = min((path, b) for a, b, cost, path in block if a == place and b in there and cost + there[b] == here[a])
        edits.append(edit)
    return costs[0][NOTHING], "".join(edits) + "I" * CLOSING[place]


def apply_edits(edits: Iterator[str], rows: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str, str]]:
    """(edit, role, text) of the turns that stay or are inserted, row by row."""
    place = NOTHING
    for edit in edits:
        if edit == "I":
            place = NEXT[place]
            yield edit, NAMES[place], ""
            continue
        role, text = next(rows)
        if edit == "K":
            place = KEEP[role[0], place]
            yield edit, role, text
        elif edit == "R":
            place = NEXT[place]
            yield edit, NAMES[place], text


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows with a tenth of the known damages, decided by crc32 of ``conv_id:turn``; nulls are one space."""
    spaced = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")]
    kind = F.crc32(F.concat(spaced[0], F.lit(":"), spaced[1]).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", spaced[2].alias("role"), spaced[3].alias("text"), kind.alias("_kind")).filter("_kind <> 0")
    text = F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("_kind") == 4, "user").otherwise(F.col("role"))
    times = F.explode(F.when(F.col("_kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), times.alias("_time")).drop("_time")


def _normal(rows: DataFrame) -> DataFrame:
    role, text = F.coalesce(F.col("role").cast("string"), F.lit(" ")), F.coalesce(F.col("text").cast("string"), F.lit(" "))
    digest = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)
    return rows.select("conv_id", F.col("turn").try_cast("long").alias("turn"), role.alias("role"), text.alias("text"), digest.alias("digest"))


def _groups(batches: Iterator, key: int = 0) -> Iterator[tuple]:
    """Rows of sorted Arrow batches as tuples, with a flag on the first of each conversation."""
    last: object = batches
    for batch in batches:
        for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            yield (last is batches or row[key] != last, row)
            last = row[key]


def _segments(rows: DataFrame, block: int) -> DataFrame:
    """One row for each conversation and task that has rows of it: counts and the tables of its blocks."""
    own = Window.partitionBy("conv_id", "digest").orderBy(F.col("turn").asc_nulls_first())
    word = F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    initial = F.when(F.left("role", F.lit(1)).isin("s", "u", "a"), F.left("role", F.lit(1))).otherwise("?")
    marked = rows.select("conv_id", "turn", "role", "digest", word.alias("_last"), initial.alias("_initial")).withColumn("_again", F.row_number().over(own) > 1)
    fault = F.when(F.col("_last") == "", "b").when(F.col("_again"), "d").when(~F.col("_last").isin(".", "!", "?"), "t").otherwise(".")
    coded = marked.select("conv_id", "turn", "role", "digest", "_again", F.concat("_initial", fault).alias("code"))
    dealt = coded.repartitionByRange("conv_id", F.col("turn").asc_nulls_first(), "role", "digest").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "digest", "_again").select("conv_id", "turn", "code")
    id_type = to_arrow_type(rows.schema["conv_id"].dataType)

    def solve(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        task, schema = TaskContext.get().partitionId(), pa.schema([("conv_id", id_type), ("segment", pa.int64()), ("solved", pa.string())])
        out: list[tuple] = []
        held: list | None = None

        def close(edge: bool) -> None:
            conv, codes, first, last, distinct = held
            codes = "".join(codes)
            n = len(codes) // 2
            pairs = {"su", "ua", "au"}
            facts = {"n": n, "blank": codes[1::2].count("b"), "duplicate": codes[1::2].count("d"), "truncated": codes[1::2].count("t"), "first": first, "last": last, "distinct": distinct, "head": codes[0], "tail": codes[-2]}
            facts["illegal"] = sum(a + b not in pairs for a, b in zip(codes[0::2], codes[2::2], strict=False))
            if n <= block and not edge:
                facts["cost"], facts["edits"] = search(codes)
            else:
                facts["blocks"] = [block_table(codes[2 * i : 2 * (i + block)]) for i in range(0, n, block)]
            out.append((conv, task, json.dumps(facts)))

        one = True
        for new, (conv, turn, code) in _groups(batches):
            if new:
                if held is not None:
                    close(one)
                    one = False
                    if len(out) >= 1000:
                        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(schema)], schema=schema)
                        out.clear()
                held = [conv, [], turn, None, 0]
            held[1].append(code)
            if turn is not None:
                held[2] = turn if held[2] is None else held[2]
                held[4] += turn != held[3]
                held[3] = turn
        if held is not None:
            close(True)  # the first and the last conversation of a task may go on in others
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(schema)], schema=schema)

    return dealt.mapInArrow(solve, f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, segment long, solved string")


def _whole(segments: list[dict]) -> dict:
    """Counts, cost and edits of a conversation from its segments."""
    facts = {k: sum(s[k] for s in segments) for k in ("blank", "duplicate", "truncated", "illegal", "distinct")}
    timed = [s for s in segments if s["last"] is not None]
    for a, b in zip(segments, segments[1:], strict=False):
        facts["illegal"] += a["tail"] + b["head"] not in ("su", "ua", "au")
    for a, b in zip(timed, timed[1:], strict=False):
        facts["distinct"] -= a["last"] == b["first"]
    facts["gaps"] = timed[-1]["last"] - timed[0]["first"] + 1 - facts["distinct"] if timed else 0
    if len(segments) == 1 and "edits" in segments[0]:
        return facts | {"cost": segments[0]["cost"], "edits": segments[0]["edits"]}
    facts["cost"], facts["edits"] = chain([b for s in segments for b in s["blocks"]])
    return facts


_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def _in_turn_order(rows: DataFrame, ids: DataFrame | None, block: int) -> DataFrame:
    """For each conversation its id, its segments and then its rows, in the order of turns, in one task."""
    parts = _segments(rows, block).select("conv_id", F.lit(1).alias("kind"), F.col("segment").alias("at"), F.lit(None).cast("string").alias("role"), F.col("solved").alias("text"), F.lit("").alias("digest"))
    turns = rows.select("conv_id", F.lit(2).alias("kind"), F.col("turn").alias("at"), "role", "text", "digest")
    every = parts.unionByName(turns)
    if ids is not None:
        named = ids.select(F.col("conv_id").cast(rows.schema["conv_id"].dataType)).distinct()
        every = every.unionByName(named.select("conv_id", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("at"), F.lit(None).cast("string").alias("role"), F.lit("").alias("text"), F.lit("").alias("digest")))
    return every.repartition("conv_id").sortWithinPartitions("conv_id", "kind", F.col("at").asc_nulls_first(), "role", "digest").select("conv_id", "kind", "role", "text")


def _conversations(batches: Iterator) -> Iterator[tuple[object, dict, Iterator[tuple[str, str, str]]]]:
    """(id, facts, repaired turns) of each conversation; the turns must be read before the next one."""
    stream = _groups(batches)
    waiting = next(stream, None)
    while waiting is not None:
        conv, segments = waiting[1][0], []
        row, new = waiting[1], False
        while not new and row is not None and row[1] < 2:
            if row[1] == 1:
                segments.append(json.loads(row[3]))
            new, row = next(stream, (True, None))

        def texts(row: tuple | None = row, new: bool = new) -> Iterator[tuple[str, str]]:
            nonlocal waiting
            while row is not None and not new:
                yield row[2], row[3]
                new, row = next(stream, (True, None))
            waiting = None if row is None else (True, row)

        facts = _whole(segments) if segments else {k: 0 for k in _COUNTS} | {"edits": ""}
        rows = texts()
        yield conv, facts, apply_edits(iter(facts["edits"]), rows)
        for _ in rows:  # rows that the edits did not ask for (deleted last)
            pass


def repaired_turns(rows: DataFrame, block: int = 64) -> DataFrame:
    """The repaired conversations: (conv_id, place, edit, role, text), places from 0; edit tells kept, reroled and inserted turns."""
    bounded_batches(rows.sparkSession)
    normal = _normal(rows)
    id_type = to_arrow_type(normal.schema["conv_id"].dataType)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        schema = pa.schema([("conv_id", id_type), ("place", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])
        out: list[tuple] = []
        for conv, _, turns in _conversations(batches):
            for place, turn in enumerate(turns):
                out.append((conv, place, *turn))
                if len(out) >= 1000:
                    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(schema)], schema=schema)
                    out.clear()
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(schema)], schema=schema)

    return _in_turn_order(normal, None, block).mapInArrow(run, f"conv_id {normal.schema['conv_id'].dataType.simpleString()}, place long, edit string, role string, text string")


def repair(rows: DataFrame, ids: DataFrame | None = None, block: int = 64) -> DataFrame:
    """One row per conversation of ``rows`` and ``ids``: its faults, the cost and edits of its repair and the digest of the repaired turns."""
    bounded_batches(rows.sparkSession)
    normal = _normal(rows)
    id_type = to_arrow_type(normal.schema["conv_id"].dataType)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        schema = pa.schema([("conv_id", id_type), *[(c, pa.int64()) for c in _COUNTS], ("audit", pa.string()), ("repaired_sha256", pa.string())])
        out: list[tuple] = []
        for conv, facts, turns in _conversations(batches):
            digest = hashlib.sha256()
            for i, (_, role, text) in enumerate(turns):
                digest.update(("\n" * (i > 0) + f"{role}:{text}").encode())
            out.append((conv, *[facts[c] for c in _COUNTS], facts["edits"], digest.hexdigest()))
            if len(out) >= 1000:
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(schema)], schema=schema)
                out.clear()
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(schema)], schema=schema)

    return _in_turn_order(normal, ids, block).mapInArrow(run, f"conv_id {normal.schema['conv_id'].dataType.simpleString()}, {', '.join(f'{c} long' for c in _COUNTS)}, audit string, repaired_sha256 string")
