"""Repair of a conversation's structure: depth-first branch-and-bound.

The roles of a repaired conversation read ``(s?(ua)+)?``.  A search node is (row, state), where
the state is what the output ends with so far.  An explicit stack holds the open prefixes; a
prefix goes if its cost and a lower bound of the rest (by a coarser automaton, in which a system
turn may stand wherever a user turn may) are beyond the incumbent (cost, audit), or if its node was
reached by a prefix of no greater (cost, audit).  All prefixes of a node end with the same row, so none
begins another of equal cost, and the lesser one stays the lesser whatever follows.  The most
promising edges are tried first; the search ends when no open prefix can beat the incumbent.

A conversation may have any number of rows.  It is cut into blocks of ``BLOCK`` rows; a block is solved
for every state that it can begin and end with, and up to ``FAN`` neighbouring solutions are the rows of a search
one level up, until one is left.  Costs add up and audits are joined, so the result is that of one
search.  The audit is then cut into its blocks' parts on the way down again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tributary.llm.common import staged
from tributary.llm.turns import numbered, turn_key

#: Rows of a block, as a power of two, and blocks that one search joins.
SHIFT = 6
BLOCK = 1 << SHIFT
FAN = 64

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1

#: What the output may go on with: at the start, after the system, a user and an assistant turn.
NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
ENDS = (0, 3)

#: A row's letter: its role's initial (x: another), and whether it is sound, has to go, or is truncated.
ROLES, FAULTS = "suax", "sdt"
LETTERS = "ABCDEFGHIJKL"

Edges = tuple[tuple[tuple[str, int, int], ...], ...]  # by state: (initials, cost, next state), ASCII order


def _least(found: list[tuple[str, int, int]]) -> tuple[tuple[str, int, int], ...]:
    """Of edges between the same two states the cheapest, and of those the ASCII-least."""
    best: dict[int, tuple[int, str]] = {}
    for name, cost, to in found:
        best[to] = min(best.get(to, (cost, name)), (cost, name))
    return tuple(sorted((name, cost, to) for to, (cost, name) in best.items()))


def _row_edges(role: str, fault: str) -> Edges:
    out = []
    for state in range(len(NEXT)):
        found, before = [], [("", 0, state)]
        for _ in range(2):  # two turns inserted bring the state back to where it was
            before += [(name + "I", cost + INSERT, NEXT[at][r]) for name, cost, at in before[-1:] for r in "ua" if r in NEXT[at]]
        for name, cost, at in before:
            found.append((name + "D", cost + DELETE, at))
            if fault != "d":
                held = cost + (TRUNCATED if fault == "t" else 0)
                if role in NEXT[at]:
                    found.append((name + "K", held + KEEP, NEXT[at][role]))
                found += [(name + "R", held + REROLE, NEXT[at][r]) for r in "ua" if r in NEXT[at] and r != role]
        out.append(_least(found))
    return tuple(out)


EDGES = {LETTERS[len(FAULTS) * i + j]: _row_edges(r, f) for i, r in enumerate(ROLES) for j, f in enumerate(FAULTS)}

#: After the last row, what is missing is inserted.
CLOSING: Edges = ((("", 0, 0),), (("II", 2 * INSERT, 3),), (("I", INSERT, 3),), (("", 0, 3),))

#: States that bounds do not tell apart: those that a user turn may follow, and that after a user turn.
ALIKE = (0, 0, 1, 0)


def search(layers: list[Edges], entry: int, ends: tuple[int, ...]) -> tuple[int, str] | None:
    """The least (cost, audit) from ``entry`` through all layers to one of ``ends``; None if there is no way."""
    n, none = len(layers), 1 << 60
    bound = [[none, none] for _ in range(n)] + [[0 if any(ALIKE[q] == g for q in ends) else none for g in (0, 1)]]
    for i in range(n - 1, -1, -1):
        for q, edges in enumerate(layers[i]):
            bound[i][ALIKE[q]] = min([bound[i][ALIKE[q]], *(cost + bound[i + 1][ALIKE[to]] for _, cost, to in edges)])
    incumbent: tuple[int, str] | None = None
    reached: dict[tuple[int, int], tuple[int, str]] = {}
    stack = [(bound[0][ALIKE[entry]], "", 0, entry, 0)]
    while stack:
        least, audit, i, q, cost = stack.pop()
        if least >= none or incumbent is not None and (least, audit) > (incumbent[0], incumbent[1][: len(audit)]):
            continue
        if (i, q) in reached and (cost, audit) >= reached[i, q]:
            continue
        reached[i, q] = (cost, audit)
        if i < n:
            ways = sorted((cost + more + bound[i + 1][ALIKE[to]], audit + name, i + 1, to, cost + more) for name, more, to in layers[i][q])
            stack += reversed(ways)
        elif q in ends and (incumbent is None or (cost, audit) < incumbent):
            incumbent = (cost, audit)
    return incumbent


@lru_cache(maxsize=1 << 16)
def solved(letters: str) -> tuple[int, str]:
    """The least (cost, audit) of a whole conversation."""
    return search([*(EDGES[c] for c in letters), CLOSING], 0, ENDS)  # deleting all rows is always a way


@lru_cache(maxsize=1 << 12)
def _ways(letters: str) -> list[tuple[int, int, int, str]]:
    return _all_ways([EDGES[c] for c in letters])


def _all_ways(layers: list[Edges]) -> list[tuple[int, int, int, str]]:
    states = range(len(NEXT))
    found = ((entry, end, search(layers, entry, (end,))) for entry in states for end in states)
    return [(entry, end, *best) for entry, end, best in found if best]


def _legal(a: str, b: str) -> bool:
    return a + b in ("su", "ua", "au")


def _role(letter: str) -> str:
    return ROLES[LETTERS.index(letter) // len(FAULTS)]


_UNIT = "conv string, place long, total long, first string, last string, illegal long, ways array<struct<entry:int,end:int,cost:long,audit:string>>, cost long, audit string"
_UNIT_ARROW = pa.schema([
    ("conv", pa.string()), ("place", pa.int64()), ("total", pa.int64()), ("first", pa.string()), ("last", pa.string()), ("illegal", pa.int64()),
    ("ways", pa.list_(pa.struct([("entry", pa.int32()), ("end", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))),
    ("cost", pa.int64()), ("audit", pa.string()),
])


def _unit(conv: str, place: int, total: int, roles: tuple[str, str], illegal: int, ways: list, whole: tuple[int, str] | None) -> dict:
    named = [dict(zip(("entry", "end", "cost", "audit"), w, strict=True)) for w in ways]
    cost, audit = whole or (None, None)
    return {"conv": conv, "place": place, "total": total, "first": roles[0], "last": roles[1], "illegal": illegal, "ways": named, "cost": cost, "audit": audit}


def _solve_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            roles = [_role(c) for c in r["letters"]]
            illegal = sum(not _legal(a, b) for a, b in zip(roles, roles[1:], strict=False))
            alone = r["total"] == 1
            out.append(_unit(r["conv"], r["place"], r["total"], (roles[0], roles[-1]), illegal, [] if alone else _ways(r["letters"]), solved(r["letters"]) if alone else None))
        yield pa.RecordBatch.from_pylist(out, schema=_UNIT_ARROW)


def _solve_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in batch.to_pylist():
            units = r["units"]
            layers: list[Edges] = []
            for u in units:
                edges = [[] for _ in NEXT]
                for w in u["ways"]:
                    edges[w["entry"]].append((w["audit"], w["cost"], w["end"]))
                layers.append(tuple(tuple(sorted(e)) for e in edges))
            illegal = sum(u["illegal"] for u in units) + sum(not _legal(a["last"], b["first"]) for a, b in zip(units, units[1:], strict=False))
            alone = r["total"] == 1
            whole = search([*layers, CLOSING], 0, ENDS) if alone else None
            made = _unit(r["conv"], r["place"], r["total"], (units[0]["first"], units[-1]["last"]), illegal, [] if alone else _all_ways(layers), whole)
            yield pa.RecordBatch.from_pylist([made], schema=_UNIT_ARROW)


_PART = "conv string, place long, audit string, before long, odd boolean"


def _cut_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """An audit's parts of ``sizes`` rows each, with the number of turns put out before each part."""
    for batch in batches:
        for r in batch.to_pylist():
            marks = np.frombuffer(r["audit"].encode(), np.uint8)
            taken, put = np.cumsum(marks != ord("I")), np.concatenate([[0], np.cumsum(marks != ord("D"))])
            sizes = [s["rows"] for s in sorted(r["sizes"], key=lambda s: s["place"])]
            ends = np.searchsorted(taken, np.cumsum(sizes), "left") + 1
            ends[-1] = len(marks)
            starts = [0, *ends[:-1].tolist()]
            yield pa.RecordBatch.from_pydict({
                "conv": [r["conv"]] * len(sizes), "place": [r["place"] * FAN + i for i in range(len(sizes))],
                "audit": [r["audit"][a:b] for a, b in zip(starts, ends.tolist(), strict=True)],
                "before": [r["before"] + int(put[a]) for a in starts], "odd": [r["odd"]] * len(sizes),
            }, schema=pa.schema([("conv", pa.string()), ("place", pa.int64()), ("audit", pa.string()), ("before", pa.int64()), ("odd", pa.bool_())]))


_EDIT = "array<struct<pre:array<string>,edit:string,role:string,post:array<string>>>"
_EDIT_ARROW = pa.list_(pa.struct([("pre", pa.list_(pa.string())), ("edit", pa.string()), ("role", pa.string()), ("post", pa.list_(pa.string()))]))


def _row_edits(audit: str, before: int, odd: bool) -> list[dict]:
    """What happens to each row of a part: the roles inserted before and after it, its edit and its role in the output.

    An output of odd length begins with the system turn; all its other roles follow from their places.
    """
    rows: list[dict] = []
    pre: list[str] = []
    at = before - odd
    for mark in audit:
        role = "user" if at % 2 == 0 else "assistant"
        at += mark != "D"
        if mark == "I":
            pre.append(role)
        else:
            rows.append({"pre": pre, "edit": mark, "role": role if mark == "R" else None, "post": []})
            pre = []
    if pre:
        rows[-1]["post"] = pre
    return rows


def _edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made = [_row_edits(*r) for r in zip(batch.column("audit").to_pylist(), batch.column("before").to_pylist(), batch.column("odd").to_pylist(), strict=True)]
        yield pa.record_batch([batch.column("conv"), batch.column("block"), batch.column("start"), pa.array(made, _EDIT_ARROW)], ["conv", "block", "start", "edits"])


def _sha(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    name, digest = None, None
    out = lambda: pa.record_batch([[name], [digest.hexdigest()]], schema=pa.schema([("conv", pa.string()), ("sha256", pa.string())]))
    for batch in batches:
        for conv, text in zip(batch.column("conv").to_pylist(), batch.column("text").to_pylist(), strict=True):
            if conv != name:
                if name is not None:
                    yield out()
                name, digest = conv, hashlib.sha256(text.encode())
            else:
                digest.update(b"\n" + text.encode())
    if name is not None:
        yield out()


@dataclass
class Repairs:
    """``summary``: a row per conversation.  ``rows``: each input row with its ``edit`` and what is inserted around it."""

    summary: DataFrame
    rows: DataFrame

    def turns(self) -> DataFrame:
        """The repaired conversations: ``conv_id, at, sub, role, text``, in the order of ``at, sub``."""
        made = lambda roles: F.transform(roles, lambda r: F.struct(r.alias("role"), F.lit("").alias("text")))
        own = F.when(F.col("edit") != "D", F.array(F.struct(F.coalesce("new_role", "role").alias("role"), "text"))).otherwise(F.array().cast("array<struct<role:string,text:string>>"))
        return self.rows.select("conv_id", "at", F.posexplode(F.concat(made(F.col("pre")), own, made(F.col("post")))).alias("sub", "turn")).select("conv_id", "at", "sub", "turn.*")

    def sha256(self) -> DataFrame:
        """Per conversation with any output the SHA-256 of its ``role:text``, joined by newlines: ``conv, sha256``.

        A block's lines are joined in its task; one digest reads its blocks' lines as a stream.
        """
        empty = lambda roles: F.transform(roles, lambda r: F.concat(r, F.lit(":")))
        own = F.when(F.col("edit") != "D", F.array(F.concat(F.coalesce("new_role", "role"), F.lit(":"), "text"))).otherwise(F.array().cast("array<string>"))
        lines = self.rows.select("conv", "block", "at", F.concat(empty(F.col("pre")), own, empty(F.col("post"))).alias("lines")).filter(F.size("lines") > 0)
        ordered = F.sort_array(F.collect_list(F.struct("at", "lines")))
        chunks = lines.groupBy("conv", "block").agg(F.array_join(F.flatten(F.transform(ordered, lambda x: x["lines"])), "\n").alias("text"))
        return chunks.repartition("conv").sortWithinPartitions("conv", "block").mapInArrow(_sha, "conv string, sha256 string")


def _ranked(units: DataFrame) -> DataFrame:
    """Blocks of a conversation by number: ``place`` from 0 on, and how many there are."""
    w = Window.partitionBy("conv")
    return units.withColumn("place", (F.row_number().over(w.orderBy("block")) - 1).cast("long")).withColumn("total", F.count("*").over(w))


def _up(total: Column | str) -> Column:
    return F.floor((F.col(total) + (FAN - 1)) / FAN).cast("long")


def repairs(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> Repairs:
    """Find the cheapest edits that give each conversation a legal structure.

    Rows go by turn, nulls first; rows of one turn by role and text.  Each row's first fault counts:
    blank (no character but ASCII white space), duplicate (role and text of an earlier row of the
    conversation), truncated (does not end with ``.``, ``!`` or ``?``).  Keep costs 0, Rerole to user or assistant 2,
    Delete 3, Insert an empty user or assistant turn 2; a truncated row that stays adds 1, blank rows and
    duplicates have to go.  Of equal costs the ASCII-least string of initials is taken.

    The summary has ``conv_id, gaps`` (turn numbers missing between the least and the greatest),
    ``blank, duplicate, truncated, illegal`` (neighbouring initials other than su, ua, au), ``cost, audit``, and
    ``conv``, the key as text.  Rows without an id are one conversation; a null role or text is one space;
    equal rows are duplicates; texts and conversations may be of any length; other columns are ignored; an
    empty table gives no rows.
    """
    space = F.lit(" ")
    named = rows.select(
        F.coalesce(F.col(f"`{conv_id}`").cast("string"), space).alias("conv"), F.col(f"`{turn}`").cast("long").alias("turn"),
        F.coalesce(F.col(f"`{role}`").cast("string"), space).alias("role"), F.coalesce(F.col(f"`{text}`").cast("string"), space).alias("text"),
    )
    kept = ["conv", "turn", "role", "text", turn_key(F.col("role"), F.col("text")).alias("key")]
    given = numbered(named, ["conv", "turn", "role", "text"], kept, "repair-rows").frame.withColumn("block", F.shiftright("at", SHIFT))
    firsts = given.groupBy("conv", "key").agg(F.min("at").alias("at")).select("at", F.lit(True).alias("new"))
    initial = F.substring("role", 1, 1)
    ink = F.rtrim(F.col("text"), F.lit(" \t\n\x0b\x0c\r"))
    blank, cut = ink == "", ~F.substring(ink, -1, 1).isin(".", "!", "?")
    thin = given.select("conv", "at", "block", "turn", F.when(initial.isin("s", "u", "a"), initial).otherwise("x").alias("initial"), blank.alias("blank"), cut.alias("cut"))
    fault = F.when(F.col("blank"), "blank").when(F.col("new").isNull(), "duplicate").when(F.col("cut"), "truncated").otherwise("none")
    number = 1 + len(FAULTS) * (F.instr(F.lit(ROLES), F.col("initial")) - 1) + F.when(F.col("fault") == "none", 0).when(F.col("fault") == "truncated", 2).otherwise(1)
    marked = staged(
        thin.join(firsts, "at", "left").withColumn("fault", fault).withColumn("letter", F.substring(F.lit(LETTERS), number, F.lit(1))).drop("new", "cut", "blank"),
        "repair-faults",
    ).frame

    blocks = marked.groupBy("conv", "block").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "letter"))), lambda x: x["letter"]), "").alias("letters"),
        F.min("at").alias("start"), F.count("*").alias("rows"),
    )
    blocks = staged(_ranked(blocks), "repair-blocks").frame
    solved_units = staged(blocks.select("conv", "place", "total", "letters").mapInArrow(_solve_blocks, _UNIT), "repair-units").frame
    finished = [solved_units.filter("audit is not null").select("conv", "cost", "audit", "illegal")]
    sizes = [blocks.select("conv", "place", "rows", "total")]
    level = solved_units.filter("audit is null")
    while not level.isEmpty():
        grouped = level.groupBy("conv", F.floor(F.col("place") / FAN).alias("place")).agg(
            F.any_value("total").alias("total"), F.sort_array(F.collect_list(F.struct("place", "first", "last", "illegal", "ways"))).alias("units")
        ).withColumn("total", _up("total"))
        made = staged(grouped.mapInArrow(_solve_groups, _UNIT), "repair-units").frame
        finished.append(made.filter("audit is not null").select("conv", "cost", "audit", "illegal"))
        below = sizes[-1].filter("total > 1")
        sizes.append(below.groupBy("conv", F.floor(F.col("place") / FAN).alias("place")).agg(F.sum("rows").alias("rows"), F.any_value("total").alias("total")).withColumn("total", _up("total")))
        level = made.filter("audit is null")

    # On the way down, each level's audits are cut into those of the level below.
    odd = F.length(F.regexp_replace("audit", "D", "")) % 2 == 1
    top = [f.select("conv", F.lit(0).cast("long").alias("place"), "audit", F.lit(0).cast("long").alias("before"), odd.alias("odd")) for f in finished]
    pieces = top[-1]
    for depth in range(len(finished) - 1, 0, -1):
        below = sizes[depth - 1].filter("total > 1").groupBy("conv", F.floor(F.col("place") / FAN).alias("place")).agg(F.collect_list(F.struct("place", "rows")).alias("sizes"))
        pieces = staged(pieces.join(below, ["conv", "place"]).mapInArrow(_cut_parts, _PART), "repair-parts").frame.unionByName(top[depth - 1])
    edits = pieces.join(blocks.select("conv", "place", "block", "start"), ["conv", "place"]).mapInArrow(_edits, f"conv string, block long, start long, edits {_EDIT}")

    result = finished[0]
    for more in finished[1:]:
        result = result.unionByName(more)
    how_many = lambda name: F.count(F.when(F.col("fault") == name, 1)).alias(name)
    counts = marked.groupBy("conv").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("long").alias("gaps"), how_many("blank"), how_many("duplicate"), how_many("truncated")
    )
    number_of = F.when(F.col("conv") != " ", F.col("conv")).cast(rows.schema[conv_id].dataType).alias("conv_id")
    summary = counts.join(result, "conv").select(number_of, "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "conv")
    changed = given.join(edits, ["conv", "block"]).withColumn("e", F.get("edits", (F.col("at") - F.col("start")).cast("int"))).select(
        number_of, "conv", "block", "at", "role", "text", F.col("e.pre").alias("pre"), F.col("e.edit").alias("edit"), F.col("e.role").alias("new_role"), F.col("e.post").alias("post")
    )
    return Repairs(summary, changed)
