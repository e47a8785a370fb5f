"""Conversation structure repair: the cheapest edits after which roles follow each other as they must.

A conversation is signed by what its rows are: a letter for each row's role and
fault.  Equal signatures have one answer, and signatures in sorted order walk a
prefix trie: the dynamic programme's layers stand on a stack along the path,
what a prefix shares is computed once, and an answer is read off wherever a
signature ends.

A conversation's rows are streamed in their order, so one of any length takes
no more memory than its signature and its edits, a byte a row each.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, discard, small_batches

#: What edits cost: to keep a row is free.
DELETE, REROLE, INSERT, LEFT_TRUNCATED = 2, 1, 5, 5
NAMES = {"u": "user", "a": "assistant"}
#: Where the letters of ``(s?(ua)+)?`` lead: 0 nothing yet, 1 after s, 2 after u, 3 after a.
NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
ENDS = (0, 3)
NEVER = 1 << 40
#: A row's letter: must go, truncated by role, in order by role.
GONE, OTHER, OTHER_TRUNCATED = "x", "?", "!"


def faults(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row for each of ``turns``: conv_id, turn, role, text, tie, fault (blank, duplicate, truncated or null), the first that holds.

    Rows follow by turn (nulls first), then role, then tie, the MD5 of the
    text.  Null roles and texts read as one space.  duplicate: the conversation
    has role and text before; which of equal rows of one turn is the first
    cannot be told apart.  Other columns are not read.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = turns.select(F.col(conv).alias("conv_id"), F.col(turn).cast("bigint").alias("turn"), space(role).alias("role"), space(text).alias("text"))
    again = F.row_number().over(Window.partitionBy("conv_id", "role", "text").orderBy(F.col("turn").asc_nulls_first())) > 1
    fault = F.when(~F.col("text").rlike(r"[^\x20\x09-\x0D]"), "blank").when(again, "duplicate").when(~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z"), "truncated")
    return rows.select("*", F.md5("text").alias("tie"), fault.alias("fault"))


def letter(role: Column, fault: Column) -> Column:
    """A row's letter in the signature."""
    own = F.when(role.rlike("^[sua]"), F.substring(role, 1, 1)).otherwise(OTHER)
    return F.when(fault.isin("blank", "duplicate"), GONE).when(fault.isNull(), own).otherwise(F.when(own == OTHER, OTHER_TRUNCATED).otherwise(F.upper(own)))


def _signed(kind: pa.DataType):
    schema = pa.schema([("conv_id", kind), *[(c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal")], ("signature", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Signature and counts of each conversation, from rows in order."""
        own: list | None = None
        for batch in batches:
            done = []
            for conv, turn, first, fault, sign in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if own is None or own[0] != conv:
                    if own:
                        done.append(own)
                    own = [conv, None, None, 0, {"blank": 0, "duplicate": 0, "truncated": 0}, 0, None, bytearray()]
                if turn is not None and turn != own[2]:
                    own[1], own[2], own[3] = turn if own[1] is None else own[1], turn, own[3] + 1
                if fault:
                    own[4][fault] += 1
                own[5] += own[6] is not None and own[6] + first not in ("su", "ua", "au")
                own[6] = first
                own[7] += sign.encode()
            yield _table(done, schema)
        yield _table([own] if own else [], schema)

    return run


def _table(done: list, schema: pa.Schema) -> pa.RecordBatch:
    rows = [(conv, 0 if lo is None else hi - lo + 1 - n, *counts.values(), illegal, signature.decode()) for conv, lo, hi, n, counts, illegal, _, signature in done]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def _inserted(costs: list[int]) -> list[int]:
    costs[2] = min(costs[2], min(costs[0], costs[1], costs[3]) + INSERT)
    costs[3] = min(costs[3], costs[2] + INSERT)
    return costs


def _steps(state: int, sign: str) -> Iterator[tuple[str, int, int]]:
    """Edits of a row: initial, next state, cost."""
    yield "D", state, DELETE
    if sign == GONE:
        return
    late = LEFT_TRUNCATED if sign == OTHER_TRUNCATED or sign.isupper() else 0
    if (to := NEXT[state].get(sign.lower())) is not None:
        yield "K", to, late
    for role in NAMES:
        if (to := NEXT[state].get(role)) is not None:
            yield "R", to, REROLE + late


START = tuple(_inserted([0, NEVER, NEVER, NEVER]))


@lru_cache(1 << 14)
def layer_after(layer: tuple[int, ...], sign: str) -> tuple[tuple[int, ...], int, dict[str, tuple[tuple[int, int], ...]]]:
    """The next layer, what its least cost is above this one's, and the edits by which its costs come about.

    A layer holds the least cost of each state, less the least of all.  State 0
    can't win if it costs over ``DELETE`` more than state 3, nor state 1 if it
    costs more: they lead nowhere else, but for an s, which can go.  Taken out,
    layers differ in few ways however long conversations are.
    """
    edges = [(e, q, to, cost + c) for q, cost in enumerate(layer) if cost < NEVER for e, to, c in _steps(q, sign)]
    costs = [min([c for *_, to, c in edges if to == q], default=NEVER) for q in range(4)]
    by = {e: tuple((q, to) for x, q, to, c in edges if x == e and c == costs[to]) for e in "DKR"}
    made = list(costs)
    costs = _inserted(costs)
    by = {e: tuple((q, to) for q, to in pairs if made[to] == costs[to]) for e, pairs in by.items()}
    if costs[0] > costs[3] + DELETE:
        costs[0] = NEVER
    if costs[1] > costs[3]:
        costs[1] = NEVER
    least = min(costs)
    return tuple(NEVER if c >= NEVER else c - least for c in costs), least, by


@lru_cache(1 << 14)
def insertions(layer: tuple[int, ...]) -> tuple[tuple[int, int], ...]:
    """The insertions by which a layer's costs come about; the order serves a walk backwards."""
    return tuple((q, to) for q, to in ((2, 3), (0, 2), (1, 2), (3, 2)) if layer[q] < NEVER and layer[q] + INSERT == layer[to])


def answers(signatures: Iterable[str]) -> Iterator[tuple[str, int, str]]:
    """(signature, cost, audit) of each; in sorted order, no prefix is computed twice."""
    layers, path = [START], ""
    costs = array("q", [0])
    for signature in signatures:
        shared = len(commonprefix([path, signature]))
        del layers[shared + 1 :], costs[shared + 1 :]
        for sign in signature[shared:]:
            layer, more, _ = layer_after(layers[-1], sign)
            layers.append(layer)
            costs.append(costs[-1] + more)
        path = signature
        yield signature, costs[-1] + min(layers[-1][q] for q in ENDS), _audit(layers, signature)


def _audit(layers: list[tuple[int, ...]], signature: str) -> str:
    """The initials of the cheapest edits, the least in ASCII order.

    Going back from the end, each layer's states on a cheapest way are marked;
    going forward, all states that the same initials lead to are followed, by
    the least initial that goes on.  Cheapest ways of one text of initials and
    more end at one time, for more edits cost more.
    """
    n = len(signature)
    least = min(layers[n][q] for q in ENDS)
    end = {q for q in ENDS if layers[n][q] == least}
    marked = bytearray(n + 1)
    for k in range(n, -1, -1):
        on = sum(1 << q for q in end) if k == n else 0
        if k < n:
            for pairs in layer_after(layers[k], signature[k])[2].values():
                for q, to in pairs:
                    on |= (marked[k + 1] >> to & 1) << q
        for q, to in insertions(layers[k]):
            on |= (on >> to & 1) << q
        marked[k] = on
    now, k, out = {0}, 0, bytearray()
    while not (k == n and now & end):
        edits = dict(layer_after(layers[k], signature[k])[2]) if k < n else {}
        edits["I"] = insertions(layers[k])
        for e in "DIKR":
            at = k + (e != "I")
            if to := {to for q, to in edits.get(e, ()) if q in now and marked[at] >> to & 1}:
                out += e.encode()
                now, k = to, at
                break
    return out.decode()


def _solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for signature, cost, audit in answers(s for batch in batches for s in batch.column(0).to_pylist()):
        yield pa.RecordBatch.from_pydict({"signature": [signature], "cost": [cost], "audit": [audit]})


def diagnosed(rows: DataFrame) -> DataFrame:
    """One row for each conversation of what ``faults`` returns: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit.

    gaps: turns missing between the first and the last, null turns apart.
    illegal: pairs of adjacent rows whose roles' initials aren't su, ua or au.
    cost and audit: of the cheapest edits (Keep, Rerole to user or assistant,
    Delete, Insert) after which the initials of roles are ``(s?(ua)+)?``; blank
    and duplicate rows must go, a truncated one that stays costs more.  A role
    with another initial, or none, can't be kept.  An empty table gives no rows.
    """
    kind = rows.schema["conv_id"].dataType.simpleString()
    order = ["conv_id", F.col("turn").asc_nulls_first(), "role", "tie"]
    given = rows.select("conv_id", "turn", "role", "tie", "fault", letter(F.col("role"), F.col("fault")).alias("sign")).repartition("conv_id").sortWithinPartitions(*order)
    given = given.select("conv_id", "turn", F.substring("role", 1, 1).alias("first"), "fault", "sign")
    signed = given.mapInArrow(_signed(_arrow_type(rows)), f"conv_id {kind}, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, signature string")
    signed = cut(signed, "repair-signatures")
    different = signed.select("signature").distinct().repartitionByRange("signature").sortWithinPartitions("signature")
    solved = different.mapInArrow(_solved, "signature string, cost bigint, audit string")
    return signed.join(solved, "signature").drop("signature")


def _arrow_type(rows: DataFrame) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(rows.schema["conv_id"].dataType)


def _repaired(kind: pa.DataType):
    schema = pa.schema([("conv_id", kind), ("place", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What edits leave, from rows in order, a conversation's audit before its rows."""
        conv, audit, at, place, odd = None, "", 0, 0, 0

        def put(edit: str, role: str | None, text: str) -> None:
            nonlocal place
            made.append((conv, place, edit, role if edit == "K" else NAMES["ua"[(place - odd) % 2]], text))
            place += 1

        def insert() -> None:
            nonlocal at
            while at < len(audit) and audit[at] == "I":
                put("I", None, "")
                at += 1

        for batch in batches:
            made: list[tuple] = []
            for own, edits, role, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if edits is not None:
                    insert()
                    conv, audit, at, place, odd = own, edits, 0, 0, (len(edits) - edits.count("D")) % 2
                    continue
                insert()
                if audit[at] != "D":
                    put(audit[at], role, text)
                at += 1
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in made], f.type) for i, f in enumerate(schema)], schema=schema)
        made = []
        insert()
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in made], f.type) for i, f in enumerate(schema)], schema=schema)

    return run


def repaired(rows: DataFrame, report: DataFrame) -> DataFrame:
    """The rows that the edits of ``diagnosed`` leave of what ``faults`` returns: conv_id, place (from 0), edit, role, text.

    Rows of a conversation follow each other by place within a partition.  A
    conversation of which nothing is left has no row.
    """
    small_batches(rows.sparkSession)
    kind = rows.schema["conv_id"].dataType.simpleString()
    none = lambda c, t: F.lit(None).cast(t).alias(c)
    heads = report.select("conv_id", F.lit(0).alias("part"), none("turn", "bigint"), none("role", "string"), none("tie", "string"), "audit", none("text", "string"))
    both = heads.union(rows.select("conv_id", F.lit(1).alias("part"), "turn", "role", "tie", none("audit", "string"), "text"))
    both = both.repartition("conv_id").sortWithinPartitions("conv_id", "part", F.col("turn").asc_nulls_first(), "role", "tie").select("conv_id", "audit", "role", "text")
    return both.mapInArrow(_repaired(_arrow_type(rows)), f"conv_id {kind}, place bigint, edit string, role string, text string")


def digests(rows: DataFrame) -> DataFrame:
    """(conv_id, sha256) of ``role:text``, newline-joined, of what ``repaired`` returns; no shuffle, for rows stand in order."""
    kind, arrow = rows.schema["conv_id"].dataType.simpleString(), _arrow_type(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, digest = None, None
        for batch in batches:
            done = []
            for own, place, role, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if not place:
                    if digest:
                        done.append((conv, digest.hexdigest()))
                    conv, digest = own, hashlib.sha256()
                digest.update(f"{chr(10) if place else ''}{role}:{text}".encode())
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in done], arrow), pa.array([r[1] for r in done], pa.string())], ["conv_id", "sha256"])
        if digest:
            yield pa.RecordBatch.from_arrays([pa.array([conv], arrow), pa.array([digest.hexdigest()])], ["conv_id", "sha256"])

    return rows.select("conv_id", "place", "role", "text").mapInArrow(run, f"conv_id {kind}, sha256 string")


def repair(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """What ``diagnosed`` and ``repaired`` return for ``turns``; faults and audits are written to the shared folder once."""
    rows = cut(faults(turns, conv, turn, role, text), "repair-rows")
    report = cut(diagnosed(rows), "repair-report")
    return report, repaired(rows, report)
