"""Scripts and project files as tables."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from quern.operators import guards, rendering, rewriting, rust
from quern.operators.analysis import Script, arithmetics, infer, scopes, word_uses
from quern.sources import arithmetic
from quern.sources.shell import ScriptError, literal

#: The tables that scripts are parsed into.
SCHEMAS = {
    "node": "node_id bigint, parent_id bigint, top_id bigint, branch int, exec_id bigint, exit_id bigint, kind string, text string, line int, end_line int, guards array<string>, error_out boolean, arms int, source string",
    "assignment": "node_id bigint, exec_id bigint, var string, value string, uses array<string>, guards array<string>",
    "arith": "node_id bigint, pos int, kind string, text string",
    "fragment": "node_id bigint, word int, pos int, kind string, text string",
    "file": "role string, path string",
    "unused": "node_id bigint, var string",
    "scope": "var string, idx int, owner int, bound_by int, readers array<int>, writers array<int>, overwriters array<int>",
    "rust": "node_id bigint, code string",
    "kept": "pos int, source string",
    "var_event": "var string, event string, node_id bigint, exec_id bigint, ord int, line int, guards array<string>",
    "guard_term": "node_id bigint, guard int, path array<int>, op string, negated boolean, atom_kind string, name string, cond_kind string, operand string",
    "m4_call": "node_id bigint, exec_id bigint, name string, args array<struct<kind:string,text:string>>, guards array<string>",
    "eval_name": "exec_id bigint, name string, value string",
    "dict_access": "dict string, op string, exec_id bigint, keys string",
    "type_hint": "var string, hint string, arg string",
    "chunk": "chunk bigint, node_id bigint, first_line int, last_line int",
    "chunk_io": "chunk bigint, var string, role string",
    "error": "line int, message string",
}


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(script_id, text) of whole files."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("script_id"), F.col("value").alias("text"))


def _node(s: Script) -> Iterator[dict]:
    for r in s.rows:
        yield {"node_id": r.node_id, "parent_id": r.parent_id, "top_id": r.top, "branch": r.branch, "exec_id": r.exec_id, "exit_id": r.exit_id, "kind": r.kind, "text": r.text, "line": r.line, "end_line": r.end_line, "guards": r.guards, "error_out": r.error_out, "arms": len(r.node.branches), "source": rendering.node(r.node)}


def _assignment(s: Script) -> Iterator[dict]:
    for r in s.rows:
        if r.kind == "Assignment":
            yield {"node_id": r.node_id, "exec_id": r.exec_id, "var": r.text, "value": literal([f for x in r.node.words[0] for f in (x[1] if x[0] == "dq" else [x])]), "uses": sorted(set(word_uses(r.node.words[0]))), "guards": r.guards}


def _arith(s: Script) -> Iterator[dict]:
    for r in s.rows:
        for text in (t for w in r.node.words for t in arithmetics(w)):
            for k, t in enumerate(arithmetic.walk(arithmetic.parse(text))):
                yield {"node_id": r.node_id, "pos": k, "kind": t[0], "text": t[1] if t[0] in ("num", "var", "step", "un", "bin", "set") else ""}


def _fragment(s: Script) -> Iterator[dict]:
    for r in s.rows:
        for k, word in enumerate(r.node.words):
            flat = [f for x in word for f in (x[1] if x[0] == "dq" else [x])]
            for j, f in enumerate(flat):
                yield {"node_id": r.node_id, "word": k, "pos": j, "kind": f[0], "text": f[2] if f[0] == "subst" else str(f[1])}


def _guard_term(s: Script) -> Iterator[dict]:
    for r in s.rows:
        if r.kind not in ("If", "While", "Until", "And", "Or", "Case"):
            continue
        for k, (test, _) in enumerate(r.node.branches):
            guard = guards.of_pattern(r.node.words[0], test, s._shown) if r.kind == "Case" else guards.of_condition(test, s._shown) if test else None
            for path, op, no, kind, name, cond, operand in guards.terms(guard) if guard else ():
                yield {"node_id": r.node_id, "guard": k, "path": list(path), "op": op, "negated": no, "atom_kind": kind, "name": name, "cond_kind": cond, "operand": operand}


def _m4_call(s: Script) -> Iterator[dict]:
    for r in s.rows:
        if r.kind == "Macro":
            yield {"node_id": r.node_id, "exec_id": r.exec_id, "name": r.text, "args": [{"kind": a[0], "text": a[1] if a[0] == "Literal" else rendering.argument(a, 0)[1:-1].strip("\n")} for a in r.node.args], "guards": r.guards}


def _substituted(s: Script) -> set[str]:
    return {r.node.args[0][1] for r in s.rows if r.kind == "Macro" and r.text in ("AC_SUBST", "AM_SUBST_NOTMAKE") and r.node.args and r.node.args[0][0] == "Literal"}


def _chunk(s: Script, window: int, threshold: int) -> Iterator[dict]:
    for k, chunk in enumerate(s.chunks(window, threshold)):
        for r in chunk:
            yield {"chunk": k, "node_id": r.node_id, "first_line": chunk[0].line, "last_line": chunk[-1].end_line}


def _chunk_io(s: Script, window: int, threshold: int) -> Iterator[dict]:
    for k, chunk in enumerate(s.chunks(window, threshold)):
        for var, role in s.chunk_io(chunk, _substituted(s)):
            yield {"chunk": k, "var": var, "role": role}


def _scope(s: Script, window: int, threshold: int) -> Iterator[dict]:
    for x in scopes(s, s.chunks(window, threshold)):
        yield {"idx" if k == "index" else k: v for k, v in x.items()}


def _rust(s: Script) -> Iterator[dict]:
    printer = rust.Printer(infer(list(s.hints())))
    for r in s.rows:
        if r.parent_id is None:
            yield {"node_id": r.node_id, "code": printer.visit(r.node)}


_TABLES = {
    "node": _node, "assignment": _assignment, "arith": _arith, "fragment": _fragment, "guard_term": _guard_term, "m4_call": _m4_call, "rust": _rust,
    "file": lambda s: [*({"role": "written", "path": p} for p in rewriting.redirected(s.top)), *({"role": "removed", "path": p} for p in rewriting.removed_files(s.top))],
    "unused": lambda s: ({"node_id": r.node_id, "var": r.text} for r in s.unused(_substituted(s))),
    "kept": lambda s: ({"pos": k, "source": rendering.node(n)} for k, n in enumerate(rewriting.without_messages(s.top))),
    "var_event": lambda s: ({"var": e.var, "event": e.event, "node_id": e.node_id, "exec_id": e.exec_id, "ord": e.ord, "line": e.line, "guards": e.guards} for e in s.events),
    "eval_name": lambda s: ({"exec_id": at, "name": name, "value": value} for at, name, value in s.dynamic_names()),
    "dict_access": lambda s: ({"dict": name, "op": op, "exec_id": at, "keys": keys} for name, op, at, keys in s.dictionaries()),
    "type_hint": lambda s: ({"var": v, "hint": h, "arg": a} for v, h, a in s.hints()),
}
_CHUNKED = {"chunk": _chunk, "chunk_io": _chunk_io, "scope": _scope}


def _rows(text: str, window: int, threshold: int, names: Iterable[str] = SCHEMAS) -> Iterator[tuple[str, dict]]:
    try:
        s = Script(text)
        for name in names:
            if name != "error":
                yield from ((name, r) for r in (_CHUNKED[name](s, window, threshold) if name in _CHUNKED else _TABLES[name](s)))
    except (ScriptError, ValueError, RecursionError) as e:
        yield "error", {"line": getattr(e, "line", 0), "message": str(e)}


def parse_scripts(scripts: DataFrame, window: int = 2, threshold: int = 200) -> DataFrame:
    """(script_id, tbl, row) of all tables; a script that can't be read gives an error row (and the rows before it)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(i, t, json.dumps(r)) for i, text in zip(frame.script_id, frame.text, strict=True) for t, r in _rows(text or "", window, threshold)]
            yield pd.DataFrame(rows, columns=["script_id", "tbl", "row"])

    return scripts.select(F.col("script_id").cast("string"), F.col("text").cast("string")).mapInPandas(run, "script_id string, tbl string, row string")


def parse_table(scripts: DataFrame, name: str, window: int = 2, threshold: int = 200) -> DataFrame:
    """One table of the scripts, with its own columns: nothing else is made or sent."""
    kind = f"script_id string, {SCHEMAS[name]}"
    arrow = to_arrow_schema(scripts.sparkSession.createDataFrame([], kind).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [{"script_id": i, **r} for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for t, r in _rows(text or "", window, threshold, [name]) if t == name]
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return scripts.select(F.col("script_id").cast("string"), F.col("text").cast("string")).mapInArrow(run, kind)


def table(parsed: DataFrame, name: str) -> DataFrame:
    """One of the tables of ``SCHEMAS`` out of parsed scripts."""
    return parsed.where(F.col("tbl") == name).select("script_id", F.from_json("row", SCHEMAS[name]).alias("r")).select("script_id", "r.*")


__all__ = ["SCHEMAS", "literal", "parse_scripts", "parse_table", "read_texts", "table"]
