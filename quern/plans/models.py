"""External models behind one interface; the default answers from a table and calls nothing."""

from __future__ import annotations

import hashlib
import json
import re
import threading
import time
import uuid
from collections import deque
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ANSWER = "request_id string, answer string, attempts int, error string"
MOST_RETRIES, IN_FLIGHT = 5, 10

Provider = Callable[[str], str]
Validator = Callable[[str, str], list[str]]


def prompt(instruction: str, request: str, schema: str, previous: str | None = None, errors: list[str] | None = None) -> str:
    parts = [instruction, "Input:\n" + request, "Answer as JSON of this schema:\n" + schema]
    if errors:
        parts += ["Your last answer was:\n" + (previous or ""), "It was wrong:\n" + "\n".join(f"- {e}" for e in errors)]
    return "\n\n".join(parts)


class Ledger:
    """Answers by request, kept in a folder that all tasks reach: one small file each, put there whole by a rename.

    What a task has been answered outlives it: when it, or another attempt of
    it, is asked again, it reads the answer and asks nobody.  ``uri`` is a
    folder of any file system that pyarrow opens.
    """

    def __init__(self, uri: str):
        self.uri = uri

    def _place(self, request_id: str, request: str) -> tuple[fs.FileSystem, str]:
        system, folder = fs.FileSystem.from_uri(self.uri)
        return system, f"{folder}/{hashlib.sha256(f'{len(request_id)}:{request_id}{request}'.encode()).hexdigest()}.json"

    def get(self, request_id: str, request: str) -> tuple | None:
        system, path = self._place(request_id, request)
        if system.get_file_info(path).type == fs.FileType.NotFound:
            return None
        with system.open_input_stream(path) as f:
            return tuple(json.loads(f.read()))

    def put(self, request_id: str, request: str, row: tuple) -> None:
        system, path = self._place(request_id, request)
        system.create_dir(path.rpartition("/")[0])
        part = f"{path}.{uuid.uuid4().hex}"
        with system.open_output_stream(part) as f:
            f.write(json.dumps(row).encode())
        system.move(part, path)


class Pace:
    """At most ``per_second`` beginnings a second, by all threads of a task."""

    def __init__(self, per_second: float | None):
        self.gap, self.next, self.lock = 1 / per_second if per_second else 0.0, 0.0, threading.Lock()

    def wait(self) -> None:
        if not self.gap:
            return
        with self.lock:
            at = max(time.monotonic(), self.next)
            self.next = at + self.gap
        time.sleep(max(0.0, at - time.monotonic()))


def ask(requests: DataFrame, provider: Provider, validate: Validator, instruction: str = "", schema: str = "{}", retries: int = MOST_RETRIES, in_flight: int = IN_FLIGHT, per_second: float | None = None, ledger: Ledger | None = None) -> DataFrame:
    """(request_id, answer, attempts, error): each request asked again with what was wrong, ``retries`` times at most; what fails is an error row, never dropped.

    A task has up to ``in_flight`` requests under way, begins ``per_second`` of
    them at most, and holds no more than these and their answers; rows come in
    the order of requests.  With a ``ledger`` a request that was answered well
    is never asked twice, whatever becomes of the task; failures are.
    """

    def one(rid: str, request: str, pace: Pace) -> tuple:
        if ledger and (known := ledger.get(rid, request)):
            return (rid, *known)
        previous, errors, answer, attempt = None, None, None, 0
        for attempt in range(1, retries + 1):
            pace.wait()
            try:
                answer = provider(prompt(instruction, request, schema, previous, errors))
                json.loads(answer)
                errors = validate(request, answer)
            except Exception as e:  # noqa: BLE001 - whatever a provider raises is told in the row
                answer, errors = None, [f"{type(e).__name__}: {e}"]
            if not errors:
                break
            previous = answer
        row = (None if errors else answer, attempt, "; ".join(errors) if errors else None)
        if ledger and not errors:
            ledger.put(rid, request, row)
        return (rid, *row)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pace = Pace(per_second)
        with ThreadPoolExecutor(in_flight) as pool:
            for f in frames:
                out, open_ = [], deque()
                try:
                    for rid, request in zip(f.request_id, f.request, strict=True):
                        if len(open_) == in_flight:
                            out.append(open_.popleft().result())
                        open_.append(pool.submit(one, rid, request, pace))
                    out += [x.result() for x in open_]
                except BaseException:
                    pool.shutdown(cancel_futures=True)
                    raise
                yield pd.DataFrame(out, columns=["request_id", "answer", "attempts", "error"])

    return requests.select("request_id", "request").mapInPandas(run, ANSWER)


def from_table(requests: DataFrame, answers: DataFrame) -> DataFrame:
    """The same from a table (request_id, answer)."""
    found = requests.select("request_id").join(answers.select("request_id", "answer"), "request_id", "left")
    return found.select("request_id", "answer", F.lit(1).alias("attempts"), F.when(F.col("answer").isNull(), "no answer").alias("error"))


def no_op_patterns(source: str, values: list[str]) -> list[str]:
    """Values that a text compares or assigns without any use: ``let _ = "value"``."""
    return [f"{v} is without effect" for v in values if re.search(rf"let\s+_\w*\s*=\s*{re.escape(json.dumps(v))}", source)]


def translation_errors(translations: DataFrame) -> DataFrame:
    """(chunk, error) for each rule that generated code breaks.

    Columns: chunk, name, source, snippets, placeholders, banned (arrays; null
    is none).  A null source is an error by itself, a null name asks for none.
    """
    given = lambda c: F.coalesce(c, F.array().cast("array<string>"))
    missing = F.transform(F.filter(given("snippets"), lambda s: ~F.contains(F.col("source"), s)), lambda s: F.concat(F.lit("missing snippet: "), s))
    dropped = F.transform(F.filter(given("placeholders"), lambda s: ~F.contains(F.col("source"), s)), lambda s: F.concat(F.lit("missing placeholder: "), s))
    barred = F.transform(F.filter(given("banned"), lambda s: F.contains(F.col("source"), s)), lambda s: F.concat(F.lit("banned: "), s))
    renamed = F.when(~F.contains("source", F.concat(F.lit("fn "), F.col("name"))), F.array(F.lit("the function has another name"))).otherwise(F.array().cast("array<string>"))
    found = F.when(F.col("source").isNull(), F.array(F.lit("no translation"))).otherwise(F.concat(renamed, missing, dropped, barred))
    return translations.select("chunk", F.explode(found).alias("error"))


def restore_placeholders(source, mappings: list[tuple[str, str]]):
    """A column with each placeholder replaced by its text, one after the other."""
    for name, text in mappings:
        source = F.replace(source, F.lit(name), F.lit(text))
    return source


OPTION_TASK = "Part the values that a build option can have. Name one representative for each group of values that lead to the same build, and give every other value as an alias of its representative. Say whether the option is on unless somebody asks, and which value it then has."
OPTION_SCHEMA = '{"representatives": ["value"], "aliases": {"value": "representative"}, "enabled_by_default": true, "non_boolean_default": null}'
CHUNK_TASK = "Translate the shell commands to one Rust function with the signature that is given. Keep every given snippet and placeholder as it stands, call no macro by its name, and add no effect that the commands don't have."
CHUNK_SCHEMA = '{"rust_func_body": "text"}'
PARTITION = "representatives array<string>, aliases map<string,string>, enabled_by_default boolean, non_boolean_default string"


def option_requests(candidates: DataFrame) -> DataFrame:
    """(request_id, request) for each option: its name and the values found, in order."""
    rows = candidates.groupBy("option_name").agg(F.array_sort(F.collect_set("value")).alias("candidates"))
    return rows.select(F.col("option_name").alias("request_id"), F.to_json(F.struct("option_name", "candidates")).alias("request"))


def analysed_options(candidates: DataFrame, answers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(partitions, failures) of options from answers (request_id, answer): what breaks a rule, or was never answered, is a failure row and no partition."""
    from quern.operators import values

    asked = candidates.groupBy("option_name").agg(F.array_sort(F.collect_set("value")).alias("candidates"))
    rows = asked.join(answers.select(F.col("request_id").alias("option_name"), F.from_json("answer", PARTITION).alias("a")), "option_name", "left").select("option_name", "candidates", "a.*")
    none = rows.where("representatives IS NULL").select("option_name", F.lit("no answer").alias("error"))
    given = rows.where("representatives IS NOT NULL").withColumn("aliases", F.coalesce("aliases", F.create_map().cast("map<string,string>")))
    wrong = values.partition_errors(given)
    return given.join(wrong.select("option_name").distinct(), "option_name", "left_anti"), none.union(wrong)
