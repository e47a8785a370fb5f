"""Project files: makefile fragments, headers, conditional compilation."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import text
from quern.operators.graphs import reached
from quern.operators.trees import cut

AM_VAR = "file string, line int, name string, op string, words array<string>, conds array<struct<negated:boolean,var:string>>"


def parse_makefile(content: str) -> Iterator[tuple]:
    """(line, name, op, words, conditions) of the assignments of a Makefile.am; ``=`` and ``+=``, if, else, endif, continuations; rules are passed over."""
    stack: list[dict] = []
    joined, start = "", 0
    for number, raw in enumerate(content.split("\n"), 1):
        if not joined:
            start = number
        if raw.rstrip().endswith("\\"):
            joined += raw.rstrip()[:-1] + " "
            continue
        line, joined = (joined + raw).split("#")[0], ""
        if m := re.match(r"if\s+(!?)\s*(\w+)", line):
            stack.append({"negated": bool(m[1]), "var": m[2]})
        elif re.match(r"else\b", line) and stack:
            stack[-1] = {**stack[-1], "negated": not stack[-1]["negated"]}
        elif re.match(r"endif\b", line) and stack:
            stack.pop()
        elif m := re.match(r"([\w.@-]+)[ \t]*(\+?=)[ \t]*(.*)$", line):
            yield start, m[1], m[2], m[3].split(), [dict(c) for c in stack]


def makefile_variables(files: DataFrame) -> DataFrame:
    """Assignments of makefile fragments (path, content) as rows; ``$U`` is deleted first."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame([(p, *row) for p, c in zip(f.path, f.content, strict=True) for row in parse_makefile((c or "").replace("$U", ""))], columns=["file", "line", "name", "op", "words", "conds"])

    return files.select("path", "content").mapInPandas(run, AM_VAR)


def inline_includes(files: DataFrame, most: int = 64) -> DataFrame:
    """(path, content) with ``include FILE`` replaced by its content, an unknown file by an empty line, until none is left.

    Lines are rows with a key, the numbers of the lines that they came through;
    a round replaces all include lines of all files at once by the lines of the
    files they name, so there are as many rounds as files are nested, and texts
    are put together once, by key.  Files without includes are handed on as
    they are.  A file that would come to stand within itself is replaced by an
    empty line: a line knows the files that it came through.  Chains of over
    ``most`` files are an error, never left out.
    """
    line = F.posexplode(F.split("content", "\n")).alias("k", "line")
    lines = files.select("path", line).withColumn("inc", F.regexp_extract("line", r"^-?include[ \t]+(\S+)[ \t]*$", 1))
    including = cut(lines.where("inc <> ''").select("path").distinct())
    rows = lines.join(including, "path", "left_semi").select("path", F.array("k").alias("key"), "line", "inc", F.array("path").alias("chain"))
    own = lines.select(F.col("path").alias("inc"), F.col("k").alias("_k"), F.col("line").alias("_line"), F.col("inc").alias("_inc"))
    done = None
    while True:
        rows = cut(rows)
        flat = rows.where("inc = ''").select("path", "key", "line")
        done = flat if done is None else done.union(flat)
        left = rows.where("inc <> ''")
        if left.isEmpty():
            break
        if not left.where(F.size("chain") > most).isEmpty():
            raise ValueError(f"include chains of over {most} files")
        within = F.array_contains("chain", F.col("inc"))
        again = left.where(within).select("path", "key", F.lit("").alias("line"), F.lit("").alias("inc"), "chain")
        fresh = left.where(~within).join(own, "inc", "left")
        key = F.when(F.col("_k").isNull(), F.col("key")).otherwise(F.concat("key", F.array("_k")))
        fresh = fresh.select("path", key.alias("key"), F.coalesce("_line", F.lit("")).alias("line"), F.coalesce("_inc", F.lit("")).alias("inc"), F.concat("chain", F.array("inc")).alias("chain"))
        rows = again.union(fresh)
    whole = done.groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("key", "line"))), lambda x: x["line"]), "\n").alias("content"))
    return files.join(including, "path", "left_anti").select("path", "content").union(whole)


def current_values(assigned: DataFrame) -> DataFrame:
    """(file, name, pos, word, conds): what variables hold at the end: the words from the last plain ``=`` that no condition guards, on."""
    reset = assigned.where("op = '=' AND size(conds) = 0").groupBy("file", "name").agg(F.max("line").alias("_from"))
    kept = assigned.join(reset, ["file", "name"], "left").where("_from IS NULL OR line >= _from")
    return kept.select("file", "name", "line", F.posexplode("words").alias("pos", "word"), "conds")


def resolve_words(values: DataFrame, most: int = 64) -> DataFrame:
    """Words ``$(NAME)`` replaced by the words of that variable in the same file, level by level; a variable within itself gives nothing, conditions add up.

    Chains of over ``most`` variables are an error, never left out.
    """
    rows = values.withColumn("_path", F.array("name"))
    done = None
    for _ in range(most):
        inner = F.nullif(F.regexp_extract("word", r"^\$[({](\w+)[)}]$", 1), F.lit(""))
        rows = rows.withColumn("_ref", inner)
        flat = rows.where("_ref IS NULL")
        done = flat if done is None else done.union(flat)
        left = rows.where("_ref IS NOT NULL")
        if left.isEmpty():
            return done.select("file", "name", "line", "pos", "word", "conds")
        sub = values.select("file", F.col("name").alias("_ref"), F.col("word").alias("_w"), F.col("conds").alias("_c"))
        left = left.join(sub, ["file", "_ref"]).where("NOT array_contains(_path, _ref)")
        rows = cut(left.select("file", "name", "line", "pos", F.col("_w").alias("word"), F.array_union("conds", "_c").alias("conds"), F.concat("_path", F.array("_ref")).alias("_path")))
    raise ValueError(f"chains of over {most} variables")


def targets(values: DataFrame) -> DataFrame:
    """(file, target, kind, prefix): libraries (``.la`` only) and programs of the primaries."""
    named = values.select("file", "word", "conds", F.regexp_extract("name", r"^(\w+?)_(LTLIBRARIES|PROGRAMS)$", 1).alias("prefix"), F.regexp_extract("name", r"^(\w+?)_(LTLIBRARIES|PROGRAMS)$", 2).alias("kind"))
    return named.where("kind = 'PROGRAMS' OR kind = 'LTLIBRARIES' AND endswith(word, '.la')").select("file", F.col("word").alias("target"), "kind", "prefix", "conds")


def target_sources(found: DataFrame, values: DataFrame) -> DataFrame:
    """(file, target, source, conds) by the variable ``<target>_SOURCES``, else ``<target>.c``."""
    keyed = found.withColumn("_var", F.concat(text.automake_canonicalize(F.col("target")), F.lit("_SOURCES")))
    listed = keyed.join(values.select("file", F.col("name").alias("_var"), F.col("word").alias("source"), F.col("conds").alias("_c")), ["file", "_var"], "left")
    default = F.concat(F.regexp_replace("target", r"\.la$", ""), F.lit(".c"))
    return listed.select("file", "target", F.coalesce("source", default).alias("source"), F.when(F.col("_c").isNull(), F.col("conds")).otherwise(F.array_union("conds", "_c")).alias("conds"))


def resolve_sources(sources: DataFrame, files: DataFrame, built: DataFrame) -> DataFrame:
    """The first of a source's spellings that is a file or is built; others go.  files, built: (path).

    Paths compress well, so a table that looks small in its files may not be;
    the hint keeps it from being sent whole through the driver.
    """
    tried = sources.select("*", F.posexplode(F.array(*[F.concat("source", F.lit(s)) for s in text.SOURCE_SUFFIXES])).alias("_k", "_p"))
    there = files.select(F.col("path").alias("_p")).union(built.select("path")).distinct()
    return tried.join(there.hint("merge"), "_p").groupBy("file", "target", "source").agg(F.min_by("_p", "_k").alias("path"))


def reached_headers(roots: DataFrame, files: DataFrame, directories: list[str]) -> tuple[DataFrame, DataFrame]:
    """Headers that sources reach: (path) inside the project, (header) outside.

    files: (path, content).  A name is looked for in the directories in order,
    then beside the file that includes it.  Each file is read once.
    """
    names = files.select("path", F.explode(text.includes(F.col("content"))).alias("header"))
    spelled = F.concat(F.array(*[F.concat(F.lit(d + "/"), F.col("header")) for d in directories]), F.array(F.concat(F.regexp_replace(F.col("path"), "[^/]*$", ""), F.col("header"))))
    tries = names.select("path", "header", F.posexplode(F.transform(spelled, text.normalize_path)).alias("k", "target"))
    hit = tries.join(files.select(F.col("path").alias("target")), "target").groupBy("path", "header").agg(F.min_by("target", "k").alias("target"))
    edges = cut(names.distinct().join(hit, ["path", "header"], "left"))
    seen = reached(roots, edges, [], "path", "path", "target")
    return seen.join(roots, "path", "left_anti"), seen.join(edges, "path").where("target IS NULL").select("header").distinct()


def values_used(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """(symbol): symbols whose value is used, itself or through ``#define`` aliases: on a line that isn't a directive, and not as ``if (X)`` alone.

    Lines are split to words once and joined by word; chains of aliases may be
    of any length and run in cycles.
    """
    lines = files.select(F.explode(F.split(text.strip_comments(text.merge_continuations(F.col("content"))), "\n")).alias("line"))
    alias = lines.select(F.regexp_extract("line", r"^\s*#\s*define\s+(\w+)\s+(\w+)\s*$", 1).alias("alias"), F.regexp_extract("line", r"^\s*#\s*define\s+(\w+)\s+(\w+)\s*$", 2).alias("symbol")).where("alias <> ''").distinct()
    body = lines.where(~F.col("line").rlike(r"^\s*#")).select(F.regexp_replace("line", r"\bif\s*\(\s*!?\s*\w+\s*\)", "").alias("line"))
    direct = body.select(F.explode(F.regexp_extract_all("line", F.lit(r"\w+"), F.lit(0))).alias("name")).distinct()
    named = reached(symbols.select("symbol", F.col("symbol").alias("name")), alias, ["symbol"], "name", "symbol", "alias")
    return named.join(direct, "name").select("symbol").distinct()


def policies(symbols: DataFrame, used: DataFrame, frozen: DataFrame) -> DataFrame:
    """(symbol, type, value): frozen ones are Set, Fixed or Unset by their value; the others Env if their value is used, Cfg if only asked for.

    symbols: (symbol); used: (symbol); frozen: (symbol, value).
    """
    rows = symbols.select("symbol").distinct().join(frozen.withColumn("_f", F.lit(True)), "symbol", "left").join(used.withColumn("_u", F.lit(True)), "symbol", "left")
    kind = F.when(F.col("_f"), F.when(F.col("value").isNull(), "Unset").when(F.col("value").isin("", "1"), "Set").otherwise("Fixed")).when(F.col("_u"), "Env").otherwise("Cfg")
    return rows.select("symbol", kind.alias("type"), F.when(kind == "Fixed", F.col("value")).alias("value"))


def header_templates(headers: DataFrame) -> DataFrame:
    """(path, symbol, subst, block): ``#define NAME @VAR@`` of header templates and the ``#if @C@`` block they stand in.

    A literal value has no subst; another value is passed over.
    """
    blocks = headers.select("path", F.explode(F.regexp_extract_all("content", F.lit(r"(?s)#\s*if\s+@(\w+)@(.*?)#\s*endif"), F.lit(0))).alias("text")).select("path", F.regexp_extract("text", r"@(\w+)@", 1).alias("block"), "text")
    outside = headers.select("path", F.lit(None).cast("string").alias("block"), F.regexp_replace("content", r"(?s)#\s*if\s+@\w+@.*?#\s*endif", "").alias("text"))
    line = F.explode(F.regexp_extract_all("text", F.lit(r"(?m)^[ \t]*#[ \t]*define[ \t]+(\w+[^\n]*)$"), F.lit(1))).alias("line")
    rows = blocks.union(outside).select("path", "block", line)
    value = F.trim(F.regexp_replace(F.regexp_extract("line", r"^\w+(.*)$", 1), r"/\*.*?\*/", ""))
    rows = rows.select("path", F.regexp_extract("line", r"^(\w+)", 1).alias("symbol"), text.substitution(value).alias("subst"), "block", value.alias("_v"))
    return rows.where(F.col("subst").isNotNull() | text.is_header_literal(F.col("_v"))).drop("_v")


def generated_files(written: DataFrame, removed: DataFrame) -> DataFrame:
    """Paths that a script writes and doesn't remove, both normalised."""
    clean = lambda d: d.select("script_id", text.normalize_path(F.col("path")).alias("path")).distinct()
    return clean(written).join(clean(removed), ["script_id", "path"], "left_anti")


def source_paths(*parts: DataFrame) -> DataFrame:
    """(path) of sources, headers and configuration templates one after the other, repeats kept."""
    out = parts[0].select("path")
    for p in parts[1:]:
        out = out.union(p.select("path"))
    return out


def other_paths(*parts: DataFrame) -> DataFrame:
    """(path) of templates and link targets, each once."""
    return source_paths(*parts).distinct()


def load_files(spark: SparkSession, root: str, paths: DataFrame) -> DataFrame:
    """(path, content) of the listed files under a folder that Spark reads."""
    found = spark.read.text(root, wholetext=True, recursiveFileLookup=True).select(F.regexp_replace(F.input_file_name(), "^.*?" + root.rstrip("/").split("/")[-1] + "/", "").alias("path"), F.col("value").alias("content"))
    return found.join(paths.select("path").distinct(), "path", "left_semi")


def mentioned_variables(templates: DataFrame, variables: DataFrame) -> DataFrame:
    """(path, var): variables that a template names as ``@VAR@``; templates are read once, whatever the variables."""
    names = templates.select("path", F.explode(F.regexp_extract_all("content", F.lit(r"@([A-Za-z_]\w*)@"), F.lit(1))).alias("var")).distinct()
    return names.join(variables.select("var").distinct(), "var", "left_semi").select("path", "var")


def cflags_variables(values: DataFrame, found: DataFrame) -> DataFrame:
    """(file, var): variables in the CFLAGS of library targets."""
    own = found.where("kind = 'LTLIBRARIES'").select("file", F.concat(text.automake_canonicalize(F.col("target")), F.lit("_CFLAGS")).alias("name"))
    words = values.join(own, ["file", "name"]).select("file", F.regexp_extract("word", r"^\$[({](\w+)[)}]$", 1).alias("var"))
    return words.where("var <> ''").distinct()


def condition_guards(conditions: DataFrame, tests: DataFrame) -> DataFrame:
    """(key, test): each condition key once with the test that the script gives it; a key without one is an error row (null)."""
    return conditions.select("key").distinct().join(tests.groupBy(F.col("condition").alias("key")).agg(F.min("test").alias("test")), "key", "left")


def first_provided(providers: list[DataFrame], key: str, value: str) -> DataFrame:
    """Of each key the value of the first provider that has one."""
    rows = None
    for k, p in enumerate(providers):
        own = p.where(F.col(value).isNotNull()).select(key, value, F.lit(k).alias("_k"))
        rows = own if rows is None else rows.union(own)
    return rows.groupBy(key).agg(F.min_by(value, "_k").alias(value))


def package_paths(names: DataFrame, catalogue: DataFrame) -> DataFrame:
    """(pc_name, path): where a package's description lies, ``NAME.pc`` if it isn't known."""
    known = catalogue.select("pc_name", F.col("path").alias("_path"))
    return names.select("pc_name").distinct().join(known, "pc_name", "left").select("pc_name", F.coalesce("_path", F.concat("pc_name", F.lit(".pc"))).alias("path"))


def merged_positions(*maps: DataFrame) -> DataFrame:
    """(var, places): the places of each variable from several maps (var, place), in order."""
    rows = maps[0].select("var", "place")
    for m in maps[1:]:
        rows = rows.union(m.select("var", "place"))
    return rows.groupBy("var").agg(F.array_sort(F.collect_list("place")).alias("places"))


def merged_flags(rows: DataFrame, by: list[str], flags: list[str]) -> DataFrame:
    """What any of a key's rows asks for."""
    return rows.groupBy(*by).agg(*[F.bool_or(f).alias(f) for f in flags])


def merged_literals(parts: Column) -> Column:
    """Parts of a value with literals that follow each other as one; parts: array<struct<kind, text>>."""
    one = lambda k, t: F.struct(k.alias("kind"), t.alias("text"))
    joins = lambda acc, x: (F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["kind"] == "Lit") & (x["kind"] == "Lit")
    more = lambda acc, x: F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(one(F.lit("Lit"), F.concat(F.try_element_at(acc, F.lit(-1))["text"], x["text"]))))
    return F.aggregate(parts, F.array().cast("array<struct<kind:string,text:string>>"), lambda acc, x: F.when(joins(acc, x), more(acc, x)).otherwise(F.concat(acc, F.array(one(x["kind"], x["text"])))))
