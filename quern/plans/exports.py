"""Sinks: manifest, wrapper header, conditional map, metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Fixed values of a manifest without metadata.
DEFAULT_NAME, DEFAULT_VERSION = "unnamed-project", "0.1.0"
#: Model prices in dollars for a million tokens.
PRICE_IN, PRICE_OUT = 0.25, 2.0


def manifest(metadata: DataFrame, features: DataFrame, edges: DataFrame) -> DataFrame:
    """(script_id, text): a Cargo manifest for each script.

    metadata: script_id, name, version; features: script_id, feature,
    enabled_by_default; edges: script_id, feature, needs.
    """
    need = edges.groupBy("script_id", "feature").agg(F.array_sort(F.collect_set("needs")).alias("needs"))
    quoted = lambda xs: F.array_join(F.transform(xs, lambda x: F.concat(F.lit('"'), x, F.lit('"'))), ", ")
    line = F.concat("feature", F.lit(" = ["), quoted(F.coalesce("needs", F.array().cast("array<string>"))), F.lit("]\n"))
    own = features.join(need, ["script_id", "feature"], "left").groupBy("script_id").agg(
        F.array_sort(F.collect_set(F.when(F.col("enabled_by_default"), F.col("feature")))).alias("_on"), F.array_sort(F.collect_set(line)).alias("_lines")
    )
    head = F.concat(F.lit('[package]\nname = "'), F.coalesce("name", F.lit(DEFAULT_NAME)), F.lit('"\nversion = "'), F.coalesce("version", F.lit(DEFAULT_VERSION)), F.lit('"\nedition = "2021"\nbuild = "build.rs"\n\n[features]\ndefault = ['))
    tail = F.lit('\n[build-dependencies]\nbindgen = "*"\npkg-config = "*"\nregex = "*"\n')
    rows = metadata.join(own, "script_id", "left")
    return rows.select("script_id", F.concat(head, quoted(F.coalesce("_on", F.array().cast("array<string>"))), F.lit("]\n"), F.array_join(F.coalesce("_lines", F.array().cast("array<string>")), ""), tail).alias("text"))


def conditional_map(policies: DataFrame) -> DataFrame:
    """One JSON text with an entry for each symbol, by name."""
    entry = F.struct(F.col("symbol").alias("key"), F.struct("type", "value").alias("value"))
    return policies.agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(entry)))).alias("json"))


def joined(column: str) -> Column:
    return F.coalesce(F.array_join(column, ";"), F.lit("")).alias(column)


def option_records(records: DataFrame) -> DataFrame:
    """The columns of build_options.csv: lists joined by ``;``, nulls empty."""
    lists = ("value_candidates", "representatives", "features")
    return records.select(*[joined(c) if c in lists else F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("option_name", "success", "failure_reason", "llm_cost", "duration_ms", *lists)])


def chunk_records(chunks: DataFrame) -> DataFrame:
    return chunks.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("chunk_id", "chunk_size", "translation_type", "success", "failure_reason", "retry_count", "llm_cost", "duration_ms")])


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)


def cost(usage: DataFrame) -> DataFrame:
    return usage.agg((F.sum(F.col("prompt_tokens") * PRICE_IN + F.col("completion_tokens") * PRICE_OUT) / 1e6).alias("cost"))


def default_of(kind: Column) -> Column:
    return F.when(kind == "Boolean", "false").when(kind == "Integer", "0").when(kind.startswith("List"), "Vec::new()").when(kind == "Path", "PathBuf::new()").otherwise("String::new()")


def rust_type(kind: Column) -> Column:
    inner = F.regexp_extract(kind, "^List<(.*)>$", 1)
    plain = lambda k: F.when(k == "Boolean", "bool").when(k == "Integer", "usize").when(k == "Path", "PathBuf").otherwise("String")
    return F.when(inner != "", F.concat(F.lit("Vec<"), plain(inner), F.lit(">"))).otherwise(plain(kind))


def skeletons(chunk_io: DataFrame, types: DataFrame) -> DataFrame:
    """(script_id, chunk, signature, header, footer): a Rust function for each chunk, parameters and returned values by name."""
    rows = chunk_io.groupBy("script_id", "chunk", "var").agg(F.bool_or(F.col("role") == "arg").alias("arg"), F.bool_or(F.col("role") == "return").alias("ret")).join(types, ["script_id", "var"], "left")
    kind = rust_type(F.coalesce("type", F.lit("Literal")))
    param = F.concat("var", F.lit(": "), F.when(F.col("ret"), F.lit("&mut ")).otherwise(F.lit("&")), kind)
    own = rows.groupBy("script_id", "chunk").agg(
        F.array_sort(F.collect_set(F.when(F.col("arg"), param))).alias("_args"),
        F.array_sort(F.collect_set(F.when(F.col("ret") & ~F.col("arg"), F.struct("var", kind.alias("kind"))))).alias("_rets"),
        F.array_sort(F.collect_set(F.when(~F.col("arg"), F.concat(F.lit("let mut "), "var", F.lit(": "), kind, F.lit(" = "), default_of(F.coalesce("type", F.lit("Literal"))), F.lit(";"))))).alias("_lets"),
    )
    names, kinds = F.transform("_rets", lambda r: r["var"]), F.transform("_rets", lambda r: r["kind"])
    out = F.when(F.size("_rets") == 0, "").otherwise(F.concat(F.lit(" -> ("), F.array_join(kinds, ", "), F.lit(")")))
    return own.select("script_id", "chunk", F.concat(F.lit("fn func"), F.col("chunk").cast("string"), F.lit("("), F.array_join("_args", ", "), F.lit(")"), out).alias("signature"), F.array_join("_lets", "\n").alias("header"), F.when(F.size("_rets") == 0, "").otherwise(F.concat(F.lit("("), F.array_join(names, ", "), F.lit(")"))).alias("footer"))


def banned(calls: DataFrame, translated: list[str]) -> DataFrame:
    """Macro names that must not stand in generated code: those without a rule."""
    return calls.where(~F.col("name").isin(translated)).select("script_id", "name").distinct()


def default_init(ownerless: DataFrame, environment: DataFrame, types: DataFrame) -> DataFrame:
    """(script_id, text) lines that give variables without an owner their defaults, but those of the environment."""
    rows = ownerless.join(environment, ["script_id", "var"], "left_anti").join(types, ["script_id", "var"], "left")
    kind = F.coalesce("type", F.lit("Literal"))
    line = F.concat(F.lit("let mut "), "var", F.lit(": "), rust_type(kind), F.lit(" = "), default_of(kind), F.lit(";"))
    return rows.groupBy("script_id").agg(F.array_join(F.array_sort(F.collect_set(line)), "\n").alias("text"))


def project_info(parts: dict[str, DataFrame], links: DataFrame) -> DataFrame:
    """One row: sorted paths of each part, links as (target, source) pairs, and how many files and links there are.

    parts: name to (path).  It is a record that a person reads; ``to_json`` of
    it is the exported text.
    """
    out = links.agg(F.array_sort(F.collect_set(F.struct("target", "source"))).alias("links"), F.count("*").alias("n_links"))
    total = F.lit(0)
    for name, rows in parts.items():
        out = out.join(rows.agg(F.array_sort(F.collect_set("path")).alias(name)))  # one row each
        total = total + F.size(name)
    return out.select(*parts, "links", total.cast("bigint").alias("n_files"), "n_links")


def project_info_json(info: DataFrame) -> DataFrame:
    return info.select(F.to_json(F.struct(*info.columns)).alias("json"))


def chunk_dump(chunks: DataFrame, nodes: DataFrame, skeletons_: DataFrame) -> DataFrame:
    """(script_id, chunk, text): what a chunk is made of, for people to read: its nodes in order, signature, header and footer."""
    lines = chunks.join(nodes, ["script_id", "node_id"]).groupBy("script_id", "chunk").agg(F.array_sort(F.collect_list(F.struct("exec_id", "source"))).alias("_n"))
    shown = F.array_join(F.transform("_n", lambda n: F.concat(F.lit("#"), n["exec_id"].cast("string"), F.lit(" "), n["source"])), "\n")
    rows = lines.join(skeletons_, ["script_id", "chunk"], "left")
    return rows.select("script_id", "chunk", F.concat_ws("\n", shown, *[F.when(F.col(c) != "", F.col(c)) for c in ("signature", "header", "footer")]).alias("text"))
