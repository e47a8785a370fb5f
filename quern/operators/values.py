"""Sets, candidates, products, guards on tables, type lattice and policies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The order in which types win.
TYPE_PRIORITY = {"Either": 0, "Literal": 1, "Path": 2, "Boolean": 3, "Integer": 4, "Optional": 5, "List": 6}
MOST_CANDIDATES = 10


def product(sets: Sequence[Column]) -> Column:
    """All tuples of one element of each array, as arrays; none if any is empty, one empty tuple for no arrays."""
    out = F.array(F.array().cast("array<string>"))
    for choices in sets:
        out = _longer(out, choices)
    return out


def _longer(tuples: Column, choices: Column) -> Column:
    return F.flatten(F.transform(tuples, lambda t: F.transform(choices, lambda x: F.concat(t, F.array(x)))))


def candidates(values: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Per key up to ten values: different ones in numeric order if all are whole numbers of any length, or else all in text order; with ``numeric``.

    Null values are none, null keys a key like others.  Ten is the feature; a
    key keeps its ten least before rows are sent, so no key is gathered whole.
    """
    key = F.struct(*by)
    rows = values.where(F.col(value).isNotNull()).select(key.alias("_key"), F.col(value).alias("_v"))
    plain = rows.groupBy("_key").agg(F.bool_and(F.col("_v").rlike("^[0-9]+$")).alias("numeric"))
    marked = rows.join(plain, "_key").select("_key", "numeric", "_v")
    numbers = marked.where("numeric").withColumn("_v", F.regexp_replace("_v", "^0+(?=[0-9])", "")).distinct()
    marked = numbers.union(marked.where("NOT numeric"))
    place = F.row_number().over(Window.partitionBy("_key").orderBy(F.when(F.col("numeric"), F.length("_v")), "_v"))
    top = marked.withColumn("_place", place).where(F.col("_place") <= MOST_CANDIDATES)
    listed = F.array_sort(F.collect_list(F.struct("_place", "_v")))
    return top.groupBy("_key", "numeric").agg(F.transform(listed, lambda x: x["_v"]).alias("candidates")).select("_key.*", "numeric", "candidates")


def contradictions(atoms: DataFrame, by: Sequence[str], var: str, negated: str) -> DataFrame:
    """Keys and variables that are asked to be both true and false."""
    return atoms.groupBy(*by, var).agg(F.bool_or(negated).alias("_no"), F.bool_or(~F.col(negated)).alias("_yes")).where("_no AND _yes").select(*by, var)


def partition_errors(options: DataFrame) -> DataFrame:
    """Rows (option_name, error) for each rule that a partition of candidates breaks.

    Columns: option_name, candidates, representatives (arrays), aliases (map).
    """
    keys, goals = F.map_keys("aliases"), F.map_values("aliases")
    rules = {
        "representatives outside candidates": F.size(F.array_except("representatives", "candidates")) > 0,
        "candidates left out": F.size(F.array_except("candidates", F.array_union("representatives", keys))) > 0,
        "aliases outside candidates": F.size(F.array_except(keys, "candidates")) > 0,
        "alias and representative at once": F.size(F.array_intersect("representatives", keys)) > 0,
        "alias of no representative": F.size(F.array_except(goals, "representatives")) > 0,
        "yes is an alias of no, or no of yes": F.coalesce(F.get(F.transform(F.array("aliases"), lambda m: (m["yes"] == "no") | (m["no"] == "yes")), 0), F.lit(False)),
        "no representative": F.size("representatives") == 0,
    }
    return options.select("option_name", F.explode(F.array_compact(F.array(*[F.when(bad, name) for name, bad in rules.items()]))).alias("error"))


def type_hint(value: Column) -> Column:
    """The hint that a literal gives: Empty, Boolean, Integer, List or Literal."""
    from quern.functions import text

    return F.when(value == "", "Empty").when(text.is_boolean(value), "Boolean").when(text.is_numeric(value), "Integer").when(value.rlike(r"\s"), "List").otherwise("Literal")


def infer_types(hints: DataFrame, var: str, hint: str) -> DataFrame:
    """(var, type): a type only if all hints but Empty agree; a mixture, or nothing, is Literal."""
    agreed = F.collect_set(F.when(F.col(hint) != "Empty", F.col(hint)))
    return hints.groupBy(var).agg(agreed.alias("_h")).select(var, F.when(F.size("_h") == 1, F.element_at("_h", 1)).otherwise("Literal").alias("type"))


def propagate_types(types: DataFrame, edges: DataFrame, var: str, src: str, dst: str) -> DataFrame:
    """One pass to destinations, then one to sources: a Literal takes its neighbours' type if they have one alone.

    Both passes read the state before them, so the order of edges is nothing.
    """
    for here, there in ((dst, src), (src, dst)):
        known = types.where(F.col("type") != "Literal").select(F.col(var).alias(there), F.col("type").alias("_t"))
        one = edges.join(known, there).groupBy(F.col(here).alias(var)).agg(F.min("_t").alias("_a"), F.max("_t").alias("_b")).where("_a = _b").select(var, "_a")
        types = types.join(one, var, "left").select(var, F.when((F.col("type") == "Literal") & F.col("_a").isNotNull(), F.col("_a")).otherwise(F.col("type")).alias("type"))
    return types


def strongest(rows: DataFrame, by: Sequence[str], kind: str, order: str) -> DataFrame:
    """The type of highest priority of each key, the first in ``order`` among equals."""
    rank = F.lit(-1)
    for name, p in TYPE_PRIORITY.items():
        rank = F.when(F.col(kind) == name, p).otherwise(rank)
    return rows.groupBy(*by).agg(F.max_by(kind, F.struct(rank, -F.col(order))).alias(kind))


def policy(rows: DataFrame, key: str, maps: Sequence[DataFrame]) -> DataFrame:
    """``policy`` from the first of the maps (key, policy) that has the key."""
    for i, m in enumerate(maps):
        rows = rows.join(m.select(F.col("key").alias(key), F.col("policy").alias(f"_p{i}")), key, "left")
    return rows.withColumn("policy", F.coalesce(*[f"_p{i}" for i in range(len(maps))])).drop(*[f"_p{i}" for i in range(len(maps))])


def scope_types(scopes: DataFrame, types: DataFrame, own: DataFrame) -> DataFrame:
    """``type`` of each scope (script_id, var, idx): inferred for the scope alone (own: script_id, var, idx, type) or else for the variable."""
    rows = scopes.join(own.withColumnRenamed("type", "_own"), ["script_id", "var", "idx"], "left").join(types, ["script_id", "var"], "left")
    return rows.withColumn("type", F.coalesce("_own", "type", F.lit("Literal"))).select(*scopes.columns, "type")


def with_known_types(types: DataFrame, known: DataFrame) -> DataFrame:
    """(script_id, var, type) with the types of standard variables (known: var, type) in place of inferred ones."""
    return types.join(known.select("var", F.col("type").alias("_known")), "var", "left").select("script_id", "var", F.coalesce("_known", "type").alias("type"))
