"""Dictionaries that dynamic names become: keys, types, and the Rust of reads and writes, as Column expressions.

keys: array<struct<kind, text>>, kind Literal or Var.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import text


def key_text(key: Column) -> Column:
    """A literal in quotes, a variable by its name."""
    return F.when(key["kind"] == "Literal", F.concat(F.lit('"'), text.escape_rust(key["text"]), F.lit('"'))).otherwise(key["text"])


def with_omitted(keys: Column, size: Column) -> Column:
    """As many keys as the dictionary has parts: what is left out is an empty literal."""
    empty = F.struct(F.lit("Literal").alias("kind"), F.lit("").alias("text"))
    return F.concat(keys, F.array_repeat(empty, F.greatest(size - F.size(keys), F.lit(0))))


def type_text(size: Column, value: Column) -> Column:
    """A map from one text, or a tuple of several, to the value's type."""
    names = F.array_join(F.array_repeat(F.lit("String"), size), ", ")
    return F.concat(F.lit("HashMap<"), F.when(size == 1, names).otherwise(F.concat(F.lit("("), names, F.lit(")"))), F.lit(", "), value, F.lit(">"))


def _tuple(keys: Column) -> Column:
    owned = F.array_join(F.transform(keys, lambda k: F.concat(key_text(k), F.when(k["kind"] == "Literal", ".to_string()").otherwise(".clone()"))), ", ")
    return F.when(F.size(keys) == 1, owned).otherwise(F.concat(F.lit("("), owned, F.lit(")")))


def read(name: Column, keys: Column) -> Column:
    return F.concat(name, F.lit(".get(&"), _tuple(keys), F.lit(").cloned().unwrap_or_default()"))


def write(name: Column, keys: Column, value: Column, append: Column, kind: Column) -> Column:
    """An insertion; what is appended goes to the entry, by its type."""
    entry = F.concat(name, F.lit(".entry("), _tuple(keys), F.lit(").or_default()"))
    more = F.when(kind.startswith("List"), F.concat(entry, F.lit(".extend("), value, F.lit(");"))).when(kind == "Integer", F.concat(F.lit("*"), entry, F.lit(" += "), value, F.lit(";"))).otherwise(F.concat(entry, F.lit(".push_str(&"), value, F.lit(");")))
    return F.when(append, more).otherwise(F.concat(name, F.lit(".insert("), _tuple(keys), F.lit(", "), value, F.lit(");")))


def access_types(accesses: DataFrame, types: DataFrame) -> DataFrame:
    """``type`` of each access: that of its raw name, else of the variable it is assigned to, else Literal."""
    one = lambda k: types.select("script_id", F.col("var").alias(k), F.col("type").alias(f"_{k}"))
    rows = accesses.join(one("raw_name"), ["script_id", "raw_name"], "left").join(one("assigned_to"), ["script_id", "assigned_to"], "left")
    return rows.withColumn("type", F.coalesce("_raw_name", "_assigned_to", F.lit("Literal"))).select(*accesses.columns, "type")


def value_parts(fragments: Column) -> Column:
    """Parts of an assigned value: Lit, Var, or null if a part comes from a command.  fragments: array<struct<kind, text>>."""
    parts = F.transform(fragments, lambda f: F.struct(F.when(f["kind"] == "lit", "Lit").otherwise("Var").alias("kind"), f["text"].alias("text")))
    return F.when(F.forall(fragments, lambda f: f["kind"].isin("lit", "var")), parts)


def assigned_values(accesses: DataFrame, assigned: DataFrame) -> DataFrame:
    """``value`` of the plain assignment at the place of an access, null for another command."""
    own = assigned.select("script_id", "node_id", F.col("value").alias("assigned_value"))
    return accesses.join(own, ["script_id", "node_id"], "left")
