"""Sets of values that names can have: products that remember where pieces come from, and fixpoints over definitions.

A product is folded over its positions by joins, one for each position, so what
is multiplied stays in tables; the number of joins is the number of positions
of the longest product.  Keys join by equality: rows with null keys take no
part.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.operators import graphs
from quern.operators.sequences import common_prefix
from quern.operators.trees import cut


def _positions(rows: DataFrame, by: Sequence[str], pos: str) -> tuple[DataFrame, int]:
    """Rows with ``_at``: positions numbered from 0 within their key, whatever they are; and how many there are at most."""
    held = cut(rows.withColumn("_at", F.dense_rank().over(Window.partitionBy(*by).orderBy(pos)) - 1))
    return held, (held.groupBy().agg(F.max("_at")).first()[0] or 0) + 1


def guarded_product(rows: DataFrame, by: Sequence[str], pos: str, value: str, conds: str) -> DataFrame:
    """(by, value, conds): each text put together from one value for each position, with the conditions that all its pieces begin with.

    ``conds`` is an array.  The conditions of a product are the longest common
    prefix of its pieces' conditions, so products of products can be given as
    one, with positions such as arrays that sort in text order.  Equal results
    count once; null values are no values, null conditions none.
    """
    held, n = _positions(rows.where(F.col(value).isNotNull()).select(*by, F.col(pos).alias("_pos"), F.col(value).alias("_v"), F.coalesce(conds, F.array().cast("array<string>")).alias("_c")), by, "_pos")
    size = held.groupBy(*by).agg(F.max("_at").alias("_last"))
    out = held.where("_at = 0").select(*by, F.col("_v").alias("value"), F.col("_c").alias("conds"), F.lit(0).alias("_k")).distinct()
    for k in range(1, n):
        piece = held.where(F.col("_at") == k).select(*by, "_v", "_c").distinct()
        grown = out.where(F.col("_k") == k - 1).join(piece, list(by)).select(*by, F.concat("value", "_v").alias("value"), common_prefix(F.col("conds"), F.col("_c")).alias("conds"), F.lit(k).alias("_k"))
        out = cut(out.join(size, list(by)).where(F.col("_k") == F.col("_last")).select(*out.columns).union(grown).distinct())
    return out.drop("_k")


def divisions(identifiers: DataFrame, values: DataFrame, known: DataFrame, by: Sequence[str], eval_id: str) -> DataFrame:
    """(by, eval_id, name, mapping): the names that an evaluated identifier can have, and which variable gave which piece.

    identifiers: by, eval_id, at, parts (array<struct<kind, text>>, kind ``lit``
    or ``var``); values: by, eval_id, var, value; known: by, name, at, role
    (``def`` or ``use``).  A name is kept if it is defined strictly before the
    evaluation or used anywhere.  Names grow piece by piece, and a beginning
    that no such name has is dropped at once, so what doesn't reach is never
    multiplied.  mapping: (var, piece) by position; literals have none.
    """
    keys = [*by, eval_id]
    parts = identifiers.select(*keys, F.posexplode("parts").alias("_p", "_part"))
    longest = identifiers.groupBy().agg(F.max(F.size("parts"))).first()[0] or 0
    options = values.select(*keys, F.col("var").alias("_var"), F.col("value").alias("_piece")).distinct()
    lit = parts.where("_part.kind = 'lit'").select(*keys, "_p", F.lit(None).cast("string").alias("_var"), F.col("_part.text").alias("_piece"))
    var = parts.where("_part.kind = 'var'").select(*keys, "_p", F.col("_part.text").alias("_var")).join(options, [*keys, "_var"]).select(*keys, "_p", "_var", "_piece")
    pieces = cut(lit.union(var).where("_piece IS NOT NULL"))
    ends = identifiers.select(*keys, "at", F.size("parts").alias("_n"))
    first = known.groupBy(*by, "name").agg(F.min(F.when(F.col("role") == "def", F.col("at"))).alias("_def"), F.max((F.col("role") == "use").cast("int")).alias("_used"))
    reach = ends.join(first, list(by)).where("_used = 1 OR _def < at").select(*keys, "_n", "name")
    begun = cut(reach.select(*keys, "_n", F.explode(F.transform(F.sequence(F.lit(0), F.length("name")), lambda k: F.substring("name", F.lit(1), k))).alias("name")).distinct())
    mapped = F.array().cast("array<struct<var:string,piece:string>>")
    out = ends.select(*keys, F.lit("").alias("name"), mapped.alias("mapping"), F.lit(0).alias("_p"))
    done = out.limit(0)
    for k in range(longest):
        grown = out.join(pieces.where(F.col("_p") == k).drop("_p"), keys)
        own = F.array(F.struct(F.col("_var").alias("var"), F.col("_piece").alias("piece")))
        grown = grown.select(*keys, F.concat("name", "_piece").alias("name"), F.when(F.col("_var").isNull(), F.col("mapping")).otherwise(F.concat("mapping", own)).alias("mapping"), F.lit(k + 1).alias("_p"))
        out = cut(grown.join(begun.drop("_n"), [*keys, "name"], "left_semi").select(*out.columns))
        done = done.union(out.join(reach.where(F.col("_n") == k + 1).drop("_n"), [*keys, "name"], "left_semi").select(*out.columns))
    return done.select(*keys, "name", "mapping").distinct()


def _on_cycles(edges: DataFrame, by: Sequence[str]) -> DataFrame | None:
    """(by, src, dst): the edges that may lie on a cycle, none if there is no cycle.

    Edges that nothing leads to, or that lead nowhere, are cut off round by
    round as long as a quarter goes at least, so all rounds together read a few
    times as much as there is.
    """
    keys, left, size = list(by), cut(edges), None
    while True:
        n = left.count()
        if n == 0:
            return None
        if size is not None and 4 * n > 3 * size:
            return left
        size = n
        ends, begins = (left.select(*keys, F.col(a).alias(b)).distinct() for a, b in (("src", "dst"), ("dst", "src")))
        left = cut(left.join(ends, [*keys, "dst"], "left_semi").join(begins, [*keys, "src"], "left_semi"))


def value_sets(parts: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, var, value): all texts that a variable can hold by any of its definitions, over all keys at once.

    parts: by, var, def_id, pos, kind (``lit`` or ``ref``), text: a definition
    puts its parts together; a ref stands for each value of that variable.  A
    round takes what is new of the last one only: a definition with one ref,
    such as a copy, hands it on between its literals, those with several are
    multiplied anew and keep what has a new piece.  Variables may be defined by
    each other: values go round by copies, and a concatenation with a variable
    that its own depends on, which would never end, gives nothing.  Nor does
    one with a variable without values.
    """
    keys = list(by)
    name = lambda c: F.struct(*keys, F.col(c).alias("var"))
    there = F.lit(True)
    for k in [*keys, "def_id"]:
        there = there & F.col(k).isNotNull()
    own = F.array_sort(F.collect_list(F.struct("pos", "kind", "text")))
    defs = parts.where(there).groupBy(*keys, "var", "def_id").agg(own.alias("_parts"))
    refs = F.transform(F.filter("_parts", lambda x: x["kind"] == "ref"), lambda x: x["text"])
    defs = cut(defs.withColumns({"_n": F.size("_parts"), "_refs": refs}))
    edges = defs.select(*keys, F.col("var").alias("src"), F.explode("_refs").alias("dst")).where("src IS NOT NULL AND dst IS NOT NULL").distinct()
    around = _on_cycles(edges, keys)
    if around is not None:  # src depends on dst
        around = graphs.closure(around.select(name("src").alias("src"), name("dst").alias("dst"))).select(F.col("src").alias("_to"), F.col("dst").alias("_from"))
        long = defs.where("_n > 1").select(*keys, "var", "def_id", F.explode("_refs").alias("text"))
        endless = long.join(around, (name("text") == F.col("_to")) & (name("var") == F.col("_from"))).select(*keys, "def_id").distinct()
        defs = cut(defs.join(endless, [*keys, "def_id"], "left_anti"))
    whole = F.array_join(F.transform("_parts", lambda x: x["text"]), "")
    delta = cut(defs.where("size(_refs) = 0").select(*keys, "var", whole.alias("value")).distinct())
    at = F.array_position(F.transform("_parts", lambda x: x["kind"]), "ref").cast("int")
    joined = lambda xs: F.aggregate(xs, F.lit(""), lambda acc, x: F.concat(acc, x["text"]))
    before, after = joined(F.slice("_parts", 1, at - 1)), joined(F.slice("_parts", at + 1, F.size("_parts")))
    links = cut(defs.where("size(_refs) = 1").select(*keys, "var", F.get("_refs", 0).alias("text"), before.alias("_before"), after.alias("_after")).distinct())
    products = cut(defs.where("size(_refs) > 1").select(*keys, "var", "def_id", "_n", F.posexplode("_parts").alias("_at", "_part")).select(*keys, "var", "def_id", "_n", "_at", "_part.kind", "_part.text"))
    longest = products.groupBy().agg(F.max("_n")).first()[0] or 0
    found = [delta]
    while not delta.isEmpty():
        known = reduce(DataFrame.union, found)
        fresh = delta.select(*keys, F.col("var").alias("text"), "value")
        made = links.join(fresh, [*keys, "text"]).select(*keys, "var", F.concat("_before", "value", "_after").alias("value"))
        if longest:
            touched = products.where("kind = 'ref'").join(fresh.select(*keys, "text").distinct(), [*keys, "text"], "left_semi").select(*keys, "def_id").distinct()
            open_ = products.join(touched, [*keys, "def_id"], "left_semi")
            new = known.withColumn("_new", F.lit(0)).join(delta, [*keys, "var", "value"], "left_anti").select(*keys, "var", "value", "_new").union(delta.withColumn("_new", F.lit(1)))
            pieces = open_.where("kind = 'lit'").select(*keys, "var", "def_id", "_at", "_n", F.col("text").alias("value"), F.lit(0).alias("_new"))
            pieces = cut(pieces.union(open_.where("kind = 'ref'").join(new.select(*keys, F.col("var").alias("text"), "value", "_new"), [*keys, "text"]).select(*keys, "var", "def_id", "_at", "_n", "value", "_new")))
            put = pieces.where("_at = 0").drop("_at")
            for k in range(1, longest):
                piece = pieces.where(F.col("_at") == k).select(*keys, "def_id", F.col("value").alias("_v"), F.col("_new").alias("_w"))
                put = put.join(piece, [*keys, "def_id"]).select(*keys, "var", "def_id", "_n", F.concat("value", "_v").alias("value"), F.greatest("_new", "_w").alias("_new"))
                made = made.union(put.where((F.col("_n") == k + 1) & (F.col("_new") == 1)).select(*keys, "var", "value"))
        delta = cut(made.distinct().join(known, [*keys, "var", "value"], "left_anti"))
        found.append(delta)
    return reduce(DataFrame.union, found)
