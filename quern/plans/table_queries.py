"""Operators on the tables of scripts, applied to tables made of orders and their lines, with SQL that computes the same from these.

A customer is a script, an order a node at its top, a line a node within its
order; nodes are numbered in order as scripts' nodes are.  What they are and do
follows from their keys.  The SQL knows what stands in what from keys, where
the operators have numbers alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.operators import defuse, macros, options, projects, sequences, trees, values
from quern.plans import exports

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


_NODES = """
w AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY script_id ORDER BY node_id) - 1 AS exec_id, 'v' || k % 3 || 'v' || (k // 3) % 3 AS name, CASE WHEN k % 7 = 0 THEN 'Arch' ELSE 'Var' END AS atom_kind,
    CASE (k // 7) % 3 WHEN 0 THEN 'Eq' WHEN 1 THEN 'True' ELSE 'False' END AS cond_kind, CASE WHEN k % 11 = 0 THEN '$x' ELSE 'w' || k % 6 END AS operand, k % 5 = 0 AS negated
  FROM (
    SELECT o_custkey AS script_id, o_orderkey * 1000 AS node_id, NULL::BIGINT AS parent_id, o_orderkey AS k FROM orders
    UNION ALL SELECT o_custkey, l_orderkey * 1000 + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey), l_orderkey * 1000, l_partkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
), a AS (
  SELECT w.script_id, w.node_id, w.parent_id, w.k, 'v' || (w.k // 2) % 3 || 'v' || (w.k // 5) % 3 AS var, CASE w.k % 4 WHEN 0 THEN 'yes' WHEN 1 THEN 'no' WHEN 2 THEN 'lit' || w.k % 5 ELSE '' END AS value,
    p.name AS parent_name, p.atom_kind AS parent_kind, p.cond_kind AS parent_cond, p.k AS parent_k
  FROM w JOIN w p ON w.parent_id = p.node_id
), s AS (SELECT DISTINCT script_id FROM w), ov AS (SELECT script_id, 'v' || i AS option, 'v' || i || 'v0' AS var FROM s, (VALUES (0), (1), (2)) t(i)),
opt AS (SELECT script_id, 'v' || (k // 5) % 3 AS option, node_id FROM w WHERE parent_id IS NULL AND k % 5 = 0)"""


def nodes(spark, d) -> DataFrame:
    """script_id, node_id, parent_id, k, exec_id, exit_id, and what the guard of each asks."""
    o, lines = table(spark, d, "orders"), table(spark, d, "lineitem")
    trees.small_partitions(spark, o.count() + lines.count())
    size = lines.select(F.col("l_orderkey").alias("o_orderkey")).repartition("o_orderkey").groupBy("o_orderkey").count()  # nearly all keys of a file differ: combined before the shuffle they fill a task
    top = o.join(size, "o_orderkey", "left").select(F.col("o_custkey").alias("script_id"), (F.col("o_orderkey") * 1000).alias("node_id"), F.lit(None).cast("bigint").alias("parent_id"), F.col("o_orderkey").alias("k"), (F.coalesce("count", F.lit(0)) + 1).alias("size"))
    inner = lines.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("script_id"), (F.col("l_orderkey") * 1000 + F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_partkey"))).alias("node_id"), (F.col("l_orderkey") * 1000).alias("parent_id"), F.col("l_partkey").alias("k"), F.lit(1).cast("bigint").alias("size"))
    placed = sequences.number_rows(top.union(inner), ["script_id"], ["node_id"]).withColumn("exec_id", F.col("exec_id").cast("bigint") - 1)
    return placed.withColumn("exit_id", F.col("exec_id") + F.col("size"))


_TERM = {
    "name": "concat('v', k % 3, 'v', (k DIV 3) % 3)", "atom_kind": "CASE WHEN k % 7 = 0 THEN 'Arch' ELSE 'Var' END", "cond_kind": "CASE (k DIV 7) % 3 WHEN 0 THEN 'Eq' WHEN 1 THEN 'True' ELSE 'False' END",
    "operand": "CASE WHEN k % 11 = 0 THEN '$x' ELSE concat('w', k % 6) END", "negated": "k % 5 = 0", "guard": "0",
}


def terms(n: DataFrame) -> DataFrame:
    return n.select("script_id", "node_id", *[F.expr(x).alias(c) for c, x in _TERM.items()])


def assigned(n: DataFrame) -> DataFrame:
    """Assignments: the lines, under the guard of their order where that asks for truth."""
    above = terms(n).select(F.col("node_id").alias("parent_id"), "name", "atom_kind", "cond_kind")
    rows = n.where("parent_id IS NOT NULL").join(above, "parent_id")
    guard = F.when((F.col("atom_kind") == "Var") & (F.col("cond_kind") == "True"), F.array(F.concat(F.lit("Var "), "name", F.lit(" True")))).otherwise(F.array().cast("array<string>"))
    value = F.expr("CASE k % 4 WHEN 0 THEN 'yes' WHEN 1 THEN 'no' WHEN 2 THEN concat('lit', k % 5) ELSE '' END")
    return rows.select("script_id", "node_id", "exec_id", F.expr("concat('v', (k DIV 2) % 3, 'v', (k DIV 5) % 3)").alias("var"), value.alias("value"), guard.alias("guards"))


def declared(n: DataFrame) -> DataFrame:
    return n.where("parent_id IS NULL AND k % 5 = 0").select("script_id", F.expr("concat('v', (k DIV 5) % 3)").alias("option"), "node_id")


def option_vars(n: DataFrame) -> DataFrame:
    one = F.struct(F.concat(F.lit("v"), F.col("i")).alias("option"), F.concat(F.lit("v"), F.col("i"), F.lit("v0")).alias("var"))
    return n.select("script_id").distinct().withColumn("i", F.explode(F.array(*[F.lit(str(i)) for i in range(3)]))).select("script_id", one.alias("o")).select("script_id", "o.*")


@query(f"WITH {_NODES} SELECT w.script_id, w.node_id, CASE WHEN atom_kind = 'Var' AND ov.option IS NOT NULL THEN 'Arg' ELSE atom_kind END AS atom_kind, CASE WHEN atom_kind = 'Var' AND ov.option IS NOT NULL THEN ov.option ELSE name END AS name FROM w LEFT JOIN ov ON ov.script_id = w.script_id AND ov.var = w.name")
def argument_atoms(spark, d):
    n = nodes(spark, d)
    return options.as_arguments(terms(n), option_vars(n)).select("script_id", "node_id", "atom_kind", "name")


@query(f"WITH {_NODES} SELECT script_id, name, node_id FROM w WHERE atom_kind = 'Var' AND NOT EXISTS (SELECT 1 FROM w p WHERE p.node_id = w.parent_id AND p.atom_kind = 'Var' AND p.name = w.name)")
def outermost_blocks(spark, d):
    n = nodes(spark, d)
    return options.outermost_guarded(terms(n), n)


_CONTEXT = "step AS (SELECT DISTINCT script_id, parent_name AS var, var AS next FROM a WHERE parent_kind = 'Var'), ctx AS (SELECT script_id, option, var FROM ov UNION SELECT c.script_id, c.option, step.next FROM ctx c JOIN step ON step.script_id = c.script_id AND step.var = c.var AND contains(step.next, c.option))"


@query(f"WITH RECURSIVE {_NODES}, {_CONTEXT} SELECT script_id, option, var FROM ctx")
def contexts_of_options(spark, d):
    n = nodes(spark, d)
    return options.contexts(option_vars(n), terms(n), n, assigned(n))


@query(f"""WITH RECURSIVE {_NODES}, {_CONTEXT},
v AS (SELECT script_id, name AS var, CASE cond_kind WHEN 'Eq' THEN operand WHEN 'True' THEN 'yes' ELSE 'no' END AS value FROM w WHERE NOT negated AND atom_kind = 'Var' UNION SELECT script_id, var, value FROM a WHERE value <> '')
SELECT DISTINCT ctx.script_id, option, value FROM ctx JOIN v ON v.script_id = ctx.script_id AND v.var = ctx.var WHERE NOT starts_with(value, '$') UNION SELECT script_id, option, unnest(['yes', 'no']) FROM ov""")
def candidates_of_options(spark, d):
    n = nodes(spark, d)
    t, a = terms(n), assigned(n)
    return options.value_candidates(options.contexts(option_vars(n), t, n, a), t, a)


@query(f"WITH {_NODES} SELECT a.script_id, option, a.node_id FROM a JOIN ov ON ov.script_id = a.script_id AND ov.var = a.var WHERE value = 'no' AND parent_k % 5 <> 0")
def options_turned_off(spark, d):
    n = nodes(spark, d)
    return options.disabling(assigned(n), declared(n), option_vars(n), n)


@query(f"""WITH {_NODES} SELECT a.script_id, ov.option, a.node_id, o.option AS needed_by FROM a JOIN ov ON ov.script_id = a.script_id AND ov.var = a.var
LEFT JOIN ov o ON parent_kind = 'Var' AND parent_cond = 'True' AND o.script_id = a.script_id AND o.var = parent_name AND o.option <> ov.option WHERE value = 'yes' AND parent_k % 5 <> 0""")
def options_turned_on(spark, d):
    n = nodes(spark, d)
    return options.enabling(assigned(n), declared(n), option_vars(n), n)


@query(f"WITH {_NODES} SELECT w.script_id, w.node_id FROM w LEFT JOIN opt ON opt.node_id IN (w.node_id, w.parent_id) WHERE opt.node_id IS NULL")
def nodes_undeclared(spark, d):
    n = nodes(spark, d)
    return options.without_declarations(n, declared(n)).select("script_id", "node_id")


@query(f"WITH {_NODES} SELECT opt.script_id, opt.option, opt.node_id FROM opt WHERE EXISTS (SELECT 1 FROM ov JOIN w ON w.script_id = ov.script_id AND w.name = ov.var AND w.atom_kind = 'Var' WHERE ov.script_id = opt.script_id AND ov.option = opt.option)")
def options_asked_for(spark, d):
    n = nodes(spark, d)
    return options.used_options(declared(n), option_vars(n), terms(n))


@query(f"WITH {_NODES} SELECT opt.script_id, opt.option, opt.node_id, (SELECT string_agg(DISTINCT a.var, ',' ORDER BY a.var) FROM a WHERE a.parent_id = opt.node_id AND a.k % 3 > 0) AS vars FROM opt")
def variables_of_declarations(spark, d):
    """The variables that lines within a declaration set, by the declaration's name with its number."""
    n = nodes(spark, d)
    calls = declared(n).select("script_id", "node_id", F.lit("AC_ARG_WITH").alias("name"), F.array(F.struct(F.lit("Lit").alias("kind"), F.concat("option", F.lit("-"), F.col("node_id").cast("string")).alias("text"))).alias("args"))
    made = assigned(n).join(n.select("node_id", "k"), "node_id").select("script_id", "var", "exec_id", F.when(F.col("k") % 3 > 0, "def").otherwise("use").alias("event"))
    found = macros.build_options(calls, made, n)
    part = lambda k: F.split_part("option", F.lit("_"), F.lit(k))
    return found.select("script_id", part(1).alias("option"), part(2).cast("bigint").alias("node_id"), F.when(F.size("vars") > 0, F.array_join("vars", ",")).alias("vars"))


_EVENTS = f"{_NODES}, ev AS (SELECT script_id, node_id, exec_id, 'x' || k % 4 AS var, CASE (k // 4) % 3 WHEN 0 THEN 'def' WHEN 1 THEN 'use' ELSE 'bound' END AS event, CASE k % 5 WHEN 0 THEN [] WHEN 1 THEN ['p'] WHEN 2 THEN ['p', 'q'] WHEN 3 THEN ['r'] ELSE [] END AS g FROM w WHERE parent_id IS NOT NULL)"
_EDGES = """edge AS (
  SELECT script_id, var, def_node, use_node FROM (
    SELECT u.script_id, u.var, f.node_id AS def_node, u.node_id AS use_node, row_number() OVER (PARTITION BY u.node_id ORDER BY f.exec_id DESC) AS r
    FROM ev u JOIN ev f ON u.event = 'use' AND f.event <> 'use' AND f.script_id = u.script_id AND f.var = u.var AND f.exec_id < u.exec_id AND f.g = u.g[:len(f.g)]
  ) WHERE r = 1)"""


def var_events(n: DataFrame) -> DataFrame:
    guards = F.expr("CASE k % 5 WHEN 1 THEN array('p') WHEN 2 THEN array('p', 'q') WHEN 3 THEN array('r') ELSE array() END").cast("array<string>")
    event = F.expr("CASE (k DIV 4) % 3 WHEN 0 THEN 'def' WHEN 1 THEN 'use' ELSE 'bound' END")
    return n.where("parent_id IS NOT NULL").select("script_id", "node_id", "exec_id", F.lit(0).cast("bigint").alias("ord"), F.expr("concat('x', k % 4)").alias("var"), event.alias("event"), guards.alias("guards"))


def _edges(spark, d) -> DataFrame:
    n = nodes(spark, d)
    plain = n.select("script_id", "node_id", "parent_id", F.lit(None).cast("int").alias("branch"), "exit_id", F.lit("").alias("kind"), F.lit("").alias("text"), F.array().cast("array<string>").alias("guards"))
    return defuse.edges(var_events(n), plain)


@query(f"WITH {_EVENTS}, {_EDGES} SELECT script_id, var, def_node, use_node FROM edge")
def edges_of_lines(spark, d):
    return _edges(spark, d)


@query(f"WITH {_EVENTS}, {_EDGES} SELECT script_id, def_node, use_node, string_agg(var, ',' ORDER BY var) AS vars FROM edge GROUP BY 1, 2, 3")
def dependencies_of_lines(spark, d):
    return defuse.dependencies(_edges(spark, d)).select("script_id", "def_node", "use_node", F.array_join("vars", ",").alias("vars"))


@query(f"WITH {_EVENTS} SELECT DISTINCT script_id, var, node_id FROM ev")
def touched_nodes(spark, d):
    return options.touching(var_events(nodes(spark, d)))


@query(f"""WITH {_EVENTS}, arm AS (SELECT w.script_id, w.parent_id, w.node_id, (w.k // 8) % 2 AS branch, bool_or(w.k % 13 = 0) OVER (PARTITION BY w.parent_id, (w.k // 8) % 2) AS error FROM w WHERE parent_id IS NOT NULL)
SELECT arm.script_id, arm.parent_id AS node_id, var FROM arm JOIN ev ON ev.node_id = arm.node_id AND event <> 'use'
WHERE NOT error AND (SELECT count(DISTINCT branch) FROM arm b WHERE b.parent_id = arm.parent_id AND NOT b.error) > 1 GROUP BY 1, 2, 3 HAVING count(DISTINCT branch) = 2""")
def defined_on_all_paths(spark, d):
    n = nodes(spark, d)
    error = F.col("k") % 13 == 0
    arms = n.select("script_id", "node_id", "parent_id", F.when(F.col("parent_id").isNotNull(), F.expr("(k DIV 8) % 2")).alias("branch"), F.when(error, "Macro").otherwise("Simple").alias("kind"), F.when(error, "AC_MSG_ERROR").otherwise("").alias("text"))
    return macros.all_path_definitions(var_events(n), arms)


@query(f"WITH {_EVENTS} SELECT script_id, node_id, event FROM ev WHERE NOT EXISTS (SELECT 1 FROM opt WHERE opt.node_id = ev.node_id // 1000 * 1000)")
def events_of_kept_nodes(spark, d):
    """Events without those of nodes that go."""
    n = nodes(spark, d)
    gone = n.join(declared(n).select(F.col("node_id").alias("_top")), F.coalesce("parent_id", "node_id") == F.col("_top"), "left_semi").select("script_id", "node_id")
    return trees.without_nodes({"e": var_events(n)}, gone, {"e": ["node_id"]})["e"].select("script_id", "node_id", "event")


@query("""
WITH s AS (SELECT o_custkey AS script_id, 'x' || l_linenumber % 3 AS var, (l_partkey % 4)::INT AS idx, l_returnflag AS f FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
own AS (SELECT script_id, var, idx, min(f) AS f FROM s GROUP BY 1, 2, 3 HAVING count(DISTINCT f) = 1), var AS (SELECT script_id, var, max(f) AS f FROM s WHERE var <> 'x1' GROUP BY 1, 2)
SELECT DISTINCT s.script_id, s.var, s.idx, coalesce(own.f, var.f, 'Literal') AS type FROM s LEFT JOIN own USING (script_id, var, idx) LEFT JOIN var ON var.script_id = s.script_id AND var.var = s.var""")
def types_of_scopes(spark, d):
    rows = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("script_id"), F.concat(F.lit("x"), F.col("l_linenumber") % 3).alias("var"), (F.col("l_partkey") % 4).cast("int").alias("idx"), F.col("l_returnflag").alias("f"))
    own = rows.groupBy("script_id", "var", "idx").agg(F.min("f").alias("type"), F.max("f").alias("_m")).where("type = _m").drop("_m")
    return values.scope_types(rows.select("script_id", "var", "idx").distinct(), rows.where("var <> 'x1'").groupBy("script_id", "var").agg(F.max("f").alias("type")), own)


# macro calls, made of orders

_CALL_NAMES = ["AC_INIT", "AC_CONFIG_HEADERS", "AC_CONFIG_FILES", "AC_CONFIG_LINKS", "AC_DEFINE", "AH_TEMPLATE", "AC_CHECK_HEADERS", "AM_CONDITIONAL", "PKG_CHECK_MODULES", "AC_PREREQ", "AC_MSG_RESULT", "AC_ARG_VAR"]
_CALLS = f"c AS (SELECT o_custkey AS s, o_orderkey AS k, ([{', '.join(map(repr, _CALL_NAMES))}])[o_orderkey % 12 + 1] AS name, o_orderkey // 12 AS n FROM orders)"


def calls(spark, d) -> DataFrame:
    """m4_call of orders: the macro and its arguments follow from the key."""
    a = {
        "AC_INIT": ["concat('Pack-', n % 3)", "concat('v1.', n % 4)", "CASE WHEN n % 2 = 0 THEN 'bug@x' END"], "AC_CONFIG_HEADERS": ["concat('h', n, '.h a/b.h:c.in')"], "AC_CONFIG_FILES": ["concat('Makefile sub', n, '/Makefile x.pc')"],
        "AC_CONFIG_LINKS": ["concat('t', n, ':s', n % 5, ' plain')"], "AC_DEFINE": ["CASE WHEN n % 3 = 0 THEN concat('$x', n) ELSE concat('D_', n % 9) END", "string(n % 2)"], "AH_TEMPLATE": ["concat('T_', n % 9)"], "AC_CHECK_HEADERS": ["concat('a', n % 3, '/b.h, c', n % 4, '.h')"],
        "AM_CONDITIONAL": ["concat('C', n % 5)", "concat('test ', n)"], "PKG_CHECK_MODULES": ["concat('P', n % 5)", "concat('glib-', n % 2, ' >= 2.', n % 7, ' gtk+')"], "AC_PREREQ": ["'2.69'"], "AC_MSG_RESULT": ["'yes'"], "AC_ARG_VAR": ["concat('V', n)"],
    }
    rows = table(spark, d, "orders").selectExpr("o_custkey AS script_id", "o_orderkey AS node_id", "o_orderkey AS exec_id", "o_orderkey DIV 12 AS n", f"element_at(array({', '.join(map(repr, _CALL_NAMES))}), int(o_orderkey % 12) + 1) AS name")
    args = F.expr("CASE name " + " ".join(f"WHEN '{m}' THEN array({', '.join(f'named_struct({chr(39)}kind{chr(39)}, {chr(39)}Lit{chr(39)}, {chr(39)}text{chr(39)}, {x})' for x in xs)})" for m, xs in a.items()) + " END")
    return rows.select("script_id", "node_id", "exec_id", "name", args.alias("args"), F.array().cast("array<string>").alias("guards"))


@query(f"WITH {_CALLS} SELECT s AS script_id, k AS node_id FROM c WHERE name NOT IN ('AC_PREREQ', 'AC_MSG_RESULT', 'AC_ARG_VAR')")
def calls_with_effects(spark, d):
    return options.without_argument_declarations(macros.relevant(calls(spark, d))).select("script_id", "node_id")


@query(f"""WITH {_CALLS} SELECT s AS script_id, 'header' AS role, unnest(['h' || n || '.h', 'a/b.h']) AS target, unnest(['h' || n || '.h.in', 'c.in']) AS source FROM c WHERE name = 'AC_CONFIG_HEADERS'
UNION ALL SELECT s, 'file', unnest(['Makefile', 'sub' || n || '/Makefile', 'x.pc']), unnest(['Makefile.am', 'sub' || n || '/Makefile.am', 'x.pc.in']) FROM c WHERE name = 'AC_CONFIG_FILES'""")
def configured_files(spark, d):
    return macros.config_files(calls(spark, d))


@query(f"WITH {_CALLS} SELECT s AS script_id, 't' || n AS target, 's' || n % 5 AS source FROM c WHERE name = 'AC_CONFIG_LINKS'")
def configured_links(spark, d):
    return macros.config_links(calls(spark, d))


@query(f"WITH {_CALLS} SELECT s AS script_id, 'pack-' || arg_max(n % 3, k) AS name, '1.' || arg_max(n % 4, k) AS version, CASE WHEN bool_or(n % 2 = 0) THEN 'bug@x' END AS bug_report FROM c WHERE name = 'AC_INIT' GROUP BY 1")
def package_metadata(spark, d):
    return macros.metadata(calls(spark, d)).select("script_id", "name", "version", "bug_report")


@query(f"""WITH {_CALLS} SELECT DISTINCT * FROM (SELECT s AS script_id, 'D_' || n % 9 AS symbol, (n % 2)::VARCHAR AS value FROM c WHERE name = 'AC_DEFINE' AND n % 3 > 0 UNION ALL SELECT s, 'T_' || n % 9, NULL FROM c WHERE name = 'AH_TEMPLATE'
UNION ALL SELECT s, unnest(['HAVE_A' || n % 3 || '_B_H', 'HAVE_C' || n % 4 || '_H']), '1' FROM c WHERE name = 'AC_CHECK_HEADERS')""")
def symbols_of_calls(spark, d):
    return macros.cpp_symbols(calls(spark, d))


@query(f"WITH {_CALLS} SELECT s AS script_id, 'C' || n % 5 AS condition, 'test ' || n AS test FROM c WHERE name = 'AM_CONDITIONAL'")
def conditions_of_calls(spark, d):
    return macros.conditionals(calls(spark, d)).select("script_id", "condition", "test")


@query(f"WITH {_CALLS} SELECT s AS script_id, 'P' || n % 5 AS prefix, unnest(['glib-' || n % 2, 'gtk+']) AS package, unnest(['>=', NULL]) AS op, unnest(['2.' || n % 7, NULL]) AS version FROM c WHERE name = 'PKG_CHECK_MODULES'")
def packages_of_calls(spark, d):
    return macros.packages(calls(spark, d))


@query("SELECT DISTINCT o_custkey AS script_id, 'gen/f' || o_orderkey % 50 AS path FROM orders o WHERE o_orderkey % 3 > 0 AND NOT EXISTS (SELECT 1 FROM orders r WHERE r.o_custkey = o.o_custkey AND r.o_orderkey % 3 = 0 AND r.o_orderkey % 50 = o.o_orderkey % 50)")
def files_left(spark, d):
    """What a script writes and doesn't remove, in different spellings."""
    o = table(spark, d, "orders")
    spelled = lambda how: F.concat(F.lit(how), (F.col("o_orderkey") % 50).cast("string")).alias("path")
    return projects.generated_files(o.where("o_orderkey % 3 > 0").select(F.col("o_custkey").alias("script_id"), spelled("./gen/x/../f")), o.where("o_orderkey % 3 = 0").select(F.col("o_custkey").alias("script_id"), spelled("gen/./f")))


@query("""
WITH r AS (SELECT l_orderkey % 100 AS script_id, l_orderkey AS chunk, 'x' || l_linenumber AS var, bool_or(l_returnflag <> 'N') AS arg, bool_or(l_returnflag = 'N') AS ret, CASE l_linenumber % 3 WHEN 0 THEN 'bool' WHEN 1 THEN 'usize' ELSE 'String' END AS kind, CASE l_linenumber % 3 WHEN 0 THEN 'false' WHEN 1 THEN '0' ELSE 'String::new()' END AS none FROM lineitem GROUP BY 1, 2, 3, 6, 7)
SELECT script_id, chunk, 'fn func' || chunk || '(' || coalesce(string_agg(var || ': ' || CASE WHEN ret THEN '&mut ' ELSE '&' END || kind, ', ' ORDER BY var) FILTER (arg), '') || ')' || coalesce(' -> (' || string_agg(kind, ', ' ORDER BY var) FILTER (NOT arg) || ')', '') AS signature,
  coalesce(string_agg('let mut ' || var || ': ' || kind || ' = ' || none || ';', chr(10) ORDER BY var) FILTER (NOT arg), '') AS header, coalesce('(' || string_agg(var, ', ' ORDER BY var) FILTER (NOT arg) || ')', '') AS footer FROM r GROUP BY 1, 2""")
def skeletons_of_orders(spark, d):
    """Functions whose parameters are lines that came back, and whose results are the others."""
    rows = table(spark, d, "lineitem").select((F.col("l_orderkey") % 100).alias("script_id"), F.col("l_orderkey").alias("chunk"), F.concat(F.lit("x"), "l_linenumber").alias("var"), F.when(F.col("l_returnflag") == "N", "return").otherwise("arg").alias("role"), "l_linenumber")
    types = rows.select("script_id", "var", F.when(F.col("l_linenumber") % 3 == 0, "Boolean").when(F.col("l_linenumber") % 3 == 1, "Integer").otherwise("Literal").alias("type")).distinct()
    return exports.skeletons(rows.drop("l_linenumber"), types)
