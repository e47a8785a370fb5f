"""Queries that run the script operators over scripts of several kinds, each written for every nation.

A case is a script with a name and a number (its key and 40) of the nation in it.  What a query
returns for a case is held in ``EXPECTED``, with the same name and number: rows
that the operators gave once and that were read through against the scripts.
The SQL puts the nations into them, so it guards against change and is no
second computation.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from quern.operators import codegen, defuse, guards, macros, options, projects, rendering, rewriting, rust, trees, values
from quern.operators.analysis import Script, Visitor, infer, path_parts, paths_of
from quern.plans import exports, runtime
from quern.plans.case_expected import EXPECTED
from quern.sources import platforms, tables
from quern.sources.shell import literal

CASES = {
    "branches": """p_{name}={num}
if test "x$with_{name}" = xyes && test -n "$CC"; then
  LIBS="$LIBS -l{name}"
elif test $level -ge 3; then
  LIBS=none
else
  AC_MSG_ERROR([no {name}])
fi
if test -n "${EXTRA+set}"; then
  EXTRA=no
fi
""",
    "loops": """case $host in
  i?86-*-linux*) os=linux ;;
  *) os=other ;;
esac
for f in a {name}; do
  eval "have_$f=$os"
  eval "v=\\$have_$f"
done
case $v in
  yes) w=1 ;;
  no|off) w=0 ;;
  *) w=$v ;;
esac
""",
    "commands": """n=$(( {num} * 2 + count ))
echo start
echo $n > out_{name}.txt
cat in.txt | grep $n > log.txt
rm -f log.txt tmp
test -f $n || exit 1
while test $n -lt 9; do
  n=$((n > 3 ? n : count))
  break
done
""",
    "macros": """AC_INIT([{name}], [1.{num}.0])
AC_PREREQ([2.69])
AM_CONDITIONAL([BIG_{num}], [test $n -gt 1])
AC_CONFIG_LINKS([a.h:src/a{num}.h])
AC_CHECK_HEADERS([stdio.h {name}.h])
AC_CHECK_LIB([z], [deflate])
AC_DEFINE([HAVE_{name}], [{num}], [doc])
AC_DEFINE_UNQUOTED([V], ["a$b"])
AC_ARG_VAR([CC], [compiler])
AC_CHECK_SIZEOF([long])
AC_MSG_NOTICE([done])
""",
    "options": """AC_ARG_ENABLE([{name}], [help], [use=$enableval], [use=no])
AC_ARG_WITH([dep], [help], [with_dep=$withval], [with_dep=yes])
if test "$use" = yes; then
  {name}_extra=1
  with_dep=yes
fi
case $use in
  yes) mode=on ;;
  fast) mode=quick ;;
  *) mode=$use ;;
esac
with_dep=no
""",
    "paths": """d=src/./{name}
for s in a b/..; do
  cp -r $d/$s /opt/$d/
done
if test "$d-$s" = "src-{num}"; then
  mv - out/{name}.o
fi
""",
    "order": """echo $CC
x={num}
echo done
y=$x
z=unused{num}
x=2
echo $y
for i in 1 2; do
  p=$i
done
echo $x $p
AC_SUBST([y])
""",
}
_NAME = "regexp_replace(lower(n_name), '[^a-z]', '_', 'g')"


def scripts(spark: SparkSession, d: str, *cases: str) -> DataFrame:
    """(script_id, text): the cases for each nation, ``<nation>/<case>``."""
    nations = spark.read.parquet(f"{d}/nation.parquet").select("n_nationkey", (F.col("n_nationkey") + 40).cast("string").alias("num"), F.regexp_replace(F.lower("n_name"), "[^a-z]", "_").alias("name"))
    texts = F.explode(F.array(*[F.struct(F.lit(c).alias("case"), F.lit(CASES[c]).alias("text")) for c in cases])).alias("c")
    text = F.replace(F.replace(F.col("c.text"), F.lit("{name}"), F.col("name")), F.lit("{num}"), F.col("num"))
    return nations.select("*", texts).select(F.concat("n_nationkey", F.lit("/"), "c.case").alias("script_id"), text.alias("text"))


def per_script(rows: DataFrame, made: Callable[[Script], Iterator[tuple]], schema: str) -> DataFrame:
    """Rows that a function makes of each parsed script, after its script_id."""
    kind = f"script_id string, {schema}"
    arrow = to_arrow_schema(rows.sparkSession.createDataFrame([], kind).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(i, *r) for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for r in made(Script(text))]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], f.type) for k, f in enumerate(arrow)], schema=arrow)

    return rows.select("script_id", "text").mapInArrow(run, kind)


QUERIES: dict[str, tuple[tuple[str, ...], Callable]] = {}


def query(*cases: str):
    def add(f):
        QUERIES[f.__name__] = (cases, f)
        return f

    return add


def _table(rows: DataFrame, name: str) -> DataFrame:
    return tables.parse_table(rows, name, 1)


@query("loops", "commands")
def case_nodes(rows):
    own = _table(rows, "node")
    return own.select("script_id", "node_id", "parent_id", "branch", "kind", "line", "exit_id")


@query("branches", "loops", "commands")
def case_rendered(rows):
    return _table(rows, "node").where("parent_id IS NULL").select("script_id", "node_id", "source")


@query("branches", "loops")
def case_guards(rows):
    return _table(rows, "node").where("size(guards) > 0").select("script_id", "node_id", F.array_join("guards", "; ").alias("guards"), "error_out")


@query("branches", "loops", "options")
def case_guard_terms(rows):
    return _table(rows, "guard_term").where("op = 'atom'").select("script_id", "node_id", "guard", "negated", "atom_kind", "name", "cond_kind", "operand")


@query("branches", "loops", "order")
def case_events(rows):
    return _table(rows, "var_event").select("script_id", "node_id", "ord", "event", "var")


@query("commands")
def case_fragments(rows):
    return _table(rows, "fragment").where("node_id < 8").select("script_id", "node_id", "word", "pos", "kind", "text")


@query("commands")
def case_arithmetic(rows):
    return _table(rows, "arith").select("script_id", "node_id", "pos", "kind", "text")


@query("branches", "loops", "commands")
def case_type_hints(rows):
    return _table(rows, "type_hint").distinct().select("script_id", "var", "hint", "arg")


@query("branches", "loops", "commands", "order")
def case_types(rows):
    return per_script(rows, lambda s: sorted(infer(list(s.hints())).items()), "var string, type string")


@query("branches", "loops", "order")
def case_def_use(rows):
    return defuse.edges(_table(rows, "var_event"), _table(rows, "node"))


@query("branches", "order")
def case_dependencies(rows):
    return defuse.dependencies(case_def_use(rows)).select("script_id", "def_node", "use_node", F.array_join("vars", ",").alias("vars"))


@query("order", "branches")
def case_chunks(rows):
    return _table(rows, "chunk").select("script_id", "chunk", "node_id", "first_line", "last_line")


@query("order")
def case_chunk_io(rows):
    return _table(rows, "chunk_io").select("script_id", "chunk", "var", "role")


@query("order")
def case_scopes(rows):
    text = lambda c: F.array_join(F.col(c).cast("array<string>"), ",").alias(c)
    return _table(rows, "scope").select("script_id", "var", "idx", "owner", "bound_by", text("readers"), text("writers"), text("overwriters"))


@query("order")
def case_multi_scopes(rows):
    """Variables with several scopes, whose types are inferred again for each."""
    return _table(rows, "scope").groupBy("script_id", "var").agg(F.count("*").alias("n")).where("n > 1")


@query("order")
def case_skeletons(rows):
    return exports.skeletons(_table(rows, "chunk_io"), case_types(rows)).where("chunk IN (3, 4)").select("script_id", "chunk", "signature", "header", "footer")


@query("order")
def case_unused(rows):
    return _table(rows, "unused").select("script_id", "node_id", "var")


@query("commands", "macros")
def case_quiet(rows):
    """Top nodes without messages to the user and macros without an effect."""
    return _table(rows, "kept").where("pos < 4").select("script_id", "pos", "source")


@query("commands")
def case_written(rows):
    return _table(rows, "file").select("script_id", "role", "path")


@query("commands")
def case_generated(rows):
    files = _table(rows, "file")
    return projects.generated_files(files.where("role = 'written'"), files.where("role = 'removed'"))


@query("branches", "loops", "commands", "macros")
def case_rust(rows):
    return _table(rows, "rust").select("script_id", "node_id", "code")


@query("macros")
def case_relevant_macros(rows):
    return options.without_argument_declarations(macros.relevant(_table(rows, "m4_call"))).select("script_id", "name")


@query("macros")
def case_conditionals(rows):
    return macros.conditionals(_table(rows, "m4_call")).select("script_id", "condition", "test")


@query("macros")
def case_links(rows):
    return macros.config_links(_table(rows, "m4_call"))


@query("macros")
def case_banned(rows):
    return per_script(rows, lambda s: [(x,) for x in sorted(codegen.banned_names(s.top))], "name string")


def _options(rows):
    calls, nodes, events = _table(rows, "m4_call"), _table(rows, "node"), _table(rows, "var_event")
    declared = calls.where("name IN ('AC_ARG_WITH', 'AC_ARG_ENABLE')").select("script_id", "node_id", F.regexp_replace(F.get("args", 0)["text"], "[^A-Za-z0-9_]", "_").alias("option"))
    return nodes, declared, options.argument_variables(macros.build_options(calls, events, nodes))


@query("options")
def case_option_variables(rows):
    return _options(rows)[2]


@query("options")
def case_option_guards(rows):
    return options.as_arguments(_table(rows, "guard_term"), _options(rows)[2]).where("atom_kind = 'Arg'").select("script_id", "node_id", "guard", "name", "cond_kind")


@query("options")
def case_option_contexts(rows):
    nodes, _, own = _options(rows)
    return options.contexts(own, _table(rows, "guard_term"), nodes, _table(rows, "assignment"))


@query("options")
def case_option_candidates(rows):
    return options.value_candidates(_options(rows)[2], _table(rows, "guard_term"), _table(rows, "assignment"))


@query("options")
def case_option_disabling(rows):
    nodes, declared, own = _options(rows)
    return options.disabling(_table(rows, "assignment"), declared, own, nodes)


@query("options")
def case_option_enabling(rows):
    nodes, declared, own = _options(rows)
    return options.enabling(_table(rows, "assignment"), declared, own, nodes)


@query("options")
def case_option_values_passed(rows):
    nodes, _, own = _options(rows)
    return options.pass_through(_table(rows, "assignment"), own, macros.all_path_definitions(_table(rows, "var_event"), nodes), nodes)


@query("options")
def case_undeclared(rows):
    nodes, declared, _ = _options(rows)
    return options.without_declarations(nodes, declared).select("script_id", "node_id", "kind")


@query("options")
def case_used_options(rows):
    _, declared, own = _options(rows)
    return options.used_options(declared, own, _table(rows, "guard_term")).select("script_id", "option")


@query("options", "branches")
def case_guarded_blocks(rows):
    return options.blocks_guarded_by(_table(rows, "guard_term"))


@query("options", "branches")
def case_outermost_guarded(rows):
    return options.outermost_guarded(_table(rows, "guard_term"), _table(rows, "node"))


@query("order")
def case_touching(rows):
    return options.touching(_table(rows, "var_event"))


@query("loops")
def case_dictionaries(rows):
    return _table(rows, "dict_access").select("script_id", "dict", "op", "keys")


@query("loops", "branches")
def case_values(rows):
    return per_script(rows, lambda s: [(v, x) for v in sorted(s.defs) for x in sorted(s.values(v))], "var string, value string")


@query("commands")
def case_pruned(rows):
    """Without the commands echo and rm, and what is empty then."""
    gone = lambda n: n.kind == "Command" and literal(n.words[0]) in ("echo", "rm")
    return per_script(rows, lambda s: [(k, rendering.node(n)) for k, n in enumerate(rewriting.remove(s.top, gone))], "pos int, source string").where("pos < 4")


@query("branches", "commands")
def case_flattened(rows):
    return per_script(rows, lambda s: [(k, n.kind, n.text) for k, n in enumerate(rewriting.flatten(s.top, -1))], "pos int, kind string, text string")


@query("branches", "options")
def case_guard_tests(rows):
    """The guards of branches as shell tests, whether cfg can decide them, and what they name for the case's options."""

    def made(s):
        for r in s.rows:
            if r.kind == "If":
                for k, (test, _) in enumerate(r.node.branches):
                    if test:
                        own = guards.of_condition(test, s._shown)
                        arg = guards.to_argument(own, {"use", "level"})
                        yield r.node_id, k, rust.as_test(own), rust.is_replaceable(arg), ",".join(guards.enumerate_literals(arg, {"use", "level"})), rust.as_test(guards.negate(own))

    return per_script(rows, made, "node_id bigint, branch int, test string, replaceable boolean, literals string, negated string")


@query("order")
def case_translated(rows):
    """Lines of main and functions: small chunks inline, a given and a dummy function for the others."""

    def made(s):
        chunks = s.chunks(1)
        types = infer(list(s.hints()))
        io = {k: ([(v, False) for v, role in s.chunk_io(c) if role == "arg"], [v for v, role in s.chunk_io(c) if role == "return"]) for k, c in enumerate(chunks)}
        lines, functions = rust.translate([(k, [r.node for r in c]) for k, c in enumerate(chunks)], {0: "fn func0() {\n    given();\n}\n"}, io, types)
        yield from (("main", k, x) for k, x in enumerate(lines))
        yield from (("function", k, x) for k, x in enumerate(functions))

    return per_script(rows, made, "part string, pos int, text string")


@query("paths")
def case_paths(rows):
    """Words of commands as paths: what they can name, their parts, and whether they are absolute."""

    def made(s):
        for r in s.rows:
            if r.kind == "Command":
                for k, w in enumerate(r.node.words[1:], 1):
                    parts, absolute = path_parts(w)
                    yield r.node_id, k, ",".join(paths_of(s, w, r.exec_id)), "|".join(f"{a} {b}" for a, b in parts), absolute

    return per_script(rows, made, "node_id bigint, word bigint, paths string, parts string, absolute boolean")


@query("paths")
def case_delimited(rows):
    return case_guards(rows)


@query("loops", "commands", "paths")
def case_visited(rows):
    """A visitor that counts what stands below each node, and one kind of its own."""

    class Count(Visitor):
        def visit(self, r, below):
            return 1 + sum(below)

        def visit_assignment(self, r, below):
            return 100

    return per_script(rows, lambda s: enumerate(Count(s).run()), "pos bigint, n bigint")


@query("order")
def case_scope_types(rows):
    """The second scope of x is a Path on its own; the others have what was inferred for the variable."""
    scopes = _table(rows, "scope").select("script_id", "var", "idx")
    own = scopes.where("var = 'x' AND idx = 1").withColumn("type", F.lit("Path"))
    return values.scope_types(scopes, case_types(rows), own)


@query("order")
def case_cleaned(rows):
    """The tables of a script once the first assignment and the loop's body are gone."""
    nodes, events, edges = _table(rows, "node"), _table(rows, "var_event"), case_def_use(rows)
    gone = nodes.where("node_id IN (2, 9)").select("script_id", "node_id")
    left = trees.without_nodes({"node": nodes, "event": events, "edge": edges}, gone, {"node": ["node_id"], "event": ["node_id"], "edge": ["def_node", "use_node"]})
    out = None
    for name, t in left.items():
        own = t.groupBy("script_id", F.lit(name).alias("tbl")).agg(F.count("*").alias("n"))
        out = own if out is None else out.union(own)
    return out


@query("order")
def case_chunk_dump(rows):
    return exports.chunk_dump(_table(rows, "chunk").where("chunk IN (3, 7)"), _table(rows, "node"), exports.skeletons(_table(rows, "chunk_io"), case_types(rows)))


@query("commands")
def case_in_brace(rows):
    return per_script(rows, lambda s: [(k, rendering.node(n)) for k, n in enumerate(rewriting.in_brace(s.top, 1, 3)[:3])], "pos int, source string")


@query("branches")
def case_approximated(rows):
    """Stacks of guards with LIBS as an option that is on by default and EXTRA as one that isn't."""

    def made(s):
        a, b = guards.atom("Arg", "LIBS", "Empty"), guards.atom("Arg", "EXTRA", "True")
        for k, stack in enumerate(([a, b], [guards.negate(a), b], [b, guards.negate(b)], [("or", [a, b])])):
            yield k, "; ".join(map(guards.text, guards.approximated(stack, {"LIBS": True, "EXTRA": False}))), guards.all_about(("and", stack), "EXTRA")

    return per_script(rows, made, "pos int, guards string, about boolean")


@query("order")
def case_helpers(rows):
    """Texts that stand around chunks: names, calls, dummies, placeholders, exports, conversions, directories."""

    def made(s):
        name = next(r.node.words[0][0][1] for r in s.rows if r.text == "x" and r.kind == "Assignment")
        kinds = ("Boolean", "Integer", "Path", "List<Literal>", "Literal")
        yield "name", rust.function_name(3)
        yield "call", rust.call(3, [("a", False), ("b", True)], ["c"])
        yield "call", rust.call(4, [("a", False), ("b", True)], ["c", "d"], {"a", "b"})
        yield "dummy", rust.dummy(5, [("a", True, "Integer")], [("b", "Boolean"), ("c", "List<Path>")])
        yield "placeholder", rust.placeholder(int(name), 2)
        yield from (("text", rust.as_text("v", k)) for k in kinds)
        yield from (("default", rust.default_of(k)) for k in (*kinds, "Optional<Integer>"))
        yield from (("type", rust.data_type(k)) for k in ("Optional<Integer>", "List<List<Path>>"))
        yield from (("export", x) for x in rust.exported([("a", "Cfg", None), ("b", "Env", None), ("c", "Fixed", name), ("d", "Unset", None)]))
        yield "optional", rust.optional(guards.atom("Var", "v", "Set")) + " " + rust.optional(guards.atom("Var", "v", "Set", negated=True))
        yield "merged", str(rust.merged([{"snippets": ["a"], "regex": False}, {"snippets": ["b", "a"], "regex": True}]))
        yield "escaped", rust.quoted('a"b\\c\td\x01')
        yield from (("directory", x) for x in [*platforms.msvc_directories("C:\\a;;D:\\b"), *platforms.compiler_directories("x\n#include <...> search starts here:\n /usr/include\n /opt (framework directory)\nEnd of search list.\n /no")])
        yield "start", runtime.environment("v", "Integer")
        yield "bindgen", runtime.bindgen_call(["A_CFLAGS"])
        yield "needs", " ".join(codegen.required_functions("check_header(x) run_pkg_config(y)"))

    return per_script(rows, made, "kind string, text string")


@query("loops", "branches")
def case_guard_rewrites(rows):
    """Guards with host globs replaced by supported platforms, 0 and 1 of booleans, and arguments that are never empty."""

    def made(s):
        for r in s.rows:
            if r.kind in ("If", "Case"):
                for k, (test, _) in enumerate(r.node.branches):
                    own = guards.of_pattern(r.node.words[0], test, s._shown) if r.kind == "Case" else guards.of_condition(test, s._shown) if test else None
                    if own is not None:
                        there = guards.supported(own, ["x86_64", "i686", "arm"], ["linux", "windows"])
                        less = guards.without_empty_arguments(guards.to_argument(guards.numeric_booleans(own, {"v"}), {"CC"}), {"CC": True})
                        yield r.node_id, k, there and guards.text(there), guards.text(guards.simplify(less)), guards.contradictory([own, guards.negate(own)]), guards.is_dead(own)

    return per_script(rows, made, "node_id bigint, branch int, supported string, without_empty string, contradictory boolean, dead boolean")


def _wide(df: DataFrame) -> DataFrame:
    """Whole numbers as bigint, as the SQL has them."""
    return df.withColumns({c: F.col(c).cast("bigint") for c, kind in df.dtypes if kind == "int"})


def queries() -> dict:
    return {name: (lambda spark, d, cases=cases, f=f: _wide(f(scripts(spark, d, *cases)))) for name, (cases, f) in QUERIES.items()}


def _literal(v) -> str:
    return "NULL" if v is None else str(v).upper() if isinstance(v, bool) else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"


def oracle_sql() -> dict[str, str]:
    """The rows held for a query's cases, with each nation's name and number."""
    out = {}
    for name, (columns, rows) in EXPECTED.items():
        kinds = [next((type(r[k + 1]) for r in rows if r[k + 1] is not None), str) for k in range(len(columns))]
        put = [f"replace(replace({c}, '{{name}}', {_NAME}), '{{num}}', (n_nationkey + 40)::VARCHAR) AS {c}" if kind is str else f"{c}::{'BOOLEAN' if kind is bool else 'BIGINT'} AS {c}" for c, kind in zip(columns, kinds, strict=True)]
        values = ", ".join("(" + ", ".join(map(_literal, r)) + ")" for r in rows)
        out[name] = f"SELECT n_nationkey::VARCHAR || '/' || script_case AS script_id, {', '.join(put)} FROM nation, (VALUES {values}) t(script_case, {', '.join(columns)})"
    return out
