"""Queries that apply the operators on project files, options, packages and exports to tables written from the ordinary ones."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import text
from quern.operators import asof, dictionaries, macros, options, projects, values
from quern.operators.trees import shared_place
from quern.plans import cache, exports, models
from quern.sources import platforms

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def listed(column: str) -> F.Column:
    return F.array_join(F.col(column).cast("array<string>"), ",").alias(column)


# scalar functions


@query(r"SELECT p_partkey, (p_size % 4)::BIGINT AS n FROM part")
def trailing_backslashes(spark, d):
    return table(spark, d, "part").select("p_partkey", text.trailing_backslashes(F.concat("p_name", F.repeat(F.lit("\\"), F.col("p_size") % 4))).cast("bigint").alias("n"))


@query("SELECT p_partkey, regexp_replace(upper(p_brand), '[^A-Z0-9]', '_', 'g') AS name FROM part")
def package_names(spark, d):
    return table(spark, d, "part").select("p_partkey", text.sanitize_package(F.concat(F.lit("lib"), "p_brand", F.lit("-dev"))).alias("name"))


_LITERALS = "CASE p_size % 5 WHEN 0 THEN '\"' || p_name || '\"' WHEN 1 THEN p_size::VARCHAR WHEN 2 THEN '' WHEN 3 THEN p_name ELSE p_size || 'x' END"


@query("SELECT p_partkey, p_size % 5 < 3 AS literal FROM part")
def header_literals(spark, d):
    return table(spark, d, "part").select("p_partkey", text.is_header_literal(F.expr(_LITERALS.replace("VARCHAR", "STRING"))).alias("literal"))


@query("SELECT p_partkey, CASE p_size % 3 WHEN 2 THEN NULL ELSE 'V' || p_size END AS var FROM part")
def substituted_names(spark, d):
    value = F.expr("CASE p_size % 3 WHEN 0 THEN concat('@V', p_size, '@') WHEN 1 THEN concat('\"@V', p_size, '@\"') ELSE concat('(@V', p_size, '@ + 1)') END")
    return table(spark, d, "part").select("p_partkey", text.substitution(value).alias("var"))


@query("SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN s ELSE CASE WHEN p_size % 2 = 0 THEN 'MY_' ELSE 'my_' END || s END AS symbol FROM (SELECT *, CASE WHEN p_size % 2 = 0 THEN upper(p_brand) ELSE lower(p_brand) END AS s FROM part)")
def prefixed_symbols(spark, d):
    symbol = F.when(F.col("p_size") % 2 == 0, F.upper("p_brand")).otherwise(F.lower("p_brand"))
    return table(spark, d, "part").select("p_partkey", text.prefixed_symbol(symbol, F.when(F.col("p_size") % 3 != 0, F.lit("My_"))).alias("symbol"))


@query("SELECT p_partkey, string_split(p_type, ' ')[1] || '|' || string_split(p_type, ' ')[2] || '|' || string_split(p_type, ' ')[3] AS blanks, p_size || '|' || p_brand AS colons FROM part WHERE len(string_split(p_type, ' ')) = 3 UNION ALL SELECT p_partkey, array_to_string(string_split(p_type, ' '), '|'), p_size || '|' || p_brand FROM part WHERE len(string_split(p_type, ' ')) <> 3")
def separated_fields(spark, d):
    colons = F.concat(F.lit(":"), "p_size", F.lit("::"), "p_brand", F.lit(":"))
    return table(spark, d, "part").select("p_partkey", F.array_join(text.split_ifs(F.concat(F.lit(" "), F.replace("p_type", F.lit(" "), F.lit(" \t ")))), "|").alias("blanks"), F.array_join(text.split_ifs(colons, ":"), "|").alias("colons"))


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN '/' ELSE '' END || 'src/' || p_size || '/x.c' AS path FROM part")
def normal_paths(spark, d):
    path = F.concat(F.when(F.col("p_size") % 2 == 0, "/./").otherwise("./"), F.lit("src/a/../"), "p_size", F.lit("//b/./../x.c"))
    return table(spark, d, "part").select("p_partkey", text.normalize_path(path).alias("path"))


@query("SELECT p_partkey, p_size % 6 < 3 AS c, p_size % 6 BETWEEN 3 AND 4 AS h FROM part")
def source_kinds(spark, d):
    name = F.concat("p_name", F.lit("."), F.element_at(F.array(*[F.lit(x) for x in ("c", "cc", "cpp", "h", "hpp", "rs")]), (F.col("p_size") % 6 + 1).cast("int")))
    return table(spark, d, "part").select("p_partkey", text.is_c_file(name).alias("c"), text.is_h_file(name).alias("h"))


@query(r"""SELECT p_partkey, '\"' || p_name || '\"\\' || p_size || '\t\r' || chr(10) || '\u{1}' AS text FROM part""")
def rust_strings(spark, d):
    return table(spark, d, "part").select("p_partkey", text.escape_rust(F.concat(F.lit('"'), "p_name", F.lit('"\\'), "p_size", F.lit("\t\r\n\x01"))).alias("text"))


@query("SELECT p_partkey, 'i[3-6]86|pc|linux' || p_size || '*' AS parts FROM part")
def triplet_parts(spark, d):
    return table(spark, d, "part").select("p_partkey", F.array_join(text.split_triplet(F.concat(F.lit("i[3-6]86-pc-linux"), "p_size", F.lit("*"))), "|").alias("parts"))


@query("SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'cc' WHEN 1 THEN 'awk' END AS value, CASE p_size % 6 WHEN 0 THEN 'bool' WHEN 1 THEN 'usize' WHEN 2 THEN 'PathBuf' WHEN 3 THEN 'Vec<PathBuf>' ELSE 'String' END AS type FROM part")
def known_values_and_types(spark, d):
    name = F.expr("CASE p_size % 3 WHEN 0 THEN 'CC' WHEN 1 THEN 'AWK' ELSE p_name END")
    kind = F.expr("CASE p_size % 6 WHEN 0 THEN 'Boolean' WHEN 1 THEN 'Integer' WHEN 2 THEN 'Path' WHEN 3 THEN 'List<Path>' ELSE 'Literal' END")
    return table(spark, d, "part").select("p_partkey", text.known_value(name).alias("value"), exports.rust_type(kind).alias("type"))


# project files


def _files(spark, d):
    """A C file for each part that includes the header of its size, and headers that include the next one, up to 20."""
    c = table(spark, d, "part").select(F.concat(F.lit("src/f"), "p_partkey", F.lit(".c")).alias("path"), F.concat(F.lit('#include "h'), "p_size", F.lit('.h"\n#include <stdio.h>\n')).alias("content"))
    h = spark.range(1, 21).select(F.concat(F.lit("inc/h"), "id", F.lit(".h")).alias("path"), F.concat(F.lit('# include "h'), F.col("id") + 1, F.lit('.h"\n')).alias("content"))
    return c, h


@query("SELECT 'inc/h' || k || '.h' AS path, 'inside' AS place FROM range(1, 21) t(k) WHERE k >= (SELECT min(p_size) FROM part WHERE p_size <= 20) UNION ALL SELECT 'stdio.h', 'outside' UNION ALL SELECT 'h' || k || '.h', 'outside' FROM (SELECT DISTINCT p_size AS k FROM part WHERE p_size > 20 UNION SELECT 21) t")
def reached_headers(spark, d):
    c, h = _files(spark, d)
    inside, outside = projects.reached_headers(c, c.union(h), ["inc"])
    return inside.select("path", F.lit("inside").alias("place")).union(outside.select("header", F.lit("outside")))


@query("SELECT 'Makefile' AS file, 't' || p_size AS target, p_brand || '/' || p_partkey AS source, p_brand || '/' || p_partkey || CASE p_partkey % 4 WHEN 0 THEN '' WHEN 1 THEN '.c' WHEN 2 THEN '.cpp' END AS path FROM part WHERE p_partkey % 4 < 3")
def resolved_sources(spark, d):
    own = F.concat("p_brand", F.lit("/"), "p_partkey")
    part = table(spark, d, "part").select("*", own.alias("own"))
    rows = part.select(F.lit("Makefile").alias("file"), F.concat(F.lit("t"), "p_size").alias("target"), F.col("own").alias("source"))
    files = part.select(F.expr("CASE p_partkey % 4 WHEN 0 THEN own WHEN 1 THEN concat(own, '.c') WHEN 2 THEN concat(own, '.cpp') END").alias("path")).where("path IS NOT NULL")
    built = part.where("p_partkey % 4 = 1").select(F.concat("own", F.lit(".cc")).alias("path"))  # comes after .c
    return projects.resolve_sources(rows, files, built)


_SYMBOL = "'S' || p_partkey"


@query(f"SELECT {_SYMBOL} AS symbol, CASE WHEN p_size % 5 = 0 THEN CASE p_size % 3 WHEN 0 THEN 'Unset' WHEN 1 THEN 'Set' ELSE 'Fixed' END WHEN p_partkey % 3 = 0 THEN 'Env' ELSE 'Cfg' END AS type, CASE WHEN p_size % 15 IN (5, 20) THEN 'v' || p_size END AS value FROM part")
def symbol_policies(spark, d):
    part = table(spark, d, "part").withColumn("symbol", F.concat(F.lit("S"), "p_partkey"))
    line = F.expr("CASE p_partkey % 3 WHEN 0 THEN concat('#define A', p_partkey, ' ', symbol, '\\nint x = A', p_partkey, ';\\n') WHEN 1 THEN concat('#ifdef ', symbol, '\\n#endif\\n') ELSE concat('if (', symbol, ') f(); /* ', symbol, ' */\\n') END")
    files = part.select(F.concat("symbol", F.lit(".c")).alias("path"), line.alias("content"))
    frozen = part.where("p_size % 5 = 0").select("symbol", F.expr("CASE p_size % 3 WHEN 1 THEN '1' WHEN 2 THEN concat('v', p_size) END").alias("value"))
    return projects.policies(part, projects.values_used(part.select("symbol"), files), frozen)


@query("SELECT 'h' || p_partkey AS path, 'A' || p_partkey AS symbol, 'X' || p_size AS subst, CASE WHEN p_size % 2 = 0 THEN 'C' || p_size END AS block FROM part UNION ALL SELECT 'h' || p_partkey, 'B' || p_partkey, NULL, NULL FROM part")
def header_templates(spark, d):
    own = F.concat(F.lit("#define A"), "p_partkey", F.lit(" @X"), "p_size", F.lit("@ /* c */\n"))
    block = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("#if @C"), "p_size", F.lit("@\n"), own, F.lit("#endif\n"))).otherwise(own)
    content = F.concat(block, F.lit("#define B"), "p_partkey", F.lit(' "lit"\n#define D'), "p_partkey", F.lit(" (1 + 2)\n"))
    return projects.header_templates(table(spark, d, "part").select(F.concat(F.lit("h"), "p_partkey").alias("path"), content.alias("content")))


@query("SELECT 'bag' AS kind, path, count(*) AS n FROM (SELECT p_brand AS path FROM part UNION ALL SELECT p_type FROM part) GROUP BY 2 UNION ALL SELECT 'set', path, 1 FROM (SELECT p_brand AS path FROM part UNION SELECT p_type FROM part)")
def project_paths(spark, d):
    a, b = (table(spark, d, "part").select(F.col(c).alias("path")) for c in ("p_brand", "p_type"))
    bag, once = projects.source_paths(a, b), projects.other_paths(a, b)
    return bag.groupBy(F.lit("bag").alias("kind"), "path").agg(F.count("*").alias("n")).union(once.select(F.lit("set"), "path", F.lit(1).cast("bigint")))


@query("SELECT 't' || p_partkey AS path, 'V' || p_size AS var FROM part WHERE p_size < 25 UNION SELECT 't' || p_partkey, 'V1' FROM part")
def mentioned_variables(spark, d):
    files = table(spark, d, "part").select(F.concat(F.lit("t"), "p_partkey").alias("path"), F.concat(F.lit("a @V"), "p_size", F.lit("@ b@@ @V1@ @Vx"), "p_size", F.lit("@ V2\n")).alias("content"))
    return projects.mentioned_variables(files, spark.range(1, 25).select(F.concat(F.lit("V"), "id").alias("var")))


@query("SELECT n_name AS path, 'top ' || n_nationkey || ' ' || 'common ' || 'deep' || ' end' AS content FROM nation UNION ALL SELECT 'common.mk', 'common deep' UNION ALL SELECT 'deep.mk', 'deep common'")
def included_makefiles(spark, d):
    own = table(spark, d, "nation").select(F.col("n_name").alias("path"), F.concat(F.lit("top "), "n_nationkey", F.lit("\ninclude common.mk\nend\n-include gone.mk")).alias("content"))
    more = spark.createDataFrame([("common.mk", "common\ninclude deep.mk"), ("deep.mk", "deep\ninclude common.mk")], "path string, content string")
    return projects.inline_includes(own.union(more)).select("path", F.trim(F.regexp_replace("content", r"\s+", " ")).alias("content"))


@query("SELECT n_name AS file, 'FLAGS_' || n_nationkey AS var FROM nation WHERE n_nationkey % 2 = 0")
def cflags_variables(spark, d):
    kind = F.when(F.col("n_nationkey") % 2 == 0, "lib_LTLIBRARIES = libx.la\nlibx_la_CFLAGS").otherwise("bin_PROGRAMS = x\nx_CFLAGS")
    held = projects.current_values(projects.makefile_variables(table(spark, d, "nation").select(F.col("n_name").alias("path"), F.concat(kind, F.lit(" = -O2 $(FLAGS_"), "n_nationkey", F.lit(")\n")).alias("content"))))
    return projects.cflags_variables(held, projects.targets(held))


@query("SELECT DISTINCT 'C' || p_size AS key, CASE WHEN p_size % 2 = 0 THEN 'test ' || p_size END AS test FROM part")
def condition_guards(spark, d):
    part = table(spark, d, "part").select(F.concat(F.lit("C"), "p_size").alias("key"), "p_size")
    return projects.condition_guards(part, part.where("p_size % 2 = 0").select(F.col("key").alias("condition"), F.concat(F.lit("test "), "p_size").alias("test")))


# packages


def _catalogue(spark, d):
    return table(spark, d, "supplier").select(
        F.concat(F.lit("p"), "s_suppkey").alias("pc_name"), F.concat(F.lit("libp"), "s_suppkey", F.lit("-dev")).alias("sys_package"), (F.col("s_nationkey") % 4 != 0).alias("installed"),
        F.array(F.concat(F.lit("/usr/include/p"), "s_suppkey", F.lit(".h")), F.lit("/usr/include/common.h"), F.lit("/usr/share/doc")).alias("headers"), F.array(F.lit("/usr/include")).alias("include_paths"), F.concat(F.lit("/pc/p"), "s_suppkey", F.lit(".pc")).alias("path"),
    )


@query("SELECT 'p' || k AS package, CASE WHEN s_suppkey IS NOT NULL THEN 'libp' || k || '-dev' END AS sys_package, CASE WHEN s_suppkey IS NOT NULL THEN 2 END::BIGINT AS n_headers, CASE WHEN s_suppkey IS NULL THEN 'not found' WHEN s_nationkey % 4 = 0 THEN 'not installed' END AS error FROM range(1, 21) t(k) LEFT JOIN supplier ON s_suppkey = k")
def installed_packages(spark, d):
    wanted = spark.range(1, 21).select(F.concat(F.lit("p"), "id").alias("package"))
    return macros.installed_packages(wanted, _catalogue(spark, d)).select("package", "sys_package", F.when(F.col("headers").isNotNull(), F.size("headers")).cast("bigint").alias("n_headers"), "error")


@query("SELECT 'p' || k AS pc_name, CASE WHEN s_suppkey IS NULL THEN 'p' || k || '.pc' ELSE '/pc/p' || k || '.pc' END AS path FROM range(1, 21) t(k) LEFT JOIN supplier ON s_suppkey = k")
def package_paths(spark, d):
    return projects.package_paths(spark.range(1, 21).select(F.concat(F.lit("p"), "id").alias("pc_name")), _catalogue(spark, d))


@query("""
WITH i AS (SELECT s_suppkey AS k FROM supplier WHERE s_nationkey % 4 <> 0), l AS (SELECT min('libp' || k || '-dev') AS first FROM i),
h AS (SELECT 'libp' || k || '-dev' AS p, 'p' || k || '.h' AS h FROM i WHERE k % 3 = 0 UNION ALL SELECT first, 'common.h' FROM l WHERE first IS NOT NULL)
SELECT p AS sys_package, '#ifdef HAVE_' || replace(replace(upper(p), 'LIB', ''), '-DEV', '') || chr(10) || string_agg('#include <' || h || '>' || chr(10), '' ORDER BY h) || '#endif' || chr(10) AS text FROM h GROUP BY p""")
def wrapper_headers(spark, d):
    wanted = table(spark, d, "supplier").where("s_suppkey % 3 = 0").select(F.concat(F.lit("p"), "s_suppkey", F.lit(".h")).alias("header")).union(spark.createDataFrame([("common.h",), ("other.h",)], "header string"))
    own = _catalogue(spark, d)
    return macros.wrapper_header(wanted, macros.installed_packages(own.select(F.col("pc_name").alias("package")), own))


@query("SELECT k AS key, CASE WHEN k % 2 = 0 THEN 'a' || k WHEN k % 3 = 0 THEN 'b' || k ELSE 'c' || k END AS path FROM (SELECT n_nationkey AS k FROM nation)")
def first_provided(spark, d):
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("key"))
    one = lambda p, when: n.select("key", F.when(when, F.concat(F.lit(p), "key")).alias("path"))
    return projects.first_provided([one("a", F.col("key") % 2 == 0), one("b", F.col("key") % 3 == 0), one("c", F.lit(True))], "key", "path")


@query("SELECT name, row_number() OVER (ORDER BY length(name), name) AS place FROM (SELECT DISTINCT p_type AS name FROM part)")
def platform_names(spark, d):
    return platforms.supported(table(spark, d, "part"), "p_type").select("name", F.col("place").cast("bigint").alias("place"))


# options, dictionaries, macros


def _partitions(spark, d):
    kind = F.col("n_nationkey") % 3
    array = lambda *x: F.array(*[F.lit(v) for v in x])
    return table(spark, d, "nation").select(
        F.concat(F.lit("o"), "n_nationkey").alias("option_name"), F.when(kind == 0, array("yes", "no")).otherwise(array("fast", "yes", "no")).alias("representatives"), F.create_map(F.lit("on"), F.lit("yes")).alias("aliases"),
        (F.col("n_regionkey") % 2 == 0).alias("enabled_by_default"), F.when(kind == 1, F.lit("fast")).alias("non_boolean_default"),
    )


@query("""
SELECT 'o' || n_nationkey AS option_name, 'o' || n_nationkey || CASE f WHEN 'fast' THEN '_fast' ELSE '' END AS feature, CASE f WHEN 'fast' THEN 'fast' ELSE 'on,yes' END AS on_values,
  n_regionkey % 2 = 0 AND (f = 'yes' OR n_nationkey % 3 = 1) AS enabled_by_default
FROM nation, (VALUES ('yes'), ('fast')) t(f) WHERE f = 'yes' OR n_nationkey % 3 > 0""")
def option_features(spark, d):
    on = F.array_join(F.array_sort(F.map_keys(F.map_filter("values", lambda k, v: v))), ",")
    return macros.features(_partitions(spark, d)).select("option_name", "feature", on.alias("on_values"), F.coalesce("enabled_by_default", F.lit(False)).alias("enabled_by_default"))


def _keys():
    return F.array(F.struct(F.lit("Literal").alias("kind"), F.col("p_brand").alias("text")), F.struct(F.lit("Var").alias("kind"), F.concat(F.lit("v"), "p_size").alias("text")))


@query("""SELECT p_partkey, 'd.get(&("' || p_brand || '".to_string(), v' || p_size || '.clone(), "".to_string())).cloned().unwrap_or_default()' AS read,
  CASE p_size % 3 WHEN 0 THEN 'd.insert(("' || p_brand || '".to_string(), v' || p_size || '.clone()), x);' WHEN 1 THEN 'd.entry(("' || p_brand || '".to_string(), v' || p_size || '.clone())).or_default().push_str(&x);'
    ELSE 'd.entry(("' || p_brand || '".to_string(), v' || p_size || '.clone())).or_default().extend(x);' END AS write,
  CASE WHEN p_size % 2 = 0 THEN 'HashMap<String, usize>' ELSE 'HashMap<(String, String), usize>' END AS type FROM part""")
def dictionary_code(spark, d):
    kind = F.when(F.col("p_size") % 3 == 2, "List<Literal>").otherwise("Literal")
    return table(spark, d, "part").select(
        "p_partkey", dictionaries.read(F.lit("d"), dictionaries.with_omitted(_keys(), F.lit(3))).alias("read"), dictionaries.write(F.lit("d"), _keys(), F.lit("x"), F.col("p_size") % 3 != 0, kind).alias("write"),
        dictionaries.type_text(F.when(F.col("p_size") % 2 == 0, 1).otherwise(2), F.lit("usize")).alias("type"),
    )


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'Integer' WHEN p_size % 3 = 0 THEN 'Path' ELSE 'Literal' END AS type, CASE WHEN p_size % 5 = 0 THEN 'w' || p_partkey END AS assigned_value, p_size % 7 > 0 AS plain FROM part")
def dictionary_accesses(spark, d):
    part = table(spark, d, "part").select("*", F.lit("s").alias("script_id"), F.col("p_partkey").alias("node_id"), F.concat(F.lit("r"), "p_partkey").alias("raw_name"), F.concat(F.lit("a"), "p_partkey").alias("assigned_to"))
    types = part.where("p_size % 2 = 0").select("script_id", F.col("raw_name").alias("var"), F.lit("Integer").alias("type")).union(part.where("p_size % 3 = 0").select("script_id", "assigned_to", F.lit("Path")))
    given = part.where("p_size % 5 = 0").select("script_id", "node_id", F.concat(F.lit("w"), "p_partkey").alias("value"))
    fragments = F.array(F.struct(F.lit("lit").alias("kind"), F.lit("a").alias("text")), F.struct(F.when(F.col("p_size") % 7 > 0, "var").otherwise("cmd").alias("kind"), F.lit("b").alias("text")))
    rows = dictionaries.assigned_values(dictionaries.access_types(part, types), given)
    return rows.select("p_partkey", "type", "assigned_value", dictionaries.value_parts(fragments).isNotNull().alias("plain"))


@query("SELECT 's' || n_regionkey AS script_id, 'M' || n_nationkey AS name, CASE WHEN n_nationkey % 4 > 0 THEN 'T' || n_nationkey END AS target, CASE WHEN n_nationkey % 4 > 0 THEN '1' END AS value FROM nation WHERE n_nationkey % 2 = 0 AND n_nationkey % 3 > 0")
def frozen_macros(spark, d):
    n = table(spark, d, "nation")
    name, target = F.concat(F.lit("M"), "n_nationkey").alias("name"), F.concat(F.lit("T"), "n_nationkey")
    calls = n.select(F.concat(F.lit("s"), "n_regionkey").alias("script_id"), name)
    effects = n.where("n_nationkey % 4 > 0 OR n_nationkey % 3 = 0").select(name, target.alias("target"), F.lit("symbol").alias("kind"))
    known = n.where("n_nationkey % 3 > 0").select(target.alias("target"), F.lit("1").alias("value"))
    return options.frozen_macros(calls, effects, n.where("n_nationkey % 2 = 0").select(name), known)


@query("SELECT DISTINCT 's' || n_regionkey AS script_id, 'I' || n_nationkey % 3 AS var FROM nation WHERE n_nationkey % 2 = 0")
def input_variables(spark, d):
    n = table(spark, d, "nation").select("*", F.concat(F.lit("M"), "n_nationkey").alias("name"))
    effects = n.select("name", F.concat(F.lit("I"), F.col("n_nationkey") % 3).alias("target"), F.when(F.col("n_nationkey") % 2 == 0, "input").otherwise("symbol").alias("kind"))
    return options.input_variables(n.select(F.concat(F.lit("s"), "n_regionkey").alias("script_id"), "name"), effects)


# exports, models, caches


@query("""
SELECT 's' || n_nationkey AS script_id, '[package]' || chr(10) || 'name = "' || lower(n_name) || '"' || chr(10) || 'version = "' || CASE WHEN n_nationkey % 2 = 0 THEN '1.' || n_nationkey ELSE '0.1.0' END || '"' || chr(10) || 'edition = "2021"' || chr(10) || 'build = "build.rs"' || chr(10) || chr(10)
  || '[features]' || chr(10) || 'default = ["a"]' || chr(10) || 'a = ["b"]' || chr(10) || 'b = []' || chr(10) || chr(10) || '[build-dependencies]' || chr(10) || 'bindgen = "*"' || chr(10) || 'pkg-config = "*"' || chr(10) || 'regex = "*"' || chr(10) AS text FROM nation""")
def manifests(spark, d):
    n = table(spark, d, "nation").select(F.concat(F.lit("s"), "n_nationkey").alias("script_id"), F.lower("n_name").alias("name"), F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("1."), "n_nationkey")).alias("version"))
    features = n.select("script_id", F.explode(F.array(F.struct(F.lit("a").alias("feature"), F.lit(True).alias("enabled_by_default")), F.struct(F.lit("b").alias("feature"), F.lit(False).alias("enabled_by_default")))).alias("f")).select("script_id", "f.*")
    return exports.manifest(n, features, n.select("script_id", F.lit("a").alias("feature"), F.lit("b").alias("needs")))


@query("""SELECT '{' || string_agg('"S' || lpad(n_nationkey::VARCHAR, 2, '0') || '":{"type":"' || CASE WHEN n_nationkey % 2 = 0 THEN 'Cfg"' ELSE 'Fixed","value":"' || n_regionkey || '"' END || '}', ',' ORDER BY n_nationkey) || '}' AS json FROM nation""")
def conditional_map(spark, d):
    n = table(spark, d, "nation").select(F.concat(F.lit("S"), F.lpad(F.col("n_nationkey").cast("string"), 2, "0")).alias("symbol"), F.when(F.col("n_nationkey") % 2 == 0, "Cfg").otherwise("Fixed").alias("type"), F.when(F.col("n_nationkey") % 2 == 1, F.col("n_regionkey").cast("string")).alias("value"))
    return exports.conditional_map(n)


@query("SELECT 'o' || p_brand AS option_name, 'true' AS success, '' AS failure_reason, '' AS llm_cost, '5' AS duration_ms, string_agg(DISTINCT p_size::VARCHAR, ';' ORDER BY p_size::VARCHAR) AS value_candidates, '' AS representatives, '' AS features FROM part GROUP BY p_brand")
def option_records(spark, d):
    own = table(spark, d, "part").groupBy(F.concat(F.lit("o"), "p_brand").alias("option_name")).agg(F.array_sort(F.collect_set(F.col("p_size").cast("string"))).alias("value_candidates"))
    none = F.lit(None).cast("array<string>")
    return exports.option_records(own.select("option_name", F.lit(True).alias("success"), F.lit(None).cast("string").alias("failure_reason"), F.lit(None).cast("double").alias("llm_cost"), F.lit(5).alias("duration_ms"), "value_candidates", none.alias("representatives"), none.alias("features")))


@query("SELECT o_orderkey::VARCHAR AS chunk_id, (o_orderkey % 9)::VARCHAR AS chunk_size, o_orderpriority AS translation_type, CASE WHEN o_orderkey % 2 = 0 THEN 'true' ELSE 'false' END AS success, '' AS failure_reason, '0' AS retry_count, '' AS llm_cost, '' AS duration_ms FROM orders")
def chunk_records(spark, d):
    o = table(spark, d, "orders")
    none = F.lit(None).cast("string")
    return exports.chunk_records(o.select(F.col("o_orderkey").alias("chunk_id"), (F.col("o_orderkey") % 9).alias("chunk_size"), F.col("o_orderpriority").alias("translation_type"), (F.col("o_orderkey") % 2 == 0).alias("success"), none.alias("failure_reason"), F.lit(0).alias("retry_count"), none.alias("llm_cost"), none.alias("duration_ms")))


@query("SELECT round(sum(o_orderkey * 0.25 + o_custkey * 2.0) / 1e6, 4) AS cost FROM orders")
def model_cost(spark, d):
    return exports.cost(table(spark, d, "orders").select(F.col("o_orderkey").alias("prompt_tokens"), F.col("o_custkey").alias("completion_tokens"))).select(F.round("cost", 4).alias("cost"))


@query("""SELECT '{"c":[' || (SELECT string_agg('"' || b || '"', ',' ORDER BY b) FROM (SELECT DISTINCT p_brand AS b FROM part)) || '],"h":[' || (SELECT string_agg('"' || b || '"', ',' ORDER BY b) FROM (SELECT DISTINCT n_name AS b FROM nation)) || '],"links":[{"target":"a","source":"b"}],"n_files":' || (SELECT count(DISTINCT p_brand) + 25 FROM part) || ',"n_links":1}' AS json""")
def project_record(spark, d):
    parts = {"c": table(spark, d, "part").select(F.col("p_brand").alias("path")), "h": table(spark, d, "nation").select(F.col("n_name").alias("path"))}
    return exports.project_info_json(exports.project_info(parts, spark.createDataFrame([("a", "b")], "target string, source string")))


@query("""
SELECT p_partkey AS chunk, 'missing snippet: b' AS error FROM part WHERE p_size % 2 = 0 UNION ALL SELECT p_partkey, 'missing placeholder: __P__' FROM part WHERE p_size % 3 = 0
UNION ALL SELECT p_partkey, 'banned: AC_X' FROM part WHERE p_size % 5 = 0 UNION ALL SELECT p_partkey, 'the function has another name' FROM part WHERE p_size % 7 = 0""")
def translation_errors(spark, d):
    part = table(spark, d, "part")
    source = F.concat(F.when(F.col("p_size") % 7 == 0, "fn g").otherwise("fn f"), F.lit("() { a "), F.when(F.col("p_size") % 2 == 0, "").otherwise("b "), F.when(F.col("p_size") % 3 == 0, "").otherwise("__P__ "), F.when(F.col("p_size") % 5 == 0, "AC_X").otherwise(""), F.lit("}"))
    array = lambda *x: F.array(*[F.lit(v) for v in x])
    return models.translation_errors(part.select(F.col("p_partkey").alias("chunk"), F.lit("f").alias("name"), source.alias("source"), array("a", "b").alias("snippets"), array("__P__").alias("placeholders"), array("AC_X").alias("banned")))


@query("SELECT p_partkey, p_name || ' ' || p_brand AS text, '__CODE_1__ {}' AS held FROM part")
def placeholders(spark, d):
    from quern.operators import rust

    return table(spark, d, "part").select("p_partkey", models.restore_placeholders(F.concat("p_name", F.lit(" __P__")), [("__P__", "__Q__")]).alias("t"), "p_brand").select("p_partkey", F.replace("t", F.lit("__Q__"), F.col("p_brand")).alias("text"), F.lit(rust.placeholder(1, 1)).alias("held"))


@query("SELECT n_nationkey AS k, n_name AS name, length(n_name)::BIGINT AS size, CASE WHEN n_nationkey % 2 = 0 THEN 'first' ELSE 'second' END AS made_by FROM nation")
def cached_results(spark, d):
    """Half of the results are kept by the content of their inputs; the other half is computed, and kept too."""
    place = f"{shared_place(spark)}/cache-{uuid.uuid4().hex}"
    kept = cache.Cache(spark, place, "size bigint, made_by string")
    compute = lambda by: lambda rows: rows.select("key", F.length("name").cast("bigint").alias("size"), F.lit(by).alias("made_by"))
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"))
    kept.through(n.where("k % 2 = 0"), ["name"], compute("first"))
    return kept.through(n, ["name"], compute("second")).select("k", "name", "size", "made_by")


@query("SELECT p.event_id, c.event_id AS value FROM (SELECT * FROM events WHERE event_type <> 'view') p ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'click') c ON p.user_id = c.user_id AND p.event_id >= c.event_id")
def latest_kept(spark, d):
    e = table(spark, d, "events")
    kept = e.where("event_type = 'click'").select("user_id", F.col("event_id").alias("at"), F.col("event_id").alias("v"))
    asked = e.where("event_type <> 'view'").select("event_id", "user_id", F.col("event_id").alias("at"))
    return cache.latest_kept(kept, asked, ["user_id"], "at", "v").select("event_id", "value")


@query("SELECT l_suppkey, bool_or(l_quantity > 45) AS header, bool_or(l_discount > 0.09) AS library FROM lineitem GROUP BY 1")
def merged_flags(spark, d):
    rows = table(spark, d, "lineitem").select("l_suppkey", (F.col("l_quantity") > 45).alias("header"), (F.col("l_discount") > 0.09).alias("library"))
    return projects.merged_flags(rows, ["l_suppkey"], ["header", "library"])


@query("SELECT var, string_agg(place::VARCHAR, ',' ORDER BY place) AS places FROM (SELECT p_brand AS var, p_partkey AS place FROM part UNION ALL SELECT p_brand, p_size FROM part WHERE p_size < 5) GROUP BY 1")
def merged_positions(spark, d):
    part = table(spark, d, "part")
    a = part.select(F.col("p_brand").alias("var"), F.col("p_partkey").alias("place"))
    return projects.merged_positions(a, part.where("p_size < 5").select(F.col("p_brand").alias("var"), F.col("p_size").cast("bigint").alias("place"))).select("var", listed("places"))


@query("SELECT p.event_id, substr(c.event_type, -1) AS separator FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF LEFT JOIN (SELECT * FROM events WHERE event_type IN ('view', 'click')) c ON p.user_id = c.user_id AND p.ts > c.ts")
def separator_in_force(spark, d):
    """The separator of fields at a place: the last character of the latest assignment before it."""
    e = table(spark, d, "events")
    given = e.where("event_type IN ('view', 'click')").select("user_id", "ts", F.substring("event_type", -1, 1).alias("v"))
    return asof.last_definition(given, e.where("event_type = 'purchase'").select("event_id", "user_id", "ts"), ["user_id"], ["ts"], "v", F.to_date("ts"), "separator").select("event_id", "separator")


@query("""SELECT 'o' || n_nationkey AS option_name, CASE n_nationkey % 3 WHEN 1 THEN 'no answer' ELSE 'alias of no representative' END AS error FROM nation WHERE n_nationkey % 3 > 0
UNION ALL SELECT 'o' || n_nationkey, 'fine: ' || CASE WHEN n_regionkey = 0 THEN 'fast,no,yes' ELSE 'no,yes' END FROM nation WHERE n_nationkey % 3 = 0""")
def analysed_options(spark, d):
    n = table(spark, d, "nation").withColumn("option_name", F.concat(F.lit("o"), "n_nationkey"))
    candidates = n.select("option_name", F.explode(F.when(F.col("n_regionkey") == 0, F.array(F.lit("yes"), F.lit("no"), F.lit("fast"))).otherwise(F.array(F.lit("yes"), F.lit("no")))).alias("value"))
    alias = F.when(F.col("n_nationkey") % 3 == 2, F.when(F.col("n_regionkey") == 0, '{"fast": "gone"}').otherwise('{"no": "gone"}')).when(F.col("n_regionkey") == 0, '{"fast": "yes"}').otherwise("{}")
    given = F.when((F.col("n_nationkey") % 3 == 2) & (F.col("n_regionkey") > 0), '["yes"]').otherwise('["yes", "no"]')
    answer = F.concat(F.lit('{"representatives": '), given, F.lit(', "aliases": '), alias, F.lit(', "enabled_by_default": true}'))
    answers = n.where("n_nationkey % 3 <> 1").select(F.col("option_name").alias("request_id"), answer.alias("answer"))
    fine, wrong = models.analysed_options(candidates, answers)
    return wrong.union(fine.select("option_name", F.concat(F.lit("fine: "), F.array_join(F.array_sort("candidates"), ","))))


@query("""SELECT 'o' || n_nationkey AS request_id, '{"option_name":"o' || n_nationkey || '","candidates":["' || n_regionkey || '","a"]}' AS request FROM nation""")
def option_requests(spark, d):
    n = table(spark, d, "nation").select(F.concat(F.lit("o"), "n_nationkey").alias("option_name"), F.explode(F.array(F.lit("a"), F.col("n_regionkey").cast("string"), F.lit("a"))).alias("value"))
    return models.option_requests(n)


@query("SELECT p_partkey, 'Lit a' || p_size || 'b|Var V|Lit c' AS parts FROM part")
def merged_literals(spark, d):
    one = lambda k, t: F.struct(F.lit(k).alias("kind"), t.alias("text"))
    parts = F.array(one("Lit", F.lit("a")), one("Lit", F.col("p_size").cast("string")), one("Lit", F.lit("b")), one("Var", F.lit("V")), one("Lit", F.lit("c")))
    return table(spark, d, "part").select("p_partkey", F.array_join(F.transform(projects.merged_literals(parts), lambda x: F.concat(x["kind"], F.lit(" "), x["text"])), "|").alias("parts"))


@query("SELECT 's' AS script_id, 'v' || n_nationkey AS var, CASE WHEN n_nationkey % 2 = 0 THEN 'Path' ELSE 'Literal' END AS type FROM nation")
def known_types(spark, d):
    n = table(spark, d, "nation").select(F.concat(F.lit("v"), "n_nationkey").alias("var"), "n_nationkey")
    return values.with_known_types(n.select(F.lit("s").alias("script_id"), "var", F.lit("Literal").alias("type")), n.where("n_nationkey % 2 = 0").select("var", F.lit("Path").alias("type")))
