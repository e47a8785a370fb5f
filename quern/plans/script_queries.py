"""Queries that run the script engine over scripts written from the tables, one for each nation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators import defuse, macros, projects
from quern.operators.analysis import infer
from quern.plans import exports
from quern.sources import tables

_SCRIPT = """AC_INIT([%1$s], [1.%2$d.3-rc1], [bugs@example.org])
AC_ARG_WITH([zlib], [use zlib], [with_z=$withval], [with_z=yes])
x=%3$d
if test "$x" = 1; then
  y=yes
else
  y=no
fi
for f in a b; do
  eval "have_$f=$y"
done
AC_CHECK_HEADERS([stdio.h zlib.h])
AC_DEFINE([NATION], [%2$d])
PKG_CHECK_MODULES([Z], [zlib >= 1.%3$d glib-2.0])
AC_CONFIG_FILES([Makefile src/%1$s.h:src/conf.in])
AC_SUBST([y])
"""


def scripts(spark: SparkSession, d: str) -> DataFrame:
    nations = spark.read.parquet(f"{d}/nation.parquet")
    return nations.select(F.col("n_nationkey").cast("string").alias("script_id"), F.format_string(_SCRIPT, "n_name", "n_nationkey", "n_regionkey").alias("text"))


def _table(spark, d, name):
    return tables.parse_table(scripts(spark, d), name)


def script_nodes(spark, d):
    return _table(spark, d, "node").groupBy("kind").agg(F.count("*").alias("n"))


def script_def_use(spark, d):
    return defuse.edges(_table(spark, d, "var_event"), _table(spark, d, "node"))


def script_eval_names(spark, d):
    return _table(spark, d, "eval_name").select("script_id", "name", "value")


def script_types(spark, d):
    hints = _table(spark, d, "type_hint")

    def run(frame):
        import pandas as pd

        found = infer([(v, h, a) for v, h, a in zip(frame["var"], frame["hint"], frame["arg"], strict=True)])
        return pd.DataFrame([(frame["script_id"].iloc[0], v, t) for v, t in sorted(found.items())], columns=["script_id", "var", "type"])

    return hints.groupBy("script_id").applyInPandas(run, "script_id string, var string, type string")


def script_chunks(spark, d):
    return _table(spark, d, "chunk").groupBy("script_id", "chunk").agg(F.count("*").alias("nodes"), F.min("first_line").alias("first_line"))


def script_skeletons(spark, d):
    return exports.skeletons(_table(spark, d, "chunk_io"), script_types(spark, d))


def script_metadata(spark, d):
    return macros.metadata(_table(spark, d, "m4_call")).select("script_id", "name", "version")


def script_symbols(spark, d):
    return macros.cpp_symbols(_table(spark, d, "m4_call"))


def script_files(spark, d):
    return macros.config_files(_table(spark, d, "m4_call"))


def script_packages(spark, d):
    return macros.packages(_table(spark, d, "m4_call"))


def script_options(spark, d):
    found = macros.build_options(_table(spark, d, "m4_call"), _table(spark, d, "var_event"), _table(spark, d, "node"))
    return found.select("script_id", "option", "kind", F.array_join("vars", ",").alias("vars"))


def makefile_sources(spark, d):
    nations = spark.read.parquet(f"{d}/nation.parquet")
    text = F.format_string("COMMON = util.c\nbin_PROGRAMS = %s\n%s_SOURCES = main.c $(COMMON)\nif LARGE\n%s_SOURCES += big.c\nendif\n", F.lower("n_name"), F.lower("n_name"), F.lower("n_name"))
    held = projects.resolve_words(projects.current_values(projects.makefile_variables(nations.select(F.col("n_name").alias("path"), text.alias("content")))))
    return projects.target_sources(projects.targets(held), held).select("file", "target", "source", F.size("conds").cast("bigint").alias("n_conds"))


def queries() -> dict:
    named = (script_nodes, script_def_use, script_eval_names, script_types, script_chunks, script_skeletons, script_metadata, script_symbols, script_files, script_packages, script_options, makefile_sources)
    return {f.__name__: f for f in named}


_ID = "n_nationkey::VARCHAR AS script_id"


def oracle_sql() -> dict[str, str]:
    """The scripts are written from the tables, so what they hold follows from the tables."""
    return {
        "script_nodes": "SELECT kind, n * (SELECT count(*) FROM nation) AS n FROM (VALUES ('Macro', 7), ('Assignment', 5), ('If', 1), ('For', 1), ('Command', 1)) t(kind, n)",
        "script_eval_names": f"SELECT {_ID}, name, value FROM nation, (VALUES ('have_a'), ('have_b')) a(name), (VALUES ('yes'), ('no')) b(value)",
        "script_def_use": f"SELECT {_ID}, var, def_node::BIGINT AS def_node, use_node::BIGINT AS use_node FROM nation, (VALUES ('x', 5, 6), ('f', 9, 10), ('y', 6, 10)) t(var, def_node, use_node)",
        # 0 and 1 are as Boolean as what x is compared with; another number agrees with it in nothing
        "script_types": f"SELECT {_ID}, var, CASE WHEN var = 'x' AND n_regionkey > 1 THEN 'Literal' ELSE type END AS type FROM nation, (VALUES ('f', 'Literal'), ('with_z', 'Boolean'), ('withval', 'Boolean'), ('x', 'Boolean'), ('y', 'Boolean')) t(var, type)",
        "script_chunks": f"SELECT {_ID}, chunk::BIGINT AS chunk, nodes::BIGINT AS nodes, first_line::INT AS first_line FROM nation, (VALUES (0, 1, 1), (1, 1, 2), (2, 3, 3), (3, 1, 12), (4, 1, 13), (5, 1, 14), (6, 1, 15), (7, 1, 16)) t(chunk, nodes, first_line)",
        "script_skeletons": f"""SELECT {_ID}, chunk::BIGINT AS chunk, signature, CASE chunk WHEN 1 THEN 'let mut with_z: bool = false;' ELSE 'let mut f: String = String::new();' || chr(10) || 'let mut x: '
            || CASE WHEN n_regionkey > 1 THEN 'String = String::new();' ELSE 'bool = false;' END || chr(10) || 'let mut y: bool = false;' END AS header, footer
            FROM nation, (VALUES (1, 'fn func1()', ''), (2, 'fn func2() -> (bool)', '(y)')) t(chunk, signature, footer)""",
        "script_metadata": f"SELECT {_ID}, regexp_replace(lower(n_name), '[^a-z0-9_-]', '-', 'g') AS name, '1.' || n_nationkey || '.3-rc1' AS version FROM nation",
        "script_symbols": f"SELECT {_ID}, symbol, CASE WHEN symbol = 'NATION' THEN n_nationkey::VARCHAR ELSE '1' END AS value FROM nation, (VALUES ('NATION'), ('HAVE_STDIO_H'), ('HAVE_ZLIB_H')) t(symbol)",
        "script_files": f"SELECT {_ID}, 'file' AS role, CASE k WHEN 1 THEN 'Makefile' ELSE 'src/' || n_name || '.h' END AS target, CASE k WHEN 1 THEN 'Makefile.am' ELSE 'src/conf.in' END AS source FROM nation, (VALUES (1), (2)) t(k)",
        "script_packages": f"SELECT {_ID}, 'Z' AS prefix, CASE k WHEN 1 THEN 'zlib' ELSE 'glib-2.0' END AS package, CASE k WHEN 1 THEN '>=' END AS op, CASE k WHEN 1 THEN '1.' || n_regionkey END AS version FROM nation, (VALUES (1), (2)) t(k)",
        "script_options": f"SELECT {_ID}, 'zlib' AS option, 'with' AS kind, 'with_z' AS vars FROM nation",
        "makefile_sources": "SELECT n_name AS file, lower(n_name) AS target, source, CASE source WHEN 'big.c' THEN 1 ELSE 0 END::BIGINT AS n_conds FROM nation, (VALUES ('main.c'), ('util.c'), ('big.c')) t(source)",
    }
