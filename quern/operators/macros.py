"""What macro calls say about a project: files, symbols, substitutions, metadata, options, packages.

Operators on the table ``m4_call(script_id, node_id, exec_id, name, args, guards)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import text
from quern.operators.containment import contained

#: Macros that have no effect on the build.
DROPPED = ("AS_INIT", "AS_ME_PREPARE", "AS_UNAME", "AC_CONFIG_SRCDIR", "AC_PREREQ", "AC_COPYRIGHT", "AC_REVISION", "AH_TOP", "LT_PREREQ", "AC_MSG_CHECKING", "AC_MSG_RESULT", "AC_MSG_NOTICE")


def arg(n: int) -> Column:
    return F.get("args", n)["text"]


def relevant(calls: DataFrame) -> DataFrame:
    return calls.where(~F.col("name").isin(*DROPPED))


def oneshot(calls: DataFrame, effects: DataFrame) -> DataFrame:
    """Second calls of oneshot macros go; macros that a called one requires and nobody calls come before all (exec_id 0).

    effects: name, is_oneshot, requires (array).
    """
    joined = calls.join(effects, "name", "left")
    first = F.row_number().over(Window.partitionBy("script_id", "name").orderBy("exec_id"))
    kept = joined.withColumn("_n", first).where("NOT coalesce(is_oneshot, false) OR _n = 1")
    needed = joined.select("script_id", F.explode("requires").alias("name")).distinct().join(calls.select("script_id", "name").distinct(), ["script_id", "name"], "left_anti")
    none = F.lit(None)
    made = needed.select("script_id", none.cast("bigint").alias("node_id"), F.lit(0).cast("bigint").alias("exec_id"), "name", F.array().cast(calls.schema["args"].dataType).alias("args"), F.array().cast("array<string>").alias("guards"))
    return kept.select(*calls.columns).unionByName(made)


def config_files(calls: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """(script_id, role, target, source) of configuration headers and files; ``target:source`` or a default template.

    files: (script_id, path) keeps what exists.
    """
    tag = F.explode(F.filter(F.split(arg(0), r"\s+"), lambda x: x != "")).alias("tag")
    rows = calls.where(F.col("name").isin("AC_CONFIG_HEADERS", "AC_CONFIG_FILES", "AC_OUTPUT")).select("script_id", F.when(F.col("name") == "AC_CONFIG_HEADERS", "header").otherwise("file").alias("role"), tag)
    target = F.split_part("tag", F.lit(":"), F.lit(1))
    given = F.split_part("tag", F.lit(":"), F.lit(2))
    default = F.concat(target, F.when(target.rlike("(^|/)Makefile$"), ".am").otherwise(".in"))
    out = rows.select("script_id", "role", target.alias("target"), F.when(given != "", given).otherwise(default).alias("source"))
    return out if files is None else out.join(files.select("script_id", F.col("path").alias("source")), ["script_id", "source"], "left_semi").select(*out.columns)


def config_links(calls: DataFrame) -> DataFrame:
    tag = F.explode(F.filter(F.split(arg(0), r"\s+"), lambda x: x != "")).alias("tag")
    return calls.where("name = 'AC_CONFIG_LINKS'").select("script_id", tag).where("tag LIKE '%:%'").select("script_id", F.split_part("tag", F.lit(":"), F.lit(1)).alias("target"), F.split_part("tag", F.lit(":"), F.lit(2)).alias("source"))


def metadata(calls: DataFrame) -> DataFrame:
    """name, version, bug_report, tarname, url of AC_INIT; of each field the last call that gives it counts."""
    fields = [text.crate_name(arg(0)).alias("name"), text.sanitize_version(arg(1)).alias("version"), arg(2).alias("bug_report"), text.crate_name(arg(3)).alias("tarname"), arg(4).alias("url")]
    rows = calls.where("name = 'AC_INIT'").select("script_id", "exec_id", *fields)
    return rows.groupBy("script_id").agg(*[F.max_by(f, F.when(F.col(f).isNotNull(), F.col("exec_id"))).alias(f) for f in ("name", "version", "bug_report", "tarname", "url")])


def cpp_symbols(calls: DataFrame) -> DataFrame:
    """(script_id, symbol, value) that AC_DEFINE, AH_TEMPLATE and AH_VERBATIM name, and what checks define."""
    literal = calls.where(F.col("name").isin("AC_DEFINE", "AC_DEFINE_UNQUOTED") & arg(0).rlike(r"^\w+$")).select("script_id", arg(0).alias("symbol"), arg(1).alias("value"))
    shown = calls.where("name = 'AH_TEMPLATE'").select("script_id", arg(0), F.lit(None).cast("string"))
    raw = calls.where("name = 'AH_VERBATIM'").select("script_id", F.explode(F.regexp_extract_all(arg(1), F.lit(r"#\s*undef\s+(\w+)"), F.lit(1))), F.lit(None).cast("string"))
    names = F.explode(F.filter(F.split(arg(0), r"[\s,]+"), lambda x: x != "")).alias("one")
    probes = calls.where(F.col("name").isin("AC_CHECK_HEADERS", "AC_CHECK_FUNCS")).select("script_id", names).select("script_id", F.concat(F.lit("HAVE_"), text.sanitize_c_name(F.col("one"))), F.lit("1"))
    return literal.union(shown).union(raw).union(probes).distinct()


def error_blocks(nodes: DataFrame) -> DataFrame:
    """Branches (script_id, parent_id, branch) that end in an error."""
    return nodes.where("kind = 'Macro' AND text = 'AC_MSG_ERROR'").select("script_id", "parent_id", "branch").distinct()


def all_path_definitions(events: DataFrame, nodes: DataFrame) -> DataFrame:
    """(script_id, node_id, var): variables that every branch of a node defines which doesn't end in an error; nodes of one branch define nothing so."""
    arms = nodes.where("branch IS NOT NULL").join(error_blocks(nodes), ["script_id", "parent_id", "branch"], "left_anti")
    many = arms.groupBy("script_id", "parent_id").agg(F.countDistinct("branch").alias("_n")).where("_n > 1")
    made = events.where(F.col("event").isin("def", "bound")).select("script_id", "node_id", "var").join(arms, ["script_id", "node_id"]).groupBy("script_id", "parent_id", "var").agg(F.countDistinct("branch").alias("_d"))
    return made.join(many, ["script_id", "parent_id"]).where("_d = _n").select("script_id", F.col("parent_id").alias("node_id"), "var")


def build_options(calls: DataFrame, events: DataFrame, nodes: DataFrame) -> DataFrame:
    """(script_id, option, kind, vars): options of AC_ARG_WITH and AC_ARG_ENABLE and the variables that their actions set."""
    own = calls.where(F.col("name").isin("AC_ARG_WITH", "AC_ARG_ENABLE")).select("script_id", "node_id", F.regexp_replace(arg(0), "[^A-Za-z0-9_]", "_").alias("option"), F.when(F.col("name") == "AC_ARG_WITH", "with").otherwise("enable").alias("kind"))
    spans = own.join(nodes.select("script_id", "node_id", "exec_id", "exit_id"), ["script_id", "node_id"])
    made = events.where("event = 'def' AND var NOT IN ('withval', 'enableval')")
    inside = contained(spans, made, ["script_id"], "exec_id", "exit_id", "exec_id", "node_id", "var", names=("node_id", "var"))
    return own.join(inside.groupBy("script_id", "node_id").agg(F.array_sort(F.collect_set("var")).alias("vars")), ["script_id", "node_id"], "left").select("script_id", "option", "kind", F.coalesce("vars", F.array().cast("array<string>")).alias("vars"))


def features(partitions: DataFrame) -> DataFrame:
    """Features of options: one for a Boolean option, one for each representative but ``no`` of another.

    partitions: option_name, representatives, aliases, enabled_by_default,
    non_boolean_default.  Columns: option_name, feature, values (map from a
    candidate to whether it turns the feature on), enabled_by_default.
    """
    boolean = F.size(F.array_except("representatives", F.array(F.lit("yes"), F.lit("no")))) == 0
    rows = partitions.withColumn("rep", F.explode(F.when(boolean, F.array(F.lit("yes"))).otherwise(F.filter("representatives", lambda r: r != "no"))))
    known = F.array_union("representatives", F.map_keys("aliases"))
    on = F.map_from_entries(F.transform(known, lambda v: F.struct(v.alias("k"), F.coalesce(F.element_at("aliases", v), v).eqNullSafe(F.col("rep")).alias("v"))))
    default = F.when(boolean | (F.col("rep") == "yes"), F.col("enabled_by_default")).otherwise(F.col("enabled_by_default") & F.col("rep").eqNullSafe(F.col("non_boolean_default")))
    name = F.when(F.col("rep") == "yes", F.col("option_name")).otherwise(F.concat_ws("_", "option_name", text.cfg_name(F.col("rep"))))
    return rows.select("option_name", name.alias("feature"), on.alias("values"), default.alias("enabled_by_default"))


def conditionals(calls: DataFrame) -> DataFrame:
    return calls.where("name = 'AM_CONDITIONAL'").select("script_id", arg(0).alias("condition"), arg(1).alias("test"), "guards")


def packages(calls: DataFrame) -> DataFrame:
    """(script_id, prefix, package, op, version) of PKG_CHECK_MODULES, all comparison operators."""
    rows = calls.where("name = 'PKG_CHECK_MODULES'").select("script_id", arg(0).alias("prefix"), F.explode(F.regexp_extract_all(arg(1), F.lit(r"([A-Za-z0-9_.+-]+(?:\s*(?:>=|<=|=|<|>)\s*[0-9][\w.]*)?)"), F.lit(1))).alias("p"))
    part = lambda n: F.nullif(F.regexp_extract("p", r"^([A-Za-z0-9_.+-]+?)\s*(?:(>=|<=|=|<|>)\s*([\w.]+))?$", n), F.lit(""))
    return rows.select("script_id", "prefix", part(1).alias("package"), part(2).alias("op"), part(3).alias("version"))


def installed_packages(wanted: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Packages with what the catalogue (pc_name, sys_package, installed, headers, include_paths) has of them; ``error`` says what is missing."""
    found = wanted.join(catalogue, wanted["package"] == catalogue["pc_name"], "left")
    error = F.when(F.col("pc_name").isNull(), "not found").when(~F.col("installed"), "not installed")
    return found.select(*wanted.columns, "sys_package", F.filter("headers", lambda h: text.is_h_file(h)).alias("headers"), "include_paths", error.alias("error"))


def wrapper_header(includes: DataFrame, installed: DataFrame) -> DataFrame:
    """(sys_package, text): guarded includes of the external headers that a package has, by include directory order.

    includes: (header); installed: sys_package, headers, include_paths.
    """
    have = installed.where("error IS NULL").select("sys_package", F.posexplode("include_paths").alias("place", "dir"), "headers").select("sys_package", "place", "dir", F.explode("headers").alias("path"))
    hit = have.select("sys_package", "place", F.expr("CASE WHEN startswith(path, concat(dir, '/')) THEN substring(path, length(dir) + 2) END").alias("header")).join(includes.select("header").distinct(), "header")
    first = hit.groupBy("header").agg(F.min_by("sys_package", F.struct("place", "sys_package")).alias("sys_package"))
    lines = F.array_join(F.transform(F.array_sort(F.collect_set("header")), lambda h: F.concat(F.lit("#include <"), h, F.lit(">\n"))), "")
    guard = F.concat(F.lit("HAVE_"), text.sanitize_package(F.col("sys_package")))
    return first.groupBy("sys_package").agg(lines.alias("_l")).select("sys_package", F.concat(F.lit("#ifdef "), guard, F.lit("\n"), "_l", F.lit("#endif\n")).alias("text"))
