"""Build options from their declaration to the features that stand for them.

Operators on the tables of scripts: ``options`` (script_id, option, node_id of
the declaration), ``option_vars`` (script_id, option, var), ``assignment``,
``guard_term``, ``node`` and ``var_event``.  What stands within what is found by
containment, by script and range of places.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.operators.containment import contained
from quern.operators.trees import cut

YES, NO = "yes", "no"


def argument_variables(options: DataFrame) -> DataFrame:
    """(script_id, option, var): the variables that an option's declaration sets, and those that hold its argument."""
    named = F.concat(F.col("kind"), F.lit("_"), F.col("option"))
    rows = options.select("script_id", "option", F.explode(F.array_union("vars", F.array(named))).alias("var"))
    return rows.distinct()


def as_arguments(terms: DataFrame, option_vars: DataFrame) -> DataFrame:
    """Atoms of guards with those about an option's variable turned into atoms about the option."""
    known = option_vars.groupBy("script_id", F.col("var").alias("name")).agg(F.min("option").alias("_option"))
    rows = terms.join(known, ["script_id", "name"], "left")
    own = (F.col("atom_kind") == "Var") & F.col("_option").isNotNull()
    return rows.withColumns({"atom_kind": F.when(own, "Arg").otherwise(F.col("atom_kind")), "name": F.when(own, F.col("_option")).otherwise(F.col("name"))}).select(*terms.columns)


def blocks_guarded_by(terms: DataFrame) -> DataFrame:
    """(script_id, name, node_id, guard): branches whose own guard mentions a variable or an argument."""
    return terms.where("atom_kind IN ('Var', 'Arg')").select("script_id", "name", "node_id", "guard").distinct()


def outermost_guarded(terms: DataFrame, nodes: DataFrame) -> DataFrame:
    """(script_id, name, node_id): nodes with such a branch that stand in no other node of the same name."""
    spans = nodes.select("script_id", "node_id", "exec_id", "exit_id")
    own = blocks_guarded_by(terms).select("script_id", "name", "node_id").distinct().join(spans, ["script_id", "node_id"])
    inside = contained(own, own, ["script_id", "name"], "exec_id", "exit_id", "exec_id", "node_id", "node_id", names=("_around", "node_id"))
    return own.select("script_id", "name", "node_id").join(inside, ["script_id", "name", "node_id"], "left_anti")


def contexts(option_vars: DataFrame, terms: DataFrame, nodes: DataFrame, assigned: DataFrame) -> DataFrame:
    """(script_id, option, var): an option's variables and, step by step, those that hold its name and are assigned under a guard about one of them."""
    spans = nodes.select("script_id", "node_id", "exec_id", "exit_id")
    guarded = blocks_guarded_by(terms).select("script_id", F.col("name").alias("var"), "node_id").distinct().join(spans, ["script_id", "node_id"])
    step = cut(contained(guarded, assigned, ["script_id"], "exec_id", "exit_id", "exec_id", "var", "var", names=("var", "_var")).distinct())
    seen = frontier = cut(option_vars.select("script_id", "option", "var").distinct())
    while True:  # ends, for what is seen grows within the names of a script
        new = frontier.join(step, ["script_id", "var"]).where(F.contains("_var", F.col("option"))).select("script_id", "option", F.col("_var").alias("var")).distinct()
        frontier = cut(new.join(seen, ["script_id", "option", "var"], "left_anti"))
        if frontier.isEmpty():
            return seen
        seen = cut(seen.union(frontier))


def value_candidates(context: DataFrame, terms: DataFrame, assigned: DataFrame) -> DataFrame:
    """(script_id, option, value): yes and no, what guards compare an option's variables with, and the literals that they get."""
    cond = F.when(F.col("cond_kind") == "Eq", F.col("operand")).when(F.col("cond_kind") == "True", YES).when(F.col("cond_kind") == "False", NO)
    asked = terms.where("NOT negated AND atom_kind IN ('Var', 'Arg')").select("script_id", F.col("name").alias("var"), cond.alias("value")).where("value IS NOT NULL AND NOT startswith(value, '$')")
    given = assigned.where("value IS NOT NULL AND value <> ''").select("script_id", "var", "value")
    own = context.join(asked.union(given), ["script_id", "var"]).select("script_id", "option", "value")
    return own.union(context.select("script_id", "option", F.explode(F.array(F.lit(YES), F.lit(NO))))).distinct()


def _outside(assigned: DataFrame, options: DataFrame, nodes: DataFrame) -> DataFrame:
    """Assignments that stand in no declaration."""
    spans = options.select("script_id", "node_id").join(nodes.select("script_id", "node_id", "exec_id", "exit_id"), ["script_id", "node_id"])
    inside = contained(spans, assigned, ["script_id"], "exec_id", "exit_id", "exec_id", "node_id", "node_id", names=("_around", "node_id"))
    return assigned.join(inside, ["script_id", "node_id"], "left_anti")


def disabling(assigned: DataFrame, options: DataFrame, option_vars: DataFrame, nodes: DataFrame) -> DataFrame:
    """(script_id, option, node_id): assignments outside of declarations that turn an option off; they are left out."""
    return _outside(assigned, options, nodes).where(F.col("value") == NO).join(option_vars, ["script_id", "var"]).select("script_id", "option", "node_id")


def enabling(assigned: DataFrame, options: DataFrame, option_vars: DataFrame, nodes: DataFrame) -> DataFrame:
    """(script_id, option, node_id, needed_by): assignments outside that turn an option on, with the option under whose truth they stand (null: none).

    The assignment goes; the other option then needs this one.
    """
    on = _outside(assigned, options, nodes).where(F.col("value") == YES).join(option_vars, ["script_id", "var"])
    truth = on.select("script_id", "option", "node_id", F.explode("guards").alias("g")).select("script_id", "option", "node_id", F.regexp_extract("g", r"^Var (\w+) True$", 1).alias("var")).where("var <> ''")
    other = truth.join(option_vars.withColumnRenamed("option", "needed_by"), ["script_id", "var"]).where("needed_by <> option").select("script_id", "option", "node_id", "needed_by").distinct()
    return on.select("script_id", "option", "node_id").join(other, ["script_id", "option", "node_id"], "left")


def pass_through(assigned: DataFrame, option_vars: DataFrame, all_paths: DataFrame, nodes: DataFrame) -> DataFrame:
    """(script_id, node_id, var): assignments of an option's value in the ``*)`` arm of a case on it, to a variable that every arm defines."""
    own = assigned.select("script_id", "node_id", "var", F.explode("uses").alias("_use")).join(option_vars.select("script_id", F.col("var").alias("_use")).distinct(), ["script_id", "_use"])
    place = nodes.where("branch IS NOT NULL").select("script_id", "node_id", "parent_id", "branch")
    cases = nodes.where("kind = 'Case'").select("script_id", F.col("node_id").alias("parent_id"), F.col("arms").alias("_arms"))
    last = own.join(place, ["script_id", "node_id"]).join(cases, ["script_id", "parent_id"]).where("branch = _arms - 1")
    return last.join(all_paths.select("script_id", F.col("node_id").alias("parent_id"), "var"), ["script_id", "parent_id", "var"]).select("script_id", "node_id", "var").distinct()


def without_declarations(nodes: DataFrame, options: DataFrame) -> DataFrame:
    """Nodes without the declarations of options and what stands in them."""
    spans = options.select("script_id", "node_id").join(nodes.select("script_id", "node_id", "exec_id", "exit_id"), ["script_id", "node_id"])
    gone = contained(spans, nodes, ["script_id"], "exec_id", "exit_id", "exec_id", "node_id", "node_id", closed=True, names=("_around", "node_id"))
    return nodes.join(gone, ["script_id", "node_id"], "left_anti")


def used_options(options: DataFrame, context: DataFrame, terms: DataFrame) -> DataFrame:
    """Options that some guard asks for; the others are dropped."""
    asked = context.join(terms.where("atom_kind IN ('Var', 'Arg')").select("script_id", F.col("name").alias("var")).distinct(), ["script_id", "var"])
    return options.join(asked.select("script_id", "option").distinct(), ["script_id", "option"], "left_semi").select(*options.columns)


def touching(events: DataFrame) -> DataFrame:
    """(script_id, var, node_id): every node that defines or uses a variable."""
    return events.select("script_id", "var", "node_id").distinct()


def frozen_macros(calls: DataFrame, effects: DataFrame, legacy: DataFrame, known: DataFrame) -> DataFrame:
    """(script_id, name, target, value): calls of legacy macros whose effects are all known beforehand, with these effects; the calls then go.

    effects: (name, target, kind); legacy: (name); known: (target, value).  A
    macro is frozen if every variable it uses or defines and every symbol has a
    known value; one without effects is frozen with none (target null).
    """
    own = legacy.select("name").distinct().join(effects, "name", "left").join(known.withColumn("_known", F.lit(True)), "target", "left")
    fine = own.groupBy("name").agg(F.bool_and(F.col("target").isNull() | F.coalesce("_known", F.lit(False))).alias("_fine")).where("_fine").select("name")
    return calls.select("script_id", "name").distinct().join(own.join(fine, "name").select("name", "target", "value"), "name")


def input_variables(calls: DataFrame, effects: DataFrame) -> DataFrame:
    """(script_id, var): variables that called macros read from outside."""
    return calls.select("script_id", "name").join(effects.where("kind = 'input'").select("name", F.col("target").alias("var")), "name").select("script_id", "var").distinct()


def without_argument_declarations(calls: DataFrame) -> DataFrame:
    return calls.where("name <> 'AC_ARG_VAR'")
