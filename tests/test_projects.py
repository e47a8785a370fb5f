import json

import pytest
from pyspark.sql import functions as F

from quern.operators import asof, projects, sequences, values
from quern.plans import exports, models
from quern.sources import platforms


def test_makefile(spark):
    content = "A = x\nA += y\nif W\nB = c.c\nelse\nB = d.c\nendif\nA = z \\\n  w\nS = $(S) $(A)\n"
    rows = projects.makefile_variables(spark.createDataFrame([("m", content)], "path string, content string"))
    held = projects.current_values(rows)
    assert [r.word for r in held.where("name = 'A'").orderBy("pos").collect()] == ["z", "w"]
    assert {(r.word, r.conds[0].negated) for r in held.where("name = 'B'").collect()} == {("c.c", False), ("d.c", True)}
    assert {r.word for r in projects.resolve_words(held).where("name = 'S'").collect()} == {"z", "w"}


def test_includes_inline(spark):
    files = spark.createDataFrame([("a", "x\ninclude b\ny"), ("b", "1\ninclude c\n2"), ("c", "z"), ("d", "include gone\nq")], "path string, content string")
    got = {r.path: r.content for r in projects.inline_includes(files).collect()}
    assert got["a"].split() == ["x", "1", "z", "2", "y"] and got["d"].split() == ["q"]


def test_includes_of_cycles_and_chains(spark):
    """Each file once on a way; many includes in one file; chains over the bound are an error."""
    rows = [("p", "1\ninclude q\ninclude q\n2"), ("q", "3\ninclude p\ninclude r"), ("r", "4\ninclude q"), ("many", "\n".join(f"include f{k}" for k in range(40)))] + [(f"f{k}", str(100 + k)) for k in range(40)]
    got = {r.path: r.content.split() for r in projects.inline_includes(spark.createDataFrame(rows, "path string, content string")).collect()}
    assert got["p"] == ["1", "3", "4", "3", "4", "2"] and got["q"] == ["3", "1", "2", "4"] and got["many"] == [str(100 + k) for k in range(40)]
    chain = spark.createDataFrame([(f"c{k}", f"include c{k + 1}" if k < 9 else "end") for k in range(10)], "path string, content string")
    assert {r.content.strip() for r in projects.inline_includes(chain).collect()} == {"end"}
    with pytest.raises(ValueError):
        projects.inline_includes(chain, most=5)


def test_long_chains_of_variables(spark):
    rows = projects.makefile_variables(spark.createDataFrame([("m", "".join(f"V{k} = $(V{k + 1})\n" for k in range(20)) + "V20 = a.c\n")], "path string, content string"))
    held = projects.current_values(rows)
    assert {r.name: r.word for r in projects.resolve_words(held).collect()} == {f"V{k}": "a.c" for k in range(21)}
    with pytest.raises(ValueError):
        projects.resolve_words(held, most=10)


def test_intervals_of_several_ranges(spark):
    ranges = spark.createDataFrame([(1, 0, 10), (1, 20, 30), (2, 0, 30), (2, 20, 30), (2, 20, 30), (3, 5, 5), (None, 1, 2)], "k int, lo int, hi int")
    gaps = spark.createDataFrame([(1, 25, 26), (2, 25, 26), (2, 0, 3), (2, 2, 4), (3, 0, 9)], "k int, a int, b int")
    got = sorted(map(tuple, sequences.subtract_intervals(ranges, gaps, "k", "lo", "hi", "a", "b").collect()), key=str)
    assert got == sorted([(1, 0, 10), (1, 20, 24), (1, 27, 30), (2, 5, 24), (2, 27, 30), (2, 20, 24), (2, 27, 30), (2, 20, 24), (2, 27, 30), (None, 1, 2)], key=str)


def test_buckets_change_nothing(spark):
    rows = spark.range(300).selectExpr("id % 3 AS k", "id AS t", "CASE WHEN id % 17 < 9 THEN 'a' WHEN id % 5 = 0 THEN NULL ELSE 'b' END AS m")
    slot = F.floor(F.col("t") / 13).cast("int")
    same = lambda a, b: sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    assert same(sequences.runs(rows, ["k"], ["t"], "m"), sequences.runs(rows, ["k"], ["t"], "m", slot))
    assert same(sequences.number_rows(rows, ["k"], ["t"]), sequences.number_rows(rows, ["k"], ["t"], bucket=slot).select("k", "t", "m", "exec_id"))
    assert same(sequences.drop_adjacent_repeats(rows, ["k"], ["t"], "m"), sequences.drop_adjacent_repeats(rows, ["k"], ["t"], "m", slot))
    marks, events = rows.where("m = 'a'").select("k", "t"), rows.where("m = 'b'").select("k", "t")
    assert same(asof.counts_around(marks, events, ["k"], ["t"]), asof.counts_around(marks, events, ["k"], ["t"], slot))


def test_headers(spark):
    files = spark.createDataFrame([("src/a.c", '#include "b.h"\n#include <stdio.h>\n'), ("inc/b.h", '#include "c.h"\n'), ("inc/c.h", '#include "b.h"\n')], "path string, content string")
    inside, outside = projects.reached_headers(spark.createDataFrame([("src/a.c",)], "path string"), files, ["inc"])
    assert {r.path for r in inside.collect()} == {"inc/b.h", "inc/c.h"} and [r.header for r in outside.collect()] == ["stdio.h"]


def test_policies(spark):
    files = spark.createDataFrame([("a.c", "#define ALIAS USED\n#ifdef ASKED\n#endif\nint x = ALIAS;\nif (BRANCH) y();\n")], "path string, content string")
    symbols = spark.createDataFrame([(s,) for s in ("USED", "ASKED", "BRANCH", "FROZEN", "GONE", "ON")], "symbol string")
    used = projects.values_used(symbols, files)
    assert [r.symbol for r in used.collect()] == ["USED"]
    frozen = spark.createDataFrame([("FROZEN", "7"), ("GONE", None), ("ON", "1")], "symbol string, value string")
    got = projects.policies(symbols, used, frozen)
    assert {r.symbol: r.type for r in got.collect()} == {"USED": "Env", "ASKED": "Cfg", "BRANCH": "Cfg", "FROZEN": "Fixed", "GONE": "Unset", "ON": "Set"}
    assert json.loads(exports.conditional_map(got).first()[0])["FROZEN"] == {"type": "Fixed", "value": "7"}


def test_header_templates(spark):
    text = "#if @HAVE@\n#define A @X@\n#endif\n#define B \"lit\" /* c */\n#define C (1 + 2)\n"
    got = projects.header_templates(spark.createDataFrame([("h", text)], "path string, content string"))
    assert {(r.symbol, r.subst, r.block) for r in got.collect()} == {("A", "X", "HAVE"), ("B", None, None)}


def test_manifest_and_cost(spark):
    meta = spark.createDataFrame([("a", "foo", None)], "script_id string, name string, version string")
    features = spark.createDataFrame([("a", "z", True), ("a", "y", False)], "script_id string, feature string, enabled_by_default boolean")
    edges = spark.createDataFrame([("a", "y", "z")], "script_id string, feature string, needs string")
    text = exports.manifest(meta, features, edges).first().text
    assert 'name = "foo"' in text and 'version = "0.1.0"' in text and 'default = ["z"]' in text and 'y = ["z"]' in text
    usage = spark.createDataFrame([(1_000_000, 500_000)], "prompt_tokens long, completion_tokens long")
    assert exports.cost(usage).first()[0] == 1.25


def test_partition_rules(spark):
    rows = spark.createDataFrame([("ok", ["yes", "no", "on"], ["yes", "no"], {"on": "yes"}), ("bad", ["yes", "no"], ["maybe"], {"yes": "no"})], "option_name string, candidates array<string>, representatives array<string>, aliases map<string,string>")
    got = {(r.option_name, r.error) for r in values.partition_errors(rows).collect()}
    assert {o for o, _ in got} == {"bad"} and len(got) == 4


def test_models(spark):
    asked = spark.createDataFrame([("1", "a"), ("2", "b")], "request_id string, request string")

    def provider(prompt: str) -> str:
        if "Input:\nb" in prompt:
            raise RuntimeError("down")
        return '{"ok": true}' if "was wrong" in prompt else "not json"

    rows = {r.request_id: r for r in models.ask(asked, provider, lambda q, a: [], retries=3).collect()}
    assert rows["1"].answer == '{"ok": true}' and rows["1"].attempts == 2
    assert rows["2"].answer is None and "down" in rows["2"].error and rows["2"].attempts == 3


def test_translation_rules(spark):
    rows = spark.createDataFrame([(1, "f", "fn f() { a }", ["a"], ["__P__"], ["bad"])], "chunk long, name string, source string, snippets array<string>, placeholders array<string>, banned array<string>")
    assert [r.error for r in models.translation_errors(rows).collect()] == ["missing placeholder: __P__"]


def test_platforms(spark, tmp_path):
    (tmp_path / "t.json").write_text(json.dumps({"x": {"arch": "x86", "os": "linux", "env": None, "abi": None, "tier": 1}, "y": {"arch": "arm", "os": "linux", "env": None, "abi": None}}))
    got = platforms.triplets(spark, str(tmp_path / "t.json"))
    assert [r.name for r in platforms.supported(got, "arch").orderBy("place").collect()] == ["arm", "x86"]
    assert platforms.compiler_directories("a\n#include <...> search starts here:\n /usr/include\nEnd of search list.\n") == ["/usr/include"]


def test_propagate_is_order_free(spark):
    types = spark.createDataFrame([("a", "Integer"), ("b", "Literal"), ("c", "Literal"), ("d", "Path")], "var string, type string")
    edges = spark.createDataFrame([("a", "b"), ("d", "c"), ("a", "c")], "src string, dst string")
    got = {r["var"]: r["type"] for r in values.propagate_types(types, edges, "var", "src", "dst").collect()}
    assert got == {"a": "Integer", "b": "Integer", "c": "Literal", "d": "Path"}


def test_product_and_candidates(spark):
    rows = spark.range(1).select(values.product([F.array(F.lit("a"), F.lit("b")), F.array(F.lit("1"))]).alias("p"), values.product([F.array().cast("array<string>")]).alias("q"), values.product([]).alias("r")).first()
    assert rows.p == [["a", "1"], ["b", "1"]] and rows.q == [] and rows.r == [[]]
    found = values.candidates(spark.createDataFrame([("k", str(x)) for x in range(12, 0, -1)] + [("t", "b"), ("t", "a"), ("t", "a")], "k string, v string"), ["k"], "v")
    got = {r.k: r.candidates for r in found.collect()}
    assert got["k"] == [str(x) for x in range(1, 11)] and got["t"] == ["a", "a", "b"]


def test_resolved_sources_are_not_broadcast(spark):
    """However small the tables look: the paths of all files never go through the driver."""
    names = spark.createDataFrame([("m", "t", "a"), ("m", "t", "b"), ("m", "u", "gone")], "file string, target string, source string")
    files, built = (spark.createDataFrame([(p,) for p in ps], "path string") for ps in (["a.c", "a.cc", "b.cc"], ["b.c", "b.c"]))
    found = projects.resolve_sources(names, files, built)
    assert sorted(map(tuple, found.collect())) == [("m", "t", "a", "a.c"), ("m", "t", "b", "b.c")]
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
