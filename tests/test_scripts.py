import pytest

from quern.operators import guards, rendering
from quern.operators.analysis import Script, infer
from quern.sources.shell import ScriptError, parse

SCRIPT = """AC_INIT([foo], [1.2])
if test "x$with_z" = xyes && test -n "$CC"; then
  LIBS="$LIBS -lz"
elif test $n -ge 3; then
  LIBS=none
else
  AC_MSG_ERROR([no])
fi
case $host in
  i?86-*-linux*) os=linux ;;
  *) os=other ;;
esac
for f in a b; do
  eval "have_$f=$os"
  eval "v=\\$have_$f"
done
echo $LIBS > out.txt
"""


def test_render_round_trip():
    once = rendering.script(parse(SCRIPT))
    assert rendering.script(parse(once)) == once


@pytest.mark.parametrize("bad", ["if x; then", "case $a in", "echo 'open", "for 1 in a; do b; done", 'a="$b', "FOO=`ls"])
def test_errors_or_values(bad):
    try:
        parse(bad)
    except ScriptError as e:
        assert e.line == 1


def test_guards():
    s = Script(SCRIPT)
    kept = {r.text: r.guards for r in s.rows if r.kind == "Assignment"}
    assert [r.guards for r in s.rows if r.text == "LIBS"][0] == ["(!Var CC Empty & Var with_z True)"]
    assert [r.guards for r in s.rows if r.text == "LIBS"][1] == ["((!Var with_z True | Var CC Empty) & Var n Ge 3)"]
    assert kept["os"] == ["(!ArchGlob Match i?86 | !OsAbiGlob Match linux*)"]
    assert any(r.error_out for r in s.rows)


def test_guard_algebra():
    a, b = guards.atom("Var", "a", "True"), guards.atom("Var", "b", "True")
    g = ("and", [a, ("or", [b, ("const", False)]), ("const", True)])
    assert guards.simplify(g) == ("and", [a, b]) and guards.simplify(guards.simplify(g)) == guards.simplify(g)
    assert guards.negate(guards.negate(g)) == g
    assert guards.contradictory([a, guards.negate(a)]) and not guards.contradictory([a, b])
    assert guards.compare_stacks(["x"], ["x", "y"]) == -1 and guards.compare_stacks(["x"], ["y"]) is None
    assert guards.supported(guards.atom("ArchGlob", "", "Match", "i?86"), ["x86_64", "i686"], []) == guards.atom("Arch", "i686")
    assert guards.supported(guards.atom("ArchGlob", "", "Match", "vax"), ["x86_64"], []) is None


def test_values_names_types():
    s = Script(SCRIPT)
    assert s.values("os") == {"linux", "other"} and s.values("f") == {"a", "b"} and s.values("nothing") == set()
    assert {(n, v) for _, n, v in s.dynamic_names() if n.startswith("have")} == {(f"have_{k}", v) for k in "ab" for v in ("linux", "other")}
    assert {(d, op) for d, op, _, _ in s.dictionaries()} == {("have_@", "Write"), ("have_@", "Read")}
    types = infer(list(s.hints()))
    assert types["n"] == "Integer" and types["LIBS"].startswith("List") and types["with_z"] == "Boolean"


def test_self_reference_ends():
    assert Script("a=$b\nb=$a\nc=$a\n").values("c") == set()


def test_chunks_cover_all_top_nodes_once():
    s = Script(SCRIPT)
    for window in (0, 1, 2, 5):
        ids = [r.node_id for c in s.chunks(window) for r in c]
        assert ids == [r.node_id for r in s.rows if r.parent_id is None]
    assert s.chunks(2, threshold=1)[0][0].node_id == 1 and len([r for c in s.chunks(2, 1) for r in c]) > len(ids)


def test_unused():
    s = Script("a=1\nb=2\necho $a\n")
    assert [r.text for r in s.unused()] == ["b"] and s.unused({"b"}) == []


def test_tables(spark):
    from quern.sources import tables

    parsed = tables.parse_scripts(spark.createDataFrame([("a", SCRIPT), ("bad", "if x; then"), ("none", None)], "script_id string, text string")).cache()
    assert [r.script_id for r in tables.table(parsed, "error").collect()] == ["bad"]
    assert tables.table(parsed, "node").where("script_id = 'a'").count() == len(Script(SCRIPT).rows)
    for name in tables.SCHEMAS:
        tables.table(parsed, name).collect()


def test_stream(spark, tmp_path):
    from quern import streaming

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "configure.ac").write_text("a=1\n")
    q = streaming.parsed_stream(spark, str(tmp_path / "in")).writeStream.format("memory").queryName("parsed").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("parsed").where("tbl = 'node'").count() == 1


def test_rewriting():
    from quern.operators import rewriting

    text = "echo hi\necho x > f\nif a; then\n  echo no\nelif b; then\n  x=1\nelse\n  y=2\nfi\nrm -f f g\nfor i in 1 2; do\n  p=1\n  q=2\n  if t; then break; fi\n  r=3\ndone\ncase $v in\n a) echo z ;;\n *) w=1 ;;\nesac\n"
    nodes = parse(text)
    kept = rewriting.remove(nodes, lambda n: n.kind == "Command" and n.words[0] == [("lit", "echo")])
    shown = rendering.script(kept)
    assert "echo" not in shown and "if ! a && b; then" in shown and "w='1'" in shown
    assert rendering.script(parse(shown)) == shown
    quiet = rewriting.without_messages(nodes)
    assert [n.kind for n in quiet][:2] == ["Redirect", "If"]
    assert rewriting.redirected(nodes) == ["f"] and rewriting.removed_files(nodes) == ["f", "g"]
    assert [(len(r), m) for r, m in rewriting.loop_runs(nodes[4].branches[0][1])] == [(2, False), (1, True), (1, False)]
    flat = rewriting.flatten(nodes, 0)
    assert any(n.kind == "Function" for n in flat) and [n.kind for n in rewriting.flatten(nodes, 100)] == [n.kind for n in nodes]
    assert rewriting.remove(parse("if a; then\n  b\nfi\n"), lambda n: n.kind == "Command") == []


def test_codegen():
    from quern.operators import codegen

    body = lambda b: rendering.body(b, 0)
    one = lambda text: codegen.render(parse(text)[0], body)
    assert one("AC_CHECK_HEADERS([stdio.h zlib.h], [x=1])").count("check_header(") == 2 and "rustc-cfg=have_zlib_h" in one("AC_CHECK_HEADERS([zlib.h])")
    assert 'check_library("deflate", &["z"], &[], false)' in one("AC_CHECK_LIB([z], [deflate])")
    assert "int main" in one("AC_COMPILE_IFELSE([AC_LANG_PROGRAM([[#include <a.h>]], [[f();]])], [x=1], [x=2])")
    assert one("AC_DEFINE_UNQUOTED([V], [\"a$b\"])") == 'println!("cargo:rustc-env=V=a{}", b);'
    assert "run_pkg_config" in one("PKG_CHECK_MODULES([Z], [zlib >= 1.2])") and one("AM_PROG_AR") is None
    assert codegen.banned_names(parse("AM_PROG_AR\nif x; then\n AC_DEFINE([A])\n LT_INIT\nfi\n")) == {"AM_PROG_AR", "LT_INIT"}
    assert codegen.required_functions(one("AC_CHECK_FUNCS([f])")) == ["check_func"]
    assert codegen.assignment(parse("a=yes")[0], "Boolean") == "a = true;" and codegen.assignment(parse('L="$L -lz"')[0], "List<Literal>") == 'L.push("-lz".to_string());'


def test_scopes():
    from quern.operators.analysis import environment_variables, scopes

    s = Script("echo $CC\nx=1\necho done\necho $x\nx=2\necho more\necho other\necho $x\n")
    chunks = s.chunks(0)
    got = {(d["var"], d["index"]): d for d in scopes(s, chunks)}
    assert got["CC", 0]["owner"] is None and got["CC", 0]["readers"] == [0]
    assert ("x", 1) in got and got["x", 0]["owner"] is not None and got["x", 1]["overwriters"] == [got["x", 1]["owner"]]
    assert environment_variables(s, chunks, {"CC", "x", "unseen"}) == {"CC", "unseen"}


def test_build_script_text():
    from quern.plans import runtime

    text = runtime.build_rs(["fn func0() {}"], ['if check_header("a.h") {\n}', 'let p = run_pkg_config("z");'], record_path="r.csv")
    for part in ("fn check_header", "fn compile", "fn run_pkg_config", "fn execute_cmd", "fn main() {", "fn func0", "fn record"):
        assert text.count(part) == 1
    assert "check_sizeof" not in text and text.count("{") == text.count("}")
    assert "chain(A.iter()" in runtime.bindgen_call(["A"]) and "bool" in runtime.environment("v", "Boolean")


@pytest.mark.parametrize("text, value", [("1 + 2 * 3", 7), ("(1 + 2) * 3", 9), ("2 ** 3 ** 2", 512), ("10 - 3 - 2", 5), ("a > 3 ? a : -b", 5), ("!a || b << 2", 1), ("0x10 + 010", 24), ("~0 & 7", 7), ("7 % 4 == 3 && 1", 1)])
def test_arithmetic(text, value):
    """Trees against a plain evaluation, also after printing."""
    from quern.sources import arithmetic

    names = {"a": 5, "b": 2}

    def run(t):
        if t[0] == "num":
            return int(t[1], 16 if t[1][:2] == "0x" else 8 if t[1][0] == "0" and len(t[1]) > 1 else 10)
        if t[0] == "var":
            return names[t[1]]
        if t[0] == "un":
            return {"-": lambda x: -x, "+": lambda x: x, "!": lambda x: int(not x), "~": lambda x: ~x}[t[1]](run(t[2]))
        if t[0] == "cond":
            return run(t[2]) if run(t[1]) else run(t[3])
        a, b = run(t[2]), run(t[3])
        return int(eval(f"{a} {({'&&': 'and', '||': 'or'}).get(t[1], t[1])} {b}".replace("- -", "+ "))) if t[1] not in ("&&", "||") else int(bool(a) and bool(b)) if t[1] == "&&" else int(bool(a) or bool(b))

    tree = arithmetic.parse(text)
    assert run(tree) == value and run(arithmetic.parse(arithmetic.shown(tree))) == value


def test_arithmetic_uses():
    from quern.sources import arithmetic

    assert arithmetic.uses(arithmetic.parse("a = b++ + $c, d += ${e}")) == ["b", "c", "d", "e"]
    for bad in ("1 +", "(2", "a ? b", "1 2", "#"):
        with pytest.raises(ValueError):
            arithmetic.parse(bad)


def test_printer_can_be_overridden():
    from quern.operators import rust

    class Quiet(rust.Printer):
        def visit_command(self, n):
            return ""

    nodes = parse("x=1\necho a\nif test $x = 1; then\n  echo b\n  y=2\nfi\n")
    assert Quiet().body(nodes) == '    x = "1".to_string();\n    if x == "1" {\n        y = "2".to_string();\n    }'
    called = rust.Printer({}, lambda n: "func1(&x);" if n.kind == "If" else None)
    assert called.body(nodes).split("\n")[-1] == "    func1(&x);"


def test_cache_keys(spark, tmp_path):
    """Equal content is computed once; other content, nulls and the places of words count apart."""
    from pyspark.sql import functions as F

    from quern.plans import cache

    kept = cache.Cache(spark, f"file://{tmp_path}/kept", "out string")
    asked = []

    def compute(rows):
        asked.append(rows.count())
        return rows.select("key", F.upper("a").alias("out"))

    rows = spark.createDataFrame([("x", "y"), ("x", "y"), ("xy", ""), ("x", None)], "a string, b string")
    first = sorted(map(str, kept.through(rows, ["a", "b"], compute).select("a", "b", "out").collect()))
    assert first == sorted(map(str, kept.through(rows, ["a", "b"], compute).select("a", "b", "out").collect())) and asked == [3, 0]
    assert len({r.k for r in rows.select(cache.content_key("a", "b").alias("k")).collect()}) == 3
