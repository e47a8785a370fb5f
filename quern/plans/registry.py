"""All registered queries of the engine, and their SQL: its operators applied to the ordinary tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.functions import globs, text
from quern.operators import asof, containment, globjoin, graphs, sequences, trees, values, valuesets

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
    from quern.plans import case_queries, project_queries, script_queries, table_queries

    return QUERIES | script_queries.queries() | case_queries.queries() | project_queries.queries() | table_queries.queries()


def oracle_sql() -> dict[str, str]:
    from quern.plans import case_queries, project_queries, script_queries, table_queries

    return SQL | script_queries.oracle_sql() | case_queries.oracle_sql() | project_queries.oracle_sql() | table_queries.oracle_sql()


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def events(spark, d, kind=None) -> DataFrame:
    rows = table(spark, d, "events")
    return rows.where(F.col("event_type") == kind) if kind else rows


def _reached(spark, d):
    return asof.last_definition(events(spark, d, "click").select("user_id", "ts", "event_id"), events(spark, d, "purchase").select("event_id", "user_id", "ts"), ["user_id"], ["ts"], "event_id", F.to_date("ts"), "def_event_id")


_REACHED = "SELECT p.event_id, p.user_id, c.event_id AS def_event_id FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'click') c ON p.user_id = c.user_id AND p.ts > c.ts"


@query(_REACHED)
def asof_last_definition(spark, d):
    return _reached(spark, d).drop("ts")


_GUARD = "CASE event_id % 3 WHEN 0 THEN '' WHEN 1 THEN 'a' ELSE CASE WHEN event_id % 2 = 0 THEN 'a/b' ELSE 'a/c' END END"


@query(f"""
WITH e AS (SELECT *, {_GUARD} AS g FROM events)
SELECT event_id, def_event_id FROM (
  SELECT p.event_id, c.event_id AS def_event_id, row_number() OVER (PARTITION BY p.event_id ORDER BY c.ts DESC NULLS LAST) AS r
  FROM (SELECT * FROM e WHERE event_type = 'purchase') p LEFT JOIN (SELECT * FROM e WHERE event_type = 'click') c
    ON p.user_id = c.user_id AND c.ts < p.ts AND (c.g = '' OR c.g = p.g OR starts_with(p.g, c.g || '/'))) WHERE r = 1""")
def asof_dominant_definition(spark, d):
    guard = F.filter(F.split(F.expr(_GUARD), "/"), lambda x: x != "")
    rows = events(spark, d).withColumn("guard", guard).select("event_id", "user_id", "ts", "event_type", "guard")
    found = asof.dominant_definition(rows.where("event_type = 'click'"), rows.where("event_type = 'purchase'"), ["user_id"], ["ts"], "event_id", "guard", "event_id", "def_event_id", F.to_date("ts"))
    return found.select("event_id", "def_event_id")


def _around(spark, d):
    return asof.counts_around(events(spark, d, "error").select("event_id", "user_id", "ts"), events(spark, d).where("event_type <> 'error'").select("user_id", "ts"), ["user_id"], ["ts"], F.to_date("ts"))


@query("SELECT e.event_id, (SELECT count(*) FROM events o WHERE o.user_id = e.user_id AND o.ts < e.ts AND o.event_type <> 'error') AS n_before FROM events e WHERE e.event_type = 'error'")
def defs_before(spark, d):
    return _around(spark, d).select("event_id", "n_before")


@query("SELECT e.event_id, (SELECT count(*) FROM events o WHERE o.user_id = e.user_id AND o.ts > e.ts AND o.event_type <> 'error') AS n_after FROM events e WHERE e.event_type = 'error'")
def uses_after(spark, d):
    return _around(spark, d).select("event_id", "n_after")


@query("""
WITH p AS (SELECT event_id, user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS since FROM events WHERE event_type = 'purchase')
SELECT p.event_id, c.event_id AS def_event_id FROM p JOIN events c ON c.event_type = 'click' AND c.user_id = p.user_id AND c.ts < p.ts AND (p.since IS NULL OR c.ts > p.since)""")
def all_definitions_between(spark, d):
    """For every purchase all clicks of the user since the purchase before it."""
    before = Window.partitionBy("user_id").orderBy("ts", "event_id")
    uses = events(spark, d, "purchase").select("event_id", "user_id", "ts", F.lag("ts").over(before).alias("since"))
    defs = events(spark, d, "click").select("user_id", "ts", "event_id")
    return asof.definitions_before(defs, uses, ["user_id"], ["ts"], "event_id", F.to_date, ["since"], "def_event_id").select("event_id", "def_event_id")


@query("SELECT e.event_id, p.event_id AS use_event_id FROM events e JOIN events p ON e.event_type = 'error' AND p.event_type = 'purchase' AND e.user_id = p.user_id AND (p.ts > e.ts OR p.ts = e.ts AND p.event_id > e.event_id)")
def all_usages_after(spark, d):
    """For every error all purchases of the user after it."""
    columns = ("event_id", "user_id", "ts")
    marks = events(spark, d, "error").select(*columns)
    return asof.usages_after(events(spark, d, "purchase").select(*columns), marks, ["user_id"], ["ts", "event_id"], "event_id", F.to_date, out="use_event_id").select("event_id", "use_event_id")


@query(f"SELECT def_event_id, string_agg(event_id::VARCHAR, ',' ORDER BY event_id) AS uses FROM ({_REACHED}) WHERE def_event_id IS NOT NULL GROUP BY 1")
def def_use_edges(spark, d):
    return asof.def_use_edges(_reached(spark, d), "def_event_id", "event_id").select("def_event_id", F.array_join(F.col("uses").cast("array<string>"), ",").alias("uses"))


@query("SELECT event_id, user_id FROM events c WHERE event_type = 'click' AND NOT EXISTS (SELECT 1 FROM events p WHERE p.event_type = 'purchase' AND p.user_id = c.user_id AND p.ts > c.ts)")
def unused_definitions(spark, d):
    return asof.unused_definitions(events(spark, d, "click").select("event_id", "user_id", "ts"), events(spark, d, "purchase"), ["user_id"], "ts").drop("ts")


@query("SELECT user_id FROM events WHERE event_type IN ('click', 'purchase', 'view') GROUP BY user_id HAVING count(DISTINCT event_type) = 3")
def all_branch_intersection(spark, d):
    return asof.in_all_branches(events(spark, d), ["user_id"], "event_type", ["click", "purchase", "view"])


@query("SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS r FROM events) WHERE r = 1")
def oneshot_first_call(spark, d):
    return asof.first_calls(events(spark, d).select("user_id", "event_type", "event_id", "ts"), ["user_id", "event_type"], ["ts", "event_id"]).drop("ts")


@query("SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS exec_id FROM events")
def exec_numbering(spark, d):
    return sequences.number_rows(events(spark, d).select("event_id", "user_id", "ts"), ["user_id"], ["ts", "event_id"], bucket=F.to_date("ts")).select("event_id", F.col("exec_id").cast("bigint").alias("exec_id"))


_RUNS = "SELECT *, sum(CASE WHEN before IS DISTINCT FROM event_type AND n > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events)"


@query(f"SELECT user_id, run::BIGINT AS run, event_type, count(*) AS size FROM ({_RUNS}) GROUP BY 1, 2, 3")
def runs_islands(spark, d):
    return sequences.runs(events(spark, d).select("user_id", "ts", "event_id", "event_type"), ["user_id"], ["ts", "event_id"], "event_type", F.to_date("ts")).select("user_id", "run", "event_type", "size")


@query(f"SELECT event_id, event_type FROM ({_RUNS}) WHERE n = 1 OR before IS DISTINCT FROM event_type")
def adjacent_dedup(spark, d):
    return sequences.drop_adjacent_repeats(events(spark, d).select("user_id", "ts", "event_id", "event_type"), ["user_id"], ["ts", "event_id"], "event_type", F.to_date("ts")).select("event_id", "event_type")


@query("""
WITH r AS (SELECT o_orderkey AS k, n, o_orderkey % 50 + 40 * n AS lo, o_orderkey % 50 + 40 * n + 25 AS hi FROM orders, (VALUES (0), (1)) t(n)),
g AS (SELECT l_orderkey AS k, l_partkey % 100 AS a, l_partkey % 100 + l_linenumber AS b FROM lineitem),
p AS (SELECT k, n, unnest(range(lo, hi + 1)) AS x FROM r),
f AS (SELECT p.* FROM p WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.k = p.k AND p.x BETWEEN g.a AND g.b)),
i AS (SELECT k, n, x, x - row_number() OVER (PARTITION BY k, n ORDER BY x) AS island FROM f)
SELECT k, min(x) AS lo, max(x) AS hi FROM i GROUP BY k, n, island""")
def interval_subtract(spark, d):
    lo = F.col("o_orderkey") % 50 + 40 * F.col("n")
    ranges = table(spark, d, "orders").withColumn("n", F.explode(F.array(F.lit(0), F.lit(1)))).select(F.col("o_orderkey").alias("k"), lo.alias("lo"), (lo + 25).alias("hi"))
    gaps = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), (F.col("l_partkey") % 100).alias("a"), (F.col("l_partkey") % 100 + F.col("l_linenumber")).alias("b"))
    return sequences.subtract_intervals(ranges, gaps, "k", "lo", "hi", "a", "b")


@query("""
WITH RECURSIVE t AS (SELECT user_id, event_id, event_type AS x, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
s AS (
  SELECT user_id, n, 0::BIGINT AS chunk, [x] AS have FROM t WHERE n = 1
  UNION ALL
  SELECT s.user_id, CASE WHEN NOT list_contains(s.have, a.x) AND list_contains(s.have, b.x) THEN b.n ELSE a.n END,
    CASE WHEN list_contains(s.have, a.x) OR coalesce(list_contains(s.have, b.x), false) THEN s.chunk ELSE s.chunk + 1 END,
    CASE WHEN list_contains(s.have, a.x) THEN s.have WHEN list_contains(s.have, b.x) THEN list_append(s.have, a.x) ELSE [a.x] END
  FROM s JOIN t a ON a.user_id = s.user_id AND a.n = s.n + 1 LEFT JOIN t b ON b.user_id = s.user_id AND b.n = s.n + 2
)
SELECT t.event_id, s.chunk FROM t ASOF JOIN s ON t.user_id = s.user_id AND t.n <= s.n""")
def chunk_lookahead(spark, d):
    rows = events(spark, d).select("user_id", "event_id", "ts", F.array("event_type").alias("defines"), F.array("event_type").alias("uses"))
    return sequences.look_ahead_chunks(rows, ["user_id"], ["ts", "event_id"], "defines", "uses", 2).select("event_id", "chunk")


@query("""
WITH RECURSIVE t AS (SELECT user_id, event_id, event_type AS x, event_type = 'error' AS cut, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
s AS (
  SELECT user_id, n, 0::BIGINT AS chunk, [x] AS have FROM t WHERE n = 1
  UNION ALL
  SELECT s.user_id, CASE WHEN NOT a.cut AND NOT list_contains(s.have, a.x) AND list_contains(s.have, b.x) THEN b.n ELSE a.n END,
    CASE WHEN NOT a.cut AND (list_contains(s.have, a.x) OR coalesce(list_contains(s.have, b.x), false)) THEN s.chunk ELSE s.chunk + 1 END,
    CASE WHEN a.cut THEN [a.x] WHEN list_contains(s.have, a.x) THEN s.have WHEN list_contains(s.have, b.x) THEN list_append(s.have, a.x) ELSE [a.x] END
  FROM s JOIN t a ON a.user_id = s.user_id AND a.n = s.n + 1 LEFT JOIN t b ON b.user_id = s.user_id AND b.n = s.n + 2
)
SELECT t.event_id, s.chunk FROM t ASOF JOIN s ON t.user_id = s.user_id AND t.n <= s.n""")
def chunk_cuts(spark, d):
    """The same where an error that comes next begins a chunk."""
    rows = events(spark, d).select("user_id", "event_id", "ts", F.array("event_type").alias("defines"), F.array("event_type").alias("uses"), (F.col("event_type") == "error").alias("cut"))
    return sequences.look_ahead_chunks(rows, ["user_id"], ["ts", "event_id"], "defines", "uses", 2, cut="cut").select("event_id", "chunk")


def _places(spark, d):
    r, n, c, s = (table(spark, d, t) for t in ("region", "nation", "customer", "supplier"))
    return (
        r.select(F.concat(F.lit("r"), "r_regionkey").alias("node"), F.lit(None).cast("string").alias("parent"))
        .union(n.select(F.concat(F.lit("n"), "n_nationkey"), F.concat(F.lit("r"), "n_regionkey")))
        .union(c.select(F.concat(F.lit("c"), "c_custkey"), F.concat(F.lit("n"), "c_nationkey")))
        .union(s.select(F.concat(F.lit("s"), "s_suppkey"), F.concat(F.lit("n"), "s_nationkey")))
    )


_PLACES = "SELECT 'r' || r_regionkey AS node, NULL AS parent FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier"


_BELOW = f"WITH RECURSIVE t AS ({_PLACES}), p AS (SELECT node, parent AS up FROM t WHERE parent IS NOT NULL UNION ALL SELECT p.node, t.parent FROM p JOIN t ON p.up = t.node WHERE t.parent IS NOT NULL)"


def _numbered(spark, d):
    """The tree as nested sets under each root: a node ends where its last descendant does.  A root is dealt by the nodes below it."""
    tree = trees.paths(_places(spark, d), "node", "parent").withColumn("root", F.get("path", 0))
    placed = sequences.number_rows(tree, ["root"], ["path"], "exec_id", F.get("path", 1))
    sizes = tree.select(F.explode("path").alias("node")).groupBy("node").count()
    return placed.join(sizes, "node").select("root", "node", "exec_id", (F.col("exec_id") + F.col("count")).alias("exit_id"))


@query(f"{_BELOW} SELECT up AS ancestor, count(*) AS n FROM p GROUP BY 1")
def nested_set_descendants(spark, d):
    nodes = _numbered(spark, d)
    return nodes.select(F.col("node").alias("ancestor"), (F.col("exit_id") - F.col("exec_id") - 1).alias("n")).where("n > 0")


@query(f"{_BELOW} SELECT up AS ancestor, node AS descendant FROM p")
def contained_descendants(spark, d):
    """The same pairs from numbers alone: what begins within a node stands below it."""
    return trees.descendants(_numbered(spark, d), "root", "node").drop("root")


@query("SELECT o.o_orderkey, l.l_orderkey, l.l_linenumber::BIGINT AS l_linenumber FROM lineitem l JOIN orders own ON own.o_orderkey = l.l_orderkey JOIN orders o ON o.o_custkey = own.o_custkey AND o.o_orderdate::DATE < l.l_shipdate::DATE AND l.l_shipdate::DATE < o.o_orderdate::DATE + 60")
def orders_around_shipments(spark, d):
    """For every line the orders of its customer that were under sixty days old when it was sent."""
    day = lambda c: F.unix_date(F.to_date(c))
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("customer"), day("o_orderdate").alias("lo"), (day("o_orderdate") + 60).alias("hi"))
    lines = table(spark, d, "lineitem").join(o.select(F.col("o_orderkey").alias("l_orderkey"), "customer"), "l_orderkey").select("customer", F.struct("l_orderkey", F.col("l_linenumber").cast("bigint").alias("l_linenumber")).alias("line"), day("l_shipdate").alias("at"))
    return containment.contained(o, lines, ["customer"], "lo", "hi", "at", "o_orderkey", "line", width=365).select(F.col("interval").alias("o_orderkey"), "place.*")


@query(f"{_BELOW} SELECT up AS ancestor, node AS descendant FROM p")
def tree_descendants(spark, d):
    return trees.descendants_of_paths(trees.paths(_places(spark, d), "node", "parent"))


@query("""
WITH c AS (SELECT c_custkey, [n_regionkey, 100 + c_nationkey, 1000 + c_custkey] AS p FROM customer JOIN nation ON c_nationkey = n_nationkey)
SELECT a.c_custkey, CASE WHEN a.p[1] <> b.p[1] THEN 0 WHEN a.p[2] <> b.p[2] THEN 1 ELSE 2 END::BIGINT AS shared FROM c a JOIN c b ON b.c_custkey = a.c_custkey + 1""")
def ancestor_prefix(spark, d):
    c = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.array(F.col("n_regionkey").cast("bigint"), 100 + F.col("c_nationkey").cast("bigint"), 1000 + F.col("c_custkey")).alias("p"))
    other = c.select((F.col("c_custkey") - 1).alias("c_custkey"), F.col("p").alias("q"))
    return c.join(other, "c_custkey").select("c_custkey", F.size(sequences.common_prefix(F.col("p"), F.col("q"))).cast("bigint").alias("shared"))


_SORTED = " UNION ALL ".join([
    "SELECT 'r' || r_regionkey AS node, r_regionkey AS root, '~' AS k FROM region",
    "SELECT 'n' || n_nationkey, n_regionkey, lpad(n_nationkey::VARCHAR, 2, '0') || '~' FROM nation",
    "SELECT 'c' || c_custkey, n_regionkey, lpad(c_nationkey::VARCHAR, 2, '0') || 'c' || lpad(c_custkey::VARCHAR, 9, '0') FROM customer JOIN nation ON c_nationkey = n_nationkey",
    "SELECT 's' || s_suppkey, n_regionkey, lpad(s_nationkey::VARCHAR, 2, '0') || 's' || lpad(s_suppkey::VARCHAR, 9, '0') FROM supplier JOIN nation ON s_nationkey = n_nationkey",
])


@query(f"SELECT node, row_number() OVER (PARTITION BY root ORDER BY k) AS place FROM ({_SORTED})")
def postorder_topo(spark, d):
    r, n, c, s = (table(spark, d, t) for t in ("region", "nation", "customer", "supplier"))
    pair = lambda kind, key: F.struct(F.lit(kind).alias("kind"), F.col(key).cast("bigint").alias("id"))
    above = F.when(F.lit(False), pair("r", "r_regionkey"))
    nodes = r.select(pair("r", "r_regionkey").alias("node"), above.alias("parent")).union(n.select(pair("n", "n_nationkey"), pair("r", "n_regionkey")))
    nodes = nodes.union(c.select(pair("c", "c_custkey"), pair("n", "c_nationkey"))).union(s.select(pair("s", "s_suppkey"), pair("n", "s_nationkey")))
    placed = trees.post_order(trees.paths(nodes, "node", "parent").withColumn("root", F.get("path", 0)), ["root"])
    return placed.select(F.concat("node.kind", F.col("node.id").cast("string")).alias("node"), F.col("place").cast("bigint").alias("place"))


_LINKS = "SELECT DISTINCT s_nationkey AS src, (s_suppkey * 7 + s_nationkey) % 25 AS dst FROM supplier"


@query(f"WITH RECURSIVE e AS ({_LINKS}), c AS (SELECT src, dst FROM e UNION SELECT c.src, e.dst FROM c JOIN e ON c.dst = e.src) SELECT src::BIGINT AS src, dst::BIGINT AS dst FROM c")
def transitive_closure(spark, d):
    links = table(spark, d, "supplier").select(F.col("s_nationkey").cast("bigint").alias("src"), F.expr("(s_suppkey * 7 + s_nationkey) % 25").cast("bigint").alias("dst"))
    return graphs.closure(links)


_DEPENDS = "SELECT e.event_id AS parent, c.event_id AS child FROM events e JOIN events c ON e.event_id <> c.event_id AND c.event_id IN (e.event_id // 2, e.event_id // 3)"


@query(f"""
WITH RECURSIVE e AS ({_DEPENDS}), p AS (SELECT event_id AS node, 0::BIGINT AS depth FROM events UNION SELECT e.parent, depth + 1 FROM p JOIN e ON e.child = p.node)
SELECT node AS event_id, max(depth) AS layer, NULL AS error FROM p GROUP BY 1""")
def graph_layers(spark, d):
    """Each event needs those of half and a third of its number: a graph with shared children, children first."""
    e = events(spark, d).select("event_id")
    needs = e.select(F.col("event_id").alias("parent"), F.explode(F.array(F.expr("event_id DIV 2"), F.expr("event_id DIV 3"))).alias("child")).where("parent <> child")
    return graphs.layers(e, needs, "event_id", "parent", "child")


@query(f"WITH RECURSIVE e AS ({_DEPENDS}), r AS (SELECT event_id AS start, event_id AS node FROM events WHERE event_id % 97 = 0 UNION SELECT r.start, e.child FROM r JOIN e ON e.parent = r.node) SELECT start, node FROM r")
def graph_reach(spark, d):
    """All that every 97th event needs, by steps that double."""
    e = events(spark, d).select("event_id")
    needs = e.select(F.col("event_id").alias("parent"), F.explode(F.array(F.expr("event_id DIV 2"), F.expr("event_id DIV 3"))).alias("child")).where("parent <> child")
    needs = needs.join(e.select(F.col("event_id").alias("child")), "child", "left_semi")
    start = e.where("event_id % 97 = 0").select(F.col("event_id").alias("start"), F.col("event_id").alias("node"))
    return graphs.reached(start, needs, ["start"], "node", "parent", "child")


@query(f"""
WITH n AS ({_SORTED}), c AS (SELECT DISTINCT 'n' || s_nationkey AS nation FROM supplier WHERE s_acctbal < 0 UNION SELECT 's' || s_suppkey FROM supplier WHERE s_acctbal < 0),
w AS (SELECT nation AS node FROM c UNION SELECT DISTINCT 'r' || n_regionkey FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_acctbal < 0)
SELECT n.node, row_number() OVER (PARTITION BY root ORDER BY k) AS place FROM n JOIN w ON n.node = w.node""")
def closed_post_order(spark, d):
    """Suppliers with debts and the places they stand in, children first."""
    r, n, s = (table(spark, d, t) for t in ("region", "nation", "supplier"))
    pair = lambda kind, key: F.struct(F.lit(kind).alias("kind"), F.col(key).cast("bigint").alias("id"))
    nodes = r.select(pair("r", "r_regionkey").alias("node"), F.when(F.lit(False), pair("r", "r_regionkey")).alias("parent")).union(n.select(pair("n", "n_nationkey"), pair("r", "n_regionkey"))).union(s.select(pair("s", "s_suppkey"), pair("n", "s_nationkey")))
    tree = trees.paths(nodes, "node", "parent").withColumn("root", F.get("path", 0))
    placed = graphs.closed_post_order(tree, s.where("s_acctbal < 0").select(pair("s", "s_suppkey").alias("node")), ["root"])
    return placed.select(F.concat("node.kind", F.col("node.id").cast("string")).alias("node"), F.col("place").cast("bigint").alias("place"))


@query("""SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS target FROM pages""")
def include_extraction(spark, d):
    return table(spark, d, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("target"))


@query("""SELECT page_id, regexp_replace(html, '("(?:\\\\.|[^"\\\\])*")|/\\*(?s:.*?)\\*/|//[^\\n]*', '\\1 ', 'g') AS html FROM pages""")
def comment_strip(spark, d):
    return table(spark, d, "pages").select("page_id", text.strip_comments(F.col("html")).alias("html"))


@query("""SELECT doc_id, regexp_replace(replace(text, '.' || chr(10), '\\' || chr(10)), '\\\\[ \\t]*\\n', ' ', 'g') AS text FROM documents""")
def continuation_merge(spark, d):
    return table(spark, d, "documents").select("doc_id", text.merge_continuations(F.replace("text", F.lit(".\n"), F.lit("\\\n"))).alias("text"))


@query("SELECT doc_id FROM documents WHERE regexp_matches(text, '(^|[^A-Za-z0-9_])and([^A-Za-z0-9_]|$)')")
def value_usage_whole_word(spark, d):
    return table(spark, d, "documents").where(text.has_word(F.col("text"), "and")).select("doc_id")


@query("SELECT p_partkey, p_name FROM part WHERE p_name GLOB '*[a-e]?*[!0-9]'")
def glob_match(spark, d):
    return table(spark, d, "part").where(globs.glob_match(F.col("p_name"), "*[a-e]?*[!0-9]")).select("p_partkey", "p_name")


@query("SELECT p_partkey, p_brand FROM part WHERE regexp_full_match(p_brand, 'Brand#[1-3][24]')")
def glob_enumerate(spark, d):
    patterns = spark.createDataFrame([("Brand#[1-3][24]",)], "pattern string")
    strings = patterns.select(F.explode(globs.glob_enumerate("pattern")).alias("p_brand"))
    return table(spark, d, "part").join(F.broadcast(strings), "p_brand").select("p_partkey", "p_brand")


_PATTERNS = ("*", "PROMO*", "*A?*", "[A-M]*", "nothing*")


@query(f"WITH p(pattern) AS (VALUES {', '.join(repr((x,)).replace(',)', ')') for x in _PATTERNS)}) SELECT pattern, (SELECT p_type FROM part WHERE p_type GLOB pattern ORDER BY length(p_type), p_type LIMIT 1) AS match FROM p")
def glob_theta_platform(spark, d):
    return globjoin.first_match(spark.createDataFrame([(p,) for p in _PATTERNS], "pattern string"), table(spark, d, "part"), "pattern", "p_type")


_NAME_PATTERNS = "SELECT DISTINCT CASE n_nationkey % 5 WHEN 0 THEN upper(substr(n_name, 2, 3)) || '*' WHEN 1 THEN '*' || substr(n_name, 1, 2) || '*' WHEN 2 THEN '*[' || substr(n_name, 1, 3) || ']?' WHEN 3 THEN '?' || substr(n_name, 2, 2) || '*' ELSE repeat('?', n_nationkey) END AS pattern FROM nation UNION SELECT DISTINCT substr(p_type, 1, 4) || '*' || substr(p_type, -3) FROM part"


@query(f"WITH p AS ({_NAME_PATTERNS}), n AS (SELECT DISTINCT p_type AS name FROM part UNION SELECT DISTINCT n_name FROM nation) SELECT pattern, name FROM p JOIN n ON name GLOB pattern")
def glob_pairs(spark, d):
    """Patterns made from names, with all names that each matches."""
    n, part = table(spark, d, "nation"), table(spark, d, "part")
    made = F.expr("CASE n_nationkey % 5 WHEN 0 THEN concat(upper(substr(n_name, 2, 3)), '*') WHEN 1 THEN concat('*', substr(n_name, 1, 2), '*') WHEN 2 THEN concat('*[', substr(n_name, 1, 3), ']?') WHEN 3 THEN concat('?', substr(n_name, 2, 2), '*') ELSE repeat('?', n_nationkey) END")
    patterns = n.select(made.alias("pattern")).union(part.select(F.concat(F.substring("p_type", 1, 4), F.lit("*"), F.substring("p_type", -3, 3))))
    return globjoin.glob_pairs(patterns, part.select(F.col("p_type").alias("name")).union(n.select("n_name")), "pattern", "name")


@query("""
WITH k AS (SELECT n_nationkey AS k, lower(n_name) AS name FROM nation),
p AS (SELECT k, name, CASE WHEN k % 3 = 0 THEN 'i?86' WHEN k % 3 = 1 THEN left(name, 2) || '*' ELSE 'sparc' END AS arch_pattern, CASE WHEN k % 4 = 0 THEN '*mingw*' ELSE '*' || right(name, 2) END AS os_pattern FROM k)
SELECT 'arch' AS part, arch_pattern AS pattern, coalesce((SELECT name FROM k WHERE k.name GLOB arch_pattern ORDER BY length(name), name LIMIT 1), CASE WHEN 'i386' GLOB arch_pattern THEN 'x86' END) AS arch, NULL AS os, NULL AS env FROM p
UNION ALL SELECT 'os', os_pattern, NULL, coalesce((SELECT name FROM k WHERE k.name GLOB os_pattern ORDER BY length(name), name LIMIT 1), CASE WHEN 'mingw' GLOB os_pattern THEN 'windows' END),
  CASE WHEN NOT EXISTS (SELECT 1 FROM k WHERE k.name GLOB os_pattern) AND 'mingw' GLOB os_pattern THEN 'gnu' END FROM p""")
def platform_alternatives(spark, d):
    """Patterns of architectures and systems, with what is supported or what stands for it."""
    name = F.lower("n_name")
    n = table(spark, d, "nation")
    arch = F.when(F.col("n_nationkey") % 3 == 0, "i?86").when(F.col("n_nationkey") % 3 == 1, F.concat(F.substring(name, 1, 2), F.lit("*"))).otherwise("sparc")
    os_ = F.when(F.col("n_nationkey") % 4 == 0, "*mingw*").otherwise(F.concat(F.lit("*"), F.substring(name, -2, 2)))
    patterns = n.select(F.lit("arch").alias("part"), arch.alias("pattern")).union(n.select(F.lit("os"), os_))
    return globjoin.platform_atoms(patterns, n.select(name.alias("arch"), name.alias("os")))


@query(r"SELECT p_partkey, regexp_replace(regexp_replace(regexp_replace(p_brand, '^\$', ''), '[^A-Za-z0-9_]', '_', 'g'), '^([0-9])', '_\1') AS name FROM part")
def as_tr_sh(spark, d):
    return table(spark, d, "part").select("p_partkey", text.as_tr_sh(F.col("p_brand")).alias("name"))


@query("SELECT c_custkey, regexp_replace(upper(replace(c_name, '*', 'P')), '[^A-Z0-9]', '_', 'g') AS macro, lower(regexp_replace(upper(replace(c_name, '*', 'P')), '[^A-Z0-9]', '_', 'g')) AS cfg FROM customer")
def sanitize_c_name(spark, d):
    return table(spark, d, "customer").select("c_custkey", text.sanitize_c_name(F.col("c_name")).alias("macro"), text.cfg_name(F.col("c_name")).alias("cfg"))


@query("SELECT p_partkey, regexp_replace(p_type, '[^A-Za-z0-9_]', '_', 'g') AS name FROM part")
def canonicalize(spark, d):
    return table(spark, d, "part").select("p_partkey", text.automake_canonicalize(F.col("p_type")).alias("name"))


@query(r"SELECT p_partkey, nullif(regexp_extract(p_brand || ' v' || p_size || '.' || p_partkey % 7 || '-rc', '([0-9]+(?:\.[0-9]+)?(?:\.[0-9]+)?(?:-[0-9A-Za-z.-]+)?(?:\+[0-9A-Za-z.-]+)?)', 1), '') AS version FROM part")
def version_sanitize(spark, d):
    return table(spark, d, "part").select("p_partkey", text.sanitize_version(F.concat("p_brand", F.lit(" v"), "p_size", F.lit("."), F.col("p_partkey") % 7, F.lit("-rc"))).alias("version"))


@query("SELECT r_name || '/' || p || '/' || s AS name FROM region CROSS JOIN (SELECT DISTINCT o_orderpriority AS p FROM orders) CROSS JOIN (SELECT DISTINCT o_orderstatus AS s FROM orders)")
def cartesian_product(spark, d):
    sets = table(spark, d, "orders").agg(F.collect_set("o_orderpriority").alias("p"), F.collect_set("o_orderstatus").alias("s"))
    regions = table(spark, d, "region").agg(F.collect_set("r_name").alias("r"), F.lit(0).alias("k")).join(sets.withColumn("k", F.lit(0)), "k")
    return regions.select(F.explode(values.product([F.col("r"), F.col("p"), F.col("s")])).alias("t")).select(F.array_join("t", "/").alias("name"))


@query("SELECT p_brand, true AS numeric, string_agg(p_size::VARCHAR, ',' ORDER BY p_size) AS candidates FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_size) AS r FROM (SELECT DISTINCT p_brand, p_size FROM part)) WHERE r <= 10 GROUP BY 1")
def top10_candidates(spark, d):
    found = values.candidates(table(spark, d, "part").select("p_brand", F.col("p_size").cast("string").alias("v")), ["p_brand"], "v")
    return found.select("p_brand", "numeric", F.array_join("candidates", ",").alias("candidates"))


@query("""
WITH w AS (SELECT p_brand, p_type AS a, split_part(p_name, ' ', 1) AS b, split_part(p_name, ' ', 2) AS c, p_type || ' ' || p_name AS name, p_partkey, p_size FROM part),
e AS (SELECT p_brand, max(p_partkey) // 2 AS at FROM part GROUP BY 1)
SELECT p_brand, i || ' ' || j || ' ' || k AS name, 'a=' || i || ',b=' || j || ',c=' || k AS mapping
FROM e JOIN (SELECT DISTINCT p_brand, a AS i FROM w) USING (p_brand) JOIN (SELECT DISTINCT p_brand, b AS j FROM w) USING (p_brand) JOIN (SELECT DISTINCT p_brand, c AS k FROM w) USING (p_brand)
WHERE EXISTS (SELECT 1 FROM w WHERE w.p_brand = e.p_brand AND w.name = i || ' ' || j || ' ' || k AND (w.p_partkey < e.at AND w.p_size < 30 OR w.p_size > 40))""")
def identifier_divisions(spark, d):
    """Names of three words, of which each can be any of its brand: those that are defined before the place or used, with which variable gave which word."""
    part = table(spark, d, "part").withColumn("name", F.concat("p_type", F.lit(" "), "p_name"))
    word = lambda k: F.split_part("name", F.lit(" "), F.lit(k))
    one = lambda kind, t: F.struct(F.lit(kind).alias("kind"), F.lit(t).alias("text"))
    shape = F.array(one("var", "a"), one("lit", " "), one("var", "b"), one("lit", " "), one("var", "c"))
    evals = part.groupBy("p_brand").agg(F.expr("max(p_partkey) DIV 2").alias("at")).select("p_brand", F.lit(1).alias("eval_id"), "at", shape.alias("parts"))
    given = part.select("p_brand", F.lit(1).alias("eval_id"), F.explode(F.array(*[F.struct(F.lit(v).alias("var"), word(k + 1).alias("value")) for k, v in enumerate("abc")])).alias("v")).select("p_brand", "eval_id", "v.*")
    known = part.where("p_size < 30").select("p_brand", "name", F.col("p_partkey").alias("at"), F.lit("def").alias("role")).union(part.where("p_size > 40").select("p_brand", "name", "p_partkey", F.lit("use")))
    found = valuesets.divisions(evals, given, known, ["p_brand"], "eval_id")
    return found.select("p_brand", "name", F.array_join(F.transform("mapping", lambda m: F.concat(m["var"], F.lit("="), m["piece"])), ",").alias("mapping"))


@query("""
WITH l AS (SELECT DISTINCT l_orderkey, l_linenumber % 3 AS pos, l_returnflag || l_linenumber AS v, [l_linestatus, l_returnflag, (l_suppkey % 3)::VARCHAR] AS c FROM lineitem WHERE l_linenumber < 6),
m AS (SELECT l_orderkey, min(pos) AS lo, max(pos) AS hi, count(DISTINCT pos) AS n FROM l GROUP BY 1),
t AS (
  SELECT a.l_orderkey, a.v || coalesce(b.v, '') || coalesce(c.v, '') AS value, a.c AS x, coalesce(b.c, a.c) AS y, coalesce(c.c, a.c) AS z
  FROM (SELECT l.* FROM l JOIN m USING (l_orderkey) WHERE pos = lo) a JOIN m USING (l_orderkey)
    LEFT JOIN l b ON b.l_orderkey = a.l_orderkey AND b.pos > lo AND (b.pos < hi OR n = 2) LEFT JOIN l c ON n = 3 AND c.l_orderkey = a.l_orderkey AND c.pos = hi
)
SELECT DISTINCT l_orderkey, value, array_to_string(CASE WHEN x[1] <> y[1] OR x[1] <> z[1] THEN [] WHEN x[2] <> y[2] OR x[2] <> z[2] THEN x[:1] WHEN x[3] <> y[3] OR x[3] <> z[3] THEN x[:2] ELSE x END, '/') AS conds FROM t""")
def guarded_products(spark, d):
    """Texts put together from one line of each residue, under the conditions that all of them begin with."""
    rows = table(spark, d, "lineitem").where("l_linenumber < 6").select("l_orderkey", (F.col("l_linenumber") % 3).alias("pos"), F.concat("l_returnflag", F.col("l_linenumber").cast("string")).alias("v"), F.array("l_linestatus", "l_returnflag", (F.col("l_suppkey") % 3).cast("string")).alias("c"))
    return valuesets.guarded_product(rows, ["l_orderkey"], "pos", "v", "c").select("l_orderkey", "value", F.array_join("conds", "/").alias("conds"))


@query("""
WITH RECURSIVE o AS (SELECT user_id, event_type, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS n FROM events),
e AS (SELECT user_id, n // 8 AS block, n % 8 AS n, event_type FROM o),
v AS (
  SELECT user_id, block, n, CASE WHEN event_type = 'click' THEN 'c' ELSE 'e' END AS value FROM e WHERE event_type IN ('click', 'error')
  UNION
  SELECT e.user_id, e.block, e.n, CASE e.event_type WHEN 'purchase' THEN '<' || v.value || '>' ELSE v.value END
  FROM v JOIN e ON e.user_id = v.user_id AND e.block = v.block AND e.n = v.n + 1 WHERE e.event_type <> 'click'
)
SELECT user_id, block, n AS var, value FROM v""")
def value_fixpoint(spark, d):
    """Events of a user, eight at a time, define each other in a chain: clicks are texts, views copies, purchases put brackets around, errors do either."""
    rows = sequences.number_rows(events(spark, d).select("user_id", "ts", "event_id", "event_type"), ["user_id"], ["ts", "event_id"], "n", F.to_date("ts")).withColumn("n", F.col("n") - 1)
    rows = rows.select("user_id", F.expr("n DIV 8").alias("block"), (F.col("n") % 8).alias("n"), "event_type")
    part = lambda pos, kind, t: F.struct(F.lit(pos).alias("pos"), F.lit(kind).alias("kind"), t.alias("text"))
    before = (F.col("n") - 1).cast("string")
    ref, lit = (lambda pos: part(pos, "ref", before)), (lambda pos, t: part(pos, "lit", F.lit(t)))
    defs = F.when(F.col("event_type") == "click", F.array(F.array(lit(0, "c")))).when(F.col("event_type") == "purchase", F.array(F.array(lit(0, "<"), ref(1), lit(2, ">")))).when(F.col("event_type") == "error", F.array(F.array(lit(0, "e")), F.array(ref(0)))).otherwise(F.array(F.array(ref(0))))
    parts = rows.select("user_id", "block", F.col("n").cast("string").alias("var"), F.posexplode(defs).alias("k", "def")).select("user_id", "block", "var", F.concat("var", F.lit("/"), "k").alias("def_id"), F.inline("def"))
    return valuesets.value_sets(parts, ["user_id", "block"]).select("user_id", "block", F.col("var").cast("bigint").alias("var"), "value")


@query("SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders")
def set_difference(spark, d):
    return table(spark, d, "customer").select("c_custkey").join(table(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").distinct()


@query("SELECT 'n' || n_nationkey AS option_name, 'candidates left out' AS error FROM nation WHERE n_nationkey % 3 = 1 UNION ALL SELECT 'n' || n_nationkey, 'alias of no representative' FROM nation WHERE n_nationkey % 3 = 2")
def partition_check(spark, d):
    kind = F.col("n_nationkey") % 3
    rows = table(spark, d, "nation").select(
        F.concat(F.lit("n"), "n_nationkey").alias("option_name"), F.array(F.lit("yes"), F.lit("no"), F.lit("on")).alias("candidates"), F.array(F.lit("yes"), F.lit("no")).alias("representatives"),
        F.when(kind == 0, F.create_map(F.lit("on"), F.lit("yes"))).when(kind == 1, F.create_map().cast("map<string,string>")).otherwise(F.create_map(F.lit("on"), F.lit("maybe"))).alias("aliases"),
    )
    return values.partition_errors(rows)


@query("SELECT user_id, event_type FROM events GROUP BY 1, 2 HAVING bool_or(value > 50) AND bool_or(NOT value > 50)")
def contradiction_detect(spark, d):
    return values.contradictions(events(spark, d).where("value IS NOT NULL").withColumn("no", F.col("value") > 50), ["user_id"], "event_type", "no")


_HINT = "CASE WHEN v = '' THEN 'Empty' WHEN v IN ('yes','no','0','1','true','false','on','off') THEN 'Boolean' WHEN regexp_full_match(v, '\\d*') THEN 'Integer' WHEN regexp_matches(v, '\\s') THEN 'List' ELSE 'Literal' END"
_VALUES = "SELECT event_type || '/' || user_id % 5 AS var, CASE WHEN event_type = 'click' THEN (value::BIGINT % 2)::VARCHAR WHEN event_type = 'view' THEN props WHEN event_type = 'error' THEN '' ELSE (event_id + 2)::VARCHAR END AS v FROM events"


def _typed(spark, d):
    v = F.expr("CASE WHEN event_type = 'click' THEN CAST(CAST(round(value) AS BIGINT) % 2 AS STRING) WHEN event_type = 'view' THEN props WHEN event_type = 'error' THEN '' ELSE CAST(event_id + 2 AS STRING) END")
    return events(spark, d).select(F.concat("event_type", F.lit("/"), (F.col("user_id") % 5).cast("string")).alias("var"), v.alias("v"))


@query(f"SELECT var, {_HINT} AS hint, count(*) AS n FROM ({_VALUES}) GROUP BY 1, 2")
def type_hints(spark, d):
    return _typed(spark, d).withColumn("hint", values.type_hint(F.col("v"))).groupBy("var", "hint").agg(F.count("*").alias("n"))


_TYPES = f"SELECT var, CASE WHEN count(DISTINCT hint) FILTER (WHERE hint <> 'Empty') = 1 THEN max(hint) FILTER (WHERE hint <> 'Empty') ELSE 'Literal' END AS type FROM (SELECT var, {_HINT} AS hint FROM ({_VALUES})) GROUP BY 1"


@query(_TYPES)
def type_infer(spark, d):
    return values.infer_types(_typed(spark, d).withColumn("hint", values.type_hint(F.col("v"))), "var", "hint")


@query(f"""
WITH t AS ({_TYPES}), e AS (SELECT var AS src, replace(var, split_part(var, '/', 1), 'error') AS dst FROM t WHERE starts_with(var, 'click')),
a AS (SELECT t.var, CASE WHEN t.type = 'Literal' AND x.ty IS NOT NULL THEN x.ty ELSE t.type END AS type FROM t LEFT JOIN
  (SELECT dst AS var, min(t.type) AS ty FROM e JOIN t ON e.src = t.var WHERE t.type <> 'Literal' GROUP BY 1 HAVING count(DISTINCT t.type) = 1) x ON t.var = x.var)
SELECT a.var, CASE WHEN a.type = 'Literal' AND x.ty IS NOT NULL THEN x.ty ELSE a.type END AS type FROM a LEFT JOIN
  (SELECT src AS var, min(a.type) AS ty FROM e JOIN a ON e.dst = a.var WHERE a.type <> 'Literal' GROUP BY 1 HAVING count(DISTINCT a.type) = 1) x ON a.var = x.var""")
def type_propagate(spark, d):
    types = type_infer(spark, d)
    edges = types.where("var LIKE 'click%'").select(F.col("var").alias("src"), F.concat(F.lit("error/"), F.split_part("var", F.lit("/"), F.lit(2))).alias("dst"))
    return values.propagate_types(types, edges, "var", "src", "dst")


@query("SELECT split_part(p_type, ' ', 1) || '@' AS dict_id, split_part(p_type, ' ', 1) AS name, count(*) AS n FROM part GROUP BY 1, 2")
def dict_group(spark, d):
    parts = F.array(F.struct(F.lit("Name").alias("kind"), F.split_part("p_type", F.lit(" "), F.lit(1)).alias("text")), F.struct(F.lit("Indirect").alias("kind"), F.lit("x").alias("text")), F.struct(F.lit("Indirect").alias("kind"), F.lit("y").alias("text")))
    rows = table(spark, d, "part").select(text.encode_dictionary_id(parts).alias("dict_id"))
    return rows.groupBy("dict_id").agg(F.count("*").alias("n")).select("dict_id", text.dictionary_name(F.col("dict_id")).alias("name"), "n")


_KIND = "CASE l_linenumber % 4 WHEN 0 THEN 'Literal' WHEN 1 THEN 'Path' WHEN 2 THEN 'Boolean' ELSE 'List' END"


@query(f"SELECT l_suppkey, arg_max({_KIND}, CASE l_linenumber % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 ELSE 6 END) AS kind FROM lineitem GROUP BY 1")
def max_priority_type(spark, d):
    return values.strongest(table(spark, d, "lineitem").withColumn("kind", F.expr(_KIND)), ["l_suppkey"], "kind", "l_orderkey")


@query("SELECT p_partkey, CASE WHEN p_size < 10 THEN 'cpp' WHEN p_size < 30 THEN 'subst' END AS policy FROM part")
def policy_lookup(spark, d):
    sizes = table(spark, d, "part").select(F.col("p_size").alias("key")).distinct()
    maps = [sizes.where("key < 10").withColumn("policy", F.lit("cpp")), sizes.where("key < 30").withColumn("policy", F.lit("subst"))]
    return values.policy(table(spark, d, "part").select("p_partkey", "p_size"), "p_size", maps).select("p_partkey", "policy")


@query("SELECT c_nationkey AS src, s_nationkey AS dst, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2")
def feature_edges(spark, d):
    o, c, l, s = (table(spark, d, t) for t in ("orders", "customer", "lineitem", "supplier"))
    rows = l.join(o, l.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey).join(s, l.l_suppkey == s.s_suppkey)
    return rows.groupBy(F.col("c_nationkey").alias("src"), F.col("s_nationkey").alias("dst")).agg(F.count("*").alias("n"))


@query("""
WITH m AS (SELECT o_custkey, bool_or(l_discount > 0.08) AS mutable FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1),
j AS (SELECT c_custkey, n_nationkey, n_regionkey, mutable FROM m JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)
SELECT 'c_custkey' AS level, c_custkey::VARCHAR AS key, bool_or(mutable) AS mutable FROM j GROUP BY 2 UNION ALL
SELECT 'n_nationkey', n_nationkey::VARCHAR, bool_or(mutable) FROM j GROUP BY 2 UNION ALL SELECT 'n_regionkey', n_regionkey::VARCHAR, bool_or(mutable) FROM j GROUP BY 2""")
def skeleton_mutability(spark, d):
    o, c, l, n = (table(spark, d, t) for t in ("orders", "customer", "lineitem", "nation"))
    own = l.join(o, l.l_orderkey == o.o_orderkey).groupBy("o_custkey").agg(F.bool_or(F.col("l_discount") > 0.08).alias("mutable"))
    rows = own.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    return trees.roll_up(rows, ["c_custkey", "n_nationkey", "n_regionkey"], "mutable")


@query("SELECT user_id, count(*) AS n, string_agg(DISTINCT event_type, ';' ORDER BY event_type) AS kinds FROM events GROUP BY 1")
def metrics_export(spark, d):
    return events(spark, d).groupBy("user_id").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("event_type")), ";").alias("kinds"))
