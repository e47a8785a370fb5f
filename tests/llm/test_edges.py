"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing names, for every operator and stage."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quern.llm import chat, common, decontaminate, jaccard_join, language_id, line_templates, mixing, order_minhash, pii, sharding, token_counts

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, size bigint, shard int, name string, _bucket int"
LONG = "word other " * 20_000
PROSE = "the quick brown fox jumps over the lazy dog and runs away from the big bad wolf "
ROWS = [
    (1, PROSE, "en", "a", 1, 1, 1, "x", 1), (1, PROSE, "en", "a", 1, 1, 1, "x", 1), (2, PROSE, "en", None, 1, 1, 1, "x", 1), (3, None, None, None, None, None, None, None, None), (4, "", "de", "b", 0, 1, 1, "x", 1),
    (None, "solo text without any id at all here", "en", "a", 1, 1, 1, "x", 1), (None, None, None, None, None, None, None, None, None), (5, LONG, "de", "b", 1, 1, 1, "x", 1), (6, " \n\t ", "en", "b", 1, 1, 1, "x", 1),
    (7, "1234 !!", "en", "b", 1, 1, 1, "x", 1), (8, "Ünïcode größe ñandú 漢字", "de", "a", 1, 1, 1, "x", 1), (9, "one two three", "en", "a", 1, 1, 1, "x", 1),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, PROSE, 5), (2, None, 5), (3, "", 5), (4, "one two three", 5), (5, "solo", 5)], "item_id bigint, text string, doc_id int")


BY_ROW = {
    "mix": lambda d, b: mixing.mix(d), "shards": lambda d, b: sharding.assign_shards(d), "fingerprints": lambda d, b: order_minhash.fingerprints(d), "compared": lambda d, b: order_minhash.compared(d), "sharded": lambda d, b: sharding.sharded(d),
    "tokens": lambda d, b: token_counts.token_counts(d, [b"wor", b"d", b"w", b"o"]), "groups": lambda d, b: jaccard_join.jaccard_groups(d), "lines": lambda d, b: line_templates.drop_recurring_lines(d), "pii": lambda d, b: pii.surrogate_text(d, b"k"), "languages": lambda d, b: language_id.identify(d),
}
OTHERS = {"contaminated": decontaminate.contaminated, "clean": decontaminate.decontaminated, "one": lambda d, b: jaccard_join.keep_one(d), "mixed": lambda d, b: mixing.mixed_documents(d), "known": lambda d, b: language_id.identified(d)}


@pytest.mark.parametrize("name", BY_ROW)
def test_one_row_for_each(docs, bench, name):
    out = BY_ROW[name](docs, bench)
    assert sorted(r.doc_id or -1 for r in out.collect()) == sorted(r[0] or -1 for r in ROWS)


@pytest.mark.parametrize("name", [*BY_ROW, *OTHERS])
def test_empty_tables(docs, bench, name):
    none, no_items = docs.limit(0), bench.limit(0)
    assert ({**BY_ROW, **OTHERS}[name](none, bench)).count() == 0
    if name in ("contaminated", "clean"):
        assert OTHERS[name](docs, no_items).count() == (0 if name == "contaminated" else len(ROWS))


@pytest.mark.parametrize("name", ["clean", "one", "mixed", "known"])
def test_filters_keep_all_columns(docs, bench, name):
    assert OTHERS[name](docs, bench).columns == docs.columns


def test_defined_results(docs, bench):
    groups = {(r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.jaccard_groups(docs).collect()}
    assert {(1, 13, 1), (2, 13, 1), (3, 0, 3), (4, 0, 4), (6, 0, 6), (None, 0, None), (None, 4, None), (9, 1, 9)} <= groups
    one = [r.doc_id for r in jaccard_join.keep_one(docs).collect()]
    assert one.count(1) == 1 and 2 not in one and one.count(None) == 2
    langs = {(r.doc_id, r.lang_pred, r.score) for r in language_id.identify(docs).collect()}
    assert {(3, "und", 0.0), (4, "und", 0.0), (7, "und", 0.0), (None, "und", 0.0)} <= langs
    assert sorted((r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, bench).collect() if r.doc_id) == [(1, 1), (1, 1), (2, 1), (9, 4)]
    assert (None, 5) in {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, bench).collect()}
    tokens = {r.doc_id: r.n_tokens for r in token_counts.token_counts(docs, [b"wor", b"d", b"o"]).collect()}
    assert tokens[3] == 0 and tokens[4] == 0 and tokens[9] == 13
    lines = {r.doc_id: (r.n_lines, r.text) for r in line_templates.drop_recurring_lines(docs).collect()}
    assert lines[3] == (0, None) and lines[4] == (1, "") and lines[6] == (2, " \n\t ")


def test_no_model_without_labels(docs):
    assert {r.lang_pred for r in language_id.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_chat_edges(spark):
    rows = [(1, 0, "user", "a", 1), (1, 0, "user", "a", 1), (1, 1, None, "b", 1), (2, None, "system", "s", 1), (None, 3, "ann", None, 1), (3, 0, "ann", "x", 1), (3, 5000, "bob", "y", 1)]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, participant int")
    got = {(r.conv_id, r.participant): r for r in chat.rotate(turns).collect()}
    assert set(got) == {(1, "user"), (None, "ann"), (3, "ann"), (3, "bob")}
    assert got[1, "user"].n_messages == 3 and "<|user name=unknown|>" in got[1, "user"].text
    assert got[3, "bob"].text == "<|user name=ann|>\nx<|end|>\n<|assistant|>\ny<|end|>\n" and got[3, "bob"].mask_from == [41]
    assert chat.rotate(turns.limit(0)).count() == 0


def test_long_chat(spark):
    """A dialogue of ten thousand turns with repeated and missing turn numbers is one row for each participant."""
    turns = spark.range(10_000).select(F.lit(7).alias("conv_id"), F.when(F.col("id") % 10 > 0, F.col("id") % 4).alias("turn"), F.element_at(F.array(F.lit("ann"), F.lit("bob"), F.lit("system")), (F.col("id") % 3 + 1).cast("int")).alias("role"), F.concat(F.lit("wörd"), F.col("id")).alias("text"))
    rows = chat.rotate(turns).collect()
    assert sorted(r.participant for r in rows) == ["ann", "bob"]
    for r in rows:
        own = [r.text[a:b] for a, b in zip(r.mask_from, r.mask_to, strict=True)]
        assert r.n_messages == 10_000 == r.text.count("<|end|>") and sorted(own) == sorted(x.text for x in turns.where(F.col("role") == r.participant).collect())
        assert all(r.text[a - 14 : a] == "<|assistant|>\n" for a in r.mask_from)


@pytest.mark.parametrize("k", range(len(corpus_pipeline.STAGES)))
def test_stages(spark, docs, tmp_path, k):
    spark.createDataFrame([(1, "one two three")], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    stage = corpus_pipeline.STAGES[k][1]
    kept = stage(spark, docs, str(tmp_path))
    assert set(docs.columns) <= {*kept.columns}
    rows = kept.collect()
    ids = [r.doc_id for r in rows]
    if k == 0:  # without letters or text: gone; repeated rows stay
        assert not {3, 4, 6, 7} & {*ids} and ids.count(1) == 2 and ids.count(None) == 1
    elif k == 1:  # the copies under 1 and 2 are one row; rows without words stay
        assert sorted(i for i in ids if i) == [1, 3, 4, 5, 6, 7, 8, 9] and ids.count(None) == 2
    elif k == 2:  # the row with the item is gone
        assert 9 not in ids and len(rows) == len(ROWS) - 1
    elif k == 3:  # rows without words aren't taken
        assert not any(not (r.text or "").strip() for r in rows)
    else:
        assert len(rows) == len(ROWS) and sorted(r.slot for r in rows if r.shard == 0) == list(range(sum(r.shard == 0 for r in rows)))
    assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0


#: What the stages call their own columns, in the input here.
INNER = "_mix_row _plan_row _mix_n _mix_k _shard_row _place_row _shard_no _shard_slot _kept _kept_hash _times _Has_Letter _row _key _bucket _rank _place _part _upto _turns _source _size name n text_hash times target taken epochs _name _root _id key place Shard slot_ item_id score".split()


@pytest.mark.parametrize("k", range(len(corpus_pipeline.STAGES)))
def test_stages_stand_any_names(spark, docs, tmp_path, k):
    spark.createDataFrame([(1, "one two three")], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    plain = docs.select("doc_id", "text", "lang", "source", "n_chars")
    more = plain.select("*", *[F.lit(i).alias(c) for i, c in enumerate(INNER)])
    stage = corpus_pipeline.STAGES[k][1]
    out = stage(spark, more, str(tmp_path))
    rows, want = out.collect(), stage(spark, plain, str(tmp_path)).collect()
    assert {c for c in INNER if c != "Shard"} <= {*out.columns}
    assert all(r[c] == i for r in rows for i, c in enumerate(INNER) if c != "Shard")
    assert sorted((str(r.doc_id), str(r.text), str(r.source)) for r in rows) == sorted((str(r.doc_id), str(r.text), str(r.source)) for r in want)


def test_keep_one_of_shared_ids(spark):
    """Rows are kept by doc_id and text: no copy stays and no unique text is lost, whatever ids say."""
    a, b, c, d = ("alpha beta gamma delta epsilon zeta", "one two three four five six", "red green blue black white grey", "north south east west up down")
    rows = [(1, a), (2, b), (2, a), (3, c), (3, d), (3, d), (None, a), (None, "left right in out here there")]
    docs = spark.createDataFrame(rows, "doc_id int, text string")
    got = [(r.doc_id, r.text) for r in jaccard_join.keep_one(docs).collect()]
    assert sorted(got, key=str) == sorted([(1, a), (2, b), (3, c), (3, d), (None, "left right in out here there")], key=str)


def test_mix_and_shards_of_shared_ids(spark):
    """Each row counts for itself, if it shares its doc_id or all it has with others."""
    rows = [(1, "a b c", "s", 0)] * 3 + [(1, "d e f g h i", "s", 1), (None, "j", "s", 2), (None, "k l", "t", 3), (2, None, "t", 4)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, shard int")
    out = mixing.mixed_documents(docs, weights=lambda s: s.withColumn("weight", F.lit(1)), share=1.0).collect()
    words = {s: sum(len(r.text.split()) for r in out if r.source == s) for s in "st"}
    assert words["t"] == 6 and abs(words["s"] - 12) <= 3 and not any(r.text is None for r in out)  # t is taken three times, as often as the cap allows
    placed = sharding.sharded(docs, 3).collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in placed) == sorted((r[0] or 0, r[1] or "") for r in rows)
    assert sorted((r.shard, r.slot) for r in placed) == [(0, 0), (0, 1), (0, 2), (1, 0), (1, 1), (2, 0), (2, 1)]


@pytest.mark.parametrize("small", [0, 5, 1000])
def test_components(spark, small):
    """The same components however many edges one task may end with."""
    edges = [(k, k + 1) for k in range(30) if k % 7] + [(100, 5), (5, 100), (40, 40), (60, 100)]
    got = {(r.node, r.root) for r in common.components(spark.createDataFrame(edges, "a bigint, b bigint"), "test", small).collect()}
    root = {}
    for k in range(31):
        root[k] = k if not k or k % 7 == 1 else root[k - 1]
    root |= {100: root[5], 60: root[5]}
    assert got == {(k, r) for k, r in root.items() if k}
