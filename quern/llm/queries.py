"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, divergence, jaccard_join, language_id, line_templates, mixing, order_minhash, pages, pii, repair, sharding, token_counts

#: Where the vocabulary of the token count query lies on the driver; QUERN_VOCABULARY names another.
VOCABULARY = os.environ.get("QUERN_VOCABULARY", "/opt/tokenizers/byte_bpe_multi_50k.tiktoken")
SURROGATE_KEY = b"quern surrogate key"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_chat_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation from every participant's side; mask: ``from-to`` of the assistant's texts."""
    rows = chat.rotate(_table(spark, sf_dir, "conversations"))
    spans = F.array_join(F.zip_with("mask_from", "mask_to", lambda a, b: F.concat(a.cast("string"), F.lit("-"), b.cast("string"))), ",")
    return rows.select("conv_id", "participant", "n_messages", "text", spans.alias("mask"))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op3_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.compared(_table(spark, sf_dir, "documents"))


def op4_stratified_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.assign_shards(_table(spark, sf_dir, "documents"), 16)
    return rows.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_table(spark, sf_dir, "documents"), token_counts.read_vocabulary(VOCABULARY))


def op6_jaccard_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_groups(_table(spark, sf_dir, "documents"))


def op7_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, lines, dropped lines and the SHA-256 of what stays."""
    rows = line_templates.drop_recurring_lines(_table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op8_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each entity: where it stands in which document, what it is, what replaces it, and whether another entity has the same surrogate."""
    return pii.with_collisions(pii.surrogate_text(_table(spark, sf_dir, "documents"), SURROGATE_KEY))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return rows.select("doc_id", "item_id", "score", "first_word", "last_word")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))
    rows = language_id.identify(docs, use=~held_out)
    return rows.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def damaged(turns: DataFrame) -> DataFrame:
    """Rows damaged by ``crc32(conv_id:turn) % 20``: 0 dropped, 1 emptied, 2 without its marks, 3 there twice, 4 said by the user.  Null reads as one space but for conv_id and turn themselves."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    way = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    text = F.when(way == 1, "").when(way == 2, F.regexp_replace(space("text"), "[.!?]", "")).otherwise(space("text"))
    rows = turns.select("conv_id", "turn", F.when(way == 4, "user").otherwise(space("role")).alias("role"), text.alias("text"), F.when(way == 0, 0).when(way == 3, 2).otherwise(1).alias("times"))
    return rows.select("conv_id", "turn", "role", "text", F.explode(F.expr("array_repeat(0, times)"))).drop("col")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation of ``conversations`` after ``damaged``; one of which no row is left has zeros, no edits and the hash of an empty text."""
    turns = _table(spark, sf_dir, "conversations")
    report, rows = repair.repair(damaged(turns))
    report, texts = report.withColumnRenamed("conv_id", "report_id"), repair.digests(rows).withColumnRenamed("conv_id", "text_id")
    every = turns.select("conv_id").distinct()
    every = every.join(report, F.col("conv_id").eqNullSafe(F.col("report_id")), "left").join(texts, F.col("conv_id").eqNullSafe(F.col("text_id")), "left")
    counts = [F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return every.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def op12_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.main_text(_table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.char_length("text").cast("bigint").alias("n_chars"))


def op13_divergence_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each language's sources: all others by divergence, and the 200 terms that set each apart most."""
    return divergence.divergences(_table(spark, sf_dir, "documents"))


def queries() -> dict:
    named = (op1_chat_rotation, op2_mix_sources, op3_order_minhash, op4_stratified_shards, op5_token_counts, op6_jaccard_groups, op7_line_templates, op8_pii_surrogates, op9_decontaminate, op10_language_id, op11_conversation_repair, op12_main_text, op13_divergence_audit)
    return {f.__name__: f for f in named}


_CHAT_SQL = """
WITH m AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
), p AS (
  SELECT DISTINCT conv_id, role AS participant FROM m WHERE role IS NOT NULL AND role <> 'system'
), r AS (
  SELECT m.conv_id, participant, turn, role, text, role IS NOT DISTINCT FROM participant AS own,
    CASE WHEN role IS NOT DISTINCT FROM participant THEN '<|assistant|>' WHEN role = 'system' THEN '<|system|>'
         ELSE '<|user name=' || coalesce(role, 'unknown') || '|>' END || chr(10) AS head
  FROM m JOIN p ON m.conv_id IS NOT DISTINCT FROM p.conv_id
), s AS (
  SELECT *, coalesce(sum(length(head) + length(text) + 8) OVER (
    PARTITION BY conv_id, participant ORDER BY turn NULLS FIRST, role NULLS FIRST, text
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(head) AS pos
  FROM r
)
SELECT conv_id, participant, count(*) AS n_messages,
  string_agg(head || text || '<|end|>' || chr(10), '' ORDER BY turn NULLS FIRST, role NULLS FIRST, text) AS text,
  coalesce(string_agg(pos::BIGINT::VARCHAR || '-' || (pos + length(text))::BIGINT::VARCHAR, ',' ORDER BY turn NULLS FIRST, role NULLS FIRST, text) FILTER (WHERE own), '') AS mask
FROM s GROUP BY conv_id, participant
"""

_MIX_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
    md5('11' || chr(31) || coalesce(doc_id::VARCHAR, chr(30) || 'null')) AS key
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight FROM d GROUP BY source
), l AS (
  SELECT *, (sum(source_size) OVER ()::DOUBLE
      - 3.0::DOUBLE * coalesce(sum(source_size) OVER (ORDER BY source_size::DOUBLE / weight, source NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
      / sum(weight) OVER (ORDER BY source_size::DOUBLE / weight, source NULLS FIRST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::DOUBLE AS level,
    3.0::DOUBLE * source_size::DOUBLE AS most
  FROM s
), c AS (
  SELECT *, first_value(CASE WHEN level * weight <= most THEN level END IGNORE NULLS) OVER (
    ORDER BY source_size::DOUBLE / weight, source NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS common
  FROM l
), t AS (
  SELECT source, source_size, CASE WHEN common IS NULL THEN most ELSE common * weight END AS target FROM c
), u AS (
  SELECT d.doc_id, d.size, t.source_size, t.target,
    CASE WHEN t.source_size > 0 THEN floor(target)::BIGINT // t.source_size ELSE 0 END AS turns,
    sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size::BIGINT AS size, source_size, target,
  (turns * size + CASE WHEN source_size > 0 THEN greatest(0, least(size, floor(target)::BIGINT - turns * source_size - (upto - size))) ELSE 0 END)::BIGINT AS taken
FROM u
"""

_JACCARD_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(list_slice(w, i, i + 4), ' ')) END) AS s FROM w
), n AS (
  SELECT doc_id, coalesce(len(s), 0) AS n FROM s
), x AS (
  SELECT doc_id, unnest(s) AS g FROM s
), pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM x a JOIN x b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM pairs JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * common >= 75 * (na.n + nb.n - common)
), reach AS (
  SELECT doc_id, doc_id AS other FROM documents
  UNION
  SELECT reach.doc_id, links.b FROM reach JOIN links ON links.a = reach.other
)
SELECT n.doc_id, n.n::BIGINT AS n_shingles, min(reach.other) AS component_id FROM n JOIN reach ON n.doc_id = reach.doc_id GROUP BY 1, 2
"""


# the CRC-32 of the UTF-8 bytes, a byte at a time; the table's entries are linear in the bits of their index
_CRC_BITS = []
for _bit in range(8):
    _value = 1 << _bit
    for _ in range(8):
        _value = (_value >> 1) ^ (0xEDB88320 if _value & 1 else 0)
    _CRC_BITS.append(_value)
_CRC_STEP = "c >> 8"
for _bit, _value in enumerate(_CRC_BITS):
    _CRC_STEP = f"xor({_CRC_STEP}, ((xor(c, b) >> {_bit}) & 1) * {_value})"

_SHARD_SQL = f"""
WITH t AS (
  SELECT DISTINCT coalesce(text, '') AS text FROM documents
), c AS (
  SELECT text, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda h: ('0x' || h)::BIGINT)), lambda c, b: {_CRC_STEP})) AS crc FROM t
), d AS (
  SELECT doc_id, source, strlen(coalesce(documents.text, ''))::BIGINT + 1 AS size, crc AS text_crc32,
    md5('7' || chr(31) || coalesce(doc_id::VARCHAR, chr(30) || 'null') || chr(31) || crc) AS key
  FROM documents JOIN c ON coalesce(documents.text, '') = c.text
), r AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY key, doc_id NULLS FIRST, size) AS r, count(*) OVER (PARTITION BY source) AS n, count(*) OVER () AS total FROM d
), p AS (
  SELECT *, row_number() OVER (ORDER BY (2 * r - 1) / (2 * n)::DOUBLE, source NULLS FIRST, r) - 1 AS place FROM r
), s AS (
  SELECT *, (place * 16) // total AS shard FROM p
)
SELECT doc_id, size, text_crc32, 'rows' AS law, shard::INT AS shard, (place - (shard * total + 15) // 16)::BIGINT AS slot, NULL::INT AS grown_shard FROM s
"""

_LINES_SQL = r"""
WITH t AS (
  SELECT DISTINCT text FROM documents WHERE text IS NOT NULL
), l AS (
  SELECT text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS place FROM t
), w AS (
  SELECT *, list_transform(regexp_extract_all(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), lambda x: CASE WHEN regexp_matches(x, '[0-9@/\\]') THEN chr(10) ELSE x END) AS w FROM l
), q AS (
  SELECT unnest([[]::INT[], [0], [1], [2], [3], [0, 1], [0, 2], [0, 3], [1, 2], [1, 3], [2, 3]]) AS q
), k AS (
  SELECT text, place, q, w, list_transform(w, lambda x, i: CASE WHEN i > 1 AND list_has_any(q, list_filter([0, 1, 2, 3], lambda z: i > 1 + (len(w) - 1) * z // 4 AND i <= 1 + (len(w) - 1) * (z + 1) // 4)) THEN chr(13) ELSE x END) AS t,
    len(list_filter(q, lambda z: (len(w) - 1) * (z + 1) // 4 > (len(w) - 1) * z // 4)) = len(q) AS fits
  FROM w, q WHERE len(w) > 0 AND (len(w) >= 5 OR len(q) = 0)
), m AS (
  SELECT text, place, [q::VARCHAR, array_to_string(t, ' ')] AS template FROM k
  WHERE fits AND 2 * len(list_filter(t, lambda x: x NOT IN (chr(10), chr(13)))) >= len(w) AND (len(q) = 0 OR len(list_filter(t, lambda x: x NOT IN (chr(10), chr(13)))) >= 5)
  UNION ALL
  SELECT text, place, [i::VARCHAR, md5(array_to_string(w[:i - 1], ' ') || chr(13) || array_to_string(w[i + 1:], ' '))]
  FROM (SELECT *, unnest(range(2, len(w) + 1)) AS i FROM w WHERE len(w) > 0 AND 4 * (len(list_filter(w, lambda x: x <> chr(10))) - 1) >= 3 * len(w)) WHERE w[i] <> chr(10)
), o AS (
  SELECT template FROM m GROUP BY 1 HAVING count(DISTINCT text) >= 3
), g AS (
  SELECT DISTINCT text, place FROM m SEMI JOIN o USING (template)
), s AS (
  SELECT l.text, count(*) AS n_lines, count(g.place) AS n_dropped, coalesce(string_agg(line, chr(10) ORDER BY l.place) FILTER (WHERE g.place IS NULL), '') AS kept
  FROM l LEFT JOIN g ON l.text = g.text AND l.place = g.place GROUP BY 1
)
SELECT doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_dropped, 0)::BIGINT AS n_dropped, sha256(kept) AS kept_sha256
FROM documents LEFT JOIN s ON documents.text = s.text
"""


_REPAIR_SQL = f"""
WITH RECURSIVE d AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))), '..'), lambda h: ('0x' || h)::BIGINT)), lambda c, b: {_CRC_STEP})) % 20 AS way
  FROM conversations
), e AS (
  SELECT conv_id, turn, CASE WHEN way = 4 THEN 'user' ELSE role END AS role,
    CASE way WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE way WHEN 0 THEN [] WHEN 3 THEN [0, 1] ELSE [0] END) AS copy FROM d
), c AS (
  SELECT conv_id, row_number() OVER () AS c FROM (SELECT DISTINCT conv_id FROM conversations)
), f AS MATERIALIZED (
  SELECT c.c, turn, role, text, substr(role, 1, 1) AS initial,
    row_number() OVER (PARTITION BY c.c ORDER BY turn NULLS FIRST, role, md5(text), copy) AS pos,
    CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 'blank'
         WHEN row_number() OVER (PARTITION BY c.c, role, text ORDER BY turn NULLS FIRST, copy) > 1 THEN 'duplicate'
         WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*\\z') THEN 'truncated' END AS fault
  FROM e JOIN c ON e.conv_id IS NOT DISTINCT FROM c.conv_id
), a AS (
  SELECT *, lag(initial) OVER (PARTITION BY c ORDER BY pos) || initial AS two FROM f
), n AS (
  SELECT c, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (two NOT IN ('su', 'ua', 'au')) AS illegal, max(pos) AS size FROM a GROUP BY c
), op AS (
  FROM (VALUES (0, 's', 1, 0, 'K'), (0, 'u', 2, 0, 'K'), (1, 'u', 2, 0, 'K'), (2, 'a', 3, 0, 'K'), (3, 'u', 2, 0, 'K'), (0, NULL, 2, 1, 'R'), (1, NULL, 2, 1, 'R'), (2, NULL, 3, 1, 'R'), (3, NULL, 2, 1, 'R'),
    (0, NULL, 0, 2, 'D'), (1, NULL, 1, 2, 'D'), (2, NULL, 2, 2, 'D'), (3, NULL, 3, 2, 'D')) v(q, initial, goes, cost, edit)
), ins AS (
  FROM (VALUES (0, 0, 0, ''), (1, 1, 0, ''), (2, 2, 0, ''), (3, 3, 0, ''), (0, 2, 5, 'I'), (1, 2, 5, 'I'), (3, 2, 5, 'I'), (2, 3, 5, 'I'), (0, 3, 10, 'II'), (1, 3, 10, 'II')) v(q, goes, cost, edits)
), dp AS (
  SELECT c, 0::BIGINT AS pos, ins.goes AS q, format('{{:09d}}', cost) || edits AS v FROM n JOIN ins ON ins.q = 0
  UNION ALL
  SELECT dp.c, f.pos, ins.goes, min(format('{{:09d}}', dp.v[:9]::INT + op.cost + ins.cost + CASE WHEN fault = 'truncated' AND op.edit <> 'D' THEN 5 ELSE 0 END) || dp.v[10:] || op.edit || ins.edits)
  FROM dp JOIN f ON f.c = dp.c AND f.pos = dp.pos + 1
    JOIN op ON op.q = dp.q AND (op.edit = 'D' OR coalesce(fault, 'truncated') = 'truncated' AND coalesce(op.initial, f.initial) = f.initial) JOIN ins ON ins.q = op.goes
  GROUP BY dp.c, f.pos, ins.goes
), best AS (
  SELECT dp.c, min(v) AS v FROM dp JOIN n ON n.c = dp.c AND n.size = dp.pos WHERE q IN (0, 3) GROUP BY dp.c
), edit AS (
  SELECT c, unnest(string_split(v[10:], '')) AS edit, generate_subscripts(string_split(v[10:], ''), 1) AS k FROM best WHERE length(v) > 9
), placed AS (
  SELECT c, edit, k, sum((edit <> 'I')::INT) OVER w AS pos, sum((edit <> 'D')::INT) OVER w AS j, sum((edit <> 'D')::INT) OVER (PARTITION BY c) % 2 AS odd FROM edit WINDOW w AS (PARTITION BY c ORDER BY k)
), t AS (
  SELECT placed.c, string_agg(CASE WHEN edit = 'K' THEN role WHEN (j - odd) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN edit = 'I' THEN '' ELSE text END, chr(10) ORDER BY k) FILTER (edit <> 'D') AS t
  FROM placed LEFT JOIN f ON f.c = placed.c AND f.pos = placed.pos GROUP BY placed.c
)
SELECT conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
  coalesce(v[:9]::BIGINT, 0) AS cost, coalesce(v[10:], '') AS audit, sha256(coalesce(t, '')) AS repaired_sha256
FROM c LEFT JOIN n USING (c) LEFT JOIN best USING (c) LEFT JOIN t USING (c)
"""

# the tables' pages mark their article, so that plain patterns find what scores must find
_PAGES_SQL = r"""
WITH a AS (
  SELECT page_id, url, list_transform(string_split_regex(coalesce(regexp_extract(html, '(?s)<article>(.*)</article>', 1), ''), '</?(p|h1)>'), lambda b: regexp_replace(replace(b, '<br>', ' '), '</?b>', '', 'g')) AS b FROM pages
), d AS (
  SELECT page_id, url, list_transform(b, lambda x: trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&quot;?', '"', 'g'), '&amp;?', '&', 'g'), '[\x20\x09-\x0D]+', ' ', 'g'), ' ')) AS b FROM a
)
SELECT page_id, url, array_to_string(list_filter(b, lambda x: x <> ''), chr(10)) AS text, length(array_to_string(list_filter(b, lambda x: x <> ''), chr(10)))::BIGINT AS n_chars FROM d
"""

_DIVERGENCE_SQL = r"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents
), o AS MATERIALIZED (
  SELECT row, lang, source, unnest(w) AS term FROM d
), kept AS MATERIALIZED (
  SELECT lang, term, count(*)::HUGEINT AS n FROM o GROUP BY 1, 2 HAVING count(DISTINCT row) >= 3
), v AS (
  SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS total FROM kept GROUP BY 1
), g AS (
  SELECT DISTINCT lang, source FROM d
), c AS (
  SELECT o.lang, o.source, o.term, count(*)::HUGEINT AS n FROM o JOIN kept ON o.lang = kept.lang AND o.term = kept.term GROUP BY 1, 2, 3
), s AS (
  SELECT lang, source, sum(n)::HUGEINT AS total FROM c GROUP BY 1, 2
), p AS MATERIALIZED (
  SELECT g.lang, g.source, kept.term, coalesce(c.n, 0) AS n, 1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 1) // (coalesce(s.total, 0) + v.v) AS p,
    1 + 1000000000::HUGEINT * (kept.n + 1) // (v.total + v.v) AS q
  FROM g JOIN kept ON g.lang = kept.lang JOIN v ON g.lang = v.lang LEFT JOIN s ON g.lang = s.lang AND g.source = s.source
    LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term
), r AS (
  SELECT a.lang, a.source, 'term' AS part, a.term AS item, (p - q) * (p - q) // q AS value FROM p a WHERE n > 0 AND p > q
  UNION ALL
  SELECT a.lang, a.source, 'pair', b.source, coalesce(x.value, 0)
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN (
    SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
    FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3
  ) x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
), k AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM r
)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank FROM k WHERE part = 'pair' OR rank <= 200
"""


_TOKENS_SQL = rf"""
WITH RECURSIVE v AS (
  SELECT DISTINCT hex(from_base64(string_split(line, ' ')[1])) AS p
  FROM read_csv('{VOCABULARY}', columns = {{'line': 'VARCHAR'}}, header = false, delim = '	', quote = '', escape = '') WHERE line <> ''
), g AS (
  SELECT unnest(range(2, (SELECT max(length(p)) FROM v) + 2, 2)) AS l
), o AS MATERIALIZED (
  SELECT doc_id, text, row_number() OVER () AS rid FROM documents
), u AS (
  SELECT rid, unnest(regexp_extract_all(text, ' ?[^ 	-
]+|[ 	-
]')) AS unit FROM o
), d AS (
  SELECT DISTINCT unit, hex(encode(unit)) AS h FROM u
), r AS (
  SELECT h, 0::BIGINT AS pos, 0::BIGINT AS n FROM d
  UNION ALL
  SELECT r.h, r.pos + greatest(2, coalesce(max(length(v.p)), 0)), r.n + 1
  FROM r CROSS JOIN g LEFT JOIN v ON v.p = substr(r.h, r.pos + 1, g.l) AND r.pos + g.l <= length(r.h) WHERE r.pos < length(r.h) GROUP BY r.h, r.pos, r.n
), c AS (
  SELECT h, max(n) AS n FROM r GROUP BY h
), t AS (
  SELECT rid, sum(c.n) AS n_tokens, count(*) AS n_units FROM u JOIN d ON u.unit = d.unit JOIN c ON d.h = c.h GROUP BY rid
)
SELECT doc_id, coalesce(n_tokens, 0)::BIGINT AS n_tokens, coalesce(n_units, 0)::BIGINT AS n_units, coalesce(strlen(text), 0)::BIGINT AS n_bytes FROM o LEFT JOIN t USING (rid)
"""


def oracle_sql() -> dict[str, str]:
    """Hashes of 64 bits that results show, models and alignments have no counterpart in the SQL dialect: those queries are tested against brute force."""
    return {"op1_chat_rotation": _CHAT_SQL, "op2_mix_sources": _MIX_SQL, "op4_stratified_shards": _SHARD_SQL, "op5_token_counts": _TOKENS_SQL, "op6_jaccard_groups": _JACCARD_SQL, "op7_line_templates": _LINES_SQL, "op11_conversation_repair": _REPAIR_SQL, "op12_main_text": _PAGES_SQL, "op13_divergence_audit": _DIVERGENCE_SQL}
