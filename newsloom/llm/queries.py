"""The registered query of each operator of this package, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm.decontamination import WINDOW as HIT_WINDOW
from newsloom.llm.decontamination import find_contamination
from newsloom.llm.fill_middle import CUT_PERCENT, SEED, SPM_PERCENT, fill_in_middle, restored
from newsloom.llm.html_text import extract_main_text
from newsloom.llm.importance import resample
from newsloom.llm.jaccard_join import near_duplicate_components, near_duplicate_links
from newsloom.llm.language import learn, predict_languages
from newsloom.llm.merkle_manifest import build_manifest, proofs
from newsloom.llm.packing import pack_documents
from newsloom.llm.piece_codec import piece_codes
from newsloom.llm.quality_lines import (
    BOILERPLATE,
    MAX_LOST_PERCENT,
    MAX_REPEAT_PERCENT,
    MIN_WORDS,
    PHRASE_WORDS,
    WIDE_MARKS,
    WINDOW,
    judge_documents,
)
from newsloom.llm.token_counts import count_tokens
from newsloom.llm.token_files import read_token_files, write_token_files
from newsloom.llm.top_k import top_inner_products
from newsloom.plans.registry import scratch


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "tokens")
    write_token_files(table(spark, sf_dir, "documents"), path)
    return read_token_files(spark, path)


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


def op1_quality_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_documents(table(spark, sf_dir, "documents"), with_text=False)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_components(table(spark, sf_dir, "documents"))


def op5_jaccard_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_links(table(spark, sf_dir, "documents"))


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages"))


def op7_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return predict_languages(docs, learn(docs))


def op9_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_codes(table(spark, sf_dir, "documents"))


def op10_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_inner_products(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fill_in_middle(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored("output", "form"), 256).alias("restored_sha256"),
    )


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    # A copy of the table in which some rows claim one character more.
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    claimed = F.when(tampered, F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    found = proofs(build_manifest(table(spark, sf_dir, "documents"), altered=claimed))
    return found.select(
        "doc_id",
        "leaf",
        "subroot",
        "root",
        F.col("proof").alias("proof_sha256"),
        "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )


QUERIES = {
    "op1_quality_lines": op1_quality_lines,
    "op3_token_counts": op3_token_counts,
    "op5_jaccard_join": op5_jaccard_join,
    "op6_html_text": op6_html_text,
    "op7_importance": op7_importance,
    "op8_language": op8_language,
    "op9_piece_codec": op9_piece_codec,
    "op10_top_k": op10_top_k,
    "op2_token_files": op2_token_files,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_jaccard_links": op5_jaccard_links,
    "op11_fill_middle": op11_fill_middle,
    "op12_decontamination": op12_decontamination,
    "op13_merkle_manifest": op13_merkle_manifest,
}

# Words, lines and 8-word windows of a text; the rules of quality_lines in the same order.
OP1_SQL = f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(text, '[ \\t-\\r]+'), lambda w: w <> '') AS w FROM docs
),
lines AS (
  SELECT doc_id, place, line,
    list_filter(regexp_split_to_array(line, '[ \\t-\\r]+'), lambda w: w <> '') AS w
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS place FROM docs)
),
judged AS (
  SELECT doc_id, len(w) AS n,
    row_number() OVER (PARTITION BY doc_id, line ORDER BY place) > 1 AS dup,
    (bars >= 2 AND 5 * bars >= len(w)) OR (len(w) >= 10 AND sentence = 0) OR (shouts >= 4 AND 2 * shouts > len(w))
      OR 2 * symbols > len(w) OR (len(w) >= 10 AND 2 * again > len(w))
      OR (phrases > 0 AND {PHRASE_WORDS} * phrases >= len(w)) AS bad
  FROM (
    SELECT *,
      length(line) - length(replace(line, '|', '')) AS bars,
      length(line) - length(regexp_replace(line, '[!?]', '', 'g')) AS shouts,
      length(line) - length(regexp_replace(line, '[.!?;:{WIDE_MARKS}]', '', 'g')) AS sentence,
      len(regexp_extract_all(line, '(?i)({"|".join(BOILERPLATE)})')) AS phrases,
      length(line) - length(regexp_replace(line, '[#*$%&|<>]', '', 'g')) AS symbols,
      len(list_filter(list_zip(w[2:], w[:-2]), lambda x: x[1] = x[2])) AS again
    FROM lines WHERE len(w) > 0
  )
),
per_line AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dup) AS n_dup_lines, count(*) FILTER (bad) AS n_bad_lines,
    coalesce(sum(n) FILTER (bad), 0) AS n_lost_words
  FROM judged GROUP BY doc_id
),
windows AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, array_to_string(w[i:i+{WINDOW - 1}], ' ')) AS times
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM words)
),
covered AS (
  SELECT doc_id, count(DISTINCT place) AS n_repeat_words
  FROM (SELECT doc_id, unnest(range(i, i + {WINDOW})) AS place FROM windows WHERE times > 1) GROUP BY doc_id
),
counted AS (
  SELECT docs.doc_id, CAST(len(w) AS BIGINT) AS n_words,
    CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
    CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines,
    CAST(coalesce(n_bad_lines, 0) AS BIGINT) AS n_bad_lines,
    CAST(coalesce(n_lost_words, 0) AS BIGINT) AS n_lost_words
  FROM docs JOIN words USING (doc_id) LEFT JOIN per_line USING (doc_id) LEFT JOIN covered USING (doc_id)
)
SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed,
  NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words)
    AND 100 * n_lost_words <= {MAX_LOST_PERCENT} * n_words AS kept
FROM counted
"""

OP10_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM v AS q JOIN v AS c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM scored QUALIFY rank <= 10
"""

# Sets of shingles, all pairs that share one, and what links reach.
OP5_SQL = """
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \\t-\\r]+'), lambda x: x <> '') AS w
  FROM documents
),
shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5
    THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s
  FROM words
),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
links AS (
  SELECT a, b FROM (
    SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL
  ) JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b
  WHERE 100 * common >= 80 * (p.n + q.n - common)
),
reach(a, b) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b
)
SELECT documents.doc_id, coalesce(n, 0) AS n_shingles, component_id
FROM documents LEFT JOIN sizes USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) USING (doc_id)
"""

# The same, with the links that each document has itself.
OP5_LINKS_SQL = OP5_SQL.replace(
    "component_id\nFROM documents",
    "component_id, (SELECT count(*) FROM links WHERE links.a = documents.doc_id) AS n_links\nFROM documents",
)

# Tokens, draws and both cuts of every text.
OP11_SQL = f"""
WITH tokens AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '-')) AS h,
    regexp_extract_all(coalesce(text, ''), '[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+') AS u
  FROM documents
),
drawn AS (
  SELECT *, len(u) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) % (len(u) + 1) AS a, CAST('0x' || substr(h, 9, 8) AS BIGINT) % (len(u) + 1) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>')
      OR CAST('0x' || substr(h, 17, 8) AS BIGINT) % 100 >= {CUT_PERCENT} THEN 'plain'
      WHEN CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 < {SPM_PERCENT} THEN 'spm' ELSE 'psm' END AS form
  FROM tokens
),
parts AS (
  SELECT *, array_to_string(u[1:least(a, b)], '') AS prefix, array_to_string(u[least(a, b) + 1:greatest(a, b)], '') AS middle,
    array_to_string(u[greatest(a, b) + 1:], '') AS suffix
  FROM drawn
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
  CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM parts
"""

# All windows of items, met with the windows of the same width of every text.
OP12_SQL = f"""
WITH small AS (
  SELECT 'd' AS kind, row_number() OVER () AS place, doc_id AS id, text FROM documents
  UNION ALL SELECT 'i', row_number() OVER (), item_id, text FROM benchmark
),
words AS (
  SELECT kind, place, id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM small
),
windows AS (
  SELECT DISTINCT id AS item_id, k, array_to_string(w[s:s + k - 1], ' ') AS t
  FROM (SELECT *, unnest(range(1, greatest(1, len(w) - {HIT_WINDOW - 1}) + 1)) AS s, least(len(w), {HIT_WINDOW}) AS k
    FROM words WHERE kind = 'i' AND len(w) > 0)
),
found AS (
  SELECT p.place, p.s, windows.k, windows.item_id
  FROM (
    SELECT place, w, k, unnest(range(1, len(w) - k + 2)) AS s
    FROM words CROSS JOIN (SELECT DISTINCT k FROM windows) WHERE kind = 'd' AND len(w) >= k
  ) AS p JOIN windows ON windows.k = p.k AND windows.t = array_to_string(p.w[p.s:p.s + p.k - 1], ' ')
),
hit AS (SELECT place, count(DISTINCT x) AS n FROM (SELECT place, unnest(range(s, s + k)) AS x FROM found) GROUP BY place),
items AS (
  SELECT place, count(*) AS n, string_agg(item, ',' ORDER BY item) AS ids
  FROM (SELECT DISTINCT place, CAST(item_id AS VARCHAR) AS item FROM found WHERE item_id IS NOT NULL) GROUP BY place
)
SELECT id AS doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(hit.n, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(items.n, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated
FROM words LEFT JOIN hit USING (place) LEFT JOIN items USING (place) WHERE kind = 'd'
"""


def _field(value: str) -> str:
    text = f"CAST({value} AS VARCHAR)"
    return f"coalesce(CAST(strlen({text}) AS VARCHAR) || ':' || {text}, '-')"


def _leaf(n_chars: str) -> str:
    return "sha256(" + " || ".join(_field(x) for x in ("doc_id", "source", "lang", n_chars, "text")) + ")"


# The levels of all trees, the siblings of each leaf, and each path folded step by step. crc32 goes bit by bit.
OP13_SQL = f"""
WITH RECURSIVE docs AS (
  SELECT *, xor(list_reduce(flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''),
    lambda c: [CAST(ord(c) AS BIGINT), 0, 0, 0, 0, 0, 0, 0])),
    lambda c, e: xor(xor(c, e) >> 1, (xor(c, e) & 1) * 3988292384), 4294967295::BIGINT), 4294967295::BIGINT) AS crc
  FROM documents
),
hashed AS (
  SELECT doc_id, lang, {_leaf("n_chars")} AS leaf, {_leaf("(CASE WHEN crc % 7 = 0 THEN n_chars + 1 ELSE n_chars END)")} AS altered FROM docs
),
leaves AS (
  SELECT *, row_number() OVER () AS place, count(*) OVER (PARTITION BY lang) AS n,
    row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i
  FROM hashed
),
nodes(lang, level, i, h, n) AS (
  SELECT lang, 0, i, leaf, n FROM leaves
  UNION ALL
  SELECT lang, level + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), (n + 1) // 2 FROM nodes WHERE n > 1 GROUP BY lang, level, i // 2, n
),
keys AS (
  SELECT lang, level AS height, h AS subroot, count(*) OVER () AS n, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i FROM nodes WHERE n = 1
),
tops(level, i, h, n) AS (
  SELECT 0, i, subroot, n FROM keys
  UNION ALL
  SELECT level + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), (n + 1) // 2 FROM tops WHERE n > 1 GROUP BY level, i // 2, n
),
levels AS (
  SELECT DISTINCT place, level AS step, leaves.i >> level AS i, nodes.lang, 'l' AS tree, level
  FROM leaves JOIN nodes ON nodes.lang IS NOT DISTINCT FROM leaves.lang AND nodes.n > 1
  UNION ALL
  SELECT DISTINCT place, height + tops.level, keys.i >> tops.level, keys.lang, 't', tops.level
  FROM leaves JOIN keys ON keys.lang IS NOT DISTINCT FROM leaves.lang JOIN tops ON tops.n > 1
),
steps AS (
  SELECT place, step, levels.i, coalesce(nodes.h, tops.h) AS sibling
  FROM levels
  LEFT JOIN nodes ON tree = 'l' AND nodes.lang IS NOT DISTINCT FROM levels.lang AND nodes.level = levels.level AND nodes.i = xor(levels.i, 1)
  LEFT JOIN tops ON tree = 't' AND tops.level = levels.level AND tops.i = xor(levels.i, 1)
),
folds(place, step, h) AS (
  SELECT place, 0, altered FROM leaves
  UNION ALL
  SELECT place, step + 1, sha256(CASE WHEN i % 2 = 1 THEN sibling || h ELSE h || coalesce(sibling, '') END) FROM folds JOIN steps USING (place, step)
),
folded AS (SELECT place, arg_max(h, step) AS folded_root FROM folds GROUP BY place),
proved AS (SELECT place, string_agg(sibling, '' ORDER BY step) AS siblings FROM steps GROUP BY place)
SELECT doc_id, leaf, subroot, root, sha256(coalesce(siblings, '')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM leaves JOIN keys ON keys.lang IS NOT DISTINCT FROM leaves.lang JOIN folded USING (place) LEFT JOIN proved USING (place)
  CROSS JOIN (SELECT h AS root FROM tops WHERE n = 1)
"""

ORACLES: dict[str, str] = {
    "op1_quality_lines": OP1_SQL,
    "op5_jaccard_join": OP5_SQL,
    "op5_jaccard_links": OP5_LINKS_SQL,
    "op10_top_k": OP10_SQL,
    "op11_fill_middle": OP11_SQL,
    "op12_decontamination": OP12_SQL,
    "op13_merkle_manifest": OP13_SQL,
}
