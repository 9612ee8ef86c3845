"""Registered queries of the training-data operators, with DuckDB text where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchgrain.functions.storage import cut_lineage
from matchgrain.llm import bpe, chat, collocations, decontaminate, fmindex, lines, minhash, packing, quality, ranking, resharding, suffixes, tables, tokenfile


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op3_minhash_odd_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


OP3_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(ws) < 3 THEN array_to_string(ws, ' ') ELSE array_to_string(ws[i:i + 2], ' ') END AS g
  FROM w, unnest(generate_series(1, greatest(len(ws) - 2, 1))) AS t(i) WHERE len(ws) > 0
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (
  SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS k FROM s AS a JOIN s AS b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2
), l AS (
  SELECT u, v FROM p JOIN n AS x ON x.doc_id = u JOIN n AS y ON y.doc_id = v WHERE 100 * k >= 85 * (x.n + y.n - k)
), r(id, c) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT l.v, r.c FROM r JOIN l ON l.u = r.id
), c AS (SELECT id, min(c) AS component_id FROM r GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, c.component_id = d.doc_id AS kept
FROM documents AS d LEFT JOIN n ON n.doc_id = d.doc_id JOIN c ON c.id = d.doc_id
"""

def op8_risk_controlled_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    signed = cut_lineage(quality.with_signals(table(spark, sf_dir, "documents").select("doc_id", "lang", "text")).drop("text"))
    cutoffs = quality.fit_cutoffs(signed, table(spark, sf_dir, "labels"))
    judged = quality.judge(signed, cutoffs)
    return judged.select(
        "doc_id", *[f"_signals.{c}" for c in quality.COUNTS], quality.base_failed(judged["_signals"]).alias("base_failed"), F.col("_kept").alias("kept")
    )


#: Views of the rules on a relation `src` (doc_id, lang, text) and the labels; the last one is `judged`.
QUALITY_VIEWS = r"""
q_words AS (
  SELECT row_number() OVER () AS rid, doc_id, lang, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^ 	-
]+') AS ws FROM src
), q_runs AS (
  SELECT rid, i, array_to_string(ws[i:i + 7], ' ') AS run FROM q_words, unnest(generate_series(1, len(ws) - 7)) AS t(i) WHERE len(ws) > 8
), q_twins AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, run) AS n FROM q_runs) WHERE n > 1
), q_cover AS (
  SELECT rid, sum(w) AS n FROM (SELECT rid, least(8, coalesce(i - lag(i) OVER (PARTITION BY rid ORDER BY i), 8)) AS w FROM q_twins) GROUP BY 1
), q_lines AS (
  SELECT rid, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^ 	-
]')) AS ls FROM q_words
), q_signals AS (
  SELECT w.rid, doc_id, coalesce(lang, '') AS stratum, len(ws)::BIGINT AS n_words,
    coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
    (length(text) - length(translate(text, '#*$%&|<>', '')))::BIGINT AS n_symbols,
    (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words, len(ls)::BIGINT AS n_lines
  FROM q_words AS w JOIN q_lines AS l ON l.rid = w.rid LEFT JOIN q_cover AS c ON c.rid = w.rid
), q_based AS (SELECT *, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed FROM q_signals),
q_values AS (
  SELECT rid, doc_id, stratum, base_failed, 'symbols' AS rule, coalesce(n_symbols / nullif(word_chars, 0), 0.0) AS x, 0.02::DOUBLE AS step FROM q_based
  UNION ALL SELECT rid, doc_id, stratum, base_failed, 'dup_lines', coalesce(n_dup_lines / nullif(n_lines, 0), 0.0), 0.02::DOUBLE FROM q_based
  UNION ALL SELECT rid, doc_id, stratum, base_failed, 'repeats', coalesce(n_repeat_words / nullif(n_words, 0), 0.0), 0.02::DOUBLE FROM q_based
  UNION ALL SELECT rid, doc_id, stratum, base_failed, 'long_words', coalesce(word_chars / nullif(n_words, 0), 0.0), 0.5::DOUBLE FROM q_based
), q_good AS (
  SELECT * FROM q_values WHERE NOT base_failed AND doc_id IN (SELECT doc_id FROM labels WHERE quality = 1 AND doc_id IS NOT NULL)
), q_sizes AS (SELECT stratum, rule, count(*) AS n FROM q_good GROUP BY 1, 2),
q_above AS (
  SELECT g.stratum, g.rule, j, count(*) FILTER (WHERE x > j * step) AS k FROM q_good AS g, unnest(generate_series(1, 50)) AS t(j) GROUP BY 1, 2, 3
), q_tail AS (
  SELECT a.stratum, a.rule, a.j, CASE WHEN k < n * 0.0125 THEN
    list_sum(list_transform(generate_series(0, k), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(0.0125) + (n - i) * ln(1 - 0.0125)))) ELSE 1 END AS p
  FROM q_above AS a JOIN q_sizes AS s ON s.stratum = a.stratum AND s.rule = a.rule
), q_cuts AS (SELECT stratum, rule, min(j) AS j FROM q_tail WHERE p <= 0.05 / (SELECT count(*) FROM q_sizes) GROUP BY 1, 2),
q_over AS (SELECT v.rid FROM q_values AS v JOIN q_cuts AS c ON c.stratum = v.stratum AND c.rule = v.rule WHERE v.x > c.j * v.step GROUP BY 1),
judged AS (SELECT b.*, NOT base_failed AND b.rid NOT IN (SELECT rid FROM q_over) AS kept FROM q_based AS b)
"""

OP8_SQL = f"""
WITH src AS (SELECT doc_id, lang, text FROM documents), {QUALITY_VIEWS}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept FROM judged
"""


def op2_template_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = lines.drop_recurring_lines(table(spark, sf_dir, "documents"))
    return cleaned.select("doc_id", "n_lines", "n_dropped", F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("kept_md5"))


def word_bpe() -> str:
    """Path of the public vocabulary that the BPE queries use; it is the same on every executor."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op6_trie_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encoding_digests(table(spark, sf_dir, "documents"), word_bpe())


#: Views of the line rule on a relation `src` (doc_id, text); the last one is `t_drops` (text_key, line_no).
LINE_VIEWS = r"""
t_lines AS (
  SELECT md5(text) AS text_key, doc_id, i - 1 AS line_no,
    list_transform(regexp_extract_all(string_split(text, chr(10))[i], '[^ 	-
]+'), lambda t: CASE WHEN regexp_matches(t, '[0-9]') THEN '<*>' ELSE t END) AS tokens
  FROM src, unnest(generate_series(1, len(string_split(text, chr(10))))) AS u(i) WHERE text IS NOT NULL
), t_leaves AS (
  SELECT text_key, line_no, min(doc_id) AS doc_id, any_value(tokens) AS tokens, len(any_value(tokens)) || ' ' || array_to_string(any_value(tokens)[1:4], ' ') AS leaf
  FROM t_lines WHERE len(tokens) > 0 GROUP BY 1, 2
), t_owned AS (
  SELECT *, array_to_string(tokens, ' ') AS content FROM t_leaves WHERE leaf IN (SELECT leaf FROM t_leaves GROUP BY 1 HAVING count(DISTINCT text_key) >= 5)
), t_contents AS (SELECT leaf, content, any_value(tokens) AS tokens FROM t_owned GROUP BY 1, 2),
t_votes AS (
  SELECT leaf, i, tokens[i] AS token, count(*) AS n FROM t_contents, unnest(generate_series(1, len(tokens))) AS u(i) GROUP BY 1, 2, 3
), t_constants AS (
  SELECT leaf, i, CASE WHEN 2 * max(n) >= sum(n) THEN max(struct_pack(n := n, token := token)).token END AS token FROM t_votes GROUP BY 1, 2
), t_agreed AS (
  SELECT c.leaf, c.content, count(*) FILTER (WHERE c.tokens[k.i] = k.token) AS same, len(any_value(c.tokens)) AS m
  FROM t_contents AS c JOIN t_constants AS k ON k.leaf = c.leaf GROUP BY 1, 2
), t_placed AS (
  SELECT o.text_key, o.line_no, o.doc_id, o.leaf, CASE WHEN same >= 0.7::DOUBLE * m THEN '' ELSE o.content END AS template
  FROM t_owned AS o JOIN t_agreed AS a ON a.leaf = o.leaf AND a.content = o.content
), t_support AS (
  SELECT leaf, template, count(DISTINCT text_key) AS texts, (min(struct_pack(a := doc_id IS NULL, b := doc_id, c := text_key))).c AS owner FROM t_placed GROUP BY 1, 2
), t_drops AS (
  SELECT DISTINCT p.text_key, p.line_no FROM t_placed AS p JOIN t_support AS s ON s.leaf = p.leaf AND s.template = p.template WHERE texts >= 5 AND p.text_key <> owner
)
"""

OP2_SQL = f"""
WITH src AS (SELECT doc_id, text FROM documents), {LINE_VIEWS},
t_lists AS (SELECT text_key, list(line_no) AS gone FROM t_drops GROUP BY 1)
SELECT d.doc_id, coalesce(len(string_split(d.text, chr(10))), 0)::BIGINT AS n_lines, coalesce(len(l.gone), 0)::BIGINT AS n_dropped,
  md5(coalesce(CASE WHEN l.gone IS NULL THEN d.text ELSE array_to_string(list_filter(string_split(d.text, chr(10)), lambda x, i: NOT list_contains(l.gone, i - 1)), chr(10)) END, '')) AS kept_md5
FROM src AS d LEFT JOIN t_lists AS l ON l.text_key = md5(d.text)
"""

def op1_perspective_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mask as text, `start-end` pairs joined by commas."""
    spans = F.transform("mask", lambda m: F.concat(m["start"].cast("string"), F.lit("-"), m["end"].cast("string")))
    return chat.rotate(table(spark, sf_dir, "conversations")).withColumn("mask", F.array_join(spans, ","))


OP1_SQL = r"""
WITH said AS (
  SELECT conv_id, turn, replace(coalesce(role, 'unknown'), '<|', '< |') AS role, replace(coalesce(text, ''), '<|', '< |') AS text,
    coalesce(floor(turn / 64), -1)::BIGINT AS part FROM conversations
), speakers AS (SELECT DISTINCT conv_id, role AS perspective FROM said WHERE role <> 'system'),
pieces AS (
  SELECT s.*, p.perspective, s.role = p.perspective AS target,
    '<|im_start|>' || CASE WHEN s.role = p.perspective THEN 'assistant' WHEN s.role = 'system' THEN 'system' ELSE 'user name=' || s.role END || chr(10) AS head
  FROM said AS s JOIN speakers AS p ON p.conv_id IS NOT DISTINCT FROM s.conv_id
), placed AS (
  SELECT *, length(head) + length(text) + 11 AS n,
    row_number() OVER (PARTITION BY conv_id, perspective, part ORDER BY turn NULLS FIRST, role, text) AS k FROM pieces
), walked AS (SELECT *, sum(n) OVER (PARTITION BY conv_id, perspective, part ORDER BY k) - n AS pos FROM placed),
parts AS (
  SELECT conv_id, perspective, part, count(*) AS n_turns, coalesce(sum(length(text) + 10) FILTER (WHERE target), 0)::BIGINT AS n_target,
    string_agg(head || text || '<|im_end|>' || chr(10), '' ORDER BY k) AS text, sum(n)::BIGINT AS n_chars,
    coalesce(string_agg((pos + length(head))::BIGINT || '-' || (pos + length(head) + length(text) + 10)::BIGINT, ',' ORDER BY k) FILTER (WHERE target), '') AS mask
  FROM walked GROUP BY 1, 2, 3
)
SELECT conv_id, perspective, part, n_turns, n_target, text, mask,
  (sum(n_chars) OVER (PARTITION BY conv_id, perspective ORDER BY part) - n_chars)::BIGINT AS char_start FROM parts
"""


def op4_simhash_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_linear_grouping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeats(table(spark, sf_dir, "documents"), full=False).withColumnRenamed("kept", "kept_sha256")


def op7_min_cost_resharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Old shards: 12 folders, by a hash of the source; new: 16, by row counts. Rows are read back from the rewritten files."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    folder = tables.fresh_folder(spark, "shards")
    resharding.write_layout(docs, F.pmod(F.crc32(F.coalesce("source", F.lit("")).cast("binary")), F.lit(12)), folder)
    rows, affected = resharding.reshard(spark.read.parquet(folder), F.col("shard"))
    resharding.rewrite_affected(rows, affected, folder)
    return spark.read.schema(rows.schema).parquet(folder).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "old_shard"
    )


def op9_fm_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fmindex.remove_earlier_passages(table(spark, sf_dir, "documents"), full=False).withColumnRenamed("kept", "kept_sha256")


OP9_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (
  SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS g FROM w, unnest(generate_series(1, len(ws) - 12)) AS t(i) WHERE len(ws) >= 13
), late AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY g) AS first FROM g) WHERE first < doc_id),
gone AS (SELECT doc_id, list(DISTINCT i + k) AS cut FROM late, unnest(generate_series(0, 12)) AS t(k) GROUP BY 1)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(len(cut), 0)::BIGINT AS n_removed,
  sha256(coalesce(array_to_string(list_filter(ws, lambda x, i: cut IS NULL OR NOT list_contains(cut, i)), ' '), '')) AS kept_sha256
FROM w LEFT JOIN gone ON gone.doc_id = w.doc_id
"""


def op10_parquet_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = tables.fresh_folder(spark, "tokens")
    tokenfile.write_tokens(table(spark, sf_dir, "documents"), folder, word_bpe())
    return tokenfile.checksums(tokenfile.read_tokens(spark, folder))


def op11_toivonen_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, doc_id, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
g AS (SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase FROM w, unnest([1, 2, 3, 4]) AS t(k), unnest(generate_series(1, len(ws) - k + 1)) AS u(i)),
f AS (SELECT lang, k, phrase, count(*)::BIGINT AS a FROM g GROUP BY 1, 2, 3 HAVING count(*) >= 30),
n AS (SELECT lang, count(*)::BIGINT AS n FROM g WHERE k = 1 GROUP BY 1),
c AS (SELECT lang, k, phrase, a, string_split(phrase, ' ') AS ws FROM f WHERE k > 1),
s AS (
  SELECT c.lang, c.phrase, c.a, i, x.a AS l, y.a AS r, (2000000::HUGEINT * c.a // (x.a + y.a))::BIGINT AS score
  FROM c, unnest(generate_series(1, k - 1)) AS t(i)
  JOIN f AS x ON x.lang = c.lang AND x.phrase = array_to_string(ws[1:i], ' ') JOIN f AS y ON y.lang = c.lang AND y.phrase = array_to_string(ws[i + 1:], ' ')
), b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, i) = 1),
o AS (
  SELECT lang, phrase, max(a) AS longer FROM (
    SELECT lang, a, array_to_string(ws[i:i + m - 1], ' ') AS phrase FROM c, unnest([2, 3]) AS t(m), unnest(generate_series(1, k - m + 1)) AS u(i) WHERE m < k
  ) GROUP BY 1, 2
), r AS (
  SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, encode(b.phrase))::INTEGER AS rank
  FROM b LEFT JOIN o ON o.lang = b.lang AND o.phrase = b.phrase WHERE coalesce(100 * longer < 80 * a, true)
)
SELECT r.lang, rank, phrase, a, l, r, n, score FROM r JOIN n ON n.lang = r.lang WHERE rank <= 2000
"""


def byte_bpe() -> str:
    """Path of the public byte-level vocabulary; it is the same on every executor."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op12_bin_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), byte_bpe())


def op13_pipelined_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP13_SQL = r"""
WITH t AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents
), f AS (SELECT doc_id, term, count(*)::BIGINT AS tf FROM t GROUP BY 1, 2),
d AS (SELECT doc_id, count(*)::BIGINT AS n FROM t GROUP BY 1),
c AS (SELECT count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS n_terms FROM d),
m AS (SELECT doc_id, 100 - 50 + (50 * n * n_docs) // n_terms AS m FROM d, c),
w AS (SELECT term, floor(1000 * ln((2 * any_value(n_docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM f, c GROUP BY 1),
i AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
), s AS (
  SELECT item_id, f.doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score
  FROM i JOIN f ON f.term = i.term JOIN w ON w.term = i.term JOIN m ON m.doc_id = f.doc_id GROUP BY 1, 2
), r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 50
"""

QUERIES = {
    "op1_perspective_rotation": op1_perspective_rotation,
    "op2_template_tree": op2_template_tree,
    "op3_minhash_odd_sketch": op3_minhash_odd_sketch,
    "op4_simhash_windows": op4_simhash_windows,
    "op5_linear_grouping": op5_linear_grouping,
    "op6_trie_bpe": op6_trie_bpe,
    "op7_min_cost_resharding": op7_min_cost_resharding,
    "op8_risk_controlled_rules": op8_risk_controlled_rules,
    "op9_fm_index": op9_fm_index,
    "op10_parquet_tokens": op10_parquet_tokens,
    "op11_toivonen_phrases": op11_toivonen_phrases,
    "op12_bin_completion": op12_bin_completion,
    "op13_pipelined_terms": op13_pipelined_terms,
}
ORACLES = {
    "op1_perspective_rotation": OP1_SQL,
    "op2_template_tree": OP2_SQL,
    "op3_minhash_odd_sketch": OP3_SQL,
    "op8_risk_controlled_rules": OP8_SQL,
    "op9_fm_index": OP9_SQL,
    "op11_toivonen_phrases": OP11_SQL,
    "op13_pipelined_terms": OP13_SQL,
}
