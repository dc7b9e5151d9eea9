"""The registered queries of this subpackage, one thin function for each operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    conversation_repair,
    gru_lm,
    html_text,
    language_id,
    line_dedup,
    mixing,
    ngram_join,
    packing,
    quality_rules,
    rp_forest,
    simple8b,
    toxicity,
    whitening,
)
from .common import table
from .tokens import public_path

QUERIES = {}
ORACLES = {}


def query(sql: str | None = None):
    def register(build):
        QUERIES[build.__name__] = build
        if sql is not None:
            ORACLES[build.__name__] = sql
        return build

    return register


@query()
def op1_kneser_ney_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's score, learned from labels of three in four ids."""
    rest = F.pmod(F.crc32(F.col("id").cast("string")), F.lit(4))
    found = toxicity.scored(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), rest != 2
    )
    return found.select(
        F.col("id").alias("doc_id"), F.coalesce(rest == 2, F.lit(False)).alias("held_out"), "score", "predicted"
    )


_OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
lines AS (
  SELECT doc_id, source, t, unnest(string_split(t, chr(10))) AS raw,
         generate_subscripts(string_split(t, chr(10)), 1) AS pos FROM d),
worded AS (
  SELECT *, trim(regexp_replace(translate(lower_az, chr(9) || chr(11) || chr(12) || chr(13),
                 '    '), ' {2,}', ' ', 'g')) AS line
  FROM (SELECT *, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')
               AS lower_az FROM lines)
  WHERE regexp_matches(raw, '[^\x20\x09-\x0D]')),
hosts AS (SELECT source, count(DISTINCT t) AS n FROM d GROUP BY source),
frequent AS (
  SELECT w.source, line FROM worded w JOIN hosts h ON w.source IS NOT DISTINCT FROM h.source
  GROUP BY w.source, line, h.n
  HAVING count(DISTINCT t) > 10 AND count(DISTINCT t) > h.n * 0.10),
gone AS (
  SELECT doc_id, sum(length(replace(w.line, ' ', ''))) AS chars FROM worded w
  JOIN frequent f ON w.line = f.line AND w.source IS NOT DISTINCT FROM f.source
  GROUP BY doc_id),
dups AS (
  SELECT doc_id, count(*) - count(DISTINCT raw) AS n FROM worded GROUP BY doc_id),
windows AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS n
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 4)),
repeats AS (
  SELECT doc_id, count(DISTINCT i + j) AS n FROM windows, (SELECT unnest([0, 1, 2]) AS j)
  WHERE n > 1 GROUP BY doc_id),
figures AS (
  SELECT d.doc_id, len(w) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))
           AS word_chars,
         length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         coalesce(u.n, 0) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words,
         coalesce(g.chars, 0) AS removed_chars
  FROM d LEFT JOIN dups u USING (doc_id) LEFT JOIN repeats r USING (doc_id)
  LEFT JOIN gone g USING (doc_id))
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars,
       n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
       n_repeat_words::BIGINT AS n_repeat_words,
       (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words)
         AND NOT removed_chars > word_chars * 0.5 AS kept,
       removed_chars::BIGINT AS removed_chars
FROM figures
"""


@query(_OP2_SQL)
def op2_line_frequency_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures of every document, and whether the rules keep it."""
    rows = quality_rules.judged(table(spark, sf_dir, "documents"), carry=["doc_id"])
    return rows.select(
        "_doc.doc_id",
        *[f"_m.{c}" for c in quality_rules.MEASURES],
        "_m.base_failed",
        F.col("_kept").alias("kept"),
        F.col("_gone_chars").cast("long").alias("removed_chars"),
    )


_OP3_SQL = r"""
WITH lines AS (
  SELECT doc_id, generate_subscripts(l, 1) AS pos, unnest(l) AS line FROM (
    SELECT doc_id, string_split(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
           'abcdefghijklmnopqrstuvwxyz'), chr(10)) AS l FROM documents)),
sets AS (
  SELECT * FROM (SELECT doc_id, pos, length(line) AS chars,
    list_sort(list_distinct(regexp_extract_all(line, '[^\x20\x09-\x0D]+'))) AS s FROM lines)
  WHERE len(s) >= 1),
classes AS (SELECT s, len(s) AS n, min((doc_id, pos)) AS at FROM sets GROUP BY s),
near AS (
  SELECT DISTINCT b.s FROM classes a JOIN classes b
  ON a.at < b.at AND 80 * a.n <= 100 * b.n AND 80 * b.n <= 100 * a.n
  WHERE 180 * len(list_intersect(a.s, b.s)) >= 80 * (a.n + b.n)),
marked AS (
  SELECT x.doc_id, x.chars, (n.s IS NOT NULL OR (x.doc_id, x.pos) <> c.at) AS removed
  FROM sets x JOIN classes c USING (s) LEFT JOIN near n USING (s))
SELECT d.doc_id, count(chars)::BIGINT AS n_lines,
       count(*) FILTER (WHERE removed)::BIGINT AS n_removed,
       coalesce(sum(chars) FILTER (WHERE removed), 0)::BIGINT AS removed_chars
FROM documents d LEFT JOIN marked USING (doc_id) GROUP BY d.doc_id
"""


@query(_OP3_SQL)
def op3_line_similarity_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its lines that have words, and those removed as later ones."""
    documents = table(spark, sf_dir, "documents")
    found = line_dedup.later_matches(documents)
    gone = F.col("removed")
    sums = found.groupBy("key").agg(
        F.count("*").alias("n_lines"),
        F.count_if(gone).alias("n_removed"),
        F.sum(F.when(gone, F.col("chars")).otherwise(0)).cast("long").alias("removed_chars"),
    )
    rows = documents.select("doc_id").join(sums, F.col("doc_id").eqNullSafe(F.col("key")), "left")
    return rows.select(
        "doc_id",
        *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_lines", "n_removed", "removed_chars")],
    )


@query()
def op4_rp_forest_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors found for every 20th one."""
    return rp_forest.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


@query()
def op5_simple8b_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place and checksum, read back from the coded files."""
    documents = table(spark, sf_dir, "documents")
    return simple8b.coded(documents, public_path("byte_bpe_50k.json"))


@query()
def op6_shortest_pack_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place in a sequence of up to 1024 ids."""
    return packing.packed(table(spark, sf_dir, "documents"), public_path("byte_bpe_50k.json"))


_OP7_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, '7|' || doc_id || '|' || md5(coalesce(text, '')) AS name FROM documents),
counts AS (SELECT source, count(*) AS n, 1.0::DOUBLE AS w FROM d GROUP BY source),
means AS (
  SELECT source, (SELECT sum(n)::DOUBLE FROM counts) * w / (SELECT sum(w) FROM counts) / n AS mean
  FROM counts),
rates AS (
  SELECT source, greatest(1, ceil(mean / 16))::BIGINT AS parts,
         mean / greatest(1, ceil(mean / 16)) AS rate FROM means),
cdf AS (
  SELECT source, rate, 0 AS k, exp(-rate) AS p, exp(-rate) AS s FROM rates
  UNION ALL
  SELECT source, rate, k + 1, p * rate / (k + 1), s + p * rate / (k + 1) FROM cdf WHERE k < 80),
draws AS (
  SELECT doc_id, d.source, name, part,
         ('0x' || substr(md5(name || '|' || part), 1, 13))::BIGINT / 4503599627370496.0 AS u
  FROM (SELECT d.*, unnest(range(1, parts + 1)) AS part
        FROM d JOIN rates r ON d.source IS NOT DISTINCT FROM r.source) d),
times AS (
  SELECT doc_id, name, part, count(*) AS n FROM draws x JOIN cdf c
  ON x.source IS NOT DISTINCT FROM c.source AND c.s <= x.u GROUP BY 1, 2, 3),
copies AS (
  SELECT doc_id, name, (part - 1) * 81 + unnest(range(0, n)) AS copy FROM times)
SELECT doc_id, copy::BIGINT AS copy,
       ('0x' || substr(md5(name || '|copy|' || copy), 1, 13))::BIGINT AS shuffle_order
FROM copies
"""


@query(_OP7_SQL)
def op7_poisson_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every copy that an even mix of the sources takes, with its place in the shuffle."""
    rows = mixing.replicated(table(spark, sf_dir, "documents"), carry=["doc_id"])
    return rows.select(
        "_doc.doc_id", F.col("_copy").alias("copy"), F.col("_order").alias("shuffle_order")
    )


_OP10_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN []
    WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])
    END) AS g FROM d),
sizes AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b
  ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM shared JOIN sizes x ON a = x.doc_id JOIN sizes y ON b = y.doc_id
  WHERE 100 * c >= 90 * (x.n + y.n - c)),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles,
       (SELECT min(b) FROM reach WHERE reach.a = d.doc_id) AS component_id
FROM d LEFT JOIN sizes USING (doc_id)
"""


@query()
def op8_text_to_tag_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page with its main text."""
    found = html_text.main_texts(table(spark, sf_dir, "pages"))
    return found.select(
        F.col("key").alias("page_id"),
        "url",
        "text",
        F.length("text").cast("long").alias("n_chars"),
        "n_blocks",
    )


@query()
def op9_gru_log_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's log-probability, learned from four in five ids."""
    rest = F.pmod(F.crc32(F.col("id").cast("string")), F.lit(5))
    found = gru_lm.scored(table(spark, sf_dir, "documents"), rest != 1)
    return found.select(
        F.col("id").alias("doc_id"),
        F.coalesce(rest == 1, F.lit(False)).alias("held_out"),
        "n_tokens",
        "n_known",
        "train_tokens",
        "base_score",
        "score",
    )


@query(_OP10_SQL)
def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the size of its set of 3-word shingles and its component."""
    found = ngram_join.groups(table(spark, sf_dir, "documents"), width=3, percent=90)
    return found.select(
        F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id")
    )


@query()
def op11_ftrl_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language, learned from three in four ids."""
    rest = F.pmod(F.crc32(F.col("id").cast("string")), F.lit(4))
    found = language_id.identified(table(spark, sf_dir, "documents"), rest != 2)
    held_out = F.coalesce(rest == 2, F.lit(False))
    return found.select(F.col("id").alias("doc_id"), held_out.alias("held_out"), "lang_pred", "score")


@query()
def op12_run_length_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, damaged by a checksum of its rows, with its cheapest repair."""
    rows = conversation_repair.damaged(
        table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text"
    )
    return conversation_repair.repaired(rows)


@query()
def op13_chebyshev_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's whitened components, up to 16."""
    return whitening.whitened(table(spark, sf_dir, "embeddings"))
