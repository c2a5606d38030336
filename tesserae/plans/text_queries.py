"""Queries over plain text. A document's lines stand for paragraphs; the template keeps lines with
number % 3 <> 1 and the destination those with number % 3 <> 2, so that both share every third line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.functions import text as T
from tesserae.operators import match
from tesserae.sources import spread, table


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pair_id, normal): the non-empty lines of documents; the table is spread, as small ones are one file."""
    docs = spread(table(spark, sf_dir, "documents"))
    return docs.select(F.col("doc_id").alias("pair_id"), T.blocks(F.replace("text", F.lit("\n"), F.lit("\n\n"))).alias("normal"))


def sides(spark: SparkSession, sf_dir: str, shortened: bool = False) -> DataFrame:
    """(pair_id, side, index, normalized, total) of both sides, from one reading. shortened: the first
    word of the destination's lines is taken away."""
    keep = lambda drop: F.filter(F.transform("normal", lambda b, p: F.struct(p.alias("p"), b.alias("b"))), lambda x: (x["p"] + 1) % 3 != drop)
    both = _lines(spark, sf_dir).select("pair_id", F.posexplode(F.array(keep(1), keep(2))).alias("side", "kept"))
    rows = both.select("pair_id", "side", F.size("kept").alias("total"), F.posexplode("kept").alias("index", "one"))
    text = F.col("one.b")
    normalized = F.when(F.col("side") == 1, F.regexp_replace(text, r"\A[^ ]+ ", "")).otherwise(text) if shortened else text
    return rows.select("pair_id", "side", "index", normalized.alias("normalized"), "total")


def text_exact_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    matched = match.match_tagged_exact(sides(spark, sf_dir))
    count = lambda s: F.count_if(F.col("status") == s).alias(s)
    return matched.groupBy("pair_id").agg(count("matched"), count("unmatched_template"), count("unmatched_destination"))


def text_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents"))
    normal = T.normalize_text(F.col("text"))
    return docs.select("doc_id", F.md5(normal).alias("normalized_md5"), F.length(normal).cast("long").alias("n_chars"))


def text_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks with their spans in the normalised text; a line is a paragraph."""
    docs = spread(table(spark, sf_dir, "documents"))
    spans = T.block_spans(T.blocks(F.replace("text", F.lit("\n"), F.lit("\n\n"))))
    return docs.select("doc_id", F.explode(spans).alias("b")).select("doc_id", F.col("b.index").cast("long").alias("index"), F.col("b.start").cast("long").alias("start"), F.col("b.end").cast("long").alias("stop"))


def _blocks(spark: SparkSession, sf_dir: str, shift: int) -> DataFrame:
    lines = T.blocks(F.replace("text", F.lit("\n"), F.lit("\n\n")))
    return spread(table(spark, sf_dir, "documents")).select((F.col("doc_id") + shift).alias("pair_id"), lines.alias("blocks"))


def text_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document against the one before it."""
    scored = match.similarity(_blocks(spark, sf_dir, 0), _blocks(spark, sf_dir, 1))
    return match.is_similar(scored, 0.1).select("pair_id", F.round("score", 6).alias("score"), "matched")


def text_refined_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both phases over documents; of the destination's lines the first word is taken away."""
    found = match.match_tagged(sides(spark, sf_dir, shortened=True))
    return found.select("pair_id", "phase", "template_index", "destination_index", F.round("score", 6).alias("score"))


def text_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = match.merge_tagged(sides(spark, sf_dir))
    return merged.select("pair_id", F.md5("output").alias("output_md5"), F.length("output").cast("long").alias("n_chars"))


LINES_SQL = r"""lines AS (
  SELECT doc_id AS pair_id, unnest(list_filter(list_transform(string_split(replace(text, chr(13), chr(10)), chr(10)),
           lambda x: trim(regexp_replace(x, '[\t\n\x0B\f\r ]+', ' ', 'g'))), lambda x: x <> '')) AS normalized,
         generate_subscripts(list_filter(list_transform(string_split(replace(text, chr(13), chr(10)), chr(10)),
           lambda x: trim(regexp_replace(x, '[\t\n\x0B\f\r ]+', ' ', 'g'))), lambda x: x <> ''), 1) AS line_no
  FROM documents)"""

BLOCKS_SQL = LINES_SQL.replace("lines AS (", "blocks AS (").replace("doc_id AS pair_id", "doc_id")

QUERIES = {
    "text_exact_match": text_exact_match,
    "text_normalize": text_normalize,
    "text_blocks": text_blocks,
    "text_similarity": text_similarity,
    "text_refined_match": text_refined_match,
    "text_merge": text_merge,
}
ORACLES = {
    "text_exact_match": f"""WITH {LINES_SQL},
t AS (SELECT *, row_number() OVER (PARTITION BY pair_id, normalized ORDER BY line_no) AS k FROM lines WHERE line_no % 3 <> 1),
d AS (SELECT *, row_number() OVER (PARTITION BY pair_id, normalized ORDER BY line_no) AS k FROM lines WHERE line_no % 3 <> 2)
SELECT pair_id, count(*) FILTER (t.line_no IS NOT NULL AND d.line_no IS NOT NULL) AS matched,
       count(*) FILTER (d.line_no IS NULL) AS unmatched_template, count(*) FILTER (t.line_no IS NULL) AS unmatched_destination
FROM t FULL JOIN d USING (pair_id, normalized, k) GROUP BY pair_id""",
    "text_normalize": r"""WITH normal AS (SELECT doc_id, array_to_string(list_filter(list_transform(
  regexp_split_to_array(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '\n[\t\n\x0B\f\r ]*\n'),
  lambda x: trim(regexp_replace(x, '[\t\n\x0B\f\r ]+', ' ', 'g'))), lambda x: x <> ''), chr(10) || chr(10)) AS t FROM documents)
SELECT doc_id, md5(t) AS normalized_md5, length(t) AS n_chars FROM normal""",
    "text_blocks": f"""WITH {BLOCKS_SQL}
SELECT doc_id, line_no - 1 AS index, coalesce(sum(length(normalized) + 2) OVER before, 0)::BIGINT AS start,
       (coalesce(sum(length(normalized) + 2) OVER before, 0) + length(normalized))::BIGINT AS stop
FROM blocks WINDOW before AS (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
    "text_similarity": f"""WITH {LINES_SQL},
words AS (SELECT pair_id, line_no, list_distinct(string_split(normalized, ' ')) AS w FROM lines),
pairs AS (SELECT doc_id AS pair_id FROM documents WHERE doc_id - 1 IN (SELECT doc_id FROM documents)),
sizes AS (SELECT p.pair_id, greatest((SELECT count(*) FROM lines l WHERE l.pair_id = p.pair_id), (SELECT count(*) FROM lines l WHERE l.pair_id = p.pair_id - 1)) AS n FROM pairs p),
hits AS (SELECT a.pair_id, sum(len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))) ORDER BY a.line_no) AS s
         FROM words a JOIN words b ON b.pair_id = a.pair_id - 1 AND a.line_no = b.line_no GROUP BY a.pair_id),
scored AS (SELECT pair_id, CASE WHEN n = 0 THEN 1.0 ELSE coalesce(s, 0) / n END AS score FROM sizes LEFT JOIN hits USING (pair_id))
SELECT pair_id, round(score, 6) AS score, score >= 0.1 AS matched FROM scored""",
}
