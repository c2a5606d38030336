"""Matching of a template side against a destination side, as joins."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tesserae.functions import refined


def tagged(template: DataFrame, destination: DataFrame) -> DataFrame:
    """Both sides as one table, with side 0 for the template's rows and 1 for the destination's."""
    return template.withColumn("side", F.lit(0)).unionByName(destination.withColumn("side", F.lit(1)))


def _of_side(side: int, column: str) -> Column:
    return F.when(F.col("side") == side, F.col(column))


def _numbered(blocks: DataFrame, pair: str) -> DataFrame:
    """Blocks (pair, side, index, normalized) with k, which numbers a side's repeats of a block. One shuffle, on
    the pair; what follows on the pair, or on the pair and more, needs none."""
    order = Window.partitionBy(pair, "normalized", "side").orderBy("index")
    # the number is said, for AQE would put few bytes into one task, and distances are much work a byte
    spark = blocks.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return blocks.repartition(parts, pair).withColumn("k", F.row_number().over(order))


def match_tagged_exact(blocks: DataFrame, pair: str = "pair_id") -> DataFrame:
    """match_text_blocks_exact for both sides in one table (pair, side, index, normalized)."""
    found = _numbered(blocks, pair).groupBy(pair, "normalized", "k").agg(F.min(_of_side(0, "index")).alias("template_index"), F.min(_of_side(1, "index")).alias("destination_index"))
    status = F.when(F.col("destination_index").isNull(), "unmatched_template").when(F.col("template_index").isNull(), "unmatched_destination").otherwise("matched")
    return found.select(pair, status.alias("status"), "template_index", "destination_index", "normalized")


def match_text_blocks_exact(template: DataFrame, destination: DataFrame, pair: str = "pair_id") -> DataFrame:
    """Exact block match: the k-th occurrence of a block matches the k-th on the other side.

    Both sides have (pair, index, normalized). Returns (pair, status, template_index,
    destination_index, normalized) with status matched, unmatched_template or
    unmatched_destination. No join: equal blocks of both sides are grouped by their number.
    """
    return match_tagged_exact(tagged(*(df.select(pair, "index", "normalized") for df in (template, destination))), pair)


def match_owners(template: DataFrame, destination: DataFrame, pair: str = "pair_id") -> DataFrame:
    """(pair, status, path, ord): owners (pair, ord, path) of both sides matched by path. Repeats stay and
    ord keeps each side's order."""
    return match_tagged_owners(tagged(*(df.select(pair, "ord", "path") for df in (template, destination))), pair)


def match_tagged_owners(owners: DataFrame, pair: str = "pair_id") -> DataFrame:
    """match_owners for both sides in one table (pair, side, ord, path): one shuffle, and one row of a
    window tells whether the other side has the path."""
    here = Window.partitionBy(pair, "path")
    told = owners.withColumn("both", F.min("side").over(here) < F.max("side").over(here)).filter((F.col("side") == 0) | ~F.col("both"))
    status = F.when(F.col("both"), "matched").when(F.col("side") == 0, "unmatched_template").otherwise("unmatched_destination")
    return told.select(pair, status.alias("status"), "path", "ord")


def match_text_blocks(template: DataFrame, destination: DataFrame, pair: str = "pair_id") -> DataFrame:
    """(pair, phase, template_index, destination_index, score): exact matches, then refined ones among what
    is left (pair, index, normalized, total): in the destination's order each block takes the best
    scoring free template block, the first of equals. Blocks without a match have phase null."""
    return match_tagged(tagged(*(df.select(pair, "index", "normalized", "total") for df in (template, destination))), pair)


_MATCH = "struct<phase:string,template_index:long,destination_index:long,score:double>"


def _matched(rows: list[dict], refine: bool) -> list[dict]:
    """The matches of a pair's rows (template_index, destination_index, normalized, total) of the exact phase."""
    alone = lambda mine, other: [{"index": r[mine], "normalized": r["normalized"], "total": r["total"]} for r in rows if r[mine] is not None and r[other] is None and r["normalized"] is not None]
    sides = alone("template_index", "destination_index"), alone("destination_index", "template_index")
    ways = refined.ways(*sides) if refine and all(sides) else []
    used_t, used_d = ({w[k] for w in ways} for k in (0, 1))
    out = [{"phase": "refined", "template_index": t, "destination_index": d, "score": score} for t, d, score in ways]
    for r in rows:
        t, d = r["template_index"], r["destination_index"]
        both = t is not None and d is not None
        if both or not (t in used_t if d is None else d in used_d):
            out.append({"phase": "exact" if both else None, "template_index": t, "destination_index": d, "score": 1.0 if both else None})
    return out


def _by_pair(blocks: DataFrame, pair: str, result: Callable[[list[dict], list[dict]], object], ddl: str) -> DataFrame:
    """(pair, out): of each pair result(rows of the exact phase, their matches). One shuffle, on the pair; a task
    has one pair's blocks as Python's at a time."""
    exact = _numbered(blocks, pair).groupBy(pair, "normalized", "k").agg(*(F.min(_of_side(s, "index")).cast("long").alias(f"{c}_index") for s, c in ((0, "template"), (1, "destination"))), F.max("total").cast("long").alias("total"))
    listed = exact.groupBy(pair).agg(F.collect_list(F.struct("template_index", "destination_index", "normalized", "total")).alias("rows"))
    kind = to_arrow_type(T.StructType.fromDDL(f"x {ddl}")[0].dataType)

    def matched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for of, row in zip(batch.column(0), batch.column(1), strict=True):
                rows = row.as_py()
                out.append(result(rows, _matched(rows, of.is_valid)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, kind)], [pair, "out"])

    return listed.mapInArrow(matched, f"`{pair}` {blocks.schema[pair].dataType.simpleString()}, out {ddl}")


def match_tagged(blocks: DataFrame, pair: str = "pair_id") -> DataFrame:
    """match_text_blocks for both sides in one table (pair, side, index, normalized, total)."""
    index = blocks.schema["index"].dataType
    found = _by_pair(blocks, pair, lambda _, matches: matches, f"array<{_MATCH}>").select(pair, F.inline("out"))
    return found.select(pair, "phase", *(F.col(c).cast(index).alias(c) for c in ("template_index", "destination_index")), "score")


def similarity(left: DataFrame, right: DataFrame, pair: str = "pair_id") -> DataFrame:
    """(pair, score): mean Jaccard of the blocks at equal index over the longer side; 1.0 if both are
    empty. Sides have (pair, blocks); sums run in the order of the index."""
    from tesserae.functions import text

    split = lambda df, name: df.select(pair, F.transform("blocks", text.words).alias(name))
    both = split(left, "a").join(split(right, "b"), pair)
    total = F.greatest(F.size("a"), F.size("b"))
    parts = F.zip_with("a", "b", lambda x, y: F.when(x.isNull() | y.isNull(), 0.0).otherwise(text.jaccard(x, y)))
    score = F.when(total == 0, 1.0).otherwise(F.aggregate(parts, F.lit(0.0), lambda acc, x: acc + x) / total)
    return both.select(pair, score.alias("score"))


def is_similar(scored: DataFrame, threshold: float) -> DataFrame:
    """scored with threshold and matched."""
    return scored.withColumn("threshold", F.lit(float(threshold))).withColumn("matched", F.col("score") >= threshold)


def merge_text(template: DataFrame, destination: DataFrame, pair: str = "pair_id") -> DataFrame:
    """(pair, output): the destination's blocks, then the template's without a match of either phase."""
    return merge_tagged(tagged(*(df.select(pair, "index", "normalized", "total") for df in (template, destination))), pair)


def merge_tagged(blocks: DataFrame, pair: str = "pair_id") -> DataFrame:
    """merge_text for both sides in one table (pair, side, index, normalized, total)."""

    def joined(rows: list[dict], matches: list[dict]) -> str:
        used = {m["template_index"] for m in matches if m["phase"] is not None}
        kept = [(0, r["destination_index"], r["normalized"]) for r in rows if r["destination_index"] is not None]
        kept += [(1, r["template_index"], r["normalized"]) for r in rows if r["template_index"] is not None and r["template_index"] not in used]
        return "\n\n".join(text for _, _, text in sorted(kept, key=lambda k: k[:2]) if text is not None)

    return _by_pair(blocks, pair, joined, "string").withColumnRenamed("out", "output")
