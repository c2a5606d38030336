"""Native column functions over plain text: normalisation, block analysis and similarity.

Everything here is a Catalyst expression, so scans keep their column pruning and the work stays in
the JVM. Null text gives null; empty text normalises to '' and has no blocks.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as the matching rules see it: the ASCII kinds, vertical tab included.
WS = r"[\t\n\x0B\f\r ]"


def blocks(source: Column) -> Column:
    """The paragraphs of a text, each with its white space collapsed; empty ones are dropped."""
    unix = F.regexp_replace(source, r"\r\n?", "\n")
    parts = F.split(unix, rf"\n{WS}*\n")
    squeezed = F.transform(parts, lambda b: F.regexp_replace(F.regexp_replace(b, rf"{WS}+", " "), r"^ | $", ""))
    return F.filter(squeezed, lambda b: b != "")


def normalize_text(source: Column) -> Column:
    """Paragraphs joined by one blank line."""
    return F.array_join(blocks(source), "\n\n")


def block_spans(parts: Column) -> Column:
    """Blocks with 0-based index and character span in the normalised text (a gap of two between blocks)."""
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<index:int,normalized:string,start:int,end:int>>").alias("out"))

    def step(acc: Column, b: Column) -> Column:
        start = acc["at"]
        end = start + F.length(b)
        one = F.struct(F.size(acc["out"]).alias("index"), b.alias("normalized"), start.alias("start"), end.alias("end"))
        return F.struct((end + 2).alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

    return F.aggregate(parts, zero, step, lambda acc: acc["out"])


def words(block: Column) -> Column:
    """The distinct words of a normalised block, as they stand."""
    return F.array_distinct(F.filter(F.split(block, rf"{WS}+"), lambda w: w != ""))


def jaccard(left: Column, right: Column) -> Column:
    """Jaccard of two arrays of distinct tokens; two empty sets are equal (1.0)."""
    both = F.size(F.array_intersect(left, right))
    return F.when(F.size(left) + F.size(right) == 0, F.lit(1.0)).otherwise(both / (F.size(left) + F.size(right) - both))
