"""Mixing sources to target weights by entropy balancing.

Among all document rates r, balancing takes those nearest to 1 (least sum of t (r log r - r + 1) over
documents of t tokens) under constraints on tokens: each source's tokens after mixing are its target
share of the total (exactly), and the mean log length over tokens stays as it was (softly, by a
quadratic penalty on its multiplier, so that there is a solution where lengths can't be met), so that
mixing sources doesn't change how long texts are. The solution is exponentially tilted, r = exp(a[source] + b z), z being the
centred log length; a and b minimise the convex dual and are found by damped Newton iterations, each a
distributed sum of the dual's value, gradient and curvature. The rates are rounded to whole copies by a
hash of the document, so that the expected tokens are kept and the copies don't depend on partitions.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.llm import shared

#: Without targets, a source's share is its tokens to this power, normalised.
FLATTEN = 0.5
ITERATIONS, TOLERANCE = 50, 1e-9
#: Penalty on b: half of this times b^2 a token.
PENALTY = 0.1


def words(text: Column) -> Column:
    """Tokens of a text as mixing counts them: its words between white space."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\t\n\x0B\f\r ]+")), F.lit(0)).cast("long")


def _z(tokens: Column, centre: float) -> Column:
    return F.log1p(tokens.cast("double")) - F.lit(centre)


@dataclass(frozen=True)
class Mix:
    """The dual's solution: (source, a) as a kept table with its number of rows, b, and the centre of z."""

    sources: DataFrame
    n_sources: int
    b: float
    centre: float


def balance(histogram: DataFrame, targets: dict[str, float] | None = None, flatten: float = FLATTEN) -> Mix:
    """Solves the dual for histogram (source, tokens, n): documents by source and length, which is
    all that the rates depend on.

    The table of a stays distributed: with the source's sums A = sum t r, B = sum t r z, C = sum t r z^2, a
    Newton step eliminates a (the Hessian is an arrow), so only sums over sources reach the driver.
    """
    h = shared.cut(histogram.filter("tokens > 0"))
    mass = F.col("n") * F.col("tokens")
    by = h.groupBy("source").agg(F.sum(mass).cast("double").alias("have"), F.sum(mass * F.log1p("tokens")).alias("log"))
    if targets is None:
        by = by.withColumn("weight", F.pow("have", F.lit(flatten)))
    else:
        given = h.sparkSession.createDataFrame([(str(k), float(v)) for k, v in targets.items()] or [("", 0.0)], "source string, weight double")
        by = by.join(F.broadcast(given), "source", "left")
    state = shared.cut(by.select("source", "have", "log", F.coalesce("weight", F.lit(0.0)).alias("weight")))
    whole = state.agg(F.sum("have").alias("total"), F.sum(F.when(F.col("weight") > 0, F.col("have"))).alias("have"), F.sum(F.when(F.col("weight") > 0, F.col("log"))).alias("log"), F.sum("weight").alias("weight")).first()
    state = state.filter("weight > 0")
    total, centre, b = float(whole.total or 0), float(whole.log or 0) / float(whole.have or 1), 0.0
    if not whole.weight:
        return Mix(shared.cut(state.select("source", F.lit(0.0).alias("a"))), 0, b, centre)
    state = shared.cut(state.select("source", (F.col("weight") / whole.weight * total).alias("want")))
    count = state.count()
    z = _z(F.col("tokens"), centre)
    h = shared.cut(h.join(shared.small(state.select("source"), count), "source").groupBy("source", "tokens").agg(F.sum("n").alias("n")))

    def sums(b: float) -> DataFrame:
        """The source's sums of t r, t r z and t r z^2 at a = 0; a only scales them."""
        r = mass * F.exp(F.lit(b) * z)
        return h.groupBy("source").agg(F.sum(r).alias("s0"), F.sum(r * z).alias("s1"), F.sum(r * z * z).alias("s2"))

    # The sources' mixed tokens sum to the total whatever b is once a is at its best for it: Newton
    # on b with a eliminated, a = log(want / A). The dual's slope there is sum of want B / A.
    for _ in range(ITERATIONS):
        x = sums(b).join(shared.small(state, count), "source")
        s = x.agg(F.sum(F.col("want") * F.log("s0")).alias("value"), F.sum(F.col("want") * F.col("s1") / F.col("s0")).alias("slope"), F.sum(F.col("want") * (F.col("s2") / F.col("s0") - F.pow(F.col("s1") / F.col("s0"), F.lit(2)))).alias("bend")).first()
        value, slope, bend = s.value + PENALTY / 2 * b * b * total, s.slope + PENALTY * b * total, s.bend + PENALTY * total
        if abs(slope) <= TOLERANCE * total:
            break
        step = -slope / bend
        step = math.copysign(min(abs(step), 1.0), step)
        for _ in range(30):  # damping: the dual must fall
            new = sums(b + step).join(shared.small(state, count), "source").agg(F.sum(F.col("want") * F.log("s0")).alias("value")).first().value
            if new + PENALTY / 2 * (b + step) ** 2 * total <= value + 1e-12 * abs(value):
                break
            step /= 2
        b += step
    solved = sums(b).join(shared.small(state, count), "source").select("source", F.log(F.col("want") / F.col("s0")).alias("a"))
    return Mix(shared.cut(solved), count, b, centre)


def _source(source_col: str) -> Column:
    """A null source is a source of its own."""
    return F.coalesce(F.concat(F.lit("s"), shared.named(source_col).cast("string")), F.lit("null"))


def _rated(docs: DataFrame, targets: dict[str, float] | None, flatten: float, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """(row, tokens, rate, copies) of every row of docs."""
    facts = docs.select(_source(source_col).alias("source"), words(shared.named(text_col)).alias("tokens"))
    keyed = None if targets is None else {"s" + k if k is not None else "null": v for k, v in targets.items()}
    mix = balance(facts.groupBy("source", "tokens").agg(F.count("*").alias("n")), keyed, flatten)
    rows = docs.select(shared.row(docs).alias("row"), _source(source_col).alias("source"), words(shared.named(text_col)).alias("tokens"))
    rows = rows.join(shared.small(mix.sources, mix.n_sources), "source", "left")
    rate = F.when(F.col("tokens") == 0, F.lit(0.0)).otherwise(F.coalesce(F.exp(F.col("a") + F.lit(mix.b) * _z(F.col("tokens"), mix.centre)), F.lit(0.0)))
    dice = F.pmod(F.xxhash64(F.col("row")[id_col], F.col("row")[text_col], F.lit("mix")), F.lit(1 << 40)) / F.lit(float(1 << 40))
    rated = rows.select("row", "tokens", rate.alias("rate"))
    return rated.select("row", "tokens", "rate", (F.floor("rate") + (dice < F.col("rate") - F.floor("rate")).cast("int")).cast("int").alias("copies"))


def mix_rates(docs: DataFrame, targets: dict[str, float] | None = None, flatten: float = FLATTEN, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(id, source, n_tokens, rate, copies) of every row of docs.

    targets: weight by source (None as a key: rows whose source is null); a source that isn't named, or
    of weight 0, gets no copies, and a named one without documents is left out of the shares. Without
    targets, shares are the sources' tokens to the power `flatten`. A null, empty or blank text has no
    tokens and no copies. Rows with equal id and text get equal copies; ties in nothing else matter. An
    empty table gives no rows. Other columns don't matter, whatever their names.
    """
    rated = _rated(docs, targets, flatten, id_col, text_col, source_col)
    return rated.select(F.col("row")[id_col].alias(id_col), F.col("row")[source_col].alias(source_col), F.col("tokens").alias("n_tokens"), "rate", "copies")


def mix_documents(docs: DataFrame, targets: dict[str, float] | None = None, flatten: float = FLATTEN, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """docs, all columns, each row as often as mix_rates says."""
    rated = _rated(docs, targets, flatten, id_col, text_col, source_col).filter("copies > 0")
    many = rated.select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    return many.select(*shared.fields(docs))
