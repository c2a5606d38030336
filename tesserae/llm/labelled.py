"""The bounded sample of labelled rows on which the classifiers are fitted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm import shared

#: Most labelled rows that a classifier is fitted on. Fitting only; every document is scored.
MAX_LABELLED = 20_000


def sample(docs: DataFrame, labels: DataFrame, label: str, most: int = MAX_LABELLED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, order, label, text) of at most `most` labelled documents, chosen by a hash of the id.

    Null ids, null labels and null texts are left out; of contradicting labels the larger counts.
    The chosen ids (at most `most` rows of 20 bytes, whatever the input's size) are broadcast, so the
    documents aren't shuffled.
    """
    known = labels.select(shared.named(id_col).alias("id"), shared.named(label).cast("int").alias("label")).dropna()
    chosen = known.groupBy("id").agg(F.max("label").alias("label")).withColumn("order", F.xxhash64("id")).orderBy("order", "id").limit(most)
    texts = docs.select(shared.named(id_col).alias("id"), shared.named(text_col).alias("text")).dropna()
    return texts.join(F.broadcast(chosen), "id").select("id", "order", "label", "text")
