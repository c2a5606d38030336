"""Every query over the test tables, with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tesserae.plans import review_queries, shape_queries, structured_queries, template_queries, text_queries

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

for module in (text_queries, structured_queries, shape_queries, template_queries, review_queries):
    QUERIES.update(module.QUERIES)
    ORACLES.update(module.ORACLES)
