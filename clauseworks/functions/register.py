"""The engine's scalar functions for use in SQL."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql.functions import pandas_udf

from .embedding import HashEmbedder
from .text import CLAUSE_LINE, normalize


def register(spark: SparkSession, dim: int = 64) -> list[str]:
    """Registers normalize_text, is_clause_start, snippet, dot and hash_embed for a session; gives their names.

    What Spark can say itself becomes a SQL function, which the optimiser sees
    through; the two others run in Python, on Arrow batches.
    """
    embedder = HashEmbedder(dim)

    def normalized(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else normalize(t).text)

    def embedded(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else embedder.embed([t])[0])

    spark.udf.register("normalize_text", pandas_udf(normalized, "string"))
    spark.udf.register("hash_embed", pandas_udf(embedded, "array<float>"))
    pattern = CLAUSE_LINE.replace("\\", "\\\\")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION is_clause_start(line STRING) RETURNS BOOLEAN RETURN rlike(line, '{pattern}')")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION dot(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE RETURN aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x)")
    flat = "trim(regexp_replace(t, '(?U)\\\\s+', ' '))"
    cut = f"regexp_extract({flat}, concat('^(.{{1,', most, '}}) '), 1)"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION snippet(t STRING, most INT) RETURNS STRING RETURN CASE WHEN length({flat}) <= most THEN {flat} ELSE concat(coalesce(nullif({cut}, ''), substring({flat}, 1, most)), '\u2026') END")
    return ["normalize_text", "hash_embed", "is_clause_start", "dot", "snippet"]
