"""Query of ranked lexical search and its SQL counterpart."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from premiumscope.llm.ball_search import lexical_search
from premiumscope.llm.registry import query, table

_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
SQL = f"""
WITH texts AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS words FROM documents),
sizes AS (SELECT r, doc_id, CAST(len(words) AS BIGINT) AS n FROM texts WHERE len(words) > 0),
totals AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM sizes),
asked AS (SELECT item_id, term, count(*) AS times
          FROM (SELECT item_id, unnest({_TERMS}) AS term FROM (SELECT DISTINCT item_id, text FROM benchmark)) GROUP BY ALL),
held AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(words) AS term FROM texts)
         WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
weights AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w
            FROM held, totals GROUP BY term),
impacts AS (SELECT r, doc_id, term, (1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // terms)) AS x
            FROM held JOIN sizes USING (r), totals),
scores AS (SELECT item_id, r, doc_id, CAST(sum(w * x * times) AS BIGINT) AS score
           FROM asked JOIN weights USING (term) JOIN impacts USING (term) GROUP BY ALL)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0)
WHERE rank <= 10
"""


@query("op12_lexical_search", SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lexical_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
