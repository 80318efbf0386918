"""Input views of the check queries, over the test tables.

Each is written once, in SQL that Spark and DuckDB read alike. ``{name}`` is a view of this module
or a table. Stars, votes and scores are arithmetic on ids: test data, not ratings.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    # Reviews without the label join, for views that do not need it.
    "review_text": """
        SELECT CAST(doc_id AS STRING) AS id, concat('P', CAST(doc_id % 50 + 1 AS STRING)) AS asin,
               CASE WHEN doc_id % 29 = 0 THEN NULL WHEN doc_id % 31 = 0 THEN '   ' ELSE text END AS body,
               CASE WHEN doc_id % 41 = 0 THEN NULL ELSE CAST((doc_id * 7 + n_chars) % 5 + 1 AS INT) END AS stars,
               CASE WHEN doc_id % 3 = 0 THEN NULL ELSE CAST(n_chars % 13 AS STRING) END AS found_helpful,
               doc_id, source
        FROM {documents}""",
    "reviews": """
        SELECT r.id, r.asin, r.body, r.stars,
               CASE l.quality WHEN 1 THEN 'TRUE' WHEN 0 THEN 'FALSE' END AS verified_purchase, r.found_helpful
        FROM {review_text} r LEFT JOIN {labels} l ON r.doc_id = l.doc_id""",
    "products": """
        SELECT concat('P', CAST(p_partkey AS STRING)) AS asin, p_name AS title, p_brand AS brand,
               p_retailprice AS price
        FROM {part}""",
    # As if a past run had enriched everything.
    "enriched": """
        SELECT id, asin, body, stars,
               CASE WHEN doc_id % 17 = 0 THEN NULL ELSE CAST((doc_id * 37) % 201 - 100 AS DOUBLE) / 100 END AS sentiment,
               CASE doc_id % 4 WHEN 0 THEN 'FULLY_ENRICHED' WHEN 1 THEN 'FAILED' ELSE 'FAST_ONLY' END AS enrichment_status,
               CASE WHEN doc_id % 4 = 0 THEN concat('Price, quality ,,topic', CAST(doc_id % 12 AS STRING)) END AS keywords_csv
        FROM {review_text}""",
    # As if a past run had seen some of the sources.
    "known_reviews": """
        SELECT id FROM {review_text} WHERE source < 'src15'""",
    "merge_target": """
        SELECT id, asin, body, stars, found_helpful FROM {review_text} WHERE source < 'src15'""",
    # All reviews, some of them with new votes, and every five-star review once more.
    "merge_batch": """
        SELECT id, asin, body, stars, CASE WHEN stars = 2 THEN '99' ELSE found_helpful END AS found_helpful
        FROM {review_text}
        UNION ALL
        SELECT id, asin, body, stars, found_helpful FROM {review_text} WHERE stars = 5""",
    "dirty_reviews": """
        SELECT CAST(doc_id AS STRING) AS id,
               CASE doc_id % 7 WHEN 0 THEN ' nan ' WHEN 1 THEN 'NA' WHEN 2 THEN 'Null' WHEN 3 THEN concat(chr(9), ' ')
                    WHEN 4 THEN '' WHEN 5 THEN lang ELSE text END AS note,
               CASE WHEN doc_id % 11 = 0 THEN CAST('NaN' AS DOUBLE) ELSE CAST(n_chars AS DOUBLE) END AS score, n_chars
        FROM {documents}""",
    "object_names": """
        SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN concat('vw_', p_name) WHEN 1 THEN concat('Tb_vw_', p_name)
               ELSE p_name END AS object_name
        FROM {part}""",
    # Rows with null and repeated ids, told apart by n.
    "odd_reviews": """
        SELECT doc_id AS n, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE CAST(doc_id % 50 AS STRING) END AS id, text AS body
        FROM {documents}""",
    # A word of each benchmark text with a weight of its own, some words several times.
    "graded_words": """
        SELECT lower(split_part(text, ' ', 2)) AS word, CAST(item_id % 37 - 17 AS DOUBLE) / 16 AS weight FROM {benchmark}""",
    # What the keyword tier gave, for reviews of all states, and for some a second time.
    "outcomes": """
        SELECT id, CASE WHEN doc_id % 7 <> 0 THEN concat('Delivery , size,, topic', CAST(doc_id % 9 AS STRING)) END AS answer,
               CASE WHEN doc_id % 7 = 0 THEN 3 ELSE CAST(doc_id % 3 + 1 AS INT) END AS attempts,
               CASE WHEN doc_id % 7 = 0 THEN repeat(concat('timeout ', id, ' '), 200) END AS error,
               CAST('2024-01-31 00:00:00' AS TIMESTAMP) AS finished_at
        FROM {review_text}
        UNION ALL
        SELECT id, CASE WHEN doc_id % 2 = 0 THEN 'Late, answer' END AS answer, 2 AS attempts,
               CASE WHEN doc_id % 2 = 1 THEN 'late' END AS error, CAST('2024-02-01 00:00:00' AS TIMESTAMP) AS finished_at
        FROM {review_text} WHERE doc_id % 3 = 0""",
    # No unique id: for aggregates only.
    "scored_facts": """
        SELECT concat('P', CAST(l_partkey AS STRING)) AS asin, CAST(l_linenumber % 5 + 1 AS INT) AS stars,
               1 - l_quantity / 25 AS sentiment,
               CASE l_returnflag WHEN 'A' THEN 'FULLY_ENRICHED' ELSE 'FAST_ONLY' END AS enrichment_status,
               l_shipdate AS created_at
        FROM {lineitem}""",
    "pipeline_logs": """
        SELECT event_id, ts AS log_timestamp,
               CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'signup' THEN 'WARN' ELSE 'INFO' END AS level,
               concat(CASE event_type WHEN 'view' THEN 'Migration stage ' WHEN 'click' THEN 'seed stage '
                      WHEN 'purchase' THEN 'cortex keyword ' WHEN 'signup' THEN 'app deploy ' ELSE 'other ' END,
                      CAST(event_id AS STRING)) AS message
        FROM {events}""",
    "event_records": """
        SELECT event_id, ts AS timestamp, concat('{{"severity_text": "', upper(event_type), '", "n": 1}}') AS record,
               concat('event ', CAST(event_id AS STRING)) AS value
        FROM {events}""",
    "metering": """
        SELECT ts AS start_time, value AS credits_used, event_type AS service_type,
               concat('WH_', upper(event_type)) AS warehouse_name, event_type AS function_name
        FROM {events}""",
    "storage": """
        SELECT CAST(ts AS DATE) AS usage_date, value * 1073741824 AS average_database_bytes,
               concat('DB_', upper(event_type), '_PRO') AS database_name
        FROM {events}""",
    "query_history": """
        SELECT ts AS start_time,
               CASE event_type WHEN 'view' THEN 'select snowflake.cortex.complete(x)' WHEN 'click' THEN 'SELECT SNOWFLAKE.CORTEX.SENTIMENT(y)'
                    WHEN 'purchase' THEN 'select Snowflake.Cortex.Translate(z)' ELSE 'select 1' END AS query_text,
               CASE WHEN event_id % 10 = 3 THEN '604' END AS error_code
        FROM {events}""",
    "snapshots": """
        SELECT CAST(ts AS DATE) AS snapshot_date, CAST(count(*) AS DOUBLE) AS wh_credits, max(value) AS ai_credits,
               CAST(NULL AS DOUBLE) AS storage_gb, CASE WHEN 1 = 0 THEN max(ts) END AS created_at
        FROM {events} GROUP BY CAST(ts AS DATE)""",
    "task_history": """
        SELECT event_id, concat('TASK_', CAST(user_id AS STRING)) AS task_name, event_type AS state,
               CASE WHEN event_type = 'error' THEN NULL ELSE ts END AS completed_time
        FROM {events}""",
    "tasks": """
        SELECT concat('TASK_', CAST(c_custkey AS STRING)) AS name,
               CASE WHEN c_acctbal < 0 THEN 'suspended' ELSE 'started' END AS state, lower(c_mktsegment) AS schedule
        FROM {customer}""",
}

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
    "embeddings", "pages", "benchmark", "labels", "conversations",
)

_NAME = re.compile(r"(?<!\{)\{(\w+)\}")


def _names(sql: str) -> list[str]:
    return list(dict.fromkeys(_NAME.findall(sql)))


def _needed(sql: str, done: dict[str, str]) -> dict[str, str]:
    for name in _names(sql):
        if name in VIEWS and name not in done:
            _needed(VIEWS[name], done)
            done[name] = VIEWS[name]
    return done


def with_views(sql: str) -> str:
    """``sql`` headed by the views it needs; tables stay placeholders."""
    views = _needed(sql, {})
    head = ",\n".join(f"{name} AS ({text})" for name, text in views.items())
    body = sql.strip()
    if views:
        body = f"WITH {head},\n{body[4:]}" if body.startswith("WITH") else f"WITH {head}\n{body}"
    return _NAME.sub(lambda m: m[1] if m[1] in VIEWS else m[0], body)


def duckdb_sql(sql: str) -> str:
    return with_views(sql).format(**{t: t for t in TABLES})


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql = with_views(f"SELECT * FROM {{{name}}}")
    return spark.sql(sql, **{t: table(spark, sf_dir, t) for t in _names(sql)})
