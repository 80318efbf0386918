"""The SQL twin of each query, for DuckDB."""

from __future__ import annotations

from checks.fixtures import duckdb_sql
from checks.queries import AS_OF, NEGATIVE, POSITIVE
from opinionmill.functions.text import KEYWORD_INSTRUCTION, WHITESPACE

NOW = f"TIMESTAMP '{AS_OF}'"


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


WS = _text(WHITESPACE)
INSTRUCTION = _text(KEYWORD_INSTRUCTION)


def rounded(x: str, digits: int) -> str:
    return f"CAST(round(CAST({x} AS DECIMAL(38,9)), {digits}) AS DOUBLE)"


def share(condition: str) -> str:
    return rounded(f"100.0 * CAST(count(*) FILTER ({condition}) AS DOUBLE) / CAST(nullif(count(*), 0) AS DOUBLE)", 1)


def number(x: str) -> str:
    return f"CAST(round(TRY_CAST({x} AS DECIMAL(38,6))) AS BIGINT)"


def row_hash(*columns: str) -> str:
    parts = [
        f"coalesce(CAST(length(CAST({c} AS VARCHAR)) AS VARCHAR) || ':' || CAST({c} AS VARCHAR), '-')" for c in columns
    ]
    return f"md5({' || '.join(parts)})"


def words(csv: str) -> str:
    return (
        f"array_to_string(list_filter(list_transform(string_split({csv}, ','), lambda x: trim(x, {WS})), "
        "lambda x: x <> ''), '|')"
    )


def non_blank(c: str) -> str:
    return f"{c} IS NOT NULL AND trim({c}) <> ''"


def window(time: str, days: int = 30) -> str:
    return f"{time} BETWEEN {NOW} - INTERVAL {days} DAY AND {NOW}"


# Joined to one row per review with a text: its words, counted.
SCORES = f"""
    lexicon AS (SELECT unnest([{', '.join(map(_text, NEGATIVE))}]) AS word, -1 AS weight
                UNION ALL SELECT unnest([{', '.join(map(_text, POSITIVE))}]), 1),
    bag AS (SELECT id, unnest(regexp_split_to_array(lower(body), '[^a-z]+')) AS word FROM scored_input),
    scores AS (SELECT id, (sum(weight) / sum(abs(weight))) AS score FROM bag JOIN lexicon USING (word) GROUP BY id)"""


def scored(source: str, select: str) -> str:
    return (
        f"WITH scored_input AS ({source}), {SCORES} SELECT {select}, coalesce(CAST(s.score AS DOUBLE), 0.0) AS sentiment "
        "FROM scored_input r LEFT JOIN scores s ON r.id = s.id"
    )


GRADED = """
    WITH weights AS (SELECT word, CAST(sum(CAST(weight AS DECIMAL(28, 9))) AS DOUBLE) AS weight FROM {graded_words} GROUP BY word),
    bag AS (SELECT n, unnest(regexp_split_to_array(lower(body), '[^a-z]+')) AS word FROM {odd_reviews}),
    scores AS (SELECT n, sum(CASE WHEN weight > 0 THEN weight ELSE 0 END) AS up,
                      sum(CASE WHEN weight < 0 THEN -weight ELSE 0 END) AS down
               FROM bag JOIN weights USING (word) WHERE word <> '' GROUP BY n)
    SELECT r.n, r.id, coalesce((up - down) / nullif(up + down, 0), 0.0) AS sentiment
    FROM {odd_reviews} r LEFT JOIN scores s ON r.n = s.n"""


def reviews_questions(source: str) -> dict[str, str]:
    ranking = f"""
        SELECT asin, {rounded('avg(stars)', 1)} AS avg_stars, {rounded('avg(sentiment)', 3)} AS avg_sentiment,
               count(*) AS review_count
        FROM {source} WHERE sentiment IS NOT NULL AND asin IS NOT NULL GROUP BY asin HAVING count(*) >= 3"""

    def ranked(direction: str) -> str:
        return f"""
            SELECT *, row_number() OVER (ORDER BY avg_sentiment {direction}, asin) AS place FROM ({ranking})
            ORDER BY place LIMIT 5"""

    summary = f"""
        SELECT count(*) AS total, count(*) FILTER (stars IN (1, 2)) AS detractors,
               count(*) FILTER (stars IN (3, 4)) AS passives, count(*) FILTER (stars = 5) AS promoters
        FROM {source} WHERE stars IS NOT NULL"""
    return {
        "kpis": f"""
            SELECT count(*) AS total, {rounded('avg(sentiment)', 3)} AS avg_sentiment,
                   {share("enrichment_status = 'FULLY_ENRICHED'")} AS pct_fully_enriched,
                   {share('sentiment < 0')} AS pct_negative
            FROM {source} WHERE sentiment IS NOT NULL""",
        "stars_distribution": f"SELECT stars, count(*) AS count FROM {source} WHERE stars IS NOT NULL GROUP BY stars",
        "sentiment_by_stars": f"""
            SELECT stars, {rounded('avg(sentiment)', 3)} AS avg_sentiment FROM {source}
            WHERE stars IS NOT NULL AND sentiment IS NOT NULL GROUP BY stars""",
        "nps_summary": summary,
        "nps_score": f"""
            SELECT *, CASE WHEN nps >= 50 THEN 'Excellent' WHEN nps >= 30 THEN 'Good' WHEN nps >= 0
                      THEN 'Needs improvement' ELSE 'Critical' END AS band
            FROM (SELECT *, CAST(round_even(pct_promoters - pct_detractors, 0) AS BIGINT) AS nps
                  FROM (SELECT *,
                               CAST(printf('%.1f', CAST(promoters AS DOUBLE) / CAST(total AS DOUBLE) * 100) AS DOUBLE) AS pct_promoters,
                               CAST(printf('%.1f', CAST(detractors AS DOUBLE) / CAST(total AS DOUBLE) * 100) AS DOUBLE) AS pct_detractors
                        FROM ({summary})))""",
        "status_breakdown": f"""
            SELECT stars, enrichment_status, count(*) AS count FROM {source} GROUP BY stars, enrichment_status""",
        "best_products": ranked("DESC"),
        "worst_products": ranked("ASC"),
        "stars_sentiment_breakdown": f"""
            SELECT stars, {share('sentiment > 0.1')} AS pct_positive,
                   {share('sentiment BETWEEN -0.1 AND 0.1')} AS pct_neutral, {share('sentiment < -0.1')} AS pct_negative
            FROM {source} WHERE stars IS NOT NULL AND sentiment IS NOT NULL GROUP BY stars""",
    }


MERGE_COLUMNS = ("id", "asin", "body", "stars", "found_helpful")


def merge(key: str, select: str) -> str:
    """Target rows plus, for each key it lacks, the smallest batch row."""
    hashed = f"SELECT *, {row_hash(*MERGE_COLUMNS)} AS row_hash FROM"
    order = ", ".join(f"{c} NULLS FIRST" for c in MERGE_COLUMNS)
    return f"""
        WITH t AS ({hashed} {{merge_target}}), b AS ({hashed} {{merge_batch}}),
        once AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY {order}) = 1)
        SELECT {select} FROM t UNION ALL SELECT {select} FROM once WHERE {key} NOT IN (SELECT {key} FROM t)"""


PENDING = f"""
    SELECT id, stars, body FROM {{enriched}}
    WHERE keywords_csv IS NULL AND enrichment_status NOT IN ('FULLY_ENRICHED', 'FAILED') AND {non_blank('body')}"""

POOL = f"""
    SELECT e.id, e.stars, {number('r.found_helpful')} AS found_helpful
    FROM ({PENDING}) e JOIN {{reviews}} r ON e.id = r.id
    WHERE upper(trim(r.verified_purchase)) = 'TRUE' OR {number('r.found_helpful')} > 5 OR e.stars IN (1, 5)"""

STRATEGIC = f"SELECT * FROM ({POOL}) ORDER BY found_helpful DESC NULLS LAST, stars ASC NULLS LAST, id LIMIT 500"

# What the batch run over the files has to choose from: all reviews with a text.
LOGGED_POOL = f"""
    SELECT id FROM {{reviews}} WHERE {non_blank('body')}
    AND (upper(trim(verified_purchase)) = 'TRUE' OR {number('found_helpful')} > 5 OR stars IN (1, 5))"""

LATEST = """
    SELECT * FROM {task_history}
    QUALIFY row_number() OVER (PARTITION BY task_name ORDER BY completed_time DESC NULLS LAST, event_id DESC) = 1"""

SNAPSHOT = f"""
    SELECT CAST({NOW} AS DATE) AS snapshot_date,
           coalesce((SELECT {rounded('sum(credits_used)', 4)} FROM {{metering}}
                     WHERE {window('start_time')} AND warehouse_name = 'WH_CLICK'), 0.0) AS wh_credits,
           coalesce((SELECT {rounded('sum(credits_used)', 4)} FROM {{metering}}
                     WHERE {window('start_time')} AND service_type = 'signup'), 0.0) AS ai_credits,
           coalesce((SELECT {rounded('sum(average_database_bytes) / power(1024, 3)', 4)} FROM {{storage}}
                     WHERE {window('usage_date')} AND database_name ILIKE '%view%'), 0.0) AS storage_gb"""

# Of several outcomes a success counts, then the earliest.
FINAL = """
    SELECT * FROM {outcomes} QUALIFY row_number() OVER (
        PARTITION BY id ORDER BY answer IS NULL, finished_at NULLS LAST, attempts, error NULLS FIRST) = 1"""
OUTCOME_COLUMNS = f"""
    CASE WHEN o.id IS NULL THEN e.enrichment_status WHEN o.answer IS NULL THEN 'FAILED' ELSE 'FULLY_ENRICHED' END AS enrichment_status,
    CASE WHEN o.answer IS NULL THEN {words('e.keywords_csv')} ELSE {words('o.answer')} END AS keywords,
    CAST(CASE WHEN o.id IS NULL THEN 0 WHEN o.answer IS NULL THEN 3 ELSE o.attempts - 1 END AS INTEGER) AS retry_count,
    CASE WHEN o.answer IS NULL THEN left(o.error, 1990) END AS error_message,
    CASE WHEN o.answer IS NULL THEN o.finished_at END AS failed_at"""

PROMPT = f"({INSTRUCTION} || body)"


def check_rows(source: str, rules: list[tuple[str, str, str, str]]) -> str:
    """``rules``: name, observed, threshold, condition on ``observed``."""
    return " UNION ALL ".join(
        f"SELECT '{name}' AS rule, observed, '{threshold}' AS threshold, {passed} AS passed "
        f"FROM (SELECT CAST({observed} AS DOUBLE) AS observed FROM {source})"
        for name, observed, threshold, passed in rules
    )


def nulls(c: str) -> str:
    return f"count(*) FILTER ({c} IS NULL)"


def copies(c: str) -> str:
    return f"count({c}) - count(DISTINCT {c})"


ZERO = ("= 0", "observed = 0")

_SQL = {
    "clean_nulls": f"""
        SELECT id, CASE WHEN upper(trim(note, {WS})) NOT IN ('NAN', 'NA', 'NULL', '') THEN note END AS note,
               CASE WHEN NOT isnan(score) THEN score END AS score, n_chars
        FROM {{dirty_reviews}}""",
    "row_hash": f"""
        SELECT id, {row_hash('id', 'asin', 'body', 'stars', 'verified_purchase', 'found_helpful')} AS row_hash
        FROM {{reviews}}""",
    "raw_projection": f"""
        SELECT id, asin, body, CAST(stars AS VARCHAR) AS stars, verified_purchase, found_helpful,
               {row_hash('id', 'asin', 'body', 'stars', 'verified_purchase', 'found_helpful')} AS row_hash
        FROM {{reviews}}""",
    "typed_reviews": f"""
        SELECT id, asin, body, CAST(stars AS BIGINT) AS stars, upper(trim(verified_purchase)) = 'TRUE' AS verified_purchase,
               {number('found_helpful')} AS found_helpful
        FROM {{reviews}}""",
    "view_name": "SELECT p_partkey, 'VW_' || regexp_replace(upper(object_name), '^VW_', '') AS view_name FROM {object_names}",
    "add_missing_columns": """
        SELECT id, stars, CAST(0 AS INTEGER) AS retry_count, CAST(NULL AS VARCHAR) AS error_message FROM {reviews}""",
    "csv_to_array": f"""
        SELECT id, asin, body, stars, sentiment, enrichment_status, {words('keywords_csv')} AS keywords FROM {{enriched}}""",
    "parse_keywords": f"SELECT id, {words('keywords_csv')} AS keywords FROM {{enriched}}",
    "merge_on_hash": merge("row_hash", "id, asin, body, CAST(stars AS VARCHAR) AS stars, found_helpful, row_hash"),
    "merge_on_key": merge("id", "id, asin, body, stars, found_helpful"),
    "enrichable_reviews": f"SELECT id, asin, body FROM {{reviews}} WHERE {non_blank('body')}",
    "keyword_prompt": f"SELECT id, {PROMPT} AS prompt FROM {{reviews}}",
    "unprocessed_reviews": "SELECT id, asin, body FROM {reviews} WHERE id NOT IN (SELECT id FROM {known_reviews})",
    "sentiment_score": scored("SELECT id, body FROM {reviews}", "r.id"),
    "sentiment_score_middle_lexicon": scored("SELECT id, body FROM {reviews}", "r.id"),
    "sentiment_graded": GRADED,
    "sentiment_graded_large": GRADED,
    "sentiment_score_large_lexicon": scored("SELECT id, body FROM {reviews}", "r.id"),
    "enrich_fast": scored(
        f"""SELECT *, {row_hash('id', 'asin', 'body', 'stars', 'verified_purchase', 'found_helpful')} AS row_hash
            FROM {{reviews}} WHERE {non_blank('body')} AND id NOT IN (SELECT id FROM {{known_reviews}})""",
        f"r.id, r.asin, r.body, CAST(r.stars AS BIGINT) AS stars, r.row_hash, 'FAST_ONLY' AS enrichment_status, {NOW} AS created_at",
    ),
    "strategic_pool": POOL,
    "strategic_reviews": f"SELECT s.*, r.body FROM ({STRATEGIC}) s JOIN {{reviews}} r ON s.id = r.id",
    "keywords_tfidf": f"""
        WITH texts AS (SELECT id, body FROM {{reviews}} WHERE {non_blank('body')}),
        bag AS (SELECT id, unnest(regexp_split_to_array(lower(body), '[^a-z]+')) AS word FROM texts),
        tf AS (SELECT id, word, count(*) AS tf FROM bag WHERE word <> '' GROUP BY id, word),
        df AS (SELECT word, count(*) AS df FROM tf GROUP BY word),
        weighed AS (
            SELECT id, word, round(tf * ln(CAST((SELECT count(*) FROM texts) AS DOUBLE) / df), 9) AS weight
            FROM tf JOIN df USING (word)),
        placed AS (
            SELECT id, word, row_number() OVER (PARTITION BY id ORDER BY weight DESC, word) AS place FROM weighed
            QUALIFY place <= 5)
        SELECT t.id, coalesce(string_agg(p.word, '|' ORDER BY p.place), '') AS keywords
        FROM texts t LEFT JOIN placed p ON t.id = p.id GROUP BY t.id""",
    "complete_with_retry": f"""
        SELECT id,
               CASE WHEN length(prompt) % 4 = 3 THEN NULL WHEN length(prompt) % 3 = 0 THEN ''
                    ELSE {words("array_to_string(string_split(body, ' ')[1:3], ', ')")} END AS keywords,
               CAST(CASE WHEN length(prompt) % 4 = 3 THEN 3 ELSE length(prompt) % 4 + 1 END AS INTEGER) AS attempts,
               CASE WHEN length(prompt) % 4 > 0 THEN 'try ' || CAST(length(prompt) % 4 AS VARCHAR) || ' failed' END AS error
        FROM (SELECT id, body, {PROMPT} AS prompt FROM {{reviews}} WHERE {non_blank('body')})""",
    "apply_outcomes": f"""
        SELECT e.id, e.asin, e.body, e.stars, e.sentiment, {OUTCOME_COLUMNS}
        FROM {{enriched}} e LEFT JOIN ({FINAL}) o ON e.id = o.id AND e.enrichment_status = 'FAST_ONLY'""",
    "compacted_store": f"""
        SELECT e.id, e.asin, e.body, CAST(e.stars AS BIGINT) AS stars, e.sentiment, {OUTCOME_COLUMNS}
        FROM (SELECT * REPLACE ('FAST_ONLY' AS enrichment_status, CAST(NULL AS VARCHAR) AS keywords_csv) FROM
              (SELECT id, asin, body, stars, sentiment, enrichment_status, {words('keywords_csv')} AS keywords,
                      keywords_csv FROM {{enriched}})) e
        LEFT JOIN ({FINAL}) o ON e.id = o.id""",
    "run_summary": """
        SELECT count(answer) AS processed, count(*) - count(answer) AS failed,
               count(*) FILTER (answer IS NOT NULL AND attempts > 1) AS retried, count(*) AS total
        FROM {outcomes}""",
    "failure_alert": """
        SELECT 'WARN' AS level, concat('keyword extraction: failed=', count(*) - count(answer), ' of total=', count(*),
                                       ', attempts=3, state=FAILED') AS message
        FROM {outcomes} HAVING count(*) > count(answer)""",
    "update_from_candidates": f"""
        SELECT e.id, coalesce('stars|' || coalesce(CAST(s.stars AS VARCHAR), NULL), {words('e.keywords_csv')}) AS keywords,
               CASE WHEN s.id IS NULL THEN e.enrichment_status ELSE 'FULLY_ENRICHED' END AS enrichment_status
        FROM {{enriched}} e LEFT JOIN ({STRATEGIC}) s ON e.id = s.id""",
    "enrich_stream_incremental": scored(
        f"SELECT CAST(doc_id AS VARCHAR) AS id, source, n_chars, text AS body FROM {{documents}} WHERE source <> 'src15' AND {non_blank('text')}",
        "r.id, r.source AS asin, r.body, CAST(r.n_chars % 5 + 1 AS BIGINT) AS stars, 'FAST_ONLY' AS enrichment_status, "
        "CAST(0 AS INTEGER) AS retry_count",
    ) + """
        UNION ALL BY NAME
        SELECT CAST(doc_id AS VARCHAR) AS id, source AS asin, text AS body, CAST(n_chars % 5 + 1 AS BIGINT) AS stars,
               'FAST_ONLY' AS enrichment_status, CAST(0 AS INTEGER) AS retry_count, 0.5 AS sentiment
        FROM {documents} WHERE source = 'src15'""",
    "csv_load": """
        SELECT id AS ID, asin AS ASIN, body AS BODY, CAST(stars AS VARCHAR) AS STARS,
               verified_purchase AS VERIFIED_PURCHASE, found_helpful AS FOUND_HELPFUL FROM {reviews}""",
    "upper_columns": """
        SELECT id AS ID, asin AS ASIN, body AS BODY, stars AS STARS,
               verified_purchase AS VERIFIED_PURCHASE, found_helpful AS FOUND_HELPFUL FROM {reviews}""",
    "bulk_append": "SELECT * FROM {reviews}",
    "clustered_read": "SELECT * FROM {reviews}",
    "first_available": "SELECT * FROM {products}",
    "mirror_views": """
        SELECT CAST(p_partkey AS BIGINT) AS key, p_name AS value FROM {part}
        UNION ALL SELECT CAST(n_nationkey AS BIGINT), n_name FROM {nation}
        UNION ALL VALUES (-1, 'VW_TB_PART'), (-1, 'VW_TB_NATION')""",
    "run_log": f"""
        WITH n AS (SELECT (SELECT count(*) FROM {{products}}) AS products, (SELECT count(*) FROM {{reviews}}) AS reviews,
                          (SELECT least(500, count(*)) FROM ({LOGGED_POOL})) AS chosen)
        SELECT 'INFO' AS level, unnest([
            'seed load of products started', concat('seed load of products completed added=', products),
            'seed load of reviews started', concat('seed load of reviews completed added=', reviews),
            'migration of products to raw started', concat('migration of products to raw completed added=', products),
            'migration of reviews to raw started', concat('migration of reviews to raw completed added=', reviews),
            'sentiment run one started', 'sentiment run one completed',
            'keyword run one started', concat('keyword run one completed processed=', chosen, ' failed=0 retried=0 total=', chosen),
            'keyword run one started', concat('keyword run one completed processed=', chosen, ' failed=0 retried=0 total=', chosen)
        ]) AS message FROM n""",
    "ingestion_timeline": """
        SELECT date_trunc('hour', created_at) AS hour, count(*) AS count FROM {scored_facts}
        WHERE created_at IS NOT NULL GROUP BY 1""",
    "top_reviews": f"""
        SELECT asin, stars, {rounded('sentiment', 3)} AS sentiment, enrichment_status, left(body, 250) AS body_preview
        FROM (SELECT * FROM {{enriched}} WHERE sentiment IS NOT NULL AND body IS NOT NULL
              ORDER BY abs(sentiment) DESC, id LIMIT 10)""",
    "sentiment_scatter": f"""
        SELECT stars, {rounded('sentiment', 3)} AS sentiment, enrichment_status FROM {{enriched}}
        WHERE sentiment IS NOT NULL AND stars IS NOT NULL""",
    "reviews_filtered": f"""
        SELECT asin, stars, {rounded('sentiment', 3)} AS sentiment, {words('keywords_csv')} AS keywords,
               enrichment_status, left(body, 300) AS body_preview
        FROM (SELECT * FROM {{enriched}} WHERE stars IN (1, 3, 5) AND sentiment BETWEEN -0.9 AND 0.8
              AND asin ILIKE '%p1%' AND enrichment_status = 'FAST_ONLY' ORDER BY abs(sentiment) DESC, id LIMIT 500)""",
    "reviews_unfiltered": f"""
        SELECT asin, stars, {rounded('sentiment', 3)} AS sentiment, {words('keywords_csv')} AS keywords,
               enrichment_status, left(body, 300) AS body_preview
        FROM (SELECT * FROM {{enriched}} WHERE stars BETWEEN 1 AND 5 AND sentiment BETWEEN -1 AND 1
              ORDER BY abs(sentiment) DESC, id LIMIT 500)""",
    "keywords_raw": f"""
        SELECT {words('keywords_csv')} AS keywords FROM {{enriched}}
        WHERE keywords_csv IS NOT NULL AND enrichment_status = 'FULLY_ENRICHED'""",
    "keyword_frequency": f"""
        SELECT keyword, count(*) AS count
        FROM (SELECT lower(trim(unnest(string_split(keywords_csv, ',')), {WS})) AS keyword FROM {{enriched}}
              WHERE enrichment_status = 'FULLY_ENRICHED')
        WHERE keyword <> '' GROUP BY keyword ORDER BY count DESC, keyword LIMIT 10""",
    "enrichment_coverage": """
        SELECT count(*) AS total, count(*) FILTER (enrichment_status = 'FAST_ONLY') AS fast_only,
               count(*) FILTER (enrichment_status = 'FULLY_ENRICHED') AS fully_enriched,
               count(*) FILTER (coalesce(trim(body), '') = '') AS no_body,
               count(*) FILTER (keywords_csv IS NULL) AS no_keywords
        FROM {enriched}""",
    "null_stats": """
        SELECT count(*) FILTER (sentiment IS NULL) AS no_sentiment, count(*) FILTER (keywords_csv IS NULL) AS no_keywords,
               count(*) FILTER (coalesce(trim(body), '') = '') AS no_body
        FROM {enriched}""",
    "event_log_tail": """
        SELECT log_timestamp AS timestamp, level AS severity, message FROM {pipeline_logs}
        ORDER BY log_timestamp DESC, event_id DESC LIMIT 50""",
    "event_record_tail": """
        SELECT timestamp, json_extract_string(record, '$.severity_text') AS severity, value AS message
        FROM {event_records} ORDER BY timestamp DESC, value DESC, record DESC LIMIT 50""",
    "json_field": "SELECT event_id, json_extract_string(props, '$.k') AS k FROM {events}",
    "metering_30d": f"""
        SELECT {rounded('coalesce(sum(credits_used), 0)', 2)} AS credits FROM {{metering}}
        WHERE {window('start_time')} AND service_type = 'purchase'""",
    "metering_10d": f"""
        SELECT {rounded('coalesce(sum(credits_used), 0)', 4)} AS credits FROM {{metering}}
        WHERE {window('start_time', 10)}""",
    "storage_30d": f"""
        SELECT {rounded('coalesce(sum(average_database_bytes), 0) / power(1024, 3)', 2)} AS storage_gb FROM {{storage}}
        WHERE {window('usage_date')} AND database_name ILIKE '%pur%'""",
    "usage_by_function": f"""
        SELECT function_name, count(*) AS call_count, {rounded('sum(credits_used)', 6)} AS credits FROM {{metering}}
        WHERE {window('start_time')} GROUP BY function_name""",
    "call_counts_by_function": f"""
        SELECT CASE WHEN query_text ILIKE '%CORTEX.COMPLETE%' THEN 'COMPLETE'
                    WHEN query_text ILIKE '%CORTEX.SENTIMENT%' THEN 'SENTIMENT' ELSE 'OTHER' END AS function_name,
               count(*) AS call_count, CAST(NULL AS DOUBLE) AS credits
        FROM {{query_history}}
        WHERE {window('start_time')} AND query_text ILIKE '%SNOWFLAKE.CORTEX%' AND error_code IS NULL GROUP BY 1""",
    "latest_snapshot": """
        SELECT snapshot_date, wh_credits, ai_credits, coalesce(storage_gb, 0.0) AS storage_gb FROM {snapshots}
        ORDER BY snapshot_date DESC LIMIT 1""",
    "cost_snapshot": f"SELECT *, {NOW} AS created_at FROM ({SNAPSHOT})",
    "snapshot_append": f"SELECT *, {NOW} AS created_at FROM ({SNAPSHOT})",
    "latest_per_key": LATEST,
    "task_status": f"""
        SELECT t.name, upper(t.state) AS enabled, t.schedule,
               coalesce(strftime(r.completed_time, '%Y-%m-%d %H:%M UTC'), '—') AS last_run,
               coalesce(r.state, '—') AS last_result
        FROM {{tasks}} t LEFT JOIN (
            SELECT * FROM {{task_history}} WHERE completed_time IS NULL OR {window('completed_time', 7)}
            QUALIFY row_number() OVER (PARTITION BY task_name ORDER BY completed_time DESC NULLS LAST, event_id DESC) = 1
        ) r ON t.name = r.task_name""",
    "quality_reviews": check_rows("{reviews}", [
        ("required_columns", "any_value(0)", *ZERO),
        ("unique_names", "any_value(0)", *ZERO),
        ("has_rows", "count(*)", ">= 1", "observed >= 1"),
        ("row_count", "count(*)", "4990..5000", "observed BETWEEN 4990 AND 5000"),
        ("id_not_null", nulls("id"), *ZERO),
        ("asin_not_null", nulls("asin"), *ZERO),
        ("stars_in_range", "count(*) FILTER (stars NOT IN (1, 2, 3, 4, 5))", *ZERO),
        ("stars_all_values", "count(DISTINCT stars) FILTER (stars BETWEEN 1 AND 5)", "= 5", "observed = 5"),
        ("id_unique", copies("id"), *ZERO),
        ("body_filled", f"avg(CASE WHEN trim(body, {WS}) <> '' THEN 1.0 ELSE 0.0 END)", ">= 0.8", "observed >= 0.8"),
    ]),
    "quality_products": check_rows("{products}", [
        ("required_columns", "any_value(0)", *ZERO),
        ("unique_names", "any_value(0)", *ZERO),
        ("has_rows", "count(*)", ">= 1", "observed >= 1"),
        ("asin_not_null", nulls("asin"), *ZERO),
        ("asin_unique", copies("asin"), *ZERO),
        ("no_empty_rows", "count(*) FILTER (asin IS NULL AND title IS NULL AND brand IS NULL AND price IS NULL)", *ZERO),
    ]),
    "stratified_sample": """
        SELECT id, stars, body FROM {reviews} WHERE id IS NOT NULL AND stars IS NOT NULL
        QUALIFY row_number() OVER (PARTITION BY stars ORDER BY md5(id), id) <= 50""",
}

for _products in ("reviews_with_products", "reviews_with_products_large"):
    _SQL[_products] = """
        SELECT r.id, r.asin, r.body, r.stars, r.verified_purchase, r.found_helpful, p.title, p.brand, p.price
        FROM {reviews} r LEFT JOIN {products} p ON r.asin = p.asin"""

_STAGE = """
    CASE WHEN m LIKE '%migration%' THEN 'Migrations' WHEN m LIKE '%seed%' OR m LIKE '%tb_reviews_src%' THEN 'Seed Load'
         WHEN m LIKE '%schemachange%' THEN 'Schemachange'
         WHEN regexp_matches(m, 'enrichment|cortex|sentiment|keyword') THEN 'AI Enrichment'
         WHEN regexp_matches(m, 'deploy|streamlit') THEN 'App Deploy' END"""
_STAGED = f"SELECT event_id, log_timestamp, {_STAGE} AS stage FROM (SELECT *, lower(message) AS m FROM {{pipeline_logs}})"
_SQL["log_stage_classify"] = f"SELECT event_id, stage FROM ({_STAGED}) WHERE stage IS NOT NULL"
_SQL["stage_durations"] = f"""
    SELECT stage, min(log_timestamp) AS first_event, max(log_timestamp) AS last_event,
           greatest(date_diff('second', min(log_timestamp), max(log_timestamp)), 1) AS duration_sec
    FROM ({_STAGED}) WHERE stage IS NOT NULL GROUP BY stage"""

for _source, _suffix in (("{enriched}", ""), ("{scored_facts}", "_facts"), (f"({_SQL['compacted_store']})", "_rollup")):
    for _name, _sql in reviews_questions(_source).items():
        _SQL[_name + _suffix] = _sql
for _name in ("enrichment_coverage", "null_stats"):
    _SQL[f"{_name}_rollup"] = _SQL[_name].replace("keywords_csv", "keywords").replace("{enriched}", f"({_SQL['compacted_store']})")
_SQL["merge_indexed"] = _SQL["merge_on_hash"]
_SQL["enrich_stream_by_state"] = _SQL["enrich_stream_incremental"]
_SQL["cleaned_store"] = _SQL["compacted_store"]
_SQL["sample_of_store"] = f"""
    SELECT id, stars, body, enrichment_status, retry_count FROM ({_SQL['compacted_store']})
    WHERE id IS NOT NULL AND stars IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY stars ORDER BY md5(id), id) <= 50"""
# Each run of the stream weighs words by the texts that it draws.
_SQL["keyword_step_stream"] = f"""
    WITH texts AS (SELECT CAST(doc_id AS VARCHAR) AS id, source AS asin, source < 'src15' AS early, text AS body
                   FROM {{documents}} WHERE {non_blank('text')}),
    bag AS (SELECT id, early, unnest(regexp_split_to_array(lower(body), '[^a-z]+')) AS word FROM texts),
    tf AS (SELECT id, early, word, count(*) AS tf FROM bag WHERE word <> '' GROUP BY ALL),
    df AS (SELECT early, word, count(*) AS df FROM tf GROUP BY ALL),
    n AS (SELECT early, CAST(count(*) AS DOUBLE) AS n FROM texts GROUP BY ALL),
    placed AS (
        SELECT id, word, row_number() OVER (PARTITION BY id ORDER BY round(tf * ln(n / df), 9) DESC, word) AS place
        FROM tf JOIN df USING (early, word) JOIN n USING (early) QUALIFY place <= 5)
    SELECT t.id, t.asin, 'FULLY_ENRICHED' AS enrichment_status, CAST(0 AS INTEGER) AS retry_count,
           coalesce(string_agg(p.word, '|' ORDER BY p.place), '') AS keywords
    FROM texts t LEFT JOIN placed p ON t.id = p.id GROUP BY t.id, t.asin"""


def oracle_sql() -> dict[str, str]:
    return {name: duckdb_sql(sql) for name, sql in _SQL.items()}
