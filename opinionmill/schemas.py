"""Column layouts of the tables the library reads and writes."""

from pyspark.sql import types as T


def _struct(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in columns.items()])


_S, _L, _D = T.StringType(), T.LongType(), T.DoubleType()

PRODUCTS_STAGING = _struct(
    ASIN=_S, TITLE=_S, URL=_S, MAIN_IMAGE=_S, ALT_IMAGES=_S, BREADCRUMBS=_S,
    RATING=_L, NUMBER_OF_RATINGS=_L, DESCRIPTION=_S, CHARACTERISTICS=_S,
)

REVIEWS_STAGING = _struct(
    ID=_S, ASIN=_S, URL=_S, BODY=_S, DATE=_S, TITLE=_S, IMAGES=_S, VIDEOS=_S, STARS=_L,
    USER_ID=_S, VARIATION=_S, VERIFIED_PURCHASE=_S, FOUND_HELPFUL=_L,
)

# What the fast tier writes; the keyword tier's columns are added on read.
REVIEWS_FAST = _struct(
    id=_S, asin=_S, body=_S, stars=_L, row_hash=_S, sentiment=_D,
    enrichment_status=_S, created_at=T.TimestampType(),
)

# One row per review the keyword tier has tried.
OUTCOMES = _struct(
    id=_S, keywords=T.ArrayType(_S), attempts=T.IntegerType(), error=_S,
    finished_at=T.TimestampNTZType(),
)

# The fact table with its outcomes, as the compacted base holds it.
REVIEWS_ENRICHED = T.StructType([
    *REVIEWS_FAST.fields,
    *_struct(keywords=T.ArrayType(_S), retry_count=T.IntegerType(), error_message=_S, failed_at=T.TimestampNTZType()).fields,
])

# One row per version of the base, with the loads that it holds.
BASE_VERSIONS = _struct(version=T.IntegerType(), folder=_S, facts=T.ArrayType(_S), outcomes=T.ArrayType(_S))

PIPELINE_LOGS = _struct(log_timestamp=T.TimestampNTZType(), level=_S, message=_S)

EVENT_LOG_TAIL = _struct(timestamp=T.TimestampNTZType(), severity=_S, message=_S)

STAGE_DURATIONS = _struct(
    stage=_S, first_event=T.TimestampNTZType(), last_event=T.TimestampNTZType(), duration_sec=_L,
)

COST_SNAPSHOT = _struct(
    snapshot_date=T.DateType(), wh_credits=_D, ai_credits=_D, storage_gb=_D,
    created_at=T.TimestampNTZType(),
)

FIGURE = _struct(name=_S, value=_D)

AI_USAGE = _struct(start_time=T.TimestampNTZType(), credits_used=_D, service_type=_S)

FUNCTION_USAGE = _struct(function_name=_S, call_count=_L, credits=_D)

TASK_STATUS = _struct(name=_S, enabled=_S, schedule=_S, last_run=_S, last_result=_S)


def all_strings(schema: T.StructType) -> T.StructType:
    """The same columns as text, plus the row hash: the layout of a raw table."""
    return T.StructType(
        [T.StructField(f.name, _S, True) for f in schema.fields] + [T.StructField("row_hash", _S, True)]
    )
