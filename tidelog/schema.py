"""Table schemas and the fixed vocabularies of the log store."""

from __future__ import annotations

from pyspark.sql import types as T

# The four levels, the bucket widths, the grouping columns.
LEVELS = ("debug", "info", "warn", "error")
BUCKETS = {"1m": "1 minute", "5m": "5 minutes", "1h": "1 hour", "1d": "1 day"}
GROUPS = {"service": "service", "level": "level"}

# Reject reasons, in the order the checks run.
NOT_OBJECT = "log must be an object"
BAD_TIMESTAMP = "invalid timestamp"
IN_FUTURE = "timestamp must not be more than five minutes in the future"
BAD_LEVEL = "invalid level"
EMPTY_SERVICE = "service must not be empty"
EMPTY_MESSAGE = "message must not be empty"
ATTRIBUTES_NOT_FLAT = "attributes must be a flat object"
ATTRIBUTE_VALUE = "attributes must contain only string, number, or boolean values"
BAD_REQUEST = "request body must contain a non-empty logs array"

MAX_FUTURE_MINUTES = 5
DEFAULT_LIMIT = 100
MAX_LIMIT = 1000
DEFAULT_RETENTION_DAYS = 30

LOG_COLUMNS = ("id", "timestamp", "level", "service", "message", "attributes")

LOG = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("level", T.StringType()),
        T.StructField("service", T.StringType()),
        T.StructField("message", T.StringType()),
        T.StructField("attributes", T.StringType()),
        T.StructField("attr_text", T.MapType(T.StringType(), T.StringType())),
        T.StructField("day", T.DateType()),
    ]
)

ROLLUP = T.StructType(
    [
        T.StructField("bucket_start", T.TimestampType()),
        T.StructField("service", T.StringType()),
        T.StructField("level", T.StringType()),
        T.StructField("count", T.LongType()),
        T.StructField("day", T.DateType()),
    ]
)

REJECT = T.StructType(
    [
        T.StructField("index", T.IntegerType()),
        T.StructField("reason", T.StringType()),
    ]
)

OUTCOME = T.StructType(
    [
        T.StructField("request_id", T.StringType()),
        T.StructField("accepted", T.LongType()),
        T.StructField("rejected", T.ArrayType(REJECT)),
        T.StructField("status", T.IntegerType()),
        T.StructField("error", T.StringType()),
    ]
)

DAY = T.StructField("day", T.DateType())
# What the tables of the store hold besides the name of the segment.
TABLES = {"logs": LOG, "rollups": ROLLUP, "outcomes": T.StructType([*OUTCOME.fields, DAY])}

COMMIT = T.StructType(
    [
        T.StructField("kind", T.StringType()),
        T.StructField("segment", T.StringType()),
        T.StructField("rows", T.LongType()),
        T.StructField("min_timestamp", T.TimestampType()),
        T.StructField("max_timestamp", T.TimestampType()),
        T.StructField("committed_at", T.TimestampType()),
    ]
)
