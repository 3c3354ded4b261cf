"""The declared table schemas."""

from __future__ import annotations

from pyspark.sql import types as T

ITEM = "url STRING, raw_content STRING, content_type STRING, source_url STRING, start_url_id VARIANT, metadata VARIANT"

_TEXT, _TIME, _FLAG = T.StringType(), T.TimestampType(), T.BooleanType()
_TEXTS, _TREE, _MONEY = T.ArrayType(_TEXT), T.VariantType(), T.DecimalType(12, 2)


def _table(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


BOARDS = _table(
    id=_TEXT, name=_TEXT, url=_TEXT, type=_TEXT, active=_FLAG, created_at=_TIME, updated_at=_TIME
)
RUNS = _table(id=_TEXT, spider_name=_TEXT, started_at=_TIME)
MESSAGES = _table(
    seq=T.LongType(),
    type=_TEXT,
    run_id=_TEXT,
    spider_name=_TEXT,
    ts=_TIME,
    item=_table(
        url=_TEXT, raw_content=_TEXT, content_type=_TEXT, source_url=_TEXT, start_url_id=_TREE, metadata=_TREE
    ),
)
BRONZE = _table(
    url=_TEXT, raw_content=_TEXT, content_type=_TEXT, source_url=_TEXT, metadata=_TREE,
    last_seen_run_id=_TEXT, start_url_id=_TEXT, created_at=_TIME, updated_at=_TIME, deleted_at=_TIME,
)
SILVER = _table(
    id=_TEXT, url=_TEXT, title=_TEXT, company_name=_TEXT, employment_type=_TEXT, locations=_TEXTS,
    categories=_TEXTS, description=_TEXT, metadata=_TREE, pay_min=_MONEY, pay_max=_MONEY,
    pay_currency=_TEXT, pay_period=_TEXT, created_at=_TIME, updated_at=_TIME, deleted_at=_TIME,
)
INGEST_EVENTS = _table(
    id=_TEXT, occurred_at=_TIME, domain=_TEXT, start_url_id=_TEXT, source_url=_TEXT, posting_url=_TEXT,
    stage=_TEXT, reason=_TEXT, detail=_TEXT,
)
_COUNT = T.IntegerType()
NODES = T.ArrayType(
    _table(
        pre=_COUNT, size=_COUNT, parent=_COUNT, depth=_COUNT, tag=_TEXT, attrs=T.MapType(_TEXT, _TEXT),
        text=_TEXT, linked=_FLAG, noise=_FLAG,
    ),
    containsNull=False,
)

# The stored vocabulary.
BOARD_HTML = "html_crawl"
BOARD_API = "api"
BOARD_TYPES = (BOARD_HTML, BOARD_API)
STAGE_INDEX = "index"
STAGE_DETAIL = "detail"
NO_RULE = "no_rule"
UNPARSEABLE = "unparseable_content"
RULE_RAISED = "rule_raised"
INVALID_SHAPE = "invalid_shape"
JSON_TYPE = "application/json"
HTML_TYPE = "text/html"
UNSPECIFIED = "__unspecified__"
UNKNOWN_DOMAIN = "(unknown)"
PAY_PERIODS = ("year", "month", "week", "day", "hour")


def empty(spark, schema: T.StructType):
    return spark.createDataFrame([], schema)
