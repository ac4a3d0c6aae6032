"""Checks of log entries, one definition for rows of entries and for whole requests.

A request is checked where it lies: its entries stay one array, so its outcome needs
no regrouping and each check is computed once, whatever is read of the result.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog import schema as S
from tidelog.functions.attributes import Fields, Stage, in_columns, shape_stages, staged, text_stages
from tidelog.functions.timeutil import iso_to_timestamp, time_literal
from tidelog.sources.requests import with_logs

_TEXTS = ("level", "service", "message")
# A time in another form than text never reads as a valid one, so its text is enough.
_OBJECT = "struct<timestamp:string,level:variant,service:variant,message:variant,attributes:variant>"
# How numbers, booleans, objects and arrays read as text.
_OTHER_TEXT = r"^[-0-9{\[]|^(true|false)$"
CHECKED = ("timestamp", "level", "service", "message", "attributes", "attr_text")
# Of a check inside a request: what names and judges the entry, and what its log columns are made of.
_SHOWN = ("index", "reason", "timestamp", "level", "service", "message", "_attributes", "_simple", "is_flat")


def to_records(entries: DataFrame, entry: str = "entry") -> DataFrame:
    """Typed columns of a VARIANT entry; NULL where a field is absent or unfit."""
    kept = [name for name in entries.columns if name != entry]
    rows = entries.select(*kept, F.col(entry).alias("_entry"))
    return in_columns(rows, [*_field_stages(), *_value_stages()]).select(*kept, *CHECKED)


def check_entries(
    entries: DataFrame, as_of: datetime | None = None, entry: str = "entry"
) -> DataFrame:
    """Adds ``reason`` (NULL when valid) and the typed log columns to each entry.

    Rows whose entry is NULL stand for bad requests and get no reason. ``as_of``
    is the clock for the future check, one moment for the whole batch.
    """
    kept = [name for name in entries.columns if name != entry]
    rows = entries.select(*kept, F.col(entry).alias("_entry"))
    stages = [*_field_stages(), _reason_stage(_latest(as_of)), *_value_stages()]
    return in_columns(rows, stages).select(*kept, "reason", *CHECKED)


def split_checked(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(valid, rejected)`` of checked entries; bad requests are in neither."""
    entry = F.col("index").isNotNull()
    return (
        checked.filter(entry & F.col("reason").isNull()).drop("reason"),
        checked.filter(entry & F.col("reason").isNotNull()).drop(*CHECKED),
    )


def validate(entries: DataFrame, as_of: datetime | None = None) -> tuple[DataFrame, DataFrame]:
    """``(valid, rejected)``: typed logs, and index plus first failing reason."""
    return split_checked(check_entries(entries, as_of))


def check_requests(
    requests: DataFrame, as_of: datetime | None = None, body: str = "body"
) -> DataFrame:
    """Puts ``checks`` in place of the body: per entry its ``index``, ``reason`` and typed fields.

    A body that does not parse, has no ``logs`` array or an empty one has NULL checks.
    Attributes stay as they came: only those of valid entries are written out, later.
    """
    kept = [name for name in requests.columns if name != body]
    entries = F.transform("_logs", lambda entry, index: F.struct(index.alias("index"), entry.alias("_entry")))
    checks, _ = staged(entries, ["index", "_entry"], [*_field_stages(), _reason_stage(_latest(as_of))])
    shown = F.transform(checks, lambda c: F.struct(*(c[name].alias(name) for name in _SHOWN)))
    return with_logs(requests, "_logs", body).select(*kept, shown.alias("checks"))


def accepted_logs(checked: DataFrame) -> DataFrame:
    """One row per valid entry of checked requests: ``index`` and the typed log columns."""
    valid = F.filter("checks", lambda c: c["reason"].isNull())
    rows = checked.select(*_rest(checked), F.inline(valid))
    return in_columns(rows, _value_stages()).select(*_rest(checked), "index", *CHECKED)


def accepted_count() -> Column:
    """How many entries of a checked request are valid; 0 for a bad request."""
    return F.coalesce(F.size(F.filter("checks", lambda c: c["reason"].isNull())), F.lit(0))


def rejected_entries(checked: DataFrame) -> DataFrame:
    """One row per invalid entry of checked requests: ``index`` and ``reason``."""
    return checked.select(*_rest(checked), F.inline(_rejects()))


def request_outcomes(checked: DataFrame) -> DataFrame:
    """Accepted count, rejects by index, status and error of every checked request.

    Each request is a row of its own already, so nothing is grouped. The columns
    that name the request stay.
    """
    rejected = F.coalesce(_rejects(), F.array())
    accepted = F.coalesce(F.size("checks") - F.size(rejected), F.lit(0))
    counted = checked.select(
        *_rest(checked), accepted.cast("long").alias("accepted"),
        rejected.cast(S.OUTCOME["rejected"].dataType).alias("rejected"),
        F.when(F.col("checks").isNull(), F.lit(S.BAD_REQUEST)).alias("error"),
    )
    status = F.when(F.col("accepted") > 0, 200).otherwise(400).alias("status")
    return counted.select(*_rest(checked), "accepted", "rejected", status, "error")


def _rest(checked: DataFrame) -> list[str]:
    return [name for name in checked.columns if name != "checks"]


def _rejects() -> Column:
    failed = F.filter("checks", lambda c: c["reason"].isNotNull())
    return F.transform(failed, lambda c: F.struct(c["index"].alias("index"), c["reason"].alias("reason")))


def _latest(as_of: datetime | None) -> Column:
    """The last millisecond that is not too far in the future."""
    now = F.current_timestamp() if as_of is None else time_literal(as_of)
    return F.unix_millis(now) + S.MAX_FUTURE_MINUTES * 60_000


def _field_stages() -> list[Stage]:
    """Steps from ``_entry`` to its fields, typed where a check needs them.

    One cast takes the fields out of the entry; it is NULL for what is no object. A
    field of the wrong type is NULL.
    """

    def fields(get: Fields) -> dict[str, Column]:
        return {"_object": get("_entry").try_cast(_OBJECT)}

    def casts(get: Fields) -> dict[str, Column]:
        found = get("_object")
        texts = {name: F.try_variant_get(found[name], "$", "string") for name in _TEXTS}
        return {"timestamp": iso_to_timestamp(found["timestamp"]), "_attributes": found["attributes"], **texts}

    def texts(get: Fields) -> dict[str, Column]:
        return {name: _if_text(get(name), get("_object")[name]) for name in _TEXTS}

    return [fields, casts, texts, *shape_stages("_attributes")]


def _value_stages() -> list[Stage]:
    """Steps to ``attributes`` and ``attr_text``; absent attributes are an empty object."""

    def given(get: Fields) -> dict[str, Column]:
        absent = get("_attributes").isNull()
        none = F.create_map().cast("map<string,string>")
        return {
            "attributes": F.when(absent, "{}").otherwise(get("attributes")),
            "attr_text": F.when(absent, none).otherwise(get("attr_text")),
        }

    return [*text_stages("_attributes"), given]


def _if_text(text: Column, value: Column) -> Column:
    """The text of a VARIANT if it is a string: only what may be the text of another kind is looked at."""
    is_text = F.schema_of_variant(value) == "STRING"
    return F.when(text.rlike(_OTHER_TEXT), F.when(is_text, text)).otherwise(text)


def _reason_stage(latest: Column) -> Stage:
    """The first check that an entry fails."""

    def reason(get: Fields) -> dict[str, Column]:
        given = get("_attributes").isNotNull()
        found = (
            F.when(get("_entry").isNull(), F.lit(None).cast("string"))
            .when(get("_object").isNull(), S.NOT_OBJECT)
            .when(get("timestamp").isNull(), S.BAD_TIMESTAMP)
            .when(F.unix_millis(get("timestamp")) > latest, S.IN_FUTURE)
            .when(~F.coalesce(get("level").isin(*S.LEVELS), F.lit(False)), S.BAD_LEVEL)
            .when(F.coalesce(F.length(get("service")), F.lit(0)) == 0, S.EMPTY_SERVICE)
            .when(F.coalesce(F.length(get("message")), F.lit(0)) == 0, S.EMPTY_MESSAGE)
            .when(given & ~get("is_object"), S.ATTRIBUTES_NOT_FLAT)
            .when(given & ~get("is_flat"), S.ATTRIBUTE_VALUE)
        )
        return {"reason": found}

    return reason
