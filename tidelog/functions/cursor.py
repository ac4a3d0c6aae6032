"""Opaque page cursor: unpadded base64url of ``{"timestamp": ..., "id": ...}``."""

from __future__ import annotations

import base64
import binascii
import json
import re
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.functions.timeutil import format_iso, iso_text, iso_to_timestamp, parse_iso

MAX_ID = 2**63 - 1
_TOKEN = re.compile(r"[A-Za-z0-9+/_-]+={0,2}", re.ASCII)
_DIGITS = re.compile(r"\d+", re.ASCII)


@dataclass(frozen=True)
class LogCursor:
    """Position of the last row of a page, exact to the microsecond."""

    timestamp: datetime
    id: int


def encode_cursor(cursor: LogCursor) -> str:
    body = json.dumps(
        {"timestamp": format_iso(cursor.timestamp), "id": str(cursor.id)},
        separators=(",", ":"),
    )
    return base64.urlsafe_b64encode(body.encode()).decode().rstrip("=")


def decode_cursor(token: str) -> LogCursor:
    """Cursor of a token; any fault is the one error ``invalid cursor``."""
    try:
        if _TOKEN.fullmatch(token) is None:
            raise ValueError(token)
        plain = token.rstrip("=").replace("+", "-").replace("/", "_")
        body = json.loads(base64.urlsafe_b64decode(plain + "=" * (-len(plain) % 4)))
        stamp, number = body["timestamp"], body["id"]
        if not isinstance(number, str) or _DIGITS.fullmatch(number) is None:
            raise ValueError(number)
        if int(number) > MAX_ID:
            raise ValueError(number)
        return LogCursor(parse_iso(stamp), int(number))
    except (ValueError, TypeError, KeyError, OverflowError, binascii.Error, RecursionError):
        raise ValueError("invalid cursor") from None


def cursor_token(df: DataFrame, timestamp: str = "timestamp", id: str = "id") -> Column:
    """Column form of :func:`encode_cursor`."""
    body = F.to_json(
        F.struct(
            iso_text(df, timestamp, 6).alias("timestamp"),
            F.col(id).cast("string").alias("id"),
        )
    )
    encoded = F.base64(F.encode(body, "UTF-8"))
    # Spark breaks base64 into lines of 76 characters.
    return F.translate(F.rtrim(encoded, F.lit("=")), "+/\r\n", "-_")


def cursor_position(token: Column) -> Column:
    """Column form of :func:`decode_cursor`: STRUCT<timestamp, id>, NULL on any fault."""
    plain = F.translate(F.rtrim(token, F.lit("=")), "-_", "+/")
    padded = F.rpad(plain, (F.ceil(F.length(plain) / 4) * 4).cast("int"), F.lit("="))
    body = F.try_parse_json(F.try_to_binary(padded, F.lit("base64")).cast("string"))
    stamp = F.try_variant_get(body, "$.timestamp", "variant")
    number = F.try_variant_get(body, "$.id", "variant")
    moment = F.when(
        F.schema_of_variant(stamp) == "STRING",
        iso_to_timestamp(F.try_variant_get(body, "$.timestamp", "string")),
    )
    digits = F.try_variant_get(body, "$.id", "string")
    row_id = F.when(
        (F.schema_of_variant(number) == "STRING") & digits.rlike(r"^\d+(?![\s\S])"),
        digits.try_cast("long"),
    )
    return F.when(
        moment.isNotNull() & row_id.isNotNull(),
        F.struct(moment.alias("timestamp"), row_id.alias("id")),
    )
