"""Requests as columns: authorisation, which replies are tried again, and how long to wait. Sending is a connector's work."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: fixed values: replies that are tried again, now and in the first generations, and methods that may be sent twice
RETRY_STATUS = [415, 429, 500, 502, 503, 504]
OLDER_RETRY_STATUS = [429, 500, 502, 503, 504]
SAFE_METHODS = ["GET", "HEAD", "OPTIONS"]


def basic_auth(user: Column, password: Column) -> Column:
    return F.concat(F.lit("Basic "), F.base64(F.concat(user, F.lit(":"), password).cast("binary")))


def tried_again(status: Column, method: Column, attempt: Column, retries: int = 4, statuses: list[int] | None = None) -> Column:
    """Whether a request is sent once more: only safe methods, only replies that may change, ``retries`` times."""
    return status.isin(statuses or RETRY_STATUS) & F.upper(method).isin(SAFE_METHODS) & (attempt < retries)


def wait_seconds(attempt: Column, factor: float = 1.0) -> Column:
    """Seconds before an attempt (from 1): none before the second, then doubling."""
    return F.when(attempt <= 1, 0.0).otherwise(F.lit(factor) * F.pow(F.lit(2.0), attempt - 1))


def healthy(status: Column, body: Column) -> Column:
    """Whether a health check got a user: a good status and a JSON body with an id."""
    return (status < 400) & F.try_variant_get(F.try_parse_json(body), "$.id", "bigint").isNotNull()
