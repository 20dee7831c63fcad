"""Removing secrets from what is shown or logged."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from turnmill.functions.text import units

# Names of secret fields, what a secret value looks like, and what stands in the place of either.
SENSITIVE_KEY = "api[_-]?key|secret|token|password|authorization|credential"
SECRET_VALUE = "sk-(?:ant|proj)-[A-Za-z0-9_-]{20,}|sk-[A-Za-z0-9_-]{30,}|[A-Za-z0-9+/=]{40,}"
SANITIZED = "[已脱敏]"
SENSITIVE_HEADER_PARTS = ("authorization", "auth", "key", "token", "secret")
MOST = 200


def for_log(value: Column) -> Column:
    """The value; a stand-in where it looks like a secret; its beginning where it is longer than MOST units."""
    cut = F.concat(F.substring(value, 1, MOST - 3), F.lit("..."))
    return F.when((units(value) >= 20) & value.rlike(SECRET_VALUE), SANITIZED).when(units(value) > MOST, cut).otherwise(value)


def fields(values: Column) -> Column:
    """A map of names to values for the log: those of secret names are hidden whatever they are."""
    return F.transform_values(values, lambda k, v: F.when(k.rlike("(?i)" + SENSITIVE_KEY), SANITIZED).otherwise(for_log(v)))


def headers(values: Column) -> Column:
    """A map of header names to values, without the values of sensitive ones: cookie, and names with any of the sensitive parts."""

    def hidden(name: Column) -> Column:
        low = F.lower(name)
        out = low == "cookie"
        for part in SENSITIVE_HEADER_PARTS:
            out = out | low.contains(part)
        return out

    return F.transform_values(values, lambda k, v: F.when(hidden(k), "[REDACTED]").otherwise(v))
