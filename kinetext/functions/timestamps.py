"""Timestamps: parsing, ISO form, months. The session's time zone has to be UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPOCH = "1970-01-01T00:00:00Z"


#: ISO 8601's basic form, and its extended form.
_BASIC = r"^(\d{4})(\d{2})(\d{2})T(\d{2})(\d{2})(\d{2})(Z|[+-]\d{2}:?\d{2})?$"
_EXTENDED = "$1-$2-$3T$4:$5:$6$7"


def parse_timestamp(t: Column) -> Column:
    """ISO form with a T, extended or basic, or exactly ``yyyy-MM-dd HH:mm:ss``; without a zone UTC; null if neither."""
    iso = F.regexp_replace(F.regexp_replace(t, F.lit(_BASIC), F.lit(_EXTENDED)), F.lit(r"([+-]\d{2})(\d{2})$"), F.lit("$1:$2"))
    return F.when(F.contains(t, F.lit("T")), F.try_to_timestamp(iso)).when(
        F.regexp_like(t, F.lit(r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$")), F.try_to_timestamp(t, F.lit("yyyy-MM-dd HH:mm:ss"))
    )


def to_iso8601(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def takeout_timestamp(t: Column) -> Column:
    """``Sep 15, 2024, 6:08:45 PM MDT`` in ISO form; the zone is dropped, not converted; what can't be read: the epoch."""
    bare = F.regexp_replace(F.trim(t), F.lit(r"(?U)\s+[A-Z]{3,4}$"), F.lit(""))
    bare = F.regexp_replace(bare, F.lit(r"[\x{202F}\x{00A0}]"), F.lit(" "))
    return F.coalesce(to_iso8601(F.try_to_timestamp(bare, F.lit("MMM d, yyyy, h:mm:ss a"))), F.lit(EPOCH))


def month(t: Column) -> Column:
    """``yyyy-MM`` in the text's own offset; null if it can't be read."""
    return F.when(parse_timestamp(t).isNotNull(), F.substring(F.regexp_replace(t, F.lit(_BASIC), F.lit(_EXTENDED)), 1, 7))
