"""Identity of a listing from its URL."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# Host of each marketplace.
HOSTS = {
    "divar.ir": "divar",
    "bama.ir": "bama",
    "hamrah-mechanic.com": "hamrah",
    "khodro45.com": "khodro45",
    "sheypoor.com": "sheypoor",
}


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (lower case, without port and ``www.``) and non-empty path segments."""
    raw = F.trim(url)
    full = F.when(raw.contains("://"), raw).otherwise(F.concat(F.lit("https://"), raw))
    rest = F.regexp_extract(full, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#]*)([^?#]*)", 1)
    path = F.regexp_extract(full, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#]*)([^?#]*)", 2)
    host = F.regexp_replace(F.lower(F.regexp_replace(rest, r":\d*$", "")), r"^www\.", "")
    return host, F.filter(F.split(path, "/"), lambda s: s != "")


def listing_identity(url: Column, hosts: Mapping[str, str] = HOSTS) -> Column:
    """``struct(source, source_id)`` of a pasted URL; NULL when it names no listing."""
    host, segments = url_parts(url)
    table = F.create_map(*[F.lit(x) for kv in hosts.items() for x in kv])
    source = F.try_element_at(table, host)
    n, first, last = F.size(segments), F.try_element_at(segments, F.lit(1)), F.try_element_at(segments, F.lit(-1))
    tail = F.regexp_extract(F.regexp_replace(last, r"\.html$", ""), r"-([0-9]+)$", 1)
    detail = F.regexp_extract(last, r"^detail-([^-]+)", 1)
    id_ = (
        F.when((source == "divar") & (n >= 3) & (first == "v"), last)
        .when((source == "sheypoor") & (n >= 2) & (first == "v"), F.nullif(tail, F.lit("")))
        .when((source == "bama") & (n >= 2) & (first == "car"), F.nullif(detail, F.lit("")))
        .when((source == "hamrah") & last.rlike("^[0-9]+$"), last)
        .when((source == "khodro45") & (n >= 2) & (first == "used-car"), last)
    )
    return F.when(id_.isNotNull(), F.struct(source.alias("source"), id_.alias("source_id")))
