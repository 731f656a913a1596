"""Paths, command lines, scripts, timestamps and hashes."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Fixed values. Time formats, tried in this order; the last two have no zone of their own.
TIME_FORMATS = ("yyyy-MM-dd'T'HH:mm:ss.SSSSSSX", "yyyy-MM-dd'T'HH:mm:ss.SSSX", "yyyy-MM-dd'T'HH:mm:ssX", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm:ss.SSSSSS")
# Fixed value. 1970 in units of 100 ns since 1601.
FILETIME_EPOCH = 116444736000000000


def parse_ts(raw: Column, zone: str = "UTC") -> Column:
    """The first format that fits, else null, whatever the session's time zone; texts without a zone are of ``zone``."""
    said = F.concat_ws(" ", raw, F.lit(zone))
    return F.coalesce(*(F.try_to_timestamp(raw, F.lit(f)) if f.endswith("X") else F.try_to_timestamp(said, F.lit(f + " VV")) for f in TIME_FORMATS))


def filetime(value: Column) -> Column:
    """100 ns since 1601 as a timestamp; null before 1970."""
    return F.when(value >= FILETIME_EPOCH, F.timestamp_micros(F.call_function("div", value - FILETIME_EPOCH, F.lit(10))))


def iso_ms(ts: Column) -> Column:
    """In UTC, to the millisecond, cut and not rounded."""
    return F.date_format(F.to_utc_timestamp(ts, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"[^\\/]*$", 0)


def dirname(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)[\\/][^\\/]*$", 1)


def extension(path: Column) -> Column:
    """Lower case, with the dot; empty if the last part has none."""
    return F.lower(F.regexp_extract(path, r"\.[^.\\/]*$", 0))


def canonical_path(path: Column) -> Column:
    """Lower case, with backslashes, ``.`` and ``..`` resolved; empty or over-long paths are null."""
    parts = F.split(F.replace(F.lower(path), F.lit("/"), F.lit("\\")), r"\\")
    step = lambda acc, p: F.when(p == ".", acc).when((p == "..") & (F.size(acc) > 1), F.slice(acc, 1, F.size(acc) - 1)).otherwise(F.array_append(acc, p))
    whole = F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "\\")
    return F.when((F.length(path) > 0) & (F.length(path) <= 32767), whole)


@F.pandas_udf(StringType())
def _composed(line: pd.Series) -> pd.Series:
    return line.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def normalized_command(line: Column) -> Column:
    """At most 4096 characters, composed (NFC), lower case, white space collapsed, at most 256.

    Only lines with a character beyond ASCII go through Python; the others are in normal form as they are.
    """
    cut = F.substring(line, 1, 4096)
    composed = F.when(cut.rlike(r"[^\x00-\x7F]"), _composed(F.when(cut.rlike(r"[^\x00-\x7F]"), cut))).otherwise(cut)
    return F.substring(F.regexp_replace(F.lower(composed), r"\s+", " "), 1, 256)


# Fixed values. Regular expressions of long Base64 runs, joined quotes, encoded commands, addresses.
BLOB = "[A-Za-z0-9+/]{40,}={0,2}"
JOINED = r'"([^"]+)"\s*\+\s*"([^"]+)"'
ENCODED = r"(?i)(?:-encodedcommand|-enc|-e)\s+([A-Za-z0-9+/]{20,}={0,2})"
ADDRESS = r"https?://[^\s\"'<>\]]+"


def deobfuscated(script: Column) -> Column:
    """Back-ticks dropped, long Base64 runs marked, quoted parts joined, three times."""
    out = F.regexp_replace(script, "`", "")
    out = F.regexp_replace(out, BLOB, "[BASE64_BLOB]")
    for _ in range(3):
        out = F.regexp_replace(out, JOINED, '"$1$2"')
    return out


def encoded_command(script: Column) -> Column:
    """The decoded argument of an encoded command, NULs dropped; empty without one."""
    b64 = F.regexp_replace(F.regexp_extract(script, ENCODED, 1), "=", "")
    usable = F.substr(b64, F.lit(1), (F.length(b64) - F.when(F.length(b64) % 4 == 1, 1).otherwise(0)).cast("int"))
    padded = F.concat(usable, F.repeat(F.lit("="), ((4 - F.length(usable) % 4) % 4).cast("int")))
    return F.when(b64 == "", "").otherwise(F.replace(F.decode(F.unbase64(padded), "ISO-8859-1"), F.lit("\x00"), F.lit("")))


def urls(script: Column) -> Column:
    return F.array_join(F.regexp_extract_all(script, F.lit(ADDRESS), F.lit(0)), " | ")


def xml_data(raw: Column, name: str) -> Column:
    return F.regexp_extract(raw, rf"""(?s)<Data Name=['"]{name}['"]>(.*?)</Data>""", 1)


def xml_field(raw: Column, name: str) -> Column:
    return F.regexp_extract(raw, rf"(?s)<{name}[^>]*>(.*?)</{name}>", 1)


def fingerprint(path: Column, parent: Column, command: Column, thumbprint: Column, location: Column) -> Column:
    """SHA-256 of the parts with NULs between; missing parts are empty."""
    nul, part = F.lit("\x00"), lambda c: F.coalesce(c, F.lit(""))
    return F.sha2(F.concat(part(path), nul, part(parent), nul, F.substring(part(command), 1, 256), nul, part(thumbprint), nul, part(location)), 256)


def novelty_keys(path: Column, parent: Column) -> tuple[Column, Column]:
    """Keys under which a process and its relationship to its parent count as seen; the second is of the hexadecimal digests of both paths."""
    part = lambda c: F.sha2(F.coalesce(c, F.lit("")), 256)
    return part(path), F.sha2(F.concat(part(parent), part(path)), 256)


def session_key(vid: Column, pid: Column, serial: Column, suffix: Column) -> Column:
    return F.coalesce(F.nullif(serial, F.lit("")), F.concat_ws(":", vid, pid, suffix))


def usb_ids(instance: Column) -> tuple[Column, Column, Column]:
    """Vendor, product and serial of a device instance path; a serial has 4 characters at least and no ``&``."""
    tail = F.regexp_extract(instance, r"[^\\]*$", 0)
    serial = F.when((F.length(tail) >= 4) & ~tail.contains("&"), tail).otherwise("")
    return F.regexp_extract(instance, "VID_(.{4})", 1), F.regexp_extract(instance, "PID_(.{4})", 1), serial


def duration(seconds: Column) -> Column:
    """As s, m or h."""
    return F.when(seconds < 60, F.concat(F.floor(seconds), F.lit("s"))).when(seconds < 3600, F.concat(F.floor(seconds / 60), F.lit("m"))).otherwise(F.concat(F.floor(seconds / 3600), F.lit("h")))
