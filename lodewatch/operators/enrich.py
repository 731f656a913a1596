"""Enrichment of process and file events from dimension tables, temporary-file anomalies, verdicts."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodewatch.functions import tables as T
from lodewatch.functions.classify import contains_any, location
from lodewatch.functions.net import any_of
from lodewatch.functions.text import basename, extension

ORDER = ("us", "event_id")


def signed(events: DataFrame, signatures: DataFrame) -> DataFrame:
    """``signature_valid`` (false if unknown), ``signer``, ``thumbprint`` by canonical path."""
    out = events.join(signatures.select("canonical_path", F.col("valid").alias("signature_valid"), "signer", "thumbprint"), "canonical_path", "left")
    return out.withColumn("signature_valid", F.coalesce("signature_valid", F.lit(False)))


def new_child(children: Column, roots: Sequence[tuple[str, str]]) -> Column:
    """Whether any child path lies in no known root."""
    return F.coalesce(F.exists(children, lambda c: location(c, roots) == "UNKNOWN"), F.lit(False))


def shadowing(dlls: Column, system_names: Sequence[str], system_folders: Sequence[str]) -> Column:
    """Modules with a system module's name outside the system folders."""
    low = [f.lower() for f in system_folders]
    odd = lambda d: F.lower(basename(d)).isin(*[n.lower() for n in system_names]) & ~any_of(F.lower(d).startswith(f) for f in low)
    return F.coalesce(F.filter(dlls, odd), F.array().cast("array<string>"))


def canonical_variables(path: Column, variables: dict[str, str]) -> Column:
    """Expands %NAME% in a path, whatever the case of the name."""
    for name, value in variables.items():
        pattern = "(?i)%" + "".join("\\" + c if c in "()" else c for c in name) + "%"
        path = F.regexp_replace(path, pattern, value.replace("\\", "\\\\").replace("$", "\\$"))
    return path


def rerouted(events: DataFrame, churning: DataFrame, width_us: int) -> DataFrame:
    """route C becomes B in a folder and window that ``churning`` (``directory``, ``window_us``) lists."""
    window = F.floor(F.col("us") / width_us) * width_us
    marked = events.withColumn("window_us", window).join(churning.select("directory", "window_us", F.lit(True).alias("busy_")), ["directory", "window_us"], "left")
    return marked.withColumn("route", F.when((F.col("route") == "C") & F.coalesce("busy_", F.lit(False)), "B").otherwise(F.col("route"))).drop("busy_", "window_us")


# Fixed values. Reasons for which a temporary file is elevated, in the order in which they are looked for.
REASONS = ("rename_to_executable", "suspicious_process_cross_access", "long_lived_temp_file", "document_in_high_churn_zone")


def temp_anomalies(events: DataFrame, busy: DataFrame, deep_s: int = T.DEEP_WATCH) -> DataFrame:
    """The first reason for which a temporary file is elevated; it stays elevated.

    events: ``directory``, ``path``, ``pid``, ``process_name``, ``action``.
    busy: folders of high churn.  Reasons, in order: renamed to an executable,
    touched by a suspicious process other than its creator, alive too long, a
    document in a busy folder.
    """
    life = Window.partitionBy("directory", "path").orderBy(*ORDER)
    at = events.withColumns({"born": F.first("us").over(life), "creator": F.first("pid").over(life)}).join(busy.select("directory", F.lit(True).alias("busy_")).distinct(), "directory", "left")
    reason = (
        F.when((F.col("action") == "rename") & extension(F.col("path")).isin(*T.EXECUTABLE_EXTENSIONS), REASONS[0])
        .when((F.col("pid") != F.col("creator")) & contains_any(F.lower("process_name"), T.SUSPICIOUS_PROCESSES), REASONS[1])
        .when(F.floor((F.col("us") - F.col("born")) / 1_000_000) > deep_s, REASONS[2])
        .when(F.coalesce("busy_", F.lit(False)) & extension(F.col("path")).isin(*T.DOCUMENT_EXTENSIONS), REASONS[3])
    )
    found = at.withColumn("reason", reason).where("reason is not null")
    return found.groupBy("directory", "path").agg(F.min_by(F.struct("reason", "us", "event_id"), F.struct(*ORDER)).alias("f")).select("directory", "path", "f.reason", "f.us", "f.event_id")


def temp_states(events: DataFrame, busy: DataFrame, deep_s: int = T.DEEP_WATCH) -> DataFrame:
    """Adds ``state`` of the temporary file after each event: ELEVATED from its first anomaly on, else DROPPED once deleted, else WATCHING."""
    found = temp_anomalies(events, busy, deep_s).select(F.col("directory").alias("d_"), F.col("path").alias("p_"), F.struct("us", "event_id").alias("up_"))
    joined = events.join(found, F.col("directory").eqNullSafe(F.col("d_")) & F.col("path").eqNullSafe(F.col("p_")), "left")
    upto = Window.partitionBy("directory", "path").orderBy(*ORDER)
    state = F.when(F.struct(*ORDER) >= F.col("up_"), "ELEVATED").when(F.last("action").over(upto.rowsBetween(Window.unboundedPreceding, 0)) == "delete", "DROPPED").otherwise("WATCHING")
    return joined.withColumn("state", state).drop("d_", "p_", "up_")


def persistence_touched(event: Column | None = None) -> Column:
    """No event is known to touch a persistence place."""
    return F.lit(False)


def verdicts(groups: DataFrame, model: Callable[[DataFrame], Column] | None = None) -> DataFrame:
    """Risk and verdict of groups (``component``, ``processes``, ``risk_level``).

    A group with the shell is High.  ``model`` gives a boolean column, false
    without one, such as ``risk.Model.threat``; where a choice is left, a hash
    of the group makes it.
    """
    risk = F.when(F.exists("processes", lambda p: F.lower(p).contains("powershell.exe")), "High").otherwise(F.coalesce("risk_level", F.lit("Low")))
    bucket = F.conv(F.substring(F.md5(F.col("component").cast("string")), 1, 8), 16, 10).cast("long") % 12
    out = groups.withColumn("risk", risk)
    threat = model(out) if model else F.lit(False)
    # Fixed values. Labels of the levels between.
    medium = F.element_at(F.array(*map(F.lit, ("Medium", "Above Medium", "High"))), (bucket % 3 + 1).cast("int"))
    low = F.element_at(F.array(*map(F.lit, ("Low", "Low", "Medium", "Above Medium"))), (bucket % 4 + 1).cast("int"))
    label = F.when(threat | (F.col("risk") == "High"), "CRITICAL").when(F.col("risk") == "Medium", medium).otherwise(low)
    return out.withColumns({"is_threat": threat, "threat_level": label})
