"""Categories, severities, routes and flags as column expressions."""

from __future__ import annotations

import functools
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodewatch.functions import tables as T
from lodewatch.functions.net import any_of
from lodewatch.functions.text import extension


def contains_any(text: Column, words: Sequence[str]) -> Column:
    return any_of(text.contains(w) for w in words)


def ordinal(label: Column, order: Sequence[str]) -> Column:
    return functools.reduce(lambda c, kv: c.when(label == kv[1], kv[0]), enumerate(order), F.when(F.lit(False), 0))


def label(number: Column, order: Sequence[str]) -> Column:
    return F.element_at(F.array(*map(F.lit, order)), (number + 1).cast("int"))


def script_match(script: Column, patterns: Sequence[tuple[str, str, str]] = T.SCRIPT_PATTERNS) -> Column:
    """Struct ``severity`` (ordinal) and ``category`` of the severest pattern, the first of equals; null without one.

    Whole scripts are searched.  The lower-case text is bound once, as the one
    element of an array; each pattern would otherwise make it again.
    """

    def severest(low: Column) -> Column:
        hits = [F.when(low.contains(p), F.struct(F.lit(T.SCRIPT_SEVERITIES.index(s)).alias("severity"), F.lit(-i).alias("order"), F.lit(c).alias("category"))) for i, (p, c, s) in enumerate(patterns)]
        return F.array_max(F.array_compact(F.array(*hits)))

    return _bound(F.lower(script), severest)


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with the value made once."""
    return F.get(F.transform(F.array(value), lambda x: use(x)), F.lit(0))


def script_severity(match: Column, language: Column, user: Column) -> Column:
    """Ordinal after enrichment; INFO where nothing matches."""
    base, category = F.coalesce(match["severity"], F.lit(1)), F.coalesce(match["category"], F.lit("NONE"))
    privileged = (user == "SYSTEM") | user.contains("ADMIN")
    high, critical = F.greatest(base, F.lit(4)), F.lit(5)
    return F.when(category.isin("AMSI_BYPASS", "RANSOMWARE"), critical).when((category == "REFLECTIVE_LOAD") & (language == "POWERSHELL"), high).when((category == "SUPPLY_CHAIN") & F.coalesce(privileged, F.lit(False)), high).otherwise(base)


def script_language(app: Column) -> Column:
    low = F.lower(app)
    return functools.reduce(lambda c, kv: c.when(low.contains(kv[0]), kv[1]), T.LANGUAGES, F.when(F.lit(False), "")).otherwise("UNKNOWN")


def should_log(severity: Column, pid: Column, app: Column, language: Column, is_dedup: Column, whitelist: Sequence[int] = (), blacklist: Sequence[str] = (), all_languages: bool = True, clean: bool = False, dedup_refs: bool = True, least: int = 2) -> Column:
    """The script log policy; the first condition that holds decides."""
    out = F.when(pid.isin(*whitelist) if whitelist else F.lit(False), True)
    out = out.when(contains_any(F.lower(app), [b.lower() for b in blacklist]), False)
    if not all_languages:
        out = out.when(language.isin("BATCH", "PYTHON"), False)
    if not clean:
        out = out.when(severity == 1, False)
    if not dedup_refs:
        out = out.when(is_dedup, False)
    return out.otherwise(severity >= least)


def pattern_hits(script: Column, patterns: Sequence[str] = T.HIT_PATTERNS) -> Column:
    return _bound(F.lower(script), lambda low: functools.reduce(lambda a, p: a + low.contains(p).cast("int"), patterns, F.lit(0)))


def script_flags(script: Column) -> dict[str, Column]:
    return {name: _bound(F.lower(script), functools.partial(contains_any, words=words)) for name, words in T.SCRIPT_FLAGS.items()}


def wmi_injection(script: Column) -> Column:
    low = F.lower(script)
    return low.contains("win32_process") & (low.contains("create") | low.contains("cmd"))


def under(path: Column, folders: Sequence[str]) -> Column:
    """Whether a lower-case path is a folder or in it; the folder ends at a separator."""
    low = [f.lower().rstrip("\\/") for f in folders]
    return any_of((path == f) | path.startswith(f + "\\") | path.startswith(f + "/") for f in low)


def location(path: Column, roots: Sequence[tuple[str, str]]) -> Column:
    """Trust of the longest root that the path starts with, else UNKNOWN."""
    longest = sorted(roots, key=lambda r: (-len(r[0]), r[0]))
    return functools.reduce(lambda c, r: c.when(F.lower(path).startswith(r[0].lower()), r[1]), longest, F.when(F.lit(False), "")).otherwise("UNKNOWN")


def file_route(path: Column, startup: Sequence[str], protected: Sequence[str], temp: Sequence[str]) -> Column:
    """A: startup, protected or executable; B: temporary; C: any other; DROP without a path."""
    low = F.lower(path)
    first = under(low, startup) | under(low, protected) | extension(path).isin(*T.EXECUTABLE_EXTENSIONS)
    return F.when(F.coalesce(path, F.lit("")) == "", "DROP").when(first, "A").when(under(low, temp), "B").otherwise("C")


def file_severity(action: Column, path: Column, process: Column, startup: Sequence[str], protected: Sequence[str], old_path: Column | None = None) -> Column:
    """Ordinal in FILE_SEVERITIES; the first rule that holds decides, and a move into a protected folder is WARNING at least."""
    low, ext, name = F.lower(path), extension(path), F.lower(process)
    is_protected, is_startup = under(low, protected), under(low, startup)
    executable, document = ext.isin(*T.EXECUTABLE_EXTENSIONS), ext.isin(*T.DOCUMENT_EXTENSIONS)
    scored = (
        F.when(is_startup, 3)
        .when(executable & is_protected & action.isin("create", "write", "rename", "delete"), 3)
        .when(is_protected & contains_any(name, T.SUSPICIOUS_PROCESSES), 3)
        .when(executable & action.isin("create", "write", "rename"), 2)
        .when(is_protected, 2)
        .when(document & action.isin("write", "delete") & contains_any(name, T.DOCUMENT_PROCESSES), 1)
        .when(ext.isin(*T.SCRIPT_EXTENSIONS), 1)
        .otherwise(0)
    )
    info = F.when(is_startup, 3).when(is_protected, 1).otherwise(0)
    out = F.when(action == "set_info", info).otherwise(scored)
    if old_path is not None:
        moved_in = (action == "rename") & is_protected & (F.coalesce(old_path, F.lit("")) != "") & ~under(F.lower(old_path), protected)
        fresh = (action == "rename") & is_protected & (F.coalesce(old_path, F.lit("")) == "")
        out = F.when(F.coalesce(moved_in | fresh, F.lit(False)), F.greatest(out, F.lit(2))).otherwise(out)
    return out


def forward_rules(row: dict[str, Column]) -> Column:
    """Bit mask of the rules that always forward a process event.

    row: location, path, signed, signer, name, new_child, dll_unknown,
    shadowing, new_relationship, new_process.  Without a path only bit 1 is
    set, in an unknown location only bit 0: later stages are skipped.
    """
    bit = lambda n, c: F.when(F.coalesce(c, F.lit(False)), 1 << n).otherwise(0)
    place = row["location"]
    known_signer = contains_any(F.lower(F.coalesce(row["signer"], F.lit(""))), T.SYSTEM_SIGNERS)
    later = (
        bit(2, ~row["signed"])
        + bit(3, row["signed"] & (place == "SYSTEM") & ~known_signer)
        + bit(4, F.lower(row["name"]).isin(*T.SYSTEM_EXECUTABLES) & (place != "SYSTEM"))
        + bit(5, row["new_child"])
        + bit(6, row["dll_unknown"])
        + bit(7, row["shadowing"])
        + bit(9, row["new_relationship"])
        + bit(10, row["new_process"])
    )
    return F.when(F.coalesce(row["path"], F.lit("")) == "", 2).when(place == "UNKNOWN", 1).otherwise(later)


def threat_score(abuse: Column, malicious: Column, suspicious: Column) -> Column:
    """0.6 of the abuse confidence, 12 and 4 for each vendor, halves rounded to even, 100 at most; missing answers count 0."""
    zero = F.lit(0)
    exact = F.coalesce(abuse, zero).cast("decimal(20,1)") * F.lit("0.6").cast("decimal(2,1)") + F.coalesce(malicious, zero) * 12 + F.coalesce(suspicious, zero) * 4
    return F.least(F.bround(exact, 0).cast("int"), F.lit(100))


def threat_label(score: Column) -> Column:
    return functools.reduce(lambda c, x: c.when(score >= x[0], x[1]), T.THREAT_LABELS, F.when(F.lit(False), "")).otherwise("CLEAN")
