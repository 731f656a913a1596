"""Decoders of application-log records: XML text to content, summary, flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodewatch.functions.classify import contains_any, pattern_hits, script_flags, wmi_injection
from lodewatch.functions.text import deobfuscated, encoded_command, urls, xml_data, xml_field

# Fixed values. Lines of each source's content: label and field.
WMI_LINES = (("Query", "Query"), ("Consumer", "CONSUMER"), ("Filter", "FILTER"), ("Operation", "Operation"), ("Namespace", "NamespaceName"), ("User", "User"))
DEFENDER_LINES = (("Threat", "Threat Name"), ("Path", "Path"), ("Action", "Action"), ("Category", "Category"), ("Process", "Process Name"), ("Origin", "Origin"), ("User", "Detection User"))
SECURITY_LINES = (
    ("Account", "TargetUserName"), ("Domain", "TargetDomainName"), ("LogonType", "LogonType"), ("SourceIP", "IpAddress"), ("SourcePort", "IpPort"),
    ("Process", "ProcessName"), ("Privileges", "PrivilegeList"), ("SubStatus", "SubStatus"), ("Workstation", "WorkstationName"),
)
# Fixed values. Words that make a script's addresses worth listing.
NETWORK_WORDS = ("http", "downloadstr", "webrequest", "webclient")


def _first(*options: Column) -> Column:
    return F.coalesce(*(F.nullif(o, F.lit("")) for o in options), F.lit(""))


def _content(raw: Column, lines: tuple[tuple[str, str], ...]) -> Column:
    return F.concat(*(F.when(xml_data(raw, field) != "", F.concat(F.lit(f"{label}: "), xml_data(raw, field), F.lit("\n"))).otherwise("") for label, field in lines))


def decoded(logs: DataFrame) -> DataFrame:
    """Records (``source``, ``timestamp``, ``raw``) with event id, content, summary, hits, addresses and flags."""
    raw, source = F.col("raw"), F.col("source")
    shell, wmi = source.startswith("PowerShell"), source.startswith("WMI")
    defender, security = source == "WindowsDefender", source == "Security"
    get = lambda name: xml_data(raw, name)
    script = deobfuscated(_first(get("ScriptBlockText"), xml_field(raw, "ScriptBlockText"), raw))
    other = _first(get("Message"), get("Description"), F.substring(raw, 1, 200))
    content = F.when(shell, script).when(wmi, _content(raw, WMI_LINES)).when(defender, _content(raw, DEFENDER_LINES)).when(security, _content(raw, SECURITY_LINES)).otherwise(other)
    code = F.when(shell, "4104").when(defender, "1116").otherwise(xml_field(raw, "EventID"))
    out = logs.withColumns({"event_code": code, "script_content": content, "script_path": F.when(shell, get("Path")).otherwise("")})
    text, low = F.col("script_content"), F.lower("script_content")
    preview = F.concat(F.lit("Script: "), F.translate(F.substring(text, 1, 120), "\n\r", "  "), F.when(F.length(text) > 120, "...").otherwise(""))
    wmi_said = F.when((get("CONSUMER") != "") & (get("FILTER") != ""), F.concat(F.lit("WMI persistence binding — Consumer: "), get("CONSUMER"), F.lit(" | Filter: "), get("FILTER")))
    wmi_said = wmi_said.when(get("Query") != "", F.concat(F.lit("WMI query: "), F.substring(get("Query"), 1, 100))).otherwise(F.concat(F.lit("WMI operation: "), get("Operation")))
    account = get("TargetUserName")
    security_said = (
        F.when(F.col("event_code") == "4625", F.concat(F.lit("FAILED LOGON — Account: "), account, F.lit(" | Type: "), get("LogonType"), F.lit(" | From: "), get("IpAddress")))
        .when(F.col("event_code") == "4672", F.concat(F.lit("PRIVILEGE ESCALATION — Account: "), account, F.lit(" | Privileges: "), F.substring(get("PrivilegeList"), 1, 80)))
        .when(F.col("event_code") == "4688", F.concat(F.lit("PROCESS CREATED — "), get("ProcessName"), F.lit(" | Account: "), account))
        .otherwise(F.concat(F.lit("Security event "), "event_code", F.lit(" — Account: "), account))
    )
    defender_said = F.concat(F.lit("Defender: ["), _first(get("Threat Name"), get("ThreatName")), F.lit("] at "), get("Path"), F.lit(" | Action: "), get("Action"))
    said = F.when(shell, preview).when(wmi, wmi_said).when(defender, defender_said).when(security, security_said)
    said = said.when(source == "", "Unknown event").otherwise(F.concat(F.lit("Event from "), source, F.lit(" | ID: "), "event_code"))
    flags = script_flags(text)
    return out.withColumns({
        "summary": said,
        "pattern_hits": F.when(shell, pattern_hits(text)).otherwise(0),
        "encoded_decoded": F.when(shell, encoded_command(text)).otherwise(""),
        "network_activity": F.when(shell & contains_any(low, NETWORK_WORDS), urls(text)).otherwise(""),
        "credential_access": shell & flags["credential_access"],
        "amsi_bypass": shell & flags["amsi_bypass"],
        "process_injection": F.when(wmi, wmi_injection(text)).otherwise(shell & flags["process_injection"]),
    })
