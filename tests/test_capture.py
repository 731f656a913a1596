import struct

import pytest
from pyspark.sql import functions as F

from lodewatch.config import ScriptPolicy
from lodewatch.functions.decode import decoded
from lodewatch.operators import capture, enrich


def tcp(flags=2, body=b"GET /"):
    ip = bytes([0x45, 0, 0, 0, 0, 0, 0, 0, 64, 6, 0, 0, 10, 0, 0, 5, 8, 8, 8, 8])
    return b"\0" * 12 + b"\x08\x00" + ip + struct.pack("!HHIIBBHHH", 50000, 80, 0, 0, 5 << 4, flags, 0, 0, 0) + body


def test_packets(spark):
    v6 = b"\0" * 12 + b"\x86\xdd" + bytes([0x60, 0, 0, 0, 0, 0, 17, 64]) + b"\0" * 15 + b"\1" + b"\0" * 15 + b"\2" + struct.pack("!HHHH", 53, 5353, 0, 0) + b"q"
    arp = b"\0" * 12 + b"\x08\x06" + b"\0" * 14 + bytes([10, 0, 0, 1]) + b"\0" * 6 + bytes([10, 0, 0, 2])
    rows = [(1, tcp()), (2, v6), (3, arp), (4, b"short"), (5, None)]
    got = {r.n: r for r in capture.parsed_packets(spark.createDataFrame(rows, "n long, frame binary")).collect()}
    assert set(got) == {1, 2, 3}
    assert (got[1].src_ip, got[1].dst_port, got[1].flags, bytes(got[1].payload)) == ("10.0.0.5", 80, 2, b"GET /")
    assert (got[2].src_ip, got[2].dst_ip, got[2].src_port, bytes(got[2].payload)) == ("::1", "::2", 53, b"q")
    assert (got[3].protocol, got[3].dst_ip) == (0xFE, "10.0.0.2")


def test_decoders(spark):
    data = lambda **kv: "".join(f"<Data Name='{k.replace('_', ' ')}'>{v}</Data>" for k, v in kv.items())
    rows = [
        ("PowerShell", data(ScriptBlockText='ie`x ("a"+"b") AmsiUtils http://h.x/p', Path="c:\\s.ps1")), ("WMI", "<EventID>5861</EventID>" + data(CONSUMER="c", FILTER="f", Query="win32_process create")),
        ("Security", "<EventID>4625</EventID>" + data(TargetUserName="bob", LogonType="3", IpAddress="1.2.3.4")), ("WindowsDefender", data(Threat_Name="T", Path="p", Action="Q")), ("App", "plain text"), ("", ""),
    ]
    got = {r.source: r for r in decoded(spark.createDataFrame(rows, "source string, raw string")).collect()}
    shell = got["PowerShell"]
    assert shell.script_content == 'iex ("ab") AmsiUtils http://h.x/p' and shell.amsi_bypass and shell.network_activity == "http://h.x/p" and shell.event_code == "4104"
    assert got["WMI"].process_injection and got["WMI"].summary == "WMI persistence binding — Consumer: c | Filter: f"
    assert got["Security"].summary == "FAILED LOGON — Account: bob | Type: 3 | From: 1.2.3.4"
    assert got["WindowsDefender"].summary == "Defender: [T] at p | Action: Q"
    assert got["App"].script_content == "plain text" and got[""].summary == "Unknown event"


def test_dimensions(spark):
    events = spark.createDataFrame([("c:\\a.exe", ["x\\ntdll.dll", "c:\\sys\\ntdll.dll"], ["c:\\sys\\ok.exe"]), ("c:\\b.exe", None, ["d:\\odd.exe"])], "canonical_path string, dlls array<string>, children array<string>")
    known = spark.createDataFrame([("c:\\a.exe", True, "S", "T")], "canonical_path string, valid boolean, signer string, thumbprint string")
    roots = [("c:\\sys\\", "SYSTEM")]
    out = enrich.signed(events, known).select("canonical_path", "signature_valid", enrich.shadowing(F.col("dlls"), ["NTDLL.dll"], ["C:\\Sys\\"]).alias("s"), enrich.new_child(F.col("children"), roots).alias("n"))
    assert {tuple(map(str, r)) for r in out.collect()} == {("c:\\a.exe", "True", "['x\\\\ntdll.dll']", "False"), ("c:\\b.exe", "False", "[]", "True")}
    expanded = enrich.canonical_variables(F.lit("%programfiles(x86)%\\t"), {"ProgramFiles(x86)": "c:\\p$"})
    assert spark.range(1).select(expanded).first()[0] == "c:\\p$\\t"


def test_watchlist_and_subscriptions(spark):
    events = spark.createDataFrame([("PowerShell", 4104, "x"), ("WMI", 1, "x"), ("App", 1, "Tool.EXE")], "source string, code int, process_name string")
    assert {r.source for r in capture.watched(events, spark.createDataFrame([("tool.exe",)], "app_name string")).collect()} == {"PowerShell", "App"}
    assert capture.subscribed(spark.createDataFrame([("a", 4625), ("b", 1)], "event_id string, code int")).count() == 1


def test_verdicts_and_rerouting(spark):
    groups = spark.createDataFrame([(1, ["PowerShell.exe"], "Low"), (2, ["a"], "Medium"), (3, ["a"], None)], "component long, processes array<string>, risk_level string")
    got = {r.component: r.threat_level for r in enrich.verdicts(groups).collect()}
    assert got[1] == "CRITICAL" and got[2] in ("Medium", "Above Medium", "High") and got[3] in ("Low", "Medium", "Above Medium")
    events = spark.createDataFrame([("d", 5, "C"), ("d", 5, "A"), ("e", 5, "C")], "directory string, us long, route string")
    busy = spark.createDataFrame([("d", 0)], "directory string, window_us long")
    assert sorted(r.route for r in enrich.rerouted(events, busy, 10).collect()) == ["A", "B", "C"]


def test_policy():
    p = ScriptPolicy.parsed('{"filter": {"min_severity": "HIGH", "proc_blacklist": ["a.exe"], "other": 1}}')
    assert p.arguments() == {"whitelist": (), "blacklist": ("a.exe",), "all_languages": True, "clean": False, "dedup_refs": True, "least": 4}
    with pytest.raises(ValueError):
        ScriptPolicy.parsed('{"min_severity": "X"}')
