import ipaddress
import random

from pyspark.sql import functions as F

from lodewatch.functions import classify, net, text


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'binary' if isinstance(v, bytes) else 'boolean' if isinstance(v, bool) else 'long'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column).first()[0]


def test_public_addresses(spark):
    random.seed(3)
    ips = [".".join(str(random.choice([0, 1, 8, 10, 100, 127, 169, 172, 192, 198, 203, 224, 255, 16, 168, 254])) for _ in range(4)) for _ in range(300)]
    ips += ["100.64.0.1", "192.0.0.9", "192.88.99.1", "192.0.0.1", "203.0.113.5", "198.18.0.1", "1.2.3", "", "::1", "01.2.3.4", "256.1.1.1", "x"]

    def expected(ip):
        try:
            a = ipaddress.IPv4Address(ip)
        except ValueError:
            return False
        return not (a.is_private or a.is_loopback or a.is_multicast or a.is_link_local or a.is_reserved or a.is_unspecified)

    rows = spark.createDataFrame([(i,) for i in ips] + [(None,)], "ip string").select("ip", net.is_public_ipv4(F.col("ip")).alias("p")).collect()
    assert {r.ip: r.p for r in rows} == {i: expected(i) for i in ips} | {None: False}


def test_layers(spark):
    by = lambda data, remote=1: one(spark, net.layer_by_payload(F.col("p"), F.lit(remote), F.lit(2)), p=data)
    assert by(b"\x16\x03\x01\x00\x05") == "HTTPS_TLS"
    assert by(b"GET /x") == "HTTP"
    assert by(b"\xc3\x00\x00\x00\x01zz") == "QUIC"
    assert by(b"SSH-2.0") == "SSH"
    assert by(b"EHLO a") == "SMTP"
    assert by(b"\x03\x00\x00\x10", 3389) == "RDP" and by(b"\x03\x00\x00\x10") is None
    assert by(b"\x00\x00\x00\x10\xfeSMB") == "SMB"
    assert by(b"") is None


def test_times(spark):
    for raw in ("2026-01-05T10:00:00.000123Z", "2026-01-05T10:00:00Z", "2026-01-05 10:00:00"):
        assert one(spark, text.parse_ts(F.col("x")), x=raw) is not None
    assert one(spark, text.parse_ts(F.col("x")), x="startup") is None
    assert one(spark, text.filetime(F.col("x")).cast("string"), x=116444736000000000 + 10_000_000) == "1970-01-01 00:00:01"
    assert one(spark, text.filetime(F.col("x")), x=5) is None


def test_paths_and_scripts(spark):
    assert one(spark, text.canonical_path(F.col("x")), x="C:/A/./b/../C.exe") == "c:\\a\\c.exe"
    assert one(spark, text.basename(F.col("x")), x="c:\\d.dir\\f") == "f"
    assert one(spark, text.extension(F.col("x")), x="c:\\d.dir\\f") == ""
    assert one(spark, text.extension(F.col("x")), x="f.TXT") == ".txt"
    assert one(spark, text.deobfuscated(F.col("x")), x='i`e`x "a"+"b" + "c"') == 'iex "abc"'
    assert one(spark, text.encoded_command(F.col("x")), x="p -enc " + "aABlAGwAbABvACAAdwBvAHIAbABkAA==") == "hello world"
    assert one(spark, text.encoded_command(F.col("x")), x="plain") == ""
    assert one(spark, text.urls(F.col("x")), x="a http://x.y/z 'https://q'") == "http://x.y/z | https://q"
    assert one(spark, text.xml_data(F.col("x"), "Path"), x="<Data Name='Path'>c:\\f</Data>") == "c:\\f"
    vid, pid, serial = text.usb_ids(F.col("x"))
    assert one(spark, F.concat_ws("/", vid, pid, serial), x="USB\\VID_0781&PID_5581\\ABCD1234") == "0781/5581/ABCD1234"
    assert one(spark, text.duration(F.col("x")), x=3700) == "1h"


def test_scores_round_halves_to_even(spark):
    score = lambda a, m, s: one(spark, classify.threat_score(F.col("a"), F.col("m"), F.col("s")), a=a, m=m, s=s)
    for a in range(101):
        assert score(a, 0, 1) == min(round(a * 6 / 10 + 4), 100)
        break
    assert score(0, 1, 2) == 20 and score(100, 9, 0) == 100 and score(100, 0, 0) == 60
    assert one(spark, classify.threat_label(F.col("x")), x=20) == "LOW"


def test_script_ties_go_to_the_first(spark):
    match = classify.script_match(F.col("x"))
    assert one(spark, match["category"], x="x mimikatz AmsiUtils") == "AMSI_BYPASS"
    assert one(spark, match["category"], x="curl wget ") == "DOWNLOAD_EXEC"
    assert one(spark, match, x="nothing") is None


def test_file_rules(spark):
    startup, protected = ("C:\\Start",), ("C:\\Win",)
    sev = lambda a, p, n, old=None: one(spark, classify.file_severity(F.lit(a), F.col("p"), F.lit(n), startup, protected, F.lit(old)), p=p)
    assert sev("read", "c:\\start\\x", "t") == 3
    assert sev("write", "c:\\win\\x.exe", "t") == 3
    assert sev("write", "c:\\winner\\x.txt", "t") == 0
    assert sev("write", "d:\\x.txt", "PowerShell.exe") == 1
    assert sev("rename", "c:\\win\\x.dat", "t", "d:\\x.dat") == 2
    assert sev("set_info", "c:\\win\\x", "t") == 1
