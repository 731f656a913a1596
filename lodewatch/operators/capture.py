"""What follows capture: event kinds, path and owner resolution, device sessions, packets, subscriptions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodewatch.operators.scan import last, running, total
from lodewatch.operators.stateful import latest

ORDER = ("us", "event_id")

# Fixed values. Kernel event ids and opcodes, directory watcher actions, event-log subscriptions.
PROCESS_KINDS = {1: "process_start", 2: "process_stop", 3: "process_snapshot", 5: "thread_create"}
FILE_ACTIONS = {12: "create", 30: "create", 13: "close", 14: "close", 15: "read", 16: "write", 17: "set_info", 18: "delete", 19: "rename"}
WATCHER_OPERATIONS = {1: "write", 3: "write", 2: "delete", 4: "rename"}
SUBSCRIBED_EVENTS = (4625, 4672, 4688, 1116, 1117, 1118)
SHELL_EVENT, WMI_EVENTS = 4104, (5859, 5861)
DEVICE_CLASSES = ("DiskDrive", "CDROM", "Volume")
ARP_PROTOCOL = 0xFE


def _by(code: Column, names: dict[int, str]) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for kv in names.items() for x in kv)), code.cast("int"))


def process_kind(code: Column) -> Column:
    """Null for other events."""
    return _by(code, PROCESS_KINDS)


def file_action(opcode: Column) -> Column:
    """An unknown opcode is a write."""
    return F.coalesce(_by(opcode, FILE_ACTIONS), F.lit("write"))


def watcher_operation(action: Column) -> Column:
    """Null for the new name of a rename, and others."""
    return _by(action, WATCHER_OPERATIONS)


def resolved_paths(events: DataFrame) -> DataFrame:
    """Fills ``path`` from the last one seen under the file key, which CLOSE (14) and DELETE (18) forget.

    events: ``file_key``, ``opcode``, ``path`` (null or empty: unknown).
    """
    own = F.nullif("path", F.lit(""))
    # What a row leaves behind: nothing under the key, its path, or what was there.
    left = F.when(F.col("opcode").isin(14, 18), F.struct(F.lit(None).cast("string").alias("path"))).when(own.isNotNull(), F.struct(own.alias("path")))
    return running(events, ["file_key"], {"left_": last(left, before=True)}).withColumn("path", F.coalesce(own, "left_.path", F.lit("unresolved"))).drop("left_")


def device_sessions(events: DataFrame) -> DataFrame:
    """Adds ``session``, the number of the device's session; rows outside a session are dropped.

    An arrival opens a session unless one is open, a removal closes it.
    events: ``device``, ``kind`` (arrival, removal or anything else).
    """
    mark = F.when(F.col("kind").isin("arrival", "removal"), F.col("kind"))
    marked = running(events, ["device"], {"last_": last(mark), "before_": last(mark, before=True)})
    opens = (F.col("kind") == "arrival") & (F.coalesce("before_", F.lit("removal")) == "removal")
    at = running(marked, ["device"], {"session": total(opens)})
    return at.where("last_ = 'arrival' or (kind = 'removal' and before_ = 'arrival')").drop("last_", "before_")


def subscribed(events: DataFrame) -> DataFrame:
    """The event-log codes (``code``) that are read; a plain predicate, pushed to the source."""
    return events.where(F.col("code").isin(*SUBSCRIBED_EVENTS))


def of_provider(events: DataFrame, provider: str, opcode: int | None = None) -> DataFrame:
    """events of one provider (``provider``), and of one opcode if given; without one, rows of opcode and id (``code``) 0 are headers and go."""
    own = events.where(F.lower("provider") == provider.lower())
    return own.where(F.col("opcode") == opcode) if opcode is not None else own.where("not (opcode = 0 and code = 0)")


def watched(events: DataFrame, watchlist: DataFrame) -> DataFrame:
    """Shell and WMI events, and others of processes whose name is on the list (``app_name``)."""
    own = ((F.col("source") == "PowerShell") & (F.col("code") == SHELL_EVENT)) | ((F.col("source") == "WMI") & F.col("code").isin(*WMI_EVENTS))
    names = watchlist.select(F.lower("app_name").alias("name_")).distinct().withColumn("on_", F.lit(True))
    joined = events.join(names, F.lower("process_name") == F.col("name_"), "left")
    return joined.where(own | F.coalesce("on_", F.lit(False))).drop("name_", "on_")


def storage_devices(devices: DataFrame) -> DataFrame:
    """F13"""
    return devices.where(F.col("class").isin(*DEVICE_CLASSES))


def owners(events: DataFrame, sockets: DataFrame, keys: Sequence[str] = ("local_ip", "local_port", "proto")) -> DataFrame:
    """Adds ``pid`` from the last snapshot of the socket's owner at or before the event; 0 if there is none.

    sockets: the keys, ``snapshot_us``, ``pid``.
    """
    found = latest(events.drop("pid"), sockets.withColumnRenamed("snapshot_us", "us"), keys, ["pid"])
    return found.withColumn("pid", F.coalesce("pid", F.lit(0)))


def with_hostnames(events: DataFrame, names: DataFrame, column: str = "dst_ip") -> DataFrame:
    """Adds ``hostname`` from the dimension of addresses (``ip``, ``hostname``); the address itself where it has no name."""
    known = names.groupBy(F.col("ip").alias(column)).agg(F.min("hostname").alias("hostname"))
    return events.drop("hostname").join(known, column, "left").withColumn("hostname", F.coalesce("hostname", column))


def packet_counters(frames: DataFrame, events: DataFrame, flows: DataFrame) -> DataFrame:
    """Frames received and dropped as no packet, flows made and ended (``closed``), events made (``is_noise`` apart)."""
    got = frames.agg(F.count("*").alias("packets_received"), F.count_if("parsed").alias("packets_validated"), F.count_if(~F.col("parsed")).alias("packets_dropped"))
    made = events.agg(F.count_if(~F.col("is_noise")).alias("events_generated"), F.count_if("is_noise").alias("noise_suppressed"))
    return got.join(flows.agg(F.count("*").alias("flows_created"), F.count_if("closed").alias("flows_expired"))).join(made)


def script_counters(events: DataFrame) -> DataFrame:
    """Scripts captured, logged, referred to as seen, and filtered; events: ``logged``, ``is_dedup``."""
    logged = F.col("logged")
    return events.agg(F.count("*").alias("captured"), F.count_if(logged).alias("logged"), F.count_if(logged & F.col("is_dedup")).alias("dedup"), F.count_if(~logged).alias("filtered"))


def _groups(address: Column) -> Column:
    """16 bytes as eight hexadecimal groups without leading zeros."""
    h = F.lower(F.hex(address))
    return F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.coalesce(F.nullif(F.regexp_replace(F.substr(h, i * 4 + 1, F.lit(4)), "^0+", ""), F.lit("")), F.lit("0")))


def ipv6_text(address: Column) -> Column:
    """16 bytes in canonical form: the longest run of two zero groups or more, the first of equals, is ``::``."""

    def short(whole: Column) -> Column:
        runs = F.transform(F.regexp_extract_all(whole, F.lit(":(?:0:){2,}"), F.lit(0)), lambda r, i: F.struct(F.length(r), -i, r.alias("run")))
        run = F.coalesce(F.array_max(runs)["run"], F.lit(""))
        at = F.instr(whole, run)
        cut = F.concat(F.substr(whole, F.lit(1), at - 1), F.lit("::"), F.substr(whole, at + F.length(run)))
        return F.regexp_replace(F.when(run == "", whole).otherwise(cut), "^:(?!:)|(?<!:):$", "")

    whole = F.concat(F.lit(":"), F.array_join(_groups(address), ":"), F.lit(":"))
    return F.get(F.transform(F.array(whole), short), F.lit(0))


def parsed_packets(packets: DataFrame) -> DataFrame:
    """Ethernet frames (``frame``) to ``version``, ``protocol``, addresses, ports, ``flags`` and ``payload``.

    What can't be parsed is dropped.  A VLAN tag is skipped; ARP has protocol
    0xFE.  Offsets are column arithmetic on the binary frame, so nothing leaves
    the JVM.
    """
    frame = F.col("frame")
    size = F.octet_length(frame)
    cut = lambda at, n: F.substr(frame, at + 1, F.lit(n))
    number = lambda at, n: F.conv(F.hex(cut(at, n)), 16, 10).cast("int")
    dotted = lambda at: F.concat_ws(".", *(number(at + i, 1).cast("string") for i in range(4)))
    tagged = (number(F.lit(12), 2) == 0x8100) & (size >= 18)
    out = packets.where(size >= 14).withColumn("at_", F.when(tagged, 18).otherwise(14))
    at = F.col("at_")
    out = out.withColumn("kind_", number(at - 2, 2))
    kind = F.col("kind_")
    arp, v4, v6 = (kind == 0x0806) & (size >= at + 28), (kind == 0x0800) & (size >= at + 20), (kind == 0x86DD) & (size >= at + 40)
    out = out.where(arp | v4 | v6)
    out = out.withColumns({
        "version": F.when(v6, 6).otherwise(4),
        "protocol": F.when(arp, ARP_PROTOCOL).when(v4, number(at + 9, 1)).otherwise(number(at + 6, 1)),
        "src_ip": F.when(arp, dotted(at + 14)).when(v4, dotted(at + 12)).otherwise(ipv6_text(cut(at + 8, 16))),
        "dst_ip": F.when(arp, dotted(at + 24)).when(v4, dotted(at + 16)).otherwise(ipv6_text(cut(at + 24, 16))),
        "body_": F.when(v4, at + number(at, 1).bitwiseAND(15) * 4).otherwise(at + 40),
    })
    body, protocol = F.col("body_"), F.col("protocol")
    ports = protocol.isin(6, 17) & (size >= body + 8)
    tcp = ports & (protocol == 6) & (size >= body + 20)
    begin = F.when(tcp, body + F.shiftright(number(body + 12, 1), 4) * 4).when(ports & (protocol == 17), body + 8).otherwise(body)
    found = {
        "src_port": F.when(ports, number(body, 2)).otherwise(0), "dst_port": F.when(ports, number(body + 2, 2)).otherwise(0), "flags": F.when(tcp, number(body + 13, 1)).otherwise(0),
        "payload": F.when(protocol == ARP_PROTOCOL, F.lit(b"")).otherwise(F.substr(frame, begin + 1, F.greatest(size - begin, F.lit(0)))),
    }
    return out.withColumns(found).drop("frame", "at_", "kind_", "body_")
