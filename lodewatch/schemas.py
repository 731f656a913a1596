"""Explicit schemas of every input and output; nothing is ever inferred."""

from __future__ import annotations

from pyspark.sql.types import ArrayType, BooleanType, DoubleType, IntegerType, LongType, MapType, StringType, StructField, StructType, TimestampType

_TYPES = {"s": StringType(), "l": LongType(), "i": IntegerType(), "b": BooleanType(), "t": TimestampType(), "d": DoubleType(), "as": ArrayType(StringType()), "m": MapType(StringType(), IntegerType())}


def _schema(spec: str) -> StructType:
    """``name:type`` words; see _TYPES."""
    return StructType([StructField(n, _TYPES[t]) for n, t in (w.split(":") for w in spec.split())])


#: The event that all sources are normalized to; ``us`` is its time in microseconds, by which operators order.
UNIFIED = _schema(
    "event_id:s source_file:s source:s record_type:s ts:t us:l pid:l process_name:s canonical_path:s user_name:s user_sid:s src_ip:s dst_ip:s src_port:i dst_port:i "
    "protocol:s direction:s tcp_state:s ipv6:b script_content:s pattern_hits:i signature_valid:b location_type:s new_child_flag:b persistence_touched:b credential_access:b amsi_bypass:b process_injection:b host_id:s"
)
PROCESS = _schema(
    "ts:s event_type:s event_subtype:s pid:l process_name:s canonical_path:s location_type:s signature_valid:b parent_pid:l real_parent_pid:l image_path_raw:s command_line_raw:s cmdline_normalized:s parent_name:s "
    "parent_canonical_path:s signature_signer:s child_count:l thread_count:l duplicate_instances:l seen_count:l session_id:l unique_child_names:as dlls_new:as dlls_shadowing:as new_child_flag:b persistence_touched:b is_64bit:b "
    "fingerprint:s user_name:s user_sid:s elevation:s integrity:s process_start_time:s exit_time:s log_time:s repeat_count:l count:l repeat_label:s window_seconds:i host_id:s"
)
NETWORK = _schema(
    "ts:s event_type:s source:s record_type:s pid:l process_name:s src_ip:s dst_ip:s src_port:i dst_port:i protocol:s ipv6:b direction:s state:s bytes_sent:l bytes_recv:l packet_count:l flow_duration_ms:l is_broadcast:b is_loopback:b user_name:s user_sid:s canonical_path:s host_id:s"
)
LEGACY = _schema(
    "source:s record_type:s ts:s pid:l process_name:s canonical_path:s user_name:s user_sid:s local_addr:s remote_addr:s local_port:i remote_port:i protocol:s direction:s tcp_state:s ipv6:b signature_valid:b location_type:s new_child_flag:b persistence_touched:b host_id:s"
)
FILE = _schema("severity:s endpoint:s action:s path:s old_path:s pid:l tid:l process:s timestamp:s protected:b executable:b document:b write_count:i sha256:s host_id:s")
APPLOG = _schema("source:s event_id:s timestamp:s summary:s script_content:s script_path:s encoded_decoded:s network_activity:s pattern_hits:i credential_access:b amsi_bypass:b process_injection:b host_id:s")
SCRIPT = StructType(
    [
        *_schema("ts:s type:s endpoint:s source:s severity:s lang:s detection:s hash:s host_id:s").fields,
        StructField("details", _schema("app_name:s content_name:s encoded_content:s")),
        StructField("actor", _schema("pid:l user:s")),
    ]
)
USB = StructType(
    [
        *_schema("timestamp:s endpoint:s event_type:s session_id:s host_id:s").fields,
        StructField("device", _schema("vid:s pid:s serial:s manufacturer:s product:s instance_id:s device_path:s")),
        StructField("mount_point", StringType()),
        StructField("activity", _schema("reads:l writes:l deletes:l executes:l bytes_read:l bytes_written:l")),
        *_schema("file_extensions:m anomalies:as").fields,
        StructField("timing", _schema("duration_seconds:d idle_seconds:d")),
    ]
)
TEMP_SUMMARY = _schema("type:s directory:s creator_pid:l creator:s total_created:l total_deleted:l elevated_count:l duration_seconds:l timestamp:s")

#: An event of a document for threat scoring, whatever its shape.
THREAT_EVENT = _schema("dst_ip:s ip:s src_ip:s domain:s hostname:s url:s process_name:s process:s image:s record_type:s protocol:s dst_port:s direction:s first_ts:s")
