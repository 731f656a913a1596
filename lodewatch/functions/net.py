"""Addresses, directions, states and application layers."""

from __future__ import annotations

import functools
import ipaddress
import operator
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodewatch.functions.tables import HTTP_STARTS, PORT_LAYERS, PRIVATE_NETWORKS, PUBLIC_EXCEPTIONS, SMTP_STARTS

_OCTET = "(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
IPV4 = rf"^{_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}$"


def any_of(conditions: Iterable[Column]) -> Column:
    return functools.reduce(operator.or_, conditions, F.lit(False))


def ipv4_number(ip: Column) -> Column:
    """The address as a number; null if it is no dotted quad without leading zeros."""
    value = F.aggregate(F.split(ip, r"\."), F.lit(0).cast("long"), lambda acc, x: acc * 256 + x.try_cast("long"))
    return F.when(ip.rlike(IPV4), value)


def is_public_ipv4(ip: Column) -> Column:
    """False for private, reserved, special and malformed addresses, and for nulls."""
    nets = [ipaddress.ip_network(x) for x in PRIVATE_NETWORKS]
    # The number is bound once; the tests of all networks would otherwise repeat how it is made.
    outside = F.exists(F.array(ipv4_number(ip)), lambda n: ~any_of(n.between(int(x.network_address), int(x.broadcast_address)) for x in nets))
    return F.coalesce(ip.isin(*PUBLIC_EXCEPTIONS) | outside, F.lit(False))


def dotted(number: Column) -> Column:
    """A host-order number as a dotted quad."""
    return F.concat_ws(".", *(F.shiftright(number, s).bitwiseAND(255).cast("string") for s in (24, 16, 8, 0)))


def is_loopback(ip: Column) -> Column:
    return ip.startswith("127.") | (ip == "::1")


def is_broadcast(ip: Column) -> Column:
    return ip.endswith(".255")


def direction(src_local: Column, dst_local: Column, v6: Column) -> Column:
    """OUTBOUND if the source is local and, for IPv4, the destination is not."""
    return F.when(src_local & (v6 | ~dst_local), "OUTBOUND").otherwise("INBOUND")


def tcp_state(flags: Column) -> Column:
    """From the flag bits FIN 1, SYN 2, RST 4, ACK 16."""
    syn, ack = flags.bitwiseAND(2) > 0, flags.bitwiseAND(16) > 0
    return F.when(syn & ~ack, "SYN_SENT").when(syn & ack, "SYN_RECEIVED").when(flags.bitwiseAND(5) > 0, "CLOSED").otherwise("ESTABLISHED")


def layer_by_port(remote: Column, local: Column) -> Column:
    """By the remote port, else by the local one, else UNKNOWN."""
    by = lambda port: functools.reduce(lambda c, kv: c.when(port == kv[0], kv[1]), PORT_LAYERS.items(), F.when(F.lit(False), ""))
    return F.coalesce(by(remote), by(local), F.lit("UNKNOWN"))


def layer_by_payload(payload: Column, remote: Column, local: Column) -> Column:
    """By the first bytes; null if they say nothing."""
    h = F.hex(F.substring(payload, 1, 8))
    n = F.octet_length(payload)
    begins = lambda texts: any_of(h.startswith(t.encode().hex().upper()) for t in texts)
    first = F.conv(F.substring(h, 1, 2), 16, 10).cast("int")
    return (
        F.when((n >= 5) & h.startswith("1603"), "HTTPS_TLS")
        .when((n >= 4) & begins(HTTP_STARTS), "HTTP")
        .when((n >= 5) & (first.bitwiseAND(0xC0) == 0xC0) & F.substring(h, 3, 8).isin("00000001", "FF000001"), "QUIC")
        .when((n >= 4) & begins(["SSH-"]), "SSH")
        .when((n >= 4) & begins(SMTP_STARTS), "SMTP")
        .when((n >= 4) & h.startswith("0300") & ((remote == 3389) | (local == 3389)), "RDP")
        .when((n >= 8) & h.startswith("00") & F.substring(h, 9, 8).isin("FF534D42", "FE534D42"), "SMB")
    )
