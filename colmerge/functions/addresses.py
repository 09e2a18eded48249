"""Network addresses in path form (``/ip4/1.2.3.4/tcp/80/p2p/peer``): class, score, port, peer. Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

DROP, PRIVATE, PUBLIC = "drop", "private", "public"


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once, however often ``f`` names it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def ip4_class(ip: Column) -> Column:
    """Loopback, unspecified, multicast, link-local, broadcast, documentation and container ranges are dropped."""

    def told(octets: Column) -> Column:
        a, b = octets[0], octets[1]
        documentation = F.array_join(F.slice(octets.cast("array<string>"), 1, 3), ".").isin("192.0.2", "198.51.100", "203.0.113")
        drop = (a == 127) | a.between(224, 239) | ip.isin("0.0.0.0", "255.255.255.255") | ((a == 169) & (b == 254)) | documentation | ((a == 172) & b.between(16, 31))
        return F.when(drop, DROP).when((a == 10) | ((a == 192) & (b == 168)), PRIVATE).otherwise(PUBLIC)

    return let(F.transform(F.split(ip, r"\."), lambda x: x.try_cast("int")), told)


def ip6_class(ip: Column) -> Column:
    """Loopback, unspecified, multicast (ff00::/8) and link-local (fe80::/10) are dropped; fc00::/7 is private."""
    group = F.split_part(ip, F.lit(":"), F.lit(1))

    def told(first: Column) -> Column:
        drop = ip.isin("::", "::1") | (first >= 0xFF00) | first.between(0xFE80, 0xFEBF)
        return F.when(drop, DROP).when(first.between(0xFC00, 0xFDFF), PRIVATE).otherwise(PUBLIC)

    return let(F.coalesce(F.conv(F.nullif(group, F.lit("")), 16, 10).cast("int"), F.lit(0)), told)


def address_class(address: Column) -> Column:
    """The class of the first IP part; an address by name is public."""
    first = F.struct(F.regexp_extract(address, r"/(ip4|ip6)/([^/]+)", 1).alias("family"), F.regexp_extract(address, r"/(ip4|ip6)/([^/]+)", 2).alias("ip"))
    return let(first, lambda a: F.when(a["family"] == "ip4", ip4_class(a["ip"])).when(a["family"] == "ip6", ip6_class(a["ip"])).otherwise(PUBLIC))


def address_score(address: Column) -> Column:
    """4: web socket through a relay, 3: relay, 2: web socket, 1: other."""
    ws, relay = address.rlike("/wss?(/|$)"), address.rlike("/p2p-circuit(/|$)")
    return F.when(ws & relay, 4).when(relay, 3).when(ws, 2).otherwise(1).cast("long")


def tcp_port(address: Column) -> Column:
    return F.regexp_extract(address, r"/tcp/([0-9]+)", 1).try_cast("int")


def last_peer(address: Column) -> Column:
    """The last peer of the path, or null."""
    return F.try_element_at(F.regexp_extract_all(address, F.lit(r"/p2p/([^/]+)"), F.lit(1)), F.lit(-1))


def with_peer(address: Column, peer: Column) -> Column:
    """The address ending in the peer, once."""
    return F.when(F.endswith(address, F.concat(F.lit("/p2p/"), peer)), address).otherwise(F.concat(address, F.lit("/p2p/"), peer))


def tier(address: Column) -> Column:
    """Order in which addresses are offered: 0 private, 1 public, 2 through a relay; null if dropped."""
    return F.when(address.rlike("/p2p-circuit(/|$)"), 2).otherwise(let(address_class(address), lambda c: F.when(c == PRIVATE, 0).when(c == PUBLIC, 1)))
