"""Addresses, codes, versions and interface scores as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that make an interface more or less likely to be the wanted cable.
GOOD_WORDS = ("enet", "realtek", "ax88179", "rtl815", "usb", "ethernet")
BAD_WORDS = ("wintun", "tap", "vpn", "hyper-v", "vethernet", "docker", "wsll", "wi-fi", "wifi", "wlan", "wireless", "bluetooth")
LOOPBACK_WORDS = ("loopback pseudo-interface", "adapter for loopback traffic", "npcap loopback", "teredo tunneling", "isatap")
LOOPBACK_DASHED = ("loopback-interface", "npf-loopback")
HOST_VIRTUAL_WORDS = ("km-test",)
RELAY_PORT = 47910


def ipv4(text: Column) -> Column:
    """A dotted quad as a bigint; null if it is none."""
    parts = F.split(text, r"\.")
    sound = text.rlike(r"^(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(\.(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)){3}$")
    number = sum((F.element_at(parts, i + 1).cast("bigint") * 256 ** (3 - i) for i in range(4)), F.lit(0))
    return F.when(sound, number)


def dotted(ip: Column) -> Column:
    return F.when(ip.isNotNull(), F.concat_ws(".", *(F.shiftright(ip, 24 - 8 * i).bitwiseAND(255).cast("string") for i in range(4))))


def ipv6_bits(text: Column) -> Column:
    """An IPv6 address as 128 binary digits; null if it is none. Embedded dotted quads are not read."""
    halves = F.split(text, "::", -1)
    groups = lambda x: F.when(x == "", F.array().cast("array<string>")).otherwise(F.split(x, ":"))
    left, right = groups(halves[0]), F.when(F.size(halves) > 1, groups(halves[1])).otherwise(F.array().cast("array<string>"))
    full = F.when(F.size(halves) > 1, F.concat(left, F.array_repeat(F.lit("0"), F.greatest(F.lit(8) - F.size(left) - F.size(right), F.lit(0))), right)).otherwise(left)
    bits = F.array_join(F.transform(full, lambda g: F.lpad(F.conv(g, 16, 2), 16, "0")), "")
    return F.when((F.size(halves) <= 2) & (F.size(full) == 8) & F.forall(full, lambda g: g.rlike("^[0-9A-Fa-f]{1,4}$")), bits)


def cidr_parts(text: Column) -> tuple[Column, Column]:
    """Address text and prefix length of an entry; a bare address has a full prefix."""
    address = F.split(text, "/")[0]
    full = F.when(address.contains(":"), 128).otherwise(32)
    given = F.split(text, "/")
    return address, F.when(F.size(given) == 1, full).when(F.size(given) == 2, given[1].try_cast("int"))


def in_cidr(ip: Column, cidr: Column) -> Column:
    """Whether an address is in a prefix; families never match each other, malformed entries match nothing."""
    address, prefix = cidr_parts(cidr)
    shift = (F.lit(32) - prefix).cast("int")
    v4 = prefix.between(0, 32) & (F.call_function("shiftright", ipv4(ip), shift) == F.call_function("shiftright", ipv4(address), shift))
    v6 = prefix.between(0, 128) & (F.substring(ipv6_bits(ip), F.lit(1), prefix) == F.substring(ipv6_bits(address), F.lit(1), prefix))
    return F.coalesce(F.when(address.contains(":"), v6).otherwise(v4), F.lit(False))


def is_link_local(ip: Column) -> Column:
    return F.shiftright(ipv4(ip), 16) == 169 * 256 + 254


def is_loopback(ip: Column) -> Column:
    return F.coalesce(F.shiftright(ipv4(ip), 24) == 127, ipv6_bits(ip) == "0" * 127 + "1", F.lit(False))


def is_usable_lan(ip: Column) -> Column:
    """Not loopback, unspecified, multicast, broadcast or link-local."""
    n = ipv4(ip)
    first = F.shiftright(n, 24)
    return n.isNotNull() & (first != 127) & (n != 0) & ~first.between(224, 239) & (n != 4294967295) & ~is_link_local(ip)


def slash24(ip: Column) -> Column:
    return F.shiftright(ip, 8)


def broadcast24(ip: Column) -> Column:
    return ip.bitwiseOR(255)


def ascii_lower(text: Column) -> Column:
    """Only A to Z change."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def pair_code(text: Column) -> Column:
    return F.upper(F.regexp_replace(text, r"\s", ""))


def pair_code_or(given: Column, generated: Column) -> Column:
    """The given code, else, where that is null or blank, a generated one."""
    return F.coalesce(F.nullif(pair_code(given), F.lit("")), generated)


def pair_code_in(text: Column) -> Column:
    """The first ``pair_code = "..."`` of a settings text that is not empty; null if there is none."""
    lines = F.transform(F.split(text, r"\r?\n"), lambda x: F.trim(x))
    values = F.transform(F.filter(lines, lambda x: x.startswith("pair_code")), lambda x: F.trim(F.regexp_replace(F.regexp_replace(F.trim(F.substring(x, 10, 1 << 30)), "^=+", ""), '^[ "]+|[ "]+$', "")))
    return F.get(F.filter(values, lambda x: x != ""), F.lit(0))


def relay_address(text: Column) -> Column:
    bare = F.regexp_replace(F.trim(text), "^(tcp|relay)://", "")
    return F.when(bare.contains(":"), bare).otherwise(F.concat(bare, F.lit(f":{RELAY_PORT}")))


def semver(text: Column) -> Column:
    """(major, minor, patch); null unless the first two are numbers. A patch keeps its leading digits, else it is 0."""
    parts = F.split(F.regexp_replace(F.trim(text), "^v+", ""), r"\.")
    major, minor = (F.when(F.get(parts, F.lit(i)).rlike("^[0-9]+$"), F.get(parts, F.lit(i)).try_cast("bigint")) for i in (0, 1))
    patch = F.coalesce(F.regexp_extract(F.coalesce(F.get(parts, F.lit(2)), F.lit("")), "^[0-9]+", 0).try_cast("bigint"), F.lit(0).cast("bigint"))
    return F.when(major.isNotNull() & minor.isNotNull(), F.struct(major.alias("major"), minor.alias("minor"), patch.alias("patch")))


def repo_slug(text: Column, host: str = "github.com") -> Column:
    """``owner/name`` from a URL on ``host`` or from a slug."""
    s = F.regexp_replace(F.trim(text), "/+$", "")
    found = F.regexp_extract(s, rf"{host.replace('.', '[.]')}/+([^/]+)/+([^/]+)", 1), F.regexp_replace(F.regexp_extract(s, rf"{host.replace('.', '[.]')}/+([^/]+)/+([^/]+)", 2), r"(\.git)+$", "")
    plain = s.rlike("^[^/]+/[^/]+$") & ~s.contains("://")
    return F.when((found[0] != "") & (found[1] != ""), F.concat_ws("/", *found)).when(~s.contains(f"{host}/") & plain, s)


def is_loopback_name(name: Column, description: Column) -> Column:
    blob = F.lower(F.concat_ws(" ", name, description))
    dashed = F.translate(blob, " _", "--")
    return _any(blob, LOOPBACK_WORDS) | _any(dashed, LOOPBACK_DASHED)


def is_host_virtual(name: Column, description: Column, words: tuple[str, ...] = HOST_VIRTUAL_WORDS) -> Column:
    return _any(F.lower(F.concat_ws(" ", name, description)), words)


def interface_score(name: Column, description: Column, is_up: Column, link_local: Column, preferred: str = "", virtual_words: tuple[str, ...] = HOST_VIRTUAL_WORDS) -> Column:
    """How likely an interface is the wanted cable; -1000 for excluded ones, among them names with one of ``virtual_words``."""
    lower = [F.lower(name), F.lower(description)]
    has = lambda word: (lower[0].contains(word) | lower[1].contains(word)).cast("int")
    score = sum((has(w) * 5 for w in GOOD_WORDS), F.lit(0)) - sum((has(w) * 80 for w in BAD_WORDS), F.lit(0)) + link_local.cast("int") * 50 + is_up.cast("int") * 10
    if preferred:
        score += (lower[0] == preferred.lower()).cast("int") * 100
    return F.when(is_loopback_name(name, description) | is_host_virtual(name, description, virtual_words), F.lit(-1000)).otherwise(score)


def _any(blob: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for word in words:
        out = out | blob.contains(word)
    return out
