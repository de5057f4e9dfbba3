"""Scalar functions on addresses, flags and rates, all as Columns (no Python per row)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ip_text(ip: Column) -> Column:
    return F.concat_ws(".", *[F.shiftright(ip, s).bitwiseAND(255).cast("string") for s in (24, 16, 8, 0)])


def ip_number(text: Column) -> Column:
    """Four octets 0..255, else null."""
    parts = F.split(text, r"\.", -1)
    octets = [F.element_at(parts, i).try_cast("long") for i in (1, 2, 3, 4)]
    ok = is_v4_host(text)
    return F.when(ok, octets[0] * 16777216 + octets[1] * 65536 + octets[2] * 256 + octets[3])


def netmask(length: Column) -> Column:
    return F.when(length == 0, F.lit(0).cast("long")).otherwise(F.lit(4294967296) - F.pow(F.lit(2.0), 32 - length).cast("long"))


def network_of(ip: Column, length: Column | int) -> Column:
    size = F.pow(F.lit(2.0), 32 - (F.lit(length) if isinstance(length, int) else length)).cast("long")
    return ip - ip % size


def cidr_text(net: Column, length: Column) -> Column:
    return F.concat(ip_text(net), F.lit("/"), length.cast("string"))


_OCTET = "(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"


def is_v4_host(text: Column) -> Column:
    return text.rlike(rf"^({_OCTET}\.){{3}}{_OCTET}$")


def is_cidr(text: Column) -> Column:
    return text.rlike(rf"^({_OCTET}\.){{3}}{_OCTET}/(3[0-2]|[12]?[0-9])$")


def tcp_flags_text(flags: Column) -> Column:
    names = [F.when(flags.bitwiseAND(b) != 0, F.lit(n)) for n, b in (("fin", 1), ("syn", 2), ("rst", 4), ("psh", 8), ("ack", 16), ("urg", 32))]
    text = F.concat_ws(",", *names)
    return F.when(text == "", F.lit("-")).otherwise(text)


def mbps(bytes_per_second: Column) -> Column:
    return (bytes_per_second / 1000 / 1000 * 8).cast("long")


def protocol_text(number: Column) -> Column:
    return F.when(number == 6, "tcp").when(number == 17, "udp").when(number == 1, "icmp").otherwise("unknown")


def forwarding_text(code: Column) -> Column:
    return F.when(code == 1, "forwarded").when(code == 2, "dropped").when(code == 3, "consumed").otherwise("unknown")


def bit(value: Column, number: int) -> Column:
    """Bit by its number from 1."""
    return F.shiftright(value, number - 1).bitwiseAND(1)


def set_bit(value: Column, number: int) -> Column:
    return value.bitwiseOR(F.lit(1 << (number - 1)))


def clear_bit(value: Column, number: int) -> Column:
    return value.bitwiseAND(~(1 << (number - 1)))


def v6_hex(text: Column) -> Column:
    """A v6 address as 32 hex digits; null where it is none. One '::' at most, groups of up to four digits, a dotted end allowed."""
    low = F.lower(F.trim(text))
    dotted = F.regexp_extract(low, rf":(({_OCTET}\.){{3}}{_OCTET})$", 1)
    v4 = ip_number(dotted)
    group = lambda shift: F.lower(F.hex(F.shiftright(v4, shift).bitwiseAND(65535)))
    low = F.when(dotted == "", low).otherwise(F.concat(F.substring(low, F.lit(1), F.length(low) - F.length(dotted)), group(16), F.lit(":"), group(0)))
    well = low.rlike("^[0-9a-f:]+$") & ~low.rlike("[0-9a-f]{5}|:::|::.*::|^:[^:]|[^:]:$")
    parts = lambda s: F.when(s == "", F.array().cast("array<string>")).otherwise(F.split(s, ":", -1))
    short = F.instr(low, "::") > 0
    head, tail = parts(F.substring_index(low, "::", 1)), F.when(short, parts(F.substring_index(low, "::", -1))).otherwise(F.array().cast("array<string>"))
    missing = 8 - F.size(head) - F.size(tail)
    groups = F.concat(head, F.array_repeat(F.lit("0"), F.greatest(missing, F.lit(0))), tail)
    fits = F.when(short, missing >= 1).otherwise(missing == 0)
    return F.when(well & fits, F.array_join(F.transform(groups, lambda g: F.lpad(g, 4, "0")), ""))


def is_v6_host(text: Column) -> Column:
    return v6_hex(text).isNotNull()


def is_zero_v6(hex32: Column) -> Column:
    return hex32 == "0" * 32


def v6_prefix(text: Column) -> Column:
    """'addr/len' as (net, len) with the bits after len cleared, else null."""
    length = F.regexp_extract(text, "^[^/]+/([0-9]{1,3})$", 1).try_cast("int")
    masked = F.concat(*[F.lpad(F.lower(F.hex(masked_part(p, length, i))), 8, "0") for i, p in enumerate(v6_parts(v6_hex(F.substring_index(text, "/", 1))))])
    return F.when((length <= 128) & masked.isNotNull(), F.struct(masked.alias("net"), length.alias("len")))


def v6_parts(hex32: Column) -> list[Column]:
    """Four numbers of 32 bits each."""
    return [F.conv(F.substring(hex32, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def masked_part(part: Column, length: Column | int, index: int) -> Column:
    """The index-th part of an address with the bits after length cleared."""
    free = F.greatest(F.lit(0), F.least(F.lit(32), 32 * (index + 1) - (F.lit(length) if isinstance(length, int) else length)))
    size = F.pow(F.lit(2.0), free).cast("long")
    return part - part % size


def v6_text(hex32: Column) -> Column:
    """Eight groups; the first run of two or more zero groups becomes one colon."""
    full = F.regexp_replace(hex32, "(.{4})(?!$)", "$1:")
    first = F.regexp_extract(full, "(0000:){2,}", 0)
    at = F.instr(full, first)
    return F.when(first == "", full).otherwise(F.concat(F.substring(full, F.lit(1), at - 1), F.lit(":"), F.substring(full, at + F.length(first), F.lit(64))))


def parse_community(text: Column) -> Column:
    """'a:b' with both parts 0..65535, else null."""
    parts = F.split(text, ":", -1)
    a, b = F.element_at(parts, 1).try_cast("int"), F.try_element_at(parts, F.lit(2)).try_cast("int")
    return F.when(text.rlike("^[0-9]{1,5}:[0-9]{1,5}$") & (a <= 65535) & (b <= 65535), F.struct(a.alias("asn"), b.alias("number")))


#: Names of the IP protocols 0 to 143. Those up to 252 are unassigned, 253 and 254 unknown, 255 is reserved.
PROTOCOL_NAMES = """
HOPOPT ICMP IGMP GGP IPV4 ST TCP CBT EGP IGP BBN_RCC_MON NVP_II PUP ARGUS_DEPRECATED EMCON XNET CHAOS UDP MUX DCN_MEAS
HMP PRM XNS_IDP TRUNK_1 TRUNK_2 LEAF_1 LEAF_2 RDP IRTP ISO_TP4 NETBLT MFE_NSP MERIT_INP DCCP THREEPC IDPR XTP DDP IDPR_CMTP TPPPPP
IL IPV6 SDRP IPV6_ROUTE IPV6_FRAG IDRP RSVP GRE DSR BNA ESP AH I_NLSP SWIPE_DEPRECATED NARP MOBILE TLSP SKIP IPV6_ICMP IPV6_NONXT
IPV6_OPTS UNKNOWN_61 CFTP UNKNOWN_63 SAT_EXPAK KRYPTOLAN RVD IPPC UNKNOWN_68 SAT_MON VISA IPCV CPNX CPHB WSN PVP BR_SAT_MON SUN_ND WB_MON WB_EXPAK
ISO_IP VMTP SECURE_VMTP VINES IPTM_OR_TTP NSFNET_IGP DGP TCF EIGRP OSPFIGP SPRITE_RPC LARP MTP AX_25 IPIP MICP_DEPRECATED SCC_SP ETHERIP ENCAP UNKNOWN_99
GMTP IFMP PNNI PIM ARIS SCPS QNX A_N IPCOMP SNP COMPAQ_PEER IPX_IN_IP VRRP PGM UNKNOWN_114 L2TP DDX IATP STP SRP
UTI SMP SM_DEPRECATED PTP ISISOVERIPV4 FIRE CRTP CRUDP SSCOPMCE IPLT SPS PIPE SCTP FC RSVP_E2E_IGNORE MOBILITYHEADER UDPLITE MPLS_IN_IP MANET HIP
SHIM6 WESP ROHC ETHERNET
""".split()


def protocol_name(number: Column) -> Column:
    """Registered name of a protocol number from 0 to 255, else null."""
    named = F.try_element_at(F.split(F.lit(" ".join(PROTOCOL_NAMES)), " "), number.cast("int") + 1)
    rest = F.when(number == 255, F.lit("RESERVED")).when(number >= 253, F.concat(F.lit("UNKNOWN_"), number.cast("string"))).otherwise(F.concat(F.lit("UNASSIGNED_"), number.cast("string")))
    return F.when((number >= 0) & (number <= 255), F.when(number < len(PROTOCOL_NAMES), named).otherwise(rest))


def hex_number(text: Column) -> Column:
    """Up to 15 hex digits, with or without 0x, as a number; else null."""
    digits = F.regexp_replace(F.lower(text), "^0x", "")
    return F.when(digits.rlike("^[0-9a-f]{1,15}$"), F.conv(digits, 16, 10).cast("long"))


def time_text(at: Column) -> Column:
    return F.date_format(at, "yyyy-MM-dd HH:mm:ss.SSSSSS")


def compact_time(at: Column) -> Column:
    """As used in names of files and keys."""
    return F.date_format(at, "dd_MM_yy_HH:mm:ss")


def whole_number(text: str) -> int | None:
    """A setting's value as a whole number, else None."""
    text = text.strip()
    return int(text) if text.lstrip("+-").isdigit() else None


def split_url(url: str) -> tuple[str, str, int, str] | None:
    """(scheme, host, port, path) of an http or https address, with the scheme's own port where none is given; else None."""
    from urllib.parse import urlsplit

    try:
        parts = urlsplit(url)
        if parts.scheme not in ("http", "https") or not parts.hostname:
            return None
        return parts.scheme, parts.hostname, parts.port or (443 if parts.scheme == "https" else 80), parts.path or "/"
    except ValueError:
        return None
