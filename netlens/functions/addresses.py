"""Column functions on addresses. A key is a byte 4 or 6 and then the octets, so keys sort by family, then address."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def key_of_v4(number: Column) -> Column:
    """Key of an IPv4 address given as an unsigned number."""
    return F.unhex(F.concat(F.lit("04"), F.lpad(F.hex(number.cast("long")), 8, "0")))


def number_of_v4(key: Column) -> Column:
    """Unsigned number of an IPv4 key; null for IPv6."""
    return F.when(is_v4(key), F.conv(F.substring(F.hex(key), 3, 8), 16, 10).cast("long"))


def is_v4(key: Column) -> Column:
    return F.length(key) == 5


def text_of_v4(number: Column) -> Column:
    octet = lambda n: F.shiftright(number.cast("long"), n).bitwiseAND(F.lit(255).cast("long")).cast("string")
    return F.concat_ws(".", octet(24), octet(16), octet(8), octet(0))


def text_of_key(key: Column) -> Column:
    """An address as text: dotted, or hexadecimal groups with the first of the longest runs of zeros left out."""
    digits = F.hex(key)
    v4 = F.transform(F.array(F.conv(F.substring(digits, 3, 8), 16, 10).cast("long")), text_of_v4)[0]  # converted once, not for each octet
    groups = [
        F.coalesce(F.nullif(F.ltrim(F.lower(F.substring(digits, 3 + 4 * k, 4)), F.lit("0")), F.lit("")), F.lit("0"))
        for k in range(8)
    ]
    whole = F.concat_ws(":", *groups)

    def shortened(text: Column) -> Column:
        out = text
        for n in range(2, 9):
            run = f"^(.*?)(?:^|:)0(?::0){{{n - 1}}}(?:$|:)(.*)$"
            out = F.when(text.rlike(run), F.regexp_replace(text, run, "$1::$2")).otherwise(out)
        return out

    mapped = F.concat(F.lit("::ffff:"), text_of_v4(F.conv(F.substring(digits, 27, 8), 16, 10)))
    v6 = F.when(digits.startswith("06" + "0" * 20 + "FFFF"), mapped).otherwise(F.transform(F.array(whole), shortened)[0])
    return F.when(is_v4(key), v4).otherwise(v6)


# Private and local IPv4 ranges (first, last) and IPv6 prefixes as hex after the family byte.
PRIVATE_V4 = (
    ("10.0.0.0", "10.255.255.255"),
    ("172.16.0.0", "172.31.255.255"),
    ("192.168.0.0", "192.168.255.255"),
    ("127.0.0.0", "127.255.255.255"),
    ("169.254.0.0", "169.254.255.255"),
    ("255.255.255.255", "255.255.255.255"),
    ("0.0.0.0", "0.0.0.0"),
)
LOOPBACK_V6, UNSPECIFIED_V6 = "0" * 31 + "1", "0" * 32


def _number(text: str) -> int:
    return int.from_bytes(bytes(map(int, text.split("."))), "big")


def is_private(key: Column) -> Column:
    """Private, loopback, link-local, broadcast or unspecified; neither shared (100.64/10) nor multicast."""
    n = number_of_v4(key)
    v4 = F.lit(False)
    for first, last in PRIVATE_V4:
        v4 = v4 | n.between(_number(first), _number(last))
    v6 = F.substring(F.hex(key), 3, 32)
    lead = F.conv(F.substring(v6, 1, 4), 16, 10).cast("int")
    unique, link = lead.bitwiseAND(F.lit(0xFE00)) == 0xFC00, lead.bitwiseAND(F.lit(0xFFC0)) == 0xFE80
    return F.when(is_v4(key), v4).otherwise(v6.isin(LOOPBACK_V6, UNSPECIFIED_V6) | unique | link)


def prefix_of(key: Column, bits: Column) -> Column:
    """The first ``bits`` bits of a key's octets, filled up to a whole byte with zeros, behind the family byte."""
    whole, rest = F.floor(bits / 8).cast("int"), (bits % 8).cast("int")
    octet = F.conv(F.hex(F.substring(key, whole + 2, F.lit(1))), 16, 10).cast("int")
    mask = F.lit(256) - F.call_function("shiftleft", F.lit(1), 8 - rest)
    part = F.unhex(F.lpad(F.hex(octet.bitwiseAND(mask).cast("long")), 2, "0"))
    lead = F.substring(key, F.lit(1), whole + 1)
    return F.when(rest == 0, lead).otherwise(F.concat(lead, part))


def mac_is_broadcast(mac: Column) -> Column:
    return mac == "ff:ff:ff:ff:ff:ff"


def _first_octet(mac: Column) -> Column:
    return F.conv(F.substring(mac, 1, 2), 16, 10).cast("int")


def mac_is_multicast(mac: Column) -> Column:
    return _first_octet(mac).bitwiseAND(F.lit(1)) == 1


def mac_is_local(mac: Column) -> Column:
    """Locally administered."""
    return _first_octet(mac).bitwiseAND(F.lit(2)) == 2


def oui(mac: Column) -> Column:
    return F.upper(F.substring(mac, 1, 8))
