"""Column functions on domains, URLs, entropy, and figures for people."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def ascii_lower(s: Column) -> Column:
    return F.translate(s, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def parent_domain(name: Column) -> Column:
    """The last two labels, without trailing dots."""
    return F.substring_index(F.rtrim(name, F.lit(".")), ".", -2)


def url_host(url: Column) -> Column:
    """What stands between ``://`` and the path, without credentials and port. IPv6 literals are not understood."""
    after = F.when(F.contains(url, F.lit("://")), F.regexp_replace(url, "^.*?://", "")).otherwise(url)
    authority = F.regexp_extract(after, "^[^/?#]*", 0)
    return ascii_lower(F.trim(F.split_part(F.substring_index(authority, "@", -1), F.lit(":"), F.lit(1))))


def entropy(s: Column) -> Column:
    """Shannon entropy in bits of the bytes of a string; 0 for the empty one."""
    digits = F.hex(F.encode(s, "UTF-8"))
    octets = F.transform(
        F.sequence(F.lit(1), (F.length(digits) / 2).cast("int")),
        lambda i: F.substring(digits, 2 * i - 1, F.lit(2)),
    )
    total = (F.length(digits) / 2).cast("double")
    counted = lambda all_: F.aggregate(
        F.array_distinct(all_),
        F.lit(0.0),
        lambda acc, o: acc - _share(all_, o, total) * F.log2(_share(all_, o, total)),
    )
    return F.when(F.length(s) == 0, 0.0).otherwise(F.transform(F.array(octets), counted)[0])


def _share(all_: Column, octet: Column, total: Column) -> Column:
    return F.size(F.filter(all_, lambda x: x == octet)) / total


def suffixes(name: Column) -> Column:
    """A name and its parents as structs of (depth, suffix), the whole name at depth 0."""
    labels = F.split(name, r"\.")
    return F.transform(
        F.sequence(F.lit(0), F.size(labels) - 1),
        lambda i: F.struct(i.alias("depth"), F.array_join(F.slice(labels, i + 1, F.size(labels)), ".").alias("suffix")),
    )


def fixed(x: Column, places: int) -> Column:
    """A number with up to three decimals, rounded from its exact value, a tie to the even digit.

    ``format_string`` rounds the shortest decimal that stands for a double instead, and a tie up; it is left
    what has no such digits: negative numbers, those from 2^53, infinity and NaN.
    """
    x, scale, half = x.cast("double"), 10**places, 1 << 51

    def digits(there: Column) -> Column:
        whole = F.floor(there)
        fraction = (there - whole) * float(1 << 52)
        small = (fraction - F.floor(fraction)) * scale  # what numbers below 1 have past 52 binary digits
        scaled = F.floor(fraction) * scale + F.floor(small)
        return F.struct(
            (whole * scale + F.shiftright(scaled, 52)).alias("n"),
            scaled.bitwiseAND(F.lit((1 << 52) - 1)).alias("rest"),
            (small > F.floor(small)).alias("more"),
        )

    def rounded(d: Column) -> Column:
        up = (d["rest"] > half) | ((d["rest"] == half) & (d["more"] | (d["n"] % 2 == 1)))
        return d["n"] + F.when(up, 1).otherwise(0)

    def written(n: Column) -> Column:
        decimals = [F.lit("."), F.lpad((n % scale).cast("string"), places, "0")] if places else []
        return F.concat(whole_div(n, scale).cast("string"), *decimals)

    # Functions of an array's one element, so that what is used often is one expression.
    found = F.array(F.when((x >= 0) & (x < float(1 << 53)), x))
    for step in (digits, rounded, written):
        found = F.transform(found, step)
    return F.coalesce(found[0], F.format_string(f"%.{places}f", x))


UNITS = ("KB", "MB", "GB", "TB")


def human_bytes(n: Column) -> Column:
    """``512 B``, ``1.5 KB`` and so on, in steps of 1024 with one decimal."""
    share, unit = n / 1024.0**5, F.lit("PB")
    for k in range(len(UNITS), 0, -1):
        below = n < 1024 ** (k + 1)
        share, unit = F.when(below, n / float(1024**k)).otherwise(share), F.when(below, UNITS[k - 1]).otherwise(unit)
    return F.when(n < 1024, F.format_string("%d B", n)).otherwise(F.concat_ws(" ", fixed(share, 1), unit))


def human_percent(share: Column) -> Column:
    """A share as percent, with more digits the smaller it is."""
    p = share * 100
    shown = lambda places: F.concat(fixed(p, places), F.lit("%"))
    return F.when(p == 0, "0%").when(p >= 10, shown(0)).when(p >= 1, shown(1)).when(p >= 0.1, shown(2)).when(p >= 0.001, shown(3)).otherwise("<0.001%")


def human_duration(seconds: Column) -> Column:
    """``310ms``, ``4.2s``, ``1m30s``, ``1h02m``."""
    whole = F.floor(seconds).cast("long")
    return (
        F.when(seconds < 1, F.concat(fixed(seconds * 1000, 0), F.lit("ms"))).when(seconds < 60, F.concat(fixed(seconds, 1), F.lit("s")))
        .when(seconds < 3600, F.format_string("%dm%02ds", F.floor(whole / 60), whole % 60)).otherwise(
            F.format_string("%dh%02dm", F.floor(whole / 3600), F.floor(whole % 3600 / 60))
        )
    )


def whole_div(a: Column, b: int) -> Column:
    """Integer quotient of longs, which a quotient of doubles isn't at nanoseconds."""
    return F.call_function("div", a, F.lit(b))


def rfc3339(ts_ns: Column) -> Column:
    """UTC time with milliseconds, cut off."""
    return F.date_format(F.timestamp_micros(whole_div(ts_ns, 1_000_000) * 1000), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def time_of_day(ts_ns: Column) -> Column:
    return F.date_format(F.timestamp_micros(whole_div(ts_ns, 1000)), "HH:mm:ss.SSSSSS")


# Shapes of indicators.
IPV4 = r"^((25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)$"
IPV6 = r"^(?=.*:.*:)(([0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}|(?!.*::.*::)(([0-9a-fA-F]{1,4}(:[0-9a-fA-F]{1,4}){0,6})?::([0-9a-fA-F]{1,4}(:[0-9a-fA-F]{1,4}){0,6})?))$"
JA3 = "^[0-9a-fA-F]{32}$"
DOMAIN = "^[A-Za-z0-9.-]*[.][A-Za-z0-9.-]*$"


def indicator_kind(token: Column) -> Column:
    """ip, cidr, ja3, domain, or null for what is none of these."""
    address, bits = F.split_part(token, F.lit("/"), F.lit(1)), F.split_part(token, F.lit("/"), F.lit(2))
    number = F.when(bits.rlike(r"^\d{1,3}$"), bits.cast("int"))
    cidr = F.when(
        (F.length(token) - F.length(F.replace(token, F.lit("/"), F.lit(""))) == 1) & (
            (address.rlike(IPV4) & (number <= 32))
            | (address.rlike(IPV6) & (number <= 128))
        ),
        "cidr",
    )
    plain = F.when(token.rlike(IPV4) | token.rlike(IPV6), "ip").when(token.rlike(JA3), "ja3").when(token.rlike(DOMAIN), "domain")
    return F.when(F.contains(token, F.lit("/")), cidr).otherwise(plain)
