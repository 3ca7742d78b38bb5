"""Names of protocols, services and codes, and predicates on them."""

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values: (service, ports, T for TCP alone, U for all but TCP, B for both).
SERVICES = (
    ("ftp", (20, 21), "T"), ("ssh", (22,), "T"), ("telnet", (23,), "T"), ("smtp", (25, 587), "T"), ("dns", (53,), "B"),
    ("dhcp", (67, 68), "U"),
    ("tftp", (69,), "U"),
    ("http", (80, 8080, 8000), "T"),
    ("kerberos", (88,), "B"),
    ("pop3", (110,), "T"),
    ("ntp", (123,), "U"), ("msrpc", (135,), "T"), ("netbios", (137, 138), "U"), ("smb", (139, 445), "T"), ("imap", (143,), "T"),
    ("snmp", (161, 162), "U"), ("ldap", (389,), "B"), ("https", (443, 8443), "T"), ("quic", (443,), "U"), ("syslog", (514,), "U"),
    ("ldaps", (636,), "T"), ("mssql", (1433,), "T"), ("oracle", (1521,), "T"), ("mysql", (3306,), "T"), ("rdp", (3389,), "T"),
    ("sip", (5060, 5061), "B"),
    ("postgres", (5432,), "T"),
    ("mdns", (5353,), "U"),
    ("winrm", (5985, 5986), "T"),
    ("redis", (6379,), "T"),
    ("elasticsearch", (9200,), "T"), ("mongodb", (27017,), "T"),
)
CLEARTEXT = ("ftp", "telnet", "http", "pop3", "imap", "smtp", "tftp", "syslog", "snmp")
TCP, UDP, ICMP, ICMP6 = 6, 17, 1, 58
PROTOCOLS = {
    1: "ICMP",
    2: "IGMP",
    6: "TCP",
    17: "UDP",
    41: "IPv6",
    47: "GRE",
    50: "ESP",
    51: "AH",
    58: "ICMPv6",
    89: "OSPF",
    132: "SCTP",
}
ETHERTYPES = {
    0x0800: "IPv4",
    0x0806: "ARP",
    0x86DD: "IPv6",
    0x8100: "VLAN",
    0x88A8: "QinQ",
    0x88CC: "LLDP",
    0x8847: "MPLS",
    0x888E: "EAPOL",
}
QTYPES = {
    1: "A",
    2: "NS",
    5: "CNAME",
    6: "SOA",
    12: "PTR",
    15: "MX",
    16: "TXT",
    28: "AAAA",
    33: "SRV",
    41: "OPT",
    43: "DS",
    46: "RRSIG",
    48: "DNSKEY",
    64: "SVCB",
    65: "HTTPS",
    255: "ANY",
}
RCODES = {0: "NOERROR", 1: "FORMERR", 2: "SERVFAIL", 3: "NXDOMAIN", 4: "NOTIMP", 5: "REFUSED"}
TLS_VERSIONS = {0x0300: "SSL 3.0", 0x0301: "TLS 1.0", 0x0302: "TLS 1.1", 0x0303: "TLS 1.2", 0x0304: "TLS 1.3"}
OBSOLETE_TLS = (0x0300, 0x0302)
TCP_FLAGS = (("S", 2), ("F", 1), ("R", 4), ("P", 8), ("A", 16), ("U", 32), ("E", 64), ("C", 128))
SYN, RST, ACK = 2, 4, 16


def _lookup(table: dict, key: Column) -> Column:
    return F.create_map(*map(F.lit, chain.from_iterable(table.items())))[key]


def service(port: Column, protocol: Column) -> Column:
    """The well-known service of a port, or null. All but TCP use the datagram rows."""
    rows = {f"{p}{side}": name for name, ports, kind in SERVICES for p in ports for side in ("TU" if kind == "B" else kind)}
    return _lookup(rows, F.concat(port.cast("string"), F.when(protocol == TCP, "T").otherwise("U")))


def is_cleartext(name: Column) -> Column:
    return name.isin(*CLEARTEXT)


def protocol(number: Column) -> Column:
    return F.coalesce(_lookup(PROTOCOLS, number), F.lit("IP"))


def _named(table: dict, number: Column, other: str) -> Column:
    return F.coalesce(_lookup(table, number), F.concat(F.lit(other), number.cast("string")))


def qtype(number: Column) -> Column:
    return _named(QTYPES, number, "TYPE")


def rcode(number: Column) -> Column:
    return _named(RCODES, number, "RCODE")


def tls_version(number: Column) -> Column:
    return F.coalesce(_lookup(TLS_VERSIONS, number), F.concat(F.lit("0x"), F.lpad(F.lower(F.hex(number)), 4, "0")))


def ethertype(number: Column) -> Column:
    return F.coalesce(_lookup(ETHERTYPES, number), F.concat(F.lit("0x"), F.lpad(F.lower(F.hex(number)), 4, "0")))


def is_obsolete_tls(number: Column) -> Column:
    return number.between(*OBSOLETE_TLS)


def has(flags: Column, bit: int) -> Column:
    return flags.bitwiseAND(F.lit(bit)) != 0


def is_syn_only(flags: Column) -> Column:
    return F.coalesce(has(flags, SYN) & ~has(flags, ACK), F.lit(False))


def flags_text(flags: Column) -> Column:
    letters = F.concat(*(F.when(has(flags, bit), letter).otherwise("") for letter, bit in TCP_FLAGS))
    return F.when(letters == "", "-").otherwise(letters)


def is_grease(value: Column) -> Column:
    return (value.bitwiseAND(F.lit(0x0F0F)) == 0x0A0A) & (F.shiftright(value, 8) == value.bitwiseAND(F.lit(0xFF)))
