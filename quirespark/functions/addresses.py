"""Addresses of hosts as Column expressions."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from quirespark.functions.text import once

#: Networks that no public host has. Of IPv4 the first address and the bits
#: that count; of IPv6 how the 32 hexadecimal digits begin.
V4 = (
    ("0.0.0.0", 8), ("10.0.0.0", 8), ("100.64.0.0", 10), ("127.0.0.0", 8), ("169.254.0.0", 16), ("172.16.0.0", 12), ("192.0.0.0", 24), ("192.0.2.0", 24), ("192.88.99.0", 24), ("192.168.0.0", 16), ("198.18.0.0", 15), ("198.51.100.0", 24), ("203.0.113.0", 24),
    ("224.0.0.0", 4), ("240.0.0.0", 4),
)
V6 = (
    "0{24}", "2001002", "20010db8", "3fff0", "20010000", "2002", "0064ff9b0{16}", "0064ff9b0001", "01000{12}", "5f00", "fec", "fed", "fee", "fef", "fc", "fd", "ff", "fe8", "fe9", "fea", "feb",
)
OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
DOTTED = rf"{OCTET}(?:[.]{OCTET}){{3}}"


def number(dotted: Column) -> Column:
    """An IPv4 address as a number."""
    return F.aggregate(F.split(dotted, "[.]"), F.lit(0).cast("long"), lambda n, part: n * 256 + part.cast("long"))


def reserved_v4(n: Column) -> Column:
    start = lambda a: sum(int(x) << 8 * (3 - k) for k, x in enumerate(a.split(".")))
    return reduce(or_, (n.between(start(a), start(a) + (1 << 32 - bits) - 1) for a, bits in V4))


def digits(address: Column) -> Column:
    """An IPv6 address as 32 hexadecimal digits; null for what is none."""
    def whole(a: Column) -> Column:
        """With a last part in dots as two groups."""
        dots = F.regexp_extract(a, rf":({DOTTED})$", 1)
        tail = F.lower(F.lpad(F.hex(number(dots)), 8, "0"))
        return F.when(dots != "", F.concat(F.substr(a, F.lit(1), F.length(a) - F.length(dots)), F.substring(tail, 1, 4), F.lit(":"), F.substring(tail, 5, 4))).otherwise(a)

    def filled(a: Column) -> Column:
        groups = lambda s: F.filter(F.split(s, ":"), lambda g: g != "")
        gap = F.instr(a, "::")
        left, right = groups(F.when(gap > 0, F.substr(a, F.lit(1), gap)).otherwise(a)), groups(F.when(gap > 0, F.substr(a, gap + 2, F.length(a))).otherwise(""))
        missing = F.lit(8) - F.size(left) - F.size(right)
        pad = lambda gs: F.array_join(F.transform(gs, lambda g: F.lpad(g, 4, "0")), "")
        ok = a.rlike("^(?:[0-9a-f]{1,4}(?::[0-9a-f]{1,4})*)?(?:::(?:[0-9a-f]{1,4}(?::[0-9a-f]{1,4})*)?)?$") & F.when(gap > 0, missing >= 1).otherwise(missing == 0)
        return F.when(ok, F.concat(pad(left), F.repeat(F.lit("0000"), F.greatest(missing, F.lit(0))), pad(right)))

    return once(once(F.lower(address), whole), filled)


def routable(address: Column) -> Column:
    """Whether an address is a public host's. A mapped one is what it maps to, a zone changes
    nothing, and what is no address is not."""
    bare = F.when(F.contains(address, F.lit(":")), F.regexp_extract(address, "^([^%]*)", 1)).otherwise(address)
    hexed = digits(bare)
    six = once(hexed, lambda d: F.when(d.rlike("^0{20}ffff"), ~reserved_v4(F.conv(F.substring(d, 25, 8), 16, 10).cast("long"))).otherwise(~d.rlike(f"^(?:{'|'.join(V6)})")))
    four = F.when(bare.rlike(f"^{DOTTED}$"), ~reserved_v4(number(bare)))
    return F.coalesce(F.when(F.contains(bare, F.lit(":")), six).otherwise(four), F.lit(False))
