"""Address checks as column expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

_OCTET = r"(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_V4 = rf"{_OCTET}(\.{_OCTET}){{3}}"
_H16 = r"[0-9a-fA-F]{1,4}"


def is_ipv4(address: Column) -> Column:
    return address.rlike(f"^{_V4}$")


def is_ipv6(address: Column) -> Column:
    """Eight groups, or fewer with one `::`; the last two groups may be a dotted quad."""
    flat = F.regexp_replace(address, f"(?<=:){_V4}$", "0:0")
    full = flat.rlike(f"^({_H16}:){{7}}{_H16}$")
    groups = F.size(F.filter(F.split(flat, ":"), lambda g: g != ""))
    part = f"({_H16}(:{_H16})*)?"
    shortened = flat.rlike(f"^{part}::{part}$") & (groups <= 7)
    return full | shortened


def is_address(address: Column) -> Column:
    return is_ipv4(address) | (address.contains(":") & is_ipv6(address))
