"""Names, numbers, sizes: parsing as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The tags a name can carry after its prefix.
TAGS = ("hide", "indx", "srch", "totl")
PREFIX = "archive"


def tag_run(name: Column, prefix: str = PREFIX) -> Column:
    """The run of tags behind the prefix, with its dots; empty without any."""
    return F.regexp_extract(name, rf"^{prefix}\.((?:(?:{'|'.join(TAGS)})\.)+)", 1)


def has_tag(name: Column, tag: str, prefix: str = PREFIX) -> Column:
    return F.concat(F.lit("."), tag_run(name, prefix)).contains(f".{tag}.")


def invalid_tags(name: Column, prefix: str = PREFIX) -> Column:
    """A name with the prefix but no tag."""
    return name.startswith(f"{prefix}.") & (tag_run(name, prefix) == "")


def u64(text: Column) -> Column:
    """A number below 2**64 as decimal(20,0), or null: decimal, 0x hexadecimal or 0 octal, at most 23 characters, no sign or blank."""
    short = F.length(text) < 24
    hexadecimal = F.conv(F.substring(text, F.lit(3), F.length(text)), 16, 10)
    octal = F.conv(text, 8, 10)
    value = (
        F.when(text.rlike(r"^0[xX][0-9a-fA-F]{1,16}\z"), hexadecimal.try_cast("decimal(20,0)"))
        .when(text.rlike(r"^0[0-7]+\z"), F.when(F.length(F.ltrim(text, F.lit("0"))) <= 21, octal.try_cast("decimal(20,0)")))
        .when(text.rlike(r"^(0|[1-9][0-9]{0,19})\z"), text.try_cast("decimal(20,0)"))
    )
    return F.when(short & (value <= F.lit("18446744073709551615").cast("decimal(20,0)")), value)


def last_numbers(name: Column, n: int) -> list[Column]:
    """The last n dotted numbers of a name, null where one is none."""
    parts = F.split(name, r"\.")
    return [F.when(F.size(parts) > n, u64(F.try_element_at(parts, F.lit(-k)))) for k in range(n, 0, -1)]


def totl_key(name: Column) -> list[Column]:
    return last_numbers(name, 3)


def indx_key(name: Column, value: Column) -> list[Column]:
    """(major, minor) with major at most 255 and no value allowed."""
    major, minor = last_numbers(name, 2)
    ok = (major <= 255) & minor.isNotNull() & (F.length(value) == 0)
    return [F.when(ok, major), F.when(ok, minor)]


SUFFIXES = "KMGTP"


def human_size(text: Column) -> Column:
    """Digits and a suffix K to P, powers of 1024, as bytes; null if it is none or overflows."""
    number = F.regexp_extract(text, rf"^([0-9]{{1,18}})([{SUFFIXES}]?)$", 1).try_cast("long")
    suffix = F.regexp_extract(text, rf"^([0-9]{{1,18}})([{SUFFIXES}]?)$", 2)
    power = reduce(lambda out, i: F.when(suffix == SUFFIXES[i], F.lit(1024 ** (i + 1))).otherwise(out), range(len(SUFFIXES)), F.lit(1).cast("long"))
    return F.try_multiply(number, power)


def any_u64(text: Column) -> Column:
    """Like :func:`u64`, with a leading + allowed, as the command line takes it."""
    return u64(F.regexp_replace(text, r"^\+", ""))


def s64(text: Column) -> Column:
    """A signed number, or null beyond 64 bits."""
    size = any_u64(F.regexp_replace(text, "^-", ""))
    return F.when(text.rlike("^-[0-9]"), -size).when(~text.startswith("-"), size).try_cast("long")


def u32(text: Column) -> Column:
    value = any_u64(text)
    return F.when(value <= 4294967295, value).cast("long")


def timespec(text: Column) -> list[Column]:
    """Seconds and nanoseconds from "sec.nsec"; both null unless both are there and there are no more than 1e9 nanoseconds."""
    shape = r"^([0-9]{1,18})\.([0-9]{1,10})$"
    sec, nsec = (F.regexp_extract(text, shape, k).try_cast("long") for k in (1, 2))
    ok = text.rlike(shape) & (nsec <= 1_000_000_000)
    return [F.when(ok, sec), F.when(ok, nsec)]


def position(text: Column) -> list[Column]:
    """major, minor, ino of "major.minor.ino": parts that are missing are 0; all null if one is no number."""
    parts = F.split(text, r"\.", 3)
    each = [F.when(F.size(parts) >= k, any_u64(F.try_element_at(parts, F.lit(k)))).otherwise(0) for k in (1, 2, 3)]
    ok = each[0].isNotNull() & each[1].isNotNull() & each[2].isNotNull()
    return [F.when(ok, x) for x in each]


def packed_key(parts: list[Column], widths: list[int]) -> Column:
    """Unsigned numbers as one string of hexadecimal digits that sorts like the tuple."""
    return F.concat(*[F.lpad(F.hex(x), w, "0") for x, w in zip(parts, widths, strict=True)])


def unpacked_key(packed: Column, widths: list[int]) -> list[Column]:
    at = [1 + sum(widths[:i]) for i in range(len(widths))]
    return [F.conv(F.substring(packed, a, w), 16, 10).cast("decimal(20,0)") for a, w in zip(at, widths, strict=True)]
