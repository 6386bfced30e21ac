"""String formats, skeletons and length classes as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Formats in the order in which they are tried (fixed values).
FORMATS = ("uuid", "iso-timestamp", "iso-date", "ipv4", "ipv6", "email", "url", "digits", "alpha", "alnum", "other")
#: Characters of a skeleton before it is cut short.
SKELETON_CHARS = 16

_DATE = r"[0-9]{4}-[0-9]{2}-[0-9]{2}"


def is_uuid(s: Column) -> Column:
    return s.rlike(r"\A[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}\z")


def is_iso_date(s: Column) -> Column:
    """Digits in the places of a date; ranges aren't looked at."""
    return s.rlike(rf"\A{_DATE}\z")


def is_iso_timestamp(s: Column) -> Column:
    return s.rlike(rf"\A{_DATE}[T ][0-9]{{2}}:[0-9]{{2}}:[0-9]{{2}}(\.[0-9]+)?(Z|[+-][0-9]{{2}}:?[0-9]{{2}})?\z")


def is_ipv4(s: Column) -> Column:
    """Four decimal parts of at most 255; leading zeros are allowed."""
    return s.rlike(r"\A(0*([0-9]|[1-9][0-9]|1[0-9]{2}|2[0-4][0-9]|25[0-5])(\.(?=[0-9])|\z)){4}(?<=[0-9])\z") & s.rlike(r"\A[0-9]{1,3}(\.[0-9]{1,3}){3}\z")


def is_ipv6(s: Column) -> Column:
    """2 to 39 hex digits and colons, two colons at least; a clock time looks like one."""
    return s.rlike(r"\A[0-9a-fA-F:]{2,39}\z") & s.rlike(r"\A[^:]*:[^:]*:")


def is_email(s: Column) -> Column:
    """The first @ has something on either side, and there is no blank."""
    at = F.instr(s, "@")
    return (at > 1) & (at < F.length(s)) & (F.instr(s, " ") == 0)


def is_url(s: Column) -> Column:
    return s.startswith("http://") | s.startswith("https://")


def detect_format(s: Column) -> Column:
    """The first of FORMATS that holds; null for null.

    Texts of letters and digits alone are looked at first, as none of them has any of the other formats.
    """
    tests = (is_uuid(s), is_iso_timestamp(s), is_iso_date(s), is_ipv4(s), is_ipv6(s), is_email(s), is_url(s))
    plain = F.when(s.rlike(r"\A[A-Za-z]+\z"), "alpha").when(s.rlike(r"\A[0-9]+\z"), "digits").otherwise("alnum")
    out = F.when(s.isNull(), F.lit(None).cast("string")).when(s.rlike(r"\A[A-Za-z0-9]+\z"), plain)
    for name, test in zip(FORMATS, tests, strict=False):
        out = out.when(test, name)
    return out.otherwise(FORMATS[-1])


def skeleton(s: Column) -> Column:
    """Runs of letters as A, of digits as 9, of blanks as one blank; cut after SKELETON_CHARS with an ellipsis."""
    runs = F.regexp_replace(F.regexp_replace(F.regexp_replace(s, r"[0-9]+", "9"), r"\p{IsAlphabetic}+", "A"), r"\p{IsWhite_Space}+", " ")
    return F.when(F.length(runs) > SKELETON_CHARS, F.concat(F.substring(runs, 1, SKELETON_CHARS), F.lit("…"))).otherwise(runs)


def length_bucket(n: Column) -> Column:
    """floor(log2 n), 0 below 2, at most 31."""
    return F.when(n < 2, 0).otherwise(F.least(F.lit(31), F.floor(F.log2(n.cast("double"))).cast("int"))).cast("int")
