"""Readings of a moment from text and numbers as column expressions; what can't be read is null."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Zone names at the end of a text that make its zone explicit (fixed values).
ZONES = ("GMT", "UTC", "EST", "EDT", "PST", "PDT", "CST", "CDT", "MST", "MDT", "BST", "JST", "IST", "CET", "CEST")
#: Texts without a zone that are understood (fixed values).
NAIVE_FORMATS = ("yyyy-MM-dd'T'HH:mm:ss[.SSSSSSSSS][.SSSSSS][.SSS]", "yyyy-MM-dd HH:mm:ss[.SSSSSSSSS][.SSSSSS][.SSS]", "yyyy/MM/dd HH:mm:ss", "yyyy/MM/dd'T'HH:mm:ss", "yyyy-MM-dd")
#: Texts with a zone that are understood.
ZONED_FORMATS = ("yyyy-MM-dd'T'HH:mm:ss[.SSSSSSSSS][.SSSSSS][.SSS]XXX", "yyyy-MM-dd'T'HH:mm:ss[.SSSSSSSSS][.SSSSSS][.SSS]XX", "yyyy-MM-dd HH:mm:ss[.SSSSSSSSS][.SSSSSS][.SSS]XXX", "d MMM yyyy HH:mm:ss z")
CROCKFORD = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"

UNITS = {"s": 1_000_000, "ms": 1_000, "us": 1}


def epoch(n: Column, unit: str) -> Column:
    """Seconds, millis, micros or nanos since 1970, none before; nanos lose what is below a micro."""
    n = n.cast("long")
    micros = F.floor(n / 1000).cast("long") if unit == "ns" else n * UNITS[unit]
    return F.when(n >= 0, F.timestamp_micros(micros))


def has_zone(s: Column) -> Column:
    t = F.trim(s)
    names = "|".join(ZONES)
    return t.rlike(r"\A[0-9\s]*\z") & (F.length(F.regexp_replace(t, "[^0-9]", "")) >= 5) | t.rlike(r"[Zz]\z") | t.rlike(r"[+-][0-9]{2}:?[0-9]{2}\z") | t.rlike(rf"(?i)[^A-Za-z]({names})\z")


def naive(s: Column, offset_seconds: int = 0) -> Column:
    """A text without a zone, taken to be ``offset_seconds`` east of UTC."""
    t = F.trim(s)
    read = F.coalesce(*(F.try_to_timestamp(F.when(t.rlike(_shape(f)), t), F.lit(f)) for f in NAIVE_FORMATS))
    return F.timestamp_micros(F.unix_micros(read) - offset_seconds * 1_000_000)


def _shape(fmt: str) -> str:
    """What texts of a naive format look like, so that one format doesn't read another's."""
    date, sep = fmt[:10].replace("yyyy", "[0-9]{4}").replace("MM", "[0-9]{2}").replace("dd", "[0-9]{2}"), fmt[10:13]
    if not sep:
        return rf"\A{date}\z"
    return rf"\A{date}{'T' if 'T' in sep else ' '}[0-9]{{2}}:[0-9]{{2}}:[0-9]{{2}}{r'([.][0-9]+)?' if '[.' in fmt else ''}\z"


def zoned(s: Column) -> Column:
    t = F.regexp_replace(F.regexp_replace(F.trim(s), "Z\\z", "+00:00"), r"\A[A-Za-z]{3}, ", "")
    return F.coalesce(*(F.try_to_timestamp(t, F.lit(f)) for f in ZONED_FORMATS))


def uuid_v7(s: Column) -> Column:
    """The milliseconds of a version 7 UUID, with or without hyphens."""
    t = F.lower(F.trim(s))
    hexes = F.replace(t, F.lit("-"), F.lit(""))
    ok = (t.rlike(r"\A[0-9a-f]{12}7[0-9a-f]{19}\z") | t.rlike(r"\A[0-9a-f]{8}-[0-9a-f]{4}-7.{3}-.{4}-.{12}\z"))
    return F.when(ok, F.timestamp_millis(F.conv(F.substring(hexes, 1, 12), 16, 10).cast("long")))


def ulid(s: Column) -> Column:
    """The milliseconds of a ULID; its first two bits are zero."""
    t = F.upper(F.trim(s))
    digits = F.transform(F.sequence(F.lit(1), F.lit(10)), lambda i: F.instr(F.lit(CROCKFORD), F.substring(t, i, F.lit(1))) - 1)
    value = F.aggregate(digits, F.lit(0).cast("long"), lambda acc, d: acc * 32 + d)
    return F.when(t.rlike(rf"\A[0-7][{CROCKFORD}]{{25}}\z"), F.timestamp_millis(value))


@dataclass(frozen=True)
class TimeInterpreter:
    """How a field tells a document's time.

    kind: s, ms, us, ns (numbers since 1970), text, uuid_v7 or ulid. For text without a zone: ``zone`` refuse (null),
    utc, offset (``offset_seconds`` east of UTC) or local (the session's zone).
    """

    kind: str = "text"
    zone: str = "refuse"
    offset_seconds: int = 0

    def __call__(self, value: Column) -> Column:
        if self.kind in ("s", "ms", "us", "ns"):
            return epoch(value, self.kind)
        text = value.cast("string")
        if self.kind == "uuid_v7":
            return uuid_v7(text)
        if self.kind == "ulid":
            return ulid(text)
        number = F.when(F.trim(text).rlike(r"\A[0-9]{10}\z"), epoch(F.trim(text), "s")).when(F.trim(text).rlike(r"\A[0-9]{13}\z"), epoch(F.trim(text), "ms"))
        plain = F.lit(None).cast("timestamp")
        if self.zone != "refuse":
            # naive() reads in the session's zone; utc and offset mean the wall clock itself
            at = naive(text, self.offset_seconds if self.zone == "offset" else 0)
            plain = at if self.zone == "local" else F.from_utc_timestamp(at, F.current_timezone())
        return F.when(has_zone(text), F.coalesce(number, zoned(text))).otherwise(plain)

    def describe(self) -> str:
        names = {"s": "epoch seconds", "ms": "epoch millis", "us": "epoch micros", "ns": "epoch nanos", "uuid_v7": "UUIDv7", "ulid": "ULID"}
        zones = {"refuse": "zone required", "utc": "UTC where no zone is given", "offset": f"{self.offset_seconds:+d} s where no zone is given", "local": "local where no zone is given"}
        return names.get(self.kind) or f"timestamp text ({zones[self.zone]})"


def within(time: Column, start=None, end=None) -> Column:
    """start <= time < end; an open side doesn't bind, but a null time is never within."""
    ok = time.isNotNull()
    if start is not None:
        ok &= time >= F.lit(start)
    if end is not None:
        ok &= time < F.lit(end)
    return ok
