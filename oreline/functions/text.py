"""Column expressions shared by the operators. All are built-in expressions: they stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that count as white space at the ends of a value.
WHITE = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85                 　"
#: Trimmed, lower-case texts that stand for "no value".
PLACEHOLDERS = ("", "n/a", "none", "unknown", "-")
#: ISO-8601 date *and* time, with an optional zone.
ISO_DATETIME = r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}(:\d{2}([.,]\d{1,9})?)?\s?([Zz]|[+-]\d{2}(:?\d{2})?)?$"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """The value without white space at either end; null stays null."""
    return F.btrim(_col(c), F.lit(WHITE))


def filled(c: Column | str) -> Column:
    """True where a text holds a value: not null and no placeholder."""
    c = _col(c)
    return c.isNotNull() & ~F.lower(strip(c)).isin(*PLACEHOLDERS)


def filled_array(c: Column | str) -> Column:
    """True where an array holds at least one element."""
    return F.coalesce(F.size(_col(c)) > 0, F.lit(False))


def clean_path(c: Column | str) -> Column:
    """A path with ``/`` for ``\\`` and without ``.`` and empty segments; null stays null."""
    parts = F.split(F.translate(_col(c), "\\", "/"), "/", -1)
    return F.array_join(F.filter(parts, lambda s: (s != "") & (s != ".")), "/")


def parse_instant(c: Column | str) -> Column:
    """Timestamp of a text that is a real date and time, else null. Values without a zone are UTC
    (the session's zone)."""
    text = strip(c)
    plain = F.regexp_replace(F.upper(text), r"\s([Z+-])", "$1")
    return F.when(text.rlike(ISO_DATETIME), F.try_to_timestamp(F.translate(plain, ",", ".")))


def plain_key(c: Column | str) -> Column:
    """A reference key without case, surrounding blanks and braces; null where nothing is left."""
    bare = F.lower(F.btrim(_col(c), F.lit(WHITE + "{}")))
    return F.when(bare != "", bare)


def service_severity(c: Column | str) -> Column:
    """Severity names of the service: CRITICAL and ERROR, HIGH and WARNING, MEDIUM and INFO, else low."""
    u = F.upper(F.coalesce(_col(c), F.lit("")))
    return (
        F.when(u.isin("CRITICAL", "ERROR"), "critical").when(u.isin("HIGH", "WARNING"), "high")
        .when(u.isin("MEDIUM", "INFO"), "medium").otherwise("low")
    )


def service_severity_rank(c: Column | str) -> Column:
    """4 for critical down to 1 for low, after :func:`service_severity`."""
    u = F.upper(F.coalesce(_col(c), F.lit("")))
    return (
        F.when(u.isin("CRITICAL", "ERROR"), 4).when(u.isin("HIGH", "WARNING"), 3)
        .when(u.isin("MEDIUM", "INFO"), 2).otherwise(1)
    )
