"""Column expressions: safe ratios, text and path checks, numbers, timestamps, rounding, maps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A zone at the end of a timestamp: Z, or hours and minutes.
ZONED = r"^\s*\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d{1,9})?)?\s*(Z|[+-]\d{2}:?\d{2}(:\d{2})?)\s*$"
NUMBER = r"^\s*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\s*$"
SAFE_NAME = r"^[A-Za-z0-9._-]+$"


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def safe_ratio(numerator: str | Column, denominator: str | Column) -> Column:
    """Null where the denominator is 0."""
    return F.try_divide(col(numerator).cast("double"), col(denominator).cast("double"))


def is_blank(c: str | Column) -> Column:
    return F.coalesce(F.trim(col(c)) == "", F.lit(True))


def finite(c: str | Column) -> Column:
    x = col(c)
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


def to_number(c: str | Column) -> Column:
    """Double from plain decimal text; null for anything else, forms with a type suffix included."""
    return F.when(col(c).rlike(NUMBER), F.trim(col(c)).try_cast("double"))


def flag(c: str | Column) -> Column:
    """Tri-state: '0' is false, '1' is true, anything else null."""
    return F.when(F.trim(col(c)) == "1", True).when(F.trim(col(c)) == "0", False)


def zoned_timestamp(c: str | Column) -> Column:
    """Timestamp from ISO text; null without a zone, as without one the moment isn't known."""
    return F.when(col(c).rlike(ZONED), F.try_to_timestamp(F.regexp_replace(F.trim(col(c)), "[T]", " ")))


def is_zoned_timestamp(c: str | Column) -> Column:
    return F.coalesce(zoned_timestamp(c).isNotNull(), F.lit(False))


def casefold(c: str | Column) -> Column:
    """A text without case: lower case of its upper case, so that sharp s and ss, or both small sigmas, are one."""
    return F.lower(F.upper(col(c)))


def now_iso(clock: Column | None = None) -> Column:
    """The moment in UTC as ISO text with microseconds and zone; ``clock`` stands in for the current time."""
    at = F.current_timestamp() if clock is None else clock
    return F.concat(F.date_format(F.to_utc_timestamp(at, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("+00:00"))


def url_part(c: str | Column, part: str) -> Column:
    """HOST, PATH, QUERY, PROTOCOL or REF of a url; null if it can't be parsed."""
    return F.try_parse_url(col(c), F.lit(part))


def url_encoded(c: str | Column) -> Column:
    """Percent encoding of a path part: spaces become %20."""
    return F.replace(F.url_encode(col(c)), F.lit("+"), F.lit("%20"))


def slashes(c: str | Column) -> Column:
    return F.replace(col(c), F.lit("\\"), F.lit("/"))


def base_name(c: str | Column) -> Column:
    """Last part of a path; backslashes separate too."""
    return F.element_at(F.split(slashes(c), "/"), -1)


def stem(c: str | Column) -> Column:
    """Base name without its last suffix; a leading dot is no suffix."""
    return F.regexp_replace(base_name(c), r"(?<=.)\.[^.]*$", "")


def suffix(c: str | Column) -> Column:
    return F.lower(F.regexp_extract(base_name(c), r"(?<=.)(\.[^.]*)$", 1))


def is_safe_path(c: str | Column) -> Column:
    """Relative, not empty, no backslash and no part that climbs; repeated slashes and dots collapse."""
    x = col(c)
    parts = F.filter(F.split(x, "/"), lambda p: (p != "") & (p != "."))
    return F.coalesce((F.size(parts) > 0) & ~x.startswith("/") & ~x.contains("\\") & ~F.array_contains(parts, ".."), F.lit(False))


def safe_stem(c: str | Column, default: str = "image", longest: int = 80) -> Column:
    """A name of safe characters: other runs become one underscore, ends are trimmed."""
    cleaned = F.regexp_replace(F.regexp_replace(stem(c), r"[^A-Za-z0-9._-]+", "_"), r"^[._]+|[._]+$", "")
    return F.when(cleaned == "", F.lit(default)).otherwise(F.substring(cleaned, 1, longest))


def half_even(c: str | Column, digits: int = 0) -> Column:
    """Rounding of ties to even."""
    return F.bround(col(c), digits)


def fixed_point(c: str | Column, digits: int = 6) -> Column:
    """Text with ``digits`` decimals of the exact binary value, ties to even, without exponent."""
    return F.format_string(f"%.{digits}f", F.bround(col(c).cast("decimal(38,18)"), digits).cast("double"))


def counts_json(c: str | Column) -> Column:
    """A map as JSON text, keys in order."""
    entries = F.array_sort(F.map_entries(col(c)))
    return F.to_json(F.map_from_entries(entries))


def keyword_class(c: str | Column, rules: list[tuple[str, list[str]]], default: str) -> Column:
    """The first rule one of whose words the lower-cased text contains; else ``default``."""
    low = F.lower(col(c))
    out = None
    for label, words in rules:
        hit = F.coalesce(F.lit(False), F.lit(False))
        for w in words:
            hit = hit | low.contains(w)
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return (out.otherwise(default)) if out is not None else F.lit(default)
