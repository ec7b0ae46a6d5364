"""Typed values out of text columns, as Column expressions. Storage is text, and the empty string marks what is missing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space in the Unicode sense.
SPACE = r"[\s\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
#: The same characters one by one, for cutting at both ends without a pattern.
SPACES = "\t\n\x0b\f\r \x1c\x1d\x1e\x1f\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def stripped(c: Column) -> Column:
    """Without white space at both ends, in the Unicode sense; null becomes empty."""
    return F.coalesce(F.btrim(c.cast("string"), F.lit(SPACES)), F.lit(""))


def or_null(c: Column) -> Column:
    """Stripped text, null if nothing is left."""
    return F.nullif(stripped(c), F.lit(""))


def first_present(df: DataFrame, *names: str) -> Column:
    """The first of the named columns that has text; names that df lacks are passed over (dotted names reach into structs)."""
    found = []
    for name in names:
        top, _, rest = name.partition(".")
        if name in df.columns:
            found.append(F.col(f"`{name}`"))
        elif rest and top in df.columns and rest in getattr(df.schema[top].dataType, "names", ()):
            found.append(F.col(f"`{top}`.`{rest}`"))
    return F.coalesce(*[or_null(c) for c in found], F.lit(None).cast("string"))


def number(c: Column) -> Column:
    """As double; what is no number counts as 0."""
    return F.when(c.cast("string").rlike(NUMBER), c.cast("string").try_cast("double")).otherwise(F.lit(0.0))


def count_value(c: Column) -> Column:
    """A count written as text: whole, not below 0; what is no number counts as 0."""
    return F.greatest(number(c).cast("long"), F.lit(0).cast("long"))


def epoch_time(seconds: Column) -> Column:
    """Seconds since 1970 as a timestamp without zone, in UTC whatever the session's zone is."""
    days = F.floor(seconds / 86400).cast("int")
    return F.lit("1970-01-01").cast("timestamp_ntz") + F.make_dt_interval(days, F.lit(0), F.lit(0), (seconds - days * F.lit(86400).cast("long")).cast("decimal(18,6)"))


def iso_time(c: Column) -> Column:
    """10 to 13 digits are seconds or, over 10,000,000,000, milliseconds since 1970, shown as ISO 8601 in UTC; other text stays."""
    text = stripped(c)
    raw = F.when(text.rlike(r"^\d{10,13}$"), text.try_cast("long"))
    seconds = F.when(raw > 10_000_000_000, F.floor(raw / 1000)).otherwise(raw)
    shown = F.concat(F.date_format(epoch_time(seconds), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00"))
    return F.coalesce(shown, text)


def published_at(c: Column) -> Column:
    """A time of publication as timestamp without zone: digits are an epoch, ISO text loses its offset unconverted, all else is null."""
    text = stripped(c)
    raw = F.when(text.rlike(r"^\d+$"), text.try_cast("long"))
    seconds = F.when(raw > 10_000_000_000, F.floor(raw / 1000)).otherwise(raw)
    epoch = F.when(seconds <= 253_402_300_799, epoch_time(seconds))  # up to the year 9999
    # a date is followed by nothing or by a time; other forms that a cast would read are not dates here
    iso = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})?)?$"), F.regexp_replace(text, r"(Z|(?<=:\d{2}|\.\d{1,9})[+-]\d{2}:?\d{2})$", "").try_cast("timestamp_ntz"))
    return F.coalesce(epoch, iso)


def joined_list(c: Column, prefix: str = "") -> Column:
    """A list written as text, parted by semicolons: JSON-like lists, words that begin with prefix, or parts between commas."""
    text = stripped(c)
    parsed = F.from_json(F.regexp_replace(text, "'", '"'), "array<string>")
    parts = F.filter(F.transform(parsed, stripped), lambda x: x != "")
    listed = F.when(text.startswith("[") & text.endswith("]") & parsed.isNotNull(), F.array_join(parts, ";"))
    plain = F.regexp_replace(text, ",", ";")
    if prefix:
        found = F.array_join(F.regexp_extract_all(text, F.lit(rf"(?U)\Q{prefix}\E\w+"), F.lit(0)), ";")
        plain = F.when((text != "") & ~text.startswith(prefix), found).otherwise(plain)
    return F.coalesce(listed, plain)


def split_tags(c: Column) -> Column:
    """Distinct tags of a semicolon list: trimmed, without '#', lower-case, sorted."""
    tags = F.transform(F.split(F.coalesce(c, F.lit("")), ";"), lambda x: F.lower(F.regexp_replace(stripped(x), r"^#+", "")))
    return F.array_sort(F.array_distinct(F.filter(tags, lambda x: x != "")))


def user_name(c: Column) -> Column:
    return F.lower(F.regexp_replace(stripped(c), r"^@+", ""))


def truthy(c: Column) -> Column:
    """A reviewer's yes."""
    return F.lower(stripped(c)).isin("1", "true", "yes", "si", "sí", "y")


def with_columns(df: DataFrame, names: list[str], more: tuple[str, ...] = ()) -> DataFrame:
    """Exactly the named columns, as text: missing ones are empty, others are dropped, but for those in more, which stay as they are."""
    return df.select(*more, *[F.coalesce(F.col(f"`{n}`").cast("string"), F.lit("")).alias(n) if n in df.columns else F.lit("").alias(n) for n in names])
