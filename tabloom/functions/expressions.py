"""Column expressions shared by all operators.

Everything here builds plain Catalyst expressions; nothing runs a job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

FLOATING = (T.FloatType, T.DoubleType)
INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
NUMERIC = FLOATING + INTEGRAL + (T.DecimalType,)
TEXTUAL = (T.StringType, T.CharType, T.VarcharType)
TEMPORAL = (T.DateType, T.TimestampType, T.TimestampNTZType)

# Accepted spellings of booleans when a table is scored.
TRUE_WORDS = ["true", "1", "yes", "y", "t"]
FALSE_WORDS = ["false", "0", "no", "n", "f"]

# The two tests of the "looks like a date" rule.
DIGIT_PATTERN = r"\d"
DATE_SEPARATOR_PATTERN = r"[-/:T]"

# One run of characters that are not white space, Unicode white space included.
WORD_PATTERN = r"(?U)[^\s\x1c-\x1f]++"

# Decimal numbers with an optional exponent, and infinity.
NUMBER_PATTERN = r"^(?i)[+-]?((\d+\.?\d*|\.\d+)(e[+-]?\d+)?|inf|infinity)$"

# Date layouts tried for string columns: (pattern for try_to_timestamp, shape guard).
# The guard keeps the parser away from text that cannot match. A None pattern
# means the ISO cast, which also understands fractions and zone offsets.
DATE_LAYOUTS: list[tuple[str | None, str]] = [
    (
        None,
        r"^\s*\d{4}-\d{1,2}-\d{1,2}([ T]\d{1,2}:\d{2}(:\d{2}(\.\d+)?)?\s*(Z|[+-]\d{2}:?\d{2})?)?\s*$",
    ),
    ("M/d/yyyy", r"^\d{1,2}/\d{1,2}/\d{4}$"),
    ("d/M/yyyy", r"^\d{1,2}/\d{1,2}/\d{4}$"),
    ("M/d/yyyy H:mm", r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{2}$"),
    ("M/d/yyyy H:mm:ss", r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{2}:\d{2}$"),
    ("d/M/yyyy H:mm:ss", r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{2}:\d{2}$"),
    ("yyyy/M/d", r"^\d{4}/\d{1,2}/\d{1,2}$"),
    ("yyyy/M/d H:mm:ss", r"^\d{4}/\d{1,2}/\d{1,2} \d{1,2}:\d{2}:\d{2}$"),
    ("M-d-yyyy", r"^\d{1,2}-\d{1,2}-\d{4}$"),
    ("d-M-yyyy", r"^\d{1,2}-\d{1,2}-\d{4}$"),
    ("d.M.yyyy", r"^\d{1,2}\.\d{1,2}\.\d{4}$"),
    ("yyyyMMdd", r"^\d{8}$"),
    ("yyyy/M/d H:mm", r"^\d{4}/\d{1,2}/\d{1,2} \d{1,2}:\d{2}$"),
    ("d/M/yyyy H:mm", r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{2}$"),
    ("M-d-yyyy H:mm", r"^\d{1,2}-\d{1,2}-\d{4} \d{1,2}:\d{2}$"),
    ("d-M-yyyy H:mm", r"^\d{1,2}-\d{1,2}-\d{4} \d{1,2}:\d{2}$"),
    ("M-d-yyyy H:mm:ss", r"^\d{1,2}-\d{1,2}-\d{4} \d{1,2}:\d{2}:\d{2}$"),
    ("d-M-yyyy H:mm:ss", r"^\d{1,2}-\d{1,2}-\d{4} \d{1,2}:\d{2}:\d{2}$"),
    ("d.M.yyyy H:mm", r"^\d{1,2}\.\d{1,2}\.\d{4} \d{1,2}:\d{2}$"),
    ("d.M.yyyy H:mm:ss", r"^\d{1,2}\.\d{1,2}\.\d{4} \d{1,2}:\d{2}:\d{2}$"),
    ("MMM d, yyyy", r"^[A-Za-z]{3} \d{1,2}, \d{4}$"),
    ("MMMM d, yyyy", r"^[A-Za-z]{3,9} \d{1,2}, \d{4}$"),
    ("d MMM yyyy", r"^\d{1,2} [A-Za-z]{3} \d{4}$"),
    ("d MMMM yyyy", r"^\d{1,2} [A-Za-z]{3,9} \d{4}$"),
    ("M/d/yyyy h:mm a", r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{2} [AaPp][Mm]$"),
    ("M/d/yyyy h:mm:ss a", r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{2}:\d{2} [AaPp][Mm]$"),
    ("yyyy-M-d h:mm a", r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{2} [AaPp][Mm]$"),
    ("yyyy-M-d h:mm:ss a", r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{2}:\d{2} [AaPp][Mm]$"),
]


def quoted(name: str) -> str:
    """Column reference that survives dots and spaces in the name."""
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    return F.col(quoted(name))


def field_types(df: DataFrame) -> dict[str, T.DataType]:
    return {f.name: f.dataType for f in df.schema.fields}


def is_numeric(dtype: T.DataType) -> bool:
    return isinstance(dtype, NUMERIC)


def is_text(dtype: T.DataType) -> bool:
    return isinstance(dtype, TEXTUAL)


def is_temporal(dtype: T.DataType) -> bool:
    return isinstance(dtype, TEMPORAL)


def is_categorical(dtype: T.DataType) -> bool:
    return is_text(dtype) or isinstance(dtype, T.BooleanType)


def nan_to_null(df: DataFrame) -> DataFrame:
    """Give missing values one spelling: NaN in float columns becomes NULL."""
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, FLOATING)]
    if not floats:
        return df
    return df.withColumns(
        {c: F.when(~F.isnan(col(c)), col(c)) for c in floats}
    )


def canonical_text(name: str, dtype: T.DataType) -> Column:
    """Text form of a value that is equal exactly when the values are equal."""
    c = col(name)
    if isinstance(dtype, FLOATING):
        # -0.0 and 0.0 are one value; float widens to double without loss.
        return (c.cast("double") + F.lit(0.0)).cast("string")
    return c.cast("string")


def counting_key(name: str, dtype: T.DataType) -> tuple[str, Column]:
    """(kind, key): a long, double or text that is equal exactly for equal values.

    Cheaper to hash and shuffle than text; for counting only.
    """
    c = col(name)
    if isinstance(dtype, INTEGRAL + (T.BooleanType,)):
        return "long", c.cast("long")
    if isinstance(dtype, T.DateType):
        return "long", F.unix_date(c).cast("long")
    if isinstance(dtype, T.TimestampType):
        return "long", F.unix_micros(c)
    if isinstance(dtype, T.TimestampNTZType):
        # Through date and clock parts: no session time zone gets involved.
        seconds = (F.hour(c) * 60 + F.minute(c)).cast("long") * 60
        micros = (F.extract(F.lit("SECOND"), c) * 1000000).cast("long")
        days = F.unix_date(c.cast("date")).cast("long")
        return "long", (days * 86400 + seconds) * 1000000 + micros
    if isinstance(dtype, FLOATING):
        return "double", c.cast("double") + F.lit(0.0)
    return "text", canonical_text(name, dtype)


def row_hash(df: DataFrame) -> Column:
    """64-bit hash of a row; equal rows have equal hashes, not the reverse."""
    types = field_types(df)
    parts = []
    for name in df.columns:
        key = counting_key(name, types[name])[1]
        parts += [key, key.isNull()]
    return F.xxhash64(*parts)


def word_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(WORD_PATTERN))


def has_digit(c: Column) -> Column:
    return c.rlike(DIGIT_PATTERN)


def has_date_separator(c: Column) -> Column:
    return c.rlike(DATE_SEPARATOR_PATTERN)


def parse_date(c: Column, layout: int) -> Column:
    """Timestamp of a string in one layout, NULL where it does not fit."""
    pattern, guard = DATE_LAYOUTS[layout]
    text = c.cast("string")
    if pattern is None:
        parsed = F.trim(text).try_cast("timestamp")
    else:
        parsed = F.try_to_timestamp(text, F.lit(pattern))
    return F.when(text.rlike(guard), parsed)


def text_to_double(c: Column) -> Column:
    """Number in a text, NULL when it is none; Java's "1d" and "1f" are none."""
    return F.when(F.trim(c).rlike(NUMBER_PATTERN), F.trim(c).try_cast("double"))


def as_double(c: Column, dtype: T.DataType) -> Column:
    return c if isinstance(dtype, T.DoubleType) else c.cast("double")


def row_digest(df: DataFrame, names: list[str] | None = None) -> Column:
    """256-bit digest of a row over ``names``; equal rows have equal digests.

    Values are length-prefixed and NULLs are marked, so neighbouring columns
    cannot run into each other.
    """
    types = field_types(df)
    parts = []
    for name in names or df.columns:
        text = canonical_text(name, types[name])
        parts.append(
            F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text), F.lit("-"))
        )
    return F.unhex(F.sha2(F.concat_ws("|", *parts), 256))


def split_key(seed: int, names: list[str], types: dict[str, T.DataType]) -> Column:
    """Seeded MD5 text of the row key: the order in which rows are dealt out."""
    parts = [F.lit(f"{seed}")] + [
        F.coalesce(canonical_text(n, types[n]), F.lit("")) for n in names
    ]
    return F.md5(F.concat_ws(":", *parts))
