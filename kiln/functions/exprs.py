"""Column expressions shared by all operators.

Everything here returns a ``pyspark.sql.Column`` built from Spark built-ins, so
it stays inside whole-stage codegen. ANSI mode is on in Spark 4: every parse,
cast and division uses its ``try_`` form.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ---- fixed values -----------------------------------------------------------
# Text that a permissive numeric parser accepts after trimming: sign, digits
# with an optional dot, optional exponent, or an infinity literal.
NUMERIC_TEXT = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$|^[+-]?(?i:inf|infinity)$"
# Families of datetime formats (Spark pattern with optional parts) and the shape of their values: a value
# is only handed to the parser of a family whose shape it has. Month comes before day; day first is the fallback.
_TIME = r"\d{1,2}:\d{2}"
DATETIME_FAMILIES: tuple[tuple[str, str], ...] = (
    ("yyyy-MM-dd[ H:mm[:ss[.SSSSSS]]]['T'H:mm:ss[.SSSSSS][XXX]]",
     rf"^\d{{4}}-\d{{1,2}}-\d{{1,2}}( {_TIME}(:\d{{2}}(\.\d{{1,6}})?)?|T{_TIME}:\d{{2}}(\.\d{{1,6}})?(Z|[+-]\d{{2}}:\d{{2}})?)?$"),
    ("yyyy/M/d", r"^\d{4}/\d{1,2}/\d{1,2}$"),
    ("M/d/yyyy[ H:mm[:ss]]", rf"^\d{{1,2}}/\d{{1,2}}/\d{{4}}( {_TIME}(:\d{{2}})?)?$"),
    ("d/M/yyyy", r"^\d{1,2}/\d{1,2}/\d{4}$"),
    ("M/d/yy", r"^\d{1,2}/\d{1,2}/\d{2}$"),
    ("M-d-yyyy", r"^\d{1,2}-\d{1,2}-\d{4}$"),
    ("yyyyMMdd", r"^\d{8}$"),
    ("yyyy-MM", r"^\d{4}-\d{2}$"),
    ("[d MMM yyyy][d MMMM yyyy]", r"^\d{1,2} [A-Z][a-z]{2,8} \d{4}$"),
    ("[MMM d, yyyy][MMMM d, yyyy]", r"^[A-Z][a-z]{2,8} \d{1,2}, \d{4}$"),
)
# Single formats, as shapes of masks (digits are 9, capitals A except T and Z, small letters a): a column is
# datetime-like when one of them carries it. m and d mark slashed dates whose first or second number can be a month.
_DAY, _MASK_TIME, _ZONE = r"9{4}-9{1,2}-9{1,2}", r"9{1,2}:99", r"(Z|[+-]99:99)"
_MASK_TIMES = ("", f" {_MASK_TIME}:99", f" {_MASK_TIME}", f"T{_MASK_TIME}:99", f" {_MASK_TIME}:99\\.9{{1,6}}",
               f"T{_MASK_TIME}:99\\.9{{1,6}}", f"T{_MASK_TIME}:99{_ZONE}", f"T{_MASK_TIME}:99\\.9{{1,6}}{_ZONE}")
DATETIME_MASKS: tuple[str, ...] = (
    *(_DAY + t for t in _MASK_TIMES), r"9{4}/9{1,2}/9{1,2}", r"9{1,2}/9{1,2}/9{4}m.*", rf"9{{1,2}}/9{{1,2}}/9{{4}} {_MASK_TIME}m.*",
    rf"9{{1,2}}/9{{1,2}}/9{{4}} {_MASK_TIME}:99m.*", r"9{1,2}/9{1,2}/9{4}m?d", r"9{1,2} Aaa 9{4}", r"9{1,2} Aa{3,8} 9{4}",
    r"Aaa 9{1,2}, 9{4}", r"Aa{3,8} 9{1,2}, 9{4}", r"9{1,2}-9{1,2}-9{4}", r"9{8}", r"9{1,2}/9{1,2}/9{2}", r"9{4}-9{2}",
)
LONGEST_DATETIME = 40
# Dates alone, which Spark casts without a formatter, and how every text of a family begins.
_ISO_DATE, _SLASHED_DATE = r"^\d{4}-\d{2}-\d{2}$", r"^\d{1,2}/\d{1,2}/\d{4}$"
_DATETIME_START = r"^(\d{1,4}[-/]\d|\d{8}$|\d{1,2} [A-Z]|[A-Z][a-z]{2,8} \d)"
LAST_SHORT_YEAR = 2068  # two-digit years go up to it; later ones belong to the century before
# The characters Python's str.strip() removes (str.isspace()), in code point order.
WHITESPACE = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004"
              "\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")
BOOLEAN_LITERALS = ("true", "false", "yes", "no", "y", "n", "0", "1", "t", "f")
# ---- end of fixed values ----------------------------------------------------

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType,
                 T.FloatType, T.DoubleType, T.DecimalType)
INTEGRAL_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
TIMESTAMP_TYPES = (T.TimestampType, T.TimestampNTZType, T.DateType)


def col(name: str) -> Column:
    """Column by exact name (names may hold dots, spaces or backticks)."""
    return F.col("`" + name.replace("`", "``") + "`")


def cells(df: DataFrame, values: list[Column], *beside: Column) -> DataFrame:
    """A row (``beside``, i, v) per row and value of one type, nulls too: i says which of ``values`` it is.

    What follows is one short piece of code for all columns. Code per column soon is longer than the
    JVM compiles (8000 bytes a method), and is then interpreted row by row.
    """
    return df.select(*beside, F.posexplode(F.array(*values)).alias("i", "v"))


def is_numeric_type(dt: T.DataType) -> bool:
    """pandas ``is_numeric_dtype``: numbers and booleans."""
    return isinstance(dt, NUMERIC_TYPES + (T.BooleanType,))


def is_number_type(dt: T.DataType) -> bool:
    return isinstance(dt, NUMERIC_TYPES)


def is_integral_type(dt: T.DataType) -> bool:
    return isinstance(dt, INTEGRAL_TYPES)


def is_double_type(dt: T.DataType) -> bool:
    return isinstance(dt, (T.FloatType, T.DoubleType))


def is_string_type(dt: T.DataType) -> bool:
    return isinstance(dt, T.StringType)


def is_timestamp_type(dt: T.DataType) -> bool:
    return isinstance(dt, TIMESTAMP_TYPES)


def strip(c: Column) -> Column:
    """Python ``str.strip``: removes its whitespace characters at both ends (linear ``trim``)."""
    return F.trim(c, F.lit(WHITESPACE))


def strip_cell(c: Column) -> Column:
    """``strip`` of a column of short texts: only those that do not begin and end with plain ASCII are trimmed."""
    plain = [F.ascii(x).between(33, 126) for x in (c, F.substring(c, -1, 1))]
    return F.when(plain[0] & plain[1], c).otherwise(strip(c))


def as_double(c: Column, dt: T.DataType) -> Column:
    """Numeric view of a numeric/boolean column (NaN becomes null)."""
    if isinstance(dt, T.BooleanType):
        c = c.cast("int")
    d = c.cast("double")
    return F.when(~F.isnan(d), d)


def parse_number(c: Column, dt: T.DataType) -> Column:
    """pandas ``to_numeric(errors='coerce')`` as a double; null when not numeric."""
    if is_numeric_type(dt):
        return as_double(c, dt)
    if not is_string_type(dt):
        return F.lit(None).cast("double")
    s = strip_cell(c)
    return F.when(s.rlike(NUMERIC_TEXT), s.try_cast("double"))


def parse_timestamp(c: Column, dt: T.DataType) -> Column:
    """Timestamp from a native timestamp or from text in any known format.

    The two common forms of a date alone are cast, and text that begins like no date is left
    after one test; the rest goes through the families. All branches read the stripped text,
    so that Spark strips it once.
    """
    if is_timestamp_type(dt):
        return c.cast("timestamp_ntz")
    if not is_string_type(dt):
        return F.lit(None).cast("timestamp_ntz")
    s = strip_cell(c)
    first, year = F.substring_index(s, "/", 1), F.substring(s, -4, 4)
    second = F.substring_index(F.substring_index(s, "/", 2), "/", -1)
    slashed = [F.concat_ws("-", year, *order).try_cast("timestamp") for order in ((first, second), (second, first))]
    families = F.coalesce(*[F.when(s.rlike(shape), _parse(s, fmt)) for fmt, shape in DATETIME_FAMILIES])
    return (F.when((F.length(s) == 10) & s.rlike(_ISO_DATE), s.try_cast("timestamp"))
            .when((F.length(s) <= 10) & s.rlike(_SLASHED_DATE), F.coalesce(*slashed))
            .otherwise(F.when((F.length(s) <= LONGEST_DATETIME) & s.rlike(_DATETIME_START), families))).cast("timestamp_ntz")


def datetime_mask(s: Column, parsed: Column) -> Column:
    """The form of a stripped text that parsed as a timestamp: a few characters that say its format."""
    capitals = "ABCDEFGHIJKLMNOPQRSUVWXY"
    form = F.translate(s, "0123456789" + capitals + "abcdefghijklmnopqrstuvwxyz", "9" * 10 + "A" * len(capitals) + "a" * 26)
    month = r"(0?[1-9]|1[0-2])"
    marks = F.concat(F.when(s.rlike(rf"^{month}/\d{{1,2}}/\d{{4}}"), "m").otherwise(""),
                     F.when(s.rlike(rf"^\d{{1,2}}/{month}/\d{{4}}$"), "d").otherwise(""))
    iso = (F.length(s) == 10) & (F.substring(s, 5, 1) == "-")  # of what parses, only a date alone
    return F.when(parsed.isNotNull(), F.when(iso, F.lit("9999-99-99")).when(s.contains("/"), F.concat(form, marks)).otherwise(form))


def mask_formats(mask: str) -> list[int]:
    """Numbers of the single formats that a mask has."""
    return [k for k, shape in enumerate(DATETIME_MASKS) if re.fullmatch(shape, mask)]


def _parse(s: Column, fmt: str) -> Column:
    t = F.try_to_timestamp(s, F.lit(fmt))
    if fmt.endswith("/yy"):
        return F.when(F.year(t) > LAST_SHORT_YEAR, t - F.expr("INTERVAL 100 YEAR")).otherwise(t)
    return t


def as_text(c: Column, dt: T.DataType) -> Column:
    """String rendering used for value comparison across types."""
    if isinstance(dt, T.BooleanType):
        return F.when(c, F.lit("True")).when(~c, F.lit("False"))
    return c.cast("string")


def word_count(c: Column) -> Column:
    """Whitespace tokens after strip; null and empty text count 0."""
    s = strip(F.coalesce(c, F.lit("")))
    return F.when(s == "", F.lit(0)).otherwise(F.size(F.split(s, r"(?U)\s+"))).cast("long")


def char_count(c: Column) -> Column:
    """Characters after strip; null counts 0."""
    return F.length(strip(F.coalesce(c, F.lit("")))).cast("long")


def round_value(x: float, digits: int = 0) -> float:
    """Driver-side twin of ``pyround``: half-even on the scaled value, so numbers
    rounded on the driver and in a plan follow one rule."""
    s = 10 ** digits
    return round(x * s) / s


def pyround(c: Column | str, digits: int = 0) -> Column:
    """Python's ``round(x, digits)`` on doubles: half-even on the scaled binary value.

    Spark's ``round``/``bround`` round the double's shortest decimal text
    (16.685 -> 16.69), Python rounds the binary value (16.684999... -> 16.68).
    """
    c = F.col(c) if isinstance(c, str) else c
    s = float(10 ** digits)
    return F.rint(c * s) / s


def comparable(c: Column, dt: T.DataType) -> Column:
    """A value with every map inside replaced by its entries in order of keys, so that Spark can compare and group it."""
    if isinstance(dt, T.MapType):
        entries = F.array_sort(F.map_entries(c), lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0))
        return F.transform(entries, lambda e: F.struct(comparable(e["key"], dt.keyType).alias("k"),
                                                       comparable(e["value"], dt.valueType).alias("v")))
    if isinstance(dt, T.ArrayType) and "map<" in dt.simpleString():
        return F.transform(c, lambda x: comparable(x, dt.elementType))
    if isinstance(dt, T.StructType) and "map<" in dt.simpleString():
        return F.when(c.isNotNull(), F.struct(*[comparable(c[f.name], f.dataType).alias(f"f{i}") for i, f in enumerate(dt.fields)]))
    return c
