"""Numbers and normal forms of cells.

The rules are SQL texts over the name of a column (or any SQL expression), each parsed in one call: built of single Column functions they cost a
hundred times as long to make, a fifth of a second for the number of one cell."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The shapes of numbers, tried in this order.
TIME = r"(?U)^\s*(\d+)\s*:\s*(\d+(?:\.\d+)?)\s*$"
MIXED = r"(?U)^\s*(\d+)\s*-\s*(\d+)\s*/\s*(\d+)\s*$"
FRACTION = r"(?U)^\s*(\d+)\s*/\s*(\d+)\s*$"
STRICT = r"(?i)^[-+]?(?:(?:\d+(?:_\d+)*\.?(?:\d+(?:_\d+)*)?|\.\d+(?:_\d+)*)(?:e[-+]?\d+(?:_\d+)*)?|inf(?:inity)?|nan)$"
PLAIN = r"^[-+]?[0-9]{1,15}(?:\.[0-9]{1,15})?$"
FIRST = r"[-+]?\d*\.?\d+(?:[eE][-+]?\d+)?"


#: The characters that are white space.
BLANKS = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def quoted(text: str) -> str:
    """A text as a SQL literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def strip(c: Column) -> Column:
    return F.trim(c, F.lit(BLANKS))


def strip_sql(x: str) -> str:
    return f"trim(BOTH '{BLANKS}' FROM {x})"


def strict_sql(t: str) -> str:
    """The double that a text without commas and blanks around it is as a whole; null if it is none."""
    return f"CASE WHEN {t} RLIKE r'{STRICT}' THEN try_cast(replace({t}, '_', '') AS DOUBLE) END"


def bare_number_sql(bare: str) -> str:
    """The number in a cell that has no blanks around it: a plain one, minutes and seconds, a mixed or plain fraction, a float, or the first
    number in it; null if there is none. Most cells are plain or have no digit, and no other shape is one of these."""
    t = f"replace({bare}, ',', '')"
    part = lambda p, i: f"try_cast(regexp_extract({t}, r'{p}', {i}) AS DOUBLE)"
    return (f"CASE WHEN {bare} IS NULL OR {bare} = '' THEN CAST(NULL AS DOUBLE) WHEN {t} RLIKE r'{PLAIN}' THEN try_cast({t} AS DOUBLE) WHEN NOT {t} RLIKE r'(?U)\\d' THEN {strict_sql(t)} "
            f"WHEN {t} RLIKE r'{TIME}' THEN {part(TIME, 1)} * 60.0D + {part(TIME, 2)} WHEN {t} RLIKE r'{MIXED}' THEN {part(MIXED, 1)} + try_divide({part(MIXED, 2)}, {part(MIXED, 3)}) "
            f"WHEN {t} RLIKE r'{FRACTION}' THEN try_divide({part(FRACTION, 1)}, {part(FRACTION, 2)}) ELSE coalesce({strict_sql(t)}, try_cast(regexp_substr({t}, r'{FIRST}') AS DOUBLE)) END")


def number_sql(x: str) -> str:
    return bare_number_sql(strip_sql(x))


def bare_text_sql(bare: str) -> str:
    """The normal form of a cell that has no blanks around it: HTML quotes and one pair of outer quotes off, trimmed, lower case."""
    t = f"replace(replace(coalesce({bare}, ''), '&#34;', '\"'), '&quot;', '\"')"
    return f"lower({strip_sql(unquoted_sql(t))})"


def unquoted_sql(t: str) -> str:
    """A text without one pair of quotes around it."""
    return f"CASE WHEN length({t}) >= 2 AND startswith({t}, '\"') AND endswith({t}, '\"') THEN substring({t}, 2, length({t}) - 2) ELSE {t} END"


def text_sql(x: str) -> str:
    return bare_text_sql(strip_sql(x))


def parse_number(x: str) -> Column:
    """The number in a column's cells."""
    return F.expr(number_sql(x))


def norm_text(x: str) -> Column:
    """A column's cells for comparison as text."""
    return F.expr(text_sql(x))
