"""Derived columns of the catalogue table (category, year, numbers, ranges).

All functions map Column -> Column.  Literal parsing is tiered: strict
shapes are evaluated with native regex (tier 1); cells that fail every
shape but could still be a Python literal go to an Arrow UDF (tier 2);
the rest cannot be a literal and get the fallback value natively (tier 3).
The UDF input is NULL outside tier 2, so Python sees only residue cells.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vitrine.functions import literals
from vitrine.functions.text import (
    DICT_STRING_TO_NUMBER_RE,
    EMPTY_LIST_RE,
    LIST_OF_STRINGS_RE,
    PY_WHITESPACE_CLASS,
    QUOTED_ITEM_RE,
    QUOTED_STRING_RE,
    py_strip,
    quoted_items,
    unquote,
)

def _null_str() -> Column:
    return F.lit(None).cast("string")

_WS = PY_WHITESPACE_CLASS


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def may_be_python_literal(c: Column) -> Column:
    """False only for cells that cannot evaluate as a Python literal.

    A literal starts with a quote, bracket, brace, parenthesis, digit, dot or
    sign, or is True/False/None/set(); string prefixes (b'', u'') carry a
    quote.  A cell that starts with a letter and has no quote is a name or
    plain text.
    """
    letter_start = c.rlike("^\\s*\\p{L}")
    keyword = c.rlike("^\\s*(?:True|False|None|set\\s*\\()")
    has_quote = c.contains("'") | c.contains('"')
    return ~letter_start | keyword | has_quote


# --------------------------------------------------------------------- D1
def primary_category(c) -> Column:
    """First element of a Python list literal; a string literal itself; else NULL.

    ``['Action', 'Indie']`` -> Action, ``'Action'`` -> Action; empty list,
    tuple, dict, bare word, malformed text, NULL -> NULL.
    """
    c = _col(c)
    is_list = c.rlike(LIST_OF_STRINGS_RE)
    is_str = c.rlike(QUOTED_STRING_RE)
    is_empty = c.rlike(EMPTY_LIST_RE)
    # Without a quote or "[" no literal can be a non-empty list or a str.
    residue = (
        ~is_list & ~is_str & ~is_empty & (c.contains("'") | c.contains('"') | c.contains("["))
    )
    return (
        F.when(c.isNull(), _null_str())
        .when(is_list, F.element_at(quoted_items(c), 1))
        .when(is_str, unquote(F.regexp_extract(c, QUOTED_ITEM_RE, 1)))
        .when(residue, literals.first_category_udf(F.when(residue, c)))
        .otherwise(_null_str())
    )


# -------------------------------------------------------------------- D14
def genre_list(c, all_genres: bool = False) -> Column:
    """Notebook ``genre_list`` followed by ``explode``: ARRAY<STRING> per cell.

    A non-empty list gives its first element only, or every element with
    ``all_genres``; tuples, sets and dicts (keys) are exploded whole; scalars pass through; empty list-likes, NULL
    and unparseable text give an empty array.  Explode the result to get
    one row per value.
    """
    c = _col(c)
    is_list = c.rlike(LIST_OF_STRINGS_RE)
    is_str = c.rlike(QUOTED_STRING_RE)
    is_empty = c.rlike(EMPTY_LIST_RE)
    is_dict = c.rlike(DICT_STRING_TO_NUMBER_RE)
    residue = ~is_list & ~is_str & ~is_empty & ~is_dict & may_be_python_literal(c)
    empty = F.array().cast("array<string>")
    return (
        F.when(c.isNull(), empty)
        .when(is_list, quoted_items(c) if all_genres else F.slice(quoted_items(c), 1, 1))
        .when(is_str, F.array(unquote(F.regexp_extract(c, QUOTED_ITEM_RE, 1))))
        .when(is_empty, empty)
        .when(is_dict, F.array_distinct(quoted_items(c)))
        .when(residue, (literals.all_genres_udf if all_genres else literals.genre_list_udf)(
            F.when(residue, c)))
        .otherwise(empty)
    )


# --------------------------------------------------------------------- D2
def release_year(c, fmt: str = "yyyy-MM-dd") -> Column:
    """Year of a date text in one fixed format; anything else is NULL.

    Date and timestamp columns are used directly.
    """
    c = _col(c)
    return F.year(F.try_to_date(c.cast("string"), fmt)).cast("int")


def year_of(c) -> Column:
    """Year of a DATE/TIMESTAMP column as INT."""
    return F.year(_col(c)).cast("int")


# --------------------------------------------------------------------- D3
# What pandas.to_numeric accepts from text: optional sign, decimal digits
# with optional fraction and exponent, or inf/infinity; blanks around.
_NUMERIC_TEXT_RE = (
    "(?i)^[ \\t\\n\\x0B\\f\\r]*[+-]?(?:(?:[0-9]+\\.?[0-9]*|\\.[0-9]+)(?:e[+-]?[0-9]+)?"
    "|inf|infinity)[ \\t\\n\\x0B\\f\\r]*\\z"
)


def to_number(c, dtype: str | None = None) -> Column:
    """``pd.to_numeric(errors="coerce")``: bad text and NaN become NULL.

    Text is first checked against the shapes pandas accepts (Spark's cast
    also takes ``1d``/``1f`` suffixes, pandas does not).  Numeric columns are
    cast to DOUBLE.
    """
    c = _col(c)
    if dtype is not None and dtype not in ("string",):
        v = c.cast("double")
    else:
        s = c.cast("string")
        v = F.when(s.rlike(_NUMERIC_TEXT_RE), s.try_cast("double"))
    return F.when(F.isnan(v), F.lit(None).cast("double")).otherwise(v)


def to_number_typed(df, name: str) -> Column:
    """``to_number`` choosing the cast from the column's type in ``df``."""
    dtype = dict(df.dtypes)[name]
    return to_number(F.col(name), dtype)


# ------------------------------------------------------------ D5, D6, D8
# The dash characters read as "-" in owner ranges (en dash,
# em dash, minus sign), and the whole-cell range pattern (digits with
# thousands commas, optional decimals, optional "- high"), written for Java
# with Python's whitespace and Unicode-digit classes.
_DASHES = "[–—−]"
_RANGE_APP_RE = (
    f"^{_WS}*([0-9,]+(?:\\.\\p{{Nd}}+)?){_WS}*(?:-{_WS}*([0-9,]+(?:\\.\\p{{Nd}}+)?))?{_WS}*\\z"
)
_RANGE_NOTEBOOK_RE = f"^{_WS}*([\\p{{Nd}},]+){_WS}*-{_WS}*([\\p{{Nd}},]+)"


def _number_without_commas(text: Column) -> Column:
    return F.regexp_replace(text, ",", "").try_cast("double")


def owner_range(c) -> Column:
    """App variant: STRUCT<low, high, mid> from ``low - high`` text.

    Dashes (en, em, minus) count as ``-``; the whole cell must match;
    thousands commas and decimals allowed; a single number gives
    high = low; anything else NULL; low > high is kept as is.
    """
    s = F.regexp_replace(F.coalesce(_col(c).cast("string"), F.lit("")), _DASHES, "-")
    matched = s.rlike(_RANGE_APP_RE)
    low = F.when(matched, _number_without_commas(F.regexp_extract(s, _RANGE_APP_RE, 1)))
    high_raw = F.when(matched, _number_without_commas(F.regexp_extract(s, _RANGE_APP_RE, 2)))
    high = F.coalesce(high_raw, low)
    return F.struct(low.alias("low"), high.alias("high"), ((low + high) / 2.0).alias("mid"))


def owner_range_prefix(c) -> Column:
    """Notebook variant: STRUCT<low, high, mid>; prefix match, ASCII ``-`` only.

    ``100 - 200 copies`` -> 100/200/150; else a digits-only cell (commas
    removed, blanks stripped) -> v/v/v; else NULL.
    """
    s = _col(c).cast("string")
    matched = s.rlike(_RANGE_NOTEBOOK_RE)
    low_m = _number_without_commas(F.regexp_extract(s, _RANGE_NOTEBOOK_RE, 1))
    high_m = _number_without_commas(F.regexp_extract(s, _RANGE_NOTEBOOK_RE, 2))
    clean = py_strip(F.regexp_replace(s, ",", ""))
    single = F.when(clean.rlike("^[0-9]+\\z"), clean.try_cast("double"))
    low = F.when(matched, low_m).otherwise(single)
    high = F.when(matched, high_m).otherwise(single)
    mid = F.when(matched, (low_m + high_m) / 2.0).otherwise(single)
    return F.struct(low.alias("low"), high.alias("high"), mid.alias("mid"))


def error_bounds(low, mid, high, mode: str = "clip") -> tuple[Column, Column]:
    """Asymmetric error bars ``(plus, minus) = (high - mid, mid - low)``.

    mode ``clip``: NULL -> 0 and floored at 0; ``abs``: absolute value;
    ``raw``: plain differences.
    """
    plus = _col(high) - _col(mid)
    minus = _col(mid) - _col(low)
    if mode == "clip":
        return (F.greatest(F.coalesce(plus, F.lit(0.0)), F.lit(0.0)),
                F.greatest(F.coalesce(minus, F.lit(0.0)), F.lit(0.0)))
    if mode == "abs":
        return F.abs(plus), F.abs(minus)
    if mode == "raw":
        return plus, minus
    raise ValueError(f"unknown error-bound mode {mode!r}")


# ----------------------------------------------------------- D7, D9, D10
def is_free(price) -> Column:
    """``price == 0``; a missing price is False."""
    return F.coalesce(_col(price) == 0, F.lit(False))


def year_label(year) -> Column:
    """Text year for point details; a missing year prints ``<NA>``."""
    return F.coalesce(_col(year).cast("string"), F.lit("<NA>"))


def range_label(low, high) -> Column:
    """``"{low:,} - {high:,}"`` with values truncated to integers; ``""`` if missing."""
    lo, hi = _col(low), _col(high)
    text = F.concat(
        F.format_number(lo.cast("bigint"), 0), F.lit(" - "), F.format_number(hi.cast("bigint"), 0)
    )
    return F.when(lo.isNotNull() & hi.isNotNull(), text).otherwise(F.lit(""))
