"""Text helpers shared by the cell parsers.

Everything here is a plain Spark column expression (Java regex), so it runs
inside whole-stage codegen.  Regexes end with ``\\z`` rather than ``$``:
Java's ``$`` also matches before a final line terminator such as U+2028,
which Python's literal parser rejects.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference's behaviour)
# ---------------------------------------------------------------------------
# Characters Python's str.strip() removes (str.isspace() is true), in code
# point order: TAB LF VT FF CR, FS GS RS US, SPACE, NEL, NBSP, OGHAM SPACE,
# U+2000..U+200A, LINE SEP, PARAGRAPH SEP, NNBSP, MMSP, IDEOGRAPHIC SPACE.
PY_WHITESPACE_CLASS = (
    "[\\t\\n\\x0B\\f\\r\\x1C\\x1D\\x1E\\x1F \\x{85}\\x{A0}\\x{1680}"
    "\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]"
)
# Python's r"[\d\W_]" on str: decimal digits, non-word characters and "_".
# Word characters are letters and numerics, so the class keeps exactly
# letters (L*), letter numbers (Nl) and other numbers (No).  Categories come
# from the JVM's Unicode tables (Java 17: Unicode 13); a letter assigned in
# a later Unicode version than the JVM knows counts as punctuation here.
PY_DIGIT_NONWORD_CLASS = "[^\\p{L}\\p{Nl}\\p{No}]"
# Pandas read_csv default missing-value tokens.
PANDAS_NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
)

# ---------------------------------------------------------------------------
# Strict shapes of Python literals that are evaluated natively (tier 1).
# Anything else that might be a literal is routed to the Arrow UDF (tier 2).
# ---------------------------------------------------------------------------
# A quoted string without escapes, line breaks or NUL.
_Q = "(?:'[^'\\\\\\n\\r\\x00]*+'|\"[^\"\\\\\\n\\r\\x00]*+\")"
# A non-negative or negative decimal number as Python writes it.
_N = "-?+(?:0|[1-9][0-9]*+)(?:\\.[0-9]++)?+"
# Whitespace Python ignores inside brackets, restricted to the common ones.
_W = "[ \\t\\n]*+"

LIST_OF_STRINGS_RE = (
    f"^[ \\t]*+\\[{_W}{_Q}(?:{_W},{_W}{_Q})*+{_W},?+{_W}\\]{_W}\\z"
)
DICT_STRING_TO_NUMBER_RE = (
    f"^[ \\t]*+\\{{{_W}{_Q}{_W}:{_W}{_N}"
    f"(?:{_W},{_W}{_Q}{_W}:{_W}{_N})*+{_W},?+{_W}\\}}{_W}\\z"
)
QUOTED_STRING_RE = f"^[ \\t]*+{_Q}{_W}\\z"
EMPTY_LIST_RE = f"^[ \\t]*+\\[{_W}\\]{_W}\\z"
QUOTED_ITEM_RE = f"({_Q})"


def py_strip(c: Column) -> Column:
    """Python ``str.strip()`` (Unicode whitespace), unlike Spark's ``trim``."""
    ws = PY_WHITESPACE_CLASS
    return F.regexp_replace(c, f"^{ws}+|{ws}+\\z", "")


def unquote(c: Column) -> Column:
    """Drop the first and last character of a quoted literal."""
    return F.substring(c, F.lit(2), F.length(c) - F.lit(2))


def quoted_items(c: Column) -> Column:
    """All quoted items of a cell already known to match a tier-1 shape."""
    return F.transform(F.regexp_extract_all(c, F.lit(QUOTED_ITEM_RE), 1), unquote)


def null_if_na_token(c: Column, tokens: tuple[str, ...] = PANDAS_NA_TOKENS) -> Column:
    """NULL for cells equal to one of pandas' missing-value tokens."""
    return F.when(c.isin(*tokens), F.lit(None).cast("string")).otherwise(c)
