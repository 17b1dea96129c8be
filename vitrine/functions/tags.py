"""Tag cells -> ARRAY<STRING> of cleaned tags (the rules of the tag counter).

Cell rules, in order: missing -> none; Python literal, then JSON; a dict
gives its keys; a list/tuple gives its elements (a dict element gives the
value of the first of tag/name/label present, else its keys; a list element
gives its first item); another scalar gives one token; text that parses as
neither is split on commas.  Tokens are then cleaned.  List results are
de-duplicated (order kept) after cleaning; dict results are not, so
``{'3D': 5, 'D': 2}`` yields ``D`` twice.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vitrine.functions import literals
from vitrine.functions.text import (
    DICT_STRING_TO_NUMBER_RE,
    EMPTY_LIST_RE,
    LIST_OF_STRINGS_RE,
    PY_DIGIT_NONWORD_CLASS,
    QUOTED_ITEM_RE,
    QUOTED_STRING_RE,
    py_strip,
    quoted_items,
    unquote,
)

_STRIP = PY_DIGIT_NONWORD_CLASS


def clean_tag_token(tok: Column) -> Column:
    """Clean one raw token; NULL when nothing is left.

    strip blanks; strip quote characters; keep the text before the first of
    ``: ( [ ] )``; keep the text before the first comma and strip blanks;
    remove leading and trailing digits, punctuation and ``_``.
    ``3D Platformer`` -> ``D Platformer``, ``C++`` -> ``C``, ``1980s`` -> ``s``.
    """
    t = py_strip(tok)
    t = F.regexp_replace(t, "^['\"]+|['\"]+\\z", "")
    t = F.regexp_extract(t, "^[^:(\\[\\])]*", 0)
    t = py_strip(F.regexp_extract(t, "^[^,]*", 0))
    t = F.regexp_replace(t, f"^{_STRIP}+|{_STRIP}+\\z", "")
    return F.nullif(t, F.lit(""))


def _clean_all(tokens: Column) -> Column:
    return F.filter(F.transform(tokens, clean_tag_token), lambda x: x.isNotNull())


def _comma_tokens(c: Column) -> Column:
    parts = F.transform(F.split(c, ","), py_strip)
    return F.filter(parts, lambda x: x != F.lit(""))


def tag_array(c) -> Column:
    """ARRAY<STRING> of cleaned tags of one cell (empty when none)."""
    c = F.col(c) if isinstance(c, str) else c
    c = c.cast("string")
    is_dict = c.rlike(DICT_STRING_TO_NUMBER_RE)
    is_list = c.rlike(LIST_OF_STRINGS_RE)
    is_str = c.rlike(QUOTED_STRING_RE)
    is_empty = c.rlike(EMPTY_LIST_RE)
    # Text that is neither a Python literal nor JSON: starts with a letter,
    # is not a keyword either language knows, and carries no quote.
    plain = (
        c.rlike("^\\s*\\p{L}")
        & ~c.rlike("^\\s*(?:True|False|None|set\\s*\\(|true|false|null|NaN|Infinity)")
        & ~(c.contains("'") | c.contains('"'))
    )
    residue = ~is_dict & ~is_list & ~is_str & ~is_empty & ~plain
    parsed = literals.tag_tokens_udf(F.when(residue, c))
    empty = F.array().cast("array<string>")
    return (
        F.when(c.isNull(), empty)
        # Python dicts collapse equal raw keys; cleaned duplicates stay.
        .when(is_dict, _clean_all(F.array_distinct(quoted_items(c))))
        .when(is_list, F.array_distinct(_clean_all(quoted_items(c))))
        .when(is_str, _clean_all(F.array(unquote(F.regexp_extract(c, QUOTED_ITEM_RE, 1)))))
        .when(is_empty, empty)
        .when(plain, F.array_distinct(_clean_all(_comma_tokens(c))))
        .when(
            parsed["from_dict"],
            _clean_all(parsed["tokens"]),
        )
        .otherwise(F.array_distinct(_clean_all(F.coalesce(parsed["tokens"], empty))))
    )
