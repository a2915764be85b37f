"""Column expressions over text: trimming, request lines, empty values, word search."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters removed at both ends of a line (fixed value: Unicode white space).
WHITE_SPACE = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def strip(col: Column) -> Column:
    return F.btrim(col, F.lit(WHITE_SPACE))


def digits_only(col: Column) -> Column:
    return F.regexp_replace(col, "[^0-9]", "")


def first_chars(col: Column, n: int = 2) -> Column:
    return F.substring(col, 1, n)


def request_parts(request: Column, words: Column | None = None) -> dict[str, Column]:
    """Method, path, arguments and protocol of a request line.

    Blank: all empty.  One or two words (scans and attacks): the whole text is the URL.
    Three or more: words 1 to 3, the second cut at ``?``; text after another ``?`` and
    later words are dropped.  ``words`` is the request split at spaces, if at hand.
    """
    words = request_words(request) if words is None else words
    whole = F.size(words) >= 3
    empty = F.lit("")
    target = F.get(words, F.lit(1))
    return {
        "request_method": F.when(whole, F.get(words, F.lit(0))).otherwise(empty),
        "request_url": F.when(whole, F.split_part(target, F.lit("?"), F.lit(1))).otherwise(
            F.coalesce(F.get(words, F.lit(0)), empty)
        ),
        "args": F.when(whole, F.split_part(target, F.lit("?"), F.lit(2))).otherwise(empty),
        "server_protocol": F.when(whole, F.get(words, F.lit(2))).otherwise(empty),
    }


def request_words(request: Column) -> Column:
    """The words of a request of three or more, else its whole text as the only word."""
    words = F.split(request, " ")
    # Only a request that starts with something odd can be blank; the others are spared
    # the look at both their ends.
    odd = ~F.get(words, F.lit(0)).between("!", "~~")
    return (
        F.when(odd & (strip(request) == ""), F.array().cast("array<string>"))
        .when(F.size(words) >= 3, words)
        .otherwise(F.array(request))
    )


def stored_text(col: Column, normalise: bool = True) -> Column:
    """Text as stored: ``-`` for empty, surrounding double quotes removed."""
    if not normalise:
        return col
    quoted = F.contains(col, F.lit('"'))
    return F.when(col == "", F.lit("-")).when(quoted, F.btrim(col, F.lit('"'))).otherwise(col)


def stored_number(col: Column, kind: str, normalise: bool = True) -> Column:
    """Number as stored: 0 for empty or ``-``; NULL for text that is no number."""
    if kind == "double":
        value = F.round(col.try_cast("double"), 3)
    else:
        value = col.try_cast(kind)
    if not normalise:
        return value
    return F.when(col.isin("", "-"), F.lit(0).cast(kind)).otherwise(value)


# ---------------------------------------------------------------- word search

_WORD = r"[\p{L}\p{N}_]"


def has_word(col: Column, word: str) -> Column:
    """Whole-word, case-insensitive containment."""
    w = re.sub(r"([^\w])", r"\\\1", word.lower())
    # The word comes first so that the scan is a plain substring search; its
    # neighbours are looked at only where it occurs.
    return F.rlike(F.lower(col), F.lit(f"{w}(?<!{_WORD}{w})(?!{_WORD})"))


def has_substring(col: Column, text: str) -> Column:
    """Case-sensitive containment."""
    return F.contains(col, F.lit(text))


def fulltext_words(query: str, mode: str = "natural") -> tuple[list[str], list[str], list[str]]:
    """The required, excluded and optional words of a word list."""
    words = query.split()
    if mode == "natural":
        required, excluded, optional = [], [], words
    elif mode == "boolean":
        required = [w[1:] for w in words if w.startswith("+")]
        excluded = [w[1:] for w in words if w.startswith("-")]
        optional = [w for w in words if w[0] not in "+-"]
    else:
        raise ValueError("mode must be 'natural' or 'boolean'")
    if any(not w for w in required + excluded):
        raise ValueError(f"a sign without a word in {query!r}")
    return required, excluded, optional


def fulltext(col: Column, query: str, mode: str = "natural") -> Column:
    """Word-list search.

    ``natural``: any of the words.  ``boolean``: ``+word`` must occur, ``-word`` must
    not; plain words count only where no ``+word`` is given, and then one must occur.
    """
    required, excluded, optional = fulltext_words(query, mode)
    if required:
        found = _all(has_word(col, w) for w in required)
    elif optional:
        found = ~_all(~has_word(col, w) for w in optional)
    else:
        return F.lit(False)
    return found & _all(~has_word(col, w) for w in excluded) if excluded else found


def _all(conditions) -> Column:
    conditions = iter(conditions)
    out = next(conditions)
    for c in conditions:
        out = out & c
    return out
