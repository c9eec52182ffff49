"""Text functions: HTML cleaning, normalisation, line splitting, search."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Entity table of the cleaning step, in the order of application.
# "&amp;" comes after "&lt;" and "&gt;", so "&amp;lt;" decodes one level only.
ENTITIES_BEFORE_AMP_HEX = [
    ("&lt;", "<"),
    ("&gt;", ">"),
    ("&amp;", "&"),
    ("&quot;", '"'),
    ("&nbsp;", " "),
    ("&apos;", "'"),
    ("&#39;", "'"),
    ("&#x27;", "'"),
    ("&#X27;", "'"),
    ("&#34;", '"'),
    ("&#x22;", '"'),
    ("&#X22;", '"'),
    ("&#38;", "&"),
]
ENTITIES_AFTER_AMP_HEX = [
    ("&#60;", "<"),
    ("&#x3c;", "<"),
    ("&#x3C;", "<"),
    ("&#62;", ">"),
    ("&#x3e;", ">"),
    ("&#x3E;", ">"),
    ("&#160;", " "),
    ("&#xa0;", " "),
    ("&#xA0;", " "),
]

# Unicode space separators (Zs): what a Unicode-aware trim removes.
SPACE_SEPARATORS = (
    " \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u202f\u205f\u3000"
)


def clean_html(col: Column | str, tag_replacement: str = "") -> Column:
    """Strip tags, decode common entities, collapse whitespace, trim; null stays null.

    Entities are literal replacements (a byte search); only the steps that need a
    pattern use one. ``&#x26;`` keeps its pattern because replacing the two
    spellings one after the other could decode twice.
    """
    col = F.col(col) if isinstance(col, str) else col
    text = F.regexp_replace(col, "<[^>]+>", tag_replacement)
    for entity, char in ENTITIES_BEFORE_AMP_HEX:
        text = F.replace(text, F.lit(entity), F.lit(char))
    text = F.regexp_replace(text, "&#[xX]26;", "&")
    for entity, char in ENTITIES_AFTER_AMP_HEX:
        text = F.replace(text, F.lit(entity), F.lit(char))
    # Runs of newlines become one space, then runs of spaces do: together, any
    # run of the three characters becomes one space. Lone spaces are not touched.
    text = F.regexp_replace(text, "[\r\n ]{2,}|[\r\n]", " ")
    return F.btrim(text, F.lit(SPACE_SEPARATORS))


def text_or_empty(col: Column | str) -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


# Characters that NFKC may change: all but those below U+0180 that it leaves alone in any
# combination. Text without them (all of English, French, German, Spanish) never leaves the
# JVM. java.util.regex tries the ranges of a class one by one, so one range stands before it.
_NFKC_UNSAFE = (
    "\u00a0\u00a8\u00aa\u00af\u00b2\u00b3\u00b4\u00b5\u00b8\u00b9\u00ba\u00bc\u00bd\u00be"
    "\u0132\u0133\u013f\u0140\u0149\u017f-\U0010ffff"
)
NFKC_UNSAFE_PATTERN = f"(?=[\u00a0-\U0010ffff])[{_NFKC_UNSAFE}]"


@F.pandas_udf(T.StringType())
def _nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda s: unicodedata.normalize("NFKC", s).lower(), na_action="ignore")


def needs_nfkc(col: Column) -> Column:
    """False for text of which NFKC and lower case are its lower case."""
    not_ascii = F.octet_length(col) != F.char_length(col)
    return not_ascii & col.rlike(NFKC_UNSAFE_PATTERN)


def nfkc_lower(col: Column | str) -> Column:
    """NFKC normalisation and lower case.

    Spark has no normalisation function; the Arrow function sees null for every
    row that does not need it.
    """
    col = F.col(col) if isinstance(col, str) else col
    return F.coalesce(_nfkc(F.when(needs_nfkc(col), col)), F.lower(col))


def contains_ignore_case(col: Column | str, query: str) -> Column:
    """Substring search as typed in a search box; a blank query matches all."""
    col = F.col(col) if isinstance(col, str) else col
    return F.lower(col).contains(query.strip(" \t\n\r\f\v").lower())


LINE_BREAK = "\r\n?|\n"


def without_last_break(parts: Column) -> Column:
    """Drop what a split leaves behind a break at the very end of a text.

    A newline at the end closes the last line, it does not open another; an empty
    text has no lines.
    """
    return F.when(
        F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)
    ).otherwise(parts)
