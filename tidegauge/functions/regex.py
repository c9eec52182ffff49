"""Regular expressions with the semantics of the two engines the data was made with.

Taxonomy patterns were written for RE2 (ASCII ``\\b``, ASCII classes), scan rules
for Python's ``re`` (Unicode ``\\b`` and classes). Spark evaluates
``java.util.regex``, whose ``\\b``, ``\\s``, ``.`` and ``$`` differ from both, so
patterns are rewritten once on the driver and stay constants in the plan.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidegauge.functions.loops import possessive_loops

_ASCII = {
    "word": "[A-Za-z0-9_]",
    "space": r"\t\n\f\r ",
    "end": r"\z",
}
_UNICODE = {
    "word": r"[\p{L}\p{N}_]",
    "space": r"\t\n\x0B\f\r\x1C-\x1F\x85\p{Z} ",
    "end": r"(?=\n?\z)",
}
_NAMED = re.compile(r"\(\?P?<([A-Za-z_][A-Za-z0-9_]*)>|\(\?P=([A-Za-z0-9_]+)\)")
_POSIX = re.compile(r"\[:(\^?)([a-z]+):\]")
_POSIX_CLASSES = {
    "alpha": "A-Za-z",
    "digit": "0-9",
    "alnum": "A-Za-z0-9",
    "upper": "A-Z",
    "lower": "a-z",
    "word": "A-Za-z0-9_",
    "xdigit": "A-Fa-f0-9",
    "space": r"\t\n\x0B\f\r ",
    "blank": r"\t ",
}

# Turkish i letters fold to "i" in java.util.regex but to nothing in RE2. Private-use
# characters stand in for them, in text and pattern; they fold to nothing anywhere.
# (Known residue: a class range that only spans these letters does not see them.)
_TURKISH_I = "\u0130\u0131"
_NEUTRAL = "\ue000\ue001"


def java_pattern(pattern: str, *, unicode_words: bool = False, ignore_case: bool = True) -> str:
    """Rewrite an RE2 (or, with ``unicode_words``, Python) pattern for Spark.

    Loops that the next character decides take neither stack nor backtracking; a pattern
    whose nested loops are ambiguous is an error (see ``possessive_loops``).
    """
    return _rewritten(possessive_loops(pattern), unicode_words, ignore_case)


def _group_name(name: str) -> str:
    """java.util.regex takes no underscore in the name of a group."""
    return name.replace("_", "U95")


def _rewritten(pattern: str, unicode_words: bool = False, ignore_case: bool = True) -> str:
    kind = _UNICODE if unicode_words else _ASCII
    word = kind["word"]
    # (?-iu:...) keeps case folding out of the class: under (?iu) [A-Za-z] would
    # also accept U+017F and U+212A as word characters.
    boundary = f"(?-iu:(?<!{word})(?={word})|(?<={word})(?!{word}))"
    no_boundary = f"(?-iu:(?<!{word})(?!{word})|(?<={word})(?={word}))"
    multiline = re.search(r"\(\?[a-z]*m", pattern) is not None
    outside = {
        "b": boundary,
        "B": no_boundary,
        "s": f"[{kind['space']}]",
        "S": f"[^{kind['space']}]",
        "Z": r"\z",
    }
    inside = {"s": kind["space"], "S": f"[^{kind['space']}]"}
    # Spelled out, so that folding applies to them as it does in RE2.
    outside |= {"w": "[A-Za-z0-9_]", "W": "[^A-Za-z0-9_]"}
    inside |= {"w": "A-Za-z0-9_", "W": "[^A-Za-z0-9_]"}
    if unicode_words:
        outside |= {"w": word, "W": r"[^\p{L}\p{N}_]", "d": r"\p{Nd}", "D": r"\P{Nd}"}
        inside |= {"w": r"\p{L}\p{N}_", "W": r"[^\p{L}\p{N}_]", "d": r"\p{Nd}", "D": r"\P{Nd}"}

    out: list[str] = []
    position, in_class = 0, False
    while position < len(pattern):
        char = pattern[position]
        if char == "\\" and position + 1 < len(pattern):
            escaped = pattern[position + 1]
            if escaped == "Q":
                stop = pattern.find("\\E", position)
                stop = len(pattern) if stop < 0 else stop + 2
                out.append(pattern[position:stop])
                position = stop
                continue
            table = inside if in_class else outside
            out.append(table.get(escaped, char + escaped))
            position += 2
        elif in_class:
            posix = _POSIX.match(pattern, position)
            if posix:
                out.append(f"[{posix[1]}{_POSIX_CLASSES[posix[2]]}]")
                position = posix.end()
                continue
            if char == "]":
                in_class = False
            # "[" opens a nested class and "&&" an intersection in Java only.
            out.append("\\" + char if char in "[&" else char)
            position += 1
        elif char == "[":
            in_class = True
            position += 1
            out.append("[")
            if pattern.startswith("^", position):
                out.append("^")
                position += 1
            if pattern.startswith("]", position):
                out.append("\\]")
                position += 1
        elif char == "$" and not multiline:
            out.append(kind["end"])
            position += 1
        elif named := _NAMED.match(pattern, position):
            name = _group_name(named[1] or named[2])
            out.append(f"(?<{name}>" if named[1] else f"\\k<{name}>")
            position = named.end()
        else:
            out.append(char)
            position += 1
    flags = "(?iud)" if ignore_case else "(?d)"
    return flags + "".join(out)


def re2_subject(col: Column) -> Column:
    """Text in the form RE2-style matching expects (see ``_TURKISH_I``)."""
    return F.when(
        col.contains(_TURKISH_I[0]) | col.contains(_TURKISH_I[1]),
        F.translate(col, _TURKISH_I, _NEUTRAL),
    ).otherwise(col)


def re2_match(col: Column | str, pattern: str) -> Column:
    """Case-insensitive ``regexp_matches(col, pattern, 'i')`` with RE2 semantics."""
    col = F.col(col) if isinstance(col, str) else col
    neutral = pattern.translate(str.maketrans(_TURKISH_I, _NEUTRAL))
    return re2_subject(col).rlike(java_pattern(neutral))


# Characters that fold to an ASCII letter although they are none: long s, Kelvin
# sign, dotted and dotless i.
FOLDING_CHARACTERS = "\u017f\u212a\u0130\u0131"

_RANGE = re.compile(r"([^\\\[])-([^\]])")
_WORD_AHEAD = re.compile(
    r"\\b(?=(?:\[(?:[a-z0-9_]-[a-z0-9_]|[a-z0-9_])+\]|[a-z0-9_])(?![*?]|\{0|\{,))"
)
_WORD_GROUP = re.compile(r"\\b\(([^()\[\]]+)\)\\b")


def folds_oddly(col: Column, characters: str = FOLDING_CHARACTERS) -> Column:
    """True for text on which lower-casing is no substitute for ignoring case."""
    tests = [col.contains(c) for c in characters]
    return reduce(lambda a, b: a | b, tests)


def matches_lower_case(pattern: str) -> bool:
    """Can the pattern be tested, case-sensitively, on lower-cased text?

    True for patterns of ASCII and Latin-1 letters without capitals, ranges other
    than within a-z, 0-9 or à-ÿ, numeric escapes and inline flags.
    Case-sensitive matching is several times faster in java.util.regex.
    """
    if not re.fullmatch("[\\x00-\\x7fà-öø-ÿ]*", pattern):
        return False
    if re.search(r"\(\?(?!:)|\\[xpPQ0-9cu]|\[:", pattern):
        return False
    if re.search(r"[A-Z]", re.sub(r"\\.", "", pattern)):
        return False
    classes = re.findall(r"\[(?:\\.|[^\]\\])*\]", pattern)
    ranges = [r for c in classes for r in _RANGE.findall(c[1:-1].lstrip("^"))]
    return all(
        (a.isdigit() and b.isdigit())
        or (a.isalpha() and b.isalpha() and a.isascii() == b.isascii())
        for a, b in ranges
    )


def lower_case_pattern(pattern: str, *, unicode_words: bool = False) -> str:
    """Spark form of a pattern for which ``matches_lower_case`` holds.

    A boundary next to a literal word character needs to look one way only; in
    ``\\b(word|other)\\b`` both do. The first letters go ahead of everything, as
    the cheapest test at a position where nothing matches.
    """
    pattern = possessive_loops(pattern)
    group = _WORD_GROUP.fullmatch(pattern)
    if group:
        branches = group[1].split("|")
        plain = all(
            re.match(r"[a-z0-9_](?![*?{])", b) and re.search(r"(?<!\\)[a-z0-9_]$", b)
            for b in branches
        )
        if plain:
            word = (_UNICODE if unicode_words else _ASCII)["word"]
            body = _rewritten(group[1], unicode_words, ignore_case=False)
            first = "".join(sorted({b[0] for b in branches}))
            return f"(?d)(?=[{first}])(?<!{word})(?:{body.removeprefix('(?d)')})(?!{word})"
    if _WORD_AHEAD.match(pattern):
        word = (_UNICODE if unicode_words else _ASCII)["word"]
        rest = _rewritten(pattern[2:], unicode_words, ignore_case=False)
        return f"(?d)(?<!{word}){rest.removeprefix('(?d)')}"
    return _rewritten(pattern, unicode_words, ignore_case=False)


def required_words(pattern: str) -> list[str] | None:
    """Literals of which a matching text must contain at least one, or ``None``.

    Understands alternations of plain ASCII words, e.g. ``\\b(node\\.js|nodejs)\\b``;
    any other construct gives ``None`` and the pattern is then always evaluated.
    """
    body = re.sub(r"^\\b|\\b$", "", pattern)
    grouped = re.fullmatch(r"\((?:\?:)?([^()]*)\)", body)
    body = grouped[1] if grouped else body
    words = []
    for branch in body.split("|"):
        pieces = [p.replace("\\.", ".") for p in re.split(r"\\s\+", branch)]
        if not all(re.fullmatch(r"[A-Za-z0-9_#\- .]+", p) for p in pieces):
            return None
        if any("." in p for p in re.split(r"\\s\+|\\\.", branch)):
            return None  # a bare dot is a wildcard
        words.append(max(pieces, key=len).lower())
    return sorted(set(words))


def contains_any(low: Column, words: list[str]) -> Column:
    test = low.contains(words[0])
    for word in words[1:]:
        test = test | low.contains(word)
    return test


_BOUNDED = re.compile(r"(\\b)?(?:\((?:\?:)?([^()]*)\)|([^()|]*?))(\\b)?")


def whole_words(pattern: str) -> dict[str, bool] | None:
    """Words of which a matching text has at least one, as a whole word, or ``None``.

    The value says whether having the word is a match already, as it is a branch by itself.

    A word counts where the branch itself, or a ``\\b`` at its end, bounds it. Understands
    alternations of literal text with ``\\s+`` and escaped marks; of each branch the
    longest bounded word is taken.
    """
    found = _BOUNDED.fullmatch(pattern)
    if not found:
        return None
    lead, grouped, plain, tail = found.groups()
    words: dict[str, bool] = {}
    for branch in (plain if grouped is None else grouped).split("|"):
        text = re.sub(r"\\s\+|\\[^\w\s]", "\0", branch)
        if not re.fullmatch(r"[A-Za-z0-9_ #/&,:;@%=\0-]+", text):
            return None
        bounded = [
            w[0].lower()
            for w in re.finditer("[A-Za-z0-9_]+", text)
            if (w.start() > 0 or lead) and (w.end() < len(text) or tail)
        ]
        if not bounded:
            return None
        word = max(bounded, key=len)
        words[word] = words.get(word, False) or word == text.lower()
    return words


def has_references(pattern: str) -> bool:
    """Does the pattern name groups or refer back to them? Such a pattern stands alone."""
    return re.search(r"\\[1-9]|\\k<|\(\?P?<[A-Za-z_]|\(\?P=", re.sub(r"\\\\", "", pattern)) is not None
