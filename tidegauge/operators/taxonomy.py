"""Tagging text against a regex taxonomy."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.functions.regex import (
    contains_any,
    folds_oddly,
    java_pattern,
    lower_case_pattern,
    matches_lower_case,
    re2_match,
    re2_subject,
    required_words,
    whole_words,
)
from tidegauge.functions.wordindex import WordIndex
from tidegauge.session import spread

# A taxonomy is part of the plan: patterns to try on every text. One beyond this is an error.
MAX_TERMS = 20_000
# Patterns in one array of the projection, so that generated methods stay small.
TERMS_PER_ARRAY = 50

# From so many terms on, those with a whole word are found by it instead of one by one.
INDEXED_FROM = 32

_TEXT, _LOW, _ODD = "__text", "__low", "__odd"


@dataclass(frozen=True)
class Term:
    key: str
    name: str
    category: str
    pattern: str


def terms_from(rows: Iterable[tuple[str, str, str, str]]) -> list[Term]:
    return [Term(*row) for row in rows]


def plan_terms(taxonomy: DataFrame | list[Term]) -> list[Term]:
    """The terms as constants. A table is read once, here, and must be of bounded size."""
    if isinstance(taxonomy, list):
        terms = taxonomy
    else:
        rows = taxonomy.select("tech_key", "display_name", "category", "regex_pattern").limit(MAX_TERMS + 1)
        terms = terms_from(map(tuple, rows.collect()))
    if len(terms) > MAX_TERMS:
        raise ValueError(f"a taxonomy may hold {MAX_TERMS} terms")
    return terms


def prepare_text(
    df: DataFrame, text: str, keep: list[str | Column], partitions: int | None = None
) -> DataFrame:
    """Columns needed for matching, each computed once per row."""
    narrow = spread(df.select(*keep, F.col(text).alias(_TEXT)), partitions)
    kept = [c for c in narrow.columns if c != _TEXT]
    col = F.col(_TEXT)
    return narrow.select(*kept, _TEXT, F.lower(col).alias(_LOW), folds_oddly(col).alias(_ODD))


def term_matches(term: Term) -> Column:
    """Does the prepared text match the term's pattern, ignoring case?

    Most patterns can be tested on the lower-cased text, behind a substring test
    where the pattern has words a match must contain. Rows with letters that
    lower-casing treats differently, and other patterns, take the general way.
    """
    general = re2_match(_TEXT, term.pattern)
    if not matches_lower_case(term.pattern):
        return general
    fast = F.col(_LOW).rlike(lower_case_pattern(term.pattern))
    words = required_words(term.pattern)
    if words:
        fast = contains_any(F.col(_LOW), words) & fast
    return F.when(F.col(_ODD), general).otherwise(fast)


def found_terms(terms: list[Term]) -> Column:
    """Number in the list, key and category of all terms that match the prepared text.

    Terms whose pattern needs a whole word are looked up by the words of the text, read
    once for all of them, and only candidates are matched. The others are tried one by
    one. Rows with letters that fold oddly meet all patterns.
    """
    def row(number: Column, key: Column, category: Column) -> Column:
        return F.struct(number.alias("number"), key.alias("tech_key"), category.alias("tech_category"))

    indexed = len(terms) >= INDEXED_FROM
    words = [whole_words(t.pattern) if indexed and matches_lower_case(t.pattern) else None for t in terms]
    by_word = [(i, t, w) for i, (t, w) in enumerate(zip(terms, words)) if w]
    one_by_one = [(i, t) for i, (t, w) in enumerate(zip(terms, words)) if not w]
    arrays = [F.array().cast("array<struct<number:int,tech_key:string,tech_category:string>>")]
    if by_word:
        entries = [
            {
                "number": str(i),
                "key": t.key,
                "category": t.category,
                "fast": lower_case_pattern(t.pattern),
                "general": java_pattern(t.pattern),
            }
            for i, t, _ in by_word
        ]
        index = WordIndex(entries, [w for *_, w in by_word])
        plain = index.matching(F.col(_LOW), lambda t: F.rlike(F.col(_LOW), t["fast"]))
        every = F.filter(index.entries, lambda t: F.rlike(re2_subject(F.col(_TEXT)), t["general"]))
        found = F.when(F.col(_ODD), every).otherwise(plain)
        arrays.append(F.transform(found, lambda t: row(t["number"].cast("int"), t["key"], t["category"])))
    for first in range(0, len(one_by_one), TERMS_PER_ARRAY):
        some = one_by_one[first : first + TERMS_PER_ARRAY]
        tested = [F.when(term_matches(t), row(F.lit(i), F.lit(t.key), F.lit(t.category))) for i, t in some]
        arrays.append(F.array_compact(F.array(*tested)))
    return F.concat(*arrays)


def tag_taxonomy(
    df: DataFrame,
    taxonomy: DataFrame | list[Term],
    text: str,
    keep: list[str],
    *,
    rows_unique: bool = False,
    partitions: int | None = None,
) -> DataFrame:
    """Pairs of row and matching term: ``keep`` columns, ``tech_key``, ``tech_category``.

    Patterns are constants of the plan and all of them are tried while a text is
    in hand: one scan, no join, no shuffle, no pair that does not match. Set
    ``rows_unique`` when ``keep`` identifies a row (as after ``latest_by``), to save the
    distinct; ``partitions`` spreads the rows first.
    """
    terms = plan_terms(taxonomy)
    pairs = (
        prepare_text(df, text, keep, partitions)
        .select(*keep, F.explode(found_terms(terms)).alias("__term"))
        .select(*keep, "__term.tech_key", "__term.tech_category")
    )
    return pairs if rows_unique else pairs.distinct()


def bridge(
    staged: DataFrame,
    taxonomy: DataFrame | list[Term],
    id_col: str = "id",
    text: str = "full_text",
    posted_at: str = "posted_at",
    matched_at: Column | None = None,
) -> DataFrame:
    """The bridge table of a staged (one row per id) record table."""
    pairs = tag_taxonomy(staged, taxonomy, text, [id_col, posted_at], rows_unique=True)
    return pairs.select(
        F.col(id_col).alias("job_id"),
        "tech_key",
        "tech_category",
        F.col(posted_at).alias("job_posted_at"),
        (matched_at if matched_at is not None else F.current_timestamp()).alias("matched_at"),
    )


def dim_terms(taxonomy: DataFrame) -> DataFrame:
    return taxonomy.select("tech_key", F.col("display_name").alias("tech_name"))


def pattern_failures(
    cases: DataFrame,
    taxonomy: DataFrame | list[Term],
    text: str = "text",
    key: str = "tech_key",
    expected: str = "should_match",
    keep: list[str] | None = None,
    partitions: int | None = None,
) -> DataFrame:
    """Control cases (text, key, expected) that a pattern gets wrong.

    Returns ``keep`` (the text, unless given), key, expected and ``did_match``. A
    case whose key is not in the taxonomy counts as not matched.
    """
    columns = [*(keep or [text]), key, expected]
    terms = plan_terms(taxonomy)
    verdict = F.lit(False)
    for first in range(0, len(terms), TERMS_PER_ARRAY):
        some = terms[first : first + TERMS_PER_ARRAY]
        own = F.when(F.lit(False), F.lit(False))
        for t in some:
            own = own.when(F.col(key) == t.key, term_matches(t))
        verdict = F.when(F.col(key).isin([t.key for t in some]), own).otherwise(verdict)
    checked = prepare_text(cases, text, columns, partitions).withColumn("did_match", F.coalesce(verdict, F.lit(False)))
    return checked.filter(F.col(expected) != F.col("did_match")).select(*columns, "did_match")
