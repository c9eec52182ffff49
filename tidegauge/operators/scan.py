"""Corpus rule scan: numbered lines, rules, allowlists, scopes, totals."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.functions.loops import needed_literals
from tidegauge.functions.regex import (
    contains_any,
    folds_oddly,
    has_references,
    java_pattern,
    lower_case_pattern,
    matches_lower_case,
)
from tidegauge.functions.text import LINE_BREAK, needs_nfkc, nfkc_lower, without_last_break
from tidegauge.session import spread

# Rules that one joined pattern stands before.
RULES_PER_TEST = 25
_NORM, _LINE = "__norm", "__line"

# Line ends of message scans: every separator str.splitlines knows.
_MESSAGE_BREAK = r"\r\n|[\n\r\x0B\f\x1C\x1D\x1E\x85\x{2028}\x{2029}]"


@dataclass(frozen=True)
class ScanRule:
    pattern: str
    description: str = "Unnamed rule"
    exceptions: tuple[str, ...] = ()


def rules_from(rows: Iterable) -> list[ScanRule]:
    """Rules from a collected rules table or from dicts."""
    rules = []
    for row in rows:
        row = row if isinstance(row, dict) else row.asDict()
        rules.append(
            ScanRule(
                row["pattern"],
                row.get("description") or "Unnamed rule",
                tuple(row.get("exceptions") or ()),
            )
        )
    return rules


def to_lines(
    df: DataFrame,
    doc: str,
    text: str,
    keep: Sequence[str] = (),
    *,
    message: bool = False,
    partitions: int | None = None,
) -> DataFrame:
    """Lines of each text, numbered from 1: ``doc``, ``keep``, ``line_no``, ``line``.

    Files break at newlines and carriage returns; messages at every separator
    Unicode has for lines.
    """
    narrow = spread(df.select(doc, *keep, text), partitions)
    return _split_lines(narrow, doc, keep, F.col(text), message)


def _split_lines(
    df: DataFrame, doc: str, keep: Sequence[str], text: Column, message: bool
) -> DataFrame:
    # The split gets its own projection: the generator below reads it three times.
    parts = df.select(
        doc, *keep, F.split(text, _MESSAGE_BREAK if message else LINE_BREAK).alias("__parts")
    )
    lines = without_last_break(F.col("__parts"))
    return parts.select(doc, *keep, F.posexplode(lines).alias("__pos", "line")).select(
        doc, *keep, (F.col("__pos") + 1).alias("line_no"), "line"
    )


def scope_documents(
    df: DataFrame,
    path: str,
    extensions: Sequence[str] | None = None,
    ignore_dirs: Sequence[str] = (),
    allow_documents: Sequence[str] = (),
) -> DataFrame:
    """Documents a scan looks at, by path.

    ``extensions`` are exact suffixes; ``ignore_dirs`` are directory names
    anywhere in the path or directory paths from the top; ``allow_documents``
    are whole paths that are never scanned.
    """
    col = F.col(path)
    if extensions is not None:
        suffix = F.regexp_extract(col, r"[^/](\.[^./]+)\z", 1)
        df = df.filter(suffix.isin(list(extensions)))
    if ignore_dirs:
        steps = F.split(F.regexp_replace(col, r"[^/]*\z", ""), "/")
        inside = F.arrays_overlap(steps, F.array(*[F.lit(d) for d in ignore_dirs]))
        for directory in ignore_dirs:
            if "/" in directory:
                inside = inside | col.startswith(directory.rstrip("/") + "/")
        df = df.filter(~inside)
    if allow_documents:
        df = df.filter(~col.isin(list(allow_documents)))
    return df


def _matches(norm: Column, pattern: str) -> Column:
    """Matches in the normalised line."""
    general = F.regexp_extract_all(norm, F.lit(_general(pattern)), 0)
    if not matches_lower_case(pattern):
        return general
    # Normalised text is lower case; of the letters that fold oddly only the
    # dotless i can be left in it.
    fast = F.regexp_extract_all(norm, F.lit(_lower(pattern)), 0)
    return F.when(folds_oddly(norm, "\u0131"), general).otherwise(fast)


def _general(pattern: str) -> str:
    return java_pattern(pattern, unicode_words=True)


def _lower(pattern: str) -> str:
    return lower_case_pattern(pattern, unicode_words=True)


def _as_written(norm: Column, line: Column, matches: Column, pattern: str) -> Column:
    """The matches as they stand in the line itself.

    Their places follow from the lengths of what lies between them. Where normalising
    changes the length of a line places do not carry over: the normalised text stays.
    """
    between = F.split(norm, _general(pattern), -1)
    same = (F.char_length(norm) == F.char_length(line)) & (F.size(between) == F.size(matches) + 1)
    pairs = F.zip_with(matches, F.slice(between, 1, F.size(matches)), lambda m, b: F.struct(m.alias("m"), b.alias("b")))

    def cut(done: Column, pair: Column) -> Column:
        start, length = done["at"] + F.char_length(pair["b"]), F.char_length(pair["m"])
        found = F.array_append(done["found"], F.substring(line, start + 1, length))
        return F.struct((start + length).alias("at"), found.alias("found"))

    nothing = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("found"))
    written = F.aggregate(pairs, nothing, cut, lambda done: done["found"])
    return F.when((norm != line) & same, written).otherwise(matches)


def _rule_hits(norm: Column, line: Column, rule: ScanRule, name: str | None) -> Column:
    def written(matches: Column) -> Column:
        return F.when(F.size(matches) > 0, _as_written(norm, line, matches, rule.pattern)).otherwise(matches)

    # As a variable of a lambda the matches are found once; as an expression, wherever they occur.
    found = F.transform(
        F.flatten(F.transform(F.array(_matches(norm, rule.pattern)), written)),
        lambda m: F.struct(F.lit(rule.description).alias("rule"), m.alias("match_text")),
    )
    if rule.exceptions and name:
        exempt = F.coalesce(F.col(name).isin(list(rule.exceptions)), F.lit(False))
        return F.when(~exempt, found).otherwise(F.slice(found, 1, 0))
    return found


def _some_rule_matches(norm: Column, rules: Sequence[ScanRule]) -> Column:
    """Tests that most lines fail: substrings a match must hold stand before a pattern, and
    one pattern stands for several rules without any."""
    plain = [r.pattern for r in rules if matches_lower_case(r.pattern)]
    others = [r.pattern for r in rules if not matches_lower_case(r.pattern)]
    joined = lambda form, some: "|".join(f"(?:{form(p)})" for p in some)
    literals = {p: needed_literals(p) for p in plain}
    tests = [contains_any(norm, literals[p]) & norm.rlike(_lower(p)) for p in plain if literals[p]]
    rest = [p for p in plain if not literals[p]]
    if rest:
        tests.append(norm.rlike(joined(_lower, rest)))
    if plain:
        tests.append(folds_oddly(norm, "\u0131"))
    if others:
        tests.append(norm.rlike(joined(_general, others)))
    return reduce(lambda a, b: a | b, tests)


def scan_rules(
    lines: DataFrame,
    rules: Sequence[ScanRule],
    doc: str = "doc_id",
    *,
    allow: Sequence[str] = (),
    skip_prefix: str | None = None,
    name: str | None = None,
    keep: Sequence[str] = (),
    exceptions: DataFrame | None = None,
) -> DataFrame:
    """All non-overlapping matches of every rule in every line.

    Returns ``doc``, ``keep``, ``line_no``, ``match_text``, ``rule``. Lines are
    normalised (NFKC, lower case) before matching; the match is reported as it is
    written in the line, or normalised where that changes the line's length. A line matching any ``allow`` pattern reports nothing; lines whose
    first visible character starts ``skip_prefix`` are not read. A rule's own
    ``exceptions`` are compared to column ``name``; long lists come as a table
    ``exceptions(rule, <name or doc>)``.
    """
    lines = _unskipped(lines, "line", skip_prefix)
    return _scan(lines, rules, doc, allow, name, keep, exceptions)


def scan_documents(
    df: DataFrame,
    text: str,
    rules: Sequence[ScanRule],
    doc: str = "doc_id",
    *,
    allow: Sequence[str] = (),
    name: str | None = None,
    keep: Sequence[str] = (),
    exceptions: DataFrame | None = None,
    message: bool = False,
    skip_prefix: str | None = None,
    partitions: int | None = None,
) -> DataFrame:
    """``to_lines`` and ``scan_rules`` in one. ``partitions`` spreads the documents first."""
    columns = _columns(doc, keep, name)
    narrow = spread(df.select(*columns, text), partitions)
    lines = _split_lines(narrow, doc, [c for c in columns if c != doc], F.col(text), message)
    return _scan(_unskipped(lines, "line", skip_prefix), rules, doc, allow, name, keep, exceptions)


def _unskipped(lines: DataFrame, line: str, prefix: str | None) -> DataFrame:
    """Lines whose first visible characters are not ``prefix``."""
    if not prefix:
        return lines
    return lines.filter(~F.regexp_replace(line, r"^[\s\p{Z}]+", "").startswith(prefix))


def _columns(doc: str, keep: Sequence[str], name: str | None) -> list[str]:
    return list(dict.fromkeys([doc, *keep, *([name] if name else [])]))


def _scan(
    lines: DataFrame,
    rules: Sequence[ScanRule],
    doc: str,
    allow: Sequence[str],
    name: str | None,
    keep: Sequence[str],
    exceptions: DataFrame | None,
) -> DataFrame:
    if not rules:
        raise ValueError("a scan needs at least one rule")
    columns, norm, line = _columns(doc, keep, name), F.col(_NORM), F.col(_LINE)
    # Groups would change their numbers in a joined pattern, and names may clash there.
    alone = [[r] for r in rules if has_references(r.pattern)]
    joined = [r for r in rules if not has_references(r.pattern)]
    sets = alone + [joined[i : i + RULES_PER_TEST] for i in range(0, len(joined), RULES_PER_TEST)]

    def any_matches(text: Column) -> Column:
        return reduce(lambda a, b: a | b, [_some_rule_matches(text, some) for some in sets])

    # Lines without a match go no further, but for those that lower case does not normalise.
    # As a variable of a lambda the lower case is made once, not once a test.
    found_low = F.exists(F.array(F.lower(F.col("line"))), any_matches)
    passed = lines.filter(needs_nfkc(F.col("line")) | found_low)
    normal = passed.select(*columns, "line_no", F.col("line").alias(_LINE), nfkc_lower("line").alias(_NORM))
    none = F.array().cast("array<struct<rule:string,match_text:string>>")
    barred = [norm.rlike(_general(pattern)) for pattern in allow]
    groups = []
    for some in sets:
        found, test = F.concat(*(_rule_hits(norm, line, r, name) for r in some)), _some_rule_matches(norm, some)
        groups.append(F.when(reduce(lambda a, b: a & ~b, barred, test), found).otherwise(none))
    # All rules in one projection: the text is read and normalised once, however many.
    hits = normal.select(*columns, "line_no", F.explode(F.concat(*groups)).alias("__hit")).select(
        *columns,
        "line_no",
        F.col("__hit.match_text").alias("match_text"),
        F.col("__hit.rule").alias("rule"),
    )
    if exceptions is not None:
        hits = hits.join(exceptions.distinct(), ["rule", name or doc], "left_anti")
    return hits.select(doc, *keep, "line_no", "match_text", "rule")


def rule_summary(hits: DataFrame) -> DataFrame:
    """Hits per rule."""
    return hits.groupBy("rule").agg(F.count(F.lit(1)).alias("hits"))


def scan_passed(hits: DataFrame) -> bool:
    return hits.isEmpty()
