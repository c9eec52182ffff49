"""Corpus rule scan over documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegauge.operators.scan import (
    ScanRule,
    rule_summary,
    scan_documents,
    scan_rules,
    scope_documents,
    to_lines,
)
from tidegauge.plans.registered.registry import query

RULES = [
    ScanRule(r"licen[sc]ed\s+under\s+(the\s+)?[a-z]+", "Licence notice"),
    ScanRule(r"[a-z0-9._-]+@[a-z0-9-]+(\.[a-z0-9-]+)+", "E-mail address", ("src3", "src11")),
    ScanRule(r"(token|password|api_key|secret)\s*=\s*[^\s]+", "Secret"),
    ScanRule(r"[0-9]{1,3}(\.[0-9]{1,3}){3}", "Network address"),
    ScanRule(r"[0-9]{13,16}", "Card number"),
    ScanRule(r"###|%%%", "Junk marker", ("src0",)),
]
ALLOW = [r"mail[0-3]\.example", r"password"]

LINES_SQL = """
    SELECT doc_id, lang, source, CAST(line_no AS INTEGER) AS line_no, line
    FROM (
        SELECT doc_id, lang, source,
               unnest(lines) AS line, unnest(range(1, len(lines) + 1)) AS line_no
        FROM (
            SELECT doc_id, lang, source,
                   CASE WHEN parts[-1] = '' THEN parts[1:len(parts) - 1] ELSE parts END AS lines
            FROM (SELECT *, string_split_regex(text, '\\r\\n|\\r|\\n') AS parts FROM documents)
        )
    )
"""


def _hits_sql(lines: str, rules: list[ScanRule], exceptions: bool = False) -> str:
    parts = []
    for rule in rules:
        pattern = rule.pattern.replace("'", "''")
        where = ""
        if exceptions and rule.exceptions:
            where = f"WHERE source NOT IN ({', '.join(repr(e) for e in rule.exceptions)})"
        parts.append(
            f"SELECT doc_id, line_no, unnest(regexp_extract_all(line, '(?i){pattern}')) "
            f"AS match_text, '{rule.description}' AS rule FROM ({lines}) {where}"
        )
    return " UNION ALL ".join(parts)


def _doc_lines(t):
    return to_lines(t.documents, "doc_id", "text", keep=["lang", "source"])


@query(LINES_SQL)
def doc_lines(t):
    return _doc_lines(t)


HITS_SQL = _hits_sql(LINES_SQL, RULES)


@query(HITS_SQL)
def rule_hits(t):
    return scan_documents(t.spread(t.documents.select("doc_id", "text")), "text", RULES)


_WORD_RULES = [ScanRule(r"the[a-z]+", "Word"), ScanRule(r"(une|der)\s[a-z]+", "Article and word")]


@query(_hits_sql(LINES_SQL, _WORD_RULES))
def rule_hits_original_case(t):
    """Words at the start of sentences and in capitals are reported as they are written."""
    return scan_documents(t.spread(t.documents.select("doc_id", "text")), "text", _WORD_RULES)


# Back references and groups of equal names, and the same rules spelled out.
_GROUP_RULES = [
    ScanRule(r"([0-9])\1\1", "Digit three times"),
    ScanRule(r"(?P<a_word>the|une|der|and) (?P=a_word)\b", "Word twice"),
    ScanRule(r"(?P<a_word>[#%])(?P=a_word)+", "Mark repeated"),
    ScanRule(r"([aeiou])\1", "Vowel twice"),
]
_SPELLED_OUT = [
    ScanRule("|".join(str(d) * 3 for d in range(10)), "Digit three times"),
    ScanRule("|".join(rf"{w} {w}\b" for w in ("the", "une", "der", "and")), "Word twice"),
    ScanRule("##+|%%+", "Mark repeated"),
    ScanRule("|".join(v * 2 for v in "aeiou"), "Vowel twice"),
]


@query(_hits_sql(LINES_SQL, _SPELLED_OUT))
def rule_hits_with_groups(t):
    """Rules that name groups or refer back to them, together in one scan."""
    return scan_documents(t.spread(t.documents.select("doc_id", "text")), "text", _GROUP_RULES)


@query(HITS_SQL)
def rule_hits_by_line(t):
    """The same hits from lines split beforehand."""
    return scan_rules(_doc_lines(t), RULES)


@query(
    _hits_sql(
        f"SELECT * FROM ({LINES_SQL}) WHERE NOT regexp_matches(lower(line), '{ALLOW[0]}|{ALLOW[1]}')",
        RULES,
    )
)
def rule_hits_allowlisted(t):
    return scan_documents(t.documents, "text", RULES, allow=ALLOW)


@query(_hits_sql(LINES_SQL, RULES, exceptions=True))
def rule_hits_excepted(t):
    """Rules that do not apply to some documents, named in the rule."""
    return scan_documents(t.documents, "text", RULES, name="source")


@query(
    f"""
    SELECT h.doc_id, h.line_no, h.match_text, h.rule
    FROM ({HITS_SQL}) AS h LEFT JOIN labels AS l
         ON l.doc_id = h.doc_id AND l.toxic = 1 AND h.rule = 'Junk marker'
    WHERE l.doc_id IS NULL
    """
)
def rule_hits_excepted_by_table(t):
    """The same from a table: one rule does not apply to documents labelled toxic."""
    exempt = t.labels.filter("toxic = 1").select(F.lit("Junk marker").alias("rule"), "doc_id")
    return scan_rules(_doc_lines(t), RULES, exceptions=exempt)


_PATH_SQL = """
    source || '/' || lang || '/doc-' || CAST(doc_id AS VARCHAR)
           || CASE lang WHEN 'en' THEN '.md' WHEN 'fr' THEN '.txt.py' WHEN 'de' THEN '' ELSE '.txt' END
"""


@query(
    _hits_sql(
        f"""
        SELECT * FROM ({LINES_SQL})
        WHERE lang IN ('en', 'fr') AND source <> 'src4' AND NOT (source = 'src5' AND lang = 'fr')
        """,
        RULES,
    )
)
def rule_hits_scoped(t):
    """Only some suffixes, and nothing below ignored directories."""
    suffix = (
        F.when(F.col("lang") == "en", ".md")
        .when(F.col("lang") == "fr", ".txt.py")
        .when(F.col("lang") == "de", "")
        .otherwise(".txt")
    )
    stem = F.concat(F.lit("doc-"), F.col("doc_id").cast("string"))
    path = F.concat(F.concat_ws("/", "source", "lang", stem), suffix)
    scoped = scope_documents(
        t.documents.withColumn("path", path),
        "path",
        extensions=[".md", ".py"],
        ignore_dirs=["src4", "src5/fr", "doc"],
    )
    return scan_documents(scoped, "text", RULES)


@query(
    _hits_sql(f"SELECT * FROM ({LINES_SQL}) WHERE NOT regexp_matches(line, '^[ \\t]*The')", RULES)
)
def rule_hits_uncommented(t):
    """Lines opening with a given mark are skipped."""
    return scan_rules(_doc_lines(t), RULES, skip_prefix="The")


@query(f"SELECT rule, count(*) AS hits FROM ({HITS_SQL}) GROUP BY rule")
def rule_totals(t):
    return rule_summary(scan_documents(t.spread(t.documents.select("doc_id", "text")), "text", RULES))


@query(
    _hits_sql(
        """
        SELECT item_id AS doc_id, CAST(unnest(range(1, len(lines) + 1)) AS INTEGER) AS line_no,
               unnest(lines) AS line
        FROM (SELECT item_id, string_split(text, chr(10)) AS lines FROM benchmark)
        """,
        [ScanRule("(th|re)[a-z]*er", "Word shape")],
    )
)
def benchmark_hits(t):
    passages = t.benchmark.withColumnRenamed("item_id", "doc_id")
    rules = [ScanRule("(th|re)[a-z]*er", "Word shape")]
    return scan_rules(to_lines(passages, "doc_id", "text", message=True), rules)


@query(
    """
    SELECT conv_id, turn, CAST(unnest(range(1, len(lines) + 1)) AS INTEGER) AS line_no,
           unnest(lines) AS line
    FROM (
        SELECT conv_id, turn,
               CASE WHEN parts[-1] = '' THEN parts[1:len(parts) - 1] ELSE parts END AS lines
        FROM (SELECT *, string_split_regex(text,
                  '\\r\\n|[\\n\\r\\x0B\\f\\x1C\\x1D\\x1E\\x{85}\\x{2028}\\x{2029}]') AS parts
              FROM conversations)
    )
    """
)
def message_lines(t):
    return to_lines(t.conversations, "conv_id", "text", keep=["turn"], message=True)
