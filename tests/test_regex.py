"""Pattern semantics, against the engines the patterns were written for."""

import re
import unicodedata

import duckdb
import pytest
from hypothesis import HealthCheck, Phase, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidegauge.functions.regex import (
    java_pattern,
    lower_case_pattern,
    matches_lower_case,
    re2_match,
    required_words,
)
from tidegauge.operators.scan import ScanRule, scan_documents, scan_rules, to_lines
from tidegauge.operators.taxonomy import Term, tag_taxonomy, terms_from
from tidegauge.sources.schemas import DEFAULT_TAXONOMY

PATTERNS = [
    r"\b(sql)\b",
    r"(sql)",
    r"\b(c#|csharp|c-sharp)\b",
    r"\b(go\s+programming|go)\b",
    r"\b(node\.js|nodejs)\b",
    r"\b(é|ski)\b",
    r"\B(s|k)",
    r"[a-z]+\.[^a-z]",
    r"^s.*k$",
    r"[[:alpha:]]#",
    r"[]s]k",
    r"K\w",
    r"[^\s]i",
    r"s|i$",
    r"(?:js)+\d",
    r"[ -~]é",
    r"\x{17f}",
    r"ı|İ",
    r"#\W",
    r"[^\w]k",
    r"s[\W_]",
    r"[[:^alpha:]]s",
    r"[[:alnum:]_]ß",
    r"\b[sk]+i",
    r"\b[sk-]i",
    r"\bs{0,1}#",
    r"\bk{1,2}\b",
    r"\bs|\bi\b",
]
ALPHABET = list("sSkKiIéÉ#. \n\t_qlQLcC-jJgGoO1") + ["ſ", "K", "İ", "ı", "\x0b", " ", "Å", "ß"]
TEXTS = [
    "I go to the store",
    "C# developer",
    "C#developer",
    "Node.js",
    "ésql",
    "mſql",
    "ſql",
    "É",
    "go\x0bprogramming",
    "GO  Programming",
    "SKI",
    "sKi",
    "Kx",
    "İs",
    "s\nk",
    "",
]


def _expected(pairs):
    engine = duckdb.connect()
    return [
        engine.execute("SELECT regexp_matches(?, ?, 'i')", [text, pattern]).fetchone()[0]
        for text, pattern in pairs
    ]


def _assert_like_re2(spark, texts):
    terms = [Term(str(i), "", "", p) for i, p in enumerate(PATTERNS)]
    frame = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    found = {
        (r["id"], int(r["tech_key"]))
        for r in tag_taxonomy(frame, terms, "text", ["id"]).collect()
    }
    pairs = [(i, j) for i in range(len(texts)) for j in range(len(PATTERNS))]
    truth = _expected([(texts[i], PATTERNS[j]) for i, j in pairs])
    wrong = [
        (texts[i], PATTERNS[j], t) for (i, j), t in zip(pairs, truth) if ((i, j) in found) != t
    ]
    assert not wrong
    direct = frame.select("id", *[re2_match("text", p).alias(f"p{j}") for j, p in enumerate(PATTERNS)])
    for row in direct.collect():
        for j in range(len(PATTERNS)):
            assert row[f"p{j}"] == ((row["id"], j) in found), (texts[row["id"]], PATTERNS[j])


def test_taxonomy_matches_like_re2(spark):
    _assert_like_re2(spark, TEXTS)


@settings(max_examples=12, phases=[Phase.generate], deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(alphabet=ALPHABET, max_size=8), min_size=40, max_size=60))
def test_taxonomy_matches_like_re2_random(spark, texts):
    _assert_like_re2(spark, texts)


def test_default_taxonomy_controls(spark):
    terms = terms_from(DEFAULT_TAXONOMY)
    texts = [
        "I go to the store",
        "JavaScript developer",
        "We use Python and React for our stack",
        "Rust programming",
        "rusty nail",
        "C# developer",
        "C#developer",
        "Node.js",
        "Spring   Boot and Amazon Web  Services on K8S",
    ]
    frame = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    found: dict[int, set] = {}
    for row in tag_taxonomy(frame, terms, "text", ["id"], rows_unique=True).collect():
        found.setdefault(row["id"], set()).add(row["tech_key"])
    assert found == {
        1: {"javascript"},
        2: {"python", "react"},
        3: {"rust"},
        6: {"c_sharp"},
        7: {"node", "javascript"},
        8: {"spring", "aws", "kubernetes"},
    }


def test_more_terms_than_one_array(spark, monkeypatch):
    monkeypatch.setattr("tidegauge.operators.taxonomy.TERMS_PER_ARRAY", 3)
    terms = [Term(f"t{i}", "", "c", rf"\b(w{i})\b") for i in range(10)]
    frame = spark.createDataFrame([(1, "w0 w4 W9"), (2, "w11")], "id int, text string")
    rows = tag_taxonomy(frame, terms, "text", ["id"]).collect()
    assert {(r["id"], r["tech_key"]) for r in rows} == {(1, "t0"), (1, "t4"), (1, "t9")}
    taxonomy = spark.createDataFrame(
        [(t.key, t.name, t.category, t.pattern) for t in terms],
        "tech_key string, display_name string, category string, regex_pattern string",
    )
    assert tag_taxonomy(frame, taxonomy, "text", ["id"]).count() == 3
    assert tag_taxonomy(frame, [], "text", ["id"]).count() == 0


def test_required_words():
    assert required_words(r"\b(python|python3|py3)\b") == ["py3", "python", "python3"]
    assert required_words(r"\b(node\.js|nodejs)\b") == ["node.js", "nodejs"]
    assert required_words(r"\b(go\s+programming|golang)\b") == ["golang", "programming"]
    assert required_words(r"\b(a.c|b)\b") is None
    assert required_words(r"[a-z]+@x") is None
    assert required_words(r"\b(ab*|c)\b") is None


def test_lower_case_conditions():
    assert matches_lower_case(r"\b(python|c#)\b")
    assert matches_lower_case(r"[a-z0-9.]+@[^\S]")
    assert not matches_lower_case(r"Python")
    assert not matches_lower_case(r"[!-_]")
    assert not matches_lower_case(r"(?-i:x)")
    assert not matches_lower_case(r"\x41")
    assert matches_lower_case("né[à-ö]") and not matches_lower_case("[a-ö]")
    assert "(?<!" in lower_case_pattern(r"\b(ab|cd)\b")
    assert java_pattern("a$").endswith(r"\z")


RULES = [
    ScanRule(r"\bsql\b", "word"),
    ScanRule(r"\bghost\s+pilot\b", "two words"),
    ScanRule(r"auto-made\s+by", "phrase"),
    ScanRule(r"\w+#", "tagged"),
    ScanRule(r"\d{2,3}", "digits"),
    ScanRule(r"[^\W\d]k", "letter k"),
    ScanRule(r"(i|s)+$", "end"),
]


def _python_hits(texts, rules, universal=True):
    hits = []
    for number, text in enumerate(texts):
        lines = text.replace("\r\n", "\n").replace("\r", "\n").split("\n") if universal else text.splitlines()
        if universal and lines[-1] == "":
            lines.pop()
        for line_no, line in enumerate(lines, 1):
            normal = unicodedata.normalize("NFKC", line).lower()
            for rule in rules:
                for match in re.finditer(rule.pattern, normal, re.IGNORECASE):
                    source = line if len(line) == len(normal) else normal
                    hits.append((number, line_no, source[match.start() : match.end()], rule.description))
    return sorted(hits)


SCAN_ALPHABET = list("sqlSQLkK #i1٣é\n\r") + ["ſ", "ı", "ﬁ", "Ⅳ", "K", " ", "\x0b", "\x85", "́"]


@settings(max_examples=8, phases=[Phase.generate], deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(alphabet=SCAN_ALPHABET, max_size=12), min_size=30, max_size=50))
def test_scan_like_python(spark, texts):
    texts += ["x ghost  pilot\nAUTO-MADE\tBY", "ésql sql", "a\n\n", "ｓｑｌ"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    expected = _python_hits(texts, RULES)
    for hits in (
        scan_documents(frame, "text", RULES),
        scan_rules(to_lines(frame, "doc_id", "text"), RULES),
    ):
        rows = hits.collect()
        assert sorted((r.doc_id, r.line_no, r.match_text, r.rule) for r in rows) == expected


def test_message_lines_like_splitlines(spark):
    texts = ["a\x0bb\x0cc\x1cd\x1de\x1ef\x85g h i\r\nj", "", "\n", "x\n\n", "y\r"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    rows = to_lines(frame, "doc_id", "text", message=True).orderBy("doc_id", "line_no").collect()
    got: dict[int, list] = {}
    for r in rows:
        got.setdefault(r.doc_id, []).append(r.line)
    assert got == {i: t.splitlines() for i, t in enumerate(texts) if t}


@pytest.mark.parametrize("pattern", PATTERNS)
def test_rewritten_patterns_compile(spark, pattern):
    spark.range(1).select(F.lit("x").rlike(java_pattern(pattern))).collect()
    spark.range(1).select(F.lit("x").rlike(java_pattern(pattern, unicode_words=True))).collect()
