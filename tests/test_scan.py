"""Scan options: allowlist, exceptions, scope, prefixes, totals."""

import pytest

from tidegauge.operators.scan import (
    ScanRule,
    rule_summary,
    rules_from,
    scan_documents,
    scan_passed,
    scan_rules,
    scope_documents,
    to_lines,
)

RULES = [
    ScanRule(r"\bvendor\b", "Vendor"),
    ScanRule(r"\bvendor\s+model\b", "Model", ("special.md",)),
    ScanRule(r"\bmade\s+by\s+tool\b", "Phrase"),
]
DOCS = [
    (1, "src/a.py", "x = 1\nVendor vendor MODEL\n# made by tool\n"),
    (2, "docs/special.md", "vendor model"),
    (3, "docs/ok.md", "vendored models, remade by tools"),
    (4, "src/node_modules/b.py", "vendor"),
    (5, "tools/checks/tests/c.py", "vendor"),
    (6, "readme", "vendor"),
    (7, "src/keys.py", "vendor_key = vendor"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, "doc_id int, path string, text string")


def _hits(frame):
    return sorted((r.doc_id, r.line_no, r.match_text, r.rule) for r in frame.collect())


def test_all_matches_of_all_rules(docs):
    assert _hits(scan_documents(docs, "text", RULES)) == [
        (1, 2, "Vendor", "Vendor"),
        (1, 2, "vendor", "Vendor"),
        (1, 2, "vendor MODEL", "Model"),
        (1, 3, "made by tool", "Phrase"),
        (2, 1, "vendor", "Vendor"),
        (2, 1, "vendor model", "Model"),
        (4, 1, "vendor", "Vendor"),
        (5, 1, "vendor", "Vendor"),
        (6, 1, "vendor", "Vendor"),
        (7, 1, "vendor", "Vendor"),
    ]


def test_options(spark, docs):
    allowed = scan_documents(docs, "text", RULES, allow=["vendor_key"])
    assert 7 not in {h[0] for h in _hits(allowed)}
    named = docs.selectExpr("*", "substring_index(path, '/', -1) as name")
    excepted = scan_documents(named, "text", RULES, name="name", keep=["path"])
    assert [h for h in _hits(excepted) if h[0] == 2] == [(2, 1, "vendor", "Vendor")]
    assert "path" in excepted.columns
    table = spark.createDataFrame([("Vendor", 2), ("Vendor", 6)], "rule string, doc_id int")
    by_table = _hits(scan_documents(docs, "text", RULES, exceptions=table))
    assert [h for h in by_table if h[0] in (2, 6)] == [(2, 1, "vendor model", "Model")]
    lines = to_lines(docs, "doc_id", "text")
    uncommented = _hits(scan_rules(lines, RULES, skip_prefix="#"))
    assert not [h for h in uncommented if h[3] == "Phrase" and h[0] == 1]
    assert uncommented == _hits(scan_documents(docs, "text", RULES, skip_prefix="#"))
    with pytest.raises(ValueError):
        scan_documents(docs, "text", [])


def test_matches_as_written(spark):
    """Places carry over unless normalising changes the line's length."""
    rows = [(1, "Use ChatGPT now, chatgpt. ÉTÉ Vendor"), (2, "ﬁne Vendor"), (3, "Ⅳ VENDOR"), (4, None), (5, ""), (6, "\nx\rVeNdOr")]
    frame = spark.createDataFrame(rows, "doc_id int, text string")
    rules = [ScanRule(r"chatgpt", "A"), ScanRule(r"\bvendor\b", "B"), ScanRule(r"[Vv]endor", "C")]
    hits = _hits(scan_documents(frame, "text", rules))
    written = {(1, "A"): ["ChatGPT", "chatgpt"], (1, "B"): ["Vendor"], (2, "B"): ["vendor"], (3, "B"): ["vendor"], (6, "B"): ["VeNdOr"]}
    for (doc, rule), want in written.items():
        assert sorted(h[2] for h in hits if (h[0], h[3]) == (doc, rule)) == sorted(want)
        assert rule != "B" or [h[2] for h in hits if (h[0], h[3]) == (doc, "C")] == want


def test_matches_are_found_once_a_line(spark):
    """However many matches a line has, and only in lines that a match may be in."""
    text = "plain\n" + "aB x " * 3000 + "\nﬁAB ab\nKab\nıab no\n"
    frame = spark.createDataFrame([(1, text), (2, "nothing here"), (3, "AB allowed")], "doc_id int, text string")
    rules, allow = [ScanRule(r"ab(?: x)?", "One"), ScanRule(r"[fk]i?a", "Two")], ["allow"]
    by_line = scan_rules(to_lines(frame, "doc_id", "text"), rules, allow=allow)
    for hits in (by_line, scan_documents(frame, "text", rules, allow=allow)):
        plan = hits._jdf.queryExecution().executedPlan().toString()
        assert plan.count("ArrowEvalPython") == 1
        assert "lower(" in plan[plan.index("ArrowEvalPython") :]
        # Once for either spelling of a pattern, and rule.
        assert plan.count("regexp_extract_all(") == 4
        found = _hits(hits)
        assert [h[2:] for h in found if h[1] == 2] == [("aB x", "One")] * 3000
        rest = [(3, "ab", "One"), (3, "ab", "One"), (3, "fia", "Two"), (4, "Ka", "Two"), (4, "ab", "One"), (5, "ab", "One")]
        assert [h[1:] for h in found if h[1] != 2] == sorted(rest)


def test_allowlist_reads_lines_with_a_match_only(docs):
    """Its patterns stand behind the rules' tests, in no filter of all lines."""
    for hits in (
        scan_documents(docs, "text", RULES, allow=["vendor_key"]),
        scan_rules(to_lines(docs, "doc_id", "text"), RULES, allow=["vendor_key"]),
    ):
        plan = hits._jdf.queryExecution().executedPlan().toString().splitlines()
        assert not [node for node in plan if "Filter" in node and "vendor_key" in node]
        assert {h[0] for h in _hits(hits)} == {1, 2, 4, 5, 6}


def test_scope(docs):
    scoped = scope_documents(
        docs, "path", [".py", ".md"], ["node_modules", "tools/checks/tests", "doc"], ["docs/ok.md"]
    )
    assert sorted(r.doc_id for r in scoped.collect()) == [1, 2, 7]
    assert scope_documents(docs, "path").count() == len(DOCS)


def test_summary_and_groups(docs, monkeypatch):
    hits = scan_documents(docs, "text", RULES)
    totals = {r.rule: r.hits for r in rule_summary(hits).collect()}
    assert totals == {"Vendor": 7, "Model": 2, "Phrase": 1}
    assert not scan_passed(hits)
    assert scan_passed(scan_documents(docs.filter("doc_id = 3"), "text", RULES))
    monkeypatch.setattr("tidegauge.operators.scan.RULES_PER_TEST", 1)
    assert _hits(scan_documents(docs, "text", RULES)) == _hits(hits)


def test_rules_from_rows():
    rules = rules_from([{"pattern": "a"}, {"pattern": "b", "description": "B", "exceptions": ["x"]}])
    assert rules == [ScanRule("a", "Unnamed rule", ()), ScanRule("b", "B", ("x",))]


def test_rules_with_references_keep_their_groups(spark):
    frame = spark.createDataFrame([(1, "AA zzqq zz"), (2, "zzzz"), (3, "xbb"), (4, "no")], "doc_id int, text string")
    rules = [ScanRule(r"(a|b)\1", "one"), ScanRule(r"(zz|qq)\1", "two"), ScanRule(r"(?P<x_y>no|b)", "three"), ScanRule(r"(?P<x_y>z)(?P=x_y)", "four")]
    together = _hits(scan_documents(frame, "text", rules))
    assert together == sorted(h for r in rules for h in _hits(scan_documents(frame, "text", [r])))
    assert [h[0] for h in together if h[3] == "one"] == [1, 3] and [h[0] for h in together if h[3] == "two"] == [2]
    assert len([h for h in together if h[3] == "four"]) == 4
