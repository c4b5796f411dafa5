from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from auditweave.operators import checks, quality

EVIDENCE = (
    "run_id string, repo string, ord bigint, id string, file string, line_start int, line_end int, source string, "
    "signal_type string, summary string, confidence double"
)


@pytest.fixture(scope="module")
def evidence(spark):
    return spark.createDataFrame(
        [
            ("run", "repo", 1, "e1", "app.py", 1, 1, "scanner_heuristic", "entrypoint", "Entrypoint candidate: app.py", 0.8),
            ("run", "repo", 2, "e2", "app.py", 9, 9, "semgrep", "secret", "Hardcoded secret-like token", 0.9),
            ("run", "repo", 3, "e3", "api.py", 4, 4, "scanner_heuristic", "route", "List endpoint without pagination", 0.65),
        ],
        EVIDENCE,
    )


def test_every_check_yields_one_finding(evidence):
    found = checks.security_findings(evidence).collect()
    assert [f.check_id for f in sorted(found, key=lambda f: f.ord)] == [r.check_id for r in checks.SECURITY_RULES]
    by_id = {f.check_id: f for f in found}
    secret = by_id["hardcoded-secrets"]
    assert (secret.status, secret.confidence, secret.evidence[0].file) == ("confirmed", 0.9, "app.py")
    assert by_id["insecure-jwt-usage"].status == "insufficient_evidence"
    assert all(f.evidence for f in found if f.status == "confirmed")


def test_performance_check_is_suspected_below_the_threshold(evidence):
    by_id = {f.check_id: f for f in checks.performance_findings(evidence).collect()}
    pages = by_id["missing-pagination-in-apis"]
    assert (pages.status, pages.confidence) == ("suspected", 0.65)


def test_runs_without_evidence_get_findings(spark, evidence):
    runs = spark.createDataFrame([("run", "repo"), ("empty", "other")], "run_id string, repo string")
    found = checks.security_findings(evidence, runs).filter("run_id = 'empty'").collect()
    assert len(found) == 8 and {f.status for f in found} == {"insufficient_evidence"}
    architecture = {f.run_id: f for f in checks.architecture_finding(evidence, runs).collect()}
    assert architecture["run"].status == "confirmed" and architecture["empty"].severity == "Medium"


def test_first_evidence_wins_in_a_hot_run(spark):
    """Brute force over a run that holds almost all rows."""
    rows = []
    for n in range(2000):
        run = "hot" if n % 50 else "cold"
        word = ["nothing", "jwt", "admin page", "Debug on", "md5 hash"][(n * 7) % 5]
        rows.append((run, "r", n, f"e{n}", f"f{n}.c", 1, 1, "semgrep", "vuln", word, 0.5 + (n % 5) / 10))
    table = spark.createDataFrame(rows, EVIDENCE).repartition(7)
    got = {(r.run_id, r.check_id): r.item for r in checks.first_match(table, checks.SECURITY_RULES).collect()}
    for run in ("hot", "cold"):
        for rule in checks.SECURITY_RULES:
            first = next((r for r in rows if r[0] == run and any(k in f"{r[9]} {r[4]}".lower() for k in rule.keywords)), None)
            item = got[(run, rule.check_id)]
            assert (item.file if item else None) == (first[4] if first else None)


def test_roadmap_order_and_buckets(spark):
    schema = "run_id string, category string, ord bigint, id string, title string, description string, severity string, status string, confidence double, recommendation string"
    rows = [
        ("r", "performance", 0, "p0", "t", "d", "High", "confirmed", 0.9, "fix p"),
        ("r", "security", 0, "s0", "t", "d", "High", "suspected", 0.9, "fix s"),
        ("r", "architecture", 0, "a0", "t", "d", "Low", "confirmed", 0.9, "fix a"),
        ("r", "security", 1, "s1", "t", "d", "Critical", "failed", 1.0, "never"),
        ("r", "security", 2, "s2", "t", "d", "Medium", "confirmed", 0.2, "fix m"),
    ]
    items = checks.roadmap(spark.createDataFrame(rows, schema)).orderBy("position").collect()
    assert [(i.task, i.priority, i.timeline_bucket, i.depends_on) for i in items] == [
        ("fix s", "P0", "immediate_1_2_days", ["s0"]),
        ("fix p", "P0", "immediate_1_2_days", ["p0"]),
        ("fix m", "P1", "short_term_1_2_weeks", ["s2"]),
        ("fix a", "P2", "medium_term_1_2_months", ["a0"]),
    ]


def _rules(words_of_rules, category="c"):
    return [checks.Rule(category, f"x{i}", "Low", tuple(words), "t", "t", "t") for i, words in enumerate(words_of_rules)]


ROWS = "run_id string, repo string, ord bigint, file string, line_start int, line_end int, source string, signal_type string, summary string, confidence double"


def _first(rows, rules):
    """Order number of the first match by run and rule, one substring test after another."""
    out = {}
    for run in {r[0] for r in rows}:
        for i, rule in enumerate(rules):
            hits = [r[2] for r in rows if r[0] == run and any(k in f"{r[8]} {r[3]}".lower() for k in rule.keywords)]
            out[run, i] = min(hits, default=None)
    return out


def test_keywords_that_overlap_and_contain_each_other(spark):
    """Against plain substring tests: nested, overlapping and odd keywords, and the empty one."""
    words = [["ab"], ["abc", "zz"], ["bcd"], ["b"], ["cd."], [".*"], ["(x|y)"], ["\\", "$1"], ["é ü"], [""], [], ["abcd", "ab"], ["🙂", "a\tb"], ["[a-z]"], ["nope"]]
    rules = _rules(words)
    texts = ["xabcdx", "bab", "zz top.", "a.*b", "(x|y)", "cost $1 \\", "É Ü", "🙂🙂", "a\tb", "[a-z]", "", "abc\ncd.", "ABC"]
    rows = [(f"r{i % 3}", "p", i, "f", 1, 1, "s", "t", t, 0.5) for i, t in enumerate(texts)]
    got = checks.first_match(spark.createDataFrame(rows, ROWS).withColumn("line_end", F.col("ord").cast("int")), rules).collect()
    assert {(r.run_id, r.rule): r.item.line_end if r.item else None for r in got} == _first(rows, rules)


def test_large_catalogue_reads_the_evidence_once(spark, tmp_path):
    """5,000 rules: results as by substring tests, and one scan of the evidence in the plan."""
    n = 5000
    rules = checks.rules_from_table(spark.range(n).select(
        F.lit("c").alias("category"), F.col("id").alias("position"), F.concat(F.lit("x"), F.col("id").cast("string")).alias("check_id"), F.lit("Low").alias("severity"),
        F.array(F.concat(F.lit("K"), F.col("id").cast("string"), F.lit(".")), F.concat(F.lit("id-"), F.col("id").cast("string"))).alias("keywords"), F.lit("t").alias("title"), F.lit("t").alias("concern"), F.lit("t").alias("advice"),
    ))
    rows = [(f"r{i % 4}", "p", i, "f", 1, i, "s", "t", f"about k{i * 37 % n}. and id-{i * 11 % n} here", 0.8) for i in range(300)]
    spark.createDataFrame(rows, ROWS).write.parquet(f"{tmp_path}/evidence")
    found = checks.first_match(spark.read.parquet(f"{tmp_path}/evidence"), rules)
    assert found._jdf.queryExecution().executedPlan().toString().count("FileScan parquet") == 1
    got = found.collect()
    assert len(got) == 4 * n
    assert {(r.run_id, r.rule): r.item.line_end if r.item else None for r in got} == _first(rows, rules)


def test_two_states_of_one_branch(spark):
    states = [("a", "security", "completed", None), ("a", "security", "failed", "later"), ("a", "architecture", "completed", None), ("a", "performance", "completed", None)]
    filled = checks.failed_branch_fill(spark.createDataFrame([("a",)], "run_id string"), spark.createDataFrame(states, "run_id string, branch string, status string, reason string"))
    assert [(r.category, r.description) for r in filled.collect()] == [("security", "later")]


PAYLOAD = (
    "branch string, findings array<struct<id:string,category:string,title:string,description:string,severity:string,status:string,"
    "confidence:double,symptoms:array<string>,recommendation:string,evidence:array<struct<file:string,line_start:int,line_end:string,source:string>>>>"
)


def finding(**changes):
    base = {
        "id": "f", "category": "security", "title": "t", "description": "d", "severity": "Unknown", "status": "unknown",
        "confidence": 1.7, "symptoms": [], "recommendation": "r", "evidence": [("", 0, "0", "model")],
    }
    base.update(changes)
    return tuple(base.values())


def test_payload_is_repaired(spark):
    rows = spark.createDataFrame([("architecture", [finding()])], PAYLOAD)
    result = quality.repair_or_reject(rows).first()
    assert result.outcome == "repaired"
    fixed = result.repaired[0]
    assert (fixed.severity, fixed.category, fixed.status, fixed.confidence) == ("Medium", "architecture", "suspected", 1.0)
    assert (fixed.evidence[0].file, fixed.evidence[0].line_start, fixed.evidence[0].line_end) == ("N/A", 1, "1")


def test_payload_outcomes(spark):
    good = finding(category="architecture", severity="Low", status="confirmed", confidence=0.5, evidence=[("a", 1, "1", "m")])
    no_evidence = finding(category="architecture", severity="Low", status="confirmed", confidence=0.5, evidence=[])
    rows = spark.createDataFrame(
        [("architecture", [good]), ("architecture", [good, no_evidence]), ("architecture", [finding(severity="Severe")]), ("architecture", [])], PAYLOAD
    )
    assert [r.outcome for r in quality.repair_or_reject(rows).collect()] == ["valid", "rejected", "rejected", "valid"]


@pytest.mark.parametrize(
    "raw, value",
    [("0.25", 0.25), (" 1.7 ", 1.0), ("-1", 0.0), ("abc", 0.5), (None, 0.5), ("nan", 0.0), ("inf", 1.0), ("1e-1", 0.1), ("1d", 0.5), ("", 0.5)],
)
def test_confidence(spark, raw, value):
    assert spark.createDataFrame([(raw,)], "c string").select(quality.std_confidence(F.col("c"))).first()[0] == value


@pytest.mark.parametrize("raw, value", [("0", 1), ("12", 12), ("-3", 1), ("x", 1), (" 7 ", 7), ("", 1), (None, 1), ("3.0", 1)])
def test_line_number(spark, raw, value):
    assert spark.createDataFrame([(raw,)], "c string").select(quality.std_line(F.col("c"))).first()[0] == value


def test_roadmap_and_risk_rules(spark):
    items = spark.createDataFrame(
        [("P9", "", "i", "e", "r", "j", "someday"), ("P0", "t", "i", "e", "r", "j", "immediate_1_2_days")],
        "priority string, task string, impact string, effort string, risk string, justification string, timeline_bucket string",
    )
    broken = [r[0] for r in items.select(quality.broken(quality.roadmap_rules(F.col))).collect()]
    assert broken == [["task_empty", "priority_unknown", "timeline_unknown"], []]
    risks = spark.createDataFrame([("", "Low", "f"), ("i", "None", "f")], "issue string, severity string, file string")
    assert [r[0] for r in risks.select(quality.broken(quality.risk_rules(F.col))).collect()] == [["issue_empty"], ["severity_unknown"]]
