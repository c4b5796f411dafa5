from __future__ import annotations

import hashlib
import json
import time

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from auditweave import fixtures
from auditweave.operators import evidence
from auditweave.plans import inputs
from auditweave.sources import reports

REPORTS = "run_id string, repo string, tool string, part bigint, payload string"


def loaded(spark, tool, *payloads):
    rows = [("run", "repo", tool, i, p if isinstance(p, str) else json.dumps(p)) for i, p in enumerate(payloads)]
    return reports.load_reports(spark.createDataFrame(rows, REPORTS), tool)


@pytest.mark.parametrize(
    "log, expected",
    [
        ('{"a": 1}', '{"a": 1}'),
        ('  {"a": 1}\n', '{"a": 1}'),
        ('warning {not json} {"results": []} tail }', '{"results": []}'),
        ('[{"a": 1}]', '{"a": 1}'),
        ("no braces", None),
        ("{broken", None),
        ('{x {y {"b": {"c": {}}}', '{"b": {"c": {}}}'),
        ('ü{ {"b": "ä"}', '{"b": "ä"}'),
    ],
)
def test_json_is_recovered_from_logs(spark, log, expected):
    got = spark.createDataFrame([(log,)], "stdout string").select(reports.recovered_json(F.col("stdout"))).first()[0]
    if expected is None:
        assert got is None
    else:
        assert json.JSONDecoder().raw_decode(got)[0] == json.loads(expected)


PIECES = ["{", "}", '"', '"a"', ":", "1", ",", "[", "]", " ", "\n", "\\", '{"a":1}', '{"b":{"c":[1,2]}}', "x", "true", "-", "NaN", '"{"', '\\"', "ü"]


@settings(max_examples=2000, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=14).map("".join))
def test_first_object_equals_decoding_at_every_brace(text):
    want, start = None, text.find("{")
    while start >= 0 and want is None:
        try:
            _, end = json.JSONDecoder().raw_decode(text, start)
            want = text[start:end]
        except json.JSONDecodeError:
            start = text.find("{", start + 1)
    assert reports.first_object(text) == want


@pytest.mark.parametrize("noise", ["{", '{"a":', '{"a":1 x', '{"', '{"x":"{",', '{"a":[{"b":1 ,', '{":":"'])
def test_recovery_takes_linear_time(noise):
    """Twice the text takes about twice the time; steps per brace would take four times as long."""

    def seconds(size):
        text = noise * (size // len(noise)) + ' {"found": [1]}'
        start = time.perf_counter()
        found = reports.first_object(text)
        assert found is None or json.loads(found)
        return time.perf_counter() - start

    small, large = (min(seconds(size) for _ in range(3)) for size in (500_000, 1_000_000))
    assert large < 3.2 * small + 0.05


def test_little_noise_goes_to_the_decoder(monkeypatch):
    """Few braces before the report need no tokens read one by one; deep or long values still do."""
    passes = []
    read = reports._read_object
    monkeypatch.setattr(reports, "_read_object", lambda *args: passes.append(1) or read(*args))
    assert reports.first_object('scan started {pass 1}\n{"a": [1]}\ndone }') == '{"a": [1]}' and not passes
    for value in ("[" * 200_000 + "]" * 200_000, "9" * 10_000):
        text = 'log {x} {"a": ' + value + "}"
        assert reports.first_object(text) == text[text.find('{"a"') :] and passes
    assert reports.first_object("{ { { { { { {}") == "{}"


def test_batches_without_noise_are_not_read_in_python():
    """Only nulls come to the recovery of clean reports; they are given back as they are."""

    class Nulls(list):
        null_count = 3

        def to_pylist(self):
            raise AssertionError("read one by one")

    assert reports._first_objects.func(Nulls([None] * 3)).to_pylist() == [None] * 3
    assert reports._first_objects.func(pa.array([None, 'x {"b": 2} y', "{"])).to_pylist() == [None, '{"b": 2}', None]


def test_clean_texts_come_back_as_they_are():
    texts = pa.array(['{"a": 1}', 'x {"b": 2} y', None, "{", "no {"])
    assert reports._first_objects.func(texts, pa.array([False, True, False, False, True])).to_pylist() == ['{"a": 1}', '{"b": 2}', None, "{", None]
    assert reports._first_objects.func(texts, pa.array([False] * 5)).to_pylist() == texts.to_pylist()


@pytest.mark.parametrize("noise", ["", "log {x} "])
def test_recovery_does_not_run_ahead_of_its_results(spark, noise):
    """A task keeps a few batches of rows for Python, not its whole partition."""
    body = F.concat(F.lit(noise + '{"results": [{"filename": "'), F.lpad(F.col("id").cast("string"), 800, "a"), F.lit('"}]}'))
    texts = spark.range(0, 400_000, 1, 1).select(
        F.lit("run").alias("run_id"), F.lit("repo").alias("repo"), F.lit("bandit").alias("tool"), F.col("id").alias("part"), body.alias("payload")
    )
    first = reports.load_reports(texts, "bandit").select("part", "readable", "document").limit(1)
    assert first.collect()[0].readable
    assert first._jdf.queryExecution().executedPlan().collectLeaves().apply(0).metrics().apply("numOutputRows").value() < 200_000


def test_lines_are_dealt_out_narrow_and_whole(spark, tmp_path):
    """Reports of lines take one shuffle of the lines' numbers; repeated, hot and missing keys keep the rows of the plain join."""
    lines = [(order, part, 7, line) for order in [*range(40), None] for line in (1, 2, None) for part in (order, 5, 5, 99, None)]
    parts = [(5, "gear", "b1", 3), (5, "gear two", "b2", 4), (6, None, "b1", None), (None, "none", "b", 1), (8, "rod", None, 2)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame(parts, "p_partkey long, p_name string, p_brand string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    dealt, plain = (found(spark, f"{tmp_path}/") for found in (fixtures.dealt_dependencies, fixtures.dependencies))
    assert dealt.columns == plain.columns and dealt.count() == plain.count() > 400
    assert dealt.exceptAll(plain).count() == plain.exceptAll(dealt).count() == 0
    plan = inputs.osv_reports(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 2 and "Broadcast" not in plan
    assert "concat" not in plan[plan.index("Exchange") :] and "to_json" not in plan[plan.index("Exchange") :]


def test_broken_types_and_noise_in_reports(spark):
    """A clean report is parsed at once; noise, other types and trailing text take the second way."""
    good = json.dumps({"results": [{"filename": "a.py", "line_number": 3, "issue_text": "x"}], "other": {"deep": [1]}})
    rows = loaded(spark, "bandit", good, f"log {{x}} {good} tail {{", '{"results": "text"}', "", "  ", "[]", "{broken", None, '{"results": [{"filename": 7}]}', "\n" + good).orderBy("part").collect()
    assert [r.readable for r in rows] == [True, True, True, True, True, False, False, False, True, True]
    assert [len(r.document.results) if r.document and r.document.results else 0 for r in rows] == [1, 1, 0, 0, 0, 0, 0, 0, 1, 1]
    assert rows[8].document.results[0].filename == "7"


def test_report_folders_are_pruned(spark, tmp_path):
    """Each tool's parse opens its own files only, and values of the folders come back unescaped."""
    for run in ("r1", "r2"):
        for tool in ("semgrep", "bandit", "osv-scanner"):
            folder = tmp_path / f"run_id={run}" / "repo=a%2Fb" / f"tool={tool}"
            folder.mkdir(parents=True)
            for part in range(3):
                (folder / f"part={part}.json").write_text('{"results": []}\n')
    texts = reports.read_report_texts(spark, f"file://{tmp_path}")
    assert sorted({(r.run_id, r.repo, r.tool, r.part) for r in texts.collect()}) == sorted((run, "a/b", tool, part) for run in ("r1", "r2") for tool in reports.REPORT_DDL for part in range(3))
    for wanted, files in ((reports.load_reports(texts, "bandit"), 6), (reports.load_reports(texts.filter("run_id = 'r2'"), "semgrep"), 3)):
        assert wanted.filter("readable").count() == files
        rows = wanted.select("run_id", "document")
        rows.collect()
        scan = rows._jdf.queryExecution().executedPlan().collectLeaves().apply(0)
        assert scan.metrics().apply("numFiles").value() == files


def test_unreadable_reports_are_set_apart(spark):
    rows = loaded(spark, "bandit", {"results": []}, "not json")
    assert [r.readable for r in rows.orderBy("part").collect()] == [True, False]
    assert [r.part for r in reports.unreadable(rows).collect()] == [1]


def test_pattern_scanner_defaults(spark):
    payload = {
        "results": [
            {"path": "a.py", "check_id": "r1", "start": {"line": 3}, "end": {"line": 5}, "extra": {"message": "bad"}},
            {"path": "b.py", "check_id": "r2", "start": {"line": 7}, "extra": {"message": ""}},
            {"path": "c.py"},
            {"check_id": "no path"},
            {"path": ""},
        ]
    }
    rows = evidence.evidence_semgrep(loaded(spark, "semgrep", payload)).orderBy("ord").collect()
    assert [(r.file, r.line_start, r.line_end, r.summary) for r in rows] == [
        ("a.py", 3, 5, "bad"), ("b.py", 7, 7, "r2"), ("c.py", 1, 1, "Semgrep finding"),
    ]
    digest = hashlib.sha256(b"a.py:3:5:semgrep:vuln:bad").hexdigest()
    assert (rows[0].id, rows[0].snippet_hash) == (digest[:16], digest)


def test_python_scanner_texts_and_paths(spark):
    payload = {
        "results": [
            {"filename": "./src//a.py", "line_number": 4, "issue_text": "x", "test_name": "t"},
            {"filename": "b.py", "line_number": "9", "issue_text": "", "test_name": "t"},
            {"filename": "c.py"},
        ]
    }
    rows = evidence.evidence_bandit(loaded(spark, "bandit", payload)).orderBy("ord").collect()
    assert [(r.file, r.line_start, r.summary) for r in rows] == [("src/a.py", 4, "x"), ("b.py", 9, "t"), ("c.py", 1, "Bandit finding")]


def test_dependency_report_is_flattened(spark):
    vulnerability = {
        "id": "G-1",
        "aliases": ["CVE-1", "CVE-2"],
        "database_specific": {"severity": " high "},
        "affected": [{"ranges": [{"events": [{"introduced": "0"}, {"fixed": "2.0"}, {"fixed": "3.0"}]}, {"events": [{"fixed": "9"}]}]}],
    }
    payload = {
        "results": [
            {"source": {"path": "uv.lock"}, "packages": [
                {"package": {"name": "p", "ecosystem": "PyPI", "version": "1"}, "vulnerabilities": [vulnerability, {"id": "G-2"}]},
                {"package": {"ecosystem": "PyPI"}, "vulnerabilities": [vulnerability]},
            ]},
            {"packages": [{"package": {"name": "q"}, "vulnerabilities": [{"database_specific": {"severity": "moderate"}}]}]},
        ]
    }
    rows = evidence.dep_findings(loaded(spark, "osv-scanner", payload)).orderBy("ord").collect()
    assert [(r.package, r.ecosystem, r.version, r.vulnerability_id, r.aliases, r.severity, r.fixed_version, r.source_file) for r in rows] == [
        ("p", "PyPI", "1", "G-1", ["CVE-1", "CVE-2"], "High", "2.0", "uv.lock"),
        ("p", "PyPI", "1", "G-2", [], "Unknown", None, "uv.lock"),
        ("q", "unknown", "unknown", "unknown", [], "Unknown", None, "unknown"),
    ]


ATTEMPTS = "run_id string, attempt int, tool string, tool_found boolean, timed_out boolean, exit_code int, stdout string, stderr string"


def test_tool_statuses(spark):
    rows = [
        ("missing", 1, "semgrep", False, False, None, "", ""),
        ("timeout", 1, "semgrep", True, True, None, "", ""),
        ("no-context", 1, "osv-scanner", True, False, 128, " out ", ""),
        ("bad", 1, "semgrep", True, False, 128, "", " boom "),
        ("empty", 1, "semgrep", True, False, 0, " ", "warn"),
        ("text", 1, "bandit", True, False, 1, "hello", ""),
        ("fine", 1, "bandit", True, False, 1, "x {\"a\": 1}", ""),
    ]
    got = {r.run_id: (r.status, r.error, r.exit_code, r.details) for r in evidence.tool_status(spark.createDataFrame(rows, ATTEMPTS)).collect()}
    assert got == {
        "missing": ("unavailable", "semgrep not found", None, "semgrep not found"),
        "timeout": ("failed", "semgrep timed out", None, "semgrep timed out"),
        "no-context": ("unavailable", "out", 128, "out"),
        "bad": ("failed", "boom", 128, "boom"),
        "empty": ("completed", None, 0, "warn"),
        "text": ("failed", "bandit produced non-JSON output", 1, "bandit produced non-JSON output"),
        "fine": ("completed", None, 1, None),
    }


def test_second_attempt(spark):
    schema = "run_id string, attempt int, status string, error string, exit_code int, stderr string"
    rows = [
        ("first", 1, "completed", None, 0, None), ("first", 2, "failed", "e2", 2, None),
        ("second", 1, "failed", "e1", 2, None), ("second", 2, "completed", None, 1, None),
        ("both", 1, "unavailable", "e1", 128, "s1"), ("both", 2, "failed", "e2", 0, None),
        ("none", 1, "unavailable", "e1", 128, None), ("none", 2, "unavailable", "e2", None, "s2"),
        ("only2", 2, "failed", "e2", 3, None), ("only1", 1, "failed", "e1", 3, None),
    ]
    statuses = spark.createDataFrame(rows, schema)
    got = {r.run_id: tuple(r)[1:] for r in evidence.attempt_fallback(statuses).collect()}
    assert got == {
        "first": ("completed", None, 0, None),
        "second": ("completed", None, 1, None),
        "both": ("failed", "e1; fallback: e2", 128, "s1"),
        "none": ("unavailable", "e1; fallback: e2", 128, "s2"),
        "only2": ("failed", "e2", 3, None),
        "only1": ("failed", "e1", 3, None),
    }
    no_fallback = {r.run_id: r.status for r in evidence.attempt_fallback(statuses, fallback=False).collect()}
    assert no_fallback["second"] == "failed"


def test_status_rollup(spark):
    rows = [("a", "unavailable"), ("b", "failed"), ("c", "completed"), ("c", "failed"), ("d", "unavailable"), ("d", "failed"), ("e", None)]
    runs = spark.createDataFrame([(x,) for x in "abcdef"], "run_id string")
    got = {r.run_id: r.status for r in evidence.dependency_status(spark.createDataFrame(rows, "run_id string, status string"), runs).collect()}
    assert got.pop("f") == "unavailable"
    assert got == {"a": "unavailable", "b": "failed", "c": "completed", "d": "failed", "e": "unavailable"}
