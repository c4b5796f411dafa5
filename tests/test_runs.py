"""Compaction, redaction, reports, run log, sinks, streaming and the whole job."""

from __future__ import annotations

import json
import os
import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from auditweave import fixed_values as V
from auditweave.functions.text import count_tokens, redacted, token_count, token_count_of_many
from auditweave.operators import checks, compaction, redaction, reporting, runlog
from auditweave.plans import audit
from auditweave.sources import documents, reports, tables
from auditweave.streaming import feeds

EVIDENCE = (
    "run_id string, ord bigint, id string, file string, line_start int, line_end int, snippet_hash string, source string, "
    "signal_type string, summary string, confidence double"
)
DEPENDENCIES = (
    "run_id string, ord bigint, package string, ecosystem string, version string, vulnerability_id string, "
    "severity string, fixed_version string, source_file string"
)


def sample_evidence(spark, n=120, run="run"):
    rows = [
        (run, i, f"e-{i}", f"src/file_{i % 3}.py", i % 50 + 1, i % 50 + 1, f"h{i}", "bandit" if i % 2 == 0 else "semgrep", "vuln", f"finding-{i % 7}", 0.8)
        for i in range(n)
    ]
    return spark.createDataFrame(rows, EVIDENCE), rows


def test_compaction_caps_and_order(spark):
    found, rows = sample_evidence(spark)
    deps = spark.createDataFrame(
        [("run", i, f"pkg-{i}", "PyPI", "1.0.0", f"GHSA-{i}", "High" if i % 3 == 0 else "Medium", None, "requirements.txt") for i in range(90)],
        DEPENDENCIES,
    )
    runs = spark.createDataFrame([("run",), ("bare",)], "run_id string")
    context = {
        r.run_id: r
        for r in compaction.compacted_context(runs, found, deps, 40, {"bandit": 20, "semgrep": 15}, 25).collect()
    }
    mine = context["run"]
    assert (mine.original_evidence_count, mine.compacted_evidence_count) == (120, 35)
    assert (mine.original_dependency_findings, mine.compacted_dependency_findings) == (90, 25)
    # Brute force: dedup, sort, caps.
    first = {}
    for r in rows:
        first.setdefault((r[3], r[4], r[7], r[9]), r)
    kept, used = [], {}
    for r in sorted(first.values(), key=lambda r: (r[7], r[3], r[4], r[5], r[9], r[2])):
        if used.get(r[7], 0) < {"bandit": 20, "semgrep": 15}[r[7]] and len(kept) < 40:
            kept.append(r[2])
            used[r[7]] = used.get(r[7], 0) + 1
    assert [e.id for e in mine.evidence_index] == kept
    assert [d.severity for d in mine.vulnerability_findings] == ["High"] * 25
    assert context["bare"].evidence_index == [] and context["bare"].compacted_dependency_findings == 0
    minimal = compaction.minimal_context(runs, deps).filter("run_id = 'run'").first()
    assert (minimal.mode, len(minimal.vulnerability_findings), minimal.dependency_findings) == ("minimal", 20, 90)


def test_tiers(spark):
    sizes = spark.createDataFrame([("a", 10, 5, 1), ("b", 200, 50, 1), ("c", 200, 150, 20), ("d", 200, 150, 120)], "run_id string, full_tokens bigint, compact_tokens bigint, minimal_tokens bigint")
    got = {r.run_id: r.tier for r in compaction.context_tier(sizes, {"s": 100}).collect()}
    assert got == {"a": "full", "b": "compact", "c": "minimal", "d": "over_budget"}
    strict = {r.run_id: r.tier for r in compaction.context_tier(sizes, {"s": 100}, compaction=False).collect()}
    assert strict["b"] == "over_budget"


@pytest.mark.parametrize(
    "text, expected",
    [
        ("Authorization: Bearer abc.def-1", "Authorization: Bearer [REDACTED]"),
        ("x sk-abcdefghijklmnopqrst y", "x [REDACTED] y"),
        ("token = 'abcdefgh12'", "token = [REDACTED]"),
        ("api_key: \"abcdefgh12\" token=short", "api_key: [REDACTED] token=short"),
        ("pk-lf-12345678", "[REDACTED]"),
        ("token=[REDACTED]", "token=[REDACTED]"),
    ],
)
def test_redaction(spark, text, expected):
    assert spark.createDataFrame([(text,)], "t string").select(redacted(F.col("t"))).first()[0] == expected


def test_nested_redaction_keeps_shape_and_keys(spark):
    schema = "id int, body struct<`api.key`:string,nested:struct<token:string,values:array<string>>,m:map<string,array<struct<t:string>>>>"
    secret = "token=abcdefghij"
    rows = spark.createDataFrame([(1, (secret, (secret, ["ok", secret, None]), {secret: [(secret,)]})), (2, None)], schema)
    out = redaction.redact_nested(rows)
    assert out.schema.simpleString() == rows.schema.simpleString()
    body = out.orderBy("id").collect()[0].body
    assert body.nested["values"] == ["ok", "token=[REDACTED]", None]
    assert list(body.m) == [secret] and body.m[secret][0].t == "token=[REDACTED]"
    assert out.orderBy("id").collect()[1].body is None


def test_tokens_of_batches_are_those_of_the_pattern(spark):
    """Batches count what the pattern counts: borders of texts, nulls, other alphabets, slices, texts beyond a part."""
    generator = random.Random(5)
    words = ["ab", "A_9", " ", "-", "é", "漢", "x", "", "\n", "𝒳", '"', "٣"]
    texts = [None if i % 11 == 0 else "".join(generator.choices(words, k=generator.randrange(9))) for i in range(3000)] + ["", "a b " * 2_000_000, "z"]
    want = [None if t is None else len(re.findall(V.TOKEN_PATTERN, t, re.ASCII)) for t in texts]
    for kind in (pa.string(), pa.large_string()):
        batch = pa.array(texts, kind)
        assert count_tokens(batch).to_pylist() == want and count_tokens(batch[7:2900]).to_pylist() == want[7:2900]
    assert count_tokens(pa.array([], pa.string())).to_pylist() == [] and count_tokens(pa.array([None], pa.string())).to_pylist() == [None]
    rows = spark.createDataFrame([(t,) for t in texts[:400]], "t string").select(token_count(F.col("t")).alias("a"), token_count_of_many(F.col("t")).alias("b")).collect()
    assert [r.a for r in rows] == [r.b for r in rows] == want[:400]


def test_sizes_count_tokens_in_batches(spark):
    """No list of matches is made for each item."""
    rows = spark.createDataFrame([("r", 1, "e", "f", 1, 1, "h", "rg", "vuln", "s", 0.5)], EVIDENCE)
    none = spark.createDataFrame([], DEPENDENCIES).withColumn("ord", F.lit(1))
    plan = compaction.context_sizes(rows.select("run_id").distinct(), rows, none)._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp" not in plan and "ArrowEvalPython" in plan


def test_sizes_are_the_tokens_of_the_payloads(spark):
    """Against the JSON texts: runs with many rows, ties, caps that bite, and a run without anything."""
    generator = random.Random(11)
    pick = generator.choice
    rows = [
        (pick(["a", "a", "a", "b"]), i, f"e-{i}", f"f_{pick('xyz')}.py", n := generator.randrange(1, 4), n, f"h{i}", pick(["bandit", "semgrep", "osv", "rg"]), "vuln", pick(["one", "two words", "three more words", 'say "x"']), pick([0.5, 0.85]))
        for i in range(600)
    ]
    found = spark.createDataFrame(rows, EVIDENCE).repartition(5)
    deps = spark.createDataFrame(
        [(pick("aab"), i, f"pkg {pick('pq')}", "PyPI", f"{i % 5}.0", f"GHSA-{pick('uvw')}", pick(["High", "Low", "Unknown"]), pick([None, "2.0"]), "r.txt") for i in range(300)], DEPENDENCIES
    )
    runs = spark.createDataFrame([(r, "1.0.0", "completed") for r in ("a", "b", "bare")], "run_id string, schema_version string, vulnerability_scan_status string")
    runs = runs.withColumn("repo_profile", F.struct(F.lit("my repo").alias("repo_name"), F.array(F.lit("Go")).alias("languages_detected"))).withColumn("scan_stats", F.struct(F.lit(3).alias("files_scanned")))
    more = {
        "folders": spark.createDataFrame([("a", f"d{i}", "Source folder", 0.5) for i in range(7)], "run_id string, path string, purpose_guess string, confidence double"),
        "manifests": spark.createDataFrame([("a", "package.json", "npm", 12), ("b", "go.mod", "go", 1)], "run_id string, path string, ecosystem string, direct_dependency_count bigint"),
        "tool_runs": spark.createDataFrame([("a", "bandit", "failed", None, "many words " * 90), ("a", "osv", "completed", 0, None), ("b", "osv", "completed", 1, "x")], "run_id string, tool string, status string, exit_code int, details string"),
    }
    limits = {"total": 40, "per_source": {"bandit": 9, "semgrep": 20, "osv": 2}, "dependency_limit": 25}
    sizes = {r.run_id: r for r in compaction.context_sizes(runs, found, deps, **limits, minimal_limit=6, **more).collect()}
    assert sorted(sizes) == ["a", "b", "bare"]

    def tokens(context):
        return {r.run_id: len(re.findall("[A-Za-z0-9_]+", r.payload)) for r in compaction.payload_json(context).collect()}

    assert {r: s.compact_tokens for r, s in sizes.items()} == tokens(compaction.compacted_context(runs, found, deps, **limits, **more))
    assert {r: s.minimal_tokens for r, s in sizes.items()} == tokens(compaction.minimal_context(runs, deps, 6, more["manifests"], more["tool_runs"]))
    # Nothing is capped: the payload is the full one but for its note on the compaction and the details that are cut.
    unique = found.withColumn("summary", F.concat("summary", F.lit(" "), "ord"))
    whole = {"total": 10_000, "per_source": {}, "dependency_limit": 10_000}
    plain = more | {"tool_runs": more["tool_runs"].withColumn("details", F.left("details", F.lit(400)))}
    sizes = {r.run_id: r.full_tokens for r in compaction.context_sizes(runs, unique, deps, **whole, **plain).collect()}
    note = 3 + 2 * len(compaction.COMPACTION_COUNTS)
    assert {r: n + note for r, n in sizes.items()} == tokens(compaction.compacted_context(runs, unique, deps, **whole, **plain))


LOG = "run_id string, node_id string, to_state string, seq bigint, ts timestamp"


def at(second: int) -> str:
    return f"2024-01-01 00:00:{second:02d}"


def log_table(spark, rows):
    return spark.createDataFrame([(r, n, s, q, at(q)) for r, n, s, q in rows], LOG.replace("timestamp", "string")).withColumn("ts", F.to_timestamp("ts"))


def test_run_log(spark):
    rows = [
        ("a", "start", "completed", 0), ("a", "scanner", "running", 1), ("a", "scanner", "completed", 2),
        ("a", "architecture", "running", 3), ("a", "security", "running", 4), ("a", "performance", "running", 5),
        ("a", "security", "failed", 6), ("a", "architecture", "completed", 7), ("a", "performance", "completed", 8),
        ("a", "roadmap", "running", 9), ("a", "roadmap", "completed", 10),
        ("b", "start", "completed", 11), ("b", "scanner", "running", 12),
    ]
    log = log_table(spark, rows)
    nodes = {r.run_id: r.nodes for r in runlog.completed_nodes(log).collect()}
    assert nodes == {"a": ["start", "scanner", "architecture", "performance", "roadmap"], "b": ["start"]}
    plan = {(r.run_id, r.node_id) for r in runlog.resume_plan(log).collect()}
    assert ("a", "security") in plan and len([p for p in plan if p[0] == "a"]) == 1 and len(plan) == 6
    assert [tuple(r) for r in runlog.roadmap_state(log).collect()] == [("a", "degraded")]
    assert [r.run_id for r in runlog.fan_in_ready(log).collect()] == ["a"]
    chain = {r.seq: r.from_state for r in runlog.transition_chain(log, slice_rows=2).collect()}
    assert (chain[0], chain[1], chain[5], chain[11], chain[12]) == ("pending", "completed", "running", "pending", "completed")
    assert runlog.chain_breaks(runlog.transition_chain(log)).count() == 0
    spans = {(r.run_id, r.node_id, r.seq): (r.closed_by, r.ended_at.second) for r in runlog.stage_spans(log, slice_rows=3).collect()}
    assert spans[("a", "security", 4)] == ("failed", 6)
    assert spans[("b", "scanner", 12)] == ("run_end", 12)
    assert spans[("a", "start", 0)] == ("instant", 0)
    stages = reporting.stage_status(runlog.latest_state(log).withColumnRenamed("node_id", "stage"))
    assert [r.run_id for r in reporting.hard_failures(stages).collect()] == ["b"]


def test_upsert_keeps_the_first_start(spark):
    schema = "run_id string, status string, started_at string, seq bigint"
    old = spark.createDataFrame([("a", "s1", "t1", 1), ("b", "s1", "t1", 1)], schema)
    new = spark.createDataFrame([("a", "s3", "t3", 3), ("a", "s2", "t2", 2), ("c", "s1", "t9", 4)], schema)
    got = {r.run_id: (r.status, r.started_at) for r in tables.upsert_runs(old, new).collect()}
    assert got == {"a": ("s3", "t1"), "b": ("s1", "t1"), "c": ("s1", "t9")}
    store = tables.manifest_rows(old.withColumnRenamed("status", "s"))
    assert tables.get_manifest(store, "a", "run_id string, s string").first().s == "s1"
    assert tables.get_manifest(store, "zzz", "run_id string, s string").count() == 0


def test_reports_are_written_in_order(spark, tmp_path):
    """A run with almost all lines spans several files whose name order is line order."""
    generator = random.Random(1)
    rows = [("hot" if i % 20 else "cold", 1, 0, i, 0.0, "", 0, f"line {i}") for i in range(5000)]
    generator.shuffle(rows)
    lines = spark.createDataFrame(rows, "run_id string, section int, part int, k1 bigint, k2 double, k3 string, k4 bigint, line string")
    documents.write_report(lines, str(tmp_path / "report"), partitions=6)
    for run in ("hot", "cold"):
        want = [f"line {i}" for i in range(5000) if (i % 20 > 0) == (run == "hot")]
        assert [r.value for r in documents.read_document(spark, str(tmp_path / "report"), run).collect()] == want
        target = tmp_path / f"{run}-text"
        documents.export_document(spark, str(tmp_path / "report"), run, str(target))
        assert "".join((target / p).read_text() for p in sorted(os.listdir(target)) if p.startswith("part-")).splitlines() == want
    bucket = documents.bucket_of(F.lit("hot"))
    number = spark.range(1).select(bucket.alias("b")).first().b
    assert len([p for p in os.listdir(tmp_path / "report" / f"bucket={number}") if p.startswith("part-")]) > 1


def files_read(rows):
    """Files that the scan of a plan opened."""
    session = rows.sparkSession
    session.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        fresh = rows.select("*")
        fresh.collect()
        return fresh._jdf.queryExecution().executedPlan().collectLeaves().apply(0).metrics().apply("numFiles").value()
    finally:
        session.conf.set("spark.sql.adaptive.enabled", "true")


def data_files(folder):
    return [os.path.join(d, f) for d, _, names in os.walk(folder) for f in names if f.startswith("part-")]


def test_number_of_files_does_not_follow_the_runs(spark, tmp_path):
    """Thousands of summaries in at most a file a bucket; one run is read by opening its bucket."""
    made = spark.range(3000).select(F.concat(F.lit("run-"), F.col("id").cast("string")).alias("run_id"), F.to_json(F.struct("id")).alias("document"))
    documents.write_summary(made, str(tmp_path / "summary"))
    total = len(data_files(tmp_path / "summary"))
    assert total <= 2 * documents.DOCUMENT_BUCKETS
    one = documents.read_document(spark, str(tmp_path / "summary"), "run-77")
    assert [json.loads(r.value) for r in one.collect()] == [{"id": 77}]
    assert files_read(one) <= 2
    assert documents.read_documents(spark, str(tmp_path / "summary")).count() == 3000
    assert documents.read_document(spark, str(tmp_path / "summary"), "nobody").count() == 0


def test_point_lookup_opens_one_bucket(spark, tmp_path):
    """The transitions of one run come from its bucket alone, over all days and appends."""
    path = str(tmp_path / "log")
    for day in (1, 2):
        log = spark.range(2000).select(
            F.concat(F.lit("run-"), (F.col("id") % 200).cast("string")).alias("run_id"), F.lit("scanner").alias("node_id"), F.lit("running").alias("to_state"),
            (F.col("id") + 10_000 * day).alias("seq"), F.to_timestamp(F.lit(f"2024-01-0{day} 10:00:00")).alias("ts"), F.lit("failed, token=abcdefabcdef").alias("reason"),
        )
        tables.append_transitions(log, path)
    one = tables.list_transitions(spark, path, "run-7")
    assert [r.seq for r in one.collect()] == [d * 10_000 + i for d in (1, 2) for i in range(7, 2000, 200)]
    assert files_read(one) == 2 and len(data_files(path)) > 40
    assert {r.reason for r in one.collect()} == {"failed, token=[REDACTED]"}
    whole = tables.list_transitions(spark, path)
    assert whole.count() == 4000 and "bucket" not in whole.columns
    assert tables.list_transitions(spark, path, "nobody").count() == 0


def test_late_rows_are_dropped(spark, tmp_path):
    folder = tmp_path / "in"
    batches = [["2024-01-01 10:00:00"], ["2024-01-05 10:00:00"], ["2024-01-06 10:00:00"], ["2024-01-01 11:00:00", "2024-01-06 11:00:00"]]
    for number, times in enumerate(batches):
        part = spark.createDataFrame([("scanner", "running", t) for t in times], "node_id string, to_state string, t string")
        part.select("node_id", "to_state", F.to_timestamp("t").alias("ts")).coalesce(1).write.parquet(str(folder / f"b={number}"))
        os.utime(folder / f"b={number}", (1000 + number, 1000 + number))
        for name in os.listdir(folder / f"b={number}"):
            os.utime(folder / f"b={number}" / name, (1000 + number, 1000 + number))
    feed = feeds.read_feed(spark, f"{folder}/*", "node_id string, to_state string, ts timestamp", files_per_batch=1)
    table = str(tmp_path / "out")
    feeds.run_window_counts(feeds.window_counts(feed), table, str(tmp_path / "log"))
    got = {str(r.window_start)[:10]: r.n for r in feeds.final_counts(spark, table).collect()}
    assert got == {"2024-01-01": 1, "2024-01-05": 1, "2024-01-06": 2}


def test_incremental_merge_resumes(spark, tmp_path):
    schema = "run_id string, status string, started_at string, finished_at string, seq bigint"
    folder, root, log = (str(tmp_path / n) for n in ("in", "runs", "log"))

    def arrive(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
        feeds.run_incremental_merge(spark, feeds.read_feed(spark, folder, schema), root, log)
        return {r.run_id: (r.status, r.started_at) for r in feeds.merged_rows(spark, root).collect()}

    assert arrive([("a", "s1", "t1", "t1", 1)]) == {"a": ("s1", "t1")}
    assert arrive([("a", "s2", "t2", "t2", 2), ("b", "s1", "t3", "t3", 3)]) == {"a": ("s2", "t1"), "b": ("s1", "t3")}


def test_incremental_merge_leaves_other_buckets_alone(spark, tmp_path):
    """A batch rewrites its own buckets only, a repeated one changes nothing, and a stale root is refused."""
    schema = "run_id string, status string, started_at string, finished_at string, seq bigint"
    folder, root, log = (str(tmp_path / n) for n in ("in", "runs", "log"))

    def arrive(rows, checkpoint=log):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
        feeds.run_incremental_merge(spark, feeds.read_feed(spark, folder, schema), root, checkpoint)
        return {r.run_id: (r.status, r.started_at, r.seq) for r in feeds.merged_rows(spark, root).collect()}

    first = arrive([(f"run-{i}", "s1", "t1", "t1", i) for i in range(300)])
    before = {f: os.stat(f).st_mtime_ns for f in data_files(root)}
    assert len(first) == 300 and 50 < len(before) <= feeds.MERGE_BUCKETS
    second = arrive([("run-5", "s2", "t2", "t2", 1000), ("new", "s1", "t3", "t3", 1001)])
    assert second == first | {"run-5": ("s2", "t1", 1000), "new": ("s1", "t3", 1001)}
    after = {f: os.stat(f).st_mtime_ns for f in data_files(root)}
    assert len(set(before.items()) & set(after.items())) >= len(before) - 2
    assert arrive([("run-5", "s2", "t2", "t2", 1000)]) == second
    with pytest.raises(Exception, match="another stream"):
        arrive([("x", "s", "t", "t", 1)], checkpoint=str(tmp_path / "other"))
    assert {r.run_id: (r.status, r.started_at, r.seq) for r in feeds.merged_rows(spark, root).collect()} == second


@pytest.fixture
def trees(tmp_path):
    contents = {
        "one/app.py": "from fastapi import FastAPI\n",
        "one/routes/users.js": "module.exports = 1\n",
        "one/package.json": '{"dependencies": {"express": "4"}}',
        "one/dist/x.js": "x",
        "two/main.go": "package main\n",
    }
    for path, body in contents.items():
        target = tmp_path / "trees" / path
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_text(body)
    return tmp_path


def report_rows(spark):
    semgrep = {"results": [{"path": "app.py", "start": {"line": 2}, "extra": {"message": "Hardcoded secret in code"}}]}
    osv = {"results": [{"source": {"path": "package.json"}, "packages": [{"package": {"name": "express"}, "vulnerabilities": [{"id": "G-1"}]}]}]}
    rows = [("run-one", "one", "semgrep", 0, json.dumps(semgrep)), ("run-one", "one", "osv-scanner", 0, json.dumps(osv)), ("run-one", "one", "bandit", 0, "crash")]
    return spark.createDataFrame(rows, audit.REPORTS)


def test_whole_audit(spark, trees):
    out, log = str(trees / "out"), str(trees / "log")
    stages = audit.run_audit(spark, str(trees / "trees"), out, report_rows(spark), log)
    one = stages["findings"].filter("run_id = 'run-one'")
    assert one.count() == 1 + 8 + 7 + 1 and stages["findings"].filter("run_id = 'run-two'").count() == 16
    summary = {r.run_id: json.loads(r.value) for r in documents.read_documents(spark, f"{out}/summary").collect()}
    assert list(summary["run-one"]) == reporting.SUMMARY_FIELDS
    assert summary["run-one"]["frameworks"] == ["Express"] and summary["run-two"]["language_detected"] == ["Go"]
    assert {t["tool"]: t["status"] for t in summary["run-one"]["scanner_tooling"]} == {
        "bandit": "tool_execution_failed", "osv-scanner": "completed", "semgrep": "completed",
    }
    assert "bandit" not in {t["tool"] for t in summary["run-two"]["scanner_tooling"]}
    assert summary["run-one"]["top_security_risks"][0]["severity"] == "High"
    text = "\n".join(r.value for r in documents.read_document(spark, f"{out}/report", "run-one").collect())
    headings = [line for line in text.splitlines() if line.startswith("#")]
    from auditweave.fixed_values import REPORT_HEADINGS

    assert headings == REPORT_HEADINGS
    assert "- Entry points: app.py" in text and "- Files skipped: 1" in text
    payloads = {(r.run_id, r.tier): json.loads(r.payload) for r in stages["payloads"].collect()}
    assert len(payloads) == 4 and payloads["run-one", "compact"]["repo_profile"]["frameworks_detected"] == ["Express"]
    assert payloads["run-one", "compact"]["dependency_summary"]["vulnerability_findings"][0]["package"] == "express"
    assert payloads["run-one", "minimal"]["evidence_index"] == [] and payloads["run-one", "minimal"]["dependency_summary"]["manifest_count"] == 1
    tiers = stages["context_tiers"].filter("run_id = 'run-one'").first()
    assert tiers.compact_tokens == len(re.findall("[A-Za-z0-9_]+", json.dumps(payloads["run-one", "compact"]))) and tiers.tier == "full"
    manifest = json.loads(stages["run_manifests"].filter("run_id = 'run-one'").first().payload_json)
    assert manifest["repo"]["repo_name"] == "one" and manifest["analysis_status"]["roadmap"] == "completed"
    # Run again: all runs are in the log, so nothing is left to do, and nothing is listed.
    again = audit.run_audit(spark, str(trees / "trees"), str(trees / "out2"), report_rows(spark), log)
    assert again["runs"].count() == 0


def test_changed_repository_and_failed_branch(spark, trees):
    """A new run id audits a repository again; finished runs are not opened; a failed branch degrades its run."""
    log = str(trees / "log")
    root = str(trees / "trees")
    audit.run_audit(spark, root, str(trees / "o1"), report_rows(spark), log)
    (trees / "trees" / "two" / "new.py").write_text("x = 1\n")
    (trees / "trees" / "empty").mkdir()
    requests = spark.createDataFrame(
        [("run-one", "one", f"{root}/does-not-exist"), ("again", "two", f"{root}/two/"), ("none", "empty", f"{root}/empty")], "run_id string, repo string, root string"
    )
    failures = spark.createDataFrame([("again", "security", "boom, token=abcdefabcdef")], "run_id string, branch string, reason string")
    texts = spark.createDataFrame([("again", "two", "semgrep", 0, ""), ("again", "two", "bandit", 0, '{"results": [{"filename": "new.py", "issue_text": "x"}]}'), ("again", "two", "bandit", 1, "crash")], audit.REPORTS)
    stages = audit.run_audit(spark, requests, str(trees / "o2"), texts, log, failures=failures)
    assert sorted(r.run_id for r in stages["runs"].collect()) == ["again", "none"]
    assert sorted(stages["repo_profile"].filter("run_id = 'again'").first().languages_detected) == ["Go", "Python"]
    status = {(r.run_id, r.tool): r.status for r in stages["tool_runs"].collect()}
    assert status["again", "semgrep"] == "completed" and status["again", "bandit"] == "failed"
    assert stages["evidence"].filter("source = 'bandit'").count() == 0
    failed = stages["findings"].filter("run_id = 'again' and category = 'security'").collect()
    assert [(r.status, r.description) for r in failed] == [("failed", "boom, token=[REDACTED]")]
    summary = {r.run_id: json.loads(r.value) for r in documents.read_documents(spark, str(trees / "o2" / "summary")).collect()}
    assert sorted(summary) == ["again", "none"] and summary["none"]["language_detected"] == []
    assert "degraded" in json.dumps(summary["again"]) and "degraded" not in json.dumps(summary["none"])
    assert {r.status for r in stages["dependency_status"].collect()} == {"unavailable"}


def test_audit_is_repeatable(spark, trees):
    names = ("findings", "roadmap", "evidence")
    results = []
    for n in (1, 2):
        stages = audit.run_audit(spark, str(trees / "trees"), str(trees / f"o{n}"), report_rows(spark))
        results.append({k: sorted(map(str, stages[k].collect())) for k in names})
    assert results[0] == results[1]


def test_report_texts_from_files(spark, tmp_path):
    folder = tmp_path / "run_id=r" / "repo=x" / "tool=bandit"
    folder.mkdir(parents=True)
    (folder / "part=0.json").write_text('{"results": []}')
    row = reports.read_report_texts(spark, str(tmp_path)).first()
    assert (row.run_id, row.repo, row.tool, row.part) == ("r", "x", "bandit", 0)


def test_failed_and_missing_branches(spark):
    runs = spark.createDataFrame([("a",), ("b",)], "run_id string")
    states = spark.createDataFrame(
        [("a", "security", "failed", "boom"), ("a", "architecture", "completed", None), ("a", "performance", "completed", None)],
        "run_id string, branch string, status string, reason string",
    )
    got = {(r.run_id, r.category): (r.severity, r.description) for r in checks.failed_branch_fill(runs, states).collect()}
    assert got == {
        ("a", "security"): ("High", "boom"),
        ("b", "architecture"): ("Medium", "architecture branch output missing"),
        ("b", "security"): ("High", "security branch output missing"),
        ("b", "performance"): ("Medium", "performance branch output missing"),
    }
