from __future__ import annotations

import random
import subprocess
from collections import Counter

import pytest
from pyspark.sql import functions as F

from auditweave.functions import paths
from auditweave.functions.skew import first_n, neighbours, slice_bounds
from auditweave.operators import checks, inventory, profiling
from auditweave.operators.inventory import ScanPolicy
from auditweave.sources.files import readable_files, requests_below, scan_files

FILES = "repo string, run_id string, rel_path string, size_bytes bigint, content binary"


def table(spark, contents: dict[str, bytes], repo: str = "r"):
    rows = [(repo, f"run-{repo}", path, len(body), bytearray(body)) for path, body in contents.items()]
    return spark.createDataFrame(rows, FILES)


SAMPLE = {
    "app.py": b"from fastapi import FastAPI\n",
    "routes/users.js": b"module.exports = 1\n",
    "package.json": b'{"dependencies": {"express": "4"}, "devDependencies": {"react": "18"}}',
    "requirements.txt": b"fastapi==0.1\nuvicorn==0.2\n",
    "dist/x.js": b"x",
}


@pytest.fixture
def tree(tmp_path):
    for path, body in {**SAMPLE, ".git/config": b"no", "sub dir/a+b %20.py": b"x = 1\n", ".hidden/x.py": b"y"}.items():
        target = tmp_path / "sample" / path
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_bytes(body)
    return tmp_path


def test_scan_lists_hidden_files_without_version_control(spark, tree):
    found = scan_files(requests_below(spark, str(tree)))
    assert {(r.repo, r.rel_path, r.size_bytes) for r in found.collect()} == {
        ("sample", p, len(b)) for p, b in {**SAMPLE, "sub dir/a+b %20.py": b"x = 1\n", ".hidden/x.py": b"y"}.items()
    }


def test_sample_repository_profile(spark, tree):
    policy = ScanPolicy()
    labelled = inventory.skip_reason(readable_files(requests_below(spark, str(tree)), policy), policy)
    stats = inventory.scan_stats(labelled).first()
    assert (stats.total_files_seen, stats.files_scanned, stats.ignored_pathspec) == (7, 6, 1)
    profile = profiling.repo_profile(inventory.language_map(labelled.filter("reason is null"))).first()
    assert profile.languages_detected == ["JavaScript", "Python"]
    assert profile.frameworks_detected == ["Express", "FastAPI", "React"]
    assert profile.first_entry_points == ["app.py"]
    assert profile.architecture_hints == ["route-controller-pattern"]
    assert profile.n_manifests == 2


def test_skip_reasons_of_real_bytes(spark):
    rows = table(
        spark,
        {
            "ok.py": b"print('ok')",
            "big.txt": b"x" * 5000,
            "nul.bin": b"\xff\xfe\x00",
            "late.txt": b"a" * 60 + b"\x00",
            "latin.txt": b"caf\xe9",
            "node_modules/x.js": b"1",
            "edge.txt": b"y" * 100,
        },
    )
    reasons = {r.rel_path: r.reason for r in inventory.skip_reason(rows, ScanPolicy(max_file_bytes=100)).collect()}
    assert reasons == {
        "ok.py": None, "big.txt": "too_large", "nul.bin": "binary", "late.txt": "binary", "latin.txt": "encoding_error",
        "node_modules/x.js": "ignored_pathspec", "edge.txt": None,
    }


def test_nul_after_the_head_is_not_binary(spark):
    rows = table(spark, {"a.txt": b"a" * 1024 + b"\x00"})
    assert inventory.skip_reason(rows, ScanPolicy()).first().reason is None


def test_lockfiles_ignore_size_but_not_policy(spark):
    rows = table(spark, {"requirements.txt": b"x" * 50, "tests/fixtures/requirements.txt": b"x", "a/uv.lock": b"\x00"})
    found = inventory.lockfiles(rows, ScanPolicy(max_file_bytes=10))
    assert {r.rel_path for r in found.collect()} == {"requirements.txt", "a/uv.lock"}


def test_lockfile_candidates_are_resolved(spark):
    rows = table(spark, {"requirements.txt": b"", "a/uv.lock": b""})
    wanted = ["requirements.txt", "/data/r/requirements.txt", "/etc/requirements.txt", "gone.lock", "./a/../a//uv.lock", "../r2/uv.lock"]
    candidates = spark.createDataFrame([("r", "/data/r/", p) for p in wanted], "repo string, root string, path string")
    found = inventory.lockfile_resolve(candidates, rows)
    assert sorted(r.rel_path for r in found.collect()) == ["a/uv.lock", "requirements.txt"]


@pytest.mark.parametrize(
    "glob, yes, no",
    [
        ("tests/fixtures/**", ["tests/fixtures/a", "tests/fixtures/b/c"], ["tests/fixtures", "x/tests/fixtures/a"]),
        ("**/*", ["a", "a/b"], []),
        ("*.py", ["a.py", "x/a.py", "a.py/inner"], ["a.pyc"]),
        ("/docs", ["docs", "docs/a"], ["x/docs"]),
        ("build/", ["build/a", "x/build/a"], ["build"]),
        ("a/**/z", ["a/z", "a/b/z", "a/b/c/z"], ["z", "b/a/z"]),
        ("f?o[0-9].c", ["foo1.c"], ["fo/1.c", "fooo1.c", "foox.c"]),
        ("**/lock", ["lock", "a/lock"], ["alock"]),
    ],
)
def test_globs(spark, glob, yes, no):
    rows = spark.createDataFrame([(p,) for p in yes + no], "p string")
    got = {r.p for r in rows.filter(paths.matches_globs(F.col("p"), [glob])).collect()}
    assert got == set(yes)


def test_last_glob_decides(spark):
    rows = spark.createDataFrame([("a.log",), ("keep.log",), ("b.txt",)], "p string")
    hit = paths.matches_globs(F.col("p"), ["*.log", "!keep.log", "# note", ""])
    assert {r.p for r in rows.filter(hit).collect()} == {"a.log"}


@pytest.mark.parametrize(
    "name, suffix", [("a.py", ".py"), (".py", ""), ("a.b.PY", ".py"), ("d.x/readme", ""), ("x.", ""), ("a/.b.rs", ".rs")]
)
def test_suffix(spark, name, suffix):
    assert spark.createDataFrame([(name,)], "p string").select(paths.file_suffix(F.col("p"))).first()[0] == suffix


@pytest.mark.parametrize(
    "raw, tidy", [("./a//b/./c/", "a/b/c"), ("a/../b", "a/../b"), ("././x", "x"), ("./", "."), ("/a/./b", "/a/b"), ("/", "/")]
)
def test_tidy_path(spark, raw, tidy):
    assert spark.createDataFrame([(raw,)], "p string").select(paths.tidy_path(F.col("p"))).first()[0] == tidy


def test_cap_matches_a_walk_in_path_order(spark):
    generator = random.Random(3)
    rows = [
        (repo, f"run-{repo}", f"{generator.randrange(10**6):06d}", None if generator.random() < 0.5 else "too_large")
        for repo, n in (("hot", 400), ("small", 6), ("edge", 20))
        for _ in range(n)
    ]
    labelled = spark.createDataFrame(rows, "repo string, run_id string, rel_path string, reason string")
    for cap in (1, 10, 1000):
        expected = set()
        for repo in ("hot", "small", "edge"):
            taken = 0
            for row in sorted(r for r in rows if r[0] == repo):
                if taken >= cap:
                    break
                expected.add(row)
                taken += row[3] is None
        got = {tuple(r) for r in inventory.max_files_cap(labelled, cap).select("repo", "run_id", "rel_path", "reason").collect()}
        assert got == expected


def test_first_n_of_a_hot_group(spark):
    rows = [("hot" if i % 10 else "cold", (i * 7919) % 10007) for i in range(3000)]
    table_ = spark.createDataFrame(rows, "k string, v int")
    got = first_n(table_, ["k"], [F.col("v")], 25, ["v"], salts=5)
    for key in ("hot", "cold"):
        expected = sorted(v for k, v in rows if k == key)[:25]
        assert [r.v for r in got.filter(F.col("k") == key).orderBy("position").collect()] == expected


def test_sparse_sequence_numbers_make_few_slices(spark):
    """A log numbered by microseconds: border rows follow the number of rows, and every neighbour is found."""
    rng = random.Random(7)
    rows = {("hot", rng.randrange(10**15)) for _ in range(4000)} | {(f"run{i % 50}", 10**15 + i * 10**9) for i in range(500)}
    rows = sorted(rows)
    log = spark.createDataFrame([(k, s, f"v{s}") for k, s in rows], "k string, seq long, v string").repartition(6)
    bounds = slice_bounds(log, ["k"], "seq", 500).collect()
    assert [b.k for b in bounds] == ["hot"] and len(bounds[0]._bounds) == 7
    sizes = Counter(sum(b < s for b in bounds[0]._bounds) for k, s in rows if k == "hot")
    assert max(sizes.values()) < 1.2 * min(sizes.values())
    got = {(r.k, r.seq): (r.b, r.a) for r in neighbours(log, ["k"], "seq", F.col("v"), before="b", after="a", slice_rows=500).collect()}
    assert len(got) == len(rows)
    for (k, s), left, right in zip(rows, [None, *rows], [*rows[1:], None], strict=False):
        assert got[k, s] == (f"v{left[1]}" if left and left[0] == k else None, f"v{right[1]}" if right and right[0] == k else None)


@pytest.mark.parametrize("width", [1, 3, 1000])
def test_neighbours_across_slices(spark, width):
    generator = random.Random(5)
    rows = [(generator.choice(["hot", "hot", "hot", "b"]), seq, None if seq % 11 == 0 else f"s{seq}") for seq in range(120)]
    table_ = spark.createDataFrame(rows, "k string, seq bigint, v string")
    got = neighbours(table_, ["k"], "seq", F.col("v"), before="b", after="a", slice_rows=width)
    found = {(r.k, r.seq): (r.b, r.a) for r in got.collect()}
    for key in ("hot", "b"):
        mine = [r for r in rows if r[0] == key]
        for i, row in enumerate(mine):
            before = mine[i - 1][2] if i else None
            after = mine[i + 1][2] if i + 1 < len(mine) else None
            assert found[(key, row[1])] == (before, after)


def test_profile_of_many_paths(spark):
    """The only entry point sorts behind thousands of manifests; many entry points give the first three."""
    contents = {f"a{i:05d}/package.json": b"{}" for i in range(3000)} | {"zz/main.py": b"x"}
    rows = inventory.scanned_files(table(spark, contents), ScanPolicy())
    found = profiling.repo_profile(rows).collect()
    assert [(p.has_entry_point, p.first_entry_points, p.n_entry_points, p.n_manifests) for p in found] == [(True, ["zz/main.py"], 1, 3000)]
    assert checks.architecture_type(profiling.repo_profile(rows)).first().architecture_type == "monolith"
    assert profiling.profile_paths(rows).count() == 3001
    many = inventory.scanned_files(table(spark, {f"d{i:02d}/main.py": b"x" for i in range(25)}), ScanPolicy())
    sentence = checks.runtime_summary(profiling.repo_profile(many)).first().runtime_flow_summary
    assert sentence.startswith("Starts from d00/main.py, d01/main.py, d02/main.py and")


def test_manifest_counts_rules(spark):
    contents = {
        "a/requirements.txt": b"# c\r\nx\r\n\r\n  \n # indented\ny",
        "b/pyproject.toml": b'[p]\nd = [\n  "a>=1",\n\t"b",\n x "c",\n]\n',
        "c/pom.xml": b"<dependency></dependency><dependency>",
        "d/package.json": b'{"dependencies": {"a": "1"}, "devDependencies": {"a": "1", "b": "2"}}',
        "e/package.json": b"{broken",
        "f/package.json": b'{"name": "none"}',
    }
    counts = profiling.manifest_counts(inventory.scanned_files(table(spark, contents), ScanPolicy()))
    assert {r.path[0]: r.direct_dependency_count for r in counts.collect()} == {"a": 4, "b": 2, "c": 2, "d": 3, "e": 0, "f": 0}


def test_repo_names_from_urls(spark):
    urls = ["https://github.com/o/r", "git@github.com:o/r2.git", "https://example.org/x", None]
    rows = inventory.repo_from_url(spark.createDataFrame([(u,) for u in urls], "github_url string"))
    assert [r.repo_name for r in rows.collect()] == ["r", "r2", None, None]


PATTERNS = ["*.md", "!keep.md", "a/", "/b", "b/**", "**/c", "a/*.py", "!a/", "x?z", "[xy]*", "[!a-m]1", "\\#odd", "# comment", "", "d ", "/a/b/", "!*.py", "*", "!*/", "**", "a**b", "c/d/*", "*.p[yx]", "(1)", "e+f", "!/b/keep.md"]
NAMES = ["a", "b", "c", "d", "xyz", "x1", "m1", "keep.md", "one.md", "t.py", "#odd", "(1)", "e+f", "ab", "aXb"]


def test_nested_ignore_files_as_git_sees_them(spark, tmp_path):
    """Random trees with ignore files at several depths, against the files that git lists."""
    rng = random.Random(21)
    rows, want = [], set()
    for number in range(25):
        root, paths_of = tmp_path / f"r{number}", {}
        for _ in range(40):
            parts = [rng.choice(NAMES[:7]) for _ in range(rng.randrange(4))] + [rng.choice(NAMES)]
            if not any("/".join(parts[:i]) in paths_of for i in range(1, len(parts))) and not any(p.startswith("/".join(parts) + "/") for p in paths_of):
                paths_of["/".join(parts)] = b"x"
        folders = sorted({p.rsplit("/", n)[0] if p.count("/") >= n else "" for p in paths_of for n in (1, 2, 3)})
        for folder in rng.sample(folders, min(3, len(folders))):
            lines = [rng.choice(PATTERNS) for _ in range(rng.randrange(1, 5))]
            paths_of[f"{folder}/.gitignore".lstrip("/")] = ("\n".join(lines) + rng.choice(["", "\n", "\r\n"])).encode()
        for path, body in paths_of.items():
            (root / path).parent.mkdir(parents=True, exist_ok=True)
            (root / path).write_bytes(body)
            rows.append((f"r{number}", f"run-r{number}", path, len(body), bytearray(body)))
        subprocess.run(["git", "init", "-q"], cwd=root, check=True)
        out = subprocess.run(["git", "-c", "core.quotePath=false", "-c", "core.excludesFile=", "ls-files", "-z", "--others", "--exclude-standard"], cwd=root, check=True, capture_output=True)
        want |= {(f"r{number}", path) for path in out.stdout.decode().split("\0") if path}
    files = spark.createDataFrame(rows, FILES).repartition(4)
    got = {(r.repo, r.rel_path) for r in inventory.nested_ignore(files).collect()}
    assert got == want and 0.2 * len(rows) < len(got) < 0.95 * len(rows)


def test_stronger_ignore_files_and_trees_without_any(spark):
    files = table(spark, {".gitignore": b"*.log\n", "sub/.ignore": b"!deep.log\n", "sub/deep.log": b"", "sub/x/deep.log": b"", "top.log": b"", "a.py": b""}).unionByName(table(spark, {"top.log": b""}, "other"))
    kept = {(r.repo, r.rel_path) for r in inventory.nested_ignore(files).collect()}
    assert kept == {("r", p) for p in (".gitignore", "sub/.ignore", "sub/deep.log", "sub/x/deep.log", "a.py")} | {("other", "top.log")}
    assert inventory.nested_ignore(files.limit(0)).count() == 0
