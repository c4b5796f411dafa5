"""One DuckDB statement per query, written relationally rather than after the Spark plan."""

from __future__ import annotations

from auditweave import fixed_values as V
from auditweave.operators.checks import FAILED_BRANCH_SEVERITY
from auditweave.plans.registry import (
    DEPENDENCY_TOP,
    EVIDENCE_PER_SOURCE,
    EVIDENCE_TOTAL,
    MINIMAL_TOP,
    SCHEMA_VERSION,
    TIER_BUDGETS,
)
from oracles.tables import SEVERITY, case_map, case_rank, compose, in_list, text, values_table

TS = "'%Y-%m-%d %H:%M:%S.%f'"
STATEMENTS: dict[str, str] = {}

# --------------------------------------------------------------- sources, sinks
STATEMENTS["load_reports"] = (
    """select run_id, 'semgrep' as tool, part::bigint as part, true as readable, count(*) as results from semgrep_flat group by run_id, part
    union all select run_id, 'bandit', part::bigint, true, count(*) from bandit_flat group by run_id, part
    union all select run_id, 'osv-scanner', (l_orderkey * 8 + l_linenumber)::bigint, true, 2 from v_dep"""
)
STATEMENTS["recover_json"] = """select ord, case when ord % 10 <> 0 then ord end as found_ord, case when ord % 10 <> 0 then file end as found_file,
    case when ord % 10 <> 0 then summary end as found_summary from v_evidence"""
_MERGED = """select a.run_id, a.started_at, z.status, z.finished_at, z.seq
    from (select run_id, min(seq) as low, max(seq) as high from {rows} group by run_id) m
    join {rows} a on a.run_id = m.run_id and a.seq = m.low join {rows} z on z.run_id = m.run_id and z.seq = m.high"""
STATEMENTS["upsert_runs"] = _MERGED.format(rows="run_rows")
STATEMENTS["upsert_scan_outputs"] = """select run_id, '{"status":"' || status || '","seq":' || seq || '}' as payload_json, seq from run_rows r
    where not exists (select 1 from run_rows s where s.run_id = r.run_id and s.seq > r.seq)"""
STATEMENTS["append_transitions"] = f"select run_id, node_id, from_state, to_state, seq, strftime(ts, {TS}) as ts,\n    case when to_state = 'failed' then node_id || ' stopped, token=[REDACTED]' end as reason from chain"
_REPO_NAME = r"""case when source_type = 'local_path' then regexp_extract(rtrim(local_path, '/'), '[^/]*$')
    else coalesce(nullif(regexp_extract(github_url, 'github\.com[:/]([^/]+)/([^/.]+)', 2), ''), 'unknown-repo') end"""
_STATUS_MAP = "(select string_agg(node_id || '=' || state, '|' order by node_id) from latest l where l.run_id = r.run_id)"
STATEMENTS["manifest_store"] = f"select run_id, {_REPO_NAME} as repo_name, coalesce({_STATUS_MAP}, '') as analysis_status from v_requests r"
_REDACTED_FAILURES = "(select string_agg(branch || '=' || branch || ' stopped, token=[REDACTED]', '|' order by branch) from last_failures f where f.run_id = r.run_id)"
STATEMENTS["run_manifest"] = f"""select run_id, '{SCHEMA_VERSION}' as schema_version, created_at, name as repo_repo_name, commit_id as repo_git_commit_sha, profile as provider_profile, model as provider_model,
    case when source_type = 'local_path' then rtrim(local_path, '/') else '/workspace/' || name || '-' || run_id end as repo_resolved_path,
    {case_map('lower(trim(provider))', V.PROVIDER_SPELLINGS)} as provider_provider_type, max_tokens::bigint as provider_max_tokens,
    'python=3.12|semgrep=1.0' as tool_versions, 'architecture=v1|roadmap=v2|scanner=v1' as prompt_versions, 3::bigint as retries_max_attempts, 1.0::double as retries_backoff_seconds,
    0.2::double as retries_jitter_seconds, 900::bigint as timeouts_scanner_seconds, 600::bigint as timeouts_agent_seconds,
    coalesce({_STATUS_MAP}, '') as analysis_status, coalesce({_REDACTED_FAILURES}, '') as branch_failures
    from (select *, {_REPO_NAME} as name from v_requests) r"""

# -------------------------------------------------------------------- inventory
STATEMENTS["hard_exclude"] = f"""select doc_id, repo, rel_path from v_files
    where len(list_intersect(string_split(rel_path, '/'), [{','.join(text(s) for s in V.HARD_EXCLUDED_SEGMENTS)}])) = 0"""
STATEMENTS["glob_policy"] = r"""select doc_id, repo, rel_path from (select *, split_part(rel_path, '/', -1) as name from v_files)
    where (starts_with(rel_path, 'src/') or name like '%.py' or starts_with(rel_path, 'docs/') or name = 'uv.lock')
      and not ((starts_with(rel_path, 'tests/fixtures/') or name like '%.toml')
               and not (starts_with(rel_path, 'src/') and name = 'pyproject.toml'))"""
# The patterns of the ignore files as regular expressions below their folder: (pattern, regex, negated, folders only).
_IGNORE_PATTERNS = values_table(
    [
        ("*.md", "^(.*/)?[^/]*[.]md$", 0, 0), ("/m1*", "^m1[^/]*$", 0, 0), ("m?[0-4]/", "^(.*/)?m[^/][0-4]$", 0, 1), ("**/index.js", "^(.*/)?index[.]js$", 0, 0),
        ("server.*", "^(.*/)?server[.][^/]*$", 0, 0), ("!README.md", "^(.*/)?README[.]md$", 1, 0), ("build/", "^(.*/)?build$", 0, 1), ("!m1?3", "^(.*/)?m1[^/]3$", 1, 0),
        ("tests/**", "^tests/.+$", 0, 0), ("/src/services/", "^src/services$", 0, 1),
    ],
    "pattern, regex, negated, dirs",
)
STATEMENTS["nested_ignore"] = f"""with ignoring as (select repo, folder, kind, line, regex, negated, dirs from
      (select repo, case when contains(rel_path, '/') then regexp_replace(rel_path, '/[^/]*$', '') else '' end as folder, (rel_path like '%.ignore')::int as kind,
         unnest([first_line, second_line]) as pattern, unnest([0, 1]) as line from v_ignore) join ({_IGNORE_PATTERNS}) using (pattern)),
    listed_paths as (select distinct repo, rel_path as path, false as is_folder from v_files
      union select repo, array_to_string(string_split(rel_path, '/')[1:n], '/'), true from (select repo, rel_path, unnest(range(1, len(string_split(rel_path, '/')))) as n from v_files)),
    hits as (select c.repo, c.path, c.is_folder, negated, row_number() over (partition by c.repo, c.path, c.is_folder order by kind desc, length(folder) desc, line desc) as n
      from listed_paths c join ignoring r on r.repo = c.repo and (folder = '' or starts_with(c.path, folder || '/')) and (is_folder or dirs = 0)
        and regexp_matches(case when folder = '' then c.path else substr(c.path, length(folder) + 2) end, regex)),
    gone as (select repo, path, is_folder from hits where n = 1 and negated = 0)
    select f.repo, f.rel_path from v_files f where not exists (select 1 from gone g where g.repo = f.repo
      and ((g.path = f.rel_path and not g.is_folder) or (g.is_folder and starts_with(f.rel_path, g.path || '/'))))"""
STATEMENTS["skip_reason"] = "select doc_id, repo, rel_path, size_bytes, reason from labelled"
_STATS = """repo, run_id, count(*) as total_files_seen, count(*) filter (reason is null) as files_scanned,
    count(*) filter (reason is not null) as files_skipped, count(*) filter (reason = 'ignored_pathspec') as ignored_pathspec,
    count(*) filter (reason = 'binary') as "binary", count(*) filter (reason = 'too_large') as too_large,
    count(*) filter (reason = 'encoding_error') as encoding_error"""
STATEMENTS["scan_stats"] = f"select {_STATS} from labelled group by repo, run_id"
STATEMENTS["max_files_cap"] = f"""select {_STATS} from (select *, coalesce(sum((reason is null)::int) over
    (partition by repo order by rel_path, doc_id rows between unbounded preceding and 1 preceding), 0) as taken from labelled)
    where taken < 8 group by repo, run_id"""
STATEMENTS["language_map"] = f"""select doc_id, rel_path,
    {case_map("regexp_extract(lower(split_part(rel_path, '/', -1)), '^.+([.][^.]+)$', 1)", V.LANGUAGE_BY_SUFFIX)} as language from v_files"""
STATEMENTS["lockfiles"] = f"""select distinct repo, run_id, rel_path from labelled
    where reason is distinct from 'ignored_pathspec' and split_part(rel_path, '/', -1) in {in_list(V.LOCKFILE_NAMES)}"""
STATEMENTS["lockfile_resolve"] = r"""select distinct repo, rel_path from v_files
    where regexp_matches(rel_path, '(uv\.lock|go\.sum|requirements\.txt)$')"""
STATEMENTS["report_exclude"] = "select doc_id, rel_path as file from v_files where not (" + " or ".join(
    f"starts_with(rel_path, '{p}/')" for p in V.DEFAULT_REPORT_EXCLUDES
) + ")"
STATEMENTS["scan_plan"] = """with py as (select distinct run_id from run_files where reason is null and language = 'Python')
    select run_id, 'semgrep' as tool from v_requests where max_tokens % 3 <> 0
    union all select run_id, 'bandit' from v_requests where max_tokens % 4 <> 0 and run_id in (select run_id from py)
    union all select run_id, 'osv-scanner' from v_requests where max_tokens % 5 <> 0"""
STATEMENTS["repo_from_url"] = r"""select run_id, github_url, name as repo_name, name is null as rejected from
    (select *, nullif(regexp_extract(github_url, 'github\.com[:/]([^/]+)/([^/.]+)', 2), '') as name from v_requests)"""

# -------------------------------------------------------------------- profiling
STATEMENTS["languages"] = "select repo, run_id, languages_detected from profile"
STATEMENTS["entry_points"] = "select repo, run_id, path from entries"
STATEMENTS["frameworks_npm"] = "select repo, run_id, framework from npm_frameworks"
STATEMENTS["frameworks_py"] = "select repo, run_id, framework from py_frameworks"
STATEMENTS["frameworks"] = """select repo, run_id, frameworks_detected from profile p
    where exists (select 1 from manifest_files m where m.repo = p.repo and m.name <> 'pom.xml')"""
STATEMENTS["architecture_hints"] = "select repo, run_id, architecture_hints from profile"
STATEMENTS["folder_summary"] = "select repo, run_id, path, purpose_guess, round(confidence, 6) as confidence from folders"
STATEMENTS["manifest_counts"] = "select repo, run_id, path, ecosystem, direct_dependency_count, doc_id from manifests"
STATEMENTS["repo_profile"] = """select repo, run_id, languages_detected, frameworks_detected, architecture_hints, entry_points <> '' as has_entry_point,
    array_to_string(string_split(entry_points, '|')[1:3], '|') as first_entry_points,
    case when entry_points = '' then 0 else len(string_split(entry_points, '|')) end::bigint as n_entry_points,
    case when manifests = '' then 0 else len(string_split(manifests, '|')) end::bigint as n_manifests from profile"""
STATEMENTS["profile_paths"] = """select repo, run_id, 'entry_point' as kind, path from entries
    union all select distinct repo, run_id, 'manifest', path from manifest_files"""

# --------------------------------------------------------------------- evidence
for _name, _producers in {
    "evidence_heuristic": "0, 1", "evidence_semgrep": "2", "evidence_bandit": "3", "evidence_osv": "4", "evidence_index": "0, 1, 2, 3, 4",
}.items():
    STATEMENTS[_name] = f"select * from evidence_out where ord_producer in ({_producers})"
STATEMENTS["dep_findings"] = """select run_id, repo, 4::bigint as ord_producer, part::bigint as ord_part, position::bigint as ord_position, inner_path as ord_path,
    package, ecosystem, version, vulnerability_id, aliases, severity, fixed_version, source_file from dep_named"""
STATEMENTS["dep_severity"] = """select raw_severity, case trim(lower(raw_severity)) when 'low' then 'Low' when 'medium' then 'Medium'
    when 'high' then 'High' when 'critical' then 'Critical' else 'Unknown' end as severity, count(*) as n from v_dep group by 1, 2"""
STATEMENTS["fixed_version"] = "select fixed_version, count(*) as n from dep_named group by 1"
STATEMENTS["evidence_id"] = """select ord, substr(h, 1, 16) as id, h as snippet_hash from
    (select ord, sha256(file || ':' || line_start || ':' || line_end || ':' || source || ':' || signal_type || ':' || summary) as h from v_evidence)"""
STATEMENTS["tool_status"] = """select run_id, attempt::bigint as attempt, status, error, exit_code, stderr, coalesce(error, stderr) as details from statuses"""
STATEMENTS["attempt_fallback"] = "select run_id, status, error, exit_code, stderr from tool_results"
STATEMENTS["dependency_status"] = """select run_id, case when bool_or(status = 'completed') then 'completed'
    when bool_or(status = 'failed') then 'failed' else 'unavailable' end as status
    from (select run_id from v_requests) full join statuses using (run_id) group by run_id"""

# ----------------------------------------------------------------------- checks
STATEMENTS["security_evidence"] = "select ord, run_id, source, signal_type from branch_evidence where category = 'security'"
STATEMENTS["performance_evidence"] = "select ord, run_id, signal_type, summary from branch_evidence where category = 'performance'"
STATEMENTS["first_match"] = "select run_id, check_id, file, summary, round(confidence, 6) as confidence from matches"
STATEMENTS["security_findings"] = "select * exclude (file) from check_findings where category = 'security'"
STATEMENTS["performance_findings"] = "select * exclude (file) from check_findings where category = 'performance'"
STATEMENTS["osv_finding"] = "select * exclude (file) from osv_finding"
STATEMENTS["architecture_finding"] = f"""select u.run_id, u.repo, 'architecture' as category, 0::bigint as ord, 'runtime-structure' as check_id,
    substr(sha256('architecture:' || coalesce(e.file, u.repo) || ':' || coalesce(e.summary, 'unknown')), 1, 16) as id,
    case when e.ord is null then 'Medium' else 'Low' end as severity,
    case when e.ord is null then 'insufficient_evidence' else 'confirmed' end as status,
    case when e.ord is null then 0.35 else 0.75 end::double as confidence,
    case when e.ord is null then '' else concat_ws(':', e.file, e.line_start, e.line_end, e.source) end as evidence
    from runs u left join v_evidence e on e.ord = (select min(ord) from v_evidence x where x.run_id = u.run_id and x.repo = u.repo
      and x.signal_type in {in_list(V.ARCHITECTURE_SIGNALS)})"""
STATEMENTS["architecture_type"] = """select repo, architecture_hints, case when architecture_hints like '%microservice%' then 'microservices'
    when architecture_hints like '%modular%' then 'modular_monolith' when entry_points <> '' then 'monolith' else 'unknown' end as architecture_type from profile"""
_RUNTIME = """case when entry_points = '' then 'No entry point was found, so the start-up path is unknown.'
    else 'Starts from ' || array_to_string(string_split(entry_points, '|')[1:3], ', ') || ' and continues into the top-level folders.' end"""
STATEMENTS["runtime_summary"] = f"select repo, {_RUNTIME} as runtime_flow_summary from profile"
STATEMENTS["module_boundaries"] = """select repo, run_id, n as position, path as name, path as paths, purpose_guess as responsibility from
    (select *, row_number() over (partition by repo order by path) as n from folders) where n <= 3"""
_TOP_CHECKS = f"""select run_id, category, n as position, title as issue, severity, coalesce(file, 'unknown') as file from
    (select *, row_number() over (partition by run_id order by {SEVERITY}, 1 - confidence, ord) as n
     from ({{rows}}) join rule_titles using (check_id) where status in ('confirmed', 'suspected')) where n <= 5"""
STATEMENTS["top_security_risks"] = _TOP_CHECKS.format(
    rows="select * from check_findings where category = 'security' union all by name select * from osv_finding"
)
STATEMENTS["top_performance_risks"] = _TOP_CHECKS.format(rows="select * from check_findings where category = 'performance'")
STATEMENTS["failed_branch_fill"] = f"""select r.run_id, c.category, substr(sha256(c.category || ':' || r.run_id || ':failed'), 1, 16) as id,
    coalesce(case when l.state = 'failed' then f.reason end, c.category || ' branch output missing') as description,
    {case_map('c.category', FAILED_BRANCH_SEVERITY)} as severity, 'failed' as status, 0.0::double as confidence
    from log_runs r join (select unnest({[*V.CATEGORIES]}) as category) c on true
    left join latest l on l.run_id = r.run_id and l.node_id = c.category
    left join last_failures f on f.run_id = r.run_id and f.branch = c.category
    where l.state is distinct from 'completed'"""
STATEMENTS["roadmap"] = "select run_id, position, priority, task, effort, risk, justification, timeline_bucket, depends_on from roadmap"
STATEMENTS["finding_id"] = "select ord, substr(sha256(category || ':' || run_id || ':' || title), 1, 16) as finding_id from v_findings"
STATEMENTS["evidence_severity"] = """select severity, advice, count(*) as n from (select
    case when signal_type in ('secret', 'vuln') then 'High' when signal_type = 'dependency' then 'Medium' else 'Low' end as severity,
    case signal_type when 'secret' then 'rotate' when 'dependency' then 'upgrade' else 'review' end as advice from v_evidence) group by 1, 2"""
STATEMENTS["restamp"] = """select ord, 'scan-' || f.run_id as run_id, '1.' || max_tokens as schema_version
    from v_findings f join v_requests r on r.run_id = f.run_id"""
STATEMENTS["rule_catalog"] = """with words as (select 'mentions-' || lower(r_name) as check_id, unnest(string_split(lower(r_name), ' ')) as word from region),
    hits as (select source, check_id, min(doc_id) as doc_id from documents join words on contains(lower(text), word) group by all)
    select s.source as run_id, w.check_id, case when h.doc_id is null then 'insufficient_evidence' else 'confirmed' end as status,
      substr(sha256('documents:' || case when h.doc_id is null then s.source else '' end || ':' || w.check_id), 1, 16) as id,
      coalesce(length(d.text), length('Nothing in the evidence points to: mention')) as length
    from (select distinct source from documents) s join (select distinct check_id from words) w on true
    left join hits h on h.source = s.source and h.check_id = w.check_id left join documents d on d.doc_id = h.doc_id"""

# ---------------------------------------------------------------------- quality
STATEMENTS["std_severity"] = f"select ord, coalesce({case_map('lower(trim(raw_severity))', V.SEVERITY_SPELLINGS)}, raw_severity) as severity from v_findings"
STATEMENTS["std_status"] = "select id, status from clean"
STATEMENTS["std_lines_files"] = """select ord, case when ord % 5 = 0 then 'N/A' else evidence_file end as std_file,
    case when trim(raw_line) = '12' then 12 when trim(raw_line) = '7' then 7 else 1 end::bigint as std_line from v_findings"""
STATEMENTS["std_confidence"] = """select ord, case trim(raw_confidence) when '0.5' then 0.5 when '1.7' then 1 when '-1' then 0 when 'abc' then 0.5
    when '0.25' then 0.25 when '0.9' then 0.9 when '0' then 0 end::double as confidence from v_findings"""
STATEMENTS["std_findings"] = """select run_id, branch, id, category, severity, status, round(confidence::double, 6) as confidence,
    case when has_ref then file end as file, case when has_ref then line end as line_start, case when has_ref then line end as line_end from clean"""
STATEMENTS["contract_violations"] = "select id, rule from dirty_broken"
STATEMENTS["repair_or_reject"] = """with before as (select run_id, branch, part, count(*) as n from dirty_broken group by all),
    after_ as (select run_id, branch, part, count(*) as n from clean_broken group by all)
    select run_id, branch, part, coalesce(b.n, 0) as broken_before, coalesce(a.n, 0) as broken_after,
      case when coalesce(b.n, 0) = 0 then 'valid' when not is_changed then 'rejected' when coalesce(a.n, 0) = 0 then 'repaired' else 'rejected' end as outcome
    from changed left join before b using (run_id, branch, part) left join after_ a using (run_id, branch, part)"""
STATEMENTS["unknown_fields"] = """select ord, field from v_findings, (values ('ord'), ('run_id'), ('raw_severity'), ('raw_confidence'), ('raw_line'), ('evidence_file')) t(field)
    where field <> 'evidence_file' or evidence_file is not null"""
STATEMENTS["request_violations"] = """select run_id, 'source_type_unknown' as rule from v_requests where source_type = 'ftp'
    union all select run_id, 'github_url_missing' from v_requests where source_type = 'github_url' and github_url is null
    union all select run_id, 'local_path_missing' from v_requests where source_type = 'local_path' and local_path is null
    union all select run_id, 'exactly_one_source' from v_requests where (github_url is null) = (local_path is null)
    union all select run_id, 'max_tokens_above_window' from v_requests where max_tokens > context_window"""
STATEMENTS["canonical_labels"] = """select run_id, provider, c as canonical, c is not null as accepted from
    (select *, case when provider = 'openai' then 'openai' when replace(replace(lower(trim(provider)), '-', ''), '_', '') = 'lmstudio' then 'lm_studio' end as c from v_requests)"""

# ------------------------------------------------------------------- compaction
_DEDUP = """(select * from v_evidence e where not exists (select 1 from v_evidence f where f.run_id = e.run_id and f.file = e.file
    and f.line_start = e.line_start and f.source = e.source and f.summary = e.summary and f.ord < e.ord))"""
STATEMENTS["evidence_dedup"] = f"select ord, run_id, file, line_start::bigint as line_start, source, summary from {_DEDUP}"
_IDENTIFIED = f"(select *, substr(sha256(concat_ws(':', file, line_start, line_end, source, signal_type, summary)), 1, 16) as id from {_DEDUP})"
_KEY = "source, file, line_start, line_end, summary, id, ord"
_CAPPED = f"""(select *, row_number() over (partition by run_id order by {_KEY}) as place from
    (select *, row_number() over (partition by run_id, source order by {_KEY}) as nth from {_IDENTIFIED})
    where nth <= {case_map('source', EVIDENCE_PER_SOURCE, str(EVIDENCE_TOTAL))} qualify place <= {EVIDENCE_TOTAL})"""
STATEMENTS["evidence_cap"] = f"select run_id, place as position, ord, source, id from {_CAPPED}"
_DEP_RANK = case_rank("severity", V.DEPENDENCY_SEVERITIES)
_DEP_ORDER = f"{_DEP_RANK}, vulnerability_id, package, version, l_orderkey, l_linenumber"
_TOP_DEPS = f"(select *, row_number() over (partition by run_id order by {_DEP_ORDER}) as n from deps qualify n <= {{n}})"
_LEAST_DEPS = f"""(select *, row_number() over (partition by run_id order by {_DEP_RANK}, vulnerability_id, package, l_orderkey, l_linenumber) as n
    from deps qualify n <= {MINIMAL_TOP})"""
STATEMENTS["dep_top_n"] = f"select run_id, n as position, severity, vulnerability_id, package, version from {_TOP_DEPS.format(n=DEPENDENCY_TOP)}"
_COUNT_NAMES = ["total_files_seen", "files_scanned", "files_skipped"]
_CONTEXT_RUNS = f"""(select r.run_id, r.repo, coalesce(total_files_seen, 0) as total_files_seen, coalesce(files_scanned, 0) as files_scanned,
    coalesce(files_skipped, 0) as files_skipped, case when r.run_id like '%-3' then 'failed' else 'completed' end as scan
    from runs r left join (select 'repo-' || (doc_id % 100) as repo, count(*) as total_files_seen, count(*) filter (reason is null) as files_scanned,
      count(*) filter (reason is not null) as files_skipped from labelled group by 1) s on s.repo = r.repo)"""
_FOLDERS = "(select distinct run_id, split_part(file, '/', 1) || '/' || signal_type as path from v_evidence)"
_MANIFESTS = "(select distinct run_id, file as path from v_evidence where signal_type = 'dependency')"
_TOOLS = """(select run_id, source as tool, case when count(*) % 3 = 0 then 'failed' else 'completed' end as status,
    case when count(*) % 3 > 0 then 0 end as exit_code, repeat('line ' || count(*) || ' ', 100) as details from v_evidence group by run_id, source)"""
_SHORT = "case when length(details) > 500 then left(details, 497) || '...' else details end"


def _json_tokens(fields: dict[str, str]) -> str:
    """Tokens of a JSON object of these fields."""
    return _TOKENS.format(x="cast(to_json({" + ", ".join(f"'{k}': {v}" for k, v in fields.items()) + "}) as varchar)")


_TOKENS = "len(regexp_extract_all({x}, '[A-Za-z0-9_]+'))"
_HEAD_FIELDS = {"schema_version": f"'{SCHEMA_VERSION}'", "run_id": "run_id", "repo_profile": "{'repo_name': repo}", "scan_stats": "{" + ", ".join(f"'{c}': {c}" for c in _COUNT_NAMES) + "}"}
_DIGEST = "sha256(concat_ws(':', file, line_start, line_end, source, signal_type, summary))"
_ITEM_FIELDS = {"id": f"substr({_DIGEST}, 1, 16)", "file": "file", "line_start": "line_start", "line_end": "line_end", "snippet_hash": _DIGEST, "source": "source", "signal_type": "signal_type", "summary": "summary", "confidence": "confidence"}
_DEP_FIELDS = {"package": "package", "ecosystem": "ecosystem", "version": "version", "vulnerability_id": "vulnerability_id", "aliases": "[]", "severity": "severity", "fixed_version": "fixed_version", "source_file": "source_file"}
_FOLDER_FIELDS = {"path": "path", "purpose_guess": "'Source folder'", "confidence": "0.5::double"}
_MANIFEST_FIELDS = {"path": "path", "ecosystem": "'npm'", "direct_dependency_count": "length(path)"}
_TOOL_FIELDS = {"tool": "tool", "status": "status", "exit_code": "exit_code", "details": "details"}


def _tier_tokens(tier: str) -> str:
    """(run_id, tier, tokens): a row for every item of the payloads of a tier, and one for the rest."""
    minimal = tier == "minimal"
    block = {
        "full": {},
        "compact": {"context_compaction": "{'enabled': true, 'original_evidence_count': 0, 'compacted_evidence_count': 0, 'original_dependency_findings': 0, 'compacted_dependency_findings': 0}"},
        "minimal": {"context_compaction": f"{{'enabled': true, 'mode': 'minimal', 'note': {text(V.MINIMAL_NOTE)}}}"},
    }[tier]
    summary = "{'vulnerability_scan_status': scan, 'vulnerability_findings': [], " + ("'manifest_count': 0}" if minimal else "'manifests': []}")
    lists = {"dependency_summary": summary, "evidence_index": "[]", "scanner_tool_runs": "[]"} | ({} if minimal else {"folders": "[]"})
    tools = _TOOL_FIELDS if tier == "full" else _TOOL_FIELDS | {"details": _SHORT}
    rows = [
        (_CONTEXT_RUNS, _HEAD_FIELDS | lists | block),
        (_TOOLS, tools),
        ({"full": "deps", "compact": _TOP_DEPS.format(n=DEPENDENCY_TOP), "minimal": _LEAST_DEPS}[tier], _DEP_FIELDS),
    ]
    if not minimal:
        rows += [(_FOLDERS, _FOLDER_FIELDS), (_MANIFESTS, _MANIFEST_FIELDS), ("v_evidence" if tier == "full" else _CAPPED, _ITEM_FIELDS)]
    return " union all ".join(f"select run_id, '{tier}' as tier, {_json_tokens(fields)} as tokens from {source} x" for source, fields in rows)


STATEMENTS["minimal_context"] = f"""with sizes as (select run_id, sum(tokens)::bigint as payload_tokens from ({_tier_tokens('minimal')}) group by run_id)
    select r.run_id, repo, 'minimal' as mode, (select count(*) from deps d where d.run_id = r.run_id) as dependency_findings,
    (select count(*) from {_MANIFESTS} m where m.run_id = r.run_id) as manifest_count,
    coalesce((select string_agg(vulnerability_id, '|' order by n) from {_LEAST_DEPS} d where d.run_id = r.run_id), '') as top,
    (select string_agg(concat_ws(':', tool, status, length({_SHORT})), '|' order by tool) from {_TOOLS} t where t.run_id = r.run_id) as tools,
    files_scanned, payload_tokens from {_CONTEXT_RUNS} r join sizes on sizes.run_id = r.run_id"""
STATEMENTS["truncate_details"] = """select conv_id, turn, case when length(text) > 500 then left(text, 497) || '...' else text end as details from conversations"""
STATEMENTS["compacted_context"] = f"""with kept as (select run_id, string_agg(id, '|' order by place) as ids, count(*) as n from {_CAPPED} group by run_id),
    top as (select run_id, string_agg(vulnerability_id, '|' order by n) as ids, count(*) as m from {_TOP_DEPS.format(n=DEPENDENCY_TOP)} group by run_id),
    sizes as (select run_id, sum(tokens)::bigint as payload_tokens from ({_tier_tokens('compact')}) group by run_id)
    select r.run_id, r.repo, coalesce(k.ids, '') as evidence_ids, coalesce(t.ids, '') as vulnerability_ids, payload_tokens,
      coalesce((select string_agg(path, '|' order by path) from {_FOLDERS} f where f.run_id = r.run_id), '') as folders,
      coalesce((select string_agg(path, '|' order by path) from {_MANIFESTS} m where m.run_id = r.run_id), '') as manifests,
      (select count(*) from v_evidence e where e.run_id = r.run_id) as original_evidence_count, coalesce(k.n, 0) as compacted_evidence_count,
      (select count(*) from deps d where d.run_id = r.run_id) as original_dependency_findings, coalesce(t.m, 0) as compacted_dependency_findings
    from runs r left join kept k on k.run_id = r.run_id left join top t on t.run_id = r.run_id join sizes s on s.run_id = r.run_id"""
STATEMENTS["token_counts"] = f"select source, lang, sum({_TOKENS.format(x='text')})::bigint as tokens, count(*) as documents from documents group by 1, 2"
STATEMENTS["token_udf"] = STATEMENTS["token_counts"]
STATEMENTS["context_tier"] = f"""with pieces as ({' union all '.join(_tier_tokens(t) for t in ('full', 'compact', 'minimal'))}),
    sizes as (select p.run_id, {', '.join(f"coalesce(sum(tokens) filter (tier = '{t}'), 0)::bigint as {t}_tokens" for t in ('full', 'compact', 'minimal'))}
      from pieces p join runs r on r.run_id = p.run_id group by p.run_id),
    budgets as ({values_table(list(TIER_BUDGETS.items()), 'stage, budget')})
    select run_id, full_tokens, compact_tokens, minimal_tokens, stage, budget::bigint as budget,
      case when full_tokens <= budget then 'full' when compact_tokens <= budget then 'compact' when minimal_tokens <= budget then 'minimal' else 'over_budget' end as tier
    from sizes join budgets on true"""

# -------------------------------------------------------------------- redaction


def _redacted(expr: str) -> str:
    for _n, pattern, keeps in V.REDACTION_PATTERNS:
        expr = f"regexp_replace({expr}, {text(pattern)}, {text(chr(92) + '1' + V.REDACTED if keeps else V.REDACTED)}, 'g')"
    return expr


STATEMENTS["redact_text"] = f"select doc_id, {_redacted('text')} as text from documents"
STATEMENTS["redact_nested"] = f"""select conv_id, turn, role, {_redacted('text')} as text, 'api_key=[REDACTED]' as secret, 'token=abcdefghij' as keys,
    'api_key=[REDACTED]' as named from conversations"""


def _hits(source: str, table: str, column: str) -> str:
    out, expr = [], column
    for name, pattern, keeps in V.REDACTION_PATTERNS:
        out.append(
            f"select '{source}' as source_table, '{name}' as pattern, coalesce(sum(len(regexp_extract_all({expr}, {text(pattern)}))), 0)::bigint as hits from {table}"
        )
        expr = f"regexp_replace({expr}, {text(pattern)}, {text(chr(92) + '1' + V.REDACTED if keeps else V.REDACTED)}, 'g')"
    return " union all ".join(out)


STATEMENTS["redaction_report"] = " union all ".join(
    [_hits("documents", "documents", "text"), _hits("conversations", "conversations", "text"), _hits("failures", "failure_texts", "reason")]
)

# -------------------------------------------------------------------- reporting
STATEMENTS["summary_risks"] = "select run_id, category, place as position, issue, severity, file from sorted_risks"
STATEMENTS["summary_roadmap"] = "select run_id, place as position, priority, task, effort, impact, risk, justification from sorted_roadmap"
_TOOL_STATUS = "case status when 'completed' then 'completed' when 'unavailable' then 'tooling_unavailable' else 'tool_execution_failed' end"
STATEMENTS["tooling_status"] = f"select run_id, tool, {_TOOL_STATUS} as status, exit_code, details from tool_runs"
STATEMENTS["stage_status"] = "select * from stage_rows"
STATEMENTS["hard_failures"] = "select run_id, scanner, roadmap from stage_rows where 'failed' in (scanner, roadmap)"
_BY_RUN = """p as (select run_id, repo,
      list_sort(list(distinct language) filter (language is not null)) as langs, list_sort(list(distinct rel_path) filter (name in {entries})) as entry_points,
      list_sort(list(distinct rel_path) filter (name in {manifests})) as manifests
      from run_files where reason is null group by 1, 2),
    deps_named as (select run_id, name, lower(unnest(json_keys(content, '$.dependencies') || json_keys(content, '$.devDependencies'))) as dep, null as body
      from run_files where reason is null and name = 'package.json' and json_valid(content)),
    fw as (select distinct run_id, framework from deps_named join framework_names on dep = dep_name
      union select distinct run_id, framework from run_files join framework_names on regexp_matches(lower(content), '\\b' || dep_name || '\\b')
      where reason is null and name in ('requirements.txt', 'pyproject.toml') and dep_name in {words}),
    f as (select run_id, list_sort(list(framework)) as frameworks from fw group by run_id)""".format(
    entries=in_list(V.ENTRY_POINT_NAMES), manifests=in_list(V.ECOSYSTEM_BY_MANIFEST), words=in_list(V.PYTHON_FRAMEWORK_WORDS)
)


def _risk_list(category: str) -> str:
    return f"""coalesce((select list(struct_pack(issue := issue, severity := severity, file := file) order by place) from sorted_risks x
      where x.run_id = p.run_id and x.category = '{category}'), [])"""


_DOCUMENT = f"""to_json(struct_pack(schema_version := '{SCHEMA_VERSION}', run_id := p.run_id, repo_name := p.repo, language_detected := coalesce(langs, []),
    frameworks := coalesce(frameworks, []), architecture_type := case when entry_points is null then 'unknown' else 'monolith' end,
    top_security_risks := {_risk_list('security')}, top_performance_risks := {_risk_list('performance')},
    roadmap := coalesce((select list(struct_pack(priority := priority, task := task, effort := effort, impact := impact, risk := risk, justification := justification) order by place)
      from sorted_roadmap x where x.run_id = p.run_id), []),
    scanner_tooling := coalesce((select list(struct_pack(tool := tool, status := {_TOOL_STATUS}, exit_code := exit_code, details := details)) from tool_runs x where x.run_id = p.run_id), []),
    analysis_status := struct_pack({', '.join(f"{s} := coalesce(s.{s}, 'failed')" for s in V.STAGES)})))::varchar"""
STATEMENTS["summary_json"] = f"with {_BY_RUN} select p.run_id, {_DOCUMENT} as document from p left join f on f.run_id = p.run_id left join stage_rows s on s.run_id = p.run_id"
STATEMENTS["write_summary"] = STATEMENTS["summary_json"]
_SHOWN = "case status when 'failed' then 'analysis_finding_failed' else status end"
_VISIBLE = "status not in ('not_applicable', 'insufficient_evidence')"
_TOP10 = f"""(select run_id, n as position, category, severity, title, {_SHOWN} as status from
    (select *, row_number() over (partition by run_id order by srank, doubt, title, brank, ord) as n from findings where {_VISIBLE}) where n <= 10)"""


def _top10(runs: str) -> str:
    return f"""select * from {_TOP10} t union all select run_id, 1, 'architecture', 'Low', 'No actionable findings', 'insufficient_evidence' from {runs}
      where run_id not in (select run_id from findings where {_VISIBLE})"""


STATEMENTS["top_findings"] = _top10("log_runs")
_LINE = f"'- **' || severity || '** `' || {_SHOWN} || '` - ' || title || ': ' || recommendation"


def _finding_lines(runs: str, categories: list[str]) -> str:
    return f"""select run_id, category, srank::bigint as k1, round(doubt, 6) as k2, title as k3, ord as k4, {_LINE} as line from findings where {_VISIBLE} and category in {in_list(categories)}
      union all select r.run_id, c, 0, 0.0, '', 0, '- No findings.' from (select run_id from {runs} union select run_id from findings) r, (select unnest({categories}) as c)
      where not exists (select 1 from findings f where f.run_id = r.run_id and f.category = c)"""


STATEMENTS["finding_lines"] = _finding_lines("log_runs", V.CATEGORIES)
_ROADMAP_LINE = """'- **' || priority || '** (' || timeline_bucket || ') - ' || task || ' [impact: ' || impact || '; effort: ' || effort || '; risk: ' || risk || '; justification: ' || justification || ']'"""


def _roadmap_lines(runs: str) -> str:
    return f"""select run_id, place as position, {_ROADMAP_LINE} as line from sorted_roadmap
      union all select run_id, 1, '- No roadmap items generated.' from {runs} where run_id not in (select run_id from roadmap)"""


STATEMENTS["roadmap_lines"] = _roadmap_lines("log_runs")
_DETAIL = r"trim(regexp_replace(details, '\s+', ' ', 'g'))"
_TOOL_LINE = f"""'- `' || tool || '`: `' || {_TOOL_STATUS} || '`' || case when exit_code is null and coalesce(details, '') = '' then ''
    else ' (' || concat_ws('; ', 'exit_code=' || exit_code, 'details=' || case when length({_DETAIL}) > 140 then left({_DETAIL}, 137) || '...' else {_DETAIL} end) || ')' end"""


def _tooling_lines(runs: str, only: str = "") -> str:
    return f"""select run_id, 1::bigint as position, {_TOOL_LINE} as line from tool_runs {only}
      union all select run_id, 1, '- No scanner tool executions recorded.' from {runs} where run_id not in (select run_id from tool_runs)"""


STATEMENTS["tooling_lines"] = _tooling_lines("(select distinct run_id from findings)")


def _report() -> str:
    fixed = []
    for s, heading in enumerate(V.REPORT_HEADINGS):
        if s > 1:
            fixed.append((s, -2, ""))
        fixed.append((s, -1, heading))
    fixed += [(0, 99, ""), (9, 0, V.SUMMARY_TABLE_HEADER), (9, 1, V.SUMMARY_TABLE_RULE), (9, 99, "")]

    def joined(names: str, otherwise: str) -> str:
        return f"coalesce(array_to_string({names}, ', '), '{otherwise}')"

    overview = [
        (3, 1, "'- Repository: `' || p.repo || '`'"),
        (3, 2, f"'- Languages detected: ' || {joined('langs', 'Unknown')}"),
        (3, 3, f"'- Frameworks detected: ' || {joined('frameworks', 'Unknown')}"),
        (3, 4, f"'- Entry points: ' || {joined('entry_points', 'Not detected')}"),
        (3, 5, f"'- Dependency manifests: ' || {joined('manifests', 'Not detected')}"),
        (3, 6, "'- Files scanned: ' || scanned_n"),
        (3, 7, "'- Files skipped: ' || skipped_n"),
        (4, 1, "'- Architecture type: `' || case when entry_points is null then 'unknown' else 'monolith' end || '`'"),
        (4, 2, "'- Runtime flow: ' || case when entry_points is null then 'No entry point was found, so the start-up path is unknown.' else 'Starts from ' || array_to_string(entry_points[1:3], ', ') || ' and continues into the top-level folders.' end"),
    ]
    info = "p left join f on f.run_id = p.run_id join seen on seen.run_id = p.run_id"
    zeros = "0::bigint as k1, 0.0::double as k2, '' as k3, 0::bigint as k4"
    parts = [f"select run_id, section::bigint as section, part::bigint as part, {zeros}, line from p, ({values_table(fixed, 'section, part, line')})"]
    parts += [
        f"select p.run_id, 1, 2, {i}, 0.0, '', 0, '- `{s}`: `' || coalesce(s.{s}, 'failed') || '`' from p left join stage_rows s on s.run_id = p.run_id"
        for i, s in enumerate(V.STAGES)
    ]
    only = "where run_id in (select run_id from p)"
    placed = "select run_id, {section}, 2, position, 0.0, '', 0, line from ({rows}) {only}"
    parts.append(placed.format(section=2, rows=_tooling_lines("p"), only=only))
    parts += [f"select p.run_id, {s}, 2, {n}, 0.0, '', 0, {line} from {info}" for s, n, line in overview]
    modules = """select run_id, row_number() over (partition by run_id order by path) as position,
        '- **' || path || '**: ' || purpose || ' (`' || path || '`)' as line from
        (select distinct run_id, path, coalesce(purpose, 'General project assets') as purpose from
          (select run_id, case when contains(rel_path, '/') then split_part(rel_path, '/', 1) else '.' end as path from run_files where reason is null)
          left join folder_names on folder = path) qualify position <= 10"""
    parts.append(placed.format(section=5, rows=modules, only=only))
    lines = _finding_lines("p", ["security", "performance"])
    parts.append(f"select run_id, case category when 'security' then 6 else 7 end, 2, k1, k2, k3, k4, line from ({lines}) {only}")
    parts.append(placed.format(section=8, rows=_roadmap_lines("p"), only=only))
    table = f"select run_id, position, '| ' || concat_ws(' | ', position, category, severity, title, status) || ' |' as line from ({_top10('p')})"
    parts.append(placed.format(section=9, rows=table, only=only))
    seen = "seen as (select run_id, count(*) filter (reason is null) as scanned_n, count(*) filter (reason is not null) as skipped_n from run_files group by run_id)"
    return f"with {_BY_RUN}, {seen} " + " union all ".join(parts)


STATEMENTS["report_markdown"] = _report()
STATEMENTS["write_report"] = f"select run_id, line from ({_report()})"

# ---------------------------------------------------------------------- run log
STATEMENTS["latest_state"] = "select run_id, node_id, state, seq from latest"
STATEMENTS["latest_run_state"] = """select run_id, node_id, to_state as state, seq from v_transitions t
    where seq = (select max(seq) from v_transitions u where u.run_id = t.run_id)"""
STATEMENTS["completed_nodes"] = """select run_id, string_agg(node_id, '|' order by first_seq) as nodes from
    (select run_id, node_id, min(seq) as first_seq from v_transitions where to_state = 'completed' group by 1, 2) group by run_id"""
STATEMENTS["resume_plan"] = f"""select run_id, node_id from log_runs, (select unnest({V.FLOW_NODES}) as node_id) n
    where not exists (select 1 from v_transitions t where t.run_id = log_runs.run_id and t.node_id = n.node_id and to_state = 'completed')"""
STATEMENTS["roadmap_state"] = """select run_id, case when state = 'failed' then 'failed'
      when exists (select 1 from latest b where b.run_id = l.run_id and b.state = 'failed' and b.node_id in ('architecture', 'security', 'performance')) then 'degraded'
      when exists (select 1 from v_transitions p where p.run_id = l.run_id and p.node_id = 'roadmap' and p.to_state = 'pending') then 'degraded'
      else 'completed' end as roadmap_status
    from latest l where node_id = 'roadmap' and state in ('completed', 'failed')"""
STATEMENTS["fan_in_ready"] = """select a.run_id, a.state as architecture, s.state as security, p.state as performance from latest a
    join latest s on s.run_id = a.run_id and s.node_id = 'security' join latest p on p.run_id = a.run_id and p.node_id = 'performance'
    where a.node_id = 'architecture' and a.state in ('completed', 'failed') and s.state in ('completed', 'failed') and p.state in ('completed', 'failed')"""
STATEMENTS["transition_chain"] = "select run_id, seq, from_state, to_state from chain"
STATEMENTS["chain_breaks"] = "select run_id, seq, 'pending' as recorded, from_state from chain where from_state <> 'pending'"
STATEMENTS["stage_spans"] = f"""with e as (select *, lag(to_state) over w as prev, lead(to_state) over w as next, lead(ts) over w as next_ts
      from v_transitions where to_state <> 'pending' window w as (partition by run_id, node_id order by seq)),
    ends as (select run_id, max(ts) as run_end from v_transitions group by run_id)
    select run_id, node_id, seq, strftime(ts, {TS}) as started_at,
      strftime(case when to_state <> 'running' then ts when next is null then run_end when next = 'running' then null else next_ts end, {TS}) as ended_at,
      case when to_state <> 'running' then 'instant' when next is null then 'run_end' when next = 'running' then 'replaced' else next end as closed_by
    from e join ends using (run_id) where to_state = 'running' or prev is distinct from 'running'"""
STATEMENTS["trace_ids"] = """select distinct run_id, node_id, substr(sha256(run_id), 1, 32) as trace_id, run_id || ':' || node_id as checkpoint_key from v_transitions"""
STATEMENTS["branch_failures"] = """select run_id, string_agg(branch || '=' || branch || ' stopped, token=[REDACTED]', '|' order by branch) as branch_failures
    from last_failures group by run_id"""

# -------------------------------------------------------------------- streaming
STATEMENTS["stream_state"] = f"""select strftime(date_trunc('day', ts), {TS}) as window_start, strftime(date_trunc('day', ts) + interval 1 day, {TS}) as window_end,
    node_id, to_state, count(*) as n from v_transitions group by all"""
STATEMENTS["stream_dedup"] = """select distinct run_id, node_id || '/' || strftime(ts, '%Y-%m-%d') as file, 1::bigint as line_start, to_state as source, 'seen' as summary from v_transitions"""
STATEMENTS["incremental_scan"] = _MERGED.format(rows="event_runs")

ORACLES = {name: compose(statement) for name, statement in STATEMENTS.items()}
