"""Shared sub-queries of the SQL oracle, written relationally for DuckDB.

``compose`` puts the sub-queries a statement names in front of it.
"""

from __future__ import annotations

import re

from auditweave import fixed_values as V
from auditweave.fixtures import VIEWS, oracle_text
from auditweave.operators.checks import PERFORMANCE_RULES, SECURITY_RULES


def text(value: str | None) -> str:
    return "null" if value is None else "'" + value.replace("'", "''") + "'"


def in_list(values) -> str:
    return "(" + ",".join(text(v) for v in values) + ")"


def case_map(expr: str, entries: dict, otherwise: str = "null") -> str:
    whens = " ".join(f"when {text(k)} then {text(v) if isinstance(v, str) else v}" for k, v in entries.items())
    return f"case {expr} {whens} else {otherwise} end"


def case_rank(expr: str, ordered: list[str]) -> str:
    return case_map(expr, {name: i for i, name in enumerate(ordered)}, str(len(ordered)))


def values_table(rows: list[tuple], columns: str) -> str:
    body = ",".join("(" + ",".join(str(v) if isinstance(v, int | float) else text(v) for v in row) + ")" for row in rows)
    return f"select * from (values {body}) t({columns})"


SEVERITY = case_rank("severity", V.SEVERITIES)
DEP_SEVERITY_LABEL = case_map("lower(trim(raw_severity))", V.DEPENDENCY_SEVERITY_SPELLINGS, "'Unknown'")
NAME = "regexp_extract(rel_path, '[^/]*$')"
IGNORED = (
    "(regexp_matches(rel_path, '(^|/)(\\.git|node_modules|dist|build|vendor|\\.venv|__pycache__)(/|$)')"
    " or regexp_matches(rel_path, '^(\\.git|node_modules|dist|build|\\.venv|__pycache__|vendor|tests/fixtures)/'))"
)
LANGUAGE = case_map(f"regexp_extract(lower({NAME}), '^.+(\\.[^.]+)$', 1)", V.LANGUAGE_BY_SUFFIX)
JSON_OK = "json_valid(content)"


def skip_case(limit: int) -> str:
    return f"case when {IGNORED} then 'ignored_pathspec' when size_bytes > {limit} then 'too_large' end"


RULES = [
    (r.category, n, r.check_id, r.severity, k)
    for rules in (SECURITY_RULES, PERFORMANCE_RULES)
    for n, r in enumerate(rules)
    for k in r.keywords
]

CTES: dict[str, str] = {name: oracle_text(name) for name in VIEWS}
CTES |= {
    "labelled": f"select *, {skip_case(300)} as reason from v_files",
    "scanned": f"select *, {LANGUAGE} as language, {NAME} as name from v_files where {skip_case(V.DEFAULT_MAX_FILE_BYTES)} is null",
    "repos": "select distinct repo, run_id from scanned",
    "entries": f"select distinct repo, run_id, rel_path as path from scanned where name in {in_list(V.ENTRY_POINT_NAMES)}",
    "manifest_files": f"select repo, run_id, doc_id, rel_path as path, name, content from scanned where name in {in_list(V.ECOSYSTEM_BY_MANIFEST)}",
    "npm": f"""select repo, run_id, d.k as dep from manifest_files,
        lateral (select unnest(json_keys(content, '$.dependencies') || json_keys(content, '$.devDependencies')) as k) d
        where name = 'package.json' and {JSON_OK}""",
    "framework_names": values_table(list(V.FRAMEWORK_BY_DEPENDENCY.items()), "dep_name, framework"),
    "npm_frameworks": "select distinct repo, run_id, framework from npm join framework_names on lower(dep) = dep_name",
    "py_frameworks": f"""select distinct repo, run_id, framework from manifest_files join framework_names
        on regexp_matches(lower(content), '\\b' || dep_name || '\\b')
        where name in ('requirements.txt', 'pyproject.toml') and dep_name in {in_list(V.PYTHON_FRAMEWORK_WORDS)}""",
    "hint_rows": f"""select repo, run_id, '{V.HINT_CONTAINER}' as hint from scanned where lower(rel_path) like '%dockerfile'
        union select repo, run_id, '{V.HINT_LAYERED}' from scanned where '/' || lower(rel_path) like '%/services/%'
        union select repo, run_id, '{V.HINT_ROUTES}' from scanned where '/' || lower(rel_path) like '%/routes/%'""",
    "folder_names": values_table([(k, *v) for k, v in V.FOLDER_PURPOSES.items()], "folder, purpose, conf"),
    "folders": f"""select distinct repo, run_id, path, coalesce(purpose, '{V.DEFAULT_FOLDER_PURPOSE[0]}') as purpose_guess,
        coalesce(conf, {V.DEFAULT_FOLDER_PURPOSE[1]})::double as confidence
        from (select repo, run_id, case when position('/' in rel_path) > 0 then split_part(rel_path, '/', 1) else '.' end as path from scanned)
        left join folder_names on folder = path""",
    "manifests": """select repo, run_id, doc_id, path,
        case name when 'package.json' then 'npm' when 'requirements.txt' then 'pip' when 'pyproject.toml' then 'python' else 'maven' end as ecosystem,
        case name when 'package.json' then case when json_valid(content) then
              coalesce(len(json_keys(content, '$.dependencies')), 0) + coalesce(len(json_keys(content, '$.devDependencies')), 0) else 0 end
          when 'requirements.txt' then len([x for x in string_split(content, chr(10)) if x <> '' and x[1] <> '#'])
          when 'pyproject.toml' then len(regexp_extract_all(content, '(?m)^\\s*"[A-Za-z0-9_.\\-]+'))
          else len(string_split(content, '<dependency>')) - 1 end::bigint as direct_dependency_count
        from manifest_files""",
    "profile": """select r.repo, r.run_id,
        coalesce((select string_agg(distinct language, '|' order by language) from scanned s where s.repo = r.repo and language is not null), '') as languages_detected,
        coalesce((select string_agg(framework, '|' order by framework) from (select * from npm_frameworks union select * from py_frameworks) f where f.repo = r.repo), '') as frameworks_detected,
        coalesce((select string_agg(hint, '|' order by hint) from hint_rows h where h.repo = r.repo), '') as architecture_hints,
        coalesce((select string_agg(path, '|' order by path) from entries e where e.repo = r.repo), '') as entry_points,
        coalesce((select string_agg(path, '|' order by path) from (select distinct repo, path from manifest_files) m where m.repo = r.repo), '') as manifests
        from repos r""",
    # evidence -----------------------------------------------------------
    "semgrep_flat": """select run_id, repo, ord // 64 as part, row_number() over (partition by run_id, ord // 64 order by ord) - 1 as position,
        case when ord % 17 <> 0 then file end as path, case when ord % 7 <> 0 then 'rule.' || signal_type end as check_id,
        case when ord % 9 <> 0 then line_start end as start_line, case when ord % 4 <> 0 then line_end end as end_line,
        case when ord % 5 = 0 then '' else summary end as message from v_evidence where source = 'semgrep'""",
    "bandit_flat": """select run_id, repo, ord // 64 as part, row_number() over (partition by run_id, ord // 64 order by ord) - 1 as position,
        case when ord % 13 <> 0 then file end as path, case when ord % 6 <> 0 then line_start else 1 end as line,
        coalesce(case when ord % 5 <> 0 then summary end, case when ord % 10 <> 0 then signal_type end, 'Bandit finding') as message
        from v_evidence where source = 'bandit'""",
    "dep_flat": f"""select run_id, 'repo-' || split_part(run_id, '-', 2) as repo, l_orderkey * 8 + l_linenumber as part,
        1 as position, '0000000001.000000000' || v as inner_path, package, ecosystem, version, case v when 0 then vulnerability_id else 'unknown' end as vulnerability_id,
        'CVE-' || l_linenumber as aliases, {DEP_SEVERITY_LABEL} as severity, fixed_version, source_file from v_dep, (values (0), (1)) t(v)""",
    "deps": f"select *, {DEP_SEVERITY_LABEL} as severity from v_dep where package is not null",
    "dep_named": "select * from dep_flat where package is not null",
    "all_evidence": """
        select run_id, repo, 0 as ord_producer, 0 as ord_part, 0 as ord_position, path as ord_path, path as file, 1 as line_start, 1 as line_end,
          'scanner_heuristic' as source, 'entrypoint' as signal_type, 'Entrypoint candidate: ' || path as summary, 0.75 as confidence from entries
        union all select run_id, repo, 1, 0, 0, path, path, 1, 1, 'scanner_heuristic', 'dependency', 'Dependency manifest detected: ' || path, 0.7
          from (select distinct run_id, repo, path from manifest_files)
        union all select run_id, repo, 2, part, position, '', path, coalesce(start_line, 1), coalesce(end_line, start_line, 1), 'semgrep', 'vuln',
          coalesce(nullif(message, ''), check_id, 'Semgrep finding'), 0.9 from semgrep_flat where path is not null
        union all select run_id, repo, 3, part, position, '', path, line, line, 'bandit', 'vuln', message, 0.85 from bandit_flat where path is not null
        union all select run_id, repo, 4, part, position, inner_path, source_file, 1, 1, 'osv', 'dependency', package || ' vulnerable to ' || vulnerability_id, 0.9 from dep_named""",
    "evidence_out": """select run_id, repo, ord_producer::bigint ord_producer, ord_part::bigint ord_part, ord_position::bigint ord_position, ord_path,
        substr(digest, 1, 16) as id, file, line_start::bigint line_start, line_end::bigint line_end, digest as snippet_hash, source, signal_type, summary,
        round(confidence::double, 6) as confidence
        from (select *, sha256(concat_ws(':', file, line_start, line_end, source, signal_type, summary)) as digest from all_evidence)""",
    "statuses": """select run_id, attempt, stdout, case kind when 'fine' then 'completed' when 'missing' then 'unavailable' when 'no_context' then 'unavailable' else 'failed' end as status,
        case kind when 'missing' then 'osv-scanner not found' when 'timeout' then 'osv-scanner timed out'
          when 'no_context' then coalesce(nullif(stderr, ''), nullif(stdout, ''), 'osv-scanner reported unavailable scan context')
          when 'bad_exit' then coalesce(nullif(stderr, ''), 'osv-scanner failed') when 'not_json' then 'osv-scanner produced non-JSON output' end as error,
        case when kind not in ('missing', 'timeout') then exit_code end::bigint as exit_code,
        case when kind not in ('missing', 'timeout') then nullif(stderr, '') end as stderr
        from (select *, case when not tool_found then 'missing' when timed_out then 'timeout' when exit_code = 128 then 'no_context'
          when exit_code not in (0, 1) then 'bad_exit' when stdout = 'plain text' then 'not_json' else 'fine' end as kind from v_attempts)""",
    "tool_results": """select coalesce(a.run_id, b.run_id) as run_id,
        case when a.run_id is not null and (a.status = 'completed' or b.run_id is null) then a.status
             when a.run_id is null or b.status = 'completed' then b.status
             when 'failed' in (a.status, b.status) then 'failed' else 'unavailable' end as status,
        case when a.run_id is not null and (a.status = 'completed' or b.run_id is null) then a.error
             when a.run_id is null or b.status = 'completed' then b.error
             else a.error || '; fallback: ' || b.error end as error,
        case when a.run_id is not null and (a.status = 'completed' or b.run_id is null) then a.exit_code
             when a.run_id is null or b.status = 'completed' then b.exit_code
             else case when b.exit_code <> 0 then b.exit_code else a.exit_code end end as exit_code,
        case when a.run_id is not null and (a.status = 'completed' or b.run_id is null) then a.stderr
             when a.run_id is null or b.status = 'completed' then b.stderr
             else coalesce(b.stderr, a.stderr) end as stderr
        from (select * from statuses where attempt = 1) a full join (select * from statuses where attempt = 2) b on a.run_id = b.run_id""",
    "tool_runs": "select run_id, 'osv-scanner' as tool, status, exit_code, coalesce(error, stderr) as details from tool_results",
    # checks -------------------------------------------------------------
    "rules": values_table(RULES, "category, rule, check_id, severity, keyword"),
    "rule_heads": "select distinct category, rule, check_id, severity from rules",
    "branch_evidence": f"""select 'security' as category, * from v_evidence where source in {in_list(V.SECURITY_SOURCES)} or signal_type in {in_list(V.SECURITY_SIGNALS)}
        union all select 'performance', * from v_evidence where signal_type = 'perf_hotspot'
          or {' or '.join(f"contains(lower(summary), {text(w)})" for w in V.PERFORMANCE_WORDS)}""",
    "first_ord": """select e.run_id, e.repo, r.category, r.check_id, min(e.ord) as ord from branch_evidence e join rules r
        on e.category = r.category and contains(lower(e.summary || ' ' || e.file), r.keyword) group by all""",
    "runs": "select distinct run_id, repo from v_evidence",
    "matches": """select u.run_id, u.repo, h.category, h.rule, h.check_id, h.severity, e.file, e.line_start, e.line_end, e.source, e.summary, e.confidence
        from runs u join rule_heads h on true left join first_ord f on f.run_id = u.run_id and f.repo = u.repo and f.check_id = h.check_id
        left join v_evidence e on e.ord = f.ord""",
    "check_rows": """select run_id, repo, category, rule::bigint as ord, check_id,
        substr(sha256(concat_ws(':', category, coalesce(file, repo), check_id)), 1, 16) as id, severity,
        case when file is null then 'insufficient_evidence' when confidence >= 0.7 then 'confirmed' else 'suspected' end as status,
        round(case when file is null then 0.35 else least(0.95, greatest(0.45, confidence)) end::double, 6) as confidence,
        coalesce(concat_ws(':', file, line_start, line_end, source), '') as evidence, file from matches""",
    "check_findings": "select * replace (case when file is null then '' else evidence end as evidence) from check_rows",
    "osv_first": """select run_id, string_agg(concat_ws(':', file, line_start, line_end, source), '|' order by ord) as evidence, arg_min(file, ord) as file
        from (select *, row_number() over (partition by run_id order by ord) as n from v_evidence where source = 'osv') where n <= 3 group by run_id""",
    "osv_finding": """select u.run_id, u.repo, 'security' as category, 8::bigint as ord, 'dependency-findings-present' as check_id,
        substr(sha256('security:' || u.repo || ':dependency-findings-present'), 1, 16) as id, 'High' as severity,
        case when o.evidence is null then 'suspected' else 'confirmed' end as status, 0.9::double as confidence, coalesce(o.evidence, '') as evidence, o.file
        from runs u left join osv_first o on o.run_id = u.run_id
        where not u.run_id like '%-3' and exists (select 1 from deps d where d.run_id = u.run_id)""",
    "rule_titles": values_table(
        [(r.check_id, r.title) for r in SECURITY_RULES + PERFORMANCE_RULES]
        + [("dependency-findings-present", "Dependency scan found vulnerable packages")],
        "check_id, title",
    ),
    "findings": f"select *, 'about ' || title as description, {SEVERITY} as srank, 1 - confidence as doubt, {case_rank('category', V.CATEGORIES)} as brank from v_findings",
    "top5": """select run_id, category, n as position, title as issue, severity, coalesce(evidence_file, 'unknown') as file from
        (select *, row_number() over (partition by run_id, category order by srank, doubt, ord) as n from findings
         where status in ('confirmed', 'suspected') and category <> 'architecture') where n <= 5""",
    "roadmap": f"""select run_id, n as position, priority, recommendation as task, 'Lowers the ' || category || ' risk: ' || title as impact, 'Medium' as effort,
        severity as risk, description as justification, {case_map('priority', V.TIMELINE_BY_PRIORITY)} as timeline_bucket, id as depends_on from
        (select *, row_number() over (partition by run_id order by srank, doubt, brank, ord) as n,
           case when severity in ('Critical', 'High') then 'P0' when severity = 'Medium' then 'P1' else 'P2' end as priority
         from findings where status in ('confirmed', 'suspected')) where n <= 10""",
    "sorted_roadmap": "select *, row_number() over (partition by run_id order by priority, task, position) as place from roadmap",
    "sorted_risks": f"select *, row_number() over (partition by run_id, category order by {SEVERITY}, issue, file, position) as place from top5",
    # run log ------------------------------------------------------------
    "latest": """select run_id, node_id, to_state as state, seq from v_transitions t
        where not exists (select 1 from v_transitions u where u.run_id = t.run_id and u.node_id = t.node_id and u.seq > t.seq)""",
    "log_runs": "select distinct run_id from v_transitions",
    "failure_texts": """select run_id, node_id as branch, seq, node_id || ' stopped, token=' || lpad(seq::varchar, 12, '0') as reason
        from v_transitions where to_state = 'failed'""",
    "last_failures": "select run_id, branch, arg_max(reason, seq) as reason from failure_texts group by all",
    "stage_rows": "select run_id, " + ", ".join(
        f"coalesce(max(case when node_id = '{s}' and state in {in_list(['completed'] if s == 'scanner' else ['completed', 'degraded'])} then state end), 'failed') as {s}"
        for s in V.STAGES
    ) + " from latest group by run_id",
    "chain": "select *, coalesce(lag(to_state) over (partition by run_id order by seq), 'pending') as from_state from v_transitions",
    "run_rows": """select run_id, 'registered' as status, '2023-12-31T00:00:00' as started_at, null::varchar as finished_at, -1 as seq from v_requests
        union all select run_id, node_id || '_' || to_state, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f'), strftime(ts, '%Y-%m-%dT%H:%M:%S.%f'), seq from v_transitions""",
    "event_runs": "select * from run_rows where seq >= 0",
    "summary_runs": """select distinct 'run-' || (doc_id % 100) as run_id, 'repo-' || (doc_id % 100) as repo from scanned""",
    "run_files": f"""select * replace ('run-' || (doc_id % 100) as run_id, 'repo-' || (doc_id % 100) as repo),
        {skip_case(V.DEFAULT_MAX_FILE_BYTES)} as reason, {LANGUAGE} as language, {NAME} as name from v_files""",
    "dirty": """select ord, id, run_id, category as branch, ord // 1024 as part, case when ord % 11 = 0 then 'security' else category end as category,
        raw_severity as severity, case ord % 9 when 0 then 'unknown' when 1 then ' N/A ' when 2 then 'Insufficient' else status end as status,
        raw_confidence as confidence, evidence_file is not null as has_ref, case when ord % 5 = 0 then '  ' else evidence_file end as file, raw_line as line
        from v_findings""",
    "clean": f"""select * replace (branch as category, coalesce({case_map('lower(trim(severity))', V.SEVERITY_SPELLINGS)}, severity) as severity,
        coalesce({case_map("replace(lower(trim(status)), ' ', '_')", V.STATUS_SPELLINGS)}, status) as status,
        greatest(0, least(1, coalesce(try_cast(trim(confidence) as double), 0.5)))::varchar as confidence,
        case when trim(file) = '' then 'N/A' else trim(file) end as file,
        greatest(1, case when regexp_full_match(trim(line), '-?[0-9]+') then trim(line)::bigint else 1 end)::varchar as line) from dirty""",
    "changed": """select d.run_id, d.branch, d.part, bool_or(d.category <> c.category or d.severity <> c.severity or d.status <> c.status
          or coalesce(try_cast(d.confidence as double)::varchar, 'x') <> coalesce(try_cast(c.confidence as double)::varchar, 'y') or trim(d.confidence) <> d.confidence
          or (d.has_ref and (d.file <> c.file or d.line <> c.line))) as is_changed
        from dirty d join clean c using (ord) group by all""",
}

BROKEN = [
    ("severity_unknown", f"severity not in {in_list(V.SEVERITIES)}"),
    ("status_unknown", f"status not in {in_list(V.STATUSES)}"),
    ("confidence_range", "coalesce(try_cast(confidence as double) not between 0 and 1, true)"),
    ("confirmed_without_evidence", "status = 'confirmed' and not has_ref"),
    ("evidence_line_range", "has_ref and coalesce(try_cast(line as double) < 1, true)"),
    ("category_of_other_branch", "category <> branch"),
]
CTES["dirty_broken"] = " union all ".join(f"select *, '{n}' as rule from dirty where {c}" for n, c in BROKEN)
CTES["clean_broken"] = " union all ".join(f"select *, '{n}' as rule from clean where {c}" for n, c in BROKEN)

_NAMES = sorted(CTES, key=len, reverse=True)
_NAME = re.compile(r"\b(" + "|".join(_NAMES) + r")\b")


def compose(statement: str) -> str:
    """The statement with every sub-query it needs, dependencies first."""
    ordered: list[str] = []

    def visit(sql: str, path: tuple[str, ...]) -> None:
        for name in dict.fromkeys(_NAME.findall(re.sub(r"'(?:[^']|'')*'", "''", sql))):
            if name in path:
                continue
            if name not in ordered:
                visit(CTES[name], (*path, name))
                if name not in ordered:
                    ordered.append(name)

    visit(statement, ())
    if not ordered:
        return statement
    shared = ",\n".join(f"{name} as ({CTES[name]})" for name in ordered)
    own = statement.lstrip()
    return f"with {shared},\n{own[5:]}" if own.startswith("with ") else f"with {shared}\n{own}"
