"""Audit tables derived from the driver's parquet tables.

The driver tables hold no repositories, so each view derives one input table of
the audit from a whole driver table. The text is written once with a few macros
and expanded for Spark (over files) and for the SQL oracle (over named views).
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FILES = """
select doc_id, source as repo, concat('run-',source) run_id,
 case when d='' then n else concat(d,'/m',cast(doc_id as STR),'/',n) end rel_path, content, BYTES(content) size_bytes
from (select *, case n
   when 'package.json' then case when doc_id%5=0 then concat('{broken ',body) else concat('{"dependencies":{"',kw,'":"1","left-pad":"1"},"devDependencies":{"react":"2"},"keywords":',JLIST(body),'}') end
   when 'requirements.txt' then concat('# deps',chr(10),'fastapi==0.1',chr(10),chr(10),kw,'>=1',chr(10),'# ',replace(body,chr(10),concat(chr(10),'# ')),chr(10))
   when 'pyproject.toml' then concat('[project]',chr(10),'dependencies = [',chr(10),'  "django>=4",',chr(10),'  "rich",',chr(10),']',chr(10),'# ',replace(body,chr(10),concat(chr(10),'# ')),chr(10))
   when 'pom.xml' then concat('<dependency>a</dependency><dependency>b</dependency><!-- ',body,' -->')
   else text end content
 from (select *, coalesce(text,'') body, PICK(doc_id%16; 'main.py','utils.py','index.js','package.json','requirements.txt','pyproject.toml','pom.xml','Dockerfile','server.ts','users.JSX','Main.java','uv.lock','go.sum','README.md','lib.rs','app.cs')KCIP n,
   PICK(IDIV(doc_id,16)%12; '','src','src/services','api/routes','tests','tests/fixtures/sample','node_modules/pkg','docs','models','build','.venv/lib','services')KCIP d,
   PICK(IDIV(doc_id,16)%9; 'Express','nestjs','next','vue','fastapi','lodash','flask','spring-boot','django')KCIP kw from @documents))
"""

IGNORE_FILES = """
select repo, run_id, concat(folder, case when folder='' then '' else '/' end, case when rank%3=2 then '.ignore' else '.gitignore' end) rel_path,
 PICK(rank%6; '*.md','# none','/m1*','m?[0-4]/','**/index.js','server.*')KCIP first_line, PICK(rank%5; '!README.md','build/','!m1?3','tests/**','/src/services/')KCIP second_line
from (select *, length(folder)+length(repo) rank from (select distinct repo, run_id, case when d in ('src/services','tests/fixtures/sample','node_modules/pkg') then '' else d end folder
  from (select source as repo, concat('run-',source) run_id, PICK(IDIV(doc_id,16)%12; '','src','src/services','api/routes','tests','tests/fixtures/sample','node_modules/pkg','docs','models','build','.venv/lib','services')KCIP d from @documents)))
"""

EVIDENCE = """
select event_id ord, concat('run-',cast(user_id as STR),'-',cast(k%4 as STR)) run_id, concat('repo-',cast(user_id as STR)) repo,
 case event_type when 'error' then 'semgrep' when 'click' then 'bandit' when 'view' then 'osv' when 'purchase' then 'scanner_heuristic' else 'rg' end source,
 PICK(k%9; 'entrypoint','config','route','auth','db','perf_hotspot','secret','vuln','dependency')KCIP signal_type,
 concat('src/',PICK(event_id%4; 'app.py','index.js','admin.py','util.go')KCIP) file, cast(IDIV(k,4)%3+1 as int) line_start, cast(IDIV(k,4)%3+1+event_id%3 as int) line_end,
 PICK(event_id%24; 'Hardcoded secret-like token','Debug mode enabled','Tainted user input reaches sink','Possible SQL injection via execute(','JWT none algorithm accepted','Use of weak MD5 hash','Unprotected /admin route','package vulnerable to CVE-2024-1','Blocking synchronous call in handler','N+1 query per item','No cache on repeat query','Large payload response','Cache miss causes full scan','Sync loop reads file io','List endpoint without pagination','Entrypoint candidate','Nothing of note','Latency in async job','Potential injection surface','CORS allow all origins','Dependency manifest detected','Unpinned import','assert used','try-except-pass')KCIP summary,
 cast(50+10*(event_id%6) as double)/100 confidence
from (select *, cast(JGET(props,'$.k') as int) k from @events)
"""

FINDINGS = """
select o_orderkey ord, concat('run-',cast(o_custkey%100 as STR)) run_id, concat('f',cast(o_orderkey as STR)) id,
 PICK(o_orderkey%3; 'architecture','security','performance')KCIP category, concat('issue ',cast(o_orderkey%40 as STR)) title, concat('advice ',cast(o_orderkey%25 as STR)) recommendation,
 PICK(o_orderkey%8; 'Low','MEDIUM',' high ','Critical','unknown','info','Severe','n/a')KCIP raw_severity,
 case o_orderpriority when '1-URGENT' then 'Critical' when '2-HIGH' then 'High' when '3-MEDIUM' then 'Medium' else 'Low' end severity,
 case o_orderstatus when 'F' then 'confirmed' when 'O' then 'suspected' else PICK(o_orderkey%3; 'insufficient_evidence','not_applicable','failed')KCIP end status,
 PICK(o_orderkey%7; '0.5','1.7','-1','abc',' 0.25 ','0.9','0')KCIP raw_confidence, PICK(o_orderkey%6; '0','12','-3','x',' 7 ','')KCIP raw_line,
 cast(o_custkey%100 as double)/100 confidence, case when o_orderkey%4=0 then null else concat('src/f',cast(o_orderkey%9 as STR),'.py') end evidence_file
from @orders
"""

DEPENDENCIES = """
select l_orderkey, concat('run-',cast(IDIV(l_orderkey,20)%150 as STR),'-',cast(IDIV(l_orderkey,3000)%4 as STR)) run_id, l_linenumber, concat('locks/',cast(l_orderkey as STR),'/uv.lock') source_file,
 case when l_partkey%17=0 then null else p_name end package, p_brand ecosystem, cast(p_size as STR) version, concat('GHSA-',cast(l_suppkey as STR),'-',cast(l_linenumber as STR)) vulnerability_id,
 PICK(l_partkey%6; 'LOW','medium',' High','CRITICAL','MODERATE','')KCIP raw_severity, case when l_partkey%3=0 then null else concat(cast(p_size+1 as STR),'.0') end fixed_version
from @lineitem join @part on l_partkey=p_partkey
"""

ATTEMPTS = """
select concat('run-',cast(l_orderkey as STR)) run_id, l_linenumber%2+1 attempt,
 PICK(min(l_partkey)%5; 0,1,2,128,cast(null as int))KCIP exit_code, min(l_suppkey)%11<>0 tool_found, min(l_partkey)%5=4 timed_out, PICK(min(l_suppkey)%3; '','{"results":[]}','plain text')KCIP stdout, PICK(max(l_partkey)%2; '','boom')KCIP stderr
from @lineitem group by l_orderkey, l_linenumber%2+1
"""

TRANSITIONS = """
select event_id seq, concat('run-',cast(user_id as STR)) run_id, case event_type when 'signup' then 'scanner' when 'view' then 'architecture' when 'click' then 'security' when 'purchase' then 'performance' else 'roadmap' end node_id,
 PICK(k%4; 'pending','running','completed','failed')KCIP to_state, ts
from (select *, cast(JGET(props,'$.k') as int) k from @events)
"""

REQUESTS = """
select concat('run-',cast(c_custkey as STR)) run_id, PICK(c_custkey%3; 'github_url','local_path','ftp')KCIP source_type,
 case when c_custkey%4=0 then null when c_custkey%4=1 then concat('git@github.com:',c_mktsegment,'/r',cast(c_custkey as STR),'.git') when c_custkey%4=2 then concat('https://github.com/',c_mktsegment,'/r',cast(c_custkey as STR)) else 'https://example.org/x' end github_url,
 case when c_custkey%5=0 then null else concat('/data/r',cast(c_custkey as STR)) end local_path, PICK(c_custkey%5; 'openai','lmstudio',' LM-Studio ','lm_studio','other')KCIP provider, cast(1000+c_custkey%9000 as int) max_tokens, 4096 context_window,
 concat('2024-01-0',cast(1+c_custkey%9 as STR),'T00:00:00Z') created_at, case when c_custkey%6=0 then null else concat('c',cast(c_custkey*7919 as STR)) end commit_id,
 case when c_custkey%7=0 then null else concat('profile-',cast(c_custkey%3 as STR)) end profile, case when c_custkey%8=0 then null else concat('model-',cast(c_custkey%4 as STR)) end model
from @customer
"""

VIEWS = {
    "v_files": FILES,
    "v_ignore": IGNORE_FILES,
    "v_evidence": EVIDENCE,
    "v_findings": FINDINGS,
    "v_dep": DEPENDENCIES,
    "v_attempts": ATTEMPTS,
    "v_transitions": TRANSITIONS,
    "v_requests": REQUESTS,
}


_TABLE = r"@(documents|events|orders|lineitem|part|customer)\b"


def _expand(text: str, pick, divide, replacements: dict[str, str]) -> str:
    text = re.sub(r"IDIV\(([^(),]+),([^(),]+)\)", lambda m: divide(m[1], m[2]), text)
    text = re.sub(r"PICK\((.*?); (.*?)\)KCIP", lambda m: pick(m[1], m[2]), text, flags=re.DOTALL)
    for pattern, replacement in replacements.items():
        text = re.sub(pattern, replacement, text)
    return text


def spark_text(view: str, sf_dir: str) -> str:
    return _expand(
        VIEWS[view],
        lambda i, items: f"element_at(array({items}),cast({i} as int)+1)",
        lambda a, b: f"({a} div {b})",
        {
            r"\bSTR\b": "string",
            r"\bJGET\(": "get_json_object(",
            r"\bJLIST\((\w+)\)": r"to_json(array(\1))",
            r"\bBYTES\(": "octet_length(",
            _TABLE: lambda m: f"parquet.`{sf_dir.rstrip('/')}/{m[1]}.parquet`",
        },
    )


def oracle_text(view: str) -> str:
    return _expand(
        VIEWS[view],
        lambda i, items: f"([{items}])[cast({i} as int)+1]",
        lambda a, b: f"({a} // {b})",
        {
            r"\bSTR\b": "varchar",
            r"\bJGET\(": "json_extract_string(",
            r"\bJLIST\((\w+)\)": r"cast(to_json([\1]) as varchar)",
            r"\bBYTES\(": "strlen(",
            _TABLE: r"\1",
        },
    )


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.sql(spark_text(name, sf_dir))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "v_files")


def ignore_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "v_ignore")


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "v_evidence")


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "v_findings")


def dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "v_dep")


#: Copies of each part for ``dealt_dependencies``: so many tasks share the lines of one very common part.
PART_COPIES = 8


def dealt_dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of ``dependencies``, dealt out evenly for heavy work on each; the number of partitions is the session's.

    The join's own shuffle deals them, by part and salt, while a line is four numbers; its texts are made behind it.
    So lines are shuffled once, and the parts, however many, are never broadcast.
    """
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    salt = f"cast(pmod(xxhash64(l_orderkey, l_linenumber), {PART_COPIES}) as int)"
    lines = _table(spark, sf_dir, "lineitem").repartition(partitions, F.col("l_partkey"), F.expr(salt))
    parts = _table(spark, sf_dir, "part").withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(PART_COPIES - 1))))
    text = re.sub(r"parquet\.`[^`]*/(lineitem|part)\.parquet`", r"{\1}", spark_text("v_dep", sf_dir))
    return spark.sql(f"{text.rstrip()} and {salt} = copy", lineitem=lines, part=parts.hint("merge"))


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "v_attempts")


def transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "v_transitions")


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "v_requests")
