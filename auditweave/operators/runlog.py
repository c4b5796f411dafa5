"""Analytics over the append-only transition log.

``transitions(run_id, node_id, to_state, seq, ts)``: ``seq`` is the insertion
order. States per run or node are combining aggregates; only neighbour
look-ups need an order, and those work on slices of a run (``skew.neighbours``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditweave import fixed_values as V
from auditweave.functions.ranks import literal_map, lookup
from auditweave.functions.skew import SLICE_ROWS, attach, neighbours
from auditweave.functions.text import redacted, short_digest, strip


def latest_state(transitions: DataFrame) -> DataFrame:
    """Current state per run and node."""
    return transitions.groupBy("run_id", "node_id").agg(
        F.max_by("to_state", "seq").alias("state"), F.max("seq").alias("seq")
    )


def latest_run_state(transitions: DataFrame) -> DataFrame:
    """Current node and state per run."""
    last = F.max_by(F.struct("node_id", "to_state"), "seq")
    return (
        transitions.groupBy("run_id")
        .agg(last.alias("last"), F.max("seq").alias("seq"))
        .select("run_id", F.col("last.node_id").alias("node_id"), F.col("last.to_state").alias("state"), "seq")
    )


def completed_nodes(transitions: DataFrame) -> DataFrame:
    """Nodes that completed, in the order they first did; at most one entry per node."""
    first = (
        transitions.filter(F.col("to_state") == "completed").groupBy("run_id", "node_id").agg(F.min("seq").alias("seq"))
    )
    return first.groupBy("run_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("seq", "node_id"))), lambda x: x["node_id"]).alias("nodes")
    )


def resume_plan(transitions: DataFrame, nodes: list[str] | None = None) -> DataFrame:
    """Nodes still to run: every node of a run that never completed."""
    nodes = nodes or V.FLOW_NODES
    done = transitions.groupBy("run_id").agg(
        *[F.bool_or((F.col("node_id") == n) & (F.col("to_state") == "completed")).alias(f"done:{n}") for n in nodes]
    )
    open_nodes = F.array_compact(F.array(*[F.when(~F.col(f"done:{n}"), F.lit(n)) for n in nodes]))
    return done.select("run_id", F.explode(open_nodes).alias("node_id"))


def _state_of(node: str) -> Column:
    return F.max_by(F.when(F.col("node_id") == node, F.col("to_state")), F.when(F.col("node_id") == node, F.col("seq")))


def roadmap_state(transitions: DataFrame, planner_errors: DataFrame | None = None) -> DataFrame:
    """State of the roadmap stage per run that reached it.

    Failed when the stage failed; degraded when a branch failed or the planner
    had an error; else completed.
    """
    states = transitions.groupBy("run_id").agg(
        _state_of("roadmap").alias("_roadmap"), *[_state_of(b).alias(f"_{b}") for b in V.CATEGORIES]
    )
    if planner_errors is not None:
        marked = planner_errors.select("run_id").distinct().withColumn("_planner", F.lit(True))
        states = states.join(marked, "run_id", "left")
    else:
        states = states.withColumn("_planner", F.lit(False))
    branch_failed = F.lit(False)
    for branch in V.CATEGORIES:
        branch_failed = branch_failed | F.coalesce(F.col(f"_{branch}") == "failed", F.lit(False))
    status = (
        F.when(F.col("_roadmap") == "failed", "failed")
        .when(branch_failed | F.coalesce("_planner", F.lit(False)), "degraded")
        .otherwise("completed")
    )
    return states.filter(F.col("_roadmap").isin(*V.TERMINAL_STATES)).select("run_id", status.alias("roadmap_status"))


def fan_in_ready(transitions: DataFrame) -> DataFrame:
    """Runs in which all three branches are finished, failed or not."""
    states = transitions.groupBy("run_id").agg(*[_state_of(b).alias(b) for b in V.CATEGORIES])
    ready = F.lit(True)
    for branch in V.CATEGORIES:
        ready = ready & F.coalesce(F.col(branch).isin(*V.TERMINAL_STATES), F.lit(False))
    return states.filter(ready)


def transition_chain(transitions: DataFrame, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Add ``from_state``: the run's state before each row, 'pending' at first."""
    chained = neighbours(transitions, ["run_id"], "seq", F.col("to_state"), before="_before", slice_rows=slice_rows)
    return chained.withColumn("from_state", F.coalesce("_before", F.lit("pending"))).drop("_before")


def chain_breaks(recorded: DataFrame, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Rows of a log whose recorded from_state is not the state before them."""
    expected = transition_chain(recorded.withColumnRenamed("from_state", "recorded"), slice_rows)
    return expected.filter(~F.col("recorded").eqNullSafe(F.col("from_state")))


def stage_spans(transitions: DataFrame, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Start and end of every stage execution.

    A 'running' row starts a span that the next finished row of the same stage
    ends. A finished row without a start is a span of no length; a start
    without an end is closed when the run ends, and one that another start
    replaces is never closed.
    """
    run_end = transitions.groupBy("run_id").agg(F.max("ts").alias("_run_end"))
    events = transitions.filter(F.col("to_state").isin("running", *V.TERMINAL_STATES))
    around = neighbours(
        events,
        ["run_id", "node_id"],
        "seq",
        F.struct("to_state", "ts"),
        before="_before",
        after="_after",
        slice_rows=slice_rows,
    )
    running = F.col("to_state") == "running"
    starts_nothing = ~running & F.coalesce(F.col("_before.to_state") == "running", F.lit(False))
    spans = attach(around.filter(~starts_nothing), run_end, ["run_id"], ["seq"])
    after = F.col("_after.to_state")
    closed_by = (
        F.when(~running, "instant").when(after.isNull(), "run_end").when(after == "running", "replaced").otherwise(after)
    )
    spans = spans.withColumn("closed_by", closed_by)
    ended = (
        F.when(F.col("closed_by") == "instant", F.col("ts"))
        .when(F.col("closed_by") == "run_end", F.col("_run_end"))
        .when(F.col("closed_by") != "replaced", F.col("_after.ts"))
    )
    return spans.select("run_id", "node_id", "seq", F.col("ts").alias("started_at"), ended.alias("ended_at"), "closed_by")


def trace_ids(transitions: DataFrame) -> DataFrame:
    """Trace id per run and checkpoint key per run and node."""
    return (
        transitions.select("run_id", "node_id")
        .distinct()
        .withColumn("trace_id", short_digest(F.col("run_id"), length=32))
        .withColumn("checkpoint_key", F.concat_ws(":", "run_id", "node_id"))
    )


def branch_failures(failures: DataFrame) -> DataFrame:
    """Redacted text of the last failure per branch, as a map per run.

    ``failures(run_id, branch, seq, reason)``; a run has at most one entry per branch.
    """
    last = failures.groupBy("run_id", "branch").agg(F.max_by("reason", "seq").alias("reason"))
    entry = F.struct("branch", redacted(F.col("reason")).alias("reason"))
    return last.groupBy("run_id").agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("branch_failures"))


def stage_statuses(transitions: DataFrame) -> DataFrame:
    """Latest state of every stage as a map per run; at most one entry per stage."""
    last = latest_state(transitions)
    entry = F.struct("node_id", "state")
    return last.groupBy("run_id").agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("analysis_status"))


def run_manifest(requests: DataFrame, statuses: DataFrame, failures: DataFrame, settings: dict) -> DataFrame:
    """Nested manifest per run from its request, states and failures.

    ``settings`` holds constants of the job: versions of tools and prompts, retries and timeouts. Every
    input has at most one row per run. ``created_at``, ``commit_id``, ``profile`` and ``model`` of a
    request may be null or absent.
    """
    optional = {c: F.col(c) if c in requests.columns else F.lit(None).cast("string") for c in ("created_at", "commit_id", "profile", "model")}
    url_name = F.nullif(F.regexp_extract("github_url", V.HOSTING_URL_PATTERN, 2), F.lit(""))
    local = F.col("source_type") == "local_path"
    folder = F.regexp_replace("local_path", "/+$", "")
    name = F.when(local, F.substring_index(folder, "/", -1)).otherwise(
        F.coalesce(url_name, F.lit("unknown-repo"))
    )
    workspace = F.lit(settings["workspace_root"].rstrip("/") + "/")
    place = F.when(local, folder).otherwise(F.concat(workspace, "_name", F.lit("-"), "run_id"))
    no_map = F.create_map().cast("map<string,string>")
    joined = (
        requests.withColumn("_name", name)
        .join(statuses, "run_id", "left")
        .join(failures, "run_id", "left")
    )
    constants = {
        k: F.struct(*[F.lit(v).alias(n) for n, v in settings[k].items()]).alias(k) for k in ("retries", "timeouts")
    }
    return joined.select(
        "run_id",
        F.lit(settings["schema_version"]).alias("schema_version"),
        optional["created_at"].alias("created_at"),
        F.struct(F.col("_name").alias("repo_name"), place.alias("resolved_path"), optional["commit_id"].alias("git_commit_sha")).alias("repo"),
        F.struct(
            optional["profile"].alias("profile"),
            lookup(F.lower(strip(F.col("provider"))), V.PROVIDER_SPELLINGS).alias("provider_type"),
            optional["model"].alias("model"),
            F.col("max_tokens").alias("max_tokens"),
        ).alias("provider"),
        literal_map(settings["tool_versions"]).alias("tool_versions"),
        literal_map(settings["prompt_versions"]).alias("prompt_versions"),
        *constants.values(),
        F.coalesce("analysis_status", no_map).alias("analysis_status"),
        F.transform_values(F.coalesce("branch_failures", no_map), lambda _k, v: redacted(v)).alias("branch_failures"),
    )
