"""Step outcomes, group status, abort rules and run history, recomputed over log tables.

Every rule here is an aggregate per run (or per run and group) joined back to
the steps, rather than a sequential walk: partial aggregation keeps the shuffle
small and AQE can split a run that owns a large share of the rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.session import cut_lineage

# Group statuses (strongest first), the log truncation marker,
# the per-step log budget, the history list size and snippet width, and the
# characters a name normalisation replaces.
ERROR, PENDING, PARTIAL, SKIPPED, SUCCESS = "error", "pending", "partial", "skipped", "success"
TRUNCATION_MARKER = "[OUTPUT TRUNCATED DUE TO SIZE LIMIT]"
LOG_BUDGET_BYTES = 5 * 1024 * 1024
HISTORY_LIMIT = 50
SNIPPET_WIDTH = 50
NAME_PATTERN = r"[\s-]"


def _as_list(x):
    return [x] if isinstance(x, (str, Column)) else list(x)


def group_status(steps: DataFrame, keys=("run_id", "group_name"), status: str = "status") -> DataFrame:
    """error if any member errored; else pending if any has no result yet; else
    partial when skipped and successful members mix; skipped when all were
    skipped; else success."""
    s = F.col(status)
    agg = steps.groupBy(*_as_list(keys)).agg(
        F.max((s == ERROR).cast("int")).alias("_e"),
        F.max((s.isNull() | (s == PENDING)).cast("int")).alias("_p"),
        F.max((s == SKIPPED).cast("int")).alias("_k"),
        F.max((s == SUCCESS).cast("int")).alias("_s"),
    )
    st = (F.when(F.col("_e") == 1, ERROR).when(F.col("_p") == 1, PENDING)
          .when((F.col("_k") == 1) & (F.col("_s") == 1), PARTIAL)
          .when(F.col("_k") == 1, SKIPPED).otherwise(SUCCESS))
    return agg.select(*_as_list(keys), st.alias("group_status"))


def _order_key(order) -> Column:
    cols = [F.col(c) if isinstance(c, str) else c for c in _as_list(order)]
    return F.struct(*cols) if len(cols) > 1 else cols[0]


def abort_propagation(steps: DataFrame, run: str = "run_id", group: str = "group_name",
                      order=("ts", "event_id"), cond: str = "cond", outcome: str = "outcome") -> DataFrame:
    """Final status per step under the group-abort rule.

    A step whose own condition is false is skipped and aborts its group; an
    error aborts its group; later members of an aborted group without their
    own condition are skipped, while a member whose own condition passes still
    runs. Abort only ever switches on, so a step is aborted exactly when its
    position is after the group's first bad step.
    """
    key = _order_key(order)
    bad = (F.col(cond) == F.lit(False)) | ((F.col(outcome) == ERROR) & F.coalesce(F.col(cond), F.lit(True)))
    first_bad = (steps.where(F.col(group).isNotNull() & bad)
                 .groupBy(run, group).agg(F.min(key).alias("_first_bad")))
    j = steps.join(first_bad, [run, group], "left")
    aborted = F.col("_first_bad").isNotNull() & (key > F.col("_first_bad")) & F.col(cond).isNull()
    final = (F.when(F.col(cond) == F.lit(False), SKIPPED).when(aborted, SKIPPED)
             .otherwise(F.col(outcome)))
    return j.withColumn("final_status", final).drop("_first_bad")


def run_first_error(steps: DataFrame, run: str = "run_id", order=("ts", "event_id"),
                    status: str = "status", error: str = "error") -> DataFrame:
    """Per run: the first error message in step order and the run status."""
    key = _order_key(order)
    is_err = F.col(status) == ERROR
    return steps.groupBy(run).agg(
        F.min_by(F.when(is_err, F.col(error)), F.when(is_err, key)).alias("first_error"),
        F.when(F.max(is_err.cast("int")) == 1, ERROR).otherwise(SUCCESS).alias("run_status"))


def normalise_name(c) -> Column:
    """Names usable as identifiers: whitespace and dashes become ``_``."""
    return F.regexp_replace(F.col(c) if isinstance(c, str) else c, NAME_PATTERN, "_")


def latest_state(events: DataFrame, keys=("id", "flow"), status: str = "status", ts: str = "timestamp",
                 seq: str | None = None, extra_max=("duration",)) -> DataFrame:
    """Latest status per run: ``max_by(status, (ts, seq))`` over non-null statuses,
    plus ``max(ts)`` and other maxima."""
    order = F.struct(F.col(ts), F.col(seq)) if seq else F.col(ts)
    aggs = [F.max_by(F.col(status), F.when(F.col(status).isNotNull(), order)).alias(status),
            F.max(ts).alias(ts)]
    aggs += [F.max(c).alias(c) for c in extra_max]
    return events.groupBy(*_as_list(keys)).agg(*aggs)


def run_history(events: DataFrame, flow: str | None = None, limit: int = HISTORY_LIMIT, **kw) -> DataFrame:
    """Newest ``limit`` runs (top-k, not a global sort), optionally for one flow."""
    ts = kw.get("ts", "timestamp")
    if flow is not None:
        events = events.where(F.col(kw.get("flow_col", "flow")) == F.lit(flow))
    kw.pop("flow_col", None)
    return latest_state(events, **kw).orderBy(F.col(ts).desc()).limit(limit)


def run_detail(runs: DataFrame, steps: DataFrame, run_id: Column, run: str = "run_id",
               order: str = "step_no") -> DataFrame:
    """One run's summary with its steps in order."""
    r = runs.where(F.col(run) == run_id)
    return r.join(steps.where(F.col(run) == run_id), run, "inner").orderBy(order)


def log_truncate(logs: DataFrame, keys=("run_id", "step"), seq: str = "seq", text: str = "line",
                 budget: int = LOG_BUDGET_BYTES, chunk: int = 100_000) -> DataFrame:
    """Apply a per-step byte budget: lines are kept while the running size fits,
    the first line that crosses it is replaced by one marker, later lines are
    dropped (empty lines still pass).

    The running size is not one window over a whole step (a step owning a third
    of the log would be one task). Lines are cut into chunks of ``chunk`` seq
    values; byte totals per (step, chunk) are a partial aggregate, a running sum
    over that small table gives the bytes of earlier chunks, and the per-line
    window only spans one chunk. Chunks already past the budget skip the window.
    """
    from pyspark.sql import Window

    keys = _as_list(keys)
    s = F.col(seq)
    num = F.unix_micros(s.cast("timestamp")) if dict(logs.dtypes)[seq] in ("timestamp", "timestamp_ntz", "date") else s
    df = (logs.withColumn("_size", F.octet_length(F.col(text)))
          .withColumn("_chunk", F.floor(num / F.lit(chunk)).cast("bigint")))
    totals = df.groupBy(*keys, "_chunk").agg(F.sum("_size").alias("_tot"))
    wk = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(*keys, "_chunk", F.coalesce(F.sum("_tot").over(wk), F.lit(0)).alias("_carry"))
    df = df.join(carry, [*keys, "_chunk"]).where((F.col("_carry") <= budget) | (F.col("_size") == 0))
    wc = Window.partitionBy(*keys, "_chunk").orderBy(seq).rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("_before", F.col("_carry") + F.coalesce(F.sum("_size").over(wc), F.lit(0)))
    incl = F.col("_before") + F.col("_size")
    marker = (F.col("_before") < budget) & (incl > budget)
    kept = (incl <= budget) | (F.col("_size") == 0) | marker
    return (df.where(kept)
            .withColumn(text, F.when(marker, F.lit(TRUNCATION_MARKER)).otherwise(F.col(text)))
            .select(*logs.columns))


def history_snippets(history: DataFrame, text: str = "query", order=("ts",), limit: int = HISTORY_LIMIT,
                     width: int = SNIPPET_WIDTH) -> DataFrame:
    """Newest ``limit`` entries with line breaks collapsed to one space, trimmed, and a ``width``-char snippet."""
    flat = F.regexp_replace(F.regexp_replace(F.col(text), r"[\n\r]+", " "), r"^\s+|\s+$", "")
    snippet = F.when(F.char_length(flat) > width, F.concat(F.substring(flat, 1, width), F.lit("...")))
    return (history.withColumn("snippet", F.coalesce(snippet, flat))
            .orderBy(*[F.col(c).desc() for c in _as_list(order)]).limit(limit))


def stop_after_output(steps: DataFrame, run: str = "run_id", order=("ts", "event_id"),
                      is_output: str = "is_output") -> DataFrame:
    """Drop steps after the first step marked as output; runs without one keep all."""
    key = _order_key(order)
    cut = steps.where(F.col(is_output)).groupBy(run).agg(F.min(key).alias("_cut"))
    return (steps.join(cut, run, "left")
            .where(F.col("_cut").isNull() | (key <= F.col("_cut"))).drop("_cut"))


def dry_run(steps: DataFrame, rules: dict[str, str], group: str = "group_name") -> DataFrame:
    """Step counts per group and planned action (``run`` / ``skip``) from run-when
    rules evaluated without executing any step; a rule that cannot be evaluated
    fails open, as in a real run."""
    from weft.operators.gates import evaluate_rules

    planned = evaluate_rules(steps, rules, on_error="run")
    runs_all = F.lit(True)
    for name in rules:
        runs_all = runs_all & F.col(name)
    return (planned.groupBy(group, F.when(runs_all, "run").otherwise("skip").alias("action"))
            .agg(F.count(F.lit(1)).alias("n_steps")))


def step_outcomes(steps: DataFrame, needs: DataFrame, run: str = "run_id", step: str = "step",
                  outcome: str = "outcome") -> DataFrame:
    """Final outcome of every step when steps depend on the outcomes of others.

    ``steps``: run, step and the outcome it has if it runs. ``needs``: run, step, ``on`` (a step of the run) and
    ``wanted`` (the outcomes of ``on`` it runs after; null: any). A step runs if all its needs are met,
    else it is skipped, which is an outcome others may want. Steps that wait for each other, or for
    a step that does not exist, stay pending. One row per (run, step) is expected.

    Evaluated level by level: only the steps settled in the last round meet the needs on them, and
    what waiting steps have heard so far is a count and a flag, so a round costs its own steps.
    """
    needs = needs.select(F.col(run).alias("_run"), F.col(step).alias("_step"), "on", "wanted")
    count = needs.groupBy("_run", "_step").agg(F.count("*").alias("_needs"))
    own = steps.select(F.col(run).alias("_run"), F.col(step).alias("_step"), F.col(outcome).alias("_outcome"))
    own = cut_lineage(own.join(count, ["_run", "_step"], "left").na.fill(0, ["_needs"]))
    settled = cut_lineage(own.where("_needs = 0").select("_run", "_step", F.col("_outcome").alias("_final")))
    waiting = own.where("_needs > 0").withColumn("_heard", F.lit(0).cast("long")).withColumn("_met", F.lit(True))
    rounds = [settled]
    while not settled.isEmpty():
        news = needs.join(settled.select("_run", F.col("_step").alias("on"), "_final"), ["_run", "on"])
        fits = F.col("wanted").isNull() | F.coalesce(F.array_contains("wanted", F.col("_final")), F.lit(False))
        news = news.groupBy("_run", "_step").agg(F.count("*").alias("_new"), F.min(fits).alias("_fits"))
        waiting = cut_lineage(waiting.join(news, ["_run", "_step"], "left").select(
            "_run", "_step", "_outcome", "_needs", (F.col("_heard") + F.coalesce("_new", F.lit(0))).alias("_heard"),
            (F.col("_met") & F.coalesce("_fits", F.lit(True))).alias("_met")))
        ready = F.col("_heard") == F.col("_needs")
        settled = waiting.where(ready).select(
            "_run", "_step", F.when(F.col("_met"), F.col("_outcome")).otherwise(SKIPPED).alias("_final"))
        waiting = waiting.where(~ready)
        rounds.append(settled)
    rounds.append(waiting.select("_run", "_step", F.lit(PENDING).alias("_final")))
    return reduce(DataFrame.unionByName, rounds).select(
        F.col("_run").alias(run), F.col("_step").alias(step), F.col("_final").alias("final_outcome"))


# Columns of the stored step log (fixed values).
STEP_LOG = "run_id string, flow string, cell_index int, status string, duration int, logs string, outputs string, error string"


def log_steps(table, steps: DataFrame) -> int:
    """Append executed steps to the saved step log (a :class:`weft.tables.SavedTable`), created on first use.
    ``steps`` has the columns of :data:`STEP_LOG`; ``logs`` is cut to the log budget of a step."""
    names = [c.split()[0] for c in STEP_LOG.split(", ")]
    logs = F.when(F.octet_length("logs") > LOG_BUDGET_BYTES, F.concat(
        F.substring("logs", 1, LOG_BUDGET_BYTES // 4), F.lit("\n" + TRUNCATION_MARKER))).otherwise(F.col("logs"))
    rows = steps.withColumn("logs", logs).select(*names)
    if not table.versions():
        table.create(steps.sparkSession.createDataFrame([], STEP_LOG))
    return table.insert(rows)
