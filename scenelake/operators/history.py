"""Analysis history: folding tool results, step numbers, lists, deletion, reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scenelake.operators.ranking import rank_within

DEFAULT_CONFIDENCE = 0.88
# Model states that reach the folded result, the last one seen wins.
REPORTED_STATES = ["WEIGHTS_DETECTED", "WEIGHTS_NOT_FOUND", "BENCHMARK_EVALUATION_ACTIVE"]


def number_steps(steps: DataFrame, at: str, key: str = "analysis_id", ties: Sequence[str] = ("tool",), out: str = "step") -> DataFrame:
    """Number the steps of each analysis by time (``at`` must be numeric or a timestamp)."""
    kind = dict(steps.dtypes)[at]
    moment = F.unix_micros(F.col(at).cast("timestamp")) if kind.startswith("timestamp") else F.col(at)
    ordered = steps.withColumn("_at", moment.cast("double"))
    return rank_within(ordered, [key], F.col("_at"), ["_at", *ties], out=out).drop("_at")


def fold_tool_results(steps: DataFrame, key: str = "analysis_id") -> DataFrame:
    """Confidence, status, total duration and tool count per analysis.

    ``steps``: step, status, confidence, duration_ms and optionally model_status. One tool
    gives its own confidence, more give the mean of those that completed.
    """
    done = (F.col("status") == "COMPLETED") & (F.col("confidence") > 0)
    states = F.col("model_status") if "model_status" in steps.columns else F.lit(None).cast("string")
    folded = steps.groupBy(key).agg(
        F.count("*").alias("tools"),
        F.max("confidence").alias("_one"),
        F.max("status").alias("_status"),
        F.avg(F.when(done, F.col("confidence"))).alias("_mean"),
        F.sum("duration_ms").alias("inference_time_ms"),
        F.max_by(states, F.when(states.isin(*REPORTED_STATES), F.col("step"))).alias("_state"),
    )
    single = F.when(F.col("_one") > 0, F.col("_one")).when(F.col("_status") == "COMPLETED", DEFAULT_CONFIDENCE).otherwise(0.0)
    confidence = F.when(F.col("tools") == 1, single).otherwise(F.coalesce("_mean", F.lit(DEFAULT_CONFIDENCE)))
    return folded.select(
        key, "tools", confidence.alias("confidence"), "inference_time_ms", F.coalesce("_state", F.lit("READY")).alias("model_status")
    )


def fold_all(analyses: DataFrame, steps: DataFrame, key: str = "analysis_id") -> DataFrame:
    """Fold results of every analysis; one without tools fails with confidence 0."""
    folded = analyses.select(key).join(fold_tool_results(steps, key), key, "left")
    return folded.fillna(0, ["tools", "inference_time_ms"]).fillna(0.0, ["confidence"]).fillna("FAILED", ["model_status"])


def first_seen(steps: DataFrame, value: str, key: str = "analysis_id", order: str = "step") -> DataFrame:
    """Distinct values per analysis in the order they first appear.

    Repeats are folded before the list is built, so the list holds distinct values only.
    """
    seen = steps.filter(F.col(value).isNotNull() & (F.col(value) != "")).groupBy(key, value).agg(F.min(order).alias("_at"))
    listed = F.sort_array(F.collect_list(F.struct("_at", value)))
    return seen.groupBy(key).agg(F.transform(listed, lambda s: s[value]).alias(f"{value}_list"))


def trace_rollup(steps: DataFrame, key: str = "analysis_id", model: str = "tool", fragment: str = "text") -> DataFrame:
    """Total duration, models in first-seen order and the joined distinct answer fragments."""
    total = steps.groupBy(key).agg(F.sum("duration_ms").alias("duration_ms"), F.count("*").alias("steps"))
    models = first_seen(steps, model, key).withColumnRenamed(f"{model}_list", "models_used")
    answers = first_seen(steps, fragment, key).select(key, F.array_join(f"{fragment}_list", " ").alias("answer"))
    return total.join(models, key, "left").join(answers, key, "left")


def warnings_of(steps: DataFrame, warnings: str = "warnings", key: str = "analysis_id") -> DataFrame:
    """All warnings of an analysis as rows, in step order; duplicates stay."""
    return steps.select(key, "step", F.posexplode(warnings).alias("position", "warning"))


def newest_first(history: DataFrame, at: str = "created_at", limit: int | None = None) -> DataFrame:
    """History ordered from the newest; with a limit only the top rows are sorted."""
    ordered = history.orderBy(F.col(at).desc(), F.col("analysis_id").desc())
    return ordered if limit is None else ordered.limit(limit)


def newest(history: DataFrame, value: str, at: str, key: Sequence[str] = ()) -> DataFrame:
    """Value of the newest row, overall or per key."""
    agg = F.max_by(value, F.struct(at, value)).alias(value)
    return history.groupBy(*key).agg(agg) if key else history.agg(agg)


def filter_history(history: DataFrame, task: str = "ALL", text: str = "") -> DataFrame:
    """Rows of a task (or ALL) whose query or location holds a text, ignoring case."""
    out = history if task == "ALL" else history.filter(F.col("task") == task)
    wanted = text.lower()
    return out.filter(F.lower("query").contains(wanted) | F.lower("location").contains(wanted))


def get_analysis(history: DataFrame, analysis_id) -> DataFrame:
    """The row of one analysis; KeyError when there is none."""
    found = history.filter(F.col("analysis_id") == analysis_id)
    if found.isEmpty():
        raise KeyError(f"analysis {analysis_id!r} not found")
    return found


def without_analysis(history: DataFrame, analysis_id) -> DataFrame:
    """History without one analysis, to be written as the next version; KeyError when it is absent."""
    get_analysis(history, analysis_id)
    return history.filter(F.col("analysis_id") != analysis_id)


def _evidence_line() -> Column:
    share = F.floor(F.col("confidence") * 100.0).cast("int")
    return F.format_string("| `%s` | %s | **%s** | %d%% | %s |", "evidence_id", "category", "title", share, "description")


def _trace_line() -> Column:
    tool = F.coalesce(F.nullif(F.col("tool"), F.lit("")), F.lit("System"))
    said = F.coalesce(F.nullif(F.col("output_summary"), F.lit("")), F.lit("-"))
    return F.format_string("| %d | %s | `%s` | %dms | %s |", "step", "name", tool, "duration_ms", said)


def render_reports(
    analyses: DataFrame,
    evidence: DataFrame,
    steps: DataFrame,
    fmt: str = "markdown",
    include_evidence: bool = True,
    include_trace: bool = True,
    notes: str | None = None,
) -> DataFrame:
    """analysis_id, content: one markdown or JSON report per analysis.

    ``analyses``: analysis_id, query, task, status, confidence, answer, models_used,
    execution_time_ms, created_at (text); ``evidence``: analysis_id, evidence_id, category,
    title, confidence, description; ``steps``: analysis_id, step, name, tool, duration_ms,
    output_summary. A report is one text by nature; only its own lines are gathered for it.
    """
    key = "analysis_id"
    if fmt == "json":
        ev = evidence.groupBy(key).agg(
            F.sort_array(F.collect_list(F.struct("evidence_id", "category", "title", "confidence", "description"))).alias("evidence")
        )
        tr = steps.groupBy(key).agg(
            F.sort_array(F.collect_list(F.struct("step", "name", "tool", "duration_ms", "output_summary"))).alias("execution_trace")
        )
        joined = analyses.join(ev, key, "left").join(tr, key, "left")

        body = F.struct(
            key, "created_at", "query", "task", "status", F.col("confidence").alias("calibrated_confidence"), "answer",
            F.coalesce(F.when(F.lit(include_evidence), F.col("evidence")), F.array()).alias("evidence"),
            F.coalesce(F.when(F.lit(include_trace), F.col("execution_trace")), F.array()).alias("execution_trace"),
            "models_used", "execution_time_ms",
            F.lit(notes or "Automated inference report.").alias("analyst_notes"),
        )
        return joined.select(key, F.to_json(body).alias("content"))
    if fmt != "markdown":
        raise ValueError(f"fmt must be 'markdown' or 'json', not {fmt!r}")

    def lines(rows: DataFrame, order: str, line: Column, out: str) -> DataFrame:
        listed = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("l"))))
        return rows.groupBy(key).agg(F.array_join(F.transform(listed, lambda s: s["l"]), "\n").alias(out))

    joined = analyses.join(lines(evidence, "evidence_id", _evidence_line(), "_ev"), key, "left").join(
        lines(steps, "step", _trace_line(), "_tr"), key, "left"
    )
    share = F.format_string("%d%%", F.floor(F.col("confidence") * 100.0).cast("int"))
    head = F.concat_ws(
        "\n",
        F.concat(F.lit("# Mission Report - "), F.col("task")),
        F.concat(F.lit("**Generated**: "), F.col("created_at"), F.lit(" | **Analysis ID**: `"), F.col(key).cast("string"), F.lit("`")),
        F.lit("\n---\n\n## 1. Executive Summary"),
        F.concat(F.lit('- **Query**: *"'), F.col("query"), F.lit('"*')),
        F.concat(F.lit("- **Identified Task**: `"), F.col("task"), F.lit("`")),
        F.concat(F.lit("- **Calibrated Confidence**: **"), share, F.lit("**")),
        F.concat(F.lit("- **Execution Latency**: `"), F.col("execution_time_ms").cast("string"), F.lit(" ms`")),
        F.concat(F.lit("- **Models Employed**: "), F.array_join("models_used", ", ")),
        F.lit("\n## 2. Findings"),
        F.concat(F.lit("> "), F.col("answer")),
    )
    sections = [head]
    if include_evidence:
        table = "\n## 3. Evidence\n| ID | Category | Feature Title | Confidence | Description |\n| :--- | :--- | :--- | :--- | :--- |\n"
        sections.append(F.when(F.col("_ev").isNotNull(), F.concat(F.lit(table), F.col("_ev"))))
    if include_trace:
        table = "\n## 4. Execution Trace\n| Step | Action | Tool | Duration | Output Summary |\n| :--- | :--- | :--- | :--- | :--- |\n"
        sections.append(F.when(F.col("_tr").isNotNull(), F.concat(F.lit(table), F.col("_tr"))))
    if notes:
        sections.append(F.lit(f"\n## 5. Analyst Annotations\n{notes}"))
    return joined.select(key, F.concat_ws("\n", *sections, F.lit("\n---")).alias("content"))
