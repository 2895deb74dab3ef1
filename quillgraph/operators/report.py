"""Flat metric rows and their CSV, Markdown and JSON forms."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEADING = ("pipeline", "example", "framework", "target")


def flattened(runs: DataFrame, metrics: dict[str, DataFrame]) -> DataFrame:
    """A wide row a run: the runs' columns, every metric's columns with its name before, errors last.

    A run that a metric lacks has nulls there. runs: run_id, the leading columns, errors (array)."""
    out = runs.withColumn("_errors", F.concat_ws(" | ", "errors")).drop("errors")
    for name, df in metrics.items():
        out = out.join(df.select("run_id", *[F.col(c).alias(f"{name}_{c}") for c in df.columns if c != "run_id"]), "run_id", "left")
    lead = [c for c in LEADING if c in out.columns]
    rest = [c for c in out.columns if c not in (*lead, "run_id", "_errors")]
    return out.select("run_id", *lead, *rest, F.col("_errors").alias("errors"))


def united(parts: list[DataFrame]) -> DataFrame:
    """Rows of several pipelines with the union of their columns, errors last."""
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return out.select(*[c for c in out.columns if c != "errors"], *(["errors"] if "errors" in out.columns else []))


def shown(c: str, kind: str) -> Column:
    """A cell: numbers to three places, a dash for null."""
    text = F.when(F.col(c).isNotNull(), F.format_string("%.3f", F.col(c))) if kind in ("double", "float") else F.col(c).cast("string")
    return F.coalesce(text, F.lit("—"))


def markdown(rows: DataFrame, order: list[str]) -> DataFrame:
    """line: a Markdown table of the rows, header first."""
    columns = [c for c in rows.columns if c != "run_id"]
    spark = rows.sparkSession
    head = spark.createDataFrame([(0, f"| {' | '.join(columns)} |"), (1, f"|{'---|' * len(columns)}")], "n long, line string")
    kinds = dict(rows.dtypes)
    body = rows.orderBy(*order).select(F.concat(F.lit("| "), F.concat_ws(" | ", *[shown(c, kinds[c]) for c in columns]), F.lit(" |")).alias("line"))
    body = body.withColumn("n", F.monotonically_increasing_id() + 2).select("n", "line")
    return head.unionByName(body).orderBy("n").select("line")


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).csv(path)


def write_json(rows: DataFrame, path: str) -> None:
    rows.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)


def write_markdown(rows: DataFrame, path: str, order: list[str]) -> None:
    markdown(rows, order).coalesce(1).write.mode("overwrite").text(path)


def run_reports(runs: DataFrame, steps: DataFrame, metrics: DataFrame) -> DataFrame:
    """run_id, text: a Markdown report of each run: what it read, its steps in order, and a block a metric.

    runs: run_id, pipeline, framework, example, source_dir, work_dir, target_framework; steps: run_id, ord, step,
    ok, output, error; metrics: run_id, ord, name, values (map of texts). What is null shows as ?; a target
    that is the framework itself is not named; a run without steps or metrics has no such part."""
    told = lambda c: F.coalesce(c, F.lit("?"))
    line = F.concat(F.lit("- `"), told("step"), F.lit("` "), F.when(F.coalesce("ok", F.lit(False)), "✓").otherwise("✗"), F.lit(" "), F.coalesce(F.nullif("output", F.lit("")), "error", F.lit("")), F.lit("\n"))
    listed = lambda rows, text: rows.groupBy("run_id").agg(F.array_join(F.expr("transform(array_sort(collect_list(struct(ord, line))), x -> x.line)"), "").alias(text))
    done = listed(steps.select("run_id", "ord", line.alias("line")), "done")
    keys = F.array_sort(F.map_keys("values"))
    values = F.array_join(F.transform(keys, lambda k: F.concat(F.lit("- "), k, F.lit(": "), F.coalesce(F.element_at("values", k), F.lit("—")), F.lit("\n"))), "")
    blocks = listed(metrics.select("run_id", "ord", F.concat(F.lit("## "), told("name"), F.lit("\n"), values, F.lit("\n")).alias("line")), "blocks")
    r = runs.join(done, "run_id", "left").join(blocks, "run_id", "left")
    target = F.when(F.col("target_framework") != told("framework"), F.concat(F.lit("- target framework: `"), "target_framework", F.lit("`\n")))
    return r.select("run_id", F.concat(
        F.lit("# "), F.initcap(told("pipeline")), F.lit(" — "), told("framework"), F.lit("/"), told("example"), F.lit("\n\n- source: `"), told("source_dir"), F.lit("`\n"), F.coalesce(target, F.lit("")),
        F.lit("- work dir: `"), told("work_dir"), F.lit("`\n\n"), F.coalesce(F.concat(F.lit("## Pipeline\n"), "done", F.lit("\n")), F.lit("")), F.coalesce("blocks", F.lit("")),
    ).alias("text"))


def clean_runs(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count_if(F.coalesce("errors", F.lit("")) == "").alias("clean"), F.count(F.lit(1)).alias("runs"))


def head_of(items: Column, most: int = 10) -> Column:
    return F.slice(items, 1, most)


def clipped(text: Column, most: int) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("…"))).otherwise(text)


def metrics_json(metrics: DataFrame) -> DataFrame:
    """pair_id, report: all columns of a pair as one JSON text."""
    return metrics.select("pair_id", F.to_json(F.struct(*[c for c in metrics.columns if c != "pair_id"])).alias("report"))


def text_report(rows: DataFrame, key: str) -> DataFrame:
    """key, text: a block for each row, a line for each of its other columns, numbers to three places."""
    kinds = dict(rows.dtypes)
    lines = [F.concat(F.lit(f"  {c}: "), shown(c, kinds[c])) for c in rows.columns if c != key]
    return rows.select(key, F.concat_ws("\n", F.concat(F.lit("== "), F.col(key).cast("string"), F.lit(" ==")), *lines).alias("text"))


def latest(listing: DataFrame, most: int = 10) -> DataFrame:
    """The reports last changed, newest first. listing: path, modified."""
    return listing.orderBy(F.desc("modified"), "path").limit(most)
