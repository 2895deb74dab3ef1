"""Source trees, notebooks, configuration and text bundles as DataFrames; files out of responses.

Listing, filtering and joining are Spark's; Python runs only where a grammar has to be read.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Suffixes of the files that a bundle holds (fixed values).
BUNDLED = ("py", "yaml", "yml", "json", "toml", "cfg", "txt", "md")
SKIPPED = r"(^|/)(\.venv|node_modules|__[^/]*)(/|$)"


def files(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """path (below the root) and content of all files whose names match."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    below = F.regexp_replace(F.regexp_replace("path", r"^[a-z]+:(//[^/]*)?", ""), f"^{'/' + root.split('://')[-1].strip('/')}/", "")
    return rows.select(below.alias("path"), "content")


def python_files(spark: SparkSession, root: str) -> DataFrame:
    """path, source of Python files whose names do not start with two underscores."""
    return files(spark, root, "*.py").where(~F.col("path").rlike(r"(^|/)__[^/]*$")).select("path", F.try_to_binary(F.hex("content"), F.lit("hex")).cast("string").alias("source"))


def notebooks(spark: SparkSession, root: str, drop_magics: bool = False) -> DataFrame:
    """path, source: code cells joined by a blank line; lines that start with % or ! may be dropped with empty cells."""
    schema = "cells array<struct<cell_type:string,source:variant>>"
    rows = spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.ipynb").json(root)
    keep = (lambda line: ~line.rlike(r"^\s*[%!]")) if drop_magics else (lambda line: F.lit(True))
    lines = F.expr("transform(filter(cells, c -> c.cell_type = 'code'), c -> if(schema_of_variant(c.source) = 'STRING', split(try_variant_get(c.source, '$', 'string'), '(?<=\\\\n)'), try_variant_get(c.source, '$', 'array<string>')))")
    cells = F.transform(lines, lambda x: F.array_join(F.filter(x, keep), ""))
    cells = F.filter(cells, lambda c: F.trim(c) != "") if drop_magics else cells
    return rows.select(F.col("_metadata.file_path").alias("path"), F.array_join(cells, "\n\n").alias("source"))


def yaml_entries(spark: SparkSession, root: str) -> DataFrame:
    """path, key, fields of the mapping in each YAML file; values that are not text are written as YAML."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import yaml

        for f in frames:
            out = []
            for path, content in zip(f.path, f.content, strict=True):
                data = yaml.safe_load(bytes(content).decode()) or {}
                for key, value in data.items() if isinstance(data, dict) else ():
                    fields = value if isinstance(value, dict) else {"value": value}
                    out.append((path, str(key), {str(k): v if isinstance(v, str) else yaml.safe_dump(v).removesuffix("\n...\n").strip() for k, v in fields.items()}))
            yield pd.DataFrame(out, columns=["path", "key", "fields"])

    return files(spark, root, "*.{yaml,yml}").mapInPandas(run, "path string, key string, fields map<string,string>")


def bundle(spark: SparkSession, root: str, group_depth: int = 1) -> DataFrame:
    """group, text: the text files of each directory at a depth, in order, under lines that name them."""
    rows = files(spark, root).where(F.regexp_extract("path", r"\.([A-Za-z]+)$", 1).isin(*BUNDLED) & ~F.col("path").rlike(SKIPPED))
    rows = rows.select(F.array_join(F.slice(F.split("path", "/"), 1, group_depth), "/").alias("group"), "path", F.col("content").cast("string").alias("body")).where(F.expr("is_valid_utf8(body)"))
    parts = F.array_sort(F.collect_list(F.struct("path", F.concat(F.lit("--- "), "path", F.lit(" ---\n"), "body").alias("said"))))
    return rows.groupBy("group").agg(F.array_join(F.transform(parts, lambda x: x["said"]), "\n\n").alias("text"))


def skeleton(spark: SparkSession, root: str, group_depth: int = 1) -> DataFrame:
    """group, text: the Python files of each directory at a depth, in order, fenced under lines that name them."""
    rows = files(spark, root, "*.py").where(~F.col("path").rlike(r"(^|/)__pycache__(/|$)"))
    rows = rows.select(F.array_join(F.slice(F.split("path", "/"), 1, group_depth), "/").alias("group"), "path", F.col("content").cast("string").alias("body")).where(F.expr("is_valid_utf8(body)"))
    said = F.concat(F.lit("--- "), "path", F.lit(" ---\n```python\n"), "body", F.lit("\n```"))
    parts = F.array_sort(F.collect_list(F.struct("path", said.alias("said"))))
    return rows.groupBy("group").agg(F.array_join(F.transform(parts, lambda x: x["said"]), "\n\n").alias("text"))


def fixtures(listing: DataFrame) -> DataFrame:
    """name, path of the Turtle files at the top."""
    return listing.where(F.col("path").rlike(r"^[^/]+\.ttl$")).select(F.regexp_replace("path", r"\.ttl$", "").alias("name"), "path").orderBy("name")


def extractions(listing: DataFrame) -> DataFrame:
    """framework, name, path of earlier extractions: framework/name/extracted.ttl."""
    parts = F.split("path", "/")
    return listing.where(F.col("path").rlike(r"^[^/]+/[^/]+/extracted\.ttl$")).select(parts[0].alias("framework"), parts[1].alias("name"), "path").orderBy("framework", "name")


def source_root(listing: DataFrame, depth: int = 1) -> DataFrame:
    """example, root: where the sources of each example (a directory at a depth) are: source_files below it, or itself."""
    parts = F.split("path", "/")
    rows = listing.where(F.size(parts) > depth).select(F.array_join(F.slice(parts, 1, depth), "/").alias("example"), (F.try_element_at(parts, F.lit(depth + 1)) == "source_files").alias("below"), F.size(parts).alias("n"))
    found = rows.groupBy("example").agg(F.bool_or(F.col("below") & (F.col("n") > depth + 1)).alias("below"))
    return found.select("example", F.when(F.col("below"), F.concat("example", F.lit("/source_files"))).otherwise(F.col("example")).alias("root"))


def default_namespace(name: Column) -> Column:
    return F.concat(F.lit("http://example.org/"), F.translate(name, "-", "_"), F.lit("#"))


def default_system_name(name: Column) -> Column:
    return F.translate(name, "-", "_")


def corpora(listing: DataFrame) -> DataFrame:
    """family, framework, has_source, has_truth, ready of paths family/framework/..."""
    rows = listing.select(F.split("path", "/").alias("p")).where(F.size("p") >= 3)
    found = rows.groupBy(F.col("p")[0].alias("family"), F.col("p")[1].alias("framework")).agg(F.max(F.col("p")[2] == "source_files").alias("has_source"), F.max(F.col("p")[2] == "ground_truth.ttl").alias("has_truth"))
    return found.withColumn("ready", F.col("has_source") & F.col("has_truth"))


def examples(listing: DataFrame) -> DataFrame:
    """Directories that hold a Python file or a notebook."""
    return listing.where(F.col("path").rlike(r"\.(py|ipynb)$")).select(F.split("path", "/")[0].alias("example")).distinct()


def response_files(responses: DataFrame) -> DataFrame:
    """id, path, content of fenced files in a response; without any the whole is raw_output.txt.

    A path loses its leading slashes and every step upwards."""
    pattern = r"(?s)---\s*([^\n]+?)\s*---\s*\n```[^\n]*\n(.*?)```"
    found = responses.select("id", "text", F.regexp_extract_all("text", F.lit(pattern), 1).alias("paths"), F.regexp_extract_all("text", F.lit(pattern), 2).alias("bodies"))
    rows = found.select("id", F.explode(F.arrays_zip("paths", "bodies")).alias("f"))
    clean = F.array_join(F.filter(F.split("f.paths", "/"), lambda p: ~p.isin("", ".", "..")), "/")
    raw = found.where(F.size("paths") == 0).select("id", F.lit("raw_output.txt").alias("path"), F.col("text").alias("content"))
    return rows.select("id", clean.alias("path"), F.col("f.bodies").alias("content")).unionByName(raw)


def response_turtle(responses: DataFrame) -> DataFrame:
    """id, text: the first fenced block, or the whole response."""
    block = F.regexp_extract("text", r"(?s)```[A-Za-z]*\s*\n(.*?)```", 1)
    return responses.select("id", F.coalesce(F.nullif(block, F.lit("")), "text").alias("text"))


def write_files(rows: DataFrame, root: str) -> None:
    """Write (path, content) rows as files under a folder that all executors share."""

    def put(part) -> None:
        for r in part:
            target = os.path.join(root, *[p for p in r.path.split("/") if p not in ("", ".", "..")])
            os.makedirs(os.path.dirname(target), exist_ok=True)
            with open(target, "w", encoding="utf-8") as f:
                f.write(r.content or "")

    rows.select("path", "content").foreachPartition(put)
