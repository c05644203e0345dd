"""Readers of the graph, box, label, timing and mapping files, as DataFrames of declared schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import MAPPING_LINE

#: The fields of graph files.
GRAPH_SCHEMA = "nodes ARRAY<STRUCT<id STRING, type STRING, position ARRAY<DOUBLE>, floor STRING, pixels ARRAY<STRING>>>, edges ARRAY<STRUCT<source STRING, target STRING, weight DOUBLE, distance DOUBLE>>"
#: Lines of a timing log.
STEP_LINE = r"(?i)([A-Za-z &]+? check):\s*([\d.]+)\s*seconds"
METRICS = {"width": (r"Image Dimensions:\s*(\d+)\s*[xX]\s*(\d+)", 1, "int"), "height": (r"Image Dimensions:\s*(\d+)\s*[xX]\s*(\d+)", 2, "int"), "total_time": (r"Total Time:\s*([\d.]+)\s*seconds", 1, "double"), "nodes_before": (r"Total graph nodes \(before pruning\):\s*(\d+)", 1, "double"), "nodes_after": (r"Total graph nodes \(after pruning\):\s*(\d+)", 1, "double"), "json_size_before_kb": (r"JSON File Size \(before pruning\):\s*([\d.,]+)\s*KB", 1, "double"), "json_size_after_kb": (r"JSON File Size \(after pruning\):\s*([\d.,]+)\s*KB", 1, "double")}


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of graph files; ord is the place in the file; unknown types become rooms."""
    raw = spark.read.schema(GRAPH_SCHEMA).option("multiLine", True).json(path).select(F.input_file_name().alias("file"), "nodes", "edges")
    n = raw.select("file", F.posexplode("nodes").alias("ord", "n"))
    kind = F.when(F.col("n.type").isin("room", "door", "corridor", "outside", "transition"), F.col("n.type")).otherwise("room")
    nodes = n.select("file", "ord", F.col("n.id").alias("id"), kind.alias("type"), F.get("n.position", F.lit(0)).alias("x"), F.get("n.position", F.lit(1)).alias("y"), F.col("n.floor").alias("floor"))
    e = raw.select("file", F.posexplode("edges").alias("ord", "e"))
    edges = e.select("file", "ord", F.least("e.source", "e.target").alias("src"), F.greatest("e.source", "e.target").alias("dst"), "e.weight", "e.distance")
    return nodes, edges


def read_text_boxes(spark: SparkSession, path: str) -> DataFrame:
    line = F.split(F.col("value"), r" \| ", 2)
    return spark.read.text(path).where("trim(value) <> ''").select(F.transform(F.split(line[0], ","), lambda x: F.trim(x).cast("int")).alias("bbox"), F.get(line, F.lit(1)).alias("text"))


def parse_mapping(lines: DataFrame) -> DataFrame:
    """(line_no, ok, src_floor, src_image, src_node, tgt_floor, tgt_image, tgt_node) of lines that are no comments; ok says whether the line parses."""
    t = F.trim("line")
    part = lambda i: F.regexp_extract(t, MAPPING_LINE, i)
    some = lines.where((t != "") & ~t.startswith("#"))
    ok = t.rlike(MAPPING_LINE)
    text = lambda i: F.when(ok, F.trim(part(i)))
    return some.select("line_no", ok.alias("ok"), part(1).try_cast("long").alias("src_floor"), text(2).alias("src_image"), text(3).alias("src_node"), part(4).try_cast("long").alias("tgt_floor"), text(5).alias("tgt_image"), text(6).alias("tgt_node"))


def timer_metrics(files: DataFrame) -> DataFrame:
    """One row for each (file_name, content); missing values are null."""
    get = lambda p, i, t: F.replace(F.regexp_extract("content", "(?i)" + p, i), F.lit(","), F.lit("")).try_cast(t)
    out = {c: get(p, i, t) for c, (p, i, t) in METRICS.items()}
    # a total without its unit, where no total has one
    out["total_time"] = F.coalesce(out["total_time"], get(r"Total Time:\s*([\d.]+)", 1, "double"))
    return files.select("file_name", *[v.alias(c) for c, v in out.items()])


def timer_steps(files: DataFrame, least: float = 1.0) -> DataFrame:
    """(file_name, step, secs) of steps over `least` seconds."""
    both = F.arrays_zip(F.regexp_extract_all("content", F.lit(STEP_LINE), F.lit(1)).alias("s"), F.regexp_extract_all("content", F.lit(STEP_LINE), F.lit(2)).alias("v"))
    return files.select("file_name", F.explode(both).alias("x")).select("file_name", F.trim("x.s").alias("step"), F.col("x.v").try_cast("double").alias("secs")).where(F.col("secs") > least)


def timer_keyvalue(lines: DataFrame) -> DataFrame:
    """(k, key, value): the part before the first colon, and the seconds or else the first number after it."""
    t = F.trim("line")
    key, value = F.trim(F.regexp_extract(t, r"^([^:]*):(.*)$", 1)), F.trim(F.regexp_extract(t, r"^([^:]*):(.*)$", 2))
    secs = F.trim(F.replace(value, F.lit("seconds"), F.lit(""))).try_cast("double")
    number = F.regexp_extract(value, r"(\d+(?:\.\d+)?)", 1).try_cast("double")
    out = lines.where(~t.contains("=") & t.contains(":")).select("k", key.alias("key"), F.when(F.lower(value).contains("seconds"), secs).otherwise(number).alias("value"))
    return out.where("value is not null")
