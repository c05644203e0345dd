"""Writers of graphs, reports and result lines: each file's content is made by DataFrame functions and written by Spark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.stats import backfill_weights


def graph_documents(nodes: DataFrame, edges: DataFrame, by: str = "building", whole: bool = False) -> DataFrame:
    """(by, json): one document {nodes, edges} for each graph, in the order of `ord`.

    Columns of nodes but by, ord, x and y go into the node as they are, x and y as `position`; `whole` rounds them, as
    the client's export does. Distances and weights are filled in first; null fields are left out of the JSON.
    """
    number = (lambda c: F.floor(F.col(c) + 0.5).cast("long")) if whole else (lambda c: F.col(c).cast("double"))
    n = F.struct("id", "type", F.array(number("x"), number("y")).alias("position"), *[c for c in nodes.columns if c not in (by, "ord", "id", "type", "x", "y")])
    e = F.struct(F.col("src").alias("source"), F.col("dst").alias("target"), "weight", *[c for c in edges.columns if c not in (by, "ord", "src", "dst", "weight")])
    sorted_ = lambda s: F.transform(F.array_sort(F.collect_list(F.struct("ord", s.alias("v")))), lambda p: p["v"])
    a = nodes.groupBy(by).agg(sorted_(n).alias("nodes"))
    b = backfill_weights(edges).groupBy(by).agg(sorted_(e).alias("edges"))
    both = a.join(b, by, "left")
    empty = F.array().cast(b.schema["edges"].dataType)
    return both.select(by, F.to_json(F.struct("nodes", F.coalesce("edges", empty).alias("edges"))).alias("json"))


def view_documents(nodes: DataFrame, edges: DataFrame, by: str = "building") -> DataFrame:
    """(by, json): the view model {nodes: [{data, position}], edges: [{data}], layout} of view nodes and edges with `ord`."""
    n = F.struct(F.struct("id", "label", "type", "floor").alias("data"), F.struct("x", "y").alias("position"))
    e = F.struct(F.struct("id", "source", "target", "color").alias("data"))
    sorted_ = lambda s: F.transform(F.array_sort(F.collect_list(F.struct("ord", s.alias("v")))), lambda p: p["v"])
    b = edges.groupBy(by).agg(sorted_(e).alias("edges"))
    both = nodes.groupBy(by).agg(sorted_(n).alias("nodes")).join(b, by, "left")
    empty = F.array().cast(b.schema["edges"].dataType)
    return both.select(by, F.to_json(F.struct("nodes", F.coalesce("edges", empty).alias("edges"), F.lit("preset").alias("layout"))).alias("json"))


def write_documents(documents: DataFrame, path: str, by: str = "building", stage: str | None = None) -> None:
    """One text file in a folder of its own for each graph, under the stage's folder if one is given; what was there is replaced."""
    out = documents.select(F.col(by), F.col("json").alias("value"))
    keys = [by]
    if stage is not None:
        out, keys = out.withColumn("stage", F.lit(stage)), ["stage", by]
    out.repartition(*keys).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).text(path)


def box_lines(boxes: DataFrame, found: DataFrame) -> DataFrame:
    """(ord, line) of boxes (ord, bbox) with the text found for the same box, or none."""
    text = found.groupBy("bbox").agg(F.max_by("text", "ord").alias("text"))
    return boxes.select("ord", "bbox").join(text, "bbox", "left").select("ord", F.concat(F.array_join("bbox", ","), F.lit(" | "), F.coalesce("text", F.lit(""))).alias("line"))


def ocr_lines(found: DataFrame) -> DataFrame:
    """(ord, line) of results (ord, bbox, text, confidence)."""
    return found.select("ord", F.format_string("BBox %d: [%s], Text: %s, Confidence: %.4f", "ord", F.array_join("bbox", ", "), "text", "confidence").alias("line"))


def detection_lines(found: DataFrame) -> DataFrame:
    """(ord, line) of door detections (ord, x1, y1, x2, y2, score, label), a block of lines each."""
    return found.select("ord", F.format_string("Detection %d:\n  Bounding Box: [%d, %d, %d, %d]\n  Confidence Score: %.2f\n  Label: %d\n", F.col("ord") + 1, "x1", "y1", "x2", "y2", "score", "label").alias("line"))


def fill_lines(areas: DataFrame) -> DataFrame:
    """(Node_ID, Position, Filled_Area) of (id, x, y, area), for a tab-separated file with a heading."""
    return areas.select(F.col("id").alias("Node_ID"), F.format_string("(%s, %s)", F.col("x").cast("string"), F.col("y").cast("string")).alias("Position"), F.col("area").alias("Filled_Area"))


def write_table(df: DataFrame, path: str, sep: str = "\t") -> None:
    df.write.mode("overwrite").option("sep", sep).option("header", True).option("emptyValue", "").csv(path)


def write_lines(lines: DataFrame, path: str, append: bool = False) -> None:
    """Lines (ord, line) in their order, dealt by ranges; append adds to what is there, as a log does."""
    lines.orderBy("ord").select(F.col("line").alias("value")).write.mode("append" if append else "overwrite").text(path)


def room_property_documents(rooms: DataFrame) -> DataFrame:
    """(room, json) of (room, area, cx, cy, eq_radius, inradius, candidates): one object for each room."""
    p = F.struct(F.col("area").alias("area_px"), F.array("cx", "cy").alias("centroid_xy"), F.col("eq_radius").alias("eq_radius_px"), F.col("inradius").alias("inradius_px"), F.size("candidates").alias("num_candidates"))
    return rooms.select("room", F.to_json(F.create_map("room", p)).alias("json"))


def timing_lines(steps: DataFrame) -> DataFrame:
    """(ord, line) of steps (ord, stage, secs)."""
    return steps.select("ord", F.format_string("%s: %.2f seconds", "stage", "secs").alias("line"))


def timing_table(metrics: DataFrame, steps: DataFrame, names: list[str]) -> DataFrame:
    """Metrics of each file with a column for each step of `names`, and the image's area."""
    wide = steps.groupBy("file_name").pivot("step", names).agg(F.max("secs"))
    return metrics.join(wide, "file_name", "left").withColumn("image_area", (F.col("width").cast("long") * F.col("height")))


def heading(title: str, width: int) -> list[Column]:
    return [F.lit(title), F.lit("=" * width)]


def report(parts: list[tuple[list[Column] | None, DataFrame | None]]) -> DataFrame:
    """(ord, line): headings and lines (ord, line) of DataFrames, one part after the other."""
    out = None
    for i, (head, df) in enumerate(parts):
        place = lambda body, n: F.struct(F.lit(i).alias("part"), F.lit(body).alias("body"), F.col(n).cast("long").alias("n")).alias("ord")  # noqa: B023, E731
        rows = df.select(place(1, "ord"), "line")
        if head:
            top = df.sparkSession.range(1).select(F.posexplode(F.array(*head)).alias("n", "line")).select(place(0, "n"), "line")
            rows = top.unionByName(rows)
        out = rows if out is None else out.unionByName(rows)
    return out


def validation_report(issues: DataFrame) -> DataFrame:
    """(ord, line) of issues (level, code, detail): the status, then errors, then warnings."""
    bad = F.count(F.when(F.col("level") == "error", 1)) > 0
    status = issues.agg(F.concat(F.lit("Status: "), F.when(bad, "FAILED").otherwise("PASSED")).alias("line")).select(F.lit(0).alias("ord"), "line")
    listed = lambda level: issues.where(F.col("level") == level).select(F.xxhash64("code", "detail").alias("ord"), F.concat(F.lit("  - "), "code", F.lit(" "), F.coalesce("detail", F.lit(""))).alias("line"))
    return report([(heading("Mapping Validation Report", 50), status), ([F.lit("Errors:")], listed("error")), ([F.lit("Warnings:")], listed("warning"))])


def connectivity_report(components: DataFrame, pairs: DataFrame) -> DataFrame:
    """(ord, line) of components (comp, nodes) and, for each floor, sampled pairs (floor, connected)."""
    c = components.agg(F.count("*").alias("n"), F.coalesce(F.max("nodes"), F.lit(0)).alias("most"))
    lines = F.array(F.concat(F.lit("Fully Connected: "), F.when(F.col("n") == 1, "Yes").otherwise("No")), F.concat(F.lit("Connected Components: "), "n"), F.concat(F.lit("Largest Component: "), "most", F.lit(" nodes")))
    head = c.select(F.posexplode(lines).alias("ord", "line"))
    yes = F.count(F.when(F.col("connected"), 1))
    floors = pairs.groupBy("floor").agg(yes.alias("y"), (F.count("*") - yes).alias("n")).select(F.col("floor").alias("ord"), F.format_string("  Floor %d: %d connected, %d disconnected", "floor", "y", "n").alias("line"))
    return report([(heading("Connectivity Verification Report", 50), head), ([F.lit("Floor-wise Connectivity:")], floors)])


def mapping_report(links: DataFrame) -> DataFrame:
    """(ord, line) of inter-floor edges (src, dst, src_floor, tgt_floor) with ids."""
    good = links.where("src IS NOT NULL")
    total = good.agg(F.concat(F.lit("Total inter-floor connections: "), F.count("*")).alias("line")).select(F.lit(0).alias("ord"), "line")
    lines = good.select(F.xxhash64("src", "dst").alias("ord"), F.format_string("  %s - %s\n    Floors: %d - %d", "src", "dst", "src_floor", "tgt_floor").alias("line"))
    return report([(heading("Multi-Floor Connection Summary", 50), total), ([F.lit("Connections:")], lines)])


def timing_report(steps: DataFrame, files: DataFrame) -> DataFrame:
    """(ord, line) of steps (ord, step, secs) and of totals for each floor (floor, image, secs)."""
    from ..operators.boxes import title

    a = steps.select("ord", F.format_string("  %s: %.3f seconds", title(F.col("step")), "secs").alias("line"))
    b = files.select(F.col("floor").alias("ord"), F.format_string("  Floor %d (%s):\n    Total: %.2f seconds", "floor", "image", "secs").alias("line"))
    total = steps.agg(F.coalesce(F.sum("secs"), F.lit(0.0)).alias("t")).select(F.lit(0).alias("ord"), F.format_string("TOTAL PROCESSING TIME: %.2f seconds", "t").alias("line"))
    return report([(heading("Multi-Floor Processing Timing Report", 60), a), ([F.lit("PER-FLOOR PROCESSING TIMES:")], b), (None, total)])
