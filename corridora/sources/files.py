"""Images, listings and result files as DataFrames."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import TRANSITIONS

#: The text forms of result files.
OCR_LINE = r"(?i)^BBox\s+(\d+):\s*\[([^\]]+)\]\s*,\s*Text:\s*([^\s,]+)"
CONFIDENCE = r"(?i)Confidence:\s*([\d.]+)"
#: What a stage's graph file ends with, the most finished stage first.
STAGES = {"post": "_post_pruning.json", "pre": "_pre_pruning.json", "final": "_final_graph.json"}
IMAGES, MASKS, TEXTS = ["jpg", "jpeg", "gif", "png", "pgm"], ["bmp"], ["xml", "gt", "txt"]


# ---- images


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """(path, height, width, channels, data) of image files; data is BGR, or gray, row by row."""
    i = spark.read.format("image").option("dropInvalid", True).load(path)
    return i.select(F.col("image.origin").alias("path"), F.col("image.height").alias("height"), F.col("image.width").alias("width"), F.col("image.nChannels").alias("channels"), F.col("image.data").alias("data"))


def _pixels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, h, w, n, data in zip(*(c.to_pylist() for c in batch.columns)):
            cells = np.frombuffer(data, np.uint8).reshape(h * w, n)
            b, g, r = (cells[:, min(k, n - 1)] for k in range(3)) if n >= 3 else (cells[:, 0],) * 3
            for lo in range(0, h * w, 1 << 18):
                at = np.arange(lo, min(lo + (1 << 18), h * w))
                cols = [pa.array(np.full(len(at), 0), pa.int32()), *(pa.array(v, pa.int32()) for v in (at // w, at % w, r[at].astype(int), g[at].astype(int), b[at].astype(int)))]
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(at), pa.string()), *cols[1:]], names=["path", "y", "x", "r", "g", "b"])


def pixels(images: DataFrame) -> DataFrame:
    """(path, y, x, r, g, b) of read_images(): gray images have three equal channels, a fourth channel is left out."""
    return images.select("path", "height", "width", "channels", "data").mapInArrow(_pixels, "path string, y int, x int, r int, g int, b int")


def image_metadata(spark: SparkSession, path: str) -> DataFrame:
    """(path, width, height, kb): sizes of the images and of their files."""
    files = spark.read.format("binaryFile").load(path).select("path", (F.col("length") / 1024.0).alias("kb"))
    name = lambda c: F.substring_index(c, "/", -1)
    seen = read_images(spark, path).select(name(F.col("path")).alias("_n"), "width", "height")
    return files.join(seen, name(F.col("path")) == F.col("_n")).select("path", "width", "height", "kb")


# ---- listings


def listed(paths: DataFrame, prefix: str = "", suffix: str = "") -> DataFrame:
    """(path, name) of paths whose file name has the prefix and the suffix, in the order of the names."""
    name = F.substring_index("path", "/", -1)
    return paths.select("path", name.alias("name")).where(F.col("name").startswith(prefix) & F.col("name").endswith(suffix)).orderBy("name", "path")


def graph_paths(paths: DataFrame) -> DataFrame:
    """(image, post, pre, final) of paths (image, path): the graph file of each stage, null where there is none."""
    stage = F.lit(None).cast("string")
    for name, end in STAGES.items():
        stage = F.when(F.col("path").endswith(end), name).otherwise(stage)
    found = paths.withColumn("_s", stage).where("_s IS NOT NULL")
    return found.groupBy("image").pivot("_s", list(STAGES)).agg(F.min("path"))


def graph_path(paths: DataFrame) -> DataFrame:
    """(image, path, stage): the file of the most finished stage of each image."""
    rank = F.coalesce(*[F.when(F.col(s).isNotNull(), F.struct(F.col(s).alias("path"), F.lit(s).alias("stage"))) for s in STAGES])
    return graph_paths(paths).select("image", rank.alias("b")).select("image", "b.path", "b.stage")


def cached(requests: DataFrame, paths: DataFrame) -> DataFrame:
    """(image, path): the result of each requested image, null where it must be made."""
    return requests.join(graph_path(paths).select("image", "path"), "image", "left")


def by_extension(paths: DataFrame) -> DataFrame:
    """(path, stem, kind): image, mask, text or archive, by the extension; others are left out."""
    ext = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    kind = F.when(ext.isin(IMAGES), "image").when(ext.isin(MASKS), "mask").when(ext.isin(TEXTS), "text").when(ext == "zip", "archive")
    return paths.select("path", F.regexp_replace(F.substring_index("path", "/", -1), r"\.[^.]*$", "").alias("stem"), kind.alias("kind")).where("kind IS NOT NULL")


def natural_key(name: Column) -> list[Column]:
    """Keys that sort names by their text, with the first number in them as a number."""
    return [F.regexp_extract(name, r"^(\D*)", 1), F.regexp_extract(name, r"(\d+)", 1).try_cast("long"), name]


def balanced_sample(rows: DataFrame, by: str, order: str, shares: dict[str, int]) -> DataFrame:
    """As many of the first rows of each source as its share of a batch says; a source without a share gives none."""
    number = F.row_number().over(Window.partitionBy(by).orderBy(order))
    wanted = F.lit(0)
    for name, n in shares.items():
        wanted = F.when(F.col(by) == name, n).otherwise(wanted)
    return rows.where(F.col(by).isin(list(shares))).withColumn("n", number).where(F.col("n") <= wanted)


# ---- text


def decoded(data: Column) -> Column:
    """Bytes as text: UTF-8, or else UTF-16, or else Latin-1, which always fits."""
    return F.coalesce(F.try_validate_utf8(data.cast("string")), F.when((F.octet_length(data) % 2 == 0) & F.substring(data, 1, 2).isin(F.unhex(F.lit("FFFE")), F.unhex(F.lit("FEFF"))), F.decode(data, "UTF-16")), F.decode(data, "ISO-8859-1"))


def read_text_tolerant(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of whole files."""
    return spark.read.format("binaryFile").load(path).select("path", decoded(F.col("content")).alias("content"))


def ocr_lines(lines: DataFrame) -> DataFrame:
    """(idx, bbox, text, confidence) of the lines (line) that name a box."""
    part = lambda i: F.regexp_extract("line", OCR_LINE, i)
    box = F.transform(F.split(part(2), ","), lambda v: F.trim(v).try_cast("int"))
    return lines.where(F.col("line").rlike(OCR_LINE)).select(part(1).try_cast("int").alias("idx"), box.alias("bbox"), part(3).alias("text"), F.regexp_extract("line", CONFIDENCE, 1).try_cast("double").alias("confidence"))


def alias_of(text: Column) -> Column:
    """stairs or elevator for the words that stand for them, else null."""
    return F.element_at(F.create_map(*[F.lit(v) for pair in TRANSITIONS.items() for v in pair]), F.lower(text))


def transition_labels(lines: DataFrame) -> DataFrame:
    """(bbox, label) of lines with a word for a vertical link; the last line of a box counts."""
    found = lines.where(F.col("line").rlike(OCR_LINE))
    read = ocr_lines(found.select("line", *([] if "k" not in lines.columns else ["k"])))
    return read.select("idx", "bbox", alias_of(F.col("text")).alias("label")).where("label IS NOT NULL AND NOT exists(bbox, v -> v IS NULL)").groupBy("bbox").agg(F.max_by("label", "idx").alias("label"))


def inline_mapping(text: DataFrame) -> DataFrame:
    """(line_no, line) of `;`-separated links (id, text); parse_mapping reads them, and pieces that do not parse go."""
    return text.select("id", F.posexplode(F.split("text", ";")).alias("line_no", "line")).where("trim(line) <> ''")


def text_boxes(lines: DataFrame) -> DataFrame:
    """(line_no, bbox, text, error) of lines `x1,y1,..` or `x1,y1,.. | text`: error is the line, where it is no box."""
    some = lines.where("trim(line) <> ''")
    cut = F.split(F.col("line"), r" \| ", 2)
    box = F.transform(F.split(cut[0], ","), lambda v: F.trim(v).try_cast("int"))
    bad = F.exists(box, lambda v: v.isNull())
    return some.select("line_no", F.when(~bad, box).alias("bbox"), F.when(~bad, F.get(cut, F.lit(1))).alias("text"), F.when(bad, F.col("line")).alias("error"))


_NUMBER = r"(?:np\.\w+\()?(-?[\d.]+)\)?"


def detections(files: DataFrame) -> DataFrame:
    """(path, det, x1, y1, x2, y2, score, label) of door detection reports (path, content); numbers may be wrapped in a type's name."""
    block = F.explode(F.filter(F.split("content", r"(?m)^Detection "), lambda b: b.rlike(r"^\d+:")))
    b = files.select("path", block.alias("b"))
    nums = F.transform(F.regexp_extract_all(F.regexp_extract("b", r"Bounding Box:\s*\[([^\]]*)\]", 1), F.lit(_NUMBER), F.lit(1)), lambda v: v.try_cast("double").cast("int"))
    get = lambda i: F.get(nums, F.lit(i))
    return b.select("path", F.regexp_extract("b", r"^(\d+):", 1).cast("int").alias("det"), get(0).alias("x1"), get(1).alias("y1"), get(2).alias("x2"), get(3).alias("y2"), F.regexp_extract("b", r"Confidence Score:\s*([\d.]+)", 1).try_cast("double").alias("score"), F.regexp_extract("b", r"Label:\s*(\d+)", 1).try_cast("int").alias("label"))


def fill_areas(lines: DataFrame) -> DataFrame:
    """(node_id, x, y, filled_area) of tab-separated lines, without the heading."""
    part = F.split(F.col("line"), "\t")
    nums = F.regexp_extract_all(F.get(part, F.lit(1)), F.lit(_NUMBER), F.lit(1))
    rows = lines.where((F.size(part) == 3) & ~F.col("line").startswith("Node_ID"))
    return rows.select(F.get(part, F.lit(0)).alias("node_id"), F.get(nums, F.lit(0)).try_cast("double").alias("x"), F.get(nums, F.lit(1)).try_cast("double").alias("y"), F.trim(F.get(part, F.lit(2))).try_cast("long").alias("filled_area"))


def read_room_properties(spark: SparkSession, path: str) -> DataFrame:
    """(file, room, area_px, centroid_xy, eq_radius_px, inradius_px, num_candidates) of JSON objects keyed by room."""
    kind = "MAP<STRING, STRUCT<area_px: BIGINT, centroid_xy: ARRAY<DOUBLE>, eq_radius_px: DOUBLE, inradius_px: DOUBLE, num_candidates: INT>>"
    whole = spark.read.option("wholetext", True).text(path).select(F.input_file_name().alias("file"), F.from_json("value", kind).alias("m"))
    return whole.select("file", F.explode("m").alias("room", "p")).select("file", "room", "p.*")
