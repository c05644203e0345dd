"""Readers and writers, on files made here; streams."""

import json
import struct
import zlib

from pyspark.sql import functions as F

from corridora.operators import masks
from corridora.sinks import writers
from corridora.sources import files, readers
from corridora.streaming import stages


def png(path, rows, kind):
    """An 8-bit image file; kind 0: gray, 2: RGB, 6: RGB with a fourth channel."""
    chunk = lambda name, data: struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))
    raw = b"".join(b"\0" + bytes(v for px in row for v in px) for row in rows)
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", len(rows[0]), len(rows), 8, kind, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def test_images(spark, tmp_path):
    colour = [[(255, 204, 102), (0, 0, 0), (1, 2, 3)], [(255, 255, 255), (9, 8, 7), (4, 5, 6)]]
    png(tmp_path / "a.png", colour, 2)
    png(tmp_path / "b.png", [[(7,), (200,)]], 0)
    png(tmp_path / "c.png", [[(1, 2, 3, 255)]], 6)
    images = files.read_images(spark, str(tmp_path))
    got = {(r.path[-5:], r.y, r.x): (r.r, r.g, r.b) for r in files.pixels(images).collect()}
    want = {("a.png", y, x): px for y, row in enumerate(colour) for x, px in enumerate(row)}
    assert got == want | {("b.png", 0, 0): (7, 7, 7), ("b.png", 0, 1): (200, 200, 200), ("c.png", 0, 0): (1, 2, 3)}
    sizes = {r.path[-5:]: (r.width, r.height, r.kb > 0) for r in files.image_metadata(spark, str(tmp_path)).collect()}
    assert sizes == {"a.png": (3, 2, True), "b.png": (2, 1, True), "c.png": (1, 1, True)}


def test_tolerant_text(spark, tmp_path):
    for name, data in {"u8": "é1".encode(), "u16": "é2".encode("utf-16"), "l1": "é3".encode("latin-1")}.items():
        (tmp_path / name).write_bytes(data)
    assert {r.path[-2:]: r.content for r in files.read_text_tolerant(spark, str(tmp_path)).collect()} == {"u8": "é1", "16": "é2", "l1": "é3"}


def test_graph_is_written_and_read_again(spark, tmp_path):
    nodes = spark.createDataFrame([(1, 1, "room_1", "room", 3.0, 4.0, "2"), (1, 0, "outside_main_1", "odd", 0.0, 0.5, None), (2, 0, "alone", "door", 1.0, 1.0, "1")], "building long, ord long, id string, type string, x double, y double, floor string")
    edges = spark.createDataFrame([(1, 0, "room_1", "outside_main_1", 1.0, 5.0), (1, 1, "room_1", "x", 7.0, 2.0)], "building long, ord long, src string, dst string, weight double, distance double")
    path = str(tmp_path / "graphs")
    for stage in ("ini", "final", "final"):
        writers.write_documents(writers.graph_documents(nodes, edges), path, stage=stage)
    assert sorted(p.name for p in (tmp_path / "graphs").iterdir() if p.is_dir()) == ["stage=final", "stage=ini"]
    n, e = readers.read_graph(spark, f"{path}/stage=final/building=1")
    # the place in the file is the order; an unknown type is read as a room; a weight of 1 was the distance
    assert [(r.ord, r.id, r.type, r.x, r.y, r.floor) for r in n.orderBy("ord").collect()] == [(0, "outside_main_1", "room", 0.0, 0.5, None), (1, "room_1", "room", 3.0, 4.0, "2")]
    assert [(r.src, r.dst, r.weight, r.distance) for r in e.orderBy("ord").collect()] == [("outside_main_1", "room_1", 5.0, 5.0), ("room_1", "x", 7.0, 2.0)]
    alone = json.loads(next((tmp_path / "graphs" / "stage=ini" / "building=2").glob("*.txt")).read_text())
    assert alone == {"nodes": [{"id": "alone", "type": "door", "position": [1.0, 1.0], "floor": "1"}], "edges": []}


def test_result_lines(spark, tmp_path):
    found = spark.createDataFrame([(1, "[np.int32(4), 5, np.int32(60), 7]"), (2, "[1, 2, 3, 4]")], "n int, box string")
    text = "".join(f"Detection {r.n}:\n  Bounding Box: {r.box}\n  Confidence Score: 0.{r.n}5\n  Label: 1\n\n" for r in found.collect())
    got = files.detections(spark.createDataFrame([("f", text)], "path string, content string")).orderBy("det").collect()
    assert [(r.det, r.x1, r.y1, r.x2, r.y2, r.score, r.label) for r in got] == [(1, 4, 5, 60, 7, 0.15, 1), (2, 1, 2, 3, 4, 0.25, 1)]
    lines = spark.createDataFrame([("Node_ID\tPosition\tFilled_Area",), ("room_1\t(np.float64(1.5), 2.0)\t30",), ("room_2\t(7, 8)\t0",)], "line string")
    assert [tuple(r) for r in files.fill_areas(lines).collect()] == [("room_1", 1.5, 2.0, 30), ("room_2", 7.0, 8.0, 0)]
    timed = spark.createDataFrame([(1, "b check", 2.0), (0, "a check", 1.234)], "ord long, stage string, secs double")
    for _ in range(2):
        writers.write_lines(writers.timing_lines(timed).coalesce(1), str(tmp_path / "log"), append=True)
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "log")).collect()) == ["a check: 1.23 seconds"] * 2 + ["b check: 2.00 seconds"] * 2
    areas = spark.createDataFrame([("room_1", 1.0, 2.5, 9)], "id string, x double, y double, area long")
    writers.write_table(writers.fill_lines(areas), str(tmp_path / "tsv"))
    assert [tuple(r) for r in files.fill_areas(spark.read.text(str(tmp_path / "tsv")).withColumnRenamed("value", "line")).collect()] == [("room_1", 1.0, 2.5, 9)]


def test_room_properties(spark, tmp_path):
    block = spark.createDataFrame([("room_1", y, x) for y in range(9) for x in range(12)] + [("room_2", 50, 70)], "room string, y long, x long")
    rooms = masks.subnode_candidates(block, 4, 2, 0)
    writers.write_documents(writers.room_property_documents(rooms), str(tmp_path / "p"), by="room")
    got = {r.room: r for r in files.read_room_properties(spark, str(tmp_path / "p/*")).collect()}
    assert (got["room_1"].area_px, got["room_1"].centroid_xy, got["room_1"].inradius_px) == (108, [5.5, 4.0], 5.0)
    assert abs(got["room_1"].eq_radius_px - (108 / 3.141592653589793) ** 0.5) < 1e-9 and got["room_2"].inradius_px == 1.0 and got["room_2"].num_candidates == 0
    points = {r.room: [(p.x, p.y) for p in r.candidates] for r in rooms.collect()}["room_1"]
    assert points and all(2 <= x + 1 <= 11 and 2 <= y + 1 <= 8 for x, y in points) and got["room_1"].num_candidates == len(points)


def test_reports(spark):
    issues = spark.createDataFrame([("error", "floor_gap", "3"), ("warning", "floor_name", "a.png:2")], "level string, code string, detail string")
    of = lambda df: [r.line for r in df.orderBy("ord").collect()]
    assert of(writers.validation_report(issues)) == ["Mapping Validation Report", "=" * 50, "Status: FAILED", "Errors:", "  - floor_gap 3", "Warnings:", "  - floor_name a.png:2"]
    assert of(writers.validation_report(issues.limit(0)))[2] == "Status: PASSED"
    comps = spark.createDataFrame([(1, 40), (9, 2)], "comp long, nodes long")
    pairs = spark.createDataFrame([(1, True), (1, False), (2, True)], "floor long, connected boolean")
    assert of(writers.connectivity_report(comps, pairs))[2:] == ["Fully Connected: No", "Connected Components: 2", "Largest Component: 40 nodes", "Floor-wise Connectivity:", "  Floor 1: 1 connected, 1 disconnected", "  Floor 2: 1 connected, 0 disconnected"]
    links = spark.createDataFrame([("1_a", "2_b", 1, 2), (None, None, 2, 3)], "src string, dst string, src_floor long, tgt_floor long")
    assert of(writers.mapping_report(links))[2:4] == ["Total inter-floor connections: 1", "Connections:"]
    steps = spark.createDataFrame([(0, "parse_mapping", 0.25), (1, "merge_graphs", 1.5)], "ord long, step string, secs double")
    floors = spark.createDataFrame([(1, "a.png", 8.5)], "floor long, image string, secs double")
    assert of(writers.timing_report(steps, floors))[2:] == ["  Parse Mapping: 0.250 seconds", "  Merge Graphs: 1.500 seconds", "PER-FLOOR PROCESSING TIMES:", "  Floor 1 (a.png):\n    Total: 8.50 seconds", "TOTAL PROCESSING TIME: 1.75 seconds"]


def test_text_boxes_and_inline_mapping(spark):
    lines = spark.createDataFrame([(0, "1,2,3,4"), (1, " 1, 2,3,4 | a | b"), (2, "1,x"), (3, "  ")], "line_no long, line string")
    assert [(r.line_no, r.bbox, r.text, r.error) for r in files.text_boxes(lines).orderBy("line_no").collect()] == [(0, [1, 2, 3, 4], None, None), (1, [1, 2, 3, 4], "a | b", None), (2, None, None, "1,x")]
    one = spark.createDataFrame([(1, "(1, a.png, s):(2, b.png, t); broken ;;(2, b.png, t):(3, c.png, u)")], "id long, text string")
    got = readers.parse_mapping(files.inline_mapping(one)).where("ok").orderBy("line_no").collect()
    assert [(r.src_floor, r.src_node, r.tgt_floor, r.tgt_node) for r in got] == [(1, "s", 2, "t"), (2, "t", 3, "u")]


def test_timer_total_without_a_unit(spark):
    df = spark.createDataFrame([("a", "Total Time: 4.5 seconds\nImage Dimensions: 10 X 20"), ("b", "total time: 7"), ("c", "")], "file_name string, content string")
    assert {r.file_name: (r.total_time, r.width) for r in readers.timer_metrics(df).collect()} == {"a": (4.5, 10), "b": (7.0, None), "c": (None, None)}


def test_streams_equal_their_batch_twins(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").limit(300)
    events.write.parquet(str(tmp_path / "in"))
    batch = spark.read.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    q = stages.latest_stream(stream(), "latest_rows", str(tmp_path / "c1"))
    q.processAllAvailable()
    q.stop()
    key = lambda df: sorted(tuple(map(str, r)) for r in df.collect())
    assert key(spark.table("latest_rows")) == key(stages.latest(batch))
    q = stages.stage_counts_stream(stream()).writeStream.outputMode("update").format("memory").queryName("count_rows").option("checkpointLocation", str(tmp_path / "c2")).start()
    q.processAllAvailable()
    q.stop()
    assert key(spark.table("count_rows").groupBy("at", "event_type").agg(F.max("n").alias("n"))) == key(stages.stage_counts(batch))
