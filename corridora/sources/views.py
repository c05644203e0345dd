"""Domain views over the driver's tables: the same integer arithmetic for Spark and for the SQL that checks it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: name: (table, condition, {column: expression}); expressions hold in Spark SQL and ANSI SQL alike.
VIEWS: dict[str, tuple[str, str, dict[str, str]]] = {
    "v_lattice": ("part", "true", {"id": "concat('corridor_connect_', p_partkey)", "k": "p_partkey", "x": "(p_partkey % 20) * 20", "y": "CAST(floor(p_partkey / 20) AS BIGINT) * 20"}),
    "v_outside": ("part", "p_partkey % 7 = 0", {"id": "concat('outside_connect_', p_partkey)", "k": "p_partkey", "x": "(p_partkey * 13) % 400", "y": "(p_partkey * 29) % 2000"}),
    "v_doors": ("customer", "true", {"id": "concat(CASE c_custkey % 4 WHEN 0 THEN 'exit' WHEN 1 THEN 'c2c' WHEN 2 THEN 'r2c' ELSE 'r2r' END, '_door_', c_custkey)", "k": "c_custkey", "subtype": "CASE c_custkey % 4 WHEN 0 THEN 'exit' WHEN 1 THEN 'c2c' WHEN 2 THEN 'r2c' ELSE 'r2r' END", "x": "(c_custkey * 37) % 400", "y": "(c_custkey * 91) % 2000"}),
    "v_rooms": ("supplier", "true", {"id": "concat('room_', s_suppkey)", "k": "s_suppkey", "x": "(s_suppkey * 41 + 7) % 400", "y": "(s_suppkey * 173 + 29) % 2000", "floor": "CAST(s_nationkey % 3 + 1 AS BIGINT)"}),
    "v_halls": ("nation", "true", {"id": "concat('corridor_main_', n_nationkey)", "k": "CAST(n_nationkey AS BIGINT)", "x": "CAST((n_nationkey * 83) % 400 AS BIGINT)", "y": "CAST((n_nationkey * 61) % 2000 AS BIGINT)"}),
    "v_transitions": ("nation", "true", {"id": "concat(CASE n_nationkey % 2 WHEN 0 THEN 'stairs_' ELSE 'elevator_' END, n_nationkey)", "k": "CAST(n_nationkey AS BIGINT)", "x": "CAST((n_nationkey * 53) % 400 AS BIGINT)", "y": "CAST((n_nationkey * 97) % 2000 AS BIGINT)", "floor": "CAST(n_regionkey AS BIGINT)", "chain": "CAST(floor(n_nationkey / 5) AS BIGINT)"}),
    "v_subnodes": ("customer", "true", {"id": "concat('room_', c_custkey % 50, '_subnode_', c_custkey)", "room": "concat('room_', c_custkey % 50)", "k": "c_custkey", "x": "((c_custkey % 50) * 41 + 7) % 400 + (c_custkey * 7) % 120", "y": "((c_custkey % 50) * 173 + 29) % 2000 + (c_custkey * 11) % 120"}),
    "v_boxes": ("part", "true", {"ord": "p_partkey", "grp": "p_partkey % 40", "x1": "(p_partkey * 37) % 400", "y1": "(p_partkey * 91) % 400", "x2": "(p_partkey * 37) % 400 + 10 + p_partkey % 30", "y2": "(p_partkey * 91) % 400 + 10 + p_partkey % 20"}),
    "v_pixcode": ("lineitem", "true", {"y": "l_orderkey % 400", "x": "l_partkey % 400", "code": "CAST((CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 2 ELSE 4 END + CASE l_linestatus WHEN 'F' THEN 0 ELSE 1 END) * 10 + l_linenumber AS BIGINT)"}),
    "v_words": ("part", "true", {"k": "p_partkey", "text": "CASE p_partkey % 12 WHEN 0 THEN 'l0O1' WHEN 1 THEN 'halls' WHEN 2 THEN 'na' WHEN 3 THEN 'lift' WHEN 4 THEN 'a' WHEN 5 THEN '' WHEN 6 THEN concat('1', p_partkey) WHEN 7 THEN 'S' WHEN 8 THEN concat(p_size, 'B-', p_size) WHEN 9 THEN 'hall' WHEN 10 THEN 'kitchn' ELSE p_name END", "conf": "CAST((p_partkey * 7) % 100 AS BIGINT)"}),
    "v_names": ("nation", "true", {"k": "CAST(n_nationkey AS BIGINT)", "name": "concat(CASE n_nationkey % 10 WHEN 0 THEN 'FF part ' WHEN 1 THEN 'SF part ' WHEN 2 THEN 'tf_' WHEN 3 THEN 'b2 ' WHEN 4 THEN 'GF ' WHEN 5 THEN 'wing' WHEN 6 THEN '4 part ' WHEN 7 THEN 'file_' WHEN 8 THEN 'level-' ELSE 'plan ' END, CASE WHEN n_nationkey % 10 = 9 THEN 'x' ELSE CAST(n_nationkey AS STRING) END, '.png')"}),
    "v_log": ("orders", "true", {"k": "o_orderkey", "line": "concat(CASE o_orderkey % 6 WHEN 0 THEN 'text detection check: ' WHEN 1 THEN 'Detecting doors check: ' WHEN 2 THEN 'Total graph nodes (before pruning): ' WHEN 3 THEN 'JSON File Size (after pruning): ' WHEN 4 THEN 'Image Dimensions: ' ELSE '=====' END, CASE o_orderkey % 6 WHEN 2 THEN concat(o_custkey, '') WHEN 3 THEN concat('1,', 100 + o_custkey % 900, '.5 KB') WHEN 4 THEN concat(o_custkey % 2000, ' x ', o_orderkey % 1500, ' pixels') WHEN 5 THEN '' ELSE concat(o_custkey % 9, '.', 10 + o_orderkey % 90, ' seconds') END)", "file_name": "concat('f', o_orderkey % 50)"}),
    "v_ocr": ("part", "true", {"k": "p_partkey", "line": "CASE p_partkey % 9 WHEN 8 THEN concat('no box ', p_partkey) ELSE concat('BBox ', p_partkey, ': [', p_partkey % 400, ', ', p_partkey % 300, ', ', p_partkey % 400 + 20, ', ', p_partkey % 300, ', ', p_partkey % 400 + 20, ', ', p_partkey % 300 + 9, ', ', p_partkey % 400, ', ', p_partkey % 300 + 9, '], Text: ', CASE p_partkey % 7 WHEN 0 THEN 'Stairs' WHEN 1 THEN 'lift' WHEN 2 THEN 'elev' WHEN 3 THEN 'hall' WHEN 4 THEN 'na' ELSE concat('10', p_partkey % 90) END, ', Confidence: 0.', 1000 + p_partkey % 9000) END"}),
    "v_listing": ("part", "true", {"path": "concat('results/', CASE p_partkey % 3 WHEN 0 THEN 'a/' WHEN 1 THEN 'b/' ELSE '' END, 'plan', CAST(floor(p_partkey / 4) AS BIGINT), CASE p_partkey % 4 WHEN 0 THEN '_post_pruning.json' WHEN 1 THEN CASE WHEN p_partkey % 8 = 1 THEN '_pre_pruning.json' ELSE '_timer_info.txt' END WHEN 2 THEN CASE WHEN p_partkey % 5 = 2 THEN '_final_graph.json' ELSE '.PNG' END ELSE '.xyz' END)", "image": "concat('plan', CAST(floor(p_partkey / 4) AS BIGINT))", "name": "concat('plan', CAST(floor(p_partkey / 4) AS BIGINT), CASE p_partkey % 4 WHEN 0 THEN CASE WHEN p_partkey % 3 = 0 THEN '.txt' ELSE '_post_pruning.json' END WHEN 1 THEN CASE WHEN p_partkey % 8 = 1 THEN '_pre_pruning.json' ELSE '_timer_info.txt' END WHEN 2 THEN CASE WHEN p_partkey % 5 = 2 THEN '_final_graph.json' ELSE '.PNG' END ELSE '.xyz' END)"}),
    "v_map": ("nation", "true", {"line_no": "CAST(n_nationkey AS BIGINT)", "line": "CASE n_nationkey % 8 WHEN 6 THEN '# a comment' WHEN 7 THEN '(1, broken' ELSE concat('  (', n_nationkey % 3 - 1, ', FF part ', n_nationkey % 4, '.png, stairs_', n_nationkey % 5, ') : (', n_nationkey % 3 + CASE n_nationkey % 5 WHEN 0 THEN 1 ELSE 0 END, ', SF part ', n_nationkey % 4, '.png, stairs_', n_nationkey, ') ') END"}),
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    table, where, columns = VIEWS[name]
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").where(where).selectExpr(*[f"{e} AS {c}" for c, e in columns.items()])


def ctes(*names: str) -> str:
    """WITH clause that defines the views for the checking SQL."""
    out = []
    for name in names:
        table, where, columns = VIEWS[name]
        out.append(f"{name} AS (SELECT {', '.join(f'{e} AS {c}' for c, e in columns.items())} FROM {table} WHERE {where})")
    return "WITH " + ",\n".join(out)
