"""Scene and frame tables derived from the given TPC-H-like tables.

Every view is one SELECT in the common subset of Spark SQL and DuckDB, using whole-number
arithmetic and string splits, so both engines see the same rows. ``{name}`` refers to a
given table or to another view. Scene sizes are fixed, the number of scenes grows with the
tables.
"""

from __future__ import annotations

from functools import lru_cache
from string import Formatter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roomgraph.functions.geometry import BOX_FIELDS, make_box, make_point, make_pose

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()

# rotations of the 3-4-5 triangle: exact in binary arithmetic up to one rounding
_TURN = """
  CASE {k} % 4 WHEN 0 THEN CAST(1 AS DOUBLE) WHEN 1 THEN CAST(3 AS DOUBLE)/5
               WHEN 2 THEN CAST(0 AS DOUBLE) ELSE CAST(-4 AS DOUBLE)/5 END"""
_TILT = """
  CASE {k} % 4 WHEN 0 THEN CAST(0 AS DOUBLE) WHEN 1 THEN CAST(4 AS DOUBLE)/5
               WHEN 2 THEN CAST(1 AS DOUBLE) ELSE CAST(3 AS DOUBLE)/5 END"""

VIEWS: dict[str, str] = {
    # 50 objects per scene
    "a_objects": """
SELECT scene_id, ord, concat('obj_', CAST(ord AS STRING)) AS node_id, label, color, j,
       x AS xmin, y AS ymin, z AS zmin, x + s AS xmax, y + s AS ymax, z + s AS zmax, conf
FROM (
  SELECT CAST(floor(p_partkey / 50) AS BIGINT) AS scene_id, p_partkey % 50 AS j,
         p_partkey AS ord,
         split_part(p_name, ' ', 2) AS label, split_part(p_name, ' ', 1) AS color,
         CAST(((p_partkey % 50) * 137 + CAST(floor(p_partkey / 50) AS BIGINT) * 11) % 300 AS DOUBLE) / 100 AS x,
         CAST(((p_partkey % 50) * 89 + CAST(floor(p_partkey / 50) AS BIGINT) * 7) % 250 AS DOUBLE) / 100 AS y,
         CAST(((p_partkey % 50) * 13 + CAST(floor(p_partkey / 50) AS BIGINT) * 3) % 30 AS DOUBLE) * 0.06 AS z,
         CAST(2 + p_size % 10 AS DOUBLE) * 0.06 AS s,
         0.5 + CAST(p_partkey % 50 AS DOUBLE) / 100 AS conf
  FROM {part}) t""",
    "a_supports": """
SELECT scene_id, ord, concat('sup_', CAST(ord AS STRING)) AS support_id,
       x AS xmin, y AS ymin, top_z - 0.05 AS zmin,
       x + 1.5 AS xmax, y + 1.5 AS ymax, top_z + 0.03 AS zmax, top_z
FROM (
  SELECT CAST(floor(s_suppkey * 2 / 5) AS BIGINT) AS scene_id, s_suppkey AS ord,
         CAST(s_suppkey * 31 % 150 AS DOUBLE) / 100 AS x,
         CAST(s_suppkey * 43 % 100 AS DOUBLE) / 100 AS y,
         CAST(s_suppkey * 7 % 20 AS DOUBLE) * 0.06 AS top_z
  FROM {supplier}) t""",
    # region -> nation -> customer, as room -> anchor -> object
    "a_tree": """
SELECT concat('r', CAST(r_regionkey AS STRING)) AS node_id, 'room' AS node_type, r_name AS label,
       CAST(NULL AS STRING) AS parent_id, CAST(r_regionkey AS BIGINT) AS ord FROM {region}
UNION ALL
SELECT concat('n', CAST(n_nationkey AS STRING)), 'anchor', n_name,
       concat('r', CAST(n_regionkey AS STRING)), CAST(1000 + n_nationkey AS BIGINT) FROM {nation}
UNION ALL
SELECT concat('c', CAST(c_custkey AS STRING)), 'object', c_mktsegment,
       concat('n', CAST(c_nationkey AS STRING)), 100000 + c_custkey FROM {customer}""",
    # one row per line item: a sighting of a part in a frame
    "a_sightings": """
SELECT CAST(floor(l_orderkey / 75) AS BIGINT) AS scene_id,
       CAST(l_linenumber * 10 + l_orderkey % 10 AS BIGINT) AS frame_no,
       l_orderkey AS k1, CAST(l_linenumber AS BIGINT) AS k2, l_partkey AS k3, l_suppkey AS k4,
       split_part(p_name, ' ', 2) AS class, split_part(p_name, ' ', 1) AS color,
       l_quantity / 50 AS conf,
       CAST(l_partkey * 37 % 300 AS DOUBLE) / 100 AS x,
       CAST(l_partkey * 53 % 250 AS DOUBLE) / 100 AS y,
       CAST((l_partkey * 7 + l_suppkey) % 25 AS DOUBLE) / 10 AS z,
       CAST(1 + l_suppkey % 5 AS DOUBLE) / 10 AS s
FROM {lineitem} l JOIN {part} p ON l.l_partkey = p.p_partkey""",
    # instances by part within a block of orders, standing for associated objects
    "a_instance_obs": """
SELECT scene_id, concat(class, '_', CAST(k3 % 40 AS STRING)) AS instance_id, frame_no, class, color, conf,
       x, y, z, s, k1, k2, k3, k4
FROM {a_sightings}""",
    # sparse points: one per line item
    "a_points": """
SELECT CAST(floor(l_orderkey / 400) AS BIGINT) AS scene_id,
       CAST(l_partkey * 37 % 500 AS DOUBLE) / 100 AS x,
       CAST((l_suppkey * 53 + l_linenumber * 71) % 400 AS DOUBLE) / 100 AS y,
       CAST(CAST(round(l_extendedprice) AS BIGINT) % 280 AS DOUBLE) / 100 AS z,
       CAST(l_quantity AS BIGINT) % 8 AS track_len
FROM {lineitem}""",
    # one detection per order, 20 frames of 20 detections per scene
    "a_detections": """
SELECT scene_id, ord, frame_no, concat('frame_', lpad(CAST(frame_no AS STRING), 6, '0'), '.jpg') AS frame,
       class_id, class, conf, x1, y1, x1 + w AS x2, y1 + h AS y2
FROM (
  SELECT CAST(floor(o_orderkey / 400) AS BIGINT) AS scene_id, o_orderkey AS ord,
         CAST(floor((o_orderkey % 400) / 20) AS BIGINT) AS frame_no,
         o_custkey % 8 AS class_id,
         CASE o_custkey % 8 WHEN 0 THEN 'cup' WHEN 1 THEN 'chair' WHEN 2 THEN 'laptop'
              WHEN 3 THEN 'bucket' WHEN 4 THEN 'pillow' WHEN 5 THEN 'mouse'
              WHEN 6 THEN 'blanket' ELSE 'trash can' END AS class,
         CAST(1 + CAST(floor(o_totalprice) AS BIGINT) % 99 AS DOUBLE) / 100 AS conf,
         CAST(o_custkey * 29 % 520 AS DOUBLE) AS x1,
         CAST(CAST(floor(o_totalprice) AS BIGINT) % 260 AS DOUBLE) AS y1,
         CAST(40 + o_orderkey % 80 AS DOUBLE) AS w,
         CAST(40 + o_custkey % 60 AS DOUBLE) AS h
  FROM {orders}) t""",
    # one camera pose per frame of a scene, world to camera; cameras look down the room
    "a_poses": """
SELECT scene_id, frame_no, concat('frame_', lpad(CAST(frame_no AS STRING), 6, '0'), '.jpg') AS frame,
       frame_no * 66666667 AS host_mono_ns,
       c AS r00, CAST(0 AS DOUBLE) AS r01, CAST(0 AS DOUBLE) - s AS r02,
       CAST(0 AS DOUBLE) AS r10, CAST(1 AS DOUBLE) AS r11, CAST(0 AS DOUBLE) AS r12,
       s AS r20, CAST(0 AS DOUBLE) AS r21, c AS r22,
       CAST(0 AS DOUBLE) - CAST((frame_no * 7 + scene_id) % 30 AS DOUBLE) / 10 AS tx,
       CAST(0 AS DOUBLE) - CAST(frame_no % 10 AS DOUBLE) / 5 AS ty,
       CAST(3 + (frame_no + scene_id) % 4 AS DOUBLE) AS tz
FROM (
  SELECT scene_id, frame_no,
         """ + _TURN.format(k="(frame_no + scene_id)") + """ AS c,
         """ + _TILT.format(k="(frame_no + scene_id)") + """ AS s
  FROM (SELECT DISTINCT CAST(floor(o_orderkey / 400) AS BIGINT) AS scene_id,
               CAST(floor((o_orderkey % 400) / 20) AS BIGINT) AS frame_no FROM {orders}) d) t""",
    # one walking camera per customer block, one station per order
    "a_track": """
SELECT CAST(floor(o_orderkey / 300) AS BIGINT) AS scene_id, o_orderkey % 300 AS frame_no,
       CAST(o_orderkey * 66000000 + o_custkey * 1000 AS BIGINT) AS host_mono_ns,
       CAST((o_orderkey % 300) * 5 AS DOUBLE) / 100 + CAST(o_custkey % 7 AS DOUBLE) / 20 AS cx,
       CAST((o_orderkey % 300) * 2 AS DOUBLE) / 100 + CASE WHEN o_custkey % 53 = 0 THEN 3 ELSE 0 END AS cy,
       CAST(150 + o_custkey % 9 AS DOUBLE) / 100 AS cz,
       CASE WHEN o_custkey % 211 = 0 THEN CAST(9 AS DOUBLE) / 10 ELSE CAST(1 AS DOUBLE) END AS qw
FROM {orders}""",
    # device frames: one per event
    "a_frames": """
SELECT user_id AS device_id, event_id AS seq, epoch_s,
       CASE event_type WHEN 'click' THEN 'manual' WHEN 'signup' THEN 'read' ELSE 'auto' END AS trigger,
       bits, k,
       CASE WHEN bits = 0 THEN '0000000000000000'
            WHEN bits % 4 = 0 THEN lpad(repeat('f', CAST(floor(bits / 4) AS INT)), 16, '0')
            WHEN bits % 4 = 1 THEN lpad(concat('1', repeat('f', CAST(floor(bits / 4) AS INT))), 16, '0')
            WHEN bits % 4 = 2 THEN lpad(concat('3', repeat('f', CAST(floor(bits / 4) AS INT))), 16, '0')
            ELSE lpad(concat('7', repeat('f', CAST(floor(bits / 4) AS INT))), 16, '0') END AS phash,
       value, event_type
FROM (
  SELECT user_id, event_id, event_type, value,
         CAST(regexp_replace(props, '[^0-9]', '', {g}) AS BIGINT) AS k,
         {epoch} AS epoch_s,
         least(CAST(63 AS BIGINT), CAST(floor(value / 8) AS BIGINT)) AS bits
  FROM {events}) t""",
    # one model answer per frame
    "a_model_log": """
SELECT seq, device_id, epoch_s, event_type AS model, trigger,
       CAST(floor(value * 10) AS BIGINT) AS latency_ms,
       k + 10 AS prompt_tokens, CAST(floor(value / 4) AS BIGINT) AS completion_tokens,
       CASE WHEN k % 10 = 0 THEN 'error' WHEN k % 10 = 1 THEN 'timeout' ELSE 'ok' END AS call_outcome,
       k % 9 = 0 AS degraded, k % 23 = 0 AS second_call,
       CASE WHEN bits < 2 THEN 'gate' WHEN k % 17 = 0 THEN 'rules' ELSE NULL END AS rejected_by,
       CASE WHEN bits < 2 THEN 'duplicate' WHEN k % 17 = 0 THEN 'too_blurry' ELSE NULL END AS reject_reason,
       CASE WHEN k % 10 < 2 THEN 'call_failed' ELSE NULL END AS error
FROM {a_frames}""",
    # raw model text in the shapes models really answer in
    "a_answers": """
SELECT seq, device_id, trigger, raw_text FROM (
 SELECT seq, device_id, trigger,
  CASE seq % 9
   WHEN 0 THEN concat('{{"scene":"s', CAST(k AS STRING), '","objects":["a","b ",""],"ocr_text":"tel 138', lpad(CAST(seq % 100000000 AS STRING), 8, '0'), '","keywords":"x, y，z","risk_level":"Warning","advice":"go"}}')
   WHEN 1 THEN concat('```json\n{{"scene":"hall","risk_level":"', CASE WHEN k % 2 = 0 THEN 'danger' ELSE 'odd' END, '","advice":"stop ', CAST(k AS STRING), '"}}\n```')
   WHEN 2 THEN concat('Sure! {{"advice":"mind the step ', CAST(k AS STRING), '","objects":"cup,mug"}} ok?')
   WHEN 3 THEN concat('{{"scene":"x","advice":"half done ', CAST(k AS STRING), '", "objects":[')
   WHEN 4 THEN concat('no json here ', CAST(k AS STRING))
   WHEN 5 THEN '   '
   WHEN 6 THEN concat('{{"advice":"', repeat('long', CAST(30 + k % 5 AS INT)), '","scene":"yard"}}')
   WHEN 7 THEN concat('{{"scene":', CAST(k AS STRING), ',"advice":"n ', CAST(k AS STRING), '"}}')
   ELSE concat('{{"scene":"room ', CAST(k AS STRING), '","ocr_text":"mail a', CAST(k AS STRING), '@b.example.com","risk_level":"低","advice":""}}')
  END AS raw_text
 FROM {a_frames}) t""",
    "a_docs": "SELECT doc_id, source, lang, text FROM {documents}",
    # confirmed memory: one node per catalogue part
    "a_memory": """
SELECT scene_id, ord, node_id,
       CASE label WHEN 'bolt' THEN '电风扇' WHEN 'gear' THEN '键盘' WHEN 'ring' THEN '葡萄'
                  WHEN 'rod' THEN '椅子' ELSE label END AS name,
       CASE color WHEN 'red' THEN '红色' WHEN 'blue' THEN '蓝色' WHEN 'hot' THEN '橙色'
                  WHEN 'cold' THEN '白色' WHEN 'old' THEN '灰色' ELSE '' END AS color,
       CASE j % 4 WHEN 0 THEN 'fan' WHEN 1 THEN label WHEN 2 THEN '' ELSE 'plate ring' END AS label_hint,
       CASE j % 3 WHEN 0 THEN 'ocr' WHEN 1 THEN 'interactive' ELSE 'multi_view' END AS source,
       conf AS confidence,
       CASE WHEN j % 5 = 0 THEN NULL ELSE (xmin + xmax) / 2 END AS x,
       (ymin + ymax) / 2 AS y, (zmin + zmax) / 2 AS z
FROM {a_objects}""",
    # questions to that memory, one per part
    "a_questions": """
SELECT ord AS query_id, scene_id,
       CASE ord % 7
         WHEN 0 THEN concat(name, '在哪里')
         WHEN 1 THEN color
         WHEN 2 THEN '办公椅在哪儿'
         WHEN 3 THEN '不存在的蓝色恐龙'
         WHEN 4 THEN ' 在哪 '
         WHEN 5 THEN name
         ELSE concat(color, '的', name, '是什么颜色') END AS text
FROM {a_memory}""",
    # words to locate among labels, stable texts and aliases, one per part
    "a_lookups": """
SELECT ord AS query_id, scene_id,
       CASE ord % 6 WHEN 0 THEN label WHEN 1 THEN substring(label, 2, 2) WHEN 2 THEN color
            WHEN 3 THEN '垃圾桶和水桶' WHEN 4 THEN concat(color, '的') ELSE upper(label) END AS text,
       CASE ord % 3 WHEN 0 THEN 'on' WHEN 1 THEN 'near' ELSE '' END AS predicate,
       CASE ord % 5 WHEN 4 THEN '' ELSE label END AS subject_hint,
       CASE ord % 4 WHEN 3 THEN '' ELSE color END AS object_hint
FROM {a_objects}""",
    # novel-looking detections with a meaning, one per order
    "a_candidate_rows": """
SELECT scene_id, ord, frame_no, frame, class AS label_hint,
       CASE WHEN o_custkey % 10 = 0 THEN NULL ELSE
         CASE o_custkey % 6 WHEN 0 THEN '风扇' WHEN 1 THEN '座椅' WHEN 2 THEN '键盘' WHEN 3 THEN '杯子'
              WHEN 4 THEN '落地扇' ELSE 'Widget' END END AS name,
       CASE o_custkey % 4 WHEN 0 THEN '红色' WHEN 1 THEN '白色' WHEN 2 THEN '蓝色' ELSE '灰色' END AS color,
       CAST(1 + o_custkey % 7 AS DOUBLE) AS f1, CAST(1 + o_custkey % 3 AS DOUBLE) AS f2,
       CAST(o_custkey % 5 AS DOUBLE) - 2 AS f3, CAST(o_orderkey % 4 AS DOUBLE) - 1 AS f4,
       CAST(o_custkey * 7 % 50 AS DOUBLE) / 10 AS cx, CAST(o_custkey * 3 % 40 AS DOUBLE) / 10 AS cy
FROM {a_detections} d JOIN {orders} o ON d.ord = o.o_orderkey""",
    # vectors asked for: the stored ones with six signs turned
    "a_vector_asks": """
SELECT vec_id AS query_id, CAST(floor(vec_id / 50) AS BIGINT) AS scene_id, vec_id, label, embedding,
       CASE WHEN vec_id % 2 = 0 THEN NULL ELSE concat('name', CAST(label AS STRING)) END AS name,
       CASE vec_id % 5 WHEN 0 THEN '' WHEN 1 THEN 'red' WHEN 2 THEN 'blue' WHEN 3 THEN 'grey' ELSE 'green' END AS color
FROM {embeddings}""",
    # feature gallery
    "a_features": """
SELECT vec_id, CAST(floor(vec_id / 50) AS BIGINT) AS scene_id, label, embedding,
       CASE WHEN vec_id % 3 = 0 THEN NULL ELSE concat('name', CAST(label AS STRING)) END AS name,
       CASE vec_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'red' WHEN 2 THEN 'blue' ELSE 'grey' END AS color
FROM {embeddings}""",
    "a_chat": """
SELECT conv_id, turn, role, text, conv_id * 1000 + turn AS chat_id, turn * 17 AS t_s FROM {conversations}""",
}

_DIALECT = {
    "spark": {"epoch": "unix_micros(ts) / CAST(1000000 AS DOUBLE)", "g": "1"},
    "duckdb": {"epoch": "CAST(epoch_us(ts) AS DOUBLE) / 1000000", "g": "'g'"},
}


def _references(sql: str) -> list[str]:
    names = [field for _, field, _, _ in Formatter().parse(sql) if field]
    return [n for n in dict.fromkeys(names) if n not in ("epoch", "g")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    # local wall clock without zone is read as UTC
    for field in df.schema.fields:
        if field.dataType.typeName() == "timestamp_ntz":
            df = df.withColumn(field.name, F.col(field.name).cast("timestamp"))
    return df


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name in TABLES:
        return table(spark, sf_dir, name)
    sql = VIEWS[name]
    parts = {n: view(spark, sf_dir, n) for n in _references(sql)}
    text = sql.format(
        **{n: "{" + n + "}" for n in parts}, **_DIALECT["spark"]
    ) if "{{" not in sql else _keep_braces(sql, parts)
    return spark.sql(text, **parts)


def _keep_braces(sql: str, parts: dict) -> str:
    """Fill dialect words only; doubled braces stay doubled for the later formatting."""
    text = sql
    for word, value in _DIALECT["spark"].items():
        text = text.replace("{" + word + "}", value)
    return text


@lru_cache(maxsize=None)
def _order(name: str) -> tuple[str, ...]:
    found: dict[str, None] = {}
    for ref in _references(VIEWS[name]):
        if ref not in TABLES:
            for dep in _order(ref):
                found[dep] = None
    found[name] = None
    return tuple(found)


def oracle(body: str) -> str:
    """DuckDB text of a query over views: the used views become WITH clauses."""
    needed: dict[str, None] = {}
    for ref in _references(body):
        if ref not in TABLES:
            for dep in _order(ref):
                needed[dep] = None
    plain = {n: n for n in (*TABLES, *VIEWS)}
    ctes = [f"{n} AS ({VIEWS[n].format(**plain, **_DIALECT['duckdb'])})" for n in needed]
    text = body.format(**plain, **_DIALECT["duckdb"]).strip()
    if not ctes:
        return text
    head = ",\n".join(ctes)
    if text.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {head},\n{text[len('WITH RECURSIVE'):]}"
    if text.upper().startswith("WITH"):
        return f"WITH {head},\n{text[len('WITH'):]}"
    return f"WITH {head}\n{text}"


# ---- typed shapes -----------------------------------------------------------------------------


def boxed(df: DataFrame) -> DataFrame:
    """Six flat extents folded into one box column."""
    return df.withColumn("box", make_box(*[F.col(f) for f in BOX_FIELDS])).drop(*BOX_FIELDS)


def objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boxed(view(spark, sf_dir, "a_objects"))


def supports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boxed(view(spark, sf_dir, "a_supports"))


def poses(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = view(spark, sf_dir, "a_poses")
    rotation = [f"r{i}{j}" for i in range(3) for j in range(3)]
    pose = make_pose([F.col(c) for c in rotation], [F.col(c) for c in ("tx", "ty", "tz")])
    # an exchange stands for the stored table: pose fields are not recomputed per point
    return flat.withColumn("pose", pose).drop(*rotation, "tx", "ty", "tz").repartition("scene_id", "frame")


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = view(spark, sf_dir, "a_detections")
    return flat.withColumn("bbox", F.struct("x1", "y1", "x2", "y2")).drop("x1", "y1", "x2", "y2")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "a_points").withColumn("p", make_point(*map(F.col, "xyz")))
