"""Scans and sinks: line JSON tables, timelines, reconstruction files, scene dumps, frames."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ---- schemas ----------------------------------------------------------------------------------

BOX = "struct<xmin:double,ymin:double,zmin:double,xmax:double,ymax:double,zmax:double>"
POINT = "struct<x:double,y:double,z:double>"
SCHEMAS = {
    "detections": "frame string, class_id int, class string, conf double, bbox array<double>",
    "observations": "frame string, class_id int, class string, conf double, bbox2d array<double>, "
                    "center array<double>, box3d array<double>, n_points int, depth_m double",
    "instances": "instance_id string, class string, class_id int, family string, "
                 "class_candidates array<struct<class:string,votes:double,max_conf:double,n_frames:int>>, "
                 "center array<double>, box3d array<double>, n_observations int, first_frame string, "
                 "last_frame string, median_conf double, "
                 "evidence struct<frame:string,class:string,conf:double,bbox2d:array<double>>",
    "anchors": "anchor_id string, category string, box array<double>, normal array<double>, "
               "n_inliers int, confidence double",
    "supports": "support_id string, category string, top_z double, box array<double>, n_inliers int, "
                "extent_xy array<double>",
    "poses": "frame_file string, extract_index int, frame_index int, host_mono_ns bigint, tx double, "
             "ty double, tz double, qx double, qy double, qz double, qw double, accuracy double, scale double",
    "manifest": "extract_index int, frame_file string, frame_index int, sender_ts_ns bigint, "
                "host_mono_ns bigint, flags int",
}
CONFIRMED = (
    "confirmed_nodes array<struct<candidate_id:string,label_hint:string,name:string,color:string,"
    "sources:array<string>,confidence:double,center:array<double>>>"
)
FRAME = (
    "device_id string, seq bigint, ts timestamp, trigger string, n_bytes bigint, width int, height int, "
    "decode_ok boolean, edge_var double, face_count int, phash string"
)


def _exists(spark: SparkSession, pattern: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return found is not None and len(found) > 0


def read_lines(spark: SparkSession, root: str, name: str, kind: str | None = None) -> DataFrame:
    """``<root>/<scene>/<name>.jsonl`` of all scenes with ``scene_id`` and line order ``ord``.

    The schema is fixed, never inferred. A missing file is an empty table.
    """
    schema = T.StructType.fromDDL(SCHEMAS[kind or name])
    pattern = f"{root}/*/{name}.jsonl"
    if not _exists(spark, pattern):
        empty = spark.createDataFrame([], schema)
        return empty.withColumns(
            {"scene_id": F.lit(None).cast("string"), "ord": F.lit(None).cast("bigint")}
        )
    lines = spark.read.schema(schema).json(pattern)
    folder = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
    # block start in the high part keeps file order across splits of one file
    place = F.col("_metadata.file_block_start") * (1 << 20) + (
        F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    )
    return lines.withColumns({"scene_id": folder, "ord": place})


def box_of(column: str):
    fields = ("xmin", "ymin", "zmin", "xmax", "ymax", "zmax")
    return F.struct(*[F.get(column, F.lit(i)).alias(f) for i, f in enumerate(fields)])


def read_timeline(spark: SparkSession, root: str) -> DataFrame:
    """``<root>/<scene>/timeline.csv``; the host clock falls back to arrival time, then 0."""
    raw = spark.read.option("header", True).option("enforceSchema", False).csv(f"{root}/*/timeline.csv")
    for name in ("host_mono_ns", "arrival_ns"):
        if name not in raw.columns:
            raw = raw.withColumn(name, F.lit(None).cast("string"))
    clock = F.coalesce(
        F.nullif("host_mono_ns", F.lit("")), F.nullif("arrival_ns", F.lit("")), F.lit("0")
    )
    return raw.select(
        F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2).alias("scene_id"),
        F.col("frame_index").cast("bigint").alias("row_no"),
        F.col("sender_ts_ns").cast("bigint").alias("sender_ts_ns"),
        clock.cast("bigint").alias("host_mono_ns"),
        F.col("flags").cast("int").alias("flags"),
    )


# ---- reconstruction files -------------------------------------------------------------------------
# parameters per camera model, as the published file format has them
_CAMERA_PARAMS = {0: 3, 1: 4, 2: 4, 3: 5}
_CAMERA_NAMES = {0: "SIMPLE_PINHOLE", 1: "PINHOLE", 2: "SIMPLE_RADIAL", 3: "RADIAL"}


def _cameras(data: bytes):
    (count,), at = struct.unpack_from("<Q", data), 8
    for _ in range(count):
        ident, model, width, height = struct.unpack_from("<iiQQ", data, at)
        n = _CAMERA_PARAMS[model]
        params = struct.unpack_from(f"<{n}d", data, at + 24)
        at += 24 + 8 * n
        yield {"camera_id": ident, "model": _CAMERA_NAMES[model], "width": width, "height": height,
               "params": list(params)}


def _images(data: bytes):
    (count,), at = struct.unpack_from("<Q", data), 8
    for _ in range(count):
        ident, *pose, camera = struct.unpack_from("<i7di", data, at)
        end = data.index(b"\0", at + 64)
        (points,) = struct.unpack_from("<Q", data, end + 1)
        name, at = data[at + 64 : end].decode(), end + 9 + 24 * points
        yield {"image_id": ident, **dict(zip(("qw", "qx", "qy", "qz", "tx", "ty", "tz"), pose)),
               "camera_id": camera, "frame": name}


def _points(data: bytes):
    (count,), at = struct.unpack_from("<Q", data), 8
    for _ in range(count):
        x, y, z = struct.unpack_from("<3d", data, at + 8)
        (track,) = struct.unpack_from("<Q", data, at + 43)
        at += 51 + 8 * track
        yield {"x": x, "y": y, "z": z, "track_len": track}


_DECODERS = {
    "cameras": (_cameras, "camera_id int, model string, width bigint, height bigint, params array<double>"),
    "images": (_images, "image_id int, qw double, qx double, qy double, qz double, tx double, ty double, "
                        "tz double, camera_id int, frame string"),
    "points3D": (_points, "x double, y double, z double, track_len bigint"),
}
_SLICE = 50_000


def read_reconstruction(spark: SparkSession, root: str, name: str) -> DataFrame:
    """``<root>/<scene>/sparse/<model>/<name>.bin`` of all scenes; one task decodes one file."""
    decode, ddl = _DECODERS[name]
    schema = T.StructType.fromDDL(f"scene_id string, model int, {ddl}")

    def run(batches):
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                parts, rows = path.split("/"), []
                for row in decode(content):
                    rows.append({"scene_id": parts[-4], "model": int(parts[-2]), **row})
                    if len(rows) == _SLICE:
                        yield pd.DataFrame(rows)
                        rows = []
                if rows:
                    yield pd.DataFrame(rows)

    files = spark.read.format("binaryFile").load(f"{root}/*/sparse/*/{name}.bin")
    return files.select("path", "content").mapInPandas(run, schema)


# ---- reports, dumps, frames ------------------------------------------------------------------------


def read_confirmed(spark: SparkSession, root: str) -> DataFrame:
    """Confirmed nodes of all scenes from their nested report."""
    raw = spark.read.schema(CONFIRMED).option("multiLine", True).json(f"{root}/*/confirmed_nodes.json")
    return raw.select(
        F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2).alias("scene_id"),
        F.posexplode("confirmed_nodes").alias("ord", "n"),
    ).select("scene_id", F.col("ord").cast("bigint").alias("ord"), "n.*")


def write_lines(df: DataFrame, folder: str) -> None:
    """Line JSON, one folder per scene."""
    df.write.mode("overwrite").partitionBy("scene_id").json(folder)


def write_memory(nodes: DataFrame, relations: DataFrame, folder: str) -> None:
    """Nodes and active relations as two tables, one folder per scene."""
    nodes.write.mode("overwrite").partitionBy("scene_id").json(f"{folder}/nodes")
    active = relations.filter(F.col("status") == "active")
    active.write.mode("overwrite").partitionBy("scene_id").json(f"{folder}/relations")


def frame_stream(spark: SparkSession, folder: str, max_files: int = 100) -> DataFrame:
    """Frames arriving as JSON files, with ``epoch_s``; rows without device or time are left out."""
    raw = spark.readStream.schema(FRAME).option("maxFilesPerTrigger", max_files).json(folder)
    return raw.filter(usable_frame()).withColumn(
        "epoch_s", F.unix_micros("ts") / F.lit(1_000_000.0)
    )


def dead_frames(spark: SparkSession, folder: str) -> DataFrame:
    """The rows the frame stream leaves out."""
    return spark.readStream.schema(FRAME).json(folder).filter(~usable_frame())


def usable_frame():
    known = F.col("trigger").isin("auto", "manual", "read")
    return F.coalesce(
        F.col("device_id").isNotNull() & F.col("seq").isNotNull() & F.col("ts").isNotNull() & known,
        F.lit(False),
    )
