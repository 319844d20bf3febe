"""Streams over file folders against the batch operators."""

import time

import pytest
from pyspark.sql import functions as F

from roomgraph.operators import lifecycle, reports
from roomgraph.plans.learning_queries import _ingest_batch, _relation_sightings
from roomgraph.sources.testtables import view
from roomgraph.streaming import flow, gate, keyed

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def frames(spark):
    return view(spark, SF, "a_frames").select("device_id", "seq", "epoch_s", "trigger", "phash").withColumn(
        "hits", F.when(F.col("seq") % 4 == 0, F.concat(F.lit("h"), F.col("seq").cast("string"))).otherwise(""))


def play(spark, parts, write, out):
    """Each of ``parts`` is one micro-batch."""
    for i, part in enumerate(parts):
        part.coalesce(1).write.parquet(f"{out}/in/p{i}")
    source = spark.readStream.schema(parts[0].schema).option("maxFilesPerTrigger", 1).option(
        "recursiveFileLookup", "true").parquet(f"{out}/in")
    query = write(source).option("checkpointLocation", f"{out}/ckpt").trigger(processingTime="400 milliseconds").start()
    total, until, rows = sum(p.count() for p in parts), time.time() + 60, {}
    while query.isActive and time.time() < until and sum(rows.values()) < total:
        rows |= {p["batchId"]: p["numInputRows"] for p in query.recentProgress if p["numInputRows"]}
        time.sleep(0.2)
    failed = query.exception()
    query.stop()
    assert failed is None, failed
    assert sum(rows.values()) == total


def halves(df, column="epoch_s"):
    middle = df.approxQuantile(column, [0.5], 0.0)[0]
    return [df.filter(F.col(column) <= middle), df.filter(F.col(column) > middle)]


def same(got, want):
    assert got.count() == want.count() and got.exceptAll(want).count() == 0


DAYS = 86400.0


def played(spark, parts, stream, out):
    """The whole stream in micro-batches of one part each, then one of a far later row of a device of its
    own, so that the watermark passes all; without that device's row."""
    last = parts[0].limit(1).withColumns({"device_id": F.lit(-1).cast("long"), "seq": F.lit(-1).cast("long"), "epoch_s": F.lit(4e9)})
    for i, part in enumerate([*parts, last]):
        part.coalesce(1).write.parquet(f"{out}/in/p{i}")
        time.sleep(0.05)
    source = spark.readStream.schema(parts[0].schema).option("maxFilesPerTrigger", 1).option(
        "recursiveFileLookup", "true").parquet(f"{out}/in")
    query = (stream(source).writeStream.foreachBatch(keyed.late_writer(f"{out}/out"))
             .option("checkpointLocation", f"{out}/ckpt").trigger(availableNow=True).start())
    assert query.awaitTermination(150)
    assert len([p for p in query.recentProgress if p["numInputRows"]]) == len(parts) + 1
    return tuple(spark.read.parquet(f"{out}/out/{k}").filter("device_id >= 0") for k in ("kept", "dead_letter"))


def jumbled(frames, late_s, parts=5):
    """``frames`` in an order in which none comes after one that is more than ``late_s`` newer."""
    key = F.col("epoch_s") + F.pmod(F.xxhash64("device_id", "seq"), F.lit(1000)) / 1000.0 * late_s
    bounds = frames.select(key.alias("k")).approxQuantile("k", [i / parts for i in range(1, parts)], 0.0)
    at = sum(((key > b).cast("int") for b in bounds), F.lit(0))
    return [frames.filter(at == i) for i in range(parts)]


POLICY = gate.GatePolicy(dup_distance=2, min_interval_s=14400.0, force_distance=7)


def test_rows_out_of_order_change_nothing(spark, frames, tmp_path):
    late_s = 5 * DAYS
    parts = jumbled(frames, late_s)
    orders = [p.agg(F.min("epoch_s"), F.max("epoch_s")).head() for p in parts]
    assert all(b[0] < a[1] for a, b in zip(orders[:-1], orders[1:]))  # they do overlap
    wants = {
        "gate": (lambda s: keyed.gate_stream(s, POLICY, late_s), gate.replay(frames.drop("hits"), POLICY),
                 ["device_id", "seq", "reject_reason", "hash_distance", "since_last_call_s"]),
        "kb": (lambda s: keyed.context_stream(s, DAYS, late_s), flow.context_asof(frames.drop("hits"), frames, DAYS),
               ["seq", "kb_context"]),
        "rate": (lambda s: keyed.rate_stream(s, 86400, 2, late_s), flow.request_rates(frames.select(
            F.col("device_id").alias("session_id"), "seq", F.col("epoch_s").alias("t_s")), 86400, 2), ["seq", "n_recent", "limited"]),
    }
    for name, (stream, want, cols) in wants.items():
        kept, dead = played(spark, parts, stream, str(tmp_path / name))
        assert dead.count() == 0
        same(kept.select(*cols), want.select(*cols))
        assert kept.filter(F.col(cols[2 if name == "gate" else 1]).isNotNull()).count() > 10


def test_rows_behind_the_watermark_come_back_marked(spark, frames, tmp_path):
    early, rest = halves(frames)
    newest = rest.agg(F.max("epoch_s")).head()[0]
    late = early.filter((F.col("seq") % 50 == 0) & (F.col("epoch_s") < newest - 3600))
    ids = [r.seq for r in late.collect()]
    in_time = frames.filter(~F.col("seq").isin(ids))
    odd = late.limit(1).withColumns({"epoch_s": F.lit(None).cast("double"), "seq": F.lit(-7).cast("long")})
    kept, dead = played(spark, [early.filter(~F.col("seq").isin(ids)), rest, late.unionByName(odd)],
                        lambda s: keyed.gate_stream(s, POLICY, 3600.0), str(tmp_path))
    assert ids and sorted(r.seq for r in dead.collect()) == sorted([*ids, -7])
    assert [r.epoch_s for r in dead.filter("seq = -7").collect()] == [None]
    cols = ["device_id", "seq", "reject_reason", "hash_distance"]
    same(kept.select(*cols), gate.replay(in_time, POLICY).select(*cols))


def test_order_ties_and_forgetting(spark, tmp_path):
    schema = "device_id long, seq long, epoch_s double, hits string"
    rows = [[(1, 2, 100.0, "A")], [(1, 4, 50.0, "B"), (1, 3, 120.0, ""), (1, 1, 100.0, "")], [(1, 5, 120.0, "C"), (2, 1, 200.0, None)],
            [(1, 6, 900.0, "")], [(1, 7, 900.0, "")], [(2, 9, 9000.0, "")], [(1, 8, 9001.0, "")]]
    parts = [spark.createDataFrame(r, schema) for r in rows]
    kept, _ = played(spark, parts, lambda s: keyed.context_stream(s, 60.0, 100.0), str(tmp_path / "kb"))
    assert {(r.device_id, r.seq): r.kb_context for r in kept.collect()} == {
        (1, 4): None, (1, 1): "B", (1, 2): "B", (1, 3): "A", (1, 5): "A", (1, 6): None, (1, 7): None, (1, 8): None,
        (2, 1): None, (2, 9): None}
    kept, _ = played(spark, parts, lambda s: keyed.rate_stream(s, 60, 2, 100.0), str(tmp_path / "rate"))
    assert {(r.device_id, r.seq): (r.n_recent, r.limited) for r in kept.filter("device_id = 1").collect()} == {
        (1, 4): (1, False), (1, 1): (3, True), (1, 2): (3, True), (1, 3): (4, True), (1, 5): (4, True), (1, 6): (2, False),
        (1, 7): (2, False), (1, 8): (1, False)}


def test_latency_histograms_of_windows(spark, frames, tmp_path):
    rows = frames.select("device_id", "seq", "epoch_s").withColumns({
        "ts": F.timestamp_seconds("epoch_s"), "latency_ms": F.pmod(F.xxhash64("seq"), F.lit(9000))})
    key = [F.unix_seconds("window.start").alias("start_s"), "le", "n"]
    want = flow.windowed_latency(rows, "1 day")
    late_s, out = 5 * DAYS, str(tmp_path)
    parts = jumbled(rows, late_s)
    last = rows.limit(1).withColumns({"ts": F.timestamp_seconds(F.lit(4e9)), "latency_ms": F.lit(1).cast("long")})
    for i, part in enumerate([*parts, last]):
        part.coalesce(1).write.parquet(f"{out}/in/p{i}")
    source = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{out}/in")
    query = flow.windowed_latency(source, "1 day", f"{int(late_s)} seconds").writeStream.format("parquet").option(
        "path", f"{out}/out").option("checkpointLocation", f"{out}/ckpt").trigger(availableNow=True).start()
    assert query.awaitTermination(150) and query.exception() is None
    got = spark.read.parquet(f"{out}/out")
    same(got.select(*key), want.select(*key))
    p95 = [reports.histogram_percentile(h, ["window"], 0.95) for h in (got, want)]
    same(*p95)


def test_newest_and_liveness(spark, frames, tmp_path):
    out = str(tmp_path / "new")
    play(spark, halves(frames), lambda s: s.writeStream.foreachBatch(keyed.newest_writer(f"{out}/out")), out)
    got = spark.read.parquet(f"{out}/out").groupBy("device_id").agg(F.max("seq").alias("seq"), (F.sum("dropped") + F.count("*")).alias("n"))
    same(got, frames.groupBy("device_id").agg(F.max("seq").alias("seq"), F.count("*").alias("n")))
    out = str(tmp_path / "live")
    play(spark, halves(frames), lambda s: keyed.liveness_stream(s, 3600.0).writeStream.format("parquet").option("path", f"{out}/out"), out)
    got = spark.read.parquet(f"{out}/out").filter("online").groupBy("device_id").agg(F.max("seen_s").alias("last_seen_s"))
    same(got, flow.liveness(frames, F.lit(0.0)).select("device_id", "last_seen_s"))


def files(spark, folder):
    return {r.f for r in spark.read.format("binaryFile").option("recursiveFileLookup", "true").option(
        "pathGlobFilter", "*.parquet").load(folder).select(F.col("path").alias("f")).collect()}


def test_tables_kept_by_batches(spark, tmp_path):
    seen = _relation_sightings(spark, SF)
    out = str(tmp_path / "relations")
    merge = lambda b, old: lifecycle.upsert_relations(b, old, 2)
    play(spark, halves(seen, "ord"),
         lambda s: s.writeStream.foreachBatch(keyed.upsert_writer(f"{out}/out", lifecycle.RELATION, merge, 16)), out)
    flat = lambda d: d.withColumn("view_tags", F.map_entries("view_tags"))
    want = flat(lifecycle.upsert_relations(seen, min_confirmations=2))
    same(flat(keyed.version(spark, f"{out}/out", 1)).select(*want.columns), want)

    objects = _ingest_batch(spark, SF)
    out = str(tmp_path / "objects")
    play(spark, halves(objects, "ord"), lambda s: s.writeStream.foreachBatch(
        keyed.upsert_writer(f"{out}/out", ["scene_id", "node_id"], lifecycle.ingest_objects, 16)), out)
    flat = lambda d: d.withColumn("attributes", F.sort_array(F.map_entries("attributes")))
    want = flat(lifecycle.ingest_objects(objects))
    same(flat(keyed.version(spark, f"{out}/out", 1)).select(*want.columns), want)


def test_a_batch_rewrites_its_own_buckets(spark, tmp_path):
    schema, out = "k long, n long", str(tmp_path)
    batches = [[(k, 1) for k in range(200)], [(3, 5), (None, 1)], [], [(3, 7), (4, 1), (None, 2)], [(3, 1)]]
    want: dict = {}

    def merge(batch, old):
        rows = batch if old is None else batch.unionByName(old)
        return rows.groupBy("k").agg(F.sum("n").alias("n"))

    write = keyed.upsert_writer(out, ["k"], merge, 64)
    for number, rows in enumerate(batches):
        before = files(spark, f"{out}/data") if number else set()
        for k, n in rows:
            want[k] = want.get(k, 0) + n
        for _ in range(2):  # a batch that runs again changes nothing
            write(spark.createDataFrame(rows, schema), number)
            assert {r.k: r.n for r in keyed.version(spark, out, number).collect()} == want
        if number:  # as many new files as keys, all others as they were
            assert len(files(spark, f"{out}/data") - before) <= len(rows)
    held = {f"batch={r.batch}/bucket={r.bucket}" for n in (3, 4) for r in keyed._manifest(spark, out, n).collect()}
    assert {"/".join(f.split("/")[-3:-1]) for f in files(spark, f"{out}/data")} == held
    with pytest.raises(ValueError):
        keyed.upsert_writer(out, ["k"], merge, 8)(spark.createDataFrame([(1, 1)], schema), 5)
