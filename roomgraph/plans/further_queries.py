"""Registered queries: evaluation, node lifecycle and text helpers in use."""

from __future__ import annotations

from pyspark.sql import functions as F

from roomgraph.fixed_values import E2E_BUCKETS, FILTERED_TEXT
from roomgraph.functions import answers as a
from roomgraph.functions import geometry as g
from roomgraph.operators import assemble, lifecycle, relations, reports, scaling, search
from roomgraph.plans.catalog import query
from roomgraph.plans.learning_queries import _line_order, _named_nodes
from roomgraph.plans.question_queries import _NODES_SQL, _keywords_sql, _locate_sql, memory
from roomgraph.plans.stream_queries import lit
from roomgraph.sources import testtables as t
from roomgraph.streaming import flow

PROMPT = "You look at one picture of a room and say what stands where, in plain words and without any names."


# ---- poses and boxes ----------------------------------------------------------------------------


@query("pose_from_quaternion", """
SELECT scene_id, frame_no, round(r00,6)+0.0 AS r00, round(r02,6)+0.0 AS r02, round(r11,6)+0.0 AS r11, round(r20,6)+0.0 AS r20, round(tx,6)+0.0 AS tx FROM {a_poses}""")
def pose_from_quaternion(spark, sf):
    """Poses rebuilt from their quaternions are the poses."""
    p = t.poses(spark, sf).withColumn("q", g.quaternion_from_pose(F.col("pose")))
    q = [F.col(f"q.{c}") for c in ("qx", "qy", "qz", "qw")]
    back = g.pose_from_quaternion(*q, *[F.col(f"pose.{c}") for c in ("tx", "ty", "tz")])
    return p.withColumn("b", back).select(
        "scene_id", "frame_no", *[(F.round(f"b.{c}", 6) + 0.0).alias(c) for c in ("r00", "r02", "r11", "r20", "tx")])


@query("neighbour_order", """
SELECT a.scene_id, a.ord, CASE WHEN (a.zmin+a.zmax)/2-(b.zmin+b.zmax)/2>0.02 THEN 'above' WHEN (b.zmin+b.zmax)/2-(a.zmin+a.zmax)/2>0.02 THEN 'below' END AS vertical,
 sqrt(pow((a.xmin+a.xmax)/2-(b.xmin+b.xmax)/2,2)+pow((a.ymin+a.ymax)/2-(b.ymin+b.ymax)/2,2)+pow((a.zmin+a.zmax)/2-(b.zmin+b.zmax)/2,2))<=1.0 AS near,
 round(sqrt(pow((a.xmin+a.xmax)/2-(b.xmin+b.xmax)/2,2)+pow((a.ymin+a.ymax)/2-(b.ymin+b.ymax)/2,2)),6) AS flat
FROM {a_objects} a JOIN {a_objects} b ON a.scene_id=b.scene_id AND b.ord=a.ord+1""")
def neighbour_order(spark, sf):
    """Each object against the next one of its scene."""
    o = t.objects(spark, sf).select("scene_id", "ord", "box")
    after = o.select("scene_id", (F.col("ord") - 1).alias("ord"), F.col("box").alias("other"))
    x, y = F.col("box"), F.col("other")
    return o.join(after, ["scene_id", "ord"]).select(
        "scene_id", "ord", relations.vertical_order(x, y).alias("vertical"),
        relations.is_near(x, y).alias("near"),
        F.round(g.horizontal_distance(g.box_center(x), g.box_center(y)), 6).alias("flat"))


# ---- views and votes ----------------------------------------------------------------------------

_SEEN = """
 v AS (SELECT scene_id, instance_id AS node_id, k1*100000000000+k2*10000000000+k3*10000+k4 AS "view", concat(color,' ',class) AS view_text, CASE WHEN k4%7=0 THEN '' ELSE color END AS color FROM {a_instance_obs})"""


def _seen(spark, sf):
    return t.view(spark, sf, "a_instance_obs").select(
        "scene_id", F.col("instance_id").alias("node_id"), (F.col("k1") * 10**11 + F.col("k2") * 10**10 + F.col("k3") * 10000 + F.col("k4")).alias("view"),
        F.concat_ws(" ", "color", "class").alias("view_text"),
        F.when(F.col("k4") % 7 == 0, "").otherwise(F.col("color")).alias("color"))


@query("latest_view_text", f"WITH {_SEEN} SELECT scene_id, node_id, arg_max(view_text, \"view\") AS layer1_text FROM v GROUP BY 1,2")
def latest_view_text(spark, sf):
    return assemble.latest_view_text(_seen(spark, sf))


@query("last_color", f"WITH {_SEEN} SELECT scene_id, node_id, arg_max(color, \"view\") AS color FROM v WHERE color<>'' GROUP BY 1,2")
def last_color(spark, sf):
    return assemble.last_color(_seen(spark, sf))


@query("consensus_text", """
SELECT node_id, concat_ws('，', CASE WHEN j%2=0 AND j%3=0 THEN concat(color,'的',label) WHEN j%2=0 THEN label WHEN j%3=0 THEN concat('颜色',color) END,
 concat('约 ',CAST(round_even((xmax-xmin)*100,0) AS INT),'×',CAST(round_even((ymax-ymin)*100,0) AS INT),'×',CAST(round_even((zmax-zmin)*100,0) AS INT),' 厘米')) AS line FROM {a_objects}""")
def consensus_text(spark, sf):
    o = t.objects(spark, sf)
    line = assemble.consensus_text(
        F.col("label"), F.col("j") % 2 == 0, F.col("color"), F.col("j") % 3 == 0, g.box_dims_cm(F.col("box")))
    return o.select("node_id", line.alias("line"))


@query("majority_vote", """
SELECT scene_id, class, count(*) FILTER (WHERE conf>0.9)>=2 AS sure, count(*) FILTER (WHERE s>0.4)>=2 AS large FROM {a_sightings} GROUP BY 1,2""")
def majority_vote(spark, sf):
    v = t.view(spark, sf, "a_sightings").select(
        "scene_id", "class", (F.col("conf") > 0.9).alias("sure"), (F.col("s") > 0.4).alias("large"))
    return reports.majority(v, ["scene_id", "class"], ["sure", "large"])


@query("frame_sampling", """
SELECT scene_id, frame_no FROM (SELECT scene_id, frame_no, row_number() OVER (PARTITION BY scene_id ORDER BY frame_no) AS rn FROM {a_poses}) f WHERE (rn-1)%3=0""")
def frame_sampling(spark, sf):
    return scaling.every_step(t.view(spark, sf, "a_poses"), ["scene_id"], "frame_no", 3).select("scene_id", "frame_no")


# ---- evaluation ---------------------------------------------------------------------------------


@query("located_first", "WITH" + _keywords_sql("{a_lookups}", "text") + "," + _NODES_SQL + "," + _locate_sql() + """,
 top AS (SELECT query_id, node_id FROM hits QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, confidence DESC, ord)=1),
 truth AS (SELECT q.query_id, list(o.node_id) FILTER (WHERE q.query_id%6<>3 AND o.label=p.label) AS expect FROM {a_lookups} q JOIN {a_objects} p ON p.ord=q.query_id JOIN {a_objects} o ON o.scene_id=q.scene_id GROUP BY 1)
SELECT t.query_id, CASE WHEN coalesce(len(expect),0)=0 THEN node_id IS NULL ELSE coalesce(list_contains(expect, node_id), false) END AS pass FROM truth t LEFT JOIN top USING (query_id)""")
def located_first(spark, sf):
    """Is the first hit one of the things that bear the asked-for label?"""
    asked, o = t.view(spark, sf, "a_lookups"), t.view(spark, sf, "a_objects")
    own = o.select(F.col("ord").alias("query_id"), F.col("label").alias("_own"))
    like = o.select("scene_id", F.col("label").alias("_own"), "node_id").groupBy("scene_id", "_own").agg(
        F.collect_set("node_id").alias("ids"))
    truth = scaling.shuffled(asked).join(own, "query_id").join(scaling.shuffled(like), ["scene_id", "_own"]).select(
        "query_id", F.when(F.col("query_id") % 6 == 3, F.array().cast("array<string>")).otherwise(F.col("ids")).alias("expect"))
    first = search.locate_ranked(asked, memory(spark, sf), 1)
    return reports.judge_located(truth, first).select("query_id", "pass")


@query("naming_checks", """
WITH n AS (SELECT node_id, label AS said, j%3<>0 AS agreed, CASE j%4 WHEN 0 THEN label WHEN 1 THEN 'not_cup' WHEN 2 THEN 'no_mouse' ELSE 'chair' END AS expect FROM {a_objects})
SELECT node_id, CASE WHEN expect IN ('laptop','cup','mouse','bed','chair','fan') THEN agreed AND lower(said)=expect WHEN expect='not_cup' THEN NOT agreed OR lower(said)<>'cup' WHEN expect='no_mouse' THEN NOT agreed OR lower(said)<>'mouse' ELSE false END AS pass FROM n""")
def naming_checks(spark, sf):
    o = t.view(spark, sf, "a_objects")
    expect = F.when(F.col("j") % 4 == 0, F.col("label")).when(F.col("j") % 4 == 1, "not_cup").when(
        F.col("j") % 4 == 2, "no_mouse").otherwise("chair")
    return o.select("node_id", reports.naming_pass(F.col("label"), F.col("j") % 3 != 0, expect).alias("pass"))


@query("run_report", """
WITH r AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY latency_ms) AS rn, count(*) OVER (PARTITION BY model) AS k FROM {a_model_log})
SELECT model, round(avg(CASE WHEN call_outcome='ok' THEN 1.0::DOUBLE ELSE 0.0 END),6) AS pass_rate, min(latency_ms) AS min_ms, round(avg(latency_ms),6) AS mean_ms, round(median(latency_ms),6) AS p50_ms,
 max(CASE WHEN rn=least(k-1, CAST(floor(k*0.95::DOUBLE) AS BIGINT))+1 THEN latency_ms END) AS p95_ms, max(latency_ms) AS max_ms,
 CAST(sum(prompt_tokens) AS BIGINT) AS prompt_tokens, CAST(sum(completion_tokens) AS BIGINT) AS completion_tokens, CAST(sum(prompt_tokens+completion_tokens) AS BIGINT) AS total_tokens FROM r GROUP BY 1""")
def run_report(spark, sf):
    calls = t.view(spark, sf, "a_model_log").withColumn("passed", F.col("call_outcome") == "ok")
    out = reports.run_report(calls, ["model"])
    return out.select("model", F.round("pass_rate", 6).alias("pass_rate"), "min_ms", F.round("mean_ms", 6).alias("mean_ms"),
                      F.round("p50_ms", 6).alias("p50_ms"), "p95_ms", "max_ms", "prompt_tokens", "completion_tokens", "total_tokens")


# ---- lifecycle ----------------------------------------------------------------------------------


@query("touched_nodes", """
WITH s AS (SELECT concat('obj_', CAST(l_partkey AS VARCHAR)) AS node_id, l_orderkey*100000000000+l_linenumber*10000000000+l_partkey*10000+l_suppkey AS ord, CAST(l_suppkey AS BIGINT) AS t_s FROM {lineitem})
SELECT o.node_id, greatest(max(t_s), max(o.j)) AS last_seen_s, arg_max(t_s, s.ord) AS last_updated_s FROM {a_objects} o JOIN s ON s.node_id=o.node_id GROUP BY 1""")
def touched_nodes(spark, sf):
    nodes = t.view(spark, sf, "a_objects").select(
        "scene_id", "node_id", F.col("j").cast("long").alias("last_seen_s"), F.lit(None).cast("long").alias("last_updated_s"))
    seen = t.view(spark, sf, "lineitem").select(
        F.concat(F.lit("obj_"), F.col("l_partkey").cast("string")).alias("node_id"), _line_order().alias("ord"),
        F.col("l_suppkey").cast("long").alias("t_s")).join(nodes.select("scene_id", "node_id"), "node_id")
    return lifecycle.touch(nodes, seen).filter("last_updated_s is not null").select("node_id", "last_seen_s", "last_updated_s")


@query("ingested_relations", """
SELECT node_id AS subject, 'on' AS predicate, concat('sup_', CAST(j%5 AS VARCHAR)) AS object FROM {a_objects} WHERE j%4<>0
UNION ALL SELECT node_id, 'in', 'room_1' FROM {a_objects}""")
def ingested_relations(spark, sf):
    batch = t.view(spark, sf, "a_objects").select(
        "scene_id", "node_id", "ord", F.col("conf").alias("confidence"), F.col("j").alias("t_s"), F.lit("room_1").alias("room_id"),
        F.when(F.col("j") % 4 == 0, "").otherwise(F.concat(F.lit("sup_"), (F.col("j") % 5).cast("string"))).alias("support_id"))
    return lifecycle.ingest_relations(batch).select("subject", "predicate", "object")


_OBSERVED = """
 o AS (SELECT scene_id, ord, CASE WHEN j%6=0 THEN ' ' ELSE concat(' ',label) END AS object_name, CASE j%3 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE 'table ' END AS support_name FROM {a_objects})"""


def _observed(spark, sf):
    o = t.view(spark, sf, "a_objects")
    return o.select(
        "scene_id", "ord", F.col("j").alias("t_s"), F.col("conf").alias("confidence"),
        F.when(F.col("j") % 6 == 0, " ").otherwise(F.concat(F.lit(" "), "label")).alias("object_name"),
        F.when(F.col("j") % 3 == 1, "").when(F.col("j") % 3 == 2, "table ").alias("support_name"))


@query("observed_nodes", f"""
WITH {_OBSERVED} SELECT scene_id, ord, concat('seen_',trim(object_name)) AS node_id, 'object' AS node_type FROM o WHERE trim(object_name)<>''
UNION ALL SELECT scene_id, ord, concat('seen_',trim(support_name)), 'anchor' FROM o WHERE trim(object_name)<>'' AND trim(support_name)<>''""")
def observed_nodes(spark, sf):
    return lifecycle.observed_rows(_observed(spark, sf))[0].select("scene_id", "ord", "node_id", "node_type")


@query("observed_edges", f"""
WITH {_OBSERVED} SELECT scene_id, ord, concat('seen_',trim(object_name)) AS subject, 'on' AS predicate, concat('seen_',trim(support_name)) AS object FROM o WHERE trim(object_name)<>'' AND trim(support_name)<>''""")
def observed_edges(spark, sf):
    return lifecycle.observed_rows(_observed(spark, sf))[1].select("scene_id", "ord", "subject", "predicate", "object")


# ---- answers and logs ---------------------------------------------------------------------------


@query("recheck", """
SELECT device_id, seq, twice AS second_call, CASE WHEN twice THEN 'low' ELSE risk END AS risk_level, CASE WHEN twice THEN prompt_tokens+7 ELSE prompt_tokens END AS prompt_tokens,
 CASE WHEN twice THEN latency_ms+5 ELSE latency_ms END AS latency_ms FROM (
 SELECT *, risk='high' AND kb='' AND words>0 AND seq%2=0 AND trigger<>'read' AS twice FROM (
  SELECT *, CASE WHEN seq%3=0 THEN 'high' ELSE 'low' END AS risk, CASE WHEN seq%5=0 THEN 'known' ELSE '' END AS kb, seq%4 AS words FROM {a_model_log}) a) b""")
def recheck(spark, sf):
    log = t.view(spark, sf, "a_model_log")
    words = F.array_repeat(F.lit("w"), (F.col("seq") % 4).cast("int")).alias("keywords")
    first = log.select(
        "device_id", "seq", "trigger", "degraded", "prompt_tokens", "completion_tokens", "latency_ms",
        F.when(F.col("seq") % 5 == 0, "known").otherwise("").alias("kb_context"),
        F.struct(F.when(F.col("seq") % 3 == 0, "high").otherwise("low").alias("risk_level"), words).alias("result"))
    second = log.filter(F.col("seq") % 2 == 0).select(
        "device_id", "seq", F.lit(False).alias("degraded"), F.lit(7).cast("long").alias("prompt_tokens"),
        F.lit(0).cast("long").alias("completion_tokens"), F.lit(5).cast("long").alias("latency_ms"),
        F.struct(F.lit("low").alias("risk_level"), words).alias("result"))
    return flow.with_recheck(first, second).select(
        "device_id", "seq", "second_call", F.col("result.risk_level").alias("risk_level"), "prompt_tokens", "latency_ms")


@query("outcomes_by_minute", """
SELECT CAST(floor(epoch_s/60)*60 AS BIGINT) AS start_s, call_outcome AS outcome, count(*) AS n, CAST(sum(latency_ms) AS BIGINT) AS latency_ms FROM {a_model_log} GROUP BY 1,2""")
def outcomes_by_minute(spark, sf):
    frames = t.view(spark, sf, "a_model_log").select(
        F.timestamp_micros((F.col("epoch_s") * 1e6).cast("long")).alias("ts"), F.col("call_outcome").alias("outcome"), "latency_ms")
    return flow.windowed_counts(frames).select(
        F.unix_seconds("window.start").alias("start_s"), "outcome", "n", "latency_ms")


_BOUNDS = ", ".join(str(b) for b in E2E_BUCKETS)
_HISTOGRAM = f"""
 b AS (SELECT unnest([{_BOUNDS}, CAST('inf' AS DOUBLE)]) AS le), w AS (SELECT CAST(floor(epoch_s/3600)*3600 AS BIGINT) AS start_s, latency_ms/1000.0::DOUBLE AS s FROM {{a_model_log}}),
 h AS (SELECT start_s, le, CAST(count(*) FILTER (s <= le) AS BIGINT) AS n FROM w, b GROUP BY 1, 2)"""


def _latency_windows(spark, sf):
    return flow.windowed_latency(t.view(spark, sf, "a_model_log").select(
        F.timestamp_micros((F.col("epoch_s") * 1e6).cast("long")).alias("ts"), "latency_ms"), "1 hour")


@query("latency_by_hour", f"WITH {_HISTOGRAM} SELECT start_s, le, n FROM h")
def latency_by_hour(spark, sf):
    return _latency_windows(spark, sf).select(F.unix_seconds("window.start").alias("start_s"), "le", "n")


@query("latency_p95_by_hour", f"""
WITH {_HISTOGRAM} SELECT start_s, min(le) FILTER (n >= 0.95 * m) AS le, max(m) AS n FROM (SELECT *, max(n) OVER (PARTITION BY start_s) AS m FROM h) x GROUP BY 1""")
def latency_p95_by_hour(spark, sf):
    return reports.histogram_percentile(_latency_windows(spark, sf), ["window"], 0.95).select(
        F.unix_seconds("window.start").alias("start_s"), "le", "n")


@query("rejects_logged", """
SELECT device_id, seq, rejected_by AS node, coalesce(reject_reason,'') AS reason, CASE WHEN reject_reason='rate_limit' THEN '' ELSE phash END AS phash, CASE WHEN rejected_by='gate' THEN k END AS since_last_call_s FROM (
 SELECT f.*, CASE WHEN f.bits<2 THEN 'gate' WHEN k%17=0 THEN 'rules' END AS rejected_by, CASE WHEN f.bits<1 THEN 'rate_limit' WHEN f.bits<2 THEN 'duplicate' WHEN k%17=0 THEN 'too_blurry' END AS reject_reason FROM {a_frames} f) r WHERE rejected_by IS NOT NULL""")
def rejects_logged(spark, sf):
    f = t.view(spark, sf, "a_frames")
    by = F.when(F.col("bits") < 2, "gate").when(F.col("k") % 17 == 0, "rules")
    why = F.when(F.col("bits") < 1, "rate_limit").when(F.col("bits") < 2, "duplicate").when(F.col("k") % 17 == 0, "too_blurry")
    frames = f.select(
        "device_id", F.col("seq").alias("thread_id"), by.alias("rejected_by"), why.alias("reject_reason"), "phash",
        F.lit(0).alias("hash_distance"), F.col("k").alias("since_last_call_s"), F.col("epoch_s").alias("created_at"))
    return flow.split_logs(frames)[1].select(
        "device_id", F.col("thread_id").alias("seq"), "node", "reason", "phash", "since_last_call_s")


@query("prompt_hidden", f"""
SELECT seq, replace(replace(concat(raw_text, substr({lit(PROMPT)}, 1, CAST(20+seq%80 AS INT))), substr({lit(PROMPT)}, 1, 40), {lit(FILTERED_TEXT)}), substr({lit(PROMPT)}, 41, 40), {lit(FILTERED_TEXT)}) AS text FROM {{a_answers}}""")
def prompt_hidden(spark, sf):
    leaked = F.concat("raw_text", F.substring(F.lit(PROMPT), F.lit(1), (20 + F.col("seq") % 80).cast("int")))
    return t.view(spark, sf, "a_answers").select("seq", a.hide_prompt(leaked, PROMPT).alias("text"))


@query("capped_texts", """
SELECT doc_id, CASE WHEN length(text)>500 THEN concat(substr(text,1,500),'...') ELSE text END AS text FROM {a_docs}""")
def capped_texts(spark, sf):
    return t.view(spark, sf, "a_docs").select("doc_id", a.cap_agent_text(F.col("text"), 500).alias("text"))


@query("read_texts", """
SELECT seq, CASE WHEN seq%4=0 THEN concat('line ', CAST(seq AS VARCHAR)) WHEN seq%4=1 THEN 'plain words' WHEN seq%4=2 THEN concat('{{"odd": ', CAST(seq AS VARCHAR), '}}') ELSE '' END AS text FROM {a_answers}""")
def read_texts(spark, sf):
    """Reading answers: wrapped, plain, JSON without text, and empty ones."""
    k, seq = F.col("seq") % 4, F.col("seq").cast("string")
    raw = (F.when(k == 0, F.concat(F.lit('```json\n{"full_text": " line '), seq, F.lit(' "}\n```')))
           .when(k == 1, " plain words\n").when(k == 2, F.concat(F.lit('{"odd": '), seq, F.lit("}"))).otherwise("  "))
    return t.view(spark, sf, "a_answers").select("seq", a.parse_read_text(raw).alias("text"))


@query("name_lists", """
SELECT seq, CASE seq%4 WHEN 0 THEN concat('cup|n', CAST(seq AS VARCHAR)) WHEN 1 THEN 'mug' ELSE '' END AS names FROM {a_answers}""")
def name_lists(spark, sf):
    k, seq = F.col("seq") % 4, F.col("seq").cast("string")
    raw = (F.when(k == 0, F.concat(F.lit('Sure: {"objects": [" cup", "", "n'), seq, F.lit('"]} fine?')))
           .when(k == 1, '{"objects": "mug "}').when(k == 2, '{"objects": [').otherwise("none {x}"))
    return t.view(spark, sf, "a_answers").select(
        "seq", F.array_join(F.coalesce(a.name_list(raw, "objects"), F.array()), "|").alias("names"))
