"""Registered queries: node tables, locating, relation questions, texts and answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from roomgraph.fixed_values import NAME_FAMILY, QUESTION_PHRASES, SYNONYMS
from roomgraph.functions import geometry as g
from roomgraph.functions import words as w
from roomgraph.operators import assemble, search
from roomgraph.operators import relations as rel
from roomgraph.operators.scaling import shuffled, top_k
from roomgraph.plans.catalog import query
from roomgraph.plans.scene_queries import NEAR_SQL, ON_SQL, SUPPORT_SQL, _TAG
from roomgraph.sources import testtables as t


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_SYN = ",".join(
    f"({_q(word)},{i},{j},{_q(name)})"
    for i, (word, names) in enumerate(SYNONYMS.items())
    for j, name in enumerate(names)
)


def _keywords_sql(source: str, text: str) -> str:
    """(query_id, scene_id, kw, place) for the texts of a source."""
    return f"""
 syn(word, wi, ni, name) AS (VALUES {_SYN}),
 kw AS (
  SELECT query_id, scene_id, lower(trim({text})) AS kw, [0,0,0] AS place FROM {source} WHERE trim({text})<>''
  UNION ALL
  SELECT q.query_id, q.scene_id, s.name, [1000-length(s.word), s.wi, s.ni] FROM {source} q JOIN syn s ON contains(q.{text}, s.word)
  WHERE NOT EXISTS (SELECT 1 FROM syn o WHERE contains(q.{text}, o.word) AND o.word<>s.word AND contains(o.word, s.word)))"""


_NODES_SQL = """
 nodes AS (SELECT scene_id, ord, node_id, label, label AS category, concat(color,'的',label) AS layer2_text, color AS alias, conf AS confidence,
   xmin,ymin,zmin,xmax,ymax,zmax FROM {a_objects})"""


def _locate_sql(hits: str = "hits", kw: str = "kw") -> str:
    return f"""
 {hits} AS (SELECT k.query_id, k.scene_id, n.node_id, n.ord, n.confidence, max(CASE
    WHEN lower(n.label)=k.kw OR lower(n.category)=k.kw THEN 3
    WHEN contains(lower(concat(n.label,' ',n.category,'  ',n.layer2_text)), k.kw) THEN 2
    WHEN contains(lower(n.alias), k.kw) THEN 1 ELSE 0 END) AS score
  FROM {kw} k JOIN nodes n ON n.scene_id=k.scene_id GROUP BY ALL HAVING score>0)"""


def memory(spark, sf):
    """Object nodes of the test scenes in the shape of the node table."""
    o = t.objects(spark, sf)
    return o.select(
        "scene_id", "ord", "node_id", "label", w.class_family(F.col("label")).alias("category"),
        F.lit("").alias("layer1_text"), F.concat("color", F.lit("的"), "label").alias("layer2_text"),
        F.array("color").alias("aliases"), F.col("conf").alias("confidence"), "box",
        F.lit(None).cast("struct<x:double,y:double,z:double>").alias("center"),
        F.lit("object").alias("node_type"), F.lit(None).cast("string").alias("parent_id"),
    )


def edges(spark, sf):
    """on, near and on-support edges of the test scenes."""
    o, s = t.objects(spark, sf), t.supports(spark, sf)
    cols = ["scene_id", "subject", "predicate", "object", "confidence"]
    return (
        rel.on_edges(o).select(*cols)
        .unionByName(rel.near_edges(o).select(*cols))
        .unionByName(rel.support_edges(o, s).select(*cols))
        .withColumn("status", F.lit("active"))
    )


def viewers(spark, sf):
    """The last pose of each scene."""
    return (
        t.poses(spark, sf).groupBy("scene_id")
        .agg(F.max_by("pose", "frame_no").alias("pose"))
    )


_EDGES_SQL = f"""
 edges AS (SELECT scene_id, subject, 'on' AS predicate, object FROM ({ON_SQL}) a
  UNION ALL SELECT scene_id, subject, 'near', object FROM ({NEAR_SQL}) b
  UNION ALL SELECT scene_id, subject, 'on', object FROM ({SUPPORT_SQL}) c)"""


@query("memory_nodes", """
WITH box AS (SELECT scene_id, min(x) AS xmin, min(y) AS ymin, max(x) AS xmax, max(y) AS ymax, max(z) AS zmax FROM {a_points} GROUP BY 1),
 n AS (SELECT scene_id, 'room_1' AS node_id, 'room' AS node_type, '室内' AS label, 'indoor_scene' AS category, CAST(NULL AS VARCHAR) AS parent_id, 1.0::DOUBLE AS confidence, '' AS aliases, round((xmax-xmin)*(ymax-ymin)*(zmax-0.0),6) AS volume FROM box
 UNION ALL SELECT scene_id, support_id, 'anchor', 'support_surface', 'support_surface', 'room_1', 0.8::DOUBLE, '', round((xmax-xmin)*(ymax-ymin)*(zmax-zmin),6) FROM {a_supports}
 UNION ALL SELECT scene_id, node_id, 'object', label, label, 'room_1', conf, concat(label,',',color), round((xmax-xmin)*(ymax-ymin)*(zmax-zmin),6) FROM {a_objects})
SELECT scene_id, node_id, node_type, label, category, parent_id, round(confidence,6) AS confidence, aliases, volume FROM n""")
def memory_nodes(spark, sf):
    instances = t.objects(spark, sf).select(
        "scene_id", "ord", F.col("node_id").alias("instance_id"), F.col("label").alias("class"),
        w.class_family(F.col("label")).alias("family"), F.array("color").alias("candidate_classes"),
        "box", F.col("conf").alias("median_conf"),
    )
    nodes = assemble.memory_nodes(t.points(spark, sf), None, t.supports(spark, sf), instances)
    b = F.col("box")
    return nodes.select(
        "scene_id", "node_id", "node_type", "label", "category", "parent_id",
        F.round("confidence", 6).alias("confidence"), F.array_join("aliases", ",").alias("aliases"),
        F.round((b.xmax - b.xmin) * (b.ymax - b.ymin) * (b.zmax - b.zmin), 6).alias("volume"),
    )


@query("hierarchy_in", """
SELECT p.node_id, p.label, count(*) AS n_children, min(c.node_id) AS first_child, max(c.label) AS last_label
FROM {a_tree} p JOIN {a_tree} c ON c.parent_id = p.node_id GROUP BY 1,2""")
def hierarchy_in(spark, sf):
    tree = t.view(spark, sf, "a_tree").withColumn("scene_id", F.lit(0))
    kids = search.children_of(tree).join(
        tree.select(F.col("node_id").alias("child_id"), F.col("label").alias("child_label")),
        "child_id",
    )
    return kids.groupBy("node_id", "label").agg(
        F.count(F.lit(1)).alias("n_children"), F.min("child_id").alias("first_child"),
        F.max("child_label").alias("last_label"),
    )


@query("expand_query", "WITH" + _keywords_sql("{a_questions}", "text") + """
SELECT query_id, count(*) AS n_keywords, string_agg(kw, '|' ORDER BY place) AS keywords FROM kw GROUP BY 1""")
def expand_query(spark, sf):
    k = w.expand_question(F.col("text"))
    return (
        t.view(spark, sf, "a_questions").select("query_id", k.alias("k")).filter(F.size("k") > 0)
        .select("query_id", F.size("k").cast("long").alias("n_keywords"),
                F.array_join("k", "|").alias("keywords"))
    )


@query("locate_top", "WITH" + _keywords_sql("{a_lookups}", "text") + "," + _NODES_SQL + "," + _locate_sql() + """
SELECT query_id, rank, node_id, score, round(confidence,6) AS confidence FROM (
 SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, confidence DESC, ord) AS rank FROM hits) r WHERE rank<=3""")
def locate_top(spark, sf):
    ranked = search.locate_ranked(t.view(spark, sf, "a_lookups"), memory(spark, sf), 3)
    return ranked.select(
        "query_id", "rank", "node_id", "score", F.round("confidence", 6).alias("confidence")
    )


@query("relations_of", f"""
WITH {_EDGES_SQL}
SELECT scene_id, node_id, predicate, count(*) AS n, min(subject) AS first_subject, max(object) AS last_object FROM (
 SELECT *, subject AS node_id FROM edges UNION ALL SELECT *, object FROM edges WHERE object<>subject) e GROUP BY 1,2,3""")
def relations_of(spark, sf):
    return search.relations_of(edges(spark, sf)).groupBy("scene_id", "node_id", "predicate").agg(
        F.count(F.lit(1)).alias("n"), F.min("subject").alias("first_subject"),
        F.max("object").alias("last_object"),
    )


_SIDES_SQL = (
    "WITH" + _keywords_sql("{a_lookups}", "subject_hint") + ","
    + _keywords_sql("{a_lookups}", "object_hint").replace("syn(", "syn2(").replace(" syn ", " syn2 ").replace("kw AS (", "kw2 AS (", 1)
    + "," + _NODES_SQL + "," + _locate_sql("s_hits", "kw") + "," + _locate_sql("o_hits", "kw2")
)
_FOUND_SQL = """
SELECT q.query_id, e.object, count(*) AS n FROM {a_lookups} q JOIN edges e ON e.scene_id=q.scene_id AND WANTED
WHERE (q.subject_hint='' OR EXISTS (SELECT 1 FROM s_hits h WHERE h.query_id=q.query_id AND h.node_id=e.subject))
  AND EXISTS (SELECT 1 FROM nodes n WHERE n.scene_id=e.scene_id AND n.node_id=e.object)
  AND (q.object_hint='' OR EXISTS (SELECT 1 FROM o_hits h WHERE h.query_id=q.query_id AND h.node_id=e.object))
GROUP BY 1,2"""
_ABOVE_SQL = """SELECT a.scene_id, a.node_id AS subject, 'above' AS predicate, b.node_id AS object
 FROM {a_objects} a JOIN {a_objects} b ON a.scene_id=b.scene_id AND (a.zmin+a.zmax)/2-(b.zmin+b.zmax)/2>0.02"""


def _objects_found(found):
    return found.groupBy("query_id", "object").agg(F.count(F.lit(1)).alias("n"))


@query("relational_query", _SIDES_SQL + "," + _EDGES_SQL.rstrip().removesuffix(")") + " UNION ALL " + _ABOVE_SQL + ")"
       + _FOUND_SQL.replace("WANTED", "(q.predicate='' OR q.predicate=e.predicate)"))
def relational_query(spark, sf):
    return _objects_found(search.relational(
        t.view(spark, sf, "a_lookups"), memory(spark, sf), edges(spark, sf), upright=True))


@query("relational_above", _SIDES_SQL + ", edges AS (" + _ABOVE_SQL + ")" + _FOUND_SQL.replace("WANTED", "true"))
def relational_above(spark, sf):
    asked = t.view(spark, sf, "a_lookups").withColumn("predicate", F.lit("above"))
    return _objects_found(search.relational(asked, memory(spark, sf), edges(spark, sf), upright=True))


@query("relational_in", _SIDES_SQL + """,
 edges AS (SELECT scene_id, node_id AS subject, concat('obj_', CAST(ord-j AS VARCHAR)) AS object FROM {a_objects} WHERE j%3=1)"""
       + _FOUND_SQL.replace("WANTED", "true"))
def relational_in(spark, sf):
    """Which containers are the named things in? Every third object lies in its scene's first."""
    first = F.concat(F.lit("obj_"), F.floor(F.col("ord") / 50).cast("long") * 50)
    nodes = memory(spark, sf).withColumn(
        "parent_id", F.when(F.col("ord") % 50 % 3 == 1, first))
    asked = t.view(spark, sf, "a_lookups").withColumn("predicate", F.lit("in"))
    return _objects_found(search.relational(asked, nodes, edges(spark, sf)))


_PHRASE = """CASE predicate WHEN 'on' THEN concat('在',lab,'上') WHEN 'above' THEN concat('在',lab,'上方') ELSE concat('在',lab,'附近') END"""
_RELTEXT = f"""
 e AS (
  SELECT scene_id, subject, 'on' AS predicate, object_label, 0.8 AS c, 0 AS stage, object_ord AS partner, 0 AS step FROM ({ON_SQL}) a
  UNION ALL SELECT a.scene_id, a.node_id, 'above', b.label, 0.8, 0, b.ord, 1 FROM {{a_objects}} a JOIN {{a_objects}} b
    ON a.scene_id=b.scene_id AND (a.zmin+a.zmax)/2-(b.zmin+b.zmax)/2>0.02
  UNION ALL SELECT scene_id, subject, 'near', object_label, 0.7, 0, object_ord, 2 FROM ({NEAR_SQL}) b
  UNION ALL SELECT scene_id, subject, 'on', '桌面', 0.75, 1, object_ord, 0 FROM ({SUPPORT_SQL}) c),
 once AS (SELECT scene_id, subject, predicate, object_label AS lab, min([-c, stage, partner, step]) AS key FROM e GROUP BY 1,2,3,4),
 best AS (SELECT *, row_number() OVER (PARTITION BY scene_id, subject ORDER BY key) AS rn FROM once),
 reltext AS (SELECT scene_id, subject AS node_id, string_agg({_PHRASE}, '；' ORDER BY rn) AS relation_text FROM best WHERE rn<=3 GROUP BY 1,2)"""


@query("relation_text", f"WITH {_RELTEXT} SELECT scene_id, node_id, relation_text FROM reltext")
def relation_text(spark, sf):
    return assemble.relation_texts(
        assemble.text_edges(t.objects(spark, sf), t.supports(spark, sf))
    )


_CLEAN = "text"
for _p in QUESTION_PHRASES:
    _CLEAN = f"replace({_CLEAN}, {_q(_p)}, '')"
_FAM = "CASE {x} " + " ".join(f"WHEN {_q(k)} THEN {_q(v)}" for k, v in NAME_FAMILY.items()) + " ELSE lower({x}) END"


def _fam(x: str) -> str:
    return _FAM.replace("{x}", x)


_VIEWER = """
 viewer AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY scene_id ORDER BY frame_no DESC) AS rn FROM {a_poses}) p WHERE rn=1)"""
_ZHTAG = "CASE tag WHEN 'front' THEN '前方' WHEN 'left' THEN '左方' WHEN 'right' THEN '右方' WHEN 'behind' THEN '后方' WHEN 'left_front' THEN '左前方' ELSE '右前方' END"


@query("retrieval_answer", f"WITH cleaned AS (SELECT query_id, scene_id, trim({_CLEAN}) AS q FROM {{a_questions}})," + _keywords_sql("cleaned", "q") + f""",
 {_VIEWER},
 scored AS (SELECT c.query_id, c.scene_id, c.q, n.*, CASE
   WHEN {_fam('n.name')}={_fam('c.q')} OR (n.name<>'' AND (contains(c.q,n.name) OR contains(n.name,c.q))) THEN 3
   WHEN n.label_hint<>'' AND contains(n.label_hint,c.q) THEN 2
   WHEN EXISTS (SELECT 1 FROM kw WHERE kw.query_id=c.query_id AND kw.kw<>'' AND (contains(n.name,kw.kw) OR contains(kw.kw,n.name))) THEN 2
   WHEN n.color<>'' AND (contains(c.q,n.color) OR contains(n.color,c.q)) THEN 1 ELSE 0 END AS score
  FROM cleaned c JOIN {{a_memory}} n ON n.scene_id=c.scene_id WHERE c.q<>''),
 ranked AS (SELECT *, max(score) OVER (PARTITION BY query_id) AS top, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, confidence DESC, ord) AS rk FROM scored WHERE score>0),
 kept AS (SELECT r.*, r00, r10, r20, r01, r11, r21, tx, ty, tz FROM ranked r LEFT JOIN viewer v ON v.scene_id=r.scene_id
   WHERE rk<=3 AND (score>=2 OR (top=1 AND length(q)<=3 AND suffix(q,'色')))),
 ego AS (SELECT *, degrees(atan2(ly,lx)) AS b, sqrt(lx*lx+ly*ly) AS d FROM (SELECT *, r00*(x-tx)+r10*(y-ty)+r20*(z-tz) AS lx, r01*(x-tx)+r11*(y-ty)+r21*(z-tz) AS ly FROM kept) e),
 lines AS (SELECT query_id, rk, concat(CASE WHEN color<>'' THEN concat(color,'的',name) ELSE name END, '：',
   CASE WHEN x IS NOT NULL AND tx IS NOT NULL THEN concat('在', {_ZHTAG}, '约 ', CAST(round_even(d,1) AS DECIMAL(18,1)), ' 米（', source, '确认，置信 ', CAST(round_even(confidence*100,0) AS INTEGER), '%）')
        WHEN x IS NOT NULL THEN concat('位置坐标 [', CAST(round_even(x,2) AS DOUBLE), ', ', CAST(round_even(y,2) AS DOUBLE), ', ', CAST(round_even(z,2) AS DOUBLE), ']（', source, '确认）')
        ELSE concat('在场景中见过（', source, '确认，置信 ', CAST(round_even(confidence*100,0) AS INTEGER), '%）') END) AS line
   FROM (SELECT *, {_TAG} AS tag FROM ego) e2),
 texts AS (SELECT query_id, concat('根据记忆，', string_agg(line, '；' ORDER BY rk)) AS answer FROM lines GROUP BY 1)
SELECT q.query_id, t.answer IS NOT NULL AS found, t.answer IS NULL AS fallback_used,
  CASE WHEN t.answer IS NOT NULL THEN t.answer WHEN trim(q.text)='' THEN '' ELSE '记忆中没找到，让我看看画面' END AS answer
FROM {{a_questions}} q LEFT JOIN texts t ON t.query_id=q.query_id""")
def retrieval_answer(spark, sf):
    questions = t.view(spark, sf, "a_questions")
    nodes = t.view(spark, sf, "a_memory").withColumn(
        "center", F.when(F.col("x").isNotNull(), g.make_point(F.col("x"), F.col("y"), F.col("z")))
    )
    hits = search.retrieve(questions, nodes, viewers(spark, sf))
    return search.answers(questions, hits).drop("scene_id")


@query("where_is", "WITH" + _keywords_sql("{a_lookups}", "text") + "," + _NODES_SQL + "," + _locate_sql() + "," + _VIEWER + "," + _RELTEXT + f""",
 top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, confidence DESC, ord) AS rank FROM hits) r WHERE rank=1),
 ego AS (SELECT t.query_id, t.scene_id, t.node_id, n.label, n.layer2_text AS layer2,
   r00*((xmin+xmax)/2-tx)+r10*((ymin+ymax)/2-ty)+r20*((zmin+zmax)/2-tz) AS lx,
   r01*((xmin+xmax)/2-tx)+r11*((ymin+ymax)/2-ty)+r21*((zmin+zmax)/2-tz) AS ly
  FROM top t JOIN nodes n ON n.scene_id=t.scene_id AND n.node_id=t.node_id JOIN viewer v ON v.scene_id=t.scene_id),
 tagged AS (SELECT *, degrees(atan2(ly,lx)) AS b, sqrt(lx*lx+ly*ly) AS d FROM ego)
SELECT e.query_id, e.node_id, e.label, e.layer2, {_TAG} AS tag, round(d,6) AS distance, coalesce(r.relation_text,'') AS relation_text
FROM tagged e LEFT JOIN reltext r ON r.scene_id=e.scene_id AND r.node_id=e.node_id""")
def where_is(spark, sf):
    """For every question: the best node, where it is for the viewer, what it is on or near."""
    best = search.locate_ranked(t.view(spark, sf, "a_lookups"), memory(spark, sf), 1)
    seen = search.egocentric_answers(best, viewers(spark, sf))
    texts = assemble.relation_texts(
        assemble.text_edges(t.objects(spark, sf), t.supports(spark, sf))
    )
    return shuffled(seen).join(texts, ["scene_id", "node_id"], "left").select(
        "query_id", "node_id", "label", "layer2", F.col("ego.tag").alias("tag"),
        F.round("ego.distance", 6).alias("distance"),
        F.coalesce("relation_text", F.lit("")).alias("relation_text"),
    )


@query("desk_objects", f"""
WITH {_EDGES_SQL}, desk AS (SELECT scene_id, support_id FROM {{a_supports}} WHERE zmax BETWEEN 0.3 AND 0.9)
SELECT o.scene_id, o.node_id, o.label FROM {{a_objects}} o WHERE EXISTS (
 SELECT 1 FROM edges e JOIN desk d ON d.scene_id=e.scene_id AND d.support_id=e.object
 WHERE e.scene_id=o.scene_id AND e.subject=o.node_id AND e.predicate='on')""")
def desk_objects(spark, sf):
    desk = t.supports(spark, sf).filter(F.col("box.zmax").between(0.3, 0.9)).select(
        "scene_id", F.col("support_id").alias("node_id")
    )
    return assemble.objects_on(memory(spark, sf), edges(spark, sf), desk).select(
        "scene_id", "node_id", "label"
    )


@query("node_by_label", """
SELECT scene_id, label, arg_min(node_id, ord) AS node_id FROM {a_objects} GROUP BY 1,2""")
def node_by_label(spark, sf):
    return assemble.first_by_label(memory(spark, sf))


_SEEN = """
 seen AS (SELECT scene_id, instance_id AS node_id, frame_no*100000000 + k1*10 + k2 AS v, k3, k4, class AS label,
   CASE WHEN k4 % 5 = 0 THEN NULL ELSE color END AS color,
   CAST(5 + k1 % 7 AS INTEGER) AS l_cm, CAST(4 + k3 % 5 AS INTEGER) AS w_cm, CAST(3 + k4 % 3 AS INTEGER) AS h_cm FROM {a_instance_obs})"""


@query("layer2_text", f"""
WITH {_SEEN},
 c AS (SELECT scene_id, node_id, max(color) AS color FROM (SELECT *, row_number() OVER (PARTITION BY scene_id,node_id ORDER BY v DESC,k3 DESC,k4 DESC) AS rn FROM seen WHERE color IS NOT NULL) q WHERE rn<=3
   GROUP BY 1,2 HAVING count(*)>=2 AND count(DISTINCT color)=1),
 z AS (SELECT scene_id, node_id, CAST(round_even(median(l_cm),0) AS INTEGER) AS l, CAST(round_even(median(w_cm),0) AS INTEGER) AS w, CAST(round_even(median(h_cm),0) AS INTEGER) AS h
   FROM (SELECT *, row_number() OVER (PARTITION BY scene_id,node_id ORDER BY v DESC,k3 DESC,k4 DESC) AS rn FROM seen) q WHERE rn<=3 GROUP BY 1,2 HAVING count(*)>=2)
SELECT n.scene_id, n.node_id, concat_ws('，', CASE WHEN color IS NOT NULL THEN concat(color,'的',label) END,
  CASE WHEN l IS NOT NULL THEN concat('约 ',l,'×',w,'×',h,' 厘米') END) AS layer2_text
FROM (SELECT DISTINCT scene_id, node_id, label FROM seen) n LEFT JOIN c ON c.scene_id=n.scene_id AND c.node_id=n.node_id LEFT JOIN z ON z.scene_id=n.scene_id AND z.node_id=n.node_id""")
def layer2_text(spark, sf):
    seen = t.view(spark, sf, "a_instance_obs").select(
        "scene_id", F.col("instance_id").alias("node_id"), F.col("class").alias("label"),
        F.struct((F.col("frame_no") * 100000000 + F.col("k1") * 10 + F.col("k2")).alias("v"),
                 "k3", "k4").alias("view"),
        F.when(F.col("k4") % 5 != 0, F.col("color")).alias("color"),
        (5 + F.col("k1") % 7).cast("int").alias("l_cm"),
        (4 + F.col("k3") % 5).cast("int").alias("w_cm"),
        (3 + F.col("k4") % 3).cast("int").alias("h_cm"),
    )
    return assemble.layer2_texts(seen)


@query("evidence_frames", """
WITH i AS (SELECT scene_id, instance_id, min(frame_no) AS a, max(frame_no) AS b FROM {a_instance_obs} GROUP BY 1,2)
SELECT scene_id, instance_id, view, concat('frame_', lpad(CAST(f AS VARCHAR), 6, '0'), '.jpg') AS frame FROM (
 SELECT scene_id, instance_id, 0 AS view, a AS f FROM i UNION ALL SELECT scene_id, instance_id, 1, a + (b-a)//2 FROM i WHERE a<>b
 UNION ALL SELECT scene_id, instance_id, 2, b FROM i WHERE a<>b) q""")
def evidence_frames(spark, sf):
    spans = t.view(spark, sf, "a_instance_obs").groupBy("scene_id", "instance_id").agg(
        w.frame_name(F.min("frame_no")).alias("first_frame"),
        w.frame_name(F.max("frame_no")).alias("last_frame"),
    )
    return assemble.evidence_frames(spans).select("scene_id", "instance_id", "view", "frame")


@query("consensus_label", """
WITH v AS (SELECT scene_id, instance_id, CASE WHEN k4 % 11 = 0 THEN '不确定' WHEN k4 % 13 = 0 THEN NULL ELSE color END AS c, k1*100000000+k2*10000000+k3*1000+k4 AS o FROM {a_instance_obs}),
 n AS (SELECT scene_id, instance_id, count(*) AS total FROM v GROUP BY 1,2),
 g AS (SELECT scene_id, instance_id, c, count(*) AS k, min(o) AS first FROM v WHERE c IS NOT NULL AND c<>'不确定' GROUP BY 1,2,3),
 b AS (SELECT *, row_number() OVER (PARTITION BY scene_id,instance_id ORDER BY k DESC, first) AS rn FROM g)
SELECT n.scene_id, n.instance_id, CASE WHEN b.k >= greatest(2,(total+1)//2) THEN c END AS color, coalesce(b.k >= greatest(2,(total+1)//2), false) AS agreed, total
FROM n LEFT JOIN b ON b.scene_id=n.scene_id AND b.instance_id=n.instance_id AND rn=1""")
def consensus_label(spark, sf):
    votes = t.view(spark, sf, "a_instance_obs").select(
        "scene_id", "instance_id",
        F.when(F.col("k4") % 11 == 0, "不确定").when(F.col("k4") % 13 != 0, F.col("color")).alias("color"),
        (F.col("k1") * 100000000 + F.col("k2") * 10000000 + F.col("k3") * 1000 + F.col("k4")).alias("o"),
    )
    return assemble.consensus(votes, ["scene_id", "instance_id"], "color", "o")


@query("described_views", f"""
WITH det AS (SELECT *, row_number() OVER (PARTITION BY scene_id, frame, class ORDER BY conf DESC, ord) AS rn FROM {{a_detections}}),
 inst AS (SELECT scene_id, class, min(frame_no) AS a, max(frame_no) AS b FROM {{a_detections}} GROUP BY 1,2),
 ev AS (SELECT scene_id, class, view, concat('frame_', lpad(CAST(f AS VARCHAR), 6, '0'), '.jpg') AS frame, f FROM (
   SELECT scene_id, class, 0 AS view, a AS f FROM inst UNION ALL SELECT scene_id, class, 1, a+(b-a)//2 FROM inst WHERE a<>b UNION ALL SELECT scene_id, class, 2, b FROM inst WHERE a<>b) q),
 ok AS (SELECT e.*, d.conf, p.* EXCLUDE (scene_id, frame_no, frame) FROM ev e LEFT JOIN det d ON d.scene_id=e.scene_id AND d.frame=e.frame AND d.class=e.class AND d.rn=1
   LEFT JOIN {{a_poses}} p ON p.scene_id=e.scene_id AND p.frame=e.frame WHERE f % 4 <> 3),
 ego AS (SELECT *, degrees(atan2(ly,lx)) AS b, sqrt(lx*lx+ly*ly) AS d FROM (SELECT *,
   r00*(1.5-tx)+r10*(1.0-ty)+r20*(0.9-tz) AS lx, r01*(1.5-tx)+r11*(1.0-ty)+r21*(0.9-tz) AS ly FROM ok) o),
 zh AS (SELECT *, {_TAG} AS tag, CASE class WHEN 'cup' THEN '杯子' WHEN 'chair' THEN '椅子' WHEN 'laptop' THEN '笔记本电脑' WHEN 'bucket' THEN '水桶' WHEN 'pillow' THEN '枕头' WHEN 'mouse' THEN '鼠标' WHEN 'blanket' THEN '被子' ELSE '垃圾桶' END AS lab FROM ego)
SELECT scene_id, class, view, concat_ws('，', CASE WHEN conf IS NOT NULL THEN concat('白色的',lab) ELSE lab END, '约 20×10×8 厘米',
  CASE WHEN conf IS NOT NULL THEN concat('在你',{_ZHTAG},'约 ',CAST(round_even(d,1) AS DECIMAL(18,1)),' 米') END) AS view_text FROM zh""")
def described_views(spark, sf):
    dets, poses = t.detections(spark, sf), t.poses(spark, sf)
    spans = dets.groupBy("scene_id", "class").agg(
        F.min("frame").alias("first_frame"), F.max("frame").alias("last_frame")
    ).withColumn("box", g.make_box(1.4, 0.95, 0.86, 1.6, 1.05, 0.94))
    quality = poses.select(
        "scene_id", "frame", (F.col("frame_no") % 4 != 3).alias("ok"), F.lit("白色").alias("crop_color")
    )
    return assemble.described_views(spans, dets, poses, quality).select(
        "scene_id", "class", "view", "view_text"
    )


@query("best_detections", """
SELECT scene_id, frame, class, ord, conf FROM (SELECT *, row_number() OVER (PARTITION BY scene_id, frame, class ORDER BY conf DESC, ord) AS rn FROM {a_detections}) q WHERE rn=1""")
def best_detections(spark, sf):
    return assemble.best_detections(t.detections(spark, sf)).select(
        "scene_id", "frame", "class", "best.ord", "best.conf"
    )


@query("busiest_frames", """
SELECT scene_id, frame, n, rn FROM (SELECT scene_id, frame, n, row_number() OVER (PARTITION BY scene_id ORDER BY n DESC, frame) AS rn
 FROM (SELECT scene_id, frame, count(*) AS n FROM {a_detections} GROUP BY 1,2) c) q WHERE rn<=6""")
def busiest_frames(spark, sf):
    """The six frames of a scene with most detections."""
    counts = t.detections(spark, sf).groupBy("scene_id", "frame").agg(F.count(F.lit(1)).alias("n"))
    return top_k(counts, ["scene_id"], [F.desc("n"), F.asc("frame")], 6)


@query("dominant_colors", """
WITH m AS (SELECT class, CAST(k3 % 20 AS BIGINT) AS crop, median(CAST((k3*7+k2*3) % 256 AS DOUBLE))*360/255 AS h, median(CAST((k3*11+k1) % 256 AS DOUBLE))/255 AS s, median(CAST((k3*5+k4) % 256 AS DOUBLE))/255 AS v FROM {a_sightings} GROUP BY 1,2)
SELECT class, crop, CASE WHEN v<0.12 THEN '黑色' WHEN s<0.15 AND v>0.82 THEN '白色' WHEN s<0.15 AND v>0.55 THEN '浅灰色' WHEN s<0.15 THEN '深灰色'
 WHEN h>=0 AND h<15 THEN '红色' WHEN h>=15 AND h<45 THEN '橙色' WHEN h>=45 AND h<70 THEN '黄色' WHEN h>=70 AND h<160 THEN '绿色' WHEN h>=160 AND h<200 THEN '青色'
 WHEN h>=200 AND h<255 THEN '蓝色' WHEN h>=255 AND h<285 THEN '紫色' WHEN h>=285 AND h<330 THEN '粉色' WHEN h>=330 AND h<360 THEN '红色' ELSE '彩色' END AS color FROM m""")
def dominant_colors(spark, sf):
    samples = t.view(spark, sf, "a_sightings").select(
        "class", (F.col("k3") % 20).alias("crop"),
        ((F.col("k3") * 7 + F.col("k2") * 3) % 256).cast("double").alias("h"),
        ((F.col("k3") * 11 + F.col("k1")) % 256).cast("double").alias("s"),
        ((F.col("k3") * 5 + F.col("k4")) % 256).cast("double").alias("v"),
    )
    return assemble.dominant_colors(samples, ["class", "crop"])
