"""Locating nodes by words, relation questions and answers from confirmed memory.

Words and node texts are matched as *distinct* strings of one scene, by an equi-join on the scene
and a shared gram with an exact test after it; only real matches are joined back to nodes and
questions. No pair is formed across scenes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from roomgraph.fixed_values import FROM_MEMORY_PREFIX, NOT_FOUND_TEXT
from roomgraph.functions import geometry as g
from roomgraph.functions import words as w
from roomgraph.operators.scaling import shuffled, top_k


def contained_pairs(small: DataFrame, s: str, big: DataFrame, b: str) -> DataFrame:
    """Distinct pairs of non-empty strings of one scene with ``s`` inside ``b``."""
    inner = small.select("scene_id", s).filter(F.col(s) != "").distinct().withColumn(
        "_g", w.first_gram(F.col(s)))
    outer = big.select("scene_id", b).filter(F.col(b) != "").distinct().withColumn(
        "_g", F.explode(w.grams(F.col(b))))
    return shuffled(inner).join(outer, ["scene_id", "_g"]).filter(F.contains(F.col(b), F.col(s))).drop("_g")


# ---- locate ----------------------------------------------------------------------------------


def _node_texts(nodes: DataFrame) -> DataFrame:
    def text(c: str) -> Column:
        return F.coalesce(F.col(c), F.lit(""))

    return nodes.withColumns(
        {
            "_label": F.lower(text("label")),
            "_category": F.lower(text("category")),
            "_direct": F.lower(
                F.concat_ws(" ", text("label"), text("category"), text("layer1_text"),
                            text("layer2_text"))
            ),
            "_aliases": F.lower(F.array_join(F.coalesce("aliases", F.array()), " ")),
        }
    )


def locate(questions: DataFrame, nodes: DataFrame) -> DataFrame:
    """All hits of each question in its scene with ``score`` 3 exact, 2 substring, 1 alias.

    ``questions`` carry query_id, scene_id, text; ``nodes`` scene_id, ord, node_id, label,
    category, layer1_text, layer2_text, aliases, confidence. The order of a result list is
    score, confidence (both falling), ord.
    """
    asked = questions.select(
        "query_id", "scene_id", F.explode(w.expand_question(F.col("text"))).alias("kw")
    )
    keywords = asked.select("scene_id", "kw").distinct()
    texted = _node_texts(nodes)
    shape = ["scene_id", "_label", "_category", "_direct", "_aliases"]
    kinds = shuffled(texted.select(*shape).distinct()).join(
        keywords.select("scene_id").distinct(), "scene_id", "left_semi")

    exact = shuffled(keywords).join(
        kinds.withColumn("kw", F.explode(F.array_distinct(F.array("_label", "_category")))),
        ["scene_id", "kw"],
    ).withColumn("score", F.lit(3))
    within = shuffled(contained_pairs(keywords, "kw", kinds, "_direct")).join(
        kinds, ["scene_id", "_direct"]).withColumn("score", F.lit(2))
    alias = shuffled(contained_pairs(keywords, "kw", kinds, "_aliases")).join(
        kinds, ["scene_id", "_aliases"]).withColumn("score", F.lit(1))
    # the empty word is inside every text of its scene
    everywhere = shuffled(keywords.filter("kw = ''")).join(kinds, "scene_id").withColumn("score", F.lit(2))
    wanted = (
        exact.select("kw", *shape, "score")
        .unionByName(within.select("kw", *shape, "score"))
        .unionByName(alias.select("kw", *shape, "score"))
        .unionByName(everywhere.select("kw", *shape, "score"))
        .join(shuffled(asked), ["scene_id", "kw"])
        .groupBy("query_id", *shape)
        .agg(F.max("score").alias("score"))
    )
    return shuffled(wanted).join(texted, shape).drop(*shape[1:])


def locate_ranked(questions: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """First ``k`` hits per question with their ``rank``."""
    return top_k(
        locate(questions, nodes),
        ["query_id"],
        [F.desc("score"), F.desc("confidence"), F.asc("ord")],
        k,
        "rank",
    )


# ---- relation questions -----------------------------------------------------------------------


def relations_of(relations: DataFrame) -> DataFrame:
    """Each relation once per end node, as ``node_id``; self-relations once."""
    ends = F.array_distinct(F.array("subject", "object"))
    return relations.withColumn("node_id", F.explode(ends))


def children_of(nodes: DataFrame) -> DataFrame:
    child = nodes.filter(F.col("parent_id").isNotNull()).select(
        "scene_id", F.col("parent_id").alias("node_id"), F.col("node_id").alias("child_id"),
        F.col("ord").alias("child_ord"),
    )
    return shuffled(nodes.select("scene_id", "node_id", "label")).join(child, ["scene_id", "node_id"])


def _side(questions: DataFrame, hint: str, nodes: DataFrame, name: str) -> DataFrame:
    asked = questions.filter(F.col(hint) != "").select(
        "query_id", "scene_id", F.col(hint).alias("text")
    )
    return locate(asked, nodes).select("query_id", "scene_id", F.col("node_id").alias(name))


def _standing(questions: DataFrame, hint: str, nodes: DataFrame, name: str) -> DataFrame:
    """Nodes with a height that a hint names in its scene; an empty hint names all of them."""
    tall = nodes.filter(F.col("box").isNotNull()).select(
        "scene_id", F.col("node_id").alias(name), g.box_center(F.col("box")).z.alias(f"_z_{name}"))
    every = questions.filter(F.col(hint) == "").select("query_id", "scene_id").join(shuffled(tall), "scene_id")
    named = _side(questions, hint, nodes, name).join(shuffled(tall), ["scene_id", name])
    return every.unionByName(named.select(*every.columns))


def relational_above(questions: DataFrame, nodes: DataFrame, margin: float = 0.02) -> DataFrame:
    """Objects that lie below the subjects, from heights: no pair is stored, and only located
    subjects meet located objects."""
    asked = questions.filter(F.col("predicate").isin("above", ""))
    subjects = _standing(asked, "subject_hint", nodes, "subject")
    objects = _standing(asked, "object_hint", nodes, "object").drop("scene_id")
    return (
        shuffled(subjects).join(objects, "query_id")
        .filter(F.col("_z_subject") - F.col("_z_object") > margin)
        .select("query_id", "scene_id", "subject", F.lit("above").alias("predicate"), "object")
    )


def relational(questions: DataFrame, nodes: DataFrame, relations: DataFrame,
               upright: bool = False) -> DataFrame:
    """Objects of active relations from located subjects to located objects.

    ``questions`` carry subject_hint, predicate, object_hint; an empty hint or predicate
    matches anything. Parent links count as ``in`` when ``in`` is asked for. With ``upright``
    ``above`` is taken from the nodes' boxes, as it isn't among the stored relations. One row per
    relation found, so an object may come back several times.
    """
    edges = (
        relations.filter(F.col("status") == "active")
        .select("scene_id", "subject", "predicate", "object", F.lit(False).alias("tree"))
        .unionByName(
            nodes.filter(F.col("parent_id").isNotNull()).select(
                "scene_id", F.col("node_id").alias("subject"), F.lit("in").alias("predicate"),
                F.col("parent_id").alias("object"), F.lit(True).alias("tree"),
            )
        )
    )
    asked = questions.select(
        "query_id", "scene_id", F.col("predicate").alias("wanted"), "subject_hint", "object_hint"
    )
    fits = (F.col("wanted") == F.col("predicate")) | ((F.col("wanted") == "") & ~F.col("tree"))

    # start from located subjects where there is a hint, from the scene otherwise
    with_subject = (
        _side(questions, "subject_hint", nodes, "subject")
        .join(shuffled(asked), ["query_id", "scene_id"])
        .join(shuffled(edges), ["scene_id", "subject"])
        .filter(fits)
    )
    any_subject = (
        asked.filter(F.col("subject_hint") == "").join(shuffled(edges), "scene_id").filter(fits)
    )
    found = with_subject.unionByName(any_subject)
    objects = _side(questions, "object_hint", nodes, "object")
    hinted = found.filter(F.col("object_hint") != "").join(
        shuffled(objects), ["query_id", "scene_id", "object"], "left_semi"
    )
    free = found.filter(F.col("object_hint") == "").join(
        shuffled(nodes.select("scene_id", F.col("node_id").alias("object"))), ["scene_id", "object"],
        "left_semi",
    )
    told = hinted.unionByName(free).select("query_id", "scene_id", "subject", "predicate", "object")
    return told.unionByName(relational_above(questions, nodes)) if upright else told


def egocentric_answers(located: DataFrame, viewers: DataFrame) -> DataFrame:
    """Direction and distance of located nodes from the viewer pose of their scene."""
    ego = g.egocentric(g.position(F.col("center"), F.col("box")), F.col("pose"))
    second = F.coalesce(F.nullif(F.col("layer2_text"), F.lit("")), F.col("layer1_text"))
    return (
        shuffled(located).join(viewers.select("scene_id", "pose"), "scene_id")
        .withColumn("ego", ego)
        .withColumn("layer2", second)
        .drop("pose")
    )


# ---- answers from confirmed memory ---------------------------------------------------------------


def _score(q: Column, keywords: Column, name: Column, hint: Column, color: Column) -> Column:
    def inside(a: Column, b: Column) -> Column:
        return F.contains(b, a)

    by_name = (w.name_family(name) == w.name_family(q)) | (
        (name != "") & (inside(name, q) | inside(q, name))
    )
    by_word = F.exists(keywords, lambda k: (k != "") & (inside(k, name) | inside(name, k)))
    return (
        F.when(by_name, 3)
        .when((hint != "") & inside(q, hint), 2)
        .when(by_word, 2)
        .when((color != "") & (inside(color, q) | inside(q, color)), 1)
        .otherwise(0)
    )


def _matches(asked: DataFrame, memory: DataFrame) -> DataFrame:
    """Distinct (scene_id, q, name, hint, color) with a positive score."""
    shape = ["scene_id", "_name", "_hint", "_color"]
    questions = asked.select("scene_id", "q").distinct().withColumn(
        "keywords", w.expand_question(F.col("q")))
    kinds = shuffled(memory.select(*shape).distinct()).join(
        questions.select("scene_id").distinct(), "scene_id", "left_semi")
    words = questions.select(
        "scene_id", "q", F.explode(F.array_union(F.array("q"), F.col("keywords"))).alias("s"))
    parts = kinds.select(
        "*", F.explode(F.array_distinct(F.array("_name", "_hint", "_color"))).alias("p"))
    touching = contained_pairs(words, "s", parts, "p").unionByName(
        contained_pairs(parts, "p", words, "s")
    ).distinct()
    by_text = shuffled(words).join(touching, ["scene_id", "s"]).join(shuffled(parts), ["scene_id", "p"])
    by_family = shuffled(questions.withColumn("_f", w.name_family(F.col("q")))).join(
        kinds.withColumn("_f", w.name_family(F.col("_name"))), ["scene_id", "_f"])
    # an empty name is inside every keyword
    nameless = shuffled(questions).join(kinds.filter("_name = ''"), "scene_id")
    pairs = (
        by_text.select("q", *shape).unionByName(by_family.select("q", *shape))
        .unionByName(nameless.select("q", *shape)).distinct().join(shuffled(questions), ["scene_id", "q"])
    )
    score = _score(F.col("q"), F.col("keywords"), F.col("_name"), F.col("_hint"), F.col("_color"))
    return pairs.withColumn("score", score).filter(F.col("score") > 0).drop("keywords")


def _where(node_pose: Column) -> Column:
    seen = F.concat(F.col("source"), F.lit("确认"))
    sure = F.concat(F.lit("，置信 "), w.percent(F.col("confidence")))
    ego = g.egocentric(F.col("center"), node_pose)
    spot = F.concat_ws(
        ", ", *[F.bround(F.col(f"center.{a}"), 2).cast("string") for a in ("x", "y", "z")]
    )
    return (
        F.when(
            F.col("center").isNotNull() & node_pose.isNotNull(),
            F.concat(
                F.lit("在"), w.zh_direction(ego.tag), F.lit("约 "), w.one_decimal(ego.distance),
                F.lit(" 米（"), seen, sure, F.lit("）"),
            ),
        )
        .when(
            F.col("center").isNotNull(),
            F.concat(F.lit("位置坐标 ["), spot, F.lit("]（"), seen, F.lit("）")),
        )
        .otherwise(F.concat(F.lit("在场景中见过（"), seen, sure, F.lit("）")))
    )


def retrieve(
    questions: DataFrame, memory: DataFrame, viewers: DataFrame | None = None, limit: int = 3
) -> DataFrame:
    """One row per matched node, at most ``limit`` per question, with its ``line`` of text.

    ``memory`` carries scene_id, ord, node_id, name, color, label_hint, source, confidence,
    center. A question left empty by cleaning has no match.
    """
    asked = questions.select(
        "query_id", "scene_id", w.clean_question(w.clean(F.col("text"))).alias("q")
    ).filter(F.col("q") != "")
    named = memory.withColumns(
        {
            "_name": w.clean(F.col("name")),
            "_hint": w.clean(F.col("label_hint")),
            "_color": w.clean(F.col("color")),
        }
    )
    hits = (
        shuffled(asked).join(_matches(asked, named), ["scene_id", "q"])
        .join(shuffled(named), ["scene_id", "_name", "_hint", "_color"])
    )
    best = top_k(
        hits, ["query_id"],
        [F.desc("score"), F.desc("confidence"), F.asc("ord")], limit, "rank",
    )
    top_score = F.max("score").over(Window.partitionBy("query_id"))
    kept = (
        best.withColumn("_top", top_score)
        .filter(
            (F.col("score") >= 2)
            | ((F.col("_top") == 1) & w.is_color_question(F.col("q")))
        )
    )
    if viewers is not None:
        kept = shuffled(kept).join(viewers.select("scene_id", F.col("pose").alias("_pose")), "scene_id", "left")
        pose = F.col("_pose")
    else:
        pose = F.lit(None).cast(
            "struct<" + ",".join(f"{f}:double" for f in g.POSE_FIELDS) + ">"
        )
    head = F.when(
        F.coalesce("color", F.lit("")) != "", F.concat("color", F.lit("的"), F.col("name"))
    ).otherwise(F.col("name"))
    return (
        kept.withColumn("where", _where(pose))
        .withColumn("line", F.concat(head, F.lit("："), F.col("where")))
        .select("query_id", "scene_id", "rank", "node_id", "name", "color", "score", "source",
                "confidence", "where", "line")
    )


def answers(questions: DataFrame, matches: DataFrame) -> DataFrame:
    """Answer sentence per question; without a match the caller should look at the picture."""
    lines = matches.groupBy("query_id").agg(
        F.sort_array(F.collect_list(F.struct("rank", "line"))).alias("_lines")
    )
    found = F.col("_lines").isNotNull()
    text = F.concat(
        F.lit(FROM_MEMORY_PREFIX), F.array_join(F.transform("_lines", lambda l: l.line), "；")
    )
    empty = w.clean(F.col("text")) == ""
    return shuffled(questions).join(lines, "query_id", "left").select(
        "query_id",
        "scene_id",
        found.alias("found"),
        (~found).alias("fallback_used"),
        F.when(found, text).when(empty, "").otherwise(NOT_FOUND_TEXT).alias("answer"),
    )
