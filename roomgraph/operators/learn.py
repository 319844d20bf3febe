"""Learning over time: novelty, candidate pool, duplicate merging, confirmation, re-identification."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roomgraph.fixed_values import MULTI_VIEW_WEIGHT
from roomgraph.functions import geometry as g
from roomgraph.functions import words as w
from roomgraph.operators.scaling import by_size, positions, stretches, top_k
from roomgraph.operators.similarity import best_matches, cosine
from roomgraph.operators.spatial import footprint_pairs, near_pairs
from roomgraph.session import cut_lineage

SIM_TOL = 0.82
NEAR_TOL = 1.0
_SPAN = 10_000  # frame numbers a task looks at together


# ---- are two observations the same object? ------------------------------------------------------


def _windows_meet(a_first: Column, a_last: Column, b_first: Column, b_last: Column) -> Column:
    overlap = F.least(a_last, b_last) - F.greatest(a_first, b_first)
    shorter = F.least(a_last - a_first, b_last - b_first)
    return F.coalesce(
        (overlap > 0) & (shorter > 0) & (F.try_divide(overlap, shorter) >= 0.5), F.lit(False)
    )


def is_same_object(a: str, b: str, sim_tol: float = SIM_TOL, near: float = NEAR_TOL) -> Column:
    """Over pair rows with ``<a>_`` and ``<b>_`` columns name, color, center, first_no,
    last_no, feature.

    With both names known the colours must agree, and one of family, place or time window;
    otherwise the features must be alike, and place or time window agree.
    """
    def c(side: str, name: str) -> Column:
        return F.col(f"{side}_{name}")

    close = F.coalesce(g.euclidean(c(a, "center"), c(b, "center")) <= near, F.lit(False))
    together = close | _windows_meet(
        c(a, "first_no"), c(a, "last_no"), c(b, "first_no"), c(b, "last_no")
    )
    named = c(a, "name").isNotNull() & c(b, "name").isNotNull()
    by_name = w.same_color(c(a, "color"), c(b, "color")) & (
        (w.name_family(c(a, "name")) == w.name_family(c(b, "name"))) | together
    )
    alike = F.coalesce(cosine(c(a, "feature"), c(b, "feature")) >= sim_tol, F.lit(False))
    return F.when(named, by_name).otherwise(alike & together)


# ---- detections already explained ---------------------------------------------------------------


def uncovered(detections: DataFrame, instances: DataFrame, min_conf: float = 0.45) -> DataFrame:
    """Confident detections that no instance of their class covers in its evidence frame.

    ``instances`` carry class, first_no, last_no, evidence_frame and evidence_box.
    """
    d, e = F.col("bbox"), F.col("_box")
    cx, cy = (d.x1 + d.x2) / 2, (d.y1 + d.y2) / 2
    px, py = (e.x2 - e.x1) * 0.5, (e.y2 - e.y1) * 0.5
    held = instances.select(
        "scene_id", "class", F.col("evidence_frame").alias("frame"),
        F.col("evidence_box").alias("_box"), F.col("first_no").alias("_f"),
        F.col("last_no").alias("_l"),
    )
    left, right = detections.filter(F.col("conf") >= min_conf).alias("d"), held.alias("i")
    same = [F.col(f"d.{c}") == F.col(f"i.{c}") for c in ("scene_id", "class", "frame")]
    inside = (
        F.col("frame_no").between(F.col("_f"), F.col("_l"))
        & cx.between(e.x1 - px, e.x2 + px)
        & cy.between(e.y1 - py, e.y2 + py)
    )
    return left.join(right, [*same, inside], "left_anti")


# ---- novelty ---------------------------------------------------------------------------------------


def novel(rows: DataFrame, known: DataFrame, sim_tol: float = SIM_TOL) -> DataFrame:
    """Rows that match no known node of their scene.

    Named rows compare family and colour, unnamed ones features. ``rows`` carry scene_id,
    ord, name, color, feature; ``known`` scene_id, node_id, name, color, feature.
    """
    words = (
        known.filter(F.col("name").isNotNull())
        .select("scene_id", w.name_family(F.col("name")).alias("_f"), w.clean(F.col("color")).alias("_c"))
        .distinct()
    )
    named = rows.filter(F.col("name").isNotNull()).withColumn("_f", w.name_family(F.col("name")))
    fresh = named.alias("r").join(
        words.alias("k"),
        (F.col("r.scene_id") == F.col("k.scene_id"))
        & (F.col("r._f") == F.col("k._f"))
        & w.same_color(F.col("r.color"), F.col("k._c")),
        "left_anti",
    ).drop("_f")
    bare = rows.filter(F.col("name").isNull())
    asked = bare.filter(F.col("feature").isNotNull()).select(
        "scene_id", F.col("ord").alias("query_id"), "feature", F.lit("").alias("conflict")
    )
    shown = known.filter(F.col("feature").isNotNull()).select(
        "scene_id", "node_id", F.col("node_id").alias("match_id"),
        F.col("node_id").alias("match_ord"), "feature", F.lit("").alias("conflict"),
    )
    alike = best_matches(asked, shown, ["scene_id"], 1, sim_tol).select(
        "scene_id", F.col("query_id").alias("ord")
    )
    return fresh.unionByName(bare.join(alike, ["scene_id", "ord"], "left_anti"))


# ---- candidate pool ---------------------------------------------------------------------------------


def _pool_walk(near: float, sim_tol: float):
    """Per block: put each row to the first candidate it matches, in order of arrival."""

    def walk(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("ord")
        pool: list[dict] = []
        firsts = []
        for r in rows.itertuples(index=False):
            here = None if pd.isna(r.x) else np.array([r.x, r.y, r.z])
            name, color = r.family if isinstance(r.family, str) else None, r.color or ""
            for cand in pool:
                close = (
                    here is not None and cand["at"] is not None
                    and np.sqrt(((here - cand["at"]) ** 2).sum()) <= near
                )
                if name is not None and cand["name"] is not None:
                    agree = not color or not cand["color"] or color == cand["color"]
                    same = agree and (name == cand["name"] or close)
                elif close and r.feature is not None and cand["feature"] is not None:
                    a, b = np.asarray(r.feature, float), np.asarray(cand["feature"], float)
                    size = max(np.linalg.norm(a) * np.linalg.norm(b), 1e-9)
                    same = float(a @ b) / size >= sim_tol
                else:
                    same = False
                if same:
                    break
            else:
                cand = {"first": r.ord, "at": None, "name": None, "color": "", "feature": r.feature}
                pool.append(cand)
            if here is not None:
                cand["at"] = here
            if name is not None:
                cand["name"], cand["color"] = name, color
            firsts.append(cand["first"])
        return pd.DataFrame(
            {"scene_id": rows["scene_id"], "ord": rows["ord"], "first_ord": firsts}
        )

    return walk


def pool_candidates(
    rows: DataFrame, sim_tol: float = SIM_TOL, near: float = NEAR_TOL
) -> DataFrame:
    """Give each novel row its candidate: ``candidate_id`` and ``action`` (new or merged).

    ``rows`` carry scene_id, ord (arrival, unique in the scene), name, color, feature and
    center (name and center may be null).

    Different known colours never meet, so a scene splits by colour unless some row lacks
    one. Where also no row has a place, meeting is just equal family and needs no walk; and
    a row with neither name nor place can meet nothing.
    """
    base = rows.withColumns(
        {
            "_family": F.when(F.col("name").isNotNull(), w.name_family(F.col("name"))),
            "_color": w.clean(F.col("color")),
        }
    )
    alone = base.filter(F.col("_family").isNull() & F.col("center").isNull())
    active = base.filter(F.col("_family").isNotNull() | F.col("center").isNotNull())
    traits = active.groupBy("scene_id").agg(
        F.max(F.col("_family").isNull() | (F.col("_color") == "")).alias("_open"),
        F.max(F.col("center").isNotNull()).alias("_placed"),
    )
    marked = active.join(traits, "scene_id")
    plain = ~F.col("_open") & ~F.col("_placed")
    grouped = marked.filter(plain)
    heads = grouped.groupBy("scene_id", "_family", "_color").agg(F.min("ord").alias("first_ord"))
    by_group = grouped.join(heads, ["scene_id", "_family", "_color"]).select(
        "scene_id", "ord", "first_ord"
    )
    walked = (
        marked.filter(~plain)
        .select(
            "scene_id", "ord", F.col("_family").alias("family"), F.col("_color").alias("color"),
            F.col("center.x").alias("x"), F.col("center.y").alias("y"), F.col("center.z").alias("z"),
            "feature", F.when(F.col("_open"), F.lit("")).otherwise(F.col("_color")).alias("_block"),
        )
        .groupBy("scene_id", "_block")
        .applyInPandas(
            _pool_walk(near, sim_tol), "scene_id long, ord long, first_ord long"
        )
    )
    single = alone.select("scene_id", "ord", F.col("ord").alias("first_ord"))
    assigned = by_group.unionByName(walked).unionByName(single)
    numbers = positions(
        assigned.filter(F.col("ord") == F.col("first_ord")).select("scene_id", "first_ord"),
        ["scene_id"], "first_ord", name="_no",
    )
    return (
        rows.join(assigned, ["scene_id", "ord"])
        .join(numbers, ["scene_id", "first_ord"])
        .withColumn("candidate_id", F.concat(F.lit("cand_"), F.col("_no").cast("string")))
        .withColumn("action", F.when(F.col("ord") == F.col("first_ord"), "new").otherwise("merged"))
        .drop("first_ord", "_no")
    )


def candidates(pooled: DataFrame) -> DataFrame:
    """One row per candidate: first and last frame, count, latest place and meaning."""
    known = F.when(F.col("name").isNotNull(), F.col("ord"))
    placed = F.when(F.col("center").isNotNull(), F.col("ord"))
    return pooled.groupBy("scene_id", "candidate_id").agg(
        F.min_by("frame", "ord").alias("first_seen"),
        F.max_by("frame", "ord").alias("last_seen"),
        F.count(F.lit(1)).alias("n_observations"),
        F.min_by("label_hint", "ord").alias("label_hint"),
        F.max_by("name", known).alias("name"),
        F.max_by("color", known).alias("color"),
        F.max_by("center", placed).alias("center"),
    )


def appearances(pooled: DataFrame, width: int = 1_000_000) -> DataFrame:
    """Every sighting of each candidate in order of arrival: (scene_id, candidate_id, place, frame, bbox,
    crop_file), the box in whole pixels. ``pooled`` carries frame, ``bbox`` and crop_file."""
    box = F.struct(*[F.col(f"bbox.{c}").cast("int").alias(c) for c in ("x1", "y1", "x2", "y2")])
    seen = pooled.select("scene_id", "candidate_id", "ord", "frame", box.alias("bbox"), "crop_file")
    return positions(seen, ["scene_id", "candidate_id"], "ord", width, "place").drop("ord")


def pool_stats(all_rows: DataFrame, pooled: DataFrame) -> DataFrame:
    """Rows per outcome and scene: known_skip, merged, new."""
    seen = all_rows.select("scene_id", "ord").join(
        pooled.select("scene_id", "ord", "action"), ["scene_id", "ord"], "left"
    )
    action = F.coalesce("action", F.lit("known_skip"))
    return seen.groupBy("scene_id", action.alias("action")).agg(F.count(F.lit(1)).alias("n"))


# ---- duplicate instances ------------------------------------------------------------------------------

_INSTANCE = [
    "scene_id", "ord", "instance_id", "class", "name", "color", "feature", "center",
    "first_no", "last_no", "n_observations", "median_conf",
]


#: Instances of a scene up to which it is walked whole, without finding its components first.
_WALK = 2_000

_MERGE_STATE = (
    "scene_id long, ord long, keeper long, first_no long, last_no long, n_observations long, "
    "absorbed array<struct<step:long,keep:long,gone:long,n:long>>"
)


def _starred(rows: DataFrame, group: list[str]) -> DataFrame:
    """Links (scene_id, u, v) from every component of a group to the group's smallest one."""
    hubs = rows.groupBy(*group).agg(F.min("comp").alias("u"))
    return (
        rows.select(*group, "comp").distinct().join(hubs, group).filter(F.col("comp") > F.col("u"))
        .select("scene_id", "u", F.col("comp").alias("v"))
    )


def _named_links(rows: DataFrame) -> DataFrame:
    """Links that give the components of all named pairs of one colour, or a blank one, whose names
    are of one family or whose hulls overlap, without the pairs.

    Equal family and colour: a star. Equal colour and overlapping hulls: a star for each stretch
    of overlapping hulls. A blank colour agrees with all: its star, or its stretches, stand among
    those of each colour of the class.
    """
    keys = ["scene_id", "class"]
    named = rows.filter(F.col("name").isNotNull()).select(
        *keys, "comp", "lo", "hi", w.name_family(F.col("name")).alias("_f"),
        w.strip(F.coalesce("color", F.lit(""))).alias("_c"))

    def with_blanks(groups: DataFrame, blanks: DataFrame, by: list[str]) -> DataFrame:
        """The groups' rows, and the blank ones once for each other colour."""
        colors = groups.filter("_c <> ''").select(*by, "_c").distinct()
        return groups.unionByName(blanks.drop("_c").join(colors, by).select(*groups.columns))

    kin = named.select(*keys, "_f", "_c", "comp")
    kin_blank = kin.filter("_c = ''").groupBy(*keys, "_f", "_c").agg(F.min("comp").alias("comp"))
    family = _starred(with_blanks(kin, kin_blank, [*keys, "_f"]), [*keys, "_f", "_c"])

    spans = named.filter(F.col("lo") < F.col("hi")).select(*keys, "_c", "comp", "lo", "hi")
    blank = stretches(spans.filter("_c = ''"), [*keys, "_c"], "lo", "hi", _SPAN, "_s")
    whole = cut_lineage(blank.groupBy(*keys, "_c", "_s").agg(
        F.min("comp").alias("comp"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("_s"))
    colored = cut_lineage(with_blanks(spans, whole, keys))
    timed = cut_lineage(stretches(colored, [*keys, "_c"], "lo", "hi", _SPAN, "_s"))
    return family.unionByName(_starred(timed, [*keys, "_c", "_s"]))


def _maybe_links(rows: DataFrame, sim_tol: float, near: float) -> DataFrame:
    """Links (scene_id, u, v) of components that some merge inside them could make one object.

    ``rows`` carry ``comp`` and the hull of the component's windows. Merging only ever swaps
    identities within a component and widens windows up to its hull, so a pair that fails here
    can't come to match: windows can meet only where the hulls overlap, and names, colours,
    features and places are those of some member. Named pairs are linked by stars; pairs are
    made of near places, and of overlapping hulls where one side has no name.
    """
    keys = ["scene_id", "class"]
    held = ["ord", "comp", "name", "color", "feature", "center", "lo", "hi"]
    placed = near_pairs(
        rows.filter(F.col("center").isNotNull()), keys, "ord", F.col("center"), near, []
    ).select(*keys, "a_ord", "b_ord")
    hulls = rows.groupBy(*keys, "comp").agg(
        F.first("lo").alias("lo"), F.first("hi").alias("hi"),
        F.every(F.col("name").isNotNull()).alias("_named"))
    spans = hulls.withColumn(
        "box", g.make_box(F.col("lo") / 100.0, 0.0, 0.0, F.col("hi") / 100.0, 0.0, 0.0))
    loose = spans.filter(~F.col("_named"))
    meeting = footprint_pairs(loose, spans, keys, ["comp"], ["comp", "_named"]).filter(
        F.col("r__named") | (F.col("l_comp") < F.col("r_comp")))
    member = rows.select(*keys, "comp", "ord", F.col("name").isNotNull().alias("_n"))
    timed = (
        meeting.join(member.select(*keys, F.col("comp").alias("l_comp"), F.col("ord").alias("x"), F.col("_n").alias("_nx")),
                     [*keys, "l_comp"])
        .join(member.select(*keys, F.col("comp").alias("r_comp"), F.col("ord").alias("y"), F.col("_n").alias("_ny")),
              [*keys, "r_comp"])
        .filter(~(F.col("_nx") & F.col("_ny")))
        .select(*keys, F.least("x", "y").alias("a_ord"), F.greatest("x", "y").alias("b_ord"))
    )
    pairs = placed.unionByName(timed).distinct()
    for side in ("a", "b"):
        full = rows.select(*keys, *[F.col(c).alias(f"{side}_{c}") for c in held])
        pairs = pairs.join(full, [*keys, f"{side}_ord"])
    close = F.coalesce(g.euclidean(F.col("a_center"), F.col("b_center")) <= near, F.lit(False))
    together = close | (F.least("a_hi", "b_hi") > F.greatest("a_lo", "b_lo"))
    alike = F.coalesce(cosine(F.col("a_feature"), F.col("b_feature")) >= sim_tol, F.lit(False))
    named = F.col("a_name").isNotNull() & F.col("b_name").isNotNull()
    color = [w.strip(F.coalesce(f"{side}_color", F.lit(""))) for side in ("a", "b")]
    agree = (color[0] == color[1]) | (color[0] == "") | (color[1] == "")
    apart = pairs.filter(
        (F.col("a_comp") != F.col("b_comp")) & together & F.when(named, agree).otherwise(alike)
    ).select("scene_id", F.least("a_comp", "b_comp").alias("u"), F.greatest("a_comp", "b_comp").alias("v"))
    return apart.unionByName(_named_links(rows)).distinct()


def _settled_components(rows: DataFrame, sim_tol: float, near: float) -> DataFrame:
    """``rows`` with ``comp``: no merge can ever lead from one component into another.

    Named instances of one family and colour begin as one component. In each round a component
    joins the smallest one it is linked to, and at once the one which that joins.
    """
    hull = ["scene_id", "comp"]

    def with_hulls(df: DataFrame) -> DataFrame:
        return cut_lineage(df.join(df.groupBy(*hull).agg(
            F.min("first_no").alias("lo"), F.max("last_no").alias("hi")), hull))

    kin = ["scene_id", "class", "_f", "_c"]
    looks = rows.withColumns({  # without a name there is no family, and nothing to join
        "_f": F.when(F.col("name").isNotNull(), w.name_family(F.col("name"))),
        "_c": w.strip(F.coalesce("color", F.lit("")))})
    first = looks.groupBy(*kin).agg(F.min("ord").alias("_to"))
    placed = with_hulls(looks.join(first, kin, "left").select(
        *rows.columns, F.coalesce("_to", "ord").alias("comp")))
    while True:
        links = cut_lineage(_maybe_links(placed, sim_tol, near))
        if links.isEmpty():
            return placed
        both = links.unionByName(links.select("scene_id", F.col("v").alias("u"), F.col("u").alias("v")))
        label = both.groupBy("scene_id", F.col("u").alias("comp")).agg(
            F.least(F.min("v"), F.first("u")).alias("_to"))
        further = label.select("scene_id", F.col("comp").alias("_to"), F.col("_to").alias("_then"))
        label = label.join(further, ["scene_id", "_to"]).select(*hull, F.col("_then").alias("_to"))
        placed = with_hulls(placed.join(label, hull, "left").withColumn(
            "comp", F.coalesce("_to", "comp")).drop("_to", "lo", "hi"))


def _merge_walk(sim_tol: float, near: float):
    """The walk over one component, or a scene, in ``ord`` order: the first pair (by the earlier, then the
    later one) that is the same object is merged in the earlier one's place; then anew.

    A place is settled once it matches no other. Settled places can only come to match the one
    that a merge has just changed, and that is always the first unsettled place; so its row of
    matches is all that is looked at, and the walk holds a few numbers a place.
    """

    def walk(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("ord").reset_index(drop=True)
        n = len(part)
        kind = pd.factorize(part["class"])[0]  # -1 without a class, and like nothing
        # what stands in each place; a merge moves the surer one's values into the earlier place
        held = {
            "named": part["named"].to_numpy(bool).copy(),
            "family": pd.factorize(part["_f"])[0],
            "color": np.where(part["_c"] == "", -1, pd.factorize(part["_c"])[0]),
            "feature": np.array(part["feature"].tolist(), float),
            "center": part[["_x", "_y", "_z"]].to_numpy(float).copy(),
            "conf": part["median_conf"].to_numpy(float).copy(),
            "ord": part["ord"].to_numpy().copy(),
        }
        held["norm"] = np.sqrt((held["feature"] ** 2).sum(1))
        named, family, color, feature, norm, center = (
            held[c] for c in ("named", "family", "color", "feature", "norm", "center"))
        first, last = part["first_no"].to_numpy().copy(), part["last_no"].to_numpy().copy()
        seen = part["n_observations"].to_numpy().copy()
        here, settled = np.ones(n, bool), np.zeros(n, bool)

        def same(i: int) -> np.ndarray:
            """Which places hold the same object as place ``i``."""
            over = np.minimum(last[i], last) - np.maximum(first[i], first)
            short = np.minimum(last[i] - first[i], last - first)
            meet = (over > 0) & (short > 0) & (over >= 0.5 * short)
            with np.errstate(invalid="ignore"):
                near_by = np.sqrt(((center[i] - center) ** 2).sum(1)) <= near
            together = near_by | meet
            colors = (color == color[i]) | (color == -1) | (color[i] == -1)
            cos = feature @ feature[i] / np.maximum(norm[i] * norm, 1e-9)
            out = np.where(named[i] & named, colors & ((family == family[i]) | together),
                           (cos >= sim_tol) & together)
            out[i] = False
            return out & here & (kind == kind[i]) & (kind >= 0)

        told: list[list[dict]] = [[] for _ in range(n)]
        i = step = 0
        while i < n:
            if settled[i] or not here[i]:
                i += 1
                continue
            matches = np.flatnonzero(same(i))
            if not len(matches):
                settled[i] = True
                continue
            after = matches[matches > i]
            i, j = (matches[0], i) if matches[0] < i else (i, after[0])
            settled[i], here[j] = False, False
            keep, gone = (j, i) if held["conf"][j] > held["conf"][i] else (i, j)
            seen[i] += seen[j]
            first[i], last[i] = min(first[i], first[j]), max(last[i], last[j])
            told[i] += told[j] + [{"step": step, "keep": int(held["ord"][keep]),
                                   "gone": int(held["ord"][gone]), "n": int(seen[i])}]
            told[j] = []
            if keep == j:
                for values in held.values():
                    values[i] = values[j]
            step += 1
        return pd.DataFrame({
            "scene_id": part["scene_id"], "ord": part["ord"], "keeper": held["ord"], "first_no": first,
            "last_no": last, "n_observations": seen, "absorbed": told,
        })[here]

    return walk


def merge_duplicates(
    instances: DataFrame, sim_tol: float = SIM_TOL, near: float = NEAR_TOL
) -> tuple[DataFrame, DataFrame]:
    """Instances without duplicates, and the report (keep, absorbed, class, n_observations_sum).

    The result is that of one plain loop over each scene: in ``ord`` order the first pair that is
    the same object is merged and stands in the earlier one's place, until no pair is left. The
    more confident one keeps its identity, the earlier one if they tie; observations add up and
    windows widen. A scene of up to ``_WALK`` instances is walked as it is. In larger ones components
    that no merge can leave are found first; each is walked by itself, which gives the loop's result
    as pairs of different components never touch. Instances without a feature take no part.
    """
    instances = cut_lineage(instances.select(*_INSTANCE))  # sizes, looks and identities read it anew
    idle = instances.filter(F.col("feature").isNull()).select(*_INSTANCE)
    rows = instances.filter(F.col("feature").isNotNull()).select(*_INSTANCE)
    small, large = by_size(
        rows.filter(F.col("scene_id").isNotNull() & F.col("ord").isNotNull()), ["scene_id"], _WALK)
    placed = small.withColumn("comp", F.lit(None).cast("long"))
    if large is not None:
        placed = placed.unionByName(_settled_components(large, sim_tol, near).drop("lo", "hi"))
    looks = placed.select(
        "scene_id", "comp", "ord", "class", "feature", "first_no", "last_no", "n_observations", "median_conf",
        F.col("name").isNotNull().alias("named"), w.name_family(F.col("name")).alias("_f"),
        w.strip(F.coalesce("color", F.lit(""))).alias("_c"),
        F.col("center.x").alias("_x"), F.col("center.y").alias("_y"), F.col("center.z").alias("_z"),
    ).withColumns({c: F.col(c).cast("long") for c in ("scene_id", "ord", "first_no", "last_no", "n_observations")})
    walked = cut_lineage(looks.groupBy("scene_id", "comp").applyInPandas(
        _merge_walk(sim_tol, near), _MERGE_STATE))
    fixed = [c for c in _INSTANCE if c not in ("ord", "first_no", "last_no", "n_observations")]
    identity = rows.select(*fixed, F.col("ord").alias("keeper"))
    merged = walked.drop("absorbed").join(identity, ["scene_id", "keeper"]).select(*_INSTANCE)
    names = rows.select("scene_id", "ord", "instance_id", "class")
    steps = walked.select("scene_id", F.explode("absorbed").alias("s"))
    report = (
        steps.select("scene_id", F.col("s.step").alias("step"), F.col("s.keep").alias("ord"),
                     F.col("s.gone").alias("gone"), F.col("s.n").alias("n_observations_sum"))
        .join(names.withColumnRenamed("instance_id", "keep"), ["scene_id", "ord"]).drop("ord")
        .join(names.select("scene_id", F.col("ord").alias("gone"), F.col("instance_id").alias("absorbed")),
              ["scene_id", "gone"])
        .select("scene_id", "keep", "absorbed", "class", "n_observations_sum")
    )
    return merged.unionByName(idle), report


# ---- confirmation --------------------------------------------------------------------------------------


def decide_upgrades(
    views: DataFrame, confirmations: DataFrame, min_views: int = 2, threshold: float = 0.7
) -> DataFrame:
    """Upgrade decision per candidate from agreeing views and outside confirmations.

    Both carry candidate_id, ord, name, color; confirmations also source and weight.
    """
    def grouped(df: DataFrame) -> DataFrame:
        return df.filter(F.coalesce("name", F.lit("")) != "").withColumns(
            {"family": w.name_family(F.col("name")), "group_color": w.clean(F.col("color"))}
        )

    keys = ["candidate_id", "family", "group_color"]
    seen = grouped(views).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.max_by("name", "ord").alias("name"), F.min("ord").alias("at")
    ).filter(F.col("n") >= min_views)
    support = seen.select(
        *keys, "name", F.lit(MULTI_VIEW_WEIGHT).alias("weight"), F.lit("multi_view").alias("source"),
        F.struct(F.lit(0).alias("stage"), "at").alias("at"),
    ).unionByName(
        grouped(confirmations).select(
            *keys, "name", "weight", "source",
            F.struct(F.lit(1).alias("stage"), F.col("ord").alias("at")).alias("at"),
        )
    )
    weighed = support.groupBy(*keys).agg(
        F.round(F.sum("weight"), 9).alias("weight"),
        F.max_by("name", "at").alias("name"),
        F.array_sort(F.collect_set("source")).alias("sources"),
        F.min("at").alias("at"),
    )
    best = top_k(
        weighed, ["candidate_id"],
        [
            F.desc("weight"), F.desc(F.array_contains("sources", "interactive")),
            F.desc(F.array_contains("sources", "ocr")), F.asc("at"),
        ],
        1,
    )
    everyone = views.select("candidate_id").union(confirmations.select("candidate_id")).distinct()
    upgrade = F.coalesce(F.col("weight") >= threshold, F.lit(False))
    reason = (
        F.when(F.col("weight").isNull(), "no_confirmation")
        .when(upgrade, F.concat(F.lit("weight="), F.format_string("%.2f", "weight")))
        .otherwise(
            F.concat(F.lit("below_threshold("), F.format_string("%.2f", "weight"),
                     F.lit(f"<{threshold})"))
        )
    )
    return everyone.join(best, "candidate_id", "left").select(
        "candidate_id",
        upgrade.alias("upgrade"),
        F.when(upgrade, F.col("name")).otherwise("").alias("name"),
        F.when(upgrade, F.col("group_color")).otherwise("").alias("color"),
        F.when(upgrade, F.array_join("sources", ",")).otherwise("").alias("sources"),
        F.when(upgrade, F.least(F.lit(1.0), F.col("weight") / threshold)).otherwise(0.0).alias("confidence"),
        reason.alias("reason"),
    )


def remaining(rows: DataFrame, confirmed: DataFrame, key: list[str]) -> DataFrame:
    """Rows without a confirmed counterpart."""
    return rows.join(confirmed.select(*key), key, "left_anti")


# ---- re-identification -------------------------------------------------------------------------------------


def reidentify(queries: DataFrame, gallery: DataFrame, sim_threshold: float = 0.95) -> DataFrame:
    """Best known node per query: by name and colour, else by features, else none.

    ``queries`` carry scene_id, query_id, feature, name, color; ``gallery`` scene_id, ord,
    node_id, feature, name, color. Known nodes are first cut down to the earliest per family
    and colour, so a popular name costs no pair of rows. The closest similarity is reported
    even when it is too low.
    """
    words = (
        gallery.filter(F.col("name").isNotNull())
        .withColumns({"_f": w.name_family(F.col("name")), "_c": w.clean(F.col("color"))})
        .groupBy("scene_id", "_f", "_c")
        .agg(F.min(F.struct("ord", "node_id")).alias("_first"))
    )
    asked = queries.filter(F.col("name").isNotNull()).withColumn("_f", w.name_family(F.col("name")))
    strong = (
        asked.alias("q")
        .join(
            words.alias("k"),
            (F.col("q.scene_id") == F.col("k.scene_id"))
            & (F.col("q._f") == F.col("k._f"))
            & w.same_color(F.col("q.color"), F.col("k._c")),
        )
        .groupBy(F.col("q.scene_id").alias("scene_id"), "query_id")
        .agg(F.min("_first").alias("s"))
        .select("scene_id", "query_id", F.col("s.node_id").alias("strong_id"))
    )
    conflict = F.when(F.col("name").isNotNull(), w.clean(F.col("color"))).otherwise("")
    looks = best_matches(
        queries.join(strong, ["scene_id", "query_id"], "left_anti")
        .filter(F.col("feature").isNotNull())
        .select("scene_id", "query_id", "feature", conflict.alias("conflict")),
        gallery.filter(F.col("feature").isNotNull()).select(
            "scene_id", F.col("ord").alias("match_id"), F.col("ord").alias("match_ord"), "feature",
            conflict.alias("conflict"),
        ),
        ["scene_id"], 1, 0.0, strict=True, digits=9,
    )
    weak = looks.join(
        gallery.select("scene_id", F.col("ord").alias("match_id"), "node_id"), ["scene_id", "match_id"]
    ).select("scene_id", "query_id", F.col("node_id").alias("weak_id"), "similarity")
    both = (
        queries.select("scene_id", "query_id")
        .join(strong, ["scene_id", "query_id"], "left")
        .join(weak, ["scene_id", "query_id"], "left")
    )
    is_strong = F.col("strong_id").isNotNull()
    is_weak = F.coalesce(F.col("similarity") >= sim_threshold, F.lit(False))
    return both.select(
        "scene_id", "query_id",
        F.when(is_strong, F.col("strong_id")).when(is_weak, F.col("weak_id")).alias("match_id"),
        F.when(is_strong, "strong").when(is_weak, "weak").otherwise("none").alias("tier"),
        F.when(is_strong, 1.0).otherwise(F.coalesce("similarity", F.lit(0.0))).alias("similarity"),
        F.when(is_strong, 1.0)
        .when(is_weak, F.least(F.lit(1.0), F.col("similarity")))
        .otherwise(0.0)
        .alias("confidence"),
    )
