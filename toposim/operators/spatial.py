"""Point-to-polygon matching (G1-G4, B15, B16) over the covers and rings
of ``cover``.  Polygons are rows (id, names, area) with ``rings`` (any
closed rings under the even-odd rule) or one ``ring``."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from toposim.functions.termsplit import align_pairs, lgm_scores
from toposim.operators.cover import located, nearest, within_distance
from toposim.operators.scoring import score_many
from toposim.session import materialize


@dataclass
class Step:
    """One cascade step: ``mode`` 'within' | 'nearby'; pre-filters
    ``named`` (only polygons with a name) and ``area_max``; post-filters
    ``measure`` + ``sim_min`` (best similarity over the polygon's names
    must exceed it; with ``term_split`` the meta-similarity on that
    measure) and ``dist_max`` (distance must be below it; a nearby step
    without it takes the nearest at any distance)."""
    mode: str
    named: bool = False
    area_max: float | None = None
    measure: str | None = None
    sim_min: float | None = None
    dist_max: float | None = None
    term_split: bool = False
    extra: dict = field(default_factory=dict)


def eligible(polys: DataFrame, step: Step) -> DataFrame:
    """B15."""
    out = polys
    if step.named:
        out = out.where(F.size("names") > 0)
    if step.area_max is not None:
        out = out.where(F.col("area") < F.lit(float(step.area_max)))
    return out


def within_matches(points: DataFrame, polys: DataFrame) -> DataFrame:
    """G1: the polygon that strictly contains each point (lowest id when
    several do); points without one are dropped (inner result)."""
    found = located(points, polys).where("within").groupBy("poi_id").agg(F.min("id").alias("id"))
    return found.withColumn("distance", F.lit(0.0))


def nearby_matches(points: DataFrame, polys: DataFrame, dist_max: float | None = None) -> DataFrame:
    """Nearest polygon (ties to the lowest id), nearer than ``dist_max``
    if that is given."""
    return nearest(points, polys, dist_max)


def candidates(points: DataFrame, polys: DataFrame, steps: Sequence[Step]) -> DataFrame:
    """(poi_id, id, within, distance): every polygon that some step may
    choose.  Distances are 0 inside and on the border."""
    found = [located(points, polys).select("poi_id", "id", "within", F.lit(0.0).alias("distance"))]
    near = [s for s in steps if s.mode == "nearby"]
    bounded = [s.dist_max for s in near if s.dist_max is not None]
    if bounded:
        found.append(within_distance(points, polys, max(bounded)).withColumn("within", F.lit(False)))
    for named, area_max in dict.fromkeys((s.named, s.area_max) for s in near if s.dist_max is None):
        some = eligible(polys, Step("nearby", named=named, area_max=area_max))
        found.append(nearest(points, some).withColumn("within", F.lit(False)))
    every = found[0]
    for f in found[1:]:
        every = every.unionByName(f)
    return every.groupBy("poi_id", "id").agg(F.max("within").alias("within"), F.min("distance").alias("distance"))


def name_similarities(cands: DataFrame, points: DataFrame, polys: DataFrame, asked: Sequence[tuple[str, bool]],
                      frequent: Sequence[str] = ()) -> DataFrame:
    """(poi_id, id, sim_0, ...): the best similarity over a polygon's
    names, for every (measure, term_split) of ``asked``; with
    ``term_split`` the meta-similarity (F7) on that measure."""
    pairs = cands.select("poi_id", "id").join(points.select("poi_id", F.lower("name").alias("poi_name")), "poi_id") \
        .join(polys.select("id", F.explode("names").alias("n")).select("id", F.lower("n").alias("poly_name")), "id")
    plain = [m for m, term_split in asked if not term_split]
    if plain:
        pairs = score_many(pairs, [("poi_name", "poly_name", plain, "s_")])
    split = [m for m, term_split in asked if term_split]
    if split:
        pairs = lgm_scores(align_pairs(pairs, "poi_name", "poly_name", "a_name", "b_name"), "a_name", "b_name", split, frequent, prefix="f_")
    best = [F.max(("f_" if term_split else "s_") + m).alias(f"sim_{k}") for k, (m, term_split) in enumerate(asked)]
    return pairs.groupBy("poi_id", "id").agg(*best)


def match_cascade(points: DataFrame, polys: DataFrame, steps: Sequence[Step], frequent: Sequence[str] = ()) -> DataFrame:
    """Ordered steps, each for the points that earlier ones left;
    result ``(poi_id, id, step, distance, sim)``.

    One table of candidates serves all steps: a step's choice is the least
    (distance, id) among the candidates it accepts, all steps' choices are
    taken in one aggregate per point, and the first step whose choice
    passes its similarity and distance bounds wins.
    """
    cands = materialize(candidates(points, polys, steps), "candidates")
    asked = list(dict.fromkeys((s.measure, s.term_split) for s in steps if s.measure is not None))
    facts = polys.select("id", (F.size("names") > 0).alias("named"), "area")
    d = cands.join(facts, "id")
    if asked:
        d = d.join(name_similarities(cands, points, polys, asked, frequent), ["poi_id", "id"], "left")
    near = F.round("distance", 9)
    keys = []
    for n, s in enumerate(steps):
        sim = F.col(f"sim_{asked.index((s.measure, s.term_split))}") if s.measure is not None else F.lit(None).cast("double")
        fits = F.col("within") if s.mode == "within" else (near < s.dist_max if s.dist_max is not None else F.lit(True))
        if s.named:
            fits = fits & F.col("named")
        if s.area_max is not None:
            fits = fits & (F.col("area") < float(s.area_max))
        passes = sim.isNotNull() if s.measure is not None else F.lit(True)
        if s.measure is not None and s.sim_min is not None:
            passes = passes & (sim > float(s.sim_min))
        if s.dist_max is not None:
            passes = passes & (near < float(s.dist_max))
        keys.append(F.min(F.when(fits, F.struct(near.alias("near"), "id", "distance", sim.alias("sim"), passes.alias("ok")))).alias(f"k{n}"))
    per = d.groupBy("poi_id").agg(*keys)
    first = F.coalesce(*[F.when(F.col(f"k{n}.ok"), F.struct(F.col(f"k{n}.id"), F.lit(n + 1).alias("step"), F.col(f"k{n}.distance"), F.col(f"k{n}.sim")))
                         for n in range(len(steps))])
    return per.select("poi_id", first.alias("m")).where("m IS NOT NULL").select("poi_id", "m.id", "m.step", "m.distance", "m.sim")


def attach(matches: DataFrame, points: DataFrame, polys: DataFrame) -> DataFrame:
    """Equi-join matches back to both sides with explicit suffixes."""
    p = points.select(*[F.col(c).alias(f"{c}_x") if c != "poi_id" else F.col(c) for c in points.columns])
    q = polys.select(*[F.col(c).alias(f"{c}_y") if c != "id" else F.col(c) for c in polys.columns])
    return matches.join(p, "poi_id").join(q, "id")
