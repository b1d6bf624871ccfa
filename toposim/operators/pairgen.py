"""Labelled pair generation from a gazetteer.

* G7 positives: every 2-combination of a place's names, built
  row-locally from that row's own name array (bounded by the row, no
  self-join, no shuffle); pairs whose lower-cased gram sets are equal
  are skipped.
* G8 negatives: one per positive, a name of another place, drawn
  exactly in one equi-join.  The pool of (name, place) rows is ranked so
  that each place's names are contiguous; a hash of the positive picks
  a rank outside the place's own range.  No retries, no pool cap.
* B9 alphabets, H10 de-duplication, I3 balanced interleaving.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from toposim.functions.text import detect_alphabet, only_alphabet
from toposim.operators.scoring import score_pairs
from toposim.operators.splits import _rank, balanced_sample
from toposim.session import materialize

SEED = 2020
MIN_NAME_LEN = 2        # fixed value: a name needs more than 2 characters
MIN_NAMES = 3           # fixed value: places with fewer names are skipped


def name_array(alternate_names: Column, name: Column, asciiname: Column, min_len: int = MIN_NAME_LEN,
               alt_min_len: int | None = None) -> Column:
    """Distinct, trimmed names (sorted): own names longer than
    ``min_len``, alternates (an array) longer than ``alt_min_len`` or that."""
    longer = lambda n: lambda x: F.length(x) > n
    alts = F.filter(F.transform(alternate_names, lambda x: F.trim(x)), longer(min_len if alt_min_len is None else alt_min_len))
    own = F.array(F.trim(F.coalesce(name, F.lit(""))), F.trim(F.coalesce(asciiname, F.lit(""))))
    return F.array_sort(F.array_distinct(F.concat(alts, F.filter(own, longer(min_len)))))


def places(gaz: DataFrame, min_names: int = MIN_NAMES, min_len: int = MIN_NAME_LEN,
           alt_min_len: int | None = None, alphabet: str | None = None) -> DataFrame:
    """``(id, country, names)`` of places with at least ``min_names`` names.

    Alternate names are a comma-separated text or an array (as the
    gazetteer reader gives them); with ``alphabet`` only names written
    wholly in it count (B10)."""
    alts = F.col("alternate_names")
    if dict(gaz.dtypes)["alternate_names"] == "string":
        alts = F.split(alts, ",")
    alts = F.coalesce(alts, F.array().cast("array<string>"))
    names = name_array(alts, F.col("name"), F.col("asciiname"), min_len, alt_min_len)
    if alphabet:
        names = F.filter(names, lambda x: only_alphabet(x, alphabet))
    return gaz.select(F.col("geonameid").alias("id"), F.coalesce("country_code", F.lit("unknown")).alias("country"), names.alias("names")) \
        .where(F.size("names") >= min_names)


def positive_pairs(pl: DataFrame) -> DataFrame:
    """``(n1, n2, id, country)`` for every name pair of a place."""
    first = pl.select("id", "country", "names", F.posexplode("names").alias("i", "n1"))
    ex = first.select("n1", F.explode(F.slice("names", F.col("i") + 2, F.size("names"))).alias("n2"), "id", "country")
    ex = ex.select("*", F.lower("n1").alias("_l1"), F.lower("n2").alias("_l2"))
    return score_pairs(ex, "_l1", "_l2", ["jaccard"], "_").where("_jaccard != 1.0").select("n1", "n2", "id", "country")


def _hash_int(*cols) -> Column:
    """A non-negative 48-bit integer from md5 (identical in SQL engines)."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[c.cast("string") for c in cols])), 1, 12), 16, 10) \
        .cast("bigint")


def negative_pairs(pos: DataFrame, pl: DataFrame, seed: int = SEED) -> DataFrame:
    """``(n1, n2, id1, id2, cc1, cc2)`` — one negative per positive."""
    pool = pl.select("id", "country", F.explode("names").alias("name"), F.lit(0).alias("_all"))
    order = F.concat_ws("|", F.md5(F.concat_ws("|", F.col("id").cast("string"), F.lit(str(seed)))),
                        F.col("id").cast("string"), F.col("name"))
    pool = pool.select("*", order.alias("_key")).select("*", F.substring("_key", 1, 3).alias("_bkt"))
    ranked = _rank(pool, "_all")
    ranked = ranked.select("id", "country", "name", F.col("_rank").alias("rank"), F.col("_class_n").alias("P"))
    span = ranked.groupBy("id").agg(F.min("rank").alias("start"), F.count(F.lit(1)).alias("m"), F.max("P").alias("P"))
    p = pos.join(span, "id")
    u = F.pmod(_hash_int(F.col("n1"), F.col("n2"), F.col("id"), F.lit(seed)), F.col("P") - F.col("m"))
    target = F.when(u + 1 < F.col("start"), u + 1).otherwise(u + 1 + F.col("m"))
    p = p.where(F.col("P") > F.col("m")).select("n1", "id", "country", target.alias("rank"))
    other = ranked.select(F.col("rank"), F.col("name").alias("n2"), F.col("id").alias("id2"),
                          F.col("country").alias("cc2"))
    return p.join(other, "rank").select("n1", "n2", F.col("id").alias("id1"), "id2",
                                        F.col("country").alias("cc1"), "cc2")


def build_dataset(gaz: DataFrame, n_max: int | None = None, min_names: int = MIN_NAMES, seed: int = SEED,
                  alphabet: str | None = None) -> DataFrame:
    """Positives + negatives in the 9-column layout, de-duplicated
    (H10), balanced and interleaved (I3, ``pos`` = interleave position)."""
    pl = materialize(places(gaz, min_names, alphabet=alphabet), "places")
    pos = materialize(positive_pairs(pl), "positives")  # scored once, read twice
    neg = negative_pairs(pos, pl, seed)
    a = pos.select(F.col("n1").alias("s1"), F.col("n2").alias("s2"), F.lit(1).alias("status"),
                   F.col("id").cast("string").alias("id1"), F.col("id").cast("string").alias("id2"),
                   F.col("country").alias("cc1"), F.col("country").alias("cc2"))
    b = neg.select(F.col("n1").alias("s1"), F.col("n2").alias("s2"), F.lit(0).alias("status"),
                   F.col("id1").cast("string"), F.col("id2").cast("string"), "cc1", "cc2")
    both = materialize(a.unionByName(b).dropDuplicates(), "dataset")
    both = both.select("s1", "s2", "status", "id1", "id2", detect_alphabet("s1").alias("alphabet1"),
                       detect_alphabet("s2").alias("alphabet2"), "cc1", "cc2",
                       F.md5(F.concat_ws("\t", "s1", "s2", F.col("status").cast("string"), "id1", "id2"))
                       .alias("_rowkey"))
    return balanced_sample(both, "status", "_rowkey", n_max, seed).drop("_rowkey")


def region_filter(df: DataFrame, country_col: str, regions: DataFrame, keep: Sequence[str],
                  exclude: Sequence[str] = ()) -> DataFrame:
    """Keep rows whose country maps to a continent in ``keep`` and is
    not in ``exclude``; unknown countries drop.  ``regions`` is the
    caller's ``(country, continent)`` table; its size decides how it is joined."""
    dim = regions.where(F.col("continent").isin(*keep))
    if exclude:
        dim = dim.where(~F.col("country").isin(*exclude))
    return df.join(dim.select(F.col("country").alias(country_col)).distinct(), country_col, "left_semi")


def hard_pairs(gaz: DataFrame, per_place: int = 2, alt_min_len: int = 3, min_names: int = MIN_NAMES,
               seed: int = SEED, alphabet: str | None = None) -> DataFrame:
    """Per place, up to ``per_place`` positive name pairs and up to
    ``per_place`` hard negatives: a name of the previous place (id order)
    with a name of this place that shares grams (jaccard > 0) but differs
    after lower-casing.  Picks are the first by md5 order.  The previous
    place comes from an exact rank (two-level, no global window) and one
    equi-join on it; name products are per row pair."""
    from pyspark.sql import Window

    from toposim.operators.splits import rank_by_key

    pl = places(gaz, min_names, alt_min_len=alt_min_len, alphabet=alphabet)
    ranked = rank_by_key(pl.withColumn("_all", F.lit(0)), "_all", "id").select("id", "country", "names", "_rank")
    prev = ranked.select((F.col("_rank") + 1).alias("_rank"), F.col("id").alias("pid"),
                         F.col("country").alias("pcountry"), F.col("names").alias("pnames"))
    pairs = ranked.join(prev, "_rank")
    cand = pairs.select("id", "country", "pid", "pcountry",
                        F.explode("pnames").alias("x"), "names") \
        .select("id", "country", "pid", "pcountry", "x", F.explode("names").alias("y")) \
        .where(F.lower("x") != F.lower("y"))
    cand = score_pairs(cand, "x", "y", ["jaccard"], "_").where("_jaccard > 0").drop("_jaccard")
    key = F.md5(F.concat_ws("|", F.col("x"), F.col("y"), F.lit(str(seed))))
    w = Window.partitionBy("id").orderBy(key)
    neg = cand.select("*", F.row_number().over(w).alias("rn")).where(F.col("rn") <= per_place) \
        .select(F.col("x").alias("s1"), F.col("y").alias("s2"), F.lit(0).alias("status"),
                F.col("pid").cast("string").alias("id1"), F.col("id").cast("string").alias("id2"),
                F.col("pcountry").alias("cc1"), F.col("country").alias("cc2"))
    pos = positive_pairs(pl)
    pkey = F.md5(F.concat_ws("|", F.col("n1"), F.col("n2"), F.lit(str(seed))))
    pw = Window.partitionBy("id").orderBy(pkey)
    pos = pos.select("*", F.row_number().over(pw).alias("rn")).where(F.col("rn") <= per_place) \
        .select(F.col("n1").alias("s1"), F.col("n2").alias("s2"), F.lit(1).alias("status"),
                F.col("id").cast("string").alias("id1"), F.col("id").cast("string").alias("id2"),
                F.col("country").alias("cc1"), F.col("country").alias("cc2"))
    out = pos.unionByName(neg)
    return out.select("s1", "s2", "status", "id1", "id2", detect_alphabet("s1").alias("alphabet1"),
                      detect_alphabet("s2").alias("alphabet2"), "cc1", "cc2")


#: Similarities at which places are settled, from the highest; the last admits any common gram.
ROUNDS = (0.8, 0.6, 0.4, 0.2, 1e-6)


def similar_pairs(gaz: DataFrame, per_place: int = 2, alt_min_len: int = 3, min_names: int = MIN_NAMES,
                  seed: int = SEED) -> DataFrame:
    """G9 over all places: per place the ``per_place`` pairs (a name of
    another place, a name of this one) of the greatest gram Jaccard > 0
    that differ after lower-casing; ties by md5 order.  ``s1, s2, id1,
    id2, jaccard``; ``id1`` is the least other place with the name.

    A top-k join with a falling bound: names are joined at ``ROUNDS[0]``;
    places with enough pairs at or over the bound are settled, and only the
    others' names are asked again at the next one.  A name that many places
    share is one row of the join, and it keeps its two least places, which
    is all that "another place" needs.
    """
    from pyspark.sql import Window

    from toposim.operators.gramjoin import gram_sets, pairs_above

    pl = places(gaz, min_names, alt_min_len=alt_min_len)
    held = materialize(pl.select(F.col("id").alias("place"), F.explode("names").alias("name")).distinct(), "place-names")
    first = held.groupBy("name").agg(F.min("place").alias("p1"))
    second = held.join(first, "name").where("place <> p1").groupBy("name").agg(F.min("place").alias("p2"))
    names = materialize(first.join(second, "name", "left").withColumn("id", F.monotonically_increasing_id()), "names")
    sets = materialize(gram_sets(names, "id", "name").select("id", "n", "grams"), "name-grams")
    held = materialize(held.join(names.select("name", F.col("id").alias("nid")), "name").select("place", "nid"), "held")
    left, done = held, None
    key = F.md5(F.concat_ws("|", F.col("s1"), F.col("s2"), F.lit(str(seed))))
    for t in ROUNDS:
        asked = left.select(F.col("nid").alias("id")).distinct().withColumn("probe", F.lit(True))
        pairs = pairs_above(materialize(sets.join(asked, "id", "left").withColumn("probe", F.coalesce("probe", F.lit(False))), "asked"), t)
        both = pairs.unionByName(pairs.select(F.col("id2").alias("id1"), F.col("id1").alias("id2"), "jaccard"))
        own = names.select(F.col("id").alias("id2"), F.col("name").alias("s2"))
        other = names.select(F.col("id").alias("id1"), F.col("name").alias("s1"), "p1", "p2")
        d = both.join(own, "id2").join(other, "id1").where(F.lower("s1") != F.lower("s2"))
        d = d.join(left, d["id2"] == left["nid"])
        d = d.withColumn("q", F.when(F.col("p1") != F.col("place"), F.col("p1")).otherwise(F.col("p2"))).where("q IS NOT NULL")
        best = Window.partitionBy("place").orderBy(F.desc(F.round("jaccard", 9)), key)
        d = d.select("place", "s1", "s2", "q", "jaccard", F.row_number().over(best).alias("rn")).where(F.col("rn") <= per_place)
        top = materialize(d, "similar")
        full = top.groupBy("place").count().where(F.col("count") >= per_place).select("place")
        last = t == ROUNDS[-1]
        settled = top if last else top.join(full, "place", "left_semi")
        done = settled if done is None else done.unionByName(settled)
        left = materialize(left.join(full, "place", "left_anti"), "unsettled")
        if last or not left.limit(1).count():
            break
    return done.select("s1", "s2", F.col("q").cast("string").alias("id1"), F.col("place").cast("string").alias("id2"), "jaccard")
