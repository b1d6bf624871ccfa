"""Sources and sinks round-trip."""

import json

from pyspark.sql import functions as F

from toposim.operators.osm import pois, streets
from toposim.operators.terms import term_counts
from toposim.plans import views as V
from toposim.sources import readers as R
from toposim.sources import sinks as K


def test_pairs_csv_roundtrip(spark, sf_dir, tmp_path):
    p = V.pairs(spark, sf_dir)
    out = str(tmp_path / "pairs")
    p.write.option("header", True).csv(out)
    back = R.read_pairs(spark, out)
    assert back.count() == p.count()
    assert sorted(back.columns) == sorted(p.columns)
    a = p.select("idx", "Name2", "Class").orderBy("idx").collect()
    b = back.select("idx", "Name2", "Class").orderBy("idx").collect()
    assert a == b


def test_missing_text_becomes_empty(spark, tmp_path):
    f = tmp_path / "p.csv"
    f.write_text("idx,Name1,Name2,Class\n1,,NA,TRUE\n2,a,b,FALSE\n")
    df = R.read_pairs(spark, str(f), columns=["idx", "Name1", "Name2", "Class"])
    rows = {r.idx: r for r in df.collect()}
    assert rows[1].Name1 == "" and rows[1].Name2 == "" and rows[1].Class == 1 and rows[2].Class == 0
    kept = R.read_pairs(spark, str(f), columns=["idx", "Name1", "Name2", "Class"], keep_na_text=True)
    assert {r.idx: r.Name2 for r in kept.collect()}[1] == "NA"


def test_frequent_terms_roundtrip(spark, sf_dir, tmp_path):
    terms = term_counts(V.pairs(spark, sf_dir), ["Name1", "Name2"])
    out = str(tmp_path / "gram_tokens_latin.csv")
    K.write_frequent_terms(terms, out)
    fs = R.read_frequent_terms(spark, out + "/*.csv", k=5)
    got = {r.term for r in fs.collect()}
    top = [r.gram for r in terms.orderBy(F.desc("count"), "stem", "gram").limit(5).collect()]
    assert got == set(top) | {t[::-1] for t in top}


def test_osm_json(spark, tmp_path):
    doc = {"elements": [
        {"type": "node", "id": 1, "lat": 1.0, "lon": 2.0, "tags": {"name": "A", "name:en": "A", "amenity": "cafe"}},
        {"type": "way", "id": 2, "center": {"lat": 3.0, "lon": 4.0}, "tags": {"highway": "x", "name": "S"},
         "geometry": [{"lat": 0.0, "lon": 0.0}, {"lat": 1.0, "lon": 1.0}]},
        {"type": "way", "id": 3, "tags": {"highway": "y"}, "geometry": [{"lat": 0.0, "lon": 0.0}]},
        {"type": "node", "id": 4, "lat": 0.0, "lon": 0.0}]}
    f = tmp_path / "osm.json"
    f.write_text(json.dumps(doc))
    el = R.read_osm_elements(spark, str(f))
    assert el.count() == 4
    s = streets(el).collect()
    assert [r.id for r in s] == [2]
    p = {r.id: r for r in pois(el).collect()}
    assert set(p) == {1, 2, 3} and p[1].name == ["A"] and (p[2].lon, p[2].lat) == (4.0, 3.0)
    K.write_osm_tables(streets(el), pois(el), str(tmp_path / "osm_out"), wkt=True)
    w = spark.read.parquet(str(tmp_path / "osm_out/streets")).first()
    assert w.geometry.startswith("LINESTRING (")


def test_gazetteer_and_name_pairs(spark, tmp_path):
    f = tmp_path / "gaz.tsv"
    row = ["1", "Athens", "Athens", "Athina,Atene,Athen", "37.9", "23.7"] + [""] * 13
    f.write_text("\t".join(row) + "\n")
    g = R.read_gazetteer(spark, str(f)).first()
    assert g.geonameid == 1 and g.alternate_names == ["Athina", "Atene", "Athen"]
    df = spark.createDataFrame([("Athens", "Athina", 1, "1", "1", "LATIN", "LATIN", "GR", "GR")],
                               R.PAIR_FILE_FIELDS)
    K.write_name_pairs(df, str(tmp_path / "np"))
    back = R.read_name_pairs(spark, str(tmp_path / "np")).first()
    assert back.status == 1 and back.s2 == "Athina"


def test_features_roundtrip(spark, tmp_path):
    df = spark.createDataFrame([(1, 0.12345, 1), (2, 0.5, 0)], "index long, f1 double, class int")
    K.write_features(df, str(tmp_path / "fp"))
    back, feats = R.read_features(spark, str(tmp_path / "fp"))
    assert feats == ["f1"] and back.count() == 2
    K.write_features(df, str(tmp_path / "fc"), fmt="csv")
    txt = spark.read.option("header", True).csv(str(tmp_path / "fc")).orderBy("index").first()
    assert txt.f1 == "0.123"


def _odd_elements(n):
    import random
    rnd = random.Random(2)
    nasty = ['plain', 'a "quoted" } name', "back\\slash \\\" }{][", "[{elements}]", "new\nline", 'elements', "ünï ✓"]
    for i in range(n):
        e = {"type": "node", "id": i, "lat": i / 7, "lon": -i / 3, "tags": {"name": rnd.choice(nasty), "k}": "v{", "elements": "elements"}}
        if i % 5 == 0:
            e |= {"type": "way", "center": {"lat": 1.5, "lon": 2.5}, "geometry": [{"lat": float(k), "lon": 0.5} for k in range(rnd.randint(1, 60))]}
        yield e


def test_one_large_json_document(spark, tmp_path):
    """One document without line ends, read by many tasks: equal to reading it whole."""
    f = tmp_path / "big.json"
    doc = {"version": 0.6, "note": "elements", "elements_x": [{"id": -1}], "osm3s": {"elements": [{"id": -2}], "a": [[{"id": -3}]]},
           "elements": list(_odd_elements(1500)), "after": [{"id": -4}], "tail": {"x": "}"}}
    f.write_text(json.dumps(doc, ensure_ascii=False))
    want = sorted(map(repr, spark.read.schema(f"elements array<{R.OSM_ELEMENT.simpleString()}>").option("multiLine", True).json(str(f)).selectExpr("inline(elements)").collect()))
    keep = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for size in (700, 20_000, 10**9):  # ranges shorter than an element, some elements long, one range
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", 1)
            got = R.read_osm_elements(spark, str(f))
            assert sorted(map(repr, got.collect())) == want, size
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)
    assert len(want) == 1500
    (tmp_path / "many").mkdir()
    for k in range(3):
        (tmp_path / "many" / f"{k}.json").write_text(json.dumps({"elements": [{"type": "node", "id": 10 * k + i} for i in range(k)]}, indent=1))
    assert sorted(r.id for r in R.read_osm_elements(spark, str(tmp_path / "many")).collect()) == [10, 20, 21]


def _parts(path):
    return [p.read_text().splitlines() for p in sorted(path.glob("part-*"))]


def test_ordered_parts_with_one_header(spark, tmp_path):
    """Several tasks write; the parts by name are in order; the header is the first line only."""
    terms = spark.range(5000).selectExpr("concat('t', id) gram", "concat('t', id) stem", "pmod(xxhash64(id), 900) count")
    keep = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    try:
        K.write_frequent_terms(terms, str(tmp_path / "gram_tokens_latin.csv"))
        K.write_results(spark.createDataFrame([("a", 0.5), ("b & c", 0.25)], "classifier string, f1 double"), str(tmp_path / "res"), fmt="csv")
        K.write_results(spark.createDataFrame([("d", 0.75)], "classifier string, f1 double"), str(tmp_path / "res"), fmt="csv")
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", keep)
    parts = [p for p in _parts(tmp_path / "gram_tokens_latin.csv") if p]
    lines = [line for p in parts for line in p]
    assert len(parts) > 2 and lines[0] == "gram\tcount" and lines.count("gram\tcount") == 1
    want = sorted(((r.gram, r["count"]) for r in terms.collect()), key=lambda r: (-r[1], r[0]))
    assert lines[1:] == [f"{g}\t{c}" for g, c in want]
    top = {g for g, _ in want[:400]}
    assert {r.term for r in R.read_frequent_terms(spark, str(tmp_path / "gram_tokens_latin.csv") + "/*.csv").collect()} == top | {t[::-1] for t in top}
    lines = [line for p in _parts(tmp_path / "res") for line in p]
    assert lines.count("classifier&f1") == 1 and sorted(lines)[-3:] == sorted(["a&0.5", "classifier&f1", "d&0.75"]) and len(lines) == 4
