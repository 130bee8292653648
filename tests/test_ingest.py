import pytest
from pyspark.sql import functions as F

from cohortweave.functions.text import split_key, strip_decoration
from cohortweave.operators import identity as I
from cohortweave.operators import joins as J
from cohortweave.operators import splits as SP
from cohortweave.operators import tables as S
from cohortweave.sources import loaders as L
from cohortweave.sources import sinks as K
from cohortweave.sources.specs import AreaRule, CohortSpec, MarkerRule, TableSpec


@pytest.fixture
def csv_dir(tmp_path):
    (tmp_path / "base.csv").write_text(
        "File,pid,X:X,Y:Y,Type,size,Z,CD8:Cyc_3_ch_2,NA,Ki67 - cycling\n"
        "r1,1,1.5,2.0,T,10,2,0.5,1,7\nr1,1,nan,3.0,NA,9,0,,2,8\nr2,2,4.0,4.0,B,8,4,0.1,NaN,9\n")
    (tmp_path / "patients.csv").write_text("pid,age\n1,60\n2,70\n")
    (tmp_path / "twice.csv").write_text("pid,age\n1,60\n1,61\n")
    (tmp_path / "markers.txt").write_text("NA\nKi67 - cycling\n")
    return tmp_path


def spec(d, **kw):
    base = dict(name="X", platform="p", tissue="t", role="train", px_um=0.5,
                base=TableSpec(f"{d}/base.csv", "csv", {"image_id": "File", "patient_id": "pid", "x_px": "X:X", "y_px": "Y:Y", "native_label": "Type"}),
                markers=MarkerRule("range", start="CD8:Cyc_3_ch_2", end="Ki67 - cycling"),
                area=AreaRule("divide", numerator="size", denominator="Z"))
    return CohortSpec(**{**base, **kw})


def test_standard_table(spark, csv_dir):
    df, markers = L.load(spark, spec(csv_dir))
    assert df.columns[:9] == ["cell_id", "cohort", "image_id", "patient_id", "x_px", "y_px", "area_px2", "native_label", "label_confidence"]
    rows = {r["cell_id"]: r for r in df.collect()}
    assert sorted(rows) == [0, 1, 2] and markers == ["CD8:Cyc_3_ch_2", "NA", "Ki67 - cycling"]
    na = next(r for r in rows.values() if r["native_label"] == "NA")  # the label NA is data
    assert na["x_px"] is None and na["area_px2"] is None and na["CD8:Cyc_3_ch_2"] is None and na["NA"] == 2.0
    assert all(r["image_id"].startswith("X|") and r["label_confidence"] == 1.0 for r in rows.values())


def test_marker_rules_and_errors(spark, csv_dir):
    cols = L.columns_of(spark, f"{csv_dir}/base.csv", "csv")
    assert L.resolve_markers(spark, MarkerRule("file", path=f"{csv_dir}/markers.txt", header=False), cols) == ["NA", "Ki67 - cycling"]
    assert L.resolve_markers(spark, MarkerRule("pattern", regex="Cyc"), cols) == ["CD8:Cyc_3_ch_2"]
    with pytest.raises(KeyError):
        L.resolve_markers(spark, MarkerRule("range", start="nope", end="NA"), cols)
    with pytest.raises(ValueError):
        L.resolve_markers(spark, MarkerRule("range", start="NA", end="File"), cols)
    with pytest.raises(KeyError):
        L.load(spark, spec(csv_dir, base=TableSpec(f"{csv_dir}/base.csv", "csv", {"image_id": "gone"})))


def test_join_must_be_n_to_one(spark, csv_dir):
    ok = TableSpec(f"{csv_dir}/patients.csv", "csv", {"age": "age"}, ("pid",), ("pid",))
    assert L.load(spark, spec(csv_dir, joins=(ok,)))[0].count() == 3
    bad = TableSpec(f"{csv_dir}/twice.csv", "csv", {"age": "age"}, ("pid",), ("pid",))
    with pytest.raises(J.RuleViolation):
        L.load(spark, spec(csv_dir, joins=(bad,)))


def test_column_absent_in_one_cohort_is_null(spark, csv_dir):
    other = spec(csv_dir, name="Y", markers=MarkerRule("pattern", regex="^NA$"))
    df = L.load_all(spark, [spec(csv_dir), other])
    m = df.groupBy("cohort").agg(F.count("`Ki67 - cycling`").alias("k"))
    assert {r["cohort"]: r["k"] for r in m.collect()} == {"X": 3, "Y": 0}


def test_sink_round_trip(spark, csv_dir, tmp_path):
    df, _ = L.load(spark, spec(csv_dir, markers=MarkerRule("pattern", regex="^NA$")))
    K.write_standard(df, str(tmp_path / "std"))
    back = spark.read.parquet(str(tmp_path / "std"))
    assert K.table_diff(df, back.select(*df.columns)).first()["status"] == "same content"
    assert K.table_diff(df, back.drop("NA")).first()["status"] == "different"


def test_name_parsing(spark):
    raw = ["CD8 - cytotoxic T cells:Cyc_3_ch_2", "pSTAT3", "phospho-S6", "CD45RO", "H3K9ac", "PD-L1:other", "p53", "HH3K27me3"]
    df = spark.createDataFrame([(r,) for r in raw], "raw string").withColumn("s", strip_decoration("raw")).withColumn("k", split_key("s"))
    got = {r["raw"]: tuple(r["k"]) for r in df.collect()}
    assert got["CD8 - cytotoxic T cells:Cyc_3_ch_2"] == ("CD8", "pan", "none")
    assert got["pSTAT3"] == ("STAT3", "pan", "phospho") and got["phospho-S6"] == ("RPS6", "pan", "phospho")
    assert got["CD45RO"] == ("CD45", "RO", "none") and got["H3K9ac"] == ("H3", "K9ac", "none") and got["HH3K27me3"] == ("H3", "K27me3", "none")
    assert got["PD-L1:other"] == ("PD-L1", "pan", "none") and got["p53"] == ("p53", "pan", "none")


def test_resolver_never_guesses(spark):
    names = spark.createDataFrame([("a", "PD-1"), ("a", "NA"), ("b", "foo"), ("b", "two")], "cohort string, raw_column string")
    cx = spark.createDataFrame([("NA", "Na", "ELEMENT", "")], "key string, name string, kind string, members string")
    ov = spark.createDataFrame([], "key string, gene string, id string")
    sym = spark.createDataFrame([
        ("symbol", "PD1", "PDCD1", "ID:1"),
        ("alias", "foo", "A", "ID:2"), ("alias", "FOO", "B", "ID:3"), ("previous", "foo", "C", "ID:4"),
        ("symbol", "two", "X", "ID:5"), ("symbol", "two", "Y", "ID:6"), ("previous", "TWO", "Z", "ID:7"), ("previous", "NA", "XK", "ID:8")],
        "source string, spelling string, symbol string, id string")
    r = {x["raw_column"]: x for x in I.resolve(I.parse_names(names), cx, ov, sym).collect()}
    assert r["PD-1"]["triple"] == "ID:1|pan|none"
    assert r["NA"]["kind"] == "non_protein"  # sodium, not a gene
    assert r["foo"]["kind"] == "unknown" and r["foo"]["note"] == "alias_conflict:A|B"
    assert r["two"]["gene"] == "Z"  # a spelling with several hits is no answer


def test_splits_do_not_leak(spark):
    rows = [("A", f"A|i{i}", f"A|p{i // 2}", f"c{i}") for i in range(40)] + [("B", f"B|i{i}", "B|same", f"d{i}") for i in range(10)]
    cells = spark.createDataFrame(rows, "cohort string, image_id string, patient_id string, cell_id string")
    plan = SP.split_plan(cells)
    assert plan.groupBy("cohort", "unit").agg(F.countDistinct("part").alias("k")).where("k > 1").isEmpty()
    s = {r["cohort"]: r for r in SP.split_summary(plan).collect()}
    assert (s["A"]["unit_kind"], s["A"]["units_test"], s["A"]["units_val"]) == ("patient", 4, 2)
    assert (s["B"]["unit_kind"], s["B"]["units_test"], s["B"]["units_val"]) == ("image", 2, 1)
    with pytest.raises(J.RuleViolation):
        SP.attach_split(cells.withColumn("image_id", F.lit("new")), plan)
    two = spark.createDataFrame([("A", "i", "p"), ("A", "i", "q")], "cohort string, image_id string, patient_id string")
    assert SP.nesting_violations(two).count() == 1


def test_unmeasured_is_not_zero(spark):
    long = spark.createDataFrame([(1, "a", 0.0), (1, "b", 0.5), (2, "a", 0.2)], "id int, marker string, value double")
    vocab = spark.createDataFrame([("a", 0), ("b", 1)], "marker string, idx int")
    v = {r["id"]: r for r in S.panel_vectors(long, vocab, ["id"]).collect()}
    assert v[1]["u"] == [0.0, 0.5] and v[2]["u"] == [0.2, None] and v[2]["present"] == [True, False]
    z = {r["id"]: r for r in S.panel_vectors(long, vocab, ["id"], fill=0.0).collect()}
    assert z[2]["u"] == [0.2, 0.0] and z[2]["present"] == [True, False]
