"""Contracts, fingerprints, manifests and signals on small files."""

import gzip

import pytest
from pyspark.sql import functions as F

from stampline.operators import signals as s
from stampline.sources import contracts as k
from stampline.sources import ledger as g

SPEC = k.TableSpec("stays", {"id": k.ColumnSpec("bigint", "key", False), "t": k.ColumnSpec("timestamp_ntz"),
                             "x": k.ColumnSpec("double")}, features=("triage_level",))


def test_reads_gz_csv_by_contract(spark, tmp_path):
    path = tmp_path / "stays.csv.gz"
    with gzip.open(path, "wt") as out:
        out.write("id,extra,t,x\n1,a,2024-01-01 00:00:01,2.5\n2,b,,\n")
    df = k.read_contract_table(spark, str(path), SPEC)
    assert df.columns == ["id", "t", "x"] and dict(df.dtypes)["t"] == "timestamp_ntz"
    assert df.schema["id"].metadata == {"role": "key"}
    assert [(r.id, r.x) for r in df.orderBy("id").collect()] == [(1, 2.5), (2, None)]


def test_reads_json_lines(spark, tmp_path):
    (tmp_path / "stays.jsonl").write_text('{"id": 1, "t": "2024-01-01 00:00:00", "x": 1}\n')
    assert k.read_contract_table(spark, str(tmp_path / "stays.jsonl"), SPEC).first().x == 1.0


def test_json_by_contract_keeps_and_counts_broken_lines(spark, tmp_path):
    spec = k.TableSpec("stays", {**SPEC.columns, "tags": k.ColumnSpec("array<string>"), "none": k.ColumnSpec("bigint")})
    path = tmp_path / "stays.jsonl"
    path.write_text('{"id": 1, "x": "2.5", "more": {"a": 1}, "tags": ["p"]}\n{"id": 2, "x":\n[]\nid 3\n'
                    '{"id": 4, "t": "2024-01-01 00:00:00", "x": 1e2, "tags": null}\n')
    df = k.read_contract_table(spark, str(path), spec, corrupt="bad")
    assert df.columns == ["id", "t", "x", "tags", "none", "bad"] and dict(df.dtypes)["x"] == "double"
    got = [(r.id, r.x, r.tags, r.none) for r in df.where("id is not null").orderBy("id").collect()]
    assert got == [(1, 2.5, ["p"], None), (4, 100.0, None, None)]
    assert {r.bad for r in df.collect()} >= {None, '{"id": 2, "x":', "id 3"}
    problems = {(r.column, r.problem): r.rows for r in k.validate_table(df, spec, corrupt="bad").collect()}
    assert problems[("bad", "corrupt")] == problems[("id", "null")] >= 2
    with pytest.raises(ValueError, match="bad: corrupt"):
        k.require_valid(df, spec, corrupt="bad")
    assert k.read_contract_table(spark, str(path), spec).columns == list(spec.columns)
    with pytest.raises(ValueError, match="column of the contract"):
        k.read_contract_table(spark, str(path), spec, corrupt="x")


def test_fingerprint_sums_all_bits_of_each_row(spark):
    import hashlib
    rows = [(1, "a"), (2, None), (2, None), (3, "é|~")]
    df = spark.createDataFrame(rows, "i long, t string")

    def limbs(some):
        digests = [hashlib.sha256("|".join("~" if x is None else f"{len(str(x))}:{x}" for x in r).encode()).hexdigest()
                   for r in some]
        return [sum(int(d[i:i + 5], 16) for d in digests) for i in range(0, 64, 5)]

    got = k.table_fingerprint(df.repartition(3)).first()
    assert (got.n_rows, got.hash) == (4, ":".join(map(str, limbs(rows))))
    one, two = (k.table_fingerprint(df.where(c)).first().hash.split(":") for c in ("i < 3", "i >= 3"))
    assert [int(a) + int(b) for a, b in zip(one, two)] == limbs(rows)  # parts add up
    changed = k.table_fingerprint(spark.createDataFrame([(1, "a"), (2, None), (2, None), (3, "è|~")], df.schema)).first()
    assert all(a != b for a, b in zip(changed.hash.split(":"), got.hash.split(":")))  # one bit of one value
    assert k.table_fingerprint(df.limit(0)).first().hash == ":".join(["0"] * 13)


def test_missing_tables_and_columns(spark, tmp_path):
    with pytest.raises(FileNotFoundError, match="stays"):
        k.read_contract_table(spark, str(tmp_path / "none.parquet"), SPEC)
    assert k.read_contract_table(spark, str(tmp_path / "none.parquet"), SPEC, required=False) is None
    assert k.dropped_features({"stays": None}, [SPEC]) == ["triage_level"]
    (tmp_path / "bad.csv").write_text("id,x\n1,2\n")
    with pytest.raises(ValueError, match=r"stays: missing column\(s\) t"):
        k.read_contract_table(spark, str(tmp_path / "bad.csv"), SPEC)


def test_validate_names_every_problem(spark):
    df = spark.createDataFrame([("1", "x"), (None, "2.5")], "id string, x string")
    got = sorted((r.column, r.problem, r.rows) for r in k.validate_table(df, SPEC).collect())
    assert got == [("id", "null", 1), ("t", "absent", None), ("x", "uncastable", 1)]
    with pytest.raises(ValueError, match="t: absent"):
        k.require_valid(df, SPEC)


def test_prefix_names_must_not_collide(spark):
    assert k.prefixed_columns(["a_x-1", "b"], ["a_"]) == {"a_x-1": "a_x_1"}
    with pytest.raises(ValueError, match="collide"):
        k.prefixed_columns(["a_x-1", "a_x+1"], ["a_"])
    with pytest.raises(ValueError, match="expected 2"):
        k.prefixed_columns(["a_x"], ["a_"], 2)
    cohort = spark.createDataFrame([(1,)], "id long")
    twice = spark.createDataFrame([(1, 2.0), (1, 3.0)], "id long, a_x double")
    with pytest.raises(ValueError, match="repeats"):
        k.select_by_prefix(cohort, twice, ["a_"], "id")


@pytest.mark.parametrize("fmt", ["parquet", "csv", "json"])
def test_write_and_recheck(spark, tmp_path, fmt):
    df = spark.range(20).withColumn("x", F.col("id") * 2)
    meta = k.write_derived(df, str(tmp_path / f"t_{fmt}"), fmt).first()
    back = spark.read.option("header", True).format(fmt).load(str(tmp_path / f"t_{fmt}"))
    back = back.select(*sorted(back.columns))
    k.require_fingerprint(back, meta.n_rows, meta.hash)
    with pytest.raises(ValueError, match="fingerprint"):
        k.require_fingerprint(back.limit(3), meta.n_rows, meta.hash)


def test_manifest_keeps_the_urgent_entry_and_refuses_strays(spark):
    rows = [(r"C:\x\files\a.hea ", 3), ("root/files/a.hea", 19), ("files/b.hea", 18), ("/z/files/c.hea", 0), (None, 1)]
    df = spark.createDataFrame(rows, "p string, fold long")
    split = {"train": list(range(18)), "val": [18], "test": [19]}
    got = g.manifest_build(df, "p", "fold", split, ["test", "val", "train"]).orderBy("place").collect()
    assert [(r.place, r.path, r.split) for r in got] == [
        (0, "files/a.hea", "test"), (1, "files/b.hea", "val"), (2, "files/c.hea", "train")]
    bad = spark.createDataFrame([("nowhere/a", 1)], "p string, fold long")
    with pytest.raises(Exception, match="unrecognised path"):
        g.manifest_build(bad, "p", "fold", split, ["test", "val", "train"]).collect()


def test_header_bytes(spark):
    rows = [("r 2 500 10\na 16 x\nb 16x2 x",), ("r 2 500 10\na 16 x\nb 212 x",), ("r 2 500",), ("r x 500 y",), ("",)]
    df = spark.createDataFrame(rows, "h string")
    assert [r.n for r in df.select(g.expected_bytes(F.col("h")).alias("n")).collect()] == [40, None, None, None, None]


def test_file_listing(spark, tmp_path):
    (tmp_path / "a.dat").write_bytes(b"1234")
    rows = g.file_listing(spark, str(tmp_path)).collect()
    assert [(r.path.rsplit("/", 1)[1], r.length) for r in rows] == [("a.dat", 4)]


def test_fallback_label_and_lost_artefacts(spark):
    latest = spark.createDataFrame([("a", "x", 0, 1), ("a", "all", 0, 2), ("a", "y", 0, 3)],
                                   "arm string, label string, seed int, run_id long")
    cells = spark.createDataFrame([("a", "x", 0), ("a", "y", 0), ("b", "x", 0)], "arm string, label string, seed int")
    alive = spark.createDataFrame([(1,), (2,)], "run_id long")
    got = {(r.arm, r.label): r.run_id for r in
           g.resolve_cells(cells, latest, alive, ["arm", "label", "seed"], "label", "all").collect()}
    assert got == {("a", "x"): 1, ("a", "y"): 2, ("b", "x"): None}


def test_gap_filling(spark):
    df = spark.createDataFrame([(1, [[None, 1.0, None, 3.0, None], [9.0, None, None, None, -9.0], [None] * 5])],
                               "id long, leads array<array<double>>")
    got = s.signal_clean(df).first().leads
    assert got[0] == [None, 1.0, 2.0, 3.0, 3.0]
    assert got[1] == [3.0, 3.0, 0.0, -3.0, -3.0]  # clipped after interpolation
    assert got[2] == [None] * 5


def test_decimation_keeps_a_constant(spark):
    assert sum(s.fir_taps(5)) == pytest.approx(1.0)
    df = spark.createDataFrame([(1, [[2.0] * 40])], "id long, leads array<array<double>>")
    assert s.signal_decimate(df, 5).first().leads[0] == pytest.approx([2.0] * 8)


def test_crops(spark):
    df = spark.createDataFrame([(1, [[1.0, None, 3.0, 4.0]])], "id long, leads array<array<double>>")
    got = s.fixed_crops(df, 2).orderBy("crop").collect()
    assert [r.crop_leads for r in got] == [[[1.0, 0.0]], [[3.0, 4.0]]]
    with pytest.raises(Exception, match="does not divide"):
        s.fixed_crops(df, 3).collect()
    a, b = [s.hashed_crop(df, 2, "id", 1, e).first().offset for e in (0, 0)]
    assert a == b and 0 <= a <= 2
