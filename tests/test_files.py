import datetime as dt
import zipfile

import pytest
from pyspark.sql import functions as F
from pyspark.sql.classic.dataframe import DataFrame

from tracelens.plans.catalog import QUERIES
from tracelens.sources import files


def test_csv_null_tokens_and_bad_cells(spark, tmp_path):
    (tmp_path / "a.csv").write_text("serial_number,failure,smart_5_raw\ns1,0,NA\ns2,x,7\n")
    columns = ["serial_number", "failure", "smart_5_raw"]
    got = files.read_csv(spark, str(tmp_path / "a.csv"), columns, strict=False).orderBy("serial_number").collect()
    assert [tuple(r) for r in got] == [("s1", 0, None), ("s2", None, 7)]
    with pytest.raises(Exception):
        files.read_csv(spark, str(tmp_path / "a.csv"), columns).collect()


def test_archives_headers_and_sums(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "q.zip", "w") as z:
        z.writestr("d1.csv", "a,b\n1,2\n")
        z.writestr("d2.csv", "a,b\n3,4\n")
    assert sorted(r["row"] for r in files.unzip_days(spark, str(tmp_path / "q.zip")).collect()) == ["1,2", "3,4", "a,b", "a,b"]
    (tmp_path / "h").mkdir()
    (tmp_path / "h" / "ok.csv").write_bytes(b"a,b\n1,2\n")
    (tmp_path / "h" / "bad.csv").write_bytes(b"a,b\r1,2\r")
    assert sorted(r["sane"] for r in files.sane_headers(spark, str(tmp_path / "h"), 2).collect()) == [False, True]
    assert files.checksums(spark, str(tmp_path / "h")).count() == 2


def test_cache_log_and_schema(spark, tmp_path):
    calls = []

    def make():
        calls.append(1)
        return spark.range(3)

    for _ in range(2):
        assert files.cached(spark, f"file://{tmp_path}/c", make).count() == 3
    assert len(calls) == 1
    log = spark.createDataFrame([(1, "completed"), (2, "failed")], "id long, status string")
    assert sorted(r["id"] for r in files.outstanding(spark.range(3), log, "id").collect()) == [0, 2]
    d = files.with_columns(spark.range(1).withColumn("z", F.lit(1)), {"id": "long", "n": "double"})
    assert d.columns == ["id", "n", "z"] and dict(d.dtypes)["n"] == "double"
    nested = spark.range(1).select(F.struct(F.lit(1).alias("a"), F.struct(F.lit(2).alias("c")).alias("b")).alias("s"))
    assert nested.select(*files.flatten(nested)).columns == ["s_a", "s_b_c"]


def test_csv_columns_are_found_by_name(spark, tmp_path):
    (tmp_path / "a.csv").write_text("failure,serial_number,smart_5_raw,more\n1,s1,7,x\n0,s2,na,y\n")
    (tmp_path / "b.csv").write_text("serial_number,failure\ns3,0\n")
    columns = ["serial_number", "failure", "smart_5_raw"]
    got = files.read_csv(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")], columns).orderBy("serial_number").collect()
    assert [tuple(r) for r in got] == [("s1", 1, 7), ("s2", 0, None), ("s3", 0, None)]


def archive(path, days):
    with zipfile.ZipFile(path, "w") as z:
        for name, text in days.items():
            z.writestr(name, text)


def test_ingest_by_quarter_resumes(spark, tmp_path):
    archive(tmp_path / "q1.zip", {"2020-01-01.csv": "date,serial_number,failure,smart_5_raw\r\n2020-01-01,a,0,NA\r\n", "2020-01-02.csv": "serial_number,date,smart_5_raw,failure,smart_9_raw\na,2020-01-02,5,1,3\nb,2020-01-02,x,0,4\n"})
    archive(tmp_path / "q2.zip", {"2020-04-01.csv": "date,serial_number,failure,smart_5_raw,smart_9_raw\n2020-04-01,b,0,1,2\n"})
    archives = {"2020Q1": str(tmp_path / "q1.zip"), "2020Q2": str(tmp_path / "missing.zip")}
    out, log = str(tmp_path / "out"), str(tmp_path / "log")
    with pytest.raises(Exception):
        files.ingest_quarters(spark, archives, out, log)
    archives["2020Q2"] = str(tmp_path / "q2.zip")
    assert files.ingest_quarters(spark, archives, out, log) == {"2020Q2": 1}
    assert files.ingest_quarters(spark, archives, out, log) == {}
    one = spark.read.parquet(f"{out}/quarter=2020Q1")
    assert one.dtypes == [("date", "date"), ("serial_number", "string"), ("failure", "int"), ("smart_5_raw", "bigint")]
    assert sorted((str(r["date"]), r["serial_number"], r["failure"], r["smart_5_raw"]) for r in one.collect()) == [("2020-01-01", "a", 0, None), ("2020-01-02", "a", 1, 5), ("2020-01-02", "b", 0, None)]
    assert spark.read.parquet(f"{out}/quarter=2020Q2").columns[-1] == "smart_9_raw"
    assert sorted((r["id"], r["status"]) for r in files.read_log(spark, log).collect()) == [("2020Q1", "completed"), ("2020Q2", "completed"), ("2020Q2", "failed")]


def test_tables_and_sinks(spark, tmp_path):
    assert files.run_ddl(spark, "CREATE OR REPLACE TEMP VIEW w1 AS SELECT 1 AS a;\nCREATE OR REPLACE TEMP VIEW w2 AS SELECT ';' AS b") == 2
    assert files.table_exists(spark, "w1") and not files.table_exists(spark, "w3") and files.row_count(spark, "w2") == 1
    assert files.local(spark, "SELECT * FROM w1")["a"].tolist() == [1]
    with pytest.raises(ValueError):
        files.local(spark, "SELECT id FROM range(5)", 4)
    d = spark.range(10).withColumn("x", F.col("id") * 2)
    got = files.run_verified(d, f"{tmp_path}/p", (10, 10), (1, 10**6))
    assert got["ok"] and got["rows"] == 10 and not files.run_verified(d, f"{tmp_path}/p", (11, 99))["ok"]
    assert files.scan(spark, [f"{tmp_path}/p", f"{tmp_path}/p"], ["x"]).count() == 20
    assert [tuple(r) for r in files.schema_of(spark, f"{tmp_path}/p").collect()] == [("id", "bigint"), ("x", "bigint")]
    for kind in ("csv", "json"):
        files.write_text(d, f"{tmp_path}/{kind}", kind)
    assert spark.read.json(f"{tmp_path}/json").count() == spark.read.option("header", True).csv(f"{tmp_path}/csv").count() == 10
    s = spark.readStream.schema(d.schema).parquet(f"{tmp_path}/p")
    files.stream_to_parquet(s, f"{tmp_path}/s", f"{tmp_path}/c").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/s").count() == 10


def test_registry_of_artefacts(spark, tmp_path):
    for f in ("a", "b"):
        (tmp_path / f).mkdir()
    (tmp_path / "b" / "m.bin").write_bytes(b"one")
    import hashlib

    r = files.Registry(spark, [f"{tmp_path}/a", f"{tmp_path}/b"], {"m.bin": hashlib.sha256(b"one").hexdigest()})
    assert r.find("m.bin") == f"{tmp_path}/b/m.bin" and r.check("m.bin") and not r.warnings
    (tmp_path / "a" / "m.bin").write_bytes(b"two")
    assert not r.check("m.bin") and len(r.warnings) == 1
    with pytest.raises(FileNotFoundError):
        r.find("x")


def line_items(spark, path, rows):
    """rows: part, ship date, quantity."""
    spark.createDataFrame([(p, None if d is None else dt.datetime.fromisoformat(d), float(q), 1, "R") for p, d, q in rows], "l_partkey long, l_shipdate timestamp_ntz, l_quantity double, l_linenumber int, l_returnflag string").write.parquet(f"{path}/lineitem.parquet")
    spark.range(10).selectExpr("id AS p_partkey", "'b' AS p_brand", "1 AS p_size").write.parquet(f"{path}/part.parquet")


def test_archives_are_written_by_the_executors(spark, tmp_path, monkeypatch):
    """No archive passes the driver (F1)."""
    line_items(spark, tmp_path, [(1, "1995-01-02", 50), (2, "1995-03-04", 1), (1, "1996-01-02", 7)])
    seen, collect = [], DataFrame.collect
    monkeypatch.setattr(DataFrame, "collect", lambda d: seen.extend(t for _, t in d.dtypes) or collect(d))
    got = sorted(tuple(r) for r in collect(QUERIES["src_15_log"](spark, str(tmp_path))))
    assert got == [("1995", "completed", 2), ("1996", "completed", 1)] and "binary" not in seen


def test_ingest_keeps_rows_without_a_date(spark, tmp_path):
    """A null cell keeps its place in the CSV (F6)."""
    line_items(spark, tmp_path, [(1, "1995-01-02", 50), (2, None, 42)])
    got = {tuple(r) for r in QUERIES["src_14_ingest"](spark, str(tmp_path)).collect()}
    assert got == {("1995", dt.date(1995, 1, 2), "1", 0, 10), (None, None, "2", 0, 2)}
    assert {tuple(r) for r in QUERIES["src_15_log"](spark, str(tmp_path)).collect()} == {("1995", "completed", 1), (None, "completed", 1)}


def test_archives_of_many_pieces(spark, tmp_path):
    """The bytes given to the text writer piece by piece are the archive's."""
    rows = spark.range(300_000, numPartitions=3).selectExpr("id % 2 AS a", "concat('f', id % 3, '.csv') AS f", "concat_ws(',', id, md5(string(id))) AS r")
    found = files.zip_files(rows, "a", "f", "r", "id,hash", f"{tmp_path}/z")
    assert sorted(found) == ["0", "1"]
    for a, path in found.items():
        local = path.removeprefix("file:")
        with zipfile.ZipFile(local) as z:
            assert z.testzip() is None and z.namelist() == ["f0.csv", "f1.csv", "f2.csv"]
        got = files.unzip_days(spark, path)
        assert got.where("line > 0").select("row").exceptAll(rows.where(f"a = {a}").select("r")).isEmpty() and got.count() == 150_003
        assert [tuple(r) for r in files.unzip_days(spark, path, headers=True).orderBy("file").collect()] == [(f"f{i}.csv", 0, "id,hash") for i in range(3)]
