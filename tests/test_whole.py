"""Queries over the whole of their tables, on inputs where a subset would show."""

import hashlib

import pytest

from tracelens.plans.catalog import QUERIES


@pytest.mark.parametrize("name", ["hyp_04_holm", "hyp_05_benjamini_hochberg"])
def test_family_is_the_whole_table(name, spark, tmp_path):
    m = 200
    spark.range(1, m + 1).withColumnRenamed("id", "s_suppkey").write.parquet(f"{tmp_path}/supplier.parquet")
    got = {r["id"]: (r["p_adjusted"], r["reject"]) for r in QUERIES[name](spark, str(tmp_path)).collect()}
    family = sorted(((i * 37 % 101 + 1) / 2000, i) for i in range(1, m + 1))
    want, worst = {}, 0.0 if name == "hyp_04_holm" else 1.0
    if name == "hyp_04_holm":
        for k, (p, i) in enumerate(family):
            worst = max(worst, (m - k) * p)
            want[i] = (min(worst, 1.0), int(worst < 0.05))
    else:
        for k, (p, i) in reversed(list(enumerate(family, 1))):
            worst = min(worst, m * p / k)
            want[i] = (worst, int(worst <= 0.05))
    assert got.keys() == want.keys()
    for i, (adjusted, reject) in want.items():
        assert got[i] == (pytest.approx(adjusted, abs=1e-8), reject)


def test_set_queries_read_all_rows(spark, tmp_path):
    ids = spark.range(1, 101)
    ids.selectExpr("id AS p_partkey", "CAST(id % 4 + 1 AS INT) AS p_size").write.parquet(f"{tmp_path}/part.parquet")
    ids.selectExpr("id + 50 AS s_suppkey", "CAST(id % 25 AS INT) AS s_nationkey", "0.5D AS s_acctbal").write.parquet(f"{tmp_path}/supplier.parquet")
    ids.selectExpr("id AS c_custkey", "CAST(id % 24 AS INT) AS c_nationkey", "CAST(id AS DOUBLE) AS c_acctbal").write.parquet(f"{tmp_path}/customer.parquet")
    run = lambda name: sorted(tuple(r) for r in QUERIES[name](spark, str(tmp_path)).collect())
    assert run("set_06_key_difference") == [(24,)]
    assert run("set_07_upsert") == [(i, float(i) if i <= 100 else 0.5) for i in range(1, 151)]
    assert run("set_09_explode_range") == [(p, i) for p in range(1, 101) for i in range(1, p % 4 + 2)]


def test_forest_has_the_librarys_trees(spark, sf_dir, monkeypatch):
    from tracelens.models import batch

    kept = []
    monkeypatch.setattr(batch, "evaluate", lambda model, df, label: kept.append(model) or df)
    QUERIES["mod_02_forest"](spark, sf_dir)
    assert kept[0].pipeline.stages[-1].getNumTrees == 300


def test_scoped_pull_sums_above_a_long(spark, tmp_path):
    base, codes = 2**62, {m for m in range(10) if int(hashlib.md5(str(m).encode()).hexdigest()[:8], 16) % 10 < 3}
    spark.range(100).selectExpr(f"id + {base} AS event_id", "TIMESTAMP_NTZ '2024-01-01 00:00:00' AS ts", "1L AS user_id", "'view' AS event_type", "1D AS value", "'{\"k\": 1}' AS props").write.parquet(f"{tmp_path}/events.parquet")
    spark.range(10).selectExpr("id AS s_suppkey", "1 AS s_nationkey").write.parquet(f"{tmp_path}/supplier.parquet")
    got = {r["pull"]: (r["n"], r["s"]) for r in QUERIES["lbl_05_scoped_pull"](spark, str(tmp_path)).collect()}
    ids = [base + i for i in range(100)]
    assert codes and got["collection_events"] == (100, sum(ids))
    assert got["machine_events"] == (10 * len(codes), sum(i for i in ids if i % 10 in codes))
    assert got["residency"][0] == len(codes) and got["capacity"] == (len(codes), sum(codes))
