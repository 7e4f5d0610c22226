"""Queries whose SQL is met to the last bit, and pairs of towers of places with many grounds."""

from __future__ import annotations

import duckdb
import pandas as pd
import pytest

from meshwright.operators import spatial
from meshwright.plans import queries as plans
from meshwright.plans import terrain  # noqa: F401  (registers its queries)


@pytest.fixture
def suppliers(tmp_path):
    """Writes suppliers (key, balance), and checks a query against its SQL; gives its rows."""

    def check(spark, name, rows, parts=()):
        con = duckdb.connect()
        tables = {"supplier": pd.DataFrame([(k, f"s{k}", k % 25, float(v)) for k, v in rows], columns=["s_suppkey", "s_name", "s_nationkey", "s_acctbal"]).astype({"s_nationkey": "int32"})}
        tables["part"] = pd.DataFrame(list(parts) or [(0, 900.0)], columns=["p_partkey", "p_retailprice"])
        for table, df in tables.items():
            con.register("df", df)
            con.execute(f"COPY (SELECT * FROM df) TO '{tmp_path}/{table}.parquet'")
            con.execute(f"CREATE OR REPLACE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet'")
        found = {tuple(r) for r in plans.QUERIES[name](spark, str(tmp_path)).collect()}
        assert found == set(con.execute(plans.ORACLE_SQL[name]).fetchall())
        return found

    return check


def test_a_loss_that_lies_on_a_half(spark, suppliers):
    # 147.33805 dB in SQL, one bit less by Java's functions: another number once rounded
    rows = [(408, -495.0), (977, -245.0), (1408, 5000.0), (2977, -900.0)]
    assert (408, 977, 1473381) in {r[:3] for r in suppliers(spark, "path_loss", rows)}


@pytest.mark.parametrize("name", ["geodesic", "shadow_prefilter", "coarse_sight", "fresnel_summary"])
def test_places_are_paired_once_whatever_the_grounds(spark, suppliers, monkeypatch, name):
    paired, whole = [], spatial.kind_pairs
    monkeypatch.setattr(spatial, "kind_pairs", lambda of, radius: paired.append(of.rows.count()) or whole(of, radius))
    rows = [(k % 20 + 1000 * (k // 20), (k * 7717) % 10999 - 999) for k in range(80)]
    parts = [(k, 880.0 + (k * 7919) % 211) for k in range(2500)]
    assert suppliers(spark, name, rows, parts) and paired == [20]
