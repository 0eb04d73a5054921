import pytest
from pyspark.sql import functions as F

from leafmill import session as S
from leafmill.operators import grid as G
from leafmill.operators import structure as R
from leafmill.plans.lineage import spread
from leafmill.plans.ordering import numbered


def test_windows_and_models(spark):
    grids = spark.createDataFrame([(1, [["h", "i"], ["a", "1"], ["b", "2"], ["note", ""], ["h", "i"], ["c", "3"]]), (2, []), (3, None), (4, [["x", None]])], "block_id bigint, grid array<array<string>>")

    def model(text, kinds):
        if "x" in text.split("\n")[0]:
            raise ValueError("no structure")
        return [{"header_rows": [0], "data_start": 1, "data_end": 3, "col_start": 0, "col_end": 9}, {"data_start": 2, "data_end": 99}]

    got = sorted((r["block_id"], r["table_no"], r["header_rows"], r["data_start"], r["data_end"], r["col_end"]) for r in R.structured(grids, model).collect())
    assert got == [(1, 0, [0], 1, 3, 2), (1, 1, [], 3, 6, 2)]  # bounds held in the grid, the second table moved below the first
    assert R.windows([["abcd" * 10]] * 5, 25) == [(0, 2), (2, 4), (4, 5)] and R.windows([], 9) == []
    small = sorted((r["block_id"], r["data_start"]) for r in R.structured(grids, lambda text, kinds: [{"header_rows": [0], "data_start": 1}], budget=4).collect())
    assert small == [(1, 1), (1, 3), (1, 5), (4, 1)] or all(b in (1, 4) for b, _ in small)


def test_rule_model_and_transposed(spark):
    g = spark.createDataFrame([(1, [["name", "Ann", "Bob"], ["age", "4", "5"], ["", "", ""]])], "block_id bigint, grid array<array<string>>")
    heads, rows = G.transposed_body(F.col("grid"), F.lit(0), F.lit(2), F.lit(0), F.lit(3))
    r = g.select(heads.alias("h"), rows.alias("r")).first()
    assert r["h"] == ["name", "age"] and r["r"] == [["Ann", "4"], ["Bob", "5"]]


def test_union_of_fragments(spark):
    f = spark.createDataFrame([(1, 0, [["h", "i"], ["a", "1"]]), (1, 1, [["h", "i"], ["b", "2"]]), (1, 2, [["c"], ["d", "4", "5"]]), (2, 0, []), (3, 0, None)], "t int, part int, grid array<array<string>>")
    got = [(r["t"], r["row_idx"], r["values"]) for r in R.union_fragments(f, ["t"], ["part"]).orderBy("t", "row_idx").collect()]
    assert got == [(1, 0, ["a", "1"]), (1, 1, ["b", "2"]), (1, 2, ["c", ""]), (1, 3, ["d", "4"])]


def test_conforming_extent(spark):
    p = spark.createDataFrame([(1, 1, "sn"), (1, 2, "s_"), (1, 3, "sn"), (1, 4, "ss"), (1, 5, "sn")], "region_id int, row_idx int, profile string")
    t = spark.createDataFrame([(1, 0, 1, 2), (1, 1, 5, 6)], "region_id int, table_no int, data_start int, data_end int")
    assert sorted((r["table_no"], r["data_end"]) for r in R.conforming_extent(p, t).collect()) == [(0, 4), (1, 6)]


def test_numbers_within_groups(spark):
    rows = [("hot", i) for i in range(500)] + [("cold", 1), ("cold", 0), (None, 7)]
    got = numbered(spark.createDataFrame(rows, "k string, v int"), ["k"], ["v"], sums={"total": "v"}).collect()
    assert sorted((r["k"] or "", r["v"], r["rn"], r["n"], r["total"]) for r in got if r["k"] != "hot") == [("", 7, 0, 1, 7), ("cold", 0, 0, 2, 1), ("cold", 1, 1, 2, 1)]
    assert all(r["rn"] == r["v"] and r["n"] == 500 for r in got if r["k"] == "hot")
    assert numbered(spark.createDataFrame([], "k string, v int"), ["k"], ["v"]).count() == 0


def test_spread_fires_no_job(spark):
    a, b = spark.range(1000), spark.range(1000).withColumnRenamed("id", "k")
    joined = a.join(b.hint("merge"), a.id == b.k).groupBy("id").count()
    tracker = spark.sparkContext.statusTracker()
    before = len(tracker.getJobIdsForGroup())
    assert spread(joined) is joined
    spread(spark.range(10).coalesce(1))
    assert len(tracker.getJobIdsForGroup()) == before


def test_session_leaves_the_cluster_alone(spark, monkeypatch):
    seen = {}

    class Builder:
        def appName(self, n):
            return self

        def master(self, m):
            seen["master"] = m
            return self

        def config(self, k, v):
            seen[k] = v
            return self

        def getOrCreate(self):
            return spark

    monkeypatch.setattr(S.SparkSession, "builder", Builder())
    monkeypatch.setenv("PYSPARK_GATEWAY_PORT", "1")
    S.session("x")
    assert "master" not in seen and "spark.sql.shuffle.partitions" not in seen and "spark.driver.memory" not in seen
    S.session("x", "local[3]")
    assert seen["master"] == "local[3]" and seen["spark.sql.shuffle.partitions"] == "3"


@pytest.mark.parametrize("text", ["", "a,b", "-- x"])
def test_rule_model_takes_any_text(text):
    assert R.rule_model(text, [])[0]["header_rows"] == [0]
