import subprocess
import sys

import __spark_entry__ as entry
from leafmill import catalogue


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert all(callable(f) for f in entry.queries().values())


def test_core_stands_alone():
    code = "import sys; sys.modules['leafmill.llm'] = None\nimport __spark_entry__ as e\nassert not any(k.startswith('p8_') for k in e.queries()) and len(e.queries()) > 100"
    assert subprocess.run([sys.executable, "-c", code], check=False).returncode == 0


def test_flagship(spark, tmp_path):
    c = spark.createDataFrame([(1, "a", 0, 1.5, "X"), (2, "b", 0, 2.5, "Y")], "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string")
    o = spark.createDataFrame([(1, 1, "F", 10.25, "2024-01-01", "p"), (2, 1, "F", 5.0, "2024-01-02", "p"), (3, 2, "O", 1.0, "2024-01-03", "p")], "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate string, o_orderpriority string")
    c.write.parquet(str(tmp_path / "customer.parquet"))
    o.write.parquet(str(tmp_path / "orders.parquet"))
    assert sorted(tuple(r) for r in catalogue.flagship(spark, str(tmp_path)).collect()) == [("X", 2, 15.25), ("Y", 1, 1.0)]
