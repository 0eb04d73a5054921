from pyspark.sql import functions as F

from leafmill.sources import files
from leafmill.streaming import flow, ingest

UNITS = "doc_id bigint, page_idx int, page_count int"


def test_barrier_merges_once(spark, tmp_path):
    store, merged = str(tmp_path / "units"), str(tmp_path / "merged")
    calls = []

    def merge(rows):
        calls.append(sorted({r["doc_id"] for r in rows.collect()}))
        return rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("pages"))

    batches = [[(1, 0, 2), (2, 0, 1)], [(1, 0, 2), (2, 0, 1), (3, 0, 3)], [(1, 1, 2), (3, 2, 3)], [(3, 1, 3), (1, 1, 2)]]
    n = [flow.barrier(spark.createDataFrame(b, UNITS), store, merged, merge, i) for i, b in enumerate(batches)]
    assert n == [1, 0, 1, 1] and calls == [[2], [1], [3]]
    assert sorted((r["doc_id"], r["pages"]) for r in spark.read.parquet(merged).collect()) == [(1, 2), (2, 1), (3, 3)]


def test_failed_merge_runs_again(spark, tmp_path):
    store, merged = str(tmp_path / "units"), str(tmp_path / "merged")
    rows = spark.createDataFrame([(1, 0, 1), (2, 0, 1)], UNITS)

    def broken(r):
        raise RuntimeError("lost")

    try:
        flow.barrier(rows, store, merged, broken)
    except RuntimeError:
        pass
    for _ in range(2):  # the batch again, and once more after its claims
        flow.barrier(rows, store, merged, lambda r: r.select("doc_id"))
    assert sorted(r["doc_id"] for r in spark.read.parquet(merged).collect()) == [1, 2]


def test_barrier_in_a_stream(spark, tmp_path):
    src = str(tmp_path / "src")
    for b in ([(1, 0, 2)], [(1, 0, 2), (5, 0, 1)], [(1, 1, 2)]):
        spark.createDataFrame(b, UNITS).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(UNITS).option("maxFilesPerTrigger", 1).parquet(src)
    q = flow.merge_stream(stream, str(tmp_path / "u"), str(tmp_path / "m"), str(tmp_path / "cp"), lambda r: r.groupBy("doc_id").agg(F.max("page_idx").alias("last")))
    q.awaitTermination()
    assert sorted((r["doc_id"], r["last"]) for r in spark.read.parquet(str(tmp_path / "m")).collect()) == [(1, 1), (5, 0)]


def test_retries(spark):
    seen = {"n": 0}

    def reader(df):
        seen["n"] += 1
        bad = ["/b"] if seen["n"] < 3 else []
        ok = df.select("path", F.lit("text").alias("kind"), F.lit(0).alias("page_idx"), F.lit(0).alias("ordinal"), F.when(F.col("path").isin([*bad, "/c"]), "error").otherwise("text").alias("type"))
        return ok

    found = spark.createDataFrame([("/a",), ("/b",), ("/c",)], "path string")
    got = {r["path"]: (r["type"], r["attempt"]) for r in files.read_with_retries(found, reader).collect()}
    assert got == {"/a": ("text", 1), "/b": ("text", 3), "/c": ("error", 3)} and seen["n"] == 3
    assert files.read_with_retries(found.limit(0), reader).count() == 0


def test_claims_turns_and_cleaning(spark, tmp_path):
    libs = spark.createDataFrame([(1, "ingested", "2024-01-01 00:00:00"), (2, "processing", None), (3, "ingested", None)], "library_id int, status string, ingested_at string")
    ledger = str(tmp_path / "claims")
    assert [flow.claim(flow.claimable(libs), ledger, "library_id").count() for _ in range(2)] == [1, 0]
    units = spark.createDataFrame([("a", 0), ("a", 1), ("a", 2), ("b", 0), ("c", 0), ("c", 1)], "doc string, page int")
    assert [(r["doc"], r["page"]) for r in flow.fair_order(units, ["doc"], ["page"]).orderBy("turn").collect()] == [("a", 0), ("b", 0), ("c", 0), ("a", 1), ("c", 1), ("a", 2)]
    store = str(tmp_path / "old")
    spark.createDataFrame([(1, "2024-01-01 00:00:00"), (2, "2024-01-03 00:00:00"), (3, None)], "k int, at string").withColumn("at", F.col("at").cast("timestamp_ntz")).write.parquet(store)
    assert flow.clean(spark, store, "at", now="2024-01-03 12:00:00") == 1 and {r["k"] for r in spark.read.parquet(store).collect()} == {2, 3}
    assert flow.clean(spark, str(tmp_path / "none"), "at") == 0


class _State:
    def __init__(self, value=None, timed_out=False):
        self.value, self.hasTimedOut = value, timed_out

    exists = property(lambda self: self.value is not None)
    get = property(lambda self: self.value)

    def update(self, v):
        self.value = v

    def remove(self):
        self.value = None

    def setTimeoutDuration(self, ms):
        self.timeout = ms


def test_a_finished_document_does_not_time_out(monkeypatch):
    """The state function itself: with a wait set, only a document under way is reported at its timeout."""
    import pandas as pd

    kept = {}

    class Pages:
        def groupBy(self, key):
            return self

        def applyInPandasWithState(self, run, *rest):
            kept["run"] = run

    ingest.complete_documents(Pages(), wait="1 hour")
    run, state = kept["run"], _State()
    page = lambda i: iter([pd.DataFrame({"page_idx": [i], "page_count": [2]})])
    assert not list(run((7,), page(0), state)) and state.timeout == 3_600_000
    late = list(run((7,), iter(()), _State(state.value, True)))
    assert late[0].to_dict("records") == [{"doc_id": 7, "pages": 1, "complete": False}]
    assert list(run((7,), page(1), state))[0]["complete"].tolist() == [True]
    assert not list(run((7,), iter(()), _State(state.value, True)))


def test_delimited_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("k;v\n1;\"x;y\"\n2\n3;z;more\n")
    (tmp_path / "b.csv").write_text("k;v\n9;\"a \"\"q\"\"\"\n")
    got = sorted((r["path"][-5:], r["row_idx"], r["values"]) for r in files.read_delimited(spark, str(tmp_path), ";").collect())
    assert got == [("a.csv", 0, ["k", "v"]), ("a.csv", 1, ["1", "x;y"]), ("a.csv", 2, ["2", ""]), ("a.csv", 3, ["3", "z"]), ("b.csv", 0, ["k", "v"]), ("b.csv", 1, ["9", 'a "q"'])]
