import hashlib

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from leafmill.functions import dtypes
from leafmill.operators import grid as G
from leafmill.operators import reduce as D
from leafmill.operators import temporal
from leafmill.queries import shapes


def kinds(spark, columns):
    cells = spark.createDataFrame([(k, v) for k, vs in columns.items() for v in vs], "col string, value string")
    return {r["col"]: r["dtype"] for r in dtypes.infer(cells, ["col"]).collect()}


def test_dtype_ladder(spark):
    got = kinds(
        spark,
        {
            "zero": ["007", "1"], "minus": ["-0"], "int": ["1", "-5", ""], "dec": ["1", "2.50"], "tiny": ["0.0000001"], "sci": ["1", "1e5"], "bool": ["True", "False"], "low": ["true"],
            "date": ["2024-01-01"], "stamp": ["2024-01-01T10:00"], "bad": ["2024-13-01"], "none": ["", ""], "big": ["99999999999999999999"],
        },
    )
    assert got == {"zero": "string", "minus": "string", "int": "integer", "dec": "decimal", "tiny": "decimal", "sci": "float", "bool": "boolean", "low": "string", "date": "date", "stamp": "datetime", "bad": "string", "none": "string", "big": "string"}


def test_typed_view_never_raises(spark):
    rows = spark.createDataFrame([(0, ["h"] * 6), (1, ["n/a", "1.9", "2024-02-30", "maybe", "1e999", "x"]), (2, [" +7 ", "12", "2024-02-29", "YES", "2", None]), (3, [])], "row_idx bigint, values array<string>")
    v = dtypes.typed_view(rows, [("integer", 0), ("integer", 0), ("date", 0), ("boolean", 0), ("float", 0), ("string", 0)]).orderBy("row_idx").collect()
    assert [tuple(r)[1:3] for r in v] == [(None, None), (7, 12), (None, None)]
    assert v[0]["c2"] is None and str(v[1]["c2"]) == "2024-02-29" and v[1]["c3"] is True


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.text("ab1", max_size=2), min_size=3, max_size=3), min_size=1, max_size=4))
def test_transpose_twice(spark, g):
    df = spark.createDataFrame([(g,)], "grid array<array<string>>")
    assert df.select(G.transpose(G.transpose(F.col("grid")))).first()[0] == g


def test_header_names(spark):
    g = [["Sales", "", ""], ["", "2019", "2020"], ["region", "amount", "amount"], ["n", "1", "2"]]
    df = spark.createDataFrame([(g,)], "grid array<array<string>>")
    assert df.select(G.headers(F.col("grid"), F.array(F.lit(1), F.lit(2)))).first()[0] == ["region", "2019 amount", "2020 amount"]
    assert df.select(G.find_header(F.col("grid"))).first()[0] == 2


def test_unpivot_keeps_filled_cells(spark):
    df = spark.createDataFrame([("a", "1", ""), ("b", None, "4")], "k string, y1 string, y2 string")
    assert G.unpivot(df, ["k"], ["y1", "y2"]).count() == 2


def test_claims_are_disjoint(spark):
    t = spark.createDataFrame([(1, 1, 0, 10, 0, 3), (1, 2, 5, 15, 2, 4), (1, 3, 5, 9, 0, 1), (1, 4, 5, 9, 6, 8)], "region_id int, table_no int, data_start int, data_end int, col_start int, col_end int")
    got = G.claims(t)
    assert G.overlaps(got).count() == 0
    assert {r["table_no"]: r["data_start"] for r in got.collect()} == {1: 0, 2: 10, 4: 5}


def test_greedy_pack(spark):
    items = spark.createDataFrame([("d", i, t) for i, t in enumerate([5, 5, 5, 30, 1, 9, 10])], "doc string, ord int, tokens int")
    got = [(r["ord"], r["bin"]) for r in D.greedy_pack(items, ["doc"], ["ord"], "tokens", 10).orderBy("ord").collect()]
    assert got == [(0, 0), (1, 0), (2, 1), (3, 2), (4, 3), (5, 3), (6, 4)]


def test_tree_reduce_ends_on_an_oversized_item(spark):
    t = spark.createDataFrame([(1, 0, "word " * 500), (1, 1, "Short one. Another.")], "doc int, ord int, text string")
    assert D.tree_reduce(t, ["doc"], "ord", "text", 40, D.extract_summary).count() == 1


def test_upsert_takes_the_latest(spark):
    a = spark.createDataFrame([(1, 1, "old"), (2, 5, "kept")], "k int, at int, v string")
    b = spark.createDataFrame([(1, 2, "new"), (2, 4, "late")], "k int, at int, v string")
    assert {r["k"]: r["v"] for r in D.upsert(a, b, "k", "at").collect()} == {1: "new", 2: "kept"}


def test_upsert_of_all_loads(spark, tmp_path):
    loads = [(i, f"t{n}", f"2024-01-0{n}") for i in range(12) for n in range(1, 2 + i % 3)] + [(12, "x", None), (12, "y", "2024-01-05")]
    df = spark.createDataFrame(loads, "content_id bigint, text string, loaded_at string").withColumn("loaded_at", F.col("loaded_at").cast("timestamp"))
    df.write.parquet(str(tmp_path / "block_texts.parquet"))
    got = {r["content_id"]: str(r["loaded_at"])[:10] for r in shapes.summary_upsert(spark, str(tmp_path)).collect()}
    assert got == {i: f"2024-01-0{1 + i % 3}" for i in range(12)} | {12: "2024-01-05"}


def test_fences_and_markers_in_blocks(spark, tmp_path):
    texts = [(1, "text", "a"), (1, "code", "```\n==LIST==\n```"), (1, "list", "- b"), (2, "title", "==CODE==\nx = 1"), (2, "text", "p == q"), (3, "code", "```py\ny"), (3, "list", "- c"), (4, "text", "==HELLO==")]
    rows = [(i, 1, p, k, x, "2024-01-01") for i, (p, k, x) in enumerate(texts)]
    df = spark.createDataFrame(rows, "block_id bigint, document_id bigint, page_idx int, type string, text string, received_at string")
    df.withColumn("received_at", F.col("received_at").cast("timestamp")).write.parquet(str(tmp_path / "blocks.parquet"))
    got = {(r["page_idx"], r["tag"], r["sections"], r["chars"]) for r in shapes.tag_split(spark, str(tmp_path)).collect()}
    assert got == {(1, "TEXT", 1, 1), (1, "CODE", 1, 16), (1, "LIST", 1, 3), (2, "CODE", 1, 5), (2, "TEXT", 1, 6), (3, "CODE", 1, 20), (4, "TEXT", 1, 9)}


def test_fences_in_documents(spark, tmp_path):
    texts = ["plain", "a\n```\nb\n```", "a\n```\nb", "in a ``` line"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r["digest"] for r in shapes.fence_strip(spark, str(tmp_path)).collect()}
    want = [texts[0], texts[1], f"```markdown\n{texts[2]}\n```", texts[3]]
    assert got == {i: hashlib.md5(x.encode()).hexdigest() for i, x in enumerate(want)}


def test_asof_and_interval(spark):
    left = spark.createDataFrame([(1, 10, "a"), (1, 5, "b"), (2, 7, "c")], "k int, at int, name string")
    right = spark.createDataFrame([(1, 6, 100), (1, 10, 200), (2, 8, 300)], "k int, at int, v int")
    got = {r["name"]: r["v"] for r in temporal.asof(left, right, ["k"], "at", ["v"]).collect()}
    assert got == {"a": 200, "b": None, "c": None}
    p = spark.createDataFrame([(float(i),) for i in range(50)], "x double")
    s = spark.createDataFrame([(3.0, 9.5), (48.0, 90.0)], "lo double, hi double")
    assert temporal.interval_join(p, s, "x", "lo", "hi", 7).count() == 9


def test_interval_join_of_long_spans(spark):
    """A span of any length goes to a few buckets; odd ends hold nothing."""
    from leafmill.operators import temporal

    inf = float("inf")
    points = spark.createDataFrame([(i, float(v)) for i, v in enumerate((-5, 0, 0.5, 3, 1e6, 1e12))] + [(90, None), (91, inf), (92, float("nan"))], "p int, x double")
    spans = spark.createDataFrame([(1, 0.0, 0.0), (2, -1e15, 1e15), (3, 0.25, 4.0), (4, 3.0, 2.0), (5, None, 4.0), (6, 0.0, inf), (7, 999_999.0, 1e6)], "s int, a double, b double")
    got = sorted((r["p"], r["s"]) for r in temporal.interval_join(points, spans, "x", "a", "b", 2).collect())
    assert got == [(0, 2), (1, 1), (1, 2), (2, 2), (2, 3), (3, 2), (3, 3), (4, 2), (4, 7), (5, 2)]
    assert temporal.interval_join(points, spans.limit(0), "x", "a", "b", 2).count() == 0
