"""The subpackage's operators on small frames: nulls, repeats, empty tables, clashing names, hot keys."""

import numpy as np
from pyspark.sql import functions as F

from leafmill.llm import encoding, language, markup, mixing, neighbours, packing, pieces, scans, truncation
from leafmill.llm.latest import latest


def test_ids_and_counts(spark):
    df = spark.createDataFrame([(1, "a b", 9), (1, "a b", 9), (2, None, 1), (3, "", 1), (4, " ", 1)], "doc_id bigint, text string, ids int")
    got = {(r["doc_id"], tuple(r["ids"])) for r in encoding.token_ids(df).collect()}
    assert got == {(1, (64, 275)), (2, ()), (3, ()), (4, (220,))} and encoding.token_ids(df).count() == 5
    assert {r["doc_id"]: r["tokens"] for r in encoding.token_counts(df, ["doc_id"]).collect()} == {1: 2, 2: 0, 3: 0, 4: 1}
    assert encoding.token_ids(df.limit(0)).count() == 0


def test_pieces(spark):
    df = spark.createDataFrame([(1, "x " * 2000, 0), (2, None, 0), (3, "", 0), (4, "short", 0)], "k bigint, text string, piece int")
    got = pieces.split_items(df, ["k"]).groupBy("k").count().collect()
    assert {r["k"]: r["count"] for r in got} == {1: 3, 3: 1, 4: 1}
    assert {r["k"] for r in pieces.split_items(df, ["k"], only_long=True).select("k").distinct().collect()} == {1}


def test_latest_breaks_ties(spark):
    df = spark.createDataFrame([(1, 5, "b"), (1, 5, "a"), (1, 4, "z"), (2, None, None)], "k int, at int, v string")
    assert {r["k"]: r["v"] for r in latest(df, "k", "at", [F.col("v")], {"v": F.col("v")}).collect()} == {1: "b", 2: None}


def test_packing(spark):
    rows = [(1, i, 100 + i, 200) for i in range(9)] + [(1, 9, 200, 1200), (2, 0, 300, None), (None, 0, 301, 10), (None, None, 302, 20)]
    df = spark.createDataFrame(rows, "document_id bigint, block_ordinal int, content_id bigint, tokens int")
    packed = packing.pack(df, group_blocks=1000)
    b = packing.batches(packed)
    assert b.agg(F.max("content_tokens")).first()[0] <= 512
    per = {r["document_id"]: (r["n"], r["t"]) for r in b.groupBy("document_id").agg(F.count(F.lit(1)).alias("n"), F.sum("content_tokens").alias("t")).collect()}
    assert per == {1: (7, 3000), 2: (1, 0), None: (2, 30)}
    assert packing.pack(df.limit(0)).count() == 0
    small = packing.batches(packing.pack(df, group_blocks=4))  # a large document in several groups
    assert small.agg(F.sum("content_tokens")).first()[0] == 3030


def test_packing_under_three_limits(spark):
    """Blocks that one limit alone would put together: the dot product keeps all three, and no document loses a token."""
    rows = [(1, i, i, 40, 40 if i % 2 else 0) for i in range(24)] + [(2, i, 100 + i, 5, 0) for i in range(40)] + [(3, i, 200 + i, 100, 100) for i in range(10)] + [(4, 0, 300, 500, 500)]
    df = spark.createDataFrame(rows, "document_id bigint, block_ordinal int, content_id bigint, tokens int, loss int")
    limits = {"capacity": 512, "segments": 16, "loss": 256}
    b = {r["document_id"]: r for r in packing.batches(packing.pack(df, **limits)).groupBy("document_id").agg(F.count(F.lit(1)).alias("n"), F.max("content_tokens").alias("t"), F.max("segments").alias("s"), F.max("loss_tokens").alias("l"), F.sum("content_tokens").alias("all"), F.sum("loss_tokens").alias("all_loss")).collect()}
    assert all(r["t"] <= 512 and r["s"] <= 16 and r["l"] <= 256 for r in b.values())
    assert [(b[i]["all"], b[i]["all_loss"]) for i in (1, 2, 3, 4)] == [(960, 480), (200, 0), (1000, 1000), (500, 256)]
    assert [b[i]["n"] for i in (1, 2, 3, 4)] == [2, 3, 5, 1]  # bound by tokens, by segments, by loss; a block above the loss limit stays whole
    one = {r["document_id"]: r["n"] for r in packing.batches(packing.pack(df.drop("loss"), capacity=512)).groupBy("document_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert one == {1: 2, 2: 1, 3: 2, 4: 1}  # tokens alone break the other limits


def test_packing_of_one_key(spark):
    """All blocks under one ordinal, or without a document: packed in runs, none lost, bins told apart."""
    rows = [(1, 0, i, 100) for i in range(1000)] + [(None, 7, 5000 + i, 100) for i in range(500)]
    df = spark.createDataFrame(rows, "document_id bigint, block_ordinal int, content_id bigint, tokens int")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "150")
    packed = packing.pack(df, group_blocks=64)
    assert packed.count() == packed.select("content_id").distinct().count() == 1500
    b = packing.batches(packed)
    assert b.agg(F.max("content_tokens")).first()[0] == 500
    assert b.where("document_id = 1").count() == 15 * 13 + 8
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")


def test_neighbours(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(260, 64))
    rows = [(i, 1, [float(x) for x in base[i]]) for i in range(240)] + [(240, 1, [2.0 * float(x) for x in base[3]]), (241, 2, [float(x) for x in base[3]]), (242, None, [1.0] * 64)]
    rows += [(300, 1, None), (301, 1, [1.0] * 63), (302, 1, [0.0] * 64), (303, 1, [float("nan")] * 64), (5, 1, [float(x) for x in base[5]])]
    df = spark.createDataFrame(rows, "content_id bigint, library_id int, embedding array<float>")
    got = neighbours.neighbours(df, shard_rows=60, probes=5)
    truth = neighbours.exact(neighbours.usable(df), neighbours.usable(df)).select("content_id", "neighbour_id")
    found = got.select("content_id", "neighbour_id")
    assert truth.join(found, ["content_id", "neighbour_id"], "left_semi").count() >= 0.95 * truth.count()
    first = got.where("content_id = 3 and rank = 1").first()
    assert first["neighbour_id"] == 240 and abs(first["similarity"] - 1) < 1e-5
    assert got.groupBy("content_id").count().agg(F.max("count")).first()[0] == 10
    assert got.where("content_id in (241, 242, 300, 301, 302, 303)").count() == 0 and neighbours.neighbours(df.limit(0)).count() == 0


def _skewed():
    """Random vectors, 40 equal ones, 40 parallel ones of other lengths."""
    rng = np.random.default_rng(8)
    base = rng.normal(size=(300, 64))
    v = np.concatenate([base, np.repeat(base[:1], 39, 0), base[1] * rng.uniform(0.1, 9, (39, 1))])[rng.permutation(378)]
    return v


def test_neighbours_among_copies(spark):
    v = _skewed()
    df = spark.createDataFrame([(i, 1, [float(x) for x in r]) for i, r in enumerate(v)], "content_id bigint, library_id int, embedding array<float>")
    got = neighbours.neighbours(df).toPandas()
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    sim = unit @ unit.T
    np.fill_diagonal(sim, -2)
    assert got.groupby("content_id").size().tolist() == [10] * len(v)
    best = np.sort(sim, 1)[:, ::-1][:, :10]
    mine = np.array([sim[a, b] for a, b in got.sort_values(["content_id", "rank"])[["content_id", "neighbour_id"]].to_numpy()]).reshape(-1, 10)
    assert (mine >= best - 1e-5).mean() >= 0.99
    same = sim > 1 - 1e-6
    assert (mine[same.sum(1) >= 10] > 1 - 1e-6).all()
    a = int(np.nonzero((v[:, None] == v[None]).all(2).sum(1) == 40)[0][0])
    copies = [j for j in np.nonzero((v == v[a]).all(1))[0] if j != a]
    assert got[got["content_id"] == a].sort_values("rank")["neighbour_id"].tolist() == copies[:10]


def test_pairs_beyond_the_lists(spark, tmp_path):
    rng = np.random.default_rng(9)
    middle = rng.normal(size=(2, 64))
    v = np.concatenate([_skewed(), middle[0] + 0.1 * rng.normal(size=(30, 64)), middle[1] + 0.17 * rng.normal(size=(25, 64))])
    rows = [(i, 1, [float(x) for x in r]) for i, r in enumerate(v)] + [(900, 2, [float(x) for x in v[0]])]
    df = spark.createDataFrame(rows, "content_id bigint, library_id int, embedding array<float>")
    df.write.parquet(str(tmp_path / "node_embeddings.parquet"))
    unit = v.astype(np.float32).astype(float)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    truth = {(int(a), int(b)) for a, b in zip(*np.nonzero(unit @ unit.T >= 0.97), strict=True) if a < b}
    assert len(truth) > 2 * 780 + 435
    for found in (neighbours.p5_found(spark, str(tmp_path)), neighbours.pairs(df, 0.97, shard_rows=60)):
        got = [tuple(r) for r in found.collect()]
        assert len(got) == len(set(got)) and set(got) == truth


def test_mixing(spark):
    counts = spark.createDataFrame([(i, "big" if i % 3 else "small", 0, 1 + i % 50) for i in range(900)] + [(900, "none", 0, 9), (901, None, 0, 9), (902, "big", 0, 0)], "doc_id bigint, source string, part int, tokens bigint")
    targets = spark.createDataFrame([("big", 0.4, 1), ("small", 0.5, 5), ("gone", 0.1, 3)], "source string, target_share double, max_repeats int")
    mixed = mixing.mix(counts, targets)
    got = {r["source"]: r for r in mixing.shares(mixed, mixing.rates(counts, targets)).collect()}
    assert abs(got["big"]["share_of_budget"] - 0.4) < 0.005 and abs(got["small"]["share_of_budget"] - 0.5) < 0.005
    assert got["gone"]["used_tokens"] == 0 and got["gone"]["capped"] and got["big"]["most_copies"] == 1 and got["small"]["most_copies"] <= 5
    assert mixed.where("source not in ('big', 'small')").count() == 0
    again = mixing.mix(counts.repartition(7), targets)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, mixed.collect()))
    assert mixing.mix(counts.limit(0), targets).count() == 0


def test_markup_templates(spark):
    rows = [("b", i, "h", i, "prose", "text", f"<nav><a href='/x'>Home of the archive {i}</a></nav><p>Text <b>{i}</b></p>") for i in range(30)]
    rows += [("b", 100, "other", 1, "prose", "text", "<nav><a href='/x'>Home of the archive 1</a></nav>"), ("b", 101, "h", 101, "prose", "text", None), ("b", 102, "h", 102, "prose", "text", "a < 3"), ("b", 103, "h", 103, "prose", "raw", '{"text": "\\u003cb>x\\u003c/b>"}')]
    df = spark.createDataFrame(rows, "origin string, item_id bigint, host string, page bigint, place string, form string, text string")
    got = {r["item_id"]: r["clean_text"] for r in markup.convert(df).collect()}
    assert got[5] == "Text 5" and "Home" in got[100] and got[103] == "x" and 101 not in got and 102 not in got
    assert markup.convert(df.limit(0)).count() == 0


def test_templates_follow_the_host(spark):
    """On a small host ten pages make a template, on a large one a share of its pages; Markdown pages have templates too."""
    row = "origin string, item_id bigint, host string, page bigint, place string, form string, text string"
    menu, bar = "<ul><li>Archive of the harbour</li></ul>", "[Home](/) | [Archive](/a) | [Contact](/c)"
    rows = [("b", i, "small", i, "prose", "text", f"{menu}<p>Page <b>{i}</b></p>") for i in range(25)]
    rows += [("b", 1000 + i, "other", i, "prose", "text", f"<ul><li>Item of page {chr(97 + i)}{chr(97 + i)}{chr(97 + i)} alone</li></ul>") for i in range(25)]
    rows += [("b", 2000 + i, "large", i, "prose", "text", f"{menu}<p>Page <b>{i}</b></p>") for i in range(12)] + [("b", 3000 + i, "large", 100 + i, "prose", "text", "Plain.") for i in range(700)]
    rows += [("b", 4000 + i, "md", i, "prose", "text", f"{bar}\n\n# Title {i}\n\nText of the page.") for i in range(15)]
    rows += [("b", 5000 + i, "same", i, "prose", "text", "**The very same text** of one paragraph") for i in range(15)]
    df = spark.createDataFrame(rows, row)
    got = {r["item_id"]: r for r in markup.convert(df).collect()}
    assert got[3]["clean_text"] == "Page 3" and got[3]["templates"] >= 1
    assert "Item of page" in got[1003]["clean_text"] and got[1003]["templates"] == 0
    assert "Archive" in got[2003]["clean_text"]  # twelve of 712 pages are below the share
    assert got[4003]["clean_text"] == "Title 3\n\nText of the page." and got[5003]["clean_text"] == "The very same text of one paragraph"
    found = markup.templates_of(markup.parsed_items(df), df).collect()
    assert {(r["host"], r["pages"], r["host_pages"]) for r in found} == {("small", 25, 25), ("md", 15, 15)}


def test_languages(spark):
    docs = spark.createDataFrame([(1, "the board approved the annual statement of the year.", "en-US"), (2, "der Vorstand genehmigte den Jahresabschluss des Jahres.", " DE "), (3, None, "en"), (4, "", None)], "doc_id bigint, text string, lang string")
    model = language.train(docs, ["de", "en"])
    assert {(r["doc_id"], r["label"], r["lang"]) for r in language.languages_of(docs, model).collect()} == {(1, "en", "en"), (2, "de", "de")}
    assert {(r["doc_id"], r["start_char"], r["end_char"]) for r in language.segments_of(docs, model).collect()} == {(1, 0, 52), (2, 0, 55)}
    assert language.languages_of(docs.limit(0), model).count() == 0


def test_limits(spark):
    rng = np.random.default_rng(6)
    n = np.minimum(np.exp(rng.normal(5.2, 0.6, 600)), 320).astype(int)
    rows = [("blocks", i, "s", "text", "x" * int(k)) for i, k in enumerate(n)] + [("blocks", 9999, None, "text", "a b"), ("blocks", 10000, "s", "text", None)]
    df = spark.createDataFrame(rows, "origin string, item_id bigint, source string, kind string, text string")
    assert {(r["source"], r["limit"]) for r in truncation.limits(df).collect()} == {("s", 320)}
    assert truncation.limits(df.limit(0)).count() == 0


def test_shards_below_shards(spark):
    """Where the driver's centres don't suffice, shards are divided again and no vector or pair is lost."""
    rng = np.random.default_rng(3)
    middles = rng.normal(size=(40, 64))
    v = np.concatenate([m + 0.1 * rng.normal(size=(12, 64)) for m in middles])
    df = spark.createDataFrame([(i, 1, [float(x) for x in r]) for i, r in enumerate(v)], "content_id bigint, library_id int, embedding array<float>")
    rows = neighbours.usable(df)
    shards = neighbours.Shards(rows, shard_rows=20, most=3)
    assert shards.deep and shards.below.count() == 3 and len(shards.top.value[1]) == 3
    placed = shards.place(rows.withColumn("queries", F.lit(True)), neighbours._probe(3), neighbours._probe(1)).cache()
    homes = placed.where("home")
    assert homes.count() == homes.select("content_id").distinct().count() == len(v)
    assert homes.groupBy("shard", "sub").count().agg(F.max("count")).first()[0] < 120
    got = neighbours._lists_of(rows, shards)
    truth = neighbours.exact(rows, rows).select("content_id", "neighbour_id")
    assert truth.join(got, ["content_id", "neighbour_id"], "left_semi").count() >= 0.95 * truth.count()
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    pairs = {(int(a), int(b)) for a, b in zip(*np.nonzero(unit @ unit.T >= 0.97), strict=True) if a < b}
    found = neighbours.within(rows, rows.select("content_id"), 0.97, shards).collect()
    assert len(pairs) > 2000 and {tuple(r) for r in found} == pairs and len(found) == len(pairs)


def test_cut_texts(spark, tmp_path):
    """Fitted endings and censoring together: each can decide, and complete notes are none."""
    import random

    rng = random.Random(8)
    who = "The field station|The harbour authority|A second witness|The survey group|Each regional office|The board of trustees".split("|")
    did = "approved|recorded|amended|withdrew|confirmed|published".split("|")
    what = "the annual statement|the depreciation schedule|a list of open claims|the sworn affidavit|the measurement protocol|the shipping calendar".split("|")
    when = "after a long discussion|within ten working days|near the old customs house|before the end of the month|without further delay".split("|")

    def text(n):
        return " ".join(f"{rng.choice(who)} {rng.choice(did)} {rng.choice(what)} {rng.choice(when)}." for _ in range(n))

    rows, cuts = [], set()
    for i in range(900):
        t = text(rng.randint(1, 4))
        if i % 25 == 0:
            t, _ = t[: rng.randint(25, len(t) - 2)], cuts.add(i)
        rows.append((i, "text", t, "free"))
    rows += [(1000 + i, "text", f"{rng.choice(['Visit of', 'Call with', 'Parcel for'])} {rng.choice(['auditor', 'clerk', 'tenant'])}", "free") for i in range(60)]
    held = [text(rng.randint(1, 4))[:180] for _ in range(120)]
    stop = "The field station approved the annual statement. "
    held += [(stop * 4)[:179] + "."] * 1
    rows += [(2000 + i, "text", t, "held") for i, t in enumerate(held)]
    rows += [(3000, "text", None, "free"), (3001, "text", "", None), (3002, "text", " \n", "free"), (3003, "list", "12 - 4", "free")]
    spark.createDataFrame(rows, "block_id bigint, type string, text string, source string").write.parquet(str(tmp_path / "blocks.parquet"))
    spark.createDataFrame([], "batch_id bigint, source string, summary string").write.parquet(str(tmp_path / "content_batches.parquet"))
    got = {r["item_id"]: r for r in truncation.judged(spark, str(tmp_path)).collect()}
    free = {i for i, r in got.items() if r["source"] == "free" and r["cut"] and r["inside"]}
    assert free <= cuts and len(free) >= 0.85 * len(cuts)
    full = [r for r in got.values() if r["source"] == "held" and r["limit"] == 180]
    assert len(full) > 40 and all(r["cut"] for r in full) and not got[2120]["inside"]
    assert got[2120]["ending_ratio"] < 0 < got[2120]["log_odds"]
    assert not {3000, 3001, 3002, 3003} & set(got)


def test_rows_of_one_id_are_numbered(spark, tmp_path):
    docs = [(1, "a b", "s"), (2, "c", "s"), (2, "c", "s"), (2, "d e f", "s"), (None, "x", "s"), (None, "y y", "s"), (3, "z", "other")]
    spark.createDataFrame(docs, "doc_id bigint, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([("s", 1.0, 2)], "source string, target_share double, max_repeats int").write.parquet(str(tmp_path / "source_targets.parquet"))
    got = mixing.document_tokens(spark, str(tmp_path))
    assert sorted((r["doc_id"] or 0, r["part"]) for r in got.collect()) == [(0, 0), (0, 1), (1, 0), (2, 0), (2, 1), (2, 2)]
    assert mixing.p9_mix(spark, str(tmp_path)).agg(F.sum("copies")).first()[0] == 6


def test_odd_language_codes(spark, tmp_path):
    """A null code names no language; repeated ones name one."""
    spark.createDataFrame([("en", "English"), (None, None), ("de", "German"), ("en", "again")], "code string, name string").write.parquet(str(tmp_path / "languages.parquet"))
    assert language._codes(spark, str(tmp_path)) == ["de", "en"]


def _scans(spark, folder, blocks):
    """The tables of problem 6 with these blocks, in documents of fifty."""
    blocks = spark.createDataFrame(blocks, "block_id bigint, type string, text string, y double").withColumn("document_id", F.expr("block_id div 50"))
    blocks.select("block_id", "document_id", F.lit(1).alias("page_idx"), "type", "text", F.expr("array(10D, y, 500D, 90D)").alias("bbox")).write.parquet(f"{folder}/blocks.parquet")
    blocks.select(F.col("document_id").alias("doc_id"), F.lit("Ledger").alias("title"), F.lit(None).cast("array<string>").alias("paratext")).distinct().write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "content_id bigint, document_id bigint, type string, heading string, search_text string").write.parquet(f"{folder}/content_nodes.parquet")
    return str(folder)


def test_confusions_come_from_all_blocks(spark, tmp_path, monkeypatch):
    """A confusion met only in blocks that a sample of 44,000 by the hash of their ids leaves out is learnt and repaired."""
    import random

    rng, n = random.Random(6), 50_000
    vocabulary = "the harbour station registered statement postponed customs minister pasture master history dusty because venue panel major wooden field opinion council budget repair window number".split()
    draw = F.pmod(F.xxhash64("id", F.lit(5)), F.lit(1 << 20)) / float(1 << 20)
    left_out = [r["id"] for r in spark.range(n).where(draw >= 44_000 / n).orderBy("id").limit(10).collect()]
    bad = dict(zip(left_out, [w.replace("st", "kx", 1) for w in vocabulary if "st" in w], strict=False))
    rows = [(i, "text", " ".join([*rng.choices(vocabulary, k=4), *([bad[i]] if i in bad else []), "record."]), float(i)) for i in range(n)]
    folder = _scans(spark, tmp_path, rows)
    ed = scans.editor_of(spark, folder)
    assert set(ed.channel.weight) == {("kx", "st")} and ed.channel.weight["kx", "st"] == len(bad) > 6
    assert len(ed.heights) == 20 and abs(ed.heights[10] - n / 2) < 16
    monkeypatch.setattr(scans, "editor_of", lambda *_: ed)
    fixed = {r["item_id"]: r["repaired_text"] for r in scans.p6_repaired(spark, folder).where("words + joins + furniture > 0").collect()}
    assert fixed == {i: rows[i][2].replace("kx", "st") for i in bad}


def test_confusions_by_a_join(spark):
    """Over a table the same as in one process."""
    import random

    rng = random.Random(2)
    usual = list(dict.fromkeys("".join(rng.choices(["ba", "ker", "ton", "mil", "gra", "sed", "vor", "pal", "facade"], k=rng.randint(2, 3))) for _ in range(200)))
    rare = [w.replace(a, b, 1) for w in usual for a, b in (("k", "lc"), ("m", "rn"), ("e", "o"), ("a", "")) if a in w and rng.random() < 0.4]
    words = {w: 1.0 + rng.randrange(3) for w in [*rare, "12345", "4fade", "x9y9"]} | {w: 1000.0 + i for i, w in enumerate(usual)}
    words = {w: c for w, c in words.items() if len(w) > 3}
    want = scans.learn_channel(list(words), np.array(list(words.values())))
    got = scans.corpus_channel(spark.createDataFrame([(w, n, True, w.isalpha()) for w, n in words.items()], "word string, n float, small boolean, plain boolean"))
    assert len(want.weight) >= 3 and (got.weight, got.strong, got.triples, got.alphabet) == (want.weight, want.strong, want.triples, want.alphabet)
    middle = want.ratios[len(want.ratios) // 2]
    assert len(got.ratios) == 1000 and 0.9 < got.ratios[500] / middle < 1.1


def test_scans_of_little(spark, tmp_path):
    """Empty tables, null heights and ids, texts without words."""
    for name, rows in (("none", []), ("few", [(None, "text", "one text.", None), (1, "text", "", float("nan")), (2, "header", " ", 0.0), (3, "text", None, -7.0), (5, "header", "  ", float("inf")), (6, "header", "", 5e-324), (4, "list", "- 12", 5.0)])):
        (tmp_path / name).mkdir()
        got = scans.p6_repaired(spark, _scans(spark, tmp_path / name, rows)).collect()
        assert sorted(r["repaired_text"] for r in got) == (["", "- 12", "one text."] if rows else []) and not any(r["words"] + r["joins"] + r["furniture"] for r in got)
