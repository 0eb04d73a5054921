"""Problem 5: the k most similar vectors of the same library for every vector.

Vectors are scaled to length one. A library of more than ``shard_rows`` vectors
is divided among centres fitted on a bounded sample; every vector lives in the
shard of its nearest centre and queries the ``probes`` nearest shards. Each
shard builds a robust-pruned directed graph: greedy (beam) searches propose
neighbours, the relaxed distance rule ``alpha * d(p*, p') <= d(p, p')`` prunes
them to a diverse few, edges are made both ways and pruned again. Queries run a
beam search over the graph, all queries of a shard at once in numpy. Pruning would
keep one of several equal vectors, so a graph holds one vector of each cell of
``CELL`` a dimension; what else lies in a found cell is compared exactly.

Accuracy: :func:`recall` measures the lists of every query whose id is
divisible by 100 against an exact scan of its library.

Defined cases: null, wrongly sized, all-zero and non-finite vectors are unusable
and neither query nor are found; a vector is not its own neighbour, an equal one
is; ties go to the smaller id; a library of fewer than k + 1 usable vectors gives
shorter lists; rows of one id delivered twice count once; a null library is a library.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.lineage import bound_batches, cut, spread
from ..session import table

DIMENSIONS, K, SHARD_ROWS, PROBES = 64, 10, 2048, 3
DEGREE, BEAM, BUILD_BEAM, ALPHA = 24, 28, 24, 1.15
#: Vectors a centre is fitted on, and centres the driver holds.
SAMPLE_PER_CENTRE, MOST_CENTRES = 24, 20_000
#: Width of a cell in each dimension; vectors of one cell differ by less than the root of 64 cells.
CELL = 1e-4


def usable(df: DataFrame, dimensions: int = DIMENSIONS) -> DataFrame:
    """content_id, library_id and the unit vector of the usable rows, one an id (of several, the least vector).

    Checked and scaled a batch at a time, and written down once: every later step reads the unit vectors.
    """

    def clean(batches):
        for batch in batches:
            column = batch.column(2)
            size = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
            right = np.flatnonzero(size == dimensions)
            flat = column.take(pa.array(right, pa.int64())).flatten()
            v = flat.fill_null(float("nan")).to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dimensions)
            norm = np.sqrt((v * v).sum(1))
            good = np.isfinite(norm) & (norm > 0)
            unit = (v[good] / norm[good, None]).astype(np.float32)
            at = pa.array(right[good], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), _lists(unit)], names=["content_id", "library_id", "v"])

    bound_batches(df.sparkSession)
    rows = df.where("embedding is not null").select(F.col("content_id").cast("bigint"), F.coalesce("library_id", F.lit(-1)).cast("int").alias("library_id"), F.col("embedding").cast("array<float>"))
    units = spread(rows).mapInArrow(clean, "content_id bigint, library_id int, v array<float>")
    one = units.groupBy("content_id").agg(F.min(F.struct("library_id", "v")).alias("x"))
    return cut(one.select("content_id", "x.library_id", "x.v"))


def _lists(v: np.ndarray) -> pa.Array:
    """The rows of a matrix as an Arrow list column."""
    return pa.ListArray.from_arrays(pa.array(np.arange(0, v.size + 1, v.shape[1]), pa.int32()), pa.array(v.ravel(), pa.float32()))


def _matrix(column) -> np.ndarray:
    """An Arrow list column as a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1 if len(column) else DIMENSIONS)


def _stack(column) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float32) if len(column) else np.zeros((0, DIMENSIONS), np.float32)


# ---------------------------------------------------------------- the graph of one shard


def search(vectors: np.ndarray, edges: np.ndarray, entries: np.ndarray, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Beam search for all queries at once: ids and similarities, best first; -1 where there are fewer."""
    n, q = len(vectors), len(queries)
    beam = min(beam, n)
    entries = entries[:beam]
    ids = np.full((q, beam), -1, np.int64)
    sims = np.full((q, beam), -np.inf, np.float32)
    seen = np.zeros((q, n), bool)
    opened = np.zeros((q, beam), bool)
    ids[:, : len(entries)] = entries
    sims[:, : len(entries)] = queries @ vectors[entries].T
    seen[:, entries] = True
    live = np.arange(q)
    while len(live):
        s = np.where(opened[live] | (ids[live] < 0), -np.inf, sims[live])
        best = s.argmax(1)
        go = s[np.arange(len(live)), best] > -np.inf
        live, best = live[go], best[go]
        if not len(live):
            break
        opened[live, best] = True
        near = edges[ids[live, best]]
        ok = (near >= 0) & ~seen[live[:, None], near]
        row = np.broadcast_to(live[:, None], near.shape)
        seen[row[ok], near[ok]] = True
        cand = np.where(ok, np.matmul(vectors[near], queries[live][:, :, None])[:, :, 0], -np.inf).astype(np.float32)
        all_sims = np.concatenate([sims[live], cand], 1)
        all_ids = np.concatenate([ids[live], np.where(ok, near, -1)], 1)
        all_open = np.concatenate([opened[live], np.zeros(cand.shape, bool)], 1)
        top = np.argpartition(-all_sims, beam - 1, axis=1)[:, :beam]
        sims[live], ids[live], opened[live] = (np.take_along_axis(x, top, 1) for x in (all_sims, all_ids, all_open))
    order = np.argsort(-sims, axis=1, kind="stable")
    return np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)


def prune(vectors: np.ndarray, points: np.ndarray, cands: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Robust pruning of each point's candidates (-1 for none): at most ``degree`` diverse neighbours."""
    p = len(points)
    cands = np.where(cands == points[:, None], -1, cands)
    order = np.sort(cands, 1)
    repeated = np.zeros(cands.shape, bool)
    at = np.argsort(cands, 1, kind="stable")
    np.put_along_axis(repeated, at, np.concatenate([np.zeros((p, 1), bool), order[:, 1:] == order[:, :-1]], 1), 1)
    ok = (cands >= 0) & ~repeated
    cv = vectors[cands]
    dist = np.where(ok, 1.0 - np.matmul(cv, vectors[points][:, :, None])[:, :, 0], np.inf)
    between = 1.0 - np.matmul(cv, cv.transpose(0, 2, 1))
    out = np.full((p, degree), -1, np.int64)
    rows = np.arange(p)
    for i in range(degree):
        best = dist.argmin(1)
        good = np.isfinite(dist[rows, best])
        if not good.any():
            break
        out[good, i] = cands[rows, best][good]
        covered = alpha * between[rows, best] <= dist
        dist = np.where(covered & good[:, None], np.inf, dist)
        dist[rows, best] = np.inf
    return out


def build(vectors: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, alpha: float = ALPHA) -> tuple[np.ndarray, np.ndarray]:
    """Edges (n x degree, -1 padded) and entry points of a shard's graph."""
    n = len(vectors)
    rng = np.random.default_rng(n)
    centre = vectors.mean(0)
    entries = np.unique(np.concatenate([[int((vectors @ centre).argmax())], rng.choice(n, min(n, 8), replace=False)]))
    edges = np.full((n, degree), -1, np.int64)
    if n <= 1:
        return edges, entries
    if n <= degree:
        others = np.array([[j for j in range(n) if j != i] for i in range(n)])
        edges[:, : n - 1] = others
        return edges, entries
    order = rng.permutation(n)
    done, step = np.zeros(0, np.int64), 32
    while len(done) < n:
        batch = order[len(done) : len(done) + step]
        if len(done):
            own = np.concatenate([entries, done[:1]])
            found, _ = search(vectors, edges, np.unique(own), vectors[batch], beam)
        else:
            found = np.broadcast_to(entries, (len(batch), len(entries)))
        peers = np.broadcast_to(batch[: min(len(batch), 32)], (len(batch), min(len(batch), 32)))
        if len(batch) > 32:  # the nearest of the points inserted together
            sims = vectors[batch] @ vectors[batch].T
            peers = batch[np.argpartition(-sims, 16, axis=1)[:, :16]]
        edges[batch] = prune(vectors, batch, np.concatenate([found, peers], 1), degree, alpha)
        _reverse(vectors, edges, batch, degree, alpha)
        done = order[: len(done) + len(batch)]
        step = min(step * 2, 512)
    return edges, entries


def _reverse(vectors: np.ndarray, edges: np.ndarray, batch: np.ndarray, degree: int, alpha: float) -> None:
    """Edges back to the new points; a node above its degree is pruned again."""
    source = np.repeat(batch, degree)
    target = edges[batch].ravel()
    source, target = source[target >= 0], target[target >= 0]
    order = np.argsort(target, kind="stable")
    source, target = source[order], target[order]
    nodes, at, counts = np.unique(target, return_index=True, return_counts=True)
    for a in range(0, len(nodes), 256):
        part = slice(a, a + 256)
        width = int(counts[part].max())
        lists = np.full((len(nodes[part]), width), -1, np.int64)
        col = np.arange(width)[None, :] < counts[part][:, None]
        lists[col] = source[at[part][0] : at[part][-1] + counts[part][-1]]
        edges[nodes[part]] = prune(vectors, nodes[part], np.concatenate([edges[nodes[part]], lists], 1), degree, alpha)


# ---------------------------------------------------------------- equal vectors


def _groups(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First row of each group of equal rows, and each row's group."""
    _, first, group = np.unique(rows, axis=0, return_index=True, return_inverse=True)
    return first, group.reshape(-1)


def _members(group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows by group in order, and each group's start and size among them."""
    size = np.bincount(group)
    return np.argsort(group, kind="stable"), np.cumsum(size) - size, size


def _expand(groups: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the members of each of ``groups``, and the entry of ``groups`` each belongs to."""
    n = size[groups]
    of = np.repeat(np.arange(len(groups)), n)
    return start[groups][of] + np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n), of


def nearest(base: np.ndarray, queries: np.ndarray, k: int = K, beam: int = BEAM, degree: int = DEGREE):
    """For blocks of queries: query row, base row and similarity of the k + 1 nearest base rows and some more.

    Of equal base rows the first k + 1 can be in a list; of the vectors of a cell all are compared.
    """
    first, copy = _groups((base + np.float32(0)).view(np.int32))
    by_copy, copy_start, copies = _members(copy)
    copies = np.minimum(copies, k + 1)
    distinct = base[first]
    cell_first, cell = _groups(np.round(distinct / CELL).astype(np.int16))
    by_cell, cell_start, cell_size = _members(cell)
    by_cell = by_cell[np.lexsort((first[by_cell], cell[by_cell]))]  # equal similarities go to the earlier row
    rows_in_cell = np.bincount(cell, weights=copies).astype(np.int64)
    graph = distinct[cell_first]
    edges, entries = build(graph, degree)
    slack = 2 * CELL * base.shape[1] ** 0.5
    for a in range(0, len(queries), 1024):
        q = queries[a : a + 1024]
        found, sims = search(graph, edges, entries, q, max(beam, k + 1))
        size = np.where(found >= 0, rows_in_cell[found], 0)
        needed = (found >= 0) & (np.cumsum(size, 1) - size <= k)
        last = np.where(needed, sims, np.inf).min(1, keepdims=True)
        row, col = np.nonzero(needed | ((found >= 0) & (sims >= last - slack)))
        at = found[row, col]
        one = cell_size[at] == 1
        parts = [(row[one], cell_first[at[one]], sims[row[one], col[one]])]
        for c in np.unique(at[~one]):
            own, rows = by_cell[cell_start[c] : cell_start[c] + cell_size[c]], row[at == c]
            for b in range(0, len(rows), step := max(1, 2_000_000 // len(own))):
                s = q[rows[b : b + step]] @ distinct[own].T
                top = np.argsort(-s, axis=1, kind="stable")[:, : k + 1]
                parts.append((np.repeat(rows[b : b + step], top.shape[1]), own[top].ravel(), np.take_along_axis(s, top, 1).ravel()))
        row, at, sim = (np.concatenate(x) for x in zip(*parts, strict=True))
        place, of = _expand(at, copy_start, copies)
        yield a + row[of], by_copy[place], sim[of]


# ---------------------------------------------------------------- shards


def fit_centres(v: np.ndarray, wanted: int, seed: int) -> np.ndarray:
    """Unit centres of a sample by spherical k-means."""
    rng = np.random.default_rng(seed & 0xFFFF)
    c = v[rng.choice(len(v), min(wanted, len(v)), replace=False)].copy()
    for _ in range(8):
        near = np.concatenate([(v[a : a + 4096] @ c.T).argmax(1) for a in range(0, len(v), 4096)])
        sums = np.zeros_like(c)
        np.add.at(sums, near, v)
        empty = np.bincount(near, minlength=len(c)) == 0
        sums[empty] = v[rng.integers(len(v), size=int(empty.sum()))]
        c = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)
    return c


def _draw(share) -> F.Column:
    """Whether a row is among a sample of about ``share``; the same rows at every run."""
    return F.pmod(F.xxhash64("content_id"), F.lit(1 << 20)) < share * (1 << 20)


class Shards:
    """How vectors are divided: centres by library on the driver, and below them, by shard, where those don't suffice.

    ``top`` are at most ``most`` centres fitted on ``sample`` vectors each, so what the
    driver holds and broadcasts is bounded (20,000 centres and 480,000 vectors by
    default). Libraries that need more shards than that are divided again below each
    centre, by centres that are fitted and kept on the executors: shards keep their size.
    """

    def __init__(self, rows: DataFrame, shard_rows: int = SHARD_ROWS, sample: int = SAMPLE_PER_CENTRE, most: int = MOST_CENTRES) -> None:
        self.shard_rows, self.sample = shard_rows, sample
        sizes = {r["library_id"]: r["n"] for r in rows.groupBy("library_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > shard_rows).collect()}
        total = sum(-(-n // shard_rows) for n in sizes.values())
        shrink = min(1.0, most / max(total, 1))
        self.deep = shrink < 1.0
        wanted = {k: max(2, int(-(-n // shard_rows) * shrink)) for k, n in sizes.items()}
        top = {}
        if sizes:
            chance = F.create_map(*[x for k, n in sizes.items() for x in (F.lit(k), F.lit(min(1.0, sample * wanted[k] / n)))])[F.col("library_id")]
            got = rows.where(_draw(chance)).select("library_id", "v").toPandas()
            top = {int(k): fit_centres(_stack(g["v"]), wanted[k], int(k)) for k, g in got.groupby("library_id")}
        self.top = rows.sparkSession.sparkContext.broadcast(top)
        self.below = cut(self._fit_below(rows)) if self.deep else None

    def _fit_below(self, rows: DataFrame) -> DataFrame:
        """library_id, shard and the centres of a shard that is above twice the wanted size, in one binary value."""
        placed = self._place(rows.withColumn("queries", F.lit(False)), _home_only)
        sizes = placed.groupBy("library_id", "shard").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 2 * self.shard_rows)
        wanted = F.ceil(F.col("n") / self.shard_rows).cast("int")
        picked = placed.join(sizes.withColumn("wanted", wanted), ["library_id", "shard"]).where(_draw(F.least(F.lit(1.0), F.lit(self.sample) * F.col("wanted") / F.col("n"))))

        def fit(key, frame):
            c = fit_centres(_stack(frame["v"]), int(frame["wanted"].iloc[0]), int(key[1]))
            return pd.DataFrame({"library_id": [key[0]], "shard": [key[1]], "centres": [c.tobytes()]})

        return picked.groupBy("library_id", "shard").applyInPandas(fit, "library_id int, shard int, centres binary")

    def _place(self, rows: DataFrame, rule) -> DataFrame:
        """Every row in its own shard (home), and as a visitor in those that ``rule`` names."""
        top = self.top

        def assign(batches):
            for batch in batches:
                library, v = batch.column(1).to_numpy(zero_copy_only=False), _matrix(batch.column(3))
                queries = batch.column(2).to_numpy(zero_copy_only=False)
                at, shard, home = [], [], []
                for lib in np.unique(library):
                    own = np.flatnonzero(library == lib)
                    c = top.value.get(int(lib))
                    row, to, first = (np.arange(len(own)), np.zeros(len(own), np.int64), np.ones(len(own), bool)) if c is None else rule(v[own], c, queries[own])
                    at.append(own[row])
                    shard.append(to)
                    home.append(first)
                if at:
                    yield _placed(batch, np.concatenate(at), np.concatenate(shard), np.concatenate(home), batch.column(2), np.zeros(sum(map(len, at)), np.int64))

        return rows.select("content_id", "library_id", "queries", "v").mapInArrow(assign, _PLACED)

    def place(self, rows: DataFrame, rule, below=None) -> DataFrame:
        """``rows``: content_id, library_id, queries, v. ``below``: the rule for visitors of a divided shard."""
        placed = self._place(rows, rule)
        if not self.deep:
            return placed
        below = below or rule
        slots = 4 * rows.sparkSession.sparkContext.defaultParallelism
        # the centres come before the rows of their shard, in each of the partitions a large shard is salted over
        salt = F.explode(F.sequence(F.lit(0), F.lit(slots - 1)))
        none = [F.lit(None).cast(t).alias(c) for c, t in (("content_id", "bigint"), ("queries", "boolean"), ("home", "boolean"), ("v", "array<float>"))]
        heads = self.below.select("library_id", "shard", "centres", *none, F.lit(0).alias("sub"), salt.alias("salt"), F.lit(0).alias("turn"))
        body = placed.withColumns({"centres": F.lit(None).cast("binary"), "salt": F.pmod(F.xxhash64("content_id"), F.lit(slots)).cast("int"), "turn": F.lit(1)})
        both = heads.unionByName(body).repartition(4 * slots, "library_id", "shard", "salt").sortWithinPartitions("library_id", "shard", "salt", "turn")

        def divide(batches):
            key, c = None, None
            for batch in batches:
                library, shard = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
                head = batch.column(2)
                edges = np.flatnonzero(np.concatenate([[True], (library[1:] != library[:-1]) | (shard[1:] != shard[:-1]), [True]]))
                for a, b in zip(edges[:-1], edges[1:], strict=True):
                    if key != (library[a], shard[a]):
                        key, c = (library[a], shard[a]), None
                    if head[int(a)].is_valid:
                        c = np.frombuffer(head[int(a)].as_py(), np.float32).reshape(-1, DIMENSIONS)
                    part = batch.slice(a, b - a)
                    part = part.filter(pc.is_null(part.column(2)))
                    if not part.num_rows:
                        continue
                    part = part.select(["content_id", "library_id", "queries", "v", "shard", "home"])
                    n, own = part.num_rows, part.column(5).to_numpy(zero_copy_only=False)
                    if c is None:
                        yield _placed(part, np.arange(n), part.column(4).to_numpy(), own, part.column(2), np.zeros(n, np.int64))
                        continue
                    v, queries = _matrix(part.column(3)), part.column(2).to_numpy(zero_copy_only=False)
                    row, to, first = [], [], []
                    for mine, use in ((np.flatnonzero(own), rule), (np.flatnonzero(~own), below)):
                        if len(mine):
                            r, t, f = use(v[mine], c, queries[mine])
                            row.append(mine[r])
                            to.append(t)
                            first.append(f & own[mine[r]])
                    at = np.concatenate(row)
                    yield _placed(part, at, part.column(4).to_numpy()[at], np.concatenate(first), part.column(2), np.concatenate(to))

        return both.select("library_id", "shard", "centres", "content_id", "queries", "home", "v").mapInArrow(divide, _PLACED)


_PLACED = "content_id bigint, library_id int, queries boolean, shard int, sub int, home boolean, v array<float>"


def _placed(batch, at: np.ndarray, shard: np.ndarray, home: np.ndarray, queries, sub: np.ndarray) -> pa.RecordBatch:
    take = pa.array(at, pa.int64())
    return pa.RecordBatch.from_arrays(
        [batch.column(0).take(take), batch.column(1).take(take), queries.take(take), pa.array(shard, pa.int32()), pa.array(sub, pa.int32()), pa.array(home, pa.bool_()), batch.column(3).take(take)],
        names=["content_id", "library_id", "queries", "shard", "sub", "home", "v"],
    )


def _home_only(v: np.ndarray, c: np.ndarray, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each vector in the shard of its nearest centre."""
    to = np.concatenate([(v[a : a + 512] @ c.T).argmax(1) for a in range(0, len(v), 512)])
    return np.arange(len(v)), to, np.ones(len(v), bool)


def _probe(probes: int):
    """The rule of searches: a vector's shard is its nearest centre's, and it visits the next ones."""

    def rule(v, c, queries):
        m, row, to = min(probes, len(c)), [], []
        for a in range(0, len(v), 512):  # blocks, so that the scores of many centres stay small
            s = v[a : a + 512] @ c.T
            top = np.argpartition(-s, m - 1, axis=1)[:, :m]
            top = np.take_along_axis(top, np.argsort(-np.take_along_axis(s, top, 1), axis=1, kind="stable"), 1)
            row.append(np.repeat(np.arange(a, a + len(s)), m))
            to.append(top.ravel())
        row, to = np.concatenate(row), np.concatenate(to)
        return row, to, np.arange(len(row)) % m == 0

    return rule


def _reach(least: float):
    """The rule of exact comparisons: a query visits every shard whose dividing plane is near enough to hold ``least``."""
    reach = max(0.0, 2 - 2 * least) ** 0.5

    def rule(v, c, queries):
        row, to, first = [], [], []
        for a in range(0, len(v), 512):
            s = v[a : a + 512] @ c.T
            home = s.argmax(1)
            gap = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (c[home] @ c.T)))
            near = (s.max(1, keepdims=True) - s <= reach * gap + 1e-4) & queries[a : a + 512, None]
            near[np.arange(len(s)), home] = True
            r, t = np.nonzero(near)
            row.append(r + a)
            to.append(t)
            first.append(t == home[r])
        return np.concatenate(row), np.concatenate(to), np.concatenate(first)

    return rule


def _by_shard(placed: DataFrame) -> DataFrame:
    """Few bytes, much work: a fixed number of partitions, which adaptive execution doesn't merge."""
    slots = placed.sparkSession.sparkContext.defaultParallelism
    return placed.repartition(max(4 * slots, int(placed.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "library_id", "shard", "sub").groupBy("library_id", "shard", "sub")


def neighbours(df: DataFrame, k: int = K, shard_rows: int = SHARD_ROWS, probes: int = PROBES, beam: int = BEAM, degree: int = DEGREE) -> DataFrame:
    """content_id, library_id, neighbour_id, similarity and rank: up to k rows a usable vector."""
    rows = usable(df)
    return _lists_of(rows, Shards(rows, shard_rows), k, probes, beam, degree)


def _lists_of(rows: DataFrame, shards: Shards, k: int = K, probes: int = PROBES, beam: int = BEAM, degree: int = DEGREE) -> DataFrame:
    def query(key: tuple[pa.Scalar, ...], frame: pa.Table) -> pa.Table:
        ids = frame["content_id"].to_numpy()
        home = frame["home"].to_numpy()
        order = np.lexsort((ids, ~home))
        v, ids, home = _matrix(frame["v"])[order], ids[order], home[order]
        base, base_ids = v[home], ids[home]
        parts = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        for row, at, sim in nearest(base, v, k, beam, degree) if len(base) else ():
            real = base_ids[at] != ids[row]
            row, at, sim = row[real], at[real], sim[real]
            order = np.lexsort((at, -sim, row))  # base rows are in order of their ids
            row, at, sim = row[order], at[order], sim[order]
            keep = np.arange(len(row)) - np.searchsorted(row, row) < k
            parts.append((ids[row[keep]], base_ids[at[keep]], sim[keep].astype(float)))
        mine, other, sim = (np.concatenate(x) for x in zip(*parts, strict=True))
        return pa.table({"content_id": pa.array(mine, pa.int64()), "library_id": pa.array(np.full(len(mine), key[0].as_py()), pa.int32()), "neighbour_id": pa.array(other, pa.int64()), "similarity": pa.array(sim, pa.float64())})

    placed = shards.place(rows.withColumn("queries", F.lit(True)), _probe(probes), _probe(1))
    found = _by_shard(placed).applyInArrow(query, "content_id bigint, library_id int, neighbour_id bigint, similarity double")

    def merge(column):  # the lists of a vector's shards, at most 2 * probes * k entries
        return F.slice(F.reverse(F.array_sort(column)), 1, k)

    lists = found.groupBy("content_id", "library_id").agg(merge(F.collect_list(F.struct("similarity", (-F.col("neighbour_id")).alias("minus")))).alias("l"))
    return lists.select("content_id", "library_id", F.posexplode("l").alias("rank", "x")).select(
        "content_id", "library_id", (-F.col("x.minus")).alias("neighbour_id"), F.col("x.similarity").alias("similarity"), (F.col("rank") + 1).cast("int").alias("rank")
    )


def exact(queries: DataFrame, rows: DataFrame, k: int = K) -> DataFrame:
    """The true lists of some queries: the stated query set against all rows of its library, in blocks."""
    part = queries.select(F.col("content_id").alias("q"), "library_id", F.col("v").alias("qv"))
    sim = F.aggregate(F.zip_with("qv", "v", lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, x: s + x)
    both = part.join(rows, "library_id").where("q <> content_id").withColumn("similarity", sim)
    order = Window.partitionBy("q").orderBy(F.desc("similarity"), "content_id")
    best = both.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k)
    return best.select(F.col("q").alias("content_id"), F.col("content_id").alias("neighbour_id"), "similarity")


def within(rows: DataFrame, dense: DataFrame, least: float, shards: Shards) -> DataFrame:
    """All pairs of at least ``least`` that have a ``dense`` vector (content_id) in them, exactly.

    A vector nearer to another centre lies beyond the plane between both centres; a dense
    one queries every shard whose plane is within the distance that ``least`` allows.
    """
    marked = rows.join(dense.withColumn("queries", F.lit(True)), "content_id", "left").withColumn("queries", F.coalesce("queries", F.lit(False)))
    marked = marked.join(marked.where("queries").select("library_id").distinct(), "library_id", "left_semi")

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frame = pa.Table.from_batches(list(batches))
        home, dense = frame["home"].to_numpy(), frame["queries"].to_numpy()
        v, ids = _matrix(frame["v"]).astype(float), frame["content_id"].to_numpy()
        base, base_ids, base_dense = v[home], ids[home], dense[home]
        q, q_ids = v[dense], ids[dense]
        for a in range(0, len(q), 256):
            for b in range(0, len(base), 4096):
                x = q_ids[a : a + 256, None]
                y = base_ids[None, b : b + 4096]
                hit = (q[a : a + 256] @ base[b : b + 4096].T >= least) & ((x < y) | ((x > y) & ~base_dense[None, b : b + 4096]))
                row, col = np.nonzero(hit)
                x, y = x[row, 0], y[0, col]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["content_id_a", "content_id_b"])

    return _by_shard(shards.place(marked, _reach(least))).applyInArrow(pairs, "content_id_a bigint, content_id_b bigint")


def pairs(nodes: DataFrame, least: float, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Pairs of a library with a cosine similarity of at least ``least``, checked exactly.

    They are taken from the lists; a vector whose list is full of such neighbours is compared with its library.
    """
    rows = usable(nodes)
    shards = Shards(rows, shard_rows)
    near = cut(_lists_of(rows, shards).where(F.col("similarity") >= least - 1e-4))
    dense = near.where(F.col("rank") == K).select("content_id")
    listed = near.select(F.least("content_id", "neighbour_id").alias("content_id_a"), F.greatest("content_id", "neighbour_id").alias("content_id_b")).distinct()
    v = rows.select("content_id", "v")
    both = listed.join(v.toDF("content_id_a", "va"), "content_id_a").join(v.toDF("content_id_b", "vb"), "content_id_b")
    sim = F.aggregate(F.zip_with("va", "vb", lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, x: s + x)
    found = both.where(sim >= least).select("content_id_a", "content_id_b")
    if dense.isEmpty():  # a look at one row of what is written down
        return found
    return found.union(within(rows, dense, least, shards)).distinct()


def p5_found(spark: SparkSession, folder: str, least: float = 0.97) -> DataFrame:
    """All pairs with a cosine similarity of at least ``least``."""
    return pairs(table(spark, folder, "node_embeddings"), least)


def p5_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """The ten nearest of every usable vector."""
    return neighbours(table(spark, folder, "node_embeddings"))


def recall(nodes: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Share of the true lists that was found, over every query whose id is divisible by 100."""
    rows = usable(nodes)
    queries = rows.where("content_id % 100 = 0")
    truth = exact(queries, rows)
    got = cut(_lists_of(rows, Shards(rows, shard_rows)).where("content_id % 100 = 0").select("content_id", "neighbour_id", F.lit(1).alias("hit")))
    return truth.join(got, ["content_id", "neighbour_id"], "left").agg(F.countDistinct("content_id").alias("queries"), F.count(F.lit(1)).alias("true_neighbours"), F.round(F.count("hit") / F.count(F.lit(1)), 4).alias("recall"))


def p5_recall(spark: SparkSession, folder: str) -> DataFrame:
    """Recall within the libraries."""
    return recall(table(spark, folder, "node_embeddings"))


def p5_recall_pooled(spark: SparkSession, folder: str) -> DataFrame:
    """Recall with all vectors in one library, which is divided among many shards and searched in few of them."""
    return recall(table(spark, folder, "node_embeddings").withColumn("library_id", F.lit(0)))


SQL = {
    "p5_found": """WITH u AS (
        SELECT content_id, coalesce(library_id, -1) AS lib, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM node_embeddings
        WHERE embedding IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
      n AS (SELECT * FROM u WHERE list_inner_product(v, v) > 0)
      SELECT a.content_id AS content_id_a, b.content_id AS content_id_b FROM n a JOIN n b ON a.lib = b.lib AND a.content_id < b.content_id
      WHERE list_cosine_similarity(a.v, b.v) >= 0.97"""
}
QUERIES = {"p5_found": p5_found, "p5_neighbours": p5_neighbours, "p5_recall": p5_recall, "p5_recall_pooled": p5_recall_pooled}
