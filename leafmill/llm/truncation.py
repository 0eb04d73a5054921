"""Problem 4: texts cut off by field limits or in transfer, and each source's share of them.

Per source, a log-normal length distribution is fitted by maximum likelihood,
lengths at a candidate limit being right-censored there (the true text was at
least that long). A candidate limit is a length, in characters or in UTF-8
bytes, that far more different texts of the source have than the fitted
distribution allows. A value's censoring posterior is the fitted share of the
texts at its length that only a limit can explain.

Ending evidence is a log-likelihood ratio of "cut at random" against "ended",
from signs of the end: closing punctuation, markup, a replacement character, open
brackets, a last word that is the beginning of words but no word, how often the
last word ends texts, how often complete texts open like this one. Counts are
taken over all texts, in tables of a fixed size. The weights of the signs are
fitted, not set: texts of a bounded sample (``SAMPLE_ROWS``) are cut at random
places and told from the sample as it came by logistic regression; as that holds
cut texts itself, expectation-maximisation weighs each of its rows by how likely
it is complete. The prior is the share of cut texts that broken words tell.

A value was cut where its posterior odds, the censoring odds (or the prior)
times the ending's likelihood ratio, are above one: a length at a limit can
outweigh a full stop, and an ending a length that is at no limit. ``inside``
tells whether the text then stops inside a word or sentence, as ``p4_found`` asks.

Defined cases: null, empty and blank texts are not cut; ties can't occur; a null
source is a source of its own; repeated rows are judged alike and come out once
in ``p4_found``; a source with too few texts has no limit and goes by endings; a
corpus too small to fit weights has no cut texts but those at a limit.
"""

from __future__ import annotations

import math
import random
import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.lineage import bound_batches, cut, spread
from ..session import table
from . import textkit as T

#: Slots of each count table (the broadcast's proven size: six float32 tables).
SLOTS = 1 << 18
#: Rows the weights of the ending evidence are fitted on, about, and texts that they need at least.
SAMPLE_ROWS, LEAST_ROWS = 8000, 30
#: Rows at least so likely cut in the first comparison, which is with all rows, are set aside from the complete ones.
SET_ASIDE = 0.1
#: The sign of a text that stops inside a word.
TORN = "no word but a beginning"
#: Texts at one length, and their excess over the fit, that make it a candidate limit; below longer texts of the source it takes more, and different ones.
LIMIT_ROWS, LIMIT_RATIO, INNER_ROWS, INNER_RATIO = 5, 6.0, 30, 20.0
_END = re.compile(r"[.!?…。！？][\"'”’»)\]」』）*_]*$")
#: What follows a complete text's last word in markup (fixed patterns).
_MARKUP_END = re.compile(r"(</[A-Za-z][A-Za-z0-9]*>|<br\s*/?>|/>|\}\}|\]\]|\|\}|```|\\end\{[a-z*]+\}|-->|\*\*|\$|\\\)|\\\]|__|\}|''|~~|`|</\w+&gt;|&gt;|==)$")


def texts_of(spark: SparkSession, folder: str) -> DataFrame:
    """origin, item_id, source, kind and text of the blocks (text and list) and batches."""
    blocks = table(spark, folder, "blocks").where(F.col("type").isin("text", "list"))
    batches = table(spark, folder, "content_batches")
    return blocks.select(F.lit("blocks").alias("origin"), F.col("block_id").alias("item_id"), "source", F.col("type").alias("kind"), "text").unionByName(
        batches.select(F.lit("content_batches").alias("origin"), F.col("batch_id").alias("item_id"), "source", F.lit("text").alias("kind"), F.col("summary").alias("text"))
    )


# ---------------------------------------------------------------- censored lengths


def _tail(z: np.ndarray) -> np.ndarray:
    return np.array([0.5 * math.erfc(x / math.sqrt(2.0)) for x in np.atleast_1d(z)])


def fit_lengths(lengths: np.ndarray, counts: np.ndarray, limit: float | None = None) -> tuple[float, float]:
    """Mean and deviation of the log lengths by maximum likelihood; rows at ``limit`` are right-censored (EM)."""
    x, w = np.log(np.maximum(lengths, 1.0)), counts.astype(float)
    held = lengths >= limit if limit else np.zeros(len(x), bool)
    mu = float(np.average(x, weights=w))
    sigma = max(0.05, math.sqrt(float(np.average((x - mu) ** 2, weights=w))))
    if not held.any():
        return mu, sigma
    free, n = ~held, w.sum()
    for _ in range(60):
        z = (math.log(limit) - mu) / sigma
        hazard = math.exp(-z * z / 2) / math.sqrt(2 * math.pi) / max(float(_tail(z)[0]), 1e-12)
        first, second = mu + sigma * hazard, mu * mu + sigma * sigma + sigma * hazard * (math.log(limit) + mu)
        m = (float((w * x)[free].sum()) + w[held].sum() * first) / n
        s = math.sqrt(max(2.5e-3, (float((w * x * x)[free].sum()) + w[held].sum() * second) / n - m * m))
        if abs(m - mu) + abs(s - sigma) < 1e-7:
            break
        mu, sigma = m, s
    return mu, sigma


def limits_of(histogram: pd.DataFrame) -> pd.DataFrame:
    """For one source: each candidate limit with its unit, the fit and the censoring posterior.

    ``histogram``: unit, length, n and, where texts repeat, the ``different`` ones among
    them; its rows are the distinct lengths of the source. Below longer texts of the
    source a length needs many different texts, as one that is often repeated is no limit.
    """
    out = []
    for unit, group in histogram.groupby("unit"):
        group = group.sort_values("length")
        length, n = group["length"].to_numpy(float), group["n"].to_numpy(float)
        different = group["different"].to_numpy(float) if "different" in group else n
        total, above = n.sum(), n[::-1].cumsum()[::-1] - n
        last = above <= 0.1 * n
        for i in np.flatnonzero(np.where(last, n >= LIMIT_ROWS, different >= INNER_ROWS) & (length >= 40)):
            m, s = fit_lengths(np.minimum(length, length[i]), n, length[i])
            z = (math.log(length[i]) - m) / s
            mass = math.exp(-z * z / 2) / math.sqrt(2 * math.pi) / (s * length[i])  # of texts that happen to be this long
            expected = max(total * mass, 0.25)
            if (n[i] / expected >= LIMIT_RATIO) if last[i] else (different[i] / expected >= INNER_RATIO):
                out.append((unit, int(length[i]), m, s, int(n[i]), float(1.0 - expected / n[i])))
    return pd.DataFrame(out, columns=["unit", "limit", "mu", "sigma", "n", "posterior"])


def limits(texts: DataFrame) -> DataFrame:
    """Candidate limits of every source, from the histogram of its lengths in characters and bytes."""
    t = texts.where("text is not null and trim(text) <> ''").select("origin", "source", F.char_length("text").alias("chars"), F.octet_length("text").alias("bytes"), F.xxhash64("text").alias("text"))
    t = t.groupBy("origin", "source", "chars", "bytes", "text").agg(F.count(F.lit(1)).alias("copies"))
    t = t.select("origin", "source", "copies", F.explode(F.array(F.struct(F.lit("chars").alias("unit"), F.col("chars").alias("length")), F.struct(F.lit("bytes").alias("unit"), F.col("bytes").alias("length")))).alias("x"))
    # a histogram has at most as many rows as there are lengths, however many texts a source has
    histogram = t.groupBy("origin", "source", "x.unit", "x.length").agg(F.sum("copies").alias("n"), F.count(F.lit(1)).alias("different"))

    def run(key, frame):
        got = limits_of(frame)
        got.insert(0, "source", key[1])
        got.insert(0, "origin", key[0])
        return got

    return histogram.groupBy("origin", "source").applyInPandas(run, "origin string, source string, unit string, limit int, mu double, sigma double, n bigint, posterior double")


# ---------------------------------------------------------------- ending evidence


_TRAILING = "".join(map(chr, [*range(0x21), *range(0x7F, 0xA1), 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
_LETTER = re.compile(r"[^\W\d_]")
_STOP = re.compile(r"[.!?…。！？]")
_OPENING = re.compile(r"(?:.*[.!?…]\s+)?[\W\d_]*((?:[^\W\d_]|['’])+(?:[ \n]+(?:[^\W\d_]|['’])+)?)")
_ITEM = re.compile(r"[-*•]|\w[.)]|\d\d[.)]")


class Signs:
    """What a text's end shows; None instead of signs for a text without letters."""

    __slots__ = ("broken", "closed", "last", "marked", "opening", "tail", "unpunctuated")

    def __init__(self, text: str) -> None:
        t = text.rstrip(_TRAILING)
        self.tail = tail = t[-400:]
        self.closed = bool(_END.search(tail[-16:]))
        self.marked = bool(_MARKUP_END.search(tail[-32:]))
        self.broken = tail[-1:] == "\ufffd" or (tail[-1:] == "-" and tail[-2:-1].isalpha())
        self.last = _last_word(tail)
        m = _OPENING.match(tail)
        self.opening = m.group(1).lower() if m else ""
        self.unpunctuated = not _STOP.search(text) and _LETTER.search(text).group().islower()

    @property
    def inside(self) -> bool:
        """Whether the text stops inside a word or sentence."""
        return self.broken or not (self.closed or self.marked) or (self.closed and bool(re.search(r"\([^()]{0,12}$", self.tail)))


def signs_of(text: str | None) -> Signs | None:
    return Signs(text) if text and _LETTER.search(text) else None


def _inner(c: str) -> bool:
    return c.isalnum() or c in "'’-" or "\u0300" <= c <= "\u036f"


def _last_word(tail: str) -> str:
    """The word that holds the last letter, lower-case."""
    i = len(tail)
    while i and not tail[i - 1].isalpha():
        i -= 1
    a = b = i
    while b < len(tail) and _inner(tail[b]):
        b += 1
    while a and _inner(tail[a - 1]):
        a -= 1
    return tail[a:b].lower()


class Counts:
    """Count tables of fixed size: word anywhere, word before an end, word before an item's end, word start, opening of ended texts, opening of others."""

    NAMES = ("word", "end", "item_end", "prefix", "opens_ended", "opens_other")

    def __init__(self, slots: np.ndarray, counts: np.ndarray) -> None:
        flat = np.zeros(len(self.NAMES) * SLOTS, np.float32)
        flat[slots] = counts
        self.tables = dict(zip(self.NAMES, flat.reshape(len(self.NAMES), SLOTS), strict=True))


def count_tables(texts: DataFrame) -> Counts:
    """Counts over all texts. At most ``SLOTS`` rows a table reach the driver."""
    rows = spread(texts.where("text is not null").select("text", "kind"))

    def run(batches):
        sums = {n: np.zeros(SLOTS, np.int64) for n in Counts.NAMES}
        for batch in batches:
            kind = batch.column(1).to_pylist()
            points, offsets = T.flatten(batch.column(0))
            for a, b in T.chunks(offsets):
                _tally(points[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], np.array([k == "list" for k in kind[a:b]], bool), sums)
            openings = {"opens_ended": [], "opens_other": []}
            for text, k in zip(batch.column(0).to_pylist(), kind, strict=True):
                if k == "text" and (s := signs_of(text)) and s.opening:
                    openings["opens_ended" if s.closed or s.marked else "opens_other"].append(s.opening)
            for name, words in openings.items():
                np.add.at(sums[name], _word_slots(words), 1)
        for i, s in enumerate(sums.values()):
            at = np.flatnonzero(s)
            yield pa.RecordBatch.from_arrays([pa.array(at + i * SLOTS, pa.int32()), pa.array(s[at])], names=["slot", "n"])

    got = rows.mapInArrow(run, "slot int, n bigint").groupBy("slot").agg(F.sum("n").cast("float").alias("n")).toPandas()
    return Counts(got["slot"].to_numpy(), got["n"].to_numpy())


def _words(points: np.ndarray, offsets: np.ndarray):
    kind = T.classes()[points]
    n = len(points)
    inner = (kind == T.LETTER) | (kind == T.NUMBER) | np.isin(points, [0x27, 0x2019, 0x2D])
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(inner & (np.concatenate([[True], ~inner[:-1]]) | edge[:-1]))
    ends = np.flatnonzero(inner & (np.concatenate([~inner[1:], [True]]) | edge[1:])) + 1
    return starts, ends, kind


def _tally(points: np.ndarray, offsets: np.ndarray, lists: np.ndarray, sums: dict) -> None:
    points = T.lowers()[points]
    starts, ends, _ = _words(points, offsets)
    if not len(starts):
        return
    keys = (T.hashes(points, starts, ends) % np.uint64(SLOTS)).astype(np.int64)
    after = np.append(points, [0x20])[ends]
    last = np.isin(ends, offsets)
    stop = np.isin(after, [ord(c) for c in ".!?,;:。"])
    # a list's items end with their lines
    padded = np.append(points, [0x20] * 3)
    item = padded[ends + 1]
    item = np.isin(item, [ord(c) for c in "-*•"]) | ((padded[ends + 2] == ord(")")) | (padded[ends + 2] == ord("."))) & (item > 0x2F)
    item &= (after == 0x0A) & lists[np.searchsorted(offsets, starts, "right") - 1]
    stop |= item
    sums["word"] += np.bincount(keys[~last | stop], minlength=SLOTS)
    sums["end"] += np.bincount(keys[stop], minlength=SLOTS)
    sums["item_end"] += np.bincount(keys[item], minlength=SLOTS)
    for width in range(1, 12):  # beginnings of longer words, of words that aren't themselves last
        some = (ends - starts > width) & ~last
        sums["prefix"] += np.bincount((T.hashes(points, starts[some], starts[some] + width) % np.uint64(SLOTS)).astype(np.int64), minlength=SLOTS)


def _word_slots(words: list[str]) -> np.ndarray:
    points, offsets = T.flatten(pa.array(words, pa.string()))
    return (T.hashes(points, offsets[:-1], offsets[1:]) % np.uint64(SLOTS)).astype(np.int64)


def _level(x: float, low: int = -6, high: int = 6) -> int:
    return int(max(low, min(high, round(x))))


def evidence(signs: list[Signs], kinds: list[str], counts: dict[str, np.ndarray]) -> list[list[str]]:
    """Names of the evidence that each text's end shows."""
    last, opening = _word_slots([s.last for s in signs]), _word_slots([s.opening for s in signs])
    word, end, item_end, prefix = (counts[n][last] for n in ("word", "end", "item_end", "prefix"))
    ended, other = counts["opens_ended"][opening], counts["opens_other"][opening]
    out = []
    for i, (s, kind) in enumerate(zip(signs, kinds, strict=True)):
        tail, sign = s.tail, s.tail[-1:]
        if s.broken:
            out.append(["broken"])
            continue
        if s.closed or s.marked:
            abbreviated = s.closed and re.search(r"\([^()]{0,12}$", tail)
            out.append(["closed in a bracket" if abbreviated else "closed" if s.closed else "marked"])
            continue
        names = ["open"]
        line = tail.rsplit("\n", 1)[-1]
        words = tail.split()
        opens = "other"
        if kind == "list" or _ITEM.match(line):
            names += ["item", f"item ends so {item_end[i] >= 1 and word[i] >= 1}"]
        elif len(tail) < 80 and len(words) > 1 and all(w[0].isupper() or not w[0].isalpha() for w in words):
            names.append("capitals")  # a heading or page furniture
        elif s.unpunctuated:  # written without sentence marks: a missing one says nothing
            names.append("unpunctuated")
        else:  # complete notes open in ways that ended texts don't
            level = _level(math.log((ended[i] + 0.5) / (other[i] + 0.5)))
            names += [f"opening {level}", f"opening seen {ended[i] >= 1}"]
            opens = "as texts" if level >= 1 and ended[i] >= 1 else "as notes" if level <= -2 or ended[i] < 1 else "as both"
        if not s.last:
            names.append("no word")
        if sign.isalnum():  # what the last word says depends on whether texts that open so have a stop at all
            if any(c.isdigit() for c in s.last):
                names.append("ends in a number")
            elif word[i] < 1:
                names.append(TORN if prefix[i] >= 1 else f"unknown word, opens {opens}")
            else:
                names.append(f"word ends texts {_level(math.log((end[i] + 0.5) / (word[i] + 1.0)), -6, 0)}, opens {opens}")
                if prefix[i] > 4 * word[i]:
                    names.append(f"begins words {_level(math.log(prefix[i] / word[i]), 1, 5)}")
        else:
            names.append("comma" if sign in ",;–—-(“[{" or re.search(r"[,;]['\"”’»]+$", tail) else "colon" if sign == ":" else "other sign")
        if sum(tail.count(c) for c in "([{“«") > sum(tail.count(c) for c in ")]}”»"):
            names.append("open bracket")
        out.append(names)
    return out


class Endings:
    """Fitted weights of the evidence: the log-likelihood ratio of a cut, and the prior log odds."""

    def __init__(self, weights: dict[str, float], bias: float, prior: float) -> None:
        self.weights, self.bias, self.prior = weights, bias, prior

    def ratio(self, names: list[str]) -> float:
        return self.bias + sum(self.weights.get(n, 0.0) for n in names)


def _logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, start: np.ndarray, ridge: float = 0.1) -> np.ndarray:
    """Weighted ridge logistic regression by Newton's method; the first column is the bias and is left free."""
    beta = start.copy()
    hold = np.full(x.shape[1], ridge)
    hold[0] = 1e-6
    for _ in range(25):
        p = 1.0 / (1.0 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (w * p * (1 - p))[:, None]).T @ x + np.diag(hold + 1e-9), x.T @ (w * (y - p)) - hold * beta)
        beta += step
        if np.abs(step).max() < 1e-5:
            break
    return beta


def fit_endings(rows: list[tuple[str, str, float | None]], counts: dict[str, np.ndarray], seed: int = 11) -> Endings:
    """Weights from a sample of (text, kind, censoring posterior or None).

    The sample's closed texts, cut at random places, show how cut texts end; the sample
    itself is a mixture of complete and cut ones, which expectation-maximisation parts.
    """
    rng = random.Random(seed)
    seen = [(s, k, p, t) for t, k, p in rows if (s := signs_of(t))]
    # texts that are complete as far as can be told: closed ones, and lists, whose items have no stops
    whole = [(t, k) for s, k, p, t in seen if len(t) >= 60 and p is None and (s.closed or (k == "list" and not s.broken))]
    made = [(s, k) for t, k in whole for _ in range(2) if (s := signs_of(t[: rng.randint(20, len(t) - 1)]))]
    if len(made) < LEAST_ROWS:
        return Endings({}, -20.0, 0.0)
    names = evidence([s for s, _ in made] + [s for s, *_ in seen], [k for _, k in made] + [k for _, k, *_ in seen], counts)
    free = np.array([p is None for _, _, p, _ in seen])
    # about half of the random cuts break a word: how much rarer that is in the sample tells the share of cut texts
    torn = [np.array([TORN in row for row in part]) for part in (names[: len(made)], names[len(made) :])]
    share = torn[1][free].mean() / torn[0].mean() if free.any() and torn[0].any() else 0.0
    prior = float(_log_odds(min(0.5, max(share, 0.5 / (len(seen) + 1)))))
    # cuts by bytes split characters, which texts cut in memory don't show: as many as their share of the cut texts
    split = min(0.5, sum(s.broken for s, *_ in seen) / max(1.0, share * len(seen)))
    names = [["broken"]] * int(len(made) * split / (1 - split)) + names
    index = {n: i for i, n in enumerate(sorted({n for row in names for n in row}), 1)}
    x = np.zeros((len(names), len(index) + 1))
    x[:, 0] = 1.0
    for i, row in enumerate(names):
        x[i, [index[n] for n in row]] = 1.0
    n = len(seen)
    cut_rows = len(names) - n
    y = np.concatenate([np.ones(cut_rows), np.zeros(n)])
    at_limit = np.array([-1.0 if p is None else p for _, _, p, _ in seen])
    sure = np.array([s.broken or TORN in row for (s, *_), row in zip(seen, names[cut_rows:], strict=True)])
    chance = np.where(at_limit >= 0, at_limit, np.where(sure, 1.0, 0.0))
    beta = np.zeros(x.shape[1])
    for turn in range(12):
        whole_weight = 1.0 - chance
        w = np.concatenate([np.full(cut_rows, whole_weight.sum() / cut_rows), whole_weight])  # both kinds weigh the same: the fit is the ratio
        beta = _logistic(x, y, w, beta)
        odds = x[cut_rows:] @ beta + np.where(at_limit >= 0, _log_odds(at_limit), prior)
        # the first comparison is with all rows, cut ones among them: there the share times the ratio is the chance itself
        again = (odds > (math.log(SET_ASIDE) if turn == 0 else 0.0)).astype(float)  # each row is taken for the likelier of both: halves would blur the few cut texts
        if (again == chance).all():
            break
        chance = again
    return Endings({k: float(beta[i]) for k, i in index.items()}, float(beta[0]), prior)


def _log_odds(p) -> np.ndarray:
    p = np.clip(np.asarray(p, float), 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


# ---------------------------------------------------------------- the operator


def _with_limits(texts: DataFrame) -> DataFrame:
    """Each text with the censoring posterior and the limit at its length, null where there is none."""
    # one row a source, holding its few limits
    found = limits(texts).groupBy("origin", F.coalesce("source", F.lit("\0")).alias("s")).agg(F.collect_list(F.struct("posterior", "limit", "unit")).alias("found"))
    rows = texts.where("text is not null").withColumn("s", F.coalesce("source", F.lit("\0"))).join(cut(found), ["origin", "s"], "left")

    def at_limit(x):  # what a limit in bytes leaves may be a few bytes short of it, where a character didn't fit
        size, slack = F.when(x["unit"] == "bytes", F.octet_length("text")).otherwise(F.char_length("text")), F.when(x["unit"] == "bytes", 3).otherwise(1)
        return (size <= x["limit"]) & (size >= x["limit"] - slack)

    best = F.array_max(F.filter("found", at_limit))
    return rows.select("origin", "item_id", "source", "kind", "text", best["posterior"].alias("posterior"), best["limit"].alias("limit"))


def endings_of(rows: DataFrame, counts: Counts) -> Endings:
    """The fitted endings of the texts with their limits, from about ``SAMPLE_ROWS`` of them picked by a hash of their id."""
    total = max(1, rows.count())
    picked = rows.where(F.pmod(F.xxhash64("origin", "item_id", F.lit(4)), F.lit(1 << 20)) < F.lit(SAMPLE_ROWS / total * (1 << 20)))
    got = picked.select("text", "kind", "posterior").orderBy("text", "kind").collect()
    return fit_endings([tuple(r) for r in got], counts.tables)


def judged(spark: SparkSession, folder: str) -> DataFrame:
    """Every text with its limit, censoring posterior, ending ratio, ``cut`` and ``inside``."""
    texts = texts_of(spark, folder)
    rows = _with_limits(texts)
    counts = count_tables(texts)
    shared = spark.sparkContext.broadcast((counts, endings_of(rows, counts)))
    bound_batches(spark)

    def run(batches):
        tables, endings = shared.value[0].tables, shared.value[1]
        for batch in batches:
            found = [signs_of(t) for t in batch.column(4).to_pylist()]
            at = [i for i, s in enumerate(found) if s]
            signs, kinds = [found[i] for i in at], batch.column(3).to_pylist()
            posterior = batch.column(5).to_pylist()
            ratios = [endings.ratio(names) for names in evidence(signs, [kinds[i] for i in at], tables)]
            odds = [lr + (endings.prior if posterior[i] is None else float(_log_odds(posterior[i]))) for i, lr in zip(at, ratios, strict=True)]
            kept = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i).take(kept) for i in (0, 1, 2, 6, 5)), pa.array(ratios, pa.float64()), pa.array(odds, pa.float64()), pa.array([o > 0 for o in odds], pa.bool_()), pa.array([s.inside for s in signs], pa.bool_())],
                names=["origin", "item_id", "source", "limit", "posterior", "ending_ratio", "log_odds", "cut", "inside"],
            )

    return rows.mapInArrow(run, "origin string, item_id bigint, source string, limit int, posterior double, ending_ratio double, log_odds double, cut boolean, inside boolean")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Texts that were cut off inside a word or sentence."""
    return judged(spark, folder).where("cut and inside").select("origin", "item_id").distinct()


def p4_judged(spark: SparkSession, folder: str) -> DataFrame:
    """All texts with their evidence."""
    return judged(spark, folder)


def p4_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Share of cut texts by source."""
    j = judged(spark, folder).groupBy("origin", "source", "item_id").agg(F.max("cut").alias("cut"), F.max(F.col("cut") & F.col("inside")).alias("inside"))
    j = j.groupBy("origin", "source").agg(F.count(F.lit(1)).alias("texts"), F.count_if("cut").alias("cut_texts"), F.count_if("inside").alias("cut_inside"))
    return j.withColumn("share", F.round(F.col("cut_inside") / F.col("texts"), 6)).withColumn("share_with_ends", F.round(F.col("cut_texts") / F.col("texts"), 6))


def p4_deciding(spark: SparkSession, folder: str) -> DataFrame:
    """How many verdicts each kind of evidence decides: what the posterior turns against the ending with the prior alone, and the reverse."""
    j = judged(spark, folder).select("cut", "posterior", (F.col("ending_ratio") > 0).alias("by_ending"), F.coalesce(F.col("posterior") > 0.5, F.lit(False)).alias("by_length"))
    return j.groupBy("by_length", "by_ending", "cut").agg(F.count(F.lit(1)).alias("n"))


def p4_limits(spark: SparkSession, folder: str) -> DataFrame:
    """Field limits found, with the fitted lengths of their sources."""
    return limits(texts_of(spark, folder))


QUERIES = {"p4_found": p4_found, "p4_judged": p4_judged, "p4_shares": p4_shares, "p4_limits": p4_limits, "p4_deciding": p4_deciding}
