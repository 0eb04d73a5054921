"""Problem 6: text of scanned pages repaired into continuous paragraphs.

An averaged perceptron edits characters: for every character it weighs keep
against replacing it by others, deleting it or inserting one beside it, and at a
line's end keep against join. Its classes aren't listed anywhere: the confusions
of the scans at hand are learnt from the corpus, by aligning rare words with
frequent ones that differ in one place, and any single letter may be replaced,
deleted or inserted besides. Its evidence is how often the word before and after
the edit occurs in the whole corpus (a count sketch of fixed size), how well the
letters around fit together, and how common the confusion is. A second
perceptron tells page furniture from text by the line's form, its place in the
text and on the page (as a rank among the corpus's blocks), and the titles of its
document. Confusions, thresholds and both perceptrons come from all words and
blocks of the corpus: distinct words are paired by a join, and words and blocks
are dealt by hash into parts, each of which trains a model; their mean, weighted by
examples, is the editor. What is read rightly is spoilt for training with the
confusions learnt and with random ones.

Words are repaired once per worker: distinct words are told by hash. What is left
of a text's line wraps is then undone, so paragraphs are continuous; lists keep
their lines.

Defined cases: null texts stay null; empty and blank texts stay as they are;
all-capital codes and numbers are no words; a word cut by furniture is joined
over it; repeated rows are repaired alike and found once; a null title, paratext
or bounding box gives no evidence; a corpus without rare words has no learnt
confusions and only single letters are tried.
"""

from __future__ import annotations

import bisect
import itertools
import math
import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.lineage import cut, spread
from ..session import table
from . import textkit as T

#: Slots of each of the two count tables (the broadcast's proven size: 8 MB).
SLOTS = 1 << 20
#: Usual words, other words, and blocks, about, that one part of the corpus trains on; all parts are trained on.
PART_USUAL, PART_RARE, PART_ROWS = 3000, 4000, 4000
#: Examples of lines that a model is fitted on at once.
PART_LINES = 50_000
#: Words beyond so many letters aren't edited.
LONGEST = 40
#: Share of all occurrences that usual words make up.
MASS = 0.97
#: Letters in fewer of the usual words than this share are seldom.
SELDOM = 0.05
#: A confusion is learnt from three words, and from this share of all pairs of a rare and a frequent word: pairs that are near by chance grow with the corpus.
LEAST_WORDS, LEAST_SHARE = 3, 1 / 500
#: A frequent word is so many times as frequent as one that may be its misreading.
RATIO = 8
#: An edit that isn't a learnt confusion is weighed only if it leads to a word so many times as frequent.
FAR_RATIO = 64
_CODE = re.compile(r"[A-Z]{0,3}[0-9]+[A-Z]{0,2}[0-9]*|[A-Z]{1,3}[0-9]+|[0-9]+(?:st|nd|rd|th|s)?|[0-9a-f]{5,}")
_HEX = re.compile(r"[a-f]*[0-9][0-9a-f]*")
_PAGE = re.compile(r"(?:[-–—]\s*)?(?:p(?:age|\s?\.)?|seite|s\.|página|pagina|pág\.|sida|strona|sayfa|стр\.|blz\.)?\s*\d{1,4}(?:\s*(?:/|of|von|de|di|van|av|z|из)\s*\d{1,4})?(?:\s*[-–—])?", re.I)
_BREAK = re.compile(r"(?<![^\W_])([^\W_]{1,40})([-\xad¬])[ \t]*\r?\n\s*([^\W_]{1,40})|(?<![^\W_])([^\W_]{1,40})(\xad|¬)\s*([^\W_]{1,40})")
_MARKED = re.compile(r"[#=\[\]{}<>*_`~]")
_LOW = re.compile(r"(?<![^\W_])[a-zß-ÿа-я]+(?![^\W_])")
#: Signs that a letter may be misread as stand between letters.
_SIGNS = "|$§¦"
_SIGN = re.compile(f"[{re.escape(_SIGNS)}]")
_WORD = re.compile(rf"[^\W_]+(?:[{re.escape(_SIGNS)}](?=[^\W\d_])[^\W_]+)*")


class Perceptron:
    """An averaged perceptron over named features, for one of several classes."""

    def __init__(self) -> None:
        self.weights: dict[str, float] = {}

    def fit(self, rows: list[tuple[list[list[str]], int]], rounds: int = 6, seed: int = 5) -> Perceptron:
        """``rows``: the features of each class that is possible, and which of them is right."""
        w, total, stamp, step = defaultdict(float), defaultdict(float), defaultdict(int), 0
        rng, ids = random.Random(seed), {}
        rows = [(classes, right, ids.setdefault((right, *map(tuple, classes)), len(ids))) for classes, right in rows]
        said: dict[int, int] = {}  # of equal rows, until a weight changes
        for _ in range(rounds):
            rng.shuffle(rows)
            for classes, right, i in rows:
                step += 1
                if (best := said.get(i)) is None:
                    scores = [sum(w[n] for n in names) for names in classes]
                    best = said[i] = max(range(len(scores)), key=lambda i: (scores[i], i != right))
                if best != right:
                    said.clear()
                    for names, by in ((classes[right], 1.0), (classes[best], -1.0)):
                        for n in names:
                            total[n] += (step - stamp[n]) * w[n]
                            stamp[n] = step
                            w[n] += by
        self.weights = {n: (total[n] + (step - stamp[n]) * v) / max(step, 1) for n, v in w.items()}
        return self

    def score(self, names: list[str]) -> float:
        get = self.weights.get
        return sum(get(n, 0.0) for n in names)

    def parts(self, examples: int) -> pa.RecordBatch:
        """The weights times the examples they were fitted on, as whole numbers, so that sums over parts don't hang on their order."""
        names = ["", *self.weights]
        values = [examples, *(round(w * examples * 65536) for w in self.weights.values())]
        return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(values, pa.int64())], names=["name", "value"])

    @classmethod
    def mean(cls, parts: DataFrame) -> Perceptron:
        """The mean of the models of all parts, weighted by examples."""
        got = dict(parts.groupBy("name").agg(F.sum("value")).collect())
        out, examples = cls(), got.pop("", 0)
        out.weights = {n: got[n] / 65536 / examples for n in sorted(got)}
        return out


class Lexicon:
    """How often a word occurs in the corpus: the lesser of two hashed counts."""

    def __init__(self, first: np.ndarray, second: np.ndarray) -> None:
        self.first, self.second = first, second

    def of_hashes(self, keys: np.ndarray) -> np.ndarray:
        return np.minimum(self.first[(keys % np.uint64(SLOTS)).astype(np.int64)], self.second[((keys >> np.uint64(40)) % np.uint64(SLOTS)).astype(np.int64)])

    def counts(self, words: list[str]) -> np.ndarray:
        if not words:
            return np.zeros(0, np.float32)
        points, offsets = T.flatten(pa.array(words, pa.string()))
        return self.of_hashes(T.hashes(T.lowers()[points], offsets[:-1], offsets[1:]))


_SIGN_POINTS = np.array([ord(c) for c in _SIGNS], np.uint32)


def _word_places(points: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    kind = T.classes()[points]
    letter = kind == T.LETTER
    inner = letter | (kind == T.NUMBER)
    if len(points) > 2:  # a sign between letters
        inner[1:-1] |= np.isin(points[1:-1], _SIGN_POINTS) & inner[:-2] & letter[2:]
    edge = np.zeros(len(points) + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(inner & (np.concatenate([[True], ~inner[:-1]]) | edge[:-1]))
    ends = np.flatnonzero(inner & (np.concatenate([~inner[1:], [True]]) | edge[1:])) + 1
    return starts, ends


def lexicon(texts: DataFrame) -> Lexicon:
    """Counts of all words of ``texts.text``: partial counts per partition, at most ``2 * SLOTS`` rows to the driver."""

    def run(batches):
        sums = np.zeros((2, SLOTS), np.int64)
        for batch in batches:
            points, offsets = T.flatten(batch.column(0))
            for a, b in T.chunks(offsets):
                part = T.lowers()[points[offsets[a] : offsets[b]]]
                keys = T.hashes(part, *_word_places(part, offsets[a : b + 1] - offsets[a]))
                for i, k in enumerate((keys, keys >> np.uint64(40))):
                    np.add.at(sums[i], (k % np.uint64(SLOTS)).astype(np.int64), 1)
        for i in (0, 1):
            at = np.flatnonzero(sums[i])
            yield pa.RecordBatch.from_arrays([pa.array(at + i * SLOTS, pa.int32()), pa.array(sums[i][at])], names=["slot", "n"])

    got = spread(texts.select("text")).mapInArrow(run, "slot int, n bigint").groupBy("slot").agg(F.sum("n").cast("float").alias("n")).toPandas()
    flat = np.zeros(2 * SLOTS, np.float32)
    flat[got["slot"].to_numpy()] = got["n"].to_numpy()
    return Lexicon(flat[:SLOTS], flat[SLOTS:])


# ---------------------------------------------------------------- the character editor


def _bucket(n: float) -> int:
    return min(16, int(np.log2(n + 1.0)))


def word_parts(words: list[str]) -> dict[tuple[str, str], int]:
    """How often triples of letters and letters occur in words, in how many words one or two letters do, and the number of words."""
    out: dict[tuple[str, str], int] = defaultdict(int)
    for w in words:
        padded = f"^{w}$"
        for i in range(len(w)):
            out["triple", padded[i : i + 3]] += 1
            out["letter", w[i]] += 1
        for part in {w[i : i + k] for i in range(len(w)) for k in (1, 2)}:
            out["inside", part] += 1
        out["word", ""] += 1
    return out


class Channel:
    """The confusions of a corpus: what is seen, what stood there, and on how many words that was met."""

    def __init__(self, noise: dict[tuple[str, str], float], natural: dict[tuple[str, str], float], vocabulary: list[str], ratios: list[tuple[tuple[str, str], float]] = (), parts: dict[tuple[str, str], int] | None = None) -> None:
        least = max(LEAST_WORDS, LEAST_SHARE * sum(noise.values()))
        self.weight = {k: n for k, n in noise.items() if n >= least and n > natural.get(k, 0.0)}
        #: how much rarer than the word itself its misreadings are
        self.ratios = sorted(x for op, x in ratios if op in self.weight)
        self.by_first: dict[str, list[tuple[str, str]]] = defaultdict(list)
        for seen, true in sorted(self.weight):
            self.by_first[seen[:1]].append((seen, true))
        parts = word_parts(vocabulary) if parts is None else parts
        self.triples = {part: n for (kind, part), n in parts.items() if kind == "triple"}
        letters = {part: n for (kind, part), n in parts.items() if kind == "letter"}
        self.alphabet = "".join(sorted((c for c, n in letters.items() if c.isalpha() and n >= 3), key=lambda c: (-letters[c], c))[:64])
        # what is seldom in words that were read rightly: only it calls for a second edit, and for any in short words
        self.strong = {seen for seen, _ in self.weight if seen and parts.get(("inside", seen), 0) < SELDOM * parts.get(("word", ""), 0)}

    def triple(self, word: str, at: int) -> int:
        """How usual the letters around a place are, as a bucket."""
        padded = f"^{word}$"
        at = max(0, min(at, len(word) - 1))
        return min(_bucket(self.triples.get(padded[at : at + 3], 0)), 6)

    def edits(self, word: str, only: set[str] | None = None) -> list[tuple[str, int, str, str]]:
        """Every word one learnt confusion away: the word, the place, what is seen and what stood there."""
        out, low = [], word.lower()
        for i in range(len(low)):
            for seen, true in (*self.by_first.get(low[i], ()), *self.by_first.get("", ())):
                if low.startswith(seen, i) and (only is None or seen in only):
                    out.append((_edited(word, i, seen, true), i, seen, true))
        return out


def _edited(word: str, at: int, seen: str, true: str) -> str:
    first = word[at : at + 1]
    put = true.upper() if word.isupper() and len(word) > 1 else true.capitalize() if first.isupper() else true
    return word[:at] + put + word[at + len(seen) :]


def _spans(word: str):
    """Each way to take up to two letters out of a word: what is left, and what was taken.

    Not nothing at its end: words that differ by letters at the end are inflected or cut off, not misread.
    """
    n = len(word)
    for i in range(n):
        for k in range(3):
            if i + k <= n and n - k >= 2:
                yield word[:i] + "\0" + word[i + k :], word[i : i + k]


def usual_count(counts: np.ndarray, words: np.ndarray | None = None) -> float:
    """The count from which on words make up ``MASS`` of all occurrences: misreadings are seldom, at any size of corpus.

    ``words``: how many words have each count, one if not given.
    """
    if not len(counts):
        return 8.0
    order = np.argsort(-counts, kind="stable")
    down = counts[order].astype(np.float64)
    mass = np.cumsum(down if words is None else down * words[order])
    return max(8.0, float(down[min(len(down) - 1, int(np.searchsorted(mass, MASS * mass[-1])))]))


def learn_channel(words: list[str], counts: np.ndarray) -> Channel:
    """Confusions from words (lower-case, each once) and their counts in the whole corpus.

    Rare words that become a frequent one by changing up to two letters in one place
    tell the confusions; pairs of frequent words tell which of these are natural.
    """
    order = np.argsort(-counts, kind="stable")
    cut_at = usual_count(counts)
    frequent = {words[i]: float(counts[i]) for i in order if counts[i] >= cut_at and len(words[i]) >= 4 and words[i].isalpha()}
    index: dict[str, list[tuple[str, str]]] = defaultdict(list)
    for w in frequent:
        for rest, taken in _spans(w):
            index[rest].append((w, taken))
    noise: dict[tuple[str, str], float] = defaultdict(float)
    ratios: list[tuple[tuple[str, str], float]] = []
    natural: dict[tuple[str, str], float] = defaultdict(float)
    for i in order:
        r, n = words[i], float(counts[i])
        if len(r) < 4 or r.isdigit() or _CODE.fullmatch(r):
            continue
        found: dict[tuple[str, str], float] = {}
        for rest, seen in _spans(r):
            for w, true in index.get(rest, ()):
                if w != r and frequent[w] >= RATIO * n and seen != true and abs(len(seen) - len(true)) < 2 and (not seen or not true or (seen[0] != true[0] and seen[-1] != true[-1])):
                    found[seen, true] = max(found.get((seen, true), 0.0), frequent[w])
        # a word may be near several: the shortest change to the most frequent one counts
        if found:
            best = max(found, key=lambda k: (-len(k[0]) - len(k[1]), found[k], k))
            (natural if r in frequent else noise)[best] += 1.0
            if r not in frequent:
                ratios.append((best, n / found[best]))
    scale = (len(words) - len(frequent)) / max(1, len(frequent))
    return Channel(noise, {k: 2.0 * n * min(scale, 1.0) for k, n in natural.items()}, list(frequent), ratios)


def _span_rows(rare: bool):
    """Each row once for every span of its word; ``rare``: not of numbers and codes."""

    def run(batches):
        for batch in batches:
            words = batch.column(0).to_pylist()
            rows = [(i, *span) for i, w in enumerate(words) if not (rare and (w.isdigit() or _CODE.fullmatch(w))) for span in _spans(w)]
            at = pa.array([i for i, _, _ in rows], pa.int64())
            yield pa.RecordBatch.from_arrays([*(c.take(at) for c in batch.columns), pa.array([r for _, r, _ in rows], pa.string()), pa.array([t for _, _, t in rows], pa.string())], names=[*batch.schema.names, "rest", "taken"])

    return run


def _part_rows(batches):
    total: dict[tuple[str, str], int] = defaultdict(int)
    for batch in batches:
        for key, n in word_parts(batch.column(0).to_pylist()).items():
            total[key] += n
    yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in total], pa.string()), pa.array([p for _, p in total], pa.string()), pa.array(list(total.values()), pa.int64())], names=["kind", "part", "n"])


def corpus_channel(words: DataFrame) -> Channel:
    """``learn_channel`` over a table of words of any size (``vocabulary``): the pairs are found by a join, only confusions come to the driver."""
    small = words.where("small")
    counts = small.groupBy("n", "plain").count().toPandas()
    cut_at = usual_count(counts["n"].to_numpy(), counts["count"].to_numpy())
    usual = int(counts["count"][(counts["n"] >= cut_at) & counts["plain"]].sum())
    scale = min(1.0, (int(counts["count"].sum()) - usual) / max(1, usual))
    is_usual = (F.col("n") >= cut_at) & F.col("plain")
    frequent = small.where(is_usual)
    left = small.select("word", "n", is_usual.alias("usual")).mapInArrow(_span_rows(True), "word string, n float, usual boolean, rest string, seen string")
    right = frequent.select(F.col("word").alias("whole"), F.col("n").alias("m")).mapInArrow(_span_rows(False), "whole string, m float, rest string, true string")
    seen, true = F.col("seen"), F.col("true")
    apart = (seen == "") | (true == "") | ((F.left(seen, F.lit(1)) != F.left(true, F.lit(1))) & (F.right(seen, F.lit(1)) != F.right(true, F.lit(1))))
    length = F.char_length(seen) + F.char_length(true)
    pairs = left.join(right, "rest").where((F.col("word") != F.col("whole")) & (F.col("m") >= RATIO * F.col("n")) & (seen != true) & (F.abs(F.char_length(seen) - F.char_length(true)) < 2) & apart)
    # a word may be near several: the shortest change to the most frequent one counts
    best = pairs.groupBy("word", "n", "usual").agg(F.max(F.struct((-length).alias("short"), "m", "seen", "true")).alias("b"))
    best = cut(best.select("usual", "b.seen", "b.true", F.round(64 * F.log2(F.col("n") / F.col("b.m"))).cast("int").alias("step")))
    ops = best.groupBy("seen", "true").agg(F.count_if(~F.col("usual")).alias("noise"), (2.0 * scale * F.count_if("usual")).alias("natural"))
    least = max(LEAST_WORDS, LEAST_SHARE * best.where(~F.col("usual")).count())
    ops = ops.where((F.col("noise") >= least) & (F.col("noise") > F.col("natural")))
    got = ops.collect()
    # how much rarer misreadings are, in sixty-fourths of an octave
    steps = best.where(~F.col("usual")).join(ops, ["seen", "true"], "left_semi").groupBy("step").count().orderBy("step").collect()
    parts = frequent.select("word").mapInArrow(_part_rows, "kind string, part string, n bigint").groupBy("kind", "part").agg(F.sum("n").alias("n")).collect()
    out = Channel({(r["seen"], r["true"]): float(r["noise"]) for r in got}, {}, [], parts={(r["kind"], r["part"]): r["n"] for r in parts})
    if steps:
        upto = np.cumsum([r["count"] for r in steps])
        at = np.searchsorted(upto, (np.arange(1000) + 0.5) / 1000 * upto[-1])
        out.ratios = [2.0 ** (steps[i]["step"] / 64) for i in at]
    return out


def near_words(lex: Lexicon, words: list[str], before: np.ndarray, alphabet: str) -> dict[int, list[tuple[str, int, str, str]]]:
    """By place in ``words``: single letters replaced, deleted or inserted, and two made one, that give a far more frequent word.

    The hash of a word is a sum over its letters, so those of all edited words follow from it without making them.
    """
    out: dict[int, list[tuple[str, int, str, str]]] = defaultdict(list)
    if not alphabet:
        return out
    letters = np.array([ord(c) for c in alphabet], np.uint32)
    put = T.mixed(letters)
    by_length: dict[int, list[int]] = defaultdict(list)
    for i, w in enumerate(words):
        if 3 <= len(w) <= 24:
            by_length[len(w)].append(i)
    for n, rows in by_length.items():
        up, down = T.powers(n + 2)
        for a in range(0, len(rows), 1000):
            part = rows[a : a + 1000]
            points = np.frombuffer("".join(words[i] for i in part).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(part), n)
            floor = (FAR_RATIO * (RATIO if n < 4 else 1) * before[part] + RATIO)[:, None]  # three letters are near many words
            with np.errstate(over="ignore"):
                terms = T.mixed(T.lowers()[points]) * up[:n]
                prefix = np.concatenate([np.zeros((len(part), 1), np.uint64), np.cumsum(terms, 1, dtype=np.uint64)], 1)
                total = prefix[:, n:]
                replaced = (total - terms)[:, :, None] + put * up[:n, None]
                removed = (prefix[:, :n] + (total - prefix[:, 1:]) * down[1])[:, : n - 1]
                merged = (prefix[:, : n - 1] + (total - prefix[:, 2:]) * down[1])[:, :, None] + put * up[: n - 1, None]
                inserted = (prefix + (total - prefix) * up[1])[:, :n, None] + put * up[:n, None]
                hits = [
                    ("r", *np.nonzero(lex.of_hashes(T.finish(replaced, n)) > floor[:, :, None])),
                    ("d", *np.nonzero(lex.of_hashes(T.finish(removed, n - 1)) > floor)),
                    ("m", *np.nonzero(lex.of_hashes(T.finish(merged, n - 1)) > floor[:, :, None])),
                    ("i", *np.nonzero(lex.of_hashes(T.finish(inserted, n + 1)) > floor[:, :, None])),
                ]
            for kind, row, at, *which in hits:
                for k in range(len(row)):
                    i, j = part[row[k]], int(at[k])
                    seen = words[i][j : j + {"i": 0, "m": 2}.get(kind, 1)].lower()
                    true = alphabet[which[0][k]] if which else ""
                    if kind != "m" or true not in seen:  # else a letter removed
                        out[i].append((_edited(words[i], j, seen, true), j, seen, true))
    return out


def edit_features(channel: Channel, word: str, new: str, at: int, seen: str, true: str, before: float, after: float) -> list[str]:
    b, a = _bucket(before), _bucket(after)
    kind = "replace" if len(seen) == len(true) else "delete" if len(seen) > len(true) else "insert"
    place = "first" if at == 0 else "last" if at + len(seen) >= len(word) else "inner"
    gap, weight = max(0, a - b), min(_bucket(channel.weight.get((seen, true), 0.0)), 5)
    tail = channel.triple(word.lower(), len(word) - 1) if at + len(seen) < len(word) else "here"
    strong, odd, fit = seen in channel.strong, channel.triple(word.lower(), at), channel.triple(new.lower(), at)
    return [
        "edit", f"op {kind}", f"to {seen}>{true}" if weight else f"far {kind}", f"gap {gap} {strong}", f"gap {min(gap, 9)} {weight}", f"weight {weight}",
        f"len {min(len(word), 9)} {weight > 0}", f"place {place} {kind}", f"digit {any(c.isdigit() for c in word)} {weight > 0}", f"case {word[:1].isupper()} {word[1:].isupper()} {weight > 0}",
        f"tail {tail} {weight > 0}", f"odd {odd} {weight > 0}", f"odd {odd} fit {fit}", f"weight {weight} gap {gap > 4}",
        # steps, so that what was learnt of one ratio holds for those beyond it; counts themselves grow with the corpus
        *[f"gap over {k}" for k in range(gap)], *[f"after over {k}" for k in range(min(a, 6))], f"short {len(word) < 4} {weight > 0}",
    ]


def keep_features(channel: Channel, word: str, at: int, before: float) -> list[str]:
    odd = channel.triple(word.lower(), at)
    return ["keep", f"keep new {before < 1}", f"keep odd {odd}", f"keep digit {any(c.isdigit() for c in word)} {word.isdigit()}", f"keep case {word[:1].isupper()} {len(word) < 4}"]


class Editor:
    """The trained models and the words a worker has met."""

    def __init__(self, lex: Lexicon, channel: Channel, letters: Perceptron, lines: Perceptron, heights: list[float], far_margin: float = 0.0) -> None:
        self.lex, self.channel, self.letters, self.lines, self.heights = lex, channel, letters, lines, heights
        #: by how much an edit that isn't a learnt confusion must outweigh keeping
        self.far_margin = far_margin
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, str] = {}
        self.far: set[str] = set()
        self.titles: dict[str, str] = {}
        self.seen, self.changed = T.Lookup(), np.zeros(0, bool)

    def __getstate__(self):
        return self.__dict__ | {"known": {}, "far": set(), "seen": T.Lookup(), "changed": np.zeros(0, bool)}

    def meet(self, texts: list[str]) -> np.ndarray:
        """Learn the words of many texts at once; which texts hold a word to repair."""
        if len(self.known) > 500_000:
            self.forget()
        points, offsets = T.flatten(pa.array(texts, pa.string()))
        out = np.zeros(len(texts), bool)
        for a, b in T.chunks(offsets):
            part, places = points[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
            starts, ends = _word_places(part, places)
            keys = T.hashes(part, starts, ends)
            rows = self.seen.find(keys)
            new = np.flatnonzero(rows < 0)
            if len(new):
                fresh, at = np.unique(keys[new], return_index=True)
                words = T.strings(part, starts[new[at]], ends[new[at]])
                self.learn(words)
                self.seen.add(fresh, np.arange(len(self.changed), len(self.changed) + len(fresh)))
                self.changed = np.concatenate([self.changed, [self.known[w] != w for w in words]])
                rows[new] = self.seen.find(keys[new])
            hit = starts[self.changed[rows]]
            out[a + np.searchsorted(places, hit, "right") - 1] = True
        return out

    def learn(self, words: list[str]) -> None:
        """Decide on words not met before: learnt confusions first, then single letters, then two confusions in one word."""
        todo = []
        for w in dict.fromkeys(words):
            if w not in self.known:
                self.known[w] = w
                if 2 < len(w) <= LONGEST and not w.isdigit() and not _CODE.fullmatch(w) and not (w.isupper() and any(c.isdigit() for c in w) and len(w) < 6) and all(c.lower() != c.upper() for c in w if c.isalpha()):
                    todo.append(w)
        before = dict(zip(todo, self.lex.counts(todo).tolist(), strict=True))
        self._decide({w: self.channel.edits(w, self.channel.strong if len(w) < 4 else None) for w in todo}, before)
        rest = [w for w in todo if self.known[w] == w]
        # invented names and codes are near words by chance: capitals and hexadecimal digits are left to the learnt confusions
        plain = [w for w in rest if w[0] == w[0].lower() and not _HEX.fullmatch(w)]
        near = near_words(self.lex, plain, np.array([before[w] for w in plain]), self.channel.alphabet)
        self._decide({plain[i]: options for i, options in near.items()}, before, self.far_margin)
        self.far.update(plain[i] for i in near if self.known[plain[i]] != plain[i])
        deeper = {}
        for w in rest:
            if self.known[w] == w and (first := self.channel.edits(w, self.channel.strong)):
                deeper[w] = [(v, at, seen, true) for u, at, seen, true in first for v, _, _, _ in self.channel.edits(u) if v.lower() != w.lower()]
        self._decide({w: e for w, e in deeper.items() if e}, before)

    def _decide(self, todo: dict, before: dict, least: float = 0.0) -> None:
        after = self.lex.counts([o[0] for options in todo.values() for o in options]).tolist()
        i = 0
        for w, options in todo.items():
            best, top = w, least
            for v, at, seen, true in options:
                n = after[i]
                i += 1
                # a word is never edited into a rarer one; what a repair leaves has no signs or digits, else it is a code
                if n > before[w] and v and not _SIGN.search(v) and not any(c.isdigit() for c in v):
                    margin = self.letters.score(edit_features(self.channel, w, v, at, seen, true, before[w], n)) - self.letters.score(keep_features(self.channel, w, at, before[w]))
                    if margin > top or (margin == top > least and v < best):
                        best, top = v, margin
            self.known[w] = best

    def repair_words(self, text: str) -> tuple[str, int]:
        """The text with its words repaired, and how many were."""
        out, at, n = [], 0, 0
        for m in _WORD.finditer(text):
            w = m.group()
            to = self.known.get(w, w)
            if to != w and not (w in self.far and m.end() == len(text.rstrip())):  # a text's last word may be cut off rather than misread
                if to[0].islower() and w[0] != to[0] and not w[0].isupper() and _opens(text, m.start(), m.end()):
                    to = to[0].upper() + to[1:]
                out += [text[at : m.start()], to]
                at = m.end()
                n += 1
        return ("".join([*out, text[at:]]), n) if n else (text, 0)

    def should_join(self, a: str, mark: str, b: str) -> bool:
        joined = self.known_form(a + b)
        if (len(a) < 4 and a.isupper()) or b[:1].isdigit():  # part of a code
            return False
        counts = self.lex.counts([joined, a, b])
        return self.letters.score(join_features(a, mark, b, counts)) > self.letters.score(["stay"])

    def known_form(self, word: str) -> str:
        self.learn([word])
        return self.known[word]

    def repair(self, text: str, titles: list[str], page: int | None, y: float | None, misread: bool = True, lines_stay: bool = False) -> tuple[str, dict[str, int]]:
        """Repaired text, and how many of each repair were made. ``lines_stay``: a list's lines aren't run together."""
        done = {"words": 0, "joins": 0, "furniture": 0}
        if not text or text.isspace():
            return text, done
        if misread:
            text, done["words"] = self.repair_words(text)
        if "\n" not in text and len(text) > 90 and "\xad" not in text and "¬" not in text:
            return text, done
        lines = text.split("\n")
        keep = self.furniture(lines, self.keys_of(titles), page, y)
        done["furniture"] = len(keep) - sum(keep)
        if done["furniture"]:
            text = "\n".join(x for x, k in zip(lines, keep, strict=True) if k)

        def join(m: re.Match) -> str:
            a, mark, b = m.group(1) or m.group(4), m.group(2) or m.group(5), m.group(3) or m.group(6)
            if not self.should_join(a, mark, b):
                return m.group()
            done["joins"] += 1
            return self.known_form(a + b)

        for _ in range(3):  # a word may be cut twice
            again = _BREAK.sub(join, text)
            if again == text:
                break
            text = again
        if "\n" in text and not lines_stay:
            text = unwrap(text)
        return text, done

    def keys_of(self, titles: list[str]) -> list[str]:
        out = []
        for t in titles:
            if t:
                if t not in self.titles:
                    if len(self.titles) > 200_000:
                        self.titles.clear()
                    self.learn(_WORD.findall(t))
                    self.titles[t] = title_key(self.repair_words(t)[0])
                out.append(self.titles[t])
        return out

    def furniture(self, lines: list[str], keys: list[str], page: int | None, y: float | None) -> list[bool]:
        """Which lines are text; a heading broken over two lines is tried as one."""
        n, i = len(lines), 0
        if n == 1 and len(lines[0]) > 90:
            return [True]
        keep = [True] * n
        while i < n:
            two = lines[i] + " " + lines[i + 1] if i + 1 < n and lines[i].strip() and lines[i + 1].strip() and len(lines[i]) + len(lines[i + 1]) < 60 else None
            if two and title_key(two) not in ("", title_key(lines[i])) and self.is_furniture(two, i, n - 1, keys, page, y):
                keep[i] = keep[i + 1] = False
                i += 2
                continue
            if two and _PAGE.fullmatch(two.strip()) and not _PAGE.fullmatch(lines[i + 1].strip()) and self.is_furniture(two, i, n - 1, keys, page, y):
                keep[i] = keep[i + 1] = False
                i += 2
                continue
            underlined = i + 1 < n and re.fullmatch(r"={3,}|-{3,}", lines[i + 1].strip())
            if lines[i].strip() and not underlined and self.is_furniture(lines[i], i, n, keys, page, y):
                keep[i] = False
            i += 1
        return keep

    def is_furniture(self, line: str, at: int, n: int, keys: list[str], page: int | None, y: float | None) -> bool:
        if len(line) > 90 or _MARKED.search(line) or len(_LOW.findall(line)) > 3:  # furniture has hardly a small word, and no markup
            return False
        return self.lines.score(line_features(line, at, n, keys, page, self.spot(y))) > self.lines.score(["text"])

    def spot(self, y: float | None) -> int | None:
        """The height on the page as a rank among the corpus's blocks: a twentieth."""
        return None if y is None or not self.heights else bisect.bisect_left(self.heights, y)


#: A line that begins an item, a table row, a quotation or a heading stays a line.
_OWN_LINE = re.compile(r"\s*(?:[-*•–—>#|=+:]|\d+[.)\s]|[A-Za-z][.)]\s|\(\w{1,3}\)|[A-Z][\w ]{0,24}:|$)")


def unwrap(text: str) -> str:
    """Wrapped lines run together; blank lines, headings, items, and sentence ends before the column's edge keep their breaks."""
    lines = text.split("\n")
    full = max(len(x.strip()) for x in lines)
    out, last = [lines[0]], lines[0]
    for x in lines[1:]:
        s, before = x.strip(), last.strip()
        ended = re.search(r"[.!?:;…。！？][\"'”’»)\]]*$", before)
        wrapped = before and s and not _OWN_LINE.match(x) and not _MARKED.search(before[-3:]) and (not ended or (len(before) >= 0.8 * full and s[0].isalpha()))
        if wrapped:
            out[-1] = out[-1].rstrip() + " " + s
        else:
            out.append(x)
        last = x
    return "\n".join(out)


def _opens(text: str, start: int, end: int) -> bool:
    """Whether a word begins a sentence, or stands in a line of capitalised words."""
    before = text[max(0, start - 80) : start]
    if not before.strip() or re.search(r"[.!?]\s+[“\"]?$", before):
        return True
    rest = re.split(r"\n", before)[-1] + " " + text[end : end + 80].split("\n", 1)[0]
    others = [w for w in re.findall(r"[^\W\d_]+", rest) if len(w) > 2]
    return bool(others) and all(w[0].isupper() for w in others)


def title_key(text: str) -> str:
    """A running head without its page numbers: letters only, lower-case, years and volumes kept out of it."""
    return " ".join(re.findall(r"[^\W\d_]+", text.lower()))


def line_features(line: str, at: int, n: int, keys: list[str], page: int | None, spot: int | None) -> list[str]:
    s = line.strip()
    words = re.findall(r"[^\W\d_]+", s)
    key = title_key(s)
    digits = re.findall(r"\d+", s)
    place = "only" if n == 1 else "first" if at == 0 else "last" if at >= n - 1 else "inner"
    match = "title" if key and key in keys else "part" if len(words) > 1 and any(k.startswith(key + " ") for k in keys) else "none"
    form = "page" if _PAGE.fullmatch(s) else "sentence" if re.search(r"[.!?:;,]\W*$", s) else "plain"
    low = sum(w[:1].islower() for w in words)
    return ["furniture", f"match {match}", f"form {form}", f"match {match} {form}", f"place {place}", f"form {form} {place}", f"digits {min(len(digits), 3)}", f"low {min(low, 3)}", f"words {min(len(words), 8)}", f"match {match} low {min(low, 2)}", f"spot {spot} {place}", f"first page {page == 0} {match}", f"capitals {bool(words) and s.isupper()} {match}", f"bar {'|' in s} {match}"]


def join_features(a: str, mark: str, b: str, counts: np.ndarray) -> list[str]:
    j, ca, cb = (_bucket(x) for x in counts[:3])
    return ["join", f"mark {mark == '-'}", f"joined {min(j, 9)}", f"joined {j > 1} {mark == '-'}", f"gap {max(-6, min(6, j - min(ca, cb)))}", f"b {b[:1].isupper()} {b[:1].isdigit()}", f"a {a[-1:].isdigit()} {a.isupper()}", f"parts {min(ca, cb) > 5} {j > 1}", f"len {min(len(a), 3)} {min(len(b), 3)}"]


# ---------------------------------------------------------------- training


def word_examples(common: list[str], rare: list[str], lex: Lexicon, channel: Channel, top: float, rng: random.Random) -> list[tuple[list[list[str]], int]]:
    """What to do with words read rightly, and with the usual ones spoilt as scans spoil them."""
    ops = sorted(channel.weight)
    weights = [channel.weight[o] ** 0.5 for o in ops]
    cases = []
    for w in common:
        made, low = [], w.lower()
        for _ in range(40 if ops else 0):  # a confusion as often as its root in the corpus
            seen, true = rng.choices(ops, weights)[0]
            at = low.find(true) if true else rng.randint(1, len(w) - 1)
            if at >= 0 and len(w) - len(true) + len(seen) > 2:
                made.append((w[:at] + seen + w[at + len(true) :], w))
            if len(made) == 2:
                break
        if channel.alphabet and len(w) > 2:  # any letter for any other, one left out, one too many
            at, c = rng.randrange(len(w)), rng.choice(channel.alphabet[:32] + "0123456789")
            d = rng.choice(channel.alphabet[:32])
            at = min(at, len(w) - 2) if (how := rng.randrange(5)) in (2, 3) else at
            made.append(((w[:at] + c + w[at + 1 :], w[:at] + c + w[at + 1 :], w[:at] + w[at + 1 :], w[:at] + c + w[at:], w[:at] + d + c + w[at + 1 :])[how], w))
        cases += [*((bad, good) for bad, good in made if bad.lower() != good.lower()), (w, w)]
    cases += [(w, w) for w in rare]
    parts = []
    for _ in range(len(common) if len(common) > 1 else 0):  # words cut off, and invented names: rare, near others, and rightly read
        a, b = rng.sample(common, 2)
        parts += [a[: rng.randint(2, max(2, len(a) - 1))], (a[: len(a) // 2] + b[len(b) // 2 :]).capitalize()]
    cases += [(w, w) for w, n in zip(parts, lex.counts(parts), strict=True) if n < top]
    cases += [(code, code) for code in ("".join(rng.choices("0123456789abcdef", k=rng.randint(3, 6))) for _ in range(400)) if not code.isdigit()]
    near = near_words(lex, [bad for bad, _ in cases], lex.counts([bad for bad, _ in cases]), channel.alphabet)
    options = [(i, e) for i, (bad, _) in enumerate(cases) for e in dict.fromkeys([*channel.edits(bad), *near.get(i, ())])]
    # a misreading is met as often as misreadings of other words are
    usual = [rng.choice(channel.ratios) if channel.ratios else 0.0 for _ in cases]
    before, whole = lex.counts([bad for bad, _ in cases]).tolist(), lex.counts([good for _, good in cases]).tolist()
    before = [n if bad == good else max(n, int(w * u)) for (bad, good), n, w, u in zip(cases, before, whole, usual, strict=True)]
    after = lex.counts([e[0] for _, e in options]).tolist()
    places: dict[tuple[int, int], list] = defaultdict(list)
    for (i, e), n in zip(options, after, strict=True):
        if n > before[i]:
            places[i, e[1]].append((e, n))
    examples = []
    for (i, at), made in places.items():
        (bad, good), n0 = cases[i], before[i]
        if bad != good and RATIO * n0 > whole[i]:
            continue  # spoilt into a word of its own
        if bad == good and n0 < top and any(n > RATIO * n0 and (seen, true) in channel.weight for (_, _, seen, true), n in made):
            continue  # a rare word a confusion away from a common one may itself be misread: says nothing
        right = next((k for k, ((v, *_), _) in enumerate(made, 1) if v.lower() == good.lower() and bad != good), 0)
        if right == 0 and bad != good:
            continue  # of a spoilt word only the spoilt place is known
        classes = [keep_features(channel, bad, at, n0)] + [edit_features(channel, bad, v, at, seen, true, n0, n) for (v, _, seen, true), n in made]
        examples.append((classes, right))
    joins = []
    for w in [*common, *rare]:
        if len(w) > 4:
            k = rng.randint(2, len(w) - 2)
            a, b, mark = w[:k], w[k:], rng.choice(["-", "-", "-", "\xad", "¬"])
            joins.append((a, mark, b, 1))
    for _ in range(len(common) + len(rare)):
        if len(common) > 1:
            a, b = rng.sample(common, 2)
            if rng.random() < 0.3:
                a, b = f"{rng.choice('ABQVX')}{rng.randint(1, 99)}", rng.choice([f"{rng.randint(1, 40):02d}", "C4", "H1", "O2"])
            joins.append((a, "-", b, 0))
    counts = lex.counts([w for a, _, b, _ in joins for w in (a + b, a, b)]).reshape(-1, 3)
    examples += [([["stay"], join_features(a, mark, b, n)], right) for (a, mark, b, right), n in zip(joins, counts, strict=True)]
    return examples


def far_choices(examples: list[tuple[list[list[str]], int]]) -> list[list[list[str]]]:
    """What could be done with words that were read rightly and are near a frequent one by single letters that no confusion backs."""
    return [classes for classes, right in examples if right == 0 and classes[0][0] == "keep" and all("weight 0" in c for c in classes[1:])]


def far_margins(letters: Perceptron, choices: list[list[list[str]]]) -> list[float]:
    """By how much the best edit outweighs keeping."""
    return [max(letters.score(c) for c in classes[1:]) - letters.score(classes[0]) for classes in choices]


def heights_of(ys: list[float], blocks: list[int]) -> list[float]:
    """The twentieths of heights on the page, of which each is met on so many blocks."""
    order = np.argsort(ys)
    upto = np.cumsum(np.array(blocks, np.int64)[order])
    return sorted({float(ys[order[np.searchsorted(upto, upto[-1] * k // 20, "right")]]) for k in range(20)}) if len(ys) else []


def line_examples(rows: list[dict], heights: list[float], rng: random.Random):
    """Furniture and lines of text, with what is seen of each."""

    def at_height(y: float | None) -> int | None:
        return None if y is None else bisect.bisect_left(heights, y)

    for r in rows:
        keys = [title_key(t) for t in r["titles"] if t]
        text = r["text"] or ""
        if r["type"] in ("header", "number") and text.strip():
            for at, n in ((0, 1), (1, 3), (0, 3), (2, 3)):  # as a text's only line, within it, at its ends
                yield [["text"], line_features(text, at, n, keys, r["page"], at_height(r["y"]) if n == 1 else None)], 1
                k = rng.randint(1, 250)
                yield [["text"], line_features(rng.choice([f"p. {k}", f"Page {k} of {k + rng.randint(0, 90)}", f"- {k} -", f"{k}", f"Page {k}"]), at, n, keys, r["page"], None)], 1
                if keys and r["type"] == "header":
                    yield [["text"], line_features(rng.choice([t for t in r["titles"] if t]) + rng.choice(["", "", " 12", "  7"]), at, n, keys, r["page"], None)], 1
        elif r["type"] in ("text", "list", "caption", "title"):
            parts = [p for p in text.split("\n") if p.strip()]
            whole = len(parts) == 1
            for i, p in enumerate(parts):
                if r["type"] in ("text", "list"):  # what narrow lines hold of a sentence
                    cutting = p.split()
                    for _ in range(3 if len(cutting) > 6 else 0):
                        k = rng.randrange(len(cutting) - 1)
                        bit = " ".join(cutting[k : k + rng.randint(1, 5)])
                        how = rng.random()
                        if how < 0.4:
                            bit = bit[: max(2, len(bit) - 3)] + rng.choice(["-", "\xad", "¬", ""])
                        elif how < 0.6:
                            bit += f" {rng.choice('ABKQX')}{rng.randint(1, 99)}-{rng.choice(['07', 'C4', '18'])}" + rng.choice(["", ".", ")."])
                        if title_key(bit) not in keys and not _PAGE.fullmatch(bit) and len(keys) > 0:
                            yield [["text"], line_features(bit, rng.choice([0, 1, 2]), 3, keys, r["page"], None)], 0
                clean = r["type"] in ("caption", "title") or sum(w[:1].islower() for w in p.split()) > 1
                if clean and title_key(p) not in keys and len(p) < 90:
                    yield [["text"], line_features(p, i, len(parts), keys, r["page"], at_height(r["y"]) if whole else None)], 0


def train(rows: list[dict], lex: Lexicon, seed: int = 3, more: list[str] = ()) -> Editor:
    """The editor from all blocks (type, text, titles, page, y) of a corpus that one process holds; ``editor_of`` does the same by parts.

    ``more``: further texts, whose words only teach the confusions.
    """
    rng = random.Random(seed)
    texts = [r["text"] for r in rows if r["type"] in ("text", "list") and r["text"]]
    # words in small letters: invented names are as rare as misreadings
    taught = list(dict.fromkeys(w for t in (*texts, *more) for w in _WORD.findall(t) if len(w) > 3 and w[0] == w[0].lower()))
    channel = learn_channel(taught, lex.counts(taught))
    words = list(dict.fromkeys(w for t in texts for w in _WORD.findall(t) if len(w) > 1 and w.isalpha()))
    rng.shuffle(words)
    counts = lex.counts(words)
    top = usual_count(counts)
    common = [w for w, n in zip(words, counts, strict=True) if n >= top]
    rare = [w for w, n in zip(words, counts, strict=True) if n < top]
    examples = word_examples(common, rare, lex, channel, top, rng)
    letters = Perceptron().fit(examples)
    # an edit that no confusion backs: as sure as only one in a hundred of the rightly read words is
    false = far_margins(letters, far_choices(examples))
    far_margin = max(0.0, float(np.quantile(false, 0.99))) if false else 0.0
    ys = [r["y"] for r in rows if r["y"] is not None]
    heights = heights_of(ys, [1] * len(ys))
    furniture = Perceptron().fit(list(line_examples(rows, heights, rng)))
    return Editor(lex, channel, letters, furniture, heights, far_margin)


# ---------------------------------------------------------------- the operator


def _bodies(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Blocks (text and list), node bodies and paratext entries."""
    docs = table(spark, folder, "documents")
    b = table(spark, folder, "blocks").where(F.col("type").isin("text", "list") & F.col("text").isNotNull())
    b = b.select(F.lit("blocks").alias("origin"), F.col("block_id").alias("item_id"), "document_id", F.lit("").alias("lead"), F.col("text").alias("body"), F.col("page_idx").alias("page"), F.try_element_at("bbox", F.lit(2)).alias("y"), (F.col("type") == "list").alias("lines_stay"))
    n = table(spark, folder, "content_nodes").where(F.col("search_text").isNotNull())
    # the leading lines: library, title and, where it is there, heading
    rest = F.split("search_text", "\n", -1)
    lead = F.when(F.col("heading").isNotNull() & (F.get(rest, F.lit(2)) == F.col("heading")), 3).otherwise(2)
    lead_text = F.array_join(F.slice(rest, F.lit(1), lead), "\n")
    n = n.select(F.lit("content_nodes").alias("origin"), F.col("content_id").alias("item_id"), "document_id", lead_text.alias("lead"), F.array_join(F.slice(rest, lead + 1, F.size(rest)), "\n").alias("body"), F.lit(None).cast("int").alias("page"), F.lit(None).cast("double").alias("y"), (F.coalesce("type", F.lit("")) != "text").alias("lines_stay"))
    p = docs.where(F.size("paratext") > 0).select(F.lit("documents").alias("origin"), F.col("doc_id").alias("item_id"), F.lit(None).cast("bigint").alias("document_id"), F.lit("").alias("lead"), F.array_join("paratext", "\n").alias("body"), F.lit(None).cast("int").alias("page"), F.lit(None).cast("double").alias("y"), F.lit(True).alias("lines_stay"))
    return b, n, p


def items_of(spark: SparkSession, folder: str) -> DataFrame:
    """All bodies; those that may hold furniture with their document's titles."""
    docs = table(spark, folder, "documents")
    none = F.lit(None).cast("array<string>")
    titles = docs.select(F.col("doc_id").alias("d"), F.concat(F.array(F.col("title")), F.coalesce("paratext", F.array().cast("array<string>"))).alias("titles")).dropDuplicates(["d"])
    b, n, p = _bodies(spark, folder)
    texts = spread(b.unionByName(n))
    # a single long line holds no furniture, so it needs no titles and isn't shuffled
    furnished = F.col("body").contains("\n") | (F.char_length("body") <= 90)
    with_titles = texts.where(furnished).join(titles, F.col("document_id") == F.col("d"), "left").drop("d")
    return with_titles.unionByName(texts.where(~furnished).withColumn("titles", none)).unionByName(p.withColumn("titles", none)).drop("document_id")


def vocabulary(texts: DataFrame, lex: Lexicon) -> DataFrame:
    """The distinct words of a column of texts that can be edited or edited into, with their counts in the corpus.

    ``small`` ones, in small letters, teach the confusions (invented names are as rare as misreadings); ``plain`` ones are of letters only.
    """
    shared = texts.sparkSession.sparkContext.broadcast(lex)

    def find(batches):
        met: set[str] = set()
        for batch in batches:
            points, offsets = T.flatten(batch.column(0))
            for a, b in T.chunks(offsets):
                part = points[offsets[a] : offsets[b]]
                starts, ends = _word_places(part, offsets[a : b + 1] - offsets[a])
                fits = (ends - starts > 1) & (ends - starts <= LONGEST + 2)
                starts, ends = starts[fits], ends[fits]
                _, at = np.unique(T.hashes(part, starts, ends), return_index=True)
                new = [w for w in T.strings(part, starts[at], ends[at]) if w not in met]
                if len(met) > 500_000:
                    met.clear()
                met.update(new)
                yield pa.RecordBatch.from_arrays([pa.array(new, pa.string())], names=["word"])

    def count(batches):
        for batch in batches:
            words = batch.column(0).to_pylist()
            small = [len(w) > 3 and w[0] == w[0].lower() for w in words]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shared.value.counts(words)), pa.array(small, pa.bool_()), pa.array([w.isalpha() for w in words], pa.bool_())], names=["word", "n", "small", "plain"])

    words = spread(texts).mapInArrow(find, "word string").distinct()
    return cut(words.mapInArrow(count, "word string, n float, small boolean, plain boolean"))


def _dealt(rows: DataFrame, parts: int) -> DataFrame:
    """Rows by ``part`` in so many tasks, as the few bytes of parts that take long would be joined into one."""
    return rows.repartition(min(4 * parts, 1000), "part")


def corpus_letters(words: DataFrame, lex: Lexicon, channel: Channel, seed: int = 3) -> tuple[Perceptron, float]:
    """The character editor's model and margin from all plain words of a vocabulary, dealt into parts."""
    context, plain = words.sparkSession.sparkContext, words.where("plain")
    counts = plain.groupBy("n").count().toPandas()
    top = usual_count(counts["n"].to_numpy(), counts["count"].to_numpy())
    common = int(counts["count"][counts["n"] >= top].sum())
    deal = [max(1, math.ceil(n / part)) for n, part in ((common, PART_USUAL), (int(counts["count"].sum()) - common, PART_RARE))]
    # as many parts as the more numerous kind needs; those of the other kind are used again, spoilt otherwise
    step = F.when(F.col("n") >= top, deal[0]).otherwise(deal[1]).cast("bigint")
    part = F.explode(F.sequence(F.pmod(F.xxhash64("word"), step), F.lit(max(deal) - 1).cast("bigint"), step))
    dealt = _dealt(plain.select(part.alias("part"), "word", "n"), max(deal))
    shared = context.broadcast((lex, channel))

    def fit(group: pa.Table) -> pa.Table:
        lex, channel = shared.value
        rows = sorted(zip(group["word"].to_pylist(), group["n"].to_pylist(), strict=True))
        rng = random.Random(f"{seed} {group['part'][0]}")
        rng.shuffle(rows)
        examples = word_examples([w for w, n in rows if n >= top], [w for w, n in rows if n < top], lex, channel, top, rng)
        weights, choices = Perceptron().fit(examples).parts(len(examples)), far_choices(examples)
        kind = pa.list_(pa.list_(pa.string()))
        return pa.concat_tables([pa.Table.from_batches([weights]).append_column("choice", pa.nulls(len(weights), kind)), pa.table({"name": pa.nulls(len(choices), pa.string()), "value": pa.nulls(len(choices), pa.int64()), "choice": pa.array(choices, kind)})])

    made = cut(dealt.groupBy("part").applyInArrow(fit, "name string, value bigint, choice array<array<string>>"))
    letters = Perceptron.mean(made.where("name is not null").select("name", "value"))

    def margins(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([math.ceil(256 * x) for x in far_margins(letters, batch.column(0).to_pylist())], pa.int32())], names=["step"])

    # as sure as only one in a hundred of the words read rightly is, in steps of 1/256
    false = made.where("choice is not null").select("choice").mapInArrow(margins, "step int").groupBy("step").count().orderBy("step").collect()
    if not false:
        return letters, 0.0
    upto = np.cumsum([r["count"] for r in false])
    return letters, max(0.0, false[int(np.searchsorted(upto, 0.99 * upto[-1]))]["step"] / 256)


def corpus_lines(spark: SparkSession, folder: str, seed: int = 3) -> tuple[Perceptron, list[float]]:
    """The furniture model from all blocks, dealt into parts, and the twentieths of their heights."""
    blocks, docs = table(spark, folder, "blocks").where("text is not null"), table(spark, folder, "documents")
    blocks = blocks.select("block_id", "document_id", "type", "text", F.col("page_idx").alias("page"), F.try_element_at("bbox", F.lit(2)).cast("double").alias("y"))
    # heights to twelve binary digits, so that there are few
    unit = F.pow(F.lit(2.0), F.greatest(F.floor(F.log2(F.abs("y"))), F.lit(-1000)) - 11)
    height = F.when(F.col("y") == 0, 0.0).when(F.abs("y") < float("inf"), F.floor(F.col("y") / unit) * unit)
    met = blocks.groupBy(height.cast("double").alias("y")).count().collect()
    heights = heights_of([r["y"] for r in met if r["y"] is not None], [r["count"] for r in met if r["y"] is not None])
    parts = max(1, math.ceil(sum(r["count"] for r in met) / PART_ROWS))
    titles = docs.select(F.col("doc_id").alias("document_id"), F.concat(F.array(F.col("title")), F.coalesce("paratext", F.array().cast("array<string>"))).alias("titles")).dropDuplicates(["document_id"])
    taught = blocks.where(F.col("type").isin("header", "number", "text", "list", "caption", "title")).join(titles, "document_id", "left")
    dealt = taught.select(F.pmod(F.xxhash64("block_id", "document_id", "text"), F.lit(parts)).alias("part"), "type", "text", "page", "y", "titles")
    dealt = _dealt(dealt, parts)

    def fit(group: pa.Table) -> pa.Table:
        rows = group.drop_columns(["part"]).to_pylist()
        for r in rows:
            r["titles"] = r["titles"] or []
        rows.sort(key=lambda r: (r["type"], r["text"], r["page"] or 0, r["y"] or 0.0, [t or "" for t in r["titles"]]))
        rng = random.Random(f"{seed} {group['part'][0]}")
        rng.shuffle(rows)
        examples, out = line_examples(rows, heights, rng), []
        while made := list(itertools.islice(examples, PART_LINES)):
            out.append(Perceptron().fit(made).parts(len(made)))
        return pa.Table.from_batches(out, pa.schema([("name", pa.string()), ("value", pa.int64())]))

    return Perceptron.mean(dealt.groupBy("part").applyInArrow(fit, "name string, value bigint")), heights


def editor_of(spark: SparkSession, folder: str) -> Editor:
    """The editor trained on a folder's whole corpus."""
    nodes = table(spark, folder, "content_nodes").select(F.col("search_text").alias("text"))
    paratext = table(spark, folder, "documents").select(F.array_join("paratext", "\n").alias("text"))
    lex = lexicon(table(spark, folder, "blocks").select("text").unionByName(nodes).unionByName(paratext).where("text is not null"))
    b, n, p = (x.select("body") for x in _bodies(spark, folder))
    words = vocabulary(b.unionByName(n).unionByName(p), lex)
    channel = corpus_channel(words)
    letters, far_margin = corpus_letters(words, lex, channel)
    lines, heights = corpus_lines(spark, folder)
    return Editor(lex, channel, letters, lines, heights, far_margin)


def repaired(spark: SparkSession, folder: str) -> DataFrame:
    """Every text with its repaired form and the number of word, join and furniture repairs."""
    shared = spark.sparkContext.broadcast(editor_of(spark, folder))

    def run(batches):
        editor = shared.value
        for batch in batches:
            c = batch.to_pydict()
            out, words, joins, furniture = [], [], [], []
            misread = editor.meet(c["body"])
            for origin, lead, body, titles, page, y, stay, bad in zip(c["origin"], c["lead"], c["body"], c["titles"], c["page"], c["y"], c["lines_stay"], misread, strict=True):
                if origin == "documents":
                    new, n = editor.repair_words(body) if bad else (body, 0)
                    done = {"words": n, "joins": 0, "furniture": 0}
                else:
                    new, done = editor.repair(body, titles or [], page, y, bad, stay)
                out.append(f"{lead}\n{new}" if lead else new)
                words.append(done["words"])
                joins.append(done["joins"])
                furniture.append(done["furniture"])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string()), pa.array(words, pa.int32()), pa.array(joins, pa.int32()), pa.array(furniture, pa.int32())], names=["origin", "item_id", "repaired_text", "words", "joins", "furniture"])

    items = items_of(spark, folder).select("origin", "item_id", "lead", "body", "titles", "page", "y", "lines_stay")
    return items.mapInArrow(run, "origin string, item_id bigint, repaired_text string, words int, joins int, furniture int")


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """Items that needed a repair."""
    return repaired(spark, folder).where("words + joins + furniture > 0").select("origin", "item_id").distinct()


def p6_repaired(spark: SparkSession, folder: str) -> DataFrame:
    """All texts, repaired."""
    return repaired(spark, folder)


QUERIES = {"p6_found": p6_found, "p6_repaired": p6_repaired}
