"""Problem 10: the languages of every text and of its stretches, with confidence.

A character n-gram model of each language is fitted on a bounded sample of
labelled documents (and fitted again without the sentences it gives to another
language, as some labels are wrong). Each sentence of a text gets a likelihood
under every language; the language set of the text is grown by penalised
likelihood, and expectation-maximisation estimates the proportions of its
languages and each sentence's membership.

Words are scored once: a word's likelihoods are looked up by hash, new words are
scored together from sorted n-gram tables. A word touching a digit is a code and
says nothing; a word's say is bounded, so names can't outvote a sentence; a
language joins the set only for a sentence most of whose words prefer it, so
quoted terms don't.

Defined cases: null, empty, blank and letterless texts have no language; a text
without a full sentence is labelled (``languages``) but is no case; labels are
compared by their part before ``-`` or ``_``, trimmed and lower-cased; ties go to
the language first in code order; a language without a labelled document in the
sample can't be found.
"""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.lineage import spread
from ..session import table
from . import textkit as T

#: Documents of each language the model is fitted on, about; the bound of what reaches the driver.
PER_LANGUAGE = 150
ORDERS, MIX, FLOOR = (1, 2, 3, 4), (0.02, 0.13, 0.35, 0.5), 1e-5
#: Nats a word may speak against a language; the likelihood a further language must gain; words of a sentence that counts.
WORD_CLIP, PENALTY, MIN_WORDS, MAJORITY = 7.0, 9.0, 3, 0.6
_TERMINAL = [ord(c) for c in ".!?…"]
_TERMINAL_WIDE = [ord(c) for c in "。！？"]
_CLOSING = [ord(c) for c in "\"'”’»)]」』）"]


def base_label(label: Column) -> Column:
    """A label's part before ``-`` or ``_``, trimmed and lower-cased."""
    return F.lower(F.trim(F.regexp_extract(F.coalesce(label, F.lit("")), r"^([^-_]*)", 1)))


def _wide(points: np.ndarray) -> np.ndarray:
    """Characters of scripts without word spaces: each is a word."""
    return ((points >= 0x3040) & (points <= 0x30FF)) | ((points >= 0x3400) & (points <= 0x9FFF)) | ((points >= 0xF900) & (points <= 0xFAFF))


def words_and_units(points: np.ndarray, offsets: np.ndarray):
    """Word starts, ends and whether they count; unit (sentence) starts, ends, whether one ends in a full stop."""
    n = len(points)
    kind = T.classes()[points]
    letter, wide = kind == T.LETTER, _wide(points)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    begins = letter & (np.concatenate([[True], ~letter[:-1]]) | wide | np.concatenate([[False], wide[:-1]]) | edge[:-1])
    starts = np.flatnonzero(begins)
    stops = letter & (np.concatenate([~letter[1:], [True]]) | wide | np.concatenate([wide[1:], [False]]) | edge[1:])
    ends = np.flatnonzero(stops) + 1
    number = np.concatenate([kind == T.NUMBER, [False]])
    counts = ~(number[ends] | number[starts - 1] & (starts > 0))

    stop = np.isin(points, _TERMINAL)
    closer = np.isin(points, _CLOSING)
    space = np.concatenate([kind == T.SPACE, [True]]) | edge
    cut = np.zeros(n + 1, bool)
    full = np.zeros(n + 1, bool)
    for width in range(3):  # a full stop, up to two closing marks, then white space
        at = np.flatnonzero(stop) + 1 + width
        at = at[at <= n]
        at = at[space[at]] if len(at) else at
        for back in range(width):
            at = at[closer[at - 1 - back]]
        full[at] = True
    at = np.flatnonzero(np.isin(points, _TERMINAL_WIDE)) + 1
    full[at] = True
    cut |= full
    line = np.flatnonzero(points == 0x0A)
    if len(line) > 1:  # blank lines
        blank = np.concatenate([[0], np.cumsum(kind != T.SPACE)])
        same = blank[line[1:]] == blank[line[:-1] + 1]
        cut[line[1:][same]] = True
    cut |= edge
    bounds = np.flatnonzero(cut)
    return starts, ends, counts, bounds[:-1], bounds[1:], full[bounds[1:]]


class Model:
    """Sorted n-gram tables with the conditional probability of their last character in each language."""

    def __init__(self, languages: list[str], counts: list[Counter]) -> None:
        """``counts``: words of each language, lower-case, with their numbers."""
        self.languages, self.tables = languages, []
        width = len(languages)
        for order in ORDERS:
            grams, contexts = defaultdict(lambda: np.zeros(width)), defaultdict(lambda: np.zeros(width))
            for j, words in enumerate(counts):
                for word, number in words.items():
                    padded = "\x02" * max(1, order - 1) + word + "\x03"
                    for i in range(max(1, order - 1), len(padded)):
                        gram = padded[i - order + 1 : i + 1]
                        grams[gram][j] += number
                        contexts[gram[:-1]][j] += number
            keys = sorted(grams)
            values = np.array([grams[k] / np.maximum(contexts[k[:-1]], 1.0) for k in keys]).reshape(len(keys), width)
            points = np.array([[ord(c) for c in k] for k in keys], np.uint64).reshape(len(keys), order)
            packed = _pack(points)
            at = np.argsort(packed)
            self.tables.append((packed[at], np.concatenate([values[at], np.zeros((1, width))]).astype(np.float32)))

    def score(self, points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Log-likelihoods (words x languages), each word's best being 0 and none below the clip."""
        lengths = ends - starts + 1  # a word and its end mark
        pad = max(ORDERS) - 1
        total = lengths + pad
        flat = np.full(int(total.sum()), 2, np.uint64)
        place = np.cumsum(total) - total
        inside = T.take(place + pad, lengths - 1)
        flat[inside] = T.lowers()[points[T.take(starts, lengths - 1)]]
        flat[place + total - 1] = 3
        at = T.take(place + pad, lengths)
        p = np.full((len(at), len(self.languages)), FLOOR, np.float32)
        for order, share, (keys, values) in zip(ORDERS, MIX, self.tables, strict=True):
            grams = _pack(np.stack([flat[at - order + 1 + i] for i in range(order)], 1))
            found = np.searchsorted(keys, grams)
            found[found == len(keys)] = 0
            p += np.float32(share) * values[np.where(keys[found] == grams, found, len(values) - 1)]
        out = np.add.reduceat(np.log(p), np.cumsum(lengths) - lengths, axis=0)
        return np.maximum(out - out.max(1, keepdims=True), -WORD_CLIP).astype(np.float32)


def _pack(points: np.ndarray) -> np.ndarray:
    """One key for each row of up to four code points: exact for three, mixed for four."""
    out = np.zeros(len(points), np.uint64)
    with np.errstate(over="ignore"):
        for i in range(points.shape[1]):
            out = (out << np.uint64(21)) + points[:, i] if i < 3 else (out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + points[:, i]
    return out


def fit(texts: list[str], labels: list[str], languages: list[str]) -> Model:
    """A model from labelled texts; in a second fit, without sentences that the first gives to another language."""
    number = {c: i for i, c in enumerate(languages)}
    points, offsets = T.flatten(pa.array(texts, pa.string()))
    starts, ends, counts, unit_starts, _, _ = words_and_units(points, offsets)
    starts, ends = starts[counts], ends[counts]
    owner = np.array([number[x] for x in labels], np.int64)[np.searchsorted(offsets, starts, "right") - 1] if len(starts) else np.zeros(0, np.int64)
    unit = np.searchsorted(unit_starts, starts, "right") - 1
    low = T.lowers()[points]
    words = np.array(T.strings(low, starts, ends), object)
    keep = np.ones(len(words), bool)
    model = None
    for _ in range(2):
        tally = [Counter(words[keep & (owner == j)].tolist()) for j in range(len(languages))]
        model = Model(languages, tally)
        if not len(words):
            break
        scores = Reader(model).word_scores(points, starts, ends)
        begins = np.flatnonzero(np.concatenate([[True], unit[1:] != unit[:-1]]))
        best = np.add.reduceat(scores, begins, axis=0).argmax(1)
        keep = np.repeat(best, np.diff(np.append(begins, len(unit)))) == owner
    return model


class Reader:
    """Scores documents under a model; keeps the words it has seen."""

    def __init__(self, model: Model, bound: int = 1 << 19) -> None:
        self.model, self.known = model, T.Lookup(bound)
        self.scores = np.zeros((0, len(model.languages)), np.float32)

    def word_scores(self, points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        keys = T.hashes(T.lowers()[points], starts, ends)
        if len(self.known.keys) > self.known.bound:
            self.known.clear()
            self.scores = self.scores[:0]
        rows = self.known.find(keys)
        new = np.flatnonzero(rows < 0)
        if len(new):
            fresh, at = np.unique(keys[new], return_index=True)
            at = new[at]
            more = self.model.score(points, starts[at], ends[at])
            self.known.add(fresh, np.arange(len(self.scores), len(self.scores) + len(fresh)))
            self.scores = np.concatenate([self.scores, more])
            rows[new] = self.known.find(keys[new])
        return self.scores[rows]

    def read(self, points: np.ndarray, offsets: np.ndarray) -> dict:
        """Units of the documents with their language and confidence, and the proportions of every document."""
        n = len(offsets) - 1
        starts, ends, counts, unit_starts, unit_ends, full = words_and_units(points, offsets)
        starts, ends = starts[counts], ends[counts]
        width = len(self.model.languages)
        owner = np.searchsorted(unit_starts, starts, "right") - 1
        with_words, at, size = np.unique(owner, return_index=True, return_counts=True)
        out = {"proportions": np.zeros((n, width)), "sentence": np.zeros(n, bool), "chosen": np.zeros((n, width), bool)}
        unit_doc = np.searchsorted(offsets, unit_starts[with_words], "right") - 1
        if not len(with_words):
            return out | {"doc": unit_doc, "start": unit_starts[:0], "end": unit_ends[:0], "lang": at, "confidence": np.zeros(0)}
        scores = self.word_scores(points, starts, ends)
        like = np.add.reduceat(scores, at, axis=0).astype(np.float64)
        wide = np.add.reduceat(_wide(points[starts]).astype(np.int64), at)
        solid = (size - wide >= MIN_WORDS) | (wide >= 2 * MIN_WORDS)
        out["sentence"][unit_doc[solid & full[with_words]]] = True
        # a further language needs a whole sentence: one that ends, or as long as one
        whole = solid & (full[with_words] | (size - wide >= 2 * MIN_WORDS) | (wide >= 4 * MIN_WORDS))
        out["chosen"] = self._choose(like, scores, at, size, unit_doc, whole, n)
        post, out["proportions"] = _mixture(like, out["chosen"], unit_doc, size, n)
        lang = post.argmax(1)
        return out | {"doc": unit_doc, "start": unit_starts[with_words], "end": unit_ends[with_words], "lang": lang, "confidence": post[np.arange(len(lang)), lang]}

    def _choose(self, like, scores, at, size, doc, solid, n) -> np.ndarray:
        """Language sets: the best language, then, while the likelihood gained is above the penalty, the one that gains most."""
        width = like.shape[1]
        begins = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
        docs = doc[begins]
        chosen = np.zeros((n, width), bool)
        whole = np.add.reduceat(like, begins, axis=0)
        chosen[docs, whole.argmax(1)] = True
        # most words of the unit must prefer its best language to every language chosen so far
        best = like.argmax(1)
        prefers = scores[np.arange(len(scores)), np.repeat(best, size)]
        for _ in range(width - 1):
            have = np.where(chosen[doc], like, -np.inf).max(1)
            gain = np.maximum(like - have[:, None], 0.0)
            base = np.where(chosen[doc], like, -np.inf).argmax(1)
            for_best = np.add.reduceat((prefers > scores[np.arange(len(scores)), np.repeat(base, size)]).astype(np.float64), at) / size
            gain[~solid | (for_best < MAJORITY) | (gain.max(1) < PENALTY)] = 0.0
            total = np.add.reduceat(gain, begins, axis=0)
            pick = total.argmax(1)
            units = np.diff(np.append(begins, len(doc)))
            more = total[np.arange(len(docs)), pick] > PENALTY + 0.5 * np.log(units)
            if not more.any():
                break
            chosen[docs[more], pick[more]] = True
        return chosen


def _mixture(like, chosen, doc, size, n, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Memberships of the units and proportions of the documents, by words, over their chosen languages."""
    width = like.shape[1]
    share = chosen / np.maximum(chosen.sum(1, keepdims=True), 1)
    masked = np.where(chosen[doc], like, -np.inf)
    masked -= masked.max(1, keepdims=True)
    rel = np.exp(masked)
    begins = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
    weight = np.add.reduceat(size, begins).astype(float)
    post = rel
    for _ in range(rounds):
        post = rel * share[doc] + 1e-300
        post /= post.sum(1, keepdims=True)
        new = np.zeros((n, width))
        new[doc[begins]] = np.add.reduceat(post * size[:, None], begins, axis=0) / weight[:, None]
        if np.abs(new - share).max() < 1e-6:
            share = new
            break
        share = new
    # a membership that no other chosen language contests is as sure as the sentence is against all languages
    full = np.exp(like - like.max(1, keepdims=True))
    full /= full.sum(1, keepdims=True)
    alone = chosen[doc].sum(1) == 1
    post[alone] *= np.maximum(full[alone][chosen[doc][alone]], 1e-6)[:, None]
    return post, share


def train(documents: DataFrame, languages: list[str], per_language: int = PER_LANGUAGE) -> Model:
    """The model of a corpus, from about ``per_language`` documents of each label, picked by a hash of their id."""
    rows = documents.select("doc_id", "text", base_label(F.col("lang")).alias("label")).where(F.col("label").isin(languages) & F.col("text").isNotNull())
    sizes = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}  # one row a language
    if not sizes:
        return Model(languages, [Counter() for _ in languages])
    odds = F.create_map(*[x for k, n in sizes.items() for x in (F.lit(k), F.lit(min(1.0, per_language / n)))])[F.col("label")]
    picked = rows.where(F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 20)) < odds * (1 << 20)).select("text", "label").toPandas()
    return fit(picked["text"].tolist(), picked["label"].tolist(), languages)


def _reading(df: DataFrame, model: Model, keep: list[str], emit, schema: str) -> DataFrame:
    shared = df.sparkSession.sparkContext.broadcast(model)  # its size follows PER_LANGUAGE, not the corpus

    def run(batches):
        reader = Reader(shared.value)
        for batch in batches:
            points, offsets = T.flatten(batch.column(len(keep)))
            for a, b in T.chunks(offsets):
                got = reader.read(points[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                got["offsets"] = offsets[a : b + 1] - offsets[a]
                yield emit([batch.column(i).slice(a, b - a) for i in range(len(keep))], got, reader.model.languages)

    rows = spread(df.select(*[F.col(k) for k in keep], F.col("text").cast("string").alias("__text")))
    return rows.mapInArrow(run, schema)


def languages_of(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id, its label, each language in its text with its proportion, and whether it has a sentence."""

    def emit(columns, got, names):
        doc, lang = np.nonzero(got["chosen"] & (got["proportions"] > 0))
        pick = pa.array(doc)
        return pa.RecordBatch.from_arrays(
            [columns[0].take(pick), columns[1].take(pick), pa.array(np.array(names, object)[lang], pa.string()), pa.array(got["proportions"][doc, lang]), pa.array(got["sentence"][doc])],
            names=["doc_id", "label", "lang", "confidence", "has_sentence"],
        )

    rows = documents.withColumn("label", base_label(F.col("lang")))
    return _reading(rows, model, ["doc_id", "label"], emit, "doc_id bigint, label string, lang string, confidence double, has_sentence boolean")


def segments_of(documents: DataFrame, model: Model) -> DataFrame:
    """Stretches of one language in order: doc_id, segment_no, start_char, end_char, lang, confidence."""

    def emit(columns, got, names):
        doc, lang = got["doc"], got["lang"]
        if not len(doc):
            empty = [columns[0].slice(0, 0), *[pa.array([], t) for t in (pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.float64())]]
            return pa.RecordBatch.from_arrays(empty, names=["doc_id", "segment_no", "start_char", "end_char", "lang", "confidence"])
        new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (lang[1:] != lang[:-1])])
        begins = np.flatnonzero(new)
        last = np.append(begins[1:], len(doc)) - 1
        sums, size = np.add.reduceat(got["confidence"], begins), last - begins + 1
        d = doc[begins]
        first = np.concatenate([[True], d[1:] != d[:-1]])
        no = np.arange(len(d)) - np.maximum.accumulate(np.where(first, np.arange(len(d)), 0))
        shift = got["offsets"][d] if "offsets" in got else 0
        return pa.RecordBatch.from_arrays(
            [columns[0].take(pa.array(d)), pa.array(no, pa.int32()), pa.array(got["start"][begins] - shift), pa.array(got["end"][last] - shift), pa.array(np.array(names, object)[lang[begins]], pa.string()), pa.array(sums / size)],
            names=["doc_id", "segment_no", "start_char", "end_char", "lang", "confidence"],
        )

    return _reading(documents, model, ["doc_id"], emit, "doc_id bigint, segment_no int, start_char bigint, end_char bigint, lang string, confidence double")


def _codes(spark: SparkSession, folder: str) -> list[str]:
    """The language codes, but null ones: a fixed table of a few rows."""
    return sorted(r["code"] for r in table(spark, folder, "languages").where("code is not null").select("code").distinct().collect())


def p10_languages(spark: SparkSession, folder: str) -> DataFrame:
    """Languages of all texts with their proportions."""
    docs = table(spark, folder, "documents")
    return languages_of(docs, train(docs, _codes(spark, folder)))


def p10_segments(spark: SparkSession, folder: str) -> DataFrame:
    """Stretches of all texts."""
    docs = table(spark, folder, "documents")
    return segments_of(docs, train(docs, _codes(spark, folder)))


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    """Languages of texts whose label is missing or wrong or that mix languages."""
    docs, codes = table(spark, folder, "documents"), _codes(spark, folder)

    def emit(columns, got, names):
        chosen = got["chosen"] & (got["proportions"] > 0)
        labels = columns[1].to_pylist()
        right = np.array([x in names and bool(chosen[i, names.index(x)]) for i, x in enumerate(labels)], bool)
        case = got["sentence"] & ((chosen.sum(1) > 1) | ~right)
        doc, lang = np.nonzero(chosen & case[:, None])
        return pa.RecordBatch.from_arrays([columns[0].take(pa.array(doc)), pa.array(np.array(names, object)[lang], pa.string())], names=["doc_id", "lang"])

    rows = docs.withColumn("label", base_label(F.col("lang")))
    return _reading(rows, train(docs, codes), ["doc_id", "label"], emit, "doc_id bigint, lang string")


QUERIES = {"p10_found": p10_found, "p10_languages": p10_languages, "p10_segments": p10_segments}
