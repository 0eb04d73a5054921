"""Operators of the subpackage against brute force, round trips and held-out accuracy, without Spark."""

import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from leafmill.llm import encoding, language, markup, mixing, neighbours, packing, pieces, scans, truncation

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def plain():
    t = tokenizers.Tokenizer.from_file(encoding.TOKENIZER)
    t.encode_special_tokens = True
    return t


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="ab'stdrevml  \n\t　éß日1２½.,!?-’😀\x00\x1c" + "Zq", max_size=30), max_size=6))
def test_ids_are_the_library_ones(plain, texts):
    enc = encoding.encoder(encoding.TOKENIZER)
    got = [x for _, _, ids in enc.encode(pa.array(texts, pa.string())) for x in ids.to_pylist()]
    assert got == [e.ids for e in plain.encode_batch(texts, add_special_tokens=False)]
    assert enc.counts(pa.array(texts, pa.string())).tolist() == [len(x) for x in got]


def test_words_of_one_hash_are_told_apart(plain, monkeypatch):
    """Even with a hash of four values every word gets its own ids."""
    from leafmill.llm import encoding

    real = encoding.T.hashes
    enc = encoding.Encoder(encoding.TOKENIZER)
    texts = ["the harbour authority approved the annual statement", "a b c d e f g h", "the the harbour", "", "über den Küstenbezirk"]
    want = [ids for _, _, lists in enc.encode(pa.array(texts)) for ids in lists.to_pylist()]
    monkeypatch.setattr(encoding.T, "hashes", lambda *a: real(*a) % np.uint64(4))
    clash = encoding.Encoder(encoding.TOKENIZER)
    for _ in range(2):
        assert [ids for _, _, lists in clash.encode(pa.array(texts)) for ids in lists.to_pylist()] == want


def test_ids_of_odd_texts(plain):
    texts = [None, "", "   ", "<|endoftext|>", "a" * 3000, "aaa " * 2000, "it's 'll 've we're I'm x'd '", "日本語" * 500]
    enc = encoding.Encoder(encoding.TOKENIZER, bound=4)  # the store of known words is emptied again and again
    got = [x for _, _, ids in enc.encode(pa.array(texts)) for x in ids.to_pylist()]
    assert got == [e.ids for e in plain.encode_batch([t or "" for t in texts], add_special_tokens=False)]


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet="ab ,.\ńé", max_size=400), st.integers(20, 60), st.integers(0, 15))
def test_pieces_cover_and_overlap(text, limit, overlap):
    p = pieces.cut_text(text, limit, overlap)
    assert p[0][0] == 0 and p[-1][1] == len(text) and all(b - a <= limit for a, b in p)
    for (_, b), (a2, b2) in zip(p, p[1:], strict=False):
        assert 0 <= b - a2 <= overlap and b2 > b


def test_pieces_take_paragraphs():
    text = ("one two three. " * 40 + "\n\n") * 6
    ends = [text[b - 2 : b] for _, b in pieces.cut_text(text)[:-1]]
    assert ends.count("\n\n") >= len(ends) - 1
    with pytest.raises(ValueError, match="overlap"):
        pieces.cut_text("x", 10, 10)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 1500), st.integers(0, 1500)), min_size=1, max_size=40), st.integers(2, 12))
def test_packing_keeps_limits(rows, segments):
    tokens, loss = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    at, piece, size, part, bins = packing.pack_group(tokens, np.minimum(loss, tokens), 512, segments, 400)
    assert np.bincount(bins, size).max() <= 512 and np.bincount(bins).max() <= segments and np.bincount(bins, part).max() <= 400
    assert np.bincount(at, size, len(tokens)).tolist() == tokens.tolist()
    assert all((at == i).sum() == max(1, -(-t // 512)) for i, t in enumerate(tokens))


def test_packing_is_near_the_bound():
    rng = np.random.default_rng(1)
    tokens = rng.integers(20, 300, 400)
    bins = packing.pack_group(tokens, tokens, 512, 512, 512)[4]
    assert bins.max() + 1 <= 1.02 * -(-tokens.sum() // 512) + 1


def test_graph_recall_against_brute_force():
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 64))
    v = centres[rng.integers(0, 12, 1500)] + 0.6 * rng.normal(size=(1500, 64))
    v = (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)
    v[7] = v[3]
    edges, entries = neighbours.build(v)
    ids, _ = neighbours.search(v, edges, entries, v[:200], neighbours.BEAM)
    truth = np.argsort(-(v[:200] @ v.T), axis=1, kind="stable")[:, :11]
    assert np.mean([len(set(ids[i, :11]) & set(truth[i])) / 11 for i in range(200)]) >= 0.95
    for n in (1, 2, 24, 26):
        e, at = neighbours.build(v[:n])
        assert (neighbours.search(v[:n], e, at, v[:n], 48)[0][:, 0] >= 0).all()


MARKUP = ["&ldquo;x&rdquo;", "<b>x</b>", "a<br/>", "**b**", "__b__ c", "[t](/u)", "[t][ref1]", "x[^2]", "# H", "T\n===", "> q", "```\nx\n```", "~~s~~", "`c`", "| a | b |\n|---|---|", "[[L|t]]", "{{x|y}}", "'''b'''", "''i''", "== H ==", "__NOTOC__", "\\emph{x}", "{\\it x}", "$x_1^2$", "\\(a\\)", "12\\,\\%", "``q''", "\\item x", "not\\footnote{f} y", "&lt;i&gt;x&lt;/i&gt;", '<span style="x']
PLAIN = ["a < 3 and b > 4", "3 < x < 7, A << B", "$19 to $75", "R&D and Q&A", "D:\\scans\\new\\22", "max_row_count in ledger_v8.csv", "~42% of 10^6; 12.4* are", "“the [sic] parcels” in note [28].", "- a\n- b", "1. a\n2. b", "7 * 2 * 3", "Ticket #971 is {name}", "A1 | 2 | 3", "x", "", "MAINTENANCE PART 3 | 94", "#!/bin/sh\n# rebuild"]


@pytest.mark.parametrize("text", MARKUP)
def test_markup_is_seen_and_goes(text):
    assert markup.re.search(markup.SUSPECT, text)
    assert markup.kinds_of(text, "prose")
    again = markup.render(text, set(), "prose")
    assert not markup.kinds_of(again, "prose"), again


@pytest.mark.parametrize("text", PLAIN)
def test_plain_text_is_none(text):
    assert not markup.kinds_of(text, "prose")


def test_markup_places():
    assert markup.kinds_of("```\nx < 1\n```", "code") and not markup.kinds_of("a[i] = *p++; // <b>", "code")
    assert not markup.kinds_of("\\frac{a}{b} f'''(x)", "formula") and markup.kinds_of("<sub>i</sub> x", "formula")
    assert markup.render("```\nx\n```", set(), "code") == "x"
    assert markup.parts_of('{"items": [{"content": "a"}, {"content": null}]}') == ["a", ""] and markup.parts_of("{bad") == ["{bad"] and markup.parts_of(None) == []
    nav = "<nav><a href='/x'>Home of the archive 12</a></nav><p>Text</p>"
    (h, node), *_ = list(markup.subtrees(nav, markup.tree(nav)))
    assert node.tag == "nav" and h == next(iter(markup.subtrees(nav.replace("12", "77"), markup.tree(nav))))[0]
    assert markup.render(nav, {h}, "prose") == "Text"


def test_censored_fit_recovers_the_lengths():
    rng = np.random.default_rng(4)
    raw = np.exp(rng.normal(5.2, 0.6, 4000))
    cut = np.minimum(raw, 320).round()
    v, n = np.unique(cut, return_counts=True)
    mu, sigma = truncation.fit_lengths(v, n, 320)
    assert abs(mu - 5.2) < 0.05 and abs(sigma - 0.6) < 0.05
    import pandas as pd

    got = truncation.limits_of(pd.DataFrame({"unit": "chars", "length": v, "n": n}))
    assert got["limit"].tolist() == [320] and got["posterior"][0] > 0.9
    v, n = np.unique(raw.round(), return_counts=True)
    assert truncation.limits_of(pd.DataFrame({"unit": "chars", "length": v, "n": n})).empty


ENGLISH = "the harbour authority approved the annual statement and the field station recorded the sworn affidavit before the end of the month"
GERMAN = "der Aufsichtsrat genehmigte den Jahresabschluss und die Buchhaltung prüfte das Messprotokoll vor dem Ende des Monats"
JAPANESE = "市議会は全会員を代表して年次報告書を要約した。"


def test_languages():
    rng = random.Random(0)

    def made(words):
        w = words.split()
        return " ".join(rng.sample(w, 9)).capitalize() + "."

    texts = [" ".join(made(x) for _ in range(6)) for x in [ENGLISH] * 20 + [GERMAN] * 20] + [JAPANESE * 4] * 5
    labels = ["en"] * 18 + ["de"] * 2 + ["de"] * 18 + ["en"] * 2 + ["ja"] * 5  # some labels are wrong
    model = language.fit(texts, labels, ["de", "en", "ja"])
    cases = [made(ENGLISH), made(GERMAN), made(ENGLISH) + " " + made(GERMAN), made(ENGLISH) + "\n\n" + JAPANESE, "See the “Jahresabschluss” of the harbour authority before the end of the month.", "", None, "123 | LX7-C4", "  "]
    points, offsets = language.T.flatten(pa.array(cases))
    got = language.Reader(model).read(points, offsets)
    names = [{model.languages[j] for j in np.flatnonzero(r)} for r in got["chosen"] & (got["proportions"] > 0)]
    assert names[:5] == [{"en"}, {"de"}, {"de", "en"}, {"en", "ja"}, {"en"}] and names[5:] == [set()] * 4
    assert not got["sentence"][5:].any() and 0.3 < got["proportions"][2][0] < 0.7


def test_scans_are_repaired():
    rng = random.Random(1)
    vocabulary = "the harbour authority approved annual statement module field station recorded sworn affidavit before clerk month manager summary internal rules with further delay quarterly committee".split()
    rows = [{"type": "text", "text": " ".join(rng.choices(vocabulary, k=14)) + ".", "titles": ["Harbour Report 2010"], "page": 1, "y": None} for _ in range(400)]
    rows += [{"type": "header", "text": f"Harbour Report 2010  {i}", "titles": ["Harbour Report 2010"], "page": 1, "y": 30.0} for i in range(60)]
    rows += [{"type": "number", "text": str(i), "titles": ["Harbour Report 2010"], "page": 1, "y": 790.0} for i in range(60)]
    first, second = np.zeros(scans.SLOTS, np.float32), np.zeros(scans.SLOTS, np.float32)
    words = [w for r in rows if r["type"] == "text" for w in scans._WORD.findall(r["text"])]
    points, offsets = scans.T.flatten(pa.array(words))
    keys = scans.T.hashes(scans.T.lowers()[points], offsets[:-1], offsets[1:])
    np.add.at(first, (keys % np.uint64(scans.SLOTS)).astype(int), 1)
    np.add.at(second, ((keys >> np.uint64(40)) % np.uint64(scans.SLOTS)).astype(int), 1)
    ed = scans.train(rows, scans.Lexicon(first, second))
    bad = "the rnanager approved the annua1 state-\nment bef0re\nHarbour Report 2010 7\nthe comm-\n12\nittee recorded Fervormi LX16-C4."
    ed.meet([bad])
    fixed, done = ed.repair(bad, ["Harbour Report 2010"], 1, None)
    assert fixed == "the manager approved the annual statement before the committee recorded Fervormi LX16-C4." and done == {"words": 3, "joins": 2, "furniture": 2}
    for text in ("the field station recorded\nthe sworn affidavit.", "", "   ", "Fervormi and Mizorti", "x" * 50_000):
        ed.meet([text])
        assert not any(ed.repair(text, [], None, None)[1].values()), text


def _lexicon(texts):
    first, second = np.zeros(scans.SLOTS, np.float32), np.zeros(scans.SLOTS, np.float32)
    points, offsets = scans.T.flatten(pa.array(texts, pa.string()))
    keys = scans.T.hashes(scans.T.lowers()[points], *scans._word_places(points, offsets))
    np.add.at(first, (keys % np.uint64(scans.SLOTS)).astype(int), 1)
    np.add.at(second, ((keys >> np.uint64(40)) % np.uint64(scans.SLOTS)).astype(int), 1)
    return scans.Lexicon(first, second)


def test_confusions_are_learnt_from_the_corpus():
    """Confusions that no list has: told from the corpus, repaired on held-out text, invented names left alone."""
    rng = random.Random(4)
    parts = ["ba", "ker", "ton", "mil", "gra", "sed", "vor", "pal", "zin", "lo", "qua", "ster", "fen", "ru", "dok", "wit", "hem", "ny", "cal", "po"]
    vocabulary = list(dict.fromkeys("".join(rng.choices(parts, k=rng.randint(2, 4))) for _ in range(900)))
    confusions = [("k", "7"), ("ba", "6a"), ("w", "vu"), ("st", "$t"), ("e", "o"), ("ny", "my"), ("l", "t"), ("r", "y")]

    def spoil(word):
        true, seen = rng.choice(confusions)
        at = word.find(true)
        return word if at < 0 or len(word) < 5 else word[:at] + seen + word[at + len(true) :]

    def line(rate):
        words = rng.choices(vocabulary, [1 / (5 + i) for i in range(len(vocabulary))], k=14)
        return [(spoil(w) if rng.random() < rate else w, w) for w in words]

    texts = [" ".join(bad for bad, _ in line(0.01)) + "." for _ in range(6000)]
    rows = [{"type": "text", "text": x, "titles": ["Ledger"], "page": 1, "y": None} for x in texts[:3000]]
    ed = scans.train(rows, _lexicon(texts), more=texts[3000:])
    assert {("7", "k"), ("vu", "w"), ("y", "r")} <= set(ed.channel.weight)
    held = [pair for _ in range(400) for pair in line(0.2)]
    ed.meet([" ".join(bad for bad, _ in held)])
    changed = [(ed.known.get(bad, bad), bad, good) for bad, good in held]
    right, made, wanted = sum(k == g != b for k, b, g in changed), sum(k != b for k, b, _ in changed), sum(b != g for _, b, g in changed)
    assert wanted > 300 and right / made > 0.93 and right / wanted > 0.85, (right, made, wanted)
    names = ["Orvindal", "Tasmerro", "Ulgrith", "Pellovar"]
    ed.meet([" ".join(names)])
    assert [ed.known[n] for n in names] == names


def test_paragraphs_are_continuous():
    ed = scans.Editor(_lexicon([]), scans.Channel({}, {}, []), scans.Perceptron(), scans.Perceptron(), [])
    wrapped = "The board of trustees met on the third\nfloor of the old building and approved\nthe minutes. The clerk read the statement\nand the meeting closed.\n\nA second paragraph begins here."
    want = "The board of trustees met on the third floor of the old building and approved the minutes. The clerk read the statement and the meeting closed.\n\nA second paragraph begins here."
    assert ed.repair(wrapped, [], None, None) == (want, {"words": 0, "joins": 0, "furniture": 0})
    assert ed.repair(wrapped, [], None, None, lines_stay=True)[0] == wrapped
    items = "Agenda:\n- first item of the\nlist\n- second item\n1. third"
    assert scans.unwrap(items) == "Agenda:\n- first item of the list\n- second item\n1. third"


def test_pivots_keep_the_mass():
    import pandas as pd

    rng = np.random.default_rng(3)
    n = 500
    g = pd.DataFrame({"source": ["a"] * 300 + ["b"] * 200, "doc_id": range(n), "part": 0, "tokens": rng.integers(1, 900, n), "share": [0.3] * 300 + [0.75] * 200, "whole": 0, "draw": rng.random(n), "node": 0, "decided": False})
    out = mixing._pivot(g)
    for s in "ab":
        a, b = g[g.source == s], out[out.source == s]
        assert abs((a.share * a.tokens).sum() - (b.share * b.tokens).sum()) < 1e-3
        assert (~b.decided).sum() <= 1 and set(b[b.decided].share) <= {0.0, 1.0}
