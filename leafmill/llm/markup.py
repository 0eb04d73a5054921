"""Problem 2: HTML, Markdown, wiki and LaTeX residue turned into clean text.

A text that may hold markup is parsed into an element tree: HTML elements and
comments, wiki templates and tables, LaTeX environments. Subtrees of block
elements are hashed (digits folded) and counted per host in Spark; those that
recur on many pages of a host are site templates and are deleted. What is left
is rendered: headings on a line of their own, list items with a dash, code and
formulas verbatim, links by their words.

Which characters count as markup is settled by strict patterns, as comparisons,
prices, paths, names with underscores and bracketed notes look alike. Code
blocks are only searched for markers around the code, formulas for markup other
than LaTeX maths.

Defined cases: null texts have null clean text; empty, blank and markup-free
texts come out as they are; broken JSON in ``raw`` is read as plain text;
repeated rows are converted alike and found once. A text that is nothing but site
template has an empty clean text.
"""

from __future__ import annotations

import html
import json
import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.lineage import cut, spread
from ..session import table

#: HTML and wiki tags (fixed values).
TAGS = (
    "a abbr address article aside b big blockquote body br button caption center cite code col colgroup dd del details dfn div dl dt em "
    "figcaption figure font footer form gallery h1 h2 h3 h4 h5 h6 head header hr html i iframe img input ins kbd label li link main mark math "
    "meta nav noscript nowiki ol option p pre q ref references s samp script section select small source span strike strong style sub "
    "summary sup syntaxhighlight table tbody td template tfoot th thead time title tr tt u ul var video wbr"
).split()
BLOCK = set("article aside div figure footer form header li main nav ol section table ul comment template wikitable".split())
DROPPED = {"script", "style", "head", "comment", "ref", "references", "noscript", "iframe"}
#: A subtree of so many characters is a site template if it is on so many pages of a host, and at least this share of
#: them: on a host of up to 500 pages ten are enough, on larger ones it takes the share.
MIN_PAGES, MIN_SHARE, MIN_CHARS = 10, 0.02, 24

_TAG = rf"</?(?:{'|'.join(TAGS)})(?:\s+[a-zA-Z_:][-\w:.]*(?:\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?)*\s*/?>"
TAG = re.compile(_TAG, re.I)
COMMENT = re.compile(r"<!--.*?(?:-->|$)|<!DOCTYPE[^>]*>|<\?xml[^>]*>", re.S | re.I)
TORN_TAG = re.compile(rf"<(?:{'|'.join(TAGS)})\s+[a-zA-Z-]+=[\"'][^>]*$", re.I)
ENTITY = re.compile(r"&(?:[a-zA-Z][a-zA-Z0-9]{1,31}|#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6});")

MARKDOWN = {
    "md_fence": re.compile(r"^[ ]{0,3}(?:```|~~~)[^\n`]*$", re.M),
    "md_heading": re.compile(r"^[ ]{0,3}#{1,6}[ \t]+\S", re.M),
    "md_setext": re.compile(r"(?<=[^\s|])[ \t\r]*\n(?:={3,}|-{3,})[ \t]*$", re.M),
    "md_id": re.compile(r"\{#[A-Za-z][\w:-]*\}"),
    "md_strong": re.compile(r"\*\*(?=\S)[^*\n]+(?<=\S)\*\*|(?<![\w_])__(?=[^\s_])[^_\n]*?(?:_[^_\n]+)*?(?<=[^\s_])__(?![\w_])"),
    "md_em": re.compile(r"(?<![\w*\\/])\*(?=[^\s*])[^*\n]+(?<=[^\s*])\*(?![\w*])|(?<![\w_\\/.])_(?=[^\s_])[^_\n]+(?<=[^\s_])_(?![\w_])"),
    "md_strike": re.compile(r"~~(?=\S)[^~\n]+(?<=\S)~~"),
    "md_code": re.compile(r"(?<![`\\])`(?=[^`\s])[^`'\n]*(?<=[^\s])`(?!`)"),
    "md_link": re.compile(r"!?\[(?:[^\[\]\n]|\[[^\[\]\n]*\])*\]\((?=\S)[^()\s]*(?:\s+\"[^\"\n]*\")?\)"),
    "md_reflink": re.compile(r"!?\[(?![\d\s,.-]+\])[^\[\]\n]+\]\[[A-Za-z][\w-]*\]"),
    "md_autolink": re.compile(r"<(?:https?://|mailto:)[^\s<>]+>"),
    "md_footnote": re.compile(r"\[\^[\w-]+\]"),
    "md_definition": re.compile(r"^[ ]{0,3}\[[^\[\]\n]+\]:[ \t]+\S+", re.M),
    "md_quote": re.compile(r"^[ ]{0,3}>[ \t]+\S", re.M),
    "md_table": re.compile(r"^[ ]{0,3}\|?[ \t]*:?-{3,}:?[ \t]*(?:\|[ \t]*:?-{3,}:?[ \t]*)+\|?[ \t]*$|^\|[^|\n]+\|[^\n]*\|[ \t]*$", re.M),
    "md_rule": re.compile(r"^[ ]{0,3}(?:\*[ ]?){3,}$|^[ ]{0,3}(?:_[ ]?){3,}$", re.M),
    "md_task": re.compile(r"^\s*[-*+] \[[ xX]\] \S", re.M),
}
WIKI = {
    "wiki_heading": re.compile(r"^(={2,6})[^=\n](?:[^\n]*[^=\n])?\1[ \t]*$", re.M),
    "wiki_link": re.compile(r"\[\[[^\[\]\n]*(?:\]\]|$)"),
    "wiki_url": re.compile(r"\[(?:https?|ftp)://[^\s\]]+[^\]\n]*\]"),
    "wiki_template": re.compile(r"\{\{[^{}]+(?:\}\}|$)"),
    "wiki_table": re.compile(r"^\{\|.*$|^\|\}|^\|-", re.M),
    "wiki_strong": re.compile(r"'''(?=\S)[^'\n]+?(?:'[^'\n]+?)*?'''"),
    "wiki_em": re.compile(r"(?<![\w'`])''(?=[^\s'])[^'\n]+(?:'[^'\n]+)*?''(?!')"),
    "wiki_magic": re.compile(r"__(?:NOTOC|TOC|FORCETOC|NOEDITSECTION|NOINDEX|INDEX|NEWSECTIONLINK|HIDDENCAT)__"),
    "wiki_sign": re.compile(r"(?<!~)~{3,5}(?!~)"),
    "wiki_redirect": re.compile(r"^#REDIRECT\b", re.M | re.I),
}
LATEX = {
    "tex_command": re.compile(r"(?<!\\)\\[a-zA-Z]+\*?[ ]?(?:\[[^\]\n]*\])?\{"),
    "tex_word": re.compile(r"(?<![A-Za-z0-9:\\])\\(?:item|noindent|par|newline|newpage|clearpage|hline|centering|maketitle|tableofcontents|ldots|dots|LaTeX|TeX|medskip|bigskip|smallskip|quad|qquad|hfill|vspace|hspace|leq|geq|neq|times|pm|cdot|sum|int|alpha|beta|gamma|epsilon|infty|sqrt|frac|left|right)(?![A-Za-z])"),
    "tex_group": re.compile(r"\{\\[a-zA-Z]+\b"),
    "tex_math": re.compile(r"(?<![\\$\w])\$\$?(?=[^\s$])(?=[^$\n]*[\\_^{}=<>+]|[a-zA-Z]\$)[^$\n]{1,300}?(?<=[^\s$\\])\$\$?(?!\d)"),
    "tex_parens": re.compile(r"\\\((?=.).*?\\\)|\\\[(?=.).*?\\\]", re.S),
    "tex_escape": re.compile(r"(?<![\\A-Za-z:])(?<=.)\\[%&#$,;_]|^\\[%&#$]|(?<=\d)\\,"),
    "tex_quote": re.compile(r"``(?=[^\s`])[^`\n]+?''"),
    "tex_break": re.compile(r"\\\\(?:\[[^\]]*\])?[ \t]*$", re.M),
}
#: Markers that enclose a whole code block.
CODE_OPEN = re.compile(r"\A\s*(?:```[^\n]*\n?|~~~[^\n]*\n?|<(?:pre|code|syntaxhighlight|source|tt)\b[^>]*>|\\begin\{(?:lstlisting|verbatim|minted|code)\}(?:\[[^\]]*\])?(?:\{[^}]*\})?|\{\{\{|\[code[^\]]*\])", re.I)
CODE_CLOSE = re.compile(r"(?:```|~~~|</(?:pre|code|syntaxhighlight|source|tt)>|\\end\{(?:lstlisting|verbatim|minted|code)\}|\}\}\}|\[/code\])\s*\Z", re.I)
#: A text without any of these holds no markup; for Spark's own filter.
SUSPECT = r"[<&*_`{\\$#|~]|\[\[|\]\(|\]\[|\[\^|\]:|\[http|''|==|--|(^|\n) {0,3}>|- \[[ xX]\]"


#: A wiki template around a formula.
_MATH_TEMPLATE = re.compile(r"\A\s*\{\{[A-Za-z][\w ]*\||\{\{(?:math|mvar|tmath|frac|sqrt)\|")


class Node:
    """An element: tag, where it starts and ends, and its children."""

    __slots__ = ("children", "end", "start", "tag")

    def __init__(self, tag: str, start: int, end: int) -> None:
        self.tag, self.start, self.end, self.children = tag, start, end, []


_PARTS = re.compile(rf"(?P<comment>{COMMENT.pattern})|(?P<tag>{_TAG})|(?P<open>\{{\{{)|(?P<close>\}}\}})|(?P<topen>^\{{\|)|(?P<tclose>^\|\}})", re.S | re.I | re.M)
_VOID = {"br", "hr", "img", "input", "link", "meta", "wbr", "col", "source"}


def tree(text: str) -> Node:
    """The element tree of a text; unclosed elements end with their parent."""
    root = Node("", 0, len(text))
    stack = [root]
    for m in _PARTS.finditer(text):
        kind, s = m.lastgroup, m.group()
        if kind == "comment":
            stack[-1].children.append(Node("comment", m.start(), m.end()))
        elif kind in ("open", "topen"):
            node = Node("template" if kind == "open" else "wikitable", m.start(), len(text))
            stack[-1].children.append(node)
            stack.append(node)
        elif kind in ("close", "tclose"):
            _close(stack, "template" if kind == "close" else "wikitable", m.end())
        else:
            name = re.match(r"</?([a-zA-Z0-9]+)", s).group(1).lower()
            if s.startswith("</"):
                _close(stack, name, m.end())
            elif name in _VOID or s.endswith("/>"):
                stack[-1].children.append(Node(name, m.start(), m.end()))
            else:
                node = Node(name, m.start(), stack[-1].end)
                stack[-1].children.append(node)
                stack.append(node)
    return root


def _close(stack: list[Node], tag: str, at: int) -> None:
    for i in range(len(stack) - 1, 0, -1):
        if stack[i].tag == tag:
            for node in stack[i:]:
                node.end = at
            del stack[i:]
            return


def subtrees(text: str, node: Node):
    """Block subtrees with their hash, outermost first."""
    for child in node.children:
        body = text[child.start : child.end]
        if child.tag in BLOCK and len(body) >= MIN_CHARS:
            yield _digest(body), child
        yield from subtrees(text, child)


def _digest(body: str) -> int:
    return xxhash.xxh64_intdigest(re.sub(r"\s+", " ", re.sub(r"\d+", "0", body)).strip()) - (1 << 63)


_BLANK_LINE = re.compile(r"\n[ \t]*\n")
_PARAGRAPH = re.compile(r"[^\n]+(?:\n[ \t]*[^\s][^\n]*)*")


def elements_of(text: str) -> list[tuple[int, Node]]:
    """What a page may share with others of its host: block subtrees, and, of texts written without elements, paragraphs that hold markup.

    A paragraph that is the whole text is content, however often it recurs.
    """
    root = tree(text) if "<" in text or "{" in text else Node("", 0, len(text))
    out = list(subtrees(text, root))
    for m in _PARAGRAPH.finditer(text) if _BLANK_LINE.search(text) else ():
        a, b = m.span()
        if b - a >= MIN_CHARS and b - a < len(text.strip()) and not any(c.start < b and a < c.end for c in root.children) and kinds_of(m.group(), "prose"):
            out.append((_digest(m.group()), Node("paragraph", a, b)))
    return out


def unescape(text: str) -> str:
    """Entities replaced, twice at most, as text may have been escaped twice."""
    for _ in range(2):
        again = ENTITY.sub(lambda m: html.unescape(m.group()), text)
        if again == text:
            break
        text = again
    return text


def kinds_of(text: str, place: str) -> set[str]:
    """Names of the markup found. ``place``: prose, code or formula."""
    found = set()
    if ENTITY.search(text) and (unescaped := unescape(text)) != text:
        if place != "code":
            found.add("entity")
        elif kinds_of(unescaped, "code"):
            found.add("entity")
        text = unescaped
    if place == "code" or (place == "prose" and text.lstrip().startswith("#!")):
        return found | {n for n, p in (("code_open", CODE_OPEN), ("code_close", CODE_CLOSE)) if p.search(text)}
    if place == "prose":
        text = re.sub(r"^#![^\n]*(?:\n#[^\n]*)*", "", text, flags=re.M)  # a script's comments are no headings
    if TAG.search(text) or COMMENT.search(text) or TORN_TAG.search(text):
        found.add("html")
    if place == "formula":
        names = [MARKDOWN["md_fence"], MARKDOWN["md_strong"], _MATH_TEMPLATE, MARKDOWN["md_code"], CODE_OPEN, WIKI["wiki_heading"], WIKI["wiki_link"]]
        return found | ({"formula_wrapper"} if any(p.search(text) for p in names) else set())
    return found | {n for group in (MARKDOWN, WIKI, LATEX) for n, p in group.items() if p.search(text)}


# ---------------------------------------------------------------- rendering

_INLINE = [
    (re.compile(r"!\[([^\]\n]*)\]\([^)\n]*\)"), r"\1"),
    (re.compile(r"\[((?:[^\[\]\n]|\[[^\[\]\n]*\])*)\]\((?=\S)[^()\s]*(?:\s+\"[^\"\n]*\")?\)"), r"\1"),
    (re.compile(r"!?\[(?![\d\s,.-]+\])([^\[\]\n]+)\]\[[A-Za-z][\w-]*\]"), r"\1"),
    (re.compile(r"<((?:https?://|mailto:)[^\s<>]+)>"), r"\1"),
    (re.compile(r"\[\^[\w-]+\]:?"), ""),
    (re.compile(r"\[\[(?:Category|File|Image):[^\[\]\n]*\]\]\n?", re.I), ""),
    (re.compile(r"\[\[(?:[^\[\]|\n]*\|)?([^\[\]|\n]*)(?:\]\]|$)"), r"\1"),
    (re.compile(r"\[(?:https?|ftp)://[^\s\]]+\s*([^\]\n]*)\]"), r"\1"),
    (WIKI["wiki_magic"], ""),
    (re.compile(r"(?<!~)~{3,5}(?!~)"), ""),
    (re.compile(r"'''''([^\n]+?)'''''|'''([^\n]+?)'''(?!')"), lambda m: m.group(1) or m.group(2)),
    (re.compile(r"``(?=[^\s`])([^`\n]+?)''"), "“\\1”"),
    (re.compile(r"(?<![\w'])''(?=\S)([^\n]+?)''(?!')"), r"\1"),
    (re.compile(r"\*\*(?=\S)([^*\n]+)(?<=\S)\*\*"), r"\1"),
    (re.compile(r"(?<![\w_])__(?=[^\s_])([^\n]+?)(?<=[^\s_])__(?![\w_])"), r"\1"),
    (re.compile(r"~~(?=\S)([^~\n]+)(?<=\S)~~"), r"\1"),
    (re.compile(r"(?<![\w*\\/])\*(?=[^\s*])([^*\n]+)(?<=[^\s*])\*(?![\w*])"), r"\1"),
    (re.compile(r"(?<![\w_\\/.])_(?=[^\s_])([^_\n]+)(?<=[^\s_])_(?![\w_])"), r"\1"),
    (re.compile(r"(?<![`\\])`(?=[^`\s])([^`'\n]*)(?<=[^\s])`(?!`)"), r"\1"),
    (re.compile(r"[ ]?\{#[A-Za-z][\w:-]*\}"), ""),
    (re.compile(r"[~ ]?\\(?:cite|citep|citet|label|footnotemark|index|pageref|ref)\*?(?:\[[^\]]*\])?\{[^{}]*\}"), ""),
    (re.compile(r"\\(?:sub)*section\*?\{([^{}]*)\}|\\chapter\*?\{([^{}]*)\}|\\paragraph\*?\{([^{}]*)\}"), lambda m: "\n" + next(g for g in m.groups() if g is not None) + "\n"),
    (re.compile(r"\\(?:textbf|textit|emph|texttt|textsc|underline|textrm|textsf|text|mbox|title|author|caption|href\{[^{}]*\}|url)\{([^{}]*)\}"), r"\1"),
    (re.compile(r"\\footnote\{([^{}]*)\}"), r" (\1)"),
    (re.compile(r"\{\\(?:it|bf|em|tt|sc|sl|rm|sf|itshape|bfseries|small|large|Large)\b[ ]?([^{}]*)\}"), r"\1"),
    (re.compile(r"\\(?:begin|end)\{(?:itemize|enumerate|description|center|quote|document|abstract|figure|table)\*?\}(?:\[[^\]]*\])?[ ]*\n?"), ""),
    (re.compile(r"^[ \t]*\\item(?:\[[^\]]*\])?[ \t]*", re.M), "- "),
    (re.compile(r"\\([%&#$_])"), r"\1"),
    (re.compile(r"(?<=\d)\\,"), " "),
    (re.compile(r"\\(?:noindent|par|newpage|clearpage|maketitle|tableofcontents|medskip|bigskip|smallskip|centering)\b[ ]?"), ""),
    (re.compile(r"\\(?:ldots|dots)\b(?:\{\})?"), "…"),
    (re.compile(r"(?<=\w)~(?=[\\\w])"), " "),
]
_LINES = [
    (re.compile(r"^(={2,6})[ \t]*([^\n]*?[^=\n])[ \t]*\1[ \t]*$", re.M), r"\2\n"),
    (re.compile(r"^[ ]{0,3}#{1,6}[ \t]+([^\n]*?)[ \t]*#*[ \t]*$", re.M), r"\1\n"),
    (re.compile(r"(?<=[^\s|])[ \t\r]*\n(?:={3,}|-{3,})[ \t]*$", re.M), "\n"),
    (re.compile(r"^[ ]{0,3}\|?[ \t]*:?-{3,}:?[ \t]*(?:\|[ \t]*:?-{3,}:?[ \t]*)*\|?[ \t]*\n?", re.M), ""),
    (re.compile(r"^\|(?![-}])([^\n]*)\|[ \t]*$", re.M), lambda m: "\t".join(c.strip() for c in m.group(1).split("|"))),
    (re.compile(r"^[ ]{0,3}>[ \t]?", re.M), ""),
    (re.compile(r"^[ \t]*[*+][ \t]+(?=\S)", re.M), "- "),
    (re.compile(r"^([ \t]*- )\[[ xX]\] ", re.M), r"\1"),
    (re.compile(r"^[ ]{0,3}\[[^\[\]\n]+\]:[ \t]+\S+[^\n]*\n?", re.M), ""),
]
_BREAKS = {"br", "p", "div", "tr", "section", "article", "blockquote", "figure", "header", "footer", "table", "ul", "ol", "dl", "hr", "pre"}


def render(text: str, templates: set[int], place: str) -> str:
    """Clean text of one value, without the subtrees whose hash is in ``templates``."""
    text = unescape(text)
    if place == "code":
        again = CODE_CLOSE.sub("", CODE_OPEN.sub("", text))
        return again.strip("\n") if again != text else text
    if place == "formula":
        text = re.sub(r"\A\s*\{\{[A-Za-z][\w ]*\|(.*)\}\}\s*\Z", r"\1", text, flags=re.S)
        text = re.sub(r"^\s*(?:```\w*\n?|\*\*)|(?:```|\*\*)\s*$", "", TAG.sub("", COMMENT.sub("", text)))
        return re.sub(r"\A\s*\$\$?\s*|\s*\$\$?\s*\Z", "", text).strip()
    root = tree(text)
    if templates:
        gone, end = [], 0
        for node in sorted((n for h, n in elements_of(text) if h in templates), key=lambda n: (n.start, -n.end)):
            if node.start >= end:  # a subtree within one that goes is gone with it
                gone.append(node)
                end = node.end
        for node in reversed(gone):
            text = text[: node.start] + text[node.end :]
        root = tree(text)
    held: list[str] = []

    def hold(s: str) -> str:
        held.append(s)
        return f"\x00{len(held) - 1}\x00"

    text = re.sub(r"^[ ]{0,3}(```|~~~)[^\n]*\n(.*?)(?:^[ ]{0,3}\1[ \t]*$|\Z)", lambda m: hold(m.group(2)), text, flags=re.S | re.M)
    text = re.sub(r"<(pre|code|syntaxhighlight|source|nowiki|math)\b[^>]*>(.*?)</\1>", lambda m: hold(m.group(2)), text, flags=re.S | re.I)
    text = re.sub(r"\\begin\{(lstlisting|verbatim)\}(.*?)\\end\{\1\}", lambda m: hold(m.group(2)), text, flags=re.S)
    text = re.sub(r"\\begin\{(equation|align|aligned|gather|displaymath|math)\*?\}(.*?)\\end\{\1\*?\}", lambda m: hold(m.group(2).strip()), text, flags=re.S)
    text = LATEX["tex_math"].sub(lambda m: hold(m.group().strip("$")), text)
    text = LATEX["tex_parens"].sub(lambda m: hold(m.group()[2:-2].strip()), text)
    text = _structure(text, tree(text))
    text = WIKI["wiki_template"].sub("", text)
    for _ in range(4):
        before = text
        for rule, to in _INLINE:
            text = rule.sub(to, text)
        if text == before:
            break
    for rule, to in _LINES:
        text = rule.sub(to, text)
    for _ in range(3):  # code within a link, and the like
        text = re.sub("\x00(\\d+)\x00", lambda m: held[int(m.group(1))], text)
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+(?=\n|\Z)", "", text)).strip()


def _structure(text: str, root: Node) -> str:
    """The text without element marks: breaks at block elements, dashes at items, bars out of tables."""
    text = COMMENT.sub("", text)
    text = re.sub(r"<(script|style|head|references)\b[^>]*>.*?</\1>|<ref\b[^>]*/>|<ref\b[^>]*>.*?</ref>", "", text, flags=re.S | re.I)
    for node in reversed([c for c in root.children if c.tag == "template"]):
        if text[node.start : node.start + 2] == "{{":
            text = text[: node.start] + text[node.end :].lstrip("\n") if node.start == 0 else text[: node.start] + text[node.end :]
    if re.search(r"^\{\|", text, flags=re.M):
        text = re.sub(r"^\{\|[^\n]*\n?|^\|\}[ \t]*\n?|^\|-[^\n]*\n?", "", text, flags=re.M)
        text = re.sub(r"^[!|](?![|}-])[ \t]*", "", text, flags=re.M)

    def mark(m: re.Match) -> str:
        name = re.match(r"</?([a-zA-Z0-9]+)", m.group()).group(1).lower()
        closing = m.group().startswith("</")
        if name == "li" or name in ("dd", "dt"):
            return "" if closing else "\n- "
        if re.fullmatch("h[1-6]", name):
            return "\n"
        if name in ("td", "th"):
            return "\t" if closing else ""
        return "\n" if name in _BREAKS else ""

    return re.sub(r"\n-\s+", "\n- ", TORN_TAG.sub("", TAG.sub(mark, text))).lstrip("\n")


def parts_of(value: str | None) -> list[str]:
    """The texts of a node's ``raw``: its text, or its items' contents."""
    if value is None:
        return []
    try:
        got = json.loads(value)
    except ValueError:
        return [value]
    if isinstance(got, dict):
        if isinstance(got.get("items"), list):
            return [str(i.get("content") or "") if isinstance(i, dict) else str(i) for i in got["items"]]
        if got.get("text") is not None:
            return [str(got["text"])]
        return []
    return [str(got)]


# ---------------------------------------------------------------- the operator

_PARSED = "origin string, item_id bigint, host string, page bigint, place string, form string, text string, kinds array<string>, elements array<struct<element:bigint,body:string>>"
_KEPT = ("origin", "item_id", "host", "page", "place", "form", "text")
_CLEAN = "origin string, item_id bigint, kinds array<string>, templates int, clean_text string"


def _value(text: str | None, form: str) -> list[str]:
    return parts_of(text) if form == "raw" else [] if text is None else [text]


def parsed_items(items: DataFrame) -> DataFrame:
    """The texts that may hold markup, parsed once and written down: kinds of markup, and elements with their hash."""
    suspects = items.where(F.col("text").rlike(SUSPECT))

    def parse(batches):
        for batch in batches:
            c = batch.to_pydict()
            kinds, elements = [], []
            for text, place, form in zip(c["text"], c["place"], c["form"], strict=True):
                values = _value(text, form)
                kinds.append(sorted({k for v in values for k in kinds_of(v, place)}))
                found = {h: u[n.start : n.end] for v in values if place == "prose" for u in [unescape(v)] for h, n in elements_of(u)} if kinds[-1] or "<" in text or "{" in text else {}
                elements.append([{"element": h, "body": body} for h, body in sorted(found.items())])
            keep = [i for i, k in enumerate(kinds) if k or elements[i]]
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index(n)).take(pa.array(keep, pa.int64())) for n in _KEPT]
                + [pa.array([kinds[i] for i in keep], pa.list_(pa.string())), pa.array([elements[i] for i in keep], pa.list_(pa.struct([("element", pa.int64()), ("body", pa.string())])))],
                names=[*_KEPT, "kinds", "elements"],
            )

    return cut(spread(suspects.select(*_KEPT)).mapInArrow(parse, _PARSED))


def templates_of(parsed: DataFrame, pages: DataFrame) -> DataFrame:
    """Site templates: host, element, the pages it is on, and the host's pages. ``pages``: host and page of all items."""
    # one row a page and element first, so no list of pages is held
    seen = parsed.select("host", "page", F.explode("elements.element").alias("element")).distinct()
    counted = seen.groupBy("host", "element").agg(F.count(F.lit(1)).alias("pages")).where(F.col("pages") >= MIN_PAGES)
    sizes = pages.select("host", "page").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("host_pages"))
    return counted.join(sizes, "host").where(F.col("pages") >= MIN_SHARE * F.col("host_pages"))


def convert(items: DataFrame) -> DataFrame:
    """Clean text of every item with markup or a site template. ``items``: origin, item_id, host, page, place, form (text or raw), text."""
    parsed = parsed_items(items)
    recurring = templates_of(parsed, items).select("host", "element")
    hits = parsed.select("origin", "item_id", "host", F.explode("elements.element").alias("element")).join(recurring, ["host", "element"])
    hits = hits.groupBy("origin", "item_id").agg(F.collect_set("element").alias("templates"))  # of one item's own subtrees
    todo = parsed.drop("elements").join(hits, ["origin", "item_id"], "left").where("size(kinds) > 0 or templates is not null")

    def finish(batches):
        for batch in batches:
            c = batch.to_pydict()
            clean = []
            for text, place, form, gone in zip(c["text"], c["place"], c["form"], c["templates"], strict=True):
                values = _value(text, form)
                done = [render(v, set(gone or ()), place) if gone or kinds_of(v, place) else v for v in values]
                clean.append("\n".join(f"- {d}" for d in done) if len(done) > 1 else done[0] if done else None)
            number = [len(gone or ()) for gone in c["templates"]]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(5), pa.array(number, pa.int32()), pa.array(clean, pa.string())], names=["origin", "item_id", "kinds", "templates", "clean_text"])

    return todo.select("origin", "item_id", "place", "form", "text", "kinds", "templates").mapInArrow(finish, _CLEAN)


def items_of(spark: SparkSession, folder: str) -> DataFrame:
    """Block texts, node raws and latex fields."""
    place = F.when(F.col("type") == "code", "code").when(F.col("type") == "equation", "formula").otherwise("prose").alias("place")
    blocks = table(spark, folder, "blocks").select(F.lit("blocks").alias("origin"), F.col("block_id").alias("item_id"), F.coalesce("source", F.lit("")).alias("host"), F.col("document_id").alias("page"), place, F.lit("text").alias("form"), "text")
    nodes = table(spark, folder, "content_nodes")
    host = F.coalesce(F.regexp_extract("search_text", r"^([^\n]*)", 1), F.lit("")).alias("host")
    raw = nodes.select(F.lit("content_nodes").alias("origin"), F.col("content_id").alias("item_id"), host, F.col("document_id").alias("page"), place, F.lit("raw").alias("form"), F.col("raw").alias("text"))
    latex = nodes.where("latex is not null").select(F.lit("content_nodes").alias("origin"), F.col("content_id").alias("item_id"), host, F.col("document_id").alias("page"), F.lit("formula").alias("place"), F.lit("text").alias("form"), F.col("latex").alias("text"))
    return blocks.unionByName(raw).unionByName(latex)


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Items that carry markup."""
    return convert(items_of(spark, folder)).select("origin", "item_id").distinct()


def p2_clean(spark: SparkSession, folder: str) -> DataFrame:
    """Clean text of the items that carry markup, and the kinds found."""
    return convert(items_of(spark, folder))


def p2_templates(spark: SparkSession, folder: str) -> DataFrame:
    """Site templates that conversion removes, with one of the texts each stands for."""
    items = items_of(spark, folder)
    parsed = parsed_items(items)
    found = templates_of(parsed, items)
    bodies = parsed.select("host", F.explode("elements").alias("e")).select("host", "e.element", "e.body").join(found.select("host", "element"), ["host", "element"], "left_semi")
    return found.join(bodies.groupBy("host", "element").agg(F.min("body").alias("body")), ["host", "element"])


QUERIES = {"p2_found": p2_found, "p2_clean": p2_clean, "p2_templates": p2_templates}
