"""The main text of web pages: the contiguous stretch of a page with the best score.

A page is a sequence of tokens. Words score +1 each and tags score below zero; a linear scan
finds the stretch whose sum is highest. The weights of tags are learned from pages whose
author marked the article: they start from how often a tag stands outside the mark, and a
structured perceptron lowers those by which a wrong stretch went beyond the marked one,
and raises those it should have passed. Elements that name themselves as something else
(a menu, a notice) are cut out first; where the name leaves doubt, it is one more weight
beside their words.
"""

from __future__ import annotations

import html
import json
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The fit takes so many pages at most, whole, those of lowest hashed id.
FIT_PAGES, FIT_PASSES, RATE = 400, 8, 0.25
#: How many sightings of a tag its prior weight is worth.
START = 5.0
#: While fitting, words outside the mark count more and words inside less, which leaves a margin.
OUTSIDE, INSIDE = 3.0, 0.5

_DROPPED = "script|style|title|noscript|template|svg|math|iframe|object|select|button|textarea|canvas|audio|video"
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    rf"|<(?P<raw>{_DROPPED})\b(?:\"[^\"]*\"|'[^']*'|[^>\"'])*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<more>(?:\"[^\"]*\"|'[^']*'|[^>\"'])*)(?:>|\Z)"
    r"|<[!?/][^>]*(?:>|\Z)"
    r"|(?P<text>[^<]+|<)",
    re.S | re.I,
)
_HINTED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset(
    "a abbr b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr br".split()
)
_MARK = frozenset(("article", "main"))
#: Elements, and words in class, id or role, that name what is not the article.
_ASIDE = frozenset("nav header footer aside form menu dialog".split())
_ASIDE_HINTS = frozenset(
    "ad ads advert advertisement banner sponsored promo nav navigation menu breadcrumb breadcrumbs header footer sidebar aside "
    "notice cookie consent popup newsletter subscribe share social related comment comments reply disqus login search form".split()
)
#: Those of them that are ordinary words of longer names, which are then weighed against the element's words.
_TOPICS = frozenset("banner header notice share social related reply login search form promo menu".split())
#: Words that make a name tell of a state of the page (no-sidebar, comments-enabled), not of what the element is.
_STATES = frozenset("no not has with without open closed enabled disabled on off fixed sticky free hidden visible left right".split())
#: What such a longer name costs, in words, and what a word of a link costs inside.
NAMED_COST, LINKED_COST = 12, 2
#: Shares of the page's words above which an element is no aside: of wrappers, and of clearly named ones.
WRAPS, HOLDS_ALL = 0.5, 0.9
#: Scripts written without spaces: two characters count as one word.
_UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff]")


@dataclass
class Token:
    key: str  # of a tag: its spelling in the weights; of text: empty
    words: int
    text: str
    breaks: bool  # whether a block ends here
    marked: bool  # inside the author's mark


@dataclass
class Doubtful:
    """An element that names itself as aside: its tokens are those from ``start`` up to ``end``."""

    start: int
    sure: bool  # its words need not be weighed
    wrapper: bool
    end: int = 0


def _names(more: str) -> list[list[str]]:
    """The names in class, id and role, each as its lower-case parts."""
    found = _HINTED.findall(more) if "=" in more else []
    names = [n for groups in found for n in "".join(groups).lower().split()]
    return [parts for n in names if (parts := [w for w in re.split(r"[^a-z0-9]+", n) if w])]


def _named(names: list[list[str]]) -> tuple[bool, bool]:
    """Whether one of the names tells of an aside, and whether without doubt."""
    told = sure = False
    for parts in names:
        hints = _ASIDE_HINTS.intersection(parts)
        if hints and not (len(parts) > 1 and _STATES.intersection(parts)):
            told = True
            sure = sure or len(parts) == 1 or not hints <= _TOPICS
    return told, sure


def _count(text: str) -> int:
    words = len(text.split())
    return words if text.isascii() else max(words, (len(_UNSPACED.findall(text)) + 1) // 2)


def _asides(line: list[Token], linked: list[bool], elements: list[Doubtful]) -> list[bool]:
    """Which tokens lie in an element that is an aside.

    An element is none if it holds more than ``HOLDS_ALL`` of the page's words (a wrapper, or one of a
    longer name: more than ``WRAPS``), or if its name leaves doubt and its words outweigh that name:
    plain words count for it, words of links and the name against it.
    """
    words, links = [0], [0]
    for t, in_link in zip(line, linked):
        words.append(words[-1] + t.words)
        links.append(links[-1] + t.words * in_link)
    depth = [0] * (len(line) + 1)
    for e in elements:
        n, of_links = words[e.end] - words[e.start], links[e.end] - links[e.start]
        if n > (WRAPS if e.wrapper or not e.sure else HOLDS_ALL) * words[-1]:
            continue
        if not e.sure and n - of_links - LINKED_COST * of_links > NAMED_COST:
            continue
        depth[e.start] += 1
        depth[e.end] -= 1
    inside, out = 0, []
    for d in depth[:-1]:
        inside += d
        out.append(inside > 0)
    return out


def tokens(page: str, hinted: bool = True) -> list[Token]:
    """The tokens of a page. Of asides - by their class only if ``hinted`` - their own tags alone are kept, so
    that their text is never returned. ``body``, ``article`` and ``main`` are never asides.
    """
    made: list[Token] = []
    linked: list[bool] = []
    stack: list[tuple[str, str, Doubtful | None]] = []
    elements: list[Doubtful] = []
    doubts = marked = links = 0

    def pop() -> None:
        nonlocal doubts, marked, links
        name, _, doubtful = stack.pop()
        if doubtful:
            doubtful.end = len(made)
            doubts -= 1
        marked -= name in _MARK
        links -= name == "a"

    def add(token: Token) -> None:
        made.append(token)
        linked.append(links > 0)

    for m in _TOKEN.finditer(page):
        if (text := m["text"]) is not None:
            text = html.unescape(text)
            add(Token("", _count(text), text, False, marked > 0))
            continue
        if m["name"] is None:
            continue
        name = m["name"].lower()
        if m["close"]:
            key = name
            if any(name == s[0] for s in stack):
                while stack[-1][0] != name:
                    pop()
                key = stack[-1][1]
                pop()
            add(Token("/" + key, 0, " " if name == "br" else "", name not in _INLINE, marked > 0))
            continue
        block = name not in _INLINE
        if block and stack and stack[-1][0] == "p":
            pop()
        if name in ("li", "td", "th", "tr", "option", "dt", "dd") and stack and stack[-1][0] == name:
            pop()
        if name in _MARK:
            while doubts:
                pop()
        names = _names(m["more"])
        key = name + "".join("." + w for parts in names[:1] for w in parts[:1])
        add(Token(key, 0, " " if name == "br" else "", block, marked > 0))
        if name not in _VOID and not m["more"].endswith("/"):
            told, sure = _named(names) if hinted and block and name not in _MARK and name not in ("body", "html") else (False, False)
            doubtful = None
            if name in _ASIDE or told:
                doubtful = Doubtful(len(made), name in _ASIDE or sure, name == "form" and not sure)
                elements.append(doubtful)
                doubts += 1
            stack.append((name, key, doubtful))
            marked += name in _MARK
            links += name == "a"
    while stack:
        pop()
    return [t for t, aside in zip(made, _asides(made, linked, elements)) if not aside]


def prior(key: str) -> float:
    """The weight of a tag before any page is seen."""
    bare = key.lstrip("/")
    name = bare.split(".")[0]
    if name in _ASIDE or name in _INLINE or _ASIDE_HINTS.intersection(bare.split(".")[1:]):
        return -0.02
    if re.fullmatch(r"p|h[1-6]|blockquote|pre|figure|figcaption", name):
        return -0.05
    return {"article": -4.0, "main": -4.0, "body": -4.0, "ul": -0.5, "ol": -0.5, "li": -0.5, "table": -0.5}.get(name, -1.0)


def _weight(weights: dict[str, float], key: str) -> float:
    if key in weights:
        return weights[key]
    plain = key.split(".")[0]
    return min(weights.get(plain, prior(key)), prior(key)) if plain != key else prior(key)


def best_stretch(scores: list[float]) -> tuple[int, int]:
    """Start and end of the stretch of highest sum above zero, the first of equals; (0, 0) if there is none."""
    best, at, sum_, start = 0.0, (0, 0), 0.0, 0
    for i, score in enumerate(scores):
        if sum_ <= 0:
            sum_, start = 0.0, i
        sum_ += score
        if sum_ > best:
            best, at = sum_, (start, i + 1)
    return at


#: A page without its texts: key, words and mark of every token.
Line = list[tuple[str, int, bool]]


def lines(page: str) -> tuple[Line, Line]:
    """The page with and without the hints of classes; two empty lines if it marks no article."""
    both = [[(t.key, t.words, t.marked) for t in tokens(page, hinted)] for hinted in (True, False)]
    return (both[0], both[1]) if any(marked and words for _, words, marked in both[0]) else ([], [])


def fit(pages: list[tuple[Line, Line]]) -> dict[str, float]:
    """Weights of tags from the ``lines`` of pages that mark an article.

    Of every four pages one is shown whole, one without the mark's own tags, one without the
    hints of classes, and one without either, so that no single sign is relied on. No tag's
    weight rises above -0.01.
    """
    examples = []
    inside, outside = Counter(), Counter()
    for hinted, plain in pages:
        shown = len(examples) % 4
        line = hinted if shown < 2 else plain
        if any(marked and words for _, words, marked in line):
            if shown % 2:
                line = [t for t in line if t[0].strip("/").split(".")[0] not in _MARK]
            examples.append(line)
            for key, _, marked in line:
                if key:
                    (inside if marked else outside)[key] += 1
    weights = {
        key: (START * prior(key) - 4.0 * outside[key] - 0.02 * inside[key]) / (START + outside[key] + inside[key])
        for key in {*inside, *outside}
        if prior(key) < -0.02 or "." in key
    }
    for _ in range(FIT_PASSES):
        wrong = 0
        for line in examples:
            scores = [
                _weight(weights, key) if key else words * (INSIDE if marked else OUTSIDE) for key, words, marked in line
            ]
            a, b = best_stretch(scores)
            wanted = [i for i, (_, words, marked) in enumerate(line) if marked and words]
            c, d = wanted[0], wanted[-1] + 1
            if {i for i in range(a, b) if line[i][1]} != {i for i in range(c, d) if line[i][1]}:
                wrong += 1
                change = Counter(t[0] for t in line[c:d] if t[0])
                change.subtract(t[0] for t in line[a:b] if t[0])
                for key, n in change.items():
                    if n:
                        weights[key] = min(-0.01, _weight(weights, key) + RATE * max(-4, min(4, n)))
        if not wrong:
            break
    return weights


def extract(page: str, weights: dict[str, float]) -> str:
    """The text of the best stretch: white space inside a block is one space, blocks are joined by a line feed."""
    line = tokens(page)
    a, b = best_stretch([_weight(weights, t.key) if t.key else float(t.words) for t in line])
    blocks, held = [], []
    for t in [*line[a:b], Token("p", 0, "", True, False)]:
        if t.breaks:
            block = " ".join("".join(held).split())
            if block:
                blocks.append(block)
            held = []
        else:
            held.append(t.text)
    return "\n".join(blocks)


def learned(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> dict[str, float]:
    """``fit`` on the sample of ``FIT_PAGES`` pages, read by tasks; their tags and numbers of words are collected."""
    ids = [
        r[0] for r in pages.select(F.col(f"`{id_col}`").cast("long").alias("id")).where("id IS NOT NULL")
        .orderBy(F.xxhash64("id"), "id").limit(FIT_PAGES).collect()
    ]
    if not ids:
        return {}
    wanted = pages.sparkSession.createDataFrame([(i,) for i in ids], "wanted long")  # FIT_PAGES rows at most
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = pa.array([json.dumps(lines(t.as_py() or "")) for t in batch.column(1)], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), made], names=["id", "lines"])

    rows = (
        pages.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{html_col}`").cast("string").alias("html"))
        .join(F.broadcast(wanted), F.col("id") == F.col("wanted"), "left_semi")
        .groupBy("id").agg(F.min("html").alias("html"))
        .mapInArrow(run, "id long, lines string").collect()
    )
    return fit([tuple(json.loads(r["lines"])) for r in sorted(rows)])


def main_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", text_col: str = "main_text") -> DataFrame:
    """``pages`` with the main text of each whole page; a column of that name is replaced.

    Null and empty pages, and pages without words outside asides, give an empty text. Of equal
    stretches the first is returned. Rows are handled alone, so repeated ones get equal texts. Where no page marks an article
    the weights stay as they were before fitting.
    """
    weights = learned(pages, id_col, html_col)
    pages = pages.drop(text_col, "_html")
    names = [*pages.columns, text_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = pa.array([extract(t.as_py() or "", weights) for t in batch.column(batch.num_columns - 1)], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], made], names=names)

    schema = pages.withColumn(text_col, F.lit("")).schema
    return pages.withColumn("_html", F.col(f"`{html_col}`").cast("string")).mapInArrow(run, schema)
