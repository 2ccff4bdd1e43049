"""Main text of web pages as a maximum-scoring subsequence of words and tags.

A page is read as one sequence of words and tags. Words score positive and tags negative, with weights from labelled
pages (``data/labelled_pages.txt``, a parameter); a linear scan finds the contiguous region of the largest score, and its
text blocks are the result. What is learned:

* a tag costs its log-odds of standing outside main text, by its name and by where it stands (see below);
* a word scores its log-odds of being main text, by where it stands: in an element that holds main text, on a page
  without any such element, or beside one;
* an element speaks for or against main text by the log-odds of its evidence: sectioning and form element names, and the
  words of its class, id and role (the last part of a hyphenated word, its head, counts in full, the others by half).
  An element against it scores as one strongly negative tag, its words not at all; where the region runs over it, it is
  left out of the text.

Weak evidence against an element doesn't hold if most of it is in an element that speaks for main text, or if next to no
words of the page would be left (a form or a "menu-open" layout around the whole page).

Reading is linear in the page's length: every search either moves on or ends the page, end tags are matched by the last
open place of their name, and each open element is closed once.

Defined results: null or empty html, or a page whose words all lie in elements strongly against main text, gives empty
text; unclosed and stray tags are allowed, an open element ends with the parent it stands in, and markup cut off by the
page's end is dropped as browsers do; ties go to the first region; repeated rows are read each by itself; null ids and
urls pass through; pages of any length are read whole; an empty table gives no rows; other columns aren't read.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache
from importlib import resources

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>=]*+(?:=(?:\s*+\"[^\"]*+\"|\s*+'[^']*+')?+[^>=]*+)*+)>")
_ATTRIBUTE = re.compile(r"(?<![^\s\"'/])(class|id|role)\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]++))", re.I)
_MARKUP = re.compile(r"<(?=[a-zA-Z/!?])")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_PART = re.compile(r"[^a-z]+")
_MARK = re.compile(r"(\[\[|\]\])")

# Fixed values of the HTML standard.
#: Text-level elements: they don't end a block.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q ruby rb rp rt s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements without content.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content isn't markup.
RAW = frozenset("script style textarea title iframe noframes noembed xmp".split())
#: Controls and embedded content: no flow text inside.
EMBEDDED = frozenset("button select datalist noscript template svg math canvas object video audio".split())
#: Sectioning, landmark and form elements: the names that say something about what is inside.
SECTIONING = frozenset("nav header footer aside form fieldset dialog menu article main".split())
#: What an open element's start tag closes.
ENDS = {"p": frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()), "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}
#: An end tag of one of LOOSE that was opened outside one of these doesn't close it.
BARRIERS = frozenset("article main td body".split())
LOOSE = frozenset("p div span li a b i".split())

#: Log-odds: an element against main text; one so strongly that nothing lifts it; one that holds main text.
AGAINST, CERTAIN, HOLDS = -1.1, -2.15, 1.0
#: Fewer words than this are next to none.
FEW = 10
#: What a word of the best place scores; costs are in such words. A tag costs MIN_COST at least, an element against main
#: text MIN_LUMP.
MIN_COST, MIN_LUMP, UNSEEN = 0.03, 0.5, -0.3

_TEXT, _OPEN, _CLOSE = range(3)


@dataclass
class Page:
    """The items of a page in order, and its elements: (parent, name, evidence), each parent before its children."""

    items: list[tuple[int, str, int]] = field(default_factory=list)  # kind, text or name, element
    parent: list[int] = field(default_factory=lambda: [-1])
    name: list[str] = field(default_factory=lambda: ["html"])
    evidence: list[tuple[tuple[str, float], ...]] = field(default_factory=lambda: [()])


@cache
def _words(name: str, attributes: str, inside: bool) -> tuple[tuple[str, float], ...]:
    out = {}
    if name in SECTIONING:
        out[f"{name}@{'in' if inside and name in ('header', 'footer', 'form') else ''}"] = 1.0
    for m in _ATTRIBUTE.finditer(attributes):
        for token in (m[2] or m[3] or m[4] or "").split():
            parts = [p for p in _PART.split(_CAMEL.sub("-", token).lower()) if p]
            for k, p in enumerate(parts):
                out[p] = max(out.get(p, 0.0), 1.0 if k == len(parts) - 1 else 0.5)
    return tuple(out.items())


def evidence(name: str, attributes: str, inside: bool) -> tuple[tuple[str, float], ...]:
    """What an element's tag says, each with how much it counts."""
    if name not in SECTIONING and "=" not in attributes:
        return ()
    return _words(name, attributes, inside) if len(attributes) < 120 else _words.__wrapped__(name, attributes, inside)


def parse(page: str) -> Page:
    out = Page()
    items, parent, names, found = out.items, out.parent, out.name, out.evidence
    open_: list[int] = []  # elements, the root not counted
    depth_of: dict[str, list[int]] = {}  # by name, where it is open
    blocks: list[int] = []  # where an element that isn't text-level is open
    barriers: list[int] = []
    articles = 0

    def close(depth: int) -> None:
        nonlocal articles
        while len(open_) > depth:
            name = names[open_.pop()]
            depth_of[name].pop()
            if name not in INLINE:
                blocks.pop()
            if name in BARRIERS:
                barriers.pop()
                articles -= name in ("article", "main")

    at, size = 0, len(page)
    while at < size:
        here = open_[-1] if open_ else 0
        m = _MARKUP.search(page, at)
        if m is None:
            items.append((_TEXT, page[at:], here))
            break
        lt = m.start()
        if lt > at:
            items.append((_TEXT, page[at:lt], here))
        c = page[lt + 1]
        if c in ("!", "?") or (c == "/" and not (page[lt + 2 : lt + 3].isascii() and page[lt + 2 : lt + 3].isalpha())):
            if page.startswith("<!--", lt):
                end = lt + 4 if page.startswith(">", lt + 4) else page.find("-->", lt + 4)
                end = end + 1 if end == lt + 4 else end + 3 if end >= 0 else size
            else:
                end = page.find(">", lt) + 1 or size
            at = end
            continue
        m = _TAG.match(page, lt)
        if m is None:
            break  # a tag without an end takes the rest of the page
        at, name, attributes = m.end(), m[2].lower(), m[3]
        if m[1]:
            depth = depth_of[name][-1] if depth_of.get(name) else None
            if depth is not None and name in LOOSE and barriers and barriers[-1] > depth:
                depth = None
            if depth is not None:
                close(depth)
            items.append((_CLOSE, name, open_[-1] if open_ else 0))
            continue
        if blocks and name in ENDS.get(names[open_[blocks[-1]]], ()):
            close(blocks[-1])
        here = open_[-1] if open_ else 0
        if name in RAW:
            if not attributes.endswith("/"):
                end = _end(name).search(page, at)
                if end is None:
                    break
                at = page.find(">", end.end()) + 1 or size
            items.append((_CLOSE, name, here))
            continue
        own = len(names)
        names.append(name)
        parent.append(here)
        found.append(evidence(name, attributes, articles > 0))
        items.append((_OPEN, name, own))
        if name not in VOID and not attributes.endswith("/"):
            depth_of.setdefault(name, []).append(len(open_))
            if name not in INLINE:
                blocks.append(len(open_))
            if name in BARRIERS:
                barriers.append(len(open_))
                articles += name in ("article", "main")
            open_.append(own)
    return out


@cache
def _end(name: str) -> re.Pattern:
    return re.compile(rf"</{name}(?=[\s/>])", re.I)


@dataclass
class Weights:
    """against and holds: log-odds by evidence; word: by place; tag: by name and place; lump: cost of an element against
    main text, outside and inside an element that holds main text."""

    against: dict[str, float] = field(default_factory=dict)
    holds: dict[str, float] = field(default_factory=dict)
    word: dict[str, float] = field(default_factory=dict)
    tag: dict[str, float] = field(default_factory=dict)
    lump: dict[bool, float] = field(default_factory=dict)

    def judged(self, page: Page) -> tuple[list[bool], list[bool], bool]:
        """For each element, whether it is (in) one against main text and whether it is in one that holds main text; and
        whether any holds some."""
        n = len(page.name)
        odds, holder = [0.0] * n, [False] * n
        for e in range(1, n):
            if page.name[e] in EMBEDDED:
                odds[e] = -math.inf
            elif page.evidence[e]:
                odds[e] = sum(w * self.against.get(x, 0.0) for x, w in page.evidence[e])
                holder[e] = odds[e] > AGAINST and any(w == 1.0 and self.holds.get(x, -1.0) >= HOLDS for x, w in page.evidence[e])
        self._innermost(page, holder)
        sure = [False] * n  # in an element strongly against main text
        weak = [AGAINST >= o > CERTAIN for o in odds]
        inside, words = [False] * n, [0] * n
        for e in range(1, n):
            sure[e] = sure[page.parent[e]] or odds[e] <= CERTAIN
            inside[e] = not sure[e] and (holder[e] or (inside[page.parent[e]] and not weak[e]))
        for kind, text, e in page.items:
            if kind == _TEXT and not sure[e]:
                words[e] += len(text.split())
        held, good = list(words), [w * i for w, i in zip(words, inside)]
        for e in range(n - 1, 0, -1):
            held[page.parent[e]] += held[e]
            good[page.parent[e]] += good[e]
        for e in range(1, n):
            if weak[e] and not sure[e] and good[e] * 2 >= held[e] > 0:
                weak[e] = False

        # what is left: words in no element against main text; with next to none, the large weak ones fall from outside in
        def nearest() -> list[int]:
            near = [0] * n
            for e in range(1, n):
                near[e] = near[page.parent[e]] or (e if weak[e] or odds[e] <= CERTAIN else 0)
            return near

        near = nearest()
        left = sum(w for e, w in enumerate(words) if not near[e])
        if left < FEW and held[0] > left:
            own = [0] * n  # words by their innermost weak element
            inner = [0] * n
            for e in range(1, n):
                inner[e] = e if weak[e] and not sure[e] else inner[page.parent[e]]
                own[inner[e]] += words[e]
            for e in range(1, n):
                if weak[e] and not sure[e] and 2 * held[e] > held[0]:
                    weak[e] = False
                    left += own[e]
                    if left >= FEW:
                        break
            near = nearest()
        inside = [False] * n
        for e in range(1, n):
            inside[e] = not near[e] and (inside[page.parent[e]] or holder[e])
        return [x > 0 for x in near], inside, any(inside)


    @staticmethod
    def _innermost(page: Page, holder: list[bool]) -> None:
        """Where most words of a main element are in one article, the article holds the main text, and not what is beside it."""
        n = len(page.name)
        words = [0] * n
        for kind, text, e in page.items:
            if kind == _TEXT:
                words[e] += len(text.split())
        for e in range(n - 1, 0, -1):
            words[page.parent[e]] += words[e]
        above = [0] * n  # the innermost main element around an element
        for e in range(1, n):
            above[e] = page.parent[e] if page.name[page.parent[e]] == "main" else above[page.parent[e]]
            if page.name[e] == "article" and holder[e] and 2 * words[e] >= words[above[e]]:
                holder[above[e]] = False


def sequence(page: str, weights: Weights) -> Iterator[tuple[str, str, str]]:
    """(kind, text or name, place): "text" and "tag" of main kind, "out" and "in" where an element against main text
    stands, the latter inside one that holds main text. What is inside elements against it doesn't appear."""
    parsed = parse(page)
    bad, inside, any_ = weights.judged(parsed)
    for kind, what, e in parsed.items:
        up = parsed.parent[e] if kind == _OPEN else e
        place = "held" if inside[e] or (up > 0 and inside[up]) else "beside" if any_ else "free"
        if kind == _OPEN and bad[e] and not (up >= 0 and bad[up]):
            yield "in" if up > 0 and inside[up] else "out", what, place
        elif not bad[e]:
            yield "text" if kind == _TEXT else "tag", what if kind != _CLOSE else "/" + what, place


def labelled_pages(held_out: bool = False) -> list[str]:
    """The pages of the data file, main text between [[ and ]]: those to learn from, or every fourth one, held out."""
    lines = [x for x in resources.files("sigmill.llm").joinpath("data/labelled_pages.txt").read_text("utf-8").splitlines() if x and not x.startswith("#")]
    return [x for k, x in enumerate(lines) if (k % 4 == 3) == held_out]


def learn(pages: list[str]) -> Weights:
    """Weights from pages with [[ and ]] around their main text, in one or more pieces."""
    main, part, away = Counter(), Counter(), Counter()
    for page in pages:
        parsed = parse(page)
        n = len(parsed.name)
        inner, outer, within = [0] * n, [0] * n, False
        for kind, text, e in parsed.items:
            for piece in _MARK.split(text) if kind == _TEXT else ():
                if piece in ("[[", "]]"):
                    within = piece == "[["
                elif piece:
                    (inner if within else outer)[e] += len(piece.split())
        for e in range(n - 1, 0, -1):
            inner[parsed.parent[e]] += inner[e]
            outer[parsed.parent[e]] += outer[e]
        for e in range(1, n):
            for x, w in parsed.evidence[e]:
                if not inner[e]:
                    away[x] += w
                elif inner[e] >= 0.6 * inner[0] and outer[e] <= 0.3 * inner[e]:
                    main[x] += w
                else:  # a part of main text, or far more than it
                    part[x] += 1.0 if not outer[e] else w / 2
    every = {*main, *part, *away}
    out = Weights(
        {x: math.log((main[x] + part[x] + 0.5) / (away[x] + 0.5)) for x in every},
        {x: math.log((main[x] + 0.5) / (away[x] + part[x] + 0.5)) for x in every},
    )
    words = {True: Counter(), False: Counter()}
    tags = {True: Counter(), False: Counter()}
    lumps = {True: Counter(), False: Counter()}
    for page in pages:
        within, left = False, page.count("]]")  # tags and elements between the pieces of main text are inside it
        first = left
        for kind, what, place in sequence(page, out):
            if kind == "text":
                for piece in _MARK.split(what):
                    if piece in ("[[", "]]"):
                        within, left = piece == "[[", left - (piece == "]]")
                    else:
                        words[within][place] += len(piece.split())
            else:
                (tags if kind == "tag" else lumps)[within or 0 < left < first][(what.lstrip("/"), place) if kind == "tag" else kind == "in"] += 1
    odds = lambda c, x: math.log((c[True][x] + 0.5) / (c[False][x] + 0.5))
    best = max([odds(words, p) for p in ("held", "beside", "free")] + [1.0])
    out.word = {p: odds(words, p) / best for p in ("held", "beside", "free")}
    out.word["free"] = max(out.word["free"], 0.25)  # with nothing to go by, words are for and tags against
    out.tag = {f"{name} {place}": min(-MIN_COST, odds(tags, (name, place)) / best) for name, place in {*tags[True], *tags[False]}}
    out.lump = {x: min(-MIN_LUMP, 2 * odds(lumps, x) / best) for x in (True, False)}  # both its tags
    return out


@cache
def default_weights() -> Weights:
    return learn(labelled_pages())


def score(kind: str, what: str, place: str, weights: Weights) -> float:
    if kind == "text":
        return weights.word[place] * len(what.split())
    if kind == "tag":
        return weights.tag.get(f"{what.lstrip('/')} {place}", UNSEEN if place != "held" else -MIN_COST)
    return weights.lump[kind == "in"]


def region(scores: list[float]) -> tuple[int, int]:
    """First and end of the best contiguous part: one pass, keeping the best sum that ends at each item."""
    best, first, end, total, start = 0.0, 0, 0, 0.0, 0
    for i, x in enumerate(scores):
        total += x
        if total <= 0:
            total, start = 0.0, i + 1
        elif total > best:
            best, first, end = total, start, i + 1
    return first, end


def main_text(page: str | None, weights: Weights | None = None) -> str:
    if not page:
        return ""
    weights = weights or default_weights()
    items = list(sequence(page, weights))
    first, end = region([score(*x, weights) for x in items])
    blocks, own = [], []
    for kind, what, _ in [*items[first:end], ("tag", "div", "")]:
        if kind == "text":
            own.append(what)
        elif what == "br":
            own.append(" ")
        elif what.lstrip("/") not in INLINE:
            block = " ".join(entities.unescape("".join(own)).split())
            if block:
                blocks.append(block)
            own = []
    return "\n\n".join(blocks)


def extract(pages: DataFrame, weights: Weights | None = None, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, text and n_chars for each page row."""
    df = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("_html"))
    weights = weights or default_weights()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 256):
                part = b.slice(k, 256)
                text = [main_text(x.as_py(), weights) for x in part.column("_html")]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(text, pa.string()), pa.array([len(x) for x in text], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    return df.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars bigint")


def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sigmill.llm.workspace import table

    return extract(table(spark, sf_dir, "pages"))
