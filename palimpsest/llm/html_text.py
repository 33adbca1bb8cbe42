"""HTML extraction by tag-path ratios.

A page is read as a sequence of text blocks, each with its path of labels (tag and class)
from the root.  For every path the text length and the punctuation per block are summed up.
Both ratios are smoothed along the page, fused, and averaged by path; links and what the
labels say of a path (its evidence) scale the result.  Paths that reach a share of the page's
typical value are the article's, and their blocks are the text.  A block between two of them
comes along unless its labels or links speak against it.

Labels alone decide nothing: evidence is a factor, which a path of long, punctuated text can
outweigh, as one of short text is dropped without any telling label.
"""

from __future__ import annotations

import html as entities
import re
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from .common import map_rows

# Element names by their part in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template svg iframe object textarea title math canvas".split())
BOILER = frozenset("nav footer aside form button select menu dialog head fieldset label option".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup "
    "time tt u var wbr br img input".split()
)
MAIN = frozenset("article main".split())
#: Opening one of the keys ends an open element named in its value.
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}
} | {t: {"p"} for t in "p div ul ol dl table section article aside nav header footer main form h1 h2 h3 h4 h5 h6 blockquote pre hr figure".split()}
SCOPE = frozenset("div td th article section aside nav header footer main body html ul ol dl table blockquote".split())
#: What a label does to the value of a path: boiler elements and names, names that may mean either, article elements.
BOILER_FACTOR, HINT_FACTOR, WEAK_FACTOR, MAIN_FACTOR = 0.01, 0.01, 0.5, 2.0
# Words in names of classes and ids.
HINT_WORDS = frozenset(
    "nav navbar navigation menu menubar foot footer sidebar sidebars ad ads adv advert adverts advertisement adbox banner banners sponsor sponsors "
    "sponsored promo promos promotion cookie cookies consent notice notices notification alert comment comments commentlist disqus replies respond "
    "social breadcrumb breadcrumbs subscribe newsletter popup modal overlay pagination pager masthead topbar signup login toolbar hidden".split()
)
WEAK_WORDS = frozenset("side reply share sharing related recommend recommended widget widgets skip copyright search tag tags byline meta".split())
NEUTRAL_WORDS = frozenset(
    "a b box bar list item items wrap wrapper container area section block inner outer top left right bottom main site page content text top global "
    "primary secondary first last col column panel header head body thread form links link text small large big the and of to".split()
)
NAME_WORD = re.compile(r"[a-z]+")
BOILER_ROLE = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar".split())
TOKEN = re.compile(
    r"<!--.*?(?:-->|$)|<![^>]*>|<\?[^>]*>|</([a-zA-Z][^\s/>]*+)[^>]*+>|<([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|[^<]++|<", re.S
)
TAIL = re.compile(r"()()()(?:(?:[^<]|<(?![a-zA-Z/!?]))++|<.*)", re.S)
ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
PUNCTUATION = re.compile(r"[.,;:!?…。，、！？]")
SIGMA, REACH = 1.0, 2
#: A path is the article's if its value is at least this share of the typical one, and at least the least value.
THRESHOLD = 0.25
LEAST_VALUE = 1.0
#: A block between selected ones needs this evidence, and no more than this share of linked text.
GAP_EVIDENCE, GAP_LINKED = 0.1, 0.5


@dataclass(slots=True)
class Path:
    """A root-to-leaf path, as its parent path and one more label; ``evidence`` is the product of its labels' factors."""

    parent: int
    label: str
    evidence: float
    main: bool


@dataclass(slots=True)
class Node:
    """A text block: what stands between two block tags."""

    path: int
    pieces: list[str] = field(default_factory=list)
    linked: int = 0


def name_factor(value: str) -> float:
    """The factor of a class or id: the least of its names'.

    A name made of hint words, with neutral ones or digits, is a hint; one of weak words, or
    with a hint word beside other words (``meta-analysis``, ``ad-hoc``), is a weak one.
    """
    least = 1.0
    for name in value.split():
        words = set(NAME_WORD.findall(re.sub(r"([a-z])([A-Z])", r"\1-\2", name).lower()))
        if words & HINT_WORDS:
            least = min(least, HINT_FACTOR if words <= HINT_WORDS | WEAK_WORDS | NEUTRAL_WORDS else WEAK_FACTOR)
        elif words & WEAK_WORDS:
            least = min(least, WEAK_FACTOR)
    return least


def label_of(tag: str, attributes: str, inside_main: bool) -> tuple[str, float]:
    """(label, factor) of an element.  ``header`` is boiler only outside of the article."""
    label, factor = tag, MAIN_FACTOR if tag in MAIN else 1.0
    if tag in BOILER or tag == "header" and not inside_main:
        factor = BOILER_FACTOR
    if attributes and not attributes.isspace():
        for a in ATTRIBUTE.finditer(attributes):
            name, value = a[1].lower(), a[2] or a[3] or a[4] or ""
            if name in ("class", "id") and value:
                label += "." + " ".join(value.split()) if name == "class" else ""  # ids would set every element apart
                if tag not in MAIN and tag not in ("body", "html"):
                    factor = min(factor, name_factor(value))
            elif (
                name == "role" and value.lower() in BOILER_ROLE
                or name == "hidden"
                or name == "aria-hidden" and value == "true"
                or name == "style" and "display:none" in value.replace(" ", "").lower()
            ):
                factor = min(factor, BOILER_FACTOR)
    return label, factor


class _Stack:
    """Open elements with their paths; finds an open tag within its scope in one step, however deep the page."""

    def __init__(self) -> None:
        self.tags, self.paths = [""], [0]
        self.places: dict[str, list[int]] = {}
        self.scopes = [0]

    def push(self, tag: str, path: int) -> None:
        self.places.setdefault(tag, []).append(len(self.tags))
        if tag in SCOPE:
            self.scopes.append(len(self.tags))
        self.tags.append(tag)
        self.paths.append(path)

    def cut(self, tag: str, scoped: bool) -> None:
        """End the innermost open ``tag`` and all in it; with ``scoped`` only if no other scope element is between."""
        places = self.places.get(tag)
        if not places or scoped and places[-1] < self.scopes[-1]:
            return
        k = places[-1]
        while len(self.tags) > k:
            t = self.tags.pop()
            self.paths.pop()
            self.places[t].pop()
            if t in SCOPE:
                self.scopes.pop()


def parse(page: str) -> tuple[list[Path], list[Node]]:
    """The paths and the text blocks in page order.  Never fails on broken markup.

    A path is kept once, as its parent and a label, so that deep pages take memory in
    proportion to their length.
    """
    paths = [Path(-1, "", 1.0, False)]
    known: dict[tuple[int, str, float], int] = {}
    stack, nodes = _Stack(), []
    current: Node | None = None
    anchors, at, size = 0, 0, len(page)
    last = page.rfind(">")
    while at < size:
        # Behind the last ">" there is text, up to a tag or comment that does not end.
        m = TOKEN.match(page, at) if at <= last else TAIL.match(page, at)
        if m is None:
            at += 1
            continue
        at = m.end()
        closing, opening = m[1], m[2]
        if opening:
            tag = opening.lower()
            if tag == "br":
                if current:
                    current.pieces.append(" ")
                continue
            attributes = m[3]
            if tag in RAW and not attributes.rstrip().endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(page, at)
                at = end.end() if end else size
                continue
            if tag in INLINE:
                anchors += tag == "a"
                continue
            current = None
            for other in CLOSES.get(tag, ()):
                stack.cut(other, scoped=True)
            if tag in VOID or attributes.rstrip().endswith("/"):
                continue
            up = stack.paths[-1]
            label, factor = label_of(tag, attributes, paths[up].main)
            path = known.get((up, label, factor))
            if path is None:
                path = known[up, label, factor] = len(paths)
                paths.append(Path(up, label, max(paths[up].evidence * factor, 1e-12), paths[up].main or tag in MAIN))
            stack.push(tag, path)
        elif closing:
            tag = closing.lower()
            if tag in INLINE:
                anchors -= tag == "a" and anchors > 0
                continue
            current = None
            stack.cut(tag, scoped=tag == "p")
        else:
            text = m[0]
            if re.match("<[a-zA-Z/!?]", text):  # a comment, a declaration or an open tag
                continue
            if current is None:
                if text.isspace():
                    continue
                current = Node(stack.paths[-1])
                nodes.append(current)
            decoded = entities.unescape(text)
            current.pieces.append(decoded)
            if anchors:
                current.linked += len(decoded)
    return paths, nodes


def smoothed(values: np.ndarray) -> np.ndarray:
    """Gaussian means over ``REACH`` blocks to either side; at the ends over those that are there."""
    kernel = np.exp(-0.5 * (np.arange(-REACH, REACH + 1) / SIGMA) ** 2)
    cut = slice(REACH, REACH + len(values))
    return np.convolve(values, kernel)[cut] / np.convolve(np.ones(len(values)), kernel)[cut]


def path_values(own: np.ndarray, chars: np.ndarray, points: np.ndarray, linked: np.ndarray, evidence: np.ndarray) -> np.ndarray:
    """The fused value of each path (numbers 0 to ``len(evidence)`` - 1), from the blocks' paths and counts.

    Text and punctuation per block of a path, both smoothed along the page, are fused by
    their geometric mean, averaged by path, and scaled by the unlinked share and the evidence.
    """
    k = len(evidence)
    n = np.maximum(np.bincount(own, minlength=k), 1)
    mean = lambda x: np.bincount(own, weights=x, minlength=k) / n
    text, punctuation = smoothed(mean(chars)[own]), smoothed(mean(points)[own])
    fused = mean(np.sqrt(text * (1 + punctuation)))
    unlinked = 1 - np.minimum(1, mean(linked) / np.maximum(mean(chars), 1))
    return fused * unlinked * evidence


def extract(page: str | None, threshold: float | None = None) -> list[str]:
    """The article's text blocks in page order; none for a null, empty or textless page.

    ``threshold`` stands for ``THRESHOLD``.  The typical value is the mean over the blocks,
    weighted by their text and value.
    """
    threshold = THRESHOLD if threshold is None else threshold
    paths, nodes = parse(page or "")
    pairs = [(n, t) for n in nodes if (t := " ".join("".join(n.pieces).split()))]
    if not pairs:
        return []
    texts = [t for _, t in pairs]
    used, own = np.unique([n.path for n, _ in pairs], return_inverse=True)
    chars = np.array([len(t) for t in texts], float)
    points = np.array([len(PUNCTUATION.findall(t)) for t in texts], float)
    linked = np.minimum(np.array([n.linked for n, _ in pairs], float), chars)
    evidence = np.array([paths[p].evidence for p in used])
    value = path_values(own, chars, points, linked, evidence)
    weight = chars * value[own]
    typical = float((weight * value[own]).sum() / weight.sum()) if weight.any() else 0.0
    selected = (value >= threshold * typical) & (value >= LEAST_VALUE)
    taken = selected[own]
    if taken.any():
        first, last = np.flatnonzero(taken)[[0, -1]]
        between = (evidence[own] >= GAP_EVIDENCE) & (linked <= GAP_LINKED * chars)
        taken[first : last + 1] |= between[first : last + 1]
    return [t for t, x in zip(texts, taken) if x]


def main_text(page: str | None) -> str:
    return "\n\n".join(extract(page))


def extract_pages(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """``pages`` with ``text`` and ``n_chars`` in place of the markup; one row for each input row.

    A null page counts as empty and gives an empty text.  Input columns named like new ones
    are replaced.  Pages are independent: no shuffle.
    """
    work = lambda pages: [(t, len(t)) for t in map(main_text, pages)]
    return map_rows(pages, [html_col], lambda: work, "text string, n_chars long", drop=(html_col,))


def pages_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
