"""HTML extraction: the method against a plain version of it, and pages on which the ratios decide."""

from __future__ import annotations

import math
import random

import pyarrow.parquet as pq
import pytest

from palimpsest.llm import html_text
from tests.conftest import SF

PROSE = "The committee met again on Tuesday, heard the report, and agreed to publish it; nobody objected. The next meeting, they said, is in May."


def _plain(page, threshold):
    """Paths as whole strings, sums by loops, smoothing by its definition."""
    paths, nodes = html_text.parse(page)
    rows = []
    for n in nodes:
        text = " ".join("".join(n.pieces).split())
        if text:
            path, k = "", n.path
            while k > 0:
                path, k = f"/{paths[k].label}{paths[k].evidence}{path}", paths[k].parent
            rows.append((path, text, min(n.linked, len(text)), paths[n.path].evidence))
    if not rows:
        return []
    of = lambda path: [r for r in rows if r[0] == path]
    chars = {p: sum(len(r[1]) for r in of(p)) / len(of(p)) for p in {r[0] for r in rows}}
    points = {p: sum(len(html_text.PUNCTUATION.findall(r[1])) for r in of(p)) / len(of(p)) for p in chars}

    def smooth(ratio, k):
        near = [(math.exp(-0.5 * ((j - k) / html_text.SIGMA) ** 2), ratio[rows[j][0]]) for j in range(max(0, k - html_text.REACH), min(len(rows), k + html_text.REACH + 1))]
        return sum(w * x for w, x in near) / sum(w for w, _ in near)

    fused = [math.sqrt(smooth(chars, k) * (1 + smooth(points, k))) for k in range(len(rows))]
    value = {}
    for p in chars:
        mine = [k for k in range(len(rows)) if rows[k][0] == p]
        links = sum(rows[k][2] for k in mine) / len(mine) / max(chars[p], 1)
        value[p] = sum(fused[k] for k in mine) / len(mine) * (1 - min(1, links)) * rows[mine[0]][3]
    weight = [len(r[1]) * value[r[0]] for r in rows]
    typical = sum(w * value[r[0]] for w, r in zip(weight, rows)) / sum(weight) if any(weight) else 0.0
    taken = [value[r[0]] >= threshold * typical and value[r[0]] >= html_text.LEAST_VALUE for r in rows]
    chosen = [k for k, t in enumerate(taken) if t]
    for k, (_, text, linked, evidence) in enumerate(rows):
        if chosen and chosen[0] < k < chosen[-1] and evidence >= html_text.GAP_EVIDENCE and linked <= html_text.GAP_LINKED * len(text):
            taken[k] = True
    return [r[1] for r, t in zip(rows, taken) if t]


def _made(r: random.Random) -> str:
    out = []
    for _ in range(r.randrange(1, 14)):
        tag, cls = r.choice(["p", "div", "li", "h2", "td", "section"]), r.choice(["", "", ' class="ad"', ' class="lead"', ' class="meta-analysis"', ' id="comments"', " hidden"])
        text = " ".join(r.choice(["one", "two,", "three.", "four", "<a href=x>five six</a>", "&amp;", "<b>bold</b>"]) for _ in range(r.randrange(0, 40)))
        out.append(r.choice([f"<{tag}{cls}>{text}</{tag}>", f"<{tag}{cls}>{text}", f"<div><{tag}{cls}>{text}</{tag}></div>", f"<article><{tag}{cls}>{text}</article>"]))
    return "".join(out)


def test_agrees_with_the_plain_version():
    r = random.Random(5)
    pages = pq.read_table(f"{SF}/pages.parquet", columns=["html"])["html"].to_pylist() + [_made(r) for _ in range(300)]
    changed = 0
    for page in pages:
        for threshold in (0.0, 0.25, 0.6):
            assert html_text.extract(page, threshold) == _plain(page, threshold)
        changed += html_text.extract(page, 0.25) != html_text.extract(page, 0.6)
    assert changed > 20


def test_ratios_decide_without_any_label():
    """No class, id, role or telling tag: text and punctuation per path tell the article from the rest."""
    menu = "".join(f"<div><div>Item {k}</div></div>" for k in range(6))
    page = f"<body>{menu}<div><div><div>{'</div><div>'.join([PROSE] * 5)}</div></div></div>{menu}</body>"
    assert html_text.extract(page) == [PROSE] * 5
    assert len(html_text.extract(page, 0.0)) == 17 and html_text.extract(page, 1.5) == []


@pytest.mark.parametrize("attribute", ['class="meta-analysis"', 'class="side"', 'class="tag"', 'class="reply-brief"', 'id="search-results"', 'class="ad-hoc"'])
def test_prose_outweighs_names_that_may_mean_either(attribute):
    page = f"<nav><a href=x>Home</a></nav><article><h1>Title</h1><p>{PROSE}</p><div {attribute}>{PROSE}</div><p>{PROSE}</p><div {attribute}>{PROSE}</div></article>"
    assert html_text.extract(page) == ["Title", PROSE, PROSE, PROSE, PROSE]


@pytest.mark.parametrize("attribute", ['class="comments"', 'class="comment-list"', 'id="cookieNotice"', 'class="ad-box left"', 'class="sidebar"', 'role="alert"', "hidden"])
def test_labels_that_mean_one_thing(attribute):
    page = f"<body><div {attribute}><p>{PROSE}</p></div><div><h1>Title</h1><p>{PROSE}</p><div {attribute}>{PROSE}</div><p>Short.</p></div><div {attribute}>{PROSE}</div></body>"
    assert html_text.extract(page) == ["Title", PROSE, "Short."]


def test_lists_and_tables_between_paragraphs_stay():
    cells = "<table><tr><td>1</td><td>22</td></tr><tr><td>3</td><td>4</td></tr></table>"
    page = f"<article><h1>Title</h1><p>{PROSE}</p><h2>Part</h2><ul><li>one</li><li>two</li></ul>{cells}<p>{PROSE}</p></article><footer>{PROSE}</footer>"
    assert html_text.extract(page) == ["Title", PROSE, "Part", "one", "two", "1", "22", "3", "4", PROSE]


def test_deep_pages():
    deep = 100_000
    for page in ("<x>" * deep + "here" + "</x>" * deep, '<div class="c">' * deep + "here", "<x>" * deep + "<p>here</y>" * 10):
        assert set(html_text.extract(page)) == {"here"}
