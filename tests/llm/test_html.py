"""HTML extraction against a plain twin on random pages, and pages that are hard to read."""

import math
import random
import time

import numpy as np
import pytest

from tidewright.llm import html_text

BODY = "<h1>Title here</h1><p>One long enough paragraph of the article with words.</p><p>Short.</p>"
WANT = "Title here\n\nOne long enough paragraph of the article with words.\n\nShort."


# A plain twin: a page is a tree of [tag, class, children]; text leaves are strings.

INNER = {"ul", "li", "p", "blockquote", "h1"}
PROSE = {"p", "blockquote", "h1"}
READERS, NAMED = {"comments"}, {"comments", "ad", "sidebar"}


def render(node):
    if isinstance(node, str):
        return node
    tag, name, children = node
    inner = "".join(map(render, children))
    return f"<{tag}{f' class={name!r}' if name else ''}>{inner}</{tag}>"


def lines_of(tree):
    """[text, tags, link characters, path of (tag, name, number)] of every line."""
    out, now, number = [], {"data": [], "tags": 0, "links": 0}, [0]

    def flush(path):
        text = " ".join("".join(now["data"]).split())
        if text:
            out.append([text, now["tags"], min(now["links"], len(text)), path])
            now["tags"] = 0
        now["data"], now["links"] = [], 0

    def walk(node, path, linked):
        if isinstance(node, str):
            now["data"].append(node)
            now["links"] += len(node) if linked else 0
            return
        tag, name, children = node
        block = tag not in ("a", "b")
        inner = path
        if block:
            flush(path)
            number[0] += 1
            inner = path + ((tag, name, number[0]),)
        now["tags"] += 1
        for child in children:
            walk(child, inner, linked or tag == "a")
        now["tags"] += 1
        if block:  # the end tag counts for the line before it is cut
            flush(inner)

    walk(tree, (), False)
    return out


def plain_text(tree, cut=None):
    lines = lines_of(tree)
    never = lambda step: step[0] in ("nav", "aside", "footer")
    blocks = sorted({p[: k + 1] for *_, p in lines for k in range(len(p))}, key=lambda p: p[-1][2])
    within = lambda p, b: p[: len(b)] == b
    counted = [x for x in lines if not any(map(never, x[3]))]
    size = lambda b, shut: sum(len(t) for t, _, _, p in counted if within(p, b) and not any(within(p, s) for s in shut))
    named = [b for b in blocks if b[-1][1] in NAMED and not any(map(never, b))]
    real = [b for b in blocks if b[-1][0] in ("article", "main") and b[-1][1] not in NAMED and not any(map(never, b)) and size(b, [])]
    around = lambda b: [x for x in named if within(b, x)]
    if real:
        least = min(len(around(b)) for b in real)
        released = {x for b in real if len(around(b)) == least for x in around(b)}
    else:
        released, shut = set(), list(named)
        for b in named:
            if any(within(b, s) and s != b for s in shut):
                continue
            free = size((), shut)
            if size(b, []) > 10 * free and 2 * size(b, []) > size((), []) and (b[-1][1] not in READERS or not free):
                released.add(b)
                shut.remove(b)
    gone = [b for b in named if b not in released]
    out = lambda p: any(map(never, p)) or any(within(p, g) for g in gone)

    def part(line):
        _, _, _, p = line
        if out(p):
            return -1
        first = lambda tag: next((p[: k + 1] for k in range(len(p)) if p[k][0] == tag and not out(p[: k + 1])), None)
        main, article = first("main"), first("article")
        if main:
            has = any(b[-1][0] == "article" and within(b, main) and not out(b) for b in blocks)
            if article or not has or (p[-1][0] in PROSE and 2 * line[2] <= len(line[0])):
                return main
        return article or 0

    where = [part(x) for x in lines]
    articles = any(isinstance(w, tuple) for w in where)
    values = []
    for (text, tags, links, _), w in zip(lines, where):
        chars = 0 if w == -1 else len(text) - 0.9 * links
        values.append(math.log2(1 + (chars / 64 if w == 0 and articles else chars) / max(1, tags)))
    if not values or max(values) <= 0:
        return ""
    smoothed = []
    for w, _ in zip(where, values):
        k = len(smoothed)
        mine = [j for j in range(len(lines)) if where[j] == w]
        at = mine.index(k)
        near = [(math.exp(-0.5 * ((i - at) / 1.5) ** 2), values[j]) for i, j in enumerate(mine) if abs(i - at) <= 5]
        smoothed.append(sum(a * v for a, v in near) / sum(a for a, _ in near))
    border = html_text.threshold(np.array([*smoothed, 0.0])) if cut is None else cut
    marked = [s >= border for s in smoothed]
    linked = [2 * x[2] > len(x[0]) for x in lines]
    chosen = {w for w, m in zip(where, marked) if m and isinstance(w, tuple)}
    loose = [k for k, w in enumerate(where) if w == 0 and marked[k] and not linked[k]]
    keep = {k for k, w in enumerate(where) if w in chosen or (w == -1 and marked[k])} | set(loose)
    if loose and not articles:
        paths = [lines[k][3] for k in loose]
        top = ()
        for step in range(min(map(len, paths))):
            if len({p[step] for p in paths}) > 1:
                break
            top = paths[0][: step + 1]
        while top and top[-1][0] in INNER:
            top = top[:-1]
        page = not top or top[-1][0] in ("html", "body")
        for k, (_, _, _, p) in enumerate(lines):
            if where[k] != 0 or linked[k]:
                continue
            place = p
            while place and place[-1][0] in PROSE:
                place = place[:-1]
            if (within(p, top) and (not page or loose[0] < k < loose[-1])) or (p[-1][0] in PROSE and within(top, place)):
                keep.add(k)
    return "\n\n".join(lines[k][0] for k in sorted(keep))


def random_page(rng):
    def words(n):
        return " ".join(rng.choice(["word", "longer", "sentence", "of", "text,", "and"]) for _ in range(n)) + " "

    def inline():
        kind = rng.random()
        text = words(rng.choice([1, 3, 10, 60]))
        return text if kind < 0.7 else ["a" if kind < 0.9 else "b", "", [text]]

    def block(depth):
        tag = rng.choice(["p"] * 6 + ["h1", "blockquote"] + ["div", "section", "ul", "nav", "aside", "article", "main", "div"] * (depth < 4))
        if tag in ("p", "h1", "blockquote"):
            return [tag, "", [inline() for _ in range(rng.randint(1, 3))]]
        if tag == "ul":
            return [tag, "", [["li", "", [inline()]] for _ in range(rng.randint(1, 5))]]
        name = rng.choice(["", "", "", "comments", "ad", "sidebar", "story"])
        return [tag, name, [block(depth + 1) for _ in range(rng.randint(1, 5))]]

    return ["html", "", [["body", "", [block(0) for _ in range(rng.randint(1, 6))]]]]


@pytest.mark.parametrize("seed", range(8))
def test_text_equals_the_plain_twin(seed):
    rng = random.Random(seed)
    some = 0
    for _ in range(150):
        tree = random_page(rng)
        want = plain_text(tree)
        assert html_text.main_text(render(tree)) == want, render(tree)
        some += bool(want)
    assert some > 100


def test_the_threshold_chooses(monkeypatch):
    rng = random.Random(5)
    trees = [random_page(rng) for _ in range(200)]
    whole = [html_text.main_text(render(t)) for t in trees]
    for cut in (-math.inf, 4.0):
        monkeypatch.setattr(html_text, "threshold", lambda values, cut=cut: cut)
        other = [html_text.main_text(render(t)) for t in trees]
        assert other == [plain_text(t, cut) for t in trees]
        assert sum(a != b for a, b in zip(whole, other)) > 60


@pytest.mark.parametrize(
    "page",
    [
        f"<body><div class='site has-sidebar'><article>{BODY}</article></div>",
        f"<div class='page no-comments'>{BODY}</div>",
        f"<body><form id='aspnetForm'><nav>Menu</nav><div>{BODY}</div><footer>f</footer></form>",
        f"<body><form id='f'><nav>Menu</nav><article>{BODY}</article><div class=comments><article>A comment, long, long, long</article></div></form>",
        f"<article>{BODY}</article><article class='comment'>I am a reader and I have to say a lot of things about this</article>",
        f"<article>{BODY}<p class='cookie-notice'>Cookies cookies cookies</p><p hidden>hidden text</p></article>",
        f"<article>{BODY}<span class='ad'>Buy</span><span style='display: none'>not seen</span></article>",
        f"<article><button>Click {BODY}</article>",
        f"<article><div><select><option>One<option>Two</div>{BODY}</article>",
        f"<article><template><div>not shown</div></template>{BODY}<noscript><p>neither</p></article>",
        f"<article>{BODY}</article><!-- never <b>closed</b>",
        f"<article>{BODY}</article><div class='unclosed' title='",
        f"<body><div>An advert without a name, somewhat long</div><article>{BODY}</article><div>After it another line</div>",
        f"<main><h1>Title here</h1><article>{BODY[19:]}</article><div><ul><li><a href=x>Related story</a></ul></div></main>",
        f"<body><header><h1>Site</h1></header><article><header>{BODY[:19]}</header>{BODY[19:]}</article>",
    ],
)
def test_hard_pages(page):
    assert html_text.main_text(page) == WANT


def test_names_that_only_hold_a_word():
    page = f"<article>{BODY}<div class='share-price-table'>Prices</div><div id='search-engines'>Engines</div></article>"
    assert html_text.main_text(page) == f"{WANT}\n\nPrices\n\nEngines"


def test_every_article_counts():
    assert html_text.main_text(f"<article>{BODY * 4}</article><article><p>Second one.</p></article>").endswith("Short.\n\nSecond one.")


def test_pages_without_article_text():
    for page in ("<nav>Menu</nav>", "<footer>Foot</footer><aside>Beside</aside>", "<p hidden>x</p>", "<button>x"):
        assert html_text.main_text(page) == ""


@pytest.mark.parametrize("make", [
    lambda n: "<div>" * n + "deep" + "</div>" * n,
    lambda n: "<div class=sidebar>" * n + "deep",
    lambda n: "<section><b>" * n + "</p></i></section>a" * n,
    lambda n: "<ul>" + "<li><div>x" * n,
    lambda n: "<p>a<a>b" * n,
    lambda n: "<div><p>some words of text</p>" * n,
])
def test_time_in_proportion_to_the_page(make):
    took = []
    for n in (2000, 16000):
        began = time.process_time()
        html_text.main_text(make(n))
        took.append(time.process_time() - began)
    assert took[1] < 30 * took[0] + 0.5
