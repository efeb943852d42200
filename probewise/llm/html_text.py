"""Main text of web pages by a linear-chain conditional random field over DOM leaf blocks.

A page becomes the sequence of its leaf blocks: runs of text between block-level tags. Features of a
block are its ancestors' tags, the words of their classes and ids, and the text's own shape. The chain
has two labels, text of the article or not; weights are trained on labelled pages and Viterbi decodes.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from random import Random

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Tag names, by the HTML standard.
BLOCK = set(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset"
    " figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup"
    " option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
REGION = set("article aside footer form header main nav section".split())
UNSEEN = set("script style title noscript template iframe object textarea svg math canvas noembed noframes".split())
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
}
ENDS_P = BLOCK - {"option", "optgroup", "button", "body", "html", "caption", "tbody", "td", "tfoot", "th", "thead", "tr", "legend", "select"}
P_SCOPE = {"button", "table", "td", "th", "caption", "html", "body", "article", "section", "div", "main", "aside", "nav", "footer", "header", "form", "li", "blockquote"}

_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/<>]*)((?:[^<>"']++|"[^"<]*"|'[^'<]*')*+)>|<(/?)([a-zA-Z][^\s/<>]*)([^<>]*)>""")
_OPEN = re.compile(r"<(?=[a-zA-Z/!?])")
_NAMED = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


@dataclass
class Block:
    ancestors: list[tuple[str, str]]  # (tag, text of class, id and role), outermost first
    text: str
    link_chars: int = 0


def blocks(page: str) -> list[Block]:
    """The leaf blocks with text, in page order. Tags left open close where the standard implies it,
    a tag cut off by the page's end is dropped, and unseen elements and comments hold no text."""
    stack: list[tuple[str, str]] = []
    out: list[Block] = []
    parts: list[str] = []
    linked = 0

    def close() -> None:
        nonlocal linked
        text = " ".join("".join(parts).split())
        if text:
            out.append(Block(list(stack), text, linked))
        parts.clear()
        linked = 0

    def pop_to(names: set[str], scope: set[str]) -> None:
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] in names:
                close()
                del stack[k:]
                return
            if stack[k][0] in scope:
                return

    at, size = 0, len(page)
    while at < size:
        found = _OPEN.search(page, at)
        start = found.start() if found else size
        if start > at:
            raw = page[at:start]
            text = html.unescape(raw) if "&" in raw else raw
            parts.append(text)
            if any(t == "a" for t, _ in stack):
                linked += len(text.strip())
        if not found:
            break
        nxt = page[start + 1]
        if nxt in "!?":
            mark = "-->" if page.startswith("<!--", start) else ">"
            end = page.find(mark, start + (4 if mark == "-->" else 1))
            at = size if end < 0 else end + len(mark)
            continue
        tag = _TAG.match(page, start)
        if not tag:
            if nxt == "/":
                end = page.find(">", start)
            else:
                end = -1 if page.find(">", start) < 0 else page.find("<", start + 1) - 1
            at = size if end < 0 else end + 1
            continue
        at = tag.end()
        slash, name, rest = (tag[1], tag[2], tag[3]) if tag[2] else (tag[4], tag[5], tag[6])
        name = name.lower()
        if slash:
            if any(t == name for t, _ in stack):
                if name in BLOCK:
                    close()
                while stack.pop()[0] != name:
                    pass
            continue
        if name in UNSEEN:
            end = re.compile(f"</{name}", re.I).search(page, at)
            stop = page.find(">", end.end()) if end else -1
            at = size if stop < 0 else stop + 1
            continue
        if name in BLOCK or name == "head":
            close()
        if name in ENDS_P:
            pop_to({"p"}, P_SCOPE)
        if name in CLOSES:
            pop_to(*CLOSES[name])
        if name in VOID or rest.endswith("/"):
            if name == "br":
                parts.append(" ")
            continue
        names = " ".join(x for m in _NAMED.finditer(rest) for x in m.groups() if x) if "=" in rest else ""
        stack.append((name, names))
    close()
    return [b for b in out if not any(t == "head" for t, _ in b.ancestors)]


def _bin(value: float, edges: tuple) -> int:
    return sum(value >= e for e in edges)


def features(page: list[Block]) -> list[list[str]]:
    """Names of the features that hold for each block."""
    out = []
    for k, b in enumerate(page):
        tags = [t for t, _ in b.ancestors]
        names = {f"has {t}" for t in tags if t not in ("html", "body")}
        names.add(f"in {next((t for t in reversed(tags) if t in BLOCK), 'none')}")
        for _, named in b.ancestors:
            for part in _PART.findall(named):
                word = part.lower()
                names.add(f"named {word}")
                if len(word) > 5:
                    names.add(f"begins {word[:5]}")
        around = next(((t, named) for t, named in reversed(b.ancestors) if named or t in REGION), ("none", ""))
        names.add(f"nearest {around[0]}")
        names.update(f"nearest named {part.lower()}" for part in _PART.findall(around[1]))
        n = len(b.text)
        words = b.text.count(" ") + 1
        links = b.link_chars / n
        names.add(f"links {_bin(links, (0.01, 0.3, 0.7, 0.95))}")
        names.add(f"words {_bin(words, (2, 5, 10, 20, 50))}")
        names.add(f"words {_bin(words, (5, 20))} links {_bin(links, (0.3, 0.9))}")
        names.add(f"stops {b.text[-1] in '.!?:;\"”»…'}")
        if "©" in b.text or "(c)" in b.text.lower():
            names.add("copyright")
        names.add(f"place {_bin(k / len(page), (0.1, 0.9))}")
        names.add("always")
        out.append(sorted(names))
    return out


@dataclass
class Chain:
    """Weights: a row by feature name for the labels 0 (other) and 1 (article), and transitions; row 2
    of the transitions is the start."""

    index: dict[str, int] = field(default_factory=dict)
    state: np.ndarray = field(default_factory=lambda: np.zeros((0, 2)))
    move: np.ndarray = field(default_factory=lambda: np.zeros((3, 2)))

    def potentials(self, page: list[Block]) -> np.ndarray:
        get, state = self.index.get, self.state
        rows = [[i for i in map(get, names) if i is not None] for names in features(page)]
        return np.array([state[r].sum(axis=0) if r else (0.0, 0.0) for r in rows]).reshape(-1, 2)

    def decode(self, page: list[Block]) -> list[int]:
        """Viterbi; equal paths prefer label 0."""
        score = self.potentials(page).tolist()
        (m00, m01), (m10, m11), (s0, s1) = self.move.tolist()
        came = []
        a, b = score[0][0] + s0, score[0][1] + s1
        for x, y in score[1:]:
            to0, to1 = b + m10 > a + m00, b + m11 > a + m01
            came.append((to0, to1))
            a, b = max(a + m00, b + m10) + x, max(a + m01, b + m11) + y
        labels = [int(b > a)]
        for step in reversed(came):
            labels.append(int(step[labels[-1]]))
        return labels[::-1]

    def fit(self, pages: list[tuple[list[Block], list[int]]], rounds: int = 12, rate: float = 0.5, decay: float = 1e-4, seed: int = 3) -> None:
        """AdaGrad on the log likelihood, page by page; gradients from forward-backward sums."""
        coded = []
        for page, labels in pages:
            rows = [np.array([self.index.setdefault(n, len(self.index)) for n in names]) for names in features(page)]
            coded.append((rows, labels))
        self.state = np.zeros((len(self.index), 2))
        seen, seen_move = np.full_like(self.state, 1e-6), np.full_like(self.move, 1e-6)
        rng = np.random.default_rng(seed)
        for _ in range(rounds):
            for k in rng.permutation(len(coded)):
                rows, labels = coded[k]
                score = np.array([self.state[r].sum(axis=0) for r in rows])
                gold = np.eye(2)[labels]
                n = len(rows)
                forward, back = np.zeros((n, 2)), np.zeros((n, 2))
                forward[0] = self.move[2] + score[0]
                for t in range(1, n):
                    forward[t] = np.logaddexp(forward[t - 1][0] + self.move[0], forward[t - 1][1] + self.move[1]) + score[t]
                for t in range(n - 2, -1, -1):
                    onward = self.move[:2] + score[t + 1] + back[t + 1]
                    back[t] = np.logaddexp(onward[:, 0], onward[:, 1])
                total = np.logaddexp(*forward[-1])
                wrong = gold - np.exp(forward + back - total)
                change = np.zeros((3, 2))
                change[2] = wrong[0]
                for t in range(1, n):
                    pair = forward[t - 1][:, None] + self.move[:2] + score[t] + back[t] - total
                    change[:2] += np.outer(gold[t - 1], gold[t]) - np.exp(pair)
                flat, each = np.concatenate(rows), np.repeat(wrong, [len(r) for r in rows], axis=0)
                grad = np.zeros_like(self.state)
                np.add.at(grad, flat, each)
                grad -= decay * self.state
                seen += grad**2
                seen_move += change**2
                self.state += rate * grad / np.sqrt(seen)
                self.move += rate * change / np.sqrt(seen_move)


#: Layouts of the labelled training pages: openings of elements around text of the article, and of
#: elements around all else. The first word of an opening is its tag.
ARTICLE = [
    "article", "main", 'div class="post-content"', 'div id="content"', 'div class="article-body"', 'section class="entry-content"',
    'div class="story text"', 'div role="main"', 'article class="post"', 'div itemprop="articleBody" class="body-copy"', 'div class="page-text"',
    'td class="content"', 'div', 'main id="main-content"', 'div class="blog-post single"', 'div class="main-column"', 'div id="primary"',
    'div class="content-area prose"', 'div class="left-column"', 'div class="text-block"', 'section', 'div class="body"',
]
OTHER = {
    "menu": ["nav", 'div class="menu"', 'ul class="navigation"', 'div id="navbar"', 'div class="breadcrumbs"', 'nav class="top-nav"', 'div role="navigation"'],
    "header": ["header", 'div class="site-header"', 'div id="masthead"', 'header class="banner"', 'div class="header-top"'],
    "footer": ["footer", 'div id="footer"', 'div class="site-footer"', 'footer class="page-footer"', 'div class="copyright"'],
    "sidebar": ["aside", 'div class="sidebar"', 'div class="widget"', 'aside class="related"', 'div id="right-rail"', 'div class="related-posts"', 'div class="recommended"', 'div class="side-column"'],
    "notice": ['div class="cookie-notice"', 'div id="consent"', 'div class="notice"', 'div class="alert banner"', 'div class="newsletter subscribe"', 'div role="alert"', 'div class="paywall-message"', 'div class="popup modal"', 'p class="gdpr cookies"'],
    "advert": ['div class="ad"', 'div class="advert"', 'div class="sponsored"', 'div id="promo"', 'ins class="adsbygoogle"', 'div class="advertisement"', 'div class="ads ad-slot"', 'section class="promotion"'],
    "form": ["form", 'form class="search"', 'form id="login"', 'form class="signup"', "fieldset"],
    "comments": ['section class="comments"', 'div id="comments"', 'div class="comment"', 'ol class="comment-list"', 'div class="reader-comments"', 'div class="replies discussion"', 'section id="disqus-thread"', 'div class="user-comment response"', 'aside class="comments"'],
    "share": ['div class="share"', 'ul class="social tags"', 'div class="pagination pager"', 'div class="byline meta"'],
}
AROUND = ["", 'div class="container"', 'div class="wrapper inner"', 'div class="row"', 'section', 'div class="col block"', 'div id="page"', 'div class="layout grid"']


def _element(opening: str, inner: str) -> str:
    return f"<{opening}>{inner}</{opening.split()[0]}>" if opening else inner


def relaid(page: list[Block], labels: list[int], rng: Random) -> str:
    """The page's texts in another layout. Every block's text is marked by its label, ``\\x01`` for text
    of the article and ``\\x02`` for others, so that labels are read off the new page."""
    main = [b.text for b, v in zip(page, labels, strict=True) if v]
    rest = [b.text for b, v in zip(page, labels, strict=True) if not v] or ["Home"]
    article = []
    for k, text in enumerate(main):
        tag = "h1" if k == 0 and rng.random() < 0.8 else rng.choice(["p", "p", "p", "p", "h2", "blockquote", "div", "li", "li"])
        text = html.escape(text)
        if rng.random() < 0.2:
            cut = rng.randrange(len(text) + 1)
            text = text[:cut].rsplit("&", 1)[0] + '<a href="/x">' + text[cut:].split(";", 1)[-1] + "</a>"
        block = f"<{tag}>\x01{text}" + f"</{tag}>" * (tag != "p" or rng.random() < 0.8)
        article.append(f"<ul>{block}</ul>" if tag == "li" else block)

    def piece(kind: str) -> str:
        def line() -> str:
            text = rng.choice(rest if rng.random() < 0.6 or not main else main)
            few = text.split()[: rng.choice([1, 2, 3, 8, 30])]
            return "\x02" + html.escape(" ".join(few))

        n = rng.randrange(1, 6)
        if kind in ("menu", "share"):
            inner = "<ul>" + "".join(f'<li><a href="/{i}">{line()}</a></li>' for i in range(n)) + "</ul>"
        elif kind == "form":
            inner = f"<label>{line()}</label><input name=q><select><option>{line()}</option></select><button>{line()}</button>"
        elif kind == "comments":
            shape = rng.choice(['<div class="comment"><b>{}</b><p>{}</p></div>', "<p>{} {}</p>", "<h3>{}</h3><p>{}</p>", "<li>{} {}</li>"])
            inner = "".join(shape.format(line(), line()) for _ in range(n))
        elif kind == "sidebar":
            inner = f"<h3>{line()}</h3>" + "".join(f'<p><a href="/{i}">{line()}</a> {line()[1:]}</p>' for i in range(n))
        else:
            inner = "".join(rng.choice(["<p>{}</p>", "<span>{}</span> ", "{} ", "<div>{}</div>"]).format(line()) for _ in range(n))
            inner = ("&copy; " if kind == "footer" and rng.random() < 0.6 else "") + inner
        return _element(rng.choice(OTHER[kind]), inner)

    inside = [k for k in ("advert", "sidebar", "notice", "share", "comments", "form") if rng.random() < 0.3]
    for kind in inside:
        article.insert(len(article) if kind in ("comments", "share", "form") else rng.randrange(len(article) + 1), piece(kind))
    odd = "".join(rng.choice("bcdfglmnprstvaeiou") for _ in range(7))
    opening = rng.choice(ARTICLE) if rng.random() < 0.6 else f'div class="{odd}"'
    body = [_element(opening, "".join(article))] if article else []
    before = [k for k, p in (("notice", 0.3), ("header", 0.5), ("menu", 0.7), ("advert", 0.4), ("form", 0.25), ("sidebar", 0.2)) if rng.random() < p]
    after = [k for k, p in (("comments", 0.5), ("share", 0.3), ("sidebar", 0.4), ("advert", 0.3), ("form", 0.2), ("notice", 0.2), ("footer", 0.8)) if rng.random() < p]
    parts = [piece(k) for k in before] + [_element(rng.choice(AROUND), "".join(body))] + [piece(k) for k in after]
    return "<html><head><title>x</title></head><body>" + _element(rng.choice(AROUND), "".join(parts)) + "</body></html>"


def marked(page: str) -> tuple[list[Block], list[int]]:
    """Blocks and labels of a relaid page; a block is of the article if its first mark says so."""
    found = [b for b in blocks(page) if "\x01" in b.text or "\x02" in b.text or b.text.startswith("©")]
    labels = [int(min(b.text.find("\x01") % 10**9, b.text.find("\x02") % 10**9) == b.text.find("\x01")) for b in found]
    for b in found:
        b.text = b.text.replace("\x01", "").replace("\x02", "") or "x"
    return found, labels


_NOT_ARTICLE = {"nav", "aside", "footer", "header", "form", "button", "select"}


def by_tags(page: list[Block]) -> list[int] | None:
    """Labels of a page that says itself where its article is; None for others."""
    if not any(t in ("article", "main") for b in page for t, _ in b.ancestors):
        return None
    return [int(any(t in ("article", "main") for t, _ in b.ancestors) and not any(t in _NOT_ARTICLE for t, _ in b.ancestors)) for b in page]


#: Bounds of the training sample: pages, and code points of a page.
SAMPLE_PAGES = 250
SAMPLE_CHARS = 60_000
LAYOUTS = 4


def learn(pages: DataFrame, rows: int = SAMPLE_PAGES, chars: int = SAMPLE_CHARS, layouts: int = LAYOUTS) -> Chain:
    """Train on a bounded sample of pages whose tags say where the article is, and on the same texts in
    other layouts with the labels kept, so that the model doesn't lean on one way to write a page."""
    usable = pages.where(F.col("html").isNotNull() & (F.length("html") <= chars))
    n = usable.count()
    unit = F.pmod(F.xxhash64(F.lit("sample"), "url", "html"), F.lit(1 << 30)) / float(1 << 30)
    picked = usable.where(unit < rows / max(1, n)).select("html").limit(2 * rows).collect()
    labelled, rng = [], Random(17)
    for text in sorted(r["html"] for r in picked):
        page = blocks(text)
        labels = by_tags(page) if page else None
        if labels is None:
            continue
        labelled.append((page, labels))
        labelled += [m for _ in range(layouts) for m in [marked(relaid(page, labels, rng))] if m[0]]
    chain = Chain()
    if labelled:
        chain.fit(labelled)
    return chain


def main_text(page: str, chain: Chain) -> str:
    found = blocks(page)
    if not found:
        return ""
    return "\n\n".join(b.text for b, v in zip(found, chain.decode(found), strict=True) if v)


def extract(pages: DataFrame, chain: Chain, page_id: str = "page_id", url: str = "url", source: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every page, from its whole html.

    Null, empty and wholly unseen pages have an empty text. Pages with equal or null ids stay; an empty
    table gives no rows. Without any labelled page to learn from nothing is called article.
    """
    shared = pages.sparkSession.sparkContext.broadcast(chain)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(p.as_py() or "", shared.value) for p in batch["html"]]
            size = pa.array([len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch["page_id"], batch["url"], pa.array(texts, pa.string()), size], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(source).alias("html"))
    return rows.mapInArrow(scan, "page_id long, url string, text string, n_chars long")
