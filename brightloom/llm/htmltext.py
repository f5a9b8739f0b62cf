"""Main text of web pages by a linear-chain conditional random field over the leaf blocks of the document tree.

A page becomes the sequence of its leaf blocks: text between the borders of block elements, with the open elements above
it. Each block has binary features: the tags of its ancestors, the words of their class, id and role, the nearest
sectioning ancestor, and bins of its text (words, share of links, punctuation, place). The field has two labels, main and
other; it is trained on labelled pages by gradient ascent on the exact likelihood and decoded by Viterbi.

Defined results: null or empty html gives no blocks and an empty text; unclosed, crossed or cut-off tags are read as
browsers do for the elements that matter here; the contents of scripts, styles, templates and embedded frames are never
text; character references are decoded, also without semicolon; white space inside a block becomes one space. Nothing
else is dropped or capped. Repeated rows are read alike. Columns other than page_id, url and html are dropped.
"""

from __future__ import annotations

import html
import random
import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Names of elements.
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed frame hr img input link meta param source track wbr".split())
UNREAD = ("script", "style", "template", "noscript", "iframe", "noembed", "noframes", "object", "svg", "canvas", "audio", "video", "textarea", "xmp")
#: Those of them whose text is read if they are never closed.
OPEN_ENDED = frozenset("noscript object svg canvas audio video".split())
CLOSES_P = BLOCK - frozenset("body head html legend option optgroup caption dd dt li tbody td tfoot th thead tr title p summary".split()) | {"p", "li", "dd", "dt"}
SECTIONS = frozenset("article aside body dialog details figure footer form header main nav section table title head".split())
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.S)
_ATTR = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_SPACE = re.compile(r"[ \t\n\r\f\v\xa0]+")
#: Elements whose start closes an open one of the same kind, and the parents where the search ends.
_SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "tbody": ("tbody", "thead", "tr", "td", "th"), "tfoot": ("tbody", "tr", "td", "th")}
_SCOPE = frozenset("ul ol menu dl table select body html".split())


def blocks(page: str) -> list[tuple[tuple, str, float]]:
    """(path, text, share of its characters in links) of each leaf block; path: (tag, attribute words) from the root."""
    out: list[tuple[tuple, str, float]] = []
    path: tuple = ()
    pieces: list[str] = []
    linked = at = links = 0
    unread = None

    def flush():
        nonlocal linked
        if pieces:
            text = _SPACE.sub(" ", html.unescape("".join(pieces))).strip()
            if text:
                total = sum(map(len, pieces))
                out.append((path, text, linked / total))
            pieces.clear()
        linked = 0

    while True:
        if unread:
            end = re.compile(rf"</{unread}(?=[\s/>])", re.I).search(page, at)
            if not end and unread in OPEN_ENDED:
                unread = None  # read on, as after an element that nothing closes
                continue
            if not end:
                break
            at, unread = end.start(), None
        m = _TAG.search(page, at)
        text = page[at : m.start()] if m else page[at:]
        if text:
            pieces.append(text)
            if links:
                linked += len(text)
        if not m:
            break
        at = m.end()
        if not m[2]:
            if m[0].startswith("<![CDATA["):
                pieces.append(html.escape(m[0][9:].removesuffix("]]>")))
            continue
        tag = m[2].lower()
        if m[1]:
            if tag == "a":
                links = max(0, links - 1)
            elif tag in BLOCK:
                flush()
                if any(e[0] == tag for e in path):
                    while path[-1][0] != tag:
                        path = path[:-1]
                    path = path[:-1]
            continue
        if tag == "a":
            links = 1
        elif tag in UNREAD and not m[3].endswith("/"):
            unread = tag
        elif tag == "br":
            pieces.append(" ")
        elif tag in BLOCK:
            flush()
            if tag in CLOSES_P and path and path[-1][0] == "p":
                path = path[:-1]
            if tag in _SIBLINGS:
                for k in range(len(path) - 1, -1, -1):
                    if path[k][0] in _SCOPE:
                        break
                    if path[k][0] in _SIBLINGS[tag]:
                        path = path[:k]
                        if tag in ("li", "dt", "dd", "option"):
                            break
            if tag not in VOID:
                words = tuple(sorted({w.lower() for a in _ATTR.findall(m[3]) for w in _PART.findall(a[1] or a[2] or a[3])})) if m[3] else ()
                path = (*path, (tag, words))
                links = 0 if tag in SECTIONS else links
    flush()
    return out


def path_features(path: tuple) -> list[str]:
    found = {f"t:{tag}" for tag, _ in path} | {f"c:{w}" for _, words in path for w in words}
    if path:
        found.add(f"p:{path[-1][0]}")
    near = next((e for e in reversed(path) if e[0] in SECTIONS), ("", ()))
    found.add(f"n:{near[0]}")
    found |= {f"n:{near[0]}.{w}" for w in near[1]}
    found |= {f"nc:{w}" for w in next((e[1] for e in reversed(path) if e[1]), ())}
    return sorted(found)


def text_features(text: str, linked: float, first: bool) -> list[str]:
    n = text.count(" ") + 1
    size = "1" if n == 1 else "4" if n < 5 else "9" if n < 10 else "19" if n < 20 else "49" if n < 50 else "50"
    found = [f"w:{size}", f"l:{'0' if linked == 0 else 'some' if linked < 0.4 else 'most'}", f"e:{text[-1] in '.!?:;,'}", "b:"]
    if "©" in text or "|" in text or "»" in text:
        found.append("s:mark")
    if first:
        found.append("i:first")
    return found


@dataclass
class Field:
    """weights: feature to (other, main); moves: label to label; ends: first label."""

    weights: dict[str, tuple[float, float]]
    moves: tuple[tuple[float, float], tuple[float, float]]
    start: tuple[float, float]

    def labels(self, page: list[tuple[tuple, str, float]], cache: dict) -> list[int]:
        """The most likely labels of a page's blocks, by Viterbi; cache holds the sums for paths."""
        if not page:
            return []
        w, ((m00, m01), (m10, m11)) = self.weights, self.moves
        back: list[tuple[int, int]] = []
        a = b = 0.0
        for i, (path, text, linked) in enumerate(page):
            if (e := cache.get(path)) is None:
                if len(cache) > 20_000:
                    cache.clear()
                known = [w[f] for f in path_features(path) if f in w]
                e = cache[path] = (sum(k[0] for k in known), sum(k[1] for k in known))
            x, y = e
            for f in text_features(text, linked, i == 0):
                if (k := w.get(f)) is not None:
                    x += k[0]
                    y += k[1]
            if i == 0:
                a, b = x + self.start[0], y + self.start[1]
                continue
            p, q = (0, a + m00) if a + m00 >= b + m10 else (1, b + m10)
            r, s = (0, a + m01) if a + m01 > b + m11 else (1, b + m11)
            back.append((p, r))
            a, b = q + x, s + y
        out = [int(b > a)]
        for step in reversed(back):
            out.append(step[out[-1]])
        return out[::-1]


def train(labelled: list[tuple[str, list[int]]], rounds: int = 150, decay: float = 2e-3) -> Field:
    """Fits the field to (html, a label for each leaf block: 1 main, 0 other) by Adam steps on the penalised log-likelihood."""
    pages = [(blocks(page), y) for page, y in labelled]
    pages = [(b, y) for b, y in pages if b]
    names: dict[str, int] = {}
    ids, rows = [], []
    longest, n = max(len(b) for b, _ in pages), len(pages)
    label, mask = np.zeros((n, longest), int), np.zeros((n, longest), bool)
    for p, (page, y) in enumerate(pages):
        assert len(page) == len(y), "one label for each block"
        for i, (path, text, linked) in enumerate(page):
            for f in path_features(path) + text_features(text, linked, i == 0):
                ids.append(names.setdefault(f, len(names)))
                rows.append(p * longest + i)
        label[p, : len(y)] = y
        mask[p, : len(y)] = True
    ids_, rows_ = np.array(ids), np.array(rows)
    k = len(names)
    theta = np.zeros((k + 3, 2))  # features; two rows of moves; start
    m1, m2 = np.zeros_like(theta), np.zeros_like(theta)
    gold = np.eye(2)[label] * mask[..., None]
    for step in range(1, rounds + 1):
        emit = np.stack([np.bincount(rows_, theta[ids_, c], minlength=n * longest) for c in (0, 1)], 1).reshape(n, longest, 2)
        move, start = theta[k : k + 2], theta[k + 2]
        alpha, beta = np.zeros((n, longest, 2)), np.zeros((n, longest, 2))
        alpha[:, 0] = emit[:, 0] + start
        for t in range(1, longest):
            new = np.logaddexp.reduce(alpha[:, t - 1, :, None] + move, axis=1) + emit[:, t]
            alpha[:, t] = np.where(mask[:, t, None], new, alpha[:, t - 1])
        for t in range(longest - 2, -1, -1):
            new = np.logaddexp.reduce(move + (emit[:, t + 1] + beta[:, t + 1])[:, None, :], axis=2)
            beta[:, t] = np.where(mask[:, t + 1, None], new, beta[:, t + 1])
        z = np.logaddexp.reduce(alpha[:, -1], axis=1)
        off = gold - np.exp(alpha + beta - z[:, None, None]) * mask[..., None]
        grad = np.zeros_like(theta)
        flat = off.reshape(-1, 2)
        for c in (0, 1):
            grad[:k, c] = np.bincount(ids_, flat[rows_, c], minlength=k)
        pair = alpha[:, :-1, :, None] + move + (emit[:, 1:] + beta[:, 1:])[:, :, None, :] - z[:, None, None, None]
        both = mask[:, 1:, None, None]
        grad[k : k + 2] = (gold[:, :-1, :, None] * gold[:, 1:, None, :] * both - np.exp(np.minimum(pair, 0)) * both).sum((0, 1))
        grad[k + 2] = off[:, 0].sum(0)
        grad = grad / n - decay * theta
        m1, m2 = 0.9 * m1 + 0.1 * grad, 0.99 * m2 + 0.01 * grad**2
        theta = theta + 0.1 * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-8)
    w = {f: tuple(theta[i].tolist()) for f, i in names.items()}
    return Field(w, tuple(map(tuple, theta[k : k + 2].tolist())), tuple(theta[k + 2].tolist()))


#: Words that name parts of pages in class and id.
MAIN_WORDS = "content post entry story text article body main page prose markdown copy".split()
OTHER_WORDS = (
    "ad ads advert advertisement banner sponsor sponsored promo promotion menu navbar navigation nav topbar breadcrumb breadcrumbs pagination pager sidebar side aside widget related recommended more "
    "footer foot copyright legal header masthead site cookie cookies consent notice alert popup modal overlay newsletter subscribe signup login search share social follow tags meta comments comment reply replies discussion disqus respond"
).split()


def labelled_pages(seed: int = 7, n: int = 240) -> list[tuple[str, list[int]]]:
    """Made pages with a label for each leaf block: articles in several layouts, among menus, notices, adverts, forms and comments."""
    r = random.Random(seed)
    syllables = "ba de fi go lu ma ne po ra si to vu ker lan mor tis".split()
    out = []
    for _ in range(n):
        parts: list[str] = []
        labels: list[int] = []

        def words(a: int, b: int) -> str:
            ws = ["".join(r.choice(syllables) for _ in range(r.randint(1, 4))) for _ in range(r.randint(a, b))]
            return " ".join(ws).capitalize() + r.choice([".", ".", ".", "!", "?", ""])

        def leaf(tag: str, text: str, y: int):
            parts.append(f"<{tag}>{text}</{tag}>" if tag else text)
            labels.append(y)

        def other(kind: str):
            tag = {"nav": "nav", "footer": "footer", "header": "header", "aside": "aside", "form": "form"}.get(kind, "div")
            cls = f' class="{kind}"' if tag == "div" or r.random() < 0.4 else ""
            cls = f' id="{kind}-{r.choice(["box", "1", "wrap", "area"])}"' if tag == "div" and r.random() < 0.25 else cls
            parts.append(f"<{tag}{cls}>")
            if kind in ("nav", "menu", "navbar", "navigation", "breadcrumb", "breadcrumbs", "pagination", "pager", "tags", "share", "social", "related", "more"):
                parts.append("<ul>")
                for _ in range(r.randint(2, 7)):
                    leaf("li", f'<a href="/x">{words(1, 3 if kind != "related" else 9)}</a>', 0)
                parts.append("</ul>")
            elif kind in ("form", "login", "search", "newsletter", "subscribe", "signup"):
                leaf("label" if r.random() < 0.0 else "p", words(1, 8), 0)
            elif "comment" in kind or kind in ("reply", "replies", "discussion", "disqus", "respond"):
                leaf("h3", words(1, 3), 0)
                for _ in range(r.randint(1, 4)):
                    inner = r.choice(["p", "li", "div"])
                    leaf(inner, words(2, 60), 0)
            elif kind == "footer" and r.random() < 0.7:
                leaf("", f"&copy; {words(1, 3)} &middot; {words(2, 14)}", 0)
            elif kind == "header":
                leaf(r.choice(["div", "p", "h1"]), words(1, 6), 0)
            else:
                leaf(r.choice(["", "p", "div"]), words(2, 30), 0)
                if r.random() < 0.3:
                    leaf("p", words(3, 30), 0)
            parts.append(f"</{tag}>")

        def article():
            kind = r.choice(["article", "article", "main", "div", "section", "main-article", "bare"])
            word = r.choice(MAIN_WORDS)
            before, after = {"article": ("<article>", "</article>"), "main": ("<main>", "</main>"), "div": (f'<div class="{word}">', "</div>"), "section": (f'<section id="{word}">', "</section>"), "main-article": ("<main><article>", "</article></main>"), "bare": ("", "")}[kind]
            parts.append(before)
            if r.random() < 0.85:
                head = r.random() < 0.2 and kind != "bare"
                parts.append("<header>" * head)
                leaf("h1", words(2, 12), 1)
                parts.append("</header>" * head)
            for _ in range(r.randint(1, 12)):
                what = r.random()
                if what < 0.72:
                    leaf("p", words(1, 90) if r.random() < 0.75 else words(1, 6), 1)
                elif what < 0.80:
                    leaf(r.choice(["h2", "h3"]), words(1, 8), 1)
                elif what < 0.86:
                    parts.append("<ul>")
                    for _ in range(r.randint(2, 5)):
                        leaf("li", words(1, 20), 1)
                    parts.append("</ul>")
                elif what < 0.9:
                    leaf(r.choice(["blockquote", "pre"]), words(4, 40), 1)
                elif what < 0.93:
                    parts.append("<table><tr>")
                    for _ in range(3):
                        leaf("td", words(1, 4), 1)
                    parts.append("</tr></table>")
                elif what < 0.96:
                    parts.append("<figure>")
                    leaf("figcaption", words(3, 12), 1)
                    parts.append("</figure>")
                else:
                    other(r.choice(["ad", "advert", "promo", "newsletter", "related", "share", "aside", "banner"]))
            if r.random() < 0.25:
                other(r.choice(["comments", "comment", "discussion", "replies", "share", "tags"]))
            parts.append(after)

        parts.append(f"<!DOCTYPE html><html><head><title>{words(2, 8)}</title></head><body>")
        labels.append(0)
        for kind in r.sample(OTHER_WORDS + ["nav", "header", "ad", "form", "aside"] * 3, r.randint(1, 4)):
            other(kind)
        article()
        for kind in r.sample(OTHER_WORDS + ["footer", "aside", "comments", "form"] * 4, r.randint(1, 4)):
            other(kind)
        parts.append("</body></html>")
        out.append(("".join(parts), labels))
    return out


def extract(pages: DataFrame, field: Field) -> DataFrame:
    """page_id, url, text, n_chars, n_blocks, n_main for each page."""

    def run(batches):
        import pyarrow as pa

        cache: dict = {}
        for batch in batches:
            texts, counts = [], []
            for page in batch.column("html"):
                found = blocks(page.as_py() or "") if page.is_valid else []
                keep = field.labels(found, cache)
                texts.append(" ".join(b[1] for b, y in zip(found, keep, strict=True) if y))
                counts.append((len(texts[-1]), len(found), sum(keep)))
            cols = list(zip(*counts, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), *(pa.array(c, pa.int64()) for c in cols)], names=["page_id", "url", "text", "n_chars", "n_blocks", "n_main"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long, n_blocks long, n_main long")
