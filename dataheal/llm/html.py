"""HTML extraction with a recurrent block labeller.

A page is cut into leaf blocks. Each block becomes a vector: the mean of the embeddings of its
tag path (tags, classes and ids from the root), the mean of the embeddings of its hashed words,
and a few figures of its shape. A bidirectional LSTM in numpy reads the vectors of the whole page
in order and gives each block the probability of belonging to the main text, so menus, adverts or
comments are told by what stands around them as well.

The network is trained on ``TRAINING_PAGES`` pages that ``training_page`` makes with a fixed seed;
its weights (under 1 MB) go to the tasks. Pages are read in place and never shuffled.

Defined results: a null or empty page, and one without a main block, gives the empty string and 0;
repeated rows are each extracted; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import html as entities
import random
import re
import zlib
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dataheal.llm import common

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|[^<]+|<""", re.S)
ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
NAME = re.compile(r"[A-Za-z]+")
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img input ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr picture source".split())
VOID = frozenset("br img input wbr source hr meta link base col embed area track param".split())
UNREAD = frozenset("script style noscript template textarea svg math iframe object".split())
#: An open element of these kinds ends where another of its group begins.
CLOSED_BY = {"p": "p", "li": "li", "dt": "dd", "dd": "dd", "tr": "tr", "td": "td", "th": "td", "option": "option"}

PATH_SLOTS, PATH_SIZE, WORD_SLOTS, WORD_SIZE, FIGURES, HIDDEN = 4096, 24, 2048, 12, 10, 32
TRAINING_PAGES, LONGEST, EPOCHS, BATCH, RATE = 1600, 60, 14, 40, 0.01
#: Most entries of each table that a worker keeps; blocks, padding included, that are read at once; steps computed ahead.
HELD, AT_ONCE, AHEAD = 100_000, 1 << 14, 1 << 12


class Place:
    """An open element: its own names and the element around it. Blocks share the elements around them."""

    __slots__ = ("parent", "tag", "names", "size")

    def __init__(self, parent: Place | None, tag: str, names: tuple[str, ...]) -> None:
        self.parent, self.tag, self.names = parent, tag, names
        self.size = len(names) + (parent.size if parent else 0)


class Block:
    __slots__ = ("place", "text", "linked")

    def __init__(self, place: Place | None, text: str, linked: int) -> None:
        self.place, self.text, self.linked = place, text, linked

    @property
    def tag(self) -> str:
        return self.place.tag if self.place else ""

    @property
    def path(self) -> tuple[str, ...]:
        """All names from the root."""
        parts, at = [], self.place
        while at:
            parts.append(at.names)
            at = at.parent
        return tuple(x for names in reversed(parts) for x in names)


class Places(dict):
    """Elements by the one around them and their names, so that pages of one make share them."""

    def __missing__(self, key: tuple[Place | None, tuple[str, ...]]) -> Place:
        if len(self) >= HELD:
            self.clear()
        self[key] = found = Place(key[0], key[1][0], key[1])
        return found


def blocks(page: str, places: Places | None = None) -> list[Block]:
    """The leaf blocks of a page in order, each with its tag path; tolerant of missing and stray tags."""
    out: list[Block] = []
    places = Places() if places is None else places
    stack: list[Place] = []
    opened: dict[str, int] = {}
    held: list[str] = []
    linked, in_link, place = 0, False, None

    def flush() -> None:
        nonlocal linked, place
        if held:
            text = " ".join("".join(held).split())
            if text:
                out.append(Block(place, text, linked))
            held.clear()
        linked = 0

    def close() -> None:
        opened[stack.pop().tag] -= 1

    def add(raw: str) -> None:
        nonlocal linked, place
        text = entities.unescape(raw) if "&" in raw else raw
        if not any(held):
            place = stack[-1] if stack else None
        held.append(text)
        linked += len(text) if in_link else 0

    at, last = 0, page.rfind(">")
    while at < len(page):
        if at > last:  # no tag can end any more
            rest = page[at:]
            add(rest[: rest.find("<!--")] if "<!--" in rest else rest)
            break
        m = TOKEN.match(page, at)
        at = m.end()
        tag = m[2] or m[5]
        if tag is None:
            if page[m.start()] != "<" or at - m.start() == 1:
                add(m[0])
            continue
        tag, closing, attributes = tag.lower(), bool(m[1] or m[4]), m[3] or m[6] or ""
        if tag in UNREAD and not closing:
            if not attributes.endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(page, at)
                at = end.end() if end else len(page)
            continue
        if tag == "a":
            in_link = not closing
        if tag in INLINE:
            if tag in ("br", "img", "input"):
                add(" ")
            continue
        flush()
        in_link = in_link and tag == "a"
        if closing:
            if opened.get(tag):
                while stack[-1].tag != tag:
                    close()
                close()
            continue
        group = CLOSED_BY.get(tag)
        if stack and group and CLOSED_BY.get(stack[-1].tag) == group or stack and stack[-1].tag == "p":
            close()
        if tag not in VOID:
            names = [tag]
            for a in ATTRIBUTE.finditer(attributes):
                names += ["." + x.lower() for x in NAME.findall(a[2] or a[3] or a[4] or "")]
            stack.append(places[stack[-1] if stack else None, tuple(names)])
            opened[tag] = opened.get(tag, 0) + 1
    flush()
    return out


DIGIT, STOP, BAR = re.compile(r"\d"), re.compile(r"[.,;:]"), re.compile(r"[|©·»›•]")


def slot(word: str, n: int) -> int:
    return zlib.crc32(word.encode("utf-8", "replace")) % n


class Slots(dict):
    """Slots by key, computed when first asked for; forgotten when there are too many."""

    def __init__(self, make) -> None:
        self.make = make

    def __missing__(self, key):
        if len(self) >= HELD:
            self.clear()
        self[key] = found = self.make(key)
        return found


def path_slots(key: tuple[tuple[str, ...], str]) -> list[int]:
    path, leaf = key
    return [slot(x, PATH_SLOTS) for x in (*path, "leaf " + leaf, *(p + ">" + q for p, q in zip(path, path[1:])))]


def word_slot(word: str) -> int:
    return slot(word.strip(".,:;!?()\"'©"), WORD_SLOTS)


class Page:
    """Slots of path parts and of words, and figures, of every block; without ``paths`` the blocks' places stand for their parts."""

    def __init__(self, found: list[Block], paths: Slots | None, known: Slots) -> None:
        n = len(found)
        self.path = None if paths is None else [paths[b.path, b.tag] for b in found]
        self.places = [b.place for b in found]
        self.words, figures = [], []
        for i, b in enumerate(found):
            text = b.text
            words = text.lower().split()
            self.words.append([known[w] for w in words])
            size = max(1, len(text))
            figures.append((
                min(1.0, np.log1p(len(words)) / 6), min(1.0, b.linked / size), len(STOP.findall(text)) / max(1, len(words)),
                text[-1] in ".!?:…\"”»", BAR.search(text) is not None, len(DIGIT.findall(text)) / size,
                i / n, (b.place.size if b.place else 0) / 12, min(1.0, n / 60), len(words) < 4))
        self.figures = np.array(figures, np.float32).reshape(n, FIGURES)

    def __len__(self) -> int:
        return len(self.figures)


def mean_rows(weights: np.ndarray, slots: list[list[int]]) -> np.ndarray:
    """Mean of the embeddings of each list; an empty list gives zeros."""
    sizes = np.array([len(x) for x in slots])
    out = np.zeros((len(slots), weights.shape[1]), weights.dtype)
    full = np.flatnonzero(sizes)
    if len(full):
        flat = np.fromiter((i for x in slots for i in x), np.int64, int(sizes.sum()))
        starts = np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
        out[full] = np.add.reduceat(weights[flat], starts, axis=0) / sizes[full, None]
    return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


class Labeller:
    """Embeddings, two LSTMs (one reads the page backwards) and an output layer."""

    def __init__(self, seed: int = 5) -> None:
        r = np.random.default_rng(seed)
        size = PATH_SIZE + WORD_SIZE + FIGURES
        draw = lambda *s: (r.standard_normal(s) / np.sqrt(s[-2])).astype(np.float32)
        self.w = {
            "path": r.standard_normal((PATH_SLOTS, PATH_SIZE)).astype(np.float32) * 0.5,
            "words": r.standard_normal((WORD_SLOTS, WORD_SIZE)).astype(np.float32) * 0.5,
            "x": draw(2, size, 4 * HIDDEN), "h": draw(2, HIDDEN, 4 * HIDDEN), "0": np.zeros((2, 1, 4 * HIDDEN), np.float32),
            "out": draw(2 * HIDDEN, 1), "out0": np.zeros(1, np.float32)}
        self.w["0"][:, :, HIDDEN : 2 * HIDDEN] = 1

    def vectors(self, pages: list[Page], sums: dict | None = None) -> np.ndarray:
        if sums is None:
            path = mean_rows(self.w["path"], [x for p in pages for x in p.path])
        else:
            path = self.along([x for p in pages for x in p.places], sums)
        words = mean_rows(self.w["words"], [x for p in pages for x in p.words])
        return np.concatenate([path, words, np.concatenate([p.figures for p in pages])], 1)

    def along(self, places: list[Place | None], sums: dict) -> np.ndarray:
        """Means of the embeddings of path parts. ``sums`` holds the sum and number of parts by element: its own added to those around it."""
        weights = self.w["path"]
        sums.setdefault(None, (np.zeros(PATH_SIZE, np.float64), 0, weights[slot("leaf ", PATH_SLOTS)]))
        for place in places:
            new, at = [], place
            while at not in sums:
                new.append(at)
                at = at.parent
            for x in reversed(new):
                total, n, _ = sums[x.parent]
                line = (x.parent.names[-1], *x.names) if x.parent else x.names
                own = [slot(p, PATH_SLOTS) for p in (*x.names, *(p + ">" + q for p, q in zip(line, line[1:])))]
                sums[x] = (total + weights[own].sum(0), n + len(own), weights[slot("leaf " + x.tag, PATH_SLOTS)])
        total, n, leaf = zip(*(sums[place] for place in places))
        return ((np.array(total) + np.array(leaf)) / (np.array(n)[:, None] + 1)).astype(np.float32)

    def run(self, x: np.ndarray, keep: bool = False) -> tuple[np.ndarray, list]:
        """Hidden states [block, way, page, HIDDEN] of ``x`` [block, way, page, size]; both ways start at block 0."""
        length, _, n, _ = x.shape
        h, c = np.zeros((2, n, HIDDEN), np.float32), np.zeros((2, n, HIDDEN), np.float32)
        out, steps = np.zeros((length, 2, n, HIDDEN), np.float32), []
        for t in range(length):
            if t % AHEAD == 0:
                pre = x[t : t + AHEAD] @ self.w["x"] + self.w["0"]
            g = pre[t % AHEAD] + h @ self.w["h"]
            gates = sigmoid(g[..., : 3 * HIDDEN])
            u = np.tanh(g[..., 3 * HIDDEN :])
            i, f, o = (gates[..., k * HIDDEN : (k + 1) * HIDDEN] for k in range(3))
            c_new = f * c + i * u
            tc = np.tanh(c_new)
            if keep:
                steps.append((h, c, gates, u, tc))
            h, c = o * tc, c_new
            out[t] = h
        return out, steps

    def logits(self, hidden: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """[block, page]; the backward way is turned round to the order of the blocks."""
        length, n = hidden.shape[0], hidden.shape[2]
        turned = hidden[turn(length, sizes), 1, np.arange(n)]
        return hidden[:, 0] @ self.w["out"][:HIDDEN, 0] + turned @ self.w["out"][HIDDEN:, 0] + self.w["out0"]

    def fit(self, pages: list[tuple[Page, np.ndarray]]) -> Labeller:
        """Cross-entropy by back-propagation through time, with Adam."""
        r = np.random.default_rng(7)
        m, v, step = {k: np.zeros_like(a) for k, a in self.w.items()}, {k: np.zeros_like(a) for k, a in self.w.items()}, 0
        by_size = sorted(range(len(pages)), key=lambda i: len(pages[i][0]))
        parts = np.array_split(np.array(by_size), max(1, len(pages) // BATCH))
        for epoch in range(EPOCHS):
            rate = RATE * (1 - epoch / EPOCHS) + 1e-4
            for part in r.permutation(len(parts)):
                grads = self.gradient([pages[i] for i in parts[part]])
                step += 1
                for k, g in grads.items():
                    m[k] += 0.1 * (g - m[k])
                    v[k] += 0.001 * (g * g - v[k])
                    self.w[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        return self

    def gradient(self, batch: list[tuple[Page, np.ndarray]]) -> dict[str, np.ndarray]:
        x, sizes = self.padded([p for p, _ in batch])
        length, _, n, width = x.shape
        y, back = np.zeros((length, n), np.float32), turn(length, sizes)
        for i, (_, labels) in enumerate(batch):
            y[: len(labels), i] = labels
        real = np.arange(length)[:, None] < sizes
        hidden, steps = self.run(x, keep=True)
        d_out = ((sigmoid(self.logits(hidden, sizes)) - y) * real / real.sum()).astype(np.float32)
        turned = d_out[back, np.arange(n)]
        d_hidden = np.stack([d_out[..., None] * self.w["out"][:HIDDEN, 0], turned[..., None] * self.w["out"][HIDDEN:, 0]], 1)
        grads = {"out": np.concatenate([np.einsum("tnh,tn->h", hidden[:, 0], d_out), np.einsum("tnh,tn->h", hidden[:, 1], turned)])[:, None], "out0": d_out.sum().reshape(1)}
        d_h, d_c = np.zeros((2, n, HIDDEN), np.float32), np.zeros((2, n, HIDDEN), np.float32)
        d_pre, g_h = np.zeros((length, 2, n, 4 * HIDDEN), np.float32), np.zeros_like(self.w["h"])
        for t in range(length - 1, -1, -1):
            h, c, gates, u, tc = steps[t]
            i, f, o = (gates[..., k * HIDDEN : (k + 1) * HIDDEN] for k in range(3))
            d_h = d_h + d_hidden[t]
            d_c = d_c + d_h * o * (1 - tc * tc)
            g = d_pre[t]
            g[..., : 3 * HIDDEN] = np.concatenate([d_c * u, d_c * c, d_h * tc], 2) * gates * (1 - gates)
            g[..., 3 * HIDDEN :] = d_c * i * (1 - u * u)
            g_h += h.transpose(0, 2, 1) @ g
            d_h, d_c = g @ self.w["h"].transpose(0, 2, 1), d_c * f
        flat = d_pre.transpose(1, 0, 2, 3).reshape(2, length * n, -1)
        grads |= {"x": x.transpose(1, 3, 0, 2).reshape(2, width, -1) @ flat, "h": g_h, "0": flat.sum(1, keepdims=True)}
        d_ways = d_pre @ self.w["x"].transpose(0, 2, 1)
        d_x = d_ways[:, 0] + d_ways[back, 1, np.arange(n)]
        grads |= {"path": np.zeros_like(self.w["path"]), "words": np.zeros_like(self.w["words"])}
        for name, cut in (("path", slice(0, PATH_SIZE)), ("words", slice(PATH_SIZE, PATH_SIZE + WORD_SIZE))):
            lists = [x for page, _ in batch for x in getattr(page, name)]
            rows = np.concatenate([d_x[: len(page), i, cut] for i, (page, _) in enumerate(batch)])
            sizes = np.array([len(x) for x in lists])
            flat = np.fromiter((j for x in lists for j in x), np.int64, int(sizes.sum()))
            each = np.repeat(rows / np.maximum(1, sizes)[:, None], sizes, axis=0)
            order = np.argsort(flat, kind="stable")
            seen, first = np.unique(flat[order], return_index=True)
            grads[name][seen] = np.add.reduceat(each[order], first, axis=0)
        return grads

    def padded(self, pages: list[Page], sums: dict | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Vectors [block, way, page, size] from the first and from the last block on, and the pages' sizes."""
        sizes = np.array([len(p) for p in pages])
        length = int(sizes.max())
        x = np.zeros((length, 2, len(pages), PATH_SIZE + WORD_SIZE + FIGURES), np.float32)
        vectors, at = self.vectors(pages, sums), 0
        for i, n in enumerate(sizes):
            x[:n, 0, i] = vectors[at : at + n]
            x[:n, 1, i] = vectors[at : at + n][::-1]
            at += n
        return x, sizes

    def label(self, pages: list[Page]) -> list[np.ndarray]:
        """Probability of main text of every block; pages of like length are read together, as many as ``AT_ONCE`` blocks allow."""
        out: list[np.ndarray] = [np.empty(0)] * len(pages)
        order = sorted((i for i, p in enumerate(pages) if len(p)), key=lambda i: len(pages[i]))
        sums: dict = {}
        while order:
            # the longest of the next pages says how many fit; a page beyond the limit is read alone
            n = next(n for n in range(min(128, len(order)), 0, -1) if n == 1 or n * len(pages[order[n - 1]]) <= AT_ONCE)
            part, order = order[:n], order[n:]
            x, sizes = self.padded([pages[i] for i in part], sums)
            p = sigmoid(self.logits(self.run(x)[0], sizes))
            for k, i in enumerate(part):
                out[i] = p[: len(pages[i]), k]
        return out


def turn(length: int, sizes: np.ndarray) -> np.ndarray:
    """[step, page]: the step of the other way that stands at the same block; padding stays in place."""
    steps = np.arange(length)[:, None]
    return np.where(steps < sizes, sizes - 1 - steps, steps)


def training_page(r: random.Random) -> tuple[str, list[bool]]:
    """An invented page and, block by block, whether it is main text."""
    syllables = r.choice((("the", "on", "er", "tion", "ing", "an", "re", "st"), ("der", "ver", "ung", "ein", "sch", "ü", "keit", "ge"), ("que", "ción", "ado", "mente", "ra", "los", "ñ", "es"), ("le", "eau", "ment", "oi", "é", "tre", "ai", "ou"), ("lorem", "ip", "sum", "do", "lor", "sit", "a", "met")))
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randint(1, 3)))
    words = lambda a, b: " ".join(word() for _ in range(r.randint(a, b)))
    sentence = lambda a=4, b=18: words(a, b).capitalize() + r.choice("....!?")
    odd = r.choice((*[lambda t: t] * 8, lambda t: t.replace(" ", " | "), str.upper, lambda t: t.replace(" ", r.choice(("$$$ ", "### ", "!! ", "*** "))), lambda t: " ".join([t.split()[0]] * len(t.split())), lambda t: f"{t} {r.randint(10**8, 10**9)} {word()}@{word()}.example.com"))
    prose = lambda a=1, b=6: odd(" ".join(sentence() for _ in range(r.randint(a, b))))
    out: list[str] = []
    labels: list[bool] = []
    upper, sloppy = r.random() < 0.05, r.random() < 0.5
    named = r.random() < 0.95
    quote = r.choice(('"', '"', '"', "'"))

    def tag(name: str, *classes: str) -> str:
        name = name.upper() if upper else name
        if not classes or not named:
            return f"<{name}>" if r.random() < 0.8 else f"<{name} class={quote}{word()}{quote}>"
        kind = r.choice(("class", "class", "id"))
        return f"<{name} {kind}={quote}{r.choice(classes)}{r.choice(('', '', '', '', '-' + word(), ' ' + word()))}{quote}>"

    def leaf(name: str, text: str, main: bool, *classes: str) -> None:
        if r.random() < 0.15 and len(text) > 20:
            cut = r.randint(5, len(text) - 5)
            text = text[:cut] + r.choice(("<b>", "<em>", "<br>", "<strong>", " &amp; ", "&nbsp;", '<a href="/x">')) + text[cut:]
            text += "</a>" if "<a " in text else ""
        out.append(tag(name, *classes) + text + ("" if sloppy and name in ("p", "li") and r.random() < 0.3 else f"</{name}>"))
        labels.append(main)

    def links(n: int, name: str = "li") -> None:
        for _ in range(n):
            text = r.choice(("Home", "About", "Contact", "News", "Login", "Archive", "Help", "Privacy", "Terms", word().capitalize(), words(1, 4), word() + r.choice(".,")))
            out.append(f'<{name}><a href="/{word()}">{text}</a></{name}>')
            labels.append(False)

    def menu() -> None:
        holder, classes = r.choice((("nav", ()), ("nav", ("menu", "nav", "navbar")), ("div", ("menu", "nav", "navigation", "topnav", "breadcrumb")), ("ul", ("menu", "nav", "tabs"))))
        out.append(tag(holder, *classes) + ("<ul>" if holder != "ul" else ""))
        links(r.randint(2, 9))
        out.append(("</ul>" if holder != "ul" else "") + f"</{holder}>")

    def group(holder: str, classes: tuple, parts) -> None:
        out.append(tag(holder, *classes))
        parts()
        out.append(f"</{holder}>")

    def header() -> None:
        holder, classes = r.choice((("header", ()), ("header", ("header", "site-header", "masthead")), ("div", ("header", "masthead", "logo", "banner", "top"))))
        group(holder, classes, lambda: (leaf(r.choice(("div", "p", "h1", "h2")), r.choice((words(1, 4), sentence(3, 8))), False, "logo", "title", "tagline", "site-title"), r.random() < 0.5 and menu()))

    def footer() -> None:
        holder, classes = r.choice((("footer", ()), ("footer", ("footer", "site-footer")), ("div", ("footer", "bottom", "copyright", "legal"))))

        def parts() -> None:
            text = r.choice((f"&copy; {word()}.example.com &middot; {prose(1, 2)}", f"© {r.randint(1999, 2030)} {words(1, 3)}. All rights reserved.", prose(1, 2), "Privacy policy | Terms of use | Contact", "Imprint", "Powered by " + word()))
            if r.random() < 0.4:
                out.append(text)
                labels.append(False)
            else:
                leaf(r.choice(("p", "div", "small")) if r.random() < 0.9 else "p", text, False)
            if r.random() < 0.3:
                group("ul", ("links",), lambda: links(r.randint(2, 5)))

        group(holder, classes, parts)

    def sidebar() -> None:
        holder, classes = r.choice((("aside", ()), ("aside", ("sidebar", "related")), ("div", ("sidebar", "widget", "related", "right", "side", "recommended", "popular"))))
        group(holder, classes, lambda: (leaf(r.choice(("h3", "h4", "h2", "p")), r.choice(("Related", "Popular", "More stories", "Latest news", "About the author", words(1, 4))), False),
                                        [leaf(r.choice(("p", "li", "div")), r.choice((prose(1, 3), words(2, 6))), False) for _ in range(r.randint(0, 3))], r.random() < 0.5 and group("ul", (), lambda: links(r.randint(2, 6)))))

    def notice() -> None:
        holder, classes = r.choice((("div", ("cookie", "cookie-notice", "notice", "consent", "gdpr", "alert", "banner", "popup", "modal", "announcement", "warning", "disclaimer")), ("section", ("notice", "alert", "cookies"))))
        text = r.choice(("We use cookies to improve your experience. Accept", "This site uses cookies.", "Please subscribe to continue reading.", "Enable JavaScript to view this page.", prose(1, 2), sentence()))
        if r.random() < 0.5:
            leaf(holder, text, False, *classes)
        else:
            group(holder, classes, lambda: (leaf("p", text, False), r.random() < 0.4 and leaf("button", r.choice(("Accept", "OK", "Close", word())), False)))

    def advert() -> None:
        holder, classes = r.choice((("div", ("ad", "ads", "advert", "advertisement", "sponsored", "promo", "banner-ad", "ad-slot")), ("aside", ("ad", "promo", "sponsor")), ("section", ("ad", "sponsored", "promotion")), ("ins", ("adsbygoogle",))))
        holder = "div" if holder == "ins" else holder
        text = r.choice((prose(1, 3), sentence(), "Advertisement", "Buy now! Save 50%", "Sponsored: " + sentence(), "Sale " + words(1, 5)))
        if r.random() < 0.6:
            leaf(holder, text, False, *classes)
        else:
            group(holder, classes, lambda: leaf("p", text, False))

    def form() -> None:
        def parts() -> None:
            leaf(r.choice(("p", "h3", "legend", "div")), r.choice(("Newsletter", "Search", "Sign up for our newsletter", "Leave a reply", "Your e-mail", "Contact us", prose(1, 1), words(1, 4))), False)
            if r.random() < 0.5:
                leaf("p", f'<label>{r.choice(("Name", "E-mail", "Password", word()))}</label> <input name="q">', False)
            if r.random() < 0.6:
                leaf("button", r.choice(("Send", "Search", "Subscribe", "Submit", word())), False)
            if r.random() < 0.2:
                group("select", (), lambda: [leaf("option", word(), False) for _ in range(r.randint(2, 5))])

        group("form", r.choice(((), ("search", "newsletter", "form", "signup", "subscribe"))), parts)

    def comments() -> None:
        def one(holder: str) -> None:
            def parts() -> None:
                if r.random() < 0.6:
                    leaf(r.choice(("div", "h4", "p")), r.choice((word().capitalize() + " says:", words(1, 2), f"{word()} wrote on {r.randint(1, 28)}.{r.randint(1, 12)}.2020", "Anonymous")), False, "author", "meta", "comment-author")
                for _ in range(r.randint(1, 2)):
                    leaf("p", prose(1, 4), False)
                if r.random() < 0.3:
                    leaf(r.choice(("div", "p")), '<a href="#">Reply</a>', False, "reply")

            if r.random() < 0.25:
                leaf(holder, prose(1, 3), False, "comment", "reply", "comment-body")
            else:
                group(holder, ("comment", "comment-body", "reply", "response"), parts)

        def parts() -> None:
            if r.random() < 0.7:
                leaf(r.choice(("h2", "h3")), r.choice(("Comments", f"{r.randint(2, 90)} comments", "Discussion", "Reader comments", "Responses", words(1, 2))), False)
            kind = r.choice(("div", "li", "article", "section", "div")) if named else "li"
            for _ in range(r.randint(1, 6)):
                one(kind)

        bare = r.random() < 0.15
        group(*r.choice((("section", ()), ("div", ())) if bare else (("section", ("comments", "comment-list", "discussion", "responses")), ("div", ("comments", "comment-list", "disqus", "discussion", "replies")), ("ol", ("comments", "commentlist")))), parts)

    def article() -> None:
        holder, classes = r.choice((("article", ()), ("article", ()), ("article", ("post", "article", "entry", "story")), ("main", ()), ("main", ("content", "main")), ("div", ("content", "post", "entry-content", "article-body", "story", "main", "text", "body")), ("section", ("content", "article", "post"))))

        def parts() -> None:
            title = r.choice((words(3, 10).capitalize(), sentence(3, 10), prose(1, 2)[:60]))
            if r.random() < 0.85:
                if r.random() < 0.15:
                    group("header", (), lambda: leaf("h1", title, True))
                else:
                    leaf(r.choice(("h1", "h1", "h2")), title, True, *r.choice(((), ("title", "headline"))))
            plain = r.random() < 0.4
            for _ in range(r.choice((1, 2, 3, 5, 8, 14, 25))):
                x = r.random() * (0.66 if plain else 1)
                if x < 0.60:
                    leaf("p", prose(1, r.choice((1, 2, 6, 14))), True)
                elif x < 0.66:
                    leaf("p", r.choice((words(1, 3), word().capitalize() + ".", sentence(1, 4))), True)
                elif x < 0.72:
                    leaf(r.choice(("h2", "h3")), words(1, 7), True)
                elif x < 0.75:
                    group("dl", (), lambda: [(leaf("dt", words(1, 4), True), leaf("dd", r.choice((prose(1, 2), words(2, 8))), True)) for _ in range(r.randint(1, 4))])
                elif x < 0.78:
                    group("figure", (), lambda: (out.append('<img src="x.png">'), leaf("figcaption", r.choice((sentence(), words(2, 6))), True)))
                elif x < 0.83:
                    group(r.choice(("ul", "ol")), (), lambda: [leaf("li", r.choice((sentence(), words(1, 6))), True) for _ in range(r.randint(2, 6))])
                elif x < 0.87:
                    group("blockquote", (), lambda: leaf("p", prose(1, 3), True)) if r.random() < 0.6 else leaf("blockquote", prose(1, 2), True)
                elif x < 0.89:
                    group("table", (), lambda: [group("tr", (), lambda: [leaf("td", words(1, 3), True) for _ in range(r.randint(2, 4))]) for _ in range(r.randint(1, 3))])
                elif x < 0.91:
                    leaf("pre", words(3, 20), True)
                elif x < 0.93:
                    group("div", (), lambda: [leaf("p", prose(1, 3), True) for _ in range(r.randint(1, 3))])
                elif x < 0.955:
                    advert()
                elif x < 0.965:
                    leaf("div", r.choice(("Share", "Tweet", "Print", "Facebook Twitter")), False, "share", "social", "tools")
                elif x < 0.975:
                    sidebar()
                elif x < 0.98:
                    form()
                else:
                    leaf("p", f'<b>{prose(1, 3)}<br>', True)

        if r.random() < 0.12:
            out.append("<div>" if r.random() < 0.5 else "")
            parts()
            out.append("</div>" if out[-1] else "")
        else:
            group(holder, classes, parts)

    head = words(2, 8)
    out.append(f"<!DOCTYPE html><html><head><title>{head}</title><style>p{{margin:0}}</style><script>var t=\"</p>\";</script></head><body>")
    labels.append(False)
    before, after = [menu, header, notice, advert, form, sidebar], [footer, sidebar, comments, comments, comments, advert, form, notice, menu, footer]
    for part in r.sample(before, r.randint(0, 4)):
        part()
    wrapped = r.random() < 0.4
    out.append(tag("div", "container", "wrapper", "page", "wrap") if wrapped else "")
    article()
    inner = r.random() < 0.5
    out.append("</div>" if wrapped and not inner else "")
    for part in r.sample(after, r.randint(0, 5)):
        part()
    out.append("</div>" if wrapped and inner else "")
    out.append("</body></html>" if r.random() < 0.7 else "")
    return r.choice(("", "", "\n")).join(out), labels


def training_pages(n: int, seed: int) -> list[tuple[Page, np.ndarray]]:
    r, out, paths, known = random.Random(seed), [], Slots(path_slots), Slots(word_slot)
    while len(out) < n:
        page, labels = training_page(r)
        found = blocks(page)
        if len(found) == len(labels) <= LONGEST:  # an invented page whose sloppy tags merge blocks has no labels
            out.append((Page(found, paths, known), np.array(labels, np.float32)))
    return out


@cache
def trained() -> Labeller:
    return Labeller().fit(training_pages(TRAINING_PAGES, 3))


def main_texts(pages: list[str], labeller: Labeller) -> list[str]:
    places, known = Places(), Slots(word_slot)
    found = [blocks(p, places) for p in pages]
    chosen = labeller.label([Page(f, None, known) for f in found])
    return ["\n".join(b.text for b, p in zip(f, c) if p >= 0.5) for f, c in zip(found, chosen)]


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars): the main text of every page."""
    labeller = trained()

    def make(part: pa.RecordBatch) -> dict:
        found = main_texts(common.texts(part.column("html")), labeller)
        return {"page_id": part.column("page_id"), "url": part.column("url"), "text": found, "n_chars": [len(t) for t in found]}

    return common.map_rows(
        pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html")),
        "page_id long, url string, text string, n_chars long", "html", make)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(common.table(spark, sf_dir, "pages"))
