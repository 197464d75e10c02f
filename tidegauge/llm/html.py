"""HTML extraction by a recurrent block labeller.

A page becomes the sequence of its leaf blocks: stretches of text between block-level tags, each with its tag path (names, classes,
ids and roles of the open elements). Hashed vectors of path and words, and a few plain measures, go through a bidirectional LSTM
written in numpy, so every block is judged with the whole page in view; blocks judged content make the text.

The labeller is trained here, on pages that a generator writes in many layouts with known content; nothing is learnt from the table
that is extracted. Training takes about twenty seconds and gives the same weights each time.

A page is content or not by what holds it: menus, headers outside the article, notices, adverts, forms and readers' comments in elements of
their own go, also inside the article. A plain paragraph inside the article's element stays, whatever it says; where the article has no
element of its own, such lines are told by their wording.

Null and empty html: empty text. Text outside all tags is a block too. Unclosed and stray tags are tolerated. Rows are
handled one by one, so repeated rows and ids don't matter.
"""

from __future__ import annotations

import functools
import html as entities
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare, rows

PATH, WORD_DIM, PLAIN = 192, 192, 6
HIDDEN = 16
#: Pages that training takes at once.
BATCH = 60
#: Blocks of pages that the labeller reads together; longer pages are read alone.
BATCH_BLOCKS = 4096
#: Blocks of a page whose vectors are held at once; the state goes from one stretch to the next, so a page may have any number of them.
STRETCH = 2048

_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>", re.S)
_NAME = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_ATOM = re.compile(r"[a-z]+")
_WORD = re.compile(r"[^\W_]+|[©®™»›→]")
#: Elements that don't end a block.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
#: Elements whose content isn't text.
HIDDEN_TEXT = frozenset("script style noscript template title head svg iframe object canvas audio video select textarea".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that open anew instead of nesting, with what they close.
CLOSES = {"p": ("p",), "li": ("li", "p"), "dt": ("dt", "dd", "p"), "dd": ("dt", "dd", "p"), "tr": ("tr", "td", "th", "p"), "td": ("td", "th", "p"), "th": ("td", "th", "p"), "option": ("option",)}
_CLOSED_BY_NEXT = frozenset("p li dt dd tr td th".split())
_BLOCK_END_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol pre section table ul".split())


def _atoms(attributes: str) -> tuple:
    return tuple(a for x in _NAME.findall(attributes) for a in _ATOM.findall("".join(x).lower()))


def blocks(page: str) -> list[tuple[tuple, str, float]]:
    """(path, text, share of link characters) of the page's leaf blocks; path: (tag, atoms of class, id and role) of each open element."""
    out: list = []
    stack: list = []  # (tag, atoms)
    text: list = []
    linked, in_link, hidden = 0, 0, 0
    at, n = 0, len(page)

    def flush():
        nonlocal linked
        if text:
            t = " ".join("".join(text).split())
            if t:
                out.append((tuple(x for x in stack if x[0] not in INLINE), t, min(1.0, linked / len(t))))
            text.clear()
        linked = 0

    def add(piece: str):
        nonlocal linked
        if piece and not hidden:
            if "&" in piece:
                piece = entities.unescape(piece)
            text.append(piece)
            if in_link:
                linked += len(piece.strip())

    while at < n:
        m = _TOKEN.search(page, at)
        if not m:
            add(page[at:])
            break
        add(page[at : m.start()])
        at = m.end()
        tag = m[2]
        if tag is None:
            if m[0].startswith("<![CDATA["):
                add(m[0][9:].removesuffix("]]>"))
            continue
        tag = tag.lower()
        if m[1]:
            if tag not in INLINE:
                flush()
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    # what is open inside ends too, but an inline end tag reaches no further than its block
                    if tag in INLINE and any(x[0] not in INLINE for x in stack[k:]):
                        break
                    for x in stack[k:]:
                        in_link -= x[0] == "a"
                        hidden -= x[0] in HIDDEN_TEXT
                    del stack[k:]
                    break
            continue
        if tag not in INLINE:
            flush()
            if tag in _BLOCK_END_P or tag in CLOSES:
                close = CLOSES.get(tag, ("p",))
                while stack and (stack[-1][0] in INLINE or stack[-1][0] in close):
                    in_link -= stack.pop()[0] == "a"
        elif tag == "a" and in_link:
            stack[:] = [x for x in stack if x[0] != "a"]
            in_link = 0
        if tag in VOID or m[3].endswith("/"):
            if tag == "img":
                add(" ")
            continue
        if tag == "body":  # an unclosed head ends here
            stack[:] = [x for x in stack if x[0] not in HIDDEN_TEXT]
            hidden = 0
        if tag in ("script", "style", "textarea", "title"):
            end = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            at = end.end() if end else n
            continue
        stack.append((tag, _atoms(m[3]) if m[3] else ()))
        in_link += tag == "a"
        hidden += tag in HIDDEN_TEXT
    flush()
    return out


@functools.lru_cache(100_000)
def _slot(word: str, size: int) -> tuple[int, float]:
    h = zlib.crc32(word.encode())
    return h % size, 1.0 if h >> 16 & 1 else -1.0


@functools.lru_cache(10_000)
def _path_vector(path: tuple) -> np.ndarray:
    v = np.zeros(PATH)
    for depth, (tag, atoms) in enumerate(reversed(path)):
        weight = 1.0 if depth < 3 else 0.6
        for word in (f"<{tag}", *(f".{a}" for a in atoms)):
            for probe in ("a", "b", "c"):
                k, sign = _slot(probe + word, PATH)
                v[k] += sign * weight
    return v


def features(leaves: list, at: int = 0, end: int | None = None) -> np.ndarray:
    """Vectors of the leaves from at up to end. Every word of a block counts; a block's word vector has length one, but for words that share a slot."""
    n, part = len(leaves), leaves[at:end]
    x = np.zeros((len(part), PATH + WORD_DIM + PLAIN))
    plain, place, weight = [], [], []
    for i, (path, text, links) in enumerate(part):
        x[i, :PATH] = _path_vector(path)
        seen = Counter(_WORD.findall(text.lower()))
        size = text.count(" ") + 1
        length = sum(c * c for c in seen.values()) ** 0.5
        for w, c in seen.items():
            k, sign = _slot(w, WORD_DIM)
            place.append(i * x.shape[1] + PATH + k)
            weight.append(sign * c / length)
        plain.append((size, links, text[-1:] in ".!?…", text.count(",") / size, (at + i) / n, len(text) / size / 10))
    np.add.at(x.reshape(-1), place, weight)
    if part:
        x[:, -PLAIN:] = plain
    x[:, -PLAIN] = np.log1p(x[:, -PLAIN]) / 4
    return x


class Labeller:
    """A bidirectional LSTM and a logistic output for each block."""

    def __init__(self, seed: int = 11):
        r, d = np.random.default_rng(seed), PATH + WORD_DIM + PLAIN
        self.p = {}
        for way in "fb":
            self.p[f"w{way}"] = r.normal(0, 1 / np.sqrt(d + HIDDEN), (d + HIDDEN, 4 * HIDDEN))
            self.p[f"c{way}"] = np.concatenate([np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)])
        self.p["o"] = r.normal(0, 0.3, 2 * HIDDEN)
        self.p["b"] = np.zeros(1)

    @staticmethod
    def _gates(z):
        s = 1 / (1 + np.exp(-np.clip(z[:, : 3 * HIDDEN], -30, 30)))
        return s[:, :HIDDEN], s[:, HIDDEN : 2 * HIDDEN], s[:, 2 * HIDDEN :], np.tanh(z[:, 3 * HIDDEN :])

    def _pass(self, x, mask, way, state=None, keep=None):
        """x: (time, page, feature). Outputs by time, and the state after the last step; keep is given what the gradient needs."""
        w, c = self.p[f"w{way}"], self.p[f"c{way}"]
        t_n, n, d = x.shape
        h, s = state or (np.zeros((n, HIDDEN)), np.zeros((n, HIDDEN)))
        xw = (x.reshape(-1, d) @ w[:d] + c).reshape(t_n, n, -1)
        out = np.zeros((t_n, n, HIDDEN))
        for t in range(t_n) if way == "f" else range(t_n - 1, -1, -1):
            i, f, o, g = self._gates(xw[t] + h @ w[d:])
            m = mask[t][:, None]
            new = f * s + i * g
            tanh = np.tanh(new)
            if keep is not None:
                keep.append((t, h, s, i, f, o, g, tanh, m))
            s = np.where(m, new, s)
            h = np.where(m, o * tanh, h)
            out[t] = h
        return out, (h, s)

    def __call__(self, pages: list[list]) -> np.ndarray:
        """(time, page): the probability of content of every leaf. Vectors are made a stretch at a time, so a page's memory is that of its
        leaves and of one number for each."""
        longest = max(map(len, pages))
        starts = range(0, longest, STRETCH)
        z = np.full((longest, len(pages)), self.p["b"][0])
        made = None
        for way, order, part in (("f", starts, self.p["o"][:HIDDEN]), ("b", reversed(starts), self.p["o"][HIDDEN:])):
            state = None
            for at in order:
                if made is None or len(starts) > 1:
                    made = padded([features(p, at, at + STRETCH) for p in pages])
                out, state = self._pass(*made, way, state)
                z[at : at + STRETCH] += out @ part
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def gradient(self, x, mask, y):
        kf, kb = [], []
        f, b = self._pass(x, mask, "f", keep=kf)[0], self._pass(x, mask, "b", keep=kb)[0]
        both = np.concatenate([f, b], 2)
        prob = 1 / (1 + np.exp(-np.clip(both @ self.p["o"] + self.p["b"], -30, 30)))
        e = np.where(mask, prob - y, 0) / mask.sum()
        grad = {"o": np.einsum("tn,tnh->h", e, both), "b": np.array([e.sum()])}
        d = x.shape[2]
        for way, kept, part in (("f", kf, self.p["o"][:HIDDEN]), ("b", kb, self.p["o"][HIDDEN:])):
            u = self.p[f"w{way}"][d:].T
            all_dz, before = np.zeros((*mask.shape, 4 * HIDDEN)), np.zeros_like(f)
            dh, ds = np.zeros(f.shape[1:]), np.zeros(f.shape[1:])
            for t, h, s, i, fg, o, g, tanh, m in reversed(kept):
                dh = dh + e[t][:, None] * part
                dn = np.where(m, ds + dh * o * (1 - tanh**2), 0)
                dz = np.concatenate([dn * g * i * (1 - i), dn * s * fg * (1 - fg), np.where(m, dh * tanh, 0) * o * (1 - o), dn * i * (1 - g**2)], 1)
                all_dz[t], before[t] = dz, h
                dh = np.where(m, dz @ u, dh)
                ds = np.where(m, dn * fg, ds)
            flat = all_dz.reshape(-1, 4 * HIDDEN)
            grad[f"w{way}"], grad[f"c{way}"] = np.concatenate([x.reshape(-1, d).T @ flat, before.reshape(-1, HIDDEN).T @ flat]), flat.sum(0)
        return grad


#: Names that layouts use. Common words in tag attributes.
_CHROME = {
    "nav": ("menu", "navbar", "nav", "breadcrumb", "navigation", "toc"), "header": ("header", "masthead", "banner", "top", "branding"), "footer": ("footer", "bottom", "copyright", "legal"),
    "aside": ("sidebar", "related", "widget", "side", "rail", "recommended"),
    "div": ("ad", "ads", "advert", "sponsored", "promo", "cookie", "notice", "consent", "newsletter", "share", "social", "popup", "alert", "menu", "sidebar", "footer", "header", "comments", "disclaimer", "related"),
    "form": ("search", "login", "subscribe", "form", "contact"), "section": ("comments", "comment", "discussion", "replies", "related", "cookie", "promo", "responses"),
}
_CONTENT = (("article", ""), ("main", ""), ("div", "content"), ("div", "article body"), ("div", "post"), ("div", "entry content"), ("section", "story"), ("main", "article"), ("article", "post"), ("div", "main text"))
#: What such parts say. Usual wordings; a name in capitals is replaced by an invented one.
_SAID = {
    "nav": ("Home", "About us", "Contact", "News", "Sign in", "Log in", "Register", "Products", "Skip to content", "Menu", "Search", "Next »", "« Previous", "Home › NAME › NAME", "All topics", "Help", "FAQ", "Archive"),
    "notice": (
        "We use cookies to improve your experience.", "This site uses cookies. By continuing you accept our use of cookies.", "Accept all cookies", "Reject all", "Manage preferences", "Please enable JavaScript to view this page.",
        "Your privacy is important to us. Read our privacy policy.", "You have read all your free articles this month. Subscribe to continue reading.", "By using this website you agree to our terms of service.",
    ),
    "advert": (
        "Advertisement", "Sponsored content", "Sponsored by NAME", "Buy now and save 50%!", "Limited time offer: order NAME today", "Shop the sale", "Click here to claim your free trial", "Advertisement: NAME for only 9.99, free shipping",
        "Save 20% on NAME with our discount code", "Download our app", "Ad",
    ),
    "form": ("Sign up for our newsletter", "Enter your email address", "Subscribe", "Search this site", "Your name", "Password", "Submit", "Get the latest news in your inbox", "Send message", "Join our mailing list"),
    "comment": ("Leave a comment", "3 comments", "NAME says:", "Reply", "Posted by NAME 2 days ago", "Great post, thanks for sharing!", "Thanks, this helped me a lot", "I totally disagree with this comment", "Log in to reply", "Report this comment", "Add a comment"),
    "footer": ("© 2024 NAME. All rights reserved.", "Copyright NAME Ltd", "Privacy policy", "Terms of use", "Imprint", "Powered by NAME", "Back to top", "Follow us on social media", "Share this article", "Share", "Tweet", "Print"),
    "sidebar": ("Related articles", "You may also like", "Most popular", "Read more", "Recommended for you", "Trending now", "Latest posts", "Recent comments", "Tags", "See also: NAME", "Read next: NAME"),
}
_KIND = {"nav": ("nav",), "header": ("nav", "notice"), "footer": ("footer", "nav"), "aside": ("sidebar", "advert"), "div": tuple(_SAID), "form": ("form",), "section": ("comment", "notice", "sidebar")}
#: Words that join others in running text. Common ones of four languages.
_JOINING = "the of and to in is it for was on that with as by this are from el la de que y en los las un por con es se del le les des et est une dans pour qui der die das und ist von mit den ein zu nicht auf".split()


_TOLD = [w for x in _SAID.values() for y in x for w in y.split() if w != "NAME"]


@functools.lru_cache(1)
def _invented(n: int = 20_000) -> np.ndarray:
    r = np.random.default_rng(5)
    letters = np.array(list("eeettaaooiinnsshhrrddlluccmmfwyppvbgkéèñóüçäößzjqx"))[r.integers(0, 50, (n, 10))]
    tail = np.where(r.random(n) < 0.1, r.integers(0, 2000, n).astype(str), "")  # numbers, alone or behind letters
    return np.array([("" if t and k % 2 else "".join(w[:k])) + t for w, k, t in zip(letters, r.integers(1, 11, n), tail, strict=True)], object)


def synthetic_page(r: np.random.Generator) -> tuple[str, list[int]]:
    """A page with a random layout, and for each of its blocks in order 1 for content and 0 for anything else. Layouts differ in the element
    that holds the article, or have none; parts that aren't content also stand inside it; where the article has no element of its own, some show it by their wording alone."""
    label: list[int] = []

    def count(lo, hi):
        return int(r.integers(lo, hi))

    # a page's own language: some of the invented words, some far oftener than others
    known, lean = _invented()[r.integers(0, len(_invented()), count(10, 40) * 3 ** count(0, 5))], r.uniform(1, 4)

    def invented(n=1):
        return known[(len(known) * r.random(n) ** lean).astype(int)].tolist()

    joining, short = r.choice([0, 0.2, 0.4]), r.choice([0, 0.2, 0.5])

    def words(lo, hi):
        n = count(lo, hi)
        w = [str(_JOINING[int(j)]) if u < joining else x for x, u, j in zip(invented(n), r.random(n), r.integers(0, len(_JOINING), n), strict=True)]
        if r.random() < 0.06:  # articles name such things too
            w.insert(count(0, n + 1), str(r.choice(_TOLD)))
            w += invented(count(4, 20))
        commas = r.random(len(w)) < 0.08
        text = " ".join(x + ("," if c else "") for x, c in zip(w, commas, strict=True))
        return (text[:1].upper() + text[1:]) + ("." if r.random() < 0.8 else "")

    def said(kind):
        return str(r.choice(_SAID[kind])).replace("NAME", invented()[0].capitalize())

    def other(kind, lo, hi):
        """What such a part says, or anything: names of rubrics, teasers, readers' opinions."""
        u = r.random()
        return words(lo, hi) if u < 0.5 else said(kind) + (" " + words(2, 12) if u > 0.9 else "")

    def block(tag, text, y, attr=""):
        label.append(y)
        return f"<{tag}{attr}>{text}" + (f"</{tag}>" if tag not in _CLOSED_BY_NEXT or r.random() < 0.9 else "")

    def chrome(tag):
        a, k = str(r.choice(["class", "id"])), str(r.choice(_CHROME[tag]))
        attr = "" if tag not in ("div", "section") and r.random() < 0.4 else f' {a}="{k}{r.choice(["", "-wrap", " box", "-1"])}"'
        kind = str(r.choice(_KIND[tag]))
        u = r.random()
        if tag == "nav" or u < 0.3:
            inner = "<ul>" + "".join(block("li", f'<a href="/x">{other(kind, 1, 4)}</a>', 0) for _ in range(count(1, 8))) + "</ul>"
        elif u < 0.6:
            inner = other(kind, 2, 30)
            label.append(0)
        else:
            inner = "".join(block(str(r.choice(["p", "div", "h3", "p", "fieldset", "button"] if tag == "form" else ["p", "div", "h3"])), other(kind, 2, 60), 0) for _ in range(count(1, 5)))
        return f"<{tag}{attr}>{inner}</{tag}>"

    def piece():
        """A part of the article."""
        u = r.random()
        if u < 0.57:
            return block(str(r.choice(["p", "p", "p", "p", "p", "div"])), words(1, 8 if r.random() < short else 90), 1)
        if u < 0.64:
            return block(str(r.choice(["h2", "h3", "h4"])), words(1, 8), 1)
        if u < 0.69:
            label.append(1)
            return f"<p><b>{words(1, 12)}<br>" + (" </p>" if r.random() < 0.5 else "")
        if u < 0.78:
            k = str(r.choice(["ul", "ol"]))
            return f"<{k}>" + "".join(block("li", words(2, 20), 1) for _ in range(count(1, 5))) + f"</{k}>"
        if u < 0.81:
            return block("blockquote", words(5, 40), 1)
        if u < 0.84:
            return "<table>" + "".join("<tr>" + "".join(block("th" if not i else "td", words(1, 6), 1) for _ in range(count(1, 4))) + "</tr>" for i in range(count(1, 5))) + "</table>"
        if u < 0.86:
            return block("pre", words(3, 40), 1)
        if u < 0.89:
            return "<figure><img src='x'>" + block("figcaption", words(2, 15), 1) + "</figure>"
        if u < 0.91:
            return "<dl>" + "".join(block("dt", words(1, 4), 1) + block("dd", words(2, 20), 1) for _ in range(count(1, 4))) + "</dl>"
        if u < 0.93:
            return "<section>" + block("h2", words(1, 8), 1) + block("p", words(5, 60), 1) + "</section>"
        if u < 0.96:
            return chrome(str(r.choice(["div", "aside", "form", "div", "section", "nav", "footer"])))
        # without an element of its own the article is told from such lines by their wording alone; inside one they are its text
        return block(str(r.choice(["p", "div"] if bare else ["p"])), said(str(r.choice(["notice", "advert", "sidebar", "form", "footer"]))), 0 if bare else 1)

    if r.random() < 0.1:  # text without tags, or little more
        label.append(1)
        return str(r.choice(["{}", "<p>{}</p>", "<body>{}</body>", "<html><body><div>{}</div></body></html>"])).format(words(1, 8 if r.random() < 0.3 else 60)), label
    bare = r.random() < 0.2
    parts = ["<!DOCTYPE html><html><head><title>", words(3, 9), "</title><style>p{margin:0}</style></head><body>"] if r.random() < 0.85 else ["<html><body>"] if r.random() < 0.5 else []
    kinds = [*_CHROME, "div", "div"]  # most often it is a div that a name alone tells
    around = 1 if r.random() < (0.4 if bare else 0.12) else 6
    wrap = "<div class='page'>" if r.random() < 0.15 else ""
    parts.append(wrap)
    for k in r.choice(kinds, count(0, around)):
        parts.append(chrome(str(k)))
    tag, attr = _CONTENT[count(0, len(_CONTENT))]
    if not bare:
        parts.append(f"<{tag}" + (f' class="{attr}"' if attr else "") + ">")
    u = r.random()
    if u < 0.6:
        parts.append(block("h1", words(2, 12), 1))
    elif u < 0.75 and not bare:
        parts.append("<header>" + block("h1", words(2, 12), 1) + (block("p", words(2, 12), 1) if r.random() < 0.5 else "") + "</header>")
    parts += [piece() for _ in range(count(1, 16))]
    if 1 not in label:
        parts.append(block("p", words(5, 60), 1))
    if not bare:
        parts.append(f"</{tag}>")
    for k in r.choice(kinds, count(0, around)):
        parts.append(chrome(str(k)))
    parts.append("</div>" if wrap else "")
    return "".join(parts) + ("</body></html>" if r.random() < 0.9 else ""), label


def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    longest = max(len(x) for x in pages)
    x, mask = np.zeros((longest, len(pages), pages[0].shape[1])), np.zeros((longest, len(pages)), bool)
    for k, p in enumerate(pages):
        x[: len(p), k] = p
        mask[: len(p), k] = True
    return x, mask


@functools.lru_cache(1)
def trained(pages: int = 1800, epochs: int = 11, seed: int = 23) -> Labeller:
    """The labeller, trained with Adam on synthetic pages; the same in every process."""
    r, model = np.random.default_rng(seed), Labeller()
    data = []
    while len(data) < pages:
        page, y = synthetic_page(r)
        leaves = blocks(page)
        if len(leaves) == len(y) and y:
            data.append((features(leaves).astype(np.float32), np.array(y, float)))
    m, v, step = {k: np.zeros_like(a) for k, a in model.p.items()}, {k: np.zeros_like(a) for k, a in model.p.items()}, 0
    mean, taken = {k: np.zeros_like(a) for k, a in model.p.items()}, 0  # of the last three epochs' weights
    for epoch in range(epochs):
        # pages of like length together, since a batch costs as much as its longest; batches in any order
        order = np.argsort([len(d[1]) * r.uniform(0.8, 1.25) for d in data])
        for i in BATCH * r.permutation(-(-len(data) // BATCH)):
            batch = [data[k] for k in order[i : i + BATCH]]
            x, mask = padded([b[0] for b in batch])
            y = np.zeros(mask.shape)
            for k, b in enumerate(batch):
                y[: len(b[1]), k] = b[1]
            step += 1
            rate = 0.02 * (1 - epoch / epochs) + 0.001
            for k, g in model.gradient(x, mask, y).items():
                g = np.clip(g, -1, 1)
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                model.p[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
            if epoch >= epochs - 3:
                for k, a in model.p.items():
                    mean[k] += a
                taken += 1
    model.p = {k: a / taken for k, a in mean.items()}
    return model


def label(model: Labeller, pages: list[list]) -> list[np.ndarray]:
    """For each page's leaves, the probability of content; pages of like length are read together."""
    out: list = [np.zeros(0)] * len(pages)
    order = [k for k in sorted(range(len(pages)), key=lambda k: len(pages[k])) if pages[k]]
    i = 0
    while i < len(order):
        j = i + 1
        while j < len(order) and len(pages[order[j]]) * (j + 1 - i) <= BATCH_BLOCKS:
            j += 1
        p = model([pages[k] for k in order[i:j]])
        for k, q in enumerate(order[i:j]):
            out[q] = p[: len(pages[q]), k]
        i = j
    return out


_PAGE = [("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64()), ("n_blocks", pa.int64())]


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars, n_blocks (of the page in all) of every row of pages."""
    prepare(pages.sparkSession)
    weights = {k: v.copy() for k, v in trained().p.items()}

    def run(batches):
        model = Labeller()
        model.p = weights
        for b in batches:
            for i in range(0, len(b), 200):
                part = b.slice(i, 200)
                leaves = [blocks(x or "") for x in part.column("html").to_pylist()]
                texts = ["\n".join(t for (_, t, _), q in zip(x, p, strict=True) if q >= 0.5) for x, p in zip(leaves, label(model, leaves), strict=True)]
                yield rows(_PAGE, page_id=part.column("page_id"), url=part.column("url"), text=texts, n_chars=[len(t) for t in texts], n_blocks=[len(x) for x in leaves])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html").mapInArrow(run, "page_id long, url string, text string, n_chars long, n_blocks long")
