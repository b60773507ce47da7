"""HTML extraction with a recurrent block labeller.

A tolerant scanner turns a page into its leaf blocks: runs of text between
block-level tags, each with the path of open elements. A bidirectional LSTM in numpy
reads the sequence of all blocks of a page, each as a hashed vector of its tag path (names,
classes, ids), a hashed vector of all its words and a few numbers, and labels each block as
main text or not in the light of the whole page. Blocks labelled main text are the result.

The network is trained here, on the driver, on pages made by a seeded generator that
knows which block is what (menus, headers, notices, adverts, forms, sidebars, related
links, comments and footers around and inside articles of many layouts). It is trained once
in a process and sent to the executors; its size is fixed. Nothing is shuffled.

Defined results: null or empty html, and pages without main text, give an empty text;
unclosed and misplaced tags are closed as browsers do for paragraphs, items and cells; a page cut off
anywhere is read as far as it goes; markup left open at the end is dropped; equal rows give
equal results; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import random
import re
from collections.abc import Iterator
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relquery.llm.common import LOWER, SPACE, in_arrow, span_hashes, table, texts_of, word_spans

BLOCK_TAGS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html label legend li main menu nav ol optgroup option p pre search section select summary table tbody td textarea tfoot th thead title tr ul".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is not read; unclosed ones of the first line hold the rest of the page, others nothing.
_UNREAD = frozenset("script style".split() + "template svg math iframe object canvas noscript".split())
_SWALLOWS = frozenset("script style".split())
#: Open elements that are kept (as in browsers) and that a block's path names.
DEPTH, PATH = 512, 32
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
#: Where a tag ends, or a quoted value in it begins.
_STOP = re.compile(r">|=\s*([\"'])")
_NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_PARTS = re.compile(r"[a-z]+|[0-9]+")
#: What a start tag closes, and where the search for it ends.
_CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
PATH_DIM, LEAF_DIM, WORD_DIM, NUMBERS = 192, 96, 48, 8
INPUT = PATH_DIM + LEAF_DIM + WORD_DIM + NUMBERS


class Block:
    __slots__ = ("linked", "path", "text")

    def __init__(self, text: str, path: tuple[str, ...], linked: int) -> None:
        self.text, self.path, self.linked = text, path, linked


class _Scanner:
    """The tags of a page in order, in time linear in its length: every search goes forward from where the last one
    ended, and what was not found once is not looked for again."""

    def __init__(self, page: str) -> None:
        self.page = page
        self.none: set[str] = set()  # what does not occur in the rest of the page

    def _find(self, what: str, at: int) -> int:
        if what in self.none:
            return -1
        found = self.page.find(what, at)
        if found < 0:
            self.none.add(what)
        return found

    def _end(self, at: int) -> int:
        """Behind the ``>`` of a start tag; -1 if it stays open. A quoted value may hold a >, but one that is never closed, or
        only by the first quote of a later tag's value, ends at the first >."""
        page = self.page
        while (m := _STOP.search(page, at)) is not None:
            if m[1] is None:
                return m.end()
            close, first = self._find(m[1], m.end()), self._find(">", m.end())
            if close < 0 or (0 <= first < close and page[close + 1 : close + 2].strip(" \t\r\n\f/>")):
                return first + 1 if first >= 0 else -1
            at = close + 1
        return -1

    def _behind(self, name: str, at: int) -> int:
        """Behind the end tag of an unread element that was opened before ``at``; ``at`` if there is none."""
        key = f"</{name}"
        if key in self.none:
            return len(self.page) if name in _SWALLOWS else at
        depth, first = 1, -1
        for m in re.compile(rf"<(/?){name}(?=[\s/>]|\Z)", re.I).finditer(self.page, at):
            if not m[1]:
                depth += name not in _SWALLOWS
                continue
            depth -= 1
            end = self.page.find(">", m.end())
            end = len(self.page) if end < 0 else end + 1
            first = end if first < 0 else first
            if depth == 0:
                return end
        if first >= 0:
            return first
        self.none.add(key)
        return len(self.page) if name in _SWALLOWS else at

    def tags(self) -> Iterator[tuple[int, int, str, bool, str]]:
        """Start, end, name ("": nothing to be read), whether it is an end tag, and its attributes."""
        page, size, at = self.page, len(self.page), 0
        while (start := page.find("<", at)) >= 0:
            after = page[start + 1 : start + 2]
            if after in ("!", "?"):
                if page.startswith("<!--", start):
                    end = self._find("-->", start + 2)
                    end = size if end < 0 else end + 3
                else:
                    end = self._find(">", start)
                    end = size if end < 0 else end + 1
                yield start, end, "", False, ""
                at = end
                continue
            closing = after == "/"
            m = _NAME.match(page, start + 1 + closing)
            if m is None:
                at = start + 1
                if closing and (end := self._find(">", start)) >= 0:  # an end tag without a name is a comment
                    yield start, end + 1, "", False, ""
                    at = end + 1
                continue
            name = m[0].lower()
            end = self._find(">", m.end()) + 1 if closing else self._end(m.end())
            if end <= 0:  # markup left open
                yield start, size, "", False, ""
                return
            if not closing and name in _UNREAD:
                if page[end - 2] != "/":
                    end = self._behind(name, end)
                yield start, end, "", False, ""
            else:
                yield start, end, name, closing, page[m.end() : end - 1]
            at = end


def blocks_of(page: str) -> list[Block]:
    """The leaf blocks of a page in order; texts decoded, white space made single, trimmed."""
    out: list[Block] = []
    stack: list[tuple[str, str]] = []  # tag, its description
    count: dict[str, int] = {}  # how many of a tag are open
    parts: list[str] = []
    path: tuple[str, ...] = ()
    linked = anchors = 0

    def flush() -> None:
        nonlocal linked
        if parts and (text := " ".join(entities.unescape("".join(parts)).split())):
            out.append(Block(text, path, min(linked, len(text))))
        parts.clear()
        linked = 0

    def text(piece: str) -> None:
        nonlocal path, linked
        if not parts or not path:
            path = tuple(d for _, d in stack[-PATH:])
        parts.append(piece)
        if anchors:
            linked += len(piece.strip())

    def close(k: int) -> None:
        for tag, _ in stack[k:]:
            count[tag] -= 1
        del stack[k:]

    at = 0
    for start, end, tag, closing, rest in _Scanner(page).tags():
        if start > at:
            text(page[at:start])
        at = end
        if not tag:
            continue
        if tag == "a":
            anchors = 0 if closing else 1
        elif tag == "br":
            parts.append(" ")
        elif tag in BLOCK_TAGS or tag in ("img", "input"):
            flush()
            anchors = 0
            if closing:
                if count.get(tag):
                    close(next(k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == tag))
            elif tag not in _VOID:
                if stack and stack[-1][0] == "p":
                    close(len(stack) - 1)
                closed, within = _CLOSES.get(tag, ((), ()))
                if any(map(count.get, closed)):
                    for k in range(len(stack) - 1, -1, -1):
                        if stack[k][0] in within:
                            break
                        if stack[k][0] in closed:
                            close(k)
                            break
                if len(stack) < DEPTH:
                    names = " ".join(a or b or c for a, b, c in _NAMED.findall(rest)) if rest else ""
                    stack.append((tag, " ".join([tag, *_PARTS.findall(names.lower())]) if names else tag))
                    count[tag] = count.get(tag, 0) + 1
    if at < len(page):
        text(page[at:])
    flush()
    return out


@lru_cache(maxsize=50_000)
def _path_vector(path: tuple[str, ...]) -> np.ndarray:
    v = np.zeros(PATH_DIM + LEAF_DIM, np.float32)
    for element in path:
        for k, word in enumerate(element.split()):
            h = crc32((word if k else f"<{word}>").encode())
            v[h % PATH_DIM] += 1.0 if h >> 31 else -1.0
    if path:
        for k, word in enumerate(path[-1].split()):
            h = crc32((f"leaf {word}" if k else f"leaf <{word}>").encode())
            v[PATH_DIM + h % LEAF_DIM] += 1.0 if h >> 31 else -1.0
    return v


def vectors(pages: list[list[Block]]) -> np.ndarray:
    """A row of INPUT numbers for each block, page after page."""
    blocks = [b for p in pages for b in p]
    data, offsets = texts_of(pa.array([b.text for b in blocks], pa.string()))
    starts, ends, first = word_spans(SPACE[data], offsets)
    words = np.diff(first)
    x = np.zeros((len(blocks), INPUT), np.float32)
    if not blocks:
        return x
    for k, b in enumerate(blocks):
        x[k, : PATH_DIM + LEAF_DIM] = _path_vector(b.path)
    h = span_hashes(data, starts, ends, LOWER)
    owner = np.repeat(np.arange(len(blocks)), words)
    sign = np.where(h >> np.uint64(63), 1.0, -1.0)
    bag = np.bincount(owner * WORD_DIM + ((h >> np.uint64(20)) % np.uint64(WORD_DIM)).astype(np.int64), sign, len(blocks) * WORD_DIM).reshape(-1, WORD_DIM)
    x[:, PATH_DIM + LEAF_DIM : -NUMBERS] = bag / np.sqrt(np.maximum((bag * bag).sum(axis=1), 1))[:, None]
    size = np.array([len(b.text) for b in blocks])
    place = np.concatenate([(np.arange(len(p)) + 0.5) / len(p) for p in pages if p])
    last = np.array([b.text[-1] in ".!?:\"”»…" for b in blocks])
    depth = np.array([len(b.path) for b in blocks])
    linked = np.array([b.linked for b in blocks])
    x[:, -NUMBERS:] = np.stack([np.log1p(words) / 3, np.log1p(size) / 5, linked / np.maximum(size, 1), place, last, depth / 8, words > 12, np.ones(len(blocks))], axis=1)
    return x


# ------------------------------------------------------------------ network


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """A bidirectional LSTM with a logistic output for each step. Weights are in ``w``."""

    def __init__(self, hidden: int = 24, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        self.hidden = hidden
        self.w: dict[str, np.ndarray] = {"out": rng.normal(0, 0.1, 2 * hidden).astype(np.float32), "bias": np.zeros(1, np.float32)}
        for d in ("f", "b"):
            self.w[f"x{d}"] = rng.normal(0, INPUT**-0.5, (INPUT, 4 * hidden)).astype(np.float32)
            self.w[f"h{d}"] = rng.normal(0, hidden**-0.5, (hidden, 4 * hidden)).astype(np.float32)
            self.w[f"o{d}"] = np.repeat(np.array([0, 1, 0, 0], np.float32), hidden)

    def _run(self, gates: np.ndarray, mask: np.ndarray, d: str, keep: bool = False):
        """gates: steps, pages, 4 * hidden. Steps beyond a page's end leave its state as it is."""
        steps, rows, _ = gates.shape
        n = self.hidden
        h, c = np.zeros((rows, n), np.float32), np.zeros((rows, n), np.float32)
        out, memory = np.zeros((steps, rows, n), np.float32), []
        for t in range(steps):
            z = gates[t] + h @ self.w[f"h{d}"]
            s = _sigmoid(z[:, : 3 * n])
            i, f, o = s[:, :n], s[:, n : 2 * n], s[:, 2 * n :]
            g = np.tanh(z[:, 3 * n :])
            m = mask[t][:, None]
            new_c = m * (f * c + i * g) + (1 - m) * c
            tc = np.tanh(new_c)
            new_h = m * (o * tc) + (1 - m) * h
            if keep:
                memory.append((h, c, i, f, o, g, tc, m))
            h, c = new_h, new_c
            out[t] = h
        return out, memory

    @staticmethod
    def _turn(x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Each page's steps in reverse order (its padding stays at the end)."""
        steps = np.arange(x.shape[0])[:, None]
        at = np.where(steps < lengths, lengths - 1 - steps, steps)
        return x[at, np.arange(x.shape[1])[None, :]]

    def _forward(self, x: np.ndarray, lengths: np.ndarray, keep: bool = False):
        mask = (np.arange(x.shape[0])[:, None] < lengths).astype(np.float32)
        xb = self._turn(x, lengths)
        hf, mf = self._run(x @ self.w["xf"] + self.w["of"], mask, "f", keep)
        hb, mb = self._run(xb @ self.w["xb"] + self.w["ob"], mask, "b", keep)
        both = np.concatenate([hf, self._turn(hb, lengths)], axis=2)
        return both @ self.w["out"] + self.w["bias"], (x, xb, both, mf, mb, mask)

    def _back(self, d: str, x: np.ndarray, dh: np.ndarray, memory: list, grads: dict) -> None:
        n = self.hidden
        nh, nc = np.zeros_like(dh[0]), np.zeros_like(dh[0])
        dz_all = np.zeros((*dh.shape[:2], 4 * n), np.float32)
        gh = np.zeros_like(self.w[f"h{d}"])
        for t in range(len(memory) - 1, -1, -1):
            h, c, i, f, o, g, tc, m = memory[t]
            g_h = dh[t] + nh
            g_o = g_h * m * tc
            g_c = nc * m + g_h * m * o * (1 - tc * tc)
            dz = np.concatenate([g_c * g * i * (1 - i), g_c * c * f * (1 - f), g_o * o * (1 - o), g_c * i * (1 - g * g)], axis=1)
            dz_all[t] = dz
            gh += h.T @ dz
            nh = dz @ self.w[f"h{d}"].T + g_h * (1 - m)
            nc = g_c * f + nc * (1 - m)
        grads[f"h{d}"] = gh
        grads[f"x{d}"] = np.tensordot(x, dz_all, axes=([0, 1], [0, 1]))
        grads[f"o{d}"] = dz_all.sum(axis=(0, 1))

    def gradients(self, x: np.ndarray, lengths: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean loss of a padded batch (steps, pages, INPUT) and its gradients."""
        z, (x, xb, both, mf, mb, mask) = self._forward(x, lengths, keep=True)
        p = _sigmoid(z)
        total = mask.sum()
        loss = float(-(mask * (y * np.log(p + 1e-7) + (1 - y) * np.log(1 - p + 1e-7))).sum() / total)
        dz = ((p - y) * mask / total).astype(np.float32)
        grads = {"out": np.tensordot(dz, both, axes=([0, 1], [0, 1])), "bias": np.array([dz.sum()], np.float32)}
        dh = dz[:, :, None] * self.w["out"]
        self._back("f", x, dh[:, :, : self.hidden], mf, grads)
        self._back("b", xb, self._turn(dh[:, :, self.hidden :], lengths), mb, grads)
        return loss, grads

    def probabilities(self, x: np.ndarray, lengths: np.ndarray, batch: int = 128) -> np.ndarray:
        """Of each block, page after page; pages of like length are run together."""
        out = np.zeros(len(x))
        first = np.concatenate([[0], np.cumsum(lengths)])
        order = np.argsort(lengths, kind="stable")
        order = order[lengths[order] > 0]
        a = 0
        while a < len(order):
            b = min(a + batch, len(order))
            while b - a > 1 and int(lengths[order[b - 1]]) * (b - a) > 40_000:  # bounds the padded batch
                b = a + (b - a) // 2
            rows = order[a:b]
            padded, sizes = _padded(x, first, rows)
            p = _sigmoid(self._forward(padded, sizes)[0])
            for k, r in enumerate(rows):
                out[first[r] : first[r + 1]] = p[: lengths[r], k]
            a = b
        return out


def _padded(x: np.ndarray, first: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    sizes = first[rows + 1] - first[rows]
    out = np.zeros((int(sizes.max()), len(rows), *x.shape[1:]), x.dtype)
    for k, r in enumerate(rows):
        out[: sizes[k], k] = x[first[r] : first[r + 1]]
    return out, sizes


# ------------------------------------------------------------------ training pages


class PageMaker:
    """Pages with a mark before each leaf text: \\x01 main text, \\x02 not."""

    #: Words for names of elements and texts, as they are common on the web.
    SIDE = "sidebar side widget aside rail col-right secondary widget-area module".split()
    ADS = "ad ads advert advertisement sponsored promo banner adsense ad-slot sponsor ad-box inline-ad".split()
    NOTICE = "notice cookie cookie-banner consent gdpr alert popup modal message subscribe-box paywall".split()
    MENU = "menu nav navbar navigation breadcrumb breadcrumbs topbar toolbar tabs links site-nav".split()
    FOOT = "footer foot site-footer copyright legal bottom colophon credits".split()
    HEAD = "header masthead top site-header branding logo hero-bar".split()
    TALK = "comments comment replies discussion responses comment-list disqus reader-comments feedback thread".split()
    MORE = "related more also-read recommended popular trending share sharing sharedaddy social tags tag-list pager pagination author-box newsletter related-stories more-stories read-next see-also".split()
    MAIN = "content article post entry story main body text article-body post-content entry-content main-content page-content prose".split()
    SAID = "home about contact login register subscribe share tweet reply report cookies accept policy privacy terms copyright rights reserved search menu newsletter advertisement sponsored related read more comments comment posted says by".split()

    def __init__(self, seed: int) -> None:
        self.random = random.Random(seed).random

    def pick(self, items):
        return items[int(self.random() * len(items))]

    def number(self, low: int, high: int) -> int:
        """From low to high - 1."""
        return low + int(self.random() * (high - low))

    def chance(self, p: float) -> bool:
        return self.random() < p

    def language(self) -> None:
        letters = self.pick(["aeiou", "aeiouéè", "aeiouäöüß", "aeioóñí"])
        self.style = self.pick(["plain"] * 6 + ["bars", "repeat", "shout", "marks"])
        self.syllables = ["".join([self.pick("bcdfghlmnprstvw"), self.pick(letters), self.pick(["", "n", "r", "s", "t", "th"])]) for _ in range(40)]

    def words(self, n: int) -> str:
        out, left = [], 0
        for k in range(n):
            w = "".join(self.pick(self.syllables) for _ in range(self.number(1, 5)))
            out.append(w.capitalize() if left == 0 else w)
            left = self.number(3, 14) if left == 0 else left - 1
            if left == 0 or k == n - 1:
                out[-1] += self.pick("...,!?") if k < n - 1 else self.pick("....!?")
        if self.style == "repeat" and n > 3:
            out = [self.pick(out[:2]) if self.chance(0.1) else out[0] for _ in out]
        elif self.style == "shout":
            out = [w.upper() + "!!" for w in out]
        elif self.style == "marks":
            out = [w + self.pick(["%%%", "&&&", "###", "$$$", "***"]) for w in out]
        return (" | " if self.style == "bars" else " ").join(out)

    def prose(self) -> str:
        return self.words(self.number(1, 8) if self.chance(0.2) else self.number(6, 90))

    def named(self, names: list[str], p: float = 0.85) -> str:
        if not self.chance(p):
            return ""
        name = self.pick(names)
        name += self.pick(["", "", "", f"-{self.number(0, 9)}", " box", " wrap", " inner"])
        return self.pick([' class="{}"', ' id="{}"', " class='{}'", ' class="{} clearfix"']).format(name)

    def bad(self, text: str) -> str:
        return "\x02" + text

    def links(self) -> str:
        short = lambda: self.pick(self.SAID) if self.chance(0.3) else self.words(self.number(1, 4))
        n = self.number(2, 9)
        return self.pick([
            lambda: "<ul>" + "".join(f'<li>{self.bad("")}<a href="/x">{short()}</a></li>' for _ in range(n)) + "</ul>",
            lambda: self.bad("") + " | ".join(f'<a href="/x">{short()}</a>' for _ in range(n)),
            lambda: "".join(f'<div>{self.bad("")}<a href="/x">{short()}</a></div>' for _ in range(n)),
        ])()

    def menu(self) -> str:
        tag = self.pick(["nav", "nav", "div", "header"])
        return f"<{tag}{self.named(self.MENU, 0.4 if tag == 'nav' else 1)}>{self.links()}</{tag}>"

    def top(self) -> str:
        tag = self.pick(["header", "header", "div"])
        inside = self.pick(["<h1>{}</h1>", "<p>{}</p>", "<div>{}</div>", "<h2>{}</h2><p>{}</p>"])
        return f"<{tag}{self.named(self.HEAD, 0.3 if tag == 'header' else 1)}>" + re.sub(r"\{\}", lambda _: self.bad(self.words(self.number(1, 9))), inside) + (self.links() if self.chance(0.3) else "") + f"</{tag}>"

    def boxed(self, names: list[str], tags: list[str], p: float = 1) -> str:
        tag = self.pick(tags)
        body = "".join(self.pick([lambda: f"<p>{self.bad(self.prose())}</p>", lambda: self.bad(self.prose()), lambda: f"<h3>{self.bad(self.words(3))}</h3>{self.links()}", lambda: f"<div>{self.bad(self.prose())}</div>"])() for _ in range(self.number(1, 4)))
        if self.chance(0.3):
            body = self.bad(" ".join(self.pick(self.SAID) for _ in range(3)) + " ") + body.replace("\x02", "", 1) if body.startswith("\x02") else body
        return f"<{tag}{self.named(names, p)}>{body}</{tag}>"

    def advert(self) -> str:
        return f"<div{self.named(self.ADS, 1)}>{self.bad(self.prose())}</div>" if self.chance(0.6) else self.boxed(self.ADS, ["div", "aside", "section"])

    def form(self) -> str:
        return f"<form{self.named(['search', 'login', 'signup', 'newsletter', 'contact', 'subscribe'], 0.6)}>" + "".join(self.pick([lambda: f"<label>{self.bad(self.words(2))}</label><input type=text>", lambda: f"<p>{self.bad(self.prose())}</p>", lambda: f"<button>{self.bad(self.words(1))}</button>", lambda: f"<select><option>{self.bad(self.words(1))}<option>{self.bad(self.words(1))}</select>"])() for _ in range(self.number(1, 5))) + "</form>"

    def talk(self) -> str:
        def one() -> str:
            head = self.pick(["", f"<div{self.named(['author', 'meta', 'user'], 0.8)}>{self.bad(self.words(2))}</div>", f"<h4>{self.bad(self.words(2))}</h4>"])
            body = "".join(f"<p>{self.bad(self.prose())}</p>" if self.chance(0.8) else f"<div>{self.bad(self.prose())}</div>" for _ in range(self.number(1, 3)))
            tag = self.pick(["div", "li", "article", "section"])
            return f"<{tag}{self.named(['comment', 'reply', 'response', 'comment-body', 'post'], 0.7)}>{head}{body}</{tag}>"

        tag = self.pick(["section", "div", "ol", "ul", "aside"])
        title = f"<h3>{self.bad(self.pick(['Comments', 'Replies', 'Discussion', self.words(2)]))}</h3>" if self.chance(0.6) else ""
        return f"<{tag}{self.named(self.TALK, 1)}>{title}{''.join(one() for _ in range(self.number(1, 6)))}</{tag}>"

    def foot(self) -> str:
        tag = self.pick(["footer", "footer", "div"])
        text = self.bad(self.pick(["&copy; ", "Copyright ", "© 2020 ", ""]) + self.prose())
        return f"<{tag}{self.named(self.FOOT, 0.3 if tag == 'footer' else 1)}>{self.pick([text, f'<p>{text}</p>'])}{self.links() if self.chance(0.4) else ''}</{tag}>"

    def article(self) -> str:
        good = lambda text: "\x01" + text
        out = [f"<{(h := self.pick(['h1', 'h1', 'h2']))}>{good(self.words(self.number(2, 14)))}</{h}>"] if self.chance(0.85) else []
        size = self.number(12, 120) if self.chance(0.1) else self.number(1, 12)
        for _ in range(size):
            out.append(self.pick([
                *[lambda: f"<p>{good(self.prose())}</p>"] * 8,
                lambda: f"<p><b>{good(self.words(self.number(1, 20)))}<br>",
                lambda: f"<p>{good(self.words(5))} <a href='/y'>{self.words(3)}</a> <i>{self.words(4)}</i> {self.prose()}</p>",
                lambda: f"<h2>{good(self.words(4))}</h2>",
                lambda: f"<h3>{good(self.words(3))}</h3>",
                lambda: "<ul>" + "".join(f"<li>{good(self.words(self.number(2, 15)))}</li>" for _ in range(self.number(2, 6))) + "</ul>",
                lambda: "<ol>" + "".join(f"<li>{good(self.words(self.number(2, 15)))}</li>" for _ in range(self.number(2, 6))) + "</ol>",
                lambda: f"<blockquote>{good(self.prose())}</blockquote>",
                lambda: f"<blockquote><p>{good(self.prose())}</p></blockquote>",
                lambda: f"<pre>{good(self.words(9))}</pre>",
                lambda: "<table>" + "".join(f"<tr><td>{good(self.words(2))}</td><td>{good(self.words(3))}</td></tr>" for _ in range(2)) + "</table>",
                lambda: f"<div>{good(self.prose())}</div>",
            ])())
            if self.chance(0.16 if size < 12 else 0.03):
                out.append(self.pick([self.advert, lambda: self.boxed(self.SIDE, ["aside", "div"]), self.form, lambda: f"<div{self.named(self.MORE, 1)}>{self.links()}</div>", lambda: self.boxed(self.NOTICE, ["div"])])())
        body = "".join(out)
        if self.chance(0.08):
            body += self.talk()
        later = lambda: self.pick([lambda: f"<{(t := self.pick(['section', 'div', 'aside']))}{self.named(self.MORE, 1)}><h3>{self.bad(self.words(self.number(1, 5)))}</h3>{self.links()}</{t}>", lambda: f"<div{self.named(self.MORE, 1)}>{self.bad(self.pick(self.SAID) + ' ' + self.words(self.number(1, 4)))}</div>"])()
        return self.pick([
            *[lambda: f"<article{self.named(self.MAIN, 0.3)}>{body}</article>"] * 4,
            lambda: f"<main><article>{body}</article></main>",
            lambda: f"<main{self.named(self.MAIN, 0.3)}><article>{body}</article>{later()}</main>",
            lambda: f"<div{self.named(self.MAIN, 1)}>{body}{later()}</div>",
            lambda: f"<main{self.named(self.MAIN, 0.3)}>{body}</main>",
            lambda: f"<div{self.named(self.MAIN, 1)}>{body}</div>",
            lambda: f"<div{self.named(self.MAIN, 1)}><div>{body}</div></div>",
            lambda: f"<section{self.named(self.MAIN, 0.8)}>{body}</section>",
            lambda: f"<div role='main'>{body}</div>",
            lambda: f"<div>{body}</div>",
        ])()

    def page(self) -> str:
        self.language()
        maybe = lambda p, f: [f()] if self.chance(p) else []
        other = lambda f: (lambda: (self.language(), f())[1])  # noqa: E731  boilerplate is often in another language
        before = [*maybe(0.35, self.top), *maybe(0.75, self.menu), *maybe(0.25, other(lambda: self.boxed(self.NOTICE, ["div", "section", "aside"]))), *maybe(0.4, other(self.advert)), *maybe(0.15, self.form), *maybe(0.2, lambda: self.boxed(self.SIDE, ["aside", "div"]))]
        self.language()
        main = self.article()
        after = [*maybe(0.2, other(self.advert)), *maybe(0.25, lambda: f"<div{self.named(self.MORE, 1)}>{self.links()}</div>"), *maybe(0.4, self.talk), *maybe(0.3, lambda: self.boxed(self.SIDE, ["aside", "div"])), *maybe(0.15, self.form), *maybe(0.1, lambda: self.boxed(self.NOTICE, ["div", "section"])), *maybe(0.75, other(self.foot))]
        body = "".join(before) + main + "".join(after)
        if self.chance(0.25):
            body = f"<div class='{self.pick(['page', 'wrapper', 'container', 'site', 'layout'])}'>{body}</div>"
        return f"<!DOCTYPE html><html><head><title>{self.bad(self.words(6))}</title></head><body>{body}</body></html>"


def labelled(page: str) -> tuple[list[Block], np.ndarray]:
    """The blocks of a made page and their labels; blocks without a mark are left out."""
    blocks = [b for b in blocks_of(page) if b.text[0] in "\x01\x02"]
    y = np.array([b.text[0] == "\x01" for b in blocks], np.float32)
    for b in blocks:
        b.text = b.text[1:].replace("\x01", "").replace("\x02", "").strip() or "-"
    return blocks, y


@lru_cache(maxsize=2)
def trained(pages: int = 2200, epochs: int = 5, batch: int = 48, rate: float = 0.01, seed: int = 11) -> Labeller:
    """The network after Adam on made pages; always the same for the same arguments."""
    maker = PageMaker(seed)
    made = [p for p in (labelled(maker.page()) for _ in range(pages)) if len(p[1])]
    x, y = vectors([b for b, _ in made]), np.concatenate([v for _, v in made])
    first = np.concatenate([[0], np.cumsum([len(v) for _, v in made])])
    rng, net = np.random.default_rng(seed), Labeller(seed=seed)
    m = {k: np.zeros_like(v) for k, v in net.w.items()}
    s = {k: np.zeros_like(v) for k, v in net.w.items()}
    step = 0
    for epoch in range(epochs):
        # pages of like length go together, batches in random order
        order = np.argsort(np.diff(first) + rng.random(len(made)) * 8, kind="stable")
        groups = [order[a : a + batch] for a in range(0, len(order), batch)]
        for g in rng.permutation(len(groups)):
            step += 1
            xs, sizes = _padded(x, first, groups[g])
            # names and words unknown at training time must not mislead: some vectors are blanked
            xs = xs * (rng.random((*xs.shape[:2], 1)) > 0.05) if epoch % 2 else xs
            _, grads = net.gradients(xs.astype(np.float32), sizes, _padded(y, first, groups[g])[0])
            pace = rate * (0.5 if epoch >= epochs - 2 else 1.0)
            for k, d in grads.items():
                m[k] = 0.9 * m[k] + 0.1 * d
                s[k] = 0.999 * s[k] + 0.001 * d * d
                net.w[k] = (net.w[k] - pace * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return net


def main_texts(pages: list[str | None], net: Labeller, threshold: float = 0.5) -> list[str]:
    blocks = [blocks_of(p) if p else [] for p in pages]
    lengths = np.array([len(b) for b in blocks], np.int64)
    keep = net.probabilities(vectors(blocks), lengths) >= threshold
    first = np.concatenate([[0], np.cumsum(lengths)])
    return ["\n".join(b.text for b, k in zip(own, keep[first[i] : first[i + 1]], strict=True) if k) for i, own in enumerate(blocks)]


def extract(pages: DataFrame, net: Labeller | None = None, group: int = 256) -> DataFrame:
    """``page_id, url, text, n_chars`` for every row."""
    net = net or trained()
    sent = pages.sparkSession.sparkContext.broadcast((net.hidden, net.w))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Labeller(sent.value[0])
        own.w = sent.value[1]
        for batch in batches:
            for a in range(0, batch.num_rows, group):
                part = batch.slice(a, group)
                yield pa.record_batch([part.column(0), part.column(1), pa.array(main_texts(part.column(2).to_pylist(), own), pa.string())], names=["page_id", "url", "text"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return in_arrow(rows, run, "page_id long, url string, text string").withColumn("n_chars", F.length("text").cast("long"))


def op1_html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
