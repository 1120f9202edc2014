"""Main text of web pages by a linear-chain conditional random field over DOM leaf blocks.

A page's tags cut its text into leaf blocks. Each block has features of its ancestors' tags, of their class and id words and of its
own text; a chain with two labels (main text or not) scores all labellings of a page's blocks in order, and Viterbi picks
the best. It is trained on the driver from a bounded sample of labelled pages: at most `most` pages of the table (a parameter of
`fit`) of lowest hash and of less than PAGE_BYTES, whose blocks are labelled by the element that holds them (article or main,
outside of navigation, asides and the like), each also laid out anew twice from its first PAGE_BLOCKS blocks, with sidebars,
notices, forms, adverts and comments around and in the article, so that the chain also knows layouts that the sample lacks.

Pages are read by one scan to the right, in time that grows with their length: no tag is searched for twice, and a block's features
come from its OUTER outermost and INNER innermost open elements.
"""

from __future__ import annotations

import html
import random
import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean_batches, let_go

PAGES, EPOCHS, RATE, DECAY, SEED = 160, 12, 0.05, 1e-4, 11
DIM = 4096

#: Bounds of the labelled sample, and of the texts that its layouts repeat as comments.
PAGE_BYTES, PAGE_BLOCKS, COMMENT = 1 << 17, 60, 200
OUTER, INNER = 16, 48
#: Open elements that an implied end tag looks through.
DEEP = 256
_OPEN = re.compile(r"<(?:!--|[!?]|(/?)([a-zA-Z][a-zA-Z0-9:-]*))")
_MARK = re.compile(r"""[>"']""")
#: Elements whose text is never shown as text; they end at their end tag alone.
_RAW = frozenset("script style noscript template textarea iframe svg title".split())
#: Form controls and their captions: their text stands apart from the block around them.
_CONTROLS = frozenset("button select option optgroup datalist output progress meter label legend".split())
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_WORD = re.compile(r"[a-z]+|[0-9]+")
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big br button cite code data datalist del dfn em font i img input ins kbd label mark meter optgroup option output progress q rp rt ruby s samp select small span strike strong sub sup time tt u var wbr".split())
#: A start tag of the first kind ends an open element of the second.
_ENDS = {"li": "li", "dt": "dd", "dd": "dt", "tr": "tr", "td": "td", "th": "th", "option": "option"}
_ENDS_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
_OUT_TAGS = frozenset("nav aside footer header form menu dialog head".split()) | _CONTROLS
_OUT_WORDS = frozenset("ad ads advert advertisement sponsored comment comments discussion discuss replies respond disqus sidebar cookie consent notice banner related newsletter subscribe share promo breadcrumb".split())


@dataclass
class Block:
    text: str
    tags: tuple[str, ...]
    words: frozenset[str]
    linked: int


def _tags(page: str):
    """(begin, end, name, is end tag, attributes) of each tag in order; comments, declarations and raw elements have no name.

    A quote after = holds its value together. A page where a tag has no end that way is malformed: from there on tags end at the next
    >. What follows the last > is no tag.
    """
    at, last, strict = 0, page.rfind(">"), True
    missing: set[str] = set()  # quotes and end tags that don't occur any more

    def find(what: str, i: int) -> int:
        if what in missing:
            return -1
        j = page.find(what, i)
        if j < 0:
            missing.add(what)
        return j

    def tag_end(i: int) -> int:
        while m := _MARK.search(page, i):
            i = m.end()
            if m[0] == ">":
                return i
            if page[m.start() - 1 : m.start()] in ("=", " ") and page[max(0, m.start() - 8) : m.start()].rstrip().endswith("="):
                j = find(m[0], i)
                i = j + 1 if j >= 0 else i
        return -1

    while m := _OPEN.search(page, at):
        begin, at = m.start(), m.end()
        if page.startswith("<!--", begin):
            j = find("-->", at)
            at = j + 3 if j >= 0 else len(page)
            yield begin, at, "", False, ""
            continue
        if begin > last:
            return
        end = tag_end(at) if strict and m[2] else -1
        if end < 0:
            strict = strict and not m[2]
            end = page.find(">", at) + 1
        name = (m[2] or "").lower()
        attributes, at = page[m.end() : end - 1], end
        if name in _RAW and not m[1]:
            if not attributes.rstrip().endswith("/"):
                at = _raw_end(page, name, end, missing)
            name = ""
        yield begin, at, name, bool(m[1]), attributes


_RAW_ENDS: dict[str, re.Pattern] = {name: re.compile(f"</{name}[^>]*>", re.I) for name in _RAW}


def _raw_end(page: str, name: str, i: int, missing: set[str]) -> int:
    m = None if f"</{name}" in missing else _RAW_ENDS[name].search(page, i)
    if m is None:
        missing.add(f"</{name}")
        return len(page)
    return m.end()


def blocks(page: str) -> list[Block]:
    """The page's leaf blocks that have text, in order: references decoded, white space one blank, trimmed."""
    out: list[Block] = []
    stack: list[tuple[str, frozenset[str]]] = []
    parts: list[str] = []
    control: list[str] = []
    open_: Counter[str] = Counter()
    links = controls = 0

    def emit(pieces: list[str], extra: tuple[str, ...] = ()):
        text = " ".join("".join(pieces).split())
        if text:
            near = stack if len(stack) <= OUTER + INNER else stack[:OUTER] + stack[-INNER:]
            out.append(Block(text, tuple(t for t, _ in near) + extra, frozenset().union(*(w for _, w in near)), links))
        pieces.clear()

    def close():
        nonlocal links
        emit(parts)
        links = 0
        if control:
            emit(control, ("button",))

    def drop(i: int):
        nonlocal controls
        for t, _ in stack[i:]:
            open_[t] -= 1
            controls -= t in _CONTROLS
        del stack[i:]

    def pop(name: str, stop: frozenset[str] = frozenset()):
        """Closes the innermost such element; with `stop`, only if none of those lies between, nor DEEP others."""
        if open_[name] <= 0:
            return
        for i in range(len(stack) - 1, max(-1, len(stack) - 1 - DEEP) if stop else -1, -1):
            if stack[i][0] == name:
                drop(i)
                return
            if stack[i][0] in stop:
                return

    def read(raw: str):
        nonlocal links
        text = html.unescape(raw) if "&" in raw else raw
        if controls:
            control.append(text)
            return
        if open_["a"] > 0:
            links += len(text.strip())
        parts.append(text)

    at = 0
    for begin, end, name, ends, attrs in _tags(page):
        if begin > at:
            read(page[at:begin])
        at = end
        if not name:
            continue
        if name not in _INLINE:
            close()
        elif name == "br":
            (control if controls else parts).append(" ")
        elif name in _CONTROLS:
            control.append(" ")
        if ends:
            pop(name)
            continue
        if name in _ENDS_P:
            pop("p", frozenset(("table", "td", "body", "article", "div", "section")))
        if name in _ENDS:
            pop(_ENDS[name], frozenset(("ul", "ol", "table", "dl", "select")))
        if name not in _VOID and not attrs.rstrip().endswith("/"):
            words = frozenset(w for x in _NAMES.findall(attrs) for w in _WORD.findall(x.lower())) if attrs else frozenset()
            stack.append((name, words))
            open_[name] += 1
            controls += name in _CONTROLS
    if at < len(page):
        read(page[at:])
    close()
    return out


def _slot(name: str) -> int:
    return zlib.crc32(name.encode()) % DIM


_slots: dict[str, int] = {}


def _id(name: str) -> int:
    got = _slots.get(name)
    if got is None:
        if len(_slots) > 50_000:
            _slots.clear()
        got = _slots[name] = _slot(name)
    return got


def features(page: list[Block]) -> list[list[int]]:
    """Hashed features of each block."""
    out, n = [], len(page)
    for i, b in enumerate(page):
        size = len(b.text)
        shown = [t for t in b.tags if t not in _INLINE or t in _CONTROLS]
        names = {f"t:{t}" for t in shown}
        names |= {f"w:{w}" for w in b.words}
        leaf = shown[-2:]
        names |= {f"leaf:{'/'.join(leaf)}", f"size:{min(10, size.bit_length())}", f"link:{min(4, 4 * b.linked // max(1, size))}"}
        names |= {f"end:{b.text[-1] if not b.text[-1].isalnum() else 'a'}", f"stops:{min(4, sum(b.text.count(c) for c in '.!?'))}", f"copy:{'©' in b.text}", f"first:{i == 0}", f"last:{i == n - 1}"}
        out.append([_id("bias"), *map(_id, sorted(names))])
    return out


@dataclass
class Chain:
    emit: np.ndarray
    """(features, 2)"""
    move: np.ndarray
    """(2, 2)"""

    def scores(self, feats: list[list[int]]) -> np.ndarray:
        flat = np.fromiter((x for f in feats for x in f), np.int64)
        at = np.cumsum([0, *(len(f) for f in feats)])[:-1]
        return np.add.reduceat(self.emit[flat], at)

    def best(self, feats: list[list[int]]) -> list[int]:
        """Viterbi: the labelling of highest score; of equal ones, main text."""
        if not feats:
            return []
        s = self.scores(feats).tolist()
        (a, b), (c, d) = self.move.tolist()
        x, y, back = s[0][0], s[0][1], []
        for u, v in s[1:]:
            i, j = (1 if y + c >= x + a else 0), (1 if y + d >= x + b else 0)
            back.append((i, j))
            x, y = (y + c if i else x + a) + u, (y + d if j else x + b) + v
        label = [1 if y >= x else 0]
        for pair in reversed(back):
            label.append(pair[label[-1]])
        return label[::-1]


def train(pages: list[tuple[list[list[int]], list[int]]]) -> Chain:
    """Adagrad on the conditional log-likelihood; expectations by forward and backward sums."""
    rng = np.random.default_rng(SEED)
    chain = Chain(np.zeros((DIM, 2)), np.zeros((2, 2)))
    sum_e, sum_m = np.full((DIM, 2), 1e-6), np.full((2, 2), 1e-6)
    for _ in range(EPOCHS):
        for p in rng.permutation(len(pages)):
            feats, y = pages[p]
            n = len(y)
            if not n:
                continue
            s, move = chain.scores(feats), chain.move
            f, b = np.zeros((n, 2)), np.zeros((n, 2))
            f[0] = s[0]
            for i in range(1, n):
                f[i] = s[i] + np.logaddexp(f[i - 1, 0] + move[0], f[i - 1, 1] + move[1])
            for i in range(n - 2, -1, -1):
                q = move + s[i + 1] + b[i + 1]
                b[i] = np.logaddexp(q[:, 0], q[:, 1])
            z = np.logaddexp(f[-1, 0], f[-1, 1])
            node = np.exp(f + b - z)
            node[np.arange(n), y] -= 1
            gm = np.zeros((2, 2))
            for i in range(1, n):
                gm += np.exp(f[i - 1][:, None] + move + s[i] + b[i] - z)
                gm[y[i - 1], y[i]] -= 1
            flat = np.fromiter((x for ft in feats for x in ft), np.int64)
            ge = np.zeros((DIM, 2))
            np.add.at(ge, flat, np.repeat(node, [len(ft) for ft in feats], 0))
            used = np.unique(flat)
            g = ge[used] / n + DECAY * chain.emit[used]
            sum_e[used] += g * g
            chain.emit[used] -= RATE * 10 * g / np.sqrt(sum_e[used])
            gm = gm / n + DECAY * chain.move
            sum_m += gm * gm
            chain.move -= RATE * gm / np.sqrt(sum_m)
    return chain


def labels(page: list[Block]) -> list[int]:
    """1 for blocks in an article or main element and in none of the other kinds."""
    return [int(("article" in b.tags or "main" in b.tags) and not _OUT_TAGS & set(b.tags) and not _OUT_WORDS & b.words) for b in page]


def relaid(page: list[Block], truth: list[int], rng: random.Random) -> tuple[list[Block], list[int]]:
    """The same text in a layout drawn at random, with its labels."""
    main = [b.text for b, y in zip(page, truth) if y]
    rest = [b.text for b, y in zip(page, truth) if not y] or ["Menu"]
    out: list[tuple[str, str, str, int]] = []  # opening, text, closing, label
    some = lambda n: [rng.choice(rest) for _ in range(rng.randint(1, n))]
    wrap = rng.choice(["article", "main", "div class='content'", "div id='article-body'", "section class='post'", "article class='entry'", "div class='post-body'", "div class='entry-content'", "div class='story text'", "div id='main-content'"])
    close = wrap.split(" ")[0]
    plain = lambda kind, xs, inner="p": [(f"<{kind}><{inner}>", x, f"</{inner}></{kind.split(' ')[0]}>", 0) for x in xs]
    before = [plain("header", some(2), "div"), plain("nav", some(5), "li"), plain(rng.choice(["div class='cookie-notice'", "div class='notice'", "dialog", "div role='alert'"]), some(1)), plain(rng.choice(["div class='ad'", "div class='advert'", "div id='sponsored'"]), some(1)), plain("form", some(2), "div"), plain(rng.choice(["aside", "div class='sidebar'"]), some(3))]
    said = lambda n: [rng.choice(main or rest)[:COMMENT] for _ in range(rng.randint(1, n))]
    talk = lambda: rng.choice([("section class='comments'", "p"), ("div id='comments'", "p"), ("div class='comment'", "p"), ("ol class='discussion'", "li"), ("ul class='comment-list'", "li"), ("div class='replies'", "div"), ("section id='discussion'", "p")])
    where, inside = talk()
    after = [plain("footer", some(2), "div"), plain(where, said(4), inside), plain(rng.choice(["aside", "div class='related'"]), some(3), "li"), plain("div class='newsletter'", some(1)), plain("form", some(2))]
    rng.shuffle(before), rng.shuffle(after)
    for x in before[: rng.randint(0, 5)]:
        out += x
    inner = [(f"<{rng.choice(['p', 'p', 'p', 'p', 'h2', 'li', 'blockquote', 'pre'])}>" if i else "<h1>", x, "", 1) for i, x in enumerate(main)]
    if rng.random() < 0.5 and main:  # a list of short items
        words = rng.choice(main).split()
        items = [" ".join(words[j : j + rng.randint(1, 6)]) for j in rng.sample(range(len(words)), min(len(words), rng.randint(2, 6)))]
        k = rng.randint(1, len(inner))
        kind = rng.choice(["ul", "ul", "ol"])
        inner[k:k] = [(f"<{kind}><li>", x, f"</li></{kind}>", 1) for x in items]
    if rng.random() < 0.4 and len(inner) > 1:
        k = rng.randint(1, len(inner) - 1)
        inner[k:k] = plain(rng.choice(["div class='ad'", "aside", "div class='advert'", "form"]), some(2))
    if rng.random() < 0.4 and len(inner) > 1:
        k = rng.randint(1, len(inner) - 1)
        a, b = rng.choice([("<div><button>", "</button></div>"), ("<button>", "</button>"), ("<select><option>", "</option></select>")])
        inner[k:k] = [(a, rng.choice(["Subscribe now", "Share", *rest]), b, 0)]
    if rng.random() < 0.4:
        where, inside = rng.choice([talk(), ("footer", "p")])
        inner += plain(where, said(3), inside)
    source = "".join(a + html.escape(x) + c for a, x, c, _ in out) + f"<{wrap}>" + "".join(a + html.escape(x) + (c or f"</{a[1:-1]}>") for a, x, c, _ in inner) + f"</{close}>"
    tail = [y for x in after[: rng.randint(0, 4)] for y in x]
    source += "".join(a + html.escape(x) + c for a, x, c, _ in tail)
    made = blocks(f"<html><body>{source}</body></html>")
    truth = [y for *_, y in [*out, *inner, *tail]]
    return (made, truth) if len(made) == len(truth) else ([], [])


def fit(pages: DataFrame, most: int = PAGES) -> Chain:
    """Trained on the `most` pages of lowest hash that have a labelled main text, and twice as many layouts of them. Only this sample is
    bounded (see above)."""
    rows = pages.where("html is not null").where(F.lower("html").rlike("<(article|main)[ >]")).where(F.octet_length("html") < PAGE_BYTES)
    ids = rows.select("page_id", F.xxhash64("page_id", F.lit(SEED)).alias("u")).orderBy("u", "page_id").limit(most)
    bound = ids.agg(F.max("u")).first()[0]
    texts = [] if bound is None else [r.html for r in rows.where(F.xxhash64("page_id", F.lit(SEED)) <= bound).select("page_id", "html").orderBy(F.xxhash64("page_id", F.lit(SEED)), F.xxhash64("html")).limit(most).collect()]
    rng = random.Random(SEED)
    data = []
    for t in texts:
        page = blocks(t)
        truth = labels(page)
        data.append((features(page), truth))
        for _ in range(2):
            made, y = relaid(page[:PAGE_BLOCKS], truth[:PAGE_BLOCKS], rng)
            data.append((features(made), y))
    return train(data)


def main_text(page: str, chain: Chain) -> str:
    found = blocks(page)
    return "\n".join(b.text for b, y in zip(found, chain.best(features(found))) if y)


def extracted(pages: DataFrame, chain: Chain | None = None) -> DataFrame:
    """One row for each row of `pages` (page_id, url, html): page_id, url, text, n_chars.

    A null or empty html, or a page without a main block, gives an empty text. Whole pages are read, however long. Repeated
    rows are extracted each; other columns are ignored. Without pages to learn from, all blocks count as main text. An empty table
    gives an empty one.
    """
    lean_batches(pages.sparkSession)
    chain = chain or fit(pages)
    held = pages.sparkSession.sparkContext.broadcast(chain)

    def run(batches):
        import pyarrow as pa

        let_go()
        for b in batches:
            text = [main_text(x, held.value) if x else "" for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(text, pa.string()), pa.array([len(x) for x in text], pa.int64())], ["page_id", "url", "text", "n_chars"])

    kinds = dict(pages.dtypes)
    return pages.select("page_id", "url", F.col("html").cast("string").alias("html")).mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
