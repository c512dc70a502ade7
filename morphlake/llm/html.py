"""Main text of web pages by a linear-chain conditional random field over leaf blocks.

A page is read into leaf blocks: runs of text that no block-level tag interrupts. A block's
features are the tags, classes, ids and roles of its ancestors and the shape of its text. The
field has two labels, main text or not, weights for each feature and each pair of neighbouring
labels; it is trained by gradient ascent on the likelihood of labelled pages, and pages are
decoded by Viterbi, a batch of pages in step. The labelled pages come from a seeded generator
of page layouts (articles with menus, headers, footers, sidebars, notices, adverts, forms and
reader comments around and inside them), so training is the same everywhere.

Defined cases: null, empty and text-free html give an empty text. Scripts, styles, titles and
comments of the markup never give blocks; an unclosed one runs to the page's end. Text that stands
in for what a browser can't or won't show (`noscript`, `object` and their like) is a block of its
own, and the field decides on it. A
`<` that opens no tag is text. Nothing is cut: any number of blocks of any length is read.
Rows that repeat an id are each extracted. Extra columns pass through in `extract`; one with the
name of the result gives way to it. The time to read a page follows its length, however
its tags are broken.
"""

from __future__ import annotations

import html as entities
import random
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from morphlake.llm.common import bounded_batches, slices, table

ROWS = 1 << 14  # hashed features
TRAIN_PAGES, SEED, STEPS, RATE, DECAY = 400, 20, 250, 0.1, 1e-3

#: Fixed values of HTML: elements that never hold text of the page, that have no end tag, and that break a line of text.
HIDDEN = "script|style|title"
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html label legend li main menu nav ol optgroup option p pre section select summary table tbody td textarea tfoot th thead tr ul".split())
#: Elements shown in place of something else; their text stands in blocks of its own, and a line goes on around one without text.
APART = frozenset("canvas iframe noscript object svg template".split())
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}

_INSIDE = r"""(?:[^>"']|"[^"]*"|'[^']*')*+"""
_TAG = re.compile(
    rf"<!--.*?(?:(?P<ended>-->)|\Z)|<(?P<hidden>{HIDDEN})\b{_INSIDE}(?:(?<=(?P<empty>/))>|>.*?(?:(?P<shut></(?P=hidden)\s*>)|\Z))"
    rf"|<[!?][^>]*>|<(?P<slash>/?)(?P<name>[a-zA-Z][\w:-]*)(?P<inside>{_INSIDE})>|</?[a-zA-Z][^>]*>",
    re.S | re.I,
)
_NAMES = re.compile(r"""\b(?:class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_PART = re.compile(r"[A-Za-z]+?(?=[A-Z][a-z]|[^A-Za-z]|$)")


def _row(name: str) -> int:
    return zlib.crc32(name.encode()) % ROWS


@lru_cache(1 << 14)
def _frame(above: tuple, tag: str, attributes: str) -> tuple:
    """Feature rows of an element and all above it."""
    own = {_row(f"in {tag}")}
    for m in _NAMES.finditer(attributes):
        for part in _PART.findall(next(x for x in m.groups() if x is not None)):
            own.add(_row(f"name {part.lower()}"))
    return tuple(sorted({*above, *own}))


class _Open:
    """The elements that are open at a place of a page, outermost first."""

    def __init__(self) -> None:
        self.frames: list[tuple[str, tuple]] = []  # name and feature rows
        self.places: dict[str, list[int]] = {}  # where the elements of each name stand among them
        self.blocks: list[int] = []  # where the block-level ones stand
        self.links = 0
        self.aparts: list[int] = []  # where those of APART stand

    def push(self, name: str, attributes: str) -> None:
        at = len(self.frames)
        self.frames.append((name, _frame(self.rows, name, attributes)))
        self.places.setdefault(name, []).append(at)
        if name in BLOCK:
            self.blocks.append(at)
        self.links += name == "a"
        if name in APART:
            self.aparts.append(at)

    def cut(self, at: int) -> None:
        """Closes all from this place on."""
        while len(self.frames) > at:
            name, _ = self.frames.pop()
            self.places[name].pop()
            if name in BLOCK:
                self.blocks.pop()
            self.links -= name == "a"
            if name in APART:
                self.aparts.pop()

    def close(self, name: str) -> None:
        """An end tag. One of an inline element closes nothing beyond its block; one without a start tag, nothing."""
        places = self.places.get(name)
        if places and (name in BLOCK or name in APART or not self.blocks or places[-1] > self.blocks[-1]):
            self.cut(places[-1])

    def close_block(self, names: set[str]) -> None:
        """What the start tag of another block closes, if that is the nearest block and nothing apart is open in it."""
        if self.blocks and self.frames[self.blocks[-1]][0] in names and not (self.aparts and self.aparts[-1] > self.blocks[-1]):
            self.cut(self.blocks[-1])

    @property
    def rows(self) -> tuple:
        return self.frames[-1][1] if self.frames else ()

    @property
    def holder(self) -> str:
        return self.frames[self.blocks[-1]][0] if self.blocks else ""


def blocks_of(page: str) -> list[tuple[str, tuple]]:
    """(text, feature rows) of each leaf block with text."""
    out: list[tuple[str, tuple, str, int]] = []
    open_ = _Open()
    pieces: list[str] = []
    links, where, apart, at = 0, None, 0, 0

    def flush() -> None:
        nonlocal pieces, links, where
        if pieces:
            text = " ".join(entities.unescape("".join(pieces)).split())
            if text:
                tag, rows = where or ("", ())
                out.append((text, rows, tag, links))
        pieces, links, where = [], 0, None

    def say(text: str) -> None:
        nonlocal links, where, apart
        if text.strip():
            if where is not None and len(open_.aparts) != apart:
                flush()
            if where is None:
                where, apart = (open_.holder, open_.rows), len(open_.aparts)
        pieces.append(text)
        if open_.links:
            links += len(text)

    # No tag ends beyond the last >, so none is looked for there; only an unclosed comment begins there.
    end = page.rfind(">") + 1
    if (hidden := page.find("<!--", end)) >= 0:
        page = page[:hidden]
    for m in _TAG.finditer(page, 0, end):
        if m.start() > at:
            say(page[at : m.start()])
        at = m.end()
        name = m["name"]
        if name is None:
            if m.end() == end and _unclosed(m):
                at = len(page)
            continue
        name = name.lower()
        if m["slash"]:
            if name in BLOCK:
                flush()
            open_.close(name)
            continue
        if name == "br":
            pieces.append(" ")
            continue
        if name in BLOCK:
            flush()
            open_.close_block(CLOSES.get(name, {"p"} if name not in ("button", "label", "option") else set()))
        if name in VOID or m["inside"].endswith("/"):
            continue
        open_.push(name, m["inside"])
    if at < len(page):
        say(page[at:])
    flush()
    n = len(out)
    return [(text, (*rows, *_shape(text, tag, links, i, n))) for i, (text, rows, tag, links) in enumerate(out)]


def _unclosed(m: re.Match) -> bool:
    """Whether a hidden element or a comment runs on beyond the last tag."""
    return not (m["ended"] or m["shut"] or m["empty"]) and (m["hidden"] is not None or m[0].startswith("<!--"))


def _shape(text: str, tag: str, links: int, i: int, n: int) -> tuple:
    words = text.count(" ") + 1
    share = min(4, 5 * links // max(len(text), 1))
    ends = text[-1] if text[-1] in ".!?:…" else "-"
    size = min(words.bit_length(), 8)
    first = "©" if text[0] == "©" or text[:9].lower() == "copyright" else "-"
    return tuple(_row(x) for x in ("any", f"tag {tag}", f"size {size}", f"links {share}", f"end {ends}", f"tag {tag} size {size}", f"tag {tag} links {share}", f"first {first}", f"place {'only' if n == 1 else 'first' if i == 0 else 'last' if i == n - 1 else 'inner'}"))


class Field:
    """w: [ROWS, 2] of features; t: [2, 2] of neighbours (from, to); s: [2] of the first block."""

    def __init__(self):
        self.w, self.t, self.s = np.zeros((ROWS, 2)), np.zeros((2, 2)), np.zeros(2)

    def emissions(self, features: list[tuple]) -> np.ndarray:
        counts = np.array([len(x) for x in features], np.int64)
        if not len(counts):
            return np.zeros((0, 2))
        flat = np.fromiter((r for x in features for r in x), np.int64, counts.sum())
        return np.add.reduceat(self.w[flat], np.cumsum(counts) - counts, axis=0)

    def decode(self, emissions: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The likeliest labels of all blocks of several pages, longest pages first in step."""
        out = np.zeros(len(emissions), np.int8)
        starts = np.cumsum(sizes) - sizes
        order = np.argsort(-sizes, kind="stable")
        order = order[sizes[order] > 0]
        if not len(order):
            return out
        live = [len(order)]
        best = self.s + emissions[starts[order]]
        back = []
        for k in range(1, int(sizes[order[0]])):
            n = int(np.searchsorted(-sizes[order], -k, side="left"))  # pages with more than k blocks
            reach = best[:n, :, None] + self.t
            back.append(reach.argmax(axis=1).astype(np.int8))
            step = reach.max(axis=1) + emissions[starts[order[:n]] + k]
            best = np.concatenate([step, best[n:]])
            live.append(n)
        label = best.argmax(axis=1).astype(np.int8)
        for k in range(len(live) - 1, -1, -1):
            n = live[k]
            out[starts[order[:n]] + k] = label[:n]
            if k:
                label[:n] = back[k - 1][np.arange(n), label[:n]]
        return out


def train(pages: list[tuple[list[tuple], np.ndarray]], steps: int = STEPS) -> Field:
    """Gradient ascent (Adam) on the log-likelihood of (features, labels) of each page."""
    field = Field()
    pages = [x for x in pages if len(x[1])]
    sizes = np.array([len(y) for _, y in pages], np.int64)
    longest = int(sizes.max())
    counts = np.array([len(f) for x, _ in pages for f in x], np.int64)
    flat = np.fromiter((r for x, _ in pages for f in x for r in f), np.int64, counts.sum())
    owner = np.repeat(np.arange(len(counts)), counts)
    page, place = np.repeat(np.arange(len(pages)), sizes), np.concatenate([np.arange(n) for n in sizes])
    truth = np.concatenate([y for _, y in pages])
    on = np.arange(longest)[None, :] < sizes[:, None]
    gold = np.zeros((len(pages), longest, 2))
    gold[page, place, truth] = 1
    gold_pairs = np.einsum("pka,pkb->ab", gold[:, :-1], gold[:, 1:])
    params = [field.w, field.t, field.s]
    moments = [[np.zeros_like(x), np.zeros_like(x)] for x in params]
    for step in range(1, steps + 1):
        e = np.zeros((len(pages), longest, 2))
        e[page, place] = np.add.reduceat(field.w[flat], np.cumsum(counts) - counts, axis=0)
        forward, backward = np.zeros_like(e), np.zeros_like(e)
        forward[:, 0] = field.s + e[:, 0]
        for k in range(1, longest):
            forward[:, k] = np.where(on[:, k, None], np.logaddexp.reduce(forward[:, k - 1, :, None] + field.t, axis=1) + e[:, k], forward[:, k - 1])
        total = np.logaddexp.reduce(forward[:, -1], axis=1)
        pairs = np.zeros((2, 2))
        for k in range(longest - 1, 0, -1):
            ahead = np.where(on[:, k, None], e[:, k] + backward[:, k], 0)
            backward[:, k - 1] = np.where(on[:, k, None], np.logaddexp.reduce(field.t + ahead[:, None, :], axis=2), 0)
            joint = np.exp(forward[:, k - 1, :, None] + field.t + ahead[:, None, :] - total[:, None, None])
            pairs += (joint * on[:, k, None, None]).sum(axis=0)
        chance = np.exp(forward + backward - total[:, None, None]) * on[..., None]
        miss = (gold - chance)[page, place]
        g = [np.stack([np.bincount(flat, miss[owner, c], ROWS) for c in (0, 1)], axis=1) / len(pages) - DECAY * field.w, (gold_pairs - pairs) / len(pages) - DECAY * field.t, (gold - chance)[:, 0].sum(axis=0) / len(pages)]
        for x, v, (m, s) in zip(params, g, moments, strict=True):
            m += 0.1 * (v - m)
            s += 0.01 * (v * v - s)
            x += RATE * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)
    return field


# ---------------------------------------------------------------- labelled pages

_YES, _NO = "zzmain", "zzrest"


def labelled_page(r: random.Random) -> str:
    """A page whose every block begins with a word that tells its label."""
    sound = "ba ce di fo gu la me ni po ru sa te vi wo ya ze".split()
    word = lambda: "".join(r.choice(sound) for _ in range(r.randint(1, 4)))
    words = lambda a, b: " ".join(word() for _ in range(r.randint(a, b)))

    def sentences(n: int) -> str:
        return " ".join(words(3, 14).capitalize() + r.choice("....!?") for _ in range(n))

    mark = lambda label, x: f"{label} {x}"
    no = lambda x: mark(_NO, x)
    attr = lambda *names: r.choice(['class="{}"', 'id="{}"', 'class="x-{}"', 'class="{} clear"']).format(r.choice(names))
    anchor = lambda x: f'<a href="/{word()}">{x}</a>'
    links = lambda a, b: "<ul>" + "".join(f"<li>{anchor(no(words(1, 3)))}</li>" for _ in range(r.randint(a, b))) + "</ul>"
    wrap = lambda tag, a, x: f"<{tag}{' ' + a if a else ''}>{x}</{tag}>"

    def menu() -> str:
        return wrap("nav", "", links(3, 8)) if r.random() < 0.6 else wrap("div", attr("menu", "navbar", "nav", "navigation", "topnav", "breadcrumb", "breadcrumbs"), links(3, 8))

    def head() -> str:
        inner = wrap(r.choice(["div", "p", "span", "h1", "h2"]), r.choice(["", attr("logo", "site-title", "brand", "tagline")]), no(words(1, 6))) + (menu() if r.random() < 0.5 else "")
        return wrap("header", r.choice(["", attr("site-header", "masthead")]), inner) if r.random() < 0.6 else wrap("div", attr("header", "masthead", "top", "banner", "topbar"), inner)

    def notice() -> str:
        return wrap(r.choice(["div", "section", "p", "aside"]), attr("notice", "cookie", "cookies", "consent", "alert", "banner", "newsletter", "subscribe", "popup", "paywall", "gdpr", "disclaimer"), r.choice(["", "<p>"]) + no(sentences(r.randint(1, 3))) + r.choice(["", f"<button>{no(words(1, 2))}</button>"]))

    def advert() -> str:
        return wrap(r.choice(["div", "div", "aside", "section", "ins"]), attr("ad", "ads", "advert", "advertisement", "sponsored", "sponsor", "promo", "promotion", "banner-ad"), r.choice(["<p>{}</p>", "{}", "<div>{}</div>"]).format(no(r.choice([words(2, 8), sentences(r.randint(1, 3))]))))

    def side() -> str:
        inner = r.choice(["<h2>{}</h2>", "<h3>{}</h3>", "<p>{}</p>"]).format(no(words(1, 4))) + r.choice([links(2, 7), f"<p>{no(sentences(r.randint(1, 4)))}</p>"])
        return wrap("aside", r.choice(["", attr("sidebar", "widget")]), inner) if r.random() < 0.6 else wrap(r.choice(["div", "section"]), attr("sidebar", "widget", "related", "trending", "recommended", "popular", "share", "social", "tags", "author-bio"), inner)

    def form() -> str:
        return wrap("form", r.choice(["", attr("search", "login", "signup", "contact")]), "".join(f"<label>{no(words(1, 4))}</label><input>" for _ in range(r.randint(1, 3))) + r.choice(["", f"<select><option>{no(word())}</option><option>{no(word())}</option></select>", f"<p>{no(sentences(1))}</p>"]) + f"<button>{no(words(1, 2))}</button>")

    def comments() -> str:
        each = "".join(wrap(r.choice(["div", "li", "article"]), attr("comment", "reply", "response"), r.choice(["<b>{}</b>", "<h4>{}</h4>", "<span>{}</span><br>"]).format(no(words(1, 2))) + f"<p>{no(sentences(r.randint(1, 5)))}</p>") for _ in range(r.randint(1, 4)))
        return wrap(r.choice(["section", "div", "ol"]), attr("comments", "comment-list", "responses", "discussion", "replies", "disqus"), r.choice(["", f"<h2>{no(words(1, 3))}</h2>", f"<h3>{no(words(1, 3))}</h3>"]) + each)

    def foot() -> str:
        text = no(r.choice(["&copy; ", "Copyright ", "", "&#169; "]) + words(2, 5) + r.choice([" &middot; ", " ", " | "]) + sentences(r.randint(1, 3)))
        inner = r.choice(["{}", "<p>{}</p>", "<div>{}</div>"]).format(text) + (links(2, 5) if r.random() < 0.3 else "")
        return wrap("footer", "", inner) if r.random() < 0.7 else wrap("div", attr("footer", "copyright", "bottom", "legal", "credits"), inner)

    def instead() -> str:
        kind = r.choice(sorted(APART))
        text = no(r.choice([words(2, 8), sentences(1)]))
        return wrap(kind, "", f"<text>{text}</text>" if kind == "svg" else text)

    def outside() -> str:
        return wrap(r.choice(sorted(APART)), "", r.choice(["<p>{}</p>", "<div>{}</div>", "{}"]).format(no(sentences(r.randint(1, 3)))))

    def part() -> str:
        inner = plain_part()
        return wrap(r.choice(sorted(APART)), "", inner) if r.random() < 0.06 else inner

    def plain_part() -> str:
        kind = r.random()
        yes = lambda x: mark(_YES, x)
        if kind < 0.7:
            text = yes(sentences(r.choice([1, 1, 2, 4, 7])) if r.random() < 0.9 else words(1, 5))
            if r.random() < 0.2:
                text += " " + anchor(words(1, 3)) + " " + words(1, 6) + "."
            return r.choice([f"<p>{text}</p>"] * 4 + [f"<p><b>{text}<br>", f"<p>{text}", f"<div>{text}</div>"])
        if kind < 0.78:
            return r.choice(["<h2>{}</h2>", "<h3>{}</h3>", "<h4>{}</h4>"]).format(yes(words(1, 8)))
        if kind < 0.86:
            return "<ul>" + "".join(f"<li>{yes(words(2, 12))}</li>" for _ in range(r.randint(2, 5))) + "</ul>"
        if kind < 0.92:
            return wrap("blockquote", "", f"<p>{yes(sentences(2))}</p>")
        if kind < 0.95:
            return wrap("pre", "", yes(words(3, 20)))
        if kind < 0.97:
            return "<table>" + "".join(f"<tr><td>{yes(words(1, 4))}</td><td>{yes(words(1, 4))}</td></tr>" for _ in range(3)) + "</table>"
        return wrap("figure", "", f"<img><figcaption>{yes(words(3, 10))}</figcaption>")

    parts = [f"<h1>{mark(_YES, words(2, 12))}</h1>"] + [part() for _ in range(r.choice([0, 1, 2, 3, 5, 8, 14]))]
    for make in (advert, notice, side, form, comments, instead):
        if r.random() < 0.12:
            parts.insert(r.randint(1, len(parts)), make())
    body = "".join(parts)
    style = r.random()
    if style < 0.45:
        body = wrap("article", r.choice(["", attr("post", "entry")]), body if r.random() < 0.8 else wrap("header", "", parts[0]) + "".join(parts[1:]))
    elif style < 0.65:
        body = wrap("main", "", body)
    elif style < 0.95:
        body = wrap(r.choice(["div", "section"]), attr("content", "post", "entry", "article", "story", "main", "article-body", "post-content", "entry-content"), body)
    before = [make() for make, chance in ((notice, 0.25), (head, 0.5), (menu, 0.7), (form, 0.15), (advert, 0.5), (side, 0.2), (outside, 0.2)) if r.random() < chance]
    after = [make() for make, chance in ((advert, 0.2), (comments, 0.4), (side, 0.35), (form, 0.15), (notice, 0.15), (outside, 0.1), (foot, 0.85)) if r.random() < chance]
    if r.random() < 0.3:
        r.shuffle(before)
    inner = "".join([*before, body, *after])
    if r.random() < 0.2:
        inner = wrap("div", attr("page", "wrapper", "container"), inner)
    return f"<!DOCTYPE html><html><head><title>{words(1, 5)}</title><script>var t='</p>';</script></head><body>{inner}" + ("</body></html>" if r.random() < 0.85 else "")


def labelled_pages(n: int = TRAIN_PAGES, seed: int = SEED) -> list[tuple[list[tuple], np.ndarray]]:
    """Features and labels of generated pages."""
    r, out = random.Random(seed), []
    for _ in range(n):
        page = labelled_page(r)
        labels = [(_YES in t, t) for t, _ in blocks_of(page)]
        plain = blocks_of(re.sub(rf"{_YES} |{_NO} ", "", page))
        if len(plain) == len(labels):
            out.append(([f for _, f in plain], np.array([y for y, _ in labels], np.int64)))
    return out


def extract_texts(field: Field, pages: list[str | None]) -> list[str]:
    read = [blocks_of(x or "") for x in pages]
    sizes = np.array([len(x) for x in read], np.int64)
    labels = field.decode(field.emissions([f for x in read for _, f in x]), sizes)
    ends = np.cumsum(sizes)
    return ["\n".join(t for (t, _), y in zip(x, labels[e - n : e], strict=True) if y) for x, e, n in zip(read, ends.tolist(), sizes.tolist(), strict=True)]


def extract(pages: DataFrame, html_col: str = "html", name: str = "__text", field: Field | None = None) -> DataFrame:
    """pages with the main text; html is left out."""
    pages = pages.drop(name) if name != html_col else pages
    bounded_batches(pages.sparkSession)
    model = pages.sparkSession.sparkContext.broadcast(field or train(labelled_pages()))
    others = [f for f in pages.schema.fields if f.name != html_col]

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, html_col):
                texts = extract_texts(model.value, piece.column(html_col).to_pylist())
                yield pa.RecordBatch.from_arrays([*(piece.column(f.name) for f in others), pa.array(texts, pa.string())], names=[*(f.name for f in others), name])

    return pages.mapInArrow(go, T.StructType([*others, T.StructField(name, T.StringType())]))


def query(spark, sf_dir: str) -> DataFrame:
    out = extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "url", F.col("__text").alias("text"), F.char_length("__text").cast("long").alias("n_chars"))
