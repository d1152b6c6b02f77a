"""Operator 2: main text of web pages by a recurrent block labeller."""

from __future__ import annotations

import random
import re
import zlib
from collections.abc import Iterator, Sequence
from html import escape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, python_ready
from .html_blocks import Block, leaf_blocks

#: The fit reads at most so many pages (smallest hash of the id) of at most so many characters.
TRAIN_PAGES, TRAIN_CHARS = 160, 60_000
PATH_BUCKETS, WORD_BUCKETS, PATH_DIM, WORD_DIM, HIDDEN = 2048, 2048, 16, 8, 20
EPOCHS, BATCH, RATE, VARIANTS = 8, 16, 0.01, 4
NUMERIC = 6

#: A block of so many characters is taken for prose where no page has landmarks.
PROSE_CHARS = 80

# Parameters of the weak teacher: landmarks whose text is the article or is not.
MAIN_TAGS = {"article", "main"}
OTHER_TAGS = {"nav", "aside", "footer", "header", "form", "dialog", "button"}
# Parameters of the variants: names that sites give to their parts.
MAIN_NAMES = ("article", "main", "content", "post", "entry", "story", "body", "text")
OTHER_NAMES = {
    "menu": ("menu", "nav", "navigation", "navbar", "breadcrumb", "topbar", "links", "tabs", "toc"),
    "header": ("header", "masthead", "banner", "logo", "site", "top"),
    "footer": ("footer", "copyright", "legal", "colophon", "bottom", "imprint"),
    "sidebar": ("sidebar", "side", "aside", "widget", "related", "recommended", "trending", "more", "tags"),
    "notice": ("notice", "cookie", "consent", "gdpr", "alert", "modal", "popup", "paywall", "privacy", "warning"),
    "ad": ("ad", "ads", "advert", "advertisement", "sponsored", "promo", "sponsor", "banner", "partner"),
    "form": ("form", "newsletter", "subscribe", "signup", "login", "search", "contact"),
    "comment": ("comment", "comments", "discussion", "replies", "reply", "respond", "thread", "disqus", "reviews"),
    "share": ("share", "social", "follow", "toolbar"),
}
PHRASES = {
    "menu": "Home|About|Contact|News|Products|Blog|Archive|Login|Help|FAQ",
    "header": "Welcome to our site|Your daily source|Est. 1998|Search",
    "footer": "© 2024 All rights reserved|Privacy policy|Terms of use|Imprint|Powered by",
    "sidebar": "Related articles|Most read|You may also like|Tags|Archives|Popular posts",
    "notice": "We use cookies to improve your experience. Accept|This site uses cookies|Subscribe to continue reading"
              "|Your privacy choices",
    "ad": "Advertisement|Sponsored|Buy now and save|Limited offer|Order today",
    "form": "Enter your email|Subscribe to our newsletter|Sign in|Username|Password|Send",
    "comment": "Great post, thanks!|I disagree with this|Reply|posted 3 days ago|Leave a comment|2 comments",
    "share": "Share|Tweet|Share on Facebook|Follow us",
}
MARK = ""


def _bucket(token: str, buckets: int, cache: dict[str, int]) -> int:
    found = cache.get(token)
    if found is None:
        if len(cache) > 500_000:
            cache.clear()
        found = cache[token] = zlib.crc32(token.encode("utf-8", "surrogatepass")) % buckets
    return found


class BlockFeatures:
    """Hashed tag-path words, hashed text words and a few shares of a block."""

    def __init__(self):
        self.paths: dict[str, int] = {}
        self.words: dict[str, int] = {}

    def path(self, block: Block) -> list[int]:
        tokens = [*(t for t in block.path.names if t not in ("html", "body")), "^" + block.path.last]
        return [_bucket(t, PATH_BUCKETS, self.paths) for t in tokens]

    def text(self, block: Block) -> list[int]:
        return [_bucket(w, WORD_BUCKETS, self.words) for w in block.text.lower().split()] or [0]

    @staticmethod
    def numbers(blocks: Sequence[Block]) -> np.ndarray:
        out = np.zeros((len(blocks), NUMERIC), np.float32)
        for k, b in enumerate(blocks):
            n = len(b.text)
            out[k] = (np.log1p(n) / 6, b.link_chars / n, sum(map(b.text.count, ".,;!?")) * 10 / n,
                      sum(map(b.text.count, "|»©•·")) * 10 / n, k / len(blocks), b.path.size / 10)
        return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class BlockLabeller:
    """A bidirectional LSTM over a page's blocks, in numpy.

    The input of a block is the sum of its path vectors, the mean of its word
    vectors and the shares; every block's logit reads the states of both directions, so it
    depends on the whole page.
    """

    def __init__(self, seed: int = 11):
        rng = np.random.default_rng(seed)
        d, h = PATH_DIM + WORD_DIM + NUMERIC, HIDDEN
        self.p = {"path": rng.normal(0, 0.1, (PATH_BUCKETS, PATH_DIM)), "word": rng.normal(0, 0.1, (WORD_BUCKETS, WORD_DIM)),
                  "out": rng.normal(0, 0.2, (2 * h, 1)), "bias": np.zeros(1)}
        for way in "fb":
            bias = np.zeros(4 * h)
            bias[h:2 * h] = 1.0  # remember by default
            self.p |= {way + "x": rng.normal(0, 0.3, (d, 4 * h)), way + "h": rng.normal(0, 0.2, (h, 4 * h)), way + "c": bias}
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}
        self.features = BlockFeatures()

    def __getstate__(self):
        return self.p

    def __setstate__(self, state):
        self.p, self.features = state, BlockFeatures()

    # -- input --------------------------------------------------------------

    def inputs(self, pages: list[list[Block]]):
        """X (time, page, feature), mask, and the hashed tokens per block."""
        steps, n = max(map(len, pages)), len(pages)
        x = np.zeros((steps, n, PATH_DIM + WORD_DIM + NUMERIC), np.float32)
        mask = np.zeros((steps, n, 1), np.float32)
        rows = [(t, k) for k, page in enumerate(pages) for t in range(len(page))]
        bags = []
        for name, dim, start, of in (("path", PATH_DIM, 0, self.features.path), ("word", WORD_DIM, PATH_DIM, self.features.text)):
            tokens = [of(b) for page in pages for b in page]
            sizes = np.array([len(t) for t in tokens])
            flat = np.fromiter((i for t in tokens for i in t), np.int64, sizes.sum())
            starts = np.r_[0, np.cumsum(sizes)[:-1]]
            sums = np.add.reduceat(self.p[name][flat], starts, 0)
            weights = 1 / sizes if name == "word" else np.ones(len(sizes))
            at = np.array(rows)
            x[at[:, 0], at[:, 1], start:start + dim] = sums * weights[:, None]
            bags.append((name, flat, sizes, weights, start, dim))
        at = np.array(rows)
        x[at[:, 0], at[:, 1], PATH_DIM + WORD_DIM:] = np.concatenate([BlockFeatures.numbers(p) for p in pages])
        mask[at[:, 0], at[:, 1], 0] = 1
        return x, mask, at, bags

    # -- the recurrence -----------------------------------------------------

    def run(self, x: np.ndarray, mask: np.ndarray, way: str, keep: bool = False):
        h = HIDDEN
        steps, n, _ = x.shape
        z = x @ self.p[way + "x"] + self.p[way + "c"]
        state, cell = np.zeros((n, h), np.float32), np.zeros((n, h), np.float32)
        out, trace = np.zeros((steps, n, h), np.float32), []
        for t in range(steps) if way == "f" else range(steps - 1, -1, -1):
            a = z[t] + state @ self.p[way + "h"]
            gates, g = _sigmoid(a[:, :3 * h]), np.tanh(a[:, 3 * h:])
            i, f, o = gates[:, :h], gates[:, h:2 * h], gates[:, 2 * h:]
            m = mask[t]
            new_cell = f * cell + i * g
            squashed = np.tanh(new_cell)
            if keep:
                trace.append((t, i, f, o, g, cell, squashed, state))
            cell = m * new_cell + (1 - m) * cell
            state = m * (o * squashed) + (1 - m) * state
            out[t] = state
        return (out, trace) if keep else out

    def back(self, x, mask, way, trace, d_out, grads):
        h = HIDDEN
        dz = np.zeros((*x.shape[:2], 4 * h), np.float32)
        d_state = np.zeros_like(d_out[0])
        d_cell = np.zeros_like(d_out[0])
        w = self.p[way + "h"]
        for t, i, f, o, g, cell, squashed, state in reversed(trace):
            m = mask[t]
            total = d_state + d_out[t]
            d_h = m * total
            d_c = m * d_cell + d_h * o * (1 - squashed ** 2)
            a = np.concatenate([d_c * g * i * (1 - i), d_c * cell * f * (1 - f), d_h * squashed * o * (1 - o),
                                d_c * i * (1 - g ** 2)], 1)
            dz[t] = a
            grads[way + "h"] += state.T @ a
            d_state = a @ w.T + (1 - m) * total
            d_cell = d_c * f + (1 - m) * d_cell
        grads[way + "x"] += np.einsum("tnd,tnk->dk", x, dz, optimize=True)
        grads[way + "c"] += dz.sum((0, 1))
        return dz @ self.p[way + "x"].T

    def logits(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        both = np.concatenate([self.run(x, mask, "f"), self.run(x, mask, "b")], 2)
        return (both @ self.p["out"] + self.p["bias"])[:, :, 0]

    # -- fit and use --------------------------------------------------------

    def fit(self, pages: list[tuple[list[Block], list[int]]], epochs: int = EPOCHS, seed: int = 5) -> None:
        """Adam on the mean logistic loss of all blocks of a batch of pages."""
        order, rng = [p for p in pages if p[0]], random.Random(seed)
        moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.p.items()}
        step = 0
        for epoch in range(epochs):
            rng.shuffle(order)
            rate = RATE * (1 - 0.8 * epoch / epochs)
            for start in range(0, len(order), BATCH):
                batch = sorted(order[start:start + BATCH], key=lambda p: len(p[0]))
                step += 1
                grads = self.gradients([b for b, _ in batch], [y for _, y in batch])
                size = np.sqrt(sum(float((g ** 2).sum()) for g in grads.values()))
                for k, g in grads.items():
                    first, second = moments[k]
                    g = g * min(1.0, 5.0 / (size + 1e-9))
                    first += 0.1 * (g - first)
                    second += 0.01 * (g * g - second)
                    self.p[k] -= (rate * (first / (1 - 0.9 ** step)) / (np.sqrt(second / (1 - 0.99 ** step)) + 1e-6)).astype(np.float32)

    def gradients(self, blocks: list[list[Block]], labels: list[list[int]]) -> dict[str, np.ndarray]:
        x, mask, at, bags = self.inputs(blocks)
        grads = {k: np.zeros_like(v) for k, v in self.p.items()}
        (hf, tf), (hb, tb) = self.run(x, mask, "f", True), self.run(x, mask, "b", True)
        both = np.concatenate([hf, hb], 2)
        z = (both @ self.p["out"] + self.p["bias"])[:, :, 0]
        y = np.zeros_like(z)
        y[at[:, 0], at[:, 1]] = np.concatenate([np.asarray(v, np.float32) for v in labels])
        d = ((_sigmoid(z) - y) * mask[:, :, 0] / mask.sum())[:, :, None].astype(np.float32)
        grads["out"] = np.einsum("tnh,tnk->hk", both, d)
        grads["bias"] = d.sum((0, 1))
        d_both = d @ self.p["out"].T
        dx = (self.back(x, mask, "f", tf, d_both[:, :, :HIDDEN], grads)
              + self.back(x, mask, "b", tb, d_both[:, :, HIDDEN:], grads))
        rows = dx[at[:, 0], at[:, 1]]
        for name, flat, sizes, weights, begin, dim in bags:
            each = np.repeat(rows[:, begin:begin + dim] * weights[:, None], sizes, 0)
            for f in range(dim):
                grads[name][:, f] = np.bincount(flat, each[:, f], len(grads[name]))
        return grads

    def labels(self, pages: list[list[Block]]) -> list[np.ndarray]:
        """Whether each block of each page is main text. Pages of like length run together."""
        out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
        order = sorted((k for k in range(len(pages)) if pages[k]), key=lambda k: len(pages[k]))
        start = 0
        while start < len(order):
            end = start + 1
            while end < len(order) and (end - start) < 256 and len(pages[order[end]]) <= 1.3 * len(pages[order[start]]) + 4:
                end += 1
            some = order[start:end]
            x, mask, _, _ = self.inputs([pages[k] for k in some])
            z = self.logits(x, mask)
            for j, k in enumerate(some):
                out[k] = z[:len(pages[k]), j] > 0
            start = end
        return out


def teacher_labels(blocks: list[Block]) -> list[int]:
    """Weak labels from landmarks: text under an article or main element, or a
    part of such a name, and under nothing that is named as something else."""
    other = {"." + w for names in OTHER_NAMES.values() for w in names}
    named = {"." + w for w in MAIN_NAMES}
    return [int((not MAIN_TAGS.isdisjoint(b.path.seen) or not named.isdisjoint(b.path.seen))
                and OTHER_TAGS.isdisjoint(b.path.seen) and other.isdisjoint(b.path.seen)) for b in blocks]


def prose_labels(blocks: list[Block]) -> list[int]:
    """Weaker labels, for samples without any landmark: long texts with few links."""
    return [int(len(b.text) >= PROSE_CHARS and b.link_chars < 0.3 * len(b.text)) for b in blocks]


def page_variant(main: list[str], spare: list[str], rng: random.Random) -> str:
    """A page of another layout with the same article. Article texts carry a
    mark; parts around them get names from the lists and texts from the fixed
    phrases or from other pages."""
    def part(kind: str) -> str:
        texts = [rng.choice(PHRASES[kind].split("|")) for _ in range(rng.randint(1, 3))]
        if spare and rng.random() < 0.6:
            texts += [rng.choice(spare) for _ in range(rng.randint(1, 3))]
        name = rng.choice(OTHER_NAMES[kind])
        if rng.random() < 0.3:
            name = rng.choice((f"site-{name}", f"{name}-box", f"{name} wide", f"js-{name}"))
        tag = {"menu": "nav", "header": "header", "footer": "footer", "sidebar": "aside", "form": "form"}.get(kind)
        if tag is None or rng.random() < 0.5:
            tag = rng.choice(("div", "section", "div", "ul" if kind == "menu" else "div"))
            attribute = f' {rng.choice(("class", "class", "id"))}="{name}"'
        else:
            attribute = "" if rng.random() < 0.5 else f' class="{name}"'
        inner = {"menu": "<li><a href='/x'>{}</a></li>", "form": rng.choice(("<label>{}</label><input>", "<button>{}</button>", "<p>{}</p>")),
                 "comment": rng.choice(("<p>{}</p>", "<div><p>{}</p></div>", "<ul><li>{}</li></ul>"))}.get(
            kind, rng.choice(("<p>{}</p>", "<div>{}</div>", "<a href='/y'>{}</a><br>", "<h3>{}</h3>", "{} ")))
        return f"<{tag}{attribute}>" + "".join(inner.format(escape(t)) for t in texts) + f"</{tag}>"

    before = [part(k) for k in ("header", "menu", "notice", "ad", "form", "sidebar", "share") if rng.random() < 0.45]
    after = [part(k) for k in ("comment", "sidebar", "share", "ad", "form", "notice", "menu", "footer") if rng.random() < 0.45]
    if rng.random() < 0.9:
        tag = rng.choice(("article", "main", "article", "div", "div", "section"))
        name = f' {rng.choice(("class", "id"))}="{rng.choice(MAIN_NAMES)}"' if tag in ("div", "section") or rng.random() < 0.3 else ""
    else:
        tag, name = "div", ""
    body = []
    for k, text in enumerate(main):
        own = "h1" if k == 0 and len(text) < 120 else rng.choice(("p", "p", "p", "p", "p", "h2" if len(text) < 80 else "p", "div",
                                                                  "blockquote", "li", "td"))
        items = [text] + ([rng.choice(spare) for _ in range(rng.randint(0, 3))] if own in ("li", "td") and spare else [])
        closed = rng.random() < 0.85 or own in ("li", "td")
        inner = "".join(f"<{own}>{MARK}{escape(t)}" + f"</{own}>" * closed for t in items)
        body.append({"li": "<ul>{}</ul>", "td": "<table><tr>{}</tr></table>"}.get(own, "{}").replace("{}", inner))
        if rng.random() < 0.12:
            body.append(part(rng.choice(("ad", "share", "sidebar", "sidebar", "form", "notice"))))
    inside = [part(k) for k in ("comment", "share", "sidebar", "form") if rng.random() < 0.25]
    return ("<html><body>" + "".join(before) + f"<{tag}{name}>" + "".join(body) + "".join(inside) + f"</{tag}>"
            + "".join(after) + "</body></html>")


def page_variants(own: list[tuple[list[Block], list[int]]], n: int, rng: random.Random) -> list[tuple[list[Block], list[int]]]:
    """``n`` labelled variants of each page. Texts of articles and of other
    parts change places now and then, so a text alone says little."""
    spare = [b.text for blocks, _ in own for b in blocks if len(b.text) < 400]
    made = []
    for blocks, labels in own:
        main = [b.text for b, y in zip(blocks, labels) if y]
        for _ in range(n):
            begin = rng.randrange(len(main))
            some = [rng.choice(spare) if rng.random() < 0.15 else t for t in main[begin:begin + rng.randint(1, 30)]]
            page = leaf_blocks(page_variant(some, spare, rng))
            made.append(([Block(b.text.replace(MARK, ""), b.path, b.link_chars) for b in page],
                         [int(MARK in b.text) for b in page]))
    return made


def fit_labeller(pages: DataFrame, html: str = "html", limit: int = TRAIN_PAGES, chars: int = TRAIN_CHARS) -> BlockLabeller | None:
    """Fit on a bounded sample of ``pages`` (page_id, html), whole pages of at
    most ``chars`` characters, and a few variants of each. The labels come from
    the pages' own landmarks, or if no page has any from their long texts;
    variants let the labeller meet layouts and parts that the sample does not
    have. None without a page that has either."""
    fit = pages.where((F.length(html) > 0) & (F.length(html) <= chars)).withColumn("pick", F.xxhash64("page_id", html))
    # Only hashes are ranked, so that what reaches the driver is the sample.
    picks = {r["pick"] for r in fit.select("pick").orderBy("pick").limit(limit).collect()}
    sample = (fit.where(F.col("pick").isin(*picks)).groupBy("pick").agg(F.min(html).alias(html))
              .orderBy("pick").select(html).collect()) if picks else []
    rng = random.Random(3)
    found = [leaf_blocks(r[0]) for r in sample]
    for teacher in (teacher_labels, prose_labels):
        own = [(b, y) for b in found if any(y := teacher(b))]
        if own:
            labeller = BlockLabeller()
            labeller.fit(own + page_variants(own, VARIANTS, rng))
            return labeller
    return None


def _texts(batches: Iterator[pa.RecordBatch], labeller: BlockLabeller | None) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            part = batch.slice(at, 1024)
            pages = [leaf_blocks(h) for h in part.column("html").to_pylist()]
            texts = ["\n".join(b.text for b, keep in zip(blocks, own) if keep)
                     for blocks, own in zip(pages, labeller.labels(pages) if labeller else [[True] * len(p) for p in pages])]
            yield pa.RecordBatch.from_arrays(
                [part.column("page_id"), part.column("url"), pa.array(texts, pa.string()),
                 pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                 limit: int = TRAIN_PAGES) -> DataFrame:
    """``page_id, url, text, n_chars`` of every row of ``pages``.

    A page is cut into leaf blocks; the labeller, fitted here on a bounded
    sample, tells for each block whether it is main text, reading the whole
    page. Character references are decoded, white space is one blank, blocks
    are joined by a newline; none is shortened.

    A null or empty page, or one without main text, gives an empty text. Null
    ids and urls pass through, repeated rows give equal results, an empty
    table gives no rows. Where no page of the sample has a landmark or a long
    text, there is nothing to learn from and all blocks are kept. Other columns
    are not read.
    """
    python_ready(pages.sparkSession)
    source = pages.select(col(id_col).alias("page_id"), col(url_col).alias("url"),
                          F.coalesce(col(html_col), F.lit("")).alias("html"))
    labeller = fit_labeller(source, "html", limit)
    kind, url = (source.schema[c].dataType.simpleString() for c in ("page_id", "url"))
    return source.mapInArrow(lambda it: _texts(it, labeller), f"page_id {kind}, url {url}, text string, n_chars long")
