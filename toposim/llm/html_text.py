"""HTML extraction by a recurrent block labeller.

A page is cut into leaf sequences (see ``blocks``).  Each has a vector of
its tag path (hashed names, classes, ids and roles of its ancestors, the
nearest weighing most), of its words (hashed) and of a few figures
(length, share of linked text, punctuation, depth, place).  A numpy
bidirectional LSTM reads the page's vectors in order and labels every
block as main text or not, so a block is judged by the whole page.

The network is trained here, once per driver process, with a fixed seed
on ``TRAIN_PAGES`` pages that ``sample_page`` writes: invented words in
many layouts of articles, menus, headers, sidebars, notices, adverts,
forms, footers and comments.  The weights (about 300 KB) go to the tasks
with the function.

Defined cases: a null or empty html has no text; a page without main
blocks gives the empty text; pages of any length are read whole; repeated
rows are each extracted; an empty table gives no rows; other columns are
kept by ``extract``.
"""

from __future__ import annotations

import functools
import random
import re
import zlib
from typing import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from toposim.llm.blocks import Block, blocks
from toposim.llm.common import table, texts_of
from toposim.session import ship

PATHS, WORDS, FIGURES, HIDDEN = 256, 32, 8, 24
TRAIN_PAGES, EPOCHS, SEED = 1_000, 14, 11
#: Blocks of all pages that go through the network together.
BATCH = 4_000
_NAME = re.compile(r"""(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
_WORD = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


# --- vectors -------------------------------------------------------------

#: Attribute texts below this length are kept between pages.
_SHORT = 500


def _hashed(tag: str, attrs: str) -> tuple[int, ...]:
    """Hashed names of one element."""
    words = ["<" + tag] + [w for m in _NAME.finditer(attrs) for w in _WORD.findall(_CAMEL.sub(" ", m[1] or m[2] or m[3] or "").lower()) if len(w) > 1]
    return tuple(zlib.crc32(w.rstrip("s").encode()) % PATHS for w in words)


_names = functools.lru_cache(maxsize=20_000)(_hashed)


@functools.lru_cache(maxsize=50_000)
def _word(w: str) -> int:
    return zlib.crc32(w.encode()) % WORDS


def vectors(page: list[Block]) -> np.ndarray:
    x = np.zeros((len(page), PATHS + WORDS + FIGURES), np.float32)
    long: dict[tuple[str, str], tuple[int, ...]] = {}
    for i, b in enumerate(page):
        weight = 1.0
        for element in reversed(b.path):
            if len(element[1]) < _SHORT:
                names = _names(*element)
            elif element in long:
                names = long[element]
            else:
                names = long[element] = _hashed(*element)
            for k in names:
                x[i, k] += weight
            weight *= 0.85
        words = b.text.lower().split()
        x[i, PATHS:PATHS + WORDS] = np.bincount([_word(w) for w in words], minlength=WORDS) / len(words) ** 0.75
        n = len(b.text)
        x[i, PATHS + WORDS:] = (np.log1p(n) / 4, min(b.linked / n, 1.0), min(b.text.count(",") + b.text.count("."), 20) / 10, len(b.path) / 8,
                                i / len(page), 1 / (1 + i), b.text[-1] in ".!?", "©" in b.text)
    np.minimum(x[:, :PATHS], 2.0, out=x[:, :PATHS])
    return x


# --- network -------------------------------------------------------------

def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def _start(seed: int) -> dict[str, np.ndarray]:
    r = np.random.default_rng(seed)
    d = PATHS + WORDS + FIGURES
    p = {}
    for side in "fb":
        p["w" + side] = (r.standard_normal((d, 4 * HIDDEN)) / np.sqrt(40)).astype(np.float32)
        p["u" + side] = (r.standard_normal((HIDDEN, 4 * HIDDEN)) / np.sqrt(HIDDEN)).astype(np.float32)
        p["c" + side] = np.repeat(np.array([0, 1, 0, 0], np.float32), HIDDEN)
    p["v"] = (r.standard_normal(2 * HIDDEN) / np.sqrt(HIDDEN)).astype(np.float32)
    p["d"] = np.zeros(1, np.float32)
    return p


def _run(z: np.ndarray, u: np.ndarray, mask: np.ndarray, keep: bool):
    """States (T, N, H) of one direction over inputs z (T, N, 4H); masked steps hold the state."""
    steps, n, _ = z.shape
    h = c = np.zeros((n, HIDDEN), np.float32)
    hs, tape = np.empty((steps, n, HIDDEN), np.float32), []
    for t in range(steps):
        a = z[t] + h @ u
        i, f, o = (_sigmoid(a[:, k * HIDDEN:(k + 1) * HIDDEN]) for k in range(3))
        g = np.tanh(a[:, 3 * HIDDEN:])
        new = f * c + i * g
        th = np.tanh(new)
        m = mask[t][:, None]
        if keep:
            tape.append((h, c, i, f, o, g, th, m))
        c = np.where(m, new, c)
        h = hs[t] = np.where(m, o * th, h)
    return hs, tape


def _back(dh_out: np.ndarray, tape, u: np.ndarray):
    steps, n, _ = dh_out.shape
    dz, du = np.zeros((steps, n, 4 * HIDDEN), np.float32), np.zeros_like(u)
    dh = dc = np.zeros((n, HIDDEN), np.float32)
    for t in range(steps - 1, -1, -1):
        h, c, i, f, o, g, th, m = tape[t]
        dh = dh + dh_out[t]
        dnew = np.where(m, dh * o * (1 - th * th) + dc, 0)
        do = np.where(m, dh * th, 0)
        da = np.concatenate([dnew * g * i * (1 - i), dnew * c * f * (1 - f), do * o * (1 - o), dnew * i * (1 - g * g)], axis=1)
        dz[t] = da
        du += h.T @ da
        dh, dc = np.where(m, 0, dh) + da @ u.T, np.where(m, dnew * f, dc)
    return dz, du


def _batch(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(len(x) for x in pages)
    x = np.zeros((steps, len(pages), pages[0].shape[1]), np.float32)
    mask = np.zeros((steps, len(pages)), bool)
    for k, p in enumerate(pages):
        x[:len(p), k] = p
        mask[:len(p), k] = True
    return x, mask


def _forward(p: dict, x: np.ndarray, mask: np.ndarray, keep: bool = False):
    hf, tf = _run(x @ p["wf"] + p["cf"], p["uf"], mask, keep)
    hb, tb = _run((x @ p["wb"] + p["cb"])[::-1], p["ub"], mask[::-1], keep)
    h = np.concatenate([hf, hb[::-1]], axis=2)
    return h @ p["v"] + p["d"], h, tf, tb


def train(pages: list[tuple[np.ndarray, np.ndarray]], epochs: int = EPOCHS, seed: int = SEED) -> dict[str, np.ndarray]:
    """Adam on the mean log loss per block, in batches of pages of like length."""
    p, r = _start(seed), np.random.default_rng(seed)
    m1, m2, step = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}, 0
    pages = sorted(pages, key=lambda q: len(q[1]))
    groups = [pages[i:i + 25] for i in range(0, len(pages), 25)]
    for epoch in range(epochs):
        for g in r.permutation(len(groups)):
            x, mask = _batch([q[0] for q in groups[g]])
            y = np.zeros(mask.shape, np.float32)
            for k, q in enumerate(groups[g]):
                y[:len(q[1]), k] = q[1]
            logit, h, tf, tb = _forward(p, x, mask, True)
            d = np.where(mask, _sigmoid(logit) - y, 0) / mask.sum()
            grad = {"v": np.tensordot(d, h, 2), "d": d.sum(keepdims=True).reshape(1)}
            dh = d[:, :, None] * p["v"]
            for side, dd, tape, xx in (("f", dh[:, :, :HIDDEN], tf, x), ("b", dh[::-1, :, HIDDEN:], tb, x[::-1])):
                dz, grad["u" + side] = _back(dd, tape, p["u" + side])
                flat = dz.reshape(-1, dz.shape[2])
                grad["w" + side] = xx.reshape(-1, xx.shape[2]).T @ flat
                grad["c" + side] = flat.sum(0)
            step += 1
            rate = 0.01 * (1 - epoch / epochs) + 0.001
            for k, v in grad.items():
                v = v + 1e-5 * p[k]
                m1[k] = 0.9 * m1[k] + 0.1 * v
                m2[k] = 0.99 * m2[k] + 0.01 * v * v
                p[k] = p[k] - rate * (m1[k] / (1 - 0.9 ** step)) / (np.sqrt(m2[k] / (1 - 0.99 ** step)) + 1e-8)
    return {k: v.astype(np.float32) for k, v in p.items()}


def label(p: dict, pages: list[list[Block]]) -> list[np.ndarray]:
    """Main text or not, per block of every page."""
    out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
    order = sorted((k for k, b in enumerate(pages) if b), key=lambda k: len(pages[k]))
    group: list[int] = []
    for k in [*order, None]:
        if group and (k is None or (len(group) + 1) * len(pages[k]) > BATCH):
            x, mask = _batch([vectors(pages[j]) for j in group])
            logit = _forward(p, x, mask)[0]
            for i, j in enumerate(group):
                out[j] = logit[:len(pages[j]), i] > 0
            group = []
        if k is not None:
            group.append(k)
    return out


# --- training pages ------------------------------------------------------

#: Names that sites give to parts of a page (common usage, stated as data).
_PARTS = {
    "menu": "nav navbar navigation menu topnav mainmenu breadcrumb breadcrumbs toc pagination pager links skip tabs submenu".split(),
    "header": "header masthead topbar banner site branding logo tagline top".split(),
    "side": "sidebar side aside widget related recommended popular trending rail secondary more teaser promo-list archive".split(),
    "notice": "cookie consent notice alert newsletter subscribe popup modal paywall gdpr message overlay announcement disclaimer warning".split(),
    "ad": "ad ads advert advertisement sponsor sponsored promo promotion banner adsense commercial affiliate".split(),
    "form": "form search login signup contact register feedback".split(),
    "footer": "footer colophon copyright legal bottom credits imprint site-footer foot".split(),
    "comments": "comments comment replies reply responses discussion disqus thread reader-comments respond feedback commentlist".split(),
    "share": "share social sharing tools tags meta-links follow buttons".split(),
}
_MAIN = "content post entry article body story text main articlebody page hentry prose copy richtext news blog".split()
_SAID = {
    "menu": "home about contact news login products services blog sitemap help".split(),
    "header": "welcome daily official site online the".split(),
    "side": "related popular latest trending read more also recommended posts archive".split(),
    "notice": "we use cookies accept privacy policy subscribe newsletter sign up consent agree".split(),
    "ad": "advertisement sponsored buy now offer sale free shop deal click".split(),
    "form": "email name password search submit send your required".split(),
    "footer": "© copyright all rights reserved terms privacy imprint".split(),
    "comments": "reply comment said says posted ago like thanks agree".split(),
    "share": "share tweet facebook print email tags follow".split(),
}


def sample_page(r: random.Random) -> str:
    """A page whose parts carry their label as ``data-y``."""
    sound = [a + b for a in "b d f g k l m n p r s t v th sh ei".split() for b in "a e i o u an er in on".split()]
    lexicon = ["".join(r.choices(sound, k=r.randint(1, 3))) for _ in range(120)]
    named = r.random() < 0.85  # some sites use no classes at all

    def words(n: int, said=(), share=0.0) -> str:
        return " ".join(r.choice(said) if said and r.random() < share else r.choice(lexicon) for _ in range(max(1, n)))

    def prose(n: int) -> str:
        out = []
        while n > 0:
            k = r.randint(1, 14)
            s = words(k)
            if r.random() < 0.12:
                s = s.replace(" ", r.choice([" <a href='/x'>", " <b>", " <em>"]), 1) + r.choice(["</a>", "</b>", "</em>", ""])
            out.append(s.capitalize() + r.choice([".", ".", ".", "?", "!", ","]))
            n -= k
        return " ".join(out)

    def attr(names: list[str], p: float = 0.9) -> str:
        if not named or r.random() > p:
            return ""
        n = r.choice(names)
        form = r.choice(["{}", "{}", "{}", "site-{}", "{}-box", "{}_wrap", "page-{}", "js-{}", "{}-container", "{} clearfix", "{}-list", "{}-area", "{}-item"])
        return f' {r.choice(["class", "class", "id"])}="{form.format(n)}"'

    def box(tag: str, a: str, y: int | None, inner: str) -> str:
        mark = "" if y is None else f' data-y="{y}"'
        return f"<{tag}{a}{mark}>{inner}</{tag}>"

    def links(said, n: int) -> str:
        item = lambda: f"<a href='/{words(1)}'>{words(r.randint(1, 4), said, 0.3)}</a>"
        if r.random() < 0.7:
            return "<ul>" + "".join(f"<li>{item()}</li>" for _ in range(n)) + "</ul>"
        return r.choice([" | ", " ", " &middot; "]).join(item() for _ in range(n)) if r.random() < 0.5 else "".join(f"<p>{item()}</p>" for _ in range(n))

    def part(kind: str) -> str:
        said, names = _SAID[kind], _PARTS[kind]
        tag = {"menu": "nav", "header": "header", "side": "aside", "footer": "footer", "form": "form", "comments": "section"}.get(kind, "div")
        strong = r.random() < 0.6
        tag = tag if strong else "div"
        a = attr(names, 0.5 if strong and tag != "div" else 1.0)
        if not a and tag in ("div", "section"):
            if kind not in ("menu", "footer"):  # nothing would tell it from the article
                a = f' class="{r.choice(names)}"'
        if kind in ("menu", "share"):
            inner = links(said, r.randint(2, 9))
        elif kind == "header":
            inner = r.choice([f"<h1>{words(r.randint(1, 4))}</h1>", f"<div>{words(3)}</div>", f"<p>{words(3)}</p>"]) + (links(said, 4) if r.random() < 0.4 else f"<p>{prose(r.randint(2, 8))}</p>")
        elif kind == "side":
            inner = "".join(f"<h3>{words(r.randint(1, 3), said, .5)}</h3>" + (links(said, r.randint(2, 6)) if r.random() < 0.6 else f"<p>{prose(r.randint(4, 40))}</p>") for _ in range(r.randint(1, 3)))
        elif kind == "form":
            inner = "".join(f"<label>{words(r.randint(1, 3), said, .5)}</label><input name='x'>" for _ in range(r.randint(1, 4))) + f"<button>{words(1, said, .8)}</button>" + (f"<p>{prose(8)}</p>" if r.random() < .4 else "")
        elif kind == "comments":
            def one() -> str:
                said_by = f"<p><b>{words(2)}</b></p>" if r.random() < .6 else ""
                body = f"<p>{prose(r.randint(3, 50))}</p>"
                return said_by + body if r.random() < .35 else box(r.choice(["div", "li", "article"]), attr(names), None, said_by + body)

            inner = (f"<h3>{words(2, said, .6)}</h3>" if r.random() < .7 else "") + "".join(one() for _ in range(r.randint(1, 6)))
        elif kind == "footer":
            inner = r.choice(["&copy; ", "", "&copy; ", "Copyright "]) + words(r.randint(1, 6), said, .5) + r.choice(["", " &middot; " + prose(r.randint(2, 25))]) + (links(said, 3) if r.random() < .4 else "")
        else:
            inner = r.choice(["", "<h4>" + words(2, said, .5) + "</h4>"]) + r.choice(["<p>{}</p>", "{}", "<span>{}</span>"]).format(prose(r.randint(2, 30)) + " " + words(2, said, r.random()))
        return box(tag, a, 0, inner)

    def main() -> str:
        title = words(r.randint(2, 10)).capitalize()
        head = f"<h1>{title}</h1>" if r.random() < 0.9 else ""
        if r.random() < 0.2 and head:
            head = box("header", attr(["entry", "article", "post"]), None, head + (f"<p>{prose(6)}</p>" if r.random() < .5 else ""))
        out = [head]
        for _ in range(r.choice([1, 2, 3, 5, 8, 14, 30])):
            k = r.random()
            if k < 0.62:
                out.append(f"<p>{prose(r.choice([2, 8, 25, 60, 120]))}</p>")
            elif k < 0.70:
                out.append(f"<p><b>{prose(30)}<br><p>{prose(20)}</p>")
            elif k < 0.78:
                out.append(f"<h{r.choice('234')}>{words(r.randint(1, 6))}</h{r.choice('234')}>")
            elif k < 0.84:
                out.append(r.choice(["<ul>", "<ol>"]) + "".join(f"<li>{prose(r.randint(2, 15))}" + r.choice(["</li>", ""]) for _ in range(r.randint(2, 5))) + "</ul>")
            elif k < 0.88:
                out.append(f"<blockquote>{prose(20)}</blockquote>")
            elif k < 0.91:
                out.append("<table>" + "".join(f"<tr><td>{words(2)}</td><td>{words(2)}</td></tr>" for _ in range(r.randint(1, 4))) + "</table>")
            elif k < 0.94:
                out.append(r.choice([f"<pre>{words(10)}</pre>", f"<figure><img src='x'><figcaption>{prose(6)}</figcaption></figure>", f"<div>{prose(30)}</div>"]))
            else:
                out.append(part(r.choice(["ad", "notice", "share", "side", "form"])))
        if r.random() < 0.15:
            out.append(part("comments"))
        tag = r.choice(["article", "article", "main", "div", "div", "section", "td"])
        inner = "".join(out)
        if r.random() < 0.3:
            inner = box("div", attr(_MAIN), None, inner)
        body = box(tag, attr(_MAIN, 0.4 if tag in ("article", "main") else 0.95), 1, inner)
        return box(r.choice(["main", "div"]), attr(["wrapper", "container", "page", "layout", "main", "content"]), None, body) if r.random() < 0.4 else body

    kinds = ["menu", "header", "ad", "notice", "side", "form", "share"]
    before = r.sample(kinds, r.randint(0, 4))
    after = r.sample(["comments", "comments", "side", "share", "ad", "notice", "form", "menu"], r.randint(0, 4))
    page = [part(k) for k in before] + [main()] + [part(k) for k in after] + ([part("footer")] if r.random() < 0.85 else [])
    return f"<html><head><title>{words(3)}</title></head><body>{''.join(page)}</body></html>"


_MARK = re.compile(r'data-y="(\d)"')


def labelled(page: str) -> tuple[np.ndarray, np.ndarray]:
    """Vectors and labels of a page with ``data-y`` marks (the innermost counts)."""
    found = blocks(page)
    y = [next((int(m[1]) for _, a in reversed(b.path) if (m := _MARK.search(a))), 0) for b in found]
    plain = [Block(b.text, tuple((t, _MARK.sub("", a)) for t, a in b.path), b.linked) for b in found]
    return vectors(plain), np.asarray(y, np.float32)


@functools.lru_cache(maxsize=1)
def trained(pages: int = TRAIN_PAGES, seed: int = SEED) -> dict[str, np.ndarray]:
    r = random.Random(seed)
    made = [labelled(sample_page(r)) for _ in range(pages)]
    return train([q for q in made if len(q[1])])


# --- extraction ----------------------------------------------------------

def main_texts(p: dict, pages: list[str]) -> list[str]:
    cut = [blocks(x) for x in pages]
    return ["\n\n".join(b.text for b, y in zip(bs, ys) if y) for bs, ys in zip(cut, label(p, cut))]


def extract(pages: DataFrame, html: str = "html", out: str = "text") -> DataFrame:
    """Adds ``out``, the main text of each page."""
    ship(pages.sparkSession)
    weights = trained()

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            texts = texts_of(s)
            yield pd.Series([t for i in range(0, len(texts), 500) for t in main_texts(weights, texts[i:i + 500])], dtype=object)

    return pages.withColumn(out, run(F.col(f"`{html}`")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return d.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
