"""HTML extraction by a recurrent block labeller.

A page is cut into leaf blocks: stretches of text between block-level tags. Each block is a vector of its hashed tag path (tags, classes, ids and roles of all open
elements), its hashed words and a few counts. A bidirectional LSTM in numpy reads the page's blocks in order and labels each as main text or not, so that a block is judged in
the context of the whole page. The weights (llm/html_blocks.npz) come from train_html.py, which trains on pages that it makes itself.
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from functools import lru_cache
from html.parser import HTMLParser

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm.common import per_row, table

PATHS, WORDS, COUNTS = 64, 16, 8
WIDTH, HIDDEN = PATHS + WORDS + COUNTS, 24

#: Elements that are not text, elements within a line, and elements without an end tag.
SILENT = frozenset("script style noscript template svg math iframe object canvas audio video head title select textarea button".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An element of the first kind is closed where one of its list begins.
CLOSES = {
    "p": frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()),
    "li": frozenset(["li"]),
    "dt": frozenset(["dt", "dd"]),
    "dd": frozenset(["dt", "dd"]),
    "tr": frozenset(["tr"]),
    "td": frozenset(["td", "th", "tr"]),
    "th": frozenset(["td", "th", "tr"]),
    "option": frozenset(["option"]),
}
_NAMES = re.compile(r"[a-z]+|\d+")


@lru_cache(1 << 16)
def _slot(word: str, width: int) -> tuple[int, float]:
    h = zlib.crc32(word.encode())
    return h % width, 1.0 if h >> 16 & 1 else -1.0


class Open:
    """An open element. sums: the hashed names (tags, classes, ids, roles) of it and of all elements around it; last: the last two of those names. Each element adds its own
    names to what the one around it has, so that deep pages cost no more than long ones."""

    __slots__ = ("tag", "sums", "last", "_vector")

    def __init__(self, tag: str, names: list[str], around: Open | None):
        self.tag, self.sums, self._vector = tag, np.zeros(PATHS, np.float32) if around is None else around.sums.copy(), None
        for name in names:
            at, sign = _slot(name, PATHS)
            self.sums[at] += sign
        self.last = ((*around.last, *names) if around else tuple(names))[-2:]

    def vector(self) -> np.ndarray:
        if self._vector is None:
            self._vector = self.sums.copy()
            for name in self.last:
                at, sign = _slot("." + name, PATHS)
                self._vector[at] += 0.5 * sign
        return self._vector


class Blocks(HTMLParser):
    """blocks: (text, innermost open element or None, characters within links) of each leaf block, in page order.

    A block-level end tag closes all that was opened since its start tag. An inline end tag does so only if no block-level element was opened since; else it closes nothing. End
    tags without a start tag are nothing. Every step costs the same however deep the page is."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[Open] = []
        self.levels: list[int] = []  # places of block-level elements in open
        self.places: dict[str, list[int]] = defaultdict(list)  # places of the elements with a tag in open
        self.blocks: list[tuple[str, Open | None, int]] = []
        self.parts: list[str] = []
        self.linked = 0
        self.silent = 0
        self.inside: Open | None = None

    def flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            self.blocks.append((text, self.inside, self.linked))
        self.parts, self.linked = [], 0

    def _close(self, tag: str) -> None:
        """Closes the last open element with this tag, and those in it."""
        while self.open:
            last = self.open.pop().tag
            if self.levels and self.levels[-1] == len(self.open):
                self.levels.pop()
            self.places[last].pop()
            self.silent -= last in SILENT
            if last == tag:
                break

    def handle_starttag(self, tag, attrs):
        if tag in INLINE:
            if tag == "br":
                self.parts.append(" ")
        else:
            self.flush()
            block = self.open[self.levels[-1]].tag if self.levels else None
            if block in CLOSES and tag in CLOSES[block]:
                self._close(block)
        if tag not in VOID:
            names = [tag]
            for k, v in attrs:
                if v and k in ("class", "id", "role"):
                    names += _NAMES.findall(v.lower())
            if tag not in INLINE:
                self.levels.append(len(self.open))
            self.open.append(Open(tag, names, self.open[-1] if self.open else None))
            self.places[tag].append(len(self.open) - 1)
            self.silent += tag in SILENT

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag not in INLINE:
            self.flush()
        found = self.places[tag][-1:] if tag not in VOID else []
        if not found or tag in INLINE and self.levels and found[0] < self.levels[-1]:
            return
        self._close(tag)

    def handle_data(self, data):
        if self.silent:
            return
        if not self.parts:
            self.inside = self.open[-1] if self.open else None
        self.parts.append(data)
        if self.places["a"]:
            self.linked += len(data.strip())


def blocks(html: str) -> list[tuple[str, Open | None, int]]:
    parser = Blocks()
    parser.feed(html)
    parser.close()
    parser.flush()
    return parser.blocks


def vectors(page: list[tuple[str, Open | None, int]]) -> np.ndarray:
    """One row for each block: hashed tag path, hashed words (whole text), counts."""
    out = np.zeros((len(page), WIDTH), np.float32)
    for k, (text, inside, linked) in enumerate(page):
        if inside is not None:
            out[k, :PATHS] = inside.vector()
        words = np.fromiter(map(zlib.crc32, text.lower().encode().split(b" ")), np.uint32)
        out[k, PATHS : PATHS + WORDS] = np.bincount(words % WORDS, weights=(words >> 16 & 1) * 2.0 - 1, minlength=WORDS) / len(words) ** 0.5
        n = len(text)
        marks = sum(text.count(c) for c in ".!?;:,")
        out[k, PATHS + WORDS :] = (np.log1p(n) / 6, np.log1p(len(words)) / 4, linked / n, marks / len(words), text[-1] in ".!?:;\"'", text[0].isupper(), k / len(page), 1.0)
    return np.clip(out, -4, 4)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """Both directions of the LSTM run as one: their gates stand side by side (input, forget, output, candidate), their recurrent weights in two blocks. Weights of sigmoid
    gates are halved, since sigmoid(x) = (1 + tanh(x / 2)) / 2, so that one tanh serves all gates of a step."""

    def __init__(self, weights: dict[str, np.ndarray]):
        self.weights = w = weights
        half = np.repeat([0.5, 0.5, 0.5, 1.0], HIDDEN).astype(np.float32)
        both = lambda f, b: np.concatenate([x for g in range(4) for x in (f[..., g * HIDDEN : (g + 1) * HIDDEN], b[..., g * HIDDEN : (g + 1) * HIDDEN])], axis=-1)
        none = np.zeros((HIDDEN, 4 * HIDDEN), np.float32)
        self.ahead = [(w["w" + k] * half, w["b" + k] * half) for k in "fb"]
        self.recurrent = np.vstack([both(w["uf"] * half, none), both(none, w["ub"] * half)])
        self._both = both

    @classmethod
    def load(cls) -> Labeller:
        import io
        from importlib.resources import files

        raw = files("granary.llm").joinpath("html_blocks.npz").read_bytes()  # from a folder or a zip
        with np.load(io.BytesIO(raw)) as stored:
            return cls({k: stored[k].astype(np.float32) for k in stored.files})

    def states(self, x: np.ndarray) -> np.ndarray:
        """Hidden states of both directions for each row of x."""
        (wf, bf), (wb, bb) = self.ahead
        z, n = self._both(x @ wf + bf, x[::-1] @ wb + bb), 2 * HIDDEN
        h, c, out = np.zeros(n, np.float32), np.zeros(n, np.float32), np.zeros((len(x), n), np.float32)
        for t in range(len(x)):
            g = np.tanh(z[t] + h @ self.recurrent)
            gates = 0.5 * g[: 3 * n] + 0.5
            c = gates[n : 2 * n] * c + gates[:n] * g[3 * n :]
            h = out[t] = gates[2 * n :] * np.tanh(c)
        return np.hstack([out[:, :HIDDEN], out[::-1, HIDDEN:]])

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Log-odds that each block is main text."""
        return self.states(x) @ self.weights["v"] + self.weights["c"]

    def main_text(self, html: str) -> str:
        page = blocks(html)
        if not page:
            return ""
        return "\n".join(b[0] for b, s in zip(page, self.scores(vectors(page)), strict=True) if s > 0)


@lru_cache(1)
def labeller() -> Labeller:
    return Labeller.load()


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars: one row for each page. Null and empty html, and pages without main text, give an empty text. Rows with null or repeated page_ids each come
    back; other columns are not read."""

    def make():
        model = labeller()

        def one(page_id, url, html):
            text = model.main_text(html)
            return page_id, url, text, len(text)

        return one

    html = F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html")
    return per_row(pages, "page_id long, url string, text string, n_chars long", make, F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html)


def op6_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
