"""Trains the block labeller of html_blocks.py: python -m granary.llm.train_html

The labelled pages are made here, by a seeded generator that knows which blocks it puts into the article. Their words are random syllables, so that the labeller learns page
structure rather than a vocabulary.
"""

from __future__ import annotations

import random
from pathlib import Path

import numpy as np

from granary.llm.html_blocks import HIDDEN, WIDTH, Labeller, blocks, sigmoid, vectors

SYLLABLES = "an ar be ca che da den do el en er es fa gen he in is ka la le li lo ma me mi na ne no on or pa per po qui ra re ri ro sa se si so sta sur ta te the ti to tra un va ve vi wa za ß é ñ ü".split()

#: Private-use characters around main parts of a made page.
BEGIN, END = "\ue000", "\ue001"


class Maker:
    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def word(self) -> str:
        return "".join(self.r.choices(SYLLABLES, k=self.r.randint(1, 4)))

    def sentence(self, low: int = 3, high: int = 18) -> str:
        words = [self.word() for _ in range(self.r.randint(low, high))]
        if self.r.random() < 0.15:
            mark = self.r.choice(["***", "%%%", "###", "&amp;&amp;&amp;", "!!", " |"])
            words = [w + mark for w in words]
        return words[0].capitalize() + " " + " ".join(words[1:]) + self.r.choice(".....?!")

    def text(self, sentences: int) -> str:
        return " ".join(self.sentence() for _ in range(sentences))

    def phrase(self, high: int = 4) -> str:
        return " ".join(self.word() for _ in range(self.r.randint(1, high)))

    def attr(self, *names: str) -> str:
        return f' {self.r.choice(["class", "class", "id"])}="{self.r.choice(names)}"'

    def links(self, n: int) -> str:
        return "".join(f'<li><a href="/{self.word()}">{self.phrase(3)}</a></li>' for _ in range(n))

    def nav(self) -> str:
        items = self.r.randint(2, 12)
        return self.r.choice([
            lambda: f"<nav><ul>{self.links(items)}</ul></nav>",
            lambda: f"<nav{self.attr('main-nav', 'menu', 'navbar', 'topnav')}>" + " ".join(f'<a href="#">{self.phrase(2)}</a>' for _ in range(items)) + "</nav>",
            lambda: f"<div{self.attr('menu', 'nav', 'navigation', 'site-menu', 'breadcrumb', 'breadcrumbs')}><ul>{self.links(items)}</ul></div>",
            lambda: f"<ul{self.attr('menu', 'nav', 'tabs', 'breadcrumb')}>{self.links(items)}</ul>",
        ])()

    def header(self) -> str:
        inside = self.r.choice([f"<h1>{self.phrase()}</h1>", f"<a href='/'>{self.phrase(2)}</a>", f"<p>{self.sentence()}</p>", f"<div>{self.phrase()}</div><p>{self.sentence()}</p>"])
        return self.r.choice([f"<header>{inside}{self.nav() if self.r.random() < 0.4 else ''}</header>", f"<div{self.attr('header', 'site-header', 'masthead', 'top-bar', 'banner')}>{inside}</div>"])

    def advert(self) -> str:
        kind = self.attr("ad", "ads", "advert", "advertisement", "sponsored", "promo", "ad-slot", "banner-ad", "sponsor")
        return f"<{(t := self.r.choice(['div', 'div', 'aside', 'section', 'p']))}{kind}>{self.r.choice([self.text(self.r.randint(1, 4)), self.phrase(), f'<p>{self.text(2)}</p>', f'<a href=x>{self.phrase()}</a>'])}</{t}>"

    def sidebar(self) -> str:
        inside = "".join(self.r.choice([lambda: f"<h3>{self.phrase()}</h3>", lambda: f"<ul>{self.links(self.r.randint(2, 6))}</ul>", lambda: f"<p>{self.text(self.r.randint(1, 3))}</p>", self.advert])() for _ in range(self.r.randint(1, 4)))
        return self.r.choice([f"<aside>{inside}</aside>", f"<aside{self.attr('sidebar', 'related')}>{inside}</aside>", f"<div{self.attr('sidebar', 'side', 'widget', 'related', 'related-posts', 'recommended', 'trending', 'share', 'social', 'newsletter', 'tags', 'author-bio', 'promo-box')}>{inside}</div>"])

    def notice(self) -> str:
        kind = self.attr("cookie", "cookie-notice", "cookie-banner", "consent", "notice", "gdpr", "alert", "popup", "modal", "subscribe", "paywall", "disclaimer", "legal")
        return f"<{(t := self.r.choice(['div', 'div', 'section', 'aside', 'p']))}{kind}>{self.r.choice([f'<p>{self.text(2)}</p>', self.text(self.r.randint(1, 3))])}{self.r.choice(['', '<button>Ok</button>', '<a href=#>Ok</a>'])}</{t}>"

    def form(self) -> str:
        return f"<form{self.r.choice(['', self.attr('search', 'login', 'newsletter', 'signup', 'contact')])}><label>{self.phrase()}</label><input name=q>{self.r.choice(['', f'<p>{self.sentence()}</p>', f'<div>{self.text(2)}</div>'])}<button>{self.phrase(2)}</button></form>"

    def comments(self) -> str:
        def one() -> str:
            t = self.r.choice(["div", "li", "article", "p"])
            inside = self.text(self.r.randint(1, 5))
            return f"<{t}{self.attr('comment', 'reply', 'comment-body', 'response')}>" + (inside if t == "p" else f"<b>{self.phrase(2)}</b><p>{inside}</p>") + f"</{t}>"

        inside = f"<h3>{self.phrase()}</h3>" * self.r.randint(0, 1) + "".join(one() for _ in range(self.r.randint(1, 6)))
        t = self.r.choice(["section", "div", "div", "ol", "ul"])
        return f"<{t}{self.attr('comments', 'comment-list', 'discussion', 'responses', 'disqus_thread', 'reader-comments')}>{inside}</{t}>"

    def footer(self) -> str:
        inside = self.r.choice([f"&copy; {self.phrase()} &middot; {self.sentence()}", f"<p>{self.text(2)}</p>", f"<ul>{self.links(4)}</ul>", f"<p>&copy; 20{self.r.randint(10, 29)} {self.phrase()}</p><nav>{self.phrase()}</nav>"])
        return self.r.choice([f"<footer>{inside}</footer>", f"<footer>{inside}</footer>", f"<div{self.attr('footer', 'site-footer', 'copyright', 'bottom')}>{inside}</div>"])

    def inline(self, text: str) -> str:
        """Some words of the text marked up."""
        words = text.split(" ")
        for _ in range(self.r.randint(0, 2)):
            k = self.r.randrange(len(words))
            t = self.r.choice(["b", "i", "em", "strong", "span", "code", 'a href="/x"'])
            if "&" not in words[k]:
                words[k] = f"<{t}>{words[k]}</{t.split()[0]}>"
        return " ".join(words)

    def paragraph(self) -> str:
        text = self.text(self.r.choice([1, 1, 2, 3, 5, 9]))
        if self.r.random() < 0.15:
            text = self.sentence(1, 3)
        kind = self.r.random()
        if kind < 0.12:
            return f"<p><b>{text}<br>"
        if kind < 0.2:
            return f"<p>{text}"
        if kind < 0.26:
            return f"<div>{self.inline(text)}</div>"
        if kind < 0.31:
            return f"<blockquote><p>{text}</p></blockquote>"
        if kind < 0.36:
            return f"<{(t := self.r.choice(['ul', 'ol']))}>" + "".join(f"<li>{self.sentence()}</li>" for _ in range(self.r.randint(2, 5))) + f"</{t}>"
        if kind < 0.41:
            return f"<h{(n := self.r.randint(2, 4))}>{self.phrase(6).capitalize()}</h{n}>"
        if kind < 0.44:
            return f"<table><tr><td>{self.phrase()}</td><td>{self.sentence()}</td></tr></table>"
        if kind < 0.47:
            return f"<pre>{text}</pre>"
        if kind < 0.49:
            return f"<figure><img src=x><figcaption>{self.sentence()}</figcaption></figure>"
        return f"<p>{self.inline(text)}</p>"

    def article(self) -> list[tuple[str, bool]]:
        """(html, whether it is main text), in order."""
        parts = [(f"<h1>{self.sentence(2, 10)}</h1>", True)] if self.r.random() < 0.85 else []
        for _ in range(self.r.choice([1, 2, 3, 5, 8, 12, 20])):
            parts.append((self.paragraph(), True))
            if self.r.random() < 0.06:
                parts.append((self.r.choice([self.advert, self.sidebar, self.notice, self.form])(), False))
        kind = self.r.random()
        if kind < 0.6:
            begin, end = self.r.choice(["<article>", f"<article{self.attr('post', 'entry', 'story')}>"]), "</article>"
        elif kind < 0.75:
            begin, end = "<main>", "</main>"
        elif kind < 0.95:
            begin, end = f"<div{self.attr('content', 'article', 'post', 'entry-content', 'main', 'story-body', 'article-body', 'post-content', 'main-content')}>", "</div>"
        else:
            begin, end = "<div>", "</div>"
        if self.r.random() < 0.25:
            begin, end = self.r.choice(["<main>", "<div class=container>", "<div id=page><section>", "<div class=wrapper>"]) + begin, end
        return [(begin, False), *parts, (end, False)]

    def page(self) -> str:
        """html in which marks stand around main parts."""
        r = self.r
        before = [f for f in (self.header, self.nav, self.advert, self.notice, self.form, self.sidebar) if r.random() < (0.7 if f == self.nav else 0.35)]
        after = [f for f in (self.sidebar, self.comments, self.advert, self.notice, self.form, self.nav) if r.random() < 0.3]
        r.shuffle(before)
        parts = [(f(), False) for f in before] + self.article() + [(f(), False) for f in after] + ([(self.footer(), False)] if r.random() < 0.8 else [])
        head = f"<!DOCTYPE html><html><head><title>{self.phrase()}</title><style>p{{margin:0}}</style><script>var t='</p>';</script></head><body>"
        return head + "".join(BEGIN + h + END if main else h for h, main in parts) + "</body></html>"


def labelled(html: str) -> tuple[np.ndarray, np.ndarray]:
    """Vectors and labels of a made page. The marks that stand around main parts are read and taken out."""
    page, labels, inside = [], [], False
    for text, path, linked in blocks(html):
        clean = text.replace(BEGIN, "").replace(END, "").strip()
        if clean:
            page.append((clean, path, linked))
            labels.append(inside)
        for mark in text:
            inside = mark == BEGIN or inside and mark != END
    return vectors(page), np.array(labels, np.float32)


def forward(x, w, u, b):
    """x: time, page, width."""
    size, steps, pages = u.shape[0], x.shape[0], x.shape[1]
    h, c, kept = np.zeros((pages, size)), np.zeros((pages, size)), []
    hs = np.zeros((steps, pages, size))
    for t in range(steps):
        z = x[t] @ w + h @ u + b
        i, f, o = sigmoid(z[:, :size]), sigmoid(z[:, size : 2 * size]), sigmoid(z[:, 2 * size : 3 * size])
        g = np.tanh(z[:, 3 * size :])
        new = f * c + i * g
        kept.append((h, c, i, f, o, g, new))
        c = new
        h = o * np.tanh(c)
        hs[t] = h
    return hs, kept


def backward(x, w, u, kept, dhs):
    dw, du, db = np.zeros_like(w), np.zeros_like(u), np.zeros(w.shape[1])
    dh, dc = np.zeros_like(dhs[0]), np.zeros_like(dhs[0])
    for t in range(len(x) - 1, -1, -1):
        h, c, i, f, o, g, new = kept[t]
        dh = dh + dhs[t]
        tc = np.tanh(new)
        dc = dc + dh * o * (1 - tc**2)
        dz = np.hstack([dc * g * i * (1 - i), dc * c * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g**2)])
        dw += x[t].T @ dz
        du += h.T @ dz
        db += dz.sum(axis=0)
        dh, dc = dz @ u.T, dc * f
    return dw, du, db


def train(pages: int = 2400, epochs: int = 6, seed: int = 11) -> dict[str, np.ndarray]:
    maker, rng = Maker(seed), np.random.default_rng(seed)
    data = [labelled(maker.page()) for _ in range(pages)]
    data = sorted((d for d in data if len(d[1])), key=lambda d: len(d[1]))
    p = {}
    for k in "fb":
        p["w" + k], p["u" + k] = rng.normal(0, 0.1, (WIDTH, 4 * HIDDEN)), rng.normal(0, 0.1, (HIDDEN, 4 * HIDDEN))
        p["b" + k] = np.concatenate([np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)])
    p["v"], p["c"] = rng.normal(0, 0.1, 2 * HIDDEN), np.zeros(1)
    m, s, step = {k: np.zeros_like(a) for k, a in p.items()}, {k: np.zeros_like(a) for k, a in p.items()}, 0
    batches = [data[i : i + 24] for i in range(0, len(data), 24)]
    for epoch in range(epochs):
        total = 0.0
        for at in rng.permutation(len(batches)):
            batch = batches[at]
            steps = max(len(y) for _, y in batch)
            x, y, mask = np.zeros((steps, len(batch), WIDTH)), np.zeros((steps, len(batch))), np.zeros((steps, len(batch)))
            back = np.zeros_like(x)
            for j, (v, label) in enumerate(batch):
                x[: len(v), j], y[: len(v), j], mask[: len(v), j], back[: len(v), j] = v, label, 1, v[::-1]
            hf, kf = forward(x, p["wf"], p["uf"], p["bf"])
            hb, kb = forward(back, p["wb"], p["ub"], p["bb"])
            turned = np.zeros_like(hb)
            for j, (v, _) in enumerate(batch):
                turned[: len(v), j] = hb[: len(v), j][::-1]
            both = np.concatenate([hf, turned], axis=2)
            odds = both @ p["v"] + p["c"]
            d = (sigmoid(odds) - y) * mask / mask.sum()
            total += float((np.logaddexp(0, odds) - y * odds)[mask > 0].mean())
            grad = {"v": (both * d[:, :, None]).sum(axis=(0, 1)), "c": np.array([d.sum()])}
            dboth = d[:, :, None] * p["v"]
            dback = np.zeros_like(hb)
            for j, (v, _) in enumerate(batch):
                dback[: len(v), j] = dboth[: len(v), j, HIDDEN:][::-1]
            for k, kept, inputs, dh in (("f", kf, x, dboth[:, :, :HIDDEN]), ("b", kb, back, dback)):
                grad["w" + k], grad["u" + k], grad["b" + k] = backward(inputs, p["w" + k], p["u" + k], kept, dh)
            step += 1
            rate = 0.01 * 0.6**epoch
            for k, g in grad.items():
                m[k], s[k] = 0.9 * m[k] + 0.1 * g, 0.999 * s[k] + 0.001 * g * g
                p[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.999**step)) + 1e-8)
        print(f"epoch {epoch}: loss {total / len(batches):.4f}", flush=True)
    p["c"] = p["c"][0]
    return {k: np.asarray(a, np.float16) for k, a in p.items()}


def accuracy(weights: dict[str, np.ndarray], pages: int = 300, seed: int = 12) -> float:
    model, maker, right, n = Labeller({k: a.astype(np.float32) for k, a in weights.items()}), Maker(seed), 0, 0
    for _ in range(pages):
        x, y = labelled(maker.page())
        right += int(((model.scores(x) > 0) == (y > 0)).sum())
        n += len(y)
    return right / n


if __name__ == "__main__":
    trained = train()
    print("accuracy on other made pages:", round(accuracy(trained), 4))
    np.savez_compressed(Path(__file__).with_name("html_blocks.npz"), **trained)
