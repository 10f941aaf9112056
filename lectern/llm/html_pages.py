"""Labelled pages to train the extractor on, made from a seed.

Every element that starts a region carries ``data-y``: 0 boilerplate, 1 main text, 2 a
container of both; elements without one have their parent's label."""

from __future__ import annotations

import random

MAIN_NAMES = [
    "article", "content", "post", "entry", "main", "story", "article-body", "post-content", "entry-content",
    "main-content", "page-content", "text", "body-text", "blog-post", "single",
]
WRAP_NAMES = ["wrapper", "container", "page", "site", "layout", "row", "inner", "outer", "col", "grid", "root", "app"]
JUNK = {
    "nav": ["nav", "menu", "navbar", "main-nav", "navigation", "breadcrumb", "breadcrumbs", "toc", "pagination", "topbar", "toolbar"],
    "header": ["header", "masthead", "site-header", "top", "branding", "logo", "page-header"],
    "footer": ["footer", "site-footer", "bottom", "copyright", "legal", "disclaimer", "page-footer"],
    "aside": ["sidebar", "aside", "widget", "related", "recommended", "trending", "popular", "tags", "secondary", "rail"],
    "ad": ["ad", "ads", "advert", "advertisement", "banner", "promo", "sponsor", "sponsored", "ad-slot", "adsbygoogle"],
    "notice": ["cookie", "cookie-notice", "consent", "gdpr", "notice", "popup", "modal", "alert", "overlay", "newsletter", "subscribe", "paywall"],
    "comments": ["comments", "comment-list", "comment", "reply", "replies", "discussion", "disqus", "respond", "reader-comments"],
    "share": ["share", "social", "sharing", "share-buttons", "follow"],
    "form": ["form", "search", "login", "signup", "contact-form", "search-form"],
    "label": ["field", "input-group", "form-field", "label"],
}


def labelled_pages(n: int = 600, seed: int = 7) -> list[str]:
    rng = random.Random(seed)
    return [_page(rng) for _ in range(n)]


def _words(r: random.Random, lo: int, hi: int) -> str:
    made = ["".join(r.choice("aeioulnrstmdc") for _ in range(r.randint(2, 9))) for _ in range(r.randint(lo, hi))]
    return " ".join(made).capitalize() + r.choice([".", ".", "!", ""])


def _name(r: random.Random, names: list[str]) -> str:
    return f' {r.choice(["class", "class", "id"])}="{r.choice(names)}"'


def _links(r: random.Random, n: int) -> str:
    items = [f'<a href="/{i}">{_words(r, 1, 3)}</a>' for i in range(n)]
    shape = r.random()
    if shape < 0.6:
        return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>"
    return "<div>" + " | ".join(items) + "</div>" if shape < 0.8 else " ".join(items)


def _junk(r: random.Random, kind: str) -> str:
    tag = {"nav": "nav", "header": "header", "footer": "footer", "aside": "aside", "form": "form", "comments": "section"}.get(kind, "div")
    plain = r.random() < 0.4
    if kind == "label":  # a field without a form around it
        return f'<label{r.choice(["", _name(r, JUNK[kind])])} data-y="0">{_words(r, 1, 4)}</label><input name=q>'
    attr = "" if plain and tag not in ("div", "section") else _name(r, JUNK[kind])
    tag = tag if plain or kind == "form" else r.choice([tag, "div", "div", "section"])
    if tag in ("div", "section") and not attr:
        attr = _name(r, JUNK[kind])
    if kind == "nav":
        inner = _links(r, r.randint(3, 10))
    elif kind == "header":
        inner = f'<a href="/">{_words(r, 1, 3)}</a>' + r.choice(["", _links(r, 4), f"<p>{_words(r, 2, 8)}</p>", f"<h1>{_words(r, 1, 4)}</h1>"])
    elif kind == "footer":
        inner = f"&copy; {_words(r, 2, 14)}" + r.choice(["", _links(r, 4), f"<p>{_words(r, 4, 20)}</p>"])
    elif kind == "aside":
        inner = f"<h3>{_words(r, 1, 3)}</h3>" + r.choice([_links(r, 6), f"<p>{_words(r, 5, 25)}</p>", f"<p>{_words(r, 5, 25)}</p>" + _links(r, 3)])
    elif kind == "form":
        inner = f"<label>{_words(r, 1, 3)}</label><input name=q><p>{_words(r, 3, 15)}</p><button>{_words(r, 1, 2)}</button>"
    elif kind == "comments":
        one = lambda: f'<div{_name(r, ["comment", "reply", "comment-body"])}><p>{_words(r, 5, 60)}</p></div>'
        item = lambda: r.choice([one(), f"<li>{_words(r, 5, 50)}</li>", f"<p>{_words(r, 5, 60)}</p>"])
        inner = f"<h3>{_words(r, 1, 2)}</h3>" + "".join(item() for _ in range(r.randint(1, 8)))
    elif kind == "share":
        inner = _links(r, r.randint(2, 5))
    else:
        inner = r.choice([_words(r, 3, 30), f"<p>{_words(r, 4, 40)}</p>", f"<p>{_words(r, 4, 40)}</p><button>{_words(r, 1, 2)}</button>"])
    return f'<{tag}{attr} data-y="0">{inner}</{tag}>'


def _block(r: random.Random) -> str:
    x = r.random()
    text = _words(r, 4, 90)
    if r.random() < 0.2:
        cut = text.split(" ")
        at = r.randrange(len(cut))
        cut[at] = f'<{(t := r.choice(["a href=/x", "b", "em", "strong", "span", "i", "code"]))}>{cut[at]}</{t.split()[0]}>'
        text = " ".join(cut)
    if x < 0.68:
        return r.choice([f"<p>{text}</p>", f"<p>{text}</p>", f"<p>{text}", f"<p><b>{text}<br>"])
    if x < 0.78:
        return f"<h{(h := r.randint(2, 4))}>{_words(r, 1, 8)}</h{h}>"
    if x < 0.86:
        kind = r.choice(["ul", "ol"])
        return f"<{kind}>" + "".join(f"<li>{_words(r, 2, 25)}</li>" for _ in range(r.randint(2, 6))) + f"</{kind}>"
    if x < 0.9:
        return f"<blockquote><p>{text}</p></blockquote>"
    if x < 0.93:
        rows = "".join(f"<tr><td>{_words(r, 1, 4)}</td><td>{_words(r, 1, 4)}</td></tr>" for _ in range(3))
        return f"<table>{rows}</table>"
    if x < 0.95:
        return f"<pre>{_words(r, 2, 30)}</pre>"
    if x < 0.97:
        return f"<figure><img src=x><figcaption>{_words(r, 2, 12)}</figcaption></figure>"
    return r.choice([f"<div>{text}</div>", f"<section><h2>{_words(r, 1, 6)}</h2><p>{text}</p></section>", text])


def _page(r: random.Random) -> str:
    blocks = [_block(r) for _ in range(r.choice([1, 2, 4, 8, 15, 25]))]
    for kind in ("ad", "share", "comments", "form", "aside", "notice", "label"):
        if r.random() < 0.12:
            blocks.insert(r.randrange(len(blocks) + 1), _junk(r, kind))
    head = f"<h1>{_words(r, 2, 10)}</h1>"
    if r.random() < 0.25:
        head = f'<header data-y="1">{head}<p>{_words(r, 2, 8)}</p></header>'
    inner = (head if r.random() < 0.85 else "") + "".join(blocks)
    style = r.random()
    if style < 0.45:
        main = f'<article{r.choice(["", "", _name(r, MAIN_NAMES)])} data-y="1">{inner}</article>'
    elif style < 0.6:
        main = f'<main{r.choice(["", _name(r, MAIN_NAMES)])} data-y="1">{inner}</main>'
    elif style < 0.72:
        main = f'<main data-y="1"><article data-y="1">{inner}</article></main>'
    elif style < 0.92:
        main = f'<div{_name(r, MAIN_NAMES)} data-y="1">{inner}</div>'
    else:
        main = f'<div data-y="1">{inner}</div>' if style < 0.96 else inner
    before = [_junk(r, k) for k in ("header", "nav", "ad", "notice", "aside", "form") if r.random() < 0.35]
    after = [_junk(r, k) for k in ("comments", "aside", "share", "ad", "notice", "footer", "form") if r.random() < 0.3]
    label = 1 if main is inner and not before and not after else 2
    if main is inner and label == 2:
        main = f'<div data-y="1">{inner}</div>'
    body = "".join([*before, main, *after])
    for _ in range(r.choice([0, 0, 1, 2])):
        body = f'<div{r.choice(["", _name(r, WRAP_NAMES)])} data-y="{label}">{body}</div>'
    return f'<!DOCTYPE html><html data-y="{label}"><head><title>{_words(r, 2, 8)}</title></head><body data-y="{label}">{body}</body></html>'
