"""HTML extraction: a tree-structured graphical model over the DOM.

Every element is a variable with three labels: boilerplate, main text, and container of
both. Its potential comes from what is seen of it (tag, words in class, id and role, share of
linked text, amount of text), the potential between parent and child from how labels follow
each other by the kind of the child. Both are counted from labelled pages. Sum-product
message passing, once upward and once downward, gives the exact marginals; text whose element
is boilerplate with a probability of one half or more is left out.

Messages of all pages of a slice are passed together, one level of the trees at a time, so
deep pages need no recursion. Pages are parsed whole, in linear time, by a tolerant tokenizer:
end tags may be missing, crossed or superfluous. A narrow map without a shuffle; a page costs
memory in proportion to its own length.
"""

from __future__ import annotations

import html as _html
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from .common import table
from .html_pages import labelled_pages

#: A quote opens a string only after an equals sign; a string without an end is none. A comment without an end is the rest of the page.
TAG = re.compile(
    r"<(?:!--(?:-?>|.*?(?:--!?>|\Z))|(/?)([a-zA-Z][^\s/>]*)((?:=\s*+(?:\"[^\"]*\"|'[^']*')|[^>])*+)>|[!?/][^>]*>)", re.S
)
ATTR = re.compile(r"""\b(class|id|role|data-y)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
WORD = re.compile(r"[a-z]+|\d+")
#: Elements whose content is no text of the page, up to their end tag; the first ones reach to the end of the page without it.
RAW_TO_END = frozenset("script style title textarea".split())
RAW = RAW_TO_END | frozenset("template noscript iframe xmp svg select head".split())
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>", re.I) for t in RAW}
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body button center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "frame h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table "
    "caption tbody td tfoot th thead tr ul br".split()
)
#: A start tag ends these open elements, unless one of the second set is in between.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"thead", "tbody", "tfoot"}, {"table"}), "option": ({"option"}, {"select"}),
}
_P_STOP = {"button", "table", "td", "th", "caption", "html", "body"}
JUNK, MAIN, MIXED = 0, 1, 2
LEVELS = (0, 1, 20, 80, 300)
SHARES = (0.0, 0.2, 0.6)


@dataclass
class Page:
    """Elements in document order, and the texts with the element each belongs to (-1: a block's edge)."""

    tags: list[str] = field(default_factory=list)
    words: list[tuple[str, ...]] = field(default_factory=list)
    parent: list[int] = field(default_factory=list)
    depth: list[int] = field(default_factory=list)
    label: list[int] = field(default_factory=list)
    chars: list[int] = field(default_factory=list)
    linked: list[int] = field(default_factory=list)
    texts: list[tuple[int, str]] = field(default_factory=list)


def parse(source: str, labelled: bool = False) -> Page:
    """The tree of a page; markup that cannot be read as a tag is text. Labels (``data-y``) are read only if asked for.

    One pass: for every tag the places where it is open are kept, so closing an element, or finding what a start tag
    ends, never searches the stack."""
    p = Page()
    open_: list[int] = []
    places: dict[str, list[int]] = {}  # tag -> where in ``open_`` it stands
    endless: set[str] = set()  # raw elements without a further end tag

    def push(tag: str, words: tuple[str, ...], label: int) -> None:
        up = open_[-1] if open_ else -1
        p.tags.append(tag)
        p.words.append(words)
        p.parent.append(up)
        p.depth.append(p.depth[up] + 1 if open_ else 0)
        p.label.append(label if label >= 0 else p.label[up] if open_ else MAIN)
        p.chars.append(0)
        p.linked.append(0)

    def enter(tag: str) -> None:
        places.setdefault(tag, []).append(len(open_))
        open_.append(len(p.tags) - 1)

    def pop_to(k: int) -> None:
        for i in reversed(open_[k:]):
            places[p.tags[i]].pop()
            if p.tags[i] in BLOCK:
                p.texts.append((-1, ""))
        del open_[k:]

    def end(what: set[str], stop: set[str]) -> None:
        """Close the innermost of ``what`` that no ``stop`` is inside of."""
        last = lambda tags: max((places[t][-1] for t in tags if places.get(t)), default=-1)
        if (k := last(what)) > last(stop - what):
            pop_to(k)

    def text(x: str) -> None:
        if x:
            if "&" in x:
                x = _html.unescape(x)
            p.texts.append((open_[-1], x))
            n = len(x) - x.count(" ")
            p.chars[open_[-1]] += n
            if places.get("a"):
                p.linked[open_[-1]] += n

    push("#root", (), -1)
    enter("#root")
    last, at = source.rfind(">") + 1, 0
    while at < last:
        m = TAG.search(source, at, last)
        if not m:
            break
        text(source[at : m.start()])
        at = m.end()
        if at == last and source.startswith("<!--", m.start()) and not source.endswith(("-->", "--!>"), m.start(), at):
            return p
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            if places.get(tag):
                pop_to(places[tag][-1])
            elif tag in ("p", "br"):
                p.texts.append((-1, ""))
            continue
        attrs = m[3]
        if tag in RAW and not (tag == "svg" and attrs.endswith("/")):
            stop = _RAW_END[tag].search(source, at) if tag not in endless else None
            if stop:
                at = stop.end()
                continue
            endless.add(tag)
            if tag in RAW_TO_END:
                return p
            continue  # without an end its content is that of the page
        if tag in BLOCK:
            p.texts.append((-1, ""))
            if places.get("p") and tag not in ("br", "button"):
                end({"p"}, _P_STOP)
        if tag in ENDS:
            end(*ENDS[tag])
        if tag in VOID:
            continue
        words, label = [], -1
        if attrs and "=" in attrs:
            for a in ATTR.finditer(attrs):
                value = (a[2] or a[3] or a[4] or "").lower()
                if a[1].lower() != "data-y":
                    words += WORD.findall(value)
                elif labelled:
                    label = int(value)
        push(tag, tuple(dict.fromkeys(words)), label)
        if not attrs.endswith("/") or tag in BLOCK:
            enter(tag)
    text(source[at:].partition("<!--")[0])
    return p


@dataclass
class Forest:
    """The elements of many pages, one after the other."""

    tag: list[str]
    words: list[tuple[str, ...]]
    parent: np.ndarray
    levels: list[np.ndarray]
    kind: np.ndarray  # 0 inline, 1 block
    share: np.ndarray
    amount: np.ndarray


def forest(pages: list[Page]) -> Forest:
    sizes = np.array([len(p.tags) for p in pages])
    first = np.repeat(np.cumsum(sizes) - sizes, sizes)
    parent = np.concatenate([np.array(p.parent) for p in pages])
    parent = np.where(parent < 0, -1, parent + first)
    depth = np.concatenate([np.array(p.depth) for p in pages])
    order = np.argsort(depth, kind="stable")
    levels = np.split(order, np.flatnonzero(np.diff(depth[order])) + 1)
    chars = np.concatenate([np.array(p.chars, np.int64) for p in pages])
    linked = np.concatenate([np.array(p.linked, np.int64) for p in pages])
    for level in levels[:0:-1]:
        np.add.at(chars, parent[level], chars[level])
        np.add.at(linked, parent[level], linked[level])
    tags = [t for p in pages for t in p.tags]
    block = np.array([t in BLOCK for t in tags])
    share = np.where(block, np.searchsorted(SHARES, linked / np.maximum(chars, 1), side="left"), len(SHARES) + 1)
    amount = np.where(block, np.searchsorted(LEVELS, chars, side="left"), len(LEVELS) + 1)
    return Forest(tags, [w for p in pages for w in p.words], parent, levels, block.astype(int), share, amount)


@dataclass
class TreeModel:
    """Log potentials counted from labelled pages."""

    root: np.ndarray  # label
    edge: np.ndarray  # kind of child, parent's label, child's label
    tags: dict[str, np.ndarray]
    other_tag: np.ndarray
    words: dict[str, np.ndarray]
    share: np.ndarray  # bin, label
    amount: np.ndarray


def train(pages: list[str], smooth: float = 0.3) -> TreeModel:
    """Count the potentials over labelled pages (``data-y`` marks, see ``html_pages``)."""
    parsed = [parse(x, labelled=True) for x in pages]
    f = forest(parsed)
    y = np.concatenate([np.array(p.label) for p in parsed])
    root = f.parent < 0
    total = np.bincount(y, minlength=3) + smooth

    def table_(keys, size: int) -> np.ndarray:
        out = np.full((size, 3), smooth)
        np.add.at(out, (keys, y), 1)
        return np.log(out / out.sum(0))

    edge = np.full((2, 3, 3), smooth)
    np.add.at(edge, (f.kind[~root], y[f.parent[~root]], y[~root]), 1)
    names = {t: i for i, t in enumerate(sorted(set(f.tag)))}
    by_tag = table_(np.array([names[t] for t in f.tag]), len(names) + 1)
    seen: dict[str, np.ndarray] = {}
    for words, label in zip(f.words, y):
        for w in words:
            seen.setdefault(w, np.zeros(3))[label] += 1
    words = {w: np.log((n + smooth * 0.1) / total) for w, n in seen.items() if n.sum() >= 2}
    words = {w: v - v.max() for w, v in words.items()}
    prior = np.bincount(y[root], minlength=3) + smooth
    return TreeModel(
        np.log(prior / prior.sum()), np.log(edge / edge.sum(2, keepdims=True)),
        {t: by_tag[i] for t, i in names.items()}, by_tag[-1].mean() + np.zeros(3), words,
        table_(f.share, len(SHARES) + 2), table_(f.amount, len(LEVELS) + 2),
    )


def _normal(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis, keepdims=True)) + top


def marginals(m: TreeModel, f: Forest) -> np.ndarray:
    """P(label) of every element by one upward and one downward pass."""
    own = np.stack([m.tags.get(t, m.other_tag) for t in f.tag]) + m.share[f.share] + m.amount[f.amount]
    for i, words in enumerate(f.words):
        for w in words:
            if w in m.words:
                own[i] += m.words[w]
    below = own  # potential times the messages of the children
    up = np.zeros_like(own)  # message to the parent, by the parent's label
    for level in f.levels[:0:-1]:
        joint = m.edge[f.kind[level]] + below[level][:, None, :]
        up[level] = _normal(joint, 2)[:, :, 0]
        np.add.at(below, f.parent[level], up[level])
    belief = below.copy()
    belief[f.levels[0]] += m.root
    for level in f.levels[1:]:
        rest = belief[f.parent[level]] - up[level]  # the parent without this child
        joint = m.edge[f.kind[level]] + rest[:, :, None]
        belief[level] += _normal(joint, 1)[:, 0, :]
        belief[level] -= belief[level].max(1, keepdims=True)
    return np.exp(belief - _normal(belief, 1))


def extract(m: TreeModel, sources: list[str]) -> list[str]:
    """The main text of each page."""
    pages = [parse(x) for x in sources]
    if not pages:
        return []
    keep = (marginals(m, f := forest(pages))[:, JUNK] < 0.5).tolist()
    out, first = [], 0
    for p in pages:
        kept = [" " if i < 0 else x if keep[first + i] else "" for i, x in p.texts]
        out.append(" ".join("".join(kept).split()))
        first += len(p.tags)
    del f
    return out


def extract_pages(pages: DataFrame, model: TreeModel, html_col: str = "html", text: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """``pages`` without the html, with the main text and its number of code points.

    Null and empty html give an empty text; repeated rows stay; pages of any length and depth are read whole; an empty
    table gives an empty result. Columns that already have the result's names are replaced."""
    rest = pages.drop(*{text, n_chars} - {html_col})
    kept = [f for f in rest.schema.fields if f.name != html_col]
    schema = StructType([*kept]).add(text, "string").add(n_chars, "long")
    shared = pages.sparkSession.sparkContext.broadcast(vars(model))

    def run(batches):
        m = TreeModel(**shared.value)
        for whole in batches:
            for a in range(0, whole.num_rows, 128):
                batch = whole.slice(a, 128)
                texts = extract(m, [x or "" for x in batch.column(html_col).to_pylist()])
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(f.name) for f in kept), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                    [*(f.name for f in kept), text, n_chars],
                )

    return rest.mapInArrow(run, schema)


def op1_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, text, n_chars for every page (see ``extract_pages``)."""
    return extract_pages(table(spark, sf_dir, "pages").select("page_id", "url", "html"), train(labelled_pages()))
