"""Operator 6, HTML extraction: a recurrent block labeller.

A page is cut into its leaf blocks, the runs of text between block tags. Each block becomes a vector: learned vectors of
the hashed steps of its tag path, the mean of learned vectors of all its hashed words, and a few shape measures. A
bidirectional LSTM in numpy reads the blocks of the whole page in order, so each is labelled main text or not with the
document on both sides of it in view.

The network is trained here, on at most ``PAGES`` pages chosen by the hash of their id. Teachers are the marks that many
pages carry, elements and class names that say what a block is; pages without any mark are labelled by shape. In half of
the training pages the steps that teach are hidden, so that the network learns to judge by words, shape and
neighbours too. Extraction is a narrow step over all pages.

Defined results: null and empty pages give the empty text, as do pages without main text; broken markup is read much
like browsers do: tags left open end with their parent, and a head without an end tag ends before the first thing that
it can't hold. An element whose text isn't shown hides it up to its end tag; one that has none hides up to the next tag
of a block only, but a script, style or the like hides the rest of the page. Nested elements share their paths, so work
grows with the page however deep it is. Repeated rows repeat, and teach once; an empty table gives no rows; other columns
are not read.
"""

from __future__ import annotations

import html
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .common import distinct_sample

#: Pages that the network may learn from, and characters of each.
PAGES = 600
LESSON = 200_000
BUCKETS = 1_024
INPUTS = 24
STATES = 16
STEPS = 240
PAGES_PER_STEP = 16
#: Blocks of a training page that are read at a time.
STRETCH = 120
#: Pages that are labelled side by side, and places for blocks that they may have together, padding included.
SIDE_BY_SIDE = 128
PLACES = 1 << 16
RATE = 0.01
MEASURES = 6

#: Tokens of markup: comments, declarations, tags, and text.
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/>]*)(?P<rest2>[^>]*)(?:>|\Z)|(?P<text>[^<]+|<)",
    re.S,
)
NAMES = re.compile(r"""\b(class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
SPACE = re.compile(r"\s+")
RAW = ("script", "style", "textarea", "iframe", "noembed", "noframes", "xmp")
HIDDEN = frozenset(("head", "title", "noscript", "template", "svg", "math", "object", "select", "button", *RAW))
#: What a head can hold, hidden elements with end tags, and the tags that end a hidden element without one.
HEAD_HOLDS = frozenset(("base", "basefont", "bgsound", "link", "meta", "title", "noscript", "template", "html", *RAW))
PAIRED = re.compile(r"<(/?)(title|noscript|template|svg|math|object|select|button)(?=[\s/>])", re.I)
BREAKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section summary table ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img input ins kbd label mark q rp rt ruby s samp "
    "small span strike strong sub sup time tt u var wbr".split()
)
#: Tags that a new tag of the same row ends, up to the nearest element that can hold them.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
HOLDS = frozenset(("ul", "ol", "dl", "table", "menu", "body", "html", "article", "section", "div", "main"))
#: Marks of main text and of what surrounds it.
MAIN = frozenset(("article", "main", "=main", "=article", "=articlebody", "=article-body", "=post-content", "=entry-content"))
ASIDE_TAGS = frozenset(("nav", "header", "footer", "aside", "form", "menu", "dialog", "address", "figcaption"))
ASIDE_NAMES = re.compile(
    r"(^|[-_])(ads?|adverts?|advertisement|sponsor(ed)?|promo\w*|banner|cookies?|consent|notice|alert|popup|modal|nav\w*|"
    r"menu|breadcrumbs?|sidebar|side|footer|header|masthead|toolbar|share|social|subscribe|newsletter|signup|login|search|"
    r"related|recommend\w*|comments?|replies|disqus|widget|legal|copyright|tags?|pagination|pager|form)($|[-_])"
)


@lru_cache(1 << 14)
def aside(step: str) -> bool:
    """Whether a step of a path says that what lies below is not main text."""
    return step in ASIDE_TAGS or step[:1] == "=" and bool(ASIDE_NAMES.search(step[1:]))


class Path:
    """An element: its own steps, those of its parents by reference, and whether any step is a mark."""

    __slots__ = ("parent", "steps", "main", "aside")

    def __init__(self, parent: Path | None = None, steps: tuple[str, ...] = ()):
        self.parent, self.steps = parent, steps
        self.main = any(s in MAIN for s in steps) or parent is not None and parent.main
        self.aside = any(map(aside, steps)) or parent is not None and parent.aside


@dataclass
class Block:
    """A run of text with the path of its element, and the share of it in links."""

    text: str
    path: Path
    linked: float


def unclosed(page: str) -> set[int]:
    """Where hidden elements start that have no end tag."""
    waiting: dict[str, list[int]] = {}
    for match in PAIRED.finditer(page):
        of = waiting.setdefault(match[2].lower(), [])
        if not match[1]:
            of.append(match.start())
        elif of:
            of.pop()
    return {at for of in waiting.values() for at in of}


def blocks(page: str) -> list[Block]:
    """The leaf blocks of a page in order, character references decoded, white space collapsed."""
    out: list[Block] = []
    root = Path()
    stack: list[tuple[str, Path, bool]] = []
    opened: Counter[str] = Counter()
    pieces: list[str] = []
    loose = unclosed(page)
    links = hidden = ending = at = 0

    def flush() -> None:
        nonlocal links
        text = SPACE.sub(" ", html.unescape("".join(pieces))).strip()
        if text:
            out.append(Block(text, stack[-1][1] if stack else root, min(1.0, links / len(text))))
        pieces.clear()
        links = 0

    def drop(place: int) -> None:
        """End the elements from this place of the stack on."""
        nonlocal hidden, ending
        for name, _, ends in stack[place:]:
            opened[name] -= 1
            hidden -= name in HIDDEN
            ending -= ends
        del stack[place:]

    def first(matches) -> int:
        return next(i for i, element in enumerate(stack) if matches(element))

    while at < len(page):
        match = TOKEN.match(page, at)
        start, at = at, match.end()
        text = match["text"]
        if text is not None:
            if hidden and stack[-1][0] == "head" and not text.isspace():
                drop(len(stack) - 1)
            if not hidden:
                pieces.append(text)
                links += len(text) if opened["a"] else 0
            continue
        tag = (match["tag"] or match["tag2"] or "").lower()
        if not tag:
            continue
        if match["end"] or match["end2"]:
            if opened[tag]:
                if tag not in INLINE:
                    flush()
                place = len(stack) - 1
                while stack[place][0] != tag:
                    place -= 1
                drop(place)
            elif tag == "p":
                flush()
            continue
        if opened["head"] and tag not in HEAD_HOLDS and not opened["noscript"] and not opened["template"]:
            drop(first(lambda element: element[0] == "head"))
        if tag == "head" and any(name != "html" for name in opened if opened[name]):
            continue
        if tag == "br":
            pieces.append(" ")
            continue
        if tag not in INLINE:
            flush()
            if ending and tag in BREAKS:
                drop(first(lambda element: element[2]))
            ends = ENDS.get(tag)
            if ends:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] in ends:
                        drop(i)
                        break
                    if stack[i][0] in HOLDS:
                        break
            while stack and (stack[-1][0] == "p" or stack[-1][0] in INLINE and opened["p"]):
                drop(len(stack) - 1)
            if tag == "body":
                drop(0)
        if tag in VOID:
            continue
        rest = match["rest"] if match["rest"] is not None else match["rest2"] or ""
        names = [] if tag in INLINE or "=" not in rest else [
            n for m in NAMES.finditer(rest) for n in (m[2] or m[3] or m[4] or "").lower().split()
        ]
        if tag in RAW:
            end = re.compile(rf"</{tag}\b[^>]*>?", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if rest.rstrip().endswith("/") and tag not in INLINE and tag in ("path", "use", "circle", "rect"):
            continue
        above = stack[-1][1] if stack else root
        stack.append((tag, above if tag in INLINE else Path(above, (tag, *(f"={n}" for n in names))), start in loose))
        opened[tag] += 1
        hidden += tag in HIDDEN
        ending += start in loose
    flush()
    return out


def taught(page: list[Block]) -> list[int]:
    """Labels by marks; by shape where a page marks no main text."""
    marked = any(block.path.main for block in page)
    out = []
    for block in page:
        if marked:
            out.append(int(block.path.main and not block.path.aside))
        else:
            long = len(block.text) >= 80 or block.path.steps[-1:] and block.path.steps[-1] in ("h1", "p", "blockquote", "pre")
            out.append(int(bool(long) and block.linked < 0.5 and not block.path.aside))
    return out


@lru_cache(1 << 14)
def hashed(text: str) -> int:
    return zlib.crc32(text.encode("utf-8", "replace")) % BUCKETS


@dataclass
class Steps:
    """The hashed steps of a page's elements: each one's own, the number of its parent or -1, and for each block the
    number of its element and its last step."""

    own: list[list[int]]
    parents: list[int]
    element: list[int]
    last: list[list[int]]

    def rows(self, part: slice) -> list[list[int]]:
        """All steps of some blocks, written out."""
        out = []
        for at, last in zip(self.element[part], self.last[part]):
            row = list(last)
            while at >= 0:
                row += self.own[at]
                at = self.parents[at]
            out.append(row or [0])
        return out

    def pooled(self, table: np.ndarray) -> np.ndarray:
        """The mean vector of each block's steps; sums go from parents to children."""
        sums = np.zeros((len(self.own) + 1, table.shape[1]), np.float32)
        sizes = np.zeros(len(self.own) + 1, np.float32)
        for i, (own, parent) in enumerate(zip(self.own, self.parents)):
            sums[i] = sums[parent] + table[own].sum(0) if own else sums[parent]
            sizes[i] = sizes[parent] + len(own)
        out, size = sums[self.element], sizes[self.element]
        for i, last in enumerate(self.last):
            out[i] += table[last or [0]].sum(0) if last or not size[i] else 0
            size[i] += len(last)
        return out / np.maximum(size, 1)[:, None]


def steps_of(page: list[Block], hide: bool) -> Steps:
    """The steps of a page's blocks; ``hide`` leaves out marks."""
    out = Steps([], [], [], [])
    number: dict[int, int] = {}
    tail: list[str | None] = [None]

    def shown(path: Path) -> list[str]:
        return [s for s in path.steps if not (hide and (s in MAIN or aside(s)))]

    for block in page:
        new, path = [], block.path
        while path.parent is not None and id(path) not in number:
            new.append(path)
            path = path.parent
        for path in reversed(new):
            parent = number.get(id(path.parent), -1)
            before, steps = tail[parent + 1], shown(path)
            chain = [before, *steps] if before is not None else steps
            out.own.append([hashed(s) for s in steps] + [hashed(f"{a}>{b}") for a, b in zip(chain, chain[1:])])
            out.parents.append(parent)
            number[id(path)] = len(out.own) - 1
            tail.append(steps[-1] if steps else before)
        at = number.get(id(block.path), -1)
        out.element.append(at)
        out.last.append([hashed(f"last {tail[at + 1]}")] if tail[at + 1] is not None else [])
    return out


def features(page: list[Block], hide: bool = False) -> tuple[Steps, list[list[int]], np.ndarray]:
    """The hashed path steps of the blocks, each one's hashed words, and its measures; ``hide`` leaves out marks."""
    words = []
    measures = np.zeros((len(page), MEASURES), np.float32)
    known: dict[str, int] = {}
    for i, block in enumerate(page):
        own = []
        for word in block.text.split():
            number = known.get(word)
            if number is None:
                number = known[word] = zlib.crc32(f"word {word.lower()}".encode("utf-8", "replace")) % BUCKETS
            own.append(number)
        words.append(own or [0])
        size = len(block.text)
        measures[i] = (
            np.log1p(size) / 5, np.log1p(len(own)) / 4, block.linked, block.text[-1:] in ".!?:;\"",
            i / len(page), (len(page) - 1 - i) / len(page),
        )
    return steps_of(page, hide), words, measures


@dataclass
class Labeller:
    """Vectors of steps and words, the input layer of the measures, both directions' weights, and the output layer."""

    steps: np.ndarray
    words: np.ndarray
    measures: np.ndarray
    forward: tuple[np.ndarray, np.ndarray, np.ndarray]
    backward: tuple[np.ndarray, np.ndarray, np.ndarray]
    out: np.ndarray
    bias: np.ndarray

    def parameters(self) -> list[np.ndarray]:
        return [self.steps, self.words, self.measures, *self.forward, *self.backward, self.out, self.bias]


def new_labeller(seed: int) -> Labeller:
    rng = np.random.default_rng(seed)

    def table(*shape: int, scale: float) -> np.ndarray:
        return rng.normal(0, scale, shape).astype(np.float32)

    def layer():
        bias = np.zeros(4 * STATES, np.float32)
        bias[STATES:2 * STATES] = 1
        return table(INPUTS, 4 * STATES, scale=INPUTS**-0.5), table(STATES, 4 * STATES, scale=STATES**-0.5), bias

    return Labeller(
        table(BUCKETS, INPUTS, scale=0.1), table(BUCKETS, INPUTS, scale=0.1), table(MEASURES, INPUTS, scale=0.3),
        layer(), layer(), table(2 * STATES, scale=0.1), np.zeros(1, np.float32),
    )


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def pooled(table: np.ndarray, rows: list[list[int]], chunk: int = 100_000) -> np.ndarray:
    """The mean vector of each row's numbers."""
    out = np.empty((len(rows), table.shape[1]), np.float32)
    lengths = np.array([len(r) for r in rows])
    ends = np.cumsum(lengths)
    i = 0
    while i < len(rows):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + chunk, "right")))
        flat = np.fromiter((n for r in rows[i:j] for n in r), np.int64)
        first = np.r_[0, np.cumsum(lengths[i:j])[:-1]]
        out[i:j] = np.add.reduceat(table[flat], first, axis=0)
        i = j
    return out / lengths[:, None]


def vectors(net: Labeller, paths: np.ndarray, words, measures: np.ndarray) -> np.ndarray:
    """The network's inputs from the mean vectors of the paths."""
    return paths * 4 + pooled(net.words, words) + measures @ net.measures


def page_vectors(net: Labeller, page: list[Block]) -> np.ndarray:
    steps, words, measures = features(page)
    return vectors(net, steps.pooled(net.steps), words, measures)


def run(layer, inputs: np.ndarray, there: np.ndarray, keep: list | None = None) -> np.ndarray:
    """States after each block, shape (blocks, pages, states). Past a page's end the state stays."""
    weight, recur, bias = layer
    n = recur.shape[0]
    state = np.zeros((inputs.shape[1], n), np.float32)
    cell = np.zeros_like(state)
    states = np.empty((*inputs.shape[:2], n), np.float32)
    for t in range(len(inputs)):
        line = inputs[t] @ weight + state @ recur + bias
        gate = sigmoid(line[:, :3 * n])
        new = np.tanh(line[:, 3 * n:])
        let_in, forget, let_out = gate[:, :n], gate[:, n:2 * n], gate[:, 2 * n:]
        on = there[t][:, None]
        next_cell = np.where(on, forget * cell + let_in * new, cell)
        shown = np.tanh(next_cell)
        next_state = np.where(on, let_out * shown, state)
        if keep is not None:
            keep.append((state, cell, let_in, forget, let_out, new, shown, on))
        state, cell = next_state, next_cell
        states[t] = state
    return states


def run_back(layer, inputs: np.ndarray, keep: list, grad: np.ndarray):
    """Gradients of a layer's weights and of its inputs, by backpropagation through time."""
    weight, recur, bias = layer
    g_weight, g_recur, g_bias = (np.zeros_like(w) for w in layer)
    g_inputs = np.empty_like(inputs)
    g_state = np.zeros_like(grad[0])
    g_cell = np.zeros_like(g_state)
    for t in range(len(inputs) - 1, -1, -1):
        state, cell, let_in, forget, let_out, new, shown, on = keep[t]
        g = grad[t] + g_state
        g_on = g * on
        c = (g_cell + g_on * let_out * (1 - shown * shown)) * on
        line = np.concatenate([
            c * new * let_in * (1 - let_in), c * cell * forget * (1 - forget),
            g_on * shown * let_out * (1 - let_out), c * let_in * (1 - new * new),
        ], axis=1)
        g_weight += inputs[t].T @ line
        g_recur += state.T @ line
        g_bias += line.sum(0)
        g_inputs[t] = line @ weight.T
        g_state = line @ recur.T + g * ~on
        g_cell = c * forget + g_cell * ~on
    return [g_weight, g_recur, g_bias], g_inputs


def stacked(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pages side by side: (blocks, pages, inputs), which places hold a block, and the places read backwards."""
    lengths = np.array([len(r) for r in rows])
    x = np.zeros((int(lengths.max()), len(rows), rows[0].shape[1]), np.float32)
    for i, row in enumerate(rows):
        x[:len(row), i] = row
    t = np.arange(len(x))[:, None]
    return x, t < lengths[None, :], np.where(t < lengths[None, :], lengths[None, :] - 1 - t, t)


def train(pages: list[list[Block]], steps: int = STEPS, seed: int = 7) -> Labeller:
    """Minimise the cross entropy of the taught labels with Adam steps over random pages."""
    net = new_labeller(seed)
    rng = np.random.default_rng(seed)
    weights = net.parameters()
    mean, square = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    labels = [np.array(taught(p), np.float32) for p in pages]
    inputs = [[features(p, hide) for hide in (False, True)] for p in pages]
    for step in range(steps):
        part = [(int(i), int(h)) for i, h in zip(rng.integers(0, len(pages), PAGES_PER_STEP), rng.integers(0, 2, PAGES_PER_STEP))]
        cut = [slice(s, s + STRETCH) for s in (int(rng.integers(0, max(1, len(pages[i]) - STRETCH + 1))) for i, _ in part)]
        paths = [r for (i, h), c in zip(part, cut) for r in inputs[i][h][0].rows(c)]
        words = [r for (i, h), c in zip(part, cut) for r in inputs[i][h][1][c]]
        measures = [inputs[i][h][2][c] for (i, h), c in zip(part, cut)]
        lengths = [len(m) for m in measures]
        flat = vectors(net, pooled(net.steps, paths), words, np.concatenate(measures))
        x, there, back = stacked(np.split(flat, np.cumsum(lengths)[:-1]))
        columns = np.arange(x.shape[1])[None, :]
        keep_a: list = []
        keep_b: list = []
        ahead, behind = run(net.forward, x, there, keep_a), run(net.backward, x[back, columns], there, keep_b)
        states = np.concatenate([ahead, behind[back, columns]], -1)
        y = stacked([labels[i][c][:, None] for (i, _), c in zip(part, cut)])[0][:, :, 0]
        g = (sigmoid(states @ net.out + net.bias) - y) * there / sum(lengths)
        g_states = g[:, :, None] * net.out
        g_forward, g_x = run_back(net.forward, x, keep_a, g_states[:, :, :STATES])
        g_backward, g_y = run_back(net.backward, x[back, columns], keep_b, g_states[:, :, STATES:][back, columns])
        g_x = g_x + g_y[back, columns]
        g_flat = np.concatenate([g_x[:n, i] for i, n in enumerate(lengths)])
        g_steps, g_words = np.zeros_like(net.steps), np.zeros_like(net.words)
        for table, rows, scale in ((g_steps, paths, 4), (g_words, words, 1)):
            sizes = np.array([len(r) for r in rows])
            np.add.at(table, np.fromiter((n for r in rows for n in r), np.int64), np.repeat(g_flat * scale / sizes[:, None], sizes, axis=0))
        grads = [g_steps, g_words, np.concatenate(measures).T @ g_flat, *g_forward, *g_backward, np.einsum("tps,tp->s", states, g), np.array([g.sum()])]
        rate = RATE * min(1.0, (step + 1) / 10) * (1 - step / steps)
        for w, g_, m, s in zip(weights, grads, mean, square):
            m += 0.1 * (g_ - m)
            s += 0.01 * (g_ * g_ - s)
            w -= rate * (m / (1 - 0.9 ** (step + 1))) / (np.sqrt(s / (1 - 0.99 ** (step + 1))) + 1e-8)
    return net


def chunks(lengths: list[int], size: int, places: int) -> Iterator[list[int]]:
    """The numbers of the pages with blocks, by length; a page of more than ``places`` blocks is alone."""
    part: list[int] = []
    for i in sorted(range(len(lengths)), key=lambda i: lengths[i]):
        if part and (len(part) == size or (len(part) + 1) * lengths[i] > places):
            yield part
            part = []
        if lengths[i]:
            part.append(i)
    if part:
        yield part


def label(net: Labeller, pages: list[list[Block]], size: int = SIDE_BY_SIDE, places: int = PLACES) -> list[np.ndarray]:
    """For each page the chance of each block to be main text."""
    out = [np.zeros(0, np.float32)] * len(pages)
    for part in chunks([len(p) for p in pages], size, places):
        x, there, back = stacked([page_vectors(net, pages[i]) for i in part])
        columns = np.arange(len(part))[None, :]
        ahead, behind = run(net.forward, x, there), run(net.backward, x[back, columns], there)
        p = sigmoid(np.concatenate([ahead, behind[back, columns]], -1) @ net.out + net.bias)
        for j, i in enumerate(part):
            out[i] = p[:len(pages[i]), j]
    return out


def fit(pages: DataFrame, most: int = PAGES) -> Labeller | None:
    """Train on a bounded sample of pages."""
    there = pages.where(F.col("html").isNotNull()).select("page_id", F.col("html").cast("string").alias("html"))
    chosen = distinct_sample(there, "html", most, seed=31).select("page_id", F.left("html", F.lit(LESSON)).alias("html")).toPandas()
    chosen = chosen.sort_values(["page_id", "html"])
    lessons = [page for page in map(blocks, chosen["html"]) if page]
    return train(lessons) if lessons else None


def extract(pages: DataFrame, net: Labeller | None = None) -> DataFrame:
    """The main text of every page and its number of characters."""
    net = net or fit(pages)

    @F.pandas_udf("text string, n_chars long")
    def main_text(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for sources in parts:
            read = [blocks(s or "") for s in sources]
            chances = label(net, read) if net else [np.zeros(len(p)) for p in read]
            texts = ["\n".join(b.text for b, c in zip(page, chance) if c >= 0.5) for page, chance in zip(read, chances)]
            yield pd.DataFrame({"text": texts, "n_chars": [len(t) for t in texts]})

    found = pages.select("page_id", "url", main_text(F.col("html").cast("string")).alias("_found"))
    return found.select("page_id", "url", "_found.text", "_found.n_chars")
