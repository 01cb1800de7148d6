"""Main text of web pages: the maximum-scoring contiguous run of words and tags."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from html import unescape
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import share_of_hash

#: What may stand in a tag after its name: a value in quotes, with any sign, or anything but the tag's end.
INSIDE = r"""(?:[^>"'=]|=\s*"[^"]*"|=\s*'[^']*'|["'=])*"""
#: Comments, elements whose content is no text, tags, text, and a stray sign.
TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|svg|iframe|textarea|select|title)\b{INSIDE}>.*?(?:</\1\s*>|\Z)|<[!/?]?[a-z]{INSIDE}(?:>|\Z)|[^<]+|<", re.S | re.I)
TAG = re.compile(r"<(/?)([a-z][a-z0-9-]*)(.*)", re.S | re.I)
MARK = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
#: Elements that begin a block of their own (a fixed value of HTML).
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: Elements without an end tag (a fixed value of HTML).
EMPTY = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that hold no main text, by their names in HTML.
ASIDE = frozenset("nav footer aside form button dialog menu head".split())
#: Words in class, id or role that speak of no main text where the labelled pages do not tell (a prior, fixed values).
PRIOR = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments complementary consent contentinfo cookie cookies footer masthead menu nav navbar "
    "navigation newsletter notice popup promo promoted promotion related respond share sharing sidebar social sponsor sponsored sponsors subscribe toolbar widget".split()
)
#: Pages that must agree before a mark counts as learnt.
AGREE = 3


@dataclass
class Weights:
    """Scores of words by the element that holds them, and of tags. Keys are an element's name and marks. `inner` are
    the scores of words inside elements that asides() takes out. `marks` tells of learnt marks whether they speak of an
    aside; others are asides if they are in PRIOR."""

    words: dict[str, float] = field(default_factory=dict)
    inner: dict[str, float] = field(default_factory=dict)
    tags: dict[str, float] = field(default_factory=dict)
    marks: dict[str, bool] = field(default_factory=dict)
    word: float = 1.0
    tag: float = -0.5


@lru_cache(100_000)
def marks_of(key: str, name: str) -> tuple[str, ...]:
    """The words of an element's class, id and role, whole and by their parts."""
    own = key[len(name) :].split()
    return (*own, *(part for mark in own for part in re.split(r"[_-]+", mark) if part and part != mark))


def scan(html: str) -> tuple[list[tuple[str, str, str, str]], dict[int, int]]:
    """(kind, key, name, text): kind is open, close or text; a text's key is that of the element that holds it. With
    them, for each open token whose own end is told (by its end tag, or a next paragraph), the place after that end.

    Elements are closed by their own end tag or that of an element around them; an end tag that opens nothing is
    kept, but closes nothing.
    """
    out, ends = [], {}
    stack: list[tuple[str, str, int]] = []
    for m in TOKEN.finditer(html):
        token = m.group()
        if m.group(1) or token.startswith("<!"):
            continue
        tag = TAG.match(token)
        if not tag:
            out.append(("text", stack[-1][1] if stack else "", "", token))
            continue
        name = tag.group(2).lower()
        if tag.group(1):
            at = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), None)
            key = f"/{stack[at][1] if at is not None else name}"
            out.append(("close", key, name, ""))
            if at is not None:
                ends[stack[at][2]] = len(out)
                del stack[at:]
            continue
        marks = " ".join(filter(None, (x for found in MARK.findall(tag.group(3)) for x in found)))
        key = f"{name} {marks.lower()}".strip()
        out.append(("open", key, name, ""))
        if name == "p":
            # a paragraph ends where the next one begins
            at = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] in ("p", "div", "article", "section", "body", "li", "td")), None)
            if at is not None and stack[at][0] == "p":
                ends[stack[at][2]] = len(out) - 1
                del stack[at:]
        if name not in EMPTY and not token.endswith("/>"):
            stack.append((name, key, len(out) - 1))
        else:
            ends[len(out) - 1] = len(out)
    return out, ends


def aside(key: str, name: str, w: Weights) -> bool:
    return name in ASIDE or name == "header" or any(w.marks.get(mark, mark in PRIOR) for mark in marks_of(key, name))


def asides(tokens: list[tuple[str, str, str, str]], ends: dict[int, int], w: Weights) -> tuple[dict[int, int], set[int]]:
    """Elements that hold no main text, from the first token to after the last, and the bounds that no run may cross.

    Bounds are the tags of article and main, and of aside elements around them, as a form around the whole page. What
    lies inside an article is an aside all the same. html and body hold the page whatever their marks, and of an
    element without its own end nothing tells how far it goes; such are neither.
    """
    named = [i for i, t in enumerate(tokens) if t[0] != "text" and t[2] in ("article", "main")]
    opened = [i for i in named if tokens[i][0] == "open"]
    covered = [(i, ends[i]) for i in opened if tokens[i][2] == "article" and i in ends]
    out, bounds = {}, set(named)
    for i, end in ends.items():
        _, key, name, _ = tokens[i]
        if name in ("html", "body", "article", "main") or not aside(key, name, w):
            continue
        if any(i < x < end for x in opened) and not any(b < i < e for b, e in covered):
            bounds |= {i, end - 1}
        else:
            out[i] = end
    return out, bounds


def learn(pages: list[str]) -> Weights:
    """Weights from labelled pages: those with one article element, whose content is the label.

    A word scores the share of its element's words that lie inside articles less the share outside; a tag -0.5, less
    by 0.4 times the share of its pages that have it more inside. A mark is learnt from AGREE pages on: one that only
    elements outside articles bear speaks of an aside, one that more pages have inside than outside does not. Elements
    that asides() takes out of a page tell nothing of the rest, so a link or list in a menu does not speak against one
    in an article; they are counted for the words inside such elements only.
    """
    labelled = []
    for html in pages:
        tokens, told = scan(html)
        begins = [i for i, t in enumerate(tokens) if t[0] == "open" and t[2] == "article"]
        ends = [i for i, t in enumerate(tokens) if t[0] == "close" and t[2] == "article"]
        if len(begins) == 1 and ends and ends[-1] > begins[0]:
            labelled.append((tokens, told, range(begins[0] + 1, ends[-1])))
    w = Weights()
    marks_in, marks_out = Counter(), Counter()
    for tokens, _, within in labelled:
        seen_in, seen_out = set(), set()
        for i, (kind, key, name, _) in enumerate(tokens):
            if kind == "open" and name not in ("html", "body", "article", "main"):
                around = i < within.start and any(t[0] == "close" and t[1] == f"/{key}" for t in tokens[within.stop :])
                if not around:
                    (seen_in if i in within else seen_out).update(marks_of(key, name))
        marks_in.update(seen_in)
        marks_out.update(seen_out)
    w.marks = {m: False for m, n in marks_in.items() if n >= AGREE and n > marks_out[m]} | {m: True for m, n in marks_out.items() if n >= AGREE and not marks_in[m]}
    inside, outside, words_in, words_out, words_aside = Counter(), Counter(), Counter(), Counter(), Counter()
    for tokens, told, within in labelled:
        seen_in, seen_out = set(), set()
        until = 0
        out = asides(tokens, told, w)[0]
        for i, (kind, key, _, text) in enumerate(tokens):
            until = max(until, out.get(i, 0))
            if kind == "text":
                (words_aside if i < until else words_in if i in within else words_out)[key] += len(text.split())
            elif i >= until:
                (seen_in if i in within else seen_out).add(key)
        inside.update(seen_in)
        outside.update(seen_out)
    share = lambda one, other: (one - other) / (one + other) if one + other else 0.0
    w.words = {k: share(words_in[k], words_out[k]) or 0.1 for k in {*words_in, *words_out}}
    w.inner = {k: share(words_in[k], words_out[k] + words_aside[k]) or 0.1 for k in {*words_in, *words_out, *words_aside}}
    w.tags = {k: -0.5 + 0.4 * max(0.0, share(inside[k], outside[k])) for k in {*inside, *outside}}
    return w


def best_run(tokens: list[tuple[str, str, str, str]], words: dict[str, float], w: Weights, out: dict[int, int], bounds: set[int], never: float, begin: int, end: int) -> tuple[float, int, int]:
    """Score and place of the first maximum-scoring run of tokens[begin:end], by one scan; elements in `out` score
    nothing, and crossing one of `bounds` scores `never`."""
    best, at, total, start = 0.0, (begin, begin), 0.0, begin
    i = begin
    while i < end:
        if i in out:
            i = out[i]
            continue
        kind, key, _, text = tokens[i]
        if kind == "text":
            score = words.get(key, w.word) * len(text.split())
        else:
            score = never if i in bounds else w.tags.get(key, w.tag)
        if total <= 0:
            total, start = 0.0, i
        total += score
        i += 1
        if total > best:
            best, at = total, (start, i)
    return best, *at


def region(tokens: list[tuple[str, str, str, str]], w: Weights, out: dict[int, int], bounds: set[int]) -> tuple[int, int]:
    """The best run outside the elements of `out`, spanning those in its middle; empty if no word scores.

    A form, or an element told by its marks alone, may hold the page itself; its inner run is taken where it scores
    more, unless the element is no form and lies in the middle of the run. Elements whose names say that they hold no
    main text count only where nothing else has words.
    """
    # crossing a bound costs more than all words of the page bring in
    never = -1.0 - sum(len(t[3].split()) for t in tokens)
    found = best_run(tokens, w.words, w, out, bounds, never, 0, len(tokens))
    inner = {b: best_run(tokens, w.inner, w, out, bounds, never, b + 1, e) for b, e in sorted(out.items()) if e > b + 1}
    spanned = covered(len(tokens), [(b, e) for _, b, e in (found, *inner.values())])
    within = covered(len(tokens), [(b + 1, out[b]) for b in inner if tokens[b][2] != "form"])
    own = [run for b, run in inner.items() if not (within[b] if tokens[b][2] == "form" else spanned[b] or tokens[b][2] in ASIDE or tokens[b][2] == "header")]
    found = max([found, *own], key=lambda x: x[0])
    if not found[0]:
        found = max([found, *inner.values()], key=lambda x: x[0])
    return found[1], found[2]


def covered(n: int, ranges: list[tuple[int, int]]) -> list[int]:
    """For each of n places, how many of the ranges hold it."""
    steps = [0] * (n + 1)
    for begin, end in ranges:
        steps[begin] += 1
        steps[end] -= 1
    return list(accumulate(steps))


def main_text(html: str, w: Weights) -> str:
    """Blocks of the best region in page order, one a line; elements that hold no main text are left out of it."""
    tokens, ends = scan(html)
    out, bounds = asides(tokens, ends, w)
    begin, end = region(tokens, w, out, bounds)
    blocks: list[list[str]] = [[]]
    skip = begin
    for i in range(begin, end):
        kind, _, name, text = tokens[i]
        skip = max(skip, out.get(i, 0))
        if kind == "text":
            if i >= skip:
                blocks[-1].append(unescape(text))
        elif name in BLOCKS:
            blocks.append([])
        elif name == "br" and i >= skip:
            blocks[-1].append(" ")
    lines = (" ".join("".join(b).split()) for b in blocks)
    return "\n".join(line for line in lines if line)


def extract(pages: DataFrame, labelled: int = 500) -> DataFrame:
    """page_id, url, text, n_chars of every page's whole html.

    Weights are learned on the driver from at most `labelled` pages with an article element, by the order of a hash
    of page_id. Null html counts as empty and gives an empty text, as do pages without words; a page of any length is
    scanned whole; of runs of equal score the first is taken; equal pages give equal texts, and repeated rows are taken
    one by one; extra columns are left out; an empty table gives no rows.
    """
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    own = pages.select("page_id", html.alias("html")).filter(F.contains("html", F.lit("<article")))
    sample = own.filter(share_of_hash("page_id", labelled, own.count())).orderBy(F.xxhash64("page_id"), "page_id").limit(labelled)
    weights = learn([r[0] for r in sample.select("html").collect()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                rows = batch.slice(at, 512)
                texts = [main_text(h.as_py(), weights) for h in rows.column(2)]
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    kinds = ", ".join(f"{c} {pages.schema[c].dataType.simpleString()}" for c in ("page_id", "url"))
    return pages.select("page_id", "url", html.alias("html")).mapInArrow(run, f"{kinds}, text string, n_chars long")
