"""Main text of web pages by a maximum-scoring subsequence.

A page is read as words and tags.  Tags score negative; a word scores positive
or negative by what is around it: the elements, the length, links and marks of
its block, the length and links of the elements around that, its place in the
page, and the names of classes.  All scores are learned from labelled pages:
words by a logistic regression over these features, tags by how often they
stand outside articles.  A linear scan finds the contiguous run with the
greatest sum; its blocks are the article, but for those whose words score well
below zero.

Results for odd input: a null or empty page, or one without a positive word,
has an empty text; broken and cut off markup is read as far as it goes; a null
``page_id`` or ``url`` stays null; repeated rows give repeated results; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches
from .labelled_pages import BEGIN, END, pages
from .quality_classifier import fit

#: Elements whose content is no text, and elements by their role in HTML.
RAW = "script|style|textarea|title|xmp"
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul "
    "button canvas iframe noscript object select svg template video audio".split()
)
NO_TEXT = frozenset("head noscript template svg iframe select button object canvas audio video math datalist".split())
#: An element that begins ends an open one of these, up to the nearest container.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "body": {"head"}}
#: Elements that an end tag inside them doesn't close.
SCOPES = frozenset("article aside body div dl footer form header html main nav ol section table td th ul".split())

_TOKEN = re.compile(
    rf"(?P<skip><!--.*?(?:-->|\Z)|<(?:{RAW})\b[^>]*+>.*?(?:</(?:{RAW})\s*+>|\Z)|<[!?][^>]*+(?:>|\Z))"
    r"""|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>"']++|"[^"]*+"|'[^']*+'|["'])*?)(?:>|\Z)"""
    r"|(?P<text>[^<]++|<)",
    re.S | re.I,
)
_ATTR = re.compile(r"""\b(class|id|role|style|hidden|aria-hidden|itemprop)\b(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]++)))?""", re.I)
_TERM = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

class Page:
    """Text of a page: its nodes, the elements around them, and its tags."""

    __slots__ = ("nodes", "tags", "parent", "name", "terms", "depth")

    def __init__(self, page: str, marks: list[tuple[int, bool]] | None = None):
        #: Block, text, nearest block element, whether in a link, whether shown, tags before it.
        self.nodes: list[tuple[int, str, int, bool, bool, int]] = []
        self.tags: list[str] = []
        #: Of each block element: the one around it, its name, the terms of its names, its depth.
        self.parent, self.name, self.terms, self.depth = [0], [""], [()], [0]
        stack = [("", 0, False, True)]
        block = 0
        for m in _TOKEN.finditer(page):
            kind = m.lastgroup
            if kind == "text":
                text = m["text"]
                _, element, linked, shown = stack[-1]
                if not text.isspace():
                    self.nodes.append((block, text, element, linked, shown, len(self.tags)))
                elif self.nodes and self.nodes[-1][0] == block:
                    self.nodes.append((block, " ", element, linked, shown, len(self.tags)))
                continue
            if m["skip"] is not None:
                if marks is not None and m["skip"] in (BEGIN, END):
                    marks.append((len(self.nodes), m["skip"] == BEGIN))
                    block += 1
                continue
            name = m["name"].lower()
            self.tags.append(name)
            if name == "br":
                self.nodes.append((block, " ", *stack[-1][1:], len(self.tags)))
            if name in BLOCKS:
                block += 1
            if m["end"]:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] == name:
                        del stack[i:]
                        break
                    if stack[i][0] in SCOPES and name not in SCOPES:
                        break
                continue
            if name in BLOCKS and stack[-1][0] == "p":
                stack.pop()
            ends = ENDS.get(name)
            if ends:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] in ends:
                        del stack[i:]
                        break
                    if stack[i][0] in SCOPES and stack[i][0] not in ends:
                        break
            if name in VOID or m["attrs"].endswith("/") and name not in BLOCKS:
                continue
            _, element, linked, shown = stack[-1]
            terms, hidden = named(m["attrs"]) if m["attrs"] else ((), False)
            shown = shown and not hidden and name not in NO_TEXT
            if name in BLOCKS:
                self.parent.append(element)
                self.name.append(name)
                self.terms.append(terms if name not in ("html", "body") else ())
                self.depth.append(self.depth[element] + 1)
                element = len(self.parent) - 1
            stack.append((name, element, linked or name == "a", shown))


def named(attrs: str) -> tuple[tuple[str, ...], bool]:
    """The terms of an element's names, and whether it is hidden."""
    terms, hidden = [], False
    for m in _ATTR.finditer(attrs):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key in ("class", "id", "role", "itemprop"):
            terms += ["." + t.lower() for t in _TERM.findall(value)]
        elif key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            hidden = True
    return tuple(terms), hidden


def _size(n: int) -> int:
    return min(n.bit_length(), 10)


def _part(a: int, b: int) -> int:
    """Five steps of a share."""
    return 0 if not a else 4 if a == b else 1 + min(2, 3 * a // b)


def blocks(page: Page) -> tuple[list[list[int]], list[list[str]], list[int]]:
    """For each block: its nodes, the features of its words, and how many they are."""
    n = len(page.parent)
    words, linked, held = [0] * n, [0] * n, [0] * n
    members: list[list[int]] = []
    stats: list[list[int]] = []
    last = None
    for i, (block, text, element, link, shown, _) in enumerate(page.nodes):
        if block != last:
            members.append([])
            stats.append([0, 0, 0, element])
            held[element] += 1
            last = block
        members[-1].append(i)
        if shown:
            k = len(text.split())
            stats[-1][0] += k
            stats[-1][1] += k * link
            stats[-1][2] += sum(map(text.count, ".,;:!?"))
            words[element] += k
            linked[element] += k * link
    for e in range(n - 1, 0, -1):  # elements come after those around them
        up = page.parent[e]
        words[up] += words[e]
        linked[up] += linked[e]
        held[up] += held[e]
    whole, seen, found = max(1, words[0]), 0, []
    for j, (k, links, marks, e) in enumerate(stats):
        one, two = page.parent[e], page.parent[page.parent[e]]
        before = stats[j - 1] if j else (0, 0, 0, 0)
        after = stats[j + 1] if j + 1 < len(stats) else (0, 0, 0, 0)
        features = {
            f"tag {page.name[e]}", f"words {_size(k)}", f"links {_part(links, k)}", f"marks {_size(marks)}", f"long {_size(k)} {_part(links, k)} {min(marks, 2)}",
            f"own {_size(words[e])} {_part(linked[e], words[e])}", f"own held {_size(held[e])}",
            f"up {_size(words[one])} {_part(linked[one], words[one])}", f"up held {_size(held[one])}", f"up name {page.name[one]} {page.name[e]}",
            f"upper {_size(words[two])} {_part(linked[two], words[two])}", f"upper share {5 * words[two] // whole}", f"up share {5 * words[one] // whole}", f"own share {5 * words[e] // whole}",
            f"place {min(9, 10 * seen // whole)}", f"depth {min(page.depth[e], 12)}",
            f"before {_size(before[0])} {_part(before[1], before[0])}", f"after {_size(after[0])} {_part(after[1], after[0])}",
        }
        seen += k
        at = e
        while at:
            features.add(f"in {page.name[at]}")
            features.update(page.terms[at])
            at = page.parent[at]
        found.append(sorted(features))
    return members, found, [s[0] for s in stats]


class Weights:
    """Scores of a word by its features, and of tags, from labelled pages."""

    MOST = 3.0

    def __init__(self, labelled: Iterable[str], l2: float = 2e-4):
        rows, grades, counts = [], [], []
        inside, tags = Counter(), Counter()
        number: dict[str, int] = {}
        for text in labelled:
            marks: list[tuple[int, bool]] = []
            page = Page(text, marks)
            main = [False] * len(page.nodes)
            for (a, on), (b, _) in zip(marks, [*marks[1:], (len(page.nodes), False)], strict=True):
                main[a:b] = [on] * (b - a)
            seen = 0
            for (_, _, _, _, _, at), on in zip(page.nodes, main, strict=True):
                tags.update(page.tags[seen:at])
                inside.update(page.tags[seen:at] if on else ())
                seen = at
            members, features, words = blocks(page)
            for nodes, own, k in zip(members, features, words, strict=True):
                if k:
                    rows.append(np.array([number.setdefault(f, len(number)) for f in own], np.int64))
                    grades.append(int(main[nodes[0]]))
                    counts.append(k)
        # a feature of a few blocks tells nothing of other pages
        often = np.bincount(np.concatenate(rows), minlength=len(number)) >= 8
        place = np.cumsum(often) - 1
        columns = [place[r[often[r]]] for r in rows]
        model = fit(np.arange(int(often.sum())), columns, np.array(grades), 2, l2)
        self.around = {f: float(model.weights[place[i]]) for f, i in number.items() if often[i]}
        self.base = -float(model.thresholds[0])
        # a tag that mostly stands outside of articles ends a region sooner
        self.tags = {t: -0.05 - 0.5 * (1 - inside[t] / n) for t, n in tags.items()}

    def word(self, features: list[str], names: bool = True) -> float:
        """Log odds that a word with these features is the article's."""
        get = self.around.get
        score = self.base + sum(get(f, 0.0) for f in features if names or f[0] != ".")
        return min(self.MOST, max(-self.MOST, score))

    def tag(self, name: str) -> float:
        return self.tags.get(name, -0.1)


def best_region(scores: list[float]) -> tuple[int, int]:
    """[low, high) of the contiguous run with the greatest sum; empty if none is positive."""
    best, at, low, total = 0.0, (0, 0), 0, 0.0
    for i, score in enumerate(scores):
        if total <= 0:
            low, total = i, 0.0
        total += score
        if total > best:
            best, at = total, (low, i + 1)
    return at


#: A block of the region goes if its words score below this: a short one next to others is rather the article's.
LEAST = -0.7


@cache
def default_weights(n: int = 1500, seed: int = 1) -> Weights:
    """From n labelled pages; the only weights that are kept."""
    return Weights(pages(n, seed))


def main_text(page: str, weights: Weights | None = None) -> str:
    """The blocks of the best region, one per line.

    If no word scores positive, names of classes are left out of account.
    """
    weights = weights or default_weights()
    read = Page(page)
    members, features, words = blocks(read)
    low = high = 0
    scores: list[float] = []
    for names in (True, False):
        scores = [weights.word(f, names) if k else 0.0 for f, k in zip(features, words, strict=True)]
        line, seen = [], 0
        for nodes, score, k in zip(members, scores, words, strict=True):
            at = read.nodes[nodes[-1]][5]
            line.append(sum(map(weights.tag, read.tags[seen:at])) + score * k)
            seen = at
        low, high = best_region(line)
        if high > low:
            break
    lines = []
    for nodes, score in zip(members[low:high], scores[low:high], strict=True):
        if score > LEAST:
            text = "".join(read.nodes[i][1] for i in nodes if read.nodes[i][4])
            lines.append(" ".join(html.unescape(text).split()))
    return "\n".join(line for line in lines if line)


def extract(table: DataFrame, weights: Weights | None = None) -> DataFrame:
    """page_id, url, text and n_chars of every page; no shuffle."""
    known = weights or default_weights()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for low in range(0, whole.num_rows, 256):
                batch = whole.slice(low, 256)
                texts = [main_text(h, known) if h else "" for h in batch.column("html").to_pylist()]
                yield pa.record_batch([
                    batch.column("page_id").cast(pa.int64()), batch.column("url").cast(pa.string()), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()),
                ], names=["page_id", "url", "text", "n_chars"])

    source = table.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return map_batches(source, run, "page_id long, url string, text string, n_chars long")
