"""Token counts by byte-pair merging on a heap and a linked list.

A word's bytes are its first symbols.  All adjacent pairs that the vocabulary
can merge wait on a heap by (rank, position); the lowest one is merged, its
neighbours' pairs are renewed in the linked list, and so on.  The count is the
number of first symbols less the number of merges; ids are never made.

Results for odd input: a null or empty text has 0 tokens; a null ``doc_id``
stays null; repeated rows give repeated results; an empty table gives an
empty result; other columns are ignored.  Very long texts are cut into words
lazily and never truncated.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches

#: A text of these characters only is split here; any other one is split by
#: the tokenizer library's own pre-tokenizer.  Fixed value: ASCII without
#: control characters other than white space, and Latin letters whose class
#: is the same in every Unicode version.
_PLAIN = re.compile("[\\t\\n\\r -~À-ÖØ-öø-įı-ňŊ-ž]*")
_LETTER = "A-Za-zÀ-ÖØ-öø-įı-ňŊ-ž"
#: The byte-level splitting pattern, a fixed value of the vocabulary, for plain texts.
_SPLIT = re.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTER}]+| ?[0-9]+| ?[^\t\n\r {_LETTER}0-9]+|[\t\n\r ]+(?![^\t\n\r ])|[\t\n\r ]+"
)


def byte_symbols() -> dict[int, str]:
    """The printable character that stands for each byte in the vocabulary."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    names = {b: chr(b) for b in shown}
    hidden = (b for b in range(256) if b not in names)
    return names | {b: chr(256 + k) for k, b in enumerate(hidden)}


class MergeCounter:
    """Counts tokens for one vocabulary; keeps counts of words already seen."""

    def __init__(self, path: str, remembered: int = 400_000):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        self.special = [t["content"] for t in model["added_tokens"]]
        merges = model["model"]["merges"]
        names: dict[str, int] = {}
        code = lambda s: names.setdefault(s, len(names))
        self.byte = [code(s) for _, s in sorted(byte_symbols().items())]
        #: (left << 20 | right) -> (rank << 20 | merged symbol)
        self.pairs: dict[int, int] = {}
        for rank, pair in enumerate(merges):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.pairs[code(left) << 20 | code(right)] = rank << 20 | code(left + right)
        if len(names) >= 1 << 20:
            raise ValueError("a vocabulary of a million symbols or more is not supported")
        self.path, self.remembered = path, remembered
        self.seen: dict[str, int] = {}
        self.by_special = re.compile("|".join(map(re.escape, self.special))) if self.special else None
        self._library = None

    def merge(self, word: bytes) -> int:
        """Symbols left of one word when no pair can be merged any more."""
        symbol = [self.byte[b] for b in word]
        n = len(symbol)
        if n < 2:
            return n
        pairs = self.pairs
        heap = []
        for i in range(n - 1):
            found = pairs.get(symbol[i] << 20 | symbol[i + 1])
            if found is not None:
                # rank, position, merged symbol and the pair it stood for
                heap.append((found >> 20, i, found & 0xFFFFF, symbol[i], symbol[i + 1]))
        if not heap:
            return n
        heapq.heapify(heap)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        left = n
        pop, push = heapq.heappop, heapq.heappush
        while heap:
            _, i, merged, a, b = pop(heap)
            j = after[i]
            if symbol[i] != a or j >= n or symbol[j] != b:
                continue  # an earlier merge has changed this pair
            symbol[i], symbol[j] = merged, -1
            k = after[i] = after[j]
            left -= 1
            if k < n:
                before[k] = i
                found = pairs.get(merged << 20 | symbol[k])
                if found is not None:
                    push(heap, (found >> 20, i, found & 0xFFFFF, merged, symbol[k]))
            h = before[i]
            if h >= 0:
                found = pairs.get(symbol[h] << 20 | merged)
                if found is not None:
                    push(heap, (found >> 20, h, found & 0xFFFFF, symbol[h], merged))
        return left

    def _split(self, text: str) -> list[str]:
        if _PLAIN.fullmatch(text):
            return _SPLIT.findall(text)
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self.path).pre_tokenizer
        names = self._library.pre_tokenize_str(text)
        return [text[a:b] for _, (a, b) in names]

    def count(self, text: str) -> int:
        if self.by_special and any(s in text for s in self.special):
            parts = self.by_special.split(text)
            return len(parts) - 1 + sum(self._count(p) for p in parts)
        return self._count(text)

    def _count(self, text: str) -> int:
        if not text:
            return 0
        seen = self.seen
        words = self._split(text)
        try:
            return sum(map(seen.__getitem__, words))
        except KeyError:
            pass
        total = 0
        for word in words:
            n = seen.get(word)
            if n is None:
                n = self.merge(word.encode())
                if len(word) <= 64:
                    if len(seen) >= self.remembered:
                        seen.clear()
                    seen[word] = n
            total += n
        return total


_COUNTERS: dict[str, MergeCounter] = {}


def counter(path: str) -> MergeCounter:
    """The counter of this Python worker for a vocabulary file."""
    if path not in _COUNTERS:
        _COUNTERS[path] = MergeCounter(path)
    return _COUNTERS[path]


def token_counts(docs: DataFrame, path: str, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every text; no shuffle."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path).count
        for whole in batches:
            for low in range(0, whole.num_rows, 256):
                batch = whole.slice(low, 256)
                texts = [t or "" for t in batch.column("text").to_pylist()]
                tokens = [count(t) for t in texts]
                yield pa.record_batch([
                    batch.column("doc_id").cast(pa.int64()),
                    pa.array([len(t) if t.isascii() else len(t.encode()) for t in texts], pa.int64()),
                    pa.array(tokens, pa.int64()),
                    pa.array([n > limit for n in tokens], pa.bool_()),
                ], schema=schema)

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_batches(source, run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
