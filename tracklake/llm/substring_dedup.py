"""Removal of passages that repeat across texts, by paragraph MinHash banding.

Every text is cut into paragraphs from its first word to its last: at line
ends, at words whose hash is the least of 17 around, and where exact document
frequencies of five-word shingles show that a passage of more texts begins or
ends.  Equal passages are so cut alike wherever they stand, even inside a
longer line.  Equal paragraphs are one node; nodes are banded by MinHash, with
bands tuned for recall, those that collide are joined, verified by exact
Jaccard similarity, and clustered by components.  A paragraph with a partner
at the similarity t has t of its shingles in another text at least; those that
haven't need no bands, which is exact.

Of a cluster in two texts or more, the first occurrence stays, and the others
can go.  They do where such paragraphs, one after another, make a passage of
``least_words`` words or more: shorter lines that many texts share stay.

Where copies differ in a word here and there, frequencies change within a
passage, and its holders are cut unlike.  So an exact check follows: of windows
of ``least_words`` equal words, those whose hash is the least of STEP in a row
are compared over all texts, and what the paragraphs left of any but the first
text's goes too.  Of a run of ``least_words`` + STEP - 1 words or more that two
texts share, no more than STEP - 1 words at either end can stay so.

Results for odd input: a null or empty text has no paragraphs; a paragraph of
fewer words than a shingle is never removed; rows are told by id and text
together (null ids last), so that rows equal in both count as one text, and
texts that share an id or have none are apart; ties go to the smallest id,
text digest and place; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .clusters import verified_components
from .common import Words, bound_batches, discard, keyed, map_batches, materialise, mix64, release, row_key, sequence_hashes, spans
from .near_dup import band_keys
from .shared_shingles import Shared, with_frequencies

#: A word begins a paragraph if its hash is the least among so many words on either side.
AROUND = 8
#: So many shingles on a passage's side are in more texts than those that straddle its edge.
INSIDE = 8
#: Of so many windows in a row, the one with the least hash is compared.
STEP = 8
KEY = ["doc_id", "text_low", "text_high"]


def tune_bands(similarity: float, recall: float = 0.999, hashes: int = 64) -> tuple[int, int]:
    """(bands, rows): the most rows whose bands reach ``recall`` within ``hashes``."""
    best = None
    for rows in range(1, hashes + 1):
        bands = max(1, math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows))) if similarity < 1 else 1
        if bands * rows <= hashes:
            best = bands, rows
    if best is None:
        raise ValueError("too few hashes for this recall")
    return best


def edges_of_passages(frequency: np.ndarray, counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles (of all texts in order) with which a passage begins, and those with which what follows one begins.

    All INSIDE shingles on the passage's side are in more texts than any of
    the ``width`` - 1 on the other side, which straddle the edge.  Within a
    passage, all its holders see the same frequencies.
    """
    few, n = width - 1, len(frequency)
    _, index = spans(counts)
    left = np.repeat(counts, counts) - index

    def over(function, offsets: range) -> np.ndarray:
        found = None
        for k in offsets:
            moved = np.roll(frequency, -k)
            found = moved if found is None else function(found, moved)
        return found

    if few < 1 or not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    begins = (index >= few) & (left >= INSIDE) & (over(np.maximum, range(-few, 0)) < over(np.minimum, range(INSIDE)))
    ends = (index >= INSIDE) & (left >= few) & (over(np.minimum, range(-INSIDE, 0)) > over(np.maximum, range(few)))
    return np.flatnonzero(begins), np.flatnonzero(ends)


def paragraphs(words: Words, hashed: np.ndarray, frequency: np.ndarray, counts: np.ndarray, width: int) -> np.ndarray:
    """The words with which paragraphs begin, the first of each text among them.

    A word that is the least among those around cuts only if all of these are
    on its side of the fixed edges: line ends and edges of passages.
    """
    n = len(hashed)
    if not n:
        return np.zeros(0, np.int64)
    n_words = np.diff(words.first)
    index = np.arange(n) - np.repeat(words.first[:-1], n_words)
    left = np.repeat(n_words, n_words) - index
    lines = np.concatenate([[0], np.cumsum(words.data == 10)])[words.start]
    fixed = index == 0
    fixed[1:] |= lines[1:] != lines[:-1]
    # shingle i of a text begins with its word i
    word = np.arange(len(frequency)) + np.repeat(words.first[:-1] - (np.cumsum(counts) - counts), counts)
    begins, ends = edges_of_passages(frequency, counts, width)
    fixed[word[begins]] = True
    fixed[word[ends] - 1 + width] = True
    least = np.ones(n, bool)
    for k in range(1, AROUND + 1):
        least[k:] &= (hashed[k:] < hashed[:-k]) | (index[k:] < k)
        least[:-k] &= (hashed[:-k] < hashed[k:]) | (left[:-k] <= k)
    edge = np.append(np.flatnonzero(fixed), n)
    soft = np.flatnonzero(least & ~fixed)
    after = np.searchsorted(edge, soft)
    soft = soft[(soft - edge[after - 1] >= AROUND) & (edge[after] - soft > AROUND)]
    return np.union1d(edge[:-1], soft)


def chosen_windows(hashed: np.ndarray, first: np.ndarray, frequency: np.ndarray, counts: np.ndarray, width: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(first words, hashes) of the windows to compare.

    Only a window whose shingles all stand in other texts too can be in one.
    Of every STEP of these in a row, the one with the least hash is chosen, so
    that equal runs of words have equal choices; of fewer, none.
    """
    inside = length - width + 1
    none = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    if inside < 1 or not len(frequency):
        return none
    _, index = spans(counts)
    sums = np.concatenate([[0], np.cumsum(frequency > 1)])
    at = np.flatnonzero(np.repeat(counts, counts) - index >= inside)
    at = at[sums[at + inside] - sums[at] == inside]
    # shingle i of a text begins with its word i; a text of fewer words than a shingle has no window
    text = np.searchsorted(np.cumsum(counts), at, side="right")
    word = first[:-1][text] + index[at]
    if len(word) < STEP:
        return none
    value = sequence_hashes(hashed, word, word + length)
    row = np.lib.stride_tricks.sliding_window_view(value, STEP)
    least = np.arange(len(row)) + row.argmin(axis=1)
    whole = (word[STEP - 1:] - word[: 1 - STEP] == STEP - 1) & (text[STEP - 1:] == text[: 1 - STEP])
    least = np.unique(least[whole])
    return word[least], value[least]


_FOUND = "doc_id long, text_low long, text_high long, first long, start long, end long, n_words int, node long, shared int, items binary, windows binary"
_WINDOW = np.dtype([("hash", "<i8"), ("first", "<u4"), ("start", "<u4"), ("end", "<u4")])


def _finder(similarity: float, width: int, length: int):
    """Paragraphs whose shared shingles can reach the similarity; in a row of its own, each text's windows to compare."""

    names = [*KEY, "first", "start", "end", "n_words", "node", "shared", "items", "windows"]

    def run(texts: Shared) -> Iterator[pa.RecordBatch]:
        words = texts.words
        hashed = words.hashes()
        begin = paragraphs(words, hashed, texts.frequency, texts.counts, width)
        owner = np.searchsorted(words.first[:-1], begin, side="right") - 1
        end = np.append(begin[1:], len(hashed))[: len(begin)]
        within = end - begin - width + 1
        shared = (texts.frequency > 1).astype(np.int64)
        sums = np.concatenate([[0], np.cumsum(shared)])
        at = (np.cumsum(texts.counts) - texts.counts)[owner] + begin - words.first[owner]
        some = np.flatnonzero(within > 0)
        some = some[sums[at[some] + within[some]] > sums[at[some]]]
        # the set of each paragraph's shingles
        group, place = spans(within[some])
        spot = at[some][group] + place
        order = np.lexsort((texts.hashes[spot], group))
        group, hashes, known = group[order], texts.hashes[spot][order], shared[spot][order]
        new = np.ones(len(group), bool)
        new[1:] = (group[1:] != group[:-1]) | (hashes[1:] != hashes[:-1])
        group, hashes, known = group[new], hashes[new], known[new]
        total = np.bincount(group, minlength=len(some))
        common = np.bincount(group, weights=known, minlength=len(some)).astype(np.int64)
        able = common >= similarity * total * (1 - 1e-12)
        chosen = some[able]
        a, b, text = begin[chosen], end[chosen], owner[chosen]
        letters = np.concatenate([[0], np.cumsum((words.data & 0xC0) != 0x80)])
        blanks = np.append(np.flatnonzero(words.data <= 32), len(words.data))

        def stops(b: np.ndarray, text: np.ndarray) -> np.ndarray:
            """Bytes up to the next word, or to the text's last word with the marks that follow it."""
            last = b == words.first[text + 1]
            stop = np.where(last, words.end[b - 1], words.start[np.minimum(b, len(hashed) - 1)])
            return np.where(last, np.minimum(blanks[np.searchsorted(blanks, stop)], words.offsets[text + 1]), stop)

        stop = stops(b, text)
        zero = letters[words.offsets[text]]
        ends = np.concatenate([[0], np.cumsum(8 * total[able])]).astype(np.int32)
        raw = hashes[able[group]].astype("<u8").tobytes()
        key = [texts.rows.column(c).combine_chunks().cast(pa.int64()).take(pa.array(text)) for c in KEY]
        yield pa.record_batch([
            *key, pa.array(a - words.first[text]), pa.array(letters[words.start[a]] - zero), pa.array(letters[stop] - zero), pa.array((b - a).astype(np.int32)),
            pa.array(sequence_hashes(hashed, a, b).view(np.int64)), pa.array(common[able].astype(np.int32)),
            pa.Array.from_buffers(pa.binary(), len(chosen), [None, pa.py_buffer(ends), pa.py_buffer(raw)]), pa.nulls(len(chosen), pa.binary()),
        ], names=names)
        at, value = chosen_windows(hashed, words.first, texts.frequency, texts.counts, width, length)
        text = np.searchsorted(words.first, at, side="right") - 1
        zero = letters[words.offsets[text]]
        found = np.empty(len(at), _WINDOW)
        found["hash"], found["first"] = value.view(np.int64), at - words.first[text]
        found["start"], found["end"] = letters[words.start[at]] - zero, letters[stops(at + length, text)] - zero
        owner, begin = np.unique(text, return_index=True)
        ends = (np.append(begin, len(at)) * _WINDOW.itemsize).astype(np.int32)
        key = [texts.rows.column(c).combine_chunks().cast(pa.int64()).take(pa.array(owner)) for c in KEY]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary()]
        yield pa.record_batch([
            *key, *(pa.nulls(len(owner), k) for k in kinds), pa.Array.from_buffers(pa.binary(), len(owner), [None, pa.py_buffer(ends), pa.py_buffer(found.tobytes())]),
        ], names=names)

    return run


def _bander(bands: int, rows: int):
    """Adds the buckets of each node, by the least hashes of its items."""
    seeds = mix64(np.arange(1, bands * rows + 1, dtype=np.uint64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for low in range(0, whole.num_rows, 1024):
                batch = whole.slice(low, 1024)
                listed = batch.column("items").to_pylist()
                begin = np.cumsum([0, *(len(x) // 8 for x in listed[:-1])])
                hashed = np.frombuffer(b"".join(listed), "<u8")
                least = np.stack([np.minimum.reduceat(mix64(hashed ^ seed), begin) for seed in seeds], axis=1)
                buckets = np.zeros((len(listed), bands), np.uint64)
                for k in range(bands):
                    key = np.full(len(listed), (k + 1) * 0xD1342543DE82EF95 & 0xFFFFFFFFFFFFFFFF, np.uint64)
                    for j in range(rows):
                        key = mix64(key ^ least[:, k * rows + j])
                    buckets[:, k] = key
                ends = pa.array(np.arange(0, buckets.size + 1, bands, dtype=np.int32))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(ends, pa.array(buckets.view(np.int64).ravel()))], names=[*batch.schema.names, "bands"])

    return run


def _verifier(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            holds = []
            for i, (x, y) in enumerate(zip(batch.column("items_a").to_pylist(), batch.column("items_b").to_pylist(), strict=True)):
                p, q = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
                common = len(np.intersect1d(p, q, assume_unique=True))
                if common >= similarity * (len(p) + len(q) - common):
                    holds.append(i)
            yield pa.record_batch([pa.array([a[i] for i in holds], pa.int64()), pa.array([b[i] for i in holds], pa.int64())], names=["a", "b"])

    def verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
        first = sets.select(F.col("node").alias("a"), F.col("items").alias("items_a"))
        second = sets.select(F.col("node").alias("b"), F.col("items").alias("items_b"))
        return map_batches(pairs.join(first, "a").join(second, "b").select("a", "b", "items_a", "items_b"), run, "a long, b long")

    return verify


def _repeating(placed: DataFrame) -> DataFrame:
    """Paragraphs of clusters in two texts or more, once for equal rows; later: not the cluster's first."""
    key = F.struct(F.col("doc_id").isNull().alias("nameless"), *KEY)
    by = placed.groupBy("cluster_id").agg(F.min(F.struct(key.alias("key"), "first")).alias("earliest"), F.max(key).alias("last"))
    joined = placed.join(by.where("earliest.key != last").select("cluster_id", "earliest"), "cluster_id")
    return joined.withColumn("later", F.struct(key.alias("key"), "first") != F.col("earliest")).drop("earliest").dropDuplicates([*KEY, "first"])


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each window."""
    for batch in batches:
        listed = batch.column("windows").to_pylist()
        found = np.frombuffer(b"".join(listed), _WINDOW)
        text = pa.array(np.repeat(np.arange(len(listed)), [len(x) // _WINDOW.itemsize for x in listed]))
        yield pa.record_batch([*(batch.column(c).take(text) for c in KEY), *(pa.array(found[c].astype(np.int64)) for c in _WINDOW.names)], names=[*KEY, "cluster_id", "first", "start", "end"])


def _uncovered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What a text's later windows hold beyond its removed paragraphs, as pieces of whole words."""
    for batch in batches:
        source, rows = [], []
        for i, (later, gone) in enumerate(zip(batch.column("later").to_pylist(), batch.column("gone").to_pylist(), strict=True)):
            cuts = sorted((x["first"], x["last"], x["start"], x["end"]) for x in gone or ())
            done, done_at, k = 0, 0, 0  # words that are gone already, and the character at which the next begins
            for x in sorted(later, key=lambda x: x["first"]):
                at, begin = max((done, done_at), (x["first"], x["start"]))
                while at < x["last"]:
                    while k < len(cuts) and cuts[k][1] <= at:
                        k += 1
                    if k < len(cuts) and cuts[k][0] <= at:
                        at, begin = cuts[k][1], cuts[k][3]
                        continue
                    to, stop = (cuts[k][0], cuts[k][2]) if k < len(cuts) and cuts[k][0] < x["last"] else (x["last"], x["end"])
                    if source and source[-1] == i and rows[-1][1] == begin:  # one piece goes on
                        rows[-1] = (rows[-1][0], stop, rows[-1][2] + to - at, rows[-1][3])
                    else:
                        source.append(i)
                        rows.append((begin, stop, to - at, x["cluster_id"]))
                    at, begin = to, stop
                done, done_at = max((done, done_at), (at, begin))
        columns = list(zip(*rows, strict=True)) or [()] * 4
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64()]
        own = [batch.column(c).take(pa.array(source, pa.int64())) for c in KEY]
        yield pa.record_batch([*own, *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=[*KEY, "start", "end", "n_words", "cluster_id"])


def _exact(windows: DataFrame, passages: DataFrame, length: int) -> DataFrame:
    """Rows of passages for what equal windows of later texts hold beyond the removed paragraphs."""
    key = F.struct(F.col("doc_id").isNull().alias("nameless"), *KEY)
    listed = map_batches(windows, _unpack, "doc_id long, text_low long, text_high long, cluster_id long, first long, start long, end long")
    by = listed.groupBy("cluster_id").agg(F.min(F.struct(key.alias("key"), "start", "end")).alias("earliest"), F.max(key).alias("last"))
    by = materialise(by.where("earliest.key != last").drop("last"), "windows")
    spot = lambda last: F.struct("first", last.alias("last"), "start", "end")
    later = listed.join(by, "cluster_id").where(key != F.col("earliest.key")).withColumn("at", spot(F.col("first") + length).withField("cluster_id", F.col("cluster_id")))
    later = later.groupBy(*KEY).agg(F.collect_set("at").alias("later"))
    gone = passages.where("removed").groupBy(*(F.col(c).alias(f"_{c}") for c in KEY)).agg(F.collect_list(spot(F.col("first") + F.col("n_words"))).alias("gone"))
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in KEY]
    texts = later.join(gone, same[0] & same[1] & same[2], "left").select(*KEY, "later", "gone")
    pieces = materialise(map_batches(texts, _uncovered, "doc_id long, text_low long, text_high long, start long, end long, n_words int, cluster_id long"), "pieces")
    stays = by.join(pieces.select("cluster_id").distinct(), "cluster_id")
    columns = ["doc_id", "start", "end", "n_words", "cluster_id", "removed", "text_low", "text_high"]
    kept = stays.select("earliest.key.*", "earliest.start", "earliest.end", F.lit(length).alias("n_words"), "cluster_id", F.lit(False).alias("removed"))
    return pieces.withColumn("removed", F.lit(True)).select(*columns).union(kept.select(*columns))


def repeated_passages(docs: DataFrame, least_words: int = 40, similarity: float = 0.8, width: int = 5, recall: float = 0.999) -> DataFrame:
    """doc_id, start, end (characters), n_words, cluster_id, removed, text_low, text_high.

    One row for each paragraph that is removed, and for the occurrence of its
    cluster that stays, if that is in a passage too; one for each piece that
    the exact check adds, and for the first text's window that stays for it
    (their cluster_id is the window's hash); other texts have no row.
    """
    bands, rows = tune_bands(similarity, recall)
    found = materialise(with_frequencies(keyed(docs), _finder(similarity, width, least_words), _FOUND, width), "paragraphs")
    release(docs.sparkSession)  # the texts' shuffle
    sets = found.where("windows is null").groupBy("node").agg(F.first(F.struct("shared", "items")).alias("one")).select("node", F.col("one.shared").cast("double").alias("shared"), (F.length("one.items") / 8).alias("total"), "one.items")
    nodes = materialise(map_batches(sets, _bander(bands, rows), "node long, shared double, total double, items binary, bands array<long>"), "nodes")
    slim = materialise(found.where("windows is null").drop("items", "shared", "windows"), "places")
    windows = materialise(found.where("windows is not null").select(*KEY, "windows"), "windows")
    discard(found, collect=True)
    members = nodes.select("node", "total", "shared", F.explode("bands").alias("bucket"))
    linked = verified_components(members, nodes.select("node", "items"), similarity, _verifier(similarity))
    discard(nodes, collect=True)
    placed = slim.join(linked, "node", "left").withColumn("cluster_id", F.coalesce("component", "node")).drop("component", "node")
    repeated = materialise(_repeating(placed), "repeated")
    discard(slim, linked)
    # runs of paragraphs one after another, and of later ones among them
    order = Window.partitionBy(*KEY).orderBy("first")
    apart = F.coalesce(F.col("first") != F.lag(F.col("first") + F.col("n_words")).over(order), F.lit(True))
    turned = apart | (F.col("later") != F.lag("later").over(order))
    runs = repeated.withColumns({"run": F.sum(apart.cast("int")).over(order), "part": F.sum(turned.cast("int")).over(order)})
    words = lambda name: F.sum("n_words").over(Window.partitionBy(*KEY, name))
    sized = runs.withColumns({"long": words("run") >= least_words, "removed": F.col("later") & (words("part") >= least_words)})
    passages = materialise(sized.where("removed or (long and not later)").drop("run", "part", "long", "later"), "passages")
    discard(repeated)
    gone = passages.where("removed").select("cluster_id").distinct()
    near = passages.join(gone, "cluster_id", "left_semi").select("doc_id", "start", "end", "n_words", "cluster_id", "removed", "text_low", "text_high")
    return near.union(_exact(windows, passages, least_words))


def _without(text: pa.Array, cuts: pa.Array) -> pa.Array:
    def cut(whole: str | None, spans_: list | None) -> str | None:
        if spans_ is None or whole is None:
            return whole
        at, parts = 0, []
        for x in sorted((s["start"], s["end"]) for s in spans_):
            parts.append(whole[at: max(at, x[0])])
            at = max(at, x[1])
        return "".join([*parts, whole[at:]])

    return pa.array([cut(t.as_py(), s.as_py()) for t, s in zip(text, cuts, strict=True)], pa.string())


def without_passages(docs: DataFrame, passages: DataFrame) -> DataFrame:
    """``docs`` with the removed passages cut out of ``text``; all rows stay.

    Rows are told by id and text together.  If ``docs`` has ``n_chars``, it is
    counted anew.  A null text stays null; other columns stay as they are,
    whatever their names.
    """
    # a text's own spans: as many as it has paragraphs
    cut = passages.where("removed").groupBy(*KEY).agg(F.collect_list(F.struct("start", "end")).alias("spans")).select("spans", *(F.col(c).alias(f"_{c}") for c in KEY))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), *row_key(docs))
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in KEY]
    joined = rows.join(cut, same[0] & same[1] & same[2], "left").select("row", "spans")
    bound_batches(docs.sparkSession)
    shorten = F.arrow_udf(_without, "string")
    left = F.when(F.col("spans").isNull(), F.col("row.text")).otherwise(F.col("cut"))
    changed = joined.withColumn("cut", shorten(F.when(F.col("spans").isNotNull(), F.col("row.text").cast("string")), F.col("spans"))).withColumn("left", left)
    made = {"text": F.col("left"), "n_chars": F.when(F.col("spans").isNull(), F.col("row.n_chars")).otherwise(F.length("left")) if "n_chars" in docs.columns else None}
    return changed.select(*((made[c] if c in made else F.col(f"row.`{c}`")).cast(docs.schema[c].dataType).alias(c) for c in docs.columns))
