"""Suffix-array dedup with a run-length index.

A byte goes if it is covered by a string of 100 bytes that also starts earlier, in a document with a smaller id or
earlier in the same one. All strings of 100 bytes are dealt out by the anchor they contain. Runs of such strings that are
equal as a whole are told by 128 bits that come from all their bytes, and only the first one goes on; runs that share an
anchor with others, and may be equal in part, are what the index is built over.

The index is the run-compressed Burrows-Wheeler transform of the runs of some anchors, in the order of their documents.
Of the suffix array only the samples at the starts of the transform's runs are kept: a text position, the position of
the suffix before it, and the length of the match of the two. Within a run of the transform, the suffix before the one
at i + 1 is one on from the suffix before the one at i, and the match is one shorter, so that the samples give the
matching statistics of every position as they are streamed in text order. Positions with matches of 100 bytes or more
are tied to the suffixes before them; what is tied together is one string, and all but its first place are marked.

The runs of an anchor that more than ``crowd`` different ones share are dealt anew, by longer anchors: twice as long each
time, and indexed as soon as they are few. Longer anchors tell apart what follows a common string; at the length of the
window only equal strings meet.

Null texts are empty. Rows with a null id are left as they are and are no source for others. Rows that repeat an id
must be equal rows; each gets a row of the result. Texts below 100 bytes lose nothing; texts of any length are judged as
a whole, in blocks. An empty table gives no rows; other columns of the input are not looked at.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import anchors
from .common import Saved, arrow_map, chunks
from .substring_dedup import NAMES, _batch, spans, unzipped, zipped

WINDOW, ANCHOR = 100, 32
#: Different runs of an anchor that are indexed together at most.
CROWD = 10_000
#: Bytes of runs in an index, about; whole anchors are kept together.
INDEXED = 1 << 20
#: Crowded anchors that are broadcast at most; more are joined by an exchange, whose hot partitions Spark splits.
BROADCAST = 1_000_000
#: Bytes whose runs are found at a time.
BLOCK = 1 << 18
BYTES = anchors.mixed(np.arange(1, 257, dtype=np.uint64) * anchors.M)


def digests(text: bytes, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    from xxhash import xxh3_64_intdigest as digest

    return np.fromiter((digest(text[a:b]) for a, b in zip(first.tolist(), (first + size).tolist(), strict=True)), np.uint64, len(first))


def blocks(texts: list[bytes], window: int, most: int = BLOCK):
    """(texts, row of each, where in its text each begins): about ``most`` bytes, which the processor's cache holds.
    Longer texts come in parts that overlap, so that each window starts in just one."""
    some, rows, begins, size = [], [], [], 0
    for row, text in enumerate(texts):
        for at in range(0, max(len(text) - window + 1, 1), most):
            some.append(text[at : at + most + window - 1])
            rows.append(row)
            begins.append(at)
            size += len(some[-1])
            if size >= most:
                yield some, np.array(rows), np.array(begins)
                some, rows, begins, size = [], [], [], 0
    if some:
        yield some, np.array(rows), np.array(begins)


def pieces(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """All runs of windows of docs (id, text) as rows of anchors.ROW."""

    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for row, _, texts in chunks(batch, 1, 4_000_000):
                found = []
                for some, rows, begins in blocks(texts, window):
                    joined = b"".join(some)
                    sizes = np.array([len(t) for t in some], np.int64)
                    ends = np.cumsum(sizes)
                    text, start, n, hashes = anchors.runs(BYTES[np.frombuffer(joined, np.uint8)], ends, window, anchor)
                    content = digests(joined, start, n + window - 1).view(np.int64)
                    found.append((hashes, content, ids[row + rows[text]], start - (ends - sizes - begins)[text], n))
                yield _batch(anchors.packed(*map(np.concatenate, zip(*found, strict=True)), True), NAMES)

    return arrow_map(docs, run, anchors.ROW)


def _asked(batch):
    """(first row, texts, text of each run, start, windows, anchor) from batches (id, z, firsts, ns, anchors)."""
    for first, end, texts in unzipped(batch, 1, 2_000_000):
        lists = [batch.column(k).slice(first, end - first) for k in (2, 3, 4)]
        text = np.repeat(np.arange(end - first), lists[0].value_lengths().to_numpy(zero_copy_only=False))
        yield first, texts, text, *(x.flatten().to_numpy(zero_copy_only=False) for x in lists)


def cut(asked: DataFrame, window: int) -> DataFrame:
    """(anchor, doc, first, piece): the bytes of the runs that were asked for."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for row, texts, text, start, n, anchor in _asked(batch):
                found = [texts[t][a:b] for t, a, b in zip(text.tolist(), start.tolist(), (start + n + window - 1).tolist(), strict=True)]
                yield _batch((anchor, ids[row + text], start, pa.array(found, pa.binary())), ["anchor", "doc", "first", "piece"])

    return arrow_map(asked, run, "anchor long, doc long, first long, piece binary")


def recut(asked: DataFrame, window: int, anchor: int) -> DataFrame:
    """The windows of the runs that were asked for, dealt anew by longer anchors, as rows of anchors.ROW."""

    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for row, texts, text, start, n, _ in _asked(batch):
                joined = b"".join(texts[t][a:b] for t, a, b in zip(text.tolist(), start.tolist(), (start + n + window - 1).tolist(), strict=True))
                ends = np.cumsum(n.astype(np.int64) + window - 1)
                part, first, many, hashes = anchors.runs(BYTES[np.frombuffer(joined, np.uint8)], ends, window, anchor)
                content = digests(joined, first, many + window - 1).view(np.int64)
                at = start[part] + first - (ends - n - window + 1)[part]
                yield _batch(anchors.packed(hashes, content, ids[row + text[part]], at, many, True), NAMES)

    return arrow_map(asked, run, anchors.ROW)


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Of symbols from 0 to 256, by doubling."""
    n, h = len(s), 7
    padded = np.concatenate([s.astype(np.uint64) + np.uint64(1), np.zeros(h, np.uint64)])
    key = np.zeros(n, np.uint64)
    for k in range(h):
        key = (key << np.uint64(9)) | padded[k : k + n]
    while True:
        order = np.argsort(key)
        sorted_key = key[order]
        rank = np.empty(n, np.uint64)
        rank[order] = np.cumsum(np.concatenate([[True], sorted_key[1:] != sorted_key[:-1]])).astype(np.uint64)
        if int(rank[order[-1]]) == n or h >= n:
            return order
        after = np.zeros(n, np.uint64)
        after[: n - h] = rank[h:]
        key = (rank << np.uint64(32)) | after
        h *= 2


def match_lengths(s: np.ndarray, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """How far the suffixes at a and at b agree, up to ``most``."""
    padded = np.concatenate([s, np.full(8, 999, s.dtype)])
    n, length = len(s), np.zeros(len(a), np.int64)
    left = np.arange(len(a))
    for k in range(most):
        x, y = a[left] + k, b[left] + k
        inside = (x < n) & (y < n)
        same = inside & (padded[np.minimum(x, n)] == padded[np.minimum(y, n)])
        left = left[same]
        if not len(left):
            break
        length[left] += 1
    return length


class RunLengthIndex:
    """The run-compressed transform of a text of symbols, with samples at the starts of its runs."""

    def __init__(self, s: np.ndarray, most: int):
        order = suffix_array(s)
        transform = s[order - 1]  # the first suffix has the last symbol before it
        starts = np.concatenate([[0], np.nonzero(transform[1:] != transform[:-1])[0] + 1])
        self.n, self.heads, self.lengths = len(s), transform[starts], np.diff(np.append(starts, len(s)))
        # The first suffix has none before it in the text: its rank starts anew, and so does the next
        rank = int(np.flatnonzero(order == 0)[0])
        starts = np.union1d(starts, [r for r in (rank, rank + 1) if r < len(s)])
        at, before = order[starts], order[starts - 1]
        length = match_lengths(s, at, before, most)
        length[starts == 0] = 0
        by = np.argsort(at)
        self.at, self.before, self.length = at[by], before[by], length[by]

    def matching_statistics(self, positions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For text positions: the position of the suffix before theirs, and how long the two agree."""
        k = np.searchsorted(self.at, positions, side="right") - 1
        on = positions - self.at[k]
        return self.before[k] + on, np.maximum(self.length[k] - on, 0)


def later_places(pieces: list[bytes], window: int) -> np.ndarray:
    """For pieces in order: text positions (a separator follows each piece) of windows that also start before."""
    sizes = np.array([len(p) for p in pieces], np.int64)
    s = np.frombuffer(b"".join(p + b"\0" for p in pieces), np.uint8).astype(np.int16) + 1
    ends = np.cumsum(sizes + 1) - 1
    s[ends] = 0
    index = RunLengthIndex(s, 4 * int(sizes.max()) + 8)
    many = sizes - window + 1
    where = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(ends - sizes, many)
    before, length = index.matching_statistics(where)
    tied = length >= window
    root = np.arange(len(s))
    root[where[tied]] = before[tied]
    members = where[tied]
    while len(members):  # each to the first suffix of its string, in steps that double
        then = root[root[members]]
        if (then == root[members]).all():
            break
        root[members] = then
    first = np.arange(len(s))
    np.minimum.at(first, root[where], where)
    return where[first[root[where]] < where]


def marked(cuts: DataFrame, window: int) -> DataFrame:
    """(doc, first, n): windows that also start earlier, from rows (anchor, doc, first, piece)."""
    dealt = cuts.repartition("anchor").sortWithinPartitions("anchor", "doc", "first")

    def resolve(rows):
        rows.sort(key=lambda r: (r[1], r[2]))
        doc, first, found = [], [], [r[3] for r in rows]
        sizes = np.array([len(p) for p in found], np.int64)
        begin = np.cumsum(sizes + 1) - sizes - 1
        places = later_places(found, window)
        own = np.searchsorted(begin, places, side="right") - 1
        doc, first = np.array([r[1] for r in rows])[own], np.array([r[2] for r in rows])[own] + places - begin[own]
        new = np.ones(len(first), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (first[1:] != first[:-1] + 1)
        at = np.nonzero(new)[0]
        return _batch((doc[at], first[at], np.diff(np.append(at, len(first))).astype(np.int32)), ["doc", "first", "n"])

    def run(batches):
        held, size, last = [], 0, None
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and row[:3] == held[-1][:3]:  # a row of documents that was there twice
                    continue
                if row[0] != last and size >= INDEXED:
                    yield resolve(held)
                    held, size = [], 0
                last = row[0]
                held.append(row)
                size += len(row[3])
        if held:
            yield resolve(held)

    return arrow_map(dealt, run, "doc long, first long, n int")


def copied(docs: DataFrame, saved: Saved, window: int = WINDOW, anchor: int = ANCHOR, crowd: int = CROWD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, first, n): n windows from the byte ``first`` on that also start earlier."""
    plain = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    total = plain.count()
    columns, parts = ["doc", "first", "n"], []
    rows, length = pieces(plain, window, anchor), anchor
    hot = anchors.hot(pieces(anchors.sampled(plain, "_id", total), window, anchor), saved, f"hot{length}")
    while True:
        last = length == window  # different strings are left
        found = anchors.judged(rows, saved, f"runs{length}", True, None if last else hot, copies=last)
        parts.append(found.where("not open").select(columns))
        if last:
            break
        asked = found.where("open").select("doc", "first", "n", "anchor")
        crowds = saved.put(asked.groupBy("anchor").agg(F.count("*").alias("many")).where(F.col("many") > crowd), f"crowds{length}")
        few = crowds.count() <= BROADCAST
        asked = asked.join(F.broadcast(crowds) if few else crowds, "anchor", "left").select("doc", "first", "n", F.when(F.col("many").isNull(), F.col("anchor")).alias("anchor"))

        def part(crowded: bool, plain: DataFrame = plain, asked: DataFrame = asked) -> DataFrame:
            runs = asked.where(F.col("anchor").isNull() if crowded else F.col("anchor").isNotNull())
            lists = runs.groupBy("doc").agg(*(F.collect_list(c).alias(c) for c in ("first", "n")), F.collect_list(F.coalesce("anchor", F.lit(0))).alias("anchor"))  # of one document
            return zipped(plain, "_id", "_text").join(lists, F.col("_id") == F.col("doc")).select("_id", "_z", "first", "n", "anchor")

        parts.append(saved.put(marked(cut(part(False), window), window), f"marked{length}").select(columns))
        if crowds.isEmpty():
            break
        length = min(2 * length, window)
        rows = recut(part(True), window, length)
        if length < window:
            some = anchors.sampled(plain, "_id", total), anchors.sampled(asked, "doc", total)
            hot = anchors.hot(recut(part(True, *some), window, length), saved, f"hot{length}")
    return reduce(DataFrame.union, parts)


def dedup(docs: DataFrame, saved: Saved, window: int = WINDOW, anchor: int = ANCHOR, crowd: int = CROWD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row of docs: id, n_bytes, n_removed, n_spans, kept_sha256, and spans (start and end of what goes)."""
    removed = copied(docs, saved, window, anchor, crowd, id_col, text_col).groupBy("doc").agg(F.collect_list("first").alias("_firsts"), F.collect_list("n").alias("_ns"))
    joined = zipped(docs, id_col, text_col).join(removed, F.col("_id") == F.col("doc"), "left").select("_id", "_z", "_firsts", "_ns")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            rows = []
            for first, _, some in unzipped(batch, 1):
                for k, text in enumerate(some, first):
                    starts, ns = (batch.column(c)[k].values for c in (2, 3))
                    cuts, kept, last = [], hashlib.sha256(), 0
                    if starts is not None and len(starts):
                        cuts = list(zip(*(x.tolist() for x in spans(starts.to_numpy(), ns.to_numpy(), window)), strict=True))
                    for a, b in cuts:
                        kept.update(text[last:a])
                        last = b
                    kept.update(text[last:])
                    rows.append((len(text), sum(b - a for a, b in cuts), len(cuts), kept.hexdigest(), [{"start": a, "end": b} for a, b in cuts]))
            types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
            columns = [pa.array([r[c] for r in rows], t) for c, t in enumerate(types)]
            yield pa.record_batch([batch.column(0), *columns], names=[id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])

    return arrow_map(joined, run, f"`{id_col}` long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,end:long>>")
