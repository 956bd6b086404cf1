"""Substring dedup by a de Bruijn graph that is compacted before it is built.

The edges of the graph are the k-token words (windows of 13 tokens), its nodes the overlaps of 12. A text is a walk.
Windows in a row that share an anchor form a piece of such a walk, and equal pieces are the same path wherever they
stand. A path whose anchor no other path has does not branch: nothing that is shared leaves or enters it. It stays
compact and is one row of the join on anchors. Where several paths have an anchor, the graph may branch within them:
their edges are taken one by one and joined by edge. Pieces of a document that follow each other in it and in the
document that has them first are one path; they are compacted along these coordinates to the longest repeated spans.
Each span's source coordinates then verify it: a digest of the words that stand there is joined to the span, and only
if the span has just these words are they removed.

Pieces are compared by 128 bits that come from all of their words, and first occurrences are by document id, so that
what is removed is what a comparison of all windows removes.

Null texts have no words. Rows with a null id are left as they are and are no source for others. Rows that repeat an id
must be equal rows; each gets a row of the result. Texts of fewer than 13 words lose nothing; texts of any length are
judged as a whole. An empty table gives no rows; other columns of the input, whatever their names, are not looked at
unless they are to be kept.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import anchors
from .common import Saved, arrow_map, chunks

WINDOW, ANCHOR = 13, 5


class Words:
    """The words of some texts, one after the other."""

    def __init__(self, texts: list[bytes], hashed: bool = True):
        split = [t.split() for t in texts]
        self.ends = np.cumsum([len(w) for w in split], dtype=np.int64)
        flat = [w for words in split for w in words]
        self.joined = b" ".join(flat)
        sizes = np.fromiter(map(len, flat), np.int64, len(flat))
        self.stops = np.cumsum(sizes + 1) - 1
        self.starts = self.stops - sizes
        self.hashes = _hashes(flat) if hashed else None

    def contents(self, first: np.ndarray, words: np.ndarray) -> np.ndarray:
        """64 bits of each span of words."""
        from xxhash import xxh3_64_intdigest as digest

        spans = zip(self.starts[first].tolist(), self.stops[first + words - 1].tolist(), strict=True)
        return np.fromiter((digest(self.joined[a:b]) for a, b in spans), np.uint64, len(first))


def _hashes(words: list[bytes]) -> np.ndarray:
    from xxhash import xxh3_64_intdigest as digest

    known = {w: digest(w) for w in set(words)}
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def _batch(columns, names):
    import pyarrow as pa

    return pa.record_batch([pa.array(c) for c in columns], names=names)


NAMES = ["anchor", "content", "doc", "at"]


def pieces(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """The pieces of all walks of docs (id, text), as rows of anchors.ROW."""

    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for first, _, texts in chunks(batch, 1, 3_000_000):
                words = Words(texts)
                text, start, n, hashes = anchors.runs(words.hashes, words.ends, window, anchor)
                content = words.contents(start, n + window - 1).view(np.int64)
                begin = words.ends - np.diff(words.ends, prepend=0)
                yield _batch(anchors.packed(hashes, content, ids[first + text], start - begin[text], n, False), NAMES)

    return arrow_map(docs, run, anchors.ROW)


def edges(asked: DataFrame, window: int = WINDOW) -> DataFrame:
    """The single edges of pieces (id, z, firsts, ns) as rows of anchors.ROW; z is the compressed text."""

    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for first, end, texts in unzipped(batch, 1, 3_000_000):
                words = Words(texts)
                begin = words.ends - np.diff(words.ends, prepend=0)
                wanted = [batch.column(k).slice(first, end - first) for k in (2, 3)]
                text = np.repeat(np.arange(end - first), wanted[0].value_lengths().to_numpy(zero_copy_only=False))
                starts, ns = (x.flatten().to_numpy(zero_copy_only=False) for x in wanted)
                text, at = np.repeat(text, ns), np.repeat(starts, ns) + np.arange(ns.sum()) - np.repeat(np.cumsum(ns) - ns, ns)
                found = words.contents(begin[text] + at, np.full(len(at), window))
                second = anchors.mixed(found ^ anchors.rolled(words.hashes, window)[begin[text] + at]) if len(at) else found
                yield _batch(anchors.packed(found, second.view(np.int64), ids[first + text], at, np.ones(len(at), np.int64), False), NAMES)

    return arrow_map(asked, run, anchors.ROW)


def zipped(docs: DataFrame, id_col: str, text_col: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """(_id, _z, keep): texts as they go through exchanges, compressed one by one; null stays null."""
    from pyspark.sql.types import BinaryType, LongType, StructField, StructType

    plain = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_z"), *keep)
    schema = StructType([StructField("_id", LongType()), StructField("_z", BinaryType()), *plain.schema.fields[2:]])

    def run(batches):
        import pyarrow as pa
        import zstandard

        press = zstandard.ZstdCompressor(level=3, write_content_size=True, write_checksum=False)
        for batch in batches:
            z = [None if x is None else press.compress(x) for x in batch.column(1).cast(pa.large_binary()).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(z, pa.binary()), *batch.columns[2:]], names=schema.names)

    return arrow_map(plain, run, schema)


def unzipped(batch, column: int, most: int = 8_000_000):
    """(first row, end row, texts) of parts of an Arrow batch of compressed texts."""
    import zstandard

    plain = zstandard.ZstdDecompressor()
    first, size, texts = 0, 0, []
    for k, z in enumerate(batch.column(column).to_pylist()):
        t = plain.decompress(z) if z else b""
        texts.append(t)
        size += len(t)
        if size >= most:
            yield first, k + 1, texts
            first, size, texts = k + 1, 0, []
    if texts:
        yield first, first + len(texts), texts


def copied(plain: DataFrame, saved: Saved, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """(doc, first, n, src, src_first) from docs (_id, _text): n windows from the word ``first`` on that start in the
    smaller document src already, from its word src_first on."""
    hot = anchors.hot(pieces(anchors.sampled(plain, "_id", plain.count()), window, anchor), saved, "hot")
    found = anchors.judged(pieces(plain, window, anchor), saved, "paths", False, hot)
    asked = found.where("open").groupBy("doc").agg(F.collect_list("first").alias("firsts"), F.collect_list("n").alias("ns"))  # of one document
    asked = zipped(plain, "_id", "_text").join(asked, F.col("_id") == F.col("doc")).select("_id", "_z", "firsts", "ns")
    single = anchors.judged(edges(asked, window), saved, "edges", False, copies=True)
    columns = ["doc", "first", "n", "src", "src_first"]
    return found.where("not open").select(columns).union(single.where("not open").select(columns))


def compacted(copies: DataFrame, saved: Saved) -> DataFrame:
    """(doc, first, n, src, src_first): pieces that go on in the document and in its source as one span."""
    path = W.partitionBy("doc", "src", "shift").orderBy("first")
    steps = copies.withColumn("shift", F.col("first") - F.col("src_first")).repartition("doc")
    steps = steps.withColumn("begins", F.coalesce((F.lag(F.col("first") + F.col("n")).over(path) != F.col("first")).cast("int"), F.lit(1)))
    steps = steps.withColumn("path", F.sum("begins").over(path.rowsBetween(W.unboundedPreceding, 0)))
    found = steps.groupBy("doc", "src", "shift", "path").agg(F.min("first").alias("first"), F.sum("n").cast("long").alias("n"))
    return saved.put(found.select("doc", "first", "n", "src", (F.col("first") - F.col("shift")).alias("src_first")), "spans")


def vouched(plain: DataFrame, found: DataFrame, window: int) -> DataFrame:
    """(src, src_first, n, digest): what stands at the source coordinates of spans, each place once."""
    places = found.select("src", "src_first", "n").distinct().groupBy("src").agg(F.collect_list("src_first").alias("firsts"), F.collect_list("n").alias("ns"))
    asked = zipped(plain, "_id", "_text").join(places, F.col("_id") == F.col("src")).select("_id", "_z", "firsts", "ns")

    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for row, end, texts in unzipped(batch, 1, 3_000_000):
                words = Words(texts, False)
                lists = [batch.column(k).slice(row, end - row) for k in (2, 3)]
                text = np.repeat(np.arange(end - row), lists[0].value_lengths().to_numpy(zero_copy_only=False))
                first, n = (x.flatten().to_numpy(zero_copy_only=False) for x in lists)
                begin = words.ends - np.diff(words.ends, prepend=0)
                inside = first + n + window - 1 <= np.diff(words.ends, prepend=0)[text]
                first, n, text = first[inside], n[inside], text[inside]
                yield _batch((ids[row + text], first, n, words.contents(begin[text] + first, n + window - 1).view(np.int64)), ["src", "src_first", "n", "digest"])

    return arrow_map(asked, run, "src long, src_first long, n long, digest long")


def verified(docs: DataFrame, saved: Saved, window: int = WINDOW, anchor: int = ANCHOR, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, first, n, src, src_first, digest): spans with the digest of the words that stand at their source."""
    plain = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    found = compacted(copied(plain, saved, window, anchor), saved)
    return found.join(vouched(plain, found, window), ["src", "src_first", "n"])


def repeated_spans(docs: DataFrame, saved: Saved, window: int = WINDOW, anchor: int = ANCHOR, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, start, words, source, source_start): spans of words that the document ``source`` has before."""
    found = verified(docs, saved, window, anchor, id_col, text_col)
    return found.select("doc", F.col("first").alias("start"), (F.col("n") + window - 1).alias("words"), F.col("src").alias("source"), F.col("src_first").alias("source_start"))


def spans(first: np.ndarray, n: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the longest runs of tokens that the windows cover."""
    order = np.argsort(first, kind="stable")
    begin, end = first[order], (first + n + window - 1)[order]
    end = np.maximum.accumulate(end)
    new = np.ones(len(begin), bool)
    new[1:] = begin[1:] > end[:-1]
    at = np.nonzero(new)[0]
    return begin[at], end[np.append(at[1:] - 1, len(end) - 1)] if len(at) else end


def dedup(docs: DataFrame, saved: Saved, window: int = WINDOW, anchor: int = ANCHOR, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), texts: bool = False) -> DataFrame:
    """For each row of docs: id, n_words, n_removed, kept_sha256, and ``keep``; with ``texts`` also kept_text: the text
    as it was where nothing is removed, else the kept words joined by single spaces."""
    from pyspark.sql.types import LongType, StringType, StructField, StructType

    removed = verified(docs, saved, window, anchor, id_col, text_col).groupBy("doc").agg(F.collect_list(F.struct("first", "n", "digest")).alias("_spans"))  # of one document
    joined = zipped(docs, id_col, text_col, keep).join(removed, F.col("_id") == F.col("doc"), "left").select("_id", "_z", "_spans", *keep)
    own = [StructField(id_col, LongType()), StructField("n_words", LongType()), StructField("n_removed", LongType()), StructField("kept_sha256", StringType())]
    schema = StructType([*own, *([StructField("kept_text", StringType())] if texts else []), *joined.schema.fields[3:]])

    def run(batches):
        import pyarrow as pa
        from xxhash import xxh3_64_intdigest as digest

        for batch in batches:
            total, gone, sha, kept_texts = [], [], [], []
            for first, _, some in unzipped(batch, 1):
                for k, text in enumerate(some, first):
                    words = text.split()
                    total.append(len(words))
                    cut, there = 0, batch.column(2)[k].values
                    if there is not None and len(there):
                        starts, ns, own = (there.field(c).to_numpy() for c in range(3))
                        words_in = zip(starts.tolist(), (starts + ns + window - 1).tolist(), own.view(np.uint64).tolist(), strict=True)
                        same = np.array([digest(b" ".join(words[a:b])) == d for a, b, d in words_in])
                        kept, last = [], 0
                        for a, b in zip(*(x.tolist() for x in spans(starts[same], ns[same], window)), strict=True):
                            kept += words[last:a]
                            cut += b - a
                            last = b
                        words = kept + words[last:]
                    gone.append(cut)
                    joined = b" ".join(words)
                    sha.append(hashlib.sha256(joined).hexdigest())
                    if texts:
                        kept_texts.append(None if not batch.column(1)[k].is_valid else (joined if cut else text).decode())
            columns = [batch.column(0), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string())]
            columns += [pa.array(kept_texts, pa.string())] if texts else []
            yield pa.record_batch([*columns, *batch.columns[3:]], names=schema.names)

    return arrow_map(joined, run, schema)
