"""Best-fit packing by matching large pieces.

Texts become pieces of at most ``capacity`` tokens. How they are packed depends on their lengths alone, and there are
at most ``capacity`` lengths: the driver plans on counts by length, not on pieces. A plan row says that so many bins
hold the same lengths. Large pieces (above a third of the capacity) come first, at most two to a bin: the largest that
is left is matched with the largest other one that still fits. Smaller pieces, from large to small, then go to the bins
whose gaps they fill best, new bins only where no gap is left. Whole runs of equal bins are filled at a time, so that
the plan has some thousand rows, whatever the number of pieces.

Pieces find their places by their rank among the pieces of their length. Ranks come from counts by length and hash
class, so that no task has to sort a length that a third of all pieces share.

Null and empty texts have the end token alone. Repeated rows are pieces of their own. An empty table packs to nothing.
"""

from __future__ import annotations

import os
import re
import struct
from bisect import bisect_left, insort
from functools import lru_cache
from zlib import crc32

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Saved, arrow_map, chunks

CAPACITY = 4096
#: Distinct words, and units of words, whose ids a worker remembers: so many new ones and as many from before.
MEMORY = 300_000
#: Letters (ASCII and of Latin-1) and then signs, without an apostrophe: two units of the tokenizer that no rule joins.
SIMPLE = re.compile(rb"((?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+)([!-&(-/:-@\[-`{-~]*)").fullmatch


class Encoder(dict):
    """By word, between ASCII white space that no token crosses: its token ids as little-endian bytes."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.older: dict[bytes, bytes] = {}
        self.units: dict[bytes, bytes] = {}
        self.older_units: dict[bytes, bytes] = {}
        #: How the tokenizer writes bytes: printable ones as themselves, the others as characters from 256 on
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [k for k in range(256) if k not in plain]
        self.shown = {k: chr(k) for k in plain} | {k: chr(256 + n) for n, k in enumerate(others)}
        probes = (b"Word", "\u00c9t\u00e9s,".encode(), b"plain!!", b"O.")
        self.direct = all(self._simple(SIMPLE(p)) == self._whole(p) for p in probes)  # else the tokenizer is of another kind

    def _whole(self, word: bytes) -> bytes:
        ids = self.tokenizer.encode(word.decode("utf-8", "replace"), add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def _unit(self, unit: bytes) -> bytes:
        found = self.units.get(unit)
        if found is None:
            found = self.older_units.get(unit)
            if found is None:
                ids = [t.id for t in self.tokenizer.model.tokenize(unit.decode("latin-1").translate(self.shown))]
                found = struct.pack(f"<{len(ids)}I", *ids)
            if len(self.units) >= MEMORY:
                self.older_units, self.units = self.units, {}
            if len(unit) < 100:
                self.units[unit] = found
        return found

    def _simple(self, match: re.Match) -> bytes:
        letters = match[1].lower()
        if not letters.isascii():
            letters = letters.decode().lower().encode()
        return self._unit(letters) + (self._unit(match[2]) if match[2] else b"")

    def __missing__(self, word: bytes) -> bytes:
        found = self.older.get(word)
        if found is None:
            match = self.direct and SIMPLE(word)
            found = self._simple(match) if match else self._whole(word)
        if len(self) >= MEMORY:
            self.older = dict(self)
            self.clear()
        if len(word) < 100:
            self[word] = found
        return found

    def text(self, text: bytes) -> bytes:
        return b"".join(map(self.__getitem__, text.split()))


@lru_cache(1)
def encoder(path: str) -> Encoder:
    """One for each worker, whose memory outlives its tasks."""
    return Encoder(path)


def pieces(docs: DataFrame, path: str, end: int = 1, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, piece, start, length, ids_crc32) of each row of docs."""

    def run(batches):
        import pyarrow as pa

        encode = encoder(path).text
        last = np.array([end], "<u4").tobytes()
        for batch in batches:
            for first, _, texts in chunks(batch, 1, 4_000_000):
                who, piece, start, length, crc = [], [], [], [], []
                for k, text in enumerate(texts):
                    ids = encode(text) + last
                    for n, at in enumerate(range(0, len(ids), 4 * capacity)):
                        part = ids[at : at + 4 * capacity]
                        who.append(first + k)
                        piece.append(n)
                        start.append(at // 4)
                        length.append(len(part) // 4)
                        crc.append(crc32(part))
                ids = batch.column(0).take(pa.array(who, pa.int64()))
                yield pa.record_batch([ids, pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], names=[id_col, "piece", "start", "length", "ids_crc32"])

    plain = docs.select(F.col(id_col).cast("long").alias(id_col), text_col)
    return arrow_map(plain, run, f"`{id_col}` long, piece int, start long, length long, ids_crc32 long")


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, pieces, first bin, pieces in each bin, offset in the bin) from the number of pieces by length.

    A row puts ``pieces`` pieces of a length, from a rank on, into as many bins as it takes at so many in each.
    """
    left = {k: n for k, n in counts.items() if n > 0}
    used: dict[int, int] = dict.fromkeys(left, 0)  # ranks given away
    rows: list[tuple[int, int, int, int, int, int]] = []
    gaps: list[int] = []  # sorted sizes of gaps
    runs: dict[int, list[tuple[int, int]]] = {}  # by gap: (first bin, bins)
    bins = 0

    def put(length: int, n: int, first: int, each: int, offset: int) -> None:
        rows.append((length, used[length], n, first, each, offset))
        used[length] += n
        left[length] -= n
        if not left[length]:
            del left[length]

    def open_gap(gap: int, first: int, n: int) -> None:
        if gap > 0 and n > 0:
            if gap not in runs:
                insort(gaps, gap)
                runs[gap] = []
            runs[gap].append((first, n))

    large = sorted(k for k in left if 3 * k > capacity)
    while large:
        top = large[-1]
        if top not in left:
            large.pop()
            continue
        k = bisect_left(large, capacity - top + 1) - 1
        while k >= 0 and large[k] not in left:
            large.pop(k)
            k -= 1
        mate = large[k] if k >= 0 else 0
        n = left[top]
        if mate == top:
            n //= 2
        elif mate:
            n = min(n, left[mate])
        if mate and not n:  # one of this length is left, and it has no equal: look below
            below = [x for x in large[:k] if x in left]
            mate = below[-1] if below else 0
            n = 1
        put(top, n, bins, 1, 0)
        if mate:
            put(mate, n, bins, 1, top)
        open_gap(capacity - top - mate, bins, n)
        bins += n
    for length in sorted(left, reverse=True):
        while length in left:
            at = bisect_left(gaps, length)
            if at == len(gaps):  # no gap: new bins, full of this length
                each = capacity // length
                full, rest = divmod(left[length], each)
                if full:
                    put(length, full * each, bins, each, 0)
                    open_gap(capacity - each * length, bins, full)
                    bins += full
                if rest:
                    put(length, rest, bins, rest, 0)
                    open_gap(capacity - rest * length, bins, 1)
                    bins += 1
                continue
            gap = gaps[at]
            first, n = runs[gap].pop()
            if not runs[gap]:
                del runs[gap]
                gaps.pop(at)
            each = min(gap // length, left[length])
            take = min(n, left[length] // each)
            put(length, take * each, first, each, capacity - gap)
            open_gap(gap - each * length, first, take)
            open_gap(gap, first + take, n - take)
    return rows


def pack(found: DataFrame, saved: Saved, capacity: int = CAPACITY, id_col: str = "doc_id", a_class: int = 250_000) -> DataFrame:
    """Adds sequence_id and offset to rows (id, piece, start, length, ids_crc32), which must be saved already.

    ``a_class``: pieces of one length that a task ranks, about.
    """
    spark = found.sparkSession
    counts = {r["length"]: r["n"] for r in found.groupBy("length").agg(F.count("*").alias("n")).collect()}  # capacity rows at most
    rows = plan(counts, capacity)
    schema = "length long, from long, pieces long, bin long, each long, at long"
    places = saved.put(spark.createDataFrame(rows, schema), "plan")
    classes = max(8, max(counts.values(), default=0) // a_class)
    salted = found.withColumn("_class", F.pmod(F.xxhash64(id_col, "piece"), F.lit(classes)))
    sums = salted.groupBy("length", "_class").agg(F.count("*").alias("n"))
    before = W.partitionBy("length").orderBy("_class").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select("length", "_class", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    # Rows that are equal in all these are equal, whichever comes first
    own = F.row_number().over(W.partitionBy("length", "_class").orderBy(id_col, "piece", "start", "ids_crc32")) - 1
    ranked = salted.withColumn("_own", own).join(sums, ["length", "_class"]).withColumn("_rank", F.col("_own") + F.col("_before"))
    # A length's plan rows follow each other by rank: the one that holds a rank starts last before it
    by_length = places.groupBy("length").agg(F.array_sort(F.collect_list(F.struct("from", "pieces", "bin", "each", "at"))).alias("_runs"))
    joined = ranked.join(by_length, "length")
    run = F.filter("_runs", lambda x: (x["from"] <= F.col("_rank")) & (F.col("_rank") < x["from"] + x["pieces"]))[0]
    joined = joined.withColumn("_run", run).withColumn("_k", F.col("_rank") - F.col("_run.from"))
    k, each = F.col("_k"), F.col("_run.each")
    return joined.select(
        id_col, "piece", "start", "length", "ids_crc32",
        (F.col("_run.bin") + F.floor(k / each)).cast("long").alias("sequence_id"),
        (F.col("_run.at") + F.pmod(k, each) * F.col("length")).cast("long").alias("offset"),
    )


def pack_documents(docs: DataFrame, saved: Saved, path: str, end: int = 1, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return pack(saved.put(pieces(docs, path, end, capacity, id_col, text_col), "pieces"), saved, capacity, id_col)
