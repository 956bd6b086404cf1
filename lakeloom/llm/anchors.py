"""Runs of windows that share an anchor.

All windows of n tokens of a text are dealt out to runs of neighbouring windows that have the same anchor: the k-token
string within the window whose hash is smallest, the leftmost of equals. Which anchor a window has depends on its tokens
alone, so that equal windows, wherever they stand, have equal anchors at equal offsets. Comparing runs by anchor
therefore compares all equal windows, at about 2 / (n - k + 2) rows for each token instead of one.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Saved

M = np.uint64(0x9E3779B97F4A7C15)


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    return h


def rolled(tokens: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k tokens in a row, built by doubling."""
    done, total, total_n, size = tokens, None, 0, 1  # done: of ``size`` tokens each
    while True:
        if k & size:
            if total is None:
                total = done
            else:  # total of total_n tokens, then size more
                total = total[: len(tokens) - total_n - size + 1] * _pow(size) + done[total_n : len(tokens) - size + 1]
            total_n += size
        size *= 2
        if size > k:
            return total
        half = size // 2
        after = done[half : len(tokens) - half + 1]
        done = done[: len(tokens) - size + 1] * _pow(half)
        done += after


def _pow(n: int) -> np.uint64:
    return np.uint64(pow(int(M), n, 1 << 64))


def slid(x: np.ndarray, w: int) -> np.ndarray:
    """The minimum of each w values in a row."""
    size = 1
    while 2 * size <= w:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    rest = w - size
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def runs(tokens: np.ndarray, ends: np.ndarray, n: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For texts that follow each other in ``tokens`` and end at ``ends``: of each run the text it is in, its first
    token (among all), its number of windows, and the hash of its anchor."""
    none = np.zeros(0, np.int64)
    if len(tokens) < n:
        return none, none, none, none.view(np.uint64)
    starts = np.concatenate([[0], ends[:-1]])
    lengths = ends - starts
    many = np.maximum(lengths - n + 1, 0)
    if not many.any():
        return none, none, none, none.view(np.uint64)
    hashes = mixed(rolled(tokens, k))
    bits = np.uint64(max(1, len(hashes)).bit_length())
    low = (np.uint64(1) << bits) - np.uint64(1)
    ordered = hashes & ~low
    ordered |= np.arange(len(hashes), dtype=np.uint64)
    at = slid(ordered, n - k + 1)  # of each window its anchor: the hash above, the place below
    first = np.union1d(np.flatnonzero(at[1:] != at[:-1]) + 1, starts[many > 0])
    text = np.searchsorted(starts, first, side="right") - 1  # of empty texts at one place the last
    stop = starts[text] + many[text]
    inside = first < stop
    first, text, stop = first[inside], text[inside], stop[inside]
    size = np.minimum(stop, np.append(first[1:], len(tokens))) - first
    return text, first, size, hashes[(at[first] & low).astype(np.int64)]


#: What a run is sent as. ``content`` tells runs with one anchor apart; ``at`` holds the first token, the number of
#: windows (below 256) and whether the run is already known to be a copy: then ``content`` is the source document, and
#: the low half of ``anchor`` is where in it the source starts.
ROW = "anchor long, content long, doc long, at long"


def packed(anchor: np.ndarray, content: np.ndarray, doc: np.ndarray, first: np.ndarray, n: np.ndarray, within: bool) -> tuple[np.ndarray, ...]:
    """Rows of one chunk of documents. Only a run's first occurrences in the chunk stand for it; later ones are copies
    for certain and go out marked, dealt by document, so that a run has a row for each chunk at most, however often
    it occurs. ``within``: later occurrences in the same document are copies as well."""
    order = np.lexsort((first, doc, content, anchor))
    anchor, content, doc, first, n = (x[order] for x in (anchor, content, doc, first, n))
    new = np.ones(len(anchor), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (content[1:] != content[:-1])
    head = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
    copy = doc > doc[head]
    if within:
        copy |= (doc == doc[head]) & (first > first[head])
    at = (first << 9) | (n << 1) | copy
    spread = mixed((doc * 31 + (first >> 12)).view(np.uint64)) & ~np.uint64(0xFFFFFFFF)
    return np.where(copy, spread.view(np.int64) | first[head], anchor.view(np.int64)), np.where(copy, doc[head], content), doc, at


#: Documents that are looked at for anchors that many runs share, about, and the different runs there that make one hot.
SAMPLED, MANY = 4_000, 16
#: Hot anchors that are dealt in parts, at most, and those parts. Others are dealt whole.
HOT, PARTS = 10_000, 1_024


def sampled(docs: DataFrame, id_col: str, total: int) -> DataFrame:
    """About SAMPLED of ``total`` documents, the same ones each time."""
    return docs.where(F.pmod(F.xxhash64(id_col), F.lit(max(1, total // SAMPLED))) == 0)


def hot(rows: DataFrame, saved: Saved, name: str) -> DataFrame:
    """(anchor, hot): anchors that MANY different runs share in rows of a sample; HOT of them at most, which may be
    broadcast. Like the bounds of a range exchange they decide where rows go and nothing else."""
    plain = rows.where(F.col("at").bitwiseAND(F.lit(1)) == 0)
    many = plain.groupBy("anchor").agg(F.approx_count_distinct("content").alias("many")).where(F.col("many") >= MANY)
    return saved.put(many.orderBy(F.desc("many"), "anchor").limit(HOT).select("anchor", F.lit(True).alias("hot")), name)


def judged(rows: DataFrame, saved: Saved, name: str, within: bool, hot: DataFrame | None = None, copies: bool = False) -> DataFrame:
    """(doc, first, n, src, src_first, open, anchor) from ROWs: runs that copy one that starts earlier, in the document
    ``src`` at ``src_first``; and with ``open`` (these have their anchor) first occurrences of runs whose anchor other runs have too, which may
    share some of their windows. ``copies``: only the former. Runs of ``hot`` anchors are dealt by content as well: such
    an anchor has several runs for certain, so that they need not meet."""
    known = F.col("at").bitwiseAND(F.lit(1)) == 1
    if hot is not None:
        rows = rows.join(F.broadcast(hot), "anchor", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
        rows = rows.withColumn("part", F.when(F.col("hot"), F.pmod("content", F.lit(PARTS)).cast("int")).otherwise(0))
        shared = ["anchor", "part"]
    else:
        rows, shared = rows.withColumn("hot", F.lit(False)), ["anchor"]
    same = W.partitionBy(*shared, "content").orderBy("doc", "at")
    found = rows.select("*", F.first("doc").over(same).alias("src"), F.first("at").over(same).alias("src_at"), F.rank().over(same).alias("k"))
    if not copies:
        group = W.partitionBy(*shared)
        found = found.select("*", (F.col("hot") | (F.min("content").over(group) != F.max("content").over(group))).alias("several"))
    copy = (F.col("k") > 1) if within else (F.col("doc") > F.col("src"))
    found = found.select(
        "doc",
        F.shiftrightunsigned("at", 9).alias("first"),
        F.shiftright("at", 1).bitwiseAND(F.lit(255)).cast("int").alias("n"),
        F.when(known, F.col("content")).otherwise(F.col("src")).alias("src"),
        F.when(known, F.col("anchor").bitwiseAND(F.lit(0xFFFFFFFF))).otherwise(F.shiftrightunsigned("src_at", 9)).alias("src_first"),
        (~known & ~copy).alias("open"), F.when(~known & ~copy, F.col("anchor")).alias("anchor"), (known | copy | (F.lit(False) if copies else F.col("several"))).alias("kept"),
    )
    return saved.put(found.where("kept").drop("kept"), name)
