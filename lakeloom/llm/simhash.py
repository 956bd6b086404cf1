"""SimHash near-duplicates by Golay-code fuzzy hashing.

A fingerprint of 64 bits is cut into three segments of 22, 21 and 21 bits. Two fingerprints that differ in at most two
bits have, by the pigeonhole principle, a pair of segments of which one is equal and the other differs in at most one
bit. The perfect binary Golay code (23, 12, 7) maps a segment to the index of the one codeword within three bits. If two
segments x and y differ in at most one bit, the codeword of y is within four bits of x. So one side of the join has the
codeword of its segment and the other side all codewords within four bits (one or six); the equal segment completes
the key. Pairs that meet are verified bit by bit.

Texts with equal fingerprints are one class from the start. A fingerprint has at most 64 + 2,016 others within two bits,
so that the links that a join leaves grow with the number of fingerprints, however dense they lie. What a key's members
are compared with is split: fingerprints of a key are dealt to blocks of about ``block`` by hash, and those that look
for them go to each block.

``similar`` links texts by the Jaccard similarity of their sets of five-word shingles, from 0.8 on. At 0.8 fingerprints
differ in some 10 bits of 64, too far for keys of segments (two Golay segments of a longer fingerprint agree for 1.3 % of
such pairs), so that min-wise keys of the shingles that fingerprints are made of join the Golay keys: 16 keys of five
minima each, which a pair at 0.8 shares with a chance of 0.998. Every pair that meets is verified by the sets themselves.
Texts with equal sets are one class. Each key's classes are compared with its smallest one first; where a key still
holds several components, what is outside its largest one is compared with all of it, in blocks, so that no link between
classes that share a key is lost and pairs are never listed.

Null texts are empty: their fingerprint is zero, their set empty (empty sets are one class). Texts of fewer words than
a shingle has are one shingle. Texts of any length count as a whole. Null ids never represent a component unless all its
ids are null. Repeated rows each give a row; empty tables give none; other columns of the input are not looked at.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .anchors import M, mixed, rolled
from .common import Saved, arrow_map, chunks, components
from .substring_dedup import Words

SEGMENTS = ((0, 22), (22, 21), (43, 21))
FAMILIES = tuple((i, j) for i in range(3) for j in range(3) if i != j)  # equal segment, coded segment


def fingerprint(text: bytes, n: int = 3) -> int:
    """A bit is set if it is in over half of the hashes of the n-word shingles."""
    from xxhash import xxh64_intdigest as digest

    words = text.lower().split()  # of bytes: A-Z only, and cut at ASCII white space
    if not words:
        return 0
    if len(words) <= n:
        return digest(b" ".join(words), 42)
    shingles = map(b" ".join, zip(*(words[i:] for i in range(n)), strict=False))
    hashes = np.fromiter((digest(x, 42) for x in shingles), np.uint64, len(words) - n + 1)
    return majority(hashes)


def majority(hashes: np.ndarray) -> int:
    """The bits that over half of the hashes have."""
    ones = np.zeros(64, np.int64)
    for part in range(0, len(hashes), 1 << 15):  # 64 bytes for each hash
        some = hashes[part : part + (1 << 15)].view(np.uint8)
        ones += np.unpackbits(some.reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 3) -> DataFrame:
    """(id, fp) for each row; fp is the fingerprint as a signed long."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            got = [fingerprint(t, n) for _, _, texts in chunks(batch, 1) for t in texts]
            yield pa.record_batch([batch.column(0), pa.array(np.array(got, np.uint64).view(np.int64))], names=["id", "fp"])

    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return arrow_map(plain, run, "id long, fp long")


@lru_cache(1)
def golay() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """By syndrome: the error of at most three bits; the errors of four bits (zero where there are none); and the
    syndromes of the lower 12 and upper 11 bits of a word."""
    generator = 0xC75
    syndromes = []
    for k in range(23):
        x = 1 << k
        for top in range(22, 10, -1):
            if x >> top & 1:
                x ^= generator << (top - 11)
        syndromes.append(x)
    near, four = np.zeros(2048, np.int64), [[] for _ in range(2048)]
    for weight in range(1, 5):
        for bits in combinations(range(23), weight):
            error = syndrome = 0
            for k in bits:
                error |= 1 << k
                syndrome ^= syndromes[k]
            if weight < 4:
                near[syndrome] = error
            else:
                four[syndrome].append(error)
    most = max(map(len, four))
    fours = np.array([x + [0] * (most - len(x)) for x in four], np.int64)
    table = lambda first, n: np.array([np.bitwise_xor.reduce([syndromes[first + k] for k in range(n) if v >> k & 1] or [0]) for v in range(1 << n)], np.int64)
    return near, fours, table(0, 12), table(12, 11)


def codewords(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The index of the codeword within three bits of each word, and of those at four bits (-1 where there are none)."""
    near, fours, low, high = golay()
    syndrome = low[x & 4095] ^ high[x >> 12]
    four = fours[syndrome]
    return (x ^ near[syndrome]) >> 11, np.where(four > 0, (x[:, None] ^ four) >> 11, -1)


def keyed(fps: DataFrame, all_near: bool) -> DataFrame:
    """(key, fp): for each family the key of the equal segment and the codeword, or all codewords within four bits."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False)
            bits = fp.view(np.uint64)
            parts = [((bits >> np.uint64(a)) & np.uint64((1 << n) - 1)).astype(np.int64) for a, n in SEGMENTS]
            for f, (i, j) in enumerate(FAMILIES):
                first, four = codewords(parts[j])
                index = np.column_stack([first, four]) if all_near else first[:, None]
                key = (np.int64(f) << 40) | (parts[i][:, None] << 12) | index
                who = np.broadcast_to(fp[:, None], index.shape)[index >= 0]
                yield pa.record_batch([pa.array(key[index >= 0]), pa.array(who)], names=["key", "fp"])

    return arrow_map(fps.select("fp"), run, "key long, fp long")


def linked(fps: DataFrame, saved: Saved, block: int = 1024) -> DataFrame:
    """(a, b): distinct fingerprints within two bits of each other. ``block``: those of a key that one task looks in, about."""
    few, many = keyed(fps, False), keyed(fps, True)
    large = few.groupBy("key").agg(F.ceil(F.count("*") / block).alias("g")).where("g > 1")
    large = saved.put(large, "large")  # 6 / block rows for each fingerprint at most, as a rule none
    here = few.join(large, "key", "left").select("key", F.col("fp").alias("b"), F.pmod(F.xxhash64("fp"), F.coalesce("g", F.lit(1))).alias("part"))
    look = many.join(large, "key", "left").select("key", F.col("fp").alias("a"), F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("g", F.lit(1)) - 1)).alias("part"))
    met = look.join(here, ["key", "part"]).where(F.col("a") < F.col("b")).where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2)
    return met.select("a", "b").distinct()


def groups(docs: DataFrame, saved: Saved, id_col: str = "doc_id", text_col: str = "text", n: int = 3) -> DataFrame:
    """(id, fp, component_id) for each row of docs."""
    each = saved.put(fingerprints(docs, id_col, text_col, n), "fingerprints")
    distinct = saved.put(each.groupBy("fp").agg(F.min("id").alias("first")), "distinct")
    roots = saved.put(components(linked(distinct, saved), saved).withColumnRenamed("node", "fp"), "roots")
    tied = distinct.join(roots, "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = tied.groupBy("root").agg(F.min("first").alias("component_id"))
    return each.join(tied.join(least, "root").select("fp", "component_id"), "fp").select(F.col("id").alias(id_col), "fp", "component_id")


def as_hex(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


#: Min-wise keys of a text, and minima in each.
KEYS, MINIMA = 16, 5


def shingle_sets(texts: list[bytes], n: int) -> list[np.ndarray]:
    """Of each text the sorted hashes of its n-word shingles, each once; fewer words are one shingle."""
    words = Words([t.lower() for t in texts])
    starts = words.ends - np.diff(words.ends, prepend=0)
    whole = mixed(rolled(words.hashes, n)) if len(words.hashes) >= n else np.zeros(0, np.uint64)
    out = []
    for a, b in zip(starts.tolist(), words.ends.tolist(), strict=True):
        short = mixed(rolled(words.hashes[a:b], b - a)) ^ np.uint64(b - a) if 0 < b - a < n else whole[a : max(a, b - n + 1)]
        out.append(np.unique(short))
    return out


def minwise(sets: list[np.ndarray], keys: int, minima: int) -> np.ndarray:
    """A row of keys for each set that is not empty."""
    joined = np.concatenate(sets)
    starts = np.cumsum([0] + [len(s) for s in sets[:-1]])
    odd = mixed(np.arange(1, keys * minima + 1, dtype=np.uint64) * M) | np.uint64(1)
    found = np.zeros((len(sets), keys), np.uint64)
    for k in range(keys * minima):
        found[:, k // minima] = mixed(found[:, k // minima] * M + np.minimum.reduceat(joined * odd[k], starts) + np.uint64(k))
    return found


SKETCH = "id long, t1 long, t2 long, s1 long, s2 long, fp long, keys array<long>"


def sketched(docs: DataFrame, id_col: str, text_col: str, n: int) -> DataFrame:
    """SKETCH of each row: digests of the text and of its set, the set's fingerprint and its min-wise keys."""

    def run(batches):
        import pyarrow as pa
        from xxhash import xxh3_128_digest as digest

        for batch in batches:
            for row, end, texts in chunks(batch, 1, 3_000_000):
                sets = shingle_sets(texts, n)
                there = np.array([k for k, s in enumerate(sets) if len(s)], np.int64)
                keys = minwise([sets[k] for k in there], KEYS, MINIMA) if len(there) else np.zeros((0, KEYS), np.uint64)
                sizes = np.zeros(len(sets), np.int64)
                sizes[there] = KEYS
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(keys.view(np.int64).ravel()))
                halves = np.frombuffer(b"".join(digest(s.tobytes()) for s in sets), np.int64).reshape(-1, 2)
                fps = np.array([majority(s) for s in sets], np.uint64).view(np.int64)
                part = batch.slice(row, end - row)
                yield pa.record_batch([part.column(0), part.column(2), part.column(3), pa.array(halves[:, 0]), pa.array(halves[:, 1]), pa.array(fps), lists], names=[x.split()[0] for x in SKETCH.split(", ")])

    return arrow_map(_texts(docs, id_col, text_col), run, SKETCH)


def text_digests(text: Column) -> tuple[Column, Column]:
    return F.xxhash64(text).alias("t1"), F.xxhash64(text, F.lit(1)).alias("t2")


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), *text_digests(F.col(text_col)))


def sets_of(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str, n: int) -> DataFrame:
    """(class, shingles) from the text that represents each class of wanted (class, id, t1, t2)."""
    who = wanted.select("class", F.col("id").alias("_id"), F.col("t1").alias("_t1"), F.col("t2").alias("_t2"))
    found = _texts(docs, id_col, text_col).join(who, F.col("id").eqNullSafe(F.col("_id")) & (F.col("t1") == F.col("_t1")) & (F.col("t2") == F.col("_t2")))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for row, end, texts in chunks(batch, 1, 3_000_000):
                sets = shingle_sets(texts, n)
                offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
                yield pa.record_batch([batch.column(0).slice(row, end - row), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(sets).view(np.int64)))], names=["class", "shingles"])

    return arrow_map(found.select("class", "text"), run, "class long, shingles array<long>").dropDuplicates(["class"])


def alike(both: Column, a: Column, b: Column, least: tuple[int, int]) -> Column:
    """Whether ``both`` of a and b shingles are a share of all that reaches least (a fraction)."""
    return both * least[1] >= (a + b - both) * least[0]


def across(members: DataFrame, sets: DataFrame, least: tuple[int, int], block: int) -> DataFrame:
    """(a, b): components that have a link between classes of one key, from members (key, class, comp). What is outside a key's largest component is compared with all of the key, in cells of two
    blocks."""
    sizes = members.groupBy("key", "comp").agg(F.count("*").alias("n"))
    sizes = sizes.groupBy("key").agg(F.max(F.struct("n", "comp")).alias("top"), F.sum("n").alias("n"))
    rows = members.join(sizes, "key").select("key", "class", "comp", (F.col("comp") != F.col("top.comp")).alias("few"), F.ceil(F.col("n") / block).alias("g"), F.ceil((F.col("n") - F.col("top.n")) / block).alias("h"))
    here = lambda c: F.pmod(F.xxhash64("class"), c)
    upto = lambda c: F.sequence(F.lit(0).cast("long"), c - 1)
    asked = rows.where("few").select("key", here(F.col("h")).alias("i"), F.explode(upto(F.col("g"))).alias("j"), F.lit(0).alias("side"), "class", "comp")
    asked = asked.union(rows.select("key", F.explode(upto(F.col("h"))).alias("i"), here(F.col("g")).alias("j"), F.lit(1).alias("side"), "class", "comp"))
    cells = asked.join(sets, "class").select("key", "i", "j", "side", "comp", "shingles").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "side")

    def compare(parts):
        side, comp = (np.concatenate([p.column(k).to_numpy(zero_copy_only=False) for p in parts]) for k in (3, 4))
        cut = int(np.searchsorted(side, 1))
        if not cut or cut == len(side):
            return [], []
        sizes = np.concatenate([p.column(5).value_lengths().to_numpy(zero_copy_only=False) for p in parts]).astype(np.int64)
        flat = np.concatenate([p.column(5).flatten().to_numpy(zero_copy_only=False) for p in parts])
        _, column, often = np.unique(flat, return_inverse=True, return_counts=True)
        row = np.repeat(np.arange(len(side)), sizes)
        shared = often[column] > 1
        row, column = row[shared], np.cumsum(often > 1)[column[shared]] - 1
        both, order = np.zeros((cut, len(side) - cut), np.float32), np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        for at in range(0, int((often > 1).sum()), 4096):
            a, b = np.searchsorted(column, (at, at + 4096))
            x = np.zeros((len(side), 4096), np.float32)
            x[row[a:b], column[a:b] - at] = 1
            both += x[:cut] @ x[cut:].T
        both = both.astype(np.int64)
        i, j = np.nonzero((both * least[1] >= (sizes[:cut, None] + sizes[None, cut:] - both) * least[0]) & (comp[:cut, None] != comp[None, cut:]))
        found = np.unique(np.column_stack([comp[:cut][i], comp[cut:][j]]), axis=0)  # once for two components
        return found[:, 0], found[:, 1]

    def run(batches):
        import pyarrow as pa

        def rows(parts):
            a, b = compare(parts)
            return pa.record_batch([pa.array(np.asarray(a, np.int64)), pa.array(np.asarray(b, np.int64))], names=["a", "b"])

        cell, parts = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.column_stack([batch.column(k).to_numpy(zero_copy_only=False) for k in range(3)])
            edges = [0, *(np.nonzero((keys[1:] != keys[:-1]).any(1))[0] + 1).tolist(), len(keys)]
            for start, end in zip(edges[:-1], edges[1:], strict=True):
                if parts and cell != tuple(keys[start]):
                    yield rows(parts)
                    parts = []
                cell = tuple(keys[start])
                parts.append(batch.slice(start, end - start))
        if parts:
            yield rows(parts)

    return arrow_map(cells, run, "a long, b long").distinct()


def similar(docs: DataFrame, saved: Saved, id_col: str = "doc_id", text_col: str = "text", n: int = 5, least: tuple[int, int] = (4, 5), block: int = 512) -> DataFrame:
    """(id, t1, t2, component, first) for each row of docs: t1 and t2 are digests of the text, component is that of
    texts linked by a similarity of least[0] / least[1] or more, first whether a row with this id and text represents it:
    that of the smallest id, of those with one id the text with the smallest digests."""
    each = saved.put(sketched(docs, id_col, text_col, n), "sketches")
    rep = F.struct(F.col("id").isNull().alias("none"), "id", "t1", "t2")
    classes = each.groupBy("s1", "s2").agg(F.min(rep).alias("rep"), F.first("fp").alias("fp"), F.first("keys").alias("keys"))
    classes = saved.put(classes.select("s1", "s2", "rep", "fp", "keys", F.monotonically_increasing_id().alias("class")), "classes")
    golay = components(linked(classes.where(F.size("keys") > 0).select("fp").distinct(), saved), saved, "golay").withColumnRenamed("node", "fp")
    by_bits = classes.where(F.size("keys") > 0).join(golay, "fp", "left").select(F.xxhash64(F.lit("golay"), F.coalesce("root", "fp")).alias("key"), "class")
    keys = saved.put(classes.select(F.explode("keys").alias("key"), "class").union(by_bits), "keys")
    # Each key's classes meet its smallest one
    centres = keys.groupBy("key").agg(F.min("class").alias("centre"), F.count("*").alias("n")).where("n > 1")
    met = saved.put(keys.join(centres, "key").select("key", "class", "centre", "n"), "met")
    wanted = met.select("class").distinct().join(classes.select("class", "rep.*"), "class")
    sets = saved.put(sets_of(docs, wanted, id_col, text_col, n), "sets")
    pairs = met.where(F.col("class") != F.col("centre")).select("class", "centre").distinct()
    pairs = pairs.join(sets, "class").join(sets.select(F.col("class").alias("centre"), F.col("shingles").alias("others")), "centre")
    both = F.size(F.array_intersect("shingles", "others"))
    links = saved.put(pairs.where(alike(both, F.size("shingles"), F.size("others"), least)).select(F.col("class").alias("a"), F.col("centre").alias("b")), "links")
    stars = saved.put(components(links, saved, "stars").withColumnRenamed("node", "class"), "starred")
    # The rest of a key: its centre has been compared with all
    rest = met.where((F.col("n") > 2) & (F.col("class") != F.col("centre"))).join(stars, "class", "left").select("key", "class", F.coalesce("root", "class").alias("comp"))
    open_keys = rest.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high").select("key")
    more = across(saved.put(rest.join(open_keys, "key", "left_semi"), "rest"), sets, least, block)
    joined = saved.put(components(more, saved, "joined").select(F.col("node").alias("star"), "root"), "joined")
    tied = classes.join(stars.withColumnRenamed("root", "star"), "class", "left").withColumn("star", F.coalesce("star", "class"))
    tied = tied.join(joined, "star", "left").select("s1", "s2", "rep", F.coalesce("root", "star").alias("component"))
    first = tied.groupBy("component").agg(F.min("rep").alias("best"))
    tied = tied.join(first, "component").select("s1", "s2", "component", "best")
    out = each.join(tied, ["s1", "s2"]).select(F.col("id").alias(id_col), "t1", "t2", "component", (rep == F.col("best")).alias("first"))
    return out
