"""Embedding near-dedup by sorted projection passes.

In each pass vectors are ordered by label and then by a string of random bits: the signs of projections on random
directions, one after the other. Vectors with a small angle agree in most signs, so that they often stand near each
other; each is compared, exactly, with the ``near`` vectors after it. Passes with other directions find what one pass
parts. Pairs of all passes are united, each batch's as ties to the first vector that they reach, and components are the
connected vectors. Windows are bounded, so a dense group
has more links than they show: the classes of each component are then all compared with each other, in blocks, and
n_links counts what is found there. Links that no pass finds and no component holds are missed; a pass finds fewer of
them in a longer order, so there are more passes where a label has very many classes.

Equal vectors of a label are one class from the start, linked to each other, so that a vector with very many copies is
compared once. The order is cut into ranges by rank, so that labels and bits may be as skewed as they like; the rows
beside each cut are compared in a second step.

Vectors that are null, zero, or hold null or non-finite components, and those without a label, link with nothing: they
are components of their own. Vectors of different lengths do not link. Repeated rows count as vectors of their own.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Saved, arrow_map, components

PASSES, NEAR, BITS = 16, 96, 48
TIES = 15  # bits of the vector's hash that follow the signs, so that the order does not hang on how rows were dealt
BLOCK = 1024  # classes of a component that are compared at a time
MANY, MORE = 4_000_000, 0.21  # beyond so many classes in a label passes grow as this power of them
ORDER = ["pass", "label", "dim", "bits", "class"]
SORTED = "pass int, label long, dim int, bits long, class long, vec binary"


def width(vectors: DataFrame, vec_col: str) -> type:
    return np.float32 if vectors.schema[vec_col].dataType.simpleString() == "array<float>" else np.float64


def plain(vectors: DataFrame, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    """(id, label, vec): vec holds the components as they are kept (4 or 8 bytes each), or is null for what links with
    nothing."""
    kind = width(vectors, vec_col)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            out = []
            for labelled, v in zip(batch.column(1).is_valid().to_pylist(), batch.column(2).to_pylist(), strict=True):
                x = np.array(v, np.float64) if labelled and v else np.zeros(0)  # None becomes NaN
                out.append((x + 0.0).astype(kind).tobytes() if x.any() and np.isfinite(x).all() else None)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(out, pa.binary())], names=["id", "label", "vec"])

    some = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vec_col).cast("array<double>").alias("vec"))
    return arrow_map(some, run, "id long, label long, vec binary")


def projected(classes: DataFrame, passes: int, seed: int, kind: type) -> DataFrame:
    """A row for each class and pass with its bits."""

    def run(batches):
        import pyarrow as pa
        from xxhash import xxh3_64_intdigest as digest

        directions: dict[int, np.ndarray] = {}
        weights = np.int64(1) << np.arange(BITS - 1, -1, -1)
        for batch in (b.slice(at, 1024) for b in batches for at in range(0, b.num_rows, 1024)):
            vecs = batch.column(2).to_pylist()
            dims = np.array([len(v) // np.dtype(kind).itemsize for v in vecs])
            for dim in np.unique(dims).tolist():
                if dim not in directions:
                    directions[dim] = np.random.default_rng([seed, dim]).normal(size=(dim, passes * BITS))
                at = np.nonzero(dims == dim)[0]
                signs = np.frombuffer(b"".join(vecs[k] for k in at), kind).reshape(-1, dim).astype(np.float64) @ directions[dim] > 0
                ties = np.fromiter((digest(vecs[k]) & (1 << TIES) - 1 for k in at), np.int64, len(at))
                bits = (signs.reshape(len(at), passes, BITS) @ weights << TIES) | ties[:, None]
                rows = batch.take(pa.array(at))
                for p in range(passes):
                    n = len(at)
                    yield pa.record_batch([pa.array(np.full(n, p, np.int32)), rows.column(1), pa.array(np.full(n, dim, np.int32)), pa.array(bits[:, p]), rows.column(0), rows.column(2)], names=[*ORDER, "vec"])

    return arrow_map(classes.select("class", "label", "vec"), run, SORTED)


def first_reached(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """Of n places, which pairs (i, j) tie, the smallest one that can be reached."""
    root = np.arange(n)
    while True:
        low, then = np.minimum(root[i], root[j]), root.copy()
        np.minimum.at(then, root[i], low)
        np.minimum.at(then, root[j], low)
        then = then[then]
        if (then == root).all():
            return root
        root = then


class Neighbours:
    """Takes rows in their order and gives pairs of classes at most ``near`` apart with a cosine that is high enough.
    With ``ties`` each class in such a pair is given just with the first one that the pairs tie it to among the rows at
    hand: the same components, but a row for each class, however dense its neighbourhood."""

    def __init__(self, near: int, least: float, kind: type, ties: bool):
        self.near, self.least, self.kind, self.ties = near, least, kind, ties
        self.group, self.classes, self.vecs = [np.zeros(0, np.int64)] * 3, np.zeros(0, np.int64), []

    def __call__(self, group: list[np.ndarray], classes: np.ndarray, vecs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        old = len(self.classes)
        group = [np.concatenate(x) for x in zip(self.group, group, strict=True)]
        classes, vecs = np.concatenate([self.classes, classes]), self.vecs + vecs
        a, b = [], []
        new = np.ones(len(classes), bool)
        new[1:] = np.any([x[1:] != x[:-1] for x in group], 0)
        edges = [*np.nonzero(new)[0].tolist(), len(classes)]
        for start, end in zip(edges[:-1], edges[1:], strict=True):
            x = np.frombuffer(b"".join(vecs[start:end]), self.kind).reshape(end - start, -1).astype(np.float64)
            norm = np.sqrt(np.einsum("ij,ij->i", x, x))
            for at in range(max(0, old - self.near - start), end - start, 512):
                to = min(at + 512 + self.near, end - start)
                cosine = (x[at : at + 512] @ x[at:to].T) / np.outer(norm[at : at + 512], norm[at:to])
                i, j = np.nonzero(cosine >= self.least)
                ok = (j > i) & (j - i <= self.near) & (at + start + j >= old)
                a.append(at + start + i[ok])
                b.append(at + start + j[ok])
        a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a, b))
        if self.ties:
            b = first_reached(a, b, len(classes))
            a = np.nonzero(b != np.arange(len(b)))[0]
            b = b[a]
        a, b = classes[a], classes[b]
        keep = max(0, len(classes) - self.near)
        self.group, self.classes, self.vecs = [x[keep:] for x in group], classes[keep:], vecs[keep:]
        return np.minimum(a, b), np.maximum(a, b)


def _pairs(a, b):
    import pyarrow as pa

    n = len(a)
    return [pa.array(a), pa.array(b), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())]


FOUND = "a long, b long, cut int, place int, pass int, label long, dim int, vec binary"


def compared(rows: DataFrame, near: int, least: float, kind: type, total: int | None = None, ties: bool = False) -> DataFrame:
    """FOUND: pairs (a, b) of each range of sorted rows; and the rows beside its cuts, with cut and place, in a. Ranges
    hold several times ``near`` rows each, so that no window reaches over a whole one; total is the count of rows."""
    total = rows.count() if total is None else total
    parts = max(1, min(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), total // (8 * near)))
    dealt = rows.repartitionByRange(parts, *ORDER).sortWithinPartitions(*ORDER)

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        here = TaskContext.get().partitionId()
        look, count = Neighbours(near, least, kind, ties), 0
        names = [x.split()[0] for x in FOUND.split(", ")]
        last = None

        def beside(part, cut, place):
            n = part.num_rows
            return pa.record_batch([part.column(4), pa.nulls(n, pa.int64()), pa.array(np.full(n, cut, np.int32)), pa.array((place + np.arange(n)).astype(np.int32)), part.column(0), part.column(1), part.column(2), part.column(5)], names=names)

        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1, 2, 4)]
            a, b = look([x.astype(np.int64) for x in columns[:3]], columns[3], batch.column(5).to_pylist())
            yield pa.record_batch(_pairs(a, b), names=names)
            if count < near:
                yield beside(batch.slice(0, near - count), here - 1, near + count)
            count += batch.num_rows
            last = batch if last is None or batch.num_rows >= near else pa.Table.from_batches([last.slice(max(0, last.num_rows - near)), batch]).combine_chunks().to_batches()[0]
        if last is not None:
            n = min(near, last.num_rows)
            yield beside(last.slice(last.num_rows - n), here, near - n)

    return arrow_map(dealt, run, FOUND)


def across(found: DataFrame, near: int, least: float, kind: type, ties: bool = False) -> DataFrame:
    """(a, b): pairs of rows on the two sides of a cut."""
    sides = found.where("cut >= 0").select("cut", "place", "pass", "label", "dim", "a", "vec").repartition("cut").sortWithinPartitions("cut", "place")

    def run(batches):
        import pyarrow as pa

        look = Neighbours(near, least, kind, ties)
        for batch in batches:
            columns = [batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 2, 3, 4)]
            a, b = look_in(look, columns, batch)
            yield pa.record_batch([pa.array(a), pa.array(b)], names=["a", "b"])

    def look_in(look, columns, batch):
        if len(look.group) == 3:
            look.group = [np.zeros(0, np.int64)] * 4
        return look(columns, batch.column(5).to_numpy(zero_copy_only=False), batch.column(6).to_pylist())

    return arrow_map(sides, run, "a long, b long")


def counted(classes: DataFrame, roots: DataFrame, least: float, kind: type, block: int = BLOCK) -> DataFrame:
    """(class, others): for each class of a component the vectors of other classes there with a cosine that is high
    enough. Rows are dealt to a block of their component by hash; each two blocks meet in one cell."""
    large = roots.groupBy("root").agg(F.count("*").alias("size")).where(F.col("size") > block)
    members = classes.join(roots, "class").join(F.broadcast(large), "root", "left")
    members = members.withColumn("g", F.coalesce(F.ceil(F.col("size") / block), F.lit(1))).withColumn("here", F.expr("pmod(xxhash64(class), g)"))
    members = members.select("root", "class", "m", "vec", "here", F.explode(F.expr("sequence(0L, g - 1)")).alias("there"))
    cells = members.select("root", F.least("here", "there").alias("i"), F.greatest("here", "there").alias("j"), (F.col("here") > F.col("there")).cast("int").alias("side"), "class", "m", "vec")
    cells = cells.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j", "side")

    def matrix(vecs):
        x = np.frombuffer(b"".join(vecs), kind).reshape(len(vecs), -1).astype(np.float64)
        return x, np.sqrt(np.einsum("ij,ij->i", x, x))

    def compare(parts):
        side, who, m = (np.concatenate([p.column(k).to_numpy(zero_copy_only=False) for p in parts]) for k in (3, 4, 5))
        vecs = [v for p in parts for v in p.column(6).to_pylist()]
        cut = int(np.searchsorted(side, 1))
        x, norm = matrix(vecs)
        m = m.astype(np.float64)
        if parts[0].column(1)[0] == parts[0].column(2)[0]:
            close = x @ x.T / np.outer(norm, norm) >= least
            np.fill_diagonal(close, False)
            return who, close.astype(np.float64) @ m
        close = (x[:cut] @ x[cut:].T / np.outer(norm[:cut], norm[cut:]) >= least).astype(np.float64)
        return who, np.concatenate([close @ m[cut:], m[:cut] @ close])

    def run(batches):
        import pyarrow as pa

        def rows(out):
            who, n = (np.concatenate(x) for x in zip(*out, strict=True))
            return pa.record_batch([pa.array(who), pa.array(np.rint(n).astype(np.int64))], names=["class", "others"])

        cell, parts, out, waiting = None, [], [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.column_stack([batch.column(k).to_numpy(zero_copy_only=False) for k in range(3)])
            edges = [0, *(np.nonzero((keys[1:] != keys[:-1]).any(1))[0] + 1).tolist(), len(keys)]
            for start, end in zip(edges[:-1], edges[1:], strict=True):
                if parts and cell != tuple(keys[start]):
                    out.append(compare(parts))
                    waiting += len(out[-1][0])
                    parts = []
                cell = tuple(keys[start])
                parts.append(batch.slice(start, end - start))
            if waiting >= 10_000:
                yield rows(out)
                out, waiting = [], 0
        if parts:
            yield rows([*out, compare(parts)])

    return arrow_map(cells, run, "class long, others long").groupBy("class").agg(F.sum("others").alias("others"))


def dedup(vectors: DataFrame, saved: Saved, least: float = 0.93, passes: int = PASSES, near: int = NEAR, seed: int = 11, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """For each row of vectors: id, n_links, component_id, kept."""
    kind = width(vectors, vec_col)
    rows = saved.put(plain(vectors, id_col, vec_col, label_col), "plain")
    classes = rows.where("vec is not null").groupBy("label", "vec").agg(F.min("id").alias("first"), F.count("*").alias("m"))
    classes = saved.put(classes.withColumn("class", F.monotonically_increasing_id()), "classes")
    most, total = (x or 0 for x in classes.groupBy("label").agg(F.count("*").alias("n")).agg(F.max("n"), F.sum("n")).first())
    passes = max(passes, int(np.ceil(passes * (most / MANY) ** MORE)))
    found = saved.put(compared(projected(classes, passes, seed, kind), near, least, kind, total * passes, True), "compared")
    pairs = saved.put(found.where("b is not null").select("a", "b").union(across(found, near, least, kind, True)).distinct(), "pairs")
    roots = saved.put(components(pairs, saved).withColumnRenamed("node", "class"), "roots")
    degree = counted(classes, roots, least, kind)
    tied = classes.join(roots, "class", "left").withColumn("root", F.coalesce("root", "class"))
    least_id = tied.groupBy("root").agg(F.min("first").alias("component_id"))
    known = tied.join(least_id, "root").join(degree, "class", "left").select(F.col("label").alias("_label"), F.col("vec").alias("_vec"), (F.col("m") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), "component_id")
    known = saved.put(known, "known")
    out = rows.join(known, (F.col("label") == F.col("_label")) & (F.col("vec") == F.col("_vec")), "left")
    component = F.when(F.col("_vec").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))
