"""Toxicity: subword bags, averaged and classified.

A text is the bag of its words, repeats included, a word the bag of its character n-grams and itself, hashed to rows of an
embedding table. The rows of all grams are averaged and a linear softmax tells the class; both are trained jointly, with
numpy, on a bounded sample of labelled rows. A word that was never seen, a misspelling say, shares most of its grams
with those that were.

Since all is linear up to the softmax, a word's share of the logit is a number that workers remember by word.
The driver trains on the bags of the sample: 51 MB on the test tables, and not above 6 bytes for each row of the table
and text, 1.6 GB, if each of 8,000 texts had all grams.

Null and empty texts have no grams and get the score of the bias alone, which is capped below one half. Rows that repeat
each give a row; an id that labels repeat counts once, with its largest label, whichever of its rows it was given for.
Without labels the score is near 0. A text of any length counts as a whole; an empty table gives no rows. Other columns
of the input, whatever their names, are not looked at.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from itertools import chain
from zlib import crc32

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, chunks

BUCKETS, WIDTH, SHORTEST, LONGEST = 1 << 15, 8, 3, 5
#: Labelled rows to train on, at most: those whose ids have the smallest hashes.
SAMPLE = 8_000
#: Words that a worker remembers at most.
MEMORY = 600_000
EDGES = b".,;:!?\"'()[]{}*#%&$|<>-_"
#: What averages are multiplied by before the softmax, so that rare toxic words can show.
SCALE = 100.0

Bag = tuple[np.ndarray, np.ndarray]  # grams and how often each stands in the bag


def grams(word: bytes) -> list[int]:
    """The word and its n-grams, with its ends marked, as rows of the table."""
    w = b"<" + word + b">"
    found = [crc32(w) % BUCKETS]
    for n in range(SHORTEST, LONGEST + 1):
        found += [crc32(w[k : k + n]) % BUCKETS for k in range(len(w) - n + 1)]
    return found


def words_of(text: bytes) -> dict[bytes, int]:
    """The words without signs at their edges, and how often each is there."""
    found: dict[bytes, int] = {}
    for w, n in Counter(text.lower().split()).items():
        w = w.strip(EDGES)
        if w:
            found[w] = found.get(w, 0) + n
    return found


def bag(text: bytes) -> Bag:
    """Sorted grams of the words and how often each is there; at most as many as the table has rows."""
    counts = np.zeros(BUCKETS, np.int64)
    some: list[int] = []
    often: list[int] = []
    for w, n in words_of(text).items():
        own = grams(w)
        some += own
        often += [n] * len(own)
        if len(some) > 1_000_000:
            counts += np.bincount(some, often, BUCKETS).astype(np.int64)
            some, often = [], []
    if some:
        counts += np.bincount(some, often, BUCKETS).astype(np.int64)
    there = np.nonzero(counts)[0]
    return there.astype(np.uint16), counts[there].astype(np.uint32)


def held_out(id_col: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 0


@dataclass
class Model:
    logits: np.ndarray  # what each gram adds to the logit
    known: np.ndarray  # whether it was in enough texts
    bias: float


def train(bags: list[Bag], label: np.ndarray, steps: int = 320, rate: float = 0.003, decay: float = 1.0, batch: int = 128, seed: int = 7, deviations: float = 2.0) -> Model:
    """Adam on the cross-entropy of the softmax, table and weights together; both classes weigh the same in total.

    Grams of few texts are left out, and those whose share of toxic texts is within ``deviations`` standard deviations
    of the share of all: noise that a small sample would be learned by heart with. One class alone, or no rows, gives a
    model that finds nothing."""
    if not len(bags) or label.min() == label.max():
        return Model(np.zeros(BUCKETS), np.ones(BUCKETS, bool), -12.0)
    rng = np.random.default_rng(seed)
    texts, toxic, share = np.zeros(BUCKETS), np.zeros(BUCKETS), label.mean()
    for (ids, _), own in zip(bags, label, strict=True):
        texts[ids] += 1
        toxic[ids] += own
    known = (texts >= min(20, 2 + len(bags) // 500)) & (np.abs(toxic - texts * share) >= deviations * np.sqrt(texts * share * (1 - share)))
    bags = [(ids[known[ids]], counts[known[ids]]) for ids, counts in bags]
    params = [rng.normal(0, 0.01, (BUCKETS, WIDTH)), rng.normal(0, 0.5, (WIDTH, 2)), np.zeros(2)]
    params = [x.astype(np.float32) for x in params]
    first, second = [np.zeros_like(x) for x in params], [np.zeros_like(x) for x in params]
    each = np.where(label == 1, 0.5 / (label == 1).mean(), 0.5 / (label == 0).mean())
    step = 0
    while step < steps:
        order = rng.permutation(len(bags))
        for at in range(0, len(order), batch):
            who = order[at : at + batch]
            ids = np.concatenate([bags[k][0] for k in who]).astype(np.int64)
            share = np.concatenate([bags[k][1] for k in who])
            row = np.repeat(np.arange(len(who)), [len(bags[k][0]) for k in who])
            total = np.bincount(row, weights=share, minlength=len(who))
            share = share * (SCALE / np.maximum(total, 1))[row]
            mean = np.stack([np.bincount(row, weights=params[0][ids, k] * share, minlength=len(who)) for k in range(WIDTH)], 1)
            z = mean @ params[1] + params[2]
            q = np.exp(z - z.max(1, keepdims=True))
            q /= q.sum(1, keepdims=True)
            q[np.arange(len(who)), label[who]] -= 1
            q *= (each[who] / len(who))[:, None]
            back = q @ params[1].T
            slope = np.stack([np.bincount(ids, weights=back[row, k] * share, minlength=BUCKETS) for k in range(WIDTH)], 1)
            step += 1
            for x, g, a, b in zip(params, (slope, mean.T @ q, q.sum(0)), first, second, strict=True):
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                x -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-6)
            params[0] *= 1 - decay * rate
    table, weights, bias = params
    return Model((table @ (weights[:, 1] - weights[:, 0])).astype(np.float64) * known, known, float(bias[1] - bias[0]))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Model:
    """From rows of labels (doc_id, toxic) that are not held out; at most ``sample`` of them."""
    named = labels.where("toxic is not null and doc_id is not null").where(~held_out())
    named = named.groupBy(F.col("doc_id").alias("_labelled")).agg(F.max("toxic").cast("int").alias("toxic")).orderBy(F.xxhash64("_labelled"), "_labelled").limit(sample)
    plain = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    chosen = plain.join(F.broadcast(named), F.col("_id") == F.col("_labelled")).select("_id", "toxic", "_text")  # sample rows at most

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            got = [bag(t) for _, _, texts in chunks(batch, 2) for t in texts]
            columns = [pa.array([g[k].tobytes() for g in got], pa.binary()) for k in (0, 1)]
            yield pa.record_batch([batch.column(0), batch.column(1), *columns], names=["id", "toxic", "grams", "counts"])

    rows = sorted(map(tuple, arrow_map(chosen, run, "id long, toxic int, grams binary, counts binary").collect()), key=lambda r: r[0])
    bags = [(np.frombuffer(r[2], np.uint16), np.frombuffer(r[3], np.uint32)) for r in rows]
    return train(bags, np.array([r[1] for r in rows], np.int64))


class Scorer(dict):
    """Scores texts a batch at a time: each word's part of the logit and its number of grams are looked up by row, and
    remembered between batches."""

    def __init__(self, model: Model):
        self.bias, self.logits, self.known = model.bias, model.logits.tolist(), model.known.tolist()
        self.bytes, self.rows, self.parts = 0, 0, np.zeros((1 << 12, 2))

    def __missing__(self, word: bytes) -> int:
        self.bytes += len(word)
        plain = word.strip(EDGES)
        if plain != word:  # the same word with signs at its edges
            row = self[plain]
        else:
            row = self.rows
            self.rows += 1
            if row == len(self.parts):
                self.parts = np.concatenate([self.parts, np.zeros_like(self.parts)])
            logit = n = 0.0
            for k in grams(word) if word else ():
                logit += self.logits[k]
                n += self.known[k]
            self.parts[row, 0], self.parts[row, 1] = logit, n
        self[word] = row
        return row

    def __call__(self, texts: list[bytes]) -> np.ndarray:
        if len(self) > MEMORY or self.bytes > 64 * MEMORY:
            self.clear()
            self.bytes = self.rows = 0
        words = [t.lower().split() for t in texts]
        sizes = [len(w) for w in words]
        found = np.fromiter(map(self.__getitem__, chain.from_iterable(words)), np.int64, sum(sizes))
        text = np.repeat(np.arange(len(texts)), sizes)
        total, n = (np.bincount(text, self.parts[found, k], len(texts)) for k in (0, 1))
        z = self.bias + SCALE * total / np.maximum(n, 1)
        z = np.where(n > 0, z, np.minimum(z, -1.0))  # no evidence is not toxic
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) for each row of docs. The model has a bounded size and goes out with the tasks."""
    shared = docs.sparkSession.sparkContext.broadcast((model.logits, model.known, model.bias))

    def run(batches):
        import pyarrow as pa

        scorer = Scorer(Model(*shared.value))
        for batch in batches:
            got = [scorer(texts) for _, _, texts in chunks(batch, 1, 1_000_000)]
            yield pa.record_batch([batch.column(0), pa.array(np.concatenate([*got, np.zeros(0)]))], names=[id_col, "score"])

    plain = docs.select(F.col(id_col).cast("long").alias(id_col), text_col)
    return arrow_map(plain, run, f"`{id_col}` long, score double")
