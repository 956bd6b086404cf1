"""Quality rules: base limits, then a decision list learned from labelled statistics.

The statistics of each text are counted in one pass. From labelled rows, sequential covering learns an ordered list of
rules, each a conjunction of thresholds: a rule grows on two thirds of the rows (FOIL's gain), is pruned on the other
third, and is kept if it is precise there; the rows that it covers leave, and the next rule is learned from the rest.
The list is emitted as one Spark expression (when ... when ... otherwise), so that judging runs in the JVM.

Null texts have no words and fail the base limits. Without labelled rows the list is empty and only base limits hold.
Repeated rows each give a row; labels that repeat an id count once, with their worst quality.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, chunks

SYMBOLS = b"#*$%&|<>"
SPACE = b" \t\n\r\x0b\x0c"
UPPER, DIGITS = bytes(range(65, 91)), bytes(range(48, 58))
STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_bytes", "n_lines", "n_distinct_words", "n_upper", "n_digits", "n_exclamations", "n_stops")
#: Labelled rows that the list is learned from, at most: those whose ids have the smallest hashes.
SAMPLE = 8000


def repeat_words(words: list[bytes], n: int = 8) -> int:
    """Words in n-word windows that are found twice or more."""
    if len(words) <= n:
        return 0
    own = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    many = len(words) - n + 1
    window = np.zeros(many, np.uint64)
    for k in range(n):
        window = window * np.uint64(0x9E3779B97F4A7C15) + own[k : k + many]
    order = np.argsort(window, kind="stable")
    same = window[order[1:]] == window[order[:-1]]
    if not same.any():
        return 0
    twice = np.zeros(many, bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    step = np.zeros(len(words) + 1, np.int64)
    at = np.nonzero(twice)[0]
    np.add.at(step, at, 1)
    np.add.at(step, at + n, -1)
    return int((np.cumsum(step[:-1]) > 0).sum())


def statistics(text: bytes) -> tuple[int, ...]:
    words = text.split()  # of bytes: at ASCII white space
    lines = [x for x in text.split(b"\n") if x.strip(SPACE)]
    without = lambda some: len(text) - len(text.translate(None, some))
    points = len(text.decode("utf-8", "replace"))
    return (
        len(words), points - (len(text) - sum(map(len, words))), without(SYMBOLS), len(lines) - len(set(lines)), repeat_words(words),
        len(text), len(lines), len(set(words)), without(UPPER), without(DIGITS), text.count(b"!"), text.count(b".") + text.count(b"?"),
    )


def with_statistics(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` of docs and the statistics of the text."""
    from pyspark.sql.types import LongType, StructField, StructType

    own = 0 if text_col in keep else 1  # the text comes first unless it is kept anyway
    kept = docs.select(*([F.col(text_col).alias("_text_")] * own), *keep)
    at = 0 if own else keep.index(text_col)
    schema = StructType([*kept.schema.fields[own:], *(StructField(s, LongType()) for s in STATISTICS)])

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            got = np.array([statistics(t) for _, _, texts in chunks(batch, at) for t in texts], np.int64).reshape(-1, len(STATISTICS))
            columns = [*batch.columns[own:], *(pa.array(got[:, k]) for k in range(len(STATISTICS)))]
            yield pa.record_batch(columns, names=[f.name for f in schema.fields])

    return arrow_map(kept, run, schema)


def ratios() -> dict[str, Column]:
    """What thresholds are set on, from the statistics."""
    per = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    return {
        "words": F.col("n_words").cast("double"),
        "word_length": per("word_chars", "n_words"),
        "symbols": per("n_symbols", "word_chars"),
        "dup_lines": per("n_dup_lines", "n_lines"),
        "repeats": per("n_repeat_words", "n_words"),
        "distinct": per("n_distinct_words", "n_words"),
        "upper": per("n_upper", "n_bytes"),
        "digits": per("n_digits", "n_bytes"),
        "exclamations": per("n_exclamations", "n_words"),
        "stops": per("n_stops", "n_words"),
    }


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


@dataclass(frozen=True)
class Condition:
    name: str
    above: bool
    limit: float

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.name] > self.limit if self.above else x[self.name] <= self.limit

    def expression(self) -> Column:
        c = ratios()[self.name]
        return c > self.limit if self.above else c <= self.limit


Rule = tuple[Condition, ...]


def covers(rule: Rule, x: dict[str, np.ndarray]) -> np.ndarray:
    return reduce(np.logical_and, (c.holds(x) for c in rule))


def _grow(x: dict[str, np.ndarray], bad: np.ndarray, cuts: int, longest: int) -> Rule:
    rule: Rule = ()
    inside = np.ones(len(bad), bool)
    while len(rule) < longest and (inside & ~bad).any():
        p0, n0 = int((inside & bad).sum()), int((inside & ~bad).sum())
        if not p0:
            break
        best, gain = None, 1e-9
        for name, v in x.items():
            edges = np.unique(np.quantile(v[inside], np.linspace(0, 1, cuts)))
            for limit in ((edges[1:] + edges[:-1]) / 2).tolist():
                high = v > limit
                for above, there in ((True, high & inside), (False, ~high & inside)):
                    p, n = int((there & bad).sum()), int((there & ~bad).sum())
                    if p:
                        g = p * (np.log2(p / (p + n)) - np.log2(p0 / (p0 + n0)))
                        if g > gain:
                            best, gain = Condition(name, above, limit), g
        if best is None:
            break
        rule += (best,)
        inside &= best.holds(x)
    return rule


def learn(x: dict[str, np.ndarray], bad: np.ndarray, fold: np.ndarray, precise: float = 0.9, least: int = 3, most: int = 12, cuts: int = 48, longest: int = 4) -> list[Rule]:
    """The ordered rules that tell bad rows. fold 0 prunes, the others grow."""
    rules: list[Rule] = []
    left = np.ones(len(bad), bool)
    part = lambda m: {k: v[m] for k, v in x.items()}
    while len(rules) < most:
        grow, prune = left & (fold != 0), left & (fold == 0)
        if (bad & grow).sum() < least or not (bad & prune).any():
            break
        rule = _grow(part(grow), bad[grow], cuts, longest)
        if not rule:
            break
        there, own = part(prune), bad[prune]

        def worth(n: int, rule: Rule = rule, there=there, own=own) -> float:
            c = covers(rule[:n], there)
            p, f = int((c & own).sum()), int((c & ~own).sum())
            return (p - f) / (p + f) if p + f else -1.0

        n = max(range(1, len(rule) + 1), key=lambda n: (worth(n), -n))
        rule = rule[:n]
        c = covers(rule, there)
        if not c.any() or (c & own).sum() < precise * c.sum():
            break
        rules.append(rule)
        left &= ~covers(rule, x)
    return rules


def learned(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> list[Rule]:
    """The list for documents with labels (doc_id, quality): quality 0 is bad. At most ``sample`` labelled rows are used."""
    named = labels.where("quality is not null and doc_id is not null").groupBy(F.col("doc_id").alias("_labelled")).agg(F.min("quality").alias("quality"))
    named = named.orderBy(F.xxhash64("_labelled"), "_labelled").limit(sample)
    chosen = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(named), F.col("_id") == F.col("_labelled"))  # sample rows at most
    seen = with_statistics(chosen, "_text", ("_id", "quality")).where(~base_failed())
    rows = seen.select("_id", (F.col("quality") == 0).alias("bad"), *(c.alias(k) for k, c in ratios().items())).collect()
    if not rows:
        return []
    rows.sort()
    x = {k: np.array([r[k] for r in rows], float) for k in ratios()}
    return learn(x, np.array([r["bad"] for r in rows]), np.array([zlib.crc32(str(r["_id"]).encode()) % 3 for r in rows]))


def verdict(rules: list[Rule]) -> Column:
    """True for what stays: the rules in their order, the first that fits decides."""
    said = F.when(base_failed(), F.lit(False))
    for rule in rules:
        said = said.when(reduce(Column.__and__, (c.expression() for c in rule)), F.lit(False))
    return said.otherwise(F.lit(True))


def judge(docs: DataFrame, rules: list[Rule], id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Statistics, base_failed and kept for each row of docs."""
    return with_statistics(docs, text_col, (id_col, *keep)).select("*", base_failed().alias("base_failed"), verdict(rules).alias("kept"))
