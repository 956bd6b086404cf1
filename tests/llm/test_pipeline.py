"""run() against plain versions of its stages, one after the other."""

import zlib

import numpy as np
import pytest

from lakeloom.llm import quality

from . import brute
from .conftest import DATA, rows_of

pipeline = pytest.importorskip("corpus_pipeline")
public_tokenizers = pytest.importorskip("public_tokenizers")


def test_run(spark, documents):
    from tokenizers import Tokenizer

    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    rules = quality.learned(documents, labels)
    rows = rows_of(documents)
    x = {r._id: r for r in quality.with_statistics(documents.withColumnRenamed("doc_id", "_id"), "text", ("_id",)).select("_id", *(c.alias(k) for k, c in quality.ratios().items())).collect()}

    def kept(i, t):
        s = brute.statistics(t)
        if s[0] < 20 or 100 * s[4] > 30 * s[0]:
            return False
        return not any(all((x[i][c.name] > c.limit) == c.above for c in rule) for rule in rules)

    rows = [r for r in rows if kept(r[0], r[1])]
    rows = sorted(rows)
    rows = [r for r, first in zip(rows, (k == x for k, x in enumerate(brute.alike(rows))), strict=True) if first]
    cut = brute.substring(rows)
    rows = [(i, cut[i][3] if cut[i][1] else t, s) for i, t, s in rows if cut[i][1] < cut[i][0]]
    size, taken = {i: len(brute.words(t)) for i, t, _ in rows}, brute.mixed(rows)
    tokenizer, want = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), []
    for i, t, _ in rows:
        ids = np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 1], "<u4")
        each = [(i, k, len(ids[a : a + 4096]), zlib.crc32(ids[a : a + 4096].tobytes())) for k, a in enumerate(range(0, len(ids), 4096))]
        want += each * (taken[i] // size[i])
    got = pipeline.run(spark, DATA).collect()
    assert sorted((r.doc_id, r.piece, r.length, r.ids_crc32) for r in got) == sorted(want)
    fill = {}
    for r in got:
        fill[r.sequence_id] = fill.get(r.sequence_id, 0) + r.length
    assert max(fill.values()) <= 4096 and len(fill) <= 1.02 * sum(fill.values()) / 4096 + 1


def test_near_dedup_of_near_copies(spark):
    """Texts alike from 0.8 on leave one, those below stay; ids may be missing or repeat with other texts."""
    base = [f"w{k}" for k in range(100)]
    change = lambda *at: " ".join("new" + w if k in at else w for k, w in enumerate(base))
    other = " ".join(f"x{k}" for k in range(50))
    rows = [(5, change()), (6, change(50)), (7, change(20, 60)), (8, change(20, 40, 60)), (None, change(99)), (9, other), (9, other), (9, other + " more y z u v w"), (None, "a b c d e f g"), (None, None), (3, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = pipeline.near_dedup(spark, docs, DATA).collect()
    # 7 is at 86 / 106 of 5, 8 at 81 / 111 of 5 but linked to 7; the two texts of 9 are at 46 / 52
    nines = [r.text for r in got if r.doc_id == 9]
    assert len(nines) == 1 and nines[0] in (other, rows[7][1])
    assert sorted(str((r.doc_id, r.text)) for r in got if r.doc_id != 9) == sorted(str(x) for x in [(5, change()), (None, "a b c d e f g"), (3, "")])


def test_mix_of_rows_without_ids(spark):
    """Each row has the copies of its own source."""
    from lakeloom.llm import mixing
    from lakeloom.llm.common import Saved

    rows = [(None, f"{s} " * (3 + k), "en", s, k) for k, s in enumerate("abcabcabc")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    want = {(r.source, r["size"]): r.taken // r["size"] for r in mixing.mix(docs, Saved(spark, "mix")).where("doc_id is null").collect()}
    got = pipeline.mix_sources(spark, docs, DATA).where("doc_id is null").groupBy("source", "text").count().collect()
    assert len(set(want.values())) > 1
    assert {(r.source, len(r.text.split())): r["count"] for r in got} == {k: n for k, n in want.items() if n}


def test_stages_take_odd_tables(spark, edge, nothing):
    for docs in (edge, nothing):
        now = docs
        for k, (_, stage) in enumerate(pipeline.STAGES):
            now = stage(spark, now, DATA)
            if k < 4:
                assert now.columns == list(pipeline.COLUMNS)
        now.collect()


def test_stages_are_in_order():
    assert [name for name, _ in pipeline.STAGES] == ["quality rules", "SimHash near-dedup", "substring dedup", "mixing", "packing"]
