import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakeloom.llm import anchors, embedding_dedup, simhash, substring_dedup, suffix_dedup

from . import brute
from .conftest import rows_of


def found(df, *columns):
    return sorted((str(r[0]), *r[1:]) for r in df.select("doc_id", *columns).collect())


def expected(rows, by_id, alone):
    """A row for each row of the input; rows without an id are judged alone."""
    return sorted((str(i), *(by_id[i] if i is not None else alone(t))) for i, t, _ in rows)


@pytest.mark.parametrize("which", ["edge", "documents", "nothing"])
def test_substring(request, saved, which):
    docs = request.getfixturevalue(which)
    rows = rows_of(docs)
    alone = lambda t: (*(brute.substring([(0, t, None)])[0][:1]), 0, brute.hashlib.sha256(" ".join(brute.words(t)).encode()).hexdigest())
    want = expected(rows, {i: v[:3] for i, v in brute.substring(rows).items()}, alone)
    assert found(substring_dedup.dedup(docs, saved), "n_words", "n_removed", "kept_sha256") == want


def test_repeated_spans(edge, saved):
    words = {i: brute.words(t) for i, t, _ in rows_of(edge)}
    found = substring_dedup.repeated_spans(edge, saved).distinct().collect()
    for r in found:
        there = words[r.doc][r.start : r.start + r.words]
        assert r.source < r.doc and len(there) == r.words and there == words[r.source][r.source_start : r.source_start + r.words]
    # the copy of 3,000 bytes from a long text is one span, not one for each piece
    assert max(r.words for r in found if r.doc == 9) > 300 and sum(r.doc == 9 for r in found) < 10


@pytest.mark.parametrize(("which", "crowd"), [("edge", 10_000), ("edge", 2), ("documents", 10_000), ("nothing", 10_000)])
def test_suffix(request, saved, which, crowd):
    docs = request.getfixturevalue(which)
    rows = rows_of(docs)
    alone = lambda t: ((b := (t or "").encode()) and len(b), 0, 0, brute.hashlib.sha256(b).hexdigest())
    want = expected(rows, brute.suffix(rows), alone)
    got = suffix_dedup.dedup(docs, saved, crowd=crowd)
    assert found(got, "n_bytes", "n_removed", "n_spans", "kept_sha256") == want
    for r in got.collect():
        assert sum(s.end - s.start for s in r.spans) == r.n_removed and len(r.spans) == r.n_spans


@pytest.mark.parametrize("crowd", [2, 10_000])
def test_hot_anchors(edge, saved, monkeypatch, crowd):
    """Runs of anchors that several share are dealt by content as well; what is found stays the same."""
    monkeypatch.setattr(anchors, "MANY", 2)
    rows = rows_of(edge)
    by_id = brute.suffix(rows)
    got = {r.doc_id: tuple(r) for r in suffix_dedup.dedup(edge, saved, crowd=crowd).drop("spans").collect() if r.doc_id is not None}
    assert got == {i: (i, *v) for i, v in by_id.items()}
    words = substring_dedup.dedup(edge, saved).collect()
    assert {r.doc_id: tuple(r)[1:] for r in words if r.doc_id is not None} == {i: v[:3] for i, v in brute.substring(rows).items()}
    for name in ("hot32", "hot"):
        assert saved.spark.read.parquet(f"{saved.root}/{name}").count() > 0


def test_suffix_array_and_index():
    rng = random.Random(1)
    for n in (1, 2, 9, 300):
        s = np.array([rng.choice([0, 1, 2, 256]) for _ in range(n)], np.int16)
        order = suffix_dedup.suffix_array(s).tolist()
        assert order == sorted(range(n), key=lambda k: s[k:].tolist())
    text = np.array(list(b"banana$bandana$" * 3), np.int16)
    index = suffix_dedup.RunLengthIndex(text, 100)
    order = suffix_dedup.suffix_array(text)
    before, length = index.matching_statistics(np.arange(len(text)))
    for k in range(1, len(order)):
        a, b = int(order[k]), int(order[k - 1])
        same = 0
        while max(a, b) + same < len(text) and text[a + same] == text[b + same]:
            same += 1
        assert (before[a], length[a]) == (b, same)
    assert index.lengths.sum() == len(text) and len(index.heads) < len(text)


def test_later_places():
    rng = random.Random(2)
    pieces = ["".join(rng.choice("ab") for _ in range(rng.randint(12, 30))).encode() for _ in range(40)]
    seen, want, at = set(), [], 0
    for p in pieces:
        for k in range(len(p) - 9):
            if p[k : k + 10] in seen:
                want.append(at + k)
            seen.add(p[k : k + 10])
        at += len(p) + 1
    assert suffix_dedup.later_places(pieces, 10).tolist() == want


def test_anchor_runs():
    rng = np.random.default_rng(0)
    tokens, ends = rng.integers(0, 3, 4000).astype(np.uint64), np.array([0, 5, 1000, 1000, 1012, 4000])
    text, first, n, anchor = anchors.runs(tokens, ends, 13, 5)
    by_window, starts = {}, np.concatenate([[0], ends[:-1]])
    covered = [(t, k) for t, f, m in zip(text, first, n, strict=True) for k in range(f, f + m)]
    assert covered == [(t, k) for t in range(6) for k in range(starts[t], ends[t] - 12)]
    for f, m, a in zip(first, n, anchor, strict=True):
        for k in range(f, f + m):
            assert by_window.setdefault(tokens[k : k + 13].tobytes(), a) == a  # equal windows, equal anchors
    for k in (1, 2, 5, 7, 32):
        base = pow(int(anchors.M), 1, 1 << 64)
        want = sum(int(tokens[j]) * pow(base, k - 1 - j, 1 << 64) for j in range(k)) % (1 << 64)
        assert int(anchors.rolled(tokens, k)[0]) == want
    assert anchors.slid(np.array([5, 3, 4, 1, 2]), 3).tolist() == [3, 1, 1]


@pytest.mark.parametrize("which", ["edge", "documents", "nothing"])
def test_simhash(request, saved, which):
    docs = request.getfixturevalue(which)
    got = simhash.groups(docs, saved).select("doc_id", simhash.as_hex(F.col("fp")), "component_id")
    assert sorted((str(a), b, c) for a, b, c in got.collect()) == brute.simhash(rows_of(docs))


def test_simhash_crowds(spark, saved):
    rng = random.Random(5)
    fps = {rng.getrandbits(64) for _ in range(300)}
    centre = rng.getrandbits(64)
    fps |= {centre ^ sum(1 << b for b in rng.sample(range(64), 2)) for _ in range(200)}  # pairs up to four bits apart
    chain = [rng.getrandbits(64)]
    for _ in range(30):
        chain.append(chain[-1] ^ sum(1 << b for b in rng.sample(range(64), 2)))
    values = np.array(sorted(fps | set(chain)), np.uint64)
    df = spark.createDataFrame([(int(v),) for v in values.view(np.int64)], "fp long")
    close = {frozenset((int(a), int(b))) for i, a in enumerate(values) for b in values[i + 1 :][np.bitwise_count(values[i + 1 :] ^ a) <= 2]}
    for crowd in (2, 8, 10_000):
        links = {frozenset(int(np.array(x, np.int64).view(np.uint64)) for x in r) for r in simhash.linked(df, saved, crowd).collect()}
        assert links <= close if crowd < 10_000 else links == close
        position = {int(v): k for k, v in enumerate(values)}
        near = {k: [] for k in range(len(values))}
        for pair in links:
            a, b = pair
            near[position[a]].append(position[b])
        theirs = brute.linked(values, lambda a: np.nonzero(np.bitwise_count(values ^ values[a]) <= 2)[0])
        assert brute.linked(values, lambda a, near=near: near[a]) == theirs


@pytest.mark.parametrize("which", ["edge", "documents", "nothing", "dense"])
def test_similar(request, spark, saved, which):
    if which == "dense":  # near copies of few texts that share a passage: keys hold several components
        rng = random.Random(6)
        word = lambda: "".join(rng.choice("abcdef") for _ in range(4))
        shared, rows = [word() for _ in range(60)], []
        for k in range(240):
            own = random.Random(k % 4)
            w = shared + ["".join(own.choice("ghij") for _ in range(4)) for _ in range(40)]
            for _ in range(rng.choice([0, 1, 2])):
                w[rng.randrange(100)] = word()
            rows.append((k, " ".join(w), "s"))
        docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    else:
        docs = request.getfixturevalue(which)
    rows = rows_of(docs)
    root = brute.alike(rows)
    groups, firsts = {}, {}
    for k, r in enumerate(root):
        groups.setdefault(r, set()).add((rows[k][0], rows[k][1]))
        if rows[k][0] is not None:
            firsts[r] = min(firsts.get(r, 1 << 60), rows[k][0])
    found = simhash.similar(docs, saved, block=16).join(docs.select("doc_id", "text", F.xxhash64("text").alias("t1"), F.xxhash64("text", F.lit(1)).alias("t2")).distinct().withColumnRenamed("doc_id", "_d"), ["t1", "t2"]).where(F.col("doc_id").eqNullSafe(F.col("_d"))).collect()
    assert len(found) == len(rows)
    got, first = {}, {}
    for r in found:
        got.setdefault(r.component, set()).add((r.doc_id, r.text))
        if r.first:
            first.setdefault(r.component, set()).add(r.doc_id)
    key = lambda g: sorted(map(str, g))
    assert sorted(map(key, got.values())) == sorted(map(key, groups.values()))
    assert set().union(set(), *first.values()) - {None} == set(firsts.values()) and all(len(x) == 1 for x in first.values()) and len(first) == len(got)


def test_golay():
    near, fours, low, high = simhash.golay()
    x = np.random.default_rng(0).integers(0, 1 << 23, 2000)
    first, four = simhash.codewords(x)
    for bit in range(23):  # the codeword of a word one bit away is among the near ones
        other, _ = simhash.codewords(x ^ (1 << bit))
        assert ((other == first) | (other[:, None] == four).any(1)).all()
    assert (np.bitwise_count(near) <= 3).all() and np.bitwise_count(near).sum() == 23 + 2 * 253 + 3 * 1771


def test_components(spark, saved):
    from lakeloom.llm.common import components

    rng = random.Random(9)
    pairs = [(k, k + 1) for k in range(60)] + [(100, x) for x in range(101, 160)] + [(rng.randint(200, 260), rng.randint(200, 260)) for _ in range(50)]
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "a long, b long"), saved).collect()}
    nodes = sorted({x for p in pairs if p[0] != p[1] for x in p})
    place = {n: k for k, n in enumerate(nodes)}
    near = {k: [] for k in range(len(nodes))}
    for a, b in pairs:
        if a != b:
            near[place[a]].append(place[b])
    assert got == {n: nodes[k] for n, k in zip(nodes, brute.linked(nodes, lambda a: near[a]), strict=True)}
    assert components(spark.createDataFrame([], "a long, b long"), saved).count() == 0


def vectors(spark):
    rng = np.random.default_rng(3)
    rows, k = [], 0
    for label in (0, 1, None):
        for _ in range(30):
            centre = rng.normal(size=16)
            for _ in range(rng.integers(1, 6)):
                rows.append((k, [float(x) for x in centre + rng.normal(size=16) * 0.15], label))
                k += 1
    rows += [(k + j, rows[0][1], 0) for j in range(150)]  # copies
    rows += [(9000, None, 0), (9001, [], 0), (9002, [0.0] * 16, 0), (9003, [float("nan")] * 16, 0), (9004, [None] * 16, 0), (9005, [float("inf")] * 16, 0), (9006, rows[0][1][:8], 0), (None, rows[0][1], 0), (3, rows[3][1], 0)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("class", F.lit(1)).withColumn("id", F.lit(1)), rows


def test_embeddings(spark, saved):
    df, rows = vectors(spark)
    rows = [(r.vec_id, r.embedding, r.label) for r in df.collect()]
    good = lambda v, l: bool(v) and l is not None and None not in v and np.isfinite(v).all() and np.any(v)
    x = [np.array(v, np.float64) if good(v, l) else None for _, v, l in rows]

    def close(a):
        if x[a] is None:
            return []
        return [b for b in range(len(rows)) if b != a and x[b] is not None and len(x[a]) == len(x[b]) and rows[a][2] == rows[b][2] and x[a] @ x[b] / np.sqrt((x[a] @ x[a]) * (x[b] @ x[b])) >= 0.93]

    links = [len(close(a)) for a in range(len(rows))]
    root = brute.linked(rows, close)
    least = {}
    for k, r in enumerate(root):
        if rows[k][0] is not None:
            least[r] = min(least.get(r, 1 << 60), rows[k][0])
    got = sorted((str(r.vec_id), r.n_links, r.component_id, r.kept) for r in embedding_dedup.dedup(df, saved).collect())
    want = sorted((str(rows[k][0]), links[k], least.get(root[k]), rows[k][0] == least.get(root[k])) for k in range(len(rows)))
    assert sum(g[1] for g in got) >= 0.9 * sum(links)
    assert got == want  # so small a table lies in a few windows
    assert embedding_dedup.dedup(df.limit(0), saved).count() == 0


def test_dense_group_of_embeddings(spark, saved):
    """Different near copies, more than all windows together hold, beside others: every link counts."""
    rng = np.random.default_rng(8)
    dense = rng.normal(size=64) + rng.normal(size=(3000, 64)) * 0.15
    x = np.concatenate([dense, rng.normal(size=(300, 64))]).astype(np.float32).astype(np.float64)
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    want = (unit @ unit.T >= 0.93).sum(1) - 1
    assert want[:3000].min() > 1000
    df = spark.createDataFrame([(k, v.tolist(), 1) for k, v in enumerate(x)], "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.dedup(df, saved).collect()}
    assert [got[k][0] for k in range(len(x))] == want.tolist()
    assert {got[k][1] for k in range(3000)} == {0} and all(got[k][1] == k for k in range(3000, 3300))


def test_windows_reach_over_cuts(spark, saved):
    """The pairs of a pass are those of one sorted list, whatever the number of shuffle partitions."""
    x = np.random.default_rng(6).normal(size=(2000, 8))
    df = spark.createDataFrame([(k, 1, v.tobytes()) for k, v in enumerate(x)], "class long, label long, vec binary")
    rows = saved.put(embedding_dedup.projected(df, 1, 11, np.float64), "rows")
    order = [r["class"] for r in rows.orderBy(*embedding_dedup.ORDER).select("class").collect()]
    unit = (x / np.linalg.norm(x, axis=1)[:, None])[order]
    close = unit @ unit.T >= 0.6
    want = sorted(tuple(sorted((order[i], order[j]))) for i in range(2000) for j in range(i + 1, min(i + 97, 2000)) if close[i, j])
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "200")
        found = saved.put(embedding_dedup.compared(rows, 96, 0.6, np.float64), "found")
        pairs = found.where("b is not null").select("a", "b").union(embedding_dedup.across(found, 96, 0.6, np.float64)).distinct()
        assert sorted(tuple(r) for r in pairs.collect()) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_first_reached():
    rng = np.random.default_rng(3)
    for n in (1, 2, 40, 300):
        i, j = rng.integers(0, n, (2, n // 2))
        chain = np.arange(n - 1) if n == 40 else np.zeros(0, np.int64)  # one path
        i, j = np.concatenate([i, chain]), np.concatenate([j, chain + 1])
        near = {k: [k, *j[i == k].tolist(), *i[j == k].tolist()] for k in range(n)}
        want = list(range(n))
        for _ in range(n):
            want = [min(want[m] for m in near[k]) for k in range(n)]
        assert embedding_dedup.first_reached(i, j, n).tolist() == want
