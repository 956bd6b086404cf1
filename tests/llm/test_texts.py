import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakeloom.llm import licenses, mixing, packing, quality, toxicity, url_filter
from lakeloom.llm.common import Saved

from . import brute
from .conftest import DATA, rows_of

public_tokenizers = pytest.importorskip("public_tokenizers")


@pytest.mark.parametrize("which", ["edge", "documents", "nothing"])
def test_licenses(request, saved, which):
    docs = request.getfixturevalue(which)
    got = licenses.scan(docs, saved).collect()
    key = lambda r: (str(r[0]), str(r))
    want = sorted(((i, *brute.licenses(t)) for i, t, _ in rows_of(docs)), key=key)
    assert sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got), key=key) == want
    for r in got:
        assert set(r.base_labels.split(",")) <= set(r.labels.split(",")) | {""} and 0 <= r.score <= 1


def test_license_templates(spark, saved):
    texts = ["Intro. This work is licensed under the GNU General Public License, version 3. End", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "license version words apache only", "Licensed under CC BY-NC 4.0.", "released under the MIT licence"]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)] + [(k, "plain words here") for k in range(5, 60)], "doc_id long, text string")
    got = {r.doc_id: (r.labels, r.score) for r in licenses.scan(docs, saved).collect()}
    assert got[0] == ("gpl,gpl-3.0", 1.0) and got[1] == ("mit", 1.0) and got[2] == ("", 0.0) and got[3] == ("cc-by,cc-by-nc-4.0", 1.0) and got[4] == ("", 0.0) and got[7] == ("", 0.0)


def test_license_pairs(spark, saved):
    """Two notices in one text, and one among rarer words of others, lose no template."""
    notices = [" ".join(t.words) for t in licenses.TEMPLATES]
    texts = [f"{a} . and then {b}" for a in notices for b in notices] + [f"{a} binary forms mozilla hereby conditions isc" for a in notices]
    docs = spark.createDataFrame(list(enumerate(texts + ["plain words of a license"] * 50)), "doc_id long, text string")

    def stated(text):
        w = text.replace(".", " ").split()
        keys = [(t.label, list(t.words[slice(*t.key)])) for t in licenses.TEMPLATES]
        own = {label for label, key in keys if any(w[k : k + len(key)] == key for k in range(len(w)))}
        return ",".join(sorted(own | set(filter(None, brute.licenses(text)[4].split(",")))))

    got = {r.doc_id: r.labels for r in licenses.scan(docs, saved).collect()}
    assert got == {r.doc_id: stated(r.text) for r in docs.collect()}


def test_mixing(edge, saved):
    rows = rows_of(edge)
    got = mixing.mix(edge, saved).collect()
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(brute.words(t))
    want = brute.targets(sizes)
    assert len(got) == len(rows)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source]) and r.taken <= 2 * r["size"]
    for s, t in want.items():
        taken = sum(r.taken for r in got if r.source == s)
        largest = max(r["size"] for r in got if r.source == s)
        assert abs(taken - t) <= largest / 2 + 1
    again = mixing.mix(edge.repartition(5), saved).collect()
    plain = lambda x: sorted(str(tuple(r)) for r in x)
    assert plain(got) == plain(again)


def test_mixing_matches_plain(documents, nothing, saved):
    got = {r.doc_id: r.taken for r in mixing.mix(documents, saved).collect()}
    assert got == brute.mixed(rows_of(documents))
    assert mixing.mix(nothing, saved).count() == 0


def test_mixing_unequal(spark, saved):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("a b c").alias("text"), F.when(F.col("id") < 1000, "x").otherwise("y").alias("source"), (F.col("id") % 2).alias("odd"))
    rows = mixing.mix(docs, saved, share=0.5, weights=(1.0,), odds_weight=1 + 9 * (F.col("doc_id") % 2)).collect()
    taken = lambda odd, s: sum(r.taken for r in rows if r.doc_id % 2 == odd and r.source == s)
    assert taken(1, "y") > 2 * taken(0, "y") and sum(r.taken for r in rows) == pytest.approx(6000, abs=6)


def test_mixing_weights(spark, saved):
    """Longer documents are likelier, by the digits of their sizes; the words of each kind are as expected."""
    rng = random.Random(3)
    sizes = [rng.choice([3, 60, 1000]) for _ in range(6000)]
    docs = spark.createDataFrame([(k, "w " * n, "x" if k % 3 else "y") for k, n in enumerate(sizes)], "doc_id long, text string, source string")
    got = mixing.mix(docs, saved, share=0.4, weights=(1.0,)).where("source = 'x'").collect()
    target, digits = got[0].target, {3: 2, 60: 6, 1000: 10}
    words = {n: sum(r["size"] for r in got if r["size"] == n) for n in digits}
    factor = target / sum(words[n] * digits[n] for n in digits)
    assert sum(r.taken for r in got) == pytest.approx(target, abs=500)
    for n in digits:
        share = sum(r.taken for r in got if r["size"] == n) / words[n]
        assert share == pytest.approx(factor * digits[n], abs=0.06) and share < 1
    certain = mixing.mix(docs.withColumn("source", F.lit("x")), saved, share=0.98, weights=(1.0,)).collect()
    assert sum(r.taken for r in certain if r["size"] < 1000) > 0 and all(r.taken == 1000 for r in certain if r["size"] == 1000)  # their chance would be over one


@pytest.mark.parametrize("which", ["edge", "documents", "nothing"])
def test_statistics(request, which):
    docs = request.getfixturevalue(which)
    got = quality.judge(docs, []).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept").collect()
    want = []
    for i, t, _ in rows_of(docs):
        s = brute.statistics(t)
        failed = s[0] < 20 or 100 * s[4] > 30 * s[0]
        want.append((i, *s, failed, not failed))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_rules_are_learned(spark, documents):
    rng = np.random.default_rng(0)
    x = {"a": rng.random(3000), "b": rng.random(3000), "c": rng.random(3000)}
    bad = ((x["a"] > 0.8) & (x["b"] <= 0.5)) | (x["c"] > 0.95)
    rules = quality.learn(x, bad, rng.integers(0, 3, 3000))
    said = np.zeros(3000, bool)
    for r in rules:
        said |= quality.covers(r, x)
    assert (said & bad).sum() / bad.sum() > 0.9 and (said & ~bad).sum() < 15 and len(rules) <= 6
    assert quality.learn(x, rng.random(3000) < 0.1, rng.integers(0, 3, 3000)) == []  # noise: no rule is precise
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    assert quality.learned(documents, labels.limit(0)) == []
    rules = quality.learned(documents, labels)
    judged = quality.judge(documents, rules).join(labels, "doc_id").collect()
    assert all(not r.kept for r in judged if r.base_failed)
    clean = [r for r in judged if r.quality == 1 and not r.base_failed]
    assert sum(r.kept for r in clean) >= 0.95 * len(clean)


@pytest.mark.parametrize("which", ["edge", "documents", "nothing"])
def test_packing(request, saved, which):
    from tokenizers import Tokenizer

    docs = request.getfixturevalue(which)
    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    got = packing.pack_documents(docs, saved, path).collect()
    want = []
    for i, t, _ in rows_of(docs):
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        want += [(str(i), k, a, len(ids[a : a + 4096]), zlib.crc32(ids[a : a + 4096].tobytes())) for k, a in enumerate(range(0, len(ids), 4096))]
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 4096
    least = -(-sum(r.length for r in got) // 4096)
    assert least <= len(sequences) <= least + max(1, least // 100)


def test_plan():
    from collections import Counter

    rng = random.Random(0)
    for n, top in [(0, 9), (1, 100), (50, 100), (3000, 100), (3000, 40), (500, 100)]:
        counts = Counter(rng.randint(1, top) for _ in range(n))
        rows, placed, fill = packing.plan(counts, 100), Counter(), Counter()
        for length, first, n_pieces, bin_, each, at in rows:
            assert first == placed[length]
            placed[length] += n_pieces
            for k in range(n_pieces):
                place = (bin_ + k // each, at + k % each * length)
                assert place[1] == fill[place[0]] or each > 1
                fill[place[0]] = max(fill[place[0]], place[1] + length)
        assert placed == counts and all(v <= 100 for v in fill.values())
        total = sum(k * v for k, v in counts.items())
        assert len(fill) <= max(-(-total // 100), sum(v for k, v in counts.items() if k > 50)) * 1.05 + 1


def test_encoder():
    e = packing.Encoder(public_tokenizers.path("word_bpe_49k.json"))
    assert e.direct
    for w in ["don't", "<|endoftext|>", "x<|endoftext|>y", "É'S", "naïve.", "½kg", "①", "áb", "ÀÉ!!", "straße", "__init__", "日本語。", "a1b2", "ﬁn", "Σας", "İx", "×", "÷a", "ÿ", "µm", "ªº", "\x00a", "a b", "\x1c"]:
        assert e[w.encode()] == e._whole(w.encode()), w


def test_urls(spark, saved):
    urls = ["https://A.example.ORG/es/1?x", "http://example.org/en/12", "https://example.org/en/2", "https://x.com/fr/", "https://x.com/de/a#b", "https://x.com?de/", "ftp://com/de/", "notcom/de/", "https://notexample.org/es/", "http://b.com:80/de/", None, "", "://", "HTTP://X.NET"]
    bad = [f"https://bad.shop.com/de/{k}" for k in range(60)] + ["https://bad.shop.com/en/1", "https://other.shop.com/en/1"]
    good = [f"https://fine.com/fr/{k}" for k in range(60)] + ["https://fine.com/en/1"]
    pages = spark.createDataFrame([(k, u, "h") for k, u in enumerate(urls + bad + good)], "page_id long, url string, host string").withColumn("_said", F.lit(1)).withColumn("domain", F.lit(1))
    got = {r.page_id: r for r in url_filter.judge_pages(pages, saved).collect()}
    assert [(got[k].host, got[k].path) for k in (0, 5, 9, 10, 12, 13)] == [("a.example.org", "/es/1"), ("x.com", ""), ("b.com:80", "/de/"), ("", ""), ("", ""), ("X.NET".lower(), "")]
    assert [got[k].rule for k in range(14)] == ["example.org/es/", "example.org/en/1", "org/", "com/fr/", "com/de/", None, "com/de/", None, "org/", None, None, None, None, None]
    verdict = {r.path + r.host: r.verdict for r in got.values()}
    assert verdict["/en/1bad.shop.com"] == "block" and verdict["/en/1fine.com"] == "allow"
    assert all(r.verdict == ("block" if r.rule in ("example.org/es/", "example.org/en/1", "com/de/") else "allow") for r in got.values() if r.rule)
    assert url_filter.judge_pages(pages.limit(0), saved).count() == 0
    assert url_filter.judge_pages(pages.union(pages), saved).count() == 2 * pages.count()


def reputation(pages, rules, names, private, z=1.0):
    """By host: the mean and the lower bound of the rate of blocked pages, from pages (host, path)."""
    said = lambda h, p: next((v for v, r in sorted(((v, r) for v, r in rules), key=lambda x: -len(x[1])) if (h == r.split("/")[0] or h.endswith("." + r.split("/")[0])) and p.startswith("/" + r.split("/", 1)[1])), None)

    def above(host):
        name = host.rpartition("@")[2].rsplit(":", 1)[0] if host.rpartition(":")[2].isdigit() or host.endswith(":") else host.rpartition("@")[2]
        parts = name.split(".")
        if name.replace(".", "").isdigit() or name.startswith("["):
            return name, "address"
        two = len(parts) > 1 and (".".join(parts[-2:]) in private or (parts[-2] in names and len(parts[-1]) == 2 and parts[-1].isalpha()))
        return ".".join(parts[-3 if two else -2 :]), ".".join(parts[-2 if two else -1 :])

    counts = {}
    for h, p in pages:
        v = said(h, p)
        n, k = counts.get(h, (0, 0))
        counts[h] = (n + (v is not None), k + (v == "block"))
    total = (sum(k for _, k in counts.values()) + 0.5) / (sum(n for n, _ in counts.values()) + 1.0)
    levels = [lambda h: (above(h)[1],), lambda h: (above(h)[1], above(h)[0]), lambda h: (above(h)[1], above(h)[0], h)]
    before = {(): total}
    for level in levels:
        groups = {}
        for h, (n, k) in counts.items():
            a, b = groups.get(level(h), (0, 0))
            groups[level(h)] = (a + n, b + k)
        seen = [(n, k, before[key[:-1]]) for key, (n, k) in groups.items() if n]
        rows, many = sum(n for n, _, _ in seen), len(seen)
        rho = 0.5
        if rows > many:
            spread = sum(n * (k / n - p) ** 2 / (p * (1 - p)) for n, k, p in seen)
            rho = min(0.99, max(0.01, (spread / rows - many / rows) / (1 - many / rows)))
        m = 1 / rho - 1
        out = {}
        for key, (n, k) in groups.items():
            p = before[key[:-1]]
            a, b = k + m * p, n - k + m * (1 - p)
            out[key] = (a / (a + b), a / (a + b) - z * (a * b / ((a + b) ** 2 * (a + b + 1))) ** 0.5)
        before = {key: v[0] for key, v in out.items()}
    return {h: out[levels[2](h)] for h in counts}


def test_reputation_matches_plain(spark, saved):
    """Hosts with many, few and no judged pages under several suffixes; some are blocked by the bound alone."""
    rng = random.Random(2)
    domains = ["a.com", "b.com", "c.example.org", "d.co.uk", "e.gov.au", "f.github.io", "10.0.0.1", "g.com:8080", "me@h.com", "co.uk", "x"]
    pages = []
    for d in domains:
        for sub in ("", "www.", "m.", "n."):
            h, bad, n = sub + d, rng.random(), rng.choice([0, 2, 10, 60])
            pages += [(h, "/" + ("de/" if rng.random() < bad else "fr/") + str(k)) for k in range(n)] + [(h, "/en/9"), (h, "/es/1")]
    found = url_filter.judge_pages(spark.createDataFrame([(k, f"https://{h}{p}") for k, (h, p) in enumerate(pages)], "page_id long, url string"), saved).collect()
    rules = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]
    low = reputation(pages, rules, url_filter.SECOND_LEVEL, url_filter.PRIVATE)
    verdicts = {(r.host, r.path): (r.rule, r.verdict) for r in found}
    free = {h: verdict for (h, _), (rule, verdict) in verdicts.items() if rule is None}
    assert free == {h: "block" if low[h][1] > 0.5 else "allow" for h in free}
    assert "block" in free.values() and "allow" in free.values()


def test_toxicity(spark):
    rng = random.Random(0)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
    rows, labels = [], []
    for k in range(1500):
        words = [word() for _ in range(60)]
        toxic = k % 6 == 0
        if toxic:
            for _ in range(5):
                words[rng.randrange(60)] = "nasty" + word()  # never the same word
        rows.append((k, " ".join(words)))
        labels.append((k, int(toxic)))
    docs = spark.createDataFrame([*rows, (5000, None), (5001, ""), (None, "plain"), rows[0]], "doc_id long, text string").withColumn("score", F.lit(1)).withColumn("toxic", F.lit(1))
    marks = spark.createDataFrame([*labels, (7, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs, marks)
    got = toxicity.score(docs, model).select("doc_id", toxicity.held_out().alias("held_out"), "score").collect()
    assert len(got) == docs.count()
    truth = dict(labels)
    for r in got:
        assert r.held_out == (zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 5 == 0) and 0 <= r.score <= 1
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert sum((r.score >= 0.5) == bool(truth[r.doc_id]) for r in held) >= 0.95 * len(held)
    assert all(r.score < 0.5 for r in got if r.doc_id in (5000, 5001))
    empty = toxicity.fit(docs, marks.limit(0))
    assert all(r.score < 0.01 for r in toxicity.score(docs, empty).collect())
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_scores_match_plain(spark, edge, documents):
    """Each text's score from its own words, one after the other, repeats included."""
    import math

    model = toxicity.fit(documents, spark.read.parquet(f"{DATA}/labels.parquet"))

    def plain(text):
        total = n = 0
        for w in (text or "").encode().split():
            w = bytes(c + 32 if 65 <= c <= 90 else c for c in w).strip(b".,;:!?\"'()[]{}*#%&$|<>-_")
            marked = b"<" + w + b">"
            for part in [marked, *(marked[k : k + m] for m in (3, 4, 5) for k in range(len(marked) - m + 1))] if w else []:
                row = zlib.crc32(part) % 32768
                total += model.logits[row]
                n += int(model.known[row])
        z = model.bias + 100 * total / n if n else min(model.bias, -1.0)
        return 1 / (1 + math.exp(-max(-60, min(60, z))))

    for docs in (edge.where("doc_id is not null and doc_id not in (7, 8)"), documents.limit(60)):
        got = toxicity.score(docs, model).collect()
        want = {i: plain(t) for i, t, _ in rows_of(docs)}
        assert len(got) == docs.count() and all(r.score == pytest.approx(want[r.doc_id], abs=1e-9) for r in got)


def test_labels_of_held_out_rows_are_not_used(spark, documents):
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    turned = labels.withColumn("toxic", F.when(toxicity.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = toxicity.fit(documents, labels), toxicity.fit(documents, turned)
    assert np.array_equal(a.logits, b.logits) and a.bias == b.bias


def test_saved_reads_the_session(spark):
    assert Saved(spark, "x").root.startswith(spark.conf.get("spark.checkpoint.dir"))
