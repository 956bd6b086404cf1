"""Plain versions of the operators, written from their contracts."""

import hashlib
import re
from collections import defaultdict

import numpy as np
import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def lower(text):
    return (text or "").translate({c: c + 32 for c in range(65, 91)})


def removed_tokens(documents, n, same):
    """By id: which tokens are covered by n-token strings that start in a smaller id (or, with same, earlier in it)."""
    seen, gone = {}, {}
    for i in sorted(documents):
        tokens = documents[i]
        cut, new = [False] * len(tokens), []
        for k in range(len(tokens) - n + 1):
            key = hash(tokens[k : k + n])
            if key in seen:
                cut[k : k + n] = [True] * n
            elif same:
                seen[key] = i
            else:
                new.append(key)
        seen.update(dict.fromkeys(new, i))
        gone[i] = cut
    return gone


def substring(rows):
    """id -> n_words, n_removed, sha of kept words."""
    documents = {i: tuple(words(t)) for i, t, _ in rows if i is not None}
    gone = removed_tokens(documents, 13, False)
    out = {}
    for i, w in documents.items():
        kept = " ".join(x for x, g in zip(w, gone[i], strict=True) if not g)
        out[i] = (len(w), sum(gone[i]), hashlib.sha256(kept.encode()).hexdigest(), kept)
    return out


def suffix(rows):
    documents = {i: (t or "").encode() for i, t, _ in rows if i is not None}
    gone = removed_tokens(documents, 100, True)
    out = {}
    for i, b in documents.items():
        cut = gone[i]
        kept = bytes(x for x, g in zip(b, cut, strict=True) if not g)
        out[i] = (len(b), sum(cut), sum(g and not (k and cut[k - 1]) for k, g in enumerate(cut)), hashlib.sha256(kept).hexdigest())
    return out


def fingerprint(text):
    w = words(lower(text))
    shingles = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def linked(items, close):
    """By position the smallest reachable position, for a function that gives the positions close to one."""
    root = list(range(len(items)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a in range(len(items)):
        for b in close(a):
            x, y = find(a), find(int(b))
            root[max(x, y)] = min(x, y)
    return [find(k) for k in range(len(items))]


def simhash(rows):
    """id -> fingerprint, component id."""
    rows = sorted(((i, t) for i, t, _ in rows), key=lambda r: (r[0] is None, r[0]))
    fps = np.array([fingerprint(t) for _, t in rows], np.uint64)
    root = linked(rows, lambda a: np.nonzero(np.bitwise_count(fps ^ fps[a]) <= 2)[0])
    return sorted((str(rows[k][0]), f"{fps[k]:016x}", rows[root[k]][0]) for k in range(len(rows)))


def alike(rows):
    """By row the smallest row that can be reached over texts whose sets of five-word shingles are alike from 0.8 on."""
    sets = []
    for _, t, _ in rows:
        w = words(lower(t))
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())

    def close(a):
        for b, s in enumerate(sets):
            both = len(s & sets[a])
            if s == sets[a] or 5 * both >= 4 * (len(s) + len(sets[a]) - both):
                yield b

    return linked(rows, close)


def statistics(text):
    text = text or ""
    w, seen, dup = words(text), set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    places = defaultdict(list)
    for k in range(len(w) - 7):
        places[tuple(w[k : k + 8])].append(k)
    again = {j for v in places.values() if len(v) > 1 for k in v for j in range(k, k + 8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(again)


def licenses(text):
    base = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
    w, places, labels = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text)), [], set()
    for phrase, label in base.items():
        p = phrase.split()
        for k in range(len(w) - len(p) + 1):
            if w[k : k + len(p)] == p:
                places.append(k)
                labels.add(label)
    return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def targets(sizes, share=1.5, most=2.0, weights=(5, 2, 1)):
    """By source (None last): its target, dealing out the excess again until no target is above most times its size."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    total, full = share * sum(sizes.values()), set()
    while True:
        rest = total - sum(most * sizes[s] for s in full)
        level = rest / sum(weight[s] for s in order if s not in full) if len(full) < len(order) else 0
        more = {s for s in order if s not in full and weight[s] * level > most * sizes[s]}
        if not more:
            return {s: most * sizes[s] if s in full else weight[s] * level for s in order}
        full |= more


def mixed(rows):
    """[(id, taken)] for rows with ids of their own."""
    size = {i: len(words(t)) for i, t, _ in rows}
    sources = defaultdict(list)
    for i, _, s in rows:
        sources[s].append(i)
    sizes = {s: sum(size[i] for i in ids) for s, ids in sources.items()}
    target, out = targets(sizes), {}
    for s, ids in sources.items():
        ratio = target[s] / sizes[s] if sizes[s] else 0.0
        copies = min(int(ratio), 2)
        rest = target[s] - copies * sizes[s]
        digits = {i: len(f"{size[i]:b}") for i in ids if size[i]}
        factor, sure = 0.0, set()
        while rest > 0 and len(sure) < len(digits):  # what would be likelier than certain is certain
            factor = (rest - sum(size[i] for i in sure)) / sum(size[i] * digits[i] for i in digits if i not in sure)
            top = max(digits[i] for i in digits if i not in sure)
            if factor * top <= 1:
                break
            sure |= {i for i in digits if digits[i] == top}
        rest -= sum(size[i] for i in sure)
        extra = set(sure)
        if rest > 0:
            u = {i: (int(hashlib.md5(f"{i}/mix".encode()).hexdigest()[:12], 16) + 0.5) / (1 << 48) for i in ids}
            p = {i: factor * digits[i] for i in digits if i not in sure}
            rank = sorted(p, key=lambda i: ((u[i] / (1 - u[i])) / (p[i] / (1 - p[i])) if p[i] < 1 else 0.0, i))
            had = 0
            for i in rank:
                if had + size[i] > rest:
                    break
                had += size[i]
                extra.add(i)
            near = min(((abs(size[i] - (rest - had)), k, i) for k, i in enumerate(rank) if i not in extra), default=None)
            if near and near[0] < rest - had:
                extra.add(near[2])
        out.update({i: size[i] * (copies + (i in extra)) for i in ids})
    return out
