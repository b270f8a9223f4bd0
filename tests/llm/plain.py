"""Plain Python versions of the operators on digests and hashed words, for small tables."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
A_TO_Z = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def buckets_of(text):
    return [zlib.crc32(w.encode()) % 10000 for w in WORD.findall((text or "").translate(A_TO_Z))]


def resampled(docs, target):
    """Sorted (doc_id, n_features, weight, score, rank) from (doc_id, text) pairs."""
    source, wanted = Counter(), Counter()
    for _, text in docs:
        source.update(buckets_of(text))
    for text in target:
        wanted.update(buckets_of(text))
    s, t = sum(source.values()), sum(wanted.values())
    gain = {b: math.floor(1000 * math.log((wanted[b] + 1) * (s + 10000) / ((source[b] + 1) * (t + 10000)))) for b in source}
    rows = []
    for i, text in docs:
        own = [gain[b] for b in buckets_of(text)]
        weight = sum(own) // len(own) if own else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((r for r in rows if r[1] >= 20), key=lambda r: (-r[3], -math.inf if r[0] is None else r[0], r[1]))
    for rank, row in enumerate(able[: 10 * len(able) // 100], 1):
        row[4] = rank
    return sorted(map(tuple, rows), key=str)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row, more=0):
    values = (row["doc_id"], row["source"], row["lang"], None if row["n_chars"] is None else row["n_chars"] + more, row["text"])
    return sha("".join("-" if x is None else f"{len(str(x).encode())}:{x}" for x in values))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][i : i + 2])) for i in range(0, len(out[-1]), 2)])
    return out


def siblings(tree, i):
    """Per level None, or whether the sibling stands before, and it."""
    out = []
    for level in tree[:-1]:
        j = i ^ 1
        out.append((j < i, level[j]) if j < len(level) else None)
        i //= 2
    return out


def proofs(rows):
    """Sorted (doc_id, leaf, subroot, root, proof, folded, verified) of rows as dictionaries."""
    groups = {}
    for row in sorted(rows, key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r))):
        groups.setdefault(row["lang"], []).append(row)
    names = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {name: levels([leaf(r) for r in groups[name]]) for name in names}
    top = levels([trees[name][-1][0] for name in names])
    out = []
    for k, name in enumerate(names):
        above = siblings(top, k)
        for i, row in enumerate(groups[name]):
            path = siblings(trees[name], i) + above
            bad = row["doc_id"] is not None and zlib.crc32(str(row["doc_id"]).encode()) % 7 == 0
            node = leaf(row, 1 if bad else 0)
            for step in path:
                node = sha(node if step is None else step[1] + node if step[0] else node + step[1])
            proof = sha("".join(step[1] for step in path if step))
            out.append((row["doc_id"], leaf(row), trees[name][-1][0], top[-1][0], proof, node, node == top[-1][0]))
    return sorted(out, key=str)


TOKEN = re.compile(rb"[0-9a-z\x80-\xff]+|[^0-9a-z\x80-\xff\x20\x09-\x0d]+")


def chance(text, weights, bias):
    """The score of a text by hashed words, pairs and repeats, one after another."""
    words = TOKEN.findall((text or "").translate(A_TO_Z).encode())
    names = words + [a + b" " + b for a, b in zip(words, words[1:], strict=False)]
    names += [b"= ="] * sum(a == b for a, b in zip(words, words[1:], strict=False))
    names += [b"= _ ="] * sum(a == b for a, b in zip(words, words[2:], strict=False))
    counts = Counter(zlib.crc32(name) % len(weights) for name in names)
    values = {place: 1 + math.log(n) for place, n in counts.items()}
    length = math.sqrt(sum(x * x for x in values.values()))
    logit = bias + sum(weights[place] * x for place, x in values.items()) / (length or 1)
    return 1 / (1 + math.exp(-logit))


def leader(rows, labels, order, alpha, beta, l1, l2):
    """Weights after one example at a time, by the written rule, as a dictionary."""
    z, n = Counter(), Counter()

    def weight(i):
        if abs(z[i]) <= l1:
            return 0.0
        return -(z[i] - math.copysign(l1, z[i])) / ((beta + math.sqrt(n[i])) / alpha + l2)

    for k in order:
        own = {i: weight(i) for i, _ in rows[k]}
        p = 1 / (1 + math.exp(-sum(own[i] * x for i, x in rows[k])))
        for i, x in rows[k]:
            g = (p - labels[k]) * x
            z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / alpha * own[i]
            n[i] += g * g
    return {i: weight(i) for i in z}
