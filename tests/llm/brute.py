"""Plain Python versions of what the operators compute, for small tables."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BASE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text):
    found = []
    for order, (kind, pattern) in enumerate(BASE.items()):
        for m in pattern.finditer(text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {
                "email": True,
                "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else True,
                "card": 12 <= len(digits) <= 19 and luhn(digits),
                "phone": 9 <= len(digits) <= 15,
            }[kind]
            if ok:
                found.append((m.start(), order, kind, m.end()))
    return [(kind, start, end) for start, _, kind, end in sorted(found)]


def base_row(text):
    spans = base_spans(text)
    listed = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
    counts = Counter(k for k, _, _ in spans)
    return (*(counts[k] for k in BASE), hashlib.sha256(listed.encode()).hexdigest())


def candidate_rows(text, loose, cues, counter_cues, context):
    """(kind, start, end, base, vote of the context, character before, character after) of all candidates, by plain loops."""
    kinds, found = list(BASE), []
    sure = {(kind, start, end) for kind, start, end in base_spans(text)}
    for name, pattern in [*((k, BASE[k]) for k in kinds), *((k, re.compile(p)) for k, p in loose.items())]:
        for m in pattern.finditer(text):
            base, given = (name, m.start(), m.end()) in sure, pattern is BASE[name]
            number = name != "card" or 12 <= len(re.sub("[^0-9]", "", m[0])) <= 19
            if not base and (given and not number or any(a < m.end() and m.start() < b for _, a, b in sure)):
                continue
            left = text[max(0, m.start() - context) : m.start()]
            vote = 1 if re.search(cues[name], left) else -1 if re.search(counter_cues, left) else 0
            sides = [text[m.start() - 1 : m.start()] if m.start() else "", text[m.end() : m.end() + 1]]
            classes = [0 if not c or c.isspace() else 1 if c.isalnum() or c == "_" else 2 for c in sides]
            found.append((kinds.index(name), m.start(), m.end(), base and given, vote, *classes))
    return sorted(found)


def quality_row(text):
    text = text or ""
    words = WORD.findall(text)
    grams = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    often = Counter(grams)
    inside = {j for i, g in enumerate(grams) if often[g] > 1 for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    n, repeats = len(words), len(inside)
    return (
        n,
        sum(map(len, words)),
        sum(c in "#*$%&|<>" for c in text),
        len(lines) - len(set(lines)),
        repeats,
        n < 20 or 100 * repeats > 30 * n,
    )


def bag(text):
    words = WORD.findall(text or "")
    if len(words) < 5:
        return Counter([tuple(words)] if words else [])
    return Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def classes(texts, similarity=0.8):
    """The least id of the class of each id."""
    bags = {i: bag(t) for i, t in texts.items()}
    parent = {i: i for i in texts}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(texts)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            either = sum((bags[a] | bags[b]).values())
            if either and sum((bags[a] & bags[b]).values()) >= similarity * either:
                low, high = sorted((top(a), top(b)))
                parent[high] = low
    return {i: top(i) for i in ids}


def lines_of(text):
    """(words, start, end) of each line; a line ends at a line break or after a word that ends a sentence."""
    out, before = [], None
    for m in WORD.finditer(text):
        if before is None or "\n" in text[before.end() : m.start()] or before[0][-1] in ".!?":
            out.append([])
        out[-1].append(m)
        before = m
    return out


