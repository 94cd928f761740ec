"""Plain Python versions of the operators, for small tables."""

from __future__ import annotations

import hashlib
import re

WORD3 = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def contaminated(docs, bench, length=10):
    """doc rows (id, text), bench rows (id, text) -> rows of op3."""
    wins: dict[tuple, set] = {}
    for item, text in bench:
        w = WORD3.findall((text or "").translate(LOWER))
        n = min(length, len(w))
        for k in range(len(w) - n + 1 if w else 0):
            wins.setdefault(tuple(w[k:k + n]), set()).add(item)
    sizes, out = {len(w) for w in wins}, []
    for doc, text in docs:
        w, hit, items = WORD3.findall((text or "").translate(LOWER)), set(), set()
        for n in sizes:
            for s in range(len(w) - n + 1):
                found = wins.get(tuple(w[s:s + n]))
                if found:
                    hit.update(range(s, s + n))
                    items |= found
        names = sorted(str(i) for i in items if i is not None)
        out.append((doc, len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit)))
    return out


def near(docs):
    """doc rows (id, text) -> {id: (n_shingles, component_id)} by comparing all pairs of sets."""
    sets = {}
    for doc, text in docs:
        w = WORD.findall((text or "").translate(LOWER))
        sets[doc] = {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    up = {d: d for d in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    holders: dict[tuple, list] = {}
    for d, s in sets.items():
        for x in s:
            holders.setdefault(x, []).append(d)
    pairs = {(a, b) for h in holders.values() if len(h) > 1 for i, a in enumerate(h) for b in h[i + 1:]}
    for a, b in pairs:
        both = len(sets[a] & sets[b])
        if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((root(a), root(b)))
            up[y] = x
    return {d: (len(s), root(d)) for d, s in sets.items()}


def counts(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of op10."""
    w = WORD.findall(text or "")
    runs: dict[tuple, list] = {}
    for i in range(len(w) - 4):
        runs.setdefault(tuple(w[i:i + 5]), []).append(i)
    covered = {j for at in runs.values() if len(at) > 1 for i in at for j in range(i, i + 5)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered)
