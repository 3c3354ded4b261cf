"""Plain versions of what the operators compute."""

import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lowered(text):
    return "".join(c.lower() if c.isascii() else c for c in text)


def brute_repeats(rows, length=20):
    """rows: (doc_id, text) in the order of their ids; words kept of each."""
    seen, out = set(), []
    for _, text in rows:
        words = WORD.findall(text or "")
        gone = [False] * len(words)
        for p in range(len(words) - length + 1):
            window = tuple(words[p : p + length])
            if window in seen:
                gone[p : p + length] = [True] * length
            seen.add(window)
        out.append((len(words), sum(gone), " ".join(w for w, g in zip(words, gone, strict=True) if not g)))
    return out


def brute_components(sets, percent=80):
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    inverted = defaultdict(list)
    for i in sorted(sets):
        shared = Counter(j for s in sets[i] for j in inverted[s])
        for j, n in shared.items():
            if 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
        for s in sets[i]:
            inverted[s].append(i)
    return {i: root(i) for i in sets}


def shingles(text, width):
    words = WORD.findall(lowered(text or ""))
    if len(words) < width:
        return {tuple(words)} if words else set()
    return {*zip(*[words[i:] for i in range(width)], strict=False)}
