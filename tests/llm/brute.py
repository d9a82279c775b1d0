"""Plain Python versions of what the operators compute."""

from __future__ import annotations

import re
from collections import defaultdict

_ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def lower(text: str | None) -> str:
    return (text or "").translate(_ASCII)


def words(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def alnum(text: str | None) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))


class Groups:
    def __init__(self, nodes):
        self.above = {x: x for x in nodes}

    def top(self, x):
        while self.above[x] != x:
            x = self.above[x]
        return x

    def join(self, a, b):
        a, b = self.top(a), self.top(b)
        self.above[max(a, b)] = min(a, b)


def shingles(text: str | None) -> set:
    w = words(lower(text))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def jaccard_groups(texts: dict[int, str | None]) -> dict[int, tuple[int, int]]:
    """doc_id: (size, least doc_id of its group)."""
    sets = {i: shingles(t) for i, t in texts.items()}
    g, ids = Groups(sets), sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 5 * min(len(x), len(y)) >= 4 * max(len(x), len(y)):
                both = len(x & y)
                if 100 * both >= 80 * (len(x) + len(y) - both):
                    g.join(a, b)
    return {i: (len(sets[i]), g.top(i)) for i in ids}


def edit_distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def deduped_lines(texts: dict[int, str | None], simhash, radius: int = 3) -> dict[int, str | None]:
    """simhash: normalised line to 64-bit number."""
    seen = defaultdict(list)
    for d in sorted(texts):
        for i, line in enumerate((texts[d] or "").split("\n")):
            if w := alnum(line):
                seen[" ".join(w)].append((d, i))
    norms = sorted(seen)
    bits = [simhash(n) for n in norms]
    g = Groups(range(len(norms)))
    for i in range(len(norms)):
        for j in range(i + 1, len(norms)):
            if (bits[i] ^ bits[j]).bit_count() <= radius and 5 * edit_distance(norms[i], norms[j]) <= max(len(norms[i]), len(norms[j])):
                g.join(i, j)
    occurrences = defaultdict(set)
    for i, n in enumerate(norms):
        occurrences[g.top(i)].update(seen[n])
    gone = {x for group in occurrences.values() for x in sorted(group)[1:]}
    return {d: t if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if (d, i) not in gone) for d, t in texts.items()}


def contamination(texts: dict[int, str | None], items: dict[int, str | None], width: int = 10) -> dict[int, tuple[int, set[int], set]]:
    """doc_id: (words, hit words, items)."""
    windows = defaultdict(set)
    for i, t in items.items():
        w = alnum(t)
        for k in range(max(1, len(w) - width + 1) if w else 0):
            windows[tuple(w[k : k + width])].add(i)
    sizes, out = {len(w) for w in windows}, {}
    for d, t in texts.items():
        w, hit, found = alnum(t), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if got := windows.get(tuple(w[k : k + n])):
                    hit.update(range(k, k + n))
                    found |= got
        out[d] = (len(w), hit, found)
    return out


def runs(words: list, least: int = 12) -> list[tuple[int, int, int]]:
    """(start, length, smallest period) of every maximal run."""
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, 2 * q):
                found.setdefault((i, j + q), q)
            i = max(j, i) + 1
    return sorted((a, b - a, q) for (a, b), q in found.items())


def without_passages(rows: list[tuple], k: int = 50) -> list[tuple[int, int, str]]:
    """(words, removed, kept words) of rows (doc_id, text)."""
    least: dict[tuple, int] = {}
    for d, t in rows:
        w = words(t)
        for i in range(len(w) - k + 1 if d is not None else 0):
            x = tuple(w[i : i + k])
            least[x] = min(d, least.get(x, d))
    out = []
    for d, t in rows:
        w, gone = words(t), set()
        for i in range(len(w) - k + 1 if d is not None else 0):
            if least[tuple(w[i : i + k])] < d:
                gone.update(range(i, i + k))
        out.append((len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def audit(rows: list[tuple], labels: list[tuple]) -> dict[tuple, tuple]:
    """(part, order, step): counts, of rows (doc_id, text, source) and labels (doc_id, quality, toxic)."""
    from collections import Counter
    from itertools import permutations

    mark = {i: {d for d, *v in labels if v[i] == 1} for i in (0, 1)}
    failed = []
    for d, t, s in rows:
        t = t or ""
        w = words(t)
        bad = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": d is not None and any(e is not None and e < d and (u or "") == t for e, u, _ in rows)}
        failed.append((s or "", {k for k, v in bad.items() if v}, d is not None and d in mark[0], d is not None and d in mark[1]))
    out, shapley = {}, Counter()
    for part in {x[0] for x in failed}:
        mine = [x[1:] for x in failed if x[0] == part]
        for p in map("".join, permutations("ABCDE")):
            for k, f in enumerate(p):
                past = set(p[:k])
                removed = [x for x in mine if f in x[0] and not x[0] & past]
                out[part, p, k + 1] = (sum(not x[0] & (past | {f}) for x in mine), len(removed), sum(f in x[0] and bool(x[0] & past) for x in mine), sum(x[0] == {f} for x in mine), sum(x[1] for x in removed), sum(x[2] for x in removed))
                shapley[part, f] += len(removed)
    return {key: (*v, shapley[key[0], key[1][key[2] - 1]]) for key, v in out.items()}
