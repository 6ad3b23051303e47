"""Plain versions of the corpus operators, for small inputs."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, defaultdict

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")


class Groups:
    def __init__(self):
        self.parent = {}

    def root(self, x):
        self.parent.setdefault(x, x)
        while self.parent[x] != x:
            x = self.parent[x]
        return x

    def link(self, a, b):
        a, b = self.root(a), self.root(b)
        self.parent[max(a, b)] = min(a, b)


def jaccard_components(sets: dict, percent: int) -> dict:
    """Smallest key that links reach, for every key."""
    groups = Groups()
    keys = sorted(sets)
    for n, a in enumerate(keys):
        for b in keys[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                groups.link(a, b)
    return {k: groups.root(k) for k in keys}


def shingle_set(text: str | None, width: int) -> set:
    words = WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if not words:
        return set()
    width = min(width, len(words))
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}


def removed_lines(texts: dict, percent: int = 80, width: int = 5) -> dict:
    """Numbers of removed lines per document."""
    places = {}
    for key in sorted(texts):
        for n, line in enumerate((texts[key] or "").split("\n")):
            if line and not line.isspace():
                places[(key, n)] = line.strip().lower()
    sets = {p: {line[i : i + width] for i in range(max(1, len(line) - width + 1))} for p, line in places.items()}
    roots = jaccard_components(sets, percent)
    out = defaultdict(list)
    for (key, n), root in roots.items():
        if root != (key, n):
            out[key].append(n)
    return out


def repeats(texts: dict, length: int = 200) -> dict:
    """(kept bytes, removed, spans) per document."""
    contents = {k: (t or "").encode() for k, t in texts.items()}
    counts = Counter(c[i : i + length] for c in contents.values() for i in range(len(c) - length + 1))
    out = {}
    for key, c in contents.items():
        gone = np.zeros(len(c), bool)
        for i in range(len(c) - length + 1):
            if counts[c[i : i + length]] > 1:
                gone[i : i + length] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out[key] = (bytes(b for b, g in zip(c, gone, strict=True) if not g), int(gone.sum()), spans)
    return out


def counts(text: str | None) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = set()
    for i in range(len(words) - 7):
        if windows[tuple(words[i : i + 8])] > 1:
            covered.update(range(i, i + 8))
    lines = [line for line in text.split("\n") if WORD.search(line)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))


PERSONAL = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
)


def personal(text: str | None) -> list[tuple]:
    """(start, kind number, end, value)."""
    found = []
    for n, (kind, pattern) in enumerate(PERSONAL):
        for m in re.finditer(pattern, text or ""):
            value = m.group()
            digits = re.sub("[^0-9]", "", value)
            luhn = sum(int(c) if i % 2 == 0 else 2 * int(c) - 9 * (int(c) > 4) for i, c in enumerate(reversed(digits)))
            if kind == "ip" and any(int(p) > 255 for p in value.split(".")):
                continue
            if kind == "card" and not (12 <= len(digits) <= 19 and luhn % 10 == 0):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            found.append((m.start(), n, m.end(), value))
    return sorted(found)


def mix_targets(sizes: dict, weights=(5, 2, 1), most: int = 3) -> dict:
    """Targets by stopping sources one after the other. None stands for a null source."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, free, left = {}, set(order), float(sum(sizes.values()))
    while free:
        level = left / sum(weight[s] for s in free)
        over = [s for s in free if level * weight[s] > most * sizes[s]]
        if not over:
            return target | {s: level * weight[s] for s in free}
        for s in over:
            target[s] = float(most * sizes[s])
            left -= target[s]
            free.discard(s)
    return target


def repaired_conversation(rows):
    """(gaps, blank, duplicate, truncated, illegal, cost, audit, sha256) of rows (turn, role, text) in order."""
    gap = " \t\n\x0b\x0c\r"
    seen, faults = set(), []
    for _, role, text in rows:
        rest = text.rstrip(gap)
        faults.append("blank" if not rest else "duplicate" if (role, text) in seen else "truncated" if rest[-1] not in ".!?" else "")
        seen.add((role, text))
    step = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
    role_of = {"u": "user", "a": "assistant"}
    # Best (cost, audit, repaired lines) to the end from each state, from the last row to the first.
    def inserted(best):
        for _ in range(4):
            for s in range(4):
                for who in "ua":
                    if (s, who) in step:
                        c, a, out = best[step[s, who]]
                        best[s] = min(best[s], (c + 5, "I" + a, (role_of[who] + ":", *out)))
        return best

    worst = (10**9, "", ())
    best = inserted([(0, "", ()), worst, worst, (0, "", ())])
    for (_, role, text), fault in reversed(list(zip(rows, faults, strict=True))):
        after, best = best, []
        for s in range(4):
            c, a, out = after[s]
            options = [(c + 2, "D" + a, out)]
            if fault not in ("blank", "duplicate"):
                more = 5 * (fault == "truncated")
                if (s, role[:1]) in step:
                    c, a, out = after[step[s, role[:1]]]
                    options.append((c + more, "K" + a, (f"{role}:{text}", *out)))
                for who in "ua":
                    if (s, who) in step:
                        c, a, out = after[step[s, who]]
                        options.append((c + 1 + more, "R" + a, (f"{role_of[who]}:{text}", *out)))
            best.append(min(options))
        best = inserted(best)
    turns = [t for t, _, _ in rows if t is not None]
    marks = [role[:1] for _, role, _ in rows]
    return (
        max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
        *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
        sum(a + b not in ("su", "ua", "au") for a, b in zip(marks, marks[1:], strict=False)),
        best[0][0],
        best[0][1],
        hashlib.sha256("\n".join(best[0][2]).encode()).hexdigest(),
    )


def ranked_documents(docs, items, top):
    """Rows (item_id, rank, doc_id, score) of distinct items over documents (doc_id, text)."""
    word = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    lower = {c: c + 32 for c in range(65, 91)}

    def terms(text):
        return word.findall((text or "").translate(lower))

    counts = [(d, Counter(terms(t))) for d, t in docs]
    counts = [(d, c) for d, c in counts if c]
    n_docs, total = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in dict.fromkeys(items):
        scored = []
        for d, c in counts:
            m = 100 - 50 + (50 * sum(c.values()) * n_docs) // total
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m))
                for t in set(terms(text)) if t in c
            )
            if score > 0:
                scored.append((-score, d is None, d or 0, d))
        out += [(item, n, d, -s) for n, (s, _, _, d) in enumerate(sorted(scored)[:top], 1)]
    return out
