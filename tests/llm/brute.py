"""What the operators should return, computed row by row in plain Python."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter
from html import unescape

import numpy as np

SPACE_WORDS = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM_WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text: str | None) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


class Sets:
    """Disjoint sets; each named by its smallest id."""

    def __init__(self, ids):
        self.ids, self.up = ids, list(range(len(ids)))

    def find(self, i):
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i, j):
        self.up[self.find(i)] = self.find(j)

    def least(self):
        best = {}
        for i, name in enumerate(self.ids):
            best[self.find(i)] = min(best.get(self.find(i), name), name)
        return [best[self.find(i)] for i in range(len(self.ids))]


def near_duplicates(docs):
    sets = []
    for _, text in docs:
        w = SPACE_WORDS.findall(lower(text))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    holders, groups = {}, Sets([d for d, _ in docs])
    for i, s in enumerate(sets):
        common = Counter(j for x in s for j in holders.get(x, ()))
        for j, n in common.items():
            if 100 * n >= 75 * (len(s) + len(sets[j]) - n):
                groups.join(i, j)
        for x in s:
            holders.setdefault(x, []).append(i)
    return sorted((d, len(s), c, c == d) for (d, _), s, c in zip(docs, sets, groups.least()))


def contamination(docs, items, window=10):
    known = {}
    for item, text in items:
        w = ALNUM_WORDS.findall(lower(text))
        n = min(window, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            known.setdefault(n, {}).setdefault(tuple(w[k : k + n]), set()).add(str(item))
    out = []
    for doc, text in docs:
        w, hit, found = ALNUM_WORDS.findall(lower(text)), set(), set()
        for n, table in known.items():
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in table:
                    hit.update(range(k, k + n))
                    found |= table[tuple(w[k : k + n])]
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out)


def luhn(digits):
    doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(x - 9 * (x > 9) for x in doubled) % 10 == 0


def personal_data(docs):
    patterns = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }

    def holds(kind, match):
        digits = re.sub("[^0-9]", "", match)
        if kind == "ip":
            return all(int(x) <= 255 for x in match.split("."))
        if kind == "card":
            return 16 <= len(digits) <= 19 and luhn(digits)
        return kind == "email" or 8 <= len(digits) <= 15

    out = []
    for doc, text in docs:
        spans = [(k, m.start(), m.end()) for k, p in patterns.items() for m in re.finditer(p, text or "") if holds(k, m[0])]
        digest = hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in spans).encode()).hexdigest()
        out.append((doc, *(sum(s[0] == k for s in spans) for k in patterns), digest))
    return sorted(out)


def token_rows(docs, tokenizer, end):
    """(doc_id, ids with the end id) in order of ids."""
    return [(d, [*tokenizer.encode(t or "", add_special_tokens=False).ids, end]) for d, t in sorted(docs, key=lambda x: (x[0], x[1] or ""))]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def scores(docs, prior, least=2):
    rows = [(d, zlib.crc32(str(d).encode()) % 7 == 2, [*SPACE_WORDS.findall(lower(t)), None]) for d, t in docs]
    one, two, three = Counter(), Counter(), Counter()
    for _, held, w in rows:
        if not held:
            one.update(w)
            two.update(zip([None, *w[:-1]], w))
            three.update(zip([None, *w[:-2]], w[:-1], w[1:]))
    n, v = sum(one.values()), len(one)

    def p(w):
        return (one[w] + 1) / (n + v + 1)

    def p2(b, w):
        return (two[b, w] + prior * p(w)) / (one[b] + prior)

    def p3(a, b, w):
        if two[a, b] < least:
            return p2(b, w)
        return (three[a, b, w] + prior * p2(b, w)) / (two[a, b] + prior)

    out = []
    for d, held, w in rows:
        base = sum(math.log10(p(x)) for x in w)
        full = math.log10(p2(None, w[0])) + sum(math.log10(p3(*x)) for x in zip([None, *w[:-2]], w[:-1], w[1:]))
        out.append((d, held, len(w), sum(one[x] > 0 for x in w), n, base, full))
    return sorted(out)


def near_vectors(rows, threshold=0.95):
    sound = [
        i for i, (_, v) in enumerate(rows) if v and all(x is not None and math.isfinite(x) for x in v) and any(v)
    ]
    groups, links = Sets([r[0] for r in rows]), [0] * len(rows)
    unit = {i: np.array(rows[i][1]) / max(abs(x) for x in rows[i][1]) for i in sound}
    unit = {i: v / np.sqrt(v @ v) for i, v in unit.items()}
    for a in sound:
        for b in sound:
            if a < b and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= threshold:
                links[a] += 1
                links[b] += 1
                groups.join(a, b)
    return sorted((r[0], n, c, c == r[0]) for r, n, c in zip(rows, links, groups.least()))


def article(page):
    """Text of the article of a generated page."""
    inner = re.search(r"<article>(.*)</article>", page, re.S)[1]
    return " ".join(unescape(re.sub("<[^>]*>", "", re.sub(r"</?(?:p|h1|br)>", " ", inner))).split())
