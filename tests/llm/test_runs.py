"""Periodic runs against a version that tries every period, on texts that repeat in many ways."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np

from cellpath.llm import runs
from cellpath.llm.queries import op12_periodic_runs, table

DOCS = "doc_id long, text string, runs string, n_words int"


def slow_runs(words):
    """start, length, period: every maximal stretch of every period; of equal stretches the smallest period."""
    found = {}
    for q in range(1, len(words) // 4 + 1):
        k = 0
        while k < len(words) - q:
            start = k
            while k < len(words) - q and words[k] == words[k + q]:
                k += 1
            if k - start + q >= max(6, 4 * q):
                found.setdefault((start, k - start + q), q)
            k += 1
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def slow_row(doc_id, words):
    found = slow_runs(words)
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
    return (
        doc_id, len(found), *((best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4),
        sha("".join(f"{s},{n},{q}\n" for s, n, q in found)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)),
    )


def slow_words(doc_id, text):
    """Words of the registered query's texts."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    return words


def test_query_on_all_documents(spark, sf_dir, documents, rows):
    found = rows(op12_periodic_runs(spark, sf_dir))
    wanted = [slow_row(i, slow_words(i, t)) for i, t in documents]
    assert sorted(found, key=str) == sorted(wanted, key=str)
    assert sum(r[1] for r in found) > 5


def _texts(rng):
    low = rng.randint(1, 3)
    some = lambda n: [rng.randint(0, low) for _ in range(n)]
    kind = rng.randint(0, 4)
    if kind == 0:
        return some(rng.randint(0, 70))
    if kind == 1:
        part = some(rng.randint(1, 13))
        return some(rng.randint(0, 9)) + part * rng.randint(1, 9) + part[: rng.randint(0, 12)] + some(rng.randint(0, 9))
    if kind == 2:  # a period that itself holds long runs of a short one
        part = [0] * rng.randint(1, 14) + [1] * rng.randint(0, 2) + [0] * rng.randint(0, 9) + [rng.randint(0, 2)]
        return (part * rng.randint(3, 6))[rng.randint(0, 5) :]
    if kind == 3:
        part = [0, 1] * rng.randint(1, 6) + [rng.randint(0, 2)]
        return part * rng.randint(3, 6) + [0] * rng.randint(0, 8)
    word = [0]
    for _ in range(rng.randint(3, 6)):  # unkind to polynomial hashes
        word = word + [1 - v for v in word]
    return word * rng.randint(1, 5)


def test_many_small_arrays():
    rng = random.Random(11)
    for _ in range(600):
        texts = [_texts(rng) for _ in range(rng.randint(1, 4))]
        row = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
        place = np.concatenate([np.arange(len(t)) for t in texts]).astype(np.int64)
        symbols = runs._symbols(np.array([v for t in texts for v in t], np.uint64), row)
        start, end, period = runs.find_runs(symbols, place)
        base = np.cumsum([0] + [len(t) for t in texts])
        wanted = [(s + base[i], n, q) for i, t in enumerate(texts) for s, n, q in slow_runs(t)]
        assert list(zip(start.tolist(), (end - start).tolist(), period.tolist())) == wanted


def test_hashes_that_err(monkeypatch):
    """With hashes that take all stretches for equal, comparing words gives the same runs."""
    monkeypatch.setattr(runs._Stretches, "_equal", lambda self, i, j, n: np.ones(len(n), np.bool_))
    words = [9, 0, 1, 0, 1, 0, 1, 0, 1, 0, 1, 7, 8]
    start, end, period = runs.find_runs(runs._symbols(np.array(words, np.uint64), np.zeros(13, np.int64)), np.arange(13))
    assert (start.tolist(), end.tolist(), period.tolist()) == ([1], [11], [2])


def test_odd_rows(spark, rows):
    long = "a b c " * 40_000
    texts = [None, "", " \t\n", "x", "x x x x x", "x x x x x x", "é é\té\r\né é é é", "A a A a A a A a", long, "x x x x x x"]
    docs = spark.createDataFrame([(i if i < 9 else 5, t, "r", 1) for i, t in enumerate(texts)] + [(None, "z z z z z z z", "r", 1)], DOCS)
    found = rows(runs.periodic_runs(docs).select("doc_id", "n_words", "runs", "collapsed"))
    plain = {(i, n, tuple(map(tuple, r)), c) for i, n, r, c in found}
    assert len(found) == 11
    assert plain == {
        (0, 0, (), ""), (1, 0, (), ""), (2, 0, (), ""), (3, 1, (), "x"), (4, 5, (), "x x x x x"), (5, 6, ((0, 6, 1),), "x"),
        (6, 7, ((0, 7, 1),), "é"), (7, 8, ((0, 8, 2),), "A a"), (8, 120_000, ((0, 120_000, 3),), "a b c"), (None, 7, ((0, 7, 1),), "z"),
    }
    assert runs.digest(runs.periodic_runs(docs.limit(0))).count() == 0
    assert runs.digest(runs.periodic_runs(docs.where("doc_id = 0"))).first().runs_sha256 == hashlib.sha256(b"").hexdigest()
