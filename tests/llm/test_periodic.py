"""Periodic runs against a search of every period."""

import hashlib
import random
import zlib

from tests.llm.conftest import ODD
from tidewright.llm import periodic
from tidewright.llm.common import table
from tidewright.llm.queries import QUERIES


def brute(words):
    """(start, length, period) of every run, from the definition."""
    n, out = len(words), []
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if length >= max(24, 3 * q) and not any(all(words[x] == words[x + r] for x in range(i, i + length - r)) for r in range(1, q)):
                out.append((i, length, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def kept(words, runs):
    return [w for i, w in enumerate(words) if not any(s + q <= i < s + n for s, n, q in runs)]


def make(rng):
    """A text of random, repeated, nested and cut stretches over a small alphabet."""
    words = []
    for _ in range(rng.randint(1, 6)):
        kind = rng.random()
        root = rng.choices("abcd" if kind < 0.5 else [f"w{i}" for i in range(300)], k=rng.randint(1, rng.choice([1, 3, 9, 17, 40, 70])))
        words += root if kind > 0.85 else root * rng.randint(2, 12) + root[: rng.randint(0, len(root))]
        if rng.random() < 0.3:
            words += words[-rng.randint(1, len(words)) :] * rng.randint(1, 4)
    return words[:900]


def test_runs_by_brute_force(spark):
    rng = random.Random(5)
    made = [make(rng) for _ in range(250)] + [["a"] * 23, ["a"] * 24, ["a", "b"] * 12, list("abcdefgh") * 3, list("abcdefgh") * 3 + ["a"], list("abcdefghi") * 3, list("abcdefghi") * 2 + list("abcdefgh"), (["a"] * 30 + ["b"]) * 4]
    docs = spark.createDataFrame([(i, " \n".join(w)) for i, w in enumerate(made)], "doc_id long, text string").repartition(3)
    got = {r.doc_id: ([(x.start, x.length, x.period) for x in r.runs], r.collapsed) for r in periodic.find_runs(docs).collect()}
    for i, words in enumerate(made):
        runs = brute(words)
        assert got[i] == (runs, " ".join(kept(words, runs))), words
    assert sum(bool(r) for r, _ in got.values()) > 150


def row_of(doc_id, text):
    words = (text or "").encode().split()
    n, h = len(words), None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = brute(words)
    best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
    sha = lambda x: hashlib.sha256(x).hexdigest()
    top = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *top, sha("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()), sha(b" ".join(kept(words, runs))))


def test_query_by_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    got = {r.doc_id: tuple(r) for r in QUERIES["op11_periodic_runs"](spark, sf).collect()}
    rows = [r for r in table(spark, sf, "documents").select("doc_id", "text").collect() if len((r.text or "").split()) < 1200]
    for r in rows:
        assert got[r.doc_id] == row_of(*r)
    assert sum(got[r.doc_id][1] > 0 for r in rows) > 5


def test_odd_documents(spark, odd):
    got = sorted(map(str, map(tuple, periodic.digests(odd).collect())))
    short = [row for row in ODD if row[0] != 8]
    long = next(tuple(r) for r in periodic.digests(odd).where("doc_id = 8").collect())
    assert sorted([*map(str, (row_of(row[0], row[1]) for row in short)), str(long)]) == got
    assert long[1:6] == (1, 0, 60_000, 1, 60_000_000)


def test_z_function():
    rng = random.Random(2)
    for _ in range(200):
        x = rng.choices([0, 1], k=rng.randint(0, 30))
        assert periodic.z_function(x) == [next((k for k in range(len(x) - i) if x[k] != x[i + k]), len(x) - i) for i in range(len(x))]
