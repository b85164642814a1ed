"""Collocations against counting every phrase."""

import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from tests.llm.conftest import ODD
from tidewright.llm import phrases
from tidewright.llm.queries import OP12_SQL, QUERIES


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def brute(docs, least, longest, top, subsumed=100):
    out = []
    for lang in {"und" if x is None else x for x, _ in docs}:
        f, n = Counter(), 0
        for x, text in docs:
            if ("und" if x is None else x) != lang:
                continue
            for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
                w = tuple(re.findall(r"[^\x20\x09]+", piece))
                n += len(w)
                f.update(w[i : i + m] for m in range(1, longest + 1) for i in range(len(w) - m + 1))
        found = {w: c for w, c in f.items() if len(w) > 1 and c >= least}
        rows = []
        for w, a in found.items():
            if any(len(v) > len(w) and 100 * c >= subsumed * a and any(v[i : i + len(w)] == w for i in range(len(v))) for v, c in found.items()):
                continue
            score, _, left, right = min((1000 * a * n // (f[w[:k]] * f[w[k:]]), k, f[w[:k]], f[w[k:]]) for k in range(1, len(w)))
            rows.append((" ".join(w), a, left, right, n, score))
        rows.sort(key=lambda r: (-r[5], -r[1], r[0].encode()))
        out += [(lang, i + 1, *r) for i, r in enumerate(rows[:top])]
    return sorted(out)


def made(rng, n):
    words = ["the", "The", "of", "and", "sea", "é", "x\x00y", "ocean", "A"] + [f"w{i}" for i in range(30)]
    stock = [" ".join(rng.choices(words, k=rng.randint(2, 7))) for _ in range(8)]
    text = lambda: "".join(rng.choice([*words, *stock]) + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", " - "]) for _ in range(rng.randint(0, 80)))
    return [(rng.choice(["en", "en", "en", "de", None, "und"]), None if rng.random() < 0.03 else text()) for _ in range(n)]


@pytest.mark.parametrize(("least", "longest", "top", "subsumed", "block"), [(5, 5, 2000, 100, 1 << 20), (5, 5, 7, 80, 3000), (12, 3, 2000, 100, 500), (2, 2, 50, 100, 1)])
def test_collocations_by_brute_force(spark, least, longest, top, subsumed, block):
    docs = made(random.Random(least), 150)
    df = spark.createDataFrame(docs, "lang string, text string").repartition(3)
    got = sorted(tuple(r) for r in phrases.collocations(df, least, longest, top, subsumed, block=block).collect())
    assert got == brute(docs, least, longest, top, subsumed)
    assert got


def test_hot_prefixes_are_split(spark, monkeypatch):
    docs = made(random.Random(9), 100)
    words = np.array([[1, x] for x in range(1000)] + [[2, 5]])
    parts = {p for p, *_ in phrases.stripes(words, np.ones(1001, np.int64), np.full(1001, phrases.WHOLE * 64), 16)}
    assert len(parts) > 8
    monkeypatch.setattr(phrases, "WHOLE", 2)  # every stripe is cut into slices
    df = spark.createDataFrame(docs, "lang string, text string")
    assert sorted(tuple(r) for r in phrases.collocations(df, 4, block=2000).collect()) == brute(docs, 4, 5, 2000)


def test_sums_past_64_bits(spark):
    df = spark.createDataFrame([("en", "a b " * 3)], "lang string, text string")
    got = phrases.collocations(df, 1, 2).collect()
    assert {(r.phrase, r.a, r.l, r.r, r.n, r.score) for r in got} == {("a b", 3, 3, 3, 6, 2000), ("b a", 2, 3, 3, 6, 1333)}


def test_odd_documents(spark, odd):
    rows = sorted(tuple(r) for r in phrases.collocations(odd, 2).collect())
    short = [(r[2], r[1]) for r in ODD]
    assert rows == brute(short, 2, 5, 2000)


def test_sql_of_the_query(spark, tmp_path):
    """The registered SQL and the query over a table of its own, where phrases nest and tie."""
    rng = random.Random(4)
    docs = [(i, t * 4 if t else t, x) for i, (x, t) in enumerate(made(rng, 250))]
    spark.createDataFrame(docs, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = sorted(con.execute(f"SELECT lang, rank, phrase, a, l, r, n, score FROM ({OP12_SQL})").fetchall())
    got = sorted(tuple(r) for r in QUERIES["op12_phrases"](spark, str(tmp_path)).collect())
    assert got == want and got
