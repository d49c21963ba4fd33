"""Periodic runs against brute force."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from geoweld.llm import runs
from geoweld.llm.queries import op11_periodic_runs

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DIR = "/root/testdata/sf0.001"


def runs_by_hand(words, least=6, power=4):
    """(start, length, period) of every stretch, by comparing all words p apart."""
    out = {}
    for p in range(1, len(words) // power + 1):
        i = 0
        while i + p < len(words):
            j = i
            while j + p < len(words) and words[j] == words[j + p]:
                j += 1
            if j > i and j + p - i >= max(least, power * p):
                out.setdefault((i, j + p), p)
            i = j + 1 if j == i else j
    return sorted((s, e - s, p) for (s, e), p in out.items())


def collapsed_by_hand(words, found):
    gone = {i for s, n, p in found for i in range(s + p, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def repetitive(rng):
    words = []
    while rng.random() < 0.8:
        block = [rng.choice("abc") for _ in range(rng.randrange(1, 7))]
        words += block * rng.randrange(1, 8)
    return words


@pytest.mark.parametrize(("least", "power"), [(6, 4), (4, 2), (6, 3), (10, 5)])
def test_runs_equal_brute_force(least, power):
    rng = random.Random(least)
    for _ in range(150):
        texts = [repetitive(rng) for _ in range(rng.randrange(1, 6))]
        flat = np.array([ord(c) for t in texts for c in t], np.int64)
        got = runs.maximal_runs(flat, np.array([len(t) for t in texts]), least, power)
        assert [tuple(r) for r in got.tolist()] == [(i, *r) for i, t in enumerate(texts) for r in runs_by_hand(t, least, power)]


def test_runs_of_odd_texts(spark):
    rng = random.Random(4)
    texts = [None, "", " \n\t ", "one", "a a a a a", "a a a a a a", "Ünï ünï " * 3 + "Ünï", "x y " * 6, "a b " * 40000, "w" * 300000, *([" ".join(repetitive(rng))] * 2)]
    texts += [" ".join(repetitive(rng)) for _ in range(30)]
    docs = spark.createDataFrame([(i, t, "clash", 3) for i, t in enumerate(texts)], "doc_id long, text string, RUNS string, found int")
    got = {r.doc_id: r for r in runs.with_runs(docs).collect()}
    assert len(got) == len(texts) and set(got[0].asDict()) == {"doc_id", "text", "found", "n_words", "runs", "collapsed"}
    for i, t in enumerate(texts):
        words = WORD.findall(t or "")
        found = [(0, 80000, 2)] if i == 8 else runs_by_hand(words)
        assert [tuple(r) for r in got[i].runs] == found and got[i].n_words == len(words)
        assert got[i].collapsed == collapsed_by_hand(words, found)
    assert runs.with_runs(docs.limit(0)).collect() == []


def test_query_equals_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    odd = spark.createDataFrame([(None, "a " * 9), (10**15, None), (8, ""), (8, "b c " * 7)], "doc_id long, text string")
    docs.unionByName(odd, allowMissingColumns=True).write.parquet(f"{tmp_path}/documents.parquet")
    rows = spark.read.parquet(f"{tmp_path}/documents.parquet").collect()
    want, planted = [], 0
    for r in rows:
        words = WORD.findall(r.text or "")
        n, h = len(words), None if r.doc_id is None else zlib.crc32(str(r.doc_id).encode())
        if h is not None and h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
            planted += 1
        found = runs_by_hand(words)
        best = min(found, key=lambda x: (-x[1], x[0], x[2]), default=None)
        digest = [hashlib.sha256(x.encode()).hexdigest() for x in ("".join(f"{s},{n},{p}\n" for s, n, p in found), collapsed_by_hand(words, found))]
        want.append((r.doc_id, len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, *digest))
    got = op11_periodic_runs(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert {d for c, d in got.dtypes if not c.endswith("sha256")} == {"bigint"}
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want)) and planted > 5
    assert got.where(F.col("n_runs") > 0).count() > 5
