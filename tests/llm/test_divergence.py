"""The audit of sources against DuckDB and a plain computation, on odd rows and cut runs."""

import random
import re
from collections import Counter, defaultdict

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from geoweld.llm import divergence
from geoweld.llm.queries import ORACLE_SQL, op12_source_divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def by_hand(rows, least_docs=3, top_terms=200):
    """Every term of every pair, one after another."""
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        terms = TERM.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
        counts[lang, source].update(terms)
        docs[lang].update(set(terms))
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= least_docs]
        share = lambda c: {t: 1 + 10**9 * (c[t] + 1) // (sum(c[k] for k in kept) + len(kept)) for t in kept}
        f = lambda p, q: (p - q) ** 2 // q
        p = {s: share(counts[lang, s]) for s in sources}
        q = share(sum((counts[lang, s] for s in sources), Counter()))
        for s in sources:
            pair = [(sum(f(p[s][t], p[o][t]) for t in kept), o) for o in sources if o != s]
            term = [(f(p[s][t], q[t]), t) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pair, None), ("term", term, top_terms)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, v, r) for r, (v, item) in enumerate(found[:most], 1)]
    return sorted(out)


def odd_rows(rng, n):
    words = ["a", "The", "the", "naïve", "über", "x1y", "é", "日本", "zz"] + [f"w{chr(97 + i)}" for i in range(20)]
    text = lambda: " ".join(rng.choice(words) for _ in range(rng.randrange(12))) + rng.choice(["", ".", "\n\t", "--9"])
    rows = [(text(), rng.choice(["en", "en", "en", "de", None]), rng.choice(["s", "s", "s", "t", "u", None])) for _ in range(n)]
    return rows + [(None, "en", "s"), (None, "xx", "lone"), ("", "", ""), ("word " * 50000, "en", "t"), ("once only here", "yy", "a"), (None, "yy", "b")] + rows[:3]


@pytest.mark.parametrize("n", [8, 300])
def test_audit_equals_brute_force(spark, tmp_path, n):
    rows = odd_rows(random.Random(n), n)
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "text string, lang string, source string, TERM int, n int").repartition(5)
    got = sorted(map(tuple, divergence.audit(docs, top_terms=7).collect()))
    assert got == by_hand(rows, top_terms=7)
    docs.withColumn("doc_id", F.lit(1)).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    got = sorted(map(tuple, op12_source_divergence(spark, str(tmp_path)).collect()))
    assert got == sorted(con.execute(ORACLE_SQL["op12_source_divergence"]).fetchall()) == by_hand(rows)


def test_audit_of_nothing(spark):
    docs = spark.createDataFrame([], "text string, lang string, source string")
    assert divergence.audit(docs).collect() == []


def test_runs_that_batches_cut():
    rows = [("en", t, s, d, 1, n) for t in "aab" for s in "xxy" for d, n in ((1, 2), (2, 3))]
    rows.sort()
    for size in (1, 2, 3, 5, 50):
        batches = [pa.RecordBatch.from_pylist([dict(zip(divergence.COUNTED.names, r, strict=True)) for r in rows[i : i + size]], divergence.COUNTED) for i in range(0, len(rows), size)]
        got = [tuple(r.values()) for b in divergence.add_runs(iter(batches)) for r in b.to_pylist()]
        assert got == [("en", "a", "x", 8, 20), ("en", "a", "y", 4, 10), ("en", "b", "x", 4, 10), ("en", "b", "y", 2, 5)]
        runs = [t.num_rows for t, s in divergence._whole_runs(iter(batches), ["lang", "term"])]
        assert sum(runs) == len(rows) and all(r in (12, 6, 18) for r in runs)


def test_shares_of_large_counts():
    import numpy as np

    n, whole = np.array([0, 10**12, 3 * 10**14]), np.array([10**15, 10**13, 4 * 10**15])
    assert divergence.share(n, whole).tolist() == [1 + 10**9 * (a + 1) // b for a, b in zip(n.tolist(), whole.tolist(), strict=True)]
