"""The pipeline over a small corpus, each stage held against what it should have done to its own input."""

import hashlib
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import regex
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(12)
    letters = {"en": ["the", "ing", "wa", "or"], "fr": ["é", "eau", "que", "tion"]}
    rows = []
    for i in range(160):
        lang = rng.choice(["en", "fr"])
        rows.append((i, " ".join("".join(rng.choices(letters[lang], k=rng.randrange(1, 5))) for _ in range(rng.randrange(30, 120))), lang, f"src{i % 3}"))
    rows += [(200 + i, rows[i][1], rows[i][2], "src0") for i in range(20)]  # copies
    rows += [(300 + i, rows[i][1] + " queeau", rows[i][2], "src1") for i in range(20, 30)]  # near copies
    rows += [(400, "short", "en", "src0"), (401, None, None, None), (402, "12 " * 50, "en", None)]
    where = tmp_path_factory.mktemp("corpus")
    df = spark.createDataFrame([(i, t, g, s, len(t or "")) for i, t, g, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    df.repartition(3).write.parquet(f"{where}/documents.parquet")
    return str(where)


def test_stages(spark, corpus, tmp_path):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, corpus).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "pack":
            assert docs.columns == columns
        seen[name] = docs.collect()
    ids = {k: {r.doc_id for r in v} for k, v in seen.items()}
    assert {400, 401, 402}.isdisjoint(ids["quality"]) and set(range(160)) <= ids["quality"]
    assert len(ids["quality"] - ids["language"]) <= 2
    assert ids["near_duplicates"] == {i for i in ids["language"] if i < 200 or (200 <= i < 220 and i - 200 not in ids["language"]) or (i >= 300 and i - 300 not in ids["language"])}
    words = lambda rows: sum(len(WORD.findall(r.text)) for r in rows)
    longest = max(len(WORD.findall(r.text)) for r in seen["near_duplicates"])
    whole = 1.5 * words(seen["near_duplicates"])
    assert whole - 3 <= words(seen["mix"]) <= whole + 3 * longest
    assert ids["pack"] == ids["mix"]


def kept_by_quality(text):
    w = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    hit = {j for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    ends = sum(bool(re.search(r"[.!?:;…\"')\]»”][\x20\x09-\x0D]*$", x)) for x in lines)
    return not (
        len(w) < 20 or 100 * len(hit) > 30 * len(w) or 10 * sum(c in "#*$%&|<>" for c in text) > len(w)
        or 10 * sum(x == x.upper() != x.lower() and len(x) > 1 for x in w) > 4 * len(w) or 10 * sum(bool(regex.search(r"\p{L}", x)) for x in w) < 8 * len(w)
        or not 1.5 * len(w) <= sum(map(len, w)) <= 40 * len(w) or 10 * (len(lines) - len(set(lines))) > 8 * len(lines) or (len(lines) >= 5 and 10 * ends < len(lines))
    )


def one_of_each(docs):
    sets = {}
    for r in docs:
        w = [x.translate({c: c + 32 for c in range(65, 91)}) for x in WORD.findall(r.text)]
        sets[r.doc_id] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}
    of = {i: i for i in sets}
    for i in sets:
        for j in sets:
            if i < j and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                low, high = sorted((of[i], of[j]))
                of = {k: low if v == high else v for k, v in of.items()}
    return [r for r in docs if of[r.doc_id] == r.doc_id]


def mixed(docs):
    sizes = Counter()
    for r in docs:
        sizes[r.source] += len(WORD.findall(r.text))
    order = sorted(sizes, key=lambda x: (x is None, (x or "").encode()))
    weight = {x: (3.0, 1.0, 2.0)[i % 3] for i, x in enumerate(order)}
    target, open_, left = {}, set(order), 1.5 * sum(sizes.values())
    while open_:
        share = {x: left * weight[x] / sum(weight[y] for y in open_) for x in open_}
        full = {x for x in open_ if share[x] > 2 * sizes[x]}
        target |= {x: 2.0 * sizes[x] for x in full} if full else share
        left -= sum(target[x] for x in full)
        open_ = open_ - full if full else set()
    out = []
    for x in order:
        own = [(hashlib.md5("|".join(["11", str(r.doc_id), *([] if x is None else [x])]).encode()).hexdigest(), r) for r in docs if r.source == x]
        budget, before = int(target[x]), 0
        epochs, rest = divmod(budget, sizes[x])
        for _, r in sorted(own, key=lambda p: p[0]):
            n = len(WORD.findall(r.text))
            out += [r] * -(-(epochs * n + max(0, min(n, rest - before))) // n)
            before += n
    return out


def test_run_equals_brute_force(spark, corpus):
    rows = [r for r in spark.read.parquet(f"{corpus}/documents.parquet").collect() if kept_by_quality(r.text)]
    told = {r.doc_id for r in corpus_pipeline.language(spark, spark.createDataFrame(rows), corpus).collect()}  # a learned model has no brute-force form
    docs = mixed(one_of_each([r for r in rows if r.doc_id in told]))
    encode = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter()
    for r in docs:
        ids = np.array([*encode.encode(r.text, add_special_tokens=False).ids, 0], "<u4")
        for piece, start in enumerate(range(0, len(ids), 2048)):
            part = ids[start : start + 2048]
            want[r.doc_id, piece, start, len(part), zlib.crc32(part.tobytes())] += 1
    out = corpus_pipeline.run(spark, corpus)
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    got = out.collect()
    assert Counter(tuple(r)[:5] for r in got) == want
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for members in bins.values():
        ends = [0, *(a + n for a, n in sorted(members))]
        assert [a for a, _ in sorted(members)] == ends[:-1] and ends[-1] <= 2048


def test_without_documents(spark, corpus, tmp_path):
    empty = spark.read.parquet(f"{corpus}/documents.parquet").where(F.lit(False))
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, corpus).count() == 0
        assert os.path.isdir(corpus), name
