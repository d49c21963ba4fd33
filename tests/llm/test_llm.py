"""The training-data operators against brute force, and on nulls, empty and odd rows."""

import json
import os
import random
import re
import time
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from geoweld.llm import ann, html_text, language_id, licenses, mixing, ngram_join, packing, quality_rules, tokens, url_filters
from geoweld.operators.components import connected_components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def documents(spark, texts, sources=None, langs=None):
    sources = sources or ["s"] * len(texts)
    langs = langs or ["en"] * len(texts)
    return spark.createDataFrame([(i, t, g, s, None if t is None else len(t)) for i, (t, g, s) in enumerate(zip(texts, langs, sources, strict=True))], DOCS)


def prose(rng, n, words=200):
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


ODD = [None, "", " \n\t ", "one", "a b c", "Ünïcode — «words»  x", "x" * 5000, "dup line here now\n" * 40]


# --- 1 mixing -------------------------------------------------------------------------


def targets_by_hand(sizes):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3.0, 1.0, 2.0)[i % 3] for i, s in enumerate(order)}
    target, open_, left = {}, set(order), 1.5 * sum(sizes.values())
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = {s for s in open_ if share[s] > 2 * sizes[s]}
        if not full:
            return target | share
        for s in full:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        open_ -= full
    return target


def test_mixing_targets_and_cut(spark):
    rng = random.Random(2)
    texts = [prose(rng, rng.randrange(0, 40)) for _ in range(300)] + ODD
    sources = [rng.choice(["a", "a", "a", "a", "b", "c", "d", None]) for _ in texts]
    docs = documents(spark, texts, sources).withColumn("size", F.lit("clash")).withColumn("taken", F.lit(1))
    got = mixing.mixed(docs, mixing.word_count(F.col("text"))).collect()
    sizes = Counter()
    for t, s in zip(texts, sources, strict=True):
        sizes[s] += len(WORD.findall(t or ""))
    want = targets_by_hand(sizes)
    assert len(got) == len(texts)
    for s in sizes:
        rows = [r for r in got if r.source == s]
        assert all(r.target == pytest.approx(want[s]) and r.source_size == sizes[s] for r in rows)
        assert sum(r.taken for r in rows) == int(rows[0].target)
        assert all(0 <= r.taken <= 2 * r.size for r in rows)
    again = mixing.mixed(docs.repartition(7), mixing.word_count(F.col("text"))).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_mixing_of_rows_without_ids(spark):
    rng = random.Random(5)
    texts = [prose(rng, rng.randrange(1, 30)) for _ in range(200)] + [prose(rng, 9)] * 40 + ["w " * 20000]
    docs = documents(spark, texts, [rng.choice("ab") for _ in texts]).withColumn("doc_id", F.lit(None).cast("long")).withColumn("copy", F.lit(1)).withColumn("of_text", F.lit(2))
    sizes = Counter()
    for r in docs.collect():
        sizes[r.source] += len(WORD.findall(r.text))
    got = mixing.mixed(docs.repartition(4), mixing.word_count(F.col("text"))).collect()
    assert len(got) == len(texts)
    for s in sizes:
        assert sum(r.taken for r in got if r.source == s) == int(next(r.target for r in got if r.source == s))
    made = mixing.mix_documents(docs, mixing.word_count(F.col("text"))).collect()
    again = mixing.mix_documents(docs.repartition(3), mixing.word_count(F.col("text"))).collect()
    assert sorted(map(str, made)) == sorted(map(str, again)) and made[0].copy == 1 and made[0].of_text == 2
    target = targets_by_hand(sizes)
    longest = {s: max(Counter(r.text for r in made if r.source == s).get(t, 0) * len(WORD.findall(t)) for t in set(r.text for r in made if r.source == s)) for s in sizes}
    for s in sizes:
        assert target[s] - 1 <= sum(len(WORD.findall(r.text)) for r in made if r.source == s) <= target[s] + longest[s]


def test_mixing_empty_and_repeats(spark):
    empty = documents(spark, []).limit(0)
    assert mixing.mixed(empty, mixing.word_count(F.col("text"))).count() == 0
    twice = documents(spark, ["a b", "c d e"]).union(documents(spark, ["a b", "c d e"]))
    got = mixing.mixed(twice, mixing.word_count(F.col("text"))).collect()
    assert len(got) == 4 and sum(r.taken for r in got) == 15
    made = mixing.mix_documents(documents(spark, ["a b", "c d e", ""]), mixing.word_count(F.col("text")))
    assert made.columns == DOCS.replace(",", "").split()[::2]
    assert Counter(r.doc_id for r in made.collect())[2] == 1


# --- 2 nearest neighbours ------------------------------------------------------------------


def test_multi_index_finds_every_code_within_the_radius():
    rng = np.random.default_rng(0)
    codes = rng.integers(0, 256, (500, 8)).astype(np.uint8)
    index = ann.MultiIndex(codes)
    for radius in (0, 5, 17, 26, 64):
        code = codes[7] ^ np.packbits(rng.random(64) < 0.1)
        bits = np.unpackbits(codes ^ code, axis=1).sum(axis=1)
        assert index.within(code, radius).tolist() == np.flatnonzero(bits <= radius).tolist()


def test_ann_recall_ties_and_odd_rows(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(1500, 16)) * rng.uniform(0.5, 2, (1500, 1))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(2000 + i, x[0].tolist()) for i in range(30)] + [(3000, None), (3020, [0.0] * 16), (3040, [float("nan")] * 16), (3060, [1.0, None] * 8), (3080, [1.0]), (None, x[1].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("x", F.lit(1))
    got = ann.nearest(df, 20, 20).collect()
    good = {i: np.array(v) for i, v in rows if i is not None and i < 3000}
    ids, m = np.array(list(good)), np.array(list(good.values()))
    found = {}
    for r in got:
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(found) == {i for i in good if i % 20 == 0}
    hits = 0
    for q, near in found.items():
        near.sort()
        assert [n[0] for n in near] == list(range(1, 21)) and q not in {n[1] for n in near}
        assert [(-s, i) for _, i, s in near] == sorted((-s, i) for _, i, s in near)
        score = m @ good[q]
        top = [i for i in ids[np.lexsort((ids, -score.round(9)))] if i != q][:20]
        hits += len(set(top) & {n[1] for n in near})
    assert hits / (20 * len(found)) >= 0.9
    few = ann.nearest(df.where("vec_id < 5"), 20, 20).collect()
    assert sorted(r.vec_id for r in few) == [1, 2, 3, 4]
    assert ann.nearest(df.limit(0)).count() == 0


def test_ann_recall_on_the_table(spark):
    where = "/root/testdata/sf0.01/embeddings.parquet"
    if not os.path.exists(where):
        pytest.skip("no tables")
    df = spark.read.parquet(where)
    rows = [(r.vec_id, np.array(r.embedding, float)) for r in df.collect() if r.vec_id is not None and r.embedding is not None and None not in r.embedding]
    rows = [(i, v) for i, v in rows if len(v) == 64 and np.isfinite(v).all() and v.any()]
    ids, m = np.array([i for i, _ in rows]), np.array([v for _, v in rows])
    hits = asked = 0
    found = {}
    for r in ann.nearest(df).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    for q, v in rows:
        if q % 20 == 0:
            score = m @ v
            top = [i for i in ids[np.lexsort((ids, -score))] if i != q][:20]
            hits, asked = hits + len(found[q] & set(top)), asked + len(top)
    assert asked and hits / asked >= 0.9


# --- 3 html -------------------------------------------------------------------------------------


def page(n, article, extra=""):
    return f"""<!DOCTYPE html><html><head><title>T</title><script>var a="</p><p>no";</script><style>p{{}}</style></head><body>
<header class="site-header"><h1>Site</h1></header><nav><ul><li><a href="/a">Menu {n}</a></li></ul></nav><div class="cookie-notice">We use cookies</div>
<div id="sidebar"><p>Side {n}</p></div><article><h2>Head {n}</h2>{article}<section class="comments"><article><p>reader {n}</p></article></section></article>{extra}
<form><p>Search</p></form><div class="ad">Buy {n}</div><footer>&copy; x</footer></body></html>"""


def test_html_keeps_the_article(spark):
    rows = [(i, f"https://h.example/{i}", page(i, f"<p>One  &amp; <b>two</b><br>\n{i} &lt;x&gt;<p>next")) for i in range(12)]
    rows += [(50, None, None), (51, "odd", ""), (52, "https://solo.example/", page(52, "<p>alone</p>")), (53, "https://h.example/z", "<p>bare <i>text")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash")).withColumn("host", F.lit(1))
    got = {r.page_id: r for r in html_text.extracted(df).collect()}
    assert got[3].text == "Head 3\n\nOne & two 3 <x>\n\nnext" and got[3].n_chars == len(got[3].text)
    assert got[50].text == "" and got[51].text == "" and got[52].text == "Head 52\n\nalone" and got[53].text == "bare text"
    assert html_text.extracted(df.limit(0)).count() == 0


def test_html_template_drops_fixed_wording_and_link_slots(spark):
    body = lambda i: f"<html><body><div class='x1'><a href='/'>Home {i}</a> <a href='/n'>News {i}</a></div><div class='x2'>Always the same words</div><div class='x3'><p>Own words {i} of a story</p></div></body></html>"
    df = spark.createDataFrame([(i, "http://t.example/a", body(i)) for i in range(8)], "page_id long, url string, html string")
    assert {r.text for r in html_text.extracted(df).collect()} == {f"Own words {i} of a story" for i in range(8)}


def texts_of_pages(spark, bodies):
    df = spark.createDataFrame([(i, "http://t.example/a", f"<html><body>{b}</body></html>") for i, b in enumerate(bodies)], "page_id long, url string, html string")
    return [r.text for r in html_text.extracted(df).orderBy("page_id").collect()]


def test_html_template_is_of_valid_classes_only(spark):
    def body(i):
        shared = ["<p>Storm hits the coast</p>", "<p>Rain is to follow</p>"][:: 1 if i % 2 else -1] if i < 5 else []
        alone = ["<p>Markets were closed</p>"] if i > 1 else []
        return f"<div class='x2'>Always the same words</div><div class='x3'><p>Own words {i} of a story</p>{''.join(shared + alone)}</div>"

    for i, text in enumerate(texts_of_pages(spark, map(body, range(8)))):
        assert "Always" not in text and f"Own words {i}" in text
        assert ("Storm" in text) == ("Rain" in text) == (i < 5)  # one class, in no order
        assert ("Markets" in text) == (i > 1)  # a class of one token


def test_html_keeps_articles_beside_long_menus_and_of_near_copies(spark):
    menu = lambda i: f"<ul>{''.join(f'<li><a href=/{k}>Menu entry number {k} of {i}</a></li>' for k in range(12))}</ul>"
    got = texts_of_pages(spark, [f"<div class='w'>{menu(i)}<article><p>Short story {i}</p></article></div>" for i in range(6)])
    assert got == [f"Short story {i}" for i in range(6)]
    got = texts_of_pages(spark, [f"<div class='w'>{menu(i)}<div class='y'>Short story {i}</div></div>" for i in range(6)])
    assert got == [f"Short story {i}" for i in range(6)]
    told = [f"Paragraph {k} of the story that many pages of this host have copied" for k in "abcd"]
    stories = [[*told, f"A changed end, {i}"] for i in range(6)] + [[f"Other story {i}", f"It goes on {i}"] for i in range(4)]
    frame = lambda s: f"<div class='x2'>Always the same words</div><div class='x3'>{''.join(f'<p>{x}</p>' for x in s)}</div>"
    assert texts_of_pages(spark, map(frame, stories)) == ["\n\n".join(s) for s in stories]


@pytest.mark.parametrize("body", [
    '<article class="post comments-open"><p>Real</p></article>', '<article class="post has-sidebar"><p>Real</p></article>', '<div class="content with-sidebar"><p>Real</p></div>',
    '<article id="research-notice-12"><p>Real</p></article>', '<svg class="i"/><p>Real</p>', "<video-player></video-player><p>Real</p>", "<title-bar></title-bar><p>Real</p>",
    '<div><object data="x"><p>gone</p></div><p>Real</p>', '<p><label>Real</label></p><form><label>gone</label></form>', '<article class="teaser"><p>a</p></article><div><p>Real</p></div>',
    '<section class="comments"><article><p>gone</p></article></section><article><p>Real</p></article>', "<svg><text>gone</text></svg><iframe/><p>Real</p>", '<div class="site-footer">gone</div>Real',
])
def test_html_loses_no_text(body):
    assert html_text.main_text(f"<html><body>{body}</body></html>", html_text.Template([])) == "Real"


def test_html_firm_template_cuts_into_marked_parts(spark):
    more = "<div class='m'>Share this story with friends</div><ul class='r'><li><a href='/x'>Other story {i}</a></li><li><a href='/y'>One more {i}</a></li></ul>"
    bodies = lambda n: [f"<article><p>Own words {i} of a story</p>{more.format(i=i)}<p>And its end {i}</p></article>" for i in range(n)]
    assert texts_of_pages(spark, bodies(8)) == [f"Own words {i} of a story\n\nAnd its end {i}" for i in range(8)]
    assert all("Share" in t for t in texts_of_pages(spark, bodies(3)))  # three pages are too few to be sure


@pytest.mark.parametrize("piece", ["<div>x", "<a '", "<a '>", "<svg>", "</p>", "<b><hr>", "<p><div><b>", "<!", "&#1", "<li>x", "</svg ", '<a href="x">y'])
def test_html_takes_time_and_memory_by_length(piece):
    page = piece * (1_000_000 // len(piece))
    tracemalloc.start()
    began = time.perf_counter()
    html_text.main_text(page, html_text.Template([]))
    took, most = time.perf_counter() - began, tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert took < 30 and most < 200e6  # tracing slows it down several times


def test_html_of_references_beyond_any_character():
    assert html_text.main_text(f"a &#{'1' * 6000}; &#{'0' * 6000}65; b", html_text.Template([])) == "a \ufffd A b"


def classes_by_hand(pages):
    """Element and text tokens of one host's pages by their whole occurrence vectors: {token: (class, once a page, is text)}."""
    counts, text = {}, {}
    for k, page in enumerate(pages):
        tokens, _, chars, _, _ = html_text.page_sequence(page)
        for t, n in zip(tokens, chars, strict=True):
            counts.setdefault(t, [0] * len(pages))[k] += 1
            text[t] = n >= 0
    by_vector = {}
    for t, vector in counts.items():
        on = sum(n > 0 for n in vector)
        if on > 1 and 2 * on >= len(pages):
            by_vector.setdefault(tuple(vector), []).append(t)
    return {t: (vector, max(vector) == 1, text[t]) for vector, ts in by_vector.items() if len(ts) > 1 for t in ts}


def valid_by_hand(pages, known):
    """Vectors of classes whose tokens come in one order, over and over, in one slot of one other class, on nine tenths of their pages."""
    good = set()
    for vector in {v for v, once, text in known.values()}:
        shapes = Counter()
        for page in pages:
            tokens, around, chars, _, _ = html_text.page_sequence(page)
            own = [i for i, t in enumerate(tokens) if t in known and known[t][0] == vector and (known[t][1] or not known[t][2])]
            size = len({t for t, x in known.items() if x[0] == vector and (x[1] or not x[2])})
            if not own:
                continue
            order = [tokens[i] for i in own]
            regular = len(set(order[:size])) == size and order == order[:size] * (len(order) // size)
            slots = set()
            for i in own[::size]:
                up = around[i]
                while up >= 0 and (tokens[up] not in known or known[tokens[up]][0] == vector):
                    up = around[up]
                if up < 0:
                    slots.add(None)
                    continue
                outer = [j for j, t in enumerate(tokens) if t in known and known[t][0] == known[tokens[up]][0] and chars[j] < 0 and j < i]
                slots.add((known[tokens[up]][0], tokens[outer[-1]]))
            shapes[(tuple(order[:size]), *slots) if regular and len(slots) == 1 else None] += 1
        most, n = max(shapes.items(), key=lambda x: (x[1], x[0] is not None))
        if most and n >= 0.9 * sum(shapes.values()):
            good.add(vector)
    return good


def test_html_templates_equal_brute_force(spark):
    rng = random.Random(9)
    hosts = {}
    for h in range(6):
        menu = "".join(f"<li class=k><a href='/{k}'>Entry {k}</a></li>" for k in range(rng.randrange(2, 6)))
        loose = rng.choice(["", "<div class='s'>Sometimes here</div>"])
        hosts[f"h{h}.example"] = [
            f"<body><ul class='t'>{menu}</ul><div class='n'>Always the same {h}</div>{loose if rng.random() < 0.7 else ''}<div class='c'>"
            + "".join(f"<p>Own {h} {i} {j}</p>" for j in range(rng.randrange(1, 5))) + "</div><div class='f'>End of it <i>all</i></div></body>" for i in range(7)
        ]
    rows = [(host, i, page) for host, pages in hosts.items() for i, page in enumerate(pages)]
    found = html_text.templates(spark.createDataFrame(rows, "host string, page_id long, source string")).collect()
    got = {r.host: json.loads(r.template) for r in found}
    for host, pages in hosts.items():
        known = classes_by_hand(pages)
        good = valid_by_hand(pages, known)
        assert {r["token"] for r in got[host] if not r["text"] and r["valid"]} == {t for t, (v, once, text) in known.items() if not text and v in good}
        assert {r["token"] for r in got[host] if r["text"]} == {t for t, (v, once, text) in known.items() if text and once and v in good}
        for page, text in zip(pages, (html_text.main_text(p, html_text.Template(got[host])) for p in pages), strict=True):
            # what few pages have is no wording of the template
            assert text.removeprefix("Sometimes here\n\n") == "\n\n".join(re.findall("<p>(.*?)</p>", page)), host


def test_html_odd_pages(spark, monkeypatch):
    long = "<p>" + "</p><p>".join(f"line {i} of it" for i in range(30000)) + "</p>"
    bodies = [f"<div class='x2'>Always the same words</div><div class='x3'><p>Own words {i}</p></div>" for i in range(8)]
    once = texts_of_pages(spark, [*bodies, long])
    assert once[:8] == [f"Own words {i}" for i in range(8)] and once[8] == "\n\n".join(f"line {i} of it" for i in range(30000))
    monkeypatch.setattr(html_text, "SENT_BYTES", 0)  # by a shuffle
    assert texts_of_pages(spark, [*bodies, long]) == once
    assert texts_of_pages(spark, bodies[:1] * 5) == ["Always the same words\n\nOwn words 0"] * 5  # copies alone make no template


# --- 4 n-gram join ----------------------------------------------------------------------------------


def brute_components(texts, width, percent):
    sets = []
    for t in texts:
        w = [x.translate({c: c + 32 for c in range(65, 91)}) for x in WORD.findall(t or "")]
        sets.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set())
    of = list(range(len(texts)))
    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                a, b = of[i], of[j]
                of = [min(a, b) if x in (a, b) else x for x in of]
    return {i: (len(s), of[i]) for i, s in enumerate(sets)}


@pytest.mark.parametrize("width,percent", [(4, 85), (5, 80)])
def test_join_equals_brute_force(spark, width, percent):
    rng = random.Random(width)
    texts = [prose(rng, rng.randrange(5, 120)) for _ in range(60)]
    for base in list(texts[:25]):  # copies, near copies, chains
        words = base.split()
        for k in range(rng.randrange(1, 6)):
            if k:
                words[rng.randrange(len(words))] = "new" + str(k)
            texts.append(" ".join(words).upper() if k == 2 else " ".join(words))
    shared = prose(rng, 40)
    texts += [f"{shared} {prose(rng, 12)}" for _ in range(40)] + [shared] * 10 + ODD
    docs = documents(spark, texts).withColumn("n", F.lit(0)).withColumn("id", F.lit("x"))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.similarity_components(docs, width, percent).collect()}
    assert got == brute_components(texts, width, percent)


def test_join_odd_rows(spark):
    docs = documents(spark, ["a b c d e f", "a b c d e f", None, ""]).union(spark.createDataFrame([(None, "a b c d e f", None, None, None), (None, "zz", None, None, None)], DOCS))
    got = Counter((r.doc_id, r.component_id) for r in ngram_join.similarity_components(docs).collect())
    assert got == Counter([(0, 0), (1, 0), (2, 2), (3, 3), (None, 0), (None, None)])
    kept = Counter((r.doc_id, r.text) for r in ngram_join.one_of_each(docs).collect())
    assert kept == Counter([(0, "a b c d e f"), (2, None), (3, ""), (None, "a b c d e f"), (None, "zz")])
    assert ngram_join.similarity_components(docs.limit(0)).count() == 0
    assert ngram_join.one_of_each(docs.limit(0)).count() == 0


def test_join_of_ids_with_several_texts(spark):
    rows = [(1, "a b c d e f"), (1, "q r s t u v"), (2, "q r s t u v"), (3, "other words of its own here"), (3, "other words of its own here"), (3, "")]
    docs = spark.createDataFrame([(i, t, "en", f"s{k}", len(t)) for k, (i, t) in enumerate(rows)], DOCS).withColumn("version", F.lit(1)).withColumn("turn", F.lit(2))
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.similarity_components(docs).collect())
    assert got == Counter([(1, 2, 1), (1, 2, 1), (2, 2, 1), (3, 2, 3), (3, 2, 3), (3, 0, 3)])
    kept = ngram_join.one_of_each(docs)
    assert kept.columns == docs.columns
    found = sorted((r.doc_id, r.text) for r in kept.collect())
    assert found == [(1, "a b c d e f"), (1, "q r s t u v"), (3, ""), (3, "other words of its own here")]
    again = ngram_join.one_of_each(docs.repartition(5))
    assert sorted(map(str, kept.collect())) == sorted(map(str, again.collect()))


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        at, how = rng.randrange(len(words) - 8), rng.random()
        if how < 0.5:
            words[at] = f"e{rng.randrange(10**6)}"
        elif how < 0.7:
            words.insert(at, f"e{rng.randrange(10**6)}")
        elif how < 0.8:
            del words[at : at + rng.randrange(1, 8)]
        else:
            del words[at]
    return words


@pytest.mark.parametrize("width,percent", [(4, 85), (5, 80)])
def test_join_of_large_groups_near_the_threshold(spark, width, percent):
    rng = random.Random(percent)
    first = prose(rng, 150, 5000).split()
    far = edited(rng, first, 9)
    cut = [first[a : a + rng.randrange(60, 140)] for a in (0, *(rng.randrange(30) for _ in range(40)))]
    texts = [" ".join(edited(rng, first, rng.randrange(1, 9))) for _ in range(300)]  # around and under it from each other
    texts += [" ".join(edited(rng, far, rng.randrange(1, 9))) for _ in range(100)]  # a family within the group
    texts += [" ".join(x) for x in cut] + [" ".join(first)] * 5 + [" ".join(first + prose(rng, n, 9000).split()) for n in range(1, 60)]
    texts += [prose(rng, 30000, 90000) + " end"] * 2 + [prose(rng, 60, 9000) for _ in range(50)]
    rng.shuffle(texts)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.similarity_components(documents(spark, texts), width, percent).collect()}
    assert got == brute_components(texts, width, percent)


def test_classes_beside_a_large_group_do_not_meet_all_of_it_at_each_shingle(spark, monkeypatch):
    rng, rows, candidates = random.Random(3), [], ngram_join._candidates
    first = prose(rng, 150, 5000).split()
    near = edited(rng, first, 12)
    texts = [" ".join(edited(rng, first, rng.randrange(3, 9))) for _ in range(300)] + [" ".join(edited(rng, near, rng.randrange(1, 3))) for _ in range(20)]

    def counted(met, percent):
        rows.append(met.count())
        return candidates(met, percent)

    monkeypatch.setattr(ngram_join, "_candidates", counted)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.similarity_components(documents(spark, texts), 4, 85).collect()}
    assert got == brute_components(texts, 4, 85) and rows[0] < 20 * 300


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(50)] + [(i, i + 1) for i in range(100, 140)]
    of = {x: x for e in edges for x in e if e[0] != e[1]}
    for _ in of:
        for a, b in edges:
            if a != b:
                of[a] = of[b] = min(of[a], of[b])
    got = connected_components(spark.createDataFrame(edges, "a long, b long"))
    assert {r.node: r.component for r in got.collect()} == of


# --- 5 language ---------------------------------------------------------------------------------------


def test_language_held_out_accuracy_and_odd_texts(spark):
    rng = random.Random(5)
    letters = {"aa": ["ka", "lo", "mi", "tu"], "bb": ["she", "thr", "wou", "ing"], "cc": ["éu", "çà", "ïo", "ñe"]}
    langs = [rng.choice(list(letters)) for _ in range(600)]
    texts = [" ".join("".join(rng.choices(letters[g], k=3)) for _ in range(20)) for g in langs]
    docs = documents(spark, texts, langs=langs).withColumn("score", F.lit("clash"))
    model = language_id.train(docs, language_id.not_held_out(), per_label=200)
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 3 == 1]
    got = {r.doc_id: r for r in language_id.predicted(docs, model).collect()}
    assert sum(got[i].lang_pred == langs[i] for i in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in got.values())
    assert sum(got[i].rejected for i in held) / len(held) < 0.05
    odd = language_id.predicted(documents(spark, [None, "", "123 ²½ --", "kaloka" * 200_000]), model).orderBy("doc_id").collect()
    assert [r.lang_pred for r in odd] == ["und", "und", "und", "aa"] and odd[0].score == 0.0 and odd[0].rejected
    none = language_id.train(docs.limit(0), language_id.not_held_out())
    assert {r.lang_pred for r in language_id.predicted(docs.limit(3), none).collect()} == {"und"}


def test_long_texts_are_read_whole():
    model = language_id.Model(("a", "b"), np.random.default_rng(0).normal(size=(64, 2)).astype(np.float32), np.zeros(2, np.float32), 1.0, 0.0)
    text = "lorem ipsum dolor " * 60_000
    found, _ = language_id.ngrams(language_id.lowered(text), 64)
    logits = model.table[found].mean(axis=0, dtype=float)
    want = np.exp(logits) / np.exp(logits).sum()
    assert language_id.classify(model, [text])["score"][0] == pytest.approx(want.max(), abs=1e-4)


# --- 6 licences ------------------------------------------------------------------------------------------


def test_license_scan(spark):
    mit = dict(licenses.TEMPLATES[::-1])["MIT"]
    texts = ["Some prose here.\nReleased under the MIT license\nmore", "This work is licensed under the GNU General Public License, version 3!", "nothing of the kind", *ODD, "LICENSED UNDER CC BY-NC 4.0"]
    got = {r.doc_id: r for r in licenses.scanned(documents(spark, texts).withColumn("license", F.lit(1))).collect()}
    assert mit and [got[i].license for i in (0, 1, 2, len(texts) - 1)] == ["MIT", "GPL-3.0", None, "CC-BY-NC-4.0"]
    assert got[0].score == 1.0 and got[2].n_units == 0 and len(got) == len(texts)
    assert licenses.scanned(documents(spark, texts).limit(0)).count() == 0


def test_license_scan_finds_notices_amid_other_words(spark):
    rng = random.Random(6)
    named = dict(licenses.TEMPLATES)
    texts = [f"{prose(rng, 80)} {named[n]} {prose(rng, 300)}" for n in named] + [f"{prose(rng, 9)} {licenses.TEXTS[0][1]} {prose(rng, 50)}", prose(rng, 200000) + " Released under the MIT license " + prose(rng, 9), "the license of the " * 40000]
    got = {r.doc_id: r for r in licenses.scanned(documents(spark, texts)).collect()}
    for i, n in enumerate(named):
        assert got[i].score == 1.0 and licenses.bigrams(got[i].matched) == licenses.bigrams(dict(licenses.TEMPLATES)[got[i].license]) and got[i].license <= n
    assert [got[len(named) + i].license for i in range(3)] == [licenses.TEXTS[0][0], "MIT", None]


def test_license_windows_equal_brute_force():
    rng = random.Random(3)
    templates = [("a", "x y z x y"), ("b", "p q r s t u v"), ("c", "x y p q")]
    known = licenses.Templates(templates, 0.8)
    for _ in range(300):
        text = " ".join(rng.choice("xyzpqrstuv") if rng.random() < 0.5 else rng.choice(templates)[1] for _ in range(rng.randrange(12)))
        pairs, want = licenses.pairs_of(text), {}
        for name, t in templates:
            own, span = licenses.bigrams(t), len(licenses.pairs_of(t))
            if len(pairs) > span:
                found = [(2 * len(own & set(pairs[i : i + span])) / (len(set(pairs[i : i + span])) + len(own)), -i) for i, g in enumerate(pairs) if g in own]
                if found and max(found)[0] >= 0.8:
                    want[name] = (max(found)[0], -max(found)[1])
        assert {name: (score, at) for score, name, at, _ in known.within(text)} == want


def test_license_scan_tells_near_notices_and_whole_texts(spark):
    notice = "This {} is free software{} you can redistribute it and/or modify\nit under the terms of the GNU {}General Public License as published by\nthe Free Software Foundation{} either version {} of the License, or\n(at your option) any later version.\n\nx"
    want = {
        "GPL-2.0": notice.format("program", ";", "", ";", "2"), "GPL-3.0": notice.format("program", ":", "", ",", "3"),
        "AGPL-3.0": notice.format("program", ":", "Affero ", ",", "3"), "LGPL-2.1": notice.format("library", ";", "Lesser ", ";", "2.1"),
        "CC-BY-NC-SA-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
        "CC-BY-3.0": "Licensed under CC BY 3.0",
    }
    whole = [" ".join(t.split()[:-60]) if len(t) > 5000 else t.replace("<year>", "2024").replace("<owner>", "A. Person and others").replace("<copyright holders>", "A. Person").replace("\n", "\r\n") for _, t in licenses.TEXTS]
    texts = [*want.values(), *whole]
    got = {r.doc_id: r.license for r in licenses.scanned(documents(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == [*want, *(n for n, _ in licenses.TEXTS)] and len(licenses.TEXTS) == 12


# --- 7 and 8 tokens -------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def tokenizer():
    tokenizers = pytest.importorskip("tokenizers")
    return tokenizers.Tokenizer.from_file(tokens.public_tokenizer())


TRICKY = [*ODD, "Don't stop. It's 'quoted' — O'Neil's, they'll're", "<|endoftext|> and <|EndOfText|>", "é É İ ǅ ß ſ ﬁ ẞ", "a\x1cb\x85c d　e", "123.45,67 9a8b", "日本語 text ΑΣ ΟΔΟΣ", "a.b,c;d!e?f)g|h]", "end.' ...' word\"' x'.", "퟿ \U0001f600 ‍"]


def test_word_encoder_equals_the_tokenizer(tokenizer):
    rng = random.Random(6)
    texts = TRICKY + ["".join(rng.choice("aBc'é .,!?1\n —st") for _ in range(rng.randrange(200))) for _ in range(400)]
    got = list(tokens.WordEncoder(tokens.public_tokenizer()).ids(pa.array(texts, pa.string())))
    assert [x.tolist() for x in got] == [tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_minimal_perfect_hash():
    keys = np.unique(np.random.default_rng(1).integers(-(1 << 62), 1 << 62, 5000))
    seeds = tokens.build_mph(keys)
    assert sorted(tokens.slot_of(keys, seeds, len(keys)).tolist()) == list(range(len(keys)))
    shard = tokens.Shard(tokens.pack_shard(0, [None, 5, 5, 9], [np.array([k, 1], "<u4") for k in range(4)]))
    assert shard.get(9).tolist() == [3, 1] and shard.get(5).tolist() == [1, 1] and shard.get(7) is None


def test_token_shards_round_trip(spark, tokenizer, tmp_path):
    texts = TRICKY * 3
    docs = documents(spark, texts).union(spark.createDataFrame([(None, "null key", None, None, None), (4, "again", None, None, None)], DOCS)).withColumn("ids", F.lit(1)).repartition(3)
    tokens.write_shards(tokens.token_shards(docs, shard_bytes=400, partition_bytes=1000), str(tmp_path / "s"))
    shards = spark.read.parquet(str(tmp_path / "s"))
    got = sorted(((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in tokens.read_documents(shards).collect()))
    rows = sorted(docs.select("doc_id", "text").collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text is not None, r.text or ""))
    start = 0
    for r, g in zip(rows, got, strict=True):
        ids = tokenizer.encode(r.text or "", add_special_tokens=False).ids + [1]
        assert g == (start, r.doc_id, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert [list(r.ids) for r in tokens.fetch(shards, [9, 10**9]).collect()] == [tokenizer.encode(TRICKY[9], add_special_tokens=False).ids + [1]]
    assert tokens.fetch(shards, []).count() == tokens.fetch(shards, [None]).count() == 0
    assert tokens.token_shards(docs.limit(0)).count() == 0
    assert [tokens.partitions_for(x) for x in (0, 1, 1 << 30, 10**14)] == [1, 1, 86, 186265]


def test_packing_covers_every_piece(spark, tokenizer):
    rng = random.Random(9)
    texts = [prose(rng, rng.randrange(1, 900)) for _ in range(80)] + TRICKY
    got = packing.packed_documents(documents(spark, texts).withColumn("piece", F.lit(1)).coalesce(1)).collect()
    ids = {i: tokenizer.encode(t or "", add_special_tokens=False).ids + [0] for i, t in enumerate(texts)}
    for i, whole in ids.items():
        pieces = sorted((r.piece, r.start, r.length, r.ids_crc32) for r in got if r.doc_id == i)
        assert pieces == [(k, s, len(whole[s : s + 2048]), zlib.crc32(np.array(whole[s : s + 2048], "<u4").tobytes())) for k, s in enumerate(range(0, len(whole), 2048))]
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for members in bins.values():
        at = 0
        for offset, n in sorted(members):
            assert offset == at
            at += n
        assert at <= 2048
    assert len(bins) <= -(-sum(map(len, ids.values())) // 2048) + 2
    assert packing.packed_documents(documents(spark, [""]).limit(0)).count() == 0


def test_packing_hardly_depends_on_the_split(spark, tokenizer):
    rng = random.Random(19)
    texts = [prose(rng, rng.randrange(1, 700)) for _ in range(500)]
    docs = documents(spark, texts).withColumn("doc_id", F.when(F.col("doc_id") % 50 > 0, F.col("doc_id")))
    total = sum(len(x.ids) + 1 for x in tokenizer.encode_batch(texts, add_special_tokens=False))
    for parts in (1, 8, 64):
        got = packing.packed_documents(docs.repartition(parts)).collect()
        assert sum(r.length for r in got) == total and sum(r.doc_id is None for r in got) >= 10
        of = {}
        for r in got:
            of.setdefault(r.sequence_id, []).append((r.offset, r.length))
        assert all(a + n == b for x in of.values() for (a, n), (b, _) in zip(sorted(x), sorted(x)[1:], strict=False))
        assert len(of) <= 1.01 * -(-total // 2048) + 1


def test_two_for_one():
    lengths = np.array([6, 5, 4, 4, 1], np.int64)
    bins = packing.best_two_fit(lengths, 10)
    assert sorted(x for b in bins for x in b) == list(range(5)) and all(lengths[b].sum() <= 10 for b in bins)
    assert packing.two_that_fit(np.bincount([3, 4, 4], minlength=11), 8, 6) == [4, 4]
    assert packing.two_that_fit(np.bincount([4], minlength=11), 8, 6) is None


# --- 9 url filters ------------------------------------------------------------------------------------------------


def test_url_filter_as_of(spark):
    entries = spark.createDataFrame(
        [(1, "bad.org", "block", "2024-01-10"), (2, "bad.org", "remove", "2024-02-10"), (3, "x.bad.org/ok/", "allow", "2024-01-15"), (4, None, "block", "2024-01-01"), (5, "BAD.net", "block", "2024-01-01")],
        "entry_id int, key string, action string, at string",
    ).withColumn("at", F.col("at").cast("date"))
    rows = [("http://bad.org/", "2024-01-09"), ("http://bad.org/", "2024-01-10"), ("http://x.BAD.org:80/ok/y?z", "2024-01-20"), ("http://x.bad.org/no", "2024-01-20"), ("https://bad.org", "2024-02-10"), (None, "2024-01-20"), ("http://bad.org/", None), ("nonsense", "2024-01-20"), ("http://notbad.org/", "2024-01-20"), ("//u@a.bad.net/q", "2024-01-20")]
    c = spark.createDataFrame([(i, u, t) for i, (u, t) in enumerate(rows)], "page_id long, url string, fetched_at string").withColumn("fetched_at", F.col("fetched_at").cast("date")).withColumn("key", F.lit(1)).withColumn("rule_id", F.lit(1))
    got = {r.page_id: (r.blocked, r.rule_id) for r in url_filters.judged(c.union(c), entries).collect()}
    assert got == {0: (False, None), 1: (True, 1), 2: (False, 3), 3: (True, 1), 4: (False, None), 5: (False, None), 6: (False, None), 7: (False, None), 8: (False, None), 9: (True, 5)}
    assert url_filters.judged(c.union(c), entries).count() == 20 and url_filters.judged(c.limit(0), entries).count() == 0
    assert not any(r.blocked for r in url_filters.judged(c, entries.limit(0)).collect())


def test_url_filters_of_long_urls_and_hot_keys(spark):
    rng = random.Random(12)
    entries = [(i, rng.choice(["hot.example", "hot.example", "a.hot.example/x/x/", "hot.example/x/"]), rng.choice(["block", "allow", "remove"]), rng.randrange(400)) for i in range(600)]
    urls = ["http://hot.example/" + "x/" * 50000, "http://" + "a." * 40000 + "hot.example/x/y", "http://a.hot.example/x/x/x", "http://hot.example", "http://other.example/x/"]
    captures = [(i, rng.choice(urls[:2]) if i < 20 else rng.choice(urls[2:]), rng.randrange(420)) for i in range(900)]
    day = lambda df: df.withColumn("at", F.date_add(F.lit("2024-01-01").cast("date"), F.col("at")))
    c = day(spark.createDataFrame(captures, "page_id long, url string, at int"))
    got = {r.page_id: (r.blocked, r.rule_id) for r in url_filters.judged(c.repartition(5), day(spark.createDataFrame(entries, "entry_id int, key string, action string, at int")), at="at").collect()}
    for i, url, at in captures:
        host, path = re.match(r"http://([^/]+)(.*)", url).groups()
        best = None
        for key in {k for _, k, _, _ in entries}:
            if key == host or host.endswith("." + key) or (key.endswith("/") and (host + path).startswith(key)):
                held = max(((d, e, a) for e, k, a, d in entries if k == key and d <= at), default=None)
                if held and held[2] != "remove":
                    best = max(best or (0,), (len(key), held[1], held[2]))
        assert got[i] == ((best[2] == "block", best[1]) if best else (False, None)), (url[:40], at)


# --- 10 quality ----------------------------------------------------------------------------------------------------


def figures_by_hand(text):
    w = WORD.findall(text or "")
    seen = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    hit = {j for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(hit)


def test_quality_figures_and_cascade(spark):
    rng = random.Random(10)
    texts = [prose(rng, rng.randrange(1, 60), 3) for _ in range(80)] + [prose(rng, 300) for _ in range(5)] + ["# | " * 60, "go on\n" * 30] + ODD
    docs = documents(spark, texts).withColumn("n_words", F.lit("clash"))
    got = {r.doc_id: r for r in quality_rules.judged(docs, sample_rows=50).collect()}
    for i, t in enumerate(texts):
        want = figures_by_hand(t)
        assert tuple(got[i][k] for k in quality_rules.FIGURES) == want
        assert got[i].base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (got[i].kept and got[i].base_failed)
    kept = {r.doc_id for r in quality_rules.keep_good(docs, sample_rows=50).collect()}
    assert kept == {i for i, r in got.items() if r.kept} and set(range(80, 85)) <= kept
    costs = quality_rules.rule_costs(docs, sample_rows=50)
    assert [c.rank for c in costs] == sorted((c.rank for c in costs), reverse=True) and len(costs) == len(quality_rules.RULES)
    assert quality_rules.judged(docs.limit(0)).count() == 0
    assert quality_rules.keep_good(docs.limit(0)).count() == 0


def test_quality_cascade_rejects_beyond_the_base(spark):
    rng = random.Random(11)
    clean = [f"{prose(rng, 60)}.\n{prose(rng, 60)}." for _ in range(6)]
    bad = [
        " ".join(w + "***" for w in prose(rng, 80).split()), prose(rng, 80).upper(), " | ".join(prose(rng, 60).split()), " ".join(str(rng.random()) for _ in range(60)),
        *("\n".join(f"{start}{prose(rng, 8)}{end}" for _ in range(8)) for start, end in (("", ""), ("", "..."), ("- ", "."))),
        " ".join("x" * rng.randrange(50, 90) + str(i) for i in range(40)),
    ]
    texts = clean + bad + ["w " * 9 + "\n" + t for t in clean] + [None, "", " ".join(clean * 80)]
    docs = documents(spark, texts)
    docs = docs.union(docs.where("doc_id = 0"))
    got = sorted((r.doc_id, r.base_failed, r.kept) for r in quality_rules.judged(docs, sample_rows=20).collect())
    n = len(clean)
    assert [x for x in got if x[0] < n] == [(0, False, True)] + [(i, False, True) for i in range(n)]
    assert [x for x in got if n <= x[0] < n + len(bad)] == [(n + i, False, False) for i in range(len(bad))]
    assert all(x[1] != x[2] for x in got if x[0] >= n + len(bad))
    alone = {r.name: quality_rules.keep_good(docs, [r], sample_rows=20).count() for r in quality_rules.RULES}
    assert all(k < docs.count() for name, k in alone.items() if name not in ("repeated_lines",))
