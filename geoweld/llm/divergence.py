"""How the wording of each source of a language differs from the other sources and from the language.

Sort-based streaming. Each task counts the terms of its documents as it reads them
and hands on partial counts by (lang, term, source). Rows are dealt and sorted by (lang, term, source,
document), so that one pass over a task's sorted rows sees each key as a run and
adds it up in constant memory. A second pass, dealt and sorted by (lang, term, source), sees the
sources of a term one after another: the run's length tells in how many documents the
term occurs, and terms in enough of them stay. A third pass, with each group's totals beside the rows,
gives partial sums for pairs of sources and the terms that a source uses more than its language.

A pair's sum runs over all kept terms, most of which neither source has. With
z the share of a term that a group lacks,
    sum f(p, q) = sum f(p, z) over the first's terms + sum f(z, q) over the other's
                  + f(z, z) for each remaining term + a correction for each term of both.
The first two need a group's counts of counts only; the third pass gives the
corrections. All arithmetic is exact in 64 bits while N + V of a group stays below 9e15 and V below 1e9.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoweld.llm.common import checkpointed

#: Bytes other than letters and those of characters beyond ASCII part terms; A-Z become a-z.
FOLD = bytes(c if c > 0x7F or 0x61 <= c <= 0x7A else c + 0x20 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))
#: Partial counts that a task adds up before it hands them on.
HELD_ROWS = 1 << 19
#: Bytes of text whose terms are counted at once.
CHUNK_BYTES = 8 << 20
#: Pairs of sources that a task works on at once.
PAIRS = 1 << 20
#: What shares are parts of.
SCALE = 1_000_000_000

COUNTED = pa.schema([("lang", pa.string()), ("term", pa.string()), ("source", pa.string()), ("document", pa.int64()), ("docs", pa.int64()), ("n", pa.int64())])
KEY = ["lang", "term", "source"]


def _ddl(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {'long' if f.type == pa.int64() else 'string'}" for f in schema)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with a few MB of text each, a longer text alone."""
    for batch in batches:
        sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < len(sizes):
            before = sizes[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(sizes, before + CHUNK_BYTES)))
            yield batch.slice(start, end - start)
            start = end


def _counted(batch: pa.RecordBatch, document: int) -> pa.Table:
    """Documents and occurrences of each (lang, term, source) in the batch; document numbers its rows."""
    terms = [(t or "").encode().translate(FOLD).split() for t in batch.column("text").to_pylist()]
    sizes = np.fromiter(map(len, terms), np.int64, len(terms))
    coded = pa.array([t for own in terms for t in own], pa.binary()).dictionary_encode()
    n_terms = len(coded.dictionary) + 1
    lang, source = (pc.fill_null(batch.column(c), "").dictionary_encode() for c in ("lang", "source"))
    n_sources = len(source.dictionary) + 1
    group = lang.indices.to_numpy().astype(np.int64) * n_sources + source.indices.to_numpy()
    row = np.repeat(np.arange(len(terms)), sizes)
    # occurrences of each term in each document, then documents and occurrences of each term in each group
    pairs, n = np.unique(row * n_terms + coded.indices.to_numpy(), return_counts=True)
    own, term = np.divmod(pairs, n_terms)
    keys, of = np.unique(group[own] * n_terms + term, return_inverse=True)
    group_of, term_of = np.divmod(keys, n_terms)
    sums = np.zeros(len(keys), np.int64)
    np.add.at(sums, of, n)
    return pa.table(
        [
            lang.dictionary.take(pa.array(group_of // n_sources)), coded.dictionary.take(pa.array(term_of)).cast(pa.string()),
            source.dictionary.take(pa.array(group_of % n_sources)), pa.array(np.full(len(keys), document)), pa.array(np.bincount(of, minlength=len(keys)).astype(np.int64)), pa.array(sums),
        ], schema=COUNTED,
    )


def _added(tables: list[pa.Table]) -> pa.Table:
    """One row for each key; document is the first of them."""
    whole = pa.concat_tables(tables)
    summed = whole.group_by(KEY, use_threads=False).aggregate([("document", "min"), ("docs", "sum"), ("n", "sum")])
    return pa.table([summed.column(c) for c in (*KEY, "document_min", "docs_sum", "n_sum")], schema=COUNTED)


def count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counts of a task: as few rows as HELD_ROWS allows."""
    held: list[pa.Table] = []
    size, document = 0, TaskContext.get().partitionId() << 32
    for batch in _chunks(batches):
        held.append(_counted(batch, document))
        document += batch.num_rows
        size += held[-1].num_rows
        if size > HELD_ROWS:
            held = [_added(held)]
            size = held[0].num_rows
            if size > HELD_ROWS // 2:
                yield from held[0].to_batches(1 << 15)
                held, size = [], 0
    if held:
        yield from _added(held).to_batches(1 << 15)


def _starts(columns: list[pa.Array]) -> np.ndarray:
    """Where rows begin that differ from the row before in one of the columns."""
    new = np.ones(len(columns[0]), bool)
    if len(new) > 1:
        new[1:] = False
        for c in columns:
            new[1:] |= pc.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False)
    return np.flatnonzero(new)


def _whole_runs(batches: Iterator[pa.RecordBatch], key: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """The sorted rows again, cut between runs of the key, with the places where runs start."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        starts = _starts([batch.column(k) for k in key])
        goes_on = bool(rest) and all(rest[-1].column(k)[-1] == batch.column(k)[0] for k in key)
        cut = int(starts[-1])
        if not cut and goes_on:
            rest.append(batch)
            continue
        done = [*rest, batch.slice(0, cut)]
        rest = [batch.slice(cut)]
        table = pa.Table.from_batches(done).combine_chunks()
        if table.num_rows:
            yield table, _starts([table.column(k).chunk(0) for k in key])
    if rest:
        table = pa.Table.from_batches(rest).combine_chunks()
        yield table, _starts([table.column(k).chunk(0) for k in key])


def _sums(values: pa.ChunkedArray, starts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values.to_numpy(), starts)


def add_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents and occurrences of each run of (lang, term, source), in constant memory: a run's rows are added up as they come."""
    last: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        table = pa.concat_tables([last, table.select(last.column_names)]) if last is not None else table.select([*KEY, "docs", "n"])
        table = table.combine_chunks()
        starts = _starts([table.column(k).chunk(0) for k in KEY])
        keys = table.select(KEY).take(pa.array(starts))
        table = keys.append_column("docs", pa.array(_sums(table.column("docs"), starts))).append_column("n", pa.array(_sums(table.column("n"), starts)))
        yield from table.slice(0, len(starts) - 1).to_batches()
        last = table.slice(len(starts) - 1)
    if last is not None:
        yield from last.to_batches()


def _keep_terms(least_docs: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of terms in enough documents of their language, with n_lang, and first in one row a term."""
        for table, starts in _whole_runs(batches, KEY[:2]):
            sizes = np.diff(np.append(starts, table.num_rows))
            first = np.zeros(table.num_rows, np.int64)
            first[starts] = 1
            enough = np.repeat(_sums(table.column("docs"), starts) >= least_docs, sizes)
            whole = table.drop_columns(["docs"]).append_column("n_lang", pa.array(np.repeat(_sums(table.column("n"), starts), sizes))).append_column("first", pa.array(first))
            yield from whole.filter(pa.array(enough)).to_batches()

    return keep


def share(count: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE * (count + 1) / whole), three digits at a time, so that nothing overflows."""
    rest, out = count + 1, np.zeros(np.broadcast(count, whole).shape, np.int64)
    for _ in range(4):
        out = out * 1000 + rest // whole
        rest = rest % whole * 1000
    return out + 1


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def audit_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of runs of (lang, term): corrections for pairs of sources, added up by task as far as PAIRS goes, and the terms that a source uses more than its language."""
    for table, starts in _whole_runs(batches, KEY[:2]):
        n, whole, n_lang, whole_lang = (table.column(c).to_numpy() for c in ("n", "whole", "n_lang", "whole_lang"))
        lang, term, source = (table.column(c).chunk(0) for c in KEY)
        p, q = share(n, whole), share(n_lang, whole_lang)
        over = pa.array(np.flatnonzero(p > q))
        value = pa.array(distance(p, q)).take(over)
        yield from _rows("term", lang.take(over), source.take(over), term.take(over), value)
        lack = share(np.zeros_like(n), whole)
        sizes = np.diff(np.append(starts, table.num_rows))
        begin, size = np.repeat(starts, sizes), np.repeat(sizes, sizes)  # of the run of each row
        names, langs = source.dictionary_encode(), lang.dictionary_encode()
        name_of, lang_of = (x.indices.to_numpy().astype(np.int64) for x in (names, langs))
        ends = np.cumsum(size)
        at = 0
        while at < len(n):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS)))
            a = np.repeat(np.arange(at, to), size[at:to])
            b = np.repeat(begin[at:to], size[at:to]) + np.arange(len(a)) - np.repeat(ends[at:to] - size[at:to] - (ends[at - 1] if at else 0), size[at:to])
            a, b = a[a != b], b[a != b]
            found = distance(p[a], p[b]) - distance(p[a], lack[b]) - distance(lack[a], p[b]) + distance(lack[a], lack[b])
            key = (lang_of[a] * len(names.dictionary) + name_of[a]) * len(names.dictionary) + name_of[b]
            order = np.argsort(key, kind="stable")
            key, first = np.unique(key[order], return_index=True)
            if len(key):
                value = pa.array(np.add.reduceat(found[order], first))
                key, item = np.divmod(key, len(names.dictionary))
                key, own = np.divmod(key, len(names.dictionary))
                yield from _rows("pair", langs.dictionary.take(pa.array(key)), names.dictionary.take(pa.array(own)), names.dictionary.take(pa.array(item)), value)
            at = to


def _rows(part: str, lang: pa.Array, source: pa.Array, item: pa.Array, value: pa.Array) -> list[pa.RecordBatch]:
    parts = pa.array([part]).take(pa.array(np.zeros(len(lang), np.int8)))
    return pa.table([lang, source, parts, item, value], names=["lang", "source", "part", "item", "value"]).to_batches()


def _share(count: Column, whole: Column) -> Column:
    wide = (F.lit(SCALE).cast("decimal(10,0)") * (count + 1).cast("decimal(19,0)")).cast("decimal(30,0)")
    return 1 + F.call_function("div", wide, whole.cast("decimal(19,0)"))


def _distance(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def audit(docs: DataFrame, least_docs: int = 3, top_terms: int = 200) -> DataFrame:
    """lang, source, part, item, value, rank: how far each source of a language is from its other sources and from the language.

    A document is a row; null text, lang and source count as empty ones. Terms
    are runs of ASCII letters, lower-cased, and of characters beyond ASCII. A language keeps the
    terms in at least least_docs of its documents. Part `pair` has every other
    source of the language, part `term` the top_terms terms that the source uses most beyond
    its language's share. Ties go by item in UTF-8. Rows that repeat are documents of their own,
    other columns are left out, and an empty table gives no rows. Languages, sources and their pairs
    are as many as the result has.
    """
    blank = [F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source")]
    counted = docs.select("text", *blank).mapInArrow(count_terms, _ddl(COUNTED))
    runs = counted.repartition(*KEY).sortWithinPartitions(*KEY, "document").mapInArrow(add_runs, "lang string, term string, source string, docs long, n long")
    sorted_runs = runs.repartition("lang", "term").sortWithinPartitions(*KEY)
    kept = checkpointed(sorted_runs.mapInArrow(_keep_terms(least_docs), "lang string, term string, source string, n long, n_lang long, first long"))

    known = kept.groupBy("lang", "source").agg(F.sum("n").alias("n"), F.count("*").alias("terms"), F.sum("first").alias("first"))
    groups = docs.select(*blank).distinct().join(known, ["lang", "source"], "left").na.fill(0)
    langs = groups.groupBy("lang").agg(F.sum("first").alias("v"), F.sum("n").alias("n"))
    langs = langs.select("lang", "v", (F.col("n") + F.col("v")).alias("whole_lang"))
    totals = checkpointed(groups.join(langs, "lang").select("lang", "source", "terms", "v", (F.col("n") + F.col("v")).alias("whole"), "whole_lang"))

    beside = kept.join(totals.select("lang", "source", "whole", "whole_lang"), ["lang", "source"])
    beside = beside.select(*KEY, "n", "n_lang", "whole", "whole_lang").repartition("lang", "term").sortWithinPartitions(*KEY)
    told = beside.mapInArrow(audit_runs, "lang string, source string, part string, item string, value long")
    told = checkpointed(told)  # read twice

    terms = told.where("part = 'term'")
    pairs = told.where("part = 'pair'").select("lang", "source", "item", "value").union(_without_corrections(kept, totals))
    pairs = pairs.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    by = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = [x.select("lang", "source", F.lit(name).alias("part"), "item", "value", F.row_number().over(by).alias("rank")) for name, x in (("pair", pairs), ("term", terms))]
    return ranked[0].union(ranked[1].where(F.col("rank") <= top_terms))


def _without_corrections(kept: DataFrame, totals: DataFrame) -> DataFrame:
    """lang, source, item, value whose sums are the pairs' values as if no term were in both."""
    lack = totals.select("lang", "source", "terms", "v", "whole", F.when(F.col("v") > 0, _share(F.lit(0), F.col("whole"))).alias("z"))
    other = lack.select("lang", F.col("source").alias("item"), F.col("terms").alias("other_terms"), F.col("z").alias("other_z"))
    both = lack.join(other, "lang").where("source <> item")
    rest = (F.col("v") - F.col("terms") - F.col("other_terms")) * _distance(F.col("z"), F.col("other_z"))
    neither = both.select("lang", "source", "item", F.coalesce(rest, F.lit(0)).alias("value"))
    counts = kept.groupBy("lang", "source", "n").agg(F.count("*").alias("times")).join(lack.select("lang", "source", "whole"), ["lang", "source"])
    counts = counts.select("lang", "source", _share(F.col("n"), F.col("whole")).alias("p"), "times")
    against = counts.join(other, "lang").where("source <> item")
    first = against.select("lang", "source", "item", (F.col("times") * _distance(F.col("p"), F.col("other_z"))).alias("value"))
    second = against.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), (F.col("times") * _distance(F.col("other_z"), F.col("p"))).alias("value"))
    return neither.union(first).union(second)
