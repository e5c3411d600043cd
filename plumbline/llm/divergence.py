"""Source divergence audit: which terms and which sources of a language stand apart, by sorted runs of term counts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Ids, pieces, release, table, written

#: A kept term is in at least this many documents of the language; probabilities are whole numbers of this unit.
LEAST_DOCS, UNIT = 3, 1_000_000_000
TOP, SHARES = 200, 16
#: Tokens that a task sorts at once; runs and partial results that it holds before it passes them on; pairs made at once.
TOKENS, HELD, PAIRS = 1_000_000, 600_000, 1_000_000
#: (lang, source) groups up to which their totals are sent to all tasks (some 100 bytes each); more are joined.
SENT = 100_000
#: Bytes of terms are letters and all of other scripts; A-Z become a-z, every other byte a space.
FOLD = bytes(b | 0x20 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))


def _starts(*changes: np.ndarray) -> np.ndarray:
    """Where runs start, given whether each row but the first differs from the one before it."""
    return np.flatnonzero(np.concatenate([[True], np.logical_or.reduce(changes)]))


class _Runs:
    """Counts of the documents of a task: tokens are sorted by (group, term, document) and scanned for runs."""

    def __init__(self):
        self.clear()

    def clear(self):
        self.groups, self.terms, self.held, self.open, self.tokens = Ids(), Ids(), [], [], 0

    def add(self, lang: str, source: str, text: str, document: int) -> None:
        group = self.groups[lang, source] << 40
        for part in pieces(text, FOLD):
            ids = np.fromiter(map(self.terms.__getitem__, part), np.int64, len(part)) + group
            self.open.append((ids, np.full(len(ids), document, np.int64), np.ones(len(ids), np.int64)))
            self.tokens += len(ids)
            if self.tokens >= TOKENS:
                self.scan()

    def scan(self) -> None:
        """Runs of (group, term, document): one document with its count."""
        if self.open:
            key, document, n = map(np.concatenate, zip(*self.open))
            order = np.lexsort((document, key))
            key, document, n = key[order], document[order], n[order]
            at = _starts(key[1:] != key[:-1], document[1:] != document[:-1]) if len(key) else np.zeros(0, np.int64)
            self.open, self.tokens = [(key[at], document[at], np.add.reduceat(n, at) if len(at) else n)], 0

    def close(self) -> None:
        """After whole documents: runs of (group, term) with their number of documents and their count."""
        self.scan()
        for key, document, n in self.open:
            self.held.append((key, np.ones(len(document), np.int64), n))
        self.open = []
        key, docs, n = map(np.concatenate, zip(*self.held)) if self.held else (np.zeros(0, np.int64),) * 3
        order = np.argsort(key, kind="stable")
        key = key[order]
        at = _starts(key[1:] != key[:-1]) if len(key) else order
        self.held = [(key[at], np.add.reduceat(docs[order], at), np.add.reduceat(n[order], at))] if len(key) else []

    def rows(self) -> Iterator[pa.RecordBatch]:
        self.close()
        names, terms = pa.array([list(g) for g in self.groups], pa.list_(pa.string())), pa.array([t.decode() for t in self.terms], pa.string())
        for key, docs, n in self.held:
            for i in range(0, len(key), 50_000):
                part = slice(i, i + 50_000)
                group = names.take(pa.array(key[part] >> 40))
                yield pa.RecordBatch.from_arrays([pc.list_element(group, 0), terms.take(pa.array(key[part] & (1 << 40) - 1)), pc.list_element(group, 1), pa.array(docs[part]), pa.array(n[part])], names=["lang", "term", "source", "docs", "n"])
        self.clear()
        release()


def partial_runs(docs: DataFrame) -> DataFrame:
    """(lang, term, source, docs, n): a task's runs, so that a frequent term comes to the shuffle once for each task and
    source, not for each document."""

    def scanned(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs, document, since = _Runs(), 0, 0
        for batch in parts:
            for lang, source, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                runs.add(lang, source, text, document)
                document, since = document + 1, since + len(text)
                if since >= 4 * TOKENS:
                    runs.close()
                    since = 0
                    if sum(len(h[0]) for h in runs.held) > HELD or len(runs.groups) > HELD:
                        yield from runs.rows()
        yield from runs.rows()

    return docs.mapInArrow(scanned, "lang string, term string, source string, docs long, n long")


def _changed(column: pa.Array) -> np.ndarray:
    return pc.not_equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False).astype(bool)


def kept_runs(partial: DataFrame, least: int) -> DataFrame:
    """(lang, term, sources, counts): the terms in at least `least` documents of a lang, from partial runs that are dealt
    out by (lang, term) and sorted by (lang, term, source). A task holds the run that it reads; a row has as many entries as
    the lang has sources with the term."""

    def merged(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in parts:
            rows = pa.table({name: batch.column(i) for i, name in enumerate(("lang", "term", "source", "docs", "n"))})
            if not len(rows):
                continue
            rows = (pa.concat_tables([held, rows]) if held is not None else rows).combine_chunks()
            lang, term, source = (rows[c].combine_chunks() if rows[c].num_chunks != 1 else rows[c].chunk(0) for c in ("lang", "term", "source"))
            other = _changed(lang) | _changed(term)
            at = _starts(other, _changed(source))
            sums = {c: np.add.reduceat(rows[c].to_numpy(), at) for c in ("docs", "n")}
            rows = rows.take(pa.array(at)).set_column(3, "docs", pa.array(sums["docs"])).set_column(4, "n", pa.array(sums["n"]))
            first = np.searchsorted(at, _starts(other))  # of each (lang, term)
            held = rows.slice(first[-1])
            yield from listed(rows.slice(0, first[-1]), first[:-1])
        if held is not None:
            yield from listed(held, np.zeros(1, np.int64))

    def listed(rows: pa.Table, first: np.ndarray) -> Iterator[pa.RecordBatch]:
        if not len(first):
            return
        enough = np.add.reduceat(rows["docs"].to_numpy(), first) >= least
        size = np.diff(np.append(first, len(rows)))
        rows = rows.filter(pa.array(np.repeat(enough, size))).combine_chunks()
        ends = np.cumsum(size[enough])
        offsets = pa.array(np.concatenate([[0], ends]), pa.int32())
        flat = lambda c: rows[c].combine_chunks() if rows[c].num_chunks != 1 else rows[c].chunk(0)
        if len(ends):
            names = rows.take(pa.array(ends - 1)).combine_chunks()
            column = lambda c: names[c].chunk(0)
            yield pa.RecordBatch.from_arrays([column("lang"), column("term"), pa.ListArray.from_arrays(offsets, flat("source")), pa.ListArray.from_arrays(offsets, flat("n"))], names=["lang", "term", "sources", "counts"])

    dealt = partial.repartition("lang", "term").sortWithinPartitions("lang", "term", "source")
    return dealt.mapInArrow(merged, "lang string, term string, sources array<string>, counts array<long>")


def _p(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    if len(count) and count.max() >= 9_000_000_000:
        return np.array([1 + UNIT * (int(c) + 1) // int(t) for c, t in zip(count, total)], np.int64)
    return 1 + UNIT * (count + 1) // total


def _f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


class _Sums:
    """Sums of values by a whole key."""

    def __init__(self):
        self.parts, self.size = [], 0

    def add(self, key: np.ndarray, value: np.ndarray) -> None:
        order = np.argsort(key, kind="stable")
        key = key[order]
        if len(key):
            at = _starts(key[1:] != key[:-1])
            self.parts.append((key[at], np.add.reduceat(value[order], at)))
            self.size += len(at)

    def whole(self) -> tuple[np.ndarray, np.ndarray]:
        parts, self.parts, self.size = self.parts, [], 0
        if len(parts) > 1:
            self.add(*map(np.concatenate, zip(*parts)))
            parts, self.parts = self.parts, []
        return parts[0] if parts else (np.zeros(0, np.int64), np.zeros(0, np.int64))


class _Scan:
    """One task's partial results over runs (lang, term, sources, counts, totals, ...)."""

    def __init__(self, top: int):
        self.top, self.groups, self.both, self.counts, self.best, self.n_best = top, Ids(), _Sums(), _Sums(), [], 0

    def take(self, lang: list, term: list, sources: list, size: np.ndarray, count: np.ndarray, total: np.ndarray, lang_total: np.ndarray) -> None:
        row = np.repeat(np.arange(len(term)), size)
        group = np.fromiter((self.groups[lang[r], s] for r, s in zip(row, sources)), np.int64, len(sources))
        first = np.concatenate([[0], np.cumsum(size)[:-1]])
        p, none = _p(count, total), 1 + UNIT // total
        q = _p(np.add.reduceat(count, first), lang_total)[row]
        over = np.flatnonzero(p > q)
        self.best.append(pd.DataFrame({"group": group[over], "value": _f(p[over], q[over]), "term": [term[r] for r in row[over]]}))
        self.n_best += len(over)
        # how many terms a group has with a count
        pairs = pd.DataFrame({"g": group, "c": count, "n": 1}).groupby(["g", "c"], sort=False)["n"].sum()
        self.counts.parts.append((pairs.index.to_frame().to_numpy(), pairs.to_numpy()))
        self.counts.size += len(pairs)
        # what a term adds for two sources that both have it, beyond what each adds against a source without it
        width, lo = size[row], 0
        upto = np.cumsum(width)
        while lo < len(row):
            hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + PAIRS, "right")))
            a = np.repeat(np.arange(lo, hi), width[lo:hi])
            b = np.arange(len(a)) - np.repeat(upto[lo:hi] - width[lo:hi] - (upto[lo - 1] if lo else 0), width[lo:hi]) + first[row[a]]
            a, b = a[a != b], b[a != b]
            self.both.add((group[a] << 32) + group[b], _f(p[a], p[b]) - _f(p[a], none[b]) - _f(none[a], p[b]) + _f(none[a], none[b]))
            lo = hi

    def prune(self) -> None:
        rows = pd.concat(self.best).sort_values(["group", "value", "term"], ascending=[True, False, True], kind="stable")
        self.best = [rows.groupby("group", sort=False).head(self.top)]
        self.n_best = len(self.best[0])

    def rows(self) -> Iterator[pd.DataFrame]:
        names = list(self.groups)
        frame = lambda part, group, item, count, value: pd.DataFrame({"lang": [names[g][0] for g in group], "source": [names[g][1] for g in group], "part": part, "item": item, "count": count, "value": value})
        if self.best:
            self.prune()
            yield frame("term", self.best[0]["group"], self.best[0]["term"].to_numpy(object), 0, self.best[0]["value"].to_numpy())
        key, value = self.both.whole()
        yield frame("both", key >> 32, [names[g][1] for g in key & (1 << 32) - 1], 0, value)
        if self.counts.parts:
            keys, ns = map(np.concatenate, zip(*self.counts.parts))
            same = pd.DataFrame({"g": keys[:, 0], "c": keys[:, 1], "n": ns}).groupby(["g", "c"], sort=False)["n"].sum()
            yield frame("count", same.index.get_level_values(0), None, same.index.get_level_values(1), same.to_numpy())
        self.__init__(self.top)


def _scanned(kept: DataFrame, groups: DataFrame, top: int, sent: int) -> DataFrame:
    """(lang, source, part, item, count, value) partial rows of kept runs: `term`, a task's first `top` terms of a group;
    `both`, sums for two sources; `count`, how many terms a group has with a count."""
    few = groups.limit(sent + 1).count() <= sent
    if few:
        known = {(r["lang"], r["source"]): (r["total"], r["lang_total"]) for r in groups.collect()}
        shared = kept.sparkSession.sparkContext.broadcast(known)
        rows = kept.select("lang", "term", "sources", "counts")
    else:
        each = kept.select("lang", "term", F.explode(F.arrays_zip("sources", "counts")).alias("e")).select("lang", "term", F.col("e.sources").alias("source"), F.col("e.counts").alias("n"))
        joined = each.join(groups.select("lang", "source", "total", "lang_total"), ["lang", "source"]).groupBy("lang", "term").agg(F.collect_list(F.struct("source", "n", "total")).alias("e"), F.first("lang_total").alias("lang_total"))
        rows = joined.select("lang", "term", F.col("e.source").alias("sources"), F.col("e.n").alias("counts"), F.col("e.total").alias("totals"), "lang_total")

    def scan(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _Scan(top)
        for batch in parts:
            if batch.num_rows:
                lang, term = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                size = pc.list_value_length(batch.column(2)).to_numpy(zero_copy_only=False).astype(np.int64)
                sources, count = batch.column(2).flatten().to_pylist(), batch.column(3).flatten().to_numpy(zero_copy_only=False)
                if few:
                    totals = np.array([shared.value[lang[r], s] for r, s in zip(np.repeat(np.arange(len(term)), size), sources)], np.int64)
                    total, lang_total = totals[:, 0], totals[np.concatenate([[0], np.cumsum(size)[:-1]]), 1]
                else:
                    total, lang_total = batch.column(4).flatten().to_numpy(zero_copy_only=False), batch.column(5).to_numpy(zero_copy_only=False)
                found.take(lang, term, sources, size, count, total, lang_total)
                if found.n_best > HELD:
                    found.prune()
                if max(found.n_best, found.both.size, found.counts.size) > HELD:
                    for frame in found.rows():
                        yield from pa.Table.from_pandas(frame, schema, preserve_index=False).to_batches(50_000)
        for frame in found.rows():
            yield from pa.Table.from_pandas(frame, schema, preserve_index=False).to_batches(50_000)

    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("part", pa.string()), ("item", pa.string()), ("count", pa.int64()), ("value", pa.int64())])
    return rows.mapInArrow(scan, "lang string, source string, part string, item string, count long, value long")


def _per(count: Column, total: Column) -> Column:
    """1 + floor(UNIT * (count + 1) / total), without overflow."""
    return F.lit(1) + F.call_function("div", (count + 1).cast("decimal(20,0)") * F.lit(UNIT).cast("decimal(10,0)"), total.cast("decimal(20,0)"))


def source_divergence(docs: DataFrame, *, least: int = LEAST_DOCS, top: int = TOP, sent: int = SENT) -> DataFrame:
    """(lang, source, part, item, value, rank): how far each source of a lang is from each other (`pair`), and the first
    `top` terms by which it stands out from its lang (`term`).

    A row is a document, repeats and null ids too; null text, lang and source are ''. Ties in value go to the smaller item
    in UTF-8. A source alone in its lang has no pairs; a lang without kept terms has pairs of value 0 and no terms; an
    empty table gives an empty one. Other columns are not read.

    Sums over all kept terms, most of which most sources lack, come of the counts there are: a source without a term has
    the same p for each such term, so terms that only one of two sources has are summed by that one's count, and only
    those that both have by their pair.
    """
    text = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    kept = written(kept_runs(partial_runs(text), least), "kept-terms")
    sizes = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"))
    sums = kept.select("lang", F.explode(F.arrays_zip("sources", "counts")).alias("e")).groupBy("lang", F.col("e.sources").alias("source")).agg(F.sum("e.counts").alias("n"))
    seen = text.groupBy("lang", "source").agg(F.lit(1).alias("one")).drop("one")
    groups = seen.join(sums, ["lang", "source"], "left").join(sizes, ["lang"], "left").select("lang", "source", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("v", F.lit(0)).alias("v"))
    groups = written(groups, "term-sources")
    langs = groups.groupBy("lang").agg((F.sum("n") + F.max("v")).alias("lang_total"))
    groups = groups.join(langs, ["lang"]).select("lang", "source", "v", (F.col("n") + F.col("v")).alias("total"), "lang_total")
    found = written(_scanned(kept, groups, top, sent), "term-runs")

    counts = found.where("part = 'count'").groupBy("lang", "source", "count").agg(F.sum("value").alias("h"))
    # the count 0 stands for all kept terms at first; terms that a source has are then moved to their own counts
    own = groups.where("v > 0").select("lang", F.col("source").alias("a"), F.col("total").alias("total_a"), "v")
    other = own.select("lang", F.col("a").alias("b"), F.col("total_a").alias("total_b"))
    f = lambda p, q: F.call_function("div", (F.col(p) - F.col(q)) * (F.col(p) - F.col(q)), F.col(q))
    both = own.join(other, ["lang"]).where("a <> b").withColumns({"a0": _per(F.lit(0), F.col("total_a")), "b0": _per(F.lit(0), F.col("total_b"))})
    none = both.select("lang", "a", "b", (F.col("v") * f("a0", "b0")).alias("value"))
    moved = counts.select("lang", F.col("source").alias("a"), "count", "h").join(both, ["lang", "a"]).withColumn("p", _per(F.col("count"), F.col("total_a")))
    there = moved.select("lang", "a", "b", (F.col("h") * (f("p", "b0") - f("a0", "b0"))).alias("value"))
    back = moved.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), (F.col("h") * (f("b0", "p") - f("b0", "a0"))).alias("value"))
    extra = found.where("part = 'both'").select("lang", F.col("source").alias("a"), F.col("item").alias("b"), "value")
    empty = groups.where("v = 0").select("lang", F.col("source").alias("a"))
    zero = empty.join(empty.withColumnRenamed("a", "b"), ["lang"]).where("a <> b").withColumn("value", F.lit(0).cast("long"))
    sums = none.unionByName(there).unionByName(back).unionByName(extra).unionByName(zero)
    pairs = sums.groupBy("lang", F.col("a").alias("source"), F.lit("pair").alias("part"), F.col("b").alias("item")).agg(F.sum("value").alias("value"))
    terms = found.where("part = 'term'").select("lang", "source", "part", "item", "value")
    # every task has passed on a group's first terms: they are thinned out share by share, before a group meets in one task
    share = F.pmod(F.xxhash64("item"), F.lit(SHARES))
    first = F.row_number().over(Window.partitionBy("lang", "source", "share").orderBy(F.desc("value"), "item"))
    terms = terms.withColumn("share", share).withColumn("rank", first).where(F.col("rank") <= top).drop("share", "rank")
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    return pairs.unionByName(terms).withColumn("rank", rank).where((F.col("part") == "pair") | (F.col("rank") <= top))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For nulls, repeats, ties, other columns and empty tables see source_divergence."""
    return source_divergence(table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
t AS (SELECT r, lang, source, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
own AS (SELECT lang, source, term, count(*) AS c FROM t JOIN kept USING (lang, term) GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT lang, count(*) AS v, sum(n) AS n FROM kept GROUP BY lang),
s AS (SELECT g.lang, g.source, coalesce(sum(c), 0) AS n FROM g LEFT JOIN own USING (lang, source) GROUP BY ALL),
every AS (
  SELECT s.lang, s.source, k.term, coalesce(c, 0) AS c, 1 + (1000000000::HUGEINT * (coalesce(c, 0) + 1)) // (s.n + v.v) AS p,
         1 + (1000000000::HUGEINT * (k.n + 1)) // (v.n + v.v) AS q
  FROM s JOIN kept k USING (lang) JOIN v USING (lang) LEFT JOIN own USING (lang, source, term)),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM every a JOIN every b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
q AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(p.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
  UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM every WHERE c > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM q QUALIFY part = 'pair' OR rank <= 200
"""
