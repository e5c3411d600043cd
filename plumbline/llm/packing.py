"""Best-fit packing of documents into sequences, in bulk-synchronous sweeps over a range of lengths at a time."""

from __future__ import annotations

import re
import unicodedata
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import batches, table, written
from .token_counts import tokenizer_path

#: Words whose ids a task keeps (some 200 bytes each); beyond it, words are encoded anew each time.
WORDS_KEPT = 150_000
#: Shares of documents and gaps in a sweep, each a task's, at most; pieces of a share at least, since each share may leave
#: a sequence open; lengths below which no range is halved any more.
SHARES, SHARE, SHORTEST = 8, 10_000, 64
#: Rows of the table of bases up to which it is broadcast (some 60 bytes each); else pieces and bases are shuffled.
BROADCAST = 300_000
_tail = re.compile(rb"[.,;:!?]+\Z")
_codecs: dict = {}


def _byte_letters() -> dict[int, str]:
    """Byte-level BPE's letter for each byte: printable bytes stand for themselves, the others follow from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordIds(dict):
    """Ids (little-endian uint32) of the words of one tokenizer.

    The tokenizer drops white space and never joins across it, so a text's ids are those of its words in turn. Lower
    case for A-Z is part of the tokenizer. A word's last run of sentence marks is split off if a letter stands before it
    once the tokenizer has normalised the word (a mark on the letter would join the run), so that "word," and "word"
    share an entry. A word of Latin letters alone goes to the BPE model at once, in the form that the tokenizer's own
    normalisation gives it.
    """

    def __init__(self, path: str):
        import os

        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.letters = self.tokenizer.model, _byte_letters()
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]

    def __missing__(self, word: bytes) -> bytes:
        cut = _tail.search(word)
        if cut and cut.start() and len(word) < 200 and unicodedata.normalize("NFC", word[: cut.start()].decode()).lower()[-1].isalpha():
            got = self[word[: cut.start()]] + self[word[cut.start() :]]
        else:
            text = unicodedata.normalize("NFC", word.decode()).lower()
            if text.isalpha() and max(text) < "\u0250":
                got = np.array([t.id for t in self.model.tokenize(text.encode().decode("latin-1").translate(self.letters))], "<u4").tobytes()
            else:
                got = self.encode(word.decode())
        if len(self) < WORDS_KEPT and len(word) < 64:
            self[word] = got
        return got

    def encode(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text.encode("utf-8", "replace").decode(), add_special_tokens=False).ids, "<u4").tobytes()

    def of(self, text: str | None) -> bytes:
        """The ids of a whole text; of a null text none."""
        if not text:
            return b""
        raw = text.encode("utf-8", "replace")
        if any(s in raw.lower() for s in self.special):  # a special token's string isn't lower-cased first
            return self.encode(text)
        return b"".join(map(self.__getitem__, raw.lower().split()))


def word_ids(path: str) -> WordIds:
    if path not in _codecs:
        _codecs[path] = WordIds(path)
    return _codecs[path]


def pieces(docs: DataFrame, path: str, size: int = 2048, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids], shard, place): each document's ids and end_id, cut at `size`.

    shard is the task that made the row and place the row's number among its shard's pieces of the same length: read
    them from a written table, where they are settled whatever task was run twice.
    """

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec, shard, places = word_ids(path), TaskContext.get().partitionId(), np.zeros(size + 1, np.int64)
        end = np.array([end_id], "<u4").tobytes()
        try:
            for frame in batches(frames, "text"):
                rows = []
                for doc, text in zip(frame["doc_id"], frame["text"]):
                    ids = codec.of(text) + end
                    for k, at in enumerate(range(0, len(ids), 4 * size)):
                        part = ids[at : at + 4 * size]
                        n = len(part) // 4
                        rows.append((doc, k, at // 4, n, zlib.crc32(part), shard, places[n], *([np.frombuffer(part, "<u4").astype(np.int32)] if with_ids else [])))
                        places[n] += 1
                yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32", "shard", "place", *(["ids"] if with_ids else [])])
        finally:
            codec.clear()  # the worker stays for tasks of other stages

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInPandas(cut, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, shard int, place long" + ", ids array<int>" * with_ids)


def swept(docs: list[tuple[int, int, int]], gaps: list[tuple[int, int, int]], size: int, base: int) -> tuple[list[tuple], list[tuple]]:
    """Best fit of runs of pieces (length, first, n) into runs of gaps (gap, sequence, n): the runs placed, and the gaps
    that are left.

    A run placed (length, first, n, sequence, offset): the pieces of this length ranked first, ..., first + n - 1 go to
    the sequences sequence, sequence + 1, ... at this offset. Equal lengths are interchangeable and so are equal gaps, so
    a run is one row however many pieces it has. Each step (longest pieces first) takes their successor among the gaps,
    the smallest that holds them, matches as many as both have, in order of rank, and puts the matched gaps back,
    smaller by the length. Pieces that no gap holds open new sequences, numbered from base.
    """
    held: dict[int, list[tuple[int, int]]] = {}
    order: list[int] = []
    runs: list[tuple[int, int, int, int, int]] = []
    opened = base

    def put(gap: int, sequence: int, n: int) -> None:
        if gap > 0:
            if gap not in held:
                held[gap] = []
                insort(order, gap)
            held[gap].append((sequence, n))

    for gap, sequence, n in sorted(gaps, reverse=True):
        put(gap, sequence, n)
    for length, rank, left in sorted(docs, reverse=True):
        while left:
            k = bisect_left(order, length)
            if k < len(order):
                gap = order[k]
                sequence, n = held[gap].pop()
                if not held[gap]:
                    del held[gap]
                    order.pop(k)
                take = min(n, left)
                if n > take:
                    put(gap, sequence + take, n - take)
            else:
                gap, sequence = size, opened
                take = max(1, left // (size // length)) if left >= size // length else 1
                opened += take
            runs.append((length, rank, take, sequence, size - gap))
            put(gap - length, sequence, take)
            left, rank = left - take, rank + take
    return runs, [(gap, *run) for gap, own in held.items() for run in own]


def best_fit_runs(counts: dict[int, int], size: int) -> pd.DataFrame:
    """One sweep over counts[n] pieces of each length n, as the runs placed."""
    return pd.DataFrame(swept([(length, 0, n) for length, n in counts.items()], [], size, 0)[0], columns=["length", "first", "n", "sequence", "offset"])


def length_ranges(size: int) -> list[tuple[int, int]]:
    """(low, high] from the longest lengths down: halves, then all that is left."""
    out, high = [], size
    while high > SHORTEST:
        out.append((high // 2, high))
        high //= 2
    return [*out, (0, high)]


def best_fit(counts: DataFrame, size: int) -> DataFrame:
    """(length, first, n, sequence, offset): the best-fit assignment of counts (length, n) to sequences of `size`.

    Pieces and gaps are range-sorted, as runs. A step takes the pieces of the next range of lengths and the gaps that
    can hold any of them, and deals both out in shares of consecutive ranks, so that no two tasks want the same gap.
    Each task sweeps its share (see swept; among pieces that want one gap the longer, then the lower rank has it); the
    gaps it leaves are dealt out anew in the next step, with those too small for this one. So short pieces find the
    gaps that all tasks left. Runs are split by lengths, shares and the pieces of a sequence, not by the corpus: where
    all counts double, they stay as they are. Each step is a table in the shared folder, as recovery needs.
    """
    spark = counts.sparkSession
    shares = min(SHARES, 1 + (counts.agg(F.sum("n")).first()[0] or 0) // SHARE)
    gaps = spark.createDataFrame([], "gap long, sequence long, n long")
    found = None

    def dealt(df: DataFrame, kind: int, what: str, start: str, turn: int) -> DataFrame:
        """The runs cut into shares; the rest of a division goes to another share in every run and step."""
        rest = F.pmod(F.xxhash64(what, start, F.lit(turn)), F.lit(shares))
        edge = lambda s: F.floor((F.col("n") * s + rest) / shares).cast("long")
        cut = df.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1)))).withColumn("a", edge(F.col("share"))).withColumn("n", edge(F.col("share") + 1) - F.col("a"))
        return cut.where("n > 0").select("share", F.lit(kind).alias("kind"), F.col(what).alias("what"), (F.col(start) + F.col("a")).alias("start"), "n")

    def sweep(turn: int):
        def one(frame: pd.DataFrame) -> pd.DataFrame:
            of = lambda kind: list(frame.loc[frame["kind"] == kind, ["what", "start", "n"]].itertuples(index=False, name=None))
            runs, left = swept(of(0), of(1), size, (turn * shares + int(frame["share"].iloc[0])) << 40)
            return pd.DataFrame([(0, *r) for r in runs] + [(1, gap, 0, n, sequence, 0) for gap, sequence, n in left], columns=["kind", "length", "first", "n", "sequence", "offset"])

        return one

    for turn, (low, high) in enumerate(length_ranges(size)):
        docs = counts.where((F.col("length") > low) & (F.col("length") <= high)).withColumn("first", F.lit(0).cast("long"))
        both = dealt(docs, 0, "length", "first", turn).unionByName(dealt(gaps.where(F.col("gap") > low), 1, "gap", "sequence", turn))
        step = written(both.groupBy("share").applyInPandas(sweep(turn), "kind int, length long, first long, n long, sequence long, offset long"), "sweep")
        runs = step.where("kind = 0").drop("kind")
        found = runs if found is None else found.unionByName(runs)
        gaps = step.where("kind = 1").select(F.col("length").alias("gap"), "sequence", "n").unionByName(gaps.where(F.col("gap") <= low))
    return found


def pack(cut: DataFrame, size: int = 2048) -> DataFrame:
    """cut (a written table of `pieces`) with sequence_id and offset, and without shard and place.

    The pieces of a length are ranked by shard, then place: a prefix sum over the shards' counts, of which a task gets
    one length's (a row a shard). The ranks' runs (see best_fit; 40 bytes each, 140,000 for 300,000 pieces of all
    lengths, and at most some for each length, share and piece of a sequence) go to the executors sorted, to be looked up
    by binary search.
    """
    shards = written(cut.groupBy("length", "shard").agg(F.count(F.lit(1)).alias("n")), "shards")
    before = Window.partitionBy("length").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    bases = shards.select(F.col("length").alias("__l"), F.col("shard").alias("__s"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__base"))
    bases = bases.hint("broadcast" if shards.count() <= BROADCAST else "merge")
    runs = best_fit(written(shards.groupBy("length").agg(F.sum("n").alias("n")), "lengths"), size).orderBy("length", "first").toPandas()
    width = 1 << 44  # ranks of one length; its pieces would fill 2**44 rows
    sent = cut.sparkSession.sparkContext.broadcast(((runs["length"] * width + runs["first"]).to_numpy(np.int64), runs.to_numpy(np.int64)))
    ranked = cut.join(bases, (F.col("length") == F.col("__l")) & (F.col("shard") == F.col("__s")))
    ranked = ranked.withColumn("__rank", F.col("place") + F.col("__base")).drop("shard", "place", "__l", "__s", "__base")

    @F.pandas_udf("sequence_id long, offset long")
    def placed(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        keys, rows = sent.value
        lengths, ranks = length.to_numpy(np.int64), rank.to_numpy(np.int64)
        at = np.searchsorted(keys, lengths * width + ranks, "right") - 1
        return pd.DataFrame({"sequence_id": rows[at, 3] + ranks - rows[at, 1], "offset": rows[at, 4]})

    return ranked.withColumn("__p", placed("length", "__rank")).select(*(c for c in ranked.columns if c != "__rank"), "__p.sequence_id", "__p.offset")


def pack_documents(docs: DataFrame, path: str, size: int = 2048, *, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """Packs every document into sequences of at most `size` ids: a row per piece, with its sequence_id and offset.

    A document is its ids by the tokenizer at `path` and then end_id; a null or empty text is end_id alone. Longer ones
    are cut into pieces of `size`. with_ids keeps the ids of each piece. Rows that repeat a doc_id, or have none, are
    documents of their own. Other columns are not read. An empty table gives an empty one.
    """
    return pack(written(pieces(docs, path, size, end_id, with_ids), "pieces"), size)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 2048; null texts are empty ones, as pack_documents says."""
    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))
