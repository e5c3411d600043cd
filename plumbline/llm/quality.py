"""Quality rules: base counts, then distribution divergence from language references."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import batches, table, written

CLASSES = ("lower", "upper", "digit", "space", "stop", "symbol", "other ASCII", "letter", "other")
#: Languages whose references are sent to the executors (a few KB each); of more, each row gets its own by a join.
MAX_LANGS = 5000
#: Common words of a language's reference.
COMMON = 64
_SYMBOLS = re.compile(r"[#*$%&|<>]")
_SPACES = re.compile(r"[\x20\x09-\x0D]")


def _class_table() -> np.ndarray:
    """The class of each code point of the basic plane; one more for all beyond it."""
    of = np.full(65537, 8, np.uint8)
    for i in range(65536):
        c = chr(i)
        if i >= 128:
            of[i] = 7 if c.isalpha() else 8
        else:
            of[i] = 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3 if c.isspace() else 4 if c in ".,;:!?'\"()-" else 5 if c in "#*$%&|<>" else 6
    return of


_table: list[np.ndarray] = []


def class_counts(text: str) -> np.ndarray:
    """Characters of the text by class."""
    if not _table:
        _table.append(_class_table())
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    return np.bincount(_table[0][np.minimum(points, 65536)], minlength=len(CLASSES))


def base_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text; all 0 for null."""
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()
    lines, seen, dup = text.split("\n"), set(), 0
    for line in lines:
        if line in seen:
            dup += 1
        elif _SPACES.sub("", line):
            seen.add(line)
    windows = list(zip(words, words[1:], words[2:]))
    repeat = 0
    if len(set(windows)) < len(windows):
        often = Counter(windows)
        upto = 0
        for i, w in enumerate(windows):
            if often[w] > 1:
                repeat += i + 3 - max(i, upto)
                upto = i + 3
    return len(words), len(text) - len(_SPACES.findall(text)), len(_SYMBOLS.findall(text)), dup, repeat


def base_failed(n_words: int, n_repeat_words: int) -> bool:
    return n_words < 50 or 100 * n_repeat_words > 50 * n_words


def js_distance(p: np.ndarray, q: np.ndarray) -> float:
    """The Jensen-Shannon distance (base 2, from 0 to 1) of two histograms; 0 if one is empty."""
    if p.sum() == 0 or q.sum() == 0:
        return 0.0
    p, q = p / p.sum(), q / q.sum()
    m = (p + q) / 2
    part = lambda x: float((x[x > 0] * np.log2(x[x > 0] / m[x > 0])).sum())
    return max(0.0, (part(p) + part(q)) / 2) ** 0.5


def lower_words(text: str) -> list[bytes]:
    """The words of a text, `[^\\x20\\x09-\\x0D]+`, in lower case of all scripts, a code point for each as SQL's `lower` has it:
    `str.lower` alone tells a final sigma apart and makes two of a dotted I."""
    return text.replace("\u03a3", "\u03c3").replace("\u0130", "i").lower().encode("utf-8").split()


def language_references(docs: DataFrame, common: int = COMMON) -> DataFrame:
    """(lang, classes array<long>, names array<string>, counts array<long>) of each lang with text (null is one): its class
    histogram, its most common words, and their numbers with that of all other words last. Counted over all documents;
    ties between words go to the smaller one."""

    def counted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {}
        for frame in frames:
            for lang, text in zip(frame["lang"], frame["text"]):
                if text:
                    words, classes = held.setdefault(lang if isinstance(lang, str) else None, (Counter(), np.zeros(len(CLASSES), np.int64)))
                    words.update(lower_words(text))
                    classes += class_counts(text)
            if sum(len(w) for w, _ in held.values()) > 300_000:
                yield from given(held)
        yield from given(held)

    def given(held: dict) -> Iterator[pd.DataFrame]:
        for lang, (words, classes) in held.items():
            for kind, names, counts in ((0, [w.decode() for w in words], list(words.values())), (1, [str(i) for i in range(len(CLASSES))], classes)):
                if names:
                    yield pd.DataFrame({"lang": [lang] * len(names), "kind": kind, "name": names, "n": counts})
        held.clear()

    counts = docs.select("lang", "text").mapInPandas(counted, "lang string, kind int, name string, n long")
    words = written(counts.groupBy("lang", "kind", "name").agg(F.sum("n").alias("n")), "words")
    of = lambda i: F.coalesce(F.sum(F.when((F.col("kind") == 1) & (F.col("name") == str(i)), F.col("n"))), F.lit(0))
    sums = words.groupBy("lang").agg(F.array(*(of(i) for i in range(len(CLASSES)))).alias("classes"), F.coalesce(F.sum(F.when(F.col("kind") == 0, F.col("n"))), F.lit(0)).alias("total"))
    # each part of the words keeps its own top, so that a language of a third of all rows is dealt out
    part = F.pmod(F.xxhash64("name"), F.lit(64))
    first = Window.partitionBy("lang", "part").orderBy(F.desc("n"), "name")
    tops = words.where("kind = 0").withColumn("part", part).withColumn("k", F.row_number().over(first)).where(F.col("k") <= common)
    top = tops.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "name"))).where(F.col("k") <= common)
    listed = top.groupBy(F.col("lang").alias("l")).agg(F.sort_array(F.collect_list(F.struct("k", "name", "n"))).alias("top"))  # `common` of a lang
    joined = sums.join(listed, F.col("lang").eqNullSafe(F.col("l")), "left")
    known = F.coalesce(F.col("top.n"), F.array().cast("array<bigint>"))
    rest = F.col("total") - F.aggregate(known, F.lit(0).cast("bigint"), lambda x, y: x + y)
    return written(joined.select("lang", "classes", F.coalesce(F.col("top.name"), F.array().cast("array<string>")).alias("names"), F.concat(known, F.array(rest)).alias("counts")), "references")


def as_reference(classes, names, counts) -> tuple[np.ndarray, dict[bytes, int], np.ndarray]:
    return np.asarray(classes, np.float64), {w.encode(): i for i, w in enumerate(names)}, np.asarray(counts, np.float64)


def divergence(text: str, reference: tuple) -> tuple[int, float, float]:
    """Characters, and the distances of the text's class and common-word histograms from the reference's."""
    classes, places, common = reference
    own = class_counts(text)
    words = np.zeros(len(common))
    rest = len(places)
    for word, n in Counter(lower_words(text)).items():
        words[places.get(word, rest)] += n
    return int(own.sum()), js_distance(own.astype(np.float64), classes), js_distance(words, common)


def quality_rules(docs: DataFrame, *, common: int = COMMON, max_class: float = 0.30, max_words: float = 0.42, least_chars: int = 200, least_words: int = 100) -> DataFrame:
    """Per row of docs: doc_id, the base counts, base_failed, class_distance, word_distance, kept.

    The distances compare a text's histograms to those of all documents of its lang. A distance only counts from
    least_chars characters or least_words words on, since short histograms are noise: below, the text is not rejected by
    it. kept is false if base_failed, or if a distance that counts is over max_class or max_words. A null lang is a
    language of its own. A null or empty text has counts 0, distances 0, and fails the base rules. Ties and repeated
    rows are judged alike; other columns are not read; an empty table gives an empty one.
    """
    references = language_references(docs, common)
    size = F.aggregate("classes", F.lit(0).cast("bigint"), lambda x, y: x + y)
    sent = docs.sparkSession.sparkContext.broadcast({r["lang"]: as_reference(r["classes"], r["names"], r["counts"]) for r in references.orderBy(F.desc(size), "lang").limit(MAX_LANGS).collect()})
    own = docs.select("doc_id", "lang", "text")

    def judged(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = sent.value
        for frame in batches(frames, "text"):
            rows = []
            for i, (lang, text) in enumerate(zip(frame["lang"], frame["text"])):
                counts = base_counts(text)
                failed, chars, a, b = base_failed(counts[0], counts[4]), 0, 0.0, 0.0
                if text:
                    lang = lang if isinstance(lang, str) else None
                    reference = known[lang] if lang in known else as_reference(*(frame[c].iloc[i] for c in ("classes", "names", "counts")))
                    chars, a, b = divergence(text, reference)
                far = chars >= least_chars and a > max_class or counts[0] >= least_words and b > max_words
                rows.append((*counts, failed, a, b, not failed and not far))
            out = pd.DataFrame(rows, columns=["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "class_distance", "word_distance", "kept"])
            yield out.assign(doc_id=frame["doc_id"].to_numpy())[["doc_id", *out.columns]]

    kind = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, class_distance double, word_distance double, kept boolean"
    if references.count() <= MAX_LANGS:
        return own.mapInPandas(judged, schema)
    # the languages of most text are sent; each of the others, which are joined, has less than one in MAX_LANGS of the text
    largest = references.sparkSession.createDataFrame([(k,) for k in sent.value], "l string")
    often = own.join(F.broadcast(largest), F.col("lang").eqNullSafe(F.col("l")), "left_semi")
    rest = own.join(F.broadcast(largest), F.col("lang").eqNullSafe(F.col("l")), "left_anti").join(references.withColumnRenamed("lang", "l"), F.col("lang").eqNullSafe(F.col("l")), "left").drop("l")
    return often.mapInPandas(judged, schema).unionByName(rest.mapInPandas(judged, schema))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distances are rounded to six places, which SQL's sums in another order share; the verdict is not."""
    found = quality_rules(table(spark, sf_dir, "documents"))
    return found.withColumns({c: F.round(c, 6) for c in ("class_distance", "word_distance")})


#: The same rules: characters and words as rows, their histograms joined to those of the language.
OP6_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, lang, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
base AS (
  SELECT r, doc_id, lang, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS word_chars,
         length(text) AS chars, length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM d),
thirds AS (SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS t FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
often AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, t) AS n FROM thirds) WHERE n > 1),
repeats AS (SELECT r, count(DISTINCT i + k) AS n FROM often, (VALUES (0), (1), (2)) x(k) GROUP BY r),
letters AS (SELECT r, lang, unnest(regexp_extract_all(text, '(?s).')) AS c FROM d),
classed AS (
  SELECT r, lang, CASE WHEN unicode(c) >= 65536 THEN 8 WHEN unicode(c) >= 128 THEN CASE WHEN regexp_matches(c, '\p{L}') THEN 7 ELSE 8 END
    WHEN regexp_matches(c, '[a-z]') THEN 0 WHEN regexp_matches(c, '[A-Z]') THEN 1 WHEN regexp_matches(c, '[0-9]') THEN 2
    WHEN regexp_matches(c, '[\x20\x09-\x0D\x1C-\x1F]') THEN 3 WHEN regexp_matches(c, '[.,;:!?''"()\-]') THEN 4 WHEN regexp_matches(c, '[#*$%&|<>]') THEN 5 ELSE 6 END AS k, count(*) AS n
  FROM letters GROUP BY ALL),
heard AS (SELECT r, lang, x, count(*) AS n FROM (SELECT r, lang, unnest(regexp_extract_all(lower(text), '[^\x20\x09-\x0D]+')) AS x FROM d) GROUP BY ALL),
top AS (SELECT lang, x, row_number() OVER (PARTITION BY lang ORDER BY sum(n) DESC, x) AS k FROM heard GROUP BY lang, x QUALIFY k <= 64),
placed AS (SELECT h.r, h.lang, coalesce(k, 0) AS k, sum(n) AS n FROM heard h LEFT JOIN top t ON h.lang IS NOT DISTINCT FROM t.lang AND h.x = t.x GROUP BY ALL),
every AS (SELECT 'c' AS what, r, lang, k, n FROM classed UNION ALL SELECT 'w', r, lang, k, n FROM placed),
reference AS (SELECT what, lang, k, n / sum(n) OVER (PARTITION BY what, lang) AS q FROM (SELECT what, lang, k, sum(n) AS n FROM every GROUP BY ALL)),
own AS (SELECT what, r, lang, k, n / sum(n) OVER (PARTITION BY what, r) AS p FROM every),
texts AS (SELECT DISTINCT what, r, lang FROM own),
paired AS (
  SELECT t.what, t.r, coalesce(p, 0) AS p, q FROM texts t JOIN reference f ON t.what = f.what AND t.lang IS NOT DISTINCT FROM f.lang
  LEFT JOIN own o ON o.what = t.what AND o.r = t.r AND o.k = f.k),
far AS (
  SELECT what, r, sqrt(greatest(0, sum((CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2))) AS js
  FROM paired GROUP BY what, r),
judged AS (
  SELECT b.*, coalesce(x.n, 0) AS n_repeat, coalesce(c.js, 0) AS a, coalesce(v.js, 0) AS z
  FROM base b LEFT JOIN repeats x USING (r) LEFT JOIN far c ON c.r = b.r AND c.what = 'c' LEFT JOIN far v ON v.r = b.r AND v.what = 'w')
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
       CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(n_repeat AS BIGINT) AS n_repeat_words,
       n_words < 50 OR 100 * n_repeat > 50 * n_words AS base_failed, round(a, 6) AS class_distance, round(z, 6) AS word_distance,
       NOT (n_words < 50 OR 100 * n_repeat > 50 * n_words) AND NOT (chars >= 200 AND a > 0.30 OR n_words >= 100 AND z > 0.42) AS kept
FROM judged
"""
