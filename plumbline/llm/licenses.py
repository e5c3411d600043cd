"""License scans: TF-IDF cosine to templates, and inheritance from the nearest ancestor directory."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches, table, written

#: Directories up to which they are sent to all tasks (some 140 bytes each); beyond, only those with one in CROWDED of the files.
SENT, CROWDED = 300_000, 10_000
#: Notices and headers by which licences are declared, and first and last words of licence files.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "MIT License Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This library is free software licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work under CC0 1.0."),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991 Copyright (C) 1989, 1991 Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007 This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the GNU General Public License"),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007 Copyright (C) 2007 Free Software Foundation, Inc."),
    ("MPL-2.0", "Mozilla Public License Version 2.0 1. Definitions 1.1. \"Contributor\" means each individual or legal entity that creates, contributes to the creation of, or owns Covered Software."),
    ("MIT", "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)
_token = re.compile(r"[a-z]+(?:-[a-z]+)*|[0-9]+(?:\.[0-9]+)*")
#: Names of files that hold a licence for their directory.
_file = re.compile(r"(?:^|/)(?:un)?(?:licen[sc]e|copying|notice)[^/]*$", re.I)


def tokens(text: str | None) -> list[str]:
    return _token.findall(text.lower()) if text else []


#: Words of the templates that any text may hold. All others are searched for however many files hold them.
PLAIN = frozenset("a above all and any are as at be by either except for from have in into is it may met must not of on or other provided so subject such that the their there they this to under use used was were which will with without you your".split())
VOCABULARY = frozenset(t for _, text in TEMPLATES for t in tokens(text))


class Scanner:
    """Templates and inverse document frequencies, ready to score texts."""

    def __init__(self, n: int, df: dict[str, int], templates=TEMPLATES, rare: float = 1.5, gap: int = 4, least: int = 3):
        self.idf = {t: math.log((1 + n) / (1 + df.get(t, 0))) + 1e-3 for _, text in templates for t in tokens(text)}
        self.other = math.log(1 + n) + 1e-3
        self.gap, self.least = gap, least
        # a notice in many files makes its own words frequent: they keep the weight from which words are searched for
        bound = min(rare, 0.5 * self.other)
        self.idf = {t: x if t in PLAIN else max(x, bound) for t, x in self.idf.items()}
        self.hits = frozenset(t for t, x in self.idf.items() if x >= bound)
        self.templates = [(name, *self._vector(tokens(text))) for name, text in templates]

    def _vector(self, words: list[str]) -> tuple[dict[str, float], float]:
        v = {t: n * self.idf.get(t, self.other) for t, n in Counter(words).items()}
        return v, math.sqrt(sum(x * x for x in v.values()))

    def segments(self, words: list[str]) -> list[tuple[int, int]]:
        """Stretches of words from one searched template word to another, no more than `gap` words apart, of `least` at
        least; and their parts without a word that no template has, since such words outweigh those of a frequent notice."""
        out, hits = [], self.hits
        for at in self._runs([i for i, w in enumerate(words) if w in hits], lambda i, j: j - i <= self.gap):
            out.append((at[0], at[-1] + 1))
            foreign = [w not in self.idf for w in words[at[0] : at[-1] + 1]]
            if any(foreign):
                out += [(p[0], p[-1] + 1) for p in self._runs(at, lambda i, j: not any(foreign[i - at[0] : j - at[0]]))]
        return out

    def _runs(self, places: list[int], near) -> list[list[int]]:
        """The places in runs of neighbours that are near, `least` at least."""
        runs: list[list[int]] = []
        for i in places:
            if runs and near(runs[-1][-1], i):
                runs[-1].append(i)
            else:
                runs.append([i])
        return [r for r in runs if len(r) >= self.least]

    def scan(self, text: str | None) -> tuple[str | None, float, float]:
        """The licence that a stretch of the text is most like (ties: the first name), its cosine, and the stretch's
        share of the text's words. (None, 0, 0) without a stretch."""
        words = tokens(text)
        best: tuple = (0.0, "", 0)
        for a, b in self.segments(words):
            v, size = self._vector(words[a:b])
            for name, t, norm in self.templates:
                dot = sum(x * t[w] for w, x in v.items() if w in t)
                cosine = dot / (size * norm) if size and norm else 0.0
                if cosine > best[0] or cosine == best[0] > 0 and name < best[1]:
                    best = (cosine, name, b - a)
        return (best[1], min(1.0, best[0]), best[2] / len(words)) if best[0] else (None, 0.0, 0.0)


def template_frequencies(files: DataFrame) -> tuple[int, dict[str, int]]:
    """How many files there are and how many hold each word of the templates: counted over all, a few hundred numbers."""

    def counted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, df = 0, Counter()
        for frame in frames:
            for text in frame["text"]:
                n += 1
                df.update(VOCABULARY.intersection(tokens(text)))
        yield pd.DataFrame({"word": ["", *df], "n": [n, *df.values()]})

    found = {r[0]: r[1] for r in files.select("text").mapInPandas(counted, "word string, n long").groupBy("word").agg(F.sum("n")).collect()}
    return found.pop("", 0), found


def directory(path):
    return F.regexp_replace(path, r"/?[^/]*$", "")


def scan_licenses(files: DataFrame, *keep: str, threshold: float = 0.6, file_share: float = 0.5) -> DataFrame:
    """Per row of files (path, text): the columns `keep`, path, own_license, own_score, is_license_file, license, origin,
    from_dir.

    A text's own licence is the template that a stretch of it is most like, from a cosine of `threshold` on; whole texts
    are searched. A file is a licence file if it has an own licence and the name of one, or if the stretch is
    file_share of its words or more. Files without an own licence inherit that of the nearest ancestor directory
    (their own first) with a licence file; of several there, the highest score, then the first name. origin is own,
    inherited or null. Null texts have no own licence; a null path is in no directory; a path without a slash is in the
    root directory ''. Repeated paths are scored each. Other columns are not read; an empty table gives an empty one.

    Directories, not files, meet their ancestors: a row for each level, so a hot directory is one row there.
    """
    sent = files.sparkSession.sparkContext.broadcast(Scanner(*template_frequencies(files)))  # the templates' size

    def scanned(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scanner = sent.value
        for frame in batches(frames, "text"):
            found = [scanner.scan(t) for t in frame["text"]]
            rows = [(n if s >= threshold else None, s if s >= threshold else 0.0, bool(s >= threshold and (share >= file_share or (p and _file.search(p))))) for p, (n, s, share) in zip(frame["path"], found)]
            out = pd.DataFrame(rows, columns=["own_license", "own_score", "is_license_file"], index=frame.index)
            yield pd.concat([frame[[*held, "path"]], out], axis=1)

    held, kinds = [f"__k{i}" for i in range(len(keep))], dict(files.dtypes)
    thin = files.select(*(F.col(f"`{c}`").alias(k) for c, k in zip(keep, held)), "path", "text")
    schema = ", ".join([*(f"{k} {kinds[c]}" for c, k in zip(keep, held)), "path string, own_license string, own_score double, is_license_file boolean"])
    own = written(thin.mapInPandas(scanned, schema).withColumn("dir", directory(F.col("path"))), "licenses")
    declared = own.where("is_license_file and dir is not null").groupBy(F.col("dir").alias("at")).agg(F.min(F.struct((-F.col("own_score")).alias("s"), F.col("own_license").alias("license"))).alias("best")).select("at", F.col("best.license").alias("license"))
    parts = F.split("dir", "/")
    above = F.when(F.col("dir") == "", F.array(F.struct(F.lit(0).alias("depth"), F.lit("").alias("at")))).otherwise(
        F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.struct(k.alias("depth"), F.array_join(F.slice(parts, F.lit(1), k), "/").alias("at")))
    )
    bare = own.where("own_license is null")
    dirs = bare.select("dir").where("dir is not null").distinct().select("dir", F.explode(above).alias("up")).select("dir", "up.depth", "up.at")
    nearest = dirs.join(declared, "at").groupBy(F.col("dir").alias("of")).agg(F.max(F.struct("depth", "license", "at")).alias("up"))
    # only files that have none look for one. A directory may hold a third of them: while not all directories can be sent, the
    # crowded ones are, at most CROWDED, so that no join gathers the files of one
    nearest = written(nearest, "nearest")
    if nearest.count() <= SENT:
        found = bare.join(F.broadcast(nearest), F.col("dir") == F.col("of"), "left")
    else:
        crowded = written(bare.groupBy(F.col("dir").alias("c")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") * CROWDED >= bare.count()).select("c"), "crowded")
        hot, rest = (bare.join(F.broadcast(crowded), F.col("dir") == F.col("c"), how) for how in ("left_semi", "left_anti"))
        sent = nearest.join(F.broadcast(crowded), F.col("of") == F.col("c"), "left_semi")
        found = hot.join(F.broadcast(sent), F.col("dir") == F.col("of"), "left").unionByName(rest.join(nearest, F.col("dir") == F.col("of"), "left"))
    columns = [*own.columns, "up"]
    joined = found.select(*columns).unionByName(own.where("own_license is not null").withColumn("up", F.lit(None).cast(dict(nearest.dtypes)["up"])))
    mine = F.col("own_license").isNotNull()
    return joined.select(
        *(F.col(k).alias(c) for c, k in zip(keep, held)), "path", "own_license", "own_score", "is_license_file", F.coalesce("own_license", "up.license").alias("license"),
        F.when(mine, "own").when(F.col("up.license").isNotNull(), "inherited").alias("origin"), F.when(~mine, F.col("up.at")).alias("from_dir"),
    )


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files source/lang/(doc_id div 50)/doc_id.txt. Every seventh is named as a licence file instead, of its
    source's directory or, an odd one, of its lang's; a null part of a path is called none."""
    docs, part = table(spark, sf_dir, "documents"), lambda c: F.coalesce(F.col(c).cast("string"), F.lit("none"))
    i = F.col("doc_id")
    inner = F.concat_ws("/", part("source"), part("lang"), F.coalesce(F.floor(i / 50).cast("string"), F.lit("none")), F.concat(part("doc_id"), F.lit(".txt")))
    above = F.concat_ws("/", part("source"), F.when(i % 2 != 0, part("lang")), F.concat(F.lit("LICENSE-"), part("doc_id")))
    return scan_licenses(docs.select("doc_id", "text", F.when(i % 7 == 0, above).otherwise(inner).alias("path")), "doc_id")
