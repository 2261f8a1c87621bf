"""License scans: TF-IDF cosine to license notices, then inheritance along directories.

1. Words of the templates get inverse document frequencies counted over all files, without
   the places where three words in a row are a notice's; any other word has the highest one.
   Template words in more than ``MAX_DF`` of all files outside notices carry no weight.
2. Headers: every run of one to four lines of a file that begins with a line holding
   a weighted template word is compared with every template; the best is the file's
   own license if its cosine reaches ``HEADER_COSINE``.
3. License files: a file whose whole text reaches ``FILE_COSINE``, or whose name is that
   of a license file and that has a license of its own, speaks for its directory.
4. Inheritance: distinct directories are joined with their ancestors and the directories
   that hold license files; the nearest ancestor wins. Files meet only the table of
   directories, so a directory with a third of all files is one row in the path join.

Defined results
* null or empty text: no own license; null path: no directory, so nothing is inherited and nothing declared;
* equal cosines: the license first in order of its name; several license files in a directory: that with
  the smallest path speaks;
* repeated rows: one result each; empty table: empty result; columns besides key, path and text are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

HEADER_COSINE = 0.6
FILE_COSINE = 0.6
MAX_DF = 0.1
RUN = 4
_WORD = re.compile(r"[^\W_]+(?:[.'-][^\W_]+)*")
_NAME = r"(?i)^(licen[cs]e|copying|unlicense)([.-].*)?$"

# Notices as the licenses' publishers word them.
TEMPLATES: dict[str, list[str]] = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
        "compliance with the License. You may obtain a copy of the License at"],
    "MIT": [
        "Released under the MIT License",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files, to deal in the Software without restriction"],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License"],
    "GPL-2.0": [
        "This work is licensed under the GNU General Public License, version 2",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation; either version 2 of the License"],
    "AGPL-3.0": ["Licensed under the GNU Affero General Public License, version 3"],
    "LGPL-3.0": ["Licensed under the GNU Lesser General Public License, version 3"],
    "BSD-3-Clause": [
        "Released under the BSD 3-Clause License",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"],
    "CC-BY-4.0": ["Licensed under CC BY 4.0",
                  "This work is licensed under a Creative Commons Attribution 4.0 International License"],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0",
                     "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0",
                     "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC0-1.0": ["To the extent possible under law, the author has waived all copyright and related rights to this work"],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
            "hereby granted"],
    "Unlicense": ["This is free and unencumbered software released into the public domain"],
    "Proprietary": ["All rights reserved"],
}


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


TRIGRAMS = frozenset(x for notices in TEMPLATES.values() for t in notices for x in zip(*(words(t)[i:] for i in range(3))))
VOCABULARY = frozenset(w for notices in TEMPLATES.values() for t in notices for w in words(t))


def _outside(text: str) -> set[str]:
    """Template words of a text at places outside the notices' three words in a row."""
    ws = words(text)
    inside = {j for i, x in enumerate(zip(ws, ws[1:], ws[2:])) if x in TRIGRAMS for j in (i, i + 1, i + 2)}
    return VOCABULARY.intersection([w for i, w in enumerate(ws) if i not in inside] if inside else ws)


def vocabulary_idf(files: DataFrame, text: str) -> tuple[dict[str, float], float]:
    """(weight of each template word, weight of any other word), from the documents of all files."""
    def count(batches: Iterator[pa.RecordBatch]):
        df, n = Counter(), 0
        for b in batches:
            n += b.num_rows
            for t in b.column("t"):
                if t.is_valid:
                    df.update(_outside(t.as_py()))
        yield pa.RecordBatch.from_arrays([pa.array(["", *df], pa.string()), pa.array([n, *df.values()], pa.int64())],
                                         names=["w", "n"])
    got = {r.w: r.n for r in files.select(F.col(text).alias("t")).mapInArrow(count, "w string, n long").groupBy("w")
           .agg(F.sum("n").alias("n")).collect()}  # one row per template word
    n = got.get("", 0)
    most = math.log(n + 2)
    return {w: 0.0 if got.get(w, 0) > max(MAX_DF * n, 20) else math.log((n + 2) / (got.get(w, 0) + 1))
            for w in VOCABULARY}, most


class Scanner:
    """Cosines of texts to all notices, through an inverted index of the notices' words."""

    def __init__(self, idf: dict[str, float], other: float):
        self.idf, self.other = idf, other
        self.index: dict[str, list[tuple[int, float]]] = defaultdict(list)
        self.names: list[str] = []
        for name in sorted(TEMPLATES):
            for notice in TEMPLATES[name]:
                v = self.vector(words(notice))
                norm = math.sqrt(sum(x * x for x in v.values()))
                for w, x in v.items():
                    if x:
                        self.index[w].append((len(self.names), x / norm))
                self.names.append(name)

    def vector(self, ws: list[str]) -> dict[str, float]:
        return {w: (1 + math.log(n)) * self.idf.get(w, self.other) for w, n in Counter(ws).items()}

    def best(self, ws: list[str]) -> tuple[float, str | None]:
        v = self.vector(ws)
        norm = math.sqrt(sum(x * x for x in v.values()))
        dots: dict[int, float] = defaultdict(float)
        for w, x in v.items():
            for i, y in self.index.get(w, ()):
                dots[i] += x * y
        if not dots or not norm:
            return 0.0, None
        i = max(dots, key=lambda i: (dots[i], -i))
        return min(1.0, dots[i] / norm), self.names[i]

    def scan(self, text: str) -> tuple[float, str | None, float, str | None]:
        """(best cosine of a run of lines, its license, cosine of the whole text, its license)."""
        lines = [words(x) for x in text.split("\n")]
        cues = [i for i, ws in enumerate(lines) if any(w in self.index for w in ws)]
        head: tuple[float, str | None] = (0.0, None)
        for i in cues:
            run: list[str] = []
            for ws in lines[i:i + RUN]:
                run = run + ws
                # cosine can only fall when most of the weight is foreign
                own = sum(self.idf.get(w, 0.0) ** 2 for w in set(run))
                if own < HEADER_COSINE ** 2 * sum(self.idf.get(w, self.other) ** 2 for w in set(run)) / 4:
                    break
                head = max(head, self.best(run), key=lambda x: x[0])
        whole = self.best([w for ws in lines for w in ws]) if cues else (0.0, None)
        return (*head, *whole)


_SCAN = "own_cosine double, own_license string, file_cosine double, file_license string"


def scan_files(files: DataFrame, key: str, path: str, text: str) -> DataFrame:
    """Per row: key, path, the best header and whole-text matches."""
    idf, other = vocabulary_idf(files, text)
    types = dict(files.dtypes)

    def scan(batches: Iterator[pa.RecordBatch]):
        scanner = Scanner(idf, other)
        for b in batches:
            out = [scanner.scan(t.as_py()) if t.is_valid else (0.0, None, 0.0, None) for t in b.column("t")]
            cols = list(zip(*out)) if out else [()] * 4
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), *[pa.array(c, t) for c, t in zip(cols, (pa.float64(), pa.string()) * 2)]],
                names=["k", "path", "own_cosine", "own_license", "file_cosine", "file_license"])
    return files.select(F.col(key).alias("k"), F.col(path).alias("path"), F.col(text).alias("t")).mapInArrow(
        scan, f"k {types[key]}, path string, " + _SCAN)


def directory(path: Column) -> Column:
    """The directory of a path, ``""`` for the top."""
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def inherit(dirs: DataFrame, declared: DataFrame) -> DataFrame:
    """dirs (dir), declared (dir, license) -> dir, license_dir, inherited_license of the nearest ancestor or itself."""
    parts = F.split("dir", "/")
    ancestors = dirs.select("dir", F.explode(F.sequence(F.lit(0), F.when(F.col("dir") == "", 0).otherwise(
        F.size(parts)))).alias("depth"))
    ancestors = ancestors.withColumn("license_dir", F.array_join(F.slice(parts, 1, F.col("depth")), "/"))
    hits = ancestors.join(declared.select(F.col("dir").alias("license_dir"), "license"), "license_dir")
    return hits.groupBy("dir").agg(F.max(F.struct("depth", "license_dir", "license")).alias("m")).select(
        "dir", F.col("m.license_dir").alias("license_dir"), F.col("m.license").alias("inherited_license"))


def scan_licenses(files: DataFrame, key: str, path: str, text: str, header_cosine: float = HEADER_COSINE,
                  file_cosine: float = FILE_COSINE) -> DataFrame:
    """Per row: key, path, own_license, own_cosine, is_license_file, license_dir, inherited_license, license."""
    s = materialize(scan_files(files, key, path, text), "license-scan")
    named = F.regexp_extract(F.col("path"), r"([^/]*)$", 1).rlike(_NAME)
    whole = F.coalesce(F.col("file_cosine") >= file_cosine, F.lit(False))
    is_file = whole | F.coalesce(named & (F.col("own_cosine") >= header_cosine), F.lit(False))
    s = (s.withColumn("dir", directory(F.col("path"))).withColumn("is_license_file", is_file)
         .withColumn("own_license", F.when(F.col("own_cosine") >= header_cosine, F.col("own_license")))
         .withColumn("declares", F.when(whole, F.col("file_license")).otherwise(F.col("own_license"))))
    declared = s.where("is_license_file AND path IS NOT NULL").groupBy("dir").agg(
        F.min_by("declares", "path").alias("license"))
    dirs = inherit(s.where("path IS NOT NULL").select("dir").distinct(), declared)
    out = s.join(dirs, "dir", "left")
    return out.select(F.col("k").alias(key), "path", "own_license", "own_cosine", "is_license_file", "license_dir",
                      "inherited_license",
                      F.coalesce("own_license", F.when(F.col("is_license_file"), F.col("declares")),
                                 "inherited_license").alias("license"))
