"""License scans (operator 1), DataFrame functions only.

A text is the row of its 5-word shingles. MinHash bands of overlapping windows of that row retrieve license templates;
a retrieved template is then verified by exact containment of its shingles in the document.
"""

from __future__ import annotations

import json
import math
import random
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of a shingle; share of a template's shingles that a document must contain.
WORDS, CONTAINED = 5, 0.8
#: A window is SPAN neighbouring blocks of BLOCK shingles and starts at every block, so windows overlap by two thirds, and
#: a piece of PIECE shingles lies whole in one of them wherever it starts.
BLOCK, SPAN = 3, 3
PIECE = BLOCK * (SPAN - 1) + 1
#: A template of fewer shingles must be whole to be contained to CONTAINED.
WHOLE = 5
#: The most that the bands of a template may miss together. Bands share one hash under different masks, so they are not independent: one
#: shingle that differs from all others in a high bit is the least under half of all masks. Computed over such masks, the
#: bands that would do if they were independent miss 0.0048, 0.0042 and 0.0027 of pieces of 5, 6 and 7; SURPLUS times as many 0.0008, 0.0007
#: and 0.0003.
MISS, SURPLUS = 0.001, 1.5


def bands_for(piece: int) -> int:
    """Bands (one minimum each) that meet a piece of so many shingles with a probability over 1 - MISS.

    If a template is contained to CONTAINED, so is one of its pieces; its Jaccard similarity with the window around it is then
    at least j, and a band misses with at most 1 - j.
    """
    kept = math.ceil(CONTAINED * piece)
    j = kept / (BLOCK * SPAN + piece - kept)
    return math.ceil(SURPLUS * math.ceil(math.log(MISS) / math.log(1 - j)))


#: Characters of the templates whose keys go into one plan, as three constant arrays; more templates take more passes over
#: the documents. A character makes about a quarter of a key at most.
PART_CHARS = 1 << 20
#: Slots for keys, at least, as a power of two: few keys then leave most slots empty, and a look at one settles most shingles.
SLOT_BITS = 13
_RANDOM = random.Random(1)
_MASKS = [_RANDOM.getrandbits(64) - 2**63 for _ in range(bands_for(WHOLE))]

#: Short notices and longer grants, as their licenses word them.
TEMPLATES = {
    "MIT": "Released under the MIT License.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "MIT-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so.",
    "BSD-disclaimer": "This software is provided by the copyright holders and contributors as is and any express or implied warranties, including, but not limited to, the implied warranties of merchantability and fitness for a particular purpose are disclaimed.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "ISC-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "BSD-conditions": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "GPL-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "MPL-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "Zlib-grant": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: The origin of this software must not be misrepresented; you must not claim that you wrote the original software.",
}


def _words(text: Column) -> Column:
    return F.split(F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " ")), " ")


def _shingled(df: DataFrame, text: str, words: str, out: str) -> DataFrame:
    """The array of shingle hashes in order, in column `out`; empty below WORDS words."""
    df = df.withColumn(words, _words(F.col(text)))
    hashed = F.transform(words, lambda x, i: F.xxhash64(x, *[F.get(F.col(words), i + k) for k in range(1, WORDS)]))
    return df.withColumn(out, F.slice(hashed, 1, F.greatest(F.size(words) - (WORDS - 1), F.lit(0)))).drop(words)


def _minima(h: str, band: int) -> Column:
    """Of each block, the least shingle under the band's permutation."""
    blocks = F.when(F.size(h) > 0, F.sequence(F.lit(0), F.ceil(F.size(h) / BLOCK).cast("int") - 1))
    return F.transform(blocks, lambda j: F.least(*[F.get(F.col(h), j * BLOCK + k).bitwiseXOR(F.lit(_MASKS[band])) for k in range(BLOCK)]))


def _template_keys(spark: SparkSession, templates: dict[str, str]) -> tuple[dict[int, list[int]], int, DataFrame]:
    """Keys with the numbers of the templates that have them, the bands that are in use, and the templates' shingles
    (license, license_id, s). A template below WHOLE shingles has its least shingle as key, so it is looked up as a band that
    has no mask, whatever the window. Bounded by PART_CHARS."""
    rows = F.from_json(F.lit(json.dumps([{"license_id": k, "t": v} for k, v in sorted(templates.items())])), "array<struct<license_id:string,t:string>>")
    known = _shingled(spark.range(1).select(F.posexplode(rows).alias("license", "row")).select("license", "row.*"), "t", "w", "row")
    known = known.select("license", "license_id", F.array_distinct("row").alias("s"), "row")
    keys: dict[int, list[int]] = {}
    bands = 0
    for license, _, s, row in known.collect():
        if not s:
            continue
        if len(s) < WHOLE:
            found = {min(row)}
        else:
            piece = min(PIECE, len(row))
            starts = {*range(0, len(row) - piece + 1, piece), len(row) - piece}
            bands = max(bands, bands_for(piece))
            found = {min(v ^ mask for v in row[at : at + piece]) for at in starts for mask in _MASKS[: bands_for(piece)]}
        for key in found:
            keys.setdefault(key, []).append(license)
    return keys, bands, known.select("license", "license_id", "s")


def _constant(values: list[int], kind: str) -> Column:
    """An array that the optimizer folds into one constant."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")


def _found(columns: list[str], keys: dict[int, list[int]]) -> Column:
    """The numbers of the templates of which a band of the document's windows has a key, each once.

    A window's minimum is one of its members' values, so only the rare members that are template keys are looked at: such a
    one is the minimum of a window if no member of that window is smaller. Keys lie in slots by their low bits; a
    slot's keys are neighbours, from ends[slot] to ends[slot + 1].
    """
    slots = 1 << max(SLOT_BITS, (2 * len(keys)).bit_length())
    flat = sorted((key & (slots - 1), key, license) for key, of in keys.items() for license in of)
    ends = np.searchsorted([f[0] for f in flat], np.arange(slots + 1)).tolist()
    ends, key_at, license_at = _constant(ends, "int"), _constant([f[1] for f in flat], "long"), _constant([f[2] for f in flat], "int")
    slot = lambda v: v.bitwiseAND(F.lit(slots - 1)).cast("int")

    def least(col: Column, v: Column, i: Column) -> Column:
        windows = F.lit(False)
        for first in range(1 - SPAN, 1):
            inside = F.lit(True)
            for k in range(first, first + SPAN):
                inside = inside & F.coalesce(F.get(col, i + k) >= v, F.lit(True)) if k else inside
            windows = windows | inside
        return windows

    def licenses(v: Column) -> Column:
        at = F.filter(F.sequence(F.get(ends, slot(v)), F.get(ends, slot(v) + 1) - 1), lambda i: F.get(key_at, i) == v)
        return F.transform(at, lambda i: F.get(license_at, i))

    def members(col: Column) -> Column:
        return F.filter(col, lambda v, i: (F.get(ends, slot(v) + 1) > F.get(ends, slot(v))) & least(col, v, i))

    # The shingles themselves come last, as they are for the short templates: each is a window of its own.
    bands = F.flatten(F.transform(F.array(*columns), members)) if columns else F.array().cast("array<long>")
    alone = F.filter("h", lambda v: F.get(ends, slot(v) + 1) > F.get(ends, slot(v)))
    return F.array_distinct(F.flatten(F.transform(F.concat(bands, alone), licenses)))


def scan(docs: DataFrame, templates: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id, license_id, containment (0.8 to 1), matched and n_shingles (of the template), first_word (where the
    document's first shingle of the template starts, from 0) for each document and template that it contains.

    Words are lower-cased runs of letters and digits. NULL and empty texts contain nothing, and texts of fewer than WORDS words only
    templates that are no longer; a template of fewer than WORDS words is one shingle, which must be there whole; one without
    words is never found; no templates, no rows. Repeated ids give one row for a template, that of
    their best containment; NULL ids count as one id. Other columns are ignored. Templates beyond PART_CHARS characters
    take further passes over the documents.
    """
    spark, templates = docs.sparkSession, TEMPLATES if templates is None else templates
    parts, room = [{}], PART_CHARS
    for name, text in sorted(templates.items()):
        if len(text) > room and parts[-1]:
            parts.append({})
            room = PART_CHARS
        parts[-1][name] = text
        room -= len(text)
    out = [f(docs, part, id_col, text_col) for part in parts if part for f in (_scan, _scan_short)]
    out = [x for x in out if x is not None]
    if not out:
        kind = docs.schema[id_col].dataType.simpleString()
        return spark.createDataFrame([], f"`{id_col}` {kind}, license_id string, containment double, matched int, n_shingles int, first_word int")
    return reduce(DataFrame.unionByName, out)


def _scan_short(docs: DataFrame, templates: dict[str, str], id_col: str, text_col: str) -> DataFrame | None:
    """scan() with those templates of one part that have fewer than WORDS words; None if there are none. Each is looked up among the
    document's runs of as many words."""
    spark = docs.sparkSession
    given = spark.createDataFrame(sorted(templates.items()), "license_id string, t string")
    words = {r["license_id"]: r["w"] for r in given.select("license_id", _words(F.col("t")).alias("w")).where(F.size("w") < WORDS).collect() if r["w"] != [""]}
    if not words:
        return None
    run = lambda n: F.transform("w", lambda x, i: F.xxhash64(x, *[F.get(F.col("w"), i + k) for k in range(1, n)]))
    runs = {f"h{n}": F.slice(run(n), 1, F.greatest(F.size("w") - (n - 1), F.lit(0))) for n in {len(w) for w in words.values()}}
    df = docs.select(F.col(id_col).alias("id"), _words(F.col(text_col)).alias("w")).withColumns(runs)
    places = F.array(*[F.struct(F.lit(name).alias("license_id"), F.array_position(f"h{len(w)}", F.xxhash64(*map(F.lit, w))).alias("at")) for name, w in sorted(words.items())])
    rows = df.select("id", F.inline(F.filter(places, lambda x: x["at"] > 0)))
    best = rows.groupBy("id", "license_id").agg((F.min("at") - 1).cast("int").alias("first_word"))
    return best.select(F.col("id").alias(id_col), "license_id", F.lit(1.0).alias("containment"), F.lit(1).alias("matched"), F.lit(1).alias("n_shingles"), "first_word")


def _scan(docs: DataFrame, templates: dict[str, str], id_col: str, text_col: str) -> DataFrame | None:
    """scan() with templates of one part; None if none of them has a shingle."""
    keys, bands, known = _template_keys(docs.sparkSession, templates)
    if not keys:
        return None
    df = _shingled(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")), "t", "w", "h").select("id", "h")
    names = [f"b{b}" for b in range(bands)]
    df = df.select("id", "h", *[_minima("h", b).alias(n) for b, n in enumerate(names)])
    # A filter on the arrays would be pushed below their projections, and they would be computed anew for each window.
    rows = df.select("id", "h", F.explode_outer(_found(names, keys)).alias("license")).where("license is not null")
    rows = rows.join(F.broadcast(known), "license")
    rows = rows.select("id", "license_id", "h", F.size("s").alias("n"), F.array_intersect("h", "s").alias("both")).withColumn("m", F.size("both")).where(F.col("m") >= F.ceil(F.col("n") * CONTAINED))
    first = F.array_position("h", F.get("both", 0)) - 1  # the intersection keeps the document's order
    rows = rows.select("id", "license_id", "n", "m", first.cast("int").alias("at"))
    best = rows.groupBy("id", "license_id").agg(F.max(F.struct("m", (-F.col("at")).alias("back"))).alias("best"), F.first("n").alias("n"))
    m = F.col("best.m")
    return best.select(F.col("id").alias(id_col), "license_id", F.round(m / F.col("n"), 6).alias("containment"), m.alias("matched"), F.col("n").alias("n_shingles"), (-F.col("best.back")).cast("int").alias("first_word"))
