"""License scans: MinHash bands over overlapping windows, then exact containment. DataFrame functions only."""

from __future__ import annotations

import re
from collections import Counter
from functools import reduce
from operator import or_

import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.llm.common import documents

SHINGLE, LEAST, BANDS = 5, 0.8, 16
# Notices and grants of widely used public licenses.
TEMPLATES = {
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-notice": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at',
    "apache-2.0-disclaimer": 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    "bsd-redistribution": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "cc-by-4.0-line": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "gpl-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "gpl-warranty": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "mit-grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction',
    "mit-line": "Released under the MIT License.",
    "mpl-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}
_VERSIONS = ("1.0", "2.0", "2.5", "3.0", "4.0")
_CREATIVE = {
    "by": ("Attribution",), "by-sa": ("Attribution-ShareAlike", "Attribution-Share Alike"), "by-nc": ("Attribution-NonCommercial", "Attribution-Non-Commercial"), "by-nd": ("Attribution-NoDerivatives", "Attribution-NoDerivs"),
    "by-nc-sa": ("Attribution-NonCommercial-ShareAlike", "Attribution-Noncommercial-Share Alike"), "by-nc-nd": ("Attribution-NonCommercial-NoDerivatives", "Attribution-NonCommercial-NoDerivs"),
}
# Names with their version, in any sentence. At most eight words, so that four fifths of the shingles are all of them
# and no other version matches.
for _kind, _name, _vs in (("gpl", "General", ("1", "2", "3")), ("lgpl", "Lesser General", ("2.1", "3")), ("lgpl-library", "Library General", ("2",)), ("agpl", "Affero General", ("3",))):
    for _v in _vs:
        TEMPLATES |= {f"{_kind}-{_v}-version": f"GNU {_name} Public License, version {_v}", f"{_kind}-{_v}-v": f"GNU {_name} Public License v{_v}"}
        TEMPLATES |= {f"{_kind}-{_v}-bare": f"GNU {_name} Public License {_v}"}
        if _kind != "lgpl-library":
            TEMPLATES |= {f"{_kind}-{_v}-spdx": f"SPDX-License-Identifier: {_kind}-{_v if '.' in _v else _v + '.0'}", f"{_kind}-{_v}-under": f"Licensed under the {_kind} v{_v}", f"{_kind}-{_v}-under-gnu": f"under the GNU {_kind} v{_v}"}
for _kind, _names in _CREATIVE.items():
    for _v in _VERSIONS:
        TEMPLATES |= {f"cc-{_kind}-{_v}-name{_i or ''}": f"Creative Commons {_name} {_v}" for _i, _name in enumerate(_names)}
        if _kind != "by":
            TEMPLATES |= {f"cc-{_kind}-{_v}-short": f"CC {_kind} {_v}"}
TEMPLATES |= {
    "agpl-notice": "under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
    "apache-2.0-spdx": "SPDX-License-Identifier: Apache-2.0",
    "apache-2.0-bare": "under the Apache License 2.0",
    "apache-2.0-released": "Released under the Apache License, Version 2.0",
    "boost-1.0": "Boost Software License, Version 1.0",
    "boost-1.0-spdx": "SPDX-License-Identifier: BSL-1.0",
    "bsd-disclaimer": 'This software is provided by the copyright holders and contributors "as is" and any express or implied warranties, including, but not limited to, the implied warranties of merchantability and fitness for a particular purpose are disclaimed.',
    "bsd-endorsement": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "bsd-licensed": "Licensed under the BSD License",
    "bsd-released": "Released under the BSD License",
    "bsd-style": "governed by a BSD-style license",
    "cc0-dedication": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work",
    "epl-2.0": "Eclipse Public License v 2.0",
    "epl-2.0-bare": "Eclipse Public License 2.0",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "isc-licensed": "Licensed under the ISC License",
    "isc-released": "Released under the ISC License",
    "lgpl-notice": "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    "mit-licensed": "Licensed under the MIT License",
    "mit-distributed": "Distributed under the MIT License",
    "mit-warranty": 'The software is provided "as is", without warranty of any kind, express or implied, including but not limited to the warranties of merchantability',
    "unlicense": "This is free and unencumbered software released into the public domain",
} | {f"mpl-{v}-{k}": f"{t} {v}" for v in ("1.1", "2.0") for k, t in (("version", "Mozilla Public License, Version"), ("bare", "Mozilla Public License"), ("spdx", "SPDX-License-Identifier: MPL"))}
# Forms of fewer words than a shingle has, found as whole runs of words.
SHORT = {f"cc-by-{v}-short": f"CC BY {v}" for v in _VERSIONS} | {"bsd-2-clause": "BSD 2-Clause", "bsd-3-clause": "BSD 3-Clause", "cc0-1.0": "CC0 1.0", "isc-spdx": "SPDX-License-Identifier: ISC", "mit-spdx": "SPDX-License-Identifier: MIT", "unlicense-spdx": "SPDX-License-Identifier: Unlicense"}
# Words that many texts have, the last choice of anchors().
_COMMON = frozenset("and any by for is of or the this to under with".split())
_SALTS = [xxhash.xxh64_intdigest(b"band", i) - (1 << 63) for i in range(BANDS)]


def plain(text: str) -> list[str]:
    return [w for w in re.split("[^a-z0-9]+", text.lower()) if w]


def shingle_hashes(words: list[str]) -> list[int]:
    """Signed XXH64 of each shingle, as the engine's xxhash64 gives it."""
    h = (xxhash.xxh64_intdigest(" ".join(words[i : i + SHINGLE]), 42) for i in range(len(words) - SHINGLE + 1))
    return [x - (1 << 64) if x >> 63 else x for x in h]


def window(n_words: int) -> tuple[int, int]:
    """(stride, shingles in a window) for a template of n_words: strides of an eighth, windows one stride longer, so
    that an occurrence without inserted words lies whole in some window."""
    stride = max(1, n_words // 8)
    return stride, n_words - SHINGLE + stride


def anchors(templates: dict[str, str], least: float = LEAST) -> list[str]:
    """Words so that a text without any of them can't contain least of any template's shingles. Lossless: they
    cover more than 1 - least of each template's shingles. Longer and more widely shared words come first."""
    rest = {k: [set(w[i : i + SHINGLE]) for i in range(max(1, len(w) - SHINGLE + 1))] for k, w in ((k, plain(v)) for k, v in templates.items())}
    size, out = {k: len(v) for k, v in rest.items()}, []
    while open_ := {k: v for k, v in rest.items() if len(v) >= least * size[k]}:
        n = Counter(w for v in open_.values() for s in v for w in s)
        out.append(max(n, key=lambda w: (w not in _COMMON, min(len(w), 9), n[w], w)))
        rest = {k: [s for s in v if out[-1] not in s] for k, v in rest.items()}
    return out


def _has(anchor: str) -> Column:
    """Whether column t holds the anchor, as a whole word if it is short."""
    has = F.contains("t", F.lit(anchor))
    return has if len(anchor) > 3 else has & F.col("t").rlike(f"(?<![a-z0-9]){anchor}(?![a-z0-9])")


def _signature(hashes: Column, salt: Column) -> Column:
    return F.array_min(F.transform(hashes, lambda h: h.bitwiseXOR(salt)))


def _table(templates: dict[str, str]) -> Column:
    """The templates as one array: name, stride, window, wide window, distinct shingles and their band minima."""
    rows = []
    for name, text in sorted(templates.items()):
        words = plain(text)
        own = sorted(set(shingle_hashes(words)))
        if not own:
            raise ValueError(f"template {name} has fewer than {SHINGLE} words")
        stride, size = window(len(words))
        longs = lambda xs: f"array({', '.join(f'{x}L' if x > -(1 << 63) else f'(-{(1 << 63) - 1}L - 1L)' for x in xs)})"
        rows.append(f"named_struct('name', {name!r}, 'stride', {stride}, 'size', {size}, 'wide', {2 * (len(words) - SHINGLE + 1)}, 'own', {longs(own)}, 'least', {longs(min(o ^ x for o in own) for x in _SALTS)})")
    return F.expr(f"array({', '.join(rows)})")


def _starts(hits: Column, stride: Column, size: Column) -> Column:
    """The grid's window starts whose window holds a hit."""
    first = lambda i: F.greatest(F.ceil((i - size + 1) / stride), F.lit(0)).cast("int")
    return F.array_distinct(F.flatten(F.transform(hits, lambda x: F.transform(F.sequence(first(x["i"]), F.floor(x["i"] / stride).cast("int")), lambda k: k * stride))))


def _within(hits: Column, start: Column, size: Column) -> Column:
    return F.transform(F.filter(hits, lambda x: (x["i"] >= start) & (x["i"] < start + size)), lambda x: x["h"])


def _first_best(hits: Column, starts: Column, size: Column, n_own: Column, least: float) -> Column:
    share = F.transform(starts, lambda s: F.struct((F.size(F.array_distinct(_within(hits, s, size))) / n_own).alias("containment"), (-s).alias("back")))
    return F.array_max(F.filter(share, lambda x: x["containment"] >= F.lit(least)))


def _best(t: Column, hits: Column, least: float) -> Column:
    """The best window of template t; null if none reaches least. Bands retrieve regions of twice the template and a
    stride; in those, containment is exact over the windows of the grid, and where none of them reaches least, over
    windows of twice the template from each of its shingles on, so that inserted words lose nothing.

    A region that holds an occurrence has Jaccard similarity 0.8 at least with the template, apart from shingles of
    other templates; sixteen bands of one row then meet but for chances of 0.2**16."""
    own = F.filter(hits, lambda x: F.array_contains(t["own"], x["h"]))
    region = t["wide"] + t["stride"] - 1
    meets = lambda s: F.exists(F.arrays_zip(t["least"].alias("m"), F.array(*map(F.lit, _SALTS)).alias("salt")), lambda b: _signature(_within(hits, s, region), b["salt"]) == b["m"])
    met = F.filter(_starts(own, t["stride"], region), meets)
    near = F.filter(own, lambda x: F.exists(met, lambda s: (x["i"] >= s) & (x["i"] < s + region)))
    n_own = F.size(t["own"])
    narrow = _first_best(near, _starts(near, t["stride"], t["size"]), t["size"], n_own, least)
    return F.coalesce(narrow, _first_best(near, F.transform(near, lambda x: x["i"]), t["wide"], n_own, least))


def scan(docs: DataFrame, templates: dict[str, str] | None = None, least: float = LEAST) -> DataFrame:
    """(doc_id, license, start_word, containment) of each template found in a row of docs: its best window, the first
    of equals; containment is the share of the template's distinct shingles in the window, least or more.

    Texts are compared as lower-case runs of letters a-z and digits. Null, empty and short texts match nothing.
    Repeated rows each give their matches. Everything happens within the row, without a shuffle, over whole texts;
    a text costs in proportion to its length. Templates are a parameter of a few kilobytes.
    """
    short = SHORT if templates is None else {}
    templates = TEMPLATES if templates is None else templates
    low = F.lower(F.col("text").cast("string"))
    rows = docs.select("doc_id", low.alias("t")).where(reduce(or_, map(_has, anchors(templates | short, least))))
    rows = rows.select("doc_id", F.filter(F.split("t", "[^a-z0-9]+"), lambda w: w != "").alias("w"))
    at = F.when(F.size("w") >= SHINGLE, F.sequence(F.lit(1), F.size("w") - (SHINGLE - 1))).otherwise(F.array().cast("array<int>"))
    every = sorted({h for text in templates.values() for h in shingle_hashes(plain(text))})
    hits = F.filter(F.transform(at, lambda i: F.struct((i - 1).alias("i"), F.xxhash64(F.array_join(F.slice("w", i, SHINGLE), " ")).alias("h"))), lambda x: x["h"].isin(every))
    run = F.concat(F.lit(" "), F.array_join("w", " "), F.lit(" "))
    rows = rows.select("doc_id", hits.alias("hits"), run.alias("run") if short else F.lit("").alias("run"))
    known = F.filter(_table(templates), lambda t: F.exists("hits", lambda x: F.array_contains(t["own"], x["h"])))
    found = F.transform(known, lambda t: F.struct(t["name"].alias("license"), _best(t, F.col("hits"), least).alias("best")))
    if short:
        forms = F.array(*(F.struct(F.lit(k).alias("name"), F.lit(f" {' '.join(plain(v))} ").alias("form")) for k, v in sorted(short.items())))
        before = lambda s: F.substring("run", F.lit(1), F.call_function("instr", F.col("run"), s["form"]))
        start = lambda s: F.char_length(before(s)) - F.char_length(F.replace(before(s), F.lit(" "), F.lit(""))) - 1
        some = F.filter(forms, lambda s: F.contains(F.col("run"), s["form"]))
        found = F.concat(found, F.transform(some, lambda s: F.struct(s["name"].alias("license"), F.struct(F.lit(1.0).alias("containment"), (-start(s)).alias("back")).alias("best"))))
    rows = rows.select("doc_id", F.explode(F.filter(found, lambda x: x["best"].isNotNull())).alias("x"))
    return rows.select("doc_id", "x.license", (-F.col("x.best.back")).cast("long").alias("start_word"), F.col("x.best.containment").alias("containment"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(documents(spark, sf_dir))


def _sql() -> str:
    """The same windows by exact containment alone, without bands or anchors."""
    rows = []
    for name, text in sorted(TEMPLATES.items()):
        w = plain(text)
        stride, size = window(len(w))
        own = sorted({" ".join(w[i : i + SHINGLE]) for i in range(len(w) - SHINGLE + 1)})
        rows.append(f"('{name}', {stride}, {size}, [{', '.join(repr(s) for s in own)}])")
    return f"""
WITH t(license, stride, size, own) AS (VALUES {', '.join(rows)}),
w AS (SELECT doc_id, row_number() OVER () AS r, list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda x: x <> '') AS w FROM documents),
h AS (SELECT doc_id, r, list_transform(generate_series(1, len(w) - {SHINGLE - 1}), lambda i: array_to_string(w[i:i + {SHINGLE - 1}], ' ')) AS h FROM w WHERE len(w) >= {SHINGLE}),
c AS (SELECT doc_id, r, h, license, stride, size, own FROM h JOIN t ON list_has_any(h, own)),
p AS (SELECT doc_id, r, license, s - 1 AS start_word, len(list_intersect(list_distinct(h[s:s + size - 1]), own)) / len(own)::DOUBLE AS containment
  FROM (SELECT *, unnest(generate_series(1, len(h), stride)) AS s FROM c)),
b AS (SELECT *, row_number() OVER (PARTITION BY r, license ORDER BY containment DESC, start_word) AS k FROM p WHERE containment >= {LEAST})
SELECT doc_id, license, start_word, containment FROM b WHERE k = 1
"""


SQL = _sql()
