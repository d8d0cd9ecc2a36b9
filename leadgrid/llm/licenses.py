"""License scan: an exact set-similarity join of text blocks with license templates.

A block is a run of consecutive words of a document, wherever lines end; a template is a notice or the body of a short
license. Blocks for a template of n words have n + n // 4 words, and both are compared as sets: a document matches if
one of its blocks holds at least `threshold` of the template's words. Words are ordered by how often they occur in
all documents, rarest first, and only words of templates count, as no other can be shared:

- prefix filter: a matching block holds one of the template's |T| - need + 1 rarest words, need = ceil(threshold * |T|);
- length filter: it has at least `need` words of templates;
- positional filter: from the first shared word on, both sides have enough words left to reach `need`.

What passes is verified by the size of the intersection. Of the runs of one length only those that begin with a word of
templates and hold one more than the run before them are compared: all others have their words, or fewer.

Phrases are found besides, word by word, over the whole text. Null and empty texts have no words. Repeated rows and null
ids are rows like any other, other columns are not read, and a very long text is one row's runs. A document without a
match has empty labels and score 0; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadgrid.llm.text import alnum_words, text_bytes
from leadgrid.sources.storage import stored

# Phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Notices as public license texts ask to give them, and labels for them.
TEMPLATES = [
    ("apache-notice", "Licensed under the Apache License, Version 2.0"),
    ("gpl-notice", "This work is licensed under the GNU General Public License, version 3"),
    ("mit-notice", "Released under the MIT License"),
    ("cc-by-nc-notice", "Licensed under CC BY-NC 4.0"),
    ("cc-by-notice", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("gpl-or-later", "either version 3 of the License, or (at your option) any later version"),
    ("mit-permission", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    ("bsd-redistribution", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("mpl-notice", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("no-warranty", "distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY"),
]
THRESHOLD = 0.8

# Bodies of short licenses, as published.
TEMPLATES += [
    (
        "mit-body",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation
        the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and
        to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above
        copyright notice and this permission notice shall be included in all copies or substantial portions of the
        Software.""",
    ),
    (
        "isc-body",
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
        granted, provided that the above copyright notice and this permission notice appear in all copies.""",
    ),
    (
        "bsd-body",
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that
        the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this
        list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above
        copyright notice, this list of conditions and the following disclaimer in the documentation and/or other
        materials provided with the distribution.""",
    ),
    (
        "gpl-header",
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General
        Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option)
        any later version.""",
    ),
    (
        "apache-header",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance
        with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0""",
    ),
    (
        "unlicense-body",
        """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify,
        publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for
        any purpose, commercial or non-commercial, and by any means.""",
    ),
]


def template_words(templates) -> list[tuple[str, list[bytes]]]:
    return [(label, sorted(set(alnum_words(text.encode())))) for label, text in templates]


def width_of(text: str) -> int:
    """Words of the blocks that a template is compared with."""
    n = len(alnum_words(text.encode()))
    return n + n // 4


def blocks_of(places: list[int], ranks: list[int], width: int, rare: frozenset[int], least: int) -> list[list[int]]:
    """The runs of `width` words as sorted word ranks, from the places of template words in a text.

    Runs begin with such a word, reach further than the run before, and hold `least` words and a rare one."""
    out, counts, end, rares = [], {}, 0, 0
    for a, place in enumerate(places):
        before = end
        while end < len(places) and places[end] < place + width:
            counts[ranks[end]] = counts.get(ranks[end], 0) + 1
            rares += ranks[end] in rare
            end += 1
        if end > before and rares and len(counts) >= least:
            out.append(sorted(counts))
        gone = ranks[a]
        rares -= gone in rare
        counts[gone] -= 1
        if not counts[gone]:
            del counts[gone]
    return out


def word_counts(docs: DataFrame, vocabulary: list[bytes], text_col: str = "text") -> dict[bytes, int]:
    """How often each of a bounded set of words occurs in all documents."""

    def run(batches):
        n = dict.fromkeys(vocabulary, 0)
        for batch in batches:
            for text in batch.column(0):
                for w in filter(n.__contains__, alnum_words(text.as_buffer().to_pybytes())):
                    n[w] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.binary()), pa.array(list(n.values()), pa.int64())], ["word", "n"])

    counts = docs.select(text_bytes(F.col(f"`{text_col}`"))).mapInArrow(run, "word binary, n bigint")
    found = {bytes(w): n for w, n in counts.groupBy("word").agg(F.sum("n")).toLocalIterator()}
    return {w: found.get(w, 0) for w in vocabulary}


_BLOCKS = "array<struct<block:bigint,width:int,words:array<int>>>"


def scan(
    docs: DataFrame, templates=TEMPLATES, phrases=PHRASES, threshold: float = THRESHOLD, id_col="doc_id", text_col="text"
) -> DataFrame:
    """One row per document: `doc_id`, `n_words`, `n_base`, `first_word`, `last_word` (places of phrases), `base_labels`,
    `labels`, `score` (the share of a template's words that the best matching block holds; 1 with a phrase)."""
    sets = template_words(templates)
    counts = word_counts(docs, sorted({w for _, words in sets for w in words}), text_col)
    order = {w: i for i, w in enumerate(sorted(counts, key=lambda w: (counts[w], w)))}
    widths = [width_of(text) for _, text in templates]
    ranked = [
        (label, sorted(order[w] for w in words), math.ceil(round(threshold * len(words), 9)), width)
        for (label, words), width in zip(sets, widths, strict=True)
        if words
    ]
    # of each width: the words that its templates' prefixes hold, and the least need
    kinds_of: dict[int, tuple[frozenset[int], int]] = {}
    for _, words, need, width in ranked:
        had, least = kinds_of.get(width, (frozenset(), need))
        kinds_of[width] = (had | set(words[: len(words) - need + 1]), min(least, need))
    prefix_words = frozenset().union(*(had for had, _ in kinds_of.values()))
    shown = sorted(phrases.items())
    patterns = [(re.compile(b"(?= " + p.encode() + b" )"), len(p.split()), label) for p, label in shown]

    def run(batches):
        rare = {w for w, r in order.items() if r in prefix_words}
        for batch in batches:
            n_words, n_base, first, last, labels, blocks = [], [], [], [], [], []
            for text in batch.column(1):
                data = text.as_buffer().to_pybytes()
                words = alnum_words(data)
                line = b" " + b" ".join(words) + b" "
                places, found = [], set()
                for pattern, _, label in patterns:
                    for m in pattern.finditer(line):
                        places.append(m.start())
                        found.add(label)
                if places:
                    blanks = np.flatnonzero(np.frombuffer(line, dtype=np.uint8) == 0x20)
                    first.append(int(np.searchsorted(blanks, min(places))))
                    last.append(int(np.searchsorted(blanks, max(places))))
                else:
                    first.append(None)
                    last.append(None)
                n_words.append(len(words))
                n_base.append(len(places))
                labels.append(sorted(found))
                own = []
                if not rare.isdisjoint(words):
                    at = [(i, order[w]) for i, w in enumerate(words) if w in order]
                    places, ranks = [i for i, _ in at], [r for _, r in at]
                    for width, (prefixes, least) in kinds_of.items():
                        for run_words in blocks_of(places, ranks, width, prefixes, least):
                            own.append({"block": len(own), "width": width, "words": run_words})
                blocks.append(own)
            kinds = pa.list_(pa.struct([("block", pa.int64()), ("width", pa.int32()), ("words", pa.list_(pa.int32()))]))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    *(pa.array(x, pa.int64()) for x in (n_words, n_base, first, last)),
                    pa.array(labels, pa.list_(pa.string())),
                    pa.array(blocks, kinds),
                ],
                ["doc_id", "n_words", "n_base", "first_word", "last_word", "found", "blocks"],
            )

    kind = "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, found array<string>, blocks " + _BLOCKS
    frame = docs.select(F.col(f"`{id_col}`").cast("bigint"), text_bytes(F.col(f"`{text_col}`"))).mapInArrow(run, kind)
    frame = stored(frame.withColumn("row", F.monotonically_increasing_id()), "license-blocks")
    matched = _join(frame, ranked)
    best = stored(
        matched.groupBy("row").agg(F.collect_set("label").alias("more"), F.max("share").alias("share")), "license-matches"
    )
    every = F.array_sort(F.array_union("found", F.coalesce("more", F.array().cast("array<string>"))))
    return frame.join(best, "row", "left").select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.concat_ws(",", "found").alias("base_labels"),
        F.concat_ws(",", every).alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"),
    )


def _join(frame: DataFrame, ranked) -> DataFrame:
    """(row, block, label, share) of the blocks that match a template; templates are a few rows of known size."""
    rows = [
        (r, width, label, words, need) for label, words, need, width in ranked for r in words[: len(words) - need + 1]
    ]
    spark = frame.sparkSession
    kind = "word int, width int, label string, template array<int>, need int"
    prefixes = F.broadcast(spark.createDataFrame(rows, kind))
    blocks = frame.select("row", F.inline("blocks"))
    shared: Column = F.size(F.array_intersect("words", "template"))
    return (
        blocks.select("row", "block", "width", "words", F.posexplode("words").alias("b_at", "word"))
        .join(prefixes, ["word", "width"])
        # the first word that a matching pair shares passes both; the prefix has seen to the template's side
        .filter((F.size("words") >= F.col("need")) & (F.size("words") - F.col("b_at") >= F.col("need")))
        # a block and a template that share several prefix words are verified once
        .groupBy("row", "block", "label")
        .agg(F.first("words").alias("words"), F.first("template").alias("template"), F.first("need").alias("need"))
        .filter(shared >= F.col("need"))
        .select("row", "block", "label", (shared / F.size("template")).alias("share"))
    )
