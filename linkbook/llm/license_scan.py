"""License scan by conditional compression.

Stretches of words around a cue are candidate blocks, whatever lines they stand in. Each is
compressed alone and with every template as a raw zstandard dictionary; templates are ranked by
how much of their own size that saves. Each that saves enough counts if its wording is really
there: the word differences must be few, and none may be in a word that sets licenses apart.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import cache
from itertools import accumulate

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Customary license notices.
TEMPLATES = {
    "AGPL-3.0": ["Licensed under the GNU Affero General Public License, version 3.", "This program is licensed under the GNU Affero General Public License v3.0."],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Released under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."],
    "BSD-2-Clause": ["Licensed under the BSD 2-Clause License.", "Released under the 2-Clause BSD License."],
    "BSD-3-Clause": ["Licensed under the BSD 3-Clause License.", "Released under the 3-Clause BSD License."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-NC-SA-4.0": ["Licensed under CC BY-NC-SA 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."],
    "CC-BY-ND-4.0": ["Licensed under CC BY-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."],
    "CC-BY-SA-3.0": ["Licensed under CC BY-SA 3.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 3.0 Unported License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC0-1.0": ["Released under CC0 1.0.", "This work is dedicated to the public domain under CC0 1.0 Universal."],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2.", "Licensed under the GNU General Public License v2.0."],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "Licensed under the GNU General Public License v3.0."],
    "LGPL-2.1": ["Licensed under the GNU Lesser General Public License, version 2.1."],
    "LGPL-3.0": ["Licensed under the GNU Lesser General Public License, version 3."],
    "MIT": ["Released under the MIT License.", "Licensed under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"],
    "MPL-2.0": ["Licensed under the Mozilla Public License, Version 2.0.", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
    "all-rights-reserved": ["All rights reserved."],
}
# Openings of full license texts. The BSD opening is the same for all its variants (see ``_named``).
OPENINGS = {
    "AGPL-3.0": ["GNU Affero General Public License Version 3, 19 November 2007"],
    "Apache-2.0": ["Apache License Version 2.0, January 2004"],
    "BSD": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
    "BSD-3-Clause": ["may be used to endorse or promote products derived from this software without specific prior written permission"],
    "CC-BY-4.0": ["Attribution 4.0 International Creative Commons Corporation", "Creative Commons Attribution 4.0 International Public License"],
    "CC-BY-NC-4.0": ["Attribution-NonCommercial 4.0 International Creative Commons Corporation", "Creative Commons Attribution-NonCommercial 4.0 International Public License"],
    "CC-BY-NC-SA-4.0": ["Attribution-NonCommercial-ShareAlike 4.0 International Creative Commons Corporation", "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International Public License"],
    "CC-BY-ND-4.0": ["Attribution-NoDerivatives 4.0 International Creative Commons Corporation", "Creative Commons Attribution-NoDerivatives 4.0 International Public License"],
    "CC-BY-SA-3.0": ["Creative Commons Legal Code Attribution-ShareAlike 3.0 Unported"],
    "CC-BY-SA-4.0": ["Attribution-ShareAlike 4.0 International Creative Commons Corporation", "Creative Commons Attribution-ShareAlike 4.0 International Public License"],
    "CC0-1.0": ["Creative Commons Legal Code CC0 1.0 Universal"],
    "GPL-2.0": ["GNU General Public License Version 2, June 1991"],
    "GPL-3.0": ["GNU General Public License Version 3, 29 June 2007"],
    "LGPL-2.1": ["GNU Lesser General Public License Version 2.1, February 1999"],
    "LGPL-3.0": ["GNU Lesser General Public License Version 3, 29 June 2007"],
    "MPL-2.0": ["Mozilla Public License Version 2.0 1. Definitions"],
}
CUES = ["licen[cs]", "copyright", "rights reserved", "public domain", "permission is hereby", r"\bcc0\b", r"\bcc[ -]by\b", "software released", "creative commons"]
# Half a block: so many words before and after a cue.
REACH = 40
# Share of a template's own compressed bytes that it has to save in a block.
MIN_SAVING = 0.1
MAX_DIFFERENT = 0.1  # share of the template's words that may be missing from, or added to, the block
CUT = "|"  # stands for wording taken out of a block
_SPELLED = re.compile(r"[^\W_](?:\S*[^\W_])?")


def spelled(text: str) -> list[str]:
    """Words in lower case from their first to their last letter or digit; others, like a comment's marks, are left out."""
    return _SPELLED.findall(text.lower())


_WORDINGS = [
    (name, spelled(t), " ".join(spelled(t)).encode())
    for kind in (TEMPLATES, OPENINGS) for name, wordings in kind.items() for t in wordings
]
_USED = [(name, set(spelled(t))) for name, wordings in TEMPLATES.items() for t in wordings]
# Words that the wording of any template can stretch over.
LONGEST = max(len(words) + int(MAX_DIFFERENT * len(words)) for _, words, _ in _WORDINGS)


def _cues() -> list[str]:
    """``CUES``, and what else finds every wording: with k words different, one of k + 1 pieces is unchanged."""
    known, more = re.compile("|".join(CUES)), []
    for _, words, _ in _WORDINGS:
        n = int(MAX_DIFFERENT * len(words)) + 1
        pieces = [" ".join(words[len(words) * i // n : len(words) * (i + 1) // n]) for i in range(n)]
        more += [re.escape(p).replace("\\ ", " ") for p in pieces if not known.search(p)]
    return CUES + sorted(set(more))


_CUE = re.compile("|".join(_cues()))
# The same in a text as it stands, with anything but letters and digits between words.
CUE_IN_TEXT = "(?i)" + "|".join(c.replace("[ -]", r"[^\p{L}\p{N}]+").replace(" ", r"[^\p{L}\p{N}]+") for c in _cues()).replace(r"\b", "")


@cache
def _sets_apart(word: str) -> bool:
    """Whether a word has a digit, or stands in the wordings of some licenses and not of others."""
    named = {name for name, words in _USED if word in words}
    return word == CUT or any(c.isdigit() for c in word) or 0 < len(named) <= len(TEMPLATES) // 2


def _named(found: set[str]) -> list[str]:
    """License names of a document. A BSD opening with the clause on endorsement is the 3-clause license, else the 2-clause one."""
    if "BSD" in found and "BSD-3-Clause" not in found:
        found = found | {"BSD-2-Clause"}
    return sorted(found - {"BSD"})


class Scanner:
    """Templates as dictionaries of compressors, made once per task."""

    def __init__(self) -> None:
        plain = {"level": 9, "write_content_size": False, "write_checksum": False, "write_dict_id": False}
        raw = zstandard.DICT_TYPE_RAWCONTENT
        self._alone = zstandard.ZstdCompressor(**plain).compress
        self._with = [
            (
                name, words, f" {text.decode()} ", len(self._alone(text)),
                zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(text, dict_type=raw), **plain).compress,
            )
            for name, words, text in _WORDINGS
        ]
        self._known: dict[tuple[str, ...], frozenset[str]] = {}

    def ranked(self, block: str) -> list[tuple[float, str, list[str]]]:
        """(saving, license, template's words), the largest saving first; what stands there word by word always counts."""
        data = block.encode("utf-8", "surrogatepass")
        alone, around = len(self._alone(data)), f" {block} "
        found = []
        for name, words, text, own, compress in self._with:
            saving = (alone - len(compress(data))) / own
            if saving >= MIN_SAVING or text in around:
                found.append((saving, name, words))
        return sorted(found, key=lambda f: (-f[0], f[1], f[2]))

    @staticmethod
    def confirmed(template: list[str], block: list[str]) -> tuple[int, int] | None:
        """The range of the block's words that is the template's wording, or None.

        The range with the fewest missing and added words; words that set licenses apart may be neither.
        """
        most = int(MAX_DIFFERENT * len(template))
        never = most + 1
        # Row i: (differences, start) of the best wording of the first i template words that ends at each place.
        row = [(0, j) for j in range(len(block) + 1)]
        for word in template:
            skip = never if _sets_apart(word) else 1
            below = [(min(row[0][0] + skip, never), row[0][1])]
            for j, other in enumerate(block):
                best = min((row[j + 1][0] + skip, row[j + 1][1]), (below[j][0] + (never if below[j][0] >= most or _sets_apart(other) else 1), below[j][1]))
                if word == other:
                    best = min(best, row[j])
                below.append(best if best[0] <= most else (never, j + 1))
            row = below
            if all(x[0] > most for x in row):
                return None
        n, start, end = min((n, -start, j) for j, (n, start) in enumerate(row))
        return (-start, end) if n <= most else None

    def blocks(self, text: str) -> Iterator[tuple[str, ...]]:
        """Stretches of a text's words, over line ends, that hold every wording with a cue."""
        words = spelled(text)
        ends = list(accumulate(len(w) + 1 for w in words))
        reach = -1
        for cue in _CUE.finditer(" ".join(words)):
            place = bisect_right(ends, cue.start())
            if place >= reach:  # otherwise the stretch before holds it and LONGEST words on both sides
                reach = place + REACH - LONGEST
                yield tuple(words[max(0, place - REACH) : place + REACH])

    def licenses(self, block: tuple[str, ...]) -> frozenset[str]:
        """All licenses whose wording a block holds; what is confirmed is taken out, and the rest is ranked again."""
        if block not in self._known:
            if len(self._known) >= 20_000:
                self._known.clear()
            found, words, before = set(), list(block), None
            while before != words:
                before = words
                for _, name, template in self.ranked(" ".join(before)):
                    if self.confirmed(template, before):
                        found.add(name)
                        while where := self.confirmed(template, words):
                            words = [*words[: where[0]], CUT, *words[where[1] :]]
            self._known[block] = frozenset(found)
        return self._known[block]


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    scanner = Scanner()
    for batch in batches:
        counts, names = [], []
        for text in batch.column("text"):
            blocks = list(scanner.blocks(text.as_py() or ""))
            counts.append(len(blocks))
            names.append(_named({name for b in blocks for name in scanner.licenses(b)}))
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array([len(n) for n in names], pa.int64()),
                pa.array([",".join(n) for n in names], pa.string()),
            ],
            ["doc_id", "n_blocks", "n_licenses", "licenses"],
        )


def scan(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_blocks (candidates), n_licenses, licenses (sorted, comma-joined).

    A block is a stretch of words around a cue, over line ends. Whole texts are searched. Null and
    empty texts have no blocks, and no licenses are the empty string. Rows that repeat give equal
    rows. An empty table gives no rows; further columns are not read.
    """
    text = F.col("text").cast("string")
    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.when(text.rlike(CUE_IN_TEXT), text).alias("text")).mapInArrow(
        _scan, f"doc_id {id_type}, n_blocks bigint, n_licenses bigint, licenses string"
    )


def query(spark: SparkSession, folder: str) -> DataFrame:
    """op10: the licenses of all documents."""
    return scan(spark.read.parquet(f"{folder}/documents.parquet"))
