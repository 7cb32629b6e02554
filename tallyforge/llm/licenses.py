"""License scans: exact set-similarity join of text blocks with license templates.

A template's and a block's words are sets, ordered by how many documents hold a word
(rarest first; counted over all documents, for the templates' words only). A block meets a
template if it holds at least THRESHOLD of the template's words. Only blocks that share a
word with a template's prefix can; the length filter and the positional filter discard
most of the rest, and what is left is verified by a full overlap count and by the template's
own phrases, word after word: version numbers and permissions, in which licenses with nearly
the same notice differ. Blocks are the lines of a text and its paragraphs (runs of lines
without an empty one). The templates are a fixed table, so the join's small side and its
prefix index are in every task.

The score is the greatest share of a template's words that a block which meets it holds; for
a text with a base phrase, also that which the text holds of a template with this phrase.

Defined results: null text is an empty text; a text without words has 0 words, no labels
and score 0; any length of text is scanned whole; repeated rows each get their row; an
empty table gives an empty result; other columns are ignored, under whatever names.
"""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm.common import map_batches, only, read_table, texts_of

#: Phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: The usual notices of common licenses, as (label, notice, phrases). A block meets a
#: notice only if all of its phrases, too, stand in the block, word after word: they tell apart
#: licenses whose notices share most words. Commas part phrases.
TEMPLATES = [
    ("apache-2.0", "Licensed under the Apache License, Version 2.0", "apache license version 2 0"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at", "apache license version 2 0"),
    ("mit-notice", "Released under the MIT License", "mit license"),
    ("mit-text", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions", "permission is hereby granted free of charge, deal in the software"),
    ("mit-text", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction", "permission is hereby granted free of charge, deal in the software"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies", "permission to use copy modify, with or without fee is hereby granted"),
    ("bsd-notice", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "redistribution and use in source and binary forms"),
    ("bsd-3-clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", "endorse or promote products derived from this software"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3", "gnu general public license, version 3"),
    ("gpl-2.0", "This work is licensed under the GNU General Public License, version 2", "gnu general public license, version 2"),
    ("gpl-notice", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", "free software, terms of the gnu general public license"),
    ("gpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version", "terms of the gnu general public license, version 3 of the license"),
    ("gpl-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version", "terms of the gnu general public license, version 2 of the license"),
    ("lgpl-notice", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", "terms of the gnu lesser general public license"),
    ("agpl-notice", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation", "terms of the gnu affero general public license"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at", "mozilla public license v 2 0"),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, for any purpose, commercial or non-commercial, and by any means", "free and unencumbered software released into the public domain"),
    ("cc-by-4.0", "Licensed under CC BY 4.0", "cc by 4 0"),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0", "cc by sa 4 0"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0", "cc by nc 4 0"),
    ("cc-by-nd-4.0", "Licensed under CC BY-ND 4.0", "cc by nd 4 0"),
    ("cc-by-nc-sa-4.0", "Licensed under CC BY-NC-SA 4.0", "cc by nc sa 4 0"),
    ("cc-by-nc-nd-4.0", "Licensed under CC BY-NC-ND 4.0", "cc by nc nd 4 0"),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License", "creative commons attribution 4 0"),
    ("cc-by-sa-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", "creative commons attribution sharealike 4 0"),
    ("cc-by-nc-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", "creative commons attribution noncommercial 4 0"),
    ("cc-by-nd-4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License", "creative commons attribution noderivatives 4 0"),
    ("cc0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work under CC0 1.0", "waived all copyright and related or neighboring rights"),
]
THRESHOLD = (4, 5)

#: Words of lower-cased UTF-8: digits, a-z and whatever is not ASCII.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_PHRASES = [(p.encode().split(b" "), label) for p, label in PHRASES.items()]
_SPACED = b" %s "
_LAST = {p[-1] for p, _ in _PHRASES}
_BLANK = re.compile(rb"\n[ \t\r\x0b\x0c]*(?=\n)")


def words_of(text: str) -> list[bytes]:
    return WORD.findall(text.encode("utf-8", "surrogatepass").lower())


def template_words() -> set[bytes]:
    return {w for _, t, _ in TEMPLATES for w in words_of(t)}


def document_frequencies(docs: DataFrame, text_col: str = "text") -> dict[bytes, int]:
    """In how many documents each template word stands, over all documents."""
    vocabulary = template_words()

    def run(batches):
        n: Counter = Counter()
        for batch in batches:
            for t in texts_of(batch, text_col):
                n.update(vocabulary.intersection(words_of(t)))
        yield pa.RecordBatch.from_arrays([pa.array([w.decode() for w in n], pa.string()), pa.array(list(n.values()), pa.int64())], ["word", "n"])

    counted = docs.select(text_col).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return dict.fromkeys(vocabulary, 0) | {r["word"].encode(): r["n"] for r in counted.collect()}  # a row per template word


class Matcher:
    """Templates in frequency order with an index of their prefixes."""

    def __init__(self, frequencies: dict[bytes, int], templates=TEMPLATES, threshold=THRESHOLD):
        num, den = threshold
        self.rank = {w: k for k, w in enumerate(sorted(frequencies, key=lambda w: (frequencies[w], w)))}
        self.index: dict[bytes, list[tuple[int, int]]] = {}
        self.templates = []
        for k, (label, text, phrases) in enumerate(templates):
            t = sorted({*words_of(text)}, key=self.rank.__getitem__)
            need = -(-len(t) * num // den)
            self.templates.append((label, t, frozenset(t), need, [_SPACED % b" ".join(words_of(p)) for p in phrases.split(",")]))
            for at, w in enumerate(t[: len(t) - need + 1]):
                self.index.setdefault(w, []).append((k, at))
        self.keys = frozenset(self.index)
        #: for each base phrase, the templates that hold it
        self.of_phrase = {label: [t[2] for t, own in zip(self.templates, templates, strict=True) if _SPACED % b" ".join(p) in _SPACED % b" ".join(words_of(own[1]))] for p, label in _PHRASES}

    def block(self, block: list[bytes]) -> list[tuple[int, int]]:
        """(template, overlap) of every template that the block's words meet."""
        b = sorted(self.rank.keys() & block, key=self.rank.__getitem__)
        tried, found, flat = set(), [], None
        for j, w in enumerate(b):
            for k, i in self.index.get(w, ()):
                if k in tried:
                    continue
                _, t, whole, need, phrases = self.templates[k]
                if len(b) < need or j > len(b) - need:  # length; the block's own prefix
                    continue
                tried.add(k)
                if 1 + min(len(t) - i - 1, len(b) - j - 1) < need:  # position of the first shared word
                    continue
                if (overlap := len(whole.intersection(b))) >= need:
                    flat = _SPACED % b" ".join(block) if flat is None else flat
                    if all(p in flat for p in phrases):
                        found.append((k, overlap))
        return found

    def share(self, labels: set[str], words: list[bytes]) -> float:
        """The greatest share of a template's words in a text that has these base labels."""
        every = {*words} if labels else set()
        return max((len(t & every) / len(t) for label in labels for t in self.of_phrase[label]), default=0.0)

    def scan(self, text: str, words: list[bytes]) -> tuple[set[str], float, list[tuple[str, int, int]]]:
        """Labels, best containment, and (label, start, end) of blocks in bytes of the text."""
        labels, best, spans = set(), 0.0, []
        if self.keys.isdisjoint(words):
            return labels, best, spans
        low = text.encode("utf-8", "surrogatepass").lower()
        at = 0
        for part in _BLANK.split(low):
            lines = part.split(b"\n")
            blocks, pos = [], at
            for line in lines:
                blocks.append((pos, line))
                pos += len(line) + 1
            if len(lines) > 1:
                blocks.append((at, part))
            for start, block in blocks:
                w = WORD.findall(block)
                if self.keys.isdisjoint(w):
                    continue
                for k, overlap in self.block(w):
                    label, t = self.templates[k][:2]
                    labels.add(label)
                    best = max(best, overlap / len(t))
                    spans.append((label, start, start + len(block)))
            at += len(part)
            m = _BLANK.match(low, at)
            at = m.end() if m else at
        return labels, best, spans


def phrase_places(words: list[bytes]) -> list[tuple[int, str]]:
    """(first word, label) of every place of a phrase, in order."""
    if _LAST.isdisjoint(words):
        return []
    found = []
    for phrase, label in _PHRASES:
        at, last = -1, len(words) - len(phrase)
        while True:
            try:
                at = words.index(phrase[0], at + 1)
            except ValueError:
                break
            if at <= last and words[at : at + len(phrase)] == phrase:
                found.append((at, label))
    return sorted(found)


SCHEMA = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label: string, start: long, end: long>>"


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", frequencies: dict[bytes, int] | None = None) -> DataFrame:
    """One row per document; spans are byte ranges of the blocks that met a template."""
    frequencies = document_frequencies(docs, text_col) if frequencies is None else frequencies
    id_type = docs.schema[id_col].dataType.simpleString()

    def make():
        matcher = Matcher(frequencies)

        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            cols: list[list] = [[] for _ in range(8)]
            for text in texts_of(batch, text_col):
                words = words_of(text)
                places = phrase_places(words)
                base = {label for _, label in places}
                more, best, spans = matcher.scan(text, words)
                row = (len(words), len(places), places[0][0] if places else None, places[-1][0] if places else None, ",".join(sorted(base)), ",".join(sorted(base | more)), max(best, matcher.share(base, words)), [dict(zip(("label", "start", "end"), s, strict=True)) for s in spans])
                for c, v in zip(cols, row, strict=True):
                    c.append(v)
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))]
            names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
            return pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(id_col)), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], [id_col, *names])

        return f

    return map_batches(docs.select(id_col, text_col), make, f"`{id_col}` {id_type}, {SCHEMA}")


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = only(read_table(spark, sf_dir, "documents"), doc_id="doc_id", text="text")
    return scan(docs).drop("spans")
