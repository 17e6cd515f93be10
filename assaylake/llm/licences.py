"""License scans: a trained classifier of paragraphs names licence families, and templates confirm it."""

from __future__ import annotations

import re
import zlib

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Ftrl, by_text, fit_temperature, read

#: Orders of the word n-grams, log2 of the buckets of n-grams that no template has, documents that give the unknown class a
#: paragraph at most, copies with noise of each statement, passes, and the share of a template's rarest words that a paragraph is
#: looked up by.
ORDERS, BITS, UNKNOWN_ROWS, COPIES, EPOCHS, RAREST = (1, 2, 3), 12, 3000, 4, 2, 0.5
#: Least calibrated probability, and least share of a template's n-grams that the paragraph must hold.
LEAST_P, LEAST_MATCH = 0.5, 0.6
UNKNOWN = "unknown"
WORD = re.compile(r"[a-z0-9]+(?:[.+-][a-z0-9]+)*")
SENTENCE = re.compile(r"(?<=[.!?;])\s+")

# fixed values: names of licence families in texts, and whole statements of some
NAMES = {
    "apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache-2.0", "Apache 2.0 License"],
    "mit": ["MIT License", "MIT Licence", "X11 License", "Expat License"],
    "bsd": ["BSD License", "BSD 3-Clause License", "BSD-3-Clause", "BSD 2-Clause License", "BSD-2-Clause", "New BSD License", "Simplified BSD License", "0BSD"],
    "isc": ["ISC License", "Internet Software Consortium License", "license ISC"],
    "gpl": ["GNU General Public License", "GNU GPL", "GPLv2", "GPLv3", "GPL-2.0-only", "GPL-3.0-or-later", "GPL-3.0", "GPL license"],
    "lgpl": ["GNU Lesser General Public License", "GNU Library General Public License", "GNU LGPL", "LGPLv3", "LGPL-3.0-only", "LGPL-2.1-or-later", "LGPL license"],
    "agpl": ["GNU Affero General Public License", "GNU AGPL", "AGPLv3", "AGPL-3.0-only", "AGPL license"],
    "gfdl": ["GNU Free Documentation License", "GFDL", "GFDL-1.3-or-later"],
    "mpl-2.0": ["Mozilla Public License", "Mozilla Public License, version 2.0", "MPL-2.0", "MPL 2.0"],
    "epl": ["Eclipse Public License", "Eclipse Public License 2.0", "EPL-2.0", "EPL 1.0"],
    "cddl": ["Common Development and Distribution License", "CDDL-1.0", "CDDL license"],
    "eupl": ["European Union Public Licence", "EUPL-1.2", "EUPL v1.2"],
    "ms-pl": ["Microsoft Public License", "MS-PL"],
    "artistic": ["Artistic License", "Artistic License 2.0", "Artistic-2.0"],
    "boost": ["Boost Software License", "Boost Software License, Version 1.0", "BSL-1.0"],
    "zlib": ["zlib License", "zlib/libpng License", "zlib-acknowledgement"],
    "postgresql": ["PostgreSQL License", "PostgreSQL Licence"],
    "python": ["Python Software Foundation License", "PSF License", "Python-2.0", "PSF-2.0"],
    "ofl": ["SIL Open Font License", "SIL Open Font License, Version 1.1", "OFL-1.1"],
    "wtfpl": ["Do What The F*ck You Want To Public License", "WTFPL"],
    "unlicense": ["The Unlicense", "Unlicense license"],
    "odbl": ["Open Database License", "ODbL-1.0"],
    "cc0": ["Creative Commons Zero", "CC0 1.0 Universal", "CC0-1.0", "CC0 license"],
    "cc-by": ["CC BY 4.0", "CC-BY-4.0", "Creative Commons Attribution 4.0 International License", "Creative Commons Attribution License"],
    "cc-by-sa": ["CC BY-SA 4.0", "CC-BY-SA-4.0", "Creative Commons Attribution-ShareAlike 4.0 International License", "Creative Commons Attribution-ShareAlike License"],
    "cc-by-nc": ["CC BY-NC 4.0", "CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial 4.0 International License", "Creative Commons Attribution-NonCommercial License"],
    "cc-by-nd": ["CC BY-ND 4.0", "CC-BY-ND-4.0", "Creative Commons Attribution-NoDerivatives 4.0 International License"],
}
STATEMENTS = {
    "apache-2.0": ["You may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."],
    "mit": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ],
    "isc": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "gpl": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/",
    ],
    "lgpl": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."],
    "agpl": ["You can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation"],
    "mpl-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."],
    "epl": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"],
    "boost": ["Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software"],
    "zlib": ["This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."],
    "unlicense": ["This is free and unencumbered software released into the public domain."],
    "public-domain": ["Released into the public domain.", "This work is in the public domain.", "Dedicated to the public domain"],
    "all-rights-reserved": ["All rights reserved.", "Copyright. All rights reserved.", "No part of this work may be reproduced without permission.", "No part of this publication may be reproduced, distributed or transmitted in any form without the prior written permission of the publisher."],
}
FORMS = ("{}", "Licensed under the {}.", "Licensed under {}.", "Released under the {}.", "This work is licensed under the {}.", "This work is licensed under a {}.", "SPDX-License-Identifier: {}", "Distributed under the terms of the {}, see the file COPYING.", "The code is under {}", "See {} for the terms.", "license = {}")
FAMILIES = sorted({*NAMES, *STATEMENTS})


def words(paragraph: str) -> list[str]:
    return WORD.findall(paragraph.lower())


def grams(ws: list[str]) -> set[str]:
    return {" ".join(ws[i : i + k]) for k in ORDERS for i in range(len(ws) - k + 1)}


def templates() -> list[tuple[str, frozenset[str]]]:
    """(family, n-grams) of each name and statement."""
    return [(f, frozenset(grams(words(t)))) for f in FAMILIES for t in [*NAMES.get(f, ()), *STATEMENTS.get(f, ())]]


def examples() -> list[tuple[str, str]]:
    """(family, text): the statements, and each name in each form."""
    return [(f, x) for f in FAMILIES for x in [*STATEMENTS.get(f, ()), *(form.format(n) for n in NAMES.get(f, ()) for form in FORMS)]]


def paragraphs(text: str) -> list[list[str]]:
    """The lines of each paragraph: a line goes on in the next unless it ends a sentence or either is blank."""
    out: list[list[str]] = []
    open_ = False
    for line in text.split("\n"):
        bare = line.rstrip()
        if not bare or bare.isspace():
            open_ = False
            continue
        if open_:
            out[-1].append(line)
        else:
            out.append([line])
        open_ = bare[-1] not in ".!?:"
    return out


class Model:
    """Families, weights of the n-grams (those of templates by place, others by bucket; the bias last), temperature, the templates,
    and the words that paragraphs are looked up by."""

    def __init__(self, index: dict[str, int], weights: np.ndarray, temperature: float, anchors: list[str]):
        self.families, self.index, self.weights, self.temperature, self.anchors = [UNKNOWN, *FAMILIES], index, weights, temperature, anchors
        self.templates: dict[str, list[frozenset[str]]] = {}
        for f, t in templates():
            self.templates.setdefault(f, []).append(t)
        self._automaton = None

    def __getstate__(self):
        return {**self.__dict__, "_automaton": None}

    def spotted(self, low: str) -> bool:
        """Whether a text in lower case has one of the words that every licence statement has some of."""
        if self._automaton is None:
            self._automaton = ahocorasick.Automaton()
            for w in self.anchors:
                self._automaton.add_word(w, 1)
            self._automaton.make_automaton()
        return next(self._automaton.iter(low), None) is not None

    def features(self, ws: list[str]) -> np.ndarray:
        n = len(self.index)
        return np.array(sorted({n + (zlib.crc32(g.encode()) >> 32 - BITS) if (i := self.index.get(g)) is None else i for g in grams(ws)}), np.int64)

    def row(self, ws: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The features and their values: one for each n-gram of a template; the others have unit length together."""
        at = self.features(ws)
        own = at < len(self.index)
        return at, np.where(own, 1.0, max(1, len(at) - int(own.sum())) ** -0.5)

    def probabilities(self, ws: list[str]) -> np.ndarray:
        """The calibrated probability of each class, unknown first."""
        at, x = self.row(ws)
        z = (x @ self.weights[at] + self.weights[-1]) / self.temperature
        p = np.exp(z - z.max())
        return p / p.sum()

    def predict(self, paragraph: str) -> tuple[str, float, float]:
        """The family, its calibrated probability, and the largest share of one of its templates that the paragraph holds;
        'unknown' if the probability or that share is too low."""
        ws = words(paragraph)
        if not ws:
            return UNKNOWN, 1.0, 0.0
        p = self.probabilities(ws)
        best = int(p.argmax())
        if best == 0 or p[best] < LEAST_P:
            return UNKNOWN, float(p[0]), 0.0
        own = grams(ws)
        share = max(len(t & own) / len(t) for t in self.templates[self.families[best]])
        return (self.families[best], float(p[best]), share) if share >= LEAST_MATCH else (UNKNOWN, float(p[0]), share)

    def statements(self, lines: list[str], remembered: dict | None = None) -> list[tuple[str, float, float]]:
        """(family, probability, match) of each family that a paragraph names: by the whole of it, by a line, or by a sentence."""
        whole = " ".join(x.strip() for x in lines)
        if not self.spotted(whole.lower()):
            return []
        found: dict[str, tuple[float, float]] = {}
        for part in dict.fromkeys([whole, *lines, *SENTENCE.split(whole)]):
            if not self.spotted(part.lower()):
                continue
            got = remembered.get(part) if remembered is not None else None
            if got is None:
                got = self.predict(part)
                if remembered is not None and len(part) <= 400:
                    remembered[part] = got
            if got[0] != UNKNOWN:
                found[got[0]] = max(found.get(got[0], (0.0, 0.0)), got[1:])
        return [(f, *found[f]) for f in sorted(found)]


def drawn_paragraphs(docs: DataFrame, text: str, key: str, most: int) -> list[str]:
    """A line of each of at most `most` documents: those of the smallest hashes of key and text, and of each the line that the hash
    names. So the draw is the same however the rows lie in files. Hashes that can't be among the smallest, by twice the share
    that is wanted, don't leave their task."""
    h = F.xxhash64(F.lit("licences"), key, text)
    share = min(1.0, 2 * most / max(1, docs.count()))
    below = int((1 << 64) * share) - (1 << 63) - 1
    lines = F.split(F.col(f"`{text}`"), "\n")
    line = F.element_at(lines, (F.pmod(F.shiftright(h, 8), F.size(lines)) + 1).cast("int"))
    rows = docs.where(F.col(f"`{text}`").isNotNull()).select(h.alias("h"), line.alias("p")).where(F.col("h") <= F.lit(below)).orderBy("h", "p").limit(most)
    return [r["p"] for r in rows.collect()]


def train(docs: DataFrame | None = None, text: str = "text", key: str = "doc_id", unknown_rows: int = UNKNOWN_ROWS) -> Model:
    """Learns families from names in forms and from statements, each with COPIES that words are dropped from and other words
    put before and after, and the unknown class from whole lines of at most unknown_rows documents (the smallest of a
    hash of key and text) that hold less than half of any template, and from words of templates out of their order. A fifth of the
    rows sets the temperature."""
    known = templates()
    plain = [ws for p in (drawn_paragraphs(docs, text, key, unknown_rows) if docs is not None else []) if (ws := words(p))]
    plain = [ws for ws in plain if (g := grams(ws)) and all(len(t & g) * 2 < len(t) for _, t in known)]
    often: dict[str, int] = {}
    for ws in plain:
        for w in set(ws):
            often[w] = often.get(w, 0) + 1
    # a paragraph that holds LEAST_MATCH of a template's n-grams has some of any half of its words
    anchors: set[str] = set()
    for _, t in known:
        own = sorted({w for g in t for w in g.split(" ")}, key=lambda w: (often.get(w, 0), -len(w), w))
        anchors.update(own[: max(1, int(np.ceil(len(own) * RAREST)))])
    rng = np.random.default_rng(11)
    rows: list[tuple[list[str], int]] = [(ws, 0) for ws in plain] + [(["text"], 0)]
    common = [w for ws in plain[:200] for w in ws[:20]] or ["text"]
    single = {w for n in NAMES.values() for x in n for w in words(x)}
    stray = sorted({w for _, x in examples() for w in words(x)} - single)
    for f, example in examples():
        ws = words(example)
        for copy in range(COPIES):
            own = [w for w in ws if copy < 2 or len(ws) < 4 or rng.random() > 0.08]
            before, after = (list(rng.choice(common if copy % 2 else stray, rng.integers(0, 7))) if copy else [] for _ in "ab")
            rows.append((before + own + after, FAMILIES.index(f) + 1))
    for _ in range(len(rows) // 3):  # words of templates out of their order are no licence
        rows.append((list(rng.choice(stray, rng.integers(1, 4))) + list(rng.choice(common, rng.integers(2, 12))), 0))
    index = {g: i for i, g in enumerate(sorted({g for _, t in known for g in t} | {g for _, x in examples() for g in grams(words(x))}))}
    rows = [rows[i] for i in rng.permutation(len(rows))]
    held = len(rows) // 5
    size = len(index) + (1 << BITS)
    model = Model(index, np.zeros((size + 1, len(FAMILIES) + 1), np.float32), 1.0, sorted(anchors))
    x = [model.row(ws) for ws, _ in rows[held:]]
    model.weights = Ftrl(size, len(FAMILIES) + 1, alpha=0.5, l1=0.01, l2=0.01).fit(x, np.array([y for _, y in rows[held:]]), EPOCHS).astype(np.float32)
    logits = np.log(np.maximum(np.array([model.probabilities(ws) for ws, _ in rows[:held]]), 1e-30))
    model.temperature = fit_temperature(logits, np.array([y for _, y in rows[:held]]))
    return model


def scan(docs: DataFrame, model: Model, text: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns in carry, n_paragraphs, families (sorted, distinct) and found, an array of (paragraph, family, score,
    match): the licence statements of every paragraph of the text, lines that are wrapped taken together (see paragraphs).

    A statement inside a longer paragraph is found by its line or sentence. Of several statements of one family in a paragraph the
    likeliest counts. Null and empty texts and those of white space have no paragraph; texts are read whole; repeated rows
    give a row each; an empty table gives none. A carried column named as a result gets an underscore behind its name."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)  # as large as NAMES, STATEMENTS and 2**BITS make it

    def of(texts: list[str | None]) -> dict:
        m, remembered, n, found = shipped.value, {}, [], []
        for t in texts:
            parts = paragraphs(t or "")
            n.append(len(parts))
            hits = []
            if t and m.spotted(t.lower()):
                for i, lines in enumerate(parts):
                    hits += [{"paragraph": i, "family": f, "score": p, "match": share} for f, p, share in m.statements(lines, remembered)]
            found.append(hits)
        kind = pa.list_(pa.struct([("paragraph", pa.int32()), ("family", pa.string()), ("score", pa.float64()), ("match", pa.float64())]))
        return {"n_paragraphs": pa.array(n, pa.int64()), "families": pa.array([sorted({h["family"] for h in hits}) for hits in found], pa.list_(pa.string())), "found": pa.array(found, kind)}

    return by_text(docs, of, "n_paragraphs long, families array<string>, found array<struct<paragraph:int,family:string,score:double,match:double>>", text, carry)


def query(spark, sf_dir: str) -> DataFrame:
    """op1: the licence statements of every document."""
    docs = read(spark, sf_dir, "documents")
    out = scan(docs, train(docs))
    return out.select("doc_id", "n_paragraphs", F.size("found").cast("long").alias("n_licences"), F.array_join("families", ",").alias("families"), "found")
