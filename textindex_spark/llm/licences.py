"""Licence scan: a trained paragraph classifier, confirmed by template comparison.

A paragraph is a line of text. Its features are the presence of word 1-, 2- and 3-grams that occur in the training set
and the share of its words that the training set knows. A multinomial logistic regression with one class for each licence
family and one for ordinary text is trained on rule-made notices (every family's names in every phrase, with and
without trailing words) and templates, against a bounded sample of the corpus's own paragraphs (NEGATIVES at most, those
that resemble a template left out). Probabilities are sharpened or softened by a temperature fitted on notices held out
of training. A paragraph that is licence text with no family sure enough is of family `unknown`. The template comparison
(shared word trigrams with the family's notices) confirms or leaves unconfirmed what the classifier says.

Every paragraph is scored: no word list decides before the classifier. Only features that are present are visited, and
a 2- or 3-gram can be known only if all its words are, so most words cost one lookup.

Defined results: null and empty texts have no paragraphs; repeated rows give the same rows again; ties between families
go to the first by name; a corpus without paragraphs trains on the built-in ordinary sentences alone; an empty table
gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import read_table

NEGATIVES = 1500
NONE, UNKNOWN = "none", "unknown"
LEAST_PROBABILITY = 0.6
CONFIRMED_FROM = 0.5
#: A family that no template confirms needs this probability.
SURE_ALONE = 0.95
STEPS, RATE, RIDGE = 300, 1.0, 1e-4

#: Word counts of the excerpts of ordinary paragraphs that stand for short paragraphs.
SHORT = (1, 2, 3, 5, 8)

#: The names that notices use for each family.
NAMES = {
    "AGPL": ["GNU Affero General Public License", "GNU Affero General Public License, version 3", "AGPL", "AGPLv3", "AGPL-3.0"],
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache-2.0 license", "Apache 2.0 licence", "Apache Software License"],
    "BSD": ["BSD License", "3-Clause BSD License", "2-Clause BSD License", "New BSD License", "Simplified BSD License", "BSD-3-Clause license"],
    "CC-BY": ["Creative Commons Attribution 4.0 International License", "Creative Commons Attribution License", "CC BY 4.0", "CC-BY 3.0", "CC BY"],
    "CC-BY-NC": ["Creative Commons Attribution-NonCommercial 4.0 International License", "CC BY-NC 4.0", "CC BY-NC-SA 4.0", "CC BY-NC-ND 4.0", "CC BY-NC"],
    "CC-BY-ND": ["Creative Commons Attribution-NoDerivatives 4.0 International License", "CC BY-ND 4.0", "CC BY-ND"],
    "CC-BY-SA": ["Creative Commons Attribution-ShareAlike 4.0 International License", "Creative Commons Attribution-ShareAlike License", "CC BY-SA 4.0", "CC BY-SA 3.0", "CC BY-SA", "CC-SA"],
    "CC0": ["CC0 1.0 Universal Public Domain Dedication", "CC0 1.0", "Creative Commons Zero", "public domain dedication"],
    "GPL": ["GNU General Public License", "GNU General Public License, version 2", "GNU General Public License, version 3", "GPL", "GPLv2", "GPLv3", "GPL-3.0"],
    "ISC": ["ISC License", "ISC licence"],
    "LGPL": ["GNU Lesser General Public License", "GNU Lesser General Public License, version 2.1", "LGPL", "LGPLv2", "LGPLv3", "LGPL-2.1"],
    "MIT": ["MIT License", "MIT licence", "Expat License", "MIT X11 License"],
    "MPL": ["Mozilla Public License", "Mozilla Public License, version 2.0", "MPL 2.0", "MPL-2.0"],
    "Unlicense": ["Unlicense", "The Unlicense"],
}
#: Notices whose wording is their own.
TEMPLATES = {
    "Apache-2.0": ["you may not use this file except in compliance with the License. You may obtain a copy of the License at", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND"],
    "BSD": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"],
    "GPL": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", "You should have received a copy of the GNU General Public License along with this program"],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"],
    "MIT": ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"],
    "MPL": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"],
    "Proprietary": ["All rights reserved.", "Copyright. All rights reserved.", "All rights reserved by the authors.", "Alle Rechte vorbehalten.", "Todos los derechos reservados.", "Tous droits réservés.", "No part of this work may be reproduced without written permission.", "Unauthorized copying of this file is strictly prohibited. Proprietary and confidential."],
    "Unlicense": ["This is free and unencumbered software released into the public domain"],
}
#: Phrases around a licence's name.
PHRASES = ["Released under the {}.", "Licensed under the {}.", "Licensed under {}.", "This work is licensed under the {}.", "This work is licensed under {}.", "Distributed under the terms of the {}.", "Available under the {}.", "This project is licensed under the {} license.", "License: {}", "{}", "SPDX-License-Identifier: {}", "Released under {}.", "{} or later", "Lizenziert unter der {}.", "Lizenz: {}", "Publicado bajo la licencia {}.", "Licencia: {}", "Distribué sous la licence {}.", "Sous licence {}."]
#: Phrases around licences of no known family, and ordinary sentences.
UNKNOWN_NAMES = [f"{a} {b} {c}" for a in ("Example", "Acme", "Open", "Vendor", "Zeta", "Northwind", "Lumen", "Free", "Common") for b in ("Community", "Public", "Source", "Widget", "Data", "Content", "Framework") for c in ("License", "Licence 3.0")]
ORDINARY = ["The weather was fine and the people of the town went out under the trees.", "This is the version of the story that is told in the north.", "He put the files in the public library and walked home free of care.", "A general and two of the soldiers came to the house.", "You may find more on this in the second part of the work.", "By noon the letter was read by all of them.", "Der Mann mit dem Hut kam mit der Bahn aus der Stadt.", "Mit der Zeit wurde der Weg besser.", "Er ging mit der Mutter und die Kinder kamen mit dem Hund unter der Brücke her.", "La casa estaba bajo el monte y todos los amigos vivían en ella.", "Tous les enfants jouent sous la table de la maison."]

_WORD = re.compile(r"[^\W_]+")


def words(paragraph: str) -> list[str]:
    return _WORD.findall(paragraph.lower())


def grams(w: list[str]) -> set[str]:
    return {" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)}


def notices() -> list[tuple[str, str]]:
    """(family, text): the rule-made training notices."""
    out = [(f, p.format(n)) for f, names in NAMES.items() for n in names for p in PHRASES]
    out += [(f, t) for f, texts in TEMPLATES.items() for t in texts for _ in range(4)]
    out += [(UNKNOWN, PHRASES[i % len(PHRASES)].format(n)) for i, n in enumerate(UNKNOWN_NAMES)]
    return out


class Model:
    def __init__(self, classes: list[str], vocabulary: dict[str, int], weights: np.ndarray, temperature: float):
        self.classes, self.vocabulary, self.weights, self.temperature = classes, vocabulary, weights, temperature
        self.templates = {f: [set(grams(words(t))) for g, t in notices() if g == f] for f in classes if f not in (NONE, UNKNOWN)}

    def state(self) -> tuple:
        return self.classes, self.vocabulary, self.weights, self.temperature

    def _row(self, w: list[str]) -> np.ndarray:
        hit, share = hits(w, self.vocabulary)
        own = self.weights[hit].sum(0) / max(1.0, np.sqrt(len(hit)))
        return own + self.weights[-2] + share * self.weights[-1]

    def judge(self, paragraph: str) -> tuple[str, float, float] | None:
        """(family, probability, similarity to the family's nearest notice), or None for ordinary text."""
        w = words(paragraph)
        if not w:
            return None
        z = self._row(w) / self.temperature
        p = np.exp(z - z.max())
        p /= p.sum()
        none = self.classes.index(NONE)
        if p[none] >= 0.5:
            return None
        p[none] = 0
        best = int(p.argmax())
        family, sure = self.classes[best], float(p[best])
        if family == UNKNOWN or sure < LEAST_PROBABILITY:
            return UNKNOWN, float(p.sum()), 0.0
        near = self.similarity(w, family)
        return (family, sure, near) if near >= CONFIRMED_FROM or sure >= SURE_ALONE else (UNKNOWN, float(p.sum()), 0.0)

    def similarity(self, w: list[str], family: str) -> float:
        own = grams(w)
        # one word of a longer notice confirms nothing
        return max((len(own & t) / max(min(len(own), len(t)), min(3, len(t))) for t in self.templates[family] if t and own), default=0.0)


def hits(w: list[str], vocabulary: dict[str, int]) -> tuple[list[int], float]:
    """Numbers of the distinct known grams of the words, and the share of words that are known."""
    at = [vocabulary.get(v, -1) for v in w]
    found = {i for i in at if i >= 0}
    known = len(at) - at.count(-1)
    if known > 1:
        for i in range(len(w) - 1):
            if at[i] >= 0 and at[i + 1] >= 0:
                found.add(vocabulary.get(f"{w[i]} {w[i + 1]}", -1))
                if i + 2 < len(w) and at[i + 2] >= 0:
                    found.add(vocabulary.get(f"{w[i]} {w[i + 1]} {w[i + 2]}", -1))
        found.discard(-1)
    return sorted(found), known / max(1, len(w))


def features(w: list[str], vocabulary: dict[str, int]) -> np.ndarray:
    x = np.zeros(len(vocabulary) + 2, dtype=np.float32)
    hit, share = hits(w, vocabulary)
    x[hit] = 1 / max(1.0, np.sqrt(len(hit)))
    x[-2] = 1.0
    x[-1] = share
    return x


def train(negatives: list[str]) -> Model:
    """Fit on the notices and on ordinary paragraphs; every fifth example is held out for the temperature."""
    known = notices()
    templates = sorted({frozenset(grams(words(t))) for _, t in known}, key=sorted)
    holding: dict[str, list[int]] = {}
    for i, t in enumerate(templates):
        for g in t:
            holding.setdefault(g, []).append(i)
    plain: list[tuple[str, tuple[str, ...]]] = []
    for k, text in enumerate([*ORDINARY, *negatives]):
        w = words(text)[:400]
        n = SHORT[k % len(SHORT)]
        # the paragraph, its beginning and a stretch from inside: short paragraphs are ordinary text as well
        for part in (w, w[:n], w[(at := k % max(1, len(w) - n + 1)) : at + n]):
            shared = Counter(i for g in grams(part) for i in holding.get(g, ()))
            if part and not any(c >= 0.5 * len(templates[i]) for i, c in shared.items()):
                plain.append((NONE, tuple(part)))
    plain = [*dict.fromkeys(plain)]
    # a known word alone in a line is ordinary where ordinary text uses it, unless it is a notice in itself
    plain += [(NONE, (v,)) for v in sorted({v for _, w in plain for v in w} & holding.keys()) if frozenset((v,)) not in templates for _ in range(6)]
    rows = [(f, words(t)) for f, t in known] + plain
    classes = sorted({f for f, _ in rows})
    vocabulary = {g: i for i, g in enumerate(sorted({g for f, w in rows if f != NONE for g in grams(w)}))}
    x = np.array([features(w, vocabulary) for _, w in rows])
    y = np.array([classes.index(f) for f, _ in rows])
    held = np.arange(len(rows)) % 5 == 4
    weights = np.zeros((x.shape[1], len(classes)), dtype=np.float32)
    seen, known_y = x[~held], y[~held]
    one = np.eye(len(classes), dtype=np.float32)[known_y]
    share = np.maximum(np.bincount(known_y, minlength=len(classes)), 1)
    # ordinary text weighs as much as all families together, and each family as much as another
    weight = np.where(known_y == classes.index(NONE), len(classes) - 1, 1) / share[known_y]
    weight = (weight / weight.sum()).astype(np.float32)
    speed = np.zeros_like(weights)
    for _ in range(STEPS):
        z = seen @ weights
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        slope = seen.T @ ((p - one) * weight[:, None]) + RIDGE * weights
        speed = 0.9 * speed - RATE * 5 * slope
        weights += speed.astype(np.float32)
    z = x[held] @ weights

    def loss(t: float) -> float:
        s = z / t
        return float(np.mean(np.log(np.exp(s - s.max(1, keepdims=True)).sum(1)) + s.max(1) - s[np.arange(len(s)), y[held]]))

    return Model(classes, vocabulary, weights, min(np.geomspace(0.5, 4, 30).tolist(), key=loss))


def fit(docs: DataFrame, negatives: int = NEGATIVES) -> Model:
    """Train with paragraphs of the corpus as ordinary text: one paragraph of each of at most `negatives` documents."""
    line = F.filter(F.split("text", "\n"), lambda x: F.length(x) >= 20)
    # ids are chosen first and joined back, so texts that are not chosen go nowhere
    ids = docs.where("text is not null and doc_id is not null").select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(negatives)
    some = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(ids), "doc_id").dropDuplicates(["doc_id"])
    rows = some.select("doc_id", F.get(line, F.pmod(F.xxhash64("doc_id"), F.greatest(F.size(line), F.lit(1))).cast("int")).alias("p")).where("p is not null")
    return train([r["p"] for r in rows.select("doc_id", F.substring("p", 1, 4000).alias("p")).orderBy("doc_id").collect()])


def _scanned(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(*shared.value)
        for batch in batches:
            rows = []
            for doc_id, text in zip(*(c.to_pylist() for c in batch.columns)):
                at = 0
                for k, line in enumerate((text or "").split("\n")):
                    found = model.judge(line) if line else None
                    if found:
                        rows.append({"doc_id": doc_id, "paragraph": k, "start": at, "end": at + len(line), "family": found[0], "probability": round(found[1], 6), "similarity": round(found[2], 6), "confirmed": found[2] >= CONFIRMED_FROM})
                    at += len(line) + 1
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("doc_id", pa.int64()), ("paragraph", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("family", pa.string()), ("probability", pa.float64()), ("similarity", pa.float64()), ("confirmed", pa.bool_())]))

    return run


def scan(docs: DataFrame, model: Model) -> DataFrame:
    """A row for each paragraph that is licence text."""
    shared = docs.sparkSession.sparkContext.broadcast(model.state())
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_scanned(shared), "doc_id long, paragraph int, start long, end long, family string, probability double, similarity double, confirmed boolean")


def op5_licences(spark, sf_dir) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return scan(docs, fit(docs))
