"""Licence scans: paragraphs are classified by sparse word n-grams; DataFrame functions only.

A logistic regression over words and pairs of words, trained here on variations of public licence notices and on other prose,
gives each paragraph a family or ``unknown``; the bar for a family is calibrated on variations it wasn't trained on.
A prediction counts as confirmed if the paragraph holds nearly all words of one of the family's templates.  Paragraphs are
lines, and the lines between blank ones as a whole: where the whole is confirmed as a family that none of its lines is, it stands
for its unconfirmed lines.  Those without any of the ``ANCHORS``, one of which is in every template, aren't scored: they can't be confirmed.

Defined results: a null, empty or licence-free text gives family ``none`` with no paragraphs; repeated rows each
get their own row; a null id stays null; an empty table gives an empty result; other columns are ignored; a very long
paragraph is read whole.
"""

from __future__ import annotations

import random
import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Lower-case strings, at least one of which every template holds; without any a paragraph has no template's phrase and isn't scored.
ANCHORS = ("licen", "copyright", "rights reserved", "public domain", "creative commons", "spdx", "copyleft", "hereby granted", "redistribut", "gplv", "gpl v", "gpl-", "cc by", "cc-by", "cc0", "rechte vorbehalten", "droits réservés", "derechos reservados")
TEMPLATES: dict[str, tuple[str, ...]] = {
    "apache-2.0": ("Licensed under the Apache License, Version 2.0.", "SPDX-License-Identifier: Apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    "mit": ("Released under the MIT License.", "SPDX-License-Identifier: MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software, subject to the copyright notice and this permission notice", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions"),
    "gpl-3.0": ("This work is licensed under the GNU General Public License, version 3.", "SPDX-License-Identifier: GPL-3.0-or-later", "GPLv3", "GPL v3", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"),
    "gpl-2.0": ("This work is licensed under the GNU General Public License, version 2.", "SPDX-License-Identifier: GPL-2.0-only", "GPLv2", "GPL v2", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License"),
    "lgpl-2.1": ("Licensed under the GNU Lesser General Public License, version 2.1.", "SPDX-License-Identifier: LGPL-2.1-or-later"),
    "agpl-3.0": ("Licensed under the GNU Affero General Public License, version 3.", "SPDX-License-Identifier: AGPL-3.0-or-later"),
    "bsd-3-clause": ("Distributed under the BSD 3-Clause License.", "SPDX-License-Identifier: BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products"),
    "bsd-2-clause": ("Distributed under the BSD 2-Clause License.", "SPDX-License-Identifier: BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    "mpl-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "SPDX-License-Identifier: MPL-2.0"),
    "isc": ("Released under the ISC License.", "SPDX-License-Identifier: ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    "cc-by-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "SPDX-License-Identifier: CC-BY-4.0"),
    "cc-by-sa-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "SPDX-License-Identifier: CC-BY-SA-4.0"),
    "cc-by-nc-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "SPDX-License-Identifier: CC-BY-NC-4.0"),
    "cc-by-nd-4.0": ("Licensed under CC BY-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.", "SPDX-License-Identifier: CC-BY-ND-4.0"),
    "cc0-1.0": ("Released into the public domain under CC0 1.0.", "SPDX-License-Identifier: CC0-1.0"),
    "proprietary": ("Copyright. All rights reserved.", "Proprietary and confidential. All rights reserved. No licence is granted.", "Alle Rechte vorbehalten.", "Tous droits réservés.", "Todos los derechos reservados."),
}
OTHER = (
    "a driver must carry a valid license at all times", "the state will license new restaurants next year", "the copyright office moved to another building",
    "he lost his hunting licence after the trial", "songs enter the public domain after seventy years", "artistic license allowed the painter to change the scene",
    "the museum reserves all rooms and rights reserved for members", "creative commons of the village are open to sheep", "see the license for details",
    "license plate numbers were written down by the officer", "a licensed electrician has to inspect the wiring", "copyright law is taught in the second term",
    "version 2 of the report is available at the library", "the work is under the bridge and may be used by any person",
)
UNKNOWN = "unknown"
#: Share of a template's words that a paragraph must hold; share of unknown paragraphs that may pass as a family.
CONFIRMED, MISTAKEN = 0.9, 0.01
_WORD = "[^a-z0-9.]+"


def words_of(text: Column) -> Column:
    """Lower-case words; full stops stay inside words only."""
    flat = F.regexp_replace(F.regexp_replace(F.lower(text), _WORD, " "), r"\.(?= |$)|(?<= |^)\.", "")
    return F.filter(F.split(flat, " +"), lambda w: w != "")


def plain_words(text: str) -> list[str]:
    return [w for w in re.sub(r"\.(?= |$)|(?<= )\.|^\.", "", re.sub(_WORD, " ", text.lower())).split(" ") if w]


def grams(words: list[str]) -> set[str]:
    return {*words, *(f"{a} {b}" for a, b in zip(words, words[1:]))}


@dataclass
class Model:
    families: list[str]
    weights: dict[str, list[float]]
    bias: list[float]
    bar: float


def variations(rng: random.Random, count: int) -> list[tuple[list[str], int]]:
    """Words with their family; -1: none."""
    families = sorted(TEMPLATES)
    filler = [w for t in OTHER for w in plain_words(t)]
    out = []
    for _ in range(count):
        for k, family in enumerate(families):
            for template in TEMPLATES[family]:
                words = plain_words(template)
                kept = [w for w in words if rng.random() > 0.04] if len(words) > 8 else words
                pad = lambda: [rng.choice(filler) for _ in range(rng.randrange(0, 12))]
                out.append((pad() + kept + pad(), k))
        for text in OTHER:
            words = plain_words(text)
            rng.shuffle(words) if rng.random() < 0.3 else None
            out.append((words + [rng.choice(filler) for _ in range(rng.randrange(0, 12))], -1))
    return out


def train(seed: int = 7, rounds: int = 300) -> Model:
    """Softmax regression over the n-grams of the templates and of the other prose; a few hundred rows, on the driver."""
    rng = random.Random(seed)
    families = sorted(TEMPLATES)
    known = sorted(set().union(*(grams(plain_words(t)) for ts in TEMPLATES.values() for t in ts), *(grams(plain_words(t)) for t in OTHER)))
    index = {g: i for i, g in enumerate(known)}

    def encode(rows: list[tuple[list[str], int]]) -> tuple[np.ndarray, np.ndarray]:
        x = np.zeros((len(rows), len(known)))
        for i, (words, _) in enumerate(rows):
            x[i, [index[g] for g in grams(words) if g in index]] = 1
        return x, np.array([len(families) if k < 0 else k for _, k in rows])

    (x, y), (vx, vy) = encode(variations(rng, 8)), encode(variations(rng, 8))
    w, b = np.zeros((len(known), len(families) + 1)), np.zeros(len(families) + 1)
    target = np.eye(len(families) + 1)[y]
    for _ in range(rounds):
        p = softmax(x @ w + b)
        w -= 4.0 * (x.T @ (p - target) / len(x) + 2e-4 * w)
        b -= 4.0 * (p - target).mean(axis=0)
    p = softmax(vx @ w + b)[:, :-1].max(axis=1)
    others = np.sort(p[vy == len(families)])
    bar = float(max(0.5, others[int((1 - MISTAKEN) * (len(others) - 1))]))
    return Model(families, {g: [round(v, 5) for v in w[i].tolist()] for g, i in index.items()}, [round(v, 5) for v in b.tolist()], bar)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def scan(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, family (of the best paragraph; ``unknown`` or ``none``), families (all found, joined by commas), paragraphs, confirmed, score."""
    spark = docs.sparkSession
    model = model or train()
    names = [*model.families, UNKNOWN]
    flat = lambda p: F.regexp_replace(F.lower(p), r"\s+", " ")
    low = flat(F.coalesce("text", F.lit("")))
    found = F.lit(False)
    for anchor in ANCHORS:
        found = found | F.contains(low, F.lit(anchor))
    anchored = lambda p: F.exists(F.array(*map(F.lit, ANCHORS)), lambda a: F.contains(p, a))
    kind = "array<struct<block:int,single:boolean,line:string>>"

    def of_block(block: Column, i: Column) -> Column:
        single = F.transform(F.filter(F.split(block, "\n"), lambda p: anchored(F.lower(p))), lambda p: F.struct(i.alias("block"), F.lit(True).alias("single"), p.alias("line")))
        whole = F.array(F.struct(i.alias("block"), F.lit(False).alias("single"), block.alias("line")))
        return F.concat(single.cast(kind), F.when(F.contains(block, F.lit("\n")) & anchored(flat(block)), whole.cast(kind)).otherwise(F.array().cast(kind)))

    lines = F.when(found, F.flatten(F.transform(F.split("text", r"\r?\n[ \t\r]*\n\s*"), of_block))).otherwise(F.array().cast(kind))
    base = materialize(docs.select("doc_id", F.monotonically_increasing_id().alias("rid"), lines.alias("lines")), "licence-lines")
    words = base.where(F.size("lines") > 0).select("rid", F.posexplode("lines").alias("place", "p")).select("rid", "place", "p.block", "p.single", words_of(F.col("p.line")).alias("words"))

    def both(w: Column) -> Column:
        pairs = F.transform(F.sequence(F.lit(0), F.size(w) - 2), lambda i: F.concat_ws(" ", F.get(w, i), F.get(w, i + 1)))
        return F.concat(w, F.when(F.size(w) > 1, pairs).otherwise(F.array().cast("array<string>")))

    # Bound to a lambda's variable, the words are split once a line and not again for every pair.
    each = F.get(F.transform(F.array("words"), both), 0)
    gram = words.select("rid", "place", F.explode(F.array_distinct(each)).alias("gram"))
    weights = spark.createDataFrame([(g, w) for g, w in model.weights.items()], "gram string, weight array<double>")  # bounded by the templates
    hits = gram.join(F.broadcast(weights), "gram")
    sums = hits.groupBy("rid", "place").agg(*[F.sum(F.col("weight")[k]).alias(f"z{k}") for k in range(len(names))])
    scored = words.join(sums, ["rid", "place"], "left")
    z = F.array(*[F.coalesce(F.col(f"z{k}"), F.lit(0.0)) + F.lit(model.bias[k]) for k in range(len(names))])
    scored = scored.select("rid", "place", "block", "single", "words", z.alias("z")).withColumn("top", F.array_max("z"))
    total = F.aggregate("z", F.lit(0.0), lambda s, v: s + F.exp(v - F.col("top")))
    own = F.slice("z", 1, len(names) - 1)
    best = F.array_max(own)
    scored = scored.withColumns({"score": F.exp(best - F.col("top")) / total, "guess": F.element_at(F.array(*map(F.lit, names)), F.array_position(own, best).cast("int"))})
    templates = spark.createDataFrame([(f, [sorted(set(plain_words(t))) for t in ts]) for f, ts in TEMPLATES.items()], "guess string, templates array<array<string>>")
    compared = scored.join(F.broadcast(templates), "guess", "left")
    held = F.exists("templates", lambda t: F.size(F.array_intersect(t, F.col("words"))) >= F.ceil(F.lit(CONFIRMED) * F.size(t)))
    judged = compared.select("rid", "block", "single", "score", F.coalesce(held, F.lit(False)).alias("confirmed"), F.when(F.col("score") >= model.bar, F.col("guess")).otherwise(F.lit(UNKNOWN)).alias("family"))
    judged = judged.withColumn("confirmed", F.col("confirmed") & (F.col("family") != UNKNOWN))
    one = F.struct("family", "confirmed", "score")
    parts = judged.groupBy("rid", "block").agg(F.collect_list(F.when(F.col("single"), one)).alias("own"), F.max(F.when(~F.col("single"), one)).alias("whole"))
    better = F.coalesce(F.col("whole.confirmed"), F.lit(False)) & ~F.exists("own", lambda p: p["confirmed"] & (p["family"] == F.col("whole.family")))
    stands = F.when(better, F.concat(F.filter("own", lambda p: p["confirmed"]), F.array("whole"))).when(F.size("own") > 0, F.col("own")).otherwise(F.array("whole"))
    judged = parts.select("rid", F.explode(stands).alias("p")).select("rid", "p.*")
    order = F.struct("confirmed", F.col("family") != UNKNOWN, "score", "family")
    per = judged.groupBy("rid").agg(F.max_by(F.struct("family", "confirmed", "score"), order).alias("best"), F.count("*").alias("paragraphs"), F.array_join(F.sort_array(F.collect_set("family")), ",").alias("families"))
    out = base.select("doc_id", "rid").join(per, "rid", "left")
    return out.select("doc_id", F.coalesce("best.family", F.lit("none")).alias("family"), F.coalesce("families", F.lit("")).alias("families"), F.coalesce("paragraphs", F.lit(0).cast("long")).alias("paragraphs"), F.coalesce("best.confirmed", F.lit(False)).alias("confirmed"), F.round(F.coalesce("best.score", F.lit(0.0)), 6).alias("score"))
