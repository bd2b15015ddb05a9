"""Licence families by a trained paragraph classifier, in DataFrame functions only on the scanning path.

A sparse multinomial logistic regression over word n-grams (1 to 3 words; only n-grams with at least one word that licence texts live by) tells
the families apart. It is fitted on the driver from the notices in ``NOTICES`` and their cut and joined variants, against ``OTHER`` sentences that
use the same words otherwise. The unknown class has two doors: a class of its own, and a least probability ``cutoff`` set where 99 % of held-out
other sentences are rejected. A family is confirmed when its best notice shares enough word pairs with the paragraph (containment).

A paragraph is a line of the text. A notice that is wrapped over lines is looked for where a line ends and the next one has words too: the last words of
the line with the first ones of those after it, as many on either side as the longest notice has (``_reach``; a half and a quarter of those after it as
well, since another notice may follow), up to a line without letters and digits or one that is a whole notice itself. It is listed under the line that it
begins in; what lines one after the other give for related families is one notice.

A line without a word of licences has no feature at all and is unknown, so a single expression on the text decides whether
anything else is computed. Nothing is shuffled. Null and empty texts have one empty paragraph, which is unknown; repeated rows give repeated results.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanseek.llm.common import query, table, whole

# Short notices as licensors publish them.
NOTICES = {
    "MIT": ["Released under the MIT License.", "Licensed under the MIT License.", "This project is licensed under the terms of the MIT license.",
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, "
            "to deal in the Software without restriction.", "SPDX-License-Identifier: MIT", "Distributed under the MIT license, see LICENSE."],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the License); you may not "
                   "use this file except in compliance with the License.", "Released under the Apache 2.0 license.",
                   "This project is licensed under the terms of the Apache License 2.0.", "SPDX-License-Identifier: Apache-2.0"],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it "
                "and or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 "
                "of the License, or any later version.", "Released under the GPL v3 license.", "SPDX-License-Identifier: GPL-3.0-or-later",
                "Licensed under GPLv3."],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2.", "it under the terms of the GNU General Public License version "
                "2 as published by the Free Software Foundation.", "Released under the GPL v2 license.", "SPDX-License-Identifier: GPL-2.0-only"],
    "LGPL": ["This library is licensed under the GNU Lesser General Public License, version 2.1.", "Licensed under the LGPL.",
             "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation.", "SPDX-License-Identifier: LGPL-3.0"],
    "AGPL": ["This work is licensed under the GNU Affero General Public License, version 3.", "Licensed under the AGPL.",
             "SPDX-License-Identifier: AGPL-3.0", "under the terms of the GNU Affero General Public License."],
    "BSD": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions "
            "are met.", "Released under the BSD License.", "Licensed under the 3-clause BSD license.", "SPDX-License-Identifier: BSD-3-Clause"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License 2.0.",
                "SPDX-License-Identifier: MPL-2.0"],
    "CC-BY": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.",
              "Released under the Creative Commons Attribution license, CC BY 3.0."],
    "CC-BY-SA": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
                 "Text is available under the Creative Commons Attribution-ShareAlike License, CC BY-SA."],
    "CC-BY-NC": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
                 "Released under CC BY-NC 3.0 for non-commercial use."],
    "CC0": ["Released under CC0 1.0 Universal.", "To the extent possible under law, the author has waived all copyright and related rights, CC0 public "
            "domain dedication.", "This work is dedicated to the public domain under CC0."],
    "proprietary": ["All rights reserved. No part of this work may be copied without permission of the copyright holder.",
                    "Copyright 2020 the author. All rights reserved.", "This software is proprietary and confidential, unauthorized copying is prohibited."],
}
OTHER = [
    "The driver had no valid license.", "She is a licensed physician in the city.", "The Apache helicopter landed near the river.", "He studied at MIT for four years.",
    "The license plate was hard to read.", "Copyright law changed in this century.", "They granted permission to enter the building.",
    "A public domain is not a private one.", "The commons met on Tuesday for a creative debate.", "Fishing licences cost more this year.", "The wildebeest, or gnu, "
    "lives on the plain.", "The version of the story is old.", "See the license terms of your provider.", "The software was used without restriction.",
    "Free software is a wide subject.", "The foundation published a report.", "The warranty of the car has ended.", "Redistribution of wealth was the general "
    "topic.", "Licensed premises close at ten.", "The general public was not admitted.", "A copy of this document is in the source archive.",
    "Mozilla and other firms met.", "The BSD daemon is a mascot.", "Please read the LICENSE file.", "The license fee is due.", "It may be copied without loss.",
]
ANCHORS = ("licen[cs]e[ds]?", "copyright", "rights", "gnu", "a?gpl(?:v[23])?", "lgpl", "mit", "apache(?:-2\\.0)?", "bsd", "mozilla", "mpl-2\\.0", "creative",
           "commons", "cc", "cc0", "permission", "redistribution", "redistribute", "proprietary", "domain", "spdx-license-identifier", "gpl-[23]\\.0\\S*",
           "a?gpl-3\\.0", "lgpl-3\\.0", "bsd-3-clause")
GATE = r"(?i)(?<![a-z0-9])(?:licen[cs]|copyright|rights|gnu|a?gpl|lgpl|mit|apache|bsd|mozilla|mpl|creative|commons|cc0?|permission|redistribut|proprietary|domain|spdx)"
WORD = r"[a-z0-9]+(?:[.-][a-z0-9]+)*"
BUCKETS = 512
SIMILAR = 0.6
_ANCHOR = re.compile("(?:" + "|".join(ANCHORS) + r")\Z")


def _words(text: str) -> list[str]:
    return re.findall(WORD, text.lower())


def _grams(ws: list[str]) -> set[str]:
    return {" ".join(ws[i:i + n]) for n in (1, 2, 3) for i in range(len(ws) - n + 1) if any(_ANCHOR.match(w) for w in ws[i:i + n])}


@dataclass(frozen=True)
class Model:
    families: list[str]                # the last one is "unknown"
    weights: dict[str, list[float]]    # one list per n-gram
    bias: list[float]
    cutoff: float
    templates: list[tuple[str, list[str]]]  # family, word pairs


def _variants(text: str, rng: np.random.Generator) -> list[str]:
    ws = text.split()
    out = [text, "Note. " + text, text + " See the file for details."]
    for _ in range(4):
        keep = rng.random(len(ws)) > 0.12
        out.append(" ".join(w for w, k in zip(ws, keep) if k))
    return out


@lru_cache(maxsize=1)
def fit(penalty: float = 2e-3, steps: int = 600) -> Model:
    """From the fixed notices alone, so that every run has the same weights."""
    rng = np.random.default_rng(7)
    families = [*NOTICES, "unknown"]
    rows = [(_grams(_words(v)), families.index(f)) for f, ts in NOTICES.items() for t in ts for v in _variants(t, rng)]
    others = [(_grams(_words(v)), len(families) - 1) for t in OTHER for v in _variants(t, rng)]
    held = others[::4]
    rows += [x for i, x in enumerate(others) if i % 4] + [(set(), len(families) - 1)] * 20
    names = sorted({g for gs, _ in rows for g in gs})
    at = {g: i for i, g in enumerate(names)}
    x = np.zeros((len(rows), len(names)))
    for i, (gs, _) in enumerate(rows):
        x[i, [at[g] for g in gs]] = 1
    y = np.eye(len(families))[[k for _, k in rows]]
    share = 1 / np.sqrt(y.sum(0) + 1)
    row_weight = (y * share).sum(1)
    row_weight /= row_weight.mean()
    w, b = np.zeros((len(names), len(families))), np.zeros(len(families))
    for _ in range(steps):
        p = _softmax(x @ w + b)
        miss = (p - y) * row_weight[:, None]
        w -= 2.0 * (x.T @ miss / len(rows) + penalty * w)
        b -= 2.0 * miss.mean(0)
    kept = np.abs(w).max(1) > 0.02  # sparse: n-grams that tell nothing are left out
    weights = {g: [round(float(v), 4) for v in w[i]] for g, i in at.items() if kept[i]}
    model = Model(families, weights, [round(float(v), 4) for v in b], 0.0,
                  [(f, sorted({" ".join(p) for p in zip(_words(t), _words(t)[1:])})) for f, ts in NOTICES.items() for t in ts])
    top = sorted(max(_softmax(_score(model, gs))[:-1]) for gs, _ in held)
    cutoff = max(0.5, top[int(0.99 * (len(top) - 1))])
    return Model(model.families, model.weights, model.bias, round(min(cutoff, 0.8), 4), model.templates)


def _softmax(z):
    e = np.exp(z - np.max(z, axis=-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def _score(model: Model, grams: set[str]) -> np.ndarray:
    return np.array(model.bias) + sum((np.array(model.weights[g]) for g in grams if g in model.weights), np.zeros(len(model.bias)))


def _literal(value: object, kind: str) -> Column:
    """A constant of a nested type, folded once when the plan is made."""
    return F.from_json(F.lit(json.dumps(value)), kind)


def _bind(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once: higher-order functions evaluate an outer expression anew for every element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _bucketed(model: Model, spark) -> Column:
    """The weights as an array of small maps by hash, since looking up a large map reads it from its start."""
    names = sorted(model.weights)
    hashes = [r.h for r in spark.createDataFrame([(i, g) for i, g in enumerate(names)], "i int, g string").orderBy("i")
              .select(F.pmod(F.xxhash64("g"), F.lit(BUCKETS)).alias("h")).collect()]
    buckets: list[dict] = [{} for _ in range(BUCKETS)]
    for g, h in zip(names, hashes):
        buckets[h][g] = model.weights[g]
    return _literal(buckets, "array<map<string,array<double>>>")


def _reach(model: Model) -> int:
    """Words of the longest notice, with room for some that were put in."""
    return max(len(pairs) for _, pairs in model.templates) + 8


def _kin(family: Column) -> Column:
    """One name for the families whose notices have most words in common."""
    return F.when(family.contains("GPL"), "GPL").when(family.startswith("CC-BY"), "CC-BY").otherwise(family)


def _words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def classify(ws: Column, model: Model, weights: Column) -> Column:
    """struct(family, prob, similarity) of the words of a paragraph; family "unknown" where no family is probable and confirmed."""
    k = len(model.families)
    lookup = lambda g: F.element_at(F.get(weights, F.pmod(F.xxhash64(g), F.lit(BUCKETS)).cast("int")), g)

    def run_of(ws: Column, n: int) -> Column:
        size = F.size(ws)
        return F.when(size >= n, F.transform(F.sequence(F.lit(0), F.greatest(size - n, F.lit(0))),
                                             lambda i: F.concat_ws(" ", *[F.get(ws, i + j) for j in range(n)]))).otherwise(F.expr("CAST(array() AS array<string>)"))

    def scored(ws: Column) -> Column:
        grams = F.array_distinct(F.concat(ws, run_of(ws, 2), run_of(ws, 3)))
        found = F.filter(F.transform(grams, lookup), lambda v: v.isNotNull())
        total = F.aggregate(found, F.array(*[F.lit(float(b)) for b in model.bias]), lambda a, v: F.zip_with(a, v, lambda p, q: p + q))
        return F.struct(total.alias("z"), F.array_distinct(run_of(ws, 2)).alias("pairs"))

    def decided(s: Column) -> Column:
        peak = F.array_max(s["z"])
        powers = F.transform(s["z"], lambda v: F.exp(v - peak))
        best = F.array_max(F.transform(F.slice(s["z"], F.lit(1), F.lit(k - 1)), lambda v, i: F.struct(v.alias("v"), (-i).alias("i"))))
        return F.struct(F.get(F.array(*[F.lit(f) for f in model.families]), -best["i"]).alias("family"),
                        (F.exp(best["v"] - peak) / F.aggregate(powers, F.lit(0.0), lambda a, v: a + v)).alias("prob"), s["pairs"].alias("pairs"))

    templates = _literal([{"family": f, "pairs": p} for f, p in model.templates], "array<struct<family:string,pairs:array<string>>>")

    def compared(d: Column) -> Column:
        similarity = F.array_max(F.transform(F.filter(templates, lambda t: t["family"] == d["family"]),
                                             lambda t: F.size(F.array_intersect(t["pairs"], d["pairs"])) / F.size(t["pairs"])))
        good = (d["prob"] >= model.cutoff) & (similarity >= SIMILAR)
        return F.struct(F.when(good, d["family"]).otherwise("unknown").alias("family"), F.round(d["prob"], 6).alias("prob"),
                        F.round(similarity, 6).alias("similarity"))

    return _bind(_bind(_bind(ws, scored), decided), compared)


def scan(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """``docs`` with ``licences``: array of struct(paragraph, family, prob, similarity) of the paragraphs that a family was found in, and
    ``n_paragraphs``."""
    model = model or fit()
    weights = _bucketed(model, docs.sparkSession)
    text = whole()
    kind = "array<struct<paragraph:int,family:string,prob:double,similarity:double>>"

    reach = _reach(model)

    def confirmed(asked: Column) -> Column:
        made = F.transform(asked, lambda x: F.transform(F.array(classify(x["ws"], model, weights)), lambda c: F.struct(
            x["i"].alias("paragraph"), c["family"].alias("family"), c["prob"].alias("prob"), c["similarity"].alias("similarity"))))
        return F.filter(F.flatten(made), lambda c: c["family"] != "unknown")

    def found(lines: Column) -> Column:
        asked = F.filter(F.transform(lines, lambda p, i: F.struct(i.alias("i"), p.alias("p"))), lambda x: x["p"].rlike(GATE))
        alone = confirmed(F.transform(asked, lambda x: F.struct(x["i"].alias("i"), _words_of(x["p"]).alias("ws"))))
        return _bind(F.struct(lines.alias("lines"), alone.alias("alone")), with_wrapped)

    def with_wrapped(s: Column) -> Column:
        taken = F.transform(F.filter(s["alone"], lambda c: c["similarity"] >= 1), lambda c: c["paragraph"])
        signs = F.transform(s["lines"], lambda p, i: F.when(F.array_contains(taken, i) | ~p.rlike(r"[\p{L}\p{N}]"), "-").when(p.rlike(GATE), "g").otherwise("o"))
        return _bind(F.struct(s["lines"].alias("lines"), s["alone"].alias("alone"), F.concat_ws("", signs).alias("signs")), wrapped)

    def wrapped(s: Column) -> Column:
        ahead = F.transform(s["lines"], lambda p, i: F.struct(
            i.alias("i"), F.regexp_extract(F.substring(s["signs"], i + 1, F.lit(reach + 1)), "^[go]+", 0).alias("signs")))
        asked = F.filter(ahead, lambda x: (F.length(x["signs"]) > 1) & x["signs"].contains("g"))

        def around(x: Column) -> Column:
            after = F.aggregate(F.slice(s["lines"], x["i"] + 2, F.length(x["signs"]) - 1), F.expr("CAST(array() AS array<string>)"),
                                lambda ws, p: F.when(F.size(ws) >= reach, ws).otherwise(F.slice(F.concat(ws, _words_of(p)), 1, reach)))
            before = F.reverse(F.slice(F.reverse(_words_of(F.get(s["lines"], x["i"]))), 1, reach))
            return _bind(F.struct(before.alias("before"), after.alias("after")), lambda w: F.array_distinct(F.array(*[
                F.struct(x["i"].alias("i"), F.concat(w["before"], F.slice(w["after"], 1, n)).alias("ws")) for n in (reach // 4, reach // 2, reach)])))

        def joined(runs: Column, c: Column) -> Column:
            last = F.element_at(runs, -1)
            goes_on = (F.size(runs) > 0) & (last["end"] + 1 >= c["paragraph"]) & (_kin(last["best"]["family"]) == _kin(c["family"]))
            run = F.when(goes_on, F.struct(last["first"].alias("first"), c["paragraph"].alias("end"),
                                           F.when(c["similarity"] >= last["best"]["similarity"], c).otherwise(last["best"]).alias("best"))
                         ).otherwise(F.struct(c["paragraph"].alias("first"), c["paragraph"].alias("end"), c.alias("best")))
            return F.concat(F.slice(runs, F.lit(1), F.size(runs) - goes_on.cast("int")), F.array(run))

        one = kind.removeprefix("array<").removesuffix(">")
        by_kin = F.transform(F.array_sort(F.transform(confirmed(F.flatten(F.transform(asked, around))), lambda c: F.struct(_kin(c["family"]).alias("kin"), c.alias("c")))),
                             lambda x: x["c"])
        runs = F.aggregate(by_kin, F.expr(f"CAST(array() AS array<struct<first:int,end:int,best:{one}>>)"), joined)
        return F.when(s["signs"].rlike("g[go]|[go]g"), _bind(F.struct(s["alone"].alias("alone"), runs.alias("runs")), both)).otherwise(s["alone"])

    def both(s: Column) -> Column:
        """Of a line and the run of lines that it stands in, with related families, the one that shares more with its notice."""
        meets = lambda c, r: c["paragraph"].between(r["first"], r["end"] + 1) & (_kin(c["family"]) == _kin(r["best"]["family"]))
        lines = F.filter(s["alone"], lambda c: ~F.exists(s["runs"], lambda r: meets(c, r) & (r["best"]["similarity"] > c["similarity"])))
        runs = F.filter(s["runs"], lambda r: ~F.exists(s["alone"], lambda c: meets(c, r) & (r["best"]["similarity"] <= c["similarity"])))
        return F.array_sort(F.concat(lines, F.transform(runs, lambda r: r["best"])))

    return (docs.withColumn("licences", F.when(text.rlike(GATE), _bind(F.split(text, "\n", -1), found)).otherwise(F.expr(f"CAST(array() AS {kind})")))
            .withColumn("n_paragraphs", (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long")))


@query("op1_license_scan")
def license_scan(spark, folder: str) -> DataFrame:
    found = scan(table(spark, folder, "documents").select("doc_id", "text")).drop("text")
    best = F.array_max(F.transform("licences", lambda c: F.struct(c["prob"].alias("prob"), (-c["paragraph"]).alias("p"), c["family"].alias("family"),
                                                                  c["similarity"].alias("similarity"))))
    listed = F.array_join(F.transform("licences", lambda c: F.concat_ws(":", c["paragraph"].cast("string"), c["family"])), ",")
    return found.select("doc_id", "n_paragraphs", F.size("licences").cast("long").alias("n_licences"), best["family"].alias("family"),
                        best["prob"].alias("prob"), best["similarity"].alias("similarity"), listed.alias("licences"))
