"""Licence scan: a trained paragraph classifier over sparse word n-grams, with an unknown class and confirmation by templates."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .store import stored

#: Notices and paragraphs of the public texts of each licence family, the templates of training and confirmation.
TEMPLATES = {
    "apache": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Apache License Version 2.0, January 2004",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "See the License for the specific language governing permissions and limitations under the License.",
    ),
    "mit": (
        "Released under the MIT License.",
        "This project is licensed under the MIT License.",
        "The MIT License (MIT)",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "The Software is provided as is, without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement.",
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "Released under the ISC License.",
    ),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        "You should have received a copy of the GNU General Public License along with this program.",
        "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    ),
    "lgpl": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
        "Licensed under the GNU Lesser General Public License, version 2.1.",
        "You should have received a copy of the GNU Lesser General Public License along with this library",
    ),
    "agpl": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
        "Licensed under the GNU Affero General Public License, version 3.",
        "You should have received a copy of the GNU Affero General Public License along with this program.",
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Released under the BSD 3-Clause License.",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ),
    "mpl": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
        "Licensed under the Mozilla Public License, version 2.0.",
    ),
    "unlicense": (
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ),
    "cc0": (
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
        "Released under CC0 1.0 Universal Public Domain Dedication.",
    ),
    "cc-by": (
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Licensed under CC BY 4.0.",
    ),
    "cc-by-nc": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
    "cc-by-sa": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ),
    "proprietary": (
        "All rights reserved.",
        "Copyright. All rights reserved. No part of this publication may be reproduced or distributed without the prior written permission of the publisher.",
        "This software is confidential and proprietary information and may not be used, copied or disclosed except under a license agreement.",
    ),
}

#: Sentences about licences that license nothing, for the class ``none``.
NEAR_MISSES = (
    "He needs a license to drive a truck in this state.",
    "The version of the story that was released last year was better.",
    "The committee reserved all seats and the rights of members were discussed.",
    "A creative person works under pressure and without restriction.",
    "The commons is a public place in the general area of the town.",
    "She obtained a copy of the file and the source of the program.",
    "Permission to build was granted by the city in January.",
    "Software for the library is free of charge on Sundays.",
    "The Apache helicopter was modified and used in the following conditions.",
    "Students at MIT published a work on binary forms of stars.",
    "Attribution of the painting to the school is not international consensus.",
    "The foundation received terms and conditions with the letter.",
    "Which license should I choose for my next project, asked the developer.",
    "The article compares the Apache License with the GNU General Public License and the MIT License.",
    "Fishing without a license is punished with a fine in that state.",
    "The court held that copyright in the photograph belonged to the publisher.",
    "A warranty of any kind is rare for used cars sold as is.",
    "The distribution of seats followed the public vote.",
    "Mozilla released version 115 of its browser in July.",
    "The software is provided to schools by the foundation.",
    "They met the conditions of the contract and received permission to publish.",
    "The domain is open to the public from May to October.",
)

NONE, UNKNOWN = "none", "unknown"
#: Bound of the sample of corpus paragraphs that training takes as ``none``.
SAMPLE = 2_000
_WORD = r"[a-z0-9]+"


def _grams(text: str) -> tuple[list[str], list[str]]:
    words = re.findall(_WORD, text.lower())
    return words, [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]


@dataclass(frozen=True)
class LicenceModel:
    """``words``: unigrams that a paragraph must hold one of to have any feature; ``weights``: per feature one weight
    for each of ``families``, as calibrated; ``bias``: these of no feature; class ``none`` has weight 0 throughout.
    ``least``: the calibrated probability from which a family is named. ``held_out``: of examples that took no
    part in the fit that judged them: (probability of the best class, whether it is right, number)."""

    families: list[str]
    words: list[str]
    weights: dict[str, list[float]]
    bias: list[float]
    least: float
    held_out: list[tuple[float, bool, int]]


def _softmax(s: np.ndarray) -> np.ndarray:
    e = np.exp(s - s.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


class _Sparse:
    """Rows of features that are present, for sums over a row's features and over a feature's rows."""

    def __init__(self, rows: list[list[int]], width: int):
        self.columns, self.width = np.concatenate([np.array(r, np.int64) for r in rows]), width
        self.starts = np.cumsum([0, *map(len, rows)])[:-1]  # every row has a feature, the bias
        self.order = np.argsort(self.columns, kind="stable")
        self.owners = np.repeat(np.arange(len(rows)), list(map(len, rows)))[self.order]
        self.present, self.begins = np.unique(self.columns[self.order], return_index=True)

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.add.reduceat(w[self.columns], self.starts)

    def transposed_times(self, y: np.ndarray) -> np.ndarray:
        out = np.zeros((self.width, y.shape[1]), y.dtype)
        out[self.present] = np.add.reduceat(y[self.owners], self.begins)
        return out


def _regression(x: _Sparse, y: np.ndarray, n: np.ndarray, rounds: int) -> np.ndarray:
    """Weights of a multinomial logistic regression by gradient steps with momentum; ``n``: how often each row counts."""
    w = step = np.zeros((x.width, y.shape[1]), np.float32)
    for _ in range(rounds):
        step = 0.9 * step - (x.transposed_times((_softmax(x.times(w)) - y) * (n / n.sum())[:, None]) + np.float32(1e-5) * w)
        w = w + step
    return w - w[:, -1:]


def fit(negatives: list[str], templates: dict[str, tuple[str, ...]] = TEMPLATES, near_misses: tuple[str, ...] = NEAR_MISSES, rounds: int = 200, seed: int = 5) -> LicenceModel:
    """Multinomial logistic regression over the presence of words and word pairs of the templates.

    Positives are the templates, whole and with words left out; negatives are ``negatives`` (a bounded sample of
    corpus paragraphs), near misses and single words of templates. Words frequent in the sample are no features,
    and a pair needs one word that is. Both sides weigh the same. For the calibration every near miss and
    paragraph, and every template with words left out, is in one of two halves, and each half is judged by a model
    of the whole templates and the other half; what has the features of anything in that is not judged. On
    these judgements a temperature is fitted by likelihood, and ``least`` is the probability from which 95 % of
    them name the right family.
    """
    rng = np.random.default_rng(seed)
    sampled = [set(_grams(t)[0]) for t in negatives]
    vocabulary = sorted({w for ts in templates.values() for t in ts for w in _grams(t)[0]})
    rare = {w for w in vocabulary if sum(w in s for s in sampled) <= max(1, 0.002 * len(sampled)) and not (len(w) < 2)}
    pairs = sorted({p for ts in templates.values() for t in ts for p in _grams(t)[1] if set(p.split()) & rare})
    features = {g: k for k, g in enumerate([*sorted(rare), *pairs])}
    families = sorted(templates)
    examples: dict[tuple[frozenset[int], int, int], int] = {}

    def add(words: list[str], grams: list[str], kind: int, half: int, n: int = 1) -> None:
        key = (frozenset(features[g] for g in (*words, *grams) if g in features), kind, half)
        examples[key] = examples.get(key, 0) + n

    for k, family in enumerate(families):
        for t in templates[family]:
            words, _ = _grams(t)
            for n in range(11):
                kept = words if n == 0 else [w for w in words if rng.random() > 0.2]
                add(kept, [f"{a} {b}" for a, b in zip(kept, kept[1:], strict=False)], k, n % 2 if n else 2, 1 if n else 10)
    for n, t in enumerate(near_misses):
        add(*_grams(t), len(families), n % 2, 10)
    for n, t in enumerate(negatives):
        add(*_grams(t), len(families), n % 2)
    for t in sorted(rare):
        add(*_grams(t), len(families), 2, 2)
    rows = [[*sorted(found), len(features)] for found, _, _ in examples]
    some = lambda which: _Sparse([r for r, own in zip(rows, which, strict=True) if own], len(features) + 1)
    kinds, halves = np.array([e[1] for e in examples]), np.array([e[2] for e in examples])
    y, n = np.eye(len(families) + 1, dtype=np.float32)[kinds], np.array([*examples.values()], np.float32)
    positive = kinds < len(families)
    weigh = np.where(positive, n / n[positive].sum(), n / n[~positive].sum()).astype(np.float32)
    logits, held = np.zeros_like(y), np.zeros(len(y), bool)
    for half in (0, 1):
        mine = halves == half
        seen = {e[0] for e, own in zip(examples, mine, strict=True) if not own}
        fresh = mine & np.array([e[0] not in seen for e in examples])
        if fresh.any():
            logits[fresh] = some(fresh).times(_regression(some(~mine), y[~mine], weigh[~mine], rounds))
        held |= fresh
    loss = lambda t: -(n[held] * np.log(_softmax(logits[held] / t)[np.arange(held.sum()), kinds[held]] + 1e-12)).sum()
    heat = min((float(t) for t in np.geomspace(0.2, 5.0, 33)), key=loss)
    p, truth, count = _softmax(logits[held].astype(float) / heat), kinds[held], n[held].astype(float)
    best = p.argmax(axis=1)
    named = best < len(families)
    order = np.argsort(-p[named].max(axis=1), kind="stable")
    top, right = p[named].max(axis=1)[order], (best == truth)[named][order] * count[named][order]
    precise = np.flatnonzero(np.cumsum(right) >= 0.95 * np.cumsum(count[named][order]))
    least = float(np.clip(top[precise[-1]] if len(precise) else 0.9, 0.3, 0.9))
    w = _regression(some(halves >= 0), y, weigh, rounds) / heat
    judged = [(float(a), bool(b), int(c)) for a, b, c in zip(p.max(axis=1), best == truth, count, strict=True)]
    return LicenceModel(families, sorted(rare), {g: w[k, :-1].tolist() for g, k in features.items()}, w[-1, :-1].tolist(), least, judged)


def _words(text: Column) -> Column:
    return F.split(F.trim(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", " ")), " ")


def sample(docs: DataFrame, id: str = "doc_id", text: str = "text", most: int = SAMPLE) -> list[str]:
    """At most ``most`` paragraphs, one of each of as many documents chosen by hash, without any that say they license something.

    The share of documents follows from their number, so each task sends its part of the sample only, however many tasks there are.
    """
    share = min(1.0, most / max(1, docs.count()))
    chosen = docs.select(F.xxhash64(F.lit(3), F.col(id)).alias("h"), F.col(text).alias("t")).where(F.pmod("h", F.lit(1 << 40)) < F.lit(int(share * (1 << 40))))
    lines = F.filter(F.split("t", "\n"), lambda x: (F.length(x) > 0) & ~F.lower(x).rlike(r"licen[sc]ed under|(?:released|distributed|published) under|licen[sc]e,? version|public licen[sc]e|rights reserved|permission (?:is hereby|to use)|redistribut|warrant"))
    rows = chosen.select("h", lines.alias("l")).where(F.size("l") > 0).select("h", F.get("l", F.pmod("h", F.size("l")).cast("int")).alias("t"))
    return [r["t"] for r in rows.orderBy("h", "t").limit(most).collect()]


def _with_pairs(words: Column) -> Column:
    pairs = F.when(F.size(words) > 1, F.transform(F.sequence(F.lit(0), F.size(words) - 2), lambda i: F.concat_ws(" ", F.get(words, i), F.get(words, i + 1)))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(words, pairs))


def _computed(rows: DataFrame, **values: Column) -> DataFrame:
    """``rows`` with more columns, computed once a row: behind a generator, Spark cannot move them into functions that run for each element."""
    return rows.select("*", F.explode(F.array(F.struct(*[v.alias(n) for n, v in values.items()]))).alias("_c")).select(*rows.columns, "_c.*")


def _units(source: DataFrame, model: LicenceModel, templates: dict[str, tuple[str, ...]], coverage: float) -> DataFrame:
    """(``id``, ``line``, ``last``, ``gram``) of the paragraphs to be judged, with the template's words and pairs in them.

    Every line with a feature word is one. So is every run of two or more lines in a row with a feature word, or
    between two such, for a notice may be broken into lines: a run ends before a blank line, before a line that
    begins like a template, and at a line that covers a template by itself. Pairs reach over the line breaks in a run.
    Only lines of documents with a feature word go on; a document's are put in order by line, whatever their number.
    """
    every = {g for ts in templates.values() for t in ts for g in sum(_grams(t), [])}
    opens = {" ".join(_grams(t)[0][:3]) for ts in templates.values() for t in ts if len(_grams(t)[0]) > 3}
    known = F.array(*[F.array(*[F.lit(g) for g in sorted(set(sum(_grams(t), [])))]) for ts in templates.values() for t in ts])
    blank = lambda w: (F.size(w) == 0) | (F.get(w, F.lit(0)) == "")
    rows = _computed(source, w=F.transform(F.split("t", "\n"), _words)).drop("t")
    rows = _computed(rows, near=F.transform("w", lambda w: F.exists(w, lambda x: x.isin(model.words)))).where(F.array_contains("near", True))
    spots = F.filter(F.sequence(F.lit(0), F.size("w") - 1), lambda k: F.get("near", k) | (F.coalesce(F.get("near", k - 1), F.lit(False)) & F.coalesce(F.get("near", k + 1), F.lit(False)) & ~blank(F.get("w", k))))
    lines = rows.select("id", F.explode(F.transform(spots, lambda k: F.struct(k.alias("line"), F.get("near", k).alias("near"), F.get("w", k).alias("w")))).alias("s")).select("id", "s.*")
    lines = _computed(lines, grams=F.filter(_with_pairs(F.col("w")), lambda g: g.isin(sorted(every))), first=F.get("w", F.lit(0)), final=F.element_at("w", -1), opens=F.array_join(F.slice("w", 1, 3), " ").isin(sorted(opens))).drop("w")
    covers = F.exists(known, lambda t: (F.size("grams") >= F.lit(coverage) * F.size(t)) & (F.size(F.array_intersect(t, F.col("grams"))) >= F.lit(coverage) * F.size(t)))
    lines = stored(lines.withColumn("alone", F.col("near") & covers).distinct(), "licence-lines")
    single = lines.where("near").select("id", "line", F.col("line").alias("last"), F.explode("grams").alias("gram"))
    order = W.partitionBy("id").orderBy("line", "first", "final")
    runs = lines.where("not alone").withColumn("before", F.lag(F.struct("line", "final")).over(order))
    runs = runs.withColumn("goes_on", F.coalesce((F.col("before.line") == F.col("line") - 1) & ~F.col("opens"), F.lit(False)))
    runs = runs.withColumn("run", F.sum((~F.col("goes_on")).cast("int")).over(order))
    across = F.when(F.col("goes_on"), F.concat_ws(" ", "before.final", "first"))
    runs = runs.withColumn("grams", F.when(across.isin(sorted(every)), F.concat("grams", F.array(across))).otherwise(F.col("grams")))
    whole = W.partitionBy("id", "run")
    runs = runs.withColumn("begin", F.min("line").over(whole)).withColumn("last", F.max("line").over(whole)).where("begin < last")
    return single.unionByName(runs.select("id", F.col("begin").alias("line"), "last", F.explode("grams").alias("gram")))


def scan(docs: DataFrame, model: LicenceModel, id: str = "doc_id", text: str = "text", templates: dict[str, tuple[str, ...]] = TEMPLATES, coverage: float = 0.6) -> DataFrame:
    """Lines of ``docs`` that hold any feature word, and runs of such lines: ``id``, ``line``, ``last``,
    ``family`` (or ``none``, or ``unknown`` where the best family is below the calibrated probability or no template of
    it is covered), ``probability``, ``covered`` (greatest share of the words and pairs of a template of the family) and ``best``.

    A line without a feature word has the bias only, hence class ``none``; it is left out. Of families with equal
    scores the last by name counts. The weights are as many as the templates have n-grams, so they are sent to all
    tasks. Texts are read whole. Null and empty texts have no row; rows that share an id are one document; an empty
    table gives an empty one.
    """
    spark = docs.sparkSession
    names = model.families
    source = docs.select(F.col(id).alias("id"), F.col(text).alias("t"))
    unit = ["id", "line", "last"]
    grams = stored(_units(source, model, templates, coverage).distinct(), "licence-grams")
    weights = spark.createDataFrame([(g, *w) for g, w in model.weights.items()], "gram string, " + ", ".join(f"w{k} double" for k in range(len(names))))
    sums = grams.join(F.broadcast(weights), "gram").groupBy(*unit).agg(*[(F.sum(f"w{k}") + F.lit(b)).alias(f"s{k}") for k, b in enumerate(model.bias)])
    total = sum((F.exp(F.least(F.col(f"s{k}"), F.lit(500.0))) for k in range(len(names))), F.lit(1.0))
    best = F.array_max(F.array(F.struct(F.lit(0.0).alias("s"), F.lit(NONE).alias("name")), *[F.struct(F.col(f"s{k}").alias("s"), F.lit(n).alias("name")) for k, n in enumerate(names)]))
    sums = sums.withColumn("b", best).select(*unit, F.col("b.name").alias("best"), (F.exp(F.least("b.s", F.lit(500.0))) / total).alias("probability"))
    own = [(f, k, g, 1.0 / len(set(sum(_grams(t), [])))) for f, ts in templates.items() for k, t in enumerate(ts) for g in set(sum(_grams(t), []))]
    parts = spark.createDataFrame(own, "family string, template int, gram string, part double")
    shares = grams.join(F.broadcast(parts), "gram").groupBy(*unit, "family", "template").agg(F.sum("part").alias("c")).groupBy(*unit, F.col("family").alias("best")).agg(F.round(F.max("c"), 6).alias("covered"))
    shares = shares.select(F.col("id").alias("_id"), F.col("line").alias("_line"), F.col("last").alias("_last"), F.col("best").alias("_best"), "covered")
    same = F.col("id").eqNullSafe(F.col("_id")) & (F.col("line") == F.col("_line")) & (F.col("last") == F.col("_last")) & (F.col("best") == F.col("_best"))
    found = sums.join(shares, same, "left").withColumn("covered", F.coalesce("covered", F.lit(0.0)))
    family = F.when(F.col("best") == NONE, F.lit(NONE)).when((F.col("probability") < model.least) | (F.col("covered") < coverage), F.lit(UNKNOWN)).otherwise(F.col("best"))
    return found.select(*unit, family.alias("family"), "probability", "covered", "best")


def _notices(units: Column) -> Column:
    """Of ``units(order, line, last, family)`` those that overlap none before them that stays."""
    start = F.expr("cast(array() as array<struct<line:int,last:int,family:string>>)")

    def add(kept: Column, x: Column) -> Column:
        clash = F.exists(kept, lambda y: (y["line"] <= x["last"]) & (x["line"] <= y["last"]))
        return F.when(clash, kept).otherwise(F.concat(kept, F.array(F.struct(x["line"].alias("line"), x["last"].alias("last"), x["family"].alias("family")))))

    return F.aggregate(F.array_sort(units), start, add)


def licences(docs: DataFrame, id: str = "doc_id", text: str = "text", most: int = SAMPLE) -> DataFrame:
    """Per row of ``docs``: ``id``, ``families`` (confirmed ones, sorted), ``n_notices`` (lines, or runs of lines, with one) and ``n_unknown`` (lines outside these that look like a licence's, but not like one that is known), after a model fitted on at most ``most`` paragraphs and the templates.

    Of notices that share a line, that which covers its template most counts, then the shortest, then the first.
    """
    model = fit(sample(docs, id, text, most))
    found = scan(docs, model, id, text).where(F.col("family") != NONE).where((F.col("family") != UNKNOWN) | (F.col("line") == F.col("last")))
    order = F.struct((-F.col("covered")).alias("c"), (F.col("last") - F.col("line")).alias("n"), "line", "last", "family")
    found = found.groupBy("id").agg(F.collect_list(F.when(F.col("family") != UNKNOWN, order)).alias("units"), F.collect_list(F.when(F.col("family") == UNKNOWN, F.col("line"))).alias("odd"))
    found = found.withColumn("kept", _notices(F.col("units")))
    odd = F.filter("odd", lambda k: ~F.exists("kept", lambda x: k.between(x["line"], x["last"])))
    found = found.select(F.col("id").alias("_found"), F.array_sort(F.array_distinct(F.transform("kept", lambda x: x["family"]))).alias("families"), F.size("kept").cast("bigint").alias("n_notices"), F.size(odd).cast("bigint").alias("n_unknown"))
    rows = docs.select(F.col(id).alias("id")).join(found, F.col("id").eqNullSafe(F.col("_found")), "left")
    zero = F.lit(0).cast("bigint")
    return rows.select("id", F.coalesce("families", F.array().cast("array<string>")).alias("families"), F.coalesce("n_notices", zero).alias("n_notices"), F.coalesce("n_unknown", zero).alias("n_unknown"))
