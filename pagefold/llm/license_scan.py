"""Licence scan: a trained paragraph classifier in DataFrame functions (operator 6).

A paragraph (a line of a text, or wrapped lines joined again) is a set of word bigrams and trigrams.
A sparse multinomial logistic regression, fitted on notices and paragraphs of the licence families and of
other licences (family ``unknown``), fragments of these and all the corpus's own
paragraphs as background, gives each paragraph a probability for each family.  The threshold is
calibrated on what it is held against, the belief that a paragraph is no background, over
paragraphs that the fit hasn't seen: at most FALSE_RATE of the background may pass.  What passes is compared with the family's notices; a
prediction is confirmed when enough of the paragraph's n-grams are theirs.  A paragraph that is
surely a licence notice, but of no one family, is of family ``unknown``.

No Python runs on the executors: paragraphs, n-grams, scores and the comparison are built-in
functions, and the model is a small table of n-gram weights whose size the notices bound.
"""

from __future__ import annotations

import json

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagefold.llm.common import stage

#: Wording that the licences themselves prescribe or that is customary, by family.
NOTICES = {
    "MIT": ["Released under the MIT License.", "Licensed under the MIT license.", "SPDX-License-Identifier: MIT",
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software.",
            "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, and to permit persons to whom the Software is furnished to do so, subject to the following conditions",
            "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
            "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
            "This project is available under the terms of the MIT licence; see the file LICENSE."],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "SPDX-License-Identifier: Apache-2.0",
                   "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
                   "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
                   "Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form.",
                   "Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable patent license to make, have made, use, offer to sell, sell, import, and otherwise transfer the Work.",
                   "This file is distributed under the terms of the Apache License 2.0."],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2.", "SPDX-License-Identifier: GPL-2.0-only",
                "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "SPDX-License-Identifier: GPL-3.0-or-later",
                "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
                "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
                "You should have received a copy of the GNU General Public License along with this program. If not, see the licenses page of the GNU project."],
    "LGPL": ["This library is licensed under the GNU Lesser General Public License, version 2.1.", "SPDX-License-Identifier: LGPL-3.0-only",
             "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation.",
             "You should have received a copy of the GNU Lesser General Public License along with this library."],
    "AGPL-3.0": ["Licensed under the GNU Affero General Public License, version 3.", "SPDX-License-Identifier: AGPL-3.0-only",
                 "You should have received a copy of the GNU Affero General Public License along with this program."],
    "BSD": ["Released under the BSD license.", "Licensed under the 3-Clause BSD License.", "SPDX-License-Identifier: BSD-3-Clause",
            "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
            "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
            "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
            "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
            "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
            "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY."],
    "MPL-2.0": ["Licensed under the Mozilla Public License, version 2.0.", "SPDX-License-Identifier: MPL-2.0",
                "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
                "If a copy of the MPL was not distributed with this file, You can obtain one at the site of the Mozilla project."],
    "CC-BY": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC0": ["Released under CC0 1.0.", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."],
    "Unlicense": ["This is free and unencumbered software released into the public domain.",
                  "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."],
    "ISC": ["Released under the ISC License.", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
            "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS."],
    "proprietary": ["All rights reserved.", "Copyright. All rights reserved. No part of this publication may be reproduced, distributed, or transmitted in any form without the prior written permission of the publisher."],
    # wording of licences outside these families
    "unknown": ["This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
                "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions",
                "The origin of this software must not be misrepresented; you must not claim that you wrote the original software.",
                "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0.",
                "Licensed under the EUPL, Version 1.2 or later.",
                "The contents of this file are subject to the terms of the Common Development and Distribution License (the \"License\").",
                "Distributed under the Boost Software License, Version 1.0.",
                "This package is free software; you can redistribute it under the terms of the Artistic License 2.0.",
                "Use of this software is governed by the Business Source License included in the file LICENSE.",
                "This font software is licensed under the SIL Open Font License, Version 1.1."],
}
FAMILIES = ["(background)", *sorted(NOTICES)]
#: Share of the background that may pass; share of a paragraph's n-grams that confirm; background share from
#: which on an n-gram is no feature.
FALSE_RATE, CONFIRM, COMMON = 0.001, 0.6, 0.005
WRAPPED = 40
WRAP = r"\n(?<=[^\n]{%d}[^\n.!?:\s][ \t]{0,8}\r?\n)[ \t]*(?:(?://+|#+|\*+|--+|;+)[ \t]*)?(?=[^\s/#*;-])" % (WRAPPED - 1)
REGULARISATION, L1_SHARE = 1e-3, 0.5


def ngrams(paragraph: Column) -> Column:
    """Distinct hashes of the word bigrams and trigrams, whatever case and marks; one word gives none."""
    words = F.filter(F.split(F.regexp_replace(F.lower(paragraph), r"[^\p{L}\p{N}]+", " "), " "), lambda w: w != "")

    def of(w: Column) -> Column:
        two = F.when(F.size(w) > 1, F.transform(F.slice(w, 1, F.size(w) - 1), lambda x, i: F.xxhash64(x, F.get(w, i + 1))))
        three = F.when(F.size(w) > 2, F.transform(F.slice(w, 1, F.size(w) - 2), lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2))))
        none = F.array().cast("array<bigint>")
        return F.array_distinct(F.concat(F.coalesce(two, none), F.coalesce(three, none)))

    # the words are taken once: a lambda over a one-element array binds them
    return F.flatten(F.transform(F.array(words), of))


def split_paragraphs(text: Column) -> Column:
    """Lines, those joined that a line end only wraps: a line of WRAPPED characters or more that ends no sentence
    goes on in the next line, behind that line's comment marks, unless that is blank."""
    return F.split(F.regexp_replace(text, WRAP, " "), "\n")


def paragraphs(docs: DataFrame) -> DataFrame:
    """``(row, doc_id, paragraph, text, grams)``: paragraphs of every whole text that hold two words or more."""
    lines = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.posexplode(split_paragraphs(F.col("text"))).alias("paragraph", "text"))
    return lines.withColumn("grams", ngrams(F.col("text"))).filter(F.size("grams") > 0)


def marked(docs: DataFrame, listed: DataFrame) -> DataFrame:
    """``(row, doc_id, paragraph, h, short, n, grams)``: the paragraphs that hold n-grams of ``listed(gram)``, with a hash
    of the paragraph, how many n-grams it has and those that are listed.  Written once: the one pass
    over the texts that the fit, the threshold and the scan share."""
    text = F.col("text")
    rows = paragraphs(docs).select("row", "doc_id", "paragraph", F.xxhash64(text, F.lit(11)).alias("h"), (F.length(text) <= 3).alias("short"),
                                   F.size("grams").alias("n"), F.explode("grams").alias("gram"))
    rows = rows.join(F.broadcast(listed.select("gram")), "gram")
    return stage(rows.groupBy("row", "doc_id", "paragraph", "h", "short", "n").agg(F.collect_list("gram").alias("grams")), "licence-marked")


def own_grams(told: DataFrame) -> DataFrame:
    """``(gram, families)`` of the whole notices."""
    return told.filter("whole").select("family", F.explode("grams").alias("gram")).groupBy("gram").agg(F.collect_set("family").alias("families"))


def notices(spark: SparkSession) -> DataFrame:
    """``(family, text)``: the notices, and the halves and thirds of those of eight words and more."""
    rows = F.array(*(F.struct(F.lit(FAMILIES.index(k)).alias("family"), F.lit(t).alias("text")) for k, v in NOTICES.items() for t in v))
    whole = spark.range(1).select(F.explode(rows).alias("r")).select("r.*")
    words = F.split("text", " ")
    parts = (whole.filter(F.size(words) >= 8)
             .select("family", words.alias("w"), F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in
                                                                     ((0, 2), (1, 2), (0, 3), (1, 3), (2, 3))))).alias("p"))
             .select("family", F.array_join(F.slice("w", (F.size("w") * F.col("p.a") / F.col("p.b")).cast("int") + 1,
                                                     (F.size("w") / F.col("p.b")).cast("int")), " ").alias("text")))
    return whole.withColumn("whole", F.lit(True)).unionAll(parts.withColumn("whole", F.lit(False)))


class Model:
    """Weights by n-gram, intercepts, threshold."""

    def __init__(self, weights: DataFrame, intercepts: list[float], threshold: float) -> None:
        self.weights, self.intercepts, self.threshold = weights, intercepts, threshold


def scores(lines: DataFrame, weights: DataFrame, intercepts: list[float], keys: list[str]) -> DataFrame:
    """Of ``lines(*keys, n, grams)``: ``keys`` with ``p`` (probability by family) and ``share`` (of the n-grams, those of the family's notices).

    Only n-grams of the model leave the scan; a paragraph without any is background and has no row."""
    n = len(intercepts)
    rows = lines.select(*keys, F.col("n").alias("_n"), F.explode("grams").alias("gram")).join(weights, "gram")
    sums = rows.groupBy(*keys).agg(F.first("_n").alias("_n"), *(F.sum(F.get("w", F.lit(i))).alias(f"w{i}") for i in range(n)),
                                   *(F.sum(F.get("own", F.lit(i))).alias(f"o{i}") for i in range(1, n)))
    e = F.array(*(F.exp(F.least(F.col(f"w{i}") + F.lit(b), F.lit(300.0))) for i, b in enumerate(intercepts)))
    sums = sums.withColumn("e", e).withColumn("total", F.aggregate("e", F.lit(0.0), lambda a, x: a + x))
    return sums.select(*keys, F.transform("e", lambda x: x / F.col("total")).alias("p"),
                       F.array(F.lit(0.0), *(F.col(f"o{i}") / F.col("_n") for i in range(1, n))).alias("share"))


def told_notices(spark: SparkSession) -> DataFrame:
    """The notices with their n-grams."""
    return notices(spark).withColumn("grams", ngrams(F.col("text"))).withColumn("id", F.monotonically_increasing_id())


def train(docs: DataFrame, seen: DataFrame | None = None) -> Model:
    """Fit and calibrate on every distinct paragraph of the corpus: one half (by a hash of the paragraph) is
    fitted, the other gives the threshold.  Paragraphs of one feature set are one weighted row of the fit,
    those without features one row together.  A paragraph that holds most of a notice is no background.
    ``seen`` is ``marked(docs, own_grams(...))`` if the caller has it."""
    spark = docs.sparkSession
    n = len(FAMILIES)
    told = told_notices(spark)
    own = own_grams(told)
    seen = marked(docs, own) if seen is None else seen
    held = F.col("h") % 2 == 0
    # every distinct paragraph counts, also those without any n-gram of a notice: by their hashes only
    text = F.explode(split_paragraphs(F.col("text"))).alias("text")
    hashes = docs.select(text).filter(F.length("text") > 3).select(F.xxhash64("text", F.lit(11)).alias("h")).distinct()
    every = hashes.agg(F.count("h").alias("all"), F.count_if(held).alias("held")).first()
    distinct = stage(seen.filter(~F.col("short")).select("h", "n", "grams").dropDuplicates(["h"]), "licence-background")
    known = distinct.select("h", "n", F.explode("grams").alias("gram")).join(F.broadcast(own), "gram")
    like = stage(known.select("h", "n", F.explode("families").alias("family")).groupBy("h", "n", "family").count()
                 .filter(F.col("count") >= CONFIRM * F.col("n")).select("h").distinct(), "licence-like")
    background = distinct.join(like, "h", "left_anti")
    less = like.agg(F.count("h").alias("all"), F.count_if(held).alias("held")).first()
    total, of_threshold = max(1, every["all"] - less["all"]), every["held"] - less["held"]
    of_fit = every["all"] - less["all"] - of_threshold
    common = (background.select(F.explode("grams").alias("gram")).groupBy("gram").count()
              .filter(F.col("count") > COMMON * total).select("gram"))
    features = stage(own.join(common, "gram", "left_anti"), "licence-features")
    grams = [r.gram for r in features.select("gram").orderBy("gram").collect()]  # bounded by the notices
    if not grams:
        return Model(features.select("gram", F.array().cast("array<double>").alias("w"), F.array().cast("array<double>").alias("own")), [0.0] * n, 1.0)
    # equal feature sets are one row, as often as they occur; the paragraphs without a feature are one row, too
    chosen = F.broadcast(features.select("gram"))
    sets = (background.filter(~held).select("h", F.explode("grams").alias("gram")).join(chosen, "gram")
            .groupBy("h").agg(F.sort_array(F.collect_list("gram")).alias("grams")).groupBy("grams").agg(F.count("*").alias("times")))
    sets = stage(sets, "licence-sets")
    without = of_fit - (sets.agg(F.sum("times")).first()[0] or 0)
    rows = sets.select(F.lit(0.0).alias("label"), "grams", F.col("times").cast("double").alias("weight"))
    if without > 0:
        rows = rows.unionAll(spark.range(1).select(F.lit(0.0), F.array().cast("array<bigint>"), F.lit(float(without))))
    rows = rows.unionAll(told.select(F.col("family").cast("double"), "grams", F.lit(total / 2 / 100)))
    vectors = CountVectorizerModel.from_vocabulary([str(g) for g in grams], inputCol="words", outputCol="features", binary=True)
    rows = vectors.transform(rows.withColumn("words", F.col("grams").cast("array<string>"))).select("label", "features", "weight")
    fitted = LogisticRegression(family="multinomial", regParam=REGULARISATION, elasticNetParam=L1_SHARE, weightCol="weight",
                                standardization=False, maxIter=50).fit(stage_vectors(rows))
    matrix, intercepts = fitted.coefficientMatrix.toArray(), [float(x) for x in fitted.interceptVector]
    kept = [i for i in range(len(grams)) if abs(matrix[:, i]).max() > 1e-9]
    # one literal: hundreds of literal rows would take the planner longer than the fit
    table = F.from_json(F.lit(json.dumps([{"gram": str(grams[i]), "w": [float(x) for x in matrix[:, i]]} for i in kept])),
                        "array<struct<gram: string, w: array<double>>>")
    learnt = spark.range(1).select(F.explode(table).alias("r")).select(F.col("r.gram").cast("long").alias("gram"), "r.w") if kept else None
    marks = features.select("gram", F.array(*(F.array_contains("families", F.lit(i)).cast("double") for i in range(n))).alias("own"))
    zero = F.array_repeat(F.lit(0.0), n)
    weights = marks.join(learnt, "gram", "left").select("gram", F.coalesce("w", zero).alias("w"), "own") if kept else \
        marks.select("gram", zero.alias("w"), "own")
    weights = stage(weights, "licence-weights")
    # the highest belief that a paragraph is no background among background not fitted on, but for FALSE_RATE of it
    unfitted = scores(background.filter(held), weights, intercepts, ["h"])
    most = unfitted.select((1 - F.get("p", F.lit(0))).alias("p")).orderBy(F.desc("p")).limit(int(FALSE_RATE * of_threshold) + 1).agg(F.min("p")).first()[0]
    return Model(weights, intercepts, min(0.99, max(0.5, most or 0.0)))


def stage_vectors(rows: DataFrame) -> DataFrame:
    """Training rows written once: the fit reads them many times."""
    return stage(rows, "licence-rows")


def scan(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """``(doc_id, paragraph, family, probability, template_share, confirmed)`` of the paragraphs that are
    licence notices by the calibrated threshold.

    Null and empty texts have no paragraphs; a text is scanned whole, each paragraph by itself; repeated
    rows are each reported; of families of one probability the first in the alphabet counts; null
    ids are reported with a null id; other columns are ignored.
    """
    docs = docs.select("doc_id", "text")
    seen = marked(docs, model.weights if model else own_grams(told_notices(docs.sparkSession)))
    model = model or train(docs, seen)
    # the weights (a few rows for each notice) are of a size that the notices bound
    found = scores(seen, F.broadcast(model.weights), model.intercepts, ["row", "doc_id", "paragraph"])
    best = F.array_max(F.slice("p", 2, len(FAMILIES) - 1))
    found = found.withColumn("best", best).filter(1 - F.get("p", F.lit(0)) >= model.threshold)
    found = found.withColumn("at", F.array_position(F.slice("p", 2, len(FAMILIES) - 1), F.col("best")).cast("int"))
    sure = (F.col("best") >= model.threshold) & (F.col("at") != FAMILIES.index("unknown"))
    names = F.array(*(F.lit(x) for x in FAMILIES))
    return found.select("doc_id", "paragraph", F.when(sure, F.get(names, F.col("at"))).otherwise("unknown").alias("family"),
                        F.when(sure, F.col("best")).otherwise(1 - F.get("p", F.lit(0))).alias("probability"),
                        F.get("share", F.col("at")).alias("template_share"),
                        (sure & (F.get("share", F.col("at")) >= CONFIRM)).alias("confirmed"))
