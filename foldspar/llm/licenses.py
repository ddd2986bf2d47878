"""License scans: a trained paragraph classifier with template comparison, in native expressions.

A multinomial logistic regression on hashed word n-grams (sparse vectors, L2-normalised) is trained on the paragraphs of
the templates below, on parts of them, and on other text, which makes the unknown class: sentences that only look like
licences, and of all documents the paragraphs with a cue word that are like no template. (Those without one are scored
only if they are like a template, so they are no examples of it.) Of these paragraphs, each counted once, a half by hash
trains; on the other half, every one of them, the probability from which a family is believed is calibrated, so that at
most a share ``false_rate`` of them would pass. A believed family is
confirmed if the paragraph holds enough of the word bigrams of one of the family's templates.

Two kinds of paragraphs are scored. Lines with a cue word are scored as they are, in windows overlapping by half if they
have more than ``WINDOW`` words. And over the words of the whole text, in windows of ``STRETCH`` words overlapping by half,
one that holds the bigrams it takes to be confirmed is cut to the stretch from the first to the last of them and scored
too, if it goes over line breaks or has no cue, under the stretch's first line and with part numbers of ``WRAPPED`` and
up; so notices may be wrapped, indented or commented. Windows are first selected by bigrams of which every confirmable
stretch holds one. No template is longer than ``STRETCH`` words, and of one that is cut by a window's edge another window
holds over two thirds.

Defined results: null or empty text has no paragraphs and no rows; a null doc_id is an id like others; repeated rows each
give their rows; an empty table gives no rows and the classifier is trained on the fixed sentences alone; other columns
are ignored, whatever their names.
"""

from __future__ import annotations

import re
from math import ceil

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foldspar.llm.common import materialise, text_or_empty

WINDOW, STRETCH = 60, 120
FEATURES = 1 << 13
#: Examples that one task of the training takes.
TASK = 20_000
WRAPPED = 1_000_000
MIN_SIMILARITY = 0.6
#: Paragraphs with less than this share of every template's bigrams are examples of the unknown class.
UNLIKE = 0.3
CUES = "licen[sc]e|copyright|warrant|redistribut|spdx|public domain|all rights reserved"

#: Usual notices of licence families, a paragraph each.
TEMPLATES = {
    "apache": [
        "Licensed under the Apache License, Version 2.0.",
        "This project is licensed under the Apache License 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at',
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
        "Licensed to the Apache Software Foundation (ASF) under one or more contributor license agreements. See the NOTICE file distributed with this work for additional information regarding copyright ownership.",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "mit": [
        "Released under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
        "SPDX-License-Identifier: MIT",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "Licensed under the GNU General Public License, version 2 or later.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        "You should have received a copy of the GNU General Public License along with this program. If not, see",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "SPDX-License-Identifier: GPL-2.0-only",
    ],
    "lgpl": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
    ],
    "agpl": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU Affero General Public License along with this program. If not, see",
        "SPDX-License-Identifier: AGPL-3.0-only",
    ],
    "cc-by-nc": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.",
    ],
    "cc-by": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "This article is distributed under the terms of the Creative Commons Attribution 4.0 International License, which permits unrestricted use, distribution, and reproduction in any medium, provided you give appropriate credit to the original author(s) and the source, provide a link to the Creative Commons license, and indicate if changes were made.",
    ],
    "cc-by-sa": [
        "Licensed under CC BY-SA 4.0, Creative Commons Attribution-ShareAlike license.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Text is available under the Creative Commons Attribution-ShareAlike License; additional terms may apply.",
    ],
    "public-domain": [
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        "SPDX-License-Identifier: CC0-1.0",
    ],
    "bsd": [
        "Licensed under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.',
        "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "isc": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.',
        "SPDX-License-Identifier: ISC",
    ],
    "mpl": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at",
        "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "boost": [
        "Distributed under the Boost Software License, Version 1.0.",
        "SPDX-License-Identifier: BSL-1.0",
    ],
    "zlib": [
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    ],
    "epl": [
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at",
        "SPDX-License-Identifier: EPL-2.0",
    ],
    "proprietary": [
        "All rights reserved.",
        "Copyright. All rights reserved. No part of this publication may be reproduced without prior written permission.",
        "No part of this publication may be reproduced, distributed, or transmitted in any form or by any means, including photocopying, recording, or other electronic or mechanical methods, without the prior written permission of the publisher.",
        "This software is proprietary and confidential; unauthorized copying is prohibited without a license agreement.",
    ],
}
#: Sentences with cue words that grant nothing.
OTHERS = [
    "He renewed his driving license at the office in May.",
    "The fishing license costs twelve pounds a year.",
    "Her lecture on the history of copyright law was well attended.",
    "The court found that the copyright had expired long ago.",
    "The washing machine came with a two year warranty.",
    "A search warrant was issued on Tuesday.",
    "The council plans to redistribute the funds among the schools.",
    "The pub lost its licence after the fight.",
    "Poets take licence with grammar, and so did she.",
    "The licensed premises close at eleven.",
    "You need a license to keep such a dog in this town.",
    "The minister warranted no further comment on the report.",
    "Most open source projects choose the MIT license or the Apache license these days.",
    "The article compares the GNU General Public License with permissive licenses.",
    "Lawyers argued for years about what the GPL means for linked programs.",
    "The company changed the license of its database last year, and users complained.",
    "The singer reserved all rights to her early recordings in a settlement.",
    "Works enter the public domain seventy years after the death of the author.",
    "Please check the license before you use the pictures.",
    "The students learned which license fits which kind of software.",
    "Creative Commons was founded in 2001 and offers several licenses.",
    "The extended warranty covers parts and labour but not the battery.",
]
FAMILIES = ["unknown", *TEMPLATES]


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}0-9]+(?:[.\-][\p{L}0-9]+)*"), F.lit(0))


def _grams(w: Column) -> Column:
    pairs = F.transform(F.slice(w, 2, 2**30), lambda x, i: F.concat(F.get(w, i), F.lit(" "), x))
    return F.concat(w, pairs)


def paragraphs(docs: DataFrame) -> DataFrame:
    """doc_id, paragraph (number of the line), part (number of the window) and words of paragraphs with a cue."""
    cue = f"(?i){CUES}"
    lines = docs.select("doc_id", text_or_empty().alias("text")).where(F.col("text").rlike(cue)).select("doc_id", F.posexplode(F.split("text", "\n")).alias("paragraph", "line"))
    rows = lines.where(F.col("line").rlike(cue)).select("doc_id", F.col("paragraph").cast("long").alias("paragraph"), tokens(F.col("line")).alias("w"))
    starts = F.when(F.size("w") <= WINDOW, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.size("w") - WINDOW // 2 - 1, F.lit(WINDOW // 2)))
    rows = rows.select("doc_id", "paragraph", "w", F.posexplode(starts).alias("part", "at"))
    rows = rows.select("doc_id", "paragraph", F.col("part").cast("long").alias("part"), F.slice("w", F.col("at") + 1, WINDOW).alias("words"))
    return rows.where(F.array_join("words", " ").rlike(cue))


def _bigrams(text: str) -> list[str]:
    """The distinct bigrams of a template, in the same words as tokens() gives."""
    w = re.findall(r"[^\W_]+(?:[.\-][^\W_]+)*", text.lower())
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(w, w[1:], strict=False)))


def _strings(some: list[str]) -> str:
    """SQL for an array of plain strings."""
    return "array(" + ",".join(f"'{x}'" for x in some) + ")"


def _templates() -> Column:
    """Literal array of (family, grams), one for each template."""
    return F.expr("array(" + ",".join(f"named_struct('family','{k}','grams',{_strings(_bigrams(x))})" for k, some in TEMPLATES.items() for x in some) + ")")


def _share(grams: Column, pairs: Column) -> Column:
    return F.size(F.array_intersect(grams, pairs)) / F.size(grams)


def _needed(least: float) -> list[str]:
    """Bigrams (the ones with the longest words) of which every stretch with the share least of a template's holds one."""
    out: set[str] = set()
    for some in TEMPLATES.values():
        for text in some:
            pairs = sorted(_bigrams(text), key=lambda x: (-max(map(len, re.split("[ .-]", x))), x))
            out |= set(pairs[: len(pairs) - ceil(least * len(pairs) - 1e-9) + 1])
    return sorted(out)


def wrapped(docs: DataFrame, least: float = MIN_SIMILARITY) -> DataFrame:
    """Like paragraphs: the stretches over line breaks, or without a cue, that hold the share least of a template's bigrams."""
    needed = _needed(least)
    # a text that holds one of them holds its longest run of letters or digits between other signs
    longest = sorted({max(re.split("[ .-]", x), key=len) for x in needed})
    runs = F.split(F.lower("text"), r"[^\p{L}0-9]+")
    some = docs.select("doc_id", text_or_empty().alias("text")).where(F.arrays_overlap(runs, F.expr(_strings(longest))))
    # a word broken at its hyphen goes to the first of the two lines whole
    whole = F.regexp_replace("text", r"(?<=[\p{L}0-9]-)\r?\n[\t *#/;]*([\p{L}0-9]+)", "$1\n")
    lines = F.transform(F.split(whole, "\n"), lambda x, i: F.transform(tokens(x), lambda y: F.struct(y.alias("word"), i.alias("line"))))
    rows = some.select("doc_id", F.flatten(lines).alias("w")).where(F.size("w") > 1)
    starts = F.when(F.size("w") <= STRETCH, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.size("w") - STRETCH // 2 - 1, F.lit(STRETCH // 2)))
    rows = rows.select("doc_id", F.posexplode(F.transform(starts, lambda at: F.slice("w", at + 1, STRETCH))).alias("part", "w"))
    rows = rows.withColumn("p", _pairs(F.col("w.word"))).where(F.arrays_overlap("p", F.expr(_strings(needed))))
    held = F.filter(_templates(), lambda t: _share(t["grams"], F.col("p")) >= least)
    rows = rows.select("doc_id", "part", "w", "p", F.explode(F.transform(held, lambda t: t["grams"])).alias("g"))
    rows = rows.withColumn("marks", F.transform("p", lambda x: F.array_contains(F.col("g"), x)))
    rows = rows.withColumn("first", F.array_position("marks", True)).withColumn("last", F.size("p") + 1 - F.array_position(F.reverse("marks"), True))
    rows = rows.select("doc_id", "part", F.slice("w", F.col("first").cast("int"), (F.col("last") - F.col("first") + 2).cast("int")).alias("w"))
    line = lambda k: F.element_at("w", k)["line"]
    rows = rows.where((line(1) < line(-1)) | ~F.array_join("w.word", " ").rlike(f"(?i){CUES}"))
    return rows.select("doc_id", line(1).cast("long").alias("paragraph"), (F.col("part") + WRAPPED).cast("long").alias("part"), F.col("w.word").alias("words"))


def _labelled(spark: SparkSession) -> DataFrame:
    """Templates, and the first and last parts of long ones, with the family's number; the other sentences with 0."""
    pairs = [(FAMILIES.index(k), x) for k, some in TEMPLATES.items() for x in some] + [(0, x) for x in OTHERS]
    lits = F.array(*[F.struct(F.lit(float(k)).alias("label"), F.lit(x).alias("line")) for k, x in pairs])
    rows = spark.range(1).select(F.explode(lits).alias("r")).select("r.*").withColumn("w", tokens(F.col("line")))
    n = F.size("w")
    parts = F.array(F.col("w"), F.slice("w", 1, F.floor(n * 0.7).cast("int")), F.slice("w", F.floor(n * 0.3).cast("int") + 1, n))
    cuts = F.when(n >= 12, parts).otherwise(F.array("w"))
    return rows.select("label", F.explode(cuts).alias("words"))


def _background(cued: DataFrame) -> DataFrame:
    """Distinct paragraphs (words, their hash h) of those with a cue that are like no template."""
    some = cued.select("words").distinct()
    some = some.where(F.array_max(F.transform(_templates(), lambda t: _share(t["grams"], _pairs(F.col("words"))))) < UNLIKE)
    return some.withColumn("h", F.xxhash64("words"))


class Classifier:
    """The fitted model, its threshold, and scoring."""

    def __init__(self, model: LogisticRegressionModel, threshold: float = 0.5):
        self.model, self.threshold = model, threshold

    @staticmethod
    def vectors(rows: DataFrame) -> DataFrame:
        tf = HashingTF(inputCol="__lic_g", outputCol="__lic_t", numFeatures=FEATURES, binary=True)
        return Normalizer(inputCol="__lic_t", outputCol="__lic_features").transform(tf.transform(rows.withColumn("__lic_g", _grams(F.col("words"))))).drop("__lic_g", "__lic_t")

    @classmethod
    def fit(cls, docs: DataFrame, false_rate: float = 0.002, cued: DataFrame | None = None) -> Classifier:
        """The unknown class is trained and calibrated on all of docs; cued is paragraphs(docs), if it is at hand."""
        spark = docs.sparkSession
        background = materialise(_background(paragraphs(docs) if cued is None else cued), "license-background")
        half = F.pmod(F.col("h"), F.lit(2))
        train = _labelled(spark).unionByName(background.where(half == 0).select(F.lit(0.0).alias("label"), "words"))
        counts = F.count(F.lit(1))
        # all unknown paragraphs together weigh as much as the examples of the families
        n = train.agg(counts.alias("n"), F.count_if(F.col("label") == 0).alias("unknown")).first()
        train = train.withColumn("weight", F.when(F.col("label") == 0, min(1.0, (n["n"] - n["unknown"]) / max(1, n["unknown"]))).otherwise(1.0))
        fitter = LogisticRegression(featuresCol="__lic_features", family="multinomial", regParam=2e-4, maxIter=30, weightCol="weight", standardization=False)
        tasks = ceil(n["n"] / TASK)  # sums of one task come in one order
        out = cls(fitter.fit(materialise(cls.vectors(train).repartition(tasks, "words") if tasks > 1 else cls.vectors(train).coalesce(1), "license-training")))
        known = 1 - F.get("probability", F.lit(0))
        top = out.scored(background.where(half == 1)).agg(F.percentile(F.round(known, 5), 1 - false_rate).alias("q")).first()["q"]
        out.threshold = min(0.9, max(0.5, top or 0.0))
        return out

    def scored(self, rows: DataFrame) -> DataFrame:
        out = self.model.setProbabilityCol("__lic_p").transform(self.vectors(rows))
        return out.withColumn("probability", vector_to_array("__lic_p")).drop("__lic_p", "rawPrediction", "prediction", "__lic_features")


def _similarity(family: Column, words: Column) -> Column:
    """Largest share of a template's bigrams in words, over the templates of that family."""
    own = F.filter(_templates(), lambda t: t["family"] == family)
    return F.array_max(F.transform(own, lambda t: _share(t["grams"], _pairs(words))))


def _pairs(w: Column) -> Column:
    return F.transform(F.slice(w, 2, 2**30), lambda x, i: F.concat(F.get(w, i), F.lit(" "), x))


def scan(docs: DataFrame, min_similarity: float = MIN_SIMILARITY, **fitting) -> DataFrame:
    """A row for each paragraph (window) with a cue and each wrapped stretch: doc_id, paragraph, part, family, probability, similarity, confirmed.

    family is the likeliest one, or unknown if it isn't believed; confirmed is true if it is believed and similar enough
    to a template of it.
    """
    cued = materialise(paragraphs(docs), "license-paragraphs")
    fitted = Classifier.fit(docs, cued=cued, **fitting)
    rows = fitted.scored(cued.unionByName(wrapped(docs, min_similarity)))
    known = F.slice("probability", 2, len(FAMILIES))
    rows = rows.withColumn("best", F.array_max(known)).withColumn("likeliest", F.element_at(F.array(*[F.lit(x) for x in TEMPLATES]), F.array_position(known, F.col("best")).cast("int")))
    rows = rows.withColumn("similarity", _similarity(F.col("likeliest"), F.col("words")))
    believed = F.coalesce(1 - F.get("probability", F.lit(0)) >= fitted.threshold, F.lit(False))
    return rows.select(
        "doc_id", "paragraph", "part", F.when(believed, F.col("likeliest")).otherwise("unknown").alias("family"),
        F.round("best", 6).alias("probability"), "similarity", (believed & (F.col("similarity") >= min_similarity)).alias("confirmed"),
    )
