"""Licence templates, selection and scores against plain versions."""

import random
import textwrap
from math import ceil

import numpy as np
from pyspark.ml.feature import HashingTF

from foldspar.llm import licenses
from foldspar.llm.common import about

MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"""
BSD = "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"""
GPL = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
MPL = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."


def test_a_confirmable_part_holds_a_needed_bigram():
    needed = set(licenses._needed(licenses.MIN_SIMILARITY))
    rng = random.Random(1)
    for some in licenses.TEMPLATES.values():
        for text in some:
            pairs = licenses._bigrams(text)
            least = ceil(licenses.MIN_SIMILARITY * len(pairs) - 1e-9)
            assert all(needed & set(pairs[k : k + least]) for k in range(len(pairs) - least + 1))
            assert all(needed & set(rng.sample(pairs, least)) for _ in range(50)) and len(pairs) < licenses.STRETCH


def test_published_notices_wrapped_and_not(spark):
    cases = [("mit", MIT), ("bsd", BSD), ("apache", APACHE), ("gpl", GPL), ("mpl", MPL)]
    rows, want = [], {}
    for family, text in cases:
        words = text.split()
        for part in (words, words[1:], words[: int(len(words) * 0.75)]):
            for width in (10_000, 72):
                for mark in ("", " * ", "# "):
                    want[len(rows)] = family
                    rows.append((len(rows), "Some prose comes first.\n\n" + "\n".join(mark + x for x in textwrap.wrap(" ".join(part), width)) + "\n\nMore prose after it.", 1, "x", 2.0))
    like = ["The MIT license and the Apache license were compared in the lecture on copyright.", "He said the software was provided as is, with no warranty, by the seller.", "Redistribution of wealth is permitted, the minister said, with or without modification of the law.", "You may obtain a copy of the book at the office."]
    rows += [(1000 + k, x, 1, "x", 2.0) for k, x in enumerate(like)] + [(None, MIT, 1, "x", 2.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, label int, words string, probability double")
    found = {}
    for r in licenses.scan(df).where("confirmed").collect():
        found.setdefault(r.doc_id, set()).add(r.family)
    assert {i: f for i, f in want.items() if f not in found.get(i, ())} == {} and not any(i in found for i in range(1000, 1004)) and "mit" in found[None]


def test_probabilities_against_plain_dot_products(spark):
    model = licenses.Classifier.fit(spark.createDataFrame([(1, MIT)], "doc_id long, text string"))
    texts = [MIT, GPL, "He lost his driving license.", "x"]
    rows = model.scored(spark.createDataFrame([(t,) for t in texts], "t string").select("t", licenses.tokens(licenses.F.col("t")).alias("words"))).collect()
    place = HashingTF(numFeatures=licenses.FEATURES).indexOf
    coefficients, intercepts = model.model.coefficientMatrix.toArray(), model.model.interceptVector.toArray()
    for r in rows:
        w = r.words
        at = sorted({place(x) for x in [*w, *(f"{a} {b}" for a, b in zip(w, w[1:], strict=False))]})
        x = np.zeros(licenses.FEATURES)
        x[at] = 1 / np.sqrt(len(at))
        e = np.exp((m := coefficients @ x + intercepts) - m.max())
        assert np.allclose(r.probability, e / e.sum(), atol=1e-9)


def test_samples_keep_their_bounds(spark):
    df = spark.range(20_000)
    for most in (5, 500, 6000):
        n = df.where(about(most, 20_000, "id")).count()
        assert abs(n - most) < 5 * most**0.5 + 1
    assert df.where(about(30_000, 20_000, "id")).count() == 20_000
    assert "1099511627" in str(about(10**3, 10**6, "id"))  # the share is kept exactly enough for 10^15 rows


def test_every_document_trains_and_calibrates(spark):
    docs = spark.range(3000).selectExpr("id doc_id", "concat('The licence number ', id, ' was sold at the fair in town ', id * 7, '.') text")
    assert licenses._background(licenses.paragraphs(docs)).count() == 3000
    # a kind that no bounded share of documents would show: the threshold follows each held out paragraph
    fitted = licenses.Classifier.fit(docs, false_rate=0.0)
    known = 1 - licenses.F.get("probability", licenses.F.lit(0))
    held = licenses._background(licenses.paragraphs(docs)).where("pmod(h, 2) = 1")
    top = fitted.scored(held).agg(licenses.F.max(known).alias("top")).first().top
    assert held.count() > 1000 and abs(fitted.threshold - min(0.9, max(0.5, top))) < 1e-5
