"""License scans: a sparse word n-gram logistic regression names the licence family of a paragraph, templates confirm it.

DataFrame and ML pipeline functions only. Every line with a word is judged, and every run of lines between blank ones
as a whole, so a notice may be wrapped. Words that stand in no template and no vocabulary entry are in no n-gram that
counts, so they are dropped before n-grams are built: the scores are those of all n-grams.
"""

from __future__ import annotations

import random
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import texts

#: Paragraphs of public licences and of the notices that refer to them, by family.
TEMPLATES = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
        "Licensed to the Apache Software Foundation (ASF) under one or more contributor license agreements. See the NOTICE file distributed with this work for additional information regarding copyright ownership.",
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
        "Grant of Copyright License. Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form.",
        "Grant of Patent License. Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable (except as stated in this section) patent license to make, have made, use, offer to sell, sell, import, and otherwise transfer the Work.",
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "MIT": (
        "Released under the MIT License.",
        "This project is licensed under the MIT License.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
        "SPDX-License-Identifier: MIT",
    ),
    "ISC": (
        "Licensed under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
        "SPDX-License-Identifier: ISC",
    ),
    "GPL": (
        "You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        "Licensed under the GNU General Public License.",
        "The GNU General Public License is a free, copyleft license for software and other kinds of works.",
    ),
    "GPL-2.0": (
        "Licensed under the GNU GPL, version 2 or any later version.",
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU General Public License along with this program; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA.",
        "SPDX-License-Identifier: GPL-2.0-only",
        "SPDX-License-Identifier: GPL-2.0-or-later",
    ),
    "GPL-3.0": (
        "Licensed under the GNU GPL, version 3 or any later version.",
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: GPL-3.0-only",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ),
    "LGPL": (
        "Licensed under the GNU Lesser General Public License, version 2.1.",
        "Licensed under the GNU LGPL, version 3.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
        "You should have received a copy of the GNU Lesser General Public License along with this library.",
        "SPDX-License-Identifier: LGPL-2.1-only",
        "SPDX-License-Identifier: LGPL-3.0-or-later",
    ),
    "AGPL": (
        "Licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU Affero General Public License along with this program.",
        "SPDX-License-Identifier: AGPL-3.0-only",
    ),
    "BSD": (
        "Released under the BSD 3-Clause License.",
        "Licensed under the 2-clause BSD license.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
        "SPDX-License-Identifier: BSD-3-Clause",
        "SPDX-License-Identifier: BSD-2-Clause",
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
        "Licensed under the Mozilla Public License, version 2.0.",
        'This Source Code Form is "Incompatible With Secondary Licenses", as defined by the Mozilla Public License, v. 2.0.',
        "SPDX-License-Identifier: MPL-2.0",
    ),
    "EPL": (
        "Licensed under the Eclipse Public License 2.0.",
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
        "All rights reserved. This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution.",
        "SPDX-License-Identifier: EPL-2.0",
    ),
    "BSL-1.0": (
        "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at https://www.boost.org/LICENSE_1_0.txt)",
        'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so.',
        "The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.",
        "SPDX-License-Identifier: BSL-1.0",
    ),
    "Zlib": (
        "Licensed under the zlib license.",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
        "The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.",
        "Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.",
        "SPDX-License-Identifier: Zlib",
    ),
    "CC-BY": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "To view a copy of this license, visit http://creativecommons.org/licenses/by/4.0/ or send a letter to Creative Commons, PO Box 1866, Mountain View, CA 94042, USA.",
        "SPDX-License-Identifier: CC-BY-4.0",
    ),
    "CC-BY-SA": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Text is available under the Creative Commons Attribution-ShareAlike License; additional terms may apply.",
        "SPDX-License-Identifier: CC-BY-SA-4.0",
    ),
    "CC-BY-NC": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-NC-4.0",
    ),
    "Public-Domain": (
        "This work is dedicated to the public domain under CC0 1.0 Universal.",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work; it is in the public domain.",
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors.",
        "SPDX-License-Identifier: CC0-1.0",
        "SPDX-License-Identifier: Unlicense",
    ),
    "Proprietary": (
        "All rights reserved.",
        "Copyright the authors. All rights reserved.",
        "No part of this publication may be reproduced, distributed, or transmitted in any form or by any means without the prior written permission of the publisher.",
        "No part of this publication may be reproduced without prior written permission of the copyright holder.",
        "This software is the confidential and proprietary information of the company. You shall not disclose such confidential information and shall use it only in accordance with the terms of the license agreement.",
    ),
}
#: Paragraphs that use the same words for something else.
UNKNOWN = (
    "You need a driving license to drive a car in this country.",
    "The right to vote is one of the civil rights of every citizen.",
    "She asked for permission to leave the room and went home.",
    "The software was released last week and the version works well.",
    "Version 2.0 of the program was slower than version 3.",
    "A fishing license costs more under the new general law.",
    "The public library opens at nine and the park is open to the public.",
    "The general public was free to use the source of the river.",
    "Copyright law protects works of art; a court decided on copyright in music.",
    "The restaurant lost its license after an inspection.",
    "The warranty covers parts and labor for two years.",
    "Her creative work is common in the city and the terms were clear.",
    "Apache is a people, and Mozilla is a browser maker.",
    "The agency may license the drug without further permission.",
)
#: Paragraphs of the same kind that the fit doesn't see: a part of the calibration.
HELD_OUT = (
    "He renewed his driving license and the fee was general knowledge.",
    "With your permission we will start the meeting at nine.",
    "The museum asked about copyright for the photographs in its public rooms.",
    "All civil rights are reserved for citizens, said the mayor.",
    "The library is free and the source of the text is unknown.",
    "A hunting license, version for adults, is sold under the old law.",
    "The software is used by the public and by the authors of the work.",
    "The license plate of the car was covered with snow.",
)
UNKNOWN_LABEL = "unknown"


@dataclass(frozen=True)
class Scanner:
    """A fitted classifier, the words that its n-grams and the templates have, and the calibration.

    slope and offset turn the log odds of the likeliest family into the probability that it is right; error is the
    share of wrong answers on the held-out paragraphs that set them, held_out their number.
    """

    model: PipelineModel
    words: tuple[str, ...]
    slope: float
    offset: float
    error: float
    held_out: int


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}.]+|\.(?![0-9])"), "")


def _grams(own: str, n: int) -> Column:
    """n-grams of a column of words in which null words are in none."""
    at = F.when(F.size(own) >= n, F.sequence(F.lit(0), F.size(own) - n))
    gram = F.transform(at, lambda i: F.concat(*(part for k in range(n) for part in ([F.lit(" ")] if k else []) + [F.get(own, i + k)])))
    return F.coalesce(F.filter(gram, lambda g: g.isNotNull()), F.array().cast("array<string>"))


def ngrams(own: str, sizes=(1, 2, 3)) -> Column:
    """Distinct n-grams of a column of words."""
    return F.array_distinct(F.concat(*(_grams(own, n) for n in sizes)))


def _variants(notice: str, rng: random.Random) -> list[str]:
    """The notice alone and as people write it: with words before and after, shouted, cut short, with words left out."""
    own = notice.split()
    out = [notice, f"Copyright 20{rng.randrange(10, 30)} Some Author. {notice}", notice.upper(), f"Note. {notice} See the file for details.", f"* {notice} *"]
    if len(own) > 8:
        for _ in range(3):
            out.append(" ".join(w for w in own if rng.random() > 0.08))
        out += [" ".join(own[: len(own) * 3 // 4]), " ".join(own[len(own) // 4 :])]
    return out


def _examples() -> list[tuple[str, str, bool]]:
    """(family, paragraph, held out): variants of the templates and paragraphs of the unknown class."""
    rng = random.Random(2026)
    rows = [(family, v, k % 3 == 2) for family, notices in TEMPLATES.items() for notice in notices for k, v in enumerate(_variants(notice, rng))]
    rows += [(UNKNOWN_LABEL, t, False) for t in UNKNOWN for _ in range(4)]
    return rows + [(UNKNOWN_LABEL, t, True) for t in HELD_OUT]


def _template_grams(spark: SparkSession) -> DataFrame:
    """family and templates: for each template its pairs and triples of words."""
    rows = [(family, k, notice) for family, notices in TEMPLATES.items() for k, notice in enumerate(notices)]
    own = spark.createDataFrame(rows, "family string, number int, notice string").select("family", "number", words(F.col("notice")).alias("words"))
    own = own.select("family", F.struct("number", ngrams("words", (2, 3)).alias("grams")).alias("t"))
    return own.groupBy(F.col("family").alias("t_family")).agg(F.transform(F.array_sort(F.collect_list("t")), lambda t: t["grams"]).alias("templates"))


def _overlap(templates: Column, grams: Column) -> Column:
    """The greatest share that a template has of its pairs and triples among the grams; 0 without templates."""
    return F.coalesce(F.array_max(F.transform(templates, lambda t: F.size(F.array_intersect(t, grams)) / F.size(t))), F.lit(0.0))


def _scored(model: PipelineModel, df: DataFrame) -> DataFrame:
    """df (with grams) with guess, the likeliest family, and x, its log odds, bounded where they are certain."""
    labels = model.stages[0].labels
    unknown = labels.index(UNKNOWN_LABEL)
    own = model.stages[2].transform(model.stages[1].transform(df)).withColumn("p", vector_to_array("probability"))
    family = F.transform("p", lambda p, i: F.when(i == unknown, -1.0).otherwise(p))
    own = own.withColumn("family_p", family).withColumn("best", F.array_max("family_p"))
    best = F.least(F.greatest(F.col("best"), F.lit(1e-9)), F.lit(1 - 1e-9))
    return own.select(*df.columns, F.get(F.array(*map(F.lit, labels)), (F.array_position("family_p", F.col("best")) - 1).cast("int")).alias("guess"), F.ln(best / (1 - best)).alias("x"))


def units(text: str) -> Column:
    """The lines of a column of texts, and the runs of several lines between lines without a letter or digit.

    Both patterns only repeat single characters, possessively: Java matches those by a loop, of any length.
    """
    bare = F.regexp_replace(text, r"(?md)^[^\p{L}\p{N}\n]++$", "")
    runs = F.filter(F.split(bare, r"\n{2,}+"), lambda t: t.contains("\n"))
    return F.concat(F.split(text, "\n"), runs)


def train(spark: SparkSession, documents: DataFrame | None = None, labels: DataFrame | None = None, max_documents: int = 100, max_overlap: float = 0.1, min_overlap: float = 0.6) -> Scanner:
    """The classifier and its calibration, from the templates and the lines of a bounded sample of labelled rows.

    The sample is of the max_documents documents that come first by a hash of doc_id among those that are labelled.
    Its lines are of the unknown class if no template has max_overlap of its word pairs and triples in them; the
    others are left out. A third of the variants of each template, HELD_OUT and every third line of the sample are
    held out of the fit: a logistic fit on their log odds (Platt scaling) calibrates the probability.
    """
    data = spark.createDataFrame(_examples(), "family string, text string, held boolean")
    templates = F.broadcast(_template_grams(spark))
    if documents is not None and labels is not None:
        sample = labels.where("doc_id is not null").select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_documents)
        own = texts(documents).join(F.broadcast(sample), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text")).limit(max_documents)
        lines = own.select(F.explode(F.array_distinct(F.split("text", "\n"))).alias("text")).select("text", words(F.col("text")).alias("words")).where(F.size("words") > 0)
        flat = templates.agg(F.flatten(F.collect_list("templates")).alias("templates"))
        lines = lines.select("text", ngrams("words", (2, 3)).alias("grams")).crossJoin(F.broadcast(flat)).where(_overlap(F.col("templates"), F.col("grams")) <= max_overlap)
        data = data.unionByName(lines.select(F.lit(UNKNOWN_LABEL).alias("family"), "text", (F.pmod(F.xxhash64("text"), F.lit(3)) == 0).alias("held")))
    data = data.select("family", "held", words(F.col("text")).alias("words")).select("family", "held", ngrams("words").alias("grams")).coalesce(1).cache()
    fit = data.where("not held").select("family", "grams")
    # the vocabulary is that of the template variants: other n-grams would only make it longer
    vector = CountVectorizer(inputCol="grams", outputCol="features", binary=True, minDF=2.0, vocabSize=1 << 12).fit(fit.where(F.col("family") != UNKNOWN_LABEL))
    index = StringIndexer(inputCol="family", outputCol="label", stringOrderType="alphabetAsc").fit(fit)
    field = LogisticRegression(family="multinomial", elasticNetParam=1.0, regParam=0.0005, maxIter=40).fit(vector.transform(index.transform(fit)))
    model = PipelineModel([index, vector, field])
    held = _scored(model, data.where("held").select("family", "grams")).join(templates, F.col("guess") == F.col("t_family"), "left")
    held = held.select("family", "guess", "x", _overlap(F.col("templates"), F.col("grams")).alias("overlap"), (F.col("family") == F.col("guess")).cast("double").alias("label"))
    held = VectorAssembler(inputCols=["x"], outputCol="features").transform(held).cache()
    platt = LogisticRegression(regParam=0.001).fit(held)
    slope, offset = float(platt.coefficients[0]), float(platt.intercept)
    sure = (_calibrated(F.col("x"), slope, offset) >= 0.5) & (F.col("overlap") >= min_overlap)
    error, n = held.agg(F.avg((F.when(sure, F.col("guess")).otherwise(UNKNOWN_LABEL) != F.col("family")).cast("double")), F.count("*")).first()
    held.unpersist()
    data.unpersist()
    single = {w for g in model.stages[1].vocabulary for w in g.split(" ")}
    own = {w for row in spark.createDataFrame([(t,) for ts in TEMPLATES.values() for t in ts], "t string").select(words(F.col("t"))).collect() for w in row[0]}
    return Scanner(model, tuple(sorted(single | own)), slope, offset, error, n)


def _calibrated(x: Column, slope: float, offset: float) -> Column:
    return 1 / (1 + F.exp(-(F.lit(slope) * x + F.lit(offset))))


def scan_paragraphs(df: DataFrame, scanner: Scanner, min_probability: float = 0.5, min_overlap: float = 0.6) -> DataFrame:
    """doc_id, unit (its number), family, guess, probability and overlap of each line and run of lines that has a word.

    guess is the likeliest family, probability the calibrated chance that it is right. family is the guess if the
    probability is min_probability at least and a template of it has min_overlap of its word pairs and triples in
    the unit; else it is unknown. Each unit is scored where it is read; the templates are a fixed list.
    """
    own = texts(df).select("doc_id", F.posexplode(units("text")).alias("unit", "part"))
    own = own.select("doc_id", F.col("unit").cast("long"), words(F.col("part")).alias("words")).where(F.size("words") > 0)
    known = F.transform("words", lambda w: F.when(w.isin(*scanner.words), w))
    own = own.select("doc_id", "unit", known.alias("words")).select("doc_id", "unit", ngrams("words").alias("grams"))
    scored = _scored(scanner.model, own).withColumn("probability", _calibrated(F.col("x"), scanner.slope, scanner.offset))
    likely = F.col("probability") >= min_probability
    # a unit that the classifier leaves out meets no template
    match = scored.join(F.broadcast(_template_grams(df.sparkSession)), likely & (F.col("guess") == F.col("t_family")), "left")
    match = match.withColumn("overlap", _overlap(F.col("templates"), F.col("grams")))
    family = F.when(likely & (F.col("overlap") >= min_overlap), F.col("guess")).otherwise(UNKNOWN_LABEL)
    return match.select("doc_id", "unit", family.alias("family"), "guess", "probability", "overlap")


def scan_licenses(df: DataFrame, scanner: Scanner, min_probability: float = 0.5) -> DataFrame:
    """doc_id, n_units, n_likely, n_confirmed and families (sorted, comma-joined) for each doc_id of df (doc_id, text).

    n_units counts the lines and runs of lines that have a word, n_likely those that the classifier gives a family,
    n_confirmed those that a template confirms; families are of the confirmed (GPL only where no version is). A null text is the empty one. Rows
    that share a doc_id are one document: its units are counted over all of them; a null doc_id groups likewise.
    A text without a word has no unit. An empty table gives an empty result, further columns are ignored.
    """
    found = scan_paragraphs(df, scanner, min_probability)
    none = texts(df).select("doc_id", F.lit(None).cast("string").alias("family"), F.lit(None).cast("double").alias("probability"))
    confirmed = F.col("family") != UNKNOWN_LABEL
    found = found.select("doc_id", "family", "probability").unionByName(none).groupBy("doc_id").agg(
        F.count("family").alias("n_units"),
        F.count_if(F.col("probability") >= min_probability).alias("n_likely"),
        F.count_if(confirmed).alias("n_confirmed"),
        F.array_sort(F.collect_set(F.when(confirmed, F.col("family")))).alias("families"),
    )
    # a line of a wrapped notice names the licence without its version, the whole notice with it
    versions = F.arrays_overlap("families", F.array(F.lit("GPL-2.0"), F.lit("GPL-3.0")))
    families = F.when(versions, F.array_remove("families", "GPL")).otherwise(F.col("families"))
    return found.withColumn("families", F.array_join(families, ","))
