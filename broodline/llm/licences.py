"""Licence scan: a trained paragraph classifier, confirmed against templates.

A paragraph is a line, together with the lines it goes on in: those that begin with a
small letter or a bracket behind one without a full stop, comment marks left out.
Every paragraph is turned into word 1-, 2- and 3-grams; words that occur
in no n-gram with a weight and in no template cannot change a result, so runs of
them become one mark first. A logistic regression with an L1 share, so with
sparse weights, names the licence family or none; it is trained here on
paragraphs made from the sentences and names below by rule. A threshold on the
probability, set on notices and whole families that training did not see, makes
everything less certain ``unknown``. A prediction is confirmed if one of the family's
names or enough of the words of one of its sentences occur in the paragraph, and if the
marks of Creative Commons licences are those of the family; unconfirmed ones, and
paragraphs that say a licence does not hold, become ``unknown`` too.

All work on the documents is DataFrame functions and JVM-side model stages.

Defined results: paragraphs are numbered from 0; NULL and empty texts and empty lines give no rows; repeated rows give
their rows again; long texts are read whole; equal lines get equal results.
"""

from __future__ import annotations

import re
from collections import defaultdict
from dataclasses import dataclass
from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: How the licences of each family are named, as words.
NAMES = {
    "AGPL": ["gnu affero general public license", "affero general public license", "gnu agpl", "agpl", "agplv3", "agpl 3 0"],
    "Apache": ["apache license", "apache license version 2 0", "apache software license", "apache 2 0", "apache v2", "asl 2 0"],
    "Artistic": ["artistic license", "artistic license 2 0", "perl artistic license"],
    "BSD": ["bsd license", "bsd 3 clause", "bsd 2 clause", "3 clause bsd", "new bsd license", "simplified bsd license", "modified bsd license", "bsd style license"],
    "Boost": ["boost software license", "boost software license version 1 0", "bsl 1 0", "boost license"],
    "CC-BY": ["creative commons attribution", "creative commons attribution 4 0 international", "cc by", "cc by 4 0", "cc by 3 0"],
    "CC-BY-NC": ["creative commons attribution noncommercial", "creative commons attribution non commercial", "cc by nc", "cc by nc 4 0"],
    "CC-BY-NC-ND": ["creative commons attribution noncommercial noderivatives", "creative commons attribution noncommercial noderivs", "cc by nc nd", "cc by nc nd 4 0"],
    "CC-BY-NC-SA": ["creative commons attribution noncommercial sharealike", "creative commons attribution noncommercial share alike", "cc by nc sa", "cc by nc sa 4 0"],
    "CC-BY-ND": ["creative commons attribution noderivatives", "creative commons attribution noderivs", "cc by nd", "cc by nd 4 0"],
    "CC-BY-SA": ["creative commons attribution sharealike", "creative commons attribution share alike", "cc by sa", "cc by sa 4 0"],
    "EPL": ["eclipse public license", "eclipse public license v 2 0", "epl 2 0", "epl 1 0"],
    "GPL": ["gnu general public license", "gnu general public license version 3", "gnu gpl", "gpl", "gplv2", "gplv3", "gpl 3 0", "gpl 2 0"],
    "ISC": ["isc license", "isc"],
    "LGPL": ["gnu lesser general public license", "gnu library general public license", "lesser general public license", "lgpl", "lgplv2 1", "lgplv3", "lgpl 2 1"],
    "MIT": ["mit license", "mit licence", "expat license", "mit x11 license", "mit"],
    "MPL": ["mozilla public license", "mozilla public license version 2 0", "mpl 2 0", "mpl 1 1", "mpl"],
    "OFL": ["sil open font license", "open font license", "ofl 1 1"],
    "Public-Domain": ["cc0", "cc0 1 0", "creative commons zero", "unlicense", "public domain dedication"],
    "Proprietary": ["proprietary license", "commercial license"],
    "Zlib": ["zlib license", "zlib libpng license"],
}
#: Usual sentences of each licence and its notices.
TEMPLATES = {
    "AGPL": [
        "licensed under the GNU Affero General Public License",
        "you can redistribute it under the terms of the GNU Affero General Public License",
        "if you modify the program you must offer all users interacting with it remotely through a computer network an opportunity to receive the corresponding source",
    ],
    "Apache": [
        "licensed under the Apache License Version 2.0",
        "you may not use this file except in compliance with the License",
        "unless required by applicable law or agreed to in writing software distributed under the License is distributed on an as is basis without warranties or conditions of any kind either express or implied",
        "see the License for the specific language governing permissions and limitations under the License",
        "subject to the terms and conditions of this License each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license",
        "you may obtain a copy of the License at http www apache org licenses LICENSE 2.0",
    ],
    "Artistic": [
        "this program is free software you can redistribute it and or modify it under the same terms as Perl itself",
        "you may distribute under the terms of either the GNU General Public License or the Artistic License as specified in the Perl README file",
    ],
    "BSD": [
        "licensed under the BSD License",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
        "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
        "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
        "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
        "use of this source code is governed by a BSD style license that can be found in the LICENSE file",
    ],
    "Boost": [
        "distributed under the Boost Software License Version 1.0",
        "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license",
    ],
    "CC-BY": [
        "licensed under a Creative Commons Attribution 4.0 International License",
        "you are free to share and adapt the material for any purpose even commercially if you give appropriate credit provide a link to the license and indicate if changes were made",
        "this is an open access article distributed under the Creative Commons Attribution License which permits unrestricted use distribution and reproduction in any medium provided the original work is properly cited",
    ],
    "CC-BY-NC": ["licensed under a Creative Commons Attribution NonCommercial 4.0 International License"],
    "CC-BY-NC-ND": ["licensed under a Creative Commons Attribution NonCommercial NoDerivatives 4.0 International License"],
    "CC-BY-NC-SA": ["licensed under a Creative Commons Attribution NonCommercial ShareAlike 4.0 International License"],
    "CC-BY-ND": ["licensed under a Creative Commons Attribution NoDerivatives 4.0 International License"],
    "CC-BY-SA": [
        "licensed under a Creative Commons Attribution ShareAlike 4.0 International License",
        "text is available under the Creative Commons Attribution ShareAlike License additional terms may apply",
    ],
    "EPL": [
        "all rights reserved this program and the accompanying materials are made available under the terms of the Eclipse Public License v2.0 which accompanies this distribution",
        "this program and the accompanying materials are made available under the terms of the Eclipse Public License",
    ],
    "GPL": [
        "licensed under the GNU General Public License version 3",
        "you can redistribute it and or modify it under the terms of the GNU General Public License as published by the Free Software Foundation either version 3 of the License or at your option any later version",
        "this program is free software you can redistribute it and or modify",
        "you should have received a copy of the GNU General Public License along with this program",
        "see the GNU General Public License for more details",
        "the GNU General Public License is a free copyleft license for software and other kinds of works",
    ],
    "ISC": [
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
        "licensed under the ISC License",
    ],
    "LGPL": [
        "licensed under the GNU Lesser General Public License version 2.1",
        "this library is free software you can redistribute it and or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
        "you should have received a copy of the GNU Lesser General Public License along with this library",
    ],
    "MIT": [
        "licensed under the MIT License",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction",
        "including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software",
        "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    ],
    "MPL": [
        "this source code form is subject to the terms of the Mozilla Public License v 2.0",
        "if a copy of the MPL was not distributed with this file you can obtain one at https mozilla org MPL 2.0",
        "licensed under the Mozilla Public License version 2.0",
    ],
    "OFL": ["this font software is licensed under the SIL Open Font License Version 1.1"],
    "Public-Domain": [
        "this work is dedicated to the public domain under CC0 1.0 license",
        "this is free and unencumbered software released into the public domain",
        "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose",
        "the author has waived all copyright and related or neighboring rights to this work to the extent possible under law",
        "the author hereby disclaims copyright to this source code and places it in the public domain",
    ],
    "Proprietary": [
        "copyright all rights reserved",
        "proprietary and confidential unauthorized copying is prohibited",
        "proprietary and confidential unauthorized copying of this file via any medium is strictly prohibited",
        "all rights reserved",
        "no part of this publication may be reproduced distributed or transmitted in any form or by any means without the prior written permission of the publisher",
    ],
    "Zlib": [
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software",
        "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely",
        "the origin of this software must not be misrepresented you must not claim that you wrote the original software",
    ],
}
#: How a notice says that a licence holds; each name is trained behind each of these.
VERBS = [
    "licensed under the", "released under the", "distributed under the terms of the", "available under", "SPDX License Identifier",
    "covered by the", "License:", "",
]
#: Words that tell the Creative Commons licences apart; each holds for the families whose name has the mark.
QUALIFIERS = {
    "NC": r"(?i)\b(nc|non-?\s?commercial)\b",
    "ND": r"(?i)\b(nd|no-?\s?deriv(ative)?s?)\b",
    "SA": r"(?i)\b(sa|share-?\s?alike)\b",
}
#: A notice that says a licence does not hold names none.
NEGATED = (
    r"(?i)\b(not|never|no longer|neither|isn.t|aren.t|wasn.t)\W+(?:\w+\W+){0,3}"
    r"(licen[sc]ed|released|available|covered|published|offered|free software)\b"
)
#: Words around a notice, and lines that share words with notices but name no licence.
OPENINGS = ["", "This work is", "This file is", "The software is", "Code and data:", "Note:", "The text is"]
CLOSINGS = ["", ".", "See the LICENSE file for details.", "Copyright 2020 the authors.", "All warranties are disclaimed."]
PLAIN = [
    "he lost his driving license on the way home",
    "the license plate of the car was stolen",
    "the copyright office moved to another street",
    "a poetic license that readers forgive",
    "the fishing license costs more this year",
    "she asked about the licensing of restaurants",
    "the court heard a copyright claim last week",
    "the word license has two spellings",
    "permission to enter the park was granted by the guard",
    "the swimming pool is in the public domain of the town",
    "the general public was invited to apply for a license",
    "a study of the copyright of songs and plays",
    "all rights of the guests were respected",
    "she reserved all seats in the first row",
    "human rights are rights of all people",
    "the talks were confidential and nobody was copying them",
    "smoking is strictly prohibited in this building",
    "version 1.0 was slow and version 4.0 was not",
    "he scored 4.0 and she scored 2.0 or 3.0",
    "the identifier of this file is 1 or 2",
    "the source of the river and the form of the hill",
    "you may use the software in the office",
    "it was released in the spring of 2020 by the authors",
    "nobody in the house knew the apache or the gnu",
    "students at mit built a robot last summer",
    "the boost in sales came from the new store",
    "the artistic director left the theatre in may",
    "an eclipse of the sun is public news",
    "the lesser evil is general agreement",
    "the king reserved the right to sign the treaty",
    "free of charge to any person under the age of ten",
    "the font of the title is open and round",
    "commercial use of the beach is not allowed",
    "the above notice shall appear on all doors of the hall",
    "share your views and give credit to the creative people of the commons",
    "the authors of the study disclaim any conflict of interest",
    "the material is made of wool and without any warranty",
    "please read the terms and conditions of the lottery",
    "to the extent possible under law the police will help",
    "the software crashed and the files were lost",
    "copies of the book were sold for a small fee",
    "modify the recipe and use less sugar",
    "under the general rules of the club members may vote",
    "the foundation gave free concerts to the public",
]
#: Share of a template's words that must occur in the paragraph.
CONFIRMED = 0.6
NONE, UNKNOWN = "none", "unknown"
#: Families that the threshold is set without, to see how notices of unknown licences fare.
APART = ["Zlib", "OFL", "Boost"]
#: Share of right names among those over the threshold.
PRECISE = 0.97


def names_in_use(family: str) -> list[str]:
    """The names of a family behind all verbs; a single plain word never stands alone."""
    behind = [f"{verb} {name}".strip() for name in NAMES[family] for verb in VERBS if verb or not is_bare(name)]
    return behind + [f"{name} licensed" for name in NAMES[family] if "licen" not in name]


def is_bare(name: str) -> bool:
    """A single word without a digit, such as ``mit``: it names a licence only beside words that speak of one."""
    return " " not in name and not any(map(str.isdigit, name))


def pieces(sentence: str) -> list[str]:
    """A sentence, and the two thirds from its start and to its end if it is long, as lines are cut."""
    tokens = sentence.split()
    cut = 2 * len(tokens) // 3
    return [sentence] if len(tokens) < 10 else [sentence, " ".join(tokens[:cut]), " ".join(tokens[-cut:])]


def labelled_paragraphs() -> list[tuple[str, str, int]]:
    """Paragraphs made of opening, notice and closing, and plain lines, with family and number of the notice."""
    rows = []
    around = list(zip(OPENINGS, CLOSINGS * 2, strict=False))
    for family in TEMPLATES:
        made = [(piece, number, around) for number, s in enumerate(TEMPLATES[family]) for piece in pieces(s)]
        made += [(name, number, around[:2]) for number, name in enumerate(names_in_use(family))]
        for notice, number, wrappings in made:
            rows += [(" ".join(p for p in (o, notice, c) if p), family, number) for o, c in wrappings]
    plain = [
        (" ".join(p for p in (opening, line, closing) if p), NONE, number)
        for number, line in enumerate(PLAIN)
        for opening in OPENINGS[:3]
        for closing in ("", ".", "Nobody knew why.")
    ]
    return rows + plain


def paragraphs(text: Column) -> Column:
    """The lines of a text; a line that goes on in the next one, behind comment marks or not, is one with it."""
    joined = F.regexp_replace(text, r"(?<![.!?:;\s])[ \t]*\r?\n[ \t]*(?:(?:#+|//+|\*+|--+|;+)[ \t]+)?(?=[a-z(])", " ")
    return F.split(joined, "\r\n|\n|\r")


def words(paragraph: Column) -> Column:
    spaced = F.regexp_replace(F.lower(paragraph), "[^a-z0-9]+", " ")
    return F.filter(F.split(spaced, " "), lambda w: w != "")


def grams(tokens: str, n: int) -> Column:
    count = F.size(tokens) - (n - 1)
    return F.when(
        count > 0,
        F.transform(F.sequence(F.lit(1), count), lambda i: F.array_join(F.slice(tokens, i, n), " ")),
    ).otherwise(F.array().cast("array<string>"))


def marked_words(paragraph: Column, kept: list[str]) -> Column:
    """The words of a paragraph, each run of words that are not ``kept`` as one ``|``."""
    ends = defaultdict(list)
    for word in kept:
        ends[word[0]].append(word[1:])
    choice = "|".join(f"{first}(?:{'|'.join(sorted(rest, reverse=True))})" for first, rest in sorted(ends.items()))
    spaced = F.concat(F.regexp_replace(F.lower(paragraph), "[^a-z0-9]+", " "), F.lit(" "))
    marked = F.regexp_replace(spaced, f"(?<![a-z0-9])(?!(?:{choice}) )[a-z0-9]++ ", "|")
    return F.filter(F.split(F.regexp_replace(marked, "[|]++", "| "), " "), lambda w: w != "")


def with_grams(df: DataFrame, paragraph: str, kept: list[str] | None = None) -> DataFrame:
    """``__words`` and ``__grams`` of each row; with ``kept``, those without other words only."""
    column = F.col(paragraph)
    spelled = df.withColumn("__words", words(column) if kept is None else marked_words(column, kept))
    together = F.concat(F.col("__words"), grams("__words", 2), grams("__words", 3))
    return spelled.withColumn("__grams", F.array_distinct(together))


@dataclass
class LicenceModel:
    stages: PipelineModel
    families: list[str]
    threshold: float

    def telling_words(self) -> list[str]:
        """The words of all n-grams with a weight and of all templates."""
        counter, learner = self.stages.stages
        weighted = learner.coefficientMatrix.toArray().any(axis=0)
        texts = [gram for gram, w in zip(counter.vocabulary, weighted, strict=True) if w]
        texts += [notice.lower() for family in TEMPLATES for notice in TEMPLATES[family] + names_in_use(family)]
        return sorted({word for text in texts for word in re.findall("[a-z0-9]+", text)})


def probabilities(df: DataFrame, stages: PipelineModel, families: list[str]) -> DataFrame:
    """The likeliest family of each row of ``__grams`` and its probability."""
    chances = stages.transform(df).withColumn("__chances", vector_to_array("probability"))
    best = F.array_max("__chances")
    names = F.array(*[F.lit(f) for f in families])
    place = F.array_position("__chances", best).cast("int")
    return chances.withColumn("__best", best).withColumn("__family", F.element_at(names, place))


def trained(labelled: DataFrame) -> PipelineModel:
    counter = CountVectorizer(inputCol="__grams", outputCol="features", binary=True, minDF=2.0).fit(labelled)
    learner = LogisticRegression(
        maxIter=60, regParam=0.0004, elasticNetParam=0.5, standardization=False, family="multinomial"
    )
    return PipelineModel([counter, learner.fit(counter.transform(labelled))])


def fit_licences(spark: SparkSession) -> LicenceModel:
    """Train on all made paragraphs, with a threshold from a model that has not seen what it judges.

    That model is trained without every fourth notice and plain line and without
    the families ``APART``. It judges these: the threshold is the least probability
    from which at least ``PRECISE`` of the named families are right, those of
    ``APART`` being right only as unknown.
    """
    rows = labelled_paragraphs()
    families = [NONE, *sorted(TEMPLATES)]
    labelled = spark.createDataFrame(
        [(text, family, number, float(families.index(family))) for text, family, number in rows],
        "text string, family string, number int, label double",
    )
    labelled = with_grams(labelled, "text")
    unseen = (F.col("number") % 4 == 3) | F.col("family").isin(*APART)
    judged = probabilities(labelled.where(unseen), trained(labelled.where(~unseen)), families)
    seen = judged.where(F.col("__family") != NONE).select("family", "__family", "__best").collect()
    threshold, right = 1.0, 0
    for place, r in enumerate(sorted(seen, key=lambda r: -r["__best"]), start=1):
        right += r["family"] == r["__family"]
        if right >= PRECISE * place:
            threshold = r["__best"]
    return LicenceModel(trained(labelled), families, threshold)


def scan_licences(
    docs: DataFrame, model: LicenceModel, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``key, paragraph, line, family, probability, likeness`` of every paragraph that is not empty."""
    chosen = docs.select(F.col(key).alias("__key"), F.col(text).alias("__text"))
    lines = chosen.select(
        "__key", F.posexplode(paragraphs(F.col("__text"))).alias("paragraph", "line")
    )
    lines = lines.where(F.col("line") != "")
    judged = probabilities(with_grams(lines, "line", model.telling_words()), model.stages, model.families)
    sentences, named, marks = F.lit(None), F.lit(None), F.lit(True)
    about = F.col("line").rlike(r"(?i)\b(licen[sc]\w*|spdx\b|under\b)")
    spelled = F.concat(F.lit(" "), F.array_join("__words", " "), F.lit(" "))
    for family in sorted(TEMPLATES):
        sets = F.array(*[F.array_distinct(words(F.lit(notice))) for notice in TEMPLATES[family]])
        sentences = F.when(F.col("__family") == family, sets).otherwise(sentences)
        held = [F.contains(F.col("__spelled"), F.lit(f" {n} ")) & (about if is_bare(n) else F.lit(True)) for n in NAMES[family]]
        names = reduce(lambda a, b: a | b, held)
        named = F.when(F.col("__family") == family, names).otherwise(named)
        if family.startswith("CC-BY"):
            same = [F.col("line").rlike(mark) == (name in family.split("-")) for name, mark in QUALIFIERS.items()]
            marks = F.when(F.col("__family") == family, reduce(lambda a, b: a & b, same)).otherwise(marks)
    shares = F.transform("__notices", lambda t: F.size(F.array_intersect(t, F.col("__words"))) / F.size(t))
    judged = judged.withColumns({"__notices": sentences, "__spelled": spelled})
    likeness = F.greatest(F.coalesce(F.array_max(shares), F.lit(0.0)), F.coalesce(named, F.lit(False)).cast("double"))
    sure = (F.col("__best") >= model.threshold) & (F.col("__family") != NONE) & marks & ~F.col("line").rlike(NEGATED)
    return judged.withColumn("likeness", likeness).select(
        F.col("__key").alias(key),
        "paragraph",
        "line",
        F.when(sure & (F.col("likeness") >= CONFIRMED), F.col("__family")).otherwise(UNKNOWN).alias("family"),
        F.col("__best").alias("probability"),
        "likeness",
    )
