"""Notices and plain lines that are not made from the templates: precision, recall, wrapped lines, negation, unknown licences."""

import pytest
from broodline.llm.licences import fit_licences, scan_licences

SPELLED = {
    "MIT": ["MIT License", "MIT licence", "Expat License"],
    "Apache": ["Apache-2.0 license", "Apache License, Version 2.0", "Apache Software License 2.0"],
    "GPL": ["GPL-3.0", "GNU General Public License v2 or later", "GPLv3"],
    "LGPL": ["LGPL-2.1", "GNU Lesser General Public License", "LGPLv3"],
    "AGPL": ["AGPL-3.0", "GNU Affero General Public License v3", "AGPLv3"],
    "BSD": ["BSD 3-Clause License", "BSD-2-Clause", "New BSD License"],
    "MPL": ["Mozilla Public License 2.0", "MPL-2.0", "MPL 1.1"],
    "CC-BY": ["CC-BY 4.0", "Creative Commons Attribution 3.0 Unported License", "CC BY 3.0"],
    "CC-BY-SA": ["CC-BY-SA 4.0", "Creative Commons Attribution-ShareAlike 3.0 License", "CC BY-SA"],
    "CC-BY-NC": ["CC-BY-NC 4.0", "Creative Commons Attribution-NonCommercial 3.0 License", "CC BY-NC 2.0"],
    "CC-BY-NC-SA": ["CC-BY-NC-SA 4.0", "Creative Commons Attribution-NonCommercial-ShareAlike 3.0", "CC BY-NC-SA 2.5"],
    "CC-BY-NC-ND": ["CC-BY-NC-ND 4.0", "Creative Commons Attribution-NonCommercial-NoDerivs 3.0", "CC BY-NC-ND 2.5"],
    "EPL": ["Eclipse Public License 2.0", "EPL-2.0", "Eclipse Public License v1.0"],
    "ISC": ["ISC License", "ISC licence"],
}
AROUND = [
    "© 2021 Jane Roe and others. Use is governed by {}.",
    "This crate comes under {}, a copy of which lies beside it.",
    "{} applies to all files in this folder unless a file says otherwise.",
]
BODIES = [
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining\na copy of this software and associated documentation files (the\n\"Software\"), to deal in the Software without restriction"),
    ("Apache", "# Unless required by applicable law or agreed to in writing, software\n# distributed under the License is distributed on an \"AS IS\" BASIS,"),
    ("BSD", "// Redistribution and use in source and binary forms, with or without\n// modification, are permitted provided that the following conditions are met:"),
    ("GPL", "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version 3 of the License."),
    ("LGPL", "You should have received a copy of the GNU Lesser General Public\nLicense along with this library; if not, write to us."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted."),
    ("Public-Domain", "This is free and unencumbered software released into the public domain."),
    ("Proprietary", "Copyright (c) 2014 Some Firm Ltd. All rights reserved."),
    ("Proprietary", "PROPRIETARY AND CONFIDENTIAL. Unauthorized copying of this file is prohibited."),
    ("Boost", "Distributed under the Boost Software License, Version 1.0."),
    ("CC-BY", "This is an open access article under the CC BY license."),
]
NOTICES = [(f, a.format(n)) for f, names in SPELLED.items() for n in names for a in AROUND] + BODIES
PLAIN = [
    pattern.format(noun)
    for noun in ("garden", "river", "council", "teacher", "ship", "factory", "museum", "bakery", "choir", "bridge")
    for pattern in (
        "The {} lost its license after the fire in March.",
        "A permission slip for the {} was granted to all pupils.",
        "The {} is open to the general public on Sundays.",
        "Version 2.0 of the {} plan was released on Monday.",
        "The copyright of the {} song went to his heirs.",
        "They share the {} alike with neighbours and friends.",
        "No commercial use of the {} was made in those years.",
        "The software of the {} failed, and the authors were sorry.",
        "All members of the {} have equal rights.",
        "She drove past the {} without a driving licence.",
        "The {} was founded by two students from MIT.",
    )
]


@pytest.fixture(scope="module")
def model(spark):
    return fit_licences(spark)


def named(spark, model, texts):
    """The families named in each text."""
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    out = [set() for _ in texts]
    for r in scan_licences(df, model).where("family <> 'unknown'").collect():
        out[r["doc_id"]].add(r["family"])
    return out


def test_precision_and_recall(spark, model):
    assert len(NOTICES) >= 100 and len(PLAIN) >= 100
    found = named(spark, model, [text for _, text in NOTICES])
    right = sum(family in names for (family, _), names in zip(NOTICES, found, strict=True))
    wrong = sum(len(names - {family}) for (family, _), names in zip(NOTICES, found, strict=True))
    false = sum(map(len, named(spark, model, PLAIN)))
    precision, recall = right / (right + wrong + false), right / len(NOTICES)
    print(f"precision {precision:.3f}, recall {recall:.3f}, {len(NOTICES)} notices, {false} of {len(PLAIN)} plain lines named")
    assert precision >= 0.97 and recall >= 0.9


def test_wrapped_lines_are_one_paragraph(spark, model):
    df = spark.createDataFrame([(1, BODIES[3][1] + "\n\nNext Part\nOf text")], "doc_id long, text string")
    found = sorted(scan_licences(df, model).collect(), key=lambda r: r["paragraph"])
    assert [(r["paragraph"], r["family"]) for r in found][0] == (0, "GPL")
    assert [r["line"] for r in found][1:] == ["Next Part", "Of text"]


def test_negation_and_foreign_licences_are_unknown(spark, model):
    texts = [
        "This is not licensed under the MIT License.", "The code was never released under the GPL.",
        "It isn't available under the Apache License.", "Licensed under the Foo Bar Community Agreement 7.",
        "This work may be used under the Open Widget Terms.", None, "", " \n\t ",
    ]
    assert named(spark, model, texts) == [set()] * len(texts)


def test_rows_without_an_id_and_clashing_columns(spark, model):
    df = spark.createDataFrame([(None, "All rights reserved.", "x", 1.0)] * 2, "doc_id long, text string, line string, probability double")
    found = scan_licences(df, model).collect()
    assert [(r["doc_id"], r["paragraph"], r["line"], r["family"]) for r in found] == [(None, 0, "All rights reserved.", "Proprietary")] * 2
