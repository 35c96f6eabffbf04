import numpy as np
import pytest
from conftest import SF

from framestride.llm import licenses, shingles


@pytest.fixture(scope="module")
def model(spark):
    return licenses.train(licenses.sample(spark.read.parquet(f"{SF}/documents.parquet")))


def found(model, *texts):
    return [sorted({x["family"] for x in f}) for f in licenses._findings(model, list(texts))]


def test_spoken_forms_are_found_and_near_misses_rejected(model):
    forms = [(f, t) for f in licenses.FAMILIES for t in licenses.spoken(f)]
    got = found(model, *(t for _, t in forms))
    assert all(f in g for (f, _), g in zip(forms, got, strict=True))
    assert all(licenses.confirmed(t, f) == 1 for f, t in forms)
    assert not any(found(model, *licenses.OTHER))
    assert not any(found(model, *(d.format(n) for names in licenses.NAMES.values() for n in names for d in licenses.DENIALS)))


def test_held_out_variants(model):
    """Variants that training did not see: the classifier alone, as a licence or none and by family."""
    lines, own = licenses.variants(seed=99, copies=2)
    assert np.mean(model.odds(lines) > model.margin) >= 0.98
    right = 0
    for line, family in zip(lines, own, strict=True):
        grams = licenses._grams(shingles.words([line])[0])
        right += licenses.FAMILIES.index(family) in model.likely(grams, 0, len(grams[0]))
    assert right / len(lines) >= 0.98


#: Wording that is in no template, with what it grants. The shares found are in the README.
HELD_OUT = [
    ("// Use of this code is governed by an MIT license found in the LICENSE file.", "MIT"), ("The crate is offered under the MIT licence.", "MIT"), ("Code: Released under MIT License, see LICENSE.", "MIT"), ("* SPDX-License-Identifier: MIT */", "MIT"),
    ("We have published all of our sources under the Apache-2.0 license.", "Apache-2.0"), ("Software distributed under Apache License v2.0 (see NOTICE).", "Apache-2.0"), ("# SPDX-License-Identifier: Apache-2.0 WITH LLVM-exception", "Apache-2.0"),
    ("This tool is available under GPLv3.", "GPL-3.0"), ("The kernel module is licensed under the GNU GPL v2.", "GPL-2.0"), ("released under the terms of the GNU General Public License v3.0 or later", "GPL-3.0"), ("/* SPDX-License-Identifier: GPL-2.0-or-later */", "GPL-2.0"), ("This script is covered by GPL version 2.", "GPL-2.0"),
    ("Distributed under the terms of the GNU Lesser General Public License v3.", "LGPL-3.0"), ("The bindings are licensed under LGPLv2.1", "LGPL-2.1"), ("the server is provided under the AGPLv3", "AGPL-3.0"), ("Subject to the Mozilla Public License, Version 2.0.", "MPL-2.0"), ("licensed under MPL-2.0", "MPL-2.0"),
    ("All documentation is licensed under the Creative Commons Attribution 4.0 International license.", "CC-BY-4.0"), ("Pictures are released under CC BY-SA 3.0 Unported.", "CC-BY-SA-3.0"), ("Text is available under the Creative Commons Attribution-ShareAlike 3.0 License.", "CC-BY-SA-3.0"),
    ("The corpus is distributed under CC-BY-NC-SA 4.0.", "CC-BY-NC-SA-4.0"), ("Slides licensed under Creative Commons BY-NC-ND 4.0", "CC-BY-NC-ND-4.0"), ("licensed under CC BY-ND 3.0", "CC-BY-ND-3.0"), ("The data are made available under CC0 1.0 Universal.", "CC0-1.0"),
    ("This package is licensed under the 3-clause BSD license.", "BSD-3-Clause"), ("distributed under the simplified BSD license", "BSD-2-Clause"), ("Released under the BSD 2-Clause license.", "BSD-2-Clause"), ("Licensed under the ISC licence.", "ISC"), ("It is released under the zlib license.", "Zlib"),
    ("Distributed under the Boost Software License, Version 1.0.", "BSL-1.0"), ("This program is made available under the terms of the Eclipse Public License v2.0", "EPL-2.0"), ("Licensed under the EUPL v1.2", "EUPL-1.2"), ("The typeface is licensed under the SIL Open Font License 1.1.", "OFL-1.1"),
    ("Copyright 1999-2004 The Makers, Inc. All rights reserved.", "Proprietary"), ("(c) 2011 Somebody. All rights reserved.", "Proprietary"), ("Unauthorised or unauthorized copying of this file via any medium is strictly prohibited", "Proprietary"),
    ("Everyone may use it: the whole thing has a permissive, MIT-style grant.", "MIT"), ("Consider this code to be in the public domain under CC0 1.0.", "CC0-1.0"), ("You can use this under GPL 3.", "GPL-3.0"), ("License: Apache 2.0", "Apache-2.0"),
]
#: Wording that grants nothing, or nothing of a family that is known.
NOTHING = [
    "This work is not licensed under the MIT License.", "The MIT License does not apply here.", "It is no longer distributed under the GPL version 2.", "Neither part is covered by the Apache License, Version 2.0.", "He said all rights reserved for members of the club were lost.",
    "She asked whether it was released under the MIT License.", "Licensed under the GPL version 1.", "Licensed under the Apache License, Version 1.1.", "Licensed under CC BY-XY 4.0.", "Licensed under the Affero Mozilla Lesser License 2.0.", "He was licensed under state law to drive trucks of version 2.",
    "The GNU General Public License, version 3 was published in 2007.", "A comparison of the MIT License and the BSD 2-Clause License.", "Students at MIT license their inventions.", "The prisoner was released under strict conditions by the MIT campus police.", "Creative Commons is an organisation.", "All rights reserved seats are taken.",
    "Your driving license is subject to renewal in 2.0 years.", "Permission is hereby granted to leave the room.", "The zlib license was mentioned.", "It was published in version 2.0 of the report.", "Unlike this, the other is released under the ISC License.", "If it were licensed under the MIT License we would use it.",
    "Redistribution of wealth is permitted provided that conditions are met.", "They reserved all rights they had.", "You may obtain a copy of the map at the desk.", "Copyright law is taught on Mondays.",
]


def test_wording_that_no_template_has(model):
    got = found(model, *(t for t, _ in HELD_OUT))
    wrong = [(t, g) for (t, f), g in zip(HELD_OUT, got, strict=True) if set(g) - {f}]
    right = sum(f in g for (_, f), g in zip(HELD_OUT, got, strict=True))
    print("found", right, "of", len(HELD_OUT))
    assert not wrong and right / len(HELD_OUT) >= 0.85, [x for x, g in zip(HELD_OUT, got, strict=True) if x[1] not in g]
    assert not [(t, g) for t, g in zip(NOTHING, found(model, *NOTHING), strict=True) if g]


def test_near_names_are_told_apart(model):
    cases = {
        "Licensed under CC BY-NC-SA 4.0.": ["CC-BY-NC-SA-4.0"], "Licensed under CC BY-ND 4.0.": ["CC-BY-ND-4.0"], "Licensed under CC BY 4.0.": ["CC-BY-4.0"], "Licensed under CC BY-SA 3.0.": ["CC-BY-SA-3.0"], "# SPDX-License-Identifier: (Apache-2.0 OR MIT)": ["Apache-2.0", "MIT"],
        "Licensed under the GNU Lesser General Public License, version 2.1.": ["LGPL-2.1"], "Licensed under the GNU Affero General Public License, version 3.": ["AGPL-3.0"], GPL.replace("version 3", "version 2"): ["GPL-2.0"], GPL.replace("version 3", "version 1"): [],
    }
    assert found(model, *cases) == list(cases.values())


def test_documents(spark):
    """Every planted licence line is found in its document, and nothing else."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    known = {
        "Licensed under the Apache License, Version 2.0.": "Apache-2.0", "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0", "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0", "Released under the MIT License.": "MIT", "All rights reserved.": "Proprietary",
    }
    want = {r["doc_id"]: sorted({f for t, f in known.items() if t in r["text"].split("\n")}) for r in docs.collect()}
    got = licenses.scan(docs).collect()
    assert {r["doc_id"]: r["families"] for r in got} == want and sum(map(len, want.values())) > 20
    for r in got:
        for x in r["findings"]:
            assert x["template"] >= licenses.CONFIRM


def test_edge_cases(spark, model):
    mit = "Released under the MIT License."
    rows = [(1, None), (2, ""), (3, "\n\n"), (4, mit), (4, mit), (None, "text\nAll rights reserved.\n" + mit), (5, "word " * 300_000 + "\n" + mit), (6, "This text discusses the MIT License and others at length.")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, text string, families string")
    got = sorted((repr(r["doc_id"]), r["families"], [x["line"] for x in r["findings"]]) for r in licenses.scan(docs, model).collect())
    assert got == [("1", [], []), ("2", [], []), ("3", [], []), ("4", ["MIT"], [0]), ("4", ["MIT"], [0]), ("5", ["MIT"], [1]), ("6", [], []), ("None", ["MIT", "Proprietary"], [1, 2])]
    assert licenses.scan(docs.limit(0), model).count() == 0


def test_sampling_of_few_and_null_rows(spark):
    docs = spark.createDataFrame([(None, None), (None, "a line"), (None, "a line")], "doc_id bigint, text string")
    assert licenses.sample(docs) == ["a line", "a line"] and licenses.sample(docs.limit(0)) == []
    assert [r["families"] for r in licenses.scan(docs).collect()] == [[], [], []]


MIT = """MIT License

Copyright (c) 2024 A. Person

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell"""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice"""
GPL = """# This program is free software: you can redistribute it and/or modify
# it under the terms of the GNU General Public License as published by
# the Free Software Foundation, either version 3 of the License, or
# (at your option) any later version."""


def test_wrapped_notices_and_grants_in_long_lines(spark, model):
    words = "the old house by the river was sold to a farmer who kept horses there ".split()
    long = lambda n: " " + " ".join(words * n) + " "
    mit, apache = "Released under the MIT License.", "Licensed under the Apache License, Version 2.0."
    rows = [
        (MIT, [("MIT", 4)]),
        (BSD, [("BSD", 0)]),
        (GPL, [("GPL-3.0", 0)]),
        ("\n".join(GPL.replace("#", "").split()), [("GPL-3.0", 5)]),
        (GPL.replace("version 3", "version 2"), [("GPL-2.0", 0)]),
        (GPL.replace("GNU General", "GNU Affero General"), [("AGPL-3.0", 0)]),
        (long(300) + mit + " " + long(300), [("MIT", 0)]),
        (long(300) + mit + " " + long(300) + apache + " " + long(300), [("Apache-2.0", 0), ("MIT", 0)]),
        (mit + " " + apache, [("Apache-2.0", 0), ("MIT", 0)]),
        ("Licensed to the farmer. Licensed under the MIT License.", [("MIT", 0)]),
        ("Licensed under CC BY-NC 4.0.", [("CC-BY-NC-4.0", 0)]),
        (long(6000) + "\n" + long(3) + "\n" + mit + "\n" + long(3), [("MIT", 2)]),
        ("Released under the\n\nMIT License.", []),
    ]
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "doc_id bigint, text string")
    got = {r["doc_id"]: sorted((x["family"], x["line"]) for x in r["findings"]) for r in licenses.scan(docs, model).collect()}
    assert got == {i: want for i, (_, want) in enumerate(rows)}
