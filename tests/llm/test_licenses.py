from pathlib import Path

import numpy as np

from corpusloom.llm import licenses
from corpusloom.llm.licenses import FAMILIES, OTHERS, TEMPLATES, UNKNOWN, _variants, scan_licenses, scan_text, train


def test_templates_are_their_family():
    for family, texts in TEMPLATES.items():
        for t in texts:
            assert scan_text("First line.\n" + t, train(), 0.5)[0][:2] == (1, family)


def test_held_out_variants():
    rng, right, n = np.random.default_rng(99), 0, 0
    for family, texts in TEMPLATES.items():
        for t in texts:
            for v in _variants(t, rng, 5)[3:]:
                found = scan_text(v, train(), 0.5)
                right += bool(found) and found[0][1] == family
                n += 1
    assert right / n > 0.85
    wrong = [v for t in OTHERS for v in _variants(t, rng, 5) if scan_text(v, train(), 0.5)]
    assert not wrong and len(FAMILIES) == len(TEMPLATES) + 1


def test_notices_of_another_making():
    """Notices written by hand, as projects have them; none is a template or a variant of one."""
    notices = {
        "MIT": ["Distributed under the MIT License. See LICENSE for more information.", "This software is released under the MIT License.", "The code in this repository is licensed under the MIT license, see below.", "Code licensed under MIT license"],
        "Apache-2.0": ["This library is licensed under the Apache License, Version 2.0, see the file LICENSE.", "Released under the Apache 2.0 license", "SPDX-License-Identifier: Apache-2.0 WITH LLVM-exception"],
        "GPL": ["This program is licensed under the GNU General Public License, version 3 or later.", "It is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the FSF, version 2."],
        "BSD": ["Released under the BSD 3-Clause License, see LICENSE.txt", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that these conditions are met:"],
        "CC-BY-SA": ["All text is available under the Creative Commons Attribution-ShareAlike License; additional terms may apply."],
        "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0. You can obtain one at mozilla.org/MPL/2.0."],
    }
    found = [(f, (scan_text(t, train(), 0.5) or [(0, UNKNOWN)])[0][1]) for f, ts in notices.items() for t in ts]
    assert sum(a == b for a, b in found) >= 0.8 * len(found), found
    prose = [
        "My cousin was licensed as a pilot under the MIT program. The MIT license office is closed.",
        "The GPL debate at the conference was long, and the version of the story that we heard was another.",
        "Permission to land was granted, free of charge, to any person on board.",
        "She wrote about copyright, and about the rights that authors reserved for themselves in 1924.",
        "Apache is the name of a people; a license plate of the state shows it.",
    ]
    assert [scan_text(t, train(), 0.5) for t in prose] == [[]] * len(prose)


def test_lines_without_cues_cannot_be_confirmed():
    """A text that holds half of a template's n-grams holds a cue, whatever half it is."""
    rng = np.random.default_rng(4)
    for family, texts in TEMPLATES.items():
        for t in texts:
            words = t.split()
            for _ in range(20):
                part = " ".join(w for w in words if rng.random() > 0.3)
                assert licenses.likeness(part, family) < 0.5 or licenses._has_cue(part, 0.5)


def test_table(spark):
    long = "word " * 50_000 + "\nReleased under the MIT License.\nLicensed under CC BY-NC 4.0."
    rows = [(1, long, "x"), (2, None, "x"), (3, "", "x"), (None, "no licence here", "x"), (1, long, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, family string")
    out = scan_licenses(df).collect()
    assert [(r.doc_id, r.family, r.n_paragraphs, r.lines) for r in out] == [(1, "MIT", 2, [1, 2]), (2, UNKNOWN, 0, []), (3, UNKNOWN, 0, []), (None, UNKNOWN, 0, []), (1, "MIT", 2, [1, 2])]
    assert scan_licenses(df.limit(0)).count() == 0


def test_notices_that_training_never_reads():
    """tests/llm/data/notices.tsv: notices and ordinary sentences, written for this test only."""
    rows = [x.split("\t") for x in (Path(__file__).parent / "data/notices.tsv").read_text().splitlines()]
    found = [(family, (scan_text(t, train(), 0.5) or [(0, UNKNOWN)])[0][1]) for family, t in rows]
    notices, prose = ([a == b for a, b in found if (a == UNKNOWN) == kind] for kind in (False, True))
    assert sum(notices) >= 0.85 * len(notices) and sum(prose) >= 0.9 * len(prose), [x for x in found if x[0] != x[1]]


def test_another_things_licence():
    assert scan_text("Visitors released under the MIT license of the harbour may enter.", train(), 0.5) == []
    assert scan_text("The mill is licensed under the BSD license board of the town.", train(), 0.5) == []
    assert scan_text("Released under the MIT license", train(), 0.5) and scan_text("Released under the MIT license [1]", train(), 0.5)
