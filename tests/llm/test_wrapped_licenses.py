import textwrap

import pytest

from corpusloom.llm.licenses import OTHERS, TEMPLATES, scan_text, train


@pytest.mark.parametrize("width, mark", [(60, ""), (60, "# "), (72, " * "), (72, "// ")])
def test_wrapped_templates(width, mark):
    for family, texts in TEMPLATES.items():
        for t in texts:
            lines = [mark + x for x in textwrap.wrap(t, width)]
            found = scan_text("\n".join(["code()", "", *lines, "", "more()"]), train(), 0.5)
            assert found and found[0][:2] == (2, family) and {f[1] for f in found} == {family}
            # without blank lines and full stops around it
            found = scan_text("\n".join(["erat oon the ndre", *lines, "ondre eras the"]), train(), 0.5)
            assert found and found[0][:2] == (1, family)


def test_placeholders_are_no_part():
    assert scan_text("Copyright (c) 2019 Acme Ltd. All rights reserved.", train(), 0.5)[0][1::2] == ("Proprietary", 1.0)


def test_neighbours_stay_apart():
    lines = ["SPDX-License-Identifier: MIT", *textwrap.wrap(TEMPLATES["MIT"][4], 72), *textwrap.wrap(TEMPLATES["CC-BY-SA"][1], 50)]
    got = scan_text("\n".join(lines), train(), 0.5)
    assert [f[1] for f in got] == ["MIT", "MIT", "CC-BY-SA"] and got[0][0] == 0 and got[1][0] == 1


def test_ordinary_text_in_lines():
    for width in (30, 60):
        assert scan_text("\n".join(textwrap.wrap(" ".join(OTHERS), width)), train(), 0.5) == []
