import pytest
from pairwright.llm import licences
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def rows(text):
    plain = [(k, text(k, 40) + "\n" + text(k + 500, 30)) for k in range(60)]
    return [
        *plain, (100, text(1, 30) + "\nLicensed under the Apache License, Version 2.0."), (101, "RELEASED under the MIT license!\n" + text(2, 20)), (102, text(3, 20) + " Licensed under CC BY-NC 4.0. " + text(4, 20)), (103, "All rights reserved."),
        (104, "This work is licensed under the GNU General Public License, version 3.\nReleased under the MIT License."), (105, None), (106, ""), (107, "You need a license to fish; the permission was granted in May."), (108, text(9, 20_000)),
        (109, "Licensed under the Foo Bar License."), (100, text(1, 30) + "\nLicensed under the Apache License, Version 2.0."), (None, "Released under the MIT License."),
    ]


def test_families(docs, rows):
    out = licences.licences(docs(rows).withColumns({"families": F.lit("clash"), "id": F.lit(3)}))
    assert out.count() == len(rows)
    got = {r["id"]: list(r["families"]) for r in out.collect()}
    assert got[100] == ["apache"] and got[101] == ["mit"] and got[102] == ["cc-by-nc"] and got[103] == ["proprietary"] and got[104] == ["gpl", "mit"] and got[None] == ["mit"]
    assert not any(v for k, v in got.items() if k is not None and (k < 100 or k in (105, 106, 107, 108, 109)))


def test_calibration_on_held_out_examples(text):
    model = licences.fit(["the cat sat on the mat and looked at the moon"] * 50 + [text(k, 30) for k in range(300)])
    assert 0.3 <= model.least <= 0.9 and set(model.families) == set(licences.TEMPLATES)
    total = sum(n for _, _, n in model.held_out)
    error = 0
    for low in (0.0, 0.2, 0.4, 0.6, 0.8):
        part = [(p, right, n) for p, right, n in model.held_out if low < p <= low + 0.2]
        if part:
            error += abs(sum(p * n for p, _, n in part) - sum(right * n for _, right, n in part)) / total
    assert error < 0.1
    assert sum(n for p, right, n in model.held_out if right) > 0.9 * total


def test_scores_against_plain_regression(docs, text):
    import math
    import re

    model = licences.fit([text(k, 30) for k in range(200)])
    lines = ["Released under the MIT License.", "He read the license of the GNU library and the public domain.", "Licensed under CC BY-NC 4.0.", "no word of it xyzzy", "copyright holder"]
    got = {r["id"]: r for r in licences.scan(docs(list(enumerate(lines))), model).collect()}
    for k, line in enumerate(lines):
        w = re.findall("[a-z0-9]+", line.lower())
        if not set(w) & set(model.words):
            assert k not in got
            continue
        found = {*w, *(f"{a} {b}" for a, b in zip(w, w[1:]))} & set(model.weights)
        s = {f: model.bias[n] + sum(model.weights[g][n] for g in found) for n, f in enumerate(model.families)} | {"none": 0.0}
        best = max(s, key=s.get)
        assert got[k]["best"] == best and abs(got[k]["probability"] - math.exp(s[best]) / sum(map(math.exp, s.values()))) < 1e-9, line


def test_ties_and_long_texts(docs, text):
    notice = "Released under the MIT License."
    rows = [(1, "\n".join([notice] * 3)), (2, (text(5, 2000) + "\n") * 60 + notice), (2, "x"), (3, "word " * 300_000 + notice), *[(k, text(k, 20)) for k in range(10, 40)]]
    got = {r["id"]: (list(r["families"]), r["n_notices"]) for r in licences.licences(docs(rows)).collect()}
    assert got[1] == (["mit"], 3) and got[2] == (["mit"], 1) and got[3] == (["mit"], 1)


def test_unknown(docs, text):
    table = docs([(1, "Permission to build is hereby granted"), *[(k, text(k, 30)) for k in range(2, 20)]])
    found = licences.scan(table, licences.fit(licences.sample(table)))
    assert {r["family"] for r in found.collect()} <= {"unknown", "none"}


UNKNOWN = (
    "Licensed under the Foo Bar License.", "Distributed under the terms of the Quux Public Licence, version 2.", "This file is released under the Blorp Source License.", "Use of this software is subject to the Example Corp License Agreement.",
    "Permission to use this software is granted under the Zed License, see LICENSE.txt.", "This library is free software under the Wibble License version 7.", "Redistribution is permitted under the Gnarl License provided that its notice is kept.",
)


def test_licences_that_no_template_has_are_counted(docs, text):
    rows = [(k, text(k, 40) + "\n" + text(k + 500, 30)) for k in range(40)] + [(1000 + k, text(700 + k, 12) + "\n" + t + "\n" + text(800 + k, 12)) for k, t in enumerate(UNKNOWN)]
    rows += [(2000, "\n".join(text(900 + k, 3000) + "\n" + t for k, t in enumerate(UNKNOWN[:5])))]
    got = {r["id"]: r for r in licences.licences(docs(rows)).collect()}
    assert all((got[1000 + k]["n_unknown"], got[1000 + k]["n_notices"], list(got[1000 + k]["families"])) == (1, 0, []) for k in range(len(UNKNOWN)))
    assert got[2000]["n_unknown"] == 5 and not got[2000]["families"]
    assert not any(got[k]["n_unknown"] or got[k]["families"] for k in range(40))


def test_empty(docs):
    assert licences.licences(docs([]).limit(0)).count() == 0


WRAPPED = {
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "gpl": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License",
    "lgpl": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
}


def test_notices_broken_into_lines(docs, text):
    import textwrap

    rows = [(k, text(k, 40) + "\n" + text(k + 500, 30)) for k in range(40)]
    cases = {100 * (n + 1) + width: (family, "\n".join(mark + x for x in textwrap.wrap(notice, width))) for n, (family, notice) in enumerate(WRAPPED.items()) for width, mark in ((72, ""), (40, "# "), (25, " * "))}
    rows += [(k, text(k, 12) + "\n" + t + "\n" + text(k + 1, 12)) for k, (_, t) in cases.items()]
    rows += [(900, "\n\n".join(textwrap.wrap(WRAPPED["bsd"], 30))), (901, "Licensed under the Foo Bar License."), (902, "Released under the MIT License.\n" + text(3, 9))]
    rows += [(903, "\n".join(textwrap.wrap(WRAPPED["gpl"], 40) + textwrap.wrap(WRAPPED["bsd"], 40)))]
    got = {r["id"]: r for r in licences.licences(docs(rows)).collect()}
    for k, (family, _) in cases.items():
        assert (list(got[k]["families"]), got[k]["n_notices"]) == ([family], 1), (k, got[k])
    assert not got[900]["families"]
    assert list(got[903]["families"]) == ["bsd", "gpl"] and got[903]["n_notices"] == 2
    assert (got[901]["n_notices"], got[901]["n_unknown"]) == (0, 1) and (got[902]["n_notices"], got[902]["n_unknown"]) == (1, 0)
    assert not any(r["families"] for k, r in got.items() if k < 100)
