import random
import string

import pytest

from tamis.llm import licenses


def shingles(text):
    text = "".join(c.lower() if c.isascii() else c for c in text or "")
    for c in "\t\n\x0b\f\r":
        text = text.replace(c, " ")
    words = [w for w in (w.strip(string.punctuation) for w in text.split(" ")) if w]
    return [" ".join(words[k : k + 5]) for k in range(len(words) - 4)]


def brute(text):
    own, best, found = shingles(text), 0.0, set()
    for name, template in licenses.TEMPLATES:
        want = set(shingles(template))
        for at in range(0, len(own), len(want)):
            share = len(want & set(own[at : at + 2 * len(want)])) / len(want)
            if share >= 0.8:
                found.add(name)
                best = max(best, share)
    return sorted(found), best


def test_scan_equals_brute_force(docs):
    rng = random.Random(10)
    rows = []
    for k in range(150):
        notice = rng.choice(licenses.TEMPLATES)[1].split()
        if rng.random() < 0.5:
            notice[rng.randrange(len(notice))] = "changed"
        around = lambda: ["w%d" % rng.randint(0, 50) for _ in range(rng.randint(0, 40))]
        rows.append((k, rng.choice([" ", "\n ", "\t"]).join(around() + (notice if k % 3 else []) + around()).title()))
    rows += [(900, None), (901, ""), (902, " \n "), (903, "released under the mit"), rows[1], (None, rows[1][1])]
    rows += [(904, " ".join(t for _, t in licenses.TEMPLATES)), (905, "Released under the MIT License. " * 2000)]
    got = sorted(((r["doc_id"], list(r["licenses"]), r["n_licenses"], round(r["containment"], 9)) for r in licenses.scan(docs(rows)).collect()), key=str)
    assert got == sorted(((i, brute(t)[0], len(brute(t)[0]), round(brute(t)[1], 9)) for i, t in rows), key=str)


def test_notices_inside_sentences_and_further_licenses(docs):
    lesser = "redistribute it under the terms of the GNU {} General Public License as published by the Free Software Foundation; either"
    rows = {
        "Released under the MIT License, see LICENSE": "MIT", "It is released under the MIT License and more": "MIT",
        "Licensed under the Apache License, Version 2.0 and others": "Apache-2.0", "Licensed under the Apache License, Version 2.0, as is": "Apache-2.0",
        "Licensed under CC BY-NC 4.0, by us": "CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0 by us": "CC-BY-NC-4.0",
        lesser.format("Lesser"): "LGPL", lesser.format("Affero"): "AGPL-3.0", lesser.replace("{} ", ""): "",
        lesser.format("Lesser") + " version 3 of the License": "LGPL", lesser.format("Affero") + " version 3 of the License": "AGPL-3.0",
        lesser.replace("{} ", "") + " version 2 of the License": "GPL-2.0", lesser.replace("{} ", "") + " version 3 of the License": "GPL-3.0",
        "This is free and unencumbered software released into the public domain. Anyone is free": "Unlicense",
    }
    rows |= {f"Released under the MIT License{mark}": "MIT" for mark in (";", ")", ":", "!!", " -- see above", '"')}
    rows |= {
        "/*\n * Licensed under the Apache License, Version 2.0 (the \"License\");\n * you may not use this file except in\n"
        " * compliance with the License.\n */": "Apache-2.0",
        "# This program is free software: you can redistribute it and/or modify\n# it under the terms of the GNU General Public License as\n"
        "# published by the Free Software Foundation, either version 3 of\n# the License, or (at your option) any later version.": "GPL-3.0",
        "." * 300_000 + " (Licensed under CC BY-NC 4.0) " + "!? " * 100_000: "CC-BY-NC-4.0", " ... !? ": "",
    }
    rows |= {f"so {text} and more": name for name, text in licenses.TEMPLATES if name in ("ISC", "EPL-2.0", "Zlib")}
    got = {r["doc_id"]: list(r["licenses"]) for r in licenses.scan(docs(list(enumerate(rows)))).collect()}
    assert got == {at: [name] if name else [] for at, name in enumerate(rows.values())}


def test_bands_retrieve_nearly_surely_and_short_templates_are_refused(docs):
    assert licenses.collision_probability() > 0.999999
    with pytest.raises(ValueError):
        licenses.scan(docs([(1, "x")]), templates=(("X", "too short"),))
    assert licenses.scan(docs([])).count() == 0


def test_no_python_in_the_plan(docs):
    plan = licenses.scan(docs([(1, "Released under the MIT License.")]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan
