from crossbook.llm import licences

FILES = "doc_id long, path string, text string, licence string, dir string"


def test_own_and_inherited(spark):
    rows = [
        (1, "a/LICENSE", "Released under the MIT License.\nmore text"), (2, "a/b/c/x.txt", "nothing here"), (3, "a/b/LICENSE.md", "Licensed under the Apache License, Version 2.0."),
        (4, "a/b/y.txt", "code\n// This work is licensed under the GNU General Public License, version 3.\ncode"), (5, "z/q.txt", None), (6, "z/r.txt", ""), (7, "a/q.txt", "no permission, said the man"),
        (8, "a/b/LICENSE-old", "Released under the MIT License"), (9, "a/b/c/d/LICENSE", "unknown terms, all licences refused by the owner"), (10, "a/b/c/d/f.txt", "x"),
    ]
    got = {r.doc_id: (r.licence, r.origin, r.licence_dir) for r in licences.scan(spark.createDataFrame([(*r, "l", "d") for r in rows], FILES)).collect()}
    assert got[1] == ("MIT", "own", None) and got[2] == ("Apache-2.0", "inherited", "a/b") and got[4] == ("GPL-3.0", "own", None)
    assert got[5] == (None, "none", None) == got[6] and got[7] == ("MIT", "inherited", "a") and got[3][0] == "Apache-2.0"
    assert got[9] == ("Apache-2.0", "inherited", "a/b") == got[10]


def test_paths_of_documents(make):
    df = licences.document_paths(make([(256, "x\nlicence"), (3, "A License\nx"), (4, "License"), (None, None)]))
    assert sorted(r.path for r in df.collect()) == ["s/LICENSE-3", "s/en/LICENSE-4", "s/en/d1/doc-256.txt", "s/en/dnone/doc-none.txt"]


def test_no_python_in_the_plan_and_empty(make):
    df = licences.scan(licences.document_paths(make([])))
    assert df.count() == 0
    assert "Python" not in (plan := df._jdf.queryExecution().executedPlan().toString()) and "Arrow" not in plan and "Cartesian" not in plan


def test_whole_licences_and_wrapped_headers(spark):
    """Known licences wrapped in comments or on one line; other notices stay unknown."""
    text = {i: t for i, (_, t) in enumerate(licences.TEMPLATES)}
    wrap = lambda t, mark: "\n".join(f"{mark} {' '.join(t.split()[i : i + 9])}" for i in range(0, len(t.split()), 9))
    at = {name: i for i, (name, t) in enumerate(licences.TEMPLATES) if len(t) > 200}
    rows = [
        (1, "p/a.py", wrap(text[at["GPL-3.0"]], "#") + "\nimport os\n"), (2, "p/b.c", "/*\n" + wrap(text[at["Apache-2.0"]], " *") + "\n */\nint x;"), (3, "q/LICENSE", "Copyright (c) 2020 Someone\n\n" + wrap(text[at["MIT"]], "")),
        (4, "q/x/y.js", "// SPDX-License-Identifier: MPL-2.0\nlet x"), (5, "r/z.js", "// SPDX-License-Identifier: Zlib\nlet x"), (6, "q/w.py", "x = 1"), (7, "r/s.py", wrap(text[at["GPL-2.0"]], "#")), (8, "s/COPYING", text[at["BSD-3-Clause"]]),
        (9, "s/t.txt", "a story of a licence " + "and other words " * 30_000), (9, "s/t.txt", "Released under the MIT License"), (9, "s/t.txt", "Released under the MIT License"),
    ]
    out = [(r.doc_id, r.licence, r.origin) for r in licences.scan(spark.createDataFrame([(*r, "l", "d") for r in rows], FILES)).collect()]
    got = {i: (n, o) for i, n, o in out}
    assert got == {1: ("GPL-3.0", "own"), 2: ("Apache-2.0", "own"), 3: ("MIT", "own"), 4: ("MPL-2.0", "own"), 5: (None, "none"), 6: ("MIT", "inherited"), 7: ("GPL-2.0", "own"), 8: ("BSD-3-Clause", "own"), 9: ("MIT", "own")}
    assert len(out) == len(rows)
