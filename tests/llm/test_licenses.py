import random

import pytest

from gristmill.llm import licenses as L

CATALOG = [
    {"license_id": "Elm-1.0", "title": "Elm Public License", "license_version": "1.0", "notice": "Anyone may use and share this program as long as the elm mark stays in every copy. The authors owe nothing to anyone for it.", "body": "Elm Public License\nVersion 1.0\n\nA holder is any person who receives the work. Silence is no promise.\n\nAnyone may use and share this program as long as the elm mark stays in every copy. The authors owe nothing to anyone for it."},
    {"license_id": "Elm-2.0", "title": "Elm Public License", "license_version": "2.0", "notice": "Anyone may use and share this program as long as the elm mark stays in every copy and no patent is claimed over it. The authors owe nothing to anyone for it.", "body": "Elm Public License\nVersion 2.0\n\nA holder is any person who receives the work. Silence is no promise.\n\nAnyone may use and share this program as long as the elm mark stays in every copy and no patent is claimed over it. The authors owe nothing to anyone for it."},
    {"license_id": "Birch-Lesser-1.1", "title": "Lesser Birch License", "license_version": "1.1", "notice": "Whoever passes these files on must pass on their source under the same birch terms, while linked works keep their own terms.", "body": "Lesser Birch License\nVersion 1.1\n\nA holder is any person who receives the work.\n\nWhoever passes these files on must pass on their source under the same birch terms, while linked works keep their own terms."},
    {"license_id": "Birch-1.1", "title": "Birch License", "license_version": "1.1", "notice": "Whoever sells copies must give a tenth to the birch council before winter and print its seal on the lid.", "body": "Birch License\nVersion 1.1\n\nSilence is no promise.\n\nWhoever sells copies must give a tenth to the birch council before winter and print its seal on the lid."},
]


@pytest.fixture(scope="module")
def r():
    return L.Reader(L.train(CATALOG))


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("// SPDX-License-Identifier: Elm-1.0\nx", {"Elm-1.0"}), ("# spdx-license-identifier : birch-lesser-1.1\n", {"Birch-Lesser-1.1"}), ("/* SPDX-License-Identifier: Elm-2.0 OR Birch-1.1 */", {"Elm-2.0", "Birch-1.1"}), (' * @license Birch-1.1\n', {"Birch-1.1"}), ("# License: Elm 2.0\n", {"Elm-2.0"}), ('__license__ = "Elm-1.0"\n', {"Elm-1.0"}), ('{"name": "x", "license": "Elm-2.0"}', {"Elm-2.0"}),
        ("# Licensed under the Lesser Birch License, Version 1.1 (the\n# \"License\"); you may not", {"Birch-Lesser-1.1"}), ("// released under the terms of the\n// Elm Public License v2.\n\npackage a", {"Elm-2.0"}), (" * on the conditions of the Elm Public\n * Licence (version 1.0), as published", {"Elm-1.0"}), ("This project uses the Birch License 1.1.", {"Birch-1.1"}),
        (CATALOG[0]["body"], {"Elm-1.0"}), (CATALOG[1]["notice"].upper(), {"Elm-2.0"}), ("# " + CATALOG[2]["notice"].replace(" ", "\n# ", 8), {"Birch-Lesser-1.1"}), (CATALOG[3]["notice"].replace("a tenth", "one tenth").replace("print", "put"), {"Birch-1.1"}),
        ("// See LICENSE for the terms of use.\n", set()), ('ALLOWED = ["Elm-1.0", "Birch-1.1", "Elm-2.0"]\n', set()), ("# Terms: ask the elm team.", set()), ("Elm Public License, Version 3.0", set()), ("/*! elm 1.0.5 */", set()), ("A holder is any person who receives the work. Silence is no promise.", set()), ("You can do what you like with the elm, except on Tuesdays.", set()), ("", set()),
    ],
)
def test_statements(r, text, want):
    assert r.statements(text) == want


def test_held_out_accuracy(r):
    rng = random.Random(99)  # other variants than those of the training seed
    samples = L._samples(sorted(CATALOG, key=lambda c: c["license_id"]), rng, 30)
    ids = [c["license_id"] for c in sorted(CATALOG, key=lambda c: c["license_id"])]
    right = sum(r.m.classify(t)[0] == (ids[k] if k < len(ids) else L.NONE) for t, k in samples if t)
    assert right / len(samples) > 0.9


def test_same_catalogue_same_model():
    a, b = L.train(CATALOG, per=4, epochs=10), L.train(list(reversed(CATALOG)), per=4, epochs=10)
    assert a.ids == b.ids and all((a.weights[k] == b.weights[k]).all() for k in a.weights)


@pytest.mark.parametrize(
    ("meta", "want"),
    [
        ('{"license": "Elm-1.0"}', {"Elm-1.0"}), ('{"license": {"key": "birch-1.1", "name": null}}', {"Birch-1.1"}), ('{"license": {"key": "other", "spdx_id": "NOASSERTION", "name": "Elm Public License, Version 2.0"}}', {"Elm-2.0"}), ('{"license": null}', set()), ("{}", set()), (None, set()), ('{"license": {"key"', set()), ('{"license": {"key": "other", "name": "Other"}}', set()), ('{"license": ["Elm-1.0", "Birch-1.1"]}', {"Elm-1.0", "Birch-1.1"}), ("[1]", set()),
    ],
)
def test_metadata(r, meta, want):
    assert L.metadata_statements(meta, r) == want


def test_rows(spark):
    cat = spark.createDataFrame([(c["license_id"], c["title"], c["license_version"], c["notice"], c["body"]) for c in CATALOG], "license_id string, title string, license_version string, notice string, body string")
    repos = spark.createDataFrame([(1, "a", '{"license": "Elm-1.0"}'), (2, "b", None), (3, "c", '{"license": "Elm-1.0"}'), (4, "b", "{}")], "id long, repo_name string, metadata string")
    files = [(10, 1, "LICENSE", CATALOG[0]["body"]), (11, 1, "src/a.py", "x = 1"), (12, 1, "lib/x/b.py", "# SPDX-License-Identifier: Birch-1.1"), (13, 1, "lib/LICENSE.txt", CATALOG[1]["body"]), (14, 1, "lib/y/z.py", "q"), (20, 2, "Copying", CATALOG[2]["body"]), (20, 2, "Copying", CATALOG[2]["body"]), (30, 3, "LICENCE.md", CATALOG[3]["body"]), (31, 3, "x", None), (32, 3, None, ""), (40, 9, "LICENSE", CATALOG[3]["body"]), (41, None, "LICENSE", "")]
    df = spark.createDataFrame([(*f, "clash") for f in files], "file_id long, repo_id long, path string, content string, license_id string")
    rows = L.license_rows(df, repos, cat).cache()
    assert sorted((r.key_id, r.license_id) for r in rows.filter("subject_kind = 'file'").collect()) == [(10, "Elm-1.0"), (12, "Birch-1.1"), (13, "Elm-2.0"), (20, "Birch-Lesser-1.1"), (30, "Birch-1.1"), (40, "Birch-1.1")]
    assert {r.key_id: r.license_id for r in rows.filter("subject_kind = 'repo'").collect()} == {1: "Elm-1.0", 2: "Birch-Lesser-1.1", 3: "CONFLICT", 4: "UNKNOWN"}
    eff = {r.file_id: (r.license_id, r.source) for r in L.effective_licenses(df, rows).collect()}
    assert eff[11] == ("Elm-1.0", "folder") and eff[12] == ("Birch-1.1", "file") and eff[14] == ("Elm-2.0", "folder") and eff[31][0] == "Birch-1.1" and eff[32] == ("CONFLICT", "repository") and eff[41] == ("UNKNOWN", "none")
    assert L.license_rows(df.limit(0), repos.limit(0), cat).count() == 0
