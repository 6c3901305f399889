from rows import make_docs  # noqa: F401

from lumentab.llm import licences as L

NOTICE = "licence string, text string"


def scan(spark, make_docs, rows, notices=None):
    table = L.default_notices(spark) if notices is None else spark.createDataFrame(notices, NOTICE)
    return sorted(((r["doc_id"] or 0, r["whole_licence"], r["licences"], r["n_lines"]) for r in L.scan_licences(make_docs(rows), table).collect()), key=repr)


def test_spellings_and_copyright_lines(spark, make_docs):
    rows = [
        (1, "Copyright (c) 2019 Some Body\n\nRELEASED under the MIT-Licence!!"),
        (2, "words\nreleased under the MIT license\nmore words\nAll rights reserved"),
        (3, "Licensed under Creative Commons Attribution-NonCommercial 4.0."),
        (4, "Licenced under the Apache License, v 2.0"),
        (5, "we copyright nothing and release under the MIT license plan"),
    ]
    got = scan(spark, make_docs, rows)
    assert got == [
        (1, "MIT", ["MIT"], 1), (2, None, ["All-Rights-Reserved", "MIT"], 2), (3, "CC-BY-NC-4.0", ["CC-BY-NC-4.0"], 1), (4, "Apache-2.0", ["Apache-2.0"], 1), (5, None, [], 0),
    ]


def test_whole_texts_of_several_lines(spark, make_docs):
    notices = [("Long", "First line of it.\nSecond line of it."), ("B", "same words"), ("A", "SAME: words")]
    got = scan(spark, make_docs, [(1, "first line of it\n\n\nsecond  line, of it"), (2, "same words"), (3, "First line of it.")], notices)
    assert got == [(1, "Long", [], 0), (2, "A", ["A"], 1), (3, None, [], 0)]


def test_odd_rows(spark, make_docs):
    rows = [(1, None), (2, ""), (3, "(c) 2020"), (None, "All rights reserved."), (4, "All rights reserved.\n" * 3), (4, "All rights reserved.\n" * 3), (5, "x" * 200000)]
    got = scan(spark, make_docs, rows)
    assert got == sorted([(1, None, [], 0), (2, None, [], 0), (3, None, [], 0), (0, "All-Rights-Reserved", ["All-Rights-Reserved"], 1), (4, None, ["All-Rights-Reserved"], 3), (4, None, ["All-Rights-Reserved"], 3), (5, None, [], 0)], key=repr)
    assert scan(spark, make_docs, []) == []
    assert scan(spark, make_docs, [(1, "All rights reserved.")], [("none", "")]) == [(1, None, [], 0)]


def test_full_texts_and_texts_inside_a_document(spark, make_docs):
    texts = {r["licence"]: r["text"] for r in L.default_notices(spark).collect()}
    mit = texts["MIT"]
    rows = [
        (1, "Copyright (c) 2019 Some Body\n\n" + mit),
        (2, "# a file\n# Copyright (c) 2019 Some Body\n" + "\n".join("# " + x for x in mit.splitlines()) + "\nimport os\n"),
        (3, "words\nLicensed under the Apache\nLicense, Version 2.0.\nwords"),
        (4, "this file is released under the MIT license and more"),
        (5, "Licensed under Creative\nCommons Attribution 4.0.\nwords"),
        (6, " ".join(mit.split())), (7, texts["Apache-2.0"]), (8, mit.replace("merge, ", "") + "x"),
    ]
    got = {r[0]: r[1:3] for r in scan(spark, make_docs, rows)}
    assert got[1] == ("MIT", []) and got[6] == ("MIT", ["MIT"])
    assert got[2] == (None, ["MIT"]) and got[4] == (None, ["MIT"]) and got[8] == (None, [])
    assert got[3] == (None, ["Apache-2.0"]) and got[5] == (None, ["CC-BY-4.0"])
    assert got[7][0] == "Apache-2.0"
