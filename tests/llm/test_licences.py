from tests.llm.helpers import AWKWARD, documents, plain
from wayfare.llm import licences as L


def look(spark, texts):
    docs = documents(spark, [(i, t, None, None) for i, t in enumerate(texts)])
    known = L.known(spark)
    return {r.doc_id: (r.licence, list(r.notices)) for r in L.notices(L.lookup(docs, known), known).collect()}


def test_spelling_case_marks_and_copyright_lines_do_not_matter(spark):
    shout = L.MIT.upper().replace("LICENSE", "LICENCE").replace(",", " ;").replace("SUBLICENSE", "sub-license")
    got = look(spark, [L.MIT, "MIT Licence\n\nCopyright (c) 2020 Someone, Inc.\n\n" + shout, "/* © 1999 A. Author */\n# (C) 2001 B\n" + L.ZLIB, L.ISC + " and more", L.MIT[:-20]])
    assert {k: v[0] for k, v in got.items()} == {0: "MIT", 1: "MIT", 2: "Zlib", 3: None, 4: None}


def test_permission_text_that_speaks_of_copyright_stays(spark):
    # only whole copyright lines go: "COPYRIGHT HOLDERS BE LIABLE" begins a line of the text itself in one layout
    flat = " ".join(L.MIT.split())
    assert look(spark, [flat, flat.replace("notice", "note")]) == {0: ("MIT", ["MIT"]), 1: (None, [])}


def test_notices_are_whole_lines(spark):
    got = look(spark, ["Some prose.\nLicensed under the Apache Licence, version 2.0\nmore\n\nAll rights reserved", "Licensed under CC BY-NC 4.0.", "it is not Licensed under CC BY-NC 4.0."])
    assert got == {0: (None, ["Apache-2.0", "all-rights-reserved"]), 1: ("CC-BY-NC-4.0", ["CC-BY-NC-4.0"]), 2: (None, [])}


def test_awkward_rows(spark):
    docs = documents(spark, AWKWARD)
    got = L.lookup(docs, L.known(spark))
    assert set(got.columns) == {*docs.columns, "licence"} and got.count() == len(AWKWARD)
    assert all((r.digest is None) == (r.text is None) and r.licence is None for r in got.collect())
    assert L.lookup(documents(spark, []), L.known(spark)).count() == 0


def test_ties_and_empty_known_texts(spark):
    rows = spark.createDataFrame([("B", "one two"), ("A", "One, two!"), ("C", "..."), ("D", "Copyright 2020 X")], "licence string, text string")
    assert plain(L.known_of(rows), "licence") == [("A",)]


def test_all_in_the_jvm(spark):
    known = L.known(spark)
    plan = L.notices(L.lookup(documents(spark, AWKWARD), known), known)._jdf.queryExecution().toString()
    assert "PythonUDF" not in plan and "MapInArrow" not in plan


def test_any_number_of_known_texts(spark, monkeypatch):
    texts = ["Some prose.\nLicensed under the Apache Licence, version 2.0\nmore\n\nAll rights reserved", None, "", "All rights reserved\nAll rights reserved.", "none"]
    docs = documents(spark, [(5, t, None, None) for t in texts] + AWKWARD)
    known = L.known(spark)
    few = plain(L.notices(docs, known), "doc_id", "text", "notices")
    monkeypatch.setattr(L, "SEND", 2)
    many = L.notices(docs, known)
    assert plain(many, "doc_id", "text", "notices") == few and set(many.columns) == {*docs.columns, "notices"}
    assert sum(bool(n) for *_, n in few) == 2
