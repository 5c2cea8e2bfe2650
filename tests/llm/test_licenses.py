from pathlib import Path

from signet.llm import licenses as L

MIT = dict(L.TEXTS)["MIT"]


def found(spark, rows):
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, license string")
    return sorted((r.doc_id or 0, r.line, r.license) for r in L.scan(docs).collect())


def test_whole_texts_whatever_their_form(spark):
    wrapped = "MIT License\n\nCopyright (c) 2020 Some Body\n\n" + MIT.replace(", ", ",\n   ").upper().replace('"', "''")
    british = dict(L.TEXTS)["Zlib"].replace("acknowledgment", "acknowledgement")
    near = MIT.replace("without limitation", "with limitation")
    got = found(spark, [(1, MIT), (2, wrapped), (3, british), (4, near), (5, None), (6, ""), (7, " \n"), (8, "word " * 20_000)])
    assert got == [(1, 0, "MIT"), (2, 0, "MIT"), (3, 0, "Zlib")]


def test_all_known_texts_are_told_apart(spark):
    rows = L.known(spark).collect()
    assert len({r.digest for r in rows if r.whole}) == len(L.TEXTS)


def test_notices_within_texts_ties_and_no_rows(spark):
    text = "some words\n  released under the MIT Licence \nmore\nReleased under the MIT License.\nnot released under the MIT License"
    assert found(spark, [(1, text), (1, text), (None, "x\nSPDX-License-Identifier: MIT")]) == [(0, 2, "MIT"), (1, 2, "MIT"), (1, 2, "MIT"), (1, 4, "MIT"), (1, 4, "MIT")]
    assert found(spark, []) == []


def test_the_common_long_texts_and_their_spdx_lines(spark):
    files = {p.stem: p.read_text() for p in (Path(L.__file__).parent / "license_texts").glob("*.txt")}
    assert {"Apache-2.0", "GPL-2.0-only", "GPL-3.0-only", "LGPL-2.1-only", "LGPL-3.0-only", "MPL-2.0", "CC0-1.0"} <= files.keys()
    names = sorted(files)
    rows = [(i, files[name].upper().replace(";", " ;")) for i, name in enumerate(names, 1)]
    short = files["Apache-2.0"].partition("APPENDIX")[0]
    lines = ["GPL-2.0-or-later", "LGPL-2.1-only", "MPL-2.0", "ISC", "AGPL-3.0-only"]
    rows += [(100, short), (101, files["GPL-2.0-only"].replace("everyone", "no one")), (102, "\n".join(f"# SPDX-License-Identifier: {x}" for x in lines))]
    got = [r for r in found(spark, rows) if r[1] == 0 or r[0] == 102]
    assert got == [(i, 0, name) for i, name in enumerate(names, 1)] + [(100, 0, "Apache-2.0")] + [(102, i, x) for i, x in enumerate(lines, 1)]


def test_a_table_of_known_texts(spark):
    docs = spark.createDataFrame([(1, "my OWN terms"), (2, MIT), (3, "a\nown notice\n")], "doc_id long, text string")
    texts = spark.createDataFrame([("Own", "My own terms.", True), ("Own", "Own notice", False)], "license string, text string, whole boolean")
    assert sorted(tuple(r) for r in L.scan(docs, texts).collect()) == [(1, 0, "Own"), (1, 1, "Own"), (3, 2, "Own")]
