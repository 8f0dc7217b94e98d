import os

import pytest
from docquery.llm import licenses

GNU = "/usr/share/common-licenses"


def test_variants_and_whole_texts(spark):
    mit = next(t for i, t in licenses.KNOWN if i == "MIT" and "hereby granted" in t)
    bsd = next(t for i, t in licenses.KNOWN if i == "BSD-3-Clause" and "Redistributions" in t)
    header = next(t for i, t in licenses.KNOWN if i == "Apache-2.0" and "compliance" in t)
    words = mit.split()
    wrapped = "\n".join(" # " + " ".join(words[at : at + 9]) for at in range(0, len(words), 9))
    rows = [
        (1, "Copyright (c) 2024 Jane Roe\n\n" + mit.upper().replace("SUBLICENSE", "sub-licence")),
        (2, "Some text here.\nlicensed under the apache licence v2.0\nMore text. Released under the MIT Licence!"),
        (3, "Released under the MIT License."),
        (4, None),
        (5, ""),
        (6, "This line speaks of a license but is none."),
        (7, "\u00a9 1999 somebody"),
        (None, "Licensed under CC BY-NC 4.0"),
        (8, "Licensed under CC BY 4.0\n" * 3 + "x" * 300_000),
        (3, "Released under the MIT License."),
        (9, "The MIT License (MIT)\n\nCopyright (c) Jane Roe\nAll rights reserved.\n\n" + mit),
        (10, "prose before\n" * 2000 + wrapped + "\nprose after\n" + bsd + "\n" + header),
        (11, mit.rsplit(" ", 1)[0]),
        (12, "x\n" * 50_000 + "Released under CC0 1.0"),
    ]
    docs = spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, licenses string")
    got = sorted((tuple(r) for r in licenses.scan(docs).collect()), key=repr)
    want = [(1, "MIT", 1, "MIT"), (2, None, 1, "Apache-2.0"), (3, "MIT", 1, "MIT"), (3, "MIT", 1, "MIT"), (4, None, 0, ""), (5, None, 0, ""), (6, None, 0, ""), (7, None, 0, ""), (None, "CC-BY-NC-4.0", 1, "CC-BY-NC-4.0"), (8, None, 3, "CC-BY-4.0")]
    want += [(9, "MIT", 1, "MIT"), (10, None, 3, "Apache-2.0,BSD-3-Clause,MIT"), (11, None, 0, ""), (12, None, 1, "CC0-1.0")]
    assert got == sorted(want, key=repr)
    assert licenses.scan(docs.limit(0)).count() == 0


def test_own_table_of_known_texts(spark):
    own = licenses.known_table(spark, (("b-own", "Use of this work is free for all."), ("a-own", "Use of this work is free, for all!"), ("c-own", "GPL 2"), ("d-own", "v2.0")))
    docs = spark.createDataFrame([(1, "Use of this work\nis free for all"), (2, "x\nGNU General Public Licence 2.0\ny"), (3, "Released under the MIT License."), (4, "version 2")], "doc_id long, text string")
    assert sorted(tuple(r) for r in licenses.scan(docs, own).collect()) == [(1, "a-own", 1, "a-own"), (2, None, 1, "c-own"), (3, None, 0, ""), (4, "d-own", 1, "d-own")]
    assert {r.licenses for r in licenses.scan(docs, own.limit(0)).collect()} == {""}


@pytest.mark.skipif(not os.path.exists(f"{GNU}/GPL-3"), reason="no folder of licence texts")
def test_folder_of_whole_texts(spark):
    names = [n for n in ("Apache-2.0", "GPL-3", "LGPL-2.1", "MPL-2.0", "CC0-1.0") if os.path.exists(f"{GNU}/{n}")]
    rows = []
    for i, n in enumerate(names):
        words = open(f"{GNU}/{n}", encoding="utf-8").read()
        rows += [(i, words), (100 + i, "Some prose.\n" + words.replace("license", "licence") + "\nMore prose.")]
    known = licenses.known_files(spark, f"{GNU}/{{{','.join(names)}}}")
    got = {r.doc_id: (r.whole_license, r.licenses) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"), known).collect()}
    for i, n in enumerate(names):
        assert got[i][0] == n and n in got[100 + i][1].split(",")
