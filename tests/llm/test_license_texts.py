"""Whole license texts as real documents hold them."""

import os

import pytest

from tidewatch.llm import licenses

COMMON = "/usr/share/common-licenses"
FILES = {"Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0"}


def found(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r["license_id"] for r in licenses.license_report(docs).orderBy("doc_id").collect()]


def test_headings_and_whole_texts(spark):
    of = dict(licenses.LICENSES)
    mit, isc = of["MIT"].removeprefix("MIT License\n"), of["ISC"].removeprefix("ISC License\n")
    note = "Copyright (c) 2020 Some One\n\n"
    texts = [note + mit, "The MIT License (MIT)\n\n" + note + mit, note + isc, note + of["BSD-3-Clause"].split("\n", 1)[1], "For a while " + mit]
    assert found(spark, texts) == ["MIT", "MIT", "ISC", "BSD-3-Clause", None]
    assert "In jurisdictions that recognize copyright laws" in of["Unlicense"] and "unlicense.org" in of["Unlicense"]
    assert found(spark, [of["Unlicense"], "The Unlicense\n" + of["Unlicense"], of["Unlicense"][:400]]) == ["Unlicense", "Unlicense", None]
    assert found(spark, [of["Apache-2.0"].split("APPENDIX")[0], "Copyright 2004 X\n" + of["WTFPL"]]) == ["Apache-2.0", "WTFPL"]


@pytest.mark.skipif(not os.path.isdir(COMMON), reason="no system license texts")
def test_system_license_texts(spark):
    texts = [open(f"{COMMON}/{f}", encoding="utf-8").read() for f in FILES]
    assert found(spark, texts) == list(FILES.values())
