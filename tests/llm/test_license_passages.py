"""Full licence texts inside documents are found by their passages."""

from pathlib import Path

import pytest

from tempora.llm import license_scan

MIT = """MIT License

Copyright (c) 2026 Somebody

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.
"""
FOLDER = Path("/usr/share/common-licenses")


def _found(spark, text):
    return {r.license for r in license_scan.scan(spark.createDataFrame([(1, f"def f():\n    return 1\n{text}\nother code")], "doc_id long, text string")).collect()}


def test_mit_text(spark):
    assert _found(spark, MIT) == {"mit-text"}
    assert _found(spark, "\n".join(f"# {line}" for line in MIT.splitlines())) == {"mit-text"}


@pytest.mark.parametrize(("file", "name"), [("Apache-2.0", "apache-2.0-text"), ("BSD", "bsd-2-clause-text"), ("GPL-2", "gpl-2.0-text"), ("GPL-3", "gpl-3.0-text"), ("LGPL-3", "lgpl-3.0-text"), ("MPL-2.0", "mpl-2.0-text")])
def test_full_texts(spark, file, name):
    if not (FOLDER / file).exists():
        pytest.skip("no licence texts here")
    assert name in _found(spark, (FOLDER / file).read_text())


def test_each_passage_finds_itself(spark):
    for name, body in license_scan.PASSAGES.items():
        words = body.split()
        assert name in _found(spark, "\n".join(" ".join(words[i : i + 8]) for i in range(0, len(words), 8))), name
