"""Wrapped and embedded licence notices inside long documents, against plain versions."""

import math
import random
import re

import pytest

from tempora.llm import license_scan

FILLER = "other words of the text go on under the sun and so on"


def _scan(spark, texts, **options):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {(r.doc_id, r.license): (r.n_units, r.dice) for r in license_scan.scan(rows, **options).collect()}


def _wrapped(name, width=7, margin=""):
    words = license_scan.TEMPLATES[name].split()
    return f"\n{margin}".join(" ".join(words[i : i + width]) for i in range(0, len(words), width))


@pytest.mark.parametrize("name", ["apache-2.0", "apache-2.0-header", "bsd-3-clause", "gpl-3.0-header", "mpl-2.0"])
def test_wrapped_inside_long_text(spark, name):
    lines = "\n".join(f"{FILLER} in line{i} and{i} the{i} end" for i in range(200))
    got = _scan(spark, [f"{lines}\n{_wrapped(name)}\n{lines}", f"{lines}\n * {_wrapped(name, 9, ' * ')}\n{lines}"])
    assert got[0, name] == got[1, name] == (1, 1.0)


def test_embedded_and_repeated(spark):
    run_on = f"{FILLER} released under the mit license {FILLER}"
    got = _scan(spark, [
        f"{FILLER} " * 40 + run_on + f" {FILLER}" * 40,
        f"{FILLER}\nReleased under the MIT License.\n{FILLER} released\nunder the MIT license {FILLER}",
        f"{run_on}\n{FILLER}\n{FILLER} released under an MIT license {FILLER}\n{FILLER} " * 3,
        f"{FILLER}\nrights of all\n{FILLER}",
    ])
    assert got == {(0, "mit"): (1, 1.0), (1, "mit"): (1, 1.0), (2, "mit"): (1, 1.0)}


def _brute(text, template, threshold):
    """The best coefficient of any run of words from the template's length to three halves that begins with a bigram of it, or ends the text."""
    words, pattern = re.findall(r"[a-z]+", text), template.split()
    pairs, t = list(zip(words[:-1], words[1:], strict=True)), set(zip(pattern[:-1], pattern[1:], strict=True))
    best, length = 0.0, len(pattern) - 1
    for at in range(len(pairs) - length + 1):
        if pairs[at] in t or at == len(pairs) - length:
            for size in range(length, max(length, math.floor(len(t) * (2 - threshold) / threshold + 1e-9)) + 1):
                own = set(pairs[at : at + size])
                best = max(best, 2 * len(own & t) / (len(own) + len(t)))
    return best


def test_windows_are_exhaustive(spark):
    rng = random.Random(5)
    template = "a b c d e f a c"
    texts = ["\n".join(" ".join(rng.choice("abcdef") if rng.random() < 0.3 else w for w in template.split()) + " x" * rng.randint(0, 3) for _ in range(rng.randint(1, 4))) for _ in range(120)]
    texts = [("y " * 30 + t + " z" * 30) for t in texts]
    got = _scan(spark, texts, templates={"t": template})
    hits = 0
    for i, text in enumerate(texts):
        best = _brute(text.replace("\n", " "), template, 0.8)
        assert ((i, "t") in got) == (best >= 0.8), text
        hits += best >= 0.8
    assert 20 < hits < 120
