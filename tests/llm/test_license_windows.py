"""Windows of license headers: the same over blocks as cut one by one, and headers deep in long texts."""

import random
import re

from pyspark.sql import functions as F

from tidemark.llm import licenses


def _by_hand(text):
    units = [u for u in re.split(r"\n|(?<=[.;:!?])[ \t]+", text) if re.search("[A-Za-z0-9]", u)]
    anchor = re.compile(r"licen[cs]|rights reserved|permission|redistribution|copyright", re.I)
    starts = {s for i, u in enumerate(units) if anchor.search(u) for s in range(max(i - licenses.BEFORE, 0), i + 1)}
    n = len(units)
    for s in starts:
        for w in licenses.WIDTHS:
            if w == 1 or s + w <= n or s + w - n < w / 3:
                yield s, w, tuple(re.findall(licenses.TERM, " ".join(units[s : s + w]).lower()))


def test_windows_over_blocks(spark):
    random.seed(11)
    words = ["license", "the", "copyright", "v 2.0", "data", "of", "x", "--"]
    texts = ["\n".join(" ".join(random.choices(words, weights=[1, 9, 1, 9, 9, 9, 9, 9], k=random.randint(0, 5))) + random.choice(["", ".", "; b"]) for _ in range(n)) for n in (1, 3, 63, 64, 65, 67, 128, 300)]
    texts += ["", "\n\n", "no anchor at all", *["\n".join(["x"] * k + ["license"]) for k in (60, 61, 64, 66, 67, 130)]]
    rows = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "digest string, text string")
    got = [(r["digest"], r["start"], r["width"], tuple(r["terms"])) for r in licenses._header_windows(rows).collect()]
    assert len(got) == len(set(got))
    assert set(got) == {(str(i), *w) for i, t in enumerate(texts) for w in _by_hand(t)}


def test_headers_in_a_long_text(spark):
    """A header far down, among thousands of lines that look like license lines, is found as it is when alone."""
    header = dict(licenses.HEADERS)["MPL-2.0"].replace(". ", ".\n")
    noise = [f"license value {i} of model row {i * 7}" for i in range(3000)]
    rows = [("a/long", "\n".join([*noise[:2500], header, *noise[2500:]])), ("b/alone", header), ("c/noise", "\n".join(noise))]
    found = {r["path"]: r["license"] for r in licenses.detect_texts(spark.createDataFrame(rows, "path string, text string")).select("path", "license").collect()}
    assert found == {"a/long": "MPL-2.0", "b/alone": "MPL-2.0"}
    assert spark.createDataFrame(rows, "path string, text string").filter(F.length("text") > 100_000).count() == 2
