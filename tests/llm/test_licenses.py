import math
import re
from collections import Counter

from stresslens.llm import licenses


def test_detection_and_inheritance(spark):
    rows = [
        (1, "a/LICENSE", "Released under the MIT License."),
        (2, "a/b/x.txt", "no notice here"),
        (3, "a/b/c/y.txt", "some words\nLicensed under the Apache License, Version 2.0.\nmore words and more and more and more and more words"),
        (4, "a/b/c/z.txt", None),
        (5, "d/w.txt", "nothing"),
        (6, "e/COPYING", "This work is licensed under the GNU General Public License, version 3."),
        (7, "e/f/g/h/i.txt", ""),
        (8, "e/f/LICENSE.md", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
        (9, None, "Released under the MIT License. But this has many other words in it, so that it is a header and not a file"),
        (10, None, "nothing"),
        (11, "a/b/odd.txt", "my driving license is lost"),
        (1, "a/LICENSE", "Released under the MIT License."),
    ]
    df = spark.createDataFrame([(*r, "x") for r in rows], "id long, path string, text string, license string")
    got = sorted(((x.id, x.license, x.kind, x.license_path) for x in licenses.scan(df).collect()), key=str)
    want = [
        (1, "MIT", "file", "a/LICENSE"),
        (1, "MIT", "file", "a/LICENSE"),
        (2, "MIT", "inherited", "a/LICENSE"),
        (3, "Apache-2.0", "header", "a/b/c/y.txt"),
        (4, "MIT", "inherited", "a/LICENSE"),
        (5, None, "none", None),
        (6, "GPL-3.0", "file", "e/COPYING"),
        (7, "CC-BY-4.0", "inherited", "e/f/LICENSE.md"),
        (8, "CC-BY-4.0", "file", "e/f/LICENSE.md"),
        (9, "MIT", "header", None),
        (10, None, "none", None),
        (11, "MIT", "inherited", "a/LICENSE"),
    ]
    assert got == sorted(want, key=str)
    assert licenses.scan(df.limit(0)).count() == 0


def test_cosine_against_brute_force(spark):
    texts = [t for _, t in licenses.TEMPLATES] + ["license for the public, version 2.0 of something", "Copyright somebody"]
    words = lambda t: [w for w in re.sub(r"[^\w.]+|_|\.(?![0-9])", " ", t.lower()).split(" ") if w]
    df = spark.createDataFrame([(i, f"{i}/f", t) for i, t in enumerate(texts)], "id long, path string, text string")
    got = {x.id: (x.license, x.score) for x in licenses.scan(df, threshold=0.0).where("kind in ('file', 'header')").collect()}
    header = lambda t: " ".join(x for x in re.split(r"\n|(?<=[.!?;])\s+", t) if re.search(licenses.CUES[4:], x, re.I))
    cue = [header(t) for t in texts if header(t)]
    count = Counter(w for t in cue + [t for _, t in licenses.TEMPLATES] for w in set(words(t)))
    n = len(cue) + len(licenses.TEMPLATES)
    vocabulary = {w for _, t in licenses.TEMPLATES for w in words(t)}
    weigh = lambda t: {w: (1 + math.log(k)) * (math.log((n + 1) / (count[w] + 1)) + 1) for w, k in Counter(words(t)).items() if w in vocabulary}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    for i, t in enumerate(texts):
        v = weigh(header(t))
        if not v:
            continue
        best = max(sum(v[w] * u.get(w, 0) for w in v) / norm(v) / norm(u) for u in (weigh(x) for _, x in licenses.TEMPLATES))
        assert abs(got[i][1] - best) < 1e-6
