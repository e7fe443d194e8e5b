import math
import random
import re
from collections import Counter

import pytest

from glyphsieve.llm import licenses
from glyphsieve.llm.license_texts import TEMPLATES as T

TEXTS = {name: text for name, kind, text in T if kind == "text"}
NOTICES = {name: text for name, kind, text in reversed(T) if kind == "notice"}
MIT, GPL = "Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3."


def tokens(text):
    return [w for w in re.split("[^a-z0-9]+", "".join(c.lower() if c.isascii() else c for c in text)) if w]


def brute(files, aligned):
    """path -> (licence, cosine) of the best window of a template's size, anywhere or where an anchor is in place."""
    texts = [t for _, _, t in files if t is not None]
    vocabulary = {w for _, _, t in T for w in tokens(t)}
    df = Counter(w for t in texts for w in set(tokens(t)) & vocabulary)
    idf = lambda n: math.log((1 + len(texts)) / (1 + n)) + 1
    vector = lambda ws: {w: n * idf(df[w]) for w, n in Counter(ws).items()}
    anchors = licenses.Model(T, df, len(texts), licenses.THRESHOLD).anchors
    out = {}
    for _, path, text in files:
        w, found = tokens(text or ""), []
        for number, (name, _, t) in enumerate(T):
            own = tokens(t)
            u, places = vector(own), [(x, i) for i, x in enumerate(own) if (number, i) in anchors.get(x, [])]
            length = math.sqrt(sum(x * x for x in u.values()))
            for s in range(1 - len(own), len(w)):
                if aligned and not any(0 <= s + i < len(w) and w[s + i] == x for x, i in places):
                    continue
                v = vector(w[max(0, s) : max(0, s + len(own))])
                dot = sum(x * v.get(k, 0) for k, x in u.items())
                if dot:
                    found.append((-min(1.0, round(dot / length / math.sqrt(sum(x * x for x in v.values())), 6)), name, max(0, s)))
        if found and -min(found)[0] >= licenses.THRESHOLD:
            out[path] = (min(found)[1], -min(found)[0])
    return out


def run(spark, files, schema="doc_id long, path string, text string", **more):
    return {r.path: r for r in licenses.scan(spark.createDataFrame(files, schema).repartition(2), **more).collect()}


def test_headers_against_brute_force(spark):
    rng = random.Random(2)
    short = [t for _, _, t in T if len(tokens(t)) < 40]
    files = []
    for i in range(40):
        lines = [" ".join(rng.choice(["the", "of", "and", "License", "software", "version", "code", "free"]) for _ in range(rng.randint(0, 12))) for _ in range(rng.randint(0, 6))]
        if rng.random() < 0.6:
            line = rng.choice(short).split()
            if len(line) > 8:
                line[rng.randrange(len(line))] = rng.choice(["changed", "the"])
            lines.insert(rng.randint(0, len(lines)), rng.choice(["", "# ", "// "]) + rng.choice([" ", "\n * "]).join(line))
        files.append((i, f"d{i}/f{i}.txt", "\n".join(lines)))
    got, want = run(spark, files), brute(files, True)
    own = {p: (r.license, r.score) for p, r in got.items() if r.via == "header"}
    assert own.keys() == want.keys() and len(want) > 15
    assert all(own[p][0] == want[p][0] and abs(own[p][1] - want[p][1]) < 2e-6 for p in want)
    assert brute(files, False).keys() == want.keys()  # no window that lies elsewhere reaches the threshold


def wrapped(text, lead, width):
    lines, line = [], ""
    for w in text.split():
        if len(line) + len(w) > width:
            lines.append(lead + line.strip())
            line = ""
        line += w + " "
    return "\n".join([*lines, lead + line.strip()])


@pytest.mark.parametrize("lead", ["", " * ", "# "])
def test_whole_licences_wrapped_and_commented(spark, lead):
    """Full texts in licence files and headers, with titles and holders; what lies below inherits."""
    files = [(0, "plain/x.py", "nothing of the kind here " * 40)]
    for name, text in TEXTS.items():
        title = f"The {name} License\n\nCopyright (c) 2021 Some One and Others\nAll rights reserved.\n\n"
        files += [(1, f"{name}/LICENSE", title + wrapped(text, lead, 78)), (2, f"{name}/src/deep/x.py", "print(1)\n" * 20), (3, f"{name}-file/any.txt", wrapped(text, lead, 60)), (4, f"{name}-file/y", "code")]
    for name, text in NOTICES.items():
        files += [(5, f"{name}-head/x.c", wrapped(text, lead, 70) + "\nint main() { return 0; }\n" * 30), (6, f"{name}-head/y.c", "int x;"), (7, f"{name}-prose/z.md", f"Some words before. {text} And many words after it, in one line of prose.")]
    got = run(spark, files)
    for name in TEXTS:
        assert (got[f"{name}/LICENSE"].license, got[f"{name}/LICENSE"].via) == (name, "header")
        assert (got[f"{name}/src/deep/x.py"].license, got[f"{name}/src/deep/x.py"].origin) == (name, f"{name}/LICENSE")
        assert (got[f"{name}-file/y"].license, got[f"{name}-file/y"].origin) == (name, f"{name}-file/any.txt")
    for name in NOTICES:
        assert got[f"{name}-head/x.c"].license == name and got[f"{name}-head/y.c"].license is None
        assert got[f"{name}-prose/z.md"].license == name
    assert got["plain/x.py"].license is None


def test_edited_texts_are_found(spark):
    rng = random.Random(5)
    words = TEXTS["MIT"].split()
    files = []
    for i in range(20):
        w = list(words)
        for _ in range(8):
            w[rng.randrange(len(w))] = f"edit{rng.randrange(1000)}"
        for _ in range(2):
            del w[rng.randrange(len(w))]
        files.append((i, f"p{i}/LICENSE.md", " ".join(w)))
    assert all(r.license == "MIT" and r.score > 0.7 for r in run(spark, files).values())


def test_nearest_ancestor(spark):
    long_ = "some plain text that says nothing of the kind\n" * 30
    files = [
        (1, "LICENSE", MIT), (2, "a.txt", long_), (3, "x/y/b.txt", long_), (4, "x/COPYING", GPL + "\n" + long_), (5, "x/y/z/c.txt", long_),
        (6, "x/y/d.txt", long_ + MIT), (7, "q/e.txt", long_), (8, "xx/f.txt", long_), (9, None, long_),
    ]
    got = run(spark, files)
    assert {p: (r.license, r.via, r.origin) for p, r in got.items()} == {
        "LICENSE": ("MIT", "header", None), "a.txt": ("MIT", "inherited", "LICENSE"), "x/y/b.txt": ("GPL-3.0", "inherited", "x/COPYING"), "x/COPYING": ("GPL-3.0", "header", None),
        "x/y/z/c.txt": ("GPL-3.0", "inherited", "x/COPYING"), "x/y/d.txt": ("MIT", "header", None), "q/e.txt": ("MIT", "inherited", "LICENSE"), "xx/f.txt": ("MIT", "inherited", "LICENSE"), None: (None, None, None),
    }


def test_a_notice_licenses_only_its_file(spark):
    files = [(1, "d/a.py", "# " + MIT), (2, "d/b.py", "code")]
    got = run(spark, files)
    assert got["d/a.py"].via == "header" and got["d/b.py"].via is None


def test_nulls_empties_repeats_and_clashing_columns(spark):
    schema = "doc_id long, path string, text string, license string, word string, rid string"
    rows = [(1, "p", None), (1, "p", ""), (None, "q/license", MIT), (2, "q/s", "no"), (2, "q/s", "no"), (None, None, MIT), (None, None, "nothing here"), (3, "d/a", MIT), (3, "d/a", "other words"), (3, "d/a", MIT + " and some more words than that")]
    got = sorted((r.path or "", r.license or "", r.via or "") for r in licenses.scan(spark.createDataFrame([r + ("x", "x", "x") for r in rows], schema)).collect())
    assert got == sorted([("p", "", ""), ("p", "", ""), ("q/license", "MIT", "header"), ("q/s", "MIT", "inherited"), ("q/s", "MIT", "inherited"), ("", "MIT", "header"), ("", "", ""), ("d/a", "MIT", "header"), ("d/a", "", ""), ("d/a", "MIT", "header")])
    assert licenses.scan(spark.createDataFrame([], schema)).count() == 0


def test_a_very_long_text(spark):
    body = "plain words of no meaning at all " * 150_000  # 5 MB
    got = run(spark, [(1, "a/b", body + GPL + body), (2, "a/c", "license mit apache gnu " * 30_000), (3, "a/d", "x" * 3_000_000)])
    assert got["a/b"].license == "GPL-3.0" and got["a/c"].license is None and got["a/d"].license is None


def test_plan_is_native(spark):
    df = spark.createDataFrame([(1, "a/b", MIT)], "doc_id long, path string, text string")
    plan = licenses.scan(df)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
