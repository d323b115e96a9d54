import math
import re
from collections import Counter

import odd
import pytest
from pyspark.sql import functions as F

from notemill.llm import licenses as li
from notemill.llm.queries import QUERIES


def terms(text):
    return re.findall(r"[0-9a-z\x80-\U0010ffff]+", "".join(c.lower() if c.isascii() else c for c in text))


class Brute:
    def __init__(self, texts):
        self.templates = [(n, Counter(terms(t))) for n, t in li.TEMPLATES]
        self.known = {w for _, c in self.templates for w in c}
        self.n = len(texts)
        self.df = Counter(w for t in texts for w in set(terms(t)) & self.known)

    def idf(self, w):
        return math.log((1 + self.n) / (1 + self.df[w])) + 1 if w in self.known else math.log(1 + self.n) + 1

    def vector(self, counts):
        v = {w: (1 + math.log(c)) * self.idf(w) for w, c in counts.items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {w: x / norm for w, x in v.items()} if norm else {}

    def best(self, text):
        v = self.vector(Counter(terms(text)))
        score = [sum(x * v.get(w, 0) for w, x in self.vector(c).items()) for _, c in self.templates]
        k = max(range(len(score)), key=lambda i: (round(score[i], 9), -i))
        return self.templates[k][0], score[k]

    def own(self, text, path=None):
        whole, cosine = self.best(text)
        file = (path or "").rpartition("/")[2].lower()
        if cosine >= li.FILE_COSINE and file in ("license", "copying", "licence.txt"):
            return whole, "file", cosine
        lines = [self.best(x) for x in text.split("\n")]
        k = max(range(len(lines)), key=lambda i: (round(lines[i][1], 9), -i))
        line, at = lines[k] if lines[k][1] >= li.LINE_COSINE else (None, 0)
        if cosine >= li.FILE_COSINE and round(cosine, 9) > round(at, 9):
            line, at = whole, cosine
        return (line, "header", at) if line else (None, None, None)


def folder(path):
    return path.rpartition("/")[0]


def brute(rows):
    """(path, text) of every file -> licence, via, cosine, directory."""
    b = Brute([t or "" for _, t in rows])
    own = [b.own(t or "", p) for p, t in rows]
    speaks = {}
    for (path, _), (name, via, cosine) in zip(rows, own):
        if via == "file" and path is not None:
            speaks.setdefault(folder(path), []).append((-round(cosine, 9), path, name))
    out = []
    for (path, _), (name, via, cosine) in zip(rows, own):
        at = None
        if via is None and path is not None:
            at = folder(path)
            while at not in speaks and at:
                at = folder(at)
            if at in speaks:
                c, _, name = min(speaks[at])
                via, cosine = "inherited", -c
            else:
                at = None
        out.append((name, via, cosine, at))
    return out


def same(got, want):
    assert got[:2] == want[:2] and got[3] == want[3]
    assert (got[2] is None) == (want[2] is None) and (got[2] is None or got[2] == pytest.approx(want[2], abs=2e-6))


FILES = [
    ("LICENSE", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated files"),
    ("a/x.txt", "some prose that goes on\nand on"), ("a/b/COPYING", "Licensed under the Apache License, Version 2.0."),
    ("a/b/c/y.txt", "prose in a deep place"), ("a/b/c/z.txt", "more prose here\nReleased under the MIT License.\nand a tail of words " + "w " * 60),
    ("a/b/1", "This work is licensed under the GNU General Public License, version 3."), ("a/b/0", "Licensed under the Apache License, Version 2.0."),
    ("top.txt", "prose"), (None, "prose"), (None, "All rights reserved."), ("é/q.txt", None), ("a/b/c/y.txt", "prose in a deep place"),
    ("s/scrap.txt", "A.\nAll rights reserved."), ("s/other.txt", "prose beside a scrap"), ("s/two.txt", "Licensed under the Apache\nLicense, Version 2.0."),
    ("t/licence.txt", "Licensed under CC BY 4.0."), ("t/u/x", "prose below"), ("t/license.py", "Released under the MIT License."),
]


def test_files_against_brute_force(spark):
    docs = spark.createDataFrame([(k, p, t) for k, (p, t) in enumerate(FILES)], "n int, path string, text string")
    rows = sorted(li.scan(docs).collect(), key=lambda r: r["n"])
    for r, want in zip(rows, brute(FILES)):
        same((r["license"], r["via"], r["cosine"], r["license_dir"]), want)
    assert rows[3]["license_dir"] == "a/b" and rows[1]["license_dir"] == "" and rows[4]["via"] == "header"
    assert rows[6]["via"] == "header"  # a notice, but no licence file
    assert rows[12]["via"] == "header" and rows[13]["license_dir"] == ""  # nothing inherits from a scrap
    assert (rows[14]["license"], rows[14]["via"]) == ("Apache-2.0", "header")  # a notice over two lines
    assert rows[16]["license_dir"] == "t" and rows[17]["via"] == "header"


def test_query_against_brute_force(spark, sf, documents):
    info = {r["doc_id"]: r for r in documents[0].collect()}
    files = [(f"{info[i]['source']}/{info[i]['lang']}/{i // 1000}/{i}.txt", t) for i, t in documents[1]]
    rows = sorted(QUERIES["op1_licenses"](spark, sf).collect(), key=lambda r: r["doc_id"])
    for r, want in zip(rows, brute(files), strict=True):
        same((r["license"], r["via"], r["cosine"], r["license_dir"]), want)


def test_a_directory_of_many_files(spark):
    rows = [(f"hot/{k}", f"prose {k}") for k in range(300)] + [("hot/LICENSE", "All rights reserved."), ("hot/sub/q", "x")]
    found = li.scan(spark.createDataFrame(rows, "path string, text string")).collect()
    assert sum(r["via"] == "inherited" and r["license"] == "Proprietary" for r in found) == 301


def test_odd_rows(spark):
    docs = odd.odd(spark)
    rows = li.scan(docs, path_col="key").collect()
    assert len(rows) == len(odd.TEXTS) and all(r["license"] is None for r in rows)
    assert set(rows[0].asDict()) == set(docs.columns) - {"text"} | {"via", "cosine", "license_dir"}
    assert li.scan(odd.none(spark), path_col="key").count() == 0


def test_full_licence_texts_speak_for_their_directories(spark):
    own = {"Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "BSD-2-Clause", "BSD-3-Clause", "MIT", "MPL-2.0", "CC0-1.0",
           "CC-BY-SA-4.0", "Unlicense"}
    texts = dict(li.full_texts())
    assert own <= set(texts)
    rows = [("top.txt", "prose without a licence above it")]
    for name, text in texts.items():
        reflowed = "Copyright (c) 2021 Some Holder and others\n\n" + " ".join(text.split())
        rows += [(f"{name}/whole/LICENSE", text), (f"{name}/whole/src/a.txt", "prose of its own"),
                 (f"{name}/flow/COPYING", reflowed), (f"{name}/flow/b.txt", "more prose")]
    found = {r["path"]: r for r in li.scan(spark.createDataFrame(rows, "path string, text string")).collect()}
    for name in texts:
        for folder, file, other in (("whole", "LICENSE", "src/a.txt"), ("flow", "COPYING", "b.txt")):
            r, below = found[f"{name}/{folder}/{file}"], found[f"{name}/{folder}/{other}"]
            assert (r["license"], r["via"]) == (name, "file") and r["cosine"] > 0.65
            assert (below["license"], below["via"], below["license_dir"]) == (name, "inherited", f"{name}/{folder}")
    assert found["top.txt"]["license"] is None


def test_full_text_cosine_against_plain_counts(spark):
    texts = dict(li.full_texts())
    files = [texts["BSD-3-Clause"].replace("Regents of the University", "Holders"), "the terms and conditions of some prose", "All rights reserved."]
    rows = li.scan(spark.createDataFrame(list(enumerate(files)), "n int, text string").withColumn("path", F.lit("x"))).collect()
    b = Brute(files)
    b.templates = [(n, Counter(terms(t))) for n, t in texts.items()]
    b.known |= {w for _, c in b.templates for w in c}
    b.df = Counter(w for t in files for w in set(terms(t)) & b.known)
    name, cosine = b.best(files[0])
    got = {r["n"]: r for r in rows}
    assert (got[0]["license"], got[0]["via"]) == (name, "file") == ("BSD-3-Clause", "file")
    assert got[0]["cosine"] == pytest.approx(cosine, abs=2e-6)
    assert got[2]["license"] == "Proprietary" and got[2]["via"] == "header"
