"""Fill-in-middle, filter orders and license scans on small tables, against brute force."""

from __future__ import annotations

import hashlib
import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tonelake.llm import infill, interaction, licences

ODD = [None, "", "   \n\t ", "!!! ...", "a", " lead", "trail \n", "Hello, World", "Hello, World", "ﬁ①é́ ß İ 中文 \x01 \x1c \x85 \xa0  z", "\U0001f600 \U0001f600", "a\x00b c", "x" * 300000, "word " * 60000]


def docs_of(spark, texts, **more):
    rows = [(i, t, *more.values()) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string" + "".join(f", {k} string" for k in more))


# ------------------------------------------------------------------ op11


def test_token_ends_are_those_of_the_pattern(monkeypatch):
    rng = random.Random(3)
    texts = [x or "" for x in ODD] + ["".join(rng.choice("ab  \n\té\x0b中\x00") for _ in range(rng.randrange(60))) for _ in range(500)]
    for part in (infill.PART, 7):
        monkeypatch.setattr(infill, "PART", part)
        for text in texts if part > 7 else texts[:9] + texts[14:]:
            assert infill.token_ends(text).tolist() == [m.end() for m in re.finditer(infill.TOKENS, text)], text[:50]


def test_long_space_does_not_step_back():
    assert infill.token_ends("x" + " " * 2_000_000 + "y" + " " * 2_000_000).tolist() == [1, 2_000_002, 4_000_002]


def infilled(key, text):
    """Plain Python of the contract."""
    text = text or ""
    tokens = re.findall(infill.TOKENS, text)
    h = [int(hashlib.sha256(f"42:{'' if key is None else key}".encode()).hexdigest()[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (len(tokens) + 1), h[1] % (len(tokens) + 1)))
    p, m, s = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return len(tokens), "plain", None, None, text
    if h[3] % 100 < 80:
        return len(tokens), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(tokens), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_infill_is_the_contract_and_comes_back(spark):
    texts = ODD + ["has <S> in it", "<P", "a < b <S c P> d M>", "$1 \\E \\1 $"] * 12 + [f"one two <S\nthree {i}" for i in range(200)]
    docs = docs_of(spark, texts, n="clash", output="clash", cuts="kept")
    docs = docs.unionByName(spark.createDataFrame([(None, "no key here", "x", "x", "x")], docs.schema))
    made = infill.fill_in_middle(docs)
    assert made.columns == ["doc_id", "text", "n", "output", "cuts", "form", "prefix_chars", "middle_chars"]
    rows = made.withColumn("back", infill.restored(F.col("output"), F.col("form"))).collect()
    assert len(rows) == len(texts) + 1 and {r.form for r in rows} == {"plain", "psm", "spm"}
    for r in rows:
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == infilled(r.doc_id, r.text)
        assert r.back == (r.text or "") and r.cuts in ("kept", "x")
    assert infill.fill_in_middle(docs.limit(0)).count() == 0


# ------------------------------------------------------------------ op12


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 6])
def test_swaps_meet_every_order_once(n):
    order, met = list(range(n)), [tuple(range(n))]
    for k in interaction.swaps(n):
        order[k], order[k + 1] = order[k + 1], order[k]
        met.append(tuple(order))
    assert sorted(met) == sorted(itertools.permutations(range(n)))


def test_walk_removes_what_each_order_removes():
    rng = np.random.default_rng(1)
    for n in (1, 3, 4):
        counts = rng.integers(0, 9, (2, 1 << n, 3))
        orders, removed, shares = interaction.walk(counts, n)
        for at, order in enumerate(orders):
            for k, f in enumerate(order):
                masks = [m for m in range(1 << n) if m >> f & 1 and not any(m >> g & 1 for g in order[:k])]
                assert (removed[:, at, k] == counts[:, masks].sum(1)).all()
        assert (shares.sum(1) == removed[..., 0].sum((1, 2))).all()


def fails(text, key, first):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    found = "A" * (len(words) < 100) + "B" * (100 * len(set(words)) < 80 * len(words)) + "C" * (100 * len(re.findall("[A-Z]", text)) > 10 * len(text))
    return found + "D" * bool(re.search("[#$%&*|]", text)) + "E" * (key is not None and first is not None and key > first)


def audited(docs, labels):
    """Plain Python of the contract."""
    first = {}
    for key, text, _ in docs:
        if key is not None:
            first[text or ""] = min(key, first.get(text or "", key))
    good, toxic = {k for k, q, _ in labels if q == 1 and k is not None}, {k for k, _, t in labels if t == 1 and k is not None}
    said = [(part or "", fails(text or "", key, first.get(text or "")), key in good, key in toxic) for key, text, part in docs]
    rows, shapley = {}, {}
    for part in {s[0] for s in said}:
        for order in itertools.permutations("ABCDE"):
            left, gone = [s for s in said if s[0] == part], []
            for step, f in enumerate(order, 1):
                out = [s for s in left if f in s[1]]
                left = [s for s in left if f not in s[1]]
                alone = sum(s[1] == f for s in said if s[0] == part)
                rows[part, "".join(order), step] = [len(left), len(out), sum(f in s[1] for s in gone), alone, sum(s[2] for s in out), sum(s[3] for s in out)]
                gone += out
                shapley[part, f] = shapley.get((part, f), 0) + len(out)
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in rows.items()}


def test_orders_of_filters_are_the_contract(spark):
    rng = random.Random(7)
    docs = [(i, t, rng.choice(["en", "de", "", None])) for i, t in enumerate(ODD)]
    for i in range(200):
        words = [rng.choice(["alpha", "Beta", "GAMMA", "d#", "e", str(i), str(rng.random())]) for _ in range(rng.choice([5, 99, 100, 101, 150]))]
        docs.append((1000 + i, " ".join(words), rng.choice(["en", "de", "", None])))
    docs += [(k, docs[rng.randrange(len(docs))][1], rng.choice(["en", "de", None])) for k in [5, 5, 5, None, None, *range(3000, 3080)]]
    docs += [docs[40]] * 30
    labels = [(k, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for k, *_ in docs if rng.random() < 0.6] + [(None, 1, 1)]
    tables = spark.createDataFrame(docs, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality long, toxic long")
    tables = tables[0].withColumn("n", F.lit("clash")).withColumn("mask", F.lit("clash")).withColumn("good", F.lit("clash")), tables[1].withColumn("text", F.lit("clash"))
    found = interaction.interactions(interaction.cells(*tables)).collect()
    got = {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in found}
    assert len(got) == len(found) and got == audited(docs, labels)
    assert interaction.interactions(interaction.cells(tables[0].limit(0), tables[1])).count() == 0
    assert interaction.interactions(interaction.cells(tables[0], tables[1].limit(0))).count() == len(got)


# ------------------------------------------------------------------ op13


@pytest.mark.parametrize(
    ("text", "tokens", "names", "weight"),
    [
        (" MIT\nmore", "mit", {"mit"}, licences.PERMISSIVE),
        ("MIT OR Apache-2.0", "mit or apache-2.0", {"mit", "apache-2.0"}, licences.PERMISSIVE),
        ("GPL-2.0-only or (MIT and AGPL-3.0) */", "gpl-2.0-only or ( mit and agpl-3.0 )", {"gpl-2.0-only", "mit", "agpl-3.0"}, licences.STRONG),
        ("GPL-3.0-only OR MIT AND LGPL-2.1-only", "gpl-3.0-only or mit and lgpl-2.1-only", {"gpl-3.0-only", "mit", "lgpl-2.1-only"}, licences.WEAK),
        ("(GPL-3.0-only OR MIT) AND LGPL-2.1-only", "( gpl-3.0-only or mit ) and lgpl-2.1-only", {"gpl-3.0-only", "mit", "lgpl-2.1-only"}, licences.WEAK),
        ("(GPL-3.0-only OR AGPL-3.0) AND MIT", "( gpl-3.0-only or agpl-3.0 ) and mit", {"gpl-3.0-only", "agpl-3.0", "mit"}, licences.STRONG),
        ("GPL-2.0+ WITH Classpath-exception-2.0 AND MIT", "gpl-2.0+ with classpath-exception-2.0 and mit", {"gpl-2.0+-with-classpath-exception-2.0", "mit"}, licences.WEAK),
        ("LicenseRef-ours.", "licenseref-ours", {"licenseref-ours"}, licences.UNRECOGNISED),
        ("MIT and some words", "mit", {"mit"}, licences.PERMISSIVE),
        ("((MIT)", "", set(), 0.0),
        ("(MIT) or (Zlib", "( mit )", {"mit"}, licences.PERMISSIVE),
        ("MIT) and Zlib", "mit", {"mit"}, licences.PERMISSIVE),
        ("or MIT", "", set(), 0.0),
        ("MIT with MIT", "mit", {"mit"}, licences.PERMISSIVE),
        ("()", "", set(), 0.0),
        ("nothing-1.0 or MIT", "", set(), 0.0),
        ("MIT with a-exception with b-exception", "mit with a-exception", {"mit-with-a-exception"}, licences.PERMISSIVE),
        ("(MIT or Zlib) with a-exception", "( mit or zlib )", {"mit", "zlib"}, licences.PERMISSIVE),
    ],
)
def test_expressions(text, tokens, names, weight):
    found = licences.well_formed(text, 0)
    assert " ".join(found) == tokens
    if found:
        assert licences.evaluated(found) == (names, weight)


def test_random_expressions_weigh_as_brackets_say():
    rng = random.Random(5)
    known = list(licences.WEIGHTS)

    def made(depth):
        """An expression, its weight by the shape it was made in, and how close its last operator binds."""
        if depth == 0 or rng.random() < 0.3:
            name = rng.choice(known)
            return name, licences.WEIGHTS[name], 9
        binds = rng.choice([1, 2])
        parts = [made(depth - 1) for _ in range(rng.randrange(2, 4))]
        said = [x if close > binds else f"({x})" for x, _, close in parts]
        return f" {'or' if binds == 1 else 'AND'} ".join(said), (min if binds == 1 else max)(w for _, w, _ in parts), binds

    for _ in range(400):
        text, weight, _ = made(4)
        tokens = licences.well_formed(text, 0)
        assert "".join(tokens) == text.replace(" ", "").lower() and licences.evaluated(tokens)[1] == weight
    assert licences.evaluated(licences.well_formed("(" * 5000 + "MIT" + ")" * 5000, 0))[0] == {"mit"}


def placed(text):
    """Every place of every phrase and tag, one word after the other."""
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    every = [p.split() for p in licences.NOTICES.keys() | licences.BASE.keys() | licences.TAGS.keys()]
    return len(words), sorted((" ".join(p), i) for i in range(len(words)) for p in every if words[i : i + len(p)] == p)


def test_places_are_those_of_a_plain_search(monkeypatch):
    rng = random.Random(2)
    words = sorted({w for p in licences.NOTICES for w in p.split()} | {"x", "é", "CC", "BY", "All", "Rights"})
    texts = [x or "" for x in ODD[:12]] + ["".join(rng.choice(words) + rng.choice([" ", ", ", "-\n", "\x00", ". "]) for _ in range(rng.randrange(80))) for _ in range(200)]
    texts += ["all rights reserved" * 3, "cc by cc by cc by", "é" * 100 + " cc by", "CC-BY-NC-SA 4.0"]
    for part in (licences.PART, 5):
        monkeypatch.setattr(licences, "PART", part)
        for text in texts:
            n, found = licences.places(text)
            assert (n, sorted(found)) == placed(text), text


def test_scan_of_odd_tables(spark):
    texts = [
        *ODD,
        "Released under CC BY 4.0. All rights reserved.\nAll  RIGHTS-reserved",
        "// SPDX-License-Identifier: (MIT OR GPL-3.0-only) AND Zlib\nlicense: whatever\nLicense: Apache-2.0.",
        "SPDX-License-Identifier: nobody knows",
        "spdx license identifier MIT",
        "the GNU General Public License, version 3, and the GNU Lesser General Public License",
    ]
    docs = docs_of(spark, texts, n_words="clash", labels="clash", found="kept", score="clash")
    docs = docs.unionByName(docs)
    made = licences.scan(docs)
    assert made.columns == ["doc_id", "text", "n_words", "labels", "found", "score", "notices", "expressions", "base_labels"]
    rows = made.collect()
    assert len(rows) == 2 * len(texts) and all(r.found == "kept" for r in rows)
    at = len(ODD)
    got = {r.doc_id: r for r in rows}
    assert all((got[i].labels, got[i].score, got[i].notices) == ([], 0.0, []) for i in range(at))
    assert got[0].n_words == 0 and got[13].n_words == 60000
    assert (got[at].base_labels, got[at].labels, got[at].score) == (["cc-by", "reserved"], ["cc-by", "reserved"], 1.0)
    assert [n.word for n in got[at].notices if n.phrase == "all rights reserved"] == [6, 9]
    assert got[at + 1].labels == ["apache-2.0", "gpl-3.0-only", "mit", "zlib"] and got[at + 1].score == licences.PERMISSIVE
    assert [e.expression for e in got[at + 1].expressions] == ["( mit or gpl-3.0-only ) and zlib", "apache-2.0"]
    assert (got[at + 2].labels, got[at + 2].base_labels) == (["unrecognised"], [])
    assert got[at + 3].labels == []
    assert (got[at + 4].base_labels, got[at + 4].labels, got[at + 4].score) == (["gpl"], ["gpl", "gpl-3", "lgpl"], licences.STRONG)
    assert licences.scan(docs.limit(0)).count() == 0


def test_scan_is_linear_in_hostile_texts():
    import time

    began = time.time()
    for text in ("license: (" * 100_000, "license: mit or " * 100_000, "license:" + "(" * 1_000_000, "license: " + "mit and " * 200_000, "cc by " * 300_000):
        licences.scanned(text)
    assert time.time() - began < 30
