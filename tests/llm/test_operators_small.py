"""Each operator on small tables: nulls, empty and long texts, ties, repeated rows, empty tables, extra columns."""

from __future__ import annotations

import itertools
import random
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from public_tokenizers import path
from pyspark.sql import functions as F

from tonelake.llm import bagminhash, bytecnn, layout, linecrf, merkle, packing, snapshots, tokencount, topk, winnow
from tonelake.llm.common import Words

WORD_MODEL, PIECE_MODEL = path("word_bpe_49k.json"), path("piece_bpe_32k.model")
ODD = [None, "", "   \n\t ", "!!! ...", "a", "Hello, World", "Hello, World", "ﬁ①é́ ß İ 中文 \x01 \x1c", "<|endoftext|> <s> ▁▁x  y", "x" * 30000, "word " * 20000]


def docs_of(spark, texts, **more):
    rows = [(i, t, *more.values()) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string" + "".join(f", {k} string" for k in more))


def by_id(df, *columns):
    return {r.doc_id: tuple(r[c] for c in columns) if len(columns) > 1 else r[columns[0]] for r in df.collect()}


# ------------------------------------------------------------------ words


def test_words_end_with_their_texts():
    w = Words(pa.array(["Ab-c1", "", None, "é", "dE"]))
    said = [bytes(w.data[a:b]).decode() for a, b in zip(w.start, w.end, strict=True)]
    assert said == ["ab", "c1", "é", "de"] and list(w.counts) == [2, 0, 0, 1, 1]
    a, b = Words(pa.array(["x y"])), Words(pa.array(["zz", "q x y"]))
    assert a.hash.tolist() == b.hash[-2:].tolist() and a.grams(2)[0] == b.grams(2)[2]


# ------------------------------------------------------------------ op1


def archive(spark, rows):
    return spark.createDataFrame(rows, "file string, place long, body string, hash string")


def test_audit_finds_each_kind_of_damage(spark):
    rows = [("f", i * 37, f"record {i}", "h") for i in range(400)] + [("g", 5, None, "h"), (None, 1, "n", "h"), ("g", None, "m", "h"), ("f", 0, "record 0", "h")]
    other = [r for r in rows if r[1] != 37 * 7 or r[0] != "f"]
    other = [(f, p, "changed" if p == 37 * 300 else b, "other") for f, p, b, _ in other] + [("z", 1, "new", "h")]
    other = [(f, p, "" if (f, p) == ("g", 5) else b, h) for f, p, b, h in other][:-2] + [other[-1]]
    found = {(r.file, r.offset): (r.kind, r.n_primary, r.n_replica) for r in merkle.audit(archive(spark, rows), archive(spark, other), "file", "place", ["body"]).collect()}
    assert found == {
        ("f", 37 * 7): ("missing", 1, 0), ("f", 37 * 300): ("changed", 1, 1), ("g", 5): ("changed", 1, 1), ("z", 1): ("extra", 0, 1), ("f", 0): ("missing", 2, 1),
    }


def test_audit_of_equal_or_empty_replicas(spark):
    rows = archive(spark, [("f", 1, "a", "h"), (None, None, None, None)])
    assert merkle.audit(rows, rows, "file", "place", ["body"]).count() == 0
    none = archive(spark, [])
    assert merkle.audit(none, none, "file", "place", ["body"]).count() == 0
    assert [r.kind for r in merkle.audit(none, rows, "file", "place", ["body"]).collect()] == ["extra", "extra"]


def test_roots_bind_offsets(spark):
    root = lambda rows: {r.file: r.digest for r in merkle.roots(merkle.tree(merkle.hashed(archive(spark, rows), "file", "place", ["body"]))).collect()}
    assert root([("f", 1, "a", ""), ("f", 900, "b", "")]) == root([("f", 900, "b", ""), ("f", 1, "a", "")])
    assert root([("f", 1, "a", ""), ("f", 900, "b", "")]) != root([("f", 1, "b", ""), ("f", 900, "a", "")])


def test_audit_of_far_and_negative_offsets(spark):
    places = [-(1 << 62), -1, 0, 63, 64, (1 << 53) + 1, (1 << 53) + 2, (1 << 62) + 5]
    rows = [("f", p, f"r{p}", "h") for p in places]
    bad = {-1, (1 << 53) + 2, (1 << 62) + 5}
    other = [(f, q, "x" if q in bad else b, h) for f, q, b, h in rows]
    found = merkle.audit(archive(spark, rows), archive(spark, other), "file", "place", ["body"]).collect()
    assert {(r.offset, r.leaf, r.kind) for r in found} == {(p, p >> 6, "changed") for p in bad}


# ------------------------------------------------------------------ op2


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<p>a<p>b", "a\n\nb"),
        ("a<br>b<div>c</div>d", "a\nb\nc\nd"),
        ("<ul><li>x<li>y<ol start=3><li>p<li>q</ol></ul>", "- x\n- y\n  3. p\n  4. q"),
        ("<table><tr><th>Name<th>N<tr><td>pear<td>10<tr><td colspan=2>all of it<tr><td rowspan=2>r<td>1<tr><td>2</table>", "Name  N\npear  10\nall of it\nr     1\n      2"),
        ("<head><title>t</title></head><body>x<script>if (a<b) {}</script><style>p{}</style>y", "xy"),
        ("<style>.no, #it {display: none}</style><p class='a no'>1<p id=it>2<p>3", "3"),
        ("<div hidden>a<div>b</div>c</div>d", "d"),
        ("<p style='visibility:hidden'>a<span style='visibility:visible'>b</span></p>", "b"),
        ("<pre>a\n  b</pre>", "a\n  b"),
        ("<b>x<p>y</b>z</p>w", "x\n\nyz\n\nw"),
        ("1 < 2 &amp; 3 &gt; 2<!-- no --><![if x]>", "1 < 2 & 3 > 2"),
        ("text <a href='", "text"),
        ("</div></td></table>ok", "ok"),
        ("<details>no<summary>s</summary>no</details><dialog>no</dialog>yes", "s\nyes"),
        ("", ""),
        ("a<object data=x>b<param name=y>c</object>d", "abcd"),
        ("<ol start=2><li>a<li value=9>b<li>c<li value=x>d<li value=' -1 '>e</ol>", "2. a\n9. b\n10. c\n11. d\n-1. e"),
        ("<pre>\n\n a\n</pre><pre>\r\nb</pre>", "\n a\n\nb"),
        ("a<plaintext>b <p>c</p> d", "a\n\nb <p>c</p> d"),
        ("<table><tr><td>a<td><table><tr><td>1<td>22<tr><td>333</table><tr><td>bb<td>c</table>", "a   1    22\n    333\nbb  c"),
        ("<table><tr><td><table><tr><td>a<tr><td>b</table><td>c<br>d<br>e<tr><td>wide one<td>f</table>", "a         c\nb         d\n          e\nwide one  f"),
    ],
)
def test_layout(page, text):
    assert layout.render(page) == text


def test_layout_of_odd_tables(spark):
    pages = spark.createDataFrame([(1, None, "r"), (1, None, "r"), (2, "<p>" * 5000 + "x" * 100000, "r"), (3, "", "r")], "page_id long, html string, rendered string")
    got = [(r.page_id, None if r.rendered is None else len(r.rendered)) for r in layout.extract(pages).orderBy("page_id").collect()]
    assert got == [(1, None), (1, None), (2, 100000), (3, 0)]
    assert layout.extract(pages.limit(0)).count() == 0


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<p title=don't>hello <b>you</b>", "hello you"),
        ("<a href=\"x\"\">text</a> more", "text more"),
        ("<p title=don't>a<p title=won't>b", "a\n\nb"),
        ("<p it's class='x>y' hidden>no</p><p =\"a>b", 'b'),
        ("<p title= 'a>b' style = 'display:none'>no</p>yes<p a=b=\"c>d\">e", 'yes\n\nd">e'),
        ("a<p title='x>y", "a"),
    ],
)
def test_stray_quotes_in_tags(page, text):
    assert layout.render(page) == text


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<math><mi>x</mi><mo>=</mo><mn>1</mn><annotation>no</annotation></math> so", "x=1 so"),
        ("a <svg width='1'/><svg><title>no</title><defs><text>no</text></defs> no <path d='M0 0'/><text>one <tspan>two</tspan></text><text/><text>three</text></svg> b", "a\none two\nthree\nb"),
        ("<svg><style>.x{display:none}</style><text class=x>no</text><foreignObject><p>yes</p></foreignObject><g>no<p>out", "yes\n\nout"),
        ("<svg/>a<svg><g><svg/><style/></g>no</svg><svg class=x/>no</svg>b", "ab"),
        ("x <map name=m><a href=y>in the map</a><area></map> y", "x in the map y"),
        ("<table style='visibility:hidden'><tr><td>no<td style='visibility:visible'>x", "x"),
        ("<table><tr><td>1<td><table style='visibility:hidden'><tr><td>no<td style='visibility:visible'>x</table><tr><td>2<td>y</table>", "1  x\n2  y"),
        ("<table style='visibility:hidden'><tr><td>no<tr style='visibility:visible'><td>a<td>b</table>c", "a  b\n\nc"),
        ("<table><tr><td style='visibility:hidden'>no<i style='visibility:visible'>in</i><td>b</table>", "in  b"),
        ("a<div><table style='visibility:hidden'><tr><td>no</table></div>b", "a\nb"),
    ],
)
def test_what_browsers_show_is_kept(page, text):
    assert layout.render(page) == text


@pytest.mark.parametrize("page", ["<svg>" * 20000 + "x<p>" * 2000, "<svg><g>" * 5000 + "<text>x</text>" * 5000, "<math>" + "<mi>x" * 20000, "<svg>" + "<g>x" * 20000])
def test_svg_and_math_are_linear_in_hostile_pages(page):
    layout.render(page)


@pytest.mark.parametrize(
    ("sheet", "page", "text"),
    [
        ("@media print {.nav{display:none} p{display:none}}", "<p class=nav>1<p>2", "1\n\n2"),
        ("@media (max-width:600px){.side{display:none}} .no{display:none}", "<p class=side>1<p class=no>2", "1"),
        ("@media only screen { .a{display:none} } @media not print{.b{display:none}}", "<p class=a>1<p class=b>2<p>3", "3"),
        ("@supports (display:grid){@media screen, print{.a{display:none}}} @keyframes x{from{display:none}}", "<p class=a>1<p>2", "2"),
        (".a{visibility:hidden} .a .b{visibility:visible}", "<p class=a>1<i class=b>2</i>3", "2"),
        ("div .no{display:none} .a.b{display:none} div > i{display:none}", "<p class=no>1<p class=a>2<p class='b a'>3<div><p class=no>4</p><b><i>5</i></b><i>6</i></div>", "1\n\n2\n\n5"),
        (".m{display:none} .m.open{display:block} p{display:block}", "<p class=m>1<p class='m open'>2<p class=m style='display:block'>3", "2\n\n3"),
        ("/* .x{ */ .y::before{content:'}'} .x{display:none!important} .z:hover{display:none}", "<p class=x style='display:block'>1<p class=z>2", "2"),
        (".x{color:red} } .z{display:none", "<p class=x>1<p class=z>2", "1\n\n2"),
    ],
)
def test_sheets_are_read_for_a_screen(sheet, page, text):
    assert layout.render(f"<style>{sheet}</style>{page}") == text
    assert layout.render(f"<html><body><style>html {{}}</style><style media=print>p{{display:none}}</style><style>{sheet}</style>{page}") == text


@pytest.mark.parametrize("page", ["<style>.x .x > .x{display:none}</style>" + "<div class=x>" * 20000, "<style>" + "a{" * 20000, "<style>" + "@media print{" * 20000, "<style>" + "a{b:c}" * 20000])
def test_sheets_are_linear_in_hostile_pages(page):
    layout.render(page)


HOSTILE = [
    "<b>" * 20000 + "<li>x" * 20000, "<ul>" + "<b>" * 20000 + "<li>x</li>" * 20000, "<li><ul>" + "<div>" * 20000 + "<li>x</li>" * 20000, "<b>" * 20000 + "<div>" * 20000 + "</b>" * 20000,
    "<table><tr><td>x" * 20000, "<table><tr><td>x<table><tr><td>y</table>" * 10000, "<table><tr><td>" * 20000 + "z" + "</td><td>y</td></tr></table>" * 20000,
    "<table>" + "<b>" * 20000 + "<td>x" * 20000, "<p><b>" + "<button>" * 20000 + "<p>x" * 20000, "<select><option>" + "<b>" * 20000 + "<option>" * 20000,
]


@pytest.mark.parametrize("page", HOSTILE)
def test_lists_and_cells_are_linear_in_deep_stacks(page):
    began = time.process_time()
    layout.render(page)
    assert time.process_time() - began < 8


def test_blocks_of_texts_overlap_as_multisets_do():
    rng = random.Random(4)
    texts = [" ".join(rng.choice("ab") for _ in range(rng.randrange(400))) for _ in range(30)] + ["a " * n for n in (0, 1, 4, 5, 6, 9, 5000)] + ["x y z " * 900, "x y z " * 700 + "q", ""]
    some, other = texts[::2], texts[1::2]
    sides = [bagminhash.shingles(Words(pa.array(x))) for x in (some, other)]
    got = bagminhash._overlaps(*sides, len(some), len(other), step=3)
    pairs = [(a, b) for a in some for b in other]
    want = bagminhash.similarity(pa.array([a for a, _ in pairs]), pa.array([b for _, b in pairs])).reshape(got.shape)
    assert np.abs(got - want).max() < 1e-12


def test_repeated_words_cost_no_more_than_others():
    sides = bagminhash.shingles(Words(pa.array(["word " * 50000] * 60)))
    began = time.process_time()
    assert bagminhash._overlaps(sides, sides, 60, 60).min() == 1 and time.process_time() - began < 1


def test_ten_thousand_malformed_pages():
    rng = random.Random(8)
    tags = "p div b i ul ol li table tr td th tbody caption pre blockquote dl dt dd select option svg math text g mi details summary dialog h1 span button object style script textarea template".split()
    more = ["", "", "", " style='visibility:hidden'", " style='visibility:visible'", " style='display:none'", " hidden", " rowspan=3", " colspan=2", " start=7", " class=a", " open", "/", " x=\"", " it's"]
    for _ in range(10000):
        parts = []
        for _ in range(rng.randrange(30)):
            tag = rng.choice(tags)
            parts.append(rng.choice([f"<{tag}{rng.choice(more)}>"] * 3 + [f"</{tag}>"] * 2 + ["x", "y z", "&amp;", "<", "<!--", "-->", ".a{visibility:hidden}"]))
        assert isinstance(layout.render("".join(parts)), str)


# A second renderer: from a tree of elements to its text, without any tags to read.


def random_tree(rng, depth=0):
    """(kind, children): blocks of words, lists, tables of words, and what is hidden."""
    word = lambda: rng.choice(["alpha", "be", "gamma rays", "d", "x < y"])
    kind = rng.choice(["p", "div", "hidden", "script", "pre", "ul", "ol", "table"]) if depth < 3 else rng.choice(["p", "pre", "hidden"])
    if kind in ("p", "hidden", "script"):
        return kind, [word() for _ in range(rng.randrange(1, 4))]
    if kind == "pre":
        return kind, [f"  {word()}" for _ in range(rng.randrange(1, 3))]
    if kind == "table":
        return kind, [[word() for _ in range(rng.randrange(1, 4))] for _ in range(rng.randrange(1, 4))]
    if kind == "div":
        return kind, [random_tree(rng, depth + 1) for _ in range(rng.randrange(1, 4))]
    return kind, [(word(), random_list(rng, depth + 1) if depth < 2 and rng.random() < 0.3 else None) for _ in range(rng.randrange(1, 4))]


def random_list(rng, depth):
    return rng.choice(["ul", "ol"]), [(rng.choice(["one", "two three"]), None) for _ in range(rng.randrange(1, 3))]


def as_html(rng, node):
    kind, inside = node
    esc = lambda x: x.replace("<", "&lt;")
    loose = rng.random() < 0.5  # with the end tags left out that HTML implies
    if kind in ("p", "hidden", "script"):
        said = " ".join(f"<b>{esc(x)}</b>" if kind == "p" and rng.random() < 0.3 else esc(x) for x in inside)
        return {"p": f"<p>{said}</p>", "hidden": f"<div style='display: none'>{said}</div>", "script": f"<script>{said}</script>"}[kind]
    if kind == "pre":
        return "<pre>" + "\n".join(map(esc, inside)) + "</pre>"
    if kind == "table":
        rows = ["".join(f"<td>{esc(c)}" + ("" if loose else "</td>") for c in row) for row in inside]
        return "<table>" + "".join(f"<tr>{r}" + ("" if loose else "</tr>") for r in rows) + "</table>"
    if kind == "div":
        return "<div>" + "\n ".join(as_html(rng, x) for x in inside) + "</div>"
    return f"<{kind}>" + "".join(f"<li>{esc(w)}{as_html(rng, sub) if sub else ''}" + ("" if loose else "</li>") for w, sub in inside) + f"</{kind}>"


def as_parts(node):
    """(margin before and after, lines) of each block; a div has none of its own."""
    return [x for child in node[1] for x in as_parts(child)] if node[0] == "div" else [as_lines(node)]


def as_lines(node, inner=False):
    kind, inside = node
    if kind in ("hidden", "script"):
        return 0, []
    if kind == "p":
        return 1, [" ".join(inside)]
    if kind == "pre":
        return 1, list(inside)
    if kind == "table":
        wide = [max(len(row[c]) for row in inside if len(row) > c) for c in range(max(map(len, inside)))]
        return 1, ["  ".join(c.ljust(n) for c, n in zip(row, wide, strict=False)).rstrip() for row in inside]
    lines = []
    for n, (word, sub) in enumerate(inside, 1):
        mark = "- " if kind == "ul" else f"{n}. "
        lines += [mark + word, *[" " * len(mark) + x for x in (as_lines(sub, True)[1] if sub else [])]]
    return 0 if inner else 1, lines


def joined(parts):
    lines, gap = [], 0
    for margin, own in parts:
        gap = max(gap, margin)
        if own:
            lines += [""] * (gap if lines else 0) + own
            gap = margin
    return lines


def test_layout_agrees_with_a_second_renderer():
    rng = random.Random(9)
    for turn in range(1500):
        trees = [random_tree(rng) for _ in range(rng.randrange(1, 5))]
        page = "".join(as_html(rng, x) for x in trees)
        assert layout.render(page) == "\n".join(joined([x for t in trees for x in as_parts(t)])), (turn, page)


@pytest.mark.parametrize("page", ["<div>" * 20000, "<b>" * 20000 + "</i>" * 20000, '<p "' * 5000, "<" * 50000, "<table><tr><td>" * 2000, "<li>" * 20000])
def test_layout_is_linear_in_hostile_pages(page):
    layout.render(page)


# ------------------------------------------------------------------ op3


def brute_classes(texts, alike=0.8):
    def bag(t):
        w = winnow_words(t)
        return [tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))] if w else []

    def counted(b):
        return {x: b.count(x) for x in set(b)}

    bags = [counted(bag(t)) if t is not None else None for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(texts)), 2):
        a, b = bags[i], bags[j]
        if a is None or b is None:
            continue
        same = sum(min(n, b.get(x, 0)) for x, n in a.items())
        total = sum(a.values()) + sum(b.values()) - same
        if total and same >= alike * total or not total and texts[i] == texts[j]:
            x, y = sorted((find(i), find(j)))
            root[y] = x
    return [find(i) for i in range(len(texts))]


def winnow_words(t):
    import re

    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


@pytest.mark.parametrize("small", [24, 2])
def test_classes_agree_with_brute_force(spark, monkeypatch, small):
    monkeypatch.setattr(bagminhash, "SMALL", small)
    monkeypatch.setattr(bagminhash, "BLOCK", 16)
    monkeypatch.setattr(bagminhash, "SPOKES", 2)
    rng = random.Random(5)
    base = [f"w{rng.randrange(500)}" for _ in range(120)]
    texts = list(ODD)
    for k in range(70):  # copies that drift away from their source
        t = list(base)
        for _ in range(k // 7):
            t[rng.randrange(len(t))] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(t))
    texts += [" ".join(base) + "!", " ".join(base).upper(), "a b c", "A b, C", " ".join(["one two three four five six"] * 50), " ".join(["one two three four five six"] * 49)]
    got = by_id(bagminhash.near_duplicates(docs_of(spark, texts, class_id="z", node="z")), "class_id", "class_size")
    want = brute_classes(texts)
    assert [got[i][0] for i in range(len(texts))] == want
    assert all(got[i][1] == (want.count(want[i])) for i in range(len(texts)))


def test_deduplicated_keeps_one_of_each(spark):
    docs = docs_of(spark, [*ODD, "Hello World"], root="z")
    docs = docs.unionByName(docs.where("doc_id in (4, 6)"))
    kept = sorted(r.doc_id for r in bagminhash.deduplicated(docs).collect())
    assert kept == [0, 1, 2, 3, 4, 5, 7, 8, 9, 10]
    assert bagminhash.deduplicated(docs.limit(0)).count() == 0 and bagminhash.near_duplicates(docs.limit(0)).count() == 0


def test_registers_estimate_weighted_similarity():
    rng = random.Random(2)
    errors = []
    for _ in range(30):
        base = [f"w{rng.randrange(60)}" for _ in range(200)]
        other = [w if rng.random() > 0.05 else "new" for w in base]
        texts = pa.array([" ".join(base * rng.randrange(1, 5)), " ".join(other)])
        s = bagminhash.signatures(*bagminhash.shingles(Words(texts)), 2)
        errors.append((s[0] == s[1]).mean() - bagminhash.similarity(texts.slice(0, 1), texts.slice(1, 1))[0])
    assert abs(np.mean(errors)) < 0.015 and np.std(errors) < 0.05


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(50)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r.node: r.root for r in bagminhash.components(edges).collect()}
    assert got == {**{i: 0 for i in range(1, 51)}, 101: 100}


# ------------------------------------------------------------------ op4


def test_packing_is_whole_and_tight(spark, monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(packing, "GROUP", 4)  # several groups and rounds
    rng = random.Random(3)
    texts = [*ODD, *[" ".join(rng.choice(["Alpha", "beta,", "it's", "Zürich"]) for _ in range(rng.randrange(1, 900))) for _ in range(60)]]
    docs = docs_of(spark, texts, bin="z", fill="z").repartition(7)
    rows = packing.pack(docs.unionByName(docs.where("doc_id = 5")), WORD_MODEL).collect()
    model = Tokenizer.from_file(WORD_MODEL)
    ids = {i: np.array([*model.encode(t or "", add_special_tokens=False).ids, 0], "<u4") for i, t in enumerate(texts)}
    for r in rows:
        own = ids[r.doc_id][r.start : r.start + r.length]
        assert len(own) == r.length and zlib.crc32(own.tobytes()) == r.ids_crc32 and r.start == 2048 * r.piece
        assert r.length == min(2048, len(ids[r.doc_id]) - r.start)
    assert sum(r.length for r in rows) == sum(map(len, ids.values())) + len(ids[5])
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for held in bins.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(bins) <= sum(r.length for r in rows) / 2048 * 1.1 + 2
    assert packing.pack(docs.limit(0), WORD_MODEL).count() == 0


def test_ids_of_units_are_the_library_s(monkeypatch):
    """Random texts of what units are cut at, composed and cased characters, special tokens, and a memory that is full at once."""
    from tokenizers import Tokenizer

    model, ids = Tokenizer.from_file(WORD_MODEL), packing.WordIds(WORD_MODEL)
    parts = ["a", "B", "'", "s", "'S", "LL", "1", "²", "½", "é", "É", "e\u0301", "H\u0331", "\u0338", "=", "<", "|>", "<|", "<|endoftext|>", "<|ENDOFTEXT|>"]
    parts += [" ", "\n", "\x0b", "\x1c", "\x00", "\x01", "\x85", "\xa0", "\u3000", "中", "Σ", "İ", "ß", "ÿ", "\xad", "ﬁ", "①", ".", ",", "!!", "word", "Ñandú", "y" * 40, "z" * 300]
    rng = random.Random(6)
    for turn in range(400):
        monkeypatch.setattr(packing, "REMEMBERED", rng.choice([3, 50, 600_000]))
        monkeypatch.setattr(packing, "AT_ONCE", rng.choice([1, 7, 1 << 18]))
        texts = [None, *["".join(rng.choice(parts) for _ in range(rng.randrange(40))) for _ in range(5)]]
        got, first = ids.of(pa.array(texts))
        for text, a, b in zip(texts, first[:-1], first[1:], strict=True):
            assert got[a:b].tolist() == [*model.encode(text or "", add_special_tokens=False).ids, 0], (turn, text)


def test_ids_of_long_texts_in_stretches():
    column = pa.array(["x" * 500, "word, " * 400, "", "no", "1a!" * 300 + " end"])
    data, ends = packing.utf8(column)
    ranges = list(packing.WordIds.stretches(data, ends, limit=100))
    assert ranges[0][0] == 0 and ranges[-1][1] == len(data) and all(a[1] == b[0] for a, b in zip(ranges, ranges[1:], strict=False)) and len(ranges) > 5
    ids = packing.WordIds(WORD_MODEL)
    whole = ids.of(column)[0]
    ids.stretches = lambda data, ends: iter(ranges)
    assert ids.of(column)[0].tolist() == whole.tolist()


def test_packing_is_near_the_bound_however_dealt(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    for parts in (1, 16, 64):
        found = packing.pack(docs.repartition(parts), WORD_MODEL)
        tokens, used = found.agg(F.sum("length"), F.count_distinct("sequence_id")).first()
        assert used <= 1.002 * -(-tokens // 2048), parts


def test_best_fit_takes_the_tightest_bin():
    bins, places, fills = packing.best_fit(np.array([6, 5, 4, 3, 2]), 10)
    assert bins.tolist() == [0, 1, 0, 1, 1] and places.tolist() == [0, 0, 6, 5, 8] and set(fills.tolist()) == {10}


# ------------------------------------------------------------------ op5


def test_network_learns_and_reads_whole_texts(spark):
    rng = random.Random(4)
    say = lambda letters, n: " ".join("".join(rng.choice(letters) for _ in range(5)) for _ in range(n))
    train = [(say("abcde", 80), "x") for _ in range(60)] + [(say("uvwxy", 80), "y") for _ in range(60)]
    net = bytecnn.fit([t for t, _ in train], [n for _, n in train], epochs=5)
    texts = [say("abcde", 30), say("uvwxy", 30), None, "", "12 34 !!", "z", say("abcde", 300) + " " + say("uvwxy", 3000)]
    got = by_id(bytecnn.identify(docs_of(spark, texts, lang_pred="q"), net), "lang_pred", "score")
    assert [got[i][0] for i in (0, 1, 2, 3, 4, 6)] == ["x", "y", "und", "und", "und", "y"]
    assert all(0 <= s <= 1 for _, s in got.values()) and got[5][0] in ("x", "y")
    kept = sorted(r.doc_id for r in bytecnn.identified(docs_of(spark, texts, lang_pred="q"), net, least=0.0).collect())
    assert kept == [0, 1, 5, 6]


def test_signs_are_no_letters():
    assert not any(map(bytecnn.has_letter, [None, "", "½ ² ① 7 _ !", "\u0301"])) and all(map(bytecnn.has_letter, ["é", "½a", "中", "ª"]))


def test_responses_agree_with_the_plain_convolution():
    rng = np.random.default_rng(3)
    net = bytecnn.fit(["abc def " * 20, "xyz uvw " * 20], ["x", "y"], epochs=1)
    windows = rng.integers(0, 256, (40, bytecnn.WINDOW)).astype(np.uint8)
    net._pairs = net.pairs()
    plain = []
    for table, bias in zip(net.tables, net.bias, strict=True):
        places = [sum(table[j][windows[:, i + j]] for j in range(len(table))) for i in range(bytecnn.WINDOW - len(table) + 1)]
        plain.append(np.max(places, axis=0) + bias)
    for got, direct, want in zip(net._responses(windows), bytecnn._direct(net, windows), plain, strict=True):
        assert np.allclose(got, want, atol=1e-5) and np.allclose(direct[0], want, atol=1e-5)
    hidden = np.maximum(0, np.concatenate(plain, axis=1)) @ net.dense + net.offset
    odds = np.exp(hidden - hidden.max(axis=1, keepdims=True))
    assert np.allclose(net.probabilities(windows), odds / odds.sum(axis=1, keepdims=True), atol=1e-5)


def test_network_without_labels(spark):
    docs = docs_of(spark, ["abc", None]).withColumn("lang", F.lit(None).cast("string"))
    assert bytecnn.trained(docs, F.lit(True)) is None
    assert set(by_id(bytecnn.identify(docs, None), "lang_pred").values()) == {"und"}
    assert bytecnn.identify(docs.limit(0), None).count() == 0


def test_filters_keep_extra_columns_and_repeated_rows(spark):
    docs = docs_of(spark, ["a word", "a word", "", None, "½"], lang="z", score="s", bands="b")
    docs = docs.unionByName(docs.where("doc_id = 0"))
    kept = bytecnn.identified(docs, bytecnn.fit(["a word here " * 9, "other said " * 9], ["x", "y"], epochs=1), least=0.0)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [0, 0, 1]
    good = linecrf.good_quality(docs, None)
    assert good.columns == docs.columns and sorted(r.doc_id for r in good.collect()) == [0, 0, 1, 2, 3, 4] and {r.bands for r in good.collect()} == {"b"}
    assert bytecnn.identified(docs.limit(0), None).count() == linecrf.good_quality(docs.limit(0), None).count() == 0


def test_every_language_is_learnt(spark, monkeypatch):
    monkeypatch.setattr(bytecnn, "LANGUAGES", 3)
    rows = [(i, f"some text {i} of it", f"l{i % 40:02}") for i in range(800)] + [(900, "one alone", "rare")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    texts, langs = bytecnn.sample(docs, F.lit(True), 10)
    assert set(langs) == {r[2] for r in rows} and len(texts) < 120
    assert len(bytecnn.fit(texts, langs, epochs=1).languages) == 41


def test_nothing_learnt_keeps_what_has_letters(spark):
    kept = bytecnn.identified(docs_of(spark, ["abc", None, "12 !", "", "é"]), None).collect()
    assert sorted(r.doc_id for r in kept) == [0, 4]


# ------------------------------------------------------------------ op6


def brute_top(vectors, k):
    out = {}
    for q, v in vectors:
        if q % 2 == 0:
            scores = sorted(((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in vectors if i != q))
            out[q] = [(i, -s) for s, i in scores[:k]]
    return out


@pytest.mark.parametrize("scale", [1, 10**5])
def test_top_k_agrees_with_brute_force(spark, monkeypatch, scale):
    for name, size in (("BLOCK", 16), ("QUERIES", 4), ("GROWTH", 2)):
        monkeypatch.setattr(topk, name, size)
    for name, size in (("TOGETHER", 1 if scale == 1 else 3), ("LANES", 4)):
        monkeypatch.setattr(topk, name, size)
    rng = np.random.default_rng(6)
    rows = [(i, [float(x) for x in rng.integers(-9, 9, 6) / 16 * scale]) for i in range(120)]
    rows += [(200 + i, rows[0][1]) for i in range(40)]  # many of one vector
    bad = [(300, None), (301, [None] * 6), (302, [float("nan")] * 6), (303, [float("inf")] * 6), (None, rows[1][1])]
    table = spark.createDataFrame([(i, v, "z") for i, v in rows + bad], "vec_id long, embedding array<float>, score string")
    got = {}
    for r in topk.top_k(table, "vec_id", "embedding", F.col("id") % 2 == 0, k=5).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    whole = [(i, [int(np.floor(64 * float(np.float32(x)))) for x in v]) for i, v in rows]
    assert {q: [x for _, x in sorted(v.items())] for q, v in got.items()} == brute_top(whole, 5)


def test_top_k_of_few_rows(spark):
    table = spark.createDataFrame([(2, [1.0, 0.0]), (3, [1.0, 1.0])], "vec_id long, embedding array<double>")
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in topk.top_k(table, "vec_id", "embedding", F.col("id") == 2).collect()] == [(2, 1, 3, 4096)]
    assert topk.top_k(table.limit(0), "vec_id", "embedding", F.lit(True)).count() == 0
    twice = spark.createDataFrame([(2, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [1.0, 1.0]), (4, []), (None, [9.0, 9.0])], "vec_id long, embedding array<double>")
    assert [(r.query_id, r.vec_id, r.score) for r in topk.top_k(twice, "vec_id", "embedding", F.col("id") == 2).collect()] == [(2, 3, 4096)]


# ------------------------------------------------------------------ op7


def brute_hits(texts, items):
    out = []
    for t in texts:
        w, hit, found = winnow_words(t), set(), set()
        for i, item in items:
            v = winnow_words(item)
            n = min(10, len(v))
            windows = {tuple(v[k : k + n]) for k in range(len(v) - n + 1)} if n else set()
            for k in range(len(w) - n + 1):
                if n and tuple(w[k : k + n]) in windows:
                    hit |= set(range(k, k + n))
                    found.add(i)
        out.append((len(w), len(hit), len(found)))
    return out


def test_contamination_agrees_with_brute_force(spark):
    rng = random.Random(8)
    word = lambda: rng.choice("abcdefgh")
    long = lambda n: " ".join(word() + word() for _ in range(n))
    items = [(i, long(n)) for i, n in enumerate([10, 11, 25, 60, 9, 5, 3, 1, 0])] + [(20, None), (21, "aa aa aa aa aa aa aa aa aa aa aa aa")]
    items += [(22, items[2][1])]
    texts = [*ODD, *[long(5) + ", " + items[k % len(items)][1].upper() + "! " + long(7) for k in range(9)], " ".join(items[2][1].split()[3:13]), " ".join(items[2][1].split()[3:12]), "aa " * 40]
    got = by_id(winnow.contamination(docs_of(spark, texts, key="z", n_hit="z"), spark.createDataFrame([(i, t, "k") for i, t in items], "item_id long, text string, key string")), "n_words", "n_hit", "n_items")
    want = brute_hits(texts, items)
    assert [got[i] for i in range(len(texts))] == want
    kept = {r.doc_id for r in winnow.decontaminated(docs_of(spark, texts, key="z"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert kept == {i for i, w in enumerate(want) if not w[1]}


def test_decontaminated_by_a_shuffle_and_with_a_larger_table(spark, monkeypatch):
    docs = docs_of(spark, [None, "", "a b c d e f g h i j k l", "b c d e f g h i j k", "b c d e f g h i j x"] * 2, key="z", item="z")
    items = spark.createDataFrame([(1, "b c d e f g h i j k")], "item_id long, text string")
    kept = sorted(r.doc_id for r in winnow.decontaminated(docs, items).collect())
    monkeypatch.setattr(winnow, "BROADCAST", 0)
    monkeypatch.setattr(winnow, "ADDRESS", 26)
    assert kept == [0, 1, 4, 5, 6, 9] == sorted(r.doc_id for r in winnow.decontaminated(docs, items).collect())


def test_contamination_without_items_or_documents(spark):
    docs, none = docs_of(spark, ODD), spark.createDataFrame([], "item_id long, text string")
    assert {tuple(r) for r in winnow.contamination(docs, none).select("n_hit", "n_items", "contaminated").collect()} == {(0, 0, False)}
    assert winnow.contamination(docs.limit(0), none).count() == 0


# ------------------------------------------------------------------ op8


def test_snapshots_collapse(spark):
    full = [("user", "hi"), ("assistant", "hello"), ("user", ""), ("assistant", None)]
    logs = {1: full[:1], 2: full[:2], 3: full, 4: full, 5: [("user", "hi"), ("user", "hello")], 6: full[:3], None: [("user", "hi"), (None, "x")], 8: [("assistant", "hello")]}
    rows = [(c, t, r, x, "z") for c, turns in logs.items() for t, (r, x) in enumerate(turns)] + [(9, None, "user", "first", "z"), (9, 0, "user", "then", "z")]
    got = {r.conv_id: (r.part, r.n_turns, r.n_copies, r.rendered) for r in snapshots.collapse(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, conv string")).orderBy("part").collect()}
    assert set(got) == {3, 5, None, 8, 9} and got[9][:2] == (1, 2) and "then" in got[9][3]  # a null number is a part before
    assert got[3][1:3] == (4, 2) and got[3][3].startswith("<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nhello")
    assert snapshots.collapse(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_long_conversations_come_in_parts(spark, monkeypatch):
    monkeypatch.setattr(snapshots, "BLOCK", 4)
    turns = [(c, t, "user", f"t{t}") for c, n in ((1, 11), (2, 30), (3, 30)) for t in range(n)]
    rows = snapshots.collapse(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")).orderBy("part").collect()
    assert {r.conv_id for r in rows} == {2} and [r.part for r in rows] == list(range(8)) and {r.n_copies for r in rows} == {2}
    assert "".join(r.rendered for r in rows) == "".join(f"<|im_start|>user\nt{t}<|im_end|>\n" for t in range(30))


def test_turns_of_one_number_are_spread_over_tasks(spark, monkeypatch):
    turns = [(c, n, "user", f"t{k % 300:03}") for c, many in ((None, 400), (None, 400), (2, 500)) for k in range(many) for n in (None, 7)]
    turns += [(3, t, r, x) for c, t, r, x in turns if c == 2] + [(4, None, "user", "t000")]
    table = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").repartition(3)
    monkeypatch.setattr(snapshots, "PART_BYTES", 2000)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        widest = snapshots.prefixes(table).select("conv", "block", F.spark_partition_id().alias("task")).distinct().groupBy("conv", "block").count()
        rows = snapshots.collapse(table).collect()
        assert max(r["count"] for r in widest.collect()) > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert {(r.conv_id, r.n_turns, r.n_copies) for r in rows} == {(None, 1600, 1), (2, 1000, 2)}
    for conv in (None, 2):
        mine = sorted((r for r in rows if r.conv_id == conv), key=lambda r: r.part)
        whole = sorted((n is not None, x) for c, n, _, x in turns if c == conv)
        assert [r.part for r in mine] == list(range(len(mine))) and max(len(r.rendered) for r in mine) < 2100
        assert "".join(r.rendered for r in mine) == "".join(f"<|im_start|>user\n{x}<|im_end|>\n" for _, x in whole)


# ------------------------------------------------------------------ op9


def test_counts_agree_with_the_library(spark):
    import sentencepiece

    rng = random.Random(9)
    bits = ["a", "The", " ", "  ", "\n", "\t", "é", "中", "▁", "<s>", "</s>", "<0x0A>", "\x00", "ing", "①", "😀", "\r\n", " "]
    texts = [*ODD, *["".join(rng.choice(bits) for _ in range(rng.randrange(30))) for _ in range(400)]]
    model = sentencepiece.SentencePieceProcessor(model_file=PIECE_MODEL)
    got = by_id(tokencount.count_tokens(docs_of(spark, texts, n_tokens="z"), PIECE_MODEL), "n_tokens")
    assert [got[i] for i in range(len(texts))] == [len(model.encode(t or "")) for t in texts]
    assert tokencount.count_tokens(docs_of(spark, ["a"]).limit(0), PIECE_MODEL).count() == 0


# ------------------------------------------------------------------ op10


def test_forward_backward_agrees_with_all_paths():
    rng = np.random.default_rng(10)
    first = np.array([0, 4, 5, 8])
    odds, moves = rng.normal(size=8), rng.normal(size=(2, 2))
    good, pairs = linecrf.forward_backward(odds, moves, first)
    want, seen = np.zeros(8), np.zeros((2, 2))
    for a, b in itertools.pairwise(first):
        total, mine, pair = 0.0, np.zeros(b - a), np.zeros((2, 2))
        for labels in itertools.product((0, 1), repeat=b - a):
            w = np.exp(sum(odds[a + i] * y for i, y in enumerate(labels)) + sum(moves[p] for p in itertools.pairwise(labels)))
            total += w
            mine += w * np.array(labels)
            for p in itertools.pairwise(labels):
                pair[p] += w
        want[a:b] = mine / total
        seen += pair / total
    assert np.allclose(good, want) and np.allclose(pairs, seen)


def test_lines_of_odd_texts():
    x, length, first = linecrf.lines(pa.array(["a\n\nb c", "", None, "\n", "é"]))
    assert np.diff(first).tolist() == [3, 1, 1, 2, 1] and length.tolist() == [1, 0, 3, 0, 0, 0, 0, 2] and np.isfinite(x).all()


def test_field_tells_junk_from_prose(spark):
    rng = random.Random(11)
    prose = lambda n: "\n".join("The " + " ".join(rng.choice(["river", "stone", "of", "and", "walks"]) for _ in range(9)) + "." for _ in range(n))
    junk = lambda n: "\n".join(" | ".join(rng.choice(["BUY", "NOW", "$$$", "%%%"]) for _ in range(9)) for _ in range(n))
    texts = [prose(6) for _ in range(80)] + [prose(1) + "\n" + junk(6) for _ in range(80)]
    field = linecrf.fit(texts, [1] * 80 + [0] * 80, {0: 1.0, 1: 1.0}, rounds=2, steps=40)
    more = [prose(5), junk(5), prose(2) + "\n" + junk(9), *ODD]
    got = by_id(linecrf.score_quality(docs_of(spark, more, score="z"), field), "score", "predicted")
    assert [got[i][1] for i in range(3)] == [1, 0, 0] and all(0 <= s <= 1 for s, _ in got.values()) and len(got) == len(more)
    kept = {r.doc_id for r in linecrf.good_quality(docs_of(spark, more, score="z"), field).collect()}
    assert kept == {i for i, (_, p) in got.items() if p}


def test_field_without_labels(spark):
    docs, none = docs_of(spark, ODD), spark.createDataFrame([], "doc_id long, quality int")
    assert linecrf.trained(docs, none, F.lit(True)) is None
    assert set(by_id(linecrf.score_quality(docs, None), "score").values()) == {0.5}
