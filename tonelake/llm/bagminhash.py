"""Near duplicates by weighted Jaccard similarity of word shingles, found with BagMinHash.

A text is the multiset of its runs of five words. Every shingle owns a Poisson
process of points over time and weight. The weight axis is cut into dyadic
intervals (0, 1], (1, 2], (2, 4] ..., the process of an interval comes as one,
and its points fall on the whole weights inside; those above the shingle's
count in a text are not the text's. Each point also picks a register, and a
register keeps the earliest point. Two texts agree in a register with the
probability of their weighted Jaccard similarity, and only the earliest few
points of each process are ever made.

Registers are banded. A bucket, however large, is not paired off: all its
members are compared with one pivot, the member that shares most buckets, and
the links found are closed into classes. Then only members outside a bucket's
largest class are compared with those of other classes there: pair by pair in
small buckets, block by block in large ones, where only links come out. So all
links between classes that any bucket can show are verified, and a group of
copies of one text costs as many comparisons as it has members.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SLICE_BYTES, Words, cut, mix, slices

WORDS, ALIKE = 5, 0.8
#: 48 bands of 8 registers: a pair at a similarity of 0.8 shares none with a probability of 0.00015.
BANDS, ROWS = 48, 8
#: Points made at once while signing, which bounds memory however many short texts a batch has.
POINTS = 1 << 18
#: Members up to which a bucket is small, and members and characters of a block of a larger one, about.
SMALL, BLOCK, BLOCK_CHARACTERS = 24, 128, 1 << 22
#: Comparisons with one pivot that go to one task, about.
SPOKES = 512
#: Occurrences of a shingle that are elements of their own where blocks of texts are compared.
LAYERS = 3

_U = np.uint64
_STEP, _LEVEL, _REGISTER = _U(0x9E3779B97F4A7C15), _U(0xD6E8FEB86659FD93), _U(0xA0761D6478BD642F)


def shingles(words: Words, k: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, shingle) with their counts, by text; texts of fewer words are one shingle."""
    owners, left, counts = words.owners(), words.left(), words.counts
    own, hashes = [owners[left >= k]], [words.grams(k)[left >= k]]
    for n in range(1, k):
        short = np.flatnonzero(counts == n)
        if len(short):
            own.append(short)
            hashes.append(words.grams(n)[words.first[short]])
    own, hashes = np.concatenate(own), np.concatenate(hashes)
    order = np.lexsort((hashes, own))
    own, hashes = own[order], hashes[order]
    new = np.ones(len(own), bool)
    new[1:] = (own[1:] != own[:-1]) | (hashes[1:] != hashes[:-1])
    at = np.flatnonzero(new)
    return own[at], hashes[at], np.diff(at, append=len(own))


def _uniform(x: np.ndarray) -> np.ndarray:
    return ((x >> _U(11)).astype(np.float64) + 0.5) * 2.0**-53


def signatures(own: np.ndarray, hashes: np.ndarray, counts: np.ndarray, n: int, registers: int = BANDS * ROWS) -> np.ndarray:
    """For each of n texts the registers' winning points; texts without shingles have zeros."""
    # about so many points are made of a text: those of its registers, and two of each shingle
    cost = np.cumsum(registers * (np.log(registers) + 3) + 2 * np.bincount(own, minlength=n))
    bounds = np.append(np.flatnonzero(np.diff(cost // POINTS, prepend=-1)), n)
    out = [np.zeros((0, registers), np.uint64)]
    for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
        a, b = np.searchsorted(own, (lo, hi))
        out.append(_signed(own[a:b] - lo, hashes[a:b], counts[a:b], int(hi - lo), registers))
    return np.concatenate(out)


def _signed(own: np.ndarray, hashes: np.ndarray, counts: np.ndarray, n: int, registers: int) -> np.ndarray:
    # a process for every dyadic interval that begins below the count
    depth = np.ceil(np.log2(counts)).astype(np.int64) + 1
    rep = np.repeat(np.arange(len(own)), depth)
    j = np.arange(len(rep)) - np.repeat(np.cumsum(depth) - depth, depth)
    doc, top = own[rep], counts[rep]
    seed = mix(hashes[rep] + _LEVEL * j.astype(np.uint64))
    rate = np.where(j == 0, 1, 2.0 ** np.maximum(0, j - 1))
    base = np.where(j == 0, 0, rate).astype(np.int64)
    weight = np.bincount(own, counts, n)
    first = np.full(n * registers, np.inf)
    value = np.zeros(n * registers, np.uint64)
    # by this time a register is empty with a probability of e**-9 / registers; texts with one go on
    until = registers * (np.log(registers) + 3) / np.maximum(weight, 1)
    clock, made = np.zeros(len(rep)), np.zeros(len(rep), np.int64)
    live = np.arange(len(rep))
    while len(live):
        while len(live):
            want = np.ceil((until[doc[live]] - clock[live]) * rate[live]).astype(np.int64) + 1
            want = np.minimum(want, 1 << 12)
            e = np.repeat(live, want)
            begin = np.cumsum(want) - want
            nth = np.arange(len(e)) - np.repeat(begin, want)
            point = mix(seed[e] + _STEP * (made[e] + nth + 1).astype(np.uint64))
            gap = np.cumsum(-np.log(_uniform(point)) / rate[e])
            gap -= np.repeat(gap[begin] + np.log(_uniform(point[begin])) / rate[live], want)
            time = clock[e] + gap
            other = mix(point ^ _REGISTER)
            level = base[e] + 1 + ((other >> _U(32)) % np.maximum(1, rate[e]).astype(np.uint64)).astype(np.int64)
            ok = np.flatnonzero((time <= until[doc[e]]) & (level <= top[e]))
            place = doc[e[ok]] * registers + ((other[ok] & _U(0xFFFFFFFF)) % _U(registers)).astype(np.int64)
            np.minimum.at(first, place, time[ok])
            won = first[place] == time[ok]
            value[place[won]] = point[ok[won]]
            last = begin + want - 1
            clock[live], made[live] = time[last], made[live] + want
            live = live[clock[live] <= until[doc[live]]]
        open_ = np.isinf(first).reshape(n, registers).any(axis=1) & (weight > 0)
        if not open_.any():
            break
        # processes whose next point is known only to be late start anew, which changes nothing before it
        until = np.where(open_, until * 2, until)
        live = np.flatnonzero(open_[doc])
        clock[live], made[live] = 0, 0
    return value.reshape(n, registers)


def banded(value: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """One key for each band, different between bands."""
    part = value.reshape(len(value), bands, rows)
    key = np.broadcast_to(np.arange(bands, dtype=np.uint64) + _U(1), part.shape[:2]).copy()
    for r in range(rows):
        key = mix(key * _STEP + part[:, :, r])
    return key.view(np.int64)


def _signed_sum(x: np.ndarray, own: np.ndarray, n: int) -> np.ndarray:
    total = np.zeros(n, np.uint64)
    np.add.at(total, own, x)
    return total.view(np.int64)


def _features(key: str):
    """Each row's multiset in 128 bits (of a text without words: the text's), its weight, and its band keys."""

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            n = batch.num_rows
            own, hashes, counts = shingles(Words(batch.column("text")))
            many = counts.astype(np.uint64)
            k1 = _signed_sum(mix(hashes ^ _LEVEL) * many, own, n)
            k2 = _signed_sum(mix(hashes ^ _REGISTER) * many, own, n)
            weight = np.bincount(own, counts, n).astype(np.int64)
            bare = np.flatnonzero(weight == 0)
            for i in bare:
                text = batch.column("text")[int(i)].as_py()
                if text is not None:
                    k1[i], k2[i] = np.frombuffer(hashlib.blake2b(text.encode(), digest_size=16).digest(), np.int64)
            keys = banded(signatures(own, hashes, counts, n))
            some = np.where(weight > 0, BANDS, 0)
            lists = pa.ListArray.from_arrays(
                pa.array(np.append(0, np.cumsum(some)).astype(np.int32)), pa.array(keys[weight > 0].ravel())
            )
            yield pa.record_batch(
                [batch.column("doc_id"), batch.column("print"), pa.array(k1), pa.array(k2), pa.array(weight), lists],
                ["doc_id", "print", "k1", "k2", "weight", "bands"],
            )

    return features


def similarity(left: pa.Array, right: pa.Array) -> np.ndarray:
    """Weighted Jaccard similarity of the shingles of each pair of texts; 0 where one has no words."""
    n = len(left)
    sides = [shingles(Words(x)) for x in (left, right)]
    own, hashes, counts = (np.concatenate([s[k] for s in sides]) for k in range(3))
    order = np.lexsort((hashes, own))
    own, hashes, counts = own[order], hashes[order], counts[order]
    both = np.flatnonzero((own[1:] == own[:-1]) & (hashes[1:] == hashes[:-1]))
    shared = np.bincount(own[both], np.minimum(counts[both], counts[both + 1]), n)
    total = np.bincount(own, counts, n)
    return shared / np.maximum(total - shared, 1)


def _linked(alike: float):
    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(slices(batches, "a_text"), "b_text"):
            ok = similarity(batch.column("a_text"), batch.column("b_text")) >= alike
            yield batch.select(["a", "b"]).filter(pa.array(ok))

    return linked


def _across(alike: float):
    """Links between members aside and others of a bucket that are of different classes, one for each class met.

    Rows come bucket by bucket and block by block, in each the block's members
    and then those aside, which are taken a few at a time.
    """

    def side(rows: list[tuple]) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]:
        return np.array([r[0] for r in rows]), np.array([r[1] for r in rows]), shingles(Words(pa.array([r[2] for r in rows], pa.string())))

    def met(aside: list[tuple], others: tuple) -> pa.RecordBatch:
        (a, ra, sa), (b, rb, sb) = side(aside), others
        ok = _overlaps(sa, sb, len(a), len(b)) >= alike
        x, y = np.nonzero(ok & (ra[:, None] != rb[None, :]))
        _, first = np.unique(np.stack([a[x], rb[y]]), axis=1, return_index=True)
        return pa.record_batch([pa.array(a[x[first]]), pa.array(b[y[first]])], ["a", "b"])

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, block, others, aside, held = None, [], None, [], 0
        for batch in slices(batches, "text"):
            columns = [batch.column(c).to_pylist() for c in ("h", "block", "aside", "node", "root", "text")]
            for h, nth, away, *row in zip(*columns, strict=True):
                if (h, nth) != key or len(aside) == BLOCK or held > SLICE_BYTES:
                    if aside:
                        yield met(aside, others)
                    aside, held = [], 0
                if (h, nth) != key:
                    key, block, others = (h, nth), [], None
                if not away:
                    block.append(row)
                    continue
                if others is None:
                    others = side(block)
                aside.append(row)
                held += len(row[2])
        if aside:
            yield met(aside, others)

    return across


def _overlaps(sa: tuple, sb: tuple, na: int, nb: int, step: int = 1 << 13) -> np.ndarray:
    """Weighted Jaccard similarity of every text of one block with every text of another.

    The first few occurrences of a shingle are elements of their own, so that
    shared counts are products of 0s and 1s. What is beyond them is of a few
    shingles in few texts, which are compared one shingle after another.
    """
    total = [np.bincount(s[0], s[2], n) for s, n in ((sa, na), (sb, nb))]
    shared = np.zeros((na, nb))
    for layer in range(1, LAYERS + 1):
        (oa, ha), (ob, hb) = ((s[0][s[2] >= layer], s[1][s[2] >= layer]) for s in (sa, sb))
        both = np.intersect1d(ha, hb)
        if not len(both):
            break
        for k in range(0, len(both), step):
            some = both[k : k + step]
            one = []
            for own, hashes, n in ((oa, ha, na), (ob, hb, nb)):
                at = np.minimum(np.searchsorted(some, hashes), len(some) - 1)
                hit = some[at] == hashes
                m = np.zeros((n, len(some)), np.float32)
                m[own[hit], at[hit]] = 1
                one.append(m)
            shared += one[0] @ one[1].T
    often = []
    for own, hashes, counts in (sa, sb):
        more = np.flatnonzero(counts > LAYERS)
        more = more[np.argsort(hashes[more], kind="stable")]
        often.append((own[more], hashes[more], counts[more] - LAYERS))
    for h in np.intersect1d(often[0][1], often[1][1]):
        (oa, ca), (ob, cb) = ((own[k], counts[k]) for own, hashes, counts in often for k in [slice(np.searchsorted(hashes, h), np.searchsorted(hashes, h, "right"))])
        shared[np.ix_(oa, ob)] += np.minimum.outer(ca, cb)
    return shared / np.maximum(total[0][:, None] + total[1][None, :] - shared, 1)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``edges`` (a, b), root being the least node it is connected with.

    Large-star and small-star steps in turn, until no edge changes: every node
    is tied to the least of its neighbours, so paths shorten by halves, and no
    node's neighbours are gathered in one place.
    """
    now = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before or state[0] == 0:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = state
        sides = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = sides.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = sides.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        now = cut(
            small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .unionByName(least.select("a", F.col("m").alias("b")))
            .where("a <> b").distinct()
        )


def _classes(docs: DataFrame, alike: float) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, print, k1, k2, empty), and distinct multisets (k1, k2, doc_id, print, root)."""
    key = docs.schema["doc_id"].dataType.simpleString()
    given = docs.select("doc_id", "text", F.xxhash64("text").alias("print"))
    rows = cut(
        given.mapInArrow(_features(key), f"doc_id {key}, print long, k1 long, k2 long, weight long, bands array<long>").withColumn(
            "void", (F.col("k1") == 0) & (F.col("k2") == 0)
        )
    )
    kinds = rows.where("not void").groupBy("k1", "k2", "weight").agg(F.min(F.struct("doc_id", "print")).alias("rep"), F.first("bands").alias("bands"))
    # numbered after the cut, so that the numbers stay
    nodes = cut(kinds.select("k1", "k2", "weight", "rep.doc_id", "rep.print", "bands")).withColumn("node", F.monotonically_increasing_id())

    keys = nodes.select("node", "weight", F.explode("bands").alias("h"))
    full = keys.groupBy("h").agg(F.count("*").alias("n")).where("n > 1")
    members = cut(keys.join(full, "h"))
    shared = members.groupBy("node").agg(F.sum("n").alias("pop"))
    pivots = members.join(shared, "node").groupBy("h").agg(F.max(F.struct("pop", -F.col("node"), "weight")).alias("p"))
    pivots = pivots.select("h", (-F.col("p.col2")).alias("pivot"), F.col("p.weight").alias("p_weight"))
    # beyond this ratio of weights no pair can be alike
    close = lambda x, y: F.least(x, y) >= alike * F.greatest(x, y)
    stars = cut(
        members.join(pivots, "h")
        .where((F.col("node") != F.col("pivot")) & close("weight", "p_weight"))
        .groupBy(F.col("node").alias("a"), F.col("pivot").alias("b"))
        .agg(F.max("n").alias("n"))
    )
    within = members.select("node").distinct()
    wanted = nodes.join(within, "node").select("node", F.col("doc_id").alias("own_id"), F.col("print").alias("own_print"))
    texts = given.join(wanted, (F.col("print") == F.col("own_print")) & F.col("doc_id").eqNullSafe(F.col("own_id")))
    texts = cut(texts.select("node", "text").dropDuplicates(["node"]))

    def verified(pairs: DataFrame) -> DataFrame:
        """Pairs (a, b, share) that are alike; the pairs of one b are dealt over ``share`` tasks."""
        dealt = pairs.select("a", "b", "share", F.pmod(F.xxhash64("a"), F.col("share")).alias("salt"))
        shares = pairs.select("b", "share").distinct()
        b = texts.join(shares, F.col("node") == F.col("b")).select("b", "share", F.explode(F.sequence(F.lit(0).cast("long"), F.col("share") - 1)).alias("salt"), F.col("text").alias("b_text"))
        a = texts.select(F.col("node").alias("a"), F.col("text").alias("a_text"))
        sided = dealt.join(b, ["b", "share", "salt"]).join(a, "a").select("a", "b", "a_text", "b_text")
        return sided.mapInArrow(_linked(alike), "a long, b long")

    # a bucket's size tells how many pairs its pivot may have there; powers of two, so that these are few for each pivot
    share = F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(F.lit(1.0), F.col("n") / SPOKES)))).cast("long")
    roots = components(verified(stars.select("a", "b", share.alias("share"))))
    placed = members.join(roots, "node", "left").select("h", "node", "weight", F.coalesce("root", "node").alias("root"))
    sizes = placed.groupBy("h", "root").agg(F.count("*").alias("n"))
    main = sizes.groupBy("h").agg(F.max(F.struct("n", "root")).alias("m"), F.count("*").alias("roots"), F.sum("n").alias("all")).where("roots > 1")
    placed = cut(placed.join(main.select("h", F.col("m.root").alias("main"), "all"), "h"))
    small = placed.where(F.col("all") <= SMALL)
    aside = small.where("root <> main").select("h", F.col("node").alias("u"), F.col("root").alias("u_root"), F.col("weight").alias("u_weight"))
    rest = (
        aside.join(small, "h")
        .where((F.col("root") != F.col("u_root")) & close("weight", "u_weight"))
        .select(F.greatest("node", "u").alias("a"), F.least("node", "u").alias("b"))
        .distinct()
        .join(stars.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), ["a", "b"], "left_anti")
    )
    sizes = texts.select("node", F.length("text").cast("long").alias("size"))
    large = placed.where(F.col("all") > SMALL).join(sizes, "node")
    many = large.groupBy("h").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("size") / BLOCK_CHARACTERS)).alias("blocks"))
    # every member is in one block, and each one aside is sent to all blocks of its bucket
    large = large.join(many, "h").select("h", "node", "root", "main", "blocks")
    own = large.select("h", F.pmod(F.xxhash64("node"), F.col("blocks")).alias("block"), F.lit(False).alias("aside"), "node", "root")
    sent = large.where("root <> main").select("h", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), F.lit(True).alias("aside"), "node", "root")
    blocks = own.unionByName(sent).join(texts, "node").repartition("h", "block").sortWithinPartitions("h", "block", "aside", "node")
    across = blocks.select("h", "block", "aside", "node", "root", "text").mapInArrow(_across(alike), "a long, b long")
    more = verified(cut(rest).withColumn("share", F.lit(1).cast("long"))).unionByName(across)
    final = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more))
    return rows, nodes.join(final, "node", "left").select("k1", "k2", "doc_id", "print", F.coalesce("root", "node").alias("root"))


def near_duplicates(docs: DataFrame, alike: float = ALIKE) -> DataFrame:
    """(doc_id, class_id, class_size) of each row of ``docs`` (doc_id, text).

    Rows linked by a similarity of ``alike`` or more, directly or through
    others, are one class, and its id is its least doc_id. Texts of one word
    multiset are linked; of texts without words only equal ones are; rows with
    null text are alone. Repeated rows stay and are of one class. An empty
    table gives an empty one; other columns are not read.
    """
    rows, kinds = _classes(docs, alike)
    sizes = rows.where("not void").groupBy("k1", "k2").agg(F.count("*").alias("copies"))
    kinds = kinds.join(sizes, ["k1", "k2"])
    whole = kinds.groupBy("root").agg(F.min("doc_id").alias("class_id"), F.sum("copies").alias("class_size"))
    named = kinds.select("k1", "k2", "root").join(whole, "root")
    found = rows.where("not void").join(named, ["k1", "k2"]).select("doc_id", "class_id", "class_size")
    alone = rows.where("void").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("class_size"))
    return found.unionByName(alone)


def deduplicated(docs: DataFrame, alike: float = ALIKE) -> DataFrame:
    """The rows of ``docs``, with all columns, that come first in their class.

    The first is the one of the least doc_id (a null id before all), of rows
    that repeat id and text one. Null texts are no copies and stay, each row of
    them; texts without words are copies of equal ones only; an empty table
    gives an empty one; other columns are carried along unread.
    """
    _, kinds = _classes(docs, alike)
    kept = kinds.groupBy("root").agg(F.min(F.struct("doc_id", "print")).alias("k")).select("k.doc_id", "k.print")
    mark = F.xxhash64(docs["text"])
    first = docs.join(kept, (mark == kept["print"]) & docs["doc_id"].eqNullSafe(kept["doc_id"]), "left_semi")
    # rows that repeat have the same id and text
    return first.where(F.col("text").isNotNull()).dropDuplicates(["doc_id", "text"]).unionByName(docs.where(F.col("text").isNull()))
