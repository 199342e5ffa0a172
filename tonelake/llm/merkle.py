"""Fixity audit of archive replicas by Merkle trees over offset ranges.

A record's hash binds its file, offset and content. A leaf covers a range of
offsets of one file and hashes the number of its records and eight sums of 32
bits over their hashes; each binds its offset, so the sum stands for the ordered
range, is a plain aggregate, and no range is gathered in one place, however full
it is. Above the leaves every node hashes its children in order of offset. Two
replicas are compared from the roots down: a level is joined only below nodes
that differ, and records are compared only in leaves that differ.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Bits of the offsets in a leaf, and of the children of a node: 64 and 16.
SPAN, FANOUT = 6, 4
_WORDS = 8


def record_hash(file: str, offset: str, content: list[str]) -> Column:
    """SHA-256 of a record as hex; nulls differ from empty values, and no two lists of values read alike."""
    parts = [F.coalesce(F.concat(F.octet_length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("-")) for c in (file, offset, *content)]
    return F.sha2(F.concat_ws("|", *parts), 256)


def hashed(records: DataFrame, file: str, offset: str, content: list[str]) -> DataFrame:
    """(file, offset, leaf, hash) of each record."""
    at = F.col(offset).cast("long")
    return records.select(
        F.col(file).cast("string").alias("file"),
        at.alias("offset"),
        F.shiftright(at, SPAN).alias("leaf"),
        record_hash(file, offset, content).alias("hash"),
    )


def leaves(records: DataFrame) -> DataFrame:
    """(file, node, digest, records) of each range of offsets."""
    # eight sums of 32 bits each; a sum of fewer than 2**31 of them fits
    sums = [F.sum(F.conv(F.substring("hash", 8 * k + 1, 8), 16, 10).cast("long")).alias(f"s{k}") for k in range(_WORDS)]
    whole = records.groupBy("file", F.col("leaf").alias("node")).agg(F.count("*").alias("records"), *sums)
    digest = F.sha2(F.concat_ws(",", F.col("records"), *[F.pmod(F.col(f"s{k}"), F.lit(1 << 32)) for k in range(_WORDS)]), 256)
    return whole.select("file", "node", digest.alias("digest"), "records")


def height(every: list[DataFrame]) -> int:
    """Levels above the leaves (of all replicas) until each file has at most two nodes, one on either side of offset 0."""
    ends = [x.agg(F.min("node"), F.max("node")).first() for x in every]
    low, high = (min([v for v in side if v is not None], default=0) for side in ([e[0] for e in ends], [-e[1] for e in ends if e[1] is not None]))
    low, high, n = low, -high, 0
    while low < -1 or high > 0:
        low, high, n = low >> FANOUT, high >> FANOUT, n + 1
    return n


def above(nodes: DataFrame, top: bool = False) -> DataFrame:
    """The parents of ``nodes``: each hashes its children, of which it has at most 16; a root has three at most."""
    parent = F.lit(0).cast("long") if top else F.shiftright("node", FANOUT)
    child = F.sort_array(F.collect_list(F.concat_ws(":", F.lpad((F.col("node") + (1 << 62)).cast("string"), 20, "0"), "digest")))
    return nodes.groupBy("file", parent.alias("node")).agg(F.sha2(F.concat_ws(",", child), 256).alias("digest"), F.sum("records").alias("records"))


def trees(*records: DataFrame) -> list[list[DataFrame]]:
    """Of each replica the levels of nodes from the leaves up to those below the files' roots, each written once."""
    found = [[cut(leaves(x))] for x in records]
    n = height([x[0] for x in found])
    for levels in found:
        for _ in range(n):
            levels.append(cut(above(levels[-1])))
    return found


def tree(records: DataFrame) -> list[DataFrame]:
    return trees(records)[0]


def roots(levels: list[DataFrame]) -> DataFrame:
    """(file, digest, records): one root for each file."""
    return above(levels[-1], top=True).select("file", "digest", "records")


def _differing(a: DataFrame, b: DataFrame) -> DataFrame:
    """(file, node) where the replicas' nodes differ, or only one has one."""
    return (
        a.select("file", "node", F.col("digest").alias("d"))
        .unionByName(b.select("file", "node", F.col("digest").alias("d")))
        .groupBy("file", "node")
        .agg(F.count("*").alias("n"), F.min("d").alias("lo"), F.max("d").alias("hi"))
        .where("n < 2 or lo <> hi")
        .select("file", "node")
    )


def _within(rows: DataFrame, node: Column, chosen: DataFrame) -> DataFrame:
    """The rows whose file and node are among the chosen ones."""
    chosen = chosen.select(F.col("file").alias("its_file"), F.col("node").alias("its_node"))
    return rows.join(chosen, F.col("file").eqNullSafe(F.col("its_file")) & node.eqNullSafe(F.col("its_node")), "left_semi")


def audit(primary: DataFrame, replica: DataFrame, file: str, offset: str, content: list[str]) -> DataFrame:
    """Where two replicas of an archive differ.

    One row for each offset with a difference: file, offset, leaf, kind
    (``changed``, ``missing`` from the replica, ``extra`` in it), n_primary and
    n_replica records there, primary_sha256 and replica_sha256 (the record's
    hash if there is one, else null). Records are told apart by offset and
    content, so the order of rows does not matter; records that repeat are
    counted. Null files and offsets are values of their own; null content
    differs from empty content. Equal or empty replicas give no rows. Other
    columns are not read.
    """
    sides = [hashed(x, file, offset, content) for x in (primary, replica)]
    both = trees(*sides)
    bad = cut(_differing(*[above(t[-1], top=True) for t in both]))
    differing = cut(_differing(*[_within(t[-1], F.lit(0).cast("long"), bad) for t in both]))
    for k in range(len(both[0]) - 2, -1, -1):
        differing = cut(_differing(*[_within(t[k], F.shiftright("node", FANOUT), differing) for t in both]))
    found = []
    for name, x in zip(("p", "r"), sides, strict=True):
        near = _within(x, F.col("leaf"), differing)
        found.append(near.groupBy("file", "offset", "leaf", "hash").agg(F.count("*").alias("n")).withColumn("side", F.lit(name)))
    every = found[0].unionByName(found[1])
    uneven = every.groupBy("file", "offset", "leaf", "hash").agg(
        F.sum(F.when(F.col("side") == "p", F.col("n")).otherwise(0)).alias("p"), F.sum(F.when(F.col("side") == "r", F.col("n")).otherwise(0)).alias("r")
    )
    spot = uneven.groupBy("file", "offset", "leaf").agg(
        F.sum("p").alias("n_primary"), F.sum("r").alias("n_replica"),
        F.max((F.col("p") != F.col("r")).cast("int")).alias("differs"),
        F.min(F.when(F.col("p") > F.col("r"), F.col("hash"))).alias("primary_sha256"),
        F.min(F.when(F.col("r") > F.col("p"), F.col("hash"))).alias("replica_sha256"),
    )
    kind = F.when(F.col("primary_sha256").isNull(), "extra").when(F.col("replica_sha256").isNull(), "missing").otherwise("changed")
    return spot.where("differs = 1").select(
        "file", "offset", "leaf", kind.alias("kind"), "n_primary", "n_replica", "primary_sha256", "replica_sha256"
    )
