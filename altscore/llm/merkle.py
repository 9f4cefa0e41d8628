"""A Merkle manifest of documents: one hash tree per language, one over their roots.

Leaves (SHA-256 of the row's columns, each with its length) are ranked within
their language by ranges, without a window over a language.  Aligned subtrees of
2^HEIGHT leaves (*blocks*) are built one per group and stored in van Emde Boas
order (``veb``).  The roots of a level of blocks are the leaves of the next one, until
each language has one block; the languages' roots are the leaves of a last forest
of one tree.  A proof goes the other way: from the top block down, each block
hands its leaves the way from them to the root, so a document's proof is what
its own block and those above hold; only digests and ids are ever shuffled, and
above the first level only one digest for 2^HEIGHT leaves.

Defined results: null columns are hashed as ``-`` and others as length and value,
so null and empty differ; null languages are a tree of their own, before all
others; null ids come first; rows of equal language and id are ordered by leaf, and
rows that are equal altogether get leaves side by side; a language of one document
has its leaf as root, a table of one document that leaf; without any sibling the proof is the hash of
nothing; empty tables give empty results; further columns are ignored, with any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import veb
from .common import arrow_batches, staged

HEIGHT = 10                # steps from a full block's leaves to its root
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
ALL = "all"                # key of the tree over the languages' roots
BLOCK = "key string, level int, block long, first long, n int, nodes binary, root string"


def digest(values: list[Column]) -> Column:
    """Lowercase hex SHA-256 of the values, each ``-`` if null, else byte length, colon, value."""
    def one(v):
        t = v.cast("string")
        return F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-"))
    return F.sha2(F.concat(*map(one, values)).cast("binary"), 256)


def leaves(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """doc_id, lang, key, rank, leaf and (where ``tampered`` holds and it differs) other, the leaf of the row
    with ``n_chars`` one larger.  Stored; rank counts from 0 within the key, which stands for the language."""
    columns = [F.col(c) for c in FIELDS]
    changed = [c + 1 if n == "n_chars" else c for c, n in zip(columns, FIELDS)]
    other = F.lit(None).cast("string")
    if tampered is not None:
        other = F.when(tampered & F.col("n_chars").isNotNull(), digest(changed))
    d = docs.select("doc_id", "lang", key_of(F.col("lang")).alias("key"), digest(columns).alias("leaf"), other.alias("other"))
    # stored first: ranges are sampled, which would read the texts twice.
    # The last key tells rows apart that are equal in all that counts.
    d = staged(d.withColumn("tie", F.monotonically_increasing_id()), "merkle-digests")
    return ranked(d, ["doc_id", "leaf", "tie"]).drop("tie")


def key_of(lang: Column) -> Column:
    """Not null, and in the order of the languages: null first, then bytewise."""
    return F.coalesce(F.concat(F.lit("="), lang.cast("string")), F.lit(""))


def ranked(d: DataFrame, order: list[str]) -> DataFrame:
    """``d``, stored, with ``rank`` from 0 within its ``key`` in that order.

    Rows lie in ranges of (key, order); a row's rank is its place in its range
    and what earlier ranges hold of its key, so a large key is many tasks.
    """
    d = staged(d.repartitionByRange("key", *order).withColumn("part", F.spark_partition_id()), "merkle-ranges")
    per = d.groupBy("key", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select("key", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy("key", "part").orderBy(*order))
    d = d.withColumn("place", place).join(per, ["key", "part"])
    return staged(d.withColumn("rank", F.col("before") + F.col("place") - 1).drop("part", "place", "before"), "merkle-leaves")


def _blocks(d: DataFrame, level: int, height: int) -> DataFrame:
    """Blocks over rows key, rank, leaf: 2^height consecutive leaves each.

    A key's only block is as high as its leaves need; where there are more, even the
    last one is of full height.
    """
    def make(key, t):
        order = t.column("rank").to_numpy().argsort(kind="stable")
        hexes = [t.column("leaf")[int(i)].as_py().encode() for i in order]
        n, block = len(hexes), key[1].as_py()
        nodes = veb.build(hexes, height if block else (n - 1).bit_length())
        return pa.table({"key": [key[0].as_py()], "level": pa.array([level], pa.int32()), "block": [block], "first": [block << height],
                         "n": pa.array([n], pa.int32()), "nodes": [nodes], "root": [nodes[:veb.DIGEST].hex()]})

    d = d.select("key", F.shiftright("rank", height).alias("block"), "rank", "leaf")
    return d.groupBy("key", "block").applyInArrow(make, BLOCK)


def forest(d: DataFrame, height: int, name: str) -> list[DataFrame]:
    """Levels of stored blocks over rows key, rank, leaf; the last has one block per key."""
    out = [staged(_blocks(d, 0, height), f"merkle-{name}")]
    while (out[-1].agg(F.max("block").alias("b")).first().b or 0) > 0:
        above = out[-1].select("key", F.col("block").alias("rank"), F.col("root").alias("leaf"))
        out.append(staged(_blocks(above, len(out), height), f"merkle-{name}"))
    return out


@dataclass
class Manifest:
    """Stored tables: leaves, blocks of the languages' trees, the languages' roots in order, blocks of the tree over them."""

    leaves: DataFrame
    trees: list[DataFrame]
    roots: DataFrame
    top: list[DataFrame]

    def root(self) -> str | None:
        """The root of all, None for an empty table."""
        row = self.top[-1].select("root").first()
        return row.root if row else None

    def blocks(self) -> DataFrame:
        return reduce(DataFrame.unionByName, self.trees + self.top)


def manifest(docs: DataFrame, tampered: Column | None = None, height: int = HEIGHT) -> Manifest:
    arrow_batches(docs.sparkSession)
    own = leaves(docs, tampered)
    trees = forest(own, height, "trees")
    roots = ranked(trees[-1].select(F.lit(ALL).alias("key"), F.col("key").alias("lang"), F.col("root").alias("leaf")), ["lang"])
    return Manifest(own, trees, roots, forest(roots, height, "top"))


def _steps(blocks: DataFrame, above: DataFrame | None) -> DataFrame:
    """key, rank, path of every leaf of ``blocks``: the way through its block, then ``above``'s way on from there."""
    d = blocks.withColumn("path", F.lit(b"")) if above is None else \
        blocks.join(above.select("key", F.col("rank").alias("block"), "path"), ["key", "block"])

    def walk(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            for r in b.to_pylist():
                block, n = veb.Block(r["nodes"], r["n"]), r["n"]
                paths = [veb.packed(block.path(i)) + r["path"] for i in range(n)]
                yield pa.RecordBatch.from_arrays([pa.array([r["key"]] * n), pa.array(range(r["first"], r["first"] + n), pa.int64()),
                                                  pa.array(paths, pa.binary())], names=["key", "rank", "path"])

    return d.select("key", "first", "n", "nodes", "path").mapInArrow(walk, "key string, rank long, path binary")


def entrances(m: Manifest) -> DataFrame:
    """The lowest blocks of the languages' trees, each with its subroot and ``path``, the way from
    the block's root through that subroot to the root of all."""
    above = None
    for level in reversed(m.top):
        above = _steps(level, above)
    above = m.roots.join(above, ["key", "rank"]).select(F.col("lang").alias("key"), F.lit(0).cast("long").alias("rank"), "path")
    for level in reversed(m.trees[1:]):
        above = staged(_steps(level, above), "merkle-paths")
    subroots = m.roots.select(F.col("lang").alias("key"), F.col("leaf").alias("subroot"))
    return (m.trees[0].select("key", "block", "first", "n", "nodes")
            .join(above.select("key", F.col("rank").alias("block"), "path"), ["key", "block"]).join(subroots, "key"))


def proofs(m: Manifest, height: int = HEIGHT) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of every document.

    folded_root is computed from ``other`` where there is one, else from the leaf.
    Documents go to their block as rows of digests; a block's documents are one
    group of 2^height at most.
    """
    own = m.leaves.select("key", F.shiftright("rank", height).alias("block"), "rank", "doc_id", "leaf", "other")
    total = m.root()

    def check(key, block, docs):
        r, n = block.to_pylist()[0], docs.num_rows
        tree, above = veb.Block(r["nodes"], r["n"]), veb.unpacked(r["path"])
        rest = b"".join(s for s, _ in above)
        folded: dict[bytes, str] = {}                          # by block root: most documents share one
        proof, root = [], []
        for rank, leaf, other in zip(*(docs.column(c).to_pylist() for c in ("rank", "leaf", "other"))):
            path = tree.path(rank - r["first"])
            proof.append(veb.join([s for s, _ in path] + [rest]).decode())
            top = veb.fold((other or leaf).encode(), path)
            if top not in folded:
                folded[top] = veb.fold(top, above).decode()
            root.append(folded[top])
        return pa.table({"doc_id": docs.column("doc_id"), "leaf": docs.column("leaf"), "subroot": [r["subroot"]] * n,
                         "root": pa.array([total] * n, pa.string()), "proof_sha256": proof, "folded_root": root,
                         "verified": [x == total for x in root]})

    schema = (f"doc_id {dict(m.leaves.dtypes)['doc_id']}, leaf string, subroot string, root string, "
              "proof_sha256 string, folded_root string, verified boolean")
    return entrances(m).groupBy("key", "block").cogroup(own.groupBy("key", "block")).applyInArrow(check, schema)
