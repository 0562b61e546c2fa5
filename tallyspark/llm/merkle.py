"""A Merkle manifest of a dataset: leaves of documents, a tree for each source, a tree over the sources, and proofs.

Levels are tables. Nodes of a level are numbered within their tree, every FANOUT
consecutive numbers are one run, and the sorted array of a run's hashes makes the
parent, until each tree has one node left. Then the levels are joined from the root
down: a node's proof is what its run holds beside it, followed by its parent's
proof, so the joins of a tree take about as many rows as it has nodes. Texts are
read once, to make leaves, and never shuffled.

Numbering needs no task that holds a tree: leaves are dealt out by ranges of (tree,
order), counted by range, and a row's number is the rows of its tree in earlier
ranges and its place in its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import forget, materialise

FANOUT = 3
#: The columns of a leaf, in this order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the parts' bytes one after the other."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def leaf_of(**fields: Column) -> Column:
    """The hash of FIELDS, each ``-`` if null, else its UTF-8 length in bytes, ``:`` and itself."""
    texts = [fields[name].cast("string") for name in FIELDS]
    return digest(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts])


def tampered(doc_id: Column, text: Column) -> Column:
    """The text as the check finds it: without its line feeds where 2 divides the id's CRC-32, else as it was."""
    return F.when(F.crc32(doc_id.cast("string").cast("binary")) % 2 == 0, F.replace(text, F.lit("\n"), F.lit(""))).otherwise(text)


def numbered(rows: DataFrame, tree: str, *order: str) -> DataFrame:
    """Adds ``place``, a row's number from 0 in its ``tree`` by ``order``, and ``size``, the tree's rows.

    Rows that are equal in all of these are numbered in the order of their ``copy``,
    which only spreads them.
    """
    parts = max(2, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = rows.repartitionByRange(parts, tree, *order, "copy").sortWithinPartitions(tree, *order, "copy")
    # Spark's ids count the rows of a partition, so what is written keeps each row's place in its range
    dealt = materialise(dealt.withColumn("part", F.spark_partition_id()).withColumn("row", F.monotonically_increasing_id()), "dealt")
    within = dealt.groupBy(tree, "part").agg(F.count(F.lit(1)).alias("own"), F.min("row").alias("first"))
    # a row for each range and each tree in it
    of_tree = Window.partitionBy(tree)
    before = F.sum("own").over(of_tree.orderBy("part")) - F.col("own")
    starts = within.select(tree, "part", (before - F.col("first")).alias("start"), F.sum("own").over(of_tree).alias("size"))
    starts = materialise(starts, "starts")
    out = dealt.join(starts, [tree, "part"]).withColumn("place", F.col("start") + F.col("row"))
    out = materialise(out.drop("start", "row", "part", "copy"), "numbered")
    forget(dealt, starts)
    return out


def build(leaves: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """The runs of every level of the trees of ``leaves(tree, place, size, node, ...)``, and the trees' last nodes.

    A run has ``(tree, parent, kids, node, size)``: ``kids`` holds its nodes with all
    their columns by place, ``node`` is their hash, ``size`` the number of nodes on the
    parents' level. The last nodes are ``(tree, node, height)``.
    """
    most = leaves.agg(F.max("size")).first()[0] or 0  # one number, which says how many levels there are
    carried = [c for c in leaves.columns if c not in ("tree", "size")]
    level, levels, height = leaves, [], 0
    tops = leaves.filter("size = 1").select("tree", "node", F.lit(0).alias("height"))
    while most > 1:
        kids = F.array_sort(F.collect_list(F.struct(*carried))).alias("kids")
        runs = level.filter("size > 1").groupBy("tree", F.floor(F.col("place") / FANOUT).alias("parent")).agg(kids, F.max("size").alias("size"))
        node = digest(F.array_join(F.transform("kids", lambda k: k.node), ""))
        runs = materialise(runs.select("tree", "parent", "kids", node.alias("node"), F.ceil(F.col("size") / FANOUT).alias("size")), "runs")
        levels.append(runs)
        height, most = height + 1, -(-most // FANOUT)
        level, carried = runs.select("tree", F.col("parent").alias("place"), "size", "node"), ["place", "node"]
        tops = tops.union(level.filter("size = 1").select("tree", "node", F.lit(height)))
    return levels, tops


def proofs(levels: list[DataFrame], leaves: DataFrame, tops: DataFrame) -> DataFrame:
    """``leaves`` with their proofs, ``tops(tree, height, proof, ...)`` being the trees' last nodes with theirs.

    A proof has for each level from the leaf up ``(left, right)``: the hashes before and
    after the node in its run. Columns of ``tops`` beside its proof go down with it. A
    lone leaf has its tree's proof.
    """
    more = [c for c in tops.columns if c not in ("tree", "height", "proof")]
    names = ["tree", *[c for c in leaves.columns if c not in ("tree", "size")], "proof", *more]
    out = leaves.filter("size = 1").drop("size").join(tops.filter("height = 0").drop("height"), "tree").select(names)
    first = F.lit(0).cast("long").alias("place")
    own = None
    for height in range(len(levels), 0, -1):
        ended = tops.filter(F.col("height") == height).select("tree", first, "proof", *more)
        own = ended if own is None else own.select("tree", F.col("kid.place").alias("place"), "proof", *more).union(ended)
        runs = levels[height - 1].select("tree", F.col("parent").alias("place"), "kids")
        own = own.join(runs, ["tree", "place"]).select("tree", "kids", F.col("proof").alias("rest"), *more, F.posexplode("kids").alias("at", "kid"))
        beside = [
            F.array_join(F.transform(part, lambda k: k.node), "").alias(name)
            for name, part in (("left", F.slice("kids", F.lit(1), F.col("at"))), ("right", F.slice("kids", F.col("at") + 2, F.lit(FANOUT))))
        ]
        own = own.withColumn("proof", F.concat(F.array(F.struct(*beside)), "rest")).drop("kids", "rest", "at")
    return out if own is None else own.select("tree", "kid.*", "proof", *more).select(names).union(out)


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its proof give."""
    return F.aggregate(proof, leaf, lambda h, run: digest(run.left, h, run.right))


def manifest(docs: DataFrame) -> DataFrame:
    """``(doc_id, leaf, subroot, root, proof, folded_root, verified)`` of every row of ``docs``.

    ``leaf``, ``subroot``, ``root`` and ``proof`` are those of the rows as given,
    ``folded_root`` what the rows as :func:`tampered` and their proofs give, ``verified``
    whether that is the root. Nulls are fields of their own kind, and a null source is a
    source, the first one. Null ids come before others and are not tampered with; rows
    equal in source and id stand in the order of their leaves, so that equal rows have
    neighbouring places of a fixed set. An empty table gives no rows. Other columns
    take no part.
    """
    fields = {name: F.col(name) for name in FIELDS}
    changed = tampered(F.col("doc_id"), F.col("text"))
    tree = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("-"))  # "-" is before "="
    leaf = leaf_of(**fields)
    leaves = docs.select(
        "doc_id",
        tree.alias("tree"),
        leaf.alias("node"),
        F.when(changed.eqNullSafe(F.col("text")), leaf).otherwise(leaf_of(**(fields | {"text": changed}))).alias("found"),
        F.monotonically_increasing_id().alias("copy"),
    )
    leaves = numbered(leaves, "tree", "doc_id", "node")
    # kids are sorted by their first field
    leaves = leaves.select("tree", "size", "place", "node", "doc_id", "found")
    levels, tops = build(leaves)
    tops = materialise(tops, "subroots")
    roots = tops.select(F.lit("all").alias("tree"), F.col("tree").alias("source"), "node", "height", F.lit(0).cast("long").alias("copy"))
    roots = numbered(roots, "tree", "source").select("tree", "size", "place", "node", "source", "height")
    upper, root = build(roots)
    root = root.select("tree", "height", F.array().cast("array<struct<left:string,right:string>>").alias("proof"), F.col("node").alias("root"))
    # each source's last node with its height in its own tree and its proof in the tree of sources
    sources = proofs(upper, roots, root).select(F.col("source").alias("tree"), "height", "proof", F.col("node").alias("subroot"), "root")
    out = proofs(levels, leaves, materialise(sources, "sources"))
    back = folded(F.col("found"), F.col("proof"))
    out = out.select("doc_id", F.col("node").alias("leaf"), "subroot", "root", "proof", back.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def siblings(proof: Column) -> Column:
    """A proof's hashes as one text, from the leaf's level up, each level from left to right."""
    return F.array_join(F.transform(proof, lambda run: F.concat(run.left, run.right)), "")
