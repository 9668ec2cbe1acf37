"""A Merkle manifest of a dataset: every row provable against one root.

A row's leaf is the SHA-256 of its fields; the leaves of a source, in the order
of their ids, are hashed in runs of ``FANOUT`` until one node is left, its
subroot; the subroots, in the order of their sources, give the root in the same
way. ``manifest`` gives each row's leaf, subroot, root and its proof (the
siblings on its way up), and folds a second leaf up the same proof, as somebody
does who holds another copy of the row.

Rows are numbered within their source by one range partitioning of (source,
id): places within partitions, plus what earlier partitions hold of the source.
No source meets in one task, however large. Going up, a level's nodes are
grouped by index divided by the fanout, each level written and a sixteenth of
the one below. Going down, each level joins the proofs of its parents, so that
all joins are of distinct keys and the last has a row for every run, not for
every leaf.

Null fields are hashed as ``-`` and differ from empty ones. A null source is a
source, the first one; null ids stand first in their source. Rows that share an
id are ordered by their leaves; equal rows have equal leaves and a place each.
A row with a null id is never tampered with. An empty table has an empty
manifest. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairnmark.llm.shared import written

FANOUT = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def row_hash(**replaced):
    """The leaf of a row: SHA-256 over its fields, each with its length in bytes; ``replaced`` gives columns instead of fields."""

    def field(name):
        value = replaced.get(name, F.col(name)).cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    return F.sha2(F.concat(*map(field, FIELDS)), 256)


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with their place ``idx`` (from 0) among those of their ``grp`` in the order of ``order``, and the ``size`` of it."""
    at = F.monotonically_increasing_id()
    placed = written(rows.repartitionByRange("grp", *order).sortWithinPartitions("grp", *order).withColumn("at", at), "placed").withColumn("part", F.shiftright("at", 33))
    ran = Window.partitionBy("grp").orderBy("part")
    before = F.coalesce(F.sum("n").over(ran.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = placed.groupBy("grp", "part").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    runs = runs.select("grp", "part", (before - F.col("first")).alias("shift"), F.sum("n").over(Window.partitionBy("grp")).alias("size"))
    return placed.join(written(runs, "runs"), ["grp", "part"]).withColumn("idx", F.col("at") + F.col("shift")).drop("at", "part", "shift")


def _parents(nodes: DataFrame, fanout: int) -> DataFrame:
    """The nodes above ``nodes`` (grp, idx, size, digest, item), each with its ``run`` of children; a group of one node keeps its digest."""
    above = nodes.groupBy("grp", F.floor(F.col("idx") / fanout).alias("idx")).agg(F.first("size").alias("size"), F.sort_array(F.collect_list(F.struct("idx", "digest", "item"))).alias("run"))
    digest = F.when(F.col("size") == 1, F.col("run")[0]["digest"]).otherwise(F.sha2(F.array_join("run.digest", ""), 256))
    return above.select("grp", "idx", (F.col("size") == 1).alias("alone"), F.ceil(F.col("size") / fanout).alias("size"), digest.alias("digest"), "run")


def _up(nodes: DataFrame, fanout: int, name: str) -> tuple[list[DataFrame], DataFrame]:
    """The written levels above ``nodes``, and the node (grp, level, digest) in which each group ends."""
    most = nodes.agg(F.max("size")).first()[0] or 0
    levels, tops = [], None
    while True:
        level = written(_parents(nodes, fanout), f"{name}-{len(levels) + 1}")
        levels.append(level)
        ended = level.where("size = 1").select("grp", F.lit(len(levels)).alias("level"), "digest")
        tops = ended if tops is None else tops.unionByName(ended)
        most = -(-most // fanout)
        if most <= 1:
            return levels, tops
        nodes = level.where("size > 1").select("grp", "idx", "size", "digest", F.lit(None).cast("string").alias("item"))


def _down(levels: list[DataFrame], tops: DataFrame) -> DataFrame:
    """(grp, digest, item, path, ...) of the leaves below ``levels``: siblings on the left and right from each leaf upwards, before the path and columns of the group's ``tops`` (grp, level, path, ...)."""
    carried = [c for c in tops.columns if c not in ("grp", "level", "path")]
    known = None
    for k in range(len(levels), 0, -1):
        ended = tops.where(F.col("level") == k).select("grp", F.lit(0).cast("long").alias("idx"), "path", *carried)
        known = ended if known is None else known.select("grp", "idx", "path", *carried).unionByName(ended)
        children = levels[k - 1].select("grp", "idx", "alone", "run").join(known, ["grp", "idx"]).select("grp", "alone", "run", "path", *carried, F.posexplode("run").alias("pos", "child"))
        digests = F.col("run.digest")
        step = F.struct(F.array_join(F.slice(digests, F.lit(1), F.col("pos")), "").alias("left"), F.array_join(F.slice(digests, F.col("pos") + 2, F.size("run")), "").alias("right"))
        path = F.when(F.col("alone"), F.col("path")).otherwise(F.concat(F.array(step), F.col("path")))
        known = children.select("grp", "child.*", path.alias("path"), *carried)
    return known.drop("idx")


def manifest(docs: DataFrame, fanout: int = FANOUT, other_text=None) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of every row.

    ``other_text`` is a column, null where the copy that is verified is the row itself; else its text.
    ``folded_root`` is what the copy's leaf and the row's proof give, ``verified`` whether that is the root.
    """
    group = F.coalesce(F.concat(F.lit("1"), F.col("source")), F.lit("0"))
    other = F.lit(None).cast("string") if other_text is None else F.when(other_text.isNotNull(), row_hash(text=other_text))
    leaves = docs.select(*FIELDS).select("doc_id", group.alias("grp"), row_hash().alias("digest"), other.alias("other"), F.monotonically_increasing_id().alias("tie"))
    leaves = numbered(written(leaves, "leaves"), ["doc_id", "digest", "tie"])
    levels, tops = _up(leaves.select("grp", "idx", "size", "digest", F.struct("doc_id", "other").alias("item")), fanout, "leaves")

    subroots = tops.select(F.lit("").alias("grp"), F.struct(F.col("grp").alias("source"), "level").alias("item"), "digest")
    over, end = _up(numbered(subroots, ["item"]), fanout, "subroots")
    empty = F.array().cast("array<struct<left: string, right: string>>")
    end = end.select("grp", "level", empty.alias("path"), F.col("digest").alias("root"))
    known = _down(over, end).select(F.col("item.source").alias("grp"), "item.level", "path", "root", F.col("digest").alias("subroot"))

    rows = _down(levels, written(known, "known"))
    proof = F.array_join(F.transform("path", lambda s: F.concat(s["left"], s["right"])), "")
    folded = F.aggregate("path", F.coalesce("item.other", "digest"), lambda node, s: F.sha2(F.concat(s["left"], node, s["right"]), 256))
    rows = rows.select("item.doc_id", F.col("digest").alias("leaf"), "subroot", "root", F.sha2(proof, 256).alias("proof_sha256"), folded.alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


def every_fifth_lowered():
    """The text with A-Z lower-cased in rows whose id's CRC-32 five divides; null (the row itself) elsewhere and where the text is null."""
    return F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.translate("text", _UPPER, _LOWER))
