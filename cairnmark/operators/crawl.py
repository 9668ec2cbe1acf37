"""A catalogue after a crawl, row after row.

A crawl lists files in its order. A listed file is the catalogue's row of its
resource, else the row of its path, else a new row. A row found at another path
takes that path over, and the row that had it is marked deleted; so what a
later file finds depends on those before it. Rows and files depend on each
other only through paths and resources: those that share any, directly or by a
chain of moves, form a component, and only a component is folded in crawl
order. Most rows meet one file of the same path and resource and nothing else;
they are told by counting and settled by a join.

A component holds as many rows as its chain of moves is long; a task reads the
rows of a component one after the other.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnmark.operators.shared import kept
from cairnmark.operators.vectors import connected

ROW = "id long, path string, resource_id string, inventory_scope string, size long, modified string, status string, hash_value string, duration_sec long"
_NAMES = [c.split()[0] for c in ROW.split(", ")]
FOUND = "seq long, path string, resource_id string, size long, modified string"


def _settled(row: dict, item: dict, scope: str) -> dict:
    """``row`` after the file ``item`` was found to be it."""
    same = row["size"] == item["size"] and row["modified"] == item["modified"]
    status = row["status"] or "new"
    if not same:
        status = "new"
    elif status == "deleted":
        status = "hashed" if row["hash_value"] else "new"
    gone = {} if same else {"hash_value": None, "duration_sec": None}
    return row | gone | {"path": item["path"], "resource_id": item["resource_id"] or row["resource_id"], "inventory_scope": scope, "size": item["size"], "modified": item["modified"], "status": status}


def fold(rows: list[dict], items: list[dict], scope: str) -> list[dict]:
    """The rows of a component after its files in crawl order. Of several rows of a path the one that came there last is found, at first the lowest id."""
    rows = sorted(rows, key=lambda r: r["id"])
    at: dict[str, list[int]] = {}
    by_resource: dict[str, int] = {}
    for k in reversed(range(len(rows))):
        at.setdefault(rows[k]["path"], []).append(k)
        if rows[k]["resource_id"]:
            by_resource[rows[k]["resource_id"]] = k
    for item in sorted(items, key=lambda i: i["seq"]):
        path, resource = item["path"], item["resource_id"]
        k = by_resource.get(resource) if resource else None
        there = at.setdefault(path, [])
        if k is None:
            k = there[-1] if there else None
        if k is None:
            rows.append(dict.fromkeys(_NAMES) | {"path": path, "resource_id": resource or None, "inventory_scope": scope, "size": item["size"], "modified": item["modified"], "status": "new"})
            k = len(rows) - 1
            there.append(k)
        else:
            old = rows[k]["path"]
            if old != path:
                if there:
                    rows[there[-1]] = rows[there[-1]] | {"status": "deleted"}
                at[old].remove(k)
                there.append(k)
            before = rows[k]["resource_id"]
            if resource and before != resource and by_resource.get(before) == k:
                del by_resource[before]
            rows[k] = _settled(rows[k], item, scope)
        if resource:
            by_resource[resource] = k
    return rows


def _fold_all(scope: str):
    kinds = {"id": "Int64", "size": "Int64", "duration_sec": "Int64"}

    def run(frames):
        last, rows, items, out = None, [], [], []
        for pdf in frames:
            pdf = pdf.astype(object).where(pdf.notna(), None)
            for r in pdf.to_dict("records"):
                if r["comp"] != last:
                    out += fold(rows, items, scope)
                    last, rows, items = r["comp"], [], []
                (items if r["seq"] is not None else rows).append(r)
            if out:
                yield pd.DataFrame(out, columns=_NAMES).astype(kinds)
                out = []
        out = fold(rows, items, scope)
        if out:
            yield pd.DataFrame(out, columns=_NAMES).astype(kinds)

    return run


def _components(rows: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Paths (path, comp) and resources (resource_id, comp) that depend on each other through more than one path and one resource, or whose path stands in several rows or files."""
    links = kept(rows.select("path", "resource_id").union(items.select("path", "resource_id")).where("resource_id IS NOT NULL").distinct())
    several = rows.select("path").groupBy("path").count().union(items.select("path").groupBy("path").count()).where("count > 1").select("path")
    wide = links.groupBy("path").count().where("count > 1").select("path").union(several).distinct()
    moved = links.groupBy("resource_id").count().where("count > 1").select("resource_id")
    again = rows.union(items).groupBy("resource_id").agg(F.countDistinct("path").alias("n")).where("n > 1 AND resource_id IS NOT NULL").select("resource_id")
    moved = moved.union(again).distinct()
    tied = links.join(wide, "path", "left_semi").union(links.join(moved, "resource_id", "left_semi").select("path", "resource_id")).distinct()
    tied = links.join(tied.select("path").distinct(), "path", "left_semi").union(links.join(tied.select("resource_id").distinct(), "resource_id", "left_semi").select("path", "resource_id")).distinct()
    node = lambda mark, c: F.concat(F.lit(mark), F.col(c))
    roots = connected(tied.select(node("p", "path").alias("a"), node("r", "resource_id").alias("b")))
    named = lambda mark, c: roots.where(F.col("node").startswith(mark)).select(F.substr("node", F.lit(2)).alias(c), F.col("root").alias("comp"))
    alone = wide.join(tied.select("path").distinct(), "path", "left_anti").select("path", node("p", "path").alias("comp"))
    return kept(named("p", "path").union(alone)), kept(named("r", "resource_id"))


def under(root: str) -> Column:
    return F.col("path").startswith(root.rstrip("/") + "/")


def reconciled(catalogue: DataFrame, crawl: DataFrame, root: str, scope: str = "archive") -> DataFrame:
    """The catalogue (``ROW``) after ``crawl`` (``FOUND``; an empty resource is none) of the folder ``root``.

    Found rows take the file's path, resource (if it has one), size, time and ``scope``. Other size or time: the row is new
    again and its hash and duration go. A deleted row that is found is hashed if it has a hash, else new. New rows have a
    null id. In the end rows below ``root`` that the crawl did not see are deleted: those with a resource by the resource,
    others by the path. Rows elsewhere stay as they are.
    """
    rows = catalogue.select(*_NAMES).withColumn("resource_id", F.nullif("resource_id", F.lit("")))
    items = crawl.select("seq", "path", F.nullif("resource_id", F.lit("")).alias("resource_id"), "size", "modified").where("path <> ''")
    paths, resources = _components(rows.select("path", "resource_id"), items.select("path", "resource_id"))
    by_resource = resources.withColumnRenamed("comp", "comp2")
    told = lambda df: df.join(paths, "path", "left").join(by_resource, "resource_id", "left").withColumn("comp", F.coalesce("comp", "comp2")).drop("comp2")
    rows, items = kept(told(rows)), kept(told(items))

    both = rows.where("comp IS NOT NULL").withColumn("seq", F.lit(None).cast("long")).unionByName(items.where("comp IS NOT NULL"), allowMissingColumns=True)
    folded = both.repartition("comp").sortWithinPartitions("comp").mapInPandas(_fold_all(scope), ROW)

    there = rows.where("comp IS NULL").drop("comp")
    here = items.where("comp IS NULL").select("path", F.col("resource_id").alias("new_resource"), F.col("size").alias("new_size"), F.col("modified").alias("new_modified"), F.lit(True).alias("found"))
    same = F.col("size").eqNullSafe(F.col("new_size")) & F.col("modified").eqNullSafe(F.col("new_modified"))
    known, found = F.col("known").isNotNull(), F.col("found").isNotNull()
    back = F.when(F.col("status") != "deleted", F.col("status")).when(F.col("status").isNull(), "new").when(F.coalesce("hash_value", F.lit("")) != "", "hashed").otherwise("new")
    plain = there.withColumn("known", F.lit(True)).join(here, "path", "full_outer").select(
        "id", "path", F.coalesce("new_resource", "resource_id").alias("resource_id"), F.when(found, F.lit(scope)).otherwise(F.col("inventory_scope")).alias("inventory_scope"),
        F.when(found, F.col("new_size")).otherwise(F.col("size")).alias("size"), F.when(found, F.col("new_modified")).otherwise(F.col("modified")).alias("modified"),
        F.when(~found, F.col("status")).when(known & same, back).otherwise("new").alias("status"),
        *(F.when(~found | same, F.col(c)).alias(c) for c in ("hash_value", "duration_sec")),
    )
    after = kept(plain.unionByName(folded))
    seen_resource = items.where("resource_id IS NOT NULL").select("resource_id", F.lit(True).alias("by_resource")).distinct()
    seen_path = items.select("path", F.lit(True).alias("by_path")).distinct()
    marked = after.join(seen_resource, "resource_id", "left").join(seen_path, "path", "left")
    seen = F.when(F.col("resource_id").isNotNull(), F.col("by_resource")).otherwise(F.col("by_path")).isNotNull()
    gone = under(root) & ~seen & F.coalesce(F.col("status") != "deleted", F.lit(False))
    return marked.withColumn("status", F.when(gone, "deleted").otherwise(F.col("status"))).select(*_NAMES)
