"""A crawl judged row after row, against a plain loop over the whole catalogue."""

import random

import pytest

from cairnmark.operators.crawl import FOUND, ROW, reconciled


def plain(catalogue, crawl, root, scope="archive"):
    rows = [dict(zip("id path resource scope size modified status hash duration".split(), r, strict=True)) for r in sorted(catalogue)]
    seen_paths, seen_resources, came = set(), set(), {id(r): -r["id"] - 10**9 for r in rows}
    clock = 0
    for _, path, resource, size, modified in sorted(crawl):
        if not path:
            continue
        clock += 1
        seen_paths.add(path)
        if resource:
            seen_resources.add(resource)
        own = next((r for r in rows if resource and r["resource"] == resource), None)
        there = max((r for r in rows if r["path"] == path), key=lambda r: came[id(r)], default=None)
        own = own or there
        if own is None:
            own = dict(id=None, path=path, resource=resource or None, scope=scope, size=size, modified=modified, status="new", hash=None, duration=None)
            rows.append(own)
            came[id(own)] = clock
            continue
        if own["path"] != path:
            if there is not None:
                there["status"] = "deleted"
            came[id(own)] = clock
        if (own["size"], own["modified"]) != (size, modified):
            own.update(status="new", hash=None, duration=None)
        elif own["status"] == "deleted":
            own["status"] = "hashed" if own["hash"] else "new"
        own.update(path=path, resource=resource or own["resource"], scope=scope, size=size, modified=modified, status=own["status"] or "new")
    for r in rows:
        if r["path"].startswith(root.rstrip("/") + "/") and r["status"] not in ("deleted", None) and not (r["resource"] in seen_resources if r["resource"] else r["path"] in seen_paths):
            r["status"] = "deleted"
    return sorted((tuple(r.values()) for r in rows), key=str)


def after(spark, catalogue, crawl, root="disk:/a"):
    got = reconciled(spark.createDataFrame(catalogue, ROW), spark.createDataFrame(crawl, FOUND), root).collect()
    return sorted((tuple(r) for r in got), key=str)


def row(i, path, resource, status="hashed", size=5, modified="t", scope="archive"):
    return (i, path, resource, scope, size, modified, status, f"h{i}", i)


P = "disk:/a/"
CASES = {
    "chain of three moves": ([row(1, P + "1", "r1"), row(2, P + "2", "r2"), row(3, P + "3", "r3")], [(1, P + "2", "r1", 5, "t"), (2, P + "3", "r2", 5, "t"), (3, P + "4", "r3", 5, "t")]),
    "chain from its end": ([row(1, P + "1", "r1"), row(2, P + "2", "r2"), row(3, P + "3", "r3")], [(3, P + "2", "r1", 5, "t"), (2, P + "3", "r2", 5, "t"), (1, P + "4", "r3", 5, "t")]),
    "swap": ([row(1, P + "1", "r1"), row(2, P + "2", "r2")], [(1, P + "2", "r1", 5, "t"), (2, P + "1", "r2", 6, "t")]),
    "crawl of one folder": ([row(1, P + "1", "r1"), row(2, "disk:/b/2", "r2"), row(3, "disk:/ab", None), row(4, P + "4", None)], [(1, P + "1", "r1", 5, "t")]),
    "path of another resource": ([row(1, P + "1", "r1")], [(1, P + "1", "other", 5, "t"), (2, P + "1", "r1", 5, "t")]),
    "found without its resource": ([row(1, P + "1", "r1")], [(1, P + "1", "", 5, "t")]),
    "back again": ([row(1, P + "1", None, "deleted"), row(2, P + "2", "r2", "deleted", None, None), row(3, P + "3", "r3", None)], [(1, P + "1", None, 5, "t"), (2, P + "2", "r2", None, None), (3, P + "3", "r3", 5, "t"), (4, "", "x", 1, "t"), (5, P + "n", None, 1, None)]),
    "nothing there": ([], [(1, P + "1", "r1", 5, "t"), (2, P + "2", "r1", 5, "t")]),
    "nothing found": ([row(1, P + "1", "r1")], []),
}


@pytest.mark.parametrize("name", CASES)
def test_crawls(spark, name):
    assert after(spark, *CASES[name]) == plain(*CASES[name], "disk:/a")


@pytest.mark.parametrize("seed", [1])
def test_random_crawls(spark, seed):
    rng = random.Random(seed)
    paths = [f"disk:/{'ab'[i % 2]}/{i}" for i in range(60)]
    resources = [f"r{i}" for i in range(45)]
    kept_paths = rng.sample(paths, 40)
    own = dict(zip(kept_paths, rng.sample(resources, 40), strict=True))
    catalogue = [row(i, p, own[p] if rng.random() < 0.8 else None, rng.choice(["hashed", "deleted", "new", None]), rng.choice([5, 6, None]), rng.choice(["t", None]), "source") for i, p in enumerate(kept_paths, 1)]
    crawl = [(i, rng.choice(paths), rng.choice([*resources, None, ""]), rng.choice([5, 6, None]), rng.choice(["t", None])) for i in range(55)]
    assert after(spark, catalogue, crawl) == plain(catalogue, crawl, "disk:/a")
