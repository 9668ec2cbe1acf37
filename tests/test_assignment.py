"""Faces that join clusters one after another, against a plain loop."""

import numpy as np
import pytest

from cairnmark.operators import assignment as A
from cairnmark.operators.ordering import places


def vectors(seed, n, dims=4):
    x = np.random.default_rng(seed).normal(size=(n, dims))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def plain(faces, members, most):
    clusters = {}
    for person, cluster, v in members:
        clusters.setdefault(person, {}).setdefault(cluster, []).append(np.array(v))
    out = {}
    for face, person, v in sorted(faces):
        own, best = clusters.setdefault(person, {}), (round(1 - most, 12), None)
        for cluster in [*sorted(c for c in own if c >= 0), *(c for c in own if c < 0)]:
            centre = np.mean(own[cluster], axis=0)
            if np.linalg.norm(centre) > 0:
                like = round(float(centre @ np.array(v) / np.linalg.norm(centre)), 12)
                if like > best[0] or like == best[0] and best[1] is None:
                    best = (like, cluster)
        own.setdefault(-face if best[1] is None else best[1], []).append(np.array(v))
        out[face] = (-face if best[1] is None else best[1], int(best[1] is None))
    return out


def frames(spark, faces, members):
    return spark.createDataFrame(faces, "id long, person_id long, embedding array<double>"), spark.createDataFrame(members, "person_id long, cluster_id long, embedding array<double>")


def drawn(seed, n=90):
    x, rng = vectors(seed, 2 * n), np.random.default_rng(seed)
    faces = [(100 + i, int(rng.choice([1, 1, 1, 2, 3])), x[i].tolist()) for i in range(n)]
    members = [(int(rng.integers(1, 3)), int(rng.integers(0, 6)) + 10, x[n + i].tolist()) for i in range(40)]
    return faces, [(p, c + 100 * p, v) for p, c, v in members]


@pytest.mark.parametrize("seed, most, piece", [(1, 0.3, 50_000), (2, 0.3, 7), (3, 0.05, 1000), (4, 1.2, 13)])
def test_faces_in_order(spark, seed, most, piece):
    faces, members = drawn(seed)
    got = {r.id: (r.cluster_id, r.is_new) for r in A.in_order(*frames(spark, faces, members), most, piece).collect()}
    assert got == plain(faces, members, most)


def test_a_face_joins_the_cluster_that_the_one_before_began(spark):
    a, b = [1.0, 0.0], [0.0, 1.0]
    faces = [(1, 7, a), (2, 7, a), (3, 7, b), (4, 8, a), (5, 7, b)]
    for piece in (1, 2, 100):
        got = {r.id: r.cluster_id for r in A.in_order(*frames(spark, faces, []), 0.2, piece).collect()}
        assert got == {1: -1, 2: -1, 3: -3, 4: -4, 5: -3}


def test_no_faces(spark):
    assert A.in_order(*frames(spark, [], [(1, 5, [1.0, 0.0])]), 0.3).collect() == []


def test_each_face_by_itself_meets_centroids_not_members(spark):
    faces, members = drawn(5)
    got = {r.id: (r.cluster_id, r.is_new) for r in A.nearest_or_new(*frames(spark, faces, members), 0.4, 8).collect()}
    assert got == {f[0]: plain([f], members, 0.4)[f[0]] for f in faces}
    s = float(np.sqrt(0.5))
    one = frames(spark, [(1, 7, [1.0, 0.0])], [(7, 30, [1.0, 0.0]), (7, 30, [-s, s]), (7, 30, [-s, s]), (7, 40, [s, s])])
    assert [r.cluster_id for r in A.nearest_or_new(*one, 0.5).collect()] == [40]


def test_waiting_faces_and_anchors(spark):
    rects = spark.createDataFrame([(1, 1, 5, None, [1.0], 0, None), (2, 1, 5, 3, [1.0], 0, 4), (3, 1, 5, 3, None, 0, 4), (4, 2, 5, None, [1.0], 0, None), (5, 1, None, None, [1.0], 0, 2), (6, 1, 5, None, [1.0], 1, 2), (7, 9, 5, None, [1.0], None, 8)], "id long, file_id long, manual_person_id long, cluster_id long, embedding array<double>, ignore_flag int, run_id long")
    files = spark.createDataFrame([(1, " archive ", None), (2, "source", 6)], "id long, inventory_scope string, faces_run_id long")
    assert {r.id for r in A.waiting(rects, files).collect()} == {1, 3}
    found = A.anchors(rects.withColumnRenamed("manual_person_id", "person_id"), files).collect()
    assert {r.face_id: (r.archive_scope, r.run_id) for r in found} == {1: ("archive", None), 2: ("archive", None), 4: (None, 6), 5: ("archive", None), 6: ("archive", None), 7: (None, 8)}


def test_places(spark):
    rows = [(k, i % 11, i) for i in range(200) for k in [None if i % 5 == 0 else "hot" if i % 3 else str(i % 4)]]
    got = places(spark.createDataFrame(rows, "k string, o long, id long"), ["k"], ["o", "id"]).collect()
    want = {}
    for k, o, i in sorted(rows, key=lambda r: (str(r[0]), r[1], r[2])):
        want.setdefault(k, []).append(i)
    assert {(r.k, r.id): r.place for r in got} == {(k, i): n for k, ids in want.items() for n, i in enumerate(ids)}
