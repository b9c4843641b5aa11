"""Mixing, clustering and the prefix trie against plain versions on small tables with every odd case."""

import hashlib
import math
import random
import zlib
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from auditgrid.llm import ball_kmeans, mixing, prefix_trie

WHITE = " \t\n\x0b\x0c\r"


def n_words(text):
    return len("".join(" " if c in WHITE else c for c in text or "").split(" ")) - "".join(" " if c in WHITE else c for c in text or "").split(" ").count("")


# --- mixing


def sources(n=400, seed=3):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        source = "big" if i % 3 == 0 else rnd.choice(("a", "Z", "é", "", None, "tiny" if i < 12 else "b", "😀"))
        words = [rnd.choice(("the", "of", f"w{rnd.randrange(50)}")) for _ in range(rnd.randrange(1, 120))]
        rows.append((i, " ".join(words), source))
    rows += [(None, "null id one", "a"), (None, "null id two words", "a"), (5, "again", "b"), (5, "again", "b"), (5, "again", "b"), (7, None, "a"), (8, "", "big"), (9, " \t\n", None), (10, "w\x0bx\x0cy\rz\xa0q", "a"), (11, "long " * 60_000, "b")]
    return rows


def targets(rows, weights=(1, 2, 3), most=3):
    """By resharing the excess until no source is above ``most`` times its size."""
    sizes = defaultdict(int)
    for _, text, source in rows:
        sizes[source] += n_words(text)
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    out, left, open_ = {}, Fraction(sum(sizes.values())), set(order)
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > most * sizes[s]}
        for s in full or open_:
            out[s] = Fraction(most * sizes[s]) if full else level * weight[s]
        left -= sum(out[s] for s in full)
        open_ -= full or set(open_)
    return sizes, out


def table(spark, rows, parts=3):
    return spark.createDataFrame([(i, t, s, 1, "x") for i, t, s in rows], "doc_id long, text string, source string, row int, size string").repartition(parts)


def test_every_source_meets_its_target(spark):
    rows = sources()
    sizes, target = targets(rows)
    got = mixing.mix(table(spark, rows)).collect()
    assert len(got) == len(rows) and sorted((r["doc_id"] is None, r["doc_id"] or 0, r["size"]) for r in got) == sorted((i is None, i or 0, n_words(t)) for i, t, _ in rows)
    by_size = {(n, float(target[s])): s for s, n in sizes.items()}
    taken, longest = defaultdict(int), defaultdict(int)
    for r in got:
        source = next(s for (n, t), s in by_size.items() if n == r["source_size"] and math.isclose(t, r["target"], rel_tol=1e-12))
        taken[source] += r["taken"]
        longest[source] = max(longest[source], r["size"])
        assert 0 <= r["taken"] <= 3 * r["size"] and (not r["size"] or r["taken"] % r["size"] == 0)
    assert set(taken) == set(sizes)
    for s in sizes:
        assert abs(taken[s] - target[s]) <= Fraction(longest[s], 2) + 1


def test_no_target_is_over_three_times_its_source(spark):
    rows = [(1, "one two", "a"), (2, "x " * 4000, "b"), (3, "y y y", "c")]
    sizes, target = targets(rows)
    got = {r["doc_id"]: r for r in mixing.mix(table(spark, rows)).collect()}
    assert target["a"] == 6 and target["c"] == 9 and target["b"] == 3990
    assert got[1]["taken"] == 6 and got[3]["taken"] == 9 and got[2]["taken"] == 4000  # the whole one is nearer than none


def test_reruns_agree_whatever_the_partitions(spark):
    rows = sources()
    first = sorted(map(str, mixing.mix(table(spark, rows, 1)).collect()))
    assert first == sorted(map(str, mixing.mix(table(spark, rows[::-1], 7)).collect()))


def test_higher_values_get_more_copies(spark):
    rows = [(i, "w " * 10, "a") for i in range(600)] + [(10_000, "z " * 6000, "b")]
    docs = table(spark, rows).withColumn("value", F.when(F.col("doc_id") % 2 == 0, 3).otherwise(F.when(F.col("doc_id") % 4 == 1, 1)))
    got = mixing.mix(docs, value_col="value", weights=(1, 3)).where("doc_id < 10000").collect()
    copies = lambda rest: sum(r["taken"] for r in got if r["doc_id"] % 2 == rest) / 3000
    assert sum(r["taken"] for r in got) == 3000 and 0.65 < copies(0) < 0.85 and 0.15 < copies(1) < 0.35
    again = mixing.mix(docs, value_col="value", weights=(1, 3), seed="other").where("doc_id < 10000 and taken > 0").select("doc_id")
    assert {r[0] for r in again.collect()} != {r["doc_id"] for r in got if r["taken"]}


def test_mixing_nothing(spark):
    assert mixing.mix(table(spark, sources()[:1]).where("false")).collect() == []
    assert [r["taken"] for r in mixing.mix(table(spark, [(1, None, None), (2, "", "a")])).collect()] == [0, 0]


# --- clustering


def vectors(n=300, size=4, seed=1):
    rnd = random.Random(seed)
    rows = [(i, [rnd.choice((-1.0, 0.5, 2.0)) + rnd.gauss(0, 0.3) for _ in range(size)]) for i in range(n)]
    rows += [(n + i, [0.25] * size) for i in range(n // 2)]  # one very common vector
    rows += [(3, [9.0] * size), (3, [9.0] * size), (None, [1.0] * size), (900, None), (901, [1.0] * (size - 1)), (902, [1.0] * (size + 1)), (903, [1.0] * (size - 1) + [None]), (904, [float("nan")] * size), (905, [math.inf] * size), (906, [-math.inf] + [0.0] * (size - 1)), (907, [])]
    return rows


def plain_means(rows, k, rounds, size):
    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    cs = [v for _, v in order[:k]]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c, strict=True))
    for turn in range(rounds + 1):
        at = [min(range(len(cs)), key=lambda j: (far(v, cs[j]), j)) for _, v in kept]
        if turn < rounds:
            for j in range(len(cs)):
                own = [v for (_, v), a in zip(kept, at, strict=True) if a == j]
                if own:
                    cs[j] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    d = [far(v, cs[a]) for (_, v), a in zip(kept, at, strict=True)]
    return [(i, a, x, sum(y for y, b in zip(d, at, strict=True) if b == a), sum(d), hashlib.sha256(",".join(map(str, cs[a])).encode()).hexdigest()) for (i, _), a, x in zip(kept, at, d, strict=True)]


def points(spark, rows, parts=3):
    return spark.createDataFrame([(i, v, 0, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, label int, x string, cluster int").repartition(parts)


@pytest.mark.parametrize("k, rounds", [(8, 10), (3, 2), (1, 3), (40, 1)])
def test_clusters_equal_plain_k_means(spark, k, rounds):
    got = ball_kmeans.cluster(points(spark, vectors()), size=4, k=k, rounds=rounds).collect()
    assert sorted(map(tuple, got), key=str) == sorted(plain_means(vectors(), k, rounds, 4), key=str)


def test_few_equal_and_no_vectors(spark):
    for rows in ([(1, [0.5, -0.5])], [(i, [0.1, 0.1]) for i in range(20)], [(i, [float(i), 0.0]) for i in range(5)]):
        got = ball_kmeans.cluster(points(spark, rows), size=2).collect()
        assert sorted(map(tuple, got), key=str) == sorted(plain_means(rows, 8, 10, 2), key=str)
    assert ball_kmeans.cluster(points(spark, vectors()), size=99).collect() == []
    assert ball_kmeans.cluster(points(spark, []), size=2).columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    with pytest.raises(Exception, match="no exact distance"):
        ball_kmeans.cluster(points(spark, [(1, [1e30, 0.0])]), size=2)


def test_cores_and_annuli_save_distances_and_find_the_nearest():
    rnd = np.random.default_rng(0)
    centroids = rnd.integers(-2000, 2000, (30, 6))
    x = centroids[rnd.integers(0, 30, 3000)] + rnd.integers(-300, 300, (3000, 6))
    at, best = ball_kmeans.nearest(x, centroids)
    before = np.where(rnd.random(3000) < 0.1, rnd.integers(0, 30, 3000), at)
    own = ball_kmeans._squared(x, centroids[before])
    radii = [math.isqrt(int(own[before == i].max(initial=0))) + 1 for i in range(30)]
    got, far, computed = ball_kmeans.Balls(centroids.tolist(), radii).assign(x, before)
    assert (got == at).all() and (far == best).all() and computed < 3000 * 30 / 2


def test_equally_near_centroids_go_to_the_smaller_number():
    balls = ball_kmeans.Balls([[0, 0], [4, 0], [0, 0], [2, 2]], [10] * 4)
    x = np.array([[2, 0], [0, 0], [4, 0], [2, 1]])
    for before in (0, 1, 2, 3):
        at, far, _ = balls.assign(x, np.full(4, before))
        assert (at.tolist(), far.tolist()) == ([0, 0, 1, 3], [4, 0, 0, 1])


# --- the trie


def chats(seed=5, n=260):
    rnd = random.Random(seed)
    rows = []
    ids = [c for c in range(n) if c % 7 or not c % 100] + [10_000 + 3, 10_000 + 4, 5_000, -7, -100, -130, 2**40 + 50]
    for c in ids:
        if c == 200:
            continue  # a base that is absent
        common = c % 3 == 0
        for t in range(rnd.randrange(1, 9)):
            text = ("hello", "bye", "é😀", "")[t % 4] if common or rnd.random() < 0.6 else f"t{rnd.randrange(3)}"
            rows.append((c, t, ("user", "assistant")[t % 2], text))
    rows += [(50, None, "system", "first"), (50, None, "system", "first"), (51, 2, None, None), (51, 2, "user", None), (51, None, None, "x"), (None, 0, "user", "nobody"), (60, 1, "user", "y" * 100_000), (61, 0, "us", "erhello"), (61, 1, "user", "hello")]
    rows += [(300, t, "user", f"{t % 5}") for t in range(3000)]  # one very long conversation
    return rows


def plain_trie(rows):
    turns = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            turns[c].append((t is not None, t or 0, role or "", text or ""))
    rebuilt = {}
    for c in turns:
        own = [x[2:] for x in sorted(turns[c])]
        base = int(math.copysign(abs(c) % 100, c))
        head = [x[2:] for x in sorted(turns.get(c - base, []))]
        h = zlib.crc32(str(c).encode()) % 6
        rebuilt[c] = tuple(head[:h]) + tuple(own[h:])
    members, ends, last, parent = defaultdict(list), defaultdict(list), {}, {}
    root = 0
    step = {}
    for c, path in rebuilt.items():
        at = root
        members[at].append(c)
        for turn in path:
            if (at, turn) not in step:
                step[at, turn] = len(step) + 1
                parent[step[at, turn]], last[step[at, turn]] = at, len(turn[1])
            at = step[at, turn]
            members[at].append(c)
        ends[at].append(c)
    depth, kids = {root: 0}, defaultdict(list)
    for v, p in parent.items():
        depth[v] = depth[p] + 1
        kids[p].append(v)
    leaves, saved = {}, {}
    for v in sorted(members, reverse=True):  # children have higher numbers
        leaves[v] = sum(leaves[k] for k in kids[v]) or 1
        saved[v] = (len(members[v]) - 1) * last.get(v, 0) + sum(saved[k] for k in kids[v])
    sha = lambda v: hashlib.sha256(",".join(map(str, sorted(ends[v]))).encode()).hexdigest()
    return [(min(members[v]), depth[v], min(members[parent[v]]) if v else None, len(members[v]), len(kids[v]), leaves[v], saved[v], sha(v)) for v in members]


def talk(spark, rows, parts=3):
    return spark.createDataFrame([(*r, b"n", 1) for r in rows], "conv_id long, turn long, role string, text string, node binary, depth int").repartition(parts)


@pytest.mark.parametrize("held, joined", [(50_000, 1 << 20), (7, 50)])
def test_trie_equals_a_plain_one(spark, monkeypatch, held, joined):
    monkeypatch.setattr(prefix_trie, "HELD", held)
    monkeypatch.setattr(prefix_trie, "JOINED", joined)
    got = sorted(map(tuple, prefix_trie.trie(talk(spark, chats())).collect()), key=str)
    assert got == sorted(plain_trie(chats()), key=str)


def test_a_flushed_family_adds_up():
    whole, parts = prefix_trie._Family(), prefix_trie._Family()
    turns = [(0, c, "user", f"{t}") for c in range(4) for t in range(5)]
    for family in (whole, parts):
        for i, turn in enumerate(turns):
            family.turn(*turn)
            if family is parts and i % 3 == 0:
                family.flush()
        family.end()
        family.flush()

    def counts(family):
        out = defaultdict(int)
        for kind, node, *_, n in family.rows:
            out[kind, node] += n or 0
        return out

    assert counts(whole) == counts(parts)


def test_trie_of_one_and_of_nothing(spark):
    assert prefix_trie.trie(talk(spark, chats()).where("false")).collect() == []
    assert prefix_trie.trie(talk(spark, [(None, 0, "user", "x")])).collect() == []
    for rows in ([(7, 0, "user", "x")], [(c, 0, "user", "x") for c in range(30)], [(c, 0, None, None) for c in (5, 105)]):
        assert sorted(map(tuple, prefix_trie.trie(talk(spark, rows, 1)).collect()), key=str) == sorted(plain_trie(rows), key=str)
