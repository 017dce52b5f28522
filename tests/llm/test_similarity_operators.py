import random
import re
import time
from pathlib import Path

import numpy as np
import pytest

from evistrata.llm import near_duplicates as nd, neighbours, queries

WORDS = [f"w{i}" for i in range(400)]


def shingles(text, k):
    words = re.findall(r"[^\W_]+", text.lower())
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)}


def brute(texts, k, threshold):
    sets = {key: shingles(t or "", k) for key, t in texts}
    keys = sorted(sets)
    return {(a, b) for i, a in enumerate(keys) for b in keys[i + 1 :] if sets[a] and sets[b] and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b])}


def corpus(seed, n=40):
    r, out = random.Random(seed), []
    for i in range(n):
        words = [r.choice(WORDS) for _ in range(r.randrange(30, 120))]
        out.append((f"t{i:03d}.0", " ".join(words)))
        for v in range(r.randrange(4)):
            edited = list(words)
            for _ in range(r.randrange(1, 6)):
                edited[r.randrange(len(edited))] = r.choice(WORDS)
            if r.random() < 0.3:
                cut = r.randrange(len(edited))
                edited = edited[cut:] + edited[:cut]
            out.append((f"t{i:03d}.{v + 1}", " ".join(edited) if r.random() < 0.8 else " ".join(words).upper() + "!"))
    return out


def found(spark, rows, k, threshold):
    df = spark.createDataFrame([("chunk", key, t, "x") for key, t in rows], "kind string, key string, text string, n string")
    return nd.near_duplicates(df, words=k, threshold=threshold)


@pytest.mark.parametrize("seed, words, threshold", [(1, 3, 0.6), (2, 5, 0.8)])
def test_pairs_by_brute_force(spark, seed, words, threshold):
    rows = corpus(seed)
    pairs, members = found(spark, rows, words, threshold)
    got = {(r.key_a, r.key_b) for r in nd.close_pairs(pairs, members).collect()}
    assert got == brute(rows, words, threshold)


def test_edge_cases(spark):
    rows = [("a", None), ("b", ""), ("c", "one two"), ("d", "one two three"), ("e", "ONE, two; three!"), ("e", "ONE, two; three!"), ("f", "x y z " * 20_000), ("g", "x y z " * 20_001), (None, "one two three"), ("h", "naïve café über alles"), ("i", "naïve café über alles")]
    pairs, members = found(spark, rows, 3, 0.6)
    assert {(r.key_a, r.key_b) for r in nd.close_pairs(pairs, members).collect()} == {("d", "e"), ("f", "g"), ("h", "i")}
    assert {r.key for r in members.collect()} == {"d", "e", "f", "g", "h", "i"}
    pairs, members = found(spark, [], 3, 0.6)
    assert nd.close_pairs(pairs, members).count() == 0 and nd.duplicate_groups(pairs, members).count() == 0


def test_kinds_are_apart(spark):
    df = spark.createDataFrame([("chunk", "a", "one two three four"), ("quote", "b", "one two three four")], "kind string, key string, text string")
    assert nd.close_pairs(*nd.near_duplicates(df, words=3, threshold=0.6)).count() == 0


def test_repeated_keys_with_differing_texts_join_no_classes(spark):
    r = random.Random(5)
    one, two = (" ".join(r.choice(WORDS) for _ in range(60)) for _ in range(2))
    rows = [("a", one), ("a", two), ("x", one), ("y", two)]
    pairs, members = found(spark, rows, 3, 0.6)
    assert {(p.key_a, p.key_b) for p in nd.close_pairs(pairs, members).collect()} == {("a", "x"), ("a", "y")}
    assert sorted((g.key, g.group, g.links) for g in nd.duplicate_groups(pairs, members).collect()) == [("a", "a", 1), ("a", "a", 1), ("x", "a", 1), ("y", "a", 1)]
    # Keys repeat at random over near texts: a pair is close if any two of their texts are.
    texts = corpus(6)
    rows = [(f"k{r.randrange(60):02d}", t) for _, t in texts]
    sets = [(k, shingles(t, 3)) for k, t in rows]
    want = {tuple(sorted((k, q))) for k, s in sets for q, u in sets if k != q and len(s & u) >= 0.6 * len(s | u)}
    got = [(p.key_a, p.key_b) for p in nd.close_pairs(*found(spark, rows, 3, 0.6)).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_many_copies(spark):
    rows = [(f"k{i:03d}", "the same words all over again") for i in range(60)]
    pairs, members = found(spark, rows, 3, 0.6)
    assert nd.close_pairs(pairs, members).count() == 60 * 59 // 2
    groups = nd.duplicate_groups(pairs, members).collect()
    assert {g.group for g in groups} == {"k000"} and {g.links for g in groups} == {59}


def test_candidates_are_checked_in_parts(spark, monkeypatch):
    """A family whose sets do not fit one place."""
    monkeypatch.setattr(nd, "HELD", 4_096)
    rows = corpus(8, 15)
    got = {(x.key_a, x.key_b) for x in nd.close_pairs(*found(spark, rows, 3, 0.6)).collect()}
    assert got == brute(rows, 3, 0.6)


def test_found_pairs_of_large_classes_are_all_there(spark, monkeypatch, tmp_path):
    """Two close families of copies, equal and written otherwise, dealt to many blocks."""
    monkeypatch.setattr(nd, "DEALT", 16)
    r = random.Random(9)
    base = [r.choice(WORDS) for _ in range(60)]
    near = [*base[:-2], "other", "end"]
    rows = [(f"k{i:03d}", " ".join(w if i % 3 else w.upper() for w in base)) for i in range(70)]
    rows += [(f"l{i:03d}", ", ".join(near)) for i in range(60)] + corpus(4, 10)
    spark.createDataFrame(rows, "chunk_id string, text string").write.parquet(f"{tmp_path}/chunks.parquet")
    spark.createDataFrame([], "risk_id string, evidence_quote string").write.parquet(f"{tmp_path}/risk_factors.parquet")
    got = [(x.key_a, x.key_b) for x in queries.p5_found(spark, str(tmp_path)).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows, 3, 0.6)


def test_large_bands_are_dealt_as_tiles(spark, monkeypatch):
    """A third of all texts in one group of near-equal ones, with tiles small enough to be used."""
    monkeypatch.setattr(nd, "TILE", 16)
    r = random.Random(7)
    base = [r.choice(WORDS) for _ in range(80)]
    rows = []
    for i in range(90):
        words = list(base)
        words[r.randrange(80)] = f"edit{i}"
        rows.append((f"n{i:03d}", " ".join(words)))
    rows += [(f"o{i:03d}", " ".join(r.choice(WORDS) for _ in range(80))) for i in range(90)]
    got = {(x.key_a, x.key_b) for x in nd.close_pairs(*found(spark, rows, 3, 0.6)).collect()}
    assert got == brute(rows, 3, 0.6)


def test_groups_by_brute_force(spark):
    rows = corpus(3)
    pairs, members = found(spark, rows, 3, 0.6)
    links = brute(rows, 3, 0.6)
    parent = {k: k for k, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    degree = {k: sum(k in p for p in links) for k in parent}
    got = {r.key: (r.group, r.links) for r in nd.duplicate_groups(pairs, members).collect()}
    assert got == {k: (root(k), degree[k]) for k in parent}


def test_sets_are_packed_without_loss():
    sets, sizes = nd.shingle_sets(["a b c d e f", None, "e f g"], 3)
    assert sizes.tolist() == [4, 0, 1] and (nd.unpacked(nd.packed(sets)) == sets).all() and len(nd.unpacked(b"")) == 0


def test_tile_pairs_skip_by_size():
    n = np.array([10, 11, 100])
    fp = np.zeros((3, 3), np.uint64)
    left, right = nd.tile_pairs(n, fp, n, fp, 0.6, True)
    assert list(zip(left, right)) == [(0, 1)]
    assert len(nd.tile_pairs(n[:2], fp[:2], n[2:], fp[2:], 0.6, False)[0]) == 0
    full = np.full((3, 3), 2**64 - 1, np.uint64)  # population counts of 0 and 192
    assert len(nd.tile_pairs(n[:2], fp[:2], n[:2], full[:2], 0.6, False)[0]) == 0


def vectors(seed, n=600, dims=128, centres=40):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(centres, dims))
    v = middle[rng.integers(0, centres, n)] + 0.45 * rng.normal(size=(n, dims)) * (rng.random(n) < 0.5)[:, None] + 1.2 * rng.normal(size=(n, dims)) * (rng.random(n) < 0.3)[:, None]
    return v * rng.uniform(0.1, 9, n)[:, None]


def exact(keys, v, k, least):
    """Pairs by brute force, with ties in favour of the lesser key."""
    v = v / np.linalg.norm(v, axis=1)[:, None]
    s = v @ v.T
    out = set()
    for i, key in enumerate(keys):
        order = sorted((j for j in range(len(keys)) if j != i), key=lambda j: (-round(s[i, j], 6), keys[j]))[:k]
        out |= {tuple(sorted((key, keys[j]))) for j in order if s[i, j] >= least}
    return out


def near_frame(spark, v):
    keys = [f"k{i:04d}" for i in range(len(v))]
    return keys, spark.createDataFrame([(k, "", x.tolist(), "e") for k, x in zip(keys, v)], "key string, at string, vector array<float>, v string")


def test_neighbours_reach_the_recall(spark):
    v = vectors(1)
    keys, df = near_frame(spark, v)
    near = neighbours.nearest(df, least=0.75, leaf=60)
    assert near.leaves > 4
    got, want = {(r.key_a, r.key_b) for r in neighbours.close_pairs(near).collect()}, exact(keys, v, 10, 0.75)
    assert len(got & want) >= 0.97 * len(want)
    # No pair is invented: what is not among the true ten of either end stands in for a missed one, and is close itself.
    unit = dict(zip(keys, v / np.linalg.norm(v, axis=1)[:, None]))
    assert all(unit[a] @ unit[b] >= 0.75 - 1e-6 for a, b in got) and len(got - want) <= len(want - got) + 2
    ten = neighbours.similar_keys(neighbours.nearest(df, leaf=60, recall=0.9))
    assert ten.groupBy("key").count().where("count < 10").count() <= 6


@pytest.mark.parametrize("kind", ["clustered", "spread", "mixed"])
def test_true_recall_without_a_limit(spark, monkeypatch, kind):
    """Recall against brute force over all vectors, where the tree is fitted on a part and calibrated on others."""
    monkeypatch.setattr(neighbours, "SAMPLE", 1_000)
    monkeypatch.setattr(neighbours, "CALIBRATION", 300)
    rng = np.random.default_rng(11)
    n = 3_000
    v = {"clustered": lambda: vectors(4, n, centres=150), "spread": lambda: rng.normal(size=(n, 128)), "mixed": lambda: np.concatenate([vectors(5, n // 2, centres=30), rng.normal(size=(n // 2, 128)) * rng.uniform(0.2, 3, 128)])}[kind]()
    keys, df = near_frame(spark, v)
    near = neighbours.nearest(df, leaf=100, recall=0.9)
    assert near.leaves >= 20 and near.recall >= 0.9
    got = {(r.key, r.other) for r in neighbours.similar_keys(near).collect()}
    unit = v / np.linalg.norm(v, axis=1)[:, None]
    s = unit @ unit.T
    np.fill_diagonal(s, -2)
    tenth = np.sort(s, axis=1)[:, -10]
    at = {k: i for i, k in enumerate(keys)}
    assert len(got) == 10 * n
    true = sum(s[at[k], at[o]] >= tenth[at[k]] - 1e-6 for k, o in got)
    assert true >= 0.9 * 10 * n


def test_leaves_grow_with_the_collection(spark, monkeypatch):
    """More leaves than the driver's sample can tell apart: a second level is fitted below the first, in tasks."""
    monkeypatch.setattr(neighbours, "SAMPLE", 200)
    v = vectors(6, 2_400, centres=100)
    v = v / np.linalg.norm(v, axis=1)[:, None] + 0.02 * np.random.default_rng(1).normal(size=v.shape)  # no ties
    keys, df = near_frame(spark, v)
    near = neighbours.nearest(df, leaf=40, least=0.75)
    assert near.leaves > 2 * (200 // neighbours.FITTED)
    got, want = {(r.key_a, r.key_b) for r in neighbours.close_pairs(near).collect()}, exact(keys, v, 10, 0.75)
    assert len(got & want) >= 0.98 * len(want)


def test_hot_leaves_are_dealt(spark, monkeypatch):
    """A third of all vectors in one place, stored in several blocks and asked for in several parts."""
    monkeypatch.setattr(neighbours, "BLOCK", 64)
    monkeypatch.setattr(neighbours, "ASKED", 100)
    rng = np.random.default_rng(8)
    v = np.concatenate([rng.normal(size=128) + 0.3 * rng.normal(size=(300, 128)), vectors(9, 300)])
    keys, df = near_frame(spark, v)
    got, want = {(r.key_a, r.key_b) for r in neighbours.close_pairs(neighbours.nearest(df, least=0.75, leaf=150)).collect()}, exact(keys, v, 10, 0.75)
    assert len(got & want) >= 0.97 * len(want)


def test_neighbour_edge_cases(spark):
    unit = [0.0] * 127
    rows = [("a", "1", [1.0, *unit]), ("a", "2", [2.0, *unit]), ("b", "1", [1.0, *unit]), ("c", "1", [0.0] * 128), ("d", "1", None), ("e", "1", [1.0]), ("f", "1", [float("nan"), *unit]), ("g", "1", [None, *unit]), ("h", "1", [1.0, 0.1, *unit[1:]]), (None, "1", [1.0, *unit])]
    df = spark.createDataFrame(rows, "key string, at string, vector array<float>")
    got = {(r.key_a, r.key_b) for r in neighbours.close_pairs(neighbours.nearest(df, least=0.75)).collect()}
    assert got == {("a", "b"), ("a", "h"), ("b", "h")}
    assert neighbours.close_pairs(neighbours.nearest(df.limit(0), least=0.75)).count() == 0


def test_many_copies_of_a_vector(spark):
    rng = np.random.default_rng(2)
    copy = rng.normal(size=128).tolist()
    rows = [(f"c{i:03d}", "", copy) for i in range(60)] + [(f"o{i:03d}", "", rng.normal(size=128).tolist()) for i in range(100)]
    near = neighbours.similar_keys(neighbours.nearest(spark.createDataFrame(rows, "key string, at string, vector array<float>"), least=0.75))
    got = {}
    for r in near.collect():
        got.setdefault(r.key, []).append(r.other)
    first = [f"c{i:03d}" for i in range(11)]
    assert set(got) == {f"c{i:03d}" for i in range(60)}
    assert all(sorted(v) == [x for x in first if x != k][:10] for k, v in got.items())


def test_tree_visits_all_leaves_once():
    v = vectors(3, 400).astype(np.float32)
    v /= np.linalg.norm(v, axis=1)[:, None]
    tree = neighbours.grow(v, len(v), leaf=40)
    order = tree.visits(v[:20], tree.leaves)
    assert all(sorted(o) == list(range(tree.leaves)) for o in order.tolist())


def test_search_widens_until_the_recall_is_met(spark, monkeypatch):
    """Vectors without structure, so that few neighbours are in the first leaves."""
    monkeypatch.setattr(neighbours, "WIDEST", 2)
    rng = np.random.default_rng(5)
    v = rng.normal(size=(1_200, 128))
    keys = [f"k{i:04d}" for i in range(len(v))]
    df = spark.createDataFrame([(k, "", x.tolist()) for k, x in zip(keys, v)], "key string, at string, vector array<float>")
    near = neighbours.nearest(df, leaf=40, recall=0.9)
    assert near.leaves > 4 and near.visited > 2 and near.recall >= 0.9
    got, want = {(r.key_a, r.key_b) for r in neighbours.close_pairs(near).collect()}, exact(keys, v, 10, -1.0)
    assert len(got & want) >= 0.88 * len(want)
    # No two are alike: nothing can be measured, so all leaves are visited.
    assert (far := neighbours.nearest(df, leaf=40, least=0.99)).visited == far.leaves


def test_similarities_are_not_rounded_to_half_precision(spark):
    rows = [(key, "", [c, (1 - c * c) ** 0.5 * sign, *[0.0] * 126]) for key, c, sign in (("a", 1.0, 1), ("b", 0.75002, 1), ("c", 0.74998, -1))]
    near = neighbours.nearest(spark.createDataFrame(rows, "key string, at string, vector array<float>"), least=0.75)
    assert {(r.key_a, r.key_b) for r in neighbours.close_pairs(near).collect()} == {("a", "b")}


def test_rounds_find_the_same_and_free_their_shuffle(spark, monkeypatch):
    """Leaves are served in rounds: as many pairs as in one, and no vectors are left in shuffle files."""
    v = vectors(12, 2_000, centres=100)
    keys, df = near_frame(spark, v)
    folders = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()

    def shuffled():
        return sum(f.stat().st_size for d in folders for f in Path(d).rglob("shuffle_*.data"))

    def found(near):
        return {(r.a, r.b, r.similarity) for r in near.edges.collect()}

    monkeypatch.setattr(neighbours, "COPIES", 100.0)
    one = neighbours.nearest(df, leaf=60, least=0.75)
    monkeypatch.setattr(neighbours, "COPIES", 0.2)
    before = shuffled()
    many = neighbours.nearest(df, leaf=60, least=0.75)
    assert one.rounds == 1 and many.rounds > 3
    got, want = found(many), found(one)
    assert {(a, b) for a, b, _ in got} == {(a, b) for a, b, _ in want}
    for _ in range(50):
        if shuffled() - before < 128 * 4 * len(v) / 2:
            break
        time.sleep(0.1)
    assert shuffled() - before < 128 * 4 * len(v) / 2
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_trees_of_many_leaves_are_not_deep():
    """Over a large collection a node has more children, else a pair is parted at each of many levels."""
    v = np.random.default_rng(4).normal(size=(20_000, 128)).astype(np.float32)
    v /= np.linalg.norm(v, axis=1)[:, None]
    tree = neighbours.grow(v, 2_400_000)
    depth, level = 0, [0]
    while level := [c for n in level for c in tree.children[n]]:
        depth += 1
    assert tree.leaves >= 300 and depth <= 3
