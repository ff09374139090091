"""Components, MinHash near-duplicates and embedding links against brute force."""

import os
import pickle
import random
import re
import time
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

from pyspark.sql import functions as F

from agoralake.llm import components, cover_tree, minhash


def groups(nodes, links):
    """Smallest node reachable from each node."""
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return {n: find(n) for n in nodes}


def test_components_against_union_find(spark):
    rng = random.Random(3)
    links = [(rng.randrange(400), rng.randrange(400)) for _ in range(330)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5)]
    found = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(links, "u bigint, v bigint")).collect()}
    real = [(a, b) for a, b in links if a != b]
    assert found == groups({n for pair in real for n in pair}, real)


def test_components_without_links(spark):
    assert components.components(spark.createDataFrame([(1, 1)], "u bigint, v bigint")).count() == 0


@pytest.mark.parametrize(("per_task", "most"), [(components.LINKS, 1), (100, 4)])
def test_rounds_of_few_links_have_few_tasks(spark, monkeypatch, per_task, most):
    """A round is dealt out by its links, not by the shuffle partitions, where Spark keeps all of these."""
    rng = random.Random(4)
    links = [(rng.randrange(400), rng.randrange(400)) for _ in range(330)] + [(1000 + i, 1001 + i) for i in range(60)]
    real, parts = components.checkpoint, []

    def counted(df):
        out = real(df)
        parts.append(out.rdd.getNumPartitions())
        return out

    monkeypatch.setattr(components, "checkpoint", counted)
    monkeypatch.setattr(components, "LINKS", per_task)
    held = {"spark.sql.shuffle.partitions": "23", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {key: spark.conf.get(key) for key in held}
    try:
        for key, value in held.items():
            spark.conf.set(key, value)
        found = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(links, "u bigint, v bigint")).collect()}
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    real_links = [(a, b) for a, b in links if a != b]
    assert found == groups({n for pair in real_links for n in pair}, real_links)
    assert parts[0] == 23 and len(parts) > 2 and max(parts[1:]) <= most, parts


def shingles(text, n):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1)))


def near(rows, n, above, of):
    sets = {d: shingles(t, n) for d, t in rows}
    links = [(a, b) for a, b in combinations(sets, 2) if sets[a] and of * len(sets[a] & sets[b]) >= above * len(sets[a] | sets[b])]
    return sets, groups(sets, links)


def edited(rng, words, changes):
    words = list(words)
    for _ in range(changes):
        words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
    return words


@pytest.mark.parametrize(("n", "above", "of", "block"), [(3, 85, 100, 384), (5, 80, 100, 384), (3, 85, 100, 3)])
def test_minhash_against_all_pairs(spark, monkeypatch, n, above, of, block):
    monkeypatch.setattr(minhash, "BLOCK", block)  # with few sets in a block, loose components have main classes and others
    rng, rows = random.Random(11), []
    for g in range(40):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.choice((4, 30, 150, 400)))]
        for _ in range(rng.choice((1, 2, 5, 12))):
            base = edited(rng, base, rng.choice((0, 0, 1, len(base) // 60)))  # chains of copies of copies
            rows.append((len(rows), " ".join(base).upper() if rng.random() < 0.2 else " ".join(base)))
    rng.shuffle(rows)
    sets, component = near(rows, n, above, of)
    found = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), minhash.plan(n, above, of)).collect()
    assert {r["doc_id"]: r["component_id"] for r in found} == component
    assert all(r["n_shingles"] == len(sets[r["doc_id"]]) and r["kept"] == (r["doc_id"] == component[r["doc_id"]]) for r in found)


def test_a_large_group_of_near_copies(spark):
    rng = random.Random(2)
    base = [f"b{i}" for i in range(120)]
    rows = [(i, " ".join(edited(rng, base, 1))) for i in range(1200)]
    found = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(7), minhash.plan(3, 85, 100))
    assert found.where("component_id = 0").count() == 1200


def test_pairs_in_shared_boilerplate_are_found(spark):
    """Documents that are all loosely alike by shared lines: pairs meet through hubs that are neither of them."""
    rng = random.Random(21)
    shared = [f"s{rng.randrange(400)}" for _ in range(190)]
    own = lambda: [f"o{rng.randrange(5000)}" for _ in range(60)]
    rows, planted = [], []
    for k in range(450):
        words = [*shared[: rng.randint(150, 190)], *own()]
        rows.append((3 * k, " ".join(words)))
        if k % 3 == 0:  # 0.85 to 1 alike
            rows.append((3 * k + 1, " ".join(edited(rng, words, rng.randint(1, 5)))))
            planted.append((3 * k, 3 * k + 1))
    sets, want = near(rows, 3, 85, 100)
    linked = [(a, b) for a, b in planted if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    loose = sum(len(sets[a] & sets[b]) / len(sets[a] | sets[b]) > 0.5 for a, b in combinations([r[0] for r in rows[:60]], 2))
    assert len(linked) > 80 and loose > 1000
    found = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4), minhash.plan(3, 85, 100)).collect()}
    met = sum(found[a] == found[b] for a, b in linked)
    assert met >= 0.99 * len(linked), (met, len(linked))
    assert all(want[d] == want[root] for d, root in found.items())


def colliding_words():
    """Two words of 2,048 characters that any polynomial modulo 2**64 with an odd base confuses."""
    one = "".join("ab"[bin(i).count("1") % 2] for i in range(2048))
    return one, one.translate(str.maketrans("ab", "ba"))


def test_words_that_polynomials_confuse(spark):
    one, two = colliding_words()
    rows = [(1, f"{one} x y"), (2, f"{two} x y"), (3, one), (4, two)]
    found = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), minhash.plan(3, 85, 100)).collect()
    assert {r["doc_id"]: r["component_id"] for r in found} == {1: 1, 2: 2, 3: 3, 4: 4}


@pytest.mark.parametrize("n", [3, 5])
def test_exact_sets_are_the_sets_of_words(n):
    rng = random.Random(4)
    texts = [" ".join(rng.choice("abcdefgh") * rng.choice((1, 3)) for _ in range(rng.randrange(40))) for _ in range(60)] + ["", None, "a", "a a", "A  a\ta"]
    sets = minhash.exact_sets(pa.array(texts, pa.string()), n)
    want = [shingles(t, n) for t in texts]
    for (a, x), (b, y) in combinations(zip(sets, want), 2):
        assert len(a) == len(x) and len(np.intersect1d(a, b)) == len(x & y)


def test_another_text_under_a_dropped_id_stays(spark):
    a, b = " ".join(f"a{i}" for i in range(50)), " ".join(f"b{i}" for i in range(50))
    docs = spark.createDataFrame([(3, a), (5, a), (5, b), (None, a)], "doc_id bigint, text string")
    kept = minhash.deduplicate(docs, minhash.plan(5, 80, 100)).collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in kept) == [(0, a), (3, a), (5, b)]


def test_sets_under_null_ids_are_compared(spark):
    words = [f"a{i}" for i in range(80)]
    rows = [(None, " ".join(words)), (None, " ".join([*words[:79], "z"])), (7, " ".join(["y", *words[1:]]))]
    found = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), minhash.plan(3, 85, 100)).collect()
    assert {r["component_id"] for r in found} == {7}


def test_minhash_odd_documents(odd_documents, no_documents, odd_texts):
    p = minhash.plan(3, 85, 100)
    found = minhash.near_duplicates(odd_documents, p).collect()
    assert len(found) == len(odd_texts)
    by = {r["doc_id"]: r for r in found if r["doc_id"] is not None}
    assert all(by[d]["n_shingles"] == 0 and by[d]["component_id"] == d and by[d]["kept"] for d in (1, 2, 3))
    assert by[5]["component_id"] == 4 and by[10]["component_id"] == 9
    assert [by[d]["component_id"] for d in (6, 7, 8, -12)] == [-12] * 4
    assert minhash.near_duplicates(no_documents, p).count() == 0
    kept = minhash.deduplicate(odd_documents, p)
    assert kept.columns == odd_documents.columns
    assert sorted(r["doc_id"] or 0 for r in kept.select("doc_id").collect()) == [-12, 0, 0, 1, 2, 3, 4, 9, 11]


def brute(vectors, threshold):
    good = {d: np.array(v, float) for d, v in vectors if v is not None and None not in v and np.isfinite(np.array(v, float)).all() and np.any(v)}
    good = {d: v / np.abs(v).max() for d, v in good.items()}
    unit = {d: v / np.linalg.norm(v) for d, v in good.items()}
    links = [(a, b) for a, b in combinations(sorted(unit), 2) if len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= threshold]
    count = dict.fromkeys([d for d, _ in vectors], 0)
    for a, b in links:
        count[a] += 1
        count[b] += 1
    return count, groups(count, links)


@pytest.mark.parametrize("cell", [40, 4096])
def test_cover_trees_against_all_pairs(spark, cell):
    rng = np.random.default_rng(5)
    vectors: list = []
    for g in range(30):
        centre = rng.normal(size=16)
        for _ in range(int(rng.integers(1, 25))):
            vectors.append(centre * rng.uniform(0.1, 9) + rng.normal(size=16) * rng.choice([0.02, 0.25, 0.6]))
    rows = [(i * 3, [float(x) for x in v]) for i, v in enumerate(vectors)]
    rows += [(7_000 + i, rows[4][1]) for i in range(30)]  # equal vectors
    rows += [(8_000, None), (8_001, [0.0] * 16), (8_002, [float("nan")] + [1.0] * 15), (8_003, [None] + [1.0] * 15), (8_004, [float("inf")] * 16), (8_005, [])]
    rows += [(8_100, [1.0, 0.0]), (8_101, [1.0, 0.0]), (8_102, [0.99, 0.1]), (8_103, [0.0, -2.0])]  # another width
    rows += [(8_200, [1e200, 1e200] + [0.0] * 14), (8_201, [1e200, 1.0001e200] + [0.0] * 14), (8_202, [1e-310, 1e-310] + [0.0] * 14), (8_203, [0.0] * 15 + [-1e308])]
    rng.shuffle(rows)
    df = spark.createDataFrame([(int(d), v) for d, v in rows], "vec_id bigint, embedding array<double>").selectExpr("vec_id", "embedding", "'x' as node", "1 as weight")
    found = cover_tree.similarity_components(df, threshold=0.95, cell=cell, sample=200).collect()
    count, component = brute(rows, 0.95)
    assert {r["vec_id"]: r["n_links"] for r in found} == count
    assert {r["vec_id"]: r["component_id"] for r in found} == component
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in found)


def test_cover_tree_levels():
    rng = np.random.default_rng(1)
    x = cover_tree.unit(rng.normal(size=(300, 8)))
    tree = cover_tree.Tree(x, np.ones(300, np.int64))
    for k, level in enumerate(tree.levels):
        assert sorted(level.flat.tolist()) == list(range(300))
        for i, (centre, radius) in enumerate(zip(level.centre, level.radius)):
            members = level.members(i)
            assert centre in members and cover_tree._distance(x[members], x[[centre]]).max() <= radius + 1e-7
            assert k == 0 or radius <= 2.0 / 2**k
            if k + 1 < len(tree.levels):
                below = range(level.kids[i], level.kids[i + 1])
                assert sorted(members) == sorted(v for j in below for v in tree.levels[k + 1].members(j))


def planted(tree, weight, reach):
    """A tree as it is sent: packed and unpacked."""
    grown = cover_tree.Tree(cover_tree.unit(tree), weight, reach)
    return grown.order, cover_tree.Vectors(*grown.packed(tree))


@pytest.mark.parametrize(("width", "copies", "near", "most"), [(64, 300, 0.08, 0.05), (64, 2_000, 0.16, 1.3), (12, 300, 0.08, 1.3)])
def test_links_of_vectors_without_structure(width, copies, near, most):
    """Vectors that no radius tells apart, with copies of one of them: all links, and few pairs of which all numbers are multiplied."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(5_000, width))
    x[:copies] = x[0] + near * x[:copies]
    x = rng.permutation(x)
    weight = rng.integers(1, 4, len(x))
    u = cover_tree.unit(x)
    linked = u @ u.T >= 0.95
    np.fill_diagonal(linked, False)
    turn = np.linalg.eigh(u.T @ u)[1][:, ::-1]
    reach = float(np.sqrt(2 - 2 * 0.95))
    (na, a), (nb, b) = planted(x[:2_500], weight[:2_500], reach), planted(x[2_500:], weight[2_500:], reach)
    count, pairs = np.zeros(len(x), np.int64), []
    for left, p, right, q in ((na, a, na, a), (na, a, 2_500 + nb, b), (2_500 + nb, b, 2_500 + nb, b)):
        links = cover_tree.Links(p, q, 0.95, turn)
        assert links.whole < most * len(left) * len(right)
        mine, other, found = links.result()
        count[left] += mine
        if p is not q:
            count[right] += other
        names = left if p is q else np.concatenate([left, right])
        pairs += names[found].tolist()
    assert (count == linked @ weight).all()
    assert groups(range(len(x)), pairs) == groups(range(len(x)), np.argwhere(linked).tolist())


def test_a_tree_is_sent_in_few_bytes():
    """A vector is sent to many other parts: its levels add little to its numbers."""
    x = np.random.default_rng(7).normal(size=(4_000, 64)).astype(np.float32)
    grown = cover_tree.Tree(cover_tree.unit(x.astype(float)), np.ones(len(x), np.int64))
    assert len(pickle.dumps(grown.packed(x))) < 1.1 * (x.nbytes + 8 * len(x))


def test_rows_that_share_an_id(spark):
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.01]), (None, [0.0, 1.0]), (None, [-1.0, 0.0]), (3, [1.0, 0.0, 0.0])]
    found = cover_tree.similarity_components(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect()
    assert sorted((r["vec_id"] or 0, r["n_links"], r["component_id"] or 0, r["kept"]) for r in found) == [(0, 0, 0, False), (0, 1, 1, False), (1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True)]


def test_shells_prune_pairs_of_parts(spark):
    rng = np.random.default_rng(8)
    rows = [(i, [float(x) for x in rng.normal(size=3)]) for i in range(900)]
    found = cover_tree.similarity_components(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), threshold=0.999, cell=30, top=4).collect()
    count, component = brute(rows, 0.999)
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in found} == {d: (count[d], component[d]) for d, _ in rows}


def test_embeddings_of_no_use(spark):
    schema = "vec_id bigint, embedding array<float>"
    assert cover_tree.similarity_components(spark.createDataFrame([], schema)).count() == 0
    [row] = cover_tree.similarity_components(spark.createDataFrame([(3, None)], schema)).collect()
    assert (row["vec_id"], row["n_links"], row["component_id"], row["kept"]) == (3, 0, 3, True)


def test_rounds_leave_no_shuffle_files(spark):
    """No shuffle of a chain's rounds stays on disk, while the result can still be read."""
    folders = [str(f) for f in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    shuffled = lambda: {f for top in folders for _, _, names in os.walk(top) for f in names if f.startswith("shuffle_")}
    before = shuffled()
    found = components.components(spark.range(300).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v")))
    ends = time.time() + 20  # files go in the background
    while shuffled() - before and time.time() < ends:
        time.sleep(0.2)
    assert not shuffled() - before
    assert found.agg(F.count("*"), F.max("component")).first() == (301, 0)
