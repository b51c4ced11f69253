"""Near copies at a similarity against brute force."""

import numpy as np
import pytest

from citegrain.llm import copies

WORDS = [f"{a}{b}" for a in "bcdfghklmnprst" for b in ("a", "eli", "om", "urra", "in")]


def family(seed: int, n: int, copies_: int, edits: int) -> list[str]:
    """A text of n words and copies with some words replaced."""
    rng = np.random.default_rng(seed)
    base = rng.choice(WORDS, n)
    out = [" ".join(base)]
    for _ in range(copies_):
        x = base.copy()
        x[rng.integers(0, n, rng.integers(1, edits + 1))] = rng.choice(WORDS, 1)
        out.append(" ".join(x))
    return out


def brute(texts: list[str | None]) -> list[int]:
    """The least position that each text reaches by links of a similarity of 0.8."""

    def shingles(x):
        w = (x or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}

    sets, root = [shingles(x) for x in texts], list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            shared = len(sets[i] & sets[j])
            if root[i] != root[j] and shared >= 0.8 * (len(sets[i]) + len(sets[j]) - shared):
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    return root


def test_within_counts_differing_bits():
    prints = np.random.default_rng(1).integers(0, 256, (300, 32), np.uint8)
    prints[100:200] = prints[0]
    prints[100:200, :4] ^= np.random.default_rng(2).integers(0, 256, (100, 4), np.uint8)
    apart = np.unpackbits(prints[:, None] ^ prints[None], axis=2).sum(axis=2)
    for radius in (0, 15, 56):
        want = np.argwhere(apart <= radius)
        assert np.array_equal(np.stack(copies.within(prints, prints, radius), axis=1), want)


@pytest.mark.parametrize("n", [40, 300])
def test_forest_joins_what_is_within(n):
    prints = np.repeat(np.random.default_rng(n).integers(0, 256, (5, 32), np.uint8), n // 5, axis=0)
    prints[:, 0] ^= np.arange(n, dtype=np.uint8) & 7
    links = copies.forest(prints, np.full(n, 100), 0.8)
    assert len(links) == n - 5 and all(i // (n // 5) == j // (n // 5) for i, j in links)
    sizes = np.where(np.arange(n) % 2, 100, 130)
    assert all(sizes[i] == sizes[j] for i, j in copies.forest(prints, sizes, 0.8)) and len(copies.forest(prints, sizes, 0.8)) == n - 10
    far = prints.copy()
    far[::2, :9] ^= 255  # 72 bits
    assert len(copies.forest(far, np.full(n, 100), 0.8)) == n - 10 and len(copies.forest(far, np.full(n, 10), 0.8)) == n - 5


def test_shingles_of_parts_are_those_of_the_whole(monkeypatch):
    words = family(3, 500, 0, 1)[0].encode().split()
    whole, print_ = copies.shingle_set(words), copies.fingerprint(copies.shingle_set(words))
    monkeypatch.setattr(copies, "_CHUNK", 7)
    assert np.array_equal(copies.shingle_set(words), whole) and copies.fingerprint(whole) == print_
    assert len(whole) == len({tuple(words[i : i + 5]) for i in range(496)})
    assert [len(copies.shingle_set(w)) for w in ([], [b"a"], [b"a"] * 4, [b"a"] * 5, [b"a"] * 6)] == [0, 1, 1, 1, 1]


def test_near_copies_are_those_of_brute_force(spark):
    texts = [None, "", " \n", "One two", "one TWO", "a", "a b c d e f"]
    for seed in range(12):
        texts += family(seed, 60 + 40 * seed, 6, 3 + seed)
    texts += family(99, 200, 80, 2) + [texts[20]] * 3
    want = brute(texts)
    df = spark.createDataFrame([(i, x, "p") for i, x in enumerate(texts)] + [(None, texts[30], "p")], "doc_id long, text string, node string")
    got = {r["doc_id"]: r["component_id"] for r in copies.near_copies(df).collect()}
    assert [got[i] for i in range(len(texts))] == want and got[None] == want[30]
    nodes = df.select(copies.sketches(df["text"]).alias("p")).select("p.*").dropDuplicates(["node"])
    roots = {r["node"]: r["root"] for r in copies.components(copies.candidates(nodes, 0.8, 16)).collect()}
    assert {r["node"]: r["root"] for r in copies.components(copies.candidates(nodes, 0.8)).collect()} == roots
    assert copies.near_copies(df.limit(0)).count() == 0


def test_short_pairs_always_share_a_key():
    rng = np.random.default_rng(4)
    for n in range(1, 80):
        for _ in range(20):
            base = np.unique(rng.integers(0, 1 << 62, 2 * n + 4).astype(np.uint64))
            a = np.sort(rng.permutation(base)[:n])
            keep = rng.permutation(a)[: n - rng.integers(0, n // 9 + 2)]
            b = np.unique(np.concatenate([keep, rng.choice(base, rng.integers(0, n // 9 + 2))]))
            shared = len(np.intersect1d(a, b))
            if shared >= 0.8 * (len(a) + len(b) - shared):
                assert len(np.intersect1d(copies.keys(a), copies.keys(b)))


def test_long_pairs_share_a_key_and_stay_within_the_radius():
    """3000 pairs of a similarity of 0.8 to 0.86, the hardest there are."""
    rng = np.random.default_rng(5)
    for _ in range(3000):
        n = int(rng.integers(64, 400))
        hashes = np.unique(rng.integers(0, 1 << 62, n).astype(np.uint64))
        edit = len(hashes) // 10
        a, b = hashes[np.sort(rng.permutation(len(hashes))[edit:])], hashes
        a = np.unique(np.concatenate([a, rng.integers(0, 1 << 62, edit).astype(np.uint64)]))
        shared = len(np.intersect1d(a, b))
        assert 0.8 <= shared / (len(a) + len(b) - shared) < 0.86
        assert len(np.intersect1d(copies.keys(a), copies.keys(b)))
        x, y = (np.frombuffer(copies.fingerprint(h), np.uint8) for h in (a, b))
        assert np.unpackbits(x ^ y).sum() <= copies.RADIUS


def test_copies_of_one_short_text_with_a_word_more(spark):
    """Of 4 and 5 shingles: a similarity of 0.8 exactly, whatever the fingerprints say."""
    texts = [" ".join(f"w{i}x{k}" for k in range(8)) for i in range(60)]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)] + [(100 + i, x + " more") for i, x in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in copies.near_copies(df).collect()}
    assert all(got[100 + i] == i for i in range(60))


def test_hubs_are_joined_in_parts(spark, monkeypatch):
    from citegrain.llm import common, simhash

    monkeypatch.setattr(common, "HUB", 3)
    star = [(0, i) for i in range(1, 40)] + [(i, i + 100) for i in range(1, 10)] + [(500, 501)]
    roots = {r["node"]: r["root"] for r in simhash.components(spark.createDataFrame(star, "a long, b long")).collect()}
    assert roots == {i: 0 for i in range(1, 40)} | {i + 100: 0 for i in range(1, 10)} | {501: 500}


def jobs(spark, run):
    """What `run` gives, and the Spark jobs that it starts."""
    from uuid import uuid4

    group = uuid4().hex
    spark.sparkContext.setJobGroup(group, "counted")
    try:
        return run(), len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_rounds_end_as_soon_as_links_are_stars(spark):
    """Another round to see that nothing changes would take some twenty jobs, each of as many tasks as there are partitions."""
    from citegrain.llm import simhash

    links = spark.createDataFrame([(i // 10 * 10, i) for i in range(100)], "a long, b long")
    found, n = jobs(spark, lambda: simhash.components(links).collect())
    assert {r["node"]: r["root"] for r in found} == {i: i // 10 * 10 for i in range(100) if i % 10} and n <= 8
    found, n = jobs(spark, lambda: simhash.components(links.limit(0)).collect())
    assert found == [] and n <= 8


@pytest.mark.parametrize("hub", [2, 512])
def test_components_of_random_links(spark, monkeypatch, hub):
    from citegrain.llm import common, simhash

    monkeypatch.setattr(common, "HUB", hub)
    links = np.random.default_rng(hub).integers(0, 300, (220, 2)).tolist() + [[i, i + 1] for i in range(400, 440)] + [[7, 7], [450, 460], [460, 450], [450, 460]]
    root = {x: x for pair in links for x in pair}
    for _ in range(len(root)):
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    got = simhash.components(spark.createDataFrame(links, "a long, b long")).collect()
    assert sorted((r["node"], r["root"]) for r in got) == sorted((a, b) for a, b in root.items() if a != b)


def test_links_that_fall_short_do_not_part_what_others_join(spark, monkeypatch):
    """The forest's links are made to fall short wherever others could take their place: sides meet again, and whole sides are joined."""
    plain = copies.forest

    def far_first(prints, sizes, similarity):
        links = plain(prints, sizes, similarity)
        nodes = sorted({x for pair in links for x in pair})
        return links[::2] + [(nodes[0], x) for x in nodes[1:]]

    texts = [x for seed in range(4) for x in family(seed, 60, 9, 9)]
    want = brute(texts)
    monkeypatch.setattr(copies, "forest", far_first)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in copies.near_copies(df).collect()}
    assert [got[i] for i in range(len(texts))] == want
