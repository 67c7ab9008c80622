"""Near-duplicates against all pairs in plain Python."""

import random

import numpy as np
import pytest

from dupeloom.llm.minhash import connected_components, keep_one_of_each, near_duplicates, shingle_set, signature


def shingles(text, size):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return frozenset()
    size = min(size, len(words))
    return frozenset(tuple(words[i : i + size]) for i in range(len(words) - size + 1))


def brute_force(rows, size, percent):
    """{(doc_id, text): (set size, component)} by all pairs."""
    sets = [shingles(t, size) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i] = parent[parent[i]]
        return i

    for i in range(len(rows)):
        for j in range(i):
            shared = len(sets[i] & sets[j])
            if shared and 100 * shared >= percent * (len(sets[i]) + len(sets[j]) - shared):
                parent[find(i)] = find(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[find(i)] = min(doc_id, least.get(find(i), doc_id))
    return sorted(((d, len(s), least.get(find(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))), key=str)


def edited(words, rng, n):
    words = list(words)
    for _ in range(n):
        at = rng.randrange(len(words))
        words[at] = f"new{rng.random()}"
    return words


@pytest.fixture(scope="module")
def made():
    """Groups of edited copies with all degrees of likeness, short texts, and texts that share a passage."""
    rng = random.Random(3)
    rows, doc_id = [], 1000
    vocabulary = [f"w{i}" for i in range(500)]
    passage = rng.choices(vocabulary, k=60)
    for group, copies in enumerate((40, 3, 2, 2, 5, 1, 1, 1)):
        base = rng.choices(vocabulary, k=rng.randrange(80, 200))
        for i in range(copies):
            rows.append((doc_id, " ".join(edited(base, rng, i % 6) if i else base)))
            doc_id += rng.randrange(1, 9)
    for _ in range(60):
        rows.append((doc_id, " ".join(rng.choices(vocabulary, k=rng.randrange(5, 60)) + passage)))
        doc_id += 1
    rows += [(doc_id + i, t) for i, t in enumerate(["two words", "Two  WORDS", "two", "", None, "\x1c", "é É", "É É"])]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("size", "percent"), [(3, 85), (5, 80)])
def test_components_equal_all_pairs(spark, sf_dir, made, size, percent):
    held = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    rows = made + held
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in near_duplicates(docs, size, percent).collect()), key=str)
    assert got == brute_force(rows, size, percent)


def test_a_star_of_far_copies_is_one_component(spark):
    """Each copy is like the first alone; two copies are too far from one another."""
    rng = random.Random(4)
    base = [f"w{rng.randrange(10**6)}" for _ in range(200)]
    rows = [(0, " ".join(base))] + [(i, " ".join(edited(base, rng, 5))) for i in range(1, 400)]
    wanted = brute_force(rows[:60], 3, 85)
    assert {c for _, _, c in wanted} == {0}
    found = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()
    assert {r.component_id for r in found} == {0}


def bridged(rng, first_id, many, few):
    """Two groups of close copies with one link between them, of a member of each; all are as far from their group's middle."""
    base = [f"w{rng.randrange(10**9)}" for _ in range(200)]
    places = rng.sample(range(3, 190, 6), 27)
    far, own = places[:7], places[7:]

    def made(at):
        words = [f"{w}b" if i in at else w for i, w in enumerate(base)]
        return " ".join([*words[:-1], f"end{rng.random()}"])

    def close(at):
        i = rng.choice(own)
        return made(at).replace(base[i], f"own{rng.random()}")

    texts = [close(far) for _ in range(many)] + [made(far[:6])] + [close([]) for _ in range(few)] + [made(far[5:6])]
    rng.shuffle(texts)
    return [(first_id + i, t) for i, t in enumerate(texts)]


def test_one_link_between_two_groups_of_copies_joins_them(spark):
    rng = random.Random(11)
    families = [bridged(rng, 1000 * k, 120, 90) for k in range(8)]
    for rows in families[:1]:
        assert {c for _, _, c in brute_force(rows, 3, 85)} == {rows[0][0]}
    docs = spark.createDataFrame([r for f in families for r in f], "doc_id long, text string").repartition(5)
    found = near_duplicates(docs, 3, 85).collect()
    assert {(r.doc_id, r.component_id) for r in found} == {(d, f[0][0]) for f in families for d, _ in f}


def members(rng, regions):
    """Rows (region, root, class, n, sketch, shingles): in each region, members of a few roots, with sets of all degrees of likeness."""
    from dupeloom.llm.minhash import signature

    rows = []
    for region, size in enumerate(regions):
        base = rng.integers(1, 1 << 62, 120, dtype=np.uint64)
        for c in range(size):
            kept = base[rng.random(120) < rng.choice([0.99, 0.95, 0.9, 0.8])]
            own = np.unique(np.concatenate([kept, rng.integers(1, 1 << 62, rng.integers(0, 9), dtype=np.uint64)]))
            sketch = np.packbits((signature(own) & np.uint64(1)).astype(np.uint8)).tobytes()
            rows.append((region, int(rng.integers(1 + size // 2)) + 1000 * region, 1000 * region + c, len(own), sketch, own.tobytes()))
    return sorted(rows, key=lambda r: r[:3])


def joined(pairs):
    """{root: smallest root that pairs reach}."""
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in [*parent] if find(x) != x}


def linked(rows):
    sets = [(r[0], r[1], set(np.frombuffer(r[5], np.uint64).tolist())) for r in rows]
    return joined((a, b) for i, (g, a, x) in enumerate(sets) for h, b, y in sets[:i] if g == h and a != b and 100 * len(x & y) >= 85 * len(x | y))


def test_rows_are_cut_into_blocks(monkeypatch):
    import pyarrow as pa

    from dupeloom.llm import minhash

    monkeypatch.setattr(minhash, "CROWD", 4)
    rows = members(np.random.default_rng(5), (3, 9, 1, 4, 17, 6))
    table = pa.table([pa.array([r[i] for r in rows], t) for i, t in ((0, pa.int64()), (1, pa.int64()), (3, pa.int64()), (4, pa.binary()), (5, pa.binary()))], list("abcde"))
    for most in (1 << 21, 300):
        monkeypatch.setattr(minhash, "MOST_SHINGLES", most)
        batches = [x for part in (table[:5], table[5:6], table[6:6], table[6:30], table[30:]) for x in part.to_batches()]
        pieces = list(minhash._pieces(iter(batches)))
        assert pa.concat_tables([p for p, _ in pieces]).to_pylist() == table.to_pylist()
        for p, alone in pieces:
            regions = set(p.column(0).to_pylist())
            assert len(regions) == 1 and len(p) <= 4 and (len(p) == 1 or sum(p.column(2).to_pylist()) <= most)
            assert alone == (regions in ({2}, {3}) and len(p) == {2: 1, 3: 4}[min(regions)])


def test_roots_that_meet_are_joined_as_by_all_pairs(spark, monkeypatch):
    """Within blocks and between them, whether a shingle is counted by postings or by products."""
    from dupeloom.llm import minhash

    rows = members(np.random.default_rng(6), (40, 1, 90, 12, 300))
    wanted = linked(rows)
    assert len(wanted) > 20
    crowd = spark.createDataFrame(rows, "region long, root long, class long, n long, sketch binary, shingles binary").repartition(3)
    assert joined(map(tuple, minhash._across(crowd, 85, 40).collect())) == wanted
    monkeypatch.setattr(minhash, "CROWD", 15)  # many groups of blocks
    assert joined(map(tuple, minhash._across(crowd, 85, 40).collect())) == wanted
    one_root = spark.createDataFrame([(r[0], r[0] + (r[2] % 1000 >= 200), *r[2:]) for r in rows], crowd.schema)  # groups of one root among them
    assert joined(map(tuple, minhash._across(one_root, 85, 40).collect())) == linked([tuple(r) for r in one_root.collect()])
    for often in (2, 48):
        monkeypatch.setattr(minhash, "FREQUENT", often)
        for region in (0, 2, 4):
            own = [r for r in rows if r[0] == region]
            half = len(own) // 2
            block = lambda part: minhash._Block(b"".join(np.asarray(r[1:2] + r[3:4]).tobytes() + r[4] for r in part), b"".join(r[5] for r in part))
            parts = [minhash._joining(block(x), block(y), 85, 40) for x, y in ((own, own[:half]), (own, own[half:]))]
            assert joined(tuple(p) for x in parts for p in x.tolist()) == linked(own)


def test_edge_rows(spark, edge_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in edge_docs.collect()]
    found = near_duplicates(edge_docs, 5, 80).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in found), key=str) == brute_force(rows, 5, 80)
    kept = keep_one_of_each(edge_docs)
    assert kept.columns == edge_docs.columns
    texts = [r.text for r in kept.collect()]
    words = [t for t in texts if t and t.split()]
    assert len(words) == len(set(words)) == len({t for _, t in rows if t and t.encode().split()})
    assert near_duplicates(no_docs).collect() == [] and keep_one_of_each(no_docs).collect() == []
    assert near_duplicates(no_docs).columns == ["row", "doc_id", "n_shingles", "component_id", "survivor"]


def test_one_of_each_component_stays(spark, made):
    docs = spark.createDataFrame(made + made[:20], "doc_id long, text string")
    components = {c for _, n, c in brute_force(made, 5, 80) if n}
    kept = keep_one_of_each(docs, 5, 80).collect()
    assert sorted(r.doc_id for r in kept if shingles(r.text, 5)) == sorted(components)


def test_signature_estimates_similarity():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 2000, dtype=np.uint64)
    other = np.concatenate([base[:1600], rng.integers(0, 1 << 63, 400, dtype=np.uint64)])
    alike = (signature(np.unique(base)) == signature(np.unique(other))).mean()
    assert abs(alike - 1600 / 2400) < 0.17
    assert len(shingle_set("a b c d", 3)) == 2 and len(shingle_set("a b", 3)) == 1 and not len(shingle_set(" \n", 3))


def test_components_of_long_paths_and_stars(spark):
    rng = random.Random(7)
    names = rng.sample(range(10**12), 400)
    path = list(zip(names[:150], names[1:150], strict=False))
    star = [(names[200], x) for x in names[201:399]]
    edges = spark.createDataFrame(path + star + [(names[0], names[0]), (names[5], names[3])], "a long, b long")
    roots = {r.node: r.root for r in connected_components(edges, "a", "b", few=20).collect()}
    at_once = connected_components(edges, "a", "b").collect()
    assert {(x, roots[x]) for x in roots} == {(r.node, r.root) for r in at_once}
    assert set(roots) == {x for e in path + star for x in e}
    assert len({roots[x] for x in names[:150]}) == 1 and len({roots[x] for x in names[200:399]}) == 1
    assert connected_components(edges.where("false"), "a", "b").collect() == []
