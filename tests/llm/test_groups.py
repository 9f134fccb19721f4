import collections
import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tablescout.llm import components, decontaminate, grid_join, sharding, simhash
from tests.llm import brute


def prose(seed, size, names=400):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(names)}" for _ in range(size))


def test_components_of_chains_stars_and_loops(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(8, 40)] + [(5, 5), (3, 2), (2, 3), (2, 3)]
    out = {r.node: r.component for r in components.components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert out == {i: 100 for i in range(100, 161)} | {i: 7 for i in range(7, 40)} | {2: 2, 3: 2}
    assert components.components(spark.createDataFrame([], "u long, v long")).collect() == []


# SimHash


@pytest.mark.parametrize("text", [t for t in brute.AWKWARD if t is None or len(t) < 10_000] + [prose(1, 500), "A a b B"])
def test_fingerprints(text):
    assert simhash.fingerprint(text) == brute.simhash(text)


def test_fingerprints_of_long_texts_are_counted_in_chunks(monkeypatch):
    text = prose(2, 1_000)
    monkeypatch.setattr(simhash, "CHUNK", 7)
    assert simhash.fingerprint(text) == brute.simhash(text)


def test_allocated_thresholds_follow_the_pigeonhole():
    rng = np.random.default_rng(0)
    sample = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    for parts in (2, 3, 4):
        groups = simhash.group_bits(sample, parts)
        assert sorted(b for g in groups for b in g) == list(range(64))
        _, thresholds = simhash.allocate(sample, groups, 3, 10**6)
        assert sum(t + 1 for t in thresholds) == 4
        masks = simhash._masks(groups, thresholds)
        for _ in range(200):
            flips = rng.choice(64, rng.integers(0, 4), replace=False)
            changed = sum(1 << int(b) for b in flips)
            assert any(changed & keep == 0 for _, keep in masks)


def test_correlated_bits_share_a_partition():
    rng = np.random.default_rng(1)
    bits = rng.integers(0, 2, (500, 64), dtype=np.uint8)
    bits[:, 40] = bits[:, 3]
    sample = np.packbits(bits, axis=1, bitorder="little").view(np.uint64)[:, 0]
    assert any({3, 40} <= set(g) for g in simhash.group_bits(sample, 4))


@pytest.mark.parametrize("block", [4_096, 5])
def test_near_links_connect_what_brute_force_connects(spark, monkeypatch, block):
    monkeypatch.setattr(simhash, "BLOCK", block)
    rng = random.Random(block)
    prints = [rng.getrandbits(64) for _ in range(60)]
    centre = rng.getrandbits(64)
    prints += [centre ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(80)]
    for p in prints[:20]:
        for n in (1, 2, 3, 4, 5):
            prints.append(p ^ sum(1 << b for b in rng.sample(range(64), n)))
    prints = sorted(set(prints))
    pairs = [(i, j) for i in range(len(prints)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 3]
    signed = [(p - (1 << 64) if p >> 63 else p,) for p in prints]
    links = simhash.near_links(spark.createDataFrame(signed, "fp long")).collect()
    place = {s[0]: i for i, s in enumerate(signed)}
    own = [(place[r.u], place[r.v]) for r in links]
    assert all((prints[i] ^ prints[j]).bit_count() <= 3 for i, j in own)
    assert brute.classes(len(prints), own) == brute.classes(len(prints), pairs)


def test_simhash_components_of_rows(spark):
    base = prose(3, 300)
    texts = [base, base, base.replace("w1 ", "w2 ", 1), base.upper(), prose(4, 300), None, "", " \n", "two words", "two words"]
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(None, base, "x"), (1, base, "x"), (None, "alone and nameless here", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    out = simhash.simhash_components(docs).collect()
    prints = [brute.simhash(t) for _, t, _ in rows]
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 3]
    place = brute.classes(len(rows), pairs)
    least = {c: min((r[0] for r, p in zip(rows, place, strict=True) if p == c and r[0] is not None), default=None) for c in place}
    expected = sorted((repr(r[0]), p, repr(least[c])) for r, p, c in zip(rows, prints, place, strict=True))
    assert sorted((repr(r.doc_id), r.fp % (1 << 64), repr(r.component_id)) for r in out) == expected
    assert simhash.simhash_components(docs.where("false")).collect() == []
    assert [r.component_id for r in simhash.simhash_components(docs.where("doc_id = 4")).collect()] == [4]


# Grid join


def vectors_with_groups(seed, groups, size, dims=16):
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(groups):
        centre = rng.normal(size=dims)
        out += [centre + rng.normal(scale=rng.choice([0.02, 0.25, 0.4]), size=dims) for _ in range(rng.integers(1, size))]
    return [v.astype(np.float32).tolist() for v in out]


def expected_vectors(rows, least=0.93):
    units = []
    for _, v, label in rows:
        sound = label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)
        units.append(np.array(v, float) / np.linalg.norm(np.array(v, float)) if sound else None)
    pairs = [
        (i, j) for i in range(len(rows)) for j in range(i)
        if units[i] is not None and units[j] is not None and rows[i][2] == rows[j][2] and len(units[i]) == len(units[j])
        and units[i] @ units[j] >= least
    ]
    counts = collections.Counter(x for pair in pairs for x in pair)
    place = brute.classes(len(rows), pairs)
    out = []
    for i, (own, *_) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if place[j] == place[i] and rows[j][0] is not None]
        out.append((repr(own), counts[i], repr(min(ids, default=None)), own == min(ids, default=None)))
    return sorted(out), len(pairs)


@pytest.mark.parametrize(("block", "interval"), [(512, 128), (16, 4)])
def test_near_vectors_equal_brute_force(spark, monkeypatch, block, interval):
    monkeypatch.setattr(grid_join, "BLOCK", block)
    monkeypatch.setattr(grid_join, "INTERVAL", interval)
    vectors = vectors_with_groups(5, 25, 25)
    rows = [(i, v, i % 2) for i, v in enumerate(vectors)]
    rows += [(1_000 + i, vectors[3], 1) for i in range(30)]
    rows += [(2_000, [2 * x for x in vectors[3]], 1), (2_001, None, 1), (2_002, [0.0] * 16, 1), (2_003, vectors[3], None)]
    rows += [(2_004, [float("nan"), *vectors[3][1:]], 1), (2_005, [None, *vectors[3][1:]], 1), (2_006, [], 1)]
    rows += [(2_007, [float("inf"), *vectors[3][1:]], 1), (2_008, [1.0, 2.0], 1), (2_009, [1.0, 2.0], 1), (None, vectors[3], 1)]
    rows += [(1_000, vectors[3], 1), (2_010, [-0.0, 1.0], 1), (2_011, [0.0, 1.0], 1)]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, rep string")
    out = grid_join.near_vectors(frame.repartition(3)).collect()
    expected, links = expected_vectors(rows)
    assert links > 500
    assert sorted((repr(r.vec_id), r.n_links, repr(r.component_id), r.kept) for r in out) == expected


def test_no_vectors_and_no_sound_ones(spark):
    frame = spark.createDataFrame([(1, None, 1), (2, [0.0], 1)], "vec_id long, embedding array<float>, label int")
    assert sorted(map(tuple, grid_join.near_vectors(frame).collect())) == [(1, 0, 1, True), (2, 0, 2, True)]
    assert grid_join.near_vectors(frame.where("false")).collect() == []


def test_distant_blocks_are_skipped(monkeypatch):
    rng = np.random.default_rng(0)
    a = np.abs(rng.normal(size=(300, 8)))
    a /= np.linalg.norm(a, axis=1)[:, None]
    mean, axes = grid_join.principal(np.concatenate([a, -a]), 4)
    join = grid_join.PairJoin(0.93, axes, mean)
    visits = []
    inner = join._join
    monkeypatch.setattr(join, "_join", lambda *x: visits.append(x) or inner(*x))
    assert join(a, -a, False) == [] and len(visits) == 1


# Sharding


@settings(max_examples=60, deadline=None)
@given(sizes=st.lists(st.integers(1, 100), max_size=60), capacity=st.integers(100, 150))
def test_best_fit_decreasing_follows_its_rule(sizes, capacity):
    placed = sharding.best_fit_decreasing(list(enumerate(sizes)), capacity)
    rooms = []
    for name, size in sorted(enumerate(sizes), key=lambda x: (-x[1], str(x[0]))):
        fitting = [(room, i) for i, room in enumerate(rooms) if room >= size]
        if fitting:
            expected = min(fitting)[1]
        else:
            expected = len(rooms)
            rooms.append(capacity)
        assert placed[name] == expected
        rooms[expected] -= size


def test_an_item_above_the_capacity_is_refused():
    with pytest.raises(ValueError, match="exceeds"):
        sharding.best_fit_decreasing([("a", 5)], 4)


def test_bins_are_level():
    rng = random.Random(0)
    items = [(i, int(rng.paretovariate(1.5) * 100)) for i in range(3_000)]
    placed = sharding.level_bins(items, 16)
    loads = collections.Counter()
    for name, size in items:
        loads[placed[name]] += size
    assert set(loads) == set(range(16)) and max(loads.values()) - min(loads.values()) <= 0.01 * max(loads.values())


def test_a_giant_group_has_a_bin_alone():
    placed = sharding.level_bins([("giant", 10_000), *((i, 10) for i in range(150))], 16)
    others = collections.Counter(b for name, b in placed.items() if name != "giant")
    assert placed["giant"] not in others and set(others.values()) == {10}


def test_shards_of_rows(spark):
    texts = [prose(i, random.Random(i).randrange(1, 80)) for i in range(600)] + ["copy"] * 200 + [None, "", "", "é"]
    rows = [(i, t, 5) for i, t in enumerate(texts)] + [(None, "nameless", 5), (0, texts[0], 5), (0, texts[0], 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard int").repartition(5)
    out = sharding.shard_by_bytes(docs, 16).collect()
    assert sorted((repr(r.doc_id), r.size) for r in out) == sorted((repr(i), len((t or "").encode()) + 1) for i, t, _ in rows)
    slots, loads, homes = collections.defaultdict(list), collections.Counter(), collections.defaultdict(set)
    for r in out:
        slots[r.shard].append(r.slot)
        loads[r.shard] += r.size
        homes[r.text_crc32].add(r.shard)
        assert r.law == "bytes" and r.grown_shard is None
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) == set(range(16))
    assert all(len(h) == 1 for h in homes.values())
    assert max(loads.values()) - min(loads.values()) <= 0.02 * max(loads.values())
    assert sharding.shard_by_bytes(docs.where("false"), 16).collect() == []


# Decontamination

ITEMS = [(1, prose(50, 40)), (2, prose(51, 200)), (3, "Only four short words"), (4, ""), (5, None), (None, prose(52, 30)), (6, prose(50, 40)), (6, "just")]


def test_contained_items_equal_brute_force(spark):
    half, most = prose(51, 200).split(), prose(50, 40).split()
    docs = [
        (1, prose(60, 500) + " " + ITEMS[0][1].upper() + "\n" + prose(61, 500)),
        (2, " ".join(half[:100]) + " gap " + " ".join(half[100:])),
        (3, " ".join(half[:150])),
        (4, " ".join(most[:37])),
        (5, "we say ONLY  four\tshort words here, just once"),
        (6, None), (7, ""), (8, "a b"), (None, ITEMS[0][1]), (9, "only four short"), (9, ITEMS[0][1]), (9, ITEMS[0][1]),
        (10, prose(70, 60_000) + " " + ITEMS[1][1]),
    ]
    frame = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    out = decontaminate.contaminated(frame, bench).collect()
    expected = brute.contained(docs, [x for x in ITEMS if None not in x])
    assert sorted(((r.doc_id, r.item_id, r.n_shingles, r.n_shared) for r in out), key=repr) == expected
    assert len(expected) > 8


def test_several_passes_find_the_same(spark, monkeypatch):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([ITEMS[0][1], ITEMS[1][1], "just"])], "doc_id long, text string")
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    once = sorted(map(tuple, decontaminate.contaminated(docs, bench).collect()))
    monkeypatch.setattr(decontaminate, "PASS_BYTES", 300)
    assert sorted(map(tuple, decontaminate.contaminated(docs, bench).collect())) == once != []


def test_no_documents_or_items(spark):
    docs = spark.createDataFrame([(1, "some text of five words")], "doc_id long, text string")
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert decontaminate.contaminated(docs.where("false"), bench).collect() == []
    assert decontaminate.contaminated(docs, bench.where("false")).collect() == []


@settings(max_examples=150, deadline=None)
@given(seed=st.integers(0, 10**6), size=st.integers(1, 60), share=st.floats(0, 1))
def test_minima_lose_no_contained_item(seed, size, share):
    rng = random.Random(seed)
    item = [f"w{rng.randrange(30)}" for _ in range(size)]
    parts = [item[i : i + rng.randrange(5, 20)] for i in range(size) if rng.random() < share]
    text = " . ".join(" ".join(p) for p in parts)
    known = decontaminate.Benchmark([(1, " ".join(item))], 0.8, 5)
    found = known.search(text, decontaminate.Hashes())
    assert [(0, h["item_id"], h["n_shingles"], h["n_shared"]) for h in found] == brute.contained([(0, text)], [(1, " ".join(item))])
