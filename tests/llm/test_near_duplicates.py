import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from punctual.llm import neardup
from punctual.llm.components import components


def runs(text):
    words = text.split()
    return Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4)) or (Counter([tuple(words)]) if words else Counter())


def brute_classes(texts):
    """Classes by comparing every pair of texts with the exact weights."""
    sets = {i: runs(x or "") for i, x in texts.items()}
    n = len(texts)
    df = Counter(r for s in sets.values() for r in s)

    def weight(run, tf):
        return tf * (1 + math.log(1 / max(df[run] / n, neardup.FLOOR)) / math.log(1 / neardup.FLOOR))

    parent = {i: i for i in texts}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids, similar = sorted(texts), {}
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = sets[a].keys() | sets[b].keys()
                low = sum(min(weight(r, sets[a][r]), weight(r, sets[b][r])) for r in both)
                high = sum(max(weight(r, sets[a][r]), weight(r, sets[b][r])) for r in both)
                similar[a, b] = low / high
                if low / high >= neardup.SIMILARITY:
                    parent[max(find(a), find(b))] = min(find(a), find(b))
    return {i: find(i) for i in ids}, similar


def found(frame):
    return {r.doc_id: r.class_id for r in neardup.near_duplicates(frame).collect()}


def test_classes_equal_brute_force_on_edited_copies(spark):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = [rng.choice(vocabulary) for _ in range(30)]
    texts, number = {}, 0
    for _ in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.choice((3, 20, 120)))] + passage
        for _ in range(rng.choice((1, 2, 6))):
            words = list(base)
            for _ in range(rng.choice((0, 1, 1, 2, 5))):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            texts[number] = " ".join(words)
            number += 1
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    want, similar = brute_classes(texts)
    assert found(frame) == want
    assert 0 < sum(0.5 < s < 0.8 for s in similar.values())


def test_a_group_of_hundreds_meets_leaders_and_rare_runs(spark, monkeypatch):
    """Many copies with different edits of one text: more than a band compares, nobody lost."""
    rng = random.Random(9)
    base = [f"b{i}" for i in range(60)]
    texts = {}
    for number in range(150):
        words = list(base)
        for _ in range(rng.choice((0, 0, 1, 1, 2))):
            words[rng.randrange(len(words))] = f"e{rng.randrange(1000)}"
        texts[number] = " ".join(words)
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    want, similar = brute_classes(texts)
    got = found(frame)
    lost = [pair for pair, s in similar.items() if s >= neardup.SIMILARITY and got[pair[0]] != got[pair[1]]]
    wrong = [i for i in got if want[i] != want[got[i]]]
    assert not wrong and not lost


def test_odd_rows(odd):
    rows = [(r.doc_id, r.class_id, r.class_size) for r in neardup.near_duplicates(odd).collect()]
    assert sorted(rows, key=repr) == sorted(
        [
            (1, 1, 1), (2, 2, 1), (3, 3, 1), (4, 4, 1), (5, 5, 1), (6, 6, 4), (7, 6, 4), (7, 6, 4), (None, 6, 4),
            (None, None, 1), (9, 9, 1), (9, 9, 1), (-10, -10, 1), (2**60, 2**60, 1),
        ],
        key=repr,
    )


def test_one_document_of_each_class_stays(odd, nothing):
    kept = neardup.deduplicated(odd)
    assert kept.columns == odd.columns
    rows = kept.collect()
    assert sorted((r.doc_id for r in rows), key=repr) == sorted([1, 2, 3, 4, 5, 6, None, 9, 9, -10, 2**60], key=repr)
    assert {r.text for r in rows if r.doc_id == 9} == {"first of two texts with one id", "second of two texts with one id"}
    assert [r.text for r in rows if r.doc_id is None] == ["a text without an id that nobody else has at all"]
    assert neardup.deduplicated(nothing).count() == 0 == neardup.near_duplicates(nothing).count()


def test_a_third_of_the_rows_under_one_id_loses_no_text(spark):
    own = [(5, " ".join(f"t{i}x{j}" for j in range(12))) for i in range(40)]
    copies = [(None, own[0][1]), (3, own[0][1]), (5, own[1][1]), (None, "no id and no other row like it at all"), (7, None), (7, "")]
    kept = neardup.deduplicated(spark.createDataFrame(own + copies + [(7, None)], "doc_id long, text string").repartition(3))
    want = [(3, own[0][1])] + own[1:] + [copies[3], (7, None), (7, "")]
    assert sorted(map(tuple, kept.collect()), key=repr) == sorted(want, key=repr)


def test_counts_beyond_16_bits_are_not_cut(spark):
    """200,000 repeats of one word shared, 20,000 own words each: similarity 0.83, and 0.62 with cut counts."""
    texts = ["w " * 200_000 + " ".join(f"{c}{i}" for i in range(20_000)) for c in "ab"]
    got = found(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert got == {0: 0, 1: 0}


def test_samples_agree_as_often_as_the_weighted_similarity():
    import numpy as np

    rng = np.random.default_rng(3)
    ids = rng.integers(1, 1 << 48, 300, dtype=np.uint64)
    a, b = np.sort(ids[:220]), np.sort(ids[80:])
    weight = {int(i): float(w) for i, w in zip(ids, rng.uniform(1, 4, 300))}
    shared = sum(weight[i] for i in set(map(int, a)) & set(map(int, b)))
    want = shared / sum(weight.values())
    agree = total = 0
    for shift in range(60):
        mixed = [(x + np.uint64(shift * 7919)) & np.uint64((1 << 48) - 1) for x in (a, b)]
        drawn = [neardup.weighted_samples(m, np.array([weight[int(i)] for i in x]), np.array([0]))[0] for m, x in zip(mixed, (a, b))]
        agree += int((drawn[0] == drawn[1]).sum())
        total += neardup.SAMPLES
    assert abs(agree / total - want) < 0.05


@pytest.mark.parametrize("n", [0, 1, 40])
def test_components_of_paths_and_stars(spark, n):
    links = spark.range(n).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).union(
        spark.range(n).select(F.lit(1000).alias("a"), (F.col("id") + 1001).alias("b"))
    )
    got = {r.node: r.root for r in components(links).collect()}
    want = {i: 0 for i in range(n + 1)} | {1000 + i: 1000 for i in range(n + 1)} if n else {}
    assert got == want


def few_edits_of_many(n, seed):
    """Texts of 120 words with four of 24 edits each, a choice per text: alike when three edits are the same, and no run is rare."""
    rng = random.Random(seed)
    chosen = set()
    while len(chosen) < n:
        chosen.add(tuple(sorted(rng.sample(range(24), 4))))
    return [" ".join(f"e{i}" if i % 5 == 2 and i // 5 in edits else f"b{i}" for i in range(120)) for edits in sorted(chosen)]


def test_no_pair_of_a_crowded_bucket_is_lost(spark):
    """Similar texts that lead none of the buckets they share are compared all the same."""
    import numpy as np

    texts = few_edits_of_many(300, 1)
    # Every word has its place, so runs are equal where they stand in the same place.
    held = np.array([[hash(r) for r in runs(x)] for x in texts])
    share = np.array([[(held[:, j] == x).mean() for j, x in enumerate(row)] for row in held])
    weight = 1 + np.log(1 / np.maximum(share, neardup.FLOOR)) / np.log(1 / neardup.FLOOR)
    shared = np.stack([((held == held[i]) * weight[i]).sum(axis=1) for i in range(len(texts))])
    total = weight.sum(axis=1)
    similar = shared / (total + total[:, None] - shared) >= neardup.SIMILARITY
    got = found(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3))
    classes = np.array([got[i] for i in range(len(texts))])
    apart = similar & (classes != classes[:, None])
    assert not apart.any(), f"{apart.sum() // 2} pairs lost"
    assert all(similar[i, classes == classes[i]].sum() > 1 for i in range(len(texts)) if (classes == classes[i]).sum() > 1)
    assert 300 < similar.sum() < 1500 and 10 < len(set(classes)) < 200
