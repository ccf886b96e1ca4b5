"""Targets, subset sums and the chosen rows."""

import itertools
import random
from collections import Counter, defaultdict

from inkprint.llm import mixing


def test_targets_share_the_whole_and_stop_at_the_limit():
    found = mixing.targets([("b", 100), ("a", 1000), (None, 10), ("c", 500)])
    assert abs(sum(found.values()) - 1610) < 1e-6
    assert found[None] == 30 and found["b"] == 300  # weights a 5, b 2, c 1, null 5
    assert abs(found["a"] / found["c"] - 5) < 1e-9
    assert mixing.targets([]) == {} and mixing.targets([("a", 0)]) == {"a": 0.0}


def test_sums_are_as_near_as_brute_force_can_make_them():
    rng = random.Random(11)
    for _ in range(200):
        counts = {rng.randint(1, 30): rng.randint(1, 3) for _ in range(4)}
        items = [n for n, c in counts.items() for _ in range(c)]
        sums = {sum(s) for k in range(len(items) + 1) for s in itertools.combinations(items, k)}
        budget = rng.randint(0, sum(items) + 5)
        taken = mixing.fit_lengths(counts, budget)
        assert all(0 < k <= counts[n] for n, k in taken.items())
        made = sum(n * k for n, k in taken.items())
        even = {n: c * budget // sum(items) for n, c in counts.items()} if budget < sum(items) else {}
        reachable = {s for s in sums if s <= budget}
        assert made in sums
        if not even or not any(even.values()):
            assert budget - made <= budget - max(reachable) or made - budget < budget - max(reachable)
        assert abs(made - budget) <= max(counts)


def test_long_lengths_and_a_short_reach():
    counts = {1: 5, 70_000: 3, 3_000_000: 2, 17: 400}
    for budget in (1, 16, 5_000_000, 6_200_000):
        made = sum(n * k for n, k in mixing.fit_lengths(counts, budget, reach=1000).items())
        assert abs(made - budget) <= 3_000_000


def test_mix_and_mixed_rows_agree(documents):
    rows = mixing.mix(documents).collect()
    assert len(rows) == documents.count()
    taken, by = Counter(), defaultdict(int)
    for r in rows:
        assert r["taken"] == r["copies"] * r["size"] and r["copies"] <= 3
        taken[r["doc_id"]] += r["copies"]
        by[r["source"], r["target"], r["source_size"]] += r["taken"]
    for (_, target, size), n in by.items():
        assert abs(n - target) <= max(40, 0.02 * target) and target <= 3 * size
    repeated = Counter(r["doc_id"] for r in mixing.mixed_rows(documents).collect())
    assert repeated == +taken
    again = {(r["doc_id"], r["copies"]) for r in mixing.mix(documents.repartition(7)).collect()}
    assert again == {(r["doc_id"], r["copies"]) for r in rows}


def test_rows_of_all_kinds(odd_docs):
    rows = mixing.mix(odd_docs, bins=4).collect()
    assert len(rows) == odd_docs.count()
    size = defaultdict(int)
    for r in rows:
        size[r["source"]] += r["size"]
    assert all(r["source_size"] == size[r["source"]] for r in rows)
    assert mixing.mixed_rows(odd_docs).columns == odd_docs.columns
    assert mixing.mix(odd_docs.where("false")).count() == 0
