import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from folio.llm import components as C
from folio.llm import jaccard_join as J
from folio.llm.components import spread_join
from folio.llm.set_relations import Group, least_overlap, links, ranges
from tests.llm.fixtures import awkward, families, table
from tests.llm.test_dedup_and_join import _components


def _near(rng, count, length=60, changed=2):
    """Texts of one passage with some words replaced; most pairs of them don't link."""
    base = [f"w{i}" for i in range(length)]
    rows = []
    for k in range(count):
        text = list(base)
        for _ in range(changed):
            text[rng.randrange(length)] = f"e{rng.randrange(1_000_000)}"
        rows.append((k, " ".join(text)))
    return rows


def _group(sets, sides=None):
    df = Counter(t for s in sets for t in s)
    shared = [np.array(sorted((t for t in s if df[t] > 1), key=lambda t: (df[t], t)), dtype=np.uint64) for s in sets]
    n = np.array([len(s) for s in sets])
    key = np.arange(len(sets)) + 100
    return Group(key, n, n - np.array([len(s) for s in shared]), shared, key.copy(), np.full(len(sets), 2) if sides is None else sides)


def _roots(keys, edges):
    parent = {k: k for k in keys}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in edges:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    return {k: find(k) for k in keys}


@pytest.mark.parametrize("seed", range(60))
def test_links_of_a_group_are_brute_force(seed):
    rng = random.Random(seed)
    bases = [{rng.randrange(300) for _ in range(rng.randrange(1, 60))} for _ in range(rng.randrange(1, 4))]
    sets = []
    for _ in range(rng.randrange(2, 150 if seed % 10 == 0 else 40)):
        s = set(rng.choice(bases))
        for _ in range(rng.randrange(0, 12)):
            if s and rng.random() < 0.5:
                s.discard(rng.choice(sorted(s)))
            else:
                s.add(rng.randrange(100_000) if rng.random() < 0.5 else rng.randrange(300))
        if s and s not in sets:
            sets.append(s)
    sides = np.array([rng.randrange(3) for _ in sets]) if seed % 2 else np.full(len(sets), 2)
    percent = rng.choice([60, 75, 90])
    true = {(i + 100, j + 100) for i in range(len(sets)) for j in range(len(sets)) if i != j and sides[i] != 0 and sides[j] != 1 and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])}
    a, b = links(_group(sets, sides), percent)
    found = list(zip(a.tolist(), b.tolist(), strict=True))
    keys = range(100, 100 + len(sets))
    assert set(found) <= true and len(found) < len(sets)
    assert _roots(keys, found) == _roots(keys, true)


def test_bounds_and_ranges():
    assert ranges(np.array([5, 9, 2]), np.array([2, 0, 3])).tolist() == [5, 6, 2, 3, 4]
    assert [least_overlap(a, b, 75) for a, b in ((4, 4), (10, 8), (1, 1))] == [4, 8, 1]


@pytest.mark.parametrize("seed", [4, 5])
def test_large_groups_in_blocks_are_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = awkward() + families(rng, groups=8, size=30) + [(10_000 + i, t) for i, t in _near(rng, 60)] + [(20_000 + i, t) for i, t in _near(rng, 40, changed=1)]
    members, _ = J.jaccard_components(table(spark, rows).repartition(3), block=7)
    first = C.smallest_of(members, "label", "doc_id")
    got = members.join(first, "label", "left").select("doc_id", "n", F.when(F.col("n") > 0, F.coalesce("first", "doc_id")).otherwise(F.col("doc_id")).alias("c"))
    assert sorted((str(r.doc_id), r.n, str(r.c)) for r in got.collect()) == _components(rows)


def test_rows_of_every_step_grow_no_faster_than_the_group(spark, monkeypatch):
    rows: dict[str, int] = {}
    real = J.materialise

    def counting(df, kind):
        out = real(df, kind)
        rows[kind] = max(rows.get(kind, 0), out.count())
        return out

    monkeypatch.setattr(J, "materialise", counting)
    monkeypatch.setattr(C, "materialise", counting)
    dealt = J._Join.compare

    def compare(self, pairs):
        rows["dealt"] = max(rows.get("dealt", 0), pairs.count())
        return dealt(self, pairs)

    monkeypatch.setattr(J._Join, "compare", compare)
    seen = []
    for count in (200, 400, 800):
        rows.clear()
        J.jaccard_components(table(spark, _near(random.Random(3), count)))
        seen.append(dict(rows))
    for kind in seen[0]:
        assert seen[2][kind] <= 6 * max(seen[0][kind], 50), (kind, seen)
        assert seen[2][kind] <= 40 * 800


def test_joins_on_hot_keys_lose_nothing(spark):
    left = spark.createDataFrame([(k % 3 if k < 90 else k, k) for k in range(120)] + [(None, -1)], "key long, x long")
    right = spark.createDataFrame([(0, "a"), (2, "b"), (95, "c"), (500, "d")], "key long, y string")
    for how in ("left", "inner"):
        assert sorted(map(str, spread_join(left, right, "key", how=how).collect())) == sorted(map(str, left.join(right, "key", how).collect()))
