import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from folio.llm import exact_dedup as X
from folio.llm import shingles
from folio.llm.components import contract
from folio.llm.jaccard_join import _spread, _squeezed, jaccard_components, jaccard_join
from tests.llm.fixtures import awkward, families, table


def _groups(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", text or "")].append(doc_id)
    return groups


def test_exact_dedup_is_brute_force(spark):
    rows = awkward()
    got = X.exact_dedup(table(spark, rows), salts=3).collect()
    groups = _groups(rows)
    keep = {body: min((i for i in ids if i is not None), default=None) for body, ids in groups.items()}
    assert len(got) == len(rows)
    expected = sorted((str(i), str(keep[b]), len(ids)) for b, ids in groups.items() for i in ids)
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size) for r in got) == expected
    assert sum(r.kept for r in got) == len(groups)
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_exact_dedup_joins_by_text_where_digests_clash(spark):
    rows = [(1, "a b"), (2, "a  b"), (3, "c"), (4, "c"), (5, "d"), (1, "a b")]
    docs = table(spark, rows)
    groups = X.text_groups(docs, salts=2).select("sha", "keep_id", "group_size")
    clashes = groups.filter("keep_id IN (1, 3)").select("sha")
    got = X._joined_by_text(docs, groups, clashes, "doc_id", "text", 2).collect()
    assert sorted((r.id, r.keep_id, r.group_size, r.copies) for r in got) == [(1, 1, 3, 2), (2, 1, 3, 1), (3, 3, 2, 1), (4, 3, 2, 1), (5, 5, 1, 1)]


def test_kept_documents_keep_every_column_and_each_text_once(spark):
    rows = awkward()
    docs = table(spark, rows)
    kept = X.kept_documents(docs)
    assert kept.columns == docs.columns
    bodies = [re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "") for r in kept.collect()]
    assert sorted(bodies) == sorted(_groups(rows))


def test_exact_dedup_of_nothing(spark):
    assert X.exact_dedup(table(spark, [])).count() == 0


_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(_LOWER))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def _components(rows):
    sets = [_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j]:
                o = len(sets[i] & sets[j])
                if 100 * o >= 75 * (len(sets[i]) + len(sets[j]) - o):
                    parent[find(i)] = find(j)
    smallest = defaultdict(lambda: None)
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            k = find(i)
            smallest[k] = doc_id if smallest[k] is None else min(smallest[k], doc_id)
    return sorted((str(d), len(s), str(smallest[find(i)] if s else d)) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True)))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_jaccard_join_is_brute_force(spark, seed):
    rows = awkward() + families(random.Random(seed), groups=25)
    got = jaccard_join(table(spark, rows).repartition(3))
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got.collect()) == _components(rows)


def test_jaccard_join_of_a_large_group_compares_few_pairs(spark):
    rng = random.Random(9)
    base = [f"w{i}" for i in range(80)]
    rows = []
    for k in range(400):
        text = list(base)
        text[rng.randrange(80)] = f"e{k}"
        rows.append((k, " ".join(text)))
    members, pairs = jaccard_components(table(spark, rows))
    assert members.select("label").distinct().count() == 1
    assert pairs.count() < 400 * 20


def test_jaccard_join_of_nothing(spark):
    assert jaccard_join(table(spark, [])).count() == 0
    assert jaccard_join(table(spark, [(1, None), (2, " ")])).select("component_id").orderBy("component_id").collect() == [(1,), (2,)]


def test_shingles_tell_words_apart():
    assert len(shingles.shingle_set("a b c d e f")) == 2
    assert set(shingles.shingle_set("A B c d e")) == set(shingles.shingle_set("a b\tc \n d e"))
    assert set(shingles.shingle_set("ab c d e f")).isdisjoint(shingles.shingle_set("a bc d e f"))
    assert set(shingles.shingle_set("Ä b c d e")).isdisjoint(shingles.shingle_set("ä b c d e"))
    assert len(shingles.shingle_set("a b")) == 1 and len(shingles.shingle_set(" ")) == 0


def test_squeezed_shingles_come_back():
    import numpy as np

    rng = np.random.default_rng(3)
    for n in (1, 5, 1000, 200_000):
        values = np.sort(rng.integers(0, 2**64, n, dtype=np.uint64))
        assert (_spread(_squeezed(values)) == values).all()


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, k) for k in range(101, 160)] + [(200, 201)]
    labels = contract(spark.createDataFrame(edges, "u long, v long")).collect()
    assert {r.node: r.label for r in labels} == {**dict.fromkeys(range(51), 0), **dict.fromkeys(range(100, 160), 100), 200: 200, 201: 200}
    more = contract(spark.createDataFrame([(50, 160), (201, 7)], "u long, v long"), spark.createDataFrame(labels, "node long, label long"))
    assert {r.label for r in more.filter(F.col("node").isin(3, 50, 160, 200, 201)).collect()} == {0}
