import random
import re
from collections import Counter

import pytest

from folio.llm import license_scan as L
from folio.llm import quality_rules as Q
from folio.llm.license_rules import BASE, CONFIDENCE, compiled, rules
from tests.llm.fixtures import awkward, table

_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

NOTICES = [
    "Licensed under the Apache License, Version 2.0.", "Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3.", "Licensed under CC BY-NC 4.0.",
    "SPDX-License-Identifier: BSD-3-Clause", "MIT license mit LICENSE mit-license", "the mit licenses", "Permission is hereby granted, free of charge, to any person obtaining a copy",
    "Creative Commons Attribution-ShareAlike 4.0", "all rights reserved", "under the Mozilla Public License 2.0 or the Apache license", "general public license general public licence",
    "dedicated to the public domain", "Kelvin K licenſe mit license", "GNU LGPL v2.1 and GPLv3", "smith license", "mit\x00license",
]


def _brute(text):
    table_ = rules()
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(_LOWER))
    body = "".join(f" {i}#{w} " for i, w in enumerate(words))
    low = (text or "").lower()
    found = []
    for rank, r in enumerate(table_):
        if r.keyword in low:
            for m in re.finditer(compiled(r.pattern), body):
                start = int(m[0].split("#")[0])
                found.append((start, -(start + m[0].count("#")), r.tier, rank, r.label, r.base))
    found.sort()
    kept = [d for k, d in enumerate(found) if not any(e[2] <= d[2] and e[0] <= d[0] and e[1] <= d[1] for e in found[:k])]
    base = [d for d in found if d[5]]
    return (
        len(words), len(base), min((d[0] for d in base), default=None), max((d[0] for d in base), default=None), ",".join(sorted({d[4] for d in base})),
        ",".join(sorted({d[4] for d in kept + base})), max((CONFIDENCE[d[2]] for d in kept), default=0.0),
    )


def test_licence_scan_is_brute_force(spark):
    rng = random.Random(4)
    rows = [*awkward(), *enumerate(NOTICES, 50)]
    rows += [(200 + k, " ".join(rng.sample(NOTICES, 4))) for k in range(20)]
    got = L.license_scan(table(spark, rows)).drop("detections").collect()
    assert sorted((tuple(r) for r in got), key=str) == sorted(((i, *_brute(t)) for i, t in rows), key=str)
    assert L.license_scan(table(spark, [])).count() == 0


def test_rules_are_many_gated_and_ordered():
    table_ = rules()
    assert len(table_) > 300 and table_[: len(BASE)] == list(BASE)
    gate = L.gate(table_)
    for r in table_:
        assert any(g in r.keyword or "licen" in r.pattern for g in gate)
        re.compile(compiled(r.pattern))


def test_specific_detections_hide_general_ones(spark):
    rows = list(enumerate(NOTICES[:5]))
    got = {r.doc_id: r.labels for r in L.license_scan(table(spark, rows)).collect()}
    assert got == {0: "apache,apache-2.0", 1: "mit", 2: "gpl,gpl-3.0", 3: "cc-by-nc-4.0", 4: "bsd-3-clause"}


def _measures(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {i + k for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for k in range(5)}
    return {
        "n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)), "n_lines": len(lines), "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(covered), "n_echo_words": sum(a == b for a, b in zip(w, w[1:], strict=False)), "n_letters": sum(c.isalpha() for c in text),
    }


def test_quality_ledger_is_brute_force(spark):
    rng = random.Random(8)
    rows = awkward()
    for k in range(40):
        w = [rng.choice("abcdefg") * rng.randrange(1, 3) for _ in range(rng.randrange(3, 60))]
        rows.append((300 + k, "".join(x + rng.choice([" ", "\n", " # ", "\t"]) for x in w)))
    rows.append((400, "a b c d e f g h i j k l\n" * 40))
    got = Q.ledger(table(spark, rows)).collect()
    expected = []
    for i, t in rows:
        m = _measures(t)
        m["failed"] = sum(bit for rule, bit in zip(Q.RULES, Q.BIT.values(), strict=True) if eval(re.sub(r"(?<![<>])=", "==", rule.fails), {}, m))
        expected.append((i, *m.values()))
    assert sorted((tuple(r) for r in got), key=str) == sorted(expected, key=str)


def test_policies_and_ablation_read_bits(spark):
    rows = [(1, "one two"), (2, " ".join(f"word{i}" for i in range(30))), (3, " ".join(f"word{i}###" for i in range(30))), (4, "a a a a a a a a a a a a a a a a"), (5, "")]
    ledger = Q.ledger(table(spark, rows))
    kept = {r.doc_id for r in ledger.filter(Q.passes("web", 2)).collect()}
    assert kept == {2}
    out = {r.rule: (r.n_failed, r.n_only) for r in Q.ablation(ledger, "web", 1).collect()}
    assert out == {"few_words": (2, 2), "repeated_windows": (1, 1), "symbols": (1, 1), "repeated_lines": (0, 0)}
    assert Q.ledger(table(spark, [])).count() == 0


@pytest.mark.parametrize("policy", list(Q.POLICIES))
def test_policies_name_known_rules(policy):
    assert set(Q.POLICIES[policy]) <= set(Q.BIT) and Q.mask(*policy) > 0
