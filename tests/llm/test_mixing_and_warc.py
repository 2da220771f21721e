import gzip
import random
import re

import pytest

from folio.llm import mixing as M
from folio.llm import warc as W
from tests.llm.fixtures import awkward, table


def _targets(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    order = sorted(s for s in sizes if s is not None) + [None] * (None in sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, free, target = share * sum(sizes.values()), set(sizes), {}
    while free:
        left, weight = total - sum(target.values()), sum(w[s] for s in free)
        above = [s for s in free if left * w[s] / weight > most * sizes[s]]
        if not above:
            target |= {s: left * w[s] / weight for s in free}
            break
        for s in above:
            target[s] = most * sizes[s]
            free.discard(s)
    return target


@pytest.mark.parametrize("seed", [1, 2, 3, 4])
def test_sources_come_to_their_targets(spark, seed):
    rng = random.Random(seed)
    names = ["b", "a", "é", "Z", "", None, "hot"]
    rows = [(k, rng.choice([0, 1, 3, 10, 200, 900]), "hot" if rng.random() < 0.4 else rng.choice(names)) for k in range(3000)]
    rows += [(None, 5, "a"), (7, 3, "a"), (7, 3, "a")]
    sized = spark.createDataFrame([(i, s, n) for i, n, s in rows], "doc_id long, source string, size long")
    got = M.mix_copies(sized, bucket_rows=200, fan_in=4).collect()
    again = M.mix_copies(sized.repartition(5), bucket_rows=200, fan_in=4).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert sorted(str((r.doc_id, r.source, r.size)) for r in got) == sorted(str((i, s, n)) for i, n, s in rows)
    sizes = {}
    for _, n, s in rows:
        sizes[s] = sizes.get(s, 0) + n
    target = _targets(sizes)
    taken = dict.fromkeys(sizes, 0)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(target[r.source])
        assert 0 <= r.copies <= 2 and (r.size == 0 or abs(r.copies - r.target / r.source_size) < 1 + 1e-9)
        taken[r.source] += r.copies * r.size
    for s, n in sizes.items():
        assert taken[s] == pytest.approx(target[s], abs=max(3, 0.001 * n))


def test_transfers_keep_words_and_expectations():
    rng = random.Random(1)
    for _ in range(2000):
        a, b, p, q = rng.randrange(1, 50), rng.randrange(1, 50), rng.random(), rng.random()
        up = min(b * q, a * (1 - p))
        down = min(a * p, b * (1 - q))
        outs = [M.transfer(a, p, b, q, 0.0), M.transfer(a, p, b, q, 0.999999)]
        for x, y in outs:
            assert a * x + b * y == pytest.approx(a * p + b * q)
            assert {x, y} & {0.0, 1.0} and 0 <= x <= 1 and 0 <= y <= 1
        mean = outs[0][0] * up / (up + down) + outs[1][0] * down / (up + down)
        assert mean == pytest.approx(p)


def test_the_last_ones_are_rounded_together():
    rng = random.Random(2)
    for n in (1, 5, 18, 40):
        sizes = [rng.randrange(1, 2 ** rng.randrange(1, 12)) for _ in range(n)]
        parts = [rng.random() for _ in sizes]
        out = M.closest(sizes, parts)
        assert abs(sum(s * o for s, o in zip(sizes, out, strict=True)) - sum(s * p for s, p in zip(sizes, parts, strict=True))) <= max(sizes)


def test_mixed_documents_repeat_rows(spark):
    rows = [(k, "w " * (k % 40), "en", f"s{k % 3}") for k in range(300)] + [(i, t, "en", None) for i, t in awkward() if i not in (8, 9)]
    docs = table(spark, rows)
    out = M.mixed_documents(docs)
    assert out.columns == docs.columns
    counts = {}
    for r in out.collect():
        counts[r.doc_id, r.text] = counts.get((r.doc_id, r.text), 0) + 1
    assert max(counts.values()) <= 4  # rows that repeat id and text may each come twice
    words = sum(len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) * n for (_, t), n in counts.items())
    assert words == pytest.approx(1.5 * sum(len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in rows), rel=0.01)
    assert M.mixed_documents(table(spark, [])).count() == 0


def _pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, id long, sha string")


PAGES = [(k, f"http://h/{k}", h, 0, "") for k, h in enumerate(["<p>a</p>", "<p>b</p>", "<p>a</p>", "", None, "é" * 5000, "<p>a</p>", "x" * 200_000, "WARC/1.1\r\n\r\n\x1f"])]


@pytest.mark.parametrize("split", [37, 1000, 1 << 23])
def test_archives_come_back_whatever_the_split(spark, split):
    rows = [*PAGES, (None, None, "<p>c</p>", 0, ""), (50, "http://x y/\r\nevil: 1", "<p>c</p>", 0, ""), (51, "u", "<p>d</p>", 0, ""), (51, "u", "<p>d</p>", 0, "")]
    files = W.write_archives(_pages(spark, rows))
    got = W.read_archives(files, split_bytes=split, with_payload=True).collect()
    by = {}
    for p, _, h, _, _ in rows:
        by.setdefault(h or "", []).append(p)
    winner = {h: max((p for p in ps if p is not None), default=None) for h, ps in by.items()}
    assert sorted((str(r.page_id), r.payload_bytes, r.payload_digest) for r in got) == sorted((str(p), len((h or "").encode()), W.base32_sha1((h or "").encode())) for p, _, h, _, _ in rows)
    assert sum(r.record_type == "response" for r in got) == len(by)
    for r in got:
        if r.record_type == "response":
            text = bytes(r.payload).decode()
            assert winner[text] == r.page_id and r.refers_to is None
        else:
            assert r.refers_to in winner.values()


def test_small_payloads_are_all_responses(spark):
    got = W.read_archives(W.write_archives(_pages(spark, PAGES), min_bytes=10)).collect()
    assert sum(r.record_type == "revisit" for r in got) == 0
    assert W.read_archives(W.write_archives(_pages(spark, []))).count() == 0


def test_damage_costs_one_record(tmp_path):
    members = [W.record(k, f"http://h/{k}", random.Random(k).randbytes(3000).hex().encode(), None, False) for k in range(20)]
    raw = bytearray(b"".join(members))
    at = len(members[0]) + len(members[1]) // 2
    raw[at : at + 20] = bytes(20)
    path = tmp_path / "damaged.warc.gz"
    path.write_bytes(raw)
    for step in (100, 5000, len(raw)):
        ids = [W.page_of(f["warc-record-id"]) for a in range(0, len(raw), step) for f, _ in W.records(str(path), a, min(a + step, len(raw)), len(raw))]
        assert ids == [0, *range(2, 20)]
    assert gzip.decompress(members[3]).startswith(b"WARC/1.1\r\n")
