"""N-gram Jaccard self-join: all links between documents whose shingle sets overlap enough.

Two sets link when 100 * intersection >= percent * union. Equal sets are one class; the join
runs over classes, so copies are never expanded.

1. One scan makes each text's set. Every shingle goes, packed with the others of its range, to
   the task of that range, which counts in how many classes it occurs and sends the shared ones
   (two classes or more) back by class. All shingles of all documents are counted, but for those
   that a sample shows to be in a large share of texts: these come last in the order of shingles
   whatever their count, so they go straight to the class, and no task gets their lists.
2. A class's prefix holds its rarest shingles, in one global order (number of classes, shingle).
   If shingles of its own alone fill the prefix, nothing can link to it, and it is done; most are.
   The others keep their shared shingles only, as an intersection needs no more.
3. Each shared shingle names a leader, the smallest class that has it. A class goes, with its set,
   to the group of each leader that its prefix names; sets that resemble each other name the same
   few leaders. Linked classes share a prefix shingle, and so a group, where ``set_relations``
   finds the links: index lists with blocks skipped by size and position, and answers derived from
   those of a highly similar set. Of the links a forest leaves the task, at most one row a set.
4. A group of more than ``block`` sets is dealt in blocks, each with the same few pivots of the
   group. That brings near copies into one component. Of what such a group then holds, pairs in
   one component need no look: the sets outside its largest component are compared among
   themselves and with that component, block against block, each pair of blocks in a task.

So no link between classes is missed, no pair leaves a task unless it links, and a task that
compares holds two blocks of sets at most. The tasks that look for shared shingles and put sets
together hold one range of shingles or classes each. Shingles and sets are compared by 64-bit hashes. The sample decides
where rows go and how ties of order fall, not what links.

Defined cases: null text and text without words have an empty set, link with nothing and are
their own component; fewer words than a shingle make one shingle; repeated rows each give a row;
a null id is its own component if nothing links to it, and never names one otherwise; an empty
table gives an empty result; other columns are ignored. The set of one very long text is held
whole by the tasks that compare it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.components import contract, smallest_of, spread_join
from folio.llm.scratch import materialise, remove, task_count
from folio.llm.set_relations import Group, links, prefix_length, ranges
from folio.llm.shared_files import give_back, small_batches
from folio.llm.shingles import set_key, shingle_set

_BULK, _META, _SHARED = 0, 1, 2
_PACKED = "part int, kind int, a binary, b binary, c binary, d binary, e binary, f binary"
_FLUSH = 1_000_000  # shingles a task packs at a time
_OFTEN = np.uint32(0xFFFFFFFF)  # the count of a frequent shingle


def _bounds(parts: int) -> np.ndarray:
    """Lower ends of equal ranges of unsigned 64-bit numbers, the first left out."""
    return np.array([(k << 64) // parts for k in range(1, parts)], dtype=np.uint64)


def _squeezed(values: np.ndarray) -> bytes:
    """Ascending 64-bit numbers as differences of 6 bytes, or whole where one doesn't fit."""
    steps = np.diff(values, prepend=values[:1])
    if len(values) and int(steps.max()) < 1 << 48:
        return b"\x06" + values[:1].tobytes() + steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()
    return b"\x08" + values.tobytes()


def _spread(raw: bytes) -> np.ndarray:
    if raw[:1] == b"\x08":
        return np.frombuffer(raw, "<u8", offset=1)
    steps = np.zeros(((len(raw) - 9) // 6, 8), np.uint8)
    steps[:, :6] = np.frombuffer(raw, np.uint8, offset=9).reshape(-1, 6)
    return np.cumsum(steps.view("<u8")[:, 0], dtype=np.uint64) + np.frombuffer(raw, "<u8", 1, 1)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int32(), *[pa.binary()] * 6]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["part", "kind", "a", "b", "c", "d", "e", "f"])


def _leader(key: np.ndarray) -> np.ndarray:
    return (key.view(np.uint64) >> np.uint64(32)).astype("<u4")


def frequent_shingles(texts: DataFrame, width: int, *, sample: int = 1024, share: float = 1 / 32, most: int = 1 << 16) -> tuple[np.ndarray, np.ndarray]:
    """Shingles in more than ``share`` of about ``sample`` classes, ascending, and their leaders."""

    def pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for text in batch["text"]:
                s = shingle_set(text, width)
                if len(s):
                    yield pd.DataFrame({"token": s.view(np.int64), "class": set_key(s)})

    rows = max(1, texts.count())
    seen = texts.select("text").sample(False, min(1.0, sample / rows), seed=1).mapInPandas(pairs, "token long, class long")
    counted = seen.groupBy("token").agg(F.count_distinct("class").alias("n"), F.min(F.shiftrightunsigned("class", 32)).alias("leader"))
    rows = counted.filter(F.col("n") > max(8, int(sample * share))).orderBy(F.desc("n"), "token").limit(most).collect()
    token = np.array([r.token for r in rows], dtype=np.int64).view(np.uint64)
    order = np.argsort(token)
    return token[order], np.array([r.leader for r in rows], dtype="<u4")[order]


def _by_class(token: np.ndarray, key: np.ndarray, size: np.ndarray, df: np.ndarray, lead: np.ndarray, bounds: np.ndarray) -> Iterator[tuple]:
    """Packed rows, one for each range of classes, of shared shingles."""
    by = key.view(np.uint64)
    order = np.argsort(by, kind="stable")
    token, key, size, df, lead, by = token[order], key[order], size[order], df[order], lead[order], by[order]
    cuts = [0, *np.searchsorted(by, bounds).tolist(), len(by)]
    for part, (x, y) in enumerate(zip(cuts, cuts[1:], strict=False)):
        if x < y:
            k, first, times = np.unique(key[x:y], return_index=True, return_counts=True)
            o = np.argsort(first)  # runs stand in unsigned order
            yield (part, _SHARED, k[o].tobytes(), times[o].astype("<u4").tobytes(), token[x:y].tobytes(), df[x:y].astype("<u4").tobytes(), size[x:y][first[o]].astype("<u4").tobytes(), lead[x:y].astype("<u4").tobytes())


def _packed_shingles(width: int, parts: int, often: tuple[np.ndarray, np.ndarray]):
    """Documents to packed shingles by range, and a packed row of (id, class, size) a batch."""
    bounds = _bounds(parts)

    def flush(ids: list, keys: list[int], sets: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        n = np.array([len(s) for s in sets], dtype="<i8")
        keys_ = np.array(keys, dtype="<i8")
        null = np.array([i is None for i in ids], dtype=np.uint8)
        rows = [(abs(hash(keys[0])) % parts, _META, np.array([i or 0 for i in ids], dtype="<i8").tobytes(), null.tobytes(), keys_.tobytes(), n.tobytes(), b"", b"")]
        first = np.unique(keys_, return_index=True)[1]  # one set a class and batch
        first = first[n[first] > 0]
        if len(first):
            tokens = np.concatenate([sets[i] for i in first])
            owner = np.repeat(first, n[first])
            if len(often[0]):
                at = np.minimum(np.searchsorted(often[0], tokens), len(often[0]) - 1)
                hot = often[0][at] == tokens
                rows += _by_class(tokens[hot], keys_[owner[hot]], n[owner[hot]], np.full(hot.sum(), _OFTEN), often[1][at[hot]], bounds)
                tokens, owner = tokens[~hot], owner[~hot]
            order = np.argsort(tokens)
            tokens, owner = tokens[order], owner[order]
            cuts = [0, *np.searchsorted(tokens, bounds).tolist(), len(tokens)]
            for part, (x, y) in enumerate(zip(cuts, cuts[1:], strict=False)):
                if x < y:
                    mine, at = np.unique(owner[x:y], return_inverse=True)
                    rows.append((part, _BULK, _squeezed(tokens[x:y]), at.astype("<u2").tobytes(), keys_[mine].tobytes(), n[mine].astype("<u4").tobytes(), b"", b""))
        yield _batch(rows)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, keys, sets, held = [], [], [], 0
        for batch in small_batches(batches):
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                s = shingle_set(text, width)
                ids.append(doc_id)
                keys.append(set_key(s) if len(s) else 0)
                sets.append(s)
                held += len(s)
                if held >= _FLUSH or len(ids) >= 60_000:
                    yield from flush(ids, keys, sets)
                    ids, keys, sets, held = [], [], [], 0
        if ids:
            yield from flush(ids, keys, sets)
        del ids, keys, sets
        give_back()

    return pack


def _shared_shingles(parts: int):
    """Packed shingles of one range to the shared ones, packed by the range of their classes."""
    bounds = _bounds(parts)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, keys, sizes = [], [], []
        for batch in batches:
            for row in zip(*[x.to_pylist() for x in batch.columns], strict=True):
                if row[1] != _BULK:
                    yield _batch([row])
                    continue
                at = np.frombuffer(row[3], "<u2")
                tokens.append(_spread(row[2]))
                keys.append(np.frombuffer(row[4], "<i8")[at])
                sizes.append(np.frombuffer(row[5], "<u4")[at])
        if not tokens:
            return
        token, key, size = map(np.concatenate, (tokens, keys, sizes))
        del tokens, keys, sizes
        order = np.argsort(token)
        token = token[order]
        same = token[1:] == token[:-1]
        some = np.zeros(len(token), bool)  # seen twice or more, perhaps in copies
        some[1:] |= same
        some[:-1] |= same
        token, key, size = token[some], key[order[some]], size[order[some]]
        order = np.lexsort((key.view(np.uint64), token))
        token, key, size = token[order], key[order], size[order]
        new = np.ones(len(token), bool)
        new[1:] = (token[1:] != token[:-1]) | (key[1:] != key[:-1])
        token, key, size = token[new], key[new], size[new]
        starts = np.flatnonzero(np.concatenate((np.ones(min(1, len(token)), bool), token[1:] != token[:-1])))
        df = np.diff(np.append(starts, len(token)))
        lead = np.repeat(_leader(key[starts]), df)
        df = np.repeat(df, df)
        keep = df > 1
        for row in _by_class(token[keep], key[keep], size[keep], df[keep], lead[keep], bounds):
            yield _batch([row])
        del token, key, size, df, lead, order
        give_back()

    return count


_CLASS = "kind int, doc_id long, class long, n long, own long, shared binary, leaders array<long>"


def _classes(percent: int):
    """Packed rows of a range of classes to rows: documents, and classes that may link."""

    def rows(kind: int, doc_id, key, n, own, shared, leaders) -> pa.RecordBatch:
        fill = pa.nulls(len(key), pa.int64())
        columns = [pa.array([kind] * len(key), pa.int32()), fill if doc_id is None else doc_id, pa.array(key, pa.int64()), pa.array(n, pa.int64())]
        columns += [fill if own is None else pa.array(own, pa.int64()), pa.array([None] * len(key) if shared is None else shared, pa.binary())]
        columns.append(pa.nulls(len(key), pa.list_(pa.int64())) if leaders is None else leaders)
        return pa.RecordBatch.from_arrays(columns, ["kind", "doc_id", "class", "n", "own", "shared", "leaders"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: list[list[np.ndarray]] = [[], [], [], [], []]
        for batch in batches:
            for _, kind, a, b, c, d, e, f in zip(*[x.to_pylist() for x in batch.columns], strict=True):
                if kind == _META:
                    ids = pa.array(np.frombuffer(a, "<i8"), pa.int64(), mask=np.frombuffer(b, np.uint8).astype(bool))
                    yield rows(0, ids, np.frombuffer(c, "<i8"), np.frombuffer(d, "<i8"), None, None, None)
                    continue
                times = np.frombuffer(b, "<u4")
                for k, x in enumerate((np.repeat(np.frombuffer(a, "<i8"), times), np.repeat(np.frombuffer(e, "<u4"), times), np.frombuffer(c, "<u8"), np.frombuffer(d, "<u4"), np.frombuffer(f, "<u4"))):
                    got[k].append(x)
        if not got[0]:
            return
        key, size, token, df, lead = map(np.concatenate, got)
        del got
        order = np.lexsort((token, df, key))
        again = np.zeros(len(order), bool)  # frequent shingles come once for each task that saw the class
        again[1:] = (key[order[1:]] == key[order[:-1]]) & (token[order[1:]] == token[order[:-1]])
        order = order[~again]
        key, size, token, lead = key[order], size[order].astype(np.int64), token[order], lead[order]
        starts = np.flatnonzero(np.concatenate((np.ones(1, bool), key[1:] != key[:-1])))
        ends = np.append(starts[1:], len(key))
        n = size[starts]
        own = n - (ends - starts)
        some = np.flatnonzero(own < prefix_length(n, percent))
        for a in range(0, len(some), 4096):
            part = some[a : a + 4096]
            length = np.minimum(prefix_length(n[part], percent) - own[part], ends[part] - starts[part])
            named = np.unique(np.stack((np.repeat(np.arange(len(part)), length), lead[ranges(starts[part], length)].astype(np.int64))), axis=1)
            at = np.searchsorted(named[0], np.arange(len(part) + 1))
            leaders = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(named[1], pa.int64()))
            yield rows(1, None, key[starts[part]], n[part], own[part], [token[starts[i] : ends[i]].tobytes() for i in part], leaders)

    return gather


def _links(percent: int):
    """Sets of groups (home, tile, class, label, side, n, own, shared), sorted by group, to links (u, v)."""

    def solve(held: list[pa.RecordBatch]) -> pa.RecordBatch | None:
        t = pa.Table.from_batches(held)
        key, label, side, n, own = (t.column(k).to_numpy().astype(np.int64) for k in ("class", "label", "side", "n", "own"))
        u, v = links(Group(key, n, own, [np.frombuffer(x, "<u8") for x in t.column("shared").to_pylist()], label, side), percent)
        return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"]) if len(u) else None

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            home, tile = (np.array(batch.column(k).to_pylist(), dtype=object) for k in (0, 1))
            starts = [0, *(np.flatnonzero((home[1:] != home[:-1]) | (tile[1:] != tile[:-1])) + 1).tolist(), batch.num_rows] if batch.num_rows else [0]
            for a, b in zip(starts, starts[1:], strict=False):
                group = (home[a], tile[a])
                if group != last and held:
                    if (found := solve(held)) is not None:
                        yield found
                    held = []
                last = group
                held.append(batch.slice(a, b - a))
        if held and (found := solve(held)) is not None:
            yield found
        give_back()

    return each


class _Join:
    """The classes' groups, and what is done with them."""

    def __init__(self, classes: DataFrame, percent: int, block: int, most_shingles: int):
        self.classes, self.percent, self.block, self.most_shingles = classes, percent, block, most_shingles
        self.parts = task_count(classes.sparkSession)

    def tiles(self, m, w):
        """In how many blocks so many sets with so many shingles go."""
        return F.greatest(F.lit(1), F.ceil(m / F.lit(self.block)), F.ceil(w / F.lit(self.most_shingles)))

    def compare(self, rows: DataFrame) -> DataFrame:
        """rows: home, tile, class, label, side. Links of each tile, as a forest."""
        whole = rows.join(self.classes.select("class", "n", "own", "shared"), "class").select("home", "tile", "class", "label", "side", "n", "own", "shared")
        dealt = whole.repartition(self.parts, "home", "tile").sortWithinPartitions("home", "tile", "class")
        return materialise(dealt.mapInArrow(_links(self.percent), "u long, v long"), "links")

    def groups(self) -> DataFrame:
        """class, home and the group's number of blocks and sets; groups of one set are left out."""
        named = materialise(self.classes.select("class", F.expr("octet_length(shared) / 8").cast("long").alias("w"), F.explode("leaders").alias("home")), "named")
        counted = named.groupBy("home").agg(F.count(F.lit(1)).alias("m"), F.sum("w").alias("w")).filter("m > 1")
        sized = materialise(counted.select("home", "m", self.tiles(F.col("m"), F.col("w")).cast("long").alias("k")), "sized")
        placed = materialise(spread_join(named, sized, "home", how="inner"), "groups")
        remove(named)
        remove(sized)
        return placed

    def first_look(self, groups: DataFrame) -> DataFrame:
        """Small groups whole; of large ones each block with the group's pivots."""
        block = F.pmod(F.xxhash64("class", "home"), F.col("k"))
        pivot = (F.col("k") > 1) & (F.pmod(F.xxhash64("home", "class", F.lit(1)), F.col("m")) < 16)
        tiles = F.when(pivot, F.sequence(F.lit(0).cast("long"), F.col("k") - 1)).otherwise(F.array(block))
        rows = groups.select("home", "class", block.alias("own_block"), F.explode(tiles).alias("block"))
        side = F.when(F.col("block") == F.col("own_block"), 2).otherwise(0)
        return self.compare(rows.select("home", F.col("block").cast("string").alias("tile"), "class", F.col("class").alias("label"), side.alias("side")))

    def second_look(self, groups: DataFrame, labels: DataFrame) -> DataFrame | None:
        """Large groups that are not in one component: all sets outside the largest one against all."""
        large = groups.filter("k > 1")
        if large.isEmpty():
            return None
        of = materialise(large.select("home", "class", "w").join(labels.select(F.col("node").alias("class"), "label"), "class", "left").select("home", "class", "w", F.coalesce("label", "class").alias("label")), "large")
        counted = of.groupBy("home", "label").agg(F.count(F.lit(1)).alias("m"), F.sum("w").alias("w"))
        place = F.struct("m", "label", "w")
        per_home = counted.groupBy("home").agg(F.max(place).alias("top"), F.sum("m").alias("m"), F.sum("w").alias("w")).filter("m > top.m")
        k_rest, k_top = self.tiles(F.col("m") - F.col("top.m"), F.col("w") - F.col("top.w")), self.tiles(F.col("top.m"), F.col("top.w"))
        sized = materialise(per_home.select("home", F.col("top.label").alias("top"), k_rest.cast("long").alias("k_rest"), k_top.cast("long").alias("k_top")), "sized")
        rows = spread_join(of.drop("w"), sized, "home", how="inner")
        is_top = F.col("label") == F.col("top")
        i = F.pmod(F.xxhash64("class", "home"), F.when(is_top, F.col("k_top")).otherwise(F.col("k_rest")))
        rows = rows.withColumn("i", i)
        name = lambda kind, a, b: F.concat_ws("-", F.lit(kind), a.cast("string"), b.cast("string"))
        upto = lambda k: F.sequence(F.lit(0).cast("long"), F.col(k) - 1)
        tops = rows.filter(is_top).select("home", "class", "label", F.explode(F.transform(upto("k_rest"), lambda a: F.struct(name("t", a, F.col("i")).alias("tile"), F.lit(0).alias("side")))).alias("x"))
        with_top = F.transform(upto("k_top"), lambda b: F.struct(name("t", F.col("i"), b).alias("tile"), F.lit(1).alias("side")))
        among = F.transform(upto("k_rest"), lambda b: F.struct(name("r", F.least("i", b), F.greatest("i", b)).alias("tile"), F.when(F.col("i") == b, 2).when(F.col("i") < b, 1).otherwise(0).alias("side")))
        rest = rows.filter(~is_top).select("home", "class", "label", F.explode(F.concat(with_top, among)).alias("x"))
        return self.compare(tops.unionByName(rest).select("home", "x.tile", "class", "label", "x.side"))


def jaccard_components(docs: DataFrame, *, width: int = 5, percent: int = 75, id_col: str = "doc_id", text_col: str = "text", block: int = 1024, most_shingles: int = 1 << 21) -> tuple[DataFrame, DataFrame]:
    """Documents (doc_id, class, n, label), and links between classes (u, v) that hold the components
    together.

    label is the component's class, null for empty sets; documents of one class have equal sets."""
    parts = task_count(docs.sparkSession)
    texts = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text"))
    often = frequent_shingles(texts, width)
    bulk = texts.mapInArrow(_packed_shingles(width, parts, often), _PACKED).repartitionById(parts, F.col("part"))
    shared = bulk.mapInArrow(_shared_shingles(parts), _PACKED).repartitionById(parts, F.col("part"))
    all_rows = materialise(shared.mapInArrow(_classes(percent), _CLASS), "classes")
    join = _Join(all_rows.filter("kind = 1").select("class", "n", "own", "shared", "leaders"), percent, block, most_shingles)
    groups = join.groups()
    found = join.first_look(groups)
    labels = contract(found)
    more = join.second_look(groups, labels)
    if more is not None:
        labels = contract(more, labels)
        found = found.unionByName(more)
    remove(groups)
    members = all_rows.filter("kind = 0").select("doc_id", "class", "n")
    members = spread_join(members, labels.select(F.col("node").alias("class"), "label"), "class")
    members = members.select("doc_id", "class", "n", F.when(F.col("n") > 0, F.coalesce("label", "class")).alias("label"))
    return members, found


def jaccard_join(docs: DataFrame, *, width: int = 5, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_shingles, component_id (smallest id reachable by links), class_id."""
    members = materialise(jaccard_components(docs, width=width, percent=percent, id_col=id_col, text_col=text_col)[0], "members")
    joined = spread_join(members, materialise(smallest_of(members, "label", "doc_id").filter("size > 1").select("label", F.col("first").alias("component_id")), "smallest"), "label")
    return joined.select(F.col("doc_id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"), F.col("class").alias("class_id"))
