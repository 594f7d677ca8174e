"""Jaccard self-join of documents' word n-grams by prefixes under several token orders.

Documents with equal sets form one class. Under any order of tokens, two sets of
similarity t or more share a token among the first n - ceil(t n) + 1 = p of each. Orders
here put tokens that fewer sets hold first, and differ in how they break ties.

1. A set of which p tokens are held by no other has no prefix token in common with any.
   Tokens below a fixed share of the hash range are counted over all documents, and sets
   with p single ones among those alone are done: they link with nothing.
2. The rest are counted whole and give their prefixes under two orders, without single
   tokens. Sets that share a prefix token are tied; sets tied under one order are tied
   anew under the other among themselves, until no group splits: what is left of a group
   shares prefix tokens under both.
3. Groups are compared exactly. A group beyond one task's share is dealt to several
   parts, each with the group's first set; parts that this doesn't unite compare what
   lies outside the largest component with all parts.

Every table passed on grows with the tokens, none with pairs. Classes are 128-bit digests
of sets of 64-bit token hashes, texts 128-bit digests.

Null and empty texts, and texts of white space, have empty sets and no links. A text of
fewer than n words has its whole word sequence as its one token. Very long texts are sets
like others. Rows with equal texts or ids count as rows of their own. An empty table gives
an empty result. Only the id and text columns are read, so others may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verdictspark.llm.graph import components
from verdictspark.llm.meeting import buckets_for, planes, unplanes
from verdictspark.llm.tables import discard, join_hot, keep, partitions, read, share_of
from verdictspark.llm.words import Words, mix, pieces, split, trim, windows

#: Places that a task gathers before it deals them out, and tokens of a block of sets.
CHUNK_PLACES = 1 << 19
BLOCK_TOKENS = 1 << 18
#: Places of a bucket: it bounds the memory of the worker that meets them.
BUCKET_PLACES = 600_000
#: Tokens of one part of a large group: the share of a task, between these two.
PART_TOKENS = (1 << 14, 1 << 20)
FILTER_BITS_MOST = 1 << 27

_U = np.uint64
_ID = np.dtype("V16")


def tokens_of(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The n-gram hashes of all texts, repeats included, and where each text's begin."""
    h, counts = words.hashes(fold=True), words.counts()
    each = np.where(counts >= n, counts - n + 1, np.minimum(counts, 1))
    first = np.concatenate([[0], np.cumsum(each)])
    out = np.empty(int(first[-1]), dtype=_U)
    text = np.repeat(np.arange(len(counts)), each)
    at = words.first[:-1][text] + np.arange(len(out)) - first[:-1][text]
    long = counts[text] >= n
    if long.any():
        out[long] = windows(h, n)[at[long]]
    for i in np.flatnonzero((counts > 0) & (counts < n)):
        out[first[i]] = windows(h[words.first[i] : words.first[i + 1]], int(counts[i]))[0]
    return out, first


def sets_of(column: pa.Array, n: int) -> list[np.ndarray]:
    """Each text's distinct tokens in order."""
    grams, first = tokens_of(split(column), n)
    return [np.unique(grams[a:b]) for a, b in zip(first[:-1], first[1:], strict=True)]


def class_id(own: np.ndarray) -> bytes:
    """A set's identity."""
    return hashlib.blake2b(own.tobytes(), digest_size=16).digest()


def prefix_length(n: int, num: int, den: int) -> int:
    return n - -(-num * n // den) + 1


def _batch(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    fields = [c.split() for c in schema.split(", ")]
    columns = zip(*rows, strict=True) if rows else [[]] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], names=[f[0] for f in fields])


def _steps(at: np.ndarray) -> bytes:
    return planes(np.diff(at, prepend=0))


def _unsteps(raw: bytes) -> np.ndarray:
    return np.cumsum(unplanes(raw).astype(np.int64))


def _by_bucket(tokens: np.ndarray, limit: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order that brings tokens below limit together by buckets of equal ranges, the buckets met and where each begins."""
    bucket = (tokens >> _U(32)) * _U(buckets) // _U((limit >> 32) + 1)
    order = np.argsort(bucket, kind="stable")
    met, edge = np.unique(bucket[order], return_index=True)
    return order, met, np.append(edge, len(order))


def _classes(id_type: str, n: int):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            sets = sets_of(batch.column("text"), n)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("tid"), pa.array([class_id(s) if len(s) else None for s in sets], pa.binary()), pa.array([len(s) for s in sets], pa.int64())],
                names=["doc_id", "tid", "cid", "n"],
            )

    return run, f"doc_id {id_type}, tid binary, cid binary, n long"


_PLACES = "bucket int, chunk binary, cids binary, sizes binary, sets binary, tokens binary"


def _sampled(n: int, limit: int, buckets: int):  # noqa: ANN202
    """Tokens below limit by bucket, each once a chunk, with the set that holds it or, if several do, with none; the chunk's sets in a row of their own."""

    def rows_of(cids: list[bytes], sizes: list[int], parts: list[np.ndarray]) -> list[tuple]:
        ids = b"".join(cids)
        chunk = hashlib.blake2b(ids, digest_size=16).digest()
        owner = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
        tokens, first, count = np.unique(np.concatenate(parts), return_index=True, return_counts=True)
        # In order of sets, so that their steps stay small.
        once = np.sort(first[count == 1])
        rows = [(int.from_bytes(chunk[:4], "little") % buckets, chunk, ids, np.array(sizes, dtype="<u4").tobytes(), None, None)]
        every = np.concatenate(parts)
        for goes, owners in ((every[once], owner[once]), (tokens[count > 1], None)):
            order, met, edge = _by_bucket(goes, limit, buckets)
            for k, b in enumerate(met.tolist()):
                own = order[edge[k] : edge[k + 1]]
                rows.append((b, chunk, None, None, None if owners is None else _steps(owners[own]), goes[own].astype("<u4").tobytes()))
        return rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cids: dict[bytes, None] = {}
        sizes, parts, places = [], [], 0
        for batch in pieces(batches):
            for own in sets_of(batch.column("text"), n):
                if len(own) and (cid := class_id(own)) not in cids:
                    cids[cid] = None
                    sizes.append(len(own))
                    parts.append(own[: np.searchsorted(own, _U(limit), side="right")])
                    places += len(parts[-1])
            if places >= CHUNK_PLACES:
                yield _batch(_PLACES, rows_of(list(cids), sizes, parts))
                cids, sizes, parts, places = {}, [], [], 0
        if cids:
            yield _batch(_PLACES, rows_of(list(cids), sizes, parts))

    return run


_SINGLE = "chunk binary, cids binary, sizes binary, sets binary"


def _singles(table: pa.Table) -> pa.Table:
    """One bucket: for each chunk, the sets of the tokens that occur once; rows of sets as they are."""
    trim()
    rows, found, several = [], [], []
    for r in table.to_pylist():
        if r["cids"] is not None:
            rows.append((r["chunk"], r["cids"], r["sizes"], None))
        elif r["sets"] is None:
            several.append(np.frombuffer(r["tokens"], dtype="<u4"))
        else:
            found.append((r["chunk"], _unsteps(r["sets"]), np.frombuffer(r["tokens"], dtype="<u4")))
    if found:
        # What several sets of a chunk hold counts twice.
        tokens = np.concatenate([f[2] for f in found] + several * 2)
        order = np.argsort(tokens, kind="stable")
        s = tokens[order]
        same = s[1:] == s[:-1]
        single = np.ones(len(s), dtype=bool)
        single[order[1:][same]] = False
        single[order[:-1][same]] = False
        at = 0
        for chunk, owner, own in found:
            owner = owner[single[at : at + len(own)]]
            at += len(own)
            if len(owner):
                rows.append((chunk, None, None, _steps(owner)))
    return pa.Table.from_batches([_batch(_SINGLE, rows)])


def _tied(num: int, den: int):  # noqa: ANN202
    """One chunk: the sets of which fewer than a prefix's tokens are known to be single."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        head = next(r for r in rows if r["cids"] is not None)
        cids, size = np.frombuffer(head["cids"], dtype=_ID), np.frombuffer(head["sizes"], dtype="<u4").astype(np.int64)
        single = np.zeros(len(size), dtype=np.int64)
        for r in rows:
            if r["sets"] is not None:
                single += np.bincount(_unsteps(r["sets"]), minlength=len(size))
        left = np.flatnonzero(single < size - -(-num * size // den) + 1)
        return pa.table({"cid": pa.array([cids[i].tobytes() for i in left], pa.binary()), "n": pa.array(size[left], pa.int64())})

    return run


BIT_CHUNK = 1 << 16


def _bit_of(column: pa.Array) -> np.ndarray:
    """64 bits of each id: a number, or a digest's first eight bytes."""
    if pa.types.is_integer(column.type):
        return np.asarray(column).view(_U)
    return np.frombuffer(b"".join(x[:8] for x in column.to_pylist()), dtype=_U)


def _bits(bits: int):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.unique((_bit_of(batch.column(0)) % _U(bits)).astype(np.int64))
            met, edge = np.unique(at // BIT_CHUNK, return_index=True)
            parts = np.split(at % BIT_CHUNK, edge[1:])
            yield pa.RecordBatch.from_pydict({"chunk": pa.array(met, pa.int32()), "at": pa.array([p.astype("<u2").tobytes() for p in parts[: len(met)]], pa.binary())})

    return run


def _set_bits(table: pa.Table) -> pa.Table:
    marks = np.zeros(BIT_CHUNK, dtype=bool)
    for at in table.column("at").to_pylist():
        marks[np.frombuffer(at, dtype="<u2")] = True
    return pa.table({"chunk": table.column("chunk").slice(0, 1), "marks": pa.array([np.packbits(marks).tobytes()], pa.binary())})


def id_filter(ids: DataFrame, count: int, bits_each: int = 16) -> np.ndarray:
    """A table of bits that is set for every id; others may pass it too, and a join sorts them out.

    It is put together in chunks on the executors; the driver gets the bits alone, at most
    FILTER_BITS_MOST of them.
    """
    bits = BIT_CHUNK
    while bits < bits_each * count and bits < FILTER_BITS_MOST:
        bits *= 2
    marks = np.zeros(bits // 8, dtype=np.uint8)
    for r in ids.mapInArrow(_bits(bits), "chunk int, at binary").groupBy("chunk").applyInArrow(_set_bits, "chunk int, marks binary").collect():
        marks[r["chunk"] * BIT_CHUNK // 8 : (r["chunk"] + 1) * BIT_CHUNK // 8] = np.frombuffer(r["marks"], dtype=np.uint8)
    return marks


def _passing(marks: np.ndarray, ids: np.ndarray) -> np.ndarray:
    at = (ids % _U(len(marks) * 8)).astype(np.int64)
    return np.flatnonzero(marks[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1)


def _sets(n: int, marks: np.ndarray, holders: dict[bytes, object]):  # noqa: ANN202
    """Sets of the classes that pass the filter; of a frequent class, that of its holder's row alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            sets = sets_of(batch.column("text"), n)
            cids = [class_id(s) for s in sets]
            ids = np.frombuffer(b"".join(c[:8] for c in cids), dtype=_U)
            goes: dict[bytes, int] = {}
            for i in _passing(marks, ids).tolist():
                if cids[i] not in holders or holders[cids[i]] == batch.column("id")[i].as_py():
                    goes.setdefault(cids[i], i)
            yield _batch("cid binary, tokens binary", [(c, sets[i].tobytes()) for c, i in goes.items()])

    return run


_BLOCK = "block binary, bucket int, nodes binary, sizes binary, tokens binary"


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sets, each node's once, as blocks of about BLOCK_TOKENS tokens."""
    seen: set[int] = set()
    nodes: list[int] = []
    sets: list[bytes] = []
    size = 0

    def row() -> tuple:
        ids = np.array(nodes, dtype="<i8").tobytes()
        return (hashlib.blake2b(ids, digest_size=16).digest(), -1, ids, np.array([len(s) // 8 for s in sets], dtype="<u4").tobytes(), b"".join(sets))

    for batch in batches:
        for node, tokens in zip(batch.column("node").to_pylist(), batch.column("tokens"), strict=True):
            if node in seen:
                continue
            seen.add(node)
            nodes.append(node)
            sets.append(tokens.as_py())
            size += len(sets[-1])
            if size >= 8 * BLOCK_TOKENS:
                yield _batch(_BLOCK, [row()])
                nodes, sets, size = [], [], 0
    if nodes:
        yield _batch(_BLOCK, [row()])
        nodes, sets = [], []
    trim()


def _spread(buckets: int):  # noqa: ANN202
    """Each block's distinct tokens by bucket, with the number of its sets that hold them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, raw in zip(batch.column("block").to_pylist(), batch.column("tokens").to_pylist(), strict=True):
                tokens, count = np.unique(np.frombuffer(raw, dtype=_U), return_counts=True)
                order, met, edge = _by_bucket(tokens, (1 << 64) - 1, buckets)
                rows = []
                for k, b in enumerate(met.tolist()):
                    own = order[edge[k] : edge[k + 1]]
                    rows.append((block, b, None, count[own].astype("<u4").tobytes(), tokens[own].astype("<u4").tobytes()))
                yield _batch(_BLOCK, rows)

    return run


def _frequencies(table: pa.Table) -> pa.Table:
    """One bucket: for each token the class of its count: 0 for single ones, then four a doubling."""
    trim()
    rows = table.to_pylist()
    tokens = [np.frombuffer(r["tokens"], dtype="<u4") for r in rows]
    _, back = np.unique(np.concatenate(tokens), return_inverse=True)
    count = np.bincount(back, np.concatenate([np.frombuffer(r["sizes"], dtype="<u4") for r in rows]))
    cls = np.floor(4 * np.log2(count)).astype(np.uint8)[back]
    at = np.cumsum([0, *map(len, tokens)])
    return pa.Table.from_batches([_batch(_BLOCK, [(r["block"], r["bucket"], None, None, cls[a:b].tobytes()) for r, a, b in zip(rows, at[:-1], at[1:], strict=True)])])


def _prefixes(num: int, den: int, buckets: int):  # noqa: ANN202
    """One block: the prefix tokens of its sets under both orders, but for single ones."""

    def run(table: pa.Table) -> pa.Table:
        trim()
        rows = table.to_pylist()
        head = next(r for r in rows if r["nodes"] is not None)
        tokens = np.frombuffer(head["tokens"], dtype=_U)
        distinct, back = np.unique(tokens, return_inverse=True)
        order, met, edge = _by_bucket(distinct, (1 << 64) - 1, buckets)
        cls = np.zeros(len(distinct), dtype=np.uint8)
        place = {b: k for k, b in enumerate(met.tolist())}
        for r in rows:
            if r["nodes"] is None:
                k = place[r["bucket"]]
                cls[order[edge[k] : edge[k + 1]]] = np.frombuffer(r["tokens"], dtype=np.uint8)
        cls = cls[back]
        size = np.frombuffer(head["sizes"], dtype="<u4").astype(np.int64)
        first = np.concatenate([[0], np.cumsum(size)])
        out: list[tuple[int, int, np.ndarray]] = []
        for node, a, b in zip(np.frombuffer(head["nodes"], dtype="<i8").tolist(), first[:-1], first[1:], strict=True):
            shared = np.flatnonzero(cls[a:b])
            takes = prefix_length(int(b - a), num, den) - (int(b - a) - len(shared))
            if takes <= 0 or not len(shared):
                continue
            own, c = tokens[a:b][shared], cls[a:b][shared]
            for o, ties in ((0, own), (1, mix(own ^ _U(0xA24BAED4963EE407)))):
                out.append((o, node, own[np.lexsort((ties, c))[:takes]]))
        each = [len(t) for _, _, t in out]
        column = lambda k, kind: pa.array(np.repeat(np.array([x[k] for x in out], dtype=np.int64), each), kind)
        found = np.concatenate([t for _, _, t in out]) if out else np.zeros(0, dtype=_U)
        return pa.table({"ord": column(0, pa.int32()), "node": column(1, pa.int64()), "token": pa.array(found.view(np.int64))})

    return run


def shared_under_both(postings: DataFrame) -> DataFrame:
    """Groups (id, root) of nodes that share prefix tokens under either order within the group.

    Within each group, the holders of a token are tied to the least of them; components
    are the next groups, for the other order, until none splits.
    """
    groups, before, step = None, None, 0
    while True:
        own = postings.where(F.col("ord") == step % 2)
        if groups is not None:
            own = own.join(groups, F.col("node") == F.col("id")).select("node", F.struct("root", "token").alias("key"))
        else:
            own = own.select("node", F.struct("token").alias("key"))
        own = keep(own, "join-held")
        lead = own.groupBy("key").agg(F.min("node").alias("lead"), F.count(F.lit(1)).alias("_held")).where("_held > 1").drop("_held")
        edges = join_hot(own, lead, "key").where("lead is not null").select(F.col("node").alias("a"), F.col("lead").alias("b"))
        found = keep(components(edges), "join-groups")
        discard(own, *([groups] if groups is not None else []))
        groups = found
        now = tuple(groups.agg(F.count(F.lit(1)), F.count_distinct("root")).first())
        if now == before or not now[0]:
            return groups
        before, step = now, step + 1


class _Forest:
    def __init__(self, n: int) -> None:
        self.root = list(range(n))

    def find(self, i: int) -> int:
        while self.root[i] != i:
            self.root[i] = self.root[self.root[i]]
            i = self.root[i]
        return i

    def link(self, i: int, j: int) -> None:
        a, b = self.find(i), self.find(j)
        self.root[max(a, b)] = min(a, b)


class _Holders:
    """Sets by token, to count what a set has in common with each of them."""

    def __init__(self, sets: list[np.ndarray]) -> None:
        self.size = np.array([len(s) for s in sets])
        self.tokens, token = np.unique(np.concatenate(sets), return_inverse=True)
        self.by_token = np.repeat(np.arange(len(sets)), self.size)[np.argsort(token, kind="stable")]
        self.begin = np.concatenate([[0], np.cumsum(np.bincount(token))])

    def linked_to(self, own: np.ndarray, num: int, den: int) -> np.ndarray:
        """The sets that link with `own`."""
        at = np.searchsorted(self.tokens, own)
        at = at[(at < len(self.tokens)) & (self.tokens[np.minimum(at, len(self.tokens) - 1)] == own)]
        count = self.begin[at + 1] - self.begin[at]
        places = np.repeat(self.begin[at] - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
        both = np.bincount(self.by_token[places], minlength=len(self.size))
        return np.flatnonzero(both * (den + num) >= num * (self.size + len(own)))


def linked(sets: list[np.ndarray], num: int, den: int) -> np.ndarray:
    """For each set, the index of the smallest one that links reach.

    A set's similarity to all others comes from the lists of its tokens' holders. Sets of
    the largest component so far needn't be asked: all their links outside it show when
    the sets outside are.
    """
    n, forest = len(sets), _Forest(len(sets))
    if n <= 6:
        for i in range(n):
            for j in range(i):
                both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if both * (den + num) >= num * (len(sets[i]) + len(sets[j])):
                    forest.link(i, j)
        return np.array([forest.find(i) for i in range(n)])
    holders, asked, step = _Holders(sets), np.zeros(n, dtype=bool), 0
    while True:
        roots = np.array([forest.find(i) for i in range(n)])
        largest = np.bincount(roots).argmax()
        left = np.flatnonzero(~asked & (roots != largest))
        if not len(left):
            return roots
        for i in left[: max(1, 1 << min(step, 8))]:
            if forest.find(int(i)) != largest or step == 0:
                for j in holders.linked_to(sets[i], num, den):
                    forest.link(int(i), int(j))
                asked[i] = True
        step += 1


def _by_group(table: pa.Table) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """The rows and sets of each group in a task, each node of a side once, by node."""
    group, node, side = (table.column(c).to_numpy() for c in ("root", "node", "side"))
    tokens = table.column("tokens").to_pylist()
    order = np.lexsort((side, node, group))
    new = np.ones(len(order), dtype=bool)
    new[1:] = (np.diff(group[order]) != 0) | (np.diff(node[order]) != 0) | (np.diff(side[order]) != 0)
    order = order[new]
    for own in np.split(order, np.flatnonzero(np.diff(group[order])) + 1):
        yield own, [np.frombuffer(tokens[i], dtype=_U) for i in own]


def _compare(num: int, den: int):  # noqa: ANN202
    def run(table: pa.Table) -> pa.Table:
        trim()
        node, out = table.column("node").to_numpy(), []
        for own, sets in _by_group(table):
            out.append((node[own], node[own][linked(sets, num, den)]))
        return pa.table({"a": pa.array(np.concatenate([a for a, _ in out])), "b": pa.array(np.concatenate([b for _, b in out]))})

    return run


def _ask(num: int, den: int):  # noqa: ANN202
    """One task: links between the components of its asking sets (side 1) and those of a part's sets."""

    def run(table: pa.Table) -> pa.Table:
        side, label = table.column("side").to_numpy(), table.column("label").to_numpy()
        found: set[tuple[int, int]] = set()
        for own, sets in _by_group(table):
            held = [k for k, i in enumerate(own) if side[i] == 0]
            if not held:
                continue
            holders = _Holders([sets[k] for k in held])
            for k, i in enumerate(own):
                if side[i] == 1:
                    found.update((int(label[i]), int(label[own[held[j]]])) for j in holders.linked_to(sets[k], num, den))
        pairs = sorted(found)
        return pa.table({"a": pa.array([a for a, _ in pairs], pa.int64()), "b": pa.array([b for _, b in pairs], pa.int64())})

    return run


def _unpacked(marks: np.ndarray):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                nodes, size = np.frombuffer(r["nodes"], dtype="<i8"), np.frombuffer(r["sizes"], dtype="<u4").astype(np.int64)
                at = 8 * np.concatenate([[0], np.cumsum(size)])
                yield _batch("node long, tokens binary", [(int(nodes[i]), r["tokens"][at[i] : at[i + 1]]) for i in _passing(marks, nodes.view(_U))])

    return run


def _verified(blocks: DataFrame, groups: DataFrame, alive: DataFrame, num: int, den: int) -> DataFrame:
    """(id, root) of the nodes of groups by their links, by exact comparison within each group."""
    spark = blocks.sparkSession
    members = keep(groups.join(alive, F.col("id") == F.col("node")).select("node", "root", "n"), "join-members")
    count, tokens = members.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    bins = int(max(2 * partitions(spark), tokens // PART_TOKENS[1] + 1))
    share = int(min(max(tokens // (2 * bins), PART_TOKENS[0]), PART_TOKENS[1]))
    totals = members.groupBy("root").agg(F.sum("n").alias("total")).select("root", F.ceil(F.col("total") / F.lit(float(share))).cast("int").alias("parts"))
    placed = keep(join_hot(members, totals, "root", count), "join-placed")
    part = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    sets = blocks.select("nodes", "sizes", "tokens").mapInArrow(_unpacked(id_filter(placed.select("node"), count)), "node long, tokens binary")

    def gathered(goes: DataFrame) -> DataFrame:
        """Rows (bin, root, side, label) of nodes with their sets."""
        return sets.join(goes.withColumnRenamed("node", "_node"), F.col("node") == F.col("_node")).drop("_node")

    # The group's first set goes to every part.
    to = F.when((F.col("node") == F.col("root")) & (F.col("parts") > 1), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(part))
    alone = F.pmod(F.xxhash64("root"), F.lit(bins))
    bin_of = F.when(F.col("parts") == 1, alone).otherwise(bins + F.abs(F.xxhash64("root", "part") / 4).cast("long"))
    goes = placed.withColumn("part", F.explode(to)).select("node", "root", F.lit(0).alias("side"), bin_of.alias("bin"))
    found = keep(gathered(goes).groupBy("bin").applyInArrow(_compare(num, den), "a long, b long"), "join-links")
    large = placed.where("parts > 1")
    if not large.limit(1).count():
        discard(members, placed)
        return found.select(F.col("a").alias("id"), F.col("b").alias("root"))
    ties = components(found)
    labels = join_hot(placed, ties.select(F.col("id").alias("node"), F.col("root").alias("_label")), "node", count)
    labels = keep(labels.withColumn("label", F.coalesce("_label", "node")).drop("_label"), "join-labels")
    apart = labels.where("parts > 1").groupBy("root", "label").agg(F.count(F.lit(1)).alias("_in"), F.sum("n").alias("_n"))
    apart = apart.groupBy("root").agg(
        F.max(F.struct("_in", F.col("label").alias("largest"))).alias("_m"), F.count(F.lit(1)).alias("_several"), F.sum("_n").alias("_all"), F.max_by("_n", F.struct("_in", "label")).alias("_most")
    ).where("_several > 1")
    apart = keep(apart.select("root", F.col("_m.largest").alias("largest"), F.ceil((F.col("_all") - F.col("_most")) / F.lit(float(share))).cast("int").alias("asks")), "join-apart")
    edges = found
    if apart.limit(1).count():
        both = keep(join_hot(labels.where("parts > 1"), apart, "root").where("largest is not null"), "join-both")
        ask = F.pmod(F.xxhash64("node", F.lit(1)), F.col("asks")).cast("int")
        held = both.withColumn("ask", F.explode(F.sequence(F.lit(0), F.col("asks") - 1))).withColumn("part", part).withColumn("side", F.lit(0))
        asking = both.where("label <> largest").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("ask", ask).withColumn("side", F.lit(1))
        goes = held.unionByName(asking).select("node", "root", "side", "label", F.xxhash64("root", "ask", "part").alias("bin"))
        more = gathered(goes).groupBy("bin").applyInArrow(_ask(num, den), "a long, b long")
        edges = found.unionByName(keep(more, "join-more"))
    return components(edges)


def near_duplicates(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, n_shingles, class, component (both null for empty sets) and text id of every row.

    Documents link when den * |intersection| >= num * |union| of their n-gram sets. A
    component is named by the class of one of its sets.
    """
    spark = docs.sparkSession
    named = docs.select(docs[id_col].alias("id"), docs[text].alias("text"))
    run, schema = _classes(docs.schema[id_col].dataType.simpleString(), n)
    rows = keep(named.withColumn("tid", text_id(F.col("text"))).mapInArrow(run, schema), "join-rows")
    total, tokens = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()

    # Enough of the hash range that a set of new words shows its prefix's length of single tokens.
    sampled = min(1.0, 2.5 * (den - num) / den)
    limit = min(int(sampled * (1 << 64)), (1 << 64) - 1)
    buckets = buckets_for(spark, sampled * tokens, BUCKET_PLACES)
    places = named.select("text").mapInArrow(_sampled(n, limit, buckets), _PLACES)
    tied = places.groupBy("bucket").applyInArrow(_singles, _SINGLE).groupBy("chunk").applyInArrow(_tied(num, den), "cid binary, n long")
    alive = keep(tied.groupBy("cid").agg(F.max("n").alias("n")).withColumn("node", F.monotonically_increasing_id()), "join-tied")
    count, tokens = alive.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()

    # Fewer than HOT_KEYS classes: the driver may have them.
    copies = rows.where("cid is not null").groupBy("cid").agg(F.count(F.lit(1)).alias("_rows"), F.min("doc_id").alias("doc_id")).where(F.col("_rows") > share_of(total))
    holders = {bytes(r["cid"]): r["doc_id"] for r in copies.collect()}
    sets = named.mapInArrow(_sets(n, id_filter(alive.select("cid"), count), holders), "cid binary, tokens binary")
    sets = sets.join(alive.select(F.col("cid").alias("_cid"), "node"), F.col("cid") == F.col("_cid")).select("node", "tokens")
    blocks = keep(sets.mapInArrow(_blocks, _BLOCK), "join-blocks")

    buckets = buckets_for(spark, tokens, BUCKET_PLACES)
    classes = blocks.select("block", "tokens").mapInArrow(_spread(buckets), _BLOCK).groupBy("bucket").applyInArrow(_frequencies, _BLOCK)
    postings = keep(blocks.unionByName(classes).groupBy("block").applyInArrow(_prefixes(num, den, buckets), "ord int, node long, token long"), "join-postings")
    groups = shared_under_both(postings)
    discard(postings)
    roots = _verified(blocks, groups, alive, num, den)
    name = alive.select(F.col("node").alias("_root"), F.col("cid").alias("component"))
    linked_classes = roots.join(alive, F.col("id") == F.col("node")).join(name, F.col("root") == F.col("_root")).select("cid", "component")
    out = join_hot(rows, linked_classes, "cid", total)
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.col("cid").alias("class"), F.coalesce("component", "cid").alias("component"), "tid")


def text_id(text: Column) -> Column:
    """A text's 128-bit id; null and empty ones have the same."""
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def one_of_each(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The rows of docs with one of each component: the least id, then the least text id.

    Rows with empty sets all stay. Of rows that agree in id and text one stays.
    """
    found = keep(near_duplicates(docs, n, num, den, text, id_col), "join-found")
    stays = found.where("component is not null").groupBy("component").agg(F.min(F.struct("doc_id", "tid")).alias("_s"), F.count(F.lit(1)).alias("_rows"))
    stays = stays.select(F.col("_s.doc_id").alias("_stay_id"), F.col("_s.tid").alias("_stay_tid"), (F.col("_rows") > 1).alias("_several"))
    empty = found.where("component is null").select(F.col("doc_id").alias("_stay_id"), F.col("tid").alias("_stay_tid")).distinct()
    stays = stays.unionByName(empty.withColumn("_several", F.lit(False)))
    marked = docs.withColumn("_own_tid", text_id(F.col(text)))
    left = marked.join(stays, F.col(id_col).eqNullSafe(F.col("_stay_id")) & (F.col("_own_tid") == F.col("_stay_tid")))
    left = keep(left.drop("_stay_id", "_stay_tid"), "join-left")
    again = left.where("_several").groupBy(F.col(id_col).alias("_id"), F.col("_own_tid").alias("_t")).count().where("count > 1").limit(1).count()
    if again:
        left = left.where("not _several").unionByName(left.where("_several").dropDuplicates([id_col, "_own_tid"]))
    return left.select(*docs.columns)


def with_component_ids(found: DataFrame) -> DataFrame:
    """Adds component_id: the smallest doc_id of the component, a row's own for empty sets."""
    found = keep(found, "join-found")
    least = found.where("component is not null").groupBy("component").agg(F.min("doc_id").alias("_least"))
    out = join_hot(found, least, "component")
    return out.select("doc_id", "n_shingles", F.coalesce("_least", "doc_id").alias("component_id"), "class")


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 3-word shingles are 90 % alike or more."""
    return with_component_ids(near_duplicates(read(spark, sf_dir, "documents"), 3, 90, 100)).drop("class")
