"""Near-duplicate join on word n-grams by a prefix tree over globally ordered sets.

A document is the set of its distinct k-word shingles. Two documents link when den * intersection >= num * union.

1. Documents with equal sets are one node. One pass over the texts gives each document its set's size and key.
2. One global order of shingles: frequent ones last, else by hash. Document frequencies are counted over all
   documents; the frequent ones are marked in a bitmap of fixed size. (A false mark only moves a shingle in the order,
   for every document alike, so results do not depend on the bitmap.)
3. Linked sets share a shingle among the first n - ceil(n * num / den) + 1 of either. Each shingle there gives its
   sets the least of them as centre; the distinct (centre, set) pairs are the groups. Both ends of every link are
   in one group at least. Many postings of one shingle in a batch are posted as one range of sizes, and join its centre
   afterwards by the range's name, so a shingle of a third of all sets sends a task a few numbers a batch.
4. A group, in blocks of bounded size, goes into a prefix tree of its ordered sets. Each set walks the tree: the overlap
   with a shared path is counted once, and a subtree ends the walk where the overlap so far and what remains of both
   cannot reach the bound, or where all its sets are in the walker's component already. A walk that reaches the
   end of a set, a leaf or a node that longer sets begin with, has its exact intersection.
5. Links join into components by least label with shortcuts. A group of several blocks whose sets aren't all in one
   component yet compares the sets outside its largest component with all its blocks, so no link is lost.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arachne.llm.hashing import U, mix, runs, set_key, shingle_sets
from arachne.llm.shared import cut, small_batches

BITS = 26
#: Marks in a bitmap at most, so that few are false.
MARKS = 1 << 21
#: Shingles a block of a group holds, about, and sets.
BLOCK = 1 << 19
SETS = 128
#: A key of more than one row in so many is joined by broadcast: so many keys at most. Keys of few rows never are.
HOT, LEAST_HOT = 2000, 100
#: Edges that one task labels.
FEW = 1 << 19
#: So many postings of a shingle and of sizes that can link, in one batch, are posted as one.
LOCAL = 16
_SEGMENT = 1 << 16


def _signed(a: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(a).view(np.int64))


def bitmap(hashes: DataFrame, name: str) -> np.ndarray:
    """A bitmap of 2^BITS bits (8 MB at any input size) with a bit for each 64-bit hash in the column `name`."""

    def local(batches):
        packed = np.zeros((1 << BITS) // 8, np.uint8)
        for b in batches:
            at = np.unique(b.column(0).to_numpy(zero_copy_only=False).view(np.uint64) >> U(64 - BITS))
            place = (at >> U(3)).astype(np.int64)
            firsts = np.flatnonzero(np.append(True, place[1:] != place[:-1])) if len(at) else np.zeros(0, np.int64)
            if len(at):
                packed[place[firsts]] |= np.bitwise_or.reduceat(np.uint8(128) >> (at & U(7)).astype(np.uint8), firsts)
        packed = packed.reshape(-1, _SEGMENT // 8)
        used = np.flatnonzero(packed.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array([packed[i].tobytes() for i in used], pa.binary())], ["segment", "bits"])

    def merge(batches):
        for t in runs(batches, ("segment",)):
            out = np.zeros(_SEGMENT // 8, np.uint8)
            for x in t.column("bits").to_pylist():
                out |= np.frombuffer(x, np.uint8)
            yield pa.RecordBatch.from_arrays([t.column("segment").combine_chunks()[:1], pa.array([out.tobytes()], pa.binary())], ["segment", "bits"])

    parts = hashes.select(name).filter(F.col(name).isNotNull()).mapInArrow(local, "segment int, bits binary")
    parts = parts.repartition("segment").sortWithinPartitions("segment").mapInArrow(merge, "segment int, bits binary")
    out = np.zeros((1 << BITS) // 8, np.uint8).reshape(-1, _SEGMENT // 8)
    for r in parts.collect():  # 1024 rows of 8 KB at most
        out[r.segment] = np.frombuffer(bytes(r.bits), np.uint8)
    return out.reshape(-1)


def _marked(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = hashes >> U(64 - BITS)
    return (bits[at >> U(3)] >> (U(7) - (at & U(7))).astype(np.uint8)) & 1 == 1


def _ordered(tokens: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Sorted names of the shingles in the global order: marked ones after all others."""
    return np.sort((tokens >> U(1)) | (_marked(bits, tokens).astype(np.uint64) << U(63)))


def _prefix(n: int, num: int, den: int) -> int:
    return n - -(-n * num // den) + 1


class _Trie:
    """A prefix tree with compressed paths over distinct ordered sets, which are kept in path order."""

    def __init__(self, sets: list[np.ndarray]):
        self.order = sorted(range(len(sets)), key=lambda i: sets[i].astype(">u8").tobytes())
        self.sets = [sets[i] for i in self.order]
        self.size = np.array([len(s) for s in self.sets], dtype=np.int64)
        # node: first and last set, depth where its path begins and ends, children; of a node whose path is a whole set
        # that set is the first
        self.nodes: list[list] = []
        self.root = self._build()

    def _build(self) -> int:
        sets = self.sets
        common = [0] * len(sets)
        for i in range(1, len(sets)):
            a, b = sets[i - 1], sets[i]
            m = min(len(a), len(b))
            differ = a[:m] != b[:m]
            common[i] = int(differ.argmax()) if differ.any() else m
        root = self._node(0, 0)
        path = [root]
        for i, s in enumerate(sets):
            last = None
            while self.nodes[path[-1]][3] > common[i]:
                last = path.pop()
                self.nodes[last][1] = i
            top = self.nodes[path[-1]]
            if last is not None:
                if top[3] < common[i]:  # a branch inside the path of `last`
                    middle = self._node(self.nodes[last][0], common[i])
                    top[4][-1] = middle
                    self.nodes[middle][4].append(last)
                    self.nodes[middle][2] = top[3]
                    self.nodes[last][2] = common[i]
                    path.append(middle)
            leaf = self._node(i, len(s))
            self.nodes[leaf][2] = self.nodes[path[-1]][3]
            self.nodes[path[-1]][4].append(leaf)
            path.append(leaf)
        for k in path:
            self.nodes[k][1] = len(sets)
        for node in self.nodes:
            a = self.size[node[0] : node[1]]
            node[5:] = [int(a.min()), int(a.max())] if len(a) else [0, 0]
        return root

    def _node(self, first: int, end: int) -> int:
        self.nodes.append([first, first, 0, end, [], 0, 0])
        return len(self.nodes) - 1

    def walk(self, x: np.ndarray, num: int, den: int, after: int, skip: np.ndarray | None) -> Iterator[int]:
        """Indexes from `after` on, in path order, of sets that x links with; sets where skip is true are left out, also those that it becomes true for during the walk."""
        nx = len(x)
        stack = [(self.root, 0)]
        while stack:
            k, overlap = stack.pop()
            first, last, begin, end, children, least, most = self.nodes[k]
            if last <= after or not nx:
                continue
            if (num + den) * min(nx, most) < num * (nx + most) and nx > most or (num + den) * nx < num * (nx + least):
                continue
            if skip is not None and skip[max(first, after) : last].all():
                continue
            left = nx
            if end > begin:
                part = self.sets[first][begin:end]
                at = np.searchsorted(x, part)
                at[at == nx] = nx - 1
                overlap += int((x[at] == part).sum())
                left = nx - int(np.searchsorted(x, part[-1], side="right"))
            if (num + den) * (overlap + min(left, most - end)) < num * (nx + least):
                continue
            # a set that ends here; others may begin with it
            if self.size[first] == end and first >= after and (num + den) * overlap >= num * (nx + end):
                yield first
            stack.extend((c, overlap) for c in children)


def trie_links(sets: list[np.ndarray], num: int, den: int) -> list[tuple[int, int]]:
    """Links among distinct ordered sets, enough to connect all that links connect."""
    trie = _Trie(sets)
    label = np.arange(len(sets))
    links = []
    for i, x in enumerate(trie.sets):
        if (label == label[0]).all():
            break
        skip = label == label[i]
        for j in trie.walk(x, num, den, i + 1, skip):
            if label[j] != label[i]:
                links.append((trie.order[i], trie.order[j]))
                label[label == label[j]] = label[i]
                skip[:] = label == label[i]
    return links


def cross_links(probes: list[np.ndarray], probe_labels: list, sets: list[np.ndarray], labels: list, num: int, den: int) -> list[tuple[int, int]]:
    """Links between probes and sets of other labels, enough to connect the labels that they connect."""
    trie = _Trie(sets)
    numbers = {v: k for k, v in enumerate(dict.fromkeys([*labels, *probe_labels]))}
    label = np.array([numbers[labels[i]] for i in trie.order])
    parent = np.arange(len(numbers))
    links = []
    for p, x in enumerate(probes):
        own = numbers[probe_labels[p]]
        skip = parent[label] == parent[own]
        for j in trie.walk(x, num, den, 0, skip):
            if parent[label[j]] != parent[own]:
                links.append((p, trie.order[j]))
                parent[parent == parent[label[j]]] = parent[own]
                skip[:] = parent[label] == parent[own]
    return links


def _least_reached(u: pa.Array, v: pa.Array) -> tuple[pa.Array, pa.Array]:
    """Nodes of an edge list, and the least node that each reaches."""
    nodes = pa.concat_arrays([u, v]).unique()
    nodes = nodes.take(pc.array_sort_indices(nodes))
    a, b = (pc.index_in(x, nodes).to_numpy() for x in (u, v))
    label = np.arange(len(nodes))
    while True:
        low = label.copy()
        np.minimum.at(low, a, label[b])
        np.minimum.at(low, b, label[a])
        low = low[low]
        if (low == label).all():
            return nodes, nodes.take(pa.array(label))
        label = low


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label): the least node that edges reach from each node that has an edge.

    Up to FEW edges, some 16 MB, are one task's; more are labelled over all tasks by least labels with shortcuts, of which each round is a
    checkpoint. Both give the same.
    """
    pairs = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u <> v")
    pairs = cut(pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    if pairs.count() <= FEW:
        kind = edges.schema[a].dataType.simpleString()

        def labelled(batches):
            found = [(x.column("u"), x.column("v")) for x in batches if x.num_rows]
            if found:
                nodes, labels = _least_reached(*(pa.concat_arrays(x) for x in zip(*found, strict=True)))
                yield pa.RecordBatch.from_arrays([nodes, labels], ["node", "label"])

        return cut(pairs.coalesce(1).mapInArrow(labelled, f"node {kind}, label {kind}"))
    pairs = cut(pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))))
    labels = cut(pairs.groupBy(F.col("u").alias("node")).agg(F.least(F.col("node"), F.min("v")).alias("label")))
    while True:
        near = pairs.join(labels.withColumnRenamed("node", "v"), "v").groupBy(F.col("u").alias("node")).agg(F.min("label").alias("low"))
        lower = labels.join(near, "node").select("node", F.col("label").alias("was"), F.least("label", "low").alias("label"))
        jump = lower.select(F.col("node").alias("label"), F.col("label").alias("via"))
        new = cut(lower.join(jump, "label", "left").select("node", "was", F.least("label", F.coalesce("via", "label")).alias("label")))
        labels = new.select("node", "label")
        if not new.filter("was <> label").head(1):
            return labels


def _spread_join(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """rows joined to a table of one row a key. Rows of hot keys, which may be most of all, stay where they are: their rows of the table are
    broadcast. The others meet by a shuffle in which no key is large."""
    counts = rows.groupBy(key).agg(F.count("*").alias("_c"))
    total = rows.count()
    hot = [r[0] for r in counts.filter(F.col("_c") > max(LEAST_HOT, total // HOT)).select(key).collect()]  # HOT keys at most
    if not hot:
        return rows.join(table, key)
    keys = F.broadcast(rows.sparkSession.createDataFrame([(k,) for k in hot], f"{key} {rows.schema[key].dataType.simpleString()}"))
    few = rows.join(keys, key, "left_anti").join(table, key)
    return few.unionByName(rows.join(F.broadcast(table.join(keys, key, "left_semi")), key))


def _size_runs(tokens: np.ndarray, least: np.ndarray, most: np.ndarray, num: int, den: int) -> np.ndarray:
    """Where runs start: of one token, sizes from `least` to `most` (sorted by token and least) of which each can link with
    one before it. What stands for many sizes of one run starts and ends runs as they would."""
    if not len(tokens):
        return np.zeros(0, np.int64)
    new = np.ones(len(tokens), dtype=bool)
    new[1:] = tokens[1:] != tokens[:-1]
    base = np.cumsum(new) << 32
    reached = np.maximum.accumulate(base + most.astype(np.int64)) - base
    new[1:] |= den * reached[:-1] < num * least[1:].astype(np.int64)
    return np.flatnonzero(new)


def _kinds(kind: int, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int32)), _signed(a), _signed(b)], ["kind", "a", "b"])


def _dealt(tokens: np.ndarray, shift: np.uint64, columns: dict[str, np.ndarray], after: int = 0) -> Iterator[pa.RecordBatch]:
    """One row for each part of the hash space that sorted `tokens` reach, its columns cut alike and packed; `after` is
    added to the numbers of parts."""
    if not len(tokens):
        return
    part = (tokens >> shift).astype(np.int64) + after
    cuts = np.flatnonzero(np.diff(part)) + 1
    firsts = [0, *cuts.tolist()]
    rows = [pa.array([int(part[i]) for i in firsts], pa.int32())]
    rows += [pa.array([x.tobytes() for x in np.split(c, cuts)], pa.binary()) for c in columns.values()]
    yield pa.RecordBatch.from_arrays(rows, ["part", *columns])


def _joined(t: pa.Table, name: str, kind) -> np.ndarray:
    return np.frombuffer(b"".join(t.column(name).to_pylist()), kind)


def _pairs(links: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[0] for x in links], pa.binary()), pa.array([x[1] for x in links], pa.binary())], ["a", "b"])


def link_components(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text", common: int = 4) -> DataFrame:
    """(id, n_shingles, component_id) for each row of docs. component_id is the least id that links reach.

    Words are lower-cased (A-Z). A text of fewer than k words has its whole sequence as its only shingle; one without
    words (null and empty too) has none and links with nothing: its component is itself. A null id is no component's
    name: such rows take no part and get a null component. Repeated ids keep a row each. Other columns are ignored.
    `common`: a shingle of so many sets counts as frequent; the bound rises while the marks don't fit the bitmap.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    texts = docs.filter("id is not null").select("text")
    kind = docs.schema["id"].dataType.simpleString()

    def profile(batches):
        for b in batches:
            n, h1, key = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, np.int64), [b""] * b.num_rows
            for row, s in shingle_sets(b.column("text"), k):
                n[row], h1[row], key[row] = len(s), *named(s)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(n), pa.array(h1), pa.array(key, pa.binary())], ["id", "n", "h1", "key"])

    def named(s: np.ndarray) -> tuple[int, bytes]:
        a, b = set_key(s)
        return a, a.to_bytes(8, "big", signed=True) + b.to_bytes(8, "big", signed=True)

    def distinct_sets(batch, seen: set):
        """Sets that this task has not met before."""
        for _, s in shingle_sets(batch.column("text"), k):
            if len(s):
                h1, key = named(s)
                if key not in seen:
                    seen.add(key)
                    yield h1, key, s

    profiles = cut(docs.mapInArrow(profile, f"id {kind}, n bigint, h1 bigint, key binary"))
    live = profiles.filter("n > 0 and id is not null")
    sizes = live.groupBy("h1", "key").agg(F.max("n").alias("n"))
    total = live.agg(F.sum("n")).first()[0] or 0
    share = min(1.0, 2 * (1 - num / den) + 0.02)
    parts = 1 << max(4, math.ceil(math.log2(max(1, share * total / 500_000))))
    shift = U(64 - int(math.log2(parts)))

    def counted(batches):
        seen: set = set()
        for b in batches:
            some = [s[: 2 * _prefix(len(s), num, den) + 1] for _, _, s in distinct_sets(b, seen)]
            if some:
                tokens, n = np.unique(np.concatenate(some), return_counts=True)
                yield from _dealt(tokens, shift, {"tokens": tokens, "counts": n.astype(np.uint32)})

    def frequent(batches):
        for t in runs(batches, ("part",)):
            tokens, back = np.unique(_joined(t, "tokens", np.uint64), return_inverse=True)
            n = np.bincount(back, weights=_joined(t, "counts", np.uint32)).astype(np.int64)
            keep = n >= common
            yield pa.RecordBatch.from_arrays([_signed(tokens[keep]), pa.array(n[keep])], ["token", "n"])

    often = cut(texts.mapInArrow(counted, "part int, tokens binary, counts binary").repartition(parts, "part").sortWithinPartitions("part").mapInArrow(frequent, "token bigint, n bigint"))
    least, marks = common, 0
    for r in sorted(often.groupBy(F.floor(F.log2("n")).alias("e")).count().collect(), reverse=True):  # a row for each power of two
        marks += r["count"]
        if marks > MARKS:
            least = 2 << r["e"]
            break
    bits = spark.sparkContext.broadcast(bitmap(often.filter(F.col("n") >= least), "token"))

    def postings(batches):
        seen: set = set()
        for b in batches:
            cols: list[list] = [[], [], [], []]
            for h1, _, s in distinct_sets(b, seen):
                p = _prefix(len(s), num, den)
                for c, x in zip(cols, (_ordered(s, bits.value)[:p], np.full(p, h1, np.int64), np.full(p, len(s), np.uint32), np.arange(p, dtype=np.uint32)), strict=True):
                    c.append(x)
            if cols[0]:
                tokens, owners, n, at = map(np.concatenate, cols)
                tokens = mix(tokens)
                by = np.lexsort((n, tokens))
                tokens, owners, n, at = tokens[by], owners[by], n[by], at[by]
                starts = _size_runs(tokens, n, n, num, den)
                lengths = np.diff(np.append(starts, len(tokens)))
                many = lengths >= LOCAL
                alone = ~np.repeat(many, lengths)
                none = np.zeros(0, np.uint64)
                yield from _dealt(tokens[alone], shift, {"tokens": tokens[alone], "owners": owners[alone], "n": n[alone], "at": at[alone], "names": none})
                if many.any():
                    # a run's name comes from its shingle and its members
                    names = mix(tokens[starts] ^ mix(np.add.reduceat(mix(owners.view(np.uint64)), starts)))[many]
                    first, last = starts[many], (starts + lengths - 1)[many]
                    yield from _dealt(tokens[first], shift, {"tokens": tokens[first], "owners": np.minimum.reduceat(owners, starts)[many], "n": n[first], "at": n[last], "names": names})
                    names, owners = np.repeat(names, lengths[many]), owners[~alone]
                    by = np.argsort(names)
                    yield from _dealt(names[by], shift, {"tokens": names[by], "owners": owners[by], "n": none, "at": none, "names": none}, parts)

    def centred(batches):
        """kind 0: a centre and a set; 1: a centre and the name of a run; 2: the name of a run and a set."""
        for t in runs(batches, ("part",)):
            if t.column("part")[0].as_py() >= parts:
                yield _kinds(2, _joined(t, "tokens", np.uint64), _joined(t, "owners", np.int64))
                continue
            whole = pc.greater(pc.binary_length(t.column("names")), 0)
            t = pa.concat_tables([t.filter(pc.invert(whole)), t.filter(whole)])
            tokens, owners, names = _joined(t, "tokens", np.uint64), _joined(t, "owners", np.int64), _joined(t, "names", np.uint64)
            n, at = _joined(t, "n", np.uint32).astype(np.int64), _joined(t, "at", np.uint32).astype(np.int64)
            names = np.concatenate([np.zeros(len(tokens) - len(names), np.uint64), names])
            local = np.arange(len(tokens)) >= len(tokens) - len(_joined(t, "names", np.uint64))
            by = np.lexsort((local, owners, n, tokens))
            tokens, owners, n, at, names, local = tokens[by], owners[by], n[by], at[by], names[by], local[by]
            # a copy that another task met; then runs of one shingle whose neighbours in size can link
            new = np.ones(len(tokens), dtype=bool)
            new[1:] = (tokens[1:] != tokens[:-1]) | (owners[1:] != owners[:-1]) | local[1:]
            tokens, owners, n, at, names, local = tokens[new], owners[new], n[new], at[new], names[new], local[new]
            if not len(tokens):
                continue
            starts = _size_runs(tokens, n, np.where(local, at, n), num, den)
            rows = np.diff(np.append(starts, len(tokens)))
            lengths = np.add.reduceat(np.where(local, LOCAL, 1), starts)
            # of a run of two: this shingle and all that follow it must suffice
            two = starts[lengths == 2]
            reach = np.minimum(n[two] - at[two], n[two + 1] - at[two + 1])
            lengths[np.flatnonzero(lengths == 2)[(num + den) * reach < num * (n[two] + n[two + 1])]] = 1
            run = np.repeat(np.arange(len(starts)), rows)
            centre = np.minimum.reduceat(owners, starts)[run]
            yield _kinds(1, centre[local], names[local])
            apart = (lengths[run] > 1) & (owners != centre) & ~local
            centre, owners = centre[apart], owners[apart]
            by = np.lexsort((owners, centre))
            centre, owners = centre[by], owners[by]
            fresh = np.ones(len(owners), dtype=bool)
            fresh[1:] = (centre[1:] != centre[:-1]) | (owners[1:] != owners[:-1])
            yield _kinds(0, centre[fresh], owners[fresh])

    posted = texts.mapInArrow(postings, "part int, tokens binary, owners binary, n binary, at binary, names binary").repartition(parts, "part").sortWithinPartitions("part")
    posted = cut(posted.mapInArrow(centred, "kind int, a bigint, b bigint"))
    named_runs = posted.filter("kind = 1").select(F.col("b").alias("run"), F.col("a").alias("centre")).distinct()
    by_run = posted.filter("kind = 2").select(F.col("a").alias("run"), F.col("b").alias("h1")).join(named_runs, "run").select("centre", "h1").filter("centre <> h1")
    near = cut(posted.filter("kind = 0").select(F.col("a").alias("centre"), F.col("b").alias("h1")).union(by_run).distinct())
    everyone = near.union(near.select("centre", F.col("centre").alias("h1")).distinct())
    members = cut(everyone.join(sizes, "h1").select("centre", "key", "h1", "n"))
    groups = members.groupBy("centre").agg((F.greatest(F.floor(F.sum("n") / F.lit(BLOCK)), F.floor(F.count("*") / F.lit(SETS))) + 1).cast("int").alias("blocks"))
    salt = F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")
    # a centre stands in every block of its group
    plan = _spread_join(members, groups, "centre").select("centre", "key", "blocks", F.explode(F.when(F.col("h1") == F.col("centre"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(salt))).alias("block"))
    plan = cut(plan)
    def ordered_sets(wanted: DataFrame) -> DataFrame:
        """(key, tokens) of the sets whose h1 is in `wanted`, and of a few more that its bitmap can't tell from them."""
        chosen = spark.sparkContext.broadcast(bitmap(wanted, "h1"))

        def shipped(batches):
            seen: set = set()
            for b in batches:
                keys, tokens = [], []
                for h1, key, s in distinct_sets(b, seen):
                    if _marked(chosen.value, np.array([h1]).view(np.uint64))[0]:
                        keys.append(key)
                        tokens.append(_ordered(s, bits.value).tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(tokens, pa.binary())], ["key", "tokens"])

        return texts.mapInArrow(shipped, "key binary, tokens binary").groupBy("key").agg(F.first("tokens").alias("tokens"))

    sets = ordered_sets(members)

    def block_links(batches):
        for t in runs(batches, ("centre", "block")):
            keys, found = t.column("key").to_pylist(), [np.frombuffer(x, np.uint64) for x in t.column("tokens").to_pylist()]
            yield _pairs([(keys[i], keys[j]) for i, j in trie_links(found, num, den)])

    run = plan.select("centre", "block", "key").join(sets, "key").repartition("centre", "block").sortWithinPartitions("centre", "block")
    links = cut(run.select("centre", "block", "key", "tokens").mapInArrow(block_links, "a binary, b binary"))
    labels = components(links)
    large = plan.filter("blocks > 1").select("centre", "blocks", "key").distinct().join(labels.withColumnRenamed("node", "key"), "key", "left").withColumn("label", F.coalesce("label", "key"))
    votes = large.groupBy("centre", "label").count()
    first = votes.groupBy("centre").agg(F.max_by("label", F.struct("count", "label")).alias("top"))
    large = cut(large.join(first, "centre"))
    outside = large.filter("label <> top")
    if outside.head(1):
        chunks = outside.join(sizes.select("key", "n"), "key").groupBy("centre").agg((F.greatest(F.floor(F.sum("n") / F.lit(BLOCK)), F.floor(F.count("*") / F.lit(SETS))) + 1).cast("int").alias("chunks"))
        dealt = large.join(chunks, "centre").withColumn("own", F.pmod(F.xxhash64("key"), "chunks").cast("int"))
        probes = dealt.filter("label <> top").select("centre", F.col("own").alias("chunk"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "key", "label", F.lit(True).alias("probe"))
        bases = dealt.select("centre", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), salt.alias("block"), "key", "label", F.lit(False).alias("probe"))

        def rest_links(batches):
            for t in runs(batches, ("centre", "chunk", "block")):
                keys, marks, which = t.column("key").to_pylist(), t.column("label").to_pylist(), t.column("probe").to_pylist()
                found = [np.frombuffer(x, np.uint64) for x in t.column("tokens").to_pylist()]
                p, q = [i for i, w in enumerate(which) if w], [i for i, w in enumerate(which) if not w]
                if p and q:
                    pick = lambda a, at: [a[i] for i in at]
                    yield _pairs([(keys[p[i]], keys[q[j]]) for i, j in cross_links(pick(found, p), pick(marks, p), pick(found, q), pick(marks, q), num, den)])

        # only the sets of groups that are still apart are made and dealt again
        sets = ordered_sets(dealt.select("key").distinct().join(sizes, "key"))
        run = probes.unionByName(bases).join(sets, "key").repartition("centre", "chunk", "block").sortWithinPartitions("centre", "chunk", "block")
        more = run.select("centre", "chunk", "block", "key", "label", "probe", "tokens").mapInArrow(rest_links, "a binary, b binary")
        labels = components(cut(links.union(more)))
    named_by = live.groupBy("key").agg(F.min("id").alias("least")).join(labels.withColumnRenamed("node", "key"), "key", "left").withColumn("label", F.coalesce("label", "key"))
    ids = named_by.join(named_by.groupBy("label").agg(F.min("least").alias("component_id")), "label").select("key", "component_id")
    out = live.select("id", "n", "key").join(ids, "key").select("id", "n", "component_id")
    rest = profiles.filter("n = 0 or id is null").select("id", "n", F.col("id").alias("component_id"))
    return out.union(rest).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")
