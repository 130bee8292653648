"""N-gram Jaccard join with prefix trees.

Two texts link when the Jaccard similarity of their sets of distinct word n-grams reaches a percentage.
Texts with equal sets are one class. Classes that may link are brought together by signatures, without
loss: sets at the threshold differ in at most D n-grams, so of D + 1 parts of the hash space at least one
is the same in both. Sets of like size that share a signature, directly or in a chain, form a group; a set
is in the groups of its own and of the next size class. Each group
is joined in a prefix tree: sets are stored as paths of globally ordered (by hash) n-grams, a probe walks
the tree sharing the overlap of common paths, and leaves a subtree when the remaining n-grams cannot
reach the threshold or when the subtree is already in its component. Groups too large for a task grow by
chance chains, much faster than the corpus: their sets meet by signature instead, in stars around the
smallest set of each, as long as that sends less than joining the group block by block.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortweave.llm.chunks import slices
from cohortweave.llm.components import components
from cohortweave.session import by_shuffle, materialise, materialise_counted, sided

GROUP_GRAMS = 1_000_000  # n-grams in a block
SEEDS = 40
U64 = np.uint64
EVEN, ODD = U64(0x9E3779B97F4A7C15), U64(0xBF58476D1CE4E5B9)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = (x ^ (x >> U64(30))) * ODD
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def gram_set(text: str, n: int) -> np.ndarray:
    """Sorted hashes of the distinct n-word shingles; with fewer words the whole sequence is the one.

    Words are runs without ASCII white space; A-Z are lower-cased.
    """
    words = text.encode().lower().split()
    if not words:
        return np.zeros(0, U64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), U64, len(words))
    k = min(n, len(words))
    out = np.full(len(h) - k + 1, U64(k))
    for i in range(k):
        out = out * EVEN + h[i:len(h) - k + 1 + i]
    return np.unique(mix(out))


def digest(grams: np.ndarray) -> tuple[int, int]:
    """Two 64-bit keys of a set."""
    a, b = mix(grams ^ EVEN).sum(dtype=U64), mix(grams + ODD).sum(dtype=U64)
    return signed(a), signed(b)


def signed(x: np.uint64) -> int:
    return int(np.asarray(x).astype(np.int64))


@dataclass
class Classes:
    """Size classes and their numbers of parts. Linked sets are in the same or in neighbouring classes."""
    percent: int
    low: list[int] = field(default_factory=lambda: [1])
    high: list[int] = field(default_factory=list)

    def of(self, size: int) -> int:
        while not self.high or self.high[-1] < size:
            self.high.append(self.low[-1] * 100 // self.percent)
            self.low.append(self.high[-1] + 1)
        return int(np.searchsorted(self.high, size))

    def parts(self, c: int) -> tuple[int, int]:
        """(parts, spare) for pairs whose larger set is in class c: at most parts - spare - 1 n-grams
        differ, so more than `spare` parts agree; 0 parts if linked sets must be equal."""
        self.of(self.low[c] if c < len(self.low) else self.high[-1] + 1)
        while len(self.high) <= c:
            self.of(self.high[-1] + 1)
        differ = (100 - self.percent) * 2 * self.high[c] // (100 + self.percent)
        if not differ:
            return 0, 0
        expected = (differ + 1) * (1 - 1 / (differ + 1)) ** self.low[max(0, c - 1)]
        spare = int(np.ceil(expected + 2 * np.sqrt(expected))) if expected > 0.2 else 0
        return differ + 1 + spare, spare


def class_key(digest1: int, c: int) -> int:
    """Key of a set within a size class."""
    return signed(mix(np.array([(digest1 + (c + 1) * int(EVEN)) & (1 << 64) - 1], U64))[0])


def signatures(grams: np.ndarray, classes: Classes) -> list[tuple[int, np.ndarray]]:
    """(size class, signatures) of a set such that linked sets that are not equal share at least one.

    A part's signature hashes its n-grams. Empty parts say nothing, so they are left out; a set with more
    empty parts than are spare gets another division of the hash space besides. If two sets agree in
    empty parts alone, both have too many, and both go on. After SEEDS divisions empty parts count too.
    """
    own = classes.of(len(grams))
    out = []
    for c in (own, own + 1):
        parts, spare = classes.parts(c)
        if not parts:
            continue
        said = []
        for seed in range(SEEDS):
            h = np.sort(mix(grams + U64((seed + 1) * int(EVEN) & (1 << 64) - 1)))
            part = ((h >> U64(32)) * U64(parts)) >> U64(32)
            starts = np.flatnonzero(np.diff(part, prepend=U64(parts)))
            sums = np.add.reduceat(mix(h ^ ODD), starts)
            salt = U64((c << 16) | seed)
            said.append(mix(sums + mix(part[starts] + mix(np.array([salt]) + EVEN))))
            if parts - len(starts) <= spare:
                break
        else:
            empty = np.setdiff1d(np.arange(parts, dtype=U64), part[starts])
            said.append(mix(mix(empty + mix(np.array([salt]) + EVEN)) + ODD))
        out.append((c, np.concatenate(said)))
    return out


@dataclass
class Node:
    path: np.ndarray  # the n-grams between the parent and this node
    low: int
    high: int  # smallest and largest set below
    leaf: int  # some set below
    ends: list[int] = field(default_factory=list)  # sets that end here
    children: dict[int, Node] = field(default_factory=dict)
    mixed: bool = False  # sets below may be in different components


class PrefixTree:
    """Joins sets one by one with those before it; keeps components and one link for every merge."""

    def __init__(self, percent: int):
        self.percent = percent
        self.root = Node(np.zeros(0, U64), 1 << 62, 0, -1, mixed=True)
        self.parent: list[int] = []
        # the root's branches by the n-grams in their sets' prefixes: two linked sets share one of their
        # first n - ceil(threshold * n) + 1 n-grams
        self.branches: dict[int, set[int]] = {}

    def prefix(self, grams: np.ndarray) -> list[int]:
        n = len(grams)
        return grams[:n + 1 + -self.percent * n // 100].tolist()

    def find(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def add(self, grams: np.ndarray) -> list[tuple[int, int]]:
        """Insert a set; the links (new set, earlier set) that merged components."""
        me = len(self.parent)
        self.parent.append(me)
        links = self.probe(grams, me)
        self.insert(grams, me)
        return links

    def probe(self, grams: np.ndarray, me: int) -> list[tuple[int, int]]:
        p, n, links = self.percent, len(grams), []
        begun = set().union(*(self.branches[g] for g in self.prefix(grams) if g in self.branches))
        stack = [(self.root.children[first], 0, 0) for first in begun]
        while stack:
            node, depth, overlap = stack.pop()
            if node.high * 100 < p * n or n * 100 < p * node.low:
                continue
            if not node.mixed and self.find(node.leaf) == self.find(me):
                continue
            at = np.searchsorted(grams, node.path)
            overlap += int(np.count_nonzero(grams[np.minimum(at, n - 1)] == node.path))
            depth += len(node.path)
            left = n - int(np.searchsorted(grams, node.path[-1], side="right"))
            most = overlap + min(left, node.high - depth)
            if most * (100 + p) < p * (n + node.low):
                continue
            for other in node.ends:
                if overlap * (100 + p) >= p * (n + depth) and self.find(other) != self.find(me):
                    links.append((me, other))
                    self.parent[self.find(other)] = self.find(me)
            stack.extend((child, depth, overlap) for child in node.children.values())
        return links

    def insert(self, grams: np.ndarray, me: int) -> None:
        node, at, n = self.root, 0, len(grams)
        for g in self.prefix(grams):
            self.branches.setdefault(g, set()).add(int(grams[0]))
        while True:
            node.low, node.high = min(node.low, n), max(node.high, n)
            node.mixed = node.mixed or self.find(node.leaf) != self.find(me)
            if at == n:
                node.ends.append(me)
                return
            child = node.children.get(int(grams[at]))
            if child is None:
                node.children[int(grams[at])] = Node(grams[at:], n, n, me, ends=[me])
                return
            rest = grams[at:at + len(child.path)]
            same = child.path[:len(rest)] == rest
            keep = len(rest) if same.all() else int(np.argmin(same))
            if keep < len(child.path):
                upper = Node(child.path[:keep], child.low, child.high, child.leaf, mixed=child.mixed)
                child.path = child.path[keep:]
                upper.children[int(child.path[0])] = child
                node.children[int(grams[at])] = upper
                child = upper
            node, at = child, at + keep


def key_of(a: Column, b: Column) -> Column:
    return F.concat(F.lpad(F.hex(a), 16, "0"), F.lpad(F.hex(b), 16, "0"))




def described(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """doc_id, row, size, d1, d2 and keys (of d1 in both size classes): each row's set, stored."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = Classes(percent)
        for rows in slices(batches, 2):
            sets = [gram_set(t, n) for _, _, t in rows]
            keys = [digest(s) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()),
                 pa.array(map(len, sets), pa.int64()), pa.array([k[0] for k in keys], pa.int64()),
                 pa.array([k[1] for k in keys], pa.int64()),
                 pa.array([[class_key(k[0], c) for c in (classes.of(len(s)), classes.of(len(s)) + 1)]
                           for s, k in zip(sets, keys)], pa.list_(pa.int64()))],
                names=["doc_id", "row", "size", "d1", "d2", "keys"])

    return materialise(docs.select("doc_id", "row", "text").mapInArrow(
        run, "doc_id long, row long, size long, d1 long, d2 long, keys array<long>"))


def candidate_edges(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """a, b: class keys of sets that share a signature, each with the smallest key among those that do.

    A signature's rows stand together in a sorted partition and are read as a stream, so a signature that
    many sets share takes no memory.
    """
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = Classes(percent)
        for rows in slices(batches, 0):
            signs, keys = [], []
            for (text,) in rows:
                grams = gram_set(text, n)
                first = digest(grams)[0]
                for c, s in signatures(grams, classes) if len(grams) else ():
                    signs.append(s)
                    keys.append(np.full(len(s), class_key(first, c), np.int64))
            if signs:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(signs).astype(np.int64)), pa.array(np.concatenate(keys))],
                                                 names=["sign", "key"])

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_sign = last_key = first_key = None
        for b in batches:
            if not b.num_rows:
                continue
            sign, key = b.column(0).to_numpy(), b.column(1).to_numpy()
            new = np.empty(len(sign), bool)
            new[0], new[1:] = last_sign is None or sign[0] != last_sign, sign[1:] != sign[:-1]
            again = np.empty(len(sign), bool)
            again[0], again[1:] = not new[0] and key[0] == last_key, (key[1:] == key[:-1]) & ~new[1:]
            start = np.maximum.accumulate(np.where(new, np.arange(len(sign)), -1))
            first = np.where(start < 0, key[0] if first_key is None else first_key, key[np.maximum(start, 0)])
            keep = ~new & ~again & (first != key)
            last_sign, last_key, first_key = sign[-1], key[-1], first[-1]
            yield pa.RecordBatch.from_arrays([pa.array(first[keep]), pa.array(key[keep])], names=["a", "b"])

    signed_sets = docs.select("text").mapInArrow(emit, "sign long, key long")
    return signed_sets.repartition("sign").sortWithinPartitions("sign", "key").mapInArrow(runs, "a long, b long").distinct()


def sent(grams: Column) -> Column:
    """n-grams that travel when a group of so many is joined: every block meets every other."""
    return grams * F.greatest(F.ceil(grams / GROUP_GRAMS) - 1, F.lit(1))


def gathered(grouped: DataFrame, edges: DataFrame) -> DataFrame:
    """row, d1, d2, part, blocks: the sets that are joined together, from their groups and the stored signature edges.

    Sets that share a signature all have an edge to the smallest of them, or are it. So the star around it holds
    every pair of them, and the stars of a group replace the group. A group goes by its stars if they send less.
    """
    kept = ["row", "d1", "d2", "part"]
    grouped = materialise(grouped)
    groups = materialise(grouped.groupBy("part").agg(F.sum("size").alias("grams")))
    large, n_large = materialise_counted(groups.where(F.col("grams") > 2 * GROUP_GRAMS))  # below, a set travels once
    blocks = groups.select("part", F.ceil(F.col("grams") / GROUP_GRAMS).cast("long").alias("blocks"))
    if not n_large:
        return grouped.join(blocks, "part").select(*kept, "blocks")
    ends = edges.select(F.col("a").alias("star"), F.col("b").alias("node")).unionByName(edges.select(F.col("a").alias("star"), F.col("a").alias("node")).distinct())
    starred = materialise(grouped.join(sided(large.select("part"), n_large), "part").join(by_shuffle(ends), "node"))
    stars = materialise(starred.groupBy("part", "star").agg(F.sum("size").alias("grams")))
    costs = stars.groupBy("part").agg(F.sum(sent(F.col("grams"))).alias("cost"))
    cut, n_cut = materialise_counted(costs.join(large, "part").where(F.col("cost") < sent(F.col("grams"))).select("part"))
    whole = grouped.join(sided(cut, n_cut), "part", "left_anti").join(blocks, "part")
    star_blocks = stars.select("part", "star", F.ceil(F.col("grams") / GROUP_GRAMS).cast("long").alias("blocks"))
    apart = starred.join(sided(cut, n_cut), "part", "left_semi").join(star_blocks, ["part", "star"]).withColumn("part", F.col("star"))
    return whole.select(*kept, "blocks").unionByName(apart.select(*kept, "blocks"))


def tree_links(sets: DataFrame, n: int, percent: int) -> DataFrame:
    """a, b: links between set keys that connect every component of each group's link graph.

    `sets` has text, d1, d2 and the groups' keys part, i, j.
    """
    def as_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in slices(batches, 0):
            grams = [gram_set(r[0], n) for r in rows]
            yield pa.RecordBatch.from_arrays(
                [*[pa.array([r[k] for r in rows], pa.int64()) for k in (1, 2)],
                 pa.array([g.astype("<u8").tobytes() for g in grams], pa.binary()), pa.array(map(len, grams), pa.int64()),
                 *[pa.array([r[k] for r in rows], pa.int64()) for k in (3, 4)]],
                names=["d1", "d2", "grams", "size", "part", "blocks"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[int, int, int, int]] = []
        stream = (row for b in batches for row in zip(*(c.to_pylist() for c in b.columns)))
        for _, rows in groupby(stream, key=lambda r: r[:3]):
            tree, keys = PrefixTree(percent), []
            for r in rows:
                if keys and keys[-1] == r[4:6]:
                    continue  # a repeated row
                keys.append(r[4:6])
                found += [(*keys[x], *keys[y]) for x, y in tree.add(np.frombuffer(r[6], "<u8"))]
            if len(found) > 10_000:
                yield out(found)
                found = []
        yield out(found)

    def out(found: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*found)) if found else [[], [], [], []]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["a1", "a2", "b1", "b2"])

    made = sets.select("text", "d1", "d2", "part", "blocks").mapInArrow(
        as_sets, "d1 long, d2 long, grams binary, size long, part long, blocks long")
    block = F.pmod(F.xxhash64("d1", "d2"), F.col("blocks"))
    others = F.when(F.col("blocks") == 1, F.array(F.lit(0).cast("long"))).otherwise(
        F.filter(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda x: x != F.col("_own")))
    pairs = made.withColumn("_own", block).withColumn("_other", F.explode(others)).select(
        "part", F.least("_own", "_other").alias("i"), F.greatest("_own", "_other").alias("j"), "size", "d1", "d2", "grams")
    ordered = pairs.repartition("part", "i", "j").sortWithinPartitions("part", "i", "j", "size", "d1", "d2")
    links = ordered.mapInArrow(join, "a1 long, a2 long, b1 long, b2 long")
    return links.select(key_of(F.col("a1"), F.col("a2")).alias("a"), key_of(F.col("b1"), F.col("b2")).alias("b"))


def linked_rows(docs: DataFrame, n: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, row (hash of id and text), size and component_id for every row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), row_hash(id_col, text_col).alias("row"), text.alias("text"))
    members = described(slim, n, percent)
    classes = members.where("size > 0").groupBy("d1", "d2").agg(
        F.min("doc_id").alias("least"), F.min("row").alias("row"), F.first("size").alias("size"), F.first("keys").alias("keys"))
    edges = materialise(candidate_edges(slim, n, percent))
    parts = components(edges)
    in_classes = classes.select("row", "d1", "d2", "size", F.explode("keys").alias("node"))
    grouped = in_classes.join(parts.select("node", F.col("label").alias("part")), "node")
    sets = slim.select("row", "text").join(gathered(grouped, edges), "row")
    links = components(materialise(tree_links(sets, n, percent)))
    keyed = classes.select("d1", "d2", "least", key_of(F.col("d1"), F.col("d2")).alias("node"))
    labelled = keyed.join(links, "node", "left").withColumn("label", F.coalesce("label", "node"))
    smallest = labelled.groupBy("label").agg(F.min("least").alias("component_id"))
    found = labelled.join(smallest, "label").select("d1", "d2", "component_id")
    own = F.when(F.col("size") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return members.join(found, ["d1", "d2"], "left").select("doc_id", "row", "size", own.alias("component_id"))


def row_hash(id_col: str, text_col: str) -> Column:
    return F.xxhash64(F.col(id_col).cast("long"), F.coalesce(F.col(text_col), F.lit("")))


def linked_documents(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_shingles (set size) and component_id (smallest id reachable by links) for every row.

    Null or empty text, and text without words, has an empty set and links with nothing: its component is
    its own id. Rows with null ids take part; a component without any other id has a null id. Repeated
    rows are in one component. An empty table gives no rows. Other columns are not read.
    """
    return linked_rows(docs, n, percent, id_col, text_col).select(
        F.col("doc_id").alias(id_col), F.col("size").alias("n_shingles"), "component_id")


def keep_first(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs`, all columns, that have the smallest id of their component.

    Rows without words stay. A row with a null id goes if its component has an id. Rows that share the
    smallest id of a component stay together. Only hashes of the rows to drop are joined with the rows.
    """
    found = linked_rows(docs, n, percent, id_col, text_col)
    name = f"_row_to_drop_{uuid.uuid4().hex}"  # no column of docs has it
    gone = materialise(found.where(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("row").alias(name)).distinct())
    return docs.join(gone, row_hash(id_col, text_col) == F.col(name), "left_anti")
