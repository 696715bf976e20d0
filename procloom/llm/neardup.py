"""Near-duplicate detection by a chosen-path similarity join (Christiani and Pagh; Christiani, Pagh and Sivertsen).

Documents with one set of word shingles are one class. Each class has minwise tokens, and each of several
independent trees branches the classes by selected tokens: its root puts classes together that share two
tokens, and a node with more than node_limit classes branches again by two further tokens of theirs. Small
nodes are compared exhaustively by sketches; nodes that stay large are dealt into pairs of blocks, so that
nothing is skipped and no task holds a whole node. A pair at the threshold of 0.85 meets in one tree with
probability 0.72 (0.69 where nodes branch), and misses all ten trees with less than one in 100,000.

Candidates go through the sketch (bytes of minwise values: first 128, then all 512, whose estimate must not
lie over 4.5 standard deviations below the threshold) and are confirmed on full sets. This takes three rounds, so that groups of many
similar copies don't bring out all their pairs: first each node of the first tree offers only a spanning
forest of its most similar pairs; then, with the components of the confirmed ones known, each node of any
tree offers a forest across components; last, all pairs that are still across components are tried. As
these may be as many as the square of a group's size, they never become rows: each document that has some in a node goes
there once with its set, and the task that has the node's sets confirms all of them.

Texts: of any length they are read whole. Null and empty ones, and those of white space, have no set and are linked with nothing. Fewer words
than a shingle make one shingle. Rows that repeat a doc_id count as one document for links and each get a
row. Only doc_id and text are read. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from procloom.llm import shared

SKETCH, FIRST = 512, 128
_U = np.uint64
#: Odd multipliers, each of which permutes 32-bit hashes.
_TIMES = np.random.default_rng(85).integers(1, 2**32, SKETCH, dtype=np.uint32) | np.uint32(1)
#: Hashes that are turned at a time.
CACHED = 1 << 15
#: Pairs that are looked at closely at a time, and pairs of a forest that are Python numbers at a time.
PAIRS = 1 << 13
#: Links in a file of labels.
LINKS_PER_FILE = 200_000


@dataclass(frozen=True)
class Paths:
    """Shingle length in words, similarity in percent, independent trees, the most classes in a node that is compared, tokens and levels of branching, classes in a block,
    shingles after which further sets of a node go to another part."""

    shingle: int = 5
    percent: int = 85
    trees: int = 10
    node_limit: int = 512
    branches: int = 2
    levels: int = 2
    block: int = 1024
    held: int = 1 << 20


def shingles(data: np.ndarray, offsets: np.ndarray, n: int) -> list[np.ndarray]:
    """The set of each text as ascending 64-bit hashes."""
    values, _, _, of = shared.words(data, offsets, lower=True)
    bounds = np.searchsorted(of, np.arange(len(offsets)))
    every = shared.grams(values, n)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a >= n:
            z = np.sort(every[a : b - n + 1])
            out.append(z[np.r_[True, z[1:] != z[:-1]]])
        else:
            out.append(shared.grams(values[a:b], b - a) if b > a else np.zeros(0, np.uint64))
    return out


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """SKETCH minwise 32-bit tokens of each set (one row a set); sets are not empty. A few sets at a time, so that they stay in a core's cache."""
    sizes = np.array([len(z) for z in sets])
    out, start = np.zeros((len(sets), SKETCH), np.uint32), 0
    total = np.cumsum(sizes)
    while start < len(sets):
        done = int(total[start - 1]) if start else 0
        stop = max(start + 1, int(np.searchsorted(total, done + CACHED, "right")))
        every = (np.concatenate(sets[start:stop]) >> _U(32)).astype(np.uint32)
        first = np.r_[0, np.cumsum(sizes[start : stop - 1])]
        turned = np.empty_like(every)
        for k in range(SKETCH):
            np.multiply(every, _TIMES[k], out=turned)
            out[start:stop, k] = np.minimum.reduceat(turned, first)
        start = stop
    return out


def tokens_needed(how: Paths) -> int:
    return how.trees * (2 + how.branches * how.levels)


def describe(docs: DataFrame, how: Paths) -> DataFrame:
    """doc_id, n, h1, h2 (which tell sets apart), tokens (for paths) and sketch of each row."""
    need = tokens_needed(how)
    if need > SKETCH:
        raise ValueError(f"{need} tokens are needed for these paths; there are {SKETCH}")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in shared.passes(batches):
            sets = shingles(data, offsets, how.shingle)
            n = np.array([len(z) for z in sets])
            with np.errstate(over="ignore"):
                h1 = np.array([shared.mix(z).sum(dtype=np.uint64) for z in sets]).view(np.int64)
                h2 = np.array([shared.mix(z ^ _U(0x5DEECE66D1234567)).sum(dtype=np.uint64) for z in sets]).view(np.int64)
            full = np.flatnonzero(n)
            tokens, sketch = np.zeros((len(sets), need), np.int32), np.zeros((len(sets), SKETCH), np.uint8)
            if len(full):
                minwise = sketches([sets[i] for i in full])
                tokens[full] = minwise[:, :need].view(np.int32)
                sketch[full] = shared.mix(minwise.astype(np.uint64)).astype(np.uint8)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, need * len(sets) + 1, need), pa.int32()), pa.array(tokens.ravel()))
            binary = lambda xs: pa.array([x.tobytes() for x in xs], pa.binary())
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(n), pa.array(h1), pa.array(h2), lists, binary(sketch)], ["doc_id", "n", "h1", "h2", "tokens", "sketch"])

    return docs.select("doc_id", "text").mapInArrow(read, "doc_id long, n long, h1 long, h2 long, tokens array<int>, sketch binary")


def among(rows: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """The rows whose key is in keys, and a few others."""
    spot, keep = shared.picker(keys, key)
    told = rows.select("*", spot)
    return told.mapInArrow(keep, told.schema).drop("p")


def sizes(at: DataFrame, how: Paths) -> DataFrame:
    """The rows of at (node, comp, ...) in nodes that hold several components, with size. Of large nodes, top is the component with most members, and most their number."""
    mixed = at.groupBy("node").agg(F.count("*").alias("size"), F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high").select("node", "size")
    mixed = shared.spill(mixed, "mixed")  # apart from the join, so that a large node's rows can be split over tasks
    sized = shared.spill(among(at, "node", mixed).join(mixed, "node"), "sized")
    by = sized.where(F.col("size") > how.node_limit).groupBy("node", "comp").agg(F.count("*").alias("n")).groupBy("node").agg(F.max(F.struct("n", "comp")).alias("m"))
    by = shared.spill(by.select("node", F.col("m.comp").alias("top"), F.col("m.n").alias("most")), "tops")
    large = sized.where(F.col("size") > how.node_limit).join(by, "node")
    return shared.spill(sized.where(F.col("size") <= how.node_limit).unionByName(large, allowMissingColumns=True), "nodes")


def nodes(classes: DataFrame, tokens: DataFrame, trees: int, how: Paths, pairs: bool) -> DataFrame:
    """node, id, side, comp, seen of the nodes of the first trees that are to be compared, for classes (id, comp, lead: the tokens of the roots) and their
    tokens (id, tokens). Nodes within one component are left out.

    A large node branches. One that a single component holds for the most part is not split by branching, as its members are near copies of each other;
    it is dealt into blocks, like those still large at the last level. seen has, by tree, the roots of earlier trees that were compared whole:
    two classes that share one have met before."""
    roots = F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.struct(t.alias("tree"), F.xxhash64(t, F.get("lead", 2 * t), F.get("lead", 2 * t + 1)).alias("node")))
    at = classes.select("id", "comp", F.explode(roots).alias("r")).select("id", "comp", "r.tree", "r.node")
    found = seen = None
    for level in range(how.levels + 1):
        sized = sizes(at, how)
        is_small = F.col("size") <= how.node_limit
        held = F.lit(level == how.levels) | (2 * F.col("most") > F.col("size"))
        if seen is None:
            seen = sized.where(is_small | held).groupBy("id").agg(F.array(*[F.max(F.when(F.col("tree") == t, F.col("node"))) for t in range(trees)]).alias("seen"))
        done = sized.where(is_small).select("tree", "node", "id", F.lit(0).alias("side"), "comp").unionByName(blocked(sized.where(~is_small & held), how, pairs))
        found = done if found is None else found.unionByName(done)
        large = sized.where(~is_small & ~held)
        if level == how.levels or large.isEmpty():
            break
        base = 2 * how.trees + F.col("tree") * (how.branches * how.levels) + level * how.branches
        children = F.transform(F.sequence(base, base + (how.branches - 1)), lambda k: F.xxhash64("node", k, F.get("tokens", k)))
        branching = large.select("id", "comp", "tree", "node").join(among(tokens.select("id", "tokens"), "id", large), "id")
        at = shared.spill(branching.select("id", "comp", "tree", F.explode(children).alias("node")), "at")
    earlier = F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.when(t < F.col("tree"), F.coalesce(F.get("seen", t), F.lit(0))).otherwise(F.lit(0)).cast("long"))
    return found.join(seen, "id", "left").select("node", "id", "side", "comp", earlier.alias("seen"))


def blocked(large: DataFrame, how: Paths, pairs: bool) -> DataFrame:
    """(tree, node, id, side, comp) where a large node's classes are dealt into blocks, each a node of its own. With pairs, every pair of blocks is one too,
    but for those of the component with most members: these meet all others and not each other."""
    blocks = lambda n: F.greatest(F.ceil(n / F.lit(how.block)), F.lit(1)).cast("long")
    deal = lambda n: F.pmod(F.xxhash64("node", "id"), n)
    if not pairs:
        return large.select("tree", F.xxhash64("node", deal(blocks(F.col("size")))).alias("node"), "id", F.lit(0).alias("side"), "comp")
    told = large.withColumn("major", F.col("comp") == F.col("top")).withColumns({"many": blocks(F.col("most")), "few": blocks(F.col("size") - F.col("most"))})
    told = told.withColumn("b", F.when(F.col("major"), deal(F.col("many"))).otherwise(deal(F.col("few"))))
    each = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    part = lambda kind, x, y, side: F.struct(F.xxhash64("node", F.lit(kind), x, y).alias("node"), side.alias("side"))
    zero, one = F.lit(0), F.lit(1)
    minor = F.concat(F.transform(each(F.col("few")), lambda o: part("few", F.least("b", o), F.greatest("b", o), F.when(F.col("b") <= o, zero).otherwise(one))), F.transform(each(F.col("many")), lambda o: part("many", F.col("b"), o, zero)))
    major = F.transform(each(F.col("few")), lambda o: part("many", o, F.col("b"), one))
    return told.select("tree", "id", "comp", F.explode(F.when(F.col("major"), major).otherwise(minor)).alias("p")).select("tree", "p.node", "id", "p.side", "comp")


def least_equal(percent: int, n: int) -> int:
    """Equal bytes of n that a pair at the threshold has, but for one in 300,000."""
    bar = percent / 100
    return int((bar - 4.5 * (bar * (1 - bar) / n) ** 0.5) * n)


def similar(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, percent: int, own: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (row of a, row of b, equal bytes) whose sketches and sizes allow the similarity; own: b is a, and only pairs of a row and a later one count."""
    found = []
    for i in range(0, len(a), 64):
        after = i if own else 0
        same = (a[i : i + 64, None, :FIRST] == b[None, after:, :FIRST]).sum(2, dtype=np.int16)
        fits = (same >= least_equal(percent, FIRST)) & (100 * np.minimum(na[i : i + 64, None], nb[after:]) >= percent * np.maximum(na[i : i + 64, None], nb[after:]))
        x, y = np.nonzero(np.triu(fits, 1) if own else fits)
        for k in range(0, len(x), PAIRS):
            u, v = x[k : k + PAIRS] + i, y[k : k + PAIRS] + after
            whole = (a[u] == b[v]).sum(1, dtype=np.int16)
            keep = whole >= least_equal(percent, SKETCH)
            found.append((u[keep], v[keep], whole[keep]))
    return tuple(np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, np.int64),) * 3


def forest(x: np.ndarray, y: np.ndarray, same: np.ndarray, n: int) -> np.ndarray:
    """Which pairs make a spanning forest of the most similar."""
    root = list(range(n))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    keep = np.zeros(len(x), bool)
    order = np.argsort(-same, kind="stable")
    for start in range(0, len(order), PAIRS):
        some = order[start : start + PAIRS]
        for k, i, j in zip(some.tolist(), x[some].tolist(), y[some].tolist()):
            a, b = find(i), find(j)
            if a != b:
                root[a] = b
                keep[k] = True
    return keep


def met(seen: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which pairs of rows share an entry of seen other than 0."""
    out = np.zeros(len(x), bool)
    for k in range(0, len(x), PAIRS):
        u, v = seen[x[k : k + PAIRS]], seen[y[k : k + PAIRS]]
        out[k : k + PAIRS] = ((u == v) & (u != 0)).any(1)
    return out


def runs(batches: Iterator[pa.RecordBatch], *keys: str) -> Iterator[pa.Table]:
    """The rows of each value of the keys, which come one after the other."""
    held, last = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        values = np.stack([batch.column(k).to_numpy() for k in keys])
        cuts = [0, *(np.flatnonzero((values[:, 1:] != values[:, :-1]).any(0)) + 1).tolist(), batch.num_rows]
        for i, j in zip(cuts, cuts[1:]):
            now = values[:, i].tolist()
            if held and now != last:
                yield pa.Table.from_batches(held).combine_chunks()
                held = []
            last = now
            held.append(batch.slice(i, j - i))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def sided(sides: np.ndarray) -> tuple[np.ndarray, np.ndarray, bool]:
    """Rows of the two sides that are compared with each other; all rows twice if there is one side."""
    two = bool(sides.min() != sides.max())
    return (np.flatnonzero(sides == 0), np.flatnonzero(sides == 1), two) if two else (np.arange(len(sides)), np.arange(len(sides)), two)


def across(node: pa.Table, how: Paths) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of rows of a node (side, id, n, sketch, comp, seen) across components that the sketches let pass, and their equal bytes. Pairs that have met in an earlier tree are left out."""
    ids, n, comps = (node.column(c).to_numpy() for c in ("id", "n", "comp"))
    sketch = np.frombuffer(b"".join(node.column("sketch").to_pylist()), np.uint8).reshape(-1, SKETCH)
    seen = node.column("seen").combine_chunks().flatten().to_numpy().reshape(len(sketch), -1)
    left, right, two = sided(node.column("side").to_numpy())
    x, y, same = similar(sketch[left], sketch[right], n[left], n[right], how.percent, own=not two)
    x, y = left[x], right[y]
    keep = (ids[x] != ids[y]) & (comps[x] != comps[y])
    x, y, same = x[keep], y[keep], same[keep]
    fresh = ~met(seen, x, y)
    return x[fresh], y[fresh], same[fresh]


def candidates(members: DataFrame, how: Paths) -> DataFrame:
    """(a, b) with a < b: pairs across components of the classes in a node (node, side, id, n, sketch, comp, seen) that span the components of each node, of those that the sketches let pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for node in runs(batches, "node"):
            x, y, same = across(node, how)
            ids, code = node.column("id").to_numpy(), np.unique(node.column("comp").to_numpy(), return_inverse=True)[1]
            keep = forest(code[x], code[y], same, len(ids))
            a, b = ids[x[keep]], ids[y[keep]]
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    # a node has node_limit classes or two blocks at most, and a task holds one node at a time
    return members.repartition("node").sortWithinPartitions("node").mapInArrow(run, "a long, b long").distinct()


def parted(x: np.ndarray, y: np.ndarray, n: np.ndarray, two: bool, held: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(part, side, item) of the items in the pairs (x, y), so that the items of each pair meet in a part: on its two sides, or in a part with one.
    Items that no chain of pairs joins have parts of their own; a side has held shingles (n: those of each item) and one item more at most."""
    kin, size = np.arange(len(n)), len(n)
    while True:
        least = np.minimum(kin[x], kin[y])
        new = kin.copy()
        np.minimum.at(new, x, least)
        np.minimum.at(new, y, least)
        new = new[new]
        if (new == kin).all():
            break
        kin = new
    row, side = np.r_[x, y], np.repeat([0, int(two)], len(x))
    items = np.unique((kin[row] * 2 + side) * size + row)  # by kin, side and item
    of, item = items // size, items % size
    before = np.cumsum(n[item]) - n[item]
    first = np.r_[True, of[1:] != of[:-1]]
    block = np.zeros((2, size), np.int64)
    block[of % 2, item] = (before - np.maximum.accumulate(np.where(first, before, 0))) // held
    p, q = block[0][x], block[int(two)][y]
    part = np.unique((kin[x] * size + p) * size + q, return_inverse=True)[1]
    rows = np.unique((np.r_[part, part] * 2 + np.r_[np.zeros(len(x), np.int64), (p != q) | two]) * size + row)
    return rows // size // 2, rows // size % 2, rows % size


def unsettled(members: DataFrame, how: Paths) -> DataFrame:
    """(node, part, side, id, comp): the documents of each node with pairs across components that the sketches let pass, each once in a part of the node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for node in runs(batches, "node"):
            x, y, _ = across(node, how)
            if not len(x):
                continue
            ids, first, who = np.unique(node.column("id").to_numpy(), return_index=True, return_inverse=True)
            n = np.zeros(len(ids), np.int64)
            np.maximum.at(n, who, node.column("n").to_numpy())
            x, y, two = who[x], who[y], sided(node.column("side").to_numpy())[2]
            part, side, item = parted(*((x, y) if two else (np.minimum(x, y), np.maximum(x, y))), n, two, how.held)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(item), node.column("node")[0].as_py())), pa.array(part), pa.array(side), pa.array(ids[item]), pa.array(node.column("comp").to_numpy()[first[item]])], ["node", "part", "side", "id", "comp"])

    return members.repartition("node").sortWithinPartitions("node").mapInArrow(run, "node long, part long, side long, id long, comp long")


def spanning_links(sets: list[np.ndarray], ids: np.ndarray, sides: np.ndarray, comps: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows x and y of pairs across components whose sets have the similarity: as many as join all components that such pairs join."""
    code = np.unique(comps, return_inverse=True)[1]
    n = np.array([len(z) for z in sets])
    every, word = np.unique(np.concatenate(sets), return_inverse=True)
    start = np.cumsum(n) - n
    left, right, two = sided(sides)
    own, out = np.zeros(len(every), bool), []
    for i in left.tolist():
        at = right if two else right[i + 1 :]
        at = at[(ids[at] != ids[i]) & (code[at] != code[i]) & (100 * np.minimum(n[at], n[i]) >= percent * np.maximum(n[at], n[i]))]
        if not len(at):
            continue
        own[word[start[i] : start[i] + n[i]]] = True
        both = np.array([np.count_nonzero(own[word[start[j] : start[j] + n[j]]]) for j in at.tolist()])
        own[word[start[i] : start[i] + n[i]]] = False
        for j in at[100 * both >= percent * (n[i] + n[at] - both)].tolist():
            if code[i] != code[j]:
                code[code == code[j]] = code[i]
                out.append((i, j))
    return tuple(np.array(out, np.int64).reshape(-1, 2).T)


def settled(docs: DataFrame, open_rows: DataFrame, how: Paths) -> DataFrame:
    """Pairs (a, b) of documents whose full sets have the similarity, for what unsettled gives: each part's pairs across components are all tried, and those given join what they join."""
    open_rows = shared.spill(open_rows, "unsettled")
    sets = full_sets(docs, open_rows.select("id"), how)
    percent = how.percent

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in runs(batches, "node", "part"):
            ids, sides, comps = (part.column(c).to_numpy() for c in ("id", "side", "comp"))
            x, y = spanning_links([np.frombuffer(z.as_buffer(), np.uint64) for z in part.column("set")], ids, sides, comps, percent)
            if len(x):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(ids[x], ids[y])), pa.array(np.maximum(ids[x], ids[y]))], ["a", "b"])

    return open_rows.join(sets, "id").repartition("node", "part").sortWithinPartitions("node", "part").mapInArrow(run, "a long, b long").distinct()


def full_sets(docs: DataFrame, ids: DataFrame, how: Paths) -> DataFrame:
    """(id, set) of the rows of docs whose doc_id is in ids (id), and of a few others; no text shuffles."""
    spot, keep = shared.picker(ids, "id")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in shared.passes(keep(batches)):
            sets = pa.array([z.tobytes() for z in shingles(data, offsets, how.shingle)], pa.binary())
            yield pa.RecordBatch.from_arrays([rows.column("id"), sets], ["id", "set"])

    rows = docs.where("doc_id is not null").select(F.col("doc_id").alias("id"), "text")
    return shared.spill(rows.select("id", "text", spot).mapInArrow(read, "id long, set binary"), "full")


def confirmed(docs: DataFrame, pairs: DataFrame, how: Paths) -> DataFrame:
    """The pairs (a, b) of documents whose full sets have the similarity."""
    pairs = shared.spill(pairs, "pairs")
    sets = full_sets(docs, pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))), how)
    percent = how.percent

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("sa"), batch.column("sb")):
                u, v = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if len(u) > len(v):
                    u, v = v, u
                at = np.searchsorted(v, u)
                both = int((v[np.minimum(at, len(v) - 1)] == u).sum())
                keep.append(100 * both >= percent * (len(u) + len(v) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left = pairs.join(sets.select(F.col("id").alias("a"), F.col("set").alias("sa")), "a")
    both = left.join(sets.select(F.col("id").alias("b"), F.col("set").alias("sb")), "b")
    return both.select("a", "b", "sa", "sb").mapInArrow(check, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(id, comp): the smallest id reachable, for each id that has a link; by repeated hooking to the smallest neighbour's label and pointer jumping."""
    files = 1 + links.count() // LINKS_PER_FILE  # few links make few files, which join without a shuffle
    with shared.scratch():
        edges = shared.spill(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).coalesce(2 * files), "edges")
        label = shared.spill(edges.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("comp")).coalesce(files), "labels", outlast=1)
        while True:
            seen = edges.join(label.select(F.col("id").alias("b"), "comp"), "b").groupBy(F.col("a").alias("id")).agg(F.min("comp").alias("near"))
            near = label.join(seen, "id").select("id", F.least("comp", "near").alias("comp"), F.col("comp").alias("old"))
            jump = label.select(F.col("id").alias("comp"), F.col("comp").alias("top"))
            new = shared.spill(near.join(jump, "comp", "left").select("id", F.coalesce(F.least("comp", "top"), "comp").alias("comp"), "old").coalesce(files), "labels", outlast=1)
            changed = not new.where("comp < old").isEmpty()
            label = new.select("id", "comp")
            if not changed:
                return label


def near_groups(docs: DataFrame, how: Paths = Paths()) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable), kept of each row of docs."""
    shared.ship(docs.sparkSession)
    same = ["n", "h1", "h2"]
    with shared.scratch():
        every = shared.spill(describe(docs, how), "sketches")
        # only sets that occur twice need a look-up; they are written apart from the join, whose rows of a large class can then be split over tasks
        held = every.where("n > 0").groupBy(same).agg(F.min("doc_id").alias("least"), F.count("*").alias("many")).where("many > 1").drop("many")
        reps = shared.spill(held, "classes")
        alone = F.when(F.col("n") > 0, F.coalesce("least", "doc_id"))
        slim = every.select("doc_id", *same)
        if reps.count() > shared.FEW:  # sets that occur once pass by the join
            clear, some = shared.apart(slim.withColumn("key", F.xxhash64(*same)), "key", reps.select(F.xxhash64(*same).alias("key")))
            joined = some.drop("key").join(reps, same, "left").unionByName(clear.drop("key").withColumn("least", F.lit(None).cast("long")))
        else:
            joined = slim.join(F.broadcast(reps), same, "left")
        member = shared.spill(joined.select("doc_id", *same, alone.alias("id")), "members")
        # a class is compared by its least document; the others are few or are cleared by a bitmap, so that sketches don't shuffle
        copies = member.where("id <> doc_id").select("doc_id").join(member.where("id = doc_id").select("doc_id"), "doc_id", "left_anti")
        chosen = shared.without(every.where("n > 0 and doc_id is not null"), copies).select(F.col("doc_id").alias("id"), "n", "tokens", "sketch")
        links, label = None, None
        for trees, spanning in ((1, True), (how.trees, True), (how.trees, False)):
            with shared.scratch():
                told = chosen.select("id", F.slice("tokens", 1, 2 * trees).alias("lead"))
                told = told.withColumn("comp", F.col("id")) if label is None else shared.spill(told.join(label, "id", "left").withColumn("comp", F.coalesce("comp", "id")), "told")
                placed = shared.spill(nodes(told, chosen, trees, how, pairs=label is not None), "placed")
                members = placed.join(among(chosen.select("id", "n", "sketch"), "id", placed), "id")
                tried = confirmed(docs, candidates(members, how), how) if spanning else settled(docs, unsettled(members, how), how)
                new = shared.spill(tried, "links", outlast=1)
            if links is None or not new.isEmpty():
                links = new if links is None else links.unionByName(new)
                label = components(links)
        comp = F.coalesce("comp", "id", "doc_id")
        out = member.join(label, "id", "left").select("doc_id", F.col("n").alias("n_shingles"), comp.alias("component_id"), (F.col("doc_id") == comp).alias("kept"))
        return shared.spill(out, "near", outlast=1)


def drop_near(docs: DataFrame, how: Paths = Paths()) -> DataFrame:
    """The rows of docs without all but one document of each group, with their columns. Rows that can't be dropped don't shuffle."""
    return shared.without(docs, near_groups(docs, how).where("not kept").select("doc_id"))
