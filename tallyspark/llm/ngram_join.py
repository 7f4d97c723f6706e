"""Jaccard join of documents on word shingles, through count-vector R-trees, up to connected components.

Points. A set of n distinct shingles is hashed into `GROUPS` groups; its group counts are a point. The intersection of two
sets is at most the sum of the minima of their coordinates, and of a set with any below a node of the tree at most the
sum of minima with the node's upper corner.

Routing. One tree over everything prunes little: with so many dimensions the corners of its upper nodes bound nothing. So
the points are first routed to many small trees by keys, exactly: sets that link share a key. Of two kinds of keys the threshold picks one.
High thresholds deal by groups again. Two sets of n and m shingles that link differ in at most D = (n + m) (1 - t) / (1 + t)
of them; dealt by hash into more than D groups, they hold the same shingles in one group at least. So a group's contents are a key. The number
of groups is fixed for a class of sizes; a set goes to each class in which the larger set of a link can be. Where a set fills no more than D
groups, the equal ones may be empty: such sets are dealt again by other hashes, and at last go by a prefix in the order of hashes. Such a
key takes several shingles at once, so trees hold little but near copies, whatever passages the documents share. Below a mean of `LEAST_MEAN` shingles
a group that no longer holds, and the keys are the shingles of the prefix: sets that link share one of the first n - ceil(t n) + 1 in any
fixed order; rare ones come first, by a table of hashed counts over all documents.

Linking. Only components are wanted, so pairs are looked at in two turns. In the first each member of a tree meets one centre: the least member
that its task read with that key, and these centres the least of them; trees that still hold several components get new centres from their
largest, `STARS` times. Members then in one component need no other look; in the second turn trees that still hold several components are joined with themselves, for pairs
across components. A tree of more than `CHUNK` members is cut into its upper nodes: its members in order of size and counts, `CHUNK` a node. A node's corner and least and largest size say with which
other nodes it can hold a link; pairs of nodes that can't are never sent anywhere. For each pair that can, the members of the one ask an R-tree of the members of the other, whose leaves and levels
prune by their corners in turn. What passes a leaf passes the bound of its points, and survivors are verified on the true sets. No link between components is lost, no group is
expanded to all its pairs, and in the first turn a key's rows are as many as the tasks that read it, not as its members.

True sets are sets of 64-bit hashes of shingles (see `shingles`): two unlike shingles with one hash would count as equal.

Cases. Null and empty texts, and those without words, have no shingles and link with nothing. Equal sets link, whatever
the texts. Identifiers may be null or repeated: rows are the documents, and a component's identifier is the least non-null one in
it. A very long text is read whole. An empty input gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.llm.common import forget, rows_in, save, short_batches, small
from tallyspark.llm.graph import components
from tallyspark.llm.shingles import mix, sets

#: Coordinates of a point, points of a leaf (and nodes of a level), members of an upper node. Small leaves keep their corners low.
GROUPS, LEAF, CHUNK = 256, 8, 2000
#: So few points are searched without a tree.
FLAT = 64
#: Shingles that the groups of linked sets hold on average, for groups to be keys.
LEAST_MEAN = 6
#: Cells of the table of hashed counts, and the slices in which it travels.
CELLS, SLICES, FAN_IN = 1 << 20, 64, 64
#: A group count that stands for itself and everything above; its bound always holds.
FULL = 255
#: Sets that one task remembers so as not to send copies' keys again, and keys of which it finds the centres at once; both only save work.
REMEMBERED, AT_ONCE = 300_000, 1 << 20
#: How often the trees get other centres before they are searched.
STARS = 1
#: Keys by which a pair is told to come from another tree.
LEAST_KEYS = 24
#: How often sets are dealt again by another hash.
DEALS = 3


def need(n_a, n_b, num: int, den: int):
    """Intersection times (den + num) must reach this for a Jaccard of num / den."""
    return num * (n_a + n_b)


def counts_of(tokens: np.ndarray) -> np.ndarray:
    return np.minimum(np.bincount((tokens >> np.uint64(56)).astype(np.int64), minlength=GROUPS), FULL).astype(np.uint8)


def points_of(raw) -> np.ndarray:
    return np.frombuffer(b"".join(map(bytes, raw)), dtype=np.uint8).reshape(-1, GROUPS)


def may_reach(a: np.ndarray, b: np.ndarray, n_a, n_b, num: int, den: int) -> np.ndarray:
    """Whether the summed minima of coordinates (rows of a against b) allow the threshold."""
    bound = np.minimum(a, b).sum(axis=-1, dtype=np.int64)
    return (bound * (den + num) >= need(n_a, n_b, num, den)) | (a.max(axis=-1) == FULL)


# --- keys of trees ------------------------------------------------------------------------------------------------------


@functools.cache
def _bounds() -> np.ndarray:
    """The least size of each class; a class ends at half as much again."""
    out = [1]
    while out[-1] < 1 << 40:
        out.append(max(out[-1] + 1, out[-1] * 3 // 2))
    return np.array(out, dtype=np.int64)


def class_of(n: int) -> int:
    return int(np.searchsorted(_bounds(), n, side="right")) - 1


@functools.cache
def dealing(c: int, num: int, den: int) -> tuple[int, int]:
    """Differences D that linked sets of class c can have, and into how many groups its sets are dealt; 0 groups where the prefix is the key.

    Enough groups are taken for the smallest sets of the class to fill more than D, as a rule.
    """
    least, most = int(_bounds()[c]), int(_bounds()[c + 1]) - 1
    d = 2 * most * (den - num) // (den + num)
    g = np.arange(d + 1, 2 * d + 12, dtype=np.float64)
    empty = (1 - 1 / g) ** least
    spare = (g * (1 - empty) - d - 0.5) / np.sqrt(g * empty * (1 - empty) + 1e-9)
    if d == 0:
        return 0, 1
    return d, int(g[np.argmax(spare >= 4)] if (spare >= 4).any() else g[spare.argmax()]) if spare.max() > 0.5 else 0


def prefix(tokens: np.ndarray, num: int, den: int, cells: np.ndarray | None = None) -> np.ndarray:
    """The first shingles, of which sets that link share one: in the order of their hashes, or rare ones first."""
    keep = len(tokens) - -(-num * len(tokens) // den) + 1
    if cells is None:
        return tokens[:keep]
    order = np.lexsort((tokens, cells[(tokens & np.uint64(CELLS - 1)).astype(np.int64)]))
    return tokens[order[:keep]]


def by_groups(num: int, den: int) -> bool:
    return den + num >= 2 * LEAST_MEAN * (den - num)


def keys_of(tokens: np.ndarray, num: int, den: int) -> np.ndarray:
    """Keys such that sets that link share one at least. tokens: sorted and distinct."""
    found = []
    with np.errstate(over="ignore"):
        for c in range(class_of(len(tokens)), class_of(len(tokens) * den // num) + 1):
            differ, groups = dealing(c, num, den)
            for deal in range(DEALS if groups else 0):
                own = tokens if not deal else np.sort(mix(tokens + np.uint64(deal)))
                # a group is a range of hashes, so its shingles lie side by side
                group = ((own >> np.uint64(32)) * np.uint64(groups)) >> np.uint64(32)
                first = np.flatnonzero(np.diff(group, prepend=np.uint64(groups)))
                total = np.add.reduceat(own, first)
                found.append(mix(total + mix(group[first] * np.uint64(DEALS) + np.uint64(deal) + np.uint64((c + 1) << 40))))
                if len(first) > differ:
                    break
            else:
                found.append(mix(prefix(tokens, num, den) + np.uint64(c + 1)))
    return np.concatenate(found)


def with_centres(keys: np.ndarray, hs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct rows key, h and up: 0 for the least h of a key, else that least h."""
    order = np.lexsort((hs, keys))
    keys, hs = keys[order], hs[order]
    new_key = np.concatenate([[True], keys[1:] != keys[:-1]])
    new = new_key | np.concatenate([[True], hs[1:] != hs[:-1]])
    up = np.where(new_key, 0, hs[np.flatnonzero(new_key)[np.cumsum(new_key) - 1]])
    return keys[new], hs[new], up[new]


class CountTree:
    """A packed R-tree of group counts. Points are sorted by class of size, then by the widest coordinates, and cut into leaves;
    levels above take LEAF nodes each. A node keeps the upper corner of its points and their least and largest size. looked: corners and points that searches met."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        spread = np.argsort(-points.astype(np.float32).std(axis=0), kind="stable")[:3] if len(points) else []
        self.order = np.lexsort((*[points[:, s] for s in spread[::-1]], size_class(sizes)))
        self.points, self.sizes = points[self.order], sizes[self.order]
        corner, least, most = self.points, self.sizes, self.sizes
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(corner) > 1 or not self.levels:
            at = np.arange(0, len(corner), LEAF)
            corner, least, most = np.maximum.reduceat(corner, at, axis=0), np.minimum.reduceat(least, at), np.maximum.reduceat(most, at)
            self.levels.append((corner, least, most))
        self.looked = 0

    def search(self, point: np.ndarray, size: int, num: int, den: int) -> np.ndarray:
        """Places of the points whose bound with `point` reaches the threshold."""
        at = np.arange(len(self.levels[-1][0]))
        for k in range(len(self.levels) - 1, -1, -1):
            corner, least, most = self.levels[k]
            at = at[in_reach(size, size, least[at], most[at], num, den)]
            self.looked += len(at)
            reach = may_reach(corner[at], point, size, least[at], num, den)
            below = len(self.levels[k - 1][0]) if k else len(self.points)
            at = (at[reach][:, None] * LEAF + np.arange(LEAF)).ravel()
            at = at[at < below]
        at = at[in_reach(size, size, self.sizes[at], self.sizes[at], num, den)]
        self.looked += len(at)
        reach = may_reach(self.points[at], point, size, self.sizes[at], num, den)
        return self.order[at[reach]]


def size_class(n: np.ndarray) -> np.ndarray:
    """Sizes in steps of a tenth."""
    return np.floor(np.log(np.maximum(n, 1)) / np.log(1.1)).astype(np.int64)


def in_reach(least_a, most_a, least_b, most_b, num: int, den: int):
    """Whether sets of sizes between the bounds of both sides can link."""
    return (most_a * den >= least_b * num) & (most_b * den >= least_a * num)


def node_pairs(corners: np.ndarray, least: np.ndarray, most: np.ndarray, asks: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the nodes that ask, and of those that can hold a link with them."""
    left, right = [], []
    for i in np.flatnonzero(asks).tolist():
        near = np.flatnonzero(in_reach(least[i], most[i], least, most, num, den))
        reach = may_reach(corners[near], corners[i], least[i], least[near], num, den)
        left.append(np.full(int(reach.sum()), i))
        right.append(near[reach])
    return (np.concatenate(left), np.concatenate(right)) if left else (np.array([], dtype=np.int64), np.array([], dtype=np.int64))


def tree_pairs(points: np.ndarray, sizes: np.ndarray, comps: np.ndarray, left: np.ndarray, right: np.ndarray, num: int, den: int) -> Iterator[tuple[int, int]]:
    """Pairs of one place of `left` and one of `right`, in different components, that the bound lets through."""
    codes = np.unique(comps, return_inverse=True)[1]
    if len(right) <= FLAT:
        n_left, n_right = sizes[left][:, None], sizes[right][None, :]
        i, j = np.nonzero((codes[left][:, None] != codes[right][None, :]) & in_reach(n_left, n_left, n_right, n_right, num, den))
        i, j = left[i], right[j]
        for k in range(0, len(i), 20_000):
            x, y = i[k : k + 20_000], j[k : k + 20_000]
            reach = may_reach(points[x], points[y], sizes[x], sizes[y], num, den)
            yield from zip(x[reach].tolist(), y[reach].tolist())
        return
    tree = CountTree(points[right], sizes[right])
    for i in left:
        found = right[tree.search(points[i], sizes[i], num, den)]
        for j in found[codes[found] != codes[i]]:
            yield int(i), int(j)


# --- passes over the texts ----------------------------------------------------------------------------------------------


def _sid(tokens: np.ndarray) -> bytes:
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()


def _points(docs: DataFrame, width: int, count: bool) -> DataFrame:
    """A row (kind 0) per document; if asked to count, at the end of each task its table of hashed counts in slices (kind 1)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        cells, any_set = np.zeros(CELLS if count else 0, dtype=np.uint32), False
        columns = ["kind", "doc_id", "n", "sid", "counts", "slice", "part"]
        for b in batches:
            rows, found = [], []
            for doc, tokens in zip(b["id"], sets(list(b["text"]), width)):
                rows.append((0, doc, len(tokens), _sid(tokens), None, None, None))
                found.append(tokens)
            if count and any(map(len, found)):
                any_set = True
                np.add.at(cells, (np.concatenate(found) & np.uint64(CELLS - 1)).astype(np.int64), np.uint32(1))
            yield pd.DataFrame(rows, columns=columns)
        if any_set:
            part = TaskContext.get().partitionId()
            each = CELLS // SLICES
            yield pd.DataFrame([(1, None, None, None, cells[s * each : (s + 1) * each].tobytes(), s, part) for s in range(SLICES)], columns=columns)

    rows = docs.select(F.col("id").cast("string").alias("id"), "text")
    return rows.mapInPandas(run, "kind int, doc_id string, n long, sid binary, counts binary, slice int, part int")


def _count_table(slices: DataFrame) -> np.ndarray:
    """Add up the tasks' tables, at most FAN_IN at a time; what comes to the driver has CELLS numbers."""

    def add(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(CELLS // SLICES, dtype=np.uint64)
        for raw in rows["counts"]:
            total += np.frombuffer(raw, dtype=np.uint32)
        capped = np.minimum(total, np.uint64(0xFFFFFFFF)).astype(np.uint32)
        return pd.DataFrame([(int(key[0]), int(key[1]), capped.tobytes())], columns=["slice", "part", "counts"])

    now = slices.select("slice", "part", "counts")
    most = now.agg(F.max("part")).first()[0] or 0
    while True:
        now = now.withColumn("part", F.floor(F.col("part") / FAN_IN).cast("int")).groupBy("slice", "part").applyInPandas(add, "slice int, part int, counts binary")
        most //= FAN_IN
        if not most:
            break
    cells = np.zeros(CELLS, dtype=np.uint32)
    each = CELLS // SLICES
    for r in now.collect():
        cells[r["slice"] * each : (r["slice"] + 1) * each] = np.frombuffer(r["counts"], dtype=np.uint32)
    return cells


def _routes(docs: DataFrame, width: int, num: int, den: int, cells: np.ndarray | None) -> DataFrame:
    """key, h (the start of the set's digest as a number), up: the centre that h meets, 0 for a centre of the task."""
    shared = docs.sparkSession.sparkContext.broadcast(cells)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sent: set[bytes] = set()
        keys: list[np.ndarray] = []
        hs: list[np.ndarray] = []
        held = 0

        def flush() -> Iterator[pd.DataFrame]:
            k, h, up = with_centres(np.concatenate(keys).view(np.int64), np.concatenate(hs))
            for i in range(0, len(k), 100_000):
                yield pd.DataFrame({"key": k[i : i + 100_000], "h": h[i : i + 100_000], "up": up[i : i + 100_000]})

        for b in batches:
            for tokens in sets(list(b["text"]), width):
                sid = _sid(tokens)
                if not len(tokens) or sid in sent:
                    continue
                if len(sent) >= REMEMBERED:
                    sent.clear()
                sent.add(sid)
                own = keys_of(tokens, num, den) if shared.value is None else prefix(tokens, num, den, shared.value)
                keys.append(own)
                hs.append(np.full(len(own), int.from_bytes(sid[:8], "little", signed=True) | 1, dtype=np.int64))
                held += len(own)
                if held >= AT_ONCE:
                    yield from flush()
                    keys, hs, held = [], [], 0
        if held:
            yield from flush()

    return docs.select("text").mapInPandas(run, "key long, h long, up long")


def _trees(docs: DataFrame, width: int, num: int, den: int, cells: np.ndarray | None) -> DataFrame:
    """key, up, h: the members of trees of two or more sets, each with the centre that it meets; the least centre has no row."""
    routed = _routes(docs, width, num, den, cells)
    # only the tasks' centres of a key meet; their members pass by, dealt by themselves
    w = Window.partitionBy("key", F.when(F.col("up") == 0, 0).otherwise(F.col("h"))).orderBy("h")
    met = F.when(F.col("up") == 0, F.first("h").over(w.rowsBetween(Window.unboundedPreceding, 0))).otherwise(F.col("up"))
    return routed.select("key", met.alias("up"), "h").filter("up != h")


def _of_sets(docs: DataFrame, wanted: DataFrame, width: int, name: str, measure) -> DataFrame:
    """sid, and what `measure` makes of the shingles (as bytes), of the wanted sets (sid, low: an identifier that has it), a saved table."""
    lows, n = wanted.select(F.col("low").alias("__low")).distinct(), rows_in(wanted)
    rows = docs.select(F.col("id").cast("string").alias("id"), "text").join(small(lows, 40, n), F.col("id").eqNullSafe(F.col("__low")), "left_semi")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(_sid(t), measure(t).tobytes()) for t in sets(list(b["text"]), width)], columns=["sid", name])

    got = rows.select("text").mapInPandas(run, f"sid binary, {name} binary")
    # an identifier may be repeated, a set may have several rows of it
    return got.join(small(wanted.select("sid"), 40, n), "sid", "left_semi").groupBy("sid").agg(F.first(name).alias(name))


def _may_link(num: int, den: int):
    @F.pandas_udf("boolean")
    def test(a: pd.Series, b: pd.Series, n_a: pd.Series, n_b: pd.Series) -> pd.Series:
        if not len(a):
            return pd.Series([], dtype=bool)
        return pd.Series(may_reach(points_of(a), points_of(b), n_a.to_numpy(), n_b.to_numpy(), num, den))

    return test


def _links(docs: DataFrame, pairs: DataFrame, ends: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b: sids) that link, verified on the true sets. ends: sid, low of these sets."""
    used = pairs.select(F.explode(F.array("a", "b")).alias("sid")).distinct()
    wanted = save(ends.join(used, "sid").select("sid", "low"), "join-ends", narrow=True, rows="true")
    true = save(_of_sets(docs, wanted, width, "tokens", lambda t: t), "join-sets", narrow=True)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            keep = []
            for x, y in zip(b["x"], b["y"]):
                s, t = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
                both = len(np.intersect1d(s, t, assume_unique=True))
                keep.append(both * (den + num) >= need(len(s), len(t), num, den))
            yield b.loc[keep, ["a", "b"]]

    with_a = pairs.join(true.select(F.col("sid").alias("a"), F.col("tokens").alias("x")), "a")
    with_b = with_a.join(true.select(F.col("sid").alias("b"), F.col("tokens").alias("y")), "b")
    links = save(with_b.mapInPandas(run, "a binary, b binary"), "links", narrow=True)
    forget(true, wanted)
    return links


def _in_nodes(members: DataFrame, num: int, den: int) -> DataFrame:
    """members (key, size of the tree, sid, comp, n, counts, least, asks) as rows of pairs of nodes: key, i, j, side (1: asks, 2: is found) and the rest. Small trees are one node."""
    sides = lambda df, i, j: df.select("key", i.alias("i"), j.alias("j"), "side", "sid", "comp", "n", "counts", "least")
    few, zero = members.filter(F.col("size") <= CHUNK), F.lit(0).cast("long")
    few = few.withColumn("side", F.explode(F.when(F.col("asks"), F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(2)))))
    out = sides(few, zero, zero)
    many = members.filter(F.col("size") > CHUNK)
    order = ["key", F.floor(F.log("n") / F.log(F.lit(1.1))), "counts", "sid"]
    # a row's number within its range: ranges end where they may, so a tree of any size is dealt over tasks
    placed = many.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("node", F.floor(F.monotonically_increasing_id() / CHUNK).cast("long"))
    placed = save(placed.drop("c_comp"), "tree-nodes", rows="true")
    if not rows_in(placed):
        return out

    def corner(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(*key, points_of(rows["counts"]).max(axis=0).tobytes(), rows["n"].min(), rows["n"].max(), rows["asks"].any())], columns=["key", "node", "corner", "low", "high", "asks"])

    def meet(key: tuple, nodes: pd.DataFrame) -> pd.DataFrame:
        number = nodes["node"].to_numpy()
        i, j = node_pairs(points_of(nodes["corner"]), nodes["low"].to_numpy(), nodes["high"].to_numpy(), nodes["asks"].to_numpy(), num, den)
        return pd.DataFrame({"key": np.full(len(i), key[0], dtype=np.int64), "i": number[i], "j": number[j]})

    nodes = placed.select("key", "node", "counts", "n", "asks").groupBy("key", "node").applyInPandas(corner, "key long, node long, corner binary, low long, high long, asks boolean")
    pairs = save(nodes.groupBy("key").applyInPandas(meet, "key long, i long, j long"), "node-pairs", narrow=True, rows="true")
    at = lambda c: small(pairs.withColumn("node", F.col(c)), 32, rows_in(pairs))
    asking = placed.filter("asks").withColumn("side", F.lit(1)).join(at("i"), ["key", "node"])
    found = placed.withColumn("side", F.lit(2)).join(at("j"), ["key", "node"])
    return out.unionByName(sides(asking, F.col("i"), F.col("j"))).unionByName(sides(found, F.col("i"), F.col("j")))


def _search_trees(members: DataFrame, num: int, den: int) -> DataFrame:
    """members: tree (key, i, j), side (1: a member that asks, 2: one that is found), sid, comp, n, counts, least. Gives pairs a, b.

    least: the smallest keys of a member's trees. Near copies meet in many trees; a pair isn't given where one of these says that another tree gives it.
    """
    columns = ["key", "i", "j", "side", "sid", "comp", "n", "counts", "least"]

    def group(g: pd.DataFrame) -> list[tuple]:
        points = points_of(g["counts"])
        sizes, side = g["n"].to_numpy(dtype=np.int64), g["side"].to_numpy()
        left, right = np.flatnonzero(side == 1), np.flatnonzero(side == 2)
        if not len(left) or not len(right):
            return []
        sid, comp = [bytes(s) for s in g["sid"]], np.array([bytes(c).hex() for c in g["comp"]])
        key = g["key"].iloc[0]
        before = [frozenset(ks[ks < key].tolist()) for ks in map(np.asarray, g["least"])]
        found = tree_pairs(points, sizes, comp, left, right, num, den)
        return [(min(sid[i], sid[j]), max(sid[i], sid[j])) for i, j in found if before[i].isdisjoint(before[j])]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        carry: list[pd.DataFrame] = []
        last = None

        def flush(frames: list[pd.DataFrame]) -> pd.DataFrame:
            return pd.DataFrame(group(pd.concat(frames)), columns=["a", "b"])

        for b in batches:
            if not len(b):
                continue
            marks = b[["key", "i", "j"]].to_numpy()
            edges = [0, *(np.nonzero((marks[1:] != marks[:-1]).any(axis=1))[0] + 1).tolist(), len(b)]
            for s, e in zip(edges[:-1], edges[1:]):
                mark = tuple(marks[s])
                if mark != last and carry:
                    yield flush(carry)
                    carry = []
                carry.append(b.iloc[s:e])
                last = mark
        if carry:
            yield flush(carry)

    rows = members.select(*columns).repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return rows.mapInPandas(run, "a binary, b binary").distinct()


def join_components(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id. Sets link whose Jaccard is at least num / den."""
    return _join(docs, width, num, den, id_col, text_col).select("doc_id", "n_shingles", "component_id")


def _join(docs: DataFrame, width: int, num: int, den: int, id_col: str, text_col: str) -> DataFrame:
    """join_components with sid, and keeps: whether the set is the one that stands for its component."""
    spark = docs.sparkSession
    short_batches(spark)
    kind = docs.schema[id_col].dataType.simpleString()
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rare_first = not by_groups(num, den)
    first = save(_points(docs, width, rare_first), "points")
    cells = _count_table(first.filter("kind = 1")) if rare_first else None
    points = first.filter("kind = 0").select(F.col("doc_id").cast(kind).alias("doc_id"), "n", "sid")
    own = points.filter("n > 0").groupBy("sid").agg(F.min("doc_id").alias("low"), F.first("n").alias("n"))
    # h: the first eight bytes of the digest as a number; where two sets share it, both stand for it, and meet each other
    own = save(own.withColumn("h", _start_of("sid")), "sets", narrow=True)
    trees = save(_trees(docs, width, num, den, cells).distinct(), "trees", narrow=True)
    same_h = own.groupBy("h").count().filter("count > 1").select(F.col("h").alias("x"), F.col("h").alias("y"))
    met = trees.select(F.least("up", "h").alias("x"), F.greatest("up", "h").alias("y")).distinct().unionByName(same_h)
    used = met.select(F.explode(F.array("x", "y")).alias("h")).distinct()
    ends = save(own.join(used, "h").select("h", "sid", F.col("low").cast("string").alias("low"), "n"), "join-ends", narrow=True, rows="true")
    counted = save(_of_sets(docs, ends, width, "counts", counts_of), "join-points", narrow=True)
    at = lambda s, c: counted.select(F.col("sid").alias(s), F.col("counts").alias(c))

    def linked(pairs: DataFrame) -> DataFrame:
        """Links among pairs (a, n_a, b, n_b): by size, then by the bound, then by the true sets."""
        pairs = pairs.filter((F.least("n_a", "n_b") * den >= F.greatest("n_a", "n_b") * num))
        bounded = pairs.join(at("a", "counts_a"), "a").join(at("b", "counts_b"), "b").filter(_may_link(num, den)("counts_a", "counts_b", "n_a", "n_b"))
        return _links(docs, save(bounded.select("a", "b"), "star-pairs", narrow=True), ends, width, num, den)

    def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
        return save(components(labels.select(F.col("node").alias("a"), F.col("label").alias("b")).unionByName(links)), "labels")

    def apart(labels: DataFrame) -> DataFrame:
        """The members (key, sid, n, comp) of trees that hold several components."""
        named = ends.join(labels.withColumnRenamed("node", "sid"), "sid", "left").select("h", "sid", "n", F.coalesce("label", "sid").alias("comp"))
        comp = save(named, "comps", narrow=True)
        part = lambda h, c: comp.select(F.col("h").alias(h), F.col("comp").alias(c))
        keys = save(trees.join(part("up", "c_up"), "up").join(part("h", "c_h"), "h").filter("c_up != c_h").select("key").distinct(), "apart", narrow=True, rows="true")
        held = trees.join(small(keys, 16), "key", "left_semi").select("key", F.explode(F.array("up", "h")).alias("h")).distinct().join(comp, "h")
        out = save(held.select("key", "sid", "n", "comp"), "rest", narrow=True)
        forget(comp, keys)
        return out

    # first turn: members and centres
    side = lambda h, *names: ends.select(F.col("h").alias(h), *[F.col(c).alias(a) for c, a in zip(("sid", "n"), names)])
    labels = save(components(linked(met.join(side("x", "a", "n_a"), "x").join(side("y", "b", "n_b"), "y").filter("a < b or (x != y and a != b)"))), "labels")
    # again, with centres from the largest component of each tree: of a group of near copies few are left apart
    for turn in range(STARS):
        rest = apart(labels)
        one = F.struct(F.xxhash64("sid", F.lit(turn)).alias("order"), "sid", "n")
        largest = rest.groupBy("key", "comp").agg(F.count("*").alias("size"), F.min(one).alias("one")).groupBy("key").agg(F.max(F.struct("size", "comp", "one")).alias("c"))
        largest = save(largest.select("key", F.col("c.comp").alias("c_comp"), F.col("c.one.sid").alias("b"), F.col("c.one.n").alias("n_b")), "centres", narrow=True, rows="true")
        pairs = rest.join(small(largest, 64), "key").filter("comp != c_comp").select(F.col("sid").alias("a"), F.col("n").alias("n_a"), "b", "n_b").distinct()
        labels = merged(labels, linked(pairs))
        forget(rest, largest)
    # second turn: trees of three or more sets that still hold several components
    rest = apart(labels)
    # near copies share many keys: trees of equal members (by two hashes and the number) are searched once
    mark = lambda seed: F.expr(f"bit_xor(xxhash64(sid, {seed}))")
    sizes = rest.groupBy("key").agg(F.count("*").alias("size"), mark(1).alias("one"), mark(2).alias("two")).filter("size > 2")
    chosen = save(sizes.groupBy("one", "two", "size").agg(F.min("key").alias("key")).select("key", "size"), "chosen", narrow=True, rows="true")
    if rows_in(chosen):
        # members outside the largest component ask, all are found
        searched = save(rest.join(small(chosen, 24), "key"), "searched", narrow=True)
        # a set is in no more trees than it has keys
        least = searched.groupBy("sid").agg(F.slice(F.array_sort(F.collect_set("key")), 1, LEAST_KEYS).alias("least"))
        largest = searched.groupBy("key", "comp").agg(F.count("*").alias("own")).groupBy("key").agg(F.max(F.struct("own", "comp")).alias("c"))
        largest = save(largest.select("key", F.col("c.comp").alias("c_comp")), "tree-largest", narrow=True, rows="true")
        members = searched.join(small(largest, 32), "key").join(least.join(counted, "sid"), "sid").withColumn("asks", F.col("comp") != F.col("c_comp"))
        more = save(_search_trees(_in_nodes(members, num, den), num, den), "tree-pairs", narrow=True, rows="true")
        if rows_in(more):
            labels = merged(labels, _links(docs, more, ends, width, num, den))
        forget(searched, largest, more)
    forget(chosen)
    forget(trees, counted, rest, ends)
    named = own.select("sid", "low").join(labels.withColumnRenamed("node", "sid"), "sid", "left").withColumn("comp", F.coalesce("label", "sid"))
    lowest = named.groupBy("comp").agg(F.min(F.struct(F.col("low").isNull().alias("none"), "low", "sid")).alias("keep"))
    of_set = save(named.join(lowest, "comp").select("sid", F.col("keep.low").alias("component_id"), (F.col("sid") == F.col("keep.sid")).alias("keeps")), "components", narrow=True)
    forget(own)
    out = points.join(of_set, "sid", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), "sid", "keeps")


def _start_of(column: str):
    """The first eight bytes, little-endian, as a signed number that is never 0."""
    hexed = F.hex(F.substring(column, 1, 8))
    big_endian = F.concat(*[F.substring(hexed, i, 2) for i in range(15, 0, -2)])
    return F.conv(big_endian, 16, -10).cast("long").bitwiseOR(F.lit(1).cast("long"))


def keep_one_of_each(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of docs for each component, with all its columns: of the least identifier, and of the least set and one only where rows
    share it; rows without words stay. Rows go by identifier; where that doesn't tell them apart (it is null, or rows that stay have it too), by identifier and set.
    """
    found = _join(docs, width, num, den, id_col, text_col)
    first = F.col("keeps") & F.col("doc_id").eqNullSafe(F.col("component_id"))
    found = found.select(F.col("doc_id").alias("__id"), F.col("sid").alias("__sid"), ((F.col("n_shingles") > 0) & ~first).alias("gone"), (F.col("n_shingles") > 0).alias("words"))
    found = save(found, "near-rows", narrow=True, gone=F.col("gone"))
    gone = small(found.filter("gone").select("__id").distinct(), 16, rows_in(found, "gone"))
    # rows that can't be told apart by identifier: null, or repeated with one of them in a component of several rows or a set of several
    odd = found.groupBy("__id").agg(F.count("*").alias("rows"), F.max("gone").alias("any"), F.min("gone").alias("all"), (F.count_if("words") - F.count_distinct(F.when(F.col("words"), F.col("__sid")))).alias("again"))
    odd = save(odd.filter("(any and (not all or __id is null)) or again > 0").select("__id"), "near-odd", narrow=True, rows="true")
    same_id = F.col(id_col).eqNullSafe(F.col("__id"))
    if not rows_in(odd):
        return docs.join(gone, F.col(id_col) == F.col("__id"), "left_anti")

    @F.pandas_udf("binary")
    def set_of(texts: pd.Series) -> pd.Series:
        return pd.Series([_sid(t) if len(t) else None for t in sets(list(texts), width)], dtype=object)

    plain = docs.join(gone, F.col(id_col) == F.col("__id"), "left_anti").join(small(odd, 16), same_id, "left_anti")
    among = docs.join(small(odd, 16), same_id, "left_semi").withColumn("__own", set_of(F.col(text_col)))
    lost = found.filter("gone").select("__id", "__sid").distinct()
    among = among.join(small(lost, 48), same_id & (F.col("__own") == F.col("__sid")), "left_anti")
    silent = among.filter(F.col("__own").isNull())
    one = among.filter(F.col("__own").isNotNull()).dropDuplicates([id_col, "__own"])
    return plain.unionByName(silent.drop("__own")).unionByName(one.drop("__own"))
