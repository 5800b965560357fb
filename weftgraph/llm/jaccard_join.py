"""N-gram Jaccard join with signature trees.

Documents are sets of distinct five-word shingles; two link when 100 * intersection >= 75 * union.

1. Classes. Equal sets are collapsed to one class (a partial aggregation, so thousands of copies cost one
   row each); from here on a class has a number and stands for all its rows.
2. Parts. A tree over sets that have nothing in common has full bitmaps and prunes nothing, so the sets are
   dealt into parts first: each goes to the BANDS parts named by ROWS minima of its hashed shingles. A
   linked pair meets in no part with probability at most (1 - 0.75**ROWS) ** BANDS, 2.2e-7 at exactly 0.75
   and far less above it. Parts with one member end here; parts with the same members are kept once.
3. Signature trees of the parts. The members of a part are split into size ranges, each with a tree: a
   leaf holds a set's token bitmap, a node the OR of its children's, their size range and the most tokens
   that share a bit. Trees of the same and of neighbouring ranges are traversed together; a node pair is
   dropped when its largest possible overlap, or its size ranges, cannot reach the threshold. What is left
   connects sets that *may* link into families. A part of more than BLOCK members is one family.
4. Signature trees of the families, on exact sets: each set is shipped once, to its family. Bitmaps run over the
   tokens that the family shares, so that the overlap of two leaves is the exact intersection. Node pairs that
   earlier links already connect are skipped, so a group of n copies yields n - 1 links, not n**2 / 2.
5. Families of more than BLOCK sets are dealt into blocks by size range and hash, a tree each; the components
   found go up a level, one set each; at the end blocks meet pairwise where they do not lie in one component
   yet and their size ranges allow it.
6. Components of the links by union and find, or alternating stars.

Shingles are 64-bit hashes: two different shingles of a pair of documents with n shingles in all are mixed up with
probability n**2 / 2**65 (1e-13 for two documents of 1000 words).

Defined results: a null or empty text, or one without words, has n_shingles 0 and is its own component;
fewer than five words make one shingle; a component is named by its least doc_id; rows are judged one by
one, so rows that share a doc_id may lie in different components; a row without an id takes part through
rows of the same set only (component_id null where there is none); extra columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, by_group, map_arrow, materialize, rows
from .components import components
from .wordhash import mix, shingle_sets

BANDS, ROWS = 28, 3
#: Sets, shingles and bytes of bitmaps of a block: what one task holds at once is two blocks.
BLOCK, BLOCK_TOKENS, BLOCK_BYTES = 2048, 2_000_000, 64 << 20
FANOUT = 8
#: Node pairs, and words of bitmaps, that are compared in one go.
PAIRS, WORDS = 1 << 15, 1 << 21
#: Ids of at most so many sets are broadcast (40 MB); beyond it they are joined.
BROADCAST_IDS = 1_000_000

_rng = np.random.default_rng(20240607)
_ADD = _rng.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32)
_MUL = _rng.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32) | np.uint32(1)


def band_keys(shingles: np.ndarray) -> np.ndarray:
    """BANDS 64-bit keys of a non-empty set."""
    low = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    for k in range(0, len(low), 512):
        np.minimum(least, ((low[k : k + 512, None] ^ _ADD) * _MUL).min(axis=0), out=least)
    grouped = least.reshape(BANDS, ROWS).astype(np.uint64)
    key = np.arange(BANDS, dtype=np.uint64)
    for j in range(ROWS):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + grouped[:, j])
    return key.astype(np.int64)


def set_digest(shingles: np.ndarray) -> tuple[int, int]:
    """128 bits of a sorted set."""
    if not len(shingles):
        return 0, 0
    with np.errstate(over="ignore"):
        return int(mix(shingles ^ np.uint64(0x51)).sum(dtype=np.uint64).astype(np.int64)), int(np.bitwise_xor.reduce(mix(shingles * np.uint64(0xD6E8FEB86659FD93))).astype(np.int64))


def _sketches(batches):
    for ids, texts in rows(batches, "doc_id", "text"):
        made = [(len(s), *set_digest(s), band_keys(s) if len(s) else []) for s in shingle_sets(texts)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), *(pa.array([m[k] for m in made], pa.int64()) for k in range(3)), pa.array([m[3] for m in made], pa.list_(pa.int64()))],
            names=["doc_id", "n_shingles", "d1", "d2", "keys"],
        )


def _sets(batches):
    """Number, size, exact set and bitmap of the classes whose text this is (by digest: ids may repeat)."""
    for number, size, d1, d2, texts in rows(batches, "c", "size", "d1", "d2", "text"):
        kept = [(c, n, s.tobytes(), bitmap(s, width(n)).tobytes()) for c, n, a, b, s in zip(number, size, d1, d2, shingle_sets(texts), strict=True) if (n, a, b) == (len(s), *set_digest(s))]
        types = (pa.int64(), pa.int64(), pa.binary(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array([k[i] for k in kept], t) for i, t in enumerate(types)], names=["c", "size", "shingles", "map"])


def width(n: int) -> int:
    """Bits of the bitmap of a set of n tokens: 4 to 8 for each, a power of two."""
    return 1 << max(6, (4 * n - 1).bit_length())


def bitmap(tokens: np.ndarray, bits: int) -> np.ndarray:
    """Bit t modulo ``bits`` for each token t."""
    on = np.zeros(bits, bool)
    on[tokens % np.uint64(bits)] = True
    return np.packbits(on, bitorder="little").view(np.uint64)


class Tree:
    """A signature tree over leaves in the order given: bitmaps, sizes, tokens beyond the bits, and each leaf's place among all sets."""

    def __init__(self, maps: np.ndarray, size: np.ndarray, excess: np.ndarray, at: np.ndarray):
        self.at, self.levels, self.spans, self.version = at, [(maps, size, size, excess)], [], -1
        while len(self.levels[-1][1]) > 1:
            m, lo, hi, ex = self.levels[-1]
            k = np.arange(0, len(lo), FANOUT)
            self.levels.append((np.bitwise_or.reduceat(m, k), np.minimum.reduceat(lo, k), np.maximum.reduceat(hi, k), np.maximum.reduceat(ex, k)))

    @property
    def top(self) -> int:
        return len(self.levels) - 1

    def components(self, level: int, union: Union) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest component of the leaves below each node."""
        if self.version != union.version:
            name = union.names()[self.at]
            self.spans, self.version = [(name, name)], union.version
            for _ in range(self.top):
                lo, hi = self.spans[-1]
                k = np.arange(0, len(lo), FANOUT)
                self.spans.append((np.minimum.reduceat(lo, k), np.maximum.reduceat(hi, k)))
        return self.spans[level]


def may_link(x: tuple, y: tuple, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which node pairs (i, j) can hold a linked pair.

    The tokens two sets share take at least (shared - excess) common bits, where excess counts the
    tokens of a set beyond its bits; so shared <= common bits + the smaller excess.
    """
    keep = (4 * x[2][i] >= 3 * y[1][j]) & (4 * y[2][j] >= 3 * x[1][i])
    left = np.flatnonzero(keep)
    step = max(1, WORDS // x[0].shape[1])
    for k in range(0, len(left), step):
        at = left[k : k + step]
        a, b = i[at], j[at]
        common = np.bitwise_count(x[0][a] & y[0][b]).sum(axis=1, dtype=np.int64) + np.minimum(x[3][a], y[3][b])
        keep[at] = 175 * np.minimum(common, np.minimum(x[2][a], y[2][b])) >= 75 * (x[1][a] + y[1][b])
    return keep


class Union:
    """Union and find; ``version`` changes with every new link."""

    def __init__(self, n: int):
        self.up, self.version = list(range(n)), 0

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        if i == j:
            return False
        self.up[max(i, j)] = min(i, j)
        self.version += 1
        return True

    def names(self) -> np.ndarray:
        up = np.array(self.up)
        while (up != up[up]).any():
            up = up[up]
        return up


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= 75 * (len(a) + len(b) - both)


def traverse(x: Tree, y: Tree, union: Union, verify=None) -> list[tuple[int, int]]:
    """Dual traversal: joins in ``union`` all pairs of leaves that may link (and that ``verify`` confirms); the new links."""
    found: list[tuple[int, int]] = []
    child, same = np.arange(FANOUT), x is y
    zero = np.zeros(1, np.int64)
    stack = [(x.top, y.top, zero, zero)]
    while stack:
        lx, ly, i, j = stack.pop()
        if max(x.top, y.top) > 1 or lx == ly == 0:
            (xl, xh), (yl, yh) = x.components(lx, union), y.components(ly, union)
            apart = ~((xl[i] == xh[i]) & (yl[j] == yh[j]) & (xl[i] == yl[j]))
            i, j = i[apart], j[apart]
            keep = may_link(x.levels[lx], y.levels[ly], i, j)
            i, j = i[keep], j[keep]
        if not len(i):
            continue
        if lx == ly == 0:
            for p, q in zip(x.at[i].tolist(), y.at[j].tolist(), strict=True):
                if (verify is None or (union.find(p) != union.find(q) and verify(p, q))) and union.join(p, q):
                    found.append((p, q))
            continue
        down_x, down_y = lx >= ly, ly >= lx
        a = i[:, None, None] * FANOUT + child[:, None] if down_x else i[:, None, None]
        b = j[:, None, None] * FANOUT + child if down_y else j[:, None, None]
        a, b = np.broadcast_arrays(a, b)
        lx, ly = lx - down_x, ly - down_y
        there = (a < len(x.levels[lx][1])) & (b < len(y.levels[ly][1]))
        if same:
            there &= a < b if lx == 0 else a <= b
        a, b = a[there], b[there]
        stack += [(lx, ly, a[k : k + PAIRS], b[k : k + PAIRS]) for k in range(0, len(a), PAIRS)]
    return found


def bitmap_links(size: np.ndarray, maps: list[bytes]) -> list[tuple[int, int]]:
    """Pairs that connect all sets that may link, by trees of the size ranges that the bitmaps' widths stand for."""
    union, found = Union(len(maps)), []
    by_width: dict[int, list[int]] = {}
    for i, m in enumerate(maps):
        by_width.setdefault(len(m) // 8, []).append(i)

    def tree(at: list[int], fold: bool = False) -> Tree:
        m = np.frombuffer(b"".join(maps[i] for i in at), np.uint64).reshape(len(at), -1)
        if fold:
            m = m[:, : m.shape[1] // 2] | m[:, m.shape[1] // 2 :]
        return Tree(m, size[at], size[at] - np.bitwise_count(m).sum(axis=1, dtype=np.int64), np.array(at))

    for words, at in by_width.items():
        x = tree(at)
        if len(at) > 1:
            found += traverse(x, x, union)
        if (wider := by_width.get(2 * words)) is not None:
            found += traverse(x, tree(wider, True), union)
    return found


def set_links(sets: list[np.ndarray], known: list[int] | None = None, cut: int | None = None) -> list[tuple[int, int]]:
    """Links that connect everything that is connected among the sets; with ``cut`` only between those before and from it.

    ``known``: component of each set so far; pairs within one are skipped.
    """
    union, found = Union(len(sets)), []
    first: dict[int, int] = {}
    for i, c in enumerate(known or []):
        union.join(first.setdefault(c, i), i)
    lengths = np.array([len(s) for s in sets])
    every, place, uses = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = uses > 1
    number = np.where(shared, np.cumsum(shared) - 1, -1)[place]
    bits = -(-max(1, int(shared.sum())) // 64) * 64
    folded = max(1, BLOCK_BYTES // (8 * len(sets))) * 64
    exact = bits <= folded
    bits = min(bits, folded)
    ends = np.cumsum(lengths)
    maps, excess = np.zeros((len(sets), bits // 64), np.uint64), np.zeros(len(sets), np.int64)
    for i, (n, end) in enumerate(zip(lengths.tolist(), ends.tolist(), strict=True)):
        own = number[end - n : end]
        own = own[own >= 0]
        maps[i] = bitmap(own.astype(np.uint64), bits)
        excess[i] = 0 if exact else len(own) - int(np.bitwise_count(maps[i]).sum())
    verify = None if exact else lambda p, q: linked(sets[p], sets[q])
    # Sets with the same least tokens stand next to each other.
    order = np.lexsort((lengths, [s[0] for s in sets]))
    side = np.zeros(len(sets), np.int64) if cut is None else (np.arange(len(sets)) >= cut).astype(np.int64)
    ranges = [int(n).bit_length() for n in lengths]
    trees: dict[tuple[int, int], Tree] = {}
    for s in (0,) if cut is None else (0, 1):
        for r in set(ranges):
            at = order[(side[order] == s) & (np.array(ranges)[order] == r)]
            if len(at):
                trees[s, r] = Tree(maps[at], lengths[at], excess[at], at)
    for (s, r), x in trees.items():
        if cut is None:
            pairs = [(x, x), (x, trees.get((0, r + 1)))]
        else:
            pairs = [(x, trees.get((1, q))) for q in (r - 1, r, r + 1)] if s == 0 else []
        for a, b in pairs:
            if b is not None:
                found += traverse(a, b, union, verify)
    return found


def _distinct(numbers: list[int]) -> list[int]:
    """Places of the first of each number (rows of a table may repeat)."""
    return list(dict(zip(reversed(numbers), reversed(range(len(numbers))), strict=True)).values())[::-1]


def _links_of_part(g: dict) -> tuple[list, list]:
    at = _distinct(g["c"])
    found = bitmap_links(np.array([g["size"][i] for i in at]), [g["map"][i] for i in at])
    return [g["c"][at[p]] for p, _ in found], [g["c"][at[q]] for _, q in found]


def _links_of_block(g: dict) -> tuple[list, list]:
    """Links of one block, or of two blocks of a family with each other."""
    at = _distinct(g["c"])
    cut = sum(g["side"][i] == 0 for i in at)
    at.sort(key=lambda i: g["side"][i])
    found = set_links([np.frombuffer(g["shingles"][i], np.uint64) for i in at], [g["comp"][i] for i in at], None if cut == len(at) else cut)
    return [g["c"][at[p]] for p, _ in found], [g["c"][at[q]] for _, q in found]


LINKS = "u long, v long"


def jaccard_components(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    with Scratch(docs.sparkSession) as scratch:
        sketch = scratch(map_arrow(docs, _sketches, "doc_id long, n_shingles long, d1 long, d2 long, keys array<long>"), "sketch")
        classes = sketch.where("n_shingles > 0").groupBy("d1", "d2", F.col("n_shingles").alias("size")).agg(F.min("doc_id").alias("least"), F.first("keys").alias("keys")).where("least is not null")
        classes = scratch(classes.withColumn("c", F.monotonically_increasing_id()), "classes")
        members = _parts(classes, scratch)
        sets = _with_sets(docs, classes, members, scratch)
        family = components(_may_link(members, sets, scratch), scratch)
        scratch.drop(members)
        links = _link_families(family.select(F.col("id").alias("c"), F.col("component").alias("family")).join(sets.select("c", "size").distinct(), "c"), sets, scratch)
        named = classes.select("d1", "d2", "size", "least", "c").join(components(links, scratch), F.col("c") == F.col("id"), "left").withColumn("component", F.coalesce("component", "c"))
        least = named.where("id is not null").groupBy("component").agg(F.min("least").alias("name"))
        named = named.join(least, "component", "left").select("d1", "d2", F.col("size").alias("n_shingles"), F.coalesce("name", "least").alias("component_id"))
        out = sketch.select("doc_id", "n_shingles", "d1", "d2").join(named, ["d1", "d2", "n_shingles"], "left")
        return materialize(out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")), "jaccard-components")


def _parts(classes: DataFrame, scratch: Scratch) -> DataFrame:
    """part, c, n (members), least of the parts with two members or more; parts with the same members once."""
    members = classes.select("c", F.explode("keys").alias("part"))
    parts = members.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("least"), F.sum(F.xxhash64("c").cast("decimal(38,0)")).alias("s")).where("n > 1")
    parts = scratch(parts.groupBy("n", "least", "s").agg(F.min("part").alias("part")).select("part", "n", "least"), "parts")
    return scratch(members.join(parts, "part").select("part", "c", "n", "least"), "members")


def _with_sets(docs: DataFrame, classes: DataFrame, members: DataFrame, scratch: Scratch) -> DataFrame:
    """c, size, shingles, map: the exact sets and bitmaps of all members."""
    active = scratch(members.select("c").distinct().join(classes, "c").select("c", "size", "d1", "d2", F.col("least").alias("doc_id")), "active")
    n = active.count()
    texts = docs.join(F.broadcast(active) if n <= BROADCAST_IDS else active, "doc_id")
    return scratch(map_arrow(texts.select("c", "size", "d1", "d2", "text"), _sets, "c long, size long, shingles binary, map binary"), "sets")


def _may_link(members: DataFrame, sets: DataFrame, scratch: Scratch) -> DataFrame:
    """Pairs that connect all sets that may link."""
    small = members.where(F.col("n") <= BLOCK).select("part", "c").join(sets.select("c", "size", "map"), "c")
    large = members.where(F.col("n") > BLOCK).select(F.col("c").alias("u"), F.col("least").alias("v")).where("u <> v")
    return scratch(by_group(small, ["part"], _links_of_part, LINKS).unionByName(large), "may-link")


def _deal(members: DataFrame) -> DataFrame:
    """Members (family, c, size) with their block: large families by size range and a hash."""
    ranged = members.withColumn("range", F.floor(F.log(2.0, "size")))
    stats = ranged.groupBy("family", "range").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("t"))
    whole = stats.groupBy("family").agg(F.sum("n").alias("n_all"), F.sum("t").alias("t_all")).where((F.col("n_all") > BLOCK) | (F.col("t_all") > BLOCK_TOKENS))
    large = stats.join(whole, "family").select("family", "range", F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("t") / BLOCK_TOKENS)).alias("k"))
    block = F.concat_ws("/", F.col("range").cast("string"), F.pmod(F.xxhash64("c"), F.col("k")).cast("string"))
    return ranged.join(large, ["family", "range"], "left").withColumn("block", F.when(F.col("k").isNull(), F.lit("")).otherwise(block)).drop("range", "k")


def _trees(blocks: DataFrame, sets: DataFrame) -> DataFrame:
    held = blocks.select("family", "block", "c", F.col("c").alias("comp"), F.lit(0).alias("side")).join(sets.select("c", "shingles"), "c")
    return by_group(held, ["family", "block"], _links_of_block, LINKS)


def _link_families(members: DataFrame, sets: DataFrame, scratch: Scratch) -> DataFrame:
    """Links that connect what is connected within the families (family, c, size).

    First the trees of all blocks. Large families then go up a level at a time: one member for each component
    stands for it, and these are dealt into blocks again, until they fit one block or little more joins.
    What members of different components can still link is left to :func:`_across`.
    """
    dealt = scratch(_deal(members), "blocks")
    links = scratch(_trees(dealt, sets), "links")
    large = dealt.where("block <> ''")
    if large.isEmpty():
        return links
    level = large.drop("block")
    while True:
        named = level.join(components(links, scratch), F.col("c") == F.col("id"), "left").withColumn("comp", F.coalesce("component", "c"))
        heads = named.groupBy("family", "comp").agg(F.min(F.struct("c", "size")).alias("h")).select("family", "h.c", "h.size")
        several = heads.groupBy("family").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("family")
        above = scratch(heads.join(several, "family"), "heads")
        if above.isEmpty() or 2 * above.count() > level.count():
            break
        links = scratch(links.unionByName(_trees(_deal(above), sets)), "links")
        level = above
    return _across(links, large, sets, scratch)


def _across(links: DataFrame, blocks: DataFrame, sets: DataFrame, scratch: Scratch) -> DataFrame:
    """Add the links between different blocks of the large families that no component holds yet."""
    named = blocks.join(components(links, scratch), F.col("c") == F.col("id"), "left").select("family", "block", "c", "size", F.coalesce("component", "c").alias("comp"))
    named = scratch(named, "named-blocks")
    roots = named.groupBy("family", "block").agg(F.min("comp").alias("c1"), F.max("comp").alias("c2"), F.min("size").alias("s1"), F.max("size").alias("s2"))
    a, b = roots.alias("a"), roots.alias("b")
    one = (F.col("a.c1") == F.col("a.c2")) & (F.col("b.c1") == F.col("b.c2")) & (F.col("a.c1") == F.col("b.c1"))
    fits = (4 * F.col("a.s2") >= 3 * F.col("b.s1")) & (4 * F.col("b.s2") >= 3 * F.col("a.s1"))
    pairs = a.join(b, (F.col("a.family") == F.col("b.family")) & (F.col("a.block") < F.col("b.block")) & fits & ~one)
    pairs = scratch(pairs.select(F.col("a.family").alias("family"), F.col("a.block").alias("x"), F.col("b.block").alias("y")), "block-pairs")
    if pairs.isEmpty():
        return links
    side = lambda at, k: pairs.join(named.withColumnRenamed("block", at), ["family", at]).select("family", "x", "y", "c", "comp", F.lit(k).alias("side"))
    held = side("x", 0).union(side("y", 1)).join(sets.select("c", "shingles"), "c")
    return scratch(links.unionByName(by_group(held, ["family", "x", "y"], _links_of_block, LINKS)), "links")


def one_of_each_group(docs: DataFrame) -> DataFrame:
    """The documents, all columns, without those that link (directly or not) to one with a smaller doc_id.

    Ids go, not rows: an id stays when any of its rows names a component. Null ids stay.
    """
    stays = F.max(F.col("doc_id") == F.col("component_id")).alias("stays")
    gone = materialize(jaccard_components(docs).where("doc_id is not null").groupBy("doc_id").agg(stays).where("not stays").select("doc_id"), "near-copies")
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)
