"""Exact Jaccard join of documents' word shingles: prefix blocks, then signature trees.

1. Every document is the set of its distinct 5-word shingles, held as 63-bit hashes in one global
   order: shingles seen often come last. Equal sets are one class.
2. Two sets of Jaccard 0.75 share a shingle among the first n - ceil(0.75 n) + 1 of each. Those
   shingles, and no others, are shuffled; a shingle with one class, or with sizes that rule each
   other out, ends there. Blocks with the same smallest class form a family.
3. Families (cut into tiles of bounded size) build signature trees over token bitmaps: nodes hold
   OR-combined bitmaps and size ranges, and a dual traversal drops node pairs whose largest
   possible overlap is too small. What is left connects classes into candidate groups.
4. Only those classes get their full sets, each once for its group (again in tiles and trees), and
   what the trees leave is verified exactly. The links give components.

Which shingles count as often seen only changes the order, never the result.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillgraph.functions.session import cut, gathered, narrow_batches, release
from quillgraph.llm.text import WordHasher, map_batches, mix, text_slices
from quillgraph.operators.components import connected_components

WIDTH = 5
#: Similarity as a whole-number ratio: 100 * intersection >= PERCENT * union.
PERCENT = 75
#: Often-seen shingles that are put last in the order; bounds what is sent with the plan (8 bytes each).
HOT_TOKENS = 131_072
#: Tokens counted at a time while looking for them.
COUNT_TOKENS = 1 << 20
#: Members of a family handled together; a larger family is cut into tiles (see ``group_links``).
TILE = 256
#: Documents to compare, with their places, that may be broadcast (64 bytes each at most); beyond it their texts are shuffled.
BROADCAST_DOCS = 500_000
#: Rows with a set or its bitmap that a task should have at least.
PAYLOAD_ROWS = 1000

_cut = partial(cut, in_loop=True)
_HOT = np.uint64(1 << 63)
_PARTS = 8
_BUCKET = np.log(1.06)
#: Size buckets apart at which the sizes alone rule a link out.
_APART = int(np.ceil(np.log(100 / PERCENT) / _BUCKET)) + 1
#: Low bits of a shuffled shingle that hold its reach, and the largest block whose pairs are tried by it.
_REACH_BITS = 5
_REACH = (1 << _REACH_BITS) - 1
PAIRED = 32


class ShingleSets:
    """Sorted shingle keys of texts; the top bit marks often-seen shingles."""

    def __init__(self, seed: int, hot: np.ndarray | None = None, width: int = WIDTH):
        self.hasher, self.width = WordHasher(seed), width
        self.hot = np.sort(hot) if hot is not None and len(hot) else None
        if self.hot is not None:
            self.maybe = np.zeros(1 << 20, bool)
            self.maybe[self.hot & np.uint64((1 << 20) - 1)] = True

    def _mark(self, keys: np.ndarray) -> np.ndarray:
        if self.hot is not None:
            some = np.flatnonzero(self.maybe[keys & np.uint64((1 << 20) - 1)])
            at = np.searchsorted(self.hot, keys[some])
            at[at == len(self.hot)] = 0
            some = some[self.hot[at] == keys[some]]
            keys[some] |= _HOT
        return keys

    def of(self, column: pa.Array):
        """(row, sorted distinct keys) of every text; no word gives an empty array."""
        for row, data, bounds in text_slices(column):
            words, counts, _ = self.hasher.words(data, bounds)
            keys = self._mark(self.hasher.runs(words, self.width) >> np.uint64(1))
            at = 0
            for i, n in enumerate(counts.tolist()):
                if n >= self.width:
                    own = np.sort(keys[at : at + n - self.width + 1])
                    if len(own) > 1:
                        fresh = np.empty(len(own), bool)
                        fresh[0] = True
                        np.not_equal(own[1:], own[:-1], out=fresh[1:])
                        own = own[fresh]
                elif n:
                    own = self._mark(self.hasher.runs(words[at : at + n], n) >> np.uint64(1))
                else:
                    own = np.empty(0, np.uint64)
                yield row + i, own
                at += n


def class_key(keys: np.ndarray) -> tuple[int, int]:
    """Key of a set (its low byte a bucket of the size) and a check value, as signed 64-bit."""
    bucket = int(_bucket(np.array([len(keys)]))[0])
    mixed = mix(keys)
    first = (int(mixed.sum(dtype=np.uint64)) & ~0xFF) | bucket
    second = int(mix(mixed + np.uint64(len(keys))).sum(dtype=np.uint64))
    return tuple(x - (1 << 64) if x >= 1 << 63 else x for x in (first, second))


def prefix_length(n: int, percent: int = PERCENT) -> int:
    return n - -(-percent * n // 100) + 1


def _bucket(n):
    return np.minimum(255, (np.log(n) / _BUCKET).astype(np.int64))


def prefix(keys: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """The first shingles of a sorted set, each with its reach in the low bits.

    If the shingle at place i is the first that two sets share, their overlap is n - i at most. So the
    other has (100 / percent + 1) * (n - i) - n shingles at most; the reach is the bucket of that size,
    counted from the set's own bucket less _APART. Two sets link only if the first shingle they share
    reaches both sizes.
    """
    n = len(keys)
    at = np.arange(prefix_length(n, percent))
    most = np.maximum(1, (100 + percent) * (n - at) // percent - n)
    reach = np.clip(_bucket(most) - _bucket(np.array([n])) + _APART, 0, _REACH)
    return (keys[: len(at)] & np.uint64(~_REACH & (1 << 64) - 1)).astype(np.int64) | reach


def often_seen(docs: DataFrame, seed: int) -> np.ndarray:
    """The HOT_TOKENS shingles of highest count among those frequent in some stretch of documents."""

    def make():
        sets = ShingleSets(seed)
        return sets

    def run(batches):
        sets, held, n, docs_n = make(), [], 0, 0

        def flush():
            keys, counts = np.unique(np.concatenate(held), return_counts=True)
            keep = counts >= max(4, docs_n // 2000)
            return pa.RecordBatch.from_arrays([pa.array(keys[keep].astype(np.int64)), pa.array(counts[keep].astype(np.int64))], names=["token", "n"])

        for batch in batches:
            for _, keys in sets.of(batch.column(0)):
                held.append(keys)
                n += len(keys)
                docs_n += 1
                if n >= COUNT_TOKENS:
                    yield flush()
                    held, n, docs_n = [], 0, 0
        if n:
            yield flush()

    narrow_batches(docs.sparkSession)
    seen = docs.select("text").mapInArrow(run, "token long, n long")
    top = seen.groupBy("token").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "token").limit(HOT_TOKENS).select("token").toArrow()
    return top.column(0).to_numpy().astype(np.uint64)


def document_sets(docs: DataFrame, seed: int, hot: np.ndarray) -> DataFrame:
    """(doc_id, n, c, check, prefix array<long>, bits) of every row; c is null for an empty set."""

    def make():
        sets = ShingleSets(seed, hot)

        def each(batch: pa.RecordBatch):
            ns, cs, checks, prefixes, bits, here = [], [], [], [], [], set()
            for _, keys in sets.of(batch.column(1)):
                n = len(keys)
                ns.append(n)
                if not n:
                    cs.append(None), checks.append(None), prefixes.append(None), bits.append(None)
                    continue
                c, check = class_key(keys)
                cs.append(c), checks.append(check)
                again = (c, check) in here
                prefixes.append(None if again else prefix(keys))
                bits.append(None if again else bitmap(keys).tobytes())
                here.add((c, check))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(ns, pa.int64()), pa.array(cs, pa.int64()), pa.array(checks, pa.int64()), pa.array(prefixes, pa.list_(pa.int64())), pa.array(bits, pa.binary())],
                names=["doc_id", "n", "c", "check", "prefix", "bits"],
            )

        return each

    return map_batches(docs, ["doc_id", "text"], make, f"doc_id {dict(docs.dtypes)['doc_id']}, n long, c long, check long, prefix array<long>, bits binary")


def _groups(*keys: np.ndarray) -> np.ndarray:
    """Start of every run of equal keys in sorted arrays."""
    n = len(keys[0])
    new = np.zeros(n, bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def _block_rows(batches):
    """Reduce a partition of (token, c) rows to (token, fam, c): see ``families``.

    The partition is held once (16 bytes a row) and handled in _PARTS parts, all rows of a token in one.
    """
    parts = [[] for _ in range(_PARTS)]
    for b in batches:
        if b.num_rows:
            token, c = b.column(0).to_numpy(), b.column(1).to_numpy()
            part = (token >> 7) & (_PARTS - 1)
            for k in range(_PARTS):
                mine = part == k
                parts[k].append((token[mine], c[mine]))
    for k in range(_PARTS):
        if parts[k]:
            token, c = (np.concatenate(x) for x in zip(*parts[k], strict=True))
            parts[k] = []
            yield from _blocks(token, c)


def _blocks(token: np.ndarray, c: np.ndarray):
    bucket, reach, token = c & 0xFF, token & _REACH, token & ~_REACH
    order = np.lexsort((c, bucket, token))
    token, c, bucket, reach = token[order], c[order], bucket[order], reach[order]
    once = np.ones(len(token), bool)
    once[1:] = (token[1:] != token[:-1]) | (c[1:] != c[:-1])
    token, c, bucket, reach = token[once], c[once], bucket[once], reach[once]
    hot = token < 0
    yield from _batches(token[hot], None, c[hot])
    token, c, bucket, reach = token[~hot], c[~hot], bucket[~hot], reach[~hot]
    block, sizes = _near_blocks(token, bucket)
    if not len(block):
        return
    keep = _reached(block, sizes[block], bucket, bucket + reach - _APART)
    # Without the rows that no other reaches, a block may fall apart.
    token, c, bucket = token[keep], c[keep], bucket[keep]
    block, sizes = _near_blocks(token, bucket)
    if not len(block):
        return
    keep = sizes[block] > 1
    fam = np.minimum.reduceat(c, np.cumsum(sizes) - sizes)[block]
    pairs = np.unique(np.stack([fam[keep], c[keep]]), axis=1)
    yield from _batches(None, pairs[0], pairs[1])


def _near_blocks(token: np.ndarray, bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of every row's block, and the blocks' sizes: rows of one shingle, each near the next in size."""
    near = np.zeros(len(token), bool)  # row i and the row before may link
    near[1:] = (token[1:] == token[:-1]) & (bucket[1:] - bucket[:-1] <= _APART)
    starts = np.flatnonzero(~near)
    sizes = np.diff(np.append(starts, len(token)))
    return np.repeat(np.arange(len(starts)), sizes), sizes


def _reached(block: np.ndarray, size: np.ndarray, bucket: np.ndarray, top: np.ndarray) -> np.ndarray:
    """Rows that reach some other row of their block and are reached by it; all of a block above PAIRED."""
    found = size > PAIRED
    small = np.flatnonzero((size > 1) & ~found)
    block, bucket, top = block[small], bucket[small], top[small]
    both = np.zeros(len(small), bool)
    for s in range(1, min(PAIRED, len(small))):
        same = np.flatnonzero(block[s:] == block[:-s])
        if not len(same):
            break
        met = same[(bucket[same] <= top[same + s]) & (bucket[same + s] <= top[same])]
        both[met] = both[met + s] = True
    found[small] = both
    return found


def _batches(token, fam, c, rows: int = 100_000):
    for at in range(0, len(c), rows):
        part = c[at : at + rows]
        null = pa.nulls(len(part), pa.int64())
        yield pa.RecordBatch.from_arrays([null if token is None else pa.array(token[at : at + rows]), null if fam is None else pa.array(fam[at : at + rows]), pa.array(part)], names=["token", "fam", "c"])


def families(sets: DataFrame) -> DataFrame:
    """(fam, c): classes that may link, gathered under the smallest class of their block.

    An often-seen shingle is dealt out by shingle and class, so that no task holds all its rows. Its
    classes are cut by size into overlapping windows, so that any two that may link share one; a
    window's smallest class is found by a pre-aggregated minimum.
    """
    tokens = sets.where("prefix is not null").select(F.explode("prefix").alias("token"), "c")
    dealt = tokens.repartition(F.shiftright("token", _REACH_BITS), F.when(F.col("token") < 0, F.pmod(F.col("c"), F.lit(1024))).otherwise(0))
    blocks = cut(dealt.mapInArrow(_block_rows, "token long, fam long, c long"))
    window = F.floor(F.col("c").bitwiseAND(F.lit(0xFF)) / _APART)
    hot = blocks.where("token is not null").select("token", "c", F.explode(F.array(window, window - 1)).alias("window"))
    hot = hot.select(F.xxhash64("token", "window").alias("place"), "c")
    least = hot.groupBy("place").agg(F.min("c").alias("fam"), F.max("c").alias("last")).where("fam <> last").select(F.col("place").alias("k"), "fam")
    # Materialised, so that Spark can split a large window's side of the join.
    hot = hot.join(cut(least), F.col("place") == F.col("k")).select("fam", "c")
    return blocks.where("token is null").select("fam", "c").unionByName(hot).distinct()


def bitmap(keys: np.ndarray) -> np.ndarray:
    """Token bitmap of a set: a power of two of bits, four or more a token up to 65 536."""
    bits = min(1 << 16, max(256, 1 << int(4 * len(keys) - 1).bit_length()))
    flags = np.zeros(bits, np.uint8)
    flags[mix(keys) & np.uint64(bits - 1)] = 1
    return np.packbits(flags, bitorder="little").view(np.uint64)


class Signatures:
    """Bitmaps of sets brought to one width, sizes, and the tokens beyond the bits they set."""

    def __init__(self, sizes: np.ndarray, bitmaps: list[np.ndarray]):
        self.sizes = sizes
        self.spare = sizes - np.array([int(np.bitwise_count(b).sum()) for b in bitmaps], np.int64)
        self.own = np.array([len(b) for b in bitmaps], np.int64)
        self.width = int(self.own.max())
        # A narrower bitmap is repeated: a token's wide bit is then set wherever its narrow bit is, and
        # common bits of two sets count width / (wider of the two) times.
        self.bits = np.stack([np.tile(b, self.width // len(b)) for b in bitmaps])
        self.order = np.lexsort((self.bits[:, 0], sizes))


def signature_tree(sig: Signatures, members: np.ndarray, leaf: int = 16, fan: int = 4):
    """Root of a tree of (OR of bitmaps, least size, largest size, largest spare, rows, children, widest)."""
    order = sig.order[np.isin(sig.order, members)]
    level = []
    for at in range(0, len(order), leaf):
        rows = order[at : at + leaf]
        level.append((np.bitwise_or.reduce(sig.bits[rows]), int(sig.sizes[rows].min()), int(sig.sizes[rows].max()), int(sig.spare[rows].max()), rows, (), int(sig.own[rows].max())))
    while len(level) > 1:
        up = []
        for at in range(0, len(level), fan):
            kids = tuple(level[at : at + fan])
            up.append((np.bitwise_or.reduce([k[0] for k in kids]), min(k[1] for k in kids), max(k[2] for k in kids), max(k[3] for k in kids), None, kids, max(k[6] for k in kids)))
        level = up
    return level[0]


def _may_link(a, b, width: int, percent: int) -> bool:
    """Whether some pair of sets under the two nodes can reach the similarity."""
    if 100 * a[2] < percent * b[1] or 100 * b[2] < percent * a[1]:
        return False
    overlap = min(int(np.bitwise_count(a[0] & b[0]).sum()) * max(a[6], b[6]) // width + min(a[3], b[3]), a[2], b[2])
    return (100 + percent) * overlap >= percent * (a[1] + b[1])


def candidate_pairs(sig: Signatures, side: np.ndarray | None = None, percent: int = PERCENT):
    """Dual traversal: arrays (p, q) of the pairs that the trees cannot rule out, likeliest first.

    With ``side`` (0 or 1 for each set) only pairs across the sides are compared.
    """
    everyone = np.arange(len(sig.sizes))
    if side is None:
        root = signature_tree(sig, everyone)
        stack = [(root, root)]
    else:
        parts = [everyone[side == s] for s in (0, 1)]
        if not len(parts[0]) or not len(parts[1]):
            return
        stack = [(signature_tree(sig, parts[0]), signature_tree(sig, parts[1]))]
    while stack:
        a, b = stack.pop()
        if not _may_link(a, b, sig.width, percent):
            continue
        if a[5] or b[5]:
            if a is b:
                kids = a[5]
                stack += [(kids[i], kids[j]) for i in range(len(kids)) for j in range(i, len(kids))]
            elif a[5] and (not b[5] or a[2] >= b[2]):
                stack += [(k, b) for k in a[5]]
            else:
                stack += [(a, k) for k in b[5]]
            continue
        x, y = a[4], b[4]
        common = np.empty((len(x), len(y)), np.int64)
        for r, row in enumerate(x):
            common[r] = np.bitwise_count(sig.bits[row] & sig.bits[y]).sum(1, dtype=np.int64)
        common = common * np.maximum(sig.own[x][:, None], sig.own[y][None, :]) // sig.width
        sx, sy = sig.sizes[x][:, None], sig.sizes[y][None, :]
        most = np.minimum(common + np.minimum(sig.spare[x][:, None], sig.spare[y][None, :]), np.minimum(sx, sy))
        can = (100 + percent) * most >= percent * (sx + sy)
        if a is b:
            can &= np.tri(len(x), k=-1, dtype=bool)
        i, j = np.nonzero(can)
        if len(i):
            first = np.argsort(-(most[i, j] / (sx + sy)[i, j]), kind="stable")
            yield x[i[first]], y[j[first]]


def spanning(pairs, accept=None) -> list[tuple[int, int]]:
    """Accepted pairs that span the components of all accepted pairs; a pair within one is not tried."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (r := root.setdefault(x, x)) != x:
            root[x] = x = root.setdefault(r, r)
        return x

    links = []
    for ps, qs in pairs:
        for p, q in zip(ps.tolist(), qs.tolist(), strict=True):
            a, b = find(p), find(q)
            if a != b and (accept is None or accept(p, q)):
                root[max(a, b)] = min(a, b)
                links.append((p, q))
    return links


def linked(sets: list[np.ndarray], side: np.ndarray | None = None, percent: int = PERCENT) -> list[tuple[int, int]]:
    """Links that span every component of the sets with Jaccard >= percent / 100, exactly."""

    def similar(p: int, q: int) -> bool:
        s, t = (sets[p], sets[q]) if len(sets[p]) <= len(sets[q]) else (sets[q], sets[p])
        where = np.searchsorted(t, s)
        where[where == len(t)] = 0
        shared = int((t[where] == s).sum())
        return 100 * shared >= percent * (len(s) + len(t) - shared)

    if len(sets) == 2 and side is None:
        return [(0, 1)] if similar(0, 1) else []
    sig = Signatures(np.array([len(s) for s in sets], np.int64), [bitmap(s) for s in sets])
    return spanning(candidate_pairs(sig, side, percent), similar)


def _tile_links(find):
    """Worker over rows (fam, i, j, c, half, n, payload) sorted by tile pair; gives (fam, src, dst).

    ``find`` gives links that span the components of a tile pair; each member of one is linked with
    the component's smallest class.
    """

    def run(batches):
        key, held, out = None, {}, []

        def flush():
            if len(held) > 1:
                cs = list(held)
                side = None if key[1] == key[2] else np.array([held[c][0] for c in cs])
                root = list(range(len(cs)))

                def top(x):
                    while root[x] != x:
                        root[x] = x = root[root[x]]
                    return x

                for p, q in find([held[c][1] for c in cs], [held[c][2] for c in cs], side):
                    x, y = top(p), top(q)
                    root[x if cs[x] > cs[y] else y] = y if cs[x] > cs[y] else x
                out.extend((key[0], c, cs[top(k)]) for k, c in enumerate(cs) if top(k) != k)

        def pack():
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1, 2)], names=["fam", "src", "dst"])

        for batch in batches:
            fam, i, j, c, half, n = (batch.column(k).to_pylist() for k in range(6))
            payload = batch.column(6)
            for r in range(batch.num_rows):
                k = (fam[r], i[r], j[r])
                if k != key:
                    flush()
                    key, held = k, {}
                held[c[r]] = (half[r], n[r], np.frombuffer(payload[r].as_py(), np.uint64))
            if len(out) > 10_000:
                yield pack()
                out = []
        flush()
        if out:
            yield pack()

    return run


def _by_signature(sizes, bitmaps, side):
    return spanning(candidate_pairs(Signatures(np.array(sizes, np.int64), bitmaps), side))


def _by_set(_, sets, side):
    return linked(sets, side)


def _by_tile(rows: DataFrame, n: int | None = None) -> DataFrame:
    """The rows of a pair of tiles in one partition; in fewer tasks if ``n``, their number, is small."""
    dealt = rows.select("fam", "i", "j", "c", "half", "n", "payload").repartition("fam", "i", "j")
    return dealt if n is None else gathered(dealt, n, PAYLOAD_ROWS)


def _dealt(rows: DataFrame, find) -> DataFrame:
    dealt = rows.sortWithinPartitions("fam", "i", "j")
    return dealt.mapInArrow(_tile_links(find), "fam long, src long, dst long")


def _in_own_tile(members: DataFrame, per: DataFrame, salt: int) -> DataFrame:
    """(fam, i, j, c, half): the members of (fam, c), each in one tile of its group; ``per`` is (k, m).

    ``per`` is materialised: Spark can then split a large group's side of the join.
    """
    tile = F.pmod(F.xxhash64("c", F.lit(salt)), F.ceil(F.col("m") / TILE)).cast("int")
    placed = members.join(per, F.col("fam") == F.col("k")).select("fam", "c", tile.alias("i"))
    return placed.select("fam", "i", F.col("i").alias("j"), "c", F.lit(0).alias("half"))


def group_links(groups: DataFrame, rows_of, table_of, find) -> DataFrame:
    """(src, dst): links that span, with each other, all pairs of a group of (fam, c) that ``find`` accepts.

    A group of more than TILE members is dealt over tiles by a hash, so no task holds it whole. Tiles
    are first joined in themselves; then one class for each component is dealt anew, as long as that
    joins components. What is still apart after that has all pairs of its tiles compared, but two
    tiles of one component never are. So a group of near copies, however large, costs time linear in
    it, and a group that falls apart costs what its components have between them.

    ``rows_of`` adds size and payload to the rows of tiles, ``table_of`` gives them as (k, n, payload),
    materialised, for classes that are needed several times; both get the number of their rows.
    """
    per = _cut(groups.groupBy("fam").agg(F.count("*").alias("m")).where("m > 1").select(F.col("fam").alias("k"), "m"))
    above = F.when(F.col("m") > TILE, F.col("m"))
    size = per.agg(F.coalesce(F.sum("m"), F.lit(0)).alias("n"), F.coalesce(F.sum(above), F.lit(0)).alias("large")).first()
    links = _cut(_dealt(_by_tile(rows_of(_in_own_tile(groups, per, 0), size["n"]), size["n"]), find))
    if not size["large"]:
        return links.select("src", "dst")
    few = lambda df: _cut(gathered(df, size["large"]))
    large = per.where(F.col("m") > TILE).select("k")
    members = few(groups.join(large, F.col("fam") == F.col("k"), "left_semi"))
    table = table_of(members.select("c").distinct(), size["large"])
    held = lambda tiles: tiles.join(table, F.col("c") == F.col("k"))

    def joined(state: DataFrame, by: str, more: DataFrame) -> DataFrame:
        step = more.select(F.col("fam").alias("f"), "src", "dst")
        to = F.coalesce("dst", by).alias("root")
        return few(state.join(step, (F.col("fam") == F.col("f")) & (F.col(by) == F.col("src")), "left").select("fam", "c", to))

    state = joined(members, "c", links)
    before = None
    for salt in range(1, 40):
        roots = gathered(state.select("fam", F.col("root").alias("c")).distinct(), size["large"])
        apart = few(roots.groupBy("fam").agg(F.count("*").alias("m")).where("m > 1").select(F.col("fam").alias("k"), "m"))
        now = apart.agg(F.coalesce(F.sum("m"), F.lit(0)).alias("n"), F.coalesce(F.max("m"), F.lit(0)).alias("most")).first()
        if not now["n"]:
            return links.select("src", "dst")
        if before is not None and now["n"] > 0.8 * before:
            break
        before = now["n"]
        more = _cut(_dealt(_by_tile(held(_in_own_tile(roots, apart, salt)), now["n"]), find))
        links = links.unionByName(more)
        state = joined(state, "root", more)
        if now["most"] <= TILE:
            break
    # Tiles of one component, and mixed ones of the small components.
    many = state.groupBy("fam", "root").agg(F.count("*").alias("s"))
    rest = many.groupBy("fam").agg(F.count("*").alias("roots"), F.sum(F.when(F.col("s") < TILE, F.col("s")).otherwise(0)).alias("small")).where("roots > 1")
    many = few(many.join(rest, "fam").select(F.col("fam").alias("f"), F.col("root").alias("r"), "s", "small"))
    if many.isEmpty():
        return links.select("src", "dst")
    part = lambda x, n: F.pmod(F.xxhash64(x), F.greatest(F.ceil(n / TILE), F.lit(1))).cast("string")
    own = F.when(F.col("s") >= TILE, F.col("root").cast("string"))
    key = F.concat_ws("/", F.coalesce(own, F.lit("mixed")), F.when(F.col("s") >= TILE, part("c", F.col("s"))).otherwise(part("root", F.col("small"))))
    placed = few(state.join(many, (F.col("fam") == F.col("f")) & (F.col("root") == F.col("r"))).select("fam", "c", own.alias("own"), key.alias("key")))
    number = F.row_number().over(Window.partitionBy("fam").orderBy("key")).cast("int")
    tiles = few(placed.select("fam", "own", "key").distinct().select("fam", "own", "key", number.alias("no")))
    a, b = (tiles.select(F.col("fam").alias(f"f{x}"), F.col("own").alias(f"own{x}"), F.col("key").alias(f"key{x}"), F.col("no").alias(x)) for x in "ij")
    pairs = few(a.join(b, (F.col("fi") == F.col("fj")) & (F.col("i") <= F.col("j"))).where("owni is null or ownj is null or owni <> ownj"))
    left = placed.join(pairs, (F.col("fam") == F.col("fi")) & (F.col("key") == F.col("keyi"))).select("fam", "i", "j", "c", F.lit(0).alias("half"))
    right = placed.join(pairs.where("i < j"), (F.col("fam") == F.col("fj")) & (F.col("key") == F.col("keyj"))).select("fam", "i", "j", "c", F.lit(1).alias("half"))
    return links.unionByName(_dealt(_by_tile(held(left.unionByName(right))), find)).select("src", "dst")


def candidate_groups(sets: DataFrame, n: int) -> DataFrame:
    """(fam, c): classes connected by pairs that the signature trees cannot rule out."""
    held = sets.where("bits is not null").select(F.col("c").alias("k"), "n", "bits")
    once = lambda rows: rows.groupBy("k").agg(F.first("n").alias("n"), F.first("bits").alias("payload"))
    groups = cut(gathered(families(sets), 2 * n))
    release(sets.sparkSession)

    def some(classes: DataFrame, m: int) -> DataFrame:
        # Where the classes are few, no other class's bitmap is shuffled.
        return _cut(gathered(once(held.join(F.broadcast(classes) if m <= BROADCAST_DOCS else classes, F.col("k") == F.col("c"), "left_semi")), m, PAYLOAD_ROWS))

    pairs = cut(group_links(groups, lambda tiles, _: tiles.join(once(held), F.col("c") == F.col("k")), some, _by_signature))
    return connected_components(pairs).select(F.col("component").alias("fam"), F.col("node").alias("c"))


def class_links(docs: DataFrame, sets: DataFrame, seed: int, hot: np.ndarray, n: int) -> DataFrame:
    """(src, dst): exact links that span the components of the ``n`` classes."""
    groups = cut(gathered(candidate_groups(sets, n), n))
    release(docs.sparkSession)
    reps = cut(gathered(sets.where("c is not null").groupBy("c").agg(F.min("doc_id").alias("rep")).select(F.col("c").alias("kc"), "rep"), n))

    # Classes whose rows all lack an id are read through their texts, each once, named by a hash.
    nameless = named = None
    if not reps.where("rep is null").isEmpty():
        nameless = cut(docs.where("doc_id is null and text is not null").groupBy("text").count().select(F.xxhash64("text").alias("doc_id"), "text"))
        named = cut(document_sets(nameless, seed, hot).where("c is not null").groupBy("c").agg(F.min("doc_id").alias("rep")).select(F.col("c").alias("kc"), "rep"))
        named = named.join(reps.where("rep is null").select(F.col("kc").alias("k")), F.col("kc") == F.col("k"), "left_semi")

    def rows_of(tiles: DataFrame, m: int) -> DataFrame:
        found = _full_sets(docs, tiles.join(reps, F.col("c") == F.col("kc")), seed, hot, m)
        return found if nameless is None else found.unionByName(_full_sets(nameless, tiles.join(named, F.col("c") == F.col("kc")), seed, hot, m))

    def table_of(classes: DataFrame, m: int) -> DataFrame:
        places = classes.select(F.lit(0).cast("long").alias("fam"), F.lit(0).alias("i"), F.lit(0).alias("j"), "c", F.lit(0).alias("half"))
        full = _cut(rows_of(places, m).select(F.col("c").alias("k"), "n", "payload"))
        # Only rows repeated in full give a class twice; without them no set moves to find that out.
        if full.count() == full.select("k").distinct().count():
            return full
        return full.groupBy("k").agg(F.first("n").alias("n"), F.first("payload").alias("payload"))

    return group_links(groups, rows_of, table_of, _by_set)


def _full_sets(docs: DataFrame, tiles: DataFrame, seed: int, hot: np.ndarray, m: int) -> DataFrame:
    """(fam, i, j, c, half, n, payload): the sets of the classes of tiles (m rows), read from the class's document ``rep``."""
    wanted = tiles.groupBy("rep", "c").agg(F.collect_list(F.struct("fam", "i", "j", "half")).alias("places"))
    wanted = cut(gathered(wanted.where("rep is not null"), m))
    size = wanted.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size("places")), F.lit(0)).alias("places")).first()
    # An id and a place are numbers: 64 bytes a row bound what is broadcast.
    small = size["n"] + size["places"] <= BROADCAST_DOCS
    texts = docs.select("doc_id", "text").join(F.broadcast(wanted) if small else wanted, F.col("doc_id") == F.col("rep"))
    names = ["fam", "i", "j", "c", "half", "n", "payload"]
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]

    def make():
        shingles = ShingleSets(seed, hot)

        def pack(rows):
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        def each(batch: pa.RecordBatch):
            want, places = batch.column(1).to_pylist(), batch.column(2)
            rows, held = [], 0
            for r, keys in shingles.of(batch.column(0)):
                if len(keys) and class_key(keys)[0] == want[r]:
                    raw = keys.tobytes()
                    for p in places[r].as_py():
                        rows.append((p["fam"], p["i"], p["j"], want[r], p["half"], len(keys), raw))
                        held += len(raw)
                        if held > 4 << 20:
                            yield pack(rows)
                            rows, held = [], 0
            if rows:
                yield pack(rows)

        return each

    return map_batches(texts, ["text", "c", "places"], make, "fam long, i int, j int, c long, half int, n long, payload binary")


def jaccard_components(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``docs``.

    Exact for 5-word shingles and Jaccard >= 0.75: no pair is left out by a cap. A null, empty or
    blank text has an empty set and links with nothing; with fewer than five words the whole
    sequence is one shingle. Equal sets, so also repeated rows, share a component. A null doc_id is
    never a component's id unless it has no other. Shingles are compared as 63-bit hashes; two
    different sets with one class key are found by a second key, and all is hashed anew.
    """
    for seed in range(1, 6):
        hot = often_seen(docs, seed)
        sets = cut(document_sets(docs, seed, hot))
        classes = sets.where("c is not null").groupBy("c").agg(F.min("check").alias("a"), F.max("check").alias("b"))
        known = classes.agg(F.count("*").alias("n"), F.count(F.when(F.col("a") != F.col("b"), 1)).alias("clashes")).first()
        if not known["clashes"]:
            break
    else:
        raise RuntimeError("different sets share a class key under every seed")
    n = known["n"]
    comp = connected_components(cut(class_links(docs, sets, seed, hot, n)))
    classes = sets.where("c is not null").groupBy("c").agg(F.min("doc_id").alias("least"))
    named = classes.join(comp.withColumnRenamed("node", "k"), F.col("c") == F.col("k"), "left").select("c", "least", F.coalesce("component", "c").alias("root"))
    named = cut(gathered(named, n))
    roots = cut(gathered(named.groupBy("root").agg(F.min("least").alias("component_id")).select(F.col("root").alias("kr"), "component_id"), n))
    label = gathered(named.join(roots, F.col("root") == F.col("kr")).select(F.col("c").alias("kc"), "component_id"), n)
    out = sets.select("doc_id", "n", "c").join(label, F.col("c") == F.col("kc"), "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def op8_jaccard_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all ``documents`` by shingle Jaccard 0.75."""
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
