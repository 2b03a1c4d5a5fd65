"""N-gram Jaccard join: exact links between all documents of a similarity threshold, their number, and their components.

The Jaccard distance is a metric, and unrelated documents lie at distance 1 from each other. So pivots
are not drawn at large but elected where documents meet, and everything after that is a metric join.

1. Election. Shingles have one global order, frequent ones last. Two documents over the threshold share l
   of the first n - ceil(t n) + l shingles of each. Among the documents that share such a shingle the one of lowest
   priority (a hash) is its pivot, and the others join the pivot's region. Near copies share most of these shingles and
   so elect few pivots. Who shares fewer than l with all others links with nobody; everybody else may leave the pivots of
   (l - 1) / 2 shingles, the rarest elected first. Two linked documents still have a pivot in common, and meet in its region.
2. Regions. A region of more than REGION documents (or CAPACITY shingles) is divided by distributed joins: some
   members are its pivots, exact distances to all of them put each member into the Voronoi region of the nearest, and
   the window d(x, p) <= d(x, home) + 2 r copies boundary members to the regions before their home. Regions are divided
   again until they are small; one that no longer shrinks (all members lie within 2 r of each other) is compared in
   blocks. A region of one task is divided in the same way in memory, and pivot distances prune its last pairs.
3. Screen. Before any set is moved, the members of a small region are compared by counters of their hashes, whose difference
   is never more than that of the sets; who has no partner left, by size or by counters, leaves the region.
4. Links. A pair is counted once: in the lowest common pivot's region, where at least one of the two is at home on every
   level. A region returns each member's number of links and a spanning forest, never the pairs.

Exact copies are one class from the start. What reaches the driver is counts and the list of frequent
shingles, whose number is bounded.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import arrow_map, durable, flagged, only, texts, tidy, without
from .words import mix, words

#: Documents that must have a shingle for it to be ordered last; such shingles, at most (the count is doubled until they are so few).
OFTEN, FREQUENT = 32, 1 << 20
#: Documents from which a shingle's pivot is elected by partial aggregation; such shingles, at most (as above).
CROWD, CROWDS = 2048, 1 << 16
#: Two linked sets share one more shingle of their prefixes for every so many that the smaller has.
SHARED = 24
#: Documents, and shingles, of a region that one task joins; documents whose pairs are compared without pivots.
REGION, CAPACITY, SMALL = 2048, 1 << 22, 32
#: Pivots of a region, on the cluster and in a task.
SPLIT, PIVOTS = 12, 6
#: Of a region's documents, the share that its largest part may have for it to be divided further.
SHRINK = 0.8
MIX = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(parts: list[bytes], n: int) -> list[np.ndarray]:
    """Sorted distinct hashes of the runs of n words; of fewer words, the whole sequence; none without words."""
    cut = words(parts, lower=True)
    h = cut.hash
    lo, hi = np.searchsorted(cut.doc, np.arange(len(parts))), np.searchsorted(cut.doc, np.arange(1, len(parts) + 1))
    run = np.full(max(0, len(h) - n + 1), np.uint64(n))
    for k in range(n):
        run = mix(run * MIX + h[k : k + len(run)])
    out = []
    for a, b in zip(lo.tolist(), hi.tolist()):
        if b - a >= n:
            out.append(np.unique(run[a : b - n + 1]))
        elif b > a:
            one = np.uint64(b - a)
            for k in range(a, b):
                one = mix(np.array([one], np.uint64) * MIX + h[k])[0]
            out.append(np.array([one], np.uint64))
        else:
            out.append(h[:0])
    return out


def sets_of_batch(batch: pa.RecordBatch, n: int) -> list[np.ndarray]:
    return shingle_sets([x.encode() for x in batch.column("text").to_pylist()], n)


def prefix_size(n: int, t: int) -> int:
    """Shingles of a set of n of which a set with similarity t per cent or more holds at least one."""
    return n - -(-t * n // 100) + 1 if n else 0


def shared_size(n: int) -> int:
    """l: shingles that the prefixes of two linked sets share, by the size of the smaller."""
    return 1 + n // SHARED


def long_prefix(n: int, t: int) -> int:
    return prefix_size(n, t) + shared_size(n) - 1


def short(hashes: np.ndarray) -> np.ndarray:
    """The low half of each hash: enough for an order, which only has to be the same for all."""
    return (hashes & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def sign_of(s: np.ndarray) -> bytes:
    """Equal for equal sets; of different ones, equal with a probability below 2**-128."""
    return np.array([mix(s).sum() if len(s) else 0, mix(s ^ MIX).sum() if len(s) else 0, len(s)], np.uint64).tobytes()


def shingle_counts(docs: DataFrame, n: int, t: int) -> DataFrame:
    """(h, c): short hashes and how many documents have them among the lowest, a quarter more than the prefix holds, over OFTEN."""

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            low = [s[: 5 * long_prefix(len(s), t) // 4] for s in sets_of_batch(batch, n)]
            return pa.RecordBatch.from_arrays([pa.array(short(np.concatenate(low)).view(np.int32))], ["h"])

        return step

    return durable(arrow_map(docs.select("text"), make, "h int").groupBy("h").agg(F.count("*").alias("c")).filter(F.col("c") > OFTEN))


def at_most(counts: DataFrame, least: int, rows: int) -> DataFrame:
    """The shingles of more than ``least`` documents, or of so many more that no more than ``rows`` are left."""
    while counts.filter(F.col("c") > least).count() > rows:
        least *= 2
    return counts.filter(F.col("c") > least)


def width(n: int) -> int:
    """Counters of a set of n: 64, or the power of two from half to all of n."""
    return max(64, 1 << (n // 2 - 1).bit_length()) if n > 2 else 64


def counters(s: np.ndarray) -> bytes:
    wide = width(len(s))
    return np.minimum(np.bincount((s >> np.uint64(5)).astype(np.int64) & (wide - 1), minlength=wide), 255).astype(np.uint8).tobytes()


FEATURES = "doc_id long, n long, sign binary, prefix array<long>, counters binary"


def features(docs: DataFrame, n: int, t: int, frequent: np.ndarray) -> DataFrame:
    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            sets = sets_of_batch(batch, n)
            prefixes = []
            for s in sets:
                if len(frequent):
                    late = frequent[np.minimum(np.searchsorted(frequent, short(s)), len(frequent) - 1)] == short(s)
                    s = np.concatenate([s[~late], s[late]])
                prefixes.append(s[: long_prefix(len(s), t)].view(np.int64))
            ends = np.concatenate([[0], np.cumsum([len(p) for p in prefixes])]).astype(np.int32)
            return pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array([sign_of(s) for s in sets], pa.binary()), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(prefixes))), pa.array(list(map(counters, sets)), pa.binary())],
                ["doc_id", "n", "sign", "prefix", "counters"],
            )

        return step

    return arrow_map(docs, make, FEATURES)


def elected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (h, x) sorted by h and priority -> (x, c, k): each h's first x is the pivot of all its x, itself included, and k counts such h; an x alone elects none."""
    h_before, pivot, told = None, 0, True
    for batch in batches:
        if not batch.num_rows:
            continue
        h, x = (batch.column(c).to_numpy() for c in ("h", "x"))
        first = np.concatenate([[h[0] != h_before], h[1:] != h[:-1]])
        c = x[np.maximum.accumulate(np.where(first, np.arange(len(h)), 0))]
        run = np.cumsum(first)
        c[run == 0] = pivot  # the run goes on from the batch before
        rest = ~first
        own = c[rest][np.unique(run[rest], return_index=True)[1]]
        rows, k = np.unique(np.stack([np.concatenate([x[rest], own]), np.concatenate([c[rest], own])], 1), axis=0, return_counts=True)
        h_before, pivot = h[-1], c[-1]
        if len(rows):
            yield pa.RecordBatch.from_arrays([pa.array(rows[:, 0]), pa.array(rows[:, 1]), pa.array(k)], ["x", "c", "k"])


def runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[dict[str, np.ndarray]]:
    """Columns of one or more whole runs of equal keys at a time, from rows sorted by key."""
    held: list[dict[str, np.ndarray]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        now = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in batch.schema.names}
        k = now[key]
        last = int(np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))[-1])
        if last == 0 and held and held[-1][key][-1] == k[0]:
            held.append(now)
            continue
        if last:
            held.append({c: v[:last] for c, v in now.items()})
        if held:
            yield joined(held)
        held = [{c: v[last:] for c, v in now.items()}]
    if held:
        yield joined(held)


def joined(parts: list[dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
    return parts[0] if len(parts) == 1 else {c: np.concatenate([p[c] for p in parts]) for c in parts[0]}


def screened(t: int) -> Callable:
    """Rows (region, x, n, counters) sorted by region and n -> (region, x) of those that sizes and counters leave a partner."""
    schema = pa.schema([("region", pa.int64()), ("x", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in runs(batches, "region"):
            key, n = rows["region"], rows["n"]
            start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            stays = np.zeros(len(key), bool)
            for lo, hi in zip(start.tolist(), [*start[1:].tolist(), len(key)]):
                counts = [np.frombuffer(c, np.uint8).astype(np.int32) for c in rows["counters"][lo:hi]]
                own = n[lo:hi]
                last = np.searchsorted(own, own * 100 // t, "right").tolist()  # behind the largest partner
                for i in range(hi - lo - 1):
                    wide, j = len(counts[i]), i + 1
                    if last[i] <= j:
                        continue
                    if any(len(counts[k]) != wide for k in range(j, last[i])):  # sizes ascend, and so do widths, by factors of two
                        others = np.stack([c.reshape(-1, wide).sum(0) for c in counts[j : last[i]]])
                    else:
                        others = np.stack(counts[j : last[i]])
                    both = own[i] + own[j : last[i]]
                    hit = np.abs(others - counts[i]).sum(1) <= both - 2 * -(-t * both // (100 + t))
                    if hit.any():
                        stays[lo + i] = True
                        stays[lo + j + np.flatnonzero(hit)] = True
            if stays.any():
                yield pa.RecordBatch.from_arrays([pa.array(key[stays]), pa.array(rows["x"][stays])], schema=schema)

    return run


def linked(common: np.ndarray, a: np.ndarray | int, b: np.ndarray | int, t: int) -> np.ndarray:
    return 100 * common >= t * (a + b - common)


class Lists:
    """Lists of numbers, and how many of list x's are in each of some others."""

    def __init__(self, lists: list[np.ndarray]):
        self.size = np.array([len(s) for s in lists], np.int64)
        _, self.flat = np.unique(np.concatenate(lists), return_inverse=True)
        self.end = np.cumsum(self.size)
        self.mark = np.zeros(int(self.flat.max()) + 1 if len(self.flat) else 1, bool)

    def common(self, x: int, others: np.ndarray) -> np.ndarray:
        own = self.flat[self.end[x] - self.size[x] : self.end[x]]
        self.mark[own] = True
        size = self.size[others]
        ends = np.cumsum(size)
        shift = np.repeat(self.end[others] - ends, size)
        hits = np.concatenate([[0], np.cumsum(self.mark[self.flat[np.arange(len(shift)) + shift]])])
        self.mark[own] = False
        return hits[ends] - hits[ends - size]


class Region:
    """Members of a region. ``join`` counts every member's links, by weight, and lists a spanning forest of them.

    below: each member's pivots before this region's, for pairs that such a region has. home: bits of the levels on which
    the member is at home; whole: all of them. side: 0, or which of two blocks, and then only pairs across count."""

    def __init__(self, sets: list[np.ndarray], t: int, below: list[np.ndarray] | None = None, weight: np.ndarray | None = None, home: np.ndarray | None = None, whole: int = 0, side: np.ndarray | None = None):
        n = len(sets)
        self.t, self.radius, self.sets = t, 1 - t / 100, Lists(sets)
        self.below = Lists(below) if below is not None and sum(map(len, below)) else None
        self.weight = np.ones(n, np.int64) if weight is None else weight
        self.home = np.zeros(n, np.int64) if home is None else home
        self.whole, self.side = whole, side
        self.root, self.links, self.degree = np.arange(n), [], np.zeros(n, np.int64)

    def distance(self, x: int, others: np.ndarray) -> np.ndarray:
        common, size = self.sets.common(x, others), self.sets.size
        return 1 - common / (size[x] + size[others] - common)

    def find(self, x: int) -> int:
        while self.root[x] != x:
            self.root[x] = x = self.root[self.root[x]]
        return x

    def test(self, x: int, others: np.ndarray, local: tuple[np.ndarray, int] | None = None, mine: int = 0) -> None:
        """Count x's links with those of the others that this region and, with local, this part of it own."""
        ok = (self.home[others] | self.home[x]) == self.whole
        if local is not None:
            ok &= (local[0] | mine) == local[1]
        if self.side is not None:
            ok &= (self.side[others] != self.side[x]) | (self.side[x] == 0)
        size = self.sets.size
        ok &= 100 * np.minimum(size[x], size[others]) >= self.t * np.maximum(size[x], size[others])
        others = others[ok]
        if not len(others):
            return
        hit = others[linked(self.sets.common(x, others), size[x], size[others], self.t)]
        if len(hit) and self.below is not None:
            hit = hit[self.below.common(x, hit) == 0]
        self.degree[x] += self.weight[hit].sum()
        self.degree[hit] += self.weight[x]
        for y in hit.tolist():
            if (a := self.find(x)) != (b := self.find(y)):
                self.root[b] = a
                self.links.append((x, y))

    def join(self) -> Region:
        """Pairs by pivots and windows, part by part. A part: members, each one's home bits, all bits."""
        n = len(self.root)
        work = [(np.arange(n), np.zeros(n, np.int64), 0)]
        slack = 1e-9
        while work:
            now, bits, whole = work.pop()
            if len(now) <= SMALL:
                for k, x in enumerate(now[:-1].tolist()):
                    self.test(x, now[k + 1 :], (bits[k + 1 :], whole), bits[k])
                continue
            # pivots far from each other, with exact distances to all
            found, far = [], None
            x = int(now[np.argsort(self.sets.size[now], kind="stable")[len(now) // 2]])
            for _ in range(PIVOTS):
                d = self.distance(x, now)
                found.append(d)
                far = d if far is None else np.minimum(far, d)
                if far.max() <= self.radius:
                    break
                x = int(now[far.argmax()])
            d = np.stack(found)
            home, best = d.argmin(0), d.min(0)
            parts = [(home == k) | ((home > k) & (d[k] <= best + 2 * self.radius + slack)) for k in range(len(d))]
            sizes = [int(p.sum()) for p in parts]
            if len(d) > 1 and sum(sizes) < 1.5 * len(now) and max(sizes) <= SHRINK * len(now) and whole < 1 << 60:
                work += [(now[p], bits[p] << 1 | (home[p] == k), whole << 1 | 1) for k, p in enumerate(parts)]
                continue
            # the parts overlap too much: the pivots' distances prune pair by pair
            order = np.lexsort((best, home))
            now, bits, d = now[order], bits[order], d[:, order]
            for k in range(len(now) - 1):
                rest = k + 1 + np.flatnonzero((np.abs(d[:, k + 1 :] - d[:, [k]]) <= self.radius + slack).all(0))
                self.test(int(now[k]), now[rest], (bits[rest], whole), bits[k])
        return self


LINKS = "a long, b long, n long"


def region_links(t: int) -> Callable:
    """Rows (region, x, below, weight, home, whole, side, kept) sorted by region and x -> rows (a, b, null) of a spanning forest and (a, null, n) of link counts."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in runs(batches, "region"):
            key = rows["region"]
            start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            ends, froms, counts = [], [], []
            for lo, hi in zip(start.tolist(), [*start[1:].tolist(), len(key)]):
                x = rows["x"][lo:hi]
                at = lo + np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))  # repeated rows are one member
                x = rows["x"][at]
                sets = [np.frombuffer(s, np.uint64) for s in rows["kept"][at]]
                if len(at) < 2:
                    continue
                below = [np.asarray(v, np.int64) for v in rows["below"][at]]
                region = Region(sets, t, below, rows["weight"][at], rows["home"][at], int(rows["whole"][lo]), rows["side"][at]).join()
                if region.links:
                    pairs = np.array(region.links)
                    ends.append(x[pairs[:, 0]])
                    froms.append(x[pairs[:, 1]])
                    some = np.flatnonzero(region.degree)
                    counts.append((x[some], region.degree[some]))
            if ends:
                a, b = np.concatenate(ends), np.concatenate(froms)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.nulls(len(a), pa.int64())], schema=schema)
                a, n = (np.concatenate([c[k] for c in counts]) for k in (0, 1))
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.nulls(len(a), pa.int64()), pa.array(n)], schema=schema)

    return run


def voronoi(t: int) -> Callable:
    """Rows (region, block, role, x, kept) sorted by all but kept, a block's pivots (role 0) first -> (region, x, pivot, at_home): each member's home, and the regions before it whose window holds it."""
    radius, slack = 1 - t / 100, 1e-9

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, pivots, names, open_ = None, [], [], None
        for batch in batches:
            out: list[tuple[int, int, int, bool]] = []
            for region, block, role, x, kept in zip(*(batch.column(c).to_pylist() for c in ("region", "block", "role", "x", "kept"))):
                if (region, block) != place:
                    place, pivots, names = (region, block), [], []
                s = np.frombuffer(kept, np.uint64)
                if role == 0:
                    if not names or names[-1] != x:
                        pivots.append(s)
                        names.append(x)
                    open_ = None
                    continue
                if open_ is None:
                    open_ = Lists(pivots)
                    values = np.unique(np.concatenate(pivots))
                at = np.minimum(np.searchsorted(values, s), len(values) - 1)
                hit = np.zeros(len(values) + 1, np.int64)
                hit[at[values[at] == s]] = 1
                sums = np.concatenate([[0], np.cumsum(hit[open_.flat])])
                common = sums[open_.end] - sums[open_.end - open_.size]
                d = 1 - common / (len(s) + open_.size - common)
                home = int(d.argmin())
                out.append((region, x, names[home], True))
                out += [(region, x, names[k], False) for k in range(home) if d[k] <= d[home] + 2 * radius + slack]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.bool_()))], ["region", "x", "pivot", "at_home"])

    return run


def sets_of(docs: DataFrame, n: int) -> DataFrame:
    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            sets = sets_of_batch(batch, n)
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([sign_of(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], ["doc_id", "sign", "kept"])

        return step

    return arrow_map(docs, make, "doc_id long, sign binary, kept binary")


def components(links: DataFrame) -> DataFrame:
    """(id, root) of every end of a link: the smallest id reachable. Large stars and small stars in turn, until nothing changes."""
    links = links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    links, state = durable(links), None
    while True:
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        links = durable(large.join(least, "a").select(F.explode(F.when(F.col("b") == F.col("m"), F.array(F.struct("a", F.col("m").alias("b")))).otherwise(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b"))))).alias("e")).select("e.*").distinct())
        now = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    roots = links.select(F.col("a").alias("id"), F.col("b").alias("root"))
    return roots.union(links.select("b", "b").distinct())


def memberships(firsts: DataFrame, crowds: DataFrame, t: int) -> DataFrame:
    """(x, n, weight, c, below): the pivots that a document's prefix elects and that it stays with, and for each those before it."""
    parts = int(firsts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cells = firsts.select(F.col("id").alias("x"), F.explode("prefix").alias("h"))
    priority = F.struct(F.xxhash64("x").alias("p"), F.col("x"))
    pivots = None
    if crowds.limit(1).count():
        # crowded shingles: their pivots by partial aggregation, no row of theirs is dealt by shingle
        low = F.shiftright(F.shiftleft("h", 32), 32).cast("int")
        met = cells.withColumn("s", low).join(F.broadcast(crowds.select(F.col("h").alias("s"))), "s", "left_semi")
        pivots = durable(met.groupBy("h").agg(F.min(priority)["x"].alias("c"), F.count("*").alias("m")).filter(F.col("m") > CROWD).select("h", "c"))
        if pivots.count() > 4 * CROWDS:
            pivots = None
    rest = cells if pivots is None else cells.join(F.broadcast(pivots), "h", "left_anti")
    pairs = rest.select("h", "x").repartition(parts, "h").withColumn("p", F.xxhash64("x")).sortWithinPartitions("h", "p", "x").select("h", "x").mapInArrow(tidy(elected), "x long, c long, k long")
    if pivots is not None:
        pairs = pairs.union(cells.join(F.broadcast(pivots), "h").select("x", "c", F.lit(1).cast("long")))
    pairs = pairs.groupBy("x", "c").agg(F.sum("k").alias("k"))
    own = pairs.groupBy("x").agg(F.array_sort(F.collect_list(F.struct("k", "c"))).alias("cs"), F.sum("k").alias("k"))  # one for each shingle of the prefix at most
    own = own.join(firsts.select(F.col("id").alias("x"), "n", F.col("copies").alias("weight")), "x")
    least = 1 + F.floor(F.ceil(F.col("n") * t / 100) / SHARED)  # shared_size of the smallest partner
    own = own.withColumn("least", least).filter("k >= least")
    none = F.struct(F.lit(0).cast("long").alias("k"), F.array().cast("array<long>").alias("cs"))
    leave = lambda so, v: F.struct((so["k"] + v["k"]).alias("k"), F.when(2 * (so["k"] + v["k"]) < F.col("least"), so["cs"]).otherwise(F.concat(so["cs"], F.array(v["c"]))).alias("cs"))
    own = own.select("x", "n", "weight", F.aggregate("cs", none, leave)["cs"].alias("cs"))
    return own.select("x", "n", "weight", F.explode("cs").alias("c"), "cs").select("x", "n", "weight", "c", F.filter("cs", lambda p: p < F.col("c")).alias("below"))


MEMBER = ["region", "x", "n", "below", "weight", "home", "whole", "side"]


def outgrown() -> Column:
    return (F.col("m") > REGION) | ((F.col("m") > SMALL) & (F.col("shingles") > CAPACITY))


def sizes_of(members: DataFrame, key: str) -> DataFrame:
    return members.groupBy(key).agg(F.count("*").alias("m"), F.sum("n").alias("shingles"))


def divided(big: DataFrame, kept: DataFrame, t: int) -> DataFrame:
    """Members (MEMBER) of regions that outgrow a task -> the members of regions that a task can join."""
    parts = int(big.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    done, level = [], 0
    while big.limit(1).count():
        blocks = F.greatest(F.ceil(F.col("m") / REGION), F.ceil(F.col("shingles") / CAPACITY)).cast("int")
        sized = durable(big.join(sizes_of(big, "region"), "region").withColumn("blocks", blocks))
        chance = F.pmod(F.xxhash64("region", "x", F.lit(level)), F.col("m"))
        pivots = sized.filter(chance < SPLIT).select("region", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(0).alias("role"), "x")
        members = sized.select("region", F.pmod(F.xxhash64("x"), F.col("blocks")).cast("int").alias("block"), F.lit(1).alias("role"), "x")
        # a region for which no pivot was drawn stays whole, and goes on as it is
        members = members.join(pivots.select("region").distinct(), "region", "left_semi")
        dealt = pivots.union(members).join(kept, "x").select("region", "block", "role", "x", "kept")
        homes = durable(dealt.repartition(parts, "region", "block").sortWithinPartitions("region", "block", "role", "x").mapInArrow(tidy(voronoi(t)), "region long, x long, pivot long, at_home boolean").distinct())
        shares = homes.groupBy("region", "pivot").agg(F.count("*").alias("k")).groupBy("region").agg(F.max("k").alias("largest"), F.sum("k").alias("all"))
        sized = sized.join(shares, "region", "left")
        shrinks = (F.col("largest") <= SHRINK * F.col("m")) & (F.col("all") < 3 * F.col("m"))
        parted = sized.filter(shrinks).join(homes, ["region", "x"])
        parted = parted.select(F.xxhash64("region", "pivot").alias("region"), "x", "n", "below", "weight", (F.col("home") * 2 + F.col("at_home").cast("long")).alias("home"), (F.col("whole") * 2 + 1).alias("whole"), "side")
        # dense: every pair of blocks is a region
        own = F.pmod(F.xxhash64("x"), F.col("blocks")).cast("int")
        dense = sized.filter(~F.coalesce(shrinks, F.lit(False))).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        side = F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2)
        done.append(durable(dense.select(F.xxhash64("region", F.least("own", "other"), F.greatest("own", "other")).alias("region"), "x", "n", "below", "weight", "home", "whole", side.alias("side"))))
        parted = durable(parted)
        large = durable(sizes_of(parted, "region").filter(outgrown()).select("region"))
        done.append(parted.join(large, "region", "left_anti"))
        big = parted.join(large, "region", "left_semi")
        level += 1
    out = done[0].select(*MEMBER)
    for more in done[1:]:
        out = out.union(more.select(*MEMBER))
    return out


def jaccard_join(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links) of every row.

    A document's set: the distinct runs of n words of its text, A-Z in lower case; of fewer words, the whole
    sequence as one. Two documents link when 100 * intersection >= percent * union. component_id is the smallest
    doc_id reachable over links. n_links: how many other documents the text links with, copies included.
    Documents without words (null, empty) link with nothing, not even with each other. Texts of any length are taken whole.
    Repeated rows are one document; rows of one doc_id and different texts are each linked for
    themselves and then united. Other columns are ignored, so their names cannot clash. Rows with a null doc_id are kept and
    stand for themselves (component null, no links). An empty table gives an empty result."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = texts(docs, id_col, text_col)
    counts = shingle_counts(docs, n, percent)
    frequent = np.sort(at_most(counts, OFTEN, FREQUENT).select("h").toPandas()["h"].to_numpy(np.int32).view(np.uint32))
    crowds = at_most(counts, CROWD, CROWDS)
    rows = durable(features(docs, n, percent, frequent))
    named = rows.filter("n > 0 and doc_id is not null").groupBy("sign", "doc_id").agg(F.count("*").alias("rows"))
    named = durable(named)
    # a class is named by its first document; those of a document with several texts, by a hash with the set's signature
    many = durable(named.groupBy("doc_id").agg(F.count("*").alias("texts")).filter("texts > 1"))
    classes = named.groupBy("sign").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"))
    classes = classes.join(many.select(F.col("doc_id").alias("rep"), "texts"), "rep", "left")
    classes = durable(classes.select("sign", "rep", "copies", F.when(F.col("texts").isNull(), F.col("rep")).otherwise(F.xxhash64("rep", "sign")).alias("id")))
    # what is no first, or is several rows of one doc_id, is looked up, the rest passes
    others = durable(named.join(classes, "sign").filter("doc_id <> rep or copies > 1 or rows > 1 or id <> rep").select("doc_id").distinct())
    some = rows.filter("n > 0 and doc_id is not null")
    plain = without(some, others).select(F.col("doc_id").alias("id"), "n", "prefix", "counters", F.lit(1).cast("long").alias("copies"))
    several = only(some, others).join(classes.select("sign", F.col("rep").alias("doc_id"), "id", "copies"), ["sign", "doc_id"])
    several = several.groupBy("id").agg(F.first("n").alias("n"), F.first("prefix").alias("prefix"), F.first("counters").alias("counters"), F.first("copies").alias("copies"))
    firsts = durable(plain.unionByName(several))

    members = memberships(firsts, crowds, percent)
    by_size = W.partitionBy("c").orderBy("n")
    near = F.coalesce(100 * F.lag("n").over(by_size) >= percent * F.col("n"), F.lit(False)) | F.coalesce(100 * F.col("n") >= percent * F.lead("n").over(by_size), F.lit(False))
    members = durable(members.withColumn("near", near).filter("near").drop("near"))
    sizes = durable(sizes_of(members, "c").select("c", outgrown().alias("big")))
    members = members.join(sizes, "c")
    zero = F.lit(0).cast("long")
    members = members.select(F.col("c").alias("region"), "x", "n", "below", "weight", zero.alias("home"), zero.alias("whole"), F.lit(0).alias("side"), "big")
    crowded = members.filter("big").select(*MEMBER)
    members = members.filter("not big").select(*MEMBER)
    profiles = firsts.select(F.col("id").alias("x"), "counters")
    stay = members.select("region", "x", "n").join(profiles, "x").select("region", "x", "n", "counters").repartition(parts, "region").sortWithinPartitions("region", "n", "x")
    members = members.join(durable(stay.mapInArrow(tidy(screened(percent)), "region long, x long")), ["region", "x"]).select(*MEMBER)

    some_many = many.limit(1).count() > 0
    members, crowded = durable(members), durable(crowded)
    wanted = members.select(F.col("x").alias("doc_id")).union(crowded.select("x"))
    wanted = wanted.union(many.select("doc_id")) if some_many else wanted
    kept = durable(sets_of(flagged(docs, wanted, "doc_id").filter("maybe"), n))
    if some_many:
        told = flagged(kept, many.select("doc_id"), "doc_id")
        plain = told.filter("not maybe").select(F.col("doc_id").alias("x"), "kept")
        kept = plain.union(told.filter("maybe").join(classes.select("sign", F.col("rep").alias("doc_id"), "id"), ["sign", "doc_id"]).select("id", "kept"))
    else:
        kept = kept.select(F.col("doc_id").alias("x"), "kept")

    if crowded.limit(1).count():
        members = members.union(divided(crowded, kept, percent))
    dealt = members.join(kept, "x").select(*MEMBER, "kept").repartition(parts, "region").sortWithinPartitions("region", "x")
    found = durable(dealt.mapInArrow(tidy(region_links(percent)), LINKS))

    degree = found.filter("b is null").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("links"))
    links = found.filter("b is not null").select("a", "b")
    if some_many:
        texts_of = named.join(many.select("doc_id"), "doc_id", "left_semi").join(classes.select("sign", "id"), "sign")
        links = links.union(texts_of.join(texts_of.groupBy("doc_id").agg(F.min("id").alias("b")), "doc_id").select("id", "b"))
    roots = components(links)
    if some_many:  # an id may be a hash: a component's name is its smallest document
        least = classes.select("id", "rep").join(roots, "id").groupBy("root").agg(F.min("rep").alias("least"))
        roots = roots.join(least, "root").select("id", F.col("least").alias("root"))
    of_class = classes.join(roots.filter("id <> root"), "id", "left").join(degree, "id", "left")
    of_class = of_class.select("sign", F.coalesce("root", "rep").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"))
    out = rows.select("doc_id", F.col("n").alias("n_shingles"), F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("sign")).alias("sign")).join(of_class, "sign", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"))


def first_of_each(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """The documents (all columns) whose doc_id is their component's smallest. Of several rows of that doc_id, the one
    with the smallest text stays (a null first), among equal texts the one whose other columns have the smallest hash."""
    found = jaccard_join(docs, n, percent).groupBy("doc_id").agg(F.min("component_id").alias("component_id"), F.count("*").alias("n"))
    found = durable(found.filter("component_id <> doc_id or n > 1"))
    drop, repeated = (found.filter(f).select("doc_id") for f in ("component_id <> doc_id", "component_id = doc_id and n > 1"))
    once = without(docs, drop.union(repeated))
    again = only(docs, repeated).groupBy("doc_id").agg(F.min_by(F.struct(*docs.columns), F.struct("text", F.xxhash64(*docs.columns))).alias("row"))
    return once.unionByName(again.select("row.*"))


def oracle(n: int = 4, percent: int = 85) -> str:
    """All pairs that share a shingle, and a recursive walk, in DuckDB."""
    run = " || ' ' || ".join(f"w[i + {k}]" for k in range(n))
    return f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, {run} AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) - {n - 2})) AS i FROM d WHERE len(w) >= {n})
  UNION ALL SELECT doc_id, len(w) || ':' || array_to_string(w, ' ') FROM d WHERE len(w) BETWEEN 1 AND {n - 1}),
c AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m FROM s a JOIN s b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN c ca ON ca.doc_id = a JOIN c cb ON cb.doc_id = b WHERE 100 * m >= {percent} * (ca.n + cb.n - m)),
r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT d.doc_id, coalesce(c.n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce((SELECT min(b) FROM r WHERE r.a = d.doc_id), d.doc_id)) AS component_id,
  (SELECT count(*) FROM e WHERE e.a = d.doc_id)::BIGINT AS n_links
FROM d LEFT JOIN c USING (doc_id)"""
