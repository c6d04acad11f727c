"""Embedding near-duplicates: exact threshold pairs by dual traversal of cover trees.

Each vector goes to the block of its nearest top-level centre. A block gets a
cover tree: nested levels whose radii halve, each node a centre, its members and their
true covering radius. A pair of blocks is searched by walking both trees
together: a pair of nodes goes no further if even its closest members are too far
apart, and is taken whole if even its farthest members link. On the unit sphere
cosine c is distance sqrt(2 - 2c).
"""

from __future__ import annotations

import io
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .graph import connected_components

#: Radii of the levels below the root, which covers all. In many dimensions unrelated vectors lie
#: more than 1 apart, so that a level of radius 1 would hold little but single vectors.
RADII = tuple(0.5 / 2**k for k in range(5))
#: Pruning runs in single precision; this covers its errors. Pairs are verified in double precision.
SLACK = 1e-3
#: Distances computed at once.
CHUNK = 1 << 20


def _scaled(raw: np.ndarray) -> np.ndarray:
    """Each vector times a power of two, which keeps its cosines, so that squares neither overflow nor vanish."""
    return np.ldexp(raw, -np.frexp(np.abs(raw).max(1))[1][:, None])


def _unit(raw: np.ndarray) -> np.ndarray:
    held = _scaled(raw).astype(np.float64)
    return held / np.sqrt((held * held).sum(1))[:, None]


class CoverTree:
    """Nodes in breadth-first order; a node's members are ``order[low:high]``, its children ``kids[k]:kids[k] + n_kids[k]``."""

    FIELDS = ("ids", "raw", "weight", "centre", "low", "high", "radius", "kids", "n_kids")

    def __init__(self, **arrays: np.ndarray) -> None:
        self.__dict__.update(arrays)
        self.norm = np.sqrt((self.raw.astype(np.float64) ** 2).sum(1))
        self.unit = (self.raw / self.norm[:, None]).astype(np.float32)
        self.sums = np.concatenate([[0], np.cumsum(self.weight)])

    @classmethod
    def build(cls, ids: np.ndarray, raw: np.ndarray, weight: np.ndarray) -> CoverTree:
        unit = (raw / np.sqrt((raw.astype(np.float64) ** 2).sum(1))[:, None]).astype(np.float32)

        def far(some: np.ndarray, members: np.ndarray) -> np.ndarray:
            return np.sqrt(np.maximum(0, 2 - 2 * (unit[some] @ unit[members].T)))

        order = np.arange(len(ids))
        first = far(order[:1], order)
        nodes = [[0, 0, len(ids), float(first.max()), 0, 0]]  # centre, low, high, radius, kids, n_kids
        level = [0]
        for limit in RADII:
            following = []
            for k in level:
                centre, low, high, radius, _, _ = nodes[k]
                if high - low == 1 or radius == 0:
                    continue
                if radius <= limit:  # the centre covers its members on this level too
                    following.append(k)
                    continue
                rest, at = order[low:high].copy(), low
                mine = int(np.flatnonzero(rest == centre)[0])
                rest[[0, mine]] = rest[[mine, 0]]
                nodes[k][4] = len(nodes)
                while len(rest):
                    ahead = far(rest[:64], rest)
                    covered = np.zeros(len(rest), bool)
                    for r, d in enumerate(ahead):
                        if covered[r]:
                            continue
                        near = (d <= limit) & ~covered
                        near[r] = True
                        covered |= near
                        members = rest[near]
                        order[at : at + len(members)] = members
                        nodes.append([int(rest[r]), at, at + len(members), float(d[near].max()), 0, 0])
                        following.append(len(nodes) - 1)
                        at += len(members)
                    rest = rest[~covered]
                nodes[k][5] = len(nodes) - nodes[k][4]
            level = following
        centre, low, high, radius, kids, n_kids = (np.array(c) for c in zip(*nodes, strict=True))
        place = np.empty(len(ids), np.int64)
        place[order] = np.arange(len(ids))
        single = high - low == 1
        return cls(ids=ids[order], raw=raw[order], weight=weight[order], centre=place[centre], low=low, high=high, radius=np.where(single, 0, radius).astype(np.float32), kids=kids, n_kids=n_kids)

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, **{f: getattr(self, f) for f in self.FIELDS})
        return out.getvalue()

    @classmethod
    def load(cls, data: bytes) -> CoverTree:
        with np.load(io.BytesIO(data)) as held:
            return cls(**{f: held[f] for f in cls.FIELDS})


def _spans(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The ranges start..start + count, one after another."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + counts, counts)


def _products(a: np.ndarray, na: np.ndarray, b: np.ndarray, nb: np.ndarray):
    """For each k the pairs of a[k]..a[k]+na[k] and b[k]..b[k]+nb[k], in pieces of bounded size."""
    sizes = na * nb
    at = 0
    while at < len(a):
        stop = at + max(1, int(np.searchsorted(np.cumsum(sizes[at:]), CHUNK, side="right")))
        x, nx, y, ny = a[at:stop], na[at:stop], b[at:stop], nb[at:stop]
        left = _spans(x, nx)
        per = np.repeat(ny, nx)
        yield np.repeat(left, per), _spans(np.repeat(y, nx), per)
        at = stop


class Links:
    """What a search found: weight linked to each member, and unions."""

    def __init__(self, n: int) -> None:
        self.steps, self.extra, self.unions = np.zeros(n + 1), np.zeros(n), []

    def total(self) -> np.ndarray:
        return self.extra + np.cumsum(self.steps)[:-1]


def dual_search(a: CoverTree, b: CoverTree, cosine: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(linked weight of a's members, of b's, unions as rows of places; b's places follow a's).

    With ``a is b`` each unordered pair is met once, and both arrays are the same.
    """
    same = a is b
    limit, base = math.sqrt(max(0.0, 2 - 2 * cosine)), 0 if same else len(a.ids)
    in_a = Links(len(a.ids))
    in_b = in_a if same else Links(len(b.ids))
    unions = in_a.unions

    def take_whole(x: int, y: int) -> None:
        in_a.steps[[a.low[x], a.high[x]]] += np.array([1, -1]) * (b.sums[b.high[y]] - b.sums[b.low[y]])
        left = np.arange(a.low[x], a.high[x])
        if same and x == y:
            in_a.extra[left] -= a.weight[left]
            unions.append(np.stack([left, np.full(len(left), left[0])], 1))
            return
        in_b.steps[[b.low[y], b.high[y]]] += np.array([1, -1]) * (a.sums[a.high[x]] - a.sums[a.low[x]])
        right = np.arange(b.low[y], b.high[y]) + base
        unions.append(np.stack([left, np.full(len(left), right[0])], 1))
        unions.append(np.stack([right, np.full(len(right), left[0])], 1))

    def decide(i: np.ndarray, j: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Takes whole pairs of nodes, drops far ones and returns the rest."""
        reach = a.radius[i] + b.radius[j]
        point = (a.high[i] - a.low[i] == 1) & (b.high[j] - b.low[j] == 1)
        keep = d - reach <= limit + SLACK
        whole = keep & ~point & (d + reach <= limit - SLACK)
        for x, y in zip(i[whole].tolist(), j[whole].tolist(), strict=True):
            take_whole(x, y)
        keep &= ~whole
        return i[keep], j[keep]

    def verify(x: np.ndarray, y: np.ndarray) -> None:
        for at in range(0, len(x), CHUNK >> 4):
            p, q = x[at : at + (CHUNK >> 4)], y[at : at + (CHUNK >> 4)]
            dots = np.einsum("ij,ij->i", a.raw[p].astype(np.float64), b.raw[q].astype(np.float64))
            hit = dots / (a.norm[p] * b.norm[q]) >= cosine
            p, q = p[hit], q[hit]
            in_a.extra += np.bincount(p, b.weight[q], len(in_a.extra))
            in_b.extra += np.bincount(q, a.weight[p], len(in_b.extra))
            unions.append(np.stack([p, q + base], 1))

    def distance(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        dots = np.einsum("ij,ij->i", a.unit[a.centre[i]], b.unit[b.centre[j]])
        return np.sqrt(np.maximum(0, 2 - 2 * dots))

    one = np.zeros(1, np.int64)
    front = [decide(one, one, distance(one, one))]
    while front:
        i, j = front.pop()
        # a node with itself holds each unordered pair of members twice; other pairs of one tree are disjoint
        for own in (True, False):
            mine = (i == j) == own if same else np.full(len(i), not own)
            x, y = i[mine], j[mine]
            ends = (a.n_kids[x] == 0) & (b.n_kids[y] == 0)
            for p, q in _products(a.low[x[ends]], (a.high - a.low)[x[ends]], b.low[y[ends]], (b.high - b.low)[y[ends]]):
                verify(*((p[p < q], q[p < q]) if own else (p, q)))
            x, y = x[~ends], y[~ends]
            # a node without children stands for itself on the next level
            na, nb = np.maximum(1, a.n_kids[x]), np.maximum(1, b.n_kids[y])
            fa, fb = np.where(a.n_kids[x], a.kids[x], x), np.where(b.n_kids[y], b.kids[y], y)
            large = na * nb > 4096
            for k in np.flatnonzero(large):
                left, right = np.arange(fa[k], fa[k] + na[k]), np.arange(fb[k], fb[k] + nb[k])
                # a bound for each bin of radii comes first; decide() looks closer at what passes
                wide = b.radius[right]
                for bin_ in (right[wide <= 0.125], right[(wide > 0.125) & (wide <= 0.25)], right[wide > 0.25]):
                    if not len(bin_):
                        continue
                    reach = np.minimum(2, limit + SLACK + a.radius[left] + b.radius[bin_].max())
                    least, others = (1 - reach * reach / 2).astype(np.float32) - 1e-5, b.unit[b.centre[bin_]].T
                    step = max(1, CHUNK // len(bin_))
                    for at in range(0, len(left), step):
                        part = left[at : at + step]
                        dots = a.unit[a.centre[part]] @ others
                        p, q = np.nonzero(dots >= least[at : at + step, None])
                        i_, j_, d = part[p], bin_[q], np.sqrt(np.maximum(0, 2 - 2 * dots[p, q]))
                        if own:
                            once = i_ <= j_
                            i_, j_, d = i_[once], j_[once], d[once]
                        front.append(decide(i_, j_, d))
            for p, q in _products(fa[~large], na[~large], fb[~large], nb[~large]):
                if own:
                    p, q = p[p <= q], q[p <= q]
                front.append(decide(p, q, distance(p, q)))
        front = [f for f in front if len(f[0])]
    joined = np.concatenate(unions) if unions else np.zeros((0, 2), np.int64)
    return in_a.total(), in_b.total(), joined


def _roots(n: int, unions: np.ndarray) -> np.ndarray:
    """The smallest place that each of n places is joined with."""
    root = np.arange(n)
    while len(unions):
        low = np.minimum(root[unions[:, 0]], root[unions[:, 1]])
        new = root.copy()
        np.minimum.at(new, root[unions[:, 0]], low)
        np.minimum.at(new, root[unions[:, 1]], low)
        while (jump := new[new]).tolist() != new.tolist():
            new = jump
        if (new == root).all():
            break
        root = new
        unions = unions[root[unions[:, 0]] != root[unions[:, 1]]]
    return root


def _centres(sample: np.ndarray, count: int) -> np.ndarray:
    """``count`` of the vectors that lie far apart, each the farthest from those before."""
    chosen, far = [0], np.full(len(sample), np.inf)
    for _ in range(min(count, len(sample)) - 1):
        far = np.minimum(far, 2 - 2 * (sample @ sample[chosen[-1]]))
        if far.max() <= 1e-9:
            break
        chosen.append(int(far.argmax()))
    return sample[chosen]


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = 0.9, block: int = 4096, sample: int = 1024, centres: int = 256) -> DataFrame:
    """(id_col, n_links, component_id, kept) for every row of ``vectors``.

    Vectors that are null, empty, zero or hold null or non-finite components
    link with nothing and are their own component; vectors of different lengths do not
    link. Equal vectors are one point with a weight. Repeated ids are told
    apart as rows. Rows with a null id count as links of others, but their component
    is null where no id names it. Other columns are ignored; an empty table gives
    an empty result. ``sample`` and ``centres`` bound what picks the
    blocks; every vector is searched, and a cell of more than ``block`` points is
    split, so that no block grows with a cluster.
    """
    if not 0 < cosine <= 1:
        raise ValueError("cosine must be above 0 and at most 1")
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    good = F.coalesce(finite & F.exists("v", lambda x: x != 0), F.lit(False))
    points = rows.where(good).groupBy("v").agg(F.min("id").alias("low"), F.count(F.lit(1)).alias("weight"))
    # ids are given after the checkpoint, whose partitions stay as they are
    points = cut(points).select(F.monotonically_increasing_id().alias("point"), F.size("v").alias("dim"), "v", "low", "weight")
    n = points.count()
    if not n:
        return rows.select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.col("id").isNotNull().alias("kept"))
    size = min(block, max(512, math.ceil(n / 10)))
    picked = points.select("v").orderBy(F.xxhash64("v"), "v").limit(sample).collect()
    tops: dict[int, np.ndarray] = {}
    for dim in {len(r.v) for r in picked}:
        held = _unit(np.array([r.v for r in picked if len(r.v) == dim]))
        tops[dim] = _centres(held, min(centres, math.ceil(n / size))).astype(np.float32)
    shared = spark.sparkContext.broadcast(tops)

    @F.pandas_udf("int")
    def nearest(vs: pd.Series) -> pd.Series:
        out = np.zeros(len(vs), np.int32)
        lengths = np.array([len(v) for v in vs])
        for dim, top in shared.value.items():
            at = np.flatnonzero(lengths == dim)
            if len(at):
                held = _unit(np.stack([vs.iloc[k] for k in at]))
                out[at] = (held.astype(np.float32) @ top.T).argmax(1)
        return pd.Series(out)

    celled = cut(points.withColumn("cell", nearest("v")))
    counts = celled.groupBy("dim", "cell").count()
    part = F.pmod(F.xxhash64("point"), F.greatest(F.lit(1), F.ceil(F.col("count") / size)))
    blocked = celled.join(counts, ["dim", "cell"]).select("point", "v", "weight", F.concat_ws("-", "dim", "cell", part).alias("block"))

    def build(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("point")
        tree = CoverTree.build(group.point.to_numpy(np.int64), _scaled(np.stack(group.v.to_list())), group.weight.to_numpy(np.float64))
        centre = _unit(tree.raw[tree.centre[:1]])[0]
        return pd.DataFrame({"block": [key[0]], "dim": [len(centre)], "centre": [centre], "radius": [float(tree.radius[0])], "tree": [tree.dump()]})

    trees = cut(blocked.groupBy("block").applyInPandas(build, "block string, dim int, centre array<double>, radius double, tree binary"))
    # pairs of blocks that can hold a link, by their covering radii
    meta = trees.select("block", "dim", "centre", "radius")
    other = meta.toDF("other", "dim", "c2", "r2")
    dots = F.aggregate(F.zip_with("centre", "c2", lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)
    apart = F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * dots))
    pairs = meta.join(other, "dim").where(F.col("block") <= F.col("other")).where(apart <= F.col("radius") + F.col("r2") + math.sqrt(2 - 2 * cosine) + SLACK)
    sides = pairs.select("block", "other").withColumn("side", F.explode(F.array_distinct(F.array("block", "other"))))
    jobs = sides.join(trees.select(F.col("block").alias("side"), "tree"), "side")

    def search(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        held = {s: CoverTree.load(t) for s, t in zip(group.side, group.tree, strict=True)}
        a, b = held[key[0]], held[key[1]]
        in_a, in_b, unions = dual_search(a, b, cosine)
        ids = a.ids if a is b else np.concatenate([a.ids, b.ids])
        linked = in_a if a is b else np.concatenate([in_a, in_b])
        root = ids[_roots(len(ids), unions)]
        some = linked > 0
        return pd.DataFrame({"point": ids[some], "linked": np.rint(linked[some]).astype(np.int64), "root": root[some]})

    met = cut(jobs.groupBy("block", "other").applyInPandas(search, "point long, linked long, root long"))
    linked = met.groupBy("point").agg(F.sum("linked").alias("linked"))
    roots = connected_components(met.select(F.col("point").alias("a"), F.col("root").alias("b")))
    named = points.join(roots, points.point == roots.node, "left").select("point", "v", "low", "weight", F.coalesce("root", "point").alias("root"))
    lows = named.groupBy("root").agg(F.min("low").alias("component_id"))
    done = named.join(lows, "root").join(linked, "point", "left")
    done = done.select("v", (F.coalesce("linked", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "component_id")
    result = rows.where(good).join(done, "v").select("id", "n_links", "component_id")
    result = result.union(rows.where(~good).select("id", F.lit(0).cast("long"), "id"))
    kept = F.coalesce(F.col("id") == F.col("component_id"), F.lit(False))
    return result.select(F.col("id").alias(id_col), "n_links", "component_id", kept.alias("kept"))
