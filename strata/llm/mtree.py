"""Exact top-k inner products by best-first search of M-trees.

Inner products become distances on the unit sphere: with R the largest norm of a
tree, a vector v is placed at (v / R, the rest up to length one) and a query q at
(q / |q|, 0), so that d^2 = 2 - 2 q.v / (R |q|) and the nearest vector has the
largest product.

Rows are dealt to trees of bounded size by their nearest pivot, split by a hash
where one pivot has too many. A tree is a table of pages: inner pages hold routing
objects with covering radius and distance to the parent, leaf pages hold vectors
with theirs. A search keeps a queue of pages by the least distance they can hold;
for every entry the stored parent distance gives a bound by the triangle inequality
before any distance is computed. Distances only steer; scores are computed in
integers, and a page or entry is passed over only if it can neither beat the k-th
score nor tie it.

Every query first searches the tree whose centre has the largest product with it.
Its k-th score there goes with it as a bound, and of the other trees it meets only
those whose covering ball can hold a score as high. A tree travels once to each
slice of the queries that ask for it.

Defined results: rows without an id and vectors that are null or hold null or
non-finite components take no part; vectors meet those of their own length (empty
ones too: all their scores are 0); rows with the query's own id aren't its
candidates; repeated rows are candidates each, and queries that share an id are one
query, its rows' best together. A component beyond 2^62 after scaling, or a result
of 2^63 - 1 or more in size, is an error.
"""

from __future__ import annotations

import heapq
import pickle

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strata.llm.common import Scratch

PAGE, TREE_ROWS, SLICE_ROWS, PIVOTS = 256, 8_192, 512, 4_096
REGION_BYTES, REGION_QUERIES = 8 << 20, 8_192  # of tree outlines that a task holds at once, and of queries that it compares with them
LIMIT, EDGE = float(1 << 62), (1 << 63) - 1
SLACK = 1e-6  # of distances between points of length one: far more than double precision loses


def sphere_points(vectors: np.ndarray, top: float) -> np.ndarray:
    unit = vectors / top
    return np.column_stack([unit, np.sqrt(np.maximum(0.0, 1.0 - (unit**2).sum(1)))])


def lengths(vectors: np.ndarray) -> np.ndarray:
    return np.sqrt((vectors**2).sum(1))


def reach(base, score, scale):
    """The distance beyond which no product is at least the score."""
    return np.sqrt(np.maximum(0.0, base - 2.0 * score / scale)) + SLACK


class Tree:
    """pages: arrays by page. A leaf has rows; an inner page has children with routing objects."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, page: int = PAGE):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], vectors[order].astype(np.int64)
        self._place()
        self.pages: list[tuple] = []
        rows = np.arange(len(self.ids))
        self.root_row = int(((self.points - self.points.mean(0)) ** 2).sum(1).argmin())
        self.radius = float(self._distances(rows, self.root_row).max())
        self.root = self._build(rows, self.root_row, page, np.random.default_rng(len(ids)))

    def _place(self) -> None:
        self.wide = self.vectors.astype(np.float64)
        self.top = float(lengths(self.wide).max()) or 1.0
        self.points = sphere_points(self.wide, self.top)
        self.largest = np.abs(self.wide).max(1, initial=0.0)

    def dump(self) -> bytes:
        most = int(np.abs(self.vectors).max(initial=0))
        small = next(t for t in (np.int8, np.int16, np.int32, np.int64) if most <= np.iinfo(t).max)
        return pickle.dumps((self.ids, self.vectors.astype(small), self.pages, self.root, self.root_row, self.radius), 5)

    @classmethod
    def load(cls, dumped: bytes) -> Tree:
        tree = cls.__new__(cls)
        tree.ids, vectors, tree.pages, tree.root, tree.root_row, tree.radius = pickle.loads(dumped)
        tree.vectors = vectors.astype(np.int64)
        tree._place()
        return tree

    def _distances(self, rows: np.ndarray, pivot: int) -> np.ndarray:
        return lengths(self.points[rows] - self.points[pivot])

    def _build(self, rows: np.ndarray, pivot: int, page: int, random: np.random.Generator) -> int:
        """The page of the rows under a routing object; children first, by bounded fan-out."""
        if len(rows) <= page:
            self.pages.append(("leaf", rows, self._distances(rows, pivot)))
            return len(self.pages) - 1
        pivots = random.choice(rows, max(2, min(page, -(-len(rows) // page) + 1)), replace=False)
        owner = np.stack([self._distances(rows, p) for p in pivots]).argmin(0)
        if np.bincount(owner, minlength=len(pivots)).max() > 0.9 * len(rows):  # many equal points: dealt out by id
            owner = np.arange(len(rows)) * len(pivots) // len(rows)
        children, centres, radii, to_parent = [], [], [], []
        for k, p in enumerate(pivots):
            own = rows[owner == k]
            if not len(own):
                continue
            children.append(self._build(own, p, page, random))
            centres.append(p)
            radii.append(float(self._distances(own, p).max()))
            to_parent.append(float(self._distances(np.array([p]), pivot)[0]))
        self.pages.append(("inner", np.array(children), np.array(centres), np.array(radii), np.array(to_parent)))
        return len(self.pages) - 1

    def products(self, rows: np.ndarray, query: np.ndarray, size: float) -> np.ndarray:
        """Exact: in doubles where every sum stays below 2^53, else in whole numbers of any size."""
        if size * self.largest[rows].max(initial=0.0) < 2.0**53:
            return (self.wide[rows] @ query.astype(np.float64)).astype(np.int64)
        whole = [int(x) for x in query]
        return np.array([sum(a * int(b) for a, b in zip(whole, v)) for v in self.vectors[rows]], object)

    def search(self, own_id: int, query: np.ndarray, k: int, least: int | None = None) -> list[tuple[int, int]]:
        """The k best (score, id), ties to the smaller id, of rows with another id; with ``least`` only scores of at least that."""
        wide = query.astype(np.float64)
        length, size = float(np.sqrt((wide**2).sum())), float(np.abs(wide).sum())
        point = np.append(wide / length if length else wide, 0.0)
        base, scale = float((point**2).sum()) + 1.0, self.top * length
        best: list[tuple[int, int]] = []  # heap of (score, -id): the worst first
        self.computed = 0
        limit = float(reach(base, least, scale)) if least is not None and scale else np.inf
        start = float(np.sqrt(((self.points[self.root_row] - point) ** 2).sum()))
        queue = [(0.0, self.root, start)]
        while queue:
            bound, at, to_centre = heapq.heappop(queue)
            if bound > limit:
                break
            page = self.pages[at]
            if page[0] == "leaf":
                rows = page[1][(np.abs(to_centre - page[2]) <= limit) & (self.ids[page[1]] != own_id)]
                if not len(rows):
                    continue
                self.computed += len(rows)
                scores, ids = self.products(rows, query, size), self.ids[rows]
                floor = best[0][0] if len(best) == k else least
                if floor is not None:
                    able = np.flatnonzero(scores >= floor)
                    scores, ids = scores[able], ids[able]
                for s, i in sorted(zip(scores.tolist(), (-ids).tolist()), reverse=True)[:k]:
                    if len(best) < k:
                        heapq.heappush(best, (s, i))
                    elif (s, i) > best[0]:
                        heapq.heapreplace(best, (s, i))
                    else:
                        break
                if len(best) == k and scale:
                    limit = min(limit, float(reach(base, best[0][0], scale)))
                continue
            _, children, centres, radii, to_parent = page
            able = np.flatnonzero(np.abs(to_centre - to_parent) - radii <= limit)
            if not len(able):
                continue
            self.computed += len(able)
            d = lengths(self.points[centres[able]] - point)
            low = np.maximum(0.0, d - radii[able])
            for j, dist, lo in zip(able.tolist(), d.tolist(), low.tolist()):
                if lo <= limit:
                    heapq.heappush(queue, (lo, int(children[j]), dist))
        return sorted(((s, -i) for s, i in best), key=lambda x: (-x[0], x[1]))


def as_long(score: int) -> int:
    """The score, or the nearer end of the longs, which no result may be."""
    return max(-EDGE, min(EDGE, score))


def whole_numbers(vector: Column) -> Column:
    """floor(256 x) of each component, as a long."""
    fine = lambda y: F.when(F.abs(y) <= LIMIT, F.floor(y)).otherwise(F.raise_error(F.concat(F.lit("component beyond 2^62 after scaling: "), y.cast("string"))).cast("long"))
    return F.transform(vector, lambda x: fine(x.cast("double") * 256))


def usable(vectors: DataFrame, id_column: str, vector: str) -> DataFrame:
    """(vec_id, v) of the rows that take part."""
    fine = F.forall(F.col(vector), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    own = vectors.where(F.col(id_column).isNotNull() & F.col(vector).isNotNull() & fine)
    return own.select(F.col(id_column).cast("long").alias("vec_id"), whole_numbers(F.col(vector)).alias("v"))


def nearest_pivots(rows: pd.Series, pivots: dict[int, np.ndarray]) -> np.ndarray:
    """The number of each vector's nearest pivot of its length; 0 where there is none."""
    out, sizes = np.zeros(len(rows), np.int64), np.array([len(v) for v in rows])
    for size in np.unique(sizes):
        own = np.flatnonzero(sizes == size)
        centres = pivots.get(int(size))
        if centres is not None and len(centres) > 1 and size:
            v = np.stack(rows.iloc[own].to_list()).astype(np.float64)
            out[own] = ((centres**2).sum(1) - 2.0 * v @ centres.T).argmin(1)
    return out


def build_trees(rows: DataFrame, n: int, tree_rows: int, scratch: Scratch) -> DataFrame:
    """(tree, size, pages, outline) over rows (vec_id, v); the outline is the centre's vector, the largest norm and the radius.

    Where one tree can hold all rows, there is one for each length.
    """
    trees = max(1, -(-n // tree_rows))

    def build(group: pd.DataFrame) -> pd.DataFrame:
        size = int(group["size"].iloc[0])
        tree = Tree(group["vec_id"].to_numpy(), np.stack(group["v"].to_list()).astype(np.int64).reshape(len(group), size))
        outline = np.append(tree.points[tree.root_row], [tree.top, tree.radius])
        return pd.DataFrame({"tree": group["tree"].iloc[:1], "size": [size], "pages": [tree.dump()], "outline": [outline.tobytes()]})

    made = lambda dealt: scratch.put(dealt.groupBy("tree").applyInPandas(build, "tree long, size int, pages binary, outline binary"))
    if trees == 1:
        return made(rows.select(F.size("v").cast("long").alias("tree"), F.size("v").alias("size"), "vec_id", "v"))
    chosen: dict[int, list] = {}
    for r in rows.orderBy(F.xxhash64("v"), "vec_id").limit(min(PIVOTS, trees)).select("v").collect():  # at most PIVOTS vectors
        chosen.setdefault(len(r.v), []).append(r.v)
    pivots = {size: np.array(vs, np.float64).reshape(len(vs), size) for size, vs in chosen.items()}

    @F.pandas_udf("long")
    def nearest(v: pd.Series) -> pd.Series:
        return pd.Series(nearest_pivots(v, pivots))

    near = scratch.put(rows.withColumn("size", F.size("v")).withColumn("pivot", nearest("v")))
    parts = near.groupBy("size", "pivot").agg(F.ceil(F.count(F.lit(1)) / F.lit(float(tree_rows))).alias("parts"))  # one row per pivot and length
    dealt = near.join(parts, ["size", "pivot"]).withColumn("tree", F.xxhash64("size", "pivot", F.pmod(F.xxhash64("v", "vec_id"), "parts")))
    return made(dealt.select("tree", "size", "vec_id", "v").repartition(2 * trees, "tree"))


def outlines(trees: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(size, chunk, held): the trees' outlines in chunks of REGION_BYTES or so by length; and the chunks' keys."""
    per_chunk = F.greatest(F.lit(1), F.lit(REGION_BYTES) / (8 * (F.col("size") + 3))).cast("int")
    dealt = trees.select("tree", "size", "outline", F.pmod(F.xxhash64("tree"), F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)).over(Window.partitionBy("size")) / per_chunk))).alias("chunk"))
    chunks = scratch.put(dealt.groupBy("size", "chunk").agg(F.sort_array(F.collect_list(F.struct("tree", "outline"))).alias("held")))
    return chunks, scratch.put(chunks.select("size", "chunk"))


def asks(queries: DataFrame, chunked: tuple[DataFrame, DataFrame], first: bool, n: int) -> DataFrame:
    """(tree, slice, query, own_id, v, least): which trees the queries (query, own_id, size, v, least) meet: with ``first`` the most promising, else all that can hold a score of at least ``least``."""
    chunks, keys = chunked
    blocks = max(1, -(-n // REGION_QUERIES))
    left = queries.join(keys, "size").withColumn("block", F.pmod(F.xxhash64("query"), F.lit(blocks)))
    right = chunks.select("size", "chunk", "held").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))

    def choose(own: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        if not len(own) or not len(held):
            return pd.DataFrame({n: [] for n in names})
        tree = np.array([h["tree"] for h in held["held"].iloc[0]], np.int64)
        outline = np.stack([np.frombuffer(h["outline"], np.float64) for h in held["held"].iloc[0]])
        centres, tops, radii = outline[:, :-2], outline[:, -2], outline[:, -1]
        q = np.stack([np.frombuffer(v, np.int64) for v in own["v"]]).astype(np.float64)
        size = lengths(q)
        q = q / np.where(size > 0, size, 1.0)[:, None]
        with_centre = q @ centres[:, :-1].T
        if first:
            best = (with_centre * tops).argmax(1)
            return own.assign(tree=tree[best])[names]
        base = np.where(size > 0, 2.0, 1.0)
        d = np.sqrt(np.maximum(0.0, (base - 1.0)[:, None] + (centres**2).sum(1) - 2.0 * with_centre))
        least = own["least"].astype("float64").fillna(-np.inf).to_numpy()
        scale = size[:, None] * tops
        with np.errstate(divide="ignore", invalid="ignore"):
            far = reach(base[:, None], least[:, None], scale)
        able = (d - radii <= far + SLACK) | (scale == 0) | ~np.isfinite(least)[:, None]
        i, j = np.nonzero(able)
        return own.iloc[i].assign(tree=tree[j])[names]

    names = ["tree", "query", "own_id", "v", "least"]
    found = left.groupBy("size", "chunk", "block").cogroup(right.groupBy("size", "chunk", "block")).applyInPandas(choose, "tree long, query long, own_id long, v binary, least decimal(20,0)")
    return found.withColumn("slice", _slice(n))


def _slice(n: int) -> Column:
    return F.pmod(F.xxhash64("query"), F.lit(max(1, -(-n // SLICE_ROWS))))


def search_trees(wanted: DataFrame, trees: DataFrame, k: int, scratch: Scratch) -> DataFrame:
    """(query, tree, score, vec_id): each query's k best in each tree it asks for."""
    groups = scratch.put(wanted.select("tree", "slice").distinct())
    parts = max(1, groups.count())
    pages = groups.join(trees.select("tree", "pages"), "tree").repartition(parts, "tree", "slice")

    def look(own: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(own) and len(held):
            tree, name = Tree.load(held["pages"].iloc[0]), own["tree"].iloc[0]
            for q, own_id, v, least in zip(own["query"], own["own_id"], own["v"], own["least"]):
                out += [(q, name, as_long(s), i) for s, i in tree.search(own_id, np.frombuffer(v, np.int64), k, None if least is None else int(least))]
        return pd.DataFrame(out, columns=["query", "tree", "score", "vec_id"]).astype("int64")

    return scratch.put(wanted.repartition(parts, "tree", "slice").groupBy("tree", "slice").cogroup(pages.groupBy("tree", "slice")).applyInPandas(look, "query long, tree long, score long, vec_id long"))


def top_products(vectors: DataFrame, k: int = 5, query_step: int = 50, id_column: str = "vec_id", vector: str = "embedding", tree_rows: int = TREE_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): for every row whose id the step divides, the k best other rows."""
    scratch = Scratch(vectors.sparkSession, "mtree")
    own = scratch.put(usable(vectors, id_column, vector))
    # Of equal vectors only those with the smallest ids can be in a result: k rows of an id at most, and k beside the query's own.
    kept = own.withColumn("r", F.row_number().over(Window.partitionBy("v", "vec_id").orderBy("vec_id"))).where(F.col("r") <= k)
    kept = kept.withColumn("r", F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))).where(F.col("r") <= 2 * k)
    rows = scratch.put(kept.select("vec_id", "v"))
    n_rows = rows.count()
    trees = build_trees(rows, n_rows, tree_rows, scratch)

    pack = F.pandas_udf(lambda vs: vs.map(lambda v: np.asarray(v, np.int64).tobytes()), "binary")
    asked = own.where(F.col("vec_id") % query_step == 0).distinct()
    none = F.lit(None).cast("decimal(20,0)").alias("least")  # as a long, pandas would make it a double where some are null
    queries = scratch.put(asked.select(F.monotonically_increasing_id().alias("query"), F.col("vec_id").alias("own_id"), F.size("v").alias("size"), pack("v").alias("v"), none))
    n = queries.count()
    if n_rows <= tree_rows:
        each = queries.join(trees.select("tree", "size"), "size").withColumn("slice", _slice(n))
        return best_of(search_trees(scratch.put(each), trees, k, scratch), queries, k)
    chunked = outlines(trees, scratch)
    near = search_trees(scratch.put(asks(queries, chunked, True, n)), trees, k, scratch)
    bounds = near.groupBy("query").agg(F.sort_array(F.collect_list("score"), asc=False).alias("best")).where(F.size("best") >= k).select("query", F.col("best")[k - 1].cast("decimal(20,0)").alias("least"))  # k for each tree searched
    far = asks(queries.drop("least").join(bounds, "query", "left"), chunked, False, n).join(near.select("query", "tree").distinct(), ["query", "tree"], "left_anti")
    return best_of(near.unionByName(search_trees(scratch.put(far), trees, k, scratch)), queries, k)


def best_of(found: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score) from what the trees gave."""
    found = found.join(queries.select("query", F.col("own_id").alias("query_id")), "query")
    ranks = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    score = F.when(F.abs("score") < EDGE, F.col("score")).otherwise(F.raise_error(F.lit("a score isn't a long")).cast("long"))
    return found.withColumn("rank", F.row_number().over(ranks)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", score.alias("score"))


#: Components are whole numbers, and their products are summed as such.
TOP_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 256)::HUGEINT) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
q AS (SELECT DISTINCT vec_id, v FROM v WHERE vec_id % 50 = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, coalesce(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])), 0)::BIGINT AS score
      FROM q JOIN v c ON c.vec_id <> q.vec_id AND len(c.v) = len(q.v)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5
"""
