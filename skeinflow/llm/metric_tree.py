"""Exact top-k search by inner product in an M-tree of pages.

The order of inner products is that of distances, once vectors are made equally long by one more coordinate: with the
greatest norm M, |(q, 0) - (x, sqrt(M^2 - |x|^2))|^2 = |q|^2 + M^2 - 2 qx. In this metric every row goes to one of a bounded
number of routing objects, the rows of a route are packed into pages around one of their own, and each node keeps its
covering radius and its distance from its parent. Of a page the lower bound |d(q, parent) - d(page, parent)| - radius
needs no distance of its own, nor does |d(q, page) - d(x, page)| of a row.

A search goes first to the nearest routes that hold enough rows, which gives a bound for each query. With it, only routes
whose region reaches into the bound are visited. Visits are joined with pages by route, a part of the route's pages and
a part of its queries, so that a task holds a bounded number of both; in it each query takes the pages nearest first
until none can hold a better row. What is compared in the end are exact integer products."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import checkpoint, release, tidied
from .vectors import dots, finite, integers, limit

K, SCALE = 10, 1024
#: Rows of a page; of the stretch of a route that is cut into pages; pages and queries of one visit; rows for each route, and routes.
PAGE, STRETCH, PAGES, QUERIES, PER_ROUTE, ROUTES = 256, 4096, 64, 4096, 16_384, 4096
#: Numbers of rows within a page.
_PLACES = 1 << 12
_NONE, _NO_ID = np.iinfo(np.int64).min, np.iinfo(np.int64).max
_PAGE = "route int, page long, centre binary, parent double, radius double, ids array<long>, far binary, rows binary"
_FOUND = "query long, query_id long, score long, id long, row long"


class Space:
    """The metric: norms of rows are at most `most`, squared."""

    def __init__(self, most: float):
        self.most = most
        #: Slack of squared distances for what floats lose: it can only let more rows be looked at.
        self.slack = lambda qq: 1e-7 * (qq + most) + 1e-6

    def rise(self, x: np.ndarray) -> np.ndarray:
        """The further coordinate of rows."""
        return np.sqrt(np.maximum(self.most - (x * x).sum(axis=1), 0.0))

    def apart(self, x: np.ndarray, up: np.ndarray, y: np.ndarray, up_y: np.ndarray) -> np.ndarray:
        """Distances between rows."""
        square = (x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1) - 2 * (x @ y.T) + (up[:, None] - up_y) ** 2
        return np.sqrt(np.maximum(square, 0.0))

    def asked(self, q: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Distances of queries from rows."""
        return np.sqrt(np.maximum((q * q).sum(axis=1)[:, None] + self.most - 2 * (q @ y.T), 0.0))

    def highest(self, qq: np.ndarray, low: np.ndarray) -> np.ndarray:
        """The highest score that a row can have which is no nearer than `low`."""
        return (qq + self.most - np.maximum(low, 0.0) ** 2) / 2 + self.slack(qq)


class Routes:
    """The upper two levels of the tree: routing objects, and of these some that the others belong to."""

    def __init__(self, space: Space, rows: np.ndarray):
        self.space, self.rows, self.up = space, rows, space.rise(rows)
        self.heads = np.arange(-(-len(rows) // max(1, round(len(rows) ** 0.5))))
        away = self._from(rows, self.up, self.heads)
        self.head, self.parent = away.argmin(axis=1), away.min(axis=1)
        self.count = self.reach = None

    def _from(self, x: np.ndarray, up: np.ndarray, at: np.ndarray) -> np.ndarray:
        return self.space.apart(x, up, self.rows[at], self.up[at])

    def place(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The route of each row, found by way of the nearest head, and the distance from it."""
        up = self.space.rise(x)
        head = self._from(x, up, self.heads).argmin(axis=1)
        route, far = np.zeros(len(x), dtype=np.int32), np.zeros(len(x))
        for h in np.unique(head):
            own, at = np.flatnonzero(head == h), np.flatnonzero(self.head == h)
            away = self._from(x[own], up[own], at)
            route[own], far[own] = at[away.argmin(axis=1)], away.min(axis=1)
        return route, far

    def held(self, count: np.ndarray, reach: np.ndarray) -> "Routes":
        """With the rows of each route and its covering radius; heads cover their routes."""
        self.count, self.reach = count, reach
        self.cover = np.array([max((self.parent[i] + reach[i] for i in np.flatnonzero((self.head == h) & (count > 0))), default=-1.0) for h in range(len(self.heads))])
        return self

    def home(self, q: np.ndarray, k: int) -> tuple[list[np.ndarray], np.ndarray]:
        """The nearest routes of each query that hold more than k rows together, and the distances from all routes."""
        far = self.space.asked(q, self.rows)
        order = np.argsort(far, axis=1, kind="stable")
        enough = np.cumsum(self.count[order], axis=1) > k
        n = np.where(enough.any(axis=1), enough.argmax(axis=1) + 1, order.shape[1])
        return [o[: m] for o, m in zip(order, n, strict=True)], far

    def reached(self, q: np.ndarray, best: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each query the routes beside its home that may hold a row as good as `best`, and the distances from them.
        Heads too far away rule out their routes unseen."""
        qq, heads = (q * q).sum(axis=1), self.rows[self.heads]
        away = self.space.asked(q, heads)
        homes, far = self.home(q, k)
        for i in range(len(q)):
            near = self.space.highest(qq[i], away[i] - self.cover) >= best[i]
            on = near[self.head] & (self.count > 0) & (self.space.highest(qq[i], np.abs(away[i][self.head] - self.parent) - self.reach) >= best[i])
            on[homes[i]] = False
            on &= self.space.highest(qq[i], far[i] - self.reach) >= best[i]
            at = np.flatnonzero(on)
            yield i, at, far[i][at]


def _small(x: np.ndarray) -> bytes:
    """Whole numbers in as few bytes as hold them."""
    most = np.abs(x).max(initial=0)
    return b"s" + x.astype(np.int16).tobytes() if most < 2**15 else b"i" + x.astype(np.int32).tobytes() if most < 2**31 else b"d" + x.astype(np.float64).tobytes()


def _large(data: bytes, width: int) -> np.ndarray:
    kind = {b"s": np.int16, b"i": np.int32, b"d": np.float64}[data[:1]]
    return np.frombuffer(data, dtype=kind, offset=1).astype(np.float64).reshape(-1, width)


def _bunches(x: np.ndarray, up: np.ndarray, space: Space, size: int) -> list[np.ndarray]:
    """Rows cut in halves by two that lie far apart, until each part has `size` at most."""
    todo, done = [np.arange(len(x))], []
    while todo:
        at = todo.pop()
        if len(at) <= size:
            done.append(at)
            continue
        own, high = x[at], up[at]
        a = space.apart(own, high, own[:1], high[:1]).argmax()
        far = space.apart(own, high, own[a : a + 1], high[a : a + 1])[:, 0]
        b = far.argmax()
        lean = far - space.apart(own, high, own[b : b + 1], high[b : b + 1])[:, 0]
        order = np.argsort(lean, kind="stable")
        half = -(-len(at) // (2 * size)) * size
        todo += [at[order[half:]], at[order[:half]]]
    return done


class Search:
    """What all tasks know: the space, the routes, the width of vectors."""

    def __init__(self, rows: DataFrame, scale: int, id_: str, vector: str, routes: int, per_route: int, page: int):
        self.page = page
        self.spark = rows.sparkSession
        own = rows.select(F.col(id_).cast("long").alias("id"), F.col(vector).alias("vec")).where(finite(F.col("vec")))
        self.width = own.agg(F.max(F.size("vec"))).first()[0] or 0
        #: Whole numbers of a column of vectors.
        self.ints = functools.partial(integers, scale=scale, width=self.width, largest=limit(self.width))
        stats = own.select("vec").mapInArrow(self._norms(), "n long, most double").agg(F.sum("n"), F.max("most")).first()
        self.n, self.space = stats[0] or 0, Space(stats[1] or 0.0)
        if not self.n:
            return
        n = min(routes, -(-self.n // per_route))
        some = own.orderBy(F.xxhash64("id", "vec"), "id").limit(n).select("vec").toArrow()
        chosen = np.unique(self.ints(some.column("vec")), axis=0)
        self.routes = Routes(self.space, chosen)
        placed = own.mapInArrow(self._placed(), "route int, far double, id long, vec array<double>")
        packed = placed.repartitionByRange("route", "far", "id").sortWithinPartitions("route", "far", "id").mapInArrow(self._packed(), _PAGE)
        self.pages = checkpoint(packed)
        per = self.pages.groupBy("route").agg(F.sum(F.size("ids")).alias("n"), F.max(F.col("parent") + F.col("radius")).alias("reach"), F.count("*").alias("pages")).toArrow()  # ROUTES rows at most
        count, reach, self.n_pages = np.zeros(len(chosen), np.int64), np.zeros(len(chosen)), np.zeros(len(chosen), np.int64)
        at = per.column("route").to_numpy()
        count[at], reach[at], self.n_pages[at] = (per.column(c).to_numpy() for c in ("n", "reach", "pages"))
        self.routes.held(count, reach)

    def _norms(self):
        ints = self.ints

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n, most = 0, 0.0
            for b in batches:
                x = ints(b.column("vec"))
                n, most = n + len(x), max(most, (x * x).sum(axis=1).max(initial=0.0))
            yield pa.RecordBatch.from_pydict({"n": [n], "most": [most]})

        return run

    def _placed(self):
        ints, routes = self.ints, self.routes

        @tidied
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x = ints(b.column("vec"))
                route, far = routes.place(x)
                at = (np.arange(len(x) + 1) * x.shape[1]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(route), pa.array(far), b.column("id"), pa.ListArray.from_arrays(pa.array(at), pa.array(x.reshape(-1)))], ["route", "far", "id", "vec"])

        return run

    def _packed(self):
        """Pages of rows that come by route and distance from it."""
        space, width, size, routes = self.space, self.width, self.page, self.routes

        @tidied
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            page = TaskContext.get().partitionId() << 32
            for b in batches:
                by = b.column("route").to_numpy()
                ids = b.column("id").fill_null(_NO_ID).to_numpy()
                x = np.asarray(b.column("vec").flatten(), dtype=np.float64).reshape(b.num_rows, width)
                up, out = space.rise(x), []
                edges = [0, *(np.flatnonzero(np.diff(by)) + 1).tolist(), len(by)]
                for lo, hi in ((a, min(a + STRETCH, z)) for f, z in zip(edges, edges[1:], strict=False) for a in range(f, z, STRETCH)):
                    for at in _bunches(x[lo:hi], up[lo:hi], space, size):
                        at = lo + at[np.argsort(ids[lo + at], kind="stable")]
                        own, high, route = x[at], up[at], slice(by[lo], by[lo] + 1)
                        middle = space.apart(own, high, own.mean(axis=0)[None], np.array([high.mean()]))[:, 0].argmin()
                        centre, rise = own[middle : middle + 1], high[middle : middle + 1]
                        far = space.apart(own, high, centre, rise)[:, 0]
                        parent = space.apart(centre, rise, routes.rows[route], routes.up[route])[0, 0]
                        out.append((by[lo], page + len(out), centre.tobytes(), parent, far.max(), ids[at], far.tobytes(), _small(own)))
                page += len(out)
                if out:
                    kinds = (pa.int32(), pa.int64(), pa.binary(), pa.float64(), pa.float64(), pa.list_(pa.int64()), pa.binary(), pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], [c.split()[0] for c in _PAGE.split(", ")])

        return run

    def queries(self, every: int) -> DataFrame:
        """Rows (query, query_id, vec) of the pages' rows whose id is divisible by `every`."""
        width = self.width

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for page, ids, rows in zip(b.column("page").to_pylist(), b.column("ids"), b.column("rows").to_pylist(), strict=True):
                    own = np.asarray(ids.values, dtype=np.int64)
                    at = np.flatnonzero((own % every == 0) & (own != _NO_ID))
                    if len(at):
                        x = _large(rows, width)[at]
                        yield pa.RecordBatch.from_arrays([pa.array(page * _PLACES + at), pa.array(own[at]), pa.array([r.tobytes() for r in x], pa.binary())], ["query", "query_id", "vec"])

        return self.pages.select("page", "ids", "rows").mapInArrow(run, "query long, query_id long, vec binary")

    def visits(self, queries: DataFrame, k: int, home: bool) -> DataFrame:
        """Rows (route, query, query_id, vec, far, best): the routes that each query goes to first, or those that its `best`
        score leaves to be looked at."""
        routes, width = self.routes, self.width

        @tidied
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for lo in range(0, whole.num_rows, 256):
                    b = whole.slice(lo, 256)
                    q, best = _vectors(b.column("vec"), width), b.column("best").to_numpy()
                    if home:
                        at, away = routes.home(q, k)
                        found = [(i, r, away[i][r]) for i, r in enumerate(at)]
                    else:
                        found = list(routes.reached(q, best.astype(np.float64), k))
                    of = pa.array(np.repeat([i for i, _, _ in found], [len(r) for _, r, _ in found]).astype(np.int64))
                    route, far = (np.concatenate([f[c] for f in found]) for c in (1, 2))
                    yield pa.RecordBatch.from_arrays([pa.array(route.astype(np.int32)), *[b.column(c).take(of) for c in ("query", "query_id", "vec")], pa.array(far.astype(np.float64)), b.column("best").take(of)], ["route", "query", "query_id", "vec", "far", "best"])

        return queries.select("query", "query_id", "vec", "best").mapInArrow(run, "route int, query long, query_id long, vec binary, far double, best long")

    def found(self, visits: DataFrame, k: int) -> DataFrame:
        """The best k rows, or those that aren't worse than the query's `best`, of each visit."""
        asked = visits.groupBy("route").agg(F.count("*").alias("n")).toArrow().to_pylist()  # ROUTES rows at most
        shape = self.spark.createDataFrame([(r["route"], int(-(-self.n_pages[r["route"]] // PAGES)), int(-(-r["n"] // QUERIES))) for r in asked], "route int, parts long, groups long")
        shape = F.broadcast(shape)
        own = visits.join(shape, "route").withColumn("group", F.pmod(F.xxhash64("query"), "groups")).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
        pages = self.pages.join(shape, "route").withColumn("part", F.pmod(F.xxhash64("page"), "parts")).withColumn("group", F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1)))
        key = ["route", "part", "group"]
        return own.drop("parts", "groups").groupBy(*key).cogroup(pages.drop("parts", "groups").groupBy(*key)).applyInArrow(_visited(self.space, self.width, k), _FOUND)


def _vectors(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.float64).reshape(-1, width)


class Best:
    """The best k rows of some queries so far: scores, ids, row numbers, best first, ties to the smaller id."""

    def __init__(self, bound: np.ndarray, k: int):
        self.bound, self.k = bound, k
        self.score, self.id, self.row = (np.full((len(bound), k), v, dtype=np.int64) for v in (_NONE, _NO_ID, -1))

    def least(self) -> np.ndarray:
        """The score that a row must have to count."""
        return np.maximum(self.bound, self.score[:, -1])

    def put(self, at: np.ndarray, score: np.ndarray, id_: np.ndarray, row: np.ndarray) -> None:
        own = np.unique(at)
        of = np.concatenate([np.repeat(own, self.k), at])
        score, id_, row = (np.concatenate([a[own].reshape(-1), b]) for a, b in ((self.score, score), (self.id, id_), (self.row, row)))
        order = np.lexsort((row, id_, ~score, row < 0, of))
        of, score, id_, row = of[order], score[order], id_[order], row[order]
        rank = np.arange(len(of)) - np.searchsorted(of, of)
        on = rank < self.k
        for held, new in ((self.score, score), (self.id, id_), (self.row, row)):
            held[of[on], rank[on]] = new[on]


def _visited(space: Space, width: int, k: int):
    def run(visits: pa.Table, pages: pa.Table) -> pa.Table:
        query, query_id = visits.column("query").to_numpy(), visits.column("query_id").to_numpy()
        q, from_route = _vectors(visits.column("vec"), width), visits.column("far").to_numpy()
        best, qq = Best(visits.column("best").to_numpy(), k), (q * q).sum(axis=1)
        if len(q) and pages.num_rows:
            _search(space, width, query, q, qq, from_route, pages, best)
        at, rank = np.nonzero(best.row >= 0)
        return pa.table({"query": query[at], "query_id": query_id[at], "score": best.score[at, rank], "id": best.id[at, rank], "row": best.row[at, rank]})

    return run


def _search(space: Space, width: int, query: np.ndarray, q: np.ndarray, qq: np.ndarray, from_route: np.ndarray, pages: pa.Table, best: Best) -> None:
    """Each query takes the pages nearest first; queries at the same page in the same step go through it together."""
    parent, radius, numbers = (pages.column(c).to_numpy() for c in ("parent", "radius", "page"))
    centres = _vectors(pages.column("centre"), width)
    ids = [np.asarray(x.values, dtype=np.int64) for x in pages.column("ids")]
    far = [np.frombuffer(x) for x in pages.column("far").to_pylist()]
    rows = [_large(x, width) for x in pages.column("rows").to_pylist()]
    # By the distances from the route alone, then by those from the pages that are left.
    high = space.highest(qq[:, None], np.abs(from_route[:, None] - parent) - radius)
    high[high < best.least()[:, None]] = -np.inf
    near = np.flatnonzero((high > -np.inf).any(axis=0))
    away = np.full(high.shape, np.inf)
    away[:, near] = space.asked(q, centres[near])
    high = np.minimum(high, space.highest(qq[:, None], np.where(np.isfinite(away), away - radius, 0.0)))
    order, each = np.argsort(-high, axis=1, kind="stable"), np.arange(len(q))
    for step in range(len(numbers)):
        page, least = order[:, step], best.least()
        on = (high[each, page] > -np.inf) & (high[each, page] >= least)
        if not on.any():
            break
        for j in np.unique(page[on]):
            at = np.flatnonzero(on & (page == j))
            may = space.highest(qq[at][:, None], np.abs(away[at, j][:, None] - far[j])) >= least[at][:, None]
            cols = np.flatnonzero(may.any(axis=0))
            if not len(cols):
                continue
            score, own = dots(q[at], rows[j][cols]).astype(np.int64), numbers[j] * _PLACES + cols
            good = may[:, cols] & (score >= least[at][:, None]) & (own != query[at][:, None])
            if len(cols) > best.k + 1:  # with the query's own row a k-th best one is still among these
                good &= score >= np.partition(score, len(cols) - best.k - 1, axis=1)[:, len(cols) - best.k - 1][:, None]
            a, b = np.nonzero(good)
            if len(a):
                best.put(at[a], score[a, b], ids[j][cols[b]], own[b])


def _top(rows: DataFrame, k: int) -> DataFrame:
    by = Window.partitionBy("query").orderBy(F.desc("score"), "id", "row")
    return rows.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def search(rows: DataFrame, k: int = K, every: int = 100, scale: int = SCALE, id_: str = "vec_id", vector: str = "embedding", routes: int = ROUTES, per_route: int = PER_ROUTE, page: int = PAGE) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): for each row whose id is divisible by `every` the k other rows of highest inner
    product, ties to the smaller id, a null one last; all, where there are fewer.

    Components are floor(scale * x), products exact. Vectors that are null or hold null, NaN or infinite components take no
    part; shorter ones end in zeros; components are held within the range in which no product leaves a long (over
    260,000 for 64 of them). Equal rows are rows of their own: each is the other's neighbour, and each is a query. Of the
    routing objects, at most `routes` rows of least hash, the number alone depends on the data; every row is indexed."""
    tree = Search(rows, scale, id_, vector, routes, per_route, page)
    none = "query_id long, rank int, vec_id long, score long"
    if not tree.n:
        return tree.spark.createDataFrame([], none)
    queries = checkpoint(tree.queries(every))
    first = checkpoint(_top(tree.found(tree.visits(queries.withColumn("best", F.lit(_NONE)), k, True), k), k))
    bound = first.groupBy("query").agg(F.when(F.count("*") == k, F.min("score")).alias("best"))
    bounded = queries.join(bound, "query", "left").withColumn("best", F.coalesce("best", F.lit(_NONE)))
    more = checkpoint(tree.visits(bounded, k, False))
    release(tree.spark)
    found = first.drop("rank") if more.isEmpty() else first.drop("rank").unionByName(tree.found(more, k))
    return _top(found, k).select("query_id", "rank", F.when(F.col("id") != _NO_ID, F.col("id")).alias("vec_id"), "score")


#: All queries against all rows.
SQL = f"""with f as (select vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::double)::bigint) as v from embeddings where embedding is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
s as (select q.vec_id as query_id, c.vec_id as vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2]))::bigint as score from f q join f c on q.vec_id % 100 = 0 and c.vec_id <> q.vec_id)
select query_id, (row_number() over (partition by query_id order by score desc, vec_id))::int as rank, vec_id, score from s qualify rank <= {K}"""
