"""Exact top-k inner products by best-first search in a paged M-tree.

Integer inner products become distances: with one more component that brings every candidate to
the same length, the nearest vectors are those with the highest products. The tree is built once and
stored in the shared folder: routing vectors at the top, as many as the rows need; under each of
them groups of bounded size with a covering radius; in a group, pages of entries round a routing
vector of their own, with covering radii, distances to the group's routing vector (the parent) and of
each entry to its page's. A query goes to its nearest group first, page by page in the order of
their bounds; what it finds there closes most other groups and pages. A stored distance gives a
bound by the triangle inequality before anything is computed: for a page by its parent, for an
entry by its page. Bounds are loosened by a margin for rounding, and scores are exact integers.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folio.llm.common import dropped, table, written

ROUTES = (16, 8192)  # routing vectors at the top, at least and at most
GROUP_ROWS = 4096
PAGE_ROWS = 256
QUERY_BLOCK = 4096
TOGETHER = 32  # queries of like distance to a page that are multiplied at once
LEAST = -(1 << 63)
EXACT = 2.0**53


def quantised(embedding: Column) -> Column:
    """floor(64 x) of each component; null for vectors that are null, empty or hold null or non-finite components."""
    good = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(embedding.isNotNull() & (F.size(embedding) > 0) & good, F.transform(embedding, lambda x: F.floor(x.cast("double") * 64)))


def products(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows; one beyond 64 bits becomes the nearest number of 64 bits above LEAST."""
    near = queries.astype(np.float64) @ vectors.astype(np.float64).T
    reach = np.abs(queries.astype(np.float64)).max(initial=0) * np.abs(vectors.astype(np.float64)).max(initial=0) * max(1, vectors.shape[1])
    if reach < EXACT:
        return near.astype(np.int64)
    with np.errstate(over="ignore"):
        out = queries @ vectors.T  # modulo 2^64: right wherever the result fits
    for i, j in np.argwhere(np.abs(near) + reach * vectors.shape[1] * 2.0**-50 >= 2.0**63).tolist():
        true = sum(a * b for a, b in zip(queries[i].tolist(), vectors[j].tolist(), strict=True))
        out[i, j] = max(LEAST + 1, min(-LEAST - 1, true))
    return out


def squares(x: np.ndarray) -> np.ndarray:
    return (x.astype(np.float64) ** 2).sum(1)


def slack(longest: float, size: int) -> float:
    """How far rounding may put a distance off."""
    return 1e-6 + (32 * max(1, size) * 2.0**-52 * longest) ** 0.5


def apart(queries: np.ndarray, own: np.ndarray, entries: np.ndarray, longest: float) -> np.ndarray:
    """Distances of queries to candidates, lifted to the same length; own: the queries' squares."""
    return np.sqrt(np.maximum(0, own[:, None] + longest - 2 * queries.astype(np.float64) @ entries.astype(np.float64).T))


def between(some: np.ndarray, other: np.ndarray, longest: float) -> np.ndarray:
    """Distances of candidates to one candidate."""
    lifts = np.sqrt(np.maximum(0, longest - squares(some)))
    lift = np.sqrt(np.maximum(0, longest - squares(other[None])))[0]
    return np.sqrt(((some.astype(np.float64) - other.astype(np.float64)) ** 2).sum(1) + (lifts - lift) ** 2)


class Page:
    """Entries in order of their distance to the page's routing vector."""

    def __init__(self, route: np.ndarray, ids: np.ndarray, vectors: np.ndarray, near: np.ndarray, parent: float):
        self.route, self.ids, self.vectors, self.near, self.parent, self.radius = route, ids, vectors, near, parent, float(near[-1])


def pages(ids: np.ndarray, vectors: np.ndarray, longest: float, parent: np.ndarray) -> list[Page]:
    """The pages of a group under its parent: routing entries are chosen far apart, and entries go to the nearest."""
    wanted, routes, near = max(1, -(-len(ids) // PAGE_ROWS)), [0], np.full(len(ids), np.inf)
    owner = np.zeros(len(ids), np.int64)
    while True:
        d = between(vectors, vectors[routes[-1]], longest)
        closer = d < near
        near[closer], owner[closer] = d[closer], len(routes) - 1
        if len(routes) == wanted or near.max() <= 0:
            break
        routes.append(int(near.argmax()))
    up, out = between(vectors[routes], parent, longest), []
    for i, route in enumerate(routes):
        own = np.flatnonzero(owner == i)
        own = own[np.lexsort((ids[own], near[own]))]
        for at in range(0, len(own), 2 * PAGE_ROWS):  # a page that many share is cut by distance
            part = own[at : at + 2 * PAGE_ROWS]
            out.append(Page(vectors[route], ids[part], vectors[part], near[part], float(up[i])))
    return out


class Search:
    """Best-first search of one group's pages, all queries in step; `computed` counts inner products with routes and entries."""

    def __init__(self, group: list[Page], parent: np.ndarray, longest: float, k: int):
        self.group, self.parent, self.longest, self.k, self.computed = group, parent, longest, k, 0

    def __call__(self, query_ids: np.ndarray, queries: np.ndarray, floors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Positions of queries, ids and scores of their k best candidates that reach the floors (LEAST: none yet)."""
        own, n, many, k = squares(queries), len(queries), len(self.group), self.k
        margin = slack(self.longest + own.max(initial=0), queries.shape[1])
        scores, best = np.full((n, k), LEAST, np.int64), np.zeros((n, k), np.int64)
        floor = floors.copy()

        def reach(at: np.ndarray) -> np.ndarray:
            far = np.sqrt(np.maximum(0, own[at] + self.longest - 2 * floor[at].astype(np.float64)))
            return np.where(floor[at] == LEAST, np.inf, far + margin)

        up = apart(queries, own, self.parent[None], self.longest)[:, 0]
        self.computed += n
        parents, radii = (np.array([getattr(p, c) for p in self.group]) for c in ("parent", "radius"))
        bound = np.maximum(0, np.abs(up[:, None] - parents) - radii - margin)  # by stored distances alone
        known, open_ = np.full((n, many), np.nan), np.ones((n, many), bool)
        active = np.arange(n)
        while len(active):
            first = np.where(open_[active], bound[active], np.inf).argmin(1)
            low = np.where(open_[active, first], bound[active, first], np.inf)
            stay = low <= reach(active)
            stay &= np.isfinite(low)
            active, first = active[stay], first[stay]
            for p in np.unique(first).tolist():
                at, page = active[first == p], self.group[p]
                new = at[np.isnan(known[at, p])]
                if len(new):  # its own distance first, which may send the page back in the order
                    known[new, p] = apart(queries[new], own[new], page.route[None], self.longest)[:, 0]
                    bound[new, p] = np.maximum(bound[new, p], known[new, p] - page.radius - margin)
                    self.computed += len(new)
                ready = at[~np.isin(at, new, assume_unique=True)] if len(new) else at
                if len(ready):
                    open_[ready, p] = False
                    self.look(page, ready, known[ready, p], reach, query_ids, queries, scores, best, floor)
        row, place = np.nonzero(scores > LEAST)
        return row, best[row, place], scores[row, place]

    def look(self, page: Page, at, distance, reach, query_ids, queries, scores, best, floor) -> None:
        """Multiplies queries with the ring of the page's entries that their bounds leave; queries of like distance share a ring."""
        order = np.argsort(distance, kind="stable")
        for i in range(0, len(order), TOGETHER):
            some, d = at[order[i : i + TOGETHER]], distance[order[i : i + TOGETHER]]
            limit = reach(some)
            low, high = np.searchsorted(page.near, (d - limit).min(), "left"), np.searchsorted(page.near, (d + limit).max(), "right")
            if low >= high:
                continue
            found = products(queries[some], page.vectors[low:high])
            self.computed += found.size
            found[(page.ids[low:high] == query_ids[some][:, None]) | (found < floor[some][:, None])] = LEAST
            both = np.concatenate((scores[some], found), axis=1)
            named = np.concatenate((best[some], np.broadcast_to(page.ids[low:high], found.shape)), axis=1)
            named[both == LEAST] = 0
            top = np.lexsort((named, ~both), axis=1)[:, : self.k]  # ~x falls as x rises, without overflow
            scores[some], best[some] = np.take_along_axis(both, top, 1), np.take_along_axis(named, top, 1)
            floor[some] = np.maximum(floor[some], scores[some, self.k - 1])


PAGE = "dim int, route long, salt long, page long, n int, parent double, routing binary, ids binary, vectors binary, near binary, head binary"
KEY = ["dim", "route", "salt"]


def _built(longest: dict[int, float], routing: dict[int, np.ndarray]):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        dim, route, salt = key
        vectors, parent = np.stack(rows["v"].to_numpy()).astype(np.int64), routing[dim][route]
        made = pages(rows["vec_id"].to_numpy(np.int64), vectors, longest[dim], parent)
        return pd.DataFrame([(dim, route, salt, i, len(p.ids), p.parent, p.route.tobytes(), p.ids.tobytes(), p.vectors.tobytes(), p.near.tobytes(), parent.tobytes()) for i, p in enumerate(made)], columns=[c.split()[0] for c in PAGE.split(", ")])
    return run


def _searched(k: int, longest: dict[int, float]):
    empty = {"query_id": [], "query_key": [], "vec_id": [], "score": []}

    def run(group: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(group) or not len(asked):
            return pd.DataFrame(empty).astype("int64")
        dim = int(group["dim"].iloc[0])
        made = [Page(np.frombuffer(r.routing, np.int64), np.frombuffer(r.ids, np.int64), np.frombuffer(r.vectors, np.int64).reshape(-1, dim), np.frombuffer(r.near, np.float64), r.parent) for r in group.itertuples()]
        search = Search(made, np.frombuffer(group["head"].iloc[0], np.int64), longest[dim], k)
        ids = asked["vec_id"].to_numpy(np.int64)
        row, found, scores = search(ids, np.stack(asked["v"].to_numpy()).astype(np.int64), asked["floor"].to_numpy(np.int64))
        return pd.DataFrame({"query_id": ids[row], "query_key": asked["query_key"].to_numpy()[row], "vec_id": found, "score": scores})
    return run


def top_k(rows: DataFrame, queries: DataFrame, k: int, routes: tuple[int, int] = ROUTES, group_rows: int = GROUP_ROWS, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: for each query its k highest integer inner products among all rows with another id.

    rows and queries have vec_id and v (array of long, or null). Rows without id or vector take no
    part; vectors of different lengths aren't compared. Ties go to the smaller vec_id. A repeated
    query counts once; repeated rows are candidates each. Of equal vectors only the k + 1 smallest
    ids can be answers, so the others aren't looked at. Components are 64-bit integers; a score
    beyond 64 bits counts as the nearest number of 64 bits. An empty table gives an empty result;
    other columns aren't read.

    The driver sees the routing vectors, `routes` of them for each length of vectors at most, and as
    many radii. A task holds one group (about `group_rows` rows) and one block of the queries whose
    bounds lead there; a group is copied only as often as such blocks come to it.
    """
    spark = rows.sparkSession
    own = rows.where("vec_id is not null and v is not null").select(F.col("vec_id").cast("long").alias("vec_id"), "v")
    copies = own.groupBy("vec_id", "v").agg(F.count("*").alias("copies"))
    able = copies.withColumn("place", F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))).where(F.col("place") <= k + 1)
    norm = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    kept = written(able.select("vec_id", "v", F.least(F.col("copies"), F.lit(k)).cast("int").alias("copies"), F.size("v").alias("dim"), norm.alias("norm")))
    sizes = kept.groupBy("dim").agg(F.max("norm").alias("m"), F.count("*").alias("n")).collect()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    if not sizes:
        return empty
    # sums of squares are rounded, so the common length is a little more than the longest
    longest = {r.dim: float(r.m) * (1 + 1e-12) + 1 for r in sizes}
    wanted = {r.dim: int(min(routes[1], max(routes[0], r.n // group_rows))) for r in sizes}
    chosen = F.row_number().over(Window.partitionBy("dim").orderBy(F.xxhash64("v"), "vec_id"))
    most = F.element_at(F.create_map(*[F.lit(x) for kv in wanted.items() for x in kv]), F.col("dim"))
    routing: dict[int, list] = {}
    for r in kept.withColumn("at", chosen).where((F.col("at") <= routes[1]) & (F.col("at") <= most)).select("dim", "v").distinct().collect():
        routing.setdefault(r.dim, []).append(r.v)
    top = {d: np.array(sorted(x), np.int64).reshape(-1, d) for d, x in routing.items()}
    sent = spark.sparkContext.broadcast((top, longest))  # bounded by `routes`

    def nearest(batches):
        top, longest = sent.value
        for some in batches:
            some = some.reset_index(drop=True)
            route, distance = np.zeros(len(some), np.int64), np.zeros(len(some))
            for d in some["dim"].unique().tolist():
                at = np.flatnonzero(some["dim"] == d)
                for i in range(0, len(at), 1024):
                    part = at[i : i + 1024]
                    x = np.stack(some["v"].to_numpy()[part]).astype(np.int64)
                    lift, lifts = (np.sqrt(np.maximum(0, longest[d] - squares(y))) for y in (x, top[d]))
                    near = squares(x)[:, None] + squares(top[d]) - 2 * x.astype(np.float64) @ top[d].astype(np.float64).T + (lift[:, None] - lifts) ** 2
                    route[part] = near.argmin(1)
                    for j in np.unique(route[part]).tolist():
                        own = part[route[part] == j]
                        distance[own] = between(x[route[part] == j], top[d][j], longest[d])
            yield pd.DataFrame({"vec_id": some["vec_id"], "v": some["v"], "copies": some["copies"], "dim": some["dim"], "route": route, "distance": distance})

    dealt = written(kept.mapInPandas(nearest, "vec_id long, v array<bigint>, copies int, dim int, route long, distance double"))
    tops = dealt.groupBy("dim", "route").agg(F.sum("copies").alias("n"), F.max("distance").alias("far")).collect()
    salts = spark.createDataFrame([(r.dim, r.route, -(-r.n // group_rows)) for r in tops], "dim int, route long, salts long")
    far = {(r.dim, r.route): r.far for r in tops}
    placed = dealt.join(F.broadcast(salts), ["dim", "route"]).withColumn("salt", F.pmod(F.xxhash64("vec_id", "v"), F.col("salts")))
    placed = placed.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    tree = written(placed.select(*KEY, "vec_id", "v").groupBy(*KEY).applyInPandas(_built(longest, top), PAGE))
    dropped(kept, dealt)

    asked = queries.where("vec_id is not null and v is not null").select(F.col("vec_id").cast("long").alias("vec_id"), "v").distinct()
    asked = written(asked.withColumns({"dim": F.size("v"), "query_key": F.xxhash64("v")}))

    def bounds(home: bool):
        def run(batches):
            """Each query with its nearest routing vector, or with those others that its floor leaves open."""
            top, longest = sent.value
            for some in batches:
                for d, part in some[some["dim"].isin(list(top))].groupby("dim"):
                    radii = np.array([far.get((d, j), -np.inf) for j in range(len(top[d]))])
                    for i in range(0, len(part), 1024):
                        rows = part.iloc[i : i + 1024]
                        x = np.stack(rows["v"].to_numpy()).astype(np.int64)
                        own = squares(x)
                        d_all = np.where(np.isfinite(radii), apart(x, own, top[d], longest[d]), np.inf)
                        first = d_all.argmin(1)
                        if home:
                            yield rows.assign(route=first, floor=LEAST)
                            continue
                        floor = rows["floor"].to_numpy(np.int64)
                        margin = slack(longest[d] + own.max(initial=0), d)
                        reach = np.where(floor == LEAST, np.inf, np.sqrt(np.maximum(0, own + longest[d] - 2 * floor.astype(np.float64))) + margin)
                        open_ = (d_all - radii - margin <= reach[:, None]) & np.isfinite(d_all)
                        open_[np.arange(len(rows)), first] = False
                        at, route = np.nonzero(open_)
                        yield rows.iloc[at].assign(route=route)
        return run

    schema = "vec_id long, v array<bigint>, dim int, query_key long, route long, floor long"

    def search(some: DataFrame) -> DataFrame:
        """Queries, dealt in blocks to the groups of their routes."""
        visits = some.groupBy("dim", "route").agg(F.ceil(F.count("*") / query_block).alias("blocks"))
        blocks = written(visits)
        to = some.join(blocks, ["dim", "route"]).withColumn("block", F.pmod(F.xxhash64("vec_id", "query_key"), F.col("blocks"))).join(F.broadcast(salts), ["dim", "route"])
        to = to.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1))).select(*KEY, "block", "vec_id", "query_key", "v", "floor")
        come = tree.join(blocks, ["dim", "route"]).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).drop("blocks")
        key = [*KEY, "block"]
        return come.groupBy(*key).cogroup(to.groupBy(*key)).applyInPandas(_searched(k, longest), "query_id long, query_key long, vec_id long, score long")

    least = Window.partitionBy("query_id", "query_key").orderBy(F.desc("score"), "vec_id")

    def best(found: DataFrame) -> DataFrame:
        return found.withColumn("rank", F.row_number().over(least)).where(F.col("rank") <= k)

    at_home = written(asked.mapInPandas(bounds(True), schema))
    home = written(best(search(at_home)))
    floors = home.where(F.col("rank") == k).select(F.col("query_id").alias("f_id"), F.col("query_key").alias("f_key"), F.col("score").alias("f_score"))
    ready = asked.join(floors, (F.col("vec_id") == F.col("f_id")) & (F.col("query_key") == F.col("f_key")), "left")
    ready = ready.select("vec_id", "v", "dim", "query_key", F.coalesce("f_score", F.lit(LEAST)).alias("floor"))
    others = written(ready.mapInPandas(bounds(False), schema))
    ranked = best(home.drop("rank").union(search(others)))
    return ranked.select("query_id", "rank", "vec_id", "score")


def op7_mtree_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", quantised(F.col("embedding")).alias("v"))
    return top_k(rows, rows.where("vec_id % 20 = 0"), 20)


#: Products are summed as 128-bit integers, so that they are exact for any components.
SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::HUGEINT) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, CAST(score AS BIGINT) AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
WHERE rank <= 20
"""
