"""Clustering of series by their adjacency rows: PCA projection, density
clustering (DBSCAN semantics) and the cluster -> members listing.

Input is the long adjacency ``(series_a, series_b, adj)`` produced by
``xcorr.adjacency``: each series is a point whose coordinates are its 0/1
adjacency row (columns ordered by series name).  Points are series, so the
number of points is the number of measured series, not the data volume.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lagscope.session import checkpoint_dir


#: Vectors beside the wanted ones; a residual this small against the largest
#: variance ends the projection, one this small against all ones is rounding.
SPARE, CLOSE, ROUNDING = 4, 1e-10, 1e-14

#: Rounds without a smaller residual after which rounding is taken to decide.
PATIENCE = 12


def pca_projection(adj: DataFrame, k: int = 2) -> DataFrame:
    """Project the (column-centred) adjacency rows on their first ``k``
    principal components: ``(series, pc1..pck)``.  Component signs are
    arbitrary; components beyond the rank of the rows are 0.  Pairs that
    ``adj`` lacks count as 0.

    The rows stay an edge table.  With A the adjacency and C the centring, the
    projections are the leading eigenvectors of C A A' C, times the roots of
    their eigenvalues; a product with that matrix is two joins of the edges with
    a table of a few numbers per series.  A subspace of ``k`` + 4 vectors is
    iterated: each round applies the matrix to the residuals, and takes the best
    vectors within the span of vectors, residuals and last steps, whose small
    matrices of inner products are all that the driver sees.  Every round is
    checkpointed.  It ends when the residuals of the first ``k`` are 1e-10 of
    the largest eigenvalue, or when rounding keeps them from shrinking."""
    checkpoint_dir(adj.sparkSession)
    adj = adj.select("series_a", "series_b", F.col("adj").cast("double").alias("v")).checkpoint()
    links = adj.where("v <> 0").checkpoint()
    # equal rows give equal results: the start is a hash of the name
    names = adj.select(F.col("series_a").alias("series")).distinct()
    seeds = [F.xxhash64("series", F.lit(c)) / F.lit(2.0 ** 63) for c in range(k + SPARE)]
    start = names.select("series", *[s.alias(f"s{c}") for c, s in enumerate(seeds)]).checkpoint()
    mean = start.agg(*[F.avg(f"s{c}") for c in range(len(seeds))]).first()
    ones = links.agg(F.sum(F.col("v") * F.col("v"))).first()[0] or 0.0
    if mean[0] is None or not ones:
        return names.select("series", *[F.lit(0.0).alias(f"pc{c + 1}") for c in range(k)])
    fresh = start.select("series", *[(F.col(f"s{c}") - m).alias(f"s{c}") for c, m in enumerate(mean)])
    # columns s: the span.  Its first ``old`` are the vectors, then come their last steps
    # up to ``held``, which have their products m already, then the residuals
    old, held, span, best, stale = 0, 0, len(seeds), None, 0
    while True:
        block = [f"s{c}" for c in range(held, span)]
        step = _times(fresh, links, block, [f"m{c}" for c in range(held, span)]).checkpoint()
        gram, products, shift = _inner(step, span)
        values, coef = _best_vectors(gram, products, k + SPARE)
        found = len(values)
        # vectors x, their products y, and the last step: the part of x outside the old vectors
        last = coef.copy()
        last[:old] = 0.0
        size = np.sqrt(np.maximum(np.einsum("ic,ij,jc->c", last, gram, last), 0.0))
        last = last[:, size > 1e-12] / size[size > 1e-12] if held else last[:, :0]
        s, m = [F.col(f"s{c}") for c in range(span)], [F.col(f"m{c}") - float(v) for c, v in enumerate(shift)]
        x, y = _combined(s, coef), _combined(m, coef)
        off = [b - float(v) * a for a, b, v in zip(x, y, values)]
        sizes = np.array(step.agg(*[F.sum(o * o) for o in off], *[F.avg(o) for o in off]).first(), dtype=float)
        far, middle = np.sqrt(sizes[:found]), sizes[found:]
        worst = far[:k].max()
        stale = stale + 1
        if best is None or worst < best:
            roots = [float(np.sqrt(max(v, 0.0))) for v in values[:k]]
            result = step.select("series", *[(x[c] * roots[c] if c < found else F.lit(0.0)).alias(f"pc{c + 1}")
                                             for c in range(k)])
            best, stale = worst, 0
        if worst <= max(CLOSE * values[0], ROUNDING * ones) or stale >= PATIENCE:
            return result
        # rounding has the say in residuals that small: they give no new direction.  The
        # others are centred again, as their division would make a mean of rounding grow
        new = [(o - float(c)) / float(f) for o, f, c in zip(off, far, middle) if f > ROUNDING * ones]
        p, q = _combined(s, last), _combined(m, last)
        old, held, span = found, found + len(p), found + len(p) + len(new)
        fresh = step.select("series", *[e.alias(f"s{c}") for c, e in enumerate([*x, *p, *new])],
                            *[e.alias(f"m{c}") for c, e in enumerate([*y, *q])])


def _times(vectors: DataFrame, links: DataFrame, cols: list[str], out: list[str]) -> DataFrame:
    """``vectors`` with A A' of its columns ``cols`` as columns ``out``."""
    at = vectors.select(F.col("series").alias("series_a"), *cols)
    across = (links.join(at, "series_a").groupBy("series_b")
              .agg(*[F.sum(F.col("v") * F.col(c)).alias(c) for c in cols]))
    back = (links.join(across, "series_b").groupBy(F.col("series_a").alias("_s"))
            .agg(*[F.sum(F.col("v") * F.col(c)).alias(o) for c, o in zip(cols, out)]))
    both = vectors.join(back, F.col("series") == F.col("_s"), "left")
    return both.select(*vectors.columns, *[F.coalesce(o, F.lit(0.0)).alias(o) for o in out])


def _inner(step: DataFrame, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Inner products of the columns s with each other and with the columns m,
    and the means of the latter: one row per column s comes to the driver."""
    s, m = [f"s{c}" for c in range(span)], [f"m{c}" for c in range(span)]
    rows = (step.select(*s, *m, F.posexplode(F.array(*s)).alias("i", "a")).groupBy("i")
            .agg(*[F.sum(F.col("a") * F.col(c)) for c in [*s, *m]], *[F.avg(c) for c in m]).orderBy("i").collect())
    cells = np.array([r[1:] for r in rows], dtype=float)
    return cells[:, :span], cells[:, span:2 * span], cells[0, 2 * span:]


def _best_vectors(gram: np.ndarray, products: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues within a span and the coefficients of their
    orthonormal vectors; directions that the span has only by rounding go."""
    scale = np.sqrt(np.maximum(np.diag(gram), 1e-300))
    weight, basis = np.linalg.eigh(gram / scale[:, None] / scale[None, :])
    kept = weight > 1e-12 * weight[-1]
    basis = basis[:, kept] / np.sqrt(weight[kept]) / scale[:, None]
    inside = basis.T @ (products + products.T) @ basis / 2
    values, turn = np.linalg.eigh(inside)
    order = np.argsort(-values)[:most]
    return values[order], basis @ turn[:, order]


def _combined(cols: list[Column], coef: np.ndarray) -> list[Column]:
    """Linear combinations of columns, one per column of ``coef``."""
    return [sum((c * float(w) for c, w in zip(cols[1:], ws[1:])), cols[0] * float(ws[0])) for ws in coef.T]


#: Points of a column's prefix list that one task compares with all others.
TILE = 1000


def sparse_rows(adj: DataFrame) -> DataFrame:
    """``(series, ones, size)``: the columns in which a series' adjacency row
    is 1, the rarest column first (ties by name), and how many there are."""
    links = adj.where(F.col("adj") == 1).select("series_a", "series_b")
    often = links.groupBy("series_b").agg(F.count(F.lit(1)).alias("f"))
    ones = (links.join(often, "series_b").groupBy("series_a")
            .agg(F.array_sort(F.collect_list(F.struct("f", "series_b"))).alias("c"))
            .select(F.col("series_a").alias("_s"), F.transform("c", lambda x: x["series_b"]).alias("ones")))
    series = adj.select(F.col("series_a").alias("series")).distinct().join(ones, F.col("series") == F.col("_s"), "left")
    return series.select("series", F.coalesce("ones", F.array().cast("array<string>")).alias("ones")).withColumn(
        "size", F.size("ones"))


def _candidates(points: DataFrame, radius: int) -> DataFrame:
    """Pairs (i, j), i < j, of points (i, ones, size) that may differ in at
    most ``radius`` columns although their sizes sum to more, each once.

    The columns before the first one that two rows share belong to one of them
    only, so rows that differ in at most h columns share one of the first h + 1
    of either, and their sizes differ by at most h.  They meet on the first
    column that their prefixes share.  A column that is in many prefixes is
    dealt to several tasks by a salt."""
    pre = points.select("i", "size", F.slice("ones", 1, radius + 1).alias("prefix")).select(
        "*", F.explode("prefix").alias("one"))
    tiles = pre.groupBy("one").agg(F.ceil(F.count(F.lit(1)) / TILE).alias("tiles"))
    pre = pre.join(tiles, "one")
    a = pre.select(F.col("one"), F.pmod(F.xxhash64("i"), "tiles").alias("tile"), "i", F.col("size").alias("si"),
                   F.col("prefix").alias("pi"))
    b = pre.select(F.col("one"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("tiles") - 1)).alias("tile"),
                   F.col("i").alias("j"), F.col("size").alias("sj"), F.col("prefix").alias("pj"))
    near = (F.col("i") < F.col("j")) & (F.abs(F.col("si") - F.col("sj")) <= radius) & (F.col("si") + F.col("sj") > radius)
    first = F.element_at(F.array_intersect("pi", "pj"), 1)
    return a.join(b, ["one", "tile"]).where(near).where(first == F.col("one")).select("i", "j", "si", "sj")


def _neighbour_pairs(points: DataFrame, radius: int) -> DataFrame:
    """All ordered pairs (i, j) of points that differ in at most ``radius``
    columns, but for those whose sizes sum to no more than that (they are near
    whatever their columns are; ``density_clusters`` counts them by size):
    |a xor b| = |a| + |b| - 2 |a and b| of every candidate."""
    pa = points.select("i", F.col("ones").alias("oi"))
    pb = points.select(F.col("i").alias("j"), F.col("ones").alias("oj"))
    apart = F.col("si") + F.col("sj") - 2 * F.size(F.array_intersect("oi", "oj"))
    found = _candidates(points, radius).join(pa, "i").join(pb, "j").where(apart <= radius).select("i", "j")
    return found.unionByName(found.select(F.col("j").alias("i"), F.col("i").alias("j")))


def connected_labels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(i, label)``: the smallest node of each node's connected component.

    Alternating large-star and small-star steps (Kiveris et al. 2014): each
    links a node's neighbours to the smallest node it sees, so paths shrink by
    a constant factor per round and the rounds grow with the logarithm of the
    longest path.  They go on until a round changes no link; links are
    checkpointed each round to the session's checkpoint folder.
    ``edges``: ``(i, j)`` in any direction, repeats allowed."""
    checkpoint_dir(nodes.sparkSession)
    links = (edges.where("i <> j").select(F.greatest("i", "j").alias("u"), F.least("i", "j").alias("v"))
             .distinct().checkpoint())
    before = None
    while True:
        # large star: a node's larger neighbours hang on the smallest of all
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        links = both.join(least, "u").where("v > u").selectExpr("v AS u", "m AS v").where("u > v").distinct()
        # small star: a node and its smaller neighbours hang on the smallest
        least = links.groupBy("u").agg(F.min("v").alias("m"))
        links = (links.join(least, "u").selectExpr("v AS u", "m AS v").union(least.selectExpr("u", "m AS v"))
                 .where("u > v").distinct().checkpoint())
        now = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return (nodes.join(links, nodes.i == links.u, "left")
            .select(nodes.i, F.coalesce("v", nodes.i).alias("label")))


def density_clusters(adj: DataFrame, eps: float = 2.3, min_samples: int = 5) -> DataFrame:
    """DBSCAN over the adjacency rows: ``(series, cluster)`` with -1 = noise.

    * rows are sparse (the columns that are 1); series with equal rows are one
      weighted point from the start;
    * neighbours within ``eps`` (the point itself counts toward
      ``min_samples``, as in the usual definition).  The squared distance of
      0/1 rows is the number h of columns in which they differ: pairs are found
      by a set-difference join.  Rows whose sizes sum to at most h are near
      whatever they hold.  These pairs are never made: points count them by
      size, and all cores among them hang on one hub, the smallest;
    * core points are joined into clusters by the connected components of the
      core-core links;
    * clusters are numbered in order of their first core point by name, and a
      border point takes the lowest-numbered cluster among its core
      neighbours -- the order a sequential scan over the points assigns.
    """
    spark: SparkSession = adj.sparkSession
    checkpoint_dir(spark)
    radius = int(eps * eps + 1e-9)
    series = sparse_rows(adj.checkpoint()).checkpoint()
    points = (series.groupBy("ones").agg(F.min("series").alias("i"), F.count(F.lit(1)).alias("w"))
              .withColumn("size", F.size("ones")).checkpoint())
    edges = _neighbour_pairs(points, radius).checkpoint()

    def by_size(values: dict[int, int], fold) -> Column:
        """Per point the fold of the values of all sizes that are near its own
        (a literal table of at most h + 1 entries); null for larger points."""
        table, so_far = [], None
        for u in range(radius + 1):
            v = values.get(u)
            so_far = v if so_far is None else so_far if v is None else fold(so_far, v)
            table.append(F.lit(so_far).cast("bigint"))
        return F.when(F.col("size") <= radius, F.element_at(F.array(*table), F.lit(radius + 1) - F.col("size")))

    # points of the small sizes, at most h + 1 rows
    small = {r["size"]: r["w"] for r in points.where(F.col("size") <= radius).groupBy("size").agg(F.sum("w").alias("w")).collect()}
    weight = points.select(F.col("i").alias("j"), F.col("w").alias("wj"))
    degree = edges.join(weight, "j").groupBy("i").agg(F.sum("wj").alias("deg"))
    # a point near to itself by size is in that sum already
    own = F.when(F.col("size") * 2 <= radius, F.lit(0)).otherwise(F.col("w"))
    total = F.coalesce(by_size(small, lambda x, y: x + y), F.lit(0)) + F.coalesce("deg", F.lit(0)) + own
    core = points.join(degree, "i", "left").where(total >= min_samples).select("i", "size").checkpoint()
    names = core.select("i")
    links = edges.join(names, "i").join(names.withColumnRenamed("i", "j"), "j").select("i", "j")
    hub = core.orderBy("size", "i").first()
    if hub is not None:
        links = links.unionByName(core.where(F.col("size") + hub["size"] <= radius).select("i", F.lit(hub["i"]).alias("j")))
    labels = connected_labels(names, links).checkpoint()
    # number clusters by their seed (the first core by name)
    seeds = labels.select("label").distinct().withColumn(
        "cluster", F.dense_rank().over(Window.orderBy("label")) - 1)
    core_cluster = labels.join(seeds, "label").select("i", "cluster").checkpoint()
    least = {r["size"]: r["c"] for r in core.where(F.col("size") <= radius).join(core_cluster, "i")
             .groupBy("size").agg(F.min("cluster").alias("c")).collect()}
    border = (edges.join(core_cluster.withColumnRenamed("i", "j"), "j")
              .groupBy("i").agg(F.min("cluster").alias("bcluster")))
    of_point = points.join(core_cluster, "i", "left").join(border, "i", "left").select(
        F.col("ones").alias("_ones"),
        F.coalesce(F.col("cluster").cast("bigint"), F.least("bcluster", by_size(least, min)), F.lit(-1)).cast("int").alias("cluster"))
    return series.join(of_point, F.col("ones") == F.col("_ones")).select("series", "cluster")


def cluster_members(clusters: DataFrame) -> DataFrame:
    """``(cluster, members array<string>)``, members sorted by name."""
    return clusters.groupBy("cluster").agg(F.array_sort(F.collect_list("series")).alias("members"))
