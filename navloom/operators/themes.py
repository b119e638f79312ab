"""Share classes, theme clusters and what they hold."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from navloom import constants as K
from navloom.functions import scalars as X, stats as S
from navloom.operators.scale import numbered
from navloom.operators.similarity import block_sums, flat, similarity_edges
from navloom.session import cut_lineage

TASK_FUNDS = 8000  # a set of this many funds has a 512 MB distance matrix, the only one its task holds


# ---- share classes ------------------------------------------------------------------------

def dedup_share_classes(items: DataFrame, by: list[str]) -> DataFrame:
    """Marks share classes: same base name, and holdings that overlap with the group's lead.

    items: by + fund_code, name, sharpe_3y, stocks (array of the top stock codes). Adds lead
    and kept. In every round the first fund left of each name group is a lead and takes all
    funds that overlap with it; names that occur once need no round.
    """
    base = items.withColumn("base", X.base_name("name"))
    group = [*by, "base"]
    sizes = base.groupBy(*group).agg(F.count("*").alias("_n"))
    sized = base.join(sizes, group)
    assigned = sized.where(F.col("_n") == 1).withColumn("lead", F.col("fund_code")).select(*by, "fund_code", "lead")
    left = cut_lineage(sized.where(F.col("_n") > 1).select(*group, "fund_code", "stocks"))
    while not left.isEmpty():
        leads = left.groupBy(*group).agg(F.min_by(F.struct("fund_code", "stocks"), F.col("fund_code")).alias("_l"))
        tried = left.join(leads, group)
        small = F.least(F.size("stocks"), F.size("_l.stocks"))
        same = F.when(
            small > 0, F.size(F.array_intersect("stocks", F.col("_l.stocks"))) / small >= K.SHARE_CLASS_OVERLAP
        ).otherwise(F.size("stocks") == F.size("_l.stocks"))
        tried = cut_lineage(tried.withColumn("_same", same | (F.col("fund_code") == F.col("_l.fund_code"))))
        assigned = assigned.unionByName(tried.where("_same").select(*by, "fund_code", F.col("_l.fund_code").alias("lead")))
        left = tried.where(~F.col("_same")).select(*group, "fund_code", "stocks")
    joined = items.join(assigned, [*by, "fund_code"])
    rank = F.struct((-F.coalesce("sharpe_3y", F.lit(-1e9))).alias("s"), F.col("fund_code").alias("c"))
    best = joined.groupBy(*by, "lead").agg(F.min_by("fund_code", rank).alias("_best"))
    return joined.join(best, [*by, "lead"]).withColumn("kept", F.col("fund_code") == F.col("_best")).drop("_best")


def best_share(rows: DataFrame, by: list[str], score: str = "quality") -> DataFrame:
    """One fund per name without share letters: the best score, then the lower code."""
    rest = F.struct(*[c for c in rows.columns if c not in by])
    order = F.struct((-F.col(score)).alias("s"), F.col("fund_code").alias("c"))
    picked = rows.groupBy(*by, X.share_key("name").alias("_share")).agg(F.min_by(rest, order).alias("_r"))
    return picked.select(*by, "_r.*")


# ---- clustering --------------------------------------------------------------------------------

def target_clusters(n):
    return F.least(F.greatest(F.floor(n / 10), F.lit(K.CLUSTER_FLOOR)), F.lit(K.CLUSTER_CEIL)).cast("int")


def merge_labels(dist: np.ndarray, k: int) -> np.ndarray:
    """Ward groups of a distance matrix by the rounds of `clusters_by_rounds`; labels 1.. by first member."""
    return merged(np.square(dist.astype(float)), k)


def merged(d2: np.ndarray, k: int) -> np.ndarray:
    """Ward groups of a matrix of squared distances, which is used up.

    Every round merges all pairs that are nearest to each other, the lower place winning among equals; of all merges
    the n - k lowest stay, by height, round and places. A round looks anew only at groups whose nearest one changed,
    and the matrix shrinks once half of it is merged away.
    """
    n = len(d2)
    np.fill_diagonal(d2, np.inf)
    size, place, merges, round_ = np.ones(n), np.arange(n), [], 0
    live, nearest = np.ones(n, bool), d2.argmin(axis=1)
    while live.sum() > 1:
        here = np.flatnonzero(live)
        near = nearest[here]
        mutual = here[(here < near) & (nearest[near] == here)]
        pairs = [(int(i), int(nearest[i])) for i in mutual]
        merges += [(d2[i, j], round_, int(place[i]), int(place[j])) for i, j in pairs]
        for i, j in pairs:
            row = ((size[i] + size) * d2[i] + (size[j] + size) * d2[j] - size * d2[i, j]) / (size[i] + size[j] + size)
            row[[i, j]] = np.inf
            row[~live] = np.inf
            d2[i], d2[:, i] = row, row
            d2[j], d2[:, j] = np.inf, np.inf
            size[i] += size[j]
            live[j] = False
        round_ += 1
        if 2 * live.sum() <= len(live):
            here = np.flatnonzero(live)
            d2, size, place, live = d2[np.ix_(here, here)], size[here], place[here], np.ones(len(here), bool)
            nearest = d2.argmin(axis=1)
            continue
        gone = np.zeros(len(live), bool)
        gone[[x for pair in pairs for x in pair]] = True
        for x in np.flatnonzero(live & gone[nearest]):
            nearest[x] = d2[x].argmin()
        for i, _ in pairs:
            held = d2[np.arange(len(live)), nearest]
            closer = live & ((d2[i] < held) | ((d2[i] == held) & (i < nearest)))
            closer[i] = False
            nearest[closer] = i
    root = np.arange(n)
    for _, _, i, j in sorted(sorted(merges)[:n - min(max(k, 1), n)], key=lambda m: m[1]):
        root[root == j] = i
    return np.unique(root, return_inverse=True)[1] + 1


def theme_clusters(vectors: DataFrame, by: list[str], task_funds: int = TASK_FUNDS) -> DataFrame:
    """(by, fund_code, cluster_id) for every set of at least three funds.

    One way for all sizes: rounds that merge all pairs nearest to each other, equal distances going to the lower
    places. Sets of up to task_funds, whose matrix is bounded, run their rounds in one task; those of larger sets
    are joins.
    """
    sizes = vectors.groupBy(*by).agg(F.count("*").alias("_n")).where(F.col("_n") >= K.MIN_CLUSTER_FUNDS)
    sized = vectors.join(sizes, by)
    key_fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in vectors.select(*by).schema)

    def solve(key, rows):
        rows = rows.sort_by("pos")
        d2 = np.empty((len(rows), len(rows)))
        for a, b, stock, industry in block_sums(rows, rows, True):
            part = np.square(np.maximum(2.0 * (1.0 - (K.STOCK_SIM_WEIGHT * stock + K.INDUSTRY_SIM_WEIGHT * industry)), 0.0))
            d2[a:a + len(part), b:b + part.shape[1]] = part
            d2[b:b + part.shape[1], a:a + len(part)] = part.T
        labels = merged(d2, rows["k"][0].as_py()).astype("int32")
        return pa.table([*[pa.repeat(v, len(rows)) for v in key], rows["fund_code"], pa.array(labels)], [*by, "fund_code", "cluster_id"])

    small = (
        flat(sized.where(F.col("_n") <= task_funds)).withColumn("k", target_clusters(F.col("_n")))
        .groupBy(*by).applyInArrow(solve, f"{key_fields}, fund_code string, cluster_id int"))
    large = sized.where(F.col("_n") > task_funds)
    return small if large.isEmpty() else small.unionByName(clusters_by_rounds(large.drop("_n"), by))


def clusters_by_rounds(vectors: DataFrame, by: list[str]) -> DataFrame:
    """Ward clusters through joins, for sets of any size.

    With P the sum of squared distances inside a group and S the one between two groups, the
    Ward distance is 2ab/(a+b) * (S/(ab) - P_A/a^2 - P_B/b^2) for sizes a and b. Funds that
    share nothing are 2 apart, so S = 4ab - E with E summed over sharing pairs only: merging
    adds up rows of E. A group without E to another is nearest to the tightest group of some
    size, so two groups per size stand for all of them and no pair is ever made up.
    """
    nodes = cut_lineage(vectors.select(*by, F.col("pos").cast("bigint").alias("id"), "fund_code"))
    place = lambda end: nodes.select(*by, F.col("fund_code").alias(f"_{end}"), F.col("id").alias(end))
    found = similarity_edges(vectors, by).select(*by, F.col("i").alias("_a"), F.col("j").alias("_b"), (4 - F.pow("dist", 2)).alias("e"))
    upper = found.join(place("a"), [*by, "_a"]).join(place("b"), [*by, "_b"]).select(*by, "a", "b", "e")
    edges = cut_lineage(upper)  # a < b
    groups = nodes.select(*by, "id", F.lit(1.0).alias("n"), F.lit(0.0).alias("p"))
    tight = F.col("p") / (F.col("n") * F.col("n"))
    merges = []
    while True:
        both = edges.unionByName(edges.select(*by, F.col("b").alias("a"), F.col("a").alias("b"), "e"))
        tightest = Window.partitionBy(*by, "n").orderBy(tight.desc(), "id")
        stand_ins = groups.withColumn("_r", F.row_number().over(tightest)).where(F.col("_r") <= 2).select(
            *by, F.col("id").alias("b"), F.col("n").alias("nb"), F.col("p").alias("pb"), F.lit(0.0).alias("e"))
        left = groups.select(*by, F.col("id").alias("a"), F.col("n").alias("na"), F.col("p").alias("pa"))
        right = groups.select(*by, F.col("id").alias("b"), F.col("n").alias("nb"), F.col("p").alias("pb"))
        apart = left.join(stand_ins, by).where(F.col("a") != F.col("b"))
        near = left.join(both, [*by, "a"]).join(right, [*by, "b"]).unionByName(apart)
        ab = F.col("na") * F.col("nb")
        d2 = 2 * ab / (F.col("na") + F.col("nb")) * (
            4 - F.col("e") / ab - (F.col("pa") / (F.col("na") * F.col("na")) + F.col("pb") / (F.col("nb") * F.col("nb"))))
        order = F.struct(d2.alias("h"), F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"), "b", "e")
        best = near.groupBy(*by, "a").agg(F.min(order).alias("m")).select(*by, "a", "m.b", "m.h")
        back = best.select(*by, F.col("a").alias("b"), F.col("b").alias("a"))
        # a stand-in may be a neighbour whose own row gave the smaller distance; its E is looked up
        pairs = best.join(back, [*by, "a", "b"]).where(F.col("a") < F.col("b")).join(edges, [*by, "a", "b"], "left")
        pairs = cut_lineage(pairs.withColumn("e", F.coalesce("e", F.lit(0.0))))
        if pairs.isEmpty():
            break
        merges.append(pairs)
        moved = pairs.select(*by, F.col("b").alias("id"), F.col("a").alias("to"))
        gained = pairs.select(*by, F.col("a").alias("id"), F.col("e").alias("_e"))
        joined = groups.join(moved, [*by, "id"], "left").withColumn("id", F.coalesce("to", "id")).groupBy(*by, "id").agg(
            F.sum("n").alias("n"), F.sum("p").alias("p"), F.product("n").alias("_ab"))
        groups = cut_lineage(joined.join(gained, [*by, "id"], "left").select(
            *by, "id", "n", F.when(F.col("_e").isNotNull(), F.col("p") + 4 * F.col("_ab") - F.col("_e")).otherwise(F.col("p")).alias("p")))
        hop = lambda end: moved.select(*by, F.col("id").alias(end), F.col("to").alias(f"_{end}"))
        edges = cut_lineage(
            edges.join(hop("a"), [*by, "a"], "left").join(hop("b"), [*by, "b"], "left")
            .select(*by, F.coalesce("_a", "a").alias("x"), F.coalesce("_b", "b").alias("y"), "e").where(F.col("x") != F.col("y"))
            .groupBy(*by, F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.sum("e").alias("e")))
    if not merges:  # no set at all: one of two funds or more has a pair of nearest neighbours
        return nodes.select(*by, "fund_code", F.lit(1).alias("cluster_id"))
    steps = None
    for n, m in enumerate(merges):
        one = m.select(*by, "a", "b", "h", F.lit(n).alias("round"))
        steps = one if steps is None else steps.unionByName(one)
    counts = nodes.groupBy(*by).agg(F.count("*").alias("n"))
    counts = counts.withColumn("keep", F.col("n") - F.least(target_clusters(F.col("n")).cast("bigint"), F.col("n")))
    # a set has n - 1 merges; its lowest n - k are kept
    steps = steps.withColumn("_band", F.floor(F.col("h") * 16))
    ranked = numbered(steps, by, "_band", [F.col("h"), F.col("round"), F.col("a"), F.col("b")], "_r")
    kept = cut_lineage(ranked.join(counts, by).where(F.col("_r") <= F.col("keep")))
    labels = nodes.withColumn("root", F.col("id"))
    for n in range(len(merges)):
        up = kept.where(F.col("round") == n).select(*by, F.col("b").alias("root"), F.col("a").alias("_up"))
        labels = labels.join(up, [*by, "root"], "left").withColumn("root", F.coalesce("_up", "root")).drop("_up")
    labels = cut_lineage(labels)
    # at most 40 roots per set
    ids = labels.select(*by, "root").distinct().withColumn("cluster_id", F.row_number().over(Window.partitionBy(*by).orderBy("root")))
    return labels.join(ids, [*by, "root"]).select(*by, "fund_code", F.col("cluster_id").cast("int").alias("cluster_id"))


# ---- what the clusters hold -----------------------------------------------------------------------

def _top(df: DataFrame, part: list[str], order: list, k: int) -> DataFrame:
    w = Window.partitionBy(*part).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _with_cluster(rows: DataFrame, clusters: DataFrame, by: list[str]) -> DataFrame:
    return rows.join(clusters.select(*by, "fund_code", "cluster_id"), [*by, "fund_code"])


def cluster_sizes(clusters: DataFrame, by: list[str]) -> DataFrame:
    return clusters.groupBy(*by, "cluster_id").agg(F.count("*").alias("fund_count"))


def top_industries(industries: DataFrame, clusters: DataFrame, by: list[str], k: int = K.TOP_INDUSTRIES) -> DataFrame:
    """Industries with the largest mean share in a cluster, funds without it counting as 0."""
    sums = _with_cluster(industries, clusters, by).groupBy(*by, "cluster_id", "key").agg(F.sum("ratio").alias("_s"))
    mean = sums.join(cluster_sizes(clusters, by), [*by, "cluster_id"]).withColumn("mean_ratio", F.col("_s") / F.col("fund_count"))
    return _top(mean.where(F.col("mean_ratio") > 0), [*by, "cluster_id"], [F.desc("mean_ratio"), "key"], k).drop("_s")


def cluster_stocks(stocks: DataFrame, clusters: DataFrame, by: list[str]) -> DataFrame:
    """Per cluster and stock: mean share, the pool's mean share, the edge over it, holders."""
    rows = _with_cluster(stocks, clusters, by)
    pool_size = clusters.groupBy(*by).agg(F.count("*").alias("_pool"))
    pool = rows.groupBy(*by, "key").agg(F.sum("ratio").alias("_all")).join(pool_size, by)
    inside = rows.groupBy(*by, "cluster_id", "key").agg(F.sum("ratio").alias("_in"), F.count_if(F.col("ratio") > 0).alias("overlap"))
    out = inside.join(cluster_sizes(clusters, by), [*by, "cluster_id"]).join(pool, [*by, "key"])
    return out.select(*by, "cluster_id", "key", "overlap", (F.col("_in") / F.col("fund_count") - F.col("_all") / F.col("_pool")).alias("edge"))


def signature_stocks(table: DataFrame, by: list[str], k: int = K.SIGNATURE_STOCKS) -> DataFrame:
    return _top(table.where(F.col("edge") > 0), [*by, "cluster_id"], [F.desc("edge"), "key"], k)


def secondary_stocks(table: DataFrame, signature: DataFrame, by: list[str], k: int = K.SECONDARY_STOCKS) -> DataFrame:
    shared = table.where(F.col("overlap") >= K.MIN_OVERLAP_FUNDS)
    rest = shared.join(signature.select(*by, "cluster_id", "key"), [*by, "cluster_id", "key"], "left_anti")
    return _top(rest, [*by, "cluster_id"], [F.desc("overlap"), "key"], k)


def capital_exposure(holdings: DataFrame, clusters: DataFrame, by: list[str], k: int = K.CAPITAL_STOCKS) -> DataFrame:
    """Money per stock in a cluster, its share of the cluster's money, holders."""
    rows = _with_cluster(holdings, clusters, by)
    sums = rows.groupBy(*by, "cluster_id", "asset_code").agg(
        F.sum(F.coalesce("hold_market_value", F.lit(0.0))).alias("mv"), F.count("*").alias("overlap"))
    total = sums.groupBy(*by, "cluster_id").agg(F.sum("mv").alias("total"))
    both = sums.join(total, [*by, "cluster_id"])
    pct = F.when(F.col("total") != 0, F.col("mv") / F.col("total") * 100).otherwise(0.0)
    ranked = _top(both.withColumn("mv_pct", pct), [*by, "cluster_id"], [F.desc("mv"), "asset_code"], k)
    return ranked.withColumn("mv_yi", F.col("mv") / 1e4).withColumn("total_yi", F.col("total") / 1e4)


def composite_scores(metrics: DataFrame, by: list[str], as_of: str) -> DataFrame:
    """Score of every fund against its pool."""
    scale = F.when(F.col("scale") > 0, F.log("scale"))
    age = X.age_years("establish_date", F.lit(as_of).cast("date"))
    rows = metrics.withColumn("log_scale", scale).withColumn("age_years", age)
    z = S.robust_z(rows, by, list(K.COMPOSITE_WEIGHTS))
    return z.withColumn("score", S.weighted_z(K.COMPOSITE_WEIGHTS))


def assemble(clusters: DataFrame, top: DataFrame, scores: DataFrame, by: list[str], others: DataFrame | None = None) -> DataFrame:
    """Cluster members with theme name, score and rank in the cluster; `others` form cluster 0."""
    names = top.groupBy(*by, "cluster_id").agg(F.concat_ws(
        " / ", F.transform(F.array_sort(F.collect_list(F.struct("rank", "key"))), lambda s: s["key"])).alias("theme"))
    rows = clusters.select(*by, "fund_code", "cluster_id").join(names, [*by, "cluster_id"], "left").withColumn(
        "theme", F.coalesce("theme", F.lit("未分类")))
    if others is not None:
        rows = rows.unionByName(others.select(
            *by, "fund_code", F.lit(0).alias("cluster_id"), F.lit("其他（无股票持仓，未参与聚类）").alias("theme")))
    scored = rows.join(scores.select(*by, "fund_code", "score"), [*by, "fund_code"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    sizes = scored.groupBy(*by, "cluster_id").agg(F.count("*").alias("fund_count"))
    scored = scored.withColumn("_band", F.floor(-F.col("score") * 100))
    return numbered(scored.join(sizes, [*by, "cluster_id"]), [*by, "cluster_id"], "_band",
                    [F.desc("score"), F.col("fund_code")], "cluster_rank").drop("_band")


# ---- held funds to clusters ------------------------------------------------------------------------

def classify(held: DataFrame, members: DataFrame, cluster_vectors: DataFrame, fund_vecs: DataFrame) -> DataFrame:
    """Cluster of each held fund: by code, else by base name, else by the most similar industries.

    held: fund_code, name; members: fund_code, name, cluster_id; vectors: label, ratio. A
    cluster vector has at most three labels, so a fund meets a bounded number of them.
    """
    by_code = members.groupBy("fund_code").agg(F.min("cluster_id").alias("_by_code"))
    by_name = members.select(X.base_name("name").alias("_base"), "cluster_id").where(F.col("_base") != "").groupBy("_base").agg(
        F.min("cluster_id").alias("_by_name"))

    def shares(df, key):
        total = df.groupBy(key).agg(F.sum("ratio").alias("_t"))
        return df.join(total, key).where(F.col("_t") > 0).select(key, "label", (F.col("ratio") / F.col("_t")).alias("v"))

    mine, theirs = shares(fund_vecs, "fund_code"), shares(cluster_vectors, "cluster_id").withColumnRenamed("v", "w")
    sims = mine.join(theirs, "label").groupBy("fund_code", "cluster_id").agg(F.sum(F.least("v", "w")).alias("sim"))
    best = sims.groupBy("fund_code").agg(F.max_by(F.struct("cluster_id", "sim"), F.struct("sim", (-F.col("cluster_id")).alias("c"))).alias("_b"))
    have = fund_vecs.select("fund_code").distinct().withColumn("_have", F.lit(True))
    rows = (
        held.withColumn("_base", X.base_name("name")).join(by_code, "fund_code", "left").join(by_name, "_base", "left")
        .join(best, "fund_code", "left").join(have, "fund_code", "left"))
    sim = F.coalesce("_b.sim", F.lit(0.0))
    match = (
        F.when(F.col("_by_code").isNotNull(), "exact").when(F.col("_by_name").isNotNull(), "name")
        .when(F.col("_have").isNull(), "no_data").when(sim >= K.SIM_THRESHOLD, "similar").otherwise("outside"))
    return rows.withColumn("match", match).withColumn(
        "cluster_id", F.coalesce("_by_code", "_by_name", F.when(F.col("match") == "similar", F.col("_b.cluster_id")))
    ).withColumn("sim", F.when(F.col("match").isin("exact", "name"), 1.0).when(F.col("match") == "no_data", 0.0).otherwise(sim)) \
        .drop("_base", "_by_code", "_by_name", "_b", "_have")


def target_of(held: DataFrame, targets: DataFrame) -> DataFrame:
    """Held fund to target map by code, else by base name."""
    codes = targets.groupBy("fund_code").agg(F.min("target_id").alias("_code"))
    names = targets.select(X.base_name("name").alias("_base"), "target_id").where(F.col("_base") != "").groupBy("_base").agg(
        F.min("target_id").alias("_name"))
    return held.withColumn("_base", X.base_name("name")).join(codes, "fund_code", "left").join(names, "_base", "left").withColumn(
        "target_id", F.coalesce("_code", "_name")).drop("_code", "_name", "_base")
