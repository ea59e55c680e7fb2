"""Folds, balance, and nested selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def group_folds(components: DataFrame, n: int = 5) -> DataFrame:
    """(node, fold): whole components in one fold, by the component's hash-free remainder."""
    return components.select("node", "component", (F.col("component") % n).alias("fold"))


def rare_strata(rows: DataFrame, stratum: str, answer: str, least: int = 5) -> DataFrame:
    """Strata under least rows become answer|rare; if any is still under least, all rows fall back to answer."""
    n = F.count("*").over(W.partitionBy(stratum))
    x = rows.withColumn("_s", F.when(n < least, F.concat(F.col(answer), F.lit("|rare"))).otherwise(F.col(stratum)))
    low = x.groupBy("_s").agg(F.count("*").alias("c")).agg(F.min("c").alias("low"))
    x = x.crossJoin(F.broadcast(low))
    return x.withColumn("stratum", F.when(F.col("low") < least, F.col(answer)).otherwise(F.col("_s"))).drop("_s", "low")


def balance(rows: DataFrame, category: str, fold: str = "fold") -> DataFrame:
    """(fold, max_dev): the largest deviation of a category's share in a fold from its share in all."""
    per = rows.groupBy(fold, category).agg(F.count("*").alias("c"))
    folds = per.groupBy(fold).agg(F.sum("c").alias("nf"))
    every = per.groupBy(category).agg(F.sum("c").alias("ca")).withColumn("n", F.sum("ca").over(W.partitionBy()))
    grid = folds.crossJoin(F.broadcast(every)).join(per, [fold, category], "left")
    return grid.groupBy(fold).agg(F.max(F.abs(F.coalesce("c", F.lit(0)) / F.col("nf") - F.col("ca") / F.col("n"))).alias("max_dev"))


def leave_one_fold_out(scores: DataFrame, config: str = "w", penalty: float = 0.35) -> DataFrame:
    """scores (config, fold, recall, n): per held fold the config of best mean less penalty deviations over the other
    folds, then best mean, then nearest 0.5; with its recall on the held fold."""
    held = scores.select(F.col("fold").alias("held")).distinct()
    rest = scores.join(F.broadcast(held), F.col("fold") != F.col("held"))
    per = rest.groupBy("held", config).agg(F.avg("recall").alias("m"), F.stddev_pop("recall").alias("s")).withColumn("robust", F.round(F.col("m") - penalty * F.col("s"), 9))
    w = W.partitionBy("held").orderBy(F.desc("robust"), F.desc(F.round("m", 9)), F.abs(F.col(config) - 0.5), config)
    best = per.withColumn("nth", F.row_number().over(w)).where("nth = 1").select(F.col("held").alias("fold"), config, "robust")
    return best.join(scores, ["fold", config]).select(F.col("fold").alias("held"), config, "robust", "recall", "n")


def _hashed(c: Column, n: int) -> Column:
    return F.conv(F.substring(F.md5(c), 1, 8), 16, 10).cast("long") % n


def seed_scan(rows: DataFrame, component: str, weights: dict[str, float], n: int = 5, seeds: int = 512, size_weight: float = 12.0) -> DataFrame:
    """(seed, size_dev, objective, chosen): whole components dealt into n folds by a hash of component and seed, and how
    far the folds stray from equal size and from each weighted category's shares; chosen is the first least objective.
    Rows are counted by component and value before the seeds multiply them."""
    parts = F.array(F.struct(F.lit("").alias("cat"), F.lit("").alias("value")), *(F.struct(F.lit(k).alias("cat"), F.col(k).cast("string").alias("value")) for k in weights))
    counts = rows.select(F.col(component).cast("string").alias("_c"), F.explode(parts).alias("p")).groupBy("_c", "p.cat", "p.value").agg(F.count("*").alias("m"))
    grid = counts.crossJoin(F.broadcast(rows.sparkSession.range(seeds).withColumnRenamed("id", "seed")))  # seeds is a parameter
    grid = grid.withColumn("_f", _hashed(F.concat_ws(":", "_c", F.col("seed").cast("string")), n))
    per = grid.groupBy("seed", "cat", "value").agg(F.sum("m").alias("all"), *(F.sum(F.when(F.col("_f") == f, F.col("m")).otherwise(0)).alias(f"f{f}") for f in range(n)))
    per = per.select("seed", "cat", "all", F.array(*(f"f{f}" for f in range(n))).alias("in_fold"))
    size = per.where("cat = ''").select("seed", F.col("all").alias("total"), F.col("in_fold").alias("sizes"))
    stray = F.array_max(F.zip_with("in_fold", "sizes", lambda c, s: F.abs(F.when(s > 0, c / s).otherwise(0.0) - F.col("all") / F.col("total"))))
    worst = per.where("cat <> ''").join(size, "seed").withColumn("dev", stray).groupBy("seed", "cat").agg(F.max("dev").alias("dev"))
    weight = F.create_map(*(F.lit(x) for kv in weights.items() for x in (kv[0], float(kv[1]))))
    worst = worst.groupBy("seed").agg(F.sum(weight[F.col("cat")] * F.col("dev")).alias("dev"))
    ideal = F.col("total") / n
    out = size.withColumn("size_dev", F.array_max(F.transform("sizes", lambda s: F.abs(s - ideal) / ideal))).join(worst, "seed")
    out = out.select("seed", "size_dev", F.round(size_weight * F.col("size_dev") + F.col("dev"), 9).alias("objective"))
    best = out.agg(F.min(F.struct("objective", "seed")).alias("b"))
    return out.crossJoin(F.broadcast(best)).select("seed", "size_dev", "objective", (F.col("seed") == F.col("b.seed")).alias("chosen"))


def split_groups(rows: DataFrame, group: str, fold: str = "fold") -> DataFrame:
    """(group, folds) of the groups that lie in more than one fold; empty if folds are isolated."""
    return rows.groupBy(group).agg(F.count_distinct(fold).alias("folds")).where("folds > 1")


def screen(rows: DataFrame, multiple: float = 1.0, least: int = 200, most: int = 900, seed: int = 0) -> DataFrame:
    """(qid, rescuable): of rows (qid, base, oracle) all queries whose oracle beats base, with multiple times as many
    controls, least at least, in the order of a seeded hash; beyond most only controls go, the largest qid first."""
    x = rows.withColumn("rescuable", F.col("oracle") > F.col("base") + 1e-12)
    n = x.agg(F.sum(F.col("rescuable").cast("long")).alias("r"), F.count("*").alias("n")).first()
    found = n.r or 0
    want = min(n.n - found, max(int(found * multiple), least))
    order = F.md5(F.concat_ws(":", F.col("qid").cast("string"), F.lit(str(seed))))
    controls = x.where(~F.col("rescuable")).orderBy(order, "qid").limit(want).orderBy("qid").limit(max(0, most - found))
    return x.where("rescuable").select("qid", "rescuable").unionByName(controls.select("qid", "rescuable"))


def best_rule(deltas: DataFrame, keys: list[str], most_changed: float = 0.2, penalty: float = 0.5) -> DataFrame:
    """deltas (keys, fold, delta, changed, n): per rule the mean, deviation and count of gains over folds, and how many
    queries it changes. Valid rules gain on average, in two folds at least, and change few queries; chosen is the one
    of best mean less penalty deviations, then best mean, then least change. None chosen means: keep all."""
    per = deltas.groupBy(*keys).agg(F.round(F.avg("delta"), 9).alias("mean_delta"), F.round(F.stddev_pop("delta"), 9).alias("sd_delta"), F.sum((F.col("delta") > 0).cast("long")).alias("positive"), F.round(F.sum("changed") / F.sum("n"), 9).alias("change_rate"))
    per = per.withColumn("valid", (F.col("mean_delta") > 0) & (F.col("positive") >= 2) & (F.col("change_rate") <= most_changed))
    order = W.partitionBy("valid").orderBy(F.desc(F.round(F.col("mean_delta") - penalty * F.col("sd_delta"), 9)), F.desc("mean_delta"), "change_rate", *keys)
    return per.withColumn("chosen", F.col("valid") & (F.row_number().over(order) == 1))


def cross_held(scores: DataFrame, config: str, base: float, folds: tuple[int, int] = (3, 4), gain: float = 0.00025, drop: float = 0.00072, cross_drop: float = 0.0002) -> DataFrame:
    """One row from scores (config, fold, recall, n): the config best on each of two folds with its recall on the other,
    the mean of those, the config of best pooled mean, and whether it passes: pooled gain over the base config, no fold
    far below it, nor the crossed mean. Ties go to the better other fold, then the smaller config."""
    at = lambda c, f: F.max(F.when(F.col("fold") == f, F.col(c)))
    a, b = folds
    x = scores.groupBy(config).agg(F.round(at("recall", a), 9).alias("a"), F.round(at("recall", b), 9).alias("b"), at("n", a).alias("na"), at("n", b).alias("nb"))
    x = x.withColumn("mean", F.round((F.col("na") * F.col("a") + F.col("nb") * F.col("b")) / (F.col("na") + F.col("nb")), 9))
    ref = x.where(F.col(config) == base).select(F.col("a").alias("ra"), F.col("b").alias("rb"), F.col("mean").alias("rm"))
    x = x.crossJoin(F.broadcast(ref)).withColumn("worst", F.round(F.least(F.col("a") - F.col("ra"), F.col("b") - F.col("rb")), 9))
    best = lambda *by: F.max_by(F.struct(config, "a", "b", "mean"), F.struct(*by, -F.col(config)))
    y = x.agg(best("a", "b").alias("x"), best("b", "a").alias("y"), best("mean", "worst").alias("m"), F.first("ra").alias("ra"), F.first("rb").alias("rb"), F.first("rm").alias("rm"))
    y = y.withColumn("cross_mean", (F.col("x.b") + F.col("y.a")) / 2)
    ok = (F.col("m.mean") >= F.col("rm") + gain) & (F.col("m.a") >= F.col("ra") - drop) & (F.col("m.b") >= F.col("rb") - drop) & (F.col("cross_mean") >= (F.col("ra") + F.col("rb")) / 2 - cross_drop)
    return y.select(F.col(f"x.{config}").alias("best_a"), F.col("x.b").alias("tested_b"), F.col(f"y.{config}").alias("best_b"), F.col("y.a").alias("tested_a"), "cross_mean", F.col(f"m.{config}").alias("best_mean"), F.col("m.mean").alias("mean"), ok.alias("passed"))


def two_level_overlap(left: DataFrame, right: DataFrame, key: str, strict: str, loose: str, itself: bool = True) -> DataFrame:
    """(key, same_key, n_strict, n_loose_only, excluded) of each row of left: whether right has its key, how many rows
    of right share its strict text, how many only the loose one; either of the first two excludes it. Right is counted
    by text before the joins, so a frequent text never meets its copies in pairs. Without itself, left is a part of
    right, a row doesn't count itself and its key says nothing."""
    both = right.groupBy(strict, loose).agg(F.count("*").alias("_b"))
    by_strict, by_loose = both.groupBy(strict).agg(F.sum("_b").alias("_s")), both.groupBy(loose).agg(F.sum("_b").alias("_l"))
    x = left.select(key, strict, loose).join(by_strict, strict, "left").join(by_loose, loose, "left").join(both, [strict, loose], "left")
    x = x.join(right.select(key).distinct().withColumn("same_key", F.lit(True)), key, "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    x = x.select(key, F.coalesce("same_key", F.lit(False)).alias("same_key"), (zero("_s") - (0 if itself else 1)).alias("n_strict"), (zero("_l") - zero("_b")).alias("n_loose_only"))
    return x.withColumn("excluded", (F.col("same_key") & F.lit(itself)) | (F.col("n_strict") > 0))


def ordered_digest(rows: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    """(by, digest): SHA-256 of a group's values in order; groups are short lists such as answers."""
    values = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).cast("string").alias("v")))), lambda x: x["v"])
    return rows.groupBy(*by).agg(F.sha2(F.array_join(values, ",", "null"), 256).alias("digest"))


def table_digest(rows: DataFrame) -> DataFrame:
    """(n, digest): rows and a sum over their hashes, whatever their order and partitions: the trace of an input."""
    h = F.conv(F.substring(F.md5(F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in sorted(rows.columns)))), 1, 8), 16, 10).cast("long")
    return rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(h), F.lit(0)).alias("digest"))


def nested_alpha(grid: DataFrame) -> DataFrame:
    """grid (w, fold, recall, n): for each held fold the weight of best recall over the queries of the other folds, the smaller of
    equals, and its recall on the held fold: (held, alpha, train, recall, n). All folds but one are the total less one."""
    w = W.partitionBy("w")
    total, many = F.sum(F.col("recall") * F.col("n")).over(w), F.sum("n").over(w)
    x = grid.withColumn("train", F.round((total - F.col("recall") * F.col("n")) / (many - F.col("n")), 9))
    best = W.partitionBy("fold").orderBy(F.desc("train"), "w")
    x = x.withColumn("k", F.row_number().over(best)).where("k = 1")
    return x.select(F.col("fold").alias("held"), F.col("w").alias("alpha"), "train", "recall", "n")


def dangling(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    """(rows, dangling): rows of child, and those whose key is not null and not in parent. Keys are counted first, so that a
    frequent one is one row of the join."""
    per = child.groupBy(key).agg(F.count("*").alias("_n"))
    x = per.join(parent.select(key).distinct().withColumn("_p", F.lit(1)), key, "left")
    return x.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("rows"), F.coalesce(F.sum(F.when(F.col(key).isNotNull() & F.col("_p").isNull(), F.col("_n"))), F.lit(0)).alias("dangling"))


def balance_gates(rows: DataFrame, limits: dict[str, float], size_limit: float, group: str, fold: str = "fold") -> DataFrame:
    """(gate, deviation, bound, passed): the folds' largest deviation from equal size and from each category's shares against
    their limits, and the groups that lie in more than one fold against none."""
    per = rows.groupBy(fold).agg(F.count("*").alias("n"))
    size = per.agg(F.sum("n").alias("all"), F.count("*").alias("k"), F.max("n").alias("hi"), F.min("n").alias("lo"))
    ideal = F.col("all") / F.col("k")
    out = [size.select(F.lit("size").alias("gate"), F.greatest(F.col("hi") - ideal, ideal - F.col("lo")).alias("d"), ideal.alias("i")).select("gate", (F.col("d") / F.col("i")).alias("deviation"), F.lit(size_limit).alias("bound"))]
    for c, most in limits.items():
        out.append(balance(rows, c, fold).agg(F.max("max_dev").alias("deviation")).select(F.lit(c).alias("gate"), "deviation", F.lit(most).alias("bound")))
    out.append(split_groups(rows, group, fold).agg(F.count("*").cast("double").alias("deviation")).select(F.lit("isolation").alias("gate"), "deviation", F.lit(0.0).alias("bound")))
    x = out[0]
    for y in out[1:]:
        x = x.unionByName(y)
    return x.withColumn("passed", F.round("deviation", 9) <= F.col("bound"))
