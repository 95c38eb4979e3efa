"""Quality of scored orderings, by aggregations over ``y`` (0 or 1) and ``p`` (score in [0, 1])."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

RANGES = 1024


def running(df: DataFrame, score: str, sums: dict[str, str], descending: bool = True) -> DataFrame:
    """Running sums over distinct scores, in two steps: sums of RANGES score ranges, then rows within each range.

    No task sees more than the scores of one range, and the window over ranges has a fixed number of rows.
    """
    sign = -1 if descending else 1
    ranged = df.withColumn("__r", sign * F.floor(F.col(score) * RANGES).cast("int"))
    per = ranged.groupBy("__r").agg(*[F.sum(c).alias(f"__{n}") for n, c in sums.items()])
    before = per.select("__r", *[(F.sum(f"__{n}").over(Window.orderBy("__r")) - F.col(f"__{n}")).alias(f"__{n}") for n in sums])
    order = F.col(score).desc() if descending else F.col(score).asc()
    w = Window.partitionBy("__r").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    out = ranged.join(F.broadcast(before), "__r")
    return out.select(*df.columns, *[(F.col(f"__{n}") + F.sum(c).over(w)).alias(n) for n, c in sums.items()])


def by_score(pred: DataFrame) -> DataFrame:
    """Rows and positives of each distinct score."""
    return pred.groupBy("p").agg(F.count(F.lit(1)).alias("n"), F.sum("y").cast("long").alias("pos"))


def auc_and_precision(pred: DataFrame) -> DataFrame:
    """One row ``auc, precision_media``: ties share their average rank; precision is averaged over distinct thresholds."""
    g = by_score(pred)
    up = running(g, "p", {"hasta": "n"}, descending=False)
    rank = F.col("hasta") - F.col("n") + (F.col("n") + 1) / 2.0
    pos, all_ = F.sum("pos").cast("double"), F.sum("n").cast("double")
    auc = F.try_divide(F.sum(F.col("pos") * rank) - pos * (pos + 1) / 2, pos * (all_ - pos))
    down = running(g, "p", {"tp": "pos", "tot": "n"})
    ap = F.try_divide(F.sum(F.col("pos") * F.col("tp") / F.col("tot")), pos)
    return up.agg(auc.alias("auc")).crossJoin(down.agg(ap.alias("precision_media")))


def curve(pred: DataFrame) -> DataFrame:
    """True and false positive rate and precision at each distinct threshold."""
    g = by_score(pred)
    t = running(g, "p", {"tp": "pos", "tot": "n"}).crossJoin(F.broadcast(g.agg(F.sum("pos").alias("positivos_"), F.sum("n").alias("todas_"))))
    return t.select(
        F.col("p").alias("umbral"), F.try_divide(F.col("tp").cast("double"), F.col("positivos_")).alias("tpr"),
        F.try_divide((F.col("tot") - F.col("tp")).cast("double"), F.col("todas_") - F.col("positivos_")).alias("fpr"), (F.col("tp") / F.col("tot")).alias("precision"),
    )


def top(pred: DataFrame, sizes: list[int]) -> DataFrame:
    """Precision, recall and lift among the ``k`` best; ties go by id. A top-k report: only the largest k is ordered."""
    best = pred.orderBy(F.desc("p"), "id").limit(max(sizes)).withColumn("i", F.row_number().over(Window.orderBy(F.desc("p"), "id")))
    whole = pred.agg(F.sum("y").cast("double").alias("positivos_"), F.count(F.lit(1)).cast("double").alias("todas_"))
    ks = pred.sparkSession.createDataFrame([(k,) for k in sizes], "k int")
    hit = best.join(F.broadcast(ks), F.col("i") <= F.col("k")).groupBy("k").agg(F.sum("y").cast("long").alias("aciertos"))
    prec = F.col("aciertos") / F.least(F.col("k"), F.col("todas_"))
    return hit.crossJoin(F.broadcast(whole)).select("k", "aciertos", prec.alias("precision"), F.try_divide(F.col("aciertos"), F.col("positivos_")).alias("cobertura"), F.try_divide(prec, F.col("positivos_") / F.col("todas_")).alias("ganancia"))


def confusion(pred: DataFrame, threshold: float) -> DataFrame:
    hit, yes = F.col("p") >= threshold, F.col("y") == 1
    c = pred.agg(F.count_if(hit & yes).alias("tp"), F.count_if(hit & ~yes).alias("fp"), F.count_if(~hit & yes).alias("fn"), F.count_if(~hit & ~yes).alias("tn"))
    return c.withColumn("f1", F.coalesce(F.try_divide(2.0 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), F.lit(0.0)))


def best_f1(pred: DataFrame) -> DataFrame:
    """Threshold of largest F1 over all distinct scores; ties go to the higher threshold."""
    t = running(by_score(pred), "p", {"tp": "pos", "tot": "n"}).crossJoin(F.broadcast(pred.agg(F.sum("y").alias("positivos_"))))
    f1 = F.round(2.0 * F.col("tp") / (F.col("tot") + F.col("positivos_")), 9)
    return t.select(F.col("p").alias("umbral"), f1.alias("f1")).orderBy(F.desc("f1"), F.desc("umbral")).limit(1)


def reliability(pred: DataFrame, bins: int = 10) -> DataFrame:
    """Mean score and share of positives in equal-width bins; a score of 1 is in the last."""
    b = F.least(F.floor(F.col("p") * bins), F.lit(bins - 1)).cast("int").alias("tramo")
    return pred.groupBy(b).agg(F.count(F.lit(1)).alias("n"), F.avg("p").alias("media"), F.avg(F.col("y").cast("double")).alias("positivos"))


#: Replicates that share a digest: 16 bits of 128 for each.
LANES = 8
#: Distribution of Poisson(1) at 0, 1, ... (fixed values).
POISSON = [0.36787944117, 0.73575888234, 0.91969860293, 0.98101184312, 0.99634015317, 0.99940581518, 0.99991675, 0.99998980]


#: Score ranges of about equal size, and salts of a score that fills several of them.
PARTS, SALTS = 256, 32


def bootstrap(pred: DataFrame, replicates: int, seed: str = "b") -> DataFrame:
    """``r, auc``: the AUC of each replicate, with Poisson(1) weights drawn from digests of id and replicate.

    The weights are the same on every run and engine, so orderings can be compared in pairs. Rows are never multiplied by
    the replicates: they go to PARTS ranges of the score (cut at quantiles), and each range gives three vectors with a
    number for each replicate: weight of the negatives, of the positives, and of its own ordered pairs. A score
    that fills a range by itself is spread over SALTS tasks and its ties are counted when their sums are merged. What
    follows are running sums over the ranges of a replicate. ``replicates`` is a multiple of LANES.
    """
    import hashlib
    import zlib
    from collections import Counter

    import numpy as np
    import pyarrow as pa

    cuts = pred.agg(F.percentile_approx("p", [i / PARTS for i in range(1, PARTS)], 10_000)).first()[0] or []
    found = Counter(cuts)
    edges, heavy = np.array(sorted(found), np.float64), np.array([c for c, n in found.items() if n > 1], np.float64)
    steps, blocks = np.array([math.ceil(c * 65536) for c in POISSON]), replicates // LANES

    def place(batches):
        for batch in batches:
            ids, p = batch.column(0).cast(pa.string()), batch.column(2).to_numpy(zero_copy_only=False)
            alone = np.isin(p, heavy)
            part = 2 * np.searchsorted(edges, p, "left") + alone
            salt = np.where(alone, [zlib.crc32(i.encode()) % SALTS for i in ids.to_pylist()], 0)
            yield pa.RecordBatch.from_arrays([ids, *batch.columns[1:], pa.array(part.astype(np.int32)), pa.array(salt.astype(np.int32))], names=["id", "y", "p", "part", "salt"])

    def weigh(ids):
        raw = b"".join(hashlib.md5(f"{seed}|{b}|{i}".encode()).digest() for i in ids for b in range(blocks))
        return np.searchsorted(steps, np.frombuffer(raw, ">u2").astype(np.int64), "right").reshape(len(ids), replicates)

    def sums(batches):
        zero = lambda: np.zeros(replicates)
        at = tie = None
        neg, pos, pairs, tie_neg, tie_pos = zero(), zero(), zero(), zero(), zero()

        def out():
            close()
            one = [pa.array([v.tolist()], pa.list_(pa.float64())) for v in (neg, pos, pairs)]
            return pa.RecordBatch.from_arrays([pa.array([at[0]], pa.int32()), *one], names=["part", "neg", "pos", "pairs"])

        def close():
            nonlocal neg, pos, pairs, tie_neg, tie_pos
            if at[0] % 2 == 0:  # ties of a spread score are counted once their sums are whole
                pairs += tie_pos * (neg + tie_neg / 2)
            neg, pos, tie_neg, tie_pos = neg + tie_neg, pos + tie_pos, zero(), zero()

        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                batch = whole.slice(start, 256)
                columns = [c.to_pylist() for c in batch.columns]
                for i, y, p, w in zip(range(batch.num_rows), columns[1], columns[2], weigh(columns[0])):
                    key = (columns[3][i], columns[4][i])
                    if at is not None and key != at:
                        yield out()
                        neg, pos, pairs = zero(), zero(), zero()
                    elif at is not None and p != tie:
                        close()
                    at, tie = key, p
                    if y:
                        tie_pos += w
                    else:
                        tie_neg += w
        if at is not None:
            yield out()

    kind = "id string, y int, p double, part int, salt int"
    placed = pred.select(F.col("id").cast("string").alias("id"), F.col("y").cast("int").alias("y"), F.col("p").cast("double").alias("p")).mapInArrow(place, kind)
    # A number of tasks that doesn't hang on the size of the rows: each of them is worked on for every replicate.
    tasks = max(2 * pred.sparkSession.sparkContext.defaultParallelism, int(pred.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    spread = placed.repartition(tasks, "part", "salt").sortWithinPartitions("part", "salt", "p")
    each = spread.mapInArrow(sums, "part int, neg array<double>, pos array<double>, pairs array<double>")
    each = each.select("part", F.posexplode(F.arrays_zip("neg", "pos", "pairs")).alias("r", "v")).groupBy("r", "part").agg(F.sum("v.neg").alias("neg"), F.sum("v.pos").alias("pos"), F.sum("v.pairs").alias("pairs"))
    each = each.withColumn("pairs", F.col("pairs") + F.when(F.col("part") % 2 == 1, F.col("pos") * F.col("neg") / 2).otherwise(0.0))
    below = F.coalesce(F.sum("neg").over(Window.partitionBy("r").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    each = each.withColumn("pairs", F.col("pairs") + F.col("pos") * below)
    return each.groupBy("r").agg(F.try_divide(F.sum("pairs"), F.sum("pos") * F.sum("neg")).alias("auc"))


def overlap(a: Column, b: Column, df: DataFrame) -> DataFrame:
    """2x2 table of two flags with Jaccard, odds ratio and chi-square with continuity correction."""
    t = df.agg(F.count_if(a & b).alias("ambos"), F.count_if(a & ~b).alias("solo_a"), F.count_if(~a & b).alias("solo_b"), F.count_if(~a & ~b).alias("ninguno"))
    x, y, z, w = (F.col(c).cast("double") for c in ("ambos", "solo_a", "solo_b", "ninguno"))
    n = x + y + z + w
    chi = F.try_divide(n * F.pow(F.greatest(F.abs(x * w - y * z) - n / 2, F.lit(0.0)), 2), (x + y) * (z + w) * (x + z) * (y + w))
    return t.select("*", F.try_divide(x, x + y + z).alias("jaccard"), F.try_divide(x * w, y * z).alias("razon"), chi.alias("chi2"))


def split(df: DataFrame, key: str, label: str, share: float = 0.3, folds: int = 3, seed: str = "42") -> DataFrame:
    """``prueba`` and ``pliegue`` by the place of a digest of the key, so that a row's part never depends on others.

    Stratified in expectation: each class is cut at the same share of a uniform digest.
    """
    u = F.conv(F.left(F.md5(F.concat_ws("|", F.lit(seed), F.col(label).cast("string"), F.col(key))), F.lit(8)), 16, 10).cast("double") / 4294967296.0
    return df.withColumn("prueba", u < share).withColumn("pliegue", F.when(u >= share, (F.floor((u - share) / (1 - share) * folds)).cast("int")))


def places(pred: DataFrame) -> DataFrame:
    """``pred`` with ``i``, its place by falling score, and ``todas``; ties go by the digest of the id, then by id.

    Places come from counts by score and by range of the digest, so no score shared by many is ordered in one task.
    """
    b = F.left(F.md5("id"), F.lit(2))
    d = pred.withColumn("__b", b)
    upto = running(d.groupBy("p").agg(F.count(F.lit(1)).alias("__k")), "p", {"__upto": "__k"})
    within = Window.partitionBy("p").orderBy("__b").rowsBetween(Window.unboundedPreceding, 0)
    part = d.groupBy("p", "__b").agg(F.count(F.lit(1)).alias("__j")).withColumn("__in", F.sum("__j").over(within) - F.col("__j"))
    before = part.join(upto, "p").select("p", "__b", (F.col("__upto") - F.col("__k") + F.col("__in")).alias("__before"))
    at = F.row_number().over(Window.partitionBy("p", "__b").orderBy(F.md5("id"), "id"))
    placed = d.join(before, ["p", "__b"]).withColumn("i", F.col("__before") + at)
    return placed.crossJoin(F.broadcast(pred.agg(F.count(F.lit(1)).alias("todas")))).select(*pred.columns, "i", "todas")


def fisher(both: int, only_a: int, only_b: int, neither: int) -> float:
    """Two-sided exact probability of a 2x2 table: the sum over tables that are no likelier."""
    from math import exp, lgamma

    rows, columns, n = both + only_a, both + only_b, both + only_a + only_b + neither
    choose = lambda n, k: lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1)
    chance = lambda x: choose(rows, x) + choose(n - rows, columns - x) - choose(n, columns)
    here = chance(both)
    return min(1.0, sum(exp(c) for x in range(max(0, rows + columns - n), min(rows, columns) + 1) if (c := chance(x)) <= here + 1e-7))


def linear_shapley(df: DataFrame, key: str, weights: dict[str, float]) -> DataFrame:
    """Exact Shapley values of a linear score: weight times distance from the mean, one row a key and feature.

    They add up to the score's distance from the mean score, whatever the order in which features are added.
    """
    means = df.agg(*[F.avg(c).alias(f"__m_{c}") for c in weights])
    parts = [F.struct(F.lit(c).alias("rasgo"), (F.lit(w) * (F.col(c) - F.col(f"__m_{c}"))).alias("aporte")) for c, w in weights.items()]
    return df.crossJoin(F.broadcast(means)).select(key, F.explode(F.array(*parts)).alias("x")).select(key, "x.*")


def coalition_shapley(df: DataFrame, key: str, features: list[str], weights: list[float], bias: float, background: list[list[float]]) -> DataFrame:
    """Exact Shapley values ``key, rasgo, aporte`` of a logistic score, missing features taken from ``background`` rows in turn.

    Every coalition of the features is reckoned (2 to their number), for whole batches of rows; the background is a
    table of fixed size. Values of a row add up to its score less the mean score of the background.
    """
    import numpy as np
    import pyarrow as pa

    n, w, base = len(features), np.array(weights), np.array(background, np.float64).reshape(-1, len(features))
    masks = (np.arange(1 << n)[:, None] >> np.arange(n)) & 1
    size = masks.sum(1)
    share = np.array([math.factorial(k) * math.factorial(n - k - 1) / math.factorial(n) if k < n else 0.0 for k in size])

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                x = np.stack([part.column(i + 1).to_numpy(zero_copy_only=False) for i in range(n)], 1)
                own, other = (x * w) @ masks.T, (base * w) @ (1 - masks).T
                value = (1 / (1 + np.exp(-(own[:, None, :] + other[None, :, :] + bias)))).mean(1)
                out = np.empty((len(x), n))
                for j in range(n):
                    without = np.flatnonzero(masks[:, j] == 0)
                    out[:, j] = ((value[:, without | (1 << j)] - value[:, without]) * share[without]).sum(1)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(np.repeat(np.arange(len(x)), n))), pa.array(features * len(x)), pa.array(out.ravel())], names=[key, "rasgo", "aporte"])

    kind = df.select(key).schema[0].dataType.simpleString()
    return df.select(key, *[F.col(c).cast("double") for c in features]).mapInArrow(run, f"`{key}` {kind}, rasgo string, aporte double")
