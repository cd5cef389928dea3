"""Metrics over sets of features, probabilities and logits."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import vectors as V
from .manifest import random_subsets, seeded_subset
from .masks import masked_psnr
from .moments import frechet_distance
from .ranks import hash_rank, order_rank, shuffled, values_at_ranks
from .tiles import _matrix, covered, log_sums, nearest, radius


def kernel_distance(features: DataFrame, *, subsets: int, m: int) -> DataFrame:
    """One row: kid, the mean unbiased squared distance under (x.y / n + 1)^3 over subsets of m of each side, or of all the smaller side has (A3). A task holds one subset, whose size is a parameter."""
    least = features.groupBy("side").count().agg(F.min("count")).first()[0] or 0
    m = min(m, least)
    drawn = random_subsets(features.select("id", "side", "x"), "id", subsets, m, ("side",))

    def run(t: pa.Table) -> pa.Table:
        side, x = t.column("side").to_numpy(zero_copy_only=False), _matrix(t.column("x"))
        names = sorted(set(side.tolist()))
        a, b = (x[side == s] for s in names)

        def k(u: np.ndarray, v: np.ndarray) -> np.ndarray:
            return (u @ v.T / u.shape[1] + 1) ** 3

        n = min(len(a), len(b))
        within = sum(kk.sum() - np.trace(kk) for kk in (k(a, a), k(b, b)))
        return pa.table({"subset": t.column("subset").slice(0, 1), "d": [within / (n - 1) / n - 2 * k(a, b).sum() / n / n]})

    each = drawn.groupBy("subset").applyInArrow(run, "subset int, d double")
    return each.agg(F.avg("d").alias("kid"))


def inception_score(probs: DataFrame, splits: int, by: str = "ord", p: str = "p") -> DataFrame:
    """One row: mean and deviation over contiguous splits of exp(mean KL(p given x, mean p)) (A4)."""
    n = probs.count()
    # row r is in split i if i*n//S <= r < (i+1)*n//S
    r = F.col("rank")
    guess = F.floor((r * splits + splits - 1) / F.lit(max(n, 1)))
    split = F.when(F.floor(guess * n / splits) > r, guess - 1).otherwise(guess)
    rows = order_rank(probs, by).withColumn("split", split.cast("int"))
    long = rows.select("split", F.posexplode(p).alias("c", "v"))
    per_class = long.groupBy("split", "c").agg(F.avg("v").alias("m"), F.sum(F.when(F.col("v") > 0, F.col("v") * F.log("v")).otherwise(0.0)).alias("e"), F.count(F.lit(1)).alias("n"))
    kl = (F.sum(F.col("e") - F.col("n") * F.col("m") * F.when(F.col("m") > 0, F.log("m")).otherwise(0.0)) / F.max("n")).alias("kl")
    return per_class.groupBy("split").agg(kl).agg(F.avg(F.exp("kl")).alias("mean"), F.stddev_pop(F.exp("kl")).alias("std"))


def precision_recall(features: DataFrame, k: int = 3, keys: tuple[str, ...] = (), real: str = "real", gen: str = "gen") -> DataFrame:
    """keys, precision, recall: share of one side's points inside the other's manifold (A5; by class A6)."""
    sides = {s: features.where(F.col("side") == s).select(*keys, "id", "x") for s in (real, gen)}

    def share(of: str, inside: str, name: str) -> DataFrame:
        balls = sides[inside].join(radius(sides[inside], k, keys=keys), [*keys, "id"])
        return covered(sides[of], balls, keys=keys, sized=sides[inside]).groupBy(*keys).agg(F.avg(F.col("hit").cast("double")).alias(name))

    p, r = share(gen, real, "precision"), share(real, gen, "recall")
    return p.join(r, list(keys)) if keys else p.select("precision", r.scalar().alias("recall"))


def class_precision_recall(features: DataFrame, k: int = 3) -> DataFrame:
    """label, precision, recall for every class of either side; 0 where a side has none."""
    classes = features.select("label").distinct()
    return classes.join(precision_recall(features, k, ("label",)), "label", "left").fillna(0.0, ["precision", "recall"])


def macro(df: DataFrame, names: list[str]) -> DataFrame:
    """Mean and population deviation over classes."""
    return df.agg(*[f(n).alias(f"{n}_{s}") for n in names for f, s in ((F.avg, "mean"), (F.stddev_pop, "std"))])


def trimmed_mean(df: DataFrame, value: str, tie: str, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """One row: mean between discrete percentiles, the lower rounded down, the upper up, both included (A8). Percentiles are exact, from counts narrowed round by round."""
    v = F.col(value).cast("double")
    rows = df.where(v.isNotNull() & ~F.isnan(v))
    n = rows.count()
    if not n:
        return rows.agg(F.avg(value).alias("mean"))
    ends = values_at_ranks(rows, value, [int(np.floor((n - 1) * low)), int(np.ceil((n - 1) * high))])
    return rows.where(v.between(*ends)).agg(F.avg(value).alias("mean"))


def top_k_hit(logits: str, target: str, k: int) -> Column:
    """Whether the target is among the k largest logits; of equal ones the lesser class is the larger."""
    mine = F.get(logits, F.col(target))
    ahead = F.filter(F.transform(logits, lambda v, i: (v > mine) | ((v == mine) & (i < F.col(target)))), lambda better: better)
    return F.size(ahead) < k


def knn_votes(queries: DataFrame, bank: DataFrame, *, k: int, temperature: float = 0.1) -> DataFrame:
    """id, label, vote, place: classes by summed exp(cosine / temperature) over the k nearest (A14, the published weighted protocol); ties go to the lesser class. queries: id, x; bank: id, x, label."""
    found = nearest(queries, bank, k, metric="cos", carried=("label",))
    votes = found.groupBy("id", "label").agg(F.sum(F.exp(F.col("score") / temperature)).alias("vote"))
    return votes.withColumn("place", F.row_number().over(W.partitionBy("id").orderBy(F.desc("vote"), "label")))


def accuracy_at(votes: DataFrame, truth: DataFrame, ks: tuple[int, ...] = (1, 5)) -> DataFrame:
    """One row: top<k> for each k; truth: id, target."""
    hit = truth.join(votes, (votes.id == truth.id) & (votes.label == truth.target), "left").select("place")
    return hit.agg(*[F.avg(F.coalesce((F.col("place") <= k).cast("double"), F.lit(0.0))).alias(f"top{k}") for k in ks])


def contrastive_accuracy(pairs: DataFrame, batch: str = "batch") -> DataFrame:
    """One row: accuracy (A17). In each batch both views look for their partner by cosine; means of batches are averaged without weights. pairs: id, batch, a, b. A batch's size is a parameter of training and fits a task."""

    def run(t: pa.Table) -> pa.Table:
        order = np.argsort(t.column("id").to_numpy())
        a, b = (_matrix(t.column(c))[order] for c in ("a", "b"))
        a, b = (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12) for x in (a, b))
        s, right = a @ b.T, np.arange(len(a))
        return pa.table({"batch": t.column("batch").slice(0, 1), "acc": [((s.argmax(1) == right).mean() + (s.argmax(0) == right).mean()) / 2]})

    return pairs.select("id", F.col(batch).alias("batch"), "a", "b").groupBy("batch").applyInArrow(run, "batch long, acc double").agg(F.avg("acc").alias("accuracy"))


def cross_entropy(logits: str, target: str, smoothing: float = 0.0) -> Column:
    """-log softmax at the target, mixed with the mean over classes."""
    nll = V.log_sum_exp(logits) - F.get(logits, F.col(target))
    return nll if not smoothing else (1 - smoothing) * nll + smoothing * (V.log_sum_exp(logits) - V.mean(logits))


def info_nce(queries: DataFrame, bank: DataFrame, temperature: float, *, block: int | None = None) -> DataFrame:
    """id, loss: cross-entropy of the positive against it and a bank of negatives of any size, at any temperature (A29, J12). Each pair of blocks sends on one scaled sum for each of its queries. queries: id, q, positive; bank: id, x."""
    own = queries.select("id", (V.cosine("q", "positive") / temperature).alias("l"))
    sums = log_sums(queries.select("id", F.col("q").alias("x")), bank.select("id", "x"), 1 / temperature, block=block)
    top = F.greatest("l", "log_sum")
    loss = top + F.log(F.exp(F.col("l") - top) + F.exp(F.col("log_sum") - top)) - F.col("l")
    return own.join(sums, "id", "left").select("id", F.when(F.col("log_sum").isNull(), 0.0).otherwise(loss).alias("loss"))


def random_pairs(items: DataFrame, key: str, seed: int) -> DataFrame:
    """a, b: each row in one pair, by neighbouring ranks of a seeded order; an odd last row stays alone and is left out."""
    ranked = hash_rank(items.select(key), shuffled(seed, F.col(key)), key)
    half = ranked.withColumn("pair", F.floor(F.col("rank") / 2))
    left, right = (half.where(F.col("rank") % 2 == i).select("pair", F.col(key).alias(n)) for i, n in ((0, "a"), (1, "b")))
    return left.join(right, "pair").select("a", "b")


def mixup(items: DataFrame, size: int, weight: float, key: str = "id", x: str = "x") -> DataFrame:
    """key, partner, x: rows blended with the row at the mirrored place of their batch."""
    ranked = order_rank(items.select(key, x), key).withColumn("batch", F.floor(F.col("rank") / size))
    counted = ranked.join(ranked.groupBy("batch").agg(F.count(F.lit(1)).alias("n")), "batch").withColumn("at", F.col("rank") % size)
    other = counted.select("batch", (F.col("n") - 1 - F.col("at")).alias("at"), F.col(key).alias("partner"), F.col(x).alias("y"))
    return counted.join(other, ["batch", "at"]).select(key, "partner", F.zip_with(x, "y", lambda u, v: weight * u + (1 - weight) * v).alias(x))


def masked_smooth_l1(pairs: DataFrame, beta: float = 1.0) -> DataFrame:
    """One row: loss over target patches only (A31). pairs: a, b (arrays), mask."""
    each = V.total(F.zip_with("a", "b", lambda u, v: V.smooth_l1(u, v, beta)))
    return pairs.agg((F.sum(each * F.col("mask")) / (F.sum("mask") + 1e-8)).alias("loss"))


#: Name -> metric and parameters, how many rows of each side, and the metric's own (X2, X3). None: all rows.
PRESETS: dict[str, dict] = {
    "fid50k_full": {"metric": "fid", "real": None, "gen": 50_000},
    "fid50k": {"metric": "fid", "real": 50_000, "gen": 50_000},
    "fid10k_full": {"metric": "fid", "real": None, "gen": 10_000},
    "kid50k_full": {"metric": "kid", "real": 1_000_000, "gen": 50_000, "subsets": 100, "m": 1000},
    "kid50k": {"metric": "kid", "real": 50_000, "gen": 50_000, "subsets": 100, "m": 1000},
    "pr50k3_full": {"metric": "pr", "real": 200_000, "gen": 50_000, "k": 3},
    "pr50k3_full_cond": {"metric": "pr_cond", "real": 200_000, "gen": 50_000, "k": 3},
    "pr50k3": {"metric": "pr", "real": 50_000, "gen": 50_000, "k": 3},
    "is50k": {"metric": "is", "gen": 50_000, "splits": 10},
    "fid_512": {"metric": "fid", "real": 512, "gen": 512},
    "is_512": {"metric": "is", "gen": 512, "splits": 1},
    **{name: {"metric": "ppl"} for name in ("ppl2_wend", "ppl_zfull", "ppl_wfull", "ppl_zend", "ppl_wend")},
    **{name: {"metric": "psnr", "pairs": 50_000} for name in ("eqt50k_int", "eqt50k_frac", "eqr50k")},
}
_REGISTRY: dict[str, Callable[..., DataFrame]] = {}


def metric(name: str) -> Callable:
    """Adds a metric f(features, **parameters) to the registry."""

    def add(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        if name in _REGISTRY:
            raise ValueError(f"there is a metric {name}")
        _REGISTRY[name] = f
        return f

    return add


def registered(name: str) -> Callable[..., DataFrame]:
    """The metric of that name."""
    return _REGISTRY[name]


def is_valid_metric(name: str) -> bool:
    return name in PRESETS


def list_metrics() -> list[str]:
    return list(PRESETS)


metric("fid")(lambda features: frechet_distance(features))
metric("kid")(lambda features, subsets, m: kernel_distance(features, subsets=subsets, m=m))
metric("pr")(lambda features, k: precision_recall(features, k))
metric("pr_cond")(lambda features, k: macro(class_precision_recall(features, k), ["precision", "recall"]))
metric("is")(lambda features, splits: inception_score(features.select(F.col("id").alias("ord"), V.softmax("x").alias("p")), splits))
metric("ppl")(lambda distances: trimmed_mean(distances, "d", "id"))
metric("psnr")(lambda pairs: masked_psnr(pairs, []))


def compute(name: str, features: DataFrame, seed: int = 0) -> DataFrame:
    """A preset over features (id, side, label, x), distances (id, d) for ppl, or pixel pairs (id, a, b, mask) for eq, id being the image's; what is more than the preset takes is sampled by a seed."""
    told = dict(PRESETS[name])
    f = _REGISTRY[told.pop("metric")]
    if "pairs" in told:
        drawn = seeded_subset(features.select("id").distinct(), "id", seed, told.pop("pairs"))
        return f(features.join(drawn, "id", "left_semi"), **told)
    sides = []
    for side in ("real", "gen"):
        if side in told:
            rows, most = features.where(F.col("side") == side), told.pop(side)
            fits = most is None or rows.count() <= most  # then there is nothing to rank
            sides.append(rows if fits else seeded_subset(rows, "id", seed, most))
    if not sides:
        return f(features, **told)
    return f(sides[0] if len(sides) == 1 else sides[0].unionByName(sides[1]), **told)


def extracted(items: DataFrame, extractor: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """items through a user's function of Arrow batches, such as a feature detector."""
    return items.mapInArrow(lambda batches: map(extractor, batches), schema)


def transformed(items: DataFrame, f: Callable[[dict], dict | None], schema: str) -> DataFrame:
    """items through a user's function of one row, such as a crop; rows for which it gives None are left out."""
    kind = to_arrow_schema(items.sparkSession.createDataFrame([], schema).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [made for row in batch.to_pylist() if (made := f(row)) is not None]
            yield pa.RecordBatch.from_pylist(rows, kind)

    return items.mapInArrow(run, schema)
