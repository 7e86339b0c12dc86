"""Mixing sources to target weights by cube-method balanced sampling.

Every document of a source has the same expected number of copies, the source's
target over its size, at most `most`. The whole part is certain; the fraction is
an inclusion probability. The cube method moves the fractional probabilities of
a source through the null space of the constraints (documents, words): as long as
three units are fractional, some direction leaves both expected totals unchanged,
and following it until a unit reaches 0 or 1 decides that unit. The flight runs
in parallel over blocks of about `block` units of one source; each block leaves
two units at most, which fly again in merged blocks, until every source has one
block. A dozen units of mixed sizes per source stay out of the flight; with the
two that it may leave they are the landing problem: of all their outcomes the one
nearest to the expected words and documents is taken.

Rows equal in id, source and size form one unit whose copies apply to each. All
choices follow from hashes of the rows and the seed, so reruns agree however the
data are partitioned.

Defined cases: a null text has size 0; documents of size 0 take 0 words; null is
a source of its own, the last; ties in size and repeated ids are units of their own
unless source and size agree too; texts of any length are counted whole; an empty
table gives an empty result. Other columns are carried along by mix() under their
own names.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, materialise

_EPS = 1e-9
#: Units kept back for the landing, and words that a document too many or too few counts as there.
_LANDING, _DOCUMENT = 12, 5.0
_UNIT = "id_ string, source_ string, size_ long, rows_ long, block_ long, p_ double, whole_ long, copies_ long"


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def direction(weights: list[tuple[float, float]]) -> tuple[float, ...] | None:
    """A non-zero vector that both constraints map to zero, or None if there is none. weights: of 1 to 3 units."""
    if len(weights) == 3:
        (a1, b1), (a2, b2), (a3, b3) = weights
        u = (a2 * b3 - a3 * b2, a3 * b1 - a1 * b3, a1 * b2 - a2 * b1)
        if any(u):
            return u
        return (a2, -a1, 0.0)  # the units are proportional
    if len(weights) == 2 and weights[0][0] * weights[1][1] == weights[1][0] * weights[0][1]:
        return (weights[1][0], -weights[0][0])
    return None


def flight(p: np.ndarray, weights: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Probabilities after the flight: 0 or 1 but for two units at most, with both weighted sums unchanged."""
    p = p.copy()
    active: list[int] = []
    todo = [i for i in range(len(p)) if _EPS < p[i] < 1 - _EPS]
    w = [(float(a), float(b)) for a, b in weights]
    draws = iter(rng.random(4 * len(todo) + 8))
    at = 0
    while True:
        while len(active) < 3 and at < len(todo):
            active.append(todo[at])
            at += 1
        u = direction([w[i] for i in active])
        if u is None:
            return p
        up = min((1 - p[i]) / x if x > 0 else -p[i] / x for i, x in zip(active, u) if x)
        down = min(p[i] / x if x > 0 else (p[i] - 1) / x for i, x in zip(active, u) if x)
        step = up if next(draws) * (up + down) < down else -down
        for i, x in zip(active, u):
            v = p[i] + step * x
            p[i] = 0.0 if v < _EPS else 1.0 if v > 1 - _EPS else v
        left = [i for i in active if 0 < p[i] < 1]
        if len(left) == len(active):
            return p  # no progress is possible within rounding
        active = left


def landing(p: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """0 or 1 for every unit: all outcomes of the fractional ones are tried, and the one nearest to the expected words and documents is taken."""
    p = p.copy()
    free = np.flatnonzero((p > 0) & (p < 1))
    outcomes = (np.arange(1 << len(free))[:, None] >> np.arange(len(free))) & 1
    off = np.abs((outcomes - p[free]) @ weights[free])
    p[free] = outcomes[np.lexsort((np.arange(len(off)), off[:, 1] + off[:, 0] * _DOCUMENT))[0]]
    return p


def kept_back(weights: np.ndarray, open_: np.ndarray) -> np.ndarray:
    """Units that stay out of the flight, for the landing: spread over all sizes."""
    by_size = open_[np.argsort(weights[open_, 1], kind="stable")]
    if len(by_size) <= _LANDING:
        return by_size
    return by_size[np.unique(np.linspace(0, len(by_size) - 1, _LANDING).astype(int))]


def _fly(last: bool, seed: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["id_", "size_", "rows_"], na_position="last", kind="stable", key=lambda s: s if s.name != "id_" else s.map(lambda x: "~" if x is None else "=" + x))
        weights = np.stack([pdf.rows_.to_numpy(float), (pdf.rows_ * pdf.size_).to_numpy(float)], 1)
        rng = np.random.default_rng([seed, int(pdf.block_.iloc[0]), len(pdf), int(pdf.size_.sum()) & 0x7FFFFFFF])
        order = rng.permutation(len(pdf))
        p = pdf.p_.to_numpy().copy()
        if last or pdf.block_.iloc[0] == 0:
            order = order[~np.isin(order, kept_back(weights, np.arange(len(pdf))))]
        p[order] = flight(p[order], weights[order], rng)
        if last:
            p = landing(p, weights)
        decided = (p == 0) | (p == 1)
        copies = np.where(decided, pdf.whole_.to_numpy() + p, 0).astype("int64")
        return pdf.assign(p_=p, copies_=pd.arrays.IntegerArray(copies, ~decided))

    return run


def source_targets(sizes: DataFrame, weights: tuple[float, ...], most: float) -> DataFrame:
    """sizes (source_, source_size_) with weight_ and target_.

    Sources are ranked by code point, null last, through a range partitioning;
    only one sum per partition and a few totals ever reach the driver.
    """
    ranged = sizes.repartitionByRange(F.col("source_").isNull(), F.col("source_")).sortWithinPartitions(F.col("source_").isNull(), F.col("source_"))
    ranked = materialise(ranged.select("*", F.spark_partition_id().alias("part_"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("at_")), "mix-sources")
    offset, before = {}, 0
    for part, n in sorted((r.part_, r.n) for r in ranked.groupBy("part_").agg(F.count("*").alias("n")).collect()):
        offset[part], before = before, before + n
    if not offset:
        return ranked.select("source_", "source_size_", F.lit(0.0).alias("target_"))
    starts = ranked.sparkSession.createDataFrame(list(offset.items()), "part_ int, before_ long")
    rank = ranked.join(starts, "part_").select("source_", "source_size_", (F.col("at_") + F.col("before_")).alias("rank_"))
    weight = F.element_at(F.array(*map(F.lit, map(float, weights))), (F.col("rank_") % len(weights) + 1).cast("int"))
    known = rank.select("source_", "source_size_", weight.alias("weight_")).withColumn("most_", F.col("source_size_") * float(most))
    factor = 0.0
    while True:  # level the water: each pass adds the sources that stop at their limit
        above = F.col("most_") < F.col("weight_") * factor
        t = known.agg(F.sum("source_size_").alias("all"), F.sum(F.when(above, F.col("most_"))).alias("stopped"), F.sum(F.when(~above, F.col("weight_"))).alias("w")).first()
        new = ((t["all"] or 0) - (t["stopped"] or 0.0)) / t["w"] if t["w"] else factor
        if new <= factor:
            break
        factor = new
    return known.select("source_", "source_size_", F.least("most_", F.col("weight_") * factor).alias("target_"))


def plan_mix(docs: DataFrame, *, doc_id: str = "doc_id", source: str = "source", text: str = "text", weights: tuple[float, ...] = (5, 2, 1), most: float = 3, block: int = 2000, seed: int = 17) -> DataFrame:
    """One row per unit: id_, source_, size_, rows_ (documents in it), source_size_, target_, copies_."""
    units = docs.select(F.col(doc_id).cast("string").alias("id_"), F.col(source).alias("source_"), word_count(text).alias("size_"))
    units = materialise(units.groupBy("id_", "source_", "size_").agg(F.count("*").alias("rows_")), "mix-units")
    sizes = units.groupBy("source_").agg(F.sum(F.col("size_") * F.col("rows_")).alias("source_size_"), F.count("*").alias("units_"))
    sizes = materialise(sizes, "mix-sizes")
    targets = materialise(source_targets(sizes.select("source_", "source_size_"), weights, most).withColumnRenamed("source_", "key_").join(sizes.select(F.col("source_").alias("source2_"), "units_"), F.col("key_").eqNullSafe(F.col("source2_"))).drop("source2_"), "mix-targets")
    ratio = F.when(F.col("source_size_") > 0, F.least(F.col("target_") / F.col("source_size_"), F.lit(float(most)))).otherwise(0.0)
    placed = units.join(targets, F.col("source_").eqNullSafe(F.col("key_"))).select(
        "id_", "source_", "size_", "rows_",
        F.pmod(F.xxhash64(F.lit(seed), "id_", "size_"), F.ceil(F.col("units_") / block)).alias("block_"),
        (ratio - F.floor(ratio)).alias("p_"), F.floor(ratio).alias("whole_"), F.lit(None).cast("long").alias("copies_"),
    )
    # A fraction that rounding alone keeps from a whole number is one.
    near = F.round("p_").cast("long")
    placed = placed.withColumn("copies_", F.when(F.abs(F.col("p_") - near) < _EPS, F.col("whole_") + near))
    most_blocks = targets.agg(F.max(F.ceil(F.col("units_") / block))).first()[0] or 1
    levels = 1 + (math.ceil(math.log(most_blocks, block // 4)) if most_blocks > 1 else 0)
    done = [placed.where("copies_ is not null")]
    open_ = placed.where("copies_ is null")
    for k in range(levels):
        if k:
            open_ = open_.withColumn("block_", F.floor(F.col("block_") / (block // 4)))
        last = k == levels - 1
        flown = open_ if not last else open_.withColumn("block_", F.lit(0).cast("long"))
        flown = materialise(flown.groupBy("source_", "block_").applyInPandas(_fly(last, seed + k), _UNIT), "mix-flight")
        done.append(flown.where("copies_ is not null"))
        open_ = flown.where("copies_ is null")
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.join(targets, F.col("source_").eqNullSafe(F.col("key_"))).select("id_", "source_", "size_", "rows_", "source_size_", "target_", "copies_")


def mix(docs: DataFrame, *, doc_id: str = "doc_id", source: str = "source", text: str = "text", **options) -> DataFrame:
    """Documents that the mix takes, with their columns and one more, copies: how often to repeat each."""
    plan = plan_mix(docs, doc_id=doc_id, source=source, text=text, **options).where("copies_ > 0").select("id_", "source_", "size_", "copies_")
    name, size = free_name(docs, "copies"), free_name(docs, "size_of")
    left = docs.withColumn(size, word_count(text))
    on = left[doc_id].cast("string").eqNullSafe(plan["id_"]) & left[source].eqNullSafe(plan["source_"]) & (left[size] == plan["size_"])
    return left.join(plan, on).select(*[left[c] for c in docs.columns], plan["copies_"].alias(name))
