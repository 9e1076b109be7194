"""Context selection: budgets, maximal marginal relevance, context packages."""

from __future__ import annotations

import contextlib
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.functions.scores import chunk_overlap, jaccard, semantic_similarity
from lodestone.functions.vector import as_double, cosine, norm
from lodestone.session import materialize


def prefix_stop(rows: DataFrame, group: list[str], order: list, size: str, budget: float) -> DataFrame:
    """Rows of every group, in order, until the first that does not fit."""
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("used", F.sum(size).over(w)).where(F.col("used") <= budget)


def prefix_skip(rows: DataFrame, group: list[str], order: list, size: str, budget: float) -> DataFrame:
    """Rows of every group, in order, that still fit after those taken, with their rank; a row without a size never fits.

    A fold over sorted partitions: it keeps two numbers for the group at hand, whatever the size of a group.
    """
    schema = T.StructType([*rows.schema.fields, T.StructField("rank", T.IntegerType())])

    def fold(batches):
        last, used, rank = None, 0.0, 0
        for batch in batches:
            names = batch.schema.names
            keys = list(zip(*(batch.column(names.index(g)).to_pylist() for g in group), strict=True))
            keep, ranks = [], []
            for k, x in zip(keys, batch.column(names.index(size)).to_pylist(), strict=True):
                if rank == 0 or k != last:
                    last, used, rank = k, 0.0, 0
                rank += 1
                fits = x is not None and used + float(x) <= budget
                used += float(x) if fits else 0.0
                keep.append(fits)
                ranks.append(rank)
            yield pa.record_batch([*batch.columns, pa.array(ranks, pa.int32())], names=[*names, "rank"]).filter(pa.array(keep, pa.bool_()))

    return rows.repartition(*group).sortWithinPartitions(*group, *order).mapInArrow(fold, schema)


#: Name -> weight of relevance, token budget, cushion, similarity, least share of critical rows.
PRESET_VALUES = {
    "balanced": (0.7, 100_000, 0.20, "semantic", 0.95),
    "high-relevance": (0.9, 100_000, 0.15, "cosine", 0.98),
    "high-diversity": (0.4, 120_000, 0.25, "semantic", 0.85),
    "memory-conservative": (0.8, 50_000, 0.30, "jaccard", 0.90),
    "enterprise": (0.6, 200_000, 0.15, "semantic", 0.95),
}
METRICS = ("cosine", "jaccard", "semantic")


@dataclass(frozen=True)
class Preset:
    """Weights of a selection; lambda is the weight of relevance. ``diversity`` compares with the least (reference) or most (classic) similar taken row."""

    lam: float = 0.7
    budget: int = 100_000
    cushion: float = 0.2
    diversity: str = "reference"
    metric: str = "cosine"
    coverage: float = 0.95


PRESETS = {name: Preset(lam, budget, cushion, "reference", metric, coverage) for name, (lam, budget, cushion, metric, coverage) in PRESET_VALUES.items()}


def validated(values: dict, base: Preset = PRESETS["balanced"]) -> Preset:
    """A preset from settings; a value of the wrong type or out of range falls back to ``base``."""
    ranges = {"lam": (0, 1), "budget": (10_000, 500_000), "cushion": (0, 0.5), "coverage": (0, 1)}
    good = {}
    for name, (low, high) in ranges.items():
        x = values.get(name)
        if isinstance(x, int | float) and not isinstance(x, bool) and low <= x <= high:
            good[name] = x
    if values.get("metric") in METRICS:
        good["metric"] = values["metric"]
    return replace(base, **good)


def from_environment(env: dict[str, str], base: Preset = PRESETS["balanced"]) -> Preset:
    """``base`` with overrides from LODESTONE_MMR_PRESET, _LAMBDA, _BUDGET, _CUSHION, _METRIC and _COVERAGE."""
    start = PRESETS.get(env.get("LODESTONE_MMR_PRESET", ""), base)
    values: dict = {"metric": env.get("LODESTONE_MMR_METRIC")}
    for name, key in (("lam", "LAMBDA"), ("budget", "BUDGET"), ("cushion", "CUSHION"), ("coverage", "COVERAGE")):
        with contextlib.suppress(KeyError, ValueError):
            values[name] = float(env[f"LODESTONE_MMR_{key}"])
    if "budget" in values:
        values["budget"] = int(values["budget"])
    return validated(values, start)


def describe(p: Preset) -> list[str]:
    """Name of the preset that ``p`` equals (or custom), and what its values imply."""
    name = next((k for k, x in PRESETS.items() if x == p), "custom")
    lean = "relevance" if p.lam > 0.7 else "diversity" if p.lam < 0.5 else "both"
    size = "small" if p.budget < 75_000 else "large" if p.budget > 150_000 else "usual"
    return [f"preset: {name}", f"favours: {lean}", f"budget: {size}, {int(p.budget * (1 - p.cushion))} tokens after the cushion", f"similarity: {p.metric}"]


def _take_critical(rows: DataFrame, p: Preset) -> DataFrame:
    """Critical rows (query_id, id, item, tokens) that are taken: all if they fit together, else in order of id each that still fits."""
    room = p.budget * (1 - p.cushion)
    total = Window.partitionBy("query_id")
    rows = rows.withColumn("fits", F.sum("tokens").over(total) <= room).withColumn("used", F.lit(0.0))
    taken = rows.where("fits").drop("fits", "used")
    left = rows.where("not fits").drop("fits")
    so_far = Window.partitionBy("query_id").orderBy("id").rowsBetween(Window.unboundedPreceding, 0)
    while True:
        # what does not fit now never will; of the rest the longest run that fits is taken
        left = left.where(F.col("used") + F.col("tokens") <= 0.8 * p.budget).withColumn("after", F.col("used") + F.sum("tokens").over(so_far))
        left = materialize(left.withColumn("now", F.col("after") <= 0.8 * p.budget), "mmr-critical")
        if left.isEmpty():
            return taken
        taken = taken.unionByName(left.where("now").drop("now", "after", "used"))
        left = left.withColumn("used", F.max(F.when(F.col("now"), F.col("after"))).over(total)).where("not now").drop("now", "after")


#: What the similarity of two rows is made from; all but the embedding may be missing.
_ITEM = {"embedding": "array<double>", "file_path": "string", "chunk_type": "string", "words": "array<string>"}


def _similarity(metric: str):
    """Of two item structs: cosine, overlap of words with its shortcuts, or both."""

    def of(a, b):
        near = cosine(a["embedding"], b["embedding"])
        if metric == "cosine":
            return near
        overlap = chunk_overlap(a["file_path"] == b["file_path"], a["chunk_type"] == b["chunk_type"], a["words"], b["words"])
        return overlap if metric == "jaccard" else semantic_similarity(near, overlap)

    return of


def mmr_select(candidates: DataFrame, k: int, preset: Preset = PRESETS["balanced"]) -> DataFrame:
    """Greedy selection per query over all candidates (query_id, id, embedding, relevance, tokens, critical): query_id, position, id, score.

    Critical rows come first, in order of id, and are not limited by ``k``. Every
    further place is one argmax pass over the candidates; ties go to the smaller id.
    The preset's similarity needs file_path, chunk_type and words; without them it is the cosine.
    """
    p, room = preset, preset.budget * (1 - preset.cushion)
    full = set(_ITEM) <= set(candidates.columns)
    same = _similarity(p.metric if full else "cosine")
    c = candidates.withColumn("embedding", as_double("embedding"))
    item = F.struct(*((F.col(n) if full or n == "embedding" else F.lit(None).cast(t)).alias(n) for n, t in _ITEM.items()))
    c = c.select("query_id", "id", item.alias("item"), F.col("relevance").cast("double").alias("relevance"), F.col("tokens").cast("double").alias("tokens"), "critical")
    c = materialize(c, "mmr-candidates")
    first = materialize(_take_critical(c.where("critical").select("query_id", "id", "item", "tokens"), p), "mmr-first")
    end, best = (F.array_min, F.least) if p.diversity == "reference" else (F.array_max, F.greatest)
    nearest = lambda items: end(F.transform(items, lambda v: same(F.col("item"), v)))
    sums = first.groupBy("query_id").agg(F.sum("tokens").alias("used"), F.count("*").alias("n"), F.collect_list("item").alias("first"))
    rest = c.where("not critical").join(sums.select("query_id", "first"), "query_id", "left").withColumn("near", nearest(F.col("first"))).drop("first", "critical")
    rest = materialize(rest, "mmr-rest")
    state = c.select("query_id").distinct().join(sums.drop("first"), "query_id", "left")
    fields = ",".join(f"{n}:{t}" for n, t in _ITEM.items())
    empty = F.array().cast(f"array<struct<id:bigint,score:double,item:struct<{fields}>>>")
    state = materialize(state.select("query_id", F.coalesce("used", F.lit(0.0)).alias("used"), F.coalesce("n", F.lit(0)).alias("n"), empty.alias("picked")), "mmr-state")
    for _ in range(k):
        open_ = rest.join(state.where(F.col("n") < k), "query_id").where((F.col("used") + F.col("tokens") <= room) & ~F.array_contains("picked.id", F.col("id")))
        near = best("near", nearest(F.col("picked.item")))  # skips nulls
        diverse = F.when(near.isNull(), 1.0).otherwise(1 - F.least(F.greatest(near, F.lit(0.0)), F.lit(1.0)))
        scored = open_.withColumn("score", p.lam * F.col("relevance") + (1 - p.lam) * diverse)
        row, order = F.struct(F.col("id").cast("long").alias("id"), "score", "item"), F.struct("score", -F.col("id"))
        top = scored.groupBy("query_id").agg(F.max_by(row, order).alias("top"), F.max_by("tokens", order).alias("size"))
        more = F.col("top").isNotNull()
        state = state.join(top, "query_id", "left").select("query_id", (F.col("used") + F.coalesce("size", F.lit(0.0))).alias("used"), (F.col("n") + more.cast("long")).alias("n"), F.when(more, F.concat("picked", F.array("top"))).otherwise(F.col("picked")).alias("picked"), more.alias("more"))
        state = materialize(state, "mmr-state")
        if state.where("more").isEmpty():
            break
        state = state.drop("more")
    one = first.select("query_id", F.row_number().over(Window.partitionBy("query_id").orderBy("id")).alias("position"), F.col("id").cast("long").alias("id"), F.lit(1.0).alias("score"))
    done = first.groupBy("query_id").agg(F.count("*").alias("done"))
    two = state.join(done, "query_id", "left").select("query_id", F.coalesce("done", F.lit(0)).alias("done"), F.posexplode("picked").alias("at", "x"))
    two = two.select("query_id", (F.col("done") + F.col("at") + 1).cast("int").alias("position"), F.col("x.id").alias("id"), F.round("x.score", 6).alias("score"))
    return one.unionByName(two)


def mmr_metrics(selected: DataFrame, candidates: DataFrame, named: int, preset: Preset = PRESETS["balanced"]) -> DataFrame:
    """Per query: chunks, tokens, utilisation of the budget, critical coverage (of ``named`` files and functions; raw, and at most 1), diversity.

    Diversity is 1 - mean pairwise cosine, 1 for a single chunk, from sums of unit vectors.
    """
    rows = selected.select("query_id", "id").join(candidates, ["query_id", "id"]).withColumn("v", as_double("embedding"))
    rows = rows.withColumn("norm_", norm(F.col("v")))
    unit = rows.where("norm_ > 0").select("query_id", "id", F.posexplode(F.transform("v", lambda x: x / F.col("norm_"))).alias("pos", "x"))
    total = unit.groupBy("query_id", "pos").agg(F.sum("x").alias("all"), F.sum(F.col("x") * F.col("x")).alias("own"))
    total = total.groupBy("query_id").agg((F.sum(F.col("all") * F.col("all") - F.col("own")) / 2).alias("close"))
    n = rows.groupBy("query_id").agg(F.count("*").alias("chunks"), F.sum("tokens").alias("tokens"), F.count_if("critical").alias("critical"))
    pairs = F.col("chunks") * (F.col("chunks") - 1) / 2
    raw = F.col("critical") / F.greatest(F.lit(named), F.lit(1))
    out = n.join(total, "query_id", "left")
    return out.select("query_id", "chunks", "tokens", (F.col("tokens") / preset.budget).alias("utilisation"), F.least(F.lit(1.0), raw).alias("coverage"), raw.alias("raw_coverage"), F.when(pairs > 0, 1 - F.coalesce("close", F.lit(0.0)) / pairs).otherwise(1.0).alias("diversity"))


def diversity(vectors: DataFrame, id_col: str, vec: str) -> DataFrame:
    """1 - mean cosine of all pairs with different ids, from sums of unit vectors: no pair is formed."""
    n = norm(F.col("v"))
    v = vectors.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), as_double(vec).alias("v")).withColumn("n", n)
    unit = v.where("n > 0").select("id", F.size("v").alias("dim"), F.posexplode(F.transform("v", lambda x: x / F.col("n"))).alias("pos", "x"))
    own = unit.groupBy("dim", "pos", "id").agg(F.sum("x").alias("x"))
    both = own.groupBy("dim", "pos").agg(F.sum("x").alias("all"), F.sum(F.col("x") * F.col("x")).alias("own"))
    total = both.agg((F.sum(F.col("all") * F.col("all") - F.col("own")) / 2).alias("total"))
    count = v.groupBy("id").count().agg(((F.sum("count").cast("double") * F.sum("count") - F.sum(F.col("count").cast("double") * F.col("count"))) / 2).alias("pairs"))
    return total.crossJoin(count).select((1 - F.try_divide(F.coalesce("total", F.lit(0.0)), "pairs")).alias("diversity"))


#: Thresholds of ``top_jaccard``; token counts are kept by that many slots of a hash; a set of fewer tokens has no other whose score rounds to 1.
_LEVELS, _SLOTS, _EXACT_SIZE = (0.95, 0.9, 0.8, 0.6, 0.3, 0.1), 1 << 20, 1_000_000


def _twice(pairs: DataFrame, k: int) -> DataFrame:
    """The first ``k`` pairs a < b from pairs of classes (x and y: arrays of id and times; score)."""
    both = pairs.select("score", F.explode("x").alias("x"), "y").select("score", "x", F.explode("y").alias("y")).where("x.id != y.id")
    both = both.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b"), "score", F.explode(F.sequence(F.lit(1), F.least(F.col("x.n") * F.col("y.n"), F.lit(k)).cast("int"))))
    return both.select("a", "b", "score").orderBy(F.desc("score"), "a", "b").limit(k)


def _heads(reps: DataFrame, level: float) -> DataFrame:
    """Per class the tokens (by hash) among which it shares one with every set at ``level``: c, size, h. Rare tokens come first, by counts of hash slots."""
    import numpy as np

    h = F.transform("t", lambda x: F.xxhash64(x))
    slots = reps.select(F.explode(h).alias("h")).groupBy(F.pmod("h", F.lit(_SLOTS)).alias("slot")).agg(F.count("*").alias("n")).toArrow()  # a row a slot
    often = np.zeros(_SLOTS, np.int64)
    often[slots.column("slot").to_numpy()] = slots.column("n").to_numpy()

    def run(batches):
        for b in batches:
            c, size, flat = b.column(0).to_numpy(), b.column(1).to_numpy().astype(np.int64), b.column(2).flatten().to_numpy()
            row = np.repeat(np.arange(len(c)), size)
            order = np.lexsort((flat, often[flat % _SLOTS], row))
            at = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
            keep = at < (size - np.ceil((level - 1e-6) * size).astype(np.int64) + 1)[row]
            yield pa.record_batch([pa.array(c[row[keep]]), pa.array(size[row[keep]].astype(np.int32)), pa.array(flat[order[keep]])], names=["c", "size", "h"])

    return reps.select("c", "size", h.alias("h")).mapInArrow(run, "c long, size int, h long")


def top_jaccard(sets: DataFrame, id_col: str, tokens: str, k: int) -> DataFrame:
    """The ``k`` pairs a < b of highest Jaccard score (six digits; then by a, b) among all rows: a, b, score.

    Rows with equal sets are one class, known by a digest; the first pairs of a
    class need its ``k`` + 1 smallest ids only. If the classes have ``k`` pairs,
    these are the result. Else classes are joined by an inverted index over
    prefixes: with tokens in order of rarity, sets whose score is ``t`` or more
    share one of the first size - ceil(t * size) + 1. The threshold falls until
    ``k`` pairs reach it; at 0 every pair is looked at.
    """
    every = F.array_sort(F.array_distinct(F.coalesce(tokens, F.array().cast("array<string>"))))
    own = sets.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), every.alias("t"))
    parts = F.transform("t", lambda x: F.coalesce(F.concat(F.length(x).cast("string"), F.lit(":"), x), F.lit("null")))
    own = own.select("id", "t", F.size("t").alias("size"), F.sha2(F.array_join(parts, ","), 256).alias("key"))
    rows = materialize(own.where("size > 0").groupBy("key", "id").agg(F.count("*").alias("n"), F.max("size").alias("size")), "jaccard-keys")
    first = rows.withColumn("at", F.row_number().over(Window.partitionBy("key").orderBy("id"))).where(F.col("at") <= k + 1)
    classes = first.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("id", F.least("n", F.lit(k)).alias("n")))).alias("ids"))
    twin = classes.where(F.size("ids") > 1).orderBy(F.col("ids")[0]["id"], F.col("ids")[1]["id"]).limit(k)
    pairs = twin.select(F.explode("ids").alias("one"), "ids").select(F.array("one").alias("x"), F.filter("ids", lambda y: y["id"] > F.col("one.id")).alias("y"), F.lit(1.0).alias("score"))
    same = materialize(_twice(pairs, k), "jaccard-same")
    if same.count() >= k and (rows.agg(F.max("size")).first()[0] or 0) < _EXACT_SIZE:
        return same
    named = classes.select("key", F.col("ids")[0]["id"].alias("m"), F.get("ids", F.lit(1))["id"].alias("m2"))
    reps = own.where("size > 0").groupBy("key").agg(F.first("t").alias("t")).join(named, "key")
    reps = materialize(reps.select(F.monotonically_increasing_id().alias("c"), "key", "t", F.size("t").alias("size"), "m", "m2"), "jaccard-sets")
    x, y = (reps.select(F.col("c").alias(f"c{i}"), F.struct("key", "m", "m2").alias(f"r{i}"), F.col("t").alias(f"t{i}")) for i in (1, 2))
    for level in _LEVELS:
        head = materialize(_heads(reps, level), "jaccard-heads")
        one, two = (head.select(F.col("c").alias(f"c{i}"), F.col("size").alias(f"n{i}"), "h") for i in (1, 2))
        near = one.join(two, "h").where((F.col("c1") < F.col("c2")) & (F.least("n1", "n2") >= (level - 1e-6) * F.greatest("n1", "n2"))).select("c1", "c2").distinct()
        both = near.join(x, "c1").join(y, "c2").select("r1", "r2", F.round(jaccard(F.col("t1"), F.col("t2")), 6).alias("score")).where(F.col("score") >= level)
        m, equal = [F.col("r1.m"), F.col("r2.m")], F.col("r1.m") == F.col("r2.m")
        both = both.withColumn("b", F.when(equal, F.least("r1.m2", "r2.m2")).otherwise(F.greatest(*m))).where("b is not null")  # the first pair of the two classes
        best = materialize(both.orderBy(F.desc("score"), F.least(*m), "b").limit(k).select("score", F.col("r1.key").alias("k1"), F.col("r2.key").alias("k2")), "jaccard-best")
        best = best.join(classes.select(F.col("key").alias("k1"), F.col("ids").alias("x")), "k1").join(classes.select(F.col("key").alias("k2"), F.col("ids").alias("y")), "k2")
        found = materialize(_twice(best, k).unionByName(same).orderBy(F.desc("score"), "a", "b").limit(k), "jaccard-top")
        if found.count() >= k:
            return found
    x, y = own.select(F.col("id").alias("a"), F.col("t").alias("x")), own.select(F.col("id").alias("b"), F.col("t").alias("y"))
    score = x.join(y, F.col("a") < F.col("b")).select("a", "b", F.round(jaccard(F.col("x"), F.col("y")), 6).alias("score"))
    return materialize(score.orderBy(F.desc("score"), "a", "b").limit(k), "jaccard-top")
