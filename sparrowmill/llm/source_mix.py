"""Operator 6 [native]: mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Each source's documents are dealt into blocks of about BLOCK_DOCS by hash. A source's target of words is met by whole
passes over its blocks and then by a prefix of its permuted blocks; in the block where the target falls, documents are
taken from the largest down as long as they fit. The blocks to draw are quotas. A binary tree over the output shards
splits them: at each node the left half gets its number of draws, and how many of them fall to each source is drawn from
the multivariate hypergeometric distribution (source by source, each hypergeometric given those before). So shards are
equal to within one draw, quotas stay exact, and each shard's share of a source is as random as if all draws had been
shuffled. A shard's draws of a source are a run of its permuted blocks, and rows are shuffled within a shard by hash.

All random numbers are hashes of the seed and of what they are for, so reruns agree. Tables with a row for each source
are metadata: they are joined by salted keys, and only they meet in one task.

Defined cases: a null text has size 0; a null source is a source of its own, last in order; sources without words have
target 0. Targets sum up to all words unless all sources are capped. Documents with no words are never taken. Rows of one
doc_id, source and size (repeated rows are such) are one unit: they are dealt and taken alike. Rows of one doc_id but of
another source or size have nothing to do with each other, and a null doc_id is an id. An empty table gives an empty mix.
The mix keeps the columns of its input, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import runtime

WORD = r"[^\x20\x09-\x0D]+"
SEED = 20
BLOCK_DOCS = 1000
LEVELS = 4  # of the tree: 2 ** LEVELS shards
WEIGHTS = (1.0, 2.0, 3.0)
MOST = 3.0  # times a source's size
SALTS = 32


def _uniform(*parts: Column | int) -> Column:
    """A number between 0 and 1 by hash."""
    h = F.xxhash64(*(p if isinstance(p, Column) else F.lit(p) for p in parts))
    return (F.shiftrightunsigned(h, 11).cast("double") + 0.5) / float(1 << 53)


def _log_factorial(n: Column) -> Column:
    z = n + 1.0
    return (z - 0.5) * F.log(z) - z + 0.9189385332046727 + 1 / (12 * z) - 1 / (360 * z * z * z)


def _log_choose(n: Column, k: Column) -> Column:
    return _log_factorial(n) - _log_factorial(k) - _log_factorial(n - k)


def hypergeometric(total: Column, good: Column, draws: Column, u: Column) -> Column:
    """How many of `draws` out of `total` are among the `good`, by inversion at u. Looked for within 12 deviations."""
    low, high = F.greatest(F.lit(0).cast("long"), draws - (total - good)), F.least(good, draws)
    mean = draws * good / F.greatest(total, F.lit(1))
    spread = 12 * F.sqrt(mean * (1 - good / F.greatest(total, F.lit(1))) + 1) + 2
    low, high = F.greatest(low, F.floor(mean - spread)), F.least(high, F.ceil(mean + spread))

    def weighed(xs: Column) -> Column:
        def log(x: Column) -> Column:
            return _log_choose(good.cast("double"), x.cast("double")) + _log_choose((total - good).cast("double"), (draws - x).cast("double"))

        return F.transform(xs, lambda x: F.struct(x.alias("x"), log(x).alias("w")))

    def scaled(xs: Column) -> Column:
        top = F.array_max(F.transform(xs, lambda p: p["w"]))
        return F.transform(xs, lambda p: F.struct(p["x"].alias("x"), F.exp(p["w"] - top).alias("w")))

    def pick(xs: Column) -> Column:
        left = u * F.aggregate(xs, F.lit(0.0), lambda a, p: a + p["w"])
        start = F.struct(left.alias("left"), F.element_at(xs, 1)["x"].alias("x"))
        return F.aggregate(
            xs,
            start,
            lambda a, p: F.struct((a["left"] - p["w"]).alias("left"), F.when(a["left"] > 0, p["x"]).otherwise(a["x"]).alias("x")),
            lambda a: a["x"],
        )

    def let(x: Column, body) -> Column:
        return F.element_at(F.transform(F.array(x), body), 1)

    return let(F.sequence(low.cast("long"), high.cast("long")), lambda a: let(weighed(a), lambda b: let(scaled(b), pick)))


def _left_half(quotas: Column, level: int, node: Column, seed: int) -> Column:
    """Of a node's quotas (an array by source), those that go left."""
    total = F.aggregate(quotas, F.lit(0).cast("long"), lambda a, q: a + q)
    start = F.struct(total.alias("total"), F.floor(total / 2).cast("long").alias("draws"), F.array().cast("array<bigint>").alias("out"))

    def step(acc: Column, q: Column) -> Column:
        one = F.transform(
            F.array(hypergeometric(acc["total"], q, acc["draws"], _uniform(seed, level, node, F.size(acc["out"])))),
            lambda x: F.struct((acc["total"] - q).alias("total"), (acc["draws"] - x).alias("draws"), F.concat(acc["out"], F.array(x)).alias("out")),
        )
        return F.element_at(one, 1)

    return F.aggregate(quotas, start, step, lambda acc: acc["out"])


def split_quotas(quotas: DataFrame, levels: int = LEVELS, seed: int = SEED) -> DataFrame:
    """quotas (source, rank, quota) split among 2 ** levels shards: per source the array `cuts` of where in its draws each
    shard's begin, one more than there are shards."""
    rows = quotas.agg(F.array_sort(F.collect_list(F.struct("rank", "quota"))).alias("all"))
    nodes = rows.select(F.lit(0).cast("long").alias("node"), F.transform("all", lambda x: x["quota"]).alias("quotas"))
    for level in range(levels):
        halves = nodes.withColumn("left", _left_half(F.col("quotas"), level, F.col("node"), seed))
        right = F.zip_with("quotas", "left", lambda a, b: a - b)
        both = F.array(F.struct((F.col("node") * 2).alias("node"), F.col("left").alias("quotas")), F.struct((F.col("node") * 2 + 1).alias("node"), right.alias("quotas")))
        nodes = halves.select(F.inline(both))
    each = nodes.select("node", F.posexplode("quotas").alias("i", "n")).groupBy("i").agg(F.array_sort(F.collect_list(F.struct("node", "n"))).alias("by_node"))
    counts = F.transform("by_node", lambda x: x["n"])
    zero = F.array(F.lit(0).cast("long"))
    cuts = F.aggregate(counts, zero, lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)))
    order = W.orderBy("rank")
    ranked = quotas.withColumn("i", F.row_number().over(order) - 1)
    return ranked.join(each.select("i", cuts.alias("cuts")), "i").drop("i")


def sources_of(sized: DataFrame) -> DataFrame:
    """Per source: its rank, size, number of documents, weight, target, whole passes and what is left then."""
    by_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    order = W.orderBy(F.col("source").asc_nulls_last())
    ranked = by_source.withColumn("rank", F.row_number().over(order).cast("long"))
    weight = F.element_at(F.array(*(F.lit(w) for w in WEIGHTS)), ((F.col("rank") - 1) % len(WEIGHTS) + 1).cast("int"))
    ranked = ranked.withColumns({"weight": weight, "most": MOST * F.col("source_size")})
    # filling up: sorted by cap over weight, the capped sources come first, and the level for the others is the largest
    by_ratio = W.orderBy(F.col("most") / F.col("weight"), "rank")
    before = by_ratio.rowsBetween(W.unboundedPreceding, -1)
    left = F.sum("source_size").over(W.partitionBy()) - F.coalesce(F.sum("most").over(before), F.lit(0.0))
    weights = F.sum("weight").over(by_ratio.rowsBetween(0, W.unboundedFollowing))
    filled = ranked.withColumn("level", left / weights).withColumn("level", F.max("level").over(W.partitionBy()))
    target = F.least(F.col("most"), F.col("level") * F.col("weight"))
    size = F.greatest(F.col("source_size"), F.lit(1))
    return (
        filled.withColumn("target", F.greatest(target, F.lit(0.0)))
        .withColumn("passes", F.least(F.floor(F.col("target") / size + 1e-12), F.lit(int(MOST))).cast("long"))
        .withColumn("rest", F.greatest(F.lit(0.0), F.col("target") - F.col("passes") * F.col("source_size")))
        .withColumn("n_blocks", F.ceil(F.col("n_docs") / BLOCK_DOCS).cast("long"))
        .select("source", "rank", "source_size", "n_docs", "target", "passes", "rest", "n_blocks")
    )


def _with_source(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """rows with their source's columns; each source's row is repeated SALTS times so that a hot source is dealt out."""
    many = sources.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).withColumnRenamed("source", "_source")
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64("doc_id", F.lit("salt")), F.lit(SALTS)).cast("int"))
    same = salted["source"].eqNullSafe(many["_source"]) & (salted["_salt"] == many["_salt"])
    return salted.join(many, same).drop(many["_salt"]).drop("_source", "_salt")


def _size() -> Column:
    return F.regexp_count(runtime.text_or_empty(), F.lit(WORD)).cast("long")


def _unit(size: Column | str = "size") -> Column:
    """What tells rows that are dealt and taken alike; nulls differ from all other values."""
    return F.xxhash64("doc_id", "source", F.col("doc_id").isNull(), F.col("source").isNull(), size)


def mix(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """Per row of docs: doc_id, source, size, source_size, target, copies, shards (one for each copy), taken and unit."""
    sized = runtime.checkpointed(docs.select("doc_id", "source", _size().alias("size")))
    sources = runtime.checkpointed(sources_of(sized))
    rows = _with_source(sized, sources).withColumn("block", F.pmod(F.xxhash64(F.lit(seed), "doc_id"), "n_blocks"))
    rows = runtime.checkpointed(rows.withColumn("unit", _unit()))
    blocks = rows.groupBy("source", "rank", "block").agg(F.sum("size").alias("words"), F.first("rest").alias("rest"), F.first("n_blocks").alias("n_blocks"), F.first("passes").alias("passes"))
    permuted = W.partitionBy("rank").orderBy(F.xxhash64(F.lit(seed + 1), "rank", "block"), "block")
    blocks = blocks.withColumn("place", F.row_number().over(permuted).cast("long") - 1)
    blocks = blocks.withColumn("before", F.sum("words").over(permuted.rowsBetween(W.unboundedPreceding, 0)) - F.col("words"))
    blocks = blocks.withColumn("whole", F.col("before") + F.col("words") <= F.col("rest")).withColumn("room", F.when(~F.col("whole") & (F.col("before") < F.col("rest")), F.col("rest") - F.col("before")))
    blocks = runtime.checkpointed(blocks)
    drawn = (F.col("whole") & (F.col("words") > 0)) | F.col("room").isNotNull()
    quotas = blocks.groupBy("source", "rank").agg((F.first("passes") * F.count("*") + F.sum(drawn.cast("long"))).alias("quota"), F.count("*").alias("filled"))
    cuts = split_quotas(quotas, seed=seed).select("rank", "cuts", "filled")
    # the block where the target falls: one for each source, of about BLOCK_DOCS documents
    edge = blocks.where("room IS NOT NULL").select("rank", "block", "room")
    inside = rows.where("size > 0").join(edge, ["rank", "block"]).groupBy("rank", "block", "room", "unit").agg(F.sum("size").alias("size"))
    ordered = F.struct((-F.col("size")).alias("minus"), F.xxhash64(F.lit(seed + 2), "unit").alias("h"), "unit")
    inside = inside.groupBy("rank", "block", "room").agg(F.array_sort(F.collect_list(ordered)).alias("docs"))
    start = F.struct(F.col("room").alias("room"), F.array().cast("array<bigint>").alias("taken"), F.lit(None).cast("struct<minus:bigint,h:bigint,unit:bigint>").alias("next"))

    def step(acc: Column, d: Column) -> Column:
        fits = -d["minus"] <= acc["room"]
        return F.struct(
            F.when(fits, acc["room"] + d["minus"]).otherwise(acc["room"]).alias("room"),
            F.when(fits, F.concat(acc["taken"], F.array(d["unit"]))).otherwise(acc["taken"]).alias("taken"),
            F.when(fits, acc["next"]).otherwise(d).alias("next"),
        )

    def end(acc: Column) -> Column:
        nearer = acc["next"].isNotNull() & (-acc["next"]["minus"] - acc["room"] < acc["room"])
        return F.when(nearer, F.concat(acc["taken"], F.array(acc["next"]["unit"]))).otherwise(acc["taken"])

    partly = inside.select("rank", "block", F.explode(F.aggregate("docs", start, step, end)).alias("unit"), F.lit(1).cast("long").alias("more"))
    placed = blocks.join(cuts, "rank").select("rank", "block", "place", "filled", "whole", "cuts")
    out = rows.join(placed, ["rank", "block"]).join(partly, ["rank", "block", "unit"], "left")
    copies = F.when(F.col("size") > 0, F.col("passes") + F.when(F.col("whole"), 1).otherwise(F.coalesce("more", F.lit(0)))).otherwise(0).cast("long")
    out = out.withColumn("copies", F.least(copies, F.lit(int(MOST))))

    def shard(k: Column) -> Column:
        draw = k * F.col("filled") + F.col("place")
        last = F.col("passes") * F.col("filled") + F.col("place")
        at = F.when(k < F.col("passes"), draw).otherwise(last)
        return (F.size(F.filter("cuts", lambda c: c <= at)) - 1).cast("int")

    shards = F.when(F.col("copies") > 0, F.transform(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1), shard)).otherwise(F.array().cast("array<int>"))
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", shards.alias("shards"), (F.col("copies") * F.col("size")).alias("taken"), "unit")


def mixed(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """The rows of docs as often as the mix takes them, dealt to its shards and shuffled there."""
    names = docs.columns
    # one row for each unit, so that each row of docs meets one
    chosen = mix(docs, seed).where("copies > 0").groupBy(F.col("unit").alias("mix_unit")).agg(F.first("shards").alias("mix_shards"))
    own = docs.select(_unit(_size()).alias("mix_own_unit"), F.struct(*(F.col(f"`{c}`") for c in names)).alias("mix_row"))
    rows = own.join(chosen, F.col("mix_own_unit") == F.col("mix_unit")).select("mix_row", "mix_unit", F.posexplode("mix_shards").alias("mix_copy", "mix_shard"))
    order = F.xxhash64(F.lit(seed + 3), "mix_unit", "mix_copy")
    dealt = rows.repartition("mix_shard", F.pmod(F.xxhash64("mix_unit"), F.lit(SALTS))).sortWithinPartitions("mix_shard", order)
    return dealt.select("mix_row.*")


def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = runtime.documents(spark, sf_dir)
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken", "copies", "shards")
