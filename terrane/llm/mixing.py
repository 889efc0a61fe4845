"""Mix sources to target weights with DataFrame functions only.

Every source gets a target number of words.  Its documents are permuted by a
hash; a mix takes all of them some whole number of times, and once more those
up to a cutoff of the hash, and one that fills the rest best.  The hash range is cut into blocks, a unit is one
block of one repetition, and a splitting tree deals each source's units among
the output shards: at every node the left half's share of each source is a
multivariate hypergeometric draw.  Each shard then takes its own units from
the source's permuted list and shuffles its documents locally.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACES, staged

WEIGHTS = (5.0, 2.0, 1.0)
#: A source is repeated so many times at most.
MOST = 3.0
#: Blocks of a source: the leading bits of the 63-bit hash.
BLOCK_BITS = 12
LEVELS = 4
SEED = 20240501
_WORDS = "[ \\t\\n\\x0B\\f\\r]+"


def words(text: str):
    """Words of a text as the contracts count them; null has none."""
    trimmed = F.btrim(text, F.lit(SPACES))
    return F.when(F.coalesce(F.length(trimmed), F.lit(0)) == 0, F.lit(0)).otherwise(F.size(F.split(trimmed, _WORDS))).cast("long")


def keyed(docs: DataFrame, seed: int) -> DataFrame:
    """(doc_id, size, skey, h): a source's key sorts by code point, with null last; h permutes."""
    sized = docs.select("doc_id", "source", words("text").alias("size"))
    return sized.select(
        "doc_id", "size", F.when(F.col("source").isNull(), "n").otherwise(F.concat(F.lit("a"), "source")).alias("skey"),
        F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id", "size"), 1).alias("h"),
    )


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """(skey, source_size, target): all words shared by weight, none above ``most`` times its source.

    Sources run full in the order of size over weight; the first that does
    not fill up settles the level for all that follow.
    """
    sums = sizes.groupBy("skey").agg(F.sum("size").alias("source_size"))
    ranked = sums.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.row_number().over(Window.orderBy("skey")) - 1) % len(weights) + 1))
    order = Window.orderBy(F.col("source_size") / F.col("weight"), "skey")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    full = F.col("source_size") * most
    level = (F.sum("source_size").over(Window.partitionBy()) - F.coalesce(F.sum(full).over(before), F.lit(0.0))) / F.sum("weight").over(
        order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    )
    leveled = ranked.withColumn("level", level).withColumn("level", F.when(F.col("level") * F.col("weight") <= full, F.col("level")))
    settled = F.first("level", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return leveled.select("skey", "source_size", F.least(F.coalesce(settled * F.col("weight"), full), full).alias("target"))


def _below(rows: DataFrame, part: str, room: str) -> DataFrame:
    """For each source (skey, ``room``): the first ``part`` that overruns the room, and the room left there."""
    run = F.sum("size").over(Window.partitionBy("skey").orderBy(part))
    over = rows.withColumn("_run", run).filter(F.col("_run") > F.col(room))
    return over.groupBy("skey").agg(F.min(F.struct(part, (F.col(room) - F.col("_run") + F.col("size")).alias("room"))).alias("m")).select(
        "skey", F.col(f"m.{part}").alias(part), F.col("m.room").alias("room")
    )


def cutoffs(sizes: DataFrame, aims: DataFrame) -> DataFrame:
    """(skey, base, cutoff, extra): every document is taken ``base`` times, and once more where h <= cutoff or h = extra.

    ``extra`` is the one document beyond the cutoff whose size comes nearest
    to what the target still lacks.

    The range of h is searched in two steps of ``2 ** BLOCK_BITS`` parts, so
    a window sees that many sums, then the few documents of the last part.
    """
    first, second = 63 - BLOCK_BITS, 63 - 2 * BLOCK_BITS
    plan = aims.select(
        "skey", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") + 1e-12)).otherwise(0).alias("base"),
        "target", "source_size",
    ).withColumn("room", F.greatest(F.col("target") - F.col("base") * F.col("source_size"), F.lit(0.0)))
    blocks = sizes.groupBy("skey", F.shiftright("h", first).alias("b1")).agg(F.sum("size").alias("size"))
    at1 = staged(_below(blocks.join(plan.select("skey", "room"), "skey"), "b1", "room"), "mix_first")
    inside = sizes.withColumn("b1", F.shiftright("h", first)).join(at1, ["skey", "b1"])
    parts = inside.groupBy("skey", "room", F.shiftright("h", second).alias("b2")).agg(F.sum("size").alias("size"))
    at2 = staged(_below(parts, "b2", "room"), "mix_second")
    last = sizes.withColumn("b2", F.shiftright("h", second)).join(at2, ["skey", "b2"])
    at3 = last.withColumn("_run", F.sum("size").over(Window.partitionBy("skey").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)))
    end = at3.filter(F.col("_run") > F.col("room")).groupBy("skey").agg(F.min(F.struct("_run", "h", "size", "room")).alias("m")).select(
        "skey", (F.col("m.h") - 1).alias("cutoff"), (F.col("m.room") - F.col("m._run") + F.col("m.size")).alias("lacks")
    )
    end = staged(end, "mix_end")
    off = F.abs(F.col("size") - F.col("lacks"))
    beyond = sizes.join(end, "skey").filter((F.col("h") > F.col("cutoff")) & (off < F.col("lacks")))
    extra = beyond.groupBy("skey").agg(F.min(F.struct(off.alias("off"), "h")).alias("m")).select("skey", F.col("m.h").alias("extra"))
    some = F.col("room") > 0
    return plan.join(end, "skey", "left").join(extra, "skey", "left").select(
        "skey", "source_size", "target", "base", F.when(some, F.coalesce("cutoff", F.lit((1 << 63) - 1))).otherwise(F.lit(-1)).alias("cutoff"),
        F.when(some, F.coalesce("extra", F.lit(-1))).otherwise(F.lit(-1)).alias("extra"),
    )


def units(sizes: DataFrame, plan: DataFrame) -> DataFrame:
    """(skey, b1, copy, place, n): the blocks of each repetition in permuted order, 0 to n - 1 in each source."""
    first = 63 - BLOCK_BITS
    blocks = sizes.groupBy("skey", F.shiftright("h", first).alias("b1")).agg(F.min("h").alias("low"))
    more = (F.col("low") <= F.col("cutoff")) | (F.col("b1") == F.shiftright("extra", first))
    copies = F.sequence(F.lit(0), F.col("base").cast("int") - F.when(more, 0).otherwise(1))
    made = blocks.join(plan.select("skey", "base", "cutoff", "extra"), "skey").filter((F.col("base") > 0) | more).select("skey", "b1", F.explode(copies).alias("copy"))
    by = Window.partitionBy("skey")
    return made.select(
        "*", (F.row_number().over(by.orderBy(F.xxhash64(F.lit(SEED), "skey", "copy", "b1"), "copy", "b1")) - 1).alias("place"), F.count("*").over(by).alias("n")
    )


def _log_gamma(x: str) -> str:
    """log of the gamma function of ``x`` > 0, by Stirling's series eight places further on."""
    z = f"(({x}) + 8)"
    down = " * ".join(f"(({x}) + {i})" for i in range(8))
    return f"(({z} - 0.5D) * ln({z}) - {z} + 0.9189385332046727D + 1 / (12D * {z}) - 1 / (360D * pow({z}, 3)) - ln({down}))"


def _log_choose(n: str, k: str) -> str:
    return f"({_log_gamma(f'{n} + 1D')} - {_log_gamma(f'{k} + 1D')} - {_log_gamma(f'{n} - {k} + 1D')})"


def _hypergeometric(good: str, total: str, draws: str, u: str) -> str:
    """SQL: how many of ``draws`` out of ``total`` are ``good``, by inverting the distribution at ``u``.

    Sums run over twelve standard deviations about the mean, clipped to the
    possible range, which is the whole distribution for double precision.
    """
    low, high = f"greatest(0L, {draws} + {good} - {total})", f"least({good}, {draws})"
    mean = f"({draws} * {good} / greatest({total}, 1L))"
    spread = f"(12 * sqrt({mean} + 1D) + 12)"
    start = f"greatest({low}, cast(floor({mean} - {spread}) as bigint))"
    end = f"least({high}, cast(ceil({mean} + {spread}) as bigint))"
    mass = f"exp({_log_choose(good, 'k')} + {_log_choose(f'({total} - {good})', f'({draws} - k)')} - {_log_choose(total, draws)})"
    fold = f"aggregate(sequence({start}, {end}), named_struct('sum', 0D, 'pick', {start}), (s, k) -> named_struct('sum', s.sum + {mass}, 'pick', if(s.sum < {u}, k, s.pick)))"
    return f"if({good} = 0L OR {draws} = 0L, 0L, {fold}.pick)"


def split_quotas(quotas: DataFrame, levels: int = LEVELS, seed: int = SEED) -> DataFrame:
    """(shard, q): unit counts of every source, in the order of ``quotas`` (skey, n), dealt over 2 ** levels shards.

    The counts of a source add up over the shards exactly, and shards differ
    by one unit at most in every halving.
    """
    nodes = quotas.agg(F.array_sort(F.collect_list(F.struct("skey", "n"))).alias("s")).select(F.lit(0).cast("long").alias("shard"), F.expr("transform(s, x -> x.n)").alias("q"))
    draw = _hypergeometric("x.n", "a.rest", "a.m", f"((shiftrightunsigned(xxhash64({seed}, level, shard, x.i), 11) + 0.5D) / 9007199254740992D)")
    for level in range(levels):
        total = F.expr("aggregate(q, 0L, (t, x) -> t + x)")
        numbered = F.expr("transform(q, (n, i) -> named_struct('n', n, 'i', i))")
        state = nodes.select("shard", "q", F.lit(level).alias("level"), numbered.alias("numbered"), total.alias("total"))
        step = f"""aggregate(numbered, named_struct('rest', total, 'm', total div 2, 'out', cast(array() as array<bigint>)),
            (a, x) -> transform(array({draw}), d -> named_struct('rest', a.rest - x.n, 'm', a.m - d, 'out', concat(a.out, array(d))))[0]).out"""
        left = state.withColumn("left", F.expr(step))
        # Written out, or each level would evaluate the one above it twice.
        nodes = staged(
            left.select(F.explode(F.array(
                F.struct((F.col("shard") * 2).alias("shard"), F.col("left").alias("q")),
                F.struct((F.col("shard") * 2 + 1).alias("shard"), F.expr("transform(q, (n, i) -> n - left[i])").alias("q")),
            )).alias("e")).select("e.shard", "e.q"), "mix_tree",
        )
    return nodes


def plan_mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST, levels: int = LEVELS, seed: int = SEED) -> DataFrame:
    """(doc_id, size, skey, h, source_size, target, shards): where each copy of each document goes.

    ``docs`` needs doc_id, source and text.  A null source is a source of its
    own; documents without words are taken as often as the others of their
    source at their place; a source without words has the target 0.  Rows
    that are equal are taken together.
    """
    sizes = staged(keyed(docs, seed), "mix_sizes")
    plan = staged(cutoffs(sizes, staged(targets(sizes, weights, most), "mix_targets")), "mix_plan")
    made = staged(units(sizes, plan), "mix_units")
    per_source = made.groupBy("skey").agg(F.max("n").alias("n"))
    names = per_source.agg(F.array_sort(F.collect_list("skey")).alias("k"))
    tree = split_quotas(per_source, levels, seed)
    # ends: the running sum of a source's quotas over the shards.
    dealt = tree.select("shard", F.posexplode("q").alias("i", "n")).join(names.select(F.posexplode("k").alias("i", "skey")), "i")
    ends = dealt.groupBy("skey").agg(F.array_sort(F.collect_list(F.struct("shard", "n"))).alias("d")).select(
        "skey", F.expr("transform(sequence(1, size(d)), j -> aggregate(slice(d, 1, j), 0L, (t, x) -> t + x.n))").alias("ends")
    )
    placed = made.join(ends, "skey").select("skey", "b1", "copy", F.expr("size(filter(ends, e -> e <= place))").alias("shard"))
    by_block = placed.groupBy("skey", "b1").agg(F.expr("transform(array_sort(collect_list(struct(copy, shard))), x -> x.shard)").alias("of_block"))
    first = 63 - BLOCK_BITS
    joined = sizes.withColumn("b1", F.shiftright("h", first)).join(by_block, ["skey", "b1"], "left").join(plan, "skey")
    times = (F.col("base") + ((F.col("h") <= F.col("cutoff")) | (F.col("h") == F.col("extra"))).cast("int")).cast("int")
    return joined.select("doc_id", "size", "skey", "h", "source_size", "target", F.coalesce(F.slice("of_block", F.lit(1), times), F.array().cast("array<int>")).alias("shards"))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST, levels: int = LEVELS, seed: int = SEED) -> DataFrame:
    """``docs`` with every copy the mix takes as a row, dealt to its shard and shuffled there.

    One partition holds one or more parts of a shard; inside, rows come in
    the order of a hash.  The columns are those of ``docs``.
    """
    names = docs.columns
    plan = plan_mix(docs, weights, most, levels, seed)
    inner = docs.select(
        *[F.col(c).alias(f"c{i}") for i, c in enumerate(names)],
        F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("doc_id"), words("text")), 1).alias("_h"),
        F.when(F.col("source").isNull(), "n").otherwise(F.concat(F.lit("a"), "source")).alias("_skey"),
    )
    # Equal rows share one entry of the plan.
    where = plan.groupBy(F.col("h").alias("_h"), F.col("skey").alias("_skey")).agg(F.min("shards").alias("_shards"))
    copies = inner.join(where, ["_h", "_skey"]).select(*[f"c{i}" for i in range(len(names))], "_h", F.posexplode("_shards").alias("_copy", "_shard"))
    spread = copies.withColumn("_order", F.xxhash64(F.lit(seed + 1), "_h", "_copy"))
    return spread.repartition("_shard", F.pmod("_order", F.lit(64))).sortWithinPartitions("_shard", "_order").select(*[f"c{i}" for i in range(len(names))]).toDF(*names)


def mix_report(docs: DataFrame) -> DataFrame:
    """(doc_id, size, source_size, target, taken, shards) of every document."""
    return plan_mix(docs).select("doc_id", "size", "source_size", "target", (F.col("size") * F.size("shards")).cast("long").alias("taken"), "shards")
