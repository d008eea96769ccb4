"""Exact random contingency tables drawn with SQL expressions only.

``matrix`` draws how many items of each colour go to each row so that row sums and colour sums are exact and every
arrangement of the items is equally likely (the multivariate hypergeometric law, which is also the multinomial law given
its totals). Rows are halved level by level: one draw splits a node's colour counts between its halves, so the nodes of a
level are independent and the work of a level is spread over tasks once it is large.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Past this many nodes the level is dealt over tasks.
SPREAD_AT = 64
#: Levels of the tree whose sizes one array holds.
TIER = 12


def univariate(total: str, good: str, n: str, seed: str) -> str:
    """SQL for one hypergeometric draw: how many of n items, of total with good marked, are marked.

    The probabilities follow from their ratios, over nine standard deviations to both sides of the mean (what lies
    beyond has less than 1e-17 of the mass), and one is kept with its chance among those seen so far. Steps: about 18
    standard deviations, thus about the square root of the count.
    """
    mean = f"(cast({n} as double) * {good} / greatest({total}, 1))"
    sd = f"sqrt({mean} * greatest(0d, 1 - cast({good} as double) / greatest({total}, 1)))"
    lo = f"greatest(0L, {n} - ({total} - {good}), cast(floor({mean} - 9 * {sd} - 15) as bigint))"
    hi = f"least({n}, {good}, cast(ceil({mean} + 9 * {sd} + 15) as bigint))"
    u = f"(shiftrightunsigned(xxhash64({seed}, k), 11) / 9007199254740992d)"
    ratio = f"(cast({good} - k as double) * ({n} - k) / (cast(k + 1 as double) * ({total} - {good} - {n} + k + 1)))"
    return (
        f"aggregate(sequence({lo}, {hi}), named_struct('w', 1d, 't', 0d, 'pick', {lo}), "
        f"(p, k) -> named_struct('w', p.w * {ratio}, 't', p.t + p.w, 'pick', if({u} * (p.t + p.w) < p.w, k, p.pick)), p -> p.pick)"
    )


def _split(caps: str, total: str, n: str, seed: str) -> str:
    """SQL for the colour counts of a node's left half, which has n of the node's total items."""
    draw = univariate("acc.total", "element_at(%s, j)" % caps, "acc.n", f"{seed}, j")
    return (
        f"aggregate(sequence(1, size({caps})), named_struct('n', {n}, 'total', {total}, 'k', 0L, 'out', cast(array() as array<bigint>)), "
        f"(acc, j) -> transform(array({draw}), k1 -> named_struct('n', acc.n - k1, 'total', acc.total - element_at({caps}, j), 'k', k1, 'out', array_append(acc.out, k1)))[0], "
        f"acc -> acc.out)"
    )


def matrix(sizes: DataFrame, caps: DataFrame, levels: int, seed: int) -> DataFrame:
    """A row for each of 2**levels rows: row int, counts and offsets array<bigint> by colour.

    sizes: row int (from 0; absent rows are empty), n bigint. caps: one row, caps array<bigint>; both sum to the same.
    offsets are the counts of all rows before. An array holds the sizes of 2**TIER rows at most: a deeper tree is drawn
    from its upper part, whose rows are runs of those below.
    """
    depth = min(levels, TIER)
    held = sizes.groupBy(F.expr(f"cast(shiftright(row, {depth}) as int)").alias("row")).agg(F.expr(f"map_from_entries(collect_list(struct(cast(row & {2**depth - 1} as int), cast(n as bigint))))").alias("m"))
    if levels > TIER:
        coarse = sizes.groupBy(F.expr(f"cast(shiftright(row, {depth}) as int)").alias("row")).agg(F.sum("n").alias("n"))
        above = matrix(coarse, caps, levels - depth, seed).select("row", F.col("counts").alias("caps"), F.col("offsets").alias("offs"))
        nodes = above.join(held, "row", "left")
    else:
        root = caps.select(F.lit(0).alias("row"), "caps", F.expr("transform(caps, c -> 0L)").alias("offs"))
        nodes = root.join(held, "row", "left")
    nodes = nodes.select("row", F.expr(f"transform(sequence(0, {2**depth - 1}), i -> coalesce(element_at(m, i), 0L))").alias("sizes"), "caps", "offs")
    for level in range(depth):
        half = 2 ** (depth - level - 1)
        add = "(s, x) -> s + x"
        nodes = nodes.withColumn("n", F.expr(f"aggregate(slice(sizes, 1, {half}), 0L, {add})")).withColumn("total", F.expr(f"aggregate(sizes, 0L, {add})"))
        nodes = nodes.withColumn("left", F.expr(_split("caps", "total", "n", f"{seed}L, {levels - depth + level}, row")))
        nodes = nodes.select(
            F.explode(
                F.expr(
                    f"array(named_struct('row', row * 2, 'sizes', slice(sizes, 1, {half}), 'caps', left, 'offs', offs), "
                    f"named_struct('row', row * 2 + 1, 'sizes', slice(sizes, {half + 1}, {half}), 'caps', zip_with(caps, left, (a, b) -> a - b), 'offs', zip_with(offs, left, (a, b) -> a + b)))"
                )
            ).alias("x")
        ).select("x.*")
        if levels == depth and 2 ** (level + 1) == SPREAD_AT and level + 1 < depth:
            nodes = nodes.repartition(SPREAD_AT, "row")
    return nodes.select("row", F.col("caps").alias("counts"), F.col("offs").alias("offsets"))
