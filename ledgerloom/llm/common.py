"""What the operators of this subpackage share: the word law, permutations, names set aside; durable cuts of lineage come from the library."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..shared import cut, own_path, shared_dir  # noqa: F401

#: A word is a run of anything but the six ASCII blanks.
GAP = r"[\x20\x09-\x0D]+"
NOT_WORD_SQL = r"[\\x20\\x09-\\x0D]+"


def words(text: Column) -> Column:
    """The words of a text in order; a null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), GAP), "")


def n_words(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def permuted(x: str, n: str, key: str, rounds: int = 32, inverse: bool = False) -> str:
    """SQL for the image of x under a keyed pseudorandom permutation of [0, n).

    Swap-or-not (Hoang, Morris and Rogaway, 2012): each round pairs x with K - x mod n and swaps the pair when a hash bit
    of its larger member says so. Every round is its own inverse, so the inverse runs the rounds backwards. It needs no
    table, works for any n and gives the same image on any task.
    """
    order = f"sequence({rounds - 1}, 0, -1)" if inverse else f"sequence(0, {rounds - 1})"
    partner = f"pmod(pmod(xxhash64({key}, r), {n}) - a, {n})"
    return f"aggregate({order}, {x}, (a, r) -> if((xxhash64({key}, r, greatest(a, {partner})) & 1L) = 1L, {partner}, a))"


def own_names(df: DataFrame, *names: str) -> None:
    """Refuse inputs that lack a needed column; columns beyond those needed are passed over."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def set_aside(df: DataFrame, *names: str) -> tuple[DataFrame, dict[str, str]]:
    """(df with its columns called _in0, _in1 and so on, the new name of each): whatever the input's columns are called, they can't meet an operator's own.

    names are needed columns, see ``own_names``. ``restored`` brings the names back.
    """
    own_names(df, *names)
    new = [f"_in{i}" for i in range(len(df.columns))]
    return df.toDF(*new), dict(zip(df.columns, new, strict=True))


def restored(df: DataFrame, at: dict[str, str], skip: tuple[str, ...] = ()) -> list[Column]:
    """The columns of a frame that was set aside under their own names, but those in skip."""
    return [F.col(new).alias(old) for old, new in at.items() if old not in skip]


def row_keys(*cols: Column) -> list[Column]:
    """Two hashes of the columns, _k1 and _k2, that tell rows apart by 128 bits."""
    return [F.xxhash64(*cols).alias("_k1"), F.xxhash64(F.lit(7), *cols).alias("_k2")]


def sums_before(df: DataFrame, key: list[str], order: str, value: str, to: str, run: int = 4096) -> DataFrame:
    """df (one row for each key and order, an int from 0) with to: the sum of value over the key's rows of smaller order.

    Runs of orders are summed first, so no task orders all rows of a key, only its runs.
    """
    part = df.withColumn("_run", F.expr(f"`{order}` div {run}"))
    runs = part.groupBy(*key, "_run").agg(F.sum(value).alias("_all"))
    runs = runs.select(*key, "_run", (F.sum("_all").over(Window.partitionBy(*key).orderBy("_run")) - F.col("_all")).alias("_ahead"))
    inside = F.sum(value).over(Window.partitionBy(*key, "_run").orderBy(order)) - F.col(value)
    return part.withColumn("_inside", inside).join(runs, [*key, "_run"]).withColumn(to, F.col("_ahead") + F.col("_inside")).drop("_run", "_ahead", "_inside")
