"""Order-dependent columns that stay spread over tasks when one key holds a large share of the rows.

A plain ``partitionBy(key)`` window sends a whole key to one task.  Here a key is cut into consecutive chunks:

* ``position``: row numbers from per-chunk row numbers plus the size of the earlier chunks;
* ``rolling``: bounded windows on blocks, each block carrying a copy of the last rows of the block before;
* ``recurrence``: ``y = q*y' + b`` solved inside chunks, chunk results chained through a small table.
"""
from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

CHUNK = 256            # rows per chunk of a recurrence; q**256 stays far above the double underflow
BLOCK = 4096           # rows per block of a rolling window


def position(df: DataFrame, keys: list[str], chunk: list[str], order: list, out: str = "pos") -> DataFrame:
    """1-based row number along ``keys``; ``chunk`` columns must be the leading part of the ordering."""
    sizes = df.groupBy(*keys, *chunk).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy(*chunk).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*keys, *chunk, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    inside = Window.partitionBy(*keys, *chunk).orderBy(*order)
    return (df.withColumn("_rn", F.row_number().over(inside))
              .join(offsets, [*keys, *chunk])
              .withColumn(out, (F.col("_off") + F.col("_rn")).cast("long"))
              .drop("_off", "_rn"))


def rolling(df: DataFrame, keys: list[str], pos: str, back: int, columns: Callable[[Window], dict[str, Column]],
            block: int = BLOCK) -> DataFrame:
    """Window columns that look at most ``back`` rows behind; ``pos`` is a gap-free 1-based row number."""
    block = max(block, back)
    home = F.floor((F.col(pos) - 1) / block)
    in_tail = F.pmod(F.col(pos) - 1, F.lit(block)) >= block - back
    copies = F.when(in_tail, F.array(home, home + 1)).otherwise(F.array(home))
    spread = df.withColumn("_blk", F.explode(copies))
    w = Window.partitionBy(*keys, "_blk").orderBy(pos)
    return spread.withColumns(columns(w)).where(F.col("_blk") == home).drop("_blk")


@dataclass(frozen=True)
class Smooth:
    """A moving average seeded with the mean of its first ``n`` inputs (from row ``start``), then
    ``(1-k)*previous + k*value``; ``k`` is 2/(n+1) for an EMA and 1/n for Wilder's."""
    out: str
    value: str
    n: int
    wilder: bool = False
    start: int = 1
    seed_first: bool = False      # seed with the first value instead of a mean (the ema_hold check)

    @property
    def k(self) -> float:
        return 1.0 / self.n if self.wilder else 2.0 / (self.n + 1)


def recurrence(df: DataFrame, keys: list[str], pos: str, specs: list[Smooth]) -> DataFrame:
    """All ``specs`` in one pass over ``keys`` ordered by the gap-free ``pos``.

    In a chunk of 256 rows the recurrence has the closed form ``y_j = w_j*(y_in + sum(b_i/w_i))`` with
    ``w_j = q**(decays so far)``, a running window sum.  A chunk is summarised by the pair (w, s) of its last row: what it makes of an
    incoming y is ``w*y + s``, and such pairs compose.  They are composed per super-chunk (256 chunks), the pairs of the super-chunks along the key
    (one for 65,536 rows), and every chunk receives the exact value before it; nothing is cut off, for any smoothing length.
    """
    chunk = F.floor((F.col(pos) - 1) / CHUNK).cast("long")
    df = df.withColumn("_c", chunk)
    w = Window.partitionBy(*keys, "_c").orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    weights, locals_ = {}, {}
    for s in specs:
        q = 1.0 - s.k
        seed_at = s.start if s.seed_first else s.start + s.n - 1
        first = F.col("_c") * CHUNK                              # last position before this chunk
        decays = F.greatest(F.lit(0), F.col(pos) - F.greatest(first, F.lit(seed_at)))
        weight = F.pow(F.lit(q), decays) if q > 0 else F.when(decays > 0, F.lit(0.0)).otherwise(F.lit(1.0))
        seed_share = F.lit(1.0) if s.seed_first else F.lit(1.0 / s.n)
        inflow = (F.when(F.col(pos) < s.start, F.lit(0.0))
                   .when(F.col(pos) <= seed_at, F.col(s.value) * seed_share)
                   .otherwise(F.col(s.value) * F.lit(s.k)))
        weights[f"_w_{s.out}"] = weight
        if q > 0:
            locals_[f"_s_{s.out}"] = F.col(f"_w_{s.out}") * F.sum(inflow / F.col(f"_w_{s.out}")).over(w)
        else:
            locals_[f"_s_{s.out}"] = F.when(F.col(pos) < s.start, F.lit(0.0)).otherwise(F.col(s.value))
    local = df.withColumns(weights).withColumns(locals_)

    ends = [f(f"_{p}_{s.out}") for s in specs for p, f in (("w", F.col), ("s", F.col))]
    last = F.struct(*ends)
    chunks = (local.groupBy(*keys, "_c").agg(F.max_by(last, F.col(pos)).alias("_e"))
                   .select(*keys, "_c", F.floor(F.col("_c") / CHUNK).cast("long").alias("_b"), "_e.*"))
    # carry: what stands before each chunk of a super-chunk, as a pair applied to what stands before the super-chunk
    inside = _carried(chunks, keys, "_b", "_c", specs)
    whole = inside.select(*keys, "_b", F.element_at("_rows", -1).alias("_l")).select(
        *keys, "_b", *[F.col(f"_l.{p}_{s.out}").alias(f"_{c}_{s.out}") for s in specs for p, c in (("p", "w"), ("y", "s"))])
    before = _carried(whole.withColumn("_all", F.lit(0)), keys, "_all", "_b", specs).select(*keys, F.explode("_rows").alias("_l")).where("_l._c is not null").select(
        *keys, F.col("_l._c").alias("_b"), *[F.col(f"_l.y_{s.out}").alias(f"_in_{s.out}") for s in specs])
    entry = (inside.join(before, [*keys, "_b"]).select(*keys, *[f"_in_{s.out}" for s in specs], F.explode("_rows").alias("_r")).where("_r._c is not null")
                   .select(*keys, F.col("_r._c").alias("_c"), *[(F.col(f"_r.y_{s.out}") + F.col(f"_r.p_{s.out}") * F.col(f"_in_{s.out}")).alias(f"_y_{s.out}") for s in specs]))
    joined = local.join(entry, [*keys, "_c"])
    final = {s.out: F.when(F.col(pos) >= (s.start if s.seed_first else s.start + s.n - 1),
                           F.col(f"_w_{s.out}") * F.col(f"_y_{s.out}") + F.col(f"_s_{s.out}")) for s in specs}
    return joined.withColumns(final).drop("_c", *weights, *locals_, *[f"_y_{s.out}" for s in specs])


def _carried(pairs: DataFrame, keys: list[str], group: str, order: str, specs: list[Smooth]) -> DataFrame:
    """Per (keys, group): ``_rows``, the composed pair (p, y) that stands before each row of the group (``_c``: its number), and the pair of the whole group
    as last element (``_c`` NULL).  Input: pairs ``_w_*``, ``_s_*`` of consecutive rows."""
    rows = F.sort_array(F.collect_list(F.struct(F.col(order).alias("_c"), *[c for s in specs for c in (f"_w_{s.out}", f"_s_{s.out}")])))
    grouped = pairs.groupBy(*keys, group).agg(rows.alias("_in"))
    fields = ", ".join(f"{p}_{s.out}: double" for s in specs for p in ("y", "p"))
    carry_t = f"struct<_c: bigint, {fields}>"

    def carry(acc, number):
        return F.struct(number.alias("_c"), *[acc[f"{p}_{s.out}"].alias(f"{p}_{s.out}") for s in specs for p in ("y", "p")]).cast(carry_t)

    def step(acc, x):
        nxt = []
        for s in specs:
            nxt.append((x[f"_w_{s.out}"] * acc[f"y_{s.out}"] + x[f"_s_{s.out}"]).alias(f"y_{s.out}"))
            nxt.append((x[f"_w_{s.out}"] * acc[f"p_{s.out}"]).alias(f"p_{s.out}"))
        return F.struct(*nxt, F.concat(acc["rows"], F.array(carry(acc, x["_c"]))).alias("rows"))
    zero = F.struct(*[F.lit(v).alias(f"{p}_{s.out}") for s in specs for p, v in (("y", 0.0), ("p", 1.0))], F.array().cast(f"array<{carry_t}>").alias("rows"))
    none = F.lit(None).cast("bigint")
    return grouped.select(*keys, group, F.aggregate("_in", zero, step, lambda acc: F.concat(acc["rows"], F.array(carry(acc, none)))).alias("_rows"))


def running_sum(df: DataFrame, keys: list[str], pos: str, col: str, out: str, block: int = BLOCK) -> DataFrame:
    """Cumulative sum along a key: a window inside each block plus the totals of the earlier blocks."""
    b = df.withColumn("_b", F.floor((F.col(pos) - 1) / block))
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (b.groupBy(*keys, "_b").agg(F.sum(col).alias("_t"))
                .select(*keys, "_b", F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_o")))
    inside = Window.partitionBy(*keys, "_b").orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    return (b.withColumn("_i", F.sum(col).over(inside)).join(offsets, [*keys, "_b"])
             .withColumn(out, F.col("_o") + F.col("_i")).drop("_o", "_i", "_b"))


def segments(df: DataFrame, keys: list[str], chunk: list[str], order: list, needed: list[str]) -> DataFrame:
    """Rows with all ``needed`` inputs, with ``seg`` (number of incomplete rows before) and ``pos`` inside the segment."""
    complete = F.lit(True)
    for c in needed:
        complete = complete & F.col(c).isNotNull()
    numbered = position(df, keys, chunk, order, "_p").withColumn("_bad", (~complete).cast("long"))
    s = running_sum(numbered, keys, "_p", "_bad", "seg").where("_bad = 0").drop("_bad", "_p")
    return position(s, [*keys, "seg"], chunk, order, "pos")


def previous(df: DataFrame, keys: list[str], pos: str, cols: dict[str, str], back: int = 1) -> DataFrame:
    """``cols`` maps a new name to the column whose value ``back`` rows ago it holds."""
    return rolling(df, keys, pos, back, lambda w: {new: F.lag(old, back).over(w) for new, old in cols.items()})


def running(df: DataFrame, keys: list[str], chunk: list[str], order: list, specs: dict[str, tuple[str, Column]]) -> DataFrame:
    """Running values up to and including each row; ``specs`` maps a name to ('max' | 'min' | 'sum' | 'last', column).

    Works inside (keys, chunk); one row per chunk carries the value of the earlier chunks over.
    """
    inside = Window.partitionBy(*keys, *chunk).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy(*chunk).rowsBetween(Window.unboundedPreceding, -1)
    agg = {"max": F.max, "min": F.min, "sum": F.sum}
    src = df.withColumns({f"_x_{n}": c for n, (_, c) in specs.items()})
    at = F.struct(*order)
    ends = src.groupBy(*keys, *chunk).agg(*[
        (F.max_by(f"_x_{n}", F.when(F.col(f"_x_{n}").isNotNull(), at)) if k == "last" else agg[k](f"_x_{n}")).alias(f"_e_{n}")
        for n, (k, _) in specs.items()])
    carry = ends.select(*keys, *chunk, *[
        (F.last(f"_e_{n}", ignorenulls=True) if k == "last" else agg[k](f"_e_{n}")).over(before).alias(f"_k_{n}")
        for n, (k, _) in specs.items()])
    local = src.withColumns({f"_i_{n}": (F.last(f"_x_{n}", ignorenulls=True) if k == "last" else agg[k](f"_x_{n}")).over(inside)
                             for n, (k, _) in specs.items()})
    j = local.join(carry, [*keys, *chunk])

    def combined(n, k):
        i, c = F.col(f"_i_{n}"), F.col(f"_k_{n}")
        if k == "last":
            return F.coalesce(i, c)
        if k == "sum":
            return F.when(i.isNull() & c.isNull(), None).otherwise(F.coalesce(i, F.lit(0)) + F.coalesce(c, F.lit(0)))
        return F.greatest(i, c) if k == "max" else F.least(i, c)
    done = j.withColumns({n: combined(n, k) for n, (k, _) in specs.items()})
    return done.drop(*[f"_{p}_{n}" for n in specs for p in "xik"])


def lagged(df: DataFrame, keys: list[str], chunk: list[str], order: list, cols: dict[str, str]) -> DataFrame:
    """``cols`` maps a new name to the column whose previous value (along keys, chunk, order) it holds."""
    w = Window.partitionBy(*keys, *chunk).orderBy(*order)
    ends = df.groupBy(*keys, *chunk).agg(F.max_by(F.struct(*cols.values()), F.struct(*order)).alias("_end"))
    cw = Window.partitionBy(*keys).orderBy(*chunk)
    carry = ends.select(*keys, *chunk, F.lag("_end").over(cw).alias("_carry"))
    j = df.withColumn("_rn", F.row_number().over(w)).withColumns({n: F.lag(c).over(w) for n, c in cols.items()}).join(carry, [*keys, *chunk])
    return j.withColumns({n: F.when(F.col("_rn") == 1, F.col("_carry")[c]).otherwise(F.col(n)) for n, c in cols.items()}).drop("_rn", "_carry")
