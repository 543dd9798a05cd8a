"""Candidates for rows out of a pool, without pairs of all with all: entries of a key stand in a ring, and a row takes some from a place of its own on.

Two kinds of rings: circles, arrays of about a thousand entries that a key is dealt to by hash; and one ring for a key, by row numbers, in which a
group's entries stand together, so that a row can jump over its own group. Tiers are filled one after the other, each only for rows that are short.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradus.functions import row
from gradus.operators.numbered import numbered
from gradus.sources import scratch

CIRCLE = 1000


def number(text: Column) -> Column:
    """The first 60 bits of the text's SHA-1."""
    return F.conv(F.substring(row.sha1(text), 1, 15), 16, 10).cast("long")


def circled(rows: DataFrame, pool: DataFrame, row_id: str, key: str, pool_id: str, entry: str, reach: int, circle: int = CIRCLE) -> DataFrame:
    """``rows`` with drawn ARRAY<STRUCT<id, entry>>: of the pool's entries with the row's ``key`` the ``reach`` that follow its own place in its circle, or
    all if there are fewer. A key with more than ``circle`` entries is dealt to as many circles as that asks for, by hash, so that a key with a third of all
    rows is spread, and every key that has entries gives some to each of its rows. A row without a key or entries gets an empty array."""
    shares = pool.groupBy(F.col(key).alias("s_key")).agg(F.ceil(F.count("*") / circle).cast("long").alias("c_shares"))
    told = pool.select(F.col(key).alias("p_key"), F.struct(row.sha1(F.col(pool_id).cast("string")).alias("h"), F.col(pool_id).alias("id"), F.col(entry).alias("entry")).alias("e"))
    held = told.join(shares, F.col("p_key") == F.col("s_key")).withColumn("p_share", F.pmod(number(F.col("e.id").cast("string")), F.col("c_shares")))
    ring = F.transform(F.sort_array(F.collect_list("e")), lambda e: F.struct(e["id"].alias("id"), e["entry"].alias("entry")))
    # a row meets a stretch of its circle, not all of it: twice the reach from each multiple of the reach on, or a small circle as it is
    n, small = F.col("c_n"), F.col("c_n") <= 2 * reach
    steps = lambda m: F.sequence(F.lit(0).cast("long"), m)
    cut = F.transform(steps(F.floor((n - 1) / reach)), lambda b: F.struct(b.alias("c_block"), F.transform(steps(F.lit(2 * reach - 1).cast("long")), lambda i: F.get("c_ring", F.pmod(b * reach + i, n).cast("int"))).alias("c_ring")))
    whole = F.array(F.struct(F.lit(0).cast("long").alias("c_block"), F.col("c_ring")))
    circles = held.groupBy("p_key", "p_share").agg(ring.alias("c_ring"), F.count("*").alias("c_n"))
    blocks = circles.select("p_key", "p_share", F.inline(F.when(small, whole).otherwise(cut)))
    sizes = held.groupBy(F.col("p_key").alias("n_key"), F.col("p_share").alias("n_share")).agg(F.count("*").alias("c_n"))
    # dealt anew by row, as what follows is much work for rows that a scan may read in one task
    mine = rows.repartition(F.col(row_id)).join(shares, F.col(key) == F.col("s_key"), "left").withColumn("c_mine", F.pmod(number(F.col(row_id).cast("string")), F.col("c_shares")))
    mine = mine.join(sizes, (F.col(key) == F.col("n_key")) & (F.col("c_mine") == F.col("n_share")), "left")
    mine = mine.withColumn("c_start", F.pmod(number(F.concat(F.col(row_id).cast("string"), F.lit(":at"))), n))
    mine = mine.withColumn("c_at", F.when(small, F.lit(0).cast("long")).otherwise(F.floor(F.col("c_start") / reach)))
    met = mine.join(blocks, (F.col(key) == F.col("p_key")) & (F.col("c_mine") == F.col("p_share")) & (F.col("c_at") == F.col("c_block")), "left")
    start, width = F.col("c_start") - F.col("c_at") * reach, F.size("c_ring").cast("long")
    drawn = F.transform(F.sequence(F.lit(1).cast("long"), F.least(F.lit(reach).cast("long"), n)), lambda i: F.get("c_ring", F.pmod(start + i, width).cast("int")))
    none = F.array().cast(met.schema["c_ring"].dataType)
    return met.select(*rows.columns, F.when(F.col("c_ring").isNull(), none).otherwise(drawn).alias("drawn"))


def ringed(rows: DataFrame, pool: DataFrame, row_id: str, key: str, group: str, entry: str, reach: int) -> DataFrame:
    """``rows`` with drawn ARRAY<STRUCT<id, entry>>: ``reach`` different entries with the row's ``key`` outside its own ``group``, or all if there are fewer;
    id is the entry's group. ``row_id`` tells the rows apart.

    Entries are numbered by key, then group. A key's numbers are a ring, in which the others than the row's group are an arc that begins where the
    group ends; the row takes places at equal distances on it. Nothing is drawn and dropped, and no row goes without that has an entry outside its group."""
    md5 = lambda c: F.md5(F.col(c).cast("string").cast("binary"))
    entries = pool.select(F.col(key).alias("e_key"), F.col(group).alias("e_group"), F.col(entry).alias("e_entry")).where("e_key is not null and e_group is not null").distinct()
    ring = numbered(entries, md5("e_key"), "e_key", md5("e_group"), "e_group", md5("e_entry"), "e_entry")
    groups = ring.groupBy("e_key", "e_group").agg(F.min("number").alias("g_first"), F.count("*").alias("g_n"))
    keys = groups.groupBy(F.col("e_key").alias("k_key")).agg(F.min("g_first").alias("k_first"), F.sum("g_n").alias("k_n"))
    own = rows.select(F.col(row_id).alias("r_id"), F.col(key).alias("r_key"), F.col(group).alias("r_group"))
    placed = own.join(keys, F.col("r_key") == F.col("k_key")).join(groups, (F.col("r_key") == F.col("e_key")) & F.col("r_group").eqNullSafe(F.col("e_group")), "left")
    others = F.col("k_n") - F.coalesce("g_n", F.lit(0))
    end = F.coalesce(F.col("g_first") + F.col("g_n") - F.col("k_first"), F.lit(0))
    step = F.greatest(F.floor(F.col("r_m") / reach), F.lit(1))
    placed = placed.select("r_id", "k_first", "k_n", end.alias("r_end"), others.alias("r_m"), number(F.concat(F.col("r_id").cast("string"), F.lit(":at"))).alias("r_at")).where("r_m > 0")
    wanted = placed.select("r_id", "k_first", "k_n", "r_end", "r_m", "r_at", F.explode(F.sequence(F.lit(0).cast("long"), F.least(F.lit(reach).cast("long"), F.col("r_m")) - 1)).alias("r_i"))
    on_arc = F.pmod(F.col("r_at") + F.col("r_i") * step, F.col("r_m"))
    wanted = wanted.select("r_id", "r_i", (F.col("k_first") + F.pmod(F.col("r_end") + on_arc, F.col("k_n"))).alias("r_number"))
    pairs = wanted.join(ring, F.col("r_number") == F.col("number")).select("r_id", F.struct("r_i", F.col("e_group").alias("id"), F.col("e_entry").alias("entry")).alias("e"))
    drawn = pairs.groupBy("r_id").agg(F.transform(F.array_sort(F.collect_list("e")), lambda e: F.struct(e["id"].alias("id"), e["entry"].alias("entry"))).alias("drawn"))
    met = rows.join(drawn, F.col(row_id) == F.col("r_id"), "left")
    return met.select(*rows.columns, F.coalesce("drawn", F.array().cast(met.schema["drawn"].dataType)).alias("drawn"))


def tiered(rows: DataFrame, want: str, tiers: Sequence[Callable[[DataFrame], DataFrame]], fits: Callable[[Column], Column]) -> DataFrame:
    """``rows`` with found ARRAY<STRUCT<entry, tier>>: up to ``want`` different entries that fit, those of the first tier first. A tier is a function that
    adds drawn, as above; it gets only the rows that are still short. ``fits`` says of an entry whether the row may have it. A tier has to draw as many more as it may
    have to leave: those that do not fit and those that the row has. What a tier but the last has
    filled is written once, so that its rows are not drawn again for the next one."""
    done, short = [], rows.withColumn("found", F.array().cast("array<struct<entry:string,tier:int>>"))
    for tier, draw in enumerate(tiers, 1):
        drawn = draw(short).withColumn("f_had", F.transform("found", lambda f: f["entry"]))
        new = F.array_distinct(F.transform("drawn", lambda d: d["entry"].cast("string")))
        new = F.filter(new, lambda e: fits(e) & ~F.array_contains("f_had", e))
        new = F.transform(F.slice(new, F.lit(1), F.greatest(F.col(want) - F.size("found"), F.lit(0))), lambda e: F.struct(e.alias("entry"), F.lit(tier).alias("tier")))
        short = drawn.withColumn("found", F.concat("found", new)).drop("drawn", "f_had")
        if tier < len(tiers):
            filled = scratch.written(short, "tier")
            enough = F.size("found") >= F.coalesce(want, F.lit(0))
            done.append(filled.where(enough))
            short = filled.where(~enough)
    return reduce(DataFrame.unionByName, [*done, short])
