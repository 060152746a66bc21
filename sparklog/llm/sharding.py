"""Balanced label propagation: linked documents move towards their neighbours' shards under quotas.

Documents are vertices; a group (here: equal texts) links all its members. The links are never listed: the members of
a group that are in one shard are a cell, cells are what moves, and a member's neighbours are counted from them. A
group is one row that holds its cells, no more than there are shards, so that a round is a scan of the groups. It gives
each shard its free room, deals that room out among the shards that members want to leave, and lets a hashed share of
the movers go, so that no shard passes its quota by more than chance; a last pass makes the sizes exact. There groups stay or move as wholes, those
that move fill the free room one after another, and single documents fill what is left, so that of the groups that
fit into a shard at most one for each border between two shards' rooms is cut, at any size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch

#: Rows that one task numbers at a time.
BLOCK_ROWS = 20_000


def _share(*cols) -> Column:
    """A number in [0, 1) fixed by the columns."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 11) / F.lit(float(2**53))


def numbered(df: DataFrame, by: list[str], order: list[str], name: str, rows: int) -> DataFrame:
    """Numbers the rows of each ``by`` from 0 without gaps, in blocks of about BLOCK_ROWS, then sums of block sizes.

    Blocks follow a hash of ``order``; equal rows share a block, so that the numbering is the same in every run.
    """
    blocks = max(1, rows // BLOCK_ROWS)
    dealt = df.withColumn("__block", F.pmod(F.xxhash64(*order), F.lit(blocks)).cast("int"))
    counts = dealt.groupBy(*by, "__block").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(*by).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*by, "__block", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    within = F.row_number().over(Window.partitionBy(*by, "__block").orderBy(*order)) - 1
    return dealt.withColumn("__within", within).join(starts, [*by, "__block"]).withColumn(name, (F.col("__start") + F.col("__within")).cast("long")).drop("__block", "__within", "__start")


def summed(df: DataFrame, by: list[str], order: list[str], count: str, name: str, rows: int) -> DataFrame:
    """Running sums of ``count`` over the rows before within each ``by``, in blocks like those of ``numbered``.

    Larger counts come first, by powers of two.
    """
    blocks = max(1, rows // BLOCK_ROWS)
    dealt = df.withColumn("__block", (F.pmod(F.xxhash64(*order), F.lit(blocks)) - F.floor(F.log2(count)) * blocks).cast("long"))
    counts = dealt.groupBy(*by, "__block").agg(F.sum(count).alias("__n"))
    before = lambda keys, order: F.coalesce(F.sum("__n" if order == ["__block"] else count).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select(*by, "__block", before(by, ["__block"]).alias("__start"))
    within = dealt.withColumn("__within", before([*by, "__block"], order))
    return within.join(starts, [*by, "__block"]).withColumn(name, F.col("__start") + F.col("__within")).drop("__block", "__within", "__start")


def _merged(cells: Column) -> Column:
    """The cells of a group, those in one shard as one."""
    count = lambda s: F.aggregate(F.filter(cells, lambda c: c["shard"] == s), F.lit(0).cast("long"), lambda n, c: n + c["n"])
    return F.transform(F.array_distinct(F.transform(cells, lambda c: c["shard"])), lambda s: F.struct(s.alias("shard"), count(s).alias("n")))


def parts_of(sizes: list[int], room: list[int]) -> list[list[tuple[int, int, int]]]:
    """For each large group the first and last place and the shard of its parts; takes the room that they fill.

    A group fills empty shards as far as it can; its remainder goes to the shard that it fits best.
    """
    out = []
    for n in sizes:
        first, parts = 0, []
        while first < n:
            left = n - first
            fits = [(r, s) for s, r in enumerate(room) if r >= left]
            most = max(room)
            shard = min(fits)[1] if fits else room.index(most)
            take = min(left, room[shard])
            parts.append((first, first + take - 1, shard))
            room[shard] -= take
            first += take
        out.append(parts)
    return out


def shard_documents(docs: DataFrame, *, shards: int = 16, rounds: int = 6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, size, text_crc32, law, shard, slot, grown_shard``.

    The law is ``rows``: the numbers of documents in any two shards differ by one at most. Equal texts are linked
    and meet in one shard unless their group is larger than a shard, which is then filled by that group. Sizes are
    UTF-8 bytes plus 1; null texts count as groups of one, without bytes. Repeated rows each take a place. Null ids
    are numbered like any other. Empty tables give no rows; other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession)
    text = F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8")
    slim = docs.select(
        F.col(id_col).alias("doc_id"), (F.length(text) + F.lit(1)).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
        F.when(F.col(text_col).isNotNull(), F.xxhash64(text)).alias("h1"), F.xxhash64(F.lit(7), text).alias("h2"),
    )
    # members begin anywhere, and are met by the groups' rows there, so that no group's members are in one task
    start = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(shards)).cast("int")
    base = scratch.save(slim.withColumn("start", start), "docs")
    cells = base.where("h1 is not null").groupBy("h1", "h2", "start").agg(F.count("*").alias("n"))
    cells = cells.groupBy("h1", "h2").agg(F.sum("n").alias("n"), F.collect_list(F.struct(F.col("start").alias("shard"), "n")).alias("cells"))
    groups, found = scratch.measured(cells.where("n > 1"), "groups", n=F.count(F.lit(1)))
    total = base.count()
    quota = -(-total // shards)
    extra = total % shards or shards
    room = [quota if s < extra else total // shards for s in range(shards)]
    of_shard = lambda xs, shard: F.element_at(F.array(*(F.lit(x) for x in xs)), shard + 1)
    # groups larger than a shard, fewer than shards whatever the input, are cut into parts that fill shards exactly
    large = groups.where(F.col("n") > quota).drop("cells").orderBy(F.desc("n"), "h1", "h2").collect()
    pieces = lambda groups, parts: docs.sparkSession.createDataFrame([(g["h1"], g["h2"], *p) for g, ps in zip(groups, parts, strict=True) for p in ps], "h1 bigint, h2 bigint, first bigint, last bigint, shard int")
    large_parts = pieces(large, parts_of([r["n"] for r in large], room))
    linked = groups.where(F.col("n") <= quota)
    for r in range(rounds if found["n"] else 0):
        there, coming, leaving = [0] * shards, [0] * shards, [0] * shards
        for x in linked.select(F.inline("cells")).groupBy("shard").agg(F.sum("n").alias("n")).collect():  # a row a shard
            there[x["shard"]] = x["n"]
        free = [a - b for a, b in zip(room, there, strict=True)]
        # shards with room first, then most neighbours; of as many, the emptier shard
        rank = lambda c: F.struct((of_shard(free, c["shard"]) > 0).alias("open"), c["n"].alias("n"), F.floor(of_shard(free, c["shard"]) * 8 / quota).alias("room"), F.xxhash64(F.col("h1"), c["shard"]).alias("tie"), c["shard"].alias("shard"))
        wishing = linked.withColumn("wish", F.array_max(F.transform("cells", rank))["shard"])
        wants = wishing.select("wish", F.inline("cells")).where("wish <> shard").groupBy("shard", "wish").agg(F.sum("n").alias("n")).collect()  # a row a pair of shards
        if not wants:
            break
        for x in wants:
            coming[x["wish"]] += x["n"]
            leaving[x["shard"]] += x["n"]
        # linked documents may fill a shard to its quota; the last round only counts what stays
        chance = of_shard([max(0.0, min(1.0, (f + n) / c)) if c else 0.0 for f, n, c in zip(free, leaving, coming, strict=True)], F.col("wish"))
        # whole remainders move together, by the hash of their group
        goes = lambda c, r=r, chance=chance: (c["shard"] != F.col("wish")) & (_share(F.col("h1"), F.col("h2"), c["shard"], F.lit(r)) < chance)
        moved = F.transform("cells", lambda c: F.struct(F.when(goes(c), F.col("wish")).otherwise(c["shard"]).alias("shard"), c["n"].alias("n")))  # noqa: B023
        new = scratch.save(wishing.select("h1", "h2", "n", moved.alias("cells")).withColumn("cells", _merged(F.col("cells"))), "groups")
        if r:
            scratch.drop(linked)
        linked = new
    # exact sizes: groups in one shard keep their places there as far as they fit as wholes
    held = linked.select("h1", "h2", "n", F.array_min("cells.shard").alias("shard"), F.array_max("cells.shard").alias("other"))
    whole = summed(held.where("shard = other"), ["shard"], ["h1", "h2"], "n", "before", max(1, total // shards))
    whole = whole.where(F.col("before") + F.col("n") <= of_shard(room, F.col("shard"))).select("h1", "h2", F.col("shard").alias("home"))
    homes = scratch.save(held.join(whole, ["h1", "h2"], "left").select("h1", "h2", "n", "home"), "homes")
    for r in homes.where("home is not null").groupBy("home").agg(F.sum("n").alias("n")).collect():  # as many rows as shards
        room[r["home"]] -= r["n"]
    # of the others, those of an eighth of a shard or more (eight a shard at most) go where they fit best
    wide = homes.where(F.col("home").isNull() & (F.col("n") * 8 > quota)).orderBy(F.desc("n"), "h1", "h2").collect()
    wide_parts = pieces(wide, parts_of([r["n"] for r in wide], room))
    lasts = [sum(room[: i + 1]) for i in range(shards)]
    to = F.size(F.filter(F.array(*(F.lit(x) for x in lasts)), lambda last: last <= F.col("turn")))
    # the rest fill the free room one after another, before the single documents
    small = homes.where(F.col("home").isNull() & (F.col("n") * 8 <= quota))
    going = summed(small.withColumn("all", F.lit(0)), ["all"], ["h1", "h2"], "n", "before", total)
    moved = small.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    # rows meet their group's home once, by their start as well
    own = homes.join(going.select("h1", "h2", "before"), ["h1", "h2"], "left")
    own = own.unionByName(groups.where(F.col("n") > quota).drop("cells"), allowMissingColumns=True)
    own = own.withColumn("start", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    rows = scratch.save(base.join(own, ["h1", "h2", "start"], "left").drop("start"), "rows")
    plain = ["doc_id", "size", "text_crc32"]
    stays = rows.where("home is not null").select(*plain, F.col("home").alias("shard"))
    goes = numbered(rows.where("home is null and n > 1"), ["h1", "h2"], ["doc_id", "size"], "place", max(total, 256 * BLOCK_ROWS) if large else total)
    fitted = goes.where(F.col("before").isNull()).join(F.broadcast(large_parts.union(wide_parts)), ["h1", "h2"]).where("place between first and last").select(*plain, "shard")
    rest = goes.where(F.col("before").isNotNull()).withColumn("turn", F.col("before") + F.col("place")).select(*plain, to.alias("shard"))
    single = numbered(rows.where("n is null").select(*plain, F.lit(0).alias("all")), ["all"], plain, "turn", total).withColumn("turn", F.col("turn") + moved)
    out = stays.union(fitted).union(rest).union(single.select(*plain, to.alias("shard")))
    out = numbered(scratch.save(out, "out"), ["shard"], ["doc_id", "size", "text_crc32"], "slot", max(1, total // shards))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
