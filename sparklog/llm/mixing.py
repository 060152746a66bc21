"""Mixing sources to target weights: Efraimidis-Spirakis sampling without Python on the executors.

Each document draws an exponential key divided by its quality weight. A source takes as many complete epochs as its
target holds and then, in the order of the keys, the documents whose running size fits what is left.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .hubs import with_hubs
from .scratch import Scratch

#: Sources whose plans are broadcast at most; of more sources, only the plans of those with a large share of the rows are.
BROADCAST_SOURCES = 100_000
WORD = r"[^\x20\x09-\x0D]+"


def text_weight(text: Column) -> Column:
    """Quality weight in [0.1, 1] of a text: its share of letters and white space, less that of capitals and of marks
    that repeat. Null and empty texts have the least."""
    text = F.coalesce(text, F.lit(""))
    n = F.greatest(F.length(text), F.lit(1))
    plain = F.length(F.regexp_replace(text, r"[^\p{L}\s]+", "")) / n
    loud = F.regexp_count(text, F.lit(r"\p{Lu}(?=\p{Lu})|[^\p{L}\p{N}\s](?=[^\p{L}\p{N}\s])")) / n
    return F.lit(0.1) + F.lit(0.9) * plain * (F.lit(1.0) - loud)


def exponential_key(doc_id: Column, text: Column, weight: Column, seed: int) -> Column:
    """An exponential number fixed by seed, id and text, divided by the weight."""
    text = F.encode(F.coalesce(text, F.lit("")), "UTF-8")
    unit = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), doc_id.cast("string"), F.crc32(text)), 11) + F.lit(0.5)) / F.lit(float(2**53))
    return -F.log(unit) / weight


def block_of(key: Column, blocks: Column) -> Column:
    """Blocks of rising keys. The logarithm of an exponential key has a density of 1/e at most, whatever the weights,
    so that a block is expected to get less than one in ``blocks`` of the rows."""
    return F.floor(F.log(key) * blocks / 2)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), most_epochs: float = 3.0) -> DataFrame:
    """Adds ``target`` to ``sizes(source, source_size)``, one row a source.

    Sources by code point, null last, weigh ``weights`` in turn. All sizes together are shared by weight; no
    source gets more than ``most_epochs`` times its size, and what it can't take is shared again by weight. That
    end is reached at once: below some level per weight a source is filled up, above it all get that level. The
    levels are sums over all sources, a row each, which one task adds up.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1  # one row a source
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.pmod(place, F.lit(len(weights))) + 1).cast("int"))
    capped = sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(most_epochs))
    by_level = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_level.rowsBetween(0, Window.unboundedFollowing)
    total = F.sum("source_size").over(Window.partitionBy())
    level = (total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(onward)
    # the first source that isn't filled up by its own level sets it for the rest
    found = capped.withColumn("rank", F.row_number().over(by_level)).withColumn("level", level).withColumn("open", F.col("level") * F.col("weight") <= F.col("cap"))
    found = found.withColumn("level", F.min(F.when(F.col("open"), F.struct("rank", "level"))).over(Window.partitionBy())["level"])
    target = F.least("cap", F.coalesce(F.col("level") * F.col("weight"), F.col("cap")))
    return found.withColumn("target", target).drop("weight", "cap", "rank", "level", "open")


def mix(
    docs: DataFrame, *, weights: Sequence[float] = (5, 2, 1), most_epochs: float = 3.0, seed: int = 8, boundary: str = "cut",
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep: Sequence[str] = (), weight: Column | None = None,
) -> DataFrame:
    """One row per input row: ``doc_id, size, source_size, target, taken, copies`` and the columns in ``keep``.

    ``taken`` counts the words that the mix takes, repeats counted; ``copies`` is how many whole copies those are
    at least. The document in which a source's target falls gives only the words still missing (``boundary='cut'``),
    or all its words if that comes nearer than none (``'nearest'``). Null texts have size 0; null sources are a
    source of their own; a source without words takes nothing. Equal rows draw equal keys and follow one another.
    Reruns agree, since a key depends on seed, id, text and weight only. Texts are counted and weighed whole, however
    long. Empty tables give no rows; other columns are ignored, unless ``keep`` names them.
    """
    if boundary not in ("cut", "nearest"):
        raise ValueError("boundary must be 'cut' or 'nearest'")
    text = F.col(text_col)
    key = exponential_key(F.col(id_col), text, weight if weight is not None else text_weight(text), seed)
    # a null source gets a key of its own, so that joins and windows share one partitioning
    own = F.coalesce(F.concat(F.lit("s"), F.col(source_col).cast("string")), F.lit("n")).alias("own")
    drawn = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), own, word_count(text).alias("size"), key.alias("key"), *(F.col(c).alias(f"kept_{c}") for c in keep))
    drawn = Scratch(docs.sparkSession).save(drawn, "drawn")
    sizes = drawn.groupBy("own").agg(F.min("source").alias("source"), F.sum("size").alias("source_size"), F.count("*").alias("n"))
    sources, rows = sizes.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    plan = source_targets(sizes, weights, most_epochs).drop("source")
    plan = plan.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
    plan = plan.withColumn("left", F.round(F.col("target")).cast("long") - F.col("epochs") * F.col("source_size")).withColumn("blocks", F.ceil(F.sqrt("n")))
    every = drawn.join(F.broadcast(plan.drop("n")), "own") if sources <= BROADCAST_SOURCES else with_hubs(drawn, plan, "own", rows)
    # of n rows of a source a task sorts about the root of n, and another adds up as many blocks
    every = every.withColumn("block", block_of(F.col("key"), F.col("blocks")))
    block_sizes = every.groupBy("own", "block").agg(F.sum("size").alias("block_size"))
    before = Window.partitionBy("own").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = block_sizes.select("own", "block", F.coalesce(F.sum("block_size").over(before), F.lit(0)).alias("start"))
    within = Window.partitionBy("own", "block").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    every = every.withColumn("upto", F.sum("size").over(within)).join(starts, ["own", "block"])
    first = F.col("start") + F.col("upto") - F.col("size")
    part = F.least(F.col("size"), F.greatest(F.lit(0).cast("long"), F.col("left") - first))
    if boundary == "nearest":
        part = F.when(2 * part >= F.col("size"), F.col("size")).otherwise(0)
    out = every.withColumn("part", part).withColumn("taken", (F.col("epochs") * F.col("size") + F.col("part")).cast("long"))
    whole = F.col("epochs") + F.when((F.col("part") == F.col("size")) & (F.col("size") > 0), 1).otherwise(0)
    return out.select("doc_id", "size", "source_size", "target", "taken", whole.cast("int").alias("copies"), *(F.col(f"kept_{c}").alias(c) for c in keep))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents that the mix takes, whole, as many times as it takes them, with all their columns.

    Documents without words, null and empty texts among them, are never taken. Repeated rows are each taken as often as
    the mix takes them; null ids and sources are like any others. Empty tables give no rows."""
    columns = docs.columns
    taken = mix(docs.select(F.struct(*columns).alias("row"), F.col(options.get("id_col", "doc_id")).alias("doc_id"), F.col(options.get("text_col", "text")).alias("text"), F.col(options.get("source_col", "source")).alias("source")), boundary="nearest", keep=["row"], **{k: v for k, v in options.items() if not k.endswith("_col")})
    return taken.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), "copies"))).select("row.*")
