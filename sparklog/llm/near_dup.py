"""Near-duplicate documents: a multi-index Hamming join of b-bit MinHash signatures, confirmed on full shingle sets.

A signature has ``positions`` MinHash values cut to ``bits`` bits; its distance is the number of positions that
differ. Positions are dealt into ``chunks``; two signatures within ``chunks * (errors + 1) - 1`` of each other must,
by the pigeonhole principle, have a chunk with at most ``errors`` differing positions. Every choice of ``errors``
positions that may be wrong gives a key of the chunk's other positions, so both meet in the bucket of one key at
least. With the defaults the threshold is 27 of 64, 4.5 standard deviations beyond what a similarity of 0.8 gives.

Buckets of near copies are never expanded into all pairs. First each member is confirmed against one pivot of its
bucket; members already in one component need no further pair. Buckets that still hold several components are
compared in pairs if they have few members; in the others, all visit the component with most members there in blocks,
where they also meet its other visitors, which makes the result whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .hubs import with_hubs
from .scratch import Scratch

#: Words whose hashes a task remembers; beyond it the memory starts afresh.
REMEMBERED_WORDS = 200_000
#: Buckets of more members are met in blocks of BLOCK sets; those of smaller ones are compared in pairs.
FEW = 16
BLOCK = 200
#: Tasks among which a component's members are dealt when they look up what is known of it.
SALTS = 32
_MIX = np.uint64(0x9E3779B97F4A7C15)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED_WORDS:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word)
        return value


def shingle_set(text: str | None, shingle: int, known: _WordHashes) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles. Only A-Z are lower-cased; words part at ASCII white space."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    if len(words) < shingle:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), seed=len(words))], dtype=np.uint64)
    each = np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))
    n = len(words) - shingle + 1
    out = np.zeros(n, dtype=np.uint64)
    for j in range(shingle):
        out ^= each[j : j + n]
        out *= _MIX
        out ^= out >> np.uint64(29)
    return np.unique(out)


def signature(hashes: np.ndarray, factors: np.ndarray, bits: int) -> np.ndarray:
    """Tagged symbols: the position above, the MinHash value's ``bits`` bits below."""
    least = np.full(len(factors), np.iinfo(np.uint64).max, dtype=np.uint64)
    for i in range(0, len(hashes), 2048):
        np.minimum(least, (hashes[i : i + 2048, None] * factors[None, :]).min(axis=0), out=least)
    symbols = ((least ^ (least >> np.uint64(31))) * _MIX) >> np.uint64(64 - bits)
    return (np.arange(len(factors), dtype=np.uint64) << np.uint64(bits)) | symbols


def _factors(positions: int) -> np.ndarray:
    return np.random.default_rng(20).integers(1, 2**63, positions, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def digest_of(hashes: np.ndarray) -> bytes:
    """128 bits that stand for a whole set; sets of one digest are the same set."""
    return xxhash.xxh3_128_digest(hashes.tobytes())


def _route(digest: bytes) -> int:
    return int.from_bytes(digest[:8], "big", signed=True)


def row_key(id_col: str, text_col: str) -> list[Column]:
    """128 bits of a row's id and text; nulls differ from any value."""
    own = [F.col(id_col).isNull(), F.col(id_col).cast("string"), F.col(text_col).isNull(), F.col(text_col)]
    return [F.xxhash64(F.lit(seed), *own).alias(f"row_{seed}") for seed in (1, 2)]


def signatures(docs: DataFrame, id_col: str, text_col: str, shingle: int, positions: int, bits: int) -> DataFrame:
    """``doc_id, row_1, row_2, digest, node, n_shingles, sig`` for each row.

    ``digest`` stands for the set, ``node`` is its first half, by which sets are sought, and ``row_1, row_2`` tell
    rows apart. No shingles give no signature.
    """
    factors = _factors(positions)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _WordHashes()
        for batch in batches:
            digests, nodes, sizes, sigs = [], [], [], []
            for text in batch.column(3):
                hashes = shingle_set(text.as_py(), shingle, known)
                digests.append(digest_of(hashes))
                nodes.append(_route(digests[-1]))
                sizes.append(len(hashes))
                sigs.append(signature(hashes, factors, bits).astype(np.int32) if len(hashes) else None)
            made = [pa.array(digests, pa.binary()), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(sigs, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *made], names=["doc_id", "row_1", "row_2", "digest", "node", "n_shingles", "sig"])

    slim = docs.select(F.col(id_col).alias("doc_id"), *row_key(id_col, text_col), F.col(text_col).alias("text"))
    return slim.mapInArrow(run, f"doc_id {slim.schema[0].dataType.simpleString()}, row_1 bigint, row_2 bigint, digest binary, node bigint, n_shingles bigint, sig array<int>")


def full_sets(docs: DataFrame, shingle: int, positions: int, bits: int) -> DataFrame:
    """``digest, node, sig, hashes`` of ``docs(text)``."""
    factors = _factors(positions)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _WordHashes()
        for batch in batches:
            sets = [shingle_set(text.as_py(), shingle, known) for text in batch.column(0)]
            digests = [digest_of(s) for s in sets]
            sigs = [signature(s, factors, bits).astype(np.int32) if len(s) else None for s in sets]
            made = [pa.array(digests, pa.binary()), pa.array(map(_route, digests), pa.int64()), pa.array(sigs, pa.list_(pa.int32())), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(made, names=["digest", "node", "sig", "hashes"])

    return docs.select("text").mapInArrow(run, "digest binary, node bigint, sig array<int>, hashes array<bigint>")


def bucket_keys(sig: Column, positions: int, chunks: int, errors: int) -> Column:
    """One key for each chunk and each choice of ``errors`` of its positions that may differ."""
    keys = []
    for c in range(chunks):
        own = range(c * positions // chunks, (c + 1) * positions // chunks)
        for wrong in combinations(own, min(errors, len(own) - 1)):
            keys.append(F.xxhash64(F.lit(len(keys)), *(sig[i] for i in own if i not in wrong)))
    return F.array(*keys)


def near_duplicates(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8,
    positions: int = 64, bits: int = 16, chunks: int = 14, errors: int = 1,
) -> DataFrame:
    """One row per input row: ``doc_id, n_shingles, component_id, kept``.

    Documents are linked if the Jaccard similarity of their shingle sets is at least ``similarity``;
    ``component_id`` is the smallest ``doc_id`` of the component and ``kept`` marks the document of that id.
    A document with fewer words than a shingle has its whole sequence as one shingle. Null or blank texts have no
    shingles and are linked with nothing. Texts are read whole, however long. Repeated rows each get a row. A null
    id belongs to its component but never names it, unless all its ids are null. Empty tables give no rows; other
    columns are ignored.
    """
    out = _grouped(docs, Scratch(docs.sparkSession), id_col, text_col, shingle, similarity, positions, bits, chunks, errors)
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def _grouped(docs: DataFrame, scratch: Scratch, id_col: str, text_col: str, shingle: int, similarity: float, positions: int, bits: int, chunks: int, errors: int) -> DataFrame:
    """``doc_id, row_1, row_2, digest, n_shingles, component_id`` and, as ``names``, whether the row has the set that names its component.

    Classes are documents of one set. Those that share a bucket are ranked by their least id (an id before none) and
    digest, and go by their ranks, so that the least rank of a component is that of the class that names it.
    Large saved tables that the result doesn't read go when their last reader has ended.
    """
    hundred = round(100 * similarity)
    sigs, rows_in = scratch.measured(signatures(docs, id_col, text_col, shingle, positions, bits), "sig", n=F.count(F.lit(1)))
    classes = sigs.where("n_shingles > 0").groupBy("digest", "node").agg(F.min("doc_id").alias("least"), F.first("sig").alias("sig"))
    rows = classes.select("node", F.explode(bucket_keys(F.col("sig"), positions, chunks, errors)).alias("key"))
    pivots = rows.groupBy("key").agg(F.min("node").alias("pivot"), F.max("node").alias("other")).where("pivot <> other").select("key", "pivot")
    shared = scratch.save(rows.join(pivots, "key"), "shared")
    # every member of a bucket may have to be confirmed against another than its pivot
    busy = classes.drop("sig").join(shared.select("node").distinct(), "node", "left_semi")
    # tasks of a global order have rising ids
    ranks = scratch.save(busy.orderBy(F.col("least").asc_nulls_last(), "digest").withColumn("rank", F.monotonically_increasing_id()), "ranks")
    text = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    ids = ranks.select("least").distinct()
    held = text.join(ids, text.doc_id.eqNullSafe(ids.least), "left_semi")
    sets = scratch.save(full_sets(held, shingle, positions, bits).dropDuplicates(["digest"]).join(ranks.select("digest", "rank"), "digest"), "sets")
    near = F.size(F.array_intersect("sig_a", "sig_b")) >= positions - (chunks * (errors + 1) - 1)

    def confirmed(pairs: DataFrame, by: str) -> DataFrame:
        a, b = (sets.select(F.col(by).alias(x), *(F.col(c).alias(f"{c}_{x}") for c in {"rank", "sig", "hashes"} - {by}), F.col("rank").alias(f"of_{x}")) for x in "ab")
        both = pairs.join(a, "a").join(b, "b").where(near).withColumn("same", F.size(F.array_intersect("hashes_a", "hashes_b")))
        return both.where(100 * F.col("same") >= hundred * (F.size("hashes_a") + F.size("hashes_b") - F.col("same"))).select(F.col("of_a").alias("a"), F.col("of_b").alias("b"))

    first = shared.where("node <> pivot").select(F.col("node").alias("a"), F.col("pivot").alias("b")).distinct()
    roots = scratch.save(components(confirmed(first, "node"), scratch), "roots")

    # members of the buckets that still hold two components
    of = shared.select("key", "node").join(ranks.select("node", "rank"), "node").join(roots.withColumnRenamed("node", "rank"), "rank", "left")
    of = of.select("key", "rank", F.coalesce("root", "rank").alias("root"))
    split = of.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("members")).where("low <> high").select("key", (F.col("members") > FEW).alias("many"))
    left, found = scratch.measured(of.join(split, "key"), "open", n=F.count(F.lit(1)), many=F.count_if("many"))
    scratch.drop(shared)
    if found["n"]:
        a, b = (left.where("not many").select("key", F.col("rank").alias(x), F.col("root").alias(f"root_{x}")) for x in "ab")
        links = confirmed(a.join(b, "key").where("a < b and root_a <> root_b").select("a", "b").distinct(), "rank")
        if found["many"]:
            links = links.union(scratch.save(_meetings(left.where("many"), sets, hundred), "met"))
        links, found = scratch.measured(links, "links", n=F.count(F.lit(1)))
        if found["n"]:
            before, roots = roots, scratch.save(components(roots.toDF("a", "b").union(links), scratch), "roots")
            scratch.drop(before)
        scratch.drop(links)
    scratch.drop(sets, left)
    # a component's name is that of its root, which its classes look up in SALTS tasks
    names = ranks.select(F.col("rank").alias("root"), "least").join(roots.select("root").distinct(), "root").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    named = roots.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int")).join(names, ["root", "salt"]).join(ranks.select(F.col("rank").alias("node"), "digest"), "node")
    named = named.select("digest", "least", (F.col("node") == F.col("root")).alias("names"))
    # classes that are linked to no other are their own components
    single = sigs.where("n_shingles > 0").groupBy("digest").agg(F.min("doc_id").alias("own"), F.count("*").alias("n")).join(named, "digest", "left")
    single = single.select("digest", F.when(F.col("names").isNull(), F.col("own")).otherwise(F.col("least")).alias("component_id"), F.coalesce("names", F.lit(True)).alias("names"), "n")
    plain = ["doc_id", "row_1", "row_2", "digest", "n_shingles"]
    out = with_hubs(sigs.where("n_shingles > 0").select(*plain), single, "digest", rows_in["n"]).select(*plain, "component_id", "names")
    # texts without shingles are their own components
    return out.union(sigs.where("n_shingles = 0").select(*plain, F.col("doc_id").alias("component_id"), F.lit(True).alias("names")))


def _meetings(left: DataFrame, sets: DataFrame, hundred: int) -> DataFrame:
    """Links ``(a, b)`` between the components of full buckets ``left(key, rank, root)``.

    A bucket's host is the component with most members there; all others visit it, and meet there its members in
    the buckets that it hosts and its other visitors. Both sides are dealt into blocks of about BLOCK sets, each
    block of one meets each of the other, and a meeting gives the links that connect what it found to be linked:
    never more than its sets, nor the pairs it looks at.
    """
    counts = left.groupBy("key", "root").agg(F.count("*").alias("n"))
    hosts = counts.groupBy("key").agg(F.max(F.struct("n", "root"))["root"].alias("host"))
    seen = left.join(hosts, "key")
    visits = seen.where("root <> host").select(F.col("rank").alias("visitor"), "host").distinct()
    members = seen.where("root = host").select("rank", "host", F.lit(True).alias("inside")).distinct()
    members = members.union(visits.select(F.col("visitor").alias("rank"), "host", F.lit(False)))
    sizes = members.groupBy("host").agg(F.ceil(F.count_if(~F.col("inside")) / BLOCK).cast("int").alias("guest_blocks"), F.ceil(F.count("*") / BLOCK).cast("int").alias("host_blocks"))
    # a component may have any number of members, so that its row meets them in SALTS tasks
    sizes = sizes.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = lambda df, c: df.withColumn("salt", F.pmod(F.xxhash64(c), F.lit(SALTS)).cast("int")).join(sizes, ["host", "salt"])
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda c, n: F.pmod(F.xxhash64(F.lit(3), c), F.col(n)).cast("int")
    host = salted(members, "rank").join(sets.select("rank", "hashes"), "rank").select("host", own("rank", "host_blocks").alias("i"), spread("guest_blocks").alias("j"), "rank", "inside", "hashes")
    come = sets.select(F.col("rank").alias("visitor"), F.col("hashes").alias("own"))
    guest = salted(visits, "visitor").join(come, "visitor").select("host", spread("host_blocks").alias("i"), own("visitor", "guest_blocks").alias("j"), "visitor", "own").toDF("to", "k", "l", "visitor", "own")

    def meet(there: pd.DataFrame, come: pd.DataFrame) -> pd.DataFrame:
        out, up = [], {}

        def top(x: int) -> int:
            while up.get(x, x) != x:
                up[x] = up.get(up[x], up[x])
                x = up[x]
            return x

        if len(there) and len(come):
            inside = there["rank"][there["inside"]].to_list()
            up.update((x, inside[0]) for x in inside)  # they are linked already
            lengths = there["hashes"].map(len).to_numpy()
            every, owner = np.concatenate(there["hashes"].to_list()), np.repeat(np.arange(len(there)), lengths)
            order = np.argsort(every, kind="stable")
            every, owner, nodes = every[order], owner[order], there["rank"].to_numpy()
            for visitor, hashes in zip(come["visitor"], come["own"], strict=True):
                starts, ends = np.searchsorted(every, hashes, "left"), np.searchsorted(every, hashes, "right")
                counts = ends - starts
                at = np.repeat(starts - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())
                same = np.bincount(owner[at], minlength=len(there))
                for node in nodes[100 * same >= hundred * (lengths + len(hashes) - same)].tolist():
                    if (x := top(visitor)) != (y := top(node)):
                        up[x] = y
                        out.append((visitor, node))
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return host.groupBy("host", "i", "j").cogroup(guest.groupBy("to", "k", "l")).applyInPandas(meet, "a bigint, b bigint")


def deduplicate(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8, positions: int = 64, bits: int = 16, chunks: int = 14, errors: int = 1) -> DataFrame:
    """One row of each component of ``near_duplicates``, with all its columns, as it came.

    Rows are judged one by one, so that ids may be null or repeated: of a component the row with the least id stays
    (an id before none). Rows of equal id and text count as repeats, and any one of them stays. Rows without
    shingles are linked with nothing and all stay. Empty tables give no rows.
    """
    scratch, keep = Scratch(docs.sparkSession), Scratch(docs.sparkSession)
    every = _grouped(docs, scratch, id_col, text_col, shingle, similarity, positions, bits, chunks, errors)
    # rows of one id and one set may still differ in their texts
    first = every.where(F.col("names") & (F.col("n_shingles") > 0) & F.col("doc_id").eqNullSafe(F.col("component_id")))
    row = first.groupBy("digest", "row_1", "row_2").agg(F.count("*").alias("n")).groupBy("digest").agg(F.min(F.struct("row_1", "row_2", "n")).alias("row")).select("row.*")
    blank = every.where("n_shingles = 0").select("row_1", "row_2", F.lit(1).cast("long").alias("n")).distinct()
    kept, found = keep.measured(row.union(blank), "kept", repeated=F.count_if(F.col("n") > 1))
    scratch.clear()
    keyed = docs.select(F.struct(*docs.columns).alias("row"), *row_key(id_col, text_col))
    out = keyed.join(kept.where("n = 1"), ["row_1", "row_2"], "left_semi").select("row.*")
    if found["repeated"]:
        again = keyed.join(kept.where("n > 1"), ["row_1", "row_2"], "left_semi").groupBy("row_1", "row_2").agg(F.first("row").alias("row"))
        out = out.union(again.select("row.*"))
    return out
