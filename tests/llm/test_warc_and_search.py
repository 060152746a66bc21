import hashlib
import json
import math
import re
import zlib
from collections import Counter

import pytest
from pyarrow.fs import FileSystem
from pyspark.sql import functions as F

from sparklog.llm import search, warc
from sparklog.llm.scratch import Scratch

PAGES = "page_id bigint, url string, html string"


def test_round_trip(spark):
    long, short = "<p>é</p>" * 40, "<p>x</p>"
    rows = [(3, "http://a/1", long), (2, "http://a/2\r\nX: y", long), (7, None, short), (8, "u", short), (9, "u", None), (None, "u", long), (2, "again", long), (11, "u", "x\r\n\r\nWARC/1.1\r\n" * 50_000), (12, "u", "a" * 99), (13, "u", "a" * 99), (14, "u", "b" * 100), (15, "u", "b" * 100)]
    index, read = warc.archive_pages(spark.createDataFrame(rows, PAGES).withColumn("digest", F.lit("mine")).withColumn("first", F.lit(1)))
    want = Counter()
    for page, _, html in rows:
        data = (html or "").encode()
        first = min((p for p, _, h in rows if h == html and p is not None), default=None) if len(data) >= 100 and sum(h == html for *_, h in rows) > 1 else None
        refers = first if first is not None and page != first else None
        want[(page, len(data), hashlib.sha256(data).hexdigest(), "response" if refers is None else "revisit", refers)] += 1
    got = read.collect()
    assert Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["type"], r["refers_to"]) for r in got) == want
    assert all((r["payload"] is None) == (r["type"] == "revisit") for r in got)
    for path in {r["path"] for r in index.collect()}:  # the sidecar says the same, and members stand alone
        fs, inner = FileSystem.from_uri(path)
        data = fs.open_input_stream(inner, compression=None).read()
        lines = [json.loads(x) for x in fs.open_input_stream(inner.removesuffix(".warc.gz") + ".cdxj").read().splitlines()]
        assert sum(x["length"] for x in lines) == len(data)
        for x in lines:
            own = zlib.decompress(data[x["offset"] : x["offset"] + x["length"]], 31)
            assert own.startswith(b"WARC/1.1") and warc.headers_of(own)["warc-record-id"] == x["record_id"]
    assert warc.archive_pages(spark.createDataFrame([], PAGES))[1].count() == 0


def test_one_stream_over_all_records(spark):
    pages = spark.createDataFrame([(i, "u", f"page {i}") for i in range(50)], PAGES).coalesce(1)
    scratch = Scratch(spark)
    path = scratch.save(warc.write_archives(warc.page_records(pages).coalesce(1), f"{scratch.dir}/warc")).first()["path"]
    fs, inner = FileSystem.from_uri(path)
    data = fs.open_input_stream(inner, compression=None).read()
    whole = zlib.decompressobj(31)
    assert whole.decompress(data).count(b"WARC/1.1") == 50 and whole.eof and not whole.unused_data
    records = list(warc.split_records(data[i : i + 7] for i in range(0, len(data), 7)))
    assert len(records) == 50 and len(list(warc.split_records(iter([b"".join(warc._member(r) for r in records)])))) == 50
    for broken in (data[:-20], zlib.compress(b"no record\r\n\r\n", 6, 31)):
        with pytest.raises((ValueError, zlib.error)):
            list(warc.split_records(iter([broken])))


def bm25(rows, k):
    words = [re.findall("[0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for _, t in rows]
    df, mean = Counter(w for x in words for w in set(x)), sum(map(len, words)) / len(rows)
    out = []
    for (q, _), asked in zip(rows, words, strict=True):
        if q is None or q % 20:
            continue
        scored = []
        for (d, _), x in zip(rows, words, strict=True):
            tf = Counter(x)
            s = sum(n * math.log(1 + (len(rows) - df[w] + 0.5) / (df[w] + 0.5)) * tf[w] * 2.2 / (tf[w] + 1.2 * (0.25 + 0.75 * len(x) / mean)) for w, n in Counter(asked).items() if tf[w])
            if round(s, 6) > 0:
                scored.append((-round(s, 6), -1 if d is None else d))
        out += [(q, i + 1, None if d < 0 else d, -s) for i, (s, d) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize(("shard_docs", "block", "piece"), [(1_000, 64, 4_000_000), (70, 4, 500), (150, 8, 10_000)])
def test_search_is_exact(spark, shard_docs, block, piece, monkeypatch):
    import random

    monkeypatch.setattr(search, "BLOCK_DOCS", block)
    monkeypatch.setattr(search, "PIECE_BYTES", piece)
    rng = random.Random(4)
    common, rare = ["The", "of", "a", "and", "to"], [f"w{i}" for i in range(150)]
    rows = [(i, " ".join(rng.choice(common if rng.random() < 0.6 else rare) for _ in range(rng.choice([3, 30, 60])))) for i in range(300)]
    rows += [(20_000, "é, È; w1"), (20_020, None), (20_040, ""), (None, "w1 w2"), (20_060, "nothingelse"), (20_080, rows[0][1]), (20_081, rows[0][1]), (2**60 + 1, "w1 w2 w3"), (2**60 + 20, "w3 w4"), (20_100, "w5 the " * 40_000)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("term", F.lit(1)).withColumn("shard", F.lit("x"))
    got = sorted((tuple(r) for r in search.search(d, F.col("doc_id") % 20 == 0, k=7, shard_docs=shard_docs).collect()), key=str)
    want = bm25(rows, 7)
    assert [g[:3] for g in got] == [w[:3] for w in want] and [g[3] for g in got] == pytest.approx([w[3] for w in want], abs=2e-6)
    assert search.search(d.limit(0), F.col("doc_id") % 20 == 0).count() == 0


def rows_from_python(plan):
    """Rows that each MapInArrow of an executed plan gave."""
    name = plan.nodeName()
    if name == "AdaptiveSparkPlan":
        return rows_from_python(plan.executedPlan())
    if "QueryStage" in name:
        return rows_from_python(plan.plan())
    own = [plan.metrics().apply("pythonNumRowsReceived").value()] if name == "MapInArrow" else []
    return own + [n for i in range(plan.children().size()) for n in rows_from_python(plan.children().apply(i))]


def test_search_rows_do_not_grow_with_shards(spark):
    d = spark.createDataFrame([(i, f"a b c w{i % 7} w{i % 11}") for i in range(400)], "doc_id bigint, text string")
    found = search.search(d, F.col("doc_id") % 20 == 0, k=5, shard_docs=20)  # 20 shards, 20 queries
    assert len(found.collect()) == 100
    assert rows_from_python(found._jdf.queryExecution().executedPlan()) == [100]


def test_shards_one_after_another_are_exact(monkeypatch):
    import random

    import numpy as np

    for name, value in (("BLOCK_DOCS", 8), ("TOGETHER", 5), ("SLICE", 60), ("COLUMNS", 6), ("COMMON", 4), ("CENTRES", 5), ("PIECE_BYTES", 100)):
        monkeypatch.setattr(search, name, value)
    rng = random.Random(5)
    languages = [[f"{p}{int(rng.paretovariate(0.7)) % 90}" for _ in range(900)] for p in "xyz"]
    rows = [(i, " ".join(rng.choice(languages[i % 3]) for _ in range(rng.choice([2, 20, 50])))) for i in range(240)]
    rows += [(1_000 + i, rows[20][1]) for i in range(60)] + [(2_000, "alone"), (2_020, "x1"), (None, "x1")]
    terms = [search.terms_of(t, search._Known()) for _, t in rows]
    df, mean = Counter(int(t) for own, _, _ in terms for t in own), sum(n for *_, n in terms) / len(rows)
    asks = [i for i, (d, _) in enumerate(rows) if d is not None and d % 20 == 0]
    asked = search.Asked([terms[i][:2] for i in asks], 7)
    for shard in range(4):
        mine = range(shard, len(rows), 4)
        own = np.concatenate([terms[i][0] for i in mine])
        vocabulary, place = np.unique(own, return_inverse=True)
        heads = np.array([rows[i][0] or 0 for i in mine]), np.array([rows[i][0] is not None for i in mine], dtype=np.int8), np.array([terms[i][2] for i in mine], dtype=np.int32)
        arrays = search.lay_out(*heads, np.array([len(terms[i][0]) for i in mine], dtype=np.int32), vocabulary, place.astype(np.int32), np.concatenate([terms[i][1] for i in mine]))
        search.ShardIndex(search._pack(*arrays), np.array([df[int(t)] for t in vocabulary]), len(rows), mean).search(asked)
    got = sorted(((rows[q][0], r + 1, int(asked.ids[i, r]) if asked.valid[i, r] else None, asked.scores[i, r]) for i, q in enumerate(asks) for r in range(7) if asked.scores[i, r] > 0), key=str)
    want = bm25(rows, 7)
    assert [g[:3] for g in got] == [w[:3] for w in want] and [g[3] for g in got] == pytest.approx([w[3] for w in want], abs=2e-6)
