import re
import zlib
from collections import Counter

import pytest
from hypothesis import example, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparklog.llm import decontaminate, labelled, pii, quality, toxicity

DOCS = "doc_id bigint, text string"
BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def by_patterns(text):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            fits = {"email": lambda: True, "ip": lambda m=m: all(int(p) <= 255 for p in m[0].split(".")), "card": lambda d=digits: 13 <= len(d) <= 19 and pii.luhn(d), "phone": lambda d=digits: 9 <= len(d) <= 15}
            if fits[kind]():
                out.append((kind, m.start(), m.end()))
    return out


@settings(max_examples=1500, deadline=None)
@given(st.text(alphabet="aB.@-+ 0123456789().é\n,", max_size=45))
def test_base_spans_are_the_patterns(text):
    assert sorted(pii.base_spans(text)) == sorted(by_patterns(text))


def test_long_runs_take_linear_time():
    for text in ("a" * 300_000, "1" * 300_000, "1." * 150_000, "a@" * 150_000, "+1" * 150_000, "1 " * 100_000 + "x"):
        pii.base_spans(text)


@pytest.mark.parametrize(
    ("text", "kind", "own"),
    [("mail bob [at] example [dot] com now", "email", "bob [at] example [dot] com"), ("call (456) 555-2186 today", "phone", "(456) 555-2186"), ("card 4111.1111.1111.1111 ok", "card", "4111.1111.1111.1111"), ("host 10[.]0[.]0[.]1 up", "ip", "10[.]0[.]0[.]1")],
)
def test_disguised_data_is_found(text, kind, own):
    base, spans = pii.spans_of(text, pii.fitted())
    assert base == [] and [(k, text[a:b]) for k, a, b in spans] == [(kind, own)]


def test_other_numbers_are_left_alone():
    for text in ("on 2023-10-12 10:33 we", "order 123456789012345678901", "the version 1.2.3 of", "1 2 3 4 5 6 7 8 9 10 11 12", "at. Esti thn"):
        assert pii.spans_of(text, pii.fitted()) == ([], [])


def test_held_out_sentences():
    w, right, made, true = pii.fitted(), 0, 0, 0
    for text, spans in pii.made_sentences(200, seed=77):
        _, got = pii.spans_of(text, w)
        right, made, true = right + len(set(got) & set(spans)), made + len(got), true + len(spans)
    assert right / made > 0.8 and right / true > 0.75


def test_best_segments_is_the_best_of_all():
    """The dynamic programme against every set of segments that don't overlap."""
    w = pii.fitted()
    for text, _ in pii.made_sentences(25, seed=9):
        s = pii.Stretch(text, 0, len(text))
        scores = pii._scores(s, w)

        def best(at, s=s, scores=scores):
            return max([0.0 if at >= len(s.tokens) else best(at + 1), *(scores[k] + best(j) for k, (i, j, _) in enumerate(s.segments) if i == at)])

        if len(s.segments) < 60:
            got = pii.best_segments(s, w)
            own = {(k, s.tokens[i][0], s.tokens[j - 1][1]): scores[n] for n, (i, j, k) in enumerate(s.segments)}
            assert sum(own[x] for x in got) == pytest.approx(best(0))


def whole_candidates(text, taken=()):
    """The rule, tried on every pair of tokens of the whole text."""
    tokens = [m.span() for m in pii._TOKEN.finditer(text) if not any(m.start() < e and a < m.end() for a, e in taken)]
    out = set()
    for i, (start, _) in enumerate(tokens):
        for _, end in tokens[i:]:
            own = text[start:end]
            if "\n" in own or any(a >= start and e <= end for a, e in taken):
                break
            digits = sum("0" <= c <= "9" for c in own)
            out |= {("email", own, start)} if pii._SPELT.fullmatch(own) else set()
            out |= {("ip", own, start)} if pii._BROKEN_IP.fullmatch(own) else set()
            out |= {(k, own, start) for k in ("phone", "card")} if 9 <= digits <= 19 and not re.search(r"[^0-9 ().+_-]", own) else set()
    return out


PIECES = ["1", "23", "4567", "123", " ", " ", "-", ".", "+", "(", ")", "_", "\n", "x", "éa", "bob", "@", " @ ", "[at]", " [AT] ", "(At)", " at ", " dot ", "[dot]", " (Dot) ", "{ DOT }", "[.]", "(.)", "10 dot 20 dot 3", ","]


@settings(max_examples=600, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=30).map("".join), st.lists(st.tuples(st.integers(0, 60), st.integers(1, 12)), max_size=2))
def test_every_candidate_of_the_whole_text_is_scored(text, spans):
    taken = [(a, min(len(text), a + n)) for a, n in spans if a < len(text)]
    s = pii.Stretch(text, 0, len(text), taken)
    got = {(k, text[s.tokens[i][0] : s.tokens[j - 1][1]], s.tokens[i][0]) for i, j, k in s.segments}
    assert got == whole_candidates(text, taken)
    if got and not taken:
        assert pii._CHAIN.search(text) or any(pii.number_runs(text, 0, len(text))) or any(pii.spelt_signs(text, 0, len(text)))


@pytest.mark.parametrize(
    ("text", "kind", "own"),
    [
        ("mail john [AT] example [DOT] com now", "email", "john [AT] example [DOT] com"), ("write john (At) mail (Dot) org now", "email", "john (At) mail (Dot) org"),
        ("mail first.last [at] mail [dot] example [dot] org now", "email", "first.last [at] mail [dot] example [dot] org"), ("host 10 dot 20 dot 30 dot 40 up", "ip", "10 dot 20 dot 30 dot 40"),
        ("tel 06 12 34 56 78 ok", "phone", "06 12 34 56 78"), ("call 01-23-45-67-89 ok", "phone", "01-23-45-67-89"), ("card 41_11_11_11_11_11_11_11 ok", "card", "41_11_11_11_11_11_11_11"),
    ],
)
def test_spellings_without_three_digits_or_small_letters(text, kind, own):
    base, spans = pii.spans_of(text, pii.fitted())
    assert base == [] and [(k, text[a:b]) for k, a, b in spans] == [(kind, own)]


def test_long_lists_have_no_borders():
    w = pii.fitted()
    for cue, own in (("call ", "(456) 555-2186"), ("", "bob [at] example [dot] com"), ("", "4111.1111.1111.1111")):
        text = ", ".join([cue + own] * 400)
        assert [text[a:b] for _, a, b in pii.spans_of(text, w)[1]] == [own] * 400


def test_candidates_take_linear_time():
    for text in ("1 " * 20_000, "a." * 20_000 + "[at] " + "b." * 20_000, "at a dot " * 10_000, "(" * 50_000 + "123456789", "bob [at] a.b, " * 5_000, "1 dot " * 20_000, "a@" * 30_000):
        pii.Stretch(text, 0, len(text))


def test_rare_and_short_terms_are_learned(spark):
    rows = [(i, f"you idiot {'no ' * (i % 40)}{'ja ' * (i // 40)}", 1) for i in range(1600)] + [(2000 + i, f"du drekzunge {'ja ' * i}", 1) for i in range(30)] + [(3000 + i, f"oh fuj {'no ' * i}", 1) for i in range(30)]
    rows += [(4000 + i, f"a kind word of the day, fujita {'no ' * (i % 40)}{'ja ' * (i // 40)}you du ja oh", 0) for i in range(1600)]
    d = spark.createDataFrame([r[:2] for r in rows], DOCS)
    lexicon = toxicity.fit(d, spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id bigint, toxic int"))
    hits = lambda t: [own.strip() for _, own, _ in lexicon.hits(toxicity.folded(t))]
    assert hits("du drekzunge!") and hits("(Fuj)") == ["fuj"] and hits("fujita is kind") == []


def test_personal_data_rows(spark):
    rows = [(1, "x a.b@c.de 10.0.0.1"), (None, None), (3, ""), (3, ""), (4, "é " * 50_000 + "+1 (456) 555-2186")]
    got = {r["doc_id"]: r for r in pii.find_personal_data(spark.createDataFrame(rows, DOCS).withColumn("spans", F.lit(1))).collect()}
    assert [tuple(s) for s in got[1]["spans"]] == [("email", 2, 10), ("ip", 11, 19)] and got[None]["base"] == [] and [s["start"] for s in got[4]["base"]] == [100_000]
    assert pii.find_personal_data(spark.createDataFrame([], DOCS)).count() == 0


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from("abc"), min_size=1, max_size=7), st.lists(st.sampled_from("abcd"), max_size=10))
def test_myers_is_the_edit_distance(item, text):
    want = min(edit_distance(item, text[a:b]) for a in range(len(text) + 1) for b in range(a, len(text) + 1))
    assert decontaminate.best_match(item, decontaminate.bits_of(item), text)[0] == want


@settings(max_examples=600, deadline=None)
@given(st.lists(st.sampled_from("abcde"), min_size=5, max_size=12), st.lists(st.sampled_from("abcdefg"), max_size=25))
@example(list("bbbab"), list("bbbba"))  # the best passage ends where a longer, worse one does
@example(list("abcde"), list("abcdeggggggggggabcde"))  # equally good passages far apart
def test_pigeonhole_misses_nothing(item, text):
    every = [(edit_distance(item, text[a:b]), -b, a) for a in range(len(text) + 1) for b in range(a, len(text) + 1)]
    want = min(every)[0]
    got = decontaminate.Matcher([(1, " ".join(item))], 0.34, 5).matches(" ".join(text))
    assert bool(got) == (want <= int(0.34 * len(item)))
    if got:
        _, a, b, distance, _ = got[0]
        assert distance == want == edit_distance(item, text[a:b]) and (distance, -b, a) == min(every)


@pytest.mark.parametrize("cut", [1, 2])
def test_passages_at_a_texts_start_and_end(cut):
    item = "one two three four five six seven eight nine ten".split()
    match = decontaminate.Matcher([("a", " ".join(item))], 0.2, 5).matches
    assert match(" ".join([*item[cut:], *"and then other words".split()])) == [("a", 0, 10 - cut, cut, 10)]
    assert match(" ".join([*"and then other words".split(), *item[:-cut]])) == [("a", 4, 14 - cut, cut, 10)]


def test_item_ids_of_any_type(spark):
    item = "the quick brown fox jumps over the lazy dog by the river"
    d = spark.createDataFrame([("d", item)], "doc_id string, text string")
    got = decontaminate.contaminated(d, spark.createDataFrame([("x", item), (None, item)], "item_id string, text string"))
    assert got.dtypes[:2] == [("doc_id", "string"), ("item_id", "string")] and {(r["doc_id"], r["item_id"]) for r in got.collect()} == {("d", "x"), ("d", None)}


def test_contaminated_rows(spark, monkeypatch):
    item = "the quick brown fox jumps over the lazy dog by the river"
    rows = [(1, "So: The quick, brown FOX jumps over a lazy dog by the river!"), (2, "the quick brown fox sat"), (None, item), (4, None), (5, ""), (6, "z " * 60_000 + item), (6, "z " * 60_000 + item)]
    bench = spark.createDataFrame([(10, item), (11, None), (12, "the"), (13, "completely other words are in this one here"), (None, item)], "item_id bigint, text string")
    d = spark.createDataFrame(rows, DOCS).withColumn("item_id", F.lit("mine")).withColumn("row", F.lit(1))
    for size in (decontaminate.BLOCK_CHARS, 60):
        monkeypatch.setattr(decontaminate, "BLOCK_CHARS", size)
        got = Counter((r["doc_id"], r["item_id"], r["start_word"], r["distance"]) for r in decontaminate.contaminated(d, bench).collect())
        assert got == Counter({(d_, i, at, e): n for i in (10, None) for d_, at, e, n in ((1, 1, 1, 1), (None, 0, 0, 1), (6, 60_000, 0, 2))})
        clean = decontaminate.clean_documents(d, bench)
        assert clean.columns == d.columns and sorted(r["doc_id"] for r in clean.collect()) == [2, 4, 5]
    assert decontaminate.contaminated(d, bench.limit(0)).count() == 0 and decontaminate.clean_documents(d.limit(0), bench).count() == 0


def labelled_docs(spark, n=400):
    good = "In the morning we walked along the river and talked about many things that mattered.\nLater the others came, and all of us ate together."
    bad = "BUY!! NOW!! CHEAP!! CLICK!! HERE!! BEST!! OFFER!!\nBUY!! NOW!! CHEAP!! CLICK!! HERE!! BEST!! OFFER!!"
    rows = []
    for i in range(n):
        text = " ".join(f"{w}{i * 7 % 13}" if j % 9 == 0 else w for j, w in enumerate((bad if i % 4 == 0 else good).split(" ")))
        if i % 5 == 0:
            text = text + f"\nYou are such a {'1d10t' if i % 2 else 'IDIOT'} and a ѕcum person{i}"
        rows.append((i, text))
    labels = spark.createDataFrame([(i, int(i % 4 != 0), int(i % 5 == 0)) for i in range(n)], "doc_id bigint, quality int, toxic int")
    return spark.createDataFrame(rows, DOCS), labels


@pytest.mark.parametrize(("module", "label"), [(quality, "quality"), (toxicity, "toxic")])
def test_held_out_accuracy(spark, module, label):
    docs, labels = labelled_docs(spark)
    odd = spark.createDataFrame([(1000, None), (1001, ""), (1002, "\n \n"), (None, "IDIOT"), (1003, "word " * 100_000), (1003, "word " * 100_000)], DOCS)
    out = module.score_documents(docs.union(odd).withColumn("score", F.lit("mine")).withColumn("label", F.lit(1)), labels)
    assert out.columns == ["doc_id", "held_out", "score", "predicted"] and out.count() == 406
    rows = out.collect()
    assert all(0 <= r["score"] <= 1 for r in rows) and all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    truth = {r["doc_id"]: r[label] for r in labels.collect()}
    held = [(r["predicted"], truth[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in truth]
    assert len(held) > 60 and sum(a == b for a, b in held) / len(held) > 0.97


@pytest.mark.parametrize("module", [quality, toxicity])
def test_without_labels(spark, module):
    docs, labels = labelled_docs(spark, 20)
    for own in (labels.limit(0), labels.withColumn("quality", F.lit(1)).withColumn("toxic", F.lit(0)), labels.withColumn("quality", F.lit(None).cast("int")).withColumn("toxic", F.lit(None).cast("int"))):
        assert module.score_documents(docs, own).count() == 20
    assert module.score_documents(docs.limit(0), labels).count() == 0


def test_quality_keeps_columns(spark):
    docs, labels = labelled_docs(spark, 80)
    own = docs.withColumn("row", F.lit("mine")).withColumn("predicted", F.lit(7)).withColumn("score", F.lit(None).cast("string"))
    own = own.union(own.limit(3)).union(spark.createDataFrame([(None, None, "a", 1, None)], own.schema))
    out = quality.good_documents(own, labels)
    want = Counter(r["doc_id"] for r in quality.score_documents(own, labels).collect() if r["predicted"])
    assert out.columns == own.columns and Counter(r["doc_id"] for r in out.collect()) == want and {r["predicted"] for r in out.collect()} == {7}
    assert quality.good_documents(own.limit(0), labels).count() == 0


def test_conflicting_and_repeated_labels(spark):
    docs, labels = labelled_docs(spark, 40)
    twice = labels.union(labels.withColumn("quality", 1 - F.col("quality")))
    sample = labelled.fit_sample(docs.union(docs), twice, "quality", 1000, 10_000)
    assert {r["y"] for r in sample.collect()} == {0} and sample.count() == labelled.fit_sample(docs, labels, "quality", 1000, 10_000).count()


def test_gradient_of_the_likelihood():
    """Against differences of the likelihood, itself a sum over all labellings."""
    import itertools

    import numpy as np

    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(7, 3)), rng.integers(0, 2, 7).astype(float)
    groups = [np.array([[0, 1, 2]]), np.array([[3], [6]]), np.array([[4, 5]])]
    w, turn = rng.normal(size=4), rng.normal(size=(2, 2))

    def likelihood(p):
        score, t = x @ p[:3] + p[3], p[4:].reshape(2, 2)
        value = lambda at, own: sum(s for s, a in zip(score[at], own, strict=True) if a) + sum(t[int(a), int(b)] for a, b in zip(own, own[1:], strict=False))
        return sum(value(at, y[at]) - np.log(sum(np.exp(value(at, own)) for own in itertools.product((0, 1), repeat=len(at)))) for g in groups for at in g)

    p = np.concatenate([w, turn.ravel()])
    want = [(likelihood(p + 1e-5 * e) - likelihood(p - 1e-5 * e)) / 2e-5 for e in np.eye(8)]
    slope, bend = quality._chain_gradient(x, y, groups, w, turn)
    assert np.concatenate([slope, bend.ravel()]) == pytest.approx(want, abs=1e-6)


def test_marginals_are_sums_over_labellings():
    import itertools

    import numpy as np

    rng = np.random.default_rng(0)
    scores, turn = rng.normal(size=5), rng.normal(size=(2, 2))
    weight = {y: np.exp(sum(s for s, a in zip(scores, y, strict=True) if a) + sum(turn[a, b] for a, b in zip(y, y[1:], strict=False))) for y in itertools.product((0, 1), repeat=5)}
    want = [sum(v for y, v in weight.items() if y[i]) / sum(weight.values()) for i in range(5)]
    assert quality.marginals(scores, turn) == pytest.approx(want)


def test_folding_and_exceptions():
    lexicon = toxicity.Lexicon({"".join(toxicity.folded(t).split()): 2.0 for t in ("idiot", "trash", "loser")})
    hits = lambda t: len(lexicon.hits(toxicity.folded(t)))
    assert [hits(t) for t in ("1d10t", "ІDІΟT", "îdïöt", "ＩＤＩＯＴ", "l0$er", "idiots!", "i​diot")] == [1] * 7
    assert [hits(t) for t in ("a trash can there", "trash talk", "videotape", "closer", "")] == [0, 1, 0, 0, 0]
    # phrases end at a word, and marks between their words don't matter
    assert [hits(t) for t in ("trash candy", "trash, can", "the trash -- CAN!", "trash can trash", "trash can, trash bin")] == [1, 0, 0, 1, 0]
    other = toxicity.Lexicon({"".join(toxicity.folded(t).split()): 2.0 for t in ("дурак", "בור")})
    assert [len(other.hits(toxicity.folded(t))) for t in ("ты Дурак!", "дур", "הוא בור")] == [1, 0, 1]
    assert toxicity.folded(" a\u0301 — Straße 1\n") == " a strasse i " or toxicity.folded(" a\u0301 — Straße 1\n") == " a strase i "


def test_fit_sample_is_bounded_and_not_held_out(spark):
    docs, labels = labelled_docs(spark)
    ids = docs.select(labelled.held_out(F.col("doc_id")).alias("h")).groupBy("h").count().collect()
    assert {r["h"]: r["count"] for r in ids}[False] == labelled.fit_sample(docs, labels, "quality", 10_000, 10_000).count()
    assert 60 < labelled.fit_sample(docs, labels, "quality", 100, 10_000).count() < 140
