"""Toxicity by a weighted lexicon, matched by an Aho-Corasick automaton on folded text.

Folding takes away accents, invisible characters, homoglyphs and digit substitutions, so that look-alikes of a term
meet it. A term matches at the start of a word and stands for all words that begin with it; terms of two and three
letters match whole words only, and end with a blank. Terms, weights and
exception phrases are learned from labelled documents; matched weights are normalised by the text's length.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled import fit_sample, held_out, logistic
from .scratch import Scratch

#: Labelled documents that are fitted on at most, the longest of them, and terms, and learned phrases, kept at most: they
#: bound the lexicon, which is learned from a bounded sample, and are arguments of ``fit``.
FIT_DOCS = 20_000
FIT_CHARS = 20_000
MOST_TERMS = 2_000
#: Phrases in which a term is meant kindly, besides those learned.
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "clown fish", "class clown", "idiot proof", "stupid question")
#: Letters of other alphabets that look like Latin ones.
HOMOGLYPHS = {
    "а": "a", "в": "b", "с": "c", "е": "e", "н": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x", "ԁ": "d", "ɡ": "g", "ո": "n", "ѵ": "v", "ԝ": "w",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ω": "w", "ı": "i", "ß": "s",
}
#: Digits and signs that stand for letters.
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s"}
_ODD = re.compile("[" + "".join(HOMOGLYPHS) + "]")
_HOMOGLYPHS = str.maketrans(HOMOGLYPHS)


#: 1, I and l are one; digits and signs stand for letters.
_LATIN = {chr(c): chr(c) for c in range(ord("a"), ord("z") + 1)} | SUBSTITUTES | {"l": "i"}
_TABLE = bytes(ord(_LATIN.get(chr(c).lower(), " ")) if c < 128 else 32 for c in range(256))
_SIGNS = str.maketrans({c: _LATIN[c] for c in (*SUBSTITUTES, "l")})
#: Accents and invisible characters, which go, and what parts words.
_DROPPED = re.compile("[\u0300-\u036f\u00ad\u200b-\u200f\u2060\ufe00-\ufe0f\ufeff]+")
_PARTS = re.compile(r"[\W\d_]+")


def folded(text: str | None) -> str:
    """Words of letters with one space between and around; look-alikes of Latin letters are these, others stay."""
    text = text or ""
    if text.isascii():
        own = text.encode().translate(_TABLE).decode()
    else:
        own = _DROPPED.sub("", unicodedata.normalize("NFKD", text).lower())
        own = own.translate(_HOMOGLYPHS) if _ODD.search(own) else own
        own = _PARTS.sub(" ", own.translate(_SIGNS))
    return f" {' '.join(own.split())} "


def counts_of(texts: DataFrame, shortest: int = 4, longest: int = 16) -> DataFrame:
    """``term, toxic, other``: documents of either label in which some word begins with the term.

    Shorter words of at least two letters count as themselves, with a blank.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[Counter, Counter] = (Counter(), Counter())

        def out() -> pa.RecordBatch:
            terms = list(held[0].keys() | held[1].keys())
            made = pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), *(pa.array([h[t] for t in terms], pa.int64()) for h in (held[1], held[0]))], names=["term", "toxic", "other"])
            held[0].clear(), held[1].clear()
            return made

        for batch in batches:
            for text, y in zip(batch.column(0), batch.column(1), strict=True):
                words = {w for w in folded(text.as_py()).split() if len(w) >= 2}
                terms = {w[:n] for w in words for n in range(shortest, min(len(w), longest) + 1)}
                held[int(y.as_py() == 1)].update(terms | {w + " " for w in words if len(w) < shortest})
                if len(held[0]) + len(held[1]) > 500_000:
                    yield out()
        yield out()

    return texts.mapInArrow(run, "term string, toxic bigint, other bigint").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))


@dataclass
class Lexicon:
    weights: dict[str, float]
    exceptions: tuple[str, ...] = EXCEPTIONS
    curve: tuple[float, ...] = (0.0, 0.0, 0.0, -2.0)
    _automaton: object = field(default=None, repr=False)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_automaton": None}  # each task builds its own

    def automaton(self):
        if self._automaton is None:
            made = ahocorasick.Automaton()
            for phrase in self.exceptions:
                made.add_word(folded(phrase), (None, float(len(folded(phrase)))))
            for term, weight in self.weights.items():
                made.add_word(" " + term, (term, weight))
            if len(made):
                made.make_automaton()
            self._automaton = made
        return self._automaton

    def hits(self, text: str) -> list[tuple[int, str, float]]:
        """End, term and weight of each match in a folded text, but for those within an exception phrase."""
        made = self.automaton()
        if not len(made):
            return []
        found, covered = [], set()
        for end, (term, value) in made.iter(text):
            if term is None:  # a phrase of whole words, with its length
                covered.update(range(end - int(value) + 1, end + 1))
            else:
                found.append((end - term.endswith(" "), term, value))
        return [h for h in found if h[0] not in covered] if covered else found

    def features(self, text: str | None) -> list[float]:
        own = folded(text)
        hits = self.hits(own)
        if not hits:
            return [0.0, 0.0, 0.0]
        total, words = sum(h[2] for h in hits), own.count(" ")
        return [math.log1p(total), min(10.0, 10 * total / math.sqrt(words)), math.log1p(len({h[1] for h in hits}))]

    def score(self, text: str | None) -> float:
        z = sum(a * b for a, b in zip(self.curve, self.features(text), strict=False)) + self.curve[-1]
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def chosen_terms(rows: list[tuple[str, int, int]]) -> dict[str, float]:
    """Weights by log-odds; of a chain of prefixes that the same documents hold, the longest speaks for all."""
    counts = {t: (a, b) for t, a, b in rows}
    heirs: dict[str, int] = {}  # most toxic documents of a term that is a letter longer
    for term, (toxic, _) in counts.items():
        heirs[term[:-1]] = max(heirs.get(term[:-1], 0), toxic if term[-1:] != " " else 0)
    out = {}
    for term, (toxic, other) in counts.items():
        longer = heirs.get(term, 0) >= 0.95 * toxic
        shorter = any(term[:n] in counts and counts[term[:n]][0] > 0 for n in range(4, len(term)))
        if longer:
            continue
        # a prefix that covers this term, and itself has no heir, is the better witness
        if shorter and any(term[:n] in counts and counts[term[:n]][0] >= toxic and heirs.get(term[:n], 0) < 0.95 * counts[term[:n]][0] for n in range(4, len(term))):
            continue
        out[term] = math.log((toxic + 0.5) / (other + 0.5))
    return out


def fit(docs: DataFrame, labels: DataFrame, fit_docs: int = FIT_DOCS, fit_chars: int = FIT_CHARS, most_terms: int = MOST_TERMS) -> Lexicon:
    """A lexicon from ``fit_docs`` labelled documents at most, of ``fit_chars`` characters each at most; ``most_terms``
    bounds its terms and its learned phrases."""
    sample = fit_sample(docs, labels, "toxic", fit_docs, fit_chars)
    scratch = Scratch(docs.sparkSession)
    sample = scratch.save(sample, "sample")
    # copies of a text are no further evidence
    distinct = scratch.save(sample.dropDuplicates(["text", "y"]), "distinct")
    every, toxic_docs = distinct.agg(F.count("*"), F.coalesce(F.sum((F.col("y") == 1).cast("int")), F.lit(0))).first()
    counts = scratch.save(counts_of(distinct), "counts")
    # so many documents of one label only that chance would rarely give any of the terms them
    chance = math.log(20 * max(1, counts.count())) / -math.log(min(0.9, (toxic_docs + 1) / (every + 2)))
    least = max(3, math.ceil(chance))
    precise = (F.col("toxic") >= least) & (F.col("toxic") >= 20 * F.col("other"))
    rows = counts.where(precise).orderBy(F.desc("toxic"), "term").limit(most_terms * 4).collect()
    weights = chosen_terms([(r["term"], r["toxic"], r["other"]) for r in rows])
    weights = dict(sorted(weights.items(), key=lambda x: (-x[1], x[0]))[:most_terms])
    lexicon = Lexicon(weights)

    def phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            said: list[tuple[str, int]] = []
            for text, y in zip(batch.column(0), batch.column(1), strict=True):
                own = folded(text.as_py())
                for end, _, _ in lexicon.hits(own):
                    last = own.find(" ", end)
                    before, after = own[: last if last >= 0 else None].split()[-2:], own[last:].split(maxsplit=1)[:1]
                    said += [(" ".join(before), y.as_py()), (" ".join([before[-1], *after]), y.as_py())]
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in said], pa.string()), pa.array([int(y) for _, y in said], pa.int64())], names=["phrase", "y"])

    kind = sample.mapInArrow(phrases, "phrase string, y bigint").groupBy("phrase").agg(F.sum("y").alias("toxic"), F.count("*").alias("n")).where("toxic = 0 and n >= 5 and phrase like '% %'")
    lexicon.exceptions = (*EXCEPTIONS, *(r["phrase"] for r in kind.orderBy(F.desc("n"), "phrase").limit(most_terms).collect()))
    lexicon._automaton = None

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [lexicon.features(t.as_py()) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.float64())), batch.column(1).cast(pa.int64())], names=["x", "y"])

    seen = sample.mapInArrow(features, "x array<double>, y bigint").collect()  # fit_docs rows at most
    if len({r["y"] for r in seen}) == 2:
        x, y = np.array([r["x"] for r in seen]), np.array([float(r["y"]) for r in seen])
        lexicon.curve = tuple(map(float, logistic(x, y, 1e-4)))
    elif seen:
        share = (sum(r["y"] for r in seen) + 1) / (len(seen) + 2)
        lexicon.curve = (0.0, 0.0, 0.0, math.log(share / (1 - share)))
    return lexicon


def score_documents(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.3, fit_docs: int = FIT_DOCS, fit_chars: int = FIT_CHARS, most_terms: int = MOST_TERMS) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every input row; only texts are features.

    Texts are scored whole, however long. Null, empty and blank texts score like any text without a match. Without labels of both kinds every text scores
    the labels' smoothed share, or a low constant. Repeated rows score alike; empty tables give no rows; other
    columns are ignored.
    """
    lexicon = fit(docs, labels, fit_docs, fit_chars, most_terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([lexicon.score(t.as_py()) for t in batch.column(1)], pa.float64())], names=["doc_id", "score"])

    slim = docs.select("doc_id", "text")
    out = slim.mapInArrow(run, f"doc_id {slim.schema[0].dataType.simpleString()}, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
