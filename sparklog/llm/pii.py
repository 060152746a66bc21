"""Personal data: exact patterns, and a semi-Markov conditional random field for what they miss.

The field scores whole candidate segments, not tokens: a segment's features see its full text, its digits, its
checksum and the word before it. A dynamic programme over the whole text chooses all boundaries and types at once.
Candidates are found from the rules themselves (runs with enough digits, chains of numbers, spellings of the
at-sign), in time linear in the text. What the patterns find is fixed, and the field adds spans beside it.
"""

from __future__ import annotations

import functools
import math
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
_AT = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Kind, start and end of each match, leftmost and without overlap in a kind; in time linear in the text."""
    out, end = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        if start < at and (m := _AT.match(text, at)):
            out.append(("email", start, m.end()))
            end = m.end()
        at = text.find("@", max(at + 1, end))
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m[0].split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", m.start(), m.end()))
    for m in _PHONE.finditer(text):
        if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
            out.append(("phone", m.start(), m.end()))
    return out


#: Digits of a card at most, and tokens of a number: each digit alone, two marks between any two.
MOST_DIGITS = 19
MOST_TOKENS = 55
#: Characters of an address's local part and of its domain at most (RFC 5321), a spelt dot counting as one.
LOCAL_CHARS, DOMAIN_CHARS = 64, 255
_TOKEN = re.compile(r"[^\W\d_]+|[0-9]+|[^\w\s]|_")
_FULL = {"email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"), "phone": _PHONE}
_SPELT = re.compile(
    r"(?i)[a-z0-9._%+-]+ ?(?:[\[({] ?at ?[\])}] ?[a-z0-9-]+(?: ?(?:[\[({] ?dot ?[\])}]|\.) ?[a-z0-9-]+)+| ?@ ?[a-z0-9-]+(?: ?(?:[\[({] ?dot ?[\])}]|\.) ?[a-z0-9-]+)+|(?<= )at [a-z0-9-]+(?: dot [a-z0-9-]+)+)"
)
_BROKEN_IP = re.compile(r"[0-9]{1,3}(?: ?(?:\[\.\]|\(\.\)|\[dot\]|\(dot\)| dot |\.) ?[0-9]{1,3}){3}")
_CUES = {"email": re.compile(r"(?i)^(e|mail|contact|write|courriel|correo)$"), "ip": re.compile(r"(?i)^(ip|host|server|address)$"), "card": re.compile(r"(?i)^(card|visa|mastercard|amex|credit|cc)$"), "phone": re.compile(r"(?i)^(phone|tel|telephone|call|fax|mobile|cell|handy|teléfono|téléphone)$")}
FEATURES = ("any", "spelt_email", "full_email", "broken_ip", "ip_parts", "phone_shape", "plus", "phone_digits", "card_digits", "luhn", "card_groups", "parens", "edge_mark", "cue", "few_tokens", "letters", "dated", "next_digit", "before_digit", "pairs", "runs_on", "dots_on")
_CUE = FEATURES.index("cue")


#: Groups of two digits, as in French phone numbers; and a number or a domain that goes on after or before a segment.
_PAIRS = re.compile(r"(?:\+?[0-9]{2,3}[ .-]?)?\(?[0-9]{1,2}\)?([ ._-]|)[0-9]{2}(?:\1[0-9]{2}){2,}")
_MORE = re.compile(r"[ ._-]{0,2}[0-9]")
_DOTS = re.compile(r"(?i) ?[\[({] ?dot ?[\])}] ?[a-z0-9]| dot [a-z0-9]| \. ?[a-z0-9]|\.[a-z0-9]")
_LESS = re.compile(r".*[0-9][ ._-]{0,2}$", re.S)


def segment_features(text: str, start: int, end: int, kind: str, before: str, next_char: str, n: int) -> list[float]:
    own = text[start:end]
    digits = re.sub(r"[^0-9]", "", own)
    parts = re.findall(r"[0-9]+", own)
    letters = any(c.isalpha() for c in own)
    return [
        1.0, float(bool(_SPELT.fullmatch(own))), float(bool(_FULL["email"].fullmatch(own))), float(bool(_BROKEN_IP.fullmatch(own))),
        float(len(parts) == 4 and all(len(p) < 4 and int(p) <= 255 for p in parts)), float(bool(re.fullmatch(r"\+?\(?[0-9][0-9 ().-]+[0-9]", own))), float(own[0] == "+"),
        float(9 <= len(digits) <= 12), float(13 <= len(digits) <= 19), float(13 <= len(digits) <= 19 and luhn(digits)), float(bool(re.fullmatch(r"[0-9]{4}([ ._-][0-9]{4}){2,3}[0-9 ._-]*", own))),
        float("(" in own and ")" in own), float(not (own[0].isalnum() or own[0] in "+(") or not own[-1].isalnum()), float(bool(_CUES[kind].match(before))), float(n <= 3), float(letters),
        float(bool(re.fullmatch(r"[0-9]{4}[-./ ][0-9]{1,2}[-./ ][0-9]{1,2}.*|[0-9]{1,2}[-./ ][0-9]{1,2}[-./ ][0-9]{4}.*", own))), float(next_char.isalnum()), float(start > 0 and (text[start - 1].isalnum() or text[start - 1] in "+.-")),
        float(bool(_PAIRS.fullmatch(own))), float(bool(_MORE.match(text, end) or _LESS.match(text[max(0, start - 4) : start]))), float(bool(_DOTS.match(text, end))),
    ]


_NUMBERS = re.compile(r"[0-9().+_-][0-9 ().+_-]{8,}")
_CHAIN = re.compile(r"(?<![0-9])[0-9]++(?: ?(?:\[\.\]|\(\.\)|\[dot\]|\(dot\)| dot |\.) ?[0-9]++){3,}+")
_SPELT_AT = re.compile(r"(?i)[\[({] ?at ?[\])}]|@|(?<= )at(?= )")
_SPELT_DOT = re.compile(r"(?i) ?[\[({] ?dot ?[\])}] ?| dot | ?\. ?")
_SPELT_DOMAIN = re.compile(r"(?i) ?[a-z0-9-]+(?: ?(?:[\[({] ?dot ?[\])}]|\.| dot ) ?[a-z0-9-]+)+")
#: What _SPELT takes before the at-sign, with the few letters beyond ASCII that ignoring case adds.
_SPELT_LOCAL = frozenset(c for c in map(chr, range(0x2200)) if re.fullmatch(r"(?i)[a-z0-9._%+-]", c))


def number_runs(text: str, low: int, high: int) -> Iterator[tuple[int, int]]:
    """Runs of digits, blanks and marks with as many digits as a phone number has."""
    return (m.span() for m in _NUMBERS.finditer(text, low, high) if sum(map(m[0].count, "0123456789")) >= 9)


def spelt_signs(text: str, low: int, high: int) -> Iterator[tuple[int, int, int, int]]:
    """Start and end of the local part, and of the domain, around each at-sign."""
    for at in _SPELT_AT.finditer(text, low, high):
        stop = at.start() - (at.start() > low and text[at.start() - 1] == " ")
        start = stop
        while start > max(low, stop - LOCAL_CHARS) and text[start - 1] in _SPELT_LOCAL:
            start -= 1
        # a spelt dot has nine characters at most
        if start < stop and (domain := _SPELT_DOMAIN.match(text, at.end(), min(high, at.end() + 5 * DOMAIN_CHARS))):
            yield start, stop, at.end(), domain.end()


class Stretch:
    """The tokens of ``text[low:high]``, with every candidate segment and its features.

    Candidates are spelt addresses, broken IPs, and 9 to 19 digits with blanks and marks, all on one line and without
    any token of a taken span.
    """

    def __init__(self, text: str, low: int, high: int, taken: list[tuple[int, int]] = ()):
        self.text, self.tokens, self.cells = text, [], []
        taken, k, cell, last = sorted(taken), 0, 0, low
        stop = -1  # end of the taken spans that start before the token
        for m in _TOKEN.finditer(text, low, high):
            while k < len(taken) and taken[k][0] < m.end():
                stop, k, cell = max(stop, taken[k][1]), k + 1, cell + 1
            if m.start() < stop:
                continue
            if text.find("\n", last, m.start()) >= 0:
                cell += 1
            self.tokens.append(m.span())
            self.cells.append(cell)
            last = m.end()
        self.starts, self.ends = [t[0] for t in self.tokens], [t[1] for t in self.tokens]
        self.segments: list[tuple[int, int, str]] = []
        rows = bytearray()  # features are 0 or 1
        for i, j, kinds in sorted({*self._numbers(low, high), *self._addresses(low, high), *self._ips(low, high)}):
            start, end = self.starts[i], self.ends[j - 1]
            before = text[self.tokens[i - 1][0] : self.tokens[i - 1][1]] if i else ""
            if before in (":", ".") and i > 1:
                before = text[self.tokens[i - 2][0] : self.tokens[i - 2][1]]
            own = bytes(map(int, segment_features(text, start, end, kinds[0], before, text[end : end + 1], j - i)))
            for kind in kinds:
                self.segments.append((i, j, kind))
                rows += own[:_CUE] + bytes([bool(_CUES[kind].match(before))]) + own[_CUE + 1 :]
        self.x = np.frombuffer(bytes(rows), dtype=np.uint8).reshape(-1, len(FEATURES))

    def _within(self, start: int, end: int) -> range:
        return range(bisect_left(self.starts, start), bisect_right(self.ends, end))

    def _numbers(self, low: int, high: int) -> Iterator[tuple[int, int, tuple[str, ...]]]:
        for run in number_runs(self.text, low, high):
            own = self._within(*run)
            sizes = {k: self.ends[k] - self.starts[k] if "0" <= self.text[self.starts[k]] <= "9" else 0 for k in own}
            for i in own:
                digits = 0
                for j in range(i, min(own.stop, i + MOST_TOKENS)):
                    digits += sizes[j]
                    if digits > MOST_DIGITS or self.cells[j] != self.cells[i]:
                        break
                    if digits >= 9:
                        yield i, j + 1, ("card", "phone")

    def _ips(self, low: int, high: int) -> Iterator[tuple[int, int, tuple[str, ...]]]:
        for chain in _CHAIN.finditer(self.text, low, high):
            own = [k for k in self._within(*chain.span()) if "0" <= self.text[self.starts[k]] <= "9"]
            for i, j in zip(own, own[3:]):
                if self.cells[i] == self.cells[j] and _BROKEN_IP.fullmatch(self.text, self.starts[i], self.ends[j]):
                    yield i, j + 1, ("ip",)

    def _addresses(self, low: int, high: int) -> Iterator[tuple[int, int, tuple[str, ...]]]:
        for start, stop, after, end in spelt_signs(self.text, low, high):
            begins = self._within(start, stop)
            for j in self._within(after, end) if begins else ():
                if len(_SPELT_DOT.sub(".", self.text[after : self.ends[j]]).strip()) > DOMAIN_CHARS:
                    break
                if _SPELT.fullmatch(self.text, self.starts[begins[-1]], self.ends[j]):
                    yield from ((i, j + 1, ("email",)) for i in begins if self.cells[i] == self.cells[j])


def _scores(s: Stretch, w: np.ndarray) -> np.ndarray:
    kinds = np.array([KINDS.index(k) for _, _, k in s.segments], dtype=int)
    return (np.concatenate([np.einsum("nf,nf->n", s.x[a : a + 10_000], w[kinds[a : a + 10_000]]) for a in range(0, len(kinds), 10_000)]) if len(kinds) else np.zeros(0)).tolist()


def best_segments(s: Stretch, w: np.ndarray) -> list[tuple[str, int, int]]:
    """The segmentation of highest score; a token outside all segments scores 0."""
    n, scores = len(s.tokens), _scores(s, w)
    best, back = [0.0] + [-math.inf] * n, [None] * (n + 1)
    by_end: dict[int, list[int]] = {}
    for k, (_, j, _) in enumerate(s.segments):
        by_end.setdefault(j, []).append(k)
    for j in range(1, n + 1):
        best[j] = best[j - 1]
        for k in by_end.get(j, ()):
            if (v := best[s.segments[k][0]] + scores[k]) > best[j]:
                best[j], back[j] = v, k
    out, j = [], n
    while j:
        if back[j] is None:
            j -= 1
        else:
            i, e, kind = s.segments[back[j]]
            out.append((kind, s.tokens[i][0], s.tokens[e - 1][1]))
            j = i
    return out[::-1]


def segment_marginals(s: Stretch, w: np.ndarray) -> np.ndarray:
    """P(segment) by the forward-backward recursion over segments."""
    n, scores = len(s.tokens), _scores(s, w)
    ahead, back = [0.0] * (n + 1), [0.0] * (n + 1)
    ends, begins = {}, {}
    for k, (i, j, _) in enumerate(s.segments):
        ends.setdefault(j, []).append(k)
        begins.setdefault(i, []).append(k)
    for j in range(1, n + 1):
        ahead[j] = float(np.logaddexp.reduce([ahead[j - 1], *(ahead[s.segments[k][0]] + scores[k] for k in ends.get(j, ()))]))
    for i in range(n - 1, -1, -1):
        back[i] = float(np.logaddexp.reduce([back[i + 1], *(back[s.segments[k][1]] + scores[k] for k in begins.get(i, ()))]))
    return np.array([math.exp(ahead[i] + scores[k] + back[j] - ahead[n]) for k, (i, j, _) in enumerate(s.segments)])


def made_sentences(n: int = 250, seed: int = 5) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """Sentences with personal data as people disguise it, and with numbers that are none."""
    rng = np.random.default_rng(seed)
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    digits = lambda k: "".join(map(str, rng.integers(0, 10, k)))
    word = lambda: "".join(pick("bcdfghklmnprstv") + pick("aeiou") for _ in range(int(rng.integers(1, 4))))

    def card() -> str:
        own = str(int(rng.integers(3, 7))) + digits(14)
        return next(own + str(c) for c in range(10) if luhn(own + str(c)))

    def email() -> str:
        at, dot = pick([(" [at] ", " [dot] "), (" (at) ", " (dot) "), (" at ", " dot "), ("[at]", "[dot]"), (" @ ", " . "), (" [AT] ", " [DOT] "), (" (At) ", " (Dot) ")])
        return pick([word(), word(), word() + "." + word()]) + at + word() + dot + pick(["", "", word() + dot]) + pick(["com", "org", "net", "de"])

    def ip() -> str:
        return pick(["[.]", " . ", "(.)", "[dot]", " dot "]).join(str(int(rng.integers(1, 256))) for _ in range(4))

    def pairs() -> str:
        return pick([" ", "-"]).join(["0" + digits(1), *(digits(2) for _ in range(4))])

    def phone() -> str:
        return pick(["({}) {}-{}", "{}-{}-{}", "{} {} {}", pairs()]).format(digits(3), digits(3), digits(4))

    def spaced() -> str:
        own = card()
        mark, wide = pick([(".", 4), ("_", 4), ("_", 2)])
        return mark.join(own[i : i + wide] for i in range(0, 16, wide))

    def other() -> str:
        return pick([f"20{digits(2)}-{pick(['01', '10', '12'])}-{digits(2)} 10:{digits(2)}", f"{digits(1)}.{digits(1)}.{digits(2)}", digits(int(rng.integers(3, 25))), f"${digits(3)},{digits(3)},{digits(3)}", f"at {word()} dot", f"{digits(4)} {digits(4)} {digits(4)} {digits(2)}", f"20{digits(2)}/{digits(2)}/{digits(2)} {digits(6)}", f"{digits(6)}-{digits(6)}", f"{digits(5)} {digits(5)} {digits(5)}", " ".join(str(k) for k in range(1, int(rng.integers(8, 20)))), pick([" ", "-", ", ", ". "]).join(digits(int(rng.integers(1, 3))) for _ in range(int(rng.integers(5, 25)))), pick([" ", " - "]).join(f"{digits(1)}.{digits(2)}" for _ in range(int(rng.integers(3, 12))))])

    cue = {"email": ["mail", "contact", ""], "ip": ["host", "ip", ""], "card": ["card", "visa", ""], "phone": ["phone", "tel:", "call", "fax"]}
    out = []
    for _ in range(n):
        text, spans = word() + " ", []
        for _ in range(int(rng.integers(1, 4))):
            kind = pick([*KINDS, "none", "none"])
            text += " ".join(word() for _ in range(int(rng.integers(1, 4)))) + " "
            if kind == "none":
                text += other() + " "
                continue
            text += (c + " ") if (c := pick(cue[kind])) else ""
            own = {"email": email, "ip": ip, "card": spaced, "phone": phone}[kind]()
            spans.append((kind, len(text), len(text) + len(own)))
            text += own + pick([" ", ", ", ". "])
        out.append((text + word() + ".", spans))
    return out


@functools.lru_cache(1)
def fitted(rounds: int = 80) -> np.ndarray:
    """Weights by kind and feature, by gradient ascent on the conditional likelihood of the made sentences."""
    rows = []
    for text, spans in made_sentences():
        s = Stretch(text, 0, len(text))
        if s.segments:
            true = set(spans)
            rows.append((s, np.array([(k, s.tokens[i][0], s.tokens[j - 1][1]) in true for i, j, k in s.segments], dtype=float)))
    w, m, v = np.zeros((len(KINDS), len(FEATURES))), 0.0, 0.0
    w[:, 0] = -1.0
    for r in range(1, rounds + 1):
        g = -2e-3 * w
        for s, y in rows:
            off = (y - segment_marginals(s, w)) / len(rows)
            np.add.at(g, np.array([KINDS.index(k) for _, _, k in s.segments]), s.x * off[:, None])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w + 0.2 * (m / (1 - 0.9**r)) / (np.sqrt(v / (1 - 0.999**r)) + 1e-8)
    return w


def added_spans(text: str, base: list[tuple[str, int, int]], w: np.ndarray) -> list[tuple[str, int, int]]:
    if not _CHAIN.search(text) and not any(map(any, (number_runs(text, 0, len(text)), spelt_signs(text, 0, len(text))))):
        return []  # no candidate, so that tokens aren't needed
    own = Stretch(text, 0, len(text), [(s, e) for _, s, e in base])
    return best_segments(own, w) if own.segments else []


def spans_of(text: str | None, w: np.ndarray) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """The patterns' spans, and those with the field's, by kind and start."""
    if not text or not re.search("[0-9@]|[Aa][Tt]", text):
        return [], []
    base = base_spans(text)
    key = lambda s: (KINDS.index(s[0]), s[1])
    return sorted(base, key=key), sorted([*base, *added_spans(text, base, w)], key=key)


def find_personal_data(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, base, spans`` for every input row: lists of ``kind, start, stop`` in code points, the end exclusive.

    Null, empty and clean texts have empty lists. Repeated rows are alike; empty tables give no rows; other columns
    are ignored. The field is fitted once, on made sentences; no text of the table is learned from.
    """
    w = fitted()
    span = "array<struct<kind:string,start:bigint,stop:bigint>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64())]))
        as_rows = lambda spans: [{"kind": k, "start": s, "stop": e} for k, s, e in spans]
        for batch in batches:
            both = [spans_of(t.as_py(), w) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([as_rows(b[i]) for b in both], kind) for i in (0, 1))], names=["doc_id", "base", "spans"])

    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return slim.mapInArrow(run, f"doc_id {slim.schema[0].dataType.simpleString()}, base {span}, spans {span}")
