"""Personal data: exact base patterns, and a linear-chain conditional random field over word shapes that adds spans.

The base patterns find e-mail addresses, IP addresses, card and telephone numbers. The field reads blank-separated
tokens by their shape (counts of digits, letters and signs, first and last character, the neighbours' shapes), is
trained on the labelled lines of ``labelled_lines`` and decoded by Viterbi. It adds what is written otherwise, such as
telephone numbers without a plus sign, card numbers with other separators or addresses with a bracketed "at"; an added
span has to read as its kind (Luhn, parts up to 255, number of digits) and never touches a base span. A run of tagged tokens
is read without its base spans, and may hold several spans side by side.

Decoding whole texts is cheap because a chain can be cut where the best tag is certain: once for each model,
``certain_plain`` proves from the weights that a token of plain letters between plain tokens is outside of any span
whatever its neighbours' tags are. Only the runs between such tokens are decoded, with the known tags at their ends, which
gives the same tags as decoding the line as a whole; if the proof failed, whole lines would be decoded.

No shuffle; a part of a batch is held at a time. Patterns start at ``@``, ``+`` or the first digit of a run, so long
runs of letters or digits cost linear time.

Defined cases: null is the empty text; a text without finds has empty spans and the hash of the empty string; repeated
rows give repeated results; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from routelens.llm.crf import Chains, LinearChain
from routelens.llm.tables import bounded_batches, table
from routelens.llm.words import parts

KINDS = ("email", "ip", "card", "phone")
OUTSIDE = len(KINDS)

# fixed values of the contract: the base patterns
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_NO_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            done = found.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns, in order."""
    out = [(a, 0, b) for a, b in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(len(p) <= 3 and int(p or 0) <= 255 for p in (g.lstrip("0") for g in m.groups()))]
        for m in CARD.finditer(text):
            digits = _NO_DIGIT.sub("", m[0])
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= len(_NO_DIGIT.sub("", m[0])) <= 15]
    return sorted(out)


# token shapes ---------------------------------------------------------------------------------------------------

_CLASS = np.zeros(256, np.int64)  # 0: other sign
for _chars, _k in ((b"0123456789", 1), (bytes(range(65, 91)) + bytes(range(97, 123)), 2), (b"@", 3), (b".", 4), (b"+", 5), (b"-/", 6), (b"()[]", 7), (b",;:!?'\"", 8)):
    _CLASS[list(_chars)] = _k
_CLASS[128:] = 2
CLASSES = 9
_BLANK = np.zeros(256, bool)
_BLANK[:33] = True
#: count -> bucket, for digits, letters and the signs @ . + - ()
_DIGITS = np.array([0, 1, 2, 3, 4, 5, 5, 6, 6, 6, 7, 7, 7, 8, 8, 8, 8, 8, 8, 8, 9])
_LETTERS = np.array([0, 1, 2, 2, 3])
_SIGNS = np.array([0, 1, 2, 3, 3])
SIZES = (10, 4, 2, 4, 2, 3, 2)
SHAPES = int(np.prod(SIZES))
#: the feature slots: own shape, shape before, shape after, own digits, first and last character, ends of the line
_SLOTS = np.cumsum([0, SHAPES, SHAPES + 1, SHAPES + 1, 10, CLASSES * CLASSES, 4])
FEATURES = int(_SLOTS[-1])


def token_shapes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end, row, line (counted over all rows), shape and edge characters of every blank-separated token."""
    n = len(data)
    z = np.zeros(0, np.int64)
    if not n:
        return z, z, z, z, z, z
    inside = ~_BLANK[data]
    edge = offsets[(offsets > 0) & (offsets < n)]
    before, after = np.append(False, inside[:-1]), np.append(inside[1:], False)
    before[edge], after[edge - 1] = False, False
    start, end = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    if not len(start):
        return z, z, z, z, z, z
    row = np.searchsorted(offsets, start, side="right") - 1
    line = np.cumsum(data == 10)[start] + row
    kind = _CLASS[data]

    def count(k: int, most: int) -> np.ndarray:
        return np.minimum(np.add.reduceat((kind == k) & inside, start, dtype=np.int64), most)

    buckets = (_DIGITS[count(1, 20)], _LETTERS[count(2, 4)], count(3, 1), _SIGNS[count(4, 4)], count(5, 1), count(6, 2), count(7, 1))
    shape = np.zeros(len(start), np.int64)
    for bucket, size in zip(buckets, SIZES, strict=True):
        shape = shape * size + bucket
    # letters with any stops are one plain shape
    plain = (buckets[0] == 0) & (buckets[2] == 0) & (buckets[4] == 0) & (buckets[6] == 0)
    shape[plain] = 0
    edges = kind[start] * CLASSES + kind[end - 1]
    edges[plain] = 2 * CLASSES + 2
    return start, end, row, line, shape, edges


def shape_features(line: np.ndarray, shape: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Feature ids of each token; the neighbours are those in the same line."""
    n = len(shape)
    same = line[1:] == line[:-1]
    before, after = np.full(n, SHAPES), np.full(n, SHAPES)
    before[1:][same], after[:-1][same] = shape[:-1][same], shape[1:][same]
    digits = shape // (SHAPES // SIZES[0])
    ends = (before == SHAPES) * 2 + (after == SHAPES)
    return np.stack([shape, before + _SLOTS[1], after + _SLOTS[2], digits + _SLOTS[3], edges + _SLOTS[4], ends + _SLOTS[5]], axis=1)


# the labelled table ---------------------------------------------------------------------------------------------

#: forms of each kind and of what only looks like one; every form is put into every frame
FORMS = {
    "email": ("jo.lee@mail.example.com", "anna_b+list@sub.example.org", "x9@example.net", "sales[at]example.co.uk", "t.ross(at)example.com", "info(at)example.net", "bo[at]example.com"),
    "ip": ("192.168.10.24", "8.8.4.4", "10.0.255.1", "172[.]16[.]0[.]9", "203.0.113.77:8080", "(10.1.2.3)"),
    "card": ("4111111111111111", "4111 1111 1111 1111", "5500-0000-0000-0004", "4012.8888.8888.1881", "3782 822463 10005", "6011/1111/1111/1117", "4222222222222"),
    "phone": ("+1 (255) 555-8013", "+49 30 1234567", "(415) 555-0133", "415-555-0176", "0171/555 0199", "555.010.4477", "020 7946 0958", "+33.1.70.18.99.00", "1-800-555-0100"),
    "": ("2024", "3", "version 2.0.", "12,500", "1.5", "v1.2.3", "2021-03-04", "12/05/1999", "10:45", "AKIAPPKKDB7LEKU7L", "password=e3b3ed3c", "b9dfda", "d7f3a9c2e4", "8f5c\"", "page 12 of 90", "100%", "$45.00", "C++", "3x4", "#1", "section 4.2.1", "+1", "ratio 3:1", "isbn", "e4", "7th", "A-1", "(2)", "(see 3)", "item[4]", "-5", "f(x)", "@", "a @ b", "and/or", "kim@localhost"),
}
FRAMES = ("{}", "please call or write {} today", "The entry {}, was added.", "of the thing {} and then", "is: {}", "{} ist hier", "word {}", "una {} en la lista (nota)", "Reach me: {}; thanks.")
PLAIN = ("the of and in that which", "Le chat est là, oui.", "Der Hund; schläft!", "¿Qué tal? (bien)", "a | b | c", "WORD!! WORD!! OTHER!!", "thing%%% of$$$ other*** then", "it's a well-known fact", "etc. and so on ...")


def labelled_lines() -> list[tuple[str, int, int, int]]:
    """(line, start, end, tag) of the training table: every form in every frame, and lines without any."""
    out = [(line, 0, 0, OUTSIDE) for line in PLAIN for _ in range(4)]
    for kind, forms in FORMS.items():
        for form in forms:
            for frame in FRAMES:
                start = frame.index("{}")
                tag = KINDS.index(kind) if kind else OUTSIDE
                out.append((frame.replace("{}", form), len(frame[:start].encode()), len(frame[:start].encode()) + len(form.encode()), tag))
    return out


@cache
def train_field() -> LinearChain:
    """The field learned from the labelled table."""
    lines = labelled_lines()
    raw = [line.encode() for line, *_ in lines]
    offsets = np.concatenate(([0], np.cumsum([len(x) for x in raw]))).astype(np.int64)
    start, end, row, line, shape, edges = token_shapes(np.frombuffer(b"".join(raw), np.uint8), offsets)
    marked = np.array([(a, b, tag) for _, a, b, tag in lines])[row]
    own = start - offsets[row]
    tags = np.where((own < marked[:, 1]) & (end - offsets[row] > marked[:, 0]), marked[:, 2], OUTSIDE)
    return LinearChain(FEATURES, len(KINDS) + 1).fit(shape_features(line, shape, edges), tags, np.bincount(row), rounds=400, rate=0.5, ridge=1e-5)


def certain_plain(field: LinearChain) -> bool:
    """Is a plain token next to plain tokens, or at an end of its line, outside of any span whatever the tags around it?"""
    step, start = field.step, field.start
    for b, a in ((0, 0), (0, 1), (1, 0), (1, 1)):
        ids = np.array([[0, (SHAPES if b else 0) + _SLOTS[1], (SHAPES if a else 0) + _SLOTS[2], _SLOTS[3], 2 * CLASSES + 2 + _SLOTS[4], 2 * b + a + _SLOTS[5]]])
        e = field.emissions(ids)[0]
        for x in range(len(KINDS)):
            into = start[OUTSIDE] - start[x] if b else (step[:, OUTSIDE] - step[:, x]).min()
            out = 0.0 if a else (step[OUTSIDE] - step[x]).min()
            if e[OUTSIDE] - e[x] + into + out <= 1e-6:
                return False
    return True


class ShapeTagger:
    def __init__(self, field: LinearChain):
        self.field, self.cut = field, certain_plain(field)

    def tags(self, line: np.ndarray, shape: np.ndarray, edges: np.ndarray, cut: bool | None = None) -> np.ndarray:
        """The best tag of every token."""
        n = len(shape)
        out = np.full(n, OUTSIDE, np.int8)
        if not n:
            return out
        same = line[1:] == line[:-1]
        odd = shape != 0
        near = odd.copy()
        near[1:] |= odd[:-1] & same
        near[:-1] |= odd[1:] & same
        if not (self.cut if cut is None else cut):
            near[:] = True
        at = np.flatnonzero(near)
        if not len(at):
            return out
        new = np.append(True, (at[1:] != at[:-1] + 1) | (line[at[1:]] != line[at[:-1]]))
        first = np.flatnonzero(new)
        length = np.diff(np.append(first, len(at)))
        lo, hi = at[first], at[first + length - 1]
        # next to a run lies a certain token of the same line, or an end of the line
        before = np.where((lo > 0) & (line[np.maximum(lo - 1, 0)] == line[lo]), OUTSIDE, -1)
        after = np.where((hi < n - 1) & (line[np.minimum(hi + 1, n - 1)] == line[hi]), OUTSIDE, -1)
        order = np.argsort(-length, kind="stable")
        window = np.unique(np.concatenate([np.maximum(at - 1, 0), at, np.minimum(at + 1, n - 1)]))
        ids = shape_features(line[window], shape[window], edges[window])[np.searchsorted(window, at)]
        out[at] = self.field.viterbi(self.field.emissions(ids), Chains(length), before[order], after[order])
        return out

    def added(self, texts: pa.Array) -> list[list[tuple[int, int, int]]]:
        """(start, kind, end) in code points of the tagged runs of each text."""
        out: list[list] = [[] for _ in range(len(texts))]
        for lo, _, data, offsets in parts(texts):
            start, end, row, line, shape, edges = token_shapes(data, offsets)
            tags = self.tags(line, shape, edges)
            hit = np.flatnonzero(tags != OUTSIDE)
            if not len(hit):
                continue
            point = np.cumsum((data & 0xC0) != 0x80)
            base = np.concatenate(([0], point))[offsets[:-1]]
            joined = np.append(False, (hit[1:] == hit[:-1] + 1) & (line[hit[1:]] == line[hit[:-1]]) & (tags[hit[1:]] == tags[hit[:-1]]))
            begin = np.flatnonzero(~joined)
            for a, b in zip(hit[begin], hit[np.append(begin[1:], len(hit)) - 1], strict=True):
                r = row[a]
                out[lo + r].append((int(point[start[a]] - 1 - base[r]), int(tags[a]), int(point[end[b] - 1] - base[r])))
        return out


_AT = re.compile(r"[A-Za-z0-9._%+-]+\s?(?:@|[(\[]at[)\]]|\bat\b)\s?[A-Za-z0-9-]+(?:(?:\.|\s?[(\[]dot[)\]]\s?|\sdot\s)[A-Za-z0-9-]+)+", re.I)
_PARTS = re.compile(r"[0-9]+")


def reads_as(kind: int, text: str) -> tuple[int, int] | None:
    """Where in ``text`` a span of that kind lies, if it can be read as one."""
    if kind == 0:
        m = _AT.search(text)
        return (m.start(), m.end()) if m else None
    runs = list(_PARTS.finditer(text))
    if not runs:
        return None
    lo, hi = runs[0].start(), runs[-1].end()
    digits = "".join(m[0] for m in runs)
    if re.search(r"[A-Za-z]", text[lo:hi]):
        return None
    if kind == 1:
        four = runs[:4]
        ok = len(four) == 4 and all(len(m[0]) <= 3 and int(m[0]) <= 255 for m in four) and all("." in text[a.end() : b.start()] for a, b in zip(four, four[1:], strict=False))
        return (lo, four[-1].end()) if ok else None
    if kind == 2:
        return (lo, hi) if 13 <= len(digits) <= 19 and luhn(digits) else None
    grouped = len(runs) >= 3 or (len(runs) == 2 and re.search(r"[()/-]", text[:hi]))
    if not grouped or not 9 <= len(digits) <= 15:
        return None
    return (lo - 1 if lo and text[lo - 1] in "+(" else lo), hi


#: what parts neighbouring finds besides blanks, and the most such units in one find
_UNITS = {1: re.compile(r"[^\s,;|/-]+"), 2: re.compile(r"[^\s,;|]+"), 3: re.compile(r"[^\s,;|]+")}
UNITS = 20


def finds(kind: int, text: str) -> list[tuple[int, int]]:
    """Where spans of that kind lie in ``text``, a run of tokens that may hold several side by side.

    The run is cut between units so that the spans hold the most digits; then as few spans as can be go over a comma
    or a later plus sign, then there are the fewest spans, then they are of the most even lengths.
    """
    if kind == 0:
        return [m.span() for m in _AT.finditer(text)]
    units = [m.span() for m in _UNITS[kind].finditer(text)]
    marks = [0, *[int(text[b] == "+" or bool(re.search(r"[,;|]", text[a:b]))) for (_, a), (b, _) in zip(units, units[1:], strict=False)]]
    best: list[tuple] = [(0, 0, 0, 0)]
    came: list[tuple] = []
    for j in range(len(units)):
        score, span, back = best[j], None, j
        for i in range(j, max(j - UNITS, -1), -1):
            lo, hi = units[i][0], units[j][1]
            found = reads_as(kind, text[lo:hi])
            if not found:
                continue
            n = len(_NO_DIGIT.sub("", text[lo + found[0] : lo + found[1]]))
            x = best[i]
            new = (x[0] - n, x[1] + any(marks[i + 1 : j + 1]), x[2] + 1, x[3] + n * n)
            if new < score:
                score, span, back = new, (lo + found[0], lo + found[1]), i
        best.append(score)
        came.append((back, span))
    out, j = [], len(units) - 1
    while j >= 0:
        back, span = came[j]
        if span:
            out.append(span)
        j = back - 1
    return out[::-1]


def spans_of(text: str, tagged: list[tuple[int, int, int]]) -> tuple[list, list]:
    """Base spans, and base and added spans together, in order."""
    base = base_spans(text)
    extra = []
    for start, kind, end in tagged:
        at = start
        for a, b in [(a, b) for a, _, b in base if a < end and start < b] + [(end, end)]:
            extra += [(at + x, kind, at + y) for x, y in finds(kind, text[at : max(a, at)])]
            at = max(at, b)
    return base, sorted(base + extra)


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def find_personal_data(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added) of every row; the counts are of base spans."""
    bounded_batches(docs.sparkSession)
    field = train_field()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = ShapeTagger(field)
        for batch in batches:
            texts = batch.column("text")
            counts = np.zeros((len(texts), len(KINDS)), np.int64)
            digest, spans, added = [], [], []
            for i, tagged in enumerate(tagger.added(texts)):
                base, every = spans_of(texts[i].as_py() or "", tagged)
                for _, k, _ in base:
                    counts[i, k] += 1
                digest.append(hashlib.sha256(_joined(base).encode()).hexdigest())
                spans.append(_joined(every))
                added.append(len(every) - len(base))
            columns = [batch.column("doc_id"), *[pa.array(c) for c in counts.T.copy()], pa.array(digest, pa.string()), pa.array(spans, pa.string()), pa.array(added, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans", "n_added"])

    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def op7_pii_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    return find_personal_data(table(spark, sf_dir, "documents"))
