"""Personal data by fixed patterns and a semi-Markov conditional random field over whole spans.

The patterns give the base spans, which always stay. Around digits, ``@`` and spelled-out signs the text falls into islands
(runs of neighbouring words that hold such signs). In an island every stretch of up to ``MAX_TOKENS`` tokens that could be
of a kind is a candidate segment; features describe the whole span (digit count, checksum, separators, host name shape,
what precedes and follows it). A segmentation scores the sum over its segments plus weights between neighbouring
types; gaps cost nothing. Dynamic programming over token positions, with segments of bounded length, gives the partition
function for training and the best joint choice of boundaries and types for decoding, where base spans are held fixed.

Training text: at most ``MAX_DOCS`` documents with base spans (smallest id hash), whose islands are labelled by their base
spans; each island is also rewritten with the same data in forms that the patterns miss (no plus sign, dots or slashes
between digit groups, spelled-out signs), and with look-alikes that are no personal data (dates, amounts, versions, numbers that fail the checksum).

Defined cases: null and empty texts have no spans; with no base span in the table the field is left out and base spans are
the result (there are none); repeated rows each get their spans; null ids are kept; overlapping base spans of different
kinds all stay; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_left
from collections.abc import Callable
from itertools import accumulate, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronopanel.llm.common import column, map_batches

KINDS = ("email", "ip", "card", "phone")
MAX_TOKENS, MAX_CHARS, MAX_DOCS, CONTEXT, STATES = 24, 120, 400, 64, len(KINDS) + 1
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
IP = re.compile(r"[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGITS = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        d = d * 2 if k % 2 else d
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def digits_of(text: str) -> str:
    return "".join(DIGITS.findall(text))


def emails(text: str):
    """Leftmost matches of local@domain, found from each @ so that long words cost linear time."""
    floor, at = 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > floor and LOCAL.match(text, begin - 1):
            begin -= 1
        m = DOMAIN.match(text, at + 1) if begin < at else None
        if m:
            yield begin, m.end()
            floor = m.end()
        else:
            floor = max(floor, at + 1)
        at = text.find("@", max(at + 1, floor))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in order of kind as listed, then start."""
    out = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    if not DIGITS.search(text):
        return out
    out += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        d = digits_of(m[0]) if m.end() - m.start() < 64 else ""
        if 16 <= len(d) <= 19 and luhn(d):
            out.append(("card", m.start(), m.end()))
    for m in PHONE.finditer(text):
        if 8 <= len(digits_of(m[0])) <= 15:
            out.append(("phone", m.start(), m.end()))
    return out


# ---- candidate segments -------------------------------------------------------------------------------------------

SIGN = re.compile(r"[0-9@]|[\[({]\s?(?:at|dot)\s?[\])}]", re.I)
WORDS = re.compile(r"\S+")
TOKENS = re.compile(r"[0-9]+|[^\W\d_]+|\S")
AT = re.compile(r"@|[\[({]\s?at\s?[\])}]", re.I)
SEPARATORS = " -.()/+:@_"
HOST = re.compile(r"[\w-]+(?:(?:\.|[\[({]\s?dot\s?[\])}])[\w-]+)+", re.I)


def islands(text: str) -> list[tuple[int, int]]:
    """Whole runs of neighbouring words on one line that hold digits or signs."""
    if not SIGN.search(text):
        return []
    out: list[list[int]] = []
    for m in WORDS.finditer(text):
        if SIGN.search(m[0]):
            if out and m.start() - out[-1][1] == 1 and text[m.start() - 1] == " ":
                out[-1][1] = m.end()
            else:
                out.append([m.start(), m.end()])
    return [(a, b) for a, b in out]


def possible(span: str, digits: str) -> list[int]:
    """Kinds that a whole span could be of."""
    out, n = [], len(digits)
    if 5 <= len(span) and AT.search(span) and (span.count(".") or "dot" in span.lower()) and not any(c.isspace() for c in span):
        out.append(0)
    elif "@" not in span and all(c in "0123456789 -.()/+[]" for c in span):
        if 4 <= n <= 12 and span.count(".") >= 3 and " " not in span:
            out.append(1)
        if 13 <= n <= 19 and "(" not in span:
            out.append(2)
        if 7 <= n <= 15:
            out.append(3)
    return out


def features(text: str, start: int, end: int, span: str, digits: str, kind: int) -> np.ndarray:
    """Whole-span features of a segment of one kind."""
    f = np.zeros(SIZE)
    n = len(digits)
    before, after = text[start - 1:start], text[end:end + 1]
    f[0] = 1
    f[1] = (not before) or before.isspace() or before in "(<[\"':="
    f[2] = (not after) or after.isspace() or after in ".,;:)>]\"'!?"
    f[3] = before.isalnum() or before in ("+", "@", ".", "-", "/", "_") and bool(before)
    f[4] = after.isalnum() or after in ("@", "-", "/", "_") and bool(after) or after == "." and text[end + 1:end + 2].isalnum()
    f[5 + min(max(n - 4, 0), 15)] = 1                                   # 5..20: digit count
    for k, s in enumerate(SEPARATORS):
        f[21 + k] = s in span                                           # 21..30
    groups = re.split(r"[^0-9]+", span.strip("+()[] "))
    f[31] = len(groups)
    f[32] = len({len(g) for g in groups}) == 1
    f[33] = 2 <= min(map(len, groups)) and max(map(len, groups)) <= 4
    f[34] = kind == 2 and luhn(digits)
    f[35] = kind == 1 and len(groups) == 4 and all(g and int(g) <= 255 for g in groups)
    f[36] = kind == 0 and bool(HOST.fullmatch(AT.split(span, maxsplit=1)[-1])) and span.count("@") <= 1
    f[37] = span[0] == "+"
    f[38] = len({c for c in span if c in "-./ "}) > 1
    f[39] = n > 0 and n == len(span)
    f[40] = kind == 3 and len(groups[-1]) >= 3
    f[41] = kind == 0 and len(AT.findall(span)) == 1
    f[42] = kind == 3 and n in (10, 11, 12)
    f[43] = len(groups) >= 3 and kind >= 2
    word = re.findall(r"[^\W\d_]+", text[max(0, start - 24):start].lower())
    f[44 + int(hashlib.md5((word[-1] if word else "").encode()).hexdigest()[:6], 16) % 12] = CONTEXT_WEIGHT
    return f


CONTEXT_WEIGHT, SIZE = 0.2, 56


def candidates(text: str, tokens: list[tuple[int, int]], i: int):
    """(token after the last, kind, start, end, span, digits) of the candidates that begin at token ``i``."""
    start = tokens[i][0]
    head = text[start]
    if not (head.isalnum() or head in "+("):
        return
    spaced = worded = False
    for j in range(i, min(len(tokens), i + MAX_TOKENS)):
        stop = tokens[j][1]
        spaced, worded = spaced or j > i and tokens[j][0] > tokens[j - 1][1], worded or text[stop - 1].isalpha() or text[stop - 1] == "@"
        if stop - start > MAX_CHARS or spaced and worded:       # words and spaces together are of no kind
            break
        if not (text[stop - 1].isalnum()):
            continue
        span = text[start:stop]
        digits = digits_of(span)
        for kind in possible(span, digits):
            yield j + 1, kind, start, stop, span, digits


def lattice(text: str, begin: int, end: int) -> tuple[int, list[tuple[int, int, int, int, int, np.ndarray]]]:
    """Token count and candidates (from token, to token, kind, start, end, features) of an island."""
    tokens = [(m.start(), m.end()) for m in TOKENS.finditer(text, begin, end)]
    return len(tokens), [(i, j, kind, start, stop, features(text, start, stop, span, digits, kind)) for i in range(len(tokens)) for j, kind, start, stop, span, digits in candidates(text, tokens, i)]


class SpanField:
    """Weights per kind over span features, and between neighbouring types; state 4 is the start of an island."""

    def __init__(self):
        self.w, self.between = np.zeros((len(KINDS), SIZE)), np.zeros((STATES, len(KINDS)))

    def _scores(self, cands) -> np.ndarray:
        return np.array([self.w[c[2]] @ c[5] for c in cands])

    def best(self, n: int, cands, fixed: set[tuple[int, int, int]] = frozenset()) -> list[int]:
        """Candidates of the best segmentation; those whose (kind, start, end) is in ``fixed`` are always taken."""
        scores = self._scores(cands) + np.array([1e6 if (c[2], c[3], c[4]) in fixed else 0.0 for c in cands])
        top = np.full((n + 1, STATES), -np.inf)
        top[0, STATES - 1] = 0
        back: dict[tuple[int, int], tuple] = {}
        ends = _by_end(cands)
        for t in range(1, n + 1):
            for s in range(STATES):
                top[t, s] = top[t - 1, s]
                back[t, s] = (t - 1, s, None)
            for k in ends.get(t, ()):
                i, kind = cands[k][0], cands[k][2]
                s = int(np.argmax(top[i] + self.between[:, kind]))
                value = top[i, s] + self.between[s, kind] + scores[k]
                if value > top[t, kind]:
                    top[t, kind], back[t, kind] = value, (i, s, k)
        t, s, out = n, int(np.argmax(top[n])), []
        while t > 0:
            t, s, k = back[t, s]
            if k is not None:
                out.append(k)
        return out[::-1]

    def decode(self, text: str, begin: int, end: int, fixed: set[tuple[int, int, int]], free: Callable[[int, int], bool]) -> list[tuple[int, int, int]]:
        """(kind, start, end) of the best segmentation of an island of any length, among candidates that are ``fixed`` or lie on ``free`` text.

        The same as ``best`` on the whole lattice. A candidate is scored where it begins and forgotten, so what is kept is a
        few numbers for each token.
        """
        tokens = [(m.start(), m.end()) for m in TOKENS.finditer(text, begin, end)]
        n = len(tokens)
        top, back = [[-np.inf] * STATES for _ in range(n + 1)], {}
        top[0][STATES - 1] = 0.0
        for t in range(n + 1):
            if t:
                for s, value in enumerate(top[t - 1]):
                    if value >= top[t][s]:
                        top[t][s] = value
                        back.pop((t, s), None)
            if t == n:
                break
            for j, kind, start, stop, span, digits in candidates(text, tokens, t):
                held = (kind, start, stop) in fixed
                if held or free(start, stop):
                    s = int(np.argmax(self.between[:, kind] + top[t]))
                    value = top[t][s] + self.between[s, kind] + (self.w[kind] @ features(text, start, stop, span, digits, kind) + (1e6 if held else 0.0))
                    if value > top[j][kind]:
                        top[j][kind], back[j, kind] = value, (t, s, (kind, start, stop))
        t, s, out = n, int(np.argmax(top[n])), []
        while t > 0:
            if (t, s) in back:
                t, s, found = back[t, s]
                out.append(found)
            else:
                t -= 1
        return out[::-1]

    def gradient(self, n: int, cands, truth: list[int]):
        """Log-likelihood of the true segmentation and its gradient, by forward and backward sums over segments."""
        scores, ends, starts = self._scores(cands), _by_end(cands), {}
        for k, c in enumerate(cands):
            starts.setdefault(c[0], []).append(k)
        fwd, bwd = np.full((n + 1, STATES), -np.inf), np.full((n + 1, STATES), -np.inf)
        fwd[0, STATES - 1] = 0
        for t in range(1, n + 1):
            fwd[t] = fwd[t - 1]
            for k in ends.get(t, ()):
                i, kind = cands[k][0], cands[k][2]
                fwd[t, kind] = np.logaddexp(fwd[t, kind], np.logaddexp.reduce(fwd[i] + self.between[:, kind]) + scores[k])
        bwd[n] = 0
        for t in range(n - 1, -1, -1):
            bwd[t] = bwd[t + 1]
            for k in starts.get(t, ()):
                j, kind = cands[k][1], cands[k][2]
                bwd[t] = np.logaddexp(bwd[t], self.between[:, kind] + scores[k] + bwd[j, kind])
        whole = np.logaddexp.reduce(fwd[n])
        dw, db, like = np.zeros_like(self.w), np.zeros_like(self.between), -whole
        for k, (i, j, kind, _, _, f) in enumerate(cands):
            p = np.exp(fwd[i] + self.between[:, kind] + scores[k] + bwd[j, kind] - whole)
            dw[kind] -= p.sum() * f
            db[:, kind] -= p
        last = STATES - 1
        for k in truth:
            kind = cands[k][2]
            dw[kind] += cands[k][5]
            db[last, kind] += 1
            like += scores[k] + self.between[last, kind]
            last = kind
        return like, dw, db

    def fit(self, rows: list[tuple], epochs: int = 12, rate: float = 0.3, decay: float = 1e-3) -> SpanField:
        gw, gb, rng = np.full(self.w.shape, 1e-2), np.full(self.between.shape, 1e-2), random.Random(5)
        order = list(range(len(rows)))
        for _ in range(epochs):
            rng.shuffle(order)
            for start in range(0, len(order), 16):
                dw, db = -decay * self.w, -decay * self.between
                for r in order[start:start + 16]:
                    _, a, b = self.gradient(*rows[r])
                    dw, db = dw + a, db + b
                gw += dw ** 2
                gb += db ** 2
                self.w += rate * dw / np.sqrt(gw)
                self.between += rate * db / np.sqrt(gb)
        return self


def _by_end(cands) -> dict[int, list[int]]:
    out: dict[int, list[int]] = {}
    for k, c in enumerate(cands):
        out.setdefault(c[1], []).append(k)
    return out


# ---- training text ------------------------------------------------------------------------------------------------

def rewritten(kind: str, span: str, rng: random.Random) -> str:
    """The same data in a form that the patterns miss."""
    d = digits_of(span)
    if kind == "email":
        user, host = span.split("@", 1)
        return rng.choice([f"{user}[at]{host}", f"{user}(at){host}", f"{user}[at]{host.replace('.', '[dot]')}"])
    if kind == "ip":
        head, tail = span.rsplit(".", 1)
        return f"{head}[.]{tail}"
    if kind == "card":
        sep = rng.choice([".", "/"])
        return sep.join(d[k:k + 4] for k in range(0, len(d), 4))
    own = d[-10:].rjust(10, "5")
    a, b, c = own[:3], own[3:6], own[6:]
    return rng.choice([f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"00{d[:-10] or '1'} {a} {b} {c}", f"({a}) {b} {c}"])


def look_alike(rng: random.Random) -> str:
    """Numbers that are no personal data."""
    r = rng.randrange
    return rng.choice([f"{r(1900, 2100)}-{r(1, 13):02}-{r(1, 29):02}", f"{r(1, 29):02}.{r(1, 13):02}.{r(1900, 2100)}", f"{r(1, 29):02}/{r(1, 13):02}/{r(1900, 2100)}", f"{r(1, 10 ** 6)}", f"{r(10 ** 6, 10 ** 12)}",
                       f"{r(1, 20)}.{r(0, 20)}.{r(0, 20)}", f"{r(1, 9)}.{r(0, 9)}.{r(0, 9)}.{r(0, 9)}.{r(0, 9)}", f"{r(1, 1000)} {r(100, 1000)} {r(100, 1000)}", f"{r(1, 1000)}.{r(100, 1000)}.{r(100, 1000)}", f"{r(10 ** 15, 10 ** 16)}",
                       f"{r(1900, 2000)} - {r(2000, 2100)}", f"{r(1000, 9999)}-{r(1000, 9999)}-{r(1000, 9999)}-{r(1000, 9999)}", f"{r(0, 24):02}:{r(0, 60):02}:{r(0, 60):02}", f"x@{r(1, 99)}", f"{r(1900, 2100)}-{r(1, 13):02}-{r(1, 29):02} {r(0, 24):02}:{r(0, 60):02}"])


def training_rows(samples: list[str], seed: int = 11) -> list[tuple]:
    """Lattices with their true segments from texts with base spans, their rewritten forms and look-alikes."""
    rng, out = random.Random(seed), []

    def add(text: str, spans: list[tuple[int, int, int]]):
        for a, b in islands(text):
            n, cands = lattice(text, a, b)
            true = [k for k, c in enumerate(cands) if (c[2], c[3], c[4]) in spans]
            true = [k for k, nxt in pairwise([*true, None]) if nxt is None or cands[k][1] <= cands[nxt][0]]
            if cands:
                out.append((n, cands, true))

    for text in samples:
        for kind, a, b in base_spans(text)[:4]:
            left, right, k = text[max(0, a - 40):a], text[b:b + 40], KINDS.index(kind)
            left, right = re.sub(r"[0-9@]", "", left), re.sub(r"[0-9@]", "", right)
            if left and not left[-1].isspace():
                continue
            for span in (text[a:b], rewritten(kind, text[a:b], rng)):
                add(left + span + right, {(k, len(left), len(left) + len(span))})
            for _ in range(2):
                add(left + look_alike(rng) + right, set())
    return out


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_docs: int = MAX_DOCS) -> SpanField | None:
    """Field fitted on at most ``max_docs`` documents that hold personal data by the patterns; None if there are none."""
    shape = F.col(text_col).rlike(r"@[A-Za-z0-9-]+\.|[0-9]\.[0-9]+\.[0-9]+\.[0-9]|[0-9]{16}|\+[0-9]")
    drawn = docs.where(shape).select(F.xxhash64(F.col(id_col), F.col(text_col)).alias("h"), F.col(text_col).alias("text"))

    def build():
        def step(batch):        # around the first base spans of a text; a training sample, not a result
            cut = []
            for text in column(batch, "text").to_pylist():
                cut.append([text[max(0, a - 60):b + 60] for _, a, b in base_spans(text)[:4]])
            return {"h": column(batch, "h"), "parts": pa.array(cut, pa.list_(pa.string()))}
        return step

    rows = map_batches(drawn, build, "h long, parts array<string>").where(F.size("parts") > 0).orderBy("h", "parts").limit(max_docs).collect()
    lattices = training_rows([p for r in rows for p in r["parts"]])
    return SpanField().fit(lattices) if lattices else None


# ---- scan ---------------------------------------------------------------------------------------------------------

def all_spans(text: str, field: SpanField | None) -> tuple[list, list]:
    """Base spans, and base spans with those that the field adds, both in order of kind as listed, then start."""
    base = base_spans(text)
    if field is None:
        return base, base
    added = []
    taken = sorted((a, b) for _, a, b in base)
    starts, ends = [a for a, _ in taken], list(accumulate((b for _, b in taken), max))
    fixed = {(KINDS.index(k), a, b) for k, a, b in base}

    def free(start: int, stop: int) -> bool:
        """No base span reaches into the stretch."""
        before = bisect_left(starts, stop)
        return not before or ends[before - 1] <= start

    for begin, end in islands(text):
        added += [(KINDS[k], a, b) for k, a, b in field.decode(text, begin, end, fixed, free) if (k, a, b) not in fixed]
    return base, sorted([*base, *added], key=lambda s: (KINDS.index(s[0]), s[1], s[2])) if added else base


def listed(spans: list) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", field: SpanField | None = None, **options) -> DataFrame:
    """Per document: base counts by kind, base_sha256, and all spans."""
    field = field or train(docs, id_col, text_col, **options)

    def build():
        def step(batch):
            rows = [all_spans(t or "", field) for t in column(batch, text_col).to_pylist()]
            counts = {f"n_{kind}": pa.array([sum(s[0] == kind for s in base) for base, _ in rows], pa.int64()) for kind in KINDS}
            return {id_col: column(batch, id_col), **counts, "base_sha256": [hashlib.sha256(listed(base).encode()).hexdigest() for base, _ in rows], "spans": [listed(every) for _, every in rows]}
        return step

    return map_batches(docs.select(F.col(id_col).cast("long").alias(id_col), text_col), build,
                       f"{id_col} long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def masked(text: str, spans: list) -> str:
    """Text with each span replaced by its kind in capitals and brackets; spans that overlap become one."""
    merged: list[list] = []
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2], KINDS.index(s[0]))):
        if merged and a < merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], b)
        else:
            merged.append([kind, a, b])
    out, at = [], 0
    for kind, a, b in merged:
        out += [text[at:a], f"[{kind.upper()}]"]
        at = b
    return "".join([*out, text[at:]])


def mask(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", field: SpanField | None = None, **options) -> DataFrame:
    """The same rows and columns with personal data masked in the text; null stays null."""
    field = field or train(docs, id_col, text_col, **options)
    names = docs.columns

    def build():
        def step(batch):
            col = column(batch, text_col)
            out = [None if t is None else masked(t, all_spans(t, field)[1]) for t in col.to_pylist()]
            return {n: pa.array(out, col.type) if n == text_col else column(batch, n) for n in names}
        return step

    def run(batches):
        step = build()
        for batch in batches:
            out = step(batch)
            yield pa.RecordBatch.from_arrays([out[n] for n in names], names=names)

    return docs.mapInArrow(run, docs.schema)
