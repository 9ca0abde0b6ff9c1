"""Personal data: base patterns, and more spans that boosted trees pick from high-recall candidates.

Base spans (emails, IPv4 addresses, card numbers, phone numbers) always stay. Generators with much looser patterns
propose overlapping candidate spans; one ensemble of boosted trees a kind scores their format and context, a Platt
calibration turns margins into probabilities, and a threshold with MIN_PRECISION on held-out candidates selects. Added
spans overlap no base span and no better added one.

Nobody labels candidates here, so the trees learn from base spans of about SAMPLE_DOCS documents (twice that at most) in disguise (plus
signs and separators dropped or changed, '@' and '.' spelled out) against the candidates that no base pattern took and
corrupted numbers. Where the sample has too few base spans of a kind, that kind gets no added spans.

Null and empty texts have no spans. Very long texts and very long runs of digits are searched whole, in time that grows
with their length. Rows are independent, so ties and repeated rows don't matter; other columns are passed over (or, in
redacted_documents, kept); an empty table gives an empty result; offsets count code
points, the end is exclusive.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm.boosting import BoostedTrees, platt, sigmoid
from tarn.llm.common import map_batches, sampled

KINDS = ("email", "ip", "card", "phone")
SAMPLE_DOCS, SAMPLE_BYTES, MIN_TRAINING, MIN_PRECISION = 2000, 32768, 20, 0.995
#: The contract's patterns.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
#: The same matches, each tried from the start of its run of digits alone, so that long runs take no squared time.
_IP_BY_RUNS = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DIGIT = re.compile(r"[0-9]")
#: The generators' patterns.
_LOOSE_EMAIL = re.compile(r"[\w.%+-]{1,64}\s?(?:@|\(at\)|\[at\]|\{at\}|\sat\s)\s?[\w-]{1,63}(?:\s?(?:\.|\(dot\)|\[dot\]|\sdot\s)\s?[\w-]{2,63}){1,4}", re.I)
_LOOSE_NUMBER = re.compile(r"[+(]?[0-9](?:[\x20()./_-]{0,2}[0-9])*")
_LOOSE_IP = re.compile(r"(?<![0-9])(?=([0-9]{1,3}(?:(?:\s?(?:\.|\[\.\]|\(\.\)|\[dot\]|\(dot\)|dot)\s?|\s)[0-9]{1,3}){3})(?![0-9]))", re.I)
_GROUP = re.compile(r"[0-9]+")
_FITS = (("ip", 7, 12), ("phone", 9, 15), ("card", 12, 19))
_HINTS = {"email": ("mail", "contact", "write"), "ip": ("ip", "host", "addr", "server"), "card": ("card", "visa", "pay", "credit"), "phone": ("phone", "tel", "call", "fax", "mobile")}

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = sum(ord(c) - 48 for c in digits[::-2]) + sum((0, 2, 4, 6, 8, 1, 3, 5, 7, 9)[ord(c) - 48] for c in digits[-2::-2])
    return total % 10 == 0


def _byte(digits: str) -> bool:
    own = digits.lstrip("0")
    return len(own) <= 3 and int(own or 0) <= 255


def _digits(s: str) -> str:
    return "".join(_DIGIT.findall(s))


def base_spans(text: str) -> list[Span]:
    """Leftmost matches without overlap for each kind; failing matches are dropped, not retried."""
    out: list[Span] = []
    at, last = text.find("@"), 0
    while at >= 0:  # no match holds another '@' before its own, so each is tried from the start of its run
        begin = at
        while begin > last and text[begin - 1] in _LOCAL_CHARS:
            begin -= 1
        m = EMAIL.match(text, begin) if begin < at else None
        if m:
            out.append(("email", m.start(), last := m.end()))
        at = text.find("@", max(at + 1, last))
    if _DIGIT.search(text):
        out += [("ip", *m.span()) for m in _IP_BY_RUNS.finditer(text) if all(_byte(p) for p in m.group().split("."))]
        out += [("card", *m.span()) for m in CARD.finditer(text) if 12 <= len(d := _digits(m.group())) <= 19 and luhn(d)]
        if "+" in text:
            out += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(_digits(m.group())) <= 15]
    return out


def _numbers(text: str, begin: int, end: int) -> list[Span]:
    """Sub-runs of a run of digits that begin and end with a group and have a kind's count of digits.

    Within a longer run an ip is four bytes and a card passes the check digit; the run as a whole need not.
    """
    groups = [m.span() for m in _GROUP.finditer(text, begin, end)]
    out: list[Span] = []
    for i, (a, _) in enumerate(groups):
        n, start = 0, a - (a > begin and text[a - 1] in "+(")
        for j in range(i, len(groups)):
            n += groups[j][1] - groups[j][0]
            if n > 19:
                break
            whole = i == 0 and j == len(groups) - 1
            for kind, low, high in _FITS:
                if low <= n <= high and (whole or _plausible(kind, [text[x:y] for x, y in groups[i : j + 1]])):
                    out.append((kind, start, groups[j][1]))
    return out


def _plausible(kind: str, groups: list[str]) -> bool:
    if kind == "ip":
        return len(groups) == 4 and all(len(g) <= 3 and _byte(g) for g in groups)
    return kind != "card" or luhn("".join(groups))


def candidates(text: str) -> list[Span]:
    """Overlapping proposals; a number is proposed as each kind whose count of digits it has, and so are its sub-runs."""
    out: list[Span] = []
    if "@" in text or re.search(r"(?i)\bat\b", text):
        out += [("email", *m.span()) for m in _LOOSE_EMAIL.finditer(text)]
    if _DIGIT.search(text):
        for m in _LOOSE_NUMBER.finditer(text):
            if m.end() - m.start() >= 7:
                out += _numbers(text, *m.span())
        out += [("ip", *m.span(1)) for m in _LOOSE_IP.finditer(text) if _plausible("ip", _GROUP.findall(m.group(1)))]
    return list(dict.fromkeys(out))


def features(text: str, span: Span) -> list[float]:
    kind, begin, end = span
    own, before, after = text[begin:end], text[max(0, begin - 24) : begin].lower(), text[end : end + 8]
    digits = _digits(own)
    groups = [len(g) for g in re.findall(r"[0-9]+", own)] or [0]
    return [
        len(own), len(digits), len(groups), max(groups), min(groups), own.count("."), own.count(" "), own.count("-"), own.count("("), own.startswith("+"), own.count("@"),
        "at" in own.lower(), "dot" in own.lower(), sum(c.isalpha() for c in own), bool(digits) and luhn(digits), len(groups) == 4 and all(_byte(g) for g in re.findall(r"[0-9]+", own)[:4]),
        groups[-1] == 4, groups[0], digits[:1] in ("3", "4", "5", "6"), any(h in before for h in _HINTS[kind]), before[-1:].isspace() or not before, before[-1:].isalnum(), after[:1].isalnum(), after[:1].isspace() or not after,
        before.rstrip()[-1:] in (":", "="), "." in own and own.rsplit(".", 1)[-1].isalpha(), len(set(digits)), own.count("["),
        before.rstrip(" ()./_-")[-1:].isdigit(), after.lstrip(" ()./_-")[:1].isdigit(),
    ]


def _disguised(kind: str, own: str, rng: np.random.Generator) -> str:
    pick = rng.integers(4)
    if kind == "email":
        at, dot = ((" at ", " dot "), ("[at]", "[dot]"), ("(at)", "."), ("@", "."))[pick]
        return own.replace("@", at).replace(".", dot)
    if kind == "ip":
        return own.replace(".", (" ", "[.]", " dot ", "(.)")[pick])
    if kind == "phone":
        return (own.lstrip("+"), "00" + own.lstrip("+"), re.sub(r"[\x20().-]+", ".", own).lstrip("+"), re.sub(r"[\x20().-]+", "-", own))[pick]
    d = _digits(own)
    return (d, "-".join(d[k : k + 4] for k in range(0, len(d), 4)), ".".join(d[k : k + 4] for k in range(0, len(d), 4)), " ".join(d[k : k + 4] for k in range(0, len(d), 4)))[pick]


def _corrupted(kind: str, own: str, rng: np.random.Generator) -> str:
    """As long and as spaced as own, but no valid number of the kind."""
    if kind == "card":
        at = [k for k, c in enumerate(own) if c.isdigit()][-1]
        return own[:at] + str((int(own[at]) + 1 + rng.integers(8)) % 10) + own[at + 1 :]
    if kind == "ip":  # disguised as well, so that the disguise alone tells nothing
        return _disguised(kind, re.sub(r"^[0-9]+", str(300 + rng.integers(600)), own), rng)
    return re.sub(r"[^0-9]", "", own)[: 7 + rng.integers(5)]


@dataclass
class Model:
    trees: BoostedTrees
    slope: float
    offset: float
    threshold: float

    def probability(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.slope * self.trees.margin(x) + self.offset)


def trained(texts: list[str], seed: int = 5) -> dict[str, Model]:
    rng = np.random.default_rng(seed)
    rows: dict[str, list[tuple[list[float], int]]] = {k: [] for k in KINDS}
    for text in texts:
        base = base_spans(text)
        for kind, a, b in base:
            for make, label in ((_disguised, 1), (_corrupted, 0)):
                own = make(kind, text[a:b], rng) if kind != "email" or label else text[a:b].replace("@", " ")
                rows[kind].append((features(text[:a] + own + text[b:], (kind, a, a + len(own))), label))
                if kind == "email":
                    continue
                # parts of a number are none
                near, at = text[max(0, a - 32) : a] + own + text[b : b + 16], min(a, 32)
                parts = [x for x in candidates(near) if at <= x[1] and x[2] <= at + len(own) and x[2] - x[1] < len(own)]
                for x in parts:
                    rows[x[0]].append((features(near, x), 0))
            if kind == "card":
                # two of them with a blank between are two
                one, near, at = text[a:b], text[max(0, a - 32) : a] + text[a:b] + " " + text[a:b] + text[b : b + 16], min(a, 32)
                rows[kind] += [(features(near, (kind, k, k + len(one))), 1) for k in (at, at + len(one) + 1)]
        taken = Taken(base)
        for kind, a, b in candidates(text):
            if not taken.meets((kind, a, b)):
                rows[kind].append((features(text, (kind, a, b)), 0))
    out = {}
    for kind, some in rows.items():
        y = np.array([label for _, label in some], float)
        if y.sum() < MIN_TRAINING or (1 - y).sum() < MIN_TRAINING:
            continue
        x = np.array([f for f, _ in some], float)
        fold = rng.integers(0, 2, len(y)).astype(bool)
        trees = BoostedTrees().fit(x[~fold], y[~fold])
        margin = trees.margin(x[fold])
        slope, offset = platt(margin, y[fold])
        p = sigmoid(slope * margin + offset)
        order = np.argsort(-p)
        precision = np.cumsum(y[fold][order]) / np.arange(1, len(order) + 1)
        good = np.flatnonzero(precision >= MIN_PRECISION)
        if len(good):
            out[kind] = Model(trees, slope, offset, max(float(p[order][good[-1]]), 0.9))
    return out


class Taken:
    """Stretches of a text, apart from each other and in order, that are asked for overlaps."""

    def __init__(self, spans: list[Span] = ()):
        self.begins, self.ends = [], []
        for begin, end in sorted((a, b) for _, a, b in spans):
            if self.ends and begin < self.ends[-1]:
                self.ends[-1] = max(end, self.ends[-1])
            else:
                self.begins.append(begin)
                self.ends.append(end)

    def meets(self, span: Span) -> bool:
        at = bisect_right(self.ends, span[1])  # the first that ends behind the span's begin
        return at < len(self.begins) and self.begins[at] < span[2]

    def add(self, span: Span) -> None:
        """span meets none."""
        at = bisect_left(self.begins, span[1])
        self.begins.insert(at, span[1])
        self.ends.insert(at, span[2])


def all_spans(text: str, models: dict[str, Model]) -> tuple[list[Span], list[Span]]:
    """Base spans, and all spans; both by start, then kind as listed."""
    by = lambda s: (s[1], KINDS.index(s[0]), s[2])
    base = sorted(base_spans(text), key=by)
    scored, taken = [], Taken(base)
    open_ = [x for x in candidates(text) if x[0] in models and not taken.meets(x)]
    for kind in KINDS:
        some = [x for x in open_ if x[0] == kind]
        if some:
            p = models[kind].probability(np.array([features(text, x) for x in some], float))
            scored += [(-float(q), by(x), x) for q, x in zip(p, some, strict=True) if q >= models[kind].threshold]
    added, chosen = [], Taken()
    for _, _, span in sorted(scored):
        if not chosen.meets(span):
            added.append(span)
            chosen.add(span)
    return base, sorted(base + added, key=by)


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def redacted(text: str, spans: list[Span]) -> str:
    """Each run of overlapping spans becomes the first one's kind in angle brackets."""
    out, last = [], 0
    for kind, a, b in spans:
        if a >= last:
            out += [text[last:a], f"<{kind.upper()}>"]
        last = max(last, b)
    return "".join([*out, text[last:]])


def fitted(docs: DataFrame) -> dict[str, Model]:
    """Trained on about SAMPLE_DOCS documents of smallest hash with a digit or '@' and at most SAMPLE_BYTES bytes."""
    fit_for = docs.select("doc_id", "text").where(F.col("text").rlike("[0-9@]") & (F.octet_length("text") <= SAMPLE_BYTES))
    return trained(sorted(r["text"] for r in sampled(fit_for, "doc_id", SAMPLE_DOCS).collect()))


def spans(docs: DataFrame, models: dict[str, Model] | None = None) -> DataFrame:
    """Per row: doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans, n_added."""
    sent = docs.sparkSession.sparkContext.broadcast(fitted(docs) if models is None else models)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        base, every = zip(*(all_spans(t or "", sent.value) for t in batch.column(1).to_pylist()), strict=True)
        counts = [pa.array([sum(s[0] == k for s in b) for b in base], pa.int64()) for k in KINDS]
        digests = pa.array([hashlib.sha256(joined(b).encode()).hexdigest() for b in base])
        return pa.RecordBatch.from_arrays([batch.column(0), *counts, digests, pa.array([joined(s) for s in every], pa.string()), pa.array([len(s) - len(b) for b, s in zip(base, every, strict=True)], pa.int64())], names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"])

    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"
    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), run, schema)


def redacted_documents(docs: DataFrame, models: dict[str, Model] | None = None) -> DataFrame:
    """docs with every span of `text` replaced; n_chars, where there is one, counts the new text."""
    sent = docs.sparkSession.sparkContext.broadcast(fitted(docs) if models is None else models)
    place = docs.columns.index("text")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [t if t is None else redacted(t, all_spans(t, sent.value)[1]) for t in batch.column(place).to_pylist()]
        return batch.set_column(place, batch.schema.field(place), pa.array(texts, batch.schema.field(place).type))

    out = map_batches(docs, run, docs.schema)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
