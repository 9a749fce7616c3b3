"""Personal data by fixed patterns and a semi-Markov conditional random field.

Patterns find the base spans. The model reads the neighbourhood of digits and at-signs as a row
of atoms (words, numbers, marks, spaces). A segment is a run of at most `LONGEST` atoms; features
of the whole span (digits, groups, check sums, marks, cue words before it) score it as one kind
of personal data or, atom by atom, as nothing, and dynamic programming over segment ends picks
boundaries and kinds together.

Weights are learned by maximum likelihood from zones of a bounded sample of documents. The base
spans there are labels, and so that the model learns more than the patterns, each also stands in
copies of its zone in other ways to write it: a phone number without its plus, a card with dots,
an address with ``[at]``. Segments of the corpus that may be written so are no evidence against a
kind: they are left out of the likelihood's slope. A span that the model adds must be part of the
best segmentation, have a marginal probability of at least `SURE` and touch no base span.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lehrplan.llm import arrays as A
from lehrplan.sources.staging import stage

KINDS = ("email", "ip", "card", "phone")
LONGEST = 24          # atoms of a segment
ZONE_ATOMS = 96       # a longer zone is cut where it reaches this many atoms
OVERLAP = 72          # characters that the zones of a long run share
ZONES = 600           # zones with base spans that the model learns from, and as many without
SURE = 0.9

Span = tuple[str, int, int]
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_HOST = re.compile(r"\s?" + _DOMAIN.pattern)
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_NUMBERS = re.compile(r"[0-9]+(?:\.[0-9]+)+")
_CHAIN = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_DIAL = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_MARK = re.compile(r"[0-9@]+|[\[(]\s?at\s?[\])]")
_AT = re.compile(r"\s?(?:@|[\[(]\s?at\s?[\])])\s?")
_ATOM = re.compile(r"[A-Za-z]+|[0-9]+|[^\S\n]+|[\s\S]")
_CUE = {"email": "email mail mailto contact write", "phone": "phone tel telephone call fax mobile",
        "card": "card visa mastercard credit amex", "ip": "ip host server address"}
_CUE_OF = {word: kind for kind, words in _CUE.items() for word in words.split()}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        value = int(c) * (1 + i % 2)
        total += value - 9 if value > 9 else value
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """Spans of the fixed patterns, by start and then kind; linear in the text."""
    found: list[Span] = []
    at, last = text.find("@"), 0
    while at >= 0:
        domain = _DOMAIN.match(text, at + 1)
        start = at
        while domain and start > last and text[start - 1] in _LOCAL:
            start -= 1
        if domain and start < at:
            found.append(("email", start, domain.end()))
            last = domain.end()
        at = text.find("@", at + 1)
    if _DIGIT.search(text):
        for m in _NUMBERS.finditer(text):
            start, parts = m.start(), m.group().split(".")
            for i in range(0, len(parts) - 3, 4):
                four = parts[i:i + 4]
                end = start + sum(map(len, four)) + 3
                if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in four):
                    found.append(("ip", start, end))
                start = end + 1
        for m in _CHAIN.finditer(text):
            digits = m.group().replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append(("card", m.start(), m.end()))
        if "+" in text:
            for m in _DIAL.finditer(text):
                if 10 <= len(_DIGIT.findall(m.group())) <= 15:
                    found.append(("phone", m.start(), m.end()))
    return ordered(found)


def ordered(spans) -> list[Span]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def written(spans) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in ordered(spans))


class Zone:
    """The atoms around marks, with the segments that may hold personal data."""

    def __init__(self, text: str, start: int, end: int):
        self.start = start
        self.text = text[start:end]
        cuts = [m.start() for m in _ATOM.finditer(self.text)] + [len(self.text)]
        self.cuts = cuts
        self.n = len(cuts) - 1
        self.left = text[max(0, start - 24):start]
        self.right = text[end:end + 1]
        self.segments: dict[int, list[tuple[int, str, list[str]]]] = defaultdict(list)
        self.unknown: set[tuple[int, int, str]] = set()  # segments that may be personal data
        digits = [0]
        for a, b in zip(cuts, cuts[1:]):
            digits.append(digits[-1] + (b - a if "0" <= self.text[a] <= "9" else 0))
        signs = [0]
        for a in cuts[:-1]:
            signs.append(signs[-1] + (self.text[a] == "@" or self.text[a:a + 3] in ("[at", "(at")))
        for i in range(self.n):
            if self.text[cuts[i]].isspace():
                continue
            for j in range(i + 1, min(self.n, i + LONGEST) + 1):
                sign = signs[j] - signs[i]
                many = digits[j] - digits[i]
                if self.text[cuts[j] - 1].isspace() or not (sign == 1 or 4 <= many <= 19):
                    continue
                span = self.text[cuts[i]:cuts[j]]
                shared = self._features(span, cuts[i], cuts[j], many, sign)
                if shared is not None:
                    self.segments[j].append((i, span, shared))

    def _features(self, span: str, a: int, b: int, many: int, sign: int) -> list[str] | None:
        edge = span[0] + span[-1]
        if not (edge[0].isalnum() or edge[0] in "+(") or not edge[1].isalnum():
            return None
        if not sign and (edge[0].isalpha() or edge[1].isalpha()):
            return None
        before = self.text[a - 1] if a else self.left[-1:]
        after = self.text[b] if b < len(self.text) else self.right
        out = [f"left={_class(before)}", f"right={_class(after)}"]
        word = re.findall(r"[A-Za-z]+", (self.left + self.text[:a])[-24:])
        if word and word[-1].lower() in _CUE_OF:
            out.append(f"cue={_CUE_OF[word[-1].lower()]}")
        letters = sum(c.isalpha() for c in span)
        spaces = sum(c.isspace() for c in span)
        if sign:
            name, host = (_AT.split(span) + [""])[:2]
            out += [f"name={bool(name) and set(name) <= _LOCAL}", f"dots={min(host.count('.'), 2)}",
                    f"whole={bool(_DOMAIN.fullmatch(host))}",
                    f"tail={span.rsplit('.', 1)[-1].isalpha()}"]
            return out
        groups = re.findall(r"[0-9]+", span)
        quad = len(groups) == 4 and all(len(g) < 4 and int(g) < 256 for g in groups)
        marks = set(re.sub(r"[0-9]", "", span))
        shape = ",".join(str(len(g)) for g in groups) if len(groups) <= 6 else "many"
        out += [f"quad={quad}", f"letters={letters > 0}", f"plus={span[0] == '+'}",
                f"round={'(' in span and ')' in span}", f"shape={shape}", f"digits={many}",
                f"spaces={min(spaces, 4)}", f"joined={len(marks)}|{len(groups) > 1}",
                f"other={any(not (c.isalnum() or c in ' +().-[]/') for c in span)}"]
        if many >= 13 and not letters:
            out.append(f"sum={luhn(''.join(groups))}|{_fours(span, groups)}")
        return out

    def labels(self, spans: list[Span]) -> dict[tuple[int, int], str] | None:
        """Base spans as segments; None if they overlap or end inside an atom."""
        place = {c: k for k, c in enumerate(self.cuts)}
        gold: dict[tuple[int, int], str] = {}
        at = -1
        for kind, start, end in ordered(spans):
            i, j = place.get(start - self.start), place.get(end - self.start)
            if i is None or j is None or i < at or not any(s[0] == i for s in self.segments[j]):
                return None
            gold[i, j] = kind
            at = j
        return gold


def _class(c: str) -> str:
    return "none" if not c else "digit" if c.isdigit() else "letter" if c.isalpha() else \
        "space" if c.isspace() else c if c in ".@+-_/=\"'" else "mark"


def zones(text: str) -> list[Zone]:
    """Zones around marks: marks with at most three atoms between them share one. The zones of a
    run that is too long for one overlap, so that no span is cut by all of them."""
    out: list[tuple[int, int]] = []
    for m in _MARK.finditer(text):
        low = max(0, m.start() - 20)
        while low < m.start() and low > 0 and not text[low - 1].isspace():
            low += 1
        high = min(len(text), m.end() + 2)
        tail = _HOST.match(text, m.end())
        if tail:
            high = min(tail.end(), m.end() + 80)
        if out and low <= out[-1][1] + 2:
            if high - out[-1][0] <= 4 * ZONE_ATOMS:
                out[-1] = (out[-1][0], max(high, out[-1][1]))
                continue
            low = max(out[-1][1] - OVERLAP, out[-1][0] + 1, 0)
            while low < m.start() and not text[low - 1].isspace():
                low += 1
        if low < high:
            out.append((low, high))
    return [Zone(text, a, b) for a, b in out]


def variants(kind: str, span: str) -> list[str]:
    """Other ways to write a base span, none of which the patterns take for it."""
    digits = "".join(_DIGIT.findall(span))
    if kind == "email":
        name, host = span.split("@")
        return [f"{name} [at] {host}", f"{name}(at){host}", f"{name} @ {host}", f"{name}[at]{host}"]
    if kind == "ip":
        parts = span.split(".")
        return ["[.]".join(parts), " . ".join(parts), "-".join(parts)]
    if kind == "card":
        fours = [digits[i:i + 4] for i in range(0, len(digits), 4)]
        return [".".join(fours), "/".join(fours), " - ".join(fours), "  ".join(fours)]
    area, middle, last = digits[-10:-7], digits[-7:-4], digits[-4:]
    return [f"({area}) {middle}-{last}", f"{area}-{middle}-{last}", f"{area}.{middle}.{last}",
            f"00{digits[:-10] or 1} {area} {middle} {last}", f"+{digits[:-10] or 1}/{area}/{middle}/{last}"]


def _fours(span: str, groups: list[str]) -> bool:
    """Whether digits stand in one group, or in groups of four with the same between them."""
    alike = len(set(re.findall(r"(?<=[0-9])[^0-9]+(?=[0-9])", span))) < 2
    return len(groups) == 1 or alike and all(len(g) == 4 for g in groups[:-1]) and len(groups[-1]) <= 4


def possible(kind: str, span: str) -> bool:
    """Whether a segment may be personal data of a kind, written in some usual way."""
    groups = re.findall(r"[0-9]+", span)
    many = sum(map(len, groups))
    if kind == "email":
        name, host = (_AT.split(span) + [""])[:2]
        return bool(name) and bool(_DOMAIN.fullmatch(host))
    if any(c.isalpha() for c in span):
        return False
    if kind == "ip":
        alike = len(set(re.findall(r"(?<=[0-9])[^0-9]+(?=[0-9])", span))) < 2
        return alike and len(groups) == 4 and all(len(g) <= 3 and int(g) <= 255 for g in groups)
    if kind == "card":
        return _fours(span, groups) and 14 <= many <= 19 and luhn("".join(groups))
    return 10 <= many <= 15 and len(groups) > 2 and [len(g) for g in groups[-2:]] == [3, 4]


Weights = dict[str, float]


def _score(weights: Weights, kind: str, shared: list[str]) -> float:
    return weights.get(kind, -1.0) + sum(weights.get(f"{kind}|{f}", 0.0) for f in shared)


def _sum(a: float, b: float) -> float:
    if a < b:
        a, b = b, a
    return a if b == -math.inf else a + math.log1p(math.exp(b - a))


def _lattice(zone: Zone, weights: Weights):
    """Segments with scores by end, forward and backward sums; an atom as nothing scores 0."""
    arcs = {j: [(i, kind, _score(weights, kind, f), f) for i, _, f in ends for kind in KINDS]
            for j, ends in zone.segments.items()}
    ahead = [-math.inf] * (zone.n + 1)
    ahead[0] = 0.0
    for j in range(1, zone.n + 1):
        total = ahead[j - 1]
        for i, _, s, _ in arcs.get(j, ()):
            total = _sum(total, ahead[i] + s)
        ahead[j] = total
    back = [-math.inf] * (zone.n + 1)
    back[zone.n] = 0.0
    for j in range(zone.n, 0, -1):
        back[j - 1] = _sum(back[j - 1], back[j])
        for i, _, s, _ in arcs.get(j, ()):
            back[i] = _sum(back[i], back[j] + s)
    return arcs, ahead, back


def learn(samples: list[tuple[Zone, dict]], rounds: int = 8, rate: float = 0.4,
          penalty: float = 1e-3) -> Weights:
    """Weights by stochastic gradient steps on the likelihood of the labelled segmentations."""
    weights: Weights = {}
    size: dict[str, float] = defaultdict(lambda: 1e-6)
    for _ in range(rounds):
        for zone, gold in samples:
            arcs, ahead, back = _lattice(zone, weights)
            slope: dict[str, float] = defaultdict(float)
            for j, ends in arcs.items():
                for i, kind, s, shared in ends:
                    if (i, j, kind) in zone.unknown:
                        continue
                    gain = (gold.get((i, j)) == kind) - math.exp(
                        min(0.0, ahead[i] + s + back[j] - ahead[-1]))
                    if abs(gain) > 1e-4:
                        slope[kind] += gain
                        for f in shared:
                            slope[f"{kind}|{f}"] += gain
            for name, g in slope.items():
                g -= penalty * weights.get(name, 0.0)
                size[name] += g * g
                weights[name] = weights.get(name, 0.0) + rate * g / math.sqrt(size[name])
    return weights


def model_spans(zone: Zone, weights: Weights, sure: float = SURE) -> list[Span]:
    """Personal data in the best segmentation of a zone, if also the marginals are sure."""
    if not zone.segments:
        return []
    arcs, ahead, back = _lattice(zone, weights)
    best: list[float] = [0.0] + [-math.inf] * zone.n
    way: list[tuple[int, str | None, float]] = [(0, None, 0.0)] * (zone.n + 1)
    for j in range(1, zone.n + 1):
        best[j], way[j] = best[j - 1], (j - 1, None, 0.0)
        for i, kind, s, _ in arcs.get(j, ()):
            if best[i] + s > best[j]:
                best[j], way[j] = best[i] + s, (i, kind, s)
    out, j = [], zone.n
    while j:
        i, kind, s = way[j]
        if kind and math.exp(ahead[i] + s + back[j] - ahead[-1]) >= sure:
            out.append((kind, zone.start + zone.cuts[i], zone.start + zone.cuts[j]))
        j = i
    return out


def find(text: str, weights: Weights) -> tuple[list[Span], list[Span]]:
    """Base spans, and all spans: the base and what the model adds beside it."""
    base = base_spans(text)
    extra = [s for zone in zones(text) for s in model_spans(zone, weights)] if weights else []
    free: list[Span] = []
    for s in sorted(set(extra), key=lambda s: (s[1], -s[2])):  # zones that overlap may both find one
        if not any(s[1] < b[2] and b[1] < s[2] for b in (*base, *free[-1:])):
            free.append(s)
    return base, ordered(base + free)


def _sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, texts, marked = [], [], []
        for text in A.column(batch, "text").to_pylist():
            if not text or not _MARK.search(text):
                continue
            base = base_spans(text)
            for zone in zones(text):
                if zone.segments:
                    low, high = max(0, zone.start - 24), zone.start + len(zone.text)
                    piece = text[low:high + 8]
                    texts.append(piece)
                    marked.append(any(low <= b[1] and b[2] <= high for b in base))
                    keys.append(int.from_bytes(hashlib.blake2b(piece.encode("utf-8", "replace"),
                                                               digest_size=8).digest(), "big") >> 1)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(texts, pa.string()),
                                          pa.array(marked, pa.bool_())], ["key", "piece", "marked"])


def _samples(piece: str) -> Iterator[tuple[Zone, dict]]:
    """The zones of a piece with their labels, and of its copies with one span written otherwise."""
    base = base_spans(piece)

    def labelled(text: str, spans: list[Span]) -> Iterator[tuple[Zone, dict]]:
        for zone in zones(text):
            end = zone.start + len(zone.text)
            inside = [s for s in spans if s[1] >= zone.start and s[2] <= end]
            gold = zone.labels(inside)
            if gold is None or any(s[1] < end and s[2] > zone.start and s not in inside for s in spans):
                continue
            taken = [(i, j) for i, j in gold]
            zone.unknown = {(i, j, kind) for j, ends in zone.segments.items() for i, span, _ in ends
                            for kind in KINDS if possible(kind, span)
                            and not any(i < b and a < j for a, b in taken)}
            yield zone, gold

    yield from labelled(piece, base)
    for kind, start, end in base:
        for other in variants(kind, piece[start:end]):
            shift = len(other) - (end - start)
            moved = [(k, a, b) if b <= start else (k, a + shift, b + shift)
                     for k, a, b in base if b <= start or a >= end]
            yield from labelled(piece[:start] + other + piece[end:],
                                ordered([*moved, (kind, start, start + len(other))]))


def train(docs: DataFrame, limit: int = ZONES) -> Weights:
    """Learn from at most ``limit`` distinct zones of all texts that hold base spans and as many that
    hold none, the first of each by a hash of them.

    Without a base span in the corpus there are no weights, and nothing is added.
    """
    pieces = stage(docs.select("text").mapInArrow(_sample, "key long, piece string, marked boolean")
                   .distinct(), "zones")
    samples = []
    for marked in ("marked", "not marked"):
        for row in pieces.where(marked).orderBy("key", "piece").limit(limit).collect():
            samples += _samples(row["piece"])
    # kinds and ways to write them in turn, not zone after zone
    samples.sort(key=lambda s: hashlib.blake2b(s[0].text.encode("utf-8", "replace")).digest())
    return learn(samples) if any(gold for _, gold in samples) else {}


def _find(batches: Iterator[pa.RecordBatch], weights: Weights) -> Iterator[pa.RecordBatch]:
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    for batch in batches:
        both = ([], [])
        for text in A.column(batch, "text").to_pylist():
            for out, spans in zip(both, find(text, weights) if text else ([], [])):
                out.append([{"kind": k, "start": a, "end": b} for k, a, b in spans])
        yield pa.RecordBatch.from_arrays(
            [A.column(batch, "doc_id"), pa.array(both[0], span), pa.array(both[1], span)],
            ["doc_id", "base", "spans"])


def personal_data(docs: DataFrame, weights: Weights) -> DataFrame:
    """``doc_id``, base spans and all spans (kind, start, end in code points) of every row.

    Null and empty texts hold none; repeated rows are read one by one. An empty table gives an
    empty result.
    """
    span = "array<struct<kind:string,start:long,end:long>>"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        partial(_find, weights=weights), f"doc_id long, base {span}, spans {span}")


def redacted(text: str, spans: list[Span]) -> str:
    """The text with every span replaced by its kind; overlapping spans become one."""
    out, at = [], 0
    for kind, start, end in spans:
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join(out) + text[at:]


def _redact(batches: Iterator[pa.RecordBatch], weights: Weights) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = []
        for text in batch.column(0).to_pylist():
            spans = find(text, weights)[1] if text else []
            texts.append(redacted(text, spans) if spans else text)
        yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), *batch.columns[1:]],
                                         batch.schema.names)


def redact(docs: DataFrame, weights: Weights) -> DataFrame:
    """The same rows and columns with personal data in ``text`` replaced by ``[KIND]``."""
    order = ["text", *[c for c in docs.columns if c != "text"]]
    first = docs.select(*[F.col(f"`{c}`") for c in order])
    return first.mapInArrow(partial(_redact, weights=weights), first.schema).select(
        *[F.col(f"`{c}`") for c in docs.columns])
