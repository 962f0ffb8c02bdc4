"""Personal data by a semi-Markov conditional random field beside base patterns.

Base spans (email, ip, card, phone) come from patterns. A zone is a stretch of text where more could
stand: runs of digits and separators, and written-out addresses. A zone's tokens are digit runs, words
and single marks; a segment is a bounded run of tokens with one of the four types or none. Features
look at the whole segment (digits, groups, check digit, separators, ends, word before), weights are
fitted by maximum likelihood with forward-backward over segments, and decoding is a dynamic
programme over boundaries and types together. What it finds and no base span overlaps is added, if
its posterior is high.

The field is fitted on a bounded sample of zones of this table (``sample_zones``, by a 64-bit hash), with the
base spans as their labels, and on fixed variants: phones without country code, written-out marks in
addresses, and numbers that are nothing.

Defined results: a null text is an empty text; texts and zones are read whole, however long; of paths that
score alike the first found stands; base spans of different kinds may overlap and all stay; rows that repeat are scanned each; an empty table gives
an empty table; further columns are ignored; texts without a digit or an address mark have no spans.
"""

from __future__ import annotations

import math
import random
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import python_workers, unit

KINDS = ("email", "ip", "card", "phone")
SAMPLE_ZONES = 600
FIT_CHARS = 400
LONGEST = 24
POSTERIOR = 0.9

# The base patterns. Possessive forms match what the plain ones match, in linear time.
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
NOT_LOCAL = re.compile(r"[^A-Za-z0-9._%+-]")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

NUMBERS = re.compile(r"(?<![A-Za-z0-9])[+(]?[0-9](?:[ ()./+-]{0,3}[0-9])++")  # whole runs; what follows them is tested after
ADDRESS = re.compile(r"[A-Za-z0-9._%+-]{1,64} ?(?:@|\(at\)|\[at\]) ?[A-Za-z0-9-]{1,63}(?: ?(?:\.|\(dot\)|\[dot\]) ?[A-Za-z0-9-]{1,63}){1,6}")
TOKEN = re.compile(r"[0-9]+|\((?:at|dot)\)|\[(?:at|dot)\]|[A-Za-z]+|.", re.S)

Span = tuple[int, int, int]  # kind, start, end


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """The base spans, by kind as listed, then start; offsets are in code points."""
    out: list[Span] = []
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and not NOT_LOCAL.match(text[start - 1]):
            start -= 1
        found = DOMAIN.match(text, at) if start < at else None
        if found:
            out.append((0, start, found.end()))
            done = found.end()
        else:
            done = at + 1
        at = text.find("@", done)
    for m in IP.finditer(text):
        parts = [p.lstrip("0") or "0" for p in m.group().split(".")]  # zeros first: int() refuses very long strings
        if all(len(p) <= 3 and int(p) <= 255 for p in parts):
            out.append((1, *m.span()))
    for m in CARD.finditer(text):
        digits = re.sub("[ -]", "", m.group())
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append((2, *m.span()))
    for m in PHONE.finditer(text):
        if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
            out.append((3, *m.span()))
    return out


def zones(text: str) -> list[tuple[int, int]]:
    """Stretches to decode: number runs with at least seven digits, and addresses, apart from each other."""
    joins = lambda at: at < len(text) and text[at].isascii() and text[at].isalnum()
    found = [m.span() for m in NUMBERS.finditer(text) if not joins(m.end()) and sum(c.isdigit() for c in m.group()) >= 7]
    if "@" in text or "(at)" in text or "[at]" in text:
        found += [m.span() for m in ADDRESS.finditer(text)]
    out: list[tuple[int, int]] = []
    for start, end in sorted(found):
        if out and start < out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def _bucket(n: int) -> str:
    return next((str(b) for b in (0, 3, 6, 8, 9, 11, 12, 15, 19) if n <= b), "more")


def features(part: str, before: str, after: str, word: str) -> list[str]:
    """What is said of a whole segment; ``before`` and ``after`` are the characters next to it."""
    digits = "".join(c for c in part if c.isdigit())
    groups = [len(g) for g in re.findall("[0-9]+", part)]
    marks = "".join(sorted(set(re.sub("[0-9A-Za-z]", "", part))))
    out = [
        "bias",
        "digits=" + _bucket(len(digits)),
        "marks=" + marks,
        "groups=" + "-".join(map(str, groups[:6])) + ("+" if len(groups) > 6 else ""),
        f"groups={min(len(groups), 6)}",
        "flush=" + ("l" if before.isalnum() or before in "+(" else "") + ("r" if after.isalnum() or after in ")@" else ""),
        "near=" + ("d" if before in "-./" and before else "") + ("d" if after in "-/" and after else ""),
        "word=" + word,
    ]
    if any(c.isalpha() for c in part):
        out.append("letters")
    if "@" in part or "(at)" in part or "[at]" in part:
        host = re.split(r"@|\(at\)|\[at\]", part)[-1]
        out += ["at", "dotted" if re.search(r"[A-Za-z0-9] ?(?:\.|\(dot\)|\[dot\]) ?[A-Za-z]{2,}$", host) else "undotted"]
    if 13 <= len(digits) <= 19:
        out.append("luhn" if luhn(digits) else "unluhn")
    if marks == "." and len(groups) == 4:
        octets = [g.lstrip("0") or "0" for g in part.split(".") if g.isdigit()]
        out.append("octets" if all(len(g) <= 3 and int(g) <= 255 for g in octets) else "no octets")
    if part[0] == "+":
        out.append("plus")
    if re.fullmatch(r"(?:\+?[0-9]{1,3}[ -])?\([0-9]{3}\) ?[0-9]{3}[ -][0-9]{4}", part):
        out.append("area code")
    return out


class Zone:
    """A zone's tokens and candidate segments (first token, end token, features)."""

    def __init__(self, text: str, start: int, end: int) -> None:
        self.ends = [start]
        for m in TOKEN.finditer(text, start, end):
            self.ends.append(m.end())
        n = len(self.ends) - 1
        word = re.search(r"([A-Za-z]+)[ :.=]*$", text[max(0, start - 24) : start])
        first_word = word[1].lower()[:12] if word else ""
        self.segments: list[tuple[int, int, list[str]]] = []
        for i in range(n):
            head = text[self.ends[i]]
            if not (head.isalnum() or head in "+("):
                continue
            digits, rest = 0, 0
            for j in range(i, min(n, i + LONGEST)):
                token = text[self.ends[j] : self.ends[j + 1]]
                digits += len(token) if token[0].isdigit() else 0
                rest = rest + 1 if not token[0].isalnum() else 0
                if digits > 19 or rest > 3:
                    break
                if not token[-1].isalnum():
                    continue
                part = text[self.ends[i] : self.ends[j + 1]]
                if digits >= 7 or part.count(".") == 3 or "@" in part or "(at)" in part or "[at]" in part:
                    before, after = text[max(0, self.ends[i] - 1) : self.ends[i]], text[self.ends[j + 1] : self.ends[j + 1] + 1]
                    self.segments.append((i, j + 1, features(part, before, after, first_word if i == 0 else "")))
        self.n = n

    def scored(self, weights: dict) -> list[tuple[int, int, int, float]]:
        return [(i, j, k, sum(weights.get((k, f), 0.0) for f in fs)) for i, j, fs in self.segments for k in range(len(KINDS))]

    def marginals(self, scored: list) -> tuple[list[float], float]:
        """Posterior of each scored segment by forward-backward, and the log of the partition sum."""
        by_end: dict[int, list] = {}
        by_start: dict[int, list] = {}
        for s in scored:
            by_end.setdefault(s[1], []).append(s)
            by_start.setdefault(s[0], []).append(s)
        forward, backward = [0.0] * (self.n + 1), [0.0] * (self.n + 1)
        for t in range(1, self.n + 1):
            forward[t] = _log_sum([forward[t - 1], *[forward[i] + x for i, _, _, x in by_end.get(t, ())]])
        for t in range(self.n - 1, -1, -1):
            backward[t] = _log_sum([backward[t + 1], *[backward[j] + x for _, j, _, x in by_start.get(t, ())]])
        z = forward[self.n]
        return [math.exp(min(0.0, forward[i] + x + backward[j] - z)) for i, j, _, x in scored], z

    def best(self, scored: list) -> list[int]:
        """Indices of the segments on the best path."""
        by_end: dict[int, list] = {}
        for at, s in enumerate(scored):
            by_end.setdefault(s[1], []).append((at, s))
        value, came = [0.0] * (self.n + 1), [-1] * (self.n + 1)
        for t in range(1, self.n + 1):
            value[t] = value[t - 1]
            for at, (i, _, _, x) in by_end.get(t, ()):
                if value[i] + x > value[t]:
                    value[t], came[t] = value[i] + x, at
        out, t = [], self.n
        while t > 0:
            if came[t] >= 0:
                out.append(came[t])
                t = scored[came[t]][0]
            else:
                t -= 1
        return out[::-1]


def _log_sum(values: list[float]) -> float:
    top = max(values)
    return top + math.log(sum(math.exp(v - top) for v in values))


def fit(samples: list[tuple[str, list[Span]]], epochs: int = 8, rate: float = 0.5, ridge: float = 1e-3) -> dict:
    """Weights by (type, feature): stochastic gradient steps, with step sizes by feature, on the likelihood of the labels."""
    rng = random.Random(7)
    data = []
    for text, spans in samples:
        for start, end in zones(text):
            zone = Zone(text, start, end)
            gold = {(s, e, k) for k, s, e in spans}
            on = {(i, j, k) for i, j, _ in zone.segments for k in range(len(KINDS)) if (zone.ends[i], zone.ends[j], k) in gold}
            data.append((zone, on))
    weights: dict = {}
    squares: dict = {}
    for _ in range(epochs):
        rng.shuffle(data)
        for zone, on in data:
            scored = zone.scored(weights)
            posterior, _ = zone.marginals(scored)
            slope: dict = {}
            for (i, j, k, _), p, fs in zip(scored, posterior, (fs for _, _, fs in zone.segments for _ in KINDS), strict=True):
                gap = ((i, j, k) in on) - p
                if abs(gap) > 1e-3:
                    for f in fs:
                        slope[k, f] = slope.get((k, f), 0.0) + gap
            for key, g in slope.items():
                g -= ridge * weights.get(key, 0.0)
                squares[key] = squares.get(key, 1.0) + g * g
                weights[key] = weights.get(key, 0.0) + rate * g / math.sqrt(squares[key])
    return weights


def variants(zone_texts: list[str], seed: int = 3) -> list[tuple[str, list[Span]]]:
    """Labelled stretches for fitting: the sampled ones with their base spans, their variants, and numbers that are nothing."""
    rng = random.Random(seed)
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    out: list[tuple[str, list[Span]]] = []
    around: list[tuple[str, str]] = []

    def put(text: str, start: int, end: int, kind: int, *parts: str) -> None:
        """The text with other parts of a kind, a space apart, in place of a span."""
        spans, told = [], text[:start]
        for part in parts:
            spans.append((kind, len(told), len(told) + len(part)))
            told += part + " "
        out.append((told[:-1] + text[end:][:20], spans))
        around.append((text[:start], text[end:][:20]))

    for text in zone_texts:
        spans = base_spans(text)
        out.append((text, spans))
        if len(spans) != 1:
            continue
        k, s, e = spans[0]
        part = text[s:e]
        if k == 3 and (m := re.match(r"\+[0-9]{1,3} (?=\()", part)):
            put(text, s, e, k, part[m.end() :])
        if k == 0:
            local, _, host = part.partition("@")
            for at, dot in ((" (at) ", " (dot) "), ("[at]", "[dot]")):
                put(text, s, e, k, re.sub("[^A-Za-z0-9]", "", local) + at + host.replace(".", dot))
        if k == 2:
            put(text, s, e, k, part, part)
    for _ in range(max(40, len(zone_texts) // 4)):
        bad = digits(16)
        if luhn(bad):
            bad = bad[:-1] + str((int(bad[-1]) + 1) % 10)
        plain = rng.choice(
            [
                digits(rng.randrange(7, 13)),
                f"20{digits(2)}-0{rng.randrange(1, 10)}-1{digits(1)}",
                f"1{digits(1)}/0{rng.randrange(1, 10)}/20{digits(2)}",
                f"20{digits(2)} - 20{digits(2)}",
                f"{digits(3)}.{digits(3)}.{digits(3)}",
                f"{rng.randrange(300, 999)}.{digits(2)}.{digits(2)}.{digits(2)}",
                f"{digits(1)}.{digits(1)}.{digits(2)}.{digits(1)}.{digits(3)}",
                bad,
                f"{digits(5)} {digits(6)} {digits(3)}",
                f"{digits(4)}-{digits(4)}",
            ]
        )
        before, after = rng.choice(around) if around else ("the ", " of")
        out.append((before + plain + after, []))
    return out


def all_spans(text: str, weights: dict, posterior: float = POSTERIOR) -> tuple[list[Span], list[Span]]:
    """(base spans, base and added spans), each by kind, then start."""
    base = base_spans(text)
    added = []
    for start, end in zones(text):
        taken = [(s, e) for _, s, e in base if s < end and start < e]
        if any(s <= start and e >= end for s, e in taken):
            continue
        zone = Zone(text, start, end)
        scored = zone.scored(weights)
        path = [at for at in zone.best(scored)]
        if not path:
            continue
        sure, _ = zone.marginals(scored)
        for at in path:
            i, j, k, _ = scored[at]
            s, e = zone.ends[i], zone.ends[j]
            if sure[at] >= posterior and not any(a < e and s < b for a, b in taken):
                added.append((k, s, e))
    return base, sorted(base + added)



def train(docs: DataFrame, sample_zones: int = SAMPLE_ZONES) -> dict:
    """The field's weights, from at most ``sample_zones`` zones of different shape.

    Texts that may hold a zone are counted over all rows; as many as give that many zones, if each
    has one, are drawn by a 64-bit hash. Zones longer than ``FIT_CHARS`` aren't fitted on.
    """

    def found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            got = [text[max(0, s - 24) : e + 20] for text in batch["text"] for s, e in zones(text) if e - s <= FIT_CHARS]
            yield pd.DataFrame({"zone": got}, dtype=object)

    may = F.col("text").rlike("[0-9]{2}|@|[(]at[)]|[\\[]at\\]")
    total = docs.where(may).count()
    u = unit(F.xxhash64(F.lit(9), "doc_id", "text"))
    part = docs.where((u < min(1.0, sample_zones / max(1, total))) & may).select("text")  # the hash first: it spares the pattern
    got = part.mapInPandas(found, "zone string").groupBy(F.regexp_replace("zone", "[0-9]", "0").alias("shape")).agg(F.min("zone").alias("zone"))
    texts = sorted(r["zone"] for r in got.orderBy(F.xxhash64("shape")).limit(sample_zones).collect())
    return fit(variants(texts))


def scan(docs: DataFrame, sample_zones: int = SAMPLE_ZONES) -> DataFrame:
    """Per row: doc_id, base and spans as arrays of (kind, start, end)."""
    python_workers(docs.sparkSession)
    weights = docs.sparkSession.sparkContext.broadcast(train(docs, sample_zones))
    span = "array<struct<kind:string,start:bigint,end:bigint>>"
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        named = lambda spans: [{"kind": KINDS[k], "start": s, "end": e} for k, s, e in spans]
        for batch in batches:
            both = [all_spans(text, weights.value) for text in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "base": [named(b) for b, _ in both], "spans": [named(a) for _, a in both]})

    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInPandas(run, f"doc_id {kind}, base {span}, spans {span}")


def digest(docs: DataFrame, sample_zones: int = SAMPLE_ZONES) -> DataFrame:
    """Per row: counts of the base kinds, the digest of the base spans and all spans as text."""
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint")
    text = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return scan(docs, sample_zones).select(
        "doc_id", *[count(k).alias(f"n_{k}") for k in KINDS], F.sha2(text("base"), 256).alias("base_sha256"), text("spans").alias("spans")
    )
