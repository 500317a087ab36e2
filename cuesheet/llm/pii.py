"""Personal data: fixed base detectors, and a semi-Markov conditional random field that adds spans."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cuesheet.llm.common import narrow, table

KINDS = ("email", "ip", "card", "phone")

_TRIGGER = re.compile(r"[0-9@]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = 2 * d - 9 if d > 4 else 2 * d
        total += d
    return total % 10 == 0


def only_digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base detectors: per kind leftmost, not overlapping; by start, then kind."""
    out = []
    at, last = text.find("@"), 0
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end(), "email"))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in m[0].split(".")):
            out.append((m.start(), m.end(), "ip"))
    for m in _CARD.finditer(text):
        digits = only_digits(m[0])
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), m.end(), "card"))
    for m in _PHONE.finditer(text):
        if 10 <= len(only_digits(m[0])) <= 15:
            out.append((m.start(), m.end(), "phone"))
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


# ---- the random field -------------------------------------------------------------------------

_TOKEN = re.compile(r"[^\W\d_]+|[0-9]+|[^\S\n]+|.", re.DOTALL)
_NUMBER_MARKS = frozenset("+().- ")
MAX_TOKENS = 24


def windows(text: str, gap: int = 16, before: int = 48, after: int = 16) -> Iterator[tuple[int, int]]:
    """Stretches around digits and at signs; no segment can lie elsewhere, so the rest is labelled as text."""
    lo = hi = None
    past = 0
    for m in _TRIGGER.finditer(text):
        if hi is not None and m.start() - hi > gap:
            yield max(past, lo - before), min(len(text), hi + after)
            lo, past = None, hi
        if lo is None:
            lo = m.start()
        hi = m.end()
    if lo is not None:
        yield max(past, lo - before), min(len(text), hi + after)


def candidates(tokens: list[str]) -> Iterator[tuple[int, int, str]]:
    """(first, end, kind) of segments of at most ``MAX_TOKENS`` tokens that could be an entity.

    Addresses are stretches without white space that hold an at sign; numbers
    are digits, blanks and + ( ) . - with 7 to 19 digits.
    """
    n = len(tokens)
    for i, t in enumerate(tokens):
        if t[0] in _LOCAL and not (i and tokens[i - 1][-1] in _LOCAL and tokens[i - 1][0] in _LOCAL):
            seen = False
            for j in range(i, min(n, i + MAX_TOKENS)):
                if tokens[j].isspace() or not all(c in _LOCAL or c == "@" for c in tokens[j]):
                    break
                seen |= tokens[j] == "@"
                if seen and tokens[j][-1].isalnum():
                    yield i, j + 1, "email"
        if "0" <= t[0] <= "9" or t in "+(":
            digits = 0
            for j in range(i, min(n, i + MAX_TOKENS)):
                u = tokens[j]
                if "0" <= u[0] <= "9":
                    digits += len(u)
                    if digits > 19:
                        break
                    if digits >= 7:
                        yield i, j + 1, "card"
                        yield i, j + 1, "phone"
                    if digits >= 4 and j - i == 6:
                        yield i, j + 1, "ip"
                elif u not in _NUMBER_MARKS:
                    break


def features(tokens: list[str], i: int, j: int, kind: str) -> list[str]:
    """Features of a whole span under one kind."""
    text = "".join(tokens[i:j])
    left = tokens[i - 1][-1] if i else " "
    right = tokens[j][0] if j < len(tokens) else " "

    def side(c: str) -> str:
        return "digit" if "0" <= c <= "9" else "letter" if c.isalnum() else "blank" if c.isspace() else "mark" if c in "+-.@_=/:" else "other"

    after = tokens[j + 1][0] if j + 1 < len(tokens) and right in ".-" else " "
    out = ["any", "left " + side(left), "right " + side(right) + (" digit" if "0" <= after <= "9" else "")]
    word = next((t.lower() for t in reversed(tokens[max(0, i - 3) : i]) if t.isalpha()), "")
    out.append("word " + (word if word in CUES else "other"))
    if kind == "email":
        local, _, domain = text.partition("@")
        labels = domain.split(".")
        out += [f"labels {min(4, len(labels))}", f"top {labels[-1].isalpha() and len(labels[-1]) >= 2}", f"at {text.count('@')}"]
        out += [f"local {bool(local)}", f"empty {'' in labels}"]
        return out
    groups = re.findall(r"[0-9]+", text)
    n = sum(map(len, groups))
    marks = "".join(sorted(set(re.sub(r"[0-9]", "", text))))
    sizes = "-".join(str(len(g)) for g in groups[:6])
    out += [f"digits {n}", f"marks {marks}", f"groups {sizes}", f"starts {text[0] if text[0] in '+(' else 'digit'}"]
    if kind == "card":
        out.append(f"luhn {luhn(''.join(groups))} {13 <= n <= 19}")
        out.append(f"even {len({len(g) for g in groups[:-1]}) <= 1} {len(groups) > 1}")
    elif kind == "ip":
        out.append(f"parts {len(groups)} {marks == '.'} {all(len(g) <= 3 and int(g) <= 255 for g in groups)}")
    else:
        out.append(f"long {10 <= n <= 15} {'+' in text}")
        out.append(f"plus {text.count('+')} {text.startswith('+')} blanks {'  ' in text}")
    return [kind + " " + f for f in out]


#: Words before a span that may matter.
CUES = frozenset("call phone tel fax mobile contact mail email card visa paid ip host server address order number id version page room from".split())


class SegmentField:
    """Weights of span features; segments of one token are text and weigh nothing."""

    def __init__(self, weights: dict[str, float] | None = None):
        self.w = defaultdict(float, weights or {})

    def lattice(self, tokens: list[str]) -> list[tuple[int, int, str, list[str], float]]:
        out = []
        for i, j, kind in candidates(tokens):
            fs = features(tokens, i, j, kind)
            out.append((i, j, kind, fs, sum(self.w[f] for f in fs if f in self.w)))
        return out

    @staticmethod
    def _sums(n: int, segments: list, forward: bool) -> list[float]:
        """Log sums over all labelings of the tokens before (after) each boundary."""
        by_edge = defaultdict(list)
        for i, j, _, _, s in segments:
            by_edge[j if forward else i].append((i if forward else j, s))
        out = [0.0] * (n + 1)
        for p in range(1, n + 1) if forward else range(n - 1, -1, -1):
            terms = [out[p - 1] if forward else out[p + 1], *(out[q] + s for q, s in by_edge[p])]
            top = max(terms)
            out[p] = top + math.log(sum(math.exp(t - top) for t in terms))
        return out

    def marginals(self, n: int, segments: list) -> list[float]:
        before, after = self._sums(n, segments, True), self._sums(n, segments, False)
        return [math.exp(min(0.0, before[i] + s + after[j] - before[n])) for i, j, _, _, s in segments]

    def best(self, tokens: list[str]) -> list[tuple[int, int, str, float]]:
        """The best labeling: (first, end, kind, posterior) of its segments, by dynamic programming over boundaries."""
        segments = self.lattice(tokens)
        if not segments:
            return []
        by_end = defaultdict(list)
        for k, s in enumerate(segments):
            by_end[s[1]].append(k)
        score, back = [0.0] * (len(tokens) + 1), [-1] * (len(tokens) + 1)
        for p in range(1, len(tokens) + 1):
            score[p] = score[p - 1]
            for k in by_end[p]:
                if score[segments[k][0]] + segments[k][4] > score[p]:
                    score[p], back[p] = score[segments[k][0]] + segments[k][4], k
        chosen, p = [], len(tokens)
        while p:
            if back[p] < 0:
                p -= 1
            else:
                chosen.append(back[p])
                p = segments[back[p]][0]
        if not chosen:
            return []
        sure = self.marginals(len(tokens), segments)
        return [(*segments[k][:3], sure[k]) for k in reversed(chosen)]

    def fit(self, examples: list[tuple[list[str], set]], rounds: int = 10, rate: float = 0.5) -> SegmentField:
        """Adaptive gradient ascent on the likelihood of the gold segments (first, end, kind)."""
        grown = defaultdict(float)
        for _ in range(rounds):
            for tokens, gold in examples:
                segments = self.lattice(tokens)
                step: dict[str, float] = defaultdict(float)
                for (i, j, kind, fs, _), p in zip(segments, self.marginals(len(tokens), segments)):
                    d = ((i, j, kind) in gold) - p
                    if abs(d) > 1e-4:
                        for f in fs:
                            step[f] += d
                for f, g in step.items():
                    g -= 0.002 * self.w[f]
                    grown[f] += g * g
                    self.w[f] += rate * g / math.sqrt(grown[f] + 1e-8)
        return self


def training_set(n: int = 700, seed: int = 11) -> list[tuple[list[str], set]]:
    """Invented sentences with entities in many forms, alone and side by side, and numbers that are none."""
    rng = random.Random(seed)
    digits = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    lead = lambda k: rng.choice("123456789") + digits(k - 1)
    word = lambda: "".join(rng.choice("aeioubcdflmnprst") for _ in range(rng.randint(2, 9)))

    def card() -> str:
        body = rng.choice("3456") + digits(rng.choice((13, 14, 14, 14, 14, 15, 17)))
        body += next(c for c in "0123456789" if luhn(body + c))
        sep = rng.choice(("", "", "", " ", "-"))
        return sep.join(body[k : k + 4] for k in range(0, len(body), 4))

    def phone() -> str:
        a, b, c = lead(3), lead(3), digits(4)
        return rng.choice((f"+{lead(1)} ({a}) {b}-{c}", f"+{lead(2)} {a} {b} {c}", f"+{lead(1)}{a}{b}{c}", f"({a}) {b}-{c}", f"+{lead(1)}-{a}-{b}-{c}", f"+{lead(2)} {digits(2)} {digits(3)} {digits(2)} {digits(2)}", f"+{lead(1)}.{a}.{b}.{c}"))

    def email() -> str:
        return rng.choice((word(), f"{word()}.{digits(2)}", f"{word()}_{word()}", f"{word()}+{word()}")) + "@" + ".".join([word() + rng.choice(("", digits(1))) for _ in range(rng.randint(1, 2))] + [rng.choice(("com", "org", "net", "de", "fr"))])

    def ip() -> str:
        return ".".join(str(rng.randint(0, 255)) for _ in range(4))

    def other() -> str:
        broken = card()
        broken = broken[:-1] + next(c for c in "0123456789" if not luhn(only_digits(broken[:-1] + c)))
        return rng.choice((
            broken, digits(rng.randint(1, 24)), f"{lead(4)}-{digits(2)}-{digits(2)}", f"{digits(2)}.{digits(2)}.{lead(4)}", f"{lead(1)}.{digits(1)}.{digits(1)}", f"{lead(2)},{digits(3)}.{digits(2)}",
            ".".join(str(rng.randint(256, 999)) for _ in range(4)), ".".join(digits(1) for _ in range(rng.choice((5, 6)))), "AK" + word().upper() + digits(3) + word().upper() + digits(8), f"token = \"{word()[:3]}{digits(9)}{word()[:2]}{digits(7)}\"",
            f"{word()}@{word()}", f"@{word()}", f"{lead(3)}-{digits(2)}-{digits(4)}", f"{lead(3)} {digits(3)} {digits(3)}", f"+{digits(rng.randint(17, 22))}", f"+{lead(3)}", f"{digits(8)}-{digits(4)}-{digits(4)}",
        ))

    makers = {"email": email, "ip": ip, "card": card, "phone": phone}
    out = []
    for _ in range(n):
        text, spans = "", []
        for _ in range(rng.randint(1, 4)):
            for _ in range(rng.choice((0, 0, 1, 2, 4))):
                text += (rng.choice(sorted(CUES)) if rng.random() < 0.15 else word()) + rng.choice((" ", " ", ", ", ". "))
            kind = rng.choice((*KINDS, "other"))
            value = makers[kind]() if kind != "other" else other()
            if kind != "other":
                spans.append((len(text), len(text) + len(value), kind))
            text += value + rng.choice((" ", " ", " ", ". ", ", ", "\n"))
        tokens = _TOKEN.findall(text)
        starts, at = {}, 0
        for k, t in enumerate(tokens):
            starts[at] = k
            at += len(t)
        starts[at] = len(tokens)
        out.append((tokens, {(starts[a], starts[b], kind) for a, b, kind in spans}))
    return out


def added_spans(text: str, base: list[tuple[int, int, str]], field: SegmentField, sure: float = 0.8) -> list[tuple[int, int, str]]:
    """Spans of the field with a posterior of ``sure`` or more that overlap no base span."""
    out = []
    for lo, hi in windows(text):
        tokens = _TOKEN.findall(text[lo:hi])
        starts, at = [], lo
        for t in tokens:
            starts.append(at)
            at += len(t)
        starts.append(at)
        for i, j, kind, p in field.best(tokens):
            a, b = starts[i], starts[j]
            if p >= sure and not any(x < b and a < y for x, y, _ in base):
                out.append((a, b, kind))
    return out


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]))))


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", field: SegmentField | None = None) -> DataFrame:
    """doc_id, base and spans (arrays of kind, start, end in code points) of each whole text.

    ``spans`` are the base spans and those that the random field adds.  Null and
    empty texts have none; repeated rows are searched each; extra columns are
    ignored; no shuffle.  The field is fitted once on invented sentences, on the
    driver, and its weights (some hundreds) are sent to the tasks.
    """
    held = docs.sparkSession.sparkContext.broadcast(dict((field or SegmentField().fit(training_set())).w))
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crf = SegmentField(held.value)
        as_rows = lambda spans: [{"kind": k, "start": a, "end": b} for a, b, k in sorted(spans, key=lambda s: (s[0], KINDS.index(s[2])))]
        for b in batches:
            bases, spans = [], []
            for value in b.column(1):
                text = value.as_py() or ""
                base = base_spans(text) if _TRIGGER.search(text) else []
                more = added_spans(text, base, crf) if base or _TRIGGER.search(text) else []
                bases.append(as_rows(base))
                spans.append(as_rows(base + more))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(bases, kind), pa.array(spans, kind)], names=["doc_id", "base", "spans"])

    source = narrow(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    one = "array<struct<kind:string,start:long,end:long>>"
    return source.mapInArrow(find, f"doc_id long, base {one}, spans {one}")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts are those of the base spans; ``n_added`` counts the field's."""
    found = find_pii(table(spark, sf_dir, "documents"))

    def text(col: str) -> Column:
        return F.array_join(F.transform(col, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in KINDS]
    added = (F.size("spans") - F.size("base")).cast("long").alias("n_added")
    return found.select("doc_id", *counts, F.sha2(text("base"), 256).alias("base_sha256"), text("spans").alias("spans"), added)


QUERIES = {"op1_pii": op1_pii}
