"""Personal data in texts: fixed rules, and a semi-Markov conditional random field beside them.

The rules find e-mail and IP addresses, card and telephone numbers. The field scores whole spans
(their digits, groups, separators, check digit, neighbours and the word before) instead of single
characters; dynamic programming over spans of bounded length then chooses boundaries and kinds
together. It adds what the rules miss: numbers that stand beside each other, other separators,
numbers without a plus sign, addresses written out with "at" and "dot".

It is trained here, on a bounded sample: what the rules find in some documents, and made-up
variants with decoys. Documents are independent: one pass to find, no shuffle.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.tables import by_batch, read
from plumbline.llm.texts import chunks

KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(4)

#: Training looks at about this many documents, and at no more than so many of their number zones.
SAMPLE_DOCUMENTS = 3000
SAMPLE_ZONES = 4000
MADE_UP_LINES = 2500
#: A span holds at most so many groups of digits, and 4 to 19 digits.
GROUPS = 8
LEAST_DIGITS, MOST_DIGITS = 4, 19
#: An address written out has at most so many labels behind its "at".
LABELS = 5
#: What a span must score beyond leaving its words alone.
MARGIN = 2.0
CONTEXT = 24


def _class(characters: str) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(characters.encode())] = True
    return table


_DIGITS = "0123456789"
_ALPHA = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_DIGIT = _class(_DIGITS)
_NUMBER = _class(_DIGITS + " ().+-")
_LOCAL = _class(_DIGITS + _ALPHA + "._%+-")
_DOMAIN = re.compile(rb"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_CARD = re.compile(rb"[0-9]+(?:[\x20-][0-9]+)*")
_PHONE = re.compile(rb"\+[0-9][\x20().0-9-]+[0-9]")
_CHAIN = re.compile(rb"[0-9]+(?:\.[0-9]+)*")
_GROUP = re.compile(rb"[0-9]+")
_AT = re.compile(rb"(?i)\x20?(?:\(at\)|\[at\]|\{at\})\x20?|\x20at\x20|\x20@\x20")
_DOT = re.compile(rb"(?i)\x20?(?:\(dot\)|\[dot\]|\{dot\})\x20?|\x20dot\x20|\.")
_LABEL = re.compile(rb"[A-Za-z0-9-]+")
_BEFORE = re.compile(rb"([A-Za-z-]+)[^A-Za-z0-9]{0,3}\Z")
_LOCAL_END = re.compile(rb"[A-Za-z0-9._%+-]{1,64}\Z")

# Words that name what follows, and common top-level domains.
CUES = {
    b"mail": "email", b"email": "email", b"e-mail": "email", b"contact": "email", b"write": "email",
    b"ip": "ip", b"host": "ip", b"server": "ip", b"address": "ip",
    b"card": "card", b"visa": "card", b"mastercard": "card", b"credit": "card",
    b"tel": "phone", b"phone": "phone", b"call": "phone", b"mobile": "phone", b"fax": "phone",
}
TOP_LEVEL = {b"com", b"org", b"net", b"edu", b"gov", b"io", b"info", b"de", b"fr", b"es", b"uk"}

Span = tuple[int, int, int]  # first byte, end, kind


def luhn(digits: bytes) -> bool:
    total = 0
    for place, code in enumerate(reversed(digits)):
        value = code - 48
        if place % 2:
            value = 2 * value - 9 if value > 4 else 2 * value
        total += value
    return total % 10 == 0


def _octet(part: bytes) -> bool:
    part = part.lstrip(b"0")
    return len(part) < 4 and int(part or b"0") <= 255


# --- rules -----------------------------------------------------------------------------------


def number_zones(offsets: np.ndarray, data: np.ndarray) -> list[tuple[int, int]]:
    """Stretches of digits, blanks and ``().+-`` inside documents that hold at least 4 digits."""
    inside = _NUMBER[data]
    starts, ends = inside.copy(), inside.copy()
    starts[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    edge = offsets[1:-1]
    edge = edge[(edge > 0) & (edge < len(data))]
    starts[edge] = inside[edge]
    ends[edge - 1] = inside[edge - 1]
    start, end = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    digits = np.concatenate(([0], np.cumsum(_DIGIT[data])))
    full = digits[end] - digits[start] >= LEAST_DIGITS
    return list(zip(start[full].tolist(), end[full].tolist()))


def number_spans(raw: bytes, start: int, end: int) -> Iterator[Span]:
    """What the rules find in one zone; a match that fails is dropped and not tried otherwise."""
    for match in _CHAIN.finditer(raw, start, end):
        parts, at = match[0].split(b"."), match.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            size = sum(map(len, four)) + 3
            if all(map(_octet, four)):
                yield at, at + size, IP
            at += size + 1
    for match in _CARD.finditer(raw, start, end):
        if 14 <= match.end() - match.start() <= 37:
            digits = match[0].replace(b" ", b"").replace(b"-", b"")
            if 14 <= len(digits) <= 19 and luhn(digits):
                yield match.start(), match.end(), CARD
    for match in _PHONE.finditer(raw, start, end):
        if 10 <= _digits(match[0]) <= 15:
            yield match.start(), match.end(), PHONE


def email_spans(offsets: np.ndarray, data: np.ndarray, raw: bytes) -> Iterator[Span]:
    signs = np.flatnonzero(data == ord("@"))
    if not len(signs):
        return
    others = np.flatnonzero(~_LOCAL[data])
    doc = np.searchsorted(offsets, signs, "right") - 1
    before = np.searchsorted(others, signs) - 1
    left = np.where(before >= 0, others[np.maximum(before, 0)] + 1, 0)
    left = np.maximum(left, offsets[doc])
    done = 0
    for sign, start, end in zip(signs.tolist(), left.tolist(), offsets[doc + 1].tolist()):
        start = max(start, done)
        match = _DOMAIN.match(raw, sign + 1, end) if start < sign else None
        if match:
            done = match.end()
            yield start, done, EMAIL


# --- spans the field chooses from ------------------------------------------------------------


@dataclass
class Option:
    start: int
    end: int
    kinds: tuple[int, ...]
    features: list[str]


def _side(raw: bytes, place: int, low: int, high: int) -> str:
    if not low <= place < high:
        return "edge"
    code = raw[place]
    if code >= 128 or chr(code).isalpha() or code == 95:
        return "letter"
    return "digit" if 48 <= code < 58 else "blank" if code <= 32 else chr(code)


def _cue(raw: bytes, place: int, low: int) -> str:
    match = _BEFORE.search(raw[max(low, place - CONTEXT) : place])
    return CUES.get(match[1].lower(), "none") if match else "none"


def number_options(raw: bytes, start: int, end: int, low: int, high: int) -> Iterator[Option]:
    """All spans of a zone from one group of digits to another, with a leading ``+`` or ``(`` or without.

    ``low`` and ``high`` are the ends of the document.
    """
    groups = [m.span() for m in _GROUP.finditer(raw, start, end)]
    for i, (first, _) in enumerate(groups):
        heads = [first]
        if first > start and raw[first - 1] in b"(+":
            heads.append(first - 1)
            if raw[first - 1] == 40 and first - 1 > start and raw[first - 2] == 43:
                heads.append(first - 2)
        digits = b""
        for j in range(i, min(i + GROUPS, len(groups))):
            if j > i and groups[j][0] - groups[j - 1][1] > 3:
                break
            digits += raw[groups[j][0] : groups[j][1]]
            if len(digits) > MOST_DIGITS:
                break
            if len(digits) < LEAST_DIGITS:
                continue
            last = groups[j][1]
            parts = [raw[a:b] for a, b in groups[i : j + 1]]
            gaps = [raw[groups[k][1] : groups[k + 1][0]] for k in range(i, j)]
            shared = [
                f"digits={len(digits)}", f"groups={len(parts)}",
                "shape=" + ("-".join(str(len(p)) for p in parts) if len(parts) < 6 else "many"),
                "gap=" + (gaps[0].decode() if len(set(gaps)) == 1 else "mixed" if gaps else "none"),
                f"long gaps={sum(len(g) > 2 for g in gaps)}",
                "right=" + _side(raw, last, low, high),
            ]
            if len(digits) >= 13:
                shared.append("check digit" if luhn(digits) else "no check digit")
            if len(parts) == 4 and all(g.strip() == b"." for g in gaps):
                shared.append("octets" if all(map(_octet, parts)) else "no octets")
            after = raw[last : last + 2]
            if len(after) == 2 and after[0] in b".-" and 48 <= after[1] < 58 and last + 1 < high:
                shared.append("goes on")
            for head in heads:
                own = raw[head:first]
                span = raw[head:last]
                own_features = [
                    "head=" + own.decode(), "left=" + _side(raw, head - 1, low, high), "cue=" + _cue(raw, head, low),
                    "brackets=" + str(span.count(b"(") - span.count(b")")), f"pluses={span.count(b'+')}",
                ]
                if head - 2 >= low and raw[head - 1] in b".-" and 48 <= raw[head - 2] < 58:
                    own_features.append("goes on before")
                yield Option(head, last, (IP, CARD, PHONE), ["number", *shared, *own_features])


def address_options(raw: bytes, match: re.Match, low: int, high: int) -> Iterator[Option]:
    """Spans around one written-out "at": the word before it, and two to five labels behind it."""
    left = _LOCAL_END.search(raw[max(low, match.start() - 64) : match.start()])
    if not left:
        return
    start = match.start() - len(left[0])
    sign = match[0].strip().lower().decode()
    labels, dots, at = [], [], match.end()
    while len(labels) < LABELS:
        label = _LABEL.match(raw, at, min(high, at + 64))
        if not label:
            break
        labels.append(label[0])
        if len(labels) > 1:
            top = labels[-1].lower()
            local = "plain" if left[0].isalpha() else "marked"
            styles = {"." if d == b"." else "word" if d == b" dot " else "bracket" for d in dots}
            yield Option(start, label.end(), (EMAIL,), [
                "address", "sign=" + sign, "dots=" + "+".join(sorted(styles)),
                f"sign={sign} dots={'+'.join(sorted(styles))}", f"labels={len(labels)}",
                "top=" + ("known" if top in TOP_LEVEL else "short" if top.isalpha() and len(top) < 4 else "other"),
                "local=" + local, "cue=" + _cue(raw, start, low),
                "next=" + ("dot" if _DOT.match(raw, label.end(), high) else "end"),
            ])
        dot = _DOT.match(raw, label.end(), high)
        if not dot:
            break
        dots.append(dot[0].lower())
        at = dot.end()


def _at_signs(raw: bytes) -> Iterator[re.Match]:
    return _AT.finditer(raw)


# --- the field -------------------------------------------------------------------------------


@dataclass
class Field:
    """Weight of every feature of every kind; spans not chosen score 0."""

    names: dict[str, int]
    weights: np.ndarray

    def score(self, option: Option, kind: int) -> float:
        row = self.weights[kind]
        return float(sum(row[self.names[f]] for f in option.features if f in self.names))


def best_spans(field: Field, options: Sequence[Option], margin: float = MARGIN) -> list[Span]:
    """Non-overlapping spans and kinds of greatest total score, each over ``margin``; ties to fewer."""
    scored = []
    for option in options:
        for kind in option.kinds:
            score = field.score(option, kind) - margin
            if score > 0:
                scored.append((option.end, option.start, kind, score))
    scored.sort()
    ends, values, last = [-1], [0.0], [None]
    for end, start, kind, score in scored:
        before = bisect_right(ends, start) - 1
        value = values[before] + score
        if value > values[-1]:
            if ends[-1] == end:
                values[-1], last[-1] = value, (start, end, kind, before)
            else:
                ends.append(end)
                values.append(value)
                last.append((start, end, kind, before))
    out, at = [], len(ends) - 1
    while at > 0:
        start, end, kind, at = last[at]
        out.append((start, end, kind))
    return out[::-1]


Zone = tuple[list[Option], set[Span]]


def fit(zones: Sequence[Zone], steps: int = 150, rate: float = 0.15, decay: float = 0.02) -> Field:
    """Weights of greatest likelihood of the zones' true spans, by gradient steps.

    Forward and backward sums run over all zones side by side, one boundary at a time.
    """
    names: dict[str, int] = {}
    zone_of, first, last, kind_of, true, features, owner = [], [], [], [], [], [], []
    for z, (options, spans) in enumerate(zones):
        cuts = {c: i for i, c in enumerate(sorted({c for o in options for c in (o.start, o.end)}))}
        for option in options:
            own = [names.setdefault(f, len(names)) for f in option.features]
            for kind in option.kinds:
                owner += [len(zone_of)] * len(own)
                features += own
                zone_of.append(z)
                first.append(cuts[option.start])
                last.append(cuts[option.end])
                kind_of.append(kind)
                true.append((option.start, option.end, kind) in spans)
    weights = np.zeros((len(KINDS), len(names)))
    if not zone_of:
        return Field(names, weights)
    zone, first, last, kind = (np.array(x) for x in (zone_of, first, last, kind_of))
    owner, features, true = np.array(owner), np.array(features), np.array(true, float)
    cell = kind[owner] * len(names) + features
    size = int(last.max()) + 1
    ending = [np.flatnonzero(last == t) for t in range(size)]
    starting = [np.flatnonzero(first == t) for t in range(size)]
    moment, spread = np.zeros(weights.size), np.zeros(weights.size)
    flat = weights.reshape(-1)
    for step in range(1, steps + 1):
        score = np.bincount(owner, flat[cell], minlength=len(zone))
        ahead, behind = np.zeros((size, len(zones))), np.zeros((size, len(zones)))
        for t in range(1, size):
            ahead[t] = ahead[t - 1]
            a = ending[t]
            np.logaddexp.at(ahead[t], zone[a], ahead[first[a], zone[a]] + score[a])
        for t in range(size - 2, -1, -1):
            behind[t] = behind[t + 1]
            a = starting[t]
            np.logaddexp.at(behind[t], zone[a], behind[last[a], zone[a]] + score[a])
        share = np.exp(ahead[first, zone] + score + behind[last, zone] - ahead[-1, zone])
        slope = np.bincount(cell, (true - share)[owner], minlength=flat.size) - decay * flat
        moment = 0.9 * moment + 0.1 * slope
        spread = 0.99 * spread + 0.01 * slope * slope
        flat += rate * (moment / (1 - 0.9**step)) / (np.sqrt(spread / (1 - 0.99**step)) + 1e-8)
    return Field(names, weights)


# --- training data ---------------------------------------------------------------------------


def _card(draw: np.random.Generator, size: int = 16) -> str:
    digits = "".join(map(str, [4, *draw.integers(0, 10, size - 2)]))
    return digits + next(str(d) for d in range(10) if luhn(f"{digits}{d}".encode()))


def _made_up(draw: np.random.Generator) -> tuple[str, int | None]:
    """A span of some kind in one of many spellings, or a decoy."""
    n = lambda low, high: int(draw.integers(low, high))
    pick = lambda *options: options[n(0, len(options))]
    kind = n(0, 9)
    if kind == 0:
        return ".".join(str(n(0, 256)) for _ in range(4)), IP
    if kind in (1, 2):
        digits = _card(draw, pick(16, 16, 16, 15, 14, 19))
        sep = pick("", "", "", " ", "-", ".")
        return sep.join(digits[i : i + 4] for i in range(0, len(digits), 4)) if sep else digits, CARD
    if kind in (3, 4):
        area, mid, end = f"{n(200, 1000)}", f"{n(100, 1000):03}", f"{n(0, 10000):04}"
        return pick(
            f"+{n(1, 99)} ({area}) {mid}-{end}", f"+{n(1, 99)} {area} {mid} {end}", f"({area}) {mid}-{end}",
            f"{area}-{mid}-{end}", f"{area}.{mid}.{end}", f"1-{area}-{mid}-{end}",
        ), PHONE
    if kind == 5:
        name = pick("joe", "anna.b", "info", "k_lee", "sales") + pick("", "", str(n(1, 99)))
        at, dot = pick((" at ", " dot "), ("(at)", "."), (" [at] ", " [dot] "), ("[at]", "."), (" (at) ", " (dot) "), (" @ ", "."))
        return name + at + dot.join([pick("example", "mail", "web", "uni-x"), *pick((), (), ("co",)), pick("com", "org", "net", "de")]), EMAIL
    if kind == 6:
        wrong = _card(draw)
        return pick(
            wrong[:-1] + str((int(wrong[-1]) + n(1, 10)) % 10),
            ".".join(str(n(200, 999)) for _ in range(3)) + f".{n(256, 999)}",
            f"{n(1, 9)}.{n(0, 99)}.{n(0, 99)}", f"{n(1, 9)}.{n(0, 9)}.{n(0, 9)}.{n(0, 9)}.{n(0, 9)}",
            "".join(str(n(0, 10)) for _ in range(n(20, 40))),
        ), None
    if kind == 7:
        return pick(
            f"{n(1900, 2100)}-{n(1, 13):02}-{n(1, 29):02}", f"{n(1, 29):02}.{n(1, 13):02}.{n(1900, 2100)}",
            f"{n(1900, 2000)}-{n(2000, 2100)}", f"{n(100, 999)}-{n(1000, 9999)}", f"{n(1000, 10**6)}.{n(10, 99)}",
            f"978-{n(0, 9)}-{n(10, 99)}-{n(100000, 999999)}-{n(0, 9)}", f"{n(10**4, 10**6)}", f"{n(10**7, 10**13)}",
        ), None
    return pick(
        " ".join(str(n(1, 10 ** n(1, 5))) for _ in range(n(3, 9))), f"look at {pick('example', 'page')}.com",
        f"meet at noon. {pick('Then', 'She')}", f"a point at the dot {pick('com', 'there')}", f"{n(1, 99)} - {n(1000, 9999)}",
        "be at home dot", f"x{n(10**9, 10**12)}y",
    ), None


def made_up_lines(lines: int, seed: int = 11) -> Iterator[tuple[bytes, set[Span]]]:
    """Lines of one to three spans or decoys between words, some with a cue before them."""
    draw = np.random.default_rng(seed)
    cue = {EMAIL: "mail", IP: "host", CARD: "card", PHONE: "phone"}
    for _ in range(lines):
        text, spans = "", set()
        for _ in range(int(draw.integers(1, 4))):
            body, kind = _made_up(draw)
            lead = ["", "word ", "the end. ", "über ", "x, "][int(draw.integers(0, 5))]
            if kind is not None and draw.random() < 0.2:
                lead = f"{cue[kind]}: "
            text += lead
            if kind is not None:
                start = len(text.encode())
                spans.add((start, start + len(body.encode()), kind))
            text += body + [" ", " ", ". ", ", ", " word "][int(draw.integers(0, 5))]
        yield text.encode(), spans


def _line_zone(raw: bytes, spans: set[Span]) -> Zone:
    offsets, data = np.array([0, len(raw)]), np.frombuffer(raw, np.uint8)
    options = [o for a, b in number_zones(offsets, data) for o in number_options(raw, a, b, 0, len(raw))]
    options += [o for m in _at_signs(raw) for o in address_options(raw, m, 0, len(raw))]
    known = {(o.start, o.end, k) for o in options for k in o.kinds}
    return options, spans & known


def _digits(text: bytes) -> int:
    return sum(48 <= c < 58 for c in text)


def _sampled(df: DataFrame, documents: int, zones: int) -> list[tuple[bytes, set[Span]]]:
    """Number zones of some documents, with what the rules say of them."""
    total = df.count()
    rows = df.select("text", F.xxhash64("key", F.length("text"), F.substring("text", 1, 64)).alias("h"))
    if total > documents:
        rows = rows.where(F.pmod("h", F.lit(1 << 30)) < F.lit((documents << 30) // total))

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for first, _, offsets, data in chunks(batch):
            raw, lines, order = data.tobytes(), [], []
            for a, b in number_zones(offsets, data):
                if b - a <= 100:
                    doc = int(np.searchsorted(offsets, a, "right")) - 1
                    low, high = max(int(offsets[doc]), a - CONTEXT), min(int(offsets[doc + 1]), b + 4)
                    lines.append({"line": raw[low:high], "start": a - low, "end": b - low})
                    order.append(hashlib.md5(raw[low:high]).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [pa.array(order, pa.string()), pa.array([x["line"] for x in lines], pa.binary()),
                 pa.array([x["start"] for x in lines], pa.int32()), pa.array([x["end"] for x in lines], pa.int32())],
                ["h", "line", "start", "end"],
            )

    found = by_batch(rows, run, "h string, line binary, start int, end int").distinct()
    out = []
    for row in found.orderBy("h", "start").limit(zones).collect():
        raw = bytes(row["line"])
        spans = set(number_spans(raw, row["start"], row["end"]))
        taken = {s for s in spans if not any(o[0] <= s[0] and s[1] <= o[1] and o != s for o in spans)}
        # More digits than a span can hold, and not all in the rules' spans: there they know nothing.
        if _digits(raw[row["start"] : row["end"]]) > max(MOST_DIGITS, sum(_digits(raw[a:b]) for a, b, _ in taken)):
            continue
        out.append((list(number_options(raw, row["start"], row["end"], 0, len(raw))), taken))
    return out


def train(df: DataFrame, key: str = "doc_id", text: str = "text", documents: int = SAMPLE_DOCUMENTS,
          zones: int = SAMPLE_ZONES) -> Field:
    """The field, fitted to made-up lines and to what the rules find in a sample of ``df``.

    About ``documents`` rows chosen by a hash and at most ``zones`` of their number zones (shorter
    than 100 bytes, equal ones once) come to the driver; a rerun draws the same ones.
    """
    frame = df.select(df[key].alias("key"), df[text].cast("string").alias("text"))
    made = [_line_zone(*line) for line in made_up_lines(MADE_UP_LINES)]
    return fit([*made, *_sampled(frame, documents, zones)])


# --- finding ---------------------------------------------------------------------------------


def find_spans(offsets: np.ndarray, data: np.ndarray, field: Field | None) -> tuple[list[list[Span]], list[list[Span]]]:
    """Spans of the rules, and those the field adds, of each document of a chunk (bytes of the chunk)."""
    raw, docs = data.tobytes(), len(offsets) - 1
    base: list[list[Span]] = [[] for _ in range(docs)]
    more: list[list[Span]] = [[] for _ in range(docs)]
    zones = number_zones(offsets, data)
    doc_of = (np.searchsorted(offsets, [a for a, _ in zones], "right") - 1).tolist() if zones else []
    found = [span for a, b in zones for span in number_spans(raw, a, b)]
    found += email_spans(offsets, data, raw)
    if found:
        owner = np.searchsorted(offsets, [s[0] for s in found], "right") - 1
        for doc, span in zip(owner.tolist(), found):
            base[doc].append(span)
    for spans in base:
        spans.sort(key=lambda s: (s[0], s[2]))
    if field is None:
        return base, more

    options: dict[int, list[Option]] = {}
    taken = np.zeros(len(data) + 1, np.int64)
    for start, end, _ in found:
        taken[start] += 1
        taken[end] -= 1
    # Bytes of the rules' spans before each byte; a span that holds one of them is out.
    taken = np.concatenate(([0], np.cumsum(np.cumsum(taken[:-1]) > 0)))
    free = np.concatenate(([0], np.cumsum(_DIGIT[data])))
    for (a, b), doc in zip(zones, doc_of):
        held = int(taken[b] - taken[a])
        if held and free[b] - free[a] - held < LEAST_DIGITS and _free_digits(data, taken, a, b) < LEAST_DIGITS:
            continue
        low, high = int(offsets[doc]), int(offsets[doc + 1])
        for option in number_options(raw, a, b, low, high):
            if taken[option.end] == taken[option.start]:
                options.setdefault(doc, []).append(option)
    for match in _at_signs(raw):
        doc = int(np.searchsorted(offsets, match.start(), "right")) - 1
        high = int(offsets[doc + 1])
        if match.end() < high:
            for option in address_options(raw, match, int(offsets[doc]), high):
                if taken[option.end] == taken[option.start]:
                    options.setdefault(doc, []).append(option)
    for doc, some in options.items():
        more[doc] = best_spans(field, some)
    return base, more


def _free_digits(data: np.ndarray, taken: np.ndarray, a: int, b: int) -> int:
    """Digits of a zone outside the rules' spans."""
    return int((_DIGIT[data[a:b]] & (taken[a + 1 : b + 1] == taken[a:b])).sum())


SCHEMA = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, redacted string"


def find(
    df: DataFrame, key: str = "doc_id", text: str = "text", field: Field | None = None, redact: bool = True
) -> DataFrame:
    """Personal data of every row, by rule and by ``field`` (None: rules only).

    The rules, leftmost and without overlap for each kind, a failing match dropped without retry:
    email ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``; ip, four numbers joined by dots,
    each at most 255; card, 14 to 19 digits with single blanks or hyphens between them that pass the
    Luhn check; phone, a plus sign and 10 to 15 digits among ``().-`` and blanks. The field adds
    spans that touch none of theirs. Returns the key, the rules' counts n_email, n_ip, n_card and
    n_phone, base_sha256 (of their spans), spans (all, as kind:start:end in code points, end
    exclusive, by start, then kind) and redacted, the text with every span replaced by its kind in
    angle brackets (null unless ``redact``).

    A null or empty text has no spans. Repeated rows, and rows of equal or null keys, count each on
    its own; other columns are not read, whatever their names. An empty table gives an empty result.
    Memory grows with a chunk of 2 MB, or with the longest text if that is longer.
    """
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    kind = df.schema[key].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for first, end, offsets, data in chunks(batch):
            points = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
            base, more = find_spans(offsets, data, field)
            out: dict[str, list] = {n: [] for n in names}
            for doc, (fixed, added) in enumerate(zip(base, more)):
                zero = int(points[offsets[doc]])
                listed = [
                    ",".join(f"{KINDS[k]}:{points[a] - zero}:{points[b] - zero}" for a, b, k in spans)
                    for spans in (fixed, sorted(fixed + added, key=lambda s: (s[0], s[2])))
                ]
                for number, name in enumerate(KINDS):
                    out[f"n_{name}"].append(sum(k == number for _, _, k in fixed))
                out["base_sha256"].append(hashlib.sha256(listed[0].encode()).hexdigest())
                out["spans"].append(listed[1])
                body = data[offsets[doc] : offsets[doc + 1]].tobytes() if redact else None
                out["redacted"].append(_redacted(body, int(offsets[doc]), fixed + added) if redact else None)
            texts = names[4:]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(first, end - first),
                 *(pa.array(out[n], pa.string() if n in texts else pa.int64()) for n in names)],
                ["key", *names],
            )

    frame = df.select(df[key].alias("key"), df[text].cast("string").alias("text"))
    return by_batch(frame, run, f"key {kind}, {SCHEMA}").toDF(key if key not in names else "key", *names)


def _redacted(body: bytes, zero: int, spans: list[Span]) -> str:
    """Text with spans replaced; of overlapping ones the first names the place."""
    parts, at = [], 0
    for start, end, kind in sorted(spans, key=lambda s: (s[0], s[2])):
        start, end = start - zero, end - zero
        if start >= at:
            parts += [body[at:start], f"<{KINDS[kind]}>".encode()]
        at = max(at, end)
    return b"".join([*parts, body[at:]]).decode()


def op11_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document; the field is fitted to a sample of them."""
    documents = read(spark, sf_dir, "documents").select("doc_id", "text")
    return find(documents, field=train(documents), redact=False).drop("redacted")


QUERIES = {"op11_personal_data": (op11_personal_data, None)}
