"""Personal data by candidate gradient boosting.

Generators of high recall propose overlapping spans of four kinds. Spans of the fixed base
grammar are always redacted. The others are judged by boosted trees over format and context
features, with one threshold for each kind, calibrated on rows that the trees were not grown
from. As nothing marks what the base grammar misses, the trees learn from spans that it finds,
written in a text's own context as people disguise them (``disguised``), and from made-up ones and
look-alikes, such as dates, versions and order numbers, that are put between the words of texts
(``planted``), as many as are needed however few the texts are. A generator's proposal
is right if it is such a span, and wrong if it is another part of one, a look-alike, a disguised match that
failed its check, or by its form of no kind (``weak_negative``).
"""

from __future__ import annotations

import ipaddress
import random
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkspan.llm.common import bounded_sample, cut, discard, over_batches

KINDS = ("email", "ip", "card", "phone")
#: About so many rows are looked through for training, and at most so many candidates are learned from.
TRAIN_ROWS = 20_000
TRAIN_CANDIDATES = 20_000
#: Least share of valid spans among calibration candidates at or above a kind's threshold.
PRECISION = 0.95
#: Spans and look-alikes that are put into a text, and into all texts together at least.
PLANTED, LEAST_PLANTED = 4, 6_000

Span = tuple[str, int, int]

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: The wider generators. Their runs are bounded, so that a scan takes linear time. An email may begin within another proposal.
_WIDE = (
    ("email", re.compile(r"(?<![\w.%+-])(?=([\w.%+-]{1,64}\s?(?i:\[at\]|\(at\)|\{at\}|\bat\b|@)\s?[A-Za-z0-9-]{1,63}(?:\s?(?i:\[dot\]|\(dot\)|\{dot\}|\bdot\b|\.)\s?[A-Za-z0-9-]{2,63}){1,4}))")),
    ("ip", re.compile(r"(?<![0-9A-Fa-f:.])(?:[0-9]{1,4}(?:\s?(?i:\[\.\]|\(\.\)|\[dot\]|\(dot\)|\bdot\b|\.)\s?[0-9]{1,4}){3}|[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{0,4}){3,7})(?![0-9A-Fa-f:])")),
    ("card", re.compile(r"(?<![0-9])[0-9]{1,6}(?:[\x20./-]{0,3}[0-9]{1,6}){1,9}(?![0-9])")),
    ("phone", re.compile(r"(?<![0-9+])(?:(?:\+|00)\x20?)?\(?[0-9]{1,4}\)?(?:[\x20./-]{0,2}\(?[0-9]{1,4}\)?){2,6}(?![0-9])")),
)
_CUES = {
    "email": ("mail", "email", "e-mail", "contact", "write"), "ip": ("ip", "host", "address", "server", "from"),
    "card": ("card", "visa", "mastercard", "credit", "number", "account"), "phone": ("phone", "tel", "call", "mobile", "fax", "contact"),
}
#: What a text without any candidate lacks.
_MAYBE = re.compile(r"[0-9@]|(?i:\bdot\b|[\[({](?:at|dot)[\])}]|\bat\s[a-z0-9-]+\.[a-z]{2})")
_HIDDEN = re.compile(r"(?i:[\[({](?:at|dot|\.)[\])}]|\bdot\b)")
_AT = re.compile(r"(?i:\s?(?:[\[({]at[\])}]|\bat\b|@)\s?)")
_DOT = re.compile(r"(?i:\s?(?:[\[({]dot[\])}]|\bdot\b|\[\.\]|\(\.\)|\.)\s?)")
#: Whether what follows could be more of a number, or of an address.
_GOES_ON = (re.compile(r"[\x20./:-]{0,2}[0-9]"), re.compile(r"(?i:\s?(?:[\[({]dot[\])}]|\bdot\b)\s?[a-z0-9-]{2}|\.[a-z0-9-]{2})"))
_TOP_LEVEL = frozenset("com org net edu gov int info biz eu uk de fr es it nl be ch at pl se no dk fi pt us ca au jp cn in br ru io ai app dev me tv cc co".split())
_SPACED_DOT = re.compile(r"\.\s|\s\.")
_DATE = re.compile(r"(?:19|20)[0-9]{2}[./-][0-9]{1,2}[./-][0-9]{1,2}|[0-9]{1,2}[./-][0-9]{1,2}[./-](?:19|20)[0-9]{2}")


def luhn(digits: str) -> bool:
    doubled = sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (sum(map(int, digits[-1::-2])) + doubled) % 10 == 0


def valid(kind: str, text: str) -> bool:
    """Whether a match of the base grammar's shape is one of its spans."""
    digits = "".join(c for c in text if "0" <= c <= "9")
    if kind == "ip":
        return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in text.split("."))
    if kind == "card":
        return 14 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 10 <= len(digits) <= 15


def base_matches(text: str) -> Iterator[tuple[Span, bool]]:
    """Every leftmost match of the base grammar, and whether it is valid."""
    end = 0
    if "@" in text:
        for found in _DOMAIN.finditer(text):
            at = found.start()
            left = at
            while left > end and (text[left - 1].isascii() and (text[left - 1].isalnum() or text[left - 1] in "._%+-")):
                left -= 1
            if left < at:
                end = found.end()
                yield ("email", left, end), True
    for kind, pattern in (("ip", _IP), ("card", _CARD), ("phone", _PHONE)):
        for found in pattern.finditer(text):
            yield (kind, found.start(), found.end()), valid(kind, found[0])


def weak_negative(span: Span, text: str) -> bool:
    """Whether a proposal that no base span overlaps is a negative by its form.

    An email without a mark that hides a sign, if there is white space at a dot of it, or beside an '@'; colons that are no IPv6 address; a date, or too few or many digits for a phone.
    """
    kind, own = span[0], text[span[1] : span[2]]
    if kind == "email":
        # "at noon. This" is prose; "at example.org", without white space at its dots, may be an address
        return not _HIDDEN.search(own) and (bool(_SPACED_DOT.search(own)) or "@" in own and any(map(str.isspace, own)))
    if kind == "ip" and ":" in own:
        try:
            ipaddress.IPv6Address(own)
        except ValueError:
            return True
    if kind == "phone":
        return bool(_DATE.fullmatch(own.strip())) or not 7 <= sum("0" <= c <= "9" for c in own) <= 15
    return False


def ordered(spans: set[Span] | list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def disguise(kind: str, text: str, rng: random.Random) -> str:
    """A span of the base grammar's shape in a way of writing that the base grammar does not find."""
    digits = "".join(c for c in text if "0" <= c <= "9")
    groups = lambda *sizes: [digits[sum(sizes[:k]) : sum(sizes[: k + 1])] for k in range(len(sizes))] + [digits[sum(sizes) :]]
    if kind == "email":
        name, _, domain = text.rpartition("@")
        at, dot = rng.choice([(" [at] ", " [dot] "), ("(at)", "(dot)"), (" at ", " dot "), ("[at]", "."), (" (at) ", "."), (" at ", "."), ("@", " dot "), ("{at}", "{dot}")])
        raise_ = str.upper if rng.random() < 0.25 else str
        return name + raise_(at) + domain.replace(".", raise_(dot))
    if kind == "ip":
        if rng.random() < 0.25:
            parts = ["%x" % (int(p[-3:]) * 257) for p in text.split(".")]
            return ":".join([*parts, *(f"{rng.randrange(65536):x}" for _ in range(4))])
        return rng.choice(["[.]", "(.)", "[dot]", " dot ", " . "]).join(text.split("."))
    if kind == "card":
        return rng.choice([".", "/", " - ", "  "]).join(x for x in groups(4, 4, 4) if x)
    local = groups(max(len(digits) - 10, 0), *rng.choice([(3, 3), (3, 3), (2, 4), (2, 7), (4, 3)]))
    return rng.choice(["({1}) {2}-{3}", "{1}-{2}-{3}", "{1} {2} {3}", "00{0} {1} {2} {3}", "00{0} {1} {2}{3}", "{1}.{2}.{3}", "{0} ({1}) {2} {3}", "{0} ({1}) {2}{3}", "({1}) {2}{3}"]).format(*local).strip()


def spoilt(kind: str, text: str, rng: random.Random) -> str:
    """A match made invalid: a card's check digit, an address's part, a phone number's length, an email's sign."""
    if kind == "card":
        return text[:-1] + str((int(text[-1]) + rng.randint(1, 9)) % 10)
    if kind == "ip":
        parts = text.split(".")
        parts[rng.randrange(4)] = str(rng.randint(256, 999))
        return ".".join(parts) if rng.random() < 0.5 else ".".join([*parts, str(rng.randrange(100))])
    if kind == "phone":
        digits = "".join(c for c in text if "0" <= c <= "9")
        return rng.choice([digits[:7], digits + digits[:9]])
    return text.replace("@", " at ").replace(".", ". ").title()


def disguised(text: str, base: list[Span], failed: list[Span], rng: random.Random, spoil: float = 0.0) -> tuple[str, set[Span], set[Span]]:
    """The text with its base spans and failed matches disguised, and where these now are.

    A share ``spoil`` of the base spans is made invalid first, and then counts as failed.
    """
    out, places, end, size = [], (set(), set()), 0, 0
    covered = np.zeros(len(text) + 1, np.int8)
    for _, a, b in base:
        covered[a:b] = 1
    failed = [s for s in failed if not covered[s[1] : s[2]].any()]
    for kind, a, b, wrong in sorted([(*s, False) for s in base] + [(*s, True) for s in failed], key=lambda s: s[1:3]):
        if a < end:
            continue
        own = text[a:b]
        if not wrong and rng.random() < spoil:
            own, wrong = spoilt(kind, own, rng), True
            new = own if kind in ("email", "phone") else disguise(kind, own, rng)
        else:
            new = disguise(kind, own, rng)
        out += [text[end:a], new]
        size += a - end
        places[wrong].add((kind, size, size + len(new)))
        size, end = size + len(new), b
    return "".join([*out, text[end:]]), *places


_NAMES = "anna ben carla dieter elena felix greta hugo ines jonas karin luis maria nils olga paul rosa sven tina uwe".split()
_HOSTS = "mail post web shop haus data blue north river stone lumen acme corp example uni lab".split()


def made_up(kind: str, rng: random.Random) -> str:
    """A span of the base grammar's shape that passes its check."""
    number = lambda n: "".join(str(rng.randrange(10)) for _ in range(n))
    if kind == "email":
        name = rng.choice(["{0}", "{0}.{1}", "{0}_{2}", "{0}{2}", "{3}.{1}", "{0}-{1}"]).format(rng.choice(_NAMES), rng.choice(_NAMES), rng.randrange(100), rng.choice("abcdefgh"))
        return f"{name}@{rng.choice(_HOSTS)}{rng.choice(['', '-' + rng.choice(_HOSTS), '.' + rng.choice(_HOSTS)])}.{rng.choice(['com', 'org', 'net', 'de', 'fr', 'es', 'co.uk', 'io'])}"
    if kind == "ip":
        return ".".join(str(rng.randrange(rng.choice([256, 256, 10]))) for _ in range(4))
    if kind == "card":
        digits = rng.choice("3456") + number(rng.choice([13, 14, 14, 14, 15, 17]))
        return next(digits + str(k) for k in range(10) if luhn(digits + str(k)))
    return f"+{rng.randrange(1, 99)} {number(3)} {number(3)} {number(4)}"


def look_alike(kind: str, rng: random.Random) -> str:
    """What generators of the kind may propose but is no personal data: dates, times, versions, decimals, order numbers, prose."""
    n = lambda a, b: rng.randrange(a, b)
    number = lambda k: "".join(str(rng.randrange(10)) for _ in range(k))
    year, word = n(1950, 2035), lambda: rng.choice([*_NAMES, *_HOSTS])
    if kind == "email":
        return rng.choice([f"{word()} at {word()}. {word().title()}", f"look at {word()} dot {word()} dot dot", f"the dot at {word()}", f"@{word()} at {word()}", f"{word()} at {n(1, 12)}.{n(10, 60)}", f"a dot on {word()} dot"])
    if kind == "ip":
        return rng.choice([
            f"{n(0, 24)}:{n(10, 60)}:{n(10, 60)}:{n(10, 60)}", f"{n(1, 9)}.{n(0, 9)}.{n(0, 9)} . {n(1, 9)}", f"{n(1, 29)} . {n(1, 13)} . {year} . {n(1, 9)}", f"{n(256, 999)} . {n(0, 256)} . {n(0, 256)} . {n(0, 256)}",
            ":".join(f"{n(0, 256):02x}" for _ in range(6)), f"{n(1, 9)}:{n(1, 9)}:{n(1, 9)}:{n(1, 9)}", f"{n(1, 9)} dot {n(1, 99)}", f"{n(300, 9999)}[.]{n(0, 99)}[.]{n(0, 99)}[.]{n(0, 99)}",
        ])
    if kind == "card":
        digits = number(n(13, 19))
        if luhn(digits):
            digits = digits[:-1] + str((int(digits[-1]) + 1) % 10)
        return rng.choice([f"{digits[:4]}.{digits[4:8]}.{digits[8:12]}.{digits[12:]}", f"{digits[:4]}/{digits[4:8]}/{digits[8:]}", f"{year}{n(10, 13)}{n(10, 29)}{number(6)}", f"{n(0, 9)}.{digits}", f"{digits[:4]} - {digits[4:8]} - {digits[8:12]} - {digits[12:]}", " ".join(str(year + k) for k in range(4))])
    return rng.choice([
        f"{year}-{n(10, 13)}-{n(10, 29)}-{number(4)}", f"{n(0, 99)}.{number(5)}.{number(5)}", f"{n(0, 99)}.{number(n(5, 11))}", f"978-{n(0, 9)}-{number(2)}-{number(6)}-{n(0, 9)}", f"{year}/{n(10, 13)}/{number(6)}", f"{n(0, 24)}:{n(10, 60)}-{n(0, 24)}:{n(10, 60)}",
        f"{year}-{year + n(1, 9)}", " ".join(str(year + k) for k in range(n(2, 5))), f"{n(1, 999)} {number(3)} {number(3)}", f"{n(1, 99)}.{number(3)}.{number(3)}", f"{n(1, 22)}-{n(1, 22)} {n(1, 22)}-{n(1, 22)} {n(1, 22)}-{n(1, 22)}", f"{n(1, 99)}.{n(0, 99)}.{n(0, 99)}.{number(4)}",
        f"{n(10, 29)}.{n(10, 13)}.{year} {n(0, 24)}.{n(10, 60)}", f"{number(4)}-{number(4)}-{number(4)}", f"{year}{n(10, 13)}{n(10, 29)}-{number(4)}", f"{n(1, 99)} {n(1, 99)} {n(1, 99)} {n(1, 99)}",
    ])


def planted(text: str, rng: random.Random, n: int) -> tuple[str, set[Span], list[tuple[str, int, int]]]:
    """The text's words with ``n`` disguised made-up spans and look-alikes between them, half of them behind a word that points to one; where both are."""
    words = text.split(" ")[:400]
    gaps = sorted(rng.randrange(len(words) + 1) for _ in range(n))
    out, size, right, wrong = [], 0, set(), []

    def put(piece: str) -> int:
        nonlocal size
        out.append(piece)
        size += len(piece)
        return size

    before = 0
    for gap in gaps:
        put("".join(f"{w} " for w in words[before:gap]))
        before = gap
        kind, good = rng.choice(KINDS), rng.random() < 0.5
        own = disguise(kind, made_up(kind, rng), rng) if good else look_alike(kind, rng)
        cue = rng.choice([*_CUES[kind], "on", "version", "order", "see", "at", "and"]) if rng.random() < 0.5 else ""
        start = put(f"{cue}{rng.choice([': ', ' '])}" if cue else "")
        end = put(own)
        (right.add if good else wrong.append)((kind, start, end))
        put(rng.choice([" ", " ", ". ", ", ", ") "]))
    put(" ".join(words[before:]))
    return "".join(out), right, wrong


def examples(text: str, rng: random.Random, plants: int = PLANTED) -> list[tuple[int, list[float]]]:
    """(right or wrong, features) of the candidates that a text teaches."""
    base, failed, wide = candidates(text)
    found = [(1, features(text, s)) for s in base] + [(0, features(text, s)) for s in failed]
    found += [(0, features(text, s)) for s in wide if weak_negative(s, text)]
    for spoil in (0.0, 0.5, 1.0) if base or failed else ():
        other, right, wrong = disguised(text, base, failed, rng, spoil)
        touched = np.zeros((2, len(KINDS), len(other) + 1), np.int8)
        for k, spans in enumerate((right, wrong)):
            for kind, a, b in spans:
                touched[k, KINDS.index(kind), a:b] = 1
        for span in candidates(other)[2]:
            part = touched[:, :, span[1] : span[2]]
            if span in right:
                found.append((1, features(other, span)))
            elif part.any() or weak_negative(span, other):
                found.append((0, features(other, span)))
    while plants > 0:
        # a long text takes them all, a short one some at a time
        other, right, wrong = planted(text, rng, min(plants, 8))
        plants -= 8
        touched = np.zeros(len(other) + 1, np.int8)
        for _, a, b in [*right, *wrong]:
            touched[a:b] = 1
        for span in candidates(other)[2]:
            if span in right:
                found.append((1, features(other, span)))
            elif touched[span[1] : span[2]].any():
                found.append((0, features(other, span)))
    return found


def proposed(text: str) -> Iterator[Span]:
    """What the wider generators propose; an email also without the last parts of its domain."""
    for kind, pattern in _WIDE:
        for found in pattern.finditer(text):
            if kind != "email":
                yield kind, found.start(), found.end()
                continue
            own = found[1]
            yield kind, found.start(), found.start() + len(own)
            dots = [m.start() for m in _DOT.finditer(own, _AT.search(own).end())]
            for end in dots[1:]:
                yield kind, found.start(), found.start() + end


def candidates(text: str | None) -> tuple[list[Span], list[Span], list[Span]]:
    """The base spans, the failed base matches, and the other spans that generators propose."""
    if not text or not _MAYBE.search(text):
        return [], [], []
    base: list[Span] = []
    failed: list[Span] = []
    for span, ok in base_matches(text):
        (base if ok else failed).append(span)
    taken = {*base, *failed}
    wide = set(proposed(text)) - taken
    covered = np.zeros(len(text) + 1, np.int8)
    for _, a, b in base:
        covered[a:b] = 1
    return ordered(base), ordered(failed), ordered([s for s in wide if not covered[s[1] : s[2]].any()])


def features(text: str, span: Span) -> list[float]:
    """Format and context of a candidate."""
    kind, a, b = span
    raw = own = text[a:b]
    if kind == "email":
        own = _DOT.sub(".", _AT.sub("@", own))
    elif kind == "ip":
        own = _DOT.sub(".", own)
    last = re.split(r"[.\s]+", own)[-1]
    digits = "".join(c for c in own if "0" <= c <= "9")
    groups = [len(g) for g in re.findall("[0-9]+", own)] or [0]
    before, after = text[max(a - 40, 0) : a], text[b : b + 40]
    words = re.findall(r"\w[\w-]*", before.lower())[-4:]
    parts = [int(g[-9:]) for g in re.findall("[0-9]+", own)[:8]] or [0]
    return [
        float(KINDS.index(kind)), float(len(own)), float(len(digits)), float(len(groups)), float(max(groups)), float(min(groups)), float(groups[-1]), float(max(parts)),
        *(float(own.count(c)) for c in " -.()/:@"), float(own.startswith("+")), float(own.startswith("00")), float(bool(digits) and luhn(digits)),
        float(sum(map(str.isalpha, own))), float(own.count("@") == 1 and "." in own.rpartition("@")[2]), float(any(w in _CUES[kind] for w in words)), float(bool(before) and before[-1].isalnum()),
        float(bool(after) and after[0].isalnum()), float(bool(re.search(r"[A-Za-z0-9][^\sA-Za-z0-9]?\s?$", before)) and before[-1:] in "$€#%="), float(len(set(digits)) if digits else 0),
        float(bool(_HIDDEN.search(raw))), float(sum(map(str.isspace, raw))), float(len(last)), float(last.islower()), float(raw.count("@")), float(len(re.findall(r"[A-Z]", raw))),
        float(bool(_GOES_ON[kind == "email"].match(after))), float(kind == "email" and last.lower() in _TOP_LEVEL), float(kind == "email" and bool(re.search(r"(?i)[\[({]at[\])}]", raw))),
        float(":" in own and not weak_negative(span, text)), float(max((len(g) for g in re.findall(r"[A-Fa-f]+", own)), default=0)), float(before[-1:] == "+" or before[-1:] == "."),
    ]


@dataclass
class Trees:
    """Boosted regression trees of depth 2 for the logistic loss, on features cut into quantile bins."""

    rounds: int = 60
    rate: float = 0.3
    start: float = 0.0
    grown: list[tuple[tuple[int, float], ...]] = field(default_factory=list)  # (root, left, right) splits
    leaves: list[np.ndarray] = field(default_factory=list)

    @staticmethod
    def _split(x: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[int, float]:
        best, out = 1e-9, (0, np.inf)
        for f in range(x.shape[1]):
            for edge in np.unique(np.quantile(x[:, f], np.linspace(0, 1, 17)[1:-1])) if len(x) else ():
                low = x[:, f] <= edge
                gl, hl, gr, hr = g[low].sum(), h[low].sum(), g[~low].sum(), h[~low].sum()
                gain = gl * gl / (hl + 1) + gr * gr / (hr + 1) - (gl + gr) ** 2 / (hl + hr + 1)
                if gain > best:
                    best, out = gain, (f, float(edge))
        return out

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        rate = min(max(float(y.mean()), 1e-3), 1 - 1e-3)
        self.start = float(np.log(rate / (1 - rate)))
        total = np.full(len(y), self.start)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-total))
            g, h = y - p, p * (1 - p)
            if abs(g).max() < 0.01:
                break
            root = self._split(x, g, h)
            low = x[:, root[0]] <= root[1]
            splits = (root, self._split(x[low], g[low], h[low]), self._split(x[~low], g[~low], h[~low]))
            leaf = self._leaf(splits, x)
            values = self.rate * np.bincount(leaf, g, 4) / (np.bincount(leaf, h, 4) + 1)
            self.grown.append(splits)
            self.leaves.append(values)
            total += values[leaf]
        return self

    @staticmethod
    def _leaf(splits: tuple[tuple[int, float], ...], x: np.ndarray) -> np.ndarray:
        right = x[:, splits[0][0]] > splits[0][1]
        below = np.where(right, x[:, splits[2][0]] > splits[2][1], x[:, splits[1][0]] > splits[1][1])
        return 2 * right + below

    def scores(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.start)
        for splits, values in zip(self.grown, self.leaves):
            total += values[self._leaf(splits, x)]
        return 1 / (1 + np.exp(-total))


@dataclass
class Model:
    trees: dict[str, Trees] = field(default_factory=dict)
    thresholds: dict[str, float] = field(default_factory=dict)  # a kind without one adds nothing

    def added(self, text: str, wide: list[Span]) -> list[tuple[Span, float]]:
        """The proposed spans that score enough; of overlapping ones the best."""
        wide = [s for s in wide if s[0] in self.thresholds]
        if not wide:
            return []
        scores = np.zeros(len(wide))
        for kind in {s[0] for s in wide}:
            own = [k for k, s in enumerate(wide) if s[0] == kind]
            scores[own] = self.trees[kind].scores(np.array([features(text, wide[k]) for k in own]))
        picked: list[tuple[Span, float]] = []
        used = np.zeros(len(text), np.int8)
        for k in sorted(range(len(wide)), key=lambda k: (-scores[k], wide[k][1], wide[k][2])):
            kind, a, b = wide[k]
            if scores[k] >= self.thresholds[kind] and not used[a:b].any():
                used[a:b] = 1
                picked.append((wide[k], float(scores[k])))
        return sorted(picked, key=lambda x: (x[0][1], KINDS.index(x[0][0])))


def train(docs: DataFrame, rows: int = TRAIN_ROWS, most: int = TRAIN_CANDIDATES) -> Model:
    """Grow trees on the ``examples`` of about ``rows`` texts, at most about ``most`` of them.

    Null ids and texts teach nothing, repeated rows teach once. The fewer texts there are, the more is planted in
    each, so that a small table teaches as a large one does; without any the model adds nothing, nor does a
    kind for which no threshold reaches the wanted precision.
    """
    texts = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sample = bounded_sample(texts, rows)
    plants = max(PLANTED, -(-LEAST_PLANTED // max(sample.count(), 1)))

    def collect(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: list[tuple[int, int, bytes]] = []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            out += [(doc_id, y, np.array(x, "<f4").tobytes()) for y, x in examples(text, random.Random(doc_id), plants)]
        return pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate((pa.int64(), pa.int32(), pa.binary()))], names=["doc_id", "y", "x"])

    # examples of one text are dealt over both folds: a small table has few texts
    found = cut(over_batches(sample, collect, "doc_id long, y int, x binary"), "pii-examples")
    share = min(1.0, most / max(found.count(), 1))
    drawn = F.pmod(F.xxhash64("doc_id", "x", F.lit(7)), F.lit(2**40)) < int(2**40 * share)
    picked = found.where(drawn).select("y", "x", F.pmod(F.xxhash64("doc_id", "x"), F.lit(3)).alias("fold")).orderBy("x", "y").collect()
    discard(found)
    model = Model()
    if len({r.y for r in picked}) < 2:
        return model
    x = np.frombuffer(b"".join(r.x for r in picked), "<f4").reshape(len(picked), -1).astype(float)
    y, fold = np.array([r.y for r in picked], float), np.array([r.fold for r in picked])
    for k, kind in enumerate(KINDS):
        grow, own = (fold != 1) & (x[:, 0] == k), (fold == 1) & (x[:, 0] == k)
        if not 0 < y[grow].sum() < grow.sum() or not 0 < y[own].sum() < own.sum():
            continue
        trees = Trees().fit(x[grow], y[grow])
        scores = trees.scores(x[own])
        order = np.argsort(-scores)
        share = np.cumsum(y[own][order]) / np.arange(1, own.sum() + 1)
        last = np.append(np.diff(scores[order]) < 0, True)  # equal scores pass a threshold together
        good = np.flatnonzero((share >= PRECISION) & last)
        if len(good):
            model.trees[kind], model.thresholds[kind] = trees, max(float(scores[order][good[-1]]), 0.5)
    return model


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])


def detect(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, base, added): spans in code points, end exclusive, by start and then kind.

    A null or empty text has none. Repeated rows are each scanned; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        m, base_out, added_out = shared.value, [], []
        for text in batch.column(1).to_pylist():
            base, _, wide = candidates(text)
            base_out.append([dict(zip(("kind", "start", "end"), s)) for s in base])
            added_out.append([dict(zip(("kind", "start", "end"), s)) for s, _ in m.added(text, wide)] if wide else [])
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(base_out, pa.list_(_SPAN)), pa.array(added_out, pa.list_(_SPAN))], names=["doc_id", "base", "added"])

    span = "array<struct<kind: string, start: int, end: int>>"
    return over_batches(docs.select(F.col("doc_id").cast("long"), "text"), run, f"doc_id long, base {span}, added {span}")


def redact(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs``, all columns, with every span of ``text`` replaced by its kind in brackets.

    Of overlapping spans the part that no earlier one covers goes too. Null and empty texts stay
    as they are, repeated rows are each redacted, an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def cleaned(text: str | None) -> str | None:
        base, _, wide = candidates(text)
        if not base and not wide:
            return text
        spans = ordered([*base, *(s for s, _ in shared.value.added(text, wide))])
        out, end = [], 0
        for kind, a, b in spans:
            if a >= end:
                out += [text[end:a], f"[{kind.upper()}]"]
            end = max(end, b)
        return "".join([*out, text[end:]])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = pa.array(map(cleaned, batch.column(at).to_pylist()), batch.schema.field(at).type)
        return batch.set_column(at, batch.schema.field(at), texts)

    return over_batches(docs, run, docs.schema)


def _is(kind: str) -> Callable[[Column], Column]:
    return lambda span: span["kind"] == kind


def digest_rows(docs: DataFrame, model: Model) -> DataFrame:
    """The contract's columns: counts and digest of the base spans, and all spans.

    A null or empty text has no spans; repeated rows are each scanned, an empty table gives an
    empty result, and columns beyond doc_id and text are ignored.
    """
    found = detect(docs, model)
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    rank = lambda s: F.struct(s["start"].alias("start"), F.array_position(F.array(*map(F.lit, KINDS)), s["kind"]).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"))
    counts = [F.size(F.filter("base", _is(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    everything = F.array_sort(F.transform(F.concat("base", "added"), rank))
    return found.select("doc_id", *counts, F.sha2(joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), joined(everything).alias("spans"))
