"""Personal data: base rules, and beyond them spans that generators propose, boosted trees score by form and context, and calibrated thresholds select."""

from __future__ import annotations

import bisect
import math
import random
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .boosting import Boosted
from .common import read_table, ship

#: In the order in which spans are listed.
BASE = ("email", "ip", "card", "phone")
ADDED = ("likely_email", "likely_ip", "likely_card", "likely_phone", "likely_id")
KINDS = BASE + ADDED
#: A kind's threshold is the least probability from which at least this share of the spans of the calibration rows is right.
PRECISION = 0.99
#: Texts that the trees are learned on, written by examples; every third sets the probabilities and thresholds.
EXAMPLES = 6_000
#: Characters before and after a span that its context is read from.
NEAR = 48
_SPANS = "array<struct<kind:string,start:int,end:int,score:double>>"

# ---- base rules

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DIGITS = re.compile(r"[0-9]+")
_IP = re.compile(r"([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(map(int, reversed(digits))):
        d *= 1 + k % 2
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _byte(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and part <= "255"


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind and start. Leftmost and non-overlapping per kind; each character is looked at a bounded number of times."""
    out, done = [], 0
    for m in _DOMAIN.finditer(text) if "@" in text else ():
        # the match begins where the run before the @ does, or where the match before ended
        s = m.start()
        while s > done and text[s - 1] in _LOCAL:
            s -= 1
        if s < m.start():
            out.append(("email", s, m.end()))
            done = m.end()
    done = 0
    for run in _DIGITS.finditer(text):
        if run.start() >= done and (m := _IP.match(text, run.start())):
            done = m.end()
            if all(map(_byte, m.groups())):
                out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if 16 <= m.end() - m.start() <= 37:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
    for m in _PHONE.finditer(text):
        if 8 <= sum(map(str.isdigit, m[0])) <= 15:
            out.append(("phone", *m.span()))
    return out


# ---- generators

_AT = re.compile(r"\x20?[(\[{<]\x20?(?:at|@)\x20?[)\]}>]\x20?|\x20at\x20|\x20?@\x20?", re.I)
_HOST = re.compile(r"[A-Za-z0-9-]{1,63}(?:(?:\x20?[(\[{<]\x20?(?:dot|\.)\x20?[)\]}>]\x20?|\x20dot\x20|\x20?\.\x20?)[A-Za-z0-9-]{1,63}){1,4}", re.I)
_LABEL = re.compile(r"\x20?[(\[{<]\x20?(?:dot|\.)\x20?[)\]}>]\x20?|\x20dot\x20|\x20?\.\x20?", re.I)
_NUMBER = re.compile(r"[+(]{0,2}[0-9](?:[\x20().\-/]{0,2}[0-9]){6,29}")
_PIECE = re.compile(r"[+(]{0,2}[0-9](?:[().\-/]{0,2}[0-9]){6,18}")
_COLONS = re.compile(r"[0-9A-Fa-f]{0,4}(?:(?::[0-9A-Fa-f]{0,4}){3,7}|(?:-[0-9A-Fa-f]{2}){5})")
_ACCOUNT = re.compile(r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?")


def proposed(text: str) -> Iterator[tuple[str, int, int]]:
    """(generator, start, end) of all that may be personal, overlapping: what the thresholds leave of it comes later."""
    for m in _AT.finditer(text):
        host = _HOST.match(text, m.end())
        if not host or m[0].strip() == "at" and not re.search(r"\S\.\S|dot", host[0], re.I):
            continue
        s, low = m.start(), max(0, m.start() - 64)
        while s > low and text[s - 1] in _LOCAL:
            s -= 1
        if s < m.start():
            ends = [x.start() for x in _LABEL.finditer(text, host.start(), host.end())][1:]
            for e in [*ends, host.end()]:  # with two labels, three and so on
                yield "email", s, e
    if not _DIGITS.search(text):
        return
    for m in _NUMBER.finditer(text):
        if m.start() and text[m.start() - 1].isdigit():
            continue
        yield "number", *m.span()
        if " " in m[0]:
            for x in _PIECE.finditer(text, m.start(), m.end()):
                if x.span() != m.span():
                    yield "number", *x.span()
    for m in _COLONS.finditer(text) if ":" in text or "-" in text else ():
        s, e = m.span()
        if e - s > 5 and not (s and (text[s - 1].isalnum() or text[s - 1] in ":-")) and not text[e : e + 1].isalnum():
            yield "colons", s, e
    for m in _ACCOUNT.finditer(text):
        if not (m.start() and text[m.start() - 1].isalnum()) and not text[m.end() : m.end() + 1].isalnum():
            yield "account", *m.span()


# ---- form and context

# Words, in the corpus's languages, near which numbers are one thing or another.
CUES = {
    "phone": ("phone", "tel", "telephone", "call", "mobile", "cell", "fax", "whatsapp", "text me", "telefon", "anrufen", "handy", "appelez", "portable", "teléfono", "llame", "llamar", "móvil"),
    "email": ("email", "e-mail", "mail", "contact", "write to", "reach me", "courriel", "correo", "schreib"),
    "card": ("card", "visa", "mastercard", "amex", "credit", "debit", "karte", "carte", "tarjeta"),
    "id": ("ssn", "social security", "passport", "iban", "account", "konto", "compte", "cuenta", "taxpayer", "driver"),
    "ip": ("ip", "address", "host", "device", "mac", "client", "logged in", "adresse", "dirección"),
    "not": ("order", "invoice", "isbn", "issn", "version", "page", "total", "price", "model", "serial", "ref", "item", "batch", "doi", "ticket", "case", "article", "rechnung", "facture", "pedido", "date", "since", "index", "id", "pp", "vol", "row"),
}
_CUE = {k: re.compile("|".join(rf"(?<![^\W_]){re.escape(w)}(?![^\W_])" for w in v)) for k, v in CUES.items()}
_DATE = re.compile(r"(?:19|20)\d\d([-./ ])(?:0?[1-9]|1[0-2])\1(?:0?[1-9]|[12]\d|3[01])(?!\d)|(?:0?[1-9]|[12]\d|3[01])([-./ ])(?:0?[1-9]|1[0-2])\2(?:19|20)\d\d(?!\d)|(?:19|20)\d{6}(?!\d)")
_TOP = re.compile(r"(?:com|net|org|edu|gov|info|io|eu|de|fr|es|uk|us|co|ch|at|it|nl)$", re.I)
_GENERATORS = ("email", "number", "colons", "account")


def _side(c: str) -> int:
    return 0 if not c or c.isspace() else 1 if c.isalpha() else 2 if c.isdigit() else 3 if c in ".," else 4 if c in "#$€£%" else 5 if c in "_/=&" else 6


def _mod97(s: str) -> bool:
    s = s.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def describe(text: str, generator: str, s: int, e: int) -> list[float]:
    """A span's features: of its own form, and of NEAR characters around it."""
    x = text[s:e]
    digits = "".join(c for c in x if "0" <= c <= "9")
    groups = [len(g) for g in _DIGITS.findall(x)] or [0]
    n = len(digits)
    left, right = text[max(0, s - NEAR) : s].lower(), text[e : e + NEAR].lower()
    cues = []
    for pattern in _CUE.values():
        last = None
        for last in pattern.finditer(left):  # the nearest is the last
            pass
        cues += [len(left) - last.end() if last else 2 * NEAR, float(bool(pattern.search(right[:24])))]
    near = left[-24:] + right[:24]
    same = max((len(m[0]) for m in re.finditer(r"(.)\1*", digits)), default=0)
    up = sum(b == a + 1 for a, b in zip(map(int, digits), map(int, digits[1:]))) if n < 40 else 0
    card = 13 <= n <= 19 and luhn(digits)
    out = [float(generator == k) for k in _GENERATORS]
    out += [len(x), n, len(set(digits)), same, up, *(x.count(c) for c in " -./():@"), sum(map(str.isalpha, x)), sum(map(str.isupper, x))]
    out += [x[:1] == "+", x[:1] == "(", digits[:2] == "00", digits[:1] == "0", len(groups), groups[0], groups[1] if len(groups) > 1 else 0, groups[-1], max(groups), min(groups)]
    out += [card, card and (digits[0] in "456" or digits[:2] in ("34", "37", "30", "36", "38")), bool(_DATE.match(x)), n == 13 and digits[:3] in ("978", "979")]
    out += [groups == [3, 2, 4] and x.count("-") == 2 and digits[:3] not in ("000", "666") and digits[0] != "9", generator == "account" and _mod97(x)]
    colons = re.split(r"[:-]", x) if generator == "colons" else []
    out += [len(colons), "::" in x, len(colons) == 6 and all(len(c) == 2 for c in colons), max(map(len, colons), default=0), sum(len(c) > 2 for c in colons)]
    more = re.match(r"[A-Za-z0-9]+", text[label.end() : label.end() + 12]) if generator == "email" and (label := _LABEL.match(text, e)) else None
    out += [bool(_TOP.search(x)), x.lower().count("dot"), bool(re.search(r"[(\[{<]", x)), x.count("\n"), bool(more), bool(more and _TOP.fullmatch(more[0]))]
    out += [_side(text[s - 1 : s]), _side(text[e : e + 1]), sum(map(str.isdigit, near)) / max(1, len(near)), *cues]
    return out


def kind_of(text: str, generator: str, s: int, e: int) -> str:
    if generator != "number":
        return {"email": "likely_email", "colons": "likely_ip", "account": "likely_id"}[generator]
    x = text[s:e]
    digits = re.sub(r"[^0-9]", "", x)
    if 13 <= len(digits) <= 19 and luhn(digits):
        return "likely_card"
    return "likely_id" if [len(g) for g in _DIGITS.findall(x)] == [3, 2, 4] else "likely_phone"


# ---- labelled rows


def _digits(r: random.Random, n: int) -> str:
    return "".join(r.choice("0123456789") for _ in range(n))


def _with_check(body: str) -> str:
    return next(body + c for c in "0123456789" if luhn(body + c))


def _iban(r: random.Random) -> str:
    country, body = r.choice(("DE", "FR", "ES", "GB", "NL")), _digits(r, r.choice((16, 18, 20)))
    rest = int("".join(str(int(c, 36)) for c in body + country) + "00") % 97
    whole = f"{country}{98 - rest:02d}{body}"
    return " ".join(whole[i : i + 4] for i in range(0, len(whole), 4)) if r.random() < 0.5 else whole


def _word(r: random.Random, low: int = 2, high: int = 9) -> str:
    return "".join(r.choice("etaoinshrdlucmfwypvbgkjqxzäéñ" if r.random() < 0.1 else "etaoinshrdlucm") for _ in range(r.randint(low, high)))


def _personal(r: random.Random) -> tuple[str, str, float]:
    """A value, the cue it goes with, and how likely a cue stands by it: what has no form of its own is personal only by its cue."""
    plain = lambda n: "".join(r.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(n))
    pick = r.randrange(11)
    if pick < 3:
        local = plain(r.randint(2, 10)) + r.choice(("", "." + plain(4), "_" + plain(3)))
        at = r.choice((" (at) ", "(at)", " [at] ", "[at]", " at ", " @ ", "{at}", " AT "))
        dot = r.choice((" dot ", "(dot)", " [dot] ", "[dot]", ".", " . ")) if at not in (" at ", " AT ") else r.choice((" dot ", "[dot]", "(dot)"))
        if dot == "." and at == " @ ":
            dot = r.choice((".", " . "))
        return local + at + plain(r.randint(3, 9)) + dot + r.choice(("com", "net", "org", "de", "fr", "es", "co.uk", "io")), "email", 0.6
    if pick < 6:
        a, b, c = str(r.randint(200, 999)), str(r.randint(200, 999)), _digits(r, 4)
        form = r.choice((f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"({a}) {b} {c}", f"1-{a}-{b}-{c}"))
        loose = r.choice((f"{a} {b} {c}", f"0{_digits(r, 3)} {_digits(r, 7)}", f"0{_digits(r, 2)}/{_digits(r, 8)}", f"00{r.randint(1, 99)} {_digits(r, 3)} {_digits(r, 6)}", " ".join(["0" + _digits(r, 1)] + [_digits(r, 2) for _ in range(4)]), a + b + c))
        return (form, "phone", 0.6) if r.random() < 0.6 else (loose, "phone", 1.0)
    if pick == 6:
        whole = _with_check(r.choice(("34", "37")) + _digits(r, 12)) if r.random() < 0.6 else _with_check("4" + _digits(r, 11))
        return (f"{whole[:4]} {whole[4:10]} {whole[10:]}" if len(whole) == 15 and r.random() < 0.5 else whole), "card", 1.0
    if pick == 7:
        return f"{r.randint(1, 665):03d}-{r.randint(1, 99):02d}-{r.randint(1, 9999):04d}", "id", 0.8
    if pick == 8:
        return _iban(r), "id", 0.6
    hexes = lambda n: "".join(r.choice("0123456789abcdef") for _ in range(n))
    if pick == 9:
        sep = r.choice(":-")
        value = sep.join(hexes(2) for _ in range(6))
    else:
        value = ":".join(hexes(r.randint(1, 4)) for _ in range(8)) if r.random() < 0.5 else f"{hexes(4)}:{hexes(3)}::{hexes(r.randint(1, 4))}:{hexes(r.randint(1, 4))}"
    return (value.upper() if r.random() < 0.3 else value), "ip", 0.6


def _other(r: random.Random) -> str:
    """A value that looks like one but isn't: dates, counts, references, ranges, numbers that fail their check."""
    d, pick = lambda n: _digits(r, n), r.randrange(20)
    if pick == 0:
        return r.choice((f"{r.randint(1900, 2099)}-{r.randint(1, 12):02d}-{r.randint(1, 28):02d}", f"{r.randint(1, 28):02d}.{r.randint(1, 12):02d}.{r.randint(1900, 2099)}", f"{r.randint(1, 28):02d}/{r.randint(1, 12):02d}/{r.randint(1900, 2099)}", f"{r.randint(1900, 2099)}-{r.randint(1900, 2099)}"))
    if pick == 1:
        return f"{d(2)}:{d(2)}:{d(2)}:{d(2)}" if r.random() < 0.3 else f"{r.randint(2000, 2030)}-{r.randint(1, 12):02d}-{r.randint(1, 28):02d} {r.randint(0, 23):02d}:{d(2)}"
    if pick in (2, 3, 4):
        return d(r.randint(7, 15))
    if pick in (5, 6, 7):
        whole = d(r.choice((13, 15, 16, 16, 16, 17, 18, 19)))
        return whole if not luhn(whole) else whole[:-1] + str((int(whole[-1]) + 1) % 10)
    if pick == 8:
        return "978" + r.choice(("", "-")) + d(1) + r.choice(("", "-")) + d(9)
    if pick == 9:
        return f"{r.randint(0, 99)}.{d(r.randint(6, 12))}"
    if pick == 10:
        return ".".join(d(r.randint(1, 3)) for _ in range(r.choice((3, 5, 6)))) + "." + d(2)
    if pick == 11:
        return " ".join(d(r.randint(1, 5)) for _ in range(r.randint(3, 9)))
    if pick == 12:
        return f"{d(3)}-{d(2)}-{d(4)}-{d(3)}" if r.random() < 0.5 else f"{d(4)}-{d(4)}-{d(3)}"
    if pick == 13:
        return r.choice(("", "$", "€")) + ".".join([d(r.randint(1, 3)), *(d(3) for _ in range(r.randint(2, 3)))])
    if pick == 14:
        return "/".join(d(r.randint(2, 4)) for _ in range(r.randint(3, 5)))
    if pick == 15:
        return f"{_word(r)} at {_word(r)}.{_word(r)}"
    if pick == 16:
        return r.choice("ABCDEFGHKLMN") + r.choice("ABCDEFGHKLMN") + d(r.choice((10, 12, 14)))
    if pick == 17:
        return r.choice((f"{_word(r)} @ {_word(r)}", f"@{_word(r)}", f"{_word(r)}(at){_word(r)}", f"{_word(r)} @ {_word(r)} . {_word(r)}", f"{_word(r)} at {_word(r)} dot")) + " " + _word(r)
    if pick == 18:
        return "-".join(d(r.randint(1, 4)) for _ in range(r.randint(4, 8)))
    return f"{d(4)} {d(4)} {d(r.randint(1, 4))}"


def examples(n: int = EXAMPLES, seed: int = 0) -> Iterator[tuple[str, list[tuple[int, int]]]]:
    """n short texts of invented words around a value, with the personal spans of each: half of the values are personal. Cues stand by either, those of other things by what isn't."""
    r = random.Random(seed)
    every = [w for k, v in CUES.items() for w in v if k != "not"]
    for _ in range(n):
        words = [_word(r) for _ in range(r.randint(0, 12))]
        after = [_word(r) for _ in range(r.randint(0, 8))]
        if yes := r.random() < 0.5:
            value, cue, often = _personal(r)
            if r.random() < often:
                words += [r.choice(CUES[cue])] + [_word(r, 1, 4)] * (r.random() < 0.3)
        else:
            value = _other(r)
            if (x := r.random()) < 0.45:
                words += [r.choice(CUES["not"])]
            elif x < 0.5:
                words.insert(0, r.choice(every))  # a cue far off tells nothing
        mark = r.choice((" ", " ", " ", ": ", ":", " #" if not yes else " ", "\n"))
        ends = r.choice((" ", " ", ". ", ", ", "\n", "", "### ", "; "))
        head = " ".join(words) + mark if words else ""
        yield head + value + ends + " ".join(after), [(len(head), len(head) + len(value))] if yes else []


class Finder:
    """The trees and a threshold for each kind that is added."""

    def __init__(self, model: Boosted, thresholds: dict[str, float]):
        self.model, self.thresholds = model, thresholds

    def added(self, text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int, float]]:
        """Of the proposed spans that reach their kind's threshold, the likeliest, then longest, then first, each apart from base spans and from those chosen before."""
        some = sorted(set(proposed(text)))
        taken = _Taken([(s, e) for _, s, e in base])
        some = [x for x in some if taken.free(*x[1:])]
        if not some:
            return []
        p = np.concatenate([self.model.probability(np.array([describe(text, *x) for x in some[i : i + 4096]], np.float64)) for i in range(0, len(some), 4096)])
        good = [(k, s, e, float(q)) for (g, s, e), q in zip(some, p, strict=True) if q >= self.thresholds[k := kind_of(text, g, s, e)]]
        out = []
        for k, s, e, q in sorted(good, key=lambda x: (-x[3], x[1] - x[2], x[1], x[0])):
            if taken.free(s, e):
                taken.add(s, e)
                out.append((k, s, e, q))
        return out

    def find(self, text: str | None) -> list[tuple[str, int, int, float]]:
        """All spans (kind, start, end, score) by kind and start; offsets in code points, end exclusive. Base spans have score 1. Null counts as empty."""
        text = text or ""
        base = base_spans(text)
        both = [(*x, 1.0) for x in base] + self.added(text, base)
        return sorted(both, key=lambda x: (KINDS.index(x[0]), x[1], x[2]))


class _Taken:
    """Places that are taken: runs that overlap are merged, so a place is found by binary search."""

    def __init__(self, spans: list[tuple[int, int]]):
        self.starts, self.ends = [], []
        for s, e in sorted(spans):
            if self.ends and s < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], e)
            else:
                self.starts.append(s), self.ends.append(e)

    def free(self, s: int, e: int) -> bool:
        i = bisect.bisect_left(self.starts, e)
        return not i or self.ends[i - 1] <= s

    def add(self, s: int, e: int) -> None:
        i = bisect.bisect_left(self.starts, s)
        self.starts.insert(i, s), self.ends.insert(i, e)


def labelled(n: int = EXAMPLES, seed: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str], list[tuple[int, int]]]:
    """Features, labels, the text's number, the kind and the place of each span proposed in examples that no base span touches. A span is right if it is a personal one from end to end."""
    x, y, of, kinds, places = [], [], [], [], []
    for i, (text, spans) in enumerate(examples(n, seed)):
        taken = _Taken([(s, e) for _, s, e in base_spans(text)])
        for g, s, e in sorted(set(proposed(text))):
            if taken.free(s, e):
                x.append(describe(text, g, s, e))
                y.append(float((s, e) in spans))
                of.append(i)
                kinds.append(kind_of(text, g, s, e))
                places.append((s, e))
    return np.array(x, np.float64), np.array(y), np.array(of), kinds, places


def _winners(p: np.ndarray, of: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """Which spans would be taken of those of a text that overlap, if there were no thresholds."""
    out, taken = np.zeros(len(p), bool), {}
    for i in sorted(range(len(p)), key=lambda i: (-p[i], spans[i][0] - spans[i][1], spans[i])):
        mine = taken.setdefault(int(of[i]), _Taken([]))
        if mine.free(*spans[i]):
            mine.add(*spans[i])
            out[i] = True
    return out


def train(n: int = EXAMPLES, seed: int = 0, precision: float = PRECISION) -> Finder:
    """Trees on two thirds of the texts; scale, shift and thresholds on the rest, thresholds by the likeliest of the spans that overlap. A kind that never reaches precision has a threshold that no probability reaches. The same seed gives the same finder, whatever the corpus."""
    x, y, of, kinds, spans = labelled(n, seed)
    held = of % 3 == 2
    model = Boosted().fit(x[~held], y[~held]).calibrate(x[held], y[held])
    p, kind, thresholds = model.probability(x), np.array(kinds), {}
    first = _winners(p, of, spans)
    for k in ADDED:
        mine = held & first & (kind == k)
        order = np.argsort(-p[mine], kind="stable")
        right, q = y[mine][order].cumsum(), p[mine][order]
        whole = np.append(q[1:] < q[:-1], True) if len(q) else np.zeros(0, bool)  # ties pass together
        good = np.flatnonzero(whole & (right >= precision * np.arange(1, len(q) + 1)))
        thresholds[k] = max(0.5, float(q[good[-1]])) if len(good) else math.inf
    return Finder(model, thresholds)


# ---- on tables


def find_private(docs: DataFrame, finder: Finder | None = None, text: str = "text") -> DataFrame:
    """docs with spans, an array of (kind, start, end, score), in place of a column of that name. Null and empty texts have none; rows stay as they are, repeated ones too, so nothing is shuffled. Whatever the columns, only texts pass through Python."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(finder or train())  # some thousand numbers

    def run(texts: pd.Series) -> pd.Series:
        f = shared.value
        return pd.Series([[{"kind": k, "start": s, "end": e, "score": q} for k, s, e, q in f.find(t)] for t in texts], dtype=object)

    return docs.withColumn("spans", F.pandas_udf(run, _SPANS)(F.col(text)))


def redact(found: DataFrame, text: str = "text") -> DataFrame:
    """find_private's rows with each span in text replaced by its kind in brackets; of spans that overlap, the parts not yet replaced are. Null texts stay null."""
    ordered = F.array_sort(F.transform("spans", lambda s: F.struct(s.start.alias("s"), s.end.alias("e"), s.kind.alias("k"))))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(done, s):
        low = F.greatest(s.s, done.at)
        new = F.array(F.substring(F.col(text), done.at + 1, low - done.at), F.concat(F.lit("["), s.k, F.lit("]")))
        return F.when(s.e <= done.at, done).otherwise(F.struct(s.e.alias("at"), F.concat(done.out, new).alias("out")))

    def end(done):
        return F.concat(F.array_join(done.out, ""), F.substring(F.col(text), done.at + 1, F.length(text)))

    return found.withColumn(text, F.when(F.size("spans") == 0, F.col(text)).otherwise(F.aggregate(ordered, start, step, end)))


def op11_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_private(read_table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    count = lambda k: F.size(F.filter("spans", lambda s: s.kind == k)).cast("long")
    said = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")
    base = F.filter("spans", lambda s: s.kind.isin(*BASE))
    return found.select("doc_id", *(count(k).alias(f"n_{k}") for k in BASE), F.sha2(said(base), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"))
