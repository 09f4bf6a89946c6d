"""Personal data: candidate spans scored by boosted trees, above fixed base rules.

Base rules find e-mail addresses, IPv4 addresses, payment cards (Luhn) and international phone numbers; what
they find always stays. Generators with high recall propose more spans, which may overlap: written-out
addresses, numbers without a country code, cards and addresses in unusual spacing, IPv6, bank accounts,
national numbers, secrets (keys and tokens). Boosted trees score each by its format and context; a calibrated threshold for each kind, chosen on rows
held back from training for a precision of PRECISION or more, selects what is redacted. Of overlapping added
spans the likeliest stays; one that overlaps a base span adds nothing and goes.

The trees are trained on the driver with TRAINING synthetic candidates from a fixed seed, in a second or so:
spans of known kind in neutral and telling contexts, and look-alikes (orders, versions, dates, amounts,
failed checksums). No corpus row is used, so the model is the same at every size.

Defined results: a null text has no spans. Whole texts are searched; each scan takes time linear in the text.
Offsets are code points, ends exclusive. Rows are independent: ties, repeated rows, empty tables and extra
columns need nothing. A column of the input with the name of a result is replaced. Bytes that aren't UTF-8
count as U+FFFD.
"""

import random
import re
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tarn.llm.boosting import Boosted
from tarn.session import ship

KINDS = ("email", "ip", "card", "phone")
#: Kinds that only the method adds come after those of the base.
ADDED_KINDS = (*KINDS, "account", "national", "secret")
TRAINING = 12_000
PRECISION = 0.995
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: Starts only where a run of digits does and never gives digits back: the same matches, in linear time.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of each kind; those that fail the kind's check are dropped."""
    out: list[Span] = []
    if "@" in text:
        done = 0
        for m in _DOMAIN.finditer(text):
            low = max(done, text.rfind("@", done, m.start()) + 1)
            start = low + len(text[low : m.start()].rstrip(_LOCAL))
            if start < m.start():
                out.append(("email", start, m.end()))
                done = m.end()
    if _DIGIT.search(text):
        out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(len(d := p.lstrip("0")) < 4 and int(d or 0) <= 255 for p in m[0].split("."))] if "." in text else []
        out += [("card", m.start(), m.end()) for m in _CARD.finditer(text) if m.end() - m.start() > 11 and 12 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
        out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15] if "+" in text else []
    return sorted(out, key=_order)


def _order(s: Span) -> tuple[int, int, int]:
    return s[1], ADDED_KINDS.index(s[0]), s[2]


#: Generators: kind, pattern, and a test that every text with a match passes. Quantifiers are bounded.
_GENERATORS = [
    ("email", re.compile(r"[A-Za-z0-9._%+-]{1,64} ?(?:\(at\)|\[at\]|\{at\}| at |@) ?[A-Za-z0-9-]{1,63}(?: ?(?:\(dot\)|\[dot\]|\{dot\}| dot |\.) ?[A-Za-z0-9-]{2,63}){1,5}", re.I), re.compile(r"(?:\(at\)|\[at\]|\{at\}| at |@) ?[A-Za-z0-9-]{1,63} ?(?:\(dot\)|\[dot\]|\{dot\}| dot |\.) ?[A-Za-z0-9-]{2}", re.I)),
    ("phone", re.compile(r"(?<![\w.+-])(?:00[1-9][0-9]{0,2}[ .-]?)?\(?0?[0-9]{2,4}\)?[ ./-]{0,2}[0-9]{3,4}(?:[ .-]?[0-9]{2,4}){1,3}(?![\w-])"), _DIGIT),
    ("card", re.compile(r"(?<![\w.])(?:[0-9]{4}[ ._/-]{1,3}){3}[0-9]{1,7}(?![\w])"), _DIGIT),
    ("ip", re.compile(r"(?<![\w:])(?:(?:[0-9a-f]{1,4}:){2,7}(?::?[0-9a-f]{1,4}){1,7}|(?:[0-9a-f]{1,4})?::[0-9a-f]{1,4}(?::[0-9a-f]{1,4}){0,6})(?![\w:])", re.I), re.compile(r"[0-9a-f]:[0-9a-f:]|::[0-9a-f]", re.I)),
    ("ip", re.compile(r"(?<![\w.])[0-9]{1,3}(?: ?(?:\[\.\]|\(\.\)|\[dot\]) ?[0-9]{1,3}){3}(?![\w])"), re.compile(r"\[\.\]|\(\.\)|\[dot\]")),
    ("account", re.compile(r"(?<![\w])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![\w])"), _DIGIT),
    ("national", re.compile(r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])"), _DIGIT),
    ("secret", re.compile(r"(?<![A-Za-z0-9+/_.=-])(?=[A-Za-z0-9+/_.=-]{16})(?=[A-Za-z+/_.=-]*[0-9])(?=[0-9+/_.=-]*[A-Za-z])[A-Za-z0-9+/_.=-]++"), _DIGIT),
]
_TELLING = {
    "email": ("mail", "e-mail", "email", "contact", "write", "reach"), "ip": ("ip", "address", "host", "server", "login"),
    "card": ("card", "visa", "mastercard", "credit", "debit", "amex"), "phone": ("phone", "tel", "call", "fax", "mobile", "cell", "telephone", "sms"),
    "account": ("iban", "account", "bank", "konto"), "national": ("ssn", "social", "security", "passport", "id"),
    "secret": ("token", "secret", "key", "apikey", "api-key", "password", "passwd", "auth", "bearer", "credential", "access"),
}
_AGAINST = ("order", "invoice", "version", "isbn", "ref", "no", "item", "part", "page", "total", "date", "license", "rfc", "build", "serial", "commit", "sha", "md", "digest", "checksum", "revision", "file", "path", "price", "art")
_WORDS = re.compile(r"[A-Za-z][A-Za-z-]*")


def generated(text: str) -> list[Span]:
    return [(kind, m.start(), m.end()) for kind, pattern, test in _GENERATORS if test.search(text) for m in pattern.finditer(text)]


def iban_ok(s: str) -> bool:
    s = s.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def national_ok(s: str) -> bool:
    return s[:3] not in ("000", "666") and s[0] != "9" and s[4:6] != "00" and s[7:] != "0000"


def features(text: str, span: Span) -> list[float]:
    """Format of the span and the 40 code points before and after it, as numbers."""
    kind, a, b = span
    s, before, after = text[a:b], text[max(0, a - 40) : a], text[b : b + 20]
    d = _digits(s)
    groups = [len(g) for g in re.findall(r"[0-9]+", s)] or [0]
    near = [w.lower().rstrip("-") for w in _WORDS.findall(before)][-4:]
    year = bool(re.match(r"(?:19|20)[0-9]{2}(?![0-9])|[0-9]{1,2}[./-][0-9]{1,2}[./-]", s))
    checks = {"card": 12 <= len(d) <= 19 and luhn(d), "account": kind == "account" and iban_ok(s), "national": kind == "national" and national_ok(s)}
    return [
        float(ADDED_KINDS.index(kind)), float(b - a), float(len(d)), float(len(groups)), float(max(groups)), float(min(groups)),
        float(len(set(groups)) == 1), float("(" in s), float("-" in s), float("." in s), float("/" in s), float(" " in s), float(s[:2] == "00"), float(s[:1] == "0"),
        float(bool(checks.get(kind, False))), float(year), float(sum(w in _TELLING[kind] for w in near)), float(any(w in _AGAINST for w in near)),
        float(before[-1:].isalnum()), float(before.rstrip()[-1:] == ":"), float(before.rstrip()[-1:] in tuple("#$€£=\"'")), float(after[:1].isalnum()), float(after[:1] in tuple("%€$")),
        float(len(s) and sum(c.isalpha() for c in s) / len(s)), float(bool(re.search(r"(?:dot|\.) ?[\])}]? ?(?:com|org|net|edu|de|fr|es|io|uk|info)$", s, re.I))), float(len(set(d))),
        float(bool(re.search(r"[(\[{](?:at|dot|\.)[)\]}]", s, re.I))), float(s.count(":")), float("::" in s), float(bool(re.search("[a-f]", s, re.I)) and kind == "ip"),
        float(len(set(s)) / len(s)), float(len(re.findall("[0-9](?=[A-Za-z])|[A-Za-z](?=[0-9])", s)) / len(s)), float(max(map(len, re.findall("[A-Za-z]+", s)), default=0) / len(s)), float(before[-1:] in tuple("\"'")), float(bool(re.search("[:=]\\s*[\"']?$", before))),
    ]


def _synthetic(rnd: random.Random) -> tuple[str, Span, int]:
    """A text, a candidate in it, and whether it is personal data."""
    num = lambda k: "".join(rnd.choice("0123456789") for _ in range(k))
    word = lambda: "".join(rnd.choice("abcdefghilmnoprstuw") for _ in range(rnd.randint(2, 9)))
    kind, good = rnd.choice(ADDED_KINDS), rnd.random() < 0.5
    sep = rnd.choice((" ", "-", "."))
    if kind == "email":
        at, dot = rnd.choice(((" (at) ", " (dot) "), ("[at]", "[dot]"), (" at ", " dot "), (" @ ", "."), ("(at)", "."), (" at ", "(dot)")))
        s = f"{word()}{at}{word()}{dot}{rnd.choice(('com', 'org', 'net', 'de', 'fr'))}" if good else rnd.choice((f"{word()} at {word()}.{word()}", f"{word()} at {word()} dot {word()}", f"{word()} @ {word()}. {word()}"))
    elif kind == "phone":
        s = rnd.choice((f"({num(3)}) {num(3)}-{num(4)}", f"{rnd.choice('23456789')}{num(2)}{sep}{num(3)}{sep}{num(4)}", f"0{num(3)}{rnd.choice(' /')}{num(4)}{num(3)}", f"00{rnd.choice('1349')}{num(1)} {num(3)} {num(4)}")) if good else rnd.choice((f"{num(7)}", f"{num(3)}.{num(3)}.{num(3)}", f"20{num(2)}-{num(3)}-{num(2)}", f"{num(10)}", f"{num(4)}-{num(4)}", f"{num(16)}", f"{num(12)}", f"20{num(2)} {num(4)} {num(4)}"))
    elif kind == "card":
        d = num(15)
        d = next(d + c for c in "0123456789" if luhn(d + c) == good)
        sep = rnd.choice((" ", "-", ".", "  ", "_", " - "))
        s = sep.join((d[:4], d[4:8], d[8:12], d[12:]))
    elif kind == "ip":
        six = ":".join(f"{rnd.getrandbits(16):x}" for _ in range(8))
        dots = "[.]".join(str(rnd.randint(1, 255 if good else 999)) for _ in range(4))
        s = rnd.choice((six, f"fe80::{rnd.getrandbits(16):x}:{rnd.getrandbits(16):x}:{rnd.getrandbits(16):x}", dots)) if good else rnd.choice((f"{num(2)}:{num(2)}:{num(2)}", f"{num(1)}:{num(2)}:{num(2)}", f"{num(2)}:{num(2)}:{num(2)}:{num(3)}"))
    elif kind == "account":
        body, land = num(18), rnd.choice(("DE", "FR", "ES", "GB"))
        key = 98 - int("".join(str(int(c, 36)) for c in body + land) + "00") % 97
        s = f"{land}{key if good else (key + rnd.randint(1, 90)) % 97:02d}{body}"
        s = " ".join(re.findall(".{1,4}", s)) if rnd.random() < 0.5 else s
    elif kind == "secret":
        some = lambda letters, k: "".join(rnd.choice(letters) for _ in range(k))
        hexes, any_ = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
        forms = (some(hexes, rnd.choice((32, 40, 64))), some(any_, rnd.randint(20, 48)), f"sk-{some(any_, 40)}", f"AKIA{some(any_[:26] + any_[52:], 16)}", f"ghp_{some(any_, 36)}", some(any_ + "+/", 40), ".".join((some(any_, 20), some(any_, 40), some(any_, 27))))
        plain = ("_".join(word() for _ in range(4)) + num(1), "-".join((some(hexes, 8), some(hexes, 4), some(hexes, 4), some(hexes, 12))), "/".join(word() for _ in range(4)) + f"/{word()}{num(2)}.txt", f"{word()}{word()}{word()}{num(2)}", f"{num(4)}-{num(2)}-{num(2)}T{num(2)}", f"{num(17)}{word()}")
        formed = good or rnd.random() < 0.5
        s = rnd.choice(forms if formed else plain)
        s = s if _DIGIT.search(s) else s[:-1] + num(1)
    else:
        s = f"{rnd.randint(1, 665):03d}-{rnd.randint(1, 99):02d}-{rnd.randint(1, 9999):04d}" if good else rnd.choice((f"{rnd.randint(900, 999)}-{num(2)}-{num(4)}", f"{num(3)}-00-{num(4)}", f"000-{num(2)}-{num(4)}", f"{num(3)}-{num(2)}-{num(4)}"))
    tell = rnd.random()
    between = (' = "', ": ", "=", '="', ': "', " = ") if kind == "secret" else (": ", " ", " is ")
    lead = f"{rnd.choice(_TELLING[kind])}{rnd.choice(between)}" if tell < (0.65 if good else 0.1) else f"{rnd.choice(_AGAINST)}{rnd.choice((' ', ': ', ' #', ' = '))}" if tell > (0.98 if good else 0.5) else ""
    told = any(lead.startswith(w) for w in _TELLING[kind])
    if kind == "national":
        good = national_ok(s) and told  # the format alone says too little
    if kind == "secret":
        good = formed and told
    if kind == "phone" and not lead.strip() and "(" not in s and not s.startswith("00"):
        good = False
    head = " ".join(word() for _ in range(rnd.randint(0, 5)))
    head = f"{head} {lead}" if head else lead
    return head + s + rnd.choice((" ", ". ", ", ", "")) + " ".join(word() for _ in range(rnd.randint(0, 4))), (kind, len(head), len(head) + len(s)), int(good)


@lru_cache(1)
def model(rows: int = TRAINING) -> tuple[Boosted, dict[str, float]]:
    """The calibrated trees and each kind's threshold: trained on half the rows, calibrated on a quarter, cut on the last."""
    rnd = random.Random(20240501)
    made = [_synthetic(rnd) for _ in range(rows)]
    x, y = np.array([features(t, s) for t, s, _ in made]), np.array([g for *_, g in made], float)
    a, b = rows // 2, 3 * rows // 4
    trees = Boosted(rounds=120, depth=4, rate=0.15).fit(x[:a], y[:a]).calibrate(x[a:b], y[a:b])
    p, t, kinds = trees.probability(x[b:]), y[b:], np.array([span[0] for _, span, _ in made[b:]])
    return trees, {kind: _threshold(p[kinds == kind], t[kinds == kind]) for kind in ADDED_KINDS}


def _threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The least probability, 0.5 or more, from which PRECISION holds; above 1 if it never does."""
    order = np.argsort(-p)
    precise = np.cumsum(y[order]) / np.arange(1, len(y) + 1)
    good = np.flatnonzero(precise >= PRECISION)
    return max(0.5, float(p[order][good[-1]])) if len(good) else 2.0


def spans(text: str, trees: Boosted, thresholds: dict[str, float]) -> tuple[list[Span], list[Span]]:
    """(base spans, all spans), each by start, kind, end."""
    base = base_spans(text)
    taken: list[tuple[int, int]] = []  # disjoint, in order
    for _, a, b in base:
        if taken and a < taken[-1][1]:
            taken[-1] = (taken[-1][0], max(b, taken[-1][1]))
        else:
            taken.append((a, b))
    free = [s for s in generated(text) if not _hits(taken, s)]
    if not free:
        return base, base
    p, added = trees.probability(np.array([features(text, s) for s in free])), []
    for k in np.lexsort((np.arange(len(free)), -p)):
        if p[k] >= thresholds[free[k][0]] and not _hits(taken, free[k]):
            added.append(free[k])
            insort(taken, free[k][1:])
    return base, sorted(base + added, key=_order)


def _hits(taken: list[tuple[int, int]], s: Span) -> bool:
    i = bisect_left(taken, (s[2],))
    return i > 0 and taken[i - 1][1] > s[1]


def redact_text(text: str, found: list[Span]) -> str:
    """Each run of overlapping spans becomes [kind], after the span that starts first."""
    out, done, end = [], 0, -1
    for kind, a, b in found:
        if a >= end:
            out += [text[done:a], f"[{kind}]"]
        done = end = max(end, b)
    return "".join([*out, text[done:]])


def joined(found: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in found)


def annotate(docs: DataFrame, text: str = "text", redacted: bool = False) -> DataFrame:
    """docs with n_email, n_ip, n_card, n_phone (of the base), base_spans and spans; redacted replaces the text, too."""
    ship(docs.sparkSession)
    trees, thresholds = model()
    new = [*(f"n_{k}" for k in KINDS), "base_spans", "spans"]
    kept = docs.drop(*new)
    schema = StructType([*kept.schema.fields, *(StructField(f"n_{k}", LongType()) for k in KINDS), StructField("base_spans", StringType()), StructField("spans", StringType())])
    at = kept.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, base, every, texts = {k: [] for k in KINDS}, [], [], []
            for t in batch.column(at).cast(pa.binary()):
                s = t.as_buffer().to_pybytes().decode("utf-8", "replace") if t.is_valid else None
                fixed, found = spans(s, trees, thresholds) if s else ([], [])
                for k in KINDS:
                    counts[k].append(sum(x[0] == k for x in fixed))
                base.append(joined(fixed))
                every.append(joined(found))
                texts.append(redact_text(s, found) if found and redacted else s)
            columns = list(batch.columns)
            if redacted:
                columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([*columns, *(pa.array(counts[k], pa.int64()) for k in KINDS), pa.array(base, pa.string()), pa.array(every, pa.string())], [*batch.schema.names, *new])

    return kept.mapInArrow(run, schema)
