"""Personal data in texts: strict rules, and spans that boosted trees choose among generous candidates.

The base rules find e-mail and network addresses, card and telephone numbers in
their plain forms, and always stay. Generators then propose every stretch that might be personal
data in some other form, spans that overlap included. Trees judge each by its form
(length, groups, check digits, character classes) and by what stands around it (marks, key words);
a threshold for each kind, set on examples not learnt from, decides. Of overlapping
spans the likeliest stays; none that meets a base span is added.

No table tells what is personal, so the trees learn from examples made here: forms
of each kind and forms that only look like them, set into contexts from a bounded
sample of the texts, with and without key words. Nothing is drawn without a seed.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoweld.llm.boosting import Boosted
from geoweld.llm.common import free_name

#: In the order in which spans with one start are told; the first four have base rules.
KINDS = ("email", "ip", "card", "phone", "id", "secret")
#: Contexts that the driver holds: so many texts, so many characters of each.
MOST_CONTEXTS, CONTEXT_CHARS = 400, 400
#: Examples made, of which a third sets the thresholds.
EXAMPLES = 9000
#: Characters on either side of a candidate that are looked at.
AROUND = 40

SPANS = "array<struct<kind: string, start: long, end: long, score: double, base: boolean>>"
FOUND = pa.struct([
    ("spans", pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("base", pa.bool_())]))), ("redacted", pa.string()),
])

# --- base rules -----------------------------------------------------------------

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match begins where a run of digits does, as one that began later would end alike; this keeps long runs linear.
BASE = {
    "ip": re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def luhn(digits: str) -> bool:
    twice = [2 * int(d) for d in digits[-2::-2]]
    return (sum(map(int, digits[-1::-2])) + sum(d - 9 * (d > 9) for d in twice)) % 10 == 0


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of local part, @ and domain: each @ is met once, so a long run of letters costs no more than its length."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            yield start, m.end()
            free = m.end()
        at = text.find("@", max(free, at + 1))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, end exclusive, by start and then kind."""
    out = [("email", a, b) for a, b in _emails(text)]
    if re.search("[0-9]", text):
        for kind, rule in BASE.items():
            for m in rule.finditer(text):
                if kind == "ip":
                    good = all(len(x) <= 3 and int(x or 0) <= 255 for x in (y.lstrip("0") for y in m.group().split(".")))
                else:
                    digits = digits_of(m.group())
                    good = 12 <= len(digits) <= 19 and luhn(digits) if kind == "card" else 9 <= len(digits) <= 15
                if good:
                    out.append((kind, m.start(), m.end()))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


# --- candidates -----------------------------------------------------------------

AT = r"(?:[@＠]|[\[({<]\s?(?:at|@)\s?[\])}>])"
DOT = r"(?:\.|[\[({<]\s?(?:dot|\.)\s?[\])}>])"
NAME = r"[\w%+-]{1,64}"
#: From the sign onwards; the part before it is looked for backwards from there.
MAIL = (
    re.compile(rf"\s?{AT}\s?(?P<rest>{NAME}(?:\s?{DOT}\s?{NAME}){{1,4}})", re.I),
    re.compile(rf"\sat\s(?P<rest>{NAME}(?:\s(?:dot|punkt|punto|point)\s{NAME}|\.{NAME}){{1,4}})", re.I),
)
MAIL_NAME = re.compile(rf"{NAME}(?:(?:\.|\s?[\[({{<]\s?(?:dot|\.)\s?[\])}}>]\s?|\sdot\s){NAME}){{0,4}}$", re.I)
NUMBER = re.compile(r"(?<![\w+(])[+(]{0,2}[0-9](?:[\x20\xa0().\-/]{0,3}[0-9])+")
PIECE = re.compile(r"[+(]{0,2}[0-9](?:[().\-/]{0,2}[0-9])+")
DOTTED = re.compile(r"(?<![\w.])[0-9]{1,3}(?:\s?(?:\[\.\]|\(\.\)|\{\.\}|\[dot\]|\(dot\))\s?[0-9]{1,3}){3}(?![\w.])", re.I)
COLONS = re.compile(r"(?<![\w:.])(?:[0-9A-Fa-f]{1,4}:|::)(?:[0-9A-Fa-f]{0,4}:){1,7}[0-9A-Fa-f]{0,4}(?![\w:])")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
ASSIGNED = re.compile(r"""(?<![A-Za-z])(?:[A-Za-z]{1,12}[_-])?(?:password|passwort|passwd|pwd|secret|token|api[_-]?key|key|auth|bearer)["']?\s{0,2}[:=]\s{0,2}["']?(?P<it>[^\s"'<>,;]{6,256})""", re.I)
LOOSE = re.compile(r"(?<![A-Za-z0-9_/+=-])(?=[A-Za-z_-]{0,64}[0-9])[A-Za-z0-9_-]{16,256}(?![A-Za-z0-9_/+=-])")


def candidates(text: str) -> list[tuple[str, int, int]]:
    """Every stretch that may be personal data, overlapping ones included, as (kind, start, end)."""
    out: set[tuple[str, int, int]] = set()
    for rule in MAIL:
        for m in rule.finditer(text):
            low = max(0, m.start() - 2 * AROUND)
            before = MAIL_NAME.search(text[low : m.start()])
            if before:
                out.add(("email", low + before.start(), m.end("rest")))
                word = re.search(r"[\w.%+-]+$", text[low : m.start()])
                if word:
                    out.add(("email", low + word.start(), m.end("rest")))
    for m in ASSIGNED.finditer(text):
        out.add(("secret", *m.span("it")))
    if not re.search("[0-9]", text):
        return sorted(out, key=lambda s: (s[1], s[2], s[0]))
    for m in NUMBER.finditer(text):
        pieces = [m.span(), *((m.start() + p.start(), m.start() + p.end()) for p in PIECE.finditer(m.group()))]
        for a, b in set(pieces):
            n = len(digits_of(text[a:b])) if b - a <= 64 else 0
            if 12 <= n <= 19:
                out.add(("card", a, b))
            if 7 <= n <= 15:
                out.add(("phone", a, b))
            if 7 <= n <= 19:
                out.add(("id", a, b))
    out |= {("ip", *m.span()) for m in DOTTED.finditer(text)}
    if text.count(":") > 1:
        out |= {("ip", *m.span()) for m in COLONS.finditer(text)}
    out |= {("id", *m.span()) for m in IBAN.finditer(text)}
    out |= {("secret", *m.span()) for m in LOOSE.finditer(text)}
    return sorted(out, key=lambda s: (s[1], s[2], s[0]))


#: Fixed word lists: what tends to stand before personal data and before other numbers, in the languages of the tables.
HINTS = {
    "email": r"mail|contact|kontakt|correo|courriel|write|schreib|escrib|[ée]cri",
    "ip": r"\bip\b|address|adresse|direcci|host|server|client|from",
    "card": r"card|karte|carte|tarjeta|visa|mastercard|amex|credit|kredit|cr[ée]dit",
    "phone": r"phone|t[eé]l|call|ruf|appel|llam|fax|mobil|handy|m[oó]vil|whatsapp|sms|contact|kontakt",
    "id": r"ssn|social|iban|passport|pass-?nr|pasaporte|passeport|dni|ausweis|account|konto|compte|cuenta|licen[cs]e no|tax|steuer|s[ée]cu",
    "secret": r"password|passwort|passwd|pwd|secret|token|api.?key|auth|bearer|login|mot de passe|contrase",
}
OTHER = r"version|\bv\.?$|isbn|issn|page|seite|p[aá]gina|order|bestell|commande|pedido|invoice|rechnung|facture|total|price|preis|prix|precio|[$€£%]|date|datum|fecha|item|artikel|article|serial|commit|sha|md5|uuid|build|number of|popul|year|jahr|\bno\.|\bnr\."
HINT_RULES = [re.compile(HINTS[k], re.I) for k in KINDS]
OTHER_RULE = re.compile(OTHER, re.I)
DATE = re.compile(r"(?:1[89]|20)\d\d[-./](?:0?[1-9]|1[0-2])[-./](?:[12]\d|3[01]|0?[1-9])|(?:[12]\d|3[01]|0?[1-9])[-./](?:[12]\d|3[01]|0?[1-9])[-./](?:1[89]|20)?\d\d")
TLD = re.compile(r"(?:com|org|net|edu|gov|info|biz|io|dev|app|[a-z]{2})$", re.I)
NO_TLD = re.compile(r"(?:is|it|in|on|as|to|of|we|he|so|or|if|an|and|the)$", re.I)
KEYED = re.compile(r"(?:AKIA|ASIA|gh[pousr]_|sk[_-]|xox[abp]-|AIza|eyJ)")
HEX = re.compile(r"[0-9a-fA-F]+")
UUID = re.compile(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")


def mod97(text: str) -> bool:
    packed = text.replace(" ", "")
    return packed[:2].isalpha() and int("".join(str(int(c, 36)) for c in packed[4:] + packed[:4])) % 97 == 1


def features(text: str, kind: str, start: int, end: int) -> list[float]:
    """Form and context of a candidate; the context is a few words on either side."""
    span, before, after = text[start:end], text[max(0, start - AROUND) : start], text[end : end + 12]
    digits = digits_of(span)
    groups = re.findall("[0-9]+", span) or [""]
    letters = sum(c.isalpha() for c in span)
    kinds = [(KINDS.index(kind) == k) for k in range(len(KINDS))]
    tail = re.split(r"[^\w]+", span)[-1]
    close = before[-24:]
    counts = [span.count(c) for c in " .-/():"]
    return [
        *kinds, len(span), len(digits), letters, len(groups), max(map(len, groups)), min(map(len, groups)), len(groups[-1]), *counts,
        span[0] == "+", span[0] == "(", digits[:1] == "0", bool(digits) and luhn(digits), kind == "id" and letters > 0 and span.isascii() and mod97(span),
        [len(g) for g in groups] == [3, 2, 4], [len(g) for g in groups][-2:] == [3, 4], bool(DATE.match(span)), digits[:3] in ("978", "979"), len(set(span)),
        sum(c.isupper() for c in span) / len(span), sum(a.isdigit() != b.isdigit() for a, b in zip(span, span[1:])) / len(span),
        bool(HEX.fullmatch(span)), bool(UUID.fullmatch(span)), bool(KEYED.match(span)), bool(TLD.match(tail)), bool(NO_TLD.match(tail)),
        bool(re.search(r"@|＠", span)), bool(re.search(r"[\[({<]", span)), bool(re.search(r"\s(?:dot|punkt|punto|point)\s", span, re.I)),
        kind == "ip" and all(x and len(x) <= 3 and int(x) <= 255 for x in groups), kind == "ip" and span.count("::") == 1 or span.count(":") == 7,
        bool(HINT_RULES[KINDS.index(kind)].search(before)), any(r.search(before) for r in HINT_RULES), bool(OTHER_RULE.search(close)), bool(re.match(r"\s?[%€$£]", after)),
        before[-1:].isalnum(), after[:1].isalnum(), before[-1:] in ".,-/:$€£#", after[:1] in "-/:" and after[1:2].isalnum(),
        bool(re.search(r"[0-9][^\w\n]{0,3}$", before)), bool(re.match(r"[^\w\n]{0,3}[0-9]", after)), bool(re.search(r"[:=]\s?[\"']?$", before)),
    ]


# --- examples -------------------------------------------------------------------


def _digits(rng: random.Random, n: int) -> str:
    return "".join(rng.choice("0123456789") for _ in range(n))


def _checked(digits: str, wanted: bool = True) -> str:
    """The digits with a last one that passes the check, or one that doesn't."""
    good = [d for d in "0123456789" if luhn(digits + d)][0]
    return digits + (good if wanted else str((int(good) + 3) % 10))


def _grouped(digits: str, sizes: tuple[int, ...], by: str) -> str:
    out, at = [], 0
    for s in sizes:
        out.append(digits[at : at + s])
        at += s
    return by.join(x for x in [*out, digits[at:]] if x)


def _word(rng: random.Random, low: int = 3, high: int = 9) -> str:
    return "".join(rng.choice("abcdefghijklmnoprstuvwz") for _ in range(rng.randint(low, high)))


def _iban(rng: random.Random, good: bool) -> str:
    country, body = rng.choice(["DE", "FR", "ES", "GB", "NL", "IT"]), _digits(rng, rng.choice([14, 18, 20]))
    check = 98 - int("".join(str(int(c, 36)) for c in body + country + "00")) % 97
    packed = f"{country}{check if good else (check + 5) % 97:02d}{body}"
    return packed if rng.random() < 0.5 else _grouped(packed, (4,) * 8, " ")


def _personal(rng: random.Random) -> tuple[str, str]:
    kind = rng.choice(KINDS)
    if kind == "email":
        name = rng.choice([_word(rng), f"{_word(rng)}.{_word(rng)}", f"{_word(rng)}{_digits(rng, 2)}", f"{_word(rng)}_{_word(rng)}"])
        at, dot = rng.choice([("@", "."), (" @ ", "."), (" @ ", " . "), ("(at)", "."), (" (at) ", "."), ("[at]", "[dot]"), (" [at] ", " [dot] "), (" at ", " dot "), (" AT ", " DOT "), ("{at}", "."), ("＠", ".")])
        host = dot.join([*([_word(rng)] if rng.random() < 0.3 else []), _word(rng), rng.choice(["com", "org", "net", "de", "fr", "es", "io", "co"])])
        return kind, (name.replace(".", dot) if dot == " dot " else name) + at + host
    if kind == "ip":
        if rng.random() < 0.5:
            return kind, rng.choice(["[.]", "(.)", "[dot]", "{.}"]).join(str(rng.randint(0, 255)) for _ in range(4))
        parts = [f"{rng.randrange(65536):x}" for _ in range(8)]
        cut = rng.randint(1, 6)
        return kind, ":".join(parts) if rng.random() < 0.4 else ":".join(parts[:cut]) + "::" + ":".join(parts[cut + 1 : cut + 1 + rng.randint(1, 7 - cut)])
    if kind == "card":
        n = rng.choice([15, 16, 16, 16, 16, 19])
        digits = _checked(rng.choice("3456") + _digits(rng, n - 2))
        return kind, _grouped(digits, (4, 6, 5) if n == 15 else (4, 4, 4, 4), rng.choice([".", "  ", "/", "\xa0", " - ", " . "]))
    if kind == "phone":
        form = rng.choice(["(ddd) ddd-dddd", "(ddd)ddd-dddd", "ddd-ddd-dddd", "ddd.ddd.dddd", "ddd ddd dddd", "1-ddd-ddd-dddd", "0d dd dd dd dd", "0d.dd.dd.dd.dd", "0ddd ddddddd", "0ddd/dddddd", "0ddd-dddddd", "00dd ddd ddddddd", "(0dd) ddddddd", "(dd) ddd dd dd dd", "6dd ddd ddd", "+dd (0) ddd / dddddd", "+dd/ddd/dddddd"])
        return kind, re.sub("d", lambda _: rng.choice("123456789"), form)
    if kind == "id":
        return kind, rng.choice([lambda: f"{rng.randint(1, 899):03d}-{rng.randint(1, 99):02d}-{rng.randint(1, 9999):04d}", lambda: _iban(rng, True), lambda: _iban(rng, True)])()
    mixed = lambda n: "".join(rng.choice("ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz23456789") for _ in range(n))
    hexed = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    return kind, rng.choice([lambda: "AKIA" + mixed(16).upper(), lambda: "ghp_" + mixed(36), lambda: "sk-" + mixed(40), lambda: mixed(rng.randint(8, 40)), lambda: hexed(rng.choice([16, 18, 32, 40, 64]))])()


def _alike(rng: random.Random) -> str:
    """Looks like personal data and isn't."""
    year, month, day = rng.randint(1800, 2030), rng.randint(1, 12), rng.randint(1, 28)
    n = lambda a, b: str(rng.randint(a, b))
    return rng.choice([
        lambda: f"{year}-{month:02d}-{day:02d}", lambda: f"{day:02d}.{month:02d}.{year}", lambda: f"{day:02d}/{month:02d}/{year}", lambda: f"{year}-{year + 5}", lambda: f"{year}-{month:02d}-{day:02d} {n(10, 23)}:{n(10, 59)}:{n(10, 59)}",
        lambda: f"{n(1, 9)}.{n(0, 20)}.{n(0, 20)}", lambda: f"{n(1, 999)},{n(100, 999)},{n(100, 999)}", lambda: f"{n(1, 999)} {n(100, 999)} {n(100, 999)}", lambda: f"{n(1, 99)}.{n(100, 999)}.{n(100, 999)},{n(10, 99)}",
        lambda: f"978-{n(0, 9)}-{n(100, 999)}-{n(10000, 99999)}-{n(0, 9)}", lambda: "978" + _digits(rng, 10), lambda: f"{n(1000, 9999)}-{n(1000, 9999)}", lambda: _digits(rng, rng.randint(7, 11)), lambda: _digits(rng, rng.randint(12, 19)),
        lambda: _checked(_digits(rng, rng.randint(11, 18)), False), lambda: _grouped(_checked(_digits(rng, 15), False), (4, 4, 4, 4), rng.choice([" ", "-", "."])), lambda: f"{n(10, 89)}.{_digits(rng, 6)}, {n(10, 89)}.{_digits(rng, 6)}",
        lambda: f"{year}{month:02d}{day:02d}{_digits(rng, 6)}", lambda: f"{n(1, 9)} {n(1, 9)} {n(1, 9)} {n(1, 9)} {n(1, 9)} {n(1, 9)} {n(1, 9)} {n(1, 9)}", lambda: " ".join(n(10, 999) for _ in range(rng.randint(3, 6))), lambda: f"{n(10, 23)}:{n(10, 59)}:{n(10, 59)}",
        lambda: ":".join(f"{rng.randrange(256):02x}" for _ in range(6)), lambda: f"{_word(rng)} at {_word(rng)}.{_word(rng)}", lambda: f"{_word(rng)} at the {_word(rng)} . {_word(rng)}", lambda: f"{_word(rng)} at {_word(rng)} point {_word(rng)}",
        lambda: f"@{_word(rng)}", lambda: f"{_word(rng)}@{_word(rng)}", lambda: f"{_word(rng)} @ {_word(rng)}. {_word(rng).title()}", lambda: "-".join([_digits(rng, 8), *(f"{rng.randrange(65536):04x}" for _ in range(3)), f"{rng.randrange(16**12):012x}"]),
        lambda: f"{rng.randrange(16**40):040x}", lambda: f"{_word(rng)}-{_word(rng)}-{_word(rng)}-{n(1, 99)}", lambda: f"{_word(rng, 9, 14)}_{_word(rng, 5, 9)}{n(1, 9)}", lambda: f"{_word(rng, 14, 20)}{n(1000, 9999)}", lambda: _iban(rng, False),
        lambda: f"{n(100, 999)}-{n(10, 99)}-{n(10, 999)}", lambda: "0." + _digits(rng, 12), lambda: f"{n(1, 99)}/{n(1, 99)}/{n(1, 99)}/{n(1, 99)}", lambda: f"{n(256, 999)}[.]{n(256, 999)}[.]{n(0, 99)}[.]{n(0, 99)}", lambda: f"key: {_word(rng, 6, 12)}", lambda: f"key = {_word(rng, 6, 12)}",
    ])()


#: Fixed: a few of the words that HINTS and OTHER look for, to stand before made examples.
LEADS = {
    "email": ("e-mail: ", "contact ", "Kontakt: ", "correo: "), "ip": ("IP ", "host ", "from "), "card": ("card ", "credit card: ", "Kreditkarte ", "tarjeta "), "phone": ("phone ", "call ", "Tel. ", "tél. ", "fax: ", "móvil "),
    "id": ("SSN ", "IBAN: ", "social security ", "Konto "), "secret": ("password=", "token = \"", "api_key: ", "secret: ", "Passwort: ", "password: "),
}
OTHER_LEADS = ("version ", "ISBN ", "page ", "order ", "invoice ", "total ", "commit ", "build ", "item no. ", "uuid ", "date ", "$", "€ ")


def examples(contexts: list[str], count: int = EXAMPLES, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Features and label of candidates in made texts: a candidate is personal if it is the stretch that was set in, of its kind."""
    rng = random.Random(seed)
    rows, labels = [], []
    pieces = [c.split() for c in contexts if c and c.split()] or [["the", "text", "of", "it"]]
    while len(rows) < count:
        words = rng.choice(pieces)
        cut = rng.randint(0, len(words))
        before, after = " ".join(words[max(0, cut - 6) : cut]), " ".join(words[cut : cut + 6])
        kind, it = _personal(rng) if (personal := rng.random() < 0.5) else ("", _alike(rng))
        if personal:
            needed = kind == "secret" and not KEYED.match(it)  # random letters are a secret only where a key word says so
            lead = rng.choice(LEADS[kind]) if needed or rng.random() < 0.4 else ""
        else:
            lead = rng.choice(OTHER_LEADS) if rng.random() < 0.4 else ""
        lead = f"{before}{' ' if before else ''}{lead}"
        close = '"' if lead.endswith('"') else ""
        text = f"{lead}{it}{close}{rng.choice([' ', ' ', ', ', '. ', chr(10)])}{after}"
        base = base_spans(text)
        for k, a, b in candidates(text):
            if any(a < y and x < b for _, x, y in base):
                continue
            inside = a < len(lead) + len(it) and b > len(lead)
            if not inside and rng.random() < 0.5:
                continue
            rows.append(features(text, k, a, b))
            start, end = len(lead), len(lead) + len(it)
            # words before an address may be a part of its name, so its start may be off
            labels.append(float(personal and k == kind and b == end and (a == start or k == "email" and abs(a - start) <= 0.4 * len(it))))
    return np.array(rows, np.float64), np.array(labels)


@dataclass
class Model:
    trees: Boosted
    thresholds: dict[str, float]


def train(docs: DataFrame, text: str = "text", precision: float = 0.98, contexts: int = MOST_CONTEXTS, count: int = EXAMPLES) -> Model:
    """Trees and thresholds. Contexts are the openings of up to `contexts` texts, CONTEXT_CHARS of each, which is all that the driver gets.

    The texts' hashes are dealt to so many classes, and each class gives the text of least hash.
    A kind's threshold is the least probability from which on a share `precision` of
    the candidates that were not learnt from is personal, and 0.5 at least; where there is none, nothing of the kind is added.
    """
    some = docs.select(F.substring(F.col(text), 1, CONTEXT_CHARS).alias("context"), F.xxhash64(text).alias("hash")).where("context is not null")
    least = some.groupBy(F.pmod("hash", F.lit(contexts)).alias("class")).agg(F.min(F.struct("hash", "context")).alias("least"))
    x, y = examples([r.context for r in least.select("class", "least.context").orderBy("class").collect()], count)
    held = np.arange(len(x)) % 3 == 0
    trees = Boosted().fit(x[~held], y[~held]).calibrate(x[held], y[held])
    p, thresholds = trees.probability(x[held]), {}
    for k, kind in enumerate(KINDS):
        own = x[held][:, k] > 0
        order = np.argsort(-p[own], kind="stable")
        right = np.cumsum(y[held][own][order]) / np.arange(1, own.sum() + 1)
        good = np.flatnonzero(right >= precision)
        thresholds[kind] = max(0.5, float(p[own][order][good[-1]])) if len(good) else 2.0
    return Model(trees, thresholds)


# --- use ------------------------------------------------------------------------


def found_in(texts: list[str], model: Model) -> list[dict]:
    """spans and redacted text of each text."""
    base, taken = [base_spans(t) for t in texts], [bytearray(len(t)) for t in texts]
    for own, marks in zip(base, taken, strict=True):
        for _, a, b in own:
            marks[a:b] = b"\1" * (b - a)
    proposed = [(i, k, a, b) for i, t in enumerate(texts) for k, a, b in candidates(t) if 1 not in taken[i][a:b]]
    chosen: list[list] = [[] for _ in texts]
    if proposed:
        p = model.trees.probability(np.array([features(texts[i], k, a, b) for i, k, a, b in proposed], np.float64))
        for j in np.lexsort((np.arange(len(p)), -p)):
            i, k, a, b = proposed[j]
            if p[j] >= model.thresholds[k] and 1 not in taken[i][a:b]:
                chosen[i].append((k, a, b, float(p[j])))
                taken[i][a:b] = b"\1" * (b - a)
    out = []
    for t, own, added in zip(texts, base, chosen, strict=True):
        spans = [{"kind": k, "start": a, "end": b, "score": 1.0, "base": True} for k, a, b in own]
        spans += [{"kind": k, "start": a, "end": b, "score": s, "base": False} for k, a, b, s in added]
        spans.sort(key=lambda s: (s["start"], KINDS.index(s["kind"])))
        out.append({"spans": spans, "redacted": redacted(t, spans)})
    return out


def redacted(text: str, spans: list[dict]) -> str:
    """The text with [KIND] in place of each span; spans that meet are one, under the first's kind."""
    out, at = [], 0
    for s in spans:
        if s["start"] >= at:
            out += [text[at : s["start"]], f"[{s['kind'].upper()}]"]
        at = max(at, s["end"])
    return "".join([*out, text[at:]])


def with_spans(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with spans (kind, start, end in code points, score, base; by start and then kind) and redacted, the text without them.

    A null text counts as empty. Columns of docs under these names are replaced; other
    columns stay, and rows that repeat are each worked out.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # some hundred kB

    @F.arrow_udf(f"struct<spans: {SPANS}, redacted: string>")
    def find(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            out = []
            for start in range(0, len(texts), 500):
                some = [t or "" for t in texts.slice(start, 500).to_pylist()]
                out.append(pa.array(found_in(some, shared.value), FOUND))
            yield pa.concat_arrays(out) if out else pa.array([], FOUND)

    found = free_name(docs, "found")
    old = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in {"spans", "redacted"}]
    return docs.withColumn(found, find(F.col(text))).select(*old, F.col(found)["spans"].alias("spans"), F.col(found)["redacted"].alias("redacted"))
