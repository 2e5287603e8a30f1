"""Personal data and secrets: candidate generators, boosted trees over format and context, calibrated thresholds.

The base detectors are exact: e-mail, IPv4, card (Luhn) and phone in international form, leftmost and not overlapping within a
kind. Beside them, high-recall generators propose overlapping spans of the same kinds in looser forms, and of secrets: obfuscated
addresses, IPv6, separated or unlucky card numbers, national phone forms, assigned or random-looking strings. Trees score each
proposal by its format and its context; isotonic calibration gives a probability; a kind's threshold is where calibrated
precision on rows kept back reaches PRECISION. Chosen proposals that touch no base span and no better proposal are added.

No table labels personal data, so the trees are trained here on TRAINING lookalikes made from a rule and a seed, set into
snippets of the corpus itself, and on long numbers that stand in the corpus, which their check digit labels. Snippets and
numbers come from CARRIERS distinct texts, those of least hash; without any the lookalikes stand in made-up words. The rows are
read whole to be searched; only this sample for fitting is bounded.

Every whole text is read; null counts as empty and has no spans. Positions are code points, ends exclusive. A null doc_id stays null,
repeated rows give equal rows, an empty table an empty result; only doc_id and text are read, so extra columns never clash.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.gbdt import Boosted, Isotonic

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "secret")
SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long, n_spans long"
PRECISION = 0.99
TRAINING = 6000
#: Distinct texts that lend snippets of SNIPPET characters and long numbers to the training, at most.
CARRIERS, SNIPPET = 2000, 240
WINDOW = 40

_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def luhn(number: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(number)):
        n = ord(c) - 48
        total += n if k % 2 == 0 else (2 * n - 9 if n > 4 else 2 * n)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of the address pattern, in linear time: from each @ back over the local part, but not into the match before."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            end = found.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the exact detectors, by start, then kind."""
    out = [("email", a, b) for a, b in emails(text)]
    if any(c in text for c in "0123456789"):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                out.append(("ip", *m.span()))
        for m in _CARD.finditer(text):
            n = digits(m[0])
            if 14 <= len(n) <= 19 and luhn(n):
                out.append(("card", *m.span()))
        if "+" in text:
            out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 10 <= len(digits(m[0])) <= 15]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


# Generators of proposals: looser than the base on purpose.
_WORDY_AT = re.compile(r"\s?[\[({]\s?(?:at|AT|At)\s?[\])}]\s?")
_WORDY_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\s?(?:\.|[\[({]\s?(?:dot|DOT|Dot)\s?[\])}])\s?[A-Za-z0-9-]++)++")
_ASSIGNED = re.compile(r"(?i)(?:pass(?:word|wd)?|pwd|secret|token|api[_-]?key|key|credential)s?[\"']?\s?[:=]\s?[\"'`]?")
_VALUE = re.compile(r"[^\s\"'`,;]{6,}+")
_RANDOM = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+={0,2}")
_IPV6 = re.compile(r"(?<![0-9A-Za-z:.])(?:[0-9A-Fa-f]{1,4}:){2,7}(?::?[0-9A-Fa-f]{1,4}){1,6}(?![0-9A-Za-z:])")
_LOOSE_CARD = re.compile(r"(?<![0-9A-Za-z])[0-9]{3,6}(?:[ ./_-]{1,2}[0-9]{2,6}){2,5}(?![0-9A-Za-z])|(?<![0-9A-Za-z.])[0-9]{13,19}(?![0-9A-Za-z])")
_LOOSE_PHONE = re.compile(r"(?<![0-9A-Za-z+.])(?:00[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)[ .-]?|[0-9]{2,4}[ .-])[0-9]{2,4}(?:[ .-][0-9]{2,4}){1,3}(?![0-9A-Za-z])")


def wordy_emails(text: str) -> Iterator[tuple[int, int]]:
    """Addresses with the signs written out, in linear time: from each sign back over the local part."""
    end = 0
    for m in _WORDY_AT.finditer(text):
        start = m.start()
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        found = _WORDY_DOMAIN.match(text, m.end()) if start < m.start() else None
        if found:
            end = found.end()
            yield start, end


def proposals(text: str) -> list[tuple[str, int, int]]:
    out = []
    if "]" in text or ")" in text or "}" in text:
        out += [("email", *x) for x in wordy_emails(text)]
    if any(c in text for c in "0123456789"):
        if text.count(":") > 1:
            out += [("ip", *m.span()) for m in _IPV6.finditer(text)]
        out += [("card", *m.span()) for m in _LOOSE_CARD.finditer(text)]
        out += [("phone", *m.span()) for m in _LOOSE_PHONE.finditer(text)]
    found = {m.span() for m in _RANDOM.finditer(text)}
    if "=" in text or ":" in text:
        found |= {v.span() for m in _ASSIGNED.finditer(text) if (v := _VALUE.match(text, m.end()))}
    return out + [("secret", *x) for x in sorted(found)]


#: Fixed lists of context words.
_CONTEXT = {
    "email": re.compile(r"e-?mail|contact|write to|reach|address|mail", re.I),
    "ip": re.compile(r"\bip\b|ipv[46]|host|server|address|ping|subnet|gateway", re.I),
    "card": re.compile(r"card|visa|master|amex|credit|debit|payment|cvv|karte|tarjeta|carte", re.I),
    "phone": re.compile(r"phone|\btel\b|call|mobile|cell|fax|whatsapp|sms|dial|telefon|tel[eé]fono|t[eé]l[eé]phone", re.I),
    "secret": re.compile(r"pass|pwd|secret|token|key|credential|bearer|auth", re.I),
    "other": re.compile(r"order|invoice|isbn|version|\bv\d|build|date|total|price|\bid\b|serial|ref|token|hash|key|chapter|page|score|model|tracking|eur|usd|[$€£%#=]", re.I),
}


def entropy(span: str) -> float:
    """Bits a character."""
    n = np.array(list(Counter(span).values())) / len(span)
    return float(-(n * np.log2(n)).sum())


def switches(span: str) -> int:
    """Places between a letter and a digit."""
    return sum(a.isdigit() != b.isdigit() for a, b in zip(span, span[1:]))


_DATE = re.compile(r"^(?:(?:19|20)\d\d[-./ ]\d{1,2}[-./ ]\d{1,2}|\d{1,2}[-./ ]\d{1,2}[-./ ](?:19|20)\d\d)")


def describe(text: str, kind: str, a: int, b: int) -> list[float]:
    """Format and context features of a proposal."""
    span, before, after = text[a:b], text[max(0, a - WINDOW) : a], text[b : b + WINDOW // 2]
    n = digits(span)
    groups = [len(g) for g in re.split(r"[^0-9A-Za-z]+", span) if g]
    around = before + " | " + after
    char = lambda c: 0.0 if not c or c.isspace() else 1.0 if c.isalnum() else 2.0
    return [
        *(float(kind == k) for k in KINDS), len(span), len(n), len(groups), max(groups, default=0), min(groups, default=0), float(len(set(groups)) == 1),
        float(luhn(n)) if n else 0.0, sum(c.isalpha() for c in span), sum(c in "abcdefABCDEF" for c in span), span.count(":"), span.count("."), span.count("-"), span.count(" "),
        span.count("("), float(span[:1] == "("), float(n[:1] == "0"), float(n[:1] in ("3", "4", "5", "6")), float("::" in span), len(set(n)), float(bool(_DATE.match(span))),
        char(before[-1:]), char(after[:1]), float(before[-1:] in "#$€£=/\\" and bool(before)), float(bool(_CONTEXT[kind].search(around))), float(bool(_CONTEXT["other"].search(before[-20:]))),
        float(bool(re.search(r"[\[({]\s?dot\s?[\])}]", span, re.I))),
        sum(c.isupper() for c in span) / len(span), len(set(span)) / len(span), entropy(span), switches(span) / len(span), float(bool(_ASSIGNED.search(before[-20:]))), float(before[-1:] in "\"'`" and bool(before)),
        max(map(len, re.findall(r"[a-z]+|[A-Z]+", span)), default=0), span.count("/"), span.count("_"),
    ]


def carriers(docs: DataFrame, most: int = CARRIERS) -> tuple[list[str], list[str]]:
    """(snippets, long numbers with their surroundings) of at most `most` distinct texts, those of least hash; both are bounded."""
    h = docs.where("text is not null").select(F.xxhash64("text").alias("h"), "text")
    limit = h.select("h").distinct().orderBy("h").limit(most).agg(F.max("h")).first()[0]
    if limit is None:
        return [], []
    at = F.pmod(F.xxhash64("h"), F.greatest(F.length("text") - SNIPPET, F.lit(1))) + 1
    number = F.regexp_instr("text", F.lit(r"(^|[^0-9A-Za-z.])[0-9]{13,19}($|[^0-9A-Za-z])"))
    near = F.when(number > 0, F.substring("text", F.greatest(number - WINDOW, F.lit(1)), F.lit(2 * WINDOW + 20)))
    rows = h.where(F.col("h") <= limit).select("h", F.substring("text", at.cast("int"), F.lit(SNIPPET)).alias("snippet"), near.alias("near"))
    rows = rows.groupBy("h").agg(F.min("snippet").alias("snippet"), F.min("near").alias("near")).orderBy("h").collect()
    return [r["snippet"] for r in rows], [r["near"] for r in rows if r["near"]]


def lookalikes(count: int = TRAINING, seed: int = 11, snippets: list[str] | None = None) -> tuple[list[tuple[str, str, int, int]], np.ndarray]:
    """Labelled proposals: (text, kind, start, end), and whether it is personal data. They stand in snippets, or else in made-up words."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice(("ta", "no", "rel", "in", "sto", "ver", "em", "al", "ique", "ung", "er", "dos")) for _ in range(r.randint(1, 3)))
    d = lambda n: "".join(r.choice("0123456789") for _ in range(n))

    def around() -> tuple[str, str]:
        if not snippets:
            return tuple(" ".join(word() for _ in range(r.randint(2, 6))) for _ in range(2))
        words = r.choice(snippets).split(" ")
        k = r.randint(0, len(words))
        return " ".join(words[:k]), " ".join(words[k:])

    def random_string(letters: str, n: int) -> str:
        return "".join(r.choice(letters) for _ in range(n))


    def card(good: bool) -> str:
        n = r.choice("3456") + d(14)
        last = next(c for c in "0123456789" if luhn(n + c) == good) if good else r.choice([c for c in "0123456789" if not luhn(n + c)])
        return n + last

    def grouped(n: str, sep: str) -> str:
        return sep.join(n[i : i + 4] for i in range(0, len(n), 4))

    hint = {
        "email": ("email", "contact", "write to", "reach me at"), "ip": ("host", "server", "IPv6 address", "ping"),
        "card": ("card number", "visa", "credit card", "Karte"), "phone": ("phone", "call", "tel", "mobile", "fax", "Telefon"),
        "secret": ("key =", "token:", "secret =", "password:", "api_key=", "auth token ="),
    }
    lower, letters = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    wrong = ("order", "invoice", "ISBN", "version", "date", "total", "id", "serial", "ref", "page", "score", "#", "=")
    made, labels = [], []
    tries = 0
    while len(made) < count and tries < 20 * count:
        tries += 1
        good, kind = r.random() < 0.5, r.choice(KINDS)
        if kind == "email":
            at, dot = r.choice((("[at]", "[dot]"), ("(at)", "(dot)"), (" [at] ", " [dot] "), (" (at) ", "."), ("{at}", "{dot}")))
            s = f"{word()}.{word()}{at}{word()}{dot}{r.choice(('com', 'org', 'net', 'de'))}" if good else f"{word()} (at) {word()} . {word().capitalize()}"
        elif kind == "ip":
            h = lambda: f"{r.randrange(65536):x}"
            s = (":".join(h() for _ in range(8)) if r.random() < 0.5 else f"2001:db8:{h()}::{h()}") if good else r.choice((f"{d(2)}:{d(2)}:{d(2)}", f"{r.randint(1, 9)}:{d(2)}:{d(2)}", f"{d(1)}:{d(1)}:{d(1)}:{d(1)}"))
        elif kind == "card":
            s = grouped(card(True), r.choice(("", ".", "/", "_"))) if good else r.choice((card(False), grouped(card(False), r.choice(("-", " ", "."))), d(13), d(17), f"{d(3)}.{d(3)}.{d(3)}.{d(3)}", f"978-{d(1)}-{d(4)}-{d(4)}-{d(1)}", f"{d(4)} {d(4)} {d(4)}"))
        elif kind == "secret" and good:
            s = r.choice((random_string("0123456789abcdef", r.choice((24, 32, 40, 64))), random_string(letters, r.randint(20, 48)), f"{r.choice(('sk', 'pk', 'gh', 'xo'))}_{random_string(letters, r.randint(20, 40))}", random_string(letters + "+/", 43) + "=", random_string(letters[:26] + "0123456789", 20)))
        elif kind == "secret":
            s = r.choice(("-".join(word() + word() for _ in range(r.randint(3, 6))), "_".join(word() + word() for _ in range(4)), "/".join(word() for _ in range(8)), "".join(word().capitalize() for _ in range(6)), r.choice("-_=ax") * r.randint(20, 60), d(r.randint(20, 30)), "".join(word() for _ in range(8)), random_string(lower, 1) * 25))
        else:
            s = r.choice((f"({d(3)}) {d(3)}-{d(4)}", f"{r.choice('23456789')}{d(2)}-{d(3)}-{d(4)}", f"0{d(2)} {d(3)} {d(4)}", f"00{d(2)} {d(3)} {d(3)} {d(3)}", f"0{d(1)}.{d(2)}.{d(2)}.{d(2)}.{d(2)}")) if good else r.choice((f"20{d(2)}-{d(2)}-{d(2)}", f"{d(2)}.{d(2)}.20{d(2)}", f"{d(2)} {d(2)} {d(2)}", f"{d(3)} {d(3)} {d(3)}", f"19{d(2)} 20{d(2)} 20{d(2)}", f"{d(2)}-{d(2)}-{d(3)}", f"{d(3)}.{d(3)}.{d(2)}"))
        lead = r.choice(hint[kind]) + r.choice((": ", " ")) if r.random() < (0.6 if good else 0.12) else r.choice(wrong) + " " if r.random() < (0.02 if good else 0.5) else ""
        quote = r.choice(("", "", '"', "'")) if kind == "secret" else ""
        left, right = around()
        at = len(left) + 1 + len(lead) + len(quote)
        text = f"{left} {lead}{quote}{s}{quote}{r.choice(('.', ',', ' ', ''))} {right}"
        hits = [p for p in proposals(text) if p[0] == kind and p[1] < at + len(s) and p[2] > at]
        for k, a, b in hits[:1]:
            made.append((text, k, a, b))
            labels.append(good and b - a >= 0.8 * len(s))
    return made, np.array(labels, float)


def natural(near: list[str]) -> tuple[list[tuple[str, str, int, int]], np.ndarray]:
    """The corpus's own long numbers, by their check digit: card proposals that are cards, and those that are not."""
    made = [(t, *p) for t in near for p in proposals(t) if p[0] == "card" and 13 <= len(digits(t[p[1] : p[2]])) <= 19 and not any(x < p[2] and p[1] < y for _, x, y in base_spans(t))]
    return made, np.array([luhn(digits(t[a:b])) for t, _, a, b in made], float)


def model(snippets: list[str] | None = None, near: list[str] | None = None) -> tuple[Boosted, Isotonic, dict[str, float]]:
    """Trees, calibration, and each kind's threshold."""
    made, y = lookalikes(snippets=snippets)
    more, labels = natural(near or [])
    made, y = made + more, np.concatenate((y, labels))
    x = np.array([describe(*m) for m in made])
    kind = np.array([KINDS.index(m[1]) for m in made])
    back = np.arange(len(y)) % 3 == 0
    trees = Boosted(trees=100, depth=4).fit(x[~back], y[~back])
    scale = Isotonic().fit(trees.margin(x[back]), y[back])
    p = scale.apply(trees.margin(x[back]))
    limits = {}
    for k, name in enumerate(KINDS):
        own, yes = p[kind[back] == k], y[back][kind[back] == k]
        limits[name] = threshold(own, yes)
    return trees, scale, limits


def threshold(p: np.ndarray, y: np.ndarray, precision: float = PRECISION) -> float:
    """The least probability from which on the precision is reached; above 1 if none is."""
    order = np.argsort(-p, kind="stable")
    last = np.flatnonzero(np.append(np.diff(p[order]) != 0, True)) if len(p) else np.zeros(0, int)
    good = last[np.cumsum(y[order])[last] / (last + 1) >= precision] if len(p) else last
    return float(p[order][good[-1]]) if len(good) else 1.1


def fitted(docs: DataFrame) -> tuple[Boosted, Isotonic, dict[str, float]]:
    """The model for a corpus."""
    return model(*carriers(docs))


def chosen(text: str, base: list[tuple[str, int, int]], trained) -> list[tuple[str, int, int]]:
    """Proposals above their kind's threshold, best first, that touch neither a base span nor each other."""
    found = proposals(text)
    if not found:
        return []
    trees, scale, limits = trained
    p = scale.apply(trees.margin(np.array([describe(text, *f) for f in found])))
    taken = [(a, b) for _, a, b in base]
    out = []
    for k in np.argsort(-p, kind="stable"):
        kind, a, b = found[k]
        if p[k] >= limits[kind] and not any(a < y and x < b for x, y in taken):
            taken.append((a, b))
            out.append(found[k])
    return out


def written(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2])))


def find(docs: DataFrame) -> DataFrame:
    """One row per document, by SCHEMA."""
    trained = fitted(docs)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for text in pdf["text"]:
                text = text or ""
                base = base_spans(text)
                more = chosen(text, base, trained)
                rows.append((*(sum(k == kind for k, _, _ in base) for kind in BASE_KINDS), hashlib.sha256(written(base).encode()).hexdigest(), written(base + more), len(more), len(base) + len(more)))
            out = pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")][1:])
            out.insert(0, "doc_id", pdf["doc_id"].astype("Int64").to_numpy())
            yield out

    return docs.select("doc_id", "text").mapInPandas(run, SCHEMA)


def redact(docs: DataFrame) -> DataFrame:
    """`docs` with every span in text replaced by its kind in brackets; null stays null, other columns stay as they are."""
    trained = fitted(docs)

    @F.pandas_udf("string")
    def clean(texts: pd.Series) -> pd.Series:
        def one(text):
            if text is None:
                return None
            base = base_spans(text)
            out, at = [], 0
            for kind, a, b in sorted(base + chosen(text, base, trained), key=lambda s: (s[1], -s[2])):
                if a >= at:
                    out += [text[at:a], f"[{kind}]"]
                    at = b
                elif b > at:
                    at = b
            return "".join(out) + text[at:]

        return texts.map(one)

    return docs.withColumn("text", clean("text"))
