"""Personal data: fixed base formats, and candidate spans that boosted trees judge."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import string
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .boosting import Boosted, least_threshold
from .common import batches, release, table

KINDS = ("email", "ip", "card", "phone")
#: A kind that only candidates have, none of them base: keys, tokens, passwords.
SECRET = "secret"
LOCAL = string.ascii_letters + string.digits + "._%+-"
_domain = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_ip = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_card = re.compile(r"[0-9]([\x20-]?[0-9])+")
_phone = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_digit = re.compile(r"[0-9]")
Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = sum(int(d) if i % 2 == 0 else (2 * int(d) - 9 if d > "4" else 2 * int(d)) for i, d in enumerate(reversed(digits)))
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """The spans of the fixed formats, by kind as in KINDS, then by start; leftmost and non-overlapping within a kind.

    Every pattern is met in time linear in the text: an e-mail's local part is the run of its characters before an @,
    so it is measured back from there instead of from every place of the run.
    """
    found: list[Span] = []
    low = 0  # the last match's end, or the place after the last @, which no local part crosses
    at = text.find("@")
    while at >= 0:
        head = text[low:at]
        run = len(head) - len(head.rstrip(LOCAL))
        low = at + 1
        if run and (m := _domain.match(text, at + 1)):
            found.append(("email", at - run, m.end()))
            low = m.end()
        at = text.find("@", low)
    if not _digit.search(text):
        return found
    found += [("ip", *m.span()) for m in _ip.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m.group().split("."))]
    for m in _card.finditer(text):
        if 13 <= m.end() - m.start():
            digits = m.group().replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                found.append(("card", *m.span()))
    if "+" in text:
        found += [("phone", *m.span()) for m in _phone.finditer(text) if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
    return found


#: High-recall generators: what stands in a text for a generator to be tried, and its pattern, which looks
#: ahead so that spans may overlap. Each is bounded.
_at, _dot = r"(?:[ ]?[(\[{][ ]?at[ ]?[)\]}][ ]?|[ ]at[ ]|[ ]?@[ ]?)", r"(?:[ ]?[(\[{][ ]?dot[ ]?[)\]}][ ]?|[ ]dot[ ]|\.)"
_named = r"(?:api[ _-]?key|access[ _-]?key|token|secret|passw(?:or)?d|passphrase|pwd|auth|credential|contraseña|passwort|mot de passe)"
GENERATORS = (
    ("email", re.compile(r"[@)\]}]|\bdot\b", re.I), re.compile(rf"(?<![\w.%+-])(?=([\w.%+-]{{1,64}}{_at}[\w-]{{1,63}}(?:{_dot}[\w-]{{1,63}}){{1,5}}))", re.I)),
    ("ip", re.compile(r"\[\.\]|\(\.\)|:"), re.compile(r"(?<![\w:])(?=((?:[0-9]{1,3}(?:\[\.\]|\(\.\)|\.)){3}[0-9]{1,3}(?![0-9])|(?:[0-9A-Fa-f]{1,4}:){3,7}:?[0-9A-Fa-f]{1,4}(?![\w:])))")),
    ("card", _digit, re.compile(r"(?<![0-9])(?=([0-9]{4}(?:[ ./_-]?[0-9]{2,6}){2,5}(?![0-9])))")),
    ("phone", _digit, re.compile(r"(?<![0-9])(?=((?:(?:00|\+)[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,5}\)|[0-9]{2,5})[ ./-]?[0-9]{2,4}(?:[ ./-]?[0-9]{2,4}){1,3}(?![0-9])))")),
    (SECRET, re.compile("[:=]|bearer", re.I), re.compile(rf"(?:{_named}[\w\" ']{{0,12}}[:=][ \"']{{0,3}}|\bbearer )([A-Za-z0-9][\w+/=.-]{{7,127}})(?![\w+/=-])", re.I)),
    (SECRET, re.compile(r"[A-Za-z0-9_]{20}"), re.compile(r"(?<![\w+/-])(?=[A-Za-z+/=_-]{0,127}[0-9])(?=[0-9+/=_-]{0,127}[A-Za-z])(?=([A-Za-z0-9][\w+/=-]{19,127})(?![\w+/=-]))")),
)
#: Generators whose shorter spans count too: a number that follows is else taken for a part of the first one. A span
#: ends with a run of digits and has at most LONGEST characters.
SHORTER = {
    "card": re.compile(r"[0-9]{4}(?:[ ./_-]?[0-9]{2,6}){2,5}"),
    "phone": re.compile(r"(?:(?:00|\+)[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,5}\)|[0-9]{2,5})[ ./-]?[0-9]{2,4}(?:[ ./-]?[0-9]{2,4}){1,3}"),
}
LONGEST = 48
#: Candidates that are judged at once.
JUDGED = 4000
_run = re.compile("[0-9]+")
_touched, _touching = re.compile(r"[0-9+)][ ]?$"), re.compile(r"[ ]?[0-9(]")
#: Words of the context that speak for or against a kind.
CUES = (
    re.compile(r"\b(?:e-?mail|mail|write|contact|reach|schreib|correo|courriel)", re.I),
    re.compile(r"\b(?:ip|host|server|ipv[46]|login|client|addr)", re.I),
    re.compile(r"\b(?:card|visa|mastercard|amex|credit|debit|payment|karte|carte|tarjeta)", re.I),
    re.compile(r"\b(?:tel|phone|call|mobile|fax|cell|whatsapp|telefon|tél|móvil|handy)", re.I),
    re.compile(rf"{_named}[\w\" ']{{0,12}}[:=][ \"']{{0,3}}$|bearer $", re.I),
    re.compile(r"\b(?:order|isbn|version|release|id|token|serial|invoice|ref|no|nr|date|page|build|key|hash|total|sum|eur|usd)\b", re.I),
)


def proposed(text: str) -> Iterator[Span]:
    """Overlapping spans that may be personal data, from every generator whose hint stands in the text: one for each
    place where a pattern can begin, and for cards and phones one for each place where it can end. Secrets are words
    after a cue, and long words of letters and digits."""
    for kind, hint, pattern in GENERATORS:
        if hint.search(text):
            for m in pattern.finditer(text):
                yield from ((kind, m.start(1), end) for end in ends(text, kind, m))


def candidates(text: str) -> list[Span]:
    return list(proposed(text))


def ends(text: str, kind: str, m: re.Match) -> list[int]:
    """Where a candidate that begins at this match can end."""
    if kind not in SHORTER:
        return [m.end(1)]
    start = m.start(1)
    stops = (r.end() for r in _run.finditer(text, start, start + LONGEST + 1) if r.end() <= start + LONGEST)
    return [e for e in stops if SHORTER[kind].fullmatch(text, start, e)]


def features(text: str, span: Span) -> list[float]:
    """Format and context of a candidate, in numbers."""
    kind, start, end = span
    body, before, after = text[start:end], text[max(0, start - 40) : start], text[end : end + 20]
    digits = re.sub("[^0-9]", "", body)
    letters = sum(c.isalpha() for c in body)
    groups = re.findall("[0-9]+", body)
    last = before[-1:] or " "
    following = after[:1] or " "
    kinds = len({c for c in body})
    return [
        *(float(kind == k) for k in (*KINDS, SECRET)), len(body), len(digits), letters, len(groups), max(map(len, groups), default=0), min(map(len, groups), default=0),
        float(luhn(digits)) if digits else 0.0, float(len(digits) in range(13, 20)), float(digits[:1] in ("3", "4", "5", "6")), float(len(groups) == 4 and all(int(g) < 256 for g in groups if len(g) < 5)),
        body.count(" "), body.count("-"), body.count("."), body.count("("), body.count(":"), body.count("/"), float("@" in body), float(bool(re.search(r"\bat\b", body, re.I))), float(bool(re.search(r"\bdot\b", body, re.I))), float(bool(re.search(r"[\[({]", body))),
        float(bool(re.search(r"(?:\.|dot[)\]} ]*)[A-Za-z]{2,6}$", body))), float(body.startswith("00")), float(body.startswith("+")), float(last.isalnum()), float(last in ".,-/#=\"'"), float(last == "+"), float(following.isalnum()), float(following in "-/\"'%"),
        float(bool(_touched.search(before))), float(bool(_touching.match(after))), float(bool(re.fullmatch("[0-9a-f]+|[0-9A-F]+", body))), kinds, sum(c.isupper() for c in body), body.count("_"),
        *(float(bool(c.search(before))) for c in CUES), float(bool(CUES[5].search(before[-12:]))), float(bool(_hash.search(before))),
    ]


_hash = re.compile(r"(?:commit|sha-?[0-9]*|md5|checksum|digest|hash|uuid|revision|etag)[\w\" ']{0,8}[:=]?[ \"']{0,3}$", re.I)


def labelled_examples(n: int, seed: int = 5) -> tuple[list[str], list[Span], list[int]]:
    """n invented contexts with a candidate each, and whether it is personal data: the labelled text of the trees.

    Positives write e-mails, addresses, cards, phone numbers and secrets in ways that the base formats miss, numbers side
    by side among them; negatives are versions, dates, prices, order numbers, hashes, coordinates, plain phrases of the
    same shapes, and spans that take too little or too much.
    """
    r = random.Random(seed)
    d = lambda k: "".join(r.choice(string.digits) for _ in range(k))
    w = lambda: "".join(r.choice(["an", "er", "the", "lo", "mi", "ka", "ten", "sh", "ou"]) for _ in range(r.randint(1, 4)))
    octet = lambda: str(r.randint(1, 255))

    def card(good: bool) -> str:
        body = r.choice("3456") + d(14)
        body += next(c for c in string.digits if luhn(body + c) == good)
        return body

    grouped = lambda s, sep: sep.join(s[i : i + 4] for i in range(0, 16, 4))
    at, dot = lambda: r.choice([" (at) ", "[at]", " at ", " [at] ", "{at}", " @ "]), lambda: r.choice([" dot ", "[dot]", " (dot) ", "."])
    tld = lambda: r.choice(["com", "org", "net", "de", "fr", "es", "info"])
    good = {
        "email": [lambda: f"{w()}{r.choice(['.', '_', ''])}{w()}{at()}{w()} dot {tld()}", lambda: f"{w()}{r.choice(['(at)', '[at]', '{at}', ' (at) '])}{w()}{dot()}{tld()}"],
        "ip": [lambda: r.choice(["[.]", "(.)"]).join([octet(), octet(), octet(), octet()]), lambda: ":".join("%x" % r.randint(1, 65535) for _ in range(8))],
        "card": [lambda: grouped(card(True), r.choice([".", "/", "_"]))],
        "phone": [lambda: f"({d(3)}) {d(3)}-{d(4)}", lambda: f"{d(3)}-{d(3)}-{d(4)}", lambda: f"{d(3)}.{d(3)}.{d(4)}", lambda: f"00{r.randint(1, 99)} {d(3)} {d(3)} {d(4)}", lambda: f"0{d(3)}/{d(3)}{d(3)}"],
    }
    bad = {
        "email": [lambda: f"{w()} at {w()}.{w().capitalize()}", lambda: f"{w()} at {w()} dot", lambda: f"{w()} @ {w()}.{d(2)}", lambda: f"{w()} at {w()}.{w()}.{w()}"],
        "ip": [lambda: f"{r.randint(1, 20)}:{d(2)}:{d(2)}:{d(2)}", lambda: ":".join(d(2) for _ in range(4)), lambda: ".".join([d(3), d(3), str(r.randint(256, 999)), d(3)])],
        "card": [lambda: card(False), lambda: card(False), lambda: card(True), lambda: grouped(card(False), r.choice([" ", "-", "."])), lambda: f"20{d(2)}-{r.randint(10, 12)}-{r.randint(10, 28)} {d(2)}", lambda: d(r.randint(8, 18)), lambda: f"{d(4)}.{d(4)}.{d(4)}"],
        "phone": [lambda: d(r.randint(8, 17)), lambda: f"20{d(2)}-{d(2)}-{d(2)}", lambda: f"{d(2)}.{d(2)}.20{d(2)}", lambda: f"{d(3)}.{d(3)}.{d(3)}.{d(3)}", lambda: f"{d(3)} {d(3)} {d(3)}", lambda: f"978-{d(1)}-{d(3)}-{d(5)}", lambda: f"{d(3)}/{d(3)}/{d(3)}"],
    }
    hints = {"email": ["email", "write to", "contact", "mail me:", "reach us at", ""], "ip": ["host", "server", "ip", "login from", "client"], "card": ["card", "visa", "credit card", "payment with", "my card is"], "phone": ["call", "tel", "phone:", "mobile", "fax", "whatsapp"]}
    plain = ["order", "isbn", "version", "release", "id", "token =", "serial", "invoice no", "ref", "the", "and then", "on", "since", "page", "of the", "", "build"]
    tel = lambda: f"+{r.randint(1, 99)} ({d(3)}) {d(3)}-{d(4)}"
    shuffled = lambda k, of: "".join(r.choice(of) for _ in range(k))
    hexes, words = "0123456789abcdef", string.ascii_letters + string.digits
    good[SECRET] = [lambda: shuffled(40, hexes), lambda: shuffled(32, hexes), lambda: shuffled(r.randint(20, 48), words), lambda: f"{r.choice(['sk', 'pk', 'ghp', 'xoxb'])}{r.choice('_-')}{shuffled(r.randint(20, 40), words)}", lambda: shuffled(r.randint(8, 14), words)]
    bad[SECRET] = [lambda: shuffled(40, hexes), lambda: shuffled(32, hexes), lambda: f"{w()}{w()}{d(2)}", lambda: f"{w()}-{w()}-{d(3)}", lambda: f"{w()}_{w()}_{w()}{d(1)}", lambda: "-".join([shuffled(8, hexes), shuffled(4, hexes), shuffled(4, hexes), shuffled(12, hexes)]), lambda: f"v{d(1)}.{d(2)}.{d(2)}-rc{d(1)}"]
    names = ["token", "api_key", "secret", "password", "access key", "auth_token", "client_secret", "API key", "pwd"]
    texts, spans, labels = [], [], []

    def beside() -> None:
        """Two numbers side by side, which the base formats take for one: each alone is right, parts and sums are not."""
        one, two, start = r.choice([tel, lambda: grouped(card(True), r.choice(["", " ", "-"]))])(), card(True), len(head := f"{w()} {w()}{r.choice([' ', ', ', '. '])}")
        text, kind = f"{head}{one} {two} {w()} {w()}", "phone" if one[0] == "+" else "card"
        second = start + len(one) + 1
        cases = [(kind, start, start + len(one), 1), ("card", second, second + 16, 1)]
        cases += [("phone", start, second + 4, 0), ("phone", one.find("(") + start, start + len(one), 0)] if kind == "phone" else [("card", start, second + 16, 0), ("phone", second, second + 16, 0)]
        for k, a, b, y in cases:
            texts.append(text)
            spans.append((k, a, b))
            labels.append(y)

    def secret(yes: bool) -> None:
        plain = not yes and r.random() < 0.3  # a word like any other after a cue
        body = f"{w()}{w()}{w()}{w()}"[:16].ljust(8, "e") if plain else r.choice((good if yes else bad)[SECRET])()
        hint = f"{r.choice(names)}{r.choice([' = ', '=', ': ', ' = '])}{r.choice(['', chr(34), chr(39)])}" if yes or plain else r.choice(["commit ", "sha1 ", "md5: ", "checksum ", "the ", "file ", "version ", "id ", "uuid ", "", "and ", "branch ", "token of ", "keys and "])
        head = f"{w()} {w()} {hint}"
        texts.append(head + body + (hint[-1] if hint.endswith(('"', "'")) else "") + f" {w()} {w()}")
        spans.append((SECRET, len(head), len(head) + len(body)))
        labels.append(int(yes))

    while len(texts) < n:
        if (turn := r.random()) < 0.08:
            beside()
            continue
        if turn < 0.25:
            secret(r.random() < 0.45)
            continue
        kind, yes = r.choice(KINDS), r.random() < 0.45
        body = r.choice((good if yes else bad)[kind])()
        hint = r.choice(hints[kind]) if yes or kind == "email" and r.random() < 0.2 else r.choice(plain)
        head = f"{w()} {w()} {hint}{r.choice([' ', ': ', ' ']) if hint else ' '}"
        texts.append(head + body + r.choice([" ", ". ", ", ", "\n", "\" "]) + f"{w()} {w()}")
        spans.append((kind, len(head), len(head) + len(body)))
        labels.append(int(yes))
    return texts[:n], spans[:n], labels[:n]


@dataclass
class PiiModel:
    trees: Boosted
    thresholds: dict[str, float]

    def extra(self, text: str, base: list[Span]) -> list[tuple[str, int, int, float]]:
        """Judged spans with their probability: apart from the base spans and each other, likelier ones first. The time is
        in proportion to the text: marks on characters tell overlaps, and candidates are judged in lots."""
        taken = bytearray(len(text))
        for _, a, b in base:
            taken[a:b] = b"\1" * (b - a)
        likely: list[tuple[float, Span]] = []
        spans = (s for s in proposed(text) if taken.find(1, s[1], s[2]) < 0)
        while lot := list(dict.fromkeys(itertools.islice(spans, JUDGED))):
            p = self.trees.probability(np.array([features(text, s) for s in lot]))
            likely += [(-float(q), s) for q, s in zip(p, lot) if q >= self.thresholds[s[0]]]
        kept: list[tuple[str, int, int, float]] = []
        for q, s in sorted(dict.fromkeys(likely)):
            if taken.find(1, s[1], s[2]) < 0:
                taken[s[1] : s[2]] = b"\1" * (s[2] - s[1])
                kept.append((*s, round(-q, 6)))
        return kept


_models: dict = {}


def pii_model(examples: int = 6000, precision: float = 0.99, seed: int = 5) -> PiiModel:
    """Trees fitted to two thirds of the labelled examples; the rest calibrates them and sets each kind's threshold, the
    lowest that keeps `precision` there."""
    key = (examples, precision, seed)
    if key not in _models:
        texts, spans, labels = labelled_examples(examples, seed)
        x, y = np.array([features(t, s) for t, s in zip(texts, spans)]), np.array(labels, float)
        cut = len(x) * 2 // 3
        trees = Boosted().fit(x[:cut], y[:cut]).calibrate(x[cut:], y[cut:])
        p, kinds = trees.probability(x[cut:]), np.array([s[0] for s in spans[cut:]])
        _models[key] = PiiModel(trees, {k: least_threshold(p[kinds == k], y[cut:][kinds == k], precision) for k in (*KINDS, SECRET)})
    return _models[key]


def all_spans(text: str | None, model: PiiModel) -> tuple[list[Span], list[tuple[str, int, int, float]]]:
    """Base spans (score 1 by definition) and those that the trees add."""
    base = base_spans(text) if text else []
    return base, model.extra(text, base) if text else []


def redacted(text: str | None, spans: list[Span]) -> str | None:
    """The text with each span, or union of overlapping ones, replaced by the mark of its first kind, as [EMAIL]."""
    if not text:
        return text
    out, done, k = [], 0, 0
    spans = sorted(spans, key=lambda s: (s[1], -s[2]))
    while k < len(spans):
        kind, start, end = spans[k][:3]
        k += 1
        while k < len(spans) and spans[k][1] < end:
            end = max(end, spans[k][2])
            k += 1
        out += [text[done:start], f"[{kind.upper()}]"]
        done = end
    return "".join([*out, text[done:]])


def _joined(spans: list, kinds: tuple[str, ...] = KINDS) -> str:
    return ",".join(f"{s[0]}:{s[1]}:{s[2]}" for s in sorted((s for s in spans if s[0] in kinds), key=lambda s: (kinds.index(s[0]), s[1], s[2])))


def find_pii(docs: DataFrame, model: PiiModel | None = None) -> DataFrame:
    """Per row: doc_id, n_<kind> of base spans, base_sha256, spans (text: those of the four kinds), secrets (text: those
    of the kind secret), n_spans (of both together), found (array of kind, start, end, score), and redacted, the text with
    every span replaced.

    Offsets are code points, ends exclusive. Base spans have score 1; the others are the trees' choice among the
    candidates and never overlap a base span. A null text is read as empty (redacted stays null). Repeated rows and null
    ids are judged like any; other columns are not read; an empty table gives an empty one.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model or pii_model())  # some 10 KB, by rounds and depth
    kind = dict(docs.dtypes)["doc_id"]

    def told(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = sent.value
        for frame in batches(frames, "text"):
            rows = []
            for text in frame["text"]:
                base, extra = all_spans(text, own)
                counts = [sum(s[0] == k for s in base) for k in KINDS]
                found = [{"kind": s[0], "start": s[1], "end": s[2], "score": s[3] if len(s) > 3 else 1.0} for s in [*base, *extra]]
                both = [*base, *extra]
                rows.append((*counts, hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(both), _joined(both, (SECRET,)), len(both), found, redacted(text, both)))
            out = pd.DataFrame(rows, columns=[*(f"n_{k}" for k in KINDS), "base_sha256", "spans", "secrets", "n_spans", "found", "redacted"])
            out.insert(0, "doc_id", frame["doc_id"].to_numpy())
            yield out

    schema = f"doc_id {kind}, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string, secrets string, n_spans long, found array<struct<kind:string,start:int,end:int,score:double>>, redacted string"
    return docs.select("doc_id", "text").mapInPandas(told, schema)


def redact_pii(docs: DataFrame, model: PiiModel | None = None) -> DataFrame:
    """docs with text redacted and n_chars, if there is such a column, counted anew; every row and column stays. A null
    text stays null; an empty table gives an empty one. Texts alone go to Python."""
    sent = docs.sparkSession.sparkContext.broadcast(model or pii_model())

    @F.pandas_udf("string")
    def clean(texts: pd.Series) -> pd.Series:
        own = sent.value
        release()
        return pd.Series([redacted(t, [s for part in all_spans(t, own) for s in part]) if isinstance(t, str) else None for t in texts], dtype=object)

    out = docs.withColumn("text", clean("text"))
    return out.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"])) if "n_chars" in docs.columns else out


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents; null texts are empty ones, as find_pii says."""
    return find_pii(table(spark, sf_dir, "documents")).drop("found", "redacted")
