"""Personal data: base rules, and a semi-Markov conditional random field for what they miss.

The field scores candidate segments by features of the whole span and the characters around it; any other token is outside
with score 0. A segment has at most MAX_TOKENS tokens and holds a digit or an at-mark, so tokens far from those are outside in
every segmentation, and dynamic programming over the stretches around digits and at-marks chooses the same boundaries and
types as over the whole text. Weights come from maximum likelihood on generated examples, forms of
the four kinds and near misses, with exact sums over all segmentations.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from math import exp, log

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts, small_batches

KINDS = ("email", "ip", "card", "phone")
Span = tuple[str, int, int]

# ---- base rules

DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A match begins where a run of digits does, and takes whole runs: said so, a long run is read once and not from each of its digits.
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGITS = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if i % 2 == 0 else (2 * n - 9 if n > 4 else 2 * n)
    return total % 10 == 0


def octets(parts: list[str]) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in parts)


def emails(text: str) -> Iterator[Span]:
    """From each at-mark leftwards, which is linear also in texts of one endless word."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at)):
            end = m.end()
            yield "email", start, end
            at = text.find("@", end)
        else:
            at = text.find("@", at + 1)


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of each kind, by kind as listed, then start."""
    out = list(emails(text))
    if DIGITS.search(text):
        out += [("ip", *m.span()) for m in IP.finditer(text) if octets(m[0].split("."))]
        out += [("card", *m.span()) for m in CARD.finditer(text) if 16 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d)]
        out += [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= sum("0" <= c <= "9" for c in m[0]) <= 15]
    return out


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


# ---- the field

MAX_TOKENS = 24
#: Characters on either side of a trigger that can belong to its segment or its features.
REACH = 96
AT = r"(?:@|[\[({] ?at ?[\])}])"
TRIGGER = re.compile(r"[0-9]|@|[\[({] ?at ?[\])}]", re.I)
TOKEN = re.compile(r"\w+|[^\w\s]")
NUMERIC = re.compile(r"[0-9]+|[+().\-\[\]]")
# What a segment of each kind may look like at all; the weights decide between what is left.
FORMS = {
    "email": re.compile(rf"[A-Za-z0-9._%+\-]+ ?{AT} ?[A-Za-z0-9\-]+(?: ?(?:\.|[\[({{] ?dot ?[\])}}]) ?[A-Za-z0-9\-]+)+", re.I),
    "ip": re.compile(r"[0-9]{1,3}(?:(?:\.|\[\.\]|\(\.\))[0-9]{1,3}){3}"),
    "card": re.compile(r"[0-9](?:[ .\-]?[0-9]){11,18}"),
    "phone": re.compile(r"\+?\(?[0-9][0-9 ().\-]{5,20}[0-9]"),
}
#: No segment of such a form is shorter.
SHORTEST = {"ip": 7, "card": 12, "phone": 7}
GROUPS = re.compile(r"[0-9]+")


@lru_cache(maxsize=1 << 12)
def describe(kind: str, span: str, left: str, right: str) -> list[str]:
    """Features of a whole span, the character before it and the two behind it."""
    groups = GROUPS.findall(span)
    n, out = sum(map(len, groups)), [f"{kind}"]
    if left and (left.isalnum() or left in "._-"):
        out.append(f"{kind} glued left")
    if right and (right[0].isalnum() or right[0] == "-"):
        out.append(f"{kind} glued right")
    if right in (" [", " (") or right[:1] in (".", "@", "[", "(") and right[1:].isalnum():
        out.append(f"{kind} cut right")
    if left in ("-", ".", "/", ",", ":", "=") or right[:1] == "/":
        out.append(f"{kind} in a longer run")
    if kind == "email":
        tail = re.split(r"[^A-Za-z0-9]+", span)[-1] or re.split(r"[^A-Za-z0-9]+", span)[-2]
        out.append("email word tld" if tail.isalpha() and 2 <= len(tail) <= 6 else "email odd tld")
        out.append("email mark" if "@" in span else "email spelt")
        if " " in span:
            out.append("email blanks")
    elif kind == "ip":
        out.append("ip octets" if octets(groups) else "ip over")
        out.append("ip plain" if "[" not in span and "(" not in span else "ip defanged")
    elif kind == "card":
        out.append("card luhn" if luhn("".join(groups)) else "card no luhn")
        out.append(f"card digits {n if n in (15, 16) else 'odd'}")
        sizes = {len(g) for g in groups[:-1]}
        out.append("card one run" if len(groups) == 1 else "card fours" if sizes == {4} or [len(g) for g in groups] == [4, 6, 5] else "card uneven")
    else:
        shape = [len(g) for g in groups]
        out.append("phone local" if shape in ([3, 3, 4], [1, 3, 3, 4], [2, 3, 3, 4]) else "phone one run" if len(groups) == 1 else "phone other")
        out.append("phone plus" if span[0] == "+" else "phone no plus")
        if "(" in span:
            out.append("phone closed" if span.count("(") == span.count(")") == 1 else "phone open")
        elif ")" in span:
            out.append("phone open")
        if not 8 <= n <= 15:
            out.append("phone too short or long")
        if len({c for c in span if c in ".-/"}) > 1:
            out.append("phone mixed")
    return out


def candidates(text: str, tokens: list[tuple[int, int]]) -> Iterator[tuple[int, int, str]]:
    """(first token, token after the last, kind) of every segment of an allowed form."""
    words = [text[a:b] for a, b in tokens]
    numeric = [bool(NUMERIC.fullmatch(w)) for w in words]
    number = [w[0] in "0123456789" and n for w, n in zip(words, numeric, strict=True)]
    for i, w in enumerate(words):
        if number[i] or w in "+(":
            for j in range(i, min(i + MAX_TOKENS, len(words))):
                if not numeric[j] or tokens[j][1] - tokens[i][0] > REACH:
                    break
                if number[j]:
                    span = text[tokens[i][0] : tokens[j][1]]
                    for kind in KINDS[1:]:
                        if len(span) >= SHORTEST[kind] and FORMS[kind].fullmatch(span):
                            yield i, j + 1, kind
    for k, w in enumerate(words):
        spelt = w.lower() == "at" and 0 < k < len(words) - 1 and words[k - 1] in "[({" and words[k + 1] in "])}"
        if w == "@" or spelt:
            last = k + (2 if spelt else 1)
            for i in range(k - 1 - spelt, max(-1, k - 12), -1):
                for j in range(last + 2, min(i + MAX_TOKENS, len(words))):
                    span = text[tokens[i][0] : tokens[j][1]]
                    if len(span) <= REACH and FORMS["email"].fullmatch(span):
                        yield i, j + 1, "email"


def stretches(text: str) -> Iterator[tuple[int, int]]:
    """Parts of the text around triggers; what lies between has no segments."""
    start, end = 0, -1
    for m in TRIGGER.finditer(text):
        a = max(0, m.start() - REACH)
        if a > end:
            if end >= 0:
                yield start, end
            start = a
        end = min(len(text), m.end() + REACH)
    if end >= 0:
        yield start, end


def lattice(text: str, low: int, high: int) -> tuple[list[tuple[int, int]], list[tuple[int, int, str, list[str]]]]:
    tokens = [m.span() for m in TOKEN.finditer(text, low, high)]
    segments = []
    for i, j, kind in candidates(text, tokens):
        a, b = tokens[i][0], tokens[j - 1][1]
        segments.append((i, j, kind, describe(kind, text[a:b], text[a - 1 : a], text[b : b + 2])))
    return tokens, segments


def decode(text: str, weights: dict[str, float]) -> list[Span]:
    """The best segmentation of a text."""
    out: list[Span] = []
    for low, high in stretches(text):
        tokens, segments = lattice(text, low, high)
        ending: dict[int, list[tuple[int, float, str]]] = {}
        for i, j, kind, names in segments:
            if (s := sum(weights.get(f, 0.0) for f in names)) > 0:
                ending.setdefault(j, []).append((i, s, kind))
        if not ending:
            continue
        best, back = [0.0] * (len(tokens) + 1), [None] * (len(tokens) + 1)
        for j in range(1, len(tokens) + 1):
            best[j] = best[j - 1]
            for i, s, kind in ending.get(j, ()):
                if best[i] + s > best[j]:
                    best[j], back[j] = best[i] + s, (i, kind)
        j, found = len(tokens), []
        while j > 0:
            if back[j]:
                i, kind = back[j]
                found.append((kind, tokens[i][0], tokens[j - 1][1]))
                j = i
            else:
                j -= 1
        out += found[::-1]
    return out


def examples(n: int, seed: int) -> list[tuple[str, set[Span]]]:
    """Generated texts with their segments: the four kinds in several forms, and numbers and marks that are none of them."""
    rng = np.random.default_rng(seed)
    pick = lambda *x: x[int(rng.integers(len(x)))]
    num = lambda k: "".join(str(d) for d in rng.integers(0, 10, k))
    word = lambda: "".join(pick("an", "the", "er", "io", "mo", "sa", "ti", "ou", "lé") for _ in range(int(rng.integers(1, 4))))
    name = lambda: "".join(pick("ab", "ke", "lo", "mi", "ra", "st") for _ in range(int(rng.integers(1, 4))))

    def card(k: int, valid: bool) -> str:
        while luhn(d := str(rng.integers(3, 7)) + num(k - 1)) != valid:
            pass
        return d

    def fours(d: str, sep: str) -> str:
        return sep.join([d[:4], d[4:10], d[10:]] if len(d) == 15 else [d[i : i + 4] for i in range(0, len(d), 4)])

    octet = lambda: str(rng.integers(1, 256))
    host = lambda dot: dot.join([*(name() for _ in range(int(rng.integers(1, 3)))), pick("com", "org", "net", "de", "info")])
    area = lambda: str(rng.integers(200, 999))
    real = {
        "email": [lambda: f"{name()}{pick('', '.', '_')}{num(2)}@{host('.')}", lambda: f"{name()} [at] {host(' [dot] ')}", lambda: f"{name()}(at){host('.')}", lambda: f"{name()} @ {host('.')}", lambda: f"{name()}.{name()}@{host('.')}"],
        "ip": [lambda: ".".join(octet() for _ in range(4)), lambda: "[.]".join(octet() for _ in range(4)), lambda: "(.)".join(octet() for _ in range(4))],
        "card": [lambda: fours(card(16, True), pick(" ", "-", ".")), lambda: card(pick(15, 16), True), lambda: fours(card(15, True), pick(" ", "-"))],
        "phone": [lambda: f"+{rng.integers(1, 99)} ({area()}) {num(3)}-{num(4)}", lambda: f"({area()}) {num(3)}-{num(4)}", lambda: f"{area()}{(s := pick('-', '.'))}{num(3)}{s}{num(4)}", lambda: f"+{rng.integers(1, 99)} {num(3)} {num(3)} {num(4)}", lambda: f"+{num(11)}"],
    }
    none = [lambda: num(int(rng.integers(1, 13))), lambda: f"{rng.integers(1900, 2030)}-{rng.integers(10, 13)}-{rng.integers(10, 29)}", lambda: f"{rng.integers(1900, 2030)}-{rng.integers(1900, 2030)}", lambda: ".".join(num(1) for _ in range(int(rng.integers(2, 4)))), lambda: ".".join(octet() for _ in range(int(rng.integers(5, 8)))), lambda: ".".join(str(rng.integers(256, 999)) for _ in range(4)), lambda: card(16, False), lambda: fours(card(16, False), pick(" ", "-")), lambda: f"{rng.integers(1, 999)},{num(3)}.{num(2)}", lambda: f"@{name()}", lambda: f"{name()}@{name()}", lambda: f"{num(3)}-{num(2)}-{num(4)}", lambda: f"978-{num(1)}-{num(2)}-{num(6)}-{num(1)}", lambda: f"{num(3)}-{num(4)}", lambda: f"{num(2)}:{num(2)}", lambda: " ".join(num(int(rng.integers(1, 5))) for _ in range(int(rng.integers(2, 7)))), lambda: f"{num(4)}/{num(4)}", lambda: f"{num(2)}.{num(2)}.{num(4)}"]
    out = []
    for _ in range(n):
        text, gold = word(), set()
        for _ in range(int(rng.integers(1, 4))):
            text += " " + " ".join(word() for _ in range(int(rng.integers(1, 4)))) + " "
            kind = pick(*KINDS, "none", "none", "none", "none")
            piece = pick(*(none if kind == "none" else real[kind]))()
            if kind != "none":
                gold.add((kind, len(text), len(text) + len(piece)))
            text += piece + pick("", ".", ",", "###", "%%%", ";", "")
        out.append((text + " " + word(), gold))
    return out


@lru_cache(maxsize=4)
def train(n: int = 500, epochs: int = 25, seed: int = 17, rate: float = 0.4, shrink: float = 0.002) -> dict[str, float]:
    """Weights by stochastic gradient on the log likelihood: the gradient is what the gold segmentation has, less what the field expects."""
    data = []
    for text, gold in examples(n, seed):
        tokens, segments = lattice(text, 0, len(text))
        rows = [(i, j, names, (kind, tokens[i][0], tokens[j - 1][1]) in gold) for i, j, kind, names in segments]
        data.append((len(tokens), sorted(rows, key=lambda r: r[1])))
    weights: dict[str, float] = {}
    rng = np.random.default_rng(seed)
    for epoch in range(epochs):
        step = rate / (1 + epoch / 5)
        for k in rng.permutation(len(data)):
            n_tokens, rows = data[k]
            if not rows:
                continue
            scores = [sum(weights.get(f, 0.0) for f in names) for _, _, names, _ in rows]
            ahead, behind = [0.0] * (n_tokens + 1), [0.0] * (n_tokens + 1)  # log sums over segmentations before and after a token
            at = 0
            for j in range(1, n_tokens + 1):
                total = ahead[j - 1]
                while at < len(rows) and rows[at][1] == j:
                    x, y = total, ahead[rows[at][0]] + scores[at]
                    total = max(x, y) + log(1 + exp(-abs(x - y)))
                    at += 1
                ahead[j] = total
            starts = sorted(range(len(rows)), key=lambda r: -rows[r][0])
            at = 0
            for i in range(n_tokens - 1, -1, -1):
                total = behind[i + 1]
                while at < len(starts) and rows[starts[at]][0] == i:
                    x, y = total, behind[rows[starts[at]][1]] + scores[starts[at]]
                    total = max(x, y) + log(1 + exp(-abs(x - y)))
                    at += 1
                behind[i] = total
            for (i, j, names, true), s in zip(rows, scores, strict=True):
                slope = step * (true - exp(ahead[i] + s + behind[j] - ahead[-1]))
                if abs(slope) > 1e-6:
                    for f in names:
                        w = weights.get(f, 0.0)
                        weights[f] = w + slope - step * shrink * w
    return weights


def find(text: str | None, weights: dict[str, float]) -> tuple[list[Span], list[Span]]:
    """Base spans, and all: the base spans with those of the field that touch none of them."""
    if not text or not TRIGGER.search(text):
        return [], []
    base = base_spans(text)
    taken = sorted((a, b) for _, a, b in base)
    more = [(k, a, b) for k, a, b in decode(text, weights) if not any(a < y and x < b for x, y in taken)]
    return base, sorted(base + more, key=lambda s: (KINDS.index(s[0]), s[1])) if more else base


def masked(text: str | None, weights: dict[str, float]) -> str | None:
    """The text with each span replaced by its kind; overlapping spans by that of the first."""
    if not text:
        return text
    out, end = [], 0
    for kind, a, b in sorted(find(text, weights)[1], key=lambda s: (s[1], -s[2])):
        if a >= end:
            out += [text[end:a], f"<{kind.upper()}>"]
        end = max(end, b)
    return "".join([*out, text[end:]])


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Personal data of every whole text: doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans and n_spans (their number, the field's included).

    Spans are kind:start:end in code points, end exclusive. A null text counts as empty; an empty text has no spans. Repeated
    rows are scanned alike. An empty table gives no rows. Further columns are ignored.
    """
    weights = train()

    def make(texts: list[str | None]) -> tuple:
        rows = []
        for t in texts:
            base, spans = find(t, weights)
            kinds = [k for k, _, _ in base]
            rows.append((*map(kinds.count, KINDS), hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans), len(spans)))
        return None, list(zip(*rows, strict=True)) or [[]] * 7

    out = map_texts(docs, [key], text, "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long", make)
    return out.withColumnRenamed(key, "doc_id")


def mask(docs: DataFrame, text: str = "text") -> DataFrame:
    """The same rows and columns, with personal data in the text replaced by its kind.

    A null text stays null and an empty one empty. Rows with a null id and repeated rows are masked like others. An empty table gives no rows. Further
    columns may have any names.
    """
    small_batches(docs.sparkSession)
    weights = train()

    @F.pandas_udf("string")
    def clean(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: masked(t, weights))

    return docs.withColumn(text, clean(F.col(text)))
