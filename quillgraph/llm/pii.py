"""Personal data as segments of a semi-Markov conditional random field.

A text is cut into segments: single atoms outside any entity, and whole candidate spans of a kind.
Features look at a whole span (digit counts, groups, separators, checksums, context) and a span is at
most MOST_CHARS long if of digits, so the sums over segmentations run in time linear in the text. Training
maximises the conditional likelihood of labelled sentences (made here from templates, a fixed seed);
decoding takes the best segmentation, in which the spans of the plain rules are given.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import texts

KINDS = ("email", "ip", "card", "phone")
#: Bounds of a segment of digits: no kind has more, whatever stands between them.
MOST_CHARS, MOST_DIGITS = 254, 19
TRAIN_SENTENCES, TRAIN_STEPS, SEED = 600, 60, 11

DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A match of these begins at the start of a run of digits, and possessive runs keep the search linear.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
RUN = re.compile(r"[+(]{0,2}[0-9](?:[ ().\-]{0,3}[0-9])*+")
GROUP = re.compile(r"[0-9]+")
MARK = re.compile(r"@|\(at\)|\[at\]|\{at\}|(?<=[A-Za-z0-9]) at (?=[A-Za-z0-9])", re.IGNORECASE)
_PART, _SIGN = r"[A-Za-z0-9-]+", r"\s?(?:\(dot\)|\[dot\]|\{dot\})\s?"
#: What may follow each written form of the sign: only spelt-out dots after a bare word.
RIGHT = {
    "@": re.compile(rf"\s?{_PART}(?:\.{_PART})+"),
    "(": re.compile(rf"\s?{_PART}(?:(?:\.|{_SIGN}| dot ){_PART})+", re.IGNORECASE),
    " ": re.compile(rf"{_PART}(?:(?:{_SIGN}| dot ){_PART})+", re.IGNORECASE),
}
#: Words before a number that tell its kind.
CONTEXT = {
    "phone": ("phone", "tel", "telephone", "call", "mobile", "fax", "cell", "whatsapp", "sms"),
    "card": ("card", "visa", "mastercard", "amex", "credit", "debit", "pan"),
    "ip": ("ip", "host", "server", "address", "ping", "ssh"),
    "other": ("version", "v", "release", "isbn", "order", "invoice", "section", "id", "serial", "no", "ref", "part", "item"),
}


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        n = int(c)
        total += n if k % 2 == 0 else (2 * n if n < 5 else 2 * n - 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The plain rules: leftmost non-overlapping matches per kind, those that fail a check dropped."""
    out: list[tuple[str, int, int]] = []
    at, floor = text.find("@"), 0
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append(("email", start, m.end()))
            floor = m.end()
        else:
            floor = at + 1
        at = text.find("@", floor)
    if not DIGIT.search(text):
        return out
    for m in IP.finditer(text):
        if all(len(x.lstrip("0")) <= 3 and int(x) <= 255 for x in m.group().split(".")):
            out.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(GROUP.sub("", m.group()) and DIGIT.findall(m.group())) <= 15:
                out.append(("phone", *m.span()))
    return out


def candidates(text: str) -> Iterator[tuple[str, int, int]]:
    """Spans that may be personal data: the only segments of entity kinds that the model scores."""
    floor = 0
    for m in MARK.finditer(text):
        end = m.start() - (m.start() > floor and text[m.start() - 1].isspace())
        start = end
        while start > floor and text[start - 1] in LOCAL:
            start -= 1
        floor = m.end()
        right = RIGHT[m.group()[0] if m.group()[0] in "@ " else "("].match(text, m.end()) if start < end else None
        if right:
            yield "email", start, right.end()
    if not DIGIT.search(text):
        return
    for m in RUN.finditer(text):
        groups = [g.span() for g in GROUP.finditer(m.group())]
        for i in range(len(groups)):
            n = 0
            for j in range(i, len(groups)):
                n += groups[j][1] - groups[j][0]
                a, b = m.start() + groups[i][0], m.start() + groups[j][1]
                if n > MOST_DIGITS or b - a > MOST_CHARS:
                    break
                if j - i == 3 and 4 <= n <= 12:
                    yield "ip", a, b
                if 13 <= n <= 19:
                    yield "card", a, b
                if 7 <= n <= 15:
                    while a > m.start() and text[a - 1] in "+(":
                        a -= 1
                    yield "phone", a, b


NAMES = [
    *(f"{k}:bias" for k in KINDS), "email:plain", "email:worded", "email:spaced", "email:tld", "email:short_local",
    "ip:octets", "ip:dots", "ip:spaced", "ip:context", "ip:touching", "ip:other", "ip:zero",
    "card:luhn", "card:16", "card:15", "card:fours", "card:single", "card:iin", "card:context", "card:touching", "card:same", "card:other", "card:odd_groups",
    "phone:plus", "phone:paren", "phone:digits10", "phone:digits11", "phone:digits12", "phone:digits7", "phone:single", "phone:groups3", "phone:groups4", "phone:many", "phone:context", "phone:touching", "phone:date", "phone:dots", "phone:octets", "phone:other", "phone:zero", "phone:part", "card:part", "ip:part",
]
INDEX = {n: k for k, n in enumerate(NAMES)}
DATE = re.compile(r"(?:[0-9]{1,2}([./-])[0-9]{1,2}\1[0-9]{2,4}|[0-9]{4}([./-])[0-9]{1,2}\2[0-9]{1,2})\b")


def features(text: str, kind: str, a: int, b: int) -> list[int]:
    """Names of what holds for the whole span, as indices."""
    s, out = text[a:b], [f"{kind}:bias"]
    if kind == "email":
        low = s.lower()
        out.append("email:plain" if "@" in s and " " not in s else "email:worded")
        if " at " in low and "dot" not in low:
            out.append("email:spaced")
        if re.search(r"[a-z]{2,6}$", low):
            out.append("email:tld")
        if len(re.match(r"[A-Za-z0-9._%+-]*", s).group()) < 3:
            out.append("email:short_local")
        return [INDEX[n] for n in out]
    digits, groups = "".join(GROUP.findall(s)), GROUP.findall(s)
    n = len(digits)
    before, after = text[max(0, a - 24) : a], text[b : b + 2]
    words = re.findall(r"[A-Za-z]+", before)[-2:]
    word = [w.lower() for w in words]
    if any(w in CONTEXT[kind] for w in word):
        out.append(f"{kind}:context")
    if any(w in CONTEXT["other"] for w in word):
        out.append(f"{kind}:other")
    if (before[-1:].isalnum() or before[-1:] in "#_=/\"'" and before) or after[:1].isalnum() or after[:1] in ("_", "/", '"', "'"):
        out.append(f"{kind}:touching")
    if re.match(r"[ .\-]?[0-9]", after) or re.search(r"[0-9][ .\-]?$", before):
        out.append(f"{kind}:part")
    octets = len(groups) == 4 and all(len(g) <= 3 and int(g) <= 255 for g in groups)
    if kind == "ip":
        out += [f for f, yes in (("ip:octets", octets), ("ip:dots", s.count(".") == 3), ("ip:spaced", " " in s), ("ip:zero", groups[0] == "0")) if yes]
    elif kind == "card":
        sizes = [len(g) for g in groups]
        checks = (("card:luhn", luhn(digits)), ("card:16", n == 16), ("card:15", n == 15), ("card:fours", sizes == [4, 4, 4, 4] or sizes == [4, 6, 5]), ("card:single", len(groups) == 1), ("card:iin", digits[0] in "3456"), ("card:same", len(set(digits)) <= 2), ("card:odd_groups", len(groups) > 1 and sizes not in ([4, 4, 4, 4], [4, 6, 5])))
        out += [f for f, yes in checks if yes]
    else:
        checks = (("phone:plus", "+" in s), ("phone:paren", "(" in s and ")" in s), ("phone:digits10", n == 10), ("phone:digits11", n == 11), ("phone:digits12", n >= 12), ("phone:digits7", n <= 9), ("phone:single", len(groups) == 1), ("phone:groups3", len(groups) == 3), ("phone:groups4", len(groups) == 4), ("phone:many", len(groups) > 5), ("phone:date", bool(DATE.match(s))), ("phone:dots", "." in s), ("phone:octets", octets and "." in s), ("phone:zero", s.startswith("0")))
        out += [f for f, yes in checks if yes]
    return [INDEX[f] for f in out]


def _sentence(rnd: random.Random) -> tuple[str, list[tuple[str, int, int]]]:
    """A labelled sentence: fillers, perhaps an entity in one of its written forms, perhaps a number of another kind."""
    d = lambda n: "".join(rnd.choice("0123456789") for _ in range(n))
    w = lambda: "".join(rnd.choice(("an", "er", "in", "th", "on", "re", "la", "de", "ch", "ou")) for _ in range(rnd.randint(1, 4)))
    octet = lambda: str(rnd.randint(1, 255))
    sep = rnd.choice((" ", "-", " "))

    def card() -> str:
        body = rnd.choice("3456") + d(14)
        body += next(c for c in "0123456789" if luhn(body + c))
        if rnd.random() < 0.3:  # called a card, a mistyped one is one too
            return rnd.choice(("card ", "visa ")) + (body if rnd.random() < 0.5 else unlucky(16))
        return body if rnd.random() < 0.5 else sep.join(body[k : k + 4] for k in range(0, 16, 4))

    def unlucky(n: int) -> str:
        """As many digits as a card has, with a wrong check digit."""
        body = d(n - 1)
        return body + rnd.choice([c for c in "0123456789" if not luhn(body + c)])

    def email() -> str:
        at, dot = rnd.choice((("@", "."), (" (at) ", " (dot) "), ("[at]", "[dot]"), (" at ", " dot "), (" @ ", "."), ("(at)", ".")))
        return f"{w()}.{d(2)}{at}{w()}{dot}{rnd.choice(('com', 'org', 'net', 'de'))}"

    def phone() -> str:
        return rnd.choice((f"+{d(1)} ({d(3)}) {d(3)}-{d(4)}", f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"+{d(2)} {d(3)} {d(4)} {d(3)}", f"{d(3)}.{d(3)}.{d(4)}", f"tel {d(10)}", f"call 0{d(3)} {d(7)}", f"1-{d(3)}-{d(3)}-{d(4)}"))

    def ip() -> str:
        j = rnd.choice((".", ".", ".", " . ", "[.]"))
        return ("." if j == "[.]" else j).join(octet() for _ in range(4))

    other = (
        lambda: f"{rnd.randint(1900, 2030)}-{rnd.randint(10, 12)}-{rnd.randint(10, 28)}", lambda: f"{d(2)}.{d(2)}.20{d(2)}", lambda: f"version {d(1)}.{d(1)}.{d(2)}.{rnd.randint(256, 9999)}",
        lambda: f"${d(1)},{d(3)}.{d(2)}", lambda: f'token = "{"".join(rnd.choice("0123456789abcdef") for _ in range(40))}"', lambda: f"{d(4)}", lambda: f"ISBN 978-{d(1)}-{d(4)}-{d(4)}-{d(1)}", lambda: f"order {d(8)}", lambda: f"id {d(12)}", lambda: f"{d(2)} {d(2)} {d(2)} {d(2)} {d(2)}",
        lambda: f"{w()} at {w()} ", lambda: f"ref {d(9)}", lambda: f"{d(5)}-{d(4)}", lambda: f"{d(8)}", lambda: f"{d(1)}.{d(1)}.{d(1)}", lambda: f"no {d(13)}", lambda: f"{d(6)} {d(6)}", lambda: f"{d(22)}", lambda: f"{w()}@{w()}",
        lambda: unlucky(16), lambda: unlucky(rnd.randint(13, 19)), lambda: sep.join(map("".join, zip(*[iter(unlucky(16))] * 4, strict=True))), lambda: f"no {unlucky(16)}",
        lambda: f"x{d(rnd.randint(13, 19))}{w()}", lambda: f"{w()}{d(11)}e", lambda: f"{d(16)}{w()}", lambda: f"{w()}_{d(10)}",
    )
    make = {"email": email, "ip": ip, "card": card, "phone": phone}
    text, marks = "", []
    for _ in range(rnd.randint(1, 3)):
        text += " ".join(w() for _ in range(rnd.randint(1, 4))) + " "
        if rnd.random() < 0.6:
            kind = rnd.choice(KINDS)
            said = make[kind]()
            skip = 4 if said.startswith("tel ") else 5 if said.startswith(("call ", "card ", "visa ")) else 0
            marks.append((kind, len(text) + skip, len(text) + len(said)))
            text += said + rnd.choice((" ", ", ", ". ", "!! ", "*** "))
        else:
            text += rnd.choice(other)() + " "
    return text + w(), marks


@lru_cache(maxsize=1)
def weights() -> tuple[float, ...]:
    """Train: gradient ascent on the conditional log-likelihood, expectations by forward and backward sums."""
    rnd = random.Random(SEED)
    data = []
    for _ in range(TRAIN_SENTENCES):
        text, marks = _sentence(rnd)
        cand = sorted(set(candidates(text)), key=lambda c: (c[2], c[1], c[0]))
        x = np.zeros((len(cand), len(NAMES)))
        for k, c in enumerate(cand):
            x[k, features(text, *c)] = 1
        gold = np.array([c in set(marks) for c in cand], float)
        data.append((x, gold, cand))
    v, grad2 = np.zeros(len(NAMES)), np.full(len(NAMES), 1e-6)
    for _ in range(TRAIN_STEPS):
        g = -0.5 * v
        for x, gold, cand in data:
            if len(cand):
                g += (gold - _marginals(x @ v, cand)) @ x
        grad2 += g * g
        v += 1.5 * g / np.sqrt(grad2)
    return tuple(v.tolist())


def _marginals(score: np.ndarray, cand: list[tuple[str, int, int]]) -> np.ndarray:
    """Probability of each candidate segment; segments outside entities score nothing."""
    cuts = sorted({p for _, a, b in cand for p in (a, b)})
    at = {p: k for k, p in enumerate(cuts)}
    span = [(at[a], at[b]) for _, a, b in cand]
    w = np.exp(np.clip(score, -40, 40))
    n = len(cuts)
    forward, backward = [1.0] + [0.0] * (n - 1), [0.0] * (n - 1) + [1.0]
    by_end: dict[int, list[int]] = {}
    by_start: dict[int, list[int]] = {}
    for k, (i, j) in enumerate(span):
        by_end.setdefault(j, []).append(k)
        by_start.setdefault(i, []).append(k)
    for j in range(1, n):
        forward[j] = forward[j - 1] + sum(forward[span[k][0]] * w[k] for k in by_end.get(j, ()))
    for i in range(n - 2, -1, -1):
        backward[i] = backward[i + 1] + sum(backward[span[k][1]] * w[k] for k in by_start.get(i, ()))
    return np.array([forward[i] * w[k] * backward[j] / forward[-1] for k, (i, j) in enumerate(span)])


def decode(text: str, given: list[tuple[str, int, int]], v: tuple[float, ...]) -> list[tuple[str, int, int]]:
    """The best segmentation's entity spans besides those given: dynamic programming over span ends."""
    taken = sorted((a, b) for _, a, b in given)
    starts, tops, top = [a for a, _ in taken], [], 0
    for _, b in taken:
        top = max(top, b)
        tops.append(top)
    free: list[tuple[int, int, float, str]] = []
    for kind, a, b in set(candidates(text)):
        k = bisect_left(starts, b)
        if k and tops[k - 1] > a:
            continue
        score = sum(v[f] for f in features(text, kind, a, b))
        if score > 0:  # a segment that lowers the sum is in no best segmentation
            free.append((b, a, score, kind))
    free.sort()
    ends: list[int] = [0]
    best: list[tuple[float, int, int]] = [(0.0, -1, -1)]  # score, candidate, state before
    for c, (b, a, score, _) in enumerate(free):
        before = bisect_left(ends, a + 1) - 1
        value = best[before][0] + score
        if value > best[-1][0]:
            ends.append(b)
            best.append((value, c, before))
    out, k = [], len(best) - 1
    while best[k][1] >= 0:
        b, a, _, kind = free[best[k][1]]
        out.append((kind, a, b))
        k = best[k][2]
    return out


def spans(text: str, v: tuple[float, ...]) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(spans of the plain rules, all spans), by kind and start."""
    order = lambda s: (KINDS.index(s[0]), s[1], s[2])
    base = sorted(base_spans(text), key=order)
    return base, sorted(base + decode(text, base, v), key=order)


def joined(found: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in found)


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the plain rules' spans, their digest, and all spans of every row.

    Null and empty texts have none. Repeated rows and null ids give a row each. Other columns are not
    read. Offsets count code points."""
    shared = docs.sparkSession.sparkContext.broadcast(weights())  # one number a feature

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        for batch in batches:
            rows = [spans(t, v) for t in batch.column("text").to_pylist()]
            counts = [pa.array([sum(s[0] == k for s in base) for base, _ in rows], pa.int64()) for k in KINDS]
            digests = pa.array([hashlib.sha256(joined(base).encode()).hexdigest() for base, _ in rows], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *counts, digests, pa.array([joined(full) for _, full in rows], pa.string())], names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    return texts(docs).mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def masked(docs: DataFrame) -> DataFrame:
    """The rows of docs with each span of personal data in `text` replaced by its kind; n_chars follows.

    A null text stays null. Every column and row stays."""
    shared = docs.sparkSession.sparkContext.broadcast(weights())

    def mask(text: str | None, v: tuple[float, ...]) -> str | None:
        if not text:
            return text
        out, at = [], 0
        for kind, a, b in sorted(spans(text, v)[1], key=lambda s: (s[1], -s[2])):
            if a >= at:
                out += [text[at:a], f"<{kind}>"]
            at = max(at, b)
        return "".join([*out, text[at:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = batch.schema.get_field_index("text")
            made = pa.array([mask(t, shared.value) for t in batch.column(k).to_pylist()], batch.schema.field(k).type)
            yield batch.set_column(k, batch.schema.field(k), made)

    out = docs.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


