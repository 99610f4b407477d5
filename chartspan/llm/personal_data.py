"""Personal data: rules, and boosted trees over the spans that high-recall generators propose (operator 4)."""

from __future__ import annotations

import bisect
import functools
import hashlib
import itertools
import random
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartspan.llm import boosting, personal_numbers

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int, int]  # start, end, number of the kind
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")  # a run of digits is whole or not at all: linear on long runs
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NUMBER = re.compile(r"[+(]?[0-9](?:[ ().\-/]{0,2}[0-9])++")
_DIGITS = re.compile(r"[0-9]+")
_CUT_BEFORE, _CUT_AFTER = re.compile(r"[0-9]([ ().\-/]{0,2})\Z"), re.compile(r"[(]?([ ().\-/]{0,2})[0-9]")
_AT = re.compile(r" ?(?:\(at\)|\[at\]| at ) ?[A-Za-z0-9-]{1,63}(?:(?: ?(?:\(dot\)|\[dot\]| dot ) ?|\.)[A-Za-z0-9-]{1,63})+", re.IGNORECASE)
#: Neighbouring words that speak for a kind, and for none.
CUES = (
    ("mail", "email", "contact", "write", "reach", "reply"),
    ("ip", "server", "host", "address", "client", "ping"),
    ("card", "visa", "mastercard", "amex", "credit", "payment", "paid", "debit", "expires", "exp"),
    ("phone", "phones", "tel", "telefon", "telephone", "call", "calls", "ring", "dial", "mobile", "cell", "handy", "fax", "hotline", "whatsapp", "sms", "reach", "contact", "ext"),
)
#: Endings of addresses that are spelled out.
TOPS = ("com", "org", "net", "edu", "gov", "info", "example", "io", "eu", "de", "fr", "es", "it", "nl", "ch", "at", "uk", "us", "ca", "au", "jp", "cn", "br")
COUNTER_CUES = ("version", "isbn", "order", "invoice", "page", "pages", "year", "article", "section", "id", "no", "number", "price", "score", "figure", "table", "serial", "doi", "release")
CONTEXT = 32
#: Digits of the longest number that is proposed as a part of a run, and proposals that are looked at together.
MOST_DIGITS, AT_ONCE = 19, 20_000
#: Numbers of a text beyond which its proposals are made and judged as arrays.
FEW = 48
#: Examples that the trees are fitted on, half of them held out for the thresholds, and the precision these must show: the lower
#: end of its 95 % interval (Wilson's, of one side), so that a lucky run of few spans sets no threshold.
EXAMPLES, PRECISION, SURE = 12_000, 0.97, 1.64
#: A threshold's least value, however good the spans below it look.
LEAST = 0.5


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def _run_start(text: str, end: int, least: int) -> int:
    """Where the run of LOCAL characters that ends before `end` starts, at `least` or later."""
    while end > least:
        low = max(least, end - 256)
        stays = len(text[low:end].rstrip(LOCAL))
        end = low + stays
        if stays:
            break
    return end


def base_spans(text: str) -> list[Span]:
    """The rules: leftmost non-overlapping matches per kind, less those that fail their test; by start, then kind."""
    found: list[Span] = []
    at, done = text.find("@"), 0
    while at >= 0:
        start = _run_start(text, at, done)
        if start < at and (m := _DOMAIN.match(text, at)):
            done = m.end()
            found.append((start, done, 0))
        at = text.find("@", max(at + 1, done))
    found += [(*m.span(), 1) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append((*m.span(), 2))
    if "+" in text:
        found += [(*m.span(), 3) for m in _PHONE.finditer(text) if 10 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(found, key=lambda s: (s[0], s[2], s[1]))


def disjoint(spans: list[Span]) -> list[tuple[int, int]]:
    """The spans' text as intervals that don't overlap, by start."""
    out: list[tuple[int, int]] = []
    for a, b, _ in sorted(spans):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _overlaps(taken: list[tuple[int, int]], start: int, end: int) -> bool:
    """Whether one of the disjoint intervals, ordered by start, overlaps start to end."""
    k = bisect.bisect_left(taken, (end, 0))
    return k > 0 and taken[k - 1][1] > start


def _numbers(text: str, run: tuple[int, int], taken: list[tuple[int, int]]) -> list[Span]:
    """Proposals of a run of numbers: all of it and its parts from group to group, longer ones first. What is taken cuts it."""
    groups, pieces = [m.span() for m in _DIGITS.finditer(text, *run)], [[]]
    for g in groups:
        if _overlaps(taken, *g):
            pieces.append([])
        else:
            pieces[-1].append(g)
    found: list[Span] = [(*run, 1)] if text.count(".", *run) == 3 and not _overlaps(taken, *run) else []
    for piece in pieces:
        for i, (first, _) in enumerate(piece):
            n = 0
            for j in range(i, len(piece)):
                n += piece[j][1] - piece[j][0]
                if n > MOST_DIGITS:
                    break
                end = piece[j][1]
                opened = first > run[0] and (text[first - 1] == "+" or text[first - 1] == "(" and (")" in text[first:end] or len(piece) == j + 1 - i == len(groups)))
                start = first - 1 if opened and not _overlaps(taken, first - 1, first) else first
                if 7 <= n <= 16:
                    found.append((start, end, 3))
                if n >= 12:
                    found.append((start, end, 2))
                if j - i == 3 and (start, end) != run and text.count(".", start, end) == 3:
                    found.append((start, end, 1))
    return sorted(found, key=lambda s: s[0] - s[1])


def candidates(text: str, base: list[Span] | None = None) -> list[Span]:
    """Proposals, overlapping ones too: anything that looks like a number of some length, parts of runs of numbers, and
    spelled-out addresses. None overlaps the rules' spans, given as base."""
    found: list[Span] = []
    taken = disjoint(base or [])
    for m in _NUMBER.finditer(text):
        found += _numbers(text, m.span(), taken)
    return found + list(_spelled(text, taken))


def _spelled(text: str, taken: list[tuple[int, int]]) -> Iterator[Span]:
    """Spelled-out addresses."""
    if "at" in text.lower():
        for m in _AT.finditer(text):
            start = _run_start(text, m.start(), 0)
            if start < m.start() and not _overlaps(taken, start, m.end()):
                yield start, m.end(), 0


def features(text: str, span: Span) -> list[float]:
    start, end, kind = span
    value, before, after = text[start:end], text[max(0, start - CONTEXT) : start], text[end : end + CONTEXT]
    words = set(re.findall(r"[a-z]+", f"{before} {after}".lower()))
    near = set(re.findall(r"[a-z]+", before.lower())[-2:])
    digits = "".join(c for c in value if c in "0123456789")
    groups = re.findall(r"[0-9]+", value)
    goes_on = _CUT_BEFORE.search(before), _CUT_AFTER.match(after)
    return [
        *(float(kind == k) for k in range(4)),
        *(float(bool(near & set(c))) for c in CUES),
        *(float(bool(words & set(c))) for c in CUES),
        float(bool(near & set(COUNTER_CUES))), float(bool(words & set(COUNTER_CUES))),
        len(value), len(digits), len(groups), max(map(len, groups), default=0), min(map(len, groups), default=0),
        *(float(value.count(c)) for c in " -./("),
        float(value[:1] == "+"), float(value[:1] == "("), float(value[:2] == "00"),
        float(len(digits) >= 12 and luhn(digits)), float(all(len(g) <= 3 and int(g) <= 255 for g in groups[:4])),
        float(any(len(g) == 4 and g[:2] in ("19", "20") for g in groups)), float(len(set(digits)) <= 2),
        float(before[-1:].isalnum()), float(after[:1].isalnum()), float(before[-1:] in ("$", "€", "#", "v", ".", "=", "/")), float(after[:1] in ("%", "€", "/", ".") and after[1:2].isalnum()),
        *(float(bool(m)) for m in goes_on), *(float(bool(m) and " " not in m[1]) for m in goes_on),
        float(value.lower().split(".")[-1].split(" ")[-1] in TOPS), float(bool(digits) and digits[0] in "3456"), float(len(digits) in (13, 15, 16)), float(digits[:1] == "0"),
        float([len(g) for g in groups] in ([3, 3, 4], [1, 3, 3, 4])), float([len(g) for g in groups] in ([4, 4, 4, 4], [4, 6, 5], [13], [15], [16])), float(len(set(map(len, groups[1:]))) == 1 and len(groups) > 3),
        len(groups[0]) if groups else 0, len(groups[-1]) if groups else 0, len(set(re.split(r"[0-9]+", value)[1:-1])),
        float("(at)" in value.lower() or "[at]" in value.lower()), float(" dot " in value.lower() or "dot)" in value.lower() or "dot]" in value.lower()),
    ]


def _example(r: random.Random) -> tuple[str, Span, int]:
    """A made-up text with a proposed span and whether it is personal data; kinds, formats and neighbours vary."""
    word = lambda: "".join(r.choice("abcdefghiklmnoprstuvw") for _ in range(r.randint(2, 9)))
    many = lambda n: " ".join(word() for _ in range(n))
    number = lambda *sizes: [str(r.randint(10 ** (n - 1), 10**n - 1)) for n in sizes]
    kind, true = r.choice((0, 1, 2, 2, 3, 3, 3)), r.random() < 0.5
    clear = False  # whether a true value speaks for itself
    if kind == 0:
        at, dot = (r.choice([" (at) ", "(at)", " [at] ", "[at]", " at "]), r.choice([" (dot) ", " [dot] ", " dot ", "."])) if true else (" at ", ".")
        clear = "(" in at or "[" in at
        value = word() + at + word() + (dot + word() if r.random() < 0.3 else "") + dot + r.choice(TOPS)
        if not true:
            value = word() + r.choice([" at ", " at "]) + word() + r.choice([".", " dot "]) + r.choice([word(), word().title()])
    elif kind == 1:
        value = "-".join(number(*r.choice([(3, 2, 3, 2), (2, 3, 2, 1)]))) if not true and r.random() < 0.3 else ".".join(str(r.randint(0, 255)) for _ in range(4))
        if not true and "-" not in value and r.random() < 0.6:
            value = re.sub("[0-9]+$", str(r.randint(256, 999)), value) if r.random() < 0.5 else re.sub("^[0-9]+", str(r.randint(256, 999)), value)
        value = value + "." if false_version(r, true) else value
    elif kind == 2:
        sizes = r.choice([(4, 4, 4, 4), (4, 4, 4, 4), (4, 4, 4, 4), (4, 6, 5), (13,)])
        digits = r.choice("3456" if true or r.random() < 0.5 else "123456789") + "".join(number(sum(sizes) - 2))
        digits += next(c for c in "0123456789" if luhn(digits + c)) if true else r.choice([c for c in "0123456789" if not luhn(digits + c)])
        at = [sum(sizes[:i]) for i in range(len(sizes) + 1)]
        value = r.choice([" ", "-", "."]).join(digits[i:j] for i, j in zip(at, at[1:])) if r.random() < 0.6 else digits
        clear = len(digits) > 13
    else:
        a, b, c = number(3, 3, 4)
        two = lambda n: " ".join(f"{r.randint(0, 99):02d}" for _ in range(n))
        shape = r.randrange(14)
        clear = shape < 6
        value = [
            f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"1-{a}-{b}-{c}", f"({a}) {b} {c}", f"({a}){b}-{c}", f"({a}) {b}-{c}", f"{a} {b} {c}", f"{a}.{b}.{c}", f"0{a[:2]}/{b}{c}", f"0{a} {b}{c}", f"0{r.randint(1, 9)} {two(4)}",
            f"0{c} {a}{b}", f"00{r.randint(1, 99)} {a} {r.choice([f'{b} {c}', b + c])}", f"00 {r.randint(11, 99)} {a[:2]} {c} {number(4)[0]}",
        ][shape]
        if not true:
            value = r.choice([
                f"20{a[:2]}-0{b[0]}-1{c[0]}", f"{a}{b}{c}", f"{a} {b} {c[:3]}", f"{a[:1]} {b} {c[:3]}", f"978-{a[0]}-{b}-{c}{a[1:]}-{b[0]}", f"{a}.{b}{c}", f"{a}-{b}-{c[:3]}", f"20{a[:2]} 20{b[:2]}", f"19{a[:2]}-19{b[:2]}", f"{a[:2]}.{b[:2]}.20{c[:2]}",
                f"{c} {number(4)[0]} {number(4)[0]}", f"{c}-{a}-{c}", " ".join(number(*[r.randint(1, 3)] * r.randint(5, 8))), f"{a}000 {b}0000", f"{a}-{c}-{b}{c}", f"{a}-{b}-{c}", "".join(r.choice("0123456789") for _ in range(r.randint(7, 16))), "0" * r.randint(1, 2) + "".join(number(r.randint(9, 14))),
            ])
    broken = kind == 1 and any(int(x) > 255 for x in re.findall("[0-9]+", value)) or kind == 2 and not true  # a cue makes no address or card of it
    cued = r.random() < (0.4 if broken else 0 if not true else 0.75 if clear else 0.97)
    cue = r.choice(CUES[kind]) if cued else ""
    counter = r.choice(COUNTER_CUES) if not true and (r.random() < 0.6 or kind == 3 and re.fullmatch("[0-9]{3}-[0-9]{3}-[0-9]{4}", value)) else ""
    filler = r.choice(["", "", "is", "me", "number", "on", "us", "at", "no"]) if cue else r.choice(["", "", "is", "of"])
    lead = " ".join(x for x in (many(r.randint(0, 3)), cue or counter, filler) if x)
    lead = f"| {word()} | " if clear and not cue and r.random() < 0.3 else lead + (r.choice([" ", " ", ": ", ". "]) if lead else "")
    beside = lambda: _beside(r, number) if kind and r.random() < 0.4 else ""
    left, right = beside(), beside()
    lead += f"{left} " if left else ""
    text = f"{lead}{value}{f' {right}' if right else ''}{r.choice([' ', '. ', ', ', '', ' | '])}{many(r.randint(0, 3))}"
    span = (len(lead), len(lead) + len(value), kind)
    if kind > 1 and not true and r.random() < 0.1:  # a run of digits within a longer name
        left, right = ("".join(r.choice("0123456789abcdef") for _ in range(r.randint(1, 12))) + r.choice("abcdef") for _ in range(2))
        digits = "".join(number(r.randint(7, 16)))
        return f"{lead}{left}{digits}{right[::-1]} {many(2)}", (len(lead) + len(left), len(lead) + len(left) + len(digits), kind), 0
    if kind and r.random() < (0.5 if left or right else 0.25):
        known = {(m.start(), m.end()) for x in (left, right) if x for m in re.finditer(re.escape(x), text)} | {span[:2]}
        cut = [c for c in candidates(text) if c[0] < span[1] and span[0] < c[1] and c[:2] not in known]
        if cut:
            return text, r.choice(cut), 0
    return text, span, int(true)


def _beside(r: random.Random, number: Callable[..., list[str]]) -> str:
    """Numbers as they stand beside others in lists and tables."""
    a, b, c = number(3, 3, 4)
    return r.choice([f"20{a[:2]}-0{b[0]}-1{c[0]}", f"{a}-{b}-{c}", f"{a} {b} {c}", f"({a}) {b}-{c}", f"{a}.{b}.{c}", a, c, f"{a}.{b[:2]}", " ".join(number(*[r.randint(1, 4)] * r.randint(2, 5))), ".".join(str(r.randint(0, 255)) for _ in range(4))])


def false_version(r: random.Random, true: bool) -> bool:
    """Whether a false address is written with one part more than four."""
    return not true and r.random() < 0.3


@functools.lru_cache(2)
def trained(seed: int = 11, examples: int = EXAMPLES) -> tuple[boosting.Boosted, list[float]]:
    """(trees, a threshold for each kind): fitted on one half of `examples` made-up labelled spans; each threshold is the least
    at which the other half's spans of the kind surely show the PRECISION, and no less than LEAST."""
    r = random.Random(seed)
    made = [_example(r) for _ in range(examples)]
    x = np.array([features(t, s) for t, s, _ in made], np.float64)
    y, kind = np.array([z for _, _, z in made], np.float64), np.array([s[2] for _, s, _ in made])
    half = examples // 2
    trees = boosting.fit(x[:half], y[:half])
    p, limits = trees.probability(x[half:]), []
    for k in range(4):
        own = kind[half:] == k
        order = np.argsort(-p[own])
        n = np.arange(1, own.sum() + 1)
        right = np.cumsum(y[half:][own][order]) / n
        low = (right + SURE**2 / (2 * n) - SURE * np.sqrt(right * (1 - right) / n + SURE**2 / (4 * n**2))) / (1 + SURE**2 / n)
        ends = np.append(np.diff(p[own][order]) < 0, True)  # spans of one probability come in together
        good = np.flatnonzero((low >= PRECISION) & ends)
        limits.append(max(LEAST, float(p[own][order][good[-1]])) if len(good) else 1.1)
    return trees, limits


def _many(text: str, base: list[Span], trees: boosting.Boosted, limits: list[float]) -> list[tuple[tuple, Span]]:
    """The accepted proposals of a text of very many numbers with their keys: by arrays, a block at a time, in memory of the text's order."""
    runs, taken = [m.span() for m in _NUMBER.finditer(text)], disjoint(base)
    judge = personal_numbers.Judge(trees.probability, len(features("", (0, 0, 0))))
    least = np.array(limits)
    good = []
    for spans, rows in personal_numbers.proposals(text, runs, taken, MOST_DIGITS, CONTEXT, CUES, COUNTER_CUES):
        p = judge(rows)
        for x, (start, end, kind, run, group, turn) in zip(p[p >= least[spans[:, 2]]].tolist(), spans[p >= least[spans[:, 2]]].tolist()):
            good.append(((-x, 0, run, start - end, group, turn), (start, end, kind)))
    single = [((0, run, a - b, -1, 0), (a, b, 1)) for run, a, b in ((a, a, b) for a, b in runs) if text.count(".", a, b) == 3 and not _overlaps(taken, a, b)]
    single += [((1, i), s) for i, s in enumerate(_spelled(text, taken))]
    for at in range(0, len(single), AT_ONCE):
        some = single[at : at + AT_ONCE]
        p = trees.probability(np.array([features(text, s) for _, s in some], np.float64))
        good += [((-x, *key), s) for x, (key, s) in zip(p.tolist(), some) if x >= limits[s[2]]]
    return good


def added_spans(texts: list[str], base: list[list[Span]], model: tuple[boosting.Boosted, list[float]]) -> list[list[Span]]:
    """For each text the proposals that the trees accept and that overlap neither the rules' spans nor a likelier proposal."""
    trees, limits = model
    many = [sum(1 for _ in itertools.islice(_DIGITS.finditer(t), FEW + 1)) > FEW for t in texts]
    proposed = ((i, s) for i, t in enumerate(texts) if not many[i] for s in candidates(t, base[i]))
    good: list[list[tuple[tuple, Span]]] = [_many(t, b, trees, limits) if m else [] for t, b, m in zip(texts, base, many)]
    while some := list(itertools.islice(proposed, AT_ONCE)):
        p = trees.probability(np.array([features(texts[i], s) for i, s in some], np.float64))
        for x, (i, s) in zip(p.tolist(), some):
            if x >= limits[s[2]]:
                good[i].append(((-x, len(good[i])), s))
    out: list[list[Span]] = [[] for _ in texts]
    for i, found in enumerate(good):
        taken: list[tuple[int, int]] = []
        for _, s in sorted(found, key=lambda g: g[0]):
            if not _overlaps(taken, s[0], s[1]):
                bisect.insort(taken, s[:2])
                out[i].append(s)
    return out


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in sorted(spans, key=lambda s: (s[0], s[2], s[1])))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_email, n_ip, n_card, n_phone (of the rules), base_sha256, spans (all), n_added.

    A null text counts as empty; a text without spans has empty strings' digest and spans. Spans of one start are ordered by
    kind; of proposals that overlap, the likelier is taken, of equally likely ones the first proposed. A very long text is read whole, its
    proposals a block of numbers at a time. Null ids and repeated rows stay. Other columns are ignored. An empty table gives no rows. No row
    leaves its partition.
    """
    model = trained()

    @F.pandas_udf("n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")
    def spans(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            texts = s.fillna("").tolist()
            base = [base_spans(t) for t in texts]
            more = added_spans(texts, base, model)
            rows = [(*(sum(x[2] == k for x in b) for k in range(4)), hashlib.sha256(_joined(b).encode()).hexdigest(), _joined(b + m), len(m)) for b, m in zip(base, more)]
            yield pd.DataFrame(rows, columns=["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"])

    return docs.select(F.col(id_col), spans(F.col(text_col)).alias("m")).select(id_col, "m.*")


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with each span replaced by its kind in brackets, as [EMAIL]; of overlapping spans, the text of all goes. Null stays null."""
    model = trained()

    @F.pandas_udf("string")
    def redacted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            texts = s.fillna("").tolist()
            base = [base_spans(t) for t in texts]
            more = added_spans(texts, base, model)
            out = []
            for t, raw, b, m in zip(texts, s, base, more):
                parts, done = [], 0
                for start, end, k in sorted(b + m, key=lambda x: (x[0], x[2], x[1])):
                    if start >= done:
                        parts += [t[done:start], f"[{KINDS[k].upper()}]"]
                    done = max(done, end)
                out.append("".join(parts) + t[done:] if raw is not None else None)
            yield pd.Series(out, dtype=object)

    return docs.withColumn(text_col, redacted(F.col(text_col)))
