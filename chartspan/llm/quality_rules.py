"""Quality rules: a linear-chain conditional random field labels lines, content share decides (operator 7)."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartspan.llm.common import SPACES

WINDOW, MIN_WORDS, MAX_REPEAT_PERCENT, MIN_CONTENT = 5, 10, 20, 0.5
#: Labelled documents that the field is fitted on, at most.
TRAIN_DOCS = 1200
#: Lines of each of them, at most: a stretch of lines that follow each other, from a place that the text's checksum picks.
TRAIN_LINES = 64
SYMBOLS = "#*$%&|<>"
#: Phrases of notices, lower case.
NOTICES = ("all rights reserved", "copyright", "licensed under", "license", "cookie", "terms of use", "privacy policy", "subscribe", "click here", "log in", "sign up")
BOILERPLATE, CONTENT, UNKNOWN = 0, 1, -1
#: A line of a bad document is taken as boilerplate, or as content, if the odds of its own features are so clear; else it stays open.
CLEAR = (0.35, 0.75)
FEATURES = ["one", "short", "long", "symbol_words", "capital_words", "exclaimed_words", "digit_share", "letter_share", "ends_sentence", "seen_before", "repeats_itself", "notice", "word_length"]


def counts(text: str | None) -> tuple[int, int, int, int, int]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of the whole text."""
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()
    n = len(words)
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    repeated = 0
    if n >= WINDOW:
        windows = list(zip(*(words[i:] for i in range(WINDOW))))
        if len(set(windows)) < len(windows):
            times = Counter(windows)
            starts = np.flatnonzero([times[w] > 1 for w in windows])
            steps = np.bincount(starts, minlength=n + 1) - np.bincount(starts + WINDOW, minlength=n + 1)
            repeated = int((np.cumsum(steps)[:n] > 0).sum())
    return n, len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated


def line_features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(a row of FEATURES for each line with a word, characters of each line)."""
    rows, chars, seen = [], [], set()
    for line in (text or "").split("\n"):
        words = line.strip(SPACES).split()
        if not words:
            continue
        n, size = len(words), sum(map(len, words))
        lower = line.lower()
        symbols = sum(map(line.count, SYMBOLS))
        letters = sum(map(str.isalpha, line))
        rows.append((
            1.0, n < 5, n > 12, min(1.0, symbols / n), sum(map(str.isupper, words)) / n, min(1.0, line.count("!") / n),
            sum(map(line.count, "0123456789")) / size, letters / size, words[-1][-1] in ".!?…\"'»", line in seen, 1 - len(set(words)) / n, any(x in lower for x in NOTICES), min(2.0, size / n / 8),
        ))
        chars.append(size)
        seen.add(line)
    return np.array(rows, np.float64).reshape(-1, len(FEATURES)), np.array(chars, np.int64)


class Field:
    """Two labels; weights of (label, feature), transitions and starts."""

    def __init__(self, weights: np.ndarray, moves: np.ndarray, start: np.ndarray):
        self.weights, self.moves, self.start = weights, moves, start

    @classmethod
    def default(cls) -> Field:
        """For want of labelled documents: signs of junk as they are commonly known."""
        w = np.zeros((2, len(FEATURES)))
        w[CONTENT] = [1.5, -0.5, 0.5, -5, -2.5, -4, -3, 0.5, 0.5, -2, -3, -2, 0]
        return cls(w, np.array([[0.5, -0.5], [-0.5, 0.5]]), np.zeros(2))

    def viterbi(self, x: np.ndarray) -> np.ndarray:
        """The most likely labels of a sequence of lines."""
        if not len(x):
            return np.zeros(0, np.int64)
        (m00, m01), (m10, m11) = self.moves.tolist()
        emit = (x @ self.weights.T).tolist()
        a, b = emit[0][0] + self.start[0], emit[0][1] + self.start[1]
        back = []
        for e0, e1 in emit[1:]:
            from0, from1 = b + m10 > a + m00, b + m11 >= a + m01
            a, b = e0 + (b + m10 if from0 else a + m00), e1 + (b + m11 if from1 else a + m01)
            back.append((from0, from1))
        labels = [int(b >= a)]
        for step in reversed(back):
            labels.append(int(step[labels[-1]]))
        return np.array(labels[::-1])


def weak_labels(x: np.ndarray, good: bool) -> np.ndarray:
    """What a document's label says of its lines: notices and lines seen before are boilerplate in any document, the other lines of a
    good one are content, and those of a bad one, which may hold both, are open."""
    boilerplate = (x[:, FEATURES.index("notice")] > 0) | (x[:, FEATURES.index("seen_before")] > 0)
    return np.where(boilerplate, BOILERPLATE, CONTENT if good else UNKNOWN)


def _logistic(x: np.ndarray, y: np.ndarray, weigh: np.ndarray, rounds: int = 12, penalty: float = 1e-3) -> np.ndarray:
    """Weights of a logistic regression by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weigh * p * (1 - p))[:, None]).T @ x + penalty * np.eye(len(w)), x.T @ (weigh * (y - p)) - penalty * w)
        w += step * min(1.0, 5 / (np.abs(step).max() + 1e-12))
    return w


def line_labels(documents: list[tuple[np.ndarray, int]]) -> list[np.ndarray]:
    """Labels of the lines of (line features, quality 0 or 1): the weak ones; and of a bad document's open lines those that look
    unlike, or like, the lines of good documents, by a regression on single lines. The line least like them is boilerplate in
    any case, since something makes the document bad; what is not clear stays UNKNOWN, for the field to sum over."""
    labels = [weak_labels(x, bool(good)) for x, good in documents]
    x, label = np.vstack([d for d, _ in documents]), np.concatenate(labels)
    side = np.concatenate([np.full(len(d), good) for d, good in documents])
    each = np.concatenate([np.full(len(d), 1 / len(d)) for d, _ in documents])
    fit = (label != BOILERPLATE) | (side == 0)
    each[fit & (side == 1)] /= each[fit & (side == 1)].sum()
    each[fit & (side == 0)] /= each[fit & (side == 0)].sum()
    p = 1 / (1 + np.exp(-np.clip(x @ _logistic(x[fit], side[fit].astype(float), each[fit]), -30, 30)))
    at = 0
    for own, (d, good) in zip(labels, documents):
        likely, at = p[at : at + len(d)], at + len(d)
        if not good:
            open_ = own == UNKNOWN
            own[open_ & (likely < CLEAR[0])] = BOILERPLATE
            own[open_ & (likely > CLEAR[1])] = CONTENT
            if not (own == BOILERPLATE).any():
                own[likely.argmin()] = BOILERPLATE
    return labels


def _expected(emit: np.ndarray, moves: np.ndarray, start: np.ndarray, live: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward-backward over sequences in columns, the longest first (live[t] of them have a line t): (label probabilities by line
    and sequence, pair probabilities summed over a sequence's steps)."""
    e, m = np.exp(emit - emit.max(axis=2, keepdims=True)), np.exp(moves)
    ahead, behind, pairs = np.zeros_like(e), np.ones_like(e), np.zeros((e.shape[1], 2, 2))
    ahead[0] = e[0] * np.exp(start)
    ahead[0] /= ahead[0].sum(axis=1, keepdims=True)
    for t in range(1, len(e)):
        n = live[t]
        a = ahead[t - 1, :n] @ m * e[t, :n]
        ahead[t, :n] = a / a.sum(axis=1, keepdims=True)
    for t in range(len(e) - 2, -1, -1):
        n = live[t + 1]
        after = e[t + 1, :n] * behind[t + 1, :n]
        b = after @ m.T
        behind[t, :n] = b / b.sum(axis=1, keepdims=True)
        pair = ahead[t, :n, :, None] * m * after[:, None, :]
        pairs[:n] += pair / pair.sum(axis=(1, 2), keepdims=True)
    p = ahead * behind
    return p / np.maximum(p.sum(axis=2, keepdims=True), 1e-300), pairs


def fit_field(sequences: list[tuple[np.ndarray, np.ndarray]], rounds: int = 120, rate: float = 2.0, penalty: float = 1e-3) -> Field:
    """Maximum likelihood by gradient ascent on (line features, line labels): what the field expects with the known labels held,
    less what it expects without; UNKNOWN labels are summed over. Sequences weigh the same whatever their length, and so do the two
    labels. Without lines of both labels, the default field."""
    known = np.concatenate([y for _, y in sequences]) if sequences else np.zeros(0)
    if not (known == BOILERPLATE).any() or not (known == CONTENT).any():
        return Field.default()
    sequences = sorted(sequences, key=lambda s: -len(s[1]))
    size = np.array([len(y) for _, y in sequences])
    x, held = np.zeros((size[0], len(size), len(FEATURES))), np.zeros((size[0], len(size), 2))
    for i, (rows, y) in enumerate(sequences):
        x[: size[i], i] = rows
        held[: size[i], i, BOILERPLATE], held[: size[i], i, CONTENT] = np.where(y == CONTENT, -1e4, 0), np.where(y == BOILERPLATE, -1e4, 0)
    live = [int((size > t).sum()) for t in range(size[0])]
    bad = np.array([np.mean(y == BOILERPLATE) for _, y in sequences])
    weigh = (bad / bad.sum() + (1 - bad) / max(1e-9, (1 - bad).sum())) / 2 / size
    w, moves, start = np.zeros((2, len(FEATURES))), np.zeros((2, 2)), np.zeros(2)
    for _ in range(rounds):
        emit = x @ w.T
        p, pairs = _expected(emit, moves, start, live)
        want_p, want_pairs = _expected(emit + held, moves, start, live)
        w += rate * (np.tensordot((want_p - p) * weigh[:, None], x, ((0, 1), (0, 1))) - penalty * w)
        moves += rate / 4 * (np.tensordot(weigh, want_pairs - pairs, 1) - penalty * moves)
        start += rate / 4 * ((want_p - p)[0] * weigh[:, None]).sum(axis=0)
    return Field(w, moves, start)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = TRAIN_DOCS) -> Field:
    """The field, fitted on stretches of at most TRAIN_LINES lines of at most `most` labelled documents (the first by hash, half of
    them of either label), with labels by line: see line_labels().

    An id that is labelled both ways counts as bad; of rows that share an id, the first by the text's hash come in. So the fit is
    the same whatever the order of rows. Only line features leave the executors. Without documents of both labels, the default field.
    """
    rank = F.xxhash64("_id", F.lit(3))
    known = labels.select(F.col(id_col).alias("_id"), F.col("quality").cast("int").alias("_y")).where("_id is not null and _y in (0, 1)").groupBy("_id").agg(F.min("_y").alias("_y"))
    few = known.where("_y = 0").orderBy(rank, "_id").limit(most // 2).unionByName(known.where("_y = 1").orderBy(rank, "_id").limit(most // 2))
    # at most `most` rows of two numbers: broadcast
    chosen = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text")).join(F.broadcast(few), "_id").select(rank.alias("a"), F.xxhash64("_text").alias("b"), "_y", "_text")

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for text in pdf["_text"]:
                x, _ = line_features(text)
                first = zlib.crc32(text.encode("utf-8", "surrogatepass")) % max(1, len(x) - TRAIN_LINES + 1)
                rows.append(x[first : first + TRAIN_LINES].ravel())
            yield pd.DataFrame({"a": pdf["a"], "b": pdf["b"], "y": pdf["_y"], "x": rows})

    got = chosen.mapInPandas(features, "a long, b long, y int, x array<double>").orderBy("a", "b", "y").limit(most).collect()
    documents = [(np.array(r["x"]).reshape(-1, len(FEATURES)), r["y"]) for r in got if len(r["x"])]
    if len({y for _, y in documents}) < 2:
        return Field.default()
    return fit_field([(x, y) for (x, _), y in zip(documents, line_labels(documents))])


def judge(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text", least: float = MIN_CONTENT) -> DataFrame:
    """One row per document: id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, content_share, kept.

    kept is false if base_failed (under 10 words, or over 20 % of them in repeated 5-word windows); else whether lines that the
    field's best path marks as content hold at least `least` of the characters. A null text counts as empty: no words, so not
    kept. Null ids and repeated rows stay, each judged alone. Of labels of one score a line is content. A very long text is judged
    whole, in time and memory proportional to its lines. Other columns are ignored. An empty table gives no rows.
    """

    @F.pandas_udf("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, content_share double")
    def measured(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = []
            for t in texts:
                x, chars = line_features(t)
                marked = field.viterbi(x) == CONTENT
                rows.append((*counts(t), float(chars[marked].sum() / chars.sum()) if len(chars) else 0.0))
            yield pd.DataFrame(rows, columns=["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "content_share"])

    found = docs.select(F.col(id_col), measured(F.col(text_col)).alias("m")).select(id_col, "m.*")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return found.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("content_share") >= least))


def keep(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text", least: float = MIN_CONTENT) -> DataFrame:
    """The documents that judge() keeps, with all their columns and all rows of repeated ones; no shuffle."""

    @F.pandas_udf("boolean")
    def kept(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            out = []
            for t in texts:
                n, _, _, _, repeated = counts(t)
                good = n >= MIN_WORDS and 100 * repeated <= MAX_REPEAT_PERCENT * n
                if good:
                    x, chars = line_features(t)
                    good = len(chars) > 0 and float(chars[field.viterbi(x) == CONTENT].sum() / chars.sum()) >= least
                out.append(good)
            yield pd.Series(out, dtype=bool)

    return docs.where(kept(F.col(text_col)))
