"""Operators against brute force: token counts, personal data, quality counts, fingerprints, vectors, pieces, urls."""

from __future__ import annotations

import math
import random
import re
import time
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import xxhash
from pyspark.sql import functions as F

from chartspan.llm import common, embedding_dedup, personal_data, quality_rules, sentencepieces, simhash, token_counts, url_filters

MODEL = public_tokenizers.path("piece_bpe_32k.model")
ODD = [None, "", " ", "a", "  two  spaces ", "\n\tx\r\n", "▁▁ mark ▁", "<s> </s> <0x0A>", "😀 日本語 ǘ", "\x00 nul", " " * 9 + "k", "tie tie tie", "tie tie tie", "Ab CD ef gh. 12 34!", "long " * 4000, "x" * 30_000]


def frame(spark, texts, start=0, extra=False):
    rows = [(start + i, t, "en", "src", i) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    clash = ("_text", "_fp", "digest", "m", "ids", "fingerprint", "component_id", "_h", "docs", "quota", "tokens", "mix_block", "share", "host", "path", "evidence", "p", "features", "secret", "before", "kept", "n_tokens", "pair_lo", "chunk", "_keep", "_id", "_y")
    return df.withColumns({c: F.lit("clash") for c in clash}) if extra else df


def groups(n, links):
    up = list(range(n))

    def top(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in links:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return [top(i) for i in range(n)]


@pytest.fixture(scope="module")
def sp():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def test_components(spark):
    r = random.Random(1)
    links = [(r.randrange(300), r.randrange(300)) for _ in range(180)] + [(400 + i, 401 + i) for i in range(150)]
    want = groups(600, links)
    got = {x.node: x.component for x in common.components(spark.createDataFrame(links, "src long, dst long")).collect()}
    held = {x for a, b in links if a != b for x in (a, b)}
    assert got == {x: want[x] for x in held}
    assert common.components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_block_pairs_meet(spark):
    rows = spark.range(50).select(F.lit(1).alias("k"), "id").union(spark.range(3).select(F.lit(2), "id"))
    dealt = common.in_block_pairs(rows, ["k"], F.col("id"), 8).collect()
    at = defaultdict(set)
    for x in dealt:
        at[x.k, x.pair_lo, x.pair_hi].add(x.id)
    met = {(k, a, b) for (k, _, _), ids in at.items() for a in ids for b in ids}
    assert met >= {(1, a, b) for a in range(50) for b in range(50)} and max(map(len, at.values())) < 40


def test_token_counts(spark, sp, tmp_path):
    docs = frame(spark, ODD, extra=True)
    want = {i: len(sp.encode(t or "")) for i, t in enumerate(ODD)}
    for _ in range(2):  # the second time from the cache
        got = token_counts.count_tokens(docs, MODEL, str(tmp_path / "cache")).collect()
        assert {x.doc_id: x.n_tokens for x in got} == want and len(got) == len(ODD)
        assert all(x.n_bytes == len((ODD[x.doc_id] or "").encode()) and x.over_limit == (x.n_tokens > 4096) for x in got)
    cached = spark.read.parquet(f"{tmp_path}/cache/{token_counts.tokenizer_digest(MODEL)}")
    assert cached.count() == len({t or "" for t in ODD})  # each distinct text once, nothing twice
    assert token_counts.count_tokens(docs.limit(0), MODEL, str(tmp_path / "none")).count() == 0
    other = public_tokenizers.path("byte_bpe_50k.json")
    assert token_counts.count_tokens(docs, other, str(tmp_path / "cache")).where("doc_id = 7").first().n_tokens > 0


def test_pieces(spark, sp):
    r = random.Random(2)
    texts = ODD + [" ".join("".join(r.choice("abcdehinorst.,é日\n") for _ in range(r.randint(0, 12))) for _ in range(60)) for _ in range(40)]
    docs = frame(spark, texts, extra=True)
    got = {x.doc_id: x for x in sentencepieces.decode(sentencepieces.encode(docs.drop("ids"), MODEL), MODEL).collect()}
    for i, t in enumerate(texts):
        ids = sp.encode(t or "")
        assert list(got[i].ids) == ids and got[i].decoded == sp.decode(ids), repr(t)
    short = {x.doc_id: x for x in sentencepieces.summary(docs, MODEL).collect()}
    assert all(short[i].n_tokens == len(got[i].ids) and short[i].round_trip == ("▁" not in (t or "")) for i, t in enumerate(texts))
    assert sentencepieces.summary(docs.limit(0), MODEL).count() == 0


def test_long_runs(sp):
    """Whole runs of spaces, marks and one letter, in about linear time; merges in any order of scores."""
    model = sentencepieces.Model(MODEL)
    for t in (" " * 100_000, "a" * 50_000 + " " * 30_000 + "b", "▁" * 20_000, ("ab " + " " * 997) * 60, "=" * 60_000, " \n" * 20_000):
        began = time.perf_counter()
        assert next(model.encode([t])).tolist() == sp.encode(t), t[:9]
        assert time.perf_counter() - began < 5
    r = random.Random(5)
    for _ in range(3000):
        t = "".join(r.choice([" ", " ", "  ", "t", "he", "in", "é", "\n", "="]) for _ in range(r.randint(1, 40)))
        assert next(model.encode([t])).tolist() == sp.encode(t), repr(t)


def brute_spans(t):
    out = [(*m.span(), 0) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(*m.span(), 1) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    digits = lambda x: re.sub("[^0-9]", "", x)
    out += [(*m.span(), 2) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 14 <= len(digits(m[0])) <= 19 and personal_data.luhn(digits(m[0]))]
    out += [(*m.span(), 3) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= len(digits(m[0])) <= 15]
    return sorted(out, key=lambda s: (s[0], s[2], s[1]))


def test_luhn():
    assert personal_data.luhn("4242424242424242") and not personal_data.luhn("4242424242424241")


def test_base_spans():
    r = random.Random(3)
    parts = ["@", "a", "b.", "1", "23", "4.", "255", ".", "-", " ", "+", "(", "4242424242424242", "é", "%", "x@y.z", "٣", "007", "+1 (415) 555-2671"]
    for _ in range(20_000):
        t = "".join(r.choice(parts) for _ in range(r.randint(0, 25)))
        assert personal_data.base_spans(t) == brute_spans(t), t


def test_personal_data(spark):
    texts = ["mail a.b@c.de or 1.2.3.4", "card 4242 4242 4242 4242.", "call +1 (415) 555-2671", "phone (415) 555-2671 or bob (at) example (dot) com", "version 1.2.3.4.5 of 2023-01-02", *ODD]
    docs = frame(spark, texts, extra=True)
    got = {x.doc_id: x for x in personal_data.find(docs).collect()}
    assert (got[0].n_email, got[0].n_ip, got[1].n_card, got[2].n_phone) == (1, 1, 1, 1)
    assert got[0].spans == "email:5:13,ip:17:24" and got[3].n_added == 2 and got[3].n_phone == 0 and got[5].spans == ""
    clean = {x.doc_id: x.text for x in personal_data.redact(docs).collect()}
    assert clean[0] == "mail [EMAIL] or [IP]" and clean[3] == "phone [PHONE] or [EMAIL]" and clean[4] == texts[4].replace("1.2.3.4", "[IP]") and clean[5] is None
    assert personal_data.find(docs.limit(0)).count() == 0


def test_boosted_trees_hold_out():
    model, limits = personal_data.trained()
    r = random.Random(99)
    made = [personal_data._example(r) for _ in range(1500)]
    p = model.probability(np.array([personal_data.features(t, s) for t, s, _ in made]))
    kept = np.array([a >= limits[s[2]] for a, (_, s, _) in zip(p, made)])
    y = np.array([z for *_, z in made])
    assert y[kept].mean() > 0.97 and kept[y == 1].mean() > 0.6


def brute_counts(t):
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    at = defaultdict(list)
    for i in range(len(words) - 4):
        at[tuple(words[i : i + 5])].append(i)
    repeated = {j for v in at.values() if len(v) > 1 for i in v for j in range(i, i + 5)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(repeated)


def test_quality_counts(spark):
    r = random.Random(5)
    texts = ODD + ["".join(r.choice(["a", "b ", "\n", " ", "\x0b", "\x0c", "\xa0", "#", "|", "c d e f g ", "é\u2028"]) for _ in range(r.randint(0, 60))) for _ in range(400)]
    got = {x.doc_id: x for x in quality_rules.judge(frame(spark, texts, extra=True), quality_rules.Field.default()).collect()}
    for i, t in enumerate(texts):
        want = brute_counts(t or "")
        x = got[i]
        assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words) == want, repr(t)
        assert x.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0]) and not (x.base_failed and x.kept)


def test_viterbi_and_training():
    r = np.random.default_rng(1)
    field = quality_rules.Field(r.normal(size=(2, len(quality_rules.FEATURES))), r.normal(size=(2, 2)), r.normal(size=2))
    for n in (1, 2, 5, 8):
        x = r.normal(size=(n, len(quality_rules.FEATURES)))
        emit = x @ field.weights.T

        def score(path):
            return field.start[path[0]] + sum(emit[i, a] for i, a in enumerate(path)) + sum(field.moves[a, b] for a, b in zip(path, path[1:]))

        paths = [[k >> i & 1 for i in range(n)] for k in range(2**n)]
        assert score(field.viterbi(x).tolist()) == pytest.approx(max(map(score, paths)))
    rows = []
    for _ in range(80):  # labels switch within a sequence; every third is left open
        y = np.repeat(r.integers(0, 2, 4), r.integers(1, 4, 4))
        rows.append((r.normal(size=(len(y), len(quality_rules.FEATURES))) + np.where(y, 1, -1)[:, None], y))
    fitted = quality_rules.fit_field([(x, np.where(r.random(len(y)) < 0.3, quality_rules.UNKNOWN, y)) for x, y in rows[:40]])
    assert np.mean(np.concatenate([fitted.viterbi(x) == y for x, y in rows[40:]])) > 0.97


def test_expectations():
    """Forward-backward against all paths, with lines held to a label and sequences of several lengths."""
    r = np.random.default_rng(4)
    sizes, moves, start = [6, 4, 4, 1], r.normal(size=(2, 2)), r.normal(size=2)
    emit = r.normal(size=(6, 4, 2)) * 3
    emit[2, 0, 1] = emit[3, 1, 0] = -1e4
    p, pairs = quality_rules._expected(emit, moves, start, [sum(n > t for n in sizes) for t in range(6)])
    for i, n in enumerate(sizes):
        paths = np.array([[k >> t & 1 for t in range(n)] for k in range(2**n)])
        score = np.array([start[y[0]] + sum(emit[t, i, a] for t, a in enumerate(y)) + sum(moves[a, b] for a, b in zip(y, y[1:])) for y in paths])
        weight = np.exp(score - score.max())
        weight /= weight.sum()
        assert np.allclose(p[:n, i, 1], weight @ paths)
        want = [[sum(w * np.sum((y[:-1] == a) & (y[1:] == b)) for w, y in zip(weight, paths)) for b in (0, 1)] for a in (0, 1)]
        assert np.allclose(pairs[i], want)


def test_near_pairs():
    r = np.random.default_rng(2)
    fps = []
    for base in r.integers(-(2**62), 2**62, 60):
        for _ in range(4):
            x = int(base) % 2**64
            for k in r.integers(0, 64, r.integers(0, 5)):
                x ^= 1 << int(k)
            fps.append(x - 2**64 if x >= 2**63 else x)
    fps = np.unique(np.array(fps, np.int64))
    away = np.bitwise_count(fps.view(np.uint64)[:, None] ^ fps.view(np.uint64)[None, :])
    for radius in (0, 1, 2, 3, 5):
        assert (simhash.near_pairs(fps, radius) == ((away <= radius) & ~np.eye(len(fps), dtype=bool))).all()


def brute_print(t):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash(spark):
    r = random.Random(7)
    words = ["".join(r.choice("abcdefgh") for _ in range(4)) for _ in range(300)]
    base = [[r.choice(words) for _ in range(200)] for _ in range(12)]
    texts = [*ODD, *(" ".join(b) for b in base)]
    for b in base:
        for _ in range(12):
            c = list(b)
            for _ in range(r.randint(0, 4)):
                c[r.randrange(200)] = r.choice(words)
            texts.append(" ".join(c))
    prints = [brute_print(t) for t in texts]
    a = np.array(prints, np.uint64)
    want = groups(len(texts), [(i, int(j)) for i in range(len(a)) for j in np.flatnonzero(np.bitwise_count(a ^ a[i]) <= 2)])
    assert len(set(want)) < len(set(prints)) - 10
    for block in (1024, 8):  # the second deals all keys to block pairs
        got = {x.doc_id: x for x in simhash.near_duplicates(frame(spark, texts, extra=True), block=block).collect()}
        assert {i: int(x.fingerprint, 16) for i, x in got.items()} == dict(enumerate(prints))
        assert {i: x.component_id for i, x in got.items()} == dict(enumerate(want))
    one = simhash.one_of_each(frame(spark, texts))
    assert sorted(x.doc_id for x in one.collect()) == sorted(set(want)) and one.columns == frame(spark, texts).columns
    two = frame(spark, ["one text of its own, long enough to differ", "a wholly other text, of other words", "one text of its own, long enough to differ", None, ""], extra=True).withColumn("doc_id", F.when(F.col("doc_id") < 2, 5).when(F.col("doc_id") == 2, 9))
    two = two.unionByName(two.where("doc_id = 5"))  # different texts under one id, rows repeated, rows without an id
    assert sorted((x.doc_id or 0, x.text or "") for x in simhash.one_of_each(two).collect()) == [(0, ""), (5, "a wholly other text, of other words"), (5, "one text of its own, long enough to differ")]
    assert simhash.one_of_each(two).columns == two.columns
    nameless = frame(spark, ["same text here"] * 3).withColumn("doc_id", F.when(F.col("doc_id") > 0, F.col("doc_id")))
    assert {x.component_id for x in simhash.near_duplicates(nameless).collect()} == {1}
    assert simhash.near_duplicates(frame(spark, [])).count() == 0 and simhash.one_of_each(frame(spark, [])).count() == 0


def test_embeddings(spark):
    r = np.random.default_rng(3)
    centres = r.normal(size=(40, 16))
    rows = [c + r.normal(size=16) * s for c in centres for s in (0, 0, 0.05, 0.2, 0.3)] + list(r.normal(size=(900, 16))) + list(centres[0] + r.normal(size=(300, 16)) * 0.12)
    rows = [x.tolist() for x in rows] + [None, [], [0.0] * 16, [float("nan")] * 16, [1.0, None] * 8, [float("inf")] + [0.0] * 15, [1.0, 2.0], [2.0, 4.0]]
    df = spark.createDataFrame([(i, x, 0) for i, x in enumerate(rows)], "vec_id long, embedding array<double>, label int")
    good = [i for i, x in enumerate(rows) if x and len(x) == 16 and all(v is not None and np.isfinite(v) for v in x) and any(x)]
    unit = np.array([rows[i] for i in good])
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.95
    np.fill_diagonal(near, False)
    links = [(good[i], good[j]) for i, j in zip(*np.nonzero(near))] + [(len(rows) - 1, len(rows) - 2)]
    want = groups(len(rows), links)
    n = Counter(a for a, _ in links)
    n[len(rows) - 2] += 1
    for block in (1024, 64):
        got = {x.vec_id: x for x in embedding_dedup.near_duplicates(df, leaf=128, block=block).collect()}
        assert all(got[i].n_links <= n[i] for i in got) and len(got) == len(rows)
        assert sum(x.n_links for x in got.values()) >= 0.98 * sum(n.values())
        assert np.mean([got[i].component_id == want[i] for i in got]) > 0.98
        assert all(x.kept == (x.vec_id == x.component_id) for x in got.values())
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0
    assert embedding_dedup.near_duplicates(df.where("vec_id >= 1701")).count() == df.where("vec_id >= 1701").count()


def test_embeddings_split_within_spark(spark, monkeypatch):
    """64 dimensions, a driver's sample too small for the table: large leaves are split in rounds on samples of their own; a dense
    group stays one leaf, dealt to block pairs. Links and components against all pairs."""
    r = np.random.default_rng(5)
    rows = np.vstack([r.normal(size=(2600, 64)), np.repeat(r.normal(size=(300, 64)), 3, axis=0) + r.normal(size=(900, 64)) * 0.2, r.normal(size=64) + r.normal(size=(500, 64)) * 0.15])
    rows = rows[r.permutation(len(rows))]
    unit = rows / np.linalg.norm(rows, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.95
    np.fill_diagonal(near, False)
    want = groups(len(rows), [(int(i), int(j)) for i, j in zip(*np.nonzero(near))])
    df = spark.createDataFrame([(i, x.tolist(), "clash") for i, x in enumerate(rows)], "vec_id long, embedding array<double>, code string")
    rounds = []
    monkeypatch.setattr(embedding_dedup, "written", lambda d, name: rounds.append(name) or common.written(d, name))
    got = {x.vec_id: x for x in embedding_dedup.near_duplicates(df, sample=100, leaf=48, block=128).collect()}
    assert rounds.count("cuts") >= 1  # some leaves were split within Spark
    assert all(got[i].n_links <= near[i].sum() for i in got)
    assert sum(x.n_links for x in got.values()) >= 0.98 * near.sum()
    assert np.mean([got[i].component_id == want[i] for i in got]) > 0.98


URLS = [
    (None, "", "", None), ("no scheme", "", "", None), ("HTTP://Ex.NET", "ex.net", "", None), ("http://ex.net/?q", "ex.net", "/", "net/"), ("a://b://c/d", "b:", "//c/d", None), ("http://É.ORG/fr/x#y", "É.org", "/fr/x", "org/fr/"),
    ("http://x.org/fr", "x.org", "/fr", None), ("http://net/", "net", "/", "net/"), ("http://internet/", "internet", "/", None), ("http://a.example.net/en/1?x=/de/", "a.example.net", "/en/1", "example.net/en/"),
    ("http://example.com/de/", "example.com", "/de/", "example.com/de/"), ("http://badexample.com/de/", "badexample.com", "/de/", None), ("", "", "", None), ("http://" + "h" * 5000 + "/" + "p/" * 3000, "h" * 5000, "/" + "p/" * 3000, None),
]


def test_urls(spark):
    df = spark.createDataFrame([(i, u[0], "x", "clash") for i, u in enumerate(URLS)], "page_id long, url string, html string, host string").withColumn("template", F.lit("clash"))
    empty = spark.createDataFrame([], "label_key long, bad int")
    got = {x.page_id: x for x in url_filters.judge(df, empty).collect()}
    for i, (_, host, path, rule) in enumerate(URLS):
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule)
        assert got[i].verdict == ({"net/": "block", "example.com/de/": "block"}.get(rule, "allow"))
    assert url_filters.judge(df.limit(0), empty).count() == 0


def brute_url_verdicts(pages, labels, depth=4, values=16, share=0.1, z=2.58, prior=8.0, purity=0.5):
    """page -> (branch, purity, verdict) by plain loops over dictionaries."""
    rows = {}
    for page, url in pages:
        host, _, path = url.split("://")[1].partition("/")
        segments = [x for x in ("/" + path).replace("\\", "\\\\").replace("*", "\\*").replace("{", "\\{").replace("}", "\\}").split("/") if x]
        rows[page] = [host, segments[: depth - 1] + (["/".join(segments[depth - 1 :])] if len(segments) >= depth else []), ()]

    def shape(x):
        ending = re.search(f"({url_filters.EXTENSION})$", x)
        ending = ending[1] if ending else ""
        out = []
        for part in re.findall(r"[0-9]+|[._-]+|[^0-9._-]+", x[: len(x) - len(ending)]):
            out.append("{n}" if part[0].isdigit() else part if part[0] in "._-" else "*")
            if len(out) > 2 and out[-1] == out[-3] == "*" and out[-2][0] in "._-":
                del out[-2:]
        return "".join(out) + ending

    for level in range(depth):
        seen = defaultdict(Counter)
        for host, segments, t in rows.values():
            if len(segments) > level:
                seen[host, t][segments[level]] += 1
        for row in rows.values():
            host, segments, t = row
            if len(segments) > level:
                n = seen[host, t]
                wild = re.fullmatch("[0-9]+", segments[level]) or len(n) >= values and len(n) >= share * sum(n.values())
                row[2] = (*t, shape(segments[level]) if wild else segments[level])
    own = {}
    for page, (host, _, t) in rows.items():
        key = re.search("([0-9]{1,18})[^0-9]*$", dict(pages)[page].split("://")[1].partition("/")[2])
        bad = labels.get(int(key[1])) if key else None
        a = own.setdefault((host, t), [0, 0])
        if bad is not None:
            a[0], a[1] = a[0] + 1, a[1] + bad
    branch = {k: k[1] for k in own}
    for level in range(1, depth + 1):
        sums = defaultdict(lambda: np.zeros(2, int))
        for k, b in branch.items():
            if len(b) >= level:
                sums[k[0], b[: level - 1], b[level - 1]] += own[k]
        names = {}
        for host, up in {x[:2] for x in sums}:
            children = sorted((x for x in sums if x[:2] == (host, up)), key=lambda x: (sums[x][1] / sums[x][0] if sums[x][0] else -1, *sums[x]))
            sets = [[x for x in children if not sums[x][0]]]
            for x in children[len(sets[0]) :]:
                (n, bad), (m, worse) = sums[x], sum((sums[y] for y in sets[-1]), np.zeros(2, int))
                p = (bad + worse + 0.5) / (n + m + 1)
                same = m and tuple(sums[sets[-1][-1]]) == (n, bad)  # entries of equal counts are one
                if same or m and abs(bad / n - worse / m) <= z * math.sqrt(p * (1 - p) * (1 / m + 1 / n)):
                    sets[-1].append(x)
                else:
                    sets.append([x])
            for members in sets:
                if len(members) > 1:
                    n, bad = sum((sums[y] for y in members), np.zeros(2, int))
                    names |= {y: f"**{int(1000 * bad / n + 0.5) if n else ''}" for y in members}
        branch = {k: b if len(b) < level else (*b[: level - 1], names.get((k[0], b[: level - 1], b[level - 1]), b[level - 1]), *b[level:]) for k, b in branch.items()}
    total, hosts, branches = np.zeros(2), defaultdict(lambda: np.zeros(2)), defaultdict(lambda: np.zeros(2))
    for k, x in own.items():
        total, hosts[k[0]] = total + x, hosts[k[0]] + x
        branches[k[0], branch[k]] += x
    smooth = lambda x, above: (x[1] + prior * above) / (x[0] + prior)
    out = {}
    for page, (host, _, t) in rows.items():
        b = branch[host, t]
        shown = branches[host, b]
        while not shown[0] and b:
            b = b[:-1]
            shown = sum((x for (h, c), x in branches.items() if h == host and c[: len(b)] == b), np.zeros(2))
        good = 1 - smooth(shown, smooth(hosts[host], (total[1] + 1) / (total[0] + 2)))
        out[page] = ("/" + "/".join(branch[host, t]), good, "block" if good < purity else "allow")
    return out


def test_url_tree(spark):
    """Random sites with literal, variable, numbered, starred, deep and spammy branches, against plain loops."""
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(3, 8)))
    pages, labels = [], {}
    for i in range(3000):
        host = r.choice(["a.com", "a.com", "b.org", "c.io"])
        kind = r.choice(["news", "shop", "spam", "*", "**", "{n}", "deep", "slug", "root"])
        tail = {"deep": f"deep/x/y/z/{r.choice('pq')}/{i}", "slug": f"s/{i}-{word()}-{word()}.html", "root": f"{word()}{i}", "*": f"*/{i}", "**": f"**/{word()}/{i}", "{n}": f"{{n}}/{i}"}.get(kind, f"{kind}/{r.choice(['item', 'page'])}-{i}.html")
        pages.append((i, f"http://{host}/{tail}"))
        if r.random() < 0.6:
            bad = {"spam": 0.95, "**": 0.8, "deep": 0.5}.get(kind, 0.05) if host != "c.io" else 0.4
            labels[i] = int(r.random() < bad)
    # a branch that stands out, named like a wildcard, beside merged siblings of other shapes
    pages += [(5000 + i, f"http://d.net/list/{word()}{'' if i % 25 == 0 else i % 4 * '-'}{'' if i % 25 == 0 else i}") for i in range(520)]
    labels |= {i: int(i % 7 == 0) for i in range(520) if i not in labels}
    want = brute_url_verdicts(pages, labels)
    got = url_filters.judge(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(list(labels.items()), "label_key long, bad int"), rules=()).collect()
    assert {x.page_id: (x.branch, round(x.purity, 9), x.verdict) for x in got} == {k: (a, round(b, 9), c) for k, (a, b, c) in want.items()}
    assert sum(x.verdict == "block" for x in got) > 200


def test_merged_branches_take_no_siblings_name(spark):
    """Bad pages with segments of letters beside good ones in other shapes: they stand out, and nothing good is pooled with them."""
    letters = lambda i: "".join("abcdefghij"[int(c)] for c in f"{i:05d}")
    rows = [(i, f"/p/{letters(i)}", 1) for i in range(20)] + [(20 + i, "/p/" + (f"{i}-{letters(i)}", f"{i}.{letters(i)}.{i}", f"{letters(i)}{i}", f"{i}_{i}")[i % 4], 0) for i in range(500)]
    parts = spark.createDataFrame([(i, "h", p, b) for i, p, b in rows], "i int, host string, path string, bad int")
    stats = url_filters.templates(parts).groupBy("host", "template").agg(F.count("bad").alias("labelled"), F.sum("bad").alias("bad"))
    got = {(tuple(x.template), tuple(x.branch)) for x in url_filters.merged(stats).collect()}
    assert {b for t, b in got if t == ("p", "*")} == {("p", "*")} and {b for t, b in got if t != ("p", "*")} == {("p", "**0")}


def test_alike_branches_are_one(spark):
    """Bad branches stand together, however thin each is, apart from good ones; branches without labels go by what stands above them."""
    def verdicts(*branches):
        pages, labels = [], []
        for name, n, bad in branches:
            pages += [(len(pages) + i, f"http://a.com/{name}/item{len(pages) + i}.html") for i in range(n)]
            labels += [] if bad is None else [(len(pages) - n + i, bad) for i in range(n)]
        got = url_filters.judge(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(labels, "label_key long, bad int"), rules=()).collect()
        return {(x.template.split("/")[1], x.branch, x.verdict) for x in got}

    leaf = "*{n}.html"
    assert verdicts(("good", 200, 0), ("spamA", 60, 1), ("spamB", 60, 1), ("unlab", 40, None)) == {
        ("good", f"/good/{leaf}", "allow"), ("spamA", f"/**1000/{leaf}", "block"), ("spamB", f"/**1000/{leaf}", "block"), ("unlab", f"/unlab/{leaf}", "allow"),
    }
    thin = verdicts(("good", 400, 0), *((f"bad{c}", 5, 1) for c in "abcdefghijkl"))
    assert {v for t, b, v in thin if t == "good"} == {"allow"} and {(b, v) for t, b, v in thin if t != "good"} == {("/**1000/**1000", "block")}


def test_url_templates(spark):
    """Spam below one branch of one host: its template is rejected, others and the other hosts stay."""
    rows, labels = [], []
    for i in range(600):
        branch = ("spam", "news", "shop")[i % 3]
        rows.append((i, f"http://a.com/{branch}/item-{i}.html"))
        labels.append((i, int(branch == "spam")))
    rows += [(600 + i, f"http://b.com/news/{600 + i}") for i in range(60)]
    labels += [(600 + i, 0) for i in range(60)] + [(None, 1), (5, None)]
    got = url_filters.judge(spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(labels, "label_key long, bad int"), rules=()).collect()
    assert {x.branch for x in got if x.verdict == "block"} == {"/spam/*-{n}.html"} and sum(x.verdict == "block" for x in got) == 200
    parts = spark.createDataFrame([(i, "a.com", f"/{'ab'[i % 2]}/x{i}") for i in range(200)], "i int, host string, path string")
    assert {tuple(x.template) for x in url_filters.templates(parts).collect()} == {("a", "*{n}"), ("b", "*{n}")}


def test_vectors_of_any_length_link(spark):
    """Squares that leave the doubles on either side; only the direction counts."""
    r = np.random.default_rng(4)
    base = r.standard_normal(24)
    rows = [(i, (base * 10.0**e).tolist()) for i, e in enumerate((-320, -200, -170, 0, 150, 200, 307))] + [(7, [1e-170, 2e-170] + [0.0] * 22), (8, [2e-170, 4e-170] + [0.0] * 22), (9, [5e-324] + [0.0] * 23), (10, [1e308] + [0.0] * 23), (11, [0.0] * 24)]
    got = {x.vec_id: x.component_id for x in embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert [got[i] for i in range(1, 7)] == [got[1]] * 6 and [got[i] for i in (7, 8, 9, 10, 11)] == [7, 7, 9, 9, 11]


def test_vector_recall_at_64_dimensions(spark):
    """Pairs at and above the threshold, against all pairs by brute force."""
    r = np.random.default_rng(9)
    base = r.standard_normal((700, 64))
    near = base[r.integers(0, 700, 500)] + 0.3 * r.standard_normal((500, 64))
    v = np.concatenate([base, near])
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    links = np.argwhere(np.triu(unit @ unit.T >= 0.95, 1))
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    got = embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), leaf=64).collect()
    assert len(links) > 300 and 0.99 * 2 * len(links) <= sum(x.n_links for x in got) <= 2 * len(links)
    components = groups(len(v), links.tolist())
    assert sum(x.component_id == components[x.vec_id] for x in got) >= 0.99 * len(v)


@pytest.mark.parametrize("name", ["text_bytes", "urls_by_rules", "personal_data_by_rules", "quality_base_counts"])
def test_what_sql_can_state(spark, name):
    from chartspan.llm import queries
    from tests.conftest import DATA
    from tests.oracle import connect, difference

    assert difference(queries.queries()[name](spark, DATA), connect(DATA), queries.SQL[name]) == ""
