"""Secret scans: candidates by pattern, false positives removed by a random forest (operator 9).

DataFrame functions and the DataFrame API's forest only.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chartspan.llm.common import text_or_empty

_CUE = r"password|passwd|pwd|secret|token|api[_-]?key|apikey|access[_-]?key|auth|bearer|credential|private"
_HEADS = r"AKIA|ASIA|ghp_|gho_|xox[bap]-|sk_live_|AIza|glpat-"
#: What stands between a cue and its value: the rest of the name, a quote, = or :, and white space.
_ASSIGNED = rf"(?<=[=:\s\"'])(?<=[=:][\s\"']{{0,3}})(?<=(?i:{_CUE})(?i:s|[_-][a-z0-9]{{1,12}}|[0-9]{{1,3}})?[\"']?\s{{0,2}}[=:]\s{{0,2}}"
#: By turns: what a secret's cue is set to, in quotes or up to white space, of 6 or more characters; a bearer's token; a run of 16
#: or more with a known head; and one with a digit in it. Whole runs only, so that a long run costs one look.
_RUN = rf"(?<![A-Za-z0-9_+/-])(?=(?:{_HEADS})|[A-Za-z_+/-]*+[0-9])[A-Za-z0-9_+/-]{{16,}}+"
CANDIDATE = "|".join([
    rf"{_ASSIGNED}\")[^\"\r\n]{{6,200}}(?=\")",
    rf"{_ASSIGNED}')[^'\r\n]{{6,200}}(?=')",
    rf"{_ASSIGNED}[\"']?)(?![\"'])[^\s\"']{{5,}}[^\s\"',;.)\]]",
    r"(?<=\s)(?<=(?i:bearer)\s{1,2})[^\s\"']{5,}[^\s\"',;.)\]]",
    rf"{_RUN}={{0,2}}",
])
#: What every cue holds one of, in lower case: looked for before the pattern's lookbehinds are tried at every place of a text.
CUE_PARTS = ("passw", "pwd", "secret", "token", "key", "auth", "bearer", "credential", "private")
#: Characters before and after a candidate that are looked at.
NEAR = 40
#: Labelled findings that the forest is fitted on, its trees and their depth, and the share of trees that keeps a finding.
FINDINGS, TREES, DEPTH, LIMIT = 4000, 24, 7, 0.5
#: The forest samples by partition: a fixed number of them makes it the same on any cluster.
PARTITIONS = 4
#: Parts of words that names and placeholders are made of.
WORDS = (
    "account", "admin", "alpha", "apple", "base", "beta", "build", "cache", "change", "client", "code", "config", "data", "date", "default", "demo", "dummy", "error", "example",
    "fake", "file", "final", "group", "host", "image", "index", "item", "local", "model", "module", "name", "node", "number", "order", "page", "parent", "part", "path", "placeholder",
    "product", "public", "release", "report", "result", "sample", "server", "service", "session", "setting", "source", "stage", "start", "state", "static", "string", "system",
    "table", "temp", "test", "text", "time", "type", "update", "user", "value", "version", "view", "your", "tion", "ing", "the", "and", "ment",
)
SECRET_CUES = rf"(?i)({_CUE})(s|[_-][a-z0-9]{{1,12}}|[0-9]{{1,3}})?[^a-z0-9]{{0,12}}$"
OTHER_CUES = r"(?i)(sha\d*|md5|commit|checksum|digest|hash|uuid|guid|etag|version|build|order|invoice|isbn|file|image|href|src|id|revision|card|number)[^a-z0-9]{0,12}$"
KNOWN_HEAD = rf"^({_HEADS})"
#: How a value begins or ends that is looked up elsewhere, called or left blank.
REFERENCE = r"^[$<{%\[(*]|[()>}\]]$|(?i)^(self|this|process|os|config|settings|env|get|your)[._-]"
FEATURES = ("length", "digits", "upper", "lower", "other", "moves", "repeats", "dictionary", "vowels", "hex", "head", "cue", "other_cue", "assigned", "quoted", "path_test", "path_code", "uuid", "steps", "special", "reference", "letters")


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("double")


def with_features(findings: DataFrame) -> DataFrame:
    """findings (secret, before, after, path) with the FEATURES, each a double; null neighbours and paths count as empty."""
    s, n = F.col("secret"), F.length("secret")
    before, after, path = (F.coalesce(F.col(c), F.lit("")) for c in ("before", "after", "path"))
    flag = lambda c: c.cast("double")
    dictionary = "(?i)" + "|".join(sorted(WORDS, key=lambda w: (-len(w), w)))
    return findings.withColumns({
        "length": n.cast("double"),
        "digits": _count(s, "[0-9]") / n,
        "upper": _count(s, "[A-Z]") / n,
        "lower": _count(s, "[a-z]") / n,
        "other": _count(s, "[_+/=-]") / n,
        "moves": _count(s, "(?<=[a-z])(?=[A-Z0-9])|(?<=[A-Z])(?=[a-z0-9])|(?<=[0-9])(?=[A-Za-z])") / n,
        "repeats": 1 - F.size(F.array_distinct(F.split(s, ""))) / n,
        "dictionary": 1 - F.length(F.regexp_replace(s, dictionary, "")) / n,
        "vowels": _count(s, "(?i)[aeiou]") / (_count(s, "[A-Za-z]") + 1),
        "hex": flag(s.rlike("^[0-9a-f]+$") | s.rlike("^[0-9A-F]+$")),
        "head": flag(s.rlike(KNOWN_HEAD)),
        "cue": flag(before.rlike(SECRET_CUES)),
        "other_cue": flag(before.rlike(OTHER_CUES)),
        "assigned": flag(before.rlike(r"[=:]\s{0,2}[\"']?$")),
        "quoted": flag(before.rlike("[\"']$") & after.rlike("^[\"']")),
        "path_test": flag(path.rlike("(?i)(^|[/_.-])(test|tests|example|examples|sample|fixture|doc|docs)([/_.-]|$)")),
        "path_code": flag(path.rlike(r"\.[a-z]{1,5}$")),
        "uuid": flag(s.rlike("^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$")),
        "steps": _count(s, "(?i)(012|123|234|345|456|567|678|789|890|abc|bcd|cde|def|xyz|qwe|asd)") / n,
        "special": _count(s, "[^A-Za-z0-9_+/=-]") / n,
        "reference": flag(s.rlike(REFERENCE)),
        "letters": flag(s.rlike("^[A-Za-z][a-z]*([ _.,/-][A-Za-z]?[a-z]*)*$")),
    })


def labelled_findings(spark: SparkSession, n: int = FINDINGS) -> DataFrame:
    """n made-up findings (secret, before, after, path, label), by hashes of their numbers: keys and passwords in usual formats,
    short and long, and what is taken for them: digests, identifiers, numbered names, placeholders, references, words, long numbers."""
    h = lambda k: F.sha2(F.concat(F.lit(f"{k}:"), F.col("id").cast("string")), 256)
    pick = lambda k, m: F.pmod(F.xxhash64(F.lit(k), "id"), F.lit(m))
    choose = lambda k, *v: F.element_at(F.array(*map(F.lit, v)), (pick(k, len(v)) + 1).cast("int"))
    mixed = F.translate(F.base64(F.unhex(h("m"))), "=", "")
    capital = F.translate(F.upper(h("u")), "0123456789", "QRSTUVW789")
    word = lambda k: choose(k, *WORDS)
    number = lambda k: F.substr(F.translate(h(k), "abcdef", "012345"), F.lit(1), (pick(k, 6) + 2).cast("int"))
    cued, other = choose("c", "password=", "token = \"", "api_key: ", "secret=", "Authorization: Bearer ", "access_key = \"", "pwd="), choose("o", "sha256:", "commit ", "md5 ", "file ", "id=", "order ", "build ", "image/", "checksum: ")
    name = F.concat(word(7), choose("q", "_", ".", "-", ""), word(8))
    sign = choose("g2", "&", "!", "@", "#", "$", "%", "^", "*", ".", ":", "?", "~")
    plain = choose("p", "the ", "and was ", "in ", "", "see ", "of ")
    width = choose("w", "16", "20", "32", "40", "64").cast("int")
    rows = spark.range(0, n, 1, PARTITIONS).withColumn("k", pick("kind", 16))
    k = F.col("k")
    secret = (
        F.when(k == 0, F.concat(F.lit("AKIA"), F.substr(F.translate(capital, "789", "XYZ"), F.lit(1), F.lit(16))))
        .when(k == 1, F.concat(F.lit("AKIA"), F.substr(capital, F.lit(1), F.lit(16))))
        .when(k.isin(2, 3), F.substr(h("a"), F.lit(1), width))
        .when(k == 4, F.substr(mixed, F.lit(1), F.least(width, F.lit(40))))
        .when(k == 5, F.concat(choose("g", "ghp_", "sk_live_", "glpat-", "xoxb-"), F.substr(F.translate(mixed, "+/", "x9"), F.lit(1), F.lit(30))))
        .when(k == 6, F.substr(h("d"), F.lit(1), width))
        .when(k == 7, F.concat(F.substr(h("v"), F.lit(1), F.lit(8)), F.lit("-"), F.substr(h("v"), F.lit(9), F.lit(4)), F.lit("-4"), F.substr(h("v"), F.lit(14), F.lit(3)), F.lit("-a"), F.substr(h("v"), F.lit(18), F.lit(3)), F.lit("-"), F.substr(h("v"), F.lit(21), F.lit(12))))
        .when(k.isin(8, 9), F.concat(word(1), choose("s", "_", "-", "/", ""), word(2), choose("t", "_", "-", "", "/"), number("n"), word(3), word(4)))
        .when(k == 10, F.concat(choose("x", "xxxxxxxxxxxx", "1234567890", "abcdef123456", "000000000000", "your-token-here-"), F.substr(F.lit("123456789012345"), F.lit(1), (pick("y", 8) + 6).cast("int"))))
        .when(k == 11, F.substr(F.translate(h("z"), "abcdef", "987654"), F.lit(1), F.lit(16)))
        .when(k == 12, F.concat(F.substr(mixed, F.lit(1), (pick("i", 7) + 3).cast("int")), sign, F.substr(mixed, F.lit(12), (pick("j", 6) + 3).cast("int"))))
        .when(k == 13, F.concat(F.when(pick("I", 2) == 0, F.initcap(word(5))).otherwise(word(5)), number("N"), choose("S", "", "!", "#", "", "$"), F.when(pick("W", 2) == 0, word(6)).otherwise("x7")))
        .when(k == 14, F.concat(choose("r", "${", "<", "{{ ", "%(", "os.environ[", "config.", "self.", "get_", "your-", "process.env.", "****"), F.when(pick("V", 2) == 0, F.upper(name)).otherwise(name), choose("R", "}", ">", " }}", ")", "]", "()", "")))
        .otherwise(F.concat(F.when(pick("J", 2) == 0, F.initcap(word(9))).otherwise(word(9)), choose("Q", "", "s", "-", "_", ""), word(10), choose("T", "", "ed", "er")))
    )
    before = F.when(k < 2, F.when(pick("b", 2) == 0, cued).otherwise(plain)).when(k < 6, F.when((k == 5) & (pick("b", 2) == 0), plain).otherwise(cued)).when(k.isin(10, 12, 13, 14, 15), cued).otherwise(F.when(pick("b", 3) == 0, plain).otherwise(other))
    after = F.when(before.endswith('"'), '" ').otherwise(choose("e", " ", ".", "\n", ", "))
    path = choose("f", "src1", "app/config.py", "web", "deploy/settings.env", "tests/example.py", "docs/readme.md", "")
    return rows.select(secret.alias("secret"), before.alias("before"), after.alias("after"), path.alias("path"), ((k < 6) | k.isin(12, 13)).cast("double").alias("label"))


def train(findings: DataFrame, trees: int = TREES, depth: int = DEPTH) -> RandomForestClassificationModel:
    rows = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(with_features(findings))
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=5, subsamplingRate=0.8).fit(rows.select("features", "label"))


def may_hold(text: Column) -> Column:
    """Whether a text can hold a candidate: it has a part of a cue and what sets it, or a long run."""
    low = F.lower(text)
    cue = None
    for part in CUE_PARTS:
        hit = F.contains(low, F.lit(part))
        cue = hit if cue is None else cue | hit
    return ((F.contains(text, F.lit("=")) | F.contains(text, F.lit(":")) | F.contains(low, F.lit("bearer"))) & cue) | text.rlike(_RUN)


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source") -> DataFrame:
    """One row per candidate: id, start (code points), secret, before, after, path. A null text has none."""
    text = F.col("_text")
    held = docs.select(F.col(id_col), F.col(path_col).cast("string").alias("path"), text_or_empty(text_col).alias("_text"))
    held = held.where(may_hold(text)).where(text.rlike(CANDIDATE))
    # between the candidates lie the pieces of a split at the same pattern, one more than there are candidates
    parts = held.withColumns({"_found": F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0)), "_between": F.split(text, CANDIDATE, -1)})
    sizes = F.transform("_found", lambda s, i: F.length(F.get("_between", i)) + F.when(i > 0, F.length(F.get("_found", i - 1))).otherwise(0))
    row = lambda s, i: F.struct(
        s.alias("secret"), F.get("_sizes", i).alias("gap"), F.right(F.get("_between", i), F.lit(NEAR)).alias("before"), F.left(F.get("_between", i + 1), F.lit(NEAR)).alias("after")
    )
    rows = parts.withColumn("_sizes", sizes).withColumn("_rows", F.transform("_found", row))
    exploded = rows.select(id_col, "path", F.posexplode("_rows").alias("_i", "m"), "_sizes")
    gap = F.aggregate(F.slice("_sizes", F.lit(1), F.col("_i") + 1), F.lit(0), lambda a, b: a + b)
    return exploded.select(id_col, gap.alias("start"), "m.secret", "m.before", "m.after", "path")


def scan(docs: DataFrame, model: RandomForestClassificationModel, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source", limit: float = LIMIT) -> DataFrame:
    """One row per candidate: id, start (code points), length, secret_sha256, probability, kept (probability >= limit).

    Null and empty texts have no candidates; a very long text is searched whole, each run of characters looked at once. Null ids and
    paths and repeated rows stay; a probability exactly at the limit is kept. Other columns are ignored. An empty table gives no
    rows. No row leaves its partition.
    """
    rows = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(with_features(candidates(docs, id_col, text_col, path_col)))
    scored = model.transform(rows).withColumn("probability", F.round(F.get(vector_to_array("probability"), F.lit(1)), 9))
    return scored.select(id_col, "start", F.length("secret").alias("length"), F.sha2("secret", 256).alias("secret_sha256"), "probability", (F.col("probability") >= limit).alias("kept"))
