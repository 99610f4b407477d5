"""Labels and model answers: normalising, parsing, binarising."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chartspan.functions.text import blank_to_null, clamp_words, one_spaced

#: How answers are written.
YES, NO = ("yes", "true", "1", "positive", "y"), ("no", "false", "0", "negative", "n")
GRADES = ("normal", "mild", "moderate", "severe")
SYNONYMS = {"severe": ("critical", "3", "high", "severe"), "moderate": ("mod", "2", "medium", "moderate"), "mild": ("1", "low", "mild"), "normal": ("0", "nl", "normal", "none")}
LEAD = r"\b(?:answer is|answer:|conclusion:|therefore|i (?:would )?say|final answer:?)\s*"
NO_REASON = "Evidence is limited in the provided summary."


def _found(c: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def _yes_no(c: Column) -> Column:
    low = F.lower(F.trim(c))
    return F.when(low.isin(*YES), "yes").when(low.isin(*NO), "no")


def binary(raw: Column) -> Column:
    """yes or no: a JSON outcome first, then the whole text, then after a lead-in, then in the last 80 characters if only one is there."""
    low = F.lower(raw)
    tail = F.right(low, F.lit(80))
    has = lambda w: tail.rlike(rf"\b{w}\b")
    return F.coalesce(
        F.when(F.trim(raw).startswith("{"), _yes_no(F.get_json_object(raw, "$.outcome"))), _yes_no(raw), F.when(low.rlike(LEAD + r"(yes|y)\b"), "yes").when(low.rlike(LEAD + r"(no|n)\b"), "no"),
        F.when(has("yes") & ~has("no"), "yes").when(has("no") & ~has("yes"), "no"),
    )


def categorical(raw: Column) -> Column:
    """One of the GRADES: the whole text or a synonym, else the first that a sentence names."""
    low = F.lower(raw)
    whole = None
    for grade, names in SYNONYMS.items():
        hit = F.trim(low).isin(*names)
        whole = F.when(hit, grade) if whole is None else whole.when(hit, grade)
    any_ = "(severe|moderate|mild|normal)"
    return F.coalesce(whole, _found(low, rf"\b(?:severity is|answer is|answer:|classification:?|level:?)\s*{any_}\b"), _found(low, rf"\b{any_}\b"))


def grade_number(c: Column) -> Column:
    at = F.array_position(F.array(*map(F.lit, GRADES)), F.lower(F.trim(c)))
    return F.when(at > 0, at - 1).cast("int")


def ground_truth(c: Column, is_binary: bool = True) -> Column:
    low = F.lower(blank_to_null(c))
    if is_binary:
        return F.when(low.isin("true", "1", "yes"), "yes").when(low.isin("false", "0", "no"), "no")
    number = low.try_cast("int")
    by_number = F.when(number.between(0, 3), F.element_at(F.array(*map(F.lit, GRADES)), number + 1))
    return F.coalesce(by_number, F.when(low.isin(*GRADES), low))


def parse_yes_no(c: Column) -> Column:
    """Yes or No by the first word, else the first yes or no anywhere."""
    first = F.lower(F.regexp_replace(F.regexp_extract(F.trim(c), r"^(\S+)", 1), r"""^[.,;:!?"'`)]+|[.,;:!?"'`)]+$""", ""))
    later = F.lower(F.regexp_extract(c, r"(?i)\b(yes|no)\b", 1))
    return F.when(first.isin("yes", "y", "1", "true"), "Yes").when(first.isin("no", "n", "0", "false"), "No").when(later == "yes", "Yes").when(later == "no", "No")


def parse_tri(c: Column) -> Column:
    """-1, 0 or 1: the text itself, else the first such number after a word boundary."""
    t = F.trim(c)
    return F.when(t.isin("-1", "0", "1"), t).otherwise(_found(t, r"\b(-1|0|1)\b"))


def tool_label(c: Column) -> Column:
    return F.when(F.lower(F.trim(c)).isin("true", "1", "yes"), "yes").otherwise("no")


def label_for(labels: DataFrame, patients: DataFrame, order: str = "_row") -> DataFrame:
    """patients(patient_id) with the label of their first row, whatever its time; null where there is none."""
    w = Window.partitionBy("patient_id").orderBy(order)
    first = labels.withColumn("_n", F.row_number().over(w)).where("_n = 1").select("patient_id", tool_label(F.col("label")).alias("prediction"))
    return patients.join(first, "patient_id", "left")


def binarised(c: Column, kind: str, chest_normal: str = "8192") -> Column:
    """1 positive or abnormal, 0 not: `bool`, `lab` (0 normal), `categorical` (0 against the rest), `chest` (its normal code)."""
    low = F.lower(F.trim(c))
    if kind == "bool":
        return F.when(low.isin("true", "1", "yes"), 1).when(low.isin("false", "0", "no"), 0)
    if kind in ("lab", "categorical"):
        return F.when(low.try_cast("double").isNotNull(), (low.try_cast("double") != 0).cast("int"))
    if kind == "chest":
        return F.when(low != "", (low != chest_normal).cast("int"))
    raise ValueError(f"no such kind: {kind}")


def iso_time(c: Column) -> Column:
    return F.replace(F.trim(c), F.lit(" "), F.lit("T"))


def reason(c: Column) -> Column:
    """The reason of a JSON answer, or the text behind `Reason:`; one-spaced, at most 45 words."""
    text = F.trim(F.coalesce(c, F.lit("")))
    given = F.when(text.startswith("{"), blank_to_null(F.get_json_object(text, "$.reason")))
    plain = one_spaced(F.coalesce(given, F.regexp_replace(text, r"(?i)^reason:\s*", "")))
    short = F.regexp_replace(clamp_words(plain, 45), r"[ ,;:]+$", "")
    clamped = F.when(F.size(F.split(plain, " ")) > 45, F.when(short.endswith("."), short).otherwise(F.concat(short, F.lit(".")))).otherwise(plain)
    return F.coalesce(F.nullif(clamped, F.lit("")), F.lit(NO_REASON))


def is_calculation(c: Column) -> Column:
    """Whether a question is a sum alone, without a word of the clinic."""
    low = F.lower(F.trim(c))
    asks = r"what is \d+|calculate \d+|compute \d+|\d+\s*[+\-*/]\s*\d+|what'?s? \d+|how much is \d+"
    return low.rlike(asks) & ~low.rlike("patient|age|weight|height|bmi|blood|pressure|lab|test|result")
