"""Point-in-time context: what was known at a landmark, as rows and as text.

Event rows have person_id, event_id, enc_idx, ent_idx, flat_idx, ts, ts_raw and the event's fields; landmarks are (person_id,
cutoff) with cutoff a timestamp_ntz, any number per person. Joins are on the person, aggregation on (person, landmark).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chartspan.functions.text import blank_to_null, estimated_tokens, head_tail, last_tokens, one_spaced, title_case, vocabulary_of
from chartspan.functions.times import age_years, day_key, display, minutes_only, relative, within

KEY = ["person_id", "cutoff"]
#: The codes and note titles that the default linearisation lets through.
CODE_PREFIXES = ("STANFORD_ONCOLOGY", "NAACCR", "SNOMED", "STANFORD_SHC_DRUG", "STANFORD_PROC", "STANFORD_NOTE", "LOINC")
NOTE_TITLES = ("pathology", "imaging", "progress notes", "consults", "h&p", "radiation completion notes")
NOTE_PREFIX = "STANFORD_NOTE"
MISSING = ("no matching concept", "unknown", "none", "")
#: Attributes that identify records.
IDENTIFIERS = ("note_id", "procedure_occurrence_id", "image_occurrence_id", "image_series_uid", "image_study_uid", "visit_source_concept_id")
EVENT_TEXT = 2000


def at_landmarks(rows: DataFrame, landmarks: DataFrame, mode: str = "before") -> DataFrame:
    """Each landmark's events by the mode of times.within(); an inner join on the person."""
    return rows.join(landmarks.select(*KEY), "person_id").where(within(F.col("ts"), F.col("cutoff"), mode))


def single_visit(rows: DataFrame, landmarks: DataFrame) -> DataFrame:
    """The events up to the cutoff of the encounter that has the latest of them; of equal ones the first in the document."""
    known = at_landmarks(rows, landmarks, "through")
    last = known.groupBy(*KEY, "enc_idx").agg(F.max("ts").alias("_last"))
    chosen = last.groupBy(*KEY).agg(F.max_by("enc_idx", F.struct("_last", -F.col("enc_idx"))).alias("enc_idx"))
    return known.join(chosen, [*KEY, "enc_idx"], "left_semi")


def last_encounters(rows: DataFrame, landmarks: DataFrame, n: int | None) -> DataFrame:
    """The events up to the cutoff (undated ones too) of the last n encounters in the document that have any; all for 0 or None."""
    known = at_landmarks(rows, landmarks, "through_day")
    if not n:
        return known
    w = Window.partitionBy(*KEY).orderBy(F.desc("enc_idx"))
    kept = known.select(*KEY, "enc_idx").distinct().withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")
    return known.join(kept, [*KEY, "enc_idx"], "left_semi")


def event_line(lab: bool = False, key: Column | None = None) -> Column:
    """CODE | Name, with the value and its source unit where there is one, and the event's key in double brackets."""
    name = F.coalesce(blank_to_null(F.col("name")), blank_to_null(F.col("event_type")), F.lit(""))
    head = F.trim(F.concat(F.coalesce("code", F.lit("")), F.lit(" | "), name))
    measured = F.trim(F.concat(F.coalesce("value", F.lit("")), F.lit(" "), F.coalesce("unit_source_value", F.lit(""))))
    line = F.when(measured != "", F.concat(head, F.lit(" | "), measured)).otherwise(head)
    return line if key is None else F.concat(line, F.lit(" [["), key, F.lit("]]"))


def delta_encoded(rows: DataFrame, lab: bool = False, with_key: bool = False, max_tokens: int | None = None) -> DataFrame:
    """(person_id, cutoff, context): events by time and id, under a header line wherever the time changes; for lab tasks one
    header a day. Undated events come first, without a header unless they are lab events. The text's end is kept if it's too
    long. Rows of one (person, cutoff) meet in one group: a timeline."""
    head = day_key(F.col("ts")) if lab else display(F.col("ts"))
    w = Window.partitionBy(*KEY).orderBy(F.asc_nulls_first("ts"), "event_id")
    before = F.lag(F.struct(head.alias("h"), F.col("ts").alias("t"))).over(w)
    changed = before.isNull() if lab else before.isNull() & F.col("ts").isNotNull()
    changed = changed | (before.isNotNull() & (before["h"] != head if lab else ~before["t"].eqNullSafe(F.col("ts"))))
    key = F.concat(F.col("person_id").cast("string"), F.lit(":"), F.col("event_id").cast("string")) if with_key else None
    lined = rows.withColumns({"_new": changed, "_n": F.row_number().over(w), "_line": event_line(lab, key), "_head": head})
    lined = lined.withColumn("_line", F.when(F.col("_new"), F.concat("_head", F.lit("\n"), "_line")).otherwise(F.col("_line")))
    parts = F.array_sort(F.collect_list(F.struct("_n", "_line")))
    text = lined.groupBy(*KEY).agg(F.array_join(F.transform(parts, lambda p: p["_line"]), "\n").alias("context"))
    return text if max_tokens is None else text.withColumn("context", last_tokens(F.col("context"), max_tokens))


def allowed(prefixes: tuple[str, ...] | None = CODE_PREFIXES, titles: tuple[str, ...] | None = NOTE_TITLES) -> Column:
    """Codes of the prefixes; of notes only those of the titles."""
    prefix = vocabulary_of(F.coalesce("code", F.lit("")))
    ok = prefix.isin(list(prefixes)) if prefixes else F.lit(True)
    title = F.lower(F.trim(F.coalesce(F.col("attrs")["note_title"], F.lit(""))))
    return ok & ((prefix != NOTE_PREFIX) | title.isin(list(titles))) if titles else ok


def linearised(rows: DataFrame, landmarks: DataFrame, n_encounters: int | None = None, keep: Column | None = None) -> DataFrame:
    """(person_id, cutoff, text): `[time] type | code | name | body` lines in document order; bodies of one space and bounded."""
    body = F.nullif(head_tail(one_spaced(F.coalesce("text_all", F.lit(""))), EVENT_TEXT), F.lit(""))
    named = F.concat_ws(" | ", *[F.nullif(F.coalesce(F.col("attrs")[c], F.lit("")), F.lit("")) for c in ("type", "code", "name")])
    line = F.concat(F.lit("["), F.coalesce("ts_raw", F.lit("UNK_TIME")), F.lit("] "), F.concat_ws(" | ", F.nullif(named, F.lit("")), body))
    chosen = last_encounters(rows, landmarks, n_encounters)
    chosen = (chosen if keep is None else chosen.where(keep)).where(named != "")
    parts = F.array_sort(F.collect_list(F.struct("flat_idx", line.alias("line"))))
    return chosen.groupBy(*KEY).agg(F.array_join(F.transform(parts, lambda p: p["line"]), "\n").alias("text"))


def demographics(persons: DataFrame, landmarks: DataFrame) -> DataFrame:
    """(person_id, cutoff, demographics): a block of age at the cutoff, sex, race and ethnicity, empty where nothing is known.

    The age stands on the birthdate; the recorded one counts only where there is no birthdate at all."""
    first = persons.where("has_person").groupBy("person_id").agg(*[F.min_by(c, "enc_idx").alias(c) for c in ("birthdate", "age_years", "gender", "race", "ethnicity")])
    known = lambda c: F.when(~F.lower(F.trim(c)).isin(*MISSING), F.trim(c))
    rows = landmarks.select(*KEY).join(first, "person_id")
    born = F.col("birthdate").try_cast("date")
    age = F.when(born.isNotNull(), age_years(born, F.col("cutoff").cast("date"))).otherwise(F.trim("age_years").try_cast("int"))
    line = lambda name, c: F.concat(F.lit(f"{name}: "), c)
    lines = F.concat_ws("\n", F.concat(F.lit("Age: "), age.cast("string"), F.lit(" years")), line("Sex", F.lower(known(F.col("gender")))), line("Race", known(F.col("race"))), line("Ethnicity", known(F.col("ethnicity"))))
    block = F.when(lines != "", F.concat(F.lit("PATIENT DEMOGRAPHICS AT PREDICTION TIME:\n"), lines, F.lit("\n"))).otherwise("")
    return rows.select(*KEY, block.alias("demographics"))


def compact(rows: DataFrame, landmarks: DataFrame, most_bytes: int | None = None, compat: bool = False) -> DataFrame:
    """Events for the compact timeline: entries after the cutoff go, times become relative to it, identifiers go, and the oldest
    encounters go until the rest fits most_bytes. Times that aren't written to the minute are read all the same; with compat
    they are not, and their entries stay unfiltered with the time as it was."""
    ts = minutes_only(F.col("ts_raw")) if compat else F.col("ts")
    known = rows.join(landmarks.select(*KEY), "person_id").withColumn("_ts", ts).where("_ts is null or _ts <= cutoff")
    known = known.withColumns({
        "attrs": F.map_filter("attrs", lambda k, _: ~k.isin(*IDENTIFIERS)),
        "when": F.coalesce(relative(F.col("_ts"), F.col("cutoff")), F.col("ts_raw")),
    })
    if most_bytes:
        size = known.groupBy(*KEY, "enc_idx").agg(F.sum(F.octet_length("content")).alias("_size"))
        w = Window.partitionBy(*KEY).orderBy(F.desc("enc_idx")).rowsBetween(Window.unboundedPreceding, 0)
        kept = size.withColumn("_sum", F.sum("_size").over(w)).where(F.col("_sum") <= most_bytes)
        known = known.join(kept.select(*KEY, "enc_idx"), [*KEY, "enc_idx"], "left_semi")
    return known.drop("_ts")


def compact_persons(persons: DataFrame, landmarks: DataFrame) -> DataFrame:
    """(person_id, cutoff, age, gender, race, ethnicity): the compact timeline's person block. The age at the cutoff is days over 365.25,
    floored; birthdate, recorded age and payer are left out."""
    first = persons.where("has_person").groupBy("person_id").agg(*[F.min_by(c, "enc_idx").alias(c) for c in ("birthdate", "gender", "race", "ethnicity")])
    days = F.datediff(F.col("cutoff").cast("date"), F.col("birthdate").try_cast("date"))
    return landmarks.select(*KEY).join(first, "person_id").select(*KEY, F.floor(days / 365.25).cast("int").alias("age"), "gender", "race", "ethnicity")


def hoisted(rows: DataFrame) -> DataFrame:
    """(person_id, cutoff, enc_idx, ent_idx, when, events) of what compact() kept: entries straight below their encounter, with their events
    in order. Encounters and entries without events are not there."""
    event = F.struct("flat_idx", "event_type", "code", "name", "value", "unit", "attrs")
    return rows.groupBy(*KEY, "enc_idx", "ent_idx").agg(F.min_by("when", "flat_idx").alias("when"), F.array_sort(F.collect_list(event), lambda a, b: a["flat_idx"] - b["flat_idx"]).alias("events"))


def token_prefix(rows: DataFrame, key: list[str], order: list[Column], text: str, budget: int) -> DataFrame:
    """Of each key the first rows that fit the budget; it ends at the first that doesn't."""
    w = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("run_tokens", F.sum(estimated_tokens(F.col(text))).over(w)).where(F.col("run_tokens") <= budget)


def size_suffix(rows: DataFrame, key: list[str], order: list[Column], size: Column, budget: int) -> DataFrame:
    """Of each key the last rows by `order` (given from the last on) whose sizes fit the budget together."""
    w = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("run_size", F.sum(size).over(w)).where(F.col("run_size") <= budget)


def dated_line(ts: Column, text: Column) -> Column:
    return F.concat(F.lit("["), F.date_format(ts, "MMMM dd, yyyy"), F.lit("] "), text)


def landmark_categories(landmarks: DataFrame, rows: DataFrame) -> DataFrame:
    """landmarks with `category`: no_events, undated, before_first, same_day or after, by the person's first dated event."""
    first = rows.groupBy("person_id").agg(F.min("ts").alias("_first"), F.count(F.lit(1)).alias("_events"))
    day = F.col("cutoff").cast("date")
    category = (
        F.when(F.col("_events").isNull(), "no_events").when(F.col("_first").isNull(), "undated").when(day < F.col("_first").cast("date"), "before_first").when(day == F.col("_first").cast("date"), "same_day").otherwise("after")
    )
    return landmarks.join(first, "person_id", "left").withColumn("category", category).drop("_first", "_events")


def normalised_gender(c: Column) -> Column:
    return F.when(blank_to_null(c).isNull(), None).when(F.upper(c).isin("FEMALE", "MALE"), F.initcap(c)).otherwise(title_case(c))
