"""Pattern-based PII: detection with spans, column summary, masking, encryption, restore.

A recogniser reads a value in one of two ways, both in time linear in its length. An
anchored one splits the value at its anchor and widens from there: to the left over the
characters that may stand before it, to the right by a pattern. Any other cuts the value
into candidates by ``token``, taking runs that touch further word characters whole, and
tests a candidate from end to end by ``accept``. A hit is then never part of a longer
run, without look-around. All work is built-in expressions.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from etlvault.functions.columns import col, cols, ratio_pct, string_columns
from etlvault.functions.masking import decrypt, encrypt, fingerprint, luhn, mask, secret


@dataclass(frozen=True)
class Recogniser:
    """One entity. ``prefilter`` is a cheap test that no value with a hit can fail.

    With ``anchor``, ``token`` is the class of characters that may stand before it, one at
    least, and ``accept`` the pattern of what follows it.
    """

    entity: str
    token: str
    accept: str
    score: float
    prefilter: str
    validator: Callable[[Column], Column] | None = None
    weak_score: float = 0.3
    anchor: str = ""

    @property
    def pattern(self) -> str:
        """The candidates as one pattern, for engines that match without backtracking."""
        return f"{self.token}+{self.anchor}{self.accept}" if self.anchor else self.token

    def confidence(self, hit: Column) -> Column:
        if self.validator is None:
            return F.lit(self.score)
        return F.when(self.validator(hit), F.lit(self.score)).otherwise(F.lit(self.weak_score))


def _octets(hit: Column) -> Column:
    return F.forall(F.split(hit, "\\."), lambda part: part.cast("int") <= 255)


# Patterns and scores; list order breaks ties between hits that start together.
_AT = "@"
_SSN_FORM, _DATE_FORM = "[0-9]{3}-[0-9]{2}-[0-9]{4}", "[0-9]{4}-[0-9]{2}-[0-9]{2}"
# possessive repeats run as a loop in Java; plain ones recurse once per part of a long run
_WORD_RUN = r"[A-Za-z0-9_]++(?:-[A-Za-z0-9_]++)*+"
RECOGNISERS = (
    Recogniser("EMAIL_ADDRESS", r"[A-Za-z0-9._%+-]", r"[A-Za-z0-9.-]+\.[A-Za-z]{2,}", 1.0, _AT, anchor=_AT),
    Recogniser("US_SSN", _WORD_RUN, f"^{_SSN_FORM}$", 0.85, _SSN_FORM),
    Recogniser("CREDIT_CARD", r"[0-9]{4}[ -][0-9]{4}[ -][0-9]{4}[ -][0-9]+|[0-9]{4}[ -][0-9]{6}[ -][0-9]+|[A-Za-z0-9_]+",
               r"^(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})$", 1.0,
               "[0-9](?:[ -]?[0-9]){12}", luhn),
    Recogniser("IP_ADDRESS", r"[A-Za-z0-9_]++(?:\.[A-Za-z0-9_]++)*+", r"^[0-9]{1,3}(?:\.[0-9]{1,3}){3}$", 0.95,
               r"[0-9]\.[0-9]{1,3}\.[0-9]", _octets),
    Recogniser("DATE_TIME", _WORD_RUN, r"^[0-9]{4}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12][0-9]|3[01])$", 0.6, _DATE_FORM),
    Recogniser("PHONE_NUMBER", r"\+[0-9]{1,3}[ .-]?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-]?)[0-9]{3}[ .-]?[0-9]{4}[0-9]*"
               r"|\+[0-9]{1,3}(?:[ .-][0-9]{2,4}){2,4}[0-9]*|\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]+|[0-9]{3}[ .-][0-9]{3}[ .-][0-9]+"
               r"|[A-Za-z0-9_]++(?:\.[0-9]++)*+",
               r"^\+[0-9]{1,3}[ .-]?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-]?)[0-9]{3}[ .-]?[0-9]{4}$|^\+[0-9]{1,3}(?:[ .-][0-9]{2,4}){2,4}$"
               r"|^\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}$|^[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4}$", 0.75, r"[ .-][0-9]{4}|\+[0-9]"),
)

# Score a hit must reach, per entity, and the single threshold of the plain form.
THRESHOLDS = {"EMAIL_ADDRESS": 0.5, "US_SSN": 0.5, "PHONE_NUMBER": 0.5, "CREDIT_CARD": 0.5, "IP_ADDRESS": 0.5,
              "DATE_TIME": 0.6, "PERSON": 0.7, "LOCATION": 0.7}
DEFAULT_THRESHOLD, GLOBAL_THRESHOLD = 0.5, 0.4
HIGH_CONFIDENCE = 0.85


_SPANS = "array<struct<run:string,start:int,end:int>>"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _anchored_spans(value: Column, rec: Recogniser) -> Column:
    """Hits of an anchored recogniser: one step per piece between anchors.

    The piece before an anchor is read backwards, so that its run of allowed characters is
    one anchored, possessive match; a run starts no earlier than the hit before it ends.
    """
    before, after = f"^{rec.token}*+", f"^(?:{rec.accept})"
    size, start = F.lit(len(rec.anchor)), F.struct(F.lit(0).alias("at"), F.lit(0).alias("free"), F.array().cast(_SPANS).alias("out"))

    def step(state: Column, s: Column) -> Column:
        spot = state["at"] + F.length(s["left"])
        begin = F.greatest(spot - s["reach"], state["free"])
        end = spot + size + F.length(s["right"])
        run = F.concat(F.substring(s["left"], F.length(s["left"]) - (spot - begin) + 1, spot - begin), F.lit(rec.anchor), s["right"])
        hit = F.array(F.struct(run.alias("run"), begin.alias("start"), end.alias("end")))
        is_hit = (begin < spot) & (s["right"] != "")
        return F.struct((spot + size).alias("at"), F.when(is_hit, end).otherwise(state["free"]).alias("free"),
                        F.when(is_hit, F.concat(state["out"], hit)).otherwise(state["out"]).alias("out"))

    def spans(pieces: Column) -> Column:
        n = F.size(pieces) - 1
        steps = F.zip_with(F.slice(pieces, F.lit(1), n), F.slice(pieces, F.lit(2), n), lambda left, right: F.struct(
            left.alias("left"), F.length(F.regexp_extract(F.reverse(left), before, 0)).alias("reach"),
            F.regexp_extract(right, after, 0).alias("right")))
        return F.aggregate(steps, start, step, lambda state: state["out"])

    return _let(F.split(value, re.escape(rec.anchor), -1), spans)


def _token_spans(value: Column, rec: Recogniser) -> Column:
    """Hits among the candidates that ``token`` cuts out; spans only for values with an accepted one."""
    empty = F.array().cast(_SPANS)
    start = F.struct(F.lit(0).alias("at"), empty.alias("out"))

    def accepted(run: Column) -> Column:
        return F.regexp_like(run, F.lit(rec.accept)) if rec.accept else F.lit(True)

    def step(state: Column, s: Column) -> Column:
        begin = state["at"] + s["g"]
        end = begin + F.length(s["r"])
        found = F.array(F.struct(s["r"].alias("run"), begin.alias("start"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(s["ok"], F.concat(state["out"], found)).otherwise(state["out"]).alias("out"))

    def spans(runs: Column) -> Column:
        gaps = F.slice(F.split(value, rec.token, -1), F.lit(1), F.size(runs))
        steps = F.zip_with(gaps, runs, lambda gap, run: F.struct(F.length(gap).alias("g"), run["r"].alias("r"), run["ok"].alias("ok")))
        return F.when(F.exists(runs, lambda run: run["ok"]), F.aggregate(steps, start, step, lambda state: state["out"])).otherwise(empty)

    runs = F.regexp_extract_all(value, F.lit(rec.token), F.lit(0))
    return _let(F.transform(runs, lambda run: F.struct(run.alias("r"), accepted(run).alias("ok"))), spans)


def _hits(value: Column, rec: Recogniser, priority: int, threshold: float) -> Column:
    """Array of the recogniser's accepted hits with their spans (start inclusive, end exclusive)."""
    spans = _anchored_spans(value, rec) if rec.anchor else _token_spans(value, rec)
    scored = F.transform(spans, lambda s: F.struct(
        s["start"].alias("start_char"), F.lit(priority).alias("priority"), s["end"].alias("end_char"),
        F.lit(rec.entity).alias("entity_type"), rec.confidence(s["run"]).alias("confidence")))
    test = value.contains(rec.prefilter) if rec.prefilter == _AT else F.regexp_like(value, F.lit(rec.prefilter))
    return F.when(test, F.filter(scored, lambda h: h["confidence"] >= threshold))


def cell_hits(value: Column, recognisers: Sequence[Recogniser] = RECOGNISERS,
              threshold: float | None = None) -> Column:
    """All hits of a value, ordered by position then recogniser order."""
    per_entity = [
        _hits(value, r, i, threshold if threshold is not None else THRESHOLDS.get(r.entity, DEFAULT_THRESHOLD))
        for i, r in enumerate(recognisers)
    ]
    kind = "array<struct<start_char:int,priority:int,end_char:int,entity_type:string,confidence:double>>"
    blank = F.array().cast(kind)
    return F.array_sort(F.concat(*[F.coalesce(h, blank) for h in per_entity]))


def _cells(df: DataFrame, row_id: str, columns: Sequence[str] | None) -> DataFrame:
    """The string cells in long form, blank ones left out."""
    columns = list(columns or string_columns(df))
    empty = F.array().cast("array<struct<column_name:string,v:string>>")
    cells = F.array(*[F.struct(F.lit(c).alias("column_name"), col(c).alias("v")) for c in columns]) if columns else empty
    return df.select(col(row_id).alias("row_id"), F.inline(cells)).filter(F.trim("v") != "")


def detect(df: DataFrame, row_id: str, columns: Sequence[str] | None = None,
           recognisers: Sequence[Recogniser] = RECOGNISERS, threshold: float | None = None) -> DataFrame:
    """One row per hit in any string column: column, row, entity, confidence and span. No shuffle."""
    found = _cells(df, row_id, columns).select("row_id", "column_name", cell_hits(F.col("v"), recognisers, threshold).alias("h"))
    return found.select("row_id", "column_name", F.inline("h")).select(
        "column_name", "row_id", "entity_type", "confidence", "start_char", "end_char")


def column_summary(detections: DataFrame, df: DataFrame, dataset: str, run_ts: str,
                   columns: Sequence[str] | None = None) -> DataFrame:
    """Per string column: entities found, confidences and the share of non-null rows flagged."""
    columns = list(columns or string_columns(df))
    counts = [F.struct(F.lit(c).alias("column_name"), F.count(col(c)).alias("n_non_null")) for c in columns]
    base = df.agg(F.array(*counts).alias("c")).select(F.inline("c"))
    # hits of a row collapse to one row per column, row and entity before anything is gathered
    rows = detections.groupBy("column_name", "row_id", "entity_type").agg(
        F.count("*").alias("n"), F.sum(F.col("confidence").cast("decimal(10,6)")).alias("s"),
        F.max("confidence").alias("hi"), F.min("confidence").alias("lo"))
    found = rows.groupBy("column_name").agg(
        F.sort_array(F.collect_set("entity_type")).alias("types"), F.count_distinct("row_id").alias("n_flagged_rows"),
        (F.sum("s").cast("double") / F.sum("n")).alias("avg"), F.max("hi").alias("max"), F.min("lo").alias("min"))
    n = F.coalesce(F.size("types"), F.lit(0))
    flagged = F.coalesce("n_flagged_rows", F.lit(0))
    return base.join(found, "column_name", "left").select(
        F.lit(dataset).alias("dataset_name"), F.lit(run_ts).alias("run_timestamp"), "column_name",
        F.col("types").isNotNull().alias("is_pii"),
        F.when(F.col("types").isNotNull(), F.array_join("types", ", ")).alias("detected_entity_types"),
        F.when(F.col("types").isNull(), 0).otherwise(n).alias("n_entity_types"),
        F.round("avg", 6).alias("avg_confidence"), F.round("max", 6).alias("max_confidence"),
        F.round("min", 6).alias("min_confidence"), flagged.alias("n_flagged_rows"),
        ratio_pct(flagged, F.col("n_non_null"), 4).alias("pct_flagged_rows"),
        F.lit("mask + encrypt").alias("anonymization_method"))


def flagged_columns(summary: DataFrame, at_least: float = HIGH_CONFIDENCE) -> DataFrame:
    """Columns flagged as PII with their best hit at or above a confidence, best first."""
    return summary.filter(F.col("is_pii") & (F.col("max_confidence") >= at_least)).orderBy(F.desc("avg_confidence"), "column_name")


def anonymise(df: DataFrame, dataset: str, run_ts: str, row_id: str, columns: Sequence[str] | None = None,
              recognisers: Sequence[Recogniser] = RECOGNISERS) -> DataFrame:
    """The frame with every cell that holds PII masked whole, by its first hit. One projection."""
    columns = list(columns or string_columns(df))
    # named first, so that a detection is evaluated once and not per branch of the mask
    entities = {c: F.get(cell_hits(col(c), recognisers), F.lit(0))["entity_type"] for c in columns}
    found = df.withColumns({f"__e_{c}": e for c, e in entities.items()})
    out = []
    for c in df.columns:
        entity = col(f"__e_{c}")
        out.append(F.when(entity.isNotNull(), mask(col(c), entity)).otherwise(col(c)).alias(c) if c in columns else col(c))
    return found.select(F.lit(dataset).alias("dataset_name"), F.lit(run_ts).alias("run_timestamp"),
                     col(row_id).alias("row_index"), *out)


def vault_cells(df: DataFrame, row_id: str, dataset: str, run_ts: str, key_id: str, key: str | None = None,
                columns: Sequence[str] | None = None, recognisers: Sequence[Recogniser] = RECOGNISERS) -> DataFrame:
    """Detections with masked value and encrypted original of their cell, one row per hit."""
    k = secret(df.sparkSession, key)
    rows = _cells(df, row_id, columns).withColumn("h", cell_hits(F.col("v"), recognisers)).filter(F.size("h") > 0)
    sealed = rows.select("row_id", "column_name", "v", encrypt(F.col("v"), k).alias("encrypted_value"), F.inline("h"))
    return sealed.select(
        F.lit(dataset).alias("dataset_name"), F.lit(run_ts).alias("run_timestamp"), "column_name", "row_id",
        mask(F.col("v"), F.col("entity_type")).alias("masked_value"), "encrypted_value", "entity_type",
        F.round("confidence", 6).alias("confidence"), "start_char", "end_char", F.lit(key_id).alias("key_id"))


def key_registry(spark: SparkSession, cells: DataFrame, dataset: str, run_ts: str, key_id: str, key: str | None = None) -> DataFrame:
    """Key id, fingerprint and entities covered. The key itself is never written."""
    return cells.agg(F.array_join(F.sort_array(F.collect_set("entity_type")), ", ").alias("entities_covered")).select(
        F.lit(dataset).alias("dataset_name"), F.lit(run_ts).alias("run_timestamp"), F.lit(key_id).alias("key_id"),
        fingerprint(spark, key).alias("key_fingerprint"), "entities_covered")


def restore(masked: DataFrame, row_id: str, cells: DataFrame, columns: Sequence[str], key: str | None = None) -> DataFrame:
    """Put the original values back by (row, column); a token that does not open leaves its mask.

    ``n_unopened`` counts such cells per row.
    """
    k = secret(masked.sparkSession, key)
    tokens = cells.groupBy(F.col("row_id").alias(row_id)).agg(*[
        F.max(F.when(F.col("column_name") == c, F.col("encrypted_value"))).alias(f"__{c}") for c in columns])
    joined = masked.join(tokens, [row_id], "left")
    opened = joined.withColumns({f"__o_{c}": decrypt(col(f"__{c}"), k) for c in columns})
    unopened = reduce(Column.__add__, [(col(f"__{c}").isNotNull() & col(f"__o_{c}").isNull()).cast("int") for c in columns])
    return opened.select(*[F.coalesce(col(f"__o_{c}"), col(c)).alias(c) if c in columns else col(c) for c in masked.columns],
                         unopened.alias("n_unopened"))


def roundtrip_check(original: DataFrame, restored: DataFrame, row_id: str, columns: Sequence[str]) -> DataFrame:
    """Per column, the non-null original cells that the restored frame does not give back."""
    pairs = original.select(col(row_id), *[col(c).alias(f"o_{c}") for c in columns]).join(
        restored.select(col(row_id), *[col(c).alias(f"r_{c}") for c in columns]), [row_id], "left")
    counts = [F.struct(F.lit(c).alias("column_name"), F.count(col(f"o_{c}")).alias("cells"),
                       F.count_if(col(f"o_{c}").isNotNull() & ~col(f"o_{c}").eqNullSafe(col(f"r_{c}"))).alias("mismatches"))
              for c in columns]
    return pairs.agg(F.array(*counts).alias("c")).select(F.inline("c"))
