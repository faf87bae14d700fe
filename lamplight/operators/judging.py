"""Answers of a judge as rows.

A judge is any function from a column of prompts to a column of answers; `stub_judge` answers nothing to find. What an
answer means is worked out here: the JSON in it, rows with defaults, one row that says so where there is none.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Kinds of signals, dimensions by pack, and those that gate a chapter or only inform.
SIGNAL_KINDS = ["fact_contradiction", "wrong_place", "tone_understatement", "other"]
PROSE = ["prose.repetition", "prose.rhythm", "prose.show_vs_tell", "prose.dialogue", "prose.vocabulary"]
NARRATIVE = ["narrative.character_arcs", "narrative.pacing", "narrative.themes", "narrative.structure", "narrative.world_building"]
CONSISTENCY = ["consistency.plot_holes", "consistency.timeline", "consistency.foreshadowing", "consistency.unresolved", "consistency.character"]
GATE = ["consistency.character", "consistency.timeline", "consistency.plot_holes"]
INFO = ["consistency.foreshadowing", "consistency.unresolved"]
FLOOR = 0.55


def dimensions(spark) -> DataFrame:
    """Pack, dimension, role (gate, info or none)."""
    rows = [(pack, d, "gate" if d in GATE else "info" if d in INFO else None) for pack, names in (("prose", PROSE), ("narrative", NARRATIVE), ("consistency", CONSISTENCY)) for d in names]
    return spark.createDataFrame(rows, "pack string, dimension string, role string")


def without_fences(text: Column) -> Column:
    """an answer in a Markdown fence without the lines of the fence."""
    trimmed = F.trim(F.coalesce(text, F.lit("")))
    lines = F.filter(F.split(trimmed, "\n"), lambda x: ~F.ltrim(x).startswith("```"))
    return F.when(trimmed.startswith("```"), F.trim(F.array_join(lines, "\n"))).otherwise(trimmed)


def signal_kind(kind: Column) -> Column:
    """a known kind in lower case, other for any other text, null for none."""
    low = F.lower(F.trim(kind))
    return F.when(low.isNull() | (low == ""), F.lit(None)).when(low.isin(SIGNAL_KINDS), low).otherwise("other")


def needs_enrich(severity: Column, confidence: Column, strengths: bool = False, floor: float = FLOOR) -> Column:
    """M08."""
    return (severity == "concern") | (F.lit(strengths) & (severity == "strength")) | (confidence < floor)


def openings(text: str) -> list[tuple[int, str]]:
    """Where brackets open at depth 0, outside of strings."""
    out, depth, quoted, skip = [], 0, False, False
    for i, c in enumerate(text):
        if quoted:
            skip, quoted = (c == "\\" and not skip), quoted and (c != '"' or skip)
        elif c == '"':
            quoted = True
        elif c in "[{":
            out += [(i, c)] if not depth else []
            depth += 1
        elif c in "]}":
            depth = max(0, depth - 1)
    return out


def decoded(text: str | None, opener: str) -> dict | list | None:
    """The JSON object ("{") or array ("[") that an answer is, or else the first that opens at depth 0 in it."""
    text = (text or "").strip()
    if text.startswith("```"):
        text = "\n".join(x for x in text.split("\n") if not x.strip().startswith("```")).strip()
    kind = dict if opener == "{" else list
    for at in [0, *[i for i, c in openings(text) if c == opener]]:
        try:
            value = json.JSONDecoder().raw_decode(text, at)
        except ValueError:
            continue
        if isinstance(value[0], kind) and (at or value[1] == len(text) or text.startswith(opener)):
            return value[0]
    return None


def _text(x: object) -> str:
    return "" if x is None else x if isinstance(x, str) else json.dumps(x, ensure_ascii=False) if isinstance(x, (dict, list)) else str(x)


FACTS = "struct<characters:array<struct<name:string,details:string>>,location:string,timeline_markers:array<string>,established_facts:array<string>,key_objects:array<struct<name:string,details:string>>,parse_failed:boolean>"


def facts_of(answer: str | None) -> dict:
    """An answer as a fact sheet; one without content is marked as failed."""
    data = decoded(answer, "{") or {}
    items = lambda key: data.get(key) if isinstance(data.get(key), list) else []
    plain = lambda key: [t for t in (_text(x).strip() for x in items(key)) if t]

    def entries(key: str, detail: str) -> list[dict[str, str]]:
        out = []
        for x in items(key):
            name, more = (_text(x.get("name")).strip(), _text(x.get(detail) or x.get("details") or x.get("description")).strip()) if isinstance(x, dict) else (_text(x).strip(), "")
            if name or more:
                out.append({"name": name or "?", "details": more})
        return out

    empty = not any(data.get(k) for k in ("characters", "timeline_markers", "established_facts", "key_objects")) and not _text(data.get("location")).strip()
    return {"characters": entries("characters", "details"), "location": _text(data.get("location")), "timeline_markers": plain("timeline_markers"), "established_facts": plain("established_facts"), "key_objects": entries("key_objects", "description"), "parse_failed": empty}


FINDINGS = "array<struct<dimension:string,severity:string,summary:string,evidence:string,counter_evidence:string,chapter_ref:string,signal_kind:string>>"


def findings_of(answer: str | None, pack: str) -> list[dict]:
    """An answer as findings. An empty array is none; an answer without findings is one row that says so: a concern
    of the consistency pack, neutral elsewhere."""
    data = decoded(answer, "[")
    rows = [x for x in data or [] if isinstance(x, dict)]
    if not rows and data != []:
        bad = {"consistency": ("consistency.general", "concern", "Consistency check failed to parse structured findings")}
        dimension, severity, summary = bad.get(pack, (f"{pack}.general", "neutral", f"{pack.capitalize()} analysis could not be parsed"))
        return [{"dimension": dimension, "severity": severity, "summary": summary, "evidence": (answer or "").strip()[:500], "counter_evidence": "", "chapter_ref": "all", "signal_kind": None}]
    default = {"dimension": f"{pack}.unknown", "severity": "neutral"}
    out = [{k: _text(x.get(k, default.get(k, ""))) for k in ("dimension", "severity", "summary", "evidence", "counter_evidence", "chapter_ref", "signal_kind")} for x in rows]
    for row in out:
        kind = row["signal_kind"].strip().lower()
        row["signal_kind"] = None if not kind else kind if kind in SIGNAL_KINDS else "other"
    return out


def enrich_map(answer: str | None) -> list[dict]:
    """An answer as dimension -> fields; anything but an object of objects is empty."""
    data = decoded(answer, "{") or {}
    return [{"dimension": k, **{f: v.get(f) if v.get(f) is None else _text(v.get(f)) for f in ("summary", "evidence", "chapter_ref", "counter_evidence")}} for k, v in data.items() if isinstance(v, dict)]


ENRICHED = "array<struct<dimension:string,summary:string,evidence:string,chapter_ref:string,counter_evidence:string>>"


def parsed(rows: DataFrame, answer: str, how, kind: str, *args: object, name: str = "parsed") -> DataFrame:
    """A column of answers parsed by one of the functions above."""

    def run(column: pd.Series) -> pd.Series:
        return pd.Series([[how(a, *args)] if single else how(a, *args) for a in column])

    single = kind.startswith("struct")  # a struct travels as a list of one
    made = F.pandas_udf(run, f"array<{kind}>" if single else kind)(F.col(answer))
    return rows.withColumn(name, F.get(made, F.lit(0)) if single else made)


def stub_judge(prompts: Column) -> Column:
    """A judge that finds nothing, for runs without a model."""
    return F.when(prompts.isNull(), F.lit(None)).otherwise(F.lit("[]"))


def judged(prompts: DataFrame, prompt: str, pack: str, judge=stub_judge) -> DataFrame:
    """Prompts -> findings, one row each, by way of a judge."""
    answered = parsed(prompts.withColumn("answer", judge(F.col(prompt))), "answer", findings_of, FINDINGS, pack)
    return answered.select(*prompts.columns, F.explode("parsed").alias("f")).select(*[c for c in prompts.columns if c != prompt], "f.*")


def fact_sheets(chapters: DataFrame, prompt: str, judge=stub_judge) -> DataFrame:
    """Chapters with fact sheets; an answer that failed is asked once more, and kept as failed if it fails again."""
    first = parsed(chapters.withColumn("answer", judge(F.col(prompt))), "answer", facts_of, FACTS, name="sheet")
    repair = judge(F.concat(F.col(prompt), F.lit("\n\nReturn only the JSON object.")))
    once_more = first.withColumn("answer", F.when(F.col("sheet.parse_failed"), repair).otherwise(F.col("answer")))
    return parsed(once_more.drop("sheet"), "answer", facts_of, FACTS, name="sheet")


def enriched(findings: DataFrame, better: DataFrame) -> DataFrame:
    """Fields of the enrich map over those of the findings; the severity is never touched. better: dimension
    and the fields, one row for a dimension."""
    fields = ["summary", "evidence", "chapter_ref", "counter_evidence"]
    new = better.select("dimension", *[F.nullif(F.trim(c), F.lit("")).alias(f"_{c}") for c in fields])
    out = findings.join(new, "dimension", "left")
    return out.select(*[F.coalesce(f"_{c}", c).alias(c) if c in fields else F.col(c) for c in findings.columns])


def demoted(findings: DataFrame) -> DataFrame:
    """Concerns without evidence, and those of tone alone, become neutral."""
    empty = F.trim(F.coalesce("evidence", F.lit(""))) == ""
    soft = signal_kind(F.col("signal_kind")) == "tone_understatement"
    return findings.withColumn("severity", F.when((F.col("severity") == "concern") & (empty | F.coalesce(soft, F.lit(False))), "neutral").otherwise(F.col("severity")))


def without_evidence() -> Column:
    """N07."""
    return F.trim(F.coalesce("evidence", F.lit(""))) == ""


def repetition_concern() -> Column:
    """N07."""
    return (F.col("dimension") == "prose.repetition") & (F.col("severity") == "concern")


def normal_rows(rows: DataFrame, kinds: list[str], default: str, texts: list[str]) -> DataFrame:
    """Rows of a detector with known kinds and severities only, and null for blank texts."""
    known = F.when(F.col("kind").isin(kinds), F.col("kind")).otherwise(default)
    severity = F.when(F.col("severity").isin("high", "moderate", "low"), F.col("severity")).otherwise("low")
    return rows.withColumns({"kind": known, "severity": severity} | {c: F.nullif(F.trim(c), F.lit("")) for c in texts})


def to_rewrite(findings: DataFrame, key: str, most: int = 5) -> DataFrame:
    """The first concerns with evidence, by rank."""
    rows = findings.filter((F.col("severity") == "concern") & ~without_evidence())
    return rows.withColumn("n", F.row_number().over(Window.partitionBy(key).orderBy("rank"))).filter(F.col("n") <= most)


def to_recover(chapters: DataFrame, key: str, focus: Column | int, most: int = 3, calls: int = 5) -> DataFrame:
    """The chapters in which to look again for a quote: the focus, then the nearest, the earlier of two; at most
    `most` chapters of a finding and `calls` in all of a key. chapters: key, finding_id, chapter."""
    order = [F.col("chapter") != focus, F.abs(F.col("chapter") - focus), F.col("chapter")]
    near = chapters.withColumn("try", F.row_number().over(Window.partitionBy(key, "finding_id").orderBy(*order))).filter(F.col("try") <= most)
    return near.withColumn("call", F.row_number().over(Window.partitionBy(key).orderBy("finding_id", "try"))).filter(F.col("call") <= calls)


def context_under(sheets: Column, excerpt: Column, ceiling: int) -> Column:
    """Sheets first, then excerpts as far as the ceiling leaves room."""
    room = F.lit(ceiling) - F.length(sheets) - 2
    return F.when(room > 0, F.concat(sheets, F.lit("\n\n"), F.left(excerpt, room))).otherwise(F.left(sheets, F.lit(ceiling)))


def finding_lines(findings: DataFrame, key: str) -> DataFrame:
    """Key, block: findings as the lines of a prompt, in order of rank."""
    line = F.concat(F.lit("- ["), "severity", F.lit("] "), "dimension", F.lit(": "), "summary", F.when(F.coalesce("chapter_ref", F.lit("")) != "", F.concat(F.lit(" (ch "), "chapter_ref", F.lit(")"))).otherwise(""))
    held = findings.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))).alias("l"))
    return held.select(key, F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("block"))


def ranked(findings: DataFrame, key: str) -> DataFrame:
    """Findings with defaults, in order of severity, certainty and dimension, ranked anew."""
    rank = F.when(F.col("severity") == "concern", 0).when(F.col("severity") == "neutral", 1).otherwise(2)
    rows = findings.withColumn("severity", F.coalesce("severity", F.lit("neutral"))).withColumn("certainty", F.coalesce("certainty", F.lit(0.0)))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(rank, F.desc("certainty"), "dimension", "finding_id")))


def without_dimensions(findings: DataFrame, dropped: DataFrame, key: str) -> DataFrame:
    """Findings but for dropped dimensions, ranked anew."""
    return ranked(findings.join(F.broadcast(dropped.select("dimension").distinct()), "dimension", "left_anti"), key)


def failed_text(count: Column) -> Column:
    """What is said of sheets that could not be parsed."""
    return F.when(count > 0, F.concat(count.cast("string"), F.lit(" fact sheet(s) could not be parsed")))
