"""The story's records as of a chapter, as entries with ids and as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamplight.functions import scalars as S
from lamplight.operators.state import before

# Sections of the block in order, caps by prefix, and the order of the cast by weight.
SECTIONS = [
    ("C", "Cast"), ("P", "Physical state and item locations (latest per attribute)"), ("E", "Where the last chapters ended"), ("T", "Timeline"),
    ("L", "Recent settings"), ("S", "Secrets (who knows what)"), ("O", "Open seeds (set up, not yet paid off)"), ("K", "Fixed story facts"), ("R", "World rules"),
]
CAPS = {"C": 40, "P": 60, "E": 3, "T": 3, "L": 3, "S": 20, "O": 25, "K": 40, "R": 15}
WEIGHTS = {"protagonist": 0, "primary": 0, "major": 1, "secondary": 2, "background": 3}
TEXT = 240


def entries(rows: DataFrame, prefix: str, text: Column, chapter: Column, order: list[Column], cap: int | None = None, show: list[Column] | None = None) -> DataFrame:
    """Manuscript, prefix, n, chapter, text: the first rows in order, up to the cap, numbered as they are shown."""
    first = rows.withColumn("_t", S.clip(F.trim(F.regexp_replace(text, r"\s+", " ")), TEXT)).withColumn("_c", chapter.cast("int")).withColumn("_n", F.row_number().over(Window.partitionBy("manuscript").orderBy(*order)))
    kept = first.filter(F.col("_n") <= (CAPS[prefix] if cap is None else cap)).filter("_t <> ''")
    number = F.row_number().over(Window.partitionBy("manuscript").orderBy(*(show or [F.col("_n")])))
    return kept.select("manuscript", F.lit(prefix).alias("prefix"), number.alias("n"), F.col("_c").alias("chapter"), F.col("_t").alias("text"))


def cast(characters: DataFrame, n: int) -> DataFrame:
    """Manuscript, name, status as of chapter n, by weight and name. A death in chapter n or later is not known yet;
    one without a chapter may be in this one."""
    weight = F.create_map(*[F.lit(x) for pair in WEIGHTS.items() for x in pair])
    died = F.when(F.col("died") > 0, F.col("died"))
    status = F.when(F.col("status") != "deceased", F.coalesce(F.nullif("status", F.lit("")), F.lit("unknown"))).when(died >= n, "active").when(died.isNotNull(), F.concat(F.lit("deceased since Ch "), died.cast("string"))).otherwise("deceased (death chapter not recorded; may be this chapter)")
    rows = characters.filter(before(F.col("introduced"), n) | (F.col("introduced") <= 0))
    return rows.select("manuscript", "name", status.alias("status"), F.when(died < n, died).otherwise(F.col("introduced")).alias("chapter"), F.coalesce(F.try_element_at(weight, F.col("weight")), F.lit(2)).alias("rank"))


def secrets(rows: DataFrame, n: int) -> DataFrame:
    """Manuscript, name, state, chapter, tail. rows: manuscript, name, state, planted, since, revealed,
    history array<struct<state,chapter>>, knowers array<string>, known_since map<string,int>.

    The last dated state before n counts. Without one, a state that changed in chapter n or later is not known yet: the
    secret is revealed if it was before n, or else hidden. Knowers with a chapter know from it on; those without one count
    only while the state has not changed since."""
    past = F.filter("history", lambda h: h["chapter"] < n)
    last = F.array_max(F.transform(past, lambda h, i: F.struct(h["chapter"].alias("chapter"), i.alias("i"), h["state"].alias("state"))))
    later = F.coalesce(F.col("since") >= n, F.lit(False))
    seen = F.coalesce(F.col("revealed") < n, F.lit(False))
    state = F.when(last.isNotNull(), last["state"]).when(later & seen, F.concat(F.lit("revealed since Ch "), F.col("revealed").cast("string"))).when(later, "hidden").otherwise(F.coalesce("state", F.lit("?")))
    chapter = F.when(last.isNotNull(), last["chapter"]).when(later & seen, F.col("revealed")).when(later, F.col("planted")).otherwise(F.coalesce("since", "planted"))
    dated = lambda k: F.try_element_at("known_since", k)
    held = F.coalesce("knowers", F.array().cast("array<string>"))
    known = F.filter(held, lambda k: F.coalesce(dated(k) < n, ~F.col("_later")))
    dropped = F.exists(held, lambda k: dated(k).isNull()) & F.col("_later")
    out = rows.filter(before(F.col("planted"), n)).withColumn("_later", later).withColumn("_known", known)
    tail = F.when(F.size("_known") > 0, F.concat(F.lit("known by "), F.array_join("_known", ", "))).when(dropped | F.col("_later"), F.lit(f"knowers before Ch {n} not recorded")).otherwise("known by no one recorded")
    return out.select("manuscript", "name", state.alias("state"), chapter.alias("chapter"), tail.alias("tail"), "planted")


def latest_physical(rows: DataFrame, n: int) -> DataFrame:
    """The last value of each attribute of an entity before n."""
    known = rows.filter(before(F.col("chapter"), n))
    return known.groupBy("manuscript", "entity", "attribute").agg(F.max_by(F.struct("value", "chapter"), F.struct(F.coalesce("chapter", F.lit(0)), "file_pos")).alias("x")).select("manuscript", "entity", "attribute", "x.value", "x.chapter")


def block(parts: list[DataFrame]) -> DataFrame:
    """Q09: manuscript, block: the sections in order, each entry with its id and chapter."""
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    order = F.create_map(*[F.lit(x) for i, (p, _) in enumerate(SECTIONS) for x in (p, i)])
    title = F.create_map(*[F.lit(x) for p, t in SECTIONS for x in (p, t)])
    line = F.concat(F.lit("["), "prefix", F.col("n").cast("string"), F.lit("]"), F.when(F.col("chapter") > 0, F.concat(F.lit(" (Ch "), F.col("chapter").cast("string"), F.lit(")"))).otherwise(""), F.lit(" "), "text")
    made = rows.groupBy("manuscript", "prefix").agg(F.array_sort(F.collect_list(F.struct("n", line.alias("line")))).alias("l"))
    section = F.concat(F.lit("### "), title[F.col("prefix")], F.lit("\n"), F.array_join(F.transform("l", lambda x: x["line"]), "\n"))
    held = made.select("manuscript", order[F.col("prefix")].alias("i"), section.alias("section"))
    return held.groupBy("manuscript").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "section"))), lambda x: x["section"]), "\n\n").alias("block"))


def state_block(characters: DataFrame, physical: DataFrame, hidden: DataFrame, seeds: DataFrame, facts: DataFrame, n: int) -> DataFrame:
    """Q09 of the story's tables, as of the start of chapter n."""
    people = cast(characters, n)
    things = latest_physical(physical, n)
    told = secrets(hidden, n)
    open_ = seeds.filter(before(F.col("planted"), n) & F.coalesce(F.col("resolved") >= n, F.lit(True)))
    return block([
        entries(people, "C", F.concat("name", F.lit("; status "), "status"), F.col("chapter"), [F.col("rank"), F.col("name")]),
        entries(things, "P", F.concat(F.col("entity").cast("string"), F.lit(" — "), F.col("attribute").cast("string"), F.lit(": "), "value"), F.col("chapter"), [F.coalesce("chapter", F.lit(0)).desc(), F.col("entity"), F.col("attribute")], show=[F.col("entity").cast("string"), F.col("attribute").cast("string")]),
        entries(told, "S", F.concat("name", F.lit(": state "), "state", F.lit("; "), "tail"), F.col("chapter"), [F.col("name")]),
        entries(open_, "O", F.concat("slug", F.lit(" (open; "), F.coalesce("priority", F.lit("normal")), F.lit(")")), F.col("planted"), [F.col("slug")]),
        entries(facts, "K", F.col("fact"), F.lit(None), [F.col("fact")]),
    ])
