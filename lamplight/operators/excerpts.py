"""Hit-weighted excerpts.

A hit is a chapter with a weight and, where it is known, a position (0 to 1). Budgets, windows and what is left of the
ceiling are worked out on numbers alone, for the few chapters that a ceiling has room for; texts are cut by join.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CEILING, PER_CHAPTER, LEAST, WINDOW = 100_000, 4000, 400, 900
WHOLE = 60_000


def row_weight(severity: Column, count: Column) -> Column:
    """Severity (high 3, moderate 2, else 1), once more for each power of ten of the count."""
    rank = F.when(F.lower(severity) == "high", 3).when(F.lower(severity) == "moderate", 2).otherwise(1)
    return (rank * (1 + F.floor(F.log10(F.greatest(count, F.lit(1)))))).cast("double")


def hits(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows (keys, chapters, locations array<struct<chapter_number, approximate_position>>, severity, count) -> keys,
    chapter_number, weight, position. A row's weight goes to each of its chapters: in equal parts to the places that
    the row names there, or, where it names none, to the chapter as a whole."""
    each = rows.withColumn("w", row_weight(F.col("severity"), F.col("count"))).select("*", F.explode("chapters").alias("chapter_number"))
    here = F.filter("locations", lambda x: x["chapter_number"] == F.col("chapter_number"))
    placed = F.when(F.size(F.coalesce(here, F.array())) > 0, F.transform(here, lambda x: x["approximate_position"].cast("double"))).otherwise(F.array(F.lit(None).cast("double")))
    found = each.withColumn("p", placed)
    return found.select(*keys, "chapter_number", (F.col("w") / F.size("p")).alias("weight"), F.explode("p").alias("position"))


def needle_position(needle: Column, text: Column) -> Column:
    """R08 for hits without a position: the middle of the first place where the needle stands as whole words, without
    regard to case, as a share of the text; null where there is none."""
    plain = F.regexp_replace(needle, r"([\\\[\](){}.*+?^$|])", r"\\$1")
    at = F.regexp_instr(text, F.concat(F.lit(r"(?iu)(?<!\w)"), plain, F.lit(r"(?!\w)")))
    return F.when((F.length(needle) > 0) & (at > 0), (at - 1 + F.floor(F.length(needle) / 2)) / F.length(text))


def window(position: Column, length: Column, chars: int = WINDOW) -> Column:
    """[s, e) of `chars` characters around a position, inside the text; null for a hit without a place."""
    centre = F.greatest(F.lit(0), F.least(length, (position * length).cast("long")))
    s, e = F.greatest(F.lit(0), centre - chars // 2), F.least(length, centre + (chars - chars // 2))
    return F.when(position.isNotNull() & (e > s), F.struct(s.alias("s"), e.alias("e")))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """R07 for one text."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(x for x in spans if x[1] > x[0]):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], e))
        else:
            out.append((s, e))
    return out


def size(spans: list[tuple[int, int]]) -> int:
    return sum(e - s for s, e in spans)


def cut_off(spans: list[tuple[int, int]], budget: int) -> list[tuple[int, int]]:
    """The first `budget` characters of spans."""
    out = []
    for s, e in spans:
        if budget <= 0:
            break
        out.append((s, min(e, s + budget)))
        budget -= e - s
    return out


def chosen(length: int, windows: list[tuple[float, int, int]], budget: int) -> list[tuple[int, int]]:
    """Windows (weight, s, e) of a text -> the spans to show. All of them if they fit; else the heaviest until the
    budget is used, the union cut where it is exceeded. What is left of the budget lengthens the first span towards
    the beginning of the text. A text without windows shows its beginning."""
    budget = min(budget, length)
    if budget <= 0:
        return []
    if not windows:
        return [(0, budget)]
    spans = merged([(s, e) for _, s, e in windows])
    if size(spans) > budget:
        spans = []
        for _, s, e in sorted(windows, key=lambda w: (-w[0], w[1], w[2])):
            grown = merged([*spans, (s, e)])
            if size(grown) > budget:
                spans = spans if size(spans) >= budget else cut_off(grown, budget)
                break
            spans = grown
    s, e = spans[0]
    return merged([(s - min(s, budget - size(spans)), e), *spans[1:]])


def budgets(weights: DataFrame, ceilings: DataFrame, book: str = "manuscript", least: int = LEAST) -> DataFrame:
    """R09 with the floor, W15: book, chapter_number, w, alloc, n (order). Chapters go by weight, then number; each takes
    `least` while there is any; what then remains is dealt out by weight, whole characters to the largest fractions."""
    order = Window.partitionBy(book).orderBy(F.desc("w"), "chapter_number")
    rows = weights.filter("w > 0").join(ceilings, book).withColumn("n", F.row_number().over(order)).filter(F.col("n") <= F.ceil(F.col("ceiling") / least))
    floor = F.least(F.lit(least), F.col("ceiling") - (F.col("n") - 1) * least)
    all_ = Window.partitionBy(book)
    rows = rows.withColumn("floor", floor).withColumn("rest", F.col("ceiling") - F.sum("floor").over(all_))
    rows = rows.withColumn("x", F.col("rest") * (F.col("w") / F.sum("w").over(all_))).withColumn("part", F.floor("x"))
    left = F.col("rest") - F.sum("part").over(all_)
    rows = rows.withColumn("left", left).withColumn("place", F.row_number().over(Window.partitionBy(book).orderBy(F.round(F.col("part") - F.col("x"), 9), "n")))
    extra = F.when(F.col("place") <= F.col("left"), 1).otherwise(0)
    return rows.select(book, "chapter_number", "w", "ceiling", "n", (F.col("floor") + F.col("part") + extra).cast("long").alias("alloc"))


def spans(rows: pd.DataFrame) -> pd.DataFrame:
    """R11 on numbers: the chapters of one book in order (n, ceiling, alloc, length, header, windows) -> what each shows.
    Headers and texts count against the ceiling; no chapter has more than half of it (or LEAST, if that is more)."""
    used, out = 0, []
    for r in rows.sort_values("n").itertuples():
        room = r.ceiling - used - r.header
        most = min(r.alloc, max(LEAST, r.ceiling // 2), r.length, room)
        found = chosen(int(r.length), [(w["w"], w["s"], w["e"]) for w in r.windows], int(most)) if used < r.ceiling else []
        if found:
            used += int(r.header) + size(found)
            out += [(r.manuscript, r.chapter_number, r.n, k, s, e) for k, (s, e) in enumerate(found)]
    return pd.DataFrame(out, columns=["manuscript", "chapter_number", "n", "k", "s", "e"])


def chapter_spans(chapters: DataFrame, hits_: DataFrame, ceiling: int = CEILING) -> DataFrame:
    """Manuscript, chapter_number, n, k, s, e: the spans to show, chapters by n. A book in which no hit has
    weight shows the beginnings of its chapters, in equal parts."""
    sizes = chapters.select("manuscript", "chapter_number", F.length("content").cast("long").alias("length"), F.length(header()).cast("long").alias("header"))
    books = sizes.groupBy("manuscript").agg(F.least(F.lit(ceiling).cast("long"), F.count(F.lit(1)) * PER_CHAPTER).alias("ceiling"), F.count(F.lit(1)).alias("chapters"))
    known = hits_.filter("weight > 0").join(sizes, ["manuscript", "chapter_number"])
    weights = known.groupBy("manuscript", "chapter_number").agg(F.sum("weight").alias("w"))
    dealt = budgets(weights, books.select("manuscript", "ceiling"))
    heads = books.join(weights.select("manuscript").distinct(), "manuscript", "left_anti")
    per = F.least(F.lit(PER_CHAPTER), F.floor(F.col("ceiling") / F.col("chapters"))).cast("long")
    first = Window.partitionBy("manuscript").orderBy("chapter_number")
    plain = sizes.join(heads, "manuscript").withColumn("alloc", per).withColumn("n", F.row_number().over(first)).filter((F.col("alloc") > 0) & (F.col("n") <= F.col("ceiling")))
    rows = dealt.select("manuscript", "chapter_number", "n", "ceiling", "alloc").join(sizes, ["manuscript", "chapter_number"]).unionByName(plain.select("manuscript", "chapter_number", "n", "ceiling", "alloc", "length", "header"))
    placed = known.withColumn("span", window(F.col("position"), F.col("length"))).filter("span IS NOT NULL")
    windows = placed.groupBy("manuscript", "chapter_number").agg(F.collect_set(F.struct(F.col("weight").alias("w"), "span.s", "span.e")).alias("windows"))
    rows = rows.join(windows, ["manuscript", "chapter_number"], "left").withColumn("windows", F.coalesce("windows", F.array()))
    return rows.groupBy("manuscript").applyInPandas(spans, "manuscript string, chapter_number int, n int, k int, s int, e int")


def header() -> Column:
    return F.concat(F.lit("--- Chapter "), F.col("chapter_number").cast("string"), F.lit(": "), F.coalesce(F.nullif(F.col("title"), F.lit("")), F.concat(F.lit("Chapter "), F.col("chapter_number").cast("string"))), F.lit(" ---\n"))


def excerpts(chapters: DataFrame, hits_: DataFrame, ceiling: int = CEILING) -> DataFrame:
    """Q14: manuscript, excerpt: the chapters' blocks (header and text), heaviest first, joined by blank lines, cut at the
    ceiling. A book's excerpt is bounded by the ceiling, whatever its length."""
    shown = chapter_spans(chapters, hits_, ceiling).join(chapters.select("manuscript", "chapter_number", header().alias("head"), "content"), ["manuscript", "chapter_number"])
    parts = shown.select("manuscript", "n", "k", "head", F.substring(F.col("content"), F.col("s") + 1, F.col("e") - F.col("s")).alias("part"))
    blocks = parts.groupBy("manuscript", "n").agg(F.concat(F.first("head"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "part"))), lambda x: x["part"]), "")).alias("block"))
    books = chapters.groupBy("manuscript").agg(F.least(F.lit(ceiling).cast("long"), F.count(F.lit(1)) * PER_CHAPTER).cast("int").alias("ceiling"))
    rows = blocks.groupBy("manuscript").agg(F.array_sort(F.collect_list(F.struct("n", "block"))).alias("blocks")).join(books, "manuscript")
    joined = """aggregate(blocks, '', (all, b) -> CASE WHEN all = '' THEN left(b.block, ceiling)
        WHEN length(all) + 2 < ceiling THEN concat(all, '\n\n', left(b.block, ceiling - length(all) - 2)) ELSE all END)"""
    return rows.select("manuscript", F.expr(joined).alias("excerpt"))


def head_tail(text: Column, most: int, tail: int | None = None) -> Column:
    """a text of at most `most` characters as it is; of a longer one the first six tenths and the last four, cut at
    a blank where one is near the cut, with a mark between."""
    tail = int(most * 0.4) if tail is None else tail
    first, last = F.left(text, F.lit(most - tail)), F.right(text, F.lit(tail))
    back = F.instr(F.reverse(first), " ")  # from the end, 1-based
    kept = F.when((back > 0) & (most - tail - back > (most - tail) * 0.8), F.left(first, F.lit(most - tail) - back)).otherwise(first)
    at = F.instr(last, " ") - 1
    end = F.when((at >= 0) & (at < tail * 0.2), F.substring(last, at + 2, F.lit(tail))).otherwise(last)
    return F.when(F.length(text) <= most, text).otherwise(F.concat(kept, F.lit("\n[…]\n"), end) if tail else kept)


def whole_chapters(chapters: DataFrame, most: int = WHOLE) -> DataFrame:
    """Manuscript, chapter_number, block: header and whole text, of very long chapters the head and the tail."""
    return chapters.select("manuscript", "chapter_number", F.concat(header(), head_tail(F.coalesce("content", F.lit("")), most)).alias("block"))


def chapter_chars(depth: Column) -> Column:
    """N04."""
    return F.when(depth == "deep", 16_000).otherwise(4000)
