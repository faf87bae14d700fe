"""Column -> Column helpers, all built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"[A-Za-z][A-Za-z\-']*"
SPOKEN_WORD = r"[A-Za-z0-9]+(?:['’][A-Za-z]+)*"


def _but_last(c: Column, n: int) -> Column:
    return F.substring(c, F.lit(1), F.length(c) - n)


def lemma(token: Column) -> Column:
    """lower case; without a possessive, or else a plain plural s."""
    low = F.lower(token)
    plural = (F.length(low) > 3) & low.endswith("s") & ~low.endswith("ss")
    return F.when(low.endswith("'s"), _but_last(low, 2)).when(plural, _but_last(low, 1)).otherwise(low)


def norm_token(token: Column) -> Column:
    """as lemma, without hyphens, and with -ies and -es plurals undone."""
    low = F.replace(F.lower(token), F.lit("-"), F.lit(""))
    long = F.length(low) > 4
    es = low.endswith("xes") | low.endswith("zes") | low.endswith("ches") | low.endswith("shes") | low.endswith("sses")
    return (
        F.when(low.endswith("'s"), _but_last(low, 2))
        .when(long & low.endswith("ies"), F.concat(_but_last(low, 3), F.lit("y")))
        .when(long & es, _but_last(low, 2))
        .when((F.length(low) > 3) & low.endswith("s") & ~low.endswith("ss"), _but_last(low, 1))
        .otherwise(low)
    )


def normalized_key(text: Column) -> Column:
    """trimmed, lower case, single blanks."""
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


def around_first(text: Column, term: Column, before: int = 40, width: int = 160) -> Column:
    """the text around the first place of the term, without case; null if it is nowhere."""
    at = F.position(F.lower(term), F.lower(text))
    cut = F.trim(F.substring(text, F.greatest(at - before, F.lit(1)), F.lit(width)))
    return F.when(at > 0, F.nullif(cut, F.lit("")))


def substring_count(text: Column, term: Column) -> Column:
    """non-overlapping occurrences."""
    return F.when(F.length(term) > 0, (F.length(text) - F.length(F.replace(text, term, F.lit("")))) / F.length(term)).otherwise(0).cast("long")


def normalized_quote(text: Column) -> Column:
    """F14, the text only: quotes and dashes folded, marks of emphasis dropped, blanks single, lower case."""
    folded = F.translate(text, "‘’‚‛′“”„″—–‒‑‐\xa0", "'" * 5 + '"' * 4 + "-" * 5 + " ")
    folded = F.replace(F.translate(folded, "*_`", ""), F.lit("…"), F.lit("..."))
    return F.lower(F.trim(F.regexp_replace(folded, r"\s+", " ")))


def bare_name(name: Column) -> Column:
    """straight quotes, single blanks, lower case, without a final possessive."""
    flat = F.lower(F.trim(F.regexp_replace(F.translate(name, "‘’“”", "''\"\""), r"\s+", " ")))
    return F.when(flat.endswith("'s"), _but_last(flat, 2)).otherwise(flat)


def card_text(text: Column) -> Column:
    """lower case, no punctuation, single blanks."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z0-9\s]", " "), r"\s+", " "))


def clip(text: Column, limit: int = 60) -> Column:
    """F22."""
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.rtrim(F.left(text, F.lit(limit - 1))), F.lit("…")))


def slug(text: Column) -> Column:
    """F24."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z0-9_\-]+", "-"), r"^-+|-+$", "")


def cited_chapters(*texts: Column) -> Column:
    """sorted distinct chapter numbers cited as Ch N."""
    found = [F.regexp_extract_all(t, F.lit(r"(?i)\bch(?:apter)?\.? *(\d+)"), F.lit(1)) for t in texts]
    return F.array_sort(F.array_distinct(F.transform(F.flatten(F.array(*found)), lambda x: x.cast("int"))))


def severity(count: Column, high: int = 4, moderate: int = 2) -> Column:
    """M01, M02, M04."""
    return F.when(count >= high, "high").when(count >= moderate, "moderate").otherwise("low")


def severity_rank(name: Column) -> Column:
    """M09."""
    return F.when(name == "high", 0).when(name == "moderate", 1).when(name == "low", 2).otherwise(3)


def over_threshold(count: Column, words: Column, load_bearing: Column) -> Column:
    """M03."""
    per_1000 = count * 1000.0 / words
    least = F.when(load_bearing, 10).otherwise(6)
    rate = F.when(load_bearing, 1.8).otherwise(1.2)
    return (count >= least) | ((words >= 1000) & (count >= 4) & (per_1000 >= rate))


def row_weight(name: Column, count: Column) -> Column:
    """M06."""
    sev = F.when(name == "high", 3).when(name == "moderate", 2).otherwise(1)
    return (sev * (1 + F.floor(F.log10(F.greatest(count, F.lit(1)))))).cast("int")


def band(p: Column) -> Column:
    """M07."""
    return F.when(p >= 0.65, "positive").when(p >= 0.35, "mid").otherwise("negative")


def cache_key(*parts: Column) -> Column:
    """M11."""
    return F.sha2(F.concat(*[F.concat(p.cast("string"), F.lit("\0")) for p in parts]), 256)


def finding_id(dimension: Column, span: Column) -> Column:
    """M12."""
    return F.substring(F.sha1(F.concat(dimension, F.lit("\0"), span)), 1, 12)


def stub_embedding(text: Column, dims: int = 384) -> Column:
    """Components from the bytes of the text's SHA-256."""
    digest = F.sha2(text, 256)
    return F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.conv(F.substring(digest, (i % 32) * 2 + 1, F.lit(2)), 16, 10).cast("int") / F.lit(255.0) * 2 - 1)


def l2(a: Column, b: Column) -> Column:
    """Squared distance in doubles."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, v: s + v)


def hesitations(spoken: Column) -> dict[str, Column]:
    """whether each marker of hesitation is in the spoken text."""
    filler = r"(?i)\b(?:um+|uh+|er+|erm|hmm+|(?<!as )well|I mean|you know|sort of|kind of|or something|or whatever|I dunno|look,|listen,|oh)\b"
    hedge = r"(?i)\b(?:maybe|perhaps|I guess|I think|I suppose|probably|I'm not sure|I don't know|not sure|might|seems?|I believe)\b"
    return {
        "broken_off": spoken.rlike("—|--|–"),
        "trailing_off": spoken.rlike(r"\.\.\.|…|\. \. \."),
        "filler": spoken.rlike(filler),
        "hedge": spoken.rlike(hedge),
        "restart": spoken.rlike(r"(?i)\b(\w{1,6})[-—]\s?\1\b"),
    }


def without_front_matter(text: Column) -> Column:
    """A text without the YAML block that it begins with."""
    return F.regexp_replace(text, r"(?s)\A\uFEFF?\s*---\r?\n.*?\r?\n---\r?\n?", "")
