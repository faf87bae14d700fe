"""Story metadata from JSON folders: characters, voice cards, lexicons."""

from __future__ import annotations

import re
import textwrap

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _files(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.text(path, wholetext=True, pathGlobFilter="*.json")
    return files.select(F.regexp_replace(F.col("_metadata.file_name"), r"\.json$", "").alias("stem"), F.col("value").alias("body"))


def read_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The objects of JSON files, whether a file holds one or an array. What is not an object, or does not parse,
    is skipped; unknown keys are ignored."""
    row = T.StructType.fromDDL(schema) if hasattr(T.StructType, "fromDDL") else T._parse_datatype_string(schema)
    files = _files(spark, path)
    is_list = F.ltrim("body").startswith("[")
    many = F.when(is_list, F.from_json("body", T.ArrayType(row))).otherwise(F.array(F.from_json("body", row)))
    rows = files.filter(F.try_parse_json("body").isNotNull()).select("stem", F.explode(many).alias("r")).filter("r IS NOT NULL")
    return rows.select("stem", "r.*")


def read_characters(spark: SparkSession, path: str) -> DataFrame:
    """Files with a name; the slug defaults to the file's stem."""
    rows = read_rows(spark, path, "slug string, name string, role string, status string, introduced_chapter int, died_chapter int, last_seen_chapter int")
    return rows.filter(F.trim("name") != "").withColumn("slug", F.coalesce(F.nullif(F.trim("slug"), F.lit("")), "stem"))


def _yaml_value(text: str) -> str | list[str]:
    text = text.strip()
    if text.startswith("[") and text.endswith("]"):
        return [str(_yaml_value(x)) for x in text[1:-1].split(",") if x.strip()]
    return text[1:-1] if len(text) > 1 and text[0] == text[-1] and text[0] in "'\"" else text


def flat_yaml(body: str) -> dict[str, str | list[str]]:
    """A YAML file of one level: keys with a text, a folded block or a list. Anything deeper is passed over."""
    out: dict[str, str | list[str]] = {}
    key = None
    for line in body.splitlines():
        if m := re.match(r"([A-Za-z_][\w-]*):\s*(.*)$", line):
            key, value = m[1], m[2]
            out[key] = "" if value.strip() in ("", "|", ">", "|-", ">-") else _yaml_value(value.split(" #")[0])
        elif key and (m := re.match(r"\s*-\s+(.*)$", line)):
            out[key] = [*(out[key] if isinstance(out[key], list) else []), str(_yaml_value(m[1]))]
        elif key and line.startswith((" ", "\t")) and isinstance(out[key], str):
            out[key] = f"{out[key]} {line.strip()}".strip()
    return out


def read_voice_cards(spark: SparkSession, path: str) -> DataFrame:
    """Cards with a voice, from .json, then .yaml, then .yml files; of equal slugs the first by kind and name."""
    return _cards(spark, path).filter("reason IS NULL").drop("reason")


def voice_card_warnings(spark: SparkSession, path: str) -> DataFrame:
    """Stem, reason: the files that gave no card, and why."""
    return _cards(spark, path).filter("reason IS NOT NULL").select("stem", "reason")


CARD = "slug string, name string, dialogue_voice string, voice_wildcards array<string>, weight string"


def _cards(spark: SparkSession, path: str) -> DataFrame:
    from_json = read_rows(spark, path, CARD).withColumn("kind", F.lit(0))
    files = spark.read.text(path, wholetext=True, pathGlobFilter="*.y*ml").select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("body"))

    def parse(column: pd.Series) -> pd.DataFrame:
        one = lambda x: " ".join(x) if isinstance(x, list) else x
        read = [flat_yaml(b) for b in column]
        return pd.DataFrame([{**{k: one(r.get(k)) for k in ("slug", "name", "dialogue_voice", "weight")}, "voice_wildcards": r["voice_wildcards"] if isinstance(r.get("voice_wildcards"), list) else None} for r in read], columns=["slug", "name", "dialogue_voice", "voice_wildcards", "weight"])

    parsed = files.select(F.regexp_replace("file", r"\.ya?ml$", "").alias("stem"), F.when(F.col("file").endswith(".yaml"), 1).otherwise(2).alias("kind"), F.pandas_udf(parse, CARD)("body").alias("r"))
    rows = from_json.unionByName(parsed.select("stem", "r.*", "kind")).withColumn("slug", F.coalesce(F.nullif(F.trim("slug"), F.lit("")), "stem"))
    mute = F.trim(F.coalesce("dialogue_voice", F.lit(""))) == ""
    first = F.row_number().over(Window.partitionBy("slug", mute).orderBy("kind", "stem"))
    return rows.withColumn("reason", F.when(mute, "no dialogue_voice").when(first > 1, "slug already taken")).drop("kind")


def read_meta(spark: SparkSession, path: str) -> dict[str, str | list[str]]:
    """The keys of the seed.yaml in a story's folder or in the nearest folder above it; none without one."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    while at is not None:
        seed = jvm.org.apache.hadoop.fs.Path(at, "seed.yaml")
        if fs.exists(seed):
            body = spark.read.text(str(seed), wholetext=True).first()[0]
            inner = re.search(r"(?m)^meta:\s*\n((?:[ \t]+.*\n?|\s*\n)*)", body)
            return flat_yaml(textwrap.dedent(inner[1])) if inner else {}
        at = at.getParent()
    return {}


def find_canon(spark: SparkSession, *candidates: str | None, chapter: int | None = None) -> str | None:
    """The first canon folder, in a candidate or beside it, that holds anything; of it, for a chapter, the snapshot
    taken at that chapter, where there is one with JSON files."""
    jvm = spark.sparkContext._jvm
    path = lambda *parts: jvm.org.apache.hadoop.fs.Path("/".join(parts))
    fs_of = lambda p: p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for c in filter(None, candidates):
        for root in (c.rstrip("/"), c.rstrip("/").rpartition("/")[0]):
            canon = path(root, "canon")
            if fs_of(canon).exists(canon) and fs_of(canon).listStatus(canon):
                shot = path(root, "checkpoints", f"chapter-{chapter or 0:03d}", "canon")
                if chapter is not None and any(fs_of(shot).globStatus(path(str(shot), depth)) for depth in ("*.json", "*/*.json")):
                    return str(shot)
                return str(canon)
    return None


def has_table(spark: SparkSession, name: str) -> bool:
    """Whether a table of vectors is there: by its name in the catalog, or by its folder."""
    if "/" not in name:
        return spark.catalog.tableExists(name)
    jvm = spark.sparkContext._jvm
    mark = jvm.org.apache.hadoop.fs.Path(f"{name}/_SUCCESS")
    return mark.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(mark)


def read_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """Lemma, zipf of a JSON object; values that are no numbers are skipped."""
    pairs = _files(spark, path).select(F.explode(F.from_json("body", "map<string,string>")).alias("lemma", "v"))
    return pairs.select(F.lower("lemma").alias("lemma"), F.expr("try_cast(v AS DOUBLE)").alias("zipf")).filter("zipf IS NOT NULL")
