"""Queries p8_ to p10_: operators on texts, over whole tables and whole texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import leakage, packing, textform


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet")


def p8_packed(spark: SparkSession, d: str) -> DataFrame:
    containers = spark.read.parquet(f"{d}/containers.parquet")
    return packing.pack(packing.token_counts(_docs(spark, d)), containers).drop("bucket")


def p8_buckets(spark: SparkSession, d: str) -> DataFrame:
    containers = spark.read.parquet(f"{d}/containers.parquet")
    return packing.pack(packing.token_counts(_docs(spark, d)), containers, packing.bucket_plan)


def p8_placed(spark: SparkSession, d: str) -> DataFrame:
    """What any right packing has in common, for each text and kind of container: it is there once, whole
    unless it exceeds the capacity, and none of its containers holds too much."""
    containers = spark.read.parquet(f"{d}/containers.parquet")
    counts = packing.token_counts(_docs(spark, d))
    packed = packing.pack(counts, containers)
    caps = containers.where("capacity_tokens > 0").groupBy("container_kind").agg(F.min("capacity_tokens").cast("bigint").alias("cap"))
    loads = packed.groupBy("container_kind", "container_id").agg(F.sum("n_tokens").alias("load"))
    parts = packed.join(loads, ["container_kind", "container_id"]).groupBy("container_kind", "doc_id").agg(
        F.count(F.lit(1)).alias("pieces"), F.count_distinct("piece").alias("different"), F.sum("n_tokens").alias("tokens"), F.max("load").alias("load"),
        F.max(F.when(F.col("piece") > 0, F.col("start_token"))).alias("last_start"),
    )
    need = F.greatest(F.ceil(F.col("n_tokens") / F.col("cap")), F.lit(1))
    right = (F.col("pieces") == need) & (F.col("different") == need) & (F.coalesce("last_start", F.lit(0)) == (need - 1) * F.col("cap"))
    joined = parts.join(counts, "doc_id").join(caps, "container_kind")
    return joined.select("container_kind", "doc_id", right.alias("whole"), (F.col("tokens") == F.col("n_tokens")).alias("complete"), (F.col("load") <= F.col("cap")).alias("fits"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    items = spark.read.parquet(f"{d}/eval_items.parquet")
    return leakage.leaked_passages(_docs(spark, d), items).select("item_id", "doc_id").distinct()


def p9_clean(spark: SparkSession, d: str) -> DataFrame:
    """The documents that hold no leaked passage."""
    docs, items = _docs(spark, d), spark.read.parquet(f"{d}/eval_items.parquet")
    return leakage.clean_documents(docs, leakage.leaked_passages(docs, items)).select("doc_id")


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return textform.lookalike_pairs(textform.lookalike_members(_docs(spark, d)))


def p10_forms(spark: SparkSession, d: str) -> DataFrame:
    """Every text in the one form, with the document that stands for all of its look."""
    docs = _docs(spark, d)
    members = textform.canonical_members(docs, textform.lookalike_members(docs))
    return textform.canonical_documents(docs).join(members, "doc_id")


def p10_classes(spark: SparkSession, d: str) -> DataFrame:
    """Each document that looks like another one, its class, its string, and how many the class has."""
    return textform.lookalike_classes(textform.lookalike_members(_docs(spark, d)))


QUERIES = {f.__name__: f for f in (p8_packed, p8_buckets, p8_placed, p9_found, p9_clean, p10_found, p10_classes, p10_forms)}

# The form in SQL is written from the definition, apart from the operator's tables: first what is in the
# text, then what it becomes, both in one order. Code points of the Unicode standard.
_WIDE = [*range(0xFF01, 0xFF5F)], [*range(0x21, 0x7F)]
_WIDE_SIGNS = [0xFF5F, 0xFF60, 0xFFE0, 0xFFE1, 0xFFE2, 0xFFE4, 0xFFE5, 0xFFE6], [0x2985, 0x2986, 0xA2, 0xA3, 0xAC, 0xA6, 0xA5, 0x20A9]
_SPACES = [0xA0, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000]
_FORMAT = [
    0xAD, *range(0x600, 0x606), 0x61C, 0x6DD, 0x70F, 0x890, 0x891, 0x8E2, 0x180E, *range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2060, 0x2065),
    *range(0x2066, 0x2070), 0xFEFF, *range(0xFFF9, 0xFFFC), 0x110BD, 0x110CD, *range(0x13430, 0x13440), *range(0x1BCA0, 0x1BCA4), *range(0x1D173, 0x1D17B),
    0xE0001, *range(0xE0020, 0xE0080),
]
_CYRILLIC = "АВЕЅІЈКМНОРСТУХҮӀԌԚԜѴаеѕіјоросухһҺӏԁԛԝүѵӔӕӘә", "ABESIJKMHOPCTYXYIGQWVaesijopocyxhhldqwyvÆæƏə"
_GREEK = "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹϳͿοϲνιΓΠΦΨψ", "ABEZHIKMNOPTYXCjJocviГПФѰѱ"
_ACCENTED = "ЀѐЁёЇїӐӑӒӓӖӗӦӧӰӱӮӯЌΆΈΊΌΎΪΫόίϊ", "ÈèËëÏïĂăÄäĔĕÖöŸÿȲȳḰÁÉÍÓÝÏŸóíï"
_TWO = {"Ў": (0x59, 0x306), "ў": (0x79, 0x306), "Ӳ": (0x59, 0x30B), "ӳ": (0x79, 0x30B), "Ή": (0x48, 0x301), "ѝ": (0x438, 0x300), "Ѓ": (0x413, 0x301)}


def _form_sql(column: str) -> str:
    """The one form of a text in SQL: single characters are translated, then accents composed."""
    text = lambda codes: "".join(map(chr, codes))
    old = text(_WIDE[0] + _WIDE_SIGNS[0] + _SPACES) + _CYRILLIC[0] + _GREEK[0] + _ACCENTED[0] + text(_FORMAT)
    new = text(_WIDE[1] + _WIDE_SIGNS[1]) + " " * len(_SPACES) + _CYRILLIC[1] + _GREEK[1] + _ACCENTED[1]
    for whole, codes in _TWO.items():
        column = f"replace({column}, '{whole}', '{text(codes)}')"
    quoted = lambda t: t.replace("'", "''")
    return f"nfc_normalize(translate({column}, '{quoted(old)}', '{quoted(new)}'))"


def oracle_sql() -> dict[str, str]:
    """The same results in plain SQL, where SQL can say them."""
    grams = "list_transform(range(1, len(w) - 6), lambda i: array_to_string(list_slice(w, i, i + 7), ' '))"
    split = lambda text: f"regexp_extract_all(lower({_form_sql(text)}), '[\\p{{L}}\\p{{N}}]+')"
    p9 = f"""WITH parts AS (SELECT item_id, question AS t FROM eval_items UNION ALL SELECT item_id, answer FROM eval_items),
items AS (SELECT DISTINCT CAST(item_id AS BIGINT) AS item_id, unnest({grams}) AS g FROM (SELECT item_id, {split('t')} AS w FROM parts)),
docs AS (SELECT DISTINCT doc_id, unnest({grams}) AS g FROM (SELECT doc_id, {split('text')} AS w FROM documents))
SELECT DISTINCT item_id, doc_id FROM items JOIN docs USING (g)"""
    forms = f"forms AS (SELECT doc_id, text, {_form_sql('text')} AS f FROM documents WHERE text IS NOT NULL)"
    p10 = f"""WITH {forms}
SELECT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM forms a JOIN forms b ON a.f = b.f AND a.doc_id < b.doc_id AND a.text <> b.text"""
    classes = f"""{forms},
classes AS (SELECT f, min(doc_id) AS class_id, count(*) AS size FROM forms GROUP BY f HAVING count(DISTINCT text) > 1)"""
    return {
        "p8_placed": """SELECT DISTINCT container_kind, doc_id, true AS whole, true AS complete, true AS fits
            FROM documents, containers WHERE text IS NOT NULL AND capacity_tokens > 0""",
        "p9_found": p9,
        "p9_clean": f"SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM ({p9}))",
        "p10_found": p10,
        "p10_classes": f"WITH {classes} SELECT class_id, doc_id, min(doc_id) OVER (PARTITION BY text) AS variant, size FROM forms JOIN classes USING (f)",
        "p10_forms": f"""WITH {classes}
            SELECT d.doc_id, f AS form, coalesce(class_id, d.doc_id) AS canonical_id FROM documents d LEFT JOIN forms USING (doc_id) LEFT JOIN classes USING (f)""",
    }
