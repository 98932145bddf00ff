"""Visually identical text with different characters.

``form`` brings one string to the canonical form; ``lookalike_members`` finds the texts of a corpus
that look the same: look-alike-mapped values are grouped under Spark's accent-sensitive Unicode
collation, each class gets a canonical member, which is joined back.
"""

from __future__ import annotations

import hashlib
import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..core.session import cut

# Letters of the Latin, Cyrillic and Greek alphabets that are printed alike, a class to a
# word, the letter that stands for it first. Unicode's list of confusable characters has each class as
# one (but Q, capital shha, the small palochka and the small letters with descender, which belong here too); of that list only letters of one case and of the same printed form are taken here, so alpha and a,
# rho and p, the capital I and the small l, or a letter and a digit, stay different.
LETTERS = """
AΑА BΒВ CСϹ EΕЕ FϜ GԌ HΗН IΙІӀ JЈͿ KΚК MΜМϺ NΝ OΟО PΡР QԚ SЅ TΤТ VѴ WԜ XΧХ YΥУҮ ZΖ ÆӔ ƏӘ
aа cсϲ dԁ eе hһҺ iіι jјϳ lӏ oоο pр qԛ sѕ vνѵ wԝ xх yуү æӕ əәǝ
ГΓ ПΠ ФΦ ѰΨ ѱψ ИͶ ΛɅ ΣƩ ƆϽ ɔͻ ƐԐ ɛԑ ƷӠ ʒӡ ꙄƧ ꙅƨ ƟѲӨ ɵѳө ÞϷ þϸ ⱵͰ ꙌꞶ ωꙍꞷ χꭓ γɣ αɑ δẟ βꞵ
ҚⱩ қⱪ ҢⱧ ңⱨ ҰɎ ұɏ ꚘꝎ ꚙꝏ гᴦ вʙ нʜ мᴍ тᴛ кᴋ яᴙ
""".split()


@lru_cache
def _table() -> dict[int, str]:
    """Code point to replacement, for text whose accents are decomposed; made by rule."""
    table: dict[int, str] = {}
    for cp in range(sys.maxunicode + 1):
        c = chr(cp)
        category = unicodedata.category(c)
        if category == "Cf":
            table[cp] = ""
        elif category == "Zs":
            table[cp] = " "
        elif unicodedata.decomposition(c).startswith("<wide>"):
            table[cp] = chr(int(unicodedata.decomposition(c).split()[1], 16))
    for same in LETTERS:
        table |= {ord(c): same[0] for c in same[1:]}
    return table


def mapped(text: str) -> str:
    """``text`` with accents decomposed, look-alikes, widths and spaces mapped, invisibles gone."""
    if text.isascii():
        return text
    return unicodedata.normalize("NFD", text).translate(_table())


def form(text: str | None) -> str | None:
    """The one consistent form of a text; case, accents and raised digits stay different."""
    if text is None or text.isascii():
        return text
    return unicodedata.normalize("NFC", mapped(text))


_OTHER = re.compile(r"[^!-~]+")


def _digest(text: str) -> bytes:
    return hashlib.md5(text.encode("utf-8", "surrogatepass")).digest()


def keyed_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, string_id, key): digests of each text, and of the printable ASCII characters that it has
    once it is mapped; null texts give no row.

    Texts of one form share the key, because mapping ends in decomposed characters. Texts are read
    once and stay where they are.
    """
    base = docs.where(F.col("text").isNotNull()).select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            ids, keys = [_digest(t) for t in texts], [_digest(_OTHER.sub("", mapped(t)))[:8] for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary()), pa.array(keys, pa.binary())], names=["doc_id", "string_id", "key"])

    return base.mapInArrow(run, "doc_id bigint, string_id binary, key binary")


def canonical_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, form): every text in the one form; a null text stays null."""
    base = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = pa.array([form(t) for t in batch.column(1).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), values], names=["doc_id", "form"])

    return base.mapInArrow(run, "doc_id bigint, form string")


def lookalike_members(docs: DataFrame) -> DataFrame:
    """(class_id, doc_id, variant): the documents of classes with at least two different strings.

    ``class_id`` is the least doc_id of the class, ``variant`` the least doc_id with the very same string.
    Copies are folded to one string, and strings narrowed by a short key that all members of a class share, so
    only the texts of possible members move. Their mapped values are grouped under the collation
    UNICODE, whose equality is that of the Unicode root at accent and case level. Since that
    collation also ignores control characters, classes are split by an exact comparison of the composed form.
    """
    ids = cut(keyed_texts(docs))
    strings = ids.groupBy("key", "string_id").agg(F.min("doc_id").alias("variant"))
    shared = strings.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    near = strings.join(shared, "key", "left_semi").select("variant", "string_id")
    texts = docs.where(F.col("text").isNotNull()).select(F.col("doc_id").cast("bigint").alias("variant"), "text").join(near, "variant")
    values = cut(texts.mapInArrow(_map_candidates, "variant bigint, string_id binary, mapped string"))
    under = F.collate("mapped", "UNICODE")
    classes = values.groupBy(under.alias("look")).agg(F.count(F.lit(1)).alias("n"), F.min("variant").alias("class_id")).where("n > 1").select("look", "class_id")
    placed = values.join(classes, under == F.col("look")).select("class_id", "variant", "string_id", "mapped")
    exact = placed.mapInArrow(_exact, "class_id bigint, variant bigint, string_id binary, form binary")
    # Split by the composed form, and drop classes of which one string is left.
    sure = exact.groupBy("class_id", "form").agg(F.count(F.lit(1)).alias("n"), F.min("variant").alias("sub_id")).where("n > 1")
    sure = exact.join(sure, ["class_id", "form"]).select(F.col("sub_id").alias("class_id"), "variant", "string_id")
    return ids.drop("key").join(sure, "string_id").select("class_id", "doc_id", "variant")


def _map_candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns variant, text, string_id; rows of repeated doc_ids with another text are not meant."""
    for batch in batches:
        rows = [(v, s, mapped(t)) for v, t, s in zip(*(batch.column(c).to_pylist() for c in ("variant", "text", "string_id"))) if _digest(t) == s]
        columns = zip(*rows) if rows else ([], [], [])
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.binary(), pa.string()))], names=["variant", "string_id", "mapped"])


def _exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values = [_digest(unicodedata.normalize("NFC", t)) for t in batch.column(3).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(values, pa.binary())], names=["class_id", "variant", "string_id", "form"])


def lookalike_classes(members: DataFrame) -> DataFrame:
    """(class_id, doc_id, variant, size): one row per document of a class, with the class's documents counted."""
    sizes = members.groupBy("class_id").agg(F.count(F.lit(1)).alias("size"))
    return members.join(sizes, "class_id").select("class_id", "doc_id", "variant", "size")


def lookalike_pairs(members: DataFrame) -> DataFrame:
    """(doc_id_a, doc_id_b), a < b: documents of one class whose strings differ. As many rows as
    there are such pairs; copies of one string are not paired with each other."""
    a = members.select("class_id", F.col("doc_id").alias("doc_id_a"), F.col("variant").alias("va"))
    b = members.select("class_id", F.col("doc_id").alias("doc_id_b"), F.col("variant").alias("vb"))
    return a.join(b, "class_id").where("va <> vb and doc_id_a < doc_id_b").select("doc_id_a", "doc_id_b")


def canonical_members(docs: DataFrame, members: DataFrame) -> DataFrame:
    """(doc_id, canonical_id): each document's class representative, itself if it is alone."""
    ids = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"))
    return ids.join(members.select("doc_id", "class_id"), "doc_id", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("canonical_id"))
