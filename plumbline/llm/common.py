"""What the operators of this folder share: words, document keys, written intermediate tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.session import prepare, scratch_path

#: What separates words, as a class of Java's regular expressions; `bytes.split()` splits at the same characters.
SPACE = r"\x20\x09-\x0D"


def words(text: bytes) -> list[bytes]:
    """Words of a UTF-8 text with A-Z in lower case; other letters stay as they are."""
    return text.lower().split()


def utf8(text: Column) -> Column:
    """A text as bytes for Python workers; a null text is an empty one."""
    return F.coalesce(text, F.lit("")).cast("binary")


def packed(docs: DataFrame, **columns: Column) -> DataFrame:
    """All columns of the input in one struct `row`, beside columns of our own: no name can clash."""
    return docs.select(F.struct("*").alias("row"), *[c.alias(name) for name, c in columns.items()])


def unpacked(df: DataFrame, **columns: Column) -> DataFrame:
    """The input's columns again; the given ones replace those of the same name or follow at the end."""
    inside = df.schema["row"].dataType.names
    own = {name.lower(): (name, c) for name, c in columns.items()}
    kept = [own.pop(n.lower())[1].alias(n) if n.lower() in own else F.col(f"row.`{n}`").alias(n) for n in inside]
    return df.select(*kept, *[c.alias(name) for name, c in own.values()])


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id's digits, modulo; a null id counts as the empty text, whose crc32 is 0."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def kept(df: DataFrame, name: str) -> DataFrame:
    """Written to the shared folder and read back: a lost executor costs no recomputation."""
    spark = prepare(df.sparkSession)
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
