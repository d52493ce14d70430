"""What the operators of this package share."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = re.compile(r"[^\W_]+")
_SIGN = re.compile(r"[^\w\x00-\x7f]")


def blanked(*kept: str) -> bytes:
    """A table for ``bytes.translate``: ASCII characters but letters, digits and ``kept`` become blanks, bytes of other characters stay."""
    return bytes(i if i > 127 or chr(i).isalnum() or chr(i) in kept else 32 for i in range(256))


_BLANKED = blanked()


def words(text: str, ascii_signs: bytes = _BLANKED) -> list[str]:
    """Runs of letters and digits, as ``WORD`` finds them, and of ASCII signs that a table of ``blanked`` keeps."""
    # Signs give way to blanks as a whole; a search tries every character in turn.
    plain = text if text.isascii() else _SIGN.sub(" ", text)
    return plain.encode().translate(ascii_signs).decode().split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lang_pair(source: str = "source_lang", target: str = "target_lang") -> Column:
    """One string for the two labels as written; null is a label of its own."""
    null = F.lit("\x01")
    return F.concat_ws("\x00", F.coalesce(F.col(source), null), F.coalesce(F.col(target), null))


def digest(*parts: Column) -> Column:
    """128-bit key of several strings."""
    return F.unhex(F.md5(F.concat_ws("\x00", *parts)))


def long_form(df: DataFrame, fields: Sequence[str], *keep: Column) -> DataFrame:
    """One row per row and text field: ``keep``, ``field``, ``text``; null texts are left out."""
    one = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in fields])).alias("t")
    return df.select(*keep, one).select(*[c for c in df.select(*keep).columns], "t.field", "t.text").filter(F.col("text").isNotNull())
