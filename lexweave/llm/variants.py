"""Problem 5: texts that look the same but differ in their characters.

Method: look-alike-mapped values are grouped under an accent-sensitive Unicode collation, one
deterministic member stands for each class, and it is joined back to the rows. A class can only
hold unequal texts when one of them holds a character to map, so only texts that share a cheap
key with such a text reach the collation.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexweave.llm.forms import odd_class, same_form
from lexweave.llm.common import lang_pair, long_form

COLLATION = "UNICODE"
#: What a reader sees of a text in its plain form; a text without it has no look.
SEEN = r"[^ \t\n\r\f\x0B]"


def variant_texts(df: DataFrame, fields: Sequence[str], id_col: str = "id") -> tuple[DataFrame, DataFrame]:
    """Rows and texts of the classes that hold texts which look alike but differ.

    Returns ``rows`` (``id``, ``text_key``) and ``texts`` (``text_key``, ``class_key``, ``pair``,
    ``field``, ``text``, ``canonical``). Texts are compared within one field and language pair (the
    labels as written, null equal to null). Null texts belong to no class, empty ones look like each
    other; exact copies are one text; a class has as canonical member its least mapped text.
    """
    rows = long_form(df, fields, F.col(id_col).alias("id"), lang_pair().alias("pair"))
    form = same_form(F.col("text"))
    plain = F.regexp_replace(form, r"[^\x21-\x7e]+", "")
    rows = rows.withColumn("near", F.xxhash64("pair", "field", plain))
    odd = rows.filter(F.col("text").rlike(odd_class())).select("near").distinct()
    rows = rows.join(odd, "near", "left_semi").withColumn("text_key", F.xxhash64("pair", "field", "text"))
    texts = rows.groupBy("pair", "field", "text", "text_key").agg(F.count(F.lit(1)).alias("copies"))
    texts = texts.withColumn("mapped", same_form(F.col("text")))
    spark = df.sparkSession
    joined = spark.sql(
        f"""
        WITH t AS (SELECT *, collate(mapped, '{COLLATION}') AS look FROM {{texts}}),
        c AS (
            SELECT pair, field, look, min(mapped) AS canonical, count(*) AS members
            FROM t GROUP BY pair, field, look HAVING count(*) > 1
        )
        SELECT t.text_key, xxhash64(t.pair, t.field, c.canonical) AS class_key, t.pair, t.field, t.text, c.canonical
        FROM t JOIN c ON t.pair = c.pair AND t.field = c.field AND t.look = c.look
        """,
        texts=texts,
    )
    return rows.select("id", "text_key"), joined


def canonical_rows(df: DataFrame, fields: Sequence[str], id_col: str = "id") -> DataFrame:
    """``id``, ``field``, ``canonical``: the canonical text of every row whose text has another look-alike.

    Rows whose text is the only one of its look need none. Blank texts are a class of their own.
    """
    rows, texts = variant_texts(df, fields, id_col)
    return texts.select("text_key", "field", "canonical").join(rows, "text_key").select("id", "field", "canonical").distinct()


def variant_pairs(df: DataFrame, fields: Sequence[str], id_col: str = "id") -> DataFrame:
    """``id_a``, ``id_b``, ``field``: row pairs whose texts look the same and are unequal, smaller id first.

    Exact copies meet no row of their own text, so a text stored many times costs its pairs with
    the other texts of the class and no more. Texts in which nothing is to be seen (blanks and
    invisible characters) look like nothing and form no pair; ``canonical_rows`` holds them too.
    """
    rows, texts = variant_texts(df, fields, id_col)
    seen = texts.filter(F.col("canonical").rlike(SEEN))
    members = seen.join(rows, "text_key").select("class_key", "pair", "field", "canonical", "text", "id")
    a, b = members.alias("a"), members.alias("b")
    same = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("class_key", "pair", "field", "canonical")]
    both = a.join(b, [*same, F.col("a.text") != F.col("b.text"), F.col("a.id") < F.col("b.id")])
    return both.select(F.col("a.id").alias("id_a"), F.col("b.id").alias("id_b"), F.col("a.field").alias("field")).distinct()
