import pytest
from pyspark.sql import functions as F

from lexweave.llm import forms


def one(spark, f, *values):
    cols = [f"c{i}" for i in range(len(values))]
    df = spark.createDataFrame([values], ", ".join(f"{c} string" for c in cols))
    return df.select(f(*[F.col(c) for c in cols]).alias("x")).first().x


@pytest.mark.parametrize(("given", "want"), [("ｆｕｌｌ", "full"), ("ä ố", "ä ố"), ("​x­y", "xy"), ("a b‑c", "a b-c"), ("Аpfel", "Apfel"), ("ﬁn", "fin"), ("0O1l", "0O1l"), (None, None), ("", "")])
def test_same_form(spark, given, want):
    assert one(spark, forms.same_form, given) == want
