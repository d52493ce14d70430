"""Where ``p3_found`` does less work: each shortcut against the plain way that it stands for."""

import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from lexweave.llm import breaks, common, forms, language, residue


def test_words_and_ends():
    r = random.Random(3)
    bits = ["a", "Haus", "_", "#", "é", "ß", "²", "½", "Ⅷ", "漢", "é", "“", "—", " ", " ", "\x1c", "\x85", "×", "÷", "'", ".", "…", "\n", " ", "\U0001d7d8", "😀", "٣", "\x0b", ")", "»"]
    for _ in range(6000):
        t = "".join(r.choice(bits) for _ in range(r.randint(0, 8)))
        assert common.words(t) == re.findall(r"[^\W_]+", t), t
        assert residue.masked_words(t) == re.findall(r"[^\W_]+|#", t), t
        assert breaks.ended(t) == bool(breaks._ENDED.search(t)), t


def test_words_coded_by_runs():
    tree = language.ContextTree(Counter({"straße".encode(): 3, b"haus": 5, b"hausen": 1, b"a": 9}))

    def bits(word):
        data, total = b" " + word + b" ", 0.0
        for i in range(1, len(data)):
            p = 1.0
            for k in range(min(language.ORDER, i), -1, -1):
                seen, n = tree.contexts.get(data[i - k : i]), tree.symbols.get(data[i - k : i + 1])
                if seen:
                    p *= (n or seen[1]) / (seen[0] + seen[1])
                    if n:
                        break
            else:
                p /= 256
            total -= math.log2(p)
        return total

    scorer = language.Scorer(dict.fromkeys(language.LANGS, tree))
    for w in ("haus", "hausa", "Straßen", "x", "a", "日本", "hausen"):
        assert math.isclose(tree.bits(w.encode()), bits(w.encode())) and all(math.isclose(x, bits(w.encode())) for x in scorer.row(w))
    # what one word has paid for, the others share
    assert len(scorer.costs) < sum(len(language.runs(w.encode())) for w in ("haus", "hausa", "Straßen", "x", "a", "日本", "hausen"))


def test_usual_characters_never_change(spark):
    odd, usual = re.compile(forms.odd_class()), re.compile(forms.USUAL.replace(r"\z", r"\Z"))
    assert not [c for c in map(chr, (*range(0xD800), *range(0xE000, 0x30000))) if usual.match(c) and odd.search(c)]
    df = spark.createDataFrame([(x,) for x in ("", "naïve cœur", "„Größe“ – 5…", "a ", "ö ", " ö", "ȫ ü", "ﬁn é", "Ａé", "é­", "аé")] + [(None,)], "t string")
    plain = F.when(F.col("t").rlike(forms.odd_class()), forms.compose(forms.fold_lookalikes(F.col("t")))).otherwise(F.col("t"))
    assert df.filter(~forms.same_form(F.col("t")).eqNullSafe(plain)).count() == 0


def test_signs_at_the_end(memory):
    r = random.Random(5)
    bits = ["a", "é", "\U00010400", "[", "&", "<", "�", "…", "-", "`", "``", "(", "„", "”", " ", "\n", "\r\n", " ", ".", "abcdefghijk"]
    df = memory(*[(i, "x", "".join(r.choice(bits) for _ in range(r.randint(0, 9)))) for i in range(3000)])
    t, sign = F.col("translated_text"), r"[\[&<�…-][^\s]{0,12}$"
    assert df.filter(t.rlike(sign) != F.substring(t, -breaks.LAST, breaks.LAST).rlike(sign)).count() == 0
    assert df.filter(t.rlike(r"[(\[{«»„“”\"`](?:(?<=[^`])|(?=``))") != breaks.delimited(t)).count() == 0
    plain = F.split(t, r"(?<=[.!?…])\s+|[\r\n]+")
    got = residue.segments(df, "translated_text", "id").groupBy("id").count()
    want = df.select("id", F.explode(plain).alias("low")).filter(F.col("low").rlike(r"[\p{L}#]|(?<![\p{L}\p{N}])[0-9]")).groupBy("id").count()
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_sources_read_after_the_join(memory, monkeypatch):
    rows = [(i, f"Die Lampe {i} ist trocken.", f"The lamp {i} is dry.") for i in range(40)] + [(50, "Das Menü", "Access denied. Your request was blocked."), (51, "Access denied: das Menü", "Access denied.")]
    df = memory(*rows)
    found = residue.residue_rows(df)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    # the sources that are searched for notices stand above the semi join, not below it
    assert plan.index("_discusses") < plan.index("LeftSemi")
    assert {r.id for r in found.collect()} == {50}
    # a table of keys too large to be sent is joined without
    monkeypatch.setattr(residue, "sent_if_few", lambda keys: keys)
    assert {r.id for r in residue.residue_rows(df).collect()} == {50}
