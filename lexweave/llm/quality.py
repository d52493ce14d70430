"""Problem 10: text statistics of documents, and the kind of text they tell.

Method: a Gaussian mixture, fitted by expectation-maximization on the standardized statistics of all
documents, whose moments are added up in every step. The components start at inspected examples and
are mapped to the kind of the examples that fall to them. The kind with the largest share in the
mixture is the document's kind.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexweave.llm.forms import same_form, words
from lexweave.plans.lineage import keep_table, shared, spread

ITEM = r"^\s*(?:[*•·▪‣◦→➤>+\-–—]|\(?\d{1,3}[.)]|\(?[^\W\d_][.)]|\[[ xX]?\])\s+\S"
CELLS = r"\||\t|\S {2,}\S.*? {2,}\S|^[^;]*;[^;]*;|^[^,]*,\S?[^\s,]*,\S"
ENDED = r"[.!?…:][\"'»“”)\]]*\s*$"
#: A line of up to so many words and no end punctuation is a bare short entry.
SHORT_WORDS = 7
#: Words in at least this share of the documents are common. There are at most 500 times as many as a document has distinct words on average.
COMMON_SHARE = 0.002
STEPS, FLOOR = 25, 0.02

STATISTICS = ("word_count", "mean_word_length", "symbol_ratio", "ended_lines", "common_words")
FEATURES = ("log_words", "mean_word_length", "symbol_ratio", "ended_lines", "common_words", "item_lines", "cell_lines", "short_lines", "log_distinct", "odd_tokens")

# Inspected examples, in the manner of the texts seen for each kind.
EXAMPLES = (
    ("prose", "Die Lampe ist im Winter trocken. Warum ist die Tür über Nacht teuer? Wir haben das Fenster gesehen, und dort war das Menü sauber.\nDas Archiv hat 12 Stufen und ersetzt das Foto.\n\nPrüfen Sie das Regal am Wochenende, denn das Kabel ist einfach. Die Pumpe kostet 36 Euro, und das Dach ist stabil."),
    ("prose", "The drawer is dry in winter. Why is the lamp expensive overnight? We have seen the window, and there the menu was clean.\nNew in stock: lamp\n1. Store the drawer\n2. Clean the map\nThe archive has 12 levels and replaces the photo on the back. Check the shelf at the weekend, because the cable is simple."),
    ("prose", "La lampe est fragile en hiver. Pourquoi la porte est cher pendant la nuit ? Nous avons vu la fenêtre, et là le menu était propre. Vérifiez le tableau, car le fil est simple."),
    ("list", "* Lampe\n* Signal\n* Reinigen Sie das Dach\n* Kabel, 5 x\n* Menü\n* Testen Sie die Pumpe,\n* Regal\n* Archiv"),
    ("list", "1. Clean the map\n2. Store the lamp\n3. drawer\n4. cable\n5. Replace the spring\n6. shelf"),
    ("list", "Lampe, 18 x\nSignal\nArchiv, 38 x\nFenster\nKabel, 5 x\nMenü\nPumpe, 7 x\nRegal"),
    ("table", "| Teil | Preis | Ort |\n---|---|---\n| Lampe | 12.50 | - |\n| ja | 418 | Kabel |\n| 3.99 | - | ja |\n| 77 | Signal | 204 |"),
    ("table", "Part\tPrice\tPlace\nok\t12.50\t-\nlamp\t418\tok\n3.99\t-\tcable\nok\t77\t204\n-\tok\t18.70"),
    ("table", "Teil;Preis;Ort\nLampe;12.50;-\nja;418;Kabel\n3.99;-;ja\n-;77;204"),
    ("table", "Teil   Preis   Ort\nLampe   12.50   -\nja   418   Kabel\n3.99   -   ja\n-   77   204"),
    ("junk", "1f 9d 55 25 0c e0 6c 3d 15 37 df 07\ned b2 93 b3 65 f6 33 28 80 3d 5f\na2 44 2b 63 d6 84 79 8d 5a"),
    ("junk", "gAOGajoaewoSp0p0GT8mJuLhTuYwZwyNX98wA0ItRROWn0xVRuzYonHlz9HvsDjNtoZC+7qZJY5Z\nPp0Gb84xBBvOpfCM3CHHpAhkJ1nUy1No1YadLoR47qWp7pKQZOtuQoyTikpAJs12ufwxBU7CrlRj\nNDETgl/53gk7JSx7UB3tomLJIx6V6Ey0wZn5D0MBNhYH89fwTFX9NUuomgdxfxSPCCj8gBlOPfft"),
    ("junk", ":: :: \\u0064 && () :: () :: || ~~ __ 0xd519 ~~ && ||\n0x2068 __ || && \\u0028 __ ~~ a __ ~~ :: || s t ::\n%3D && ~~ 0x2823 %3D %3D ||"),
    ("junk", "*°%=\\%!§&{%!]§]\\/=§\\/§+$&}}^>@#_+&@{-}?<^!//{>~\n/?\\^=>{_?+-{[=>[&$$\\<>_/[#§|?+$% >_^]&§]=\n]*!*-&° <^\\/& > ^![}<@[\\/°"),
    ("junk", "Shfs vgkzvdn fpwtpz nrfk.\nRftf xkgh ktmdfsp knc vgcfnts rdndssg pfgsfppc dckz sfmfmgg.\nBxn hhnvl pvnmzr mplndhl llsxbrzk lbc ffs tvlpwrpl lrzb cwcdlsnw."),
    ("junk", "hatu teti teti hatu hatu hatu teti hatu teti teti teti\nteti hatu hatu teti hatu hatu hatu teti hatu hatu teti hatu\nteti teti hatu teti teti teti"),
    ("junk", "fdutq dtgg gökq dqöqh hhquhq hlijr ösf wahtj tgdfws\njldöeh aw kfowk kqew jk gsjsg adlws hfföjk sqflk\nulhjkk ogkstg sds tsz hfh ddöff stfk hlsjj"),
)
KINDS = ("prose", "list", "table", "junk")


def common_words(docs: DataFrame, text: str = "text", least: float = COMMON_SHARE) -> list[str]:
    """The words in at least ``least`` of all documents, by their number of documents over the whole table."""
    rows = docs.filter(F.col(text).isNotNull()).select(F.explode(F.array_distinct(words(F.col(text)))).alias("w")).filter(F.col("w").rlike(r"^\p{L}+$"))
    bound = docs.count() * least
    return sorted(r.w for r in rows.groupBy("w").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= max(2.0, bound)).select("w").collect())


_WORDS, _SPLIT = re.compile(r"[^\W_]+"), re.compile(r"\r\n|\r|\n")
_ITEM, _CELLS, _ENDED = re.compile(ITEM), re.compile(CELLS), re.compile(ENDED)
_ALNUM = re.compile(r"[^\W_]")
_SYMBOL = re.compile(r"[^\w\s]|_")
MEASURES = "word_count long, mean_word_length double, symbol_ratio double, ended_lines double, common_words double, line_count long, item_lines double, cell_lines double, short_lines double, log_words double, log_distinct double, odd_tokens double"


def measured(text: str, common: frozenset[str]) -> tuple:
    """The statistics of one text in its plain form, in the order of ``MEASURES``."""
    words = _WORDS.findall(text.lower())
    n = len(words)
    rows = [x for x in _SPLIT.split(text) if x.strip()]
    ended = item = cell = short = 0
    for x in rows:
        end, cells = _ENDED.search(x) is not None, _CELLS.search(x) is not None
        ended += end
        item += _ITEM.match(x) is not None
        cell += cells
        short += not end and not cells and len(_WORDS.findall(x)) <= SHORT_WORDS
    tokens = text.split()
    odd = sum(1 for x in tokens if not _ALNUM.search(x) and x.strip("|-–—*+•·:=,;.!?…→"))
    k, solid = max(1, len(rows)), max(1, len("".join(text.split())))
    m = max(1, n)
    return n, sum(map(len, words)) / m, len(_SYMBOL.findall(text)) / solid, ended / k, sum(w in common for w in words) / m, len(rows), item / k, cell / k, short / k, float(np.log1p(n)), float(np.log1p(len(set(words)))), odd / max(1, len(tokens))


def with_statistics(docs: DataFrame, common: list[str], text: str = "text") -> DataFrame:
    """``docs`` with the statistics of its text and the shares of its lines; all 0 for a null or blank text.

    One pass in Python for each text: the dozen patterns over words and lines take a tenth of the
    time that they take as interpreted lambdas in the JVM.
    """
    sent = shared(docs.sparkSession, frozenset(common))

    @F.pandas_udf(MEASURES)
    def measure(of: pd.Series) -> pd.DataFrame:
        held = sent()
        return pd.DataFrame([measured(x, held) for x in of], columns=[c.split()[0] for c in MEASURES.split(", ")])

    return docs.withColumn("_m", measure(same_form(F.coalesce(F.col(text), F.lit(""))))).select("*", "_m.*").drop("_m")


def _rows(batch: pa.RecordBatch) -> np.ndarray:
    return np.stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns], 1)


def summed(table: DataFrame, of: Callable[[np.ndarray], tuple[np.ndarray, ...]]) -> list[tuple[np.ndarray, ...]]:
    """What ``of`` tells of each batch of the rows of ``table``, added up in every partition; one entry for each that has rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                part = of(_rows(batch))
                total = part if total is None else tuple(x + y for x, y in zip(total, part, strict=True))
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(total)], pa.binary())], ["part"])

    # Sorted, so that the order in which tasks end doesn't change the sums.
    return [pickle.loads(x) for x in sorted(bytes(r.part) for r in table.mapInArrow(run, "part binary").collect())]


class Mixture:
    """Gaussian mixture over standardized features; each component bears a kind."""

    def __init__(self, table: DataFrame, seeds: np.ndarray, kinds: list[str]) -> None:
        """Fitted to all rows of ``table`` and the seeds: each step adds up the moments of every component over the whole table."""
        ends = lambda parts, own: tuple(sum(x) for x in zip(*parts, own, strict=True))
        first = lambda x: (np.array(float(len(x))), x.sum(0))
        n, total = ends(summed(table, first), first(seeds))
        self.mean = mean = total / n
        second = lambda x: (((x - mean) ** 2).sum(0),)
        self.scale = np.maximum(np.sqrt(ends(summed(table, second), second(seeds))[0] / n), 1e-6)
        s = self.standard(seeds)
        width = np.eye(s.shape[1])
        self.means, self.shapes, self.weights = s.copy(), np.array([width] * len(s)), np.full(len(s), 1 / len(s))
        for _ in range(STEPS):
            n, one, two = ends(summed(table, self.moments), self.moments(seeds))
            n = n + 1e-9
            alive = n >= 2
            self.weights = np.maximum(n, 1e-6) / np.maximum(n, 1e-6).sum()
            for j in np.nonzero(alive)[0]:
                # The moments are taken about the mean of the step before, which is near.
                d = one[j] / n[j]
                c = np.empty_like(width)
                c[np.triu_indices(len(width))] = two[j] / n[j]
                c = np.triu(c) + np.triu(c, 1).T
                self.means[j] = self.means[j] + d
                self.shapes[j] = c - np.outer(d, d) + FLOOR * width
        votes = self.shares(s)
        self.kinds = [max(KINDS, key=lambda k: sum(v for v, x in zip(votes[:, j], kinds, strict=True) if x == k)) if votes[:, j].sum() > 1e-3 else kinds[int(((s - self.means[j]) ** 2).sum(1).argmin())] for j in range(len(s))]

    def standard(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) / self.scale

    def moments(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Number, sum and sum of products of the rows in each component, by their shares, about its mean."""
        z = self.standard(x)
        r = self.shares(z)
        i, k = np.triu_indices(z.shape[1])
        one, two = np.empty((len(self.means), z.shape[1])), np.empty((len(self.means), len(i)))
        for j, m in enumerate(self.means):
            near = r[:, j] > 0
            d = z[near] - m
            w = r[near, j]
            one[j] = w @ d
            two[j] = ((d * w[:, None]).T @ d)[i, k]
        return r.sum(0), one, two

    def shares(self, z: np.ndarray) -> np.ndarray:
        """Each component's share in each row."""
        logs = np.empty((len(z), len(self.means)))
        for j, (m, c) in enumerate(zip(self.means, self.shapes, strict=True)):
            low = np.linalg.cholesky(c)
            y = (z - m) @ np.linalg.inv(low).T
            logs[:, j] = np.log(self.weights[j]) - np.log(np.diag(low)).sum() - 0.5 * np.einsum("ij,ij->i", y, y)
        logs -= logs.max(1, keepdims=True)
        p = np.exp(logs)
        return p / p.sum(1, keepdims=True)

    def kind_shares(self, x: np.ndarray) -> np.ndarray:
        """Share of each kind in each row."""
        p = self.shares(self.standard(x))
        return np.stack([p[:, [k == kind for k in self.kinds]].sum(1) for kind in KINDS], 1)


def fitted(stats: DataFrame, common: list[str]) -> Mixture:
    """The mixture of all rows of ``stats`` and the examples."""
    spark = stats.sparkSession
    shown = with_statistics(spark.createDataFrame([(t,) for _, t in EXAMPLES], "text string"), common).select(*FEATURES).collect()
    seeds = np.array([list(r) for r in shown], float)
    return Mixture(stats.select(*FEATURES), seeds, [k for k, _ in EXAMPLES])


def document_kinds(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``kind`` (prose, list, table, junk), ``share`` and the statistics of every document.

    Null and blank texts have no statistics but zeros and count as prose, as nothing speaks against it.
    """
    spark = docs.sparkSession
    common = common_words(docs, text)
    own = docs.select(F.col(id_col), F.col(text))
    # Written once: every step of the fit reads all rows.
    stats = keep_table(with_statistics(spread(own), common, text).drop(text))
    model = shared(spark, fitted(stats, common))

    @F.pandas_udf("array<double>")
    def judge(*columns: pd.Series) -> pd.Series:
        return pd.Series(list(model().kind_shares(np.stack([c.to_numpy(float) for c in columns], 1))))

    j = stats.withColumn("j", judge(*FEATURES))
    best = F.greatest(*[F.struct(F.element_at("j", i + 1).alias("share"), F.lit(k).alias("kind")) for i, k in enumerate(KINDS)])
    j = j.withColumn("best", F.when(F.col("line_count") > 0, best))
    return j.withColumns({"kind": F.coalesce("best.kind", F.lit("prose")), "share": F.coalesce("best.share", F.lit(0.0))}).drop("j", "best")
