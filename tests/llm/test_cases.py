"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, with the results the docstrings state."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexweave.llm import breaks, copies, language, leaks, neardup, packing, pairs, quality, residue, variants

DE = "Die Lampe ist im Winter trocken. Warum ist die Tür über Nacht teuer? Wir haben das Fenster gesehen, und dort war das Menü sauber."
EN = "The lamp is dry in winter. Why is the door expensive overnight? We have seen the window, and there the menu was clean."
FR = "La lampe est fragile en hiver. Pourquoi la porte est cher pendant la nuit ? Nous avons vu la fenêtre, et là le menu était propre."


@pytest.fixture(scope="module")
def corpus(memory):
    more = [(100 + i, DE.replace("Lampe", f"Lampe {i}"), EN.replace("lamp", f"lamp {i}")) for i in range(30)]
    return memory((1, DE, EN), (1, DE, EN), (2, None, None), (3, "", ""), (4, DE * 400, EN * 400), *more)


def test_variants(corpus, memory):
    assert variants.variant_pairs(corpus, ["source_text", "translated_text"]).count() == 0
    df = memory((5, "\u0410pfel", "a\u00a0b"), (3, "Apfel", "a b"), (4, "Apfel", None), (9, "A\u0308pfel", ""), (8, "\u00c4pfel", ""))
    got = {tuple(r) for r in variants.variant_pairs(df, ["source_text", "translated_text"]).collect()}
    assert got == {(3, 5, "source_text"), (4, 5, "source_text"), (8, 9, "source_text"), (3, 5, "translated_text")}
    blank = memory((1, "", ""), (2, "\u200b", " "), (3, "", "\u00a0"), (4, None, None))
    assert variants.variant_pairs(blank, ["source_text", "translated_text"]).count() == 0
    assert {tuple(r) for r in variants.canonical_rows(blank, ["source_text", "translated_text"]).collect()} == {(1, "source_text", ""), (2, "source_text", ""), (3, "source_text", ""), (2, "translated_text", " "), (3, "translated_text", " ")}
    assert {(r.id, r.canonical) for r in variants.canonical_rows(df, ["source_text"]).collect()} == {(3, "Apfel"), (4, "Apfel"), (5, "Apfel"), (8, "\u00c4pfel"), (9, "\u00c4pfel")}


def test_copies(corpus, memory):
    assert copies.later_copies(corpus).count() == 0
    df = memory((5, "b: 1, a: 2", None), (3, "A = 2; B = 1", None), (4, "a: 1; b: 2", None), (7, "x - y", None), (8, "X y!", None), (9, None, None))
    assert {tuple(r) for r in copies.later_copies(df).collect()} == {(3, 5), (7, 8)}
    assert copies.later_copies(df.limit(0)).count() == 0


def test_copies_behind_one_beginning(spark):
    rows = [(f"{'x' * 40} {i % 300}".encode(), 1, i) for i in range(600)]
    df = spark.createDataFrame(rows, "bytes binary, copies long, first_id long")
    got = copies.radix_buckets(df, most=100, longest=12).groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).collect()
    assert sum(r.n for r in got) == 600 and max(r.n for r in got) <= 100
    assert copies.radix_buckets(df, most=100, longest=12).groupBy("bytes").agg(F.countDistinct("bucket").alias("n")).filter("n > 1").count() == 0


def test_trie():
    t = copies.Trie()
    for k in (b"", b"abc", b"abc", b"a" * 12, b"a" * 24, b"a" * 25):
        t.add(k, 1, len(k))
    assert sorted(t.items()) == [(b"", 1, 0), (b"a" * 12, 1, 12), (b"a" * 24, 1, 24), (b"a" * 25, 1, 25), (b"abc", 2, 3)]


def test_near_duplicates(corpus):
    got = {tuple(r) for r in neardup.near_duplicates(corpus).collect()}
    ids = [1, 4, *range(100, 130)]
    # one word more among nineteen; the long text holds the same words
    assert got == {(a, b) for a in ids for b in ids if a < b}
    # the same from the classes: rows 1 and 1 are one, each class has its smallest id
    links, members = neardup.near_links(corpus), [tuple(r) for r in neardup.near_members(corpus).collect()]
    assert {tuple(r) for r in links.collect()} == got and sorted(members) == [(i, i) for i in ids]
    assert neardup.near_duplicates(corpus.limit(0)).count() == 0 and neardup.near_links(corpus.limit(0)).count() == 0


def test_all_near_duplicates(memory):
    # 24 of 32 words are shared, just three quarters: each of the pairs counts
    pair = lambda i: [(2 * i, " ".join(f"w{i}x{k}" for k in range(28)), "x"), (2 * i + 1, " ".join(f"w{i}x{k}" for k in range(4, 32)), "x")]
    rows = [r for i in range(400) for r in pair(i)]
    assert {tuple(r) for r in neardup.near_duplicates(memory(*rows)).collect()} == {(2 * i, 2 * i + 1) for i in range(400)}


def test_near_duplicates_of_short_words(memory):
    # "ŉ" parts words without a blank, so eighteen fit in 34 characters
    text = "aŉŉ" + "ŉ".join("bcdefghijklmopqr")
    assert len(text) == 34
    assert {tuple(r) for r in neardup.near_duplicates(memory((1, text, "x"), (2, text + " s", "x"))).collect()} == {(1, 2)}


def test_blocks():
    r = np.random.default_rng(3)
    sets = []
    for n in r.choice([18, 24, 33, 63, 64, 65, 130, 300], 200):
        own = r.choice(3000, n, replace=False)
        sets += [own, np.concatenate([own[n // 8 :], r.choice(np.arange(5000, 9000), n // int(r.integers(7, 15)), replace=False)])]
    sets = [np.sort(x).astype(np.int64) * 7919 for x in sets if len(x) >= 18]
    key = np.arange(len(sets)) * 1_000_003
    batch = pa.RecordBatch.from_pydict({"set_key": key, "salt": np.zeros(len(sets), np.int64), "w": pa.array([x.tolist() for x in sets], pa.list_(pa.int64()))})
    with_bits = next(neardup._with_bits(iter([batch]))).append_column("n", pa.array([len(x) for x in sets], pa.int32()))
    words = [set(x.tolist()) for x in sets]
    want = {(key[i], key[j]) for i in range(len(words)) for j in range(i + 1, len(words)) if 4 * len(words[i] & words[j]) >= 3 * len(words[i] | words[j])}
    for parts in ({}, {(0, c): 2 + c % 3 for c in range(14)}):
        dealt = pa.Table.from_batches(neardup.in_blocks(parts)(iter([with_bits])))
        met = [neardup._met(dealt.filter(pa.array(dealt["pair"].to_numpy() == p))) for p in dealt["pair"].unique().to_pylist()]
        got = [(x, y) for t in met for x, y in zip(t["key_a"].to_pylist(), t["key_b"].to_pylist(), strict=True)]
        assert len(want) > 100 and want <= set(got) and len(got) == len(set(got))


def test_register_estimate():
    r = np.random.default_rng(1)
    pool = r.integers(0, 2**63, 4000).astype(np.uint64)
    a, b = pool[:1000], np.concatenate([pool[:750], pool[1000:1250]])
    s = neardup.sketches(np.concatenate([a, b]), np.array([0, 1000]), 600)
    n = np.array([1000.0])
    assert abs((s[0] == s[1]).mean() - 0.6) < 0.08
    assert neardup.similarity_gap(s[:1], s[1:], n, n, 0.6)[0] < neardup.SLACK < neardup.similarity_gap(s[:1], s[1:], n, n, 0.9)[0]


def test_cut_texts(memory):
    good = [(i, f"Die Lampe {i} ist im Winter trocken. Das Menü ist sauber.", f"The lamp {i} is dry in winter. The menu is clean.") for i in range(10, 40)]
    df = memory(*good, (1, "Die Lampe ist im Winter trocken. Das Menü ist sauber.", "The lamp is dry in winter. The me"), (2, "Die Lampe ist im Winter trocken.", "The lamp is dry in winter"), (3, "Die Lampe ist im…", "The lamp is in…"), (4, "Die Lampe ist im Winter trocken.", "The lamp is dr…"), (5, "Das Menü ist sauber.", ""), (6, None, "The"), (7, "Lampe", None))
    assert {r.id for r in breaks.cut_texts(df).collect()} == {1, 4}
    share = {r.provider: (r.rows, r.cut) for r in breaks.cut_share(df).collect()}
    assert share == {"deepl": (37, 2)}
    assert breaks.cut_texts(df.limit(0)).count() == 0 and breaks.cut_share(df.limit(0)).count() == 0


def test_open_delimiters(memory):
    good = [(i, f"Die Lampe {i} ist im Winter trocken. Lies das Handbuch.", f"The lamp {i} is dry in winter. Read the manual.") for i in range(10, 40)]
    source = "Die Lampe ist im Winter trocken (siehe das Handbuch)."
    cut = [(1, source, "The lamp is dry in winter (see the manual"), (2, "Die Lampe ist im Winter trocken (siehe Abb. 3).", "The lamp is dry in winter (see fig."), (3, "Sie sagte: „Die Lampe ist im Winter trocken und neu.“", 'She said: "The lamp is dry.')]
    whole = [(4, source, "The lamp is dry in winter (see the manual)."), (5, "Sie sagte: „Die Lampe ist trocken.“", 'She said: "The lamp is dry.'), (6, "a) Die Lampe ist 5\" breit.", "a) The lamp is 5\" wide."), (7, "Die Lampe ist neu :( und trocken.", "The lamp is new :( and dry."), (8, "Die Lampe (alt ist trocken.", "The lamp (old is dry."), (9, "Die Lampe (alt) ist [neu] „gut“.", "The lamp (old) is [new] “good”.")]
    df = memory(*good, *cut, *whole)
    assert {r.id for r in breaks.cut_texts(df).collect()} == {1, 2, 3}
    assert breaks.open_delimiters("a (b [c) d {{e")[0] == [("{", 0, 11), ("{", 1, 12)]
    assert breaks.open_delimiters("a ```b``` «c» »d« „e“ “f” ```g")[0] == [("```", 1, 26)]


def test_spikes(memory):
    rows = [(i, "x", "y" * 160) for i in range(20)] + [(100 + i, "x", "z" * (100 + i) + ".") for i in range(100)]
    got = breaks.length_spikes(memory(*rows), F.col("provider"), F.col("translated_text")).collect()
    assert {(r.unit, r["length"], r.open_texts) for r in got} == {("chars", 160, 20), ("bytes", 160, 20)}


def test_residue(memory):
    rows = [(1, "Das Menü", "The {{name}}"), (2, "Das {{ name }}", "The {{name}}"), (3, "Das Menü", "Access denied. Your request was blocked."), (4, "Ohne JavaScript läuft die Galerie nicht.", "Without JavaScript the gallery does not run."), (5, "Das Menü", "This paragraph only holds the space until the final copy arrives."), (6, "Das Menü", "This paragraph only holds the space until the copy arrives."), (7, "x", None), (8, None, "")]
    assert {r.id for r in residue.residue_rows(memory(*rows)).collect()} >= {1, 3, 6}
    assert not {r.id for r in residue.residue_rows(memory(*rows)).collect()} & {2, 4, 7, 8}
    assert residue.residue_rows(memory(*rows).limit(0)).count() == 0


def test_residue_spreads(memory):
    notice = "access denied for this address until tomorrow at noon sharp"
    chain = [notice.replace("sharp", "today"), notice.replace("sharp", "today").replace("denied", "closed"), notice.replace("sharp", "today").replace("denied", "closed").replace("noon", "nine")]
    far = "access denied today because the lamp is dry in winter again"
    rows = [(i, "Das Menü", t) for i, t in enumerate([notice, *chain, "sharp noon at tomorrow until address this for denied access", "the lamp is dry in winter and clean", far.replace("access denied", "entry closed")])]
    df = memory(*rows)
    assert {r.id for r in residue.residue_rows(df).collect()} == {0, 1, 2, 3, 4}
    one = residue.segments(df, "translated_text").select("seg_key", "masked").distinct()
    front = one.filter(F.col("masked").contains("access"))
    assert {r.seg_key for r in residue.near_segments(one, front, most=1).collect()} == {r.seg_key for r in residue.near_segments(one, front).collect()}


def test_residue_of_copies(memory):
    # a row stored again and again is no notice; what stands for different sources is
    rows = [(i, "Das Menü ist im Keller zu finden, wenn das Licht an der Tür brennt.", "The menu is below.") for i in range(12)]
    rows += [(20 + i, f"Das Menü {'abcdefgh'[i]} ist im Keller zu finden, wenn das Licht brennt.", "Nothing stands here yet.") for i in range(8)]
    assert {r.id for r in residue.residue_rows(memory(*rows)).collect()} == set(range(20, 28))


def test_residue_recall():
    r = np.random.default_rng(5)
    names = [f"w{i}" for i in range(60)]
    lost = total = 0
    for n in (4, 5, 8, 9, 10, 20, 30):
        for _ in range(400):
            a = list(r.choice(names, n, replace=False))
            b = [x for x in names if x not in a][: max(1, n // 9)]
            # a word more, a word changed, as many as the share allows
            other = a + b[:1] if n < 9 else a[: n - len(b)] + b
            assert 5 * len(set(a) & set(other)) >= 4 * len(set(a) | set(other))
            lost += not residue.Known([" ".join(other)]).near([" ".join(a)])[0]
            total += 1
    assert lost == 0, (lost, total)


def test_pairs(memory):
    rows = [(100 + i, DE.replace("Lampe", f"Lampe{i}"), EN) for i in range(40)]
    odd = [(1, DE, " ​"), (2, DE, "I'm sorry, but I can't translate this passage."), (3, DE, "Here you are: " + DE.upper()), (4, DE, FR), (5, DE, EN), (6, None, None), (7, DE, "{{name}}")]
    teach = memory(*[(200 + i, FR, EN) for i in range(40)], source_lang="fr")
    df = memory(*rows, *odd).unionByName(teach)
    assert {r.id: r.defect for r in pairs.pair_defects(df).collect()} == {1: "empty", 2: "refusal", 3: "copied", 4: "other_language", 6: "empty"}
    assert 3 not in {r.id for r in pairs.pair_defects(df.withColumn("status", F.lit("confirmed"))).collect()}


def test_pairs_of_copies(memory):
    # a cut translation stored again and again stays cut; as a notice it would be residue and have no defect
    rows = [(i, DE, "The lamp is dry in winter. Why is the") for i in range(12)] + [(20, DE, EN)]
    assert {tuple(r) for r in pairs.pair_defects(memory(*rows)).collect()} == {(i, "truncated") for i in range(12)}


def test_automaton():
    a = pairs.SuffixAutomaton("a b a b c".split())
    assert a.covered("x a b c y a b".split(), 2) == 5 and a.covered([], 2) == 0


def test_language(memory):
    rows = [memory(*[(1000 * k + i, t.replace(" ", f" x{i} ", 1), EN) for i in range(30)], source_lang=x) for k, (x, t) in enumerate((("de", DE), ("en", EN), ("fr", FR)), 1)]
    odd = memory((1, FR, EN), (2, DE + " " + FR, EN), (3, None, EN), (4, "", EN)).unionByName(memory((5, DE, EN), source_lang="n/a")).unionByName(memory((6, DE, EN), source_lang="de-DE")).unionByName(memory((7, DE, EN), target_lang=None))
    df = odd.unionByName(rows[0]).unionByName(rows[1]).unionByName(rows[2])
    got = {(r.id, r.field, r.issue, r.lang) for r in language.language_issues(df).collect()}
    assert got == {(1, "source_lang", "wrong", "fr"), (2, "source_lang", "mixed", "de"), (2, "source_lang", "mixed", "fr"), (5, "source_lang", "missing", "de"), (7, "target_lang", "missing", "en")}
    assert language.language_issues(df.limit(0)).count() == 0


def test_languages(memory):
    rows = [memory(*[(1000 * k + i, t.replace(" ", f" x{i} ", 1), EN) for i in range(30)], source_lang=x) for k, (x, t) in enumerate((("de", DE), ("en", EN), ("fr", FR)), 1)]
    raw = "Die Lampe ist im Wi\u200bnter tro\ufb01cken. La lampe est fragile en hiver."
    df = memory((1, DE + " " + FR, EN), (2, raw, "12"), (3, None, "")).unionByName(rows[0]).unionByName(rows[1]).unionByName(rows[2])
    got = {(r.id, r.field, r.segment): r for r in language.languages(df).collect()}
    assert [got[1, "source_lang", k].lang for k in range(1, 7)] == ["de"] * 3 + ["fr"] * 3
    assert all(0.25 <= r.confidence <= 1 for r in got.values() if r.lang) and len({r.confidence for r in got.values()}) > 2
    assert [(1, "source_lang", k) in got for k in range(8)] == [True] * 7 + [False]
    assert raw[got[2, "source_lang", 2].begin : got[2, "source_lang", 2].end] == "La lampe est fragile en hiver."
    assert got[2, "target_lang", 0].lang == "en" and got[3, "target_lang", 0].lang is None and (3, "source_lang", 0) not in got
    assert {i for i, f, k in got if f == "target_lang" and k == 0} == {r.id for r in df.collect()}
    assert language.languages(df.limit(0)).count() == 0


def test_mixture():
    de, fr = [0.0, 40, 40, 40], [9.0, 40, 40, 0.0]
    short = [[9.0 + i, 40, 40, 0.0] for i in range(5)]
    assert language.mixture(np.array([de, *short])) == ("de", "fr")
    assert language.mixture(np.array([de, *[fr] * 9])) == ()
    assert language.mixture(np.array([de, [3.0, 40, 40, 0.0], [2.0, 40, 40, 0.0]])) == ()


def test_leaks(spark):
    item = "one two three four five six seven eight nine ten"
    docs = spark.createDataFrame([(1, "x ONE, two three-four\nfive six seven eight y"), (2, "one two three four five six seven"), (3, None), (4, ""), (5, item.replace("four", "4")), (6, "w " * 20000 + item)], "doc_id long, text string").withColumn("t", F.lit(1))
    items = spark.createDataFrame([(7, item), (8, None), (9, "short")], "item_id long, text string").withColumn("u", F.lit(1))
    got = {r.doc_id: r for r in leaks.leaks(docs, items).collect()}
    assert {d for d, r in got.items() if r.exact_run >= 8} == {1, 6}
    assert (got[5].exact_run, got[5].overlap_words, got[5].substitutions) == (6, 9, 1)
    assert leaks.leaks(docs.limit(0), items).count() == 0 and leaks.leaks(docs, items.limit(0)).count() == 0


def test_overlap():
    def slow(doc, item, shift):
        lo, hi = max(0, -shift), min(len(item), len(doc) - shift)
        run = best = words = wrong = gap = 0
        top = (0, 0)
        for x in doc[lo + shift : hi + shift] == item[lo:hi]:
            run, words, gap = (run + 1, words + 1, 0) if x else (0, words, gap + 1)
            if x:
                best, top = max(best, run), max(top, (words, -wrong))
            elif gap > 1:
                words = wrong = 0
            else:
                wrong += bool(words)
        return best, top[0], -top[1]

    r = np.random.default_rng(9)
    for _ in range(300):
        doc, item = r.integers(0, 3, 30), r.integers(0, 3, 12)
        shift = int(r.integers(-5, 25))
        assert leaks.overlap(doc, item, shift) == slow(doc, item, shift)


def test_packing(spark):
    r = np.random.default_rng(3)
    sizes = r.integers(1, 100, 3000)
    bins, made = packing.pack(sizes, 128)
    load = np.bincount(bins, weights=sizes)
    assert load.max() <= 128 and len(load) == made and made <= 1.02 * np.ceil(sizes.sum() / 128) + 2
    docs = spark.createDataFrame([(i, DE) for i in range(50)] + [(90, None), (91, ""), (92, DE * 30), (1, DE)], "doc_id long, text string").withColumn("tokens", F.lit("x"))
    limits = spark.createDataFrame([("a", 100), ("b", 300), ("a", 100), ("c", None)], "provider string, max_tokens long")
    got = packing.requests(docs, limits, group=20).toPandas()
    assert set(got.provider) == {"a", "b"}
    assert got.groupby(["provider", "request"]).tokens.sum().max() <= 300 and got[got.provider == "a"].groupby("request").tokens.sum().max() <= 100
    total = got.groupby("provider").tokens.sum()
    assert total["a"] == total["b"] and (got[got.doc_id < 50].part == 0).all() and got[got.doc_id == 92].part.max() > 1
    assert packing.requests(docs.limit(0), limits).count() == 0 and packing.requests(docs, limits.limit(0)).count() == 0


def test_quality(spark, data):
    own = [(-1, "\n".join(f"* Lampe {i}" for i in range(9))), (-2, "Teil;Preis;Ort\n" + "\n".join("Lampe;12.50;-\nja;418;Kabel" for _ in range(4))), (-3, "\n".join("°§$%&/()=?" * 3 for _ in range(9))), (-4, DE), (-5, None), (-6, " \n ")]
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame(own, "doc_id long, text string")).withColumn("kind", F.lit(1))
    got = {r.doc_id: r for r in quality.document_kinds(docs).collect()}
    assert [got[-i].kind for i in range(1, 7)] == ["list", "table", "junk", "prose", "prose", "prose"]
    assert got[-4].word_count == 24 and got[-5].word_count == 0 and got[-4].ended_lines == 1
    assert quality.document_kinds(docs.limit(0)).count() == 0


def test_mixture_of_all_rows(spark):
    r = np.random.default_rng(2)
    x = np.concatenate([r.normal(0, 1, (9000, 10)), r.normal(4, 2, (3000, 10))])
    table = spark.createDataFrame([tuple(map(float, v)) for v in x], ", ".join(f"{c} double" for c in quality.FEATURES)).repartition(5)
    seeds = np.array([[0.0] * 10, [4.0] * 10])
    got = quality.Mixture(table, seeds, ["prose", "junk"])
    every = np.concatenate([x, seeds])
    assert np.allclose(got.mean, every.mean(0)) and np.allclose(got.scale, every.std(0))
    # the same steps in memory
    z, means, shapes, weights = got.standard(every), got.standard(seeds), np.array([np.eye(10)] * 2), np.full(2, 0.5)
    for _ in range(quality.STEPS):
        logs = np.stack([np.log(w) - 0.5 * np.linalg.slogdet(c)[1] - 0.5 * np.einsum("ij,jk,ik->i", z - m, np.linalg.inv(c), z - m) for w, m, c in zip(weights, means, shapes, strict=True)], 1)
        p = np.exp(logs - logs.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        n = p.sum(0)
        weights, means = n / n.sum(), p.T @ z / n[:, None]
        shapes = np.array([((z - m) * p[:, j : j + 1]).T @ (z - m) / n[j] + quality.FLOOR * np.eye(10) for j, m in enumerate(means)])
    assert np.allclose(got.means, means, atol=1e-6) and np.allclose(got.shapes, shapes, atol=1e-6) and np.allclose(got.weights, weights, atol=1e-6)
    assert got.kinds == ["prose", "junk"]
