"""Kernels that read slices of texts: bounded in memory, equal to their sequential forms."""

import random

import numpy as np
import pyarrow as pa

from termweave.functions import roots, tokenizers
from termweave.functions.tokenizers import PATTERN, Texts


def odd_texts(seed, n=200):
    rng = random.Random(seed)
    pieces = ["a", "fox", "é", "😀", " ", "  ", ",", "\t", "—", "½", "\x1c", "​", "नि", "A1", "\x00"]
    return [rng.choice([None, ""]) if rng.random() < 0.1 else "".join(rng.choice(pieces) for _ in range(rng.randint(1, 30))) for _ in range(n)]


def test_a_batch_is_cut_as_its_texts_are(spark):
    spans, cut = PATTERN.spans(spark), PATTERN.cutter(spark)
    for seed in range(5):
        texts = odd_texts(seed)
        for values in (pa.array(texts, pa.string()), pa.array(["x y", *texts], pa.string()).slice(1), pa.array(["a  b", " c", "", None, "d. "], pa.string())):
            found = cut(Texts(values), values)
            expected = [(i, *s) for i, v in enumerate(values.to_pylist()) for s in spans(v or "")]
            assert list(zip(found.rows.tolist(), found.starts.tolist(), found.ends.tolist(), found.tokens.to_pylist())) == expected


def test_tokens_of_long_texts_are_not_held_at_once(spark, monkeypatch):
    monkeypatch.setattr(tokenizers, "SLICE_BYTES", 100)
    texts = pa.array(["ab " * 20, None, "c " * 100, "", *["de"] * 90], pa.string())
    cuts = list(tokenizers.slices(texts))
    assert [a for a, _ in cuts] == [0, *(b for _, b in cuts[:-1])] and cuts[-1][1] == len(texts)
    sizes = np.array([len(v or "") for v in texts.to_pylist()])
    assert all(sizes[a:b].sum() <= 100 or b == a + 1 for a, b in cuts)
    # no array of a text's tokens reaches the JVM
    plan = PATTERN.explode(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), ["doc_id"])._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Generate" not in plan


def test_distinct_tokens(spark):
    rows = spark.createDataFrame(list(enumerate(odd_texts(7))), "doc_id long, text string")
    once = sorted(r.token for r in PATTERN.distinct(rows).collect())
    assert once == sorted({r.token for r in PATTERN.explode(rows, ["doc_id"]).collect()}) and len(once) > 5


def test_remembered_tokens_are_few():
    # four workers of an executor; 200 bytes a token and its root
    assert 4 * 200 * roots.MEMO < 100e6


def test_terms_are_the_most_frequent_of_all(spark, tmp_path, monkeypatch):
    from collections import Counter

    from termweave.plans import dictionaries as made

    rng = random.Random(1)
    words = ["w%d" % min(int(rng.expovariate(0.05)), 400) for _ in range(20_000)] + ["Été", "½x"] * 30
    texts = [" ".join(words[i : i + 37]) for i in range(0, len(words), 37)] + ["", "!?", None, "  lone"]
    spark.createDataFrame([(t,) for t in texts], "text string").write.parquet(str(tmp_path / "documents.parquet"))
    expected = set()
    for n in range(1, made.LONGEST + 1):
        counts = Counter()
        for t in texts:
            ws = "".join(c if c.isalnum() else " " for c in (t or "").lower()).split()
            counts.update(" ".join(ws[i : i + n]) for i in range(len(ws) - n + 1))
        expected |= {(f"g_{n}_{r}", label) for r, (label, _) in enumerate(sorted(counts.items(), key=lambda x: (-x[1], x[0]))[: made.TOP], 1)}
    # crowded sketches and few first candidates: the bounds must be lowered and counting repeated
    for bits, first in ((20, 2000), (11, 3)):
        monkeypatch.setattr(made, "CELL_BITS", bits)
        monkeypatch.setattr(made, "CANDIDATES", first)
        assert {(r.concept_id, r.label) for r in made.corpus_terms(spark, str(tmp_path)).collect()} == expected


def test_terms_do_not_shuffle_every_ngram(spark, tmp_path, monkeypatch):
    from termweave.plans import dictionaries as made

    kept = []
    counts = made._counts
    monkeypatch.setattr(made, "_counts", lambda *a: kept.append(counts(*a)) or kept[-1])
    monkeypatch.setattr(made, "CANDIDATES", 4)
    rng = random.Random(2)
    texts = [" ".join(["one two three four"] * 3 + ["u%d" % rng.randrange(10**9) for _ in range(40)]) for _ in range(300)]
    monkeypatch.setattr(made, "TOP", 3)
    spark.createDataFrame([(t,) for t in texts], "text string").write.parquet(str(tmp_path / "documents.parquet"))
    made.corpus_terms(spark, str(tmp_path))
    # 300 texts of 40 words that come once: 48,000 n-grams, of which few are counted as strings
    assert sum(k.count() for k in kept) < 5_000


def annotated(spark, **options):
    from termweave.operators.recognizer import Recognizer
    from termweave.sources.dictionary import from_rows

    names = [(1, "red fox"), (1, "fox"), (1, "foxs"), (2, "Fox"), (2, "fox"), (3, "den"), (3, "dens"), (4, "fox red den")]
    return Recognizer(from_rows(spark, names), root=roots.s_stem, **options)


def mentions(spark):
    rng = random.Random(3)
    words = ["fox", "Fox", "foxs", "red", "den", "dens", "the", ",", "é", "fxo"]
    return spark.createDataFrame([(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 20)))) for i in range(200)] + [(900, None)], "doc_id long, text string")


def test_filters_are_part_of_the_scan(spark):
    from pyspark.sql import functions as F

    from termweave.operators.filters import label_filter, levenshtein_filter

    own, docs = annotated(spark, filters=[]), mentions(spark)
    every = own.annotate(docs)
    for theta in (0.85, 1.0, -0.5, -1.5):
        fused, general = levenshtein_filter(own.index, theta)(every), label_filter(own.labels, theta)(every)
        assert sorted(map(tuple, fused.collect())) == sorted(map(tuple, general.select(*fused.columns).collect()))
        assert "Exchange" not in fused._jdf.queryExecution().executedPlan().toString()
    assert fused.count() < every.count()
    # rows that a caller has changed are no longer the scan's
    some = levenshtein_filter(own.index)(every.where("start > 5"))
    assert {r.start > 5 for r in some.collect()} == {True}
    chain = own.filtered([levenshtein_filter(own.index), lambda found: found.where(F.length("matched_text") > 3)])
    assert chain.index is own.index and own.filters == []
    assert "Exchange" not in chain.annotate(docs)._jdf.queryExecution().executedPlan().toString()


def test_longest_annotations_are_chosen_by_the_scan(spark, monkeypatch):
    from termweave.operators import match

    own, docs = annotated(spark, filters=[]), mentions(spark)
    place = ["doc_id", "concept_id", "start", "end", "matched_length"]
    got = match.longest(own.matches(docs))
    expected = match.longest(own.matches(docs).select("*")).select(*place)
    assert sorted(map(tuple, got.select(*place).collect())) == sorted(map(tuple, expected.collect()))
    handed = match.scan_of(own.matches(docs)).but(longest=True)
    assert handed.select("doc_id", "start").distinct().count() == got.count() < own.matches(docs).select("doc_id", "start").distinct().count()


def test_states_are_forgotten(spark, monkeypatch):
    from termweave.operators import scan

    own = annotated(spark, filters=[])
    matcher = scan.Matcher(own.index.rows_in_memory(), own.stop, own.terms).prepare(roots.s_stem.plain)
    cut = PATTERN.cutter(spark)
    texts = pa.array([r.text for r in mentions(spark).collect()], pa.string())
    walks = lambda: [x.tolist() for x in matcher.walk(cut(Texts(texts), texts))][:2]
    first, states = walks(), len(matcher.keys)
    monkeypatch.setattr(scan, "MEMO_STATES", 0)
    monkeypatch.setattr(scan, "MEMO_TOKENS", 2)
    assert walks() == first and len(matcher.keys) == states > len(matcher.posted)


def test_distances_of_many_pairs():
    from termweave.operators import near

    def levenshtein(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abé") for _ in range(rng.randint(0, 7)))
    pairs = [(word(), word()) for _ in range(3000)]
    a, b = (Texts(pa.array([p[i] for p in pairs], pa.string())) for i in (0, 1))
    for k in (0, 1, 2, 3):
        got = near.distances(near._matrix(a.codes, a.at[:-1], np.diff(a.at), -1), np.diff(a.at), near._matrix(b.codes, b.at[:-1], np.diff(b.at), -2), np.diff(b.at), k)
        assert got.tolist() == [min(levenshtein(*p), k + 1) for p in pairs]


def test_near_windows_are_found_in_one_pass(spark, monkeypatch):
    from termweave.operators import fuzzy
    from termweave.sources.dictionary import from_rows

    rng = random.Random(6)
    letters = lambda a, b: "".join(rng.choice("abcé") for _ in range(rng.randint(a, b)))
    labels = from_rows(spark, [(i, " ".join(letters(1, 6) for _ in range(rng.randint(1, 3)))) for i in range(60)])
    texts = [(i, rng.choice(["", " ", ", "]).join(letters(0, 5) + rng.choice(["", " ", "  ", "-", "नि", "É"]) for _ in range(rng.randint(0, 25)))) for i in range(60)]
    docs = spark.createDataFrame([*texts, (99, None)], "doc_id long, text string")
    for k in (1, 2):
        one = fuzzy.fuzzy_match(docs, labels, k)
        assert "Exchange" not in one._jdf.queryExecution().executedPlan().toString()
        monkeypatch.setattr(fuzzy, "SCAN_LABELS", 0)
        joined = fuzzy.fuzzy_match(docs, labels, k)
        monkeypatch.undo()
        assert one.schema.simpleString() == joined.schema.simpleString()
        rows = sorted(map(repr, map(tuple, one.collect())))
        assert rows == sorted(map(repr, map(tuple, joined.collect()))) and len(rows) > 100


def test_windows_shuffle_hits_only(spark):
    from pyspark.sql import functions as F

    from termweave import wordlists
    from termweave.operators import match

    stop, terms = wordlists.STOP["en"], wordlists.TERMINATION["en"]
    docs = mentions(spark).withColumn("text", F.concat_ws(" ", "text", F.lit("of red, the fox  and den")))
    rows = match.content_tokens(docs, stop, terms)
    tokens = {}
    for r in PATTERN.explode(docs, ["doc_id"]).orderBy("doc_id", "pos").collect():
        tokens.setdefault(r.doc_id, []).append(r)
    expected = set()
    for doc, found in tokens.items():
        seg = cpos = 0
        for r in found:
            if r.token.strip(" ") in terms:
                seg += 1
            elif r.token not in stop:
                cpos += 1
                expected.add((doc, seg, cpos, r.start, r.end, r.token))
    assert set(map(tuple, rows.collect())) == expected and len(expected) == rows.count()
    assert "Window" not in rows._jdf.queryExecution().executedPlan().toString()
    own = annotated(spark)
    plan = match.match_windows(docs.coalesce(1), own.index, stop, terms, roots.lower)._jdf.queryExecution().executedPlan().toString()
    # the tokens meet the dictionary before the exchange on the document's id, which is above in the plan
    assert plan.index("Exchange hashpartitioning(doc_id") < plan.index("BroadcastHashJoin") and plan.count("hashpartitioning(doc_id") == 1


def test_a_suffix_is_one_call_for_most_words():
    from termweave.functions import stemmers

    class Counted(str):
        calls = 0

        def endswith(self, *options):
            Counted.calls += 1
            return super().endswith(*options)

    options = stemmers._EN_STEP2_ORDER
    assert stemmers._suffix(Counted("qwrt"), options) == "" and Counted.calls == 1
    assert [stemmers._suffix(w, options) for w in ("national", "rational", "ogi", "")] == [next((s for s in options if w.endswith(s)), "") for w in ("national", "rational", "ogi", "")]
