"""Matching against hand-made cases and a sequential model."""

import collections
import random

import pytest

from termweave import wordlists
from termweave.functions import roots
from termweave.functions.text import explode_tokens
from termweave.functions.tokenizers import PATTERN
from termweave.operators import index, match
from termweave.operators.filters import damerau_levenshtein, levenshtein_filter
from termweave.operators.recognizer import ConceptRecognizer, EmbeddingRecognizer, FuzzyRecognizer, Recognizer, lower_recognizer, phonetic_recognizer, stem_recognizer
from termweave.sources.dictionary import from_rows

UNIT = [(1, "bright cat"), (2, "Brighton"), (3, "mechanical"), (4, "cet"), (5, "caets"), (6, "cat"), (7, "a")]
PLANTS = [(1, "blasts (of plants)"), (2, "emergent aquatic plants"), (3, "plant structure"), (4, "submerged aquatic plants"), (5, "allelochemical"), (6, "plant-plant interaction")]


def found(spark, recognizer, text):
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    rows = recognizer.annotate(docs).select("concept_id", "start", "end", "matched_length").collect()
    return sorted(((int(r[0]), *r[1:]) for r in rows), key=lambda r: (r[1], r))


@pytest.mark.parametrize(
    "rows, text, filters, expected",
    [
        (UNIT, "The bright cat is from Brighton. Cats are like that!", [], [(1, 4, 14, 2), (6, 11, 14, 1), (2, 23, 31, 1), (6, 33, 37, 1)]),
        (UNIT, "The bright cat is from Brighton. Cats are like that!", None, [(1, 4, 14, 2), (6, 11, 14, 1), (2, 23, 31, 1)]),
        (UNIT, " mechanical  Brighton", [], [(3, 1, 11, 1), (2, 13, 21, 1)]),
        (UNIT, "A bright cat loves Brighton's bright lights.", None, [(1, 2, 12, 2), (6, 9, 12, 1), (2, 19, 27, 1)]),
        ([(1, "spectroscopy"), (2, "technique"), (3, "according")], "infrared spectroscopy technique (NIRS). According to", [], [(1, 9, 21, 1), (2, 22, 31, 1), (3, 40, 49, 1)]),
        (PLANTS, "Secondly, plant-plant interactions influence allelochemical fun", None, [(6, 10, 34, 3), (5, 45, 59, 1)]),
    ],
)
def test_stemmed(spark, rows, text, filters, expected):
    assert found(spark, stem_recognizer(from_rows(spark, rows), filters=filters), text) == expected


@pytest.mark.parametrize(
    "rows, text, expected",
    [
        ([(1, "red fox")], "fox red", [(1, 0, 7, 2)]),
        ([(1, "red"), (2, "red fox den")], "red fox", []),
        ([(1, "red fox")], "red fox fox", []),
        ([(1, "red fox")], "red red fox", [(1, 4, 11, 2)]),
        ([(1, "red red fox"), (2, "red fox")], "red red fox", [(1, 0, 11, 3), (2, 4, 11, 2)]),
        ([(1, "red fox")], "red of fox", [(1, 0, 10, 2)]),
        ([(1, "red fox")], "red, fox", []),
        ([(1, "red fox")], "red  fox", []),
        ([(1, "fox"), (1, "Fox")], "fox", [(1, 0, 3, 1), (1, 0, 3, 1)]),
        ([(1, "of the")], "of the", []),
        ([(1, "fox")], "", []),
    ],
)
def test_edges(spark, rows, text, expected):
    assert found(spark, lower_recognizer(from_rows(spark, rows), filters=[]), text) == expected


def test_set_filter_keeps_one_row_per_concept(spark):
    assert found(spark, lower_recognizer(from_rows(spark, [(1, "fox"), (1, "Fox")])), "fox") == [(1, 0, 3, 1)]


def sequential(labels, tokens, stop, terms):
    """Annotations (key, first token, last token, tokens) as defined, token by token."""
    postings, histogram, length = collections.defaultdict(set), collections.Counter(), {}
    for key, words in labels.items():
        kept = [w for w in words if w not in stop]
        length[key] = len(kept)
        for w in kept:
            postings[w].add(key)
            histogram[key, w] += 1
    out = set()
    for i, first in enumerate(tokens):
        if first in stop or first in terms or not postings.get(first):
            continue
        keys, end, size, j = postings[first], i, 1, i + 1
        while j < len(tokens) and tokens[j] not in terms:
            if tokens[j] not in stop:
                both = keys & postings.get(tokens[j], set())
                allowed = [k for k in both if tokens[j] != first or histogram[k, tokens[j]] >= 2]
                if not allowed:
                    break
                keys, end, size = both, j, size + 1
            j += 1
        out |= {(k, i, end, size) for k in keys if length[k] == size}
    return out


@pytest.mark.parametrize("seed", range(4))
def test_against_the_sequential_model(spark, seed):
    rng = random.Random(seed)
    words = ["w%d" % i for i in range(5)]
    labels = {str(i): [rng.choice([*words, "of"]) for _ in range(rng.randint(1, 5))] for i in range(rng.randint(3, 9))}
    texts = [[rng.choice([*words, *words, "of", ","]) for _ in range(rng.randint(0, 14))] for _ in range(300)]
    dictionary = from_rows(spark, [(k, " ".join(v)) for k, v in labels.items()])
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    stop, terms = wordlists.STOP["en"], wordlists.TERMINATION["en"]
    built = index.build(dictionary, stop, roots.lower)
    expected = set()
    for doc, tokens in enumerate(texts):
        starts, at = [], 0
        for t in tokens:
            starts.append(at)
            at += len(t) + 1
        for key, first, last, size in sequential(labels, tokens, stop, terms):
            expected.add((doc, key, starts[first], starts[last] + len(tokens[last]), size))
    for plan in (match.match, match.match_windows):
        got = plan(docs, built, stop, terms, roots.lower).collect()
        assert {(r.doc_id, r.concept_id, r.start, r.end, r.matched_length) for r in got} == expected
        assert len(got) == len(expected)


def test_both_tokenizers_agree(spark):
    values = ["été  noël\t—😀 x", "  a", "éa", " a b ", "", None, "a\x0bb\x1cc\x85d", "½²x_y", "​z é"]
    rows = spark.createDataFrame(list(enumerate(values)), "doc_id long, text string")
    table = lambda made: sorted(map(tuple, made.select("doc_id", "pos", "start", "end", "token").collect()))
    assert table(PATTERN.explode(rows, ["doc_id"])) == table(explode_tokens(rows, ["doc_id"]))


def test_fuzzy_recognizer(spark):
    own = FuzzyRecognizer(from_rows(spark, [(1, "red foxes"), (2, "badger")]), filters=[]).initialize()
    assert found(spark, own, "The Red, foxs saw a badgers") == [(1, 4, 13, 2), (2, 20, 27, 1)]
    strict = FuzzyRecognizer(from_rows(spark, [(1, "red foxes"), (2, "badger")]))
    assert found(spark, strict, "red foxs, badgers, badger") == [(1, 0, 8, 2), (2, 19, 25, 1)]


def test_embedding_recognizer(spark):
    def pieces():
        return lambda text: [p for w in text.split() for p in ([w[:4], "##" + w[4:]] if len(w) > 4 else [w])]

    def embedder():
        import numpy as np

        cut = pieces()
        return lambda labels: [(cut(x), np.array([[len(p), 1.0] for p in cut(x)], np.float32).reshape(-1, 2)) for x in labels]

    own = EmbeddingRecognizer(from_rows(spark, [(1, "redder fox"), (1, "fox"), (2, "of")]), pieces, embedder, filters=[]).initialize()
    assert found(spark, own, "a fox of redder foxes and redder fox") == [(1, 2, 15, 3), (1, 26, 36, 3), (1, 33, 36, 1)]
    vectors = {r.token: r.vectors for r in own.concept_vectors().collect()}
    assert vectors["##er"] == {"1": [4.0, 1.0]} and vectors["fox"] == {"1": [3.0, 1.0]}
    pooled = {(r.concept_id, r.label_index): list(r.pooled) for r in own.label_vectors().collect()}
    assert pooled["1", 1] == [3.0, 1.0] and len(pooled) == 3


def test_filters_follow_any_recognizer(spark):
    class Everything(ConceptRecognizer):
        def initialize(self):
            return self

        def mentions(self, docs):
            tokens = self.tokens(docs).selectExpr("doc_id", "'1' as concept_id", "0 as label_index", "start", "end", "token as matched_text", "1 as matched_length")
            return match.described(tokens)

    own = Everything(from_rows(spark, [(1, "fox")]))
    assert found(spark, own, "red fox") == [(1, 4, 7, 1)]
    assert own(spark.createDataFrame([(1, "x")], "doc_id long, text string")).count() == 0


def plan_of(rows):
    return rows._jdf.queryExecution().executedPlan().toString()


def test_texts_are_not_shuffled(spark):
    docs = spark.createDataFrame([(1, "red fox")], "doc_id long, text string")
    own = lower_recognizer(from_rows(spark, [(1, "red fox")]), filters=[])
    for rows in (own.matches(docs), own.annotate(docs)):
        assert "Exchange" not in plan_of(rows) and "MapInArrow" in plan_of(rows)


def test_one_exchange_of_the_texts_by_windows(spark):
    docs = spark.createDataFrame([(1, "red fox")], "doc_id long, text string")
    own = lower_recognizer(from_rows(spark, [(1, "red fox")]))
    plan = plan_of(match.match_windows(docs, own.index, own.stop, own.terms, roots.lower))
    assert plan.count("Exchange hashpartitioning(doc_id") == 1
    assert "BroadcastHashJoin" in plan


def test_texts_of_one_split_are_cut_by_all_cores(spark):
    docs = spark.createDataFrame([(1, "red fox")], "doc_id long, text string")
    own = lower_recognizer(from_rows(spark, [(1, "red fox")]))
    for few, moved in ((docs.coalesce(1), "RoundRobinPartitioning(4)"), (docs.repartition(2), "RoundRobinPartitioning(2)")):
        plan = plan_of(match.match_windows(few, own.index, own.stop, own.terms, roots.lower))
        assert plan.count("Exchange hashpartitioning(doc_id") == plan.count("RoundRobin") == plan.count(moved) == 1


def test_a_root_without_a_plain_form(spark):
    own = Recognizer(from_rows(spark, [("1", "Robert")]), root=roots.soundex, filters=[])
    assert found(spark, own, "Rupert") == [(1, 0, 6, 1)]


def test_repeated_keys_and_null_texts(spark):
    docs = spark.createDataFrame([(1, "red fox"), (1, "red fox"), (None, "fox red"), (2, None), (3, "")], "doc_id long, text string")
    own = lower_recognizer(from_rows(spark, [(1, "red fox")]), filters=[])
    rows = [(r.doc_id, r.matched_text) for r in own.annotate(docs).collect()]
    assert sorted(rows, key=repr) == [(1, "red fox"), (1, "red fox"), (None, "fox red")]


def test_a_large_dictionary_is_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(index, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(index, "SCAN_BYTES", 0)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        own = lower_recognizer(from_rows(spark, [(1, "red fox")]), filters=[])
        docs = spark.createDataFrame([(1, "red fox")], "doc_id long, text string")
        rows = own.matches(docs)
        assert "BroadcastHashJoin" not in rows._jdf.queryExecution().executedPlan().toString()
        assert rows.count() == 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_loose_levenshtein(spark):
    own = Recognizer(from_rows(spark, UNIT), filters=[])
    docs = spark.createDataFrame([(1, "Cats mechanically cat")], "doc_id long, text string")
    every = own.annotate(docs)
    spans = lambda theta: {(r.start, r.end) for r in levenshtein_filter(own.index, theta)(every).collect()}
    assert spans(0.85) == {(18, 21)}
    assert spans(-0.5) == {(18, 21)}
    assert spans(-1.5) == {(0, 4), (18, 21), (5, 17)}
    assert spans(1.0) == set()


@pytest.mark.parametrize("a, b, d", [("ca", "abc", 2), ("", "ab", 2), ("abcd", "acbd", 1), ("same", "same", 0), ("kitten", "sitting", 3)])
def test_damerau_levenshtein(a, b, d):
    assert damerau_levenshtein(a, b) == damerau_levenshtein(b, a) == d


def test_phonetic(spark):
    assert [r[0] for r in found(spark, phonetic_recognizer(from_rows(spark, [(1, "Smith")]), filters=[]), "Smyth")] == [1]


def test_unknown_language(spark):
    with pytest.raises(ValueError):
        Recognizer(from_rows(spark, UNIT), language="xx")


def test_french(spark):
    own = stem_recognizer(from_rows(spark, [(1, "cheval noir")]), language="fr", filters=[])
    assert found(spark, own, "Les chevaux noirs") == [(1, 4, 17, 2)]


def test_saved_index(spark, tmp_path):
    own = lower_recognizer(from_rows(spark, UNIT), filters=[])
    own.index.save(str(tmp_path / "index"))
    again = lower_recognizer(from_rows(spark, [(9, "other")]), filters=[]).load_index(spark, str(tmp_path / "index"))
    assert found(spark, again, "cat") == [(6, 0, 3, 1)]
