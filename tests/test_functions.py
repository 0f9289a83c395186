import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from termweave.functions import roots, similarity, text
from termweave.functions.phonetics import double_metaphone
from termweave.functions.stemmers import english, french, stemmer

ENGLISH = "consigned:consign consistency:consist knackeries:knackeri generously:generous happy:happi dying:die hopping:hop hoping:hope relational:relat conditional:condit national:nation technique:techniqu interactions:interact according:accord caresses:caress ponies:poni skies:sky luxuriously:luxuri agreed:agre apology:apolog vietnamization:vietnam inning:inning"
FRENCH = "continu:continu continuellement:continuel continuité:continu majestueusement:majestu majestueux:majestu mains:main malheureusement:malheur malignité:malign chevaux:cheval constamment:const évidemment:évident ouvrière:ouvri bayer:bai"


@pytest.mark.parametrize("pair", ENGLISH.split())
def test_english(pair):
    word, stem = pair.split(":")
    assert english(word) == stem


@pytest.mark.parametrize("pair", FRENCH.split())
def test_french(pair):
    word, stem = pair.split(":")
    assert french(word) == stem


@given(st.text(alphabet="abcdeéèinoqrstuyY'ç", max_size=14))
def test_stemmers_take_anything(word):
    assert isinstance(english(word), str) and isinstance(french(word), str)


@given(st.text(max_size=12))
def test_phonetic_keys_take_anything(word):
    first, second = double_metaphone(word)
    assert isinstance(first, str) and isinstance(second, str)


@pytest.mark.parametrize("word, keys", [("Smith", ("SM0", "XMT")), ("Schmidt", ("XMT", "SMT")), ("Thompson", ("TMPSN", "")), ("Xavier", ("SF", "SFR")), ("architect", ("ARKTKT", "")), ("knight", ("NT", ""))])
def test_phonetic_keys(word, keys):
    assert double_metaphone(word) == keys


def test_no_stemmer():
    with pytest.raises(ValueError):
        stemmer("xx")


def tokens(spark, value):
    rows = spark.createDataFrame([(1, value)], "doc_id long, text string")
    return [(r.start, r.end, r.token) for r in text.explode_tokens(rows, ["doc_id"]).orderBy("pos").collect()]


@pytest.mark.parametrize(
    "value, expected",
    [
        (" mechanical  Brighton", [(0, 1, " "), (1, 11, "mechanical"), (12, 13, " "), (13, 21, "Brighton")]),
        ("a b ", [(0, 1, "a"), (2, 3, "b")]),
        ("a\nb", [(0, 1, "a"), (1, 2, "\n"), (2, 3, "b")]),
        ("plant-plant, (x)", [(0, 5, "plant"), (5, 6, "-"), (6, 11, "plant"), (11, 12, ","), (13, 14, "("), (14, 15, "x"), (15, 16, ")")]),
        ("", []),
        (None, []),
    ],
)
def test_tokens(spark, value, expected):
    assert tokens(spark, value) == expected


def test_pieces_lose_nothing(spark):
    values = ["été  noël\t—😀 x", "  a", "éa", "a b"]
    rows = spark.createDataFrame([(v,) for v in values], "text string").select("text", F.array_join(text.pieces(F.col("text")), "").alias("again")).collect()
    assert all(r.text == r.again for r in rows)


def test_normalize(spark):
    row = spark.createDataFrame([("Blasts (of PLANTS)-x",)], "t string").select(text.normalize_label(F.col("t")).alias("a"), text.normalize_fuzzy(F.lit("a  -B")).alias("b")).first()
    assert (row.a, row.b) == ("blasts  of plants x", "a b")


def test_piece_spans_and_short_ids(spark):
    row = spark.range(1).select(
        text.piece_spans(F.array(*map(F.lit, ["play", "##ing", "ball"])), F.lit("playing  ball")).alias("s"),
        text.last_piece(F.array(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("c")))).alias("l"),
        text.short_id(F.lit("http://x/y/c_12")).alias("i"),
        text.short_id(F.lit("http://x/y/c")).alias("none"),
    ).first()
    assert [(s.start, s.end) for s in row.s] == [(0, 4), (4, 7), (9, 13)]
    assert row.l == ["b", "c"] and row.i == "12" and row.none is None


def test_roots(spark):
    words = ["Ponies", "cats", "class", "corpus", "dies", None, "Running"]
    rows = spark.createDataFrame([(w,) for w in words], "t string").select(roots.s_stem(F.col("t")).alias("s"), roots.snowball()(F.col("t")).alias("e"), roots.identity(F.col("t")).alias("i")).collect()
    assert [r.s for r in rows] == ["pony", "cat", "class", "corpus", "dy", None, "running"]
    assert [r.e for r in rows] == ["poni", "cat", "class", "corpus", "die", None, "run"]
    assert [r.i for r in rows] == words


def test_similarity(spark):
    a, b = F.array(*map(F.lit, "x x y".split())), F.array(*map(F.lit, "x z".split()))
    row = spark.range(1).select(
        similarity.hard_overlap(a, b).alias("o"),
        similarity.jaccard(a, b).alias("j"),
        similarity.jaccard(F.array(F.lit("q")), F.array(F.lit("q"))).alias("same"),
        similarity.tversky_ratio(1, 1, 1, F.lit(2), F.lit(1), F.lit(1)).alias("zero"),
        similarity.tversky_ratio(1, 0.5, 0.5, F.lit(4), F.lit(2), F.lit(2)).alias("ratio"),
        similarity.jaccard_count(F.lit(1), F.lit(0)).alias("none"),
    ).first()
    assert (row.o, row.j, row.same, row.zero, row.ratio, row.none) == (2, 0.4, 0.5, 0.0, 2.0, 0.0)


def test_means(spark):
    rows = spark.createDataFrame([("a", 4.0, 1.0), ("a", None, 1.0), ("b", None, 1.0), ("c", 0.0, 1.0)], "g string, v double, w double")
    got = {r.g: r for r in rows.groupBy("g").agg(similarity.geometric_mean(F.col("v"), F.col("w")).alias("m"), similarity.arithmetic_mean(F.col("v"), F.col("w")).alias("a")).collect()}
    assert got["a"].m == pytest.approx(2.0) and got["a"].a == 2.0
    assert got["b"].m == 1.0 and got["b"].a is None
    assert got["c"].m == pytest.approx(1e-5)
    assert rows.where("g = 'z'").agg(similarity.geometric_mean(F.col("v"), F.col("w")).alias("m")).first().m is None


@settings(deadline=None)
@given(st.text(alphabet="ab", max_size=6), st.text(alphabet="ab", max_size=6))
def test_edit_distance_is_a_metric(a, b):
    from termweave.operators.filters import damerau_levenshtein as d

    assert d(a, b) == d(b, a) and (d(a, b) == 0) == (a == b) and abs(len(a) - len(b)) <= d(a, b) <= max(len(a), len(b))
