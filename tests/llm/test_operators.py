"""Each operator on awkward tables, and against brute force where SQL can't say it."""

import collections
import html
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from conftest import SMALL
from hypothesis import given, settings
from hypothesis import strategies as st

from termweave.llm import bpe, common, exact_dedup, html_extract, language_id, line_dedup, mixing, near_dedup, quality_classifier, quality_rules, substring_dedup

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, score double, _gone int, _new string, _trow long, h long, tokens int, own string"
PROSE = "the cat sat on a mat while rain fell over old houses near the river and people walked home slowly under grey skies".split()


def prose(rng, n):
    return " ".join(rng.choice(PROSE) for _ in range(n))


def row(doc_id, text, lang="en", source="s"):
    return (doc_id, text, lang, source, None if text is None else len(text), 0.5, 1, "x", 2, 3, 4, "y")


@pytest.fixture(scope="module")
def awkward(spark):
    rng = random.Random(1)
    long = prose(rng, 20_000)
    body = prose(rng, 80)
    rows = [row(1, body), row(2, body), row(2, body), row(3, ""), row(4, None), row(None, body), row(None, None), row(5, "   \n\n "), row(6, long), row(7, body + " end", None, None), row(8, "héé ñ 😀 \u0000x"), row(9, "one"), row(9, "two"), row(10, "line a\nline b\nline a\n\nline b")]
    return spark.createDataFrame(rows, COLUMNS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], COLUMNS)


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(i, i % 2, None if i == 3 else 0) for i in range(1, 11)] + [(None, 1, 0), (1, 0, 1), (2, None, None)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def pairs(table, *columns):
    return sorted((tuple(r) for r in table.select(*columns).collect()), key=lambda r: tuple((v is not None, v) for v in r))


# ------------------------------------------------------------------ 1 near dedup


def jaccard(a, b):
    x, y = (collections.Counter(s.tolist()) for s in (np.repeat(*near_dedup.shingles(a)), np.repeat(*near_dedup.shingles(b))))
    total = sum((x | y).values())
    return sum((x & y).values()) / total if total else 0.0


def test_signatures_estimate_weighted_jaccard():
    rng = random.Random(2)
    worst = []
    for _ in range(30):
        words = prose(rng, 120).split()
        other = list(words)
        for _ in range(rng.randint(0, 25)):
            other[rng.randrange(len(other))] = "w%d" % rng.randrange(99)
        texts = [" ".join(words) + " la la la la" * rng.randint(0, 9), " ".join(other) + " la la la la" * rng.randint(0, 9)]
        parts = [near_dedup.shingles(t) for t in texts]
        sig = near_dedup.signatures(np.concatenate([np.full(len(e), i) for i, (e, _) in enumerate(parts)]), np.concatenate([e for e, _ in parts]), np.concatenate([c for _, c in parts]), 2, 640)
        worst.append(float((sig[0] == sig[1]).mean()) - jaccard(*texts))
    assert abs(np.mean(worst)) < 0.02 and np.abs(worst).max() < 0.12


def test_near_groups_against_brute_force(spark):
    rng = random.Random(3)
    texts = []
    for _ in range(60):
        base = [rng.choice(PROSE) + str(rng.randrange(30)) for _ in range(rng.randint(3, 150))]
        texts.append(base)
        for _ in range(rng.choice([0, 0, 1, 3])):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(copy) // 20))):
                copy[rng.randrange(len(copy))] = "new%d" % rng.randrange(1000)
            texts.append(copy)
    texts = [" ".join(t) for t in texts]
    found = {r.doc_id: r.group_id for r in near_dedup.groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    close = {(i, j) for i in range(len(texts)) for j in range(i + 1, len(texts)) if jaccard(texts[i], texts[j]) >= near_dedup.THRESHOLD}
    together = {(i, j) for i, j in close if found.get(i, -1) == found.get(j, -2)}
    assert len(together) >= 0.9 * len(close)
    leader = list(range(len(texts)))
    for _ in texts:
        for i, j in close:
            leader[i] = leader[j] = min(leader[i], leader[j])
    assert all(leader[i] == leader[g] for i, g in found.items())


def test_one_bucket_of_strangers_and_teams(spark):
    """Everything meets in one bucket: the rounds find what all pairs would."""
    rng = random.Random(13)
    texts = []
    for i in range(14):
        base = [f"b{i}_{k}" for k in range(40)]
        for step in range(rng.choice([1, 1, 2, 5])):
            # each a bit further from the first: chains that only their neighbours join
            texts.append(" ".join(["x%d_%d" % (i, k) if k < 7 * step else w for k, w in enumerate(base)]))
    rng.shuffle(texts)
    rows = [(i, *near_dedup.shingles(t)) for i, t in enumerate(texts)]
    packed = spark.createDataFrame([(i, e.tobytes() + c.astype(np.uint32).tobytes()) for i, e, c in rows], "doc_id long, packed binary")
    met = spark.createDataFrame([(7, i) for i, _, _ in rows] + [(8, 0), (8, 1)], "key long, doc long")
    links = near_dedup.verified_links(met, packed, near_dedup.THRESHOLD)
    close = {(i, j) for i in range(len(texts)) for j in range(i + 1, len(texts)) if jaccard(texts[i], texts[j]) >= near_dedup.THRESHOLD}
    found = {tuple(sorted(r)) for r in links.collect()}
    assert found <= close and len(found) == links.count()

    def least(edges):
        lead = list(range(len(texts)))
        for _ in texts:
            for i, j in edges:
                lead[i] = lead[j] = min(lead[i], lead[j])
        return lead

    assert least(found) == least(close)


def test_near_awkward(awkward, empty):
    assert near_dedup.groups(empty).count() == 0
    groups = dict(pairs(near_dedup.groups(awkward), "doc_id", "group_id"))
    assert groups[1] == groups[2] == groups[7] == 1 and not {3, 4, 5, 6, None} & set(groups)
    kept = near_dedup.dedup(awkward)
    assert kept.columns == awkward.columns
    assert [r[0] for r in pairs(kept, "doc_id")] == [None, None, 1, 3, 4, 5, 6, 8, 9, 9, 10]
    assert near_dedup.dedup(empty).count() == 0


# -------------------------------------------------------------------------- 2 BPE


@pytest.fixture(scope="module")
def codec():
    return bpe.codec(bpe.VOCABULARY)


@pytest.fixture(scope="module")
def merges():
    import base64

    import tiktoken

    with open(bpe.VOCABULARY, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("abcdeiorstu  \n\t'0129éß漢😀"), st.characters(exclude_categories=["Cs"])), max_size=80))
def test_bpe_equals_merging(codec, merges, text):
    ids = codec.encode(text)
    assert ids == merges.encode_ordinary(text) and codec.decode(ids) == text.encode()


@pytest.mark.parametrize("text", ["a" * 5000, "ab" * 3000, "-" * 4097, "x" * 301 + " " * 301, "\n " * 500, "aaaaab" * 999])
def test_bpe_on_long_pieces(codec, merges, text):
    assert codec.encode(text) == merges.encode_ordinary(text)


def test_bpe_words_are_kept_once(merges):
    """Chunks that skip the pattern are coded as it would; letters alone stay out of the other memo."""
    own = bpe.Codec(bpe.VOCABULARY)
    for text in ["a thinbleing über.", "x ΑΣǅ ɐb ª º ͅ ", ", . .a a. 1. é. ñ,ñ _ß. a.b.", "á. ɐ ʰa it's don't 's, ’s."]:
        assert own.encode(text) == merges.encode(text)
    assert "thinbleing" in own.chunks and " thinbleing" not in own.pieces


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from("abcdeiorstu  \n\t'0129éß漢😀"), st.characters(exclude_categories=["Cs"])), max_size=60), max_size=6))
def test_bpe_of_many_equals_merging(codec, merges, texts):
    codec.words.free()
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(bpe, "MANY", 1)
        patch.setattr(bpe, "GROUP", 100)
        assert list(codec.encode_all(texts)) == [merges.encode_ordinary(t) for t in texts]


def test_bpe_new_words_are_merged_at_once(merges, monkeypatch):
    rng = random.Random(5)
    texts = [" ".join("".join(rng.choices("abdeilnorstué", k=rng.randint(1, 14))) for _ in range(400)) for _ in range(12)]
    own = bpe.Codec(bpe.VOCABULARY)
    monkeypatch.setattr(own, "_by_backtracking", None)  # not needed
    assert list(own.encode_all(texts)) == [merges.encode_ordinary(t) for t in texts]


def test_bpe_awkward(awkward, empty):
    assert bpe.encode(empty).count() == 0
    coded = bpe.encode(awkward)
    rows = coded.collect()
    assert len(rows) == awkward.count() and all(r.round_trip is not False for r in rows)
    assert [(r.n_tokens, r.token_ids, r.round_trip) for r in rows if r.doc_id == 3] == [(0, [], True)]
    assert [(r.n_tokens, r.token_ids, r.round_trip) for r in rows if r.doc_id == 4] == [(None, None, None)]
    assert pairs(bpe.decode(coded), "doc_id", "text") == pairs(awkward, "doc_id", "text")
    with pytest.raises(FileNotFoundError):
        bpe.encode(empty, "/nowhere")


# ----------------------------------------------------------------------- 3 mixing


@given(st.lists(st.tuples(st.integers(0, 9), st.integers(0, 12)), min_size=1, max_size=6), st.integers(0, 40))
def test_apportionment_against_listing_quotients(parties, seats):
    weights, stock = [float(w) for w, _ in parties], [a for _, a in parties]
    offers = sorted((-w / (2 * k + 1), i) for i, (w, a) in enumerate(zip(weights, stock)) if w > 0 for k in range(a))
    expected = collections.Counter(i for _, i in offers[:seats])
    assert mixing.sainte_lague(weights, stock, seats) == [expected[i] for i in range(len(parties))]


@given(st.lists(st.tuples(st.integers(0, 9), st.integers(0, 12), st.booleans()), min_size=1, max_size=6))
def test_reachable_against_listing_quotients(parties):
    weights, stock, limits = [float(w) for w, _, _ in parties], [a for _, a, _ in parties], [on for _, _, on in parties]
    offers = sorted((-w / (2 * k + 1), i, k) for i, (w, a) in enumerate(zip(weights, stock)) if w > 0 for k in range(a + 1))
    count = 0
    for _, i, k in offers:
        if k == stock[i]:
            if limits[i]:
                break
        else:
            count += 1
    assert mixing.reachable(weights, stock, limits) == count


def test_mixing_awkward(awkward, empty):
    assert mixing.mix(empty).count() == 0 and mixing.mixed_documents(empty).count() == 0
    rows = mixing.mix(awkward, {"s": 0.0}, block_tokens=50, shards=2).collect()
    assert {(r.source, r.doc_id, r.source_share, r.target_share) for r in rows} == {("", 7, 1.0, 1.0)}
    # nothing but the source of most tokens is named: all of it and as much of the others as there is
    assert mixing.mix(awkward, {"s": 1e6}, block_tokens=50, shards=2).where("source = 's'").count() == awkward.where("source = 's'").count()
    assert mixing.mixed_documents(awkward).columns == awkward.columns
    assert mixing.mix(awkward, seats=0).count() == 0


def test_blocks_by_hand(spark):
    """Streams in order of shard and id; a long document covers several blocks, an empty one none."""
    rows = [(1, "a b c", "x"), (2, "a " * 24 + "b", "x"), (3, "", "x"), (4, "a b", "x"), (None, "a", "x"), (1, "a b c d", "y"), (4, "c", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = sorted((r.source, r.shard, -1 if r.doc_id is None else r.doc_id, r.tokens, r.before, r.block) for r in mixing.blocks(docs, 10, 2).collect())
    assert got == [("x", 0, -1, 1, 0, 0), ("x", 0, 2, 25, 1, 0), ("x", 0, 4, 1, 26, 2), ("x", 0, 4, 2, 27, 2), ("x", 1, 1, 3, 29, 2), ("x", 1, 3, 0, 32, 3), ("y", 1, 1, 4, 0, 0)]


def test_token_shares_meet_the_weights(spark):
    """Scarce favoured sources, a hot source without a weight, one long document, one tiny source."""
    rng = random.Random(12)
    sizes = {"a": 300, "b": 300, "c": 300, "hot": 3000, "tiny": 2}
    rows = [(source, prose(rng, rng.randint(20, 60))) for source, n in sizes.items() for _ in range(n)] + [("c", prose(rng, 1500))]
    docs = spark.createDataFrame([(i, text, source) for i, (source, text) in enumerate(rows)], "doc_id long, text string, source string")
    mixture = mixing.mix(docs, {"a": 3.0, "b": 2.0, "none": 5.0}, block_tokens=100, shards=4)
    got = {r["source"]: r["sum(tokens)"] for r in mixture.groupBy("source").sum("tokens").collect()}
    stock = {r["source"]: r["sum(tokens)"] for r in mixing.blocks(docs, 100, 4).groupBy("source").sum("tokens").collect()}
    assert got["a"] >= 0.97 * stock["a"] and got["tiny"] == stock["tiny"]
    assert all(abs(got[s] / got["a"] * 3 - w) <= 0.1 for s, w in {"b": 2, "c": 1, "hot": 1}.items())
    told = {r.source: r.source_share for r in mixture.select("source", "source_share").distinct().collect()}
    assert all(abs(told[s] - got[s] / sum(got.values())) < 1e-5 for s in got)


def test_token_shares_of_the_query(spark):
    """Every source's share of the tokens is within a point of what the weights ask for."""
    mixture = mixing.query(spark, "/root/testdata/sf0.1").groupBy("source", "source_share", "target_share").sum("tokens").collect()
    total = sum(r["sum(tokens)"] for r in mixture)
    assert len(mixture) > 10
    for r in mixture:
        assert abs(r["sum(tokens)"] / total - r.target_share) <= 0.01 and abs(r.source_share - r["sum(tokens)"] / total) < 1e-5


# ------------------------------------------------------------------ 4 exact dedup


@given(st.lists(st.tuples(st.binary(max_size=6), st.integers(0, 50)), max_size=60))
def test_trie_holds_what_went_in(rows):
    trie, expected = exact_dedup.Trie(), collections.defaultdict(set)
    for text, i in rows:
        assert trie.insert(text, np.array([i]))
        expected[text].add(i)
    got = {t: (least, set(ids.tolist())) for t, least, ids in trie.records()}
    assert got == {t: (min(s), s) for t, s in expected.items()}


@given(st.lists(st.tuples(st.binary(min_size=1, max_size=4), st.integers(0, 9)), max_size=50), st.integers(1, 20))
def test_trie_spills_whole_subtrees(rows, every):
    trie, left, expected = exact_dedup.Trie(), collections.defaultdict(set), collections.defaultdict(set)
    for n, (text, i) in enumerate(rows):
        expected[text].add(i)
        if not trie.insert(text, np.array([i])):
            left[text].add(i)
        if n % every == 0:
            for t, _, ids in trie.spill():
                left[t].update(ids.tolist())
    held = {t: set(ids.tolist()) for t, _, ids in trie.records()}
    assert not set(held) & set(left) and {**held, **left} == expected
    assert trie.bytes >= 0


@given(st.binary(max_size=400), st.binary(max_size=400), st.integers(0, 300))
def test_common_prefix(a, b, shared):
    a, b = a[:shared] + a, a[:shared] + b
    most = min(len(a), len(b))
    want = next((i for i in range(most) if a[i] != b[i]), most)
    assert exact_dedup.common_prefix(a, 0, b, 0, most) == want


@pytest.mark.parametrize("budget", [1 << 30, 3000, 900])
def test_exact_against_brute_force(spark, budget):
    rng = random.Random(4)
    rows = [(rng.randrange(300), "ab"[: rng.randrange(3)] * rng.randrange(20) + rng.choice(["", "z"])) for _ in range(500)] + [(None, "a"), (5, None)]
    groups = collections.defaultdict(set)
    for i, t in rows:
        if i is not None and t is not None:
            groups[t].add(i)
    want = sorted((i, min(s)) for s in groups.values() if len(s) > 1 for i in s)
    got = exact_dedup.owners(spark.createDataFrame(rows, "doc_id long, text string"), trie_bytes=budget, combine_bytes=500)
    assert pairs(got, "doc_id", "owner_id") == want


def test_exact_awkward(awkward, empty):
    assert exact_dedup.owners(empty).count() == 0 and exact_dedup.dedup(empty).count() == 0
    assert pairs(exact_dedup.owners(awkward), "doc_id", "owner_id") == [(1, 1), (2, 1)]
    kept = exact_dedup.dedup(awkward)
    assert kept.columns == awkward.columns and kept.count() == awkward.count() - 2


# ------------------------------------------------------------------- 5 line dedup


def lines_by_hand(rows):
    seen, out = set(), []
    for doc_id, text in sorted(set(rows), key=lambda r: (r[0], xxhash.xxh64(r[1]).intdigest())):
        kept = []
        for line in text.split("\n"):
            if not line.strip(" ") or line not in seen:
                kept.append(line)
            if line.strip(" "):
                seen.add(line)
        if kept == text.split("\n") or any(k.strip(" ") for k in kept):
            out.append((doc_id, "\n".join(kept)))
    return sorted(out)


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_lines_against_brute_force(spark, limit):
    rng = random.Random(5)
    rows = [(i, "\n".join(rng.choice(["", " ", "a", "b", "c%d" % rng.randrange(40)]) for _ in range(rng.randrange(1, 7)))) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert pairs(line_dedup.dedup_lines(docs, segments=3, broadcast_limit=limit), "doc_id", "text") == lines_by_hand(rows)


def test_lines_where_numbers_are_too_many_to_send(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "LOST_LIMIT", -1)
    rows = [(i, "\n".join(f"l{k % 5}" for k in range(i, i + 4))) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert pairs(line_dedup.dedup_lines(docs), "doc_id", "text") == lines_by_hand(rows)


def test_lines_beside_clashing_names(spark):
    docs = spark.createDataFrame([(1, "a\nb", 1, 2, 3), (2, "b\nc", 4, 5, 6)], ["doc_id", "text", "a.b", "_gone", "_new"])
    out = line_dedup.dedup_lines(docs)
    assert out.columns == docs.columns and sorted(map(tuple, out.collect())) == [(1, "a\nb", 1, 2, 3), (2, "c", 4, 5, 6)]


def test_lines_awkward(awkward, empty):
    assert line_dedup.dedup_lines(empty).count() == 0
    out = line_dedup.dedup_lines(awkward)
    assert out.columns == awkward.columns and out.dtypes == awkward.dtypes
    by_id = collections.defaultdict(list)
    for r in out.collect():
        by_id[r.doc_id].append(r.text)
        assert r.text is None or r.n_chars == len(r.text)
    assert by_id[10] == ["line a\nline b\n"] and by_id[3] == [""] and by_id[4] == [None] and by_id[5] == ["   \n\n "] and sorted(by_id[9]) == ["one", "two"]
    assert 1 not in by_id and 2 not in by_id  # the null id comes first and keeps the line


# ------------------------------------------------------------------------- 6 HTML

PAGE = "<html><head><title>T</title><style>p{}</style></head><body><nav><ul>" + "".join(f'<li><a href="/{i}">item {i}</a></li>' for i in range(12)) + "</ul></nav><article><h1>On rain</h1><p>" + " ".join(PROSE * 4) + "</p><p>" + " ".join(PROSE * 3) + " &amp; more</p></article><script>var x='<p>';</script><footer><a>x</a> <a>y</a></footer></body></html>"


def test_html_region():
    text, regions = html_extract.extract(PAGE)
    assert regions == 1 and "rain fell" in text and "& more" in text and "item 3" not in text and "var x" not in text


def test_smoothing_against_the_formula():
    values = np.random.default_rng(0).random(17) * 9
    for radius in (0, 1, 2, 5, 40):
        for i, got in enumerate(html_extract.smooth(values, radius, 1.5)):
            near = range(max(0, i - radius), min(17, i + radius + 1))
            w = [np.exp(-((j - i) ** 2) / (2 * 1.5**2)) for j in near]
            assert got == pytest.approx(sum(a * values[j] for a, j in zip(w, near)) / sum(w))


@pytest.mark.parametrize(
    "page, expected",
    [(None, None), ("", ("", 0)), ("<p></p>", ("", 0)), ("plain text", ("plain text", 1)), ("<p>open", ("open", 1)), ("a <![x y]> b", ("a ![x y]> b", 1)), ("<b>&lt;x&gt;", ("<x>", 1)), ("<script>never closed", ("", 0))],
)
def test_html_edges(page, expected):
    assert html_extract.extract(page) == expected


WORDS = " ".join(PROSE * 3)


@pytest.mark.parametrize(
    "page",
    [
        f"<html><head><title>x</title><p>{WORDS}</p></html>",
        f"<head><meta charset=utf-8><noscript><link href=x><p>{WORDS}</p>",
        f"<head><noscript><style>p{{}}</style><body><p>{WORDS}</p></body>",
        f"<body><select><option>one<p>{WORDS}</p></body>",
        f"<body><noscript><p>{WORDS}</p><select><option>a</select></body>",
        f"<body><object data=x><div><p>{WORDS}</p></div></body>",
        f"<head><template><p>never shown</p></template><svg><text>1</text></svg><p>{WORDS}</p>",
    ],
)
def test_unclosed_silent_elements_swallow_nothing(page):
    text, regions = html_extract.extract(page)
    assert WORDS in text and regions >= 1 and "never shown" not in text


@pytest.mark.parametrize("page", [f"<body><noscript><p>{WORDS}</p></noscript><p>x</p>", f"<p>x</p><object><select>{WORDS}</object>", f"<p>x</p><style>{WORDS}"])
def test_closed_silent_elements_stay_silent(page):
    assert WORDS not in html_extract.extract(page)[0]


def plain_extract(page):
    """Regular expressions and loops for well-formed pages."""
    page = re.sub(r"<!--.*?-->|<!doctype[^>]*>", "", page, flags=re.S | re.I)
    for tag in html_extract.SILENT:
        page = re.sub(rf"<{tag}\b[^>]*>.*?</{tag}\s*>", "", page, flags=re.S | re.I)
    rows, text, tags = [], "", 0

    def end():
        nonlocal text, tags
        if text.split() or tags:
            rows.append((" ".join(text.split()), tags))
        text, tags = "", 0

    for piece in re.findall(r"<[^>]*>|\n|[^<\n]+", page):
        if piece.startswith("<"):
            block = re.match(r"</?\s*(\w+)", piece)[1].lower() in html_extract.BLOCK
            if block and piece[1] != "/":
                end()
            tags += 1
            if block and piece[1] == "/":
                end()
        elif piece == "\n":
            if text.strip():
                end()
            text += " "
        else:
            text += html.unescape(piece)
    end()
    ratio = [math.log(1 + len(t) / max(1, n)) for t, n in rows]
    kernel = {k: math.exp(-k * k / 2) for k in range(-2, 3)}
    even = []
    for i in range(len(ratio)):
        near = [k for k in kernel if 0 <= i + k < len(ratio)]
        even.append(sum(kernel[k] * ratio[i + k] for k in near) / sum(kernel[k] for k in near))
    mean = sum(even) / max(1, len(even))
    cut = math.sqrt(sum((e - mean) ** 2 for e in even) / max(1, len(even)))
    return "\n".join(t for (t, _), r, e in zip(rows, ratio, even) if t and e >= cut and r >= cut)


def test_pages_against_plain_extraction(spark):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect()}
    rows = html_extract.query(spark, SMALL).collect()
    assert len(rows) == len(pages) and sum(r.text == plain_extract(pages[r.page_id]) for r in rows) == len(rows)


@given(st.text(alphabet="<>/!-[]?=\"' abp\n&;#", max_size=60))
def test_html_takes_anything(page):
    html_extract.extract(page)


def test_html_awkward(spark):
    pages = spark.createDataFrame([(1, PAGE, 2, "t"), (None, None, None, None), (2, "", 0, ""), (2, "", 0, ""), (3, "<p>" + "w " * 50_000, 1, "x")], "page_id long, html string, regions int, text string")
    rows = html_extract.extracted(pages).collect()
    assert len(rows) == 5 and [len(r.text) for r in rows if r.page_id == 3] == [99_999]
    assert html_extract.extracted(pages.limit(0)).count() == 0


# -------------------------------------------------------------- 7 substring dedup


def repeated_words(docs, size):
    seen, out = set(), set()
    for i, text in sorted(docs):
        words = text.split()
        for a in range(len(words) - size + 1):
            key = tuple(words[a : a + size])
            if key in seen:
                out.update((i, b) for b in range(a, a + size))
            seen.add(key)
    return out


@pytest.fixture(scope="module")
def passages():
    rng = random.Random(6)
    shared = [[f"p{j}_{i}" for i in range(rng.randint(20, 90))] for j in range(12)]
    docs = []
    for i in range(120):
        words = []
        for _ in range(rng.randint(0, 5)):
            words += [f"u{i}_{rng.random()}" for _ in range(rng.randint(0, 30))]
            if rng.random() < 0.6:
                p = rng.choice(shared)
                a = rng.randint(0, len(p) // 2)
                words += p[a : a + rng.randint(10, len(p))]
        words += ["x"] * (rng.randint(10, 200) if rng.random() < 0.1 else 0)
        docs.append((i, " ".join(words)))
    return docs


@pytest.mark.parametrize("batches", [1, 5])
def test_passages_against_brute_force(spark, passages, batches):
    rows = substring_dedup.repeats(spark.createDataFrame(passages, "doc_id long, text string"), batches).collect()
    assert {(r.doc_id, w) for r in rows for w in range(r.first, r.first + r.words)} == repeated_words(passages, 50)
    words = {i: t.split() for i, t in passages}
    for r in rows:
        assert words[r.doc_id][r["first"] : r["first"] + r.words] == words[r.from_id][r.from_first : r.from_first + r.words]
        assert (r.from_id, r.from_first) < (r.doc_id, r["first"])


def test_passages_where_texts_must_move(spark, passages, monkeypatch):
    monkeypatch.setattr(substring_dedup, "BROADCAST_ITEMS", -1)
    rows = substring_dedup.repeats(spark.createDataFrame(passages, "doc_id long, text string"), 2).collect()
    assert {(r.doc_id, w) for r in rows for w in range(r.first, r.first + r.words)} == repeated_words(passages, 50)


def test_an_index_goes_on_from_its_manifest(spark, passages, tmp_path):
    docs = spark.createDataFrame(passages, "doc_id long, text string")
    whole = {tuple(r) for r in substring_dedup.repeats(docs, 1).collect()}
    index, got = substring_dedup.Index(spark), set()
    for low, high in zip([0, 20, 40, 60, 80, 100], [20, 40, 60, 80, 100, 120]):
        part = docs.where(f"doc_id >= {low} and doc_id < {high}")
        got |= {tuple(r) for r in index.ingest(part, docs.where(f"doc_id < {low}") if low else None).collect()}
        index.save(str(tmp_path / "manifest"))
        names = [t[0] for runs in (index.anchor_runs, index.window_runs) for t in runs.tables]
        assert len(names) <= 2 * 2 * (substring_dedup.FANOUT - 1)
        for name in names:  # as in a session that knows no tables
            spark.sql(f"drop table {name}")
        index = substring_dedup.Index.open(spark, str(tmp_path / "manifest"))
    index.close()
    words = lambda rows: {(r[0], w) for r in rows for w in range(r[1], r[1] + r[2])}
    assert words(got) == words(whole) == repeated_words(passages, 50)


def test_anchors_hit_every_passage():
    rng = np.random.default_rng(7)
    passage = rng.integers(1, 1 << 62, 50).astype(np.uint64)
    for _ in range(50):
        chosen = []
        for _ in range(2):
            before = rng.integers(1, 1 << 62, rng.integers(0, 60)).astype(np.uint64)
            _, hashes = substring_dedup.anchors(np.concatenate([before, passage, rng.integers(1, 1 << 62, rng.integers(0, 60)).astype(np.uint64)]))
            chosen.append(set(hashes.tolist()))
        assert chosen[0] & chosen[1]


@pytest.mark.parametrize("words", [1, 300, 1 << 20])
def test_documents_are_searched_together_as_alone(monkeypatch, words):
    """Groups of documents give what each gives alone, and no memo of words is kept."""
    import pyarrow as pa

    rng = random.Random(17)
    texts = ["", "a", *(" ".join(rng.choices("abcd", k=n)) for n in (*range(4, 9), 0, 60, 200)), "a b " * 40, ""]
    ids = [7 * i for i in range(len(texts))]
    monkeypatch.setattr(substring_dedup, "WORDS", words)
    batch = pa.record_batch({"doc_id": pa.array(ids, pa.int64()), "text": texts})
    got = [(r["doc_id"], r["h"]) for b in substring_dedup._fingerprints(3, 6)(iter([batch])) for r in b.to_pylist()]
    prints, windows, asked = [], [], []
    for i, text in zip(ids, texts):
        h = substring_dedup.word_hashes(text.split())
        places, found = substring_dedup.anchors(h, 3, 6)
        found = found.view(np.int64).tolist()
        prints += [(i, x) for x in set(found)] + [(i, x) for x in set(found) if found.count(x) > 1]
        asked.append(sorted(set(found))[::2])
        near = {w for p, x in zip(places, found) if x in asked[-1] for w in range(max(p - 3, 0), min(p + 1, len(h) - 5))}
        whole = substring_dedup.window_hashes(h, 6).view(np.int64).tolist()
        windows += [(i, w, whole[w], i % 2 == 0) for w in near]
    assert sorted(got) == sorted(prints)
    batch = pa.record_batch({"doc_id": batch.column(0), "text": batch.column(1), "own": pa.array([i % 2 == 0 for i in ids]), "hs": pa.array(asked, pa.list_(pa.int64()))})
    rows = [(r["doc_id"], r["place"], r["h"], r["own"]) for b in substring_dedup._windows(3, 6)(iter([batch])) for r in b.to_pylist()]
    assert sorted(rows) == sorted(windows) and windows
    assert "substring_dedup" not in {memo.owner for memo in common._MEMOS}


def test_passages_awkward(awkward, empty):
    assert substring_dedup.repeats(empty).count() == 0
    rows = substring_dedup.repeats(awkward)
    got = {(r.doc_id, r.from_id) for r in rows.collect()}
    assert (2, 1) in got and (7, 1) in got and not {3, 4, 5, None} & {a for a, _ in got}


# ---------------------------------------------------------------- 8 quality rules


def test_mcd_against_plain_numpy(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(600, quality_rules.DIM)) @ rng.normal(size=(quality_rules.DIM, quality_rules.DIM)) + 5
    x[:120] += 40
    rows = spark.createDataFrame([("k", v.tolist()) for v in x], "key string, x array<double>")
    got = quality_rules.fit(rows)["k"]
    # C-steps by hand from the same start, with exact order statistics
    centre, scale = np.median(x, 0), np.maximum((np.percentile(x, 75, axis=0) - np.percentile(x, 25, axis=0)) / 1.349, quality_rules.FLOOR)
    z = (x - centre) / scale
    z /= np.maximum(np.sqrt((z**2).sum(1, keepdims=True)), 1e-9)
    own = quality_rules.Estimate(centre, z.T @ z / len(z) * quality_rules.DIM, scale)
    for _ in range(40):
        d = own.distance(x)
        inner = x[np.argsort(d)[: int(0.7 * len(x))]]
        own = quality_rules.Estimate(inner.mean(0), np.cov((inner / scale).T, bias=True), scale)
    assert np.abs((got.centre - own.centre) / scale).max() < 0.1
    assert got.distance(x)[:120].min() > got.distance(x)[120:].max()


def test_chi_squared():
    assert common.chi2_quantile(0.95, 1) == pytest.approx(3.8415, abs=1e-3) and common.chi2_quantile(0.99, 8) == pytest.approx(20.0902, abs=1e-3)


def test_rules_awkward(spark, awkward, empty):
    assert quality_rules.kept(empty).count() == 0
    rows = quality_rules.distances(awkward).collect()
    assert len(rows) == awkward.count()
    assert {r.doc_id for r in rows if r.distance is not None} == {None, 1, 2, 6, 7, 8, 9, 10}
    assert {r.doc_id for r in rows if r.distance is None} == {None, 3, 4, 5}


def test_a_group_is_drawn_to_its_language_by_its_size():
    one = lambda c, n: quality_rules.Estimate(np.full(quality_rules.DIM, c), np.eye(quality_rules.DIM), np.ones(quality_rules.DIM), n)
    for n, share in ((0, 0.0), (100, 0.5), (300, 0.75), (1e12, 1.0)):
        pool = quality_rules.Pool(one(4.0, n), quality_rules.Pool(one(0.0, 5), None, 100), 100)
        assert pool.distance(np.zeros((1, quality_rules.DIM)))[0] == pytest.approx(quality_rules.DIM * 16 * share / 1.05)


def test_rules_query_against_plain_numpy(spark):
    """All of sf0.001: estimates with exact order statistics, blended and applied row by row."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    by = collections.defaultdict(list)
    for r in docs:
        if r.text and (x := quality_rules.statistics(r.text)):
            for key in ((r.lang or "", r.source or ""), (r.lang or "",), ()):
                by[key].append(x)

    def estimate(x):
        centre, scale = np.median(x, 0), np.maximum((np.percentile(x, 75, axis=0) - np.percentile(x, 25, axis=0)) / 1.349, quality_rules.FLOOR)
        z = (x - centre) / scale
        z /= np.maximum(np.sqrt((z**2).sum(1, keepdims=True)), 1e-9)
        own = quality_rules.Estimate(centre, z.T @ z / len(z) * quality_rules.DIM, scale)
        for _ in range(60):
            inner = x[np.argsort(own.distance(x))[: max(1, int(np.ceil(quality_rules.SUPPORT * len(x))))]]
            own = quality_rules.Estimate(inner.mean(0), np.cov((inner / scale).T, bias=True).reshape(quality_rules.DIM, -1), scale, len(x))
        own.inverse = np.linalg.inv(own.cov * quality_rules.SUPPORT / common.gamma_p(quality_rules.DIM / 2 + 1, common.chi2_quantile(quality_rules.SUPPORT, quality_rules.DIM) / 2))
        return own

    plain = {k: estimate(np.array(x)) for k, x in by.items()}
    spoken = {k: quality_rules.Pool(e, plain[()], quality_rules.PRIOR) for k, e in plain.items() if len(k) == 1}
    cut = common.chi2_quantile(quality_rules.CUT, quality_rules.DIM)
    expected = {}
    for r in docs:
        if r.text and (x := quality_rules.statistics(r.text)):
            key = (r.lang or "", r.source or "")
            expected[r.doc_id] = quality_rules.Pool(plain[key], spoken[key[:1]], quality_rules.PRIOR).distance(np.array([x]))[0]
    got = {r.doc_id: r.distance for r in quality_rules.distances(spark.read.parquet(f"{SMALL}/documents.parquet")).where("distance is not null").collect()}
    assert got.keys() == expected.keys()
    # quantiles are binned in the query, so sets may differ by a row
    near = [i for i in got if abs(np.log(got[i] + 1) - np.log(expected[i] + 1)) < 0.25]
    assert len(near) >= 0.95 * len(got)
    assert sum((got[i] <= cut) != (expected[i] <= cut) for i in got) <= 0.02 * len(got)


def test_rules_reject_junk(spark):
    rng = random.Random(9)
    rows = [row(i, prose(rng, rng.randint(30, 300)) + ".", "en", f"s{i % 3}") for i in range(900)]
    junk = [row(1000 + i, " ".join(w + "$%&#" for w in prose(rng, 60).split())) for i in range(20)] + [row(2000 + i, "spam " * 90) for i in range(20)]
    kept = {r.doc_id for r in quality_rules.kept(spark.createDataFrame(rows + junk, COLUMNS)).collect()}
    assert len(kept & set(range(900))) >= 890 and not kept - set(range(900))


# ----------------------------------------------------------- 9 quality classifier


def test_ranking_on_held_out_documents(spark):
    rng = random.Random(10)
    good = lambda: prose(rng, rng.randint(20, 200))
    bad = lambda: " ".join(rng.choice(["buy", "now", "cheap", "win", *PROSE[:5]]) for _ in range(rng.randint(20, 200)))
    texts = [(i, good() if i % 3 else bad()) for i in range(900)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    known = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(450)], "doc_id long, quality int, toxic int")
    kept = {r.doc_id for r in quality_classifier.classify(docs, known, quantile=0.01).where("doc_id >= 450").collect()}
    fine = {i for i in range(450, 900) if i % 3}
    assert len(kept & fine) >= 0.97 * len(fine) and len(kept - fine) <= 3


def test_ranking_awkward(spark, awkward, empty, labels):
    assert quality_classifier.classify(empty, labels).count() == 0
    kept = quality_classifier.classify(awkward, labels)
    assert kept.columns == awkward.columns and not {3, 4, 5} & {r.doc_id for r in kept.collect()}
    unlabelled = quality_classifier.classify(awkward, labels.limit(0))
    assert unlabelled.count() == awkward.where("trim(translate(text, '\n', ' ')) <> ''").count()
    assert set(quality_classifier.ranked(awkward, labels).columns) == {"doc_id", "score"}


def test_ranking_fit_against_plain_loops():
    """The same pairs, one slot at a time."""
    rng = random.Random(13)
    texts = [prose(rng, rng.randint(5, 40)) + (" cheap cheap win" if i % 3 == 0 else " odious" if i % 3 == 1 else "") for i in range(60)]
    grade = np.array([i % 3 for i in range(60)])
    got = quality_classifier.fit(texts, grade, 0.05, seed=3, epochs=1, pairs_per_epoch=640, min_documents=2)
    draw = np.random.default_rng(3)
    dense, slots = quality_classifier.featurise(texts)
    x = (dense - dense.mean(0)) / (dense.std(0) + 1e-6)
    held = quality_classifier.hold_out(grade, draw)
    assert [int(held[grade == k].sum()) for k in range(3)] == [5, 5, 5]
    train = [i for i in range(60) if not held[i]]
    seen = collections.Counter(s for i in train for s in slots[i])
    slots = [[s for s in row if seen[s] >= 2] for row in slots]
    good, bad = [i for i in train if grade[i] == 2], [[i for i in train if grade[i] == k] for k in (0, 1)]
    wd, gd, ww, gw = np.zeros(x.shape[1]), np.full(x.shape[1], 1e-8), collections.defaultdict(float), collections.defaultdict(lambda: 1e-2)
    for _ in range(10):
        a = draw.choice(good, 64)
        b = [bad[k][draw.integers(len(bad[k]))] for k in draw.integers(0, 2, 64)]
        step, stepd = collections.defaultdict(float), -1e-5 * wd
        for i, j in zip(a, b):
            margin = (x[i] - x[j]) @ wd + sum(ww[s] for s in slots[i]) - sum(ww[s] for s in slots[j])
            pull = 1 / (1 + math.exp(margin))
            stepd = stepd + (x[i] - x[j]) * pull / 64
            for s in slots[i]:
                step[s] += pull / 64
            for s in slots[j]:
                step[s] -= pull / 64
        gd += stepd**2
        wd = wd + 0.15 * stepd / np.sqrt(gd)
        for s, v in step.items():
            v -= 1e-5 * ww[s]
            gw[s] += v * v
            ww[s] += 0.075 * v / math.sqrt(gw[s])
    assert got.dense == pytest.approx(wd, abs=1e-8)
    assert got.words[sorted(ww)] == pytest.approx([ww[s] for s in sorted(ww)], abs=1e-6) and np.count_nonzero(got.words) <= len(ww)
    scores = [x[i] @ wd + sum(ww[s] for s in slots[i]) for i in range(60) if held[i] and grade[i] == 2]
    assert got.threshold == pytest.approx(np.quantile(scores, 0.05), abs=1e-6)


def test_ranking_query_against_plain_scores(spark):
    """Every document of sf0.001, scored one by one by the model of the same labels."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    grades = {}
    for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect():
        grades[r.doc_id] = min(grades.get(r.doc_id, 2), 0 if r.quality == 0 else 1 if r.toxic else 2)
    texts = {r.doc_id: r.text for r in docs.collect()}
    known = sorted(i for i in grades if texts.get(i) is not None)
    model = quality_classifier.fit([texts[i] for i in known], np.array([grades[i] for i in known]), 0.005)
    expected = {}
    for i, text in texts.items():
        if text and text.strip():
            dense, slots = quality_classifier.featurise([text])
            score = float(((dense[0] - model.mean) / model.scale) @ model.dense) + sum(float(model.words[s]) for s in slots[0])
            toxic = sum(w for m, w in model.toxicity.weights.items() if m in set(quality_classifier.marks(text)))
            if score >= model.threshold and toxic >= model.toxicity.threshold:
                expected[i] = score
    got = {r.doc_id: r.score for r in quality_classifier.query(spark, SMALL).collect()}
    assert got.keys() == expected.keys() and all(abs(got[i] - expected[i]) < 1e-3 for i in got)


@pytest.mark.parametrize("n", [1, 2, 3, 5])
def test_ranking_with_few_labels(n):
    """No number of labels switches the ranking off but none of a kind."""
    texts = [f"good words here {i}" for i in range(n)] + [f"cheap win now {i}" for i in range(n)]
    model = quality_classifier.fit(texts, np.array([2] * n + [0] * n), 0.0, epochs=1, min_documents=1)
    score = model.score(["good words here", "cheap win now"])
    assert score[0] > score[1]


def test_ranking_is_fitted_on_every_labelled_row(spark):
    """Parts of 60 rows: scales, marks and cuts are those of all 300."""
    rng = random.Random(15)
    texts = [prose(rng, rng.randint(20, 60)) + (" cheap cheap win" if i % 3 == 0 else " odious" if i % 9 == 1 else " vile" if i % 3 == 1 else "") for i in range(300)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(7, texts[7] + " again")], "doc_id long, text string").repartition(3)
    known = spark.createDataFrame([(i, int(i % 3 > 0), int(i % 3 == 1)) for i in range(300)], "doc_id long, quality int, toxic int")
    model = quality_classifier.fit_on_tables(docs, known, 0.05, 60)
    dense, _ = quality_classifier.featurise(texts)
    assert model.mean == pytest.approx(dense.mean(0)) and model.scale == pytest.approx(dense.std(0) + 1e-6)
    # a part has too few of them to tell them from chance
    assert {("odious", 0), ("vile", 0)} <= model.toxicity.weights.keys()
    kept = model.score(texts) >= model.threshold
    assert kept[2::3].mean() >= 0.9 and kept[0::3].mean() <= 0.05 and kept[1::3].mean() <= 0.05
    again = quality_classifier.fit_on_tables(docs.repartition(5), known, 0.05, 60)
    assert (again.words == model.words).all() and again.threshold == model.threshold and again.toxicity.weights == model.toxicity.weights


def test_ranking_parts_travel_in_pieces(monkeypatch):
    """No value holds a whole part, and the pieces with some marks' rows make the part again."""
    monkeypatch.setattr(quality_classifier, "PIECE", 1000, raising=False)
    rng = random.Random(16)
    texts = [prose(rng, rng.randint(20, 60)) + f" own{i} own{i + 1}" for i in range(200)]
    ids = rng.sample(range(1000), 200)
    rows = [(i, t, i % 3) for i, t in zip(ids, texts)] + [(ids[5], "~ later text", ids[5] % 3)]
    table = pa.table({"part": [4] * 201, "doc_id": [r[0] for r in rows], "text": [r[1] for r in rows], "grade": pa.array([r[2] for r in rows], pa.int32())})
    read = quality_classifier._read_part(0)(table).drop_columns("summary").to_pylist()
    assert max(len(v) for r in read for v in r.values() if isinstance(v, bytes)) <= 1000
    order = sorted(range(200), key=lambda k: ids[k])
    whole = quality_classifier.Part([texts[k] for k in order], np.array([ids[k] % 3 for k in order]), [0, 2, 4])
    pieces = [r["content"] for r in sorted((r for r in read if r["mark"] is None), key=lambda r: r["piece"])]
    some = {r["mark"]: r["content"] for r in read if r["mark"] is not None and hash(r["content"]) % 2}
    part = quality_classifier.Part.unpacked(pieces, some)
    assert len(pieces) > 1 and (part.grade == whole.grade).all() and (part.held == whole.held).all() and (part.dense == whole.dense).all() and part.seed == whole.seed
    of = lambda p, i: {p.names[m] for m in p.marks.of(np.array([i]))[0]}
    for i in range(200):
        assert (part.slots.of(np.array([i]))[0] == whole.slots.of(np.array([i]))[0]).all() and of(part, i) == of(whole, i) & some.keys()


def test_labelling_bounds_hold_on_rows(spark):
    """An id on 3,000 rows is one document, and which text is its own doesn't hang on their order."""
    rows = [(1, f"text {i}", "en") for i in range(3000)] + [(i, f"other {i}", "fr") for i in range(2, 40)]
    known = spark.createDataFrame([(i, i % 2, 0) for i in range(1, 40)], "doc_id long, quality int, toxic int")
    found = []
    for order in (rows, rows[::-1]):
        docs = spark.createDataFrame(order, "doc_id long, text string, lang string").repartition(3)
        one, two = (t.collect() for t in (quality_classifier.sample(docs, known, 10), language_id.sample(docs, 10)))
        assert len(one) <= 10 and len(two) <= 10
        found.append((sorted(map(tuple, one)), sorted(map(tuple, two))))
        every = quality_classifier.sample(docs, known, 100).where("doc_id = 1").collect()
        assert [tuple(r) for r in every] == [(1, "text 0", 2)] and [tuple(r) for r in language_id.sample(docs, 10).where("doc_id = 1").collect()] == [(1, "en", "text 0")]
    assert found[0] == found[1]


# ------------------------------------------------------------------ 10 language ID

SPEECH = {"en": "the quick brown fox jumps over the lazy dog and then it sleeps", "fr": "le renard brun saute par dessus le chien paresseux et puis il dort", "de": "der schnelle braune fuchs springt über den faulen hund und schläft dann"}


def test_scores_against_direct_sums():
    model = language_id.fit(list(SPEECH.values()), list(SPEECH))
    texts = ["le chien dort", "", "the dog", "über " * 3, "x" * 300_000]
    score, count = model.score(texts)
    for text, s, n in zip(texts, score, count):
        columns = np.concatenate([*language_id.slots(text), np.zeros(0, np.int32)])
        assert n == len(columns)
        assert s == pytest.approx(model.weights[columns].astype(float).sum(0) + model.prior, rel=1e-6)


def test_language_fit_against_counts():
    model = language_id.fit(list(SPEECH.values()) + ["dog"], [*SPEECH, "en"], smoothing=0.5)
    counts = {k: collections.Counter() for k in SPEECH}
    for text, k in zip([*SPEECH.values(), "dog"], [*SPEECH, "en"]):
        for part in language_id.slots(text):
            counts[k].update(part.tolist())
    assert model.languages == sorted(SPEECH)
    for j, k in enumerate(model.languages):
        total = sum(counts[k].values()) + 0.5 * language_id.SLOTS
        assert model.weights[:, j] == pytest.approx([math.log((counts[k][c] + 0.5) / total) for c in range(language_id.SLOTS)], rel=1e-5)


def test_language_query_against_plain_sums(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    named = [r for r in docs if r.lang is not None and r.text is not None]
    model = language_id.fit([r.text for r in named], [r.lang for r in named])
    got = {r.doc_id: (r.language, r.margin) for r in language_id.query(spark, SMALL).collect()}
    assert len(got) == len(docs)
    for r in docs:
        parts = np.concatenate([*language_id.slots(r.text or ""), np.zeros(0, np.int32)])
        if not len(parts):
            assert got[r.doc_id] == (None, None)
            continue
        score = model.weights[parts].astype(float).sum(0)
        first, second = sorted(score)[::-1][:2]
        assert got[r.doc_id][0] == model.languages[int(score.argmax())] and got[r.doc_id][1] == pytest.approx((first - second) / len(parts), abs=2e-6)


def test_long_texts_are_whole(monkeypatch):
    text = prose(random.Random(11), 500)
    whole = np.bincount(np.concatenate(list(language_id.slots(text))), minlength=language_id.SLOTS)
    monkeypatch.setattr(language_id, "CHUNK", 64)
    assert (np.bincount(np.concatenate(list(language_id.slots(text))), minlength=language_id.SLOTS) == whole).all()


def test_language_awkward(spark, awkward, empty):
    model = language_id.fit(list(SPEECH.values()), list(SPEECH))
    rows = language_id.identify(awkward, model).collect()
    assert len(rows) == awkward.count() and {r.language for r in rows if r.doc_id in (3, 4, 5)} == {None}
    assert {r.language for r in rows if r.doc_id in (1, 6)} == {"en"}
    assert language_id.identify(empty, model).count() == 0
    none = language_id.fit_on_table(empty)
    assert none.languages == [] and {r.language for r in language_id.identify(awkward, none).collect()} == {None}
    one = language_id.fit(["abc"], ["en"])
    assert {r.margin for r in language_id.identify(awkward, one).collect()} == {None, 0.0}
