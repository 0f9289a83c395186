import json
import random
import threading
import urllib.parse
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from termweave import wordlists
from termweave.operators import embed, fuzzy
from termweave.operators.recognizer import lower_recognizer
from termweave.sources import brat, dictionary, enrichment, files, rdf, sparql
from termweave.streaming.annotate import annotate_stream, parquet_sink


def rows_of(table, *columns):
    return sorted(tuple(r) for r in table.select(*columns).collect())


def test_tsv(spark, tmp_path):
    (tmp_path / "d.tsv").write_text('a\tfirst\nb\tNA\na\t"second"\n')
    labels = dictionary.read_tsv(spark, str(tmp_path / "d.tsv"))
    assert rows_of(labels, "concept_id", "label_index", "label") == [("a", 0, "first"), ("a", 1, '"second"'), ("b", 0, "NA")]
    assert rows_of(dictionary.read_tsv(spark, str(tmp_path / "d.tsv"), header=True), "concept_id", "label") == [("a", '"second"'), ("b", "NA")]
    dictionary.write_tsv(dictionary.from_rows(spark, [("z", "one"), ("a", "two"), ("z", "three")]), str(tmp_path / "order"))
    assert [r.value for r in spark.read.text(str(tmp_path / "order")).collect()] == ["z\tone", "z\tthree", "a\ttwo"]
    dictionary.write_tsv(labels, str(tmp_path / "out"))
    assert rows_of(dictionary.read_tsv(spark, str(tmp_path / "out")), "concept_id", "label_index", "label") == rows_of(labels, "concept_id", "label_index", "label")


def test_dictionary(spark):
    labels = dictionary.from_rows(spark, [("x", "one"), ("y", "one"), ("x", "two")])
    entries = {r.id: (r.label, r.synonyms) for r in dictionary.concepts(labels).collect()}
    assert entries == {"x": ("one", ["two"]), "y": ("one", [])}
    assert rows_of(dictionary.reverse_index(labels), "label", "concept_id") == [("one", "y")]
    # the concept loaded last wins, whatever its id
    assert rows_of(dictionary.reverse_index(dictionary.from_rows(spark, [("z", "one"), ("a", "one")])), "label", "concept_id") == [("one", "a")]
    assert dictionary.size(labels).first()[0] == 2
    assert dictionary.lookup(dictionary.concepts(labels), "q").count() == 0
    more = dictionary.add_labels(dictionary.concept_index(labels), spark.createDataFrame([("x", "three")], "concept_id string, label string"))
    assert dict(more.collect())["x"] == ["one", "three", "two"]
    shown = labels.limit(1).select(dictionary.display_concept(F.array(F.lit("b"), F.lit("a")), F.lit("d"))).first()[0]
    assert shown == "a, b | d"


def test_word_lists(spark, tmp_path):
    (tmp_path / "w.txt").write_text("the \nof\n\nthe\n")
    assert wordlists.load_word_list(spark, str(tmp_path / "w.txt")) == ["of", "the"]
    assert len(wordlists.STOP["en"]) == 17 and {"he", "the"} == set(wordlists.STOP["en"]) & set(wordlists.TERMINATION["en"])


def test_brat(spark, tmp_path):
    rows = spark.createDataFrame([(2, "http://x/c_1", "b"), (1, "http://x/c_1", "a"), (3, "plain", "z")], "ord long, concept_id string, label string")
    assert [r.line for r in brat.lines(rows).collect()] == ["1\tname:Name:a\tname:Name:b"]
    brat.write(rows, str(tmp_path / "db"), remove_uris=False)
    assert sorted(r.value.split("\t")[0] for r in spark.read.text(str(tmp_path / "db")).collect()) == ["http://x/c_1", "plain"]


def test_ntriples(spark, tmp_path):
    (tmp_path / "t.nt").write_text(
        f'<http://x/1> <{rdf.TYPE}> <{rdf.CONCEPT}> .\n# note\n<http://x/1> <{rdf.SKOS}prefLabel> "caf\\u00E9 \\"x\\""@fr .\n'
        f'<http://x/1> <{rdf.SKOS}altLabel> "bar"@fr .\n<http://x/1> <{rdf.SKOS}altLabel> "pub"@en .\n<http://x/2> <{rdf.SKOS}prefLabel> "untyped"@fr .\n'
        f'<http://x/1> <{rdf.SKOS_XL}prefLabel> _:n .\n_:n <{rdf.SKOS_XL}literalForm> "xl"@fr .\n'
    )
    triples = rdf.read_ntriples(spark, str(tmp_path / "t.nt"))
    assert triples.count() == 7
    plain = dictionary.index_labels(rdf.dictionary_rows(triples, "fr", xl=False))
    assert rows_of(plain, "concept_id", "label_index", "label") == [("http://x/1", 0, 'café "x"'), ("http://x/1", 1, "bar")]
    assert rows_of(rdf.dictionary_rows(triples, "fr"), "label") == [("xl",)]
    assert rows_of(rdf.dictionary_rows(triples, "fr", same_alternatives=True), "label") == [("xl",), ("xl",)]


class Endpoint(BaseHTTPRequestHandler):
    rows = [{"x": {"value": f"http://x/{i:03}"}, "lf": {"value": f"label {i}"}} for i in range(25)]
    asked: list = []

    def do_GET(self):
        query = urllib.parse.parse_qs(urllib.parse.urlparse(self.path).query)["query"][0]
        self.asked.append(query)
        if "count(" in query:
            found = [{"count": {"value": "0" if "altLabel" in query else str(len(self.rows))}}]
        else:
            words = query.split()
            limit, offset = (int(words[words.index(w) + 1]) for w in ("LIMIT", "OFFSET"))
            found = self.rows[offset : offset + limit]
        body = json.dumps({"results": {"bindings": found}}).encode()
        self.send_response(200)
        self.end_headers()
        self.wfile.write(body)

    def log_message(self, *_):
        pass


@pytest.fixture
def endpoint():
    server = HTTPServer(("127.0.0.1", 0), Endpoint)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    Endpoint.asked.clear()
    yield f"http://127.0.0.1:{server.server_port}/sparql"
    server.shutdown()


def test_sparql(spark, endpoint, tmp_path):
    options = {"page_size": 10, "select": "?x ?lf", "cache": str(tmp_path)}
    rows = sparql.fetch_all(spark, endpoint, "?x ?p ?lf", **options)
    assert rows.count() == 25 and rows.distinct().count() == 25
    pages = {q for q in Endpoint.asked if "OFFSET" in q}
    assert len(pages) == 3 and all("ORDER BY ?x ?lf" in q and q.startswith("define sql:big-data-const 0") for q in pages)
    before = len(Endpoint.asked)
    assert sparql.fetch_all(spark, endpoint, "?x ?p ?lf", **options).count() == 25
    assert all("OFFSET" not in q for q in Endpoint.asked[before:])
    found = dictionary.index_labels(sparql.skos_dictionary_rows(spark, endpoint, "en", page_size=10, graph="http://g"))
    assert found.count() == 25 and any("FROM <http://g>" in q for q in Endpoint.asked)


def test_command_line(spark, endpoint, tmp_path):
    from termweave.__main__ import main

    main(["build-dictionary", "--endpoint", endpoint, "--output", str(tmp_path / "d"), "--language", "en"])
    assert spark.read.text(str(tmp_path / "d")).count() == 25


def test_enrichment(spark):
    reply = {"collection": [{"@id": "m1", "cui": ["C1"], "semanticType": ["T1"], "synonym": ["s"]}, {"@id": "m2", "semanticType": ["T2"], "synonym": ["no"]}, {"@id": "m3", "cui": ["C2", "C1"], "synonym": ["no"]}]}
    replies = spark.createDataFrame([("a", json.dumps(reply)), ("b", '{"collection": []}')], "concept_id string, json string")
    concepts = spark.createDataFrame([("a", "x", ["old"]), ("b", "y", ["old"])], "id string, label string, cuis array<string>")
    got = {r.id: r for r in enrichment.enrich(concepts, replies).collect()}
    assert (got["a"].mappings, got["a"].cuis, got["a"].tuis, got["a"].synonyms) == (["m1", "m2", "m3"], ["C1", "C2"], ["T1"], ["s"])
    assert (got["b"].mappings, got["b"].cuis) == (None, ["old"])
    assert {r.concept_id: r.mappings for r in enrichment.merged(replies, 1).collect()} == {"a": ["m1"]}


def test_fuzzy_against_brute_force(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abc") for _ in range(rng.randint(1, 7)))
    names = sorted({" ".join(word() for _ in range(rng.randint(1, 2))) for _ in range(40)})
    labels = fuzzy.fuzzy_labels(dictionary.from_rows(spark, list(enumerate(names))))
    strings = sorted({" ".join(word() for _ in range(rng.randint(1, 2))) for _ in range(150)})
    got = fuzzy.similar(spark.createDataFrame([(s,) for s in strings], "window string"), labels).collect()

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            before, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
        return row[-1]

    want = {(s, n, d) for s in strings for n in names if (d := distance(s, n)) <= 2}
    assert {(r.window, r.normalized, r.distance) for r in got} == want and len(got) == len(want)


def test_embedding_index(spark):
    def make():
        import numpy as np

        return lambda labels: [(label.split(), np.array([[len(w), 1.0] for w in label.split()], np.float32)) for label in labels]

    embedded = embed.embed_labels(dictionary.from_rows(spark, [("a", "red fox"), ("a", "foxes"), ("b", "red")]), make, batch_size=2)
    pooled = {(r.concept_id, r.label_index): r.pooled for r in embedded.collect()}
    assert pooled["a", 0] == [3.0, 1.0] and pooled["a", 1] == [5.0, 1.0]
    by_token = {r.token: r.vectors for r in embed.concept_vectors(embed.token_index(embedded)).collect()}
    assert by_token["red"] == {"a": [3.0, 1.0], "b": [3.0, 1.0]}


def test_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("one\ntwo")
    texts = files.read_texts(spark, str(tmp_path / "in"))
    assert texts.first().text == "one\ntwo"
    first = files.save_once(spark.range(3), str(tmp_path / "t"))
    assert first.count() == 3 and files.save_once(spark.range(9), str(tmp_path / "t")).count() == 3


def test_stream(spark, tmp_path):
    spark.createDataFrame([(i, "red fox") for i in range(6)], "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("doc_id long, text string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    own = lower_recognizer(dictionary.from_rows(spark, [(1, "red fox")]))
    annotate_stream(stream, own, parquet_sink(str(tmp_path / "out"))).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    assert rows_of(spark.read.parquet(str(tmp_path / "out")), "doc_id") == [(i,) for i in range(6)]
