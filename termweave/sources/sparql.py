"""SPARQL endpoints as a Python data source: one partition per page.

    spark.dataSource.register(SparqlSource)
    spark.read.format("sparql").options(endpoint=..., where="?x ?p ?lf", select="?x ?lf").load()

Pages are ordered by the selected columns, so they neither overlap nor skip.
"""

from __future__ import annotations

import json
import urllib.parse
import urllib.request
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StringType, StructField, StructType

from .web import fetch

PAGE = 9000


class Page(InputPartition):
    def __init__(self, offset: int, limit: int):
        super().__init__(offset)
        self.offset, self.limit = offset, limit


def ask(endpoint: str, query: str, timeout: float, tries: int = 3) -> dict:
    """The JSON reply to a query; an empty reply has no bindings."""
    url = endpoint + ("&" if "?" in endpoint else "?") + urllib.parse.urlencode({"query": query, "format": "application/sparql-results+json"})
    request = urllib.request.Request(url, headers={"Accept": "application/sparql-results+json"})
    body = fetch(request, timeout, tries)
    return json.loads(body) if body.strip() else {"results": {"bindings": []}}


class SparqlReader(DataSourceReader):
    def __init__(self, options: dict):
        self.endpoint, self.where = options["endpoint"], options["where"]
        self.columns = options.get("select", "?x ?lf").split()
        self.graph, self.prefixes = options.get("from", ""), options.get("prefixes", "")
        self.size, self.timeout = int(options.get("page_size", PAGE)), float(options.get("timeout", 0))
        self.pragma = options.get("pragma", "define sql:big-data-const 0")

    def _from(self) -> str:
        return f"FROM <{self.graph}>" if self.graph else ""

    def count_query(self) -> str:
        inner = f"SELECT DISTINCT {' '.join(self.columns)} {self._from()} WHERE {{ {self.where} }}"
        return f"{self.pragma} {self.prefixes} SELECT (count(*) AS ?count) WHERE {{ {{ {inner} }} }}".strip()

    def page_query(self, page: Page) -> str:
        names = " ".join(self.columns)
        return f"{self.pragma} {self.prefixes} SELECT DISTINCT {names} {self._from()} WHERE {{ {self.where} }} ORDER BY {names} LIMIT {page.limit} OFFSET {page.offset}".strip()

    def count(self) -> int:
        rows = ask(self.endpoint, self.count_query(), self.timeout)["results"]["bindings"]
        return int(rows[0]["count"]["value"]) if rows else 0

    def partitions(self) -> list[Page]:
        return [Page(at, self.size) for at in range(0, self.count(), self.size)] or [Page(0, 0)]

    def read(self, partition: Page) -> Iterator[tuple]:
        if not partition.limit:
            return
        for row in ask(self.endpoint, self.page_query(partition), self.timeout)["results"]["bindings"]:
            yield tuple(row.get(c.lstrip("?"), {}).get("value") for c in self.columns)


class SparqlSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sparql"

    def schema(self) -> StructType:
        return StructType([StructField(c.lstrip("?"), StringType()) for c in self.options.get("select", "?x ?lf").split()])

    def reader(self, schema: StructType) -> SparqlReader:
        return SparqlReader(dict(self.options))


def fetch_all(spark: SparkSession, endpoint: str, where: str, cache: str | None = None, **options) -> DataFrame:
    """All pages. ``cache`` is a shared folder: a query already there isn't asked again."""
    spark.dataSource.register(SparqlSource)
    reader = spark.read.format("sparql").options(endpoint=endpoint, where=where, **{k: str(v) for k, v in options.items()})
    rows = reader.load()
    if cache is None:
        return rows
    import hashlib

    key = hashlib.sha256(repr((endpoint, where, sorted(options.items()))).encode()).hexdigest()
    path = f"{cache.rstrip('/')}/sparql-{key}"
    rows.write.mode("ignore").parquet(path)
    return spark.read.parquet(path)


def skos_where(language: str, kind: str, xl: bool) -> str:
    """Graph pattern for ``kind`` ('prefLabel' or 'altLabel') labels."""
    from .rdf import CONCEPT, SKOS, SKOS_XL

    typed = f"?x a <{CONCEPT}> . "
    named = f"?x <{SKOS_XL}{kind}> ?node . ?node <{SKOS_XL}literalForm> ?lf . " if xl else f"?x <{SKOS}{kind}> ?lf . "
    return typed + named + f'FILTER(lang(?lf) = "{language}")'


def skos_dictionary_rows(spark: SparkSession, endpoint: str, language: str = "fr", xl: bool = True, graph: str = "", page_size: int = PAGE) -> DataFrame:
    """(ord, concept_id, label) of an endpoint's thesaurus."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    parts = []
    for kind, name in enumerate(("prefLabel", "altLabel")):
        rows = fetch_all(spark, endpoint, skos_where(language, name, xl), select="?x ?lf", page_size=page_size, **({"from": graph} if graph else {}))
        parts.append(rows.select(F.lit(kind).alias("kind"), "x", "lf"))
    order = Window.partitionBy("x").orderBy("kind", "lf")
    return parts[0].unionByName(parts[1]).select(F.row_number().over(order).cast("long").alias("ord"), F.col("x").alias("concept_id"), F.col("lf").alias("label"))
