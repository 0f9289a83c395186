"""python -m termweave build-dictionary: a dictionary from a SPARQL endpoint."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from .sources import brat, dictionary, rdf, sparql


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="termweave")
    commands = parser.add_subparsers(dest="command", required=True)
    build = commands.add_parser("build-dictionary", help="write ID<TAB>LABEL lines of a thesaurus")
    source = build.add_mutually_exclusive_group(required=True)
    source.add_argument("--endpoint", help="SPARQL endpoint")
    source.add_argument("--ntriples", help="N-Triples file or folder")
    build.add_argument("--from", dest="graph", default="", help="graph to read from")
    build.add_argument("--output", required=True, help="folder to write")
    build.add_argument("--brat", default="", help="folder for a normalisation database of the same labels")
    build.add_argument("--language", default="fr")
    build.add_argument("--plain", action="store_true", help="plain SKOS labels rather than SKOS-XL")
    build.add_argument("--keep", action="store_true", help="do nothing if the output is there")
    own = parser.parse_args(args)
    spark = SparkSession.builder.appName("termweave").getOrCreate()
    if own.endpoint:
        rows = sparql.skos_dictionary_rows(spark, own.endpoint, own.language, not own.plain, own.graph)
    else:
        rows = rdf.dictionary_rows(rdf.read_ntriples(spark, own.ntriples), own.language, not own.plain)
    mode = "ignore" if own.keep else "overwrite"
    dictionary.write_tsv(dictionary.index_labels(rows), own.output, mode)
    if own.brat:
        brat.write(rows, own.brat, mode=mode)


if __name__ == "__main__":
    main()
