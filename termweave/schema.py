"""Schemas of the tables that the operators pass on."""

from __future__ import annotations

LABELS = "concept_id string, label_index int, label string"
LABEL_ROWS = "ord long, concept_id string, label string"
CONCEPTS = "id string, label string, definition string, source string, language string, mappings array<string>, cuis array<string>, tuis array<string>, synonyms array<string>"
TRIPLES = "s string, p string, o string, o_lang string"
SEARCH_REPLY = "collection array<struct<`@id`: string, cui: array<string>, semanticType: array<string>, synonym: array<string>>>"
SPARQL_REPLY = "results struct<bindings array<map<string, struct<value: string>>>>"
SEPARATOR = ":::"
