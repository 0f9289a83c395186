"""Recognisers: a dictionary, a way to find its concepts in texts, and filters in one."""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Callable, Sequence
from copy import copy

from pyspark.sql import DataFrame, SparkSession

from .. import wordlists
from ..functions import roots
from ..functions.text import last_words
from ..functions.tokenizers import PATTERN, PieceTokenizer, Tokenizer
from ..sources.dictionary import concepts, read_tsv
from . import embed, fuzzy
from . import filters as annotation_filters
from . import index as indexing
from . import match as matching


class ConceptRecognizer(ABC):
    """What every recogniser offers; a new one defines ``initialize`` and ``mentions``.

    ``labels`` is a dictionary (concept_id, label_index, label). ``filters``
    defaults to the Levenshtein filter; an empty list leaves annotations as
    matched, with one row per label of a concept.
    """

    def __init__(self, labels: DataFrame, filters: Sequence[annotation_filters.AnnotationFilter] | None = None, key: str = "doc_id", tokenizer: Tokenizer = PATTERN):
        self.labels, self.key, self.tokenizer = labels, key, tokenizer
        self._filters = filters

    @classmethod
    def from_tsv(cls, spark: SparkSession, path: str, **options):
        return cls(read_tsv(spark, path), **options)

    @abstractmethod
    def initialize(self) -> ConceptRecognizer:
        """Build what matching needs now rather than at the first use."""

    @abstractmethod
    def mentions(self, docs: DataFrame) -> DataFrame:
        """Annotations of (key, text) before the filters."""

    @property
    def filters(self) -> list[annotation_filters.AnnotationFilter]:
        if self._filters is None:
            return [annotation_filters.label_filter(self.labels, key=self.key)]
        return list(self._filters)

    def filtered(self, filters: Sequence[annotation_filters.AnnotationFilter]) -> ConceptRecognizer:
        """This recogniser, with all it has built, with other filters."""
        other = copy(self)
        other._filters = list(filters)
        return other

    def tokens(self, docs: DataFrame) -> DataFrame:
        """(key, pos, start, end, token) of all tokens."""
        return self.tokenizer.explode(docs, [self.key])

    def annotate(self, docs: DataFrame) -> DataFrame:
        """Annotations of (key, text), with the filters applied in order."""
        found = self.mentions(docs)
        for step in self.filters:
            found = found.transform(step)
        return found

    def concepts(self) -> DataFrame:
        return concepts(self.labels)

    def __call__(self, docs: DataFrame) -> DataFrame:
        return self.annotate(docs)


class Recognizer(ConceptRecognizer):
    """Labels whose roots stand side by side in any order, stop words apart.

    ``root`` defaults to the Snowball stem of ``language``.
    """

    def __init__(
        self,
        labels: DataFrame,
        language: str = "en",
        root: roots.Root | None = None,
        filters: Sequence[annotation_filters.AnnotationFilter] | None = None,
        stop: Sequence[str] | None = None,
        terms: Sequence[str] | None = None,
        key: str = "doc_id",
        tokenizer: Tokenizer = PATTERN,
    ):
        super().__init__(labels, filters, key, tokenizer)
        self.language = wordlists.check_language(language)
        self.root = root or roots.snowball(language)
        self.stop = list(wordlists.STOP[language] if stop is None else stop)
        self.terms = list(wordlists.TERMINATION[language] if terms is None else terms)
        self._index: indexing.Index | None = None

    @property
    def index(self) -> indexing.Index:
        if self._index is None:
            self._index = indexing.build(self.labels, self.stop, self.root, self.tokenizer)
        return self._index

    def initialize(self) -> Recognizer:
        _ = self.index
        return self

    def load_index(self, spark: SparkSession, path: str) -> Recognizer:
        self._index = indexing.load(spark, path)
        return self

    @property
    def filters(self) -> list[annotation_filters.AnnotationFilter]:
        if self._filters is None:
            return [annotation_filters.levenshtein_filter(self.index, key=self.key)]
        return list(self._filters)

    def matches(self, docs: DataFrame) -> DataFrame:
        return matching.match(docs, self.index, self.stop, self.terms, self.root, self.key, tokenizer=self.tokenizer)

    def mentions(self, docs: DataFrame) -> DataFrame:
        return matching.annotations(docs, self.index, self.stop, self.terms, self.root, self.key, tokenizer=self.tokenizer)


class FuzzyRecognizer(ConceptRecognizer):
    """Windows of words within ``distance`` edits of a label.

    A mention's length is its number of words. The default filter asks
    single words to equal a label, so pass ``filters=[]`` to keep near ones.
    """

    def __init__(self, labels: DataFrame, distance: int = fuzzy.DISTANCE, **options):
        super().__init__(labels, **options)
        self.distance = distance
        self._known: DataFrame | None = None

    def initialize(self) -> FuzzyRecognizer:
        if self._known is None:
            self._known = fuzzy.fuzzy_labels(self.labels)
        return self

    def mentions(self, docs: DataFrame) -> DataFrame:
        self.initialize()
        return matching.described(fuzzy.mentions(docs, self._known, self.distance, self.key, self.tokenizer), self.key)


class EmbeddingRecognizer(Recognizer):
    """Labels whose word pieces stand side by side, with vectors per piece.

    ``pieces`` builds the tokenizer of an embedding model (a text to its
    pieces), ``embedder`` the model itself (see ``embed.embed_labels``); both are
    built where they are needed, once per task. A stop word or termination term
    counts by its last piece.
    """

    def __init__(self, labels: DataFrame, pieces: Callable[[], Callable[[str], list[str]]], embedder: embed.MakeEmbedder, language: str = "en", batch_size: int = 32, **options):
        cut = pieces()
        lists = {name: last_words(cut, options.pop(name, None) or known[language]) for name, known in (("stop", wordlists.STOP), ("terms", wordlists.TERMINATION))}
        super().__init__(labels, language, root=roots.identity, tokenizer=PieceTokenizer(pieces), **lists, **options)
        self.embedder, self.batch_size = embedder, batch_size
        self._embedded: DataFrame | None = None

    @property
    def embedded(self) -> DataFrame:
        """The labels' vectors, a written table: embedded once."""
        if self._embedded is None:
            from ..shared import materialise

            self._embedded = materialise(embed.embed_labels(self.labels, self.embedder, self.batch_size), "embedded")
        return self._embedded

    def initialize(self) -> EmbeddingRecognizer:
        super().initialize()
        _ = self.embedded
        return self

    def token_vectors(self) -> DataFrame:
        """(token, concept_id, vector): the vector of a piece in a concept."""
        return embed.token_index(self.embedded)

    def concept_vectors(self) -> DataFrame:
        """(token, vectors map<concept_id, vector>)."""
        return embed.concept_vectors(self.token_vectors())

    def label_vectors(self) -> DataFrame:
        """(concept_id, label_index, pooled)."""
        return self.embedded.select("concept_id", "label_index", "pooled")


def lower_recognizer(labels: DataFrame, **options) -> Recognizer:
    return Recognizer(labels, root=roots.lower, **options)


def stem_recognizer(labels: DataFrame, language: str = "en", stemmer=None, **options) -> Recognizer:
    root = roots.custom(lambda t: stemmer(stemmer(t.lower()))) if stemmer else roots.snowball(language)
    return Recognizer(labels, language=language, root=root, **options)


def phonetic_recognizer(labels: DataFrame, **options) -> Recognizer:
    return Recognizer(labels, root=roots.metaphone(), **options)
