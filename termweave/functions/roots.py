"""Root functions: tokens with equal roots match each other.

A root function maps a token column to a root column; its attribute ``plain``,
where it has one, maps one token alike. ``lower``, ``identity``,
``s_stem`` and ``soundex`` stay in the JVM; ``snowball`` and ``metaphone`` are
Arrow UDFs that remember the tokens a worker has seen.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import phonetics, stemmers

Root = Callable[[Column], Column]
#: Tokens that a worker remembers: frequent ones; what it holds doesn't follow the vocabulary.
MEMO = 50_000


def identity(token: Column) -> Column:
    return token


def lower(token: Column) -> Column:
    return F.lower(token)


def s_stem(token: Column) -> Column:
    """Harman's S-stemmer on the lower-cased token."""
    t = F.lower(token)

    def cut(n: int) -> Column:
        return F.substring(t, F.lit(1), F.length(t) - n)

    return (
        F.when(t.endswith("ies") & ~t.endswith("eies") & ~t.endswith("aies"), F.concat(cut(3), F.lit("y")))
        .when(t.endswith("es") & ~t.endswith("aes") & ~t.endswith("ees") & ~t.endswith("oes"), cut(1))
        .when(t.endswith("s") & ~t.endswith("us") & ~t.endswith("ss"), cut(1))
        .otherwise(t)
    )


def _s_stem(token: str) -> str:
    t = token.lower()
    if t.endswith("ies") and not t.endswith(("eies", "aies")):
        return t[:-3] + "y"
    if t.endswith("es") and not t.endswith(("aes", "ees", "oes")):
        return t[:-1]
    return t[:-1] if t.endswith("s") and not t.endswith(("us", "ss")) else t


identity.plain = str
lower.plain = str.lower
s_stem.plain = _s_stem


def soundex(token: Column) -> Column:
    return F.soundex(token)


def _memoised(make: Callable[[str], str]) -> Root:
    def root(token: Column) -> Column:
        @F.arrow_udf("string")
        def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            known: dict[str | None, str | None] = {None: None}
            for batch in batches:
                encoded = batch.dictionary_encode()
                words = encoded.dictionary.to_pylist()
                for word in words:
                    if word not in known:
                        if len(known) > MEMO:
                            known.clear()
                            known[None] = None
                        known[word] = make(word)
                yield pa.array([known.get(w) if w in known else make(w) for w in words], pa.string()).take(encoded.indices)

        return run(token)

    root.plain = make
    return root


def custom(stem: Callable[[str], str]) -> Root:
    """A root function from a Python stemmer, applied to distinct tokens."""
    return _memoised(stem)


def snowball(language: str = "en") -> Root:
    """The Snowball stem of the Snowball stem, in lower case."""
    once = stemmers.stemmer(language)
    return _memoised(lambda token: once(once(token.lower())))


def metaphone() -> Root:
    """The primary double-metaphone key."""
    return _memoised(lambda token: phonetics.double_metaphone(token)[0])
