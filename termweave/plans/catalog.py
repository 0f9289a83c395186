"""All queries over the driver's tables by name, and their DuckDB SQL.

Queries without SQL use stemmers and phonetic keys, which SQL lacks; tests
compare them with sequential versions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import shared, wordlists
from ..__main__ import main as command_line
from ..functions import roots, similarity, text
from ..functions.tokenizers import PATTERN
from ..operators import embed, fuzzy, index, match
from ..operators.filters import levenshtein_filter
from ..operators.recognizer import EmbeddingRecognizer, FuzzyRecognizer, Recognizer, stem_recognizer
from ..sources import brat, dictionary, enrichment, files, rdf
from ..streaming.annotate import annotate_stream, parquet_sink
from . import dictionaries as made
from . import sql

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
EN = wordlists.STOP["en"]
EN_END = wordlists.TERMINATION["en"]


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if oracle:
            ORACLES[function.__name__] = oracle
        return function

    return register


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return made.table(spark, sf_dir, "documents").select("doc_id", "text")


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return made.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.col("p_name").alias("text"))


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return made.table(spark, sf_dir, "conversations")


_PLACE = ("doc_id", "concept_id", "label_index", "start", "end", "matched_length")

# ---------------------------------------------------------------- dictionaries


@query(f"with {sql.BRANDS} select concept_id, label_index, label from blabels")
def dict_load_rows(spark, sf_dir):
    return made.brand_labels(spark, sf_dir).drop("ord")


@query(f"with {sql.BRANDS} select concept_id, label_index, label from blabels")
def dict_load_tsv(spark, sf_dir):
    path = shared.new_path(spark, "tsv")
    made.brand_rows(spark, sf_dir).orderBy("ord").select(F.concat_ws("\t", "concept_id", "label").alias("value")).coalesce(1).write.text(path)
    return dictionary.read_tsv(spark, path).drop("ord")


@query(f"with {sql.BRANDS} select concept_id, label_index, label from blabels")
def dict_roundtrip(spark, sf_dir):
    path = shared.new_path(spark, "roundtrip")
    dictionary.write_tsv(made.brand_labels(spark, sf_dir), path)
    return dictionary.read_tsv(spark, path).drop("ord")


@query(f"""with {sql.BRANDS} select concept_id as id, max(label) filter (label_index = 0) as label, (count(*) - 1)::int as n_synonyms
    from blabels where concept_id = 'http://example.org/brand_Brand#2' group by concept_id""")
def dict_lookup(spark, sf_dir):
    found = dictionary.lookup(dictionary.concepts(made.brand_labels(spark, sf_dir)), "http://example.org/brand_Brand#2")
    return found.select("id", "label", F.size("synonyms").alias("n_synonyms"))


@query(f"with {sql.BRANDS} select label, arg_max(concept_id, ord) as concept_id from blabels where label_index = 0 group by label")
def dict_reverse_index(spark, sf_dir):
    return dictionary.reverse_index(made.brand_labels(spark, sf_dir))


@query(f"with {sql.BRANDS} select count(distinct concept_id) as n_concepts from blabels")
def dict_size(spark, sf_dir):
    return dictionary.size(made.brand_labels(spark, sf_dir))


@query(f"with {sql.BRANDS} select distinct concept_id as id from blabels")
def dict_ids(spark, sf_dir):
    return dictionary.concepts(made.brand_labels(spark, sf_dir)).select("id")


@query(f"""with {sql.BRANDS}, more as (select concept_id, label from blabels union select 'http://example.org/brand_' || p_brand, p_type from part)
    select concept_id, array_to_string(list_sort(list(distinct label)), ', ') as labels from more group by concept_id""")
def dict_add_labels(spark, sf_dir):
    part = made.table(spark, sf_dir, "part")
    more = part.select(F.concat(F.lit("http://example.org/brand_"), "p_brand").alias("concept_id"), F.col("p_type").alias("label"))
    table = dictionary.add_labels(dictionary.concept_index(made.brand_labels(spark, sf_dir)), more)
    return table.select("concept_id", F.array_join("labels", ", ").alias("labels"))


@query(f"with {sql.BRANDS} select '[' || concept_id || '] ' || label as shown from blabels where label_index = 0")
def dict_display(spark, sf_dir):
    preferred = made.brand_labels(spark, sf_dir).where("label_index = 0")
    return preferred.select(dictionary.display_entry(F.col("concept_id"), F.col("label")).alias("shown"))


@query(f"with {sql.BRANDS} select concept_id, array_to_string(list_sort(list(distinct label)), ', ') as labels from blabels group by concept_id")
def concept_index(spark, sf_dir):
    return dictionary.concept_index(made.brand_labels(spark, sf_dir)).select("concept_id", F.array_join("labels", ", ").alias("labels"))


@query(f"with {sql.BRANDS} select concept_id, array_to_string(list_sort(list(distinct label)), ', ') || ' | ' as shown from blabels group by concept_id")
def concept_display(spark, sf_dir):
    table = dictionary.concept_index(made.brand_labels(spark, sf_dir))
    return table.select("concept_id", dictionary.display_concept(F.col("labels"), F.lit(None).cast("string")).alias("shown"))


@query(f"""with {sql.BRANDS} select key, key || chr(9) || string_agg('name:Name:' || label, chr(9) order by ord) as line
    from (select split_part(string_split(concept_id, '/')[-1], '_', 2) as key, ord, label from brand) group by key""")
def brat_norm_db(spark, sf_dir):
    return brat.lines(made.brand_rows(spark, sf_dir))


_LISTS = " union all ".join(f"select '{kind}' as kind, '{lang}' as lang, unnest([{sql.quoted(sorted(set(terms)))}]) as term" for kind, lists in (("stop", wordlists.STOP), ("end", wordlists.TERMINATION)) for lang, terms in lists.items())


@query(_LISTS)
def word_lists(spark, sf_dir):
    rows = []
    for kind, lists in (("stop", wordlists.STOP), ("end", wordlists.TERMINATION)):
        for language, terms in lists.items():
            path = shared.new_path(spark, f"{kind}-{language}")
            spark.createDataFrame([(t + " ",) for t in terms], "value string").coalesce(1).write.text(path)
            rows += [(kind, language, t) for t in wordlists.load_word_list(spark, path)]
    return spark.createDataFrame(rows, "kind string, lang string, term string")


# ----------------------------------------------------------------- thesauruses


@query(f"with {sql.TRIPLES} {sql.plain('prefLabel', 'en')}")
def skos_plain_labels(spark, sf_dir):
    return rdf.plain_labels(made.triples(spark, sf_dir), "en")


@query(f"with {sql.TRIPLES} {sql.xl('altLabel', 'fr')}")
def skos_xl_labels(spark, sf_dir):
    return rdf.xl_labels(made.triples(spark, sf_dir), "fr", rdf.SKOS_XL + "altLabel")


@query(f"""with {sql.TRIPLES}, both_kinds as (select 0 as kind, * from ({sql.plain('prefLabel', 'en')}) union all select 1, * from ({sql.plain('altLabel', 'en')}))
    select x as concept_id, (row_number() over (partition by x order by kind, lf) - 1)::int as label_index, lf as label from both_kinds""")
def skos_dictionary(spark, sf_dir):
    return dictionary.index_labels(rdf.dictionary_rows(made.triples(spark, sf_dir), "en", xl=False)).drop("ord")


@query(f"with {sql.TRIPLES} select count(*) as count from (select distinct * from ({sql.plain('prefLabel', 'en')}))")
def skos_count(spark, sf_dir):
    return rdf.count_distinct(rdf.plain_labels(made.triples(spark, sf_dir), "en"))


@query(f"with {sql.TRIPLES} select distinct * from ({sql.plain('altLabel', 'en')}) order by x, lf limit 90 offset 30")
def skos_page(spark, sf_dir):
    return rdf.page(rdf.plain_labels(made.triples(spark, sf_dir), "en", rdf.SKOS + "altLabel"), 30, 90)


def _write_ntriples(triples: DataFrame, path: str) -> None:
    node = lambda c: F.concat(F.lit("<"), c, F.lit(">"))
    literal = F.concat(F.lit('"'), "o", F.lit('"@'), "o_lang")
    triples.select(F.concat_ws(" ", node("s"), node("p"), F.when(F.col("o_lang").isNull(), node("o")).otherwise(literal), F.lit(".")).alias("value")).write.text(path)


@query(f"with {sql.TRIPLES} select s, p, o, o_lang from triples")
def ntriples_roundtrip(spark, sf_dir):
    path = shared.new_path(spark, "triples")
    _write_ntriples(made.triples(spark, sf_dir), path)
    return rdf.read_ntriples(spark, path)


@query(f"""with {sql.TRIPLES}, both_kinds as (select 0 as kind, * from ({sql.plain('prefLabel', 'en')}) union all select 1, * from ({sql.plain('altLabel', 'en')}))
    select x as concept_id, (row_number() over (partition by x order by kind, lf) - 1)::int as label_index, lf as label from both_kinds""")
def command_line_dictionary(spark, sf_dir):
    """As ``skos_dictionary``, by the command line from an N-Triples file to a TSV."""
    source, target = shared.new_path(spark, "triples"), shared.new_path(spark, "built")
    _write_ntriples(made.triples(spark, sf_dir), source)
    for _ in range(2):
        command_line(["build-dictionary", "--ntriples", source, "--output", target, "--language", "en", "--plain", "--keep"])
    return dictionary.read_tsv(spark, target).drop("ord")


_REPLIES = """with items as (select p_brand, p_partkey, p_size % 2 = 0 as has_cui, p_size % 4 <> 0 as has_type, 'C' || p_size as cui, p_type, p_name,
        row_number() over (partition by p_brand order by p_partkey) as place from part)
    select p_brand as concept_id, array_to_string(list('id' || p_partkey order by p_partkey), ',') as mappings,
        array_to_string(list_sort(list(distinct cui) filter (has_cui)), ',') as cuis,
        array_to_string(list_sort(list(distinct p_type) filter (has_cui and has_type)), ',') as tuis,
        array_to_string(list_sort(list(distinct p_name) filter (has_cui and has_type)), ',') as synonyms from items {where} group by p_brand"""


def _replies(spark, sf_dir, most: int | None = None) -> DataFrame:
    found = enrichment.merged(made.search_replies(spark, sf_dir), most)
    return found.select("concept_id", *[F.array_join(c, ",").alias(c) for c in ("mappings", "cuis", "tuis", "synonyms")])


@query(_REPLIES.format(where=""))
def enrich_search_replies(spark, sf_dir):
    return _replies(spark, sf_dir)


@query(_REPLIES.format(where="where place <= 3"))
def enrich_top_replies(spark, sf_dir):
    """Of each reply the first three results."""
    return _replies(spark, sf_dir, 3)


# ------------------------------------------------------------ tokens and roots

_TURNS = "turns as (select conv_id * 1000 + turn as doc_id, text from conversations)"


def _turn_texts(spark, sf_dir):
    return _turns(spark, sf_dir).select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), "text")


@query(f"with {sql.tokens('tok', 'documents')} select * from tok")
def token_spans(spark, sf_dir):
    return PATTERN.explode(_docs(spark, sf_dir), ["doc_id"])


@query(f"with {_TURNS}, {sql.tokens('tok', 'turns')} select * from tok")
def token_spans_windows(spark, sf_dir):
    """By expressions and windows alone, without a Python worker."""
    return text.explode_tokens(_turn_texts(spark, sf_dir).repartition("doc_id"), ["doc_id"])


@query(f"""with {sql.tokens('tok', 'documents')} select doc_id, pos, token in ({sql.quoted(EN)}) as is_stop,
    trim(token) in ({sql.quoted(EN_END)}) as ends, token in ({sql.quoted(EN + EN_END)}) as blocks from tok""")
def token_classes(spark, sf_dir):
    t = F.col("token")
    return token_spans(spark, sf_dir).select("doc_id", "pos", text.is_stop(t, EN).alias("is_stop"), text.is_termination(t, EN_END).alias("ends"), text.blocks_start(t, EN, EN_END).alias("blocks"))


@query(f"select doc_id, {sql.NORMAL} as normalized from (select doc_id, text as label from documents)")
def label_normalize(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", text.normalize_label(F.col("text")).alias("normalized"))


@query(r"select doc_id, lower(regexp_replace(text, '[\p{C}\p{M}\p{P}\p{S}\p{Z}]+', ' ', 'g')) as normalized from documents")
def fuzzy_normalize(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", text.normalize_fuzzy(F.col("text")).alias("normalized"))


def _token_roots(spark, sf_dir, root: roots.Root) -> DataFrame:
    return PATTERN.distinct(_docs(spark, sf_dir)).select("token", root(F.col("token")).alias("root"))


_DISTINCT = f"with {sql.tokens('tok', 'documents')} select distinct token, "


@query(_DISTINCT + "token as root from tok")
def root_identity(spark, sf_dir):
    return _token_roots(spark, sf_dir, roots.identity)


@query(_DISTINCT + "lower(token) as root from tok")
def root_lower(spark, sf_dir):
    return _token_roots(spark, sf_dir, roots.lower)


@query(_DISTINCT + sql.s_root("token") + " as root from tok")
def root_s_stem(spark, sf_dir):
    return _token_roots(spark, sf_dir, roots.s_stem)


@query()
def root_stem(spark, sf_dir):
    return _token_roots(spark, sf_dir, roots.snowball("en"))


@query()
def root_stem_fr(spark, sf_dir):
    return _token_roots(spark, sf_dir, roots.snowball("fr"))


@query()
def root_phonetic(spark, sf_dir):
    return _token_roots(spark, sf_dir, roots.metaphone())


@query(_DISTINCT + sql.soundex("token") + " as root from tok")
def root_soundex(spark, sf_dir):
    return _token_roots(spark, sf_dir, roots.soundex)


@query("""with p as (select p_partkey as doc_id, unnest(['a', 'b', 'c']) as piece, p_name from part)
    select doc_id, piece, (case piece when 'a' then 0 when 'b' then 2 else strpos(p_name, ' ') end)::int as start,
        (case piece when 'a' then 2 when 'b' then strpos(p_name, ' ') - 1 else length(p_name) end)::int as "end" from p""")
def piece_spans(spark, sf_dir):
    """Word pieces: the first two letters, the word's rest, the second word."""
    words = F.split("text", " ")
    first, second = F.element_at(words, 1), F.element_at(words, 2)
    pieces = F.array(F.substring(first, 1, 2), F.concat(F.lit("##"), F.expr("substring(split(text, ' ')[0], 3)")), second)
    spans = _parts(spark, sf_dir).select("doc_id", F.posexplode(text.piece_spans(pieces, F.col("text"))).alias("i", "s"))
    return spans.select("doc_id", F.element_at(F.array(F.lit("a"), F.lit("b"), F.lit("c")), F.col("i") + 1).alias("piece"), "s.start", "s.end")


@query("""select doc_id, i::int as place, case when length(w) > 3 then '##' || substr(w, 4) else w end as piece
    from (select p_partkey as doc_id, unnest(ws) as w, generate_subscripts(ws, 1) - 1 as i from (select p_partkey, string_split(p_name, ' ') as ws from part))""")
def last_pieces(spark, sf_dir):
    """The last word piece of each word: three letters, then the rest."""
    cut = F.transform(F.split("text", " "), lambda w: F.filter(F.array(F.substring(w, 1, 3), F.when(F.length(w) > 3, F.concat(F.lit("##"), F.substring(w, F.lit(4), F.length(w))))), lambda p: p.isNotNull()))
    return _parts(spark, sf_dir).select("doc_id", F.posexplode(text.last_piece(cut)).alias("place", "piece"))


@query("""select replace(p_brand, '#', '_') as brand, string_agg(p_name, chr(10) order by p_partkey) || chr(10) as text from part group by p_brand""")
def read_files(spark, sf_dir):
    """Files of a brand's part names, read whole."""
    path = shared.new_path(spark, "files")
    rows = made.table(spark, sf_dir, "part").select(F.translate("p_brand", "#", "_").alias("brand"), "p_partkey", F.col("p_name").alias("value"))
    rows.repartition("brand").sortWithinPartitions("brand", "p_partkey").select("brand", "value").write.partitionBy("brand").text(path)
    return files.read_texts(spark, path).select(F.regexp_extract("doc_id", "brand=([^/]+)/", 1).alias("brand"), "text")


@query("select p_partkey as doc_id, p_name as text from part")
def save_once(spark, sf_dir):
    """The second write finds the table there and changes nothing."""
    path = shared.new_path(spark, "once")
    files.save_once(_parts(spark, sf_dir), path)
    return files.save_once(_parts(spark, sf_dir).limit(0), path)


# ----------------------------------------------------------------------- index


@query(f"with {sql.TERMS}, {sql.label_index('terms')} select root, string_agg(key, ' ' order by key) as keys from post group by root")
def root_index(spark, sf_dir):
    rows = index.postings(made.corpus_terms(spark, sf_dir), EN, roots.lower)
    return rows.groupBy("root").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":::", "concept_id", F.col("label_index").cast("string")))), " ").alias("keys"))


@query(f"with {sql.TERMS}, {sql.label_index('terms')} select root, split_part(key, ':::', 1) as concept_id, split_part(key, ':::', 2)::int as label_index, cnt from post")
def root_histogram(spark, sf_dir):
    return index.postings(made.corpus_terms(spark, sf_dir), EN, roots.lower)


@query(f"""with {sql.TERMS}, {sql.label_index('terms')} select concept_id, label_index, coalesce(n_tokens, 0)::int as n_tokens
    from terms left join lens on lens.key = concept_id || ':::' || label_index""")
def label_lengths(spark, sf_dir):
    return index.label_lengths(made.corpus_terms(spark, sf_dir), EN)


@query(f"""with {sql.TERMS}, {sql.label_index('terms')}, {sql.tokens('tok', 'documents')}
    select doc_id, pos, count(*) as n_keys from tok join post on post.root = lower(tok.token)
    where token not in ({sql.quoted(EN)}) and trim(token) not in ({sql.quoted(EN_END)}) group by all""")
def root_hits(spark, sf_dir):
    found = index.build(made.corpus_terms(spark, sf_dir), EN, roots.lower)
    spread = PATTERN.explode(_docs(spark, sf_dir), ["doc_id"])
    t = F.col("token")
    content = spread.where(~text.is_stop(t, EN) & ~text.is_termination(t, EN_END)).select("doc_id", "pos", F.lower(t).alias("root"))
    return content.join(found.hint(found.by_root), "root").select("doc_id", "pos", F.size("keys").cast("long").alias("n_keys"))


# -------------------------------------------------------------------- matching


def _matched(spark, sf_dir, docs: DataFrame, labels: DataFrame, root: roots.Root, language: str = "en") -> DataFrame:
    stop, terms = wordlists.STOP[language], wordlists.TERMINATION[language]
    return match.match(docs, index.build(labels, stop, root), stop, terms, root)


_ANN = 'select doc_id, concept_id, label_index, start, "end", matched_length from ann'


@query(f"with recursive {sql.TERMS}, {sql.matches('documents', 'terms')} {_ANN}")
def match_lower(spark, sf_dir):
    return _matched(spark, sf_dir, _docs(spark, sf_dir), made.corpus_terms(spark, sf_dir), roots.lower)


@query(f"with recursive {sql.TERMS}, {sql.PLURALS}, {sql.matches('documents', 'plurals', sql.s_root)} {_ANN}")
def match_unfiltered(spark, sf_dir):
    return _matched(spark, sf_dir, _docs(spark, sf_dir), made.plural_terms(made.corpus_terms(spark, sf_dir)), roots.s_stem)


@query(f"with recursive {sql.TERMS}, {sql.matches('documents', 'terms', language='fr')} {_ANN}")
def match_fr(spark, sf_dir):
    own = Recognizer(made.corpus_terms(spark, sf_dir), "fr", roots.lower, filters=[])
    return own.annotate(_docs(spark, sf_dir)).select(*_PLACE)


@query(f"with recursive {sql.TERMS}, {sql.matches('documents', 'terms', sql.prefix_root)} {_ANN}")
def match_custom_stem(spark, sf_dir):
    """By a stemmer of the caller: the first five letters."""
    own = stem_recognizer(made.corpus_terms(spark, sf_dir), stemmer=made.first_letters, filters=[])
    return own.annotate(_docs(spark, sf_dir)).select(*_PLACE)


def _repeating(label: str) -> str:
    return f"len(list_distinct(string_split({label}, ' '))) < len(string_split({label}, ' '))"


@query(f"with recursive {sql.TERMS}, rep as (select * from terms where {_repeating('label')}), {sql.matches('documents', 'rep')} {_ANN}")
def match_repeated(spark, sf_dir):
    words = F.split("label", " ")
    labels = made.corpus_terms(spark, sf_dir).where(F.size(F.array_distinct(words)) < F.size(words))
    return _matched(spark, sf_dir, _docs(spark, sf_dir), labels, roots.lower)


@query()
def match_stem(spark, sf_dir):
    return _matched(spark, sf_dir, _docs(spark, sf_dir), made.corpus_terms(spark, sf_dir), roots.snowball("en"))


@query()
def match_phonetic(spark, sf_dir):
    return _matched(spark, sf_dir, _docs(spark, sf_dir), made.corpus_terms(spark, sf_dir), roots.metaphone())


def _recognizer(spark, sf_dir, **options) -> Recognizer:
    return Recognizer(made.plural_terms(made.corpus_terms(spark, sf_dir)), root=roots.s_stem, **options)


_FILTERED = f"""with recursive {sql.TERMS}, {sql.PLURALS}, {sql.matches('documents', 'plurals', sql.s_root)},
    worded as (select ann.*, substr(text, start + 1, "end" - start) as matched_text from ann join documents using (doc_id)),
    kept as (select * from worded w where matched_length > 1 or exists (select 1 from plurals p where p.concept_id = w.concept_id and p.label = w.matched_text)),
    sole as (select doc_id, concept_id, start, "end", min(label_index)::int as label_index, min(matched_text) as matched_text, min(matched_length)::int as matched_length from kept group by all)"""


@query(f"""{_FILTERED} select doc_id, concept_id, label_index, concept_id || ':::' || label_index as label_key, start, "end", matched_text, matched_length, 1.0::double as confidence_score from sole""")
def annotate(spark, sf_dir):
    return _recognizer(spark, sf_dir).annotate(_docs(spark, sf_dir))


@query(f"""{_FILTERED} select doc_id, concept_id, label_index, start, "end", matched_length from sole""")
def filter_levenshtein(spark, sf_dir):
    return _recognizer(spark, sf_dir).annotate(_docs(spark, sf_dir)).select(*_PLACE)


@query(f"""{_FILTERED.replace("p.label = w.matched_text", "1 - damerau_levenshtein(w.matched_text, p.label) > -1.5")} select doc_id, concept_id, label_index, start, "end", matched_length from sole""")
def filter_levenshtein_loose(spark, sf_dir):
    own = _recognizer(spark, sf_dir, filters=[])
    return levenshtein_filter(own.index, theta=-1.5)(own.annotate(_docs(spark, sf_dir))).select(*_PLACE)


@query(f"""{_FILTERED} select doc_id, concept_id, label_index, start, "end", matched_length from sole where "end" - start >= 8""")
def filter_chain(spark, sf_dir):
    """The Levenshtein filter, then one of the caller's."""
    own = _recognizer(spark, sf_dir)
    own = own.filtered([*own.filters, lambda found: found.where(F.col("end") - F.col("start") >= 8)])
    return own.annotate(_docs(spark, sf_dir)).select(*_PLACE)


_NAMES = f"with recursive {sql.PART_NAMES}, {sql.PART_TEXTS}, {sql.matches('parts', 'names')}"


def _named(spark, sf_dir) -> DataFrame:
    own = Recognizer(made.part_names(spark, sf_dir), root=roots.lower, filters=[])
    return own.annotate(_parts(spark, sf_dir))


@query(f"{_NAMES} select ann.doc_id, ann.concept_id, start, \"end\", label from ann left join names using (concept_id)")
def annotate_with_concept(spark, sf_dir):
    names = dictionary.concepts(made.part_names(spark, sf_dir))
    return match.with_concepts(_named(spark, sf_dir), names).select("doc_id", "concept_id", "start", "end", "label")


@query(f"""{_NAMES} select 'Annotation (' || substr(text, start + 1, "end" - start) || ')[' || start || '-' || "end" || ' M' || matched_length || '] - ' || concept_id as shown
    from ann join parts using (doc_id)""")
def annotation_display(spark, sf_dir):
    shown = dictionary.display_annotation(F.col("matched_text"), F.col("start"), F.col("end"), F.col("matched_length"), F.col("concept_id"))
    return _named(spark, sf_dir).select(shown.alias("shown"))


@query(f"{_NAMES} {_ANN} order by matched_length desc, doc_id, start, \"end\", concept_id")
def annotations_sorted(spark, sf_dir):
    return match.by_length(_named(spark, sf_dir)).select(*_PLACE)


@query(f"""with recursive {sql.TERMS}, {sql.matches('documents', 'terms')}, placed as (select *, row_number() over (partition by doc_id
    order by "end" - start desc, matched_length desc, start, concept_id) as place from ann) select doc_id, concept_id, start, "end", matched_length from placed where place = 1""")
def longest_annotation(spark, sf_dir):
    return match.longest(match_lower(spark, sf_dir)).select("doc_id", "concept_id", "start", "end", "matched_length")


@query(f"{_NAMES} {_ANN}")
def index_reload(spark, sf_dir):
    """Match with an index that was saved and loaded again."""
    path = shared.new_path(spark, "index")
    index.build(made.part_names(spark, sf_dir), EN, roots.lower).save(path)
    return match.match(_parts(spark, sf_dir), index.load(spark, path), EN, EN_END, roots.lower).select(*_PLACE)


@query(f"{_NAMES} {_ANN}")
def annotate_from_tsv(spark, sf_dir):
    """An annotator of a dictionary file."""
    path = shared.new_path(spark, "names")
    dictionary.write_tsv(made.part_names(spark, sf_dir), path)
    own = Recognizer.from_tsv(spark, path, root=roots.lower, filters=[]).initialize()
    return own(_parts(spark, sf_dir)).select(*_PLACE)


@query(f"{_NAMES} {_ANN}")
def annotate_stream_parts(spark, sf_dir):
    """The part table as a stream of its files, annotated batch by batch."""
    source, sink, state = (shared.new_path(spark, n) for n in ("stream-in", "stream-out", "stream-state"))
    _parts(spark, sf_dir).repartition(3).write.parquet(source)
    stream = spark.readStream.schema("doc_id long, text string").option("maxFilesPerTrigger", 2).parquet(source)
    own = Recognizer(made.part_names(spark, sf_dir), root=roots.lower, filters=[])
    running = annotate_stream(stream, own, parquet_sink(sink)).option("checkpointLocation", state).trigger(availableNow=True).start()
    running.awaitTermination()
    return spark.read.parquet(sink).select(*_PLACE)


@query(f"with recursive {sql.TERMS}, rep as (select * from terms where {_repeating('label')}), {sql.matches('documents', 'rep')} {_ANN}")
def match_windows(spark, sf_dir):
    """The plan for dictionaries that don't fit every task."""
    words = F.split("label", " ")
    labels = made.corpus_terms(spark, sf_dir).where(F.size(F.array_distinct(words)) < F.size(words))
    return match.match_windows(_docs(spark, sf_dir), index.build(labels, EN, roots.lower), EN, EN_END, roots.lower).select(*_PLACE)


_FUZZY_PARTS = r"""with names as (select arg_max('p' || k, 'p' || k) as concept_id, label from (select min(p_partkey) as k, p_name as label from part group by p_name) group by label),
    ws as (select p_partkey as doc_id, unnest(p) as w, generate_subscripts(p, 1) as i from (select p_partkey, string_split(p_name, ' ') as p from part)),
    placed as (select doc_id, w, i, lead(w) over (partition by doc_id order by i) as w2, coalesce(sum(length(w) + 1) over (partition by doc_id order by i rows between unbounded preceding and 1 preceding), 0)::int as start from ws),
    wins as (select doc_id, start, (start + length(w))::int as e, w as "window" from placed union all select doc_id, start, (start + length(w) + 1 + length(w2))::int, w || ' ' || w2 from placed where w2 is not null)"""


@query(f"""{_FUZZY_PARTS} select doc_id, start, e as "end", "window", concept_id, label as normalized, levenshtein("window", label)::int as distance from wins join names on levenshtein("window", label) <= 2""")
def fuzzy_match_parts(spark, sf_dir):
    return fuzzy.fuzzy_match(_parts(spark, sf_dir), made.part_names(spark, sf_dir)).drop("label_index")


@query(f"""{_FUZZY_PARTS} select doc_id, concept_id, 0 as label_index, start, e as "end", "window" as matched_text, (1 + length("window") - length(replace("window", ' ', '')))::int as matched_length
    from wins join names on levenshtein("window", label) <= 2""")
def annotate_fuzzy_parts(spark, sf_dir):
    """The approximate recogniser."""
    own = FuzzyRecognizer(made.part_names(spark, sf_dir), filters=[])
    return own.annotate(_parts(spark, sf_dir)).drop("label_key", "confidence_score")


_LEAD_ENDS = ", ".join(f'lead(w, {k}) over o as w{k}, lead("end", {k}) over o as e{k}' for k in range(1, made.LONGEST))
_FUZZY_WINDOWS = " union all ".join(
    f"""select doc_id, start, {'"end"' if n == 1 else f"e{n - 1}"} as e, {" || ' ' || ".join(["w", *[f"w{k}" for k in range(1, n)]])} as "window" from near_words where {"true" if n == 1 else f"w{n - 1} is not null"}"""
    for n in range(1, made.LONGEST + 1)
)


@query(rf"""with {sql.TERMS}, {sql.tokens('tok', 'documents')},
    names as (select label as normalized, max(concept_id) as concept_id from terms where length(label) >= {made.LONG} and regexp_full_match(label, '[ -~]+') group by label),
    nw as (select doc_id, pos, start, "end", trim(lower(regexp_replace(token, '[\p{{C}}\p{{M}}\p{{P}}\p{{S}}\p{{Z}}]+', ' ', 'g'))) as w from tok),
    near_words as (select *, {_LEAD_ENDS} from nw where w <> '' window o as (partition by doc_id order by pos)),
    wins as ({_FUZZY_WINDOWS}),
    plain as (select distinct "window", regexp_replace("window", '[^ -~]', chr(1), 'g') as w from wins),
    pairs as (select "window", normalized, concept_id, levenshtein(w, normalized)::int as distance from plain join names
        on length(w) between length(normalized) - 2 and length(normalized) + 2 where levenshtein(w, normalized) <= 2)
    select doc_id, start, e as "end", "window", concept_id, normalized, distance from wins join pairs using ("window")""")
def fuzzy_match(spark, sf_dir):
    """The SQL's distance counts bytes, so the labels are ASCII and other characters count as one byte that no label has."""
    return fuzzy.fuzzy_match(_docs(spark, sf_dir), made.long_terms(spark, sf_dir)).drop("label_index")


# ------------------------------------------------------------------ similarity

_PAIRS = f"""{_TURNS}, {sql.tokens('tok', 'turns')}, cnt as (select doc_id, lower(token) as w, count(*) as n from tok group by all),
    sizes as (select doc_id, sum(n)::bigint as size from cnt group by doc_id),
    pairs as (select conv_id * 1000 + turn as a, conv_id * 1000 + turn + 1 as b from conversations where conv_id * 1000 + turn + 1 in (select doc_id from turns)),
    met as (select a, b, coalesce((select sum(x.n * y.n) from cnt x join cnt y using (w) where x.doc_id = a and y.doc_id = b), 0)::bigint as overlap from pairs),
    sized as (select met.*, x.size as na, y.size as nb from met join sizes x on x.doc_id = a join sizes y on y.doc_id = b)"""


def _turn_pairs(spark, sf_dir) -> DataFrame:
    """(a, b, overlap, na, nb) of each turn and the next."""
    turns = _turn_texts(spark, sf_dir)
    words = PATTERN.explode(turns, ["doc_id"]).select("doc_id", F.lower("token").alias("w"))
    pairs = turns.select(F.col("doc_id").alias("a"), (F.col("doc_id") + 1).alias("b")).join(turns.select(F.col("doc_id").alias("b")), "b", "left_semi")
    named = lambda k: words.withColumnRenamed("doc_id", k)
    met = similarity.overlap_by_key(named("a"), named("b"), "a", "b", pairs, "w")
    sizes = words.groupBy("doc_id").agg(F.count("*").alias("n"))
    return met.join(sizes.select(F.col("doc_id").alias("a"), F.col("n").alias("na")), "a").join(sizes.select(F.col("doc_id").alias("b"), F.col("n").alias("nb")), "b")


@query(f"with {_PAIRS} select a, b, overlap from sized")
def sim_hard_overlap(spark, sf_dir):
    return _turn_pairs(spark, sf_dir).select("a", "b", "overlap")


@query(f"with {_PAIRS} select a, b, round(overlap / (na + nb), 6) as jaccard from sized")
def sim_jaccard(spark, sf_dir):
    """With the array functions: texts of turns are short."""
    turns = _turn_texts(spark, sf_dir)
    arrays = turns.select("doc_id", F.transform(PATTERN.column(spark, F.col("text")), lambda t: F.lower(t["token"])).alias("ws"))
    pairs = arrays.select(F.col("doc_id").alias("a"), "ws", (F.col("doc_id") + 1).alias("b")).join(arrays.select(F.col("doc_id").alias("b"), F.col("ws").alias("ws2")), "b")
    return pairs.select("a", "b", F.round(similarity.jaccard(F.col("ws"), F.col("ws2")), 6).alias("jaccard"))


@query(f"with {_PAIRS} select a, b, round(overlap / (na + nb), 6) as jaccard from sized")
def sim_jaccard_count(spark, sf_dir):
    return _turn_pairs(spark, sf_dir).select("a", "b", F.round(similarity.jaccard_count(F.col("overlap"), F.col("na") + F.col("nb")), 6).alias("jaccard"))


@query(f"with {_PAIRS} select a, b, round(0.5 * overlap - 0.25 * na - 0.25 * nb, 6)::double as contrast from sized")
def sim_tversky_contrast(spark, sf_dir):
    c = similarity.tversky_contrast(0.5, 0.25, 0.25, F.col("overlap"), F.col("na"), F.col("nb"))
    return _turn_pairs(spark, sf_dir).select("a", "b", F.round(c, 6).alias("contrast"))


@query(f"""with {_PAIRS} select a, b, round(case when 0.5 * overlap - 0.25 * na - 0.25 * nb = 0 then 0
    else 0.5::double * overlap / (0.5::double * overlap - 0.25::double * na - 0.25::double * nb) end, 6) as ratio from sized""")
def sim_tversky_ratio(spark, sf_dir):
    r = similarity.tversky_ratio(0.5, 0.25, 0.25, F.col("overlap"), F.col("na"), F.col("nb"))
    return _turn_pairs(spark, sf_dir).select("a", "b", F.round(r, 6).alias("ratio"))


_WEIGHTED = "(select l_orderkey, case when l_discount > 0 then l_discount::double end as v, l_quantity::double / 50 as w from lineitem)"


def _weighted(spark, sf_dir) -> DataFrame:
    line = made.table(spark, sf_dir, "lineitem")
    return line.select("l_orderkey", F.when(F.col("l_discount") > 0, F.col("l_discount").cast("double")).alias("v"), (F.col("l_quantity").cast("double") / 50).alias("w"))


@query(f"select l_orderkey, round(exp(coalesce(sum(w * ln(greatest(v, 0.00001))) filter (v is not null), 0) / count(*)), 6) as mean from {_WEIGHTED} group by l_orderkey")
def sim_geometric_mean(spark, sf_dir):
    return _weighted(spark, sf_dir).groupBy("l_orderkey").agg(F.round(similarity.geometric_mean(F.col("v"), F.col("w")), 6).alias("mean"))


@query(f"select l_orderkey, round(sum(v * w) / count(*), 6) as mean from {_WEIGHTED} group by l_orderkey")
def sim_arithmetic_mean(spark, sf_dir):
    return _weighted(spark, sf_dir).groupBy("l_orderkey").agg(F.round(similarity.arithmetic_mean(F.col("v"), F.col("w")), 6).alias("mean"))


# ------------------------------------------------------------------ embeddings

_PIECE_LISTS = {name: {"en": text.last_words(made.word_pieces, lists["en"])} for name, lists in (("stop", wordlists.STOP), ("end", wordlists.TERMINATION))}


def _embedding(spark, sf_dir, **options) -> EmbeddingRecognizer:
    return EmbeddingRecognizer(made.part_names(spark, sf_dir), made.make_word_pieces, made.make_letter_embedder, **options)


@query(f"""with {sql.PART_NAMES}, keyed as (select concept_id as doc_id, label as text from names), {sql.pieces('tok', 'keyed')},
    first as (select token, doc_id as concept_id from tok group by all)
    select token, concept_id, dim, (case dim when 0 then length(token) when 1 then unicode(token) else unicode(right(token, 1)) end)::double as value from first, (select unnest([0, 1, 2])::int as dim)""")
def embedding_index(spark, sf_dir):
    """Labels through tokenizer and embedder into vectors per piece and concept."""
    vectors = _embedding(spark, sf_dir).concept_vectors()
    each = vectors.select("token", F.explode("vectors").alias("concept_id", "vector"))
    return each.select("token", "concept_id", F.posexplode("vector").alias("dim", "value")).withColumn("value", F.col("value").cast("double"))


@query(f"""with {sql.PART_NAMES}, keyed as (select concept_id as doc_id, label as text from names), {sql.pieces('tok', 'keyed')}
    select doc_id as concept_id, round(avg(length(token)), 4) as mean_length from tok group by doc_id""")
def embedding_labels(spark, sf_dir):
    """The pooled vector of each label: its first dimension."""
    return _embedding(spark, sf_dir).label_vectors().select("concept_id", F.round(F.element_at("pooled", 1).cast("double"), 4).alias("mean_length"))


@query(f"""with recursive {sql.PART_NAMES}, {sql.PART_TEXTS},
    {sql.matches('parts', 'names', lambda t: t, cut=sql.pieces, stops=_PIECE_LISTS['stop'], ends=_PIECE_LISTS['end'])} {_ANN}""")
def embedding_match(spark, sf_dir):
    return _embedding(spark, sf_dir, filters=[]).annotate(_parts(spark, sf_dir)).select(*_PLACE)


@query("""with flat as (select label, unnest(embedding) as v, generate_subscripts(embedding, 1) - 1 as dim from embeddings)
    select label, dim::int as dim, round(avg(v::double), 6) as value from flat group by all""")
def embedding_means(spark, sf_dir):
    found = embed.pooled(made.table(spark, sf_dir, "embeddings"), "label", "embedding")
    return found.select("label", "dim", F.round("value", 6).alias("value"))
