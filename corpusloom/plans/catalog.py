"""The registered queries of this engine and their DuckDB SQL."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import metadata, text
from ..functions.chunking import SECTION_SIGNS
from ..functions.vectors import HashedEmbedder, embed
from ..operators import ann, chunks, context, extraction, pdf, search
from ..operators.scratch import place
from ..sources import elements, markup, variants
from .engine import Engine

QUESTION = "the answer to a question of the house"
#: Share of a source's documents on which a line must be to count as repeated.
REPEATED_SHARE = 0.02


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "documents").select("doc_id", "text")


# chunkers


def sliding_windows(spark, sf_dir):
    return chunks.windows(_docs(spark, sf_dir), 800, 200)


def parent_child_chunks(spark, sf_dir):
    return chunks.parents_and_children(_docs(spark, sf_dir)).select("doc_id", "parent_index", "child_index", "child", F.length("parent").alias("parent_chars"))


def structural_chunks(spark, sf_dir):
    return chunks.structural(_docs(spark, sf_dir))


def structural_chunks_paragraphs(spark, sf_dir):
    return chunks.structural(_docs(spark, sf_dir).withColumn("text", F.replace("text", F.lit("\n"), F.lit("\n\n"))))


def chunk_validity_ids(spark, sf_dir):
    return chunks.indexable(chunks.structural(_docs(spark, sf_dir)), "doc_id").select("doc_id", "id", "chunk_index", "chunk_type", "chunk_total", F.length("chunk").alias("n_chars"))


def _strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def _sentences(x: str) -> str:
    return rf"string_split(regexp_replace({x}, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))"


def _tail(x: str) -> str:
    s = _sentences(_strip(x))
    return f"(case when len({s}) <= 2 then right({x}, 400) else {s}[-2] || ' ' || {s}[-1] end)"


def _fold(parts: str, joint: str, large: bool) -> str:
    """DuckDB's form of the chunker's fold over a list of texts."""
    empty = "struct_pack(now := '', out := []::varchar[])"
    states = f"list_transform({parts}, lambda p: struct_pack(now := p, out := []::varchar[]))"
    a = "aa" if large else "bb"
    x = "xx" if large else "yy"
    step = f"case when length({a}.now) + length({x}.now) <= 1500 then struct_pack(now := {a}.now || {joint} || {x}.now, out := {a}.out) else struct_pack(now := {_tail(a + '.now')} || {joint} || {x}.now, out := list_append({a}.out, {_strip(a + '.now')})) end"
    if large:
        step = f"case when length({x}.now) > 1500 then struct_pack(now := {a}.now, out := list_concat({a}.out, {_finished(_sentence_fold(x + '.now'))})) else {step} end"
    return f"list_reduce({states}, lambda {a}, {x}: {step}, {empty})"


def _finished(state: str) -> str:
    return f"list_transform([{state}], lambda st: case when {_strip('st.now')} = '' then st.out else list_append(st.out, {_strip('st.now')}) end)[1]"


def _sentence_fold(x: str) -> str:
    return _fold(_sentences(x), "' '", False)


def _structural_sql(source: str) -> str:
    blocks = rf"list_filter(list_transform(regexp_split_to_array(text, '\n\s*\n'), lambda b: {_strip('b')}), lambda b: b <> '')"
    return f"select doc_id, case when length(text) < 1500 then 'full_document' else 'general' end as chunk_type, unnest(case when length(text) < 1500 then [text] else {_finished(_fold(blocks, 'chr(10)', True))} end) as chunk, unnest(case when length(text) < 1500 then [0] else range(0, 100000)[1:len({_finished(_fold(blocks, 'chr(10)', True))})] end)::int as chunk_index from {source}"


WINDOWS_SQL = """
select doc_id, i::int as chunk_index, substr(text, (i * 600 + 1)::bigint, 800) as chunk
from (select doc_id, text, unnest(case when length(text) = 0 then [] when length(text) <= 800 then [0] else range(0, ceil(length(text) / 600)::bigint) end) as i from documents where text is not null)
"""
CHILDREN_SQL = """
with p as (select doc_id, i, substr(text, (i * 2500 + 1)::bigint, 2500) as parent from (select doc_id, text, unnest(range(0, ceil(length(text) / 2500)::bigint)) as i from documents where length(text) > 0)),
c as (select doc_id, i, parent, unnest(case when length(parent) <= 800 then [0] else range(0, ceil(length(parent) / 600)::bigint) end) as j from p)
select doc_id, i::int as parent_index, (row_number() over (partition by doc_id order by i, j) - 1)::int as child_index, substr(parent, (j * 600 + 1)::bigint, 800) as child, length(parent)::int as parent_chars from c
"""
_SIGNS_SQL = ", ".join(f"struct_pack(at := len(regexp_extract(chunk, '^(?s)(.*?)({sign})', 1)), nth := {i}, name := case when regexp_matches(chunk, '{sign}') then '{name}' end)" for i, (name, sign) in enumerate(SECTION_SIGNS["legal"].items()))
SECTIONS_SQL = f"""
with signed as (select doc_id, case when doc_id % 5 = 0 then 'Vu le pourvoi. ' else '' end || text || case doc_id % 3 when 0 then ' PAR CES MOTIFS. Attendu que' when 1 then ' Sur la recevabilité' else '' end as text from documents),
w as ({WINDOWS_SQL.replace('from documents', 'from signed')})
select doc_id, chunk_index, coalesce(list_sort(list_filter([{_SIGNS_SQL}], lambda s: s.name is not null))[1].name, 'general') as chunk_type from w
"""
STRUCTURAL_SQL = _structural_sql("documents")
PARAGRAPHS_SQL = _structural_sql("(select doc_id, replace(text, chr(10), chr(10) || chr(10)) as text from documents)")
VALID_SQL = f"""
with c as ({STRUCTURAL_SQL}), k as (select * from c where length({_strip('chunk')}) >= 50)
select doc_id, doc_id || '_chunk_' || (row_number() over (partition by doc_id order by chunk_index) - 1) as id, chunk_index, chunk_type, count(*) over (partition by doc_id) as chunk_total, length(chunk)::int as n_chars from k
"""


def section_types(spark, sf_dir):
    """Chunks of documents in which signs of sections stand before and after the text."""
    after = F.when(F.col("doc_id") % 3 == 0, " PAR CES MOTIFS. Attendu que").when(F.col("doc_id") % 3 == 1, " Sur la recevabilité").otherwise(F.lit(""))
    before = F.when(F.col("doc_id") % 5 == 0, "Vu le pourvoi. ").otherwise(F.lit(""))
    docs = _docs(spark, sf_dir).withColumn("text", F.concat(before, "text", after))
    return chunks.with_sections(chunks.windows(docs, 800, 200).withColumn("chunk_type", F.lit("general")), "legal").select("doc_id", "chunk_index", "chunk_type")


# metadata


def _meta_docs(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents")
    section = F.when(F.col("lang") == "fr", "motifs").when(F.col("lang") == "de", "historique").otherwise("general")
    return docs.withColumn("section", section).withColumn("verdict", F.when(F.col("doc_id") % 3 == 0, "REJET").when(F.col("doc_id") % 3 == 1, "null").otherwise(F.lit("Autre")))


def enriched_chunks(spark, sf_dir):
    docs = _meta_docs(spark, sf_dir)
    meta = {"juridiction": F.when(F.col("doc_id") % 5 != 0, F.col("source")), "date_decision": F.when(F.col("doc_id") % 2 == 0, F.lit("2024-03-15")), "dispositif": metadata.outcome(F.col("verdict"))}
    return docs.select("doc_id", metadata.enriched(F.col("text"), meta, F.col("section"), "legal").alias("chunk"))


def enriched_by_domain(spark, sf_dir):
    """Domains without a reference prefix, and one with it."""
    docs = _meta_docs(spark, sf_dir)
    meta = {"reference_complete": F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("Réf. "), "source")), "juridiction": F.col("source"), "dispositif": metadata.outcome(F.col("verdict"))}
    each = [F.struct(F.lit(d).alias("domain"), metadata.enriched(F.col("text"), meta, F.col("section"), d).alias("chunk")) for d in (*metadata.NO_REFERENCE, "technique")]
    return docs.select("doc_id", F.explode(F.array(*each)).alias("x")).select("doc_id", "x.domain", "x.chunk")


BY_DOMAIN_SQL = f"""
with d as (select *, case when lang = 'fr' then 'motifs' when lang = 'de' then 'historique' else 'general' end as section, case doc_id % 3 when 0 then 'Rejet' when 1 then null else 'Autre' end as verdict from documents),
p as (select doc_id, text, domain, concat_ws(' | ', case when domain = 'technique' then case when doc_id % 2 = 0 then 'Réf. ' || source else source end end, 'Résultat: ' || verdict, case when section <> 'general' then 'Section: ' || section end) as prefix from d, (select unnest({[*metadata.NO_REFERENCE, "technique"]}) as domain))
select doc_id, domain, case when prefix = '' then text else '[' || prefix || ']' || chr(10) || chr(10) || text end as chunk from p
"""
ENRICHED_SQL = """
with d as (select *, case when lang = 'fr' then 'motifs' when lang = 'de' then 'historique' else 'general' end as section, case doc_id % 3 when 0 then 'Rejet' when 1 then null else 'Autre' end as verdict from documents),
p as (select doc_id, text, concat_ws(' | ', case when doc_id % 5 <> 0 then source || case when doc_id % 2 = 0 then ', 2024-03-15' else '' end end, 'Résultat: ' || verdict, case when section <> 'general' then 'Section: ' || section end) as prefix from d)
select doc_id, case when prefix = '' then text else '[' || prefix || ']' || chr(10) || chr(10) || text end as chunk from p
"""


def outcome_and_vote(spark, sf_dir):
    docs = _meta_docs(spark, sf_dir)
    spelled = F.element_at(F.array(*[F.lit(x) for x in ("ADOPTE", "rejeté", "Unanimite", "other")]), (F.col("doc_id") % 4 + 1).cast("int"))
    return docs.select("doc_id", metadata.outcome(F.col("verdict")).alias("outcome"), metadata.vote(spelled).alias("vote"))


OUTCOME_SQL = """
select doc_id, case doc_id % 3 when 0 then 'Rejet' when 1 then 'null' else 'Autre' end as outcome, case doc_id % 4 when 0 then 'Adopté' when 1 then 'Rejeté' when 2 then 'Unanimité' else 'other' end as vote from documents
"""


def metadata_strings(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents").withColumn("parties", F.when(F.col("doc_id") % 2 == 0, F.array("lang", "source")))
    m = metadata.stringified({"source": (F.col("source"), "string"), "n_chars": (F.col("n_chars"), "bigint"), "lang": (F.when(F.col("lang") != "en", F.col("lang")), "string"), "parties": (F.col("parties"), "array<string>")})
    return docs.select("doc_id", F.to_json(m).alias("metadata"))


METADATA_SQL = """
select doc_id, '{"source":"' || source || '","n_chars":"' || n_chars || '"' || case when lang <> 'en' then ',"lang":"' || lang || '"' else '' end || ',"parties":"' || case when doc_id % 2 = 0 then '[\\"' || lang || '\\",\\"' || source || '\\"]' else '[]' end || '"}' as metadata from documents
"""


def metadata_where(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents")
    m = F.create_map(F.lit("lang"), F.col("lang"), F.lit("source"), F.col("source"))
    rule = {"$or": [{"lang": {"$in": ["fr", "es"]}}, {"$and": [{"source": "src1"}, {"lang": {"$ne": "de"}}]}], "source": {"$contains": "1"}}
    own = {"lang": F.col("lang"), "source": F.col("source")}
    return docs.where(metadata.where(m, rule, own)).select("doc_id", "lang", "source")


def metadata_where_numbers(spark, sf_dir):
    """Numbers that are stored as texts, and a column of numbers."""
    docs = _t(spark, sf_dir, "documents").withColumn("m", F.create_map(F.lit("words"), F.size(F.split("text", " ")).cast("string"), F.lit("lang"), F.col("lang")))
    rule = {"words": {"$gt": 9, "$lte": 400.5}, "n_chars": {"$gte": 100}, "$or": [{"lang": {"$in": ["fr", "de"]}}, {"words": {"$nin": [100, 200]}}]}
    return docs.where(metadata.where(F.col("m"), rule, {"n_chars": F.col("n_chars")}, ("n_chars",))).select("doc_id", "lang", "n_chars")


WHERE_NUMBERS_SQL = """
with d as (select *, len(string_split(text, ' ')) as words from documents)
select doc_id, lang, n_chars from d where words > 9 and words <= 400 and n_chars >= 100 and (lang in ('fr', 'de') or words not in (100, 200))
"""
WHERE_SQL = "select doc_id, lang, source from documents where (lang in ('fr', 'es') or (source = 'src1' and lang <> 'de')) and contains(source, '1')"


def source_contains(spark, sf_dir):
    return _t(spark, sf_dir, "documents").where(F.contains(F.lower("source"), F.lower(F.lit("SRC1")))).select("doc_id", "source", text.preview(F.col("text"), 300).alias("preview"))


CONTAINS_SQL = "select doc_id, source, case when length(text) > 300 then substr(text, 1, 300) || '...' else text end as preview from documents where contains(lower(source), 'src1')"


def collection_counts(spark, sf_dir):
    return _t(spark, sf_dir, "documents").groupBy(F.col("source").alias("name")).agg(F.count("*").alias("n"))


def get_by_ids(spark, sf_dir):
    items = _t(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"))
    return _t(spark, sf_dir, "documents").join(items, "doc_id", "left_semi").select("doc_id", "source", "n_chars")


def preview(spark, sf_dir):
    return _docs(spark, sf_dir).orderBy("doc_id").limit(20).select("doc_id", text.preview(F.col("text"), 200, always=True).alias("preview"))


def document_ids(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents").withColumn("path", F.concat(F.lit("/corpus/"), F.col("source"), F.lit("."), F.col("doc_id").cast("string"), F.lit(".json")))
    return docs.select("doc_id", chunks.document_id(F.lit("json"), F.col("path"), F.sha2("text", 256)).alias("document_id"))


IDS_SQL = "select doc_id, 'json_' || source || '.' || doc_id || '_' || substr(sha256('/corpus/' || source || '.' || doc_id || '.json:' || sha256(text)), 1, 8) as document_id from documents"


# dates, labels, JSON


def french_dates(spark, sf_dir):
    orders = _t(spark, sf_dir, "orders")
    return orders.select("o_orderkey", text.french_date(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")).alias("french"))


FRENCH_SQL = f"select o_orderkey, day(o_orderdate) || ' ' || {text.MONTHS!r}[month(o_orderdate)] || ' ' || year(o_orderdate) as french from orders"


def iso_date_check(spark, sf_dir):
    orders = _t(spark, sf_dir, "orders")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    spelled = F.when(F.col("o_orderkey") % 4 == 0, day).when(F.col("o_orderkey") % 4 == 1, F.left(day, F.lit(7))).when(F.col("o_orderkey") % 4 == 2, F.replace(day, F.lit("-"))).otherwise(F.concat(F.left(day, F.lit(8)), F.lit("32")))
    date = metadata.valid_date(spelled)
    return orders.select("o_orderkey", spelled.alias("given"), date.alias("valid"), metadata.year(F.lit(None).cast("string"), date).alias("year"))


ISO_SQL = """
with d as (select o_orderkey, strftime(o_orderdate, '%Y-%m-%d') as d from orders),
g as (select o_orderkey, case o_orderkey % 4 when 0 then d when 1 then substr(d, 1, 7) when 2 then replace(d, '-', '') else substr(d, 1, 8) || '32' end as given from d)
select o_orderkey, given, case when o_orderkey % 4 in (0, 2) then given end as valid, case when o_orderkey % 4 in (0, 2) then substr(given, 1, 4) end as year from g
"""


def key_labels(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents")
    key = F.concat(F.col("lang"), F.lit("_of "), F.col("source"), F.lit("'s_x2Y"))
    value = F.left("text", F.lit(20))
    return docs.select("doc_id", text.label(key).alias("label"), text.is_structured(F.col("lang"), value).alias("structured"))


LABELS_SQL = "select doc_id, upper(lang[1]) || lang[2:] || ' Of S' || source[2:] || '''S X2Y' as label, not contains(substr(text, 1, 20), ' ') as structured from documents"


def json_props(spark, sf_dir):
    events = _t(spark, sf_dir, "events").select("event_id", "props")
    return events.select("event_id", markup.flatten_json(F.col("props")).alias("f")).select("event_id", F.to_json("f.metadata").alias("metadata"), F.col("f.content").alias("content"))


PROPS_SQL = """select event_id, '{"k":"' || json_extract_string(props, '$.k') || '"}' as metadata, '' as content from events"""


def _as_json(docs):
    plain = F.regexp_replace("text", "[^A-Za-z0-9 .,]", " ")
    inner = F.struct(F.col("n_chars").alias("size"), F.concat(F.lit("a text of "), "source").alias("what_it_is"))
    return F.to_json(F.struct(F.col("doc_id").cast("string").alias("ref_no"), (F.col("doc_id") % 2 == 0).alias("ok"), F.lit("2024-03-15").alias("day"), F.array("lang", "source").alias("tags"), inner.alias("more"), F.concat(F.lit("x "), plain).alias("body")))


def json_documents(spark, sf_dir):
    """Each document as a JSON file, flattened: an id, a flag, a date, a list, a nested object and a text."""
    docs = _t(spark, sf_dir, "documents")
    flat = docs.select("doc_id", markup.flatten_json(_as_json(docs)).alias("f"))
    m = lambda key: F.col("f.metadata")[key]
    return flat.select("doc_id", F.col("f.content").alias("content"), *[m(k).alias(k.replace(".", "_")) for k in ("ref_no", "ok", "day", "tags_count", "more.size", "more.what_it_is_short", "body_short")])


JSON_SQL = """
with d as (select *, 'x ' || regexp_replace(text, '[^A-Za-z0-9 .,]', ' ', 'g') as body from documents)
select doc_id, 'Day: 15 mars 2024' || chr(10) || 'Tags: ' || lang || ', ' || source || chr(10) || chr(10) || 'More:' || chr(10) || 'What It Is: a text of ' || source || chr(10) || 'Body: ' || body as content,
  doc_id::varchar as ref_no, case when doc_id % 2 = 0 then 'True' else 'False' end as ok, '2024-03-15' as day, '2' as tags_count, n_chars::varchar as more_size, 'a text of ' || source as more_what_it_is_short, case when length(body) < 100 then body end as body_short from d
"""


def json_variant_metadata(spark, sf_dir):
    """The metadata of the same files without Python."""
    docs = _t(spark, sf_dir, "documents")
    flat = docs.select("doc_id", variants.json_metadata(_as_json(docs)).alias("f"))
    m = lambda key: F.col("f.metadata")[key]
    return flat.select("doc_id", F.col("f.error").alias("error"), *[m(k).alias(k.replace(".", "_")) for k in ("ref_no", "ok", "day", "tags_count", "more.size", "more.what_it_is_short", "body_short")])


JSON_VARIANT_SQL = f"select * exclude (content), null as error from ({JSON_SQL})"


def xml_documents(spark, sf_dir):
    """Each document as an XML file, flattened."""
    docs = _t(spark, sf_dir, "documents")
    plain = F.regexp_replace("text", "[^A-Za-z0-9 .,]", " ")
    data = F.concat(F.lit('<doc lang="'), "lang", F.lit('"><reference>R '), F.col("doc_id").cast("string"), F.lit("</reference><date>1999</date><Date> 2024 </Date><p>"), plain, F.lit(" <b>"), "lang", F.lit("</b> lost</p><note>"), "source", F.lit("</note></doc>"))
    flat = docs.select("doc_id", markup.flatten_xml(data).alias("f"))
    return flat.select("doc_id", F.to_json("f.metadata").alias("metadata"), F.col("f.content").alias("content"))


XML_SQL = """
with d as (select *, trim(regexp_replace(text, '[^A-Za-z0-9 .,]', ' ', 'g')) as p from documents)
select doc_id, '{"reference":"R ' || doc_id || '","date":"2024","attr_lang":"' || lang || '"}' as metadata, case when p <> '' then p || chr(10) else '' end || '[b]: ' || lang || chr(10) || '[note]: ' || source as content from d
"""


def _as_xml(docs):
    plain = F.regexp_replace("text", "[^A-Za-z0-9 .,]", " ")
    return F.concat(F.lit('<doc lang="'), "lang", F.lit('"><reference>R '), F.col("doc_id").cast("string"), F.lit("</reference><date>1999</date><Date> 2024 </Date><p>"), plain, F.lit(" <b>"), "lang", F.lit("</b> lost</p><note>"), "source", F.lit("</note></doc>"))


def xml_element_rows(spark, sf_dir):
    """Each document as an XML file, a row for each element."""
    docs = _t(spark, sf_dir, "documents")
    rows = elements.elements(docs.select("doc_id", "lang", "source", "text"), _as_xml(docs))
    return rows.select("doc_id", "seq", "parent", "depth", "tag", elements.own_text(F.col("own")).alias("own"))


XML_ROWS_SQL = r"""
with d as (select doc_id, lang, source, trim(regexp_replace(regexp_replace(text, '[^A-Za-z0-9 .,]', ' ', 'g'), ' +', ' ', 'g')) as p from documents)
select doc_id, 0 as seq, null::int as parent, 0 as depth, 'doc' as tag, null as own from d
union all select doc_id, 1, 0, 1, 'reference', 'R ' || doc_id from d union all select doc_id, 2, 0, 1, 'date', '1999' from d union all select doc_id, 3, 0, 1, 'Date', '2024' from d
union all select doc_id, 4, 0, 1, 'p', p from d union all select doc_id, 5, 4, 2, 'b', lang from d union all select doc_id, 6, 0, 1, 'note', source from d
"""


def xml_elements_flat(spark, sf_dir):
    """Metadata and content from element rows, by grouping."""
    docs = _t(spark, sf_dir, "documents")
    flat = elements.flattened(elements.elements(docs.select("doc_id", "lang", "source", "text"), _as_xml(docs)), "doc_id")
    return flat.select("doc_id", "content", *[F.col("metadata")[k].alias(k) for k in ("reference", "date", "attr_lang")])


XML_FLAT_SQL = r"""
with d as (select *, trim(regexp_replace(text, '[^A-Za-z0-9 .,]', ' ', 'g')) as p from documents)
select doc_id, case when p <> '' then p || chr(10) else '' end || '[b]: ' || lang || chr(10) || '[note]: ' || source as content, 'R ' || doc_id as reference, '2024' as date, lang as attr_lang from d
"""


def root_namespaces(spark, sf_dir):
    """Every other document in the name space of its source."""
    docs = _t(spark, sf_dir, "documents")
    space = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit(' xmlns="urn:'), "source", F.lit('"'))).otherwise(F.lit(""))
    text = F.concat(F.lit("<doc"), space, F.lit("><p>"), F.regexp_replace("text", "[^A-Za-z0-9 .,]", " "), F.lit("</p></doc>"))
    return elements.root_namespaces(elements.elements(docs.select("doc_id", "source", "text"), text), "doc_id")


def html_tag_texts(spark, sf_dir):
    """How many elements of each tag of a page have a text of their own, and its length."""
    pages = _t(spark, sf_dir, "pages")
    own = elements.own_text(F.col("own"))
    rows = elements.elements(pages.select("page_id", "html"), F.col("html"), html=True).where("tag not in ('script', 'style')").withColumn("own", own).where("own <> ''")
    return rows.groupBy("page_id", "tag").agg(F.count("*").alias("n"), F.sum(F.length("own")).alias("n_chars"))


class _TestModel:
    """Answers with a JSON object that depends on the length of the prompt."""

    def answer(self, prompts: list[str]) -> list[str]:
        dates = ["2024-03-15", "2024-13-01", "20240315"]
        return [json.dumps({"date_decision": dates[len(p) % 3], "vote_resultat": "ADOPTE" if len(p) % 2 else "autre", "objet": p[-3:] if p[-3:].isalpha() else None}) for p in prompts]


def extracted_metadata(spark, sf_dir):
    found = extraction.extract(_docs(spark, sf_dir), "municipal", _TestModel())
    return found.select("doc_id", *[F.col("extracted")[k].alias(k) for k in ("date_decision", "annee_decision", "vote_resultat")])


EXTRACTED_SQL = f"""
with p as (select doc_id, {len(extraction.prompt_head("municipal"))} + least(length(text), {extraction.HEAD}) as n from documents)
select doc_id, case n % 3 when 0 then '2024-03-15' when 2 then '20240315' end as date_decision, case when n % 3 <> 1 then '2024' end as annee_decision, case when n % 2 = 1 then 'Adopté' else 'autre' end as vote_resultat from p
"""


def domain_prompts(spark, sf_dir):
    """The prompt of every domain, and of an unknown one."""
    docs = _docs(spark, sf_dir)
    each = [F.struct(F.lit(d).alias("domain"), context.prompt(F.left("text", F.lit(40)), F.col("doc_id").cast("string"), d).alias("prompt")) for d in (*context.ROLES, "other")]
    return docs.select("doc_id", F.explode(F.array(*each)).alias("x")).select("doc_id", "x.domain", "x.prompt")


_ROLES_SQL = ", ".join(f"('{d}', '{context.ROLES.get(d, context.ROLES['tourisme'])}')" for d in (*context.ROLES, "other"))
PROMPTS_SQL = f"""
select doc_id, domain, 'Assistant spécialisé ' || role || '. Répondre avec les seuls passages ci-dessous, sans rien inventer, en citant la source; sinon dire que l''information manque.' || chr(10) || chr(10) || '## Passages' || chr(10) || doc_id || chr(10) || chr(10) || '## Question' || chr(10) || substr(text, 1, 40) as prompt
from documents, (values {_ROLES_SQL}) r(domain, role)
"""


# paged text


def _paged(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select(F.col("source").alias("doc"), F.col("doc_id").alias("page"), "text")


def repeated_lines(spark, sf_dir):
    """A source is a document and a text a page, whose lines repeat over a fiftieth of the pages."""
    pages = _paged(spark, sf_dir)
    lines = pdf.page_lines(pages)
    return pdf.repeated_lines(lines, pages, REPEATED_SHARE)


def line_cleanup(spark, sf_dir):
    pages = _paged(spark, sf_dir)
    lines = pdf.page_lines(pages)
    return pdf.cleaned(lines, pdf.repeated_lines(lines, pages, REPEATED_SHARE)).select("doc", "page", "seq", "line")


LINES_SQL = rf"""
with l as (select source as doc, doc_id as page, unnest(range(0, len(string_split(text, chr(10)))))::int as seq, {_strip('unnest(string_split(text, chr(10)))')} as line from documents),
n as (select source as doc, count(*) as n from documents group by source having count(*) >= 3),
r as (select doc, line, count(distinct page) as pages from l where length(line) > 2 group by doc, line)
"""
REPEATED_SQL = LINES_SQL + "select doc, line, pages from r join n using (doc) where pages >= greatest(3, floor(n * 0.02::double))"
CLEANUP_SQL = LINES_SQL + r", rep as (select doc, line from r join n using (doc) where pages >= greatest(3, floor(n * 0.02::double))) select doc, page, seq, line from l anti join rep using (doc, line) where line <> '' and not regexp_full_match(line, '\d{1,4}')"


def _blocks(spark, sf_dir):
    """Blocks from the lines of documents: every other document has its lines in two columns."""
    docs = _t(spark, sf_dir, "documents")
    lines = docs.select(F.col("source").alias("doc"), F.col("doc_id").alias("page"), F.posexplode(F.split("text", "\n")).alias("block_seq", "text"))
    left = (F.col("page") % 2 == 0) | (F.col("block_seq") % 2 == 0)
    return lines.select("doc", "page", "block_seq", "text", F.lit(100.0).alias("width"), F.when(left, 5.0).otherwise(60.0).alias("x0"), F.when(left, 40.0).otherwise(95.0).alias("x1"), F.floor(F.col("block_seq") / 2).cast("double").alias("y0"), F.when(F.col("block_seq") % 7 == 6, 1).otherwise(0).alias("block_type"))


def page_layouts(spark, sf_dir):
    return pdf.layouts(_blocks(spark, sf_dir))


def reading_order(spark, sf_dir):
    return pdf.in_reading_order(_blocks(spark, sf_dir))


BLOCKS_SQL = rf"""
with u as (select source as doc, doc_id as page, unnest(range(0, len(string_split(text, chr(10))))) as q, unnest(string_split(text, chr(10))) as text from documents),
b as (select doc, page, q, text, page % 2 = 0 or q % 2 = 0 as is_left, q // 2 as y from u where q % 7 <> 6 and {_strip('text')} <> ''),
s as (select doc, page, case when count(*) >= 4 and count(*) filter (is_left) > 1 and count(*) filter (not is_left) > 1 then 'multi' else 'single' end as layout from b group by doc, page)
"""
LAYOUTS_SQL = BLOCKS_SQL + "select doc, page, layout from s"
ORDER_SQL = BLOCKS_SQL + "select doc, page, string_agg(text, chr(10) order by case when layout = 'multi' and not is_left then 1 else 0 end, y, case when layout = 'multi' then 0 when is_left then 5 else 60 end, q) as text from b join s using (doc, page) group by doc, page"


def html_flatten(spark, sf_dir):
    pages = _t(spark, sf_dir, "pages")
    return pages.select("page_id", markup.flatten_html(F.col("html")).alias("content"))


HTML_TEXTS_SQL = r"""
with c as (select page_id, regexp_replace(html, '<(script|style)[^>]*>.*?</(script|style)>', '', 'gs') as h from pages),
x as (select page_id, h, regexp_extract_all(h, '<([a-zA-Z][a-zA-Z0-9]*)(?:\s[^>]*)?>([^<]+)', 1) as tags, regexp_extract_all(h, '<([a-zA-Z][a-zA-Z0-9]*)(?:\s[^>]*)?>([^<]+)', 2) as texts from c),
u as (select page_id, unnest(range(0, len(tags))) as i, unnest(tags) as tag, trim(regexp_replace(unnest(texts), '\s+', ' ', 'g')) as own from x),
v as (select page_id, i, tag, replace(replace(replace(replace(replace(replace(own, '&copy;', '©'), '&middot;', '·'), '&quot;', chr(34)), '&lt;', '<'), '&gt;', '>'), '&amp;', '&') as own from u where own <> '')
"""
HTML_SQL = HTML_TEXTS_SQL + r"""
select page_id, coalesce(content, '') as content from pages left join (select page_id, string_agg(case when tag in ('p', 'div', 'span') then own else '[' || tag || ']: ' || own end, chr(10) order by i) as content from v group by page_id) using (page_id)
"""

HTML_TAGS_SQL = HTML_TEXTS_SQL + "select page_id, tag, count(*) as n, sum(length(own))::bigint as n_chars from v group by page_id, tag"

# vectors


def _vectors(spark, sf_dir):
    return _t(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label", "embedding")


def _questions(spark, sf_dir, every: int | None):
    v = _t(spark, sf_dir, "embeddings")
    return v.where(F.col("vec_id") % every == 0 if every else F.col("vec_id") == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))


def vector_topk(spark, sf_dir):
    return search.top_k(_vectors(spark, sf_dir), _questions(spark, sf_dir, None), 5, digits=6)


def vector_topk_batch(spark, sf_dir):
    return search.top_k(_vectors(spark, sf_dir), _questions(spark, sf_dir, 25), 5, digits=6)


def vector_ann(spark, sf_dir):
    """About the 10 nearest: an index of cells over all vectors, with as many probes as 95 % of the nearest of a sample need."""
    index = ann.IvfIndex.build(_vectors(spark, sf_dir)).tuned(10, 0.95)
    return index.search(_questions(spark, sf_dir, 25), 10, digits=6)


def vector_topk_cosine(spark, sf_dir):
    return search.top_k(_vectors(spark, sf_dir), _questions(spark, sf_dir, 25), 5, metric="cosine", digits=6)


def vector_topk_filtered(spark, sf_dir):
    return search.top_k(_vectors(spark, sf_dir).where("label = 3"), _questions(spark, sf_dir, 25), 5, digits=6)


def vector_threshold(spark, sf_dir):
    return search.within(search.top_k(_vectors(spark, sf_dir), _questions(spark, sf_dir, 25), 15, digits=6), 1.2)


def _child_results(spark, sf_dir):
    children = _vectors(spark, sf_dir).withColumn("parent_id", F.when(F.col("label") != 9, F.col("label")))
    found = search.within(search.top_k(children, _questions(spark, sf_dir, 25), 10, digits=6), 1.6)
    parents = children.where("parent_id is not null and parent_id <> 4").groupBy("parent_id").agg(F.count("*").alias("n_children"))
    return found, parents


def parent_rollup(spark, sf_dir):
    return search.parents(*_child_results(spark, sf_dir)).select("query_id", "rank", "parent_id", "n_children", "distance")


def parent_rollup_compat(spark, sf_dir):
    return search.parents(*_child_results(spark, sf_dir), compat=True).select("query_id", "rank", "parent_id", "n_children", "distance")


def _top_sql(questions: str, k: int, rows: str = "true", metric: str = "round(list_distance(v.embedding::double[], q.embedding::double[]) ^ 2, 6)") -> str:
    return f"select * from (select q.vec_id as query_id, row_number() over (partition by q.vec_id order by {metric}, v.vec_id)::int as rank, v.vec_id as id, v.label as label, {metric} as distance from embeddings v, embeddings q where {questions} and {rows}) where rank <= {k}"


TOP10_SQL = f"with c as (select *, case when label <> 9 then label end as parent_id from ({_top_sql('q.vec_id % 25 = 0', 10)}) where distance <= 1.6), nth as (select *, row_number() over (partition by query_id order by rank) as nth, count(parent_id) over (partition by query_id) > 0 as has from c), p as (select label as parent_id, count(*) as n_children from embeddings where label not in (4, 9) group by label), f as (select query_id, parent_id, min(rank) as r, min(distance) as distance from nth where has and parent_id is not null group by all), j as (select query_id, row_number() over (partition by query_id order by r)::int as rank, parent_id, n_children, distance from f join p using (parent_id))"
ALONE_SQL = " union all select query_id, rank, id as parent_id, null as n_children, distance from nth where not has"
ROLLUP_SQL = TOP10_SQL + " select query_id, rank, parent_id, n_children, distance from j" + ALONE_SQL
COMPAT_SQL = TOP10_SQL + " select j.query_id, j.rank, j.parent_id, n_children, nth.distance from j join nth on nth.query_id = j.query_id and nth.nth = j.rank" + ALONE_SQL


# text search, contexts, prompts


def _text_results(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents").select("doc_id", "source", "text")
    cut = chunks.indexable(chunks.windows(docs, 800, 200), "doc_id")
    embedder = HashedEmbedder(64)
    vectors = cut.select("id", F.col("source").alias("source_file"), F.col("chunk").alias("document"), embed(F.col("chunk"), embedder).alias("embedding"))
    asked = spark.createDataFrame([(0, QUESTION, embedder.embed([QUESTION])[0].tolist())], "query_id long, question string, query array<double>")
    return search.top_k(vectors, asked.drop("question"), 5, digits=6), asked.drop("query")


def hashed_text_search(spark, sf_dir):
    return _text_results(spark, sf_dir)[0]


def context_string(spark, sf_dir):
    return context.contexts(_text_results(spark, sf_dir)[0], most=1.9)


def prompt_string(spark, sf_dir):
    found, asked = _text_results(spark, sf_dir)
    joined = context.contexts(found, most=1.9).join(asked, "query_id")
    return joined.select("query_id", context.prompt(F.col("question"), F.col("context"), "tourisme").alias("prompt"))


def extractive_answers(spark, sf_dir):
    found, asked = _text_results(spark, sf_dir)
    return context.answers(context.contexts(found, most=1.9).join(asked, "query_id"), "tourisme").select("query_id", "answer")


# ingestion of files

#: Documents of one file, and files of one folder.
OF_A_FILE, OF_A_FOLDER = 50, 1000


def _ingested(spark, sf_dir) -> Engine:
    """The documents, written as JSON files of OF_A_FILE documents each, in a collection of its own."""
    docs = _docs(spark, sf_dir).where("text is not null")
    of_file = docs.groupBy(F.floor(F.col("doc_id") / OF_A_FILE).alias("file")).agg(F.array_sort(F.collect_list(F.struct("doc_id", "text"))).alias("d"))
    entries = F.transform("d", lambda x: F.struct(F.concat(F.lit("d"), x["doc_id"].cast("string")), F.concat(F.lit("x "), x["text"])))
    folder = place(spark, "files")
    # a file is one row; few folders are listed sooner than one for each file
    of_file.select(F.floor(F.col("file") / OF_A_FOLDER).alias("folder"), F.map_from_entries(entries).alias("docs")).write.option("maxRecordsPerFile", 1).partitionBy("folder").json(folder)
    engine = Engine(spark, f"ingested_{uuid.uuid4().hex[:12]}")
    engine.ingest_corpus(folder, update=True)
    return engine


def ingested_chunks(spark, sf_dir):
    rows = _ingested(spark, sf_dir).chunks.matching({"domain": "tourisme", "source_type": "json"})
    return rows.select("chunk_index", "chunk_total", F.md5("document").alias("md5"), F.length("document").alias("n_chars"))


def ingested_search(spark, sf_dir):
    engine = _ingested(spark, sf_dir)
    asked = spark.createDataFrame([(0, QUESTION)], "query_id long, question string")
    return engine.search(asked, 5).select("query_id", "rank", F.round("distance", 6).alias("distance"))


FILES_SQL = f"(select doc_id // {OF_A_FILE} as doc_id, chr(10) || 'Docs:' || chr(10) || string_agg('D' || doc_id || ': x ' || text, chr(10) order by doc_id) as text from documents where text is not null group by 1)"
INGESTED_SQL = f"""
with c as ({_structural_sql(FILES_SQL)}), k as (select * from c where length({_strip('chunk')}) >= 50)
select chunk_index, count(*) over (partition by doc_id) as chunk_total, md5(chunk) as md5, length(chunk)::int as n_chars from k
"""
_WORD = r"[^\s.,;:!?|]+"
TEXT_SQL = rf"""
with w as ({WINDOWS_SQL}), k as (select *, doc_id || '_chunk_' || (row_number() over (partition by doc_id order by chunk_index) - 1) as id from w where length({_strip('chunk')}) >= 50),
tok as (select id, unnest(regexp_extract_all(lower(chunk), '{_WORD}')) as t from k),
cnt as (select id, ('0x' || substr(md5(t), 1, 8))::bigint % 64 as b, count(*) as c from tok group by all),
len as (select id, sqrt(sum(c * c)) as l from cnt group by id),
qt as (select ('0x' || substr(md5(t), 1, 8))::bigint % 64 as b, count(*) as c from (select unnest(regexp_extract_all('{QUESTION}', '{_WORD}')) as t) group by all),
ql as (select sqrt(sum(c * c)) as l from qt),
dots as (select id, sum(cnt.c * qt.c) as d from cnt join qt using (b) group by id),
dist as (select k.id, source, chunk, round(case when len.l is null then 1.0 else 2 - 2 * coalesce(d, 0) / (len.l * (select l from ql)) end, 6) as distance from k left join len using (id) left join dots using (id) join documents using (doc_id)),
top as (select 0::bigint as query_id, row_number() over (order by distance, id)::int as rank, id, source as source_file, chunk as document, distance from dist qualify row_number() over (order by distance, id) <= 5)
"""
CONTEXT_SQL = TEXT_SQL + ", ctx as (select query_id, coalesce(string_agg('[Source : ' || source_file || ']' || chr(10) || document, chr(10) || chr(10) || '---' || chr(10) || chr(10) order by rank) filter (distance <= 1.9), '') as context from top group by query_id)"
_RULES = "Assistant spécialisé en tourisme. Répondre avec les seuls passages ci-dessous, sans rien inventer, en citant la source; sinon dire que l''information manque."


def rag_lexical_eval(spark, sf_dir):
    """A user turn as question, the assistant turn after it as answer, the turn before it as context."""
    turns = _t(spark, sf_dir, "conversations")
    later = lambda by, name, role: turns.where(F.col("role") == role if role else F.lit(True)).select("conv_id", (F.col("turn") - by).alias("turn"), F.col("text").alias(name))
    asked = turns.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"))
    rows = asked.join(later(1, "answer", "assistant"), ["conv_id", "turn"]).join(later(-1, "context", None), ["conv_id", "turn"], "left").na.fill("", ["context"])
    return context.lexical_scores(rows).select("conv_id", "turn", *[F.round(c, 6).alias(c) for c in ("faithfulness", "answer_relevancy", "context_precision")])


def _words_sql(x: str) -> str:
    return rf"list_distinct(list_filter(regexp_split_to_array(lower({x}), '[\s.,;:!?|]+'), lambda w: w <> ''))"


def _share_sql(x: str, y: str) -> str:
    return f"round(case when len({x}) = 0 then 0.0 else len(list_intersect({x}, {y})) / len({x}) end, 6)"


INGESTED_SEARCH_SQL = rf"""
with c as ({_structural_sql(FILES_SQL)}), k as (select doc_id || '_' || chunk_index as id, chunk from c where length({_strip('chunk')}) >= 50),
tok as (select id, unnest(regexp_extract_all(lower(chunk), '{_WORD}')) as t from k),
cnt as (select id, ('0x' || substr(md5(t), 1, 8))::bigint % 64 as b, count(*) as c from tok group by all),
len as (select id, sqrt(sum(c * c)) as l from cnt group by id),
qt as (select ('0x' || substr(md5(t), 1, 8))::bigint % 64 as b, count(*) as c from (select unnest(regexp_extract_all('{QUESTION}', '{_WORD}')) as t) group by all),
ql as (select sqrt(sum(c * c)) as l from qt),
dots as (select id, sum(cnt.c * qt.c) as d from cnt join qt using (b) group by id),
dist as (select round(case when len.l is null then 1.0 else 2 - 2 * coalesce(d, 0) / (len.l * (select l from ql)) end, 6) as distance from k left join len using (id) left join dots using (id))
select 0::bigint as query_id, row_number() over (order by distance)::int as rank, distance from dist qualify row_number() over (order by distance) <= 5
"""
EVAL_SQL = f"""
with r as (select q.conv_id, q.turn, {_words_sql('q.text')} as q, {_words_sql('a.text')} as a, {_words_sql("coalesce(c.text, '')")} as c from conversations q join conversations a on a.conv_id = q.conv_id and a.turn = q.turn + 1 and a.role = 'assistant' left join conversations c on c.conv_id = q.conv_id and c.turn = q.turn - 1 where q.role = 'user')
select conv_id, turn, {_share_sql('a', 'c')} as faithfulness, {_share_sql('q', 'a')} as answer_relevancy, {_share_sql('q', 'c')} as context_precision from r
"""

QUERIES = {
    f.__name__: f
    for f in (
        sliding_windows, parent_child_chunks, structural_chunks, structural_chunks_paragraphs, section_types, chunk_validity_ids, enriched_chunks, outcome_and_vote, metadata_strings, metadata_where, metadata_where_numbers, source_contains,
        collection_counts, get_by_ids, preview, document_ids, french_dates, iso_date_check, key_labels, json_props, json_documents, json_variant_metadata, xml_documents, xml_element_rows, xml_elements_flat, root_namespaces, html_tag_texts, extracted_metadata, domain_prompts, enriched_by_domain, repeated_lines, line_cleanup, page_layouts, reading_order, html_flatten,
        vector_topk, vector_topk_batch, vector_ann, vector_topk_cosine, vector_topk_filtered, vector_threshold, parent_rollup, parent_rollup_compat, hashed_text_search, context_string, prompt_string, extractive_answers, rag_lexical_eval, ingested_chunks, ingested_search,
    )
}
ORACLES = {
    "sliding_windows": WINDOWS_SQL,
    "parent_child_chunks": CHILDREN_SQL,
    "structural_chunks": STRUCTURAL_SQL,
    "structural_chunks_paragraphs": PARAGRAPHS_SQL,
    "chunk_validity_ids": VALID_SQL,
    "enriched_chunks": ENRICHED_SQL,
    "outcome_and_vote": OUTCOME_SQL,
    "metadata_strings": METADATA_SQL,
    "metadata_where": WHERE_SQL,
    "metadata_where_numbers": WHERE_NUMBERS_SQL,
    "source_contains": CONTAINS_SQL,
    "collection_counts": "select source as name, count(*) as n from documents group by source",
    "get_by_ids": "select doc_id, source, n_chars from documents where doc_id in (select item_id from benchmark)",
    "preview": "select doc_id, substr(text, 1, 200) || '...' as preview from documents order by doc_id limit 20",
    "document_ids": IDS_SQL,
    "french_dates": FRENCH_SQL,
    "iso_date_check": ISO_SQL,
    "key_labels": LABELS_SQL,
    "json_props": PROPS_SQL,
    "json_documents": JSON_SQL,
    "json_variant_metadata": JSON_VARIANT_SQL,
    "xml_documents": XML_SQL,
    "extracted_metadata": EXTRACTED_SQL,
    "domain_prompts": PROMPTS_SQL,
    "enriched_by_domain": BY_DOMAIN_SQL,
    "repeated_lines": REPEATED_SQL,
    "line_cleanup": CLEANUP_SQL,
    "page_layouts": LAYOUTS_SQL,
    "reading_order": ORDER_SQL,
    "html_flatten": HTML_SQL,
    "vector_topk": _top_sql("q.vec_id = 0", 5),
    "vector_topk_batch": _top_sql("q.vec_id % 25 = 0", 5),
    "vector_topk_cosine": _top_sql("q.vec_id % 25 = 0", 5, metric="round(list_cosine_distance(v.embedding::double[], q.embedding::double[]), 6)"),
    "vector_topk_filtered": _top_sql("q.vec_id % 25 = 0", 5, "v.label = 3"),
    "vector_threshold": f"select * from ({_top_sql('q.vec_id % 25 = 0', 15)}) where distance <= 1.2",
    "parent_rollup": ROLLUP_SQL,
    "parent_rollup_compat": COMPAT_SQL,
    "hashed_text_search": TEXT_SQL + "select query_id, rank, id, source_file, document, distance from top",
    "context_string": CONTEXT_SQL + "select query_id, context from ctx",
    "prompt_string": CONTEXT_SQL + f"select query_id, '{_RULES}' || chr(10) || chr(10) || '## Passages' || chr(10) || context || chr(10) || chr(10) || '## Question' || chr(10) || '{QUESTION}' as prompt from ctx",
    "extractive_answers": TEXT_SQL + "select query_id, document as answer from top where rank = 1 and distance <= 1.9",
    "rag_lexical_eval": EVAL_SQL,
    "xml_element_rows": XML_ROWS_SQL,
    "root_namespaces": "select doc_id, case when doc_id % 2 = 0 then 'urn:' || source end as root_namespace from documents",
    "section_types": SECTIONS_SQL,
    "xml_elements_flat": XML_FLAT_SQL,
    "html_tag_texts": HTML_TAGS_SQL,
    "ingested_chunks": INGESTED_SQL,
    "ingested_search": INGESTED_SEARCH_SQL,
}
