"""The queries opN_<name> over the driver's tables, and their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .alignment import align
from .chat import format_chat, parse_messages
from .common import read_table
from .fingerprint import compare_with_next
from .html_extract import extract
from .langid import identify
from .lexical_search import rank_documents
from .mixing import mix
from .ngram_join import ngram_components
from .pii import find, summary
from .preference import judge_quality
from .quality import judge
from .sentencepiece_codec import encode, model_bytes
from .warc import archive_and_read


#: Tools and their parameters: name, parameter, JSON type, whether it is required.
TOOLS = [("search", "query", "string", True), ("search", "limit", "integer", False), ("calculate", "expression", "string", True), ("now", None, None, False)]


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return ngram_components(docs, n=5, percent=80).select("doc_id", "n_shingles", "component_id")


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """first_position and last_finish are where the queueing puts a document's first play, and the virtual time its last one ends."""
    m = mix(read_table(spark, sf_dir, "documents"), weights=(5, 2, 1), cap=3)
    return m.select("doc_id", "size", "source_size", "target", "taken", F.array_min("plays.position").alias("first_position"), F.array_max("plays.finish").alias("last_finish"))


def op3_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_with_next(read_table(spark, sf_dir, "documents"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every whole text, and the digest of what they decode to."""
    back = encode(read_table(spark, sf_dir, "documents"), model_bytes(), back=True)
    return back.select("doc_id", F.size("ids").cast("long").alias("n_ids"), "ids", F.sha2("text", 256).alias("decoded_sha256"))


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Schemas are those of the tools below; the given conversations hold no calls."""
    schemas = spark.createDataFrame(TOOLS, "tool string, parameter string, type string, required boolean")
    return format_chat(parse_messages(read_table(spark, sf_dir, "conversations")), schemas)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_and_read(read_table(spark, sf_dir, "pages"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(read_table(spark, sf_dir, "documents"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary(find(read_table(spark, sf_dir, "documents")))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(read_table(spark, sf_dir, "documents"))


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read_table(spark, sf_dir, "pages"))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank_documents(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"), most=20)


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(read_table(spark, sf_dir, "documents"))


def op13_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_quality(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
    "op2_source_mix": op2_source_mix,
    "op3_document_fingerprints": op3_document_fingerprints,
    "op4_sentencepiece": op4_sentencepiece,
    "op5_chat_format": op5_chat_format,
    "op6_warc": op6_warc,
    "op7_language_id": op7_language_id,
    "op8_pii": op8_pii,
    "op9_quality_rules": op9_quality_rules,
    "op10_html_extraction": op10_html_extraction,
    "op11_ranked_search": op11_ranked_search,
    "op12_token_alignment": op12_token_alignment,
    "op13_quality_classifier": op13_quality_classifier,
}

#: op1 compares all pairs that share a word sequence and closes the links by recursion. The conversations hold no calls, so
#: that op5's links are all empty.
ORACLES: dict[str, str] = {
    "op1_ngram_jaccard_join": r"""
        with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws from documents),
        s as (select distinct doc_id, array_to_string(ws[i : i + 4], ' ') as g from (select doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) as i from w where len(ws) > 0)),
        n as (select doc_id, count(*) as n from s group by 1),
        p as (select a.doc_id as a, b.doc_id as b, count(*) as k from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by 1, 2),
        l as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * k >= 80 * (x.n + y.n - k)),
        r(doc_id, c) as (select doc_id, doc_id from documents union select l.b, r.c from r join l on l.a = r.doc_id)
        select d.doc_id, coalesce(n.n, 0) as n_shingles, (select min(c) from r where r.doc_id = d.doc_id) as component_id from documents d left join n on n.doc_id = d.doc_id
    """,
    "op5_chat_format": """
        select conv_id, turn, cast(0 as bigint) as part, role, turn as order_turn, cast(0 as bigint) as order_step, false as cyclic, cast(0 as bigint) as n_calls,
          cast(0 as bigint) as n_answered, cast(0 as bigint) as n_invalid, cast(null as boolean) as linked,
          '{"content":' || to_json(text) || ',"role":' || to_json(role) || '}' as json,
          '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) as rendered
        from conversations
    """,
    "op6_warc": """
        with p as (select page_id, coalesce(html, '') as html, regexp_extract(url, '^[a-z]+://([^/?#]*)([^#]*)', ['host', 'rest']) as u from pages),
        k as (select *, concat(regexp_replace(lower(u.host), '^www[.]', ''), case when u.rest = '' then '/' else u.rest end) as key from p),
        d as (select page_id, strlen(html) as n, sha1(html) as digest, max(page_id) over (partition by html) as last, row_number() over w as capture, lag(page_id) over w as last_page_id from k window w as (partition by key order by page_id))
        select page_id, n as payload_bytes, digest as payload_digest,
          case when n >= 1000 and page_id <> last then 'revisit' else 'response' end as record_type,
          case when n >= 1000 and page_id <> last then last end as refers_to, capture, last_page_id
        from d
    """,
    "op11_ranked_search": r"""
        with w as (select doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from documents),
        n as (select doc_id, count(*) as n from w group by 1), s as (select count(*) as nd, cast(sum(n) as bigint) as l from n),
        p as (select doc_id, term, count(*) as tf from w group by 1, 2), df as (select term, count(*) as df from p group by 1),
        q as (select item_id, term, count(*) as k from (select item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from benchmark) group by 1, 2),
        x as (select q.item_id, p.doc_id, cast(sum(k * cast(floor(1000 * ln((2 * nd + 2)::double / (2 * df + 1))) as bigint) * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * nd) // l)))) as bigint) as score from q join p using (term) join df using (term) join n using (doc_id), s group by 1, 2),
        r as (select item_id, cast(row_number() over (partition by item_id order by score desc, doc_id) as int) as rank, doc_id, score from x where score > 0) select * from r where rank <= 20
    """,
}
