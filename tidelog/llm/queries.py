"""Registered queries of the corpus operators, and their SQL where it exists.

Each query applies its operator to the whole table it is meant for and
derives digest columns from the operator's result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm import chat, decontaminate, jaccard, licenses, pieces, pii, quality, topk, urlfilter, warc
from tidelog.llm.common import scratch, table


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write every page to WARC archives in the shared folder and read them back."""
    path = scratch(spark, "warc")
    warc.write(table(spark, sf_dir, "pages"), path)
    return warc.read(spark, path, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")


def tokenizer_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and decode every document."""
    model = tokenizer_model()
    done = pieces.decode(pieces.encode(table(spark, sf_dir, "documents"), model), model)
    return done.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("text", 256).alias("decoded_sha256"),
    )


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four-word shingles, linked at a Jaccard similarity of 0.85."""
    return jaccard.jaccard_join(table(spark, sf_dir, "documents"), k=4, percent=85)


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document; counts and digest are of the pattern spans."""
    found = pii.find(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["base"])
    kinds = F.transform(base, lambda s: s["kind"])
    counts = [F.size(F.array_remove(kinds, k)).cast("bigint") for k in pii.KINDS]
    counts = [(F.size(kinds).cast("bigint") - n).alias(f"n_{k}") for k, n in zip(pii.KINDS, counts, strict=True)]
    return found.select("doc_id", *counts, F.sha2(pii.spans_text(base), 256).alias("base_sha256"), pii.spans_text(F.col("spans")).alias("spans"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License notices in every document."""
    found = licenses.scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.size("matches").cast("bigint").alias("n_matches"), licenses.matches_text(F.col("matches")).alias("matches"))


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best other rows of every vector whose id is divisible by 100."""
    rows = table(spark, sf_dir, "embeddings")
    return topk.top_k(rows, rows.where("vec_id % 100 = 0"), 10)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fit on the labelled rows outside the held-out fold, score every document."""
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.classify(docs, model).select("doc_id", quality.held_out().alias("held_out"), "score", "predicted")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark items that each document contains."""
    found = decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        (F.size("hits") > 0).alias("contaminated"),
        F.size("hits").cast("bigint").alias("n_items"),
        F.array_join(F.col("hits.item_id").cast("array<string>"), ",").alias("item_ids"),
        F.coalesce(F.array_max("hits.words"), F.lit(0)).cast("bigint").alias("most_words"),
    )


#: The rules of the contract, as host, path and action.
URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judge every page's url by the rules; without a rule it is allowed."""
    rules = spark.createDataFrame(URL_RULES, "host string, path string, action string")
    return urlfilter.judge(table(spark, sf_dir, "pages"), rules)


_PROBE = "\\### Assistant: </turn> ok"


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Format all conversations and one full of control strings; read them back."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-7, 0, "user", _PROBE), (-7, 1, "assistant", _PROBE)], turns.schema)
    back = chat.read_conversations(chat.format_conversations(turns.unionByName(probe)))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss_text").cast("bigint").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_warc": op1_warc,
        "op2_sentencepiece": op2_sentencepiece,
        "op3_jaccard_join": op3_jaccard_join,
        "op4_pii": op4_pii,
        "op5_license_scan": op5_license_scan,
        "op6_topk": op6_topk,
        "op7_quality": op7_quality,
        "op8_decontaminate": op8_decontaminate,
        "op9_url_filter": op9_url_filter,
        "op10_chat_format": op10_chat_format,
    }


OP1_SQL = """
WITH p AS (SELECT page_id, url, coalesce(html, '') AS html FROM pages),
     d AS (SELECT *, sha1(html) AS hex, max(page_id) OVER (PARTITION BY html) AS last FROM p),
     v AS (SELECT *, list_transform(range(4), lambda k: ('0x' || substr(hex, 1 + 10 * k, 10))::BIGINT) AS parts FROM d)
SELECT page_id,
       octet_length(encode(html))::BIGINT AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i:
           substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((parts[1 + i // 8] >> (35 - 5 * (i % 8))) & 31)::INT, 1)), '') AS payload_digest,
       CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> last THEN last END AS refers_to,
       url
FROM v
"""

OP3_SQL = r"""
WITH RECURSIVE w AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
    SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
reach AS (SELECT doc_id, doc_id AS got FROM documents UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.got),
least AS (SELECT doc_id, min(got) AS component_id FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, coalesce(k.links, 0)::BIGINT AS n_links
FROM documents d JOIN least USING (doc_id) LEFT JOIN n USING (doc_id)
LEFT JOIN (SELECT a AS doc_id, count(*) AS links FROM links GROUP BY a) k USING (doc_id)
"""

OP6_SQL = """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
    SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
    FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score
FROM s QUALIFY rank <= 10
"""

OP9_SQL = r"""
WITH u AS (
    SELECT page_id,
           translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
           coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
    FROM pages),
r AS (
    SELECT *, CASE
        WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
        WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
        WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
        WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
        WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/' END AS rule
    FROM u)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('example.com/en/', 'net/es/', 'net/fr/') THEN 'block' ELSE 'allow' END AS verdict
FROM r
"""

OP10_SQL = r"""
WITH t AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
    UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (
    SELECT *, length(replace(replace(replace(text, '\', '\\'), '</turn>', '<\e/turn>'), '### ', '#\h## ')) AS n,
           CASE WHEN role IS DISTINCT FROM lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text)
                THEN length('### ' || role || ':') + 1 ELSE 0 END AS head
    FROM t)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(head + n + 8)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_warc": OP1_SQL, "op3_jaccard_join": OP3_SQL, "op6_topk": OP6_SQL, "op9_url_filter": OP9_SQL, "op10_chat_format": OP10_SQL}
