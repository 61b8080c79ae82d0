"""The registered query of each corpus operator, and its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packetloom.llm import alignment, bpe, collocations, decontam, fingerprints, licenses, linededup, neardup, pii, sharding, toxicity, urls, warc
from packetloom.llm.common import scratch, sorted_join, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(build):
        QUERIES[name] = build
        if sql:
            ORACLES[name] = sql
        return build
    return add


@query("op9_decontamination", r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
wins AS (
  SELECT DISTINCT item, k, hash(array_to_string(w[i + 1:i + k], ' ')) AS h, array_to_string(w[i + 1:i + k], ' ') AS g
  FROM (SELECT item, w, least(10, len(w)) AS k, unnest(range(len(w) - least(10, len(w)) + 1)) AS i FROM items WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT k FROM wins),
occ AS (
  SELECT d.doc_id, d.i, d.k, x.item
  FROM (SELECT doc_id, k, i, array_to_string(w[i + 1:i + k], ' ') AS g
        FROM (SELECT doc_id, w, k, unnest(range(greatest(0, len(w) - k + 1))) AS i FROM words, sizes)) d
  JOIN wins x ON x.k = d.k AND x.g = d.g),
hit AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM occ) GROUP BY 1),
named AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT doc_id, item FROM occ) GROUP BY 1)
SELECT words.doc_id, len(w)::BIGINT AS n_words, coalesce(hit.n, 0)::BIGINT AS n_hit, coalesce(named.n, 0)::BIGINT AS n_items,
  sha256(coalesce(s, '')) AS items_sha256, hit.n IS NOT NULL AS contaminated
FROM words LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)""")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontam.find_passages(docs, table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", F.col("hits.n_words").alias("n_words"), decontam.n_hit().alias("n_hit"),
        F.size("hits.item_ids").cast("long").alias("n_items"),
        F.sha2(sorted_join(F.col("hits.item_ids")), 256).alias("items_sha256"),
        (F.size("hits.spans") > 0).alias("contaminated"))


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


@query("op4_bpe")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    encoded = bpe.encode(docs, tokenizer_path()).select(
        "doc_id", "ids", F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"))
    return bpe.decode(encoded, tokenizer_path()).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op1_fingerprints")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    pairs = fingerprints.with_next(docs, "doc_id", ["text"])
    size = F.length("text")
    cut = F.floor(size / 4).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), size - cut), F.substring(F.col("next.text"), F.lit(1), cut))
    # texts move, sketches do not: they are made where the pairs are
    pairs = pairs.select("doc_id", size.cast("long").alias("n_chars"), "text", F.col("next.text").alias("next_text"), edited.alias("edited"))
    for text, out in (("text", "sketch"), ("next_text", "next_sketch"), ("edited", "edited_sketch")):
        pairs = fingerprints.fingerprint(pairs, text, out)
    own, other, after = F.col("sketch"), F.col("edited_sketch"), F.col("next_sketch")
    return pairs.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        fingerprints.printed(own).alias("fingerprint"), fingerprints.printed(other).alias("edited_fingerprint"),
        fingerprints.likeness(own, other).alias("near_edited"), fingerprints.likeness(own, after).alias("near_next"),
        fingerprints.resemblance(own, other).alias("jaccard_edited"), fingerprints.resemblance(own, after).alias("jaccard_next"))


URL_RULES = """SELECT * FROM VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'),
  ('block', 'net', '/es/'), ('block', 'net', '/fr/') AS r(verdict, host, path)"""


@query("op5_url_filter", r"""
WITH rules(verdict, host, path) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'),
  ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
rest AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r FROM pages),
parts AS (SELECT page_id, translate(regexp_extract(r, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
fit AS (SELECT page_id, arg_max(rules.host || rules.path, length(rules.host || rules.path)) AS rule,
  arg_max(verdict, length(rules.host || rules.path)) AS verdict
  FROM parts JOIN rules ON (parts.host = rules.host OR ends_with(parts.host, '.' || rules.host)) AND starts_with(parts.path, rules.path) GROUP BY 1)
SELECT parts.page_id, parts.host, parts.path, fit.rule, coalesce(fit.verdict, 'allow') AS verdict FROM parts LEFT JOIN fit USING (page_id)""")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urls.judge(pages, spark.sql(URL_RULES)).select("page_id", "host", "path", "rule", "verdict")


@query("op6_licenses")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return licenses.scan(docs).drop("text")


@query("op7_warc", """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
g AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS top FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 1000 AND page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id < top THEN top END AS refers_to FROM g""")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "warc")
    warc.write_archives(table(spark, sf_dir, "pages").select("page_id", "url", "html"), folder)
    page = lambda c: F.regexp_extract(c, "^urn:page:(-?[0-9]+)$", 1).try_cast("bigint")
    return warc.read_archives(spark, folder).select(
        page(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type", page(F.col("refers_to_id")).alias("refers_to"))


@query("op10_toxicity")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.scored(docs.select("doc_id", "text"), model).select(
        "doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


@query("op3_near_duplicates", r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
sets AS (SELECT DISTINCT doc_id, array_to_string(w[i + 1:i + least(5, len(w))], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(len(w) - least(5, len(w)) + 1)) AS i FROM words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY 1),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.doc_id, b FROM reach JOIN links ON a = other)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept
FROM (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY 1) LEFT JOIN sizes USING (doc_id)""")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op2_line_dedup")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), copy_share=None)


@query("op8_pii")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.pseudonymize(docs, key="corpus pseudonyms").select(
        "doc_id", "text", F.size("pii").cast("long").alias("n_found"), F.array_join(F.transform("pii", lambda p: p["kind"]), ",").alias("kinds"))


@query("op12_minimax_shards")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents").select("doc_id", "text"), shards=16).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


_PHRASES = r"""
WITH RECURSIVE pieces AS (SELECT coalesce(lang, 'und') AS lang, doc_id, row_number() OVER () AS row, unnest(string_split_regex(
  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents),
split AS MATERIALIZED (SELECT lang, list_filter(string_split_regex(p, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces),
sizes AS (SELECT lang, sum(len(w))::BIGINT AS n FROM split GROUP BY 1),
f AS MATERIALIZED (SELECT lang, k, array_to_string(w[i + 1:i + k], ' ') AS phrase, count(*) AS f
  FROM (SELECT lang, w, k, unnest(range(greatest(0, len(w) - k + 1))) AS i FROM split, range(1, 5) t(k)) GROUP BY 1, 2, 3 HAVING count(*) >= 30),
cand AS (SELECT lang, k, phrase, string_split(phrase, ' ') AS w, f AS a FROM f WHERE k > 1),
cuts AS (SELECT c.lang, c.k, c.phrase, c.a, t.j, x.f AS l, y.f AS r, (2000000::HUGEINT * c.a // (x.f + y.f))::BIGINT AS score
  FROM cand c, range(1, 4) t(j) JOIN f x ON x.lang = c.lang AND x.k = t.j AND x.phrase = array_to_string(c.w[1:t.j], ' ')
  JOIN f y ON y.lang = c.lang AND y.k = c.k - t.j AND y.phrase = array_to_string(c.w[t.j + 1:], ' ') WHERE t.j < c.k),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, k, phrase ORDER BY score, j) = 1),
inner_ AS (SELECT DISTINCT c.lang, s.m AS k, array_to_string(c.w[i + 1:i + s.m], ' ') AS phrase, c.a
  FROM (SELECT *, unnest(range(3)) AS i FROM cand) c, (VALUES (2), (3)) s(m) WHERE s.m < c.k AND i + s.m <= c.k),
held AS (SELECT lang, k, phrase, max(a) AS most FROM inner_ GROUP BY 1, 2, 3),
kept AS (SELECT b.* FROM best b LEFT JOIN held h USING (lang, k, phrase) WHERE h.most IS NULL OR 100::HUGEINT * h.most < 80::HUGEINT * b.a)
SELECT lang, rank, phrase, a, l, r, n, score FROM (
  SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r, score FROM kept) JOIN sizes USING (lang)
WHERE rank <= 2000"""


@query("op13_collocations", _PHRASES)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents").select("lang", "text"))


@query("op11_token_alignment")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return alignment.aligned_documents(docs, tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))
