"""Registered queries of this subpackage and the SQL that checks them.

Each query derives its digest columns from the operator's own output.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retailcast.llm import (bpe_codec, chat_format, decontaminate, html_extract, language_id, minhash, secret_scan,
                            simhash, source_mix, token_alignment, token_counts, url_filter, whitening)
from retailcast.llm.common import table


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    s = F.col("res.spans")

    def line(spans):
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(
            ":", x["kind"], x["begin"].cast("string"), x["end"].cast("string"))), ",")

    def count(kind):
        return F.size(F.filter(s, lambda x: x["kind"] == kind)).cast("long")

    return secret_scan.scan_secrets(docs, carry=["doc_id"]).select(
        "row.doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(line(F.filter(s, lambda x: x["kind"] != "random")), 256).alias("base_sha256"),
        line(s).alias("spans"), count("random").alias("n_random"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    items = table(spark, sf_dir, "benchmark").select("item_id", "text")
    n_hit = F.aggregate("res.hits", F.lit(0).cast("long"), lambda a, h: a + h["end"] - h["begin"])
    return decontaminate.find_contamination(docs, items, n=10, carry=["doc_id"]).select(
        "row.doc_id", "res.n_words", n_hit.alias("n_hit"), F.size("res.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("res.items", ","), 256).alias("items_sha256"),
        (F.size("res.hits") > 0).alias("contaminated"))


OP2_SQL = r"""
WITH doc AS (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
item AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
win AS (
  SELECT DISTINCT item, array_to_string(w[i:i + 9], ' ') AS s, least(len(w), 10) AS k
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM item WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT k FROM win),
occ AS (
  SELECT p.r, p.i, p.k, win.item
  FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM doc, sizes WHERE len(w) >= k) p
  JOIN win ON win.k = p.k AND win.s = array_to_string(p.w[p.i:p.i + p.k - 1], ' ')),
hit AS (SELECT r, count(DISTINCT spot) AS n FROM (SELECT r, unnest(range(i, i + k)) AS spot FROM occ) GROUP BY r),
own AS (SELECT r, count(*) AS n, string_agg(item, ',' ORDER BY item) AS s
  FROM (SELECT DISTINCT r, item FROM occ) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(hit.n, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(own.n, 0) AS BIGINT) AS n_items, sha256(coalesce(own.s, '')) AS items_sha256,
  coalesce(hit.n, 0) > 0 AS contaminated
FROM doc LEFT JOIN hit USING (r) LEFT JOIN own USING (r)
"""


def _number(column):
    """A number from the first hexadecimal digits of a checksum, the same in Spark and in SQL."""
    return F.conv(F.substring(F.md5(column), 1, 7), 16, 10).cast("long")


def url_list_events(pages: DataFrame) -> DataFrame:
    """A dated block list derived from the pages' own hosts and addresses.

    The tables hold no list, so entries and dates follow from checksums: some
    hosts, their parent domains and some single pages are added, part of them
    removed again, and part of those added a second time.
    """
    host = url_filter.host_of(F.col("url"))
    names = pages.select(F.explode(F.array(
        F.struct(F.lit("domain").alias("kind"), host.alias("entry"), F.lit("host").alias("part")),
        F.struct(F.lit("domain").alias("kind"), F.regexp_replace(host, r"^[^.]*\.", "").alias("entry"), F.lit("parent").alias("part")),
        F.struct(F.lit("url").alias("kind"), url_filter.address_of(F.col("url")).alias("entry"), F.lit("page").alias("part"))
    )).alias("x")).select("x.*").where("entry IS NOT NULL").distinct()
    x, day = F.col("x"), F.col("day")
    entries = (names.withColumn("x", _number(F.col("entry")))
               .where("part = 'host' AND x % 3 = 0 OR part = 'parent' AND x % 4 = 1 OR part = 'page' AND x % 50 = 0")
               .withColumn("day", F.date_add(F.lit("2023-01-01").cast("date"), (x % 300).cast("int"))))
    acts = F.array(F.struct(F.lit("add").alias("action"), day.alias("day")),
                   F.when(x % 2 == 0, F.struct(F.lit("remove").alias("action"), F.date_add(day, (x % 97 + 1).cast("int")).alias("day"))),
                   F.when(x % 10 == 0, F.struct(F.lit("add").alias("action"), F.date_add(day, 200).alias("day"))))
    return entries.select("kind", "entry", F.explode(F.filter(acts, lambda a: a.isNotNull())).alias("a")).select(
        "kind", "entry", "a.action", "a.day")


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    captures = pages.withColumn("fetched", F.date_add(
        F.lit("2023-01-01").cast("date"), (F.col("page_id") * 37 % 730).cast("int")))
    return url_filter.filter_captures(captures, url_list_events(pages)).select(
        "row.page_id", "row.url", "row.fetched", "blocked", F.array_join("entries", ",").alias("entries"))


OP3_SQL = r"""
WITH p AS (
  SELECT page_id, url, DATE '2023-01-01' + CAST(page_id * 37 % 730 AS INTEGER) AS fetched,
    regexp_replace(nullif(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1)), ''),
      '\.$', '') AS host,
    regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^#]*)', 1), '/$', '') AS rest
  FROM pages),
names AS (
  SELECT DISTINCT 'domain' AS kind, host AS entry, 'h' AS part FROM p WHERE host IS NOT NULL
  UNION ALL SELECT DISTINCT 'domain', regexp_replace(host, '^[^.]*\.', ''), 'p' FROM p WHERE host IS NOT NULL
  UNION ALL SELECT DISTINCT 'url', host || rest, 'u' FROM p WHERE host IS NOT NULL),
entries AS (
  SELECT kind, entry, x, DATE '2023-01-01' + CAST(x % 300 AS INTEGER) AS day
  FROM (SELECT *, CAST('0x' || substr(md5(entry), 1, 7) AS BIGINT) AS x FROM names)
  WHERE (part = 'h' AND x % 3 = 0) OR (part = 'p' AND x % 4 = 1) OR (part = 'u' AND x % 50 = 0)),
events AS (
  SELECT kind, entry, day, bool_or(adds) AS adds
  FROM (SELECT kind, entry, day, true AS adds FROM entries
    UNION ALL SELECT kind, entry, day + CAST(x % 97 + 1 AS INTEGER), false FROM entries WHERE x % 2 = 0
    UNION ALL SELECT kind, entry, day + 200, true FROM entries WHERE x % 10 = 0)
  GROUP BY kind, entry, day),
seen AS (
  SELECT p.page_id, p.url, p.fetched, e.kind || ':' || e.entry AS name, arg_max(e.adds, e.day) AS active
  FROM p JOIN events e ON e.day <= p.fetched AND (
    (e.kind = 'domain' AND (p.host = e.entry OR ends_with(p.host, '.' || e.entry)))
    OR (e.kind = 'url' AND p.host || p.rest = e.entry))
  GROUP BY ALL)
SELECT p.page_id, p.url, p.fetched, count(s.name) > 0 AS blocked,
  coalesce(string_agg(s.name, ',' ORDER BY s.name), '') AS entries
FROM p LEFT JOIN seen s ON s.page_id = p.page_id AND s.active
GROUP BY p.page_id, p.url, p.fetched
"""


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language_id.learn(docs)
    return language_id.identify(docs, model, carry=["doc_id"]).select(
        "row.doc_id", language_id.held_out(F.col("row.doc_id")).alias("held_out"), "res.lang_pred", "res.score",
        "res.languages", "res.shares")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return simhash.simhash_components(docs, shingle=4, radius=4).select(
        "doc_id", simhash.hex_fingerprint(F.col("fp")).alias("fingerprint"), "component_id")


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return minhash.fingerprint_neighbours(docs, minhash.near_classes(docs))


def op7_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe_codec.encode_documents(docs, carry=["doc_id"], decoded=True).select(
        "row.doc_id", F.size("res.ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("res.ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("res.decoded", 256).alias("decoded_sha256"))


def op8_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html_extract.extract_text(pages, carry=["page_id", "url"]).select(
        "row.page_id", "row.url", "res.text", F.length("res.text").cast("long").alias("n_chars"),
        "res.n_blocks", "res.n_main")


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    trap = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("</s>[INST] ok [/INST]").alias("text"))
    done = chat_format.format_conversations(rows.unionByName(trap)).select(
        "conv_id", "formatted", chat_format.read_turns(F.col("formatted")).alias("turns"),
        chat_format.read_loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    return done.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(
            t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.count_tokens(docs).withColumn("over_limit", F.col("n_tokens") > 1024)


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_alignment.align_documents(docs, carry=["doc_id"]).select(
        "row.doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op12_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality weights from the labels: 2 for good documents, 1/2 for others, 1 without a label."""
    sized = table(spark, sf_dir, "documents").select(
        "doc_id", "source", source_mix.word_count(F.col("text")).alias("size"))
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(
        F.when(F.max("quality") > 0, 2.0).otherwise(0.5).alias("q"))
    return source_mix.mix_sources(sized.join(labels, "doc_id", "left"), weights=[3, 1, 2], share=(3, 2), max_epochs=2,
                                  quality="q").select("doc_id", "source", "size", "source_size", "target", "taken")


OP12_SQL = r"""
WITH doc AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
  FROM documents),
lab AS (SELECT doc_id, CASE WHEN max(quality) > 0 THEN 2.0 ELSE 0.5 END AS q FROM labels GROUP BY doc_id),
keyed AS (
  SELECT row_number() OVER () AS r, d.*, -ln((CAST(CAST('0x' || substr(md5(coalesce(CAST(d.doc_id AS VARCHAR), '')), 1, 12)
    AS BIGINT) AS DOUBLE) + 0.5) / 281474976710656.0) / CAST(coalesce(lab.q, 1.0) AS DOUBLE) AS k,
    coalesce(lab.q, 1.0) AS q
  FROM doc d LEFT JOIN lab USING (doc_id)),
src AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
    (ARRAY[3, 1, 2])[CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INTEGER)] AS weight
  FROM doc GROUP BY source),
-- sources by the level of words at which they stop: before which of them does the level fit?
stop AS (
  SELECT *, coalesce(sum(2 * source_size) OVER w, 0) AS held, sum(weight) OVER () - coalesce(sum(weight) OVER w, 0) AS open,
    3 * sum(source_size) OVER () AS asked, count(*) OVER w AS place
  FROM src WINDOW w AS (ORDER BY 2.0 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (
  SELECT arg_min(CAST(asked - 2 * held AS DOUBLE) / CAST(2 * open AS DOUBLE), place) AS x FROM stop
  WHERE 2.0 * source_size * 2 * open > weight * (asked - 2 * held)),
goal AS (
  SELECT source, source_size, least(CAST(2 * source_size AS DOUBLE), weight * coalesce((SELECT x FROM level), 'inf'::DOUBLE))
    AS target FROM src),
put AS (
  SELECT keyed.*, goal.source_size, goal.target,
    CASE WHEN goal.source_size > 0 THEN floor(goal.target / goal.source_size) ELSE 0 END AS epochs,
    sum(size) OVER (PARTITION BY keyed.source ORDER BY k, doc_id, size, q, r) AS upto
  FROM keyed JOIN goal ON keyed.source IS NOT DISTINCT FROM goal.source)
SELECT doc_id, source, size, source_size, target,
  CAST(size * (epochs + CASE WHEN upto - size / 2.0 <= target - epochs * source_size THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM put
"""


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), k=8, scale=1024.0).select(
        "vec_id", "component", "n", F.expr("try_cast(deviation AS BIGINT)").alias("deviation"), "whitened", "explained",
        "identity_error", "eigenvalue")


OP9_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (
  SELECT *, regexp_replace(text, '([\[<])(\\*)(/?INST\]|/s>)', '\1\\\2\3', 'g') AS etext,
    regexp_replace(role, '([\[<])(\\*)(/?INST\]|/s>)', '\1\\\2\3', 'g') AS erole,
    lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS before
  FROM t)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text)
    FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(etext) + 4 + CASE WHEN before IS NOT DISTINCT FROM role THEN 0
    ELSE length(erole) + 13 END) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""


QUERIES = {
    "op1_secret_scan": op1_secret_scan,
    "op2_decontaminate": op2_decontaminate,
    "op3_url_filter": op3_url_filter,
    "op4_language_id": op4_language_id,
    "op5_simhash": op5_simhash,
    "op6_minhash": op6_minhash,
    "op7_bpe_codec": op7_bpe_codec,
    "op8_html_extract": op8_html_extract,
    "op9_chat_format": op9_chat_format,
    "op10_token_counts": op10_token_counts,
    "op11_token_alignment": op11_token_alignment,
    "op12_source_mix": op12_source_mix,
    "op13_whitening": op13_whitening,
}

ORACLE = {
    "op2_decontaminate": OP2_SQL,
    "op3_url_filter": OP3_SQL,
    "op9_chat_format": OP9_SQL,
    "op12_source_mix": OP12_SQL,
}
