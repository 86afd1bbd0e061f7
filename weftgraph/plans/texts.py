"""Text functions, classifiers and parsers over the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.functions import text as T
from weftgraph.operators import matching, predicates, questions
from weftgraph.plans.registry import query, table
from weftgraph.sources import tables
from weftgraph.storage import stored


@query("SELECT o_orderkey, substr(sha256(o_orderkey || '|' || o_custkey), 1, 24) AS id, sha256(o_orderpriority || chr(10) || o_orderstatus) AS digest FROM orders")
def hash_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    return orders.select("o_orderkey", T.short_hash(F.col("o_orderkey"), F.col("o_custkey")).alias("id"), T.content_digest(F.col("o_orderpriority"), F.col("o_orderstatus")).alias("digest"))


@query("""SELECT p_partkey, 'urn:x:part:' || url_encode(p_name || ' #' || p_brand) AS iri, 'Brand#' || regexp_replace(p_brand, '^.*#', '') AS brand_full, regexp_replace(p_brand, '^.*#', '') AS tail,
'P-' || upper(replace(p_name, ' ', '-')) AS code, replace(p_name, ' ', '-') AS slug FROM part""")
def minted_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IRIs, local names, codes and slugs."""
    tail = T.after_last(F.col("p_brand"), "#")
    return table(spark, sf_dir, "part").select(
        "p_partkey", T.minted_iri("urn:x:", F.lit("part"), F.concat("p_name", F.lit(" #"), "p_brand")).alias("iri"), F.concat(F.lit("Brand#"), T.iri_tail(F.col("p_brand"))).alias("brand_full"), tail.alias("tail"),
        T.code_of(F.col("p_name"), "P-").alias("code"), T.slug(F.col("p_name")).alias("slug"),
    )


@query("""SELECT event_id, json_extract_string(props, '$.k')::INTEGER AS k, '{"k":' || json_extract_string(props, '$.k') || '}' AS object FROM events""")
def json_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A field of JSON texts, and the first object that a noisy answer holds."""
    noisy = F.concat(F.lit("The answer {is}: ```json\n"), "props", F.lit("``` and that was it"))
    return table(spark, sf_dir, "events").select("event_id", T.parsed_or(F.col("props"), "k int", F.lit(None))["k"].alias("k"), T.first_object_udf(noisy).alias("object"))


@query("SELECT event_id, strftime(ts + INTERVAL 8 HOUR, '%Y-%m-%d') AS day, strftime(ts + INTERVAL 8 HOUR, '%H:%M') AS minute FROM events")
def local_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    ts = F.col("ts").cast("timestamp_ntz").cast("timestamp")
    return table(spark, sf_dir, "events").select("event_id", T.local_day(ts, "Asia/Shanghai").cast("string").alias("day"), T.local_minute(ts, "Asia/Shanghai").alias("minute"))


@query("""SELECT item_id, length(n) AS n_normal, (SELECT count(DISTINCT w) FROM unnest(regexp_extract_all(n, '[a-z0-9]+')) AS t(w))::BIGINT AS n_words FROM (
SELECT item_id, regexp_replace(lower(text), '[\\s.,:;!?()''"`~\\[\\]]+', '', 'g') AS n FROM benchmark)""".replace("\\\\", "\\"))
def normal_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length of the normalised text and its Latin terms."""
    rows = table(spark, sf_dir, "benchmark").select("item_id", T.normalised(F.col("text")).alias("n"), T.terms(F.col("text")).alias("t"))
    return rows.select("item_id", F.char_length("n").cast("long").alias("n_normal"), F.size(F.filter("t", lambda w: w.rlike("^[a-z0-9]+$"))).cast("long").alias("n_words"))


@query("""SELECT p_partkey, CASE WHEN lower(p_name) LIKE '%blue%' THEN NULL WHEN lower(p_name) LIKE '%ring%' OR lower(p_name) LIKE '%bolt%' THEN 'fastener' WHEN lower(p_name) LIKE '%widget%' THEN 'device' ELSE 'other' END AS class,
CASE WHEN p_type IN ('ECONOMY', 'SMALL') THEN 'erp' WHEN p_type = 'LARGE' THEN 'manufacturing' ELSE 'cross' END AS side FROM part""")
def keyword_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered classifiers: blocked words first, then the first class that matches."""
    name = F.col("p_name")
    made = F.when(F.lower(name).contains("blue"), None).otherwise(predicates.keyword_class(name, [], [("fastener", ["Ring", "bolt"]), ("device", ["widget"])], "other"))
    return table(spark, sf_dir, "part").select("p_partkey", made.alias("class"), predicates.side_of(F.col("p_type"), {"erp": ["ECONOMY", "SMALL"], "manufacturing": ["LARGE"]}).alias("side"))


@query(r"""SELECT doc_id, concat_ws(',', CASE WHEN length(coalesce(text, '')) < 500 THEN 'too short' END, CASE WHEN NOT contains(coalesce(text, ''), '.') THEN 'missing .' END,
CASE WHEN regexp_matches(coalesce(text, ''), 'https?://') THEN 'banned https?://' END, CASE WHEN regexp_matches(coalesce(text, ''), '(?i)(api[_-]?key|secret|password|passwd|token|authorization)\s*[:=]') THEN 'secret' END) AS errors FROM documents""")
def article_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(predicates.article_errors(F.col("text"), ["."], ["https?://"]), ",").alias("errors"))


@query()
def instance_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signs of instance-level questions in all turns; tests hold the patterns against fixed questions."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(predicates.instance_signals(F.col("text")), ",").alias("signals"))


_KEYS = ("author", "keyword", "sig", "KEY", "token_2", "api%5Fkey", "monkey", "auth")


@query(r"""WITH u AS (SELECT page_id, ['author', 'keyword', 'sig', 'KEY', 'token_2', 'api%5Fkey', 'monkey', 'auth'][page_id % 8 + 1] AS k, url FROM pages)
SELECT page_id, CASE page_id % 6 WHEN 0 THEN coalesce(length(url) <= 2048 AND regexp_matches(url, '^https?://[^/?#@:]+([/?#]|$)')
  AND NOT regexp_matches(url, '(?i)[?&](access_token|api_key|apikey|auth|authorization|key|password|passwd|secret|signature|sig|token)(=|&|#|$)'), false)
WHEN 1 THEN page_id % 300 > 255 WHEN 3 THEN NOT page_id % 40 BETWEEN 16 AND 31 WHEN 4 THEN k IN ('author', 'keyword', 'token_2', 'monkey') ELSE false END AS public FROM u""")
def public_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which addresses may be cited: those of pages, and made ones with private hosts, users, and keys that are, or look like, those of credentials."""
    n = F.col("page_id")
    text = n.cast("string")
    made = F.when(n % 6 == 0, F.col("url")).when(n % 6 == 1, F.concat(F.lit("https://10."), (n % 300).cast("string"), F.lit(".0.1/x"))).when(n % 6 == 2, F.concat(F.lit("https://user@example.com/"), text))
    key = F.element_at(F.array(*map(F.lit, _KEYS)), (n % 8 + 1).cast("int"))
    made = made.when(n % 6 == 3, F.concat(F.lit("http://172."), (n % 40).cast("string"), F.lit(".1.2:80/"))).when(n % 6 == 4, F.concat(F.lit("http://h"), text, F.lit(".example.com:8080/?a=1&"), key, F.lit("=2"))).otherwise(F.concat(F.lit("http://localhost"), F.when(n % 2 == 0, ".localdomain.").otherwise("."), F.lit("/"), text))
    return table(spark, sf_dir, "pages").select("page_id", predicates.is_public_url(made).alias("public"))


MARKERS = ("the", "and", "http", "@", "password", "benchmark")


@query("""SELECT doc_id, n FROM (SELECT doc_id, """ + " + ".join(f"contains(text, '{w}')::BIGINT" for w in MARKERS) + """ AS n FROM documents WHERE text IS NOT NULL) WHERE n > 0""")
def marked_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of the markers each document holds, found in one pass."""
    words = spark.createDataFrame([(w,) for w in MARKERS], "word string")
    return matching.marker_counts(table(spark, sf_dir, "documents"), "doc_id", F.col("text"), words)


@query("""WITH w AS (SELECT DISTINCT string_split(text, ' ')[k] AS word, k FROM benchmark, (VALUES (3), (7)) v(k)), word AS (SELECT word, min(k) AS ord FROM w WHERE length(word) >= 4 GROUP BY word)
SELECT doc_id, min(word) FILTER (WHERE contains(text, word)) AS first_word, count(*) FILTER (WHERE contains(text, word)) AS held, CASE min(ord) FILTER (WHERE contains(text, word)) WHEN 3 THEN 'third' WHEN 7 THEN 'seventh' END AS class
FROM documents, word GROUP BY doc_id HAVING count(*) FILTER (WHERE contains(text, word)) > 0""")
def texts_by_word(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of benchmark items in documents, as parts of words too: the first, how many, and the class of lowest order."""
    parts = F.split("text", " ")
    every = table(spark, sf_dir, "benchmark").select(F.explode(F.array(*[F.struct(F.get(parts, F.lit(k - 1)).alias("word"), F.lit(k).alias("ord"), F.lit(c).alias("class")) for k, c in ((3, "third"), (7, "seventh"))])).alias("w")).select("w.*")
    words = stored(every.where("length(word) >= 4").groupBy("word").agg(F.min(F.struct("ord", "class")).alias("c")).select("word", "c.*"), "words")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = matching.hits(docs, "doc_id", F.col("text"), words).groupBy("doc_id").agg(F.min("word").alias("first_word"), F.count("*").alias("held"))
    return held.join(matching.first_classes(docs, "doc_id", F.col("text"), words), "doc_id")


@query(r"""SELECT DISTINCT doc_id, sha256(text) AS sha256, octet_length(encode(text))::BIGINT AS bytes, CASE WHEN length(text) = octet_length(encode(text)) AND NOT regexp_matches(text, '[\x0A-\x0D\x1C-\x1E]') THEN (octet_length(encode(text)) + 2047) // 2048 END::BIGINT AS chunks, true AS fits
FROM documents WHERE length(text) > 0""")
def chunk_utf8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of at most 2,048 bytes of every text: digest and bytes of what they make up again, and how many they are in a single line of one-byte characters."""
    T.register(spark)
    docs = table(spark, sf_dir, "documents").where("char_length(text) > 0").select("doc_id", "text").distinct()
    docs.createOrReplaceTempView("weft_texts")
    chunks = spark.sql("SELECT doc_id, xxhash64(text) AS same, char_length(text) = octet_length(text) AND NOT text RLIKE '[\\\\x0A-\\\\x0D\\\\x1C-\\\\x1E]' AS plain, c.chunk_no, c.chunk FROM weft_texts, LATERAL byte_chunks(text, 2048) AS c")
    made = chunks.groupBy("doc_id", "same", "plain").agg(F.count("*").alias("n"), F.max(F.octet_length("chunk")).alias("most"), F.array_sort(F.collect_list(F.struct("chunk_no", "chunk"))).alias("parts"))
    again = F.array_join(F.transform("parts", lambda p: p["chunk"]), "")
    return made.select("doc_id", F.sha2(again.cast("binary"), 256).alias("sha256"), F.octet_length(again).cast("long").alias("bytes"), F.when(F.col("plain"), F.col("n")).alias("chunks"), (F.col("most") <= 2048).alias("fits"))


@query("SELECT page_id, sha256(coalesce(html, '')) AS sha256 FROM pages")
def page_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of raw pages beside their text."""
    return tables.page_texts(table(spark, sf_dir, "pages")).select("page_id", "sha256")


@query()
def text_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text nodes of pages as the reader of pages keeps them; tests hold it against fixed pages."""
    return tables.page_texts(table(spark, sf_dir, "pages"))


COLOURS = ("red", "blue", "green")


@query("""WITH item(id, w) AS (SELECT DISTINCT 'q:' || string_split(p_name, ' ')[2], string_split(p_name, ' ')[2] FROM part), colour(w) AS (VALUES ('red'), ('blue'), ('green')),
asked AS (SELECT p_partkey, replace(lower('Which ' || p_name || ' is of ' || p_type), ' ', '') AS q FROM part),
scored AS (SELECT p_partkey, id, 10.0::DOUBLE * contains(q, w)::INT + 3.0::DOUBLE * (SELECT count(*) FROM colour c WHERE contains(q, c.w)) AS score FROM asked, item)
SELECT p_partkey AS qid, id AS item, score FROM (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY score DESC, id) AS k FROM scored WHERE score > 0) WHERE k = 1 AND score >= 6""")
def question_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions about parts, routed to the competency query of their kind; colours are the named entities."""
    parts = table(spark, sf_dir, "part")
    asked = parts.select(F.col("p_partkey").alias("qid"), F.concat(F.lit("Which "), "p_name", F.lit(" is of "), "p_type", F.lit("?")).alias("question"))
    word = F.split("p_name", " ")[1]
    items = parts.select(F.concat(F.lit("q:"), word).alias("id"), F.lit("in_scope").alias("bucket"), F.array(word).alias("match_terms"), F.array(F.lit("Colour")).alias("entity_types"), F.array().cast("array<string>").alias("relations")).distinct()
    names = spark.createDataFrame([("Colour", c, f"colour:{c}") for c in COLOURS], "type string, name string, id string")
    found = questions.verdicts(asked, items, names)
    return found.where("item is not null").select("qid", "item", "score")


@query("""SELECT count(*) AS total, count(*) FILTER (WHERE p_size > 20) AS non_empty, (SELECT string_agg(k::VARCHAR, ',') FROM (SELECT lpad(p_partkey::VARCHAR, 9, '0') AS k FROM part WHERE p_size > 20 ORDER BY k LIMIT 3)) AS sample FROM part""")
def field_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select(F.lpad(F.col("p_partkey").cast("string"), 9, "0").alias("id"), F.when(F.col("p_size") > 20, F.array("p_type")).otherwise(F.array(F.lit(""))).alias("v"))
    return questions.probe_field(rows, F.col("v")).withColumn("sample", F.array_join("sample", ","))
