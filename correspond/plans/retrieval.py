"""Queries of retrieval: dates, vectors, budgets, citations, costs."""

from pyspark.sql import functions as F

from correspond.functions import text as fn
from correspond.operators import retrieval
from correspond.plans.base import MAIL, mail, query, read

#: US dollars for a million tokens of input and output, or of embedding. Fixed values.
PRICES = {"gpt-4o-mini": (0.15, 0.60), "gpt-4o": (2.50, 10.00), "gpt-5.4-mini": (0.75, 4.50)}
EMBED_PRICES = {"text-embedding-3-small": 0.02, "text-embedding-3-large": 0.13, "text-embedding-ada-002": 0.10}


@query("""SELECT event_id AS query_id, CASE k WHEN 0 THEN DATE '2026-03-16' WHEN 1 THEN DATE '2026-03-18' - n WHEN 2 THEN DATE '2026-03-18' - (n - 1) WHEN 3 THEN DATE '2026-02-01' WHEN 4 THEN make_date(2026, m, 3) WHEN 5 THEN DATE '2025-01-01' WHEN 6 THEN make_date(2020 + m, m, 9) WHEN 7 THEN (DATE '2026-03-01' - to_months(m))::DATE WHEN 8 THEN make_date(2024, m, 1) END AS start_day,
CASE k WHEN 0 THEN DATE '2026-03-22' WHEN 1 THEN DATE '2026-03-18' - n WHEN 2 THEN DATE '2026-03-18' WHEN 3 THEN DATE '2026-02-28' WHEN 4 THEN make_date(2026, m, 3 + n) WHEN 5 THEN DATE '2025-12-31' WHEN 6 THEN make_date(2020 + m, m, 9) WHEN 7 THEN last_day((DATE '2026-03-01' - to_months(m))::DATE) WHEN 8 THEN last_day(make_date(2024, m, 1)) END AS end_day
FROM (SELECT event_id, (event_id % 10)::INTEGER AS k, (event_id % 20 + 1)::INTEGER AS n, (event_id % 12 + 1)::INTEGER AS m FROM events)""")
def parse_date_range(spark, d):
    """Questions with date phrases of ten kinds (the last without one), made from events."""
    e = read(spark, d, "events")
    n, m, k = F.col("event_id") % 20 + 1, F.col("event_id") % 12 + 1, F.col("event_id") % 10
    phrases = [F.lit("이번 주 메일"), F.format_string("%d일 전 메일", n), F.format_string("최근 %d일", n), F.lit("지난 달에 온 것"), F.format_string("%d월 3일 ~ %d일", m, n + 3), F.lit("작년 요약"), F.format_string("%d-%02d-09 메일", m + 2020, m), F.format_string("%d달 전", m), F.format_string("2024년 %d월", m), F.lit("안녕")]
    text = F.element_at(F.array(*phrases), (k + 1).cast("int"))
    r = retrieval.date_range(text, "2026-03-18")
    return e.select(F.col("event_id").alias("query_id"), r["start"].alias("start_day"), r["end"].alias("end_day"))


@query(f"WITH {MAIL}, q AS (SELECT c_custkey AS query_id, DATE '1996-01-01' + (c_custkey % 700)::INTEGER AS s, DATE '1996-01-01' + (c_custkey % 700)::INTEGER + 2 AS e FROM customer WHERE c_custkey % 100 = 0) SELECT query_id, account, mail_id, mail_date::DATE AS day FROM q JOIN mail ON mail_date::DATE BETWEEN s AND e")
def date_range_retrieval(spark, d):
    """Ranges of three days, asked for by every hundredth customer, x the mails of all accounts."""
    start = F.date_add(F.lit("1996-01-01").cast("date"), (F.col("c_custkey") % 700).cast("int"))
    q = read(spark, d, "customer").where("c_custkey % 100 = 0").select(F.col("c_custkey").alias("query_id"), start.alias("start"), F.date_add(start, 2).alias("end"))
    return retrieval.in_ranges(q, mail(spark, d, replies=False)).select("query_id", "account", "mail_id", "day")


@query("""WITH s AS (SELECT q.vec_id AS query_id, v.vec_id AS id, list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) AS c FROM embeddings q, embeddings v WHERE q.vec_id % 100 = 0),
k AS (SELECT query_id, id, round(c, 6) AS similarity, row_number() OVER (PARTITION BY query_id ORDER BY c DESC, id) AS rank FROM s) SELECT * FROM k WHERE rank <= 30""")
def vector_topk(spark, d):
    """Every hundredth vector asks for its 30 nearest among all."""
    v = read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    q = v.where("id % 100 = 0").select(F.col("id").alias("query_id"), "embedding")
    return retrieval.vector_topk(v, q).withColumn("similarity", F.round("similarity", 6)).select("query_id", "id", "similarity", "rank")


@query("""WITH s AS (SELECT q.vec_id AS query_id, v.vec_id AS id, list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) AS c FROM embeddings q, embeddings v WHERE q.vec_id % 100 = 0),
f AS (SELECT query_id, id FROM (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY c DESC, id) AS r FROM s) WHERE r <= 30),
l AS (SELECT l_suppkey AS source, l_partkey % 500 AS target, sum(l_quantity) AS weight FROM lineitem GROUP BY 1, 2),
m AS (SELECT DISTINCT query_id, source, target, weight FROM f JOIN l ON id = source OR id = target),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY weight DESC, source, target) AS rank FROM m) SELECT query_id, source, target, weight, rank FROM k WHERE rank <= 30""")
def relationship_topk(spark, d):
    """The heaviest links around the nearest entities of each query."""
    v = read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    found = retrieval.vector_topk(v, v.where("id % 100 = 0").select(F.col("id").alias("query_id"), "embedding"))
    links = read(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("source"), (F.col("l_partkey") % 500).alias("target")).agg(F.sum("l_quantity").alias("weight"))
    return retrieval.top_relationships(found, links)


@query("WITH p AS (SELECT source, doc_id, n_chars, (doc_id * 7 % 101) AS score FROM documents), u AS (SELECT *, sum(n_chars) OVER (PARTITION BY source ORDER BY score DESC, doc_id ROWS UNBOUNDED PRECEDING)::BIGINT AS upto FROM p WHERE score > 0) SELECT source, doc_id, score, upto, row_number() OVER (PARTITION BY source ORDER BY upto, doc_id) AS rank FROM u WHERE upto <= 20000")
def global_reduce(spark, d):
    """Points of partial answers by score, as many as a budget holds."""
    points = read(spark, d, "documents").select("source", "doc_id", "n_chars", (F.col("doc_id") * 7 % 101).alias("score"))
    return retrieval.best_within_budget(points, ["source"], "score", "n_chars", 20000, "doc_id").select("source", "doc_id", "score", "upto", "rank")


@query("SELECT source, doc_id, upto FROM (SELECT source, doc_id, sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING)::BIGINT AS upto FROM documents) WHERE upto <= 30000")
def context_budget(spark, d):
    return retrieval.within_budget(read(spark, d, "documents").select("source", "doc_id", "n_chars"), ["source"], "n_chars", 30000, "doc_id").select("source", "doc_id", "upto")


@query("WITH b AS (SELECT source, doc_id, n_chars, ((sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) - n_chars) // 10000)::INTEGER AS batch FROM documents) SELECT source, batch, count(*) AS reports, sum(n_chars)::BIGINT AS size, max(doc_id) AS last FROM b GROUP BY 1, 2")
def report_batches(spark, d):
    """Reports packed into batches of a budget: one row a batch."""
    b = retrieval.batches(read(spark, d, "documents").select("source", "doc_id", "n_chars"), ["source"], "n_chars", 10000, "doc_id")
    return b.groupBy("source", "batch").agg(F.count("*").alias("reports"), F.sum("n_chars").alias("size"), F.max("doc_id").alias("last"))


def _answers(spark, d):
    k = F.col("o_orderkey")
    answer = F.when(k % 5 == 0, "nothing here").otherwise(F.format_string("See [Data: x] **ID: M%d@example.com).** then\nID: 2\nand ID: m%d@example.com, and ID: m%d@example.com]》. (ID: 』(m%d@x'」; )", k, k + 1, k, k))
    return read(spark, d, "orders").select(k.alias("query_id"), answer.alias("answer"), F.format_string("ID: ctx%d@example.com", k).alias("context"))


@query("""WITH a AS (SELECT o_orderkey AS k FROM orders) SELECT k AS query_id, 0 AS place, CASE WHEN k % 5 = 0 THEN 'ctx' || k || '@example.com' ELSE 'M' || k || '@example.com' END AS cited FROM a
UNION ALL SELECT k, 1, 'm' || (k + 1) || '@example.com' FROM a WHERE k % 5 <> 0 UNION ALL SELECT k, 2, 'm' || k || '@example.com' FROM a WHERE k % 5 <> 0 UNION ALL SELECT k, 3, '(m' || k || '@x'||chr(39) FROM a WHERE k % 5 <> 0""")
def extract_citations(spark, d):
    rows = _answers(spark, d).withColumn("answer", F.regexp_replace(F.col("answer"), r"\*+|#+", ""))
    return retrieval.citations(rows)


@query(r"SELECT o_orderkey AS query_id, CASE WHEN o_orderkey % 5 = 0 THEN 'nothing here' ELSE 'See   then' || chr(10) || 'and  and  ( )' END AS shown FROM orders")
def strip_ids(spark, d):
    return _answers(spark, d).select("query_id", fn.strip_ids(F.col("answer")).alias("shown"))


@query("""WITH a AS (SELECT o_orderkey AS k, o_custkey % 4 AS t FROM orders) SELECT k AS cite_id, reverse(lpad(k::VARCHAR, 9, '0')) || '-abc@example.com' AS mail_id, t + 1 AS tier FROM a WHERE t < 3""")
def resolve_citations(spark, d):
    """Ids cited whole, by local part with another host, cut short, or not at all like a mail's."""
    o, k, t = read(spark, d, "orders"), F.col("o_orderkey"), F.col("o_custkey") % 4
    name = F.reverse(F.lpad(k.cast("string"), 9, "0"))
    mails = o.select(F.concat(name, F.lit("-abc@example.com")).alias("mail_id"), F.lit(0).alias("account_rank"), k.alias("seq"))
    cited = F.concat(name, F.when(t == 0, "-ABC@example.com").when(t == 1, "-abc@other.org").when(t == 2, "-a").otherwise("x"))
    found = retrieval.resolve(o.select(k.alias("cite_id"), cited.alias("cited")), mails)
    return found.select("cite_id", "mail_id", F.col("tier").cast("long").alias("tier"))


_TRUE = """WITH a AS (SELECT o_orderkey AS k, o_custkey AS c, o_custkey % 4 AS t, reverse(lpad(o_orderkey::VARCHAR, 9, '0')) AS name FROM orders)
SELECT k AS query_id, 'Intro' || chr(10) || '발신인: nobody' || chr(10) || chr(10) || '1. ID: ' || name || CASE t WHEN 0 THEN '-ABC@example.com' WHEN 1 THEN '-abc@other.org' WHEN 2 THEN '-a' ELSE 'x' END || ').' || chr(10)
 || '발신인: ' || CASE WHEN t < 3 THEN 'c' || c || '$2@x.com' ELSE 'wrong' END || chr(10) || '발신인: second' || chr(10) || chr(10) || 'ID: ' || name || '-abc@example.com' AS answer FROM a"""


@query(_TRUE)
def correct_senders(spark, d):
    """Answers of three paragraphs: without an id, with a wrong sender and an id of one of four kinds, and without a sender."""
    k, t = F.col("o_orderkey"), F.col("o_custkey") % 4
    name = F.reverse(F.lpad(k.cast("string"), 9, "0"))
    o = read(spark, d, "orders")
    mails = o.select(F.concat(name, F.lit("-abc@example.com")).alias("mail_id"), F.lit(0).alias("account_rank"), k.alias("seq"), F.format_string("c%d$2@x.com", "o_custkey").alias("sender"))
    cited = F.concat(name, F.when(t == 0, "-ABC@example.com").when(t == 1, "-abc@other.org").when(t == 2, "-a").otherwise("x"))
    answer = F.concat(F.lit("Intro\n발신인: nobody\n\n1. ID: "), cited, F.lit(").\n발신인: wrong\n발신인: second\n\nID: "), name, F.lit("-abc@example.com"))
    return retrieval.correct_senders(o.select(k.alias("query_id"), answer.alias("answer")), mails)


@query("SELECT o_orderkey AS cite_id, 'message-id-of-archive-' || o_orderkey || '-x' AS mail_id, CASE WHEN o_custkey % 3 = 2 THEN 1 ELSE 3 END::BIGINT AS tier FROM orders")
def resolve_common_prefix(spark, d):
    """Ids that all begin alike, cited cut short, with more behind, or in capitals: what they share costs nothing."""
    o, k, t = read(spark, d, "orders"), F.col("o_orderkey"), F.col("o_custkey") % 3
    stem = F.format_string("message-id-of-archive-%d-", k)
    mails = o.select(F.concat(stem, F.lit("x")).alias("mail_id"), F.lit(0).alias("account_rank"), k.alias("seq"))
    cited = F.when(t == 0, stem).when(t == 1, F.concat(stem, F.lit("x.more"))).otherwise(F.upper(F.concat(stem, F.lit("x"))))
    found = retrieval.resolve(o.select(k.alias("cite_id"), cited.alias("cited")), mails)
    return found.select("cite_id", "mail_id", F.col("tier").cast("long").alias("tier"))


@query(f"WITH {MAIL}, c AS (SELECT o_custkey % 200 AS query_id, 'm' || o_orderkey || '@example.com' AS mail_id FROM orders) SELECT query_id, account, count(*) AS n FROM c JOIN mail USING (mail_id) GROUP BY 1, 2")
def citation_counts(spark, d):
    """Cited mails by account for each answer."""
    cited = read(spark, d, "orders").select((F.col("o_custkey") % 200).alias("query_id"), F.format_string("m%d@example.com", "o_orderkey").alias("mail_id"))
    return cited.join(mail(spark, d, replies=False).select("mail_id", "account"), "mail_id").groupBy("query_id", "account").agg(F.count("*").alias("n"))


@query("SELECT DISTINCT c_custkey AS query_id, lower(trim(' ' || n_name || ' ')) AS account FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE n_regionkey < 3")
def cited_accounts(spark, d):
    """Account names in answers, of those that exist."""
    known = read(spark, d, "nation").where("n_regionkey < 3").select(F.lower(F.trim("n_name")).alias("account"))
    named = read(spark, d, "customer").select(F.col("c_custkey").alias("query_id"), F.lower(F.trim(F.format_string(" Nation_%d ", "c_nationkey"))).alias("account"))
    return named.distinct().join(known, "account", "left_semi").select("query_id", "account")


_MODEL = "CASE event_type WHEN 'click' THEN 'gpt-4o-mini' WHEN 'view' THEN 'gpt-4o' WHEN 'error' THEN 'gpt-5.4-mini' WHEN 'purchase' THEN 'text-embedding-3-small' ELSE 'unknown' END"
_PRICE = "(VALUES ('gpt-4o-mini', 0.15::DOUBLE, 0.60::DOUBLE), ('gpt-4o', 2.50, 10.00), ('gpt-5.4-mini', 0.75, 4.50), ('text-embedding-3-small', 0.02, 0.0), ('text-embedding-3-large', 0.13, 0.0), ('text-embedding-ada-002', 0.10, 0.0)) p(model, i, o)"


def _usage(spark, d):
    t = F.col("event_type")
    model = F.when(t == "click", "gpt-4o-mini").when(t == "view", "gpt-4o").when(t == "error", "gpt-5.4-mini").when(t == "purchase", "text-embedding-3-small").otherwise("unknown")
    return read(spark, d, "events").select("event_id", "user_id", model.alias("model"), F.round(F.col("value") * 100).cast("long").alias("input_tokens"), F.round(F.col("value")).cast("long").alias("output_tokens"))


def _prices(spark):
    """The price table as a literal of six rows."""
    rows = [(m, *p) for m, p in PRICES.items()] + [(m, p, 0.0) for m, p in EMBED_PRICES.items()]
    return spark.createDataFrame(rows, "model string, i double, o double")


@query(f"WITH u AS (SELECT {_MODEL} AS model, round(value * 100)::BIGINT AS input_tokens, round(value)::BIGINT AS output_tokens FROM events), s AS (SELECT model, count(*) AS calls, sum(input_tokens)::BIGINT AS input_tokens, sum(output_tokens)::BIGINT AS output_tokens FROM u GROUP BY 1) SELECT model, calls, input_tokens, output_tokens, round((input_tokens * coalesce(i, 0) + output_tokens * coalesce(o, 0)) / 1000000, 6) AS cost_usd FROM s LEFT JOIN {_PRICE} USING (model)")
def indexing_cost(spark, d):
    """Usage of each model, and its cost; unknown models cost nothing."""
    sums = _usage(spark, d).groupBy("model").agg(F.count("*").alias("calls"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"))
    cost = (F.col("input_tokens") * F.coalesce("i", F.lit(0.0)) + F.col("output_tokens") * F.coalesce("o", F.lit(0.0))) / 1000000
    return sums.join(F.broadcast(_prices(spark)), "model", "left").select("model", "calls", "input_tokens", "output_tokens", F.round(cost, 6).alias("cost_usd"))


@query(f"WITH u AS (SELECT user_id, event_id, {_MODEL} AS model, round(value * 100)::BIGINT AS a, round(value)::BIGINT AS b, CASE event_id % 3 WHEN 0 THEN 'local' WHEN 1 THEN 'global' ELSE 'other' END AS scope FROM events) SELECT user_id, scope, sum(a)::BIGINT AS input_tokens, sum(b)::BIGINT AS output_tokens, round(sum((a * coalesce(i, 0) + b * coalesce(o, 0)) / 1000000), 6) AS cost_usd, string_agg(DISTINCT model, ',' ORDER BY model) AS models FROM u LEFT JOIN {_PRICE} USING (model) GROUP BY 1, 2")
def query_cost(spark, d):
    """The query log by user and scope, with all that is not local or global as other."""
    k = F.col("event_id") % 3
    raw = F.when(k == 0, "LOCAL").when(k == 1, "Global").otherwise("drift")
    scope = F.when(F.lower(raw).isin("local", "global"), F.lower(raw)).otherwise("other")
    rows = _usage(spark, d).withColumn("scope", scope).join(F.broadcast(_prices(spark)), "model", "left")
    cost = (F.col("input_tokens") * F.coalesce("i", F.lit(0.0)) + F.col("output_tokens") * F.coalesce("o", F.lit(0.0))) / 1000000
    return rows.groupBy("user_id", "scope").agg(F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.round(F.sum(cost), 6).alias("cost_usd"), F.array_join(F.array_sort(F.collect_set("model")), ",").alias("models"))


@query(f"WITH u AS (SELECT user_id AS query_id, event_id, {_MODEL} AS account, round(value * 100)::BIGINT AS a, round(value)::BIGINT AS b FROM events), f AS (SELECT query_id, account, min(event_id) AS first FROM u WHERE event_id % 4 <> 0 GROUP BY 1, 2), l AS (SELECT query_id, string_agg(account, ',' ORDER BY first) AS accounts FROM f GROUP BY 1) SELECT query_id, sum(a)::BIGINT AS input_tokens, sum(b)::BIGINT AS output_tokens, any_value(coalesce(accounts, '')) AS accounts FROM u LEFT JOIN l USING (query_id) GROUP BY 1")
def federated_usage(spark, d):
    """One row for each query over several accounts: usage of all, and the accounts that it cites in the order in which they first are."""
    used = _usage(spark, d).withColumnRenamed("model", "account").withColumn("query_id", F.col("user_id"))
    cited = used.where("event_id % 4 <> 0").select("query_id", F.col("event_id").alias("place"), "account")
    return retrieval.federated_usage(used, cited).withColumn("accounts", F.array_join("accounts", ","))
