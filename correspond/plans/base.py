"""Registration of queries, and the tables that they read as domain facts."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from correspond.operators import keywords

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with the SQL of the same result."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- orders as mails -----------------------------------------------------------

MAIL = """mail AS (
  SELECT 'acct' || c_nationkey || '@example.com' AS account, 'm' || o_orderkey || '@example.com' AS mail_id, o_orderkey AS seq,
         'cust' || c_custkey || '@example.com' AS person, c_name AS person_name, o_orderdate AS mail_date,
         CASE WHEN o_orderkey % 2 = 0 THEN 'sent' ELSE 'received' END AS direction, o_orderstatus = 'F' AS is_reply,
         CASE WHEN o_orderstatus = 'F' AND shipped >= o_orderdate THEN date_diff('second', o_orderdate, shipped) / 3600.0 END AS reply_elapsed_hours,
         CASE o_orderpriority WHEN '1-URGENT' THEN 'alert' WHEN '2-HIGH' THEN 'formal' WHEN '3-MEDIUM' THEN 'transactional' WHEN '4-NOT SPECIFIED' THEN 'notification' WHEN '5-LOW' THEN 'casual' END AS kg_tone,
         CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 3 = 0 THEN 'friendly' ELSE 'not' END AS llm_tone, 'folder' || (o_orderkey % 4) AS folder
  FROM orders JOIN customer ON c_custkey = o_custkey LEFT JOIN (SELECT l_orderkey, min(l_shipdate) AS shipped FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey)"""


def mail(spark, d, replies: bool = True) -> DataFrame:
    """The mail fact. Without `replies` the hours are not worked out, and lineitem is not read."""
    rows = read(spark, d, "orders").join(read(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    if replies:
        shipped = read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.min("l_shipdate").alias("shipped"))
        rows = rows.join(shipped, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    address = lambda kind, key: F.concat(F.lit(kind), F.col(key).cast("string"), F.lit("@example.com"))
    tones = {"1-URGENT": "alert", "2-HIGH": "formal", "3-MEDIUM": "transactional", "4-NOT SPECIFIED": "notification", "5-LOW": "casual"}
    tone = F.create_map(*(F.lit(x) for pair in tones.items() for x in pair))
    key = F.col("o_orderkey")
    hours = F.when((F.col("o_orderstatus") == "F") & (F.col("shipped") >= F.col("o_orderdate")), F.expr("timestampdiff(SECOND, o_orderdate, shipped)") / 3600.0) if replies else F.lit(None).cast("double")
    return rows.select(
        address("acct", "c_nationkey").alias("account"), address("m", "o_orderkey").alias("mail_id"), key.alias("seq"), address("cust", "c_custkey").alias("person"), F.col("c_name").alias("person_name"),
        F.col("o_orderdate").alias("mail_date"), F.when(key % 2 == 0, "sent").otherwise("received").alias("direction"), (F.col("o_orderstatus") == "F").alias("is_reply"), hours.alias("reply_elapsed_hours"),
        tone[F.col("o_orderpriority")].alias("kg_tone"), F.when(key % 5 == 0, F.lit(None)).when(key % 3 == 0, "friendly").otherwise("not").alias("llm_tone"), F.concat(F.lit("folder"), (key % 4).cast("string")).alias("folder"),
    )


# --- conversations and events as chat messages -----------------------------------

CHAT = """chat AS (
  SELECT 'room' || conv_id AS chatroom_id, turn AS seq, TIMESTAMP '2024-01-01 09:00:00' + to_days((conv_id % 60)::INTEGER) + to_minutes(7 * turn) AS dt, role AS sender, text, role = 'system' AS is_system, 'owner' || (conv_id % 7) AS owner FROM conversations)"""


def chat(spark, d) -> DataFrame:
    c = read(spark, d, "conversations")
    dt = F.expr("timestampadd(MINUTE, 7 * turn, timestampadd(DAY, conv_id % 60, TIMESTAMP_NTZ '2024-01-01 09:00:00'))")
    return c.select(F.concat(F.lit("room"), F.col("conv_id").cast("string")).alias("chatroom_id"), F.col("turn").alias("seq"), dt.alias("dt"), F.col("role").alias("sender"), "text", (F.col("role") == "system").alias("is_system"), F.concat(F.lit("owner"), (F.col("conv_id") % 7).cast("string")).alias("owner"))


TALK = """talk AS (SELECT event_type AS chatroom_id, event_id AS seq, ts AS dt, 'user' || user_id AS sender, value FROM events)"""


def talk(spark, d) -> DataFrame:
    """Messages at volume: a room for each type of event."""
    return read(spark, d, "events").select(F.col("event_type").alias("chatroom_id"), F.col("event_id").alias("seq"), F.col("ts").alias("dt"), F.concat(F.lit("user"), F.col("user_id").cast("string")).alias("sender"), "value")


# --- documents as mails with keywords ---------------------------------------------

WORDS = r"""words AS (
  SELECT 'acct' || (doc_id % 5) AS account, source AS person, DATE '2024-01-01' + (doc_id % 90)::INTEGER AS day, doc_id, w AS keyword
  FROM (SELECT doc_id, source, unnest(regexp_extract_all(lower(text), '\p{L}{6,}')) AS w FROM documents))"""


def words(spark, d) -> DataFrame:
    """(account, person, day, doc_id, keyword): a row for each word of six letters or more."""
    texts = read(spark, d, "documents").select(F.concat(F.lit("acct"), (F.col("doc_id") % 5).cast("string")).alias("account"), F.col("source").alias("person"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 90).cast("int")).alias("day"), "doc_id", "text")
    return keywords.mentions(texts)
