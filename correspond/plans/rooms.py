"""Queries on chats: parsing, blocks, counts, mood; and on mail blocks."""

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from correspond.functions import text as fn
from correspond.operators import blocks, chatlog, facts, mood, series, snapshot
from correspond.operators.tables import shared_dir
from correspond.plans.base import CHAT, MAIL, TALK, chat, mail, query, read, talk
from correspond.sources.snapshots import Snapshots

# --- mail blocks --------------------------------------------------------------------


def _raw(spark, d):
    m = mail(spark, d, replies=False)
    own, other = F.col("account"), fn.person_header(F.col("person_name"), F.col("person"))
    sent = F.col("direction") == "sent"
    return m.select(
        "account", "seq", "mail_id", F.format_string("Order %d", "seq").alias("subject"), F.when(sent, "발신").otherwise("수신").alias("direction_raw"), F.date_format("mail_date", "yyyy-MM-dd HH:mm:ss").alias("date_raw"),
        F.when(sent, own).otherwise(other).alias("sender"), F.when(sent, other).otherwise(own).alias("receiver"), F.when(F.col("folder") != "folder3", F.col("folder")).alias("folder"), F.concat(F.lit("Dear "), "person_name", F.lit(",\n\nline two")).alias("body"),
    )


_RAW = f"""{MAIL}, raw AS (SELECT account, mail_id, seq, 'Order ' || seq AS subject, CASE direction WHEN 'sent' THEN '발신' ELSE '수신' END AS direction_raw, strftime(mail_date, '%Y-%m-%d %H:%M:%S') AS date_raw,
  CASE direction WHEN 'sent' THEN account ELSE person_name || ' <' || person || '>' END AS sender, CASE direction WHEN 'sent' THEN person_name || ' <' || person || '>' ELSE account END AS receiver,
  CASE WHEN folder <> 'folder3' THEN folder END AS folder, 'Dear ' || person_name || ',' || chr(10) || chr(10) || 'line two' AS body FROM mail)"""


@query(f"WITH {_RAW} SELECT account, mail_id, subject, direction_raw, date_raw, sender, receiver, folder, body FROM raw")
def parse_mail_blocks(spark, d):
    """Mails written as blocks, and read again."""
    raw = _raw(spark, d)
    return blocks.parse_blocks(raw.select("account", "seq", blocks.render(raw).alias("text")), ["account"]).drop("seq")


@query(f"WITH {_RAW} SELECT account, seq // 100 AS file, count(*) AS n, sum(seq)::BIGINT AS checksum FROM raw GROUP BY 1, 2")
def split_blocks(spark, d):
    """Files of blocks between separators, split and parsed."""
    raw = _raw(spark, d)
    sep = F.lit(blocks.SEPARATOR + "\n")
    texts = raw.select("account", F.floor(F.col("seq") / 100).alias("file"), "seq", F.concat(sep, blocks.render(raw), F.lit("\n"), sep).alias("text"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]), "\n")
    found = blocks.split_blocks(texts.groupBy("account", "file").agg(joined.alias("text")), ["account", "file"])
    return found.groupBy("account", "file").agg(F.count("*").alias("n"), F.sum(F.regexp_extract(blocks.header(F.col("text"), "제목"), r"(\d+)", 1).cast("long")).alias("checksum"))


@query("SELECT l_orderkey AS id, max_by('line ' || l_linenumber || ' of ' || l_partkey, l_linenumber::BIGINT * 1000000000 + l_partkey) AS text FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P') GROUP BY 1")
def export_id_text(spark, d):
    """The last block of each id, of new ids alone: the rows of the id,text file."""
    rows = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), "l_linenumber", "l_partkey", F.format_string("line %d of %d", "l_linenumber", "l_partkey").alias("text"))
    new = read(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("id"))
    return rows.join(new, "id", "left_semi").groupBy("id").agg(F.max_by("text", F.struct("l_linenumber", "l_partkey")).alias("text"))


@query(f"WITH {_RAW} SELECT mail_id, subject, body FROM raw WHERE seq IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def bodies_by_ids(spark, d):
    raw = _raw(spark, d)
    ids = read(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("seq"))
    texts = raw.join(ids, "seq", "left_semi").select("mail_id", blocks.render(raw).alias("text"))
    return texts.select("mail_id", blocks.header(F.col("text"), "제목").alias("subject"), blocks.body(F.col("text"), "attachment").alias("body"))


@query(f"WITH {_RAW} SELECT account, person, mail_id, direction, subject, body, row_number() OVER (PARTITION BY account, person ORDER BY mail_date, mail_id) AS place FROM raw JOIN mail USING (account, mail_id) WHERE mail_date >= TIMESTAMP '1998-01-01' AND mail_date < TIMESTAMP '1999-01-01'")
def person_mail_bodies(spark, d):
    """The mails with each person in a range, by date, with subject and body from their blocks; mails without a block are left out."""
    refs = series.in_days(mail(spark, d, replies=False), "mail_date", "1998-01-01", "1998-12-31").select("account", "person", "mail_id", "direction", "mail_date")
    raw = _raw(spark, d)
    read_again = blocks.parse_blocks(raw.select("account", "seq", blocks.render(raw).alias("text")), ["account"]).select("account", "mail_id", "subject", "body")
    place = F.row_number().over(Window.partitionBy("account", "person").orderBy("mail_date", "mail_id"))
    return refs.join(read_again, ["account", "mail_id"]).select("account", "person", "mail_id", "direction", "subject", "body", place.alias("place"))


_QUOTES = r"""o AS (SELECT o_orderkey AS seq, o_custkey % 50 AS cust, o_orderdate + to_minutes((o_orderkey * 37) % 1440) AS t, o_orderkey % 3 = 0 AS is_reply, (o_orderkey // 3) % 7 AS form FROM orders),
head AS (SELECT *, year(t) || '년 ' || month(t) || '월 ' || day(t) || '일 ' || CASE form WHEN 5 THEN '' ELSE '(목) ' END || CASE WHEN hour(t) < 12 THEN '오전' ELSE '오후' END || ' ' || CASE hour(t) % 12 WHEN 0 THEN 12 ELSE hour(t) % 12 END || ':' || lpad(minute(t)::VARCHAR, 2, '0') AS told FROM o),
said AS (SELECT *, CASE WHEN NOT is_reply THEN 'No quote' ELSE 'Yes.' || chr(10) || CASE form WHEN 1 THEN told || ', C' || cust || '@X.com님이 작성:' WHEN 2 THEN told || ', C' || cust || '@X.com님이 작성:' || chr(10) || 'from <k@x.com>'
  WHEN 3 THEN told || ', as K <k@x.com> said' WHEN 4 THEN told || ', Lee, Kim <C' || cust || '@X.com>님이 작성:' || chr(10) || told || ', J <j@x.com>님이 작성:' ELSE told || ', 이름 <C' || cust || '@X.com>님이 작성:' END END AS body FROM head),
m AS (SELECT *, regexp_extract(body, '(\d{4}년 \d{1,2}월 \d{1,2}일[^,]+),\s*(.+?)님이 작성:', 1) AS whole, regexp_extract(body, '(\d{4}년 \d{1,2}월 \d{1,2}일[^,]+),\s*(.+?)님이 작성:', 2) AS who FROM said),
q AS (SELECT *, regexp_matches(whole, '\d{4}년 \d{1,2}월 \d{1,2}일[^(]*\([^)]+\)\s*(오전|오후)\s*\d{1,2}:\d{2}') AS found, lower(coalesce(nullif(regexp_extract(who, '<([^>]+)>', 1), ''), trim(who))) AS quote_sender FROM m)"""


def _quotes(spark, d):
    """Replies that quote the header of an earlier mail, when and by whom, in seven forms: names, bare addresses, more addresses after them, no marker, two quotes, no weekday."""
    key = F.col("o_orderkey")
    t = F.expr("timestampadd(MINUTE, (o_orderkey * 37) % 1440, o_orderdate)")
    o = read(spark, d, "orders").select(key.alias("seq"), (F.col("o_custkey") % 50).alias("cust"), t.alias("t"), (key % 3 == 0).alias("is_reply"), F.floor(key / 3) % 7)
    o = o.toDF("seq", "cust", "t", "is_reply", "form")
    half, hour = F.when(F.hour("t") < 12, "오전").otherwise("오후"), F.when(F.hour("t") % 12 == 0, 12).otherwise(F.hour("t") % 12)
    at = F.format_string("%d년 %d월 %d일 %s%s %d:%02d", F.year("t"), F.month("t"), F.dayofmonth("t"), F.when(F.col("form") == 5, "").otherwise("(목) "), half, hour, F.minute("t"))
    form, bare = F.col("form"), F.format_string("%s, C%d@X.com님이 작성:", at, F.col("cust"))
    quote = (
        F.when(form == 1, bare).when(form == 2, F.concat(bare, F.lit("\nfrom <k@x.com>"))).when(form == 3, F.concat(at, F.lit(", as K <k@x.com> said")))
        .when(form == 4, F.format_string("%s, Lee, Kim <C%d@X.com>님이 작성:\n%s, J <j@x.com>님이 작성:", at, F.col("cust"), at)).otherwise(F.format_string("%s, 이름 <C%d@X.com>님이 작성:", at, F.col("cust")))
    )
    return o.withColumn("body", F.when(F.col("is_reply"), F.concat(F.lit("Yes.\n"), quote)).otherwise("No quote"))


@query(f"WITH {_QUOTES} SELECT seq, CASE WHEN found THEN quote_sender END AS sender, CASE WHEN found THEN strftime(t, '%Y-%m-%d %H:%M') END AS minute FROM q")
def reply_quote_parse(spark, d):
    sender, minute = blocks.quoted(F.col("body"))
    return _quotes(spark, d).select("seq", sender.alias("sender"), minute.alias("minute"))


@query(f"""WITH {_QUOTES}, asked AS (SELECT 'c' || cust || '@x.com' AS s, strftime(t, '%Y-%m-%d %H:%M') AS m, max(seq) AS seq, max_by(t, seq) AS t FROM q WHERE NOT is_reply GROUP BY 1, 2),
r AS (SELECT seq, quote_sender, t FROM q WHERE found)
SELECT 'm' || r.seq AS mail_id, 'm' || asked.seq AS reply_to, round(date_diff('second', asked.t, r.t + INTERVAL 3 HOUR) / 3600.0::DOUBLE, 2) AS hours FROM r LEFT JOIN asked ON s = r.quote_sender AND m = strftime(r.t, '%Y-%m-%d %H:%M')""")
def reply_link(spark, d):
    """Mails that quote a sender and a minute, and the last mail of that sender in that minute."""
    sender, minute = blocks.quoted(F.col("body"))
    q = _quotes(spark, d)
    rows = q.select(
        F.lit("a").alias("account"), "seq", F.format_string("m%d", "seq").alias("mail_id"), F.when(~F.col("is_reply"), F.format_string("c%d@x.com", "cust")).alias("sender"), F.date_format("t", "yyyy-MM-dd HH:mm").alias("minute"),
        F.expr("CASE WHEN is_reply THEN timestampadd(HOUR, 3, t) ELSE t END").alias("mail_date"), sender.alias("quote_sender"), minute.alias("quote_minute"),
    )
    return blocks.reply_links(rows).select("mail_id", "reply_to", "hours")


@query(f"WITH {_RAW}, f AS (SELECT l_orderkey AS seq, string_agg('File ' || k || ': part ' || l_partkey, chr(10) ORDER BY k) AS files FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS k FROM lineitem) GROUP BY 1) SELECT mail_id, concat_ws(chr(10), subject, files) AS text FROM raw LEFT JOIN f USING (seq)")
def merge_attachments(spark, d):
    files = read(spark, d, "lineitem").select(F.format_string("m%d@example.com", "l_orderkey").alias("mail_id"), (F.col("l_linenumber").cast("long") * 1000000000 + F.col("l_partkey")).alias("i"), F.format_string("part %d", "l_partkey").alias("text"))
    return blocks.with_attachments(_raw(spark, d).select("mail_id", F.col("subject").alias("text")), files)


_STORED = "b AS (SELECT event_type AS room, strftime(ts, '%Y-%m-%d') || '_' || lpad((hour(ts) // 12 + 1)::VARCHAR, 2, '0') AS block_id, ts, value FROM events)"


@query(f"""WITH {_STORED}, o AS (SELECT room, block_id, count(*) AS n, 'old' AS version FROM b WHERE ts < TIMESTAMP '2024-01-20 13:00:00' GROUP BY 1, 2), n AS (SELECT room, block_id, count(*) AS n, 'new' AS version FROM b WHERE ts >= TIMESTAMP '2024-01-19' GROUP BY 1, 2),
r AS (SELECT n.room, block_id FROM n JOIN (SELECT room, max(left(block_id, 10)) AS l FROM o GROUP BY 1) x ON x.room = n.room AND left(block_id, 10) = l), k AS (SELECT * FROM o WHERE (room, block_id) NOT IN (SELECT (room, block_id) FROM r))
SELECT * FROM k UNION ALL SELECT * FROM n WHERE (room, block_id) NOT IN (SELECT (room, block_id) FROM k)""")
def incremental_merge(spark, d):
    """Stored half-day blocks and new ones that overlap them by a day: the last stored day is renewed, earlier ones stay."""
    e = read(spark, d, "events").select(F.col("event_type").alias("room"), F.concat(F.date_format("ts", "yyyy-MM-dd"), F.when(F.hour("ts") < 12, "_01").otherwise("_02")).alias("block_id"), "ts")
    old = e.where("ts < timestamp_ntz '2024-01-20 13:00:00'").groupBy("room", "block_id").agg(F.count("*").alias("n")).withColumn("version", F.lit("old"))
    new = e.where("ts >= timestamp_ntz '2024-01-19'").groupBy("room", "block_id").agg(F.count("*").alias("n")).withColumn("version", F.lit("new"))
    return blocks.incremental(old, new, "room", latest_day=True)


# --- chat ------------------------------------------------------------------------------

_LINES = r"array_to_string(list_filter(list_transform(regexp_split_to_array(coalesce(text, ''), '\n'), lambda x: regexp_replace(x, '\s+$', '')), lambda x: x <> ''), chr(10))"


@query(f"WITH {CHAT} SELECT chatroom_id, row_number() OVER (PARTITION BY chatroom_id ORDER BY seq) AS message, strftime(dt, '%Y-%m-%d %H:%M') AS at, CASE WHEN NOT is_system THEN sender END AS sender, {_LINES} AS text, is_system FROM chat")
def chat_parse(spark, d):
    """Conversations written as an export (mobile and PC lines by turns, system lines), and read again."""
    c = chat(spark, d).withColumn("text", F.coalesce("text", F.lit("")))
    half, hour = F.when(F.hour("dt") < 12, "오전").otherwise("오후"), F.when(F.hour("dt") % 12 == 0, 12).otherwise(F.hour("dt") % 12)
    clock = F.format_string("%s %d:%02d", half, hour, F.minute("dt"))
    day = F.format_string("%d년 %d월 %d일", F.year("dt"), F.month("dt"), F.dayofmonth("dt"))
    line = F.when(F.col("is_system"), F.concat(day, F.lit(" "), clock, F.lit(": "), "text")).when(F.col("seq") % 2 == 0, F.concat(day, F.lit(" "), clock, F.lit(", "), "sender", F.lit(" : "), "text")).otherwise(F.concat(F.lit("["), "sender", F.lit("] ["), clock, F.lit("] "), "text"))
    whole = F.concat(F.lit("header\n--------------- "), F.first(day), F.lit(" 월요일 ---------------\n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", line.alias("l")))), lambda x: x["l"]), "\n"))
    lines = chatlog.lines_of(c.groupBy(F.col("chatroom_id").alias("file")).agg(whole.alias("text")), ["file"])
    return chatlog.parse_export(lines).select(F.col("file").alias("chatroom_id"), "message", F.date_format("dt", "yyyy-MM-dd HH:mm").alias("at"), "sender", "text", "is_system")


_BLOCKS = f"{TALK}, k AS (SELECT *, dt::DATE AS day, row_number() OVER (PARTITION BY chatroom_id, dt::DATE ORDER BY dt, seq) - 1 AS p FROM talk), blocks AS (SELECT *, strftime(day, '%Y-%m-%d') || '_' || lpad((p // 400 + 1)::VARCHAR, 2, '0') AS block_id, p % 400 AS place FROM k)"


@query(f"WITH {_BLOCKS} SELECT chatroom_id, block_id, count(*) AS n, min(seq) AS first_seq, max(seq) AS last_seq FROM blocks GROUP BY 1, 2")
def message_blocks(spark, d):
    return chatlog.day_blocks(talk(spark, d)).groupBy("chatroom_id", "block_id").agg(F.count("*").alias("n"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))


@query(f"WITH {_BLOCKS}, f AS (SELECT chatroom_id, block_id, sender, count(*) AS n, min(place) AS p0 FROM blocks GROUP BY 1, 2, 3) SELECT chatroom_id, block_id, sum(n)::BIGINT AS message_count, count(*) AS participant_count, string_agg(sender, ',' ORDER BY p0) AS participants FROM f GROUP BY 1, 2")
def block_facts(spark, d):
    return chatlog.block_facts(chatlog.day_blocks(talk(spark, d)).withColumn("is_system", F.lit(False))).withColumn("participants", F.array_join("participants", ","))


@query(f"WITH {_BLOCKS} SELECT chatroom_id, block_id, sender, count(*) AS sent_message FROM blocks GROUP BY 1, 2, 3")
def participant_facts(spark, d):
    return chatlog.day_blocks(talk(spark, d)).groupBy("chatroom_id", "block_id", "sender").agg(F.count("*").alias("sent_message"))


def _stored(spark, d):
    """Conversations as the texts of stored blocks: in a third of the rooms the header lists others than those who speak, in a third nobody; each block comes again in later texts, cut off and whole."""
    rows = chatlog.day_blocks(chat(spark, d).withColumn("text", F.coalesce("text", F.lit("")))).withColumn("room_name", F.concat(F.lit(" "), "chatroom_id"))
    third = F.regexp_extract("chatroom_id", r"\d+", 0).cast("long") % 3
    header = F.when(third == 0, F.regexp_replace("text", "참여자: [^\n]*", "참여자: 이영희,  김철수 , ,알 수 없음")).when(third == 1, F.regexp_replace("text", "참여자: [^\n]*", "참여자: 알 수 없음")).otherwise(F.col("text"))
    texts = chatlog.render_blocks(rows).select("chatroom_id", header.alias("text"))
    more = F.array(F.struct(F.lit(0).alias("seq"), F.col("text").alias("text")), F.struct(F.lit(1).alias("seq"), F.lit("later part\n23:59 nobody: cut off").alias("text")), F.struct(F.lit(2).alias("seq"), F.concat("text", F.lit("\n23:59 nobody: again")).alias("text")))
    return texts.select("chatroom_id", F.explode(more).alias("t")).select("chatroom_id", "t.seq", "t.text")


@query(f"WITH {CHAT} SELECT chatroom_id, row_number() OVER (PARTITION BY chatroom_id ORDER BY seq) AS message, strftime(dt, '%H:%M') AS time, CASE WHEN NOT is_system THEN sender END AS sender, coalesce(text, '') AS text, is_system FROM chat")
def chat_block_parse(spark, d):
    """Messages of stored blocks: the first text of each id counts."""
    return chatlog.parse_lines(chatlog.stored_blocks(_stored(spark, d), ["chatroom_id"]), ["chatroom_id", "block_id"]).drop("block_id")


@query(f"""WITH {CHAT}, f AS (SELECT chatroom_id, strftime(dt, '%Y-%m-%d') AS block_date, sender, count(*) AS n, min(seq) AS p0 FROM chat WHERE NOT is_system GROUP BY 1, 2, 3),
b AS (SELECT chatroom_id, strftime(min(dt), '%Y-%m-%d') AS block_date, regexp_extract(chatroom_id, '\\d+')::BIGINT % 3 AS third FROM chat GROUP BY 1),
s AS (SELECT chatroom_id, sum(n)::BIGINT AS n, count(*) AS k, string_agg(sender, ',' ORDER BY p0) AS who FROM f GROUP BY 1)
SELECT chatroom_id, block_date || '_01' AS block_id, block_date, chatroom_id AS room, coalesce(n, 0) AS message_count, CASE third WHEN 0 THEN 2 ELSE coalesce(k, 0) END AS participant_count, CASE third WHEN 0 THEN '이영희,김철수' ELSE coalesce(who, '') END AS participants FROM b LEFT JOIN s USING (chatroom_id)""")
def stored_block_facts(spark, d):
    """Facts of stored blocks: participants of the header, or those who speak where it lists nobody."""
    found = chatlog.stored_blocks(_stored(spark, d), ["chatroom_id"])
    said = chatlog.parse_lines(found, ["chatroom_id", "block_id"]).withColumnRenamed("message", "place")
    facts_ = chatlog.block_facts(said.join(found.select("chatroom_id", "block_id", "listed"), ["chatroom_id", "block_id"]))
    return facts_.join(found.select("chatroom_id", "block_id", "block_date", "room"), ["chatroom_id", "block_id"]).withColumn("participants", F.array_join("participants", ","))


@query(r"""WITH t AS (SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN chr(10) || '  카카오톡 대화 : ' || text WHEN 1 THEN '친구 님과 카카오톡 대화' || chr(10) || text WHEN 2 THEN repeat(chr(10), 5) || '카카오톡 대화 방' WHEN 3 THEN '저장한 카카오톡대화：방' || (doc_id % 9) || ' ' || chr(10) || text WHEN 4 THEN text || chr(10) || '카카오톡 대화 방' END AS text FROM documents),
f AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10))[1:5], lambda x: trim(x)), lambda x: x <> '')[1] AS line FROM t)
SELECT doc_id, coalesce(nullif(trim(regexp_extract(line, '카카오톡\s*대화\s*[:：]?\s*(.+)', 1)), ''), 'room ' || doc_id) AS name FROM f""")
def room_name(spark, d):
    """Exports that begin with a hint, with one that names nobody, too late for one, with one of another form, without one, and empty ones."""
    k, text = F.col("doc_id") % 6, F.col("text")
    forms = F.when(k == 0, F.concat(F.lit("\n  카카오톡 대화 : "), text)).when(k == 1, F.concat(F.lit("친구 님과 카카오톡 대화\n"), text)).when(k == 2, F.lit("\n" * 5 + "카카오톡 대화 방")).when(k == 3, F.concat(F.format_string("저장한 카카오톡대화：방%d \n", F.col("doc_id") % 9), text)).when(k == 4, F.concat(text, F.lit("\n카카오톡 대화 방")))
    return read(spark, d, "documents").select("doc_id", chatlog.room_name(forms, F.format_string("room %d", "doc_id")).alias("name"))


@query("SELECT c_custkey AS id, sha1(trim(' ' || c_name || ' ')) AS room_id FROM customer")
def room_id(spark, d):
    return read(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.sha1(F.encode(F.trim(F.concat(F.lit(" "), "c_name", F.lit(" "))), "UTF-8")).alias("room_id"))


@query(f"WITH {TALK}, k AS (SELECT *, row_number() OVER (PARTITION BY chatroom_id, sender ORDER BY dt DESC, seq DESC) AS k FROM talk) SELECT chatroom_id, sender, seq FROM k WHERE k <= 8")
def recent_messages(spark, d):
    return snapshot.newest(talk(spark, d), ["chatroom_id", "sender"], 8, F.desc("dt"), F.desc("seq")).select("chatroom_id", "sender", "seq")


@query(f"WITH {TALK}, k AS (SELECT *, row_number() OVER (PARTITION BY chatroom_id, sender ORDER BY dt DESC, seq DESC) AS k, count(*) OVER (PARTITION BY chatroom_id, sender) AS n FROM talk) SELECT chatroom_id, sender, any_value(n) AS message_count, string_agg(seq::VARCHAR, ',' ORDER BY seq) AS history FROM k WHERE k <= 80 GROUP BY 1, 2")
def participant_history(spark, d):
    """Totals of all messages, and the last 80 in order: cut before they are gathered."""
    t = talk(spark, d)
    totals = t.groupBy("chatroom_id", "sender").agg(F.count("*").alias("message_count"))
    last = snapshot.newest(t, ["chatroom_id", "sender"], 80, F.desc("dt"), F.desc("seq"))
    history = last.groupBy("chatroom_id", "sender").agg(F.array_join(F.transform(F.array_sort(F.collect_list("seq")), lambda x: x.cast("string")), ",").alias("history"))
    return totals.join(history, ["chatroom_id", "sender"])


_MENTIONS = f"""{CHAT}, terms(keyword) AS (VALUES ('la'), ('the'), ('aa'), ('a.b')), hits AS (SELECT chatroom_id, sender, keyword, sum((length(text) - length(replace(text, keyword, ''))) // length(keyword))::BIGINT AS mention_count FROM chat, terms WHERE NOT is_system GROUP BY 1, 2, 3)"""


@query(f"WITH {_MENTIONS} SELECT * FROM hits WHERE mention_count > 0")
def keyword_mentions(spark, d):
    terms = spark.range(1).select(F.explode(F.array(*map(F.lit, ("la", "the", "aa", "a.b")))).alias("keyword"))
    return chatlog.mentions(chat(spark, d).where("not is_system").select("chatroom_id", "sender", "text"), terms)


# --- counts ------------------------------------------------------------------------------

@query(f"WITH {_BLOCKS}, p AS (SELECT chatroom_id, block_id, day, sender, count(*) AS n FROM blocks GROUP BY 1, 2, 3, 4) SELECT chatroom_id, sender, sum(n)::BIGINT AS messages, count(*) AS n_blocks, 'the ' || sender AS description FROM p WHERE day BETWEEN DATE '2024-01-05' AND DATE '2024-01-20' GROUP BY 1, 2")
def room_people_stats(spark, d):
    """Participants of blocks of a range, with what is known of the people; the blocks' days are cut before the join."""
    rows = chatlog.day_blocks(talk(spark, d).where("dt >= timestamp_ntz '2024-01-05' and dt < timestamp_ntz '2024-01-21'"))
    parts = rows.groupBy("chatroom_id", "block_id", "sender").agg(F.count("*").alias("n"))
    people = talk(spark, d).select("sender").distinct().select("sender", F.concat(F.lit("the "), "sender").alias("description"))
    return parts.groupBy("chatroom_id", "sender").agg(F.sum("n").alias("messages"), F.count("*").alias("n_blocks")).join(people, "sender", "left")


_KEYWORDS = f"{TALK}, kw AS (SELECT chatroom_id, dt::DATE AS day, sender, 'k' || (value::INTEGER % 7) AS keyword FROM talk)"


def _keywords(spark, d):
    return talk(spark, d).select("chatroom_id", F.to_date("dt").alias("day"), "sender", F.concat(F.lit("k"), (F.expr("cast(round(value) as int)") % 7).cast("string")).alias("keyword"))


_KEYWORDS = _KEYWORDS.replace("value::INTEGER", "round(value)::INTEGER")


@query(f"WITH {_KEYWORDS} SELECT chatroom_id, sender, keyword, count(*) AS n FROM kw WHERE day BETWEEN DATE '2024-01-05' AND DATE '2024-01-20' GROUP BY 1, 2, 3")
def room_keywords_person(spark, d):
    return _keywords(spark, d).where(F.col("day").between("2024-01-05", "2024-01-20")).groupBy("chatroom_id", "sender", "keyword").agg(F.count("*").alias("n"))


@query(f"WITH {_BLOCKS}, b AS (SELECT DISTINCT chatroom_id, block_id, day FROM blocks), m AS (SELECT chatroom_id, block_id, sender, 'k' || (seq % 7) AS keyword, count(*) AS mention_count FROM blocks GROUP BY 1, 2, 3, 4) SELECT chatroom_id, sender, keyword, sum(mention_count)::BIGINT AS n, count(DISTINCT block_id) AS n_blocks FROM m JOIN b USING (chatroom_id, block_id) WHERE day BETWEEN DATE '2024-01-05' AND DATE '2024-01-20' GROUP BY 1, 2, 3")
def room_keywords_by_block(spark, d):
    """Keyword facts of blocks joined with the blocks of a range of days."""
    rows = chatlog.day_blocks(talk(spark, d))
    facts = rows.groupBy("chatroom_id", "block_id", "sender", F.concat(F.lit("k"), (F.col("seq") % 7).cast("string")).alias("keyword")).agg(F.count("*").alias("mention_count"))
    days = rows.select("chatroom_id", "block_id", "day").distinct().where(F.col("day").between("2024-01-05", "2024-01-20"))
    return facts.join(days, ["chatroom_id", "block_id"]).groupBy("chatroom_id", "sender", "keyword").agg(F.sum("mention_count").alias("n"), F.countDistinct("block_id").alias("n_blocks"))


@query(f"WITH {_BLOCKS}, m AS (SELECT chatroom_id, block_id, day, sender, 'k' || (seq % 997) AS keyword, count(*) AS mention_count FROM blocks GROUP BY 1, 2, 3, 4, 5), o AS (SELECT chatroom_id, keyword FROM m GROUP BY 1, 2 HAVING sum(mention_count) >= 2) SELECT chatroom_id, block_id, sender, keyword, mention_count FROM m JOIN o USING (chatroom_id, keyword) WHERE day < DATE '2024-01-20'")
def message_keyword_fact(spark, d):
    """Keyword mentions of blocks that are stored, those before a day, of keywords that a room has twice or more."""
    rows = chatlog.day_blocks(talk(spark, d))
    mentions = rows.groupBy("chatroom_id", "block_id", "sender", F.concat(F.lit("k"), (F.col("seq") % 997).cast("string")).alias("keyword")).agg(F.count("*").alias("mention_count"))
    stored = rows.where("day < date '2024-01-20'").select("chatroom_id", "block_id", "sender").distinct()
    return facts.message_keyword_fact(mentions, stored).select("chatroom_id", "block_id", "sender", "keyword", "mention_count")


@query(f"WITH {CHAT}, c AS (SELECT chatroom_id, sender AS person, count(*) AS messages FROM chat WHERE NOT is_system GROUP BY 1, 2), s AS (SELECT DISTINCT chatroom_id, 'assistant' AS person, 0::BIGINT AS messages, 'answers in ' || chatroom_id AS description FROM chat) SELECT chatroom_id, person, coalesce(c.messages, s.messages) AS messages, s.description AS description FROM c FULL JOIN s USING (chatroom_id, person)")
def room_people_fact(spark, d):
    """Message counts of persons merged into those stored, whose descriptions stay."""
    c = chat(spark, d)
    stored = c.select("chatroom_id").distinct().select("chatroom_id", F.lit("assistant").alias("person"), F.lit(0).cast("long").alias("messages"), F.concat(F.lit("answers in "), "chatroom_id").alias("description"))
    return facts.room_people_fact(c, stored)


@query(f"WITH {_KEYWORDS} SELECT chatroom_id, keyword, strftime(day, '%Y-%m') AS month, count(*) AS n FROM kw GROUP BY 1, 2, 3")
def room_keyword_monthly(spark, d):
    return _keywords(spark, d).groupBy("chatroom_id", "keyword", F.date_format("day", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"))


@query(f"WITH {_KEYWORDS} SELECT chatroom_id, keyword, day, count(*) AS n FROM kw GROUP BY 1, 2, 3")
def room_keyword_daily(spark, d):
    return _keywords(spark, d).groupBy("chatroom_id", "keyword", "day").agg(F.count("*").alias("n"))


@query(f"WITH {_KEYWORDS} SELECT chatroom_id, day, keyword, sender, count(*) AS n, row_number() OVER (PARTITION BY chatroom_id, day, keyword ORDER BY count(*) DESC, sender) AS place FROM kw GROUP BY 1, 2, 3, 4")
def room_keyword_mentioners(spark, d):
    counts = _keywords(spark, d).groupBy("chatroom_id", "day", "keyword", "sender").agg(F.count("*").alias("n"))
    return counts.withColumn("place", F.row_number().over(Window.partitionBy("chatroom_id", "day", "keyword").orderBy(F.desc("n"), "sender")))


@query(f"WITH {TALK}, p AS (SELECT chatroom_id, sender, count(*) AS n FROM talk WHERE dt >= TIMESTAMP '2024-01-05' AND dt < TIMESTAMP '2024-01-21' GROUP BY 1, 2) SELECT chatroom_id, sum(n)::BIGINT AS messages, count(*) AS participants, string_agg(sender, ',' ORDER BY n DESC, sender) AS names FROM p GROUP BY 1")
def room_list(spark, d):
    each = series.in_days(talk(spark, d), "dt", "2024-01-05", "2024-01-20").groupBy("chatroom_id", "sender").agg(F.count("*").alias("n"))
    names = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "sender"))), lambda x: x["sender"]), ",")
    return each.groupBy("chatroom_id").agg(F.sum("n").alias("messages"), F.count("*").alias("participants"), names.alias("names"))


@query(f"WITH {TALK} SELECT chatroom_id, sender, strftime(dt, '%Y-%m') AS month, count(*) AS n, sum(count(*)) OVER (PARTITION BY chatroom_id, sender)::BIGINT AS total FROM talk GROUP BY 1, 2, 3")
def room_person_monthly(spark, d):
    monthly = talk(spark, d).groupBy("chatroom_id", "sender", F.date_format("dt", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"))
    return monthly.withColumn("total", F.sum("n").over(Window.partitionBy("chatroom_id", "sender")))


@query(f"WITH {TALK} SELECT chatroom_id, sender, dt::DATE AS day, count(*) AS n FROM talk GROUP BY 1, 2, 3")
def room_person_daily(spark, d):
    return talk(spark, d).groupBy("chatroom_id", "sender", F.to_date("dt").alias("day")).agg(F.count("*").alias("n"))


@query(f"WITH {TALK}, r AS (SELECT DISTINCT chatroom_id, sender FROM talk), p AS (SELECT chatroom_id, sender, count(*) AS n FROM talk WHERE dt >= TIMESTAMP '2024-01-10' AND dt < TIMESTAMP '2024-01-12' GROUP BY 1, 2) SELECT chatroom_id, sender, coalesce(n, 0) AS n FROM r LEFT JOIN p USING (chatroom_id, sender)")
def room_person_detail(spark, d):
    t = talk(spark, d)
    counts = series.in_days(t, "dt", "2024-01-10", "2024-01-11").groupBy("chatroom_id", "sender").agg(F.count("*").alias("n"))
    return t.select("chatroom_id", "sender").distinct().join(counts, ["chatroom_id", "sender"], "left").fillna(0, ["n"])


@query(f"WITH {TALK} SELECT chatroom_id, min(dt)::DATE AS first_day, max(dt)::DATE AS last_day FROM talk GROUP BY 1")
def messenger_date_range(spark, d):
    return talk(spark, d).groupBy("chatroom_id").agg(F.to_date(F.min("dt")).alias("first_day"), F.to_date(F.max("dt")).alias("last_day"))


@query(f"WITH {_BLOCKS} SELECT chatroom_id, block_id, row_number() OVER (PARTITION BY chatroom_id ORDER BY strftime(dt, '%H:%M'), block_id, place) AS line, strftime(dt, '%H:%M') AS time, sender, seq FROM blocks WHERE day = DATE '2024-01-07'")
def day_messages(spark, d):
    """The transcript of one day: the day is cut out before blocks are made."""
    rows = chatlog.day_blocks(series.in_days(talk(spark, d), "dt", "2024-01-07", "2024-01-07")).withColumn("time", F.date_format("dt", "HH:mm"))
    return rows.select("chatroom_id", "block_id", F.row_number().over(Window.partitionBy("chatroom_id").orderBy("time", "block_id", "place")).alias("line"), "time", "sender", "seq")


@query(f"WITH {CHAT}, s AS (SELECT owner, strftime(dt, '%Y-%m') AS period, list_sort(list_distinct(list(sender))) AS c FROM chat GROUP BY 1, 2) SELECT owner, period, len(c) AS n_contacts, array_to_string(c, ',') AS contacts, row_number() OVER (PARTITION BY owner ORDER BY period) AS place FROM s")
def summaries(spark, d):
    """Stored summaries by period: contacts kept as a JSON array and decoded."""
    stored = chat(spark, d).groupBy("owner", F.date_format("dt", "yyyy-MM").alias("period")).agg(F.to_json(F.array_sort(F.collect_set("sender"))).alias("json"))
    rows = stored.withColumn("c", F.from_json("json", "array<string>"))
    return rows.select("owner", "period", F.size("c").cast("long").alias("n_contacts"), F.array_join("c", ",").alias("contacts"), F.row_number().over(Window.partitionBy("owner").orderBy("period")).alias("place"))


@query(f"""WITH {CHAT}, u AS (SELECT owner, dt::DATE AS day, seq + (replace(chatroom_id, 'room', '')::BIGINT) * 1000 AS seq, sender, coalesce(left(text, 1500), '') AS text, text IS NULL AS lacks, unnest([{{'unit': 'month', 'period': strftime(dt, '%Y-%m')}}, {{'unit': 'year', 'period': strftime(dt, '%Y')}}]) AS u FROM chat),
k AS (SELECT owner, u.unit AS unit, u.period AS period, day, seq, sender, text, lacks, sum(length(text) + 1) OVER (PARTITION BY owner, u.unit, u.period ORDER BY day, seq ROWS UNBOUNDED PRECEDING) AS upto FROM u)
SELECT owner, unit, period, ((upto - length(text) - 1) // 30000)::INTEGER AS part, count(*) AS n_items, coalesce(string_agg(text, chr(10) ORDER BY day, seq) FILTER (NOT lacks), '') AS text, array_to_string(list_sort(list_distinct(list(sender))), ',') AS contacts FROM k GROUP BY 1, 2, 3, 4""")
def message_period_digest(spark, d):
    """All messages of each month and year, in parts of some 30,000 characters; one without text counts and adds nothing."""
    c = chat(spark, d).select("owner", F.to_date("dt").alias("day"), (F.col("seq") + F.replace("chatroom_id", F.lit("room"), F.lit("")).cast("long") * 1000).alias("seq"), F.col("sender").alias("who"), "text")
    return series.digest(c, ["owner"], 1500, 30_000).withColumn("contacts", F.array_join("contacts", ","))


@query(f"""WITH {CHAT}, r AS (SELECT chatroom_id, 'Room ' || (replace(chatroom_id, 'room', '')::BIGINT % 17) AS name, count(*) AS messages, CASE WHEN replace(chatroom_id, 'room', '')::BIGINT % 4 <> 0 THEN (count(*) * 7 % 5)::DOUBLE END AS mood FROM chat GROUP BY 1, 2)
SELECT chatroom_id, row_number() OVER (ORDER BY name, chatroom_id) AS by_name, row_number() OVER (ORDER BY messages DESC, chatroom_id) AS by_total, row_number() OVER (ORDER BY coalesce(mood, -1) DESC, chatroom_id) AS by_mood FROM r""")
def rooms_sorted(spark, d):
    """Places of the rooms by name, messages and mood, those without a mood last. Rooms are aggregated rows, which one task can order."""
    key = F.replace("chatroom_id", F.lit("room"), F.lit("")).cast("long")
    r = chat(spark, d).groupBy("chatroom_id").agg(F.count("*").alias("messages")).withColumns({"name": F.format_string("Room %d", key % 17), "mood": F.when(key % 4 != 0, (F.col("messages") * 7 % 5).cast("double"))})
    place = lambda *order: F.row_number().over(Window.orderBy(*order))
    return r.select("chatroom_id", place("name", "chatroom_id").alias("by_name"), place(F.desc("messages"), "chatroom_id").alias("by_total"), place(F.coalesce("mood", F.lit(-1.0)).desc(), "chatroom_id").alias("by_mood"))


@query(f"""WITH b AS (SELECT event_id, user_id, CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN strptime(strftime(ts, '%Y-%m-%d'), '%Y-%m-%d') ELSE date_trunc('second', ts) END AS t FROM events)
SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY t DESC NULLS LAST, event_id) AS number FROM b""")
def renumbered_blocks(spark, d):
    """Blocks after a merge, newest first by dates of two formats (unreadable ones last), numbered anew for each owner."""
    k = F.col("event_id") % 5
    raw = F.when(k == 0, "2024-13-45 soon").when(k == 1, F.date_format("ts", "yyyy-MM-dd")).otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    rows = read(spark, d, "events").select("user_id", "event_id", fn.block_time(raw).alias("t"))
    return blocks.numbered(rows, ["user_id"], F.col("t").desc_nulls_last(), "event_id").select("user_id", "event_id", "number")


# --- mood ------------------------------------------------------------------------------

_SAID = "replace(replace(text, 'ion', 'ㅋㅋㅋ'), 'ou.', '해요 ^^ 좋다')"
_MARKS = r"""(len(regexp_extract_all(t, '!')) + len(regexp_extract_all(t, '\^\^|ㅠ{2,}|ㅜ{2,}|-_-|;;')) + len(regexp_extract_all(t, '[\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}\x{1F1E6}-\x{1F1FF}]'))
 + coalesce(list_sum(list_transform(regexp_extract_all(t, '[ㅋㅎ]{2,}'), lambda x: least(length(x), 5))), 0) + (regexp_replace(t, '^\s+|\s+$', '', 'g') = '이모티콘')::INT
 + CASE WHEN regexp_matches(right(regexp_replace(t, '^\s+|\s+$', '', 'g'), 10), '(습니다|합니다|입니다|십니다|세요|니다)[\s.!?]*$') THEN -1 WHEN regexp_matches(right(regexp_replace(t, '^\s+|\s+$', '', 'g'), 10), '(야|다|지|냐|거든|잖아|었어|았어|해|줘|봐|용|염|잉)[\s~.!?]*$') THEN 1 ELSE 0 END)::DOUBLE"""


@query(f"SELECT doc_id, {_MARKS} AS score FROM (SELECT doc_id, {_SAID} AS t FROM documents)")
def tone_markers(spark, d):
    said = F.replace(F.replace("text", F.lit("ion"), F.lit("ㅋㅋㅋ")), F.lit("ou."), F.lit("해요 ^^ 좋다"))
    return read(spark, d, "documents").select("doc_id", mood.tone_markers(said).alias("score"))


_ROOMS = """m AS (SELECT 'o' || (user_id % 3) AS owner, 'r' || (user_id % 12) AS chatroom_id, ts AS dt, event_id AS seq, event_type AS sender, repeat('!', floor(value)::INTEGER % 3) AS t FROM events),
u AS (SELECT *, unnest([{'unit': 'day', 'period': strftime(dt, '%Y-%m-%d')}, {'unit': 'month', 'period': strftime(dt, '%Y-%m')}]) AS p FROM m)"""
_UNITS = ("day", "month")


def _rooms(spark, d):
    e = read(spark, d, "events")
    return e.select(F.concat(F.lit("o"), (F.col("user_id") % 3).cast("string")).alias("owner"), F.concat(F.lit("r"), (F.col("user_id") % 12).cast("string")).alias("chatroom_id"), F.col("ts").alias("dt"), F.col("event_id").alias("seq"), F.col("event_type").alias("sender"), F.expr("repeat('!', cast(floor(value) % 3 as int))").alias("text"))


_GAPS = """g AS (SELECT chatroom_id, dt::DATE AS day, greatest(0, mi - lag(mi) OVER (PARTITION BY chatroom_id, dt::DATE ORDER BY dt, seq)) AS gap, lag(mi) OVER (PARTITION BY chatroom_id, dt::DATE ORDER BY dt, seq) AS before FROM (SELECT *, hour(dt) * 60 + minute(dt) AS mi FROM m)),
dg AS (SELECT chatroom_id, day, avg(gap::DOUBLE) AS gap FROM g WHERE before IS NOT NULL GROUP BY 1, 2),
gaps AS (SELECT chatroom_id, p.unit AS unit, p.period AS period, avg(gap) AS gap FROM (SELECT *, unnest([{'unit': 'day', 'period': strftime(day, '%Y-%m-%d')}, {'unit': 'month', 'period': strftime(day, '%Y-%m')}]) AS p FROM dg) GROUP BY 1, 2, 3)"""
_BALANCE = """each AS (SELECT chatroom_id, p.unit AS unit, p.period AS period, sender, count(*) AS n FROM u GROUP BY 1, 2, 3, 4),
bal AS (SELECT chatroom_id, unit, period, sum(n)::BIGINT AS messages, CASE WHEN count(*) > 1 THEN greatest(0.0::DOUBLE, (ln(sum(n)::DOUBLE) - sum(n * ln(n::DOUBLE)) / sum(n)) / ln(count(*)::DOUBLE)) ELSE 0.0 END AS balance FROM each GROUP BY 1, 2, 3)"""


@query(f"WITH {_ROOMS}, {_GAPS} SELECT chatroom_id, unit, period, round(gap, 6) AS gap FROM gaps")
def response_speed(spark, d):
    return mood.response_gaps(_rooms(spark, d), _UNITS).withColumn("gap", F.round("gap", 6))


@query(f"WITH {_ROOMS}, {_BALANCE} SELECT chatroom_id, unit, period, messages, round(balance, 6) AS balance FROM bal")
def participation_balance(spark, d):
    return mood.balance(_rooms(spark, d), _UNITS).withColumn("balance", F.round("balance", 6))


_MOOD = f"""{_ROOMS}, {_GAPS}, {_BALANCE}, tones AS (SELECT owner, chatroom_id, p.unit AS unit, p.period AS period, avg(length(t)::DOUBLE) AS tone FROM u GROUP BY 1, 2, 3, 4),
x AS (SELECT owner, chatroom_id, unit, period, tone, messages, balance, 1 / (coalesce(gap, 1440.0::DOUBLE) + 1) AS speed, CASE WHEN unit = 'day' AND chatroom_id < 'r3' THEN (right(period, 2)::INTEGER * 5)::DOUBLE END AS private_ratio FROM tones JOIN bal USING (chatroom_id, unit, period) LEFT JOIN gaps USING (chatroom_id, unit, period)),
y AS (SELECT *, CASE WHEN max(tone) OVER r = min(tone) OVER r THEN 50.0::DOUBLE ELSE 100 * (tone - min(tone) OVER r) / (max(tone) OVER r - min(tone) OVER r) END AS tn, CASE WHEN max(speed) OVER r = min(speed) OVER r THEN 50.0::DOUBLE ELSE 100 * (speed - min(speed) OVER r) / (max(speed) OVER r - min(speed) OVER r) END AS sn,
 CASE WHEN max(messages) OVER o = min(messages) OVER o THEN 50.0::DOUBLE ELSE 100.0::DOUBLE * (messages - min(messages) OVER o) / (max(messages) OVER o - min(messages) OVER o) END * (0.5::DOUBLE + 0.5::DOUBLE * balance) AS an FROM x WINDOW r AS (PARTITION BY chatroom_id, unit), o AS (PARTITION BY owner, unit)),
mood AS (SELECT chatroom_id, unit, period, round(0.35::DOUBLE * least(100, greatest(0, coalesce(private_ratio, 50))) + 0.35::DOUBLE * tn + 0.15::DOUBLE * an + 0.15::DOUBLE * sn, 2) AS mood_score FROM y)"""


def _mood_inputs(spark, d):
    m = _rooms(spark, d)
    private = m.where("chatroom_id < 'r3'").select("chatroom_id", F.date_format("dt", "yyyy-MM-dd").alias("period")).distinct().select("chatroom_id", F.lit("day").alias("unit"), "period", (F.substring("period", 9, 2).cast("int") * 5).cast("double").alias("private_ratio"))
    return m, private


def _mood(spark, d):
    return mood.mood_scores(*_mood_inputs(spark, d), _UNITS)


@query(f"WITH {_MOOD} SELECT * FROM mood")
def mood_score(spark, d):
    return _mood(spark, d)


@query(f"WITH {_MOOD} SELECT * FROM mood")
def mood_after_changes(spark, d):
    """Moods of all rooms after some had more messages: worked out for all without these, then for the changed rooms alone, with those of their owners."""
    m, private = _mood_inputs(spark, d)
    store = Snapshots(spark, f"{shared_dir(spark)}/moods-{uuid.uuid4().hex}", mood.STATS, ["owner"], parts=8)
    mood.refresh(store, m.where("chatroom_id > 'r1' or seq % 3 <> 0"), private, _UNITS)
    mood.refresh(store, m.where("chatroom_id <= 'r1'"), private, _UNITS)
    return mood.scores(store.current())


@query(f"WITH {_MOOD} SELECT chatroom_id, round(coalesce(avg(mood_score) FILTER (unit = 'day'), avg(mood_score) FILTER (unit = 'month')), 8) AS mood FROM mood WHERE unit = 'day' AND period BETWEEN '2024-01-03' AND '2024-01-12' OR unit = 'month' AND period = '2024-01' GROUP BY 1")
def room_mood_avg(spark, d):
    """Over a range: of the finer unit if there are rows, else of the coarser."""
    rows = _mood(spark, d).where("unit = 'day' and period between '2024-01-03' and '2024-01-12' or unit = 'month' and period = '2024-01'")
    mean = lambda u: F.avg(F.when(F.col("unit") == u, F.col("mood_score")))
    return rows.groupBy("chatroom_id").agg(F.round(F.coalesce(mean("day"), mean("month")), 8).alias("mood"))
