"""Mail blocks: rendering, splitting, parsing, merging."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The line that separates blocks. Fixed value.
SEPARATOR = "=" * 60
#: Names of header fields in a block, as written. Fixed values.
FIELDS = {"mail_id": "ID", "subject": "제목", "direction_raw": "구분", "date_raw": "날짜", "sender": "발신인", "receiver": "수신인", "folder": "폴더 정보"}


def render(mails: DataFrame) -> Column:
    """A mail's fields and body as the text of a block."""
    lines = [F.concat(F.lit(f"[{name}] "), F.coalesce(F.col(c), F.lit("없음"))) for c, name in FIELDS.items()]
    return F.concat_ws("\n", *lines, F.lit(""), F.lit("[메일 본문]"), "body", F.lit(""), F.lit("[첨부파일 정보]"), F.lit("없음"))


def split_blocks(files: DataFrame, keys: list[str]) -> DataFrame:
    """files(keys, text) -> (keys, seq, text): trimmed blocks in order, empty ones left out."""
    parts = F.posexplode(F.split("text", SEPARATOR)).alias("seq", "text")
    return files.select(*keys, parts).withColumn("text", F.regexp_replace("text", r"^\s+|\s+$", "")).where("text <> ''")


def header(text: Column, name: str) -> Column:
    """`[NAME] value` or `NAME: value` on a line of its own; null without one."""
    return F.nullif(F.regexp_extract(text, rf"(?m)^[ \t]*(?:\[{name}\]|{name}:)[ \t]*(\S.*?)[ \t]*$", 1), F.lit(""))


def body(text: Column, stop: str = "section") -> Column:
    """The body section, up to the next section or separator, or only to the list of attachments."""
    end = r"\n\[|\n===|\z" if stop == "section" else r"\n\[첨부파일 정보\]|\z"
    return F.trim(F.regexp_replace(F.regexp_extract(text, rf"(?s)\[메일 본문\][ \t]*\n(.*?)(?:{end})", 1), r"\s+$", ""))


def parse_blocks(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """blocks(keys, seq, text) -> records; the first of each id, blocks without one left out, folder `없음` null."""
    fields = {c: header(F.col("text"), name) for c, name in FIELDS.items()}
    rows = blocks.select(*keys, "seq", *(f.alias(c) for c, f in fields.items()), body(F.col("text")).alias("body")).where("mail_id is not null")
    rows = rows.withColumn("folder", F.nullif("folder", F.lit("없음")))
    names = [c for c in rows.columns if c not in (*keys, "mail_id")]
    first = rows.groupBy(*keys, "mail_id").agg(F.min_by(F.struct(*names), "seq").alias("r"))
    return first.select(*keys, "mail_id", "r.*")


#: How a reply names the mail that it answers: when, and by whom; and the time in it. Fixed values.
QUOTE = r"(\d{4}년 \d{1,2}월 \d{1,2}일[^,]+),\s*(.+?)님이 작성:"
QUOTE_TIME = r"(\d{4})년 (\d{1,2})월 (\d{1,2})일[^(]*\([^)]+\)\s*(오전|오후)\s*(\d{1,2}):(\d{2})"


def quoted(text: Column) -> tuple[Column, Column]:
    """Address and minute (`YYYY-MM-DD HH:MM`) of the mail that a body quotes; nulls without one.

    The first passage that ends in the marker counts, and nothing beyond it: a sender is an address in angle
    brackets, or all that stands before the marker; a date without the marker, or a marker without a readable time, is no quote.
    """
    when, who = (F.regexp_extract(text, QUOTE, k) for k in (1, 2))
    g = lambda k: F.regexp_extract(when, QUOTE_TIME, k)
    hour = F.when((g(4) == "오후") & (g(5) != "12"), g(5).cast("int") + 12).when((g(4) == "오전") & (g(5) == "12"), 0).otherwise(g(5).cast("int"))
    minute = F.format_string("%s-%02d-%02d %02d:%s", g(1), g(2).cast("int"), g(3).cast("int"), hour, g(6))
    found, inner = when.rlike(QUOTE_TIME), F.regexp_extract(who, "<([^>]+)>", 1)
    return F.when(found, F.lower(F.when(inner != "", inner).otherwise(F.trim(who)))), F.when(found, minute)


def reply_links(mails: DataFrame) -> DataFrame:
    """mails(account, seq, mail_id, sender, minute, mail_date, quote_sender, quote_minute) -> replies and what they answer.

    An equi-join on (account, sender, minute); of equal keys the last mail answers.
    Rows without a quote never enter the join.
    """
    asked = mails.groupBy("account", F.col("sender").alias("quote_sender"), F.col("minute").alias("quote_minute")).agg(F.max_by(F.struct(F.col("mail_id").alias("reply_to"), F.col("mail_date").alias("asked_at")), "seq").alias("a"))
    replies = mails.where("quote_sender is not null and quote_minute is not null")
    hours = F.round(F.expr("timestampdiff(SECOND, a.asked_at, mail_date)") / 3600.0, 2)
    return replies.join(asked, ["account", "quote_sender", "quote_minute"], "left").select("account", "mail_id", F.col("a.reply_to").alias("reply_to"), hours.alias("hours"))


def incremental(old: DataFrame, new: DataFrame, owner: str, latest_day: bool = False) -> DataFrame:
    """Stored and new blocks (owner, block_id, ...): only unknown ids are added, first ones winning.

    With latest_day, blocks of the last stored day (the id's first ten characters) are
    replaced where their new version arrived, as that day was still growing.
    """
    if latest_day:
        last = old.groupBy(owner).agg(F.max(F.substring("block_id", 1, 10)).alias("_last"))
        renewed = new.join(last, owner).where(F.substring("block_id", 1, 10) == F.col("_last")).select(owner, "block_id").distinct()
        old = old.join(renewed, [owner, "block_id"], "left_anti")
    return old.unionByName(new.join(old.select(owner, "block_id"), [owner, "block_id"], "left_anti"))


def with_attachments(blocks: DataFrame, files: DataFrame) -> DataFrame:
    """blocks(mail_id, text) with the texts of their files(mail_id, i, text), numbered in order."""
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "text"))), lambda x, k: F.concat(F.lit("File "), (k + 1).cast("string"), F.lit(": "), x["text"])), "\n")
    texts = files.groupBy("mail_id").agg(listed.alias("files"))
    return blocks.join(texts, "mail_id", "left").select("mail_id", F.concat_ws("\n", "text", "files").alias("text"))


def numbered(rows: DataFrame, keys: list[str], *order) -> DataFrame:
    """Block numbers from 1 after a merge."""
    return rows.withColumn("number", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
