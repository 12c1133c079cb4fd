"""Fact tables, put together from the operators on blocks, contacts, keywords and profiles."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from correspond.functions import text as fn
from correspond.operators import blocks, snapshot
from correspond.operators.graph import pairs
from correspond.operators.tables import written

#: Tones that an entity's description may name. Fixed values.
TONES = ("formal", "casual", "transactional", "notification", "alert")


def tones(entities: DataFrame) -> DataFrame:
    """entities(account, title, type, description) -> (account, title, kg_tone) of mails, title in capitals; one tone a mail: of several entities of a mail the last by seq, or by name where entities have no seq."""
    tone = F.lower(F.regexp_extract("description", r"(?U)Tone:\s*(\w+)", 1))
    seq = F.col("seq") if "seq" in entities.columns else F.lit(0)
    named = entities.where(F.upper("type") == "EMAIL").select("account", F.upper("title").alias("title"), tone.alias("kg_tone"), seq.alias("seq"))
    return named.where(F.col("kg_tone").isin(*TONES)).groupBy("account", "title").agg(F.max(F.struct("seq", "kg_tone")).alias("t")).select("account", "title", "t.kg_tone")


def mail_fact(texts: DataFrame, entities: DataFrame, tone_of: Callable[[Column], Column] | None = None) -> DataFrame:
    """texts(account, seq, text) of blocks, entities(account, title, type, description) -> the mail fact, each id of an account once, from its first block.

    (account, seq, mail_id, folder, mail_date, sender, receiver, direction, counterparty,
    subject, body, is_reply, kg_tone, llm_tone, reply_to, reply_elapsed_hours): a
    reply (`Re:`) is linked to the last mail of the sender and minute that it quotes; a
    folder that is missing is UNKNOWN; tone_of(body) is the hook for a judged tone.
    """
    raw = blocks.parse_blocks(texts, ["account"])
    body = F.coalesce("body", F.lit(""))
    sender, minute = blocks.quoted(body)
    reply = fn.is_reply(F.col("subject"))
    rows = raw.select(
        "account", "seq", "mail_id", F.coalesce("folder", F.lit("UNKNOWN")).alias("folder"), fn.block_time(F.col("date_raw")).alias("mail_date"), "sender", "receiver",
        fn.direction(F.col("direction_raw"), fn.address(F.col("sender")), F.col("account")).alias("direction"), fn.counterparty(F.col("sender"), F.col("receiver"), F.col("account")).alias("counterparty"),
        "subject", "body", reply.alias("is_reply"), (tone_of(body) if tone_of else F.lit(None).cast("string")).alias("llm_tone"),
        F.when(reply, sender).alias("quote_sender"), F.when(reply, minute).alias("quote_minute"), F.substring("date_raw", 1, 16).alias("minute"),
    )
    rows = written(rows, "mails")  # texts are parsed once, for the fact and for both sides of the replies
    by_minute = rows.select("account", "seq", "mail_id", fn.address(F.col("sender")).alias("sender"), "minute", F.date_trunc("minute", "mail_date").cast("timestamp_ntz").alias("mail_date"), "quote_sender", "quote_minute")
    linked = blocks.reply_links(by_minute).withColumnRenamed("hours", "reply_elapsed_hours")
    told = tones(entities).withColumnRenamed("title", "_title")
    rows = rows.drop("quote_sender", "quote_minute", "minute").withColumn("_title", F.upper("mail_id"))
    return rows.join(told, ["account", "_title"], "left").drop("_title").join(linked, ["account", "mail_id"], "left")


def keyword_fact(rows: DataFrame, persons: DataFrame, least: int = 2) -> DataFrame:
    """rows(account, keyword, person, day), persons(person) -> daily counts of keywords that an account has `least` times or more, of known persons."""
    often = rows.groupBy("account", "keyword").agg(F.count("*").alias("_n")).where(F.col("_n") >= least).select("account", "keyword")
    daily = rows.groupBy("account", "keyword", "person", "day").agg(F.count("*").alias("daily_count"))
    return daily.join(often, ["account", "keyword"], "left_semi").join(persons, "person", "left_semi").select("account", "keyword", "person", "day", "daily_count")


def person_fact(contacts: DataFrame, profiles: DataFrame, stored: DataFrame) -> DataFrame:
    """contacts(account, contact, counts..., name) with profiles(account, contact, description, relation), merged into stored persons: new counts replace old ones, a description or relation that is missing keeps the old one."""
    new = contacts.join(profiles, ["account", "contact"], "left").select(stored.columns)
    return snapshot.upsert(stored, new, ["account", "contact"], keep_if_null=("description", "relation"))


def room_people_fact(messages: DataFrame, stored: DataFrame) -> DataFrame:
    """messages(chatroom_id, sender, is_system) -> stored(chatroom_id, person, messages, description) with new counts; persons without new messages stay."""
    counts = messages.where("not is_system").groupBy("chatroom_id", F.col("sender").alias("person")).agg(F.count("*").alias("messages"))
    return snapshot.upsert(stored, counts.withColumn("description", F.lit(None).cast("string")), ["chatroom_id", "person"], keep_if_null=("description",))


def profiles(persons: DataFrame, owner: str = "account") -> DataFrame:
    """persons(owner, index_date, person, description, ...) -> those of each owner's latest state that have a description."""
    return snapshot.latest_snapshot(persons, [owner]).where("trim(description) <> ''")


def message_keyword_fact(mentions: DataFrame, participants: DataFrame, least: int = 2) -> DataFrame:
    """mentions(chatroom_id, block_id, sender, keyword, mention_count) of keywords that a room has `least` times or more, by participants(chatroom_id, block_id, sender) of stored blocks."""
    often = mentions.groupBy("chatroom_id", "keyword").agg(F.sum("mention_count").alias("_n")).where(F.col("_n") >= least).select("chatroom_id", "keyword")
    return mentions.join(often, ["chatroom_id", "keyword"], "left_semi").join(participants, ["chatroom_id", "block_id", "sender"], "left_semi")


def relationship_fact(links: DataFrame, roster: DataFrame, stored: DataFrame) -> DataFrame:
    """links(source, target, seq, relation, description) between persons of the roster(name), merged into stored(person_a, person_b, relation, description): each pair once, the last link of a pair counting."""
    return snapshot.upsert(stored, pairs(links, roster), ["person_a", "person_b"])
