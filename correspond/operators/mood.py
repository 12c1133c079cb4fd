"""Mood of rooms by period."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Weights and patterns. Fixed values.
WEIGHTS = {"private": 0.35, "tone": 0.35, "activity": 0.15, "speed": 0.15}
EMOTICON = r"\^\^|ㅠ{2,}|ㅜ{2,}|-_-|;;"
EMOJI = r"[\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}\x{1F1E6}-\x{1F1FF}]"
LAUGH, LAUGH_CAP = "[ㅋㅎ]{2,}", 5
FORMAL = r"(습니다|합니다|입니다|십니다|세요|니다)[\s.!?]*$"
CASUAL = r"(야|다|지|냐|거든|잖아|었어|았어|해|줘|봐|용|염|잉)[\s~.!?]*$"
STICKER = "이모티콘"


def tone_markers(text: Column) -> Column:
    """Exclamation marks, emoticons, emoji, laughs (5 at most each) and a sticker, less a formal or plus a casual ending."""
    bare = F.regexp_replace(text, r"^\s+|\s+$", "")
    tail = F.substring(bare, F.greatest(F.char_length(bare) - 9, F.lit(1)), F.lit(10))
    laughs = F.aggregate(F.regexp_extract_all(text, F.lit(LAUGH), F.lit(0)), F.lit(0), lambda s, x: s + F.least(F.char_length(x), F.lit(LAUGH_CAP)))
    counts = sum((F.regexp_count(text, F.lit(p)) for p in ("!", EMOTICON, EMOJI)), F.lit(0))
    ending = F.when(tail.rlike(FORMAL), -1).when(tail.rlike(CASUAL), 1).otherwise(0)
    return (counts + laughs + (bare == STICKER).cast("int") + ending).cast("double")


def periods(dt: Column, units=("month", "year")) -> Column:
    forms = {"day": "yyyy-MM-dd", "month": "yyyy-MM", "year": "yyyy"}
    return F.explode(F.array(*(F.struct(F.lit(u).alias("unit"), F.date_format(dt, forms[u]).alias("period")) for u in units)))


def response_gaps(messages: DataFrame, units=("month", "year")) -> DataFrame:
    """(room, unit, period, gap): the mean over day blocks of the mean minutes between messages, none negative."""
    before = F.lag("minute").over(Window.partitionBy("chatroom_id", "day").orderBy("dt", "seq"))
    gap = F.when(before.isNotNull(), F.greatest(F.lit(0), F.col("minute") - before))
    rows = messages.withColumn("day", F.to_date("dt")).withColumn("minute", F.hour("dt") * 60 + F.minute("dt")).withColumn("gap", gap)
    daily = rows.groupBy("chatroom_id", "day").agg(F.avg("gap").alias("gap")).where("gap is not null")
    return daily.select("chatroom_id", "gap", periods(F.col("day"), units).alias("p")).groupBy("chatroom_id", "p.unit", "p.period").agg(F.avg("gap").alias("gap"))


def balance(messages: DataFrame, units=("month", "year")) -> DataFrame:
    """(room, unit, period, messages, balance): entropy of the senders' shares over its maximum; one speaker has 0."""
    each = messages.select("chatroom_id", "sender", periods(F.col("dt"), units).alias("p")).groupBy("chatroom_id", "p.unit", "p.period", "sender").agg(F.count("*").alias("n"))
    total, who, nlogn = F.sum("n"), F.count("*"), F.sum(F.col("n") * F.log("n"))
    entropy = F.log(total) - nlogn / total
    return each.groupBy("chatroom_id", "unit", "period").agg(total.alias("messages"), F.when(who > 1, F.greatest(F.lit(0.0), entropy / F.log(who))).otherwise(0.0).alias("balance"))


def normalised(value: Column, *keys) -> Column:
    """0 to 100 between the least and greatest of a group; 50 where all are equal."""
    w = Window.partitionBy(*keys)
    low, high = F.min(value).over(w), F.max(value).over(w)
    return F.when(high == low, 50.0).otherwise(100 * (value - low) / (high - low))


def room_stats(messages: DataFrame, private: DataFrame, units=("month", "year")) -> DataFrame:
    """messages(owner, chatroom_id, dt, seq, sender, text), private(chatroom_id, unit, period, private_ratio) -> (owner, chatroom_id, unit, period, tone, messages, balance, gap, private_ratio): what a score needs of each room by itself."""
    tones = messages.select("owner", "chatroom_id", tone_markers(F.col("text")).alias("tone"), periods(F.col("dt"), units).alias("p")).groupBy("owner", "chatroom_id", "p.unit", "p.period").agg(F.avg("tone").alias("tone"))
    keys = ["chatroom_id", "unit", "period"]
    rows = tones.join(balance(messages, units), keys).join(response_gaps(messages, units), keys, "left").join(private.select(*keys, "private_ratio"), keys, "left")
    return rows.select("owner", *keys, "tone", "messages", "balance", "gap", "private_ratio")


def scores(stats: DataFrame) -> DataFrame:
    """room_stats of all rooms of their owners -> (chatroom_id, unit, period, mood_score)."""
    rows = stats.withColumn("speed", 1 / (F.coalesce("gap", F.lit(1440.0)) + 1))
    room, owner = ("chatroom_id", "unit"), ("owner", "unit")
    ratio = F.least(F.greatest(F.coalesce("private_ratio", F.lit(50.0)), F.lit(0.0)), F.lit(100.0))
    activity = normalised(F.col("messages"), *owner) * (0.5 + 0.5 * F.col("balance"))
    score = WEIGHTS["private"] * ratio + WEIGHTS["tone"] * normalised(F.col("tone"), *room) + WEIGHTS["activity"] * activity + WEIGHTS["speed"] * normalised(F.col("speed"), *room)
    return rows.select("chatroom_id", "unit", "period", F.round(score, 2).alias("mood_score"))


def mood_scores(messages: DataFrame, private: DataFrame, units=("month", "year")) -> DataFrame:
    """messages(owner, chatroom_id, dt, seq, sender, text), private(chatroom_id, unit, period, private_ratio) -> (chatroom_id, unit, period, mood_score).

    Of the private ratio (50 where it is missing), tone and speed among the room's
    periods, and activity among the owner's rooms. All rooms in one job.
    """
    return scores(room_stats(messages, private, units))


#: Columns of room_stats as they are stored.
STATS = "owner string, chatroom_id string, unit string, period string, tone double, messages long, balance double, gap double, private_ratio double"


def refresh(stored, messages: DataFrame, private: DataFrame, units=("month", "year"), batch: int | None = None) -> DataFrame:
    """Scores after some rooms have changed: (chatroom_id, unit, period, mood_score) of all rooms of the owners concerned, whose scores depend on each other.

    stored: Snapshots of room_stats by owner. messages(owner, ...) holds all messages of the changed rooms, and of no others: only their statistics are worked
    out anew and take the place of their old ones; those of the owners' other rooms are read from the store, and other owners' not at all.
    """
    owners = messages.select("owner").distinct()
    stored.replace(room_stats(messages, private, units), ["owner", "chatroom_id"], batch, "moods")
    return scores(stored.of(owners))
