"""Chat formatting with typed content parts, with DataFrame functions alone."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from correspond.llm.common import table

#: The template: <|turn|>ROLE<|text|>PARTS<|end|> for each turn. Fixed values.
TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
#: Control strings, of this template and of common others, and what stands for them inside texts; % comes first, and is undone last.
ESCAPES = (("%", "%25"), ("<|", "%3C|"), ("<s>", "%3Cs>"), ("</s>", "%3C/s>"), ("<<SYS>>", "%3C<SYS>>"), ("<</SYS>>", "%3C</SYS>>"), ("[INST]", "%5BINST]"), ("[/INST]", "%5B/INST]"))
PARTS = "array<struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>>"
#: Tokens that a placeholder stands for: per 14 x 14 pixels, per second, per page.
PATCH, PER_SECOND, PER_PAGE = 14, 25, 600


def escape(text: Column) -> Column:
    for plain, coded in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(coded))
    return text


def unescape(text: Column) -> Column:
    for plain, coded in (("<", "%3C"), ("[", "%5B"), ("%", "%25")):
        text = F.replace(text, F.lit(coded), F.lit(plain))
    return text


def text_part(text: Column) -> Column:
    """A message that is one text as an array of typed parts."""
    null = F.lit(None)
    return F.array(F.struct(F.lit("text").alias("type"), F.coalesce(text, F.lit("")).alias("text"), null.cast("string").alias("ref"), null.cast("int").alias("width"), null.cast("int").alias("height"), null.cast("double").alias("seconds"), null.cast("int").alias("pages")))


def format_turns(turns: DataFrame) -> DataFrame:
    """turns(conv_id, turn, role, parts) -> (conv_id, turn, segment, loss_start, loss_chars, attachments), a row for each row of turns.

    A visitor walks the parts in order: text is escaped; an image, a sound or a
    document becomes a placeholder <|TYPE:K|>, K its number among the turn's
    attachments, which are listed with reference and the number of tokens that they
    expand to. A part of another type is kept as text. segment is the turn under the
    template; the parts of an assistant are under the loss mask, as loss_start and
    loss_chars in code points of segment (others: 0 characters).

    Null texts, roles and parts count as empty. Turns are formatted row by row, so a
    conversation of any length, and a turn's text of any length, is spread over all tasks; its text is its segments in
    order. An empty table gives none.
    """
    parts = F.coalesce(F.col("parts"), F.array().cast(PARTS))
    media = lambda p: F.coalesce(p["type"].isin("image", "audio", "document"), F.lit(False))
    zero = F.lit(0.0)
    tokens = lambda p: (
        F.when(p["type"] == "image", F.ceil(F.coalesce(p["width"], F.lit(0)) / PATCH) * F.ceil(F.coalesce(p["height"], F.lit(0)) / PATCH))
        .when(p["type"] == "audio", F.ceil(F.coalesce(p["seconds"], zero) * PER_SECOND)).otherwise(F.coalesce(p["pages"], F.lit(0)) * PER_PAGE).cast("long")
    )
    attachments = F.transform(F.filter(parts, media), lambda p, k: F.struct(k.alias("number"), p["type"].alias("type"), p["ref"].alias("ref"), tokens(p).alias("tokens")))
    start = F.struct(F.lit("").alias("text"), F.lit(0).alias("n"))
    visit = lambda s, p: F.struct(
        F.concat(s["text"], F.when(media(p), F.concat(F.lit("<|"), p["type"], F.lit(":"), s["n"].cast("string"), F.lit("|>"))).otherwise(escape(F.coalesce(p["text"], F.lit(""))))).alias("text"),
        (s["n"] + media(p).cast("int")).alias("n"),
    )
    content = F.aggregate(parts, start, visit, lambda s: s["text"])
    role = escape(F.coalesce(F.col("role"), F.lit("")))
    head = F.concat(F.lit(TURN), role, F.lit(TEXT))
    rows = turns.select("conv_id", "turn", head.alias("head"), content.alias("content"), attachments.alias("attachments"), F.coalesce(F.col("role") == "assistant", F.lit(False)).alias("learn"))
    return rows.select(
        "conv_id", "turn", F.concat("head", "content", F.lit(END)).alias("segment"), F.when(F.col("learn"), F.char_length("head")).otherwise(0).alias("loss_start"),
        F.when(F.col("learn"), F.char_length("content")).otherwise(0).alias("loss_chars"), "attachments",
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """Output of format_turns on texts -> (conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_attachments, attachment_tokens), one row a conversation.

    Turns follow each other by turn (null first), equal ones by segment. A digest is
    of one string, so a conversation meets in one row here and only here; the turns'
    texts are shuffled once, gathered by map tasks first.
    """
    turn = F.struct("turn", "segment", "loss_start", "loss_chars")
    gathered = formatted.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"), F.sum(F.char_length("segment")).alias("formatted_chars"), F.sum(F.size("attachments")).alias("n_attachments"), F.sum(F.aggregate("attachments", F.lit(0).cast("long"), lambda s, a: s + a["tokens"])).alias("attachment_tokens"))

    def over(name: str, f) -> Column:
        return F.array_join(F.transform(name, f), "")

    seg = lambda t: t["segment"]
    split = lambda t: F.split(F.substring_index(F.substring(seg(t), len(TURN) + 1, 1 << 30), END, 1), r"<\|text\|>", 2)
    said = over("turns", lambda t: F.concat(unescape(F.get(split(t), F.lit(0))), F.lit("\n"), unescape(F.get(split(t), F.lit(1))), F.lit("\n")))
    learnt = over("turns", lambda t: unescape(F.substring(seg(t), t["loss_start"] + 1, t["loss_chars"])))
    out = gathered.select("conv_id", F.size("turns").cast("long").alias("n_turns"), said.alias("said"), learnt.alias("learnt"), "formatted_chars", "n_attachments", "attachment_tokens")
    return out.select("conv_id", "n_turns", F.sha2(F.encode("said", "UTF-8"), 256).alias("turns_sha256"), F.char_length("learnt").cast("long").alias("loss_chars"), F.sha2(F.encode("learnt", "UTF-8"), 256).alias("loss_sha256"), F.col("formatted_chars").cast("long").alias("formatted_chars"), "n_attachments", "attachment_tokens")


def op4_chat(spark, sf_dir):
    """All conversations and one, numbered -1, whose texts are control strings of the usual kinds."""
    said = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    return read_back(format_turns(said.unionByName(hard).select("conv_id", "turn", "role", text_part(F.col("text")).alias("parts"))))
