"""Chat exports: lines to messages, messages to day blocks, and blocks to messages."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from correspond.operators import scan
from correspond.operators.keywords import occurrences
from correspond.operators.tables import written

_DATE = r"(\d{4})년\s*(\d{1,2})월\s*(\d{1,2})일"
_TIME = r"(오전|오후)\s*(\d{1,2}):(\d{2})"
#: Grammars of export lines, in the order that they are tried in. Fixed values.
SEPARATORS = (rf"^-+\s*{_DATE}.*-+$", rf"^{_DATE}\s*(?:월요일|화요일|수요일|목요일|금요일|토요일|일요일)?\s*$")
MOBILE = (rf"^{_DATE}\s+{_TIME},\s*(.+?)\s*:\s*(.*)$", rf"^(\d{{4}})\.\s*(\d{{1,2}})\.\s*(\d{{1,2}})\.\s+{_TIME},\s*(.+?)\s*:\s*(.*)$")
SYSTEM = rf"^{_DATE}\s+{_TIME}:\s*(.*)$"
PC = rf"^\[(.+?)\]\s*\[{_TIME}\]\s*(.*)$"
#: Messages of a block at most. Fixed value.
BLOCK = 400
#: Line ends, as a pattern, and the characters of white space that are taken off a line's end. Fixed values.
LINE_ENDS = r"\R|[\x1c-\x1e]"
TRAILING = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: How an export's first line gives a room's name. Fixed value.
ROOM_HINT = r"(?d)카카오톡\s*대화\s*[:：]?\s*(.+)"
#: Lines of a file that one task scans.
SEGMENT = 100_000


def hour_of(half: Column, hour: Column) -> Column:
    """Hours of the day from a morning or afternoon hour."""
    h = hour.cast("int")
    return F.when((half == "오후") & (h != 12), h + 12).when((half == "오전") & (h == 12), 0).otherwise(h)


def room_name(text: Column, fallback: Column) -> Column:
    """A room's name from the first line with text among an export's first five: what follows the hint; without the hint, or nothing after it, the fallback."""
    bare = lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")
    first = F.get(F.filter(F.transform(F.slice(F.split(text, LINE_ENDS, 6), 1, 5), bare), lambda x: x != ""), F.lit(0))
    return F.coalesce(F.nullif(F.trim(F.regexp_extract(first, ROOM_HINT, 1)), F.lit("")), fallback)


def lines_of(texts: DataFrame, keys: list[str]) -> DataFrame:
    """Whole texts -> (keys, line_no, line), split at every kind of line end. Files that are larger than a row should be are read by sources.readers.export_lines."""
    return texts.select(*keys, F.posexplode(F.split("text", LINE_ENDS)).alias("line_no", "line"))


def parse_export(lines: DataFrame, file: str = "file", segment: int = SEGMENT) -> DataFrame:
    """(file, line_no, line) -> (file, message, dt, sender, text, is_system).

    The date is carried forward over a file's lines; a line that starts no message
    continues the one before; lines before the first message and blank ones fall away, and so does white space at
    the end of lines. Files are scanned in segments of so many lines, each of which goes on from the date and the message that
    those before leave open, so one file is spread over all tasks; only the lines of one message meet in one.
    """
    lines = lines.select(file, "line_no", F.rtrim("line", F.lit(TRAILING)).alias("line"))
    line = F.col("line")
    # Of each grammar: year, month, day, half of the day, hour, minute, sender, what is said. A line is read once by the one that it fits.
    groups = lambda *order: "\0".join(f"${k}" if k else "" for k in order)
    cases = [*(("sep", p, groups(1, 2, 3)) for p in SEPARATORS), *(("message", p, groups(1, 2, 3, 4, 5, 6, 7, 8)) for p in MOBILE), ("system", SYSTEM, groups(1, 2, 3, 4, 5, 6, 0, 7)), ("pc", PC, groups(0, 0, 0, 2, 3, 4, 1, 5))]
    fits = None
    for k, (_, p, _) in enumerate(cases):
        fits = F.when(line.rlike(p), k) if fits is None else fits.when(line.rlike(p), k)
    rows = lines.withColumn("fits", fits)
    read, kind = F.lit(None), F.lit(None)
    for k, (name, p, order) in enumerate(cases):
        read = F.when(F.col("fits") == k, F.regexp_replace(line, p, order)).otherwise(read)
        kind = F.when(F.col("fits") == k, name).otherwise(kind)
    rows = rows.select(file, "line_no", "line", kind.alias("kind"), F.split(read, "\0", 8).alias("g"))
    g = lambda k: F.get("g", F.lit(k))
    own = F.when(F.col("kind") != "pc", F.make_date(g(0).cast("int"), g(1).cast("int"), g(2).cast("int")))
    clock = F.when(F.col("kind") != "sep", hour_of(g(3), g(4)) * 60 + g(5).cast("int"))
    sender, kept = F.when(F.col("kind").isin("message", "pc"), F.trim(g(6))), F.when(F.col("kind").isNull() | (F.col("kind") == "pc"), line)
    rows = rows.select(file, "line_no", F.floor(F.col("line_no") / segment).alias("_segment"), "kind", own.alias("own"), clock.alias("minutes"), sender.alias("sender"), F.when(F.col("kind") != "sep", g(7)).alias("said"), kept.alias("line"))
    # Lines are read once; the scans take no more than the columns that they need.
    rows = written(rows, "lines").where("kind is not null or line <> ''")
    several = not rows.where("_segment > 0").isEmpty()
    rows = scan.carry_forward(rows, [file], "_segment", "line_no", F.col("own"), "day", several)
    start = F.coalesce(F.col("kind").isin("message", "system") | ((F.col("kind") == "pc") & F.col("day").isNotNull()), F.lit(False))
    dt = F.expr("timestampadd(MINUTE, minutes, cast(day as timestamp_ntz))")
    rows = scan.running_count(rows.withColumn("start", start), [file], "_segment", "line_no", F.col("start"), "message", several)
    rows = rows.where("message > 0 and (start or kind is null or kind = 'pc')").withColumn("said", F.when(F.col("start"), F.col("said")).otherwise(F.col("line")))
    first = F.when(F.col("start"), F.struct(dt.alias("dt"), "sender", (F.col("kind") == "system").alias("is_system")))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "said"))), lambda x: x["said"]), "\n")
    return rows.groupBy(file, "message").agg(F.max(first).alias("m"), text.alias("text")).select(file, "message", "m.dt", "m.sender", "text", "m.is_system")


def day_blocks(messages: DataFrame, room: str = "chatroom_id") -> DataFrame:
    """Messages with day, block_id (`YYYY-MM-DD_NN`), and their place in the block: days of a room, cut after BLOCK messages."""
    place = F.row_number().over(Window.partitionBy(room, "day").orderBy("dt", "seq")) - 1
    rows = messages.withColumn("day", F.to_date("dt")).withColumn("place", place)
    return rows.withColumn("block_id", F.format_string("%s_%02d", F.col("day").cast("string"), F.floor(F.col("place") / BLOCK).cast("int") + 1)).withColumn("place", F.col("place") % BLOCK)


def block_facts(rows: DataFrame, room: str = "chatroom_id") -> DataFrame:
    """Each block's real messages, participants in the order they first speak, and their number.

    Where rows have a column `listed`, the participants that the block's header lists count instead, unless it lists nobody."""
    real = ~F.coalesce("is_system", F.lit(False)) & F.col("sender").isNotNull()
    listed = F.max("listed") if "listed" in rows.columns else F.lit(None).cast("array<string>")
    first = rows.groupBy(room, "block_id", "sender").agg(F.count_if(real).alias("n"), F.min(F.when(real, F.col("place"))).alias("at"), listed.alias("listed"))
    spoke = F.transform(F.array_sort(F.collect_list(F.when(F.col("at").isNotNull(), F.struct("at", "sender")))), lambda x: x["sender"])
    facts = first.groupBy(room, "block_id").agg(F.sum("n").alias("message_count"), spoke.alias("spoke"), F.max("listed").alias("listed"))
    who = F.when(F.size("listed") > 0, F.col("listed")).otherwise(F.col("spoke"))
    return facts.select(room, "block_id", "message_count", F.size(who).cast("long").alias("participant_count"), who.alias("participants"))


#: Header lines of a stored block, what stands for nobody, and the body. Fixed values.
BLOCK_HEADER = {"block_id": "ID", "room": "채팅방", "block_date": "날짜", "participants": "참여자"}
NOBODY = "알 수 없음"
BLOCK_BODY = r"(?s)\[대화 내용\]\s*\n(.*?)(?:\n=+|\z)"
#: A line of a stored block that starts a message: the time, and a notice or a sender with what they say. Fixed value.
MESSAGE_LINE = r"(?d)^(\d{2}:\d{2})\s+(?:\[알림\]\s?(.*)|([^:\n]+?):\s(.*))$"


def render_blocks(rows: DataFrame, room: str = "chatroom_id", name: str = "room_name") -> DataFrame:
    """Messages of day_blocks with the room's name -> (room, block_id, text) as stored: header, participants in the order they first speak, lines."""
    facts = block_facts(rows, room).select(room, "block_id", "participants")
    named = rows.groupBy(room, "block_id").agg(F.max(name).alias("_name"))
    head = [F.concat(F.lit(f"{BLOCK_HEADER[c]}: "), v) for c, v in (("block_id", F.col("block_id")), ("room", F.col("_name")), ("block_date", F.substring("block_id", 1, 10)), ("participants", F.when(F.size("participants") > 0, F.array_join("participants", ", ")).otherwise(F.lit(NOBODY))))]
    bar = F.lit("=" * 60)
    text = F.concat_ws("\n", bar, *head, F.lit(""), F.lit("[대화 내용]"), "text", bar)
    return render_lines(rows, room).join(facts, [room, "block_id"]).join(named, [room, "block_id"]).select(room, "block_id", text.alias("text"))


def stored_blocks(texts: DataFrame, keys: list[str]) -> DataFrame:
    """texts(keys, seq, text) -> (keys, block_id, room, block_date, listed, text): each block of an id once, by its first text; texts without an id, as the later parts of a cut block, are left out. text is the body."""
    g = lambda name: F.trim(F.regexp_extract("text", rf"(?md)^{name}:\s*(.+)$", 1))
    fields = {c: g(name) for c, name in BLOCK_HEADER.items()}
    listed = F.filter(F.transform(F.split(fields["participants"], ","), lambda x: F.trim(x)), lambda x: (x != "") & (x != NOBODY))
    first = texts.withColumn("block_id", fields["block_id"]).where("block_id <> ''").groupBy(*keys, "block_id").agg(F.min_by("text", "seq").alias("text"))
    return first.select(*keys, "block_id", fields["room"].alias("room"), F.nullif(fields["block_date"], F.lit("")).alias("block_date"), listed.alias("listed"), F.regexp_extract("text", BLOCK_BODY, 1).alias("text"))


def render_lines(rows: DataFrame, room: str = "chatroom_id") -> DataFrame:
    """(room, block_id, text): the lines `HH:MM sender: text` of a block."""
    line = F.concat(F.date_format("dt", "HH:mm"), F.when(F.col("is_system"), F.concat(F.lit(" [알림] "), "text")).otherwise(F.concat(F.lit(" "), "sender", F.lit(": "), "text")))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", line.alias("line")))), lambda x: x["line"]), "\n")
    return rows.groupBy(room, "block_id").agg(text.alias("text"))


def parse_lines(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """Bodies of blocks -> (keys, message, time, sender, text, is_system): a line that starts with a time starts a message, others go on."""
    w = Window.partitionBy(*keys).orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = lines_of(blocks, keys).withColumn("start", F.col("line").rlike(MESSAGE_LINE))
    rows = rows.withColumn("message", F.sum(F.col("start").cast("int")).over(w)).where("message > 0")
    get = lambda k: F.when(F.col("start"), F.regexp_extract("line", MESSAGE_LINE, k))
    notice = F.col("line").rlike(r"^\d{2}:\d{2}\s+\[알림\]")
    said = F.struct("line_no", F.when(~F.col("start"), F.col("line")).when(notice, get(2)).otherwise(get(4)).alias("said"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(said)), lambda x: x["said"]), "\n")
    sender = F.max(F.when(F.col("start") & ~notice, F.trim(get(3))))
    return rows.groupBy(*keys, "message").agg(F.max(get(1)).alias("time"), sender.alias("sender"), text.alias("text"), F.max(F.col("start") & notice).alias("is_system"))


def mentions(blocks: DataFrame, keywords: DataFrame) -> DataFrame:
    """blocks(room, block_id, sender, text), keywords(keyword): literal, non-overlapping occurrences, 1 or more."""
    keys = [c for c in blocks.columns if c != "text"]
    return occurrences(blocks, keywords).groupBy(*keys, "keyword").agg(F.sum("n").alias("mention_count"))
