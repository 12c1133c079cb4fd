"""Retrieval by date and vector, budgets, and citations."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from correspond.operators.prefixes import best_beginnings
from correspond.operators.series import running_total
from correspond.operators.tables import written
from correspond.operators.vectors import nearest


def date_range(text: Column, as_of: str) -> Column:
    """The first date expression of a fixed order in a question -> struct(start, end) of dates, null without one; relative to `as_of`."""
    today = F.lit(as_of).cast("date")
    g = lambda p, k: F.regexp_extract(text, p, k)
    n = lambda p, k: g(p, k).cast("int")
    both = lambda a, b=None: F.struct(a.alias("start"), (a if b is None else b).alias("end"))
    ymd = lambda y, m, d: F.try_make_date(y, m, d) if hasattr(F, "try_make_date") else F.make_date(y, m, d)
    y0, monday, first = F.year(today), F.date_trunc("week", today).cast("date"), F.trunc(today, "month")
    month = lambda d: both(F.trunc(d, "month"), F.last_day(d))
    year = lambda y: both(F.make_date(y, F.lit(1), F.lit(1)), F.make_date(y, F.lit(12), F.lit(31)))
    one = F.lit(1)
    sep = r"\s*[~～\-]\s*"
    p1, p2 = rf"(\d+)월\s*(\d+)일{sep}(\d+)월\s*(\d+)일", rf"(\d+)월\s*(\d+)일{sep}(\d+)일"
    p3, p4 = rf"(\d{{4}})-(\d{{2}})-(\d{{2}}){sep}(\d{{4}})-(\d{{2}})-(\d{{2}})", rf"(\d{{4}})-(\d{{2}})-(\d{{2}}){sep}(\d{{2}})-(\d{{2}})"
    week, ago, recent, months = r"(저저번|저번|지난)\s*주", r"(\d+)\s*일\s*전", r"최근\s*(\d+)\s*일", r"(저저번|저번|지난)\s*달"
    years_ago, moons, moons2 = r"(\d+)\s*년\s*전", r"(\d+)\s*달\s*전", r"(\d+)\s*개월\s*전"
    full, ym, yy, mm, md = r"(\d{4})\s*년\s*(\d+)\s*월\s*(\d+)\s*일", r"(\d{4})\s*년\s*(\d+)\s*월", r"(\d{4})\s*년", r"(\d+)월", r"(\d+)월\s*(\d+)일"
    iso, short = r"(\d{4})-(\d{2})-(\d{2})", r"(\d{2,4})-(\d{1,2})-(\d{1,2})"
    back = lambda p: F.when(g(p, 1) == "저저번", 2).otherwise(1)
    no_day, no_month = ~text.rlike(r"\d+일"), ~text.rlike(r"\d+월")
    y24 = F.when(n(short, 1) < 100, n(short, 1) + 2000).otherwise(n(short, 1))
    cases = [
        (text.rlike(p1), both(ymd(y0, n(p1, 1), n(p1, 2)), ymd(y0, n(p1, 3), n(p1, 4)))),
        (text.rlike(p2), both(ymd(y0, n(p2, 1), n(p2, 2)), ymd(y0, n(p2, 1), n(p2, 3)))),
        (text.rlike(p3), both(ymd(n(p3, 1), n(p3, 2), n(p3, 3)), ymd(n(p3, 4), n(p3, 5), n(p3, 6)))),
        (text.rlike(p4), both(ymd(n(p4, 1), n(p4, 2), n(p4, 3)), ymd(n(p4, 1), n(p4, 4), n(p4, 5)))),
        (text.rlike("이번 ?주"), both(monday, F.date_add(monday, 6))),
        (text.rlike(week), both(F.date_sub(monday, 7 * back(week)), F.date_add(F.date_sub(monday, 7 * back(week)), 6))),
        (text.contains("오늘"), both(today)),
        (text.contains("어제"), both(F.date_sub(today, 1))),
        (text.rlike(ago), both(F.date_sub(today, n(ago, 1)))),
        (text.rlike(recent), both(F.date_sub(today, n(recent, 1) - 1), today)),
        (text.rlike("이번 ?달"), both(first, today)),
        (text.rlike(months), month(F.add_months(first, -back(months)))),
        (text.contains("올해"), both(F.trunc(today, "year"), today)),
        (text.contains("작년"), year(y0 - 1)),
        (text.rlike(years_ago), year(y0 - n(years_ago, 1))),
        (text.rlike(moons), month(F.add_months(first, -n(moons, 1)))),
        (text.rlike(moons2), month(F.add_months(first, -n(moons2, 1)))),
        (text.rlike(full), both(ymd(n(full, 1), n(full, 2), n(full, 3)))),
        (text.rlike(ym) & no_day, month(ymd(n(ym, 1), n(ym, 2), one))),
        (text.rlike(yy) & no_month, year(n(yy, 1))),
        (text.rlike(mm) & no_day, month(ymd(y0, n(mm, 1), one))),
        (text.rlike(md), both(ymd(y0, n(md, 1), n(md, 2)))),
        (text.rlike(iso), both(ymd(n(iso, 1), n(iso, 2), n(iso, 3)))),
        (text.rlike(short), both(ymd(y24, n(short, 2), n(short, 3)))),
    ]
    out = None
    for hit, value in cases:
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out


#: Levels of spans of days: the highest is of some 2,900 years.
LEVELS = 21


def _spans(first: Column, last: Column) -> Column:
    """The fewest spans of 2^level days, each at a multiple of its length, that make up the days first to last (numbers): two a level at most."""
    spans = []
    for k in range(LEVELS):
        low, high = F.shiftright(first + F.lit((1 << k) - 1), k), F.shiftright(last + 1, k)
        odd = lambda x: x.bitwiseAND(F.lit(1)) == 1
        cell = lambda x: F.struct(F.lit(k).alias("level"), x.cast("int").alias("cell"))  # noqa: E731, B023
        spans += [F.when((low < high) & odd(low), cell(low)), F.when((low < high) & odd(high), cell(high - 1))]
    return F.filter(F.array(*spans), lambda s: s.isNotNull())


def in_ranges(queries: DataFrame, mails: DataFrame, at: str = "mail_date") -> DataFrame:
    """queries(query_id, start, end) x mails between start and end: days, both included, or times.

    A range is made up of spans of days whose lengths are powers of two, ten years of some 20, and a mail meets
    the spans of the lengths in use that its day is in, by an equi-join; so a range costs no row a day, and no range is compared with all mails.
    """
    number = lambda c: F.datediff(F.to_date(c), F.lit("1970-01-01"))
    spans = queries.select("*", F.explode(_spans(number("start"), number("end"))).alias("_s")).select("*", "_s.level", "_s.cell").drop("_s").withColumnsRenamed({"level": "_level", "cell": "_cell"})
    used = sorted(r[0] for r in spans.select("_level").distinct().collect())
    if not used:
        return spans.join(mails.withColumn("day", F.to_date(at)).limit(0), F.lit(True)).drop("_level", "_cell")
    day = number(at)
    dated = mails.withColumn("day", F.to_date(at)).select("*", F.explode(F.array(*(F.struct(F.lit(k).alias("_level"), F.shiftright(day, k).cast("int").alias("_cell")) for k in used))).alias("_m")).select("*", "_m.*").drop("_m")
    met = spans.join(dated, ["_level", "_cell"]).drop("_level", "_cell")
    kinds = dict(queries.dtypes)
    for c, keeps in (("start", F.col(at) >= F.col("start")), ("end", F.col(at) <= F.col("end"))):
        if kinds[c] != "date":
            met = met.where(keeps)
    return met


def vector_topk(vectors: DataFrame, queries: DataFrame, k: int = 30) -> DataFrame:
    """The k nearest rows of vectors(id, embedding) to each of queries(query_id, embedding) by cosine, with similarity and rank; see vectors.nearest. A null or empty vector is left out, a zero vector has a similarity of 0."""
    return nearest(vectors, queries, k)[0]


def within_budget(rows: DataFrame, keys: list[str], tokens: str, budget: int, *order) -> DataFrame:
    """The first rows of each key whose tokens fit a budget together."""
    return running_total(rows, keys, tokens, "upto", *order).where(F.col("upto") <= budget)


def batches(rows: DataFrame, keys: list[str], tokens: str, budget: int, *order) -> DataFrame:
    """Numbers runs of rows so that a run has about `budget` tokens."""
    return running_total(rows, keys, tokens, "_upto", *order).withColumn("batch", F.floor((F.col("_upto") - F.col(tokens)) / budget).cast("int")).drop("_upto")


def best_within_budget(points: DataFrame, keys: list[str], score: str, tokens: str, budget: int, *order) -> DataFrame:
    """points(keys, score, tokens, ...) -> those that fit the budget, the highest score first, with rank: what a global answer is reduced from. Points of score 0 or none are left out."""
    kept = within_budget(points.where(F.col(score) > 0), keys, tokens, budget, F.desc(score), *order)
    return kept.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy("upto", *order)))


def top_relationships(found: DataFrame, links: DataFrame, k: int = 30) -> DataFrame:
    """found(query_id, id, rank) of entities, links(source, target, weight, ...) -> (query_id, source, target, weight, rank): the k heaviest links with an end among a query's entities, each once.

    Each entity hands a query its k heaviest links at most, so no more than entities x k meet in a query's group.
    """
    ends = links.select(F.explode(F.array("source", "target")).alias("id"), "source", "target", "weight").distinct()
    heavy = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("weight"), "source", "target"))
    wanted = ends.join(found.select("id").distinct(), "id", "left_semi").withColumn("_k", heavy).where(F.col("_k") <= k)
    met = found.select("query_id", "id").join(wanted, "id").select("query_id", "source", "target", "weight").distinct()
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("weight"), "source", "target"))
    return met.withColumn("rank", place).where(F.col("rank") <= k)


def federated_usage(used: DataFrame, cited: DataFrame) -> DataFrame:
    """used(query_id, input_tokens, output_tokens) by account, cited(query_id, place, account) -> one row a query: summed usage, and the accounts cited, each once, in the order of their first place."""
    first = cited.where("account is not null").groupBy("query_id", "account").agg(F.min("place").alias("place"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("place", "account"))), lambda x: x["account"])
    sums = used.groupBy("query_id").agg(F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"))
    return sums.join(first.groupBy("query_id").agg(listed.alias("accounts")), "query_id", "left").withColumn("accounts", F.coalesce("accounts", F.array().cast("array<string>")))


CITED = r"ID:\s*(\S+)"
#: Marks that an answer may put around an id, in a class of a pattern. Fixed values.
AROUND = r"\]),.;:》」』"


def _bare(token: Column) -> Column:
    """Without marks around it; others, such as opening brackets and quotes, belong to the id."""
    return F.regexp_replace(token, rf"^[{AROUND}]+|[{AROUND}]+$", "")


def citations(answers: DataFrame, columns=("answer", "context")) -> DataFrame:
    """(query_id, answer, context) -> (query_id, cited, place): `ID: x` tokens without punctuation, short numbers left out, in order; of the context where the answer has none."""

    def found(c):
        ids = F.transform(F.regexp_extract_all(F.col(c), F.lit(CITED), F.lit(1)), _bare)
        return F.array_distinct(F.filter(ids, lambda x: (x != "") & ~x.rlike(r"^\d{1,6}$")))

    a, b = found(columns[0]), found(columns[1])
    return answers.select("query_id", F.posexplode(F.when(F.size(a) > 0, a).otherwise(b)).alias("place", "cited"))


def resolve(cited: DataFrame, mails: DataFrame) -> DataFrame:
    """cited(cite_id, cited), mails(mail_id, account_rank, seq) -> the mail meant: same id, else same local part, else one starts with the other (cited ids of 8 characters or more).

    Of several mails that fit, the first by account_rank and seq is meant. Different cited ids are resolved once; those that neither
    equi-join resolves meet the mails in the order of ids, see best_beginnings.
    """
    local = lambda c: F.split_part(c, F.lit("@"), F.lit(1))
    ids = mails.select(F.lower("mail_id").alias("key"), F.struct("account_rank", "seq", "mail_id").alias("best"))
    by_local = ids.groupBy(local(F.col("key")).alias("c_local")).agg(F.min("best").alias("by_local"))
    asked = cited.select("cite_id", F.lower("cited").alias("key"))
    same = asked.select("key").distinct().join(ids, "key", "left").groupBy("key").agg(F.min("best").alias("best"))
    both = same.withColumn("c_local", local(F.col("key"))).join(by_local, "c_local", "left")
    tier = F.when(F.col("best").isNotNull(), 1).when(F.col("by_local").isNotNull(), 2)
    tiers = written(both.select("key", F.coalesce("best", "by_local").alias("best"), tier.alias("tier")), "tiers")
    known, left = tiers.where("tier is not null"), tiers.where("tier is null and char_length(key) >= 8").select("key")
    if not left.isEmpty():
        known = known.unionByName(best_beginnings(left, ids).withColumn("tier", F.lit(3)))
    return asked.join(known, "key").select("cite_id", "best.mail_id", "tier")


def correct_senders(answers: DataFrame, mails: DataFrame, field: str = "발신인") -> DataFrame:
    """(query_id, answer), mails(mail_id, account_rank, seq, sender) -> answers in which a paragraph's sender line names who sent the mail that the paragraph cites first.

    Paragraphs without a sender line or an id that resolves stay as they are; a null
    answer becomes an empty one. Only paragraphs that may change take part in the
    joins; an answer is put together again from its own paragraphs alone.
    """
    parts = answers.select("query_id", F.posexplode(F.split(F.coalesce("answer", F.lit("")), "\n\n")).alias("place", "p"))
    cited = parts.where(F.col("p").contains(f"{field}:")).select(F.struct("query_id", "place").alias("cite_id"), _bare(F.regexp_extract("p", CITED, 1)).alias("cited")).where("cited <> ''")
    senders = mails.groupBy("mail_id").agg(F.min_by("sender", F.struct("account_rank", "seq")).alias("sender"))
    true = resolve(cited, mails).join(senders, "mail_id").where("sender <> ''").select("cite_id.query_id", "cite_id.place", "sender")
    head, tail = F.regexp_extract("p", rf"(?s)\A(.*?{field}:\s*)", 1), F.regexp_extract("p", rf"(?s)\A.*?{field}:\s*[^\n]*(.*)\z", 1)
    fixed = parts.join(true, ["query_id", "place"], "left").select("query_id", "place", F.when(F.col("sender").isNull(), F.col("p")).otherwise(F.concat(head, "sender", tail)).alias("p"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "p"))), lambda x: x["p"]), "\n\n")
    return fixed.groupBy("query_id").agg(whole.alias("answer"))
