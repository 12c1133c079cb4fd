"""Series over days and months, and period digests."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from correspond.operators.tables import written


def in_days(rows: DataFrame, column: str, start: str, end: str) -> DataFrame:
    """Rows of whole days start to end."""
    at = F.col(column)
    return rows.where((at >= F.lit(start).cast("timestamp_ntz")) & (at < F.date_add(F.lit(end).cast("date"), 1).cast("timestamp_ntz")))


def exchange(mails: DataFrame, keys: list[str], unit: str) -> DataFrame:
    """Mails sent and received for each key and period (`day` or `month`)."""
    period = F.date_format("mail_date", "yyyy-MM") if unit == "month" else F.to_date("mail_date").cast("string")
    return mails.groupBy(*keys, period.alias("period")).agg(F.count_if(F.col("direction") == "sent").alias("sent"), F.count_if(F.col("direction") == "received").alias("received"))


def dense_months(counts: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """Fills in the months without mail of years that have some, within the range."""
    years = counts.select(*keys, F.substring("period", 1, 4).alias("year")).distinct()
    first = F.greatest(F.concat("year", F.lit("-01-01")).cast("date"), F.trunc(F.lit(start).cast("date"), "month"))
    last = F.least(F.concat("year", F.lit("-12-01")).cast("date"), F.trunc(F.lit(end).cast("date"), "month"))
    months = years.select(*keys, F.explode(F.sequence(first, last, F.expr("interval 1 month"))).alias("m")).select(*keys, F.date_format("m", "yyyy-MM").alias("period"))
    return months.join(counts, [*keys, "period"], "left").fillna(0, ["sent", "received"])


def top_counts(rows: DataFrame, keys: list[str], count: str, k: int) -> DataFrame:
    """The k highest counts of each key, ties by name, with the percent of the highest. Map tasks keep k rows of a key, so that a hot key is no more than tasks x k rows."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(count), "name"))
    top = rows.where(F.col(count) > 0).withColumn("rank", place).where(F.col("rank") <= k)
    return top.withColumn("percent", F.round(100.0 * F.col(count) / F.max(count).over(Window.partitionBy(*keys)), 4))


def running_total(rows: DataFrame, keys: list[str], value: str, name: str, *order) -> DataFrame:
    """rows with the sum of `value` over each key's rows up to and with each one, in the given order, which should tell rows apart.

    Rows are cut into ranges of (keys, order), each range is summed, and a range adds to
    its own running sum what the ranges before it hold: a key of any number of rows is spread over all tasks.
    """
    ranges = written(rows.repartitionByRange(*keys, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    sums = ranges.groupBy(*keys, "_range").agg(F.sum(value).alias("_sum"))
    before = F.coalesce(F.sum("_sum").over(Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select(F.struct(*keys).alias("_keys"), F.col("_range").alias("_of"), before.alias("_before"))
    at = (F.struct(*keys).eqNullSafe(F.col("_keys"))) & (F.col("_range") == F.col("_of"))
    own = F.sum(value).over(Window.partitionBy(*keys, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return ranges.withColumn(name, own).join(sums, at).withColumn(name, F.col("_before") + F.col(name)).drop("_range", "_keys", "_of", "_before")


def _periods(rows: DataFrame) -> DataFrame:
    """Each row once in its month and once in its year."""
    units = F.array(F.struct(F.lit("month").alias("unit"), F.date_format("day", "yyyy-MM").alias("period")), F.struct(F.lit("year").alias("unit"), F.date_format("day", "yyyy").alias("period")))
    return rows.select("*", F.explode(units).alias("_u")).select(*rows.columns, "_u.*")


def digest(rows: DataFrame, keys: list[str], cut: int, budget: int) -> DataFrame:
    """rows(keys, day, seq, who, text) -> text of each month and year in order, in numbered parts of `budget` characters or so, each with its number of items and its sorted contacts.

    No item is lost: part k has the items that begin in the k-th `budget` characters of a
    period, each cut to `cut` characters. A null text counts as an item and adds nothing.
    """
    items = _periods(rows.select(*keys, "day", "seq", "who", F.substring("text", 1, cut).alias("text")))
    items = items.withColumn("_n", F.coalesce(F.char_length("text"), F.lit(0)) + 1)
    period = [*keys, "unit", "period"]
    placed = running_total(items, period, "_n", "_upto", "day", "seq")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("day", "seq", "text"))), lambda x: x["text"]), "\n")
    return placed.groupBy(*period, F.floor((F.col("_upto") - F.col("_n")) / budget).cast("int").alias("part")).agg(F.count("*").alias("n_items"), text.alias("text"), F.array_sort(F.collect_set("who")).alias("contacts"))


def period_contacts(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows(keys, day, who) -> of each month and year the number of items and all contacts, sorted."""
    once = _periods(rows.select(*keys, "day", "who")).groupBy(*keys, "unit", "period", "who").agg(F.count("*").alias("n"))
    return once.groupBy(*keys, "unit", "period").agg(F.sum("n").alias("n_items"), F.array_sort(F.collect_list("who")).alias("contacts"))


def ticks(spans: DataFrame) -> DataFrame:
    """spans(keys, first, last) of dates -> the same with ticks: the first day, the firsts of each third month from the first day's month on (each sixth where the span is over 30 months of 30 days), and the last day."""
    step = F.when(F.datediff("last", "first") / 30.0 > 30, F.expr("interval 6 months")).otherwise(F.expr("interval 3 months"))
    inner = F.filter(F.sequence(F.trunc("first", "month"), F.col("last"), step), lambda t: t >= F.col("first"))
    return spans.withColumn("ticks", F.array_sort(F.array_distinct(F.concat(F.array("first"), inner, F.array("last")))))
