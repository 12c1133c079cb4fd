"""Intimacy scores of correspondents, and what is made of them."""

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from correspond.functions.text import addresses

#: Weights of tones. Fixed values.
TONES = {"casual": 1.0, "transactional": 0.5, "formal": 0.2, "notification": 0.1, "alert": 0.1}


def tone_score() -> Column:
    """Of a mail: the graph's tone, averaged with friendliness where that was judged."""
    kg = F.coalesce(F.create_map(*(F.lit(x) for pair in TONES.items() for x in pair))[F.coalesce("kg_tone", F.lit(""))], F.lit(0.0))
    return F.when(F.col("llm_tone").isNull(), kg).otherwise((kg + (F.col("llm_tone") == "friendly").cast("double")) / 2)


def rounded(x: Column, digits: int) -> Column:
    """As the SQL rounds: the product with a power of ten goes to the nearest whole number, halves away from zero. F.round goes by the printed decimal instead, and parts at halves that the product meets exactly."""
    return F.round(x * 10.0**digits, 0) / 10.0**digits


def by_person(mails: DataFrame) -> DataFrame:
    """mails(account, sender, receiver, direction, ...) of address fields -> a row for each person of a mail: each address of the receivers of a sent mail, or of the senders of a received one, once; the owner's own is left out."""
    field = F.when(F.col("direction") == "sent", F.col("receiver")).when(F.col("direction") == "received", F.col("sender"))
    return mails.withColumn("person", F.explode(F.array_distinct(addresses(field)))).where(F.col("person") != F.lower("account"))


def intimacy(mails: DataFrame, as_of: str, start: str | None = None, end: str | None = None, end_inclusive_day: bool = True, volume: bool = True, decay: bool = True, persons: DataFrame | None = None) -> DataFrame:
    """Score of every (account, person) in one aggregation: balance, replies and tone, then volume and age.

    `persons` adds correspondents without mail, of score 0. The last day of a range
    counts whole unless end_inclusive_day is off. Mails with a seq are added up in its order.
    """
    if start:
        mails = mails.where(F.col("mail_date") >= F.lit(start).cast("timestamp_ntz"))
    if end:
        to = F.lit(end).cast("timestamp_ntz")
        mails = mails.where(F.col("mail_date") < F.date_add(F.lit(end).cast("date"), 1).cast("timestamp_ntz") if end_inclusive_day else F.col("mail_date") <= to)
    tone = F.avg(tone_score())
    if "seq" in mails.columns:  # a sum of fractions depends on its order: here it is that of the mails, however they are dealt out
        mails = mails.withColumn("_tones", F.sum(tone_score()).over(Window.partitionBy("account", "person").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        tone = F.max_by("_tones", "seq") / F.count("*")
    sums = mails.groupBy("account", "person").agg(
        F.count("*").alias("n"), F.count_if(F.col("direction") == "sent").alias("sent"), F.count_if(F.col("direction") == "received").alias("received"), F.count_if("is_reply").alias("replies"),
        F.avg("reply_elapsed_hours").alias("hours"), tone.alias("tone"), F.max("mail_date").alias("last"),
    )
    if persons is not None:
        sums = persons.select("account", "person").distinct().join(sums, ["account", "person"], "left").fillna(0, ["n", "sent", "received", "replies", "tone"])
    n = F.col("n")
    balance = F.when(n > 0, 1 - F.abs(F.col("sent") - F.col("received")) / n).otherwise(0.0)
    replies = F.when(n > 0, F.col("replies") / n * F.exp(-0.01 * F.coalesce("hours", F.lit(0.0)))).otherwise(0.0)
    scored = sums.withColumns({"r": balance, "p": replies}).withColumn("eis", 0.3 * F.col("r") + 0.4 * F.col("p") + 0.3 * F.col("tone"))
    if volume:
        scored = scored.withColumn("eis", F.col("eis") * (1 - F.exp(-0.05 * n)))
    if decay:
        scored = scored.withColumn("eis", F.col("eis") * F.coalesce(F.exp(-0.005 * F.datediff(F.lit(as_of).cast("date"), F.to_date("last"))), F.lit(1.0)))
    return scored.select("account", "person", "n", "sent", "received", "replies", rounded(F.col("hours"), 4).alias("t_bar"), *(rounded(F.col(c), 6).alias(out) for c, out in (("r", "r"), ("p", "p"), ("tone", "t"), ("eis", "eis"))))


def ranked(scores: DataFrame) -> DataFrame:
    """Persons of each account by score, highest first, then by address."""
    return scores.withColumn("rank", F.row_number().over(Window.partitionBy("account").orderBy(F.desc("eis"), "person")))


def tier(percent: Column) -> Column:
    """Steps of 90, 70, 40 and 15."""
    return F.when(percent >= 90, "closest").when(percent >= 70, "close").when(percent >= 40, "regular").when(percent >= 15, "distant").otherwise("rare")


def one_dimensional_means(values: np.ndarray, weights: np.ndarray, k: int) -> np.ndarray:
    """Centres of at most k groups of ascending different values, by Lloyd's rounds from values at even places among them; equal ones (to three digits) are one."""
    n = min(k, len(values))
    places = np.floor(np.arange(n) * (len(values) - 1) / max(1, n - 1) + 0.5).astype(int)
    centres = values[places].astype(float)
    for _ in range(100):
        own = np.abs(values[:, None] - centres[None]).argmin(axis=1)
        size = np.bincount(own, weights, n)
        new = np.where(size > 0, np.bincount(own, weights * values, n) / np.maximum(size, 1), centres)
        moved = (np.abs(new - centres) > 1e-9).any()
        centres = new
        if not moved:
            break
    return np.unique(np.floor(centres * 1000 + 0.5) / 1000)


def bands(scores: DataFrame, k: int = 5) -> DataFrame:
    """One-dimensional k-means of rounded percents within each account: (account, person, percent, band), band 1 the lowest.

    Only the histogram of at most 101 percents reaches the helper; persons get their
    band by an equi-join on the percent. A percent half way between two centres is in the upper band.
    """

    def centres(pdf):
        import pandas as pd

        order = pdf.sort_values("percent")
        c = one_dimensional_means(order["percent"].to_numpy(float), order["n"].to_numpy(float), k)
        return pd.DataFrame({"account": pdf["account"], "percent": pdf["percent"], "band": np.searchsorted((c[1:] + c[:-1]) / 2, pdf["percent"].to_numpy(float), "right") + 1})

    told = scores.select("account", "person", F.floor(100 * F.col("eis") + 0.5).cast("int").alias("percent"))
    found = told.groupBy("account", "percent").agg(F.count("*").alias("n")).groupBy("account").applyInPandas(centres, "account string, percent int, band int")
    return told.join(found, ["account", "percent"]).select("account", "person", "percent", "band")


def band_floors(banded: DataFrame) -> DataFrame:
    """(account, person, percent, band) -> (account, band, n, floor, floor_above): the lowest percent of each band and of the next higher one of the account."""
    floors = banded.groupBy("account", "band").agg(F.count("*").alias("n"), F.min("percent").alias("floor"))
    return floors.withColumn("floor_above", F.lead("floor").over(Window.partitionBy("account").orderBy("band")))
