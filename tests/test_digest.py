"""Digests give all of their input back, and running totals are spread over tasks."""

import datetime
import random
from collections import defaultdict

from pyspark.sql import functions as F

from correspond.operators import retrieval, series


def test_digest_has_all_items(spark):
    day = datetime.date(2024, 1, 1)
    rows = [("a", day + datetime.timedelta(k), k, f"p{k}", f"text {k:03d} " + "x" * (k % 40)) for k in range(80)]
    df = spark.createDataFrame(rows, "account string, day date, seq long, who string, text string")
    parts = series.digest(df, ["account"], 30, 200).where("unit = 'year'").orderBy("part").collect()
    assert "\n".join(p.text for p in parts).split("\n") == [r[4][:30] for r in rows]
    assert len(parts) > 5 and sum(p.n_items for p in parts) == 80 and all(len(p.text) <= 230 for p in parts)
    assert {c for p in parts for c in p.contacts} == {r[3] for r in rows}
    (whole,) = series.period_contacts(df, ["account"]).where("unit = 'year'").collect()
    assert whole.n_items == 80 and whole.contacts == sorted(r[3] for r in rows)


def test_running_total_of_a_hot_key(spark):
    """A key with nine of ten rows: sums as in one pass, and no range with more than four times its share."""
    r = random.Random(2)
    rows = [("hot" if k % 10 else r.choice(["a", None]), k, r.randrange(5)) for k in range(20_000)]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "key string, id long, n long").repartition(7)
    got = series.running_total(df, ["key"], "n", "upto", F.desc("id"))
    want, total = {}, defaultdict(int)
    for key, k, n in sorted(rows, key=lambda x: -x[1]):
        total[key] += n
        want[k] = total[key]
    assert {x.id: x.upto for x in got.collect()} == want
    ranges = df.repartitionByRange("key", F.desc("id")).groupBy(F.spark_partition_id()).count().collect()
    assert max(x["count"] for x in ranges) <= 4 * sum(x["count"] for x in ranges) / len(ranges)


def test_best_within_budget(spark):
    rows = [("q", i, s, 10) for i, s in enumerate([3, 0, 9, 7, 7, None, 1])]
    df = spark.createDataFrame(rows, "query string, id long, score long, tokens long")
    got = retrieval.best_within_budget(df, ["query"], "score", "tokens", 40, "id").orderBy("rank").collect()
    assert [(x.id, x.rank) for x in got] == [(2, 1), (3, 2), (4, 3), (0, 4)]
