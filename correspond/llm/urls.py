"""URL filters: host-suffix and path-prefix expressions, joined on short hashes and confirmed by full digests."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from correspond.llm.common import materialise, sent_if_small, table

#: Rules of this number at most are sent to every task; more are joined by a shuffle.
MAX_BROADCAST = 50_000


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first :// up to /, ? or #, A-Z lower-cased; path: then up to ? or #. Null or no ://: both empty."""
    at = F.instr(url, "://")
    rest = F.coalesce(F.when(at > 0, F.substring(url, at + 3, F.lit(1 << 30))), F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat_ws("\u0001", host, path), 256)


def _short(digest: Column) -> Column:
    return F.substring(digest, 1, 8)


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """pages(page_id, url), rules(host, path, verdict) -> (page_id, host, path, rule, verdict), a row for each row of pages.

    A rule fits a url whose host is the rule's or ends in it at a dot and whose path
    starts with the rule's. A url is expanded into the suffixes of its host; those
    that rules have, met on the first 8 digits of a SHA-256 and confirmed on all of it, bring the
    lengths of their paths, and suffix and path prefix of each length meet the rules
    in the same way. Of fitting rules the longest wins (host and path together; then
    the longer host, then the later verdict by name); without one the verdict is `default`.

    All of that precedes the only shuffle of pages, one row a url, which puts
    a url's expressions together again; rules beyond max_broadcast are joined by
    shuffles, whatever their number. Null urls and such without :// have empty host and path and fit no rule but one
    of empty host; urls of any length are read whole; rules with a null host or path count it as empty; repeated pages
    give repeated rows; empty tables give none or only defaults; other columns are
    not read.
    """
    rules = rules.select(F.coalesce("host", F.lit("")).alias("r_host"), F.coalesce("path", F.lit("")).alias("r_path"), F.col("verdict").alias("r_verdict"))
    rules = rules.groupBy("r_host", "r_path").agg(F.max("r_verdict").alias("r_verdict")).withColumn("r_digest", _digest(F.col("r_host"), F.col("r_path")))
    rules = materialise(rules.withColumn("short", _short(F.col("r_digest"))), "rules")
    hosts = rules.groupBy("r_host").agg(F.sort_array(F.collect_set(F.char_length("r_path"))).alias("lengths"))
    hosts = materialise(hosts.select(F.sha2("r_host", 256).alias("h_digest"), _short(F.sha2("r_host", 256)).alias("h_short"), "lengths"), "hosts")
    rules, hosts = sent_if_small(rules, max_broadcast), sent_if_small(hosts, max_broadcast)
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", "url", host.alias("host"), path.alias("path")).withColumn("_labels", F.split("host", r"\.", -1))
    suffixes = F.transform(F.sequence(F.lit(1), F.size("_labels")), lambda k: F.array_join(F.slice("_labels", k, F.size("_labels")), "."))
    rows = rows.select("page_id", "url", "host", "path", F.posexplode(suffixes).alias("_k", "_suffix")).withColumn("h", F.sha2("_suffix", 256))
    rows = rows.join(hosts, (_short(F.col("h")) == F.col("h_short")) & (F.col("h") == F.col("h_digest")), "left")
    lengths = F.filter("lengths", lambda n: n <= F.char_length("path"))
    rows = rows.select("page_id", "url", "host", "path", "_k", "_suffix", F.posexplode_outer(lengths).alias("_i", "_n"))
    rows = rows.withColumn("d", F.when(F.col("_n").isNotNull(), _digest(F.col("_suffix"), F.substring("path", F.lit(1), F.col("_n")))))
    rows = rows.join(rules, (_short(F.col("d")) == F.col("short")) & (F.col("d") == F.col("r_digest")), "left")
    strength = F.when(F.col("r_host").isNotNull(), F.struct((F.char_length("r_host") + F.char_length("r_path")).alias("all"), F.char_length("r_host").alias("of_host"), F.col("r_verdict").alias("verdict"), F.concat("r_host", "r_path").alias("rule")))
    copies = F.count_if((F.col("_k") == 0) & (F.coalesce("_i", F.lit(0)) == 0))
    best = rows.groupBy("page_id", "url").agg(F.max(strength).alias("best"), F.first("host").alias("host"), F.first("path").alias("path"), copies.alias("_copies"))
    out = best.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"), F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies"))).alias("_copy"))
    return out.select("page_id", "host", "path", "rule", "verdict")


#: Rules of the query. Fixed values.
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))


def op5_urls(spark, sf_dir):
    rules = spark.range(1).select(F.explode(F.array(*(F.struct(F.lit(h).alias("host"), F.lit(p).alias("path"), F.lit(v).alias("verdict")) for h, p, v in RULES))).alias("r")).select("r.*")
    return judge(table(spark, sf_dir, "pages"), rules)
