"""Segmented scans, splittable readers, prefixes, ranges of days, and communities against plain versions."""

import datetime
import math
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from conftest import SF
from pyspark.sql import functions as F

from correspond.operators import affinity, blocks, chatlog, communities, prefixes, retrieval, scan, snapshot, tokens, vectors
from correspond.plans import mail
from correspond.sources import readers

R = random.Random(4)


@pytest.mark.parametrize("size", [1, 3, 50])
def test_scans(spark, size):
    rows = [(f"k{i % 2}", i, None if R.random() < 0.8 else R.randrange(9), R.random() < 0.3) for i in range(120)]
    df = spark.createDataFrame(rows, "k string, at long, v int, flag boolean").withColumn("seg", F.floor(F.col("at") / size)).repartition(3)
    got = {r.at: (r.last, r.n, r.place) for r in scan.placed(scan.running_count(scan.carry_forward(df, ["k"], "seg", "at", F.col("v"), "last"), ["k"], "seg", "at", F.col("flag"), "n"), ["k"], "seg", ["at"], "place").collect()}
    for k in ("k0", "k1"):
        last, n = None, 0
        for place, (_, at, v, flag) in enumerate(r for r in rows if r[0] == k):
            last, n = last if v is None else v, n + flag
            assert got[at] == (last, n, place)


DATE = r"(\d{4})년\s*(\d{1,2})월\s*(\d{1,2})일"
TIME = r"(오전|오후)\s*(\d{1,2}):(\d{2})"


def plain_export(lines):
    """One line after another."""
    out, day = [], None
    clock = lambda d, half, h, m: datetime.datetime(*d, int(h) % 12 + 12 * (half == "오후"), int(m))
    for line in lines:
        line = line.rstrip()
        if not line:
            continue
        if m := re.match(rf"^-+\s*{DATE}.*-+$", line) or re.match(rf"^{DATE}\s*(?:[월화수목금토일]요일)?\s*$", line):
            day = tuple(map(int, m.groups()))
        elif m := re.match(rf"^{DATE}\s+{TIME},\s*(.+?)\s*:\s*(.*)$", line) or re.match(rf"^(\d{{4}})\.\s*(\d{{1,2}})\.\s*(\d{{1,2}})\.\s+{TIME},\s*(.+?)\s*:\s*(.*)$", line):
            day = tuple(map(int, m.groups()[:3]))
            out.append([clock(day, *m.groups()[3:6]), m[7].strip(), m[8], False])
        elif m := re.match(rf"^{DATE}\s+{TIME}:\s*(.*)$", line):
            day = tuple(map(int, m.groups()[:3]))
            out.append([clock(day, *m.groups()[3:6]), None, m[7], True])
        elif (m := re.match(rf"^\[(.+?)\]\s*\[{TIME}\]\s*(.*)$", line)) and day:
            out.append([clock(day, *m.groups()[1:4]), m[1].strip(), m[5], False])
        elif out:
            out[-1][2] += "\n" + line
    return [tuple(r) for r in out]


def some_lines(n):
    d = lambda: f"2024년 {R.randrange(1, 13)}월 {R.randrange(1, 28)}일"
    t = lambda: f"{R.choice(['오전', '오후'])} {R.randrange(1, 13)}:{R.randrange(60):02d}"
    kinds = [lambda: f"--- {d()} 월요일 ---", lambda: f"{d()} 화요일", lambda: f"{d()} {t()}, 홍 : 안녕  ", lambda: f"2024. 3. 4. {t()}, 김 : x", lambda: f"{d()} {t()}: 알림", lambda: f"[이] [{t()}] pc\t", lambda: "go on", lambda: "", lambda: "  ", lambda: " indented　"]
    return [R.choices(kinds, weights=[1, 1, 2, 1, 1, 6, 5, 2, 1, 2])[0]() for _ in range(n)]


@pytest.mark.parametrize("segment", [1, 4, 100_000])
def test_export_in_segments(spark, segment):
    """A file in segments gives what one line after another gives, whatever is open at their edges."""
    files = {"a": some_lines(150), "b": some_lines(40), "c": ["[이] [오전 9:00] no date yet", "go on"], "d": [""]}
    lines = spark.createDataFrame([(f, k, line) for f, own in files.items() for k, line in enumerate(own)], "file string, line_no long, line string").repartition(4)
    got = defaultdict(list)
    for r in chatlog.parse_export(lines, segment=segment).orderBy("file", "message").collect():
        got[r.file].append((r.dt, r.sender, r.text, r.is_system))
    assert dict(got) == {f: p for f, own in files.items() if (p := plain_export(own))}


def test_split_files(spark, tmp_path):
    """Records and lines that cross the splits of a file are whole, and numbered as in the whole file."""
    texts = ["\n".join(f"{blocks.SEPARATOR}\n[ID] {k}\n본문 {'é' * R.randrange(60)}\n{blocks.SEPARATOR}" for k in range(n)) for n in (200, 3, 0)]
    for k, t in enumerate(texts):
        (tmp_path / f"b{k}.txt").write_text(t, encoding="utf-8")
    (tmp_path / "lines").mkdir()
    own = some_lines(400)
    (tmp_path / "lines" / "x.txt").write_bytes("\r\n".join([*own[:200], "odd\x0bend\x1dhere", *own[200:]]).encode())
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("100", "777", "4096", "128m"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "0")
            found = readers.block_files(spark, f"{tmp_path}/b*.txt")
            got = sorted((r.file[-6:], r.seq, r.text) for r in found.collect())
            assert got == [(f"b{k}.txt", i, x.strip()) for k, t in enumerate(texts) for i, x in enumerate(t.split(blocks.SEPARATOR)) if x.strip()]
            lines = readers.export_lines(spark, f"{tmp_path}/lines")
            if size == "100":
                assert found.select(F.spark_partition_id()).distinct().count() > 1
            whole = [*own[:200], "odd", "end", "here", *own[200:]]
            assert [(r.line_no, r.line) for r in lines.orderBy("line_no").collect()] == list(enumerate(whole))
        parsed = chatlog.parse_export(lines, segment=64).orderBy("message").collect()
        assert [(r.dt, r.sender, r.text, r.is_system) for r in parsed] == plain_export(whole)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_beginnings(spark):
    """Nested, shared and missing beginnings, in one range and in many, against all pairs."""
    word = lambda: "".join(R.choice("ab") for _ in range(R.randrange(1, 9)))
    ids = {w: (R.randrange(3), k, f"M{k}") for k, w in enumerate({word() for _ in range(150)} | {"ab" * 30, "é", "日本"})}
    asked = {word() for _ in range(150)} | {"ab" * 31, "", "zzz", "日", "日本語"}
    a = spark.createDataFrame([(w,) for w in asked], "key string").repartition(3)
    i = spark.createDataFrame([(w, *b) for w, b in ids.items()], "key string, account_rank int, seq long, mail_id string").select("key", F.struct("account_rank", "seq", "mail_id").alias("best"))
    want = {q: min(b for w, b in ids.items() if w.startswith(q) or q.startswith(w)) for q in asked if any(w.startswith(q) or q.startswith(w) for w in ids)}
    before = spark.conf.get("spark.sql.shuffle.partitions")
    sampled = prefixes.SAMPLED
    try:
        for parts, every in (("1", sampled), ("4", 2), ("16", 1)):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            prefixes.SAMPLED = every
            assert {r.key: tuple(r.best) for r in prefixes.best_beginnings(a, i).collect()} == want
    finally:
        prefixes.SAMPLED = sampled
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert prefixes.best_beginnings(a.limit(0), i).count() == 0 and prefixes.best_beginnings(a, i.limit(0)).count() == 0


def test_resolve(spark):
    mails = [("AbcdefGH@x.com", 0, 5), ("abcdefgh@y.com", 1, 1), ("abcdefghij@x.com", 0, 2), ("abcdefghij@x.com", 2, 0), ("abcd", 3, 0), (None, 0, 0)]
    cited = ["abcdefgh@X.com", "abcdefgh@other", "abcdefghi", "abcdefg", "abcdefghij@x.com.more", "abcdefgx", None, "nothing at all"]
    got = retrieval.resolve(spark.createDataFrame([(k, c) for k, c in enumerate(cited)], "cite_id int, cited string"), spark.createDataFrame(mails, "mail_id string, account_rank int, seq int")).collect()
    assert {r.cite_id: (r.mail_id, r.tier) for r in got} == {0: ("AbcdefGH@x.com", 1), 1: ("AbcdefGH@x.com", 2), 2: ("abcdefghij@x.com", 3), 4: ("abcdefghij@x.com", 2), 5: ("abcd", 3)}


def test_ranges(spark):
    """Days and times, short and long ranges, before 1970 too: each mail once for each range that it is in."""
    day = lambda: datetime.date(1960, 1, 1) + datetime.timedelta(R.randrange(9000))
    q = [(k, a, a + datetime.timedelta(R.choice([0, 1, 6, 31, 400, 3652]))) for k, a in enumerate(day() for _ in range(60))] + [(99, datetime.date(2000, 1, 2), datetime.date(2000, 1, 1)), (98, None, None)]
    m = [(i, datetime.datetime.combine(day(), datetime.time(R.randrange(24), R.randrange(60)))) for i in range(300)] + [(999, None)]
    mails = spark.createDataFrame(m, "mail_id long, mail_date timestamp_ntz")
    got = sorted((r.query_id, r.mail_id) for r in retrieval.in_ranges(spark.createDataFrame(q, "query_id long, start date, end date"), mails).collect())
    assert got == sorted((k, i) for k, a, b in q for i, t in m if a and t and a <= t.date() <= b)
    noon = lambda x: x and datetime.datetime.combine(x, datetime.time(12))
    timed = spark.createDataFrame([(k, noon(a), noon(b)) for k, a, b in q], "query_id long, start timestamp_ntz, end timestamp_ntz")
    got = sorted((r.query_id, r.mail_id) for r in retrieval.in_ranges(timed, mails).collect())
    assert got == sorted((k, i) for k, a, b in q for i, t in m if a and t and noon(a) <= t <= noon(b))
    days = F.datediff("start", F.lit("1970-01-01")), F.datediff("end", F.lit("1970-01-01"))
    spans = spark.createDataFrame(q, "query_id long, start date, end date").select(F.size(retrieval._spans(*days)).alias("n")).agg(F.max("n")).first()[0]
    assert spans <= 24
    assert retrieval.in_ranges(timed.limit(0), mails).count() == 0


def plain_communities(links, limit):
    """Moves of one node after another, level by level."""
    w = defaultdict(float)
    for a, b, x in links:
        w[min(a, b), max(a, b)] += 1.0 if x is None else x
    twice, at = 2 * sum(w.values()), {n: n for e in w for n in e}
    size, edges = dict.fromkeys(at, 1), w
    while True:
        near, k, comm = defaultdict(dict), defaultdict(float), {n: n for n in size}
        for (a, b), x in edges.items():
            k[a] += x
            k[b] += x
            if a != b:
                near[a][b] = near[b][a] = x
        tot, held, moved = dict(k), dict(size), False
        for _ in range(20):
            before = dict(comm)
            for n in sorted(size):
                to = defaultdict(float)
                for o, x in near[n].items():
                    to[comm[o]] += x
                own = comm[n]
                tot[own] -= k[n]
                held[own] -= size[n]
                gain = {c: to[c] - k[n] * tot[c] / twice for c in {*to, own} if held[c] + size[n] <= limit}
                best = max(sorted(gain), key=lambda c: (round(gain[c], 9), c == own))
                comm[n] = best
                tot[best] += k[n]
                held[best] += size[n]
            moved |= comm != before
            if comm == before:
                break
        if not moved:
            return at
        at = {n: comm[c] for n, c in at.items()}
        sizes, merged = defaultdict(int), defaultdict(float)
        for n, s in size.items():
            sizes[comm[n]] += s
        for (a, b), x in edges.items():
            merged[min(comm[a], comm[b]), max(comm[a], comm[b])] += x
        size, edges = dict(sizes), merged


LINKS = "source string, target string, weight double"


def test_communities(spark):
    """Groups with many links inside and few between: as modular as moves of one node after another, to 5 %, and none too large."""
    names = [f"n{k:03d}" for k in range(60)]
    links = [(a, b, None) for i, a in enumerate(names) for b in names[:i] if R.random() < (0.5 if i // 10 == names.index(b) // 10 else 0.02)]
    df = spark.createDataFrame(links, LINKS)
    found = communities.communities(df)
    rows = found.collect()
    top = max(r.level for r in rows)
    for level in range(top + 1):
        own = defaultdict(set)
        for r in rows:
            if r.level == level:
                own[r.community].add(r.node)
        assert all(len(m) <= 15 and c == min(m) for c, m in own.items()) and sum(map(len, own.values())) == len({n for a, b, _ in links for n in (a, b)})
    nested = {(r.node, r.level): r.community for r in rows}
    for level in range(top):  # a level's communities stay together at the next
        assert len({(nested[n, level], nested[n, level + 1]) for n, x in nested if x == level}) == len({nested[n, level] for n, x in nested if x == level})
    plain = spark.createDataFrame(list(plain_communities(links, 15).items()), "node string, community string")
    best = communities.modularity(df, found.where(F.col("level") == top).select("node", "community"))
    assert best >= 0.95 * communities.modularity(df, plain) > 0
    assert sorted(map(tuple, communities.communities(df.repartition(5)).collect())) == sorted(map(tuple, rows))


def test_communities_of_odd_links(spark):
    odd = [("a", "a", 1.0), ("b", "c", 0.0), ("d", "e", None), ("e", "d", 2.0), (None, "f", 1.0), ("g", "h", -1.0)]
    got = {(r.node, r.community) for r in communities.communities(spark.createDataFrame(odd, LINKS)).collect()}
    assert got == {("a", "a"), ("d", "d"), ("e", "d")}
    assert communities.communities(spark.createDataFrame([], LINKS)).count() == 0
    star = [("hub", f"leaf{k}", 1.0) for k in range(60)]
    sizes = communities.communities(spark.createDataFrame(star, LINKS)).groupBy("level", "community").count().agg(F.max("count")).first()[0]
    assert 2 <= sizes <= 15


def test_links_that_communities_drop(spark, monkeypatch):
    """Links between communities that are too large to become one are not carried to the next level, and a turn deals links out once, without sorting them for a join."""
    tables, plans, write = [], [], communities.Scratch.written
    monkeypatch.setattr(communities.Scratch, "written", lambda self, df, name: (name == "wishes" and plans.append(df._jdf.queryExecution().toString()), out := write(self, df, name), tables.append((name, out.count())))[1])
    links = [(f"n{a:02d}", f"n{b:02d}", None) for a in range(24) for b in range(a)]
    found = communities.communities(spark.createDataFrame(links, LINKS), limit=4)
    assert found.groupBy("level", "community").count().where("level = 0 and count <> 4").count() == 0 and found.where("level = 0").count() == 24
    later = tables[[name for name, _ in tables].index("level0") :]
    assert all(n == 0 for name, n in later if name in ("edges", "less", "wishes")) and len(plans) > 1
    assert not any("SortMergeJoin [dst" in p for p in plans)


def test_communities_of_a_table(spark):
    """Orders and suppliers of the smallest table, against moves of one node after another."""
    li = spark.read.parquet(f"{SF}/lineitem.parquet").select(F.format_string("o%d", F.col("l_orderkey")).alias("source"), F.format_string("p%d", "l_partkey").alias("target"), F.col("l_quantity").alias("weight")).where("hash(source) % 9 = 0")
    found = communities.communities(li)
    top = found.agg(F.max("level")).first()[0]
    plain = spark.createDataFrame(list(plain_communities([tuple(r) for r in li.collect()], 15).items()), "node string, community string")
    assert communities.modularity(li, found.where(F.col("level") == top).select("node", "community")) >= 0.95 * communities.modularity(li, plain) > 0


def test_nearest_vectors(spark, monkeypatch):
    """In clusters with a crowd of copies, and in no order at all, with vectors and queries of no length: equal to all pairs, of which clusters leave most out."""
    r = np.random.default_rng(5)
    monkeypatch.setattr(vectors, "BLOCK", 50)
    monkeypatch.setattr(vectors, "QUERIES", 7)
    for spread, most in ((0.05, 0.5), (5.0, 1.0)):
        x = r.normal(size=(12, 6))[r.integers(12, size=900)] + spread * r.normal(size=(900, 6))
        x[100:400] = x[100]
        x[7] = x[500] = 0
        rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(2000, None), (2001, [])]
        v = spark.createDataFrame(rows, "id long, embedding array<double>").repartition(3)
        q = v.where("id % 30 = 7 or id > 1999 or id = 100").select(F.col("id").alias("query_id"), "embedding")
        found, work = vectors.nearest(v, q, 10, cells=24)
        unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
        want = []
        for i in [i for i in range(900) if i % 30 == 7 or i == 100]:
            s = np.round(unit @ unit[i], 9)
            want += [(i, int(j), k + 1) for k, j in enumerate(np.lexsort((np.arange(900), -s))[:10])]
        got = found.collect()
        assert sorted((g.query_id, g.rank) for g in got) == sorted((i, k) for i, _, k in want)
        by_place = {(i, k): np.round(unit[j] @ unit[i], 9) for i, j, k in want}
        assert all(abs(g.similarity - by_place[g.query_id, g.rank]) < 1e-8 for g in got)
        compared, pairs = work.first()
        assert pairs == 31 * 900 and compared <= most * pairs
    assert vectors.nearest(v.limit(0), q)[0].count() == 0 and vectors.nearest(v, q.limit(0))[0].count() == 0


def test_caps_of_a_column(spark):
    rows = [(a, i, c) for a, n, c in (("hot", 3000, 7), ("some", 40, 20), ("few", 3, 9), ("none", 10, 0), ("free", 50, None)) for i in range(n)]
    df = spark.createDataFrame(rows, "account string, at long, cap int").repartition(5)
    got = snapshot.newest(df, ["account"], F.col("cap"), F.desc("at"))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(((a, i, c) for a, n, c in (("hot", 3000, 7), ("some", 40, 20), ("few", 3, 9), ("free", 50, None)) for i in range(n) if c is None or i >= n - c), key=str)
    assert "WindowGroupLimit" in got._jdf.queryExecution().executedPlan().toString()


def test_token_chunks(spark):
    """Cut where a loop over the tokens cuts, out of the text as it is; with a tokenizer's tokens and with any others."""
    import public_tokenizers
    from tokenizers import Tokenizer

    texts = [None, "", "one", "  two  words\n", *(" ".join("".join(R.choice("abcé日 ") for _ in range(8)) for _ in range(R.randrange(200))) for _ in range(20))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        told = f.read()
    whole = Tokenizer.from_str(told)
    words = lambda many: [[m.span() for m in re.finditer(r"\S+", t)] for t in many]
    for offsets, plain in ((tokens.tokenizer_offsets(told), lambda t: whole.encode(t, add_special_tokens=False).offsets), (words, lambda t: words([t])[0])):
        for size, overlap in ((40, 7), (1500, 150)):
            want = []
            for i, t in enumerate(texts):
                spans, first, n = plain(t or ""), 0, 0
                while first < len(spans) and (n == 0 or first + overlap < len(spans)):
                    own = spans[first : first + size]
                    want.append((i, n, len(own), t[own[0][0] : max(e for _, e in own)]))
                    first, n = first + size - overlap, n + 1
            got = tokens.token_chunks(df, offsets, size, overlap).collect()
            assert sorted((r.doc_id, r.chunk, r.n_tokens, r.text) for r in got) == want and all(texts[r.doc_id][r.start : r.end] == r.text for r in got)
        assert {r.doc_id: r.n for r in tokens.token_counts(df, "text", "n", offsets).collect()} == {i: len(plain(t or "")) for i, t in enumerate(texts)}


def test_scores_at_halves(spark):
    """Scores that lie half way between two of six digits: the mails' tones are added up in order and rounded as in SQL, however the mails are dealt out."""
    kinds, rows = [*affinity.TONES, "none"], []
    for person in range(300):
        for seq in range(16):
            rows.append(("a", f"p{person:03d}", person * 16 + seq, R.choice(("sent", "received")), False, None, R.choice(kinds), R.choice((None, "friendly", "not")), datetime.datetime(2000, 1, 1)))
    mails = spark.createDataFrame(rows, "account string, person string, seq long, direction string, is_reply boolean, reply_elapsed_hours double, kg_tone string, llm_tone string, mail_date timestamp_ntz")
    of = defaultdict(list)
    for r in rows:
        of[r[1]].append(r)
    want = {}
    for person, own in of.items():
        total = 0.0
        for r in own:
            kg = affinity.TONES.get(r[6], 0.0)
            total += kg if r[7] is None else (kg + (r[7] == "friendly")) / 2
        sent = sum(r[3] == "sent" for r in own)
        eis = 0.3 * (1 - abs(2 * sent - 16) / 16) + 0.4 * 0.0 + 0.3 * (total / 16)
        want[person] = math.floor(eis * 1e6 + 0.5) / 1e6
    for dealt in (mails, mails.repartition(7), mails.orderBy(F.desc("seq"))):
        got = affinity.intimacy(dealt, "2001-12-31", volume=False, decay=False).collect()
        assert {r["person"]: r["eis"] for r in got} == want


def test_folders_by_numbers(spark):
    """Chunks of mails are summed by the mail's number, in a hash; names of mails are never sorted or dealt out."""
    plan = mail.folder_counts(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "mail_id" not in plan


@pytest.mark.parametrize("size", [1, 3, 50])
def test_previous(spark, size):
    rows = [("ab"[k % 3 == 0], k, R.choice((None, "x", "y"))) for k in R.sample(range(40), 25)]
    df = spark.createDataFrame(rows, "key string, seq long, v string").withColumn("segment", F.floor(F.col("seq") / size))
    got = {r["seq"]: (r["p"], r["s"]) for r in scan.previous(df, ["key"], "segment", "seq", {"p": F.col("v"), "s": F.col("seq")}).collect()}
    want = {}
    for key in "ab":
        own = sorted(r[1:] for r in rows if r[0] == key)
        want |= {b[0]: (a[1], a[0]) for a, b in zip([(None, None), *own], own)}
    assert got == want


def test_mails_are_parsed_once(spark):
    """The mail fact reads parsed mails from a table: neither texts nor the order of an account's mails are in its plan again."""
    plan = mail.mail_fact(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract(text" not in plan and "lag(" not in plan
