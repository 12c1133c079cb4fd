"""Hand-computed cases."""

import datetime
import math

from pyspark.sql import functions as F

from correspond.functions import text as fn
from correspond.operators import affinity, blocks, chatlog, graph, keywords, mood, retrieval, series
from correspond.streaming import jobs


def test_intimacy(spark):
    rows = [("a", "p", "sent", True, 10.0, "casual", "friendly"), ("a", "p", "sent", False, None, "formal", "not"), ("a", "p", "sent", False, None, "alert", None), ("a", "p", "received", False, None, None, "friendly")]
    m = spark.createDataFrame(rows, "account string, person string, direction string, is_reply boolean, reply_elapsed_hours double, kg_tone string, llm_tone string").withColumn("mail_date", F.lit("2024-01-01 10:00:00").cast("timestamp_ntz"))
    people = spark.createDataFrame([("a", "p"), ("a", "nobody")], "account string, person string")
    got = {r.person: r for r in affinity.intimacy(m, "2024-01-21", volume=False, decay=False, persons=people).collect()}
    want = 0.3 * 0.5 + 0.4 * 0.25 * math.exp(-0.1) + 0.3 * 0.425
    assert abs(got["p"].eis - want) < 1e-6 and got["p"].n == 4 and abs(got["p"].t - 0.425) < 1e-6
    assert got["nobody"].eis == 0 and got["nobody"].n == 0 and got["nobody"].t_bar is None
    aged = affinity.intimacy(m, "2024-01-21", volume=False).first()
    assert abs(aged.eis - want * math.exp(-0.1)) < 1e-6


def test_bands(spark):
    s = spark.createDataFrame([("a", f"p{i}", x / 100) for i, x in enumerate((90, 90, 50, 10, 10))], "account string, person string, eis double")
    got = {r.person: r.band for r in affinity.bands(s).collect()}
    assert got == {"p0": 3, "p1": 3, "p2": 2, "p3": 1, "p4": 1}


def test_month_spine(spark):
    c = spark.createDataFrame([("k", "2023-03", 1, 0), ("k", "2025-01", 0, 2)], "key string, period string, sent long, received long")
    got = sorted(r.period for r in series.dense_months(c, ["key"], "2023-02-01", "2025-02-28").collect())
    assert got == [f"2023-{m:02d}" for m in range(2, 13)] + ["2025-01", "2025-02"]


def test_mail_blocks(spark):
    sep = blocks.SEPARATOR
    text = f"{sep}\n[ID] a\n[제목] s1\n[폴더 정보] 없음\n\n[메일 본문]\nhello\n\n[첨부파일 정보]\n없음\n{sep}\n{sep}\nID: b\n제목: s2\n{sep}\n{sep}\n[제목] no id\n{sep}\n{sep}\n[ID] a\n[제목] again\n{sep}"
    got = {r.mail_id: r for r in blocks.parse_blocks(blocks.split_blocks(spark.createDataFrame([("x", text)], "account string, text string"), ["account"]), ["account"]).collect()}
    assert set(got) == {"a", "b"} and got["a"].subject == "s1" and got["a"].folder is None and got["a"].body == "hello" and got["b"].subject == "s2"


def test_quoted_header(spark):
    at = "2026년 3월 5일 (목) 오후"
    cases = [
        (f"{at} 3:20, 홍길동 <A@x.com>님이 작성:", "a@x.com", "2026-03-05 15:20"), (f"{at} 12:05, x <b@x>님이 작성:", "b@x", "2026-03-05 12:05"), ("2026년 3월 5일 (목) 오전 12:05, x <b@x>님이 작성:", "b@x", "2026-03-05 00:05"),
        (f"{at} 3:20, A@x.com님이 작성:", "a@x.com", "2026-03-05 15:20"), (f"{at} 3:20,  A@x.com 님이 작성:\n<b@y.com> wrote", "a@x.com", "2026-03-05 15:20"), (f"{at} 3:20, x <b@x>님이", None, None),
        (f"We meet {at} 3:20, ask Kim <k@x.com>", None, None), ("2026년 3월 5일 오후 3:20, x <b@x>님이 작성:", None, None), (f"{at} 3:20, Lee, Kim <c@x>님이 작성: {at} 4:20, <d@x>님이 작성:", "c@x", "2026-03-05 15:20"),
        (f"{at} 3:20 no comma\n{at} 4:20, <d@x>님이 작성:", "d@x", "2026-03-05 15:20"), ("none", None, None), (None, None, None),
    ]
    df = spark.createDataFrame([(k, c[0]) for k, c in enumerate(cases)], "k int, t string")
    s, m = blocks.quoted(F.col("t"))
    assert [tuple(r) for r in df.orderBy("k").select(s, m).collect()] == [c[1:] for c in cases]


def test_contact_counts(spark):
    rel = [("M1", "A@X.COM", "이메일의 발신자는 A이다."), ("M1", "B@X.COM", "이메일의 수신자는 B이다."), ("M1", "C@X.COM", "이메일의 참조 수신자는 C이다."), ("M2", "B@X.COM", "이메일의 수신자는 B이다."), ("M2", "ME@X.COM", "이메일의 수신자는 나이다."), ("M1", "B@X.COM", None), ("m1", "A@X.COM", "x")]
    ent = [(1, "M1", "email", "Subject: s | Tone: casual"), (2, "M2", "EMAIL", "Tone: formal"), (3, "a@x.com", "Person", "Name: Kim, Lee"), (4, "B@X.COM", "PERSON", "Name: None"), (5, "A@X.COM", "PERSON", "OrgName: Z\nRole: Name:  Park , Choi"), (6, "B@X.COM", "TOPIC", "Name: no")]
    rel = spark.createDataFrame([("u", *r) for r in rel], "account string, source string, target string, description string")
    ent = spark.createDataFrame([("u", *r) for r in ent], "account string, seq long, title string, type string, description string")
    own = spark.createDataFrame([("u", "me@x.com")], "account string, owner string")
    got = {r.contact: tuple(r)[2:] for r in graph.contact_counts(rel, ent, own, ["account"]).collect()}
    assert got == {"a@x.com": ("Z", 0, 1, 1), "b@x.com": ("", 2, 0, 2)}  # the reference's pattern takes the first `Name:`, that of OrgName too
    old = spark.createDataFrame([("u", "b@x.com", "Bo", 5, 1, 0), ("u", "z@x.com", "Zed", 1, 0, 0)], "account string, contact string, name string, sent long, received long, friendly long")
    got = {r.contact: tuple(r)[2:] for r in graph.contact_counts(rel, ent, own, ["account"], old).collect()}
    assert got == {"a@x.com": ("Z", 0, 1, 1), "b@x.com": ("Bo", 7, 1, 2), "z@x.com": ("Zed", 1, 0, 0)}


def test_room_name(spark):
    texts = ["카카오톡 대화 : 가족톡\n...", "\n\n저장한 카카오톡대화： 방 \n", "가족톡 님과 카카오톡 대화\n카카오톡 대화 둘", "\n" * 5 + "카카오톡 대화 방", "안녕\n카카오톡 대화 방", "", None, "카카오톡 대화:"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    assert [r[0] for r in df.orderBy("k").select(chatlog.room_name(F.col("t"), F.lit("file"))).collect()] == ["가족톡", "방", "file", "file", "file", "file", "file", ":"]


def test_stored_blocks(spark):
    head = "====\n[대화 1]\n\nID: 2024-01-01_01\n채팅방:  가족 \n날짜: 2024-01-01\n참여자: {}\n\n[대화 내용]\n{}\n====="
    lines = "09:00 홍: 안녕: 하세요\n둘째\n\n09:01 [알림] 김: 들어왔습니다\n09:02  이 : a\n9:03 no start"
    texts = [(1, head.format("홍, 이, ,알 수 없음", lines)), (2, head.format("x", "09:00 z: later")), (3, "no id\n09:00 z: x"), (0, "ID:  b2\n참여자: 알 수 없음\n[대화 내용]\n09:00 홍: x\n09:01 [알림] y")]
    found = chatlog.stored_blocks(spark.createDataFrame([("r", *t) for t in texts], "chatroom_id string, seq int, text string"), ["chatroom_id"])
    got = {r.block_id: r for r in found.collect()}
    assert set(got) == {"2024-01-01_01", "b2"} and got["2024-01-01_01"].room == "가족" and got["2024-01-01_01"].listed == ["홍", "이"] and got["b2"].listed == [] and got["b2"].block_date is None
    said = chatlog.parse_lines(found, ["chatroom_id", "block_id"])
    assert [tuple(r)[2:] for r in said.where("block_id <> 'b2'").orderBy("message").collect()] == [(1, "09:00", "홍", "안녕: 하세요\n둘째\n", False), (2, "09:01", None, "김: 들어왔습니다", True), (3, "09:02", "이", "a\n9:03 no start", False)]
    facts_ = chatlog.block_facts(said.withColumnRenamed("message", "place").join(found.select("chatroom_id", "block_id", "listed"), ["chatroom_id", "block_id"]))
    assert {r.block_id: (r.message_count, r.participant_count, r.participants) for r in facts_.collect()} == {"2024-01-01_01": (2, 2, ["홍", "이"]), "b2": (1, 1, ["홍"])}


def test_chat_export(spark):
    text = "[홍길동] [오후 3:20] lost\n2024년 1월 1일 오후 3:20, 홍길동 : 안녕\n둘째 줄\n\n--------------- 2024년 1월 2일 화요일 ---------------\n[김] [오전 12:05] hi\n2024년 1월 3일 오후 3:20: 홍길동님이 들어왔습니다."
    got = chatlog.parse_export(chatlog.lines_of(spark.createDataFrame([("f", text)], "file string, text string"), ["file"])).orderBy("message").collect()
    assert [(r.dt, r.sender, r.text, r.is_system) for r in got] == [
        (datetime.datetime(2024, 1, 1, 15, 20), "홍길동", "안녕\n둘째 줄", False), (datetime.datetime(2024, 1, 2, 0, 5), "김", "hi", False), (datetime.datetime(2024, 1, 3, 15, 20), None, "홍길동님이 들어왔습니다.", True)]


def test_blocks_of_400(spark):
    m = spark.range(401).select(F.lit("r").alias("chatroom_id"), F.col("id").alias("seq"), F.lit("2024-01-01 09:00:00").cast("timestamp_ntz").alias("dt"), F.lit("a").alias("sender"))
    got = {r.block_id: r["count"] for r in chatlog.day_blocks(m).groupBy("block_id").count().collect()}
    assert got == {"2024-01-01_01": 400, "2024-01-01_02": 1}


def test_tone_and_balance(spark):
    df = spark.createDataFrame([("ㅋㅋㅋㅋㅋㅋㅋ 좋아!",), ("감사합니다.",), ("이모티콘",)], "t string")
    assert [r[0] for r in df.select(mood.tone_markers(F.col("t"))).collect()] == [6.0, -1.0, 1.0]
    rows = [(room, s, i) for room, who in (("x", "aabb"), ("y", "aaaa")) for i, s in enumerate(who)]
    m = spark.createDataFrame(rows, "chatroom_id string, sender string, seq long").withColumn("dt", F.lit("2024-01-01 09:00:00").cast("timestamp_ntz"))
    assert {r.chatroom_id: round(r.balance, 9) for r in mood.balance(m, ("month",)).collect()} == {"x": 1.0, "y": 0.0}


def test_gaps(spark):
    m = spark.createDataFrame([("r", 0, "2024-01-01 09:00:00"), ("r", 1, "2024-01-01 09:10:00"), ("r", 2, "2024-01-01 09:15:30")], "chatroom_id string, seq long, at string")
    m = m.select("chatroom_id", "seq", F.col("at").cast("timestamp_ntz").alias("dt"))
    assert mood.response_gaps(m, ("month",)).first().gap == 7.5


def test_mentions(spark):
    b = spark.createDataFrame([("r", "나무나무가"), ("r", "aaa"), ("r", "a.b axb")], "room string, text string")
    k = spark.createDataFrame([("나무",), ("aa",), ("a.b",)], "keyword string")
    assert {r.keyword: r.mention_count for r in chatlog.mentions(b, k).collect()} == {"나무": 2, "aa": 1, "a.b": 1}


def test_keywords_by_automaton(spark):
    """Few and many keywords, in one block and in several, find the same."""
    b = spark.createDataFrame([(1, "나무나무가 aaaa"), (2, "ababab a.b"), (3, None), (4, "")], "doc long, text string")
    words = ["나무", "무나", "aa", "a.b", "aba", "ab", "b", "zz", "", None]
    k = spark.createDataFrame([(w,) for w in words + words[:2]], "keyword string")
    want = sorted((d, w, t.count(w)) for d, t in ((1, "나무나무가 aaaa"), (2, "ababab a.b")) for w in words[:8] if w in t)
    for few, block in ((64, 9), (0, 100), (0, 3), (0, 4)):
        assert sorted((r.doc, r.keyword, r.n) for r in keywords.occurrences(b, k, few, block).collect()) == want
    for few in (64, 0):
        assert keywords.occurrences(b, k.where("keyword = 'zz'"), few).collect() == [] == keywords.occurrences(b, k.where("false"), few).collect()


def test_components(spark):
    links = [("a", "b"), ("c", "b"), ("d", "e"), ("e", "e"), ("f", "f"), ("g", "h"), ("h", "i"), ("i", "j"), ("j", "k"), ("b", "a")]
    found = graph.components(spark.createDataFrame(links, "source string, target string"))
    assert dict(found.select("node", "component").collect()) == dict(zip("abcdefghijk", "aaaddfggggg", strict=True))


def test_latest_day(spark):
    old = spark.createDataFrame([("r", "2024-01-01_01", "o"), ("r", "2024-01-02_01", "o")], "room string, block_id string, v string")
    new = spark.createDataFrame([("r", "2024-01-02_01", "n"), ("r", "2024-01-01_01", "n")], "room string, block_id string, v string")
    got = {r.block_id: r.v for r in blocks.incremental(old, new, "room", latest_day=True).collect()}
    assert got == {"2024-01-01_01": "o", "2024-01-02_01": "n"}
    later = spark.createDataFrame([("r", "2024-01-03_01", "n")], "room string, block_id string, v string")
    got = {r.block_id: r.v for r in blocks.incremental(old, later, "room", latest_day=True).collect()}
    assert got == {"2024-01-01_01": "o", "2024-01-02_01": "o", "2024-01-03_01": "n"}


def test_dates(spark):
    want = {"이번 주": ("2026-03-16", "2026-03-22"), "지난 달": ("2026-02-01", "2026-02-28"), "3월 22일 ~ 25일": ("2026-03-22", "2026-03-25"), "최근 3일": ("2026-03-16", "2026-03-18"), "2026년 3월": ("2026-03-01", "2026-03-31"), "작년": ("2025-01-01", "2025-12-31"), "저저번 주": ("2026-03-02", "2026-03-08"), "2026-03-22 ~ 03-25": ("2026-03-22", "2026-03-25"), "26-3-2": ("2026-03-02", "2026-03-02"), "2025년 요약": ("2025-01-01", "2025-12-31"), "5월": ("2026-05-01", "2026-05-31"), "어제": ("2026-03-17", "2026-03-17"), "없음": None}
    df = spark.createDataFrame([(k,) for k in want], "t string")
    got = {r.t: r.d and (str(r.d.start), str(r.d.end)) for r in df.select("t", retrieval.date_range(F.col("t"), "2026-03-18").alias("d")).collect()}
    assert got == want


def test_citations_and_records(spark):
    a = spark.createDataFrame([(1, "ID: abc123@x.com]. ID: 2 ID: ABC123", "")], "query_id long, answer string, context string")
    assert [r.cited for r in retrieval.citations(a).orderBy("place").collect()] == ["abc123@x.com", "ABC123"]
    t = spark.createDataFrame([(1, '("entity"<|>A<|>PERSON<|>d)##("relationship"<|>A<|>B<|>d<|>7)')], "chunk long, text string")
    got = graph.parse_records(t, ["chunk"]).orderBy("place").collect()
    assert (got[0].name, got[0].type, got[1].name, got[1].other, got[1].strength) == ("A", "PERSON", "A", "B", 7.0)
    label, rest = fn.relation_tag(F.lit("[관계: 친구] 자주 연락"))
    assert tuple(spark.range(1).select(label, rest).first()) == ("친구", "자주 연락")


def test_pairs(spark):
    links = spark.createDataFrame([("A", "B", 1, "x", "one"), ("B", "A", 2, "y", None), ("A", "A", 3, "z", ""), ("A", "X", 4, "w", ""), ("A", "B", 5, "", "no label"), ("A", "B", 6, None, "none")], "source string, target string, seq long, relation string, description string")
    roster = spark.createDataFrame([("A",), ("B",)], "name string")
    assert [tuple(r) for r in graph.pairs(links, roster).collect()] == [("A", "B", "y", None)]


def test_profile(spark):
    rows = [("관계: [관계: 기업] 알림 서비스\n자주 주고 받은 내용: 보안 알림", "G"), ("자주 주고 받은 내용: x", ""), (None, "n")]
    df = spark.createDataFrame(rows, "t string, n string")
    got = [tuple(r) for r in df.select(*fn.profile(F.col("t"), F.col("n"))).collect()]
    assert got == [("이름: G\n관계: 알림 서비스\n자주 주고 받은 내용: 보안 알림", "기업"), ("이름: 알 수 없음\n관계: \n자주 주고 받은 내용: x", None), (None, None)]


def test_correct_senders(spark):
    answers = spark.createDataFrame([(1, "ID: M1@x.com.\n발신인: bad\n발신인: two\n\n발신인: bad"), (2, "ID: none\n발신인: bad"), (3, None), (4, "발신인:\nbad\nID: m1@y.com")], "query_id long, answer string")
    mails = spark.createDataFrame([("m1@x.com", 1, 5, "late"), ("m1@x.com", 0, 9, r"a$1\b <a@x>")], "mail_id string, account_rank int, seq long, sender string")
    got = {r.query_id: r.answer for r in retrieval.correct_senders(answers, mails).collect()}
    true = r"a$1\b <a@x>"
    assert got == {1: f"ID: M1@x.com.\n발신인: {true}\n발신인: two\n\n발신인: bad", 2: "ID: none\n발신인: bad", 3: "", 4: f"발신인:\n{true}\nID: m1@y.com"}


def test_streams_without_rows(spark, tmp_path):
    schema = "room string, block_id string, n long"
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
    jobs.sync_blocks(spark, stream, "room", f"{tmp_path}/at")
    assert jobs.stored_blocks(spark, stream.schema, "room", f"{tmp_path}/at").collect() == []
    sessions = jobs.closed_sessions(spark, stream.withColumn("ts", F.lit("2024-01-01").cast("timestamp")), "ts", ["room"], "1 hour")
    assert sessions.columns == ["room", "started", "ended", "n"] and sessions.collect() == []


def test_vectors_without_queries(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0])], "id long, embedding array<double>")
    q = v.select(F.col("id").alias("query_id"), "embedding")
    assert retrieval.vector_topk(v, q.where("false")).collect() == []
    assert [(r.query_id, r.id, r.rank) for r in retrieval.vector_topk(v, q.where("query_id = 1")).collect()] == [(1, 1, 1), (1, 3, 2)]
