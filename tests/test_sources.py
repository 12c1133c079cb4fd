"""Files read and written, each as a round trip, and their odd cases."""

import json
import math

import numpy as np
import pytest
from conftest import SF
from pyspark.sql import functions as F

from correspond.functions import text as fn
from correspond.operators import affinity, blocks, facts, keywords, tables
from correspond.plans.registry import QUERIES
from correspond.sources import export, readers
from correspond.streaming import jobs


def test_block_files(spark, tmp_path):
    block = "[ID] {}\n[제목] Re: x\n[구분] 발신\n[날짜] 2024-01-0{} 10:00:00\n[발신인] a@x.com\n[수신인] B <b@x.com>\n[폴더 정보] 없음\n\n[메일 본문]\nhello\n\n[첨부파일 정보]\n없음"
    for name, ids in (("one", (1, 2)), ("two", (3,))):
        (tmp_path / f"{name}.txt").write_text("\n".join(f"{blocks.SEPARATOR}\n{block.format(i, i)}\n{blocks.SEPARATOR}" for i in ids), encoding="utf-8")
    (tmp_path / "none.txt").write_text("")
    found = readers.block_files(spark, str(tmp_path))
    assert sorted(r.mail_id for r in blocks.parse_blocks(found, ["file"]).collect()) == ["1", "2", "3"]
    fact = facts.mail_fact(found.select(F.lit("a@x.com").alias("account"), F.monotonically_increasing_id().alias("seq"), "text"), spark.createDataFrame([("a@x.com", "2", "email", "Tone: Formal | x")], "account string, title string, type string, description string"), tone_of=F.upper).collect()
    assert len(fact) == 3 and all(r.is_reply and r.direction == "sent" and r.counterparty == "b@x.com" and r.folder == "UNKNOWN" and r.llm_tone == "HELLO" for r in fact)
    assert {r.mail_id: r.kg_tone for r in fact} == {"1": None, "2": "formal", "3": None}


def test_export_lines(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("첫 줄\r\n\r\nthird".encode())
    assert [(r.line_no, r.line) for r in readers.export_lines(spark, str(tmp_path)).orderBy("line_no").collect()] == [(0, "첫 줄"), (1, ""), (2, "third")]


def test_id_text_csv(spark, tmp_path):
    rows = spark.createDataFrame([("1", 1, "old"), ("1", 2, 'two\n"lines", here'), ("2", 1, "한글"), ("3", 1, "")], "id string, seq long, text string")
    new = spark.createDataFrame([("1",), ("2",)], "id string")
    export.write_id_text_csv(export.latest_texts(rows, new), f"{tmp_path}/out")
    assert sorted(map(tuple, readers.id_text_csv(spark, f"{tmp_path}/out").collect())) == [("1", 'two\n"lines", here'), ("2", "한글")]
    assert export.latest_texts(rows).count() == 3


def test_graph_tables(spark, tmp_path):
    odd = spark.createDataFrame([("a", "b", 2)], "from_ string, to_ string, weight int")
    got = readers.graph_table(odd, "relationships").first()
    assert (got.source, got.target, got.weight, got.description) == ("a", "b", 2.0, None)
    old = readers.graph_table(spark.createDataFrame([("n", "PERSON", None)], "name string, type string, entity_type string"), "entities").first()
    assert old.title == "n" and old.type is None
    spark.createDataFrame([("x", "y")], "src string, tgt string").write.parquet(f"{tmp_path}/rel")
    edges = readers.read_graph_table(spark, f"{tmp_path}/rel", "relationships")
    export.write_graph_json(readers.graph_table(spark.createDataFrame([("x",)], "title string"), "entities"), edges, f"{tmp_path}/graph")
    assert json.loads("".join(r.value for r in spark.read.text(f"{tmp_path}/graph/edges").collect()))["target"] == "y"


def test_usage_records(spark, tmp_path):
    def put(folder, name, text):
        (tmp_path / folder).mkdir(exist_ok=True)
        (tmp_path / folder / name).write_text(text)

    usage = {"prompt_tokens": 10, "completion_tokens": 3, "total_tokens": 13}
    put("extract_graph", "a", json.dumps({"result": {"response": {"model": "m", "usage": usage}}}, indent=2))
    put("extract_graph", "b", json.dumps({"result": {}}))
    put("extract_graph", "c", "not json {")
    put("text_embedding", "d", json.dumps({"result": {"response": {"usage": usage}}}))
    put("other", "e", json.dumps({"result": {"response": {"usage": usage}}}))
    got = {r.kind: (r.calls, r.input_tokens, r.output_tokens) for r in readers.usage_totals(readers.usage_records(spark, str(tmp_path))).collect()}
    assert got == {"model": (2, 10, 3), "embedding": (1, 13, 0)}


def test_nested_counts(spark):
    rows = spark.createDataFrame([("k", "p", "d2"), ("k", "p", "d1"), ("k", "p", "d1"), ("k", "q", "d1"), ("k", None, "d1"), ("k", "q", None)], "key string, person string, day string")
    (got,) = export.nested_counts(rows, ["key"], "person", "day").collect()
    assert json.loads(got.nested) == {"p": {"d1": 2, "d2": 1}, "q": {"d1": 1}}


def test_no_machine_local_folder_on_a_cluster(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"
        getConf = lambda self: type("C", (), {"get": lambda *_: None})()
        getCheckpointDir = lambda self: None

    session = type("S", (), {"conf": type("C", (), {"get": lambda *_: None})(), "sparkContext": Context()})()
    with pytest.raises(ValueError, match="checkpoint"):
        tables.shared_dir(session)


def plain_bands(values, k=5):
    """The groups of a list of percents as they are shown: 1 the lowest."""
    different = sorted(set(values))
    n = max(1, min(k, len(different)))
    centres = [different[0]] if n == 1 else [different[math.floor(i * (len(different) - 1) / (n - 1) + 0.5)] for i in range(n)]
    for _ in range(100 if n > 1 else 0):
        own = [[] for _ in centres]
        for v in values:
            own[min(range(n), key=lambda c: (abs(v - centres[c]), c))].append(v)
        new = [sum(o) / len(o) if o else c for o, c in zip(own, centres, strict=True)]
        done = all(abs(a - b) <= 1e-9 for a, b in zip(new, centres, strict=True))
        centres = new
        if done:
            break
    found = sorted({math.floor(c * 1000 + 0.5) / 1000 for c in centres})
    edges = [(a + b) / 2 for a, b in zip(found, found[1:], strict=False)]
    return [1 + sum(v >= e for e in edges) for v in values]


def test_bands_of_the_table(spark):
    got, own = QUERIES["affinity_bands"](spark, SF).collect(), {}
    for r in got:
        own.setdefault(r.account, []).append(r)
    assert len(own) > 3
    for rows in own.values():
        assert plain_bands([r.percent for r in rows]) == [r.band for r in rows]
    for r in QUERIES["affinity_band_floors"](spark, SF).collect():
        mine = [x.percent for x in own[r.account] if x.band == r.band]
        above = [x.percent for x in own[r.account] if x.band > r.band and x.band == min(y.band for y in own[r.account] if y.band > r.band)]
        assert (r.n, r.floor, r.floor_above) == (len(mine), min(mine), min(above) if above else None)


def test_centres_of_made_up_values():
    r = np.random.default_rng(5)
    for _ in range(200):
        values = r.integers(0, 101, r.integers(1, 40)).tolist()
        x, w = np.unique(values, return_counts=True)
        c = affinity.one_dimensional_means(x.astype(float), w.astype(float), 5)
        assert (np.searchsorted((c[1:] + c[:-1]) / 2, values, "right") + 1).tolist() == plain_bands(values)


def test_shown_names(spark):
    rows = spark.createDataFrame([("no-reply@mail.instagram.com", "Bob"), ("a@b.com", " Ann "), ("a@b.com", None), (None, None), ("x@y.io", "GitHub")], "mail string, name string")
    got = [r[0] for r in rows.select(fn.shown_name(F.col("mail"), F.col("name"))).collect()]
    assert got == ["instagram", "Ann", "a", "(알 수 없음)", "y"]


def test_append_goes_on_and_rebuilds(spark, tmp_path):
    rows = spark.range(100).withColumn("v", F.col("id") * 2)
    stream = lambda: jobs.files(spark, f"{tmp_path}/in", rows.schema)
    rows.where("id < 60").repartition(3).write.mode("append").parquet(f"{tmp_path}/in")
    assert jobs.append_once(spark, stream(), ["id"], f"{tmp_path}/out").count() == 60
    rows.where("id >= 40").repartition(2).write.mode("append").parquet(f"{tmp_path}/in")
    got = jobs.append_or_rebuild(spark, stream(), ["id"], f"{tmp_path}/out")
    assert got.count() == 100 and got.agg(F.sum("v")).first()[0] == 9900 and "rebuilt" not in got.inputFiles()[0]
    again = jobs.append_or_rebuild(spark, stream(), ["id"], f"{tmp_path}/out")
    assert again.count() == 100 and "rebuilt" in again.inputFiles()[0]
    assert jobs.append_or_rebuild(spark, stream(), ["id"], f"{tmp_path}/out", mode="rewrite").count() == 100


def test_facts_of_rooms_and_profiles(spark):
    said = spark.createDataFrame([("r", "a", False), ("r", "a", False), ("r", "b", True)], "chatroom_id string, sender string, is_system boolean")
    stored = spark.createDataFrame([("r", "a", 1, "knows"), ("r", "c", 5, None)], "chatroom_id string, person string, messages long, description string")
    assert sorted(map(tuple, facts.room_people_fact(said, stored).collect())) == [("r", "a", 2, "knows"), ("r", "c", 5, None)]
    persons = spark.createDataFrame([("o", "2024-01-01", "a", "x"), ("o", "2024-02-01", "a", "y"), ("o", "2024-02-01", "b", " "), ("p", "2024-01-01", "c", None)], "account string, index_date string, person string, description string")
    assert [r.description for r in facts.profiles(persons).collect()] == ["y"]


def test_keyword_hook(spark):
    texts = spark.createDataFrame([(1, "one; two"), (2, None)], "doc_id long, text string")
    assert sorted((r.doc_id, r.keyword) for r in keywords.mentions(texts, lambda t: F.split(t, "; ")).collect()) == [(1, "one"), (1, "two")]
