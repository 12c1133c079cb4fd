"""Queries on entities, relationships and documents."""

from pyspark.sql import functions as F

from correspond.functions import text as fn
from correspond.operators import communities, facts, graph, snapshot
from correspond.plans.base import query, read

_REL = """rel AS (SELECT 'S' || l_suppkey AS source, 'P' || l_partkey AS target, min(l_orderkey) AS seq, count(*) AS n, CASE WHEN min(l_orderkey) % 3 = 0 THEN NULL ELSE sum(l_quantity) END AS weight,
  CASE WHEN min(l_orderkey) % 2 = 0 THEN '[관계: r' || (min(l_orderkey) % 5) || '] sold ' || count(*) ELSE 'sold ' || count(*) END AS description FROM lineitem GROUP BY 1, 2)"""


def _relationships(spark, d):
    sums = read(spark, d, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.min("l_orderkey").alias("seq"), F.count("*").alias("n"), F.sum("l_quantity").alias("q"))
    li = sums.select(F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("source"), F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("target"), "seq", "n", "q")
    told = F.format_string("sold %d", "n")
    return li.select("source", "target", "seq", "n", F.when(F.col("seq") % 3 != 0, F.col("q")).alias("weight"), F.when(F.col("seq") % 2 == 0, F.concat(F.format_string("[관계: r%d] ", F.col("seq") % 5), told)).otherwise(told).alias("description"))


@query(rf"WITH {_REL} SELECT source, target, nullif(trim(regexp_extract(description, '^\[관계:\s*([^\]]+)\]', 1)), '') AS relation, trim(regexp_replace(description, '^\[관계:\s*[^\]]+\]\s*', '')) AS description, round(coalesce(weight, 1.0), 6) AS weight FROM rel")
def graph_edges(spark, d):
    return graph.edges(_relationships(spark, d))


@query(f"WITH {_REL} SELECT source, target, CASE WHEN seq % 2 = 0 THEN 'r' || (seq % 5) END AS label, 'sold ' || n AS rest FROM rel")
def relation_tag(spark, d):
    label, rest = fn.relation_tag(F.col("description"))
    return _relationships(spark, d).select("source", "target", label.alias("label"), rest.alias("rest"))


_ENT = """ent AS (SELECT 'P' || p_partkey AS title, CASE WHEN p_size % 2 = 0 THEN 'EMAIL' ELSE 'TOPIC' END AS type, p_partkey AS id, p_size AS degree, p_type AS kind, p_name AS name FROM part)"""


def _entities(spark, d):
    p, key = read(spark, d, "part"), F.col("p_partkey")
    description = F.when(F.col("p_size") % 2 == 0, F.format_string("Subject: %s | ID: m%d | Tone: %s", "p_name", key, F.lower("p_type"))).otherwise(F.format_string("Name: %s, other | Summary: about %s | OrgName: none", "p_name", "p_type"))
    return p.select(F.concat(F.lit("P"), key.cast("string")).alias("title"), F.when(F.col("p_size") % 2 == 0, "EMAIL").otherwise("TOPIC").alias("type"), description.alias("description"), F.col("p_size").alias("degree"), "p_brand", "p_type", key.alias("id"))


@query(f"WITH {_ENT}, com AS (SELECT 'P' || p_partkey AS title, CASE WHEN p_partkey % 3 = 0 THEN p_type ELSE p_brand END AS community FROM part WHERE p_partkey % 3 = 0 OR p_partkey % 4 <> 0) SELECT title AS id, CASE WHEN type = 'EMAIL' THEN name ELSE title END AS label, type, degree, community AS cluster FROM ent LEFT JOIN com USING (title)")
def graph_nodes(spark, d):
    """Nodes of communities by brand, which list titles, and of later ones by kind, which list ids."""
    e = _entities(spark, d)
    slice_ = F.pmod("id", F.lit(50)).alias("slice")
    brands = e.where("id % 4 <> 0").groupBy(F.col("p_brand").alias("community"), slice_).agg(F.collect_list("title").alias("entity_ids"), F.lit(1).alias("seq"))
    kinds = e.where("id % 3 = 0").groupBy(F.col("p_type").alias("community"), slice_).agg(F.collect_list(F.col("id").cast("string")).alias("entity_ids"), F.lit(2).alias("seq"))
    return graph.nodes(e.withColumn("id", F.col("id").cast("string")), brands.unionByName(kinds))


@query(f"WITH {_ENT} SELECT title, CASE WHEN type = 'TOPIC' THEN name END AS name, CASE WHEN type = 'TOPIC' THEN 'about ' || kind END AS summary, NULL::VARCHAR AS org, CASE WHEN type = 'EMAIL' THEN name END AS subject FROM ent")
def entity_attributes(spark, d):
    """Attributes in descriptions: of a list of names the first, `none` as none."""
    a = lambda n: graph.attribute(F.col("description"), n)
    none = lambda c: F.when(F.lower(c) != "none", c)
    return _entities(spark, d).select("title", none(F.trim(F.split_part(a("Name"), F.lit(","), F.lit(1)))).alias("name"), a("Summary").alias("summary"), none(a("OrgName")).alias("org"), a("Subject").alias("subject"))


_MAILS = """told AS (SELECT o_custkey % 5 AS account, CASE WHEN o_orderkey % 4 = 0 THEN 'M' ELSE 'm' END || (o_orderkey - o_orderkey % 2) AS title, o_orderkey AS seq, CASE WHEN o_orderkey % 7 = 0 THEN 'topic' ELSE 'Email' END AS type,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'Subject: a | Tone:  Alert' WHEN '2-HIGH' THEN 'Tone: formal | Subject: b' WHEN '3-MEDIUM' THEN 'Tone: friendly' WHEN '4-NOT SPECIFIED' THEN 'no word of it' WHEN '5-LOW' THEN 'Subject: c' || chr(10) || 'Tone: casual | x' END AS description FROM orders)"""


def _mails(spark, d):
    """Entities of mails and topics, two of a mail by turns."""
    k, p = F.col("o_orderkey"), F.col("o_orderpriority")
    description = F.when(p == "1-URGENT", "Subject: a | Tone:  Alert").when(p == "2-HIGH", "Tone: formal | Subject: b").when(p == "3-MEDIUM", "Tone: friendly").when(p == "4-NOT SPECIFIED", "no word of it").when(p == "5-LOW", "Subject: c\nTone: casual | x")
    title = F.concat(F.when(k % 4 == 0, "M").otherwise("m"), (k - k % 2).cast("string"))
    return read(spark, d, "orders").select((F.col("o_custkey") % 5).alias("account"), title.alias("title"), k.alias("seq"), F.when(k % 7 == 0, "topic").otherwise("Email").alias("type"), description.alias("description"))


@query(rf"WITH {_MAILS}, t AS (SELECT *, lower(regexp_extract(description, 'Tone:\s*(\w+)', 1)) AS tone FROM told WHERE upper(type) = 'EMAIL') SELECT account, upper(title) AS title, max_by(tone, seq) AS kg_tone FROM t WHERE tone IN ('formal', 'casual', 'transactional', 'notification', 'alert') GROUP BY ALL")
def kg_tone_map(spark, d):
    """Tones of mails in descriptions, of those that count as one; the last of a mail's."""
    return facts.tones(_mails(spark, d))


@query("WITH e AS (SELECT 'S' || l_suppkey AS node FROM lineitem UNION ALL SELECT 'P' || l_partkey FROM lineitem) SELECT node, count(*) AS degree FROM e GROUP BY 1")
def node_degree(spark, d):
    return graph.degrees(read(spark, d, "lineitem").select(F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("source"), F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("target")))


@query("WITH l AS (SELECT l_suppkey % 90 AS s, l_partkey % 90 AS t, l_orderkey * 10 + l_linenumber AS k, l_partkey, l_suppkey, CASE WHEN l_orderkey % 3 <> 0 THEN 'r' || l_returnflag END AS relation, 'as told by ' || l_orderkey AS description FROM lineitem) SELECT least(s, t) AS person_a, greatest(s, t) AS person_b, max_by(relation, k * 1000000 + l_partkey) AS relation, max_by(description, k * 1000000 + l_partkey) AS description FROM l WHERE relation IS NOT NULL AND s <> t AND s IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0) AND t IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0) GROUP BY 1, 2")
def relationship_pairs(spark, d):
    li = read(spark, d, "lineitem")
    links = li.select((F.col("l_suppkey") % 90).alias("source"), (F.col("l_partkey") % 90).alias("target"), ((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 1000000 + F.col("l_partkey")).alias("seq"), F.when(F.col("l_orderkey") % 3 != 0, F.concat(F.lit("r"), "l_returnflag")).alias("relation"), F.format_string("as told by %d", "l_orderkey").alias("description"))
    return graph.pairs(links, read(spark, d, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("name")))


@query(f"WITH {_REL} SELECT s.source, s.target FROM rel s WHERE source IN (SELECT 'S' || s_suppkey FROM supplier WHERE s_acctbal > 2000) AND target IN (SELECT 'P' || p_partkey FROM part WHERE p_size > 25)")
def active_relationships(spark, d):
    """Edges whose both ends are active."""
    s = read(spark, d, "supplier").where("s_acctbal > 2000").select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("source"))
    p = read(spark, d, "part").where("p_size > 25").select(F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("target"))
    return _relationships(spark, d).select("source", "target").join(s, "source", "left_semi").join(p, "target", "left_semi")


@query("SELECT l_returnflag AS owner, count(DISTINCT l_suppkey) + count(DISTINCT l_partkey) AS node_count, count(DISTINCT l_suppkey * 1000000000 + l_partkey) AS edge_count FROM lineitem GROUP BY 1")
def graph_stats(spark, d):
    """Nodes and edges by owner: one exact two-level aggregation of labelled items."""
    li = read(spark, d, "lineitem")
    items = li.select(F.col("l_returnflag").alias("owner"), F.explode(F.array(F.struct(F.lit("s").alias("k"), F.col("l_suppkey").alias("a"), F.lit(0).cast("long").alias("b")), F.struct(F.lit("p").alias("k"), F.col("l_partkey").alias("a"), F.lit(0).cast("long").alias("b")), F.struct(F.lit("e").alias("k"), F.col("l_suppkey").alias("a"), F.col("l_partkey").alias("b")))).alias("i"))
    return items.select("owner", "i.*").distinct().groupBy("owner").agg(F.count_if(F.col("k") != "e").alias("node_count"), F.count_if(F.col("k") == "e").alias("edge_count"))


@query("SELECT l_suppkey % 7 AS level, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, level LIMIT 1")
def best_level(spark, d):
    """The most common level."""
    return read(spark, d, "lineitem").groupBy((F.col("l_suppkey") % 7).alias("level")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "level").limit(1)


_CHUNKS = """rec AS (SELECT l_orderkey AS chunk, l_linenumber AS k, 'Part' || (l_partkey % 300) AS part, 'Supp' || l_suppkey AS supp, 'flag ' || l_returnflag AS description, l_quantity AS strength FROM lineitem)"""


def _records(spark, d):
    li = read(spark, d, "lineitem")
    text = F.format_string('("entity"<|>Part%d<|>part<|>flag %s)##("relationship"<|>Supp%d<|>Part%d<|>flag %s<|>%s)', F.col("l_partkey") % 300, "l_returnflag", "l_suppkey", F.col("l_partkey") % 300, "l_returnflag", F.col("l_quantity").cast("string"))
    chunks = li.groupBy(F.col("l_orderkey").alias("chunk")).agg(F.array_join(F.array_sort(F.collect_list(text)), "##").alias("text"))
    return graph.parse_records(chunks, ["chunk"])


@query(f"WITH {_CHUNKS}, a AS (SELECT chunk, 'entity' AS kind, part AS name, NULL AS other, 'part' AS type, description, NULL::DOUBLE AS strength FROM rec UNION ALL SELECT chunk, 'relationship', supp, part, NULL, description, strength FROM rec) SELECT * FROM a")
def parse_graph_records(spark, d):
    return _records(spark, d).drop("place")


@query(f"WITH {_CHUNKS} SELECT upper(part) AS name, 'PART' AS type, count(*) AS frequency, array_to_string(list_sort(list_distinct(list(description))), ';') AS descriptions FROM rec GROUP BY 1")
def entity_merge(spark, d):
    return graph.merge_entities(_records(spark, d)).withColumn("descriptions", F.array_join("descriptions", ";"))


@query(f"WITH {_CHUNKS} SELECT upper(supp) AS source, upper(part) AS target, sum(strength) AS weight, count(*) AS frequency FROM rec GROUP BY 1, 2")
def edge_merge(spark, d):
    return graph.merge_edges(_records(spark, d))


@query(f"""WITH RECURSIVE {_REL}, e AS (SELECT source AS s, target AS t FROM rel UNION SELECT target, source FROM rel),
r(node, component) USING KEY (node) AS (
  SELECT s, min(least(s, t)) FROM e GROUP BY s
  UNION SELECT e.t, min(r.component) FROM r JOIN e ON r.node = e.s JOIN recurring.r AS x ON x.node = e.t WHERE r.component < x.component GROUP BY e.t)
SELECT node, component FROM r""")
def graph_components(spark, d):
    """Suppliers and parts that relationships bring together, directly or not."""
    return graph.components(_relationships(spark, d).select("source", "target"))


@query()
def graph_communities(spark, d):
    """Communities of fifteen at most among suppliers and parts, level by level."""
    return communities.communities(_relationships(spark, d).select("source", "target", "weight"))


@query()
def community_level(spark, d):
    """The level of the most communities."""
    return communities.common_level(graph_communities(spark, d))


@query(r"""WITH w AS (SELECT doc_id, regexp_extract_all(text, '\s*\S+') AS w FROM documents), c AS (SELECT doc_id, w, unnest(range(0, greatest(0, len(w) - 150 - 1) + 1, 1350)) AS s FROM w WHERE len(w) > 0)
SELECT doc_id, (s // 1350)::INTEGER AS chunk, len(w[s + 1:s + 1500])::INTEGER AS n_words, regexp_replace(array_to_string(w[s + 1:s + 1500], ''), '^\s+', '') AS text FROM c""")
def chunk_documents(spark, d):
    return graph.chunks(read(spark, d, "documents"))


@query(f"WITH {_REL}, b AS (SELECT source AS person, target AS other, seq FROM rel UNION ALL SELECT target, source, seq FROM rel) SELECT DISTINCT person, other, CASE WHEN seq % 2 = 0 THEN 'r' || (seq % 5) END AS relation FROM b WHERE person IN (SELECT 'P' || p_partkey FROM part WHERE p_size = 7)")
def person_neighbours(spark, d):
    people = read(spark, d, "part").where("p_size = 7").select(F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("person"))
    return graph.neighbours(graph.edges(_relationships(spark, d)), people)


@query("WITH a AS (SELECT p_partkey AS id, p_name AS label, p_size AS degree FROM part WHERE p_partkey % 3 <> 0), b AS (SELECT p_partkey AS id, CASE WHEN p_size % 2 = 0 THEN upper(p_name) END AS label, p_size + 1 AS degree FROM part WHERE p_partkey % 2 = 0) SELECT id, coalesce(b.label, a.label) AS label, coalesce(b.degree, a.degree) AS degree FROM a FULL JOIN b USING (id)")
def graph_compose(spark, d):
    p = read(spark, d, "part")
    base = p.where("p_partkey % 3 <> 0").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("label"), F.col("p_size").alias("degree"))
    delta = p.where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("id"), F.when(F.col("p_size") % 2 == 0, F.upper("p_name")).alias("label"), (F.col("p_size") + 1).alias("degree"))
    return snapshot.graph_compose(base, delta, ["id"])


@query(f"""WITH {_REL}, e AS (SELECT source, 'S' || (substr(target, 2)::BIGINT % 60) AS target, seq, 'r' || (seq % 5) AS relation, 'sold ' || n AS description FROM rel WHERE seq % 4 = 0),
k AS (SELECT least(source, target) AS person_a, greatest(source, target) AS person_b, max(row(seq, relation, description)) AS l FROM e WHERE source <> target AND substr(source, 2)::BIGINT < 40 AND substr(target, 2)::BIGINT < 40 GROUP BY 1, 2),
s AS (SELECT 'S' || s_suppkey AS person_a, 'S' || (s_suppkey + 1) AS person_b, 'stored' AS relation, 'long ago' AS description FROM supplier WHERE s_suppkey < 9)
SELECT person_a, person_b, CASE WHEN l IS NULL THEN s.relation ELSE l[2] END AS relation, CASE WHEN l IS NULL THEN s.description ELSE l[3] END AS description FROM k FULL JOIN s USING (person_a, person_b)""")
def relationship_fact(spark, d):
    """Labelled links between persons of a roster, each pair once with what is told of it, merged into the stored ones."""
    rel = graph.edges(_relationships(spark, d)).select("source", "target", "relation", "description").join(_relationships(spark, d).select("source", "target", "seq"), ["source", "target"]).where("seq % 4 = 0")
    links = rel.withColumn("target", F.concat(F.lit("S"), (F.substring("target", 2, 99).cast("long") % 60).cast("string")))
    roster = spark.range(40).select(F.concat(F.lit("S"), F.col("id").cast("string")).alias("name"))
    stored = read(spark, d, "supplier").where("s_suppkey < 9").select(F.format_string("S%d", "s_suppkey").alias("person_a"), F.format_string("S%d", F.col("s_suppkey") + 1).alias("person_b"), F.lit("stored").alias("relation"), F.lit("long ago").alias("description"))
    return facts.relationship_fact(links, roster, stored)


@query("""WITH e AS (SELECT l_suppkey AS a, l_partkey % 50 AS b, min(l_quantity) AS w, max(l_shipmode_) AS m, min(l_orderkey) AS k FROM (SELECT *, l_returnflag AS l_shipmode_ FROM lineitem) GROUP BY 1, 2),
o AS (SELECT least(a, b) AS a, greatest(a, b) AS b, max(w) AS w, max(m) AS m FROM e WHERE k % 2 = 0 AND a <= b GROUP BY 1, 2), n AS (SELECT b AS a, a AS b, CASE WHEN k % 3 = 0 THEN NULL ELSE w + 1 END AS w, lower(m) AS m FROM e WHERE a <= b AND k % 5 <> 0)
SELECT least(coalesce(o.a, n.a), coalesce(o.b, n.b)) AS source, greatest(coalesce(o.a, n.a), coalesce(o.b, n.b)) AS target, coalesce(n.w, o.w) AS weight, coalesce(n.m, o.m) AS mode FROM o FULL JOIN n ON o.a = n.b AND o.b = n.a""")
def graph_compose_edges(spark, d):
    """Edges and later ones that name their ends the other way round."""
    e = read(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("a"), (F.col("l_partkey") % 50).alias("b")).agg(F.min("l_quantity").alias("w"), F.max("l_returnflag").alias("m"), F.min("l_orderkey").alias("k")).where("a <= b")
    base = e.where("k % 2 = 0").select(F.col("a").alias("source"), F.col("b").alias("target"), F.col("w").alias("weight"), F.col("m").alias("mode"))
    delta = e.where("k % 5 <> 0").select(F.col("b").alias("source"), F.col("a").alias("target"), F.when(F.col("k") % 3 != 0, F.col("w") + 1).alias("weight"), F.lower("m").alias("mode"))
    return snapshot.graph_compose(base, delta, ["source", "target"], undirected=True)


_CONTACTS = f"""{_MAILS}, r AS (SELECT o_custkey % 5 AS account, CASE WHEN o_orderkey % 4 = 0 THEN 'M' ELSE 'm' END || (o_orderkey - o_orderkey % 2) AS source, CASE WHEN l_suppkey % 10 = 3 THEN 'supp' ELSE 'SUPP' END || l_suppkey || '@X.COM' AS target,
  CASE WHEN l_returnflag = 'A' THEN '이메일의 발신자는 누구이다.' WHEN l_returnflag = 'R' THEN '이메일의 수신자는 누구이다.' WHEN l_linestatus = 'O' THEN '이메일의 참조 수신자는 누구이다.' END AS description FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
casual AS (SELECT DISTINCT account, title FROM told WHERE upper(type) = 'EMAIL' AND contains(description, 'Tone: casual')),
c AS (SELECT r.account, target, count(*) FILTER (contains(description, '수신자') AND NOT contains(description, '참조')) AS sent, count(*) FILTER (contains(description, '발신자') AND NOT contains(description, '참조')) AS received, count(title) AS friendly
  FROM r LEFT JOIN casual ON casual.account = r.account AND title = source GROUP BY 1, 2),
p AS (SELECT n_regionkey AS account, 'supp' || s_suppkey || '@x.com' AS contact, CASE s_suppkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'Ms ' || s_name ELSE s_name END AS name FROM supplier, (SELECT DISTINCT n_regionkey FROM nation)),
new AS (SELECT c.account, lower(target) AS contact, coalesce(name, '') AS name, sent, received, friendly FROM c LEFT JOIN p ON p.account = c.account AND p.contact = lower(target) WHERE sent + received > 0 AND upper('supp' || c.account || '@x.com') <> target)"""


def _contact_graph(spark, d):
    li, o = read(spark, d, "lineitem"), read(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    k, flag = F.col("l_orderkey"), F.col("l_returnflag")
    source = F.concat(F.when(k % 4 == 0, "M").otherwise("m"), (k - k % 2).cast("string"))
    target = F.concat(F.when(F.col("l_suppkey") % 10 == 3, "supp").otherwise("SUPP"), F.col("l_suppkey").cast("string"), F.lit("@X.COM"))
    role = F.when(flag == "A", "이메일의 발신자는 누구이다.").when(flag == "R", "이메일의 수신자는 누구이다.").when(F.col("l_linestatus") == "O", "이메일의 참조 수신자는 누구이다.")
    relationships = li.join(o, "l_orderkey").select((F.col("o_custkey") % 5).alias("account"), source.alias("source"), target.alias("target"), role.alias("description"))
    accounts = read(spark, d, "nation").select(F.col("n_regionkey").alias("account")).distinct()
    n = F.col("s_suppkey") % 4
    name = F.when(n == 0, "Name: None").when(n == 1, F.concat(F.lit("Role: x\nName:  Ms "), "s_name", F.lit(" , other"))).otherwise(F.concat(F.lit("Name: "), "s_name"))
    older = F.array(F.struct(F.lit(1).alias("seq"), F.lit("Name: outdated").alias("description")), F.struct(F.lit(2).alias("seq"), name.alias("description")))
    people = read(spark, d, "supplier").crossJoin(F.broadcast(accounts)).select("account", F.format_string("Supp%d@x.com", "s_suppkey").alias("title"), F.lit("person").alias("type"), F.explode(older).alias("e")).select("account", "e.seq", "title", "type", "e.description")
    owners = accounts.select("account", F.format_string("supp%d@x.com", "account").alias("owner"))
    return relationships, _mails(spark, d).select("account", "seq", "title", "type", "description").unionByName(people), owners


@query(f"WITH {_CONTACTS} SELECT * FROM new")
def contact_stats_graph(spark, d):
    """Contacts of each account by what relationships tell of them: senders, recipients but for copies, casual mails; the owner is left out."""
    return graph.contact_counts(*_contact_graph(spark, d), ["account"])


@query(f"WITH {_CONTACTS}, old AS (SELECT account, contact, 'old name' AS name, 1 AS sent, 2 AS received, 3 AS friendly FROM new WHERE contact LIKE '%7@x.com' OR name = '' UNION ALL SELECT 0, 'gone@x.com', 'gone', 1, 1, 0) SELECT account, contact, coalesce(nullif(new.name, ''), old.name, '') AS name, coalesce(new.sent, 0) + coalesce(old.sent, 0) AS sent, coalesce(new.received, 0) + coalesce(old.received, 0) AS received, coalesce(new.friendly, 0) + coalesce(old.friendly, 0) AS friendly FROM new FULL JOIN old USING (account, contact)")
def contact_stats_graph_append(spark, d):
    """The same, added to stored counts."""
    parts = _contact_graph(spark, d)
    new = graph.contact_counts(*parts, ["account"])
    old = new.where("contact like '%7@x.com' or name = ''").select(F.col("account").cast("long").alias("account"), "contact", F.lit("old name").alias("name"), F.lit(1).alias("sent"), F.lit(2).alias("received"), F.lit(3).alias("friendly"))
    gone = spark.range(1).select(F.col("id").alias("account"), F.lit("gone@x.com"), F.lit("gone"), F.lit(1), F.lit(1), F.lit(0))
    return graph.contact_counts(*parts, ["account"], stored=old.union(gone))


@query("""WITH t AS (SELECT o_custkey AS person, p_type AS topic, count(*) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY person ORDER BY n DESC, topic) AS k FROM t),
c AS (SELECT o_custkey AS person, count(*) FILTER (o_orderkey % 2 = 0) AS sent, count(*) FILTER (o_orderkey % 2 = 1) AS received FROM orders GROUP BY 1)
SELECT person, sent, received, c_mktsegment AS org, c_mktsegment = (SELECT c_mktsegment FROM customer WHERE c_custkey = 0) AS same_org, string_agg(topic, ',' ORDER BY k) AS topics FROM c JOIN customer ON c_custkey = person JOIN k USING (person) WHERE k <= 5 GROUP BY ALL""")
def person_profile(spark, d):
    """Counts by role, organisation, whether the owner (0) shares it, and the five main topics of a person's mails."""
    o, c = read(spark, d, "orders").select(F.col("o_custkey").alias("person"), "o_orderkey"), read(spark, d, "customer")
    topics = o.join(read(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey"), "o_orderkey").join(read(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_type").alias("topic")), "l_partkey").groupBy("person", "topic").agg(F.count("*").alias("n"))
    top = snapshot.newest(topics.withColumn("minus", -F.col("n")), ["person"], 5, "minus", "topic").groupBy("person").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("minus", "topic"))), lambda x: x["topic"]), ",").alias("topics"))
    roles = o.groupBy("person").agg(F.count_if(F.col("o_orderkey") % 2 == 0).alias("sent"), F.count_if(F.col("o_orderkey") % 2 == 1).alias("received"))
    own = c.where("c_custkey = 0").select(F.col("c_mktsegment").alias("org"), F.lit(True).alias("same")).distinct()
    people = c.select(F.col("c_custkey").alias("person"), F.col("c_mktsegment").alias("org")).join(own, "org", "left")
    return roles.join(people, "person").join(top, "person").select("person", "sent", "received", "org", F.coalesce("same", F.lit(False)).alias("same_org"), "topics")
