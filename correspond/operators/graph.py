"""Entities, relationships and communities as tables."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from correspond.functions.text import relation_tag
from correspond.operators.tables import Scratch


def attribute(description: Column, name: str) -> Column:
    """`Name: value |` of a description; null without one."""
    return F.nullif(F.trim(F.regexp_extract(description, rf"{name}:\s*([^|\n]+)", 1)), F.lit(""))


def nodes(entities: DataFrame, communities: DataFrame) -> DataFrame:
    """entities(id, title, type, description, degree), communities(community, seq, entity_ids) -> nodes with label and cluster.

    A community lists its entities by id or by title; of several that list an entity
    the last one counts, by seq, and of equal ones the higher name.
    """
    listed = communities.select("community", "seq", F.explode("entity_ids").alias("_key"))
    last = listed.groupBy("_key").agg(F.max(F.struct("seq", "community")).alias("_last"))
    keys = entities.select("title", F.explode(F.array_distinct(F.array("id", "title"))).alias("_key"))
    own = keys.join(last, "_key").groupBy("title").agg(F.max("_last").alias("_last")).select("title", F.col("_last.community").alias("cluster"))
    label = F.when(F.upper("type") == "EMAIL", F.coalesce(attribute(F.col("description"), "Subject"), F.col("title"))).otherwise(F.col("title"))
    return entities.join(own, "title", "left").select(F.col("title").alias("id"), label.alias("label"), "type", "degree", "cluster")


def edges(relationships: DataFrame) -> DataFrame:
    """(source, target, description, weight) -> edges with the relation's label apart, weight 1 where it is missing."""
    label, rest = relation_tag(F.col("description"))
    return relationships.select("source", "target", label.alias("relation"), rest.alias("description"), F.round(F.coalesce("weight", F.lit(1.0)), 6).alias("weight"))


def degrees(links: DataFrame) -> DataFrame:
    """Ends of edges at each node; a loop counts twice."""
    return links.select(F.explode(F.array("source", "target")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))


def pairs(links: DataFrame, roster: DataFrame) -> DataFrame:
    """links(source, target, seq, relation, description) -> undirected labelled pairs of persons in the roster(name), with relation and description of a pair's last link; of two that share the last place, the higher by relation and description."""
    known = roster.select("name").distinct()
    kept = links.where("relation <> '' and string(source) <> '' and string(target) <> '' and source <> target").join(known.withColumnRenamed("name", "source"), "source", "left_semi").join(known.withColumnRenamed("name", "target"), "target", "left_semi")
    return kept.groupBy(F.least("source", "target").alias("person_a"), F.greatest("source", "target").alias("person_b")).agg(F.max(F.struct("seq", "relation", "description")).alias("l")).select("person_a", "person_b", "l.relation", "l.description")


def contact_counts(relationships: DataFrame, entities: DataFrame, owners: DataFrame, keys: list[str], stored: DataFrame | None = None) -> DataFrame:
    """Mail contacts from a graph: (keys, contact, name, sent, received, friendly).

    relationships(keys, source, target, description), entities(keys, seq, title, type, description),
    owners(keys, owner). A description that speaks of a recipient counts as sent to the target, of a sender as received
    from it, and of a copy as neither; who has one of the two is a contact, but for the owner. friendly are
    all relationships from casual mails. Names come from the last person entity of the title,
    the first of several; `none` is no name. Contacts are told in lower case; of titles that differ in case alone the last counts.
    stored(keys, contact, name, sent, received, friendly) is added up with the new counts of the contacts that the graph has, whose
    missing names it keeps; its other contacts stay as they are.
    """
    says = lambda word: F.coalesce(F.col("description").contains(word), F.lit(False))
    person, mail = F.upper("type") == "PERSON", F.upper("type") == "EMAIL"
    casual = entities.where(mail & F.col("description").contains("Tone: casual")).select(*keys, F.col("title").alias("source"), F.lit(1).alias("_casual")).distinct()
    copy = says("참조")
    edge = relationships.join(casual, [*keys, "source"], "left").groupBy(*keys, "target").agg(F.count_if(says("수신자") & ~copy).alias("sent"), F.count_if(says("발신자") & ~copy).alias("received"), F.count("_casual").alias("friendly"))
    known = edge.where("sent + received > 0").join(owners.select(*keys, F.upper("owner").alias("target")), [*keys, "target"], "left_anti")
    name = F.trim(F.regexp_extract("description", r"(?d)Name:\s*(.+)", 1))
    name = F.when(F.lower(name) == "none", "").when(name.contains(","), F.trim(F.split_part(name, F.lit(","), F.lit(1)))).otherwise(name)
    names = entities.where(person).groupBy(*keys, F.upper("title").alias("_upper")).agg(F.max_by(F.coalesce(name, F.lit("")), "seq").alias("name"))
    told = known.withColumn("_upper", F.upper("target")).join(names, [*keys, "_upper"], "left")
    row = F.struct("target", F.coalesce("name", F.lit("")).alias("name"), "sent", "received", "friendly")
    new = told.groupBy(*keys, F.lower("target").alias("contact")).agg(F.max(row).alias("r")).select(*keys, "contact", "r.name", "r.sent", "r.received", "r.friendly")
    if stored is None:
        return new
    old = stored.select(*keys, "contact", *(F.col(c).alias(f"_{c}") for c in ("name", "sent", "received", "friendly")))
    both = new.join(old, [*keys, "contact"], "full")
    counts = ((F.coalesce(c, F.lit(0)) + F.coalesce(f"_{c}", F.lit(0))).alias(c) for c in ("sent", "received", "friendly"))
    return both.select(*keys, "contact", F.coalesce(F.nullif("name", F.lit("")), "_name", F.lit("")).alias("name"), *counts)


def parse_records(texts: DataFrame, keys: list[str]) -> DataFrame:
    """Extraction output -> (keys, place, kind, name, other, type, description, strength)."""
    rows = texts.select(*keys, F.posexplode(F.split("text", "##")).alias("place", "record"))
    parts = F.split(F.regexp_extract("record", r"(?s)^\s*\((.*)\)\s*$", 1), r"<\|>")
    at = lambda k: F.trim(F.regexp_replace(F.get(parts, F.lit(k)), r'^"|"$', ""))
    link = at(0) == "relationship"
    rows = rows.where(at(0).isin("entity", "relationship"))
    return rows.select(*keys, "place", at(0).alias("kind"), at(1).alias("name"), F.when(link, at(2)).alias("other"), F.when(~link, at(2)).alias("type"), at(3).alias("description"), F.when(link, F.coalesce(at(4).try_cast("double"), F.lit(1.0))).alias("strength"))


def merge_entities(records: DataFrame) -> DataFrame:
    """One row for each name and type, in how many chunks, and the different descriptions in order."""
    r = records.where("kind = 'entity'")
    return r.groupBy(F.upper("name").alias("name"), F.upper("type").alias("type")).agg(F.count("*").alias("frequency"), F.array_sort(F.collect_set("description")).alias("descriptions"))


def merge_edges(records: DataFrame) -> DataFrame:
    r = records.where("kind = 'relationship'")
    return r.groupBy(F.upper("name").alias("source"), F.upper("other").alias("target")).agg(F.sum("strength").alias("weight"), F.count("*").alias("frequency"))


def components(links: DataFrame) -> DataFrame:
    """(source, target) -> (node, component), the smallest node that can be reached.

    In each round every node takes its smallest neighbour as label and the links
    become links of labels, so chains shorten fast; each round is a written table.
    A node whose only link is to itself is a component of its own.
    """
    tables = Scratch(links.sparkSession, "components")
    left, labels = tables.written(links.select(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).distinct(), "links"), None
    while True:
        both = left.select(F.col("a").alias("node"), F.col("b").alias("to")).unionByName(left.select(F.col("b").alias("node"), F.col("a").alias("to")))
        hop = tables.written(both.groupBy("node").agg(F.min("to").alias("to")).select("node", F.least("node", "to").alias("label")), "hop")
        if labels is None:
            labels = hop.select("node", F.col("label").alias("component"))
        else:
            labels = labels.join(hop.select(F.col("node").alias("component"), "label"), "component", "left").select("node", F.coalesce("label", "component").alias("component"))
        labels = tables.written(labels, "labels")
        x, y = hop.select(F.col("node").alias("a"), F.col("label").alias("la")), hop.select(F.col("node").alias("b"), F.col("label").alias("lb"))
        left = tables.written(left.join(x, "a").join(y, "b").where("la <> lb").select(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b")).distinct(), "links")
        if left.isEmpty():
            tables.keep("labels")
            return labels


def chunks(docs: DataFrame, size: int = 1500, overlap: int = 150) -> DataFrame:
    """(doc_id, chunk, n_words, text): documents in pieces of `size` words, each `overlap` words into the one before, cut out of the text as it is. For tokens of a tokenizer see tokens.token_chunks."""
    words = F.regexp_extract_all("text", F.lit(r"\s*\S+"), F.lit(0))  # each with the white space before it
    step = size - overlap
    rows = docs.select("doc_id", words.alias("w")).where("size(w) > 0")
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("w") - overlap - 1), F.lit(step))
    cut = rows.select("doc_id", F.posexplode(starts).alias("chunk", "start"), "w").select("doc_id", "chunk", F.slice("w", F.col("start") + 1, F.lit(size)).alias("w"))
    return cut.select("doc_id", "chunk", F.size("w").alias("n_words"), F.regexp_replace(F.array_join("w", ""), r"^\s+", "").alias("text"))


def neighbours(links: DataFrame, people: DataFrame) -> DataFrame:
    """people(person) -> the other ends of their undirected links."""
    both = links.select(F.explode(F.array(F.struct(F.col("source").alias("person"), F.col("target").alias("other")), F.struct(F.col("target").alias("person"), F.col("source").alias("other")))).alias("l"), "relation")
    return both.select("l.*", "relation").join(people, "person", "left_semi").distinct()
