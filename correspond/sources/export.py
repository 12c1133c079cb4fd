"""Writers: id,text files, graphs and nested counts as JSON, database tables."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def nested_counts(rows: DataFrame, keys: list[str], outer: str, inner: str) -> DataFrame:
    """rows(keys, outer, inner) -> (keys, nested): how many rows of each outer and inner value there are, as JSON objects in JSON objects, in order; rows without either are left out."""
    counts = rows.where(F.col(outer).isNotNull() & F.col(inner).isNotNull()).groupBy(*keys, outer, F.col(inner).cast("string").alias("_in")).agg(F.count("*").alias("n"))
    inside = counts.groupBy(*keys, outer).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("_in", "n")))).alias("_map"))
    entries = F.array_sort(F.collect_list(F.struct(F.col(outer).cast("string").alias("_k"), F.map_entries("_map").alias("_v"))))
    whole = F.map_from_entries(F.transform("_e", lambda x: F.struct(x["_k"], F.map_from_entries(x["_v"]))))
    return inside.groupBy(*keys).agg(entries.alias("_e")).select(*keys, F.to_json(whole).alias("nested"))


def latest_texts(blocks: DataFrame, new: DataFrame | None = None) -> DataFrame:
    """blocks(id, seq, text) -> (id, text): the last block of each id, of the ids in new(id) alone where that is given."""
    rows = blocks if new is None else blocks.join(new.select("id"), "id", "left_semi")
    return rows.groupBy("id").agg(F.max_by("text", "seq").alias("text"))


def write_id_text_csv(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    """(id, text) as CSV files with a header under a folder; quotes inside texts are doubled."""
    rows.select("id", "text").write.csv(path, mode=mode, header=True, quote='"', escape='"', quoteAll=True)


def write_graph_json(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Nodes and edges as JSON lines in two folders: no task and no file holds a graph whole."""
    nodes.write.json(f"{path}/nodes", mode="overwrite", ignoreNullFields=False)
    edges.write.json(f"{path}/edges", mode="overwrite", ignoreNullFields=False)


def write_database_table(rows: DataFrame, url: str, table: str, mode: str = "append", **options: str) -> None:
    rows.write.format("jdbc").options(url=url, dbtable=table, **options).mode(mode).save()
