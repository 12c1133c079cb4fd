"""Block files, chat exports, graph tables, usage records, and databases, as DataFrames."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from correspond.operators import scan
from correspond.operators.blocks import SEPARATOR
from correspond.operators.chatlog import LINE_ENDS

#: Names that a column of a graph table goes by, the first that is there counting. Fixed values.
NAMES = {
    "entities": {"id": ("id",), "title": ("title", "name", "id"), "type": ("entity_type", "type"), "description": ("description",), "degree": ("degree",), "weight": ("weight",), "level": ("level",), "source_id": ("source_id",)},
    "relationships": {"id": ("id",), "source": ("source", "src", "source_id"), "target": ("target", "tgt", "target_id"), "description": ("description",), "weight": ("weight",), "level": ("level",)},
    "communities": {"community": ("community", "id"), "level": ("level",), "entity_ids": ("entity_ids",)},
}
TYPES = {"degree": "int", "weight": "double", "level": "int", "entity_ids": "array<string>"}
#: Folders of an indexing run's records: calls of the model, and of embeddings. Fixed values.
MODEL_FOLDERS, EMBEDDING_FOLDER = ("community_reporting", "extract_graph", "summarize_descriptions"), "text_embedding"
_USAGE = "result struct<response:struct<model:string,usage:struct<prompt_tokens:bigint,completion_tokens:bigint,total_tokens:bigint>>>, broken string"


def _records(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """(file, _split, _id, value) of the records of text files, read in splits: _split is where in the file a split begins, and _id rises with the records of one."""
    return spark.read.text(path, **options).select(F.input_file_name().alias("file"), F.expr("input_file_block_start()").alias("_split"), F.monotonically_increasing_id().alias("_id"), "value")


def block_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, seq, text) of the blocks in text files, trimmed, empty ones left out; seq counts what stands between separators from 0.

    Files are read in splits of spark.sql.files.maxPartitionBytes: a block that crosses an edge belongs to the split in which it begins, so no row holds more than a block."""
    numbered = scan.placed(_records(spark, path, lineSep=SEPARATOR), ["file"], "_split", ["_id"], "seq")
    return numbered.select("file", "seq", F.regexp_replace("value", r"^\s+|\s+$", "").alias("text")).where("text <> ''")


def export_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, line) of chat exports, lines numbered from 0; files are read in splits, as by block_files."""
    lines = _records(spark, path).select("file", "_split", "_id", F.posexplode(F.split("value", LINE_ENDS)).alias("_part", "line"))
    return scan.placed(lines, ["file"], "_split", ["_id", "_part"], "line_no").select("file", "line_no", "line")


def id_text_csv(spark: SparkSession, path: str) -> DataFrame:
    """(id, text), with texts of several lines."""
    return spark.read.schema("id string, text string").csv(path, header=True, multiLine=True, quote='"', escape='"')


def graph_table(rows: DataFrame, kind: str) -> DataFrame:
    """A table of entities, relationships or communities under the names of NAMES; null where a column goes by none of them. Source and target fall back to the first two columns."""
    first = {"source": rows.columns[:1], "target": rows.columns[1:2]} if kind == "relationships" else {}

    def column(name: str, known: tuple[str, ...]) -> Column:
        found = [c for c in (*known, *first.get(name, ())) if c in rows.columns]
        return (F.col(found[0]) if found else F.lit(None)).cast(TYPES.get(name, "string")).alias(name)

    return rows.select(*(column(name, known) for name, known in NAMES[kind].items()))


def read_graph_table(spark: SparkSession, path: str, kind: str) -> DataFrame:
    return graph_table(spark.read.parquet(path), kind)


def usage_records(spark: SparkSession, cache: str) -> DataFrame:
    """(folder, model, prompt_tokens, completion_tokens, total_tokens) of the records under a run's folders, one JSON file each; missing numbers are 0, files that aren't JSON are left out."""
    rows = spark.read.schema(_USAGE).json(f"{cache}/*", multiLine=True, mode="PERMISSIVE", columnNameOfCorruptRecord="broken").withColumn("_path", F.input_file_name())
    folder = F.element_at(F.split("_path", "/"), -2)
    zero = lambda c: F.coalesce(F.col(f"result.response.usage.{c}"), F.lit(0)).alias(c)
    return rows.where("broken is null").select(folder.alias("folder"), F.col("result.response.model").alias("model"), *map(zero, ("prompt_tokens", "completion_tokens", "total_tokens"))).where(F.col("folder").isin(*MODEL_FOLDERS, EMBEDDING_FOLDER))


def usage_totals(records: DataFrame) -> DataFrame:
    """(kind, calls, input_tokens, output_tokens) of model calls and of embeddings."""
    embedding = F.col("folder") == EMBEDDING_FOLDER
    kind = F.when(embedding, "embedding").otherwise("model")
    return records.groupBy(kind.alias("kind")).agg(F.count("*").alias("calls"), F.sum(F.when(embedding, F.col("total_tokens")).otherwise(F.col("prompt_tokens"))).alias("input_tokens"), F.sum(F.when(embedding, 0).otherwise(F.col("completion_tokens"))).alias("output_tokens"))


def database_table(spark: SparkSession, url: str, table: str, key: str | None = None, low: int = 0, high: int = 0, parts: int = 1, **options: str) -> DataFrame:
    """A table behind JDBC, read in `parts` ranges of a numeric key, so that no task reads all of it."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    if key:
        reader = reader.options(partitionColumn=key, lowerBound=str(low), upperBound=str(high), numPartitions=str(parts))
    return reader.load()
