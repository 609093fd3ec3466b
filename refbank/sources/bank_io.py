"""Bank import / export and document scans.

The bank's interchange formats are JSON Lines (rules, patterns, event log)
and single JSON documents (anchors, knowledge graph, template schema).  At
scale the bank lives as Parquet snapshots partitioned by ``template_id``;
JSON is import/export only.  Readers accept many templates at once: the
template id comes from the directory layout ``.../<template_id>/...``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from refbank.functions import scalars as S

RULE_SCHEMA = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("when", T.StructType([T.StructField("input_type", T.StringType()),
                                        T.StructField("trigger", T.StringType()),
                                        T.StructField("error_type", T.StringType())])),
    T.StructField("condition", T.StructType([T.StructField("field", T.StringType()),
                                             T.StructField("context", T.StringType()),
                                             T.StructField("missing", T.ArrayType(T.StringType()))])),
    T.StructField("then", T.StructType([T.StructField("action", T.StringType()),
                                        T.StructField("anchor", T.StringType()),
                                        T.StructField("pattern", T.StringType()),
                                        T.StructField("method", T.StringType()),
                                        T.StructField("prompt", T.StringType()),
                                        T.StructField("headers", T.ArrayType(T.StringType())),
                                        T.StructField("patterns", T.ArrayType(T.StringType())),
                                        T.StructField("fallback", T.StringType())])),
    T.StructField("confidence", T.DoubleType()),
    T.StructField("support", T.LongType()),
    T.StructField("created_at", T.StringType()),
    T.StructField("last_used", T.StringType()),
    T.StructField("example", T.StructType([T.StructField("input", T.StringType()),
                                           T.StructField("output", T.StringType())])),
])
PATTERN_SCHEMA = T.StructType([
    T.StructField("pattern_id", T.StringType()),
    T.StructField("input_signature", T.StringType()),
    T.StructField("input_type", T.StringType()),
    T.StructField("fields_extracted", T.ArrayType(T.StringType())),
    T.StructField("accuracy", T.DoubleType()),
    T.StructField("rules_used", T.ArrayType(T.StringType())),
    T.StructField("anchors_matched", T.ArrayType(T.StringType())),
    T.StructField("created_at", T.StringType()),
])
EVENT_SCHEMA = T.StructType([
    T.StructField("event_id", T.StringType()),
    T.StructField("ts", T.StringType()),
    T.StructField("template_signature", T.StringType()),
    T.StructField("error_type", T.StringType()),
    T.StructField("missing_fields", T.ArrayType(T.StringType())),
    T.StructField("repair_action", T.StringType()),
    T.StructField("human_confirmed", T.BooleanType()),
    T.StructField("confidence", T.DoubleType()),
    T.StructField("rule_ids", T.ArrayType(T.StringType())),
    T.StructField("cluster_key", T.StringType()),
])
#: Flat rule columns and where a rule has them.
RULE_COLUMNS = [(f"{part}.{f.name}", f.name, f.dataType) for part in ("when", "condition", "then") for f in RULE_SCHEMA[part].dataType.fields]
ANCHOR_SPEC = "struct<type:string,role:string,pattern:string,patterns:array<string>,relative_to:string,offset:map<string,int>>"
EDGE_DOC = "struct<edges:array<struct<from:string,to:string,relation:string,weight:double>>>"
FIELD_SPEC = ("struct<cell:string,address:string,relative_to:string,row_offset:int,col_offset:int,"
              "type:string,required:boolean,name:string,anchor:string>")


def _template_from_path(level: int = 2) -> F.Column:
    """Directory name ``level`` steps above the file (``<tpl>/<store>/file``)."""
    parts = F.split(F.col("_metadata.file_path"), "/")
    return F.element_at(parts, -(level + 1))


def _empty(spark: SparkSession, schema: T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.globStatus(p))


def is_folder(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory())


def read_rules(spark: SparkSession, path: str, template_level: int = 2) -> DataFrame:
    """Rules JSONL -> flat rule table.  Blank lines are skipped, a
    malformed line fails the read (FAILFAST), a missing path yields no rows."""
    flat = T.StructType([T.StructField(n, t) for n, t in [
        ("template_id", T.StringType()), ("id", T.StringType()), *((n, t) for _, n, t in RULE_COLUMNS), ("confidence", T.DoubleType()),
        ("support", T.LongType()), ("created_at", T.StringType()), ("last_used", T.TimestampType()),
        ("example_input", T.StringType()), ("example_output", T.StringType()), ("ord", T.LongType())]])
    if not _exists(spark, path):
        return _empty(spark, flat)
    r = spark.read.schema(RULE_SCHEMA).option("mode", "FAILFAST").json(path)
    return r.select(
        _template_from_path(template_level).alias("template_id"), "id", *(F.col(c).alias(n) for c, n, _ in RULE_COLUMNS),
        "confidence", "support", "created_at",
        # unparsable timestamps become null and are ignored by decay
        F.expr("try_to_timestamp(last_used)").alias("last_used"),
        F.col("example.input").alias("example_input"), F.col("example.output").alias("example_output"),
        F.monotonically_increasing_id().alias("ord"))


def write_rules(rules: DataFrame, path: str) -> None:
    """Export a flat rule table back to JSONL (nested layout)."""
    def col(c, kind="string"):
        return (F.col(c) if c in rules.columns else F.lit(None)).cast(kind).alias(c)

    def part(name):
        return F.struct(*[col(n, t) for c, n, t in RULE_COLUMNS if c.startswith(f"{name}.")]).alias(name)

    out = rules.select(
        "id", part("when"), part("condition"), part("then"),
        "confidence", "support", col("created_at"),
        F.date_format("last_used", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("last_used"),
        F.when(col("example_input").isNotNull() | col("example_output").isNotNull(),
               F.struct(col("example_input").alias("input"), col("example_output").alias("output"))).alias("example"))
    out.write.mode("errorifexists").json(path)


def read_patterns(spark: SparkSession, path: str, template_level: int = 2) -> DataFrame:
    """S3: success patterns JSONL."""
    if not _exists(spark, path):
        return _empty(spark, T.StructType([T.StructField("template_id", T.StringType())] + PATTERN_SCHEMA.fields
                                          + [T.StructField("ord", T.LongType())]))
    p = spark.read.schema(PATTERN_SCHEMA).option("mode", "FAILFAST").json(path)
    return p.select(_template_from_path(template_level).alias("template_id"), "*",
                    F.monotonically_increasing_id().alias("ord"))


def read_anchors(spark: SparkSession, path: str, template_level: int = 2) -> DataFrame:
    """Anchors document, flat ``{field: spec}`` or wrapped
    ``{schema_version, anchors: {...}}`` (Q3) -> one row per field."""
    cols = ("template_id string, field string, type string, role string, pattern string, patterns array<string>, "
            "relative_to string, offset map<string,int>")
    if not _exists(spark, path):
        return spark.createDataFrame([], cols)
    doc = spark.read.text(path, wholetext=True).select(
        _template_from_path(template_level).alias("template_id"), F.col("value"))
    body = F.coalesce(F.get_json_object("value", "$.anchors"), F.col("value"))
    m = _parsed(F.from_json(body, f"map<string,{ANCHOR_SPEC}>"), "anchors")
    return (doc.select("template_id", F.explode(m).alias("field", "spec"))
            .select("template_id", "field", "spec.type", "spec.role", "spec.pattern", "spec.patterns",
                    "spec.relative_to", "spec.offset"))


def _parsed(value, what: str):
    """A document that is no JSON object of its kind fails the read."""
    return F.coalesce(value, F.raise_error(F.lit(f"malformed {what} document")))


def read_edges(spark: SparkSession, path: str, template_level: int = 2) -> DataFrame:
    """Knowledge graph document -> (template_id, src, dst, relation, weight)."""
    if not _exists(spark, path):
        return spark.createDataFrame([], "template_id string, src string, dst string, relation string, weight double")
    doc = spark.read.text(path, wholetext=True).select(
        _template_from_path(template_level).alias("template_id"), 
        _parsed(F.from_json("value", EDGE_DOC, {"mode": "FAILFAST"}), "graph").alias("g"))
    return (doc.select("template_id", F.explode_outer("g.edges").alias("e")).where(F.col("e").isNotNull())
            .select("template_id", F.col("e.from").alias("src"), F.col("e.to").alias("dst"),
                    F.col("e.relation").alias("relation"), F.coalesce("e.weight", F.lit(1.0)).alias("weight")))


def schema_fields_from_json(docs: DataFrame) -> DataFrame:
    """Template schema documents ``(tpl, value)`` -> flat field specs
    ``(tpl, field, rel, r0, c0, dr, dc, name, type, required)``.

    New layout ``{"fields": {name: spec}}`` (non-object specs skipped) and the
    legacy cell-keyed layout ``{"B2": {"name": ...}}`` are both accepted."""
    fields_txt = F.get_json_object("value", "$.fields")
    is_new = F.coalesce(F.ltrim(fields_txt).startswith("{"), F.lit(False))
    new = (docs.where(is_new)
           .select("tpl", F.explode(F.from_json(fields_txt, "map<string,string>")).alias("field", "raw"))
           .where(F.col("raw").startswith("{"))
           .withColumn("spec", F.from_json("raw", FIELD_SPEC)))
    # ``cell`` unless empty, else ``address``
    ref = F.coalesce(F.when(F.col("spec.cell") != "", F.col("spec.cell")), F.col("spec.address"))
    absolute = S.is_cell_ref(ref)
    new = new.select(
        "tpl", "field",
        F.when(~absolute, F.col("spec.relative_to")).alias("rel"),
        F.when(absolute, S.cell_row(F.upper(ref))).alias("r0"),
        F.when(absolute, S.cell_col(F.upper(ref))).alias("c0"),
        F.coalesce(F.col("spec.row_offset"), F.lit(0)).cast("long").alias("dr"),
        F.coalesce(F.col("spec.col_offset"), F.lit(0)).cast("long").alias("dc"),
        F.col("spec.name").alias("name"), F.col("spec.type").alias("type"),
        F.col("spec.required").alias("required"))
    legacy = (docs.where(~is_new)
              .select("tpl", F.explode(F.from_json("value", "map<string,string>")).alias("field", "raw"))
              .where(~F.col("field").isin("fields", "meta", "version") & S.is_cell_ref(F.col("field")))
              .withColumn("spec", F.from_json("raw", FIELD_SPEC))
              .select("tpl", "field", F.lit(None).cast("string").alias("rel"),
                      S.cell_row(F.upper(F.col("field"))).alias("r0"),
                      S.cell_col(F.upper(F.col("field"))).alias("c0"),
                      F.lit(0).cast("long").alias("dr"), F.lit(0).cast("long").alias("dc"),
                      F.col("spec.name").alias("name"), F.col("spec.type").alias("type"),
                      F.col("spec.required").alias("required")))
    return new.unionByName(legacy)


def formula_constraints_from_json(docs: DataFrame) -> DataFrame:
    """``formula_constraints`` of each schema document, one row each."""
    arr = F.from_json(F.get_json_object("value", "$.formula_constraints"),
                      "array<struct<cell:string,formula:string,depends_on:array<string>,description:string>>")
    return docs.select("tpl", F.explode(arr).alias("f")).select("tpl", "f.*")


def _log_lines(spark: SparkSession, path: str) -> DataFrame:
    """Every line that is not blank, with its JSON object in ``e`` (null if it is none).

    Fields are read as text first: an odd type in one field must not cost the line."""
    loose = T.StructType([T.StructField(f.name, T.StringType()) for f in EVENT_SCHEMA] + [T.StructField("_bad", T.StringType())])
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file")).where(S.py_strip("value") != "")
    e = F.from_json("value", loose, {"columnNameOfCorruptRecord": "_bad"})
    return lines.withColumn("e", e).withColumn("e", F.when(F.col("e._bad").isNull(), F.col("e")))


def _typed_events(lines: DataFrame) -> DataFrame:
    def typed(f):
        c = F.col(f"e.{f.name}")
        if isinstance(f.dataType, T.ArrayType):
            return F.from_json(c, f.dataType).alias(f.name)
        return c.try_cast(f.dataType).alias(f.name)

    return lines.where(F.col("e").isNotNull()).select(*[typed(f) for f in EVENT_SCHEMA])


def read_exec_log(spark: SparkSession, path: str) -> DataFrame:
    """Lenient event log: blank lines and lines that are no JSON object
    are dropped; a field of another type is cast, or null where it cannot be."""
    if not _exists(spark, path):
        return _empty(spark, EVENT_SCHEMA)
    return _typed_events(_log_lines(spark, path))


def read_exec_log_with_rejects(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """S8 variant: the good rows, and the rejected raw lines (with their
    file) so they can be counted or kept."""
    if not _exists(spark, path):
        return _empty(spark, EVENT_SCHEMA), spark.createDataFrame([], "line string, file string")
    lines = _log_lines(spark, path)
    return _typed_events(lines), lines.where(F.col("e").isNull()).select(F.col("value").alias("line"), "file")


def append_events(events: DataFrame, path: str, partition_col: str = "dt") -> None:
    """Append-only event log, partitioned by day."""
    out = events.withColumn(partition_col, F.to_date(F.col("ts").cast("timestamp")))
    out.write.mode("append").partitionBy(partition_col).json(path)


def write_snapshot(df: DataFrame, root: str, version: int, partition_col: str = "template_id") -> str:
    """Write a bank table as a *new* snapshot directory (never the path
    being read).  Returns the snapshot path."""
    path = f"{root.rstrip('/')}/snapshot={version:06d}"
    df.write.mode("errorifexists").partitionBy(partition_col).parquet(path)
    return path


def latest_snapshot(spark: SparkSession, root: str) -> str | None:
    """Path of the highest snapshot under ``root`` (listing only)."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/snapshot=*")
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = fs.globStatus(p) or []
    # a folder without the commit mark is unfinished
    names = sorted(str(s.getPath().toString()) for s in found
                   if fs.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS")))
    return names[-1] if names else None


def read_snapshot(spark: SparkSession, root: str) -> DataFrame | None:
    path = latest_snapshot(spark, root)
    return spark.read.parquet(path) if path else None


BANK_STORES = ("rules", "patterns", "anchors", "edges", "schema")


def _fs_path(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def latest_bank(spark: SparkSession, root: str) -> int:
    """Number of the newest whole bank under ``root``, 0 if there is none."""
    p, fs = _fs_path(spark, f"{root.rstrip('/')}/bank=*/_COMPLETE")
    return max((int(s.getPath().getParent().getName().split("=")[1]) for s in fs.globStatus(p) or []), default=0)


def commit_bank(spark: SparkSession, root: str, stores: dict[str, DataFrame]) -> int:
    """One new bank number over all stores.  Stores that are not given are taken
    over from the newest whole bank.  The mark that makes the bank readable is
    written last, so a round that breaks leaves the old one in place; numbers of
    broken rounds are not used again."""
    unknown = set(stores) - set(BANK_STORES)
    if unknown:
        raise ValueError(f"no such store: {sorted(unknown)}")
    old = read_bank(spark, root)
    p, fs = _fs_path(spark, f"{root.rstrip('/')}/bank=*")
    number = 1 + max((int(s.getPath().getName().split("=")[1]) for s in fs.globStatus(p) or []), default=0)
    path = f"{root.rstrip('/')}/bank={number:06d}"
    for name, df in {**old, **stores}.items():
        df.write.mode("errorifexists").partitionBy("template_id").parquet(f"{path}/{name}")
    fs.create(_fs_path(spark, f"{path}/_COMPLETE")[0], False).close()
    return number


def read_bank(spark: SparkSession, root: str, number: int | None = None) -> dict[str, DataFrame]:
    """The stores of a whole bank (the newest unless told), none if there is none."""
    number = latest_bank(spark, root) if number is None else number
    path = f"{root.rstrip('/')}/bank={number:06d}"
    if not number or not _exists(spark, f"{path}/_COMPLETE"):
        return {}
    return {n: spark.read.parquet(f"{path}/{n}") for n in BANK_STORES if _exists(spark, f"{path}/{n}")}


def scan_documents(spark: SparkSession, path: str, template_level: int = 1) -> DataFrame:
    """Every file as one text value with its path (and template dir)."""
    if not _exists(spark, path):
        return spark.createDataFrame([], "template_id string, path string, content string")
    d = spark.read.text(path, wholetext=True)
    return d.select(_template_from_path(template_level).alias("template_id"),
                    F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))
