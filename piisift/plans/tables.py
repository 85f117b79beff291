"""Input tables of the registered queries, all read or derived by Spark.

* ``corpus``: every text we scan — ``documents.text``, ``pages.html`` and the
  REC record text built from ``customer`` (one row per customer, every type
  of identifier at least once).
* ``doc_files``: ``documents`` seen as files of a run (``source`` is the
  scanned folder), used by the run, report and browsing queries.

Each derived table also has a DuckDB form (``*_SQL``) for the oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# REC text per customer.  ``{s}`` is the engine's string type name.
REC_TEXT = (
    "concat('card 4', lpad(cast(c_custkey*7919 % 1000000000000000 as {s}),15,'0'),"
    " ' aadhaar ', lpad(cast(234123400000 + c_custkey as {s}),12,'0'),"
    " ' pan ABCP', 'K', lpad(cast(c_custkey%10000 as {s}),4,'0'), 'L passport A', lpad(cast(c_custkey as {s}),7,'0'),"
    " ' voter ABC', lpad(cast(c_custkey as {s}),7,'0'),"
    " ' dl MH12 2011', lpad(cast(c_custkey as {s}),7,'0'),"
    " ' ifsc HDFC0', lpad(cast(c_custkey as {s}),6,'0'),"
    " ' upi user', cast(c_custkey as {s}), '@ybl phone +91 9', lpad(cast(c_custkey as {s}),9,'0'),"
    " ' mail u', cast(c_custkey as {s}), '@mail.example.com')"
)

# documents as files: folder = source, extension by language; the shortest
# texts are notes (md: skipped), the next ones damaged files (ERROR), so that
# every outcome occurs and every other text is scanned.
FILE_EXT = ("case when n_chars < 60 then 'md' when lang = 'en' then 'txt' when lang = 'de' then 'csv' "
            "when lang = 'fr' then 'TXT' else 'Csv' end")
DAMAGED = "n_chars between 60 and 90"
SUPPORTED_EXTENSIONS = ("pdf", "docx", "xlsx", "txt", "csv")  # fixed default list
BASE_TS = "2024-01-01 00:00:00"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Parquet table by name (a file or a folder of files)."""
    return spark.read.parquet(_path(sf_dir, name))


def spread(df: DataFrame, per_core: int = 2) -> DataFrame:
    """Round-robin spread of a plain scan that arrives in fewer splits than
    there are cores (e.g. one large row group), to ``per_core`` × cores.

    Only looks at the plan's own split count (planning, no job).  An input
    that already gives every core a split is left alone, so large tables are
    never reshuffled; for small ones (one row group cannot be split by a
    reader) the shuffle is cheap next to the regex work it spreads.
    """
    try:
        cores = df.sparkSession.sparkContext.defaultParallelism
        have = df.rdd.getNumPartitions()
    except Exception:  # noqa: BLE001 - no RDD access (e.g. Spark Connect): keep as is
        return df
    return df if have >= cores else df.repartition(cores * per_core)


def _path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


def rec(spark: SparkSession, sf_dir: str) -> DataFrame:
    cust = read_table(spark, sf_dir, "customer").select("c_custkey")
    return cust.selectExpr("c_custkey as rec_id", REC_TEXT.format(s="string") + " as text")


def corpus(spark: SparkSession, sf_dir: str, balance: bool = True) -> DataFrame:
    """src, doc_id, text — documents ∪ pages ∪ conversations ∪ REC."""
    docs = read_table(spark, sf_dir, "documents").select(
        F.lit("documents").alias("src"), "doc_id", "text")
    pages = read_table(spark, sf_dir, "pages").select(
        F.lit("pages").alias("src"), F.col("page_id").alias("doc_id"), F.col("html").alias("text"))
    said = read_table(spark, sf_dir, "conversations").select(
        F.lit("conversations").alias("src"), (F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), "text")
    recs = rec(spark, sf_dir).select(F.lit("rec").alias("src"), F.col("rec_id").alias("doc_id"), "text")
    every = docs.unionByName(pages).unionByName(said).unionByName(recs)
    return spread(every) if balance else every


def doc_files(spark: SparkSession, sf_dir: str, balance: bool = True) -> DataFrame:
    """documents as files: scan_path, doc_id, path, file_name, size_bytes,
    created, modified (TIMESTAMP_NTZ), lang, text, extension, status."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    if balance:
        docs = spread(docs)
    ext = F.expr(FILE_EXT)
    name = F.concat(F.lit("doc-"), F.col("doc_id").cast("string"), F.lit("."), ext)
    created = F.expr(f"timestamp_ntz'{BASE_TS}' + make_dt_interval(0, 0, doc_id, 0)")  # + doc_id minutes
    out = docs.select(
        F.col("source").alias("scan_path"), "doc_id",
        F.concat_ws("/", F.lit("/data"), "source", name).alias("path"),
        name.alias("file_name"), ext.alias("ext_raw"),
        F.octet_length("text").cast("long").alias("size_bytes"),
        created.alias("created"),
        # modified: n_chars seconds later, so run metadata never reads the text
        (created + F.expr("make_dt_interval(0, 0, 0, n_chars)")).alias("modified"),
        "lang", "text", F.expr(DAMAGED).alias("damaged"))
    supported = F.lower("ext_raw").isin(*SUPPORTED_EXTENSIONS)
    return (out.withColumn("extension", F.lower("ext_raw"))
            .withColumn("status", F.when(~supported, "SKIPPED")
                        .when(F.col("text").isNull() | F.col("damaged"), "ERROR").otherwise("SCANNED"))
            .drop("ext_raw"))


def run_id_of(scan_path):
    return F.concat(F.lit("run-"), scan_path)


# ---- DuckDB forms -------------------------------------------------------
REC_SQL = f"select c_custkey as rec_id, {REC_TEXT.format(s='varchar')} as text from customer"
CORPUS_SQL = ("select 'documents' as src, doc_id, text from documents "
              "union all select 'pages' as src, page_id as doc_id, html as text from pages "
              "union all select 'conversations' as src, conv_id * 1000 + turn as doc_id, text from conversations "
              "union all select 'rec' as src, rec_id as doc_id, text from rec")
DOC_FILES_SQL = f"""
select source as scan_path, doc_id,
       '/data/' || source || '/doc-' || cast(doc_id as varchar) || '.' || ({FILE_EXT}) as path,
       'doc-' || cast(doc_id as varchar) || '.' || ({FILE_EXT}) as file_name,
       lower({FILE_EXT}) as extension,
       cast(strlen(text) as bigint) as size_bytes,
       timestamp '{BASE_TS}' + to_minutes(doc_id) as created,
       timestamp '{BASE_TS}' + to_minutes(doc_id) + to_seconds(n_chars) as modified,
       case when lower({FILE_EXT}) not in ({', '.join(repr(e) for e in SUPPORTED_EXTENSIONS)}) then 'SKIPPED'
            when text is null or {DAMAGED} then 'ERROR' else 'SCANNED' end as status,
       text, {DAMAGED} as damaged
from documents"""


def with_ctes(body: str, *names: str) -> str:
    """Prefix a DuckDB statement with the derived tables it uses."""
    defs = {"rec": REC_SQL, "corpus": CORPUS_SQL, "doc_files": DOC_FILES_SQL}
    need: list[str] = []
    for n in names:
        if n == "corpus" and "rec" not in need:
            need.append("rec")
        if n not in need:
            need.append(n)
    if not need:
        return body
    return "with " + ",\n".join(f"{n} as ({defs[n]})" for n in need) + "\n" + body
