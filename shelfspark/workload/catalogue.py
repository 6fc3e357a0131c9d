"""Queries over users, bases and files, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfspark.functions import names
from shelfspark.operators import catalog, dml, versions
from shelfspark.schema import FILE_EVENTS, FILES, KB_EVENTS, missing_columns, require_columns
from shelfspark.sources import sinks
from shelfspark.storage import fresh_path
from shelfspark.workload import bind
from shelfspark.workload.sql import registry

STAMP = "1700000000"


PARTS = {
    "asked_kbs": """
        SELECT DISTINCT 'u' || CAST(doc_id % 6 AS VARCHAR) AS user_id,
               'KB_u' || CAST(doc_id % 5 AS VARCHAR) || '_' || source AS kb_id FROM documents""",
    "web_files": """
        SELECT md5(url) AS file_id,
               'KB_u' || CAST(page_id % 5 AS VARCHAR) || '_src' || CAST(page_id % 20 AS VARCHAR)
                 AS kb_id,
               url AS file_name, 0 AS deleted FROM pages""",
}


def asked_kbs(spark, d):
    doc = F.col("doc_id")
    return (
        bind.table(spark, d, "documents")
        .select(
            F.concat(F.lit("u"), (doc % 6).cast("string")).alias("user_id"),
            F.concat(F.lit("KB_u"), (doc % 5).cast("string"), F.lit("_"), "source").alias("kb_id"),
        )
        .distinct()
    )


def web_files(spark, d):
    page = F.col("page_id")
    return bind.table(spark, d, "pages").select(
        F.md5("url").alias("file_id"),
        F.concat(
            F.lit("KB_u"), (page % 5).cast("string"), F.lit("_src"), (page % 20).cast("string")
        ).alias("kb_id"),
        F.col("url").alias("file_name"),
        F.lit(0).alias("deleted"),
    )


QUERIES, SQL, register = registry(PARTS)

# --- projections and filters --------------------------------------------------


@register("flt_live", "SELECT file_id, status FROM files WHERE deleted = 0")
def flt_live(spark, d):
    return catalog.live(bind.files(spark, d)).select("file_id", "status")


@register(
    "flt_user_id",
    """SELECT candidate, regexp_matches(candidate, '^[A-Za-z][A-Za-z0-9_]*$') AS valid FROM (
         SELECT lang || '_' || CAST(doc_id AS VARCHAR) AS candidate FROM documents
         UNION ALL SELECT CAST(doc_id AS VARCHAR) || source FROM documents
         UNION ALL SELECT url FROM pages)""",
)
def flt_user_id(spark, d):
    documents = bind.table(spark, d, "documents")
    candidates = (
        documents.select(F.concat("lang", F.lit("_"), "doc_id").alias("candidate"))
        .unionByName(documents.select(F.concat("doc_id", "source").alias("candidate")))
        .unionByName(bind.table(spark, d, "pages").select(F.col("url").alias("candidate")))
    )
    return candidates.withColumn("valid", names.valid_user_id(F.col("candidate")))


@register(
    "flt_file_id",
    """SELECT candidate, regexp_matches(candidate, '^[0-9a-f]{32}$') AS valid FROM (
         SELECT file_id AS candidate FROM files
         UNION ALL SELECT md5(text) FROM texts
         UNION ALL SELECT upper(md5(text)) FROM texts
         UNION ALL SELECT kb_id FROM files)""",
)
def flt_file_id(spark, d):
    files, texts = bind.files(spark, d), bind.texts(spark, d)
    candidates = (
        files.select(F.col("file_id").alias("candidate"))
        .unionByName(texts.select(F.md5("text").alias("candidate")))
        .unionByName(texts.select(F.upper(F.md5("text")).alias("candidate")))
        .unionByName(files.select(F.col("kb_id").alias("candidate")))
    )
    return candidates.withColumn("valid", names.valid_file_id(F.col("candidate")))


@register(
    "prj_clean_name",
    """SELECT page_id, replace(regexp_replace(
                replace(url, '?', '%') || ' +（' || CAST(page_id AS VARCHAR) || '）。',
                '[！-～　-〿]', '', 'g'), '/', '_') AS name FROM pages""",
)
def prj_clean_name(spark, d):
    encoded = F.replace(F.replace("url", F.lit("/"), F.lit("%2F")), F.lit("?"), F.lit("%25"))
    raw = F.concat(encoded, F.lit("%20+%EF%BC%88"), "page_id", F.lit("）。"))
    return bind.table(spark, d, "pages").select("page_id", names.clean_name(raw).alias("name"))


@register(
    "prj_truncate_name",
    f"""SELECT origin, CASE WHEN strlen(stem || ext) <= 200 THEN stem || ext ELSE
          substring(stem, 1, greatest(0, length(stem) - 4 * list_min(list_filter(
            range(1, length(stem) // 4 + 2), lambda m:
            strlen(substring(stem, 1, greatest(0, length(stem) - 4 * m)) || '_{STAMP}' || ext)
              <= 200)))) || '_{STAMP}' || ext END AS name
        FROM (SELECT 'b' || CAST(item_id AS VARCHAR) AS origin, replace(text, '.', ' ') AS stem,
                     '.txt' AS ext FROM benchmark
              UNION ALL
              SELECT 'c' || CAST(conv_id AS VARCHAR) || ':' || CAST(turn AS VARCHAR),
                     replace(text, '.', ' '), '.md' FROM conversations)""",
)
def prj_truncate_name(spark, d):
    def named(df, origin, ext):
        return df.select(
            origin.alias("origin"),
            F.concat(F.replace("text", F.lit("."), F.lit(" ")), F.lit(ext)).alias("name"),
        )

    raw = named(bind.table(spark, d, "benchmark"), F.concat(F.lit("b"), "item_id"), ".txt")
    raw = raw.unionByName(
        named(
            bind.table(spark, d, "conversations"),
            F.concat(F.lit("c"), "conv_id", F.lit(":"), "turn"),
            ".md",
        )
    )
    return raw.select("origin", names.truncate_name(F.col("name"), F.lit(STAMP)).alias("name"))


@register(
    "prj_download",
    """SELECT a.file_id, CASE WHEN NOT regexp_matches(a.file_id, '^[0-9a-f]{32}$')
                 OR l.user_id IS NULL THEN 'file not found'
               WHEN l.deleted <> 0 THEN 'file deleted'
               WHEN starts_with(l.file_name, 'http') THEN 'redirect' ELSE 'file' END AS outcome,
          CASE WHEN l.user_id IS NULL OR l.deleted <> 0 THEN ''
               WHEN starts_with(l.file_name, 'http') THEN l.file_name
               ELSE l.user_id || '/' || a.file_id || '/' || l.file_name END AS target
        FROM (SELECT file_id FROM files UNION ALL SELECT file_id FROM web_files
              UNION ALL SELECT md5(text) FROM texts) a
        LEFT JOIN (SELECT f.file_id, f.file_name, f.deleted, k.user_id
                   FROM (SELECT file_id, kb_id, file_name, deleted FROM files
                         UNION ALL SELECT * FROM web_files) f
                   JOIN kbs k ON k.kb_id = f.kb_id) l ON l.file_id = a.file_id""",
)
def prj_download(spark, d):
    columns = ("file_id", "kb_id", "file_name", "deleted")
    files = bind.files(spark, d).select(*columns).unionByName(web_files(spark, d))
    asked = files.select("file_id").unionByName(
        bind.texts(spark, d).select(F.md5("text").alias("file_id"))
    )
    return catalog.downloads(asked, files, bind.kbs(spark, d), bind.users(spark, d))


def _message_case(table: dict[str, str]) -> str:
    cases = " ".join(f"WHEN '{key}' THEN '{text}'" for key, text in table.items())
    return f"CASE status {cases} ELSE '' END"


@register(
    "prj_status_msg",
    f"SELECT file_id, {_message_case(names.STATUS_MESSAGES)} AS msg FROM files",
)
def prj_status_msg(spark, d):
    return bind.files(spark, d).select(
        "file_id", names.status_message(F.col("status")).alias("msg")
    )


@register(
    "prj_status_label",
    f"""SELECT file_id, CASE WHEN status = 'red' AND deleted = 1 THEN 'gone'
               ELSE {_message_case(names.STATUS_LABELS)} END AS label FROM files""",
)
def prj_status_label(spark, d):
    error = F.when(F.col("deleted") == 1, "gone")
    return bind.files(spark, d).select(
        "file_id", names.status_label(F.col("status"), error).alias("label")
    )


@register(
    "flt_green",
    """SELECT k.user_id, count(*) AS n_green FROM live_files f JOIN kbs k ON k.kb_id = f.kb_id
       WHERE f.status = 'green' GROUP BY k.user_id""",
)
def flt_green(spark, d):
    green = catalog.live(bind.files(spark, d)).where("status = 'green'")
    per_kb = green.groupBy("kb_id").agg(F.count(F.lit(1)).alias("n"))
    return (
        per_kb.join(bind.kbs(spark, d), "kb_id").groupBy("user_id").agg(F.sum("n").alias("n_green"))
    )


@register("flt_schema", "SELECT count(*) AS n_rows FROM files")
def flt_schema(spark, d):
    return require_columns(bind.files(spark, d), "files").agg(F.count(F.lit(1)).alias("n_rows"))


@register(
    "set_required_cols",
    """SELECT doc_id, 'content_length,deleted,file_id,file_name,file_size,kb_id,status,timestamp'
              AS missing FROM documents""",
)
def set_required_cols(spark, d):
    documents = bind.table(spark, d, "documents").withColumn("chunk_size", F.lit(0))
    missing = ",".join(sorted(missing_columns(documents, FILES.names)))
    return documents.select("doc_id", F.lit(missing).alias("missing"))


@register(
    "prj_stamp_chunk",
    """SELECT file_id, file_name FROM files UNION ALL SELECT file_id, file_name FROM web_files""",
)
def prj_stamp_chunk(spark, d):
    stored = bind.files(spark, d).select(
        "file_id", F.concat(F.lit("/content/"), "kb_id", F.lit("/"), "file_name").alias("path")
    )
    shown = stored.select("file_id", names.base_name(F.col("path")).alias("file_name"))
    return shown.unionByName(web_files(spark, d).select("file_id", "file_name"))


@register(
    "prj_new_ids",
    """SELECT file_id, md5(kb_id || chr(1) || file_name) AS new_file_id,
              'KB' || md5(kb_id) AS new_kb_id FROM files""",
)
def prj_new_ids(spark, d):
    return bind.files(spark, d).select(
        "file_id",
        names.stable_id(F.col("kb_id"), F.col("file_name")).alias("new_file_id"),
        names.stable_kb_id(F.col("kb_id")).alias("new_kb_id"),
    )


@register(
    "flt_user_exists",
    """SELECT DISTINCT 'u' || CAST(user_id AS VARCHAR) AS user_id FROM events
       WHERE 'u' || CAST(user_id AS VARCHAR) IN (SELECT user_id FROM users)""",
)
def flt_user_exists(spark, d):
    asked = bind.table(spark, d, "events").select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("user_id")
    )
    return catalog.user_exists(asked.distinct(), bind.users(spark, d))


@register(
    "scan_catalog",
    """SELECT f.kb_id, f.file_id, f.file_name, f.status, f.file_size AS bytes, f.timestamp
       FROM live_files f WHERE f.kb_id IN (SELECT kb_id FROM kbs)""",
)
def scan_catalog(spark, d):
    return catalog.list_files(bind.files(spark, d), bind.kbs(spark, d)).select(
        "kb_id", "file_id", "file_name", "status", "bytes", "timestamp"
    )


@register("scan_users", "SELECT user_id FROM users")
def scan_users(spark, d):
    return bind.users(spark, d).select("user_id")


@register(
    "scan_kb_names",
    """SELECT user_id, kb_id, kb_name FROM kbs
       WHERE deleted = 0 AND kb_id IN (SELECT kb_id FROM asked_kbs WHERE user_id <> 'u5')""",
)
def scan_kb_names(spark, d):
    return catalog.kb_names(bind.kbs(spark, d), asked_kbs(spark, d).where("user_id <> 'u5'"))


# --- joins --------------------------------------------------------------------


@register(
    "join_lineage",
    """SELECT f.file_id, u.user_id, f.file_name, f.deleted FROM files f
       JOIN kbs k ON k.kb_id = f.kb_id JOIN users u ON u.user_id = k.user_id""",
)
def join_lineage(spark, d):
    return catalog.lineage(bind.files(spark, d), bind.kbs(spark, d), bind.users(spark, d))


@register(
    "join_semi_owner",
    """SELECT file_id FROM live_files
       WHERE kb_id IN (SELECT kb_id FROM kbs WHERE user_id = 'u3')""",
)
def join_semi_owner(spark, d):
    return catalog.owned_files(bind.files(spark, d), bind.kbs(spark, d), "u3").select("file_id")


MISSING_KBS = """
SELECT user_id, kb_id FROM asked_kbs a WHERE NOT EXISTS (
  SELECT 1 FROM kbs k WHERE k.user_id = a.user_id AND k.kb_id = a.kb_id AND k.deleted = 0)"""


@register("join_anti_kb", MISSING_KBS)
def join_anti_kb(spark, d):
    return catalog.missing_kbs(asked_kbs(spark, d), bind.kbs(spark, d))


@register(
    "set_except_kb",
    """SELECT user_id, kb_id FROM asked_kbs
       EXCEPT SELECT user_id, kb_id FROM kbs WHERE deleted = 0""",
)
def set_except_kb(spark, d):
    owned = catalog.user_kbs(bind.kbs(spark, d)).select("user_id", "kb_id")
    return asked_kbs(spark, d).exceptAll(owned)


@register(
    "join_file_exist",
    """SELECT a.user_id, f.kb_id, f.file_id, f.status FROM live_files f
       JOIN (SELECT 'u' || CAST(doc_id % 6 AS VARCHAR) AS user_id,
                    lpad(CAST(doc_id AS VARCHAR), 32, '0') AS file_id FROM documents) a
         ON a.file_id = f.file_id
       JOIN kbs k ON k.kb_id = f.kb_id AND k.user_id = a.user_id""",
)
def join_file_exist(spark, d):
    asked = bind.table(spark, d, "documents").select(
        F.concat(F.lit("u"), (F.col("doc_id") % 6).cast("string")).alias("user_id"),
        F.concat(F.lit("KB_u"), (F.col("doc_id") % 5).cast("string"), F.lit("_"), "source").alias(
            "kb_id"
        ),
        F.lpad(F.col("doc_id").cast("string"), 32, "0").alias("file_id"),
    )
    return catalog.existing_files(asked, bind.files(spark, d), bind.kbs(spark, d))


@register(
    "join_soft_upload",
    """SELECT i.kb_id, i.file_name FROM (
         SELECT kb_id, file_name FROM files
         UNION ALL SELECT kb_id, 'new_' || file_name FROM files
         UNION ALL SELECT kb_id, 'new_' || file_name FROM files) i
       WHERE NOT EXISTS (SELECT 1 FROM live_files f
                         WHERE f.kb_id = i.kb_id AND f.file_name = i.file_name)""",
)
def join_soft_upload(spark, d):
    files = bind.files(spark, d)
    fresh = files.select("kb_id", F.concat(F.lit("new_"), "file_name").alias("file_name"))
    incoming = files.select("kb_id", "file_name").unionByName(fresh).unionByName(fresh)
    return catalog.accept_uploads(incoming, files)


# --- aggregates ---------------------------------------------------------------


@register(
    "agg_total_status",
    """SELECT k.user_id, k.kb_name || k.kb_id AS kb_key,
              count(*) FILTER (WHERE f.status = 'green') AS green,
              count(*) FILTER (WHERE f.status = 'yellow') AS yellow,
              count(*) FILTER (WHERE f.status = 'red') AS red,
              count(*) FILTER (WHERE f.status = 'gray') AS gray
       FROM kbs k LEFT JOIN live_files f ON f.kb_id = k.kb_id
       WHERE k.deleted = 0 GROUP BY k.user_id, k.kb_name, k.kb_id""",
)
def agg_total_status(spark, d):
    return catalog.total_status(bind.files(spark, d), bind.kbs(spark, d))


@register(
    "agg_status_total",
    """SELECT kb_id, status, count(*) AS n_files FROM live_files
       WHERE kb_id IN (SELECT kb_id FROM kbs) GROUP BY kb_id, status""",
)
def agg_status_total(spark, d):
    totals = catalog.status_map(bind.files(spark, d), bind.kbs(spark, d))
    return totals.select("kb_id", F.explode("total").alias("status", "n_files"))


@register(
    "agg_file_stats",
    """SELECT file_id, CAST(sum(length(content)) AS BIGINT) AS content_length,
              count(*) AS chunk_size FROM chunks GROUP BY file_id""",
)
def agg_file_stats(spark, d):
    return catalog.file_stats(bind.chunks(spark, d))


@register(
    "agg_files_present",
    """SELECT DISTINCT file_id FROM vectors
       WHERE file_id IN (SELECT file_id FROM files WHERE status = 'green')""",
)
def agg_files_present(spark, d):
    asked = bind.files(spark, d).where("status = 'green'")
    return dml.present_files(bind.vectors(spark, d), asked)


@register(
    "agg_any_pending",
    """SELECT kb_id, bool_or(status = 'gray') AS pending FROM live_files
       WHERE kb_id IN (SELECT kb_id FROM kbs) GROUP BY kb_id""",
)
def agg_any_pending(spark, d):
    return catalog.any_pending(bind.files(spark, d), bind.kbs(spark, d))


# --- state changes --------------------------------------------------------------


def file_events(spark, d):
    """Add, size, status and delete events of every file, in sequence."""
    files = bind.files(spark, d)
    number = F.col("file_id").cast("bigint") * 10

    def step(rows, op, seq, **attributes):
        return rows.select(
            *(
                (number + seq).alias("seq") if f.name == "seq"
                else F.lit(op).alias("op") if f.name == "op"
                else F.col("file_id") if f.name == "file_id"
                else attributes[f.name].cast(f.dataType).alias(f.name) if f.name in attributes
                else F.lit(None).cast(f.dataType).alias(f.name)
                for f in FILE_EVENTS
            )
        )

    return (
        step(files, "add", 1, kb_id=F.col("kb_id"), file_name=F.col("file_name"),
             status=F.lit("gray"), timestamp=F.col("timestamp"))
        .unionByName(step(files, "update", 2, file_size=F.col("file_size")))
        .unionByName(step(files, "update", 3, status=F.col("status")))
        .unionByName(step(files.where("deleted = 1"), "delete", 4))
    )


LAST = 1 << 60


@register(
    "dml_update_file",
    """SELECT file_id, kb_id, file_name, status, timestamp, file_size,
              CAST(-1 AS BIGINT) AS content_length, CAST(-1 AS BIGINT) AS chunk_size, deleted
       FROM files""",
)
def dml_update_file(spark, d):
    return dml.fold_files(file_events(spark, d))


@register(
    "dml_soft_delete_files",
    """SELECT file_id, CASE WHEN status = 'red' THEN 1 ELSE deleted END AS deleted FROM files""",
)
def dml_soft_delete_files(spark, d):
    files = bind.files(spark, d)
    gone = dml.delete_file_events(files, files.where("status = 'red'"), LAST)
    return dml.fold_files(file_events(spark, d).unionByName(gone)).select("file_id", "deleted")


@register(
    "dml_delete_kb",
    """SELECT f.file_id, CASE WHEN k.kb_id IS NOT NULL THEN 1 ELSE f.deleted END AS deleted
       FROM files f LEFT JOIN (
         SELECT kb_id FROM kbs WHERE (user_id, kb_id) IN (SELECT (user_id, kb_id) FROM asked_kbs)
       ) k ON k.kb_id = f.kb_id""",
)
def dml_delete_kb(spark, d):
    _, gone = dml.delete_kb_events(
        bind.kbs(spark, d), bind.files(spark, d), asked_kbs(spark, d), LAST
    )
    return dml.fold_files(file_events(spark, d).unionByName(gone)).select("file_id", "deleted")


@register(
    "dml_rename_kb",
    """SELECT k.kb_id, CASE WHEN a.kb_id IS NOT NULL THEN 'new ' || k.kb_id ELSE k.kb_name END
              AS kb_name
       FROM kbs k LEFT JOIN asked_kbs a ON a.kb_id = k.kb_id AND a.user_id = k.user_id""",
)
def dml_rename_kb(spark, d):
    kbs = bind.kbs(spark, d)
    created = kbs.select(
        "kb_id", "user_id", F.lit(0).cast("bigint").alias("seq"), F.lit("add").alias("op"), "kb_name"
    ).select(*KB_EVENTS.names)
    asked = asked_kbs(spark, d).withColumn("kb_name", F.concat(F.lit("new "), "kb_id"))
    renamed = dml.rename_kb_events(kbs, asked, LAST)
    return dml.fold_kbs(created.unionByName(renamed)).select("kb_id", "kb_name")


@register(
    "dml_cas_status",
    """SELECT file_id, CASE WHEN status = 'gray' AND length(file_name) % 2 = 0 THEN 'green'
                            ELSE status END AS status FROM files""",
)
def dml_cas_status(spark, d):
    files = bind.files(spark, d)
    asked = files.where(F.length("file_name") % 2 == 0)
    return dml.swap_status(files, asked, "gray", "green").select("file_id", "status")


@register(
    "dml_status_lifecycle",
    """SELECT doc_id, CASE WHEN lang = 'de' OR n_chars < 100 THEN 'red'
                           WHEN source = 'src3' THEN 'yellow' ELSE 'green' END AS status
       FROM documents""",
)
def dml_status_lifecycle(spark, d):
    parsed, embedded = F.col("lang") != "de", F.col("n_chars") >= 100
    status = dml.stage_status(parsed, embedded, F.col("source") != "src3")
    return bind.table(spark, d, "documents").select("doc_id", status.alias("status"))


@register(
    "dml_delete_vectors",
    """SELECT file_id, chunk_idx FROM vectors
       WHERE file_id NOT IN (SELECT file_id FROM files WHERE status = 'red')""",
)
def dml_delete_vectors(spark, d):
    gone = bind.files(spark, d).where("status = 'red'")
    return dml.delete_vectors(bind.vectors(spark, d), gone).select("file_id", "chunk_idx")


@register(
    "dml_delete_partition",
    """SELECT file_id, chunk_idx FROM vectors WHERE file_id NOT IN (
         SELECT file_id FROM vectors WHERE kb_id IN (SELECT kb_id FROM kbs WHERE deleted = 1))""",
)
def dml_delete_partition(spark, d):
    gone = bind.kbs(spark, d).where("deleted = 1")
    return dml.delete_kb_vectors(bind.vectors(spark, d), gone).select("file_id", "chunk_idx")


@register(
    "dml_clean_status",
    """SELECT file_id, file_name FROM live_files WHERE status = 'gray'
         AND kb_id IN (SELECT kb_id FROM kbs WHERE deleted = 0 AND user_id = 'u2')""",
)
def dml_clean_status(spark, d):
    events = dml.clean_by_status(bind.files(spark, d), bind.kbs(spark, d), "gray", "u2", LAST)
    return events.select("file_id", "file_name")


# --- sinks ----------------------------------------------------------------------


@register(
    "snk_vectors",
    """SELECT c.user_id, c.file_id, c.chunk_idx, c.content FROM chunks c
       JOIN vectors v ON v.file_id = c.file_id AND v.chunk_idx = c.chunk_idx""",
)
def snk_vectors(spark, d):
    path = fresh_path(spark, "vectors")
    sinks.write_vectors(bind.chunks(spark, d), bind.vectors(spark, d), path)
    return sinks.read_vectors(spark, path, 64).select(
        "user_id", "file_id", "chunk_idx", "content"
    )


@register(
    "snk_reload",
    """SELECT file_id, chunk_idx, CASE WHEN ends_with(file_id, '7') THEN 'vector' ELSE 'chunk' END AS lacks
       FROM chunks WHERE ends_with(file_id, '7') <> (chunk_idx = 9)""",
)
def snk_reload(spark, d):
    """Some files have lost their vectors, all have lost their last chunk."""
    vectors = bind.vectors(spark, d).where(~F.col("file_id").endswith("7"))
    chunks = bind.chunks(spark, d).where("chunk_idx < 9")
    return dml.orphans(vectors, chunks).select("file_id", "chunk_idx", "lacks")


@register(
    "snk_catalog",
    """SELECT f.file_id, CASE WHEN u.user_id IS NULL THEN 'invalid user_id, please check...'
              WHEN k.kb_id IS NULL
              THEN 'invalid kb_id, please check [''' || f.kb_id || ''']' ELSE 'success' END AS msg
       FROM (SELECT file_id, kb_id, 'u' || CAST(CAST(file_id AS BIGINT) % 6 AS VARCHAR) AS user_id
             FROM files) f
       LEFT JOIN users u ON u.user_id = f.user_id
       LEFT JOIN kbs k ON k.kb_id = f.kb_id AND k.user_id = f.user_id AND k.deleted = 0""",
)
def snk_catalog(spark, d):
    incoming = bind.files(spark, d).select(
        "file_id",
        "kb_id",
        F.concat(F.lit("u"), (F.col("file_id").cast("bigint") % 6).cast("string")).alias("user_id"),
    )
    return catalog.register_files(incoming, bind.kbs(spark, d), bind.users(spark, d)).select(
        "file_id", "msg"
    )


@register(
    "snk_add_events",
    """SELECT f.file_id, f.kb_id, f.file_name, 'gray' AS status, f.file_size
       FROM (SELECT *, 'u' || CAST(CAST(file_id AS BIGINT) % 6 AS VARCHAR) AS user_id FROM files) f
       JOIN users u ON u.user_id = f.user_id
       JOIN kbs k ON k.kb_id = f.kb_id AND k.user_id = f.user_id AND k.deleted = 0""",
)
def snk_add_events(spark, d):
    """Accepted files as add events, appended to a log and read back as state."""
    incoming = bind.files(spark, d).select(
        "file_id", "kb_id", "file_name", "timestamp", "file_size",
        F.concat(F.lit("u"), (F.col("file_id").cast("bigint") % 6).cast("string")).alias("user_id"),
    )
    accepted = catalog.register_files(incoming, bind.kbs(spark, d), bind.users(spark, d))
    log = versions.file_log(spark, fresh_path(spark, "file-log"))
    log.append(dml.add_file_events(accepted, 1), 1)
    return log.read().select("file_id", "kb_id", "file_name", "status", "file_size")


@register(
    "dml_state_as_of",
    """SELECT file_id, CASE WHEN CAST(file_id AS BIGINT) % 3 = 0 THEN 'green' ELSE status END AS status,
              CASE WHEN CAST(file_id AS BIGINT) % 4 = 1 THEN 7 ELSE file_size END AS file_size,
              CASE WHEN CAST(file_id AS BIGINT) % 10 = 2 THEN 1 ELSE 0 END AS deleted FROM files""",
)
def dml_state_as_of(spark, d):
    """A log of files with a snapshot in it, read as of a change before the last."""
    files = bind.files(spark, d).select("file_id", "kb_id", "file_name", "status", "timestamp", "file_size")
    log = versions.file_log(spark, fresh_path(spark, "file-log"))
    number = F.col("file_id").cast("bigint")
    log.append(dml.file_update_events(files, 1), 1)
    log.append(dml.file_update_events(files.where(number % 3 == 0).select("file_id", F.lit("green").alias("status")), 2), 2)
    log.compact()
    log.append(dml.file_update_events(files.where(number % 4 == 1).select("file_id", F.lit(7).alias("file_size")), 3), 3)
    log.append(dml.delete_file_events(files, files.where(number % 10 == 2), 4), 4)
    log.append(dml.file_update_events(files.select("file_id", F.lit("red").alias("status")), 5), 5)
    return log.read(as_of=4).select("file_id", "status", "file_size", "deleted")


@register(
    "dml_cas_sequence",
    """SELECT f.file_id, coalesce(list_reduce(list_prepend(f.status, c.steps),
                lambda held, step: CASE WHEN held = split_part(step, '>', 1) THEN split_part(step, '>', 2) ELSE held END),
              f.status) AS status
       FROM files f LEFT JOIN (
         SELECT lpad(CAST(user_id % 50 AS VARCHAR), 32, '0') AS file_id,
                list(['green', 'yellow', 'red', 'gray'][event_id % 4 + 1] || '>'
                     || ['green', 'yellow', 'red', 'gray'][CAST(floor(value) AS BIGINT) % 4 + 1] ORDER BY event_id) AS steps
         FROM events GROUP BY 1) c ON c.file_id = f.file_id""",
)
def dml_cas_sequence(spark, d):
    """Ordered conditional changes of status, very many to the same few files."""
    names = F.array(*(F.lit(s) for s in ("green", "yellow", "red", "gray")))
    status = lambda number: F.element_at(names, (number % 4 + 1).cast("int"))
    changes = bind.table(spark, d, "events").select(
        F.lpad((F.col("user_id") % 50).cast("string"), 32, "0").alias("file_id"), F.col("event_id").alias("seq"),
        status(F.col("event_id")).alias("old"), status(F.floor("value")).alias("new"),
    )
    return versions.compose_swaps(bind.files(spark, d).select("file_id", "status"), changes)


@register(
    "dml_delete_marks",
    """SELECT file_id, chunk_idx FROM vectors WHERE CAST(file_id AS BIGINT) % 3 <> 0
         AND kb_id <> 'KB_u1_src1' AND CAST(file_id AS BIGINT) < 900000""",
)
def dml_delete_marks(spark, d):
    """Stored vectors after deletions by file and by base, marked in bitmaps, and a compaction."""
    table = versions.VectorTable(spark, fresh_path(spark, "vector-table"))
    vectors = bind.vectors(spark, d)
    table.append(vectors)
    table.delete(vectors.where(F.col("file_id").cast("bigint") % 3 == 0))
    table.compact(0.3)
    table.delete_kbs(spark.createDataFrame([("KB_u1_src1",)], "kb_id string"))
    return table.read().select("file_id", "chunk_idx")


@register(
    "snk_new_users",
    """SELECT 'u' || CAST(user_id AS VARCHAR) AS user_id, min(event_type) AS user_name
       FROM events WHERE 'u' || CAST(user_id AS VARCHAR) NOT IN (SELECT user_id FROM users)
       GROUP BY user_id""",
)
def snk_new_users(spark, d):
    incoming = bind.table(spark, d, "events").select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("user_id"),
        F.col("event_type").alias("user_name"),
    )
    return catalog.add_users(bind.users(spark, d), incoming)


# --- display --------------------------------------------------------------------


@register(
    "fn_fmt_size",
    """SELECT doc_id, CASE WHEN size < 0 THEN '未知'
              WHEN size < 1024 THEN CAST(size AS VARCHAR) || 'B'
              WHEN size < 1048576 THEN printf('%.2fKB', round(size / 1024.0, 2))
              WHEN size < 1073741824 THEN printf('%.2fMB', round(size / 1048576.0, 2))
              ELSE printf('%.2fG', round(size / 1073741824.0, 2)) END AS shown
       FROM (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN n_chars WHEN 1 THEN n_chars * 1000
                    WHEN 2 THEN n_chars * 10000000 ELSE -1 END AS size FROM documents)""",
)
def fn_fmt_size(spark, d):
    doc, size = F.col("doc_id") % 4, F.col("n_chars")
    scaled = (
        F.when(doc == 0, size).when(doc == 1, size * 1000).when(doc == 2, size * 10000000)
        .otherwise(-1)
    )
    return bind.table(spark, d, "documents").select(
        "doc_id", names.display_size(scaled).alias("shown")
    )


@register(
    "fn_fmt_date",
    """SELECT file_id, substring(timestamp, 1, 4) || '-' || substring(timestamp, 5, 2) || '-'
              || substring(timestamp, 7, 2) AS shown FROM files""",
)
def fn_fmt_date(spark, d):
    return bind.files(spark, d).select(
        "file_id", names.display_date(F.col("timestamp")).alias("shown")
    )


@register("fn_now", "SELECT event_id, strftime(ts, '%Y%m%d%H%M') AS stamp FROM events")
def fn_now(spark, d):
    return bind.table(spark, d, "events").select(
        "event_id", names.time_stamp(F.col("ts")).alias("stamp")
    )
