"""From texts of files to chunks, vectors and file events, as one declarative job."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfspark.config import Settings
from shelfspark.functions import names
from shelfspark.functions.text import (
    sentence_pieces,
    title_positions,
    titled_pieces,
    token_split,
)
from shelfspark.models import embed
from shelfspark.operators.dml import stage_status
from shelfspark.operators.scan import explode_rows, fill_forward
from shelfspark.storage import spread, stored

WHOLE_KINDS = ("csv", "xlsx", "pptx", "eml")


def _piece_arrays(raw: DataFrame, cfg: Settings, kind: Column | None) -> DataFrame:
    """``text`` replaced by the array of its sentence pieces, ``pieces``."""
    raw = spread(raw, *(c for c in ("file_id", "part") if c in raw.columns))
    pieces = sentence_pieces(F.col("text"), cfg.sentence_chars)
    if kind is not None:
        pieces = (
            F.when(kind.isin(*WHOLE_KINDS), F.array("text"))
            .when(kind == "pdf", sentence_pieces(F.col("text"), cfg.sentence_chars, pdf=True))
            .otherwise(pieces)
        )
    if "whole" in raw.columns:  # recognised text of pictures, say
        pieces = F.when(F.col("whole"), F.array("text")).otherwise(pieces)
        return raw.withColumn("pieces", pieces).drop("text", "whole")
    return raw.withColumn("pieces", pieces).drop("text")


def split_sentences(
    raw: DataFrame, cfg: Settings = Settings(), kind: Column | None = None
) -> DataFrame:
    """(…, piece_idx, content) from texts (file_id, text): the first split.

    With ``kind``, scanned pages are normalised first and row, slide and mail texts stay
    whole.
    """
    arrays = _piece_arrays(raw, cfg, kind)
    kept = [c for c in arrays.columns if c != "pieces"]
    return explode_rows(arrays.select(*kept, "pieces"), "pieces", "content", "piece_idx")


def last_titles(raw: DataFrame, cfg: Settings = Settings(), kind: Column | None = None) -> DataFrame:
    """(file_id, title) of the last title in the texts of each file that has one."""
    arrays = _piece_arrays(raw, cfg, kind)
    found = arrays.select(
        "file_id",
        F.col("part") if "part" in arrays.columns else F.lit(0).alias("part"),
        F.get("pieces", F.array_max(title_positions(F.col("pieces")))).alias("title"),
    )
    return found.where("title is not null").groupBy("file_id").agg(F.max_by("title", "part").alias("title"))


def _with_titles(arrays: DataFrame, earlier: DataFrame | None = None) -> DataFrame:
    """Pieces as (content, category), titles carried within a text and over the parts.

    Inside a text the pieces are an array of one row, so nothing is shuffled. What a text
    inherits from the parts before it is one title per part, filled forward in blocks. ``earlier``
    (file_id, title) has the titles that files bring along from before.
    """
    located = arrays.withColumn("_titles", title_positions(F.col("pieces")))
    inherited = None
    if "part" in arrays.columns:
        tails = located.select(
            "file_id", "part", F.get("pieces", F.array_max("_titles")).alias("_tail")
        )
        before = (
            fill_forward(tails, ["file_id"], "part", "_tail", "_inherited", inclusive=False)
            .where("_inherited is not null")
            .drop("_tail")
        )
        located = located.join(before, ["file_id", "part"], "left")
        inherited = F.col("_inherited")
    if earlier is not None:
        brought = earlier.select("file_id", F.col("title").alias("_brought"))
        located = located.join(brought, "file_id", "left")
        inherited = F.col("_brought") if inherited is None else F.coalesce(inherited, F.col("_brought"))
    shown = titled_pieces(F.col("pieces"), F.col("_titles"), inherited)
    return located.withColumn("pieces", shown).drop("_titles", "_inherited", "_brought")


def enhance_titles(
    raw: DataFrame, cfg: Settings = Settings(), kind: Column | None = None
) -> DataFrame:
    """(…, piece_idx, content, category) of the first split with titles marked and carried."""
    shown = _with_titles(_piece_arrays(raw, cfg, kind))
    kept = [c for c in shown.columns if c != "pieces"]
    rows = explode_rows(shown.select(*kept, "pieces"), "pieces", "_piece", "piece_idx")
    return rows.select(*kept, "piece_idx", "_piece.content", "_piece.category")


def _part_offsets(sized: DataFrame, block_parts: int = 65536) -> DataFrame:
    """Final texts before each part of a file (file_id, part, _before), zero left out.

    Counts are summed in blocks of parts, so a file with most of the rows (a large table,
    say) is numbered by many tasks.
    """
    earlier = Window.unboundedPreceding, -1
    texts = sized.withColumn("_block", F.floor(F.col("part") / block_parts))
    in_block = Window.partitionBy("file_id", "_block").orderBy("part").rowsBetween(*earlier)
    over_blocks = Window.partitionBy("file_id").orderBy("_block").rowsBetween(*earlier)
    blocks = (
        texts.groupBy("file_id", "_block")
        .agg(F.sum("_n").alias("_n"))
        .select("file_id", "_block", F.sum("_n").over(over_blocks).alias("_blocks_before"))
        .where("_blocks_before > 0")
    )
    before = F.coalesce("_texts_before", F.lit(0)) + F.coalesce("_blocks_before", F.lit(0))
    return (
        texts.withColumn("_texts_before", F.sum("_n").over(in_block))
        .join(blocks, ["file_id", "_block"], "left")
        .select("file_id", "part", before.alias("_before"))
        .where("_before > 0")
    )


def final_texts(
    raw: DataFrame,
    cfg: Settings = Settings(),
    kind: Column | None = None,
    measure=None,
    earlier_titles: DataFrame | None = None,
) -> DataFrame:
    """Both splits of texts (file_id, text): their final texts as arrays, ``_cut``, inside the row
    of a text. Files of several texts have a ``part`` number; their arrays are stored, as they are
    read several times: whatever gives the texts, parsers say, runs once."""
    arrays = _piece_arrays(raw, cfg, kind)
    pieces = F.col("pieces")
    if cfg.title_enhance:
        arrays = _with_titles(arrays, earlier_titles)
        pieces = F.transform("pieces", lambda piece: piece["content"])
    cut = token_split(pieces, cfg.chunk_tokens, cfg.chunk_overlap_tokens, measure)
    texts = arrays.withColumn("_cut", cut).drop("pieces")
    return stored(texts, "texts") if "part" in raw.columns else texts


def number_texts(texts: DataFrame) -> DataFrame:
    """(…, chunk_idx, chunk_id, content) of ``final_texts``, numbered by position: no shuffle. Of
    files of several texts, by ``part`` from zero, counts are added up per file, and only those
    numbers are shuffled."""
    kept = [c for c in texts.columns if c not in ("_cut", "part")]
    start = F.lit(0)
    if "part" in texts.columns:
        sized = texts.select("file_id", "part", F.size("_cut").cast("bigint").alias("_n"))
        texts = texts.join(_part_offsets(sized), ["file_id", "part"], "left")
        start = F.coalesce("_before", F.lit(0))
    numbered = explode_rows(
        texts.select(*kept, start.alias("_start"), "_cut"), "_cut", "content", "_at"
    )
    number = (F.col("_start") + F.col("_at")).cast("int")
    return numbered.select(
        *kept,
        number.alias("chunk_idx"),
        names.chunk_id(F.col("file_id"), number).alias("chunk_id"),
        "content",
    )


def chunk_texts(
    raw: DataFrame,
    cfg: Settings = Settings(),
    kind: Column | None = None,
    measure=None,
    earlier_titles: DataFrame | None = None,
) -> DataFrame:
    """Both splits: (…, chunk_idx, chunk_id, content) from texts (file_id, text)."""
    return number_texts(final_texts(raw, cfg, kind, measure, earlier_titles))


def stamp(chunks: DataFrame, files: DataFrame) -> DataFrame:
    """Chunks with owner, base and shown name: the base name of a path, or the address."""
    is_url = F.col("file_name").rlike(r"\Ahttps?://")
    shown = F.when(is_url, F.col("file_name")).otherwise(names.base_name(F.col("file_name")))
    return chunks.join(
        files.select("file_id", "kb_id", "user_id", shown.alias("file_name")), "file_id"
    )


def ingest(
    raw: DataFrame,
    files: DataFrame,
    model: Callable,
    cfg: Settings = Settings(),
    measure=None,
    store: Callable[[DataFrame], DataFrame] | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(chunks, vectors, outcome) of texts (file_id, text and, if several, part and whole).

    ``files`` has file_id, user_id, kb_id and file_name. ``outcome`` gives per file its
    characters, chunks and status; a file without any text row failed to parse and is red, as
    is one whose model call failed. ``store`` writes vectors and returns the file_ids that are
    in the index then; the other files are yellow. The model runs once per chunk: its vectors
    are stored and all three results are read from there.
    """
    kind = names.parser_kind(F.col("file_name"), F.col("file_name").rlike(r"\Ahttps?://"))
    known = raw.join(files.select("file_id", "file_name"), "file_id").withColumn("_kind", kind)
    readable = known.where(F.col("_kind").isNotNull()).drop("file_name")
    texts = final_texts(readable, cfg, F.col("_kind"), measure).drop("_kind")
    parsed = texts if "part" in raw.columns else readable  # the one that is stored, or leaves out the split
    return embed_and_store(stamp(number_texts(texts), files), files, parsed.select("file_id"), model, cfg, store)


def embed_and_store(
    chunks: DataFrame,
    files: DataFrame,
    parsed: DataFrame,
    model: Callable,
    cfg: Settings = Settings(),
    store: Callable[[DataFrame], DataFrame] | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(chunks, vectors, outcome) of stamped chunks of ``files`` (file_id, kb_id); ``parsed`` has
    the files of which a text could be read. See ``ingest``."""
    embedded = stored(embed(chunks, model, cfg=cfg), "embedded")
    chunks = embedded.select(*chunks.columns)
    failed = embedded.groupBy("file_id").agg(
        F.bool_and(F.col("embedding_error").isNull()).alias("_embedded"),
        F.sum(F.length("content")).alias("content_length"),
        F.count(F.lit(1)).alias("chunk_size"),
    )
    # A file is indexed whole or not at all.
    whole = failed.where("_embedded").select("file_id")
    vectors = embedded.join(whole, "file_id", "left_semi").drop("embedding_error")
    parsed = parsed.select("file_id", F.lit(True).alias("_parsed")).distinct()
    reached = (
        files.select("file_id", "kb_id")
        .join(parsed, "file_id", "left")
        .join(failed, "file_id", "left")
    )
    indexed = F.lit(True)
    if store is not None:
        written = store(vectors).select("file_id", F.lit(True).alias("_indexed")).distinct()
        reached = reached.join(written, "file_id", "left")
        indexed = F.coalesce("_indexed", F.col("chunk_size").isNull())  # no chunk, nothing to write
        vectors = vectors.join(written.select("file_id"), "file_id", "left_semi")
    outcome = (
        reached
        .select(
            "file_id",
            "kb_id",
            F.coalesce("content_length", F.lit(0)).alias("content_length"),
            F.coalesce("chunk_size", F.lit(0)).alias("chunk_size"),
            stage_status(
                F.col("_parsed").isNotNull(), F.coalesce("_embedded", F.lit(True)), indexed
            ).alias("status"),
        )
    )
    return chunks, vectors, outcome
