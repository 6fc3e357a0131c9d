"""Token ids in flat binary files with 64-bit document offsets.

Documents are range-partitioned and sorted by id. The task of a partition encodes its texts in
that order and writes three flat files: ``ids`` (unsigned 16-bit if the vocabulary allows, else
32-bit, little-endian), ``offsets`` (unsigned 64-bit, one per document and one for the end,
counted from the partition's start) and ``docs`` (the ids of the documents, signed 64-bit,
each after a byte that is 0 for a null id). A partition's base, the ids in all partitions
before it, is a prefix sum over one manifest row per partition. Readers map the files into
memory.

A task writes under a name of its own attempt and renames at the end; it writes the same bytes
when it runs again, so executors may be lost at any time.
"""

from __future__ import annotations

import json
import mmap
import os
import re
import uuid
import zlib
from array import array
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfspark.llm.arrow import Memo, held, let_go, slices
from shelfspark.llm.bpe import byte_alphabet
from shelfspark.storage import cut_lineage

#: Unicode's white space, and four controls that Python, but not Unicode, counts to it.
SPACE = " \t\n\r\f\v\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200B)))
CONTROLS = "\x1c\x1d\x1e\x1f"
CHUNK = re.compile(f"[^{SPACE}]+")
MEMO_CHUNKS = 1_000_000
#: Marks that part what stands before them at the end of a run, if the library agrees.
MARKS = ".,!?%$&*#|"
#: The characters that stand for bytes in a vocabulary.
SPELLED = dict(enumerate(byte_alphabet()))
DOC = np.dtype([("there", "u1"), ("doc_id", "<i8")])
READ_DOCS = 4096


#: Whether a byte is a letter or a mark in Latin-1, whose letters are all composed, and the words
#: of such letters that lose nothing but their case.
LETTER = np.array([chr(c).isalpha() for c in range(256)])
MARK = np.isin(np.arange(256), [ord(m) for m in MARKS])
PLAIN = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")


def runs(text: str) -> list[str]:
    """Runs without white space."""
    return CHUNK.findall(text) if any(c in text for c in CONTROLS) else text.split()


class Known(Memo):
    """Ids of runs, made when first asked for."""

    def __init__(self, most: int, make: Callable[[str], bytes]):
        super().__init__(most)
        self.make = make

    def __missing__(self, run: str) -> bytes:
        return self.keep(run, self.make(run))


class Encoder:
    """Ids of texts by the tokenizers library, which sees each distinct run without white
    space once as long as the memo holds it. The library's rules for a vocabulary of
    words never look beyond such a run; others are encoded as whole texts. If the library also
    lower-cases and parts letters from marks, texts of Latin-1 are put so first, which leaves
    fewer runs, and words of letters go to its model at once."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.type = np.dtype("<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4")
        self.code = "H" if self.type.itemsize == 2 else "I"
        spec = json.loads(self.library.to_str())
        #: What special strings begin with: they are told from texts before these lose their case.
        self.special = {t["content"][:1] for t in spec["added_tokens"]}
        self.model = self.library.model
        self.by_chunk = self._drops_space()
        self.by_core = self.by_chunk and self._parts_marks() and self._models_words()
        self.known = Known(MEMO_CHUNKS, self._run)

    def _ids(self, text: str) -> list[int]:
        return self.library.encode(text, add_special_tokens=False).ids

    def _drops_space(self) -> bool:
        """True if white space vanishes and parts its neighbours."""
        apart = self._ids("a") + self._ids("b") + self._ids("1") + self._ids("!c")
        return all(self._ids(f"a{s}b 1{s}{s}!c") == apart for s in SPACE)

    def _parts_marks(self) -> bool:
        """True if letters lose their case and are parted from marks behind them."""
        letters = [chr(c) for c in range(256) if PLAIN.match(chr(c))]
        if any(self._ids(f"{c}w{c}") != self._ids(f"{c}w{c}".lower()) for c in letters):
            return False
        marks = [m + n for m in MARKS for n in ("", *MARKS)]
        letters = [chr(c) for c in np.flatnonzero(LETTER)]
        if any(self._ids(f"{c}{m}d") != self._ids(c) + self._ids(f"{m}d") for c in letters for m in MARKS):
            return False
        behind = ("", "a", "1", "(", "'s")
        return all(self._ids(f"Word{m}{b}") == self._ids("word") + self._ids(m + b) for m in marks for b in behind)

    def _models_words(self) -> bool:
        """True if a lower-case word's ids are those of its bytes by the model."""
        letters = sorted({chr(c).lower() for c in range(256) if PLAIN.match(chr(c))})
        words = [*letters, *(f"{c}w{d}e{c}" for c, d in zip(letters, letters[1:])), "the", "word", "straße", "été"]
        try:
            return all(self._word(w) == array(self.code, self._ids(w)).tobytes() for w in words)
        except Exception:  # a model that takes no such words
            return False

    def _word(self, word: str) -> bytes:
        spelled = word if word.isascii() else word.encode("utf-8").decode("latin-1").translate(SPELLED)
        return array(self.code, [t.id for t in self.model.tokenize(spelled)]).tobytes()

    def _run(self, run: str) -> bytes:
        if self.by_core and PLAIN.fullmatch(run):
            lower = run.lower()
            return self._word(run) if lower == run else self.known[lower]
        return array(self.code, self._ids(run)).tobytes()

    def _runs(self, text: str) -> list[str]:
        if not self.by_chunk:
            return [text] if text else []
        return runs(self._parted(text) if self.by_core else text)

    def _parted(self, text: str) -> str:
        """A text of Latin-1 in lower case and with blanks between letters and marks; others, and
        those that may hold special strings, as they are."""
        try:
            text.encode("latin-1")  # first, as lower-casing may lead into it
        except UnicodeEncodeError:
            return text
        if any(first in text for first in self.special):
            return text
        codes = np.frombuffer(text.lower().encode("latin-1"), np.uint8)
        behind = np.flatnonzero(LETTER[codes[:-1]] & MARK[codes[1:]]) + 1
        return np.insert(codes, behind, 32).tobytes().decode("latin-1")

    def encode(self, texts: list[str]) -> list[bytes]:
        ids = self.known.__getitem__
        return [b"".join(map(ids, self._runs(t))) for t in texts]


def load(path: str) -> Encoder:
    return held(__name__, path, lambda: Encoder(path))


def _place(uri: str) -> tuple[pa.fs.FileSystem, str]:
    if uri.startswith("file:") or ":" not in uri:
        return pa.fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return pa.fs.FileSystem.from_uri(uri)


def write_token_files(
    docs: DataFrame, path: str, folder: str, end_id: int = 2, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """Writes ``docs`` to new files in ``folder`` and returns the manifest: part, name, n_docs,
    n_tokens, base, doc_base; a row per partition with documents, none for an empty table.

    Each document ends with ``end_id``; a null text has that id alone. Ids stand in ascending
    order, null ids first; rows of one id in order of a hash of their texts, then the texts.
    Other columns are not read. ``folder`` is seen by all executors; ``path`` names the
    vocabulary file, present on each executor.
    """
    ranged = (
        docs.select(
            F.col(id_column).cast("long").alias("doc_id"), F.coalesce(F.col(text_column), F.lit("")).alias("text")
        )
        .withColumn("tie", F.xxhash64("text"))
        .repartitionByRange("doc_id", "tie")
        .sortWithinPartitions("doc_id", "tie", "text")
        .select("doc_id", "text")
    )
    run = uuid.uuid4().hex

    def write(batches):
        files, base = _place(folder)
        task = TaskContext.get()
        name = f"{base}/{run}-{task.partitionId():06d}"
        own = f".{task.taskAttemptId()}"
        encoder = load(path)
        end = np.array([end_id], encoder.type).tobytes()
        outs, n_docs, n_ids = None, 0, 0
        for batch in slices(batches):
            if outs is None:
                files.create_dir(base, recursive=True)
                outs = {kind: files.open_output_stream(f"{name}.{kind}{own}") for kind in ("ids", "offsets", "docs")}
            ids = [i + end for i in encoder.encode(batch.column("text").to_pylist())]
            lengths = np.fromiter(map(len, ids), np.uint64, len(ids)) // encoder.type.itemsize
            outs["ids"].write(b"".join(ids))
            outs["offsets"].write((n_ids + np.cumsum(lengths) - lengths).astype("<u8").tobytes())
            named = np.zeros(len(ids), DOC)
            column = batch.column("doc_id")
            named["there"] = column.is_valid().to_numpy(zero_copy_only=False)
            named["doc_id"] = column.fill_null(0).to_numpy(zero_copy_only=False)
            outs["docs"].write(named.tobytes())
            n_docs, n_ids = n_docs + len(ids), n_ids + int(lengths.sum())
        if outs is None:
            return
        outs["offsets"].write(np.array([n_ids], "<u8").tobytes())
        for kind, out in outs.items():
            out.close()
            files.move(f"{name}.{kind}{own}", f"{name}.{kind}")
        let_go()
        yield pa.RecordBatch.from_pydict(
            {"part": [task.partitionId()], "name": [name.rpartition("/")[2]], "bits": [encoder.type.itemsize * 8], "n_docs": [n_docs], "n_tokens": [n_ids]}
        )

    written = cut_lineage(ranged.mapInArrow(write, "part long, name string, bits long, n_docs long, n_tokens long"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition
    sums = {f"{kind}base": F.coalesce(F.sum(of).over(earlier), F.lit(0)) for kind, of in (("", "n_tokens"), ("doc_", "n_docs"))}
    return written.withColumns(sums)


class TokenFile:
    """The documents of one partition, mapped into memory where the file system allows it."""

    def __init__(self, folder: str, name: str, bits: int):
        files, base = _place(folder)

        def flat(kind, dtype):
            at = f"{base}/{name}.{kind}"
            if isinstance(files, pa.fs.LocalFileSystem):
                with open(at, "rb") as file:
                    return np.frombuffer(mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ), dtype)
            with files.open_input_file(at) as file:
                return np.frombuffer(file.read(), dtype)

        self.ids = flat("ids", f"<u{bits // 8}")
        self.offsets = flat("offsets", "<u8").astype(np.int64)
        self.docs = flat("docs", DOC)

    def __len__(self) -> int:
        return len(self.docs)

    def __getitem__(self, at: int) -> np.ndarray:
        return self.ids[self.offsets[at] : self.offsets[at + 1]]


def read_token_files(manifest: DataFrame, folder: str, with_ids: bool = True) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens, ids_crc32 and, if asked for, the
    ids as little-endian unsigned 32-bit integers; a row per document of the files."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids

    def read(batches):
        for batch in batches:
            for row in batch.to_pylist():
                file = TokenFile(folder, row["name"], row["bits"])
                for first in range(0, len(file), READ_DOCS):
                    at = range(first, min(first + READ_DOCS, len(file)))
                    whole = [file[i].astype("<u4").tobytes() for i in at]
                    named = file.docs[at.start : at.stop]
                    out = {
                        "doc_id": pa.array(named["doc_id"].copy(), mask=named["there"] == 0),
                        "start": file.offsets[at.start : at.stop] + row["base"],
                        "n_tokens": [len(w) // 4 for w in whole],
                        "ids_crc32": [zlib.crc32(w) for w in whole],
                    }
                    yield pa.RecordBatch.from_pydict(out | ({"ids": whole} if with_ids else {}))

    spark = manifest.sparkSession
    parts = max(1, manifest.count())
    return spread_rows(manifest.select("name", "bits", "base"), parts).mapInArrow(read, schema)


def spread_rows(manifest: DataFrame, parts: int) -> DataFrame:
    """About one row of the manifest a task."""
    return manifest.repartition(parts, "name")
