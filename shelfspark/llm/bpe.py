"""Byte-pair encoding and decoding with a vocabulary file of words with ends.

A pre-token's symbols form a doubly linked list. Every neighbouring pair that may merge lies
in a priority queue by the rank of its merge and then its place; a popped entry whose symbols
have changed meanwhile is stale and skipped. Decoding concatenates vocabulary strings.

The file's steps are followed in order: special strings are cut out of the raw text, the rest
is composed (NFC), white space becomes blanks, characters are lower-cased one by one, the
split pattern finds the pre-tokens, and their bytes are spelled in the byte alphabet.
"""

from __future__ import annotations

import json
import re
import unicodedata
from array import array
from heapq import heapify, heappop, heappush

import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark.llm.arrow import Memo, held, map_texts

#: Runs without ASCII white space: no rule of the file looks beyond them.
CHUNK = re.compile(r"[^ \t\n\r\f\v]+")
#: The characters of Unicode's White_Space property.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: Entries of a worker's memos, which hold ids alone: some 200 bytes for a word of both.
MEMO_CHUNKS, MEMO_WORDS = 250_000, 300_000
#: Text bytes that are encoded at once: ids and decoded text take several times as much.
SLICE_BYTES = 1 << 20
#: Bits for the place in a queue entry, a number made of the merge's rank and the place.
PLACE = 40


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b if b in plain else next(others)) for b in range(256)]


class WordBpe:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, vocab = spec["model"], spec["model"]["vocab"]
        self.strings = {at: string for string, at in vocab.items()}
        self.strings.update({t["id"]: t["content"] for t in spec["added_tokens"]})
        end = self.end = model["end_of_word_suffix"]
        pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
        ranked = [(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs]
        self.left, self.right, self.made = (list(x) for x in zip(*ranked))
        self.merges = {(a, b): rank for rank, (a, b, _) in reversed(list(enumerate(ranked)))}
        alphabet = byte_alphabet()
        self.inner = [vocab[c] for c in alphabet]
        self.ends = {vocab[c]: vocab[c + end] for c in alphabet}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        split = next(s for s in spec["pre_tokenizer"]["pretokenizers"] if s["type"] == "Split")
        pattern = split["pattern"]["Regex"].replace(r"\s", SPACE)
        self.split = regex.compile(pattern)
        # The same for lower-cased ASCII texts, which the standard library scans faster.
        self.ascii = re.compile(pattern.replace(r"\p{L}", "a-z").replace(r"\p{N}", "0-9"), re.ASCII)
        self.words, self.chunks = Memo(MEMO_WORDS), Memo(MEMO_CHUNKS)

    def merge(self, ids: list[int]) -> list[int]:
        """The symbols ``ids`` of one pre-token after all merges."""
        count, rank_of = len(ids), self.merges.get
        queue = []
        for i, pair in enumerate(zip(ids, ids[1:])):
            rank = rank_of(pair)
            if rank is not None:
                queue.append(rank << PLACE | i)
        if not queue:
            return ids
        heapify(queue)
        lefts, rights, mades = self.left, self.right, self.made
        mask = (1 << PLACE) - 1
        before, after = list(range(-1, count - 1)), list(range(1, count + 1))
        while queue:
            entry = heappop(queue)
            i, rank = entry & mask, entry >> PLACE
            j = after[i]
            if ids[i] != lefts[rank] or j == count or ids[j] != rights[rank]:
                continue  # stale
            ids[i] = made = mades[rank]
            ids[j] = -1
            k = after[i] = after[j]
            if k < count:
                before[k] = i
                rank = rank_of((made, ids[k]))
                if rank is not None:
                    heappush(queue, rank << PLACE | i)
            h = before[i]
            if h >= 0:
                rank = rank_of((ids[h], made))
                if rank is not None:
                    heappush(queue, rank << PLACE | h)
        return [i for i in ids if i >= 0]

    def word(self, word: str) -> bytes:
        """Ids (little-endian unsigned 32-bit) of a pre-token."""
        found = self.words.get(word)
        if found is None:
            ids = [self.inner[b] for b in word.encode("utf-8")]
            ids[-1] = self.ends[ids[-1]]
            found = self.words.keep(word, array("I", self.merge(ids)).tobytes())
        return found

    def chunk(self, chunk: str) -> bytes:
        """Ids of a run without ASCII white space."""
        found = self.chunks.get(chunk)
        if found is None:
            parts = []
            for piece in self.cut.split(chunk) if "<" in chunk else (chunk,):
                if piece in self.special:
                    parts.append(array("I", [self.special[piece]]).tobytes())
                elif piece.isascii():
                    lowered = piece.lower()
                    if lowered == chunk:
                        lowered = chunk  # both memos then hold one string
                    parts += map(self.word, (lowered,) if lowered.isalpha() else self.ascii.findall(lowered))
                else:
                    # One by one: a final capital sigma is not special.
                    lowered = unicodedata.normalize("NFC", piece).replace("Σ", "σ").lower()
                    parts += map(self.word, self.split.findall(lowered))
            found = self.chunks.keep(chunk, parts[0] if len(parts) == 1 else b"".join(parts))
        return found

    def encode(self, text: str) -> tuple[bytes, str]:
        """Ids of a whole text as bytes, and the text they decode to."""
        known, make = self.chunks.get, self.chunk
        ids = b"".join([known(c) or make(c) for c in CHUNK.findall(text)])
        return ids, self.decode(memoryview(ids).cast("I"))

    def decode(self, ids) -> str:
        """Vocabulary strings joined by a blank: the file names no decoder that would take
        the word ends and the byte alphabet away."""
        return " ".join(map(self.strings.__getitem__, ids))


def load(path: str) -> WordBpe:
    return held(__name__, path, lambda: WordBpe(path))


def encode_decode(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, ids (binary, little-endian unsigned 32-bit) and decoded text of each row.

    A null text counts as empty and has no ids. A row per input row, repeated rows included;
    other columns are not read. ``path`` names the vocabulary file, present on each executor.
    Nothing is shuffled; memos per task are bounded.
    """

    def of(batch):
        encoder = load(path)
        encoded = [encoder.encode(t or "") for t in batch.column("text").to_pylist()]
        return {"doc_id": batch.column("doc_id"), "ids": [e[0] for e in encoded], "decoded": [e[1] for e in encoded]}

    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return map_texts(rows, of, f"doc_id {kind}, ids binary, decoded string", most=SLICE_BYTES)


def digests(encoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of the rows of ``encode_decode``."""
    return encoded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
