"""Token counts without token ids.

A text is a bag of pre-tokens: no piece of the model spans the place where a blank follows
another character, nor holds a character that is in no piece, so texts may be cut there and
the pieces of the parts counted apart. Pieces are counted once per distinct pre-token, joined
to the frequencies of the pre-tokens in each document, and summed.

The distinct pre-tokens are those a task has met: the join needs no shuffle. (A table of all
pre-tokens of the corpus would have to be joined with about as many rows as there are words.)
"""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark.llm.arrow import Memo, held, map_texts

BLANK = "▁"  # stands for a blank inside pieces
MEMO_PRETOKENS = 400_000


class PieceCounter:
    """Counts the pieces of a BPE model that marks blanks in front of words."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        if any(BLANK in piece.lstrip(BLANK) for piece in pieces):
            raise ValueError(f"{path} has pieces with a blank after another character")
        # A line end in no piece is spelled in bytes and parts its neighbours.
        self.parts_lines = not any("\n" in piece for piece in pieces)
        ends = "\n" if self.parts_lines else ""
        self.pattern = re.compile(f"{BLANK}+[^{BLANK}{ends}]*|[^{BLANK}{ends}]+" + ("|\n+" if ends else ""))
        self.pieces = Memo(MEMO_PRETOKENS)

    def count_pieces(self, pretokens: list[str]) -> list[int]:
        """Pieces of each pre-token. The model puts a blank in front of any text, so the first
        blank is left to it; other pre-tokens are counted behind a line end."""
        led = [p[1:].replace(BLANK, " ") if p[0] == BLANK else "\n" + p for p in pretokens]
        counts = map(len, self.model.encode(led, num_threads=1))
        return [(n or 1) if p[0] == BLANK else n - 2 for p, n in zip(pretokens, counts)]

    def frequencies(self, text: str) -> Counter:
        return Counter(self.pattern.findall(BLANK + text.replace(" ", BLANK))) if text else Counter()

    def count(self, texts: list[str]) -> list[int]:
        bags = [self.frequencies(t) for t in texts]
        known = self.pieces
        missing = list({p for bag in bags for p in bag if p not in known})
        fresh = dict(zip(missing, self.count_pieces(missing)))
        counts = [sum([n * (known[p] if p in known else fresh[p]) for p, n in bag.items()]) for bag in bags]
        for pretoken, pieces in fresh.items():
            known.keep(pretoken, pieces)
        return counts


def load(path: str) -> PieceCounter:
    return held(__name__, path, lambda: PieceCounter(path))


def token_counts(
    docs: DataFrame, path: str, limit: int = 4096, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens and over_limit (more than ``limit`` tokens) of each row.

    No begin, end or other special tokens are added and none are read from a text. A null text
    counts as empty, with no bytes and no tokens. A row per input row, repeated rows included;
    other columns are not read. ``path`` names the model file, present on each executor.
    """

    def of(batch):
        texts = [t or "" for t in batch.column("text").to_pylist()]
        return {"doc_id": batch.column("doc_id"), "n_bytes": [len(t.encode("utf-8")) for t in texts], "n_tokens": load(path).count(texts)}

    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    counted = map_texts(rows, of, f"doc_id {kind}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
