import tracemalloc

import pyarrow as pa
from pyspark.sql import functions as F

from shelfspark.llm import bpe, ngram_join
from shelfspark.llm.queries import tokenizer


def test_memos_of_words_are_small():
    encoder = bpe.WordBpe(tokenizer("word_bpe_49k.json"))
    words = ["".join(chr(97 + (n * 7919 >> 3 * i) % 26) for i in range(9)) + chr(97 + n % 26) for n in range(20_000)]
    text = " ".join(words)
    tracemalloc.start()
    try:
        encoder.encode(text)
        held = tracemalloc.get_traced_memory()[0]
    finally:
        tracemalloc.stop()
    assert held < 300 * len(set(words))


def test_stored_rows_reach_python_in_small_batches(spark):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    rows = spark.range(0, 4000, 1, 1).select("id", F.repeat(F.lit("x"), 10_000).alias("text"))

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"rows": [batch.num_rows], "bytes": [batch.column("text").nbytes]})

    got = ngram_join._stored(rows.mapInArrow(sizes, "rows long, bytes long"), "sizes").agg(F.sum("rows"), F.max("bytes")).first()
    assert got[0] == 4000 and got[1] < 8 << 20
    long = spark.range(0, 3, 1, 1).select("id", F.repeat(F.lit("x"), 9 << 20).alias("text"))
    assert ngram_join._stored(long.mapInArrow(sizes, "rows long, bytes long"), "sizes").agg(F.sum("rows")).first()[0] == 3
    assert spark.conf.get(name, None) == before
