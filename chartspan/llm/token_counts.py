"""Token counts through a digest cache (operator 1)."""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartspan.llm.common import text_or_empty, written

#: Texts that a worker hands to the tokenizer at once; bounds the token lists in memory.
CHUNK = 64


def tokenizer_digest(path: str) -> str:
    """Names a tokenizer's version: SHA-256 of the vocabulary file and the rules of counting."""
    with open(path, "rb") as f:
        return hashlib.sha256(b"plain-v1\0" + f.read()).hexdigest()


@functools.lru_cache(4)
def _counter(path: str):
    """texts -> counts, without begin, end or added special tokens, truncation or padding."""
    if path.endswith(".model"):
        import sentencepiece

        encode = sentencepiece.SentencePieceProcessor(model_file=path).encode
        return lambda texts: [len(x) for x in encode(texts, num_threads=1)]
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return lambda texts: [len(x.ids) for x in tokenizer.encode_batch(texts, add_special_tokens=False)]


def count_misses(texts: DataFrame, tokenizer_path: str) -> DataFrame:
    """(digest, _text) -> (digest, n_tokens), by the library on whole texts. The vocabulary file is there on every executor."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counter = _counter(tokenizer_path)
        for pdf in batches:
            values = pdf["_text"].tolist()
            counts = [n for at in range(0, len(values), CHUNK) for n in counter(values[at : at + CHUNK])]
            yield pd.DataFrame({"digest": pdf["digest"], "n_tokens": pd.Series(counts, dtype="int64")})

    return texts.mapInPandas(count, "digest string, n_tokens long")


def count_tokens(docs: DataFrame, tokenizer_path: str, cache_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096) -> DataFrame:
    """One row per document: id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    The cache is a Parquet table of (digest, n_tokens), one folder per tokenizer version. The digest is SHA-256 of the content,
    normalised no further than the tokenizer allows counts to stay exact: a null text becomes the empty one. Distinct digests
    that the cache lacks are encoded once each and appended; then all documents, repeated ones too, get their count by a join.
    Null ids and repeated rows stay. A very long text is encoded whole, by one worker. Other columns are ignored. An empty table gives
    no rows. What is written and joined is of this run's digests alone, however large the cache.
    """
    spark, cache = docs.sparkSession, f"{cache_path}/{tokenizer_digest(tokenizer_path)}"
    hashed = docs.select(F.col(id_col), text_or_empty(text_col).alias("_text")).withColumn("digest", F.sha2(F.encode("_text", "UTF-8"), 256))
    schema = "digest string, n_tokens long"
    spark.createDataFrame([], schema).write.mode("append").parquet(cache)  # so that the folder is there
    sizes = written(hashed.select(id_col, F.octet_length("_text").cast("long").alias("n_bytes"), "digest"), "token-digests")  # texts are hashed for it once, and once for the misses
    cached = spark.read.schema(schema).parquet(cache)
    # writers at a time may both have appended a digest
    known = written(cached.join(sizes.select("digest").distinct(), "digest", "left_semi").groupBy("digest").agg(F.max("n_tokens").alias("n_tokens")), "token-hits")
    misses = hashed.select("digest", "_text").dropDuplicates(["digest"]).join(known.select("digest"), "digest", "left_anti")
    found = written(count_misses(misses, tokenizer_path), "token-misses")
    found.write.mode("append").parquet(cache)
    # plain sides, so that a digest that many rows share can be split
    return sizes.join(known.unionByName(found), "digest").select(id_col, "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
