"""Packing by power-of-two decomposition: no sequence ever crosses documents.

A document's token ids are cut into pieces whose lengths are powers of two: as many of the longest as fit, then the binary digits
of the rest from the highest down. Pieces of equal length form a bucket; each piece is a sequence of its own, exactly full, so
nothing is padded. Sequences are numbered bucket by bucket, longest first, and by document inside a bucket.
"""

from __future__ import annotations

import os
import unicodedata
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyweave.llm import common as C
from tallyweave.llm.token_counts import byte_symbols

CUT = "doc_id long, doc_tokens long, pieces array<struct<start:long,length:long,ids_crc32:long>>"
PIECE = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
CUT_ARROW = pa.schema([("doc_id", pa.int64()), ("doc_tokens", pa.int64()), ("pieces", pa.list_(PIECE))])
#: Words whose ids a worker keeps (twice, see ``_ids``), and the longest of them in bytes.
CACHED, CACHED_BYTES = 150_000, 64
#: Bytes of text whose new words are looked up together.
TEXT_BYTES = 2 << 20
#: Documents that one task numbers.
NUMBERED = 100_000
#: Punctuation that the tokenizer parts from a letter before it.
_TAIL = b".,!?;:"
_SYMBOLS = byte_symbols()
_TOKENIZERS: dict[str, tuple] = {}


def _tokenizer(name: str) -> tuple:
    """A worker's tokenizer and the ids of words it has seen, as little-endian 32-bit: those of late, and those of before."""
    if name not in _TOKENIZERS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _TOKENIZERS[name] = (Tokenizer.from_file(public_tokenizers.path(name)), {}, {})
    return _TOKENIZERS[name]


def _words(text: bytes) -> list[bytes]:
    """Parts between ASCII white space, which the tokenizer drops and no token crosses. Letter case is not kept by the tokenizer;
    only its special tokens tell it apart."""
    return (text if b"<|" in text else text.lower()).split()


def _word_ids(word: bytes, tokenizer, cache: dict[bytes, bytes]) -> bytes:
    """Ids of one word. Punctuation after a letter is a part by itself, so it is cut off and both parts looked up. A part that is
    letters in the form the tokenizer would bring it to goes straight to its merges."""
    base = word.rstrip(_TAIL)
    if base and len(base) < len(word) and 97 <= base[-1] <= 122 and b"<|" not in word:
        for part in (base, word[len(base) :]):
            if part not in cache:
                cache[part] = _word_ids(part, tokenizer, cache)
        return cache[base] + cache[word[len(base) :]]
    text = word.decode(errors="replace")
    if text.isalpha() and text == text.lower() and unicodedata.is_normalized("NFC", text):
        return np.array([t.id for t in tokenizer.model.tokenize(word.decode("latin-1").translate(_SYMBOLS))], "<u4").tobytes()
    return np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def _ids(texts: list[bytes], name: str) -> list[bytes]:
    tokenizer, cache, former = _tokenizer(name)
    if len(cache) > CACHED:
        # Words of late become those of before; a word in use comes back from there, others are forgotten at the next turn.
        cache, former = {}, cache
        _TOKENIZERS[name] = tokenizer, cache, former
    split = [_words(t) for t in texts]
    more = {}
    for word in {w for words in split for w in words if w not in cache}:
        if len(word) > CACHED_BYTES:
            more[word] = _word_ids(word, tokenizer, {})
        elif word in former:
            cache[word] = former[word]
        else:
            cache[word] = _word_ids(word, tokenizer, cache)
    if more:
        both = lambda w: cache[w] if w in cache else more[w]
        return [b"".join(map(both, words)) for words in split]
    return [b"".join(map(cache.__getitem__, words)) for words in split]


def binary_pieces(n: int, longest: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` tokens; ``longest`` is a power of two."""
    pieces = [(i * longest, longest) for i in range(n // longest)]
    at = n // longest * longest
    while at < n:
        size = 1 << ((n - at).bit_length() - 1)
        pieces.append((at, size))
        at += size
    return pieces


def cut_documents(docs: DataFrame, tokenizer: str, longest: int, end_id: int) -> DataFrame:
    """doc_id, doc_tokens, pieces: each document's ids, and the end after them, cut into powers of two."""

    def cut(batches):
        for batch in C.small(batches, limit=TEXT_BYTES):
            texts = [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]
            end = np.array([end_id], "<u4").tobytes()
            rows = []
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), _ids(texts, tokenizer), strict=True):
                view = memoryview(ids + end)
                pieces = [{"start": s, "length": n, "ids_crc32": zlib.crc32(view[4 * s : 4 * (s + n)])} for s, n in binary_pieces(len(view) // 4, longest)]
                rows.append({"doc_id": doc_id, "doc_tokens": len(view) // 4, "pieces": pieces})
            yield from pa.Table.from_pylist(rows, schema=CUT_ARROW).to_batches()

    return C.plain(docs, "doc_id", "text").mapInArrow(C.giving_back(cut), CUT)


def pack_documents(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", max_tokens: int = 2048, end_id: int = 1) -> DataFrame:
    """Sequences of at most ``max_tokens`` tokens; each holds one piece of one document and is exactly full.

    docs: doc_id, text (null: empty). ``tokenizer``: a file of the public tokenizers that drops white space and letter case. A
    document is its ids without special tokens added, then ``end_id``; even an empty one has that id.

    Returns a row per piece: doc_id, start (ids before it), length (a power of two), ids_crc32 (of its little-endian 32-bit ids),
    doc_tokens, sequence_id (0 and up without gaps, by length from long to short, then by document), offset (always 0). Rows that
    share a doc_id, or have none, are documents of their own. Further columns are ignored.
    """
    longest = 1 << (max_tokens.bit_length() - 1)
    cut = C.stored(cut_documents(docs, tokenizer, longest, end_id), "packing")
    n = max(1, -(-cut.count() // NUMBERED))
    key = F.when(F.col("doc_id").isNull(), F.xxhash64("pieces")).otherwise(F.xxhash64("doc_id"))
    pieces = cut.select("doc_id", "doc_tokens", F.pmod(key, F.lit(n)).alias("part"), F.inline("pieces"))
    # Sequences of a length in the parts before, by a running sum over one row for each length and part.
    counts = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.orderBy(F.desc("length"), "part").rowsBetween(Window.unboundedPreceding, -1))
    before = counts.select(F.col("length").alias("of_length"), F.col("part").alias("of_part"), F.coalesce(before, F.lit(0)).alias("before"))
    rank = F.row_number().over(Window.partitionBy("length", "part").orderBy("doc_id", "start", "doc_tokens", "ids_crc32"))
    joined = pieces.withColumn("rank", rank).join(before, (F.col("length") == F.col("of_length")) & (F.col("part") == F.col("of_part")))
    return joined.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("before") + F.col("rank") - 1).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
