"""Token counts of whole texts with a public tokenizer, lengths only.

The encoder runs in an Arrow function that sends back numbers, never token ids.
Each call of the encoder gets about the same number of bytes, and a long text
is cut where no token can reach across, so the sum of its pieces is the count of
the whole.

Defined results: a null or empty text has 0 bytes and 0 tokens; repeated rows are
counted each by itself; an empty table gives an empty result; a text with no safe
place to cut is encoded whole; other columns of the input are not read, so their
names cannot clash.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_VOCABULARY = "byte_bpe_50k.json"
PIECE_CHARS = 16_384
CALL_BYTES = 1_000_000

#: A letter or digit before a space or line break: every pre-token ends here, since a
#: pre-token takes white space at its start only and no special token holds white space.
SAFE_END = re.compile(r"[^\W_](?=[ \n])")


def pieces(text: str, piece_chars: int = PIECE_CHARS) -> Iterator[str]:
    """Cut a text at safe places, each piece about piece_chars long or longer."""
    start = 0
    while len(text) - start > piece_chars:
        found = SAFE_END.search(text, start + piece_chars)
        if not found:
            break
        yield text[start : found.end()]
        start = found.end()
    yield text[start:]


@functools.cache
def _tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def vocabulary_path(name: str) -> str:
    """Where this machine keeps a public vocabulary; each executor asks for its own."""
    if "/" in name:
        return name
    import public_tokenizers

    return str(public_tokenizers.path(name))


def count_texts(texts: list[str | None], vocabulary: str, piece_chars: int = PIECE_CHARS, call_bytes: int = CALL_BYTES) -> list[int]:
    """Tokens of each text."""
    encode = _tokenizer(vocabulary_path(vocabulary)).encode_batch_fast
    counts, waiting, owners, held = [0] * len(texts), [], [], 0

    def flush() -> None:
        for owner, encoded in zip(owners, encode(waiting, add_special_tokens=False), strict=True):
            counts[owner] += len(encoded)
        waiting.clear()
        owners.clear()

    for row, text in enumerate(texts):
        for piece in pieces(text, piece_chars) if text else ():
            waiting.append(piece)
            owners.append(row)
            held += len(piece) if piece.isascii() else len(piece.encode())
            if held >= call_bytes:
                flush()
                held = 0
    flush()
    return counts


def token_counts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = DEFAULT_VOCABULARY, limit: int = 512, piece_chars: int = PIECE_CHARS, call_bytes: int = CALL_BYTES) -> DataFrame:
    """id_col, n_bytes, n_tokens and over_limit (n_tokens > limit) of every row."""
    rows = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("_text"))
    kind = rows.schema[id_col].dataType.simpleString()

    def count(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                texts = part.column(1).to_pylist()
                tokens = pa.array(count_texts(texts, vocabulary, piece_chars, call_bytes), pa.int64())
                sizes = pc.fill_null(pc.binary_length(part.column(1)), 0).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), sizes, tokens], ["_id", "n_bytes", "n_tokens"])

    counted = rows.mapInArrow(count, f"_id {kind}, n_bytes bigint, n_tokens bigint")
    return counted.select(F.col("_id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
