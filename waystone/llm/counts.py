"""Token counts: every distinct pre-token is counted once by the library, and documents sum their pre-tokens' counts."""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from waystone.llm import pieces

#: Tokens above which a document is over the limit.
LIMIT = 2048


def normal(text: str) -> str:
    """NFC, then lower case letter by letter (the library knows no final sigma)."""
    text = unicodedata.normalize("NFC", text)
    return text.replace("Σ", "σ").lower()


def token_counts(docs: DataFrame, tokenizer: str, limit: int = LIMIT) -> DataFrame:
    """Per row of docs: doc_id, n_bytes, n_tokens, over_limit, by the word-ending BPE tokenizer file.

    In each block of documents the distinct pre-tokens are counted once (a worker remembers those of earlier blocks), the
    counts are joined to each document's pre-tokens and summed; ids are never materialised. Special strings inside texts
    count one token each, as the library's default has it. Null and empty texts have 0 tokens; repeated rows are counted
    each; columns other than doc_id and text are not read. There is no exchange, so hot keys and copies do not matter.
    """

    def count(batches):
        _, special = pieces.library(tokenizer, "word")
        memory = pieces.library_memory(tokenizer, "word")
        for batch in batches:
            texts = pieces.text_list(batch.column("text"))
            out = np.zeros(len(texts), np.int64)
            for a, b in pieces.blocks(texts):
                parts, owner, after = pieces.split_special(texts[a:b], special)
                cut = pieces.Cut([normal(t) for t in parts], "word")
                sums = np.bincount(owner[cut.owner], weights=memory.sizes_of(cut), minlength=b - a)
                out[a:b] = sums + np.bincount(owner[after >= 0], minlength=b - a)
            n_bytes = [len(t.encode("utf-8", "surrogatepass")) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(n_bytes, pa.int64()), pa.array(out), pa.array(out > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select("doc_id", "text").mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
