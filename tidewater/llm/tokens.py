"""Token counts without token ids.

A text's token count is the sum, over its distinct pre-tokens, of frequency times number of
pieces. Each block of documents is cut into pre-tokens, and its vocabulary is joined to the piece
counts; a pre-token is encoded once, when first met, and kept for the task's later blocks. The
counts are then joined to the (document, pre-token, frequency) rows of the block and summed, so
memory is bounded by one block and the kept vocabulary (`KEPT` entries), no ids are made, and no
row is shuffled: a shuffle by pre-token would move several times the text's own size.

Strings of special tokens inside a text are one token each, as the library reads them.

Defined results: a null or empty text has 0 bytes and 0 tokens; repeated rows are counted each; a null
id stays null; a very long text is a block of its own; other columns are not read, whatever their names;
an empty table gives an empty result; a file of another kind of vocabulary is refused.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F
from tokenizers import Tokenizer

from tidewater.llm.blocks import flat, row_blocks, texts
from tidewater.llm.storage import bounded

#: The published pre-token pattern of byte-level BPE vocabularies of this kind (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pre-tokens whose piece counts a task keeps; beyond it the table starts anew.
KEPT = 400_000


@lru_cache(maxsize=2)
def _load(path: str) -> tuple[Tokenizer, list[str]]:
    whole = Tokenizer.from_file(path)
    cut = json.loads(whole.to_str())
    kind = cut["pre_tokenizer"] or {}
    if cut["normalizer"] or kind.get("type") != "ByteLevel" or not kind.get("use_regex", True) or kind.get("add_prefix_space"):
        raise ValueError("a byte-level BPE with the published pre-token pattern is needed")
    whole.no_truncation()
    whole.no_padding()
    special = [t.content for t in whole.get_added_tokens_decoder().values()]
    return whole, sorted(special, key=len, reverse=True)


def _count(path: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, special = _load(path)
        cut = regex.compile(PATTERN).findall
        at_special = regex.compile("(" + "|".join(map(regex.escape, special)) + ")") if special else None
        known: dict[str, int] = {}
        for batch in batches:
            for block in row_blocks(batch, "text"):
                _, offsets = flat(block.column(1))
                tokens: list[str] = []
                per_doc, extra = [], []
                for raw in texts(block.column(1)):
                    text, before, found = raw.decode(), len(tokens), 0
                    if at_special and any(s in text for s in special):
                        parts = at_special.split(text)
                        found = len(parts) // 2
                        for part in parts[::2]:
                            tokens += cut(part)
                    else:
                        tokens += cut(text)
                    per_doc.append(len(tokens) - before)
                    extra.append(found)
                coded = pa.array(tokens, pa.string()).dictionary_encode()
                vocabulary = coded.dictionary.to_pylist()
                if len(known) > KEPT:
                    known.clear()
                fresh = [t for t in vocabulary if t not in known]
                for t, e in zip(fresh, encoder.encode_batch_fast(fresh, add_special_tokens=False)):
                    known[t] = len(e)
                pieces = np.array([known[t] for t in vocabulary], np.int64)
                # (document, pre-token) frequencies, then the join by pre-token number.
                n = max(1, len(vocabulary))
                owner = np.repeat(np.arange(len(per_doc)), per_doc)
                pair, frequency = np.unique(owner * n + coded.indices.to_numpy(), return_counts=True)
                weight = pieces[pair % n] * frequency if len(pair) else np.zeros(0)
                total = np.bincount(pair // n, weight, minlength=len(per_doc)).astype(np.int64) + np.array(extra, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [block.column(0).cast(pa.int64()), pa.array(np.diff(offsets), pa.int64()), pa.array(total, pa.int64())],
                    ["doc_id", "n_bytes", "n_tokens"],
                )

    return run


def count_tokens(docs: DataFrame, path: str, limit: int = 512) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, over_limit; path: a byte-level BPE .json."""
    narrow = bounded(docs).select(F.col("doc_id").cast("long"), "text")
    counted = narrow.mapInArrow(_count(path), "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
