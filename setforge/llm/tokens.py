"""Token counts by batch encoding in Arrow functions that return lengths only.

Batches handed to the tokenizer are balanced by bytes (``batch_bytes``), not by rows. A text longer than ``split_chars``
is encoded in parts cut at safe boundaries: between a letter and a single space that a letter follows. The byte-level
pre-tokenizer ends a token at every such place, so the counts of the parts add up to the count of the whole; a text
without such a place stays whole, and so does every text where the tokenizer is not a plain byte-level one.

Defined results: null text counts as empty (0 bytes, 0 tokens); repeated rows are counted each; an empty table gives an
empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import json
import os
import re
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Letter, space, letter: only letters assigned long ago, so that every Unicode version agrees.
_SAFE = re.compile(r"(?<=[A-Za-zÀ-ÖØ-öø-ÿ]) (?=[A-Za-zÀ-ÖØ-öø-ÿ])")


@dataclass(frozen=True)
class CountParams:
    """A tokenizer file: a path, or the name of a file of the installed vocabulary package."""

    tokenizer: str = "byte_bpe_50k.json"
    limit: int = 512
    batch_bytes: int = 1 << 19
    split_chars: int = 1 << 16


def vocabulary(name: str) -> str:
    if os.path.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=4)
def load(name: str):
    """The tokenizer, once for each Python worker."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    path = vocabulary(name)
    if path.endswith(".model"):
        import sentencepiece

        return sentencepiece.SentencePieceProcessor(model_file=path)
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return tok


def is_plain(tok) -> bool:
    """Whether a tokenizer (a library object) is a plain byte-level one, for which ``parts`` are safe."""
    if not hasattr(tok, "to_str"):
        return False
    if any(_SAFE.search(t.content) for t in tok.get_added_tokens_decoder().values()):
        return False
    kind = json.loads(tok.to_str())
    pre = kind["pre_tokenizer"] or {}
    return kind["model"]["type"] == "BPE" and kind["normalizer"] is None and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)


@lru_cache(maxsize=4)
def cuts(name: str) -> bool:
    """Whether long texts may be cut for this tokenizer file."""
    return is_plain(load(name))


def parts(text: str, split_chars: int) -> list[str]:
    """The text cut at the first safe boundary after every ``split_chars`` characters."""
    out, at = [], 0
    while len(text) - at > split_chars and (m := _SAFE.search(text, at + split_chars)):
        out.append(text[at : m.start()])
        at = m.start()
    out.append(text[at:])
    return out


def counter(p: CountParams):
    """A function from a list of texts to their token counts."""
    tok = load(p.tokenizer)
    if p.tokenizer.endswith(".model"):
        return lambda texts: [len(x) for x in tok.encode(texts, num_threads=1)]
    return lambda texts: [len(x) for x in tok.encode_batch_fast(texts, add_special_tokens=False)]


def count_batch(texts: list[str], p: CountParams, count) -> list[int]:
    """Token counts of the texts, encoded in batches of about ``batch_bytes``."""
    totals = [0] * len(texts)
    owners, batch, size = [], [], 0

    def flush():
        nonlocal owners, batch, size
        for k, n in zip(owners, count(batch), strict=True):
            totals[k] += n
        owners, batch, size = [], [], 0

    whole = not cuts(p.tokenizer)
    for k, text in enumerate(texts):
        for part in [text] if whole else parts(text, p.split_chars):
            if part:
                owners.append(k)
                batch.append(part)
                size += len(part.encode())
                if size >= p.batch_bytes:
                    flush()
    if batch:
        flush()
    return totals


def token_counts(docs: DataFrame, p: CountParams = CountParams()) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every document."""

    def run(batches):
        count = counter(p)
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                texts = [t or "" for t in batch.column(1).to_pylist()]
                tokens = count_batch(texts, p, count)
                sizes = [len(t.encode()) for t in texts]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64()), pa.array([n > p.limit for n in tokens], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op7_token_counts(spark, sf_dir: str) -> DataFrame:
    from setforge.llm.common import table

    return token_counts(table(spark, sf_dir, "documents"))
