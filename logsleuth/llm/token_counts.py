"""Token counts: batch encoding inside Arrow functions, lengths only.

A task takes Arrow batches of texts, cuts texts above ``piece_chars`` at safe
boundaries and hands the tokenizer lists of pieces of about ``batch_bytes``
bytes each, so a list of short texts and one long text cost the same memory.
Only the lengths leave the task.  The vocabulary file is read on the driver and
broadcast as bytes (its size is checked against ``max_model_bytes``).

A safe boundary is one space between two ASCII letters.  There the tokenizer
never merges: for a sentencepiece model this is checked in the vocabulary (the
space mark occurs only at the start of a piece or in pieces of marks alone, no
normalisation, a mark is put before the text); the piece after the boundary
starts without the space as the model puts the mark back.  For a tokenizer file
it holds where the pre-tokenizer starts a new word at the space; the space stays
with the piece after it.  Otherwise a text is encoded whole.

Edge cases: null or empty text has 0 bytes and 0 tokens; a text without a safe
boundary is one piece; a very long text is encoded piece by piece and counted
whole; repeated rows are counted each; an empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty, for_arrow

PIECE_CHARS = 1 << 15
BATCH_BYTES = 1 << 20
MAX_MODEL_BYTES = 64 << 20


class Counter:
    """Counts tokens of texts with a vocabulary given as file bytes."""

    def __init__(self, model: bytes, kind: str):
        if kind == "model":
            import sentencepiece

            self.sp = sentencepiece.SentencePieceProcessor(model_proto=model)
            self.safe, self.drop = self._sentencepiece_safe(model), 1
            self.lengths = lambda texts: list(map(len, self.sp.encode(texts, num_threads=1)))
        elif kind == "json":
            import json

            from tokenizers import Tokenizer

            tok = Tokenizer.from_str(model.decode())
            tok.no_truncation()
            tok.no_padding()
            self.lengths = lambda texts: [len(e) for e in tok.encode_batch(texts, add_special_tokens=False)]
            pre = json.dumps(json.loads(model).get("pre_tokenizer") or {})
            self.safe = "ByteLevel" in pre and '"add_prefix_space": true' not in pre
            self.drop = 0
        else:
            raise ValueError(f"unknown tokenizer file type: {kind}")

    def _sentencepiece_safe(self, model):
        # the marks and the dummy prefix, from the model's own behaviour
        pieces = [self.sp.id_to_piece(i) for i in range(self.sp.get_piece_size())]
        if any("▁" in p.lstrip("▁") for p in pieces):
            return False
        probe = [("a b", ["a", "b"]), ("Ab  c", None), (" a", None)]
        one = lambda t: [self.sp.id_to_piece(i) for i in self.sp.encode(t)]
        marks = "".join(one("x")).startswith("▁")
        kept = "".join(one("Ab  c")) == "▁Ab▁▁c" and "".join(one(" a")) == "▁▁a"
        return marks and kept and all(one(t) == sum(map(one, x), []) for t, x in probe if x)

    def pieces(self, text, size):
        """The text cut at safe boundaries into pieces of about ``size`` characters."""
        if len(text) <= size or not self.safe:
            return [text]
        out, start, at = [], 0, size
        while at < len(text):
            m = _BOUNDARY.search(text, max(at - 1, start))
            if not m:
                break
            cut = m.start() + 1  # the space
            out.append(text[start:cut])
            start = cut + self.drop
            at = start + size
        return [*out, text[start:]]


_BOUNDARY = re.compile(r"[A-Za-z] (?=[A-Za-z])")


def count_texts(counter, texts, piece_chars=PIECE_CHARS, batch_bytes=BATCH_BYTES):
    """Token counts of a list of texts, encoded in lists of bounded bytes."""
    counts, part, owner, held = [0] * len(texts), [], [], 0

    def flush():
        for i, n in zip(owner, counter.lengths(part)):
            counts[i] += n
        part.clear()
        owner.clear()

    for i, text in enumerate(texts):
        for p in counter.pieces(text, piece_chars) if text else ():
            part.append(p)
            owner.append(i)
            held += len(p) if p.isascii() else len(p.encode("utf-8", "surrogatepass"))
            if held >= batch_bytes:
                flush()
                held = 0
    if part:
        flush()
    return counts


def token_counts(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
                 limit: int = 4096, piece_chars: int = PIECE_CHARS, batch_bytes: int = BATCH_BYTES,
                 max_model_bytes: int = MAX_MODEL_BYTES) -> DataFrame:
    """One row per document: ``id_col``, ``n_bytes`` (UTF-8), ``n_tokens``,
    ``over_limit`` (more than ``limit`` tokens)."""
    with open(tokenizer_path, "rb") as f:
        data = f.read(max_model_bytes + 1)
    if len(data) > max_model_bytes:
        raise ValueError(f"the tokenizer file is above {max_model_bytes} bytes")
    kind = tokenizer_path.rpartition(".")[2]
    model = docs.sparkSession.sparkContext.broadcast(data)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        counter = None
        for batch in batches:
            if counter is None:
                counter = Counter(model.value, kind)
            ends = np.cumsum(batch.column(2).to_numpy())
            counts, lo = [], 0
            while lo < batch.num_rows:  # some texts at a time: as many as fit the bytes, one at least
                hi = int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + 4 * batch_bytes, side="right"))
                hi = max(hi, lo + 1)
                counts += count_texts(counter, batch.column(1).slice(lo, hi - lo).to_pylist(), piece_chars, batch_bytes)
                lo = hi
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(counts, pa.int64())],
                                             ["id", "n_bytes", "n_tokens"])

    text = text_or_empty(text_col)
    src = for_arrow(docs, F.col(id_col).alias("id"), text.alias("text"),
                      F.octet_length(text).cast("long").alias("n_bytes"))
    kind_ = src.schema["id"].dataType.simpleString()
    return (src.mapInArrow(run, f"id {kind_}, n_bytes long, n_tokens long")
               .select(F.col("id").alias(id_col), "n_bytes", "n_tokens",
                       (F.col("n_tokens") > limit).alias("over_limit")))
