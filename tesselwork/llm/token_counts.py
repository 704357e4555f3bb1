"""Token counts of fields and sections by offset-mapped attribution.

A document's fields are joined and encoded once, as a whole.  A byte-level encoding loses
nothing, so a running sum of token lengths gives each token's span; the spans are joined to
the section intervals by binary search, and tokens that cross a boundary go by a stated rule."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import bounded_batches, lean

#: Ranks of a byte-level vocabulary (base64 token and rank a line), read on the driver only.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pre-tokenisation pattern that belongs to that vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: majority: the section with most of the token's bytes, the earliest on a tie;
#: start: the section of its first byte; split: each section its share of the bytes.
RULES = ("majority", "start", "split")


def attribute(lengths: np.ndarray, ends: np.ndarray, rule: str = "majority") -> tuple[np.ndarray, int]:
    """Tokens of each section, and how many tokens cross a boundary.

    lengths: bytes of each token; ends: ascending ends of the sections, the last one the end
    of the text.  Empty sections get none."""
    stop = np.cumsum(lengths)
    start = stop - lengths
    first = np.searchsorted(ends, start, "right")
    last = np.searchsorted(ends, stop - 1, "right")
    whole = first == last
    out = np.bincount(first[whole], minlength=len(ends)).astype(np.float64)
    for i in np.flatnonzero(~whole).tolist():
        sections = np.arange(first[i], last[i] + 1)
        begin = np.maximum(np.where(sections > 0, ends[np.maximum(sections - 1, 0)], 0), start[i])
        part = np.minimum(ends[sections], stop[i]) - begin
        if rule == "split":
            out[sections] += part / lengths[i]
        else:
            out[sections[0] if rule == "start" else sections[int(np.argmax(part))]] += 1
    return out, int(np.count_nonzero(~whole))


def token_counts(docs: DataFrame, fields: tuple[str, ...] = ("text",), sections: str = "lines", rule: str = "majority", tokenizer: str = TOKENIZER, pattern: str = PATTERN, id: str = "doc_id") -> DataFrame:
    """Per row of docs: doc_id, n_bytes, n_tokens, n_sections, n_crossing, section_tokens.

    The fields (nulls as empty) are joined by line breaks.  sections: "lines" cuts the whole
    after each line break, "fields" after each field's.  A document of empty fields has one
    section or one per field, and no tokens but those of the breaks between fields.  The sum
    of section_tokens is n_tokens under every rule."""
    if rule not in RULES or sections not in ("lines", "fields"):
        raise ValueError("unknown rule or sections")
    spark = docs.sparkSession
    bounded_batches(spark)
    with open(tokenizer, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    shared = spark.sparkContext.broadcast(ranks)
    names = [f"_f{i}" for i in range(len(fields))]
    source = docs.select(F.col(id).alias("doc_id"), *[F.col(c).cast("string").alias(n) for c, n in zip(fields, names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        ranks = shared.value
        encoding = tiktoken.Encoding("shared", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        size = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            size[rank] = len(token)
        for batch in batches:
            out: list[list] = [[] for _ in range(5)]
            for values in zip(*(c.to_pylist() for c in batch.columns[1:])):
                values = [v or "" for v in values]
                text = "\n".join(values)
                raw = np.frombuffer(text.encode(), np.uint8)
                lengths = size[np.array(encoding.encode_ordinary(text), np.int64)]
                if sections == "lines":
                    ends = np.append(np.flatnonzero(raw == 10) + 1, len(raw))
                else:
                    ends = np.cumsum([len(v.encode()) + 1 for v in values])
                    ends[-1] = len(raw)
                counts, crossing = attribute(lengths, ends, rule)
                for column, value in zip(out, (len(raw), len(lengths), len(ends), crossing, counts)):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, pa.int64()) for c in out[:4]], pa.array(out[4], pa.list_(pa.float64()))], names=["doc_id", "n_bytes", "n_tokens", "n_sections", "n_crossing", "section_tokens"])

    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(lean(run), f"doc_id {kind}, n_bytes long, n_tokens long, n_sections long, n_crossing long, section_tokens array<double>")
