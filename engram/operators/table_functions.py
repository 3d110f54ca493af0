"""Chunking as a table function, for SQL."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn

from ..functions.tokens import VOCABULARY, counter
from .chunking import MAX_TOKENS, by_sentence, pack

#: Bytes of segments that are packed at once; what stands in the open chunk waits for the next ones.
BLOCK = 1 << 20


class PackChunks:
    """pack_chunks(TABLE(t), keys, ordering, text [, joint, max_tokens, vocabulary]): (keys..., chunk_index, chunk, n_tokens).

    `keys` and `ordering` are comma-separated columns of t. The segments `text` of
    each key are joined in order by `joint`, while a chunk stays within
    `max_tokens`; a longer segment is divided as in `chunking.packed`, which this
    equals. Null segments count for nothing, and a key without others gives one
    empty chunk. Chunks leave as they close: no key is held whole. `vocabulary` ''
    counts a token for every four characters.
    """

    @staticmethod
    def analyze(t: AnalyzeArgument, keys: AnalyzeArgument, ordering: AnalyzeArgument, text: AnalyzeArgument, joint: AnalyzeArgument | None = None, max_tokens: AnalyzeArgument | None = None, vocabulary: AnalyzeArgument | None = None) -> AnalyzeResult:
        names, order = ([c.strip() for c in a.value.split(",") if c.strip()] for a in (keys, ordering))
        missing = [c for c in [*names, *order, text.value] if c not in t.dataType.names]
        if missing or not names:
            raise ValueError(f"pack_chunks needs keys, an ordering and a text of the table; not there: {missing}")
        schema = StructType([*[t.dataType[c] for c in names], StructField("chunk_index", IntegerType()), StructField("chunk", StringType()), StructField("n_tokens", LongType())])
        return AnalyzeResult(schema, partitionBy=[PartitioningColumn(c) for c in names], orderBy=[OrderingColumn(c) for c in order])

    def __init__(self):
        self.key, self.open, self.size, self.n = None, [], 0, 0

    def eval(self, t, keys: str, ordering: str, text: str, joint: str = "\n", max_tokens: int = MAX_TOKENS, vocabulary: str = VOCABULARY) -> Iterator[tuple]:
        if self.key is None:
            self.key = tuple(t[c.strip()] for c in keys.split(",") if c.strip())
            self.joint, self.limit, self.tokens = joint, max_tokens, counter(vocabulary or None)
            self.divide = by_sentence(self.tokens, max_tokens)
        if t[text] is not None:
            self.open.append(t[text])
            self.size += len(t[text].encode("utf-8", "replace"))
        if self.size >= BLOCK:
            yield from self._close(all_=False)

    def _close(self, all_: bool) -> Iterator[tuple]:
        chunks = pack(self.open, self.joint, self.limit, self.tokens, self.divide)
        last = self.open[-1] if self.open else ""
        rest = []
        if chunks and not all_ and (len(last.encode("utf-8", "replace")) <= self.limit or self.tokens.count(last) <= self.limit):
            rest = [chunks.pop()]  # still open; what was divided stands apart and isn't
        self.open, self.size = rest, sum(len(r.encode("utf-8", "replace")) for r in rest)
        for chunk in chunks:
            yield *self.key, self.n, chunk, self.tokens.count(chunk)
            self.n += 1

    def terminate(self) -> Iterator[tuple]:
        if self.key is None:
            return
        yield from self._close(all_=True)
        if self.n == 0:
            yield *self.key, 0, "", 0


def register(spark: SparkSession) -> None:
    """Make `pack_chunks` known to the session's SQL."""
    spark.udtf.register("pack_chunks", udtf(PackChunks))
