"""Source-aware chunking: message groups by thread and author, speaker turns, paragraphs, and packing under a token budget.

Texts are taken apart into segments by column expressions and windows; one
function on arrays of segments packs them, because only the tokenizer can tell
how long a joined text is.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from ..functions.slices import by_slices
from ..functions.text import strip
from ..functions.tokens import VOCABULARY, Counter, counter
from ..sources.jsonl import messages
from .listing import ordered_text

MAX_TOKENS = 3000
CHUNKS = ArrayType(StructType([StructField("chunk_index", IntegerType(), False), StructField("total", IntegerType(), False), StructField("chunk", StringType()), StructField("n_tokens", LongType())]), False)
EMOJI_ONLY = r"(?U)\A\s*[\p{So}\p{Sk}\p{Sm}\x{200d}\x{fe0f}\x{fe0e}]+\s*\z"
LINES = r"\R|[\x1c-\x1e]"
SPEAKER = r"(?U)\A[\[({]?\s*(\w[\w\s]*)[\])}]?\s*:"
AUTHOR = r"(?U)\A(<@\w+>|\w[\w\s]*):\s*(.*)\z"


def estimate_tokens(text: Column | str) -> Column:
    """A token for every four characters."""
    return F.floor(F.char_length(text) / 4)


def author_groups(df: DataFrame, key: str | list[str], order: str, author: str, island: str = "island") -> DataFrame:
    """Number the runs of consecutive rows by one author, from 1."""
    w = Window.partitionBy(key).orderBy(order)
    fresh = (~F.col(author).eqNullSafe(F.lag(author).over(w)) | (F.row_number().over(w) == 1)).cast("bigint")
    return df.withColumn("__fresh", fresh).withColumn(island, F.sum("__fresh").over(w)).drop("__fresh")


def within_budget(df: DataFrame, key: str, order: str, text: str, budget: int) -> DataFrame:
    """The rows of each key before the first that would exceed `budget` tokens; at least one."""
    w = Window.partitionBy(key).orderBy(order)
    used = df.withColumn("__used", F.sum(estimate_tokens(text)).over(w))
    over = used.withColumn("__over", F.max((F.col("__used") > budget).cast("int")).over(w)).withColumn("__n", F.row_number().over(w))
    return over.filter("__over = 0 or __n = 1").drop("__used", "__over", "__n")


def paragraphs(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"\n\n+"), strip), lambda p: p != "")


def sections(text: Column) -> Column:
    return F.split(text, r"\n---+\n")


def hard_split(text: Column, max_tokens: int) -> Column:
    """Pieces of `max_tokens` * 4 characters."""
    size = 4 * max_tokens
    return F.transform(F.sequence(F.lit(0), F.greatest(F.floor((F.char_length(text) - 1) / size), F.lit(0)).cast("int")), lambda i: F.substr(text, i * size + 1, F.lit(size)))


def pack(parts: Iterable[str], joint: str, limit: int, tokens: Counter, divide: Callable[[str], list[str]], trim: bool = True) -> list[str]:
    """Join consecutive parts while they stay within `limit` tokens; a part above it is divided, and its pieces stand apart.

    `trim`: white space around a joined text goes. The joined text is encoded
    once, and the ends of its parts where the limit is near.
    """
    parts = list(parts)
    text = joint.join(parts)
    ragged = trim and any(p != p.strip() or not p for p in parts)
    if not ragged and (not parts or parts[0]) and len(text.encode("utf-8", "replace")) <= limit:  # no token is shorter than a byte
        return [text] * bool(text)
    if ragged:
        return _pack_slowly(parts, joint, limit, tokens, divide, trim)
    measure = tokens.ruler(text)
    done, begin, at = [], None, 0  # the open chunk is text[begin:end]
    end = 0
    for part in parts:
        first, last = at, at + len(part)
        at = last + len(joint)
        if 4 * len(part) > limit and len(part.encode("utf-8", "replace")) > limit and measure(first, last, limit) > limit:
            done += [text[begin:end]] * (begin is not None and end > begin) + divide(part)
            begin = None
            continue
        empty = begin is None or end == begin
        if not empty and measure(begin, last, limit) > limit:
            done.append(text[begin:end])
            empty = True
        if empty:
            begin = first
        end = last
    return done + [text[begin:end]] * (begin is not None and end > begin)


def _pack_slowly(parts: Iterable[str], joint: str, limit: int, tokens: Counter, divide: Callable[[str], list[str]], trim: bool) -> list[str]:
    """The same, joined texts encoded each for itself."""
    fits = lambda t: len(t.encode("utf-8", "replace")) <= limit or tokens.count(t) <= limit
    done, open_ = [], ""
    for part in parts:
        if not fits(part):
            done += [open_] * bool(open_) + divide(part)
            open_ = ""
            continue
        longer = open_ + joint + part if open_ else part
        longer = longer.strip() if trim and open_ else longer
        if open_ and not fits(longer):
            done.append(open_)
            longer = part
        open_ = longer
    return done + [open_] * bool(open_)


def by_sentence(tokens: Counter, max_tokens: int) -> Callable[[str], list[str]]:
    """A text above the budget packed by sentences, and a sentence above it cut between tokens."""
    return lambda t: pack(re.split(r"(?<=[.!?])\s+", t), " ", max_tokens, tokens, lambda s: tokens.pieces(s, max_tokens)) or [t]


def _chunked(cut: Callable[[Counter], Callable], vocabulary: str | None):
    """A column function: the chunks that `cut`, given the counter, makes of a value, as an array of (chunk_index, total, chunk, n_tokens)."""

    def compute():
        tokens = counter(vocabulary)
        divided = cut(tokens)

        def numbered(value) -> list[tuple[int, int, str, int]]:
            chunks = divided(value)
            return [(i, len(chunks), c, tokens.count(c)) for i, c in enumerate(chunks)]

        return lambda values: [numbered(v) for v in values]

    return by_slices(compute, CHUNKS, to_arrow_type(CHUNKS))


def packed_rows(joint: str, max_tokens: int = MAX_TOKENS, vocabulary: str | None = VOCABULARY):
    """A column function on arrays of segments: chunks of at most `max_tokens` tokens, numbered and counted. A segment above that is packed by sentences, and a sentence above it cut between tokens. No segment gives one empty chunk."""

    def cut(tokens: Counter):
        divide = by_sentence(tokens, max_tokens)
        return lambda parts: pack(parts or [], joint, max_tokens, tokens, divide) or [""]

    return _chunked(cut, vocabulary)


def packed(joint: str, max_tokens: int = MAX_TOKENS, vocabulary: str | None = VOCABULARY):
    """The same, the chunks alone."""
    rows = packed_rows(joint, max_tokens, vocabulary)
    return lambda segments: F.transform(rows(segments), lambda c: c["chunk"])


def _numbered(df: DataFrame, key: str, chunks: str, order: list[str]) -> DataFrame:
    """(key, chunk_index, total, chunk, n_tokens) from rows of arrays of chunks; a key has one row, or several in `order`."""
    rows = df.select(key, *order, F.inline_outer(chunks))  # no array is empty; the optimizer runs the function of `inline` twice, for a filter
    if order:
        w = Window.partitionBy(key)
        rows = rows.withColumns({"chunk_index": F.row_number().over(w.orderBy(*order, "chunk_index")) - 1, "total": F.count("*").over(w).cast("int")})
    return rows.select(key, "chunk_index", "total", "chunk", "n_tokens")


def chunk_paragraphs(df: DataFrame, key: str, text: str, max_tokens: int = MAX_TOKENS, vocabulary: str | None = VOCABULARY) -> DataFrame:
    """(key, chunk_index, total, chunk, n_tokens): paragraphs packed with a blank line between; a text without any is one empty chunk."""
    chunks = df.select(key, packed_rows("\n\n", max_tokens, vocabulary)(paragraphs(F.coalesce(F.col(text), F.lit("")))).alias("__chunks"))
    return _numbered(chunks, key, "__chunks", [])


def message_groups(df: DataFrame, key: str, order: str, author: str, text: str, thread: str | None = None) -> DataFrame:
    """(key, thread, first, island, segment): in each thread, consecutive messages by one author as one segment.

    Blank messages are passed over. A null thread is the thread "main" and a null
    author "unknown". `first` is a thread's first message, blank or not; a
    thread without segments has one row with a null island.
    """
    of = F.lit("main") if thread is None else F.coalesce(F.col(thread).cast("string"), F.lit("main"))
    rows = df.select(key, order, F.coalesce(author, F.lit("unknown")).alias("__author"), strip(F.coalesce(text, F.lit(""))).alias("__text"), of.alias("thread"))
    threads = rows.groupBy(key, "thread").agg(F.min(order).alias("first"))
    own = author_groups(rows.filter("__text <> ''"), [key, "thread"], order, "__author").groupBy(key, "thread", "island").agg(ordered_text(F.col("__text"), F.col(order), separator="\n").alias("segment"))
    return threads.join(own, [key, "thread"], "left")


def chunk_messages(df: DataFrame, key: str, order: str, author: str, text: str, thread: str | None = None, max_tokens: int = MAX_TOKENS, vocabulary: str | None = VOCABULARY) -> DataFrame:
    """(key, chunk_index, total, chunk, n_tokens): author segments packed with a line break between; no chunk spans threads.

    Segments of emoji only are left out; a thread without others is one empty chunk.
    """
    return _chunk_groups(message_groups(df, key, order, author, text, thread), key, ["first", "thread"], max_tokens, vocabulary)


def _chunk_groups(groups: DataFrame, key: str, unit: list[str], max_tokens: int, vocabulary: str | None) -> DataFrame:
    """Chunks of (key, unit, island, segment), each unit packed by itself, units in order."""
    segment = F.when(~F.col("segment").rlike(EMOJI_ONLY), F.struct("island", "segment"))
    parts = groups.groupBy(key, *unit).agg(F.transform(F.sort_array(F.collect_list(segment)), lambda s: s["segment"]).alias("__parts"))
    chunks = parts.select(key, *unit, packed_rows("\n", max_tokens, vocabulary)("__parts").alias("__chunks"))
    return _numbered(chunks, key, "__chunks", unit)


def _lines(df: DataFrame, key: list[str], text: str) -> DataFrame:
    """(key, line_no, line) of every text."""
    return df.select(*key, F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), LINES)).alias("line_no", "line"))


def plain_groups(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, section, island, segment): of a plain-text chat, by section (between lines of dashes), the runs of lines by one author.

    "name:" or "<@id>:" at the head of a line names its author; other lines
    belong to the author above. Lines are stripped and blank ones left out. A
    section in which no line has content is one segment as it stands, or has a
    null island if it is blank.
    """
    cut = df.select(key, F.posexplode(sections(F.coalesce(F.col(text), F.lit("")))).alias("section", "__section"))
    head = F.regexp_extract("line", AUTHOR, 1)
    lines = _lines(cut, [key, "section"], "__section").withColumn("__named", F.nullif(head, F.lit("")))
    w = Window.partitionBy(key, "section").orderBy("line_no")
    lines = lines.withColumns({"__author": F.last("__named", ignorenulls=True).over(w), "__content": strip(F.when(F.col("__named").isNull(), F.col("line")).otherwise(F.regexp_extract("line", AUTHOR, 2)))})
    runs = author_groups(lines, [key, "section"], "line_no", "__author").filter("__content <> ''")
    runs = runs.groupBy(key, "section", "island").agg(ordered_text(F.col("__content"), F.col("line_no"), separator="\n").alias("segment"))
    whole = strip(F.col("__section"))
    joined = cut.join(runs, [key, "section"], "left")
    return joined.select(key, "section", F.when(F.col("segment").isNotNull(), F.col("island")).when(whole != "", F.lit(1)).alias("island"), F.coalesce("segment", whole).alias("segment"))


def chunk_plain_chat(df: DataFrame, key: str, text: str, max_tokens: int = MAX_TOKENS, vocabulary: str | None = VOCABULARY) -> DataFrame:
    """(key, chunk_index, total, chunk, n_tokens) of plain-text chats; no chunk spans sections, and a blank text is one empty chunk."""
    return _chunk_groups(plain_groups(df, key, text), key, ["section"], max_tokens, vocabulary)


def speaker_turns(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, island, speaker, segment): consecutive turns of one speaker as one segment; what stands before the first turn has a null speaker.

    "name:", also in brackets, at the head of a line begins a turn. Turns
    without text are passed over. A text without turns has no row.
    """
    lines = _lines(df, [key], text).withColumn("__name", strip(F.nullif(F.regexp_extract("line", SPEAKER, 1), F.lit(""))))
    w = Window.partitionBy(key).orderBy("line_no")
    lines = lines.withColumn("__turn", F.count("__name").over(w))
    rest = strip(F.when(F.col("__name").isNull(), F.col("line")).otherwise(F.regexp_replace("line", SPEAKER, "")))
    turns = lines.groupBy(key, "__turn").agg(F.max("__name").alias("speaker"), strip(ordered_text(rest, F.col("line_no"), separator="\n")).alias("__text")).filter("__text <> ''")
    spoken = F.max("__turn").over(Window.partitionBy(key)) > 0
    runs = author_groups(turns.withColumn("__spoken", spoken).filter("__spoken"), key, "__turn", "speaker")
    return runs.groupBy(key, "island").agg(F.max("speaker").alias("speaker"), ordered_text(F.col("__text"), F.col("__turn"), separator="\n").alias("segment"))


def chunk_turns(df: DataFrame, key: str, text: str, max_tokens: int = MAX_TOKENS, vocabulary: str | None = VOCABULARY) -> DataFrame:
    """(key, chunk_index, total, chunk, n_tokens): speaker turns packed with a blank line between; a text without turns by paragraphs."""
    turns = speaker_turns(df, key, text).groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("island", "segment"))), lambda s: s["segment"]).alias("__turns"))
    parts = df.select(key, text).join(turns, key, "left").select(key, F.coalesce("__turns", paragraphs(F.coalesce(F.col(text), F.lit("")))).alias("__parts"))
    return _numbered(parts.select(key, packed_rows("\n\n", max_tokens, vocabulary)("__parts").alias("__chunks")), key, "__chunks", [])


def chunk_sources(df: DataFrame, key: str, kind: str, text: str, max_tokens: int = MAX_TOKENS, vocabulary: str | None = VOCABULARY) -> DataFrame:
    """(key, chunk_index, total, chunk, n_tokens) by source type: chats in JSON or plain text, transcripts and documents by turns, all others by paragraphs."""
    rows = df.select(key, F.coalesce(F.col(kind), F.lit("")).alias("__kind"), F.col(text).alias("__text")).withColumn("__sent", F.when(F.col("__kind") == "slack", messages(F.col("__text"))))
    sent = rows.filter("__sent is not null").select(key, F.posexplode_outer("__sent").alias("__at", "__m")).select(key, "__at", "__m.user", "__m.text", "__m.thread_ts")
    plain, spoken = rows.filter("__kind = 'slack' and __sent is null"), F.col("__kind").isin("meeting_transcript", "document")
    return reduce(
        DataFrame.unionByName,
        [
            chunk_messages(sent, key, "__at", "user", "text", "thread_ts", max_tokens, vocabulary),
            chunk_plain_chat(plain, key, "__text", max_tokens, vocabulary),
            chunk_turns(rows.filter(spoken), key, "__text", max_tokens, vocabulary),
            chunk_paragraphs(rows.filter(~spoken & (F.col("__kind") != "slack")), key, "__text", max_tokens, vocabulary),
        ],
    )


def legacy_chunks(df: DataFrame, key: str, text: str, found: Column | None = None, max_tokens: int = MAX_TOKENS, vocabulary: str | None = VOCABULARY) -> DataFrame:
    """(key, chunk_index, total, chunk, n_tokens, prior_entities): a text whole if it fits, else its paragraphs packed as they are, those above the budget cut between tokens.

    `found` (array of names) is what earlier chunks of the text gave; the first chunk has none.
    """

    def cut(tokens: Counter):
        pieces = lambda t: tokens.pieces(t, max_tokens)
        return lambda t: [t] if tokens.count(t) <= max_tokens else pack(t.split("\n\n"), "\n\n", max_tokens, tokens, pieces, trim=False)

    none = F.array().cast("array<string>")
    chunks = df.select(key, _chunked(cut, vocabulary)(F.coalesce(F.col(text), F.lit(""))).alias("__chunks"), (none if found is None else found).alias("__found"))
    rows = chunks.select(key, "__found", F.inline_outer("__chunks"))
    return rows.select(key, "chunk_index", "total", "chunk", "n_tokens", F.when(F.col("chunk_index") > 0, F.col("__found")).otherwise(none).alias("prior_entities"))
