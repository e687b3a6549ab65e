"""Sum-of-squares online packing of documents into training windows.

Each task packs the documents of its own partition, so nothing is shuffled. It keeps one array with the number of open
windows at every fill level; a document goes to the level whose choice leaves the smallest sum of squared counts, which
keeps open windows few at any size of input. Documents longer than a window are cut into whole windows and a rest. A
task holds back the latest documents until they suffice to fill the gaps of all open windows; at its end it cuts these
to fit, so that only its last windows are partial, and those are cut to powers of two, which need no padding.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections import defaultdict, deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from drawbook.llm.workers import tidy_task

CACHED_WORDS = 250_000
# The byte-level tokenizer's word pattern for texts in which \w is a letter, a digit or an underscore.
PLAIN = re.compile(r"[\t\n\x0b\x0c\r\x20-\x7e\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u017f]*").fullmatch
PLAIN_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+").findall
RARE_SPACE = re.compile(r"[\x1c-\x1f\x85]").search


class IdEncoder:
    """Token ids of texts as little-endian unsigned 32-bit bytes, remembering the ids of words.

    The tokenizer cuts a text into words and encodes each by itself. Texts of common letters are cut by the standard
    library's patterns, others by the tokenizer's own pattern; a text with special tokens or rare white space goes to the
    tokenizer whole. Where the order of the merges is the order of the ids, new words are encoded by the faster of the two
    libraries, from the same vocabulary.
    """

    def __init__(self, vocabulary: str, end_id: int, pattern: str, special: tuple[str, ...]):
        import regex
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(vocabulary)
        self.end = array("I", [end_id]).tobytes()
        self.split = regex.compile(pattern).findall
        self.special = special
        self.known: dict[str, bytes] = {}
        self.word_ids = lambda word: self.tokenizer.encode(word, add_special_tokens=False).ids
        model = json.loads(vocabulary)["model"]
        merged = [model["vocab"]["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
        if merged == sorted(merged):
            letters = byte_letters()
            ranks = {bytes(letters[c] for c in piece): k for piece, k in model["vocab"].items() if piece not in special}
            self.word_ids = tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def encode(self, text: str) -> bytes:
        if any(mark in text for mark in self.special) or RARE_SPACE(text):
            return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes() + self.end
        words, known = (PLAIN_WORDS if PLAIN(text) else self.split)(text), self.known
        for word in set(words):
            if word not in known:
                known[word] = array("I", self.word_ids(word)).tobytes()
        out = b"".join([known[word] for word in words]) + self.end
        if len(known) > CACHED_WORDS:
            known.clear()
        return out


def byte_letters() -> dict[str, int]:
    """The byte behind each letter of a byte-level vocabulary: printable bytes stand for themselves, the others follow at 256."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


_ENCODERS: dict[tuple, IdEncoder] = {}


def encoder_of(vocabulary: str, end_id: int, pattern: str, special: tuple[str, ...]) -> IdEncoder:
    """One encoder per Python worker, so that the words of earlier tasks stay known."""
    key = (hash(vocabulary), end_id)
    if key not in _ENCODERS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        _ENCODERS[key] = IdEncoder(vocabulary, end_id, pattern, special)
    return _ENCODERS[key]


class LevelPacker:
    """Places items one by one; ``counts[level]`` is the number of open windows filled to ``level``."""

    def __init__(self, window: int, first_id: int):
        self.window, self.next_id = window, first_id
        self.counts = np.zeros(window + 1, np.int64)
        self.open: dict[int, deque[int]] = defaultdict(deque)
        self.gap = 0

    def new(self) -> int:
        self.next_id += 1
        return self.next_id - 1

    def place(self, size: int) -> tuple[int, int]:
        """Window and offset for an item of 1 to ``window - 1`` tokens."""
        counts = self.counts
        # Sum of squares after the move, less that before it: a window leaves its level and enters the higher one.
        after = 2 * counts[size:] + 1
        after[-1] = 0  # a full window is not open
        cost = after[: self.window - size + 1] - 2 * counts[: self.window - size + 1] + 1
        cost[counts[: self.window - size + 1] == 0] = np.iinfo(np.int64).max
        cost[0] = after[0]
        level = int(len(cost) - 1 - np.argmin(cost[::-1]))  # of equal costs the fullest
        if level:
            sequence = self.open[level].popleft()
            counts[level] -= 1
            self.gap -= size
        else:
            sequence = self.new()
            self.gap += self.window - size
        if level + size < self.window:
            self.open[level + size].append(sequence)
            counts[level + size] += 1
        return sequence, level

    def partial(self) -> Iterator[tuple[int, int]]:
        for level in np.flatnonzero(self.counts)[::-1]:
            for sequence in self.open[int(level)]:
                yield sequence, int(level)


def pack_stream(documents: Iterator[tuple[object, bytes]], window: int, first_id: int) -> Iterator[tuple]:
    """(key, start, ids of the piece, tokens of the document, sequence, offset) for (key, ids as bytes)."""
    packer = LevelPacker(window, first_id)
    held: deque[tuple[object, int, bytes, int]] = deque()
    held_tokens = 0
    for key, ids in documents:
        total, start = len(ids) // 4, 0
        while total - start >= window:
            yield key, start, ids[4 * start: 4 * (start + window)], total, packer.new(), 0
            start += window
        if start == total:
            continue
        held.append((key, start, ids[4 * start:], total))
        held_tokens += total - start
        # Placing the oldest may open a window; what stays held must still fill every gap.
        while held and held_tokens - len(held[0][2]) // 4 >= packer.gap + window:
            key, start, rest, total = held.popleft()
            held_tokens -= len(rest) // 4
            sequence, offset = packer.place(len(rest) // 4)
            yield key, start, rest, total, sequence, offset

    gaps = deque((sequence, level, window - level) for sequence, level in packer.partial())
    left = held_tokens - sum(g[2] for g in gaps)
    while left > 0:  # whole windows, then powers of two
        room = window if left >= window else 1 << (left.bit_length() - 1)
        gaps.append((packer.new(), 0, room))
        left -= room
    while held:
        key, start, rest, total = held.popleft()
        while rest:
            sequence, offset, room = gaps.popleft()
            taken = min(room, len(rest) // 4)
            yield key, start, rest[: 4 * taken], total, sequence, offset
            start, rest = start + taken, rest[4 * taken:]
            if taken < room:
                gaps.appendleft((sequence, offset + taken, room - taken))


def pack(docs: DataFrame, vocabulary: str, window: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of the token sequences of ``docs``, each placed in a window of ``window`` tokens.

    ``vocabulary`` is the path of a tokenizer file, read by the driver and sent to the tasks (a few MB whatever the data).
    A document is its ids followed by ``end_id``; a null or empty text is the end id alone. Returns ``id_col``, ``start``
    (ids of the document before the piece), ``ids`` (little-endian unsigned 32-bit), ``length``, ``doc_tokens``,
    ``sequence_id`` and ``offset``. Each id is in one piece. Repeated rows and null ids are packed like any other row;
    extra columns are not read. An empty table gives no pieces. Sequence ids depend on the partitions of ``docs``.
    """
    import public_tokenizers
    from tokenizers import Tokenizer

    content = open(vocabulary, encoding="utf-8").read()
    special = tuple(x.content for x in Tokenizer.from_str(content).get_added_tokens_decoder().values())
    shared = docs.sparkSession.sparkContext.broadcast(content)
    pattern = public_tokenizers.PATTERN
    key_type = docs.schema[id_col].dataType
    schema = T.StructType([
        T.StructField(id_col, key_type), T.StructField("start", T.LongType()), T.StructField("ids", T.BinaryType()),
        T.StructField("doc_tokens", T.LongType()), T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(shared.value, end_id, pattern, special)
        arrow_key = None

        def documents() -> Iterator[tuple[object, bytes]]:
            nonlocal arrow_key
            for batch in batches:
                arrow_key = batch.schema.field(0).type
                for key, text in zip(batch.column(0), batch.column(1), strict=True):
                    yield key.as_py(), encoder.encode(text.as_py() or "")

        def as_batch(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True))
            kinds = [arrow_key, pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=schema.names)

        rows, held = [], 0
        for piece in pack_stream(documents(), window, TaskContext.get().partitionId() << 33):
            rows.append(piece)
            held += len(piece[2])
            if held > 4 << 20:
                yield as_batch(rows)
                rows, held = [], 0
        if rows:
            yield as_batch(rows)

    pieces = docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(tidy_task(run), schema)
    return pieces.withColumn("length", (F.octet_length("ids") / 4).cast("long"))
