"""Token ids of a corpus in shard files, in the order of ids, and read back.

Documents are dealt to tasks by ranges of their id. Each task encodes its own,
ends each document with an end id, and writes files of bounded size that hold
a wavelet matrix (see ``wavelet``) and a table of their documents. A manifest
table names the files of tasks that succeeded; files are read through it.

The vocabulary splits at white space, so each distinct word is encoded once by
the tokenizers library and kept by the worker, a bounded number of them.

Defined results: a missing or empty text has the end id only. Rows without id
come first; rows with equal ids are ordered by the first ``LEAD`` characters of
their text, then by a hash of it, and written each.
An empty table makes no file and an empty result.
"""

from __future__ import annotations

import os
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from ..operators.settle import new_path, settle
from . import wavelet
from .bpe import LONGEST_KEPT, PIECES, Vocabulary
from .files import opened, publish
from .text import one_by_one

KEPT_WORDS = 600_000  # words a worker keeps, and as many from before
NEAR = "\u024f"  # last character whose class all releases of Unicode tables agree on, see bpe.FAR
LEAD = 64
FILE_TOKENS = 1 << 22  # a file ends with the document that reaches so many
MISSING = -(2**63)  # stands for a missing id in a file
_PER_GROUP = 1000


class _Kept(dict):
    """Ids of words as bytes; a word that is not kept is encoded when it is asked for.

    When there are many, it starts anew and takes words from those before when
    they are asked for again: frequent words stay, those that came once go.
    """

    def __init__(self, vocabulary: LibraryVocabulary):
        super().__init__(vocabulary.special_ids)
        self.vocabulary, self.before = vocabulary, {}

    def __missing__(self, word: str) -> bytes:
        ids = self.before.get(word)
        if ids is None:
            ids = self.vocabulary.ids_of(word)
        if len(word) <= LONGEST_KEPT:
            if len(self) >= KEPT_WORDS:
                self.before = dict(self)
                self.clear()
                self.update(self.vocabulary.special_ids)
            self[word] = ids
        return ids


class LibraryVocabulary(Vocabulary):
    """The library's model encodes the pieces of each new word; what it gives is kept."""

    def __init__(self, path: str):
        super().__init__(path)
        self.model = self.rules.model
        self.letter_of = {b: c for c, b in self.byte_of.items()}
        near = map(chr, range(0x80, ord(NEAR) + 1))
        self.letters_of = {ord(c): c.encode().decode("latin-1").translate(self.letter_of) for c in near}
        self.as_bytes = [i.to_bytes(4, "little") for i in range(len(self.tokens))]
        self.special_ids = {word: self.words.ids[i] for word, i in self.words.items()}
        self.kept = _Kept(self)

    def encode(self, texts):
        for text in one_by_one(texts):
            yield b"".join(map(self.kept.__getitem__, self.parts(text)))

    def ids_of(self, word: str) -> bytes:
        plain = word.isascii()
        if plain or max(word) <= NEAR:
            if word.isalpha():  # one piece
                return self._of_letters(word if plain else word.translate(self.letters_of))
            if word[:-1].isalpha() and word[-1] in ".,;:!?":  # two
                return self.kept[word[:-1]] + self.kept[word[-1]]
            if plain and word.isprintable():  # letters that stand for themselves
                return b"".join(map(self._of_letters, PIECES.findall(word)))
        return b"".join(map(self._of_piece, self.pieces(word)))

    def _of_letters(self, letters: str) -> bytes:
        tokens, as_bytes = self.model.tokenize(letters), self.as_bytes
        return b"".join([as_bytes[t.id] for t in tokens]) if len(tokens) > 1 else as_bytes[tokens[0].id]

    def _of_piece(self, piece: bytes) -> bytes:
        return self._of_letters(piece.decode("latin-1").translate(self.letter_of))


@lru_cache(2)
def _library(path: str) -> LibraryVocabulary:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    return LibraryVocabulary(path)


def write_files(docs: DataFrame, path: str, end_id: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Write ``docs`` and return the manifest: file, first (task, number in it), n_documents, n_tokens."""
    folder = new_path(docs.sparkSession)
    pairs = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    # rows of one id, or without, may be many: they go on by their text, and equal ones by Spark's row id
    keys = {
        "lead": F.substring("text", 1, LEAD), "hash": F.xxhash64("text"), "row": F.monotonically_increasing_id(),
    }
    dealt = pairs.withColumns(keys).repartitionByRange("id", *keys)
    ordered = dealt.sortWithinPartitions("id", "lead", "hash", "text").select("id", "text")

    def run(batches):
        task, number = TaskContext.get().partitionId(), 0
        for ids, lengths, tokens in _file_loads(batches, path, end_id):
            name = f"part-{task:08d}-{number:06d}.wm"
            about = np.array([[MISSING if i is None else i for i in ids], lengths], "<i8").tobytes()
            publish(folder, name, lambda stream: wavelet.write(stream, tokens, about))
            columns = [[f"{folder}/{name}"], [task], [number], [len(ids)], [len(tokens)]]
            yield pa.record_batch(
                [pa.array(c, pa.string() if i == 0 else pa.int64()) for i, c in enumerate(columns)],
                names=["file", "task", "number", "n_documents", "n_tokens"],
            )
            number += 1

    return settle(ordered.mapInArrow(run, "file string, task long, number long, n_documents long, n_tokens long"))


def _file_loads(batches, path, end_id):
    """(document ids, their numbers of tokens, all their tokens) for one file after the other."""
    end = int(end_id).to_bytes(4, "little")
    ids, parts, held = [], [], 0

    def load():
        raw = [p + end for p in parts]
        return list(ids), [len(r) // 4 for r in raw], np.frombuffer(b"".join(raw), "<u4")

    for batch in batches:
        some = batch.column(0).to_pylist()
        for i, raw in zip(some, _library(path).encode(batch.column(1))):
            ids.append(i)
            parts.append(raw)
            held += len(raw) // 4 + 1
            if held >= FILE_TOKENS:
                yield load()
                ids, parts, held = [], [], 0
    if ids:
        yield load()


def read_files(manifest: DataFrame) -> DataFrame:
    """Per document of the files: doc_id, start, n_tokens, ids_crc32, in no order.

    Where a file starts is the sum of those before it, added up within groups
    of tasks and then over groups, so no task sees all files.
    """
    grouped = manifest.withColumn("group", F.floor(F.col("task") / _PER_GROUP))
    groups = grouped.groupBy("group").agg(F.sum("n_tokens").alias("in_group"))
    upto = Window.orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.select("group", F.coalesce(F.sum("in_group").over(upto), F.lit(0)).alias("of_groups"))
    within = Window.partitionBy("group").orderBy("task", "number").rowsBetween(Window.unboundedPreceding, -1)
    starts = grouped.withColumn("of_files", F.coalesce(F.sum("n_tokens").over(within), F.lit(0)))
    files = starts.join(groups, "group").select("file", (F.col("of_groups") + F.col("of_files")).alias("start"))

    def run(batches):
        for batch in batches:
            for file, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                system, place = opened(file)
                with system.open_input_file(place) as source:
                    matrix = wavelet.WaveletMatrix(source, kept_blocks=8)
                    ids, lengths = np.frombuffer(matrix.documents, "<i8").reshape(2, -1)
                    tokens = matrix.all().astype("<u4")
                begin = np.concatenate([[0], np.cumsum(lengths)[:-1]])
                crc = [zlib.crc32(tokens[b : b + n]) for b, n in zip(begin.tolist(), lengths.tolist())]
                yield pa.record_batch(
                    [
                        pa.array(ids, pa.int64(), mask=ids == MISSING), pa.array(start + begin, pa.int64()),
                        pa.array(lengths, pa.int64()), pa.array(crc, pa.int64()),
                    ],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    # the rows are few and small, the files are not: a fixed number of tasks, which Spark does not merge
    spread = files.repartition(int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")), "file")
    return spread.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
