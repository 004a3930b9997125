"""BPE encoding and decoding with a pair occurrence index.

The words of a batch of texts are encoded together, each distinct one once.
All their symbols stand in one array. An index maps each pair of neighbouring
symbols that the vocabulary can merge to all its positions in that array. The
pairs that occur are the active ranks; they are applied in ascending order, a
rank at all its positions at once, and the pairs that a merge makes enter the
index. Merges never cross words, so the order within each word is that of BPE.

The vocabulary is a file of the tokenizers library with an end-of-word suffix
(lower case, white space dropped). Its special tokens are found in the raw text
and kept. Texts are read whole. Each worker keeps the words it has encoded, a
bounded number of them, until another operator needs the memory (``kept``).

Defined results: a missing or empty text has no tokens and decodes to an empty
text. Repeated rows each get their tokens. Other columns pass through; columns
named like a result are replaced.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from array import array

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType
from tokenizers import Tokenizer

from .kept import kept
from .text import one_by_one

# The pattern of the vocabulary's pieces.
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
# White space for str.split() but not for the vocabulary.
_NOT_SPACE = regex.compile("[\x1c-\x1f]")
# Beyond Latin letters, Unicode tables of different releases differ: there the vocabulary's own are used.
FAR = regex.compile("[^\x00-\u024f]")
KEPT_WORDS = 250_000  # words a worker keeps from run to run
FRESH_WORDS = 150_000  # new words encoded together
LONGEST_KEPT = 64
BATCH_BYTES = 4_000_000  # ids handed on at once, or one text's


def byte_letters() -> list[str]:
    """The letter that stands for each byte: itself if it is visible, else the next unused one from 256."""
    visible = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    spare = iter(range(256, 512))
    return [chr(b) if b in visible else chr(next(spare)) for b in range(256)]


class Words(dict):
    """Numbers of words, given to new ones as they are asked for, and the ids of each number."""

    def __init__(self, fixed: dict[str, bytes]):
        super().__init__({word: i for i, word in enumerate(fixed)})
        self.fixed, self.ids, self.fresh = len(fixed), list(fixed.values()), []
        self.times = np.zeros(0, np.int64)  # how often each number came

    def __missing__(self, word: str) -> int:
        number = self[word] = len(self.ids) + len(self.fresh)
        self.fresh.append(word)
        return number

    def forget(self, run: list[array], most: int) -> None:
        """Drop long new words; if there are more than ``most``, keep those that came twice or more, or
        of too many of these the more frequent ones."""
        for word in self.fresh:
            if len(word) > LONGEST_KEPT:
                self.ids[self.pop(word)] = b""
        self.fresh = []
        now = np.bincount(np.concatenate([np.frombuffer(r, np.uint32) for r in run]), minlength=len(self.ids))
        now[: len(self.times)] += self.times
        self.times = now
        if len(self) <= most:
            return
        least = 2
        while np.count_nonzero(now >= least) > most // 2:
            least *= 2
        now[: self.fixed] = least
        kept = [(word, n) for word, n in self.items() if now[n] >= least]
        self.clear()
        self.update((word, i) for i, (word, _) in enumerate(kept))
        self.ids = [self.ids[n] for _, n in kept]
        self.times = now[[n for _, n in kept]] // 2


class Vocabulary:
    kept_words = KEPT_WORDS

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        ids = model["model"]["vocab"]
        self.end = end = model["model"]["end_of_word_suffix"]
        letters = byte_letters()
        self.rules = Tokenizer.from_file(path)
        self.byte_of = {c: b for b, c in enumerate(letters)}
        self.inner = np.array([ids[c] for c in letters], np.int64)
        self.last = np.array([ids[c + end] for c in letters], np.int64)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["model"]["merges"]]
        keys = np.array([ids[a] << 32 | ids[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.pairs, self.ranks = keys[order], order.astype(np.int64)
        self.made = np.array([ids[a + b] for a, b in pairs], np.int64)
        self.special = {t["content"]: t["id"] for t in model["added_tokens"]}
        # kept under keys that no word can have, as they hold a space
        self._marked = {t: f" {t}" for t in self.special}
        self.special_split = regex.compile("|".join(map(regex.escape, self.special)) or "(?!)")
        known = {**{i: t for t, i in ids.items()}, **{i: t for t, i in self.special.items()}}
        self.tokens = [known.get(i, "") for i in range(max(known) + 1)]
        self.words = Words({f" {t}": int(i).to_bytes(4, "little") for t, i in self.special.items()})

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 where the pair is not merged."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.ranks[at], -1)

    def merged(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all pieces, and where each piece's begin."""
        sizes = np.array([len(p) for p in pieces], np.int64)
        ends = np.cumsum(sizes)
        raw = np.frombuffer(b"".join(pieces), np.uint8)
        n = len(raw)
        symbol = self.inner[raw]
        symbol[ends - 1] = self.last[raw[ends - 1]]
        after, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        after[ends - 1] = -1
        before[ends - sizes] = -1
        alive = np.ones(n, bool)

        index: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def enter(places):
            """Add the pairs that begin at ``places``."""
            ranks = self.rank_of(symbol[places], symbol[after[places]])
            places, ranks = places[ranks >= 0], ranks[ranks >= 0]
            if not len(ranks):
                return
            order = np.argsort(ranks, kind="stable")
            places, ranks = places[order], ranks[order]
            cuts = np.flatnonzero(np.diff(ranks)) + 1
            for rank, part in zip(ranks[np.concatenate([[0], cuts])].tolist(), np.split(places, cuts)):
                if rank not in index:
                    index[rank] = []
                    heapq.heappush(active, rank)
                index[rank].append(part)

        enter(np.flatnonzero(after >= 0))
        lefts, rights = np.zeros(len(self.made), np.int64), np.zeros(len(self.made), np.int64)
        lefts[self.ranks], rights[self.ranks] = self.pairs >> 32, self.pairs & 0xFFFFFFFF
        while active:
            rank = heapq.heappop(active)
            lists = index.pop(rank)
            at = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
            a, b = lefts[rank], rights[rank]
            at = at[alive[at] & (symbol[at] == a)]
            at = at[after[at] >= 0]
            at = at[symbol[after[at]] == b]
            if a == b:
                at = _apart(np.sort(at), after)
            if not len(at):
                continue
            gone = after[at]
            symbol[at] = self.made[rank]
            alive[gone] = False
            after[at] = after[gone]
            has = after[at] >= 0
            before[after[at[has]]] = at[has]
            left = before[at]
            # a neighbour may have been merged in the same step: then it begins its own pair
            enter(np.unique(np.concatenate([at[has], left[left >= 0]])))
        kept = np.flatnonzero(alive)
        return symbol[kept], np.searchsorted(kept, ends - sizes)

    def learn(self, fresh: list[str]) -> list[bytes]:
        """The ids of each word."""
        pieces, owner = [], []
        for k, word in enumerate(fresh):
            found = self.pieces(word)
            pieces += found
            owner += [k] * len(found)
        if not pieces:
            return [b""] * len(fresh)
        ids, starts = self.merged(pieces)
        raw = ids.astype("<i4").tobytes()
        first = np.searchsorted(np.array(owner), np.arange(len(fresh) + 1))
        cuts = (4 * np.concatenate([starts, [len(ids)]])[first]).tolist()
        return [raw[a:b] for a, b in zip(cuts, cuts[1:])]

    def encode(self, texts):
        """Ids of each text of a list or Arrow array, as bytes, four for each id.

        A text becomes numbers of its words, one look per word. Texts are taken in runs; the words
        that are new in a run are encoded together.
        """
        words, run = self.words, []
        for i, text in enumerate(one_by_one(texts)):
            run.append(array("I", map(words.__getitem__, self.parts(text))))
            if len(words.fresh) >= FRESH_WORDS or i == len(texts) - 1:
                words.ids += self.learn(words.fresh)
                for numbers in run:
                    yield b"".join(map(words.ids.__getitem__, numbers))
                words.forget(run, self.kept_words)
                run = []

    def pieces(self, word: str) -> list[bytes]:
        if FAR.search(word):
            found = self.rules.pre_tokenizer.pre_tokenize_str(word)
            return [bytes(map(self.byte_of.__getitem__, p)) for p, _ in found]
        return [p.encode() for p in PIECES.findall(word)]

    def split(self, text: str) -> list[str]:
        """The words of a text as the vocabulary's normalizer leaves them: NFC, lower case letter by letter."""
        if text.isascii():
            text = text.lower()
        elif FAR.search(text):
            text = self.rules.normalizer.normalize_str(text)
        else:
            text = unicodedata.normalize("NFC", text).lower()
        return [w for w in regex.split(r"\s+", text) if w] if _NOT_SPACE.search(text) else text.split()

    def parts(self, text: str | None) -> list[str]:
        """Words and special tokens of a text, in order."""
        if not text:
            return []
        if not any(s in text for s in self.special):
            return self.split(text)
        parts, at = [], 0
        for m in self.special_split.finditer(text):
            parts += self.split(text[at : m.start()])
            parts.append(self._marked[m[0]])
            at = m.end()
        return parts + self.split(text[at:])

    def decode(self, ids: list[int] | None) -> str:
        return " ".join(map(self.tokens.__getitem__, ids or ()))


def _apart(places: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Of equal pairs that overlap (x x x), the first, third, ... from the left."""
    follows = np.zeros(len(places), bool)
    follows[1:] = after[places[:-1]] == places[1:]
    run = np.arange(len(places))
    begins = np.maximum.accumulate(np.where(follows, 0, run))
    return places[(run - begins) % 2 == 0]


@kept(2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def _with_column(docs: DataFrame, name: str, kind, make) -> DataFrame:
    """``docs`` with one column more, made of each batch of Arrow rows."""
    rest = [f for f in docs.schema.fields if f.name != name]
    schema = StructType([*rest, StructField(name, kind)])

    def run(batches):
        for batch in batches:
            names = [f.name for f in rest]
            columns = [batch.column(batch.schema.get_field_index(n)) for n in names]
            for start, stop, column in make(batch):
                yield pa.record_batch([*[c.slice(start, stop - start) for c in columns], column], names=[*names, name])

    return docs.mapInArrow(run, schema)


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with the token ids of each text."""

    def make(batch):
        texts = batch.column(batch.schema.get_field_index(text))
        start, held, found = 0, 0, []
        for i, raw in enumerate(vocabulary(path).encode(texts)):
            found.append(raw)
            held += len(raw)
            if held >= BATCH_BYTES or i == len(texts) - 1:
                offsets = np.concatenate([[0], np.cumsum([len(f) // 4 for f in found])]).astype(np.int32)
                flat = pa.array(np.frombuffer(b"".join(found), "<i4"), pa.int32())
                yield start, i + 1, pa.ListArray.from_arrays(offsets, flat)
                start, held, found = i + 1, 0, []

    return _with_column(docs, ids, ArrayType(IntegerType()), make)


def decode(docs: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``docs`` with the text that each list of ids stands for: its tokens, joined by spaces."""

    def make(batch):
        known = vocabulary(path)
        lists = batch.column(batch.schema.get_field_index(ids))
        for start in range(0, len(lists), 500):
            some = lists.slice(start, 500).to_pylist()
            yield start, start + len(some), pa.array([known.decode(x) for x in some], pa.string())

    return _with_column(docs, text, StringType(), make)


def digests(encoded: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    listed = F.array_join(F.col("ids").cast("array<string>"), " ")
    return encoded.select(
        doc_id,
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(listed.cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
