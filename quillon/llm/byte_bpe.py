"""Problem 6: token ids of a whole corpus by a public byte-level BPE vocabulary, by replaying its merges."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, functions as F

from quillon.operators.batches import bounds

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
# fixed value: the pattern that the public vocabulary's texts are split by before its merges
WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
EPOCH = 256  # ranks whose waiting pairs are sorted together


def alphabet() -> dict[str, int]:
    """Byte of each letter of a byte-level vocabulary: printable bytes stand for themselves, the rest follow 255."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


class Merges:
    """Merge table of a vocabulary: for each rank the pair of ids and the id it becomes."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        ids = model["vocab"]
        self.byte_id = np.zeros(256, dtype=np.int32)
        for letter, byte in alphabet().items():
            self.byte_id[byte] = ids[letter]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.left = np.array([ids[a] for a, _ in pairs], dtype=np.int64)
        self.right = np.array([ids[b] for _, b in pairs], dtype=np.int64)
        self.made = np.array([ids[a + b] for a, b in pairs], dtype=np.int32)
        codes = (self.left << 32) | self.right
        self.order = np.argsort(codes)
        self.codes = codes[self.order]

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, or the number of merges where there is none."""
        none = len(self.codes)
        code = (left.astype(np.int64) << 32) | right
        at = np.minimum(np.searchsorted(self.codes, code), none - 1)
        return np.where(self.codes[at] == code, self.order[at], none)


def replay(merges: Merges, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words, one after another, and where each word begins (one more entry for the end).

    The bytes of all words lie in one linked list. An inverted index leads from a pair's rank to the positions
    where the pair stood when it was noted; ranks are applied in order, each to all its positions at once, and
    only the neighbours of merged positions give new pairs to note. A note that no longer holds is skipped.
    """
    size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    start = np.r_[0, np.cumsum(size)]
    n = int(start[-1])
    if not n:
        return np.zeros(0, dtype=np.int32), start
    token = merges.byte_id[np.frombuffer(b"".join(words), dtype=np.uint8)].astype(np.int32)
    after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
    full = size > 0
    after[start[1:][full] - 1] = -1
    before[start[:-1][full]] = -1
    none = len(merges.codes)
    epochs = -(-none // EPOCH)
    waiting: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(epochs)]

    def note(rank: np.ndarray, place: np.ndarray, now: int) -> tuple[np.ndarray, np.ndarray]:
        """Put pairs into the index; those of the running epoch are returned."""
        held = rank < none
        rank, place = rank[held], place[held]
        epoch = rank // EPOCH
        soon = epoch == now
        if not soon.all():
            later = np.flatnonzero(~soon)
            later = later[np.argsort(epoch[later], kind="stable")]
            first, length = bounds(epoch[later])
            for a, m in zip(first, length):
                part = later[a : a + m]
                waiting[int(epoch[part[0]])].append((rank[part], place[part]))
        return rank[soon], place[soon]

    inner = np.flatnonzero(after >= 0)
    note(merges.ranks(token[inner], token[after[inner]]), inner, -1)
    for now in range(epochs):
        if not waiting[now]:
            continue
        rank = np.concatenate([r for r, _ in waiting[now]])
        place = np.concatenate([p for _, p in waiting[now]])
        waiting[now] = []
        order = np.argsort(rank, kind="stable")
        rank, place = rank[order], place[order]
        first, length = bounds(rank)
        index = {int(rank[a]): [place[a : a + m]] for a, m in zip(first, length)}
        todo = sorted(index, reverse=True)
        while todo:
            r = todo.pop()
            at = np.unique(np.concatenate(index.pop(r)))
            a, b = merges.left[r], merges.right[r]
            follow = after[at]
            holds = (token[at] == a) & (follow >= 0)
            holds[holds] = token[follow[holds]] == b
            at = at[holds]
            if a == b and len(at) > 1:  # of overlapping pairs every other one, from the left
                chained = after[at[:-1]] == at[1:]
                head = np.r_[True, ~chained]
                run = np.arange(len(at)) - np.maximum.accumulate(np.where(head, np.arange(len(at)), 0))
                at = at[run % 2 == 0]
            if not len(at):
                continue
            gone = after[at]
            beyond = after[gone]
            token[at], token[gone] = merges.made[r], -1
            after[at] = beyond
            before[beyond[beyond >= 0]] = at[beyond >= 0]
            left = before[at]
            spots = np.r_[at[beyond >= 0], left[left >= 0]]
            if len(spots):
                fresh_rank, fresh = note(merges.ranks(token[spots], token[after[spots]]), spots, now)
                for x in np.unique(fresh_rank).tolist():
                    if x not in index:
                        index[x] = []
                        todo.append(x)
                        todo.sort(reverse=True)
                    index[x].append(fresh[fresh_rank == x])
    alive = token >= 0
    counted = np.r_[0, np.cumsum(alive)]
    return token[alive], counted[start]


class Encoder:
    """Ids of texts, slice by slice; words met before in the task (up to ``remember`` ids) are not encoded again."""

    def __init__(self, path: str, remember: int = 4_000_000):
        self.merges, self.remember = Merges(path), remember
        self.split = regex.compile(WORDS)
        self.known: dict[str, int] = {}
        self.ids, self.start = [], [0]

    def learn(self, words: set[str]) -> None:
        new = [w for w in words if w not in self.known]
        ids, start = replay(self.merges, [w.encode("utf-8", "surrogatepass") for w in new])
        base, n = self.start[-1], len(self.known)
        self.known.update(zip(new, range(n, n + len(new))))
        self.ids.append(ids)
        self.start.extend((base + start[1:]).tolist())

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another and where each text begins; null is an empty text."""
        if self.start[-1] > self.remember:
            self.known, self.ids, self.start = {}, [], [0]
        split = [self.split.findall(t) if t else [] for t in texts]
        self.learn(set().union(*split))
        if len(self.ids) > 1:
            self.ids = [np.concatenate(self.ids)]
        flat = self.ids[0] if self.ids else np.zeros(0, dtype=np.int32)
        start = np.asarray(self.start)
        known = self.known
        word = np.fromiter((known[w] for ws in split for w in ws), dtype=np.int64)
        length = (start[1:] - start[:-1])[word] if len(word) else np.zeros(0, dtype=np.int64)
        end = np.cumsum(length)
        total = int(end[-1]) if len(end) else 0
        where = np.arange(total) + np.repeat(start[word] - (end - length), length) if total else np.zeros(0, dtype=np.int64)
        words_end = np.cumsum([len(ws) for ws in split], dtype=np.int64)
        return flat[where], np.r_[0, np.r_[0, end][words_end]]


def slices(texts: pa.Array, chars: int) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``chars`` characters."""
    begin, held = 0, 0
    for i, size in enumerate(pc.fill_null(pc.utf8_length(texts), 0).to_pylist()):
        held += size
        if held >= chars:
            yield begin, i + 1
            begin, held = i + 1, 0
    if begin < len(texts):
        yield begin, len(texts)


def encoded(batches: Iterator[pa.RecordBatch], path: str, chars: int) -> Iterator[pa.RecordBatch]:
    encoder = None
    for batch in batches:
        encoder = encoder or Encoder(path)
        texts = batch.column("text")
        for a, z in slices(texts, chars):
            ids, start = encoder.encode(texts.slice(a, z - a).to_pylist())
            lists = pa.ListArray.from_arrays(pa.array(start.astype(np.int32)), pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*(batch.slice(a, z - a).column(c) for c in batch.schema.names if c != "text"), lists], names=[*(c for c in batch.schema.names if c != "text"), "ids"])


def token_ids(documents: DataFrame, keep: list[str], vocabulary: str = VOCABULARY, chars: int = 2_000_000) -> DataFrame:
    """The columns ``keep`` and ``ids`` (array of int) of each row's whole ``text``, without special tokens.

    The distinct words of a slice of the corpus are encoded together by replaying the vocabulary's merges over
    them (see ``replay``); a task remembers the words of its earlier slices. Words don't depend on each other,
    so slices give the ids that one replay over the whole corpus would give, and nothing is shuffled: the work
    is in proportion to the text and no group gathers anywhere. Memory: a slice of about ``chars`` characters
    (or one longer text) and the remembered words.

    Null, empty: an empty list. Strings of special tokens are ordinary text. Repeated rows each come out. A
    column named ``ids`` can't be kept.
    """
    kept = documents.select(*keep, F.col("text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.drop("text").schema.fields)
    return kept.mapInArrow(lambda batches: encoded(batches, vocabulary, chars), f"{fields}, ids array<int>")
