"""Token ids of a corpus under a public byte-level BPE vocabulary, by speculation and verification.

Words are cut by the vocabulary's own pattern. For words a worker has not met, a greedy longest match over a trie
proposes tokens for all of them at once. A proposal is the exact encoding if every adjacent pair of its tokens is
compatible, that is if no merge could have joined anything across their border; all pairs are tested at once. Only words
with an incompatible pair are merged one by one, by rank.

The tables come from the vocabulary file, which the driver reads and broadcasts: their size is fixed by the vocabulary.
"""

from __future__ import annotations

import heapq
import itertools
import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"

#: The pattern that cuts text into words; fixed by the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Words a worker remembers before it starts anew.
REMEMBER = 300_000
#: Characters of text encoded at a time.
SLICE_CHARS = 2_000_000


def byte_alphabet() -> dict[str, int]:
    """The characters that stand for bytes in the vocabulary file: printable Latin-1 stands for itself, the rest follows from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


@dataclass
class Tables:
    """A vocabulary as arrays. Tokens are numbered by rank here: first the 256 bytes, then the merges in order."""

    ids: np.ndarray  # the vocabulary's id of each token
    left: np.ndarray  # what a token was merged from; itself for a byte
    right: np.ndarray
    pair_key: np.ndarray  # sorted left * size + right of all merges
    pair_token: np.ndarray
    edge_key: np.ndarray  # trie: sorted node * 256 + byte
    edge_node: np.ndarray
    node_token: np.ndarray  # the token that ends at a node, or -1

    @property
    def size(self) -> int:
        return len(self.ids)


def load(path: str = VOCABULARY) -> Tables:
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    alphabet, vocab = byte_alphabet(), model["vocab"]
    single = {b: c for c, b in alphabet.items()}
    names = [single[b] for b in range(256)]
    number = {c: k for k, c in enumerate(names)}
    left, right = list(range(256)), list(range(256))
    for merge in model["merges"]:
        a, b = merge.split(" ") if isinstance(merge, str) else merge
        if a + b in number:  # ranks and tokens would no longer be the same numbers
            raise ValueError(f"two merges of the vocabulary make {a + b!r}")
        number[a + b] = len(names)
        names.append(a + b)
        left.append(number[a])
        right.append(number[b])
    size = len(names)
    lefts, rights = np.array(left, np.int64), np.array(right, np.int64)
    key = lefts[256:] * size + rights[256:]
    order = np.argsort(key)
    node_of: dict[int, int] = {}
    node_token = [-1]
    for token, name in enumerate(names):
        node = 0
        for c in name:
            edge = node * 256 + alphabet[c]
            nxt = node_of.get(edge)
            if nxt is None:
                nxt = node_of[edge] = len(node_token)
                node_token.append(-1)
            node = nxt
        node_token[node] = token
    edges = np.array(sorted(node_of), np.int64)
    return Tables(
        np.array([vocab[n] for n in names], np.int32), lefts, rights, key[order], order + 256, edges,
        np.array([node_of[e] for e in edges.tolist()], np.int64), np.array(node_token, np.int64),
    )


def propose(t: Tables, text: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Greedy longest matches of the words ``text[starts:ends]``: tokens in order of their words, and each token's word."""
    end_of = np.zeros(len(text), np.int64)
    end_of[starts] = 1
    end_of = ends[np.cumsum(end_of) - 1]
    longest, size = text.astype(np.int64), np.ones(len(text), np.int64)
    at = np.arange(len(text))
    node, depth = np.zeros(len(text), np.int64), 0
    while len(at):
        depth += 1
        key = node * 256 + text[at + depth - 1]
        found = np.minimum(np.searchsorted(t.edge_key, key), len(t.edge_key) - 1)
        hit = t.edge_key[found] == key
        at, node = at[hit], t.edge_node[found[hit]]
        token = t.node_token[node]
        good = token >= 0
        longest[at[good]], size[at[good]] = token[good], depth
        more = at + depth < end_of[at]
        at, node = at[more], node[more]
    chosen = np.zeros(len(text), bool)
    here = starts.copy()
    while len(here):
        chosen[here] = True
        stop = end_of[here]
        here = here + size[here]
        here = here[here < stop]
    where = np.flatnonzero(chosen)
    word = np.zeros(len(text), np.int64)
    word[starts] = 1
    return longest[where], (np.cumsum(word) - 1)[where]


def compatible(t: Tables, a: np.ndarray, b: np.ndarray, limit: np.ndarray | None = None) -> np.ndarray:
    """Whether the tokens ``a`` and ``b`` stay apart when their bytes stand next to each other.

    Undoes the merges of both from the last one back. At each moment the tokens at the border are the ones that were
    there then; if the vocabulary joins them by a merge that comes before the next merge that took one of them away, the
    border would have been crossed. A merge of equal rank on both sides is done from the left.
    """
    a, b = a.copy(), b.copy()
    ok = np.ones(len(a), bool)
    until = np.full(len(a), t.size, np.int64) if limit is None else limit.astype(np.int64).copy()
    live = np.arange(len(a))
    while len(live):
        x, y = a[live], b[live]
        key = x * t.size + y
        found = np.minimum(np.searchsorted(t.pair_key, key), len(t.pair_key) - 1)
        merged = np.where(t.pair_key[found] == key, t.pair_token[found], t.size)
        crossed = merged < until[live]
        ok[live[crossed]] = False
        undo_left = x > y
        last = np.where(undo_left, x, y)
        # a merge on the right of the border happens after an equally ranked join at the border, which lies further left
        until[live] = np.where(undo_left, x, y + 1)
        a[live] = np.where(undo_left, t.right[x], x)
        b[live] = np.where(undo_left, y, t.left[y])
        live = live[~crossed & (last >= 256)]
    return ok


def merge(t: Tables, word: bytes) -> list[int]:
    """The exact encoding: the lowest-ranked merge first, the leftmost of equal ones; n log n in the word's length."""
    token = list(word)
    n = len(token)
    nxt, prev, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n

    def joined(i: int) -> int:
        key = token[i] * t.size + token[nxt[i]]
        k = int(np.searchsorted(t.pair_key, key))
        return int(t.pair_token[k]) if k < len(t.pair_key) and t.pair_key[k] == key else -1

    heap = [(m, i, token[i], token[i + 1]) for i in range(n - 1) if (m := joined(i)) >= 0]
    heapq.heapify(heap)
    while heap:
        m, i, x, y = heapq.heappop(heap)
        if not alive[i] or token[i] != x or nxt[i] >= n or token[nxt[i]] != y:
            continue
        j = nxt[i]
        token[i], alive[j], nxt[i] = m, False, nxt[j]
        if nxt[j] < n:
            prev[nxt[j]] = i
        for k in (prev[i], i):
            if k >= 0 and nxt[k] < n and (found := joined(k)) >= 0:
                heapq.heappush(heap, (found, k, token[k], token[nxt[k]]))
    return [x for x, a in zip(token, alive) if a]


def encode_words(t: Tables, words: list[str]) -> list[np.ndarray]:
    """The vocabulary's ids of each word."""
    raw = [w.encode("utf-8", "surrogatepass") for w in words]
    lengths = np.array([len(r) for r in raw], np.int64)
    text = np.frombuffer(b"".join(raw), np.uint8)
    ends = np.cumsum(lengths)
    token, word = propose(t, text, ends - lengths, ends)
    inner = np.flatnonzero(word[1:] == word[:-1])
    failed = np.unique(word[inner[~_pairs(t, token[inner], token[inner + 1])]])
    counts = np.bincount(word, minlength=len(words))
    out = np.split(t.ids[token], np.cumsum(counts)[:-1])
    for k in failed.tolist():
        out[k] = t.ids[merge(t, raw[k])]
    return out


def _pairs(t: Tables, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    if not len(a):
        return np.ones(0, bool)
    key, back = np.unique(a * t.size + b, return_inverse=True)
    return compatible(t, key // t.size, key % t.size)[back]


_find = regex.compile(PATTERN).findall


class Words:
    """The words met so far, with their ids one after the other; forgotten together when they become too many."""

    def __init__(self, t: Tables):
        self.t = t
        self.forget()

    def forget(self) -> None:
        self.at: dict[str, int] = {}
        self.ids = np.zeros(0, np.int32)
        self.start, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def learn(self, words: list[str]) -> None:
        if not words:
            return
        found = encode_words(self.t, words)
        size = np.array([len(f) for f in found], np.int64)
        first = len(self.ids) + np.cumsum(size) - size
        self.at.update(zip(words, range(len(self.at), len(self.at) + len(words))))
        self.ids = np.concatenate([self.ids, *found])
        self.start, self.size = np.concatenate([self.start, first]), np.concatenate([self.size, size])

    def encode(self, texts: list[str | None], counts_only: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and the number of ids of each; a null or empty text has none."""
        if len(self.at) > REMEMBER or len(self.ids) > 4 * REMEMBER:
            self.forget()
        cut = [_find(x) if x else [] for x in texts]
        words = list(itertools.chain.from_iterable(cut))
        at = self.at
        self.learn([w for w in dict.fromkeys(words) if w not in at])
        which = np.fromiter(map(at.__getitem__, words), np.int64, len(words))
        size = self.size[which]
        upto = np.concatenate([[0], np.cumsum(size)])
        stops = np.cumsum([0, *map(len, cut)])
        counts = np.diff(upto[stops])
        if counts_only:
            return np.zeros(0, np.int32), counts
        return self.ids[np.repeat(self.start[which] - upto[:-1], size) + np.arange(upto[-1])], counts


#: One worker's words, by the vocabulary they belong to.
_worker: dict[str, Words] = {}


def worker_words(path: str, shared) -> Words:
    if path not in _worker:
        _worker.clear()
        _worker[path] = Words(shared.value)
    return _worker[path]


def _slices(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    lo = held = 0
    for k, x in enumerate(texts):
        held += len(x or "")
        if held >= SLICE_CHARS:
            yield lo, k + 1
            lo, held = k + 1, 0
    if lo < len(texts):
        yield lo, len(texts)


def token_ids(docs: DataFrame, ident: Column, text: Column, vocabulary: str = VOCABULARY, counts_only: bool = False) -> DataFrame:
    """``doc_id, ids`` (ARRAY<INT>) or, with ``counts_only``, ``doc_id, n_tokens`` of every row, whole texts, without special tokens.

    A null or empty text gives an empty list (a count of 0); a null id stays null; repeated rows are each encoded; special
    tokens' strings within a text are ordinary text; other columns are not read.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(load(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = worker_words(vocabulary, shared)
        for b in batches:
            texts = b.column("text").to_pylist()
            for lo, hi in _slices(texts):
                ids, n = words.encode(texts[lo:hi], counts_only)
                names = b.column("doc_id").slice(lo, hi - lo)
                if counts_only:
                    yield pa.RecordBatch.from_arrays([names, pa.array(n.astype(np.int32))], names=["doc_id", "n_tokens"])
                else:
                    offsets = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([names, pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids))], names=["doc_id", "ids"])

    schema = "doc_id bigint, " + ("n_tokens int" if counts_only else "ids array<int>")
    return docs.select(ident.cast("bigint").alias("doc_id"), text.alias("text")).mapInArrow(run, schema)
