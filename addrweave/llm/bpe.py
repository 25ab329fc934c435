"""Byte-pair encoding and decoding of whole corpora.

1. Pieces.  Texts are cut into pieces by the byte-level rule (letters, numbers,
   other signs, each with one leading space; contractions; white space), in
   numpy over the code points of a block.
2. Lexicon.  A pass over all texts finds the frequent pieces; they are compiled,
   with their token ids as outputs, into a minimal acyclic transducer: equal
   suffixes share states, and numbers added up along a word's transitions give
   its place in the output table.  The file lies in the shared folder, Spark
   hands it to the executors, and tasks memory-map it.
3. Encoding.  The distinct pieces of a block walk the transducer together;
   those it doesn't hold are merged exactly, lowest rank and leftmost first.
4. Decoding.  The ids are turned back into bytes through the vocabulary.

Any piece gets the same ids from the transducer and from the merges, so the
choice of frequent pieces never changes a result.  Null texts count as empty:
no tokens, empty string.  Distinct pieces of one block are told apart by 64-bit
hashes.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import uuid

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text
from .common import documents, per_block, shared_dir

WIDE = 1 << 21  # bytes of a block: each distinct piece of a block is encoded once
LEXICON_SIZE = 1 << 16
#: Pieces that make up this share of some task's pieces are frequent.
SHARE = 2.0**-17
LONGEST = 32

OTHER, LETTER, NUMBER, SPACE = range(4)
_classes: list[np.ndarray] = []


def classes() -> np.ndarray:
    """The class of every code point."""
    if not _classes:
        every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
        table = np.zeros(0x110000, np.uint8)
        for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (SPACE, r"\s")):
            table[np.frombuffer("".join(regex.findall(pattern, every)).encode("utf-32-le"), np.uint32)] = kind
        _classes.append(table)
    return _classes[0]


class Vocabulary:
    """Token ids, their bytes, and merges, read from a tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            model = json.load(file)
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        byte_of = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}
        ids = model["model"]["vocab"]
        self.special = {t["content"].encode(): t["id"] for t in model["added_tokens"]}
        size = max([*ids.values(), *self.special.values()]) + 1
        self.tokens = np.empty(size, object)
        self.tokens[:] = b""
        for token, k in ids.items():
            self.tokens[k] = bytes(byte_of[c] for c in token)
        for content, k in self.special.items():
            self.tokens[k] = content
        self.names = np.array([str(k) for k in range(size)], object)
        self.of_byte = np.array([ids[c] for c, _ in sorted(byte_of.items(), key=lambda x: x[1])], np.int64)
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["model"]["merges"]]
        keys = np.array([ids[a] << 32 | ids[b] for a, b in merges], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int32)
        self.merged = np.array([ids[a + b] for a, b in merges], np.int64)
        self.rank_of: dict[int, int] | None = None

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs; len(merged) where there is no merge (also next to -1)."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (right >= 0), self.ranks[at], len(self.merged)).astype(np.int32)

    def merge_many(self, symbols: np.ndarray) -> np.ndarray:
        """Merge each row of byte ids (padded by -1) to the end; rows stay padded."""
        none, n = len(self.merged), symbols.shape[1]
        out = symbols.copy()
        rows = np.arange(len(symbols))
        ranks = self.rank(symbols[:, :-1], symbols[:, 1:])
        while len(rows):
            at = ranks.argmin(1)
            best = ranks[np.arange(len(rows)), at]
            done = best == none
            if done.any():
                out[rows[done]] = symbols[done]
                rows, symbols, ranks, at, best = rows[~done], symbols[~done], ranks[~done], at[~done], best[~done]
                if not len(rows):
                    break
            each = np.arange(len(rows))
            shift = np.arange(n)[None, :] + (np.arange(n)[None, :] > at[:, None])
            symbols = np.where(shift < n, np.take_along_axis(symbols, np.minimum(shift, n - 1), 1), -1)
            symbols[each, at] = self.merged[best]
            ranks = np.where(shift[:, : n - 1] < n - 1, np.take_along_axis(ranks, np.minimum(shift[:, : n - 1], n - 2), 1), none)
            right = np.minimum(at + 1, n - 1)
            fits = at + 1 < n
            where = np.minimum(at, n - 2)
            ranks[each[fits], where[fits]] = self.rank(symbols[each, at], symbols[each, right])[fits]
            left = at > 0
            ranks[each[left], at[left] - 1] = self.rank(symbols[each, at - 1], symbols[each, at])[left]
        return out

    def merge_one(self, piece: bytes) -> list[int]:
        """Merge one piece of any length, with a heap of (rank, position)."""
        if self.rank_of is None:
            self.rank_of = dict(zip(self.keys.tolist(), self.ranks.tolist(), strict=True))
        ids = self.of_byte[np.frombuffer(piece, np.uint8)].tolist()
        after, before = [*range(1, len(ids)), -1], [-1, *range(len(ids) - 1)]
        heap = [(r, k) for k in range(len(ids) - 1) if (r := self.rank_of.get(ids[k] << 32 | ids[k + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, k = heapq.heappop(heap)
            j = after[k]
            if ids[k] < 0 or j < 0 or self.rank_of.get(ids[k] << 32 | ids[j]) != rank:
                continue
            ids[k], ids[j] = int(self.merged[rank]), -1
            after[k] = after[j]
            if after[j] >= 0:
                before[after[j]] = k
            for a, b in ((before[k], k), (k, after[k])):
                if a >= 0 and b >= 0 and (r := self.rank_of.get(ids[a] << 32 | ids[b])) is not None:
                    heapq.heappush(heap, (r, a))
        return [x for x in ids if x >= 0]

    def encode(self, pieces: list[bytes]) -> list[list[int]]:
        """Ids of distinct pieces by exact merging."""
        out: list = [None] * len(pieces)
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        low = 1
        for high in (8, 12, 16, 24, LONGEST):
            chosen = np.flatnonzero((lengths >= low) & (lengths <= high))
            low = high + 1
            if len(chosen):
                flat = np.frombuffer(b"".join(pieces[k].ljust(high, b"\0") for k in chosen.tolist()), np.uint8).reshape(-1, high)
                symbols = np.where(np.arange(high)[None, :] < lengths[chosen][:, None], self.of_byte[flat], -1)
                merged = self.merge_many(symbols)
                counts = (merged >= 0).sum(1).tolist()
                for k, row, n in zip(chosen.tolist(), merged.tolist(), counts, strict=True):
                    out[k] = row[:n]
        for k in np.flatnonzero((lengths < 1) | (lengths > LONGEST)).tolist():
            out[k] = [self.special[pieces[k]]] if pieces[k] in self.special else self.merge_one(pieces[k])
        for content, k in self.special.items():
            if len(content) <= LONGEST and content in pieces:
                out[pieces.index(content)] = [k]
        return out


def pieces(data: np.ndarray, at: np.ndarray, special: list[bytes]) -> np.ndarray:
    """Byte offsets at which the pieces of a block's texts begin."""
    if not len(data):
        return np.zeros(0, np.int64)
    code = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    place = np.flatnonzero((data & 0xC0) != 0x80)
    kind = classes()[code]
    n = len(code)
    first = np.zeros(n + 1, bool)  # where a text, or a stretch between special tokens, begins
    texts = np.searchsorted(place, at)
    first[texts] = True
    whole = []
    flat = data.tobytes()
    for content in special:
        k = flat.find(content)
        while k >= 0:
            if np.searchsorted(at, k, "right") == np.searchsorted(at, k + len(content) - 1, "right"):
                whole.append((int(np.searchsorted(place, k)), int(np.searchsorted(place, k + len(content)))))
            k = flat.find(content, k + len(content))
    for a, b in whole:
        first[[a, b]] = True
    first = first[:n]
    run = first.copy()
    run[1:] |= kind[1:] != kind[:-1]
    space = kind == SPACE
    begins = run.copy()
    joined = np.zeros(n, bool)
    after_space = run[1:] & ~space[1:] & space[:-1] & ~first[1:]
    begins[:-1] |= after_space
    joined[1:] = after_space & (code[:-1] == 0x20)
    begins &= ~joined
    quote = np.flatnonzero(begins & (code == 0x27))
    padded = np.concatenate([code, np.zeros(2, np.uint32)])
    stops = np.concatenate([first, np.ones(3, bool)])
    one, two = padded[quote + 1], padded[quote + 2]
    single = np.isin(one, [ord(c) for c in "stmd"]) & ~stops[quote + 1]
    double = (((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))) & ~stops[quote + 1] & ~stops[quote + 2]
    begins[quote[single | double] + 1] = False
    ends = np.concatenate([quote[single] + 2, quote[double] + 3])
    begins[ends[ends < n]] = True
    for a, b in whole:
        begins[a] = True
        begins[a + 1 : b] = False
    return place[begins]


def distinct(block: pa.RecordBatch, special: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """A block's distinct pieces, the number of each piece in turn, and each text's first piece."""
    data, at = text.raw(block.column("text"))
    starts = pieces(data, at, special)
    ends = np.append(starts[1:], len(data))[: len(starts)]
    _, which, number = np.unique(text.hashes(data, starts, ends), return_index=True, return_inverse=True)
    flat = data.tobytes()
    return [flat[a:b] for a, b in zip(starts[which].tolist(), ends[which].tolist(), strict=True)], number, np.searchsorted(starts, at)


def frequent(docs: DataFrame, special: list[bytes], size: int = LEXICON_SIZE, share: float = SHARE) -> list[bytes]:
    """The most frequent pieces of all texts, ``size`` at most.

    Each task counts all its pieces and passes on those with at least ``share``
    of them (so any piece with that share of the corpus is passed on by some
    task); their counts are then summed.
    """

    def count(batches):
        known: dict[bytes, int] = {}
        total = 0

        def passed(all_of_it):
            least = share * total
            kept = {k: v for k, v in known.items() if v >= least}
            if all_of_it:
                return pa.RecordBatch.from_arrays([pa.array(list(kept), pa.binary()), pa.array(list(kept.values()), pa.int64())], ["piece", "n"])
            known.clear()
            known.update(kept)

        for block in text.blocks(batches, size=WIDE):
            found, number, _ = distinct(block, special)
            total += len(number)
            for piece, n in zip(found, np.bincount(number, minlength=len(found)).tolist(), strict=True):
                if n > 1 and len(piece) <= LONGEST:
                    known[piece] = known.get(piece, 0) + n
            if len(known) > 8 * size:
                passed(False)
        yield passed(True)

    counts = docs.mapInArrow(count, "piece binary, n long").groupBy("piece").agg(F.sum("n").alias("n"))
    return [bytes(r["piece"]) for r in counts.orderBy(F.desc("n"), "piece").limit(size).collect()]


def compile_lexicon(words: list[bytes], outputs: list[list[int]]) -> bytes:
    """A minimal acyclic transducer over sorted distinct words, as one flat file.

    A transition's number counts the words that sort before it from its state;
    the sum along a word is its place in the table of outputs.
    """
    order = sorted(range(len(words)), key=words.__getitem__)
    register: dict[tuple, int] = {}
    states: list[tuple[bool, tuple]] = []

    def settle(node) -> int:
        key = (node[0], tuple(node[1]))
        if key not in register:
            register[key] = len(states)
            states.append(key)
        return register[key]

    path: list = [[False, []]]
    last = b""
    for k in order:
        word = words[k]
        same = 0
        while same < len(last) and same < len(word) and last[same] == word[same]:
            same += 1
        while len(path) > same + 1:
            number = settle(path.pop())
            path[-1][1].append((last[len(path) - 1], number))
        path += [[False, []] for _ in word[same:]]
        path[-1][0] = True
        last = word
    while len(path) > 1:
        number = settle(path.pop())
        path[-1][1].append((last[len(path) - 1], number))
    root = settle(path[0])
    below: list[int] = []
    keys, targets, numbers = [], [], []
    for state, (final, edges) in enumerate(states):  # targets come before their sources
        seen = int(final)
        for byte, target in edges:
            keys.append(state << 8 | byte)
            targets.append(target)
            numbers.append(seen)
            seen += below[target]
        below.append(seen)
    flat = [x for k in order for x in outputs[k]]
    cuts = np.cumsum([0, *(len(outputs[k]) for k in order)])
    parts = [np.asarray(p, np.int64) for p in (keys, targets, numbers, [f for f, _ in states], cuts, flat, [root])]
    return np.concatenate([np.array([len(p) for p in parts], np.int64), *parts]).tobytes()


class Lexicon:
    """A compiled transducer, memory-mapped."""

    def __init__(self, path: str):
        whole = np.memmap(path, np.int64, "r")
        ends = 7 + np.cumsum(whole[:7])
        self.keys, self.targets, self.numbers, self.final, self.cuts, self.ids, root = (whole[a:b] for a, b in zip([7, *ends[:-1]], ends, strict=True))
        self.root = int(root[0])

    def places(self, words: list[bytes]) -> np.ndarray:
        """Place of each word in the output table, -1 if the lexicon lacks it."""
        out = np.full(len(words), -1, np.int64)
        if not len(self.keys) or not words:
            return out
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        begin = np.cumsum(lengths) - lengths
        flat = np.frombuffer(b"".join(words), np.uint8)
        live = np.flatnonzero((lengths > 0) & (lengths <= LONGEST))
        state, number = np.full(len(live), self.root, np.int64), np.zeros(len(live), np.int64)
        step = 0
        while len(live):
            key = state << 8 | flat[begin[live] + step]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            ok = self.keys[at] == key
            live, at, number = live[ok], at[ok], number[ok]
            state, number = self.targets[at], number + self.numbers[at]
            step += 1
            ended = lengths[live] == step
            found = ended & (self.final[state] == 1)
            out[live[found]] = number[found]
            live, state, number = live[~ended], state[~ended], number[~ended]
        return out

    def outputs(self, place: int) -> list[int]:
        return self.ids[self.cuts[place] : self.cuts[place + 1]].tolist()


def put_file(docs: DataFrame, content: bytes) -> str:
    """Write a small file to the shared folder and hand it to all executors; its name."""
    spark = docs.sparkSession
    name = f"{uuid.uuid4().hex}.lexicon"
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/{name}")
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    out = system.create(path)
    out.write(bytearray(content))
    out.close()
    spark.sparkContext.addFile(system.makeQualified(path).toString())
    return name


class Encoder:
    """Encodes and decodes blocks inside a task."""

    def __init__(self, vocabulary: Vocabulary, lexicon: Lexicon):
        self.vocabulary, self.lexicon = vocabulary, lexicon

    def ids(self, found: list[bytes]) -> list[list[int]]:
        places = self.lexicon.places(found)
        out: list = [None] * len(found)
        for k in np.flatnonzero(places >= 0).tolist():
            out[k] = self.lexicon.outputs(places[k])
        new = np.flatnonzero(places < 0).tolist()
        for k, ids in zip(new, self.vocabulary.encode([found[k] for k in new]), strict=True):
            out[k] = ids
        return out

    def texts(self, block: pa.RecordBatch):
        """The ids of each text of a block."""
        found, number, first = distinct(block, list(self.vocabulary.special))
        lists = self.ids(found)
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        flat = np.fromiter((x for ids in lists for x in ids), np.int64, int(sizes.sum()))
        begin = np.cumsum(sizes) - sizes
        each = sizes[number]
        place = np.cumsum(each) - each
        ids = flat[np.repeat(begin[number] - place, each) + np.arange(int(each.sum()))]
        cuts = np.append(place, len(ids))[first]
        return [ids[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(self.vocabulary.tokens[ids].tolist()).decode("utf-8", "replace")


def _encoder(docs: DataFrame, path: str):
    """A function that gives the task's encoder."""
    vocabulary = Vocabulary(path)
    words = [w for w in frequent(documents(docs), list(vocabulary.special)) if w not in vocabulary.special]
    name = put_file(docs, compile_lexicon(words, vocabulary.encode(words)))
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)  # as large as the tokenizer file
    made: list[Encoder] = []

    def get():
        if not made:
            made.append(Encoder(shared.value, Lexicon(SparkFiles.get(name))))
        return made[0]

    return get


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and the array of token ids of every row."""
    get = _encoder(docs, path)

    def run(block):
        lists = get().texts(block)
        cuts = np.cumsum([0, *map(len, lists)])
        ids = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(np.concatenate(lists).astype(np.int32) if lists else [], pa.int32()))
        return pa.RecordBatch.from_arrays([block.column("doc_id"), ids], ["doc_id", "ids"])

    return per_block(documents(docs), run, "doc_id long, ids array<int>", size=WIDE)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and text of rows with arrays of token ids (null: empty)."""
    shared = encoded.sparkSession.sparkContext.broadcast(Vocabulary(path))

    def run(batches):
        for batch in batches:
            lists = batch.column("ids").to_pylist()
            texts = [b"".join(shared.value.tokens[np.array(x or [], np.int64)].tolist()).decode("utf-8", "replace") for x in lists]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """Encode and decode every row; digests of both.

    Returns doc_id, n_tokens, ids_sha256 (of the decimal ids joined by commas)
    and decoded_sha256 (of the decoded text in UTF-8).
    """
    get = _encoder(docs, path)

    def run(block):
        encoder = get()
        lists = encoder.texts(block)
        spoken = [hashlib.sha256(",".join(encoder.vocabulary.names[ids].tolist()).encode()).hexdigest() for ids in lists]
        back = [hashlib.sha256(encoder.decode(ids).encode()).hexdigest() for ids in lists]
        counts = pa.array([len(ids) for ids in lists], pa.int64())
        return pa.RecordBatch.from_arrays([block.column("doc_id"), counts, pa.array(spoken), pa.array(back)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return per_block(documents(docs), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", size=WIDE)
