"""Packing documents into fixed-size sequences by shortest-pack-first over the length histogram.

Documents are tokenised and cut at multiples of the sequence size. The histogram of piece
lengths, which has at most as many rows as a sequence has tokens, is packed longest length
first: the pieces of a length go to the open pattern with the most room, and counts of
patterns are updated, never single pieces. Each step leaves a slot: an interval of ranks of
one length that goes to an interval of sequences at one offset. Pieces then find their slot
by their rank within their length.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import batches_of, kept, settle, trimmed

SIZE = 2048
END_ID = 1
CACHED_WORDS = 300_000
#: Bytes of text whose words are looked up together; longer texts are taken in parts.
TOGETHER = 1 << 20
#: Words encoded in one call.
ENCODED = 8_000
#: Bytes of text that a worker is handed at a time.
HANDED = 4 << 20
#: Lower-cased words that the tokenizer's normaliser leaves alone and its pre-tokeniser takes as one run.
PLAIN = re.compile("[a-zß-öø-ÿ]+")

_BYTES = np.arange(256, dtype=np.uint8)
_LOWER = np.where((_BYTES >= 0x41) & (_BYTES <= 0x5A), _BYTES + 32, _BYTES).astype(np.uint8)
_SPACE = np.isin(_BYTES, list(b" \t\n\v\f\r"))
_LETTER = (_BYTES >= 0x61) & (_BYTES <= 0x7A)
#: The second byte of a Latin letter after 0xC3; the signs of multiplication and division are none.
_SECOND = (_BYTES >= 0x9F) & (_BYTES <= 0xBF) & (_BYTES != 0xB7)
#: ASCII punctuation but the apostrophe.
_MARK = np.isin(_BYTES, list(b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"))


def parted(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words of texts: their bytes in one row and where each begins; ``bounds`` has the texts' own in ``data``.

    ASCII is lower-cased. White space parts words, and so does a mark between a letter and
    white space, as the tokenizer does itself.
    """
    low = _LOWER[data]
    space = _SPACE[low]
    first = np.zeros(len(low) + 1, bool)
    first[bounds] = True
    after = np.append(space[1:], True) | first[1:]
    before = np.append(True, space[:-1]) | first[:-1]
    letter = _LETTER[low]
    letter[1:] |= _SECOND[low[1:]] & (low[:-1] == 0xC3)
    mark = _MARK[low] & after & ~before & np.append(False, letter[:-1])
    begins = ~space & (before | mark)
    place = np.cumsum(~space)
    return low[~space], (place[begins] - 1), begins


class WordIds:
    """Token ids of texts, with a bounded cache by word in two halves, an older and a newer.

    The tokenizer drops white space and never merges over it, so a text's ids are those of
    its words in turn. Of some texts together, the distinct words are looked up once each.
    Words that the cache lacks are encoded together: plain ones by the tokenizer's model
    alone, others by the whole tokenizer. Texts that may hold a special token, which counts
    as written, are left to the whole tokenizer.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        bytewise = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
        steps = {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, bytewise]}
        self.model = Tokenizer.from_str(json.dumps(spec | {"normalizer": None, "pre_tokenizer": steps, "added_tokens": []}))
        self.cache: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True

    def put(self, words: list[bytes], ids: np.ndarray, bounds: np.ndarray) -> None:
        whole, ends = ids.tobytes(), (4 * bounds).tolist()
        self.cache.update(zip(words, [whole[a:b] for a, b in zip([0, *ends], ends, strict=False)], strict=True))

    def learn(self, words: list[bytes]) -> None:
        """Encode words and put them into the cache, some at a time, as an encoding takes much more room than its ids."""
        for first in range(0, len(words), ENCODED):
            self.encode(words[first : first + ENCODED])

    def encode(self, words: list[bytes]) -> None:
        plain = [w for w in words if w.isalpha()]
        if len(plain) < len(words):
            rest = [w for w in words if not w.isalpha()]
            fine = [PLAIN.fullmatch(w.decode("utf-8", "replace")) is not None for w in rest]
            plain += [w for w, f in zip(rest, fine, strict=True) if f]
            other = [w for w, f in zip(rest, fine, strict=True) if not f]
            texts = [w.decode("utf-8", "replace") for w in other]
            done = self.tokenizer.encode(" ".join(texts), add_special_tokens=False)
            at = np.fromiter((a for a, _ in done.offsets), np.int64, len(done.ids))
            starts = np.cumsum([len(t) + 1 for t in texts])
            self.put(other, np.array(done.ids, "<u4"), np.searchsorted(at, starts))
        if plain:
            # The last token of a plain word says that it ends one.
            done = self.model.encode_batch_fast([b" ".join(plain).decode()], add_special_tokens=False)[0]
            ids = np.array(done.ids, "<u4")
            self.put(plain, ids, np.flatnonzero(self.ends[ids]) + 1)

    def of(self, words: list[bytes]) -> list[bytes]:
        """The ids of distinct words as little-endian unsigned 32-bit integers."""
        found = list(map(self.cache.get, words))
        if None in found:
            missing = [i for i, ids in enumerate(found) if ids is None]
            new = [words[i] for i in missing]
            if len(self.cache) + len(new) > CACHED_WORDS // 2:
                # Words met since the last turn outlive it; those not met again are forgotten at the next.
                self.older, self.cache = self.cache, {}
            known = list(map(self.older.get, new))
            self.cache.update((w, ids) for w, ids in zip(new, known, strict=True) if ids is not None)
            if None in known:
                self.learn([w for w, ids in zip(new, known, strict=True) if ids is None])
            for i, w in zip(missing, new, strict=True):
                found[i] = self.cache[w]
        return found

    def together(self, texts: pa.Array, end: bytes = b"") -> tuple[np.ndarray, np.ndarray]:
        """The ids of some texts (UTF-8 as large_binary) one after another, each with ``end`` after it, and their counts."""
        _, offsets, data = texts.buffers()
        bounds = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(data or b"", np.uint8)[bounds[0] : bounds[-1]]
        bounds = bounds - bounds[0]
        row, at, begins = parted(data, bounds)
        held = [None, pa.py_buffer(np.append(at, len(row))), pa.py_buffer(row)]
        coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at), held).dictionary_encode()
        ids = [*self.of(coded.dictionary.to_pylist()), end]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        places, flat = np.cumsum(sizes) - sizes, np.frombuffer(b"".join(ids), "<u4")
        # Each text has a word more, the end, so none is without.
        number = np.append(0, np.cumsum(begins))[bounds]
        words = np.insert(coded.indices.to_numpy(), number[1:], len(ids) - 1)
        each = sizes[words]
        at = np.repeat(places[words] - np.cumsum(each) + each, each)
        at += np.arange(len(at))
        return flat[at], np.add.reduceat(each, number[:-1] + np.arange(len(texts)))

    def ids(self, text: bytes, end: bytes = b"") -> np.ndarray:
        """The ids of one text, in parts of about ``TOGETHER`` bytes that end at white space."""
        parts, at = [], 0
        while at < len(text):
            stop = at + TOGETHER
            if stop < len(text):
                space = re.compile(rb"[ \t-\r]").search(text, stop)
                stop = space.end() if space else len(text)
            part, at = text[at:stop], stop
            if b"<|" in part:
                whole = self.tokenizer.encode(part.decode("utf-8", "replace"), add_special_tokens=False)
                parts.append(np.array(whole.ids, "<u4"))
            else:
                parts.append(self.together(pa.array([part], pa.large_binary()))[0])
        return np.concatenate([*parts, np.frombuffer(end, "<u4")])


def word_ids(path: str) -> WordIds:
    return kept(f"word ids {path}", lambda: WordIds(path))


def lots(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Where to part texts so that each part has about ``TOGETHER`` bytes, or is one longer or special text."""
    size = pc.binary_length(texts).to_numpy(zero_copy_only=False).copy()
    size[pc.match_substring(texts, b"<|").to_numpy(zero_copy_only=False)] = TOGETHER + 1
    first = held = 0
    for i, n in enumerate(size.tolist()):
        if first < i and held + n > TOGETHER:
            yield first, i
            first, held = i, 0
        held += n
    if first < len(size):
        yield first, len(size)


def pieces(
    docs: DataFrame,
    tokenizer_path: str,
    size: int = SIZE,
    keep_ids: bool = False,
    id_col: str = "doc_id",
    text_col: str = "text",
    number: bool = False,
) -> DataFrame:
    """Whole texts as pieces of at most ``size`` ids: ``<id_col>, start, length, ids_crc32, doc_tokens``.

    A document is its ids and then the end id; a null text is empty. ``keep_ids`` adds the
    ids themselves as ``ids array<int>``, ``number`` the numbers of ``numbered``: the same
    worker gives them, as a second one a task would come to hold tokenizers too.
    """
    end = np.array([END_ID], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = word_ids(tokenizer_path)
        for b in batches:
            texts = b.column(1).cast(pa.large_binary()).fill_null(b"")
            for first, last in lots(texts):
                some = texts.slice(first, last - first)
                if last - first == 1:
                    ids = coder.ids(some[0].as_py(), end)
                    counts = np.array([len(ids)])
                else:
                    ids, counts = coder.together(some, end)
                n = -(-counts // size)
                doc = np.repeat(np.arange(len(counts)), n)
                start = (np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)) * size
                length = np.minimum(counts[doc] - start, size)
                bounds = np.append(0, np.cumsum(length))
                at, whole = (4 * bounds).tolist(), memoryview(ids).cast("B")
                crc = [zlib.crc32(whole[x:y]) for x, y in zip(at, at[1:], strict=False)]
                arrays = [b.column(0).slice(first, last - first).take(pa.array(doc))]
                arrays += [pa.array(x, pa.int64()) for x in (start, length, crc, counts[doc])]
                if keep_ids:
                    arrays.append(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids.view(np.int32))))
                yield pa.RecordBatch.from_arrays(arrays, names)

    names = [id_col, "start", "length", "ids_crc32", "doc_tokens", *["ids"] * keep_ids]
    def cut_and_count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from counted(cut(batches), size)

    own = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string").cast("binary"))
    kinds = ", ".join(f"`{n}` {'array<int>' if n == 'ids' else 'long'}" for n in names)
    return own.mapInArrow(trimmed(cut_and_count), f"{kinds}, {NUMBERS}") if number else own.mapInArrow(trimmed(cut), kinds)


def pack_histogram(counts: dict[int, int], size: int = SIZE) -> list[tuple[int, int, int, int, int]]:
    """Slots (length, lo, hi, base, offset): the pieces of ranks lo to hi - 1 of that length go to
    the sequences from ``base`` on, at ``offset``."""
    room: list[list[tuple[int, int]]] = [[] for _ in range(size + 1)]
    slots, fresh = [], 0
    for length in sorted(counts, reverse=True):
        lo, left, free = 0, counts[length], size
        while left:
            while free >= length and not room[free]:
                free -= 1
            if free >= length:
                base, count = room[free].pop()
            else:
                # As many new sequences as hold the pieces that are left, each filled in turn.
                free, base, count = size, fresh, -(-left // (size // length))
                fresh += count
            taken = min(left, count)
            slots.append((length, lo, lo + taken, base, size - free))
            if count > taken:
                room[free].append((base + taken, count - taken))
            room[free - length].append((base, taken))
            lo, left = lo + taken, left - taken
            free = max(free, free - length)
    return slots


#: What ``numbered`` adds.
NUMBERS = "_part long, _nth long"


def counted(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """A task's batches with ``_part`` and ``_nth`` after their columns, of which ``length`` is one."""
    part, seen = TaskContext.get().partitionId(), np.zeros(size + 1, np.int64)
    for b in batches:
        length = b.column("length").to_numpy(zero_copy_only=False)
        order = np.argsort(length, kind="stable")
        held = np.bincount(length, minlength=size + 1)
        first = np.cumsum(held) - held
        nth = np.empty(len(length), np.int64)
        nth[order] = np.arange(len(length)) - first[length[order]] + seen[length[order]]
        seen += held
        arrays = [*b.columns, pa.array(np.full(len(nth), part)), pa.array(nth)]
        yield pa.RecordBatch.from_arrays(arrays, [*b.schema.names, "_part", "_nth"])


def numbered(table: DataFrame, size: int) -> DataFrame:
    """Add ``_part``, the task that a row was in, and ``_nth``, its number among the task's rows of its length, from 0.

    The caller settles the result, so the numbers are those of one run of each task.
    """
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in table.schema)
    return table.mapInArrow(lambda batches: counted(batches, size), f"{kinds}, {NUMBERS}")


def pack(table: DataFrame, size: int = SIZE) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to a table of pieces with a column ``length`` (long) of 1 to ``size``.

    A piece's rank within its length is its number within its task's rows of that length and
    how many the tasks before it have, so no group of equal pieces, ids or lengths is ordered
    in one place. At any time there are at most two patterns a length, so the number of slots
    depends on ``size`` alone and they are broadcast. An empty table gives an empty result.
    """
    return placed(numbered(table, size), size)


def placed(table: DataFrame, size: int) -> DataFrame:
    """A table of ``numbered`` pieces, packed."""
    with batches_of(table.sparkSession, HANDED):
        table = settle(table, "pieces")
    held = settle(table.groupBy("length", "_part").agg(F.count("*").alias("n")), "piece-counts")
    counts = {r.length: r.n for r in held.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots = np.array(pack_histogram(counts, size), np.int64).reshape(-1, 5)
    length, lo, _, base, offset = slots[np.lexsort((slots[:, 1], slots[:, 0]))].T
    found = table.sparkSession.sparkContext.broadcast((length, lo, base, offset))
    before = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = held.select("length", "_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_first"))
    ranked = table.join(settle(starts, "piece-starts"), ["length", "_part"]).withColumn("_rank", F.col("_first") + F.col("_nth"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        length, lo, base, offset = found.value
        begin = np.searchsorted(length, np.arange(size + 2))
        for b in batches:
            n, rank = (b.column(i).to_numpy(zero_copy_only=False) for i in (at, len(names)))
            # Slots of a length lie together in order of their first ranks: halve the stretch that can hold each rank.
            left, right = begin[n], begin[n + 1]
            while (right - left > 1).any():
                middle = (left + right) // 2
                after = lo[np.minimum(middle, len(lo) - 1)] <= rank
                left, right = np.where(after & (right - left > 1), middle, left), np.where(after, right, np.maximum(middle, left + 1))
            arrays = [pa.array(base[left] + rank - lo[left]), pa.array(offset[left])]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], *arrays], [*names, "sequence_id", "offset"])

    names = [c for c in table.columns if c not in ("_part", "_nth")]
    at = names.index("length")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in table.schema if f.name in names)
    return ranked.select(*names, "_rank").mapInArrow(place, f"{kinds}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer_path: str, size: int = SIZE, keep_ids: bool = False) -> DataFrame:
    """All documents, tokenised, cut and packed: a row per piece.

    Null ids are kept; repeated rows are packed once each; null and empty texts are the end
    id alone; which of several equally long pieces goes where is left to their places in the
    table. Columns of ``docs`` other than ``doc_id`` and ``text`` are left out.
    """
    done = placed(pieces(docs, tokenizer_path, size, keep_ids, number=True), size)
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *["ids"] * keep_ids]
    return done.select(*names)
