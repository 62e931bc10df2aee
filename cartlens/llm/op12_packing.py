"""Vector bin packing: examples go to sequences under limits on tokens, segments and loss-bearing tokens at once.

An example is its token ids and, optionally, a mask of the tokens that bear loss (instruction data: the answers). Each
task packs its own rows as it reads them, so nothing is shuffled and no example meets the driver. A task keeps a pool of
at most ``POOL_ITEMS`` open examples or ``POOL_SEQUENCES`` sequences of tokens and fills one sequence after another by the
dot-product heuristic: of the examples that fit whole, the one whose size vector (tokens, 1 segment, loss tokens, each as
a share of its limit) has the largest product with what the sequence still has room for. When none fits whole, the one
with the largest product is cut to fit and its rest stays in the pool. A sequence is padded to the token limit unless
its length is a power of two; one that ends short of the limit (segments or loss used up, or no example left) gives its
last tokens back down to a power of two, so nothing is padded: a task's tail takes as many short sequences as its
length has binary digits, whatever the input.

Tokens: texts are split at ASCII white space, which no piece of the tokenizer crosses; a task's distinct chunks are cut
into the tokenizer's words and its distinct words encoded once, until ``CACHE`` chunks are known and the tables start
afresh. Texts with code points whose classes differ between Unicode versions pass the tokenizer's own normaliser and
splitter. A very long text is cut into full sequences as it is admitted; memory is the ids of one batch of texts (4 MB,
or one text) and of the pool.

Defined results: a null or empty text is its end id alone. Rows with equal or null ids are examples of their own;
every row's pieces count from its first id. An empty table gives an empty one. Only the key, text and mask columns are
read, so other columns cannot clash. A mask shorter than the ids (or null) has no loss beyond its end; without a mask
column every token but an example's first bears loss. A task that is run again packs the same rows in the same way.
"""

from __future__ import annotations

import json
import os
import unicodedata
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartlens.llm.op7_bpe import batches_of, byte_of_char, gathered
from cartlens.llm.registry import query, table

POOL_ITEMS = 2048
POOL_SEQUENCES = 64
CACHE = 500_000
END_ID = 2

#: Fixed value: the splitting rule of the lower-case vocabulary with word ends.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Code points whose classes, cases and compositions don't depend on the Unicode version or on neighbours (as capital sigma's).
SETTLED = "\\u0000-\\u03a2\\u03a4-\\u052f\\u2010-\\u205f\\u3000-\\u3096\\u30a0-\\u30ff\\u4e00-\\u9fa5\\uac00-\\ud7a3"


@dataclass(frozen=True)
class Limits:
    """What one sequence holds at most."""

    tokens: int = 4096
    segments: int = 256
    loss: int = 4096


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Numbers(dict):
    """Numbers of distinct strings, dealt as they are first seen; ``fresh`` are those not handled yet."""

    def __init__(self):
        super().__init__()
        self.fresh: list[str] = []

    def __missing__(self, value: str) -> int:
        self[value] = number = len(self)
        self.fresh.append(value)
        return number

    def of(self, values: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, values), np.int64, len(values))

    def news(self) -> list[str]:
        fresh, self.fresh = self.fresh, []
        return fresh


class Lists:
    """Id lists by number, one behind the other."""

    def __init__(self):
        self.flat, self.cuts = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def append(self, flat: np.ndarray, sizes: np.ndarray) -> None:
        self.flat = np.concatenate([self.flat, flat.astype(np.uint32)])
        self.cuts = np.concatenate([self.cuts, self.cuts[-1] + np.cumsum(sizes)])

    def gather(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the numbered lists, and where each list ends."""
        return gathered(self.flat, self.cuts, numbers), np.cumsum(np.diff(self.cuts)[numbers])


class Encoder:
    """Token ids of texts as the tokenizers library gives them. Made in each task from the tokenizer's JSON."""

    def __init__(self, settings: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        parsed = json.loads(settings)
        parsed["truncation"] = parsed["padding"] = None
        self.special = {t["content"]: t["id"] for t in parsed["added_tokens"]}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.words = regex.compile(PATTERN + "|\n")
        self.unsettled = regex.compile(f"[^{SETTLED}]")
        self.rules = Tokenizer.from_str(json.dumps(parsed | {"added_tokens": [], "model": {"type": "BPE", "vocab": {}, "merges": []}}))
        self.model = Tokenizer.from_str(json.dumps(parsed | {"added_tokens": [], "normalizer": None, "pre_tokenizer": None}))
        self.model.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        known, end = parsed["model"]["vocab"], parsed["model"].get("end_of_word_suffix")
        #: Whether an id is the last of its word; None where the vocabulary does not tell.
        self.last = None
        if end and all(c + end in known for c in byte_of_char()):
            self.last = np.zeros(max(known.values()) + 1, bool)
            self.last[[i for piece, i in known.items() if piece.endswith(end)]] = True
        self.forget()

    def forget(self) -> None:
        self.chunk_numbers, self.chunk_ids = Numbers(), Lists()
        self.word_numbers, self.word_ids = Numbers(), Lists()

    def words_of(self, chunk: str) -> list[str]:
        """The words of a chunk that the fast way cannot split."""
        if self.cut is not None and any(s in chunk for s in self.special):
            return [w for part in self.cut.split(chunk) for w in ([part] if part in self.special else self.words_of(part))]
        normal = self.rules.normalizer.normalize_str(chunk)
        return [normal[a:b] for _, (a, b) in self.rules.pre_tokenizer.pre_tokenize_str(normal)]

    def lines(self, chunks: list[str]) -> list[str]:
        """The words of all chunks, a line feed behind those of each."""
        whole = "\n".join([*chunks, ""])
        if self.unsettled.search(whole) or any(s in whole for s in self.special):
            odd = [bool(self.unsettled.search(c)) or any(s in c for s in self.special) for c in chunks]
            plain = iter(self.lines([c for c, o in zip(chunks, odd) if not o]))
            out = []
            for chunk, o in zip(chunks, odd):
                if o:
                    out += [*self.words_of(chunk), "\n"]
                else:
                    for word in plain:
                        out.append(word)
                        if word == "\n":
                            break
            return out
        return self.words.findall(unicodedata.normalize("NFC", whole).lower())

    def plain_ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, and how many each has. Word ends are read from the ids: keeping track of places takes a third more time."""
        if self.last is not None and words:
            done = self.model.encode_batch_fast([words], is_pretokenized=True, add_special_tokens=False)[0]
            flat = np.array(done.ids, np.uint32)
            sizes = np.diff(np.flatnonzero(self.last[flat]) + 1, prepend=0)
            if len(sizes) == len(words) and sizes.sum() == len(flat):
                return flat, sizes
        done = self.model.encode(words, is_pretokenized=True, add_special_tokens=False)
        return np.array(done.ids, np.uint32), np.bincount(np.array(done.word_ids, np.int64), minlength=len(words))

    def learn_words(self) -> None:
        new = self.word_numbers.news()
        if not new:
            return
        odd = [k for k, w in enumerate(new) if w == "\n" or w in self.special]  # few: put in where they stand
        flat, counts = self.plain_ids([w for a, b in zip([-1, *odd], [*odd, len(new)]) for w in new[a + 1 : b]])
        for k in odd:
            own = [self.special[new[k]]] if new[k] in self.special else []
            flat = np.insert(flat, int(counts[:k].sum()), own)
            counts = np.insert(counts, k, len(own))
        self.word_ids.append(flat, counts)

    def learn(self) -> None:
        """Encodes the chunks not seen before."""
        fresh = self.chunk_numbers.news()
        if not fresh:
            return
        places = self.word_numbers.of(self.lines(fresh))
        self.learn_words()
        flat, ends = self.word_ids.gather(places)
        last = ends[places == self.word_numbers["\n"]]
        self.chunk_ids.append(flat, np.diff(last, prepend=0))

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        if len(self.chunk_numbers) > CACHE:
            self.forget()
        lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        coded = lists.flatten().dictionary_encode()  # only distinct chunks leave Arrow
        places = self.chunk_numbers.of(coded.dictionary.to_numpy(zero_copy_only=False).tolist())[coded.indices.to_numpy()]
        self.learn()
        flat, ends = self.chunk_ids.gather(places)
        cuts = np.concatenate(([0], ends))[lists.offsets.to_numpy() - lists.offsets[0].as_py()]
        return np.split(flat, cuts[1:-1]) if len(texts) else []


class Example:
    """One row's ids, and running sums of its loss-bearing tokens (None: all but the first)."""

    __slots__ = ("key", "ids", "loss")

    def __init__(self, key, ids: np.ndarray, mask=None):
        self.key, self.ids, self.loss = key, ids, None
        if mask is not None:
            full = np.zeros(len(ids) + 1, np.int64)
            own = np.array([bool(m) for m in mask[: len(ids)]], np.int64)
            full[1 : len(own) + 1] = own
            self.loss = np.cumsum(full)

    def loss_before(self, at: int) -> int:
        return max(0, at - 1) if self.loss is None else int(self.loss[at])

    def furthest(self, start: int, loss: int) -> int:
        """The largest end whose span from ``start`` bears at most ``loss``."""
        bar = self.loss_before(start) + loss
        return min(bar + 1, len(self.ids)) if self.loss is None else int(np.searchsorted(self.loss, bar, side="right")) - 1


class Packer:
    """Fills sequences from a pool of open examples; ``out`` collects (example, start, length, sequence, offset)."""

    def __init__(self, limits: Limits, first: int = 0):
        if min(limits.tokens, limits.segments, limits.loss) < 1:
            raise ValueError("limits must be positive")
        self.limits, self.sequence, self.out = limits, first, []
        self.examples: list[Example | None] = []
        self.start, self.size, self.loss = (np.zeros(2 * POOL_ITEMS, np.int64) for _ in range(3))
        self.open, self.tokens = 0, 0

    def add(self, example: Example) -> None:
        """Admits an example; what fills whole sequences by itself is placed at once."""
        at, cap = 0, self.limits
        while len(example.ids) - at >= cap.tokens and example.furthest(at, cap.loss) >= at + cap.tokens:
            self.emit([(example, at, cap.tokens)])
            at += cap.tokens
        self.pool(example, at, len(example.ids) - at)
        while self.open > POOL_ITEMS or self.tokens > POOL_SEQUENCES * cap.tokens:
            self.fill()

    def pool(self, example: Example, at: int, size: int) -> None:
        if size == 0:
            return
        if len(self.examples) == len(self.size):  # full of settled places: close the gaps
            live = np.flatnonzero(self.size[: len(self.examples)])
            self.examples = [self.examples[i] for i in live]
            for column in (self.start, self.size, self.loss):
                column[: len(live)] = column[live]
                column[len(live) :] = 0
            if 2 * len(live) > len(self.size):
                self.start, self.size, self.loss = (np.concatenate([c, np.zeros_like(c)]) for c in (self.start, self.size, self.loss))
        k = len(self.examples)
        self.examples.append(example)
        self.start[k], self.size[k] = at, size
        self.loss[k] = example.loss_before(at + size) - example.loss_before(at)
        self.open += 1
        self.tokens += size

    def take(self, k: int, length: int) -> tuple[Example, int, int]:
        """A piece from the front of an open example."""
        example, at = self.examples[k], int(self.start[k])
        self.start[k] += length
        self.size[k] -= length
        self.loss[k] -= example.loss_before(at + length) - example.loss_before(at)
        self.tokens -= length
        if not self.size[k]:
            self.examples[k] = None
            self.open -= 1
        return example, at, length

    def fill(self) -> None:
        """Packs one sequence."""
        cap, n = self.limits, len(self.examples)
        room, segments, loss = cap.tokens, cap.segments, cap.loss
        size, bears = self.size[:n], self.loss[:n]
        placed: list[tuple[Example, int, int]] = []
        barred = np.zeros(n, bool)  # bear loss at once where none is left
        while room and segments:
            able = (size > 0) & ~barred
            whole = able & (size <= room) & (bears <= loss)
            product = size * (room / cap.tokens**2) + bears * (loss / cap.loss**2) + segments / cap.segments**2
            if whole.any():
                k = int(np.where(whole, product, -1.0).argmax())
                length = int(size[k])
            elif able.any():
                k = int(np.where(able, product, -1.0).argmax())
                at = int(self.start[k])
                length = min(int(size[k]), room, self.examples[k].furthest(at, loss) - at)
                if length == 0:
                    barred[k] = True
                    continue
            else:
                break
            before = int(bears[k])
            placed.append(self.take(k, length))
            loss -= before - int(bears[k])
            room -= length
            segments -= 1
        self.emit(self.unpadded(placed))

    def unpadded(self, placed: list[tuple[Example, int, int]]) -> list[tuple[Example, int, int]]:
        """Pieces that need no padding: the token limit or a power of two; the rest goes back to the pool."""
        total = sum(length for _, _, length in placed)
        over = 0 if total == self.limits.tokens else total - (1 << (total.bit_length() - 1))
        while over:
            example, at, length = placed.pop()
            back = min(over, length)
            if back < length:
                placed.append((example, at, length - back))
            self.give_back(example, at + length - back, back)
            over -= back
        return placed

    def give_back(self, example: Example, at: int, size: int) -> None:
        """Joins the span with the example's open rest, if it has one."""
        for k, other in enumerate(self.examples):
            if other is example and self.size[k] and self.start[k] == at + size:
                self.start[k] = at
                self.size[k] += size
                self.loss[k] += example.loss_before(at + size) - example.loss_before(at)
                self.tokens += size
                return
        self.pool(example, at, size)

    def emit(self, placed: list[tuple[Example, int, int]]) -> None:
        offset = 0
        for example, at, length in placed:
            self.out.append((example, at, length, self.sequence, offset))
            offset += length
        self.sequence += 1

    def finish(self) -> None:
        while self.open:
            self.fill()


def pieces_of(out: list[tuple], key_type: pa.DataType, ids: bool) -> pa.RecordBatch:
    """The digest columns of packed pieces, and their ids where asked for."""
    own = [e.ids[a : a + n] for e, a, n, _, _ in out]
    columns = [
        pa.array([e.key for e, *_ in out], key_type),
        pa.array([a for _, a, *_ in out], pa.int64()),
        pa.array([len(x) for x in own], pa.int64()),
        pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in own], pa.int64()),
        pa.array([len(e.ids) for e, *_ in out], pa.int64()),
        pa.array([s for *_, s, _ in out], pa.int64()),
        pa.array([o for *_, o in out], pa.int64()),
        pa.array([e.loss_before(a + n) - e.loss_before(a) for e, a, n, _, _ in out], pa.int64()),
    ]
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "loss_tokens"]
    if ids:
        columns.append(pa.array([x.astype(np.int32) for x in own], pa.list_(pa.int32())))
        names.append("ids")
    return pa.RecordBatch.from_arrays(columns, names)


def packed(
    rows: DataFrame, key: str = "doc_id", text: str | None = "text", ids: str | None = None, mask: str | None = None,
    limits: Limits = Limits(), end_id: int = END_ID, with_ids: bool = True, path: str | None = None,
) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, loss_tokens and ids of every piece.

    Examples are the encoded ``text`` and the end id, or the id lists of column ``ids`` as they are (null: no ids, no
    piece). ``mask`` names an array column that is true where a token bears loss.
    """
    settings = None
    if ids is None:
        with open(path or tokenizer_path(), encoding="utf-8") as f:
            settings = rows.sparkSession.sparkContext.broadcast(f.read())
    source = rows.select(
        F.col(f"`{key}`").alias("_key"), F.col(f"`{text if ids is None else ids}`").alias("_body"),
        (F.lit(None).cast("array<boolean>") if mask is None else F.coalesce(F.col(f"`{mask}`"), F.array().cast("array<boolean>"))).alias("_mask"),
    )

    def run(batches):
        encoder = Encoder(settings.value) if settings is not None else None
        packer = Packer(limits, TaskContext.get().partitionId() << 40)
        key_type = None

        def examples(batch):
            if encoder is None:
                for k, body, m in zip(*(c.to_pylist() for c in batch.columns)):
                    yield Example(k, np.array(body or (), np.uint32), m)
                return
            for a, b in batches_of(batch.column(1)):
                part = batch.slice(a, b - a)
                for k, own, m in zip(part.column(0).to_pylist(), encoder.encode(part.column(1)), part.column(2).to_pylist()):
                    yield Example(k, np.append(own, np.uint32(end_id)), m)

        for batch in batches:
            key_type = batch.schema.field(0).type
            for example in examples(batch):
                packer.add(example)
                if len(packer.out) > 2000:
                    yield pieces_of(packer.out, key_type, with_ids)
                    packer.out = []
        packer.finish()
        if packer.out:
            yield pieces_of(packer.out, key_type, with_ids)

    longs = ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "loss_tokens")
    fields = [T.StructField("doc_id", rows.schema[key].dataType), *[T.StructField(n, T.LongType()) for n in longs]]
    if with_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.IntegerType())))
    return source.mapInArrow(run, T.StructType(fields))


@query("op12_packing")
def op12_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packed(table(spark, folder, "documents"), with_ids=False)
