"""Byte-level BPE encoding and decoding through a distinct-word table.

Texts are split once, inside Spark tasks (the tokenizer's own splitting rule; no merge crosses a word). A task numbers
the distinct words of each batch of texts and writes the texts as word numbers to a file, the words to a table. All
batches' words then meet in hash buckets: each distinct word of the corpus is encoded once, and its ids go back to
every (batch, number) that holds it. Last, each batch meets its ids and every text gathers them by its word numbers,
that is by position. A word moves once per batch that holds it, however often it stands there, and no text is read again.
Decoding joins ids with the vocabulary's pieces (fixed size) in the same way.

Defined results: null and empty texts give no ids (hash of nothing). The text of a special token is that token, as
in the tokenizers library by default. Rows are handled one by one, so repeated rows repeat; an empty table gives an
empty one. A text longer than a batch is a batch of its own. Extra columns don't matter; where ``encode`` adds a
column of an existing name, the new one replaces it.
"""

from __future__ import annotations

import hashlib
import json
import os
import struct
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartlens.llm.registry import query, table
from cartlens.session import scratch_path, written

#: Text of a batch, whose distinct words are moved once.
BATCH_BYTES = 16_000_000
PIECE_BYTES = 4_000_000
#: Words of all batches in one hash bucket, on average.
BUCKET_WORDS = 200_000

#: Fixed value: the splitting rule of the byte-level vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Code points whose classes don't depend on the Unicode version; other texts are split by the tokenizer itself.
SETTLED = "\\u0000-\\u052f\\u2010-\\u205f\\u3000-\\u3096\\u30a0-\\u30ff\\u4e00-\\u9fa5\\uac00-\\ud7a3"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Splitter:
    """Cuts texts into words and special tokens. Made in each task from the tokenizer's settings without vocabulary."""

    def __init__(self, settings: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        parsed = json.loads(settings)
        self.special = {t["content"] for t in parsed["added_tokens"]}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.words = regex.compile(PATTERN)
        self.unsettled = regex.compile(f"[^{SETTLED}]")
        self.splitter = Tokenizer.from_str(json.dumps(parsed | {"added_tokens": []})).pre_tokenizer

    def split(self, text: str) -> list[str]:
        if self.cut is not None and any(s in text for s in self.special):
            out = []
            for part in self.cut.split(text):
                out += [part] if part in self.special else self.split_plain(part)
            return out
        return self.split_plain(text)

    def split_plain(self, text: str) -> list[str]:
        if self.unsettled.search(text):
            return [text[a:b] for _, (a, b) in self.splitter.pre_tokenize_str(text)]
        return self.words.findall(text)


class Encoder:
    """Ids of single words. Made in each task from the tokenizer's JSON."""

    def __init__(self, settings: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        parsed = json.loads(settings)
        parsed["truncation"] = parsed["padding"] = None
        self.special = {t["content"]: t["id"] for t in parsed["added_tokens"]}
        parsed["added_tokens"] = []
        self.model = Tokenizer.from_str(json.dumps(parsed))
        self.model.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)

    def encode_words(self, words: list[str]) -> list[list[int]]:
        plain = [w for w in words if w not in self.special]
        ids = iter(self.model.encode_batch_fast(plain, add_special_tokens=False)) if plain else iter(())
        return [[self.special[w]] if w in self.special else next(ids).ids for w in words]


class Pieces:
    """Bytes of every id: a table of the vocabulary's size, made once and broadcast."""

    def __init__(self, settings: str):
        parsed = json.loads(settings)
        known = parsed["model"]["vocab"] | {t["content"]: t["id"] for t in parsed["added_tokens"]}
        pieces, back = [b""] * (max(known.values()) + 1), byte_of_char()
        for piece, i in known.items():
            plain = all(c in back for c in piece)
            pieces[i] = bytes(back[c] for c in piece) if plain else piece.encode()
        self.flat = np.frombuffer(b"".join(pieces), np.uint8)
        self.cuts = np.cumsum([0, *map(len, pieces)])

    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8 of the decoded text; broken sequences become U+FFFD."""
        return gathered(self.flat, self.cuts, ids).tobytes().decode("utf-8", "replace").encode()


def read_settings(path: str | None) -> str:
    with open(path or tokenizer_path(), encoding="utf-8") as f:
        return f.read()


def bare_settings(settings: str) -> str:
    """The tokenizer's settings without a vocabulary: enough to split."""
    bare = {"truncation": None, "padding": None, "model": {"type": "BPE", "vocab": {}, "merges": []}}
    return json.dumps(json.loads(settings) | bare)


def byte_of_char() -> dict[str, int]:
    """Byte-level vocabularies write printable bytes as themselves and the others as code points from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def gathered(flat: np.ndarray, cuts: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """The runs ``flat[cuts[k]:cuts[k + 1]]`` of all k in ``numbers``, one behind the other."""
    start = cuts[numbers]
    size = cuts[numbers + 1] - start
    ends = np.cumsum(size)
    if not len(ends):
        return flat[:0]
    return flat[np.repeat(start - (ends - size), size) + np.arange(ends[-1])]


def squeezed(raw: bytes) -> bytes:
    return struct.pack("<Q", len(raw)) + pa.compress(raw, codec="zstd", asbytes=True)


def unsqueezed(blob: bytes) -> bytes:
    size = struct.unpack_from("<Q", blob)[0]
    return pa.decompress(blob[8:], size, codec="zstd", asbytes=True) if size else b""


def packed(numbers: np.ndarray) -> bytes:
    """Numbers as four planes of bytes, compressed: the high planes are nearly all zero."""
    return squeezed(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes())


def unpacked(planes: bytes) -> np.ndarray:
    return np.frombuffer(unsqueezed(planes), np.uint8).reshape(4, -1).T.copy().view("<u4").ravel()


def packed_words(words: list[str]) -> bytes:
    coded = [w.encode() for w in words]
    sizes = packed(np.fromiter(map(len, coded), np.uint32, len(coded)))
    return struct.pack("<Q", len(sizes)) + sizes + squeezed(b"".join(coded))


def unpacked_words(blob: bytes) -> list[str]:
    cut = 8 + struct.unpack_from("<Q", blob)[0]
    ends, raw = np.cumsum(unpacked(blob[8:cut])).tolist(), unsqueezed(blob[cut:])
    return [raw[a:b].decode() for a, b in zip([0, *ends], ends)]


def packed_rows(rows: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(rows)
    return sink.getvalue().to_pybytes()


def split_once(docs: DataFrame, kept: list[str], text: str, settings: str) -> DataFrame:
    """Written, a row per batch of texts: _batch, _file, _offset, _lengths, _words, _many.

    The kept columns, the words a text has and the word numbers lie in a file of the task in the shared folder, so that
    they need not move to meet their ids. Rows name the file of the attempt that wrote them. A batch's words are
    numbered by falling frequency, which keeps most numbers small.
    """
    folder = scratch_path(docs.sparkSession, "bpe_batches")
    bare = docs.sparkSession.sparkContext.broadcast(bare_settings(settings))
    rows = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").alias("_bpe_text"))

    def run(batches):
        from pyspark import TaskContext

        splitter = Splitter(bare.value)
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        name, out, at = f"{uuid.uuid4().hex}.batches", None, 0
        first, made = TaskContext.get().partitionId() << 32, 0
        number, parts, counts, found, size = {}, [], [], [], 0

        def of_batch():
            flat = np.concatenate([np.zeros(0, np.uint32), *found])
            order = np.argsort(-np.bincount(flat, minlength=len(number)), kind="stable")
            rank = np.empty(len(order), np.uint32)
            rank[order] = np.arange(len(order), dtype=np.uint32)
            words = list(number)
            held = [packed_rows(pa.Table.from_batches(parts)), packed(np.array(counts)), packed(rank[flat])]
            for blob in held:
                out.write(blob)
            columns = [first + made], [name], [at], [list(map(len, held))], [packed_words([words[i] for i in order.tolist()])], [len(words)]
            types = pa.int64(), pa.string(), pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.int64()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["_batch", "_file", "_offset", "_lengths", "_words", "_many"])

        try:
            for batch in batches:
                texts = batch.column(len(kept))
                for a, b in batches_of(texts):
                    for t in texts.slice(a, b - a).to_pylist():
                        words = splitter.split(t or "")
                        found.append(np.fromiter((number.setdefault(w, len(number)) for w in words), np.uint32, len(words)))
                        counts.append(len(words))
                        size += len(t or "")
                    parts.append(pa.RecordBatch.from_arrays([batch.column(i).slice(a, b - a) for i in range(len(kept))], list(kept)))
                    out = out or store.open_output_stream(f"{root}/{name}", compression=None)
                    if size >= BATCH_BYTES:
                        done = of_batch()
                        at, made = at + sum(done.column(3)[0].as_py()), made + 1
                        number, parts, counts, found, size = {}, [], [], [], 0
                        yield done
            if parts:
                yield of_batch()
        finally:
            if out is not None:
                out.close()

    split = rows.mapInArrow(run, "_batch long, _file string, _offset long, _lengths array<long>, _words binary, _many long")
    return written(split, "bpe_split").withColumn("_file", F.concat(F.lit(f"{folder}/"), "_file"))


def stored(file: str, offset: int, lengths: list[int]) -> list[bytes]:
    """What ``split_once`` put at a place of a file."""
    store, path = fs.FileSystem.from_uri(file)
    with store.open_input_file(path) as source:
        raw = source.read_at(sum(lengths), offset)
    ends = np.cumsum(lengths).tolist()
    return [raw[a:b] for a, b in zip([0, *ends], ends)]


def batches_of(column: pa.Array, most: int = PIECE_BYTES):
    """(first row, row behind the last) of at most ``most`` bytes of text, or one row."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    total, at = np.concatenate(([0], np.cumsum(sizes, dtype=np.int64))), 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(total, total[at] + most, side="right")) - 1)
        yield at, to
        at = to


def word_ids(split: DataFrame, settings: str) -> DataFrame:
    """_batch, _places, _sizes, _ids: ids of some words of a batch; each distinct word of the corpus is encoded once.

    Words meet in as many hash buckets as keep a bucket's distinct words to about BUCKET_WORDS; what a batch has in a
    bucket is one row. A bucket's rows stream through its table of distinct words, so no word is a hot key.
    """
    full = split.sparkSession.sparkContext.broadcast(settings)
    many = max(8, -(-(split.agg(F.sum("_many")).first()[0] or 0) // BUCKET_WORDS))

    def deal(batches):
        from pandas.util import hash_array

        for batch in batches:
            for own, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = unpacked_words(blob)
                bucket = (hash_array(np.array(words, object), categorize=False) % np.uint64(many)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                starts = np.flatnonzero(np.concatenate(([True], np.diff(bucket[order]) != 0))) if len(words) else []
                runs = [order[a:b] for a, b in zip(starts, [*starts[1:], len(order)])]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([int(bucket[r[0]]) for r in runs], pa.int64()), pa.array([own] * len(runs), pa.int64()),
                        pa.array([packed(r) for r in runs], pa.binary()), pa.array([packed_words([words[i] for i in r.tolist()]) for r in runs], pa.binary()),
                    ],
                    ["_bucket", "_batch", "_places", "_words"],
                )

    def run(batches):
        encoder, bucket, table = Encoder(full.value), None, {}
        for batch in batches:
            for at, own, places, blob in zip(*[batch.column(i).to_pylist() for i in range(4)]):
                if at != bucket:
                    bucket, table = at, {}
                words = unpacked_words(blob)
                new = [w for w in words if w not in table]
                table.update(zip(new, (np.array(x, "<u4").tobytes() for x in encoder.encode_words(new))))
                ids = [table[w] for w in words]
                sizes = np.fromiter(map(len, ids), np.uint32, len(ids)) // 4
                row = [own], [places], [packed(sizes)], [packed(np.frombuffer(b"".join(ids), "<u4"))]
                types = pa.int64(), pa.binary(), pa.binary(), pa.binary()
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(row, types)], ["_batch", "_places", "_sizes", "_ids"])

    dealt = split.select("_batch", "_words").mapInArrow(deal, "_bucket long, _batch long, _places binary, _words binary")
    met = dealt.repartition("_bucket").sortWithinPartitions("_bucket")
    return met.mapInArrow(run, "_batch long, _places binary, _sizes binary, _ids binary")


def encoded(docs: DataFrame, make, fields: list[tuple[str, T.DataType]], text: str = "text", path: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """Rows with added columns: ``make(pieces, ids, cuts)`` gives their arrays for a batch of texts."""
    settings, spark = read_settings(path), docs.sparkSession
    pieces = spark.sparkContext.broadcast(Pieces(settings))
    names = [n for n, _ in fields]
    kept = [c for c in (docs.columns if keep is None else keep) if c not in names]
    plain = [f"_in{i}" for i in range(len(kept))]  # no name can clash
    source = docs.select(*[F.col(f"`{c}`").alias(p) for c, p in zip(kept, plain)], F.col(f"`{text}`").alias("_text"))
    split = split_once(source, plain, "_text", settings)
    schema = T.StructType([*[T.StructField(p, docs.schema[c].dataType) for c, p in zip(kept, plain)], *[T.StructField(f"_new{i}", t) for i, (_, t) in enumerate(fields)]])
    target = [*plain, *[f"_new{i}" for i in range(len(fields))]]

    def gather(rows: pa.Table, table: pa.Table) -> pa.Table:
        def joined(name):
            return np.concatenate([np.zeros(0, "<u4"), *[unpacked(x) for x in table.column(name).to_pylist()]])

        place, sizes, flat = joined("_places"), joined("_sizes").astype(np.int64), joined("_ids")
        # words arrive in any order: where each number's ids begin, and how many they are
        start, size = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
        start[place], size[place] = np.cumsum(sizes) - sizes, sizes
        held, counts, numbers = stored(*[rows.column(c)[0].as_py() for c in ("_file", "_offset", "_lengths")])
        own = np.split(unpacked(numbers), np.cumsum(unpacked(counts).astype(np.int64))[:-1])
        out, ends = [np.zeros(0, "<u4")], [0]
        for mine in own:
            each = size[mine]
            upto = np.cumsum(each)
            ends.append(ends[-1] + (int(upto[-1]) if len(upto) else 0))
            if len(upto):
                out.append(flat[np.repeat(start[mine] - (upto - each), each) + np.arange(upto[-1])])
        new = make(pieces.value, np.concatenate(out), np.array(ends))
        old = pa.ipc.open_stream(held).read_all()
        return pa.Table.from_arrays([*[old.column(p) for p in plain], *new], target)

    met = split.drop("_words", "_many").groupBy("_batch").cogroup(word_ids(split, settings).groupBy("_batch"))
    return met.applyInArrow(gather, schema).toDF(*kept, *names)


def id_lists(pieces: Pieces, ids: np.ndarray, cuts: np.ndarray) -> list[pa.Array]:
    return [pa.array(np.diff(cuts)), pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(ids.astype(np.int32)))]


def encode(docs: DataFrame, text: str = "text", path: str | None = None) -> DataFrame:
    """Adds n_tokens and token_ids."""
    return encoded(docs, id_lists, [("n_tokens", T.LongType()), ("token_ids", T.ArrayType(T.IntegerType()))], text, path)


def decode(rows: DataFrame, ids: str = "token_ids", out: str = "decoded", path: str | None = None) -> DataFrame:
    """Adds the text of each id list: ids joined with the vocabulary's pieces. Null lists give null."""
    pieces = rows.sparkSession.sparkContext.broadcast(Pieces(read_settings(path)))
    kept = [c for c in rows.columns if c != out]
    source = rows.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{ids}`").alias("_bpe_ids"))

    def run(batches):
        for batch in batches:
            texts = [None if x is None else pieces.value.decode(np.asarray(x, np.int64)).decode() for x in batch.column(len(kept)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(texts, pa.string())], [*kept, out])

    return source.mapInArrow(run, T.StructType([*[rows.schema[c] for c in kept], T.StructField(out, T.StringType())]))


def digests(pieces: Pieces, ids: np.ndarray, cuts: np.ndarray) -> list[pa.Array]:
    own = [ids[a:b] for a, b in zip(cuts[:-1], cuts[1:])]
    return [
        pa.array(np.diff(cuts)),
        pa.array([hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in own], pa.string()),
        pa.array([hashlib.sha256(pieces.decode(x)).hexdigest() for x in own], pa.string()),
    ]


@query("op7_bpe")
def op7_bpe(spark: SparkSession, folder: str) -> DataFrame:
    fields = [("n_tokens", T.LongType()), ("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType())]
    return encoded(table(spark, folder, "documents"), digests, fields, keep=["doc_id"])
