"""Token-ID output: documents as patched frame-of-reference shards (see pfor), in ascending document order.

Rows are dealt out by ranges of (doc_id, text hash), each task writes its range as shards of bounded size under names of its
own, and a manifest table lists the shards of the tasks that ended well; files of lost attempts are never read. The place of
a document among all ids comes from two small prefix sums over the manifest.

Defined cases: null text counts as empty and yields the end id alone; null doc_ids come first; rows with equal doc_ids are
all kept, ordered by the hash of their text; an empty table yields no shards and no rows; other columns are ignored.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from geoloom.llm import pfor
from geoloom.llm.common import byte_rows, new_path, slices, table, tidied, written

END_ID = 1
SHARD_IDS = 8_000_000
#: So many tasks write to one folder.
FOLDER_PARTS = 1000
#: Pieces of text between white space that are remembered in each of two generations.
PIECES = 300_000
#: Bytes of text whose pieces are looked up together.
TOGETHER = 4 << 20

MANIFEST = "part long, shard long, name string, n_docs long, n_ids long"
ROWS = "name string, row long, doc_id long, n_before long, n_tokens long, ids_crc32 long"


#: Of a tokenizer that lowers and drops white space, what Encoder's way by pieces relies on (fixed values of that form).
LETTERS_AND_MARKS = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
CUTS = [
    {"type": "Split", "pattern": {"Regex": LETTERS_AND_MARKS}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
]


class Encoder:
    """Ids of whole texts as little-endian bytes. A tokenizer of another form than NORMALIZERS and CUTS encodes whole texts.

    With one of that form, no token, special or not, spans ASCII white space, and nothing composes across it, so a text's ids
    are those of its pieces, and a piece met lately is not encoded again. Pieces are remembered in two generations of at most
    PIECES, the older of which is dropped when the younger is full. What is done to a piece beforehand is done to ASCII alone:
    - A-Z are lowered, unless "<|" may begin a special token, which is found before lowering;
    - the MARKS at the end, behind a letter a-z, A-Z or of U+00C0 to U+00FF, are a piece by themselves, as letters and marks
      are cut apart;
    - a piece of a-z and the small letters from U+00DF to U+00FF alone needs no normalizer and no cutting, and goes to the
      same model without these steps, its bytes written as ByteLevel writes them. Many go at a time: only a piece's last
      token ends with the model's suffix.
    A piece with any other character is encoded as it stands, since capitals compose otherwise than small letters.
    Texts are cut and gathered in Arrow and numpy; Python meets each different piece of TOGETHER bytes once.
    """

    #: Between new pieces, which are encoded many at a time; a control character is no part of any other token.
    MARK = b" \x01 "
    MARKS = b"!#$%&()*+,-./:;=?@[]^_`{}~"
    SMALL = re.compile("[a-z\u00df-\u00f6\u00f8-\u00ff]+")

    def __init__(self, path: str):
        import json
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, models, pre_tokenizers

        self.tokenizer, self.young, self.old = Tokenizer.from_file(path), {b"": b""}, {}
        form = json.loads(self.tokenizer.to_str())
        known = (form["normalizer"] or {}).get("normalizers") == NORMALIZERS and (form["pre_tokenizer"] or {}).get("pretokenizers") == CUTS
        model, letters = form["model"], sorted(pre_tokenizers.ByteLevel.alphabet())
        known = known and model["type"] == "BPE" and not model["dropout"] and model["unk_token"] is None and not model["continuing_subword_prefix"]
        known = known and bool(suffix := model["end_of_word_suffix"]) and all(c in model["vocab"] and c + suffix in model["vocab"] for c in letters)
        known = known and all(t["content"].startswith("<|") and not t["normalized"] and not set(t["content"]) & set(" \t\n\x0b\x0c\r\x01") and t["content"].encode()[-1] not in self.MARKS and not (t["lstrip"] or t["rstrip"] or t["single_word"]) for t in form["added_tokens"])
        mark = self._ids(self.tokenizer, ["\x01"])[0]
        self.by_pieces = known and len(mark) == 1
        if self.by_pieces:
            self.mark = mark[0]
            rest = {k: v for k, v in model.items() if v is not None and k not in ("type", "vocab", "merges")}
            self.small = Tokenizer(models.BPE(model["vocab"], [tuple(x) for x in model["merges"]], cache_capacity=0, **rest))  # pieces come once
            self.small.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
            self.last = np.zeros(max(model["vocab"].values()) + 1, bool)  # whether an id ends a piece of letters
            self.last[[i for token, i in model["vocab"].items() if token.endswith(suffix)]] = True
            # printable bytes show as themselves, the others from U+0100 on
            self.shown = dict(zip([b for b in range(256) if chr(b) not in letters], [c for c in letters if ord(c) > 255], strict=True))

    @staticmethod
    def _ids(tokenizer, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _whole(self, texts: list[bytes]) -> list[bytes]:
        return [x.tobytes() for x in self._ids(self.tokenizer, [t.decode("utf-8", "replace") for t in texts])]

    def _many(self, pieces: list[bytes]) -> None:
        groups = [pieces[i : i + 256] for i in range(0, len(pieces), 256)]
        for group, ids in zip(groups, self._ids(self.tokenizer, [self.MARK.join(g).decode("utf-8", "replace") for g in groups]), strict=True):
            cut = np.flatnonzero(ids == self.mark)
            self._keep(group, ids, np.append(0, cut + 1), np.append(cut, len(ids)))

    def _many_small(self, pieces: list[bytes], shown: list[str]) -> None:
        for i in range(0, len(pieces), 256):
            ids = self._ids(self.small, [" ".join(shown[i : i + 256])])[0]
            ends = np.flatnonzero(self.last[ids]) + 1
            self._keep(pieces[i : i + 256], ids, np.append(0, ends[:-1]), ends)

    def _keep(self, pieces: list[bytes], ids: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        raw = ids.tobytes()
        self.young.update(zip(pieces, [raw[a:b] for a, b in zip((4 * starts).tolist(), (4 * ends).tolist(), strict=True)], strict=True))

    def _learn(self, pieces: list[bytes]) -> None:
        """Puts the pieces, none of which is in young or there twice, there."""
        small, shown, rest, odd = [], [], [], []
        for p, ids in zip(pieces, map(self.old.get, pieces), strict=True):
            if ids is not None:
                self.young[p] = ids
            elif p.isalpha() and p.islower():  # of bytes: a-z alone
                small.append(p)
                shown.append(p.decode())
            elif b"\x01" in p or len(p) > 255:
                odd.append(p)
            elif not p.isascii() and self.SMALL.fullmatch(p.decode("utf-8", "replace")):
                small.append(p)
                shown.append(p.decode("latin-1").translate(self.shown))
            else:
                rest.append(p)
        self._many_small(small, shown)
        self._many(rest)
        self.young.update(zip(odd, self._whole(odd), strict=True))

    @classmethod
    def _cut(cls, words: pa.Array) -> pa.Array:
        """Two pieces of each word: all but the marks behind a letter, and these."""
        data, offsets = np.frombuffer(words.buffers()[2] or b"", np.uint8), _edges(words)
        ends = offsets[:-1] + pc.binary_length(pc.ascii_rtrim(words, cls.MARKS.decode())).to_numpy()
        padded = np.append(data, [0, 0])  # read below for words of marks alone, which aren't cut
        last, before, held = padded[ends - 1], padded[ends - 2], ends > offsets[:-1]
        accented = (before == 0xC3) & (last >= 0x80) & (last != 0x97) & (last != 0xB7) & (ends > offsets[:-1] + 1)
        ascii_letter = (last | 32 >= 97) & (last | 32 <= 122)
        ends = np.where(held & (ascii_letter | accented), ends, offsets[1:])
        edges = np.append(np.stack([offsets[:-1], ends], 1).ravel(), offsets[-1:]).astype(np.int32)
        return pa.Array.from_buffers(pa.string(), len(edges) - 1, [None, pa.py_buffer(edges), words.buffers()[2]])

    def encode(self, texts: list[bytes]) -> list[bytes]:
        if not self.by_pieces:
            return self._whole(texts)
        group = np.cumsum([len(x) for x in texts]) // TOGETHER
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(texts)]
        return [x for a, b in zip(cuts[:-1], cuts[1:], strict=True) if b > a for x in self._together(texts[a:b])]

    def _together(self, texts: list[bytes]) -> list[bytes]:
        if len(self.young) > PIECES:
            self.old, self.young = self.young, {b"": b""}
        words = pc.ascii_split_whitespace(pa.array(texts, pa.binary()).view(pa.string()))
        coded = words.values.dictionary_encode()
        different = coded.dictionary
        to_lower = pc.and_not(pc.string_is_ascii(different), pc.match_substring(different, "<|"))
        cut = self._cut(pc.if_else(to_lower, pc.ascii_lower(different), different)).dictionary_encode()
        pieces = cut.dictionary.view(pa.binary()).to_numpy(zero_copy_only=False).tolist()
        found = list(map(self.young.get, pieces))
        if None in found:
            gaps = [i for i, x in enumerate(found) if x is None]
            self._learn([pieces[i] for i in gaps])
            for i in gaps:
                found[i] = self.young[pieces[i]]
        held = pa.array(found, pa.binary())
        ids, edges = np.frombuffer(held.buffers()[2] or b"", "<u4"), _edges(held) // 4
        ids, edges = _gathered(ids, edges, cut.indices.to_numpy())
        ids, edges = _gathered(ids, edges[::2], coded.indices.to_numpy())
        raw, edges = ids.tobytes(), (4 * edges[words.offsets.to_numpy()]).tolist()
        return [raw[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]


def _edges(column: pa.Array) -> np.ndarray:
    """Where each text or list of bytes starts in its buffer, and where the last ends."""
    return np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, 4 * column.offset) if len(column) else np.zeros(1, np.int32)


def _gathered(values: np.ndarray, edges: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lists of values between edges at the given places, in a row, and their edges."""
    counts = np.diff(edges)[places]
    out = np.append(0, np.cumsum(counts, dtype=np.int64))
    return values[np.repeat(edges[:-1][places] - out[:-1], counts) + np.arange(out[-1])], out


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each Python worker, which goes from task to task."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def write_token_files(docs: DataFrame, out_dir: str, tokenizer: str, end_id: int = END_ID, shard_ids: int = SHARD_IDS, percentile: int = pfor.PERCENTILE) -> DataFrame:
    """Writes docs (doc_id, text) as shards under out_dir, a folder that all executors reach; returns the manifest."""
    end = np.array([end_id], "<u4").tobytes()

    @tidied
    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        files, base = fs.FileSystem.from_uri(out_dir)
        part, encode = TaskContext.get().partitionId(), encoder(tokenizer).encode
        base = f"{base}/{part // FOLDER_PARTS:06d}"
        files.create_dir(base, recursive=True)
        doc_ids, ids, count, n = [], [], 0, 0

        def shard() -> pa.RecordBatch:
            name = f"part-{part:06d}-{n:05d}-{uuid.uuid4().hex}.pfor"
            body = pfor.encode_shard(doc_ids, [len(x) // 4 for x in ids], np.frombuffer(b"".join(ids), "<u4"), percentile)
            with files.open_output_stream(f"{base}/{name}") as f:
                f.write(body)
            return pa.RecordBatch.from_pydict({"part": [part], "shard": [n], "name": [name], "n_docs": [len(ids)], "n_ids": [count]})

        for batch in batches:
            for some in slices(batch, 1024):
                for key, got in zip(some.column(0).to_pylist(), encode(byte_rows(some.column(1))), strict=True):
                    doc_ids.append(key)
                    ids.append(got + end)
                    count += len(ids[-1]) // 4
                    if count >= shard_ids:
                        yield shard()
                        doc_ids, ids, count, n = [], [], 0, n + 1
        if ids:
            yield shard()

    spark = docs.sparkSession
    dealt = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("tie"))
    dealt = dealt.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    manifest = dealt.mapInArrow(shards, MANIFEST)
    return written(manifest, "token-manifest")


def read_token_files(spark: SparkSession, out_dir: str, manifest: DataFrame) -> DataFrame:
    """A row per document: doc_id, start (ids of all documents before it), n_tokens, ids_crc32, and the shard it is in."""

    @tidied
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                doc_ids, lengths, ids = pfor.decode_shard(content.as_py())
                ends = np.cumsum(lengths, dtype=np.int64)
                raw = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([path.rsplit("/", 1)[1]] * len(crc)), pa.array(np.arange(len(crc))), pa.array(doc_ids, pa.int64()), pa.array(ends - lengths), pa.array(lengths.astype(np.int64)), pa.array(crc, pa.int64())],
                    names=["name", "row", "doc_id", "n_before", "n_tokens", "ids_crc32"],
                )

    by_part = manifest.groupBy("part").agg(F.sum("n_ids").alias("n"))  # as many rows as there are ranges
    parts = by_part.withColumn("part_start", F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))).select("part", "part_start")
    before = F.sum("n_ids").over(Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    starts = manifest.withColumn("before", before).join(parts, "part").select("name", "part", "shard", (F.coalesce("part_start", F.lit(0)) + F.coalesce("before", F.lit(0))).alias("shard_start"))
    if manifest.isEmpty():
        found = spark.createDataFrame([], ROWS)
    else:
        files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pfor").option("recursiveFileLookup", "true").load(out_dir).select("path", "content")
        found = files.mapInArrow(rows, ROWS)
    return found.join(starts, "name").select("doc_id", (F.col("shard_start") + F.col("n_before")).alias("start"), "n_tokens", "ids_crc32", F.col("name").alias("shard_name"))


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def tokenized(spark: SparkSession, docs: DataFrame) -> DataFrame:
    out = new_path(spark, "token-files")
    return read_token_files(spark, out, write_token_files(docs, out, tokenizer_path()))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenized(spark, table(spark, sf_dir, "documents"))
