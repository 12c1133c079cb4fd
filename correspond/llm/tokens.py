"""Token-ID shards: a wavelet matrix of each shard's ids in one compressed file."""

import functools
import json
import os
import struct
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from correspond.llm.common import small_batches, table
from correspond.operators.tables import shared_dir

#: Ids in a shard, rounded up to whole documents: some 4 MB of bit-planes before compression.
SHARD_IDS = 1 << 21
MAGIC = b"WVM2"
#: Bits of a plane that are compressed together, and bits between two stored ranks inside them.
_CHUNK, _BLOCK = 1 << 19, 1 << 9


class WaveletMatrix:
    """Bit-planes of the ids' numbers among the shard's different ids, highest bit first; each plane lists the ids in the order that stable partition by the planes above gives.

    A plane is cut into chunks. Ones before each chunk are at hand; `chunk(level, k)`
    brings the ranks inside it and its bits, so an access needs one chunk of each plane.
    """

    def __init__(self, n: int, symbols: np.ndarray, before: np.ndarray, chunk):
        """symbols: the different ids, ascending; before: (levels, chunks + 1) ones before each chunk and in all."""
        self.n, self.symbols, self.before, self.chunk = n, symbols, before, functools.lru_cache(256)(chunk)
        self.levels, self.zeros = len(before), [n - int(b[-1]) for b in before]

    def _number(self, value: int) -> int:
        """Of an id among the shard's, -1 if it isn't there."""
        k = int(np.searchsorted(self.symbols, value))
        return k if k < len(self.symbols) and self.symbols[k] == value else -1

    def _ones(self, level: int, i: int) -> int:
        """Ones before position i: two stored ranks and the bits of one block."""
        c, r = divmod(i, _CHUNK)
        if c == self.before.shape[1] - 1:
            return int(self.before[level, c])
        ranks, bits = self.chunk(level, c)
        block = r // _BLOCK
        if block >= len(ranks):
            return int(self.before[level, c + 1])
        part = bits[block * (_BLOCK // 8) : r // 8 + 1]
        whole = r // 8 - block * (_BLOCK // 8)
        last = int(part[whole]) & ((1 << r % 8) - 1) if r % 8 else 0
        return int(self.before[level, c]) + int(ranks[block]) + int(np.bitwise_count(part[:whole]).sum()) + last.bit_count()

    def _place(self, level: int, bit: int, k: int) -> int:
        """Position of the k-th (from 0) such bit: a search over stored ranks, then within one block."""
        before = self.before[level][:-1]
        before = before if bit else np.arange(len(before)) * _CHUNK - before
        c = int(np.searchsorted(before, k, "right")) - 1
        ranks, bits = self.chunk(level, c)
        ranks = ranks.astype(np.int64) if bit else np.arange(len(ranks)) * _BLOCK - ranks
        k -= int(before[c])
        block = int(np.searchsorted(ranks, k, "right")) - 1
        found = np.unpackbits(bits[block * (_BLOCK // 8) : (block + 1) * (_BLOCK // 8)], bitorder="little")
        return c * _CHUNK + block * _BLOCK + int(np.flatnonzero(found == bit)[k - int(ranks[block])])

    def access(self, i: int) -> int:
        value = 0
        for level in range(self.levels):
            bit = int(self.chunk(level, i // _CHUNK)[1][i % _CHUNK // 8]) >> i % 8 & 1
            ones = self._ones(level, i)
            i = self.zeros[level] + ones if bit else i - ones
            value = value << 1 | bit
        return int(self.symbols[value])

    def count(self, value: int, low: int, high: int) -> int:
        """Occurrences of an id in [low, high)."""
        value = self._number(value)
        if value < 0:
            return 0
        for level in range(self.levels):
            a, b = self._ones(level, low), self._ones(level, high)
            low, high = (self.zeros[level] + a, self.zeros[level] + b) if value >> (self.levels - 1 - level) & 1 else (low - a, high - b)
        return high - low

    def find(self, value: int, k: int) -> int:
        """Position of the k-th (from 0) occurrence of an id; -1 if there are fewer."""
        if k >= self.count(value, 0, self.n):
            return -1
        value, at = self._number(value), 0
        for level in range(self.levels):
            ones = self._ones(level, at)
            at = self.zeros[level] + ones if value >> (self.levels - 1 - level) & 1 else at - ones
        at += k
        for level in reversed(range(self.levels)):
            bit = value >> (self.levels - 1 - level) & 1
            at = self._place(level, bit, at - self.zeros[level] if bit else at)
        return at

    def decode(self) -> np.ndarray:
        """All ids in order: the stable partitions are undone from the last level up."""
        kind = np.uint16 if self.levels <= 16 else np.uint32
        now = np.zeros(self.n, kind)
        for level in reversed(range(self.levels)):
            packed = [self.chunk.__wrapped__(level, c)[1] for c in range(self.before.shape[1] - 1)]
            bits = np.unpackbits(np.concatenate(packed) if packed else np.zeros(0, np.uint8), count=self.n, bitorder="little").view(bool)
            up = np.empty(self.n, kind)
            up[~bits] = now[: self.zeros[level]]
            up[bits] = now[self.zeros[level] :] | kind(1 << (self.levels - 1 - level))
            now = up
        return self.symbols[now] if self.n else np.zeros(0, np.uint32)


def _planes(ids: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The different ids, ascending, and packed bits of each level, little end first."""
    symbols = np.flatnonzero(np.bincount(ids)).astype(np.uint32)
    number = np.zeros(int(symbols[-1]) + 1 if len(symbols) else 1, np.uint16 if len(symbols) <= 1 << 16 else np.uint32)
    number[symbols] = np.arange(len(symbols))
    now, planes = number[ids], []
    for level in reversed(range(max(1, (max(1, len(symbols)) - 1).bit_length()))):
        bits = (now & number.dtype.type(1 << level)).astype(bool)
        planes.append(np.packbits(bits, bitorder="little"))
        if level:
            now = np.concatenate((now[~bits], now[bits]))
    return symbols, planes


def pack_shard(doc_ids: list, lengths: list[int], ids: np.ndarray) -> bytes:
    """The file: magic; numbers of documents, ids, different ids, planes and bytes of the head; the compressed head (document
    ids with a null mask, lengths, the different ids, ones before each chunk, bytes of each chunk); then the chunks, each compressed by itself: ranks of its blocks, bits."""
    symbols, planes = _planes(ids)
    pack, body, sizes = zstandard.ZstdCompressor(level=1).compress, [], []
    n_chunks = -(-len(ids) // _CHUNK)
    before = np.zeros((len(planes), n_chunks + 1), np.int64)
    for level, plane in enumerate(planes):
        ones = np.bitwise_count(np.pad(plane, (0, -len(plane) % (_BLOCK // 8)))).reshape(-1, _BLOCK // 8).sum(axis=1, dtype=np.int64)
        for c in range(n_chunks):
            own = ones[c * (_CHUNK // _BLOCK) : (c + 1) * (_CHUNK // _BLOCK)]
            before[level, c + 1] = before[level, c] + own.sum()
            ranks = np.concatenate(([0], np.cumsum(own)[:-1])).astype(np.uint32)
            body.append(pack(ranks.tobytes() + plane[c * (_CHUNK // 8) : (c + 1) * (_CHUNK // 8)].tobytes()))
            sizes.append(len(body[-1]))
    head = pack(np.array([x or 0 for x in doc_ids], np.int64).tobytes() + np.array([x is None for x in doc_ids], bool).tobytes() + np.array(lengths, np.uint64).tobytes() + symbols.tobytes() + before.tobytes() + np.array(sizes, np.uint64).tobytes())
    return MAGIC + struct.pack("<QQQBQ", len(doc_ids), len(ids), len(symbols), len(planes), len(head)) + head + b"".join(body)


def unpack_shard(blob: bytes) -> tuple[list, np.ndarray, WaveletMatrix]:
    """Document ids, lengths, matrix. Chunks are decompressed as they are asked for."""
    if blob[:4] != MAGIC:
        raise ValueError("not a token shard")
    docs, n, kinds, levels, size = struct.unpack_from("<QQQBQ", blob, 4)
    start, unpack, n_chunks = 4 + struct.calcsize("<QQQBQ"), zstandard.ZstdDecompressor().decompress, -(-n // _CHUNK)
    head, at = unpack(blob[start : start + size]), 17 * docs + 4 * kinds
    keys = np.frombuffer(head, np.int64, docs).tolist()
    doc_ids = [None if null else k for k, null in zip(keys, np.frombuffer(head, bool, docs, 8 * docs).tolist(), strict=True)]
    before = np.frombuffer(head, np.int64, levels * (n_chunks + 1), at).reshape(levels, n_chunks + 1)
    edges = start + size + np.concatenate(([0], np.cumsum(np.frombuffer(head, np.uint64, levels * n_chunks, at + before.nbytes)))).astype(np.int64)

    def chunk(level: int, c: int) -> tuple[np.ndarray, np.ndarray]:
        k = level * n_chunks + c
        raw, blocks = unpack(blob[edges[k] : edges[k + 1]]), -(-min(_CHUNK, n - c * _CHUNK) // _BLOCK)
        return np.frombuffer(raw, np.uint32, blocks), np.frombuffer(raw, np.uint8, offset=4 * blocks)

    return doc_ids, np.frombuffer(head, np.uint64, docs, 9 * docs).astype(np.int64), WaveletMatrix(n, np.frombuffer(head, np.uint32, kinds, 17 * docs), before, chunk)


#: Latin letters and then ASCII punctuation: normaliser and word pattern make exactly these two words of it.
_WORD = r"^(?P<letters>[A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{FF}]+)(?P<after>[!-/:-@\[-`{-~]*)$"


#: Normaliser, word pattern and mark of a word's end with which white space has no token and no word goes past it. Fixed values of the vocabulary files.
_WORDWISE = (
    {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
    "</w>",
)


def wordwise(tokenizer_json: str) -> bool:
    """Whether pieces between white space may be tokenised one by one, and in lower case: for tokenizers that are known to work so alone."""
    told = json.loads(tokenizer_json)
    steps = (told.get("pre_tokenizer") or {}).get("pretokenizers") or [None]
    return (told.get("normalizer"), steps[0], told.get("model", {}).get("end_of_word_suffix")) == _WORDWISE and not told.get("post_processor")


class Encoder:
    """Ids of whole texts. With a tokenizer whose words end at white space (see wordwise), pieces between ASCII white space are tokenised
    one by one and remembered, letters and the punctuation after them apart; with any other, or `direct`, each text is tokenised whole."""

    def __init__(self, tokenizer_json: str, direct: bool = False, remember: int = 200_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.direct, self.remember = Tokenizer.from_str(tokenizer_json), direct or not wordwise(tokenizer_json), remember
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[k for t, k in vocabulary.items() if t.endswith("</w>")]] = True
        self.known: dict[str, bytes] = {"": b""}

    def _learn(self, new: list[str], alone: bool) -> None:
        """alone: each is one word by itself, so many are tokenised in one call and told apart by the ends of words."""
        for k in range(0, len(new), 4096):
            part = new[k : k + 4096]
            if alone:
                ids = np.array(self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, np.uint32)
                edges = (4 * (np.flatnonzero(self.ends[np.minimum(ids, len(self.ends) - 1)]) + 1)).tolist()
                if len(edges) == len(part):
                    raw = ids.tobytes()
                    self.known.update(zip(part, [raw[a:b] for a, b in zip([0, *edges[:-1]], edges, strict=True)], strict=True))
                    continue
            self.known.update(zip(part, [np.array(e.ids, np.uint32).tobytes() for e in self.tokenizer.encode_batch_fast(part, add_special_tokens=False)], strict=True))

    def encode(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, each with the end id; lengths."""
        if self.direct:
            rows = [np.array([*self.tokenizer.encode(t or "", add_special_tokens=False).ids, end], np.uint32) for t in texts.to_pylist()]
            return np.concatenate([np.zeros(0, np.uint32), *rows]), np.array([len(r) for r in rows], np.int64)
        split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        edges = split.offsets.to_numpy()
        found = split.values.slice(edges[0], edges[-1] - edges[0]).dictionary_encode()
        pieces = found.dictionary
        parts = pc.extract_regex(pieces, _WORD)
        simple = pc.and_(parts.is_valid(), pc.invert(pc.match_substring(pieces, "<|")))
        first = pc.if_else(simple, pc.utf8_lower(pc.struct_field(parts, 0)), pieces)
        words = pa.chunked_array([first, pc.if_else(simple, pc.struct_field(parts, 1), "")]).combine_chunks().dictionary_encode()
        different = words.dictionary.to_numpy(zero_copy_only=False).tolist()
        if len(self.known) + len(different) > self.remember:  # words of these texts are the likeliest to come again
            self.known = {"": b""} | {w: self.known[w] for w in different if w in self.known}
        whole = set(pc.unique(pc.filter(pieces, pc.invert(simple))).to_numpy(zero_copy_only=False).tolist())
        new = [w for w in different if w not in self.known]
        self._learn([w for w in new if w not in whole], True)
        self._learn([w for w in new if w in whole], False)
        ids = [self.known[w] for w in different]
        sizes = np.fromiter(map(len, ids), np.int32, len(ids)) // 4
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), pa.array(np.frombuffer(b"".join(ids), np.uint32)))
        numbers, at, n = words.indices.to_numpy(), found.indices.to_numpy(), len(pieces)
        order = np.empty(2 * len(at), np.int32)
        order[::2], order[1::2] = numbers[:n][at], numbers[n:][at]
        taken = lists.take(pa.array(order))
        upto = taken.offsets.to_numpy()[2 * (edges - edges[0])]
        return np.insert(taken.flatten().to_numpy(), upto[1:], np.uint32(end)), np.diff(upto).astype(np.int64) + 1


def _encoder(held: dict) -> Encoder:
    """Kept with the broadcast tokenizer, so that a worker's later tasks find the words of earlier ones."""
    if "encoder" not in held:
        held["encoder"] = Encoder(held["json"], held["direct"])
    return held["encoder"]


def _gathered(batches, most: int = 6 << 20):
    """Joins small batches to some MB, in which words repeat more."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= most:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
    if sum(b.num_rows for b in held):
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _slices(texts: pa.Array, most: int = 6 << 20):
    """(start, rows) of runs of texts of some MB together, or one text."""
    sizes, at = pc.fill_null(pc.binary_length(texts), 0).to_numpy(), 0
    upto = np.cumsum(sizes)
    while at < len(sizes):
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + most, "right")))
        yield at, end - at
        at = end


def write_shards(docs: DataFrame, path: str, tokenizer_json: str, end: int = 2, shard_ids: int = SHARD_IDS, direct: bool = False) -> None:
    """Encodes docs(doc_id long, text) and writes shard files, as rows (part, seq, first_id, n_ids, file), to a table at path.

    Shards follow each other in ascending doc_id (null first; equal ids by their text's hash),
    each of shard_ids ids or a little more, as documents are never cut: a text of more ids
    than that is a shard, which must be less than 2 GB. Null text
    counts as empty: the end id alone. An empty table makes an empty one.
    Spark's writer commits whole files only, so a lost executor leaves no trace.
    """
    model = docs.sparkSession.sparkContext.broadcast({"json": tokenizer_json, "direct": direct})

    def shards(batches):
        from pyspark import TaskContext

        encoder, part, seq = _encoder(model.value), TaskContext.get().partitionId(), 0
        keys, lengths, ids, n = [], [], [], 0

        def shard():
            file = pack_shard(keys, lengths, np.concatenate(ids))
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([seq], pa.int64()), pa.array([keys[0]], pa.int64()), pa.array([n], pa.int64()), pa.array([file], pa.binary())], ["part", "seq", "first_id", "n_ids", "file"])

        for batch in _gathered(batches):
            for k, rows in _slices(batch.column(1)):
                some = batch.slice(k, rows)
                got, sizes = encoder.encode(some.column(1), end)
                edge = 0
                for key, size in zip(some.column(0).to_pylist(), sizes.tolist(), strict=True):
                    keys.append(key)
                    lengths.append(size)
                    ids.append(got[edge : edge + size])
                    edge, n = edge + size, n + size
                    if n >= shard_ids:
                        yield shard()
                        keys, lengths, ids, n, seq = [], [], [], 0, seq + 1
                        pa.default_memory_pool().release_unused()
        if keys:
            yield shard()

    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"), "text")
    small_batches(ordered).mapInArrow(shards, "part long, seq long, first_id long, n_ids long, file binary").write.option("maxRecordsPerFile", 8).option("compression", "none").parquet(path)


def read_shards(spark, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, read back from the files at path."""
    kind = T.StructType().add("part", "long").add("seq", "long").add("doc_id", "long").add("at", "long").add("n_tokens", "long").add("ids_crc32", "long")

    def documents(batches):
        for batch in batches:
            for part, seq, file in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                keys, lengths, matrix = unpack_shard(file)
                ids, edges = matrix.decode().astype("<u4", copy=False), np.concatenate(([0], np.cumsum(lengths)))
                sums = [zlib.crc32(ids[a:b]) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
                n = len(keys)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, part)), pa.array(np.full(n, seq)), pa.array(keys, pa.int64()), pa.array(edges[:-1]), pa.array(lengths), pa.array(sums, pa.int64())], kind.names)

    stored = spark.read.schema("part long, seq long, first_id long, n_ids long, file binary").parquet(path)
    # One row a shard of two million ids: the only rows that a single task orders.
    before = Window.orderBy(F.col("first_id").asc_nulls_first(), "part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    offsets = stored.select("part", "seq", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("base"))
    found = stored.select("part", "seq", "file").mapInArrow(documents, kind)
    return found.join(offsets, ["part", "seq"]).select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def token_output(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Writes docs(doc_id, text) as token shards in the shared folder and reads them back; see write_shards and read_shards."""
    import uuid

    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    with open(tokenizer, encoding="utf-8") as f:
        tokenizer_json = f.read()
    path = f"{shared_dir(docs.sparkSession)}/token-shards-{uuid.uuid4().hex}"
    write_shards(docs, path, tokenizer_json)
    return read_shards(docs.sparkSession, path)


def op8_token_output(spark, sf_dir):
    return token_output(table(spark, sf_dir, "documents"))
