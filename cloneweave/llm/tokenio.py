"""Token ids in length-delimited binary records, with a separate offset index.

A record is: length of the data (8 bytes, little endian), masked CRC-32 of
those 8 bytes, the data, masked CRC-32 of the data.  The data are a flag byte
(1: the key is null), the key (8 bytes), the width of an id (2 or 4), and the
ids.  Files are in ascending key order, one a range partition; the index, a
Parquet table (file, offset, bytes, key, tokens before it in its file), serves
shuffled reads.  A task writes under a name of its own attempt and returns its
index rows, so only finished tasks' files are ever read.

Defined results: null texts are empty; null keys come first; rows of equal
keys stand by a hash of their text; every document ends with the end id, so
an empty one has one token; an empty table gives an empty index.
"""

from __future__ import annotations

import io
import json
import os
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloneweave.llm import blobs
from cloneweave.llm.common import fresh_path, staged

_known: dict[str, tuple] = {}
# The normalizer and the splitter of a tokenizer whose texts may be encoded word by word.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLITTER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}


@dataclass(frozen=True)
class TokenParams:
    tokenizer: str = ""  # path of a tokenizers JSON file
    end_id: int = 1
    cache: int = 1 << 20  # words a worker remembers
    marks: int = 1 << 23  # places at which a worker marks words that it saw once, a byte each
    longest: int = 64  # characters of a word that is remembered
    chunk_bytes: int = 4 << 20  # text whose words are numbered at once
    read_bytes: int = 32 << 20


def masked(crc: int) -> int:
    return (((crc >> 15) | (crc << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def frame(data: bytes) -> bytes:
    size = len(data).to_bytes(8, "little")
    return b"".join((size, masked(zlib.crc32(size)).to_bytes(4, "little"), data, masked(zlib.crc32(data)).to_bytes(4, "little")))


def unframe(read) -> bytes | None:
    """The next record's data from read(n), None at the end; raises if a checksum doesn't hold."""
    head = read(12)
    if not head:
        return None
    if len(head) < 12 or masked(zlib.crc32(head[:8])) != int.from_bytes(head[8:], "little"):
        raise ValueError("record length is damaged")
    n = int.from_bytes(head[:8], "little")
    body = read(n + 4)
    if len(body) < n + 4 or masked(zlib.crc32(body[:n])) != int.from_bytes(body[n:], "little"):
        raise ValueError("record data are damaged")
    return body[:n]


class Encoder:
    """Encodes whole texts with the tokenizers library, each distinct word once.

    White space always ends a token of the tokenizer's splitter and leaves
    none, so a text's ids are its words' ids in order.  Arrow splits the texts
    and numbers their words, and numpy puts the words' ids in the texts' order.
    A letter before a final full stop or comma ends a token too.  Texts that
    hold a special token's string, in small letters or capitals, are encoded
    whole, and so are all texts where the tokenizer's normalizer or splitter is
    another than these.  ``whole`` is the plain way, for tests.

    A worker outlives its task, and so does what it remembers: only words that
    came twice are remembered, as most words of a corpus come once.
    """

    def __init__(self, path: str, p: TokenParams):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core; each thread would keep memory of its own
        from tokenizers import Tokenizer

        self.tokenizer, self.p, self.cache = Tokenizer.from_file(path), p, {}
        self.seen, self.marked = np.zeros(p.marks, dtype=bool), 0
        self.width = 2 if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4
        self.dtype = f"<u{self.width}"
        self.special = [t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values()]
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.by_word = spec.get("normalizer") == NORMALIZER and spec.get("pre_tokenizer") == SPLITTER and spec["model"].get("type") == "BPE"
        suffix = spec["model"].get("end_of_word_suffix")
        last = {token: i for token, i in self.tokenizer.get_vocab().items() if suffix and token.endswith(suffix)}
        self.ends = np.zeros(max(1 << 16, self.tokenizer.get_vocab_size(with_added_tokens=True)), dtype=bool)
        if sum(len(token) == len(suffix) + 1 for token in last) == 256:  # any byte can end a word
            self.ends[list(last.values())] = True

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=self.dtype).tobytes()

    def _fast(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype=self.dtype) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encoded(self, words: list[str]) -> dict[str, bytes]:
        """Ids of each word.  Words of letters only are encoded a line at a time.

        Each of them has at least one last token, marked by the vocabulary's
        suffix; where a line has as many of these as words, it is cut there,
        and otherwise its words are encoded one by one.
        """
        out, longest = {}, self.p.longest
        letters = [w for w in words if w.isalpha() and len(w) <= longest]
        single = [w for w in words if not w.isalpha() or len(w) > longest]
        lines = [letters[i : i + 256] for i in range(0, len(letters), 256)]
        for first in range(0, len(lines), 16):
            some = lines[first : first + 16]
            for line, ids in zip(some, self._fast([" ".join(line) for line in some])):
                cuts = np.flatnonzero(self.ends[ids])
                if len(cuts) != len(line) or cuts[-1] != len(ids) - 1:
                    single += line
                    continue
                flat, cuts = ids.tobytes(), ((cuts + 1) * self.width).tolist()
                out.update(zip(line, [flat[a:b] for a, b in zip([0, *cuts], cuts)]))
        for first in range(0, len(single), 4096):
            some = single[first : first + 4096]
            out.update(zip(some, (ids.tobytes() for ids in self._fast(some))))
        return out

    def again(self, words: list[str]) -> list[bool]:
        """Whether each word was marked before, or one that shares its place; all are marked now."""
        if self.marked + len(words) > len(self.seen) // 2:
            self.seen[:], self.marked = False, 0
        places = np.fromiter(map(hash, words), dtype=np.int64, count=len(words)) % len(self.seen)
        found = self.seen[places]
        self.seen[places] = True
        self.marked += len(words) - int(found.sum())
        return found.tolist()

    def learn(self, words: list[str]) -> list[bytes]:
        """Ids of words that the cache lacks; it remembers those that come again, and is emptied where it would hold more than it may."""
        if len(self.cache) + len(words) > self.p.cache:
            self.cache = {}
        cache = self.cache
        tails = [w[-1] if w.endswith((".", ",")) and w[-2:-1] < "\u0250" and w[-2:-1].isalpha() else "" for w in words]
        heads = [w[:-1] if tail else w for w, tail in zip(words, tails)]
        parts = {*heads, *tails}
        ids = {w: cache[w] for w in parts if w in cache}
        new = [w for w in parts if w not in ids]
        ids |= self.encoded(new)
        out = [ids[head] + ids[tail] if tail else ids[head] for head, tail in zip(heads, tails)]
        whole = [w for w, tail in zip(words, tails) if tail]
        ids.update((w, x) for w, x, tail in zip(words, out, tails) if tail)
        fresh = new + whole
        cache.update((w, ids[w]) for w, known in zip(fresh, self.again(fresh)) if known and len(w) <= self.p.longest)
        if len(cache) > self.p.cache:
            self.cache = {}
        return out

    def batch(self, texts: list[str | None] | pa.Array) -> list[bytes]:
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        if not self.by_word:
            return [self.whole(x) if x else b"" for x in texts.to_pylist()]
        size, out, first = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64), [], 0
        upto = np.cumsum(size)
        while first < len(texts):  # about chunk_bytes at a time, and one text at least
            begin = upto[first] - size[first]
            n = max(1, int(np.searchsorted(upto, begin + self.p.chunk_bytes, "right")) - first)
            out += self._chunk(texts.slice(first, n))
            pa.default_memory_pool().release_unused()  # else the worker keeps the largest chunk's
            first += n
        return out

    def _chunk(self, texts: pa.Array) -> list[bytes]:
        low = pc.ascii_lower(pc.fill_null(texts, ""))
        special = np.zeros(len(low), dtype=bool)
        for x in self.special:
            special |= pc.match_substring(low, x).to_numpy(zero_copy_only=False)
        if special.any():
            low = pc.if_else(pa.array(special), "", low)
        split = pc.ascii_split_whitespace(low)
        numbered = split.flatten().dictionary_encode()
        words = numbered.dictionary.to_numpy(zero_copy_only=False).tolist()
        found = list(map(self.cache.get, words))
        lacking = [i for i, ids in enumerate(found) if ids is None]
        for i, ids in zip(lacking, self.learn([words[i] for i in lacking]) if lacking else ()):
            found[i] = ids
        ids = np.frombuffer(b"".join(found), dtype=self.dtype)
        sizes = np.fromiter(map(len, found), dtype=np.int64, count=len(found)) // self.width
        starts = np.cumsum(sizes) - sizes
        word = numbered.indices.to_numpy(zero_copy_only=False)
        upto, parts = np.concatenate([[0], np.cumsum(sizes[word])]), []
        for i in range(0, len(word), 1 << 20):  # words; a single text may have very many
            some = word[i : i + (1 << 20)]
            each = sizes[some]
            place = np.repeat(starts[some] - (upto[i : i + len(some)] - upto[i]), each)
            place += np.arange(len(place))
            parts.append(ids[place].tobytes())
        flat = b"".join(parts)
        ends = np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False))
        bounds = [0, *(upto[ends] * self.width).tolist()]
        out = [flat[a:b] for a, b in zip(bounds, bounds[1:])]
        for i in np.flatnonzero(special).tolist():
            out[i] = self.whole(texts[i].as_py())
        return out


def encoder(path: str, p: TokenParams) -> Encoder:
    """One for each worker process, kept between tasks."""
    if path not in _known:
        _known[path] = Encoder(path, p)
    return _known[path]


def write_records(documents: DataFrame, params: TokenParams, id_col: str = "doc_id", text_col: str = "text") -> tuple[str, DataFrame]:
    """Folder of record files, and their index: part, file, n, doc_id, offset, bytes, before, n_tokens."""
    p = params
    folder = fresh_path(documents.sparkSession, "tokens")
    rows = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).withColumn("_tie", F.xxhash64("text"))
    rows = rows.repartitionByRange("doc_id", "_tie").sortWithinPartitions("doc_id", "_tie").drop("_tie")

    def write(batches):
        part, enc, at, before, n = TaskContext.get().partitionId(), encoder(p.tokenizer, p), 0, 0, 0
        end = np.array([p.end_id], dtype=enc.dtype).tobytes()
        name, out = None, None
        try:
            for b in batches:
                if b.num_rows and out is None:
                    name = blobs.attempt_name(folder, part, ".rec")
                    out = blobs.writer(name)
                keys, rec = b["doc_id"].to_pylist(), []
                for first in range(0, len(keys), 1024):
                    for key, ids in zip(keys[first : first + 1024], enc.batch(b["text"].slice(first, 1024))):
                        ids += end
                        data = frame(b"".join((bytes([key is None]), (key or 0).to_bytes(8, "little", signed=True), bytes([enc.width]), ids)))
                        out.write(data)
                        rec.append((part, name, n, key, at, len(data), before, len(ids) // enc.width))
                        at, before, n = at + len(data), before + len(ids) // enc.width, n + 1
                if rec:
                    yield pa.record_batch([pa.array(list(x)) if i != 3 else pa.array(list(x), pa.int64()) for i, x in enumerate(zip(*rec))], ["part", "file", "n", "doc_id", "offset", "bytes", "before", "n_tokens"])
        finally:
            if out is not None:
                out.close()

    return folder, staged(rows.mapInArrow(write, "part long, file string, n long, doc_id long, offset long, bytes long, before long, n_tokens long"), "tokenindex")


def read_records(index: DataFrame, params: TokenParams) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every record, read from the files in byte ranges that the index gives."""
    p = params
    spark = index.sparkSession
    totals = index.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect()  # a row a file
    base, done = [], 0
    for r in totals:
        base.append((r["part"], done))
        done += r["n"]
    bases = spark.createDataFrame(base, "part long, base long")
    ranges = index.groupBy("part", "file", F.floor(F.col("offset") / p.read_bytes).alias("_r")).agg(F.min("offset").alias("begin"), F.max(F.col("offset") + F.col("bytes")).alias("end"), F.min("before").alias("before")).join(bases, "part")

    ranges = staged(ranges.select("file", "begin", "end", "before", "base"), "ranges")

    def read(batches):
        for b in batches:
            for r in b.to_pylist():
                system, path = blobs.opened(r["file"])
                rows, start = [], r["base"] + r["before"]
                with system.open_input_file(path) as f:  # one request a range, of read_bytes and a record at most
                    f.seek(r["begin"])
                    block = io.BytesIO(f.read(r["end"] - r["begin"]))
                while (data := unframe(block.read)) is not None:
                    ids = np.frombuffer(data, dtype=f"<u{data[9]}", offset=10)
                    rows.append((None if data[0] else int.from_bytes(data[1:9], "little", signed=True), start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    start += len(ids)
                    if len(rows) == 4096:
                        yield _table(rows)
                        rows = []
                if rows:
                    yield _table(rows)

    # a number of its own: a range is a few bytes here, and adaptive execution would merge them all
    return ranges.repartition(max(1, ranges.count()), "file", "begin").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _table(rows: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(list(x), pa.int64()) for x in zip(*rows)], ["doc_id", "start", "n_tokens", "ids_crc32"])
