"""Token ids as Arrow files of fixed-size-list batches.

A data file is Arrow's stream of record batches closed by its footer (the IPC file format).  Every row is
one sequence of ``SEQUENCE`` ids and its mask, both fixed-size lists, so row ``r`` of a memory-mapped file
is a slice at a known place.  Documents follow each other without gaps in ascending id; only the end of a
file is padded, where the mask is false.  A second Arrow file lists the file's documents and their lengths.
"""

from __future__ import annotations

import contextlib
import ctypes
import json
import uuid
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.llm.common import bounded_batches, id_text, new_folder, stored, with_ids

SEQUENCE = 2048
BATCH_SEQUENCES = 128
END_ID = 2
CACHE_PIECES = 300_000
#: Pieces encoded in one call, and how a byte-level vocabulary writes a blank.
GROUP, BLANK = 64, "\u0120"
#: Characters of text that are cut into pieces at once; a longer text is cut alone.
SLICE_CHARS = 4_000_000

MANIFEST = "part int, path string, index_path string, n_docs long, n_tokens long"


class PieceEncoder:
    """Whole-text encodings, put together from remembered encodings of the pieces between blanks.

    A byte-level tokenizer splits its text before merging and lets a blank lead the piece after it, so
    text cut before single blanks encodes piece by piece to the same ids.  Where a piece starts with
    more white space, or the tokenizer is of another kind, the text is encoded at once.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 65536 else "<u4")
        # Of this part alone: the whole tokenizer as text, parsed, takes more memory than the tokenizer.
        split = json.loads(self.tokenizer.pre_tokenizer.__getstate__()) if self.tokenizer.pre_tokenizer is not None else {}
        self.by_pieces = self.tokenizer.normalizer is None and split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", True)
        self.pieces: dict[str, bytes] = {}
        self.leads = np.zeros(self.tokenizer.get_vocab_size() + 1, bool)  # ids of tokens that start with a blank
        for token, number in self.tokenizer.get_vocab().items():
            self.leads[number] = token.startswith(BLANK)

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.dtype).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_pieces(self, pieces: list[str]) -> list[bytes]:
        """The encoding of each piece with a blank before it; many at once, cut where a blank leads."""
        groups = [pieces[k : k + GROUP] for k in range(0, len(pieces), GROUP)]
        out: list[bytes] = []
        for group, e in zip(groups, self.tokenizer.encode_batch_fast(["".join([f" {w}" for w in g]) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, self.dtype)
            starts = np.flatnonzero(self.leads[ids]).tolist()
            if len(starts) != len(group):
                out += self._encode([f" {w}" for w in group])
                continue
            raw, size = ids.tobytes(), self.dtype.itemsize
            out += [raw[a * size : b * size] for a, b in zip(starts, [*starts[1:], len(ids)], strict=True)]
        return out

    def _known(self, pieces: list[str]) -> list[bytes]:
        """The encoding of each of distinct pieces with a blank before it; empty where a piece has none of its own."""
        found = list(map(self.pieces.get, pieces))
        wanted = [w for w, b in zip(pieces, found, strict=True) if b is None]
        plain = [w for w in wanted if w and not w[0].isspace()]
        fresh = dict.fromkeys(wanted, b"") | dict(zip(plain, self._encode_pieces(plain), strict=True))
        if len(self.pieces) + len(fresh) <= CACHE_PIECES:
            self.pieces.update(fresh)
        return [fresh[w] if b is None else b for w, b in zip(pieces, found, strict=True)]

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        if not self.by_pieces:
            return [np.frombuffer(b, self.dtype) for b in self._encode(texts)]
        if not texts:
            return []
        cut = pc.split_pattern(pa.array(texts, pa.string()), " ")
        firsts = cut.offsets.to_numpy()
        distinct = pc.dictionary_encode(cut.flatten())
        blobs = self._known(distinct.dictionary.to_numpy(zero_copy_only=False).tolist())
        which = distinct.indices.to_numpy().astype(np.int64)
        sizes = np.fromiter(map(len, blobs), np.int64, len(blobs))
        lacking = (sizes == 0)[which]
        # The first piece of a text has no blank ahead, so it is encoded as the text's own.
        lacking[firsts[:-1]] = False
        which[firsts[:-1]] = len(blobs) + np.arange(len(texts))
        heads = self._encode([t[: k if (k := t.find(" ")) >= 0 else len(t)] for t in texts])
        sizes = np.r_[sizes, np.fromiter(map(len, heads), np.int64, len(heads))] // self.dtype.itemsize
        ids, starts = np.frombuffer(b"".join(blobs + heads), self.dtype), np.cumsum(sizes) - sizes
        lengths = sizes[which]
        ends = np.cumsum(lengths)
        whole = ids[np.repeat(starts[which] - (ends - lengths), lengths) + np.arange(ends[-1])]
        bounds = np.r_[0, ends[firsts[1:] - 1]].tolist()
        out = [whole[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        for k in np.flatnonzero(np.logical_or.reduceat(lacking, firsts[:-1])).tolist():
            out[k] = np.frombuffer(self._encode([texts[k]])[0], self.dtype)
        return out


def slices(texts: list[str], chars: int = SLICE_CHARS) -> Iterator[list[str]]:
    """The texts in order, about ``chars`` characters at a time."""
    start = size = 0
    for k, text in enumerate(texts, 1):
        size += len(text)
        if size >= chars or k == len(texts):
            yield texts[start:k]
            start, size = k, 0


_encoders: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    """One encoder a worker and tokenizer: what it remembers serves later tasks too."""
    if path not in _encoders:
        _encoders[path] = PieceEncoder(path)
    return _encoders[path]


def forget_encoders() -> None:
    """Give the memory of this worker's encoders back to the system: workers live on, and the tasks after these need it."""
    if _encoders:
        _encoders.clear()
        with contextlib.suppress(OSError, AttributeError):  # another C library keeps it for itself
            ctypes.CDLL(None).malloc_trim(0)


class SequenceFile:
    """Writes one data file, batch by batch; holds less than a batch of ids."""

    def __init__(self, uri: str, dtype: np.dtype, sequence: int) -> None:
        store, path = pyarrow.fs.FileSystem.from_uri(uri)
        self.sequence, self.dtype = sequence, dtype
        self.schema = pa.schema([pa.field("input_ids", pa.list_(pa.from_numpy_dtype(dtype), sequence)), pa.field("mask", pa.list_(pa.bool_(), sequence))])
        self.sink = store.open_output_stream(path)
        self.writer = pa.ipc.new_file(self.sink, self.schema)
        self.held: list[np.ndarray] = []
        self.n_held = 0

    def add(self, ids: np.ndarray) -> None:
        self.held.append(ids)
        self.n_held += len(ids)
        if self.n_held >= self.sequence * BATCH_SEQUENCES:
            self._flush(last=False)

    def _flush(self, last: bool) -> None:
        ids = np.concatenate([*self.held, np.zeros(0, self.dtype)])
        full = len(ids) if last else len(ids) // (self.sequence * BATCH_SEQUENCES) * self.sequence * BATCH_SEQUENCES
        self.held, self.n_held = [ids[full:]], len(ids) - full
        padding = -full % self.sequence
        values, mask = np.r_[ids[:full], np.zeros(padding, self.dtype)], np.r_[np.ones(full, bool), np.zeros(padding, bool)]
        for k in range(0, len(values), self.sequence * BATCH_SEQUENCES):
            part = slice(k, k + self.sequence * BATCH_SEQUENCES)
            lists = [pa.FixedSizeListArray.from_arrays(pa.array(x[part]), self.sequence) for x in (values, mask)]
            self.writer.write_batch(pa.record_batch(lists, schema=self.schema))

    def close(self) -> None:
        self._flush(last=True)
        self.writer.close()
        self.sink.close()


def make_folder(uri: str) -> None:
    store, path = pyarrow.fs.FileSystem.from_uri(uri)
    store.create_dir(path, recursive=True)


def write_tokens(docs: DataFrame, tokenizer: str, *, folder: str | None = None, doc_id: str = "doc_id", text: str = "text", end_id: int = END_ID, sequence: int = SEQUENCE) -> DataFrame:
    """Encode every text, append ``end_id`` to each, and write the files; returns their manifest.

    ``tokenizer`` is the path of a tokenizer file, ``folder`` a URI that executors can write to (by
    default a new folder in the shared one).  Documents are in ascending id over all files, null ids
    first, rows of equal id by text.  Null and empty texts give the end id alone.  Every task attempt
    writes under names of its own and only attempts that succeed are in the manifest, so a lost executor
    leaves unlisted files at worst.  An empty table gives an empty manifest.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    folder = folder or new_folder(spark, "tokens")
    make_folder(folder)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, part = encoder(tokenizer), TaskContext.get().partitionId()
        base = f"{folder}/part-{part:06d}-{uuid.uuid4().hex}"
        data, index, sink, n_docs, n_tokens = None, None, None, 0, 0
        schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64())])
        for pdf in batches:
            if data is None:
                data = SequenceFile(f"{base}.arrow", encode.dtype, sequence)
                store, path = pyarrow.fs.FileSystem.from_uri(f"{base}.index.arrow")
                index = pa.ipc.new_file(sink := store.open_output_stream(path), schema)
            end = np.array([end_id], encode.dtype)
            lengths = np.zeros(len(pdf), np.int64)
            every = (ids for own in slices([t or "" for t in pdf["text"]]) for ids in encode(own))
            for k, ids in enumerate(every):
                data.add(ids)
                data.add(end)
                lengths[k] = len(ids) + 1
            index.write_batch(pa.record_batch([pa.array(pdf["doc_id"], pa.string()).cast(pa.int64()), pa.array(lengths)], schema=schema))
            n_docs, n_tokens = n_docs + len(pdf), n_tokens + int(lengths.sum())
        if data is not None:
            data.close()
            index.close()
            sink.close()
            yield pd.DataFrame([(part, f"{base}.arrow", f"{base}.index.arrow", n_docs, n_tokens)], columns=["part", "path", "index_path", "n_docs", "n_tokens"])

    narrow = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    ordered = narrow.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return stored(ordered.select(id_text("doc_id").alias("doc_id"), "text").mapInPandas(run, MANIFEST), "token-manifest")


def _opened(uri: str) -> Any:
    store, path = pyarrow.fs.FileSystem.from_uri(uri)
    return pa.ipc.open_file(store.open_input_file(path))


def read_sequences(path: str) -> Iterator[np.ndarray]:
    """The ids of a data file in order, without padding."""
    source = _opened(path)
    for k in range(source.num_record_batches):
        batch = source.get_batch(k)
        ids, mask = (batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("input_ids", "mask"))
        yield ids if mask.all() else ids[mask]


def read_tokens(manifest: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` of every document, read back from the files of a manifest.

    ``start`` counts the ids of all documents before it; ``ids`` are little-endian unsigned 32-bit
    integers, the end id included.
    """
    # One row a file: the running sum is over the list of files, not over documents.
    before = F.sum("n_tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    placed = manifest.withColumn("base", F.coalesce(before, F.lit(0)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forget_encoders()  # all files are written by now
        for pdf in batches:
            for file in pdf.itertuples():
                index, stream = _opened(file.index_path), read_sequences(file.path)
                held, start = np.zeros(0, np.uint32), int(file.base)
                for k in range(index.num_record_batches):
                    batch = index.get_batch(k)
                    lengths = batch.column("n_tokens").to_numpy()
                    parts, have = [held], len(held)
                    while have < lengths.sum():
                        parts.append(next(stream).astype(np.uint32))
                        have += len(parts[-1])
                    ids, ends = np.concatenate(parts), np.cumsum(lengths)
                    held = ids[ends[-1] :] if len(ends) else ids
                    cut = [ids[e - n : e].astype("<u4").tobytes() for e, n in zip(ends, lengths, strict=True)]
                    yield pd.DataFrame({"doc_id": batch.column("doc_id").cast(pa.string()).to_pandas(), "start": start + ends - lengths, "n_tokens": lengths, "ids": cut})
                    start += int(lengths.sum())

    files = max(1, manifest.count())
    return with_ids(placed.repartition(files).mapInPandas(run, "doc_id string, start long, n_tokens long, ids binary"))
