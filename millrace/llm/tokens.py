"""Token files: flat unsigned integers with 64-bit document offsets, memory-mapped when read."""

from __future__ import annotations

import os
import uuid
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shipping import ship
from .caches import held
from .store import cut, open_array, open_fs, work_dir

#: Texts of these characters only, with single spaces and line ends, fall into pieces that byte-level BPE never joins.
_PLAIN = bytes([10, *range(32, 127), *range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x100)])
#: The letters that stand for bytes in byte-level BPE: printable ones for themselves, the others from U+0100 on.
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_UNITS = {b: chr(b) for b in _SHOWN} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in _SHOWN)}
#: Pieces whose ids are kept in a worker at most, and texts encoded together.
CACHE, TOGETHER = 900_000, 512
#: Rows of a batch that a reader returns, and ids that it holds at once.
READ_ROWS, READ_IDS = 50_000, 1 << 22
_READ = "doc_id long, start long, n_tokens long, ids_crc32 long"


def plain(text: str) -> bool:
    """Whether spaces and line ends in a text stand alone between other characters, all of them in Latin-1."""
    try:
        other = text.encode("latin-1").translate(None, _PLAIN)
    except UnicodeEncodeError:
        return False
    return not other and text == text.strip() and not any(pair in text for pair in ("  ", " \n", "\n ", "\n\n"))


class Encoder:
    """Encodes whole texts with a tokenizer, as bytes of little-endian ids.

    A byte-level BPE tokenizer without normalizer splits text before every single space, around
    every single line end and between a letter and a comma or full stop, and never merges over a
    split; so for plain texts the library encodes each distinct piece once and the ids are joined.
    All other texts go through the library whole.
    """

    def __init__(self, path: str):
        import json

        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        self.pieces = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not spec.get("normalizer")
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self.known: dict[str, bytes] = {}

    def _library(self, texts: list[str]) -> list[bytes]:
        return [array(self.dtype.char, e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, new: set[str]) -> None:
        known = self.known
        ended = [w for w in new if w[-1:] in (",", ".") and w[-2:-1].isalpha()]
        whole = list(new.difference(ended).union([w[:-1] for w in ended], (",", ".")).difference(known))
        words = [w for w in whole if w.removeprefix(" ").isalpha()]
        known.update(zip(words, self._words(words), strict=True))
        rest = list({"\n", *whole}.difference(words))
        known.update(zip(rest, self._library(rest), strict=True))
        for w in ended:
            known[w] = known[w[:-1]] + known[w[-1]]

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of words, letters only but for a space before: each is one unit that the library's model takes as it is."""
        model, kind = self.tokenizer.model, self.dtype.char
        units = "\n".join(words).encode().decode("latin-1").translate(_UNITS).split(_UNITS[10]) if words else []
        return [array(kind, [t.id for t in model.tokenize(u)]).tobytes() for u in units]

    def encode(self, texts: list[str]) -> list[bytes]:
        out: list = [None] * len(texts)
        cutup = {k: t.replace(" ", "\x01 ").replace("\n", "\x01\n\x01").split("\x01") for k, t in enumerate(texts) if self.pieces and plain(t) and not any(s in t for s in self.special)}
        if len(self.known) > CACHE:
            self.known.clear()
        if new := set().union(*cutup.values()).difference(self.known):
            self._learn(new)
        for k, pieces in cutup.items():
            out[k] = b"".join(map(self.known.__getitem__, pieces))
        rest = [k for k, x in enumerate(out) if x is None]
        for k, ids in zip(rest, self._library([texts[k] for k in rest]), strict=True):
            out[k] = ids
        return out


def encoder_for(path: str) -> Encoder:
    """A worker's encoder, with the pieces that its earlier tasks have met."""
    return held("tokens", path, lambda: Encoder(path))


def _writer(folder: str, tokenizer: str, end_id: int):
    def write(batches):
        encoder, part = encoder_for(tokenizer), TaskContext.get().partitionId()
        end = np.array([end_id], encoder.dtype).tobytes()
        fs, where = open_fs(folder)
        fs.create_dir(where, recursive=True)
        name = f"{part:06d}-{uuid.uuid4().hex}"  # each attempt writes its own files; the manifest names those that count
        ids, ends, total, nulls = array("q"), array("q", [0]), 0, 0
        with fs.open_output_stream(f"{where}/{name}.bin") as out:
            for batch in batches:
                for at in range(0, batch.num_rows, TOGETHER):
                    some = batch.slice(at, TOGETHER)
                    for doc, got in zip(some.column("doc_id").to_pylist(), encoder.encode([t or "" for t in some.column("text").to_pylist()]), strict=True):
                        out.write(got)
                        out.write(end)
                        total += len(got) // encoder.dtype.itemsize + 1
                        nulls += doc is None  # these come first
                        ids.append(doc or 0)
                        ends.append(total)
        with fs.open_output_stream(f"{where}/{name}.idx") as out:
            out.write(np.array(ends).astype("<u8").tobytes())
        with fs.open_output_stream(f"{where}/{name}.doc") as out:
            out.write(np.array(ids).astype("<i8").tobytes())
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "name": [name], "docs": [len(ids)], "tokens": [total], "width": pa.array([encoder.dtype.itemsize], pa.int32()), "nulls": [nulls]})

    return write


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int = 2) -> tuple[str, list[tuple]]:
    """Encode ``docs (doc_id, text)`` and write the ids in ascending order of doc_id.

    Returns the folder and the list of files ``(name, documents, tokens, bytes of an id, first
    token's place, null doc_ids)``, one entry for each partition; the places are prefix sums of the partitions'
    totals. ``name.bin`` holds the ids as little-endian unsigned integers (16 bits where the
    vocabulary allows), ``name.idx`` 64-bit offsets of its documents and the end, ``name.doc`` their
    doc_ids (64-bit). Null texts are empty; every document ends with ``end_id``. Null doc_ids come
    first; the list has their number, and the file any value in their place. Rows of equal doc_id go by their text. An empty table gives empty
    files. Other columns aren't read. The tokenizer's path must exist on every executor.
    """
    ship(docs.sparkSession)
    spark = docs.sparkSession
    folder = work_dir(spark, "tokens")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.crc32(F.col("text").cast("binary")).alias("c"))
    ordered = ordered.repartitionByRange(parts, "doc_id", "c").sortWithinPartitions("doc_id", "c").select("doc_id", "text")
    manifest = cut(ordered.mapInArrow(_writer(folder, tokenizer, end_id), "part int, name string, docs long, tokens long, width int, nulls long"), "tokens")
    files, base = [], 0
    for r in manifest.orderBy("part").collect():  # one row for each partition
        files.append((r.name, r.docs, r.tokens, r.width, base, r.nulls))
        base += r.tokens
    return folder, files


def _crcs(ids, ends: np.ndarray) -> list[int]:
    """CRC of each document's ids; ``READ_IDS`` are held at once, however long a document is."""
    first, last, some, out = int(ends[0]), int(ends[-1]), ids(0, 0), []
    for place, end in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        crc = 0
        while place < end:
            if place >= first + len(some):
                first, some = place, ids(place, min(last, place + READ_IDS))
            part = some[place - first : end - first]
            crc = zlib.crc32(part.astype("<u4").tobytes(), crc)
            place += len(part)
        out.append(crc)
    return out


def read_token_files(spark, folder: str, files: list[tuple]) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` of every document in token files, from the files alone.

    start counts the ids of all documents before; the CRC is of the ids as 32-bit little-endian
    integers, the end id included. A task holds ``READ_ROWS`` documents' offsets and ``READ_IDS`` ids
    at once, of a memory map or fetched by ranges.
    """
    ship(spark)

    def read(batches):
        fs, where = open_fs(folder)
        for batch in batches:
            for name, docs, _, width, base, nulls in (files[k] for k in batch.column("id").to_pylist()):
                with open_array(fs, f"{where}/{name}.bin", f"<u{width}") as ids, open_array(fs, f"{where}/{name}.idx", "<u8") as offsets, open_array(fs, f"{where}/{name}.doc", "<i8") as names:
                    for k in range(0, docs, READ_ROWS):
                        some = names(k, min(docs, k + READ_ROWS))
                        ends = offsets(k, k + len(some) + 1).astype("int64")
                        yield pa.RecordBatch.from_arrays([pa.array(some, mask=np.arange(k, k + len(some)) < nulls), pa.array(base + ends[:-1]), pa.array(np.diff(ends)), pa.array(_crcs(ids, ends), pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    files = list(files)
    return spark.range(0, len(files), 1, max(1, len(files))).mapInArrow(read, _READ)
