"""Token ids as files: frequency-ranked ids in byte-aligned codes with separate control bytes.

A file of the format is one segment, the documents of a doc_id range:

    magic "TMS2", u32 part, u32 segment of the part, u32 documents, u32 ids, u32 ranks
    i64 doc_id and u8 null flag for each document, u32 ids of each document
    u32 id for each rank (rank 0 is the segment's most frequent id)
    control bytes (2 bits for each id: its bytes less one, four ids to a byte)
    data bytes (each id's rank, little-endian, as many bytes as its control says)
    trailer "TMSE"

Decoding looks the control bytes up in a table of lengths, so numpy reads all ids
at once. A segment carries its own ranks: one pass over the text
is enough, and a segment is read without any other.

Files are written by Spark's file committer, one segment each, so what lost or
repeated tasks wrote is dropped, in whatever store the shared folder is; they are
read back as binary files. Texts are dealt by doc_id range; starts come from
prefix sums over the segments' totals. Texts that hold a special token of the
tokenizer go to the library whole, which recognises it. Edge cases: a null text
counts as empty and has only the end id; a null doc_id comes first; repeated rows
stay, ordered by text; clashing extra columns are cut first; a text of any length
is one document of one segment.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import STAGING, documents, partitions, room, settings, slices, stage_path

MAGIC, TRAILER = b"TMS2", b"TMSE"
END_ID = 2
#: Ids in a segment before the next one begins.
SEGMENT_IDS = 2 << 20
#: Words kept with their ids in a worker, about 200 bytes each; as its step has no other cache, two shares and a half.
CACHE_WORDS = room(200, 2.5)

#: White space as the tokenizer's pattern has it. Fixed values.
_WS = "\t\n\x0b\x0c\r \x85\xa0  -     　"
#: Nothing or white space after a unit's mark: a longer run was cut.
_ODD = re.compile(rf"\n?+(?:[{_WS}]|\Z)")
_CUT = re.compile(rf"(?=[ \n][^{_WS}])")
#: Marks at the end of a word, but for the apostrophe, which may begin a piece of its own, and what must stand before
#: them: digits and letters of every version of Unicode.
_MARKS = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum() and c != "'")
_BEFORE_MARKS = frozenset(c for c in map(chr, range(0x250)) if c.isalnum() and (c.isascii() or c >= "\xc0"))
#: Ends kept with their ids.
MOST_ENDS = 4096

# ---- codes -----------------------------------------------------------------

#: Bytes of the four values of each control byte.
LENGTHS = np.array([[(c >> 2 * j & 3) + 1 for j in range(4)] for c in range(256)], np.uint8)


def encode_values(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes of unsigned 32-bit values."""
    v = np.ascontiguousarray(values, "<u4")
    n = len(v)
    two = np.zeros(-(-n // 4) * 4, np.uint8)
    longer = [np.flatnonzero(v >> np.uint32(8 * j)) for j in range(1, 4 if n and v.max() > 0xFFFF else 2)]
    for x in longer:
        two[x] += 1
    size = two[:n] + np.uint8(1)
    at = np.cumsum(size, dtype=np.int64)
    data = np.empty(int(at[-1]) if n else 0, np.uint8)
    at -= size
    data[at] = v.astype(np.uint8)
    for j, x in enumerate(longer, 1):
        data[at[x] + j] = (v[x] >> np.uint32(8 * j)).astype(np.uint8)
    four = two.reshape(-1, 4)
    control = four[:, 0] | four[:, 1] << 2 | four[:, 2] << 4 | four[:, 3] << 6
    return control.tobytes(), data.tobytes()


def decode_values(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The n values again, by table lookup."""
    d = np.frombuffer(data, np.uint8)
    size = LENGTHS[np.frombuffer(control, np.uint8)].ravel()[:n]
    at = np.cumsum(size, dtype=np.int64)
    at -= size
    out = d[at].astype(np.uint32)
    for j in range(1, int(size.max()) if n else 0):
        longer = np.flatnonzero(size > j)
        out[longer] |= d[at[longer] + j].astype(np.uint32) << np.uint32(8 * j)
    return out


def pack_segment(doc_ids: list, counts: list[int], ids: np.ndarray, part: int = 0, seq: int = 0) -> bytes:
    """A segment (without its trailer) of documents in order, ids being those of all of them."""
    # ids are below the vocabulary's size, so a table counts them without sorting
    frequency = np.bincount(ids) if len(ids) else np.zeros(0, np.int64)
    present = np.flatnonzero(frequency)
    ranked = present[np.argsort(-frequency[present], kind="stable")].astype("<u4")
    rank_of = np.zeros(int(present.max()) + 1 if len(present) else 1, np.uint32)
    rank_of[ranked] = np.arange(len(ranked))
    control, data = encode_values(rank_of[ids])
    null = np.array([d is None for d in doc_ids], np.uint8)
    numbers = np.array([d or 0 for d in doc_ids], "<i8")
    head = struct.pack("<IIIII", part, seq, len(doc_ids), len(ids), len(ranked))
    return b"".join([MAGIC, head, numbers.tobytes(), null.tobytes(), np.array(counts, "<u4").tobytes(), ranked.tobytes(), control, data])


def unpack_segment(segment: bytes) -> tuple[int, int, list, np.ndarray, np.ndarray]:
    """Part, number in the part, document ids, ids of each document, all ids."""
    if segment[:4] != MAGIC or segment[-4:] != TRAILER:
        raise ValueError("no whole segment")
    part, seq, docs, n, ranks = struct.unpack_from("<IIIII", segment, 4)
    at = 24
    numbers = np.frombuffer(segment, "<i8", docs, at).tolist()
    null = np.frombuffer(segment, np.uint8, docs, at + 8 * docs)
    counts = np.frombuffer(segment, "<u4", docs, at + 9 * docs).astype(np.int64)
    at += 13 * docs
    ranked = np.frombuffer(segment, "<u4", ranks, at)
    at += 4 * ranks
    width = -(-n // 4)
    values = decode_values(segment[at : at + width], segment[at + width : -4], n)
    return part, seq, [None if x else d for d, x in zip(numbers, null)], counts, ranked[values] if n else values


# ---- texts to ids ----------------------------------------------------------


class Encoder:
    """The library's ids of whole texts, with the ids of words kept.

    The tokenizer's pattern always has a bound before the last white space of a
    run, so a text falls into independent units before each space or line feed
    that another character follows. A unit is kept under its own text, a space at
    its begin left out. A text's first unit is sought as if a line feed stood
    before it, whose one id is cut off again. Columns are cut at every space and
    line feed; texts where that cuts a run of three or of other white space are
    cut anew. Texts with a token that the tokenizer adds to its vocabulary (a
    special token) go to the library whole.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        size = self.tokenizer.get_vocab_size()
        self.dtype = np.uint16 if size <= 1 << 16 else np.uint32
        tokens = [self.tokenizer.id_to_token(i) or "" for i in range(size)]
        self.begins = {mark: np.array([t.startswith(token) for t in tokens]) for mark, token in ((" ", "Ġ"), ("\n", "Ċ"))}
        self.spaced: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.ends: dict[str, bytes] = {}

    def _ids(self, text: str) -> bytes:
        # one text a call: the library deals several to threads, and the other cores have tasks of their own
        (e,) = self.tokenizer.encode_batch_fast([text], add_special_tokens=False)
        return np.array(e.ids, self.dtype).tobytes()

    def _learn(self, units: list[str], mark: str) -> None:
        """Ids of new units that begin with the mark, many in one text: only their first id begins with it."""
        size = np.dtype(self.dtype).itemsize
        lead = " " if mark == " " else ""  # a line feed is part of the unit
        for low in range(0, len(units), 64):
            part = units[low : low + 64]
            raw = self._ids("".join([lead + u for u in part]))
            cuts = np.flatnonzero(self.begins[mark][np.frombuffer(raw, self.dtype)])
            if len(cuts) == len(part) and cuts[0] == 0:
                at = (cuts * size).tolist()
                self.spaced.update(zip(part, [raw[x:y] for x, y in zip(at, [*at[1:], len(raw)])]))
            else:
                self.spaced.update(zip(part, [self._ids(lead + u) for u in part]))

    def _look_up(self, units: list[str]) -> tuple[list[bytes], np.ndarray]:
        """Ids of distinct units and their kinds: 0 a word, 1 a mark alone, 2 one before white space, which has no ids."""
        spaced, older = self.spaced, self.older
        found = list(map(spaced.get, units))
        kinds = np.zeros(len(units), np.int8)
        late, ended, stems = [], [], {}
        for i in [i for i, ids in enumerate(found) if ids is None]:
            unit = units[i]
            if not unit or unit[0].isspace():
                # they are never kept, so they are always met here
                if _ODD.match(unit):
                    kinds[i] = 1 if unit in ("", "\n") else 2
                    found[i] = self._ids(unit or " ") if kinds[i] == 1 else b""
                    continue
            if unit in older:
                found[i] = spaced[unit] = older[unit]
                continue
            late.append(i)
            # the pattern has a bound between a letter or digit and marks
            stem = unit.rstrip(_MARKS)
            if stem != unit and stem and stem[-1] in _BEFORE_MARKS and len(unit) - len(stem) <= 8:
                ended.append((unit, stem))
                if stem in spaced:
                    continue
                if stem in older:
                    spaced[stem] = older[stem]
                    continue
                unit = stem
            stems[unit] = None
        self._learn([u for u in stems if u[0] != "\n"], " ")
        self._learn([u for u in stems if u[0] == "\n"], "\n")
        for unit, stem in ended:
            end = unit[len(stem) :]
            if end not in self.ends:
                if len(self.ends) >= MOST_ENDS:
                    self.ends.clear()
                self.ends[end] = self._ids(end)
            spaced[unit] = spaced[stem] + self.ends[end]
        for i in late:
            found[i] = spaced[units[i]]
        return found, kinds

    def _with_runs(self, texts: list[str]) -> list[bytes]:
        """Ids of texts with runs of white space: cut before a run's last space or line feed alone."""
        cut = [_CUT.split(t) for t in texts]
        rest = [[u[1:] if u[0] == " " else u for u in units[1:]] for units in cut]
        distinct = list({u for units in rest for u in units})
        ids = dict(zip(distinct, self._look_up(distinct)[0]))
        return [(self._ids(first) if first else b"") + b"".join([ids[u] for u in units]) for (first, *_), units in zip(cut, rest)]

    def encode_column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one text after the other, and the number of ids of each."""
        if len(self.spaced) > CACHE_WORDS // 2:
            # two generations: words still in use move over from the older one, the others go
            self.older, self.spaced = self.spaced, {}
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        whole = np.zeros(len(texts), bool)
        for content in self.added:
            whole |= pc.match_substring(texts, content).to_numpy(zero_copy_only=False)
        plain = pc.if_else(pa.array(whole), "", texts)
        bare = pc.invert(pc.or_(pc.or_(pc.starts_with(plain, " "), pc.starts_with(plain, "\n")), pc.equal(plain, "")))
        marked = pc.if_else(bare, pc.binary_join_element_wise(pa.scalar("\n", pa.large_string()), plain, pa.scalar("", pa.large_string())), plain)
        pieces = pc.split_pattern(pc.replace_substring(marked, "\n", " \n"), " ")
        bare = bare.to_numpy(zero_copy_only=False)
        at = np.concatenate([[0], np.cumsum(pc.list_value_length(pieces).to_numpy())]).astype(np.int64)
        first = at[:-1]  # an empty piece, as a space begins every text now
        words = pieces.flatten().dictionary_encode()
        places = words.indices.to_numpy()
        units = words.dictionary.to_numpy(zero_copy_only=False).tolist()
        found, kinds = self._look_up(units)
        lengths = np.fromiter(map(len, found), np.int64, len(found)) // np.dtype(self.dtype).itemsize
        begin, length = (np.cumsum(lengths) - lengths)[places], lengths[places]
        length[first] = 0
        begin[first[bare] + 1] += 1
        length[first[bare] + 1] -= 1
        kind = np.append(kinds[places], np.int8(0))
        kind[first] = 0
        # a mark alone is a piece of its own if its run has one more mark at most
        alone = np.flatnonzero(kind == 1)
        before = places[alone - 1]
        blank = np.zeros(len(units), bool)
        blank[[j for j in np.unique(before).tolist() if units[j][-1:].isspace()]] = True
        hits = np.concatenate([np.flatnonzero(kind == 2), alone[(kind[alone + 1] > 0) | blank[before]]])
        runs = np.unique(np.searchsorted(at, hits, "right") - 1).tolist()
        known = int(lengths.sum())
        for i, ids in [*zip(runs, self._with_runs([texts[i].as_py() for i in runs])), *[(i, self._ids(texts[i].as_py())) for i in np.flatnonzero(whole).tolist()]]:
            found.append(ids)
            length[at[i] : at[i + 1]] = 0
            begin[at[i]], length[at[i]] = known, len(ids) // np.dtype(self.dtype).itemsize
            known += int(length[at[i]])
        stops = np.concatenate([[0], np.cumsum(length)])
        ids = np.frombuffer(b"".join(found), self.dtype)[np.repeat(begin - stops[:-1], length) + np.arange(stops[-1])]
        return ids, np.diff(stops[at])

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        ids, counts = self.encode_column(pa.array(texts, pa.large_string()))
        return np.split(ids, np.cumsum(counts)[:-1]) if texts else []


def with_ends(ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids and counts with the end id after each text."""
    counts = counts + 1
    out = np.full(len(ids) + len(counts), END_ID, ids.dtype)
    inner = np.ones(len(out), bool)
    inner[np.cumsum(counts) - 1] = False
    out[inner] = ids
    return out, counts


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The encoder of this worker; workers live on over tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


# ---- tables ----------------------------------------------------------------


def segments(docs: DataFrame, path: str) -> DataFrame:
    """Segments, in doc_id order by part and number in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        part, seq = TaskContext.get().partitionId(), 0
        doc_ids: list = []
        counts: list[int] = []
        held: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            ids = np.concatenate(held)
            row = pa.RecordBatch.from_arrays([pa.array([pack_segment(doc_ids, counts, ids, part, seq)], pa.binary())], ["segment"])
            doc_ids.clear(), counts.clear(), held.clear()
            return row

        total = 0
        for whole in batches:
            for b in slices(whole):
                ids, sizes = with_ends(*enc.encode_column(b.column("text")))
                stops = np.cumsum(sizes)
                for doc, low, high in zip(b.column("doc_id").to_pylist(), (stops - sizes).tolist(), stops.tolist()):
                    doc_ids.append(doc)
                    held.append(ids[low:high])
                    counts.append(high - low)
                    total += high - low
                    if total >= SEGMENT_IDS:
                        yield flush()
                        seq, total = seq + 1, 0
        if doc_ids:
            yield flush()

    dealt = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(partitions(docs.sparkSession), "doc_id").sortWithinPartitions("doc_id", "text")
    return dealt.mapInArrow(run, "segment binary")


def write(docs: DataFrame, path: str, folder: str) -> None:
    """Write the ids of docs to the folder, a file for each segment."""
    spark = docs.sparkSession
    # a row's bytes and the line separator are all that Spark's text writer puts into a file
    raw = segments(docs, path).select(F.col("segment").cast("string").alias("value"))
    with settings(spark, STAGING):
        raw.write.option("maxRecordsPerFile", 1).option("lineSep", TRAILER.decode()).text(folder)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of all documents in the folder's files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for segment in b.column("content").to_pylist():
                if not segment:  # a task without rows leaves an empty file
                    continue
                part, seq, doc_ids, counts, ids = unpack_segment(segment)
                ends = np.cumsum(counts)
                raw = memoryview(ids.astype("<u4")).cast("B")
                crc = [zlib.crc32(raw[4 * (e - c) : 4 * e]) for e, c in zip(ends.tolist(), counts.tolist())]
                n = len(doc_ids)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * n, pa.int64()), pa.array([seq] * n, pa.int64()), pa.array(doc_ids, pa.int64()), pa.array(ends - counts, pa.int64()), pa.array(counts, pa.int64()), pa.array(crc, pa.int64())],
                    ["part", "seq", "doc_id", "inside", "n_tokens", "ids_crc32"],
                )

    def head(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [struct.unpack_from("<IIIII", s, 4) for s in b.column("content").to_pylist() if s]
            yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in (0, 1, 3)], ["part", "seq", "ids"])

    stored = spark.read.format("binaryFile").load(folder).select("content")
    rows = stored.mapInArrow(run, "part long, seq long, doc_id long, inside long, n_tokens long, ids_crc32 long")
    sizes = stored.mapInArrow(head, "part long, seq long, ids long")
    parts = sizes.groupBy("part").agg(F.sum("ids").alias("n"))
    before = parts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("part_start"))
    inner = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("part", "seq", F.coalesce(F.sum("ids").over(inner), F.lit(0)).alias("seq_start")).join(before, "part")
    return rows.join(starts, ["part", "seq"]).select("doc_id", (F.col("part_start") + F.col("seq_start") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def op9_tokenfile(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = stage_path(spark, "tokens")
    write(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), folder)
    return read(spark, folder)


QUERIES = {"op9_tokenfile": op9_tokenfile}
ORACLE: dict[str, str] = {}
