"""SentencePiece encoding and decoding by a max-plus parallel scan.

The vocabulary file holds a BPE model: its encoding of a string is the one path
of pieces through the string's lattice on which every piece is its own encoding
and every two neighbours are the encoding of their concatenation. Scores are 0
for such a step and minus infinity for any other, so the best path of max-plus
algebra is exactly the library's encoding, and transfer matrices of 0 and minus
infinity are kept as sets of reachable states.

A text of CHUNK characters or more is split into chunks, dealt to tasks one by
one. The state at a chunk boundary is the piece that ends at or crosses it, with
the characters it still covers. Each chunk yields its transfer matrix from entry
to exit states. Matrices are combined up a tree, FAN neighbours at a time, until
a text has one; from the top, which knows where the text begins and ends, each
node tells its children their entry and exit states; then each chunk is
backtraced by itself. No task but the last, which joins a text's ids, sees more
than FAN matrices or one chunk. Shorter texts are encoded whole by the same
search; tests hold both ways against the library and against each other. No piece
has a space mark after another character, so a path passes through every word
start, and the paths of words are found many at a time and kept (within a number
of bytes).

Characters outside the vocabulary become their UTF-8 bytes' pieces. Edge cases:
null and empty texts have no ids; repeated rows are encoded one by one; a null
doc_id stays null; extra columns, whatever their names, are cut first. Decoding gives the text back, except that a literal space
mark (U+2581) in a text becomes a space, as in the library.
"""

from __future__ import annotations

import hashlib
import pickle
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import REMEMBERED, SLICE_BYTES, bound_batches, crc32_of, documents, joined, lean, partitions, room, slices, stage

SPACE = "▁"
#: Characters of a chunk, neighbours combined at once, and characters of words searched many at a time.
CHUNK, FAN, WIDE = 32_768, 64, 48
#: Words kept with their ids in a worker, about 180 bytes each; steps in its table, 9 bytes each, and beside it, 110.
KEPT, KNOWN, PAIRS = room(180, 0.7), room(18, 0.2), room(220, 0.1)
BEGIN, BYTES = 65_535, 65_534
_BASE = np.uint64(0x100000001B3)
_MIXER = np.uint64(0x9E3779B97F4A7C15)


class Pieces:
    """A BPE model's vocabulary with the search for its paths."""

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        special = [model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i) for i in range(size)]
        self.piece = [model.id_to_piece(i) for i in range(size)]
        self.id = {p: i for i, p in enumerate(self.piece) if not special[i]}
        self.score = [model.get_score(i) for i in range(size)]
        self.byte = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.longest = max(map(len, self.id))
        if any(SPACE in p.lstrip(SPACE) for p in self.id):
            raise ValueError("a piece crosses a word start")
        self.chars = {p for p in self.id if len(p) == 1}
        letters = "".join(re.escape(c) for c in sorted(self.chars - {SPACE}))
        self._word = re.compile(f"{SPACE}*[{letters}]+|{SPACE}+|[^{letters}{SPACE}]")
        self.text = [b"" if model.is_control(i) else bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(self.piece)]
        self.paths: dict[str, bytes] = {}
        self.pairs: dict[int, bool] = {}
        self._known, self._valid = np.zeros(0, np.int64), np.zeros(0, bool)
        powers = [np.uint64(1)]
        with np.errstate(over="ignore"):
            for _ in range(self.longest):
                powers.append(powers[-1] * _BASE)
            hashes = {self._hash(p): i for p, i in self.id.items()}
        if len(hashes) != len(self.id):
            raise ValueError("two pieces have one hash")
        self._powers = powers
        self._hashes = np.array(sorted(hashes), np.uint64)
        self._ids = np.array([hashes[h] for h in sorted(hashes)], np.int64)

    @staticmethod
    def _hash(piece: str) -> int:
        h = 0
        for c in piece:
            h = (h * int(_BASE) + ord(c) * int(_MIXER)) & (1 << 64) - 1
        return h

    # -- steps ---------------------------------------------------------------

    def merge(self, text: str) -> list[str]:
        """The model's own rule on a short string: merge the best neighbours, the left ones first, while any can be."""
        parts = list(text)
        while len(parts) > 1:
            best = None
            for i in range(len(parts) - 1):
                found = self.id.get(parts[i] + parts[i + 1])
                if found is not None and (best is None or self.score[found] > best[0]):
                    best = (self.score[found], i)
            if best is None:
                break
            i = best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def step(self, before: int, piece: int) -> bool:
        """Whether `piece` may follow `before` (BEGIN and BYTES: nothing that merges)."""
        key = before << 16 | piece
        found = self.pairs.get(key)
        if found is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            if piece == BYTES:
                found = True
            else:
                p = self.piece[piece]
                if before in (BEGIN, BYTES):
                    found = self.merge(p) == [p]
                else:
                    b = self.piece[before]
                    found = self.merge(p) == [p] if p[0] == SPACE and b[-1] != SPACE else self.merge(b + p) == [b, p]
            self.pairs[key] = found
        return found

    def reach(self, z: str, at: int, before: int, stop: int) -> dict[int, tuple[int, int]]:
        """From a boundary at `at` after piece `before`: for each reachable end up to stop, (piece, its start).

        A path is the encoding of what it spells, so an end is reached in one way at most.
        """
        out = {at: (before, -1)}
        for end in range(at + 1, min(len(z), stop) + 1):
            if z[end - 1] not in self.chars:
                if end - 1 in out:
                    out[end] = (BYTES, end - 1)
                continue
            for start in range(end - 1, max(at, end - self.longest) - 1, -1):
                if start in out:
                    piece = self.id.get(z[start:end])
                    if piece is not None and self.step(out[start][0], piece):
                        out[end] = (piece, start)
                        break
        return out

    def _spell(self, z: str, out: dict[int, tuple[int, int]], end: int, at: int) -> list[int]:
        """Ids of the path in `out` from at to end."""
        back: list[list[int]] = []
        while end > at:
            piece, start = out[end]
            back.append([self.byte[b] for b in z[start:end].encode("utf-8", "surrogatepass")] if piece == BYTES else [piece])
            end = start
        return [i for ids in reversed(back) for i in ids]

    # -- words ---------------------------------------------------------------

    def _lookup(self, h: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self._hashes, h), len(self._hashes) - 1)
        return np.where(self._hashes[at] == h, self._ids[at], -1)

    def _steps(self, before: np.ndarray, piece: np.ndarray) -> np.ndarray:
        """step() of many pairs from a sorted table, which takes up what it lacks."""
        keys = before << 16 | piece
        at = np.minimum(np.searchsorted(self._known, keys), max(0, len(self._known) - 1))
        hit = self._known[at] == keys if len(self._known) else np.zeros(len(keys), bool)
        out = np.zeros(len(keys), bool)
        out[hit] = self._valid[at[hit]]
        lost = np.flatnonzero(~hit)
        if len(lost):
            found, where = np.unique(keys[lost], return_inverse=True)
            got = np.array([self.step(k >> 16, k & 0xFFFF) for k in found.tolist()], bool)
            out[lost] = got[where]
            if len(self._known) + len(found) > KNOWN:
                self._known, self._valid = np.zeros(0, np.int64), np.zeros(0, bool)
            at = np.searchsorted(self._known, found)
            self._known, self._valid = np.insert(self._known, at, found), np.insert(self._valid, at, got)
        return out

    def _learn(self, words: list[str]) -> None:
        """Paths of new words: scalar for long or odd ones, otherwise one position of all words at a time."""
        many = []
        for w in words:
            if len(w) > WIDE or SPACE * 2 in w or w[0] not in self.chars:
                self.paths[w] = np.array(self._spell(w, self.reach(w, 0, BEGIN, len(w)), len(w), 0), np.uint16).tobytes()
            else:
                many.append(w)
        many.sort(key=len, reverse=True)
        for low in range(0, len(many), 20_000):
            self._learn_many(many[low : low + 20_000])

    def _learn_many(self, words: list[str]) -> None:
        n, sizes = len(words), np.array([len(w) for w in words])
        width = int(sizes[0])
        codes = np.zeros((n, width), np.uint64)
        codes[np.arange(width) < sizes[:, None]] = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        h = np.zeros((width + 1, n), np.uint64)
        with np.errstate(over="ignore"):
            for j in range(width):
                h[j + 1] = h[j] * _BASE + codes[:, j] * _MIXER
        last, back = np.full((width + 1, n), -1, np.int64), np.zeros((width + 1, n), np.int64)
        last[0] = BEGIN
        alive = n - np.searchsorted(sizes[::-1], np.arange(1, width + 1), side="left")
        for end, m in enumerate(alive.tolist(), 1):
            left = np.arange(m)
            for size in range(1, min(end, self.longest) + 1):
                rows = left[last[end - size, left] >= 0]
                if not len(rows):
                    continue
                with np.errstate(over="ignore"):
                    piece = self._lookup(h[end, rows] - h[end - size, rows] * self._powers[size])
                rows, piece = rows[piece >= 0], piece[piece >= 0]
                if not len(rows):
                    continue
                ok = self._steps(last[end - size, rows], piece)
                rows = rows[ok]
                last[end, rows], back[end, rows] = piece[ok], size
                if len(rows):
                    left = left[last[end, left] < 0]
                    if not len(left):
                        break
        # backtrace all words together, from their ends
        at, row = sizes.copy(), np.arange(n)
        columns, owners = [], []
        while len(row):
            columns.append(last[at, row])
            owners.append(row)
            at = at - back[at, row]
            row, at = row[at > 0], at[at > 0]
        owner, piece = np.concatenate(owners[::-1]), np.concatenate(columns[::-1])
        order = np.argsort(owner, kind="stable")
        cuts = np.cumsum(np.bincount(owner, minlength=n))[:-1]
        for w, ids in zip(words, np.split(piece[order].astype(np.uint16), cuts)):
            self.paths[w] = ids.tobytes()

    def words(self, z: str) -> list[str]:
        """Parts between which no pieces merge: words with their space marks, and single unknown characters."""
        return self._word.findall(z)

    def encode_marked(self, texts: list[str]) -> list[bytes]:
        """Ids (16 bits each) of texts whose spaces are marks already."""
        if len(self.paths) > KEPT:
            self.paths.clear()
        parts = [self.words(z) for z in texts]
        fresh = set().union(*parts) - self.paths.keys() if parts else set()
        if fresh:
            self._learn(list(fresh))
        get = self.paths.__getitem__
        return [b"".join(map(get, p)) for p in parts]

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        return [np.frombuffer(b, np.uint16) for b in self.encode_marked([marked(t) for t in texts])]

    def decode(self, ids: np.ndarray) -> str:
        raw = b"".join(map(self.text.__getitem__, ids.tolist()))
        return (raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "replace")

    # -- chunks --------------------------------------------------------------

    def _sync(self, z: str, low: int, high: int) -> int:
        """The first word start in [low, high), or -1."""
        at = z.find(SPACE, low, high)
        while 0 < at < high and z[at - 1] == SPACE:
            at = z.find(SPACE, at + 1, high)
        return at if at > 0 else -1

    def states(self, z: str, at: int) -> list[tuple[int, int]]:
        """States that a boundary at `at` can have: (piece, characters it covers after the boundary)."""
        out = []
        for start in range(max(0, at - self.longest), at):
            for end in range(at, min(len(z), start + self.longest) + 1):
                piece = self.id.get(z[start:end])
                if piece is not None and self.step(BEGIN, piece):
                    out.append((piece, end - at))
        if at and z[at - 1] not in self.chars:
            out.append((BYTES, 0))
        return out

    def _exits(self, out: dict[int, tuple[int, int]], cut: int, end: int) -> dict[tuple[int, int], int]:
        """Exit states of a reached set: pieces that begin before the cut and end at or after it."""
        return {(piece, at - cut): at for at, (piece, start) in out.items() if at >= cut and start < cut and at <= end}

    def transfer(self, z: str, low: int, high: int, first: bool) -> dict:
        """The chunk [low, high) of z (with context around it): entry state -> exit states that it reaches."""
        entries = [(BEGIN, 0)] if first else self.states(z, low)
        sync = self._sync(z, low + self.longest, high)
        rest = None
        if sync >= 0:
            tail = self._last_sync(z, sync, high)
            rest = set(self._exits(self.reach(z, tail, BYTES, high + self.longest), high, len(z)))
        out = {}
        for piece, over in entries:
            got = self.reach(z, low + over, piece, sync if sync >= 0 else high + self.longest)
            if rest is None:
                out[piece, over] = set(self._exits(got, high, len(z)))
                if over + low >= high:
                    out[piece, over].add((piece, low + over - high))
            else:
                out[piece, over] = rest if sync in got else set()
        return out

    def _last_sync(self, z: str, sync: int, high: int) -> int:
        """The last word start before high, sync at least."""
        at = z.rfind(SPACE, sync, high)
        while at > sync and z[at - 1] == SPACE:
            at -= 1
        return max(at, sync)

    def backtrace(self, z: str, low: int, high: int, entry: tuple[int, int], leave: tuple[int, int]) -> np.ndarray:
        """Ids of the pieces that begin in the chunk, on the path from entry to exit."""
        start, end = low + entry[1], high + leave[1]
        sync = self._sync(z, low + self.longest, high)
        if sync < 0:
            return np.array(self._spell(z, self.reach(z, start, entry[0], end), end, start), np.uint16)
        tail = self._last_sync(z, sync, high)
        head = self._spell(z, self.reach(z, start, entry[0], sync), sync, start)
        middle = np.frombuffer(self.encode_marked([z[sync:tail]])[0], np.uint16)
        last = self._spell(z, self.reach(z, tail, BYTES, end), end, tail)
        return np.concatenate([np.array(head, np.uint16), middle, np.array(last, np.uint16)])


def marked(text: str | None) -> str:
    """The text as the model sees it: a space before it, and marks for spaces."""
    return SPACE + text.replace(" ", SPACE) if text else ""


def compose(one: dict, two: dict) -> dict:
    """Max-plus product of two transfer matrices of 0 and minus infinity."""
    return {entry: set().union(*[two.get(x, set()) for x in exits]) if exits else set() for entry, exits in one.items()}


def product(matrices: list[dict]) -> dict:
    """Product of neighbours' matrices, first to last."""
    out = matrices[0]
    for m in matrices[1:]:
        out = compose(out, m)
    return out


def solve(matrices: list[dict], entry: tuple[int, int] = (BEGIN, 0), leave: tuple[int, int] | None = None) -> list[tuple[tuple[int, int], tuple[int, int]]]:
    """Entry and exit state of each of some neighbours on the path that enters the first by entry and leaves the last by leave.

    Prefix products from the left give what the entry reaches, products from the
    right what reaches the exit; one state at each boundary is in both. Without a
    leave the text ends here, so no character is left to cover.
    """
    ahead: list[set] = [{entry}]
    for m in matrices:
        ahead.append(set().union(*[m.get(s, set()) for s in ahead[-1]]))
    behind = [{s for s in ahead[-1] if (s[1] == 0 if leave is None else s == leave)}]
    for m, before in zip(reversed(matrices), reversed(ahead[:-1])):
        behind.append({s for s in before if m.get(s, set()) & behind[-1]})
    on = [next(iter(s)) for s in reversed(behind)]
    return list(zip(on, on[1:]))


def pieces(path: str) -> Pieces:
    """The model of this worker; workers live on over tasks."""
    if path not in REMEMBERED:
        REMEMBERED[path] = Pieces(path)
    return REMEMBERED[path]


def _tree(matrices: DataFrame, fan: int) -> DataFrame:
    """row, number, entry, entry_over, leave, leave_over of every chunk from its matrix (row, number, matrix)."""
    node = "row long, number long, matrix binary"
    states = ("entry", "entry_over", "leave", "leave_over")

    def up(table: pa.Table) -> pa.Table:
        rows = sorted(zip(table.column("number").to_pylist(), table.column("matrix").to_pylist()))
        made = pickle.dumps(product([pickle.loads(m) for _, m in rows]))
        return pa.table({"row": [table.column("row")[0].as_py()], "number": [rows[0][0] // fan], "matrix": [made]})

    def down(table: pa.Table) -> pa.Table:
        rows = sorted(zip(*(table.column(c).to_pylist() for c in ("number", "matrix", *states))), key=lambda r: r[0])
        _, _, entry, over, leave, leave_over = rows[0]
        on = solve([pickle.loads(r[1]) for r in rows], (BEGIN, 0) if entry is None else (entry, over), None if leave is None else (leave, leave_over))
        return pa.table({
            "row": [table.column("row")[0].as_py()] * len(rows), "number": [r[0] for r in rows],
            **{c: pa.array([s[i][j] for s in on], pa.int64()) for c, (i, j) in zip(states, ((0, 0), (0, 1), (1, 0), (1, 1)))},
        })

    parent = F.floor(F.col("number") / fan).alias("parent")
    levels = [matrices]
    while (levels[-1].agg(F.max("number")).first()[0] or 0) >= fan:
        levels.append(stage(levels[-1].groupBy("row", parent).applyInArrow(up, node), "piece-tree"))
    solved = None
    for level in reversed(levels):
        children = level.withColumn("parent", F.floor(F.col("number") / fan))
        if solved is None:
            asked = children.select("*", *[F.lit(None).cast("long").alias(c) for c in states])
        else:
            known = solved.select("row", F.col("number").alias("parent"), *states)
            asked = children.join(known, ["row", "parent"])
        solved = asked.groupBy("row", "parent").applyInArrow(down, "row long, number long, " + ", ".join(f"{c} long" for c in states))
    return solved


def _long(docs: DataFrame, path: str, chunk: int, fan: int) -> DataFrame:
    """doc_id, ids of texts of the chunk length or more: matrices, tree, backtraces."""
    schema = "row long, doc_id long, number long, low long, high long, z string"
    names = [c.split()[0] for c in schema.split(", ")]
    tasks = partitions(docs.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, around = TaskContext.get().partitionId() << 40, 2 * pieces(path).longest
        for whole in batches:
            for doc, text in zip(whole.column("doc_id").to_pylist(), whole.column("text").to_pylist()):
                z = marked(text)
                for at in range(0, len(z), 64 * chunk):
                    rows = []
                    for start in range(at, min(len(z), at + 64 * chunk), chunk):
                        low, high = max(0, start - around), min(len(z), start + chunk)
                        rows.append((row, doc, start // chunk, start - low, high - low, z[low : high + around]))
                    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(),) * 5 + (pa.string(),))], names)
                row += 1

    chunks = stage(docs.mapInArrow(lean(cut, keeps=True), schema).repartition(tasks, "row", "number"), "piece-chunks")

    def transfers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(path)
        for b in batches:
            made = [pickle.dumps(model.transfer(z, low, high, n == 0)) for n, low, high, z in zip(*(b.column(c).to_pylist() for c in ("number", "low", "high", "z")))]
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("number"), pa.array(made, pa.binary())], ["row", "number", "matrix"])

    matrices = stage(chunks.select("row", "number", "low", "high", "z").mapInArrow(lean(transfers, keeps=True), "row long, number long, matrix binary"), "piece-matrices")
    solved = _tree(matrices, fan)

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(path)
        for b in batches:
            ids = [model.backtrace(r["z"], r["low"], r["high"], (r["entry"], r["entry_over"]), (r["leave"], r["leave_over"])).tobytes() for r in b.to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("doc_id"), b.column("number"), pa.array(ids, pa.binary())], ["row", "doc_id", "number", "ids"])

    # dealt by chunk: a few bytes of states would else bring all chunks of a text into few tasks
    spelt = chunks.join(solved, ["row", "number"]).repartition(tasks, "row", "number").mapInArrow(lean(spell, keeps=True), "row long, doc_id long, number long, ids binary")

    def whole(table: pa.Table) -> pa.Table:
        order = np.argsort(np.asarray(table.column("number")))
        return pa.table({"doc_id": pa.array([table.column("doc_id")[0].as_py()], pa.int64()), "ids": [joined(table.column("ids").take(pa.array(order)), np.uint16).tobytes()]})

    return spelt.groupBy("row").applyInArrow(whole, "doc_id long, ids binary")


def encode(docs: DataFrame, path: str, chunk: int = CHUNK, fan: int = FAN) -> DataFrame:
    """doc_id, ids (little-endian 16-bit numbers) of every row of docs."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    size = F.coalesce(F.length("text"), F.lit(0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(path)
        for b_ in batches:
            for b in slices(b_, limit=SLICE_BYTES // 4):  # its words are many times its bytes
                got = model.encode_marked([marked(t) for t in b.column("text").to_pylist()])
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(got, pa.binary())], ["doc_id", "ids"])

    bound_batches(docs.sparkSession)
    short = rows.filter(size < chunk).mapInArrow(lean(run, keeps=True), "doc_id long, ids binary")
    return short.unionByName(_long(rows.filter(size >= chunk), path, chunk, fan))


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, text of encoded rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([model.decode(np.frombuffer(i, np.uint16)) for i in b.column("ids").to_pylist()], pa.string())], ["doc_id", "text"])

    return encoded.mapInArrow(run, "doc_id long, text string")


def digest(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_crc32 (little-endian 32-bit ids), decoded_chars and decoded_sha256 of the text decoded from the ids."""
    schema = "doc_id long, n_tokens long, ids_crc32 long, decoded_chars long, decoded_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(path)
        for b in batches:
            rows = []
            for doc, raw in zip(b.column("doc_id").to_pylist(), b.column("ids").to_pylist()):
                ids = np.frombuffer(raw, np.uint16)
                text = model.decode(ids)
                rows.append((doc, len(ids), crc32_of(ids.astype("<u4").tobytes()), len(text), hashlib.sha256(text.encode()).hexdigest()))
            frame = pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])
            frame["doc_id"] = frame["doc_id"].astype("Int64")
            yield pa.RecordBatch.from_pandas(frame, preserve_index=False)

    return encoded.mapInArrow(run, schema)


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("piece_bpe_32k.model")
    return digest(encode(documents(spark, sf_dir), path), path)


QUERIES = {"op7_sentencepiece": op7_sentencepiece}
ORACLE: dict[str, str] = {}
