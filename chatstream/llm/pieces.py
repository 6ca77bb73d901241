"""SentencePiece encoding and decoding for merge-type vocabularies.

Encoding keeps an agenda of adjacent symbol pairs ordered by the score of the piece they would form (ties: leftmost
first). The best pair is merged, its new neighbours enter the agenda, and so on until no pair forms a piece. Two
neighbouring characters that are neighbours in no piece can never end up in one symbol, so a text falls into segments
there. The distinct segments of a slice of texts are encoded together: each has a row of pair orders as its agenda,
and every round takes the best pair of each row. Very long segments use a heap as agenda. Each distinct segment is
checked against the sentencepiece library, in both directions and one call per slice; a difference raises. Texts are
encoded whole; memory is bounded by ``SLICE_CHARS`` or the longest single text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from chatstream.llm.common import once, text_or_empty

MARK = "▁"
#: Code points that are encoded together, unless one text is longer; a worker holds about 45 bytes for each.
SLICE_CHARS = 500_000
#: The same where a job does nothing else: more memory for less time, as a slice's distinct segments are checked once.
ALONE_SLICE_CHARS = 4_000_000
#: Longer segments get a heap instead of a row.
ROW_LENGTH = 128
NONE = np.int32(2**31 - 1)


class Pieces:
    """One vocabulary, from the model file."""

    def __init__(self, model: bytes):
        import sentencepiece

        self.library = lib = sentencepiece.SentencePieceProcessor(model_proto=model)
        size = lib.get_piece_size()
        plain = [i for i in range(size) if not (lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i) or lib.is_unused(i))]
        self.piece_of = {i: lib.id_to_piece(i) for i in plain}
        self.id_of = {p: i for i, p in self.piece_of.items()}
        self.order = {p: -lib.get_score(i) for p, i in self.id_of.items()}
        self.byte_id = {int(lib.id_to_piece(i)[1:-1], 16): i for i in range(size) if lib.is_byte(i)}
        self.byte_of = {i: b for b, i in self.byte_id.items()}
        self.end_id = lib.eos_id()
        if len(self.byte_id) != 256 or max(self.byte_of) - min(self.byte_of) != 255 or any("\n" in p for p in self.id_of) or lib.normalize("a  b ") != f"{MARK}a{MARK}{MARK}b{MARK}":
            raise ValueError("a vocabulary with byte fallback, line feeds in no piece and plain space marks is needed")
        self.written = [str(i) for i in range(size)]
        self.spelling = [self.piece_of.get(i, "").replace(MARK, " ") for i in range(size)]
        self.last_byte = max(self.byte_of)
        self._tables(size)

    def _tables(self, size: int) -> None:
        """Symbol of each character, pairs of symbols that form a piece, pairs of characters found in pieces."""
        longer = [p for p in self.id_of if len(p) > 1]
        inside = sorted({c for p in longer for c in p})
        symbol = {**self.id_of, **{c: size + k for k, c in enumerate(c for c in inside if c not in self.id_of)}}
        self.first_unknown = size
        self.symbol_of = np.full(0x110000, 2 * size, np.int32)
        for c, k in symbol.items():
            if len(c) == 1:
                self.symbol_of[ord(c)] = k
        self.base = np.int64(2 * size + 1)
        rank = {s: k for k, s in enumerate(sorted(set(self.order.values())))}
        pairs = sorted((symbol[p[:k]] * int(self.base) + symbol[p[k:]], rank[self.order[p]], self.id_of[p]) for p in longer for k in range(1, len(p)) if p[:k] in symbol and p[k:] in symbol)
        self.pair_key, self.pair_rank, self.pair_id = np.array([x[0] for x in pairs], np.int64), np.array([x[1] for x in pairs], np.int32), np.array([x[2] for x in pairs], np.int32)
        self.inside = np.zeros(0x110000, np.int32)
        self.inside[[ord(c) for c in inside]] = np.arange(1, len(inside) + 1)
        self.next_to = np.zeros((len(inside) + 1, len(inside) + 1), bool)
        a, b = np.array(sorted({(ord(x), ord(y)) for p in longer for x, y in zip(p, p[1:])})).T
        self.next_to[self.inside[a], self.inside[b]] = True

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Order and id of the piece that two symbols form; NONE where they form none."""
        key = left.astype(np.int64) * self.base + right
        at = np.searchsorted(self.pair_key, key)
        at[at == len(self.pair_key)] = 0
        hit = self.pair_key[at] == key
        return np.where(hit, self.pair_rank[at], NONE), self.pair_id[at]

    def merge_rows(self, symbols: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Symbols left in each row after all merges, -1 elsewhere. Rows are filled up to their lengths."""
        rows, width = symbols.shape
        place = np.arange(width, dtype=np.int32)
        symbols = np.where(place < lengths[:, None], symbols, -1)
        after, before = np.tile(place + 1, (rows, 1)), np.tile(place - 1, (rows, 1))
        agenda, made = np.full((rows, width), NONE, np.int32), np.zeros((rows, width), np.int32)
        if width > 1:
            agenda[:, :-1], made[:, :-1] = self._pairs(symbols[:, :-1], symbols[:, 1:])
            agenda[:, :-1][symbols[:, 1:] < 0] = NONE
        live = np.arange(rows)
        while len(live):
            i = agenda[live].argmin(1)
            open_ = agenda[live, i] != NONE
            live, i = live[open_], i[open_]
            if not len(live):
                break
            j, new = after[live, i], made[live, i]
            k = after[live, j]
            symbols[live, i], symbols[live, j], agenda[live, j], after[live, i] = new, -1, NONE, k
            more = k < lengths[live]
            agenda[live[~more], i[~more]] = NONE
            r, x, y = live[more], i[more], k[more]
            before[r, y] = x
            agenda[r, x], made[r, x] = self._pairs(symbols[r, x], symbols[r, y])
            h = before[live, i]
            more = h >= 0
            r, x, y = live[more], h[more], i[more]
            agenda[r, x], made[r, x] = self._pairs(symbols[r, x], symbols[r, y])
        return symbols

    def merge_long(self, segment: str) -> list[int]:
        """Ids of one segment, with a heap as agenda."""
        order = self.order
        symbols: list[str | None] = list(segment)
        last = len(symbols)
        after, before = list(range(1, last + 1)), list(range(-1, last - 1))
        agenda = [(order[pair], i, pair) for i, pair in enumerate(map(str.__add__, segment, segment[1:])) if pair in order]
        heapify(agenda)
        while agenda:
            _, i, piece = heappop(agenda)
            left = symbols[i]
            if left is None or (j := after[i]) >= last or left + symbols[j] != piece:
                continue
            symbols[i], symbols[j] = piece, None
            after[i] = k = after[j]
            if k < last:
                before[k] = i
                if (pair := piece + symbols[k]) in order:
                    heappush(agenda, (order[pair], i, pair))
            if (h := before[i]) >= 0 and (pair := symbols[h] + piece) in order:
                heappush(agenda, (order[pair], h, pair))
        return [i for s in symbols if s is not None for i in self._ids_of(s)]

    def _ids_of(self, symbol: str) -> list[int]:
        known = self.id_of.get(symbol)
        return [self.byte_id[b] for b in symbol.encode()] if known is None else [known]

    def encode_segments(self, points: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> list[list[int]]:
        """Ids of each segment points[start:start + length]."""
        out: list[list[int]] = [[]] * len(starts)
        low = 0
        for high in (4, 8, 16, 32, 64, ROW_LENGTH):
            which = np.flatnonzero((lengths > low) & (lengths <= high))
            low = high
            if not len(which):
                continue
            at = np.minimum(starts[which, None] + np.arange(high), len(points) - 1)
            left = self.merge_rows(self.symbol_of[points[at]], lengths[which])
            ids, ends = left[left >= 0].tolist(), np.cumsum((left >= 0).sum(1)).tolist()
            strange = (left >= self.first_unknown).any(1).tolist()
            begin = 0
            for row, (k, end) in enumerate(zip(which.tolist(), ends, strict=True)):
                if strange[row]:
                    cells = np.flatnonzero(left[row] >= 0).tolist()
                    first = int(starts[k])
                    out[k] = [x for c in cells for x in ([int(left[row, c])] if left[row, c] < self.first_unknown else self._ids_of(chr(points[first + c])))]
                else:
                    out[k] = ids[begin:end]
                begin = end
        for k in np.flatnonzero(lengths > ROW_LENGTH).tolist():
            out[k] = self.merge_long(_text(points[starts[k]:starts[k] + lengths[k]]))
        return out

    def encode_slice(self, texts: list[str]) -> tuple[list[list[int]], list[str], list[np.ndarray]]:
        """Ids and text of each distinct segment; per text the numbers of its segments in order."""
        marked = [MARK + t.replace(" ", MARK) if t else "" for t in texts]
        whole = "".join(marked)
        points = np.frombuffer(whole.encode("utf-32-le"), np.uint32).astype(np.int64)
        if not len(points):
            return [], [], [np.zeros(0, np.int64)] * len(texts)
        ends = np.cumsum([len(t) for t in marked])
        kind = self.inside[points]
        first = np.empty(len(points), bool)
        first[0] = True
        first[1:] = ~self.next_to[kind[:-1], kind[1:]]
        first[ends[ends < len(points)]] = True
        starts = np.flatnonzero(first)
        lengths = np.diff(starts, append=len(points))
        _, one, number = np.unique(_hashes(points, starts, lengths), return_index=True, return_inverse=True)
        segments = [whole[a:b] for a, b in zip(starts[one].tolist(), (starts + lengths)[one].tolist(), strict=True)]
        ids = self.encode_segments(points, starts[one], lengths[one])
        self.check(segments, ids)
        return ids, segments, np.split(number, np.searchsorted(starts, ends[:-1]))

    def encode(self, text: str) -> list[int]:
        """Ids of one text, without an end id."""
        ids, _, numbers = self.encode_slice([text])
        return [i for k in numbers[0].tolist() for i in ids[k]]

    def decode(self, ids: list[int]) -> str:
        """Pieces joined, bytes read as UTF-8 (wrong ones as U+FFFD), marks as spaces, without the one leading space."""
        text = self.spelled(ids)
        return text[1:] if text.startswith(" ") else text

    def spelled(self, ids: list[int]) -> str:
        if min(ids, default=0) > self.last_byte:
            return "".join(map(self.spelling.__getitem__, ids))
        out, run = [], bytearray()
        for i in ids:
            if i in self.byte_of:
                run.append(self.byte_of[i])
                continue
            if run:
                out.append(run.decode("utf-8", "replace"))
                run = bytearray()
            out.append(self.spelling[i])
        out.append(run.decode("utf-8", "replace"))
        return "".join(out)

    def check(self, segments: list[str], ids: list[list[int]]) -> None:
        """Hold the segments against the library, both ways.

        The library sets a mark before each text. It stands for a segment's own first mark; before other segments goes
        a line feed, whose ids are known.
        """
        lead, byte = self.library.encode("\n"), "\n"
        marked = [s for s in segments if s[0] == MARK and len(s) > 1]
        mine = dict(zip(segments, ids, strict=True))
        expected = [mine[s] for s in marked]
        bare = [s[1:].replace(MARK, " ") for s in marked]
        inner = [s for s in segments if s[0] != MARK]
        for what, texts, wanted in (("marked", bare, expected), ("inner", [byte + s for s in inner], [lead + mine[s] for s in inner])):
            if (theirs := self.library.encode(texts, num_threads=1)) != wanted:
                at = next(k for k, (x, y) in enumerate(zip(theirs, wanted, strict=True)) if x != y)
                raise AssertionError(f"{what} segment {texts[at]!r}: {wanted[at]}, the library has {theirs[at]}")
        for texts, found in ((bare, expected), (inner, [mine[s] for s in inner])):
            if texts and self.library.decode(found, num_threads=1) != texts:  # without ids it gives one empty text
                raise AssertionError("the library decodes a segment in another way")


def _text(points: np.ndarray) -> str:
    return points.astype(np.uint32).tobytes().decode("utf-32-le")


def _hashes(points: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """64-bit hash of each segment: a sum of mixed (character, place in the segment)."""
    place = np.arange(len(points)) - np.repeat(starts, lengths)
    with np.errstate(over="ignore"):
        x = (points.astype(np.uint64) + (place.astype(np.uint64) << np.uint64(21)) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(32)
        x *= np.uint64(0x94D049BB133111EB)
        return np.add.reduceat(x, starts)


def pieces_of(model: bytes) -> Pieces:
    """One vocabulary per worker process, however many tasks it runs."""
    return once(hashlib.sha256(model).hexdigest(), lambda: Pieces(model))


def read_model(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encode_documents(documents: DataFrame, model_path: str, *, with_ids: bool = True, slice_chars: int = SLICE_CHARS) -> DataFrame:
    """Adds ``n_tokens``, ``ids`` (text of decimal ids, one space between), ``ids_sha256`` and ``decoded_sha256``.

    Ids end with the end id. Null and empty texts have that id alone and decode to an empty text. Rows are returned as
    often as they come; columns of these four names are replaced, all others stay. ``with_ids=False`` leaves ``ids``
    out of the result. The model file is read once on the driver and goes along with the tasks.
    """
    model, made = read_model(model_path), ["n_tokens", "ids", "ids_sha256", "decoded_sha256"]
    kept = documents.drop(*made)
    schema = T.StructType([*kept.schema.fields, T.StructField("n_tokens", T.LongType()), *([T.StructField("ids", T.StringType())] if with_ids else []), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])
    where = kept.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pieces_of(model)
        for batch in batches:
            for part in slices(batch, where, slice_chars):
                yield pa.RecordBatch.from_arrays([*part.columns, *_encoded(pieces, [t or "" for t in part.column(where).to_pylist()], with_ids)], names=schema.names)

    return kept.mapInArrow(run, schema)


def slices(batch: pa.RecordBatch, where: int, slice_chars: int = SLICE_CHARS) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in slices with up to ``slice_chars`` code points in the column ``where``, or one longer text."""
    sizes, start = pa.compute.fill_null(pa.compute.utf8_length(batch.column(where)), 0).to_pylist(), 0
    while start < len(sizes):
        end, total = start + 1, sizes[start]
        while end < len(sizes) and total + sizes[end] <= slice_chars:
            total += sizes[end]
            end += 1
        yield batch.slice(start, end - start)
        start = end


def _encoded(pieces: Pieces, texts: list[str], with_ids: bool) -> list[pa.Array]:
    ids, _, numbers = pieces.encode_slice(texts)
    counts = np.array([len(x) for x in ids], np.int64)
    written = [" ".join([pieces.written[i] for i in x]) for x in ids]
    spelled = [pieces.spelled(x) for x in ids]
    end = pieces.written[pieces.end_id]
    n, joined, of_ids, of_text = [], [], [], []
    for own in numbers:
        order = own.tolist()
        line = " ".join([*map(written.__getitem__, order), end])
        text = "".join(map(spelled.__getitem__, order))
        n.append(int(counts[own].sum()) + 1)
        of_ids.append(hashlib.sha256(line.encode()).hexdigest())
        of_text.append(hashlib.sha256((text[1:] if text[:1] == " " else text).encode()).hexdigest())
        if with_ids:
            joined.append(line)
    return [pa.array(n, pa.int64()), *([pa.array(joined, pa.string())] if with_ids else []), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())]


def encoded_digest(documents: DataFrame, model_path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each row."""
    return encode_documents(documents.select("doc_id", text_or_empty("text").alias("text")), model_path, with_ids=False, slice_chars=ALONE_SLICE_CHARS).drop("text")
