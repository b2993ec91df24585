"""Fill-in-middle transformation over seekable compressed frames.

``store`` turns every text into independent zstandard frames of ``FRAME`` bytes. Each frame carries how many bytes, units (lines) and
code points come before it, so the place after any number of units is found in one frame: a binary search over the
counts, one decompression, one look for the line end. ``transform`` cuts prefix, middle and suffix that way, streams the
frames of the three parts in output order into frames of the output, and rebuilds the text from these; digests are fed
frame by frame, so no step holds a whole text in clear.

A unit is a line with its line end; the last one may lack it. Two hashes of the id choose the cuts, one whether the text
is transformed, one the order of the parts (``psm``: prefix, suffix, middle; ``spm``: suffix, prefix, middle).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.llm.common import prepare

FRAME = 1 << 14
SEED = 7
#: Percent of the texts that are transformed, and of those the percent in the order suffix, prefix, middle.
RATE = 100
SPM = 50
#: What stands before each part.
MARKS = {"prefix": b"<P>", "suffix": b"<S>", "middle": b"<M>"}
ORDERS = {"psm": ("prefix", "suffix", "middle"), "spm": ("suffix", "prefix", "middle"), "plain": ()}

_NEWLINE = 0x0A
# One context of each kind per process: a context holds far more memory than a text.
_COMPRESS = zstandard.ZstdCompressor(level=1)
_DECOMPRESS = zstandard.ZstdDecompressor()


def _code_points(piece: bytes) -> int:
    """Code points that start in some bytes of UTF-8."""
    return int(np.count_nonzero(np.frombuffer(piece, np.int8) >= -64))


class Writer:
    """Bytes in, frames out: ``frames`` holds ``(data, bytes, units, chars)`` with the counts before each frame."""

    def __init__(self, size: int = FRAME):
        self.size, self.frames = size, []
        self.bytes = self.units = self.chars = 0
        self.digest = hashlib.sha256()
        self._held = bytearray()

    def write(self, piece: bytes) -> None:
        self.digest.update(piece)
        self._held += piece
        while len(self._held) >= self.size:
            self._flush(self.size)

    def _flush(self, size: int) -> None:
        piece = bytes(self._held[:size])
        del self._held[:size]
        self.frames.append((_COMPRESS.compress(piece), self.bytes, self.units, self.chars))
        self.bytes += len(piece)
        self.units += piece.count(b"\n")
        self.chars += _code_points(piece)

    def close(self) -> Frames:
        if self._held:
            self._flush(len(self._held))
        return Frames(*(list(x) for x in zip(*self.frames, strict=True)), total=(self.bytes, self.units, self.chars)) \
            if self.frames else Frames([], [], [], [], (0, 0, 0))


class Frames:
    """One stored text: frames in order, the counts before each, and the counts of all (bytes, line ends, code points)."""

    def __init__(self, data, before, units, chars, total):
        self.data, self.total = data, total
        self.before, self.units, self.chars = (np.array(x, np.int64) for x in (before, units, chars))

    def frame(self, i: int) -> bytes:
        return _DECOMPRESS.decompress(self.data[i])

    @property
    def lines(self) -> int:
        """Units of the text: its line ends, and one more where text follows the last of them."""
        if not self.data:
            return 0
        return self.total[1] + (not self.frame(len(self.data) - 1).endswith(b"\n"))

    def after(self, units: int, lines: int) -> tuple[int, int]:
        """``(bytes, code points)`` before the end of the first ``units`` of ``lines`` units; decompresses one frame at most."""
        if units == 0:
            return 0, 0
        if units == lines:
            return self.total[0], self.total[2]
        i = int(np.searchsorted(self.units, units)) - 1
        piece = self.frame(i)
        ends = np.flatnonzero(np.frombuffer(piece, np.uint8) == _NEWLINE)
        at = int(ends[units - self.units[i] - 1]) + 1
        return int(self.before[i]) + at, int(self.chars[i]) + _code_points(piece[:at])

    def stream(self, low: int, high: int) -> Iterator[bytes]:
        """The bytes ``low`` to ``high``, frame by frame."""
        i = max(int(np.searchsorted(self.before, low, "right")) - 1, 0)
        while i < len(self.data) and self.before[i] < high:
            start = int(self.before[i])
            yield self.frame(i)[max(low - start, 0): high - start]
            i += 1

    def find(self, mark: bytes, low: int = 0) -> int:
        """Place of the first ``mark`` at or after byte ``low``, -1 if there is none; marks may lie across frames."""
        held, at = b"", low
        for piece in self.stream(low, self.total[0]):
            held += piece
            found = held.find(mark)
            if found >= 0:
                return at + found
            keep = min(len(held), len(mark) - 1)
            at += len(held) - keep
            held = held[len(held) - keep:]
        return -1


def draws(key, seed: int = SEED) -> list[int]:
    """Four numbers under 2^32 from an id (null counts as an empty one)."""
    name = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    return [int(name[i: i + 8], 16) for i in range(0, 32, 8)]


def rearranged(text: Frames, key, rate: int = RATE, spm: int = SPM, seed: int = SEED, size: int = FRAME):
    """``form, lines, prefix chars, middle chars, output`` of one stored text."""
    lines, (first, second, chosen, order) = text.lines, draws(key, seed)
    out = Writer(size)
    if not text.data or chosen % 100 >= rate or any(text.find(m) >= 0 for m in MARKS.values()):
        for piece in text.stream(0, text.total[0]):
            out.write(piece)
        return "plain", lines, None, None, out
    form = "spm" if order % 100 < spm else "psm"
    low, high = sorted((first % (lines + 1), second % (lines + 1)))
    (a, a_chars), (b, b_chars) = text.after(low, lines), text.after(high, lines)
    parts = {"prefix": (0, a), "middle": (a, b), "suffix": (b, text.total[0])}
    for part in ORDERS[form]:
        out.write(MARKS[part])
        for piece in text.stream(*parts[part]):
            out.write(piece)
    return form, lines, a_chars, b_chars - a_chars, out


def restored(output: Frames, form: str) -> Iterator[bytes]:
    """The text an output was made from, piece by piece: the marks are found in the output alone."""
    if form == "plain":
        yield from output.stream(0, output.total[0])
        return
    starts, at = {}, 0
    for part in ORDERS[form]:
        at = output.find(MARKS[part], at) + len(MARKS[part])
        starts[part] = at
    ends = dict(zip(ORDERS[form], [starts[p] - len(MARKS[p]) for p in ORDERS[form][1:]] + [output.total[0]], strict=True))
    for part in ("prefix", "middle", "suffix"):
        yield from output.stream(starts[part], ends[part])


_FRAME = pa.struct([("data", pa.binary()), ("bytes", pa.int64()), ("units", pa.int64()), ("chars", pa.int64())])
_STORED = ("_id {kind}, n_bytes long, n_line_ends long, n_chars long, "
           "frames array<struct<data: binary, bytes: long, units: long, chars: long>>")


def _column(stored: list[Frames]) -> list[pa.Array]:
    rows = [[dict(zip(("data", "bytes", "units", "chars"), f, strict=True))
             for f in zip(t.data, t.before.tolist(), t.units.tolist(), t.chars.tolist(), strict=True)] for t in stored]
    totals = [pa.array([t.total[i] for t in stored], pa.int64()) for i in range(3)]
    return [*totals, pa.array(rows, pa.list_(_FRAME))]


def _frames_of(rows: pa.RecordBatch, first: int) -> Iterator[Frames]:
    """Frames of the rows of a batch whose columns ``first`` to ``first + 3`` are the totals and the frames."""
    totals = [rows.column(first + i).to_pylist() for i in range(3)]
    for i in range(rows.num_rows):
        frames = rows.column(first + 3)[i].as_py() or []
        yield Frames([f["data"] for f in frames], [f["bytes"] for f in frames], [f["units"] for f in frames],
                     [f["chars"] for f in frames], tuple(t[i] for t in totals))


def store(docs: DataFrame, text: str = "text", key: str = "doc_id", size: int = FRAME) -> DataFrame:
    """``key, n_bytes, n_line_ends, n_chars, frames``: every text as frames of ``size`` bytes of UTF-8. A null text has none."""
    prepare(docs.sparkSession)

    def run(batches):
        for batch in batches:
            stored = []
            for value in batch.column(1):
                writer = Writer(size)
                writer.write((value.as_py() or "").encode())
                stored.append(writer.close())
            yield pa.RecordBatch.from_arrays([batch.column(0), *_column(stored)],
                                             ["_id", "n_bytes", "n_line_ends", "n_chars", "frames"])
    plain = docs.select(F.col(key).alias("_id"), F.col(text).alias("_text"))
    return plain.mapInArrow(run, _STORED.format(kind=plain.schema["_id"].dataType.simpleString())).withColumnRenamed("_id", key)


_DIGESTS = ["n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
_KINDS = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
_OUTPUT = ["output_bytes", "output_line_ends", "output_chars", "output_frames"]


def transform(stored: DataFrame, key: str = "doc_id", rate: int = RATE, spm: int = SPM, seed: int = SEED,
              size: int = FRAME, outputs: bool = False) -> DataFrame:
    """``key, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256`` of what ``store`` returns.

    With ``outputs`` the transformed texts follow as frames (``output_frames`` and their totals); ``texts`` reads them.
    """
    def run(batches):
        for batch in batches:
            rows, made = [], []
            for name, text in zip(batch.column(0).to_pylist(), _frames_of(batch, 1), strict=True):
                form, lines, prefix, middle, out = rearranged(text, name, rate, spm, seed, size)
                output, back = out.close(), hashlib.sha256()
                for piece in restored(output, form):
                    back.update(piece)
                rows.append((lines, form, prefix, middle, out.digest.hexdigest(), back.hexdigest()))
                if outputs:
                    made.append(output)
            columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate(_KINDS)]
            more = _column(made) if outputs else []
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns, *more], ["_id", *_DIGESTS, *(_OUTPUT if outputs else [])])
    kind = stored.schema[key].dataType.simpleString()
    schema = (f"_id {kind}, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string")
    if outputs:
        schema += ", " + _STORED.format(kind=kind).split(", ", 1)[1].replace("n_", "output_").replace("frames ", "output_frames ")
    return (stored.select(F.col(key).alias("_id"), "n_bytes", "n_line_ends", "n_chars", "frames")
            .mapInArrow(run, schema).withColumnRenamed("_id", key))


def _clear(frames: list[bytes]) -> str:
    return b"".join(map(_DECOMPRESS.decompress, frames)).decode()


def texts(stored: DataFrame, frames: str = "frames", text: str = "text") -> DataFrame:
    """Adds the stored text in clear as column ``text``."""
    def run(values: pa.Array) -> pa.Array:
        return pa.array([_clear([f["data"] for f in v.as_py() or []]) for v in values], pa.string())
    return stored.withColumn(text, F.arrow_udf(run, "string")(F.col(frames)))


def fill_in_middle(docs: DataFrame, text: str = "text", key: str = "doc_id", rate: int = RATE, spm: int = SPM,
                   seed: int = SEED, size: int = FRAME, outputs: bool = False) -> DataFrame:
    """``store`` and ``transform`` in one: one row per document.

    Null and empty texts, and texts that hold a mark, are plain: output and text are the same. A null id draws as an empty
    one. Repeated rows repeat the result; other columns are not read. An empty table gives an empty result.
    """
    return transform(store(docs, text, key, size), key, rate, spm, seed, size, outputs)
