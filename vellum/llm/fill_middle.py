"""Fill-in-the-middle transformation over seekable compressed frames.

``stored`` keeps every text as independent zstandard frames of FRAME code points at
most, each with the number of code points before it.  Any range of a text can then be
read by decompressing only the frames that hold it.  ``transformed`` cuts a text by
reading the frames around its cuts, writes the output as frames of the same kind, and
streams frames in order for the digests, so that no more than a frame of a text is
ever open at once.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterable, Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.store import written

#: Code points of a frame.
FRAME = 1 << 16
# The marks before prefix, suffix and middle, and the seed of the cuts.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = "1:"
PLAIN, PSM, SPM = "plain", "psm", "spm"
#: How a text with the marks of each form is laid out, as names of its parts.
ORDER = {PSM: ((PREFIX, "prefix"), (SUFFIX, "suffix"), (MIDDLE, "middle")), SPM: ((SUFFIX, "suffix"), (PREFIX, "prefix"), (MIDDLE, "middle"))}

KIND = pa.struct([("start", pa.int64()), ("units", pa.int64()), ("data", pa.binary())])
SQL_KIND = "struct<start: bigint, units: bigint, data: binary>"


class Frames:
    """A text as frames: (code points before, code points, compressed UTF-8)."""

    def __init__(self, frames: list[tuple[int, int, bytes]]):
        self.frames = frames
        self.starts = [f[0] for f in frames]
        self.n = sum(f[1] for f in frames)

    @classmethod
    def of(cls, parts: Iterable[str], compress, size: int = FRAME) -> Frames:
        """The frames of the concatenation of ``parts``, made while they come."""
        out, n, held, room = [], 0, [], 0
        for part in parts:
            while part:
                take = part[: size - room]
                held.append(take)
                room += len(take)
                part = part[len(take) :]
                if room == size:
                    out.append((n, room, compress("".join(held).encode())))
                    n, held, room = n + room, [], 0
        if room:
            out.append((n, room, compress("".join(held).encode())))
        return cls(out)

    def read(self, begin: int, end: int, expand) -> Iterator[str]:
        """Code points ``begin`` up to ``end``, a piece of a frame at a time; other frames stay closed."""
        k = max(bisect_right(self.starts, begin) - 1, 0)
        while begin < end and k < len(self.frames):
            start, units, data = self.frames[k]
            whole = expand(data).decode()
            yield whole[begin - start : end - start] if begin > start or end < start + units else whole
            begin, k = start + units, k + 1

    def stream(self, expand) -> Iterator[str]:
        return self.read(0, self.n, expand)

    def find(self, mark: str, begin: int, expand) -> int:
        """The place of the first ``mark`` from ``begin`` on, -1 if there is none; marks across two frames count."""
        at, tail = begin, ""
        for part in self.read(begin, self.n, expand):
            text = tail + part
            k = text.find(mark)
            if k >= 0:
                return at - len(tail) + k
            at += len(part)
            tail = text[max(len(text) - len(mark) + 1, 0) :]
        return -1


def digest(parts: Iterable[str]) -> str:
    total = hashlib.sha256()
    for part in parts:
        total.update(part.encode())
    return total.hexdigest()


def layout(doc_id: int | None, text: Frames, expand) -> tuple[str, int, int]:
    """(form, end of the prefix, end of the middle)."""
    name = hashlib.sha256(f"{SEED}{'' if doc_id is None else doc_id}".encode()).hexdigest()
    a, b, odd, turned = (int(name[k : k + 8], 16) for k in (0, 8, 16, 24))
    first, second = sorted((a % (text.n + 1), b % (text.n + 1)))
    if not text.n or odd % 100 >= 90 or any(text.find(m, 0, expand) >= 0 for m in (PREFIX, SUFFIX, MIDDLE)):
        return PLAIN, 0, 0
    return SPM if turned % 100 < 20 else PSM, first, second


def arranged(text: Frames, form: str, first: int, second: int, expand) -> Iterator[str]:
    """The output, piece by piece."""
    if form == PLAIN:
        yield from text.stream(expand)
        return
    ranges = {"prefix": (0, first), "middle": (first, second), "suffix": (second, text.n)}
    for mark, part in ORDER[form]:
        yield mark
        yield from text.read(*ranges[part], expand)


def restored(output: Frames, form: str, expand) -> Iterator[str]:
    """The text again, from the output and its form alone, piece by piece."""
    if form == PLAIN:
        yield from output.stream(expand)
        return
    places, at = [], 0
    for mark, _ in ORDER[form]:
        at = output.find(mark, at, expand)
        places.append((at, at + len(mark)))
        at += len(mark)
    ends = [p[0] for p in places[1:]] + [output.n]
    ranges = {part: (begin, end) for (_, part), (_, begin), end in zip(ORDER[form], places, ends)}
    for part in ("prefix", "middle", "suffix"):
        yield from output.read(*ranges[part], expand)


def stored(docs: DataFrame, size: int = FRAME) -> DataFrame:
    """(doc_id, n code points, n_bytes UTF-8, frames) of every row: the seekable store of the texts.

    Null texts count as empty and have no frame.  Null and repeated doc_ids keep their
    rows; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compress = zstandard.ZstdCompressor(level=3, write_content_size=True).compress
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                rows = []
                for doc, text in zip(batch.column(0)[k : k + 256].to_pylist(), batch.column(1)[k : k + 256], strict=True):
                    text = text.as_py() or ""
                    rows.append((doc, len(text), len(text.encode()), Frames.of([text], compress, size).frames))
                doc, n, n_bytes, frames = zip(*rows, strict=True)
                frames = pa.array([[dict(zip(("start", "units", "data"), f)) for f in each] for each in frames], pa.list_(KIND))
                yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(n, pa.int64()), pa.array(n_bytes, pa.int64()), frames], ["doc_id", "n", "n_bytes", "frames"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, f"doc_id long, n long, n_bytes long, frames array<{SQL_KIND}>")


def transformed(store: DataFrame, size: int = FRAME, with_output: bool = False) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256[, output]) of every row of a store.

    ``output`` is the transformed text as frames; prefix_chars and middle_chars are null
    for plain ones.  The cuts of a null doc_id are those of the seed alone.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compress = zstandard.ZstdCompressor(level=1, write_content_size=True).compress
        expand = zstandard.ZstdDecompressor().decompress
        kinds = [("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output_sha256", pa.string()), ("restored_sha256", pa.string())]
        kinds += [("output", pa.list_(KIND))] * with_output
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                rows = []
                for doc, frames in zip(batch.column(0)[k : k + 256].to_pylist(), batch.column(1)[k : k + 256], strict=True):
                    text = Frames([(f["start"], f["units"], f["data"]) for f in frames.as_py()])
                    form, first, second = layout(doc, text, expand)
                    output = Frames.of(arranged(text, form, first, second, expand), compress, size)
                    sizes = (None, None) if form == PLAIN else (first, second - first)
                    row = (doc, text.n, form, *sizes, digest(output.stream(expand)), digest(restored(output, form, expand)))
                    rows.append(row + ([dict(zip(("start", "units", "data"), f)) for f in output.frames],) * with_output)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), kinds, strict=True)], [name for name, _ in kinds])

    schema = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string"
    return store.select("doc_id", "frames").mapInArrow(run, schema + f", output array<{SQL_KIND}>" * with_output)


def fill_in_middle(docs: DataFrame) -> DataFrame:
    """``transformed`` of the documents, whose store is written to the shared folder first."""
    return transformed(written(stored(docs), "frames"))


ORACLE_SQL = """
with cut as (
  select doc_id, coalesce(text, '') as t, length(coalesce(text, '')) as n, sha256('1:' || coalesce(cast(doc_id as varchar), '')) as h from documents
), hashed as (
  select *, cast('0x' || substr(h, 1, 8) as bigint) % (n + 1) as a, cast('0x' || substr(h, 9, 8) as bigint) % (n + 1) as b,
    cast('0x' || substr(h, 17, 8) as bigint) % 100 as odd, cast('0x' || substr(h, 25, 8) as bigint) % 100 as turned from cut
), placed as (
  select doc_id, t, n, least(a, b) as p, greatest(a, b) as q,
    case when n = 0 or odd >= 90 or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') then 'plain' when turned < 20 then 'spm' else 'psm' end as form from hashed
), parts as (
  select *, substr(t, 1, p) as x, substr(t, p + 1, q - p) as y, substr(t, q + 1) as z from placed
)
select doc_id, n, form, case when form <> 'plain' then p end as prefix_chars, case when form <> 'plain' then q - p end as middle_chars,
  sha256(case form when 'plain' then t when 'psm' then '<P>' || x || '<S>' || z || '<M>' || y else '<S>' || z || '<P>' || x || '<M>' || y end) as output_sha256,
  sha256(t) as restored_sha256
from parts
"""
