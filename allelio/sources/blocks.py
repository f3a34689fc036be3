"""Binary files that Spark has no reader for: a Python data source of block-gzip text, and the decoding of PLINK files.

Files are split into byte ranges, so a large file is read by many tasks, each in constant memory.
"""

from __future__ import annotations

import fnmatch
import json
import posixpath
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# Fixed values of the two formats.
BGZF_MAGIC = b"\x1f\x8b\x08\x04"
BGZF_EXTRA = b"\x06\x00BC\x02\x00"
BGZF_HEADER = 18
BGZF_FOOTER = 8
BED_MAGIC = b"\x6c\x1b\x01"
BED_MISSING, BED_REF = 1, 3
BED_ALT_DOSAGE = np.array([2, 0, 1, 0], dtype=np.int32)

BATCH_LINES = 10_000
BATCH_CALLS = 16_000_000


def list_files(path: str) -> list[tuple[str, int]]:
    """(path, size) of a file, of the files of a folder, or of those matching a pattern in the last path part."""
    system, root = fs.FileSystem.from_uri(path)
    prefix = path[: len(path) - len(root)]
    folder, name = posixpath.split(root)
    info = None if any(ch in name for ch in "*?[") else system.get_file_info(root)
    if info is not None and info.type == fs.FileType.File:
        found = [info]
    elif info is not None:
        found = system.get_file_info(fs.FileSelector(root, recursive=True))
    else:
        found = [f for f in system.get_file_info(fs.FileSelector(folder)) if fnmatch.fnmatch(f.base_name, name)]
    files = [f for f in found if f.type == fs.FileType.File and not f.base_name.startswith(("_", "."))]
    return sorted((prefix + f.path, f.size) for f in files)


def open_file(path: str):
    system, root = fs.FileSystem.from_uri(path)
    return system.open_input_file(root)


class ByteRange(InputPartition):
    def __init__(self, path: str, start: int, end: int):
        self.path, self.start, self.end = path, start, end


def first_line(path: str) -> str:
    """First line of a block-gzip file, without reading more than it."""
    for line in bgzf_lines(path, 0, 1):
        return line.rstrip(b"\r").decode()
    return ""


# --- block gzip -------------------------------------------------------------


def _is_block(buf: bytes, at: int) -> bool:
    return buf[at : at + 4] == BGZF_MAGIC and buf[at + 10 : at + 16] == BGZF_EXTRA


def _block_size(header: bytes) -> int:
    return int.from_bytes(header[16:18], "little") + 1


def _first_block(f, start: int, size: int) -> int:
    """Offset of the first block at or after ``start``; a block is at most 64 KiB, so two of them hold a header."""
    buf = f.read_at(min(2 * 65536 + BGZF_HEADER, size - start), start)
    at = buf.find(BGZF_MAGIC)
    while at >= 0:
        if _is_block(buf, at):
            after = start + at + _block_size(buf[at : at + BGZF_HEADER])
            if after >= size or _is_block(f.read_at(BGZF_HEADER, after), 0):
                return start + at
        at = buf.find(BGZF_MAGIC, at + 1)
    return size


def _blocks(f, at: int, size: int) -> Iterator[tuple[int, bytes]]:
    """(offset, text) of the blocks from ``at`` on."""
    while at + BGZF_HEADER <= size:
        header = f.read_at(BGZF_HEADER, at)
        if not _is_block(header, 0):
            raise ValueError(f"no block-gzip header at byte {at}; a plain gzip file must be named .gz")
        length = _block_size(header)
        body = f.read_at(length - BGZF_HEADER - BGZF_FOOTER, at + BGZF_HEADER)
        yield at, zlib.decompress(body, wbits=-15)
        at += length


def bgzf_lines(path: str, start: int, end: int) -> Iterator[bytes]:
    """Lines of a byte range: all that begin in it, plus the one that begins at its end.

    A range that does not begin the file leaves out its first line, which belongs to the range before it.
    """
    with open_file(path) as f:
        size = f.size()
        first = start if start == 0 else _first_block(f, start, size)
        if first >= end:
            return
        skipping, rest = start > 0, b""
        for at, text in _blocks(f, first, size):
            lines = (rest + text).split(b"\n")
            rest = lines.pop()
            if at >= end:
                if skipping:  # one line covers the whole range
                    return
                if lines:
                    yield lines[0]
                    return
            else:
                if skipping and lines:
                    lines.pop(0)
                    skipping = False
                yield from lines
        if rest and not skipping:
            yield rest


# --- position indexes of block-gzip files ------------------------------------

# Fixed values of the index formats.
TBI_MAGIC, CSI_MAGIC = b"TBI\x01", b"CSI\x01"
TBI_SHIFT, TBI_DEPTH = 14, 5


def covering_bins(start: int, end: int, shift: int, depth: int) -> list[int]:
    """Numbers of all bins that may hold a record that overlaps the 0-based half-open range, from the widest to the narrowest."""
    bins: list[int] = []
    first, width = 0, shift + 3 * depth
    for level in range(depth + 1):
        bins += range(first + (start >> width), first + (end - 1 >> width) + 1)
        first, width = first + (1 << 3 * level), width - 3
    return bins


class PositionIndex:
    """A ``.tbi`` or ``.csi`` index: per contig the chunks of each bin, and the offset from which records reach a window."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 4
        self.csi = data[:4] == CSI_MAGIC
        if not self.csi and data[:4] != TBI_MAGIC:
            raise ValueError("neither a .tbi nor a .csi index")
        self.shift, self.depth = (self._ints(2) if self.csi else (TBI_SHIFT, TBI_DEPTH))
        if self.csi:
            (aux,) = self._ints(1)
            names = data[self.at + 28 : self.at + aux]
            self.at += aux
            (n,) = self._ints(1)
        else:
            n, *_, size = self._ints(8)
            names = data[self.at : self.at + size]
            self.at += size
        self.names = [x.decode() for x in names.split(b"\0") if x]
        self.refs = [self._contig() for _ in range(n)]

    def _ints(self, n: int) -> tuple[int, ...]:
        self.at += 4 * n
        return struct.unpack_from(f"<{n}i", self.data, self.at - 4 * n)

    def _longs(self, n: int) -> tuple[int, ...]:
        self.at += 8 * n
        return struct.unpack_from(f"<{n}Q", self.data, self.at - 8 * n)

    def _contig(self) -> tuple[dict[int, list[tuple[int, int]]], tuple[int, ...]]:
        bins: dict[int, list[tuple[int, int]]] = {}
        for _ in range(self._ints(1)[0]):
            number = self._ints(1)[0] & 0xFFFFFFFF
            if self.csi:
                self._longs(1)
            ends = self._longs(2 * self._ints(1)[0])
            bins[number] = list(zip(ends[::2], ends[1::2], strict=True))
        return bins, () if self.csi else self._longs(self._ints(1)[0])

    def chunks(self, contig: str, start: int, end: int) -> list[tuple[int, int]]:
        """Virtual offsets (file offset of a block << 16 | offset in its text) of what may overlap a 1-based closed range."""
        plain = contig.removeprefix("chr")
        found: list[tuple[int, int]] = []
        for name, (bins, windows) in zip(self.names, self.refs, strict=True):
            if name.removeprefix("chr") == plain:
                # Positions the index cannot name lie behind all bins.
                first, last = max(start - 1, 0), min(end, 1 << self.shift + 3 * self.depth)
                window = first >> self.shift
                least = windows[min(window, len(windows) - 1)] if windows else 0
                if first < last:
                    found += [c for b in covering_bins(first, last, self.shift, self.depth) for c in bins.get(b, []) if c[1] > least]
        return found


def read_index(path: str) -> PositionIndex | None:
    """The index beside a block-gzip file, if there is one."""
    for ending in (".tbi", ".csi"):
        system, root = fs.FileSystem.from_uri(path + ending)
        if system.get_file_info(root).type == fs.FileType.File:
            with system.open_input_file(root) as f:
                return PositionIndex(b"".join(text for _, text in _blocks(f, 0, f.size())))
    return None


class VirtualRange(InputPartition):
    def __init__(self, path: str, start: int, end: int):
        self.path, self.start, self.end = path, start, end


def indexed_ranges(path: str, index: PositionIndex, regions: list[tuple[str, int, int]], split: int) -> list[VirtualRange]:
    """Ranges of a file that hold all records of the regions, none twice, about ``split`` compressed bytes at most."""
    out: list[VirtualRange] = []
    for start, end in sorted({c for r in regions for c in index.chunks(*r)}):
        if out and start <= out[-1].end:
            if end <= out[-1].end:
                continue
            if (out[-1].end >> 16) - (out[-1].start >> 16) < split:
                out[-1].end = end
                continue
            start = out[-1].end
        out.append(VirtualRange(path, start, end))
    return out


def virtual_lines(path: str, start: int, end: int) -> Iterator[bytes]:
    """Lines between two virtual offsets; indexes name only beginnings of lines."""
    rest = b""
    with open_file(path) as f:
        for at, text in _blocks(f, start >> 16, f.size()):
            if at > end >> 16:
                break
            text = text[: end & 0xFFFF] if at == end >> 16 else text
            lines = (rest + (text[start & 0xFFFF :] if at == start >> 16 else text)).split(b"\n")
            rest = lines.pop()
            yield from lines
    if rest:
        yield rest


class BgzfReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.split = int(options.get("splitbytes", 64 * 1024 * 1024))
        self.regions = [tuple(r) for r in json.loads(options["regions"])] if "regions" in options else None

    def partitions(self) -> list[InputPartition]:
        out: list[InputPartition] = []
        for path, size in list_files(self.path):
            if path.endswith((".tbi", ".csi")):
                continue
            index = None if self.regions is None else read_index(path)
            if index is not None:
                out += indexed_ranges(path, index, self.regions, self.split)
            else:
                out += [ByteRange(path, at, min(at + self.split, size)) for at in range(0, size, self.split)]
        return out or [ByteRange("", 0, 0)]

    def read(self, partition: ByteRange | VirtualRange) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        batch: list[str] = []
        lines = virtual_lines if isinstance(partition, VirtualRange) else bgzf_lines
        top = partition.start == 0

        def rows() -> pa.RecordBatch:
            first = [top, *[False] * (len(batch) - 1)]
            return pa.RecordBatch.from_pydict({"value": batch, "path": [partition.path] * len(batch), "first": first})

        for line in lines(partition.path, partition.start, partition.end):
            batch.append(line.rstrip(b"\r").decode())
            if len(batch) == BATCH_LINES:
                yield rows()
                batch, top = [], False
        if batch:
            yield rows()


class BgzfText(DataSource):
    """``spark.read.format("bgzf_text").load(path)``: lines of block-gzip files, split inside a file.

    ``path`` names a line's file, ``first`` tells whether it is the file's first line. Option ``regions`` (JSON of contig, start, end,
    closed) opens only the blocks that a ``.tbi`` or ``.csi`` index beside a file names for them; other lines may come with them.
    """

    @classmethod
    def name(cls) -> str:
        return "bgzf_text"

    def schema(self) -> str:
        return "value string, path string, first boolean"

    def reader(self, schema) -> BgzfReader:
        return BgzfReader(self.options)


# --- PLINK ------------------------------------------------------------------


def decode_bed(raw: bytes, n_variants: int, n_samples: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(variant, sample, ALT dosage, missing) of all calls that are not homozygous reference."""
    packed = np.frombuffer(raw, dtype=np.uint8).reshape(n_variants, -1)
    codes = np.stack([(packed >> shift) & 3 for shift in (0, 2, 4, 6)], axis=2).reshape(n_variants, -1)[:, :n_samples]
    variant, sample = np.nonzero(codes != BED_REF)
    code = codes[variant, sample]
    return variant, sample, BED_ALT_DOSAGE[code], code == BED_MISSING


def bed_size(path: str) -> int:
    """Bytes of a variant-major ``.bed`` file behind its magic number; other files are refused."""
    with open_file(path) as f:
        if f.read_at(3, 0) != BED_MAGIC:
            raise ValueError(f"not a variant-major .bed file: {path}")
        return f.size() - 3


def lines_between(path: str, start: int, end: int) -> list[bytes]:
    """Lines of a plain text file that begin in a byte range."""
    with open_file(path) as f:
        size = f.size()
        at = max(start - 1, 0)
        data = f.read_at(min(end, size) - at, at)
        # A line that begins before the range ends at the range's start or inside it, or covers it wholly.
        begin = 0 if start == 0 else data.find(b"\n") + 1
        if start and not begin:
            return []
        at = min(end, size)
        while not data.endswith(b"\n") and at < size:  # the last line goes on
            more = f.read_at(min(4096, size - at), at)
            cut = more.find(b"\n") + 1
            data, at = data + (more[:cut] if cut else more), at + len(more)
        return [x for x in data[begin:].split(b"\n") if x.strip()]


def plink_sites(lines: list[bytes]) -> dict[str, np.ndarray]:
    """``contig, pos, ref, alt, variant_id`` of ``.bim`` lines; allele 1 is ALT, contigs are named with prefix."""
    cells = [line.split() for line in lines]
    codes = {b"23": "X", b"24": "Y", b"25": "X", b"26": "M"}
    text = lambda i: np.array([c[i].decode() for c in cells], object)
    plain = [c[0][3:] if c[0].startswith(b"chr") else c[0] for c in cells]
    contig = np.array(["chr" + (codes.get(c) or c.decode()) for c in plain], object)
    return {"contig": contig, "pos": np.array([int(c[3]) for c in cells], np.int64), "ref": text(5), "alt": text(4), "variant_id": text(1)}


def plink_calls(stem: str, first: int, lines: list[bytes], samples: pa.Array, keep: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Calls of the variants of consecutive ``.bim`` lines that are kept; ``first`` is the first one's number in the file."""
    sites, n = plink_sites(lines), len(samples)
    stride = (n + 3) // 4
    step = max(1, BATCH_CALLS // max(n, 1))
    with open_file(f"{stem}.bed") as f:
        for at in range(0, len(lines), step):
            some = np.flatnonzero(keep[at : at + step])
            if not len(some):
                continue
            a, b = at + int(some[0]), at + int(some[-1]) + 1
            variant, sample, dosage, missing = decode_bed(f.read_at((b - a) * stride, 3 + (first + a) * stride), b - a, n)
            kept = keep[a + variant]
            variant, sample, dosage, missing = a + variant[kept], sample[kept], dosage[kept], missing[kept]
            columns = [pa.array(sites[c]).take(pa.array(variant)) for c in ("contig", "pos", "ref", "alt", "variant_id")]
            yield pa.RecordBatch.from_arrays(
                [*columns, samples.take(pa.array(sample)), pa.array(dosage, mask=missing), pa.array([stem] * len(variant), pa.string())],
                names=["contig", "pos", "ref", "alt", "variant_id", "sample_id", "alt_dosage", "path"],
            )
