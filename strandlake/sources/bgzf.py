"""Blocked gzip (BGZF) files and their position indexes, read and written by pieces.

A BGZF file is a series of gzip members of at most 64 KB; a virtual offset (member's place << 16 | place within) names any byte, so
tasks can start at any record. Indexes (TBI, CSI, BAI) list, for bins of positions, runs of virtual offsets.
Files lie in any store that pyarrow.fs knows; local ones without a scheme too.
"""

from __future__ import annotations

import re
import struct
import time
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from typing import BinaryIO, TypeVar

from pyarrow import fs

T = TypeVar("T")
END = (1 << 31) - 1
#: Bytes read at a time, and bytes of text in a member.
PIECE, MEMBER = 1 << 22, 0xFF00
# The member that ends a file, and the magic of indexes.
EOF = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
TBI, CSI, BAI = b"TBI\1", b"CSI\1", b"BAI\1"
#: Bits of a window of the linear index, levels of bins, and the bin of totals of a BAI.
SHIFT, DEPTH = 14, 5


def retried(action: Callable[[], T], attempts: int = 3, wait: float = 1.0) -> T:
    """SRC-11: within a task: again after an error of input, after 1 and 2 seconds. A missing file is no such error."""
    for k in range(attempts):
        try:
            return action()
        except (FileNotFoundError, IsADirectoryError, PermissionError):
            raise
        except OSError:
            if k == attempts - 1:
                raise
            time.sleep(wait * 2**k)
    raise ValueError("attempts must be positive")


def store(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path and the path in it."""
    if re.match(r"[a-z][a-z0-9+.-]+://", path) and not path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), re.sub(r"^file:(//)?(?=/)", "", path)


def exists(path: str) -> bool:
    system, at = store(path)
    return system.get_file_info(at).type == fs.FileType.File


def size(path: str) -> int:
    system, at = store(path)
    info = system.get_file_info(at)
    if info.type != fs.FileType.File:
        raise FileNotFoundError(path)
    return info.size


def opened(path: str) -> BinaryIO:
    system, at = store(path)
    return retried(lambda: system.open_input_file(at))


def listed(path: str, suffixes: tuple[str, ...]) -> list[str]:
    """A file, or the files of a folder with such names, in order."""
    system, at = store(path)
    if system.get_file_info(at).type != fs.FileType.Directory:
        return [path]
    names = [x.base_name for x in system.get_file_info(fs.FileSelector(at)) if x.type == fs.FileType.File and x.base_name.endswith(suffixes) and x.base_name[0] not in "._"]
    return [f"{path.rstrip('/')}/{n}" for n in sorted(names)]


# members --------------------------------------------------------------------------------------------------


def member_size(head: bytes) -> int:
    """Bytes of the member that begins with head, or 0 if it is none of a blocked file."""
    if len(head) < 18 or head[:4] != b"\x1f\x8b\x08\x04":
        return 0
    at, end = 12, 12 + struct.unpack_from("<H", head, 10)[0]
    while at + 4 <= min(end, len(head)):
        tag, n = head[at : at + 2], struct.unpack_from("<H", head, at + 2)[0]
        if tag == b"BC" and n == 2 and at + 6 <= len(head):
            return struct.unpack_from("<H", head, at + 4)[0] + 1
        at += 4 + n
    return 0


def blocked(path: str) -> bool:
    with opened(path) as f:
        return member_size(f.read(64)) > 0


def next_member(path: str, at: int) -> int:
    """Where the first member at or after a byte begins: one whose size leads to another or to the end of the file."""
    n = size(path)
    if at <= 0 or at >= n:
        return min(max(at, 0), n)
    with opened(path) as f:
        f.seek(at)
        data = f.read(min(n - at, 3 << 16))
    found = data.find(b"\x1f\x8b\x08\x04")
    while found >= 0:
        if k := member_size(data[found:]):
            after = data[found + k : found + k + 64]
            if at + found + k == n or member_size(after):
                return at + found
        found = data.find(b"\x1f\x8b\x08\x04", found + 1)
    return n


class Members:
    """Members of a file from a byte on, with their places; `count` tells how many were read."""

    def __init__(self, path: str, start: int = 0):
        self.path, self.start, self.count = path, start, 0

    def __iter__(self) -> Iterator[tuple[int, bytes]]:
        place, held, at = self.start, b"", 0
        with opened(self.path) as f:
            while True:
                if len(held) - at < 1 << 16:
                    where = place + len(held) - at

                    def more(where=where) -> bytes:
                        f.seek(where)
                        return f.read(PIECE)

                    held, at = held[at:] + retried(more), 0
                if at == len(held):
                    return
                k = member_size(held[at : at + 64])
                if not k or at + k > len(held):
                    raise ValueError(f"{self.path}: not a blocked file, or cut short, at {place}")
                extra = struct.unpack_from("<H", held, at + 10)[0]
                self.count += 1
                yield place, zlib.decompress(held[at + 12 + extra : at + k - 8], -15)
                place, at = place + k, at + k


def member(data: bytes, level: int = 6) -> bytes:
    """A member that holds data (at most 64 KB)."""
    packer = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = packer.compress(data) + packer.flush()
    return b"\x1f\x8b\x08\x04\x00\x00\x00\x00\x00\xff\x06\x00BC\x02\x00" + struct.pack("<H", len(body) + 25) + body + struct.pack("<II", zlib.crc32(data), len(data))


def whole(path: str) -> bytes:
    """All of a small file, decompressed if it is packed."""
    with opened(path) as f:
        data = f.read()
    if data[:2] != b"\x1f\x8b":
        return data
    out, at = [], 0
    while at < len(data):
        unpack = zlib.decompressobj(31)
        out.append(unpack.decompress(data[at:]))
        at = len(data) - len(unpack.unused_data)
    return b"".join(out)


def text_lines(members: Members, start: int, stop: int) -> Iterator[list[bytes]]:
    """Lines that begin at virtual offsets from start, where one begins, up to (not with) stop; a list for each member."""
    rest = b""
    for place, data in members:
        if place == start >> 16:
            data = data[start & 0xFFFF :]
            shift = start & 0xFFFF
        else:
            shift = 0
        if place >= stop >> 16:
            # what was begun before is ended; of this member's own lines those before stop
            limit = (stop & 0xFFFF) - shift if place == stop >> 16 else 0
            at = 0
            if rest:
                at = data.find(b"\n") + 1
                if not at:
                    rest += data
                    continue
                yield [rest + data[: at - 1]]
                rest = b""
            own = []
            while at < limit:
                end = data.find(b"\n", at)
                if end < 0:
                    rest = data[at:]
                    break
                own.append(data[at:end])
                at = end + 1
            if own:
                yield own
            if not rest:
                return
            continue
        lines = (rest + data).split(b"\n")
        rest = lines.pop()
        yield lines
    if rest:
        yield [rest]


def first_line(path: str, at: int) -> int:
    """The virtual offset of the first line that begins behind the first line end in or after the first member from a byte on; 0 for the file's own begin."""
    if at <= 0:
        return 0
    behind = False
    for place, data in Members(path, next_member(path, at)):
        if behind:
            return place << 16
        end = data.find(b"\n")
        if 0 <= end < len(data) - 1:
            return place << 16 | end + 1
        behind = end >= 0
    return size(path) << 16


# indexes --------------------------------------------------------------------------------------------------


def bins_of(start: int, stop: int, shift: int = SHIFT, depth: int = DEPTH) -> list[int]:
    """Bins that may hold records overlapping the 0-based half-open range."""
    stop = min(stop, 1 << (shift + 3 * depth)) - 1
    found = []
    first = 0
    for level in range(depth + 1):
        s = shift + 3 * (depth - level)
        found += range(first + (start >> s), first + (stop >> s) + 1)
        first += 1 << (3 * level)
    return found


def bin_of(start: int, stop: int, shift: int = SHIFT, depth: int = DEPTH) -> int:
    """The smallest bin that holds all of the 0-based half-open range."""
    stop -= 1
    for level in range(depth, 0, -1):
        s = shift + 3 * (depth - level)
        if start >> s == stop >> s:
            return ((1 << (3 * level)) - 1) // 7 + (start >> s)
    return 0


class Index:
    """names, and for each name bins (runs of virtual offsets) and the least offset of each window or bin."""

    def __init__(self, shift: int = SHIFT, depth: int = DEPTH):
        self.shift, self.depth = shift, depth
        self.names: list[str] = []
        self.bins: list[dict[int, list[tuple[int, int]]]] = []
        self.linear: list[list[int]] = []
        self.least: list[dict[int, int]] = []

    @classmethod
    def read(cls, path: str) -> Index:
        data = whole(path)
        magic, at = data[:4], 4
        i4 = lambda at, n=1: struct.unpack_from(f"<{n}i", data, at)
        out = cls()
        if magic == CSI:
            out.shift, out.depth, extra = i4(at, 3)
            at += 12
            if extra >= 28:
                out.names = [x.decode() for x in data[at + 28 : at + 28 + i4(at + 24)[0]].split(b"\0")[:-1]]
            at += extra
        elif magic not in (TBI, BAI):
            raise ValueError(f"{path}: not an index")
        (n,) = i4(at)
        at += 4
        if magic == TBI:
            size = i4(at + 24)[0]
            out.names = [x.decode() for x in data[at + 28 : at + 28 + size].split(b"\0")[:-1]]
            at += 28 + size
        totals = ((1 << (3 * (out.depth + 1))) - 1) // 7 + 1  # a bin of counts, no records
        for _ in range(n):
            bins, least = {}, {}
            (k,) = i4(at)
            at += 4
            for _ in range(k):
                number = struct.unpack_from("<I", data, at)[0]
                at += 4
                if magic == CSI:
                    least[number] = struct.unpack_from("<Q", data, at)[0]
                    at += 8
                (m,) = i4(at)
                runs = struct.unpack_from(f"<{2 * m}Q", data, at + 4)
                at += 4 + 16 * m
                if number != totals:
                    bins[number] = list(zip(runs[::2], runs[1::2], strict=True))
            linear: list[int] = []
            if magic != CSI:
                (m,) = i4(at)
                linear = list(struct.unpack_from(f"<{m}Q", data, at + 4))
                at += 4 + 8 * m
            out.bins.append(bins)
            out.linear.append(linear)
            out.least.append(least)
        return out

    def runs(self, i: int, start: int, stop: int) -> list[tuple[int, int]]:
        """Runs of virtual offsets, put together, that may hold records of reference i overlapping the 0-based half-open range."""
        if not 0 <= i < len(self.bins) or stop <= start:
            return []
        bins, linear = self.bins[i], self.linear[i]
        least = 0
        if linear:
            least = linear[min(start >> self.shift, len(linear) - 1)]
        elif self.least[i]:
            number = ((1 << (3 * self.depth)) - 1) // 7 + (start >> self.shift)
            while number not in self.least[i] and number:
                number = (number - 1) >> 3
            least = self.least[i].get(number, 0)
        # a wide range has more bins than there are
        wanted = set(bins_of(start, stop, self.shift, self.depth)) if stop - start < 1 << 26 else None
        some = sorted(r for b, runs in bins.items() if wanted is None or b in wanted for r in runs if r[1] > least)
        return joined(some)

    def cuts(self) -> list[int]:
        """Virtual offsets where records begin, ascending."""
        return sorted({r[0] for bins in self.bins for runs in bins.values() for r in runs} | {x for linear in self.linear for x in linear if x})

    def add(self, name: str, start: int, stop: int, at: int, end: int) -> None:
        """A record, 0-based half-open, that lies at [at, end)."""
        if not self.names or self.names[-1] != name:
            if name in self.names:
                raise ValueError(f"records of {name} don't stand together")
            self.names.append(name)
            self.bins.append(defaultdict(list))
            self.linear.append([])
            self.least.append({})
        runs = self.bins[-1][bin_of(start, stop, self.shift, self.depth)]
        if runs and runs[-1][1] >> 16 == at >> 16:
            runs[-1] = (runs[-1][0], end)
        else:
            runs.append((at, end))
        linear = self.linear[-1]
        for w in range(start >> self.shift, ((stop - 1) >> self.shift) + 1):
            linear.extend([0] * (w + 1 - len(linear)))
            linear[w] = linear[w] or at

    def append(self, other: Index, shift: int) -> None:
        """What another index has, its offsets moved on by so many bytes; names go on in order."""
        by = shift << 16
        for k, name in enumerate(other.names):
            if not self.names or self.names[-1] != name:
                if name in self.names:
                    raise ValueError(f"records of {name} don't stand together")
                self.names.append(name)
                self.bins.append(defaultdict(list))
                self.linear.append([])
                self.least.append({})
            for number, runs in other.bins[k].items():
                self.bins[-1][number] += [(a + by, b + by) for a, b in runs]
            linear = self.linear[-1]
            linear.extend([0] * (len(other.linear[k]) - len(linear)))
            for w, x in enumerate(other.linear[k]):
                if x and not linear[w]:
                    linear[w] = x + by

    def tbi(self) -> bytes:
        """As the bytes of a TBI of variant calls."""
        names = b"".join(n.encode() + b"\0" for n in self.names)
        # Calls; columns of name, begin and end; the mark of comments; no lines to skip
        out = [TBI, struct.pack("<8i", len(self.names), 2, 1, 2, 0, ord("#"), 0, len(names)), names]
        for bins, linear in zip(self.bins, self.linear, strict=True):
            out.append(struct.pack("<i", len(bins)))
            for number, runs in sorted(bins.items()):
                out.append(struct.pack(f"<Ii{2 * len(runs)}Q", number, len(runs), *(x for r in runs for x in r)))
            filled, last = [], 0
            for x in linear:  # a window without records begins where the one before does
                last = x or last
                filled.append(last)
            out.append(struct.pack(f"<i{len(filled)}Q", len(filled), *filled))
        raw = b"".join(out)
        return b"".join(member(raw[i : i + MEMBER]) for i in range(0, len(raw), MEMBER)) + EOF


def joined(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted runs, those that overlap or meet in one member put together."""
    out: list[tuple[int, int]] = []
    for a, b in runs:
        if out and a >> 16 <= out[-1][1] >> 16:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out
