"""Compound binary files (the container of macro projects): a reader, and a writer for fixtures."""

from __future__ import annotations

import struct

MAGIC = bytes.fromhex("d0cf11e0a1b11ae1")
END, FREE, FAT, NONE = 0xFFFFFFFE, 0xFFFFFFFF, 0xFFFFFFFD, 0xFFFFFFFF


class CompoundFile:
    """Streams by their path, such as `VBA/dir`; names are matched in any case."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC or len(data) < 512:
            raise ValueError("not a compound file")
        self.data = data
        shift, mini_shift = struct.unpack_from("<HH", data, 30)
        self.size, self.mini_size = 1 << shift, 1 << mini_shift
        first_dir, _, self.cutoff, first_mini, _, first_more, _ = struct.unpack_from("<7I", data, 48)
        blocks = [b for b in struct.unpack_from("<109I", data, 76) if b < FAT]
        seen = set()
        while first_more < FAT and first_more not in seen:
            seen.add(first_more)
            more = struct.unpack(f"<{self.size // 4}I", self._sector(first_more))
            blocks += [b for b in more[:-1] if b < FAT]
            first_more = more[-1]
        self.fat = [x for b in blocks for x in struct.unpack(f"<{self.size // 4}I", self._sector(b))]
        raw = self._chain(first_mini)
        self.mini_fat = struct.unpack(f"<{len(raw) // 4}I", raw)
        table = self._chain(first_dir)
        self.entries = []
        for at in range(0, len(table) - 127, 128):
            n = struct.unpack_from("<H", table, at + 64)[0]
            left, right, child = struct.unpack_from("<3I", table, at + 68)
            start, size = struct.unpack_from("<IQ", table, at + 116)
            self.entries.append((table[at : at + max(0, n - 2)].decode("utf-16-le"), table[at + 66], left, right, child, start, size & 0xFFFFFFFF))
        self.mini = self._chain(self.entries[0][5])
        self.paths: dict[str, int] = {}
        self.names: dict[str, str] = {}
        self._walk(self.entries[0][4], "", set())

    def _sector(self, i: int) -> bytes:
        return self.data[(i + 1) * self.size : (i + 2) * self.size]

    def _chain(self, i: int) -> bytes:
        out, seen = [], set()
        while i < FAT:
            if i in seen or i >= len(self.fat):
                raise ValueError("a broken chain of sectors")
            seen.add(i)
            out.append(self._sector(i))
            i = self.fat[i]
        return b"".join(out)

    def _walk(self, i: int, prefix: str, seen: set[int]) -> None:
        todo = [(i, prefix)]
        while todo:
            i, prefix = todo.pop()
            if i >= len(self.entries) or i in seen:
                continue
            seen.add(i)
            name, _, left, right, child, _, _ = self.entries[i]
            path = prefix + name
            self.paths[path.lower()], self.names[path.lower()] = i, path
            todo += [(left, prefix), (right, prefix), (child, path + "/")]

    def has(self, path: str) -> bool:
        return path.lower() in self.paths

    def storages(self) -> list[str]:
        return [self.names[p] for p, i in self.paths.items() if self.entries[i][1] == 1]

    def read(self, path: str) -> bytes:
        if not self.has(path):
            raise KeyError(path)
        _, _, _, _, _, start, size = self.entries[self.paths[path.lower()]]
        if size >= self.cutoff:
            return self._chain(start)[:size]
        out, i = [], start
        while i < FAT and len(out) * self.mini_size < size:
            out.append(self.mini[i * self.mini_size : (i + 1) * self.mini_size])
            i = self.mini_fat[i]
        return b"".join(out)[:size]


def write_compound(streams: dict[str, bytes]) -> bytes:
    """A compound file of 512-byte sectors; paths have one storage at most."""
    sectors: list[bytes] = []
    fat: list[int] = []

    def put(data: bytes) -> int:
        if not data:
            return END
        first = len(sectors)
        n = -(-len(data) // 512)
        for k in range(n):
            sectors.append(data[k * 512 : (k + 1) * 512].ljust(512, b"\0"))
            fat.append(first + k + 1 if k < n - 1 else END)
        return first

    mini, mini_fat, place = b"", [], {}
    for path, data in streams.items():
        if len(data) >= 4096:
            place[path] = put(data)
        elif data:
            first, n = len(mini_fat), -(-len(data) // 64)
            mini_fat += [first + k + 1 for k in range(n - 1)] + [END]
            mini += data.ljust(n * 64, b"\0")
            place[path] = first
        else:
            place[path] = END
    mini_start = put(mini)
    mini_fat_start = put(struct.pack(f"<{len(mini_fat)}I", *mini_fat).ljust(-(-len(mini_fat) // 128) * 512, b"\xff")) if mini_fat else END
    folders = sorted({p.split("/")[0] for p in streams if "/" in p})
    rows = [["Root Entry", 5, NONE, NONE, NONE, mini_start, len(mini)]]

    def siblings(indexes: list[int]) -> int:
        for a, b in zip(indexes, indexes[1:], strict=False):
            rows[a][3] = b
        return indexes[0] if indexes else NONE

    top: list[int] = []
    for folder in folders:
        rows.append([folder, 1, NONE, NONE, NONE, 0, 0])
        at, own = len(rows) - 1, []
        top.append(at)
        for path, data in streams.items():
            if path.startswith(folder + "/"):
                rows.append([path.split("/", 1)[1], 2, NONE, NONE, NONE, place[path], len(data)])
                own.append(len(rows) - 1)
        rows[at][4] = siblings(own)
    for path, data in streams.items():
        if "/" not in path:
            rows.append([path, 2, NONE, NONE, NONE, place[path], len(data)])
            top.append(len(rows) - 1)
    rows[0][4] = siblings(top)
    table = b""
    for name, kind, left, right, child, start, size in rows:
        raw = name.encode("utf-16-le") + b"\0\0"
        table += raw.ljust(64, b"\0") + struct.pack("<HBB3I", len(raw), kind, 1, left, right, child) + bytes(36) + struct.pack("<IQ", start, size)
    dir_start = put(table.ljust(-(-len(table) // 512) * 512, b"\0"))
    n_fat = 1
    while n_fat * 128 < len(sectors) + n_fat:
        n_fat += 1
    blocks = [len(sectors) + k for k in range(n_fat)]
    full = (fat + [FAT] * n_fat + [FREE] * (n_fat * 128))[: n_fat * 128]
    sectors += [struct.pack("<128I", *full[k * 128 : (k + 1) * 128]) for k in range(n_fat)]
    head = MAGIC + bytes(16) + struct.pack("<HHHHH", 0x3E, 3, 0xFFFE, 9, 6) + bytes(6) + struct.pack("<9I", 0, n_fat, dir_start, 0, 4096, mini_fat_start, -(-len(mini_fat) // 128), END, 0)
    return head + struct.pack("<109I", *(blocks + [FREE] * 109)[:109]) + b"".join(sectors)
