"""Mesh and grid file layouts: headers are parsed on the driver, rows are read by ranges on the workers.

A layout knows its variables and zones and reads any range of a zone's nodes or elements, so a partition of a
scan is (zone, first row, rows), whatever the size of a zone.
"""

from __future__ import annotations

import copy
import io
import re
import struct
from dataclasses import dataclass, field, replace

import numpy as np
from pyarrow import fs

# Fixed values of the file formats.
MESH_ID = "_binary_79fbed93-3277-4ee4-accb-6f156987aa7a"
GRID_ID = "RectGridData_6810e83e-3d8c-4ee4-974e-3def6bfa6497"
GRID_VERSION = 1
ANIMATION_VARIABLES = ["x", "y", "z", "DP_DT", "U", "GRAD_RO", "Qcr"]
HEADER_BYTES = 12
ELEMENT_TYPES = {"TRIANGLE": "triangle", "QUADRILATERAL": "quad", "TETRAHEDRON": "tetrahedron", "BRICK": "hexahedron"}
ELEMENT_NODES = {"triangle": 3, "quad": 4, "tetrahedron": 4, "hexahedron": 8}
RECORDS = {"ZONE", "TEXT", "GEOMETRY", "CUSTOMLABELS", "DATASETAUXDATA", "VARAUXDATA"}
ORDINALS = ["bool", "int8", "uint8", "int16", "uint16", "int64", "uint64", "int64", "uint64", "int32", "uint32", "float32", "float64"]
MISSING = 0xFFFFFFFF


class FormatError(ValueError):
    """A file that doesn't follow its format."""


def opened(path: str) -> io.BufferedIOBase:
    """A file of any store that Arrow knows, or a local one."""
    if "://" in path:
        system, at = fs.FileSystem.from_uri(path)
        return system.open_input_file(at)
    return fs.LocalFileSystem().open_input_file(path)


def beside(path: str, name: str) -> str:
    """A file named in a manifest: absolute, or next to the manifest."""
    return name if name.startswith("/") or "://" in name else f"{path.rpartition('/')[0] or '.'}/{name}"


@dataclass
class Zone:
    title: str
    nodes: int
    elements: int = 0
    etype: str = "quad"
    shape: list[int] | None = None  # nodes per axis of an ordered zone
    point: bool = True
    at: int = 0  # the byte where its rows begin
    marks: list[int] = field(default_factory=list)  # of text: the bytes where every MARK-th of its rows begins


#: Rows of a text between two places that a reader can begin at.
MARK = 1 << 14


@dataclass
class Layout:
    path: str
    variables: list[str]
    zones: list[Zone] = field(default_factory=list)

    def part(self, zone: int, first: int, rows: int) -> Layout:
        """What a reader of these rows needs, without looking through the file again."""
        return self

    def read_nodes(self, zone: int, first: int, rows: int) -> np.ndarray:
        raise NotImplementedError

    def read_elements(self, zone: int, first: int, rows: int) -> np.ndarray:
        """Node numbers; -1 for a missing node."""
        z = self.zones[zone]
        if z.shape is None:
            raise FormatError("this format has no connectivity")
        return ordered_elements(z.shape, first, rows)


def roles(variables: list[str]) -> tuple[list[str], list[str]]:
    """Coordinates in order of axis, and fields in file order. Single letters x, y, z (any case) are coordinates."""
    found: dict[str, str] = {}
    fields = []
    for v in variables:
        if v.lower() in ("x", "y", "z"):
            if v.lower() in found:
                raise FormatError(f"coordinate {v} occurs twice")
            found[v.lower()] = v
        else:
            fields.append(v)
    names = "".join(sorted(found))
    if names not in ("x", "xy", "xyz"):
        raise FormatError(f"coordinates {names or 'none'} have a gap")
    return [found[a] for a in names], fields


def ordered_elements(shape: list[int], first: int, rows: int) -> np.ndarray:
    """Cells of an ordered zone, counter-clockwise, by their number (i fastest)."""
    dims = [n for n in shape if n > 1] or [1]
    cells = [max(n - 1, 1) for n in dims]
    at, out, stride = np.arange(first, first + rows), 0, 1
    for n, c in zip(dims, cells, strict=True):
        out = out + at % c * stride
        at, stride = at // c, stride * n
    ring = [0, 1] if len(dims) == 1 else [0, 1, 1 + dims[0], dims[0]]
    if len(dims) == 3:
        ring = ring + [r + dims[0] * dims[1] for r in ring]
    return np.asarray(out)[:, None] + np.array(ring)


def ordered_count(shape: list[int]) -> int:
    n = 1
    for s in shape:
        n *= max(s - 1, 1)
    return n


# -- text meshes -------------------------------------------------------------


def tokens(text: str) -> list[tuple[str, list[str]]]:
    """``name = args`` pairs; arguments may be quoted, separated by blanks, tabs or commas."""
    words = re.findall(r'"([^"]*)"|([^\s,="]+)|(=)', text)
    flat = [("=", True) if eq else (bare or quoted, False) for quoted, bare, eq in words]
    out: list[tuple[str, list[str]]] = []
    for i, (word, eq) in enumerate(flat):
        if eq:
            continue
        if i + 1 < len(flat) and flat[i + 1][1]:
            out.append((word.upper(), []))
        elif out:
            out[-1][1].append(word)
        else:
            raise FormatError(f"value without a name: {word}")
    return out


def first_word(line: str) -> str:
    return re.split(r"[\s,]", line.strip(), maxsplit=1)[0].upper()


def text_header(text: str) -> tuple[str, list[str], str]:
    """Title, variables and file type."""
    title, variables, kind = "", [], "FULL"
    for name, args in tokens(text):
        if name == "TITLE" and args:
            title = args[0]
        elif name == "VARIABLES":
            variables = args
        elif name == "FILETYPE" and args:
            kind = args[0].upper()
            if kind not in ("FULL", "GRID", "SOLUTION"):
                raise FormatError(f"unknown file type {kind}")
        else:
            raise FormatError(f"unknown header property {name}")
    return title, variables, kind


def text_zone(text: str) -> Zone:
    """A zone record's tokens; ordered and finite-element options exclude each other; unknown ones are ignored."""
    z, ordered, shape = Zone("", 0), None, [1, 1, 1]

    def kind(is_ordered: bool, name: str) -> None:
        nonlocal ordered
        if ordered is not None and ordered != is_ordered:
            raise FormatError(f"option {name} does not fit the zone's type")
        ordered = is_ordered

    def whole(args: list[str], name: str) -> int:
        if not args or not re.fullmatch(r"[+-]?\d+", args[0]):
            raise FormatError(f"option {name} needs a whole number")
        return int(args[0])

    for name, args in tokens(text):
        if name == "T":
            if not args:
                raise FormatError("option T needs an argument")
            z.title = args[0]
        elif name == "N":
            kind(False, name)
            z.nodes = whole(args, name)
        elif name == "E":
            kind(False, name)
            z.elements = whole(args, name)
        elif name == "ET":
            kind(False, name)
            if not args or args[0] not in ELEMENT_TYPES:
                raise FormatError(f"invalid element type {args}")
            z.etype = ELEMENT_TYPES[args[0]]
        elif name == "F":
            form = args[0].upper() if args else ""
            if form not in ("POINT", "FEPOINT", "BLOCK", "FEBLOCK"):
                raise FormatError(f"invalid data form {form}")
            kind(not form.startswith("FE"), name)
            z.point = form.endswith("POINT")
        elif name in ("I", "J", "K"):
            kind(True, name)
            shape["IJK".index(name)] = whole(args, name)
    if ordered:
        z.shape, z.nodes = shape, shape[0] * shape[1] * shape[2]
        z.etype = "quad" if min(shape) < 2 else "hexahedron"
        z.elements = ordered_count(shape)
    return z


class TextMesh(Layout):
    """Text mesh: header, then zone records with node rows (and connectivity, numbered from 1)."""

    def __init__(self, path: str):
        super().__init__(path, [])
        header, zone_text, skipping, need, in_header, place, seen = "", None, False, 0, True, 0, 0
        for raw in io.BufferedReader(_Raw(opened(path)), 1 << 20):
            begin, place = place, place + len(raw)
            if need:
                if (text := raw.strip()) and not text.startswith(b"#"):
                    if seen % MARK == 0:
                        self.zones[-1].marks.append(begin)
                    seen, need = seen + 1, need - 1
                continue
            line = raw.decode("utf-8", "replace")
            if not line.strip() or line.strip().startswith("#"):
                continue
            word = first_word(line)
            if in_header and word not in RECORDS:
                header += " " + line.rstrip("\r\n")
                continue
            if in_header:
                in_header = False
                self.title, self.variables, self.kind = text_header(header)
            if word in RECORDS:
                skipping = word != "ZONE"
                if zone_text is not None:
                    self._close(zone_text, None)
                zone_text = None if skipping else line.strip()[4:]
            elif skipping or zone_text is None:
                continue
            elif re.match(r"\s*[-+.\d]", line):
                z = self._close(zone_text, begin)
                zone_text, seen = None, 1
                z.marks.append(begin)
                need = self._lines(z) - 1
            else:
                zone_text += " " + line.rstrip("\r\n")
        if in_header:
            self.title, self.variables, self.kind = text_header(header)
        if need:
            raise FormatError("the file ends inside a zone")

    def part(self, zone: int, first: int, rows: int) -> TextMesh:
        out = copy.copy(self)
        out.zones = [replace(z, marks=[]) for z in self.zones]
        z = self.zones[zone]
        for skip in (first, z.nodes + first):  # as node rows, and as rows of connectivity
            k = skip // MARK
            if k < len(z.marks):
                out.zones[zone].marks += [-1] * (k + 1 - len(out.zones[zone].marks))
                out.zones[zone].marks[k] = z.marks[k]
        return out

    def _lines(self, z: Zone) -> int:
        if not z.point:
            raise FormatError("block form is not supported")
        return z.nodes + (0 if z.shape else z.elements)

    def _close(self, text: str, number: int | None) -> Zone:
        z = text_zone(text)
        if number is None:
            raise FormatError("a zone without data")
        z.at = number
        self.zones.append(z)
        return z

    def _rows(self, zone: int, skip: int, rows: int, kind) -> np.ndarray:
        file, out = opened(self.path), []
        file.seek(self.zones[zone].marks[skip // MARK])
        skip %= MARK
        for raw in io.BufferedReader(_Raw(file), 1 << 20):
            text = raw.strip()
            if not text or text.startswith(b"#"):
                continue
            if skip:
                skip -= 1
                continue
            out.append(np.array(text.split(), dtype=kind))
            if len(out) == rows:
                return np.stack(out)
        raise FormatError("the file ends inside a zone")

    def read_nodes(self, zone: int, first: int, rows: int) -> np.ndarray:
        return self._rows(zone, first, rows, float)

    def read_elements(self, zone: int, first: int, rows: int) -> np.ndarray:
        z = self.zones[zone]
        return super().read_elements(zone, first, rows) if z.shape else self._rows(zone, z.nodes + first, rows, np.int64) - 1


class _Raw(io.RawIOBase):
    def __init__(self, file):
        self.file = file

    def readable(self) -> bool:
        return True

    def readinto(self, b) -> int:
        data = self.file.read(len(b))
        b[: len(data)] = data
        return len(data)


# -- binary meshes -----------------------------------------------------------


def _string(f) -> str:
    (n,) = struct.unpack("<Q", f.read(8))
    return f.read(n).decode()


def _put(s: str) -> bytes:
    return struct.pack("<Q", len(s.encode())) + s.encode()


class BinaryMesh(Layout):
    """Binary mesh of ordered zones: signature, variables, zone offsets; each zone its shape, then rows. ``real``: bytes of a number."""

    def __init__(self, path: str, real: int = 4):
        super().__init__(path, [])
        self.real = np.dtype(f"<f{real}")
        f = opened(path)
        if not _string(f).endswith(MESH_ID):
            raise FormatError("not a binary mesh")
        (n,) = struct.unpack("<Q", f.read(8))
        self.variables = [_string(f) for _ in range(n)]
        (zones,) = struct.unpack("<Q", f.read(8))
        for at in struct.unpack(f"<{zones}Q", f.read(8 * zones)):
            f.seek(at)
            (dim,) = struct.unpack("<Q", f.read(8))
            if not 1 <= dim <= 3:
                raise FormatError("a zone has 1 to 3 axes")
            shape = list(struct.unpack(f"<{dim}Q", f.read(8 * dim)))
            self.zones.append(Zone("", int(np.prod(shape)), ordered_count(shape), "quad" if dim < 3 else "hexahedron", shape, True, at + 8 * (dim + 1)))

    def read_nodes(self, zone: int, first: int, rows: int) -> np.ndarray:
        f, width = opened(self.path), len(self.variables) * self.real.itemsize
        f.seek(self.zones[zone].at + first * width)
        data = np.frombuffer(f.read(rows * width), self.real)
        if len(data) < rows * len(self.variables):
            raise FormatError("the file ends inside a zone")
        return data.reshape(rows, -1).astype(float)


def write_binary_mesh(path: str, variables: list[str], zones: list[tuple[list[int], np.ndarray]], real: int = 4, prefix: str = "mesh") -> None:
    """Ordered zones (shape, rows x variables). ``prefix`` begins the signature, for readers that compare it whole."""
    head = _put(prefix + MESH_ID) + struct.pack("<Q", len(variables)) + b"".join(map(_put, variables)) + struct.pack("<Q", len(zones))
    at, offsets, body = len(head) + 8 * len(zones), [], []
    for shape, rows in zones:
        part = struct.pack(f"<{len(shape) + 1}Q", len(shape), *shape) + np.asarray(rows, f"<f{real}").tobytes()
        offsets.append(at)
        body.append(part)
        at += len(part)
    with open(path, "wb") as f:
        f.write(head + struct.pack(f"<{len(zones)}Q", *offsets) + b"".join(body))


class AnimationMesh(Layout):
    """Three lines name a grid file, a field file and a time step; blocks of 4-byte floats with fixed variables."""

    def __init__(self, path: str):
        super().__init__(path, list(ANIMATION_VARIABLES))
        grid, fields, step = opened(path).read().decode().split("\n")[:3]
        self.grid, self.fields, self.step = beside(path, grid.strip()), beside(path, fields.strip()), int(step)
        f = opened(self.grid)
        (n,) = struct.unpack("<I", f.read(4))
        at = 4
        for i in range(n):
            shape = list(struct.unpack("<3i", f.read(12)))
            nodes = int(np.prod(shape))
            self.zones.append(Zone(f"Zone_{i}", nodes, ordered_count(shape), "hexahedron", shape, True, at + 12))
            at += 12 + 12 * nodes
            f.seek(at)

    def read_nodes(self, zone: int, first: int, rows: int) -> np.ndarray:
        total = sum(z.nodes for z in self.zones)
        g, f = opened(self.grid), opened(self.fields)
        g.seek(self.zones[zone].at + 12 * first)
        xyz = np.frombuffer(g.read(12 * rows), "<f4").reshape(rows, 3)
        f.seek((total * 16 + 8) * self.step + 8 + 16 * (sum(z.nodes for z in self.zones[:zone]) + first))
        data = np.frombuffer(f.read(16 * rows), "<f4")
        if len(data) < 4 * rows:
            raise FormatError("the field file is short")
        return np.hstack([xyz, data.reshape(rows, 4)]).astype(float)


class ManifestMesh(Layout):
    """Five lines name mesh info, coordinates, elements, field info and fields: one unstructured zone of bricks."""

    def __init__(self, path: str):
        super().__init__(path, [])
        names = [beside(path, n.strip()) for n in opened(path).read().decode().split("\n")[:5]]
        info, self.coordinates, self.elements, field_info, self.fields = names
        words = opened(info).read().decode().split()
        values = dict(zip(words, words[1:], strict=False))
        try:
            self.dim, nodes, elements = int(values["NumCoords"]), int(values["NnBase"]), int(values["NtBase"])
        except KeyError as e:
            raise FormatError(f"mesh info lacks {e}") from e
        if self.dim not in (2, 3):
            raise FormatError("only 2 or 3 coordinates are possible")
        words = opened(field_info).read().decode().split()
        if "Variables" not in words:
            raise FormatError("field info lacks its variables")
        own = [w[1:-1] if len(w) > 1 and w[0] == w[-1] == '"' else w for w in words[words.index("Variables") + 1 :]]
        self.variables = ["x", "y", "z"][: self.dim] + own
        self.zones = [Zone(values.get("Name", ""), nodes, elements, "hexahedron")]

    def read_nodes(self, zone: int, first: int, rows: int) -> np.ndarray:
        own = len(self.variables) - self.dim
        c, f = opened(self.coordinates), opened(self.fields)
        c.seek(HEADER_BYTES + 8 * self.dim * first)
        f.seek(4 * own * first)
        xyz = np.frombuffer(c.read(8 * self.dim * rows), "<f8").reshape(rows, self.dim)
        return np.hstack([xyz, np.frombuffer(f.read(4 * own * rows), "<f4").reshape(rows, own)]).astype(float)

    def read_elements(self, zone: int, first: int, rows: int) -> np.ndarray:
        f = opened(self.elements)
        f.seek(HEADER_BYTES + 32 * first)
        raw = np.frombuffer(f.read(32 * rows), "<u4").reshape(rows, 8)
        out = np.where(raw == MISSING, -1, raw.astype(np.int64))
        full = out[:, 7] >= 0
        out[np.ix_(full, [2, 3, 6, 7])] = out[np.ix_(full, [3, 2, 7, 6])]  # rings are stored crosswise
        return out


def layout(path: str) -> Layout:
    """The layout of a file, by its extension."""
    for ending, kind in ((".tec", TextMesh), (".bin", BinaryMesh), (".anim", AnimationMesh), (".imm-g", ManifestMesh)):
        if path.endswith(ending):
            return kind(path)
    raise FormatError(f"unknown mesh format: {path}")


# -- voxel grids -------------------------------------------------------------


@dataclass
class RectGrid:
    """Grid nodes per axis, their coordinates, and named arrays over the cells."""

    shape: list[int]
    coordinates: list[np.ndarray]
    arrays: dict[str, np.ndarray]

    @property
    def cells(self) -> list[int]:
        return [n - 1 for n in self.shape]


def write_rect_grid(path: str, grid: RectGrid, real: int = 4) -> None:
    head = _put(GRID_ID) + struct.pack("<2I", GRID_VERSION, len(grid.shape)) + struct.pack(f"<{len(grid.shape)}I", *grid.shape)
    for c in grid.coordinates:
        head += struct.pack("<Q", len(c)) + np.asarray(c, f"<f{real}").tobytes()
    head += struct.pack("<Q", len(grid.arrays))
    for name, a in grid.arrays.items():
        head += _put(name) + struct.pack("<IQ", ORDINALS.index(a.dtype.name), a.size)
    at, offsets = len(head) + 8 + 8 * len(grid.arrays), []
    for a in grid.arrays.values():
        offsets.append(at)
        at += a.nbytes
    with open(path, "wb") as f:
        f.write(head + struct.pack(f"<Q{len(offsets)}q", len(offsets), *offsets))
        for a in grid.arrays.values():
            f.write(a.tobytes())


def rect_grid_header(path: str, dim: int, real: int = 4) -> tuple[RectGrid, dict[str, tuple[str, int, int]]]:
    """A grid without its arrays, and of each array the type, size and place in the file. The version may not be newer, the dimension must fit."""
    f = opened(path)
    if _string(f) != GRID_ID:
        raise FormatError("not a rectangular grid")
    version, n = struct.unpack("<2I", f.read(8))
    if version > GRID_VERSION or n != dim:
        raise FormatError("the grid's version or dimension does not fit")
    shape = list(struct.unpack(f"<{dim}I", f.read(4 * dim)))
    coordinates = []
    for _ in range(dim):
        (k,) = struct.unpack("<Q", f.read(8))
        coordinates.append(np.frombuffer(f.read(real * k), f"<f{real}").astype(float))
    (k,) = struct.unpack("<Q", f.read(8))
    info = []
    for _ in range(k):
        name = _string(f)
        kind, size = struct.unpack("<IQ", f.read(12))
        info.append((name, ORDINALS[kind], size))
    (k,) = struct.unpack("<Q", f.read(8))
    places = struct.unpack(f"<{k}q", f.read(8 * k))
    return RectGrid(shape, coordinates, {}), {name: (kind, size, at) for (name, kind, size), at in zip(info, places, strict=True)}


def read_cells(path: str, array: tuple[str, int, int], first: int, count: int) -> np.ndarray:
    """Some cells of an array, read from their own place in the file."""
    kind, _, at = array
    f, width = opened(path), np.dtype(kind).itemsize
    f.seek(at + first * width)
    data = np.frombuffer(f.read(count * width), kind)
    if len(data) < count:
        raise FormatError("the file ends inside an array")
    return data


def read_rect_grid(path: str, dim: int, real: int = 4, only: list[str] | None = None) -> RectGrid:
    """A grid's coordinates and its arrays, or those named."""
    grid, arrays = rect_grid_header(path, dim, real)
    grid.arrays = {n: read_cells(path, a, 0, a[1]) for n, a in arrays.items() if only is None or n in only}
    return grid


def read_vtk_rectilinear(path: str) -> RectGrid:
    """A legacy ASCII rectilinear grid with cell data: coordinates of each axis, scalars and field arrays."""
    words = iter(opened(path).read().decode().split())
    kinds = {"float": "float32", "double": "float64", "int": "int32", "long": "int64", "char": "int8", "unsigned_char": "uint8", "short": "int16", "unsigned_short": "uint16", "unsigned_int": "uint32", "unsigned_long": "uint64", "bit": "uint8", "vtktypeint64": "int64"}
    shape, coordinates, arrays, cells = [], [], {}, 0
    for w in words:
        if w == "DATASET" and next(words) != "RECTILINEAR_GRID":
            raise FormatError("not a rectilinear grid")
        elif w == "DIMENSIONS":
            shape = [int(next(words)) for _ in range(3)]
        elif w in ("X_COORDINATES", "Y_COORDINATES", "Z_COORDINATES"):
            n, _ = int(next(words)), next(words)
            coordinates.append(np.array([float(next(words)) for _ in range(n)]))
        elif w == "CELL_DATA":
            cells = int(next(words))
        elif w == "POINT_DATA":
            break
        elif w == "SCALARS" and cells:
            name, kind = next(words), next(words)
            if next(words) != "LOOKUP_TABLE":
                next(words)
            next(words)
            arrays[name] = np.array([float(next(words)) for _ in range(cells)]).astype(kinds[kind])
        elif w == "FIELD" and cells:
            next(words)
            for _ in range(int(next(words))):
                name, width, n, kind = next(words), int(next(words)), int(next(words)), next(words)
                arrays[name] = np.array([float(next(words)) for _ in range(n * width)]).astype(kinds[kind])
    dim = sum(n > 1 for n in shape)
    return RectGrid(shape[:dim], coordinates[:dim], arrays)
