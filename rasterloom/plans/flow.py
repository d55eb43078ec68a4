"""Flows: graphs of operators over streams that compile to one DataFrame plan per target.

A graph is built in code or loaded from a JSON file of any of three generations. It is validated as a whole (kinds,
inputs, no cycle) before anything is planned; results of unchanged nodes are reused by a hash of their configuration and
inputs.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalar import BINARY, UNARY
from ..functions.wavelets import scaling_filter
from ..model import KEY, Stream, concatenated, constant, grid, ordered, surfaces
from ..operators import astrometry, colour, consensus, fit, geometry, neighbourhood, pixelwise, planes
from ..sources import csvplanes, images
from . import macros

#: Operators by name: (node, input streams) -> stream.
OPERATORS: dict[str, Callable[["Node", list[Stream]], Stream]] = {}

#: Parameters that operators take, first by the names that files hold; others are refused. Operators that are not listed take none.
_STARS = "gridRows gridCols starsPerGrid ransacIterations ransacSeed"
PARAMETERS: dict[str, frozenset[str]] = {
    k: frozenset(v.split())
    for k, v in {
        "tone_curve": "controlPoints boundaryCondition outputMin outputEnd displayMin displayEnd points condition out",
        "colorspace_mask": "color_space mask_3d_points rotation_matrix space spheres",
        "wavelet_denoise": "wavelet levels sigma star_threshold star_protection protection_radius",
        "chroma_denoise": "colorspace chroma_strength luma_strength preserve_edges edge_threshold",
        "points_extraction": "targetPlane threshold minDiameter maxDiameter maxAspectRatio",
        "shift_detection": f"usePreviousOffset alignmentPlane starThreshold starMinDiameter starMaxDiameter starSampleRadius saturationThreshold useSaturationMask maxAspectRatio phaseMaxOffset templateSearchRange {_STARS}",
        "star_identification": f"fovDeg useHeaderFovDeg catalog.matchLimit catalog.magLimit {_STARS}",
        "orientation": "ransacThresholdPx ransacIterations ransacSeed",
        "file_reader": "filePaths path", "image_reader": "filePaths path", "fits_reader": "filePaths path",
        "file_writer": "outputFilePath path", "image_writer": "outputFilePath path low end depth form",
        "coefficients": "planes xOrder yOrder coefficients", "table": "planes columns lines table", "tensor": "planes xOrder yOrder tensor",
        "bayer_unpack_sparse": "pattern", "bayer_unpack_dense": "pattern", "convolution": "kernel", "deconvolution": "kernel", "quantile_filter": "kernel q", "dwt": "kernel", "idwt": "kernel",
        "sigma_filtering": "sigma", "reposition": "shift_x shift_y rot90 flip_x flip_y transpose left top crop_width crop_height",
    }.items()
}


def register_operator(name: str):
    """Decorator that adds an operator to flows; a name is taken once."""

    def add(function):
        if name in OPERATORS:
            raise ValueError(f"operator {name} exists")
        OPERATORS[name] = function
        return function

    return add


@dataclass
class Node:
    """One operator of a flow. category is that of its output: primary unless said otherwise."""

    id: int
    type: str
    params: dict = field(default_factory=dict)
    inputs: list[int] = field(default_factory=list)
    category: str = "primary"

    def as_auxiliary(self) -> "Node":
        self.category = "auxiliary"
        return self


class Flow:
    def __init__(self) -> None:
        self.nodes: dict[int, Node] = {}
        self.known: dict[str, Stream] = {}
        self.given: list[Stream] = []

    def _mark(self, stream: Stream) -> str:
        """A name for a given stream. The flow keeps the stream, so that no other one can take its identity."""
        if not any(s is stream for s in self.given):
            self.given.append(stream)
        return f"source {next(k for k, s in enumerate(self.given) if s is stream)}"

    def add(self, kind: str, *inputs: Node, **params) -> Node:
        node = Node(max(self.nodes, default=-1) + 1, kind, params, [n.id for n in inputs])
        self.nodes[node.id] = node
        return node

    def include(self, other: "Flow") -> dict[int, Node]:
        """Appends another flow; gives its nodes by their old numbers."""
        offset = max(self.nodes, default=-1) + 1
        moved = {k: replace(n, id=n.id + offset, inputs=[i + offset for i in n.inputs]) for k, n in other.nodes.items()}
        self.nodes |= {n.id: n for n in moved.values()}
        return moved

    def order(self, targets: list[int] | None = None) -> list[Node]:
        """The ancestors of the targets (all nodes without any), inputs first. Unknown inputs and cycles raise."""
        out, state = [], {}

        def visit(k: int) -> None:
            if k not in self.nodes:
                raise ValueError(f"node {k} is missing")
            if state.get(k) == "open":
                raise ValueError(f"node {k} lies on a cycle")
            if k not in state:
                state[k] = "open"
                for i in self.nodes[k].inputs:
                    visit(i)
                state[k] = "done"
                out.append(self.nodes[k])

        for k in targets if targets is not None else sorted(self.nodes):
            visit(k)
        return out

    def validate(self, given: tuple[int, ...] = ()) -> None:
        for node in self.order():
            if node.id not in given and node.type not in OPERATORS:
                raise ValueError(f"node {node.id}: no operator {node.type}")
            if node.id not in given:
                self._known(node)

    @staticmethod
    def _known(node: Node) -> None:
        if node.type in OPERATORS and (other := set(node.params) - PARAMETERS.get(node.type, frozenset())):
            raise ValueError(f"node {node.id}: {node.type} takes no {', '.join(sorted(other))}")

    def run(self, target: Node | int, **sources: Stream) -> Stream:
        """The plan of one node. sources: streams by node number as n0=..., for readers and open inputs."""
        target = target.id if isinstance(target, Node) else target
        given = {int(k[1:]): s for k, s in sources.items()}
        results, marks = dict(given), {k: self._mark(s) for k, s in given.items()}
        for node in self.order([target]):
            if node.id in results:
                continue
            if node.type not in OPERATORS:
                raise ValueError(f"node {node.id}: no operator {node.type}")
            self._known(node)
            mark = hashlib.md5(repr((node.type, sorted(node.params.items(), key=str), node.category, [marks[i] for i in node.inputs])).encode()).hexdigest()
            if mark not in self.known:
                try:
                    self.known[mark] = replace(OPERATORS[node.type](node, [results[i] for i in node.inputs]), category=node.category)
                except Exception as e:
                    raise RuntimeError(f"node {node.id} ({node.type}): {e}") from e
            results[node.id], marks[node.id] = self.known[mark], mark
        return results[target]


def load(text: str) -> Flow:
    """A flow from JSON: the present form (connections in nodes), the earlier one (planeNames), or the first (ids and a
    list of connections). An absent category is primary; trays and places on screen are ignored."""
    data = json.loads(text)
    flow, plain = Flow(), {"index", "id", "type", "text", "x", "y", "zOrder", "connections", "category", "planeCount"}
    for position, item in enumerate(data["nodes"]):
        key = item.get("index", item.get("id", position))
        params = {("planes" if k == "planeNames" else k): v for k, v in item.items() if k not in plain}
        flow.nodes[key] = Node(key, item["type"], params, category=item.get("category") or "primary")
    links = [(n.get("index", n.get("id", p)), to) for p, n in enumerate(data["nodes"]) for to in n.get("connections", [])]
    links += [(c["from"], c["to"]) for c in data.get("connections", [])]
    for a, b in links:
        if b not in flow.nodes:
            raise ValueError(f"connection to node {b}, which is missing")
        flow.nodes[b].inputs.append(a)
    flow.order()
    return flow


def dump(flow: Flow, version: str = "1") -> str:
    nodes = [{"index": n.id, "type": n.type, "category": n.category, **n.params, "connections": [m.id for m in flow.nodes.values() for i in m.inputs if i == n.id]} for n in flow.nodes.values()]
    return json.dumps({"version": version, "nodes": nodes, "trays": []})


def _changed(s: Stream, pixels, **changes) -> Stream:
    return replace(s, pixels=pixels, **changes)


#: Cells of a kernel, and of a table that a flow holds, at most; larger ones are no kernels and belong in files.
KERNEL = 1 << 16


def _cells(s: Stream, plane: int = 0) -> list[list[float | None]]:
    """The values of a small plane, None where it is invalid."""
    if s.width * s.height > KERNEL:
        raise ValueError(f"a kernel of {s.width} x {s.height} is too large")
    a: list[list[float | None]] = [[None] * s.width for _ in range(s.height)]
    for r in s.pixels.where((F.col("frame_idx") == 0) & (F.col("plane_idx") == plane)).select("y", "x", "v").limit(KERNEL).collect():
        a[r.y][r.x] = r.v
    return a


def _kernel(node: Node, streams: list[Stream], plane: int = 0, invalid: float | None = 0.0):
    """The kernel of a neighbourhood node: its parameter, or a plane of its auxiliary input (a small table)."""
    if "kernel" in node.params:
        return node.params["kernel"]
    return [[invalid if v is None else v for v in row] for row in _cells(ordered(streams)[-1], plane)]


def _unary(name: str, s: Stream) -> Stream:
    if s.type == "polynomial":
        if name == "pass":
            return s
        if name == "negate":
            made = tuple(tuple(tuple(-v for v in row) for row in c) for c in surfaces(s))
        else:
            values = [constant(c) for c in surfaces(s)]
            if any(v is None for v in values):
                raise ValueError(f"{name} of a polynomial takes a constant")
            spark = SparkSession.active()
            found = spark.range(1).select(*[UNARY[name](F.lit(v)).alias(f"v{k}") for k, v in enumerate(values)]).first()
            made = tuple(((float("nan") if v is None else float(v),),) for v in found)
        return replace(s, coefficients=made[0], by_plane=made if s.by_plane else ())
    if "re" in s.pixels.columns:
        return _changed(s, pixelwise.unary_complex(s.pixels, name))
    return _changed(s, pixelwise.unary(s.pixels, name))


def _binary(name: str, streams: list[Stream]) -> Stream:
    if not any(s.pixels is not None and "re" in s.pixels.columns for s in streams):
        return pixelwise.binary(streams, name)
    streams = ordered(streams)
    out = max(streams, key=lambda s: (s.length, s.planes))
    for s in streams:
        if s is not out and s.type == "polynomial":
            raise ValueError(f"{name} of complex pixels and a polynomial is not defined")
        if s is not out:
            on = tuple(c for c in KEY if {"frame_idx": s.length > 1, "plane_idx": s.planes > 1, "y": s.height > 1, "x": s.width > 1}[c])
            out = _changed(out, pixelwise.binary_complex(out.pixels, s.pixels, on, name))
    return out


for _name in UNARY:
    OPERATORS[_name] = lambda node, s, n=_name: _unary(n, s[0])
OPERATORS["category_auxiliary"] = lambda node, s: s[0]
for _name in BINARY:
    OPERATORS[_name] = lambda node, s, n=_name: _binary(n, s)
for _name in ("sum", "product", "count", "maximum", "minimum", "average", "standard_deviation"):
    OPERATORS[_name] = lambda node, s, n=_name: _changed(s[0], pixelwise.stack(_all(s), n), length=1, width=max(x.width for x in s), height=max(x.height for x in s))


def _all(streams: list[Stream]):
    return concatenated([s.pixels for s in streams], [s.length for s in streams]) if len(streams) > 1 else streams[0].pixels


@register_operator("transpose")
def _transpose(node: Node, s: list[Stream]) -> Stream:
    return _changed(s[0], colour.transpose(s[0].pixels), width=s[0].height, height=s[0].width)


@register_operator("lab_converter")
def _lab(node: Node, s: list[Stream]) -> Stream:
    return _changed(s[0], colour.to_lab(s[0].pixels, s[0].planes), planes=3) if s[0].planes in (3, 4) else s[0]


@register_operator("rgb_converter")
def _rgb(node: Node, s: list[Stream]) -> Stream:
    return _changed(s[0], colour.to_rgb(s[0].pixels)) if s[0].planes == 3 else _changed(s[0], colour.merge_rgbg(s[0].pixels), planes=3)


@register_operator("bayer_unpack_sparse")
def _sparse(node: Node, s: list[Stream]) -> Stream:
    return _changed(s[0], colour.bayer_sparse(s[0].pixels, node.params.get("pattern", "RGGB")), planes=3)


@register_operator("bayer_unpack_dense")
def _dense(node: Node, s: list[Stream]) -> Stream:
    return _changed(s[0], colour.bayer_dense(s[0].pixels, node.params.get("pattern", "RGGB")), planes=4, width=(s[0].width + 1) // 2, height=(s[0].height + 1) // 2)


@register_operator("convolution")
def _convolution(node: Node, s: list[Stream]) -> Stream:
    """One kernel for all planes, or one for each plane where the auxiliary input has as many."""
    image, parts = ordered(s)[0], None
    several = "kernel" not in node.params and ordered(s)[-1].planes == image.planes > 1
    for k in range(image.planes if several else 1):
        kernel = _kernel(node, s, k)
        convolve = neighbourhood.convolve if len(kernel) * len(kernel[0]) <= 225 else planes.fft_convolve
        part = convolve(image.pixels.where(F.col("plane_idx") == k) if several else image.pixels, kernel, image.width, image.height)
        parts = part if parts is None else parts.unionByName(part)
    return _changed(image, parts)


@register_operator("deconvolution")
def _deconvolution(node: Node, s: list[Stream]) -> Stream:
    return _changed(s[0], planes.deconvolve(s[0].pixels, _kernel(node, s), s[0].width, s[0].height))


@register_operator("quantile_filter")
def _quantile(node: Node, s: list[Stream]) -> Stream:
    """Invalid cells of the kernel are left out; its plane's name may hold the quantile."""
    image, aux = ordered(s)[0], ordered(s)[-1]
    q = neighbourhood.parse_quantile(aux.names[0])[0] if aux.names and aux is not image else node.params.get("q", 0.5)
    return _changed(image, neighbourhood.quantile_filter(image.pixels, _kernel(node, s, invalid=None), image.width, image.height, q))


@register_operator("fft")
def _fft(node: Node, s: list[Stream]) -> Stream:
    return _changed(s[0], planes.fft(s[0].pixels, s[0].width, s[0].height))


@register_operator("ifft")
def _ifft(node: Node, s: list[Stream]) -> Stream:
    return _changed(s[0], planes.ifft(s[0].pixels, s[0].width, s[0].height))


@register_operator("matrix_product")
def _product(node: Node, s: list[Stream]) -> Stream:
    s = ordered(s)
    if s[0].width != s[1].height:
        raise ValueError("inner sizes differ")
    on = tuple(c for c, n in (("frame_idx", s[1].length), ("plane_idx", s[1].planes)) if n > 1)
    right = s[1].pixels if len(on) == 2 else s[0].pixels.select("frame_idx", "plane_idx").distinct().join(s[1].pixels.drop(*[c for c in ("frame_idx", "plane_idx") if c not in on]), list(on) or F.lit(True))  # one matrix for all
    return _changed(s[0], planes.matrix_product(s[0].pixels, right), width=s[1].width)


@register_operator("inverse_matrix")
def _inverse(node: Node, s: list[Stream]) -> Stream:
    return _changed(s[0], planes.inverse_matrix(s[0].pixels, s[0].width, s[0].height))


def _table_rows(tables: list[Stream], frames: Stream) -> DataFrame:
    """Parameters by frame: the row of a table of one line for every frame, else the line of the frame's id, else that of the
    empty label. A table without labels has a line a frame."""
    table = tables[0]
    names = [c for c in table.columns]
    at = lambda c: F.max(F.when(F.col("x") == names.index(c), F.col("v"))).alias(c)
    rows = table.pixels.where("plane_idx = 0").groupBy("y").agg(*[at(c) for c in names])
    every = frames.pixels.select("frame_idx").distinct()
    if table.height == 1:
        return every.join(F.broadcast(rows.drop("y")))  # one row
    if not any(table.lines):
        return rows.withColumnRenamed("y", "frame_idx")
    labels = {label: y for y, label in enumerate(table.lines)}
    ids = frames.ids or tuple(str(k) for k in range(frames.length))
    pairs = [(k, labels.get(name, labels.get(""))) for k, name in enumerate(ids) if name in labels or "" in labels]
    lines = rows.sparkSession.createDataFrame(pairs, "frame_idx int, y int")  # a row a frame
    return lines.join(rows, "y").drop("y")


@register_operator("transform")
def _transform(node: Node, s: list[Stream]) -> Stream:
    """Frames (and constant streams as frames) by the parameters of the table input; the canvas holds all of them."""
    tables = [x for x in s if x.type == "table"]
    image = next(x for x in ordered(s) if x.type != "table")
    if not tables:
        raise ValueError("a transform takes a table of parameters")
    params = _table_rows(tables, image)
    filled = params.select("frame_idx", *[F.coalesce(F.col(c), F.lit(d)).alias(c) if c in params.columns else F.lit(d).alias(c) for c, d in (("dx", 0.0), ("dy", 0.0), ("rotation", 0.0), ("scale", 1.0))], *[F.col(c).cast("int").alias(c) for c in ("left", "top", "width", "height") if c in params.columns])
    left, top, width, height = geometry.canvas_of(filled, image.width, image.height)
    return _changed(image, geometry.transform(image.pixels, filled, image.width, image.height, width, height, left, top), width=width, height=height)


@register_operator("reposition")
def _reposition(node: Node, s: list[Stream]) -> Stream:
    """By parameters, or by a table input of one line."""
    tables = [x for x in s if x.type == "table" and {"shift_x", "shift_y", "rot90", "flip_x", "flip_y", "transpose", "left", "top", "width", "height"} & set(x.columns)]
    image, p = next(x for x in ordered(s) if not any(x is t for t in tables)), dict(node.params)
    if tables:
        if tables[0].height != 1:
            raise ValueError("a reposition takes a table of one line")
        row = dict(zip(tables[0].columns, _cells(tables[0])[0], strict=True))
        p = {{"width": "crop_width", "height": "crop_height"}.get(k, k): int(v) for k, v in row.items() if v}
        p |= {k: bool(p[k] % 2) for k in ("transpose", "flip_x", "flip_y") if k in p}
        p = {"crop_width": image.width - p.get("left", 0), "crop_height": image.height - p.get("top", 0)} | p
    w, h = p.get("crop_width", image.width), p.get("crop_height", image.height)
    turned = bool(p.get("transpose")) != bool(p.get("rot90", 0) % 2)
    return _changed(image, geometry.reposition(image.pixels, image.width, image.height, **p), width=h if turned else w, height=w if turned else h)


@register_operator("dwt")
def _dwt(node: Node, s: list[Stream]) -> Stream:
    """A further level of the planes' approximations. Each plane is followed by its bands ad, da, dd of the newest level, then
    by those of earlier ones; the taps come from the auxiliary input."""
    image, taps = ordered(s)[0], [v or 0.0 for v in _kernel(node, s)[0]]
    sizes = image.sizes or ((image.width, image.height),)
    group, (w, h) = 1 + 3 * (len(sizes) - 1), sizes[-1]
    plane, band = F.floor(F.col("plane_idx") / group).cast("int"), F.col("plane_idx") % group
    bands = neighbourhood.dwt(image.pixels.where(band == 0).withColumn("plane_idx", plane), w, h, taps)
    out = image.pixels.where(band > 0).withColumn("plane_idx", plane * (group + 3) + band + 3).select(*KEY, "v")
    for k, name in enumerate(("aa", "ad", "da", "dd")):
        out = out.unionByName(bands[name].withColumn("plane_idx", F.col("plane_idx") * (group + 3) + k).select(*KEY, "v"))
    names = image.names or tuple(f"Plane {k}" for k in range(image.planes // group))
    level = len(sizes)
    names = tuple(x for n in names[::group] for x in (n, *[f"{n} ({b}{k})" for k in range(level, 0, -1) for b in ("ad", "da", "dd")]))
    n = len(taps)
    new = ((w + n - 1) // 2, (h + n - 1) // 2)
    first = sizes[1] if level > 1 else new
    return _changed(image, out.withColumn("plane_idx", F.col("plane_idx").cast("int")), planes=image.planes // group * (group + 3), width=first[0], height=first[1], sizes=(*sizes, new), names=names)


@register_operator("idwt")
def _idwt(node: Node, s: list[Stream]) -> Stream:
    """Takes back all levels; a stream without any passes."""
    image, taps = next((x for x in ordered(s) if x.sizes), ordered(s)[0]), [v or 0.0 for v in _kernel(node, s)[0]]
    while image.sizes:
        image = _level_back(image, taps)
    return image


def _level_back(image: Stream, taps: list[float]) -> Stream:
    """The stream without its newest level."""
    group, (w, h) = 1 + 3 * (len(image.sizes) - 1), image.sizes[-2]
    plane, band = F.floor(F.col("plane_idx") / group).cast("int"), F.col("plane_idx") % group
    bands = {name: image.pixels.where(band == k).withColumn("plane_idx", plane) for k, name in enumerate(("aa", "ad", "da", "dd"))}
    back = neighbourhood.idwt(bands, w, h, taps).withColumn("plane_idx", (F.col("plane_idx") * (group - 3)).cast("int")).select(*KEY, "v")
    rest = image.pixels.where(band > 3).withColumn("plane_idx", (plane * (group - 3) + band - 3).cast("int")).select(*KEY, "v")
    sizes = image.sizes[:-1] if len(image.sizes) > 2 else ()
    width, height = image.sizes[1] if sizes else image.sizes[0]
    kept = tuple(n for k, n in enumerate(image.names) if not 1 <= k % group <= 3)
    return _changed(image, back.unionByName(rest), planes=image.planes // group * (group - 3), width=width, height=height, sizes=sizes, names=kept)


@register_operator("auto_levels")
def _levels(node: Node, s: list[Stream]) -> Stream:
    """The pixels as they are; the display range of each frame is the header."""
    return replace(s[0], header=colour.auto_levels(s[0].pixels))


def _as_table(rows: DataFrame, line: str, columns: tuple[str, ...], frame: str | None = None) -> DataFrame:
    """Rows as the pixels of a table: a line each, a column for each name."""
    cells = F.posexplode(F.array(*[F.col(c).cast("double") for c in columns])).alias("x", "v")
    return rows.select(F.col(frame).alias("frame_idx") if frame else F.lit(0).alias("frame_idx"), F.lit(0).alias("plane_idx"), F.col(line).cast("int").alias("y"), cells)


@register_operator("points_extraction")
def _points(node: Node, s: list[Stream]) -> Stream:
    p, columns = node.params, ("x", "y", "brightness", "center_brightness", "area", "aspect_ratio")
    plane = min(p.get("targetPlane", 1), s[0].planes - 1)
    found = planes.label_planes(s[0].pixels.where(F.col("plane_idx") == plane), s[0].width, s[0].height, p.get("threshold", 95) / 100, p.get("minDiameter", 2), p.get("maxDiameter", 16), p.get("maxAspectRatio", 2.0))
    return Stream(_as_table(found, "point", columns, "frame_idx"), s[0].length, 1, len(columns), 1, type="table", columns=columns, ids=s[0].ids)


@register_operator("shift_detection")
def _shifts(node: Node, s: list[Stream]) -> Stream:
    """A line a frame; the reference is the auxiliary stream's first frame, else the first frame of the stream itself."""
    p, columns = node.params, ("dx", "dy", "rotation", "confidence", "time")
    image, *others = ordered(s)
    plane = min(p.get("alignmentPlane", 1), image.planes - 1)
    target = others[0] if others else image
    reference = target.pixels.where((F.col("frame_idx") == 0) & (F.col("plane_idx") == min(plane, target.planes - 1))).select("y", "x", "v")
    found = astrometry.register_frames(
        image.pixels.where(F.col("plane_idx") == plane).select("frame_idx", "y", "x", "v"), reference, image.width, image.height, quantile=p.get("starThreshold", 95) / 100, least=p.get("starMinDiameter", 2), most=p.get("starMaxDiameter", 16), aspect=p.get("maxAspectRatio", 2.0),
        rows=p.get("gridRows", 3), columns=p.get("gridCols", 3), stars=p.get("starsPerGrid", 8), radius=p.get("starSampleRadius", 100), previous=p.get("usePreviousOffset", True), rounds=p.get("ransacIterations", 100), seed=p.get("ransacSeed", 2725), phase_most=p.get("phaseMaxOffset", 100), template_reach=p.get("templateSearchRange", 150),
        saturation=p.get("saturationThreshold", 95) if p.get("useSaturationMask", False) else None,
    )
    return Stream(_as_table(found, "frame_idx", columns), 1, 1, len(columns), image.length, type="table", columns=columns)


def _wide(s: Stream) -> DataFrame:
    """The rows of a table as columns: frame_idx, line, and its own."""
    at = lambda c: F.max(F.when(F.col("x") == s.columns.index(c), F.col("v"))).alias(c)
    return s.pixels.where("plane_idx = 0").groupBy("frame_idx", F.col("y").alias("line")).agg(*[at(c) for c in s.columns])


@register_operator("star_identification")
def _identify(node: Node, s: list[Stream]) -> Stream:
    """A table of points a frame and a catalogue as a table (id, ra, dec, mag), told by its columns; a line a star, the
    brightest of the catalogue first."""
    p, columns = node.params, ("ra", "dec", "mag", "x", "y", "brightness", "id")
    points, catalog = next(x for x in s if "brightness" in x.columns), next(x for x in s if {"id", "ra", "dec", "mag"} <= set(x.columns))
    stars = _wide(catalog).select(F.col("id").cast("long").alias("id"), "ra", "dec", "mag").where("id is not null").where(F.col("mag") <= p.get("catalog.magLimit", 8.0))
    found = _wide(points).where("x is not null").select("frame_idx", F.col("line").cast("long").alias("id"), "x", "y", "brightness")
    extent = found.agg(*[(F.min(c) + F.max(c)).alias(c) for c in ("x", "y")]).first()  # margins are taken as equal
    if extent.x is None:
        return Stream(_as_table(found.limit(0), "id", ("x",), "frame_idx"), points.length, 1, len(columns), 1, type="table", columns=columns, ids=points.ids)
    known = astrometry.catalog_triangles(stars, p.get("fovDeg", 2.0) / 2, p.get("catalog.magLimit", 8.0))
    named = consensus.identify_frames(found, stars, known, extent.x, extent.y, p.get("fovDeg", 2.0), error=p.get("catalog.matchLimit", 1.0) / 100, rows=p.get("gridRows", 1), columns=p.get("gridCols", 1), stars=p.get("starsPerGrid", 8), rounds=p.get("ransacIterations", 100), seed=p.get("ransacSeed", 2725))
    line = F.row_number().over(Window.partitionBy("frame_idx").orderBy("mag", "id")) - 1  # as many as a frame's points
    return Stream(_as_table(named.withColumn("line", line), "line", columns, "frame_idx"), points.length, 1, len(columns), 1, type="table", columns=columns, ids=points.ids)


@register_operator("orientation")
def _orientation(node: Node, s: list[Stream]) -> Stream:
    """A line a frame of identified stars (a table with ra, dec, x, y); places are taken about the middle of the stars' extent,
    as a table of stars does not tell the frame's."""
    p, columns = node.params, ("crval1", "crval2", "rotation", "pixel_scale", "confidence")
    stars = _wide(s[0]).withColumnRenamed("line", "star")
    extent = stars.agg(*[(F.min(c) + F.max(c)).alias(c) for c in ("x", "y")]).first()
    found = consensus.plate_consensus(stars, extent.x or 0.0, extent.y or 0.0, p.get("ransacThresholdPx", 3.0), p.get("ransacIterations", 100), p.get("ransacSeed", 2725))
    return Stream(_as_table(found, "frame_idx", columns), 1, 1, len(columns), s[0].length, type="table", columns=columns, lines=s[0].ids or ())


@register_operator("chroma_denoise")
def _chroma(node: Node, s: list[Stream]) -> Stream:
    """Frames of three planes (of four with the mean green); others pass."""
    p, image = node.params, s[0]
    if image.planes < 3:
        return image
    pixels = colour.merge_rgbg(image.pixels) if image.planes == 4 else image.pixels
    edges = p.get("edge_threshold", 0.1) if p.get("preserve_edges", True) else None
    return _changed(image, macros.colour_denoise(pixels, image.width, image.height, p.get("colorspace", "Lab"), p.get("chroma_strength", 2.0), p.get("luma_strength", 0.2), edges), planes=3)


@register_operator("wavelet_denoise")
def _wavelet(node: Node, s: list[Stream]) -> Stream:
    p = node.params
    stars = p.get("star_threshold", 99.0) if p.get("star_protection", True) else None
    return _changed(s[0], planes.wavelet_denoise(s[0].pixels, s[0].width, s[0].height, p.get("sigma", 0.1), list(scaling_filter(p.get("wavelet", "db4"))), p.get("levels", 4), stars, p.get("protection_radius", 3), tile=256))


def _read(pixels: DataFrame, **known) -> Stream:
    """A stream of read pixels; the extents come from one aggregation."""
    n, p, w, h = pixels.agg(*[F.coalesce(F.max(c), F.lit(-1)) + 1 for c in ("frame_idx", "plane_idx", "x", "y")]).first()
    return Stream(pixels, max(1, n), max(1, p), max(1, w), max(1, h), **known)


def _paths(node: Node) -> list[str] | str:
    """The files of a reader, or the one file or folder of a writer, by the name that files hold or as path."""
    found = node.params.get("filePaths") or node.params.get("outputFilePath") or node.params.get("path")
    if not found:
        raise ValueError("no file is given")
    return found


@register_operator("file_reader")
def _file_reader(node: Node, s: list[Stream]) -> Stream:
    return _read(csvplanes.read_csv(SparkSession.active(), _paths(node)).select(*KEY, "v"), type="table")


def _numbered(pixels: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Frames numbered in the order of their files and parts: a row a frame, joined back."""
    order = F.row_number().over(Window.orderBy(*keys)) - 1  # a row a frame
    frames = pixels.select(*keys).distinct().withColumn("frame_idx", order.cast("int"))
    return pixels.join(frames, list(keys)).select(*KEY, "v")


@register_operator("image_reader")
def _image_reader(node: Node, s: list[Stream]) -> Stream:
    return _read(_numbered(images.read_png(SparkSession.active(), _paths(node)), ("source_file",)))


@register_operator("fits_reader")
def _fits_reader(node: Node, s: list[Stream]) -> Stream:
    return _read(_numbered(images.read_fits(SparkSession.active(), _paths(node)), ("source_file", "part")))


@register_operator("file_writer")
def _file_writer(node: Node, s: list[Stream]) -> Stream:
    """Writes a folder of text files a frame and hands the stream on."""
    def named(names: tuple[str, ...], at: str):
        """The name at a place, or its number; a letter before that of a column tells a header from values."""
        number = F.concat(F.lit("x" if at == "x" else ""), F.col(at).cast("string"))
        return F.coalesce(F.try_element_at(F.array(*map(F.lit, names)), F.col(at) + 1), number) if names else number

    labels = {"column": named(s[0].columns, "x"), "line": named(s[0].lines, "y"), "plane": named(s[0].names, "plane_idx")}
    csvplanes.write_csv(s[0].pixels.withColumns({k: v for k, v in labels.items() if k not in s[0].pixels.columns}), _paths(node))
    return s[0]


@register_operator("image_writer")
def _image_writer(node: Node, s: list[Stream]) -> Stream:
    """The encoded files, one row a frame, as the header; they are written where a path is given."""
    p = node.params
    files = images.encode_frames(s[0].pixels, s[0].width, s[0].height, p.get("low", 0.0), p.get("end", 256.0), p.get("depth", 8), p.get("form", "png"))
    if "path" in p or "outputFilePath" in p:
        files.write.mode("overwrite").parquet(_paths(node))
    return replace(s[0], header=files)


@register_operator("tone_curve")
def _tone(node: Node, s: list[Stream]) -> Stream:
    """The range shown on screen (displayMin, displayEnd) does not matter to the values."""
    p = node.params
    points = p.get("controlPoints", p.get("points", [(0.0, 0.0), (1.0, 1.0)]))
    out = p.get("out", (p.get("outputMin", 0.0), p.get("outputEnd", 1.0)))
    curve = colour.tone_curve(F.col("v"), [tuple(x) for x in points], p.get("boundaryCondition", p.get("condition", "natural")), tuple(map(float, out)))
    return _changed(s[0], s[0].pixels.withColumn("v", curve))


@register_operator("colorspace_mask")
def _mask(node: Node, s: list[Stream]) -> Stream:
    """Frames of three planes, or of four with the mean green; any others pass everywhere."""
    p = node.params
    spheres = [tuple(x) for x in p.get("mask_3d_points", p.get("spheres", []))]
    if s[0].planes not in (3, 4):
        return _changed(s[0], s[0].pixels.withColumn("v", F.lit(1.0)))
    pixels = colour.merge_rgbg(s[0].pixels) if s[0].planes == 4 else s[0].pixels
    return _changed(s[0], colour.colour_mask(pixels, spheres, p.get("color_space", p.get("space", "RGB"))), planes=3)


@register_operator("quadratic_fit")
def _quadratic(node: Node, s: list[Stream]) -> Stream:
    """The fitted surface itself, cell by cell, so that it can be subtracted."""
    c = fit.quadratic_fit(s[0].pixels)
    return _changed(s[0], s[0].pixels.join(c, ["frame_idx", "plane_idx"]).select(*KEY, fit.surface(F.col("c")).alias("v")))


@register_operator("sigma_filtering")
def _sigma(node: Node, s: list[Stream]) -> Stream:
    return _changed(s[0], pixelwise.sigma_clip(s[0].pixels, node.params.get("sigma", 1.5)))


@register_operator("coefficients")
def _coefficients(node: Node, s: list[Stream]) -> Stream:
    """Values by "plane,x power,y power"; absent ones are 0. One plane holds for all planes of what it meets."""
    p = node.params
    rows, cols, values = p.get("yOrder", 0) + 1, p.get("xOrder", 0) + 1, p.get("coefficients", {})
    names = tuple(p.get("planes", ["Plane 0"]))
    made = tuple(tuple(tuple(float(values.get(f"{k},{i},{j}", 0)) for i in range(cols)) for j in range(rows)) for k in range(len(names)))
    return Stream(type="polynomial", coefficients=made[0], by_plane=made if len(made) > 1 else (), planes=len(names), names=names)


def _constant(node: Node, kind: str, values, width: int, height: int, **known) -> Stream:
    """Pixels of a constant by "plane,x,y" (absent ones are 0), or one value everywhere."""
    spark, names = SparkSession.active(), tuple(node.params.get("planes", ["Plane 0"]))
    cells = grid(spark.range(len(names)).select(F.lit(0).alias("frame_idx"), F.col("id").cast("int").alias("plane_idx")), width, height)
    if isinstance(values, dict):
        given = [(*map(int, k.split(",")), float(v)) for k, v in values.items()]
        table = spark.createDataFrame(given, "plane_idx int, x int, y int, v double")
        pixels = cells.join(F.broadcast(table), ["plane_idx", "x", "y"], "left").select(*KEY, F.coalesce("v", F.lit(0.0)).alias("v"))  # as large as the flow's file
    else:
        pixels = cells.select(*KEY, F.lit(float(values)).alias("v"))
    return Stream(pixels, 1, len(names), width, height, type=kind, names=names, **known)


@register_operator("table")
def _table(node: Node, s: list[Stream]) -> Stream:
    p = node.params
    columns, lines = p.get("columns", ["A", "B", "C"]), p.get("lines", ["1", "2", "3"])
    width, height = (v if isinstance(v, int) else len(v) for v in (columns, lines))
    return _constant(node, "table", p.get("table", {}), width, height, columns=() if isinstance(columns, int) else tuple(columns), lines=() if isinstance(lines, int) else tuple(lines))


@register_operator("tensor")
def _tensor(node: Node, s: list[Stream]) -> Stream:
    return _constant(node, "tensor", node.params.get("tensor", {}), node.params.get("xOrder", 1), node.params.get("yOrder", 1))
