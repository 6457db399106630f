"""PDF by the standard library: page trees in, with page sizes and the image of a scanned page; pages of images out."""

from __future__ import annotations

import re
import struct
import zlib

import numpy as np

from quire.raster.kernels import scaled

POINTS = 72
#: The size of a page whose tree names none.
LETTER = (0.0, 0.0, 612.0, 792.0)


class Name(bytes):
    """A PDF name, without its slash."""


class Ref(int):
    """A reference to an object, by its number."""


_TOKEN = re.compile(rb"%[^\r\n]*|<<|>>|[\[\]]|<[0-9A-Fa-f\s]*>|/[^\s()<>\[\]{}/%]*|\(|[^\s()<>\[\]{}/%]+")
_NUMBER = re.compile(rb"[+-]?(?:\d+\.?\d*|\.\d+)")


def _string_end(body: bytes, at: int) -> int:
    """Behind the bracket that closes a string whose first one is before `at`."""
    depth = 1
    for m in re.compile(rb"\\.|[()]", re.DOTALL).finditer(body, at):
        depth += {b"(": 1, b")": -1}.get(m[0], 0)
        if not depth:
            return m.end()
    return len(body)


def parsed(body: bytes):
    """The first value in body: dict, list, Name, Ref, number, bytes or None. What is malformed is left out."""
    stack: list[list] = [[]]
    at = 0
    while m := _TOKEN.search(body, at):
        token, at = m[0], m.end()
        top = stack[-1]
        if token.startswith(b"%"):
            continue
        if token in (b"<<", b"["):
            stack.append([])
            continue
        if token in (b">>", b"]"):
            if len(stack) == 1:
                break
            held = stack.pop()
            pairs = zip(held[::2], held[1::2], strict=False)
            stack[-1].append({k: v for k, v in pairs if isinstance(k, Name)} if token == b">>" else held)
        elif token == b"(":
            end = _string_end(body, at)
            top.append(body[at : end - 1])
            at = end
        elif token == b"R" and len(top) > 1 and all(isinstance(x, int) for x in top[-2:]):
            top[-2:] = [Ref(top[-2])]
        elif token.startswith(b"/"):
            top.append(Name(re.sub(rb"#([0-9A-Fa-f]{2})", lambda h: bytes([int(h[1], 16)]), token[1:])))
        elif _NUMBER.fullmatch(token):
            top.append(int(token) if token.lstrip(b"+-").isdigit() else float(token))
        elif token in (b"true", b"false"):
            top.append(token == b"true")
        else:
            top.append(None if token == b"null" else token)
    return stack[0][0] if stack[0] else None


class Pdf:
    """Objects of a PDF by number, those in object streams too; of a number that repeats, the last."""

    def __init__(self, data: bytes):
        self.data, self.bodies, self.streams = data, {}, {}
        #: Whether some object stream could not be read, as in an encrypted or damaged file.
        self.hidden = False
        begin, after = re.compile(rb"(?<!\d)(\d{1,10})\s{1,9}\d{1,5}\s{1,9}obj\b"), re.compile(rb"\bendobj\b|\bstream\r?\n")
        at = 0
        while (m := begin.search(data, at)) and (stop := after.search(data, m.end())):
            number, body, at = int(m[1]), data[m.end() : stop.start()], stop.end()
            self.bodies[number] = body
            if stop[0] == b"endobj":
                continue
            length = re.search(rb"/Length\s+(\d+)(?!\s+\d+\s+R)", body)
            end = at + int(length[1]) if length else -1
            if not 0 <= end <= len(data) or data[end : end + 12].lstrip()[:9] != b"endstream":
                end = data.find(b"endstream", at)
            end = end if end >= 0 else len(data)
            self.streams[number] = at, end
            if re.search(rb"/Type\s*/ObjStm\b", body):
                self._unpack(body, data[at:end])
            at = end

    def _unpack(self, body: bytes, held: bytes) -> None:
        first = re.search(rb"/First\s+(\d+)", body)
        try:
            held = zlib.decompressobj().decompress(held) if b"FlateDecode" in body else held
            begin = int(first[1])
            head = [int(x) for x in held[:begin].split()]
            starts = [begin + x for x in head[1::2]]
            self.bodies |= {n: held[a:b] for n, a, b in zip(head[::2], starts, [*starts[1:], len(held)], strict=True)}
        except (zlib.error, ValueError, TypeError):
            self.hidden = True

    def get(self, value, kind=None):
        """What a value, or the object that it refers to, is; None if it isn't of the kind."""
        for _ in range(20):
            if not isinstance(value, Ref):
                break
            value = parsed(self.bodies.get(int(value), b""))
        return value if kind is None or isinstance(value, kind) and not isinstance(value, bool) else None

    def stream(self, value) -> tuple[dict, bytes] | None:
        """Dictionary and bytes of a stream that a reference leads to."""
        head = self.get(value, dict)
        if head is None or not isinstance(value, Ref) or int(value) not in self.streams:
            return None
        a, b = self.streams[int(value)]
        length = self.get(head.get(b"Length"), int)
        return head, self.data[a : a + length] if length is not None and a + length <= b else self.data[a:b]

    def root(self) -> dict | None:
        """The page tree's root."""
        for number in reversed(re.findall(rb"/Root\s+(\d+)\s+\d+\s+R", self.data)):
            catalog = self.get(Ref(number), dict)
            tree = self.get((catalog or {}).get(b"Pages"), dict)
            if tree is not None:
                return tree
        return None

    def pages(self) -> list[dict]:
        """Pages in the order of the tree, with what they inherit; without a tree, page objects by number."""
        root = self.root()
        if root is None:
            found = [self.get(Ref(n), dict) for n in sorted(self.bodies)]
            return [x for x in found if x and x.get(b"Type") == b"Page"]
        out, todo, seen = [], [(root, {})], set()
        while todo:
            node, above = todo.pop()
            own = above | {k: node[k] for k in (b"MediaBox", b"CropBox", b"Rotate", b"Resources") if k in node}
            kids = self.get(node.get(b"Kids"), list)
            if kids is None:
                out.append(node | own)
                continue
            for kid in reversed(kids):
                if not (isinstance(kid, Ref) and kid in seen) and (below := self.get(kid, dict)) is not None:
                    seen.add(kid if isinstance(kid, Ref) else None)
                    todo.append((below, own))
        return out

    def _box(self, value) -> tuple[float, ...] | None:
        box = [self.get(x, (int, float)) for x in self.get(value, list) or ()]
        if len(box) != 4 or None in box:
            return None
        x0, x1, y0, y1 = *sorted(box[::2]), *sorted(box[1::2])
        return (x0, y0, x1, y1) if x1 > x0 and y1 > y0 else None

    def size(self, page: dict) -> tuple[float, float]:
        """Width and height in points as a page is shown: what the crop box leaves of the media box, turned."""
        media = self._box(page.get(b"MediaBox")) or LETTER
        crop = self._box(page.get(b"CropBox")) or media
        x0, y0, x1, y1 = max(media[0], crop[0]), max(media[1], crop[1]), min(media[2], crop[2]), min(media[3], crop[3])
        if x1 <= x0 or y1 <= y0:
            x0, y0, x1, y1 = media
        turned = (self.get(page.get(b"Rotate"), (int, float)) or 0) % 180 == 90
        return (y1 - y0, x1 - x0) if turned else (x1 - x0, y1 - y0)


def page_sizes(data: bytes) -> list[tuple[float, float]] | None:
    """Width and height of each page; None where pages cannot be read, as in an encrypted file.

    Where the root counts pages that the tree doesn't hold, so many of the default size.
    """
    pdf = Pdf(data)
    found = [pdf.size(x) for x in pdf.pages()]
    if found:
        return found
    root = pdf.root()
    counted = pdf.get((root or {}).get(b"Count"), int)
    if counted is None:
        return None if pdf.hidden or root is None and pdf.streams and b"/Encrypt" in data else []
    return [(LETTER[2], LETTER[3])] * counted


def page_count(data: bytes) -> int | None:
    sizes = page_sizes(data)
    return None if sizes is None else len(sizes)


def _unpredicted(data: bytes, parms: dict, stride: int, step: int) -> bytes:
    from quire.sources.png import unfiltered

    predictor = parms.get(b"Predictor", 1)
    if predictor == 1:
        return data
    if predictor < 10:
        raise ValueError(f"predictor {predictor} is not supported")
    rows = len(data) // (stride + 1)
    raw = np.frombuffer(data, np.uint8, rows * (stride + 1)).reshape(rows, stride + 1)
    return unfiltered(raw, step).tobytes()


def page_image(data: bytes, index: int) -> tuple[np.ndarray, tuple[float, float]]:
    """The one image of a scanned page, height x width x 4 bytes, and the page's size in points.

    Images of one or eight bits, gray or RGB, deflated or plain; JPEG needs Pillow. Other pages raise ValueError.
    """
    pdf = Pdf(data)
    page = pdf.pages()[index]
    resources = pdf.get(page.get(b"Resources"), dict) or {}
    drawn = [pdf.stream(x) for x in (pdf.get(resources.get(b"XObject"), dict) or {}).values()]
    images = [x for x in drawn if x and x[0].get(b"Subtype") == b"Image"]
    if len(images) != 1:
        raise ValueError(f"page {index} has {len(images)} images, not one: give a renderer over a PDF library")
    head, held = images[0]
    get = lambda key, kind=None: pdf.get(head.get(key), kind)
    width, height, depth = get(b"Width", int), get(b"Height", int), get(b"BitsPerComponent", int) or 1
    filters = get(b"Filter")
    filters = [pdf.get(x) for x in filters] if isinstance(filters, list) else [filters] if filters else []
    out = np.full((height, width, 4), 255, np.uint8)
    if filters == [b"DCTDecode"]:
        from quire.sources.png import decode_jpeg

        out[..., :3] = decode_jpeg(held)
        return _turned(out, pdf, page), pdf.size(page)
    space = get(b"ColorSpace")
    channels = {b"DeviceGray": 1, b"CalGray": 1, b"DeviceRGB": 3, b"CalRGB": 3}.get(space if isinstance(space, bytes) else space[0] if space else b"DeviceGray")
    if filters not in ([], [b"FlateDecode"]) or channels is None or depth not in (1, 8) or (depth, channels) == (1, 3):
        raise ValueError(f"image of filters {filters}, {depth} bits, {space} is not supported: give a renderer over a PDF library")
    parms = get(b"DecodeParms")
    parms = pdf.get(parms[0], dict) if isinstance(parms, list) else parms
    stride = (width * channels * depth + 7) // 8
    plain = zlib.decompressobj().decompress(held) if filters else held
    plain = _unpredicted(plain, parms or {}, stride, max(1, channels * depth // 8))
    rows = np.frombuffer(plain, np.uint8, height * stride).reshape(height, stride)
    if depth == 1:
        out[..., :3] = np.unpackbits(rows, axis=1)[:, :width, None] * np.uint8(255)
    else:
        out[..., :3] = rows.reshape(height, width, channels)
    if get(b"Decode", list) in ([1, 0], [1, 0, 1, 0, 1, 0]):
        out[..., :3] = 255 - out[..., :3]
    return _turned(out, pdf, page), pdf.size(page)


def _turned(image: np.ndarray, pdf: Pdf, page: dict) -> np.ndarray:
    return np.ascontiguousarray(np.rot90(image, -(pdf.get(page.get(b"Rotate"), int) or 0) // 90 % 4))


def render_scan(data: bytes, index: int, dpi: float | None, max_width: int | None = None) -> np.ndarray:
    """A renderer for pages of one image each, as scanners and this library make them: the image fills the page.

    The page's points times dpi / 72, rounded, or `max_width` pixels wide.
    """
    image, (width, height) = page_image(data, index)
    pixels = lambda x: max(1, int(np.floor(x + 0.5)))
    scale = max_width / width if max_width else (dpi or POINTS) / POINTS
    return scaled(image, pixels(width * scale), pixels(height * scale))


def _stream(head: str, data: bytes) -> bytes:
    return f"<< {head} /Length {len(data)} >>\nstream\n".encode() + data + b"\nendstream"


def _image_object(content: bytes, mime: str, width: int, height: int) -> bytes:
    head = f"/Type /XObject /Subtype /Image /Width {width} /Height {height}"
    if mime == "image/jpeg":
        return _stream(f"{head} /ColorSpace /DeviceRGB /BitsPerComponent 8 /Filter /DCTDecode", content)
    depth, color = content[24], content[25]
    at, packed = 8, b""
    while at < len(content):
        (n,) = struct.unpack(">I", content[at : at + 4])
        if content[at + 4 : at + 8] == b"IDAT":
            packed += content[at + 8 : at + 8 + n]
        at += 12 + n
    colors, space = (1, "/DeviceGray") if color == 0 else (3, "/DeviceRGB")
    parms = f"/DecodeParms << /Predictor 15 /Colors {colors} /BitsPerComponent {depth} /Columns {width} >>"
    return _stream(f"{head} /ColorSpace {space} /BitsPerComponent {depth} /Filter /FlateDecode {parms}", packed)


def _hidden_text(text: str, height: float) -> str:
    """Drawing of lines of text that can be found but not seen."""
    escape = lambda x: x.encode("cp1252", "replace").hex()
    lines = " ".join(f"<{escape(x)}> Tj T*" for x in text.split("\n"))
    return f"BT 3 Tr /F 10 Tf 12 TL 10 {max(height - 20, 0):g} Td {lines} ET "


def pdf_of(rendered: list[tuple]) -> bytes:
    """A PDF of pages (content, MIME type, width and height in pixels and in points, and, if there is any, the text that
    is in the image); a JPEG or one of this library's PNGs each. The text lies unseen under the image."""
    objects: list[bytes] = [b"", b"", b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding /WinAnsiEncoding >>"]
    kids = []
    for content, mime, width, height, width_pts, height_pts, *text in rendered:
        objects.append(_image_object(content, mime, width, height))
        hidden = _hidden_text(text[0], height_pts) if text and text[0] else ""
        draw = zlib.compress(f"{hidden}q {width_pts:g} 0 0 {height_pts:g} 0 0 cm /I Do Q".encode())
        objects.append(_stream("/Filter /FlateDecode", draw))
        n = len(objects)
        objects.append(
            f"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 {width_pts:g} {height_pts:g}] "
            f"/Resources << /Font << /F 3 0 R >> /XObject << /I {n - 1} 0 R >> >> /Contents {n} 0 R >>".encode()
        )
        kids.append(f"{n + 1} 0 R")
    objects[0] = b"<< /Type /Catalog /Pages 2 0 R >>"
    objects[1] = f"<< /Type /Pages /Count {len(kids)} /Kids [{' '.join(kids)}] >>".encode()
    out, offsets = [b"%PDF-1.7\n%\xe2\xe3\xcf\xd3\n"], []
    at = len(out[0])
    for i, body in enumerate(objects, 1):
        offsets.append(at)
        out.append(f"{i} 0 obj\n".encode() + body + b"\nendobj\n")
        at += len(out[-1])
    table = b"".join(f"{o:010d} 00000 n \n".encode() for o in offsets)
    out.append(f"xref\n0 {len(objects) + 1}\n0000000000 65535 f \n".encode() + table)
    out.append(f"trailer\n<< /Size {len(objects) + 1} /Root 1 0 R >>\nstartxref\n{at}\n%%EOF\n".encode())
    return b"".join(out)
