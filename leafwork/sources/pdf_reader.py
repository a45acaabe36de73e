"""PDF files with the standard library alone: pages, outline, metadata, simple text, and files of some of the pages.

Reads cross-reference tables and streams, object streams, Flate with predictors; a file whose references are broken is
searched for its objects. Text is what simple fonts show, by their ToUnicode map or as WinAnsi. Encrypted files are an error.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

SPACE, MARKS = b"\x00\t\n\x0c\r ", b"()<>[]{}/%"
_TOKEN = re.compile(rb"[^\x00\t\n\x0c\r ()<>\[\]{}/%]+")
_NUMBER = re.compile(rb"[+-]?(?:\d+\.?\d*|\.\d+)$")
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


class Name(str):
    """A name, without its slash."""


class Word(str):
    """A keyword or operator."""


@dataclass(frozen=True)
class Ref:
    number: int


@dataclass
class Stream:
    head: dict
    body: bytes


class Scanner:
    """Objects one after another from a place in a buffer."""

    def __init__(self, data: bytes, at: int = 0) -> None:
        self.data, self.at = data, at

    def skip(self) -> None:
        data, at = self.data, self.at
        while at < len(data):
            if data[at] in SPACE:
                at += 1
            elif data[at] == 0x25:  # a comment
                ends = [e for e in (data.find(b"\n", at), data.find(b"\r", at)) if e >= 0]
                at = min(ends, default=len(data))
            else:
                break
        self.at = at

    def next(self):
        """The next object; None at the end. References are made of three tokens."""
        self.skip()
        data, at = self.data, self.at
        if at >= len(data):
            return None
        c = data[at : at + 1]
        if c == b"/":
            m = _TOKEN.match(data, at + 1)
            self.at = m.end() if m else at + 1
            raw = m[0] if m else b""
            return Name(re.sub(rb"#([0-9A-Fa-f]{2})", lambda x: bytes([int(x[1], 16)]), raw).decode("latin-1"))
        if c == b"(":
            return self.literal()
        if data[at : at + 2] == b"<<":
            self.at = at + 2
            out = {}
            while isinstance(key := self.next(), Name):
                out[key] = self.value()
            return out
        if c == b"<":
            end = data.find(b">", at)
            self.at = (end if end >= 0 else len(data)) + 1
            digits = re.sub(rb"[^0-9A-Fa-f]", b"", data[at:end])
            return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
        if c == b"[":
            self.at, out = at + 1, []
            while not ((x := self.value()) is None or isinstance(x, Word) and x in ("]", "endobj")):
                out.append(x)
            return out
        if data[at : at + 2] == b">>" or c in (b"]", b"{", b"}", b">", b")"):
            self.at = at + (2 if data[at : at + 2] == b">>" else 1)
            return Word(data[at : self.at].decode())
        m = _TOKEN.match(data, at)
        self.at = m.end()
        if _NUMBER.match(m[0]):
            return float(m[0]) if b"." in m[0] else int(m[0])
        return Word(m[0].decode("latin-1"))

    def value(self):
        """next(), with references, and the words that are values."""
        x = self.next()
        if isinstance(x, int) and not isinstance(x, bool):
            here = self.at
            if isinstance(self.next(), int) and self.next() == "R":
                return Ref(x)
            self.at = here
        if isinstance(x, Word):
            return {"true": True, "false": False, "null": None}.get(x, x) if x != "null" else _NULL
        return x

    def literal(self) -> bytes:
        data, at, depth, out = self.data, self.at + 1, 1, bytearray()
        while at < len(data):
            c = data[at : at + 1]
            if c == b"\\":
                m = re.compile(rb"[0-7]{1,3}").match(data, at + 1)
                if m:
                    out.append(int(m[0], 8) & 255)
                    at = m.end()
                    continue
                e = data[at + 1 : at + 2]
                if e not in (b"\n", b"\r"):
                    out += _ESCAPES.get(e, e)
                at += 3 if data[at + 1 : at + 3] == b"\r\n" else 2
                continue
            depth += (c == b"(") - (c == b")")
            at += 1
            if not depth:
                break
            out += c
        self.at = at
        return bytes(out)


class _Null:
    """The null object, told from the end of the input."""

    def __bool__(self) -> bool:
        return False


_NULL = _Null()


def unpredict(data: bytes, parms: dict) -> bytes:
    """Undo the row filters of PNG that a Flate stream may be under."""
    if int(parms.get("Predictor", 1)) < 10:
        return data
    unit = max(1, int(parms.get("Colors", 1)) * int(parms.get("BitsPerComponent", 8)) // 8)
    wide = -(-int(parms.get("Columns", 1)) * int(parms.get("Colors", 1)) * int(parms.get("BitsPerComponent", 8)) // 8)
    out, above = bytearray(), bytes(wide)
    for at in range(0, len(data) - wide, wide + 1):
        kind, row = data[at], bytearray(data[at + 1 : at + 1 + wide])
        for i in range(wide):
            left = row[i - unit] if i >= unit else 0
            up, corner = above[i], above[i - unit] if i >= unit else 0
            if kind == 4:
                near = left + up - corner
                add = min((abs(near - left), 0, left), (abs(near - up), 1, up), (abs(near - corner), 2, corner))[2]
            else:
                add = (0, left, up, (left + up) // 2)[kind]
            row[i] = (row[i] + add) & 255
        out += row
        above = bytes(row)
    return bytes(out)


def text_of(raw) -> str:
    """A text string: UTF-16 or UTF-8 with a mark, else one byte a character."""
    if not isinstance(raw, bytes):
        return ""
    if raw[:2] in (b"\xfe\xff", b"\xff\xfe"):
        return raw.decode("utf-16", "replace")
    return raw[3:].decode("utf-8", "replace") if raw[:3] == b"\xef\xbb\xbf" else raw.decode("cp1252", "replace")


class Pdf:
    """One file. Objects are read when they are asked for."""

    def __init__(self, data: bytes) -> None:
        if b"%PDF-" not in data[:1024]:
            raise ValueError("not a PDF file")
        self.data, self.places, self.kept = data, {}, {}
        try:
            found = data.rindex(b"startxref")
            self.trailer = self.sections(Scanner(data, found + 9).next())
            self.catalog = self.dict(self.trailer["Root"])
            self.pages = list(self.leaves(self.catalog["Pages"], {}, set()))
        except (ValueError, KeyError, TypeError, AttributeError, IndexError, zlib.error):
            self.search()
        if "Encrypt" in self.trailer:
            raise ValueError("the file is encrypted")

    # ---- objects
    def sections(self, at: int) -> dict:
        """Places of objects from the cross-reference sections, newest first; the newest trailer."""
        trailer, seen, todo = None, set(), [at]
        while todo:
            at = todo.pop(0)
            if at in seen:
                continue
            seen.add(at)
            scan = Scanner(self.data, at)
            if (first := scan.next()) == "xref":
                while isinstance(start := scan.next(), int):
                    for i in range(scan.next()):
                        place, _, kind = scan.next(), scan.next(), scan.next()
                        if kind == "n":
                            self.places.setdefault(start + i, (place, None))
                head = scan.next()
            elif isinstance(first, int):
                stream = self.read(at)
                head = stream.head
                wide = head["W"]
                body, k = self.decoded(stream), 0
                pairs = head.get("Index") or [0, head["Size"]]
                for start, n in zip(pairs[::2], pairs[1::2], strict=True):
                    for i in range(n):
                        f = []
                        for w in wide:
                            f.append(int.from_bytes(body[k : k + w], "big"))
                            k += w
                        kind = f[0] if wide[0] else 1
                        if kind:
                            self.places.setdefault(start + i, (f[1], None) if kind == 1 else (f[2], f[1]))
            else:
                raise ValueError("no cross-reference section")
            trailer = trailer or head
            todo += [head[k] for k in ("XRefStm", "Prev") if isinstance(head.get(k), int)]
        return trailer

    def search(self) -> None:
        """Objects of a broken file, by their first words; the last of a number counts."""
        self.places = {int(m[1]): (m.start(), None) for m in re.finditer(rb"(?<!\d)(\d+)\s+\d+\s+obj\b", self.data)}
        self.kept, self.trailer = {}, {}
        for number in list(self.places):
            x = self.get(Ref(number))
            if isinstance(x, Stream) and x.head.get("Type") == "ObjStm":
                numbers = Scanner(self.decoded(x))
                for i in range(self.get(x.head["N"])):
                    self.places.setdefault(numbers.next(), (i, number))
                    numbers.next()
        for m in re.finditer(rb"trailer", self.data):
            head = Scanner(self.data, m.end()).next()
            self.trailer |= head if isinstance(head, dict) else {}
        if "Root" not in self.trailer:
            roots = [n for n in self.places if isinstance(x := self.get(Ref(n)), dict) and x.get("Type") == "Catalog"]
            if not roots:
                raise ValueError("no catalog")
            self.trailer["Root"] = Ref(roots[-1])
        self.catalog = self.dict(self.trailer["Root"])
        self.pages = list(self.leaves(self.catalog["Pages"], {}, set()))

    def read(self, at: int):
        """The object that stands at a place: `n g obj` and what follows."""
        scan = Scanner(self.data, at)
        scan.next(), scan.next(), scan.next()
        x = scan.value()
        scan.skip()
        if isinstance(x, dict) and self.data[scan.at : scan.at + 6] == b"stream":
            start = scan.at + 6
            start += 2 if self.data[start : start + 2] == b"\r\n" else 1
            n = self.get(x.get("Length"))
            if not isinstance(n, int) or b"endstream" not in self.data[start + n : start + n + 20]:
                n = max(self.data.find(b"endstream", start), start) - start
            return Stream(x, self.data[start : start + n])
        return x

    def get(self, x):
        """What a reference stands for; anything else is itself."""
        hops = 0
        while isinstance(x, Ref) and hops < 32:
            if x.number not in self.kept:
                place, box = self.places.get(x.number, (None, None))
                if place is None:
                    self.kept[x.number] = None
                elif box is None:
                    self.kept[x.number] = self.read(place)
                else:
                    holder = self.get(Ref(box))
                    body, heads = self.decoded(holder), []
                    scan = Scanner(body)
                    for _ in range(2 * self.get(holder.head["N"])):
                        heads.append(scan.next())
                    self.kept[x.number] = Scanner(body, self.get(holder.head["First"]) + heads[2 * place + 1]).value()
            x, hops = self.kept[x.number], hops + 1
        return None if x is _NULL or isinstance(x, Ref) else x

    def dict(self, x) -> dict:
        x = self.get(x)
        return x.head if isinstance(x, Stream) else x if isinstance(x, dict) else {}

    def decoded(self, stream: Stream) -> bytes:
        kinds, parms = self.get(stream.head.get("Filter")) or [], self.get(stream.head.get("DecodeParms")) or {}
        kinds = kinds if isinstance(kinds, list) else [kinds]
        parms = parms if isinstance(parms, list) else [parms] * len(kinds)
        body = stream.body
        for kind, parm in zip(map(self.get, kinds), parms, strict=False):
            if kind not in ("FlateDecode", "Fl"):
                raise ValueError(f"filter {kind} is not read")
            body = unpredict(zlib.decompressobj().decompress(body), self.dict(parm))
        return body

    # ---- structure
    def leaves(self, node, inherited: dict, seen: set) -> Iterator[tuple[Ref | None, dict]]:
        """(reference, page with what it inherits) in order."""
        own = self.dict(node)
        if isinstance(node, Ref):
            if node.number in seen:
                return
            seen.add(node.number)
        inherited = inherited | {k: own[k] for k in ("Resources", "MediaBox", "CropBox", "Rotate") if k in own}
        if "Kids" in own:
            for kid in self.get(own["Kids"]) or []:
                yield from self.leaves(kid, inherited, seen)
        elif own:
            yield (node if isinstance(node, Ref) else None), inherited | own

    def metadata(self) -> dict[str, str]:
        info = self.dict(self.trailer.get("Info"))
        return {k[0].lower() + k[1:]: text_of(self.get(v)) for k, v in info.items() if text_of(self.get(v))}

    def outline(self) -> list[tuple[int, str, int]]:
        """(level, title, page from 1; -1 for a target that isn't a page) in pre-order."""
        numbers = {ref.number: i for i, (ref, _) in enumerate(self.pages, 1) if ref}
        out, seen = [], set()

        def target(entry: dict) -> int:
            to = self.get(entry.get("Dest"))
            if to is None:
                action = self.dict(entry.get("A"))
                to = self.get(action.get("D")) if action.get("S") == "GoTo" else None
            if isinstance(to, bytes | Name):
                to = self.named(to)
            to = to.get("D") if isinstance(to, dict) else to
            to = self.get(to)
            page = to[0] if isinstance(to, list) and to else None
            return numbers.get(page.number, -1) if isinstance(page, Ref) else page + 1 if isinstance(page, int) else -1

        todo = [(self.dict(self.catalog.get("Outlines")).get("First"), 1)]
        while todo:
            ref, level = todo.pop()
            entry = self.dict(ref)
            if not entry or isinstance(ref, Ref) and ref.number in seen:
                continue
            if isinstance(ref, Ref):
                seen.add(ref.number)
            out.append((level, text_of(self.get(entry.get("Title"))), target(entry)))
            todo.append((entry.get("Next"), level))
            todo.append((entry.get("First"), level + 1))
        return out

    def named(self, name):
        """A named destination, from the catalog's dictionary or its name tree."""
        old = self.dict(self.catalog.get("Dests"))
        if isinstance(name, Name):
            return self.get(old.get(name))
        todo, seen = [self.dict(self.catalog.get("Names")).get("Dests")], 0
        while todo and seen < 10_000:
            node, seen = self.dict(todo.pop()), seen + 1
            pairs = self.get(node.get("Names")) or []
            for key, value in zip(pairs[::2], pairs[1::2], strict=False):
                if self.get(key) == name:
                    return self.get(value)
            todo += self.get(node.get("Kids")) or []
        return None

    # ---- text
    def spans(self, page: dict) -> list[tuple[int, int, int, str, float]]:
        """(block, line, span, text, size): a line is what stands at one height, a block ends where lines are far apart."""
        parts = self.get(page.get("Contents"))
        parts = parts if isinstance(parts, list) else [parts]
        body = b"\n".join(self.decoded(s) for s in map(self.get, parts) if isinstance(s, Stream))
        fonts = {k: self.font(v) for k, v in self.dict(self.dict(page.get("Resources")).get("Font")).items()}
        shown, stack, scan = [], [], Scanner(body)
        size, lead, font = 0.0, 0.0, None
        line = [1.0, 0.0, 0.0, 1.0, 0.0, 0.0]  # the text line's matrix
        frame, frames = line, []

        def move(x: float, y: float) -> None:
            nonlocal line
            a, b, c, d, e, f = line
            line = [a, b, c, d, e + x * a + y * c, f + x * b + y * d]

        def show(raw: bytes) -> None:
            text = font(raw) if font else raw.decode("cp1252", "replace")
            scale = abs(line[3] or line[1]) * abs(frame[3] or frame[1])
            shown.append((round(frame[5] + line[5] * (frame[3] or 1), 2), text, round(size * scale, 4)))

        while (x := scan.next()) is not None:
            if not isinstance(x, Word):
                stack.append(x)
                continue
            numbers = [float(v) for v in stack if isinstance(v, int | float)]
            if x == "BT":
                line = [1.0, 0.0, 0.0, 1.0, 0.0, 0.0]
            elif x == "q":
                frames.append(frame)
            elif x == "Q" and frames:
                frame = frames.pop()
            elif x == "cm" and len(numbers) == 6:
                a, b, c, d, e, f = frame
                g, h, i, j, k, m = numbers
                frame = [g * a + h * c, g * b + h * d, i * a + j * c, i * b + j * d, k * a + m * c + e, k * b + m * d + f]
            elif x == "Tf" and numbers:
                size, font = numbers[-1], fonts.get(stack[0])
            elif x == "TL" and numbers:
                lead = numbers[-1]
            elif x in ("Td", "TD") and len(numbers) == 2:
                lead = -numbers[1] if x == "TD" else lead
                move(*numbers)
            elif x == "Tm" and len(numbers) == 6:
                line = numbers
            elif x == "T*":
                move(0, -lead)
            elif x in ("Tj", "'", '"') and stack and isinstance(stack[-1], bytes):
                if x != "Tj":
                    move(0, -lead)
                show(stack[-1])
            elif x == "TJ" and stack and isinstance(stack[-1], list):
                gap = lambda v: b" " if isinstance(v, int | float) and v < -200 else b""
                show(b"".join(v if isinstance(v, bytes) else gap(v) for v in stack[-1]))
            elif x == "ID":  # an inline image
                scan.at = max(scan.data.find(b"EI", scan.at), scan.at) + 2
            stack = []
        out, block, row, k, last = [], 0, 0, 0, None
        for y, text, points in shown:
            if last is not None and y != last[0]:
                far = abs(last[0] - y) > 1.8 * max(points, last[1], 1)
                block, row, k = (block + 1, 0, 0) if far else (block, row + 1, 0)
            if out and last is not None and y == last[0] and out[-1][4] == points:
                out[-1] = (*out[-1][:3], out[-1][3] + text, points)
            else:
                out.append((block, row, k, text, points))
                k += 1
            last = (y, points)
        return out

    def font(self, x):
        """From bytes to text, by the font's ToUnicode map if it has one."""
        to = self.get(self.dict(x).get("ToUnicode"))
        if not isinstance(to, Stream):
            return lambda raw: raw.decode("cp1252", "replace")
        known, wide, held, scan = {}, 1, [], Scanner(self.decoded(to))
        put = lambda code, raw: known.__setitem__(code, raw.decode("utf-16-be", "replace"))
        while (v := scan.next()) is not None:
            if v in ("endcodespacerange",):
                wide = len(held[0]) if held else 1
            elif v == "endbfchar":
                for a, b in zip(held[::2], held[1::2], strict=False):
                    put(int.from_bytes(a, "big"), b)
            elif v == "endbfrange":
                for a, b, c in zip(held[::3], held[1::3], held[2::3], strict=False):
                    low, high = int.from_bytes(a, "big"), int.from_bytes(b, "big")
                    for i in range(min(high - low, 65535) + 1):
                        if isinstance(c, list):
                            if i < len(c):
                                put(low + i, c[i])
                        else:
                            put(low + i, c[:-2] + ((int.from_bytes(c[-2:], "big") + i) & 65535).to_bytes(2, "big"))
            if isinstance(v, Word):
                held = []
            else:
                held.append(v)
        return lambda raw: "".join(known.get(int.from_bytes(raw[i : i + wide], "big"), "") for i in range(0, len(raw), wide))

    # ---- files of pages
    def copy(self, first: int, last: int, metadata: dict[str, str]) -> bytes:
        """A file of the pages first .. last (from 1), with all that they refer to but other pages."""
        pages = {ref.number for ref, _ in self.pages if ref}
        numbers, bodies = {}, []

        def place(x: Ref) -> int:
            if x.number not in numbers:
                numbers[x.number] = len(bodies) + 1
                bodies.append(None)
                todo.append(x)
            return numbers[x.number]

        def put(x) -> bytes:
            if isinstance(x, Ref):
                return b"null" if x.number in pages or self.get(x) is None else b"%d 0 R" % place(x)
            if isinstance(x, dict):
                return b"<<" + b" ".join(put(Name(k)) + b" " + put(v) for k, v in x.items()) + b">>"
            if isinstance(x, Stream):
                return put({**x.head, Name("Length"): len(x.body)}) + b"\nstream\n" + x.body + b"\nendstream"
            if isinstance(x, list):
                return b"[" + b" ".join(map(put, x)) + b"]"
            if isinstance(x, Name):
                return b"/" + b"".join(bytes([c]) if _TOKEN.match(bytes([c])) and c != 35 and 33 <= c < 127 else b"#%02X" % c for c in x.encode("latin-1"))
            if isinstance(x, bytes):
                return b"<" + x.hex().encode() + b">"
            if isinstance(x, bool) or x is None or x is _NULL:
                return {True: b"true", False: b"false"}.get(x if isinstance(x, bool) else None, b"null")
            return (b"%d" % x) if isinstance(x, int) else f"{x:.6f}".rstrip("0").rstrip(".").encode() if isinstance(x, float) else str(x).encode("latin-1")

        todo: list[Ref] = []
        bodies += [b"<< /Type /Catalog /Pages 2 0 R >>", None, None]  # catalog, tree, metadata
        kids = []
        for _, page in self.pages[max(first, 1) - 1 : last]:
            kids.append(len(bodies) + 1)
            bodies.append(None)
            own = {k: v for k, v in page.items() if k not in ("Parent", "Annots", "StructParents")}
            bodies[kids[-1] - 1] = b"<< /Parent 2 0 R " + put(own)[2:]
        while todo:
            x = todo.pop()
            bodies[numbers[x.number] - 1] = put(self.get(x))
        bodies[1] = b"<< /Type /Pages /Kids [" + b" ".join(b"%d 0 R" % k for k in kids) + b"] /Count %d >>" % len(kids)
        names = {k[:1].upper() + k[1:]: b"\xfe\xff" + v.encode("utf-16-be") for k, v in metadata.items()}
        bodies[2] = put({Name(k): v for k, v in names.items()})
        out, places = bytearray(b"%PDF-1.7\n"), []
        for i, body in enumerate(bodies, 1):
            places.append(len(out))
            out += b"%d 0 obj\n" % i + body + b"\nendobj\n"
        start = len(out)
        out += b"xref\n0 %d\n0000000000 65535 f \n" % (len(bodies) + 1) + b"".join(b"%010d 00000 n \n" % p for p in places)
        out += b"trailer << /Size %d /Root 1 0 R /Info 3 0 R >>\nstartxref\n%d\n%%%%EOF\n" % (len(bodies) + 1, start)
        return bytes(out)
