"""A PDF's document information, by its cross-reference table: a few kilobytes at known places of a file of any size.

Takes tables and streams of cross-references, their chains, object streams, and strings in UTF-16, UTF-8 or Latin-1. Texts of
pages and encrypted strings are left to a PDF library.
"""

from __future__ import annotations

import re
import zlib
from typing import BinaryIO

#: Bytes of the file's end in which the place of the last table stands, and those read at an object's place.
TAIL, OBJECT = 2048, 1 << 16
#: Tables in a chain, bytes of one, and bytes of an unpacked stream.
TABLES, TABLE_BYTES, STREAM_BYTES = 64, 1 << 24, 1 << 26
_WHITE = b"\x00\t\n\x0c\r "
_TOKEN = re.compile(rb"[\x00\t\n\x0c\r ]*(?:%[^\r\n]*[\x00\t\n\x0c\r ]*)*(<<|>>|\[|\]|\(|<|/[^\x00\t\n\x0c\r ()<>\[\]{}/%]*|[^\x00\t\n\x0c\r ()<>\[\]{}/%]+|.)", re.S)
_REFERENCE = re.compile(rb"[\x00\t\n\x0c\r ]+(\d+)[\x00\t\n\x0c\r ]+R(?![A-Za-z0-9])")
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


class Reference(int):
    """The number of an object that stands elsewhere."""


class _Values:
    """Objects as they stand in a piece of a file."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def _token(self) -> bytes:
        found = _TOKEN.match(self.data, self.at)
        if not found:
            raise ValueError("a PDF object is cut off")
        self.at = found.end()
        return found[1]

    def next(self, depth: int = 0):
        """A dict, list, name (str with its slash), string (bytes), number, Reference, or None for anything else."""
        token = self._token()
        if depth > 50:
            raise ValueError("PDF objects are nested too deep")
        if token == b"<<":
            out = {}
            while (key := self._token()) != b">>":
                out[key.decode("latin-1")] = self.next(depth + 1)
            return out
        if token == b"[":
            out = []
            while True:
                before = self.at
                if self._token() == b"]":
                    return out
                self.at = before
                out.append(self.next(depth + 1))
        if token == b"(":
            return self._string()
        if token == b"<":
            end = self.data.index(b">", self.at)
            digits = re.sub(rb"[^0-9A-Fa-f]", b"", self.data[self.at : end])
            self.at = end + 1
            return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
        if token.startswith(b"/"):
            return token.decode("latin-1")
        if re.fullmatch(rb"[+-]?\d+", token):
            if more := _REFERENCE.match(self.data, self.at):
                self.at = more.end()
                return Reference(int(token))
            return int(token)
        return None

    def _string(self) -> bytes:
        out, depth, data = bytearray(), 1, self.data
        while True:
            c = data[self.at : self.at + 1]
            if not c:
                raise ValueError("a PDF string is cut off")
            self.at += 1
            if c == b"\\":
                octal = re.compile(rb"[0-7]{1,3}").match(data, self.at)
                if octal:
                    out.append(int(octal[0], 8) & 255)
                    self.at = octal.end()
                    continue
                c = data[self.at : self.at + 1]
                self.at += 1
                if c in (b"\r", b"\n"):  # a line that goes on
                    self.at += c == b"\r" and data[self.at : self.at + 1] == b"\n"
                else:
                    out += _ESCAPES.get(c, c)
                continue
            depth += (c == b"(") - (c == b")")
            if not depth:
                return bytes(out)
            out += c


def _number(value) -> int:
    if not isinstance(value, int) or isinstance(value, Reference):
        raise ValueError("a PDF table lacks a number")
    return value


class _Pdf:
    def __init__(self, file: BinaryIO):
        self.file = file
        self.size = file.seek(0, 2)
        self.places: dict[int, tuple[int, int]] = {}  # object -> (place, -1), or (object stream, index)
        self.trailer: dict = {}

    def _read(self, at: int, size: int) -> bytes:
        if not 0 <= at < self.size:
            raise ValueError("a place outside of the PDF")
        self.file.seek(at)
        return self.file.read(size)

    def load(self) -> None:
        """All tables, the newest first; what a newer one says stands."""
        tail = self._read(max(0, self.size - TAIL), TAIL)
        found = re.findall(rb"startxref[\x00\t\n\x0c\r ]*(\d+)", tail)
        if not found:
            raise ValueError("no startxref at the PDF's end")
        todo, seen = [int(found[-1])], set()
        while todo and len(seen) < TABLES:
            at = todo.pop(0)
            if at in seen:
                continue
            seen.add(at)
            head = self._read(at, OBJECT)
            trailer = self._table(at) if head.lstrip(_WHITE).startswith(b"xref") else self._table_stream(at)
            self.trailer = trailer | self.trailer
            todo += [trailer[k] for k in ("/XRefStm", "/Prev") if isinstance(trailer.get(k), int)]

    def _table(self, at: int) -> dict:
        data = b""
        while b"trailer" not in data or len(data) - data.index(b"trailer") < OBJECT:
            more = self._read(at + len(data), OBJECT) if at + len(data) < self.size else b""
            data += more
            if not more or len(data) > TABLE_BYTES:
                break
        end = data.index(b"trailer")
        numbers = data[data.index(b"xref") + 4 : end].split()
        i = 0
        while i + 1 < len(numbers):
            first, n = int(numbers[i]), int(numbers[i + 1])
            i += 2
            for k in range(n):
                if i + 3 > len(numbers):
                    break
                if numbers[i + 2] == b"n":
                    self.places.setdefault(first + k, (int(numbers[i]), -1))
                i += 3
        trailer = _Values(data, end + 7).next()
        return trailer if isinstance(trailer, dict) else {}

    def _table_stream(self, at: int) -> dict:
        about, data = self._stream(at)
        widths = [_number(w) for w in about["/W"]]
        index = about.get("/Index") or [0, _number(about["/Size"])]
        row, i = sum(widths), 0
        for first, n in zip(index[::2], index[1::2], strict=False):
            for k in range(_number(n)):
                fields, j = [], i
                for w in widths:
                    fields.append(int.from_bytes(data[j : j + w], "big"))
                    j += w
                if j > len(data):
                    return about
                kind = fields[0] if widths[0] else 1
                if kind == 1:
                    self.places.setdefault(first + k, (fields[1], -1))
                elif kind == 2:
                    self.places.setdefault(first + k, (fields[1], fields[2]))
                i += row
        return about

    def _stream(self, at: int) -> tuple[dict, bytes]:
        """A stream's dictionary and its unpacked bytes."""
        head = self._read(at, OBJECT)
        start = re.match(rb"[\x00\t\n\x0c\r ]*\d+[\x00\t\n\x0c\r ]+\d+[\x00\t\n\x0c\r ]+obj", head)
        values = _Values(head, start.end() if start else 0)
        about = values.next()
        if not isinstance(about, dict):
            raise ValueError("no stream where the PDF says")
        begin = re.compile(rb"[\x00\t\n\x0c\r ]*stream\r?\n").match(head, values.at)
        if not begin:
            raise ValueError("no stream where the PDF says")
        length = about.get("/Length")
        if isinstance(length, Reference):
            length = self.get(length)
        data = self._read(at + begin.end(), min(_number(length), TABLE_BYTES))
        filters = about.get("/Filter") or []
        for f in [filters] if isinstance(filters, str) else filters:
            if f != "/FlateDecode":
                raise ValueError(f"no PDF filter {f} here")
            data = zlib.decompressobj().decompress(data, STREAM_BYTES)
        parameters = about.get("/DecodeParms") or {}
        parameters = parameters[0] if isinstance(parameters, list) and parameters else parameters
        if isinstance(parameters, dict) and (parameters.get("/Predictor") or 1) >= 10:
            data = _unpredicted(data, parameters.get("/Columns") or 1)
        return about, data

    def get(self, number: int, depth: int = 0):
        """An object by its number; None if there is none."""
        place, index = self.places.get(number, (0, 0))
        if depth > 8 or not place:
            return None
        if index < 0:
            size = OBJECT
            while True:
                data = self._read(place, size)
                start = re.match(rb"[\x00\t\n\x0c\r ]*\d+[\x00\t\n\x0c\r ]+\d+[\x00\t\n\x0c\r ]+obj", data)
                if not start:
                    raise ValueError("no object where the PDF says")
                try:
                    return _Values(data, start.end()).next()
                except ValueError:
                    if len(data) < size or size > TABLE_BYTES:
                        raise
                    size *= 8
        holder = self.places.get(place, (0, 0))
        if holder[1] >= 0:
            return None
        about, data = self._stream(holder[0])
        heads = data[: _number(about["/First"])].split()
        for i in range(_number(about["/N"])):
            if int(heads[2 * i]) == number:
                return _Values(data, about["/First"] + int(heads[2 * i + 1])).next()
        return None


def _unpredicted(data: bytes, columns: int) -> bytes:
    """Rows of bytes from their differences, as in PNG images; one byte a value."""
    out, above = bytearray(), bytes(columns)
    for at in range(0, len(data) - columns, columns + 1):
        kind, row = data[at], bytearray(data[at + 1 : at + 1 + columns])
        for i in range(columns):
            left, corner = (row[i - 1], above[i - 1]) if i else (0, 0)
            if kind == 1:
                guess = left
            elif kind == 2:
                guess = above[i]
            elif kind == 3:
                guess = (left + above[i]) // 2
            elif kind == 4:
                near = left + above[i] - corner
                guess = min((left, above[i], corner), key=lambda x: abs(near - x))
            else:
                guess = 0
            row[i] = (row[i] + guess) & 255
        out += row
        above = bytes(row)
    return bytes(out)


def _text(raw: bytes) -> str:
    if raw[:2] in (b"\xfe\xff", b"\xff\xfe"):
        return raw.decode("utf-16", errors="replace")
    return raw.decode("utf-8-sig", errors="replace") if raw[:3] == b"\xef\xbb\xbf" else raw.decode("latin-1")


def document_information(file: BinaryIO) -> dict[str, str]:
    """The entries of a PDF's information dictionary that are texts, say Title and Author; none if the file is encrypted or has none."""
    pdf = _Pdf(file)
    if not pdf._read(0, 1024).lstrip(_WHITE).startswith(b"%PDF-"):
        raise ValueError("not a PDF")
    pdf.load()
    info = pdf.trailer.get("/Info")
    info = pdf.get(info) if isinstance(info, Reference) else info
    if not isinstance(info, dict) or "/Encrypt" in pdf.trailer:
        return {}
    found = {k[1:]: pdf.get(v) if isinstance(v, Reference) else v for k, v in info.items()}
    return {k: text for k, v in found.items() if isinstance(v, bytes) and (text := _text(v).strip("\x00 "))}
