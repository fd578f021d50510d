"""What is sent to a port, as streaming sources: lines from UDP datagrams, lines and frames from TCP
connections. The driver listens; what it receives is numbered and kept until the query has committed it, so
that a batch can be read again. What is sent while no query listens is lost."""

from __future__ import annotations

import socket
import struct
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

#: Frames that say they are longer end their connection.
MAX_FRAME = 1 << 26


class _Reader(SimpleDataSourceStreamReader):
    """Offsets number the items. At most about `most` of them are held; the rest waits in the sockets."""

    def __init__(self, host: str, port: int, most: int = 1_000_000):
        self.at, self.most = (host, port), most
        self.sock: socket.socket | None = None
        self.first, self.items = 0, []

    def _listen(self, kind: int) -> socket.socket:
        if self.sock is None:
            self.sock = socket.socket(socket.AF_INET, kind)
            self.sock.setsockopt(socket.SOL_SOCKET, socket.SO_REUSEADDR, 1)
            self.sock.bind(self.at)
            self.sock.setblocking(False)
            if kind == socket.SOCK_STREAM:
                self.sock.listen(128)
        return self.sock

    def _receive(self) -> None:
        raise NotImplementedError

    def initialOffset(self) -> dict:
        return {"line": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        if not self.items:
            self.first = start["line"]
        self._receive()
        rows = self._rows(start["line"], self.first + len(self.items))
        return iter(rows), {"line": start["line"] + len(rows)}

    def _rows(self, a: int, b: int) -> list[tuple]:
        return [(self.items[k - self.first], k) for k in range(max(a, self.first), min(b, self.first + len(self.items)))]

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter(self._rows(start["line"], end["line"]))

    def commit(self, end: dict) -> None:
        self.items = self.items[max(0, end["line"] - self.first) :]
        self.first = end["line"]


class _Udp(_Reader):
    def _receive(self) -> None:
        s = self._listen(socket.SOCK_DGRAM)
        while len(self.items) < self.most:
            try:
                self.items += s.recv(65_535).decode("utf-8", "replace").splitlines()
            except BlockingIOError:
                return


class _TcpLines(_Reader):
    def __init__(self, host: str, port: int, most: int = 1_000_000):
        super().__init__(host, port, most)
        self.open: list[tuple[socket.socket, bytearray]] = []

    def _receive(self) -> None:
        s = self._listen(socket.SOCK_STREAM)
        while True:
            try:
                c = s.accept()[0]
            except BlockingIOError:
                break
            c.setblocking(False)
            self.open.append((c, bytearray()))
        self.open = [x for x in self.open if self._more(*x)]

    def _more(self, c: socket.socket, held: bytearray) -> bool:
        """Take what a connection has; False when it has ended."""
        while len(self.items) < self.most:
            try:
                data = c.recv(1 << 16)
            except BlockingIOError:
                return True
            except OSError:
                data = b""
            held += data
            if not self._split(held, not data):
                c.close()
                return False
        return True

    def _split(self, held: bytearray, ended: bool) -> bool:
        *lines, rest = bytes(held).split(b"\n")
        if ended and rest:
            lines.append(rest)
        self.items += [x.decode("utf-8", "replace").rstrip("\r") for x in lines]
        held[:] = rest
        return not ended


class _TcpFrames(_TcpLines):
    def _split(self, held: bytearray, ended: bool) -> bool:
        while len(held) >= 4:
            (n,) = struct.unpack_from(">I", held)
            if n > MAX_FRAME:
                return False
            if len(held) < 4 + n:
                break
            self.items.append(bytes(held[: 4 + n]))
            del held[: 4 + n]
        return not ended


class _Source(DataSource):
    """Options host, port and maxLines (items held at a time)."""

    reader = _Reader
    columns = "value string, line bigint"

    def schema(self) -> str:
        return self.columns

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        o = self.options
        return self.reader(o.get("host", "127.0.0.1"), int(o["port"]), int(o.get("maxLines", 1_000_000)))


class UdpLines(_Source):
    reader = _Udp

    @classmethod
    def name(cls) -> str:
        return "udp_lines"


class TcpLines(_Source):
    reader = _TcpLines

    @classmethod
    def name(cls) -> str:
        return "tcp_lines"


class TcpFrames(_Source):
    """Frames of a 4-byte big-endian length and as many bytes, whole."""

    reader = _TcpFrames
    columns = "content binary, line bigint"

    @classmethod
    def name(cls) -> str:
        return "tcp_frames"


def listen(spark, source: type[_Source], port: int, host: str = "127.0.0.1", max_lines: int = 1_000_000) -> DataFrame:
    """Stream of (value or content, line): what is sent to host and port, numbered."""
    spark.dataSource.register(source)
    return spark.readStream.format(source.name()).option("host", host).option("port", port).option("maxLines", max_lines).load()
