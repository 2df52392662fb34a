"""A guarded way out: addresses are checked before every hop, redirects and bodies are bounded.

The exchange itself is injected: (method, address, headers, body) -> (status, headers, chunks of the body).
"""

from __future__ import annotations

import ipaddress
import socket
from collections.abc import Callable, Iterable
from urllib.parse import urljoin, urlsplit

from tidewheel.functions.urls import redacted_url
from tidewheel.sources.feeds import Refused, checked_address

Exchange = Callable[[str, str, dict[str, str], bytes | None], tuple[int, dict[str, str], Iterable[bytes]]]
MOVED = (301, 302, 303, 307, 308)
PRIVATE_HEADERS = ("authorization", "cookie", "proxy-authorization")
HOPS = 5


class Unsafe(OSError):
    """An address, a redirect or a body that isn't taken; ``kind`` says which rule it breaks."""

    def __init__(self, kind: str, said: str) -> None:
        super().__init__(f"{kind}: {said}")
        self.kind = kind


def resolved(host: str, port: int) -> list[str]:
    """The addresses of a host, as the system resolves it."""
    try:
        return list(dict.fromkeys(info[4][0] for info in socket.getaddrinfo(host, port, type=socket.SOCK_STREAM)))
    except OSError as e:
        raise Unsafe("dns", host) from e


def _origin(url: str) -> tuple[str, str, int]:
    parts = urlsplit(url)
    return parts.scheme, parts.hostname or "", parts.port or {"http": 80, "https": 443}[parts.scheme]


class Guarded:
    """Fetches with ``exchange``; a name whose addresses aren't all public is refused before anything is sent, at every hop."""

    def __init__(self, exchange: Exchange, resolve: Callable[[str, int], list[str]] = resolved, plain_hosts: frozenset[str] = frozenset(), hops: int = HOPS, most: int | None = None) -> None:
        self.exchange, self.resolve, self.plain_hosts, self.hops, self.most = exchange, resolve, plain_hosts, hops, most

    def _checked(self, url: str) -> str:
        try:
            address = checked_address(url, self.plain_hosts)
        except ValueError as e:
            raise Unsafe("address", str(e)) from e
        _, host, port = _origin(address)
        found = self.resolve(host, port)
        if not found or not all(ipaddress.ip_address(a).is_global for a in found):
            raise Unsafe("address", f"{host} has no public address")
        return address

    def _body(self, chunks: Iterable[bytes]) -> bytes:
        out = bytearray()
        for chunk in chunks:
            out += chunk
            if self.most is not None and len(out) > self.most:
                raise Unsafe("body", f"more than {self.most} bytes")
        return bytes(out)

    def request(self, method: str, url: str, headers: dict[str, str] | None = None, body: bytes | None = None) -> tuple[int, dict[str, str], bytes]:
        address, sent = self._checked(url), dict(headers or {})
        seen = {address}
        for hop in range(self.hops + 1):
            status, answer, chunks = self.exchange(method, address, sent, body)
            answer = {k.lower(): v for k, v in answer.items()}
            if status not in MOVED:
                return status, answer, self._body(chunks)
            if not answer.get("location"):
                raise Unsafe("redirect", "no location")
            if hop == self.hops:
                break
            following = self._checked(urljoin(address, answer["location"]))
            if method != "GET" and (status not in (307, 308) or _origin(following) != _origin(address)):
                raise Unsafe("redirect", f"{method} to {redacted_url(following)}")
            if address.startswith("https:") and following.startswith("http:"):
                raise Unsafe("downgrade", redacted_url(following))
            if following in seen:
                raise Unsafe("loop", redacted_url(following))
            if _origin(following) != _origin(address):
                sent = {k: v for k, v in sent.items() if k.lower() not in PRIVATE_HEADERS}
            seen.add(following)
            address = following
        raise Unsafe("redirects", f"more than {self.hops} from {redacted_url(url)}")

    def __call__(self, url: str) -> bytes:
        status, _, body = self.request("GET", url)
        if not 200 <= status < 300:
            raise Refused(status)
        return body
