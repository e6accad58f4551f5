"""Addresses that need a base: resolution, normal form and safety, in plain Python for Arrow workers."""

from __future__ import annotations

import ipaddress
import re
from urllib.parse import parse_qsl, urlencode, urljoin, urlsplit, urlunsplit

from pagelens.functions.urls import TRACKING_PARAMS

_PORTS = {"http": 80, "https": 443}
# Beginnings of references that lead to no page.
_ELSEWHERE = ("#", "mailto:", "tel:", "javascript:", "data:")
_TRACKING = frozenset(TRACKING_PARAMS)
_HOST = re.compile(r"(?=.{1,253}$)([a-z0-9]([a-z0-9-]{0,61}[a-z0-9])?\.)+[a-z0-9-]{2,63}", re.I)


def _parts(url: str | None, base: str | None):
    """The pieces of a resolved web address and its host with any unusual port, or nothing."""
    url = (url or "").strip()
    if not url or url.startswith(_ELSEWHERE):
        return None
    try:
        found = urlsplit(urljoin(base, url) if base else url)
        scheme, port = found.scheme.lower(), found.port
        host = (found.hostname or "").lower()
    except ValueError:
        return None
    if scheme not in _PORTS or not host:
        return None
    host = f"[{host}]" if ":" in host else host
    return found, scheme, host if port in (None, _PORTS[scheme]) else f"{host}:{port}"


def normal(url: str | None, base: str | None = None) -> str | None:
    """One spelling of a web address: no fragment, user, default port, tracking parameter, doubled or final slash. None for anything else."""
    parts = _parts(url, base)
    if not parts:
        return None
    found, scheme, place = parts
    path = re.sub("/{2,}", "/", found.path).rstrip("/") or "/"
    asked = [(k, v) for k, v in parse_qsl(found.query, keep_blank_values=True) if k.lower() not in _TRACKING]
    return urlunsplit((scheme, place, path, urlencode(asked), ""))


def absolute(url: str | None, base: str | None = None) -> str | None:
    """The address as a redirect would follow it: path and query as they stand."""
    parts = _parts(url, base)
    return urlunsplit((parts[1], parts[2], parts[0].path or "/", parts[0].query, "")) if parts else None


def site(url: str | None) -> str:
    try:
        host = (urlsplit(url or "").hostname or "").lower().rstrip(".")
    except ValueError:
        return ""
    return host.removeprefix("www.")


def same_site(a: str | None, b: str | None) -> bool:
    x, y = site(a), site(b)
    return bool(x and y) and (x == y or x.endswith("." + y) or y.endswith("." + x))


def private_address(host: str) -> bool | None:
    """Whether a literal address is not a public one; None for a name, which takes a lookup to know."""
    try:
        found = ipaddress.ip_address(host.strip("[]"))
    except ValueError:
        return None
    return not found.is_global or found.is_multicast


def target(text: str) -> str:
    """The address an audit may start at. Raises ValueError for another scheme, credentials, a bad name or a private address."""
    text = text.strip()
    found = urlsplit(text if "://" in text else f"https://{text}")
    host = (found.hostname or "").lower()
    if found.scheme.lower() not in _PORTS:
        raise ValueError("only http and https addresses can be read")
    if found.username or found.password:
        raise ValueError("an address with credentials is refused")
    if private_address(host):
        raise ValueError("a private address is refused")
    if private_address(host) is None and not _HOST.fullmatch(host):
        raise ValueError("not a host name")
    return normal(found.geturl())
