"""Sites as a data source: ``spark.read.format("site_crawl")`` visits each site in a task of its own, breadth first and within bounds.

A task keeps one site's queue, robots rules and sitemap addresses (all bounded by ``Limits``); sites are what is dealt over the
cluster. Redirects are followed by hand, so each hop is judged before it is taken. A page that could not be read is a row that
says why; nothing raises for a site's sake.

Options: ``sites`` (addresses, one a line), ``what`` (``pages``, or ``files`` for robots.txt and sitemap addresses), ``private``
(``true`` allows addresses that are not public, for tests), and any field of ``Limits`` by name.
"""

from __future__ import annotations

import socket
import time
from collections import deque
from collections.abc import Callable, Iterator
from typing import NamedTuple
from urllib.error import HTTPError
from urllib.parse import urljoin, urlsplit
from urllib.request import HTTPRedirectHandler, Request, build_opener
from urllib.robotparser import RobotFileParser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from pagelens.functions import resolve
from pagelens.functions import urls as U
from pagelens.functions import vocab as V
from pagelens.operators.parse import parse
from pagelens.operators.robots import locations

PAGES = "page_id long, site string, url string, final_url string, status int, ok boolean, fetched boolean, depth int, is_home boolean, in_sitemap boolean, from_url string, outcome string, refused_target string, redirects int, redirect_chain array<string>, content_type string, robots_header string, robots_allowed boolean, truncated boolean, error string, html string"
FILES = "site string, url string, robots string, robots_status int, sitemap_urls array<string>, sitemaps array<string>"


class Limits(NamedTuple):
    """How far a visit to one site goes."""

    pages: int = 20
    depth: int = 3
    redirects: int = 5
    page_bytes: int = 3_000_000
    robots_chars: int = 200_000
    sitemaps: int = 5
    sitemap_urls: int = 2_000
    seconds: float = 150.0
    timeout: float = 12.0
    delay: float = 0.15
    agent: str = "pagelens/1.0 (read-only; respects robots.txt)"


class Answer(NamedTuple):
    status: int
    headers: dict[str, str]
    body: bytes
    truncated: bool = False


class _Stay(HTTPRedirectHandler):
    def redirect_request(self, *_):
        return None


def web_get(limits: Limits) -> Callable[[str], Answer]:
    """Reads an address as it answers, redirects left alone, and no more than the bound of its body."""
    opener = build_opener(_Stay)

    def get(url: str) -> Answer:
        ask = Request(url, headers={"User-Agent": limits.agent, "Accept": "text/html,application/xhtml+xml,*/*;q=0.1"})
        try:
            got = opener.open(ask, timeout=limits.timeout)
        except HTTPError as refusal:
            got = refusal
        with got:
            body = got.read(limits.page_bytes + 1)
            return Answer(got.status, {k.lower(): v for k, v in got.headers.items()}, body[: limits.page_bytes], len(body) > limits.page_bytes)

    return get


def is_private(host: str) -> bool:
    """Whether a host is no public address, or a name that does not lead to one."""
    literal = resolve.private_address(host)
    if literal is not None:
        return literal
    try:
        found = {x[4][0] for x in socket.getaddrinfo(host, None)}
    except OSError:
        return True
    return any(resolve.private_address(x) is not False for x in found)


def _decoded(answer: Answer) -> str:
    kind = answer.headers.get("content-type", "").lower()
    name = kind.partition("charset=")[2].split(";")[0].strip(" \"'") or "utf-8"
    try:
        return answer.body.decode(name, errors="replace")
    except LookupError:
        return answer.body.decode("utf-8", errors="replace")


class Visit:
    """One visit to one site."""

    def __init__(self, start: str, limits: Limits, get: Callable[[str], Answer] | None = None, private: Callable[[str], bool] = is_private):
        self.start, self.limits, self.get, self.private = start, limits, get or web_get(limits), private
        self.site = resolve.site(start)
        self.robots: str | None = None
        self.robots_status: int | None = None
        self.rules = RobotFileParser()
        self.rules.parse([])
        self.listed: list[str] = []
        self.sitemaps: list[str] = []
        self.ends = time.monotonic() + limits.seconds

    def _followed(self, url: str) -> Answer | None:
        """The answer at the end of any redirects, for files; nothing where there is none."""
        for _ in range(self.limits.redirects + 1):
            if self.private(urlsplit(url).hostname or ""):
                return None
            try:
                answer = self.get(url)
            except Exception:
                return None
            aim = resolve.absolute(answer.headers.get("location"), url) if 300 <= answer.status < 400 else None
            if not aim:
                return answer
            url = aim
        return None

    def read_robots(self) -> None:
        """A file that is missing or cannot be read forbids nothing."""
        answer = self._followed(urljoin(self.start, "/robots.txt"))
        self.robots_status = answer.status if answer else None
        if answer and answer.status == 200 and answer.body:
            self.robots = _decoded(answer)[: self.limits.robots_chars]
            self.rules = RobotFileParser()
            self.rules.parse(self.robots.splitlines())

    def read_sitemaps(self) -> None:
        """Addresses from the sitemaps that robots.txt names and the usual one, and one level of sitemaps that they name."""
        named = [line.partition(":")[2].strip() for line in (self.robots or "").splitlines() if line.lower().startswith("sitemap:")]
        first = [x for x in (resolve.normal(y, self.start) for y in [y for y in named if y] + ["/sitemap.xml"]) if x][: self.limits.sitemaps]
        queue, met, latest = deque((x, True) for x in dict.fromkeys(first)), set(first), time.monotonic() + self.limits.seconds / 4
        found: dict[str, None] = {}
        while queue and time.monotonic() < latest:
            aim, may_list = queue.popleft()
            answer = self._followed(aim)
            if not answer or answer.status != 200:
                continue
            self.sitemaps.append(aim)
            inner, is_index = locations(_decoded(answer), aim)
            if not is_index:
                found.update(dict.fromkeys(inner))
            elif may_list:
                fresh = [x for x in inner[: self.limits.sitemaps] if x not in met]
                met.update(fresh)
                queue.extendleft((x, False) for x in reversed(fresh))
        self.listed = list(found)[: self.limits.sitemap_urls]

    def allowed(self, url: str) -> bool:
        return self.rules.can_fetch(self.limits.agent, url) or self.rules.can_fetch("*", url)

    def refusal(self, url: str) -> str | None:
        """Why a redirect is not followed to an address, or nothing."""
        if not resolve.same_site(url, self.start):
            return "refused_external_domain"
        if self.private(urlsplit(url).hostname or ""):
            return "refused_non_public_address"
        return None if self.allowed(url) else "refused_robots"

    def page(self, url: str, depth: int, source: str | None) -> dict:
        row = dict.fromkeys(x.split()[0] for x in PAGES.split(", "))
        row |= {"site": self.site, "url": url, "final_url": url, "ok": False, "fetched": False, "depth": depth, "from_url": source, "is_home": url == self.start, "in_sitemap": url in self.listed, "outcome": "none"}
        row |= {"redirects": 0, "redirect_chain": [], "robots_allowed": True, "truncated": False, "html": "", "content_type": "", "robots_header": ""}
        if not self.allowed(url):
            return row | {"robots_allowed": False, "outcome": "refused_robots", "error": "closed by robots.txt"}
        if self.private(urlsplit(url).hostname or ""):
            return row | {"outcome": "refused_non_public_address", "error": "not a public address"}
        now, met = url, {url}
        while True:
            try:
                answer = self.get(now)
            except Exception as wrong:
                return row | {"outcome": row["outcome"] if row["outcome"] == "followed" and row["status"] is None else "transport_error", "error": f"{type(wrong).__name__}: {wrong}"[:300]}
            row |= {"status": answer.status, "content_type": answer.headers.get("content-type", ""), "robots_header": answer.headers.get("x-robots-tag", "")}
            if answer.status not in (301, 302, 303, 307, 308):
                break
            if len(row["redirect_chain"]) >= self.limits.redirects:
                return row | {"outcome": "limit_exceeded", "error": "too many redirects"}
            aim = resolve.absolute(answer.headers.get("location"), now)
            if not aim or aim in met:
                return row | {"outcome": "loop" if aim else "bad_location", "error": "a redirect that leads back" if aim else "a redirect without an address"}
            met.add(aim)
            row["redirect_chain"].append(now)
            row["redirects"] += 1
            if reason := self.refusal(aim):
                return row | {"outcome": reason, "refused_target": aim, "final_url": aim, "robots_allowed": reason != "refused_robots", "error": "a redirect that is not followed"}
            now, row["outcome"] = aim, "followed"
        kind = row["content_type"].lower()
        text = _decoded(answer) if not kind or any(t in kind for t in V.HTML_TYPES) else ""
        return row | {"final_url": resolve.normal(now) or now, "fetched": True, "ok": 200 <= answer.status < 300, "html": text, "truncated": answer.truncated}

    def wanted(self, url: str) -> bool:
        """Whether an address is a page of this site that visitors may see."""
        path = urlsplit(url).path.lower()
        words = {w for part in path.split("/") for chunk in part.split("-") for piece in chunk.split("_") for w in piece.split(".")}
        return resolve.same_site(url, self.start) and path.rpartition(".")[2] not in U.ASSET_SUFFIXES and not words & set(U.ACCOUNT_TOKENS)

    def pages(self) -> Iterator[dict]:
        """Pages level by level; where links run dry, addresses of the sitemap that are no deeper than the bound."""
        self.read_robots()
        self.read_sitemaps()
        seeds = [u for u in self.listed if self.wanted(u)]
        queue: deque[tuple[str, int, str | None]] = deque([(self.start, 0, None)])
        seen, done = {self.start}, 0
        while queue and done < self.limits.pages and time.monotonic() < self.ends:
            url, depth, source = queue.popleft()
            if done and self.limits.delay:
                time.sleep(self.limits.delay)
            row = self.page(url, depth, source)
            done += 1
            seen.add(row["final_url"])
            yield row
            if row["html"] and depth < self.limits.depth:
                found = parse(row["html"], row["final_url"])
                for link in found["internal_links"]:
                    if link not in seen and self.wanted(link):
                        seen.add(link)
                        queue.append((link, depth + 1, row["final_url"]))
            if not queue and seeds:
                fresh = [(u, d, "sitemap") for u in seeds if u not in seen and (d := len([x for x in urlsplit(u).path.split("/") if x])) <= self.limits.depth][: self.limits.pages]
                seen.update(u for u, *_ in fresh)
                queue.extend(fresh)
                seeds = []


class _Site(InputPartition):
    def __init__(self, number: int, url: str):
        super().__init__(number)
        self.number, self.url = number, url


class SiteReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        kinds = {k: type(v) for k, v in Limits()._asdict().items()}
        self.limits = Limits(**{k: kinds[k](options[k]) for k in kinds if k in options})
        self.sites = [x for x in (resolve.normal(y if "://" in y else f"https://{y}") for y in options.get("sites", "").split("\n") if y.strip()) if x]
        self.what, self.open = options.get("what", "pages"), options.get("private", "false") == "true"

    def partitions(self):
        return [_Site(i, x) for i, x in enumerate(dict.fromkeys(self.sites))] or [_Site(0, "")]

    def read(self, partition):
        if not partition.url:
            return
        visit = Visit(partition.url, self.limits, private=(lambda host: False) if self.open else is_private)
        if self.what == "files":
            visit.read_robots()
            visit.read_sitemaps()
            yield visit.site, visit.start, visit.robots, visit.robots_status, visit.listed, visit.sitemaps
            return
        for seq, row in enumerate(visit.pages()):
            yield tuple((row | {"page_id": (partition.number << 32) | seq}).values())


class SiteCrawl(DataSource):
    """Register with ``spark.dataSource.register(SiteCrawl)``."""

    @classmethod
    def name(cls):
        return "site_crawl"

    def schema(self):
        return FILES if self.options.get("what") == "files" else PAGES

    def reader(self, schema):
        return SiteReader(self.options)


# What a home page's answer means for its site.
HOME_OUTCOMES = {
    "refused_external_domain": "external_redirect",
    "refused_non_public_address": "private_redirect",
    "loop": "redirect_loop",
    "limit_exceeded": "redirect_limit",
    "bad_location": "bad_location",
    "transport_error": "transport_error",
}


def home_outcome(outcome: Column, status: Column, fetched: Column, redirects: Column) -> Column:
    """How the request for a home page ended. Nulls mean that there was no answer."""
    said = F.coalesce(*[F.when(outcome == k, v) for k, v in HOME_OUTCOMES.items()], F.when(outcome == "refused_robots", F.when(redirects == 0, "robots_blocked").otherwise("robots_redirect")))
    answered = F.when(F.coalesce(fetched, F.lit(False)), F.when(status.between(200, 299), "ok").otherwise("http_error"))
    return F.coalesce(said, F.when(status.isNull(), "transport_error"), answered, F.lit("transport_error"))


def homes(pages: DataFrame) -> DataFrame:
    """(site, home_outcome) of crawled sites."""
    c = F.col
    return pages.filter("is_home").groupBy("site").agg(F.min(home_outcome(c("outcome"), c("status"), c("fetched"), c("redirects"))).alias("home_outcome"))
