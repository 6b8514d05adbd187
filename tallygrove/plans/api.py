"""The service's routes as functions over tables: same parameters and checks, without a server."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame

from ..operators import flows, index, listing, retrieval


def _rows(df: DataFrame) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.collect()]


class NotFound(LookupError):
    status = 404


def _bounded(name: str, value: int, least: int, most: int) -> None:
    if not least <= value <= most:
        raise ValueError(f"{name} from {least} to {most}")


class Service:
    """Tables, an embedder, models and a clock, all given."""

    def __init__(self, listings: DataFrame, built: index.Index | None = None, embedder=None, model: flows.Model | None = None, cache: flows.Cache | None = None, now=None) -> None:
        self.listings, self.index, self.embedder, self.model = listings, built, embedder, model
        self.cache, self.now = cache or flows.Cache(), now or (lambda: dt.datetime.now(dt.timezone.utc).replace(tzinfo=None))
        self.postings = retrieval.postings(built.chunks, "id", "content") if built else None

    def jobs(self, filters: listing.Filters = listing.Filters(), sort: str = "newest", page: int = 1, page_size: int = 20) -> dict:
        listing.check_page(page, page_size)
        key = flows.Cache.key(filters.key() | {"sort": sort, "page": page, "page_size": page_size})
        if (held := self.cache.get(key)) is not None:
            return held
        filters = listing.Filters(**{**filters.__dict__, "now": filters.now or self.now()})
        counted = listing.totals(self.listings, filters, page_size).first()
        rows = _rows(listing.shaped(listing.page_of(self.listings, filters, sort, page, page_size)))
        out = {"jobs": rows, "total": counted.total, "page": page, "page_size": page_size, "total_pages": counted.total_pages}
        self.cache.put(key, out)
        return out

    def job(self, id: int) -> dict:
        rows = _rows(listing.shaped(listing.by_id(self.listings, id), full=True))
        if not rows:
            raise NotFound(id)
        return rows[0]

    def similar(self, id: int, k: int = 6, same_company: bool = False) -> dict:
        _bounded("k", k, 1, 20)
        self.job(id)
        if self.index is None or self.index.vectors.where(f"job_id = {int(id)}").isEmpty():
            return {"indexed": False, "jobs": []}
        return {"indexed": True, "jobs": _rows(retrieval.similar(self.index.vectors, self.listings, id, k, same_company))}

    def search(self, q: str, mode: str = "hybrid", k: int = 10) -> list[dict]:
        _bounded("length of q", len(q), 2, 300)
        _bounded("k", k, 1, 50)
        searchers = retrieval.modes(self.index.chunks, self.postings, self.embedder)
        if mode not in searchers:
            raise ValueError(f"mode is one of {sorted(searchers)}")
        hits = retrieval.as_hits(searchers[mode](q, k), self.index.chunks, self.listings)
        return sorted(_rows(hits), key=lambda h: (-h["score"], h["chunk_id"]))

    def ask(self, question: str) -> flows.Answer:
        _bounded("length of question", len(question), 3, 500)
        return flows.answer(question, lambda q: _rows(retrieval.context(self.index.chunks, self.listings, self.postings, self.embedder, q)), self.model)

    def refreshed(self) -> int:
        """After new data: cached pages go."""
        return self.cache.clear("jobs:")
