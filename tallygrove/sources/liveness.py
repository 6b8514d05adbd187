"""Which postings' links are alive: one probe for each distinct URL, by an injected client in a thread pool."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.extract import domain

# Fixed values.
ALIVE = frozenset((200, 301, 302, 303, 307, 308, 401, 403))
DEAD_DOMAINS = ("liveblog365.com", "remote.co")
# End of fixed values.
NO_HEAD = 405


def probe(client: Callable[[str, str], int], url: str) -> bool:
    """client takes (method, url) and returns a status; any error means dead."""
    try:
        status = client("HEAD", url)
        return (client("GET", url) if status == NO_HEAD else status) in ALIVE
    except Exception:
        return False


def alive(df: DataFrame, client: Callable[[str, str], int], url_col: str = "url", threads: int = 30) -> DataFrame:
    def work(frames):
        with ThreadPoolExecutor(threads) as pool:
            for frame in frames:
                yield frame[[*pool.map(lambda u: probe(client, u), frame["url"])]] if len(frame) else pd.DataFrame({"url": []}, dtype=str)

    urls = df.select(F.col(url_col).alias("url")).where(F.col("url").startswith("http") & ~domain(F.col("url")).isin(*DEAD_DOMAINS)).distinct()
    found = urls.mapInPandas(work, "url string")
    return df.join(found, df[url_col] == found["url"], "left_semi")
