"""Fetching texts for a work list: the first place of each id that answers well."""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Get = Callable[[str], tuple[int, str]]


def first_good(rows: list[tuple[int, int, str]], get: Get, attempts: int = 3, wait: float = 0.5, least: int = 1) -> tuple[int, str | None, str | None, int]:
    """(id, url, text, tries) of one id's places (id, at, url) in order; a place is tried again after errors.

    An answer is good if its status is 200, it is not a web page and it has ``least`` characters.
    """
    tries = 0
    for number, _, url in sorted(rows, key=lambda r: r[1]):
        for k in range(attempts):
            tries += 1
            try:
                status, text = get(url)
            except OSError:
                time.sleep(wait * 2**k * (0.5 + random.Random(f"{url}|{k}").random()))
                continue
            if status == 200 and len(text) >= least and not text.lstrip()[:15].lower().startswith(("<!doctype html", "<html")):
                return number, url, text, tries
            break
    return rows[0][0], None, None, tries


def fetched(worklist: DataFrame, get: Get, **options) -> DataFrame:
    """id, url, text, tries for each id of a work list (id, at, url); url and text are null if no place is good.

    ``get`` runs on the executors; ids are dealt by hash, so a failed task fetches only its own again.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple[int, int, str]] = []
        done = []
        for batch in batches:
            for row in batch.itertuples(index=False):
                if held and held[0][0] != row.id:
                    done.append(first_good(held, get, **options))
                    held = []
                held.append((row.id, row.at, row.url))
            yield pd.DataFrame(done, columns=["id", "url", "text", "tries"])
            done = []
        if held:
            yield pd.DataFrame([first_good(held, get, **options)], columns=["id", "url", "text", "tries"])

    dealt = worklist.select(F.col("id").cast("long").alias("id"), "at", "url").repartition("id").sortWithinPartitions("id", "at")
    return dealt.mapInPandas(run, "id long, url string, text string, tries long")
