"""Paged REST sources, with the transport left to the caller: this library opens no connections of its own.

``fetch(url, payload)`` returns parsed JSON; it runs on the driver, since such services limit the rate of calls.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterable, Iterator, Sequence
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NUTRIENT = "struct<nutrient:struct<name:string,unitName:string>,amount:double,nutrientName:string,unitName:string,value:double>"
FOOD = f"fdcId long, description string, dataType string, brandOwner string, gtinUpc string, ingredients string, servingSize double, servingSizeUnit string, householdServingFullText string, foodNutrients array<{NUTRIENT}>"


def pages(fetch: Callable[[str, dict], dict], url: str, query: str, kinds: Sequence[str], size: int = 50, most: int | None = None) -> Iterator[dict]:
    """Foods of a search, page by page, until one is empty."""
    page = 1
    while most is None or page <= most:
        found = fetch(url, {"query": query, "dataType": ",".join(kinds), "pageSize": size, "pageNumber": page}).get("foods", [])
        if not found:
            return
        yield from found
        page += 1


def details(fetch: Callable[[str, dict], list], url: str, ids: Sequence[int], size: int = 20, pause: float = 0.5) -> Iterator[dict]:
    """Foods by id, a batch a call with a pause between calls."""
    for k in range(0, len(ids), size):
        if k:
            time.sleep(pause)
        yield from fetch(url, {"fdcIds": list(ids[k : k + size])})


def to_table(spark: SparkSession, foods: Iterable[dict], schema: str = FOOD, **tags: str) -> DataFrame:
    """Records as a typed table; further columns hold ``tags``."""
    rows = spark.createDataFrame([(json.dumps(f),) for f in foods], "value string")  # one page or one keyword's pages at a time
    df = rows.select(F.from_json("value", schema).alias("f")).select("f.*")
    return df.withColumns({k: F.lit(v) for k, v in tags.items()})


def crawl(spark: SparkSession, fetch: Callable[[str, dict], dict], url: str, keywords: Sequence[str], kinds: Sequence[str], path: str, size: int = 50, most: int = 3, schema: str = FOOD) -> DataFrame:
    """The foods of each keyword's first pages as a table of Parquet at ``path``, tagged with ``search_category``.

    The driver holds one keyword's pages at a time. Keywords that the table has are not asked for again, so a broken crawl goes on where it ended.
    """
    for keyword in keywords:
        part = f"{path}/search_category={quote(keyword, safe=' ')}"
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{part}/_SUCCESS")
        if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
            to_table(spark, list(pages(fetch, url, keyword, kinds, size, most)), schema).coalesce(1).write.mode("overwrite").parquet(part)
    return spark.read.schema(f"{schema}, search_category string").parquet(path)
