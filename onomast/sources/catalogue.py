"""Catalogues: the JSON payload, a payload fetched over HTTP, and a Python data source over either."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Places that one value list can hold: brand_ord is list * PLACES + place.
PLACES = 1 << 40


class CatalogueError(RuntimeError):
    """A catalogue that cannot be used; the message says why."""


def adapt(payloads: DataFrame, column: str = "value") -> DataFrame:
    """Brands (brand_ord, code, label, translations) of JSON payloads, one per row.

    Types are strict: an item whose code or label is not a JSON string is dropped, as is a translation whose locale or
    value is not, and a payload without lists gives nothing.  No translations is null.
    """
    v = payloads.select(F.try_parse_json(F.col(column)).alias("v"))
    lists = v.select(_array("v", "$.values_lists").alias("lists")).select(F.posexplode("lists").alias("list", "l"))
    values = lists.select("list", F.posexplode(_array("l", "$.values")).alias("place", "b"))
    text = lambda path: F.when(F.schema_of_variant(F.expr(f"try_variant_get(b, '{path}', 'variant')")) == "STRING", F.expr(f"try_variant_get(b, '{path}', 'string')"))
    brands = values.select((F.col("list").cast("long") * PLACES + F.col("place")).alias("brand_ord"), text("$.code").alias("code"), text("$.label").alias("label"), _array("b", "$.label_translations").alias("t"))
    is_text = lambda x, path: F.schema_of_variant(F.try_variant_get(x, path, "variant")) == "STRING"
    kept = F.filter("t", lambda x: F.coalesce(is_text(x, "$.locale") & is_text(x, "$.value"), F.lit(False)))
    pairs = F.transform(kept, lambda x: F.struct(F.try_variant_get(x, "$.locale", "string").alias("locale"), F.try_variant_get(x, "$.value", "string").alias("value")))
    return brands.where("code is not null and label is not null").select("brand_ord", "code", "label", F.when(F.size(pairs) > 0, pairs).alias("translations"))


def _array(column: str, path: str):
    return F.expr(f"try_variant_get({column}, '{path}', 'array<variant>')")


def read(spark: SparkSession, path: str) -> DataFrame:
    """Brands of a JSON file or folder, each file one payload."""
    brands = adapt(spark.read.text(path, wholetext=True))
    if brands.isEmpty():
        raise CatalogueError("The catalogue holds no usable brands.")
    return brands


def fetch(url: str, token: str | None, get: Callable[[str, dict[str, str]], tuple[int, str]]) -> str:
    """The payload behind a URL; ``get(url, headers)`` gives (status, body).

    Four failures are told apart: no token, a status that is not 2xx, a body that is not JSON, and (in :func:`load`) no
    usable brand.
    """
    if not (token or "").strip():
        raise CatalogueError("Missing API token.")
    status, body = get(url, {"Authorization": f"Bearer {token.strip()}"})
    if not 200 <= status < 300:
        raise CatalogueError(f"The catalogue request failed with HTTP {status}.")
    try:
        json.loads(body)
    except ValueError:
        raise CatalogueError("The catalogue is not valid JSON.") from None
    return body


def load(spark: SparkSession, url: str, token: str | None, get: Callable[[str, dict[str, str]], tuple[int, str]]) -> DataFrame:
    """Brands behind a URL."""
    brands = adapt(spark.createDataFrame([(fetch(url, token, get),)], "value string"))
    if brands.isEmpty():
        raise CatalogueError("The catalogue holds no usable brands.")
    return brands


def http_get(url: str, headers: dict[str, str]) -> tuple[int, str]:
    """A plain GET for :func:`load`."""
    from urllib.error import HTTPError
    from urllib.request import Request, urlopen

    try:
        with urlopen(Request(url, headers=headers)) as r:
            return r.status, r.read().decode("utf-8")
    except HTTPError as e:
        return e.code, ""


class CatalogueSource(DataSource):
    """``spark.read.format("catalogue").option("url", ...).option("token", ...)``: the payload as one row ``value``.

    ``CatalogueSource.get`` is the fetcher, which tests replace; register with ``spark.dataSource.register``.
    """

    get = staticmethod(http_get)

    @classmethod
    def name(cls) -> str:
        return "catalogue"

    def schema(self) -> str:
        return "value string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options), type(self).get)


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str], get):
        self.options, self.get = options, get

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(0)]

    def read(self, partition: InputPartition) -> Iterator[tuple[str]]:
        yield (fetch(self.options["url"], self.options.get("token"), self.get),)
